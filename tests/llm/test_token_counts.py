from __future__ import annotations

import random

import public_tokenizers
from tokenizers import Tokenizer as Library

from pagewatch.llm.token_counts import Tokenizer, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


def texts():
    rng = random.Random(8)
    bits = ["word", "Wörter", " ", " ", " ", "  ", "\n", "\t ", " ", " ", "\u001c", "'s", "'ll", "123", "!!", "<|endoftext|>", "<|endof", "日本語", "🙂", "don't", ".", "x" * 40, "\r\n", "é", "é"]
    return ["".join(rng.choice(bits) for _ in range(rng.choice([1, 5, 40, 300]))) for _ in range(250)] + ["", " ", "  ", " a", "a ", "\n a \n"]


def test_parts_and_chunks_add_up():
    library, mine = Library.from_file(PATH), Tokenizer(PATH)
    for text in texts():
        wanted = len(library.encode(text, add_special_tokens=False).ids)
        assert mine.count(text) == wanted, repr(text)
        for chunk, overlap in ((16, 4), (50, 3), (200, 64)):
            assert mine.count(text, chunk, overlap) == wanted, (repr(text), chunk, overlap)
    for text in ("nospaces" * 4000, " " * 20_000, "日本" * 9000, "a b" * 15_000):
        assert mine.count(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_rows(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts())] + [(None, "null id", None), (5, None, "x"), (5, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    library = Library.from_file(PATH)
    wanted = []
    for i, text, _ in rows:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        wanted.append((i, len((text or "").encode()), n, n > 1024))
    assert sorted(map(str, (tuple(r) for r in token_counts(df, PATH).collect()))) == sorted(map(str, wanted))
    assert token_counts(df.limit(0), PATH).collect() == []
