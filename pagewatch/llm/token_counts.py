"""Token counts of whole documents as a byte-level BPE tokenizer gives them, huge documents included.

A huge document is encoded in overlapping chunks with offsets. Two neighbours are spliced where both put a token
boundary at one place that no token of any text can cross: a space between two characters that are no white space, where
the tokenizer's own splitting always cuts. If the overlap holds no such place, it is widened, up to the whole of both.
Documents of ordinary size are cut at the same places, and the count of each part is remembered.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pagewatch.llm.common import MEMO_WORDS, slices

#: Characters of a chunk, and of the first overlap tried.
CHUNK, OVERLAP = 16_384, 512
LIMIT = 1024
#: A space next to other white space or at an end of the text.
LOOSE = re.compile(r"\A | \Z| \s|\s ")
FIRM = re.compile(r"(?<=\S) (?=\S)")


class Tokenizer:
    """One tokenizers file; special strings inside texts are handled as the library does by itself."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer as Library

        self.library = Library.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.first: dict[str, int] = {}
        self.later: dict[str, int] = {}

    def length(self, text: str) -> int:
        return len(self.library.encode(text, add_special_tokens=False).ids)

    def starts(self, text: str, begin: int, end: int) -> np.ndarray:
        """Where the tokens of ``text[begin:end]`` start."""
        return begin + np.array([a for a, _ in self.library.encode(text[begin:end], add_special_tokens=False).offsets], np.int64)

    def remembered(self, known: dict[str, int], part: str, lead: str) -> int:
        count = known.get(part)
        if count is None:
            if len(known) >= MEMO_WORDS:
                known.clear()
            count = known[part] = self.length(lead + part)
        return count

    def count(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        if not text:
            return 0
        if len(text) > chunk:
            return self.spliced(text, chunk, overlap)
        parts = FIRM.split(text) if LOOSE.search(text) else text.split(" ")
        known, total = self.later, self.remembered(self.first, parts[0], "")
        for part in parts[1:]:
            count = known.get(part)
            total += self.remembered(known, part, " ") if count is None else count
        return total

    def spliced(self, text: str, chunk: int, overlap: int) -> int:
        total, firm_from, end = 0, 0, min(len(text), chunk)
        now = self.starts(text, 0, end)
        while end < len(text):
            lap = overlap
            while True:
                begin = max(firm_from, end - lap)
                next_end = min(len(text), begin + max(chunk, 2 * lap))
                following = self.starts(text, begin, next_end)
                shared = np.intersect1d(now[(now > begin) & (now < end)], following)
                cut = next((p for p in shared[::-1].tolist() if text[p] == " " and not text[p - 1].isspace() and not text[p + 1 : p + 2].isspace() and p + 1 < end), None)
                if cut is not None:
                    total += int(np.searchsorted(now, cut)) - int(np.searchsorted(now, firm_from))
                    firm_from = cut
                    break
                if begin == firm_from:  # all of this chunk lies in the next one, which takes its place
                    break
                lap *= 2
            now, end = following, next_end
        return total + len(now) - int(np.searchsorted(now, firm_from))


def token_counts(df: DataFrame, path: str, limit: int = LIMIT, id_column: str = "doc_id", text_column: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row of ``df``: tokens of the whole text by the tokenizers file at
    ``path``, without begin or end tokens.

    The file has to split texts as byte-level BPE does, before a single space between other characters. A null or empty
    text has no bytes and no tokens. Repeated rows and null ids are counted like any other row. Other columns are not
    read. The path has to be readable by all executors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = loaded(path)
        for whole in batches:
            for batch in slices(whole, "text"):
                counts = [tokenizer.count(text, chunk, overlap) if text else 0 for text in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"])

    read = df.select(F.col(id_column).alias("id"), F.coalesce(F.octet_length(text_column), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_column).cast("string").alias("text"))
    counted = read.mapInArrow(run, f"id {dict(read.dtypes)['id']}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_column), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


LOADED: dict[str, Tokenizer] = {}


def loaded(path: str) -> Tokenizer:
    """The tokenizer of a Python worker, with what it remembers, for all its tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in LOADED:
        LOADED[path] = Tokenizer(path)
    return LOADED[path]
