"""Languages by prediction by partial matching: exact code lengths of bytes under frozen statistics of each language.

Every language has a tree of byte contexts up to three bytes long. A byte seen in a context costs its share there; a
byte not seen costs an escape, and is then coded in the next shorter context, down to a uniform code. What a byte costs
in every context of the tree is worked out once, so a text is scored by two look-ups a byte for all languages at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from pagewatch.llm.common import held_out, released, slices
from pagewatch.session import durable

DEPTH = 3
#: A context grows when it has at least this share of the bytes of a language, so that a tree has at most 1 / LEAST_SHARE
#: contexts of any length, however large the corpus is.
LEAST_SHARE = 2e-5
#: Byte values fall into classes: letters regardless of ASCII case, digits, marks and white space as one class each.
SIGNS = 160
PAD = 3
#: Text that is counted and scored at a time; both take many times its room.
COUNTED_BYTES, SCORED_BYTES = 1 << 20, 1 << 18
LETTER = regex.compile(r"\p{L}")


def byte_classes() -> np.ndarray:
    classes = np.zeros(256, np.int64)
    for value in range(128):
        sign = chr(value)
        classes[value] = 4 + ord(sign.lower()) - ord("a") if sign.isalpha() else 1 if sign.isdigit() else PAD if sign.isspace() else 2
    classes[128:] = 32 + np.arange(128)
    return classes


CLASSES = byte_classes()


def signs_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all bytes, each text led by ``DEPTH`` spaces; and where the bytes of each text start."""
    pad = b" " * DEPTH
    joined = np.frombuffer(pad + pad.join(texts), np.uint8)
    lengths = np.array([len(t) for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths + DEPTH)[:-1]]) + DEPTH if len(texts) else lengths
    return CLASSES[joined], starts


def runs(signs: np.ndarray, base: int) -> np.ndarray:
    """For every place from ``DEPTH`` on, the byte and the ``DEPTH`` before it as one number."""
    code = signs[: len(signs) - DEPTH].astype(np.int64)
    for k in range(1, DEPTH + 1):
        code = code * base + signs[k : len(signs) - DEPTH + k]
    return code


@dataclass(frozen=True)
class Model:
    """``cost[node, sign, language]`` in bits; ``node_of`` gives the longest context of the trees for ``DEPTH`` signs."""

    languages: list[str]
    dense: np.ndarray
    node_of: np.ndarray
    cost: np.ndarray

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code lengths of texts, a column for each language."""
        total = np.zeros((len(texts), len(self.languages)))
        filled = [i for i, t in enumerate(texts) if t]
        if filled and self.languages:
            signs, starts = signs_of([texts[i] for i in filled])
            signs = self.dense[signs]
            base = self.cost.shape[1]
            code = signs[: len(signs) - DEPTH].astype(np.int64)
            for k in range(1, DEPTH):
                code = code * base + signs[k : len(signs) - DEPTH + k]
            node = self.node_of[code]
            sign = signs[DEPTH:]
            flat = self.cost.reshape(-1, len(self.languages))
            costs = flat[node.astype(np.int64) * base + sign]
            keep = np.ones(len(sign), bool)
            for k in range(1, DEPTH + 1):  # the spaces that lead every text but the first
                keep[starts[1:] - k - DEPTH] = False
            ends = np.cumsum(keep)
            bounds = np.concatenate([[0], ends[starts[1:] - DEPTH - 1]]) if len(starts) > 1 else np.array([0])
            total[filled] = np.add.reduceat(costs[keep].astype(np.float64), bounds, axis=0)
        return total


def counted(df: DataFrame) -> DataFrame:
    """(lang, run, n): how often each run of ``DEPTH + 1`` byte classes occurs in the texts (lang, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def add(lang: str, codes: np.ndarray) -> None:
            values, n = np.unique(codes, return_counts=True)
            if lang in sums:
                old, m = sums[lang]
                values, place = np.unique(np.concatenate([old, values]), return_inverse=True)
                n = np.bincount(place, np.concatenate([m, n])).astype(np.int64)
            sums[lang] = values, n

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, (values, n) in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values)), pa.array(values), pa.array(n)], ["lang", "run", "n"])
            sums.clear()

        for whole in batches:
            for batch in slices(whole, "text", COUNTED_BYTES):
                by_lang: dict[str, list[bytes]] = {}
                for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                    if text:
                        by_lang.setdefault(lang, []).append(text)
                for lang, texts in by_lang.items():
                    signs, starts = signs_of(texts)
                    keep = np.ones(len(signs) - DEPTH, bool)
                    for k in range(1, DEPTH + 1):
                        keep[starts[1:] - k - DEPTH] = False
                    add(lang, runs(signs, SIGNS)[keep])
                if sum(len(v) for v, _ in sums.values()) > 1_000_000:
                    yield from flush()
        yield from flush()

    return df.mapInArrow(released(count), "lang string, run long, n long").groupBy("lang", "run").agg(F.sum("n").alias("n"))


def learn(df: DataFrame, text_column: str = "text", lang_column: str = "lang", least_share: float = LEAST_SHARE) -> Model:
    """Trees of all languages named in ``df``, counted over all its rows that have a language and a text.

    Contexts are pruned by Spark before the statistics come to the driver. Those of a full-length context are kept where
    its share is large enough in a language; what is pruned still counts in the shorter contexts.
    """
    rows = df.where(F.col(lang_column).isNotNull() & F.col(text_column).isNotNull())
    table = durable(counted(rows.select(F.col(lang_column).cast("string").alias("lang"), F.col(text_column).cast("string").cast("binary").alias("text"))))
    totals = {r.lang: r.n for r in table.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(totals)
    place = {lang: i for i, lang in enumerate(languages)}
    if not languages:
        return Model([], np.zeros(SIGNS, np.int64), np.zeros(1, np.int32), np.zeros((1, 1, 0), np.float32))
    # As an Arrow table it takes no Python workers of its own, which would stand idle beside the others of an executor.
    least = pa.table({"lang": pa.array(list(totals), pa.string()), "least": pa.array([max(1.0, v * least_share) for v in totals.values()], pa.float64())})
    large = F.broadcast(table.sparkSession.createDataFrame(least))
    levels = []
    for order in range(DEPTH + 1):
        cut = F.col("run") % F.lit(SIGNS ** (order + 1))
        grams = table.groupBy("lang", cut.alias("gram")).agg(F.sum("n").alias("n"))
        if order:
            context = F.floor(F.col("gram") / SIGNS)
            kept = grams.groupBy("lang", context.alias("context")).agg(F.sum("n").alias("of")).join(large, "lang").where("of >= least").select("context").distinct()
            grams = grams.withColumn("context", context).join(kept, "context", "left_semi")
        found = grams.select("lang", "gram", "n").toArrow()
        levels.append((np.array([place[x] for x in found["lang"].to_pylist()], np.int64), found["gram"].to_numpy().astype(np.int64), found["n"].to_numpy().astype(np.float64)))
    return built(languages, levels)


def built(languages: list[str], levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Model:
    seen = np.unique(levels[0][1])
    dense = np.zeros(SIGNS, np.int64)  # sign 0 stands for all that was never seen
    dense[seen] = np.arange(1, len(seen) + 1)
    base, many = len(seen) + 1, len(languages)

    def dense_gram(grams: np.ndarray, order: int) -> np.ndarray:
        out = np.zeros(len(grams), np.int64)
        for k in range(order, -1, -1):
            out = out * base + dense[grams // SIGNS**k % SIGNS]
        return out

    costs, suffix_node, first = [], np.zeros(1, np.int64), 0
    for order, (lang, grams, n) in enumerate(levels):
        gram = dense_gram(grams, order)
        contexts, at = np.unique(gram // base, return_inverse=True)
        counts = np.zeros((len(contexts), base, many), np.float32)
        counts[at, gram % base, lang] = n
        if order == 0:
            shorter = np.full((1, base, many), np.log2(base), np.float32)
        else:
            shorter = np.concatenate(costs)[suffix_node[contexts % base ** (order - 1)]]
        total, kinds = counts.sum(axis=1, keepdims=True), (counts > 0).sum(axis=1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            cost = np.where(counts > 0, np.log2((total + kinds) / counts), np.log2((total + kinds) / kinds) + shorter)
        costs.append(np.where(total > 0, cost, shorter).astype(np.float32))
        # Longest known context for every run of ``order`` signs.
        nodes = np.tile(suffix_node, base) if order else suffix_node
        nodes[contexts] = first + np.arange(len(contexts))
        suffix_node, first = nodes, first + len(contexts)
    return Model(languages, dense, suffix_node.astype(np.int32), np.concatenate(costs))


def predict(df: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text", unknown: str = "und") -> DataFrame:
    """(id, held_out, lang_pred, score, bits_per_byte) for every row of ``df``.

    The language with the shortest code wins, the first by name among equals; ``score`` is its share of the likelihood.
    Texts that are null or hold no letter, and all texts if no language was learned, are ``unknown`` with score 0.
    ``bits_per_byte`` is the shortest code per byte, 0 for an empty text. Repeated rows and null ids are scored like any
    other row (a null id counts as held out). Other columns are not read.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for whole in batches:
            for batch in slices(whole, "text", SCORED_BYTES):
                texts = [t.encode() if t else b"" for t in batch.column("text").to_pylist()]
                bits = own.bits(texts)
                names, scores, rates = [], [], []
                for text, row in zip(texts, bits):
                    if not own.languages or not LETTER.search(text.decode()):
                        names.append(unknown)
                        scores.append(0.0)
                    else:
                        names.append(own.languages[int(row.argmin())])
                        scores.append(float(1 / np.exp2(np.maximum(row.min() - row, -1000)).sum()))
                    rates.append(float(row.min() / len(text)) if text and own.languages else 0.0)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rates, pa.float64())], ["id", "held_out", "lang_pred", "score", "bits_per_byte"])

    read = df.select(F.col(id_column).alias("id"), held_out(F.col(id_column)).alias("held_out"), F.col(text_column).cast("string").alias("text"))
    scored = read.mapInArrow(released(run), f"id {dict(read.dtypes)['id']}, held_out boolean, lang_pred string, score double, bits_per_byte double")
    return scored.withColumnRenamed("id", id_column)


def kept(df: DataFrame, model: Model, text_column: str = "text", unknown: str = "und") -> DataFrame:
    """The rows of ``df`` whose text is in a learned language, with ``lang_pred``. Null texts and texts without a letter,
    which are ``unknown``, go. The decision is made in the pass over the rows, without a join."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for whole in batches:
            for batch in slices(whole, text_column, SCORED_BYTES):
                texts = [t.encode() if t else b"" for t in batch.column(text_column).to_pylist()]
                bits = own.bits(texts)
                names = [own.languages[int(r.argmin())] if own.languages and LETTER.search(t.decode()) else unknown for t, r in zip(texts, bits)]
                out = batch.append_column("lang_pred", pa.array(names, pa.string()))
                yield out.filter(pa.array([n != unknown for n in names], pa.bool_()))

    return df.mapInArrow(released(run), T.StructType([*df.schema.fields, T.StructField("lang_pred", T.StringType())]))
