"""Quality of documents by attention-based multiple-instance learning.

A document is a bag of passages of a fixed number of words. Every passage is encoded from its signs, word lengths and
repetitions by a small learned layer; gated attention, learned from the labels of whole documents, weighs the passages;
and the weighted passage representation is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pagewatch.llm.common import held_out, mix, slices
from pagewatch.session import small

#: Words of a passage.
PASSAGE = 48
#: Labelled documents that are learned from, at most; half of each label where there are as many.
SAMPLE = 2400
THRESHOLD = 0.7
HIDDEN, GATE, STEPS, RATE = 24, 16, 150, 0.04


def sign_table() -> np.ndarray:
    """For every byte: upper case, lower case, digit, line break, space, beyond ASCII, and groups of marks."""
    groups = [str.isupper, str.islower, str.isdigit, lambda c: c in "\n\r", str.isspace, lambda c: ord(c) > 127, lambda c: c in "!", lambda c: c in "#$%&*@", lambda c: c in "|=/<>[]{}_+", lambda c: c in ".,;:?\"'()-"]
    table = np.zeros((256, len(groups)), np.float32)
    for value in range(256):
        for k, test in enumerate(groups):
            table[value, k] = test(chr(value)) if k == 5 or value < 128 else 0
    return table


SIGNS = sign_table()
FEATURES = SIGNS.shape[1] + 9


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts, axis=0)


def passages(texts: list[bytes], words: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of all texts, and how many each text has. A text without words has one empty passage."""
    joined = b"\n".join(texts) + b"\n"
    signs = np.frombuffer(joined, np.uint8)
    blank = SIGNS[signs, 4] > 0
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    text_starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    begins = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    if not len(begins):
        return np.zeros((len(texts), FEATURES), np.float32), np.ones(len(texts), np.int64)
    of_text = np.searchsorted(text_starts, begins, side="right") - 1
    counts = np.bincount(of_text, minlength=len(texts))
    first_word = np.concatenate([[0], np.cumsum(counts)[:-1]])
    number = np.arange(len(begins)) - first_word[of_text]
    opens = np.flatnonzero(number % words == 0)
    # Words as hashes: every byte mixed with its place in the word, added up.
    word_of = np.cumsum(np.concatenate([[True], blank[:-1]]) & ~blank) - 1
    inside = np.flatnonzero(~blank)
    place = inside - begins[word_of[inside]]
    with np.errstate(over="ignore"):
        hashes = sums(mix(signs[inside].astype(np.uint64) + (place.astype(np.uint64) << np.uint64(8))), np.flatnonzero(place == 0))
    sizes = np.diff(np.append(np.flatnonzero(place == 0), len(inside))).astype(np.float32)
    same = np.zeros((len(begins), 9), np.float32)
    same[:, 0], same[:, 1] = sizes / 10, (sizes / 10) ** 2
    for k, lag in enumerate((1, 2, 3, 4)):
        same[lag:, 2 + k] = (hashes[lag:] == hashes[:-lag]) & (of_text[lag:] == of_text[:-lag])
    same[:, 6] = sizes <= 2
    same[:, 7] = sizes >= 15
    per_word = sums(same, opens)
    in_passage = np.diff(np.append(opens, len(begins))).astype(np.float32)
    per_sign = sums(SIGNS[signs], begins[opens])  # bytes up to the next passage, of a following text only its break
    bytes_in = np.diff(np.append(begins[opens], len(signs))).astype(np.float32)
    found = np.concatenate([per_sign / bytes_in[:, None], per_word / in_passage[:, None]], axis=1)
    found[:, -1] = np.log1p(in_passage) / 4
    bags = np.bincount(of_text[opens], minlength=len(texts))
    out, start = np.zeros((len(found) + int((bags == 0).sum()), FEATURES), np.float32), np.maximum(bags, 1)
    filled = np.repeat(bags > 0, start)
    out[filled] = found
    return out, start


@dataclass
class Model:
    """Weights by name: scaling (m, s), encoder (W, b), gated attention (V, U, w), and score (c, d)."""

    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, bags: np.ndarray) -> dict[str, np.ndarray]:
        p = self.weights
        starts = np.concatenate([[0], np.cumsum(bags)[:-1]])
        owner = np.repeat(np.arange(len(bags)), bags)
        z = np.clip((x - p["m"]) / p["s"], -8, 8)
        h = np.tanh(z @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * g) @ p["w"]
        a = np.exp(e - np.maximum.reduceat(e, starts)[owner])
        a = a / np.add.reduceat(a, starts)[owner]
        r = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return {"starts": starts, "owner": owner, "z": z, "h": h, "t": t, "g": g, "a": a, "r": r, "score": 1 / (1 + np.exp(-np.clip(r @ p["c"] + p["d"], -30, 30)))}

    def score(self, x: np.ndarray, bags: np.ndarray) -> np.ndarray:
        return self.forward(x, bags)["score"]


def gradients(model: Model, x: np.ndarray, bags: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    p, f = model.weights, model.forward(x, bags)
    error = weight * (f["score"] - labels)
    owner, h, a, t, g = f["owner"], f["h"], f["a"], f["t"], f["g"]
    dr = error[:, None] * p["c"]
    da = (dr[owner] * h).sum(axis=1)
    de = a * (da - np.add.reduceat(a * da, f["starts"])[owner])
    dt, dg = de[:, None] * p["w"] * g * (1 - t**2), de[:, None] * p["w"] * t * g * (1 - g)
    dh = a[:, None] * dr[owner] + dt @ p["V"].T + dg @ p["U"].T
    dz = dh * (1 - h**2)
    return {"c": f["r"].T @ error, "d": error.sum(keepdims=True), "w": (t * g).T @ de, "V": h.T @ dt, "U": h.T @ dg, "W": f["z"].T @ dz, "b": dz.sum(axis=0)}


def fit(x: np.ndarray, bags: np.ndarray, labels: np.ndarray, steps: int = STEPS, seed: int = 1) -> Model:
    """Both labels weigh as they occur; full batches, adaptive moments and a little decay."""
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(0, shape[0] ** -0.5, shape)
    weights = {"m": x.mean(axis=0), "s": x.std(axis=0) + 1e-3, "W": draw(x.shape[1], HIDDEN), "b": np.zeros(HIDDEN), "V": draw(HIDDEN, GATE), "U": draw(HIDDEN, GATE), "w": draw(GATE), "c": draw(HIDDEN), "d": np.zeros(1)}
    model = Model({k: v.astype(np.float64) for k, v in weights.items()})
    weight = np.full(len(labels), 1 / len(labels))
    first = {k: 0.0 for k in weights}
    second = dict(first)
    for step in range(1, steps + 1):
        for k, d in gradients(model, x, bags, labels, weight).items():
            d = d + 1e-4 * model.weights[k]
            first[k] = 0.9 * first[k] + 0.1 * d
            second[k] = 0.99 * second[k] + 0.01 * d * d
            model.weights[k] = model.weights[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return model


def learn(df: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality") -> Model | None:
    """A model of the labelled documents of ``df``, of which at most ``sample`` are drawn by a hash of their ids.

    Passages are encoded by the tasks, and only their features come to the driver. Documents without label, text or id,
    and labels other than 0 and 1, teach nothing; an id with several labels teaches each. Without both labels there is
    no model.
    """
    named = labels.select(F.col(id_column).alias("id"), F.col(label_column).cast("int").alias("label")).where("id IS NOT NULL AND label IN (0, 1)").distinct()
    totals = {r.label: r.n for r in named.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        return None
    rare = min(totals.values())
    want = {k: sample - min(rare, sample // 2) if totals[k] != rare else min(rare, sample // 2) for k in totals}
    if totals[0] == totals[1]:
        want = {0: sample // 2, 1: sample // 2}
    share = F.pmod(F.xxhash64("id", "label"), F.lit(1 << 30)) / float(1 << 30)
    drawn = named.where((F.col("label") == 0) & (share < want[0] / totals[0]) | (F.col("label") == 1) & (share < want[1] / totals[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                x, bags = passages(batch.column("text").to_pylist())
                ends = np.cumsum(bags)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array([x[e - n : e].tobytes() for e, n in zip(ends, bags)], pa.binary())], ["id", "label", "x"])

    read = df.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").cast("binary").alias("text")).where("text IS NOT NULL")
    found = read.join(small(drawn), "id").select("id", "label", "text").mapInArrow(run, f"id {dict(read.dtypes)['id']}, label int, x binary")
    # The draw is by hash, so its size is near the bound; the order by hash makes it one.
    rows = found.orderBy(F.xxhash64("id", "label"), "id", "label").limit(sample).toArrow()
    x = [np.frombuffer(b.as_buffer(), np.float32).reshape(-1, FEATURES) for b in rows["x"]]
    y = rows["label"].to_numpy().astype(np.float64)
    if len(set(y.tolist())) < 2:
        return None
    weight = np.array([totals[int(k)] / max(1, (y == k).sum()) for k in y])
    return calibrated(np.concatenate(x).astype(np.float64), np.array([len(v) for v in x]), y, weight)


def calibrated(x: np.ndarray, bags: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Model:
    """Fitted on the drawn rows, which hold more of the rare label, and shifted to the shares among all labels."""
    model = fit(x, bags, y)
    prior = (weight * y).sum() / (weight * (1 - y)).sum()
    model.weights["d"] = model.weights["d"] + np.log(prior) - np.log(y.sum() / (1 - y).sum())
    return model


def score(df: DataFrame, model: Model | None, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, held_out, score, predicted) for every row of ``df``, over all passages of its whole text.

    A null text is scored as an empty one, which is one empty passage. Repeated rows and null ids are scored like any
    other row (a null id counts as held out). Without a model every score is 0.5. Other columns are not read.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                texts = [t or b"" for t in batch.column("text").to_pylist()]
                x, bags = passages(texts)
                scores = own.score(x.astype(np.float64), bags) if own else np.full(len(texts), 0.5)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array(scores, pa.float64())], ["id", "held_out", "score"])

    read = df.select(F.col(id_column).alias("id"), held_out(F.col(id_column)).alias("held_out"), F.col(text_column).cast("string").cast("binary").alias("text"))
    scored = read.mapInArrow(run, f"id {dict(read.dtypes)['id']}, held_out boolean, score double")
    return scored.select(F.col("id").alias(id_column), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
