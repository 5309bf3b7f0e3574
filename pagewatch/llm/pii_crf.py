"""Personal data in texts: exact base patterns, and a linear-chain conditional random field that adds what they miss.

The field reads words by their shape (digits, letters, marks, length, what stands before them) and is learned from a small
labelled table. A word without a digit and without an ``@`` is outside by definition, so a text falls apart into short
runs of words that may matter; all runs of a batch are decoded together, by Viterbi over numpy arrays.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pagewatch.llm.common import slices

KINDS = ("email", "ip", "card", "phone")
#: Outside, then first and further words of every kind.
LABELS = ("O", *(f"{part}-{kind}" for kind in KINDS for part in "BI"))
STARTS_CLOSED = np.array([label[0] == "I" for label in LABELS])
CLOSED = np.array([[b[0] == "I" and a[1:] != b[1:] for b in LABELS] for a in LABELS])
NEVER = -1e9

#: Sizes of the labelled table and of what a worker remembers.
LABELLED_ROWS = 1500
MEMO_TOKENS = 100_000
EPOCHS, RATE, DECAY = 150, 0.1, 0.003

CONTINUATIONS = bytes(range(0x80, 0xC0))
FLAT = bytes(32 if b in b"\t\x0b\f" else 10 if b in b"\n\r" else b for b in range(256))
LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(rb"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(rb"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(rb"\+[0-9][ ().0-9-]+[0-9]")
LIVE = re.compile(rb"[0-9@]")
SPACES = re.compile(rb"[ \n]")
NO_DIGIT = bytes(b for b in range(256) if not 48 <= b <= 57)
MARKS = b"\"'<>[]{}#$%&*!?,;:.|=~`^\\/"

#: Words that announce a kind, in a few languages.
CUES = {
    **dict.fromkeys("phone tel telephone call mobile fax cell telefon handy anrufen rufnummer téléphone appelez portable teléfono móvil llame".split(), "phone"),
    **dict.fromkeys("mail email e-mail contact kontakt courriel correo write".split(), "email"),
    **dict.fromkeys("card visa mastercard credit karte kreditkarte carte tarjeta".split(), "card"),
    **dict.fromkeys("ip server host addr gateway rechner serveur servidor".split(), "ip"),
}


def luhn(digits: bytes) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        d -= 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: bytes) -> Iterator[tuple[int, int]]:
    """From every ``@`` to the left and right, which is what leftmost matching finds, in time linear in the text."""
    end, at = 0, text.find(b"@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (found := DOMAIN.match(text, at + 1)):
            end = found.end()
            yield start, end
            at = text.find(b"@", end)
        else:
            at = text.find(b"@", at + 1)


def small_octets(found: bytes) -> bool:
    return all(len(part := x.lstrip(b"0")) < 4 and int(part or b"0") <= 255 for x in found.split(b"."))


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(kind, start, end) in bytes, by kind and place."""
    out = [(0, *span) for span in emails(text)] if b"@" in text else []
    if LIVE.search(text) is None:
        return out
    out += [(1, *m.span()) for m in IP.finditer(text) if small_octets(m[0])]
    for m in CARD.finditer(text):
        if 13 <= m.end() - m.start() and 13 <= len(digits := m[0].translate(None, NO_DIGIT)) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if b"+" in text:
        out += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(m[0].translate(None, NO_DIGIT)) <= 15]
    return out


def runs(text: bytes) -> Iterator[list[tuple[int, int]]]:
    """Runs of neighbouring words of one line that hold a digit or an ``@``, as places in the text, marks around them left out."""
    flat = text.translate(FLAT)
    run: list[tuple[int, int]] = []
    end, run_end, found = 0, 0, LIVE.search(flat)
    while found:
        start = max(flat.rfind(b" ", end, found.start()), flat.rfind(b"\n", end, found.start()), end - 1) + 1
        if run and flat[run_end:start].strip(b" "):
            yield run
            run = []
        stop = SPACES.search(flat, found.end())
        run_end = end = stop.start() if stop else len(flat)
        run.append(core(flat, start, end))
        found = LIVE.search(flat, end)
    if run:
        yield run


def core(flat: bytes, start: int, end: int) -> tuple[int, int]:
    word = flat[start:end]
    left = len(word) - len(word.lstrip(MARKS))
    inner = word.strip(MARKS)
    if b"[" in inner and word[left + len(inner) :].startswith(b"]"):
        inner += b"]"
    if inner.startswith(b"(") and b")" not in inner:
        inner, left = inner[1:], left + 1
    if inner.endswith(b")") and b"(" not in inner:
        inner = inner[:-1]
    return (start + left, start + left + len(inner)) if inner else (start, end)


@lru_cache(MEMO_TOKENS)
def shape(word: bytes) -> str:
    """Capitals, other letters and digits as X, x and 9, each run of them once; long ones by their beginning."""
    out = re.sub(r"9+", "9", re.sub(r"[a-z\x80-\xff]+", "x", re.sub(r"[A-Z]+", "X", re.sub(r"[0-9]", "9", word[:64].decode("latin-1")))))
    return out[:16]


def bucket(n: int) -> int:
    return n if n < 5 else 5 if n < 7 else 7 if n < 10 else 10 if n < 13 else 13 if n < 20 else 20


@lru_cache(MEMO_TOKENS)
def word_features(word: bytes) -> tuple[str, ...]:
    """What a word alone tells."""
    digits = word.translate(None, NO_DIGIT)
    letters = sum(65 <= b <= 90 or 97 <= b <= 122 or b > 127 for b in word[:64])
    out = [f"shape {shape(word)}", f"digits {bucket(len(digits))}", f"letters {min(letters, 3)}"]
    if b"@" in word:
        local, _, domain = word.partition(b"@")
        out.append(f"at {bool(local)} {domain.count(b'.') > 0} {len(domain) > 2}")
    if word.count(b".") == 3 and IP.fullmatch(word):
        out.append(f"octets {small_octets(word)}")
    if word.count(b":") > 1 and not word.strip(b"0123456789abcdefABCDEF:"):
        out.append("colons")
    if 13 <= len(digits) <= 19:
        out.append(f"luhn {luhn(digits)} {not letters}")
    return tuple(out)


#: What the features of a word depend on: its own, the shapes beside it, its place, and what its run is and follows.
Setting = tuple[tuple[str, ...], str, str, str, str, tuple[str, ...]]


def settings(text: bytes, run: list[tuple[int, int]]) -> list[Setting]:
    before = text[max(0, run[0][0] - 48) : run[0][0]].split()[-2:]
    cues = tuple(sorted({CUES[w] for w in (x.strip(MARKS + b"()").decode("utf-8", "replace").lower() for x in before) if w in CUES})) or ("no",)
    words = [text[a : min(b, a + 256)] for a, b in run]
    digits = b"".join(words[:24]).translate(None, NO_DIGIT)
    plain = all(not w[:64].strip(b"0123456789-.()+ ") for w in words[:24])
    whole = f"run {min(len(run), 6)} {bucket(len(digits))} {plain} {luhn(digits) if 13 <= len(digits) <= 19 else '-'}"
    shapes = ["^", *map(shape, words), "$"]
    last = len(run) - 1
    return [(word_features(word), shapes[k], shapes[k + 2], f"place {min(k, 3)} {k == last}", whole, cues) for k, word in enumerate(words)]


def features(setting: Setting) -> list[str]:
    own, before, after, place, whole, cues = setting
    return [*own, *(f"cue {c} {x}" for c in cues for x in ("", own[1], whole)), "bias", whole, place, f"before {before}", f"after {after}"]


def labelled_rows(rows: int = LABELLED_ROWS, seed: int = 12) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """The small labelled table: invented lines with personal data in many writings, and with figures that are none."""
    rng = random.Random(seed)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("aeiouyäéñbcdfghklmnprstvw") for _ in range(rng.randrange(2, 9)))
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    octets = lambda top: ".".join(str(rng.randrange(top)) for _ in range(4))

    def card(valid: bool) -> str:
        d = digits(15)
        last = next(x for x in "0123456789" if luhn((d + x).encode()) == valid)
        d += last
        return rng.choice([d, *[sep.join(d[i : i + 4] for i in range(0, 16, 4)) for sep in " -./"]])

    cued = {kind: [w for w, k in CUES.items() if k == kind] for kind in KINDS}
    found = {
        "phone": [lambda: f"+{rng.randrange(1, 99)} ({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"{digits(3)}-{digits(3)}-{digits(4)}", lambda: f"+{rng.randrange(20, 99)} {digits(2)} {digits(4)} {digits(4)}", lambda: f"+{digits(11)}"],
        "card": [lambda: card(True)],
        "ip": [lambda: octets(256), lambda: ":".join(hexes(4) for _ in range(8))],
        "email": [lambda: f"{word()}.{digits(2)}@{word()}{digits(1)}.example.com", lambda: f"{word()}@{word()}.org", lambda: f"{word()}@[{octets(256)}]"],
    }
    announced = {"phone": [lambda: f"{digits(3)} {digits(3)} {digits(4)}", lambda: f"0{digits(2)} {digits(7)}", lambda: f"{digits(10)}", lambda: f"{digits(3)}.{digits(3)}.{digits(4)}", lambda: f"0{digits(3)}/{digits(6)}"], "email": [lambda: f"{word()}@{word()}"], "card": [], "ip": []}
    none = [
        lambda: str(rng.randrange(1900, 2030)), lambda: digits(rng.randrange(1, 9)), lambda: digits(rng.randrange(9, 30)), lambda: f"{digits(2)}.{digits(2)}.20{digits(2)}", lambda: f"20{digits(2)}-{digits(2)}-{digits(2)}",
        lambda: f"{digits(2)}:{digits(2)}:{digits(2)}", lambda: f"{digits(1)},{digits(3)}.{digits(2)}", lambda: f"{digits(2)} {digits(3)} {digits(3)}", lambda: f"{digits(1)}.{digits(2)}.{digits(1)}", lambda: f"v{octets(30)}", lambda: f"{octets(256)}.{digits(1)}",
        lambda: f"{rng.randrange(256, 999)}.{octets(256)[:-2]}", lambda: ".".join(str(rng.randrange(256, 999)) for _ in range(4)), lambda: card(False), lambda: card(False), lambda: f'"{hexes(rng.choice([16, 32, 40]))}"', lambda: hexes(rng.choice([8, 32, 64])), lambda: f"{word()}{digits(2)}", lambda: f"#{digits(6)}", lambda: f"@{word()}",
        lambda: f"{digits(3)}-{digits(4)}", lambda: f"{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}", lambda: f"AKIA{hexes(16).upper()}", lambda: f"{word()} @ {digits(2)}", lambda: f"{digits(3)} {digits(3)} {digits(4)}", lambda: f"{digits(4)} {digits(4)}", lambda: f"{word()}={digits(6)}", lambda: f"{digits(3)}.{digits(3)}.{digits(4)}",
    ]
    out = []
    for _ in range(rows):
        text, spans = " ".join(word() for _ in range(rng.randrange(1, 5))), []
        for _ in range(rng.randrange(1, 3)):
            kind = rng.choice([*KINDS, "phone", None, None, None, None])
            if kind is None:
                item = rng.choice(none)()
                if rng.random() < 0.1:
                    text += f" {rng.choice(list(CUES))}"
                    item = rng.choice([digits(rng.randrange(1, 7)), f"20{digits(2)}-{digits(2)}-{digits(2)}", card(False)])
            elif announced[kind] and rng.random() < 0.4:
                text += f" {rng.choice(cued[kind])}{rng.choice([':', '', '', '.'])}"
                item = rng.choice(announced[kind])()
            else:
                if rng.random() < 0.2:
                    text += f" {rng.choice(cued[kind])}{rng.choice([':', ''])}"
                item = rng.choice(found[kind])()
            start = len(text) + 1
            text += f" {item}"
            if kind is not None:
                spans.append((kind, start, len(text)))
            text += rng.choice(["", "", ",", ".", "!!", "###"]) + "".join(f" {word()}" for _ in range(rng.randrange(1, 5)))
        out.append((text, spans))
    return out


def labelled_table(spark: SparkSession) -> DataFrame:
    """``labelled_rows`` as a table (text, spans)."""
    return spark.createDataFrame(labelled_rows(), "text string, spans array<struct<kind: string, start: int, end: int>>")


def code_points(text: bytes, places: list[int]) -> dict[int, int]:
    """Code points before each of the places in bytes; one pass over the text."""
    out, last, total = {}, 0, 0
    for place in sorted(set(places)):
        total += len(text[last:place].translate(None, CONTINUATIONS))
        out[place], last = total, place
    return out


class Field:
    """Weights of features by label, and of neighbouring labels."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, start: np.ndarray, step: np.ndarray) -> None:
        self.names, self.weights, self.start, self.step = names, weights, start, step
        self.known: dict[Setting, np.ndarray] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}

    def scores(self, words: list[Setting]) -> np.ndarray:
        """[word, label]; features that were never seen count nothing. Settings are remembered, up to a number of them."""
        if len(self.known) > MEMO_TOKENS:
            self.known.clear()
        for setting in words:
            if setting not in self.known:
                self.known[setting] = self.weights[[self.names[f] for f in features(setting) if f in self.names]].sum(axis=0)
        return np.array([self.known[setting] for setting in words])

    def decode(self, lengths: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """The best labels of runs that follow each other in ``scores``; runs of one length are decoded together."""
        labels, ends = np.zeros(len(scores), np.int8), np.cumsum(lengths)
        for length in np.unique(lengths):
            at = (ends[lengths == length] - length)[:, None] + np.arange(length)
            best = scores[at[:, 0]] + self.start
            back = np.zeros((length, len(at), len(LABELS)), np.int8)
            for k in range(1, length):
                ways = best[:, :, None] + self.step
                back[k] = ways.argmax(axis=1)
                best = np.take_along_axis(ways, back[k][:, None, :].astype(np.int64), axis=1)[:, 0] + scores[at[:, k]]
            now = best.argmax(axis=1)
            for k in range(length - 1, -1, -1):
                labels[at[:, k]] = now
                now = back[k][np.arange(len(at)), now]
        return labels


def expectations(scores: np.ndarray, start: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For runs of one length, [run, word, label]: chances of labels, summed chances of neighbours, and the logarithms of the sums over all labellings."""
    n, length, _ = scores.shape
    sums = lambda x, axis: (top := x.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - top).sum(axis=axis))
    forward, backward = np.empty_like(scores), np.zeros_like(scores)
    forward[:, 0] = scores[:, 0] + start
    for k in range(1, length):
        forward[:, k] = sums(forward[:, k - 1][:, :, None] + step, 1) + scores[:, k]
    for k in range(length - 2, -1, -1):
        backward[:, k] = sums(step + (scores[:, k + 1] + backward[:, k + 1])[:, None, :], 2)
    whole = sums(forward[:, -1], 1)
    pairs = np.zeros_like(step)
    for k in range(1, length):
        pairs += np.exp(forward[:, k - 1][:, :, None] + step + (scores[:, k] + backward[:, k])[:, None, :] - whole[:, None, None]).sum(axis=0)
    return np.exp(forward + backward - whole[:, None, None]), pairs, whole


def gold(text: bytes, run: list[tuple[int, int]], spans: list[tuple[str, int, int]], points: dict[int, int]) -> list[int]:
    """Labels of a run by spans in code points."""
    out = []
    for a, b in run:
        label = 0
        for kind, start, end in spans:
            if points[a] < end and points[b] > start:
                label = LABELS.index(f"{'B' if points[a] <= start or not out else 'I'}-{kind}")
        out.append(label)
    return out


@lru_cache(4)
def fitted(rows: tuple[tuple[str, tuple[tuple[str, int, int], ...]], ...]) -> Field:
    """The field of greatest likelihood, with decayed weights, for labelled rows; one fit a process."""
    words, lengths, labels = [], [], []
    for line, spans in rows:
        text = line.encode()
        for run in runs(text):
            points = code_points(text, [p for span in run for p in span])
            words += map(features, settings(text, run))
            labels += gold(text, run, list(spans), points)
            lengths.append(len(run))
    names = {f: k for k, f in enumerate(sorted({f for fs in words for f in fs}))}
    cuts = np.cumsum([0, *map(len, words)])
    flat = np.array([names[f] for fs in words for f in fs])
    owner = np.repeat(np.arange(len(words)), np.diff(cuts))
    labels, lengths = np.array(labels, dtype=np.int64), np.array(lengths)
    ends, size = np.cumsum(lengths), len(LABELS)
    wanted = np.eye(size)[labels]
    weights, start, step = np.zeros((len(names) + 1, size)), np.where(STARTS_CLOSED, NEVER, 0.0), np.where(CLOSED, NEVER, 0.0)
    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in (weights, start, step)]
    groups = [(ends[lengths == n] - n)[:, None] + np.arange(n) for n in np.unique(lengths)]
    for epoch in range(1, EPOCHS + 1):
        scores = np.add.reduceat(weights[flat], cuts[:-1], axis=0)
        chances, of_start, of_step = np.zeros_like(scores), np.zeros(size), np.zeros((size, size))
        for at in groups:
            chance, pairs, _ = expectations(scores[at], start, step)
            chances[at] = chance
            of_start += wanted[at[:, 0]].sum(axis=0) - chance[:, 0].sum(axis=0)
            of_step -= pairs
            for k in range(1, at.shape[1]):
                np.add.at(of_step, (labels[at[:, k - 1]], labels[at[:, k]]), 1)
        of_weights = np.zeros_like(weights)
        np.add.at(of_weights, flat, (wanted - chances)[owner])
        for x, slope, (mean, square) in zip((weights, start, step), (of_weights, of_start, of_step), moments):
            slope = slope / len(lengths) - DECAY * np.where(x > NEVER / 2, x, 0) / 10
            mean += 0.1 * (slope - mean)
            square += 0.01 * (slope * slope - square)
            x += RATE * (mean / (1 - 0.9**epoch)) / (np.sqrt(square / (1 - 0.99**epoch)) + 1e-8) * (x > NEVER / 2)
    return Field(names, weights, start, step)


def learn(labelled: DataFrame | None = None, rows: int = LABELLED_ROWS) -> Field:
    """The field learned from at most ``rows`` rows of ``labelled`` (text, spans), by default from ``labelled_rows``."""
    if labelled is None:
        found = labelled_rows(rows)
    else:
        found = [(r.text, r.spans) for r in labelled.where("text IS NOT NULL").orderBy(F.xxhash64("text"), "text").limit(rows).collect()]
    return fitted(tuple((text, tuple(tuple(s) for s in spans or ())) for text, spans in found))


def added_spans(field: Field, texts: list[bytes], base: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
    """What the field finds in each text outside its base spans, (kind, start, end) in bytes."""
    found = [(n, run) for n, text in enumerate(texts) if text for run in runs(text)]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not found:
        return out
    scores = field.scores([setting for n, run in found for setting in settings(texts[n], run)])
    labels = field.decode(np.array([len(run) for _, run in found]), scores)
    at = 0
    for n, run in found:
        own = labels[at : at + len(run)]
        at += len(run)
        if not own.any():
            continue
        k = 0
        while k < len(run):
            if own[k] == 0:
                k += 1
                continue
            last = k
            while last + 1 < len(run) and own[last + 1] and LABELS[own[last + 1]][0] == "I":
                last += 1
            out[n].append(((int(own[k]) - 1) // 2, run[k][0], run[last][1]))
            k = last + 1
    for n, spans in enumerate(out):
        if spans and base[n]:
            taken = sorted((a, b) for _, a, b in base[n])
            highest = np.maximum.accumulate([b for _, b in taken])
            before = np.searchsorted([a for a, _ in taken], [b for _, _, b in spans])
            out[n] = [s for s, k in zip(spans, before) if k == 0 or highest[k - 1] <= s[1]]
    return out


SPANS = "array<struct<kind: string, start: long, end: long, base: boolean>>"


def personal_data(df: DataFrame, field: Field | None = None, id_column: str = "doc_id", text_column: str = "text", masked: bool = False) -> DataFrame:
    """(id, spans), and the text with spans replaced by their kinds if ``masked``, for every row of ``df``.

    Spans are places in code points, end exclusive, by kind in the order of ``KINDS`` and then by start. Base spans are
    all leftmost matches of a kind's pattern that pass its check; kinds do not hide each other. The field adds spans
    that touch no base span. A null or empty text has none. Rows are told apart by nothing and repeated rows answer
    alike; texts of any length are read whole, in time linear in their length. Other columns are not read.
    """
    field = field or learn()
    kind = dict(df.select(F.col(id_column).alias("id")).dtypes)["id"]
    shared = df.sparkSession.sparkContext.broadcast(field)  # a few thousand weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            for batch in slices(whole, "text"):
                texts = [text or b"" for text in batch.column("text").to_pylist()]
                base = [base_spans(text) for text in texts]
                added = added_spans(model, texts, base)
                rows, clean = [], []
                for text, own, more in zip(texts, base, added):
                    spans = sorted([(*s, True) for s in own] + [(*s, False) for s in more])
                    points = code_points(text, [p for _, a, b, _ in spans for p in (a, b)])
                    rows.append([{"kind": KINDS[k], "start": points[a], "end": points[b], "base": sure} for k, a, b, sure in spans])
                    if masked:
                        clean.append(covered(text, spans))
                columns = [batch.column("id"), pa.array(rows, SPAN_TYPE)] + ([pa.array(clean, pa.string())] if masked else [])
                yield pa.RecordBatch.from_arrays(columns, ["id", "spans", "text"][: len(columns)])

    rows = df.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, spans {SPANS}" + (", text string" if masked else "")).withColumnRenamed("id", id_column)


SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


def covered(text: bytes, spans: list[tuple[int, int, int, bool]]) -> str:
    """The text with every stretch that spans cover replaced by the kind of the span that begins it."""
    out, end = [], 0
    for kind, start, stop, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= end:
            out += [text[end:start], f"[{KINDS[kind].upper()}]".encode()]
        end = max(end, stop)
    return b"".join([*out, text[end:]]).decode("utf-8", "replace")


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(df: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Counts and checksum of base spans, and the list of all spans, of what ``personal_data`` returns."""
    base = F.filter("spans", lambda s: s["base"])
    of = lambda kind: F.filter(base, lambda s: s["kind"] == kind)
    counts = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return df.select(id_column, *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
