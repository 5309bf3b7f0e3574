"""SentencePiece encoding, decoding, and sampled segmentations without replacement.

A text is cut where no piece can lie across: before a space between two other characters. The segmentations of each
part form a lattice of pieces, whose backward sums give the exact share of every edge, so a search that follows
Gumbel-perturbed scores needs no estimates: the best perturbed completion of a prefix is known as soon as the prefix is.
The search keeps a queue of sets of segmentations, each of them all that agree with an emitted one up to some part and
differ there. The set with the highest perturbed score is taken, a member is drawn and emitted, and what remains of the
set is split in the same way. So the emitted segmentations are distinct and are the top of all perturbed scores.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from pagewatch.llm.common import merged, mix, released

SPACE = "▁"
#: Segmentations of a document, and how sharply probable ones are preferred.
SAMPLES, ALPHA = 4, 1.5
#: Steps of a part for which draws are made for all rows at once.
FIRST_STEPS = 8
#: Parts that the library encodes in one call.
ENCODED_AT_ONCE = 1024
#: Text that one step of a task works on at a time: the more, the more of its parts are alike, and each is worked out once.
BATCH_BYTES = 7 << 20
FIRM = re.compile("(?<=[^ ]) (?=[^ ])")
NONE = float("-inf")


def offsets_of(lengths: np.ndarray) -> np.ndarray:
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    return offsets


def gathered(offsets: np.ndarray, values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of ``rows`` of a list of lists, one after another, and how many each row has."""
    places, lengths = places_of(offsets, rows)
    return values[places], lengths


def places_of(offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the values of ``rows`` of a list of lists stand, one after another, and how many each row has."""
    starts = offsets[rows]
    lengths = offsets[rows + 1] - starts
    ends = np.cumsum(lengths)
    places = np.repeat(starts - (ends - lengths), lengths)
    places += np.arange(len(places))
    return places, lengths


def parts_of(text: str) -> list[str]:
    """Parts that are encoded apart; the space before each but the first is the library's own leading space."""
    if not text:
        return []
    parts = text.split(" ")
    return parts if "" not in parts else FIRM.split(text)


def single_spaced(text: str) -> bool:
    """Whether the parts of ``text`` are what lies between its spaces."""
    return bool(text) and "  " not in text and text[0] != " " and text[-1] != " "


class Vocabulary:
    """The pieces of a model file, found by hash, with log probabilities by rank: a file of merges has ranks for scores."""

    def __init__(self, path: str, alpha: float):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        size = self.library.get_piece_size()
        kept = [i for i in range(size) if not (self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i) or self.library.is_unused(i))]
        ranks = np.array([min(size, -self.library.get_score(i)) for i in kept])
        log_norm = np.log(np.sum(1 / (ranks + 10)))
        names = [self.library.id_to_piece(i) for i in kept]
        self.longest = max(map(len, names))
        # Hashes of all pieces and of what they begin with, character by character.
        hashes, lengths = np.zeros(len(names), np.uint64), np.array([len(n) for n in names])
        signs = np.array(names).view(np.uint32).reshape(len(names), -1).astype(np.uint64)
        self.begins = np.zeros(1 << 20, bool)
        for k in range(self.longest):
            on = np.flatnonzero(lengths > k)
            hashes[on] = self.extended(hashes[on], signs[on, k])
            self.begins[(hashes[on] >> np.uint64(44)).astype(np.int64)] = True
        order = np.argsort(hashes)
        self.hashes, self.ids, self.scores = hashes[order], np.array(kept, np.int32)[order], alpha * (-np.log(ranks + 10) - log_norm)[order]
        # By the first 20 bits of a hash: where such hashes begin (-1: there are none) and how many there are.
        lead = (self.hashes >> np.uint64(44)).astype(np.int64)
        self.crowd = np.bincount(lead, minlength=1 << 20).astype(np.uint16)
        self.slot = np.where(self.crowd > 0, np.cumsum(self.crowd, dtype=np.int64) - self.crowd, -1).astype(np.int32)
        self.byte_score = alpha * (-np.log(size + 10) - log_norm)
        self.first_byte = next(i for i in range(size) if self.library.is_byte(i))

    @staticmethod
    def extended(h: np.ndarray, signs: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (h + signs + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        return h ^ (h >> np.uint64(29))

    def look_up(self, h: np.ndarray) -> np.ndarray:
        """Places of pieces, -1 for what is no piece."""
        lead = (h >> np.uint64(44)).astype(np.int64)
        out = self.slot[lead]  # a slot of -1 meets the last hash, which is then another
        other = np.flatnonzero(self.hashes[out] != h)
        many = np.where(out[other] < 0, 0, self.crowd[lead[other]])
        at = out[other]
        out[other] = -1
        for k in range(1, int(many.max()) if len(many) else 0):
            left = np.flatnonzero(many > k)
            good = left[self.hashes[at[left] + k] == h[other[left]]]
            out[other[good]] = at[good] + k
        return out


@dataclass
class Lattices:
    """The lattices of distinct parts. Nodes are places in a part, edges of a node lie side by side."""

    first_node: np.ndarray  # of each part
    nodes: np.ndarray  # number of inner nodes of each part, its characters
    edge_at: np.ndarray  # first edge of each node
    node: np.ndarray  # of each edge, the node it leaves
    target: np.ndarray  # of each edge, the node it leads to, or -1 at the end of a part
    share: np.ndarray  # of each edge at its node, by all completions
    above: np.ndarray  # sum of the shares of a node's edges up to and with this one
    id_at: np.ndarray  # ids of each edge
    ids: np.ndarray
    best_at: np.ndarray  # edges of each part's leading segmentation, which takes the edge with the largest share everywhere
    best: np.ndarray
    log_best: np.ndarray
    log_rest: np.ndarray  # of all other segmentations together
    parting: np.ndarray  # for each edge of a leading one: share of the others that part from it up to here

    @property
    def log_share(self) -> np.ndarray:
        return log_of(self.share)


def edges_of(signs: np.ndarray, ends: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First edge of every node, and characters and place of the piece of every edge, by node and length. A node is followed
    as long as some piece begins with what was read; a character that is no piece is an edge of its own, of place -1."""
    reading, h, found = np.arange(len(signs), dtype=np.int32), np.zeros(len(signs), np.uint64), []
    many = np.zeros(len(signs), np.int32)
    for k in range(vocabulary.longest):
        if k:
            on = reading + k < ends[reading]
            reading, h = reading[on], h[on]
        if not len(reading):
            break
        h = vocabulary.extended(h, signs[reading + k])
        on = vocabulary.begins[(h >> np.uint64(44)).astype(np.int32)]
        piece = np.full(len(reading), -1, np.int32)
        piece[on] = vocabulary.look_up(h[on])
        # Every place has an edge of one character.
        hit = np.flatnonzero(piece >= 0) if k else slice(None)
        node = reading[hit]
        rank = many[node]
        found.append((node, rank, piece[hit]))
        many[node] = rank + 1
        reading, h = reading[on], h[on]
    edge_at = offsets_of(many)
    step, place = np.empty(int(edge_at[-1]), np.int32), np.empty(int(edge_at[-1]), np.int32)
    for k, (node, rank, piece) in enumerate(found):
        at = edge_at[node] + rank
        step[at], place[at] = k + 1, piece
    return edge_at, step, place


def alike(far: np.ndarray, fan: np.ndarray) -> list[np.ndarray]:
    """Nodes of equal distance ``far`` and number of edges ``fan``, the nearest to their ends first."""
    wide = int(fan.max()) + 1
    key = far.astype(np.int64) * wide + fan
    key = key.astype(np.int16) if key.max() < 1 << 15 else key  # short keys sort faster
    order = np.argsort(key, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(key[order])) + 1)


def log_of(share: np.ndarray) -> np.ndarray:
    return np.log(np.maximum(share, 1e-300))


def lattices(parts: list[str], vocabulary: Vocabulary) -> Lattices:
    names = [SPACE + p.replace(" ", SPACE) for p in parts]
    lengths = np.array([len(n) for n in names], np.int64)
    signs = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    first, total = offsets_of(lengths), int(lengths.sum())
    ends = np.repeat(first[1:], lengths).astype(np.int32)
    edge_at, step, piece = edges_of(signs, ends, vocabulary)
    fan = np.diff(edge_at)
    node = np.repeat(np.arange(total, dtype=np.int32), fan)
    target = node + step
    target[target >= np.repeat(ends, fan)] = total
    raw = np.flatnonzero(piece < 0)
    code = signs[node[raw]]
    scores = vocabulary.scores[piece]
    scores[raw] = vocabulary.byte_score * (1 + (code > 0x7F).astype(np.int64) + (code > 0x7FF) + (code > 0xFFFF))
    # Backward sums over all completions, for all places that are equally far from the end of their part and have equally
    # many edges, a row of arrays for each edge; and the edge with the largest share at each place.
    sums = np.zeros(total + 1)
    share, above, leading = np.empty(len(node)), np.empty(len(node)), np.empty(total, np.int64)
    for nodes in alike(ends - np.arange(total, dtype=np.int32), fan) if total else []:
        first_edges, many = edge_at[nodes], int(fan[nodes[0]])
        if many == 1:
            sums[nodes] = scores[first_edges] + sums[target[first_edges]]
            share[first_edges] = above[first_edges] = 1.0
            leading[nodes] = first_edges
            continue
        edges = first_edges + np.arange(many)[:, None]
        through = scores[edges] + sums[target[edges]]
        top = through.max(axis=0)
        weight = np.exp(through - top)
        whole = weight[1].copy()
        for more in weight[2:]:
            whole += more
        whole += weight[0]
        sums[nodes] = top + np.log(whole)
        lead = edges[-1]
        for k in range(many - 2, -1, -1):
            lead = np.where(weight[k] == 1.0, edges[k], lead)
        leading[nodes] = lead
        weight /= whole
        share[edges] = weight
        above[edges] = np.cumsum(weight, axis=0)
    target[target == total] = -1
    # Ids: one of a piece, or those of the bytes of a character that is no piece.
    encoded = [chr(int(c)).encode("utf-8", "surrogatepass") for c in code]
    id_at = np.arange(len(piece) + 1)
    if len(raw):
        more = np.zeros(len(piece), np.int64)
        more[raw] = [len(b) - 1 for b in encoded]
        id_at[1:] += np.cumsum(more)
    ids = np.empty(int(id_at[-1]), np.int32)
    ids[id_at[:-1]] = vocabulary.ids[piece]
    if len(encoded):
        at, _ = places_of(id_at, raw)
        ids[at] = np.frombuffer(b"".join(encoded), np.uint8).astype(np.int32) + vocabulary.first_byte
    # The leading segmentation of every part, all parts step by step.
    active, at, found, steps = np.arange(len(parts)), first[:-1].copy(), [], np.zeros(len(parts), np.int64)
    while len(active):
        edge = leading[at]
        found.append((active, edge))
        steps[active] += 1
        onward = target[edge]
        on = onward >= 0
        active, at = active[on], onward[on]
    best_at = offsets_of(steps)
    best, who = np.empty(int(best_at[-1]), np.int64), np.repeat(np.arange(len(parts)), steps)
    for step_no, (active, edge) in enumerate(found):
        best[best_at[active] + step_no] = edge
    log_share = log_of(share[best])
    others = np.maximum(1 - share[best], 0)
    others[fan[node[best]] == 1] = 0
    before = np.cumsum(log_share) - log_share
    leave = np.exp(before - before[best_at[:-1]][who]) * others
    rest = np.add.reduceat(leave, best_at[:-1]) if len(leave) else leave
    sums = np.cumsum(leave)
    parting = (sums - np.concatenate([[0.0], sums])[best_at[:-1]][who]) / np.maximum(rest, 1e-300)[who]
    log_best = np.add.reduceat(log_share, best_at[:-1]) if len(parts) else np.empty(0)
    with np.errstate(divide="ignore"):
        return Lattices(first[:-1], lengths, edge_at, node, target, share, above, id_at, ids, best_at, best, log_best, np.log(rest), parting)


class EdgeKeys:
    """Ascending numbers of edges, worked out where they are asked for: the node, and the share up to the edge."""

    def __init__(self, lattice: Lattices):
        self.lattice = lattice

    def __getitem__(self, edges: np.ndarray) -> np.ndarray:
        return self.lattice.node[edges] + np.minimum(self.lattice.above[edges], 1.0) * (1 - 1e-12)


def first_not_below(values: np.ndarray | EdgeKeys, low: np.ndarray, high: np.ndarray, sought: np.ndarray) -> np.ndarray:
    """``searchsorted`` in ascending ``values``, of which the places from ``low`` to ``high`` come into question, by steps."""
    at = low.copy()
    on = np.flatnonzero(at < high)
    on = on[values[at[on]] < sought[on]]
    while len(on):
        at[on] += 1
        on = on[at[on] < high[on]]
        on = on[values[at[on]] < sought[on]]
    return at


def uniform(keys: np.ndarray, place: np.ndarray, use: int) -> np.ndarray:
    """Numbers above 0 and below 1 that row key, place in the row and use fix."""
    with np.errstate(over="ignore"):
        x = mix(keys + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(use) * np.uint64(0xD1B54A32D192ED03))
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


class Sampler:
    """Top perturbed segmentations of the rows of a batch, all rows at once."""

    def __init__(self, lattice: Lattices, words: np.ndarray, row_at: np.ndarray, keys: np.ndarray):
        self.lattice, self.words, self.row_at = lattice, words, row_at
        self.rows = np.repeat(np.arange(len(keys)), np.diff(row_at))
        self.place = np.arange(len(words)) - row_at[:-1][self.rows]
        self.key, self.keys = keys[self.rows], keys
        # Segmentations of parts: the leading one of every part, then those that were drawn.
        self.path_at, self.paths = lattice.best_at, lattice.best
        self.log_path = lattice.log_best
        self.leads = np.exp(lattice.log_best)
        self.samples: list[dict] = []
        self.spelled: tuple[int, np.ndarray, np.ndarray] | None = None  # ids of all paths, when there were so many edges

    def add_paths(self, who: np.ndarray, edges: np.ndarray, many: int) -> int:
        """Paths given edge by edge in the order of steps; returns the number of the first."""
        start = len(self.path_at) - 1
        order = np.argsort(who, kind="stable")
        lengths = np.bincount(who, minlength=many)
        self.path_at = np.concatenate([self.path_at, self.path_at[-1] + np.cumsum(lengths)])
        self.paths = np.concatenate([self.paths, edges[order]])
        self.log_path = np.concatenate([self.log_path, np.bincount(who, log_of(self.lattice.share[edges]), many)])
        return start

    def others(self, words: np.ndarray, keys: np.ndarray, place: np.ndarray, use: int) -> int:
        """Draw a segmentation other than the leading one for every one of ``words``: where it parts, how, and how it goes on."""
        t = self.lattice
        many = len(words)
        if not many:
            return len(self.path_at) - 1
        rank = np.searchsorted(self.parting_keys(), words + uniform(keys, place, use) * (1 - 1e-12))
        rank = np.clip(rank, t.best_at[words], t.best_at[words + 1] - 1)
        kept = rank - t.best_at[words]
        who, edges = [np.repeat(np.arange(many), kept)], [t.best[np.arange(int(kept.sum())) + np.repeat(t.best_at[words] - (np.cumsum(kept) - kept), kept)]]
        leave = t.best[rank]
        node = t.node[leave]
        low = t.above[leave] - t.share[leave]
        u = uniform(keys, place, use + 1) * np.maximum(1 - t.share[leave], 0)
        u = np.where(u >= low, u + t.share[leave], u)
        edge = self.edge_under(node, u)
        same = edge == leave
        if same.any():  # rounding met the edge that is left out: its neighbour stands in
            edge[same] = np.where(leave[same] + 1 < t.edge_at[node[same] + 1], leave[same] + 1, leave[same] - 1)
        active, step = np.arange(many), 0
        while len(active):
            who.append(active)
            edges.append(edge)
            on = t.target[edge] >= 0
            active, node = active[on], t.target[edge[on]]
            step += 1
            edge = self.edge_under(node, uniform(keys[active], place[active], use + 2 + (step << 20)))
        return self.add_paths(np.concatenate(who), np.concatenate(edges), many)

    def parting_keys(self) -> np.ndarray:
        if not hasattr(self, "_parting"):
            self._parting = np.repeat(np.arange(len(self.lattice.best_at) - 1), np.diff(self.lattice.best_at)) + self.lattice.parting * (1 - 1e-12)
        return self._parting

    def edge_under(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        t = self.lattice
        return first_not_below(EdgeKeys(t), t.edge_at[node], t.edge_at[node + 1] - 1, node + np.minimum(u, 1.0) * (1 - 1e-12))

    def drawn(self, fresh: np.ndarray, number: int) -> np.ndarray:
        """Paths of the parts at ``fresh``: the leading one, or another, by their shares."""
        words, key, place = self.words[fresh], self.key[fresh], self.place[fresh]
        path = words.copy()
        other = np.flatnonzero(uniform(key, place, number * 8 + 1) >= self.leads[words])
        other = other[np.isfinite(self.lattice.log_rest[words[other]])]
        path[other] = self.others(words[other], key[other], place[other], number * 8 + 2) + np.arange(len(other))
        return path

    def rest(self, path: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Log share of all segmentations of a part but this one."""
        rest = self.lattice.log_rest[words]
        drawn = np.flatnonzero(path != words)
        with np.errstate(divide="ignore"):
            rest[drawn] = np.log(-np.expm1(np.minimum(self.log_path[path[drawn]], 0)))
        return rest

    def emit(self, path: np.ndarray, live: np.ndarray, top: np.ndarray, start: np.ndarray, excluded: dict, number: int) -> None:
        """A sample of every live row, and the sets that split what is left of the set it came from."""
        logs = np.where(live[self.rows], self.log_path[path], 0.0)
        sums = np.concatenate([[0.0], np.cumsum(logs)])
        before = sums[:-1] - sums[self.row_at[:-1]][self.rows]
        own = np.flatnonzero(live[self.rows] & (self.place >= start[self.rows]))
        left = np.full(len(path), NONE)
        left[own] = self.rest(path[own], self.words[own])
        for row, drawn in excluded.items():  # where it parted from an earlier one, that one is gone as well
            at = int(self.row_at[row] + start[row])
            gone = np.exp(self.log_path[[*drawn, path[at]]]).sum()
            left[at] = np.log(1 - gone) if gone < 1 - 1e-12 else NONE
        mass = before[own] + left[own]
        possible = np.isfinite(mass)
        own, mass = own[possible], mass[possible]
        score = np.full(len(path), NONE)
        with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
            score[own] = mass - np.log(np.exp(mass - top[self.rows[own]]) - np.log(uniform(self.key[own], self.place[own], number * 8 + 7)))
        self.samples.append({"path": path, "live": live, "log_prob": sums[self.row_at[1:]] - sums[self.row_at[:-1]], "top": top, "score": score, "start": start, "excluded": excluded})

    def queue(self) -> tuple[np.ndarray, np.ndarray]:
        """For every row the highest set of the queue: of which sample it is, and its score."""
        rows = len(self.keys)
        tops = np.full((len(self.samples), rows), NONE)
        filled = np.flatnonzero(np.diff(self.row_at))
        for n, sample in enumerate(self.samples):
            if len(filled):
                tops[n, filled] = np.maximum.reduceat(sample["score"], self.row_at[:-1][filled])
        of = tops.argmax(axis=0)
        return of, tops[of, np.arange(rows)]

    def run(self, samples: int) -> np.ndarray:
        """Draw the samples; returns for every row the score that the next one would have had."""
        rows = len(self.keys)
        top = -np.log(-np.log(uniform(self.keys, np.zeros(rows), 3)))
        self.emit(self.drawn(np.arange(len(self.words)), 0), np.ones(rows, bool), top, np.zeros(rows, np.int64), {}, 0)
        for number in range(1, samples):
            of, top = self.queue()
            live = np.isfinite(top)
            path, start, excluded = self.samples[0]["path"].copy(), np.zeros(rows, np.int64), {}
            who, edges, at_places, going = [], [], [], np.flatnonzero(live)
            for row in going.tolist():
                sample = self.samples[of[row]]
                low, high = int(self.row_at[row]), int(self.row_at[row + 1])
                at = low + int(sample["score"][low:high].argmax())
                sample["score"][at] = NONE
                start[row] = at - low
                path[low:at] = sample["path"][low:at]
                gone = [*(sample["excluded"].get(row, ()) if sample["start"][row] == at - low else ()), int(sample["path"][at])]
                excluded[row] = gone
                at_places.append(at)
            draws = self.step_draws(self.keys[going], start[going], 0, FIRST_STEPS, number)
            for n, (row, at) in enumerate(zip(going.tolist(), at_places)):
                steps = self.excluding(int(self.words[at]), excluded[row], draws[n].tolist(), self.keys[row], int(start[row]), number)
                who += [n] * len(steps)
                edges += steps
            if at_places:
                first = self.add_paths(np.array(who), np.array(edges), len(at_places))
                path[at_places] = first + np.arange(len(at_places))
            fresh = np.flatnonzero(live[self.rows] & (self.place > start[self.rows]))
            path[fresh] = self.drawn(fresh, number)
            self.emit(path, live, top, start, excluded, number)
        return self.queue()[1]

    @staticmethod
    def step_draws(keys: np.ndarray, places: np.ndarray, first: int, many: int, number: int) -> np.ndarray:
        """For every row the draws of ``many`` steps from step ``first``."""
        at = (np.arange(many) + first) * 1_000_003 + places[:, None]
        return uniform(np.repeat(keys, many), at.ravel(), number * 8 + 6).reshape(len(keys), many)

    def excluding(self, word: int, gone: list[int], draws: list[float], key: np.uint64, place: int, number: int) -> list[int]:
        """Edges of a drawn segmentation of a part that is none of the paths ``gone``, by the draws of its first steps."""
        t = self.lattice
        left = []  # edges of each path, and what it weighs from there on
        for p in gone:
            path = self.paths[self.path_at[p] : self.path_at[p + 1]]
            left.append((path.tolist(), np.exp(np.cumsum(log_of(t.share[path])[::-1])[::-1]).tolist()))
        node, steps = int(t.first_node[word]), []
        while node >= 0:
            low, high, step = int(t.edge_at[node]), int(t.edge_at[node + 1]), len(steps)
            weights = t.share[low:high].tolist()
            if left:
                for path, weight in left:
                    weights[path[step] - low] -= weight[step]
                weights = [0.0 if w < 1e-13 else w for w in weights]
                if not any(weights):  # rounding: any edge that no path left holds whole
                    weights = [float(all(path[step] != e for path, _ in left) or t.target[e] >= 0) for e in range(low, high)]
            if step >= len(draws):
                draws = draws + self.step_draws(np.array([key]), np.array([place]), len(draws), 64, number)[0].tolist()
            u, edge, passed = draws[step] * sum(weights), low, weights[0]
            while passed <= u and edge < high - 1:
                edge += 1
                passed += weights[edge - low]
            left = [(path, weight) for path, weight in left if path[step] == edge]
            steps.append(edge)
            node = int(t.target[edge])
        return steps

    def ids(self, sample: dict) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a sample of all rows, and where each row's start."""
        if self.spelled is None or self.spelled[0] != len(self.paths):
            ids, lengths = gathered(self.lattice.id_at, self.lattice.ids, self.paths)
            self.spelled = len(self.paths), ids, offsets_of(lengths)[self.path_at]
        ids, lengths = gathered(self.spelled[2], self.spelled[1], sample["path"])
        return ids, offsets_of(lengths)[self.row_at]


LOADED: dict[tuple[str, float], Vocabulary] = {}


def loaded(path: str, alpha: float = ALPHA) -> Vocabulary:
    if (path, alpha) not in LOADED:
        LOADED[path, alpha] = Vocabulary(path, alpha)
    return LOADED[path, alpha]


def numbered(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct parts of texts in the order in which they come up, the parts of all texts by number, and where each text's
    start."""
    chunks, lengths = [pa.array([], pa.string())], [np.zeros(0, np.int64)]
    for plain, run in groupby((text or "" for text in texts), single_spaced):
        if plain:
            parts = pc.split_pattern(pa.array(run, pa.string()), " ")
        else:
            parts = pa.array([parts_of(text) for text in run], pa.list_(pa.string()))
        chunks.append(parts.flatten())
        lengths.append(pc.list_value_length(parts).to_numpy().astype(np.int64))
    known = pa.concat_arrays(chunks).dictionary_encode()
    return known.dictionary.to_pylist(), known.indices.to_numpy().astype(np.int64), offsets_of(np.concatenate(lengths))


def encoded(vocabulary: Vocabulary, distinct: list[str], words: np.ndarray, row_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows as the library gives them, and where each row's start; every distinct part is encoded once.

    Few lists are held at a time, since Python's collector goes over all that stay."""
    many, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
    for start in range(0, len(distinct), ENCODED_AT_ONCE):
        lists = vocabulary.library.encode(distinct[start : start + ENCODED_AT_ONCE], num_threads=1)
        many.append(np.fromiter(map(len, lists), np.int64, len(lists)))
        found.append(np.fromiter(chain.from_iterable(lists), np.int32, int(many[-1].sum())))
    ids, lengths = gathered(offsets_of(np.concatenate(many)), np.concatenate(found), words)
    return ids, offsets_of(lengths)[row_at]


def row_keys(seed: int, ids: list, texts: list[str | None]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(f"{i}" if i is not None else f"text {t}", seed=seed) for i, t in zip(ids, texts)], np.uint64)


def runs(df: DataFrame, id_column: str, text_column: str, work, schema: str, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    read = df.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in merged(batches, "text", batch_bytes):
            yield work(batch.column("id"), batch.column("text").to_pylist())

    return read.mapInArrow(released(run), f"id {dict(read.dtypes)['id']}, {schema}").withColumnRenamed("id", id_column)


def lists_of(ids: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))


def encode(df: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, ids) for every row of ``df``, as the library encodes the whole text; a null or empty text has no ids."""

    def work(keys: pa.Array, texts: list[str | None]) -> pa.RecordBatch:
        ids, at = encoded(loaded(path), *numbered(texts))
        return pa.RecordBatch.from_arrays([keys, lists_of(ids, at)], ["id", "ids"])

    return runs(df, id_column, text_column, work, "ids array<int>")


def decode(df: DataFrame, path: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """(id, text) for every row of ``df``; null ids are the empty text."""
    read = df.select(F.col(id_column).alias("id"), F.col(ids_column).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = loaded(path).library
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([library.decode(x) if x else "" for x in batch.column("ids").to_pylist()], pa.string())], ["id", "text"])

    return read.mapInArrow(released(run), f"id {dict(read.dtypes)['id']}, text string").withColumnRenamed("id", id_column)


def log_inclusion(log_prob: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Log probability that a segmentation's perturbed score passes ``bound``, the first that was not drawn."""
    gap = log_prob - bound
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        return np.where(gap < -30, gap, np.log(-np.expm1(-np.exp(np.minimum(gap, 40)))))


def segmentations(df: DataFrame, path: str, samples: int = SAMPLES, seed: int = 1, alpha: float = ALPHA, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, rank, ids, log_prob, log_inclusion): up to ``samples`` distinct segmentations of every whole text of ``df``.

    They are drawn without replacement by row key and seed, the row's id, or its text where the id is null; so repeated
    rows are drawn alike. An empty or null text has one segmentation, without ids, and a text with fewer segmentations
    than asked for has all of them, in the order in which they were drawn. Other columns are not read.
    """

    def work(keys: pa.Array, texts: list[str | None]) -> pa.RecordBatch:
        sampler, bound = sampled(loaded(path, alpha), keys.to_pylist(), texts, samples, seed)
        columns = [[], [], [], [], []]
        for rank, sample in enumerate(sampler.samples):
            ids, at = sampler.ids(sample)
            inclusion = log_inclusion(sample["log_prob"], bound)
            for row in np.flatnonzero(sample["live"]).tolist():
                for column, value in zip(columns, (keys[row], rank + 1, ids[at[row] : at[row + 1]], sample["log_prob"][row], inclusion[row])):
                    column.append(value)
        kinds = [keys.type, pa.int32(), pa.list_(pa.int32()), pa.float64(), pa.float64()]
        columns[0] = [k.as_py() for k in columns[0]]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["id", "rank", "ids", "log_prob", "log_inclusion"])

    return runs(df, id_column, text_column, work, "rank int, ids array<int>, log_prob double, log_inclusion double")


def sampled(vocabulary: Vocabulary, keys: list, texts: list[str | None], samples: int, seed: int) -> tuple[Sampler, np.ndarray]:
    distinct, words, row_at = numbered(texts)
    sampler = Sampler(lattices(distinct, vocabulary), words, row_at, row_keys(seed, keys, texts))
    return sampler, sampler.run(samples)


def digests(df: DataFrame, path: str, samples: int = SAMPLES, seed: int = 1, alpha: float = ALPHA, id_column: str = "doc_id", text_column: str = "text", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Encoding, decoding and sampling of every whole text of ``df``, with checksums in place of ids.

    (id, n_pieces, ids_crc32, round_trip, n_samples, sample_pieces, sample_crc32, sample_log_prob, sample_log_inclusion):
    checksums are of ids as 32-bit little-endian integers, ``round_trip`` says that the decoded ids are the text (a null
    text is empty), and lists are by rank. A task works on ``batch_bytes`` of text at a time, and takes about 70 times
    as much memory for the lattices of their parts. See ``segmentations`` for rows without id, repeated rows and empty texts.
    """

    def work(keys: pa.Array, texts: list[str | None]) -> pa.RecordBatch:
        vocabulary = loaded(path, alpha)
        distinct, words, row_at = numbered(texts)
        ids, at = encoded(vocabulary, distinct, words, row_at)
        back = vocabulary.library.decode([ids[a:b].tolist() for a, b in zip(at, at[1:])])
        sampler = Sampler(lattices(distinct, vocabulary), words, row_at, row_keys(seed, keys.to_pylist(), texts))
        bound = sampler.run(samples)
        rows = range(len(texts))
        found = [[], [], [], []]
        for sample in sampler.samples:
            own, starts = sampler.ids(sample)
            for column, values in zip(found, (np.diff(starts), [zlib.crc32(own[a:b].tobytes()) for a, b in zip(starts, starts[1:])], sample["log_prob"], log_inclusion(sample["log_prob"], bound))):
                column.append(np.asarray(values))
        live = np.array([s["live"] for s in sampler.samples])
        many = live.sum(axis=0)
        columns = [pa.array([[c[n][row].item() for n in range(len(live)) if live[n][row]] for row in rows], pa.list_(kind)) for c, kind in zip(found, (pa.int32(), pa.int64(), pa.float64(), pa.float64()))]
        return pa.RecordBatch.from_arrays(
            [keys, pa.array(np.diff(at)), pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in zip(at, at[1:])], pa.int64()), pa.array([b == (t or "") for b, t in zip(back, texts)], pa.bool_()), pa.array(many.astype(np.int32)), *columns],
            ["id", "n_pieces", "ids_crc32", "round_trip", "n_samples", "sample_pieces", "sample_crc32", "sample_log_prob", "sample_log_inclusion"],
        )

    return runs(df, id_column, text_column, work, "n_pieces long, ids_crc32 long, round_trip boolean, n_samples int, sample_pieces array<int>, sample_crc32 array<long>, sample_log_prob array<double>, sample_log_inclusion array<double>", batch_bytes)
