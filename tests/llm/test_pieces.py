from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from pagewatch.llm import pieces
from pagewatch.llm.pieces import decode, digests, encode, loaded, lattices, sampled, segmentations

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def vocabulary():
    return loaded(PATH)


def texts():
    rng = random.Random(12)
    bits = ["word", "Wörter", " ", " ", " ", "  ", "\n", "\t", "日本語", "🙂", "the", "ing", "ciónmente", "123", "!!", "é", "x" * 30, " "]
    return ["".join(rng.choice(bits) for _ in range(rng.choice([1, 4, 30, 200]))) for _ in range(200)] + ["", None, " ", "   ", " a", "a ", "a  b ", "▁"]


def all_segmentations(word, vocabulary):
    """Every segmentation of a part with its log weight, by trying all cuts."""
    name = "▁" + word.replace(" ", "▁")
    places = {vocabulary.library.id_to_piece(int(i)): n for n, i in enumerate(vocabulary.ids)}

    def go(at):
        if at == len(name):
            yield (), 0.0
            return
        for end in range(at + 1, len(name) + 1):
            piece = name[at:end]
            if piece in places:
                n = places[piece]
                step, log = (int(vocabulary.ids[n]),), vocabulary.scores[n]
            elif end == at + 1:
                raw = piece.encode()
                step, log = tuple(vocabulary.first_byte + b for b in raw), vocabulary.byte_score * len(raw)
            else:
                continue
            for rest, more in go(end):
                yield step + rest, log + more

    found = dict(go(0))
    norm = math.log(sum(math.exp(v) for v in found.values()))
    return {k: v - norm for k, v in found.items()}


def test_rows_as_the_library_encodes_them(spark, vocabulary):
    rows = [(i, t, "x") for i, t in enumerate(texts())] + [(None, "no id", "x"), (9002, "twice", "x"), (9002, "twice", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = encode(df, PATH)
    wanted = sorted(str((i, vocabulary.library.encode(t or ""))) for i, t, _ in rows)
    assert sorted(str((r.doc_id, r.ids)) for r in got.collect()) == wanted
    back = {r.doc_id: r.text for r in decode(got, PATH).collect()}
    assert all(back[i] == (t or "") for i, t, _ in rows if i is not None and t != "▁")
    assert encode(df.limit(0), PATH).collect() == [] and digests(df.limit(0), PATH).collect() == []
    for r in digests(df, PATH, samples=3).collect():
        assert r.round_trip or r.doc_id == len(texts()) - 1
        assert 1 <= r.n_samples <= 3 and len(r.sample_crc32) == len(set(r.sample_crc32)) == r.n_samples


def test_lattices_hold_all_segmentations(vocabulary):
    words = ["the", "ing", "a", "", "é", "schö", "日", "x y", "there", "🙂k"]
    lattice = lattices(words, vocabulary)
    for n, word in enumerate(words):
        wanted = all_segmentations(word, vocabulary)
        found = {}

        def walk(node, ids, log):
            if node < 0:
                found[ids] = log
                return
            for e in range(int(lattice.edge_at[node]), int(lattice.edge_at[node + 1])):
                walk(int(lattice.target[e]), ids + tuple(lattice.ids[lattice.id_at[e] : lattice.id_at[e + 1]].tolist()), log + float(lattice.log_share[e]))

        walk(int(lattice.first_node[n]), (), 0.0)
        assert found == pytest.approx(wanted, abs=1e-9)
        lead = tuple(i for e in lattice.best[lattice.best_at[n] : lattice.best_at[n + 1]] for i in lattice.ids[lattice.id_at[e] : lattice.id_at[e + 1]].tolist())
        assert lattice.log_best[n] == pytest.approx(wanted[lead], abs=1e-9)
        rest = 1 - math.exp(wanted[lead])
        assert math.exp(lattice.log_rest[n]) == pytest.approx(rest, abs=1e-9)


def test_samples_follow_the_law_of_drawing_without_replacement(vocabulary):
    sure = pieces.Vocabulary(PATH, 0.4)  # flat, so that many segmentations come up
    text, rows = "the inger", 6000
    one, two = (all_segmentations(w, sure) for w in text.split())
    prob = {a + b: math.exp(x + y) for a, x in one.items() for b, y in two.items()}
    sampler, bound = sampled(sure, list(range(rows)), [text] * rows, 3, 9)
    drawn = []
    for sample in sampler.samples:
        ids, at = sampler.ids(sample)
        drawn.append([tuple(ids[a:b].tolist()) for a, b in zip(at, at[1:])])
        assert all(abs(sample["log_prob"][k] - math.log(prob[drawn[-1][k]])) < 1e-9 for k in range(0, rows, 97))
    assert all(len({d[k] for d in drawn}) == 3 for k in range(rows))
    assert all((np.diff([s["top"][k] for s in sampler.samples] + [bound[k]]) < 0).all() for k in range(rows))
    first, second = Counter(drawn[0]), Counter(drawn[1])
    for seg, p in sorted(prob.items(), key=lambda x: -x[1])[:12]:
        after = sum(q * p / (1 - q) for other, q in prob.items() if other != seg)
        for count, share in ((first[seg], p), (second[seg], after)):
            assert abs(count - rows * share) < 5 * math.sqrt(rows * share * (1 - share)) + 3
    # Weights by inclusion are unbiased: they add up to the number of rows.
    weights = sum(np.exp(s["log_prob"] - pieces.log_inclusion(s["log_prob"], bound)) for s in sampler.samples)
    assert abs(weights.mean() - 1) < 0.06


def test_few_segmentations_and_seeds(spark, vocabulary):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "a b"), (3, ""), (4, None), (None, "a b")], "doc_id long, text string")
    got = segmentations(df, PATH, samples=50, seed=3).collect()
    wanted = {a + b for a in all_segmentations("a", vocabulary) for b in all_segmentations("b", vocabulary)}
    for i, n in ((1, 2), (2, 1), (None, 1)):
        assert Counter(tuple(r.ids) for r in got if r.doc_id == i) == Counter({w: n for w in wanted})
    assert [(r.ids, r.log_prob, r.rank) for r in got if r.doc_id == 3] == [([], 0.0, 1)] and sum(r.doc_id == 4 for r in got) == 1
    long = spark.createDataFrame([(i, t) for i, t in enumerate(texts()) if t], "doc_id long, text string")
    a, b, c = (sorted((r.doc_id, r.rank, r.ids, round(r.log_prob, 6)) for r in segmentations(x, PATH, 3, seed).collect()) for x, seed in ((long, 1), (long.repartition(5), 1), (long, 2)))
    assert a == b != c


def test_tables_find_what_sorted_searches_find():
    vocabulary = pieces.loaded(PATH)
    rng = np.random.default_rng(5)
    lead = vocabulary.hashes >> np.uint64(44) << np.uint64(44)
    sought = np.concatenate([vocabulary.hashes, lead, lead + np.uint64(7), rng.integers(0, 1 << 63, 5000).astype(np.uint64), ~np.zeros(1, np.uint64)])
    places = np.minimum(np.searchsorted(vocabulary.hashes, sought), len(vocabulary.hashes) - 1)
    assert vocabulary.look_up(sought).tolist() == np.where(vocabulary.hashes[places] == sought, places, -1).tolist()
    values, ends = np.sort(rng.random(4000)), np.sort(rng.choice(4000, 60, replace=False))
    low, high, wanted = np.concatenate([[0], ends[:-1] + 1]), ends, rng.random(60)
    assert pieces.first_not_below(values, low, high, wanted).tolist() == np.clip(np.searchsorted(values, wanted), low, high).tolist()


def test_parts_are_numbered_as_they_come():
    texts = ["b a b", None, "", " a  b ", "a", "  ", "a b b\n"]
    distinct, words, row_at = pieces.numbered(texts)
    assert [[distinct[w] for w in words[a:b]] for a, b in zip(row_at, row_at[1:])] == [pieces.parts_of(t or "") for t in texts]
    assert distinct == list(dict.fromkeys(p for t in texts for p in pieces.parts_of(t or "")))


def test_few_lists_are_held_while_parts_are_encoded():
    class Library:
        most = 0

        def encode(self, parts, num_threads):
            self.most = max(self.most, len(parts))
            return [[len(p), 7] for p in parts]

    class Only:
        library = Library()

    distinct = [f"w{k}" for k in range(5000)]
    ids, at = pieces.encoded(Only, distinct, np.array([4999, 0, 1], np.int64), np.array([0, 1, 1, 3]))
    assert ids.tolist() == [5, 7, 2, 7, 2, 7] and at.tolist() == [0, 2, 2, 6] and Only.library.most <= 1024


def test_levels_hold_nodes_alike_and_shares_add_up():
    far, fan = np.array([1, 3, 1, 2, 1, 3]), np.array([1, 2, 2, 1, 1, 2])
    assert [x.tolist() for x in pieces.alike(far, fan)] == [[0, 4], [2], [3], [1, 5]]
    lattice = pieces.lattices(["the", "of the", "\u4e2dx", "a" * 40], pieces.loaded(PATH))
    fan = np.diff(lattice.edge_at)
    assert np.allclose(lattice.above[lattice.edge_at[1:] - 1], 1) and np.allclose(np.add.reduceat(lattice.share, lattice.edge_at[:-1]), 1)
    assert lattice.above[lattice.edge_at[:-1]].tolist() == lattice.share[lattice.edge_at[:-1]].tolist() and fan.max() > 2
