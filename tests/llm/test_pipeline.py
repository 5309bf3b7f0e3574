from __future__ import annotations

import corpus_pipeline
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor

import __spark_entry__
from pagewatch.session import small
from tests.llm.helpers import shingles, smallest_reached
from tests.llm.test_decontaminate import brute as contained
from tests.llm.test_language_ppm import corpus
from tests.llm.test_secret_scans import brute as secrets_in


def documents():
    rows = [(i, text, lang, "s", len(text)) for i, text, lang in corpus(150, 5)]
    long = max(rows, key=lambda r: r[4])
    rows += [(300, long[1] + " thaing", long[2], "s", 0), (301, long[1], long[2], "s", 0), (301, long[1], long[2], "s", 0)]
    rows += [(400, "tha ing er ou st " + LEAK + " ingtha", "aa", "s", 0), (500, "thaing ouer password=hunter2hunter2 sting ou", "aa", None, None)]
    rows += [(600, "12345 !!! ...", "aa", "s", 13), (601, "", "aa", "s", 0), (602, None, None, None, None), (None, "thaing ererou ststing without id", "aa", "s", 31)]
    return rows


LEAK = "ouer thast ingou erst thaer stou inger outha"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(documents(), "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, LEAK), (2, None), (3, "not in any document at all here")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_one_by_one(spark, folder, tmp_path):
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = before, docs.collect()
        assert name == "segmented" or docs.columns == corpus_pipeline.COLUMNS
    before, after = seen["language"]
    assert {r.doc_id for r in before} - {r.doc_id for r in after} == {600, 601, 602} and len(after) == len(before) - 3
    before, after = seen["near_duplicates"]
    sets = {r.doc_id: shingles(r.text, 5) for r in before if r.doc_id is not None}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    reached = smallest_reached(sets, links)
    assert sorted(r.doc_id for r in after if r.doc_id is not None) == sorted(i for i in sets if reached[i] == i) and sum(r.doc_id is None for r in after) == 1
    before, after = seen["decontamination"]
    leaks = {d for d, _, _, _ in contained([(r.doc_id, r.text) for r in before], [(1, LEAK)])}
    assert leaks == {400} and {r.doc_id for r in after} == {r.doc_id for r in before} - leaks
    before, after = seen["secrets"]
    assert len(before) == len(after) and [r.text for r in after if r.doc_id == 500] == ["thaing ouer [SECRET] sting ou"]
    assert all(not secrets_in(r.text)[-1] and r.n_chars == len(r.text) for r in after)
    before, after = seen["segmented"]
    library = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert {r.doc_id: r.n_pieces for r in after} == {r.doc_id: len(library.encode(r.text)) for r in before} and all(r.round_trip for r in after)


def test_run_and_empty_tables(spark, folder, tmp_path):
    assert __spark_entry__.queries()["pipeline"](spark, folder).count() > 50
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def stage_texts(spark, folder, name, rows):
    """(doc_id, text) that a stage leaves of such rows, which have equal other columns."""
    docs = spark.createDataFrame([(*r, "aa", "s", 1) for r in rows], SCHEMA)
    left = dict(corpus_pipeline.STAGES)[name](spark, docs, folder)
    assert left.columns == corpus_pipeline.COLUMNS
    return sorted(((r.doc_id, r.text) for r in left.collect()), key=str)


def test_decontamination_is_by_own_text(spark, folder):
    words = LEAK.split()
    clean = [(None, "a clean text"), (None, " ".join(words[:6])), (None, " ".join(words[2:])), (None, None), (7, "the other text of this id"), (8, " ".join(words[:6])), (8, " ".join(words[2:])), (9, "alone"), (9, "alone")]
    rows = [*clean, (None, f"x {LEAK} y"), (7, f"x {LEAK} y"), (7, LEAK)]
    assert stage_texts(spark, folder, "decontamination", rows) == sorted(clean, key=str)


def test_near_duplicates_compare_every_row(spark, folder):
    long = lambda name: " ".join(f"{name}{i}" for i in range(60))
    kept = [(3, long("a")), (5, long("b")), (5, long("c")), (None, long("d")), (None, None), (4, ""), (None, " \t")]
    copies = [(None, long("a")), (None, long("a") + " more"), (5, long("a") + " more"), (6, long("a")), (7, long("c") + " more"), (3, long("a")), (None, long("d")), (None, None), (4, "")]
    assert stage_texts(spark, folder, "near_duplicates", [*copies, *kept]) == sorted(kept, key=str)


def test_few_that_go_move_no_rows(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(30)), "aa", "s", 1) for i in [*range(40), 1, 1, 2]], SCHEMA)
    monkeypatch.setattr(corpus_pipeline, "small", lambda df: small(df, 10))
    left = corpus_pipeline.near_duplicates(spark, docs, "")
    plan = left._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Left" in line]
    assert len(joins) == 2 and all("broadcast" in line for line in joins)
    assert sorted(r.doc_id for r in left.collect()) == list(range(40))


def test_stages_start_no_python_workers_for_side_tables(spark, folder, monkeypatch):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    monkeypatch.setattr(spark.sparkContext, "parallelize", None)  # local rows of Python go through workers of their own
    for stage in (corpus_pipeline.language, corpus_pipeline.secrets):
        assert stage(spark, docs, folder).count() > 50
