"""Columns of the user's, whatever their names, stay as they are in every operator that gives rows back."""

import random

import pytest

import corpus_pipeline
from laborlake.llm import columns, decontaminate, mixing, near_duplicates, pii, toxicity

from .conftest import sentence

NAMES = ["__row", "_row", "row", "met", "given", "found", "place", "block", "bits", "_spans", "spans", "_masked", "masked", "all", "__rate", "rate", "times", "__times", "number", "__source", "__salt", "lowered", "score", "label", "first"]


@pytest.fixture(scope="module")
def clashing(spark):
    rng = random.Random(2)
    rows = [(i, sentence(rng, 60, 900), "en", f"s{i % 2}") for i in range(60)]
    rows += [(100 + i, f"{sentence(rng, 40, 900)} foul vile {sentence(rng, 40, 900)} nasty a@b.org", "en", "s1") for i in range(30)]
    rows += [(200 + i, rows[i][1] + " more", "de", "s0") for i in range(5)] + [rows[3], rows[3], (None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n}` string" for n in NAMES)
    return spark.createDataFrame([(*r, *[f"{n} of {r[0]}" for n in NAMES]) for r in rows], schema)


def kept_as_they_were(out):
    for r in out.collect():
        assert [r[n] for n in NAMES] == [f"{n} of {r.doc_id}" for n in NAMES]
    return out.count()


def test_all_row_operators(spark, clashing):
    labels = spark.createDataFrame([(i, 1, int(i >= 100)) for i in (*range(60), *range(100, 130))], "doc_id long, quality int, toxic int")
    item = clashing.where("doc_id = 7").first().text
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    n = clashing.count()
    assert toxicity.reject(clashing, labels).columns == clashing.columns
    assert 60 < kept_as_they_were(toxicity.reject(clashing, labels)) < n
    assert kept_as_they_were(near_duplicates.deduplicate(clashing)) == n - 7
    assert kept_as_they_were(decontaminate.decontaminate(clashing, bench)) == n - 1
    masked = pii.redact(clashing)
    assert kept_as_they_were(masked) == n and masked.columns == clashing.columns and masked.where("text like '%[EMAIL]'").count() == 30
    mixed = mixing.mix(clashing)
    assert mixed.columns == [*clashing.columns, "copy"] and kept_as_they_were(mixed) > 0


def test_rows_are_told_apart_whatever_the_bitmap_lets_pass(clashing, monkeypatch):
    monkeypatch.setattr(columns, "SET_BITS", 8)
    rows = clashing.where("doc_id < 10").selectExpr("xxhash64(doc_id, text) AS row", "doc_id")
    left = columns.without(clashing, rows)
    assert kept_as_they_were(left) == clashing.where("doc_id is null or doc_id >= 10").count()
    assert columns.without(clashing, rows.limit(0)).count() == clashing.count()


def test_pipeline_of_clashing_odd_and_empty_tables(spark, clashing, tmp_path):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    for name, docs in (("clash", clashing), ("none", clashing.limit(0))):
        d = f"{tmp_path}/{name}"
        docs.write.parquet(f"{d}/documents.parquet")
        labels.write.parquet(f"{d}/labels.parquet")
        bench.write.parquet(f"{d}/benchmark.parquet")
        out = corpus_pipeline.run(spark, d)
        assert out.columns == [*clashing.columns, "copy"]
        kept_as_they_were(out)
