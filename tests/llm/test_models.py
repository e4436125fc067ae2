"""Toxicity, language, quality classifier, quality rules and the pipeline: exact parts against plain Python, models by held-out accuracy."""

import itertools
import os
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from laborlake.llm import columns, language_crf, quality_pu, queries, rules, toxicity, wordhash

from .conftest import sentence

DATA = "/root/testdata/sf0.01"
SMALLEST = "/root/testdata/sf0.001"
given = pytest.mark.skipif(not os.path.isdir(DATA), reason="no given tables")


def plain_statistics(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    often, covered, lines, dup = Counter(windows), set(), set(), 0
    for i, x in enumerate(windows):
        if often[x] > 1:
            covered.update(range(i, i + 8))
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_statistics_equal_plain_counts(make, odd_rows):
    rng = random.Random(1)
    rows = [(i, "\n".join(sentence(rng, rng.randrange(0, 12), 4) for _ in range(rng.randrange(1, 9)))) for i in range(150)]
    rows += [(900 + i, t) for i, t in enumerate(["a " * 30, "é\n\né #*$\n é", "a b c d e f g h a b c d e f g h"])] + [(1000 + i, r[1]) for i, r in enumerate(odd_rows)]
    got = rules.measure(make(rows)).collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got} == {d: plain_statistics(t) for d, t in rows}


def labelled_quality(spark, make):
    rng = random.Random(2)
    good = [(i, sentence(rng, 60, 900)) for i in range(160)]
    bad = [(1000 + i, " ".join(f"{w}***" for w in sentence(rng, 60, 900).split())) for i in range(120)]
    labels = spark.createDataFrame([(d, 1, 0) for d, _ in good] + [(d, 0, 0) for d, _ in bad], "doc_id long, quality int, toxic int")
    return make(good + bad), labels


def test_rules_find_the_bad_rows_and_leave_the_good(spark, make):
    docs, labels = labelled_quality(spark, make)
    kept = {r.doc_id for r in rules.judge(docs, labels).where("kept").collect()}
    assert kept == set(range(160))


def test_rules_on_odd_tables_without_labels(odd, empty, no_labels, odd_rows):
    assert rules.judge(odd, no_labels).where("not base_failed and not kept").count() == 0
    assert rules.judge(empty, no_labels).count() == 0


def test_positive_unlabelled_learning(spark, make, odd, empty, no_labels, odd_rows):
    docs, labels = labelled_quality(spark, make)
    scored = {r.doc_id: r.score for r in quality_pu.score(docs, labels.where("quality = 1")).collect()}
    assert min(s for d, s in scored.items() if d < 1000) > 0.5 > max(s for d, s in scored.items() if d >= 1000)
    assert {r.score for r in quality_pu.score(odd, no_labels).collect()} == {0.5}
    assert quality_pu.score(odd, labels.limit(0).union(spark.createDataFrame([(5, 1, 0)], labels.schema))).count() == len(odd_rows)
    assert quality_pu.score(empty, labels).count() == 0


def test_prior_of_a_known_mixture():
    rng = np.random.default_rng(0)
    positive, negative = rng.normal(0, 1, (4000, quality_pu.FEATURES)), rng.normal(3, 1, (4000, quality_pu.FEATURES))
    mixture = np.concatenate([positive[:2800], negative[:1200]])
    rng.shuffle(mixture)
    assert abs(quality_pu.estimate_prior(rng.normal(0, 1, (4000, quality_pu.FEATURES)), mixture) - 0.7) < 0.06


def test_toxicity_counts_equal_plain_counts(spark):
    rows = [(1, "a b a b"), (0, "a b c"), (1, "a b"), (0, None), (0, "c c c")]
    docs = spark.createDataFrame(rows, "label int, text string")
    counts = toxicity.statistics(docs).groupBy("kind").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in "abcd"]).collect()
    # Pairs once per text: start-a, a-b, b-a | start-a, a-b, b-c | start-a, a-b | start-c, c-c.
    got = {r.kind: (r.n, r.a, r.b) for r in counts}
    assert got[toxicity.CONTEXT] == (4, 5, 5) and got[toxicity.CONTINUATION][1:] == (3, 5)
    assert got[toxicity.COUNTS] == (1, 1, 2)


def test_toxicity_of_small_odd_and_empty_tables(spark, make, odd, empty, no_labels, odd_rows):
    rng = random.Random(3)
    rows = [(i, sentence(rng, 80, 300)) for i in range(400)]
    rows = [(d, f"{t} foul vile {t} nasty" if d % 4 == 0 else t) for d, t in rows]
    labels = spark.createDataFrame([(d, 1, int(d % 4 == 0)) for d, _ in rows], "doc_id long, quality int, toxic int")
    docs = make(rows + [(1000, None), (1001, "")])
    scored = {r.doc_id: r.score for r in toxicity.score(docs, labels).collect()}
    assert sum((scored[d] >= 0.5) == (d % 4 == 0) for d, _ in rows) >= 390 and scored[1001] < 0.5 and scored[1000] < 0.5
    left = toxicity.reject(docs, labels)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {d for d, s in scored.items() if s < 0.5}
    assert {r.score for r in toxicity.score(odd, no_labels).collect()} == {0.5} and toxicity.score(empty, labels).count() == 0


def test_a_rare_toxic_expression_of_ordinary_words_is_learned(spark, make):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(800)]
    apart, joined = [], []
    for i in range(600):
        w = [rng.choice(words) for _ in range(60)]
        w[5], w[40] = "alpha", "beta"
        apart.append((i, " ".join(w)))
    for i in range(18):
        w = [rng.choice(words) for _ in range(60)]
        j = rng.randrange(50)
        w[j : j + 2] = "alpha", "beta"
        joined.append((1000 + i, " ".join(w)))
    labels = spark.createDataFrame([(d, 1, int(d >= 1000)) for d, _ in apart + joined], "doc_id long, quality int, toxic int")
    left = {r.doc_id for r in toxicity.reject(make(apart + joined), labels).collect()}
    assert left == set(range(600))


def number_of(*words):
    return [int(toxicity.numbers(next(wordhash.chunks(pa.array([w]), wordhash.PUNCTUATION))[2])[0][0]) for w in words]


def test_every_pair_has_its_own_evidence_however_rare(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(800)]
    rows = [(0, [rng.choice(words) for _ in range(60)] + ["alpha", "w1", "beta"]) for _ in range(600)]
    rows += [(1, [rng.choice(words) for _ in range(60)]) for _ in range(18)]
    for i in range(2):  # less often than chance in 10,000 shows, and in fewer than 20 texts
        rows[600 + i][1][30:32] = "alpha", "beta"
    rows[617][1][10:12] = "beta", "alpha"
    found = toxicity.pairs(spark.createDataFrame([(y, " ".join(w)) for y, w in rows], "label int, text string")).cache()
    got = {r.key: r.value for r in toxicity.evidence(found, toxicity._sums(found)).collect()}
    alpha, beta = number_of("alpha", "beta")
    assert got[(alpha << toxicity.BITS) | beta] > 0 and ((beta << toxicity.BITS) | alpha) not in got
    assert found.where(F.col("pair") == ((beta << toxicity.BITS) | alpha)).count() == 1


def test_words_of_near_hashes_are_words_of_their_own(spark, make):
    rng = random.Random(2)
    words, first = [f"w{i}" for i in range(20_000)], {}
    for word, number in zip(words, number_of(*words)):
        if first.setdefault(number >> 10, word) != word:  # 21 bits of the hash are the same
            foul, fine = word, first[number >> 10]
            break
    texts = [[rng.choice(words[:300]) for _ in range(60)] + [foul if i < 60 else fine] + ["w7"] for i in range(600)]
    labels = spark.createDataFrame([(i, 1, int(i < 60)) for i in range(600)], "doc_id long, quality int, toxic int")
    left = {r.doc_id for r in toxicity.reject(make([(i, " ".join(w)) for i, w in enumerate(texts)]), labels).collect()}
    assert left == set(range(60, 600))


def test_toxicity_keeps_all_where_nothing_is_learned(spark, make, no_labels):
    docs = make([(i, f"word{i} and some text") for i in range(40)])
    one_label = spark.createDataFrame([(i, 1, 1) for i in range(40)], no_labels.schema)
    one_toxic = spark.createDataFrame([(i, 1, int(i == 7)) for i in range(40)], no_labels.schema)
    blank = make([(i, None) for i in range(40)])
    mostly = spark.createDataFrame([(i, 1, int(i % 4 > 0)) for i in range(40)], no_labels.schema)
    for table, labels in ((docs, no_labels), (docs, one_label), (docs, one_toxic), (blank, mostly)):
        assert toxicity.reject(table, labels).count() == 40
        assert toxicity.reject(table, labels, threshold=0.3).count() == 40


def test_toxicity_sets_some_of_each_label_aside(spark):
    rows = spark.createDataFrame([(i, int(i < 10)) for i in range(3000)], "doc_id long, label int")
    for sample, wanted in ((20_000, {1: 2, 0: 598}), (100, {1: 2, 0: 50})):
        got = toxicity._set_aside(rows, sample)
        upto = F.when(F.col("label") == 1, got[1][1]).otherwise(got[0][1])
        aside = rows.where(toxicity._place() <= upto).groupBy("label").count().collect()
        assert {r["label"]: r["count"] for r in aside} == wanted and {k: v[0] for k, v in got.items()} == {1: 10, 0: 2990}


@pytest.mark.skipif(not os.path.isdir(SMALLEST), reason="no given tables")
def test_toxicity_of_the_smallest_given_table(spark):
    docs, labels = columns.table(spark, SMALLEST, "documents"), columns.table(spark, SMALLEST, "labels")
    clean = docs.join(labels.where("toxic = 0"), "doc_id", "left_semi")
    left = toxicity.reject(docs, labels).join(clean.select("doc_id"), "doc_id", "left_semi").count()
    assert left >= 0.9 * clean.count()


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    emissions, moves, offsets = rng.normal(size=(9, 3)), rng.normal(size=(3, 3)), np.array([0, 4, 4, 9])
    got = language_crf.forward_backward(emissions, moves, offsets)
    for a, b in ((0, 4), (4, 9)):
        want = np.zeros((b - a, 3))
        for y in itertools.product(range(3), repeat=b - a):
            weight = np.exp(sum(emissions[a + i, y[i]] for i in range(b - a)) + sum(moves[y[i - 1], y[i]] for i in range(1, b - a)))
            want[np.arange(b - a), y] += weight
        assert np.allclose(want / want.sum(1, keepdims=True), got[a:b])


def test_slopes_of_moves_equal_differences_of_the_likelihood():
    rng = np.random.default_rng(4)
    emissions, moves, offsets = rng.normal(size=(8, 3)), rng.normal(size=(3, 3)), np.array([0, 4, 5, 5, 8])
    gold = rng.integers(0, 3, 8)

    def loss(moves):
        total = 0.0
        for a, b in ((0, 4), (4, 5), (5, 8)):
            def weight(y):
                return sum(emissions[a + i, y[i]] for i in range(b - a)) + sum(moves[y[i - 1], y[i]] for i in range(1, b - a))

            total += np.log(sum(np.exp(weight(y)) for y in itertools.product(range(3), repeat=b - a))) - weight(gold[a:b])
        return total

    got = language_crf._pair_slopes(language_crf.passes(emissions, moves, offsets), gold, offsets)
    for x, y in itertools.product(range(3), repeat=2):
        step = np.zeros((3, 3))
        step[x, y] = 1e-5
        assert abs((loss(moves + step) - loss(moves - step)) / 2e-5 - got[x, y]) < 1e-6


def test_a_rare_language_is_learned_beside_a_large_one(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{rng.randrange(300)}en" for _ in range(30)), "en") for i in range(3000)]
    rows += [(5000 + i, " ".join(f"z{rng.randrange(300)}ul" for _ in range(30)), "zu") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    field = language_crf.train(docs, sample=40)
    got = language_crf.predict(docs.where("doc_id >= 5000 or doc_id < 100"), field).collect()
    assert field.languages == ["en", "zu"] and all(r.lang_pred == ("zu" if r.doc_id >= 5000 else "en") for r in got)


@given
def test_language_of_switched_odd_and_empty_texts(spark, odd, empty):
    docs = columns.table(spark, DATA, "documents").select("doc_id", "text", "lang")
    held = columns.fold(F.col("doc_id"), 4) == 2
    field = language_crf.train(docs.where(~held))
    right = language_crf.predict(docs, field).join(docs.where(held).select("doc_id", "lang"), "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right >= 0.97
    long = docs.where(held & (F.length("text") > 900)).orderBy("doc_id")
    parts = {lang: re.findall(r"[^\W\d_]+", long.where(F.col("lang") == lang).first().text) for lang in ("en", "de")}
    mixed = spark.createDataFrame([(1, " ".join(parts["en"][:30] + parts["de"][:30]))], "doc_id long, text string")
    runs = language_crf.predict(mixed, field, with_runs=True).first().runs
    assert [r.lang for r in runs] == ["en", "de"] and abs(runs[1].start - 30) <= 2
    got = {(r.doc_id, r.lang_pred, r.score) for r in language_crf.predict(odd, field).collect()}
    assert {(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0)} <= got and all(x[1] != "und" for x in got if x[0] in (4, 5, 6, 7, 8))
    assert language_crf.predict(empty, field).count() == 0
    assert {r.lang_pred for r in language_crf.predict(odd, language_crf.train(odd.where("false"))).collect()} == {"und"}


def quality_of(scored, labels, label):
    both = scored.where("held_out").join(labels, "doc_id")
    return both.agg(F.avg((F.col("predicted") == F.col(label)).cast("int"))).first()[0]


@given
def test_classifiers_on_held_out_rows(spark):
    labels = columns.table(spark, DATA, "labels")
    assert quality_of(queries.op8_quality_classifier(spark, DATA), labels, "quality") >= 0.9
    scored = queries.op3_toxicity(spark, DATA)
    assert scored.count() == 1000 and scored.where("score < 0 or score > 1").count() == 0
