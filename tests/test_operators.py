import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from laborlake.operators.dedup import first_per_key, flag_all_but_best, not_yet_stored
from laborlake.operators.pairs import pair_counts
from laborlake.operators.percentiles import exact_percentiles
from laborlake.operators.trend import trailing_averages
from laborlake.operators.upsert import merge_upsert
from laborlake.plans import gold

WANTED = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}


@pytest.mark.parametrize("kind", ["spread", "equal", "tight", "wild"])
def test_percentiles_match_numpy_with_a_hot_group(spark, kind):
    rng = random.Random(7)
    draw = {
        "spread": lambda: round(rng.uniform(1, 250000), 2),
        "equal": lambda: 100000.0,
        "tight": lambda: 100000 + rng.random() / 1000,
        "wild": lambda: 10 ** rng.uniform(-3, 9),
    }[kind]
    groups = {"hot": 3000, "two": 2, "three": 3, "four": 4, "one": 1}
    data = {g: [draw() for _ in range(n)] for g, n in groups.items()}
    data[None] = [draw() for _ in range(5)]
    df = spark.createDataFrame([(g, v) for g, vs in data.items() for v in vs], "g string, v double")
    got = {r.g: r for r in exact_percentiles(df.repartition(7), ["g"], "v", WANTED, min_count=3, decimals=4).collect()}
    assert set(got) == {"hot", "three", "four", None}
    for g, row in got.items():
        assert row.sample_size == len(data[g])
        for name, p in WANTED.items():
            assert row[name] == pytest.approx(np.percentile(data[g], p * 100), abs=1e-3, rel=1e-9)


def test_pairs_match_brute_force_with_copies(spark):
    rng = random.Random(3)
    owners = {i: set(rng.sample("abcdefgh", rng.randint(0, 5))) for i in range(200)}
    owners.update({i: {"a", "b", "c"} for i in range(200, 400)})  # a large group of copies
    rows = [(o, s) for o, items in owners.items() for s in items] * 2
    got = pair_counts(spark.createDataFrame(rows, "o int, s string"), "o", "s", "x", "y", "n").collect()
    want = Counter(p for items in owners.values() for p in combinations(sorted(items), 2))
    assert {(r.x, r.y): r.n for r in got} == dict(want)


def test_first_per_key_is_deterministic_and_idempotent(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("n")
    )
    once = first_per_key(df.repartition(9), ["k"], [F.col("n")])
    rows = {(r.k, r.n) for r in once.collect()}
    first = {}
    for r in df.collect():
        first.setdefault(r.k, r.n)
    assert rows == set(first.items())
    assert {(r.k, r.n) for r in first_per_key(once, ["k"], [F.col("n")]).collect()} == rows


def test_flag_all_but_best(spark):
    rows = [("hot", i % 3, "f", i) for i in range(900)] + [("solo", 1, "f", 1000), ("", 2, "g", 1), ("", 2, "e", 2)]
    df = spark.createDataFrame(rows, "k string, score int, f string, n int")
    out = flag_all_but_best(df.repartition(5), "k", [-F.col("score"), F.col("f"), F.col("n")], ["f", "n"], "dup")
    assert out.count() == len(rows)
    assert {(r.k, r.f, r.n) for r in out.filter(~F.col("dup")).collect()} == {
        ("hot", "f", 2), ("solo", "f", 1000), ("", "e", 2),
    }


def test_not_yet_stored(spark):
    incoming = spark.range(10).select(F.col("id").cast("string").alias("k"), F.lit(1).alias("x"))
    stored = spark.range(4, 400).select(F.col("id").cast("string").alias("k"))
    for left, right in ((incoming, stored), (incoming.hint("merge"), stored), (incoming.unionByName(incoming.limit(0)), stored.union(stored))):
        assert {r.k for r in not_yet_stored(left, right, "k").collect()} == {"0", "1", "2", "3"}
    assert not_yet_stored(incoming, stored.limit(0), "k").count() == 10


def _series(spark, days):
    df = spark.createDataFrame([("e", f"2024-01-{d:02d}" if d <= 31 else f"2024-02-{d - 31:02d}", n) for d, n in days],
                               "e string, d string, job_count long")
    out = trailing_averages(df.withColumn("date", F.to_date("d")), "e").orderBy("date").collect()
    return [(r.moving_avg_7d, r.moving_avg_30d) for r in out]


def test_averages_cover_days_present(spark):
    assert _series(spark, [(1, 4)]) == [(4.0, 4.0)]
    assert _series(spark, [(1, 4), (7, 2)])[1] == (3.0, 3.0)  # six days back is inside
    assert _series(spark, [(1, 4), (8, 2)])[1] == (2.0, 3.0)  # seven days back is outside
    assert _series(spark, [(1, 4), (30, 2)])[1] == (2.0, 3.0)  # 29 days back is inside
    assert _series(spark, [(1, 4), (31, 2)])[1] == (2.0, 2.0)  # 30 days back is outside


def test_merge_is_idempotent_and_key_unique(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([("B", 2), ("C", 3)], "v string, k int")
    merged = merge_upsert(old, new, ["k"])
    want = {(1, "a"), (2, "B"), (3, "C")}
    assert {tuple(r) for r in merged.collect()} == want
    assert sorted(tuple(r) for r in merge_upsert(merged, new, ["k"]).collect()) == sorted(want)


def test_leaving_out_rare_skills_changes_nothing(spark):
    rng = random.Random(5)
    rows = [(str(j), s) for j in range(300) for s in {f"s{int(rng.paretovariate(0.7))}" for _ in range(6)}]
    skills = spark.createDataFrame(rows, "job_id string, skill_name string")
    full = gold.skill_cooccurrence(skills).collect()
    assert full and gold.skill_cooccurrence(skills, drop_rare=True).collect() == full


def test_rates_passed_in_spread_a_hot_currency(spark):
    rows = spark.range(40_000).select(
        F.col("id").cast("string").alias("raw_hash"), F.lit("Engineer").alias("title_normalized"), F.lit("us").alias("country"),
        F.when(F.col("id") % 100 == 0, "EUR").otherwise("USD").alias("salary_currency"),
        F.lit(100.0).alias("salary_min"), F.lit(300.0).alias("salary_max"),
    )
    fx = spark.createDataFrame([("USD", 1.0), ("EUR", 0.5), ("XXX", 0.0)], "currency string, rate double")
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        joined = gold.in_usd(gold.mid_salaries(rows), fx)
        assert "_salt" not in joined.columns
        sizes = sorted(r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect())
        got = {r.salary_usd: r["count"] for r in joined.groupBy("salary_usd").count().collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {200.0: 39_600, 400.0: 400}
    assert len(sizes) > 8 and sizes[-1] < 4 * sizes[len(sizes) // 2]
