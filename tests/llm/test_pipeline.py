"""The pipeline's stages on a small corpus whose outcome is known."""

import random

import corpus_pipeline
from laborlake.llm import mixing

from .conftest import sentence


def test_stages_take_effect_in_turn(spark, make, tmp_path):
    rng = random.Random(21)
    clean = [(i, sentence(rng, 80, 3000), "en", f"s{i % 3}") for i in range(120)]
    toxic = [(1000 + i, f"foul {sentence(rng, 40, 3000)} vile {sentence(rng, 40, 3000)} nasty", "en", "s0") for i in range(80)]
    copies = [(2000 + i, clean[i][1] + " end", "en", "s1") for i in range(10)]
    item = sentence(rng, 30, 9000)
    leaks = [(3000, f"{sentence(rng, 40, 3000)} {item} {sentence(rng, 40, 3000)}", "en", "s2")]
    personal = [(4000, f"{sentence(rng, 60, 3000)} a.b@c.org", "en", "s2")]
    docs = make(clean + toxic + copies + leaks + personal + [(5000, None, None, None)])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, 1, int(d in range(1000, 1080))) for d, *_ in clean + toxic], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    want = {d for d, *_ in clean} | {3000, 4000, 5000}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "near_duplicates":
            assert {r.doc_id for r in at.collect()} == want
        if name == "decontamination":
            want -= {3000}
        if name == "personal_data":
            row = at.where("doc_id = 4000").first()
            assert row.text.endswith(" [EMAIL]") and row.n_chars == len(row.text)
            assert {r.doc_id for r in at.collect()} == want
            planned = {r.doc_id: r.copies for r in mixing.copies(at).collect()}
        if k < len(corpus_pipeline.STAGES) - 1:
            assert at.columns == docs.columns
    counts = {r.doc_id: r["count"] for r in at.groupBy("doc_id").count().collect()}
    assert counts == {d: n for d, n in planned.items() if n}
