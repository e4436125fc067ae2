"""Registered queries of the text operators, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from laborlake.llm import (
    chat, decontaminate, language_crf, main_text, mixing, near_duplicates, pii, prefix_trie, quality_pu, rules, substrings, term_scan, toxicity,
)
from laborlake.llm.columns import fold, table
from laborlake.sources.staging import staged


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.copies(table(spark, sf_dir, "documents"))
    return taken.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "rate", "copies"
    )


OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, ([5, 2, 1])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight,
         sum(source_size) OVER ()::BIGINT AS everything FROM per),
ranked AS (
  SELECT *, row_number() OVER by_cap AS k,
         (3 * everything - 2 * coalesce(sum(2 * source_size) OVER (by_cap ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS left_over,
         (sum(weight) OVER (by_cap ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS weights
  FROM weighed WINDOW by_cap AS (ORDER BY 2 * source_size / weight, source NULLS LAST)),
open AS (SELECT * FROM ranked WHERE 4 * source_size * weights > weight * left_over ORDER BY k LIMIT 1),
rates AS (
  SELECT r.source, r.source_size,
         CASE WHEN o.k IS NULL OR r.k < o.k THEN (2 * r.source_size)::DOUBLE
              ELSE (r.weight * o.left_over)::DOUBLE / (2 * o.weights)::DOUBLE END AS target
  FROM ranked r LEFT JOIN open o ON true),
rated AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END::DOUBLE AS rate FROM rates),
drawn AS (
  SELECT s.doc_id, s.size, s.source, r.source_size, r.target, r.rate,
         ('0x' || substr(md5('mix:' || coalesce(s.doc_id::VARCHAR, md5(s.text), '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
  FROM sized s JOIN rated r ON s.source IS NOT DISTINCT FROM r.source),
counted AS (SELECT *, (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies FROM drawn)
SELECT doc_id, size, source_size, target, copies * size AS taken, source, rate, copies FROM counted
"""

def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"),
    )
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    back = chat.read_back(chat.examples(given.unionByName(more)))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("losses", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
        F.size("losses").cast("long").alias("n_targets"),
    )


OP2_SQL = r"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, t, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
told AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) AS k,
         length('<|turn|>' || url_encode(role) || chr(10) || '<|end|>' || chr(10)) + length(text)
         + len(regexp_extract_all(text, '[<\[]\\*(\|turn\|>|\|end\|>|/?s>|/?INST\]|/?SYS>>|\|im_start\|>|\|im_end\|>|\|endoftext\|>)')) AS chars
  FROM given),
grown AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k) AS prefix, max(k) OVER (PARTITION BY conv_id) AS n FROM told)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (sum(prefix) FILTER (role = 'assistant' OR k = n))::BIGINT AS formatted_chars,
       (count(*) FILTER (role = 'assistant'))::BIGINT AS n_targets
FROM grown GROUP BY conv_id
"""

def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"
    )


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH told AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
windows AS (
  SELECT r, i, hash(list_slice(w, i, i + 34)) AS h FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM told)),
often AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
hit AS (SELECT r, i FROM windows SEMI JOIN often USING (h)),
covered AS (
  SELECT r, sum(least(35, i - coalesce(before, i - 35)))::BIGINT AS n
  FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM hit) GROUP BY r),
gone AS (SELECT DISTINCT r, i + o AS i FROM hit, unnest(range(0, 35)) AS t(o)),
kept AS (
  SELECT t.r, string_agg(word, ' ' ORDER BY t.i) AS words
  FROM (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM told) t ANTI JOIN gone g ON t.r = g.r AND t.i = g.i
  GROUP BY t.r)
SELECT t.doc_id, len(t.w)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_removed, sha256(coalesce(k.words, '')) AS kept_sha256
FROM told t LEFT JOIN covered c ON t.r = c.r LEFT JOIN kept k ON t.r = k.r
"""

def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_ids", "coverage", "tiles")


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = near_duplicates.classes(docs)
    # One row per document, repeated rows of the table included.
    return found.select("doc_id", "class_id", "n_links", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy")).drop("copy")


def _predicted(scored: DataFrame, says: Column) -> DataFrame:
    held = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", says.cast("int").alias("predicted"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    known = scored.withColumn("score", F.when(F.col("learned"), F.col("score")).otherwise(F.lit(0.0)))
    return _predicted(known, F.col("score") >= 0.5)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    field = language_crf.train(docs.where(~held))
    return language_crf.predict(docs, field).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.spans(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("base", _is_kind(k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(pii.as_text(F.col("base")).cast("binary"), 256).alias("base_sha256"), pii.as_text(F.col("all")).alias("spans")
    )


def _is_kind(kind: str):
    return lambda s: s["kind"] == kind


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_pu.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return _predicted(scored, F.col("score") >= 0.3)


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    own = staged(prefix_trie.turns(given), "trie-turns")
    convs = own.select("conv_id").distinct().select(
        "conv_id", (F.col("conv_id") - F.col("conv_id") % 5).alias("first"), (F.crc32(F.col("conv_id").cast("string")) % 9).alias("h")
    )
    # At most five conversations start with the turns of one, eight turns at most.
    lent = own.where("pos < 8").withColumnRenamed("conv_id", "first").join(convs, "first").where("pos < h")
    kept = own.where(F.col("pos") >= F.crc32(F.col("conv_id").cast("string")) % 9)
    no_turn = convs.select("conv_id", F.lit(None).cast("long").alias("pos"), F.lit(None).cast("binary").alias("turn"), F.lit(None).cast("long").alias("bytes"))
    columns = ["conv_id", "pos", "turn", "bytes"]
    return prefix_trie.nodes(lent.select(columns).unionByName(kept.select(columns)).unionByName(no_turn))


OP11_SQL = r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8),
    lambda a, b: CASE WHEN a & 1 = 1 THEN xor(3988292384::BIGINT, a >> 1) ELSE a >> 1 END, n::BIGINT)) AS tab),
placed AS (
  SELECT conv_id, md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || ':' || coalesce(text, '')) AS t,
         strlen(coalesce(text, ''))::BIGINT AS b, turn FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, t, b, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, t) - 1 AS pos FROM placed),
convs AS (
  SELECT conv_id, conv_id - conv_id % 5 AS first,
         xor(4294967295::BIGINT, list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
           lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1]), 4294967295::BIGINT)) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM own), crc),
rebuilt AS (
  SELECT c.conv_id, o.pos, o.t, o.b FROM convs c JOIN own o ON o.conv_id = c.first AND o.pos < c.h
  UNION ALL SELECT c.conv_id, o.pos, o.t, o.b FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.pos >= c.h),
prefixes AS (
  SELECT conv_id, row_number() OVER w AS d, string_agg(t, '') OVER (w ROWS UNBOUNDED PRECEDING) AS p, b
  FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY pos)
  UNION ALL SELECT conv_id, 0, '', 0 FROM convs),
ends AS (SELECT conv_id, max(d) AS n FROM prefixes GROUP BY conv_id),
nodes AS (
  SELECT p, any_value(d)::BIGINT AS depth, min(x.conv_id) AS conv_id, count(*)::BIGINT AS n_convs, any_value(b)::BIGINT AS b,
         sha256(coalesce(string_agg(x.conv_id::VARCHAR, ',' ORDER BY x.conv_id) FILTER (d = e.n), '')) AS ends_sha256
  FROM prefixes x JOIN ends e ON x.conv_id = e.conv_id GROUP BY p),
children AS (SELECT left(p, length(p) - 32) AS p, count(*)::BIGINT AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
sums AS (
  SELECT x.p, count(*) FILTER (c.p IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.b)::BIGINT AS saved_tokens
  FROM nodes n LEFT JOIN children c ON n.p = c.p JOIN prefixes x ON x.conv_id = n.conv_id AND x.d <= n.depth GROUP BY x.p)
SELECT n.conv_id, n.depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0)::BIGINT AS n_children,
       s.n_leaves::BIGINT AS n_leaves, s.saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s ON n.p = s.p LEFT JOIN children c ON n.p = c.p
LEFT JOIN nodes up ON n.depth > 0 AND up.p = left(n.p, length(n.p) - 32)
"""


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_scan.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""
OP12_SQL = rf"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS r, {_TERMS} AS t FROM documents WHERE text IS NOT NULL),
sized AS (SELECT doc_id, r, len(t) AS n FROM docs WHERE len(t) > 0),
totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM sized),
tfs AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM docs) GROUP BY r, term),
wanted AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark WHERE text IS NOT NULL),
weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w
  FROM tfs, totals WHERE term IN (SELECT term FROM wanted) GROUP BY term, docs),
scored AS (
  SELECT q.item_id, s.doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * s.n * docs) // words))))::BIGINT AS score
  FROM tfs f JOIN weights USING (term) JOIN wanted q USING (term) JOIN sized s ON f.r = s.r, totals GROUP BY q.item_id, f.r, s.doc_id)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST))::INT AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10
"""


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(table(spark, sf_dir, "pages"))


#: The given pages hold one article each; SQL takes its blocks by their tags, the operator by their paths' ratios.
OP13_SQL = r"""
WITH found AS (
  SELECT page_id, url, row_number() OVER () AS r,
         string_split_regex(regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's'), '</?(h1|p)>') AS blocks
  FROM pages),
told AS (
  SELECT page_id, url, r, list_transform(blocks, lambda b: trim(regexp_replace(
    replace(replace(replace(replace(regexp_replace(regexp_replace(b, '<br>', ' ', 'g'), '<[^>]*>', '', 'g'),
      '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '\s+', ' ', 'g'))) AS blocks
  FROM found),
joined AS (
  SELECT page_id, url, array_to_string(list_filter(list_transform(blocks, lambda b: regexp_replace(b, '&amp;?', '&', 'g')), lambda b: b <> ''), chr(10)) AS text
  FROM told)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM joined
"""


#: Name -> (query, checking SQL or None).
QUERIES = {
    "op1_mixing": (op1_mixing, OP1_SQL),
    "op2_chat_format": (op2_chat_format, OP2_SQL),
    "op3_toxicity": (op3_toxicity, None),
    "op4_language": (op4_language, None),
    "op5_pii": (op5_pii, None),
    "op6_quality_rules": (op6_quality_rules, None),
    "op7_substring_dedup": (op7_substring_dedup, OP7_SQL),
    "op9_decontamination": (op9_decontamination, None),
    "op8_quality_classifier": (op8_quality_classifier, None),
    "op10_near_duplicates": (op10_near_duplicates, None),
    "op11_conversation_trie": (op11_conversation_trie, OP11_SQL),
    "op12_ranked_search": (op12_ranked_search, OP12_SQL),
    "op13_main_text": (op13_main_text, OP13_SQL),
}
