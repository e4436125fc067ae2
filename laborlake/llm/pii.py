"""Personal data: patterns for four kinds, and bootstrapped contextual extraction of identifiers that they miss.

**Base.** E-mail, IP address, card and phone are matched by fixed patterns, leftmost and non-overlapping per kind, and
checked (value of IP parts, Luhn sum, number of digits).

**Bootstrap.** Words with a digit or ``@`` are instances, wherever they stand, and so are runs of digits that go over blanks,
such as ``(030) 901 820 11``, if they have 7 to 19 digits; the words of such a run are instances only with 7 digits of their own.
Those that base matches cover are seeds of their kind. The word before, the two words before and the word behind an instance are its contexts. A context is a pattern of a
kind with the confidence ``sum of its instances' scores of the kind / (its different instances + 1)``, if at least
``LEAST_SEEDS`` of them are scored; an instance that no pattern covers yet gets ``1 - product of (1 - confidence)``
over its confident patterns. Scores of patterns and instances follow from each other in ``ROUNDS`` rounds over written
tables of the pattern-instance graph, which is counted once and holds no context that is too rare for a pattern. In the end an instance beside patterns that together reach ``LEAST_SCORE`` is
a new span of the kind, if it has the kind's shape (digits, dots or ``@``) and no base span overlaps it; of new spans of a kind that
overlap, the longest stays. Contexts are read off the text as it stands, other instances in it included.

Everything is columns and joins. Contexts and instances are counted as different pairs, pre-aggregated, so a frequent
context or a group of copies weighs once; joins on contexts read written tables, where Spark can split a hot one.

Defined results: a null text reads as empty and has no spans; repeated rows get equal spans; without seeds, or in an
empty table, nothing is added to the base. Positions are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laborlake.llm import columns
from laborlake.sources.staging import freed, staged

KINDS = ("email", "ip", "card", "phone")
# The patterns of the four kinds. Possessive repetition and the looking back keep matching linear in the text; they
# don't change a match: what follows a repeated part is never in it, and a run's later starts match no more than its first.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain to be matched at all.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}
# A whole word with a digit or @; looked for at word starts only.
INSTANCE = r"(?<![^\x20\x09-\x0D])(?=[^\x20\x09-\x0D0-9@]*+[0-9@])[^\x20\x09-\x0D]++"
# Digits joined by blanks, brackets, dots, slashes or hyphens.
RUN = r"(?<![^\x20\x09-\x0D])[+(]{0,2}+[0-9]++(?:[\x20()./-]{1,3}+[0-9]++(?![A-Za-z_@%]))++"
RUN_HINT = r"[0-9][()./-]{0,2}\x20[()./-]{0,2}[0-9]"
RUN_DIGITS = (7, 19)
LEAST_SEEDS, LEAST_CONFIDENCE, LEAST_SCORE, ROUNDS = 5, 0.8, 0.8, 3
#: Characters of text looked at for the words around an instance.
AROUND = 64
#: Matches gathered at once.
BLOCK = 256
LOCATED = "array<struct<start:int,end:int,value:string,before:string,behind:string>>"
SPAN = "struct<nr:int,start:int,end:int,kind:string>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def part(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + part(i)) % 10 == 0


def _small(part: Column) -> Column:
    bare = F.ltrim(part, F.lit("0"))
    return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))


def holds(kind: str, value: Column) -> Column:
    """The check of a match beyond its pattern."""
    digits = _digits(value)
    if kind == "ip":
        return F.forall(F.split(value, r"\."), _small)
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _located(values: Column, pieces: Column) -> Column:
    """start, end, value and the text before and behind of each match, from the matches and the pieces between them. The
    text before may reach over earlier matches; the text behind reaches over the next one."""
    none = F.array().cast(LOCATED)
    n = F.size(values)

    def grown(a: Column, i: Column) -> Column:
        piece, value = F.element_at(pieces, i), F.element_at(values, i)
        start = a["at"] + F.length(piece)
        end = start + F.length(value)
        before = F.right(F.concat(a["tail"], F.right(piece, F.lit(AROUND))), F.lit(AROUND))
        rest = [F.element_at(pieces, i + 1), F.coalesce(F.get(values, i), F.lit("")), F.coalesce(F.get(pieces, i + 1), F.lit(""))]
        behind = F.left(F.concat(*[F.left(x, F.lit(AROUND)) for x in rest]), F.lit(AROUND))
        one = F.struct(start.alias("start"), end.alias("end"), value.alias("value"), before.alias("before"), behind.alias("behind"))
        tail = F.right(F.concat(before, F.right(value, F.lit(AROUND))), F.lit(AROUND))
        return F.struct(end.alias("at"), tail.alias("tail"), F.concat(a["out"], F.array(one)).alias("out"))

    # Appending copies an array, so matches are gathered in blocks.
    def block(done: Column, b: Column) -> Column:
        last = F.element_at(done, -1)
        first = F.struct(last["at"].alias("at"), last["tail"].alias("tail"), none.alias("out"))
        inner = F.aggregate(F.sequence(b * BLOCK + 1, F.least(n, (b + 1) * BLOCK)), first, grown)
        return F.concat(done, F.array(inner))

    start = F.array(F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"), none.alias("out")))
    blocks = F.aggregate(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), start, block)
    return F.when(n > 0, F.flatten(F.transform(blocks, lambda x: x["out"]))).otherwise(none)


def matched(docs: DataFrame, keep: list[str], patterns: dict[str, tuple[str, str]]) -> DataFrame:
    """``docs`` columns ``keep`` and, per name of ``patterns`` (pattern, hint), the located matches in ``text``."""
    text = F.coalesce("text", F.lit(""))
    none = F.array().cast("array<string>")
    found = docs.select(
        *keep, text.alias("_text"),
        *[F.when(text.rlike(hint), F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(none).alias(f"_{k}") for k, (p, hint) in patterns.items()],
    )
    found = found.select(
        "*", *[F.when(F.size(f"_{k}") > 0, F.split("_text", p, -1)).otherwise(none).alias(f"_{k}_pieces") for k, (p, _) in patterns.items()]
    )
    return found.select(*keep, *[_located(F.col(f"_{k}"), F.col(f"_{k}_pieces")).alias(k) for k in patterns])


def base_spans(docs: DataFrame, keep: list[str], instances: bool = False) -> DataFrame:
    """``keep`` and per kind the checked matches; with ``instances`` also all words with a digit or ``@`` and runs of digits."""
    patterns = {k: (PATTERNS[k], HINTS[k]) for k in KINDS}
    if not instances:
        found = matched(docs, keep, patterns)
        return found.select(*keep, *[_checked(k) for k in KINDS])
    found = matched(docs, keep, patterns | {"words": (INSTANCE, "[0-9@]"), "runs": (RUN, RUN_HINT)})
    runs = F.filter("runs", lambda m: m["value"].contains(" ") & F.length(_digits(m["value"])).between(*RUN_DIGITS)).alias("runs")
    found = found.select(*keep, *[_checked(k) for k in KINDS], "words", runs)
    whole = F.filter("words", lambda m: (F.length(_digits(m["value"])) >= RUN_DIGITS[0]) | ~_overlaps("runs", m))
    return found.select(*keep, *KINDS, F.when(F.size("runs") > 0, F.concat(whole, "runs")).otherwise(F.col("words")).alias("instances"))


def _overlaps(spans_: str | Column, m: Column) -> Column:
    return F.exists(spans_, lambda s: (s["start"] < m["end"]) & (m["start"] < s["end"]))


def _checked(kind: str) -> Column:
    return F.filter(kind, lambda m: holds(kind, m["value"])).alias(kind)


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def contexts(found: DataFrame) -> DataFrame:
    """(row, doc_id, start, end, kind, value, pattern): each instance of ``found`` beside each of its contexts; kind is null
    where it is no seed. Instances that overlap a base span, but aren't seeds, are left out."""
    spans = F.concat(*[_plain(k) for k in KINDS])
    every = found.select("row", "doc_id", "instances", *KINDS, spans.alias("_spans"))
    free = F.filter("instances", lambda m: ~_overlaps("_spans", m))
    tagged = [_tagged(F.col(k), F.lit(k)) for k in KINDS] + [_tagged(free, F.lit(None).cast("string"))]
    rows = every.select("row", "doc_id", F.explode(F.concat(*tagged)).alias("m")).select("row", "doc_id", "m.*")
    before, behind = _words(F.col("before")), _words(F.col("behind"))
    one, two, after = F.get(before, F.size(before) - 1), F.get(before, F.size(before) - 2), F.get(behind, F.lit(0))
    patterns = F.array_compact(
        F.array(F.concat(F.lit("L:"), one), F.concat(F.lit("LL:"), two, F.lit(" "), one), F.concat(F.lit("R:"), after))
    )
    return rows.select("row", "doc_id", "start", "end", "kind", "value", F.explode(patterns).alias("pattern"))


def _plain(kind: str) -> Column:
    return F.transform(kind, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end")))


def _tagged(matches: Column, kind: Column) -> Column:
    return F.transform(
        matches,
        lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), kind.alias("kind"), m["value"].alias("value"),
                           m["before"].alias("before"), m["behind"].alias("behind")),
    )


def _weighed(told: DataFrame) -> DataFrame:
    """(pattern, value, n): the different pairs of ``told``, n being the pattern's number of values. Patterns with fewer than
    ``LEAST_SEEDS`` values are left out, as they can't have so many scored ones."""
    pairs = staged(told.select("pattern", "value").distinct(), "pii-pairs")
    sizes = staged(pairs.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_SEEDS), "pii-sizes")
    return staged(pairs.join(sizes, "pattern").select("pattern", "value", "n"), "pii-edges")


def _patterns(edges: DataFrame, scores: DataFrame) -> DataFrame:
    """(pattern, kind, confidence) of the confident patterns. ``edges`` are those of ``_weighed``, ``scores`` (value, kind, score)."""
    support = edges.join(scores, "value").groupBy("pattern", "n", "kind").agg(F.sum("score").alias("sum"), F.count("*").alias("seeds"))
    confidence = F.col("sum") / (F.col("n") + 1)
    return (
        support.where(F.col("seeds") >= LEAST_SEEDS).select("pattern", "kind", confidence.alias("confidence"))
        .where(F.col("confidence") >= LEAST_CONFIDENCE)
    )


def _together(confidence: str) -> Column:
    """1 - product of (1 - confidence)."""
    return 1 - F.exp(F.sum(F.log(F.greatest(1 - F.col(confidence), F.lit(1e-9)))))


def _shaped(kind: Column, value: Column) -> Column:
    n = F.length(_digits(value))
    return (
        F.when(kind == "email", value.contains("@"))
        .when(kind == "ip", F.regexp_count(value, F.lit(r"[.:]")) >= 3)
        .when(kind == "card", n.between(13, 19))
        .otherwise(n.between(7, 15))
    )


def discovered(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(row, doc_id, kind, start, end) of new spans, from rows of ``base_spans`` with instances."""
    told = staged(contexts(found), "pii-contexts")
    edges = _weighed(told)
    seeds = staged(told.where("kind is not null").select("value", "kind", F.lit(1.0).alias("score")).distinct(), "pii-seeds")
    patterns = staged(_patterns(edges, seeds), "pii-patterns")
    for _ in range(rounds):
        new = (
            edges.join(patterns, "pattern").groupBy("value", "kind").agg(_together("confidence").alias("score"))
            .where(F.col("score") >= LEAST_SCORE).where(_shaped(F.col("kind"), F.col("value")))
            .join(seeds.select("value"), "value", "left_anti")
        )
        new = staged(new.select("value", "kind", "score"), "pii-new")
        # Scores never fall from round to round: if there are none now, there were none, and all later patterns are these.
        if new.isEmpty():
            break
        patterns = staged(_patterns(edges, seeds.unionByName(new)), "pii-patterns")
    hits = told.where("kind is null").drop("kind").join(patterns, "pattern")
    spans = hits.groupBy("row", "doc_id", "start", "end", "value", "kind").agg(_together("confidence").alias("score"))
    spans = spans.where((F.col("score") >= LEAST_SCORE) & _shaped(F.col("kind"), F.col("value")))
    return spans.select("row", "doc_id", "kind", "start", "end").distinct()


def row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, ``base`` and ``all``: arrays of (order of the kind, start, end, kind) sorted so, for every row of ``docs``."""
    keyed = docs.select("doc_id", "text", row_key().alias("row"))
    found = staged(base_spans(keyed, ["row", "doc_id"], instances=True), "pii-base")
    more = discovered(found).groupBy("row", "doc_id").agg(F.collect_list(_span(F.col("kind"), F.col("start"), F.col("end"))).alias("more"))
    # A run stands for the words in it.
    more = more.withColumn("more", F.filter("more", lambda m: ~F.exists("more", lambda s: _within(m, s))))
    base = F.concat(*[_of_kind(k) for k in KINDS])
    same = (F.col("f.row") == F.col("m.row")) & F.col("f.doc_id").eqNullSafe(F.col("m.doc_id"))
    joined = found.select("row", "doc_id", base.alias("base")).alias("f").join(more.alias("m"), same, "left")
    both = F.concat("base", F.coalesce("more", F.array().cast(f"array<{SPAN}>")))
    return joined.select("f.row", "f.doc_id", F.array_sort("base").alias("base"), F.array_sort(F.array_distinct(both)).alias("all"))


def _within(m: Column, s: Column) -> Column:
    """Whether ``m`` overlaps the longer span ``s`` of its kind."""
    return (m["kind"] == s["kind"]) & (s["start"] < m["end"]) & (m["start"] < s["end"]) & (s["end"] - s["start"] > m["end"] - m["start"])


def _span(kind: Column, start: Column, end: Column) -> Column:
    nr = F.array_position(F.array(*map(F.lit, KINDS)), kind).cast("int")
    return F.struct(nr.alias("nr"), start.alias("start"), end.alias("end"), kind.alias("kind")).cast(SPAN)


def _of_kind(kind: str) -> Column:
    return F.transform(kind, lambda m: _span(F.lit(kind), m["start"], m["end"]))


def as_text(spans_: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans_: Column) -> Column:
    """``text`` with each stretch covered by spans replaced by the bracketed kind of its first span, e.g. ``[EMAIL]``."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    by_place = F.array_sort(F.transform(spans_, lambda s: F.struct(s["start"], s["end"], s["kind"])))

    def grown(a: Column, s: Column) -> Column:
        label = F.concat(F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        inside = s["start"] < a["at"]
        return F.struct(
            F.greatest(a["at"], s["end"]).alias("at"), F.when(inside, a["out"]).otherwise(F.concat(a["out"], F.array(label))).alias("out")
        )

    done = F.aggregate(by_place, start, grown, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text))))
    return F.when(F.size(spans_) > 0, done).otherwise(text)


def redact(docs: DataFrame, length: str | None = None) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced, all other columns and rows as they are; a column ``length`` follows
    the texts that change."""
    with freed(docs.sparkSession):
        found = spans(docs).where(F.size("all") > 0).select("row", "doc_id", "all").dropDuplicates(["row", "doc_id"])
        found = staged(found, "pii-found", keep=True)
    keyed = columns.packed(docs, row=row_key(), doc_id=F.col("doc_id")).alias("d")
    same = (F.col("d.row") == F.col("f.row")) & F.col("d.doc_id").eqNullSafe(F.col("f.doc_id"))
    spans_ = F.coalesce(F.col("f.all"), F.array().cast(f"array<{SPAN}>")).alias("spans")
    masked = keyed.join(found.alias("f"), same, "left").select("given", spans_).withColumn("masked", redacted(F.col("given.text"), F.col("spans")))
    new = {"text": F.col("masked")}
    if length:
        kind = docs.schema[length].dataType
        new[length] = F.when(F.size("spans") > 0, F.length("masked").cast(kind)).otherwise(F.col(f"given.`{length}`"))
    return masked.select(*[(new[c] if c in new else F.col(f"given.`{c}`")).alias(c) for c in docs.columns])
