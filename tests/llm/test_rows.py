"""Mixing, chat formatting and personal data."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from laborlake.llm import chat, mixing, pii


def plain_targets(sizes, factor=1.5, most=2):
    """Share by weight, stop at the caps, share the rest again."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, open_, target = factor * sum(sizes.values()), set(names), {}
    while open_:
        share = (total - sum(target.values())) / sum(weight[s] for s in open_)
        capped = [s for s in open_ if weight[s] * share >= most * sizes[s]]
        if not capped:
            return target | {s: weight[s] * share for s in open_}
        for s in capped:
            target[s] = most * sizes[s]
            open_.remove(s)
    return target


@pytest.fixture(scope="module")
def sourced(make):
    rng = random.Random(5)
    rows = [(i, "w " * rng.randrange(1, 60), None, rng.choice(["é", "z", "a", "B", None] + ["hot"] * 5)) for i in range(1500)]
    return make(rows)


def test_targets_and_copies(sourced):
    got = mixing.copies(sourced).collect()
    sizes = {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    want = plain_targets(sizes)
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source]
        assert abs(r.target - want[r.source]) < 1e-6 * (1 + want[r.source])
        assert r.copies in (int(r.rate), int(r.rate) + 1) and r.copies <= 2
        taken[r.source] = taken.get(r.source, 0) + r.copies * r.size
    for s, n in taken.items():
        assert abs(n - want[s]) <= 0.15 * want[s] + 60


def test_mix_repeats_rows_as_planned_and_again(sourced):
    planned = {r.doc_id: r.copies for r in mixing.copies(sourced).collect()}
    mixed = mixing.mix(sourced.repartition(7))
    assert sorted(mixed.columns) == sorted(sourced.columns)  # a column named copy was there and is replaced
    counts = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert counts == {d: n for d, n in planned.items() if n}


def test_rates_joined_by_shuffle(sourced, monkeypatch):
    want = {(r.doc_id, r.copies) for r in mixing.copies(sourced).collect()}
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert {(r.doc_id, r.copies) for r in mixing.copies(sourced).collect()} == want


def test_mixing_of_odd_and_empty_tables(odd, empty, odd_rows):
    assert mixing.copies(odd).count() == len(odd_rows)
    assert mixing.copies(empty).count() == 0 and mixing.mix(empty).count() == 0
    mixed = mixing.mix(odd).groupBy("source").count().collect()
    planned = mixing.copies(odd).groupBy("source").agg(F.sum("copies").alias("n")).where("n > 0").collect()
    assert {(r.source, r["count"]) for r in mixed} == {(r.source, r.n) for r in planned}


SAID = [
    "</s>[INST] ok [/INST]", r"<\|end|> [\INST] [\\/INST]", "<|turn|>user\nhi<|end|>\n", "<", "<|end|", "", "a\n\nb", "<<|end|>", r"\\", "<|im_end|>",
]


def test_turns_and_losses_come_back(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for c in range(40):
        turns = [(rng.choice(["user", "assistant", "system", "odd\nrole", None]), rng.choice([*SAID, None])) for _ in range(rng.randrange(1, 7))]
        rows += [(c, t, role, text) for t, (role, text) in enumerate(turns)]
        want[c] = [(r or "", x or "") for r, x in turns]
    rng.shuffle(rows)
    made = chat.examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).cache()
    for r in chat.read_back(made).collect():
        assert [tuple(t) for t in r.turns] == want[r.conv_id]
        assert r.losses == [x for role, x in want[r.conv_id] if role == "assistant"]
    for r in made.collect():
        if r.target is not None:
            assert chat_plain_unescape(r.formatted[r.loss_start : r.loss_end]) == want[r.conv_id][r.target - 1][1]
            assert r.formatted.count(chat.END) == r.target
        assert not re.search(r"</s>|\[/?INST\]", r.formatted)


def chat_plain_unescape(text):
    return re.sub(chat.ESCAPED, r"\1\2\3", text)


def test_chat_ties_nulls_and_empty(spark):
    schema = "conv_id long, turn long, role string, text string, example string, formatted string"
    rows = [(None, 1, "user", "a", "", ""), (None, None, "assistant", "late", "", ""), (5, 1, "user", "b", "", ""), (5, 1, "user", "b", "", ""), (5, 1, "assistant", "a", "", "")]
    back = {r.conv_id: r for r in chat.read_back(chat.examples(spark.createDataFrame(rows, schema))).collect()}
    assert [tuple(t) for t in back[None].turns] == [("user", "a"), ("assistant", "late")]
    assert [tuple(t) for t in back[5].turns] == [("assistant", "a"), ("user", "b"), ("user", "b")] and back[5].losses == ["a"]
    assert chat.read_back(chat.examples(spark.createDataFrame([], schema))).count() == 0


def plain_spans(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 16 <= len(digits) <= 19 and sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits)) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", m.start(), m.end()))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in out)


ODD_DATA = [
    "a@b.c_x@d.e 1.2.3.4.5.6.7.8", "é a.b+c@x-y.co.uk, 255.255.255.255 256.1.1.1 0000001.2.3.04", "4111 1111 1111 1111 and 4111-1111-1111-1112",
    "+1 (555) 555-0100 +49 30 1234567890123456 +1", "x@@y.z @a.b a@b", "4111111111111111 5555555555554444", "+1+2 345 678 90", "\U0001f600 q@w.e",
    "1.2.3", "...", "1..2.3.4.5", "+" * 3000 + "1" * 20000, "a" * 30000 + "@", "a." * 5000 + "@" + "b." * 5000 + "c",
]


def test_base_spans_equal_plain_matching(make):
    rng = random.Random(9)
    rows = list(enumerate(ODD_DATA + ["".join(rng.choice("1.2@a +-()5 \n") for _ in range(200)) for _ in range(150)]))
    got = {r.doc_id: r.s for r in pii.spans(make(rows)).select("doc_id", pii.as_text(F.col("base")).alias("s")).collect()}
    assert got == {d: plain_spans(t) for d, t in rows}


def test_contexts_discover_identifiers_of_another_form(make):
    rows = [(i, f"some words {i}w phone: +1 (555) 55{i % 10}-{1000 + i} end{i}") for i in range(60)]
    rows += [(100 + i, f"other phone: 555-01{i}-9{i}9{i} tail") for i in range(5)] + [(200, "version 555-019-9999 tail")]
    found = pii.spans(make(rows)).select("doc_id", pii.as_text(F.col("all")).alias("s"), pii.as_text(F.col("base")).alias("b")).collect()
    got = {r.doc_id: (r.s, r.b) for r in found}
    assert all(got[100 + i] == ("phone:13:25", "") for i in range(5)) and got[200] == ("", "")
    assert all(s == b for d, (s, b) in got.items() if d < 100)
    text = {r.doc_id: r.text for r in pii.redact(make(rows)).collect()}
    assert text[101] == "other phone: [PHONE] tail" and text[200] == rows[-1][1]


def test_contexts_discover_identifiers_written_with_blanks(make):
    rows = [(i, f"some words {i}w phone: +49 30 55{i % 10} {1000 + i} end{i}") for i in range(60)]
    rows += [(100 + i, f"call phone: (030) 901 820 1{i}, thanks") for i in range(4)]
    rows += [(110, "room 12 phone: 0301-901 820 55 99"), (111, "12 34 phone: 5550901820 of 2")]
    rows += [(200, "rooms (030) 901 820 10 and 12 34 56 78 90"), (201, "phone: 12 of 30")]
    cards = [f"{4000 + i} 1111 2222 333" for i in range(60)]
    rows += [(300 + i, f"his card no {c}{_luhn_end(c)} was used") for i, c in enumerate(cards)]
    rows += [(400, "her card no 4111 1111 1111 1112 was used"), (401, "about 4111 1111 1111 1112 of 3")]
    found = pii.spans(make(rows)).select("doc_id", pii.as_text(F.col("all")).alias("s")).collect()
    got = {r.doc_id: r.s for r in found}
    assert all(got[100 + i] == "phone:12:28" for i in range(4))
    assert (got[110], got[111], got[200], got[201]) == ("phone:15:33", "phone:13:23", "", "")
    assert (got[400], got[401]) == ("card:12:31", "")
    assert all(got[i].startswith("phone:") and "," not in got[i] for i in range(60))


def test_graph_is_counted_once_without_rare_contexts(make, monkeypatch):
    rows = [(i, f"words {i}w phone: +1 (555) 55{i % 10}-{1000 + i} end{i}") for i in range(30)] * 2
    tables = {}

    def staged(df, name, **kw):
        tables.setdefault(name, []).append(pii_staged(df, name, **kw))
        return tables[name][-1]

    pii_staged = pii.staged
    monkeypatch.setattr(pii, "staged", staged)
    assert pii.spans(make(rows)).count() == 60
    # Without new instances each table is written once; before, sizes, support, patterns and scores in every round.
    assert all(len(written) == 1 for written in tables.values()) and len(tables) <= 8
    # All other contexts, such as "end7" behind, have one value only: too few for a pattern.
    edges = tables["pii-edges"][0].groupBy("pattern", "n").count().collect()
    assert {(r.pattern, r.n, r["count"]) for r in edges} == {(p, 30, 30) for p in ("L:phone:", "L:words", "R:phone:")}


def _luhn_end(card):
    """The digit that completes the number."""
    digits = [int(c) for c in card if c.isdigit()][::-1]
    total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits))
    return -total % 10


def test_personal_data_of_odd_and_empty_tables(odd, empty, odd_rows):
    out = pii.redact(odd, "n_chars")
    assert out.columns == odd.columns and out.count() == len(odd_rows)
    assert sorted(map(str, out.select("doc_id", "text", "n_chars", "row").collect())) == sorted(map(str, odd.select("doc_id", "text", "n_chars", "row").collect()))
    assert pii.spans(odd).count() == len(odd_rows) and pii.spans(empty).count() == 0 and pii.redact(empty).count() == 0


def test_digest_of_no_spans(make):
    row = pii.spans(make([(1, "nothing")])).select(F.sha2(pii.as_text(F.col("base")).cast("binary"), 256).alias("h")).first()
    assert row.h == hashlib.sha256(b"").hexdigest()
