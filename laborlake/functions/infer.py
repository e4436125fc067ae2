"""Rules that read country, city, work place, title and skills out of text."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from laborlake.functions import lexicons as lx
from laborlake.functions.parse import null_if_empty, strip

Rules = Sequence[tuple[str, Sequence[str]]]


def contains_any(lowered: Column, words: Iterable[str]) -> Column:
    return reduce(or_, (lowered.contains(w) for w in words))


def first_rule(lowered: Column, rules: Rules, *, whole_words: bool = False) -> Column:
    """Label of the first rule one of whose words occurs, else NULL."""
    out = None
    for label, words in rules:
        hit = _whole_word(lowered, words) if whole_words else contains_any(lowered, words)
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out


def _whole_word(lowered: Column, words: Iterable[str]) -> Column:
    return lowered.rlike(r"(?U)(?<!\w)(?:" + "|".join(re.escape(w) for w in words) + r")(?!\w)")


def country(location: Column, rules: Rules = lx.COUNTRY_HINTS, *, whole_words: bool = False) -> Column:
    """Country code from place names. By default words match inside other words too."""
    return first_rule(F.lower(location), rules, whole_words=whole_words)


def country_wide(location: Column, *, whole_words: bool = False) -> Column:
    return country(location, lx.COUNTRY_HINTS_WIDE, whole_words=whole_words)


def country_choice(given: Column, location: Column, *, names: bool = False) -> Column:
    """The given country, else the inferred one, in upper case; with ``names`` a known country's name becomes its code."""
    chosen = null_if_empty(given)
    if names:
        chosen = F.coalesce(country_code(chosen), chosen)
    return F.upper(F.coalesce(chosen, country(location)))


def country_code(name: Column) -> Column:
    """Code of a country by one of its names, whatever the case, blanks and points in it; NULL for others."""
    table = F.create_map(*[F.lit(x) for code, known in lx.COUNTRY_NAMES.items() for n in known for x in (n, code)])
    return F.try_element_at(table, F.regexp_replace(F.upper(name), "[^A-Z]", ""))


def city(location: Column) -> Column:
    return null_if_empty(strip(F.split_part(location, F.lit(","), F.lit(1))))


def currency_of(country_code: Column) -> Column:
    """Currency by country; no country counts as US, an unknown one as USD."""
    table = F.create_map(*[F.lit(x) for kv in lx.COUNTRY_CURRENCY.items() for x in kv])
    return F.coalesce(
        F.try_element_at(table, F.coalesce(country_code, F.lit("US"))), F.lit("USD")
    )


def remote_by_words(text: Column) -> Column:
    """Work place from words, 'remote' words first."""
    lowered = F.lower(text)
    return F.when(contains_any(lowered, lx.REMOTE_WORDS), F.lit(True)).when(
        contains_any(lowered, lx.ONSITE_WORDS), F.lit(False)
    )


def remote_by_patterns(title: Column, description: Column, location: Column) -> Column:
    """Work place from patterns, 'on site' patterns first."""
    lowered = F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in (title, description, location)]))
    return F.when(lowered.rlike("(?U)" + "|".join(lx.ONSITE_PATTERNS)), F.lit(False)).when(
        lowered.rlike("(?U)" + "|".join(lx.REMOTE_PATTERNS)), F.lit(True)
    )


def remote_by_job_type(job_type: Column) -> Column:
    lowered = F.lower(job_type)
    return F.when(contains_any(lowered, lx.JOB_TYPE_REMOTE), F.lit(True)).when(
        contains_any(lowered, lx.JOB_TYPE_ONSITE), F.lit(False)
    )


def work_type(remote: Column) -> Column:
    return F.when(remote, F.lit("Remote")).when(~remote, F.lit("On-site"))


def canonical_title(title: Column, category: Column) -> Column:
    """Canonical title from the title and the provider's category."""
    text = F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(category, F.lit("")))
    return first_rule(F.lower(text), lx.TITLE_RULES)


def role_family(title: Column) -> Column:
    return first_rule(F.lower(title), lx.ROLE_RULES)


# A word character is a letter, a digit of any script, or '_'. Written out
# because the meaning of \b differs between Java versions.
_WORD = r"[\p{L}\p{N}_]"


def _edges(term: str, symbols_as_words: bool) -> str:
    """Pattern of a term whose two edges are word boundaries."""
    left = f"(?<!{_WORD})" if symbols_as_words or re.match(r"\w", term) else f"(?<={_WORD})"
    right = f"(?!{_WORD})" if symbols_as_words or re.search(r"\w$", term) else f"(?={_WORD})"
    return left + re.escape(term) + right


def _overlaps(a: str, b: str) -> bool:
    """Can two different terms match overlapping stretches of one text?

    Yes if the words of one are part of the other's, or one ends with the words
    the other begins with. A single left-to-right scan could then miss one.
    """
    wa, wb = re.findall(r"\w+", a), re.findall(r"\w+", b)

    def inside(x, y):
        return any(y[i : i + len(x)] == x for i in range(len(y) - len(x) + 1))

    def chained(x, y):
        return any(x[-n:] == y[:n] for n in range(1, min(len(x), len(y)) + 1))

    return inside(wa, wb) or inside(wb, wa) or chained(wa, wb) or chained(wb, wa)


def _one_scan(terms: Sequence[str]) -> str:
    """Pattern that finds any of the terms, branching on the first character."""
    by_first: dict[str, list[str]] = {}
    for term in sorted(terms, key=len, reverse=True):
        by_first.setdefault(term[0], []).append(re.escape(term[1:]))
    branches = "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in sorted(by_first.items()))
    return f"(?<!{_WORD})(?:{branches})(?!{_WORD})"


def skills(
    description: Column,
    lexicon: Sequence[str] = lx.SKILLS,
    *,
    symbols_as_words: bool = False,
) -> Column:
    """Lexicon terms found as whole words, in lexicon order; an empty list for no text.

    A term's edges must be word boundaries, so 'c++' is found only before a
    word character; ``symbols_as_words`` asks for no word character on either
    side instead. Terms that cannot overlap are found in one scan of the text;
    the others are tried one by one, after a cheap substring test.
    """
    terms = list(dict.fromkeys(lexicon))
    plain = [t for t in terms if re.match(r"\w", t) and re.search(r"\w$", t)]
    scanned = [
        t
        for t in plain
        if re.fullmatch(r"\w+", t) or not any(_overlaps(t, o) for o in terms if o != t)
    ]
    text = F.lower(F.coalesce(description, F.lit("")))
    found = F.array().cast("array<string>")
    if scanned:
        found = F.regexp_extract_all(text, F.lit(_one_scan(scanned)), F.lit(0))
    single = [
        F.when(text.contains(t) & text.rlike(_edges(t, symbols_as_words)), F.lit(t))
        for t in terms
        if t not in scanned
    ]
    if single:
        found = F.concat(found, F.array_compact(F.array(*single)))
    return F.array_intersect(F.array(*[F.lit(t) for t in terms]), found)


def skill_choice(given: Column, description: Column, lexicon: Sequence[str] = lx.SKILLS) -> Column:
    """The provider's list (lower case, no blanks, no repeats) or else extracted skills."""
    listed = F.array_distinct(
        F.filter(F.transform(given, lambda s: strip(F.lower(s))), lambda s: s != "")
    )
    return F.when(F.size(given) > 0, listed).otherwise(skills(description, lexicon))
