"""SQL fragments that state the library's text rules for DuckDB."""

from __future__ import annotations

import re

from laborlake.functions import lexicons as lx
from laborlake.functions.parse import WHITESPACE

_WS = WHITESPACE.replace("'", "''")
_WORD = r"\p{L}\p{N}_"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, '{_WS}')"


def clean(x: str, size: int | None = None) -> str:
    text = f"nullif({strip(x)}, '')"
    return text if size is None else f"substring({text}, 1, {size})"


def contains_any(x: str, words) -> str:
    return "(" + " or ".join(f"contains({x}, {quote(w)})" for w in words) + ")"


def rules(x: str, table) -> str:
    arms = " ".join(f"when {contains_any(f'lower({x})', words)} then {quote(label)}" for label, words in table)
    return f"(case {arms} end)"


def money(x: str) -> str:
    s = strip(f"replace(replace({x}, ',', ''), '$', '')")
    return f"nullif(greatest({number(s)}, 0), 0)"


def money_k(x: str) -> str:
    s = f"replace(replace(lower({strip(x)}), ',', ''), '$', '')"
    short = strip(f"left({s}, length({s}) - 1)")
    return f"(case when ends_with({s}, 'k') then {number(short)} * 1000 else nullif(greatest({number(strip(s))}, 0), 0) end)"


def number(s: str) -> str:
    pattern = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
    return f"(case when regexp_matches({s}, '{pattern}') then try_cast({s} as double) end)"


def boolean(x: str, yes, no) -> str:
    s = f"lower({strip(x)})"
    listed = [", ".join(quote(v) for v in values) for values in (yes, no)]
    return f"(case when {s} in ({listed[0]}) then true when {s} in ({listed[1]}) then false end)"


def timestamp(x: str, strip_first: bool = False) -> str:
    form = "([0-9]:[0-9]{1,2}(?:[.][0-9]+)?)[ ]*([+-][0-9]{2}(?::?[0-9]{2})?)$"
    bare = strip(x) if strip_first else f"rtrim({x}, '{_WS}')"
    s = f"left(regexp_replace({bare}, '{form}', '\\1'), 19)"
    times = ["%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M:%SZ", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d", "%d/%m/%Y"]
    formats = "[" + ", ".join(map(quote, times)) + "]"
    offset = f"regexp_extract({strip(x)}, '{form}', 2)"
    rest = f"coalesce(try_cast(substr(replace({offset}, ':', ''), 4, 2) as int), 0)"
    minutes = f"(try_cast(substr({offset}, 2, 2) as int) * 60 + {rest})"
    ahead = f"coalesce(case when left({offset}, 1) = '-' then -{minutes} else {minutes} end, 0)"
    return f"(case when {s} = ltrim({s}) then try_strptime({s}, {formats}) - to_minutes({ahead}) end)"


def term_pattern(term: str) -> str:
    """Whole-word pattern; a term that ends in a symbol needs a word character after it."""
    body = re.sub(r"([+.#/\-])", r"\\\1", term)
    left = f"(^|[^{_WORD}])" if re.match(r"\w", term) else f"[{_WORD}]"
    right = f"($|[^{_WORD}])" if re.search(r"\w$", term) else f"[{_WORD}]"
    return left + body + right


def skills(x: str, lexicon=lx.SKILLS) -> str:
    arms = ", ".join(
        f"case when regexp_matches(lower({x}), {quote(term_pattern(t))}) then {quote(t)} end" for t in lexicon
    )
    return f"list_filter([{arms}], lambda s: s is not null)"


def currency(country: str) -> str:
    arms = " ".join(f"when '{c}' then '{v}'" for c, v in lx.COUNTRY_CURRENCY.items())
    return f"(case coalesce({country}, 'US') {arms} else 'USD' end)"


def remote_words(x: str) -> str:
    return (
        f"(case when {contains_any(f'lower({x})', lx.REMOTE_WORDS)} then true "
        f"when {contains_any(f'lower({x})', lx.ONSITE_WORDS)} then false end)"
    )


def remote_patterns(x: str) -> str:
    return (
        f"(case when regexp_matches(lower({x}), {quote('|'.join(lx.ONSITE_PATTERNS))}) then false "
        f"when regexp_matches(lower({x}), {quote('|'.join(lx.REMOTE_PATTERNS))}) then true end)"
    )


def remote_job_type(x: str) -> str:
    return (
        f"(case when {contains_any(f'lower({x})', lx.JOB_TYPE_REMOTE)} then true "
        f"when {contains_any(f'lower({x})', lx.JOB_TYPE_ONSITE)} then false end)"
    )


def city(x: str) -> str:
    return f"nullif({strip(f'''split_part({x}, ',', 1)''')}, '')"


def hash_key(title: str, company: str, posted: str, source: str) -> str:
    parts = [f"lower({strip(f'''coalesce({p}, '')''')})" for p in (title, company)]
    parts += [f"coalesce({p}, '')" for p in (posted, source)]
    return f"sha256(concat_ws('|', {', '.join(parts)}))"

