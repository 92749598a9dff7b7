"""Column helpers for text: trimming, lines, matching, tokens and n-grams."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters, digits and underscore, at least two: the same class in Java and RE2.
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"


# Every character that counts as white space.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column) -> Column:
    """Remove white space of any kind at both ends."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def lines(c: Column) -> Column:
    # split at one plain character needs no pattern; few texts have another line end
    other = F.regexp_replace(c, r"\r\n|[\r\x0b\x0c\u0085\u2028\u2029]", "\n")
    return F.split(F.when(c.rlike(r"[\r\x0b\x0c\u0085\u2028\u2029]"), other).otherwise(c), "\n", -1)


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def first_match(c: Column, pattern: str, group: int = 1) -> Column:
    """Group of the first match, null when nothing (or the empty string) matches."""
    return blank_to_null(F.regexp_extract(c, pattern, group))


def contains_any(c: Column, phrases: Sequence[str]) -> Column:
    hit = F.lit(False)
    for phrase in phrases:
        hit = hit | c.contains(phrase)
    return hit


def let(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use(c)`` with ``c`` evaluated once, however often ``use`` refers to it."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def first_rule(c: Column, rules: Sequence[tuple[str, Sequence[str]]], default: str) -> Column:
    """Label of the first rule with a phrase inside ``c``."""

    def ladder(text: Column) -> Column:
        out = None
        for label, phrases in rules:
            hit = contains_any(text, phrases)
            out = F.when(hit, label) if out is None else out.when(hit, label)
        return F.lit(default) if out is None else out.otherwise(default)

    return let(c, ladder)


def required_literal(pattern: str) -> str:
    """The longest piece of plain text every match of ``pattern`` holds, or ''."""
    plain = re.sub(r"\\[a-zA-Z]|\[[^\]]*\]|\([^)]*\)|.(?=[?*{])", "\0", pattern)
    if "|" in plain or "(" in plain:
        return ""
    return max(re.split(r"[\0.^$*+?{}\\]+", plain), key=len)


def found(c: Column, pattern: str) -> Column:
    """``c`` matches ``pattern``; a plain substring search rules most rows out first."""
    literal = required_literal(pattern)
    matches = c.rlike(f"(?U){pattern}")
    return c.contains(literal) & matches if literal else matches


def hits(c: Column, patterns: Sequence[str], regex: bool = True) -> Column:
    """Patterns found in ``c``, in list order. Each pattern is a literal, compiled once."""
    return F.array_compact(
        F.array(*[F.when(found(c, p) if regex else c.contains(p), F.lit(p)) for p in patterns])
    )


def drop_until(items: Column, test: Callable[[Column], Column]) -> Column:
    """Elements from the first one that passes ``test``; empty when none does."""
    return let(
        items,
        lambda xs: let(
            F.array_position(F.transform(xs, test), F.lit(True)),
            lambda i: F.when(i > 0, F.slice(xs, F.greatest(i, F.lit(1)), F.size(xs))).otherwise(F.slice(xs, 1, 0)),
        ),
    )


def take_until(items: Column, test: Callable[[Column], Column]) -> Column:
    """Elements before the first one that passes ``test``; all when none does."""
    return let(
        items,
        lambda xs: let(
            F.array_position(F.transform(xs, test), F.lit(True)),
            lambda i: F.when(i > 0, F.slice(xs, F.lit(1), F.greatest(i - 1, F.lit(0)))).otherwise(xs),
        ),
    )


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN_PATTERN), F.lit(0))


def words(c: Column, stop_words: Sequence[str] = ()) -> Column:
    """Lower-case words without the stop words, in text order."""
    found = tokens(c)
    return F.filter(found, lambda w: ~w.isin(list(stop_words))) if stop_words else found


def with_bigrams(found: Column) -> Column:
    """A word list followed by its adjacent pairs."""
    n = F.size(found)
    pairs = F.when(
        n >= 2,
        F.zip_with(
            F.slice(found, 1, n - 1),
            F.slice(found, 2, n - 1),
            lambda a, b: F.concat(a, F.lit(" "), b),
        ),
    ).otherwise(F.slice(found, 1, 0))
    return F.concat(found, pairs)


def content_words(c: Column, stop_words: Sequence[str]) -> Column:
    """Distinct ASCII words longer than two letters, minus the stop words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z]+"), F.lit(0))
    return F.array_distinct(
        F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(list(stop_words)))
    )


def seconds_of(c: Column) -> Column:
    """``Duration: H:M:S`` in a probe log as seconds, 0 when absent."""
    pattern = r"Duration:\s*(\d+):(\d+):([\d.]+)"
    h, m, s = (F.regexp_extract(c, pattern, i).try_cast("double") for i in (1, 2, 3))
    return F.coalesce(h * 3600 + m * 60 + s, F.lit(0.0))


def json_from_text(c: Column) -> Column:
    """The JSON object inside a free-text reply, null when there is none.

    A surrounding code fence is removed; if what remains is not JSON the first
    balanced ``{...}`` is taken, braces inside string literals not counting.
    The text is cut into its structural marks first, so the fold runs over
    marks, not characters.
    """
    body = strip(c)
    inner = F.regexp_extract(body, r"(?s)^\s*```(?:json|JSON)?\s*\n?(.*?)\n?```\s*$", 1)
    body = F.when(inner != "", strip(inner)).otherwise(body)
    tail = F.regexp_extract(body, r"(?s)\{.*", 0)
    # Marks: an escaped character, one quote or brace, or a run of anything else.
    marks = F.regexp_extract_all(tail, F.lit(r'\\[\s\S]|["{}]|[^"{}\\]++|\\'), F.lit(0))
    opened = F.struct(
        F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(0).alias("len"), F.lit(0).alias("end")
    )

    def step(state: Column, mark: Column) -> Column:
        quoted = state["quoted"]
        sign = F.when(mark.startswith("\\"), F.when(quoted, "").otherwise(F.right(mark, F.lit(1)))).otherwise(mark)
        change = F.when(quoted, 0).when(sign == "{", 1).when(sign == "}", -1).otherwise(0)
        depth = state["depth"] + change
        length = state["len"] + F.length(mark)
        closed = (change == -1) & (depth == 0)
        return F.struct(
            depth.cast("int").alias("depth"),
            F.when(sign == '"', ~quoted).otherwise(quoted).alias("quoted"),
            length.alias("len"),
            F.when(state["end"] > 0, state["end"]).when(closed, length).otherwise(0).alias("end"),
        )

    end = F.aggregate(marks, opened, step, lambda state: state["end"])
    candidate = F.when(end > 0, F.substring(tail, F.lit(1), end))
    is_json = F.try_parse_json(body).isNotNull() & (body != "")
    ok = F.try_parse_json(candidate).isNotNull()
    return F.when(is_json, body).when(ok, candidate)
