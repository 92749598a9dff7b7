"""Field extraction from report text: each function maps a text column to a column.

Java flags used below: ``d`` makes only a line feed a line end, ``U`` makes
classes such as ``\\w`` and ``\\s`` cover all of Unicode.

Every function takes the lower-case text as ``low`` if the caller has it. A
substring search in it rules out most rows before a pattern runs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline import lexicons as lx
from faultline.functions import text as t

_HEADER = r"(?i)^(From|To|Subject|Date):"
_SECTION = r"(?i)^(Steps|Expected|Actual|Impact|Environment|Reproducibility|Additional)"
_ITEM = r"(?U)^(\d+[\.\)]|[-•*])\s+"
_NUMBERED = r"(?U)^\d+[\.\)]\s+"
_STEPS_MENTION = r"(?i)steps?\s*(to\s*)?(reproduce|repro)"
_NAME = r"[A-Z][a-z]+(?: [A-Z][a-z]+)+"


def _has(text: Column, low: Column | None, *phrases: str) -> Column:
    return t.contains_any(F.lower(text) if low is None else low, phrases)


def reporter_email(text: Column, low: Column | None = None) -> Column:
    """Address inside the first ``From:`` line."""
    header = F.when(_has(text, low, "from:"), F.regexp_extract(text, r"(?imdU)^From:\s*(.+)$", 1))
    return t.first_match(header, r"(?U)[\w.+\-]+@[\w.\-]+\.\w+", 0)


def reporter_name(text: Column, email: Column | None = None) -> Column:
    """Display name, else a bare ``From:`` name, else a signature, else the address."""
    email = reporter_email(text) if email is None else email
    mail = F.when(text.contains("From:"), text)
    display = t.first_match(mail, r'(?mdU)^\s*From:\s*"?([^"<\n]+?)"?\s*<[^>]+>\s*$')
    bare = t.first_match(mail, r"(?mdU)^\s*From:\s*([^\n<]+?)\s*$")
    closings = ["Regards", "Thanks", "Cheers", "Best"]
    closed = F.when(t.contains_any(text, closings), text)
    signed = t.first_match(closed, rf"(?mdU)(?:{'|'.join(closings)})[,\s]*\n\s*({_NAME})")
    dash = F.when(text.startswith("-") | text.contains("\n-"), text)
    dashed = t.first_match(dash, rf"(?mdU)^-\s*({_NAME})\s*$")
    parts = F.filter(F.split(F.split_part(email, F.lit("@"), F.lit(1)), "[._]"), lambda p: p != "")
    spelled = F.array_join(
        F.transform(parts, lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.lower(F.substr(p, F.lit(2))))),
        " ",
    )
    return F.coalesce(
        t.strip(display),
        F.when(~bare.contains("@"), t.strip(bare)),
        t.strip(signed),
        t.strip(dashed),
        spelled,
    )


def module_prefix(
    text: Column,
    rules: Sequence[tuple[str, Sequence[str]]] = lx.MODULE_RULES,
    default: str = "[App]",
) -> Column:
    return t.first_rule(F.lower(text), rules, default)


def title(
    text: Column,
    rules: Sequence[tuple[str, Sequence[str]]] = lx.MODULE_RULES,
    product: str = "App",
    low: Column | None = None,
) -> Column:
    """Subject without reply marks and tags, led by a module tag."""
    tag = f"[{product}]"
    named = _has(text, low, "subject:") & text.rlike(r"(?imd)^Subject:")
    raw = F.regexp_extract(text, r"(?imd)^Subject:(.*)$", 1)
    subject = t.strip(F.regexp_replace(t.strip(raw), r"(?iU)^(Re|Fwd|FW):\s*", ""))
    subject = t.strip(
        F.regexp_replace(subject, rf"(?iU)\[(URGENT|{product}|BUG|CRITICAL)\]\s*", "")
    )
    tagged = t.let(
        subject,
        lambda s: F.when(s.startswith("["), s).otherwise(F.concat(module_prefix(s, rules, tag), F.lit(": "), s)),
    )
    body = F.filter(t.lines(text), lambda x: (t.strip(x) != "") & ~x.rlike(_HEADER))
    fallback = t.let(
        F.try_element_at(body, F.lit(1)),
        lambda line: F.concat(module_prefix(line, rules, tag), F.lit(": "), F.left(t.strip(line), F.lit(80))),
    )
    return F.when(named, tagged).otherwise(
        F.coalesce(fallback, F.lit(f"{tag}: Bug report"))
    )


def platform(text: Column, low: Column | None = None) -> Column:
    mentions = F.array_compact(
        F.array(
            *[
                F.when(_has(text, low, name.lower()) & text.rlike(rf"(?iU)\b{name}\b"), F.lit(name))
                for name in ("Android", "iOS", "Web")
            ]
        )
    )

    def labelled(value: Column) -> Column:
        android = value.contains("android")
        return (
            F.when(android & (value.contains("ios") | value.contains("web")), "Android, iOS, Web")
            .when(android, "Android")
            .when(value.contains("ios"), "iOS")
            .when(value.contains("web"), "Web")
        )

    value = F.when(
        _has(text, low, "platform:"), F.lower(F.regexp_extract(text, r"(?idU)Platform:\s*([\w,/ ]+)", 1))
    )
    return F.coalesce(
        t.let(value, labelled), t.blank_to_null(F.array_join(mentions, ", ")), F.lit("Unknown")
    )


def version(text: Column, low: Column | None = None) -> Column:
    named = F.when(_has(text, low, "version"), text)
    label = F.when(_has(text, low, "version:"), text)
    return F.coalesce(
        t.first_match(label, r"(?iU)(?:App\s*Version|Version):\s*v?(\d+\.\d+(?:\.\d+)?)"),
        t.first_match(F.when(text.rlike(r"[vV]\p{Nd}"), text), r"(?U)\b[vV](\d+\.\d+\.\d+)\b"),
        t.first_match(named, r"(?iU)\bversion\s+(\d+\.\d+(?:\.\d+)?)\b"),
    )


def _run_of_items(lines: Column, item: str) -> Column:
    """Item lines from the first one up to the next blank line, marks removed."""
    run = t.take_until(t.drop_until(lines, lambda x: x.rlike(item)), lambda x: x == "")
    kept = F.filter(run, lambda x: x.rlike(item))
    return F.transform(kept, lambda x: t.strip(F.regexp_replace(x, item, "")))


def steps(text: Column, low: Column | None = None) -> Column:
    """Numbered or bulleted steps below a steps label; else numbered lines after a mention."""
    named = F.when(_has(text, low, "step"), text)
    block = F.regexp_extract(
        named,
        r"(?idU)(?:Steps to Reproduce|Steps|Reproduction Steps)[:\s]*\n([\s\S]+?)(?=\n\s*\n\s*[A-Z]|\z)",
        1,
    )
    labelled = _run_of_items(F.transform(t.lines(block), t.strip), _ITEM)
    after = t.drop_until(t.lines(named), lambda x: x.rlike(_STEPS_MENTION))
    after = F.filter(after, lambda x: ~x.rlike(_STEPS_MENTION))
    mentioned = _run_of_items(F.transform(after, t.strip), _NUMBERED)
    either = t.let(labelled, lambda found: F.when(F.size(found) > 0, found).otherwise(mentioned))
    return F.coalesce(either, F.array().cast("array<string>"))


def labelled_field(
    text: Column, labels: Sequence[str], default: str = lx.NOT_PROVIDED, low: Column | None = None
) -> Column:
    """Value behind the first label that has one, up to a blank line or the next label."""
    padded = F.concat(text, F.lit("\n\n"))
    values = [
        t.blank_to_null(
            t.strip(
                F.regexp_replace(
                    F.regexp_extract(
                        F.when(_has(text, low, label.lower()), padded),
                        rf"(?idU)(?:^|\n)\**\s*{label}(?:\s+Result)?\s*[:\*]+\s*\**\n?"
                        r"([\s\S]+?)(?=\n\s*\n|\n\s*(?:Actual|Expected|Impact|Environment|Repro|Steps|Regards|Thanks|$))",
                        1,
                    ),
                    r"\*+",
                    "",
                )
            )
        )
        for label in labels
    ]
    return F.coalesce(*values, F.lit(default))


def component_corpus(text: Column, title_: Column, low: Column | None = None) -> Column:
    return F.concat(F.lower(text) if low is None else low, F.lit(" "), F.lower(title_))


def component(
    text: Column,
    title_: Column,
    rules: Sequence[tuple[str, Sequence[str]]] = lx.COMPONENT_RULES,
    word_rules: Sequence[tuple[str, Sequence[str]]] = lx.COMPONENT_WORD_RULES,
    default: str = lx.CATCH_ALL,
    low: Column | None = None,
    corpus: Column | None = None,
) -> Column:
    """First rule with a phrase in the text or title; word rules match whole words.

    ``corpus``: lower-case text and title, see :func:`component_corpus`, if the caller has it as a
    column. The many searches in it are compiled then; inside :func:`text.let` they are interpreted.
    """
    words = {label: entries for label, entries in word_rules}

    def ladder(corpus: Column) -> Column:
        out = None
        for label, phrases in rules:
            hit = t.contains_any(corpus, phrases)
            for word in words.get(label, []):
                hit = hit | t.found(corpus, rf"\b{word}\b")
            out = F.when(hit, label) if out is None else out.when(hit, label)
        return F.lit(default) if out is None else out.otherwise(default)

    return t.let(component_corpus(text, title_, low), ladder) if corpus is None else ladder(corpus)


def reproducibility(text: Column, low: Column | None = None) -> Column:
    def labelled(value: Column) -> Column:
        percent = F.regexp_extract(value, r"(?U)~?(\d+)%", 1)
        return (
            F.when(t.contains_any(value, ["100", "every time", "always", "consistent"]), "100%")
            .when(t.contains_any(value, ["intermittent", "sometimes", "occasional"]), "intermittent")
            .when(value.contains("conditional"), "conditional")
            .when(percent != "", F.concat(F.lit("~"), percent, F.lit("%")))
        )

    def mentioned(low: Column) -> Column:
        sure = ["100% reproducible", "every single time", "100% consistent", "every time", "always"]
        return (
            F.when(t.contains_any(low, sure) | t.found(low, r"\b100%\b"), "100%")
            .when(low.contains("intermittent"), "intermittent")
            .otherwise("unknown")
        )

    pattern = r"(?idU)Reproducibility[:\s]+(.+?)(?:\.|$|\n)"
    value = F.when(_has(text, low, "reproducibility"), F.lower(t.strip(F.regexp_extract(text, pattern, 1))))
    low = F.lower(text) if low is None else low
    return F.coalesce(t.let(value, labelled), t.let(low, mentioned))


def description(text: Column, skip_greeting: bool = False) -> Column:
    """First paragraph after the headers: at most six lines, three sentences, 450 letters."""
    body = t.drop_until(t.lines(text), lambda x: x.rlike(_HEADER))
    body = F.transform(F.filter(body, lambda x: ~x.rlike(_HEADER)), t.strip)
    if skip_greeting:
        body = F.filter(body, lambda x: ~x.rlike(r"(?iU)^(hi|hello|dear|hey)\b.{0,60},$"))
    paragraph = t.take_until(t.drop_until(body, lambda x: x != ""), lambda x: x == "")
    paragraph = F.slice(t.take_until(paragraph, lambda x: x.rlike(_SECTION)), 1, 6)
    raw = F.array_join(F.transform(paragraph, lambda x: F.regexp_replace(x, r"\*+", "")), " ")

    def shorten(raw: Column) -> Column:
        short = F.array_join(F.slice(F.split(raw, r"(?U)(?<=[.!?])\s+", -1), 1, 3), " ")
        cut = t.let(
            short,
            lambda s: F.when(F.length(s) > 450, F.concat(F.left(s, F.lit(450)), F.lit("..."))).otherwise(s),
        )
        return F.when(raw == "", lx.NO_DESCRIPTION).otherwise(cut)

    return t.let(raw, shorten)
