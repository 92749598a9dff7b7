"""Named queries over the test tables and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- SQL text helpers -------------------------------------------------------------


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(items: Sequence[str]) -> str:
    return ", ".join(q(i) for i in items)


def sql_any(expr: str, phrases: Sequence[str]) -> str:
    return "(" + " OR ".join(f"contains({expr}, {q(p)})" for p in phrases) + ")"


def sql_ladder(expr: str, rules: Sequence[tuple[str, Sequence[str]]], default: str) -> str:
    whens = " ".join(f"WHEN {sql_any(expr, ps)} THEN {q(label)}" for label, ps in rules)
    return f"CASE {whens} ELSE {q(default)} END"


def sql_strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^\\s+|\\s+$', '', 'g')"


def sql_word(word: str) -> str:
    """Pattern for a whole word, letters of any script counting as such."""
    return rf"(^|[^\p{{L}}\p{{N}}_]){word}($|[^\p{{L}}\p{{N}}_])"


def sql_pattern(pattern: str) -> str:
    """The pattern with word ends and word letters of any script, for RE2."""
    out = pattern.replace(r"\w", r"[\p{L}\p{N}_]")
    if out.startswith(r"\b"):
        out = r"(^|[^\p{L}\p{N}_])" + out[2:]
    if out.endswith(r"\b"):
        out = out[:-2] + r"($|[^\p{L}\p{N}_])"
    return out


def sql_case(expr: str, mapping: dict) -> str:
    whens = " ".join(
        f"WHEN {q(k)} THEN {q(v) if isinstance(v, str) else v}" for k, v in mapping.items()
    )
    return f"CASE {expr} {whens} END"
