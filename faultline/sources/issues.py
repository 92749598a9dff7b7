"""Historical issues: scans, and the columns taken from a nested issue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline import schemas
from faultline.functions import text as t

_WORD = r"\p{L}\p{N}_"


def read_issues(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.ISSUES).json(path)


# --- scans: predicates and column lists reach the file reader ----------------


def recent(issues: DataFrame, kind: Column, updated: str, key: str, limit: int = 300) -> DataFrame:
    """Rows of one kind, newest update first."""
    return issues.filter(kind).orderBy(F.desc(updated), key).limit(limit)


def training_corpus(
    issues: DataFrame, labelled: Column, created: str, key: str, now: Column,
    limit: int = 2000, max_age_months: int = 15,
) -> DataFrame:
    """Labelled rows of the last ``max_age_months`` times 30 days before ``now``."""
    oldest = now - F.expr(f"INTERVAL {max_age_months * 30} DAYS")
    return issues.filter(labelled & (F.col(created) >= oldest)).orderBy(F.desc(created), key).limit(limit)


def paged_search(
    issues: DataFrame, columns: Sequence[str], where: Column, updated: str, key: str,
    limit: int = 200, after: tuple | None = None,
) -> DataFrame:
    """One page, newest first; ``after`` is the ``(updated, key)`` of the last row seen."""
    rows = issues.filter(where)
    if after is not None:
        moment, last = (F.lit(v) for v in after)
        rows = rows.filter((F.col(updated) < moment) | ((F.col(updated) == moment) & (F.col(key) > last)))
    return rows.select(*columns).orderBy(F.desc(updated), key).limit(limit)


def text_search(
    issues: DataFrame, text: str, query: str, newest: str, key: str, limit: int = 20
) -> DataFrame:
    """Rows whose text holds every word of ``query``, newest first."""
    words = [w for w in query.lower().split() if w]
    rows = issues
    for word in words:
        quoted = "".join(c if c.isalnum() or c == "_" else "\\" + c for c in word)
        rows = rows.filter(F.lower(F.col(text)).rlike(f"(^|[^{_WORD}]){quoted}($|[^{_WORD}])"))
    return rows.orderBy(F.desc(newest), key).limit(limit)


def by_keys(issues: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """Point lookups for a whole list of keys."""
    return issues.join(keys.select(key).distinct(), key, "left_semi")


# --- columns -----------------------------------------------------------------


def html_text(html: Column) -> Column:
    return t.strip(F.regexp_replace(html, "<[^>]+>", " "))


def doc_tree_text(tree: Column) -> Column:
    """Text nodes of a document tree (JSON text), depth first, joined by a space.

    A step of the fold puts the children of every node in the node's own place, so the order is
    that of the document at any depth; when no node has children left, the remaining steps
    do nothing. Their number is bounded by the ``content`` keys there are. A tree that is
    null or no JSON has the empty text; what is no object is passed over; text that is no string is
    taken as it prints.
    """

    def kind(node: Column) -> Column:
        return F.try_variant_get(node, "$.type", "string")

    def children(node: Column) -> Column:
        inner = F.when(kind(node).eqNullSafe(F.lit("text")), F.lit(None))
        return inner.otherwise(F.try_variant_get(node, "$.content", "array<variant>"))

    def step(state: Column, _: Column) -> Column:
        spread = F.flatten(F.transform(state["nodes"], lambda x: F.coalesce(children(x), F.array(x))))
        more = F.exists(spread, lambda x: children(x).isNotNull())
        done = F.struct(F.lit(False).alias("more"), state["nodes"].alias("nodes"))
        return F.when(state["more"], F.struct(more.alias("more"), spread.alias("nodes"))).otherwise(done)

    def walk(root: Column) -> Column:
        name = F.lit('"content"')
        plain = F.to_json(root)
        bound = ((F.length(plain) - F.length(F.replace(plain, name, F.lit("")))) / F.length(name)).cast("int")
        start = F.struct(F.lit(True).alias("more"), F.array(root).alias("nodes"))
        return F.aggregate(F.sequence(F.lit(0), bound), start, step)["nodes"]

    texts = F.transform(
        t.let(F.try_parse_json(tree), walk),
        lambda x: F.when(kind(x) == "text", F.try_variant_get(x, "$.text", "string")),
    )
    return F.coalesce(F.array_join(F.filter(texts, lambda x: x != ""), " "), F.lit(""))


def issue_text(summary: Column, html: Column, tree_json: Column | None = None) -> Column:
    """Summary and body; the body is the rendered HTML, else the document tree."""
    body = doc_tree_text(tree_json) if tree_json is not None else F.lit("")
    body = F.when(F.coalesce(html, F.lit("")) != "", html_text(html)).otherwise(body)
    return t.strip(F.concat(F.coalesce(summary, F.lit("")), F.lit("\n"), body))


def training_text(summary: Column, body: Column) -> Column:
    """Body alone when it already starts with the summary."""
    summary, body = F.coalesce(summary, F.lit("")), F.coalesce(body, F.lit(""))
    return F.when(body.startswith(summary), body).otherwise(
        t.strip(F.concat(summary, F.lit("\n"), body))
    )


def description_text(description: Column, summary: Column, html: Column) -> Column:
    """Training text of an issue whose description is plain text or a tree (a variant)."""
    plain = F.when(F.schema_of_variant(description) == "STRING", F.variant_get(description, "$", "string"))
    body = issue_text(summary, html, F.to_json(description))
    return F.when(t.strip(plain) != "", training_text(summary, plain)).otherwise(
        training_text(summary, body)
    )


def issue_fields(issues: DataFrame) -> DataFrame:
    """Flat attributes of nested issues."""
    f = F.col("fields")
    return issues.select(
        "key",
        F.coalesce(
            t.blank_to_null(f["assignee"]["displayName"]), t.blank_to_null(f["assignee"]["emailAddress"])
        ).alias("assignee"),
        F.coalesce(f["priority"]["name"], F.lit("Unknown")).alias("priority"),
        F.try_element_at(f["components"], F.lit(1))["name"].alias("component"),
        f["created"].alias("created"),
    )
