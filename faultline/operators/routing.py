"""Owner routing: rosters, managers and the owner cascade."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline import lexicons as lx


def owner_frequency(matches: DataFrame, queries: DataFrame, similar: float = lx.TFIDF_SIMILAR) -> DataFrame:
    """Most frequent assignee over the matches of a query; ties to the better ranked."""
    named = matches.filter(F.coalesce("assignee", F.lit("")) != "")
    counts = named.groupBy("query_id", "assignee").agg(F.count("*").alias("n"), F.min("rank").alias("first_rank"))
    best = F.max_by(F.struct("assignee", "n"), F.struct("n", -F.col("first_rank")))
    per = counts.groupBy("query_id").agg(best.alias("b"), F.sum("n").alias("total"))
    reason = F.format_string(
        f"%s had %d of %d similar issues (similarity {similar} or more).",
        F.col("b.assignee"), F.col("b.n"), F.col("total"),
    )
    return queries.select("query_id").join(per, "query_id", "left").select(
        "query_id",
        F.col("b.assignee").alias("suggested_owner"),
        F.coalesce(F.when(F.col("b").isNotNull(), reason), F.lit("No similar issue names anyone.")).alias("owner_reason"),
    )


def roster_build(issues: DataFrame, managers: DataFrame, minimum: int = lx.ROSTER_MINIMUM) -> DataFrame:
    """``component, assignee`` to the people of each component, busiest first."""
    counts = (
        issues.filter(F.coalesce("assignee", F.lit("")) != "")
        .groupBy("component", F.col("assignee").alias("name"))
        .agg(F.count("*").alias("bug_count"))
        .filter(F.col("bug_count") >= minimum)
    )
    order = Window.partitionBy("component").orderBy(F.desc("bug_count"), "name")
    return manager_anti_join(counts, managers, "name").withColumn("place", F.row_number().over(order))


def component_match_join(matches: DataFrame, routed: DataFrame) -> DataFrame:
    """Matches on the component their report was routed to."""
    return matches.join(routed, ["query_id", "component"], "left_semi")


def roster_semi_join(matches: DataFrame, roster: DataFrame) -> DataFrame:
    """Matches whose assignee is on the roster of the component."""
    people = roster.select("component", F.col("name").alias("assignee"))
    return matches.join(people, ["component", "assignee"], "left_semi")


def manager_anti_join(rows: DataFrame, managers: DataFrame, name: str = "assignee") -> DataFrame:
    return rows.join(managers.select(F.col("manager").alias(name)), name, "left_anti")


def manager_lookup(routed: DataFrame, team_managers: DataFrame) -> DataFrame:
    """Escalation manager of a component, null where none is mapped."""
    return routed.join(team_managers.select("component", "manager"), "component", "left")


def closest_manager(matches: DataFrame, managers: DataFrame) -> DataFrame:
    """The manager on the most similar match of a query."""
    theirs = matches.join(managers.select(F.col("manager").alias("assignee")), "assignee", "left_semi")
    best = F.max_by(F.struct("assignee", "key", "similarity"), F.struct("similarity", -F.col("rank")))
    return theirs.groupBy("query_id").agg(best.alias("b")).select(
        "query_id",
        F.col("b.assignee").alias("manager"),
        F.col("b.key").alias("key"),
        F.col("b.similarity").alias("similarity"),
    )


def owner_routed(
    routed: DataFrame, matches: DataFrame, roster: DataFrame, managers: DataFrame, team_managers: DataFrame
) -> DataFrame:
    """Owner per report: an engineer with hits, else the closest manager, else the
    team's manager, else nobody.

    ``routed(query_id, component)``; ``matches(query_id, rank, key, component,
    assignee, similarity)`` with at most k rows per report; the other three are
    staff tables.
    """
    same = component_match_join(matches, routed).filter(F.coalesce("assignee", F.lit("")) != "")
    engineers = roster_semi_join(manager_anti_join(same, managers), roster)
    hits = engineers.groupBy("query_id", "assignee").agg(
        F.count("*").alias("n"),
        F.min("rank").alias("first_rank"),
        F.array_sort(F.collect_list(F.struct("rank", "key"))).alias("keys"),
    )
    best = hits.groupBy("query_id").agg(
        F.max_by(F.struct("assignee", "n", "keys"), F.struct("n", -F.col("first_rank"))).alias("e"),
        F.sum("n").alias("total"),
    )
    near = closest_manager(same, managers).select(
        "query_id", F.struct("manager", "key", "similarity").alias("m")
    )
    joined = (
        manager_lookup(routed, team_managers)
        .join(best, "query_id", "left")
        .join(near, "query_id", "left")
    )
    engineer, closest, team = F.col("e").isNotNull(), F.col("m").isNotNull(), F.col("manager").isNotNull()
    examples = F.array_join(F.transform(F.slice(F.col("e.keys"), 1, 3), lambda k: k["key"].cast("string")), ", ")
    reason = (
        F.when(engineer, F.format_string(
            "Most matches on %s: %d of %d, such as %s.",
            F.col("component"), F.col("e.n"), F.col("total"), examples))
        .when(closest, F.format_string(
            "Only a manager has had something similar here: %s (similarity %.2f), %s.",
            F.col("m.key").cast("string"), F.col("m.similarity"), F.col("m.manager")))
        .when(team, F.format_string(
            "Nothing similar on %s; its manager is %s.", F.col("component"), F.col("manager")))
        .otherwise(F.format_string(
            "Nothing similar on %s and no manager is known.", F.col("component")))
    )
    return joined.select(
        "query_id",
        F.when(engineer, F.col("e.assignee")).when(closest, F.col("m.manager")).otherwise(F.col("manager")).alias("suggested_owner"),
        reason.alias("owner_reason"),
        F.when(engineer, "frequency-fallback")
        .when(closest, "manager-from-similar-bug")
        .when(team, "manager-escalation")
        .otherwise("no-candidates")
        .alias("method"),
    )


def owner_options(roster: DataFrame, managers: DataFrame, suggested: DataFrame) -> DataFrame:
    """Everyone a reviewer may pick: ``name, team``, managers first.

    A manager's entry replaces a roster entry; a suggested name only counts
    when nobody else lists it. One grouped minimum removes duplicates.
    """
    rows = (
        managers.select(F.col("manager").alias("name"), F.lit(0).alias("pref"), F.lit("Manager").alias("team"))
        .unionByName(roster.select("name", F.lit(1).alias("pref"), F.col("component").alias("team")))
        .unionByName(suggested.select(F.col("suggested_owner").alias("name"), F.lit(2).alias("pref"), F.lit("?").alias("team")))
        .filter(F.coalesce("name", F.lit("")) != "")
    )
    return (
        rows.groupBy("name")
        .agg(F.min(F.struct("pref", "team")).alias("b"))
        .select("name", F.col("b.team").alias("team"))
        .orderBy(F.when(F.col("team") == "Manager", 0).otherwise(1), F.lower("name"), "name")
    )
