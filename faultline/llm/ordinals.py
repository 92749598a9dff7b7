"""Places of rows in the order of their group, for groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.session import materialise


def number_rows(
    df: DataFrame, group: list[str], order: list[str], place: str = "place", total: str | None = None
) -> DataFrame:
    """Adds ``place`` (long, from 0) among the rows of equal ``group``, by ``order``, nulls first.

    ``total`` names a column for the size of the group, if wanted. Null groups are groups.
    Rows that agree in all columns of the order come in the order of the written rows. Any
    group may hold all the rows: rows are dealt out by ranges of group, order and a row tag,
    so a large group, or many equal rows, lie in many partitions. Each counts its own rows;
    the counts of the earlier partitions of a group (one row per partition and group) are
    added. An empty table gives no rows.
    """
    tagged = materialise(df.withColumn("_tag", F.monotonically_increasing_id()), "untold")
    keys = [F.col(c).asc_nulls_first() for c in [*group, *order]]
    dealt = tagged.repartitionByRange(*keys, "_tag").withColumn("_part", F.spark_partition_id())
    dealt = materialise(dealt, "dealt")
    counts = dealt.groupBy("_part", *group).agg(F.count(F.lit(1)).alias("_rows"))
    counts = materialise(counts, "dealt-counts")
    before = Window.partitionBy(*group).orderBy("_part")
    sums = F.sum("_rows").over(before) - F.col("_rows")
    offsets = counts.select("_part", *group, sums.alias("_before"))
    if total:
        sizes = F.sum("_rows").over(Window.partitionBy(*group))
        offsets = counts.select("_part", *group, sums.alias("_before"), sizes.alias(total))
    offsets = offsets.select(
        F.col("_part").alias("_p"), *[F.col(c).alias(f"_g{k}") for k, c in enumerate(group)],
        "_before", *([total] if total else []),
    )
    own = Window.partitionBy("_part", *group).orderBy(*keys, "_tag")
    inside = dealt.withColumn("_own", F.row_number().over(own))
    same = F.col("_part") == F.col("_p")
    for k, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{k}"))
    return inside.join(offsets, same).select(
        *df.columns,
        (F.col("_own") - 1 + F.col("_before")).alias(place),
        *([total] if total else []),
    )
