"""Paged reading against plain reading: any page size, ties, filters, streams."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from faultline.session import fresh_path
from faultline.sources import paged

SCHEMA = "key BIGINT, updated TIMESTAMP_NTZ, status STRING, n INT"


@pytest.fixture(scope="module")
def issues(spark):
    rng = random.Random(2)
    start = datetime.datetime(2024, 1, 1)
    rows = [
        (k, start + datetime.timedelta(hours=rng.choice([0, 0, 5, rng.randrange(300)])), rng.choice(["Open", "Done", None]), rng.choice([1, 2, None]))
        for k in range(900)
    ]
    path = fresh_path(spark, "issues")
    spark.createDataFrame(rows, SCHEMA).repartitionByRange(6, "updated").sortWithinPartitions("updated").write.parquet(path)
    return path, rows


@pytest.mark.parametrize("page_rows, slices", [(1000, 1), (7, 4), (100, 16)])
def test_pages_add_up(spark, issues, page_rows, slices):
    path, rows = issues
    df = paged.read_pages(spark, path, page_rows=page_rows, slices=slices)
    assert sorted(map(str, df.collect())) == sorted(map(str, spark.createDataFrame(rows, SCHEMA).collect()))
    assert df.rdd.getNumPartitions() <= slices
    few = df.where((F.col("status") == "Open") & (F.col("n") > 1) & (F.length("status") == 4) & (F.col("updated") >= "2024-01-01 05:00:00"))
    want = sorted(k for k, u, s, n in rows if s == "Open" and (n or 0) > 1 and u.hour + 24 * (u.day - 1) + 24 * 31 * (u.month - 1) >= 5)
    assert sorted(r.key for r in few.select("key").collect()) == want
    assert df.where("status in ('Done', 'x')").count() == sum(s == "Done" for _, _, s, _ in rows)


def test_filters_reach_the_pages(spark, issues):
    reader = paged.PagedIssues({"path": issues[0]}).reader(paged.PagedIssues({"path": issues[0]}).schema())
    filters = [paged.IsNotNull(("status",)), paged.EqualTo(("status",), "Open"), paged.GreaterThan(("n",), 1), paged.EqualTo(("s", "x"), 2)]
    assert list(reader.pushFilters(filters)) == [filters[3]]
    assert [w[1:] for w in reader.where] == [("status", "Open"), ("n", 1)]
    read = [b for part in reader.partitions() for b in reader.read(part)]
    assert sum(b.num_rows for b in read) == sum(s == "Open" and (n or 0) > 1 for _, _, s, n in issues[1])
    plan = paged.read_pages(spark, issues[0]).where("status = 'Open'")._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.replace("RuntimeFilters", "") and "BatchScan paged_issues" in plan


def test_token_order_of_ties(spark, issues):
    store, seen, after = paged.ParquetPages(issues[0], "updated", "key"), [], None
    while True:
        page = store.page(["key"], [], after, None, 13)
        seen += [(u.as_py(), k.as_py()) for u, k in zip(page["updated"], page["key"])]
        if page.num_rows < 13:
            break
        after = store.token(page, 12)
    assert seen == sorted((u, k) for k, u, _, _ in issues[1])


def test_stream_of_changes(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    at = lambda h: datetime.datetime(2024, 1, 1, h)

    def write(rows):
        spark.createDataFrame([(k, at(h), "Open", 1) for k, h in rows], SCHEMA).coalesce(1).write.mode("append").parquet(path)

    def run():
        stream = paged.read_pages(spark, path, stream=True, page_rows=2)
        query = stream.select("key", F.hour("updated").alias("h")).writeStream.format("parquet").option("path", out)
        query.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        return sorted(map(tuple, spark.read.schema("key BIGINT, h INT").parquet(out).collect()))

    write([(1, 3), (2, 3), (3, 4)])
    assert run() == [(1, 3), (2, 3), (3, 4)]
    assert len(run()) == 3
    write([(4, 4), (1, 9), (5, 9), (6, 10)])  # issue 1 changed; 4 ties with the last token
    assert run() == sorted([(1, 3), (2, 3), (3, 4), (4, 4), (1, 9), (5, 9), (6, 10)])


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "none"))
    assert paged.read_pages(spark, str(tmp_path / "none")).collect() == []


@pytest.mark.parametrize("held", [1, 3000, 64 << 20])
def test_rows_in_no_order(monkeypatch, tmp_path, held):
    """Each row group belongs to one slice, whatever the order; equal tokens and null keys are not lost."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    rng = random.Random(5)
    times = [datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=rng.randrange(40)) for _ in range(1000)]
    rows = [(None if k % 100 == 8 else rng.randrange(20), None if k % 100 == 7 else t, k) for k, t in enumerate(times)]
    columns = zip(*rows, strict=True)
    table = pa.table([pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.timestamp("us"), pa.int64()), strict=True)], ["key", "updated", "n"])
    path = str(tmp_path / "t.parquet")
    pq.write_table(table, path, row_group_size=100)
    monkeypatch.setattr(paged, "HELD_BYTES", held, raising=False)
    source = paged.PagedIssues({"path": path, "page_rows": "7", "slices": "4"})
    reader = source.reader(source.schema())
    parts = reader.partitions()
    read = [[r for b in reader.read(part) for r in b.to_pylist()] for part in parts]
    assert sorted(r["n"] for part in read for r in part) == [k for k in range(1000) if k % 100 != 7]
    assert sorted(len(part) for part in read) == [198, 198, 297, 297]
    assert all(b.num_rows <= 7 for part in parts for b in reader.read(part))
