"""Ticket table, log, corrections, sources and sinks."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from faultline import schemas
from faultline.operators import mining, tickets
from faultline.session import fresh_path
from faultline.sources import issues as src
from faultline.sources import reports, tables
from faultline.streaming import streams

DRAFT = "report_id BIGINT, summary STRING, description STRING, component STRING, priority STRING, assignee STRING, reporter STRING, duplicate_of STRING, media_paths ARRAY<STRING>"


def at(day):
    return F.lit(f"2024-05-{day:02d} 10:00:00").cast("timestamp_ntz")


def no_tickets(spark):
    return spark.createDataFrame([], schemas.TICKETS)


def test_keys_ignore_malformed(spark):
    keys = spark.createDataFrame([("TKT-7",), ("TKT-x",), ("odd",), ("TKT-12",)], "key STRING")
    assert tickets.next_key(keys).first()[0] == "TKT-13"
    assert tickets.next_key(keys.limit(0)).first()[0] == "TKT-1"


def test_log_replays_to_state(spark):
    rows = [(i, "s" * 600 if i == 3 else f"sum {i}", None, "", "P1", "ann", "bob", "", ["a", "b"]) for i in range(40)]
    drafts = spark.createDataFrame(rows, DRAFT)
    state, log = tickets.insert_tickets(drafts, no_tickets(spark), at(1))
    assert sorted(int(r["key"][4:]) for r in state.collect()) == list(range(1, 41))
    assert max(len(r["summary"]) for r in state.collect()) == 500
    state = state.drop("report_id")
    changes = spark.createDataFrame([("TKT-1", "Done"), ("TKT-2", "Nope"), ("TKT-99", "Done")], "key STRING, to STRING")
    state, moved, rejected = tickets.update_status(state, changes, at(2))
    assert {(r["key"], r["reject_reason"]) for r in rejected.collect()} == {("TKT-2", "invalid status"), ("TKT-99", "unknown key")}
    state, gone = tickets.delete_tickets(state, spark.createDataFrame([("TKT-5",)], "key STRING"), at(3))
    replayed = tickets.replay_state(log.unionByName(moved).unionByName(gone))
    cols = state.columns
    want = {json.dumps(r.asDict(), default=str, sort_keys=True) for r in state.select(*cols).collect()}
    got = {json.dumps(r.asDict(), default=str, sort_keys=True) for r in replayed.select(*cols).collect()}
    assert len(want) == 39 and got == want


def test_event_order_across_stretches(spark):
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, "hot" if i % 3 == 0 else f"k{i % 5}", f"s{i % 4}", start + datetime.timedelta(hours=7 * i)) for i in range(120)]
    df = spark.createDataFrame(rows, "seq BIGINT, key STRING, status STRING, ts TIMESTAMP_NTZ")
    got = {r["seq"]: (r["previous_status"], r["micros_in_status"]) for r in tickets.event_order_state(df, "key", "status", "ts", "seq").collect()}
    per = {}
    for seq, key, status, ts in rows:
        per.setdefault(key, []).append((seq, status, ts))
    for events in per.values():
        for i, (seq, _, ts) in enumerate(events):
            before = events[i - 1][1] if i else None
            wait = int((events[i + 1][2] - ts).total_seconds() * 1_000_000) if i + 1 < len(events) else None
            assert got[seq] == (before, wait)


def test_corrections(spark):
    rows = [("2024-01-01", "h", "UI", "DS", "0.5", "t", "x"), ("2024-01-02", "h", "UI", "Backend", "0.5", "", "first\nsecond"), ("2024-01-03", "g", "UI", " ", "0.5", "t", "x")]
    df = spark.createDataFrame(rows, schemas.CORRECTIONS)
    latest = {r["bug_hash"]: r["corrected_component"] for r in tickets.corrections_latest(df).collect()}
    assert latest == {"h": "Backend", "g": " "}
    assert tickets.corrections_latest(df, "all").count() == 3
    issues = {r["component"]: r["summary"] for r in tables.corrections_as_issues(df).collect()}
    assert issues == {"DS": "t", "Backend": "first"}
    path = fresh_path(spark, "csv")
    tables.append_corrections(df, path)
    back = tables.read_corrections(spark, path)
    assert {r["bug_text"] for r in back.collect()} == {"x", "first\nsecond"}


def test_events_round_trip(spark):
    path = fresh_path(spark, "events")
    row = [(datetime.datetime(2024, 1, 1), 1, "INSERT", "TKT-1", '{"a": "x, \\"y\\"\\nz"}')]
    tables.append_events(spark.createDataFrame(row, schemas.TICKET_EVENTS), path)
    tables.append_events(spark.createDataFrame(row, schemas.TICKET_EVENTS), path)
    back = tables.read_events(spark, path).collect()
    assert len(back) == 2 and json.loads(back[0]["payload"]) == {"a": 'x, "y"\nz'}


def test_issues_with_trees(spark, tmp_path):
    tree = {"type": "doc", "content": [{"type": "p", "content": [{"type": "text", "text": "one"}, {"type": "text", "text": ""}]}, {"type": "p", "content": [{"type": "text", "text": "two"}]}]}
    base = {"status": {"name": "Open"}, "assignee": {"displayName": "", "emailAddress": "a@b.c"}, "priority": None, "components": [{"name": "UI"}], "created": "2024", "updated": "2024", "issuetype": {"name": "Bug"}}
    rows = [
        {"key": "A", "fields": {**base, "summary": "sum", "description": tree}, "renderedFields": {"description": ""}},
        {"key": "B", "fields": {**base, "summary": "sum", "description": "sum and text"}, "renderedFields": None},
        {"key": "C", "fields": {**base, "summary": "sum", "description": None}, "renderedFields": {"description": "<p>hello</p>"}},
    ]
    (tmp_path / "i.json").write_text("\n".join(json.dumps(r) for r in rows))
    df = src.read_issues(spark, str(tmp_path))
    text = src.description_text(F.col("fields.description"), F.col("fields.summary"), F.col("renderedFields.description"))
    got = {r["key"]: r["t"] for r in df.select("key", text.alias("t")).collect()}
    assert got == {"A": "sum\none two", "B": "sum and text", "C": "sum\nhello"}
    flat = src.issue_fields(df).first()
    assert (flat["assignee"], flat["priority"], flat["component"]) == ("a@b.c", "Unknown", "UI")


def test_tree_of_any_depth(spark):
    tree = {"type": "text", "text": "x"}
    for _ in range(40):
        tree = {"type": "p", "content": [{"type": "text", "text": ""}, tree, {"type": "text", "text": "y"}]}
    rows = [(json.dumps(tree),), (None,), ("{broken",), ("[]",), ('{"type": "text", "content": [1]}',)]
    df = spark.createDataFrame(rows, "j STRING")
    got = [r[0] for r in df.select(src.doc_tree_text(F.col("j"))).collect()]
    assert got == [" ".join(["x"] + ["y"] * 40), "", "", "", ""]


def test_deep_and_wide_trees_in_the_jvm(spark):
    import random

    rng = random.Random(6)

    def plain(node):
        if not isinstance(node, dict):
            return []
        if node.get("type") == "text":
            return [node["text"]] if node.get("text") else []
        inner = node.get("content")
        return [x for c in inner for x in plain(c)] if isinstance(inner, list) else []

    def grow(depth):
        if depth == 0 or rng.random() < 0.3:
            return rng.choice([{"type": "text", "text": f'w{rng.randrange(99)} "content" \\u00e9'}, {"type": "hr"}, 7, None, "x"])
        return {"content": [grow(depth - 1) for _ in range(rng.randrange(5))], "type": rng.choice(["p", "doc", None]), "text": "no"}

    trees = [grow(7) for _ in range(60)]
    deep = {"type": "text", "text": "deep"}
    for _ in range(200):
        deep = {"type": "p", "content": [deep]}
    trees += [deep, {"content": [{"type": "text", "text": f"t{k}"} for k in range(3000)]}]
    df = spark.createDataFrame([(json.dumps(x),) for x in trees], "j STRING")
    found = df.select(src.doc_tree_text(F.col("j")).alias("t"))
    assert [r.t for r in found.collect()] == [" ".join(plain(x)) for x in trees]
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()


def test_log_of_one_instant(spark):
    """Insert, update and delete at one time replay to the table."""
    now = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    drafts = spark.createDataFrame([(k, f"s{k}") for k in range(6)], "report_id BIGINT, summary STRING")
    for c in ("description", "component", "priority", "assignee", "reporter", "duplicate_of"):
        drafts = drafts.withColumn(c, F.lit("x"))
    drafts = drafts.withColumn("media_paths", F.lit(None).cast("array<string>"))
    empty = spark.createDataFrame([], "key STRING")
    table, log = tickets.insert_tickets(drafts, empty, now)
    table = table.drop("report_id")
    keys = sorted(r.key for r in table.collect())
    changes = [(keys[0], "Closed", 1), (keys[0], "In Progress", 2), (keys[1], "Closed", 1), (keys[2], "nope", 1)]
    changes = spark.createDataFrame(changes, "key STRING, to STRING, n INT")
    table, events, rejects = tickets.update_status(table, changes, now, log=log, order="n")
    assert rejects.count() == 1 and {r.seq for r in events.collect()} == {1}
    log = log.unionByName(events)
    gone = spark.createDataFrame([(keys[1],), (keys[3],)], "key STRING")
    table, events = tickets.delete_tickets(table, gone, now, log=log)
    flat = log.unionByName(events).withColumn("seq", F.lit(0).cast("bigint"))
    for every in (log.unionByName(events), flat):
        back = tickets.replay_state(every)
        assert sorted(map(tuple, back.select("key", "status").collect())) == sorted(
            map(tuple, table.select("key", "status").collect())
        )
    assert sorted(r.key for r in table.collect()) == sorted(set(keys) - {keys[1], keys[3]})
    assert {r.key: r.status for r in table.collect()}[keys[0]] == "In Progress"


def test_replay_from_any_snapshot(spark, tmp_path):
    """Snapshots after any batch, events out of order and tied: always the full replay."""
    import random

    rng, rows = random.Random(5), []
    for n in range(300):
        key, at = f"TKT-{rng.randrange(25)}", f"2024-01-{rng.randrange(1, 9):02d} 10:00:00"
        event = rng.choice(["INSERT", "STATUS_UPDATE", "STATUS_UPDATE", "DELETE"])
        payload = {"INSERT": {"summary": f"s{n}", "status": "Open"}, "STATUS_UPDATE": {"to": f"st{n % 4}"}, "DELETE": {}}[event]
        rows.append((at, rng.randrange(40), event, key, json.dumps(payload)))
    schema = "timestamp STRING, seq BIGINT, event STRING, key STRING, payload STRING"

    def frame(part):
        return spark.createDataFrame(part, schema).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))

    # of events that tie in everything either may count: leave one of each
    rows = list({(r[0], r[1], r[2], r[3]): r for r in rows}.values())
    path = str(tmp_path / "log")
    with pytest.raises(ValueError):
        tickets.replay_log(spark, path)
    for k in range(4):
        assert tickets.append_log(frame(rows[k::4]), path) == k
        if k in (1, 2):
            assert tickets.snapshot_log(spark, path) == k == tickets.snapshot_log(spark, path)
        seen = [r for j in range(k + 1) for r in rows[j::4]]
        want = sorted(map(str, tickets.replay_state(frame(seen)).collect()))
        assert sorted(map(str, tickets.replay_log(spark, path).collect())) == want
        if k == 1:
            middle = want
    assert sorted(map(str, tickets.replay_log(spark, path, upto=1).collect())) == middle
    states, mark, last = tickets._state_of_log(spark, path, None)
    read = [f for f in states.inputFiles() if "/log/batch=" in f]
    assert (mark, last) == (2, 3) and read and all("batch=3" in f for f in read)


def test_transitions_over_several_batches(spark, tmp_path):
    """Busy keys, equal times, small Arrow batches and one file per micro-batch."""
    import random

    from faultline.streaming import streams

    rng, rows = random.Random(8), []
    for n in range(600):
        rows.append((n, rng.choice("aab"), rng.choice(["Open", "Closed", "odd"]), n // 7))
    schema = "seq BIGINT, key STRING, status STRING, second BIGINT"
    for part in range(4):
        own = spark.createDataFrame(rows[part * 150 : part * 150 + 150], schema)
        own = own.withColumn("ts", F.timestamp_seconds("second")).drop("second")
        own.coalesce(1).write.parquet(str(tmp_path / f"in{part}"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        schema = "seq BIGINT, key STRING, status STRING, ts TIMESTAMP"
        out = f"{tmp_path}/out"
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False)
        events = stream.parquet(f"{tmp_path}/in*")
        streams.stream_status_transitions(events, out, "key", "status", ["ts", "seq"]).awaitTermination()
        got = sorted(
            (r.key, r.seconds, r.from_status or "-", r.to_status, r.valid)
            for r in spark.read.parquet(f"{out}/data").withColumn("seconds", F.unix_seconds("moment")).collect()
        )
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    last, want = {}, []
    for _, key, status, second in rows:
        want.append((key, second, last.get(key, "-"), status, status in ("Open", "Closed")))
        last[key] = status
    assert got == sorted(want)


def stop_after_batches(query, n):
    """Lets a started query finish ``n`` batches, then stops it in the middle of the source."""
    while query.isActive and len(query.recentProgress) < n:
        query.awaitTermination(0.05)
    query.stop()


def test_transitions_by_time_of_shuffled_batches(spark, tmp_path):
    """Any order of arrival, a restart between two batches, and late events beside the others."""
    import random

    from faultline.streaming import keyed, streams

    rng, rows = random.Random(3), []
    for n in range(400):
        rows.append((n, rng.choice(["a", "a", "b", "c", None]), rng.choice(["Open", "Closed", "odd", None]), 1000 + n // 3))
    shuffled = rng.sample(rows, len(rows))
    schema = "seq BIGINT, key STRING, status STRING, second BIGINT"

    def write(part, name):
        own = spark.createDataFrame(part, schema).withColumn("ts", F.timestamp_seconds("second")).drop("second")
        own.coalesce(1).write.parquet(str(tmp_path / f"in{name}"))
        return own

    for part in range(5):
        write(shuffled[part * 80 : part * 80 + 80], part)
    every = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("second")).drop("second")
    streams.write_heartbeat(every, str(tmp_path / "in5"), "ts", "1 HOUR")
    write([(900, "a", "Open", 1001), (901, "d", "Closed", 1002)], 6)
    out, kinds = f"{tmp_path}/out", "seq BIGINT, key STRING, status STRING, ts TIMESTAMP"
    stream = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in*")

    def start():
        return streams.stream_status_transitions(stream, out, "key", "status", ["ts", "seq"], delay="10 minutes")

    stop_after_batches(start(), 2)
    start().awaitTermination()
    got = sorted(
        (r.key, r.seconds, r.from_status or "-", r.to_status or "-", r.valid)
        for r in streams.read_events(spark, out).withColumn("seconds", F.unix_seconds("moment")).collect()
    )
    last, want = {}, []
    for _, key, status, second in rows:
        if key is not None:
            want.append((key, second, last.get(key) or "-", status or "-", status in ("Open", "Closed")))
            last[key] = status
    assert got == sorted(want)
    late = streams.read_events(spark, out, late=True).collect()
    assert sorted((r.key, r.to_status, r.from_status) for r in late) == [("a", "Open", None), ("d", "Closed", None)]
    assert keyed.ROCKSDB != spark.conf.get(keyed.PROVIDER, "")  # the session's own setting is back


def test_each_event_once_or_late(spark, tmp_path):
    from faultline.streaming import streams

    kinds = "id BIGINT, ts TIMESTAMP, value STRING"
    batches = [
        [(1, 100), (2, 4000), (1, 100)],
        [(2, 4000), (3, 9000), (1, 100)],  # the watermark is at 3400: 1 is behind it
        [(4, 8000), (5, 8500), (3, 9000), (None, 9000), (6, None)],
        [(4, 8000), (7, 20000)],
        [(3, 9000), (7, 20000), (8, 20001)],
    ]
    for n, rows in enumerate(batches):
        own = spark.createDataFrame(rows, "id BIGINT, s BIGINT").select("id", F.timestamp_seconds("s").alias("ts"), F.lit("x").alias("value"))
        own.coalesce(1).write.parquet(str(tmp_path / f"in{n}"))
    stream = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in*")
    out = f"{tmp_path}/out"
    stop_after_batches(streams.stream_event_dedup(stream, out, "id", "ts", "600 seconds"), 1)
    streams.stream_event_dedup(stream, out, "id", "ts", "600 seconds").awaitTermination()
    once = sorted((r.id, r.value) for r in streams.read_events(spark, out).collect())
    assert once == [(i, "x") for i in (1, 2, 3, 5, 7, 8)]
    late = sorted((str(r.id) for r in streams.read_events(spark, out, late=True).collect()))
    assert late == sorted(["1", "4", "None", "6", "4", "3"])


def test_compacted_state(spark, tmp_path):
    """A snapshot and the batches behind it give the state; a batch writes only what it changes."""
    import pathlib

    from faultline.streaming import streams

    kinds, out = "k BIGINT, status STRING, t BIGINT", f"{tmp_path}/out"
    sizes = [[(k, "Open", 1) for k in range(500)], [(3, "Closed", 2)], [(4, "Closed", 2), (999, "Open", 2)]]

    def state():
        return {(r.k, r.status, r.n_events) for r in streams.read_state(spark, out, "k").collect()}

    for n, rows in enumerate(sizes):
        spark.createDataFrame(rows, kinds).coalesce(1).write.parquet(str(tmp_path / f"in{n}"))
        stream = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in*")
        streams.stream_ticket_state(stream, out, "k", "status", ["t"]).awaitTermination()
        if n == 1:
            before = state()
            mark = streams.compact_state(spark, out, "k")
            assert streams.compact_state(spark, out, "k") == mark and state() == before
    assert {(3, "Closed", 2), (4, "Closed", 2), (999, "Open", 1), (5, "Open", 1)} <= state() and len(state()) == 501
    rows = spark.read.option("basePath", f"{out}/data").parquet(f"{out}/data")
    written = dict(rows.groupBy("batch_id").count().collect())
    assert sorted(written.values())[-3:] == [1, 2, 500]
    # what the snapshot holds is not read from the batches again
    first = min(pathlib.Path(f"{out}/data").glob("batch_id=*"), key=lambda p: int(p.name.split("=")[1]))
    assert not any(first.name in p for p in streams._state_rows(spark, out)[0].inputFiles())


def test_paged_search_walks_all(spark):
    df = spark.createDataFrame([(i, i // 3) for i in range(20)], "key INT, updated INT")
    seen, after = [], None
    while True:
        page = src.paged_search(df, ["key", "updated"], F.lit(True), "updated", "key", limit=6, after=after).collect()
        if not page:
            break
        seen += [r["key"] for r in page]
        after = (page[-1]["updated"], page[-1]["key"])
    assert sorted(seen) == list(range(20)) and len(seen) == 20


def test_report_folders(spark, tmp_path):
    (tmp_path / "case1").mkdir()
    (tmp_path / "case1" / "email.txt").write_text("Subject: a\nbody")
    (tmp_path / "case1" / "shot.PNG").write_bytes(b"x")
    (tmp_path / "case1" / "clip.mp4").write_bytes(b"x")
    (tmp_path / "alone.txt").write_text("text")
    got = {r["report_id"]: (r["raw_text"], [a.rsplit("/", 1)[1] for a in r["attachments"]]) for r in reports.report_files(spark, str(tmp_path)).collect()}
    assert got == {"case1": ("Subject: a\nbody", ["clip.mp4", "shot.PNG"]), "alone": ("text", [])}
    kinds = {(r["kind"], r["label"]) for r in reports.attachments(spark, str(tmp_path)).collect()}
    assert kinds == {("image", "case1"), ("video", "case1")}


def test_manifest(spark, tmp_path):
    repos = [{"name": n, "team": t, "stack": "s", "prod_branch": "main", "freshness": "warm", "purpose": "p"} for n, t in [("b", "x"), ("a", "x"), ("c", "y")]]
    (tmp_path / "repos.json").write_text(json.dumps({"repos": repos}, indent=1))
    df = tables.read_manifest(spark, str(tmp_path / "repos.json"))
    assert df.first()["owns_features"] == []
    assert [(r["name"], r["place"]) for r in tables.repos_by_team(tables.repos_for_team(df, "x")).orderBy("place").collect()] == [("a", 1), ("b", 2)]


def test_mining_tree(spark, tmp_path):
    files = {
        "shop/pom.xml": "x", "shop/README.md": "read me", "shop/src/PayService.java": "public enum Kind {}\n@GetMapping(\"/pay\")\n@PostMapping(value = \"/buy\")",
        "shop/src/PayDto.java": "x", "shop/.git/config": "x", "shop/build/Old.java": "x", "shop/py/app.py": "class A(Base):\nclass BadError(Exception):\n  class Inner:\n@app.route('/r')\n@api.post(\"/p\")",
        "shop/src/application-dev.yml": "a: b",
    }
    for path, content in files.items():
        f = tmp_path / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(content)
    (tmp_path / "shop/logo.png").write_bytes(b"\x89PNG\xff\xfe")
    (tmp_path / "shop/py/latin.txt").write_bytes(b"caf\xe9")
    (tmp_path / "shop/README.rst").write_bytes(b"caf\xe9")
    df = mining.read_repo_files(spark, str(tmp_path))
    listed = {p.split("/", 1)[1] for p in files} - {".git/config"} | {"logo.png", "py/latin.txt", "README.rst"}  # file listings skip hidden names
    assert {r["path"] for r in df.collect()} == listed
    assert {(r["build_file"]) for r in mining.mine_stack(df).collect()} == {"pom.xml"}
    assert {(r["suffix"], r["n_files"]) for r in mining.language_breakdown(df).collect()} == {(".java", 2), (".py", 1)}
    java = {(r["kind"], tuple(r["names"])) for r in mining.mine_java_symbols(df).collect()}
    assert java == {("services", ("PayService",)), ("enums", ("Kind",))}
    py = {(r["kind"], tuple(r["names"])) for r in mining.mine_python_classes(df).collect()}
    assert py == {("classes", ("A",)), ("exceptions", ("BadError",))}
    assert {(r["verb"], r["route"]) for r in mining.mine_spring_routes(df).collect()} == {("GET", "/pay"), ("POST", "/buy")}
    assert {(r["verb"], r["route"]) for r in mining.mine_python_routes(df).collect()} == {("ANY", "/r"), ("POST", "/p")}
    assert [r["path"] for r in mining.mine_config_files(df).collect()] == ["src/application-dev.yml"]
    assert [(r["path"], r["line_no"]) for r in mining.mine_grep(df, "ENUM").collect()] == [("src/PayService.java", 1)]
    manifest = spark.createDataFrame([("shop", "x")], "name STRING, team STRING")
    row = mining.repo_summary(df, manifest).first()
    assert row["readme_excerpt"] == "read me" and row["n_source_files"] == 3 and row["n_modules"] == 2
    assert (row["n_spring_routes"], row["n_python_routes"]) == (2, 2) and len(row["spring_routes"]) == 2
    assert [(r["top_dir"], r["dto_count"]) for r in row["contracts"]] == [("src", 1)]
    assert not any(r["content"] for r in df.filter("path = 'logo.png'").collect())


def test_stream_state_equals_batch(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    source = fresh_path(spark, "stream")
    events.repartition(4).write.parquet(source)
    out = fresh_path(spark, "state")
    stream = streams.file_stream(spark, events.schema, source, "*.parquet", per_trigger=1)
    streams.stream_ticket_state(stream, out, "user_id", "event_type", ["ts", "event_id"]).awaitTermination()
    live = {(r["user_id"], r["status"], r["n_events"]) for r in streams.read_state(spark, out, "user_id").collect()}
    batch = tickets.last_status(events, "user_id", "event_type", ["ts", "event_id"])
    assert live == {(r["user_id"], r["status"], r["n_events"]) for r in batch.collect()}


def test_stream_dedup(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    source, out = fresh_path(spark, "stream"), fresh_path(spark, "out")
    events.unionByName(events).repartition(3).write.parquet(source)
    streams.stream_event_dedup(streams.file_stream(spark, events.schema, source, "*.parquet"), out, "event_id", "ts", "400 days").awaitTermination()
    assert spark.read.parquet(f"{out}/data").count() == events.count()


def test_stream_triage_rerun_adds_nothing(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Subject: pay fails\n\nbody")
    out = fresh_path(spark, "triage")
    from faultline.operators.extraction import parse_reports

    for _ in range(2):
        streams.stream_triage(streams.report_stream(spark, str(tmp_path)), parse_reports, out).awaitTermination()
    rows = spark.read.parquet(f"{out}/data").collect()
    assert [(r["report_id"], r["title"]) for r in rows] == [("a", "[Payments]: pay fails")]


def test_long_source_files_are_read_whole(spark, tmp_path):
    (tmp_path / "shop").mkdir()
    (tmp_path / "shop/big.py").write_text("#" * 2_500_000 + "\nclass Last(Base):\n")
    df = mining.read_repo_files(spark, str(tmp_path))
    content = df.first()["content"]
    assert len(content) == 2_500_019 and content.endswith("class Last(Base):\n")
    assert [(r["path"], r["line_no"]) for r in mining.mine_grep(df, "class last").collect()] == [("big.py", 2)]
    assert mining.read_repo_files(spark, str(tmp_path), 1000).first()["content"] is None
