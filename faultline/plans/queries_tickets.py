"""Queries for sources, tickets, the event log, drafts and corrections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline import lexicons as lx
from faultline.operators import classify, drafts, mining, quality, routing, textindex, tickets
from faultline.plans import queries_decisions as dec
from faultline.plans import standins as s
from faultline.plans.queries_extraction import BASE, EMAIL, NAME, PARSED, PLATFORM, parsed
from faultline.plans.registry import q, query, sql_case, sql_list, sql_strip, table
from faultline.session import fresh_path, materialise
from faultline.sources import issues as src
from faultline.sources import paged
from faultline.sources import reports as rep
from faultline.sources import tables

NOW = "2024-03-01 12:00:00"


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


# --- scans ------------------------------------------------------------------------------


@query("src_issues", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS updated FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 300")
def src_issues(spark, sf):
    rows = src.recent(table(spark, sf, "orders"), F.col("o_orderstatus") == "F", "o_orderdate", "o_orderkey")
    return rows.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("updated"))


@query("src_training_corpus", f"""SELECT key, component, strftime(created, '%Y-%m-%d') AS created FROM ({s.TICKETS_SQL})
  WHERE component <> 'MACHINERY' AND created >= TIMESTAMP '2001-08-01' - INTERVAL 450 DAYS ORDER BY created DESC, key LIMIT 2000""")
def src_training_corpus(spark, sf):
    labelled = F.col("component") != "MACHINERY"
    rows = src.training_corpus(s.tickets(spark, sf), labelled, "created", "key", F.lit("2001-08-01").cast("timestamp"))
    return rows.select("key", "component", F.date_format("created", "yyyy-MM-dd").alias("created"))


@query("src_paged_search", """SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O' AND (o_orderdate < TIMESTAMP '2000-01-01'
  OR (o_orderdate = TIMESTAMP '2000-01-01' AND o_orderkey > 100)) ORDER BY o_orderdate DESC, o_orderkey LIMIT 200""")
def src_paged_search(spark, sf):
    orders = table(spark, sf, "orders")
    import datetime

    rows = src.paged_search(
        orders, ["o_orderkey", "o_orderpriority", "o_orderdate"], F.col("o_orderstatus") == "O", "o_orderdate", "o_orderkey",
        after=(datetime.datetime(2000, 1, 1), 100),
    )
    return rows.drop("o_orderdate")


@query("src_issue_pages", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_custkey > 20")
def src_issue_pages(spark, sf):
    """All open orders through the paged source, 5,000 rows a page; both filters are pushed."""
    rows = paged.read_pages(spark, f"{sf}/orders.parquet", "o_orderdate", "o_orderkey", page_rows=5000)
    return rows.where("o_orderstatus = 'O' AND o_custkey > 20").select("o_orderkey", "o_custkey", "o_totalprice")


_W = "(^|[^\\p{L}\\p{N}_])"
_E = "($|[^\\p{L}\\p{N}_])"


@query("src_text_search", f"SELECT doc_id, source FROM documents WHERE regexp_matches(lower(text), '{_W}the{_E}') AND regexp_matches(lower(text), '{_W}are{_E}') ORDER BY n_chars DESC, doc_id LIMIT 20")
def src_text_search(spark, sf):
    docs = table(spark, sf, "documents")
    return src.text_search(docs, "text", "the ARE", "n_chars", "doc_id").select("doc_id", "source")


@query("text_search_index", f"""SELECT * FROM (SELECT 'search' AS kind, doc_id, source, 0 AS line_no FROM documents WHERE regexp_matches(lower(text), '{_W}the{_E}') AND regexp_matches(lower(text), '{_W}released{_E}') ORDER BY n_chars DESC, doc_id LIMIT 20)
  UNION ALL SELECT 'grep', doc_id, source, line_no FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, line_no) AS n FROM (SELECT *, row_number() OVER (PARTITION BY source, doc_id ORDER BY line_no) AS i FROM
   (SELECT doc_id, source, generate_subscripts(ls, 1)::INT AS line_no, unnest(ls) AS line FROM (SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents)) WHERE contains(lower(line), 'released under')) WHERE i <= 5) WHERE n <= 20""")
def text_search_index(spark, sf):
    """A search by words and one for a phrase, both through a saved trigram index."""
    path = fresh_path(spark, "trigrams")
    textindex.build_index(table(spark, sf, "documents").withColumnRenamed("doc_id", "id"), "text", path)
    some = textindex.find_texts(spark, path, ["the", "Released"])
    searched = src.text_search(some, "text", "the Released", "n_chars", "id")
    files = textindex.find_texts(spark, path, ["Released under"])
    lines = mining.mine_grep(files.select(F.col("source").alias("repo"), F.format_string("%020d", "id").alias("path"), F.col("text").alias("content")), "Released under")
    lines = lines.select(F.lit("grep").alias("kind"), F.col("path").cast("bigint").alias("doc_id"), F.col("repo").alias("source"), "line_no")
    return searched.select(F.lit("search").alias("kind"), F.col("id").alias("doc_id"), "source", F.lit(0).alias("line_no")).unionByName(lines)


@query("src_issue_by_key", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT doc_id FROM documents)")
def src_issue_by_key(spark, sf):
    keys = table(spark, sf, "documents").select(F.col("doc_id").alias("o_orderkey"))
    return src.by_keys(table(spark, sf, "orders"), keys, "o_orderkey").select("o_orderkey", "o_orderstatus")


@query("issue_fields", """SELECT o_orderkey AS key, CASE WHEN o_orderkey % 3 = 0 THEN c_name WHEN o_orderkey % 3 = 1 THEN concat('u', c_custkey, '@mail.example.com') END AS assignee,
  CASE WHEN o_orderstatus = 'P' THEN 'Unknown' ELSE o_orderpriority END AS priority, CASE WHEN o_orderstatus <> 'O' THEN c_mktsegment END AS component,
  strftime(o_orderdate, '%Y-%m-%d') AS created FROM orders JOIN customer ON o_custkey = c_custkey""")
def issue_fields(spark, sf):
    j = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("o_orderkey") % 3
    name = F.struct(F.col("c_mktsegment").alias("name"))
    nested = j.select(
        F.col("o_orderkey").alias("key"),
        F.struct(
            F.struct(
                F.when(k == 0, F.col("c_name")).when(k == 1, "").alias("displayName"),
                F.when(k == 1, F.concat(F.lit("u"), F.col("c_custkey").cast("string"), F.lit("@mail.example.com"))).alias("emailAddress"),
            ).alias("assignee"),
            F.when(F.col("o_orderstatus") != "P", F.struct(F.col("o_orderpriority").alias("name"))).alias("priority"),
            F.when(F.col("o_orderstatus") != "O", F.array(name)).otherwise(F.slice(F.array(name), 1, 0)).alias("components"),
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("created"),
        ).alias("fields"),
    )
    return src.issue_fields(nested)


@query("src_report_files", "SELECT text || chr(10) AS raw_text, 0 AS n_attachments FROM benchmark")
def src_report_files(spark, sf):
    # One text file per benchmark row, written first, then found and read whole.
    path = fresh_path(spark, "reports")
    table(spark, sf, "benchmark").repartition("item_id").write.partitionBy("item_id").text(path)
    found = rep.report_files(spark, path)
    return found.select("raw_text", F.size("attachments").alias("n_attachments"))


_MEDIA = "SELECT page_id, concat('case', page_id % 40, '/', page_id, CASE page_id % 5 WHEN 0 THEN '.PNG' WHEN 1 THEN '.mov' WHEN 2 THEN '.txt' WHEN 3 THEN '.jpeg' ELSE '' END) AS path, html FROM pages"


@query("src_attachments", f"""SELECT page_id, kind, 'case' || (page_id % 40) AS label, octet_length(encode(coalesce(html, ''))) AS n_bytes FROM (SELECT *, CASE WHEN sx IN ({sql_list(lx.IMAGE_SUFFIXES)}) THEN 'image'
  WHEN sx IN ({sql_list(lx.VIDEO_SUFFIXES)}) THEN 'video' END AS kind FROM (SELECT *, lower(regexp_extract(path, '\\.[^./]+$', 0)) AS sx FROM ({_MEDIA}))) WHERE kind IS NOT NULL""")
def src_attachments(spark, sf):
    """Every page as a file of a report's folder, written, then found among the others."""
    s.views(spark, sf, "pages")
    folder = fresh_path(spark, "cases")
    rep.write_files(spark.sql(_MEDIA).select("path", F.encode("html", "UTF-8").alias("content")).repartition(8), folder)
    number = F.regexp_extract("path", r"/(\d+)\.[^/]*$", 1).cast("bigint")
    return rep.attachments(spark, folder).select(number.alias("page_id"), "kind", "label", F.col("length").alias("n_bytes"))


@query("src_repo_manifest", "SELECT n_name AS team, s_name AS name, CAST(row_number() OVER (PARTITION BY n_name ORDER BY s_name) AS INT) AS place FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def src_repo_manifest(spark, sf):
    # One manifest per nation, written as JSON and read back.
    j = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    path = fresh_path(spark, "manifest")
    entry = F.struct(F.col("s_name").alias("name"), F.col("n_name").alias("team"))
    j.groupBy("n_name").agg(F.collect_list(entry).alias("repos")).write.partitionBy("n_name").json(path)
    return tables.repos_by_team(tables.read_manifest(spark, path).select("team", "name"))


# --- corrections --------------------------------------------------------------------------

# Documents whose label says otherwise: the language is the corrected component.
_CORR = """SELECT concat('2024-01-', lpad(CAST(1 + doc_id % 28 AS STRING), 2, '0')) AS timestamp, substr(md5(lang || CAST(doc_id % 50 AS STRING)), 1, 12) AS bug_hash, source AS predicted_component,
  CASE WHEN doc_id % 9 = 0 THEN ' ' ELSE lang END AS corrected_component, '0.5' AS confidence_at_prediction,
  CASE WHEN doc_id % 4 = 0 THEN '' ELSE concat(' ', source, ' title') END AS title, text AS bug_text, doc_id FROM documents"""


def _corrections(spark, sf) -> DataFrame:
    s.views(spark, sf, "documents")
    return spark.sql(_CORR)


_AS_ISSUES = f"""SELECT 'CORRECTION-' || bug_hash AS key, coalesce(nullif(trim(title), ''), substr(split_part({sql_strip('bug_text')}, chr(10), 1), 1, 120)) AS summary,
  {sql_strip('bug_text')} AS description, trim(corrected_component) AS component, NULL::VARCHAR AS assignee, 'Unknown' AS priority, timestamp AS created
  FROM ({_CORR}) WHERE trim(corrected_component) <> '' AND {sql_strip('bug_text')} <> ''"""


@query("src_corrections", _AS_ISSUES)
def src_corrections(spark, sf):
    return tables.corrections_as_issues(_corrections(spark, sf))


@query("union_training", f"""SELECT key, component, assignee, description FROM ({_AS_ISSUES}) UNION ALL SELECT key, component, assignee, NULL FROM ({s.TICKETS_SQL})""")
def union_training(spark, sf):
    issues = s.tickets(spark, sf).select("key", "component", "assignee")
    fixed = tables.corrections_as_issues(_corrections(spark, sf)).select("key", "component", "assignee", "description")
    return tickets.union_training(issues, fixed)


@query("corrections_latest", f"""SELECT bug_hash, timestamp, corrected_component FROM (SELECT *, row_number() OVER (PARTITION BY bug_hash ORDER BY timestamp DESC, corrected_component DESC) AS p FROM ({_CORR})) WHERE p = 1""")
def corrections_latest(spark, sf):
    return tickets.corrections_latest(_corrections(spark, sf)).select("bug_hash", "timestamp", "corrected_component")


_REVIEWS = """SELECT doc_id, concat('2024-01-', lpad(CAST(1 + doc_id % 28 AS STRING), 2, '0')) AS timestamp, source AS predicted_component,
  CASE WHEN doc_id % 5 = 0 THEN 'bugs' WHEN doc_id % 2 = 0 THEN source ELSE lang END AS edited_component, doc_id % 8 / 8.0 AS confidence,
  source AS title, text AS description, lang AS actual_result FROM documents"""


@query("sink_corrections", f"""SELECT timestamp, substr(md5(concat_ws(chr(10) || chr(10), title, description, actual_result)), 1, 12) AS bug_hash, predicted_component,
  edited_component AS corrected_component, printf('%.3f', confidence::DOUBLE) AS confidence_at_prediction FROM ({_REVIEWS}) WHERE edited_component <> predicted_component AND edited_component <> 'bugs'""")
def sink_corrections(spark, sf):
    s.views(spark, sf, "documents")
    rows = spark.sql(_REVIEWS).withColumn("confidence", F.col("confidence").cast("double"))
    path = fresh_path(spark, "corrections")
    tables.append_corrections(tables.correction_rows(rows), path)
    return tables.read_corrections(spark, path).drop("title", "bug_text")


# --- tickets ------------------------------------------------------------------------------


@query("next_key", f"SELECT 'TKT-' || (max(o_orderkey) + 1) AS next_key FROM orders")
def next_key(spark, sf):
    # Statuses stand among the keys as malformed ones.
    keys = s.tickets(spark, sf).select("key").unionByName(s.tickets(spark, sf).select(F.col("status").alias("key")))
    return tickets.next_key(keys)


@query("ticket_count", "SELECT count(*) AS n FROM orders")
def ticket_count(spark, sf):
    return s.tickets(spark, sf).agg(F.count("*").alias("n"))


@query("tickets_newest_first", "SELECT concat('TKT-', o_orderkey) AS key, strftime(o_orderdate, '%Y-%m-%d') AS created FROM orders")
def tickets_newest_first(spark, sf):
    rows = tickets.tickets_newest_first(s.tickets(spark, sf))
    return rows.select("key", F.date_format("created", "yyyy-MM-dd").alias("created"))


_DRAFTS = """SELECT doc_id AS report_id, substr(concat(source, ' ', text), 1, 600) AS summary, text AS description, CASE WHEN lang = 'es' THEN '' ELSE source END AS component,
  concat('P', CAST(doc_id % 4 AS STRING)) AS priority, '' AS assignee, lang AS reporter, '' AS duplicate_of FROM documents"""


def _inserted(spark, sf):
    s.views(spark, sf, "documents")
    rows = spark.sql(_DRAFTS).withColumn("media_paths", F.lit(None).cast("array<string>"))
    return tickets.insert_tickets(rows, s.tickets(spark, sf), _now())


_INSERTED = f"""SELECT report_id, 'TKT-' || ((SELECT max(o_orderkey) FROM orders) + row_number() OVER (ORDER BY substr(md5(CAST(report_id AS VARCHAR)), 1, 3), report_id)) AS key,
  substr(summary, 1, 500) AS summary, 'Open' AS status, nullif(component, '') AS component, priority, nullif(assignee, '') AS assignee, reporter, '{NOW}' AS created FROM ({_DRAFTS})"""


@query("insert_tickets", _INSERTED)
def insert_tickets(spark, sf):
    new, _ = _inserted(spark, sf)
    return new.select(
        "report_id", "key", "summary", "status", "component", "priority", "assignee", "reporter",
        F.date_format("created", "yyyy-MM-dd HH:mm:ss").alias("created"),
    )


@query("insert_events", f"SELECT key, 'INSERT' AS event, summary, status, coalesce(component, '') AS component FROM ({_INSERTED})")
def insert_events(spark, sf):
    _, events = _inserted(spark, sf)
    return events.select("key", "event", *[F.get_json_object("payload", f"$.{c}").alias(c) for c in ("summary", "status", "component")])


# One wanted change per customer: some keys unknown, some statuses invalid.
_CHANGES = """SELECT concat(CASE WHEN c_custkey % 10 = 9 THEN 'TKT-X' ELSE 'TKT-' END, CAST(c_custkey AS STRING)) AS key,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Done' WHEN 'BUILDING' THEN 'Closed' WHEN 'FURNITURE' THEN 'In Progress' WHEN 'HOUSEHOLD' THEN 'Reopened' ELSE 'Open' END AS "to" FROM customer"""
_JUDGED = f"""SELECT c.key, c."to", CASE WHEN c."to" NOT IN ({sql_list(lx.STATUSES)}) THEN 'invalid status' WHEN t.key IS NULL THEN 'unknown key' END AS reject_reason
  FROM ({_CHANGES}) c LEFT JOIN ({s.TICKETS_SQL}) t USING (key)"""


def _changes(spark, sf) -> DataFrame:
    s.views(spark, sf, "customer")
    return spark.sql(_CHANGES.replace('"to"', "`to`"))


def _ticket_rows(spark, sf) -> DataFrame:
    rows = s.tickets(spark, sf).select("key", "status", F.col("created").cast("timestamp_ntz").alias("created"))
    return rows.withColumn("updated", F.col("created"))


@query("status_domain_check", _JUDGED)
def status_domain_check(spark, sf):
    return quality.status_domain_check(_changes(spark, sf), _ticket_rows(spark, sf))


@query("update_status", f"""SELECT t.key, coalesce(j."to", t.status) AS status, CASE WHEN j."to" IS NOT NULL THEN '{NOW}' ELSE strftime(created, '%Y-%m-%d %H:%M:%S') END AS updated
  FROM ({s.TICKETS_SQL}) t LEFT JOIN (SELECT * FROM ({_JUDGED}) WHERE reject_reason IS NULL) j USING (key)""")
def update_status(spark, sf):
    updated, _, _ = tickets.update_status(_ticket_rows(spark, sf), _changes(spark, sf), _now())
    return updated.select("key", "status", F.date_format("updated", "yyyy-MM-dd HH:mm:ss").alias("updated"))


@query("status_update_events", f"""SELECT key, t.status AS from_status, j."to" AS to_status FROM ({s.TICKETS_SQL}) t JOIN (SELECT * FROM ({_JUDGED}) WHERE reject_reason IS NULL) j USING (key)""")
def status_update_events(spark, sf):
    _, events, _ = tickets.update_status(_ticket_rows(spark, sf), _changes(spark, sf), _now())
    return events.select(
        "key", F.get_json_object("payload", "$.from").alias("from_status"), F.get_json_object("payload", "$.to").alias("to_status")
    )


@query("delete_tickets", f"SELECT key, status FROM ({s.TICKETS_SQL}) WHERE key NOT IN (SELECT concat('TKT-', c_custkey) FROM customer)")
def delete_tickets(spark, sf):
    gone = table(spark, sf, "customer").select(F.concat(F.lit("TKT-"), F.col("c_custkey").cast("string")).alias("key"))
    kept, _ = tickets.delete_tickets(_ticket_rows(spark, sf), gone, _now())
    return kept.select("key", "status")


_REPLAYED = f"""SELECT key, json_extract_string(ins.payload, '$.summary') AS summary, st.status, json_extract_string(ins.payload, '$.priority') AS priority
  FROM (SELECT * FROM (SELECT key, event, row_number() OVER (PARTITION BY key ORDER BY timestamp DESC, seq DESC) AS p FROM log) WHERE p = 1 AND event <> 'DELETE') last
  JOIN (SELECT key, arg_max(payload, (timestamp, seq)) AS payload FROM log WHERE event = 'INSERT' GROUP BY key) ins USING (key)
  JOIN (SELECT key, arg_max(CASE event WHEN 'INSERT' THEN json_extract_string(payload, '$.status') ELSE json_extract_string(payload, '$.to') END, (timestamp, seq)) AS status
    FROM log WHERE event <> 'DELETE' GROUP BY key) st USING (key)"""


@query("replay_state", f"WITH log AS ({s.LOG_SQL}) {_REPLAYED}")
def replay_state(spark, sf):
    return tickets.replay_state(s.ticket_log(spark, sf)).select("key", "summary", "status", "priority")


@query("replay_log", f"WITH log AS ({s.LOG_SQL}) {_REPLAYED}")
def replay_log(spark, sf):
    """The log appended in four batches out of order; a snapshot after two of them, the rest replayed."""
    path, log = fresh_path(spark, "log"), s.ticket_log(spark, sf)
    for k in range(4):
        tickets.append_log(log.where(F.pmod(F.xxhash64("seq"), F.lit(4)) == k), path)
        if k == 1:
            tickets.snapshot_log(spark, path)
    return tickets.replay_log(spark, path).select("key", "summary", "status", "priority")


@query("last_status", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, count(*) AS n_events FROM events GROUP BY user_id")
def last_status(spark, sf):
    return tickets.last_status(table(spark, sf, "events"), "user_id", "event_type", ["ts", "event_id"]).drop("updated")


@query("event_order_state", """SELECT event_id, user_id, lag(event_type) OVER w AS previous_status, epoch_us(lead(ts) OVER w) - epoch_us(ts) AS micros_in_status
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def event_order_state(spark, sf):
    rows = tickets.event_order_state(table(spark, sf, "events"), "user_id", "event_type", "ts", "event_id", chunk="hour")
    return rows.select("event_id", "user_id", "previous_status", "micros_in_status")


@query("add_missing_column", f"SELECT key, NULL::VARCHAR AS reporter FROM ({s.TICKETS_SQL})")
def add_missing_column(spark, sf):
    return tickets.add_missing_column(s.tickets(spark, sf), "reporter", "string").select("key", "reporter")


@query("backfill_missing", """SELECT doc_id AS key, 64 AS dim, vec_id IS NULL AS filled, round(coalesce(embedding[1]::DOUBLE, 0.0), 6) AS first_kept, 1.0::DOUBLE AS norm
  FROM documents LEFT JOIN embeddings ON vec_id = doc_id""")
def backfill_missing(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("key"), F.col("source").alias("summary"), F.col("text").alias("description"))
    vec = s.index(spark, sf).select("key", F.col("vec"))
    encoder = classify.fit_encoder(docs.select(F.col("description").alias("text")), 64)
    rows = tickets.backfill_missing(docs.join(vec, "key", "left"), lambda d: classify.embed_text(d, encoder))
    known = vec.select("key", F.lit(False).alias("filled"))
    length = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    filled = F.coalesce("filled", F.lit(True))
    first = F.when(filled, 0.0).otherwise(F.round(F.col("vec")[0].cast("double"), 6))
    return rows.join(known, "key", "left").select(
        "key", F.size("vec").alias("dim"), filled.alias("filled"), first.alias("first_kept"), F.round(F.sqrt(length), 4).alias("norm")
    )


# --- sinks --------------------------------------------------------------------------------


@query("sink_index", "SELECT vec_id AS key, label, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings")
def sink_index(spark, sf):
    path = fresh_path(spark, "index")
    tables.write_index(s.index(spark, sf), path)
    return spark.read.parquet(path).select("key", "label", F.round(F.get("vec", F.lit(0)).cast("double"), 6).alias("first"))


@query("sink_event_log", f"WITH log AS ({s.LOG_SQL}) SELECT seq, event, key, payload FROM log")
def sink_event_log(spark, sf):
    path = fresh_path(spark, "events")
    log = s.ticket_log(spark, sf).select(F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "seq", "event", "key", "payload")
    tables.append_events(log.filter(F.col("event") == "INSERT"), path)
    tables.append_events(log.filter(F.col("event") != "INSERT"), path)
    return tables.read_events(spark, path).select("seq", "event", "key", "payload")


@query("sink_snapshot", f"SELECT key, component, assignee, key || ';' || status AS media_paths FROM ({s.TICKETS_SQL})")
def sink_snapshot(spark, sf):
    path = fresh_path(spark, "snapshot")
    rows = s.tickets(spark, sf).select("key", "component", "assignee", F.array("key", "status").alias("media_paths"))
    tables.write_snapshot(rows, path)
    return spark.read.option("header", "true").csv(path)


# --- drafts -------------------------------------------------------------------------------

_DIM = "SELECT n_name AS component, concat('1', n_nationkey) AS component_id, r_name AS team FROM nation JOIN region ON n_regionkey = r_regionkey"


def _dim(spark, sf) -> DataFrame:
    s.views(spark, sf, "nation", "region")
    return spark.sql("SELECT n_name AS component, concat('1', CAST(n_nationkey AS STRING)) AS component_id, r_name AS team FROM nation JOIN region ON n_regionkey = r_regionkey")


_HINTS = "SELECT doc_id AS report_id, concat('NATION_', CAST(doc_id % 30 AS STRING)) AS component_hint FROM documents"


@query("component_dim", f"""SELECT report_id, component_hint, d.component, component_id, coalesce(team, 'bugs') AS team FROM ({_HINTS}) h LEFT JOIN ({_DIM}) d ON d.component = component_hint""")
def component_dim(spark, sf):
    s.views(spark, sf, "documents")
    return drafts.component_dim(spark.sql(_HINTS), _dim(spark, sf))


@query("component_by_keyword", """SELECT part_key, CASE WHEN contains(lower(t), 'steel') THEN 'Backend' WHEN contains(lower(t), 'small') THEN 'UI' END AS component
  FROM (SELECT p_partkey AS part_key, p_type AS t FROM part)""")
def component_by_keyword(spark, sf):
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("part_key"), drafts.component_by_keyword(F.col("p_type"), {"steel": "Backend", "small": "UI"}).alias("component")
    )


_TEAM = "CASE doc_id % 3 WHEN 0 THEN 'BE_Core' WHEN 1 THEN 'bugs' ELSE '' END"


@query("draft_labels", f"""{BASE} SELECT report_id, array_to_string(list_filter(['triage', CASE WHEN team NOT IN ('', 'bugs') THEN replace(lower(team), '_', '-') END,
  CASE WHEN contains(lower(p), 'android') THEN 'android' END, CASE WHEN contains(lower(p), 'ios') THEN 'ios' END], lambda l: l IS NOT NULL), ',') AS labels,
  array_to_string(list_filter(['triage', CASE WHEN lower(p) = 'android' THEN 'android' WHEN lower(p) = 'ios' THEN 'ios' END], lambda l: l IS NOT NULL), ',') AS strict_labels
  FROM (SELECT report_id, {PLATFORM} AS p, {_TEAM.replace('doc_id', 'report_id')} AS team FROM r)""")
def draft_labels(spark, sf):
    rows = parsed(spark, sf).select("report_id", "platform", F.expr(_TEAM.replace("doc_id", "report_id")).alias("team"))
    return rows.select(
        "report_id",
        F.array_join(drafts.draft_labels(F.col("platform"), F.col("team")), ",").alias("labels"),
        F.array_join(drafts.draft_labels(F.col("platform"), F.col("team"), strict=True), ",").alias("strict_labels"),
    )


@query("reporter_display", f"""{BASE} SELECT report_id, CASE WHEN n <> '' AND e <> '' THEN n || ' <' || e || '>' WHEN n <> '' THEN n ELSE e END AS reporter
  FROM (SELECT report_id, trim(coalesce({NAME}, '')) AS n, trim(coalesce({EMAIL}, '')) AS e FROM r)""")
def reporter_display(spark, sf):
    return parsed(spark, sf).select("report_id", drafts.reporter_display(F.col("reporter_name"), F.col("reporter_email")).alias("reporter"))


def _drafts(spark, sf) -> DataFrame:
    p = parsed(spark, sf).withColumn("component_hint", F.concat(F.lit("NATION_"), (F.col("report_id") % 30).cast("string")))
    p = materialise(p, "parsed")
    m = materialise(dec.summarised_matches(spark, sf), "matches")
    from faultline.operators.priority import score_priority

    dups = m.filter(F.col("rank") == 1).select(
        "query_id", F.when(F.col("similarity") >= 0.38, F.col("key")).alias("duplicate_of"), F.round("similarity", 3).alias("duplicate_confidence"))
    owners = routing.owner_frequency(m, p.select(F.col("report_id").alias("query_id")))
    return drafts.build_drafts(p, score_priority(p, m), m, owners, dups, _dim(spark, sf))


_DRAFTED = f"""{dec.SCORED}, own AS (SELECT query_id, assignee, count(*) AS n, min(rank) AS fr FROM matches WHERE coalesce(assignee, '') <> '' GROUP BY 1, 2),
 owner AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, fr) AS p FROM own) WHERE p = 1),
 cnt AS (SELECT query_id, count(*) AS n_similar, string_agg(CAST(key AS VARCHAR), ',' ORDER BY rank) AS similar_keys FROM matches GROUP BY query_id),
 drafted AS (SELECT p.report_id, p.title, sc1.priority, sc1.scoring_path, d.component, coalesce(d.team, 'bugs') AS team, o.assignee AS owner, CASE WHEN m.similarity >= 0.38 THEN CAST(m.key AS VARCHAR) END AS duplicate_of,
   coalesce(c.n_similar, 0) AS n_similar, c.similar_keys, p.platform, p.steps, p.reporter_name, p.reporter_email, p.description
   FROM parsed p JOIN sc1 USING (report_id) LEFT JOIN ({_DIM}) d ON d.component = 'NATION_' || (p.report_id % 30) LEFT JOIN owner o ON o.query_id = p.report_id
   LEFT JOIN cnt c ON c.query_id = p.report_id LEFT JOIN (SELECT * FROM matches WHERE rank = 1) m ON m.query_id = p.report_id)"""


@query("build_drafts", f"""{_DRAFTED} SELECT report_id, title AS summary, {sql_case('priority', lx.PRIORITY_ID)} AS priority_id, scoring_path, component, team, owner, duplicate_of, similar_keys,
  array_to_string(list_filter(['triage', CASE WHEN team <> 'bugs' THEN replace(lower(team), '_', '-') END, CASE WHEN contains(lower(platform), 'android') THEN 'android' END,
    CASE WHEN contains(lower(platform), 'ios') THEN 'ios' END], lambda l: l IS NOT NULL), ',') AS labels FROM drafted""")
def build_drafts(spark, sf):
    d = _drafts(spark, sf)
    keys = F.transform("triage_notes.similar_bugs", lambda m: m["key"])
    return d.select(
        "report_id", "fields.summary", F.col("fields.priority.id").alias("priority_id"),
        F.col("triage_notes.priority_scoring_path").alias("scoring_path"), F.get("fields.components", F.lit(0))["name"].alias("component"),
        "triage_notes.team", F.col("fields.suggested_assignee").alias("owner"), F.col("fields.duplicate_candidate").alias("duplicate_of"),
        F.array_join(keys, ",").alias("similar_keys"), F.array_join("fields.labels", ",").alias("labels"),
    )


@query("draft_document", f"""{_DRAFTED} SELECT report_id, 'doc' AS type, 14 + CASE WHEN n_similar > 0 THEN 2 + (duplicate_of IS NOT NULL)::INT ELSE 0 END
    + CASE WHEN reporter_name IS NOT NULL OR reporter_email IS NOT NULL THEN 2 ELSE 0 END AS sections, description, greatest(1, len(steps))::INT AS n_steps FROM drafted""")
def draft_document(spark, sf):
    d = _drafts(spark, sf).select("report_id", F.col("fields.description").alias("doc"))
    return d.select(
        "report_id",
        F.get_json_object("doc", "$.type").alias("type"),
        F.json_array_length(F.get_json_object("doc", "$.content")).alias("sections"),
        F.get_json_object("doc", "$.content[2].content[0].text").alias("description"),
        F.json_array_length(F.get_json_object("doc", "$.content[6].content")).alias("n_steps"),
    )


@query("sink_drafts", f"""{_DRAFTED} SELECT report_id, title AS display_summary, {sql_case('priority', lx.PRIORITY_ID)} AS priority_id, scoring_path, team, coalesce(component, 'unclassified (needs manual routing)') AS component,
  owner, duplicate_of, similar_keys FROM drafted""")
def sink_drafts(spark, sf):
    path = fresh_path(spark, "drafts")
    tables.write_drafts(_drafts(spark, sf), path, _now())
    schema = """report_id BIGINT, display_summary STRING, fields STRUCT<priority: STRUCT<id: STRING>>, triage_notes STRUCT<priority_scoring_path: STRING,
      team: STRING, component: STRING, owner_suggestion: STRING, duplicate_of: STRING, similar_bugs: ARRAY<STRUCT<key: STRING>>>, run_date DATE"""
    back = spark.read.schema(schema).json(path)
    n = "triage_notes"
    return back.select(
        "report_id", "display_summary", F.col("fields.priority.id").alias("priority_id"), F.col(f"{n}.priority_scoring_path").alias("scoring_path"),
        f"{n}.team", f"{n}.component", F.col(f"{n}.owner_suggestion").alias("owner"), f"{n}.duplicate_of",
        F.array_join(F.transform(f"{n}.similar_bugs", lambda m: m["key"]), ",").alias("similar_keys"),
    )


@query("similar_report_rows", f"""WITH {s.PAIRS_CTE.format(k=5)} SELECT query_id, CAST(rank AS INT) AS rank, key, CASE WHEN starts_with(key, 'TKT-') THEN 'local' ELSE 'external' END AS origin,
  similarity, assignee, priority FROM (SELECT query_id, rank, CASE WHEN nn.key % 2 = 0 THEN 'TKT-' || nn.key ELSE 'ISS-' || nn.key END AS key, round(similarity, 3) AS similarity,
  coalesce(CASE WHEN component <> 'BUILDING' THEN assignee END, '(unassigned)') AS assignee, priority FROM nn JOIN ({s.ATTRIBUTES_SQL}) t ON t.key = nn.key)""")
def similar_report_rows(spark, sf):
    m = s.vector_matches(spark, sf, 5)
    prefix = F.when(F.col("key") % 2 == 0, "TKT-").otherwise("ISS-")
    named = m.withColumns({
        "key": F.concat(prefix, F.col("key").cast("string")),
        "assignee": F.when(F.col("component") != "BUILDING", F.col("assignee")),
    })
    return drafts.similar_report_rows(named)


@query("path_signals", """SELECT doc_id, CASE WHEN contains(p, ':') THEN trim(substr(p, instr(p, ':') + 1)) ELSE p END AS signals
  FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN concat('L1-keyword: ', source, ': x') ELSE 'L1-vague' END AS p FROM documents)""")
def path_signals(spark, sf):
    p = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("L1-keyword: "), "source", F.lit(": x"))).otherwise("L1-vague")
    return table(spark, sf, "documents").select("doc_id", drafts.path_signals(p).alias("signals"))


_EDITS = """SELECT doc_id AS report_id, source AS predicted_component, CASE WHEN doc_id % 3 = 0 THEN lang ELSE source END AS edited_component, lang AS predicted_owner,
  CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'someone' ELSE lang END AS edited_owner FROM documents"""


@query("override_audit", f"""SELECT report_id, CASE WHEN predicted_component IS DISTINCT FROM edited_component THEN predicted_component || '>' || edited_component END AS component_change,
  CASE WHEN predicted_owner IS DISTINCT FROM edited_owner THEN predicted_owner || '>' || coalesce(edited_owner, '-') END AS owner_change FROM ({_EDITS})""")
def override_audit(spark, sf):
    s.views(spark, sf, "documents")
    audit = drafts.override_audit(spark.sql(_EDITS), ["component", "owner"])

    def change(name):
        m = F.try_element_at("human_overrides", F.lit(name))
        return F.when(m.isNotNull(), F.concat(m["from"], F.lit(">"), F.coalesce(m["to"], F.lit("-")))).alias(f"{name}_change")

    return audit.select("report_id", change("component"), change("owner"))


_PREDICTED = "SELECT doc_id AS report_id, concat('NATION_', CAST(doc_id % 25 AS STRING)) AS component, concat('P', CAST(doc_id % 4 AS STRING)) AS priority, source AS owner FROM documents"
_OVERRIDES = "SELECT doc_id AS report_id, CASE WHEN quality = 1 THEN 'NATION_3' ELSE 'bugs' END AS component, CASE WHEN toxic = 1 THEN 'P0' END AS priority, CAST(NULL AS STRING) AS owner FROM labels"


@query("apply_overrides", f"""SELECT report_id, CASE WHEN c <> 'bugs' THEN c END AS component, component_id, coalesce(team, 'bugs') AS team, priority,
  {sql_case('priority', lx.PRIORITY_ID)} AS priority_id, {sql_case('priority', lx.SEVERITY)} AS severity, owner, edited
  FROM (SELECT p.report_id, coalesce(o.component, p.component) AS c, coalesce(o.priority, p.priority) AS priority, coalesce(o.owner, p.owner) AS owner, o.component IS NOT NULL OR o.priority IS NOT NULL AS edited
    FROM ({_PREDICTED}) p LEFT JOIN ({_OVERRIDES}) o USING (report_id)) x LEFT JOIN ({_DIM}) d ON d.component = x.c""")
def apply_overrides(spark, sf):
    s.views(spark, sf, "documents", "labels")
    return drafts.apply_overrides(spark.sql(_PREDICTED), spark.sql(_OVERRIDES), _dim(spark, sf))


# --- media findings: turns of a conversation stand for attachments --------------------------

_FINDINGS = """SELECT conv_id AS report_id, turn AS seq, CASE role WHEN 'user' THEN 'image' ELSE 'video' END AS kind, concat('/m/', CAST(conv_id AS STRING), '/', role, CAST(turn % 3 AS STRING), '.mp4') AS path,
  text AS one_line_summary, concat('s', CAST(turn % 2 AS STRING)) AS screen, CASE WHEN turn % 3 = 0 THEN '' ELSE concat('not ', role, CAST(turn AS STRING)) END AS contradiction,
  length(text) / 10.0 AS duration_seconds, turn % 4 AS frame_count FROM conversations"""


def _findings(spark, sf) -> DataFrame:
    s.views(spark, sf, "conversations")
    return spark.sql(_FINDINGS)


@query("findings_rollup", f"""SELECT report_id, string_agg(CASE WHEN kind = 'video' THEN concat('[Video ', regexp_extract(path, '[^/]+$', 0), '] ', one_line_summary) ELSE {sql_strip('one_line_summary')} END,
  ' ' ORDER BY kind, seq) AS combined_summary FROM ({_FINDINGS}) WHERE one_line_summary <> '' GROUP BY report_id""")
def findings_rollup(spark, sf):
    return drafts.findings_rollup(_findings(spark, sf), chunk=4)


@query("with_media_summary", f"""WITH f AS (SELECT report_id, string_agg(CASE WHEN kind = 'video' THEN concat('[Video ', regexp_extract(path, '[^/]+$', 0), '] ', one_line_summary) ELSE {sql_strip('one_line_summary')} END,
  ' ' ORDER BY kind, seq) AS cs FROM ({_FINDINGS}) WHERE one_line_summary <> '' GROUP BY report_id)
  SELECT doc_id AS report_id, CASE WHEN coalesce(cs, '') <> '' THEN concat('[From attached media]', chr(10), {sql_strip('cs')}, chr(10), chr(10), '[Text]', chr(10), {sql_strip('text')}) ELSE {sql_strip('text')} END AS raw_text
  FROM documents LEFT JOIN f ON report_id = doc_id""")
def with_media_summary(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("report_id"), F.col("text").alias("raw_text"))
    return drafts.with_media_summary(docs, drafts.findings_rollup(_findings(spark, sf)))


@query("gate_media_contradiction", f"""SELECT report_id, image, screen, concat('File ', image, ' (screen ', screen, ') disagrees with the text: ', contradiction) AS message
  FROM (SELECT report_id, regexp_extract(path, '[^/]+$', 0) AS image, screen, arg_min(contradiction, seq) AS contradiction FROM ({_FINDINGS}) WHERE contradiction <> '' GROUP BY 1, 2, 3)""")
def gate_media_contradiction(spark, sf):
    return quality.gate_media_contradiction(_findings(spark, sf)).select("report_id", "image", "screen", "message")


@query("reject_long_media", f"""SELECT report_id, seq, CASE WHEN d > 60 THEN 'rejected' WHEN frame_count = 0 THEN 'error' ELSE 'accepted' END AS state
  FROM (SELECT *, duration_seconds::DOUBLE AS d FROM ({_FINDINGS}))""")
def reject_long_media(spark, sf):
    rows = _findings(spark, sf).withColumn("duration_seconds", F.col("duration_seconds").cast("double"))
    return quality.reject_long_media(rows).select("report_id", "seq", "state")


@query("seconds_of", """SELECT event_id, event_id % 3 * 3600.0::DOUBLE + event_id % 60 * 60 + event_id % 59 + 0.5 AS seconds FROM events""")
def seconds_of(spark, sf):
    from faultline.functions.text import seconds_of as parse

    e = F.col("event_id")
    log = F.format_string("x Duration: %02d:%02d:%02d.50, start", e % 3, e % 60, e % 59)
    return table(spark, sf, "events").select("event_id", parse(log).alias("seconds"))
