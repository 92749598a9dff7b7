"""Queries for source-tree mining and for streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline import lexicons as lx
from faultline.operators import extraction, mining
from faultline.plans import standins as s
from faultline.plans.queries_extraction import PARSED
from faultline.plans.registry import q, query, sql_case, sql_list, table
from faultline.session import fresh_path
from faultline.streaming import streams

_NAME = "regexp_extract(path, '[^/]+$', 0)"
_SUFFIX = f"lower(regexp_extract({_NAME}, '[^.](\\.[^.]+)$', 1))"
_TOP = "CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) END"
_VISIBLE = f"len(list_filter(string_split(path, '/'), lambda p: starts_with(p, '.') OR p IN ({sql_list(lx.IGNORED_DIRS)}))) = 0"
F_CTE = f"files AS ({s.FILES_SQL}), vis AS (SELECT *, {_SUFFIX} AS suffix, {_TOP} AS top_dir FROM files WHERE {_VISIBLE})"
_SOURCE = f"suffix IN ({sql_list(lx.SOURCE_SUFFIXES)})"


def _files(spark, sf) -> DataFrame:
    return s.repo_files(spark, sf).select("repo", "path", "content")


@query("mine_stack", f"WITH {F_CTE} SELECT repo, path AS build_file, {sql_case('path', lx.BUILD_FILES)} AS stack FROM files WHERE path IN ({sql_list(list(lx.BUILD_FILES))})")
def mine_stack(spark, sf):
    return mining.mine_stack(_files(spark, sf))


@query("mine_tree", f"WITH {F_CTE} SELECT repo, top_dir, count_if({_SOURCE})::BIGINT AS n_files FROM vis WHERE top_dir IS NOT NULL GROUP BY 1, 2")
def mine_tree(spark, sf):
    return mining.files_per_top_dir(_files(spark, sf))


@query("language_breakdown", f"""WITH {F_CTE} SELECT repo, suffix, n AS n_files, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY n DESC, suffix) AS place
  FROM (SELECT repo, suffix, count(*) AS n FROM vis WHERE {_SOURCE} GROUP BY 1, 2)) WHERE place <= 8""")
def language_breakdown(spark, sf):
    return mining.language_breakdown(_files(spark, sf))


@query("structural_map", f"""WITH {F_CTE}, vis2 AS (SELECT *, {_SUFFIX} AS suffix FROM files WHERE len(list_filter(string_split(path, '/'), lambda p: starts_with(p, '.') OR p IN ('node_modules', 'build', 'dist', '__pycache__'))) = 0),
 lang AS (SELECT repo, string_agg(suffix || '=' || n, ',' ORDER BY n DESC, suffix) AS languages FROM (SELECT repo, suffix, count(*) AS n FROM vis2 WHERE suffix <> '' GROUP BY 1, 2) GROUP BY repo),
 tops AS (SELECT repo, string_agg(DISTINCT split_part(path, '/', 1), ',' ORDER BY split_part(path, '/', 1)) AS top_dirs FROM files WHERE contains(path, '/') GROUP BY repo)
 SELECT v.repo, count(*) AS n_files, any_value(top_dirs) AS top_dirs, any_value(languages) AS languages FROM vis2 v LEFT JOIN lang USING (repo) LEFT JOIN tops USING (repo) GROUP BY v.repo""")
def structural_map(spark, sf):
    m = mining.structural_map(_files(spark, sf))
    langs = F.transform("languages", lambda x: F.concat(x["suffix"], F.lit("="), x["n_files"].cast("string")))
    return m.select("repo", "n_files", F.array_join("top_dirs", ",").alias("top_dirs"), F.array_join(langs, ",").alias("languages"))


_LINES = "lines AS (SELECT repo, path, top_dir, unnest(string_split(content, chr(10))) AS line FROM vis)"
_SYMBOLS = f"""{F_CTE}, {_LINES},
 java AS (SELECT DISTINCT repo, top_dir, kind, regexp_replace({_NAME}, '\\.java$', '') AS name FROM (SELECT *, CASE WHEN ends_with(path, 'Service.java') THEN 'services' WHEN ends_with(path, 'Exception.java') THEN 'exceptions'
     WHEN regexp_matches(path, '(Controller|Handler|Endpoint|Resource)\\.java$') THEN 'endpoints' END AS kind FROM vis WHERE top_dir IS NOT NULL) WHERE kind IS NOT NULL
   UNION SELECT repo, top_dir, 'enums', regexp_extract(line, 'public\\s+enum\\s+(\\w+)', 1) FROM lines WHERE ends_with(path, '.java') AND top_dir IS NOT NULL AND regexp_matches(line, 'public\\s+enum\\s+(\\w+)')),
 py AS (SELECT repo, top_dir, CASE WHEN bool_or(regexp_matches(line, '^class\\s+\\w*(?:Exception|Error)\\s*[\\(:]')) THEN 'exceptions' ELSE 'classes' END AS kind, regexp_extract(line, '^class\\s+(\\w+)', 1) AS name
   FROM lines WHERE ends_with(path, '.py') AND top_dir IS NOT NULL AND regexp_matches(line, '^class\\s+\\w+') GROUP BY 1, 2, regexp_extract(line, '^class\\s+(\\w+)', 1))"""


def _symbols(cte: str) -> str:
    return f"""SELECT repo, top_dir, kind, max(n) AS total, string_agg(name, ',' ORDER BY name) FILTER (p <= 20) AS names FROM (SELECT *, count(*) OVER (PARTITION BY repo, top_dir, kind) AS n,
      row_number() OVER (PARTITION BY repo, top_dir, kind ORDER BY name) AS p FROM {cte}) GROUP BY 1, 2, 3"""


def _flat(df: DataFrame) -> DataFrame:
    return df.withColumn("names", F.array_join("names", ","))


@query("mine_java_symbols", f"WITH {_SYMBOLS} {_symbols('java')}")
def mine_java_symbols(spark, sf):
    return _flat(mining.mine_java_symbols(_files(spark, sf)))


@query("mine_python_classes", f"WITH {_SYMBOLS} {_symbols('py')}")
def mine_python_classes(spark, sf):
    return _flat(mining.mine_python_classes(_files(spark, sf)))


@query("distinct_symbols", f"""WITH w AS (SELECT DISTINCT source AS repo, lang AS top_dir, 'words' AS kind, unnest(regexp_extract_all(lower(text), '[a-z]{{4,}}')) AS name FROM documents) {_symbols('w')}""")
def distinct_symbols(spark, sf):
    words = table(spark, sf, "documents").select(
        F.col("source").alias("repo"), F.col("lang").alias("top_dir"), F.lit("words").alias("kind"),
        F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))).alias("name"))
    return _flat(mining.distinct_symbols(words))


@query("java_contracts", f"WITH {F_CTE} SELECT repo, top_dir, count(*) AS dto_count FROM vis WHERE top_dir IS NOT NULL AND regexp_matches(path, '(Dto|DTO|Request|Response)\\.java$') GROUP BY 1, 2")
def java_contracts(spark, sf):
    return mining.java_contracts(_files(spark, sf))


_SPRING = "@(Get|Post|Put|Delete|Patch|Request)Mapping\\s*\\(\\s*(?:value\\s*=\\s*)?[\"'']([^\"'']+)[\"'']"


@query("mine_spring_routes", f"WITH {F_CTE}, {_LINES} SELECT DISTINCT repo, upper(regexp_extract(line, '{_SPRING}', 1)) AS verb, trim(regexp_extract(line, '{_SPRING}', 2)) AS route FROM lines WHERE ends_with(path, '.java') AND regexp_matches(line, '{_SPRING}')")
def mine_spring_routes(spark, sf):
    return mining.mine_spring_routes(_files(spark, sf))


_PYROUTE = "@\\w+\\.(route|get|post|put|delete|patch)\\s*\\(\\s*[\"'']([^\"'']+)[\"'']"


@query("mine_python_routes", f"""WITH {F_CTE}, {_LINES} SELECT DISTINCT repo, CASE WHEN regexp_extract(line, '{_PYROUTE}', 1) = 'route' THEN 'ANY' ELSE upper(regexp_extract(line, '{_PYROUTE}', 1)) END AS verb,
  trim(regexp_extract(line, '{_PYROUTE}', 2)) AS route FROM lines WHERE ends_with(path, '.py') AND regexp_matches(line, '{_PYROUTE}')""")
def mine_python_routes(spark, sf):
    return mining.mine_python_routes(_files(spark, sf))


@query("mine_config_files", f"WITH {F_CTE} SELECT DISTINCT repo, path FROM vis WHERE regexp_matches({_NAME}, '^application(-.*)?\\.(yml|yaml|properties)$')")
def mine_config_files(spark, sf):
    return mining.mine_config_files(_files(spark, sf))


@query("mine_grep", f"""WITH {F_CTE}, l AS (SELECT repo, path, generate_subscripts(ls, 1) AS line_no, unnest(ls) AS text FROM (SELECT repo, path, string_split(content, chr(10)) AS ls FROM files)),
 a AS (SELECT *, row_number() OVER (PARTITION BY repo, path ORDER BY line_no) AS i FROM l WHERE contains(lower(text), 'mapping')),
 b AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY path, line_no) AS n FROM a WHERE i <= 5)
 SELECT repo, path, CAST(line_no AS INT) AS line_no, text FROM b WHERE n <= 20""")
def mine_grep(spark, sf):
    files = s.repo_files(spark, sf)
    return mining.mine_grep(files, "Mapping")


@query("recent_n", """SELECT o_custkey AS repo, o_orderkey AS id, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders) WHERE place <= 15""")
def recent_n(spark, sf):
    commits = table(spark, sf, "orders").select(F.col("o_custkey").alias("repo"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("date"))
    return mining.recent_n(commits).select("repo", "id", "place")


@query("repo_summary", f"""WITH {_SYMBOLS}, sym AS (SELECT DISTINCT repo, top_dir, kind, name FROM java UNION SELECT repo, top_dir, kind, name FROM py),
 spring AS (SELECT DISTINCT repo, upper(regexp_extract(line, '{_SPRING}', 1)) AS verb, trim(regexp_extract(line, '{_SPRING}', 2)) AS route FROM lines WHERE ends_with(path, '.java') AND regexp_matches(line, '{_SPRING}')),
 python AS (SELECT DISTINCT repo, CASE WHEN regexp_extract(line, '{_PYROUTE}', 1) = 'route' THEN 'ANY' ELSE upper(regexp_extract(line, '{_PYROUTE}', 1)) END AS verb, trim(regexp_extract(line, '{_PYROUTE}', 2)) AS route FROM lines WHERE ends_with(path, '.py') AND regexp_matches(line, '{_PYROUTE}')),
 sl AS (SELECT repo, count(*) AS n, string_agg(verb || ' ' || route, ',' ORDER BY route, verb) FILTER (p <= 40) AS l FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY route, verb) AS p FROM spring) GROUP BY repo),
 pl AS (SELECT repo, count(*) AS n, string_agg(verb || ' ' || route, ',' ORDER BY route, verb) FILTER (p <= 40) AS l FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY route, verb) AS p FROM python) GROUP BY repo),
 md AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY n DESC, top_dir) AS p FROM (SELECT repo, top_dir, count_if({_SOURCE}) AS n FROM vis WHERE top_dir IS NOT NULL GROUP BY 1, 2)),
 ml AS (SELECT repo, string_agg(top_dir || '=' || n, ',' ORDER BY p) AS l FROM md WHERE p <= 15 GROUP BY repo),
 sy AS (SELECT repo, string_agg(top_dir || '/' || kind || '=' || n, ',' ORDER BY top_dir, kind) AS l FROM (SELECT repo, top_dir, kind, count(*) AS n FROM sym JOIN (SELECT repo, top_dir FROM md WHERE p <= 15) USING (repo, top_dir) GROUP BY 1, 2, 3) GROUP BY repo),
 ct AS (SELECT repo, string_agg(top_dir || '=' || n, ',' ORDER BY top_dir) AS l FROM (SELECT repo, top_dir, count(*) AS n FROM vis WHERE top_dir IS NOT NULL AND regexp_matches(path, '(Dto|DTO|Request|Response)\\.java$') GROUP BY 1, 2) JOIN (SELECT repo, top_dir FROM md WHERE p <= 15) USING (repo, top_dir) GROUP BY repo),
 cm AS (SELECT repo, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY p) AS l FROM (SELECT source AS repo, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS p FROM documents) WHERE p <= 15 GROUP BY repo),
 base AS (SELECT source AS repo, min(lang) AS team FROM documents GROUP BY source)
 SELECT b.repo, team, (SELECT count(*) FROM vis v WHERE v.repo = b.repo AND {_SOURCE}) AS n_source_files, ml.l AS modules, sy.l AS symbols, ct.l AS contracts,
   sl.n AS n_spring_routes, sl.l AS spring_routes, pl.n AS n_python_routes, pl.l AS python_routes, cm.l AS commits
 FROM base b LEFT JOIN ml USING (repo) LEFT JOIN sy USING (repo) LEFT JOIN ct USING (repo) LEFT JOIN sl USING (repo) LEFT JOIN pl USING (repo) LEFT JOIN cm USING (repo)""")
def repo_summary(spark, sf):
    files = s.repo_files(spark, sf).select("repo", "path", "content")
    docs = table(spark, sf, "documents")
    manifest = docs.groupBy(F.col("source").alias("name")).agg(F.min("lang").alias("team"))
    commits = docs.select(
        F.col("source").alias("repo"), F.col("doc_id").alias("id"), F.col("n_chars").alias("date"),
        F.left("text", F.lit(72)).alias("summary"),
    )
    out = mining.repo_summary(files, manifest, commits)

    def joined(name, entry):
        return F.array_join(F.transform(name, entry), ",").alias(name)

    def route(x):
        return F.concat(x["verb"], F.lit(" "), x["route"])

    return out.select(
        "repo", "team", F.coalesce("n_source_files", F.lit(0)).alias("n_source_files"),
        joined("modules", lambda x: F.concat(x["top_dir"], F.lit("="), x["n_files"].cast("string"))),
        joined("symbols", lambda x: F.concat(x["top_dir"], F.lit("/"), x["kind"], F.lit("="), x["total"].cast("string"))),
        joined("contracts", lambda x: F.concat(x["top_dir"], F.lit("="), x["dto_count"].cast("string"))),
        "n_spring_routes", joined("spring_routes", route), "n_python_routes", joined("python_routes", route),
        joined("commits", lambda x: x["id"].cast("string")),
    )


# --- streams: the same results as in batch ---------------------------------------------------


def _event_stream(spark, sf) -> DataFrame:
    schema = table(spark, sf, "events").schema
    return streams.file_stream(spark, schema, sf, "events.parquet")


@query("stream_ticket_state", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, count(*) AS n_events FROM events GROUP BY user_id")
def stream_ticket_state(spark, sf):
    out = fresh_path(spark, "state")
    streams.stream_ticket_state(_event_stream(spark, sf), out, "user_id", "event_type", ["ts", "event_id"]).awaitTermination()
    streams.compact_state(spark, out, "user_id")
    return streams.read_state(spark, out, "user_id").select("user_id", "status", "n_events")


@query("stream_event_dedup", "SELECT DISTINCT event_id, user_id, event_type FROM events")
def stream_event_dedup(spark, sf):
    out = fresh_path(spark, "unique")
    twice = _event_stream(spark, sf)
    streams.stream_event_dedup(twice.unionByName(_event_stream(spark, sf)), out, "event_id", "ts").awaitTermination()
    return streams.read_events(spark, out).select("event_id", "user_id", "event_type")


# Events are dealt into four files in an order of their own; the later files' events are behind the
# watermark of those before. Which are late is decided by the first of them that holds a later time.
_DEALT = "SELECT *, abs(user_id) % 4 AS file FROM events"


@query("stream_late_events", f"""WITH e AS ({_DEALT}),
  seen AS (SELECT file, max(ts) OVER (ORDER BY file) AS latest FROM (SELECT file, max(ts) AS ts FROM e GROUP BY file))
  SELECT event_id, coalesce(epoch_ms(e.ts) <= epoch_ms(latest - INTERVAL 1 HOUR), false) AS late
  FROM e LEFT JOIN seen ON seen.file = e.file - 1""")
def stream_late_events(spark, sf):
    """Every event comes out once: unique or late, by the same stream."""
    out, source = fresh_path(spark, "unique"), fresh_path(spark, "dealt")
    events = table(spark, sf, "events")
    for k in range(4):  # in the order of the files' times
        events.where(F.abs("user_id") % 4 == k).coalesce(1).write.parquet(f"{source}/{k}")
    stream = streams.file_stream(spark, events.schema, f"{source}/*", "*.parquet", per_trigger=1, latestFirst="false")
    streams.stream_event_dedup(stream, out, "event_id", "ts").awaitTermination()
    both = [streams.read_events(spark, out, late).select("event_id", F.lit(late).alias("late")) for late in (False, True)]
    return both[0].unionByName(both[1])


_TRANSITIONS = """SELECT user_id AS key, coalesce(from_status, '-') AS from_status, to_status, count(*) AS n, min(valid::INT)::INT AS valid FROM
  (SELECT user_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_status, event_type AS to_status, event_type IN ('view', 'click', 'purchase') AS valid FROM events) GROUP BY 1, 2, 3"""


def _moves(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key", F.coalesce("from_status", F.lit("-")).alias("from_status"), "to_status").agg(
        F.count("*").alias("n"), F.min(F.col("valid").cast("int")).alias("valid"))


@query("stream_status_transitions", _TRANSITIONS)
def stream_status_transitions(spark, sf):
    out = fresh_path(spark, "transitions")
    streams.stream_status_transitions(
        _event_stream(spark, sf), out, "user_id", "event_type", ["ts", "event_id"], ["view", "click", "purchase"]
    ).awaitTermination()
    return _moves(spark.read.parquet(f"{out}/data"))


@query("stream_transitions_by_time", _TRANSITIONS)
def stream_transitions_by_time(spark, sf):
    """Events that arrive in four batches by the hash of their id give the same transitions."""
    out, source = fresh_path(spark, "transitions"), fresh_path(spark, "shuffled")
    events = table(spark, sf, "events")
    part = F.pmod(F.xxhash64("event_id"), F.lit(4))
    for k in range(4):
        events.where(part == k).coalesce(1).write.parquet(f"{source}/{k}")
    span = "40 days"  # more than the events span: none is behind the watermark before the end
    streams.write_heartbeat(events, f"{source}/4", "ts", "41 DAYS")
    stream = streams.file_stream(spark, events.schema, f"{source}/*", "*.parquet", per_trigger=1)
    streams.stream_status_transitions(
        stream, out, "user_id", "event_type", ["ts", "event_id"], ["view", "click", "purchase"], span
    ).awaitTermination()
    return _moves(streams.read_events(spark, out))


@query("stream_triage", f"{PARSED} SELECT report_id, title, component_hint, reproducibility, 0 AS rejected FROM parsed UNION ALL SELECT -1 - doc_id, NULL, NULL, NULL, 1 FROM documents WHERE doc_id % 50 = 0")
def stream_triage(spark, sf):
    """All reports, and an empty one beside every fiftieth, which must not stop the others."""
    out, source = fresh_path(spark, "triage"), fresh_path(spark, "mails")
    mails = s.reports(spark, sf)
    blank = mails.filter(F.col("report_id") % 50 == 0).select((-1 - F.col("report_id")).alias("report_id"), F.lit(" \n").alias("raw_text"))
    mails.unionByName(blank).write.parquet(source)
    reports = streams.file_stream(spark, "report_id BIGINT, raw_text STRING", source, "*.parquet")
    streams.stream_triage(reports, lambda batch: extraction.parse_reports(batch), out).awaitTermination()
    nothing = F.lit(None).cast("string")
    rejected = spark.read.parquet(f"{out}/rejects").select(
        "report_id", nothing.alias("title"), nothing.alias("component_hint"), nothing.alias("reproducibility"), F.lit(1).alias("rejected"))
    done = spark.read.parquet(f"{out}/data").select("report_id", "title", "component_hint", "reproducibility", F.lit(0).alias("rejected"))
    return done.unionByName(rejected)


@query("stream_corrections", """SELECT substr(md5(text), 1, 12) AS bug_hash, lang AS corrected_component FROM documents""")
def stream_corrections(spark, sf):
    out, source = fresh_path(spark, "corrections"), fresh_path(spark, "csv")
    from faultline.sources import tables

    docs = table(spark, sf, "documents")
    rows = docs.select(
        F.lit("2024-01-01").alias("timestamp"), F.substring(F.md5("text"), 1, 12).alias("bug_hash"), F.col("source").alias("predicted_component"),
        F.col("lang").alias("corrected_component"), F.lit("0.5").alias("confidence_at_prediction"), F.col("source").alias("title"), F.col("text").alias("bug_text"))
    tables.append_corrections(rows, source)
    streams.stream_corrections(spark, source, out).awaitTermination()
    return spark.read.parquet(f"{out}/data").select("bug_hash", "corrected_component")
