"""How the test tables stand in for reports, issues, tickets and logs.

Text expressions are written once, in SQL both engines read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.plans.registry import table

_NL = "chr(10)"

REPORT_TEXT = f"""concat(
  CASE doc_id % 5
    WHEN 0 THEN concat('From: "', upper(lang), ' Desk" <', source, '.', lang, '@mail.example.com>', {_NL})
    WHEN 1 THEN concat('From: Team ', source, {_NL})
    WHEN 2 THEN concat('From: ', lang, '_', source, '@mail.example.com', {_NL})
    ELSE '' END,
  'To: intake@mail.example.com', {_NL},
  CASE doc_id % 7
    WHEN 0 THEN 'Subject: Re: ' WHEN 1 THEN 'Subject: [URGENT] ' WHEN 2 THEN 'Subject: [Known] '
    WHEN 3 THEN '' WHEN 4 THEN 'Subject: login fails ' ELSE 'Subject: ' END,
  CASE WHEN doc_id % 7 = 3 THEN '' ELSE concat(substr(split_part(text, {_NL}, 1), 1, 60), {_NL}) END,
  {_NL}, text, {_NL}, {_NL},
  CASE doc_id % 3
    WHEN 0 THEN concat('Steps to Reproduce:', {_NL}, '1. Open ', source, {_NL}, '2) Scroll to ', lang, {_NL},
                       '   and wait', {_NL}, '- Tap pay', {_NL}, {_NL})
    WHEN 1 THEN concat('How to reproduce: steps to repro below', {_NL}, '1. Start ', source, {_NL}, '2. Stop', {_NL}, {_NL})
    ELSE '' END,
  CASE doc_id % 4 WHEN 0 THEN '' ELSE concat('Expected: page ', lang, ' loads', {_NL}, {_NL}) END,
  CASE doc_id % 4 WHEN 1 THEN concat('**Actual Result:** ', source, ' crashes to home', {_NL}, {_NL})
                  WHEN 2 THEN concat('Actual:', {_NL}, 'wrong results and price mismatch', {_NL}, {_NL}) ELSE '' END,
  CASE doc_id % 6 WHEN 0 THEN concat('Impact: all users', {_NL}, {_NL}) WHEN 1 THEN concat('Impact: a subset of users', {_NL}, {_NL})
                  WHEN 2 THEN concat('Impact: the majority of sessions', {_NL}, {_NL}) ELSE '' END,
  CASE doc_id % 8 WHEN 0 THEN concat('Reproducibility: always', {_NL}) WHEN 1 THEN concat('Reproducibility: ~40%', {_NL})
                  WHEN 2 THEN concat('Reproducibility: sometimes. Rare', {_NL}) WHEN 3 THEN concat('It is intermittent', {_NL})
                  WHEN 4 THEN concat('Reproducibility: conditional', {_NL}) ELSE '' END,
  CASE doc_id % 6 WHEN 0 THEN concat('Platform: Android', {_NL}) WHEN 1 THEN concat('Platform: iOS, Android', {_NL})
                  WHEN 2 THEN concat('Seen on iOS and web', {_NL}) WHEN 3 THEN concat('Platform: web', {_NL}) ELSE '' END,
  CASE doc_id % 4 WHEN 0 THEN concat('App Version: 1.', CAST(doc_id % 10 AS STRING), '.2', {_NL})
                  WHEN 1 THEN concat('build v2.', CAST(doc_id % 10 AS STRING), '.7 on version 3.1', {_NL}) ELSE '' END,
  CASE doc_id % 5 WHEN 3 THEN concat({_NL}, 'Regards,', {_NL}, 'Jane Roe') ELSE '' END)"""

REPORTS_CTE = f"rep AS (SELECT doc_id AS report_id, {REPORT_TEXT} AS raw_text FROM documents)"


def reports(spark: SparkSession, sf: str) -> DataFrame:
    """Every document dressed as a report mail."""
    # the test tables are one file; extraction takes far longer than dealing the texts out
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang", "source").repartition("doc_id")
    return docs.select(F.col("doc_id").alias("report_id"), F.expr(REPORT_TEXT).alias("raw_text"))


# Orders of a customer as tickets of a component, the customer being the assignee.
TICKETS_SQL = """SELECT concat('TKT-', CAST(o_orderkey AS STRING)) AS key, o_orderkey,
  concat('P', CAST(CAST(substr(o_orderpriority, 1, 1) AS INT) - 1 AS STRING)) AS priority,
  c_name AS assignee, c_custkey, c_mktsegment AS component, o_orderstatus AS status, o_orderdate AS created
  FROM orders JOIN customer ON o_custkey = c_custkey"""

# Managers: the customers of the first nation (a dimension, not a sample).
MANAGERS_SQL = "SELECT c_name AS manager, c_mktsegment AS component FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_0'"
TEAM_MANAGERS_SQL = f"""SELECT component, min(manager) AS manager FROM ({MANAGERS_SQL}) WHERE component <> 'MACHINERY' GROUP BY component"""


def views(spark: SparkSession, sf: str, *names: str) -> None:
    for name in names:
        table(spark, sf, name).createOrReplaceTempView(name)


def tickets(spark: SparkSession, sf: str) -> DataFrame:
    views(spark, sf, "orders", "customer")
    return spark.sql(TICKETS_SQL)


def managers(spark: SparkSession, sf: str) -> DataFrame:
    views(spark, sf, "customer", "nation")
    return spark.sql(MANAGERS_SQL)


def team_managers(spark: SparkSession, sf: str) -> DataFrame:
    views(spark, sf, "customer", "nation")
    return spark.sql(TEAM_MANAGERS_SQL)


# Labelled vectors with the text of the document of the same number.
INDEX_SQL = """SELECT vec_id AS key, embedding AS vec, label, text FROM embeddings JOIN documents ON vec_id = doc_id"""


def index(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("key"), F.col("embedding").alias("vec"), "label"
    )


def index_with_text(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("key"), "text")
    return index(spark, sf).join(docs, "key")


# Every vector with its neighbours' attributes taken from the order of the same number.
ATTRIBUTES_SQL = f"""SELECT o_orderkey AS key, priority, assignee, component FROM ({TICKETS_SQL})"""

# Every possible pair of vectors, best first: what the block join must agree with.
PAIRS_CTE = """pairs AS (
  SELECT a.vec_id AS query_id, b.vec_id AS key, b.label AS label,
    round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, key) AS rank FROM pairs) WHERE rank <= {k})"""


def neighbours(spark: SparkSession, sf: str, k: int) -> DataFrame:
    """Nearest other vectors of every vector, with labels."""
    from faultline.operators.classify import neighbours_of

    idx = index(spark, sf)
    return neighbours_of(idx.withColumnRenamed("key", "query_id"), idx, k, exclude_self=True)


def vector_matches(spark: SparkSession, sf: str, k: int) -> DataFrame:
    """Neighbours dressed as matches of historical tickets."""
    t = tickets(spark, sf).select(F.col("o_orderkey").alias("key"), "priority", "assignee", "component")
    return neighbours(spark, sf, k).join(t, "key")


MATCHES_CTE = PAIRS_CTE + f""", matches AS (
  SELECT nn.*, t.priority, t.assignee, t.component FROM nn JOIN ({ATTRIBUTES_SQL}) t USING (key))"""

# Routed component of a vector: the segment with the number of its label.
ROUTED_SQL = """SELECT vec_id AS query_id, CASE label % 5 WHEN 0 THEN 'AUTOMOBILE' WHEN 1 THEN 'BUILDING'
  WHEN 2 THEN 'FURNITURE' WHEN 3 THEN 'HOUSEHOLD' ELSE 'MACHINERY' END AS component FROM embeddings"""


def routed(spark: SparkSession, sf: str) -> DataFrame:
    views(spark, sf, "embeddings")
    return spark.sql(ROUTED_SQL)


# Files of source repositories, one per document.
FILES_SQL = """SELECT source AS repo,
  concat(CASE doc_id % 11 WHEN 0 THEN 'build/' WHEN 1 THEN '' ELSE concat('mod', CAST(doc_id % 3 AS STRING), '/') END,
    CASE doc_id % 13
      WHEN 0 THEN 'package.json' WHEN 1 THEN 'application-dev.yml' WHEN 2 THEN 'README.md' WHEN 3 THEN 'pom.xml'
      ELSE concat(upper(substr(lang, 1, 1)), substr(lang, 2), 'Unit', CAST(doc_id AS STRING),
        CASE doc_id % 6 WHEN 0 THEN 'Service.java' WHEN 1 THEN 'Exception.java' WHEN 2 THEN 'Controller.java'
          WHEN 3 THEN 'Dto.java' ELSE '.py' END) END) AS path,
  concat('import ', lang, chr(10),
    CASE WHEN doc_id % 6 < 4 THEN concat('public enum ', upper(lang), CAST(doc_id % 40 AS STRING), ' {}', chr(10),
        '@GetMapping("/', source, '/', CAST(doc_id % 9 AS STRING), '")', chr(10),
        '@RequestMapping(value = "/all/', lang, '")', chr(10))
      ELSE concat('class Unit', CAST(doc_id % 30 AS STRING), '(Base):', chr(10), 'class ', lang, 'Error(Exception):', chr(10),
        '@app.route("/', source, '")', chr(10), '@api.post("/', lang, '/', CAST(doc_id % 4 AS STRING), '")', chr(10)) END,
    text) AS content,
  doc_id AS file_id
  FROM documents"""


def repo_files(spark: SparkSession, sf: str) -> DataFrame:
    views(spark, sf, "documents")
    return spark.sql(FILES_SQL)


# Ticket log: users are tickets, event types their statuses.
LOG_SQL = """SELECT ts AS timestamp, event_id AS seq,
  CASE WHEN event_id = first_id THEN 'INSERT' WHEN event_type = 'error' THEN 'DELETE' ELSE 'STATUS_UPDATE' END AS event,
  concat('TKT-', CAST(user_id AS STRING)) AS key,
  CASE WHEN event_id = first_id THEN concat('{"summary": "ticket ', CAST(user_id AS STRING), '", "status": "', event_type, '", "priority": "P1"}')
    WHEN event_type = 'error' THEN '{}' ELSE concat('{"from": "", "to": "', event_type, '"}') END AS payload
  FROM (SELECT e.*, f.first_id FROM events e JOIN (SELECT user_id AS u, min(event_id) AS first_id FROM events GROUP BY user_id) f ON e.user_id = f.u)"""


def ticket_log(spark: SparkSession, sf: str) -> DataFrame:
    views(spark, sf, "events")
    return spark.sql(LOG_SQL)
