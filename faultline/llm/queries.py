"""One query per operator of this subpackage, over its whole table, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import (
    decontaminate,
    exact,
    jaccard,
    language,
    licenses,
    lines,
    merkle,
    packing,
    passages,
    quality,
    repair,
    tokens,
    warc,
)
from faultline.llm import text as tx
from faultline.session import fresh_path, materialise

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    tx.small_batches(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op1_packing")
def op1_packing(spark: SparkSession, sf: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    pieces = packing.pack_documents(table(spark, sf, "documents"))
    return pieces.select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
        "sequence_length",
        "sequence_cost",
    )


OP2_SQL = """
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, w[k:k + least(len(w), 10) - 1] AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS k
        FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM wins),
runs AS (
  SELECT doc_id, size, k, w[k:k + size - 1] AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS k
        FROM dw, sizes WHERE len(w) >= size)),
hits AS (SELECT r.doc_id, r.k, r.size, x.item_id FROM runs r JOIN wins x USING (size, win)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(k, k + size)) AS p FROM hits) GROUP BY 1),
named AS (SELECT doc_id, count(*) AS n_items,
    string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY 1)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words,
  CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""


@query("op2_decontamination", OP2_SQL)
def op2_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    """Words of each document inside windows of ten benchmark words."""
    found = decontaminate.find_windows(
        table(spark, sf, "documents"), table(spark, sf, "benchmark")
    )
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


#: A line of a run that goes lies in a part of it of up to five lines that has five words too.
OP9_SQL = """
WITH raw AS (
  SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
lines AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS p,
    len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS w
  FROM raw WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
docs AS (SELECT doc_id, list(line ORDER BY p) AS ls, list(w ORDER BY p) AS ws FROM lines GROUP BY 1),
wins AS (
  SELECT doc_id, size, k - 1 AS p, ls[k:k + size - 1] AS win, list_sum(ws[k:k + size - 1]) AS w
  FROM (SELECT *, unnest(range(1, len(ls) - size + 2)) AS k
        FROM docs, (SELECT unnest(range(1, 6)) AS size) WHERE len(ls) >= size)),
later AS (
  SELECT *, row_number() OVER (PARTITION BY size, win ORDER BY doc_id, p) AS nth FROM wins),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + size)) AS p FROM later WHERE nth > 1 AND w >= 5),
cleaned AS (
  SELECT raw.doc_id, coalesce(string_agg(raw.line, chr(10) ORDER BY raw.i)
      FILTER (WHERE gone.p IS NULL), '') AS text,
    count(lines.p) AS n_lines, count(gone.p) AS n_deleted
  FROM raw LEFT JOIN lines USING (doc_id, i) LEFT JOIN gone
    ON gone.doc_id = raw.doc_id AND gone.p = lines.p
  GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS INTEGER) AS n_lines,
  CAST(coalesce(n_deleted, 0) AS INTEGER) AS n_deleted, cleaned.text
FROM documents d LEFT JOIN cleaned USING (doc_id)
"""


@query("op9_line_dedup", OP9_SQL)
def op9_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """What is left of every document without runs of lines that occurred before."""
    found = lines.drop_repeated_lines(table(spark, sf, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_deleted", "text")


OP10_SQL = """
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
    sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id)
      AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""


@query("op10_exact_dedup", OP10_SQL)
def op10_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Fills an empty digest index with all documents; the decision for each."""
    name = f"digest_index_{uuid.uuid4().hex}"
    exact.open_index(spark, name, fresh_path(spark, "digest-index"))
    decided = exact.append_new(table(spark, sf, "documents"), name)
    spark.sql(f"DROP TABLE {name}")  # the catalog's entry; what is read below is written
    return decided.select(
        "doc_id",
        "keep_id",
        "group_size",
        "kept",
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


@query("op3_passages")
def op3_passages(spark: SparkSession, sf: str) -> DataFrame:
    """Passages of fifty words or more that an earlier document has too."""
    return passages.near_duplicate_passages(table(spark, sf, "documents"))


@query("op4_quality")
def op4_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Quality score of every document; labels learned from three quarters of the ids."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = quality.fit(docs, table(spark, sf, "labels").where(~held_out))
    found = quality.score(docs, model)
    return found.select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


@query("op5_language")
def op5_language(spark: SparkSession, sf: str) -> DataFrame:
    """Language of every document; learned from two thirds of them."""
    docs = table(spark, sf, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = language.fit(docs.where(~held_out))
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op6_licenses")
def op6_licenses(spark: SparkSession, sf: str) -> DataFrame:
    """License notices in every document."""
    found = licenses.scan_licenses(table(spark, sf, "documents"))
    return found.select(
        "doc_id",
        F.size("matches").cast("long").alias("n_matches"),
        F.array_sort(F.array_distinct("matches.license")).alias("licenses"),
        "matches",
    )


OP7_SQL = """
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5
    THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) END) AS g
  FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS root, doc_id AS node FROM t
  UNION SELECT r.root, e.b FROM r JOIN e ON r.node = e.a)
SELECT t.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.root) AS component_id
FROM t LEFT JOIN n USING (doc_id) JOIN r ON r.node = t.doc_id GROUP BY t.doc_id
"""


@query("op7_jaccard", OP7_SQL)
def op7_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of documents that share three quarters of their runs of five words."""
    return jaccard.link_documents(table(spark, sf, "documents"))


OP8_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS n, sha256(body) AS digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first_id FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""


@query("op8_warc", OP8_SQL)
def op8_warc(spark: SparkSession, sf: str) -> DataFrame:
    """All pages as WARC records, read back and assembled: one row per capture."""
    path = fresh_path(spark, "warc")
    warc.write_warc(table(spark, sf, "pages"), path)
    records = materialise(warc.read_warc(spark, path, blocks=False), "warc-records")
    captures = warc.assemble_captures(records)
    flat = materialise(
        captures.select(
            F.regexp_extract(F.col("metadata.block").cast("string"), "^id: (.*)\r\n", 1)
            .cast("long")
            .alias("page_id"),
            "response.payload_bytes",
            F.regexp_replace("response.payload_digest", "^sha256:", "").alias("payload_digest"),
            F.col("response.type").alias("record_type"),
            F.col("response.refers_to").alias("refers_to_record"),
            "capture_id",
        ),
        "warc-captures",
    )
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type"]
    first = flat.select(
        F.col("capture_id").alias("refers_to_record"), F.col("page_id").alias("refers_to")
    )
    revisits = flat.where(F.col("record_type") == "revisit").join(
        first, "refers_to_record", "left"
    )
    others = flat.where(F.col("record_type") != "revisit")
    return others.select(*columns, F.lit(None).cast("long").alias("refers_to")).unionByName(
        revisits.select(*columns, "refers_to")
    )


#: CRC-32 in SQL: the table from its rule, then a fold over the (ASCII) characters.
CRC_SQL = """
WITH RECURSIVE bits(i, k, v) AS (
  SELECT CAST(range AS BIGINT), 0, CAST(range AS BIGINT) FROM range(256)
  UNION ALL
  SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
"""


def crc_of(text: str) -> str:
    return f"""xor(list_reduce([4294967295] || list_transform(string_split({text}, ''),
      lambda c: CAST(ascii(c) AS BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295)"""


OP11_SQL = f"""{CRC_SQL}
rows AS (
  SELECT *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS small,
    {crc_of('CAST(doc_id AS VARCHAR)')} % 3 = 0 AS struck
  FROM documents, crc),
told AS (
  SELECT *, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-')
    || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
    || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head FROM rows),
leaves AS (
  SELECT doc_id, coalesce('=' || lang, '-') AS tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN struck THEN sha256(head || coalesce(strlen(small) || ':' || small, '-')) END AS changed FROM told),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
  count(*) OVER (PARTITION BY tree) AS n FROM leaves),
low(tree, level, place, n, digest) AS (
  SELECT tree, 0, place, n, leaf FROM placed
  UNION ALL
  SELECT tree, level + 1, place // 8, (max(n) + 7) // 8, sha256(string_agg(digest, '' ORDER BY place))
  FROM low WHERE n > 1 GROUP BY tree, level, place // 8),
subs AS (SELECT tree, level AS depth, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place,
  count(*) OVER () AS n FROM low WHERE n = 1),
high(level, place, n, digest) AS (
  SELECT 0, place, n, subroot FROM subs
  UNION ALL
  SELECT level + 1, place // 8, (max(n) + 7) // 8, sha256(string_agg(digest, '' ORDER BY place))
  FROM high WHERE n > 1 GROUP BY level, place // 8),
nodes AS (
  SELECT tree, level, place, n, digest FROM low
  UNION ALL SELECT NULL, level, place, n, digest FROM high),
sides AS (
  SELECT a.tree, a.level, a.place, string_agg(b.digest, '' ORDER BY b.place) FILTER (WHERE b.place < a.place) AS l,
    string_agg(b.digest, '' ORDER BY b.place) FILTER (WHERE b.place > a.place) AS r
  FROM nodes a JOIN nodes b ON a.tree IS NOT DISTINCT FROM b.tree AND a.level = b.level
    AND a.place // 8 = b.place // 8 WHERE a.n > 1 GROUP BY 1, 2, 3),
climb(tree, first, level, place, proof, folded) AS (
  SELECT tree, place, 0, place, '', coalesce(changed, leaf) FROM placed
  UNION ALL
  SELECT c.tree, first, c.level + 1, CASE WHEN c.level + 1 = depth THEN 0 ELSE c.place // 8 END,
    proof || coalesce(l, '') || coalesce(r, ''), sha256(coalesce(l, '') || folded || coalesce(r, ''))
  FROM climb c JOIN subs USING (tree) JOIN sides s ON s.tree = c.tree AND s.level = c.level AND s.place = c.place
  WHERE c.level < depth),
top_climb(tree, first, level, place, proof, folded) AS (
  SELECT c.tree, first, 0, s.place, proof, folded FROM climb c JOIN subs s ON s.tree = c.tree AND c.level = s.depth
  UNION ALL
  SELECT c.tree, first, c.level + 1, c.place // 8, proof || coalesce(l, '') || coalesce(r, ''),
    sha256(coalesce(l, '') || folded || coalesce(r, ''))
  FROM top_climb c JOIN sides s ON s.tree IS NULL AND s.level = c.level AND s.place = c.place)
SELECT doc_id, leaf, subroot, digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root,
  folded = digest AS verified
FROM placed p JOIN subs USING (tree) JOIN high h ON h.n = 1
JOIN top_climb t ON t.tree = p.tree AND t.first = p.place AND t.level = h.level
"""


@query("op11_merkle", OP11_SQL)
def op11_merkle(spark: SparkSession, sf: str) -> DataFrame:
    """Proof of every document in the manifest; a third of the documents are tampered with."""
    small = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    struck = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    told = F.when(struck, merkle.leaf_digest(text=small))
    manifest = merkle.build_manifest(table(spark, sf, "documents"), keep={"told": told})
    found = merkle.verify(manifest, F.coalesce("told", "leaf"))
    return found.select(
        F.col("row_id").alias("doc_id"),
        "leaf",
        "subroot",
        "root",
        merkle.proof_digest(F.col("proof")).alias("proof_sha256"),
        "folded_root",
        "verified",
    )


@query("op12_token_counts")
def op12_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of every document; fills an empty cache of counts."""
    name = f"token_cache_{uuid.uuid4().hex}"
    tokens.open_cache(spark, name, fresh_path(spark, "token-cache"))
    counts = tokens.count_tokens(table(spark, sf, "documents"), name)
    spark.sql(f"DROP TABLE {name}")  # the catalog's entry; the counts are written
    return counts.select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit")
    )


OP13_SQL = f"""{CRC_SQL}
keyed AS (
  SELECT *, {crc_of("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS k,
    coalesce(CAST(conv_id AS VARCHAR), '~') AS c FROM conversations, crc),
damaged AS (
  SELECT c, turn, CASE WHEN k = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
    CASE k WHEN 1 THEN '' WHEN 2 THEN translate(coalesce(text, ' '), '.!?', '') ELSE coalesce(text, ' ') END AS text,
    unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) AS copy FROM keyed WHERE k <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY c
    ORDER BY turn NULLS FIRST, sha256(strlen(role) || ':' || role || text), copy) - 1 AS place FROM damaged),
coded AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'b'
      WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY place) > 1 THEN 'd'
      WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 't' ELSE '.' END AS fault,
    left(role, 1) AS initial, lead(left(role, 1)) OVER (PARTITION BY c ORDER BY place) AS next FROM placed),
tallies AS (
  SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 'b') AS blank,
    count_if(fault = 'd') AS duplicate, count_if(fault = 't') AS truncated, count(*) AS n,
    count_if(next IS NOT NULL AND initial || next NOT IN ('su', 'ua', 'au')) AS illegal FROM coded GROUP BY c),
fill(q, q2, cost, audit, lines) AS (VALUES
  (0, 0, 0, '', []), (0, 2, 5, 'I', ['user:']), (0, 3, 10, 'II', ['user:', 'assistant:']),
  (1, 1, 0, '', []), (1, 2, 5, 'I', ['user:']), (1, 3, 10, 'II', ['user:', 'assistant:']),
  (2, 2, 0, '', []), (2, 3, 5, 'I', ['assistant:']), (3, 3, 0, '', []), (3, 2, 5, 'I', ['user:'])),
keep(q, q2, initial) AS (VALUES (0, 1, 's'), (0, 2, 'u'), (1, 2, 'u'), (2, 3, 'a'), (3, 2, 'u')),
rename(q, q2, role) AS (VALUES (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')),
edits AS (
  SELECT c, place, q, q AS q2, 2 AS cost, 'D' AS audit, CAST([] AS VARCHAR[]) AS lines
    FROM coded, (SELECT unnest([0, 1, 2, 3]) AS q)
  UNION ALL
  SELECT c, place, q, q2, CASE WHEN fault = 't' THEN 5 ELSE 0 END, 'K', [role || ':' || text]
    FROM coded JOIN keep USING (initial) WHERE fault IN ('t', '.')
  UNION ALL
  SELECT c, place, q, q2, CASE WHEN fault = 't' THEN 6 ELSE 1 END, 'R', [r.role || ':' || text]
    FROM coded, rename r WHERE fault IN ('t', '.')),
best(c, place, q, b) AS (
  SELECT c, CAST(0 AS BIGINT), 0, struct_pack(cost := CAST(0 AS BIGINT), audit := '', lines := CAST([] AS VARCHAR[])) FROM tallies
  UNION ALL
  SELECT s.c, s.place + 1, e.q2, min(struct_pack(cost := CAST(b.cost + f.cost + e.cost AS BIGINT),
    audit := b.audit || f.audit || e.audit, lines := b.lines || f.lines || e.lines))
  FROM best s JOIN fill f ON f.q = s.q JOIN edits e ON e.c = s.c AND e.place = s.place AND e.q = f.q2
  GROUP BY s.c, s.place, e.q2),
won AS (
  SELECT s.c, min(struct_pack(cost := CAST(b.cost + f.cost AS BIGINT), audit := b.audit || f.audit,
    lines := b.lines || f.lines)) AS b
  FROM best s JOIN tallies t ON t.c = s.c AND t.n = s.place JOIN fill f ON f.q = s.q AND f.q2 IN (0, 3) GROUP BY s.c)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(b.cost, 0) AS cost,
  coalesce(b.audit, '') AS audit, sha256(coalesce(array_to_string(b.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN tallies t ON t.c = coalesce(CAST(i.conv_id AS VARCHAR), '~')
LEFT JOIN won w ON w.c = t.c
"""


def damaged(turns: DataFrame) -> DataFrame:
    """Faults by the CRC of conversation and turn: dropped, emptied, cut, repeated, renamed."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    k = F.crc32(F.concat(parts[0], F.lit(":"), parts[1])) % 20
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    struck = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), k.alias("k")).where("k <> 0")
    return struck.select(
        "conv_id",
        "turn",
        F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


@query("op13_repair", OP13_SQL)
def op13_repair(spark: SparkSession, sf: str) -> DataFrame:
    """Damaged conversations, their faults, the cheapest repair and a digest of the result."""
    turns = table(spark, sf, "conversations")
    found, repaired = repair.repair_conversations(damaged(turns))
    digests = repair.conversation_digests(repaired)
    every = turns.select("conv_id").distinct()
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    found = found.withColumnRenamed("conv_id", "_f")
    digests = digests.withColumnRenamed("conv_id", "_d")
    whole = every.join(found, F.col("conv_id").eqNullSafe(F.col("_f")), "left")
    whole = whole.join(digests, F.col("conv_id").eqNullSafe(F.col("_d")), "left")
    return whole.select(
        "conv_id",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )
