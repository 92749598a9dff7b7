"""Queries for text and vector retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline import lexicons as lx
from faultline.operators import classify, dedup, retrieval, routing, svd, tfidf
from faultline.plans import standins as s
from faultline.plans.registry import query, sql_list, table
from faultline.session import materialise

_STOPS = sql_list(lx.STOP_WORDS)


def words_sql(expr: str) -> str:
    return (f"list_filter(regexp_extract_all(lower({expr}), '[\\p{{L}}\\p{{N}}_]{{2,}}'), "
            f"lambda w: w NOT IN ({_STOPS}))")


def counts_sql(source: str, id_: str, text: str) -> str:
    return (f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(list_concat(ws, list_transform(range(1, len(ws)), "
            f"lambda i: ws[i] || ' ' || ws[i + 1]))) AS term FROM (SELECT {id_} AS doc_id, {words_sql(text)} AS ws FROM {source})) GROUP BY doc_id, term")


def tfidf_ctes(source: str, id_: str, text: str, limit: int, prefix: str = "") -> str:
    p = prefix
    return f"""{p}counts AS ({counts_sql(source, id_, text)}),
 {p}vocab AS (SELECT term, corpus_tf, df, ln((1.0::DOUBLE + (SELECT count(*) FROM {source})) / (1 + df)) + 1 AS idf FROM
   (SELECT term, CAST(sum(tf) AS BIGINT) AS corpus_tf, count(*) AS df FROM {p}counts GROUP BY term ORDER BY corpus_tf DESC, term LIMIT {limit})),
 {p}raw AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS raw FROM {p}counts JOIN {p}vocab USING (term)),
 {p}weights AS (SELECT doc_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS weight FROM {p}raw)"""


_DOCS = tfidf_ctes("documents", "doc_id", "text", lx.TFIDF_MAX_FEATURES)


def _docs(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text")


@query("tfidf_fit", f"WITH {_DOCS} SELECT doc_id, term, round(weight, 6) AS weight FROM weights")
def tfidf_fit(spark, sf):
    weights, _ = tfidf.tfidf_fit(_docs(spark, sf))
    return weights.select("doc_id", "term", F.round("weight", 6).alias("weight"))


@query("tfidf_vocabulary", f"WITH {_DOCS} SELECT term, df, round(idf, 6) AS idf FROM vocab")
def tfidf_vocabulary(spark, sf):
    _, vocab = tfidf.tfidf_fit(_docs(spark, sf))
    return vocab.select("term", "df", F.round("idf", 6).alias("idf"))


@query("vocab_limit", f"WITH {_DOCS} SELECT term, corpus_tf, df FROM vocab")
def vocab_limit(spark, sf):
    return tfidf.vocab_limit(tfidf.term_counts(_docs(spark, sf), most=lx.TFIDF_MAX_FEATURES), lx.TFIDF_MAX_FEATURES)


def _learned(spark, sf) -> DataFrame:
    docs = _docs(spark, sf)
    return svd.embed_svd(docs, svd.fit_svd_encoder(docs, rank=32))


@query("embed_svd", f"""WITH {_DOCS} SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM weights) THEN 1.0::DOUBLE END AS norm,
  CASE WHEN doc_id IN (SELECT doc_id FROM weights) THEN 32 END AS width FROM documents""")
def embed_svd(spark, sf):
    """Vectors of the learned encoder: unit length where a term is known, null elsewhere."""
    square = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    found = _learned(spark, sf)
    return found.select("doc_id", F.round(F.sqrt(square), 6).alias("norm"), F.when(F.col("vec").isNotNull(), F.size("vec")).alias("width"))


@query("loo_evaluate_svd")
def loo_evaluate_svd(spark, sf):
    """Leave-one-out votes for the language of every document from its nearest in the learned space."""
    langs = table(spark, sf, "documents").select(F.col("doc_id").alias("key"), F.col("lang").alias("label"))
    index = materialise(_learned(spark, sf).withColumnRenamed("doc_id", "key").where("vec is not null").join(langs, "key"), "learned")
    return classify.evaluation(classify.loo_predictions(index))


# Benchmark texts ask, documents answer.
_SIMS = f"""{_DOCS}, qraw AS (SELECT doc_id AS query_id, term, (1 + ln(tf)) * idf AS raw FROM ({counts_sql('benchmark', 'item_id', 'text')}) JOIN vocab USING (term)),
 qw AS (SELECT query_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY query_id)) AS weight FROM qraw),
 sims AS (SELECT query_id, doc_id AS key, round(sum(qw.weight * weights.weight), 6) AS similarity FROM qw JOIN weights USING (term) GROUP BY query_id, doc_id),
 ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, key) AS rank FROM sims) WHERE rank <= 5 AND similarity > 0),
 tm AS (SELECT m.*, CASE WHEN lang = 'es' THEN '' ELSE source END AS assignee FROM ranked m JOIN documents d ON m.key = d.doc_id WHERE similarity >= 0.12)"""


def _asked(spark, sf) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def text_matches(spark, sf) -> tuple[DataFrame, DataFrame]:
    return tfidf.tfidf_matches(_asked(spark, sf), _docs(spark, sf))


def staffed_matches(spark, sf) -> DataFrame:
    matches, _ = text_matches(spark, sf)
    staff = table(spark, sf, "documents").select(
        F.col("doc_id").alias("key"), F.when(F.col("lang") == "es", "").otherwise(F.col("source")).alias("assignee")
    )
    return matches.join(staff, "key")


@query("sim_join_tfidf", f"WITH {_SIMS} SELECT query_id, CAST(rank AS INT) AS rank, key, similarity, similarity >= 0.38 AS is_duplicate_candidate FROM tm")
def sim_join_tfidf(spark, sf):
    return text_matches(spark, sf)[0].select("query_id", "rank", "key", "similarity", "is_duplicate_candidate")


@query("tfidf_duplicates", f"""WITH {_SIMS} SELECT item_id AS query_id, CASE WHEN similarity >= 0.38 THEN key END AS duplicate_of,
  coalesce(round(similarity, 3), 0.0::DOUBLE) AS duplicate_confidence FROM benchmark LEFT JOIN (SELECT * FROM ranked WHERE rank = 1) r ON r.query_id = item_id""")
def tfidf_duplicates(spark, sf):
    return text_matches(spark, sf)[1]


@query("owner_frequency", f"""WITH {_SIMS}, c AS (SELECT query_id, assignee, count(*) AS n, min(rank) AS first_rank FROM tm WHERE assignee <> '' GROUP BY 1, 2),
 b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, first_rank) AS p, sum(n) OVER (PARTITION BY query_id) AS total FROM c)
 SELECT item_id AS query_id, assignee AS suggested_owner, CASE WHEN assignee IS NULL THEN 'No similar issue names anyone.'
   ELSE concat(assignee, ' had ', n::BIGINT, ' of ', total::BIGINT, ' similar issues (similarity 0.12 or more).') END AS owner_reason
 FROM benchmark LEFT JOIN (SELECT * FROM b WHERE p = 1) x ON x.query_id = item_id""")
def owner_frequency(spark, sf):
    return routing.owner_frequency(staffed_matches(spark, sf), _asked(spark, sf))


# --- vectors ------------------------------------------------------------------------------

_NN = s.PAIRS_CTE.format(k=5)


def _queries(spark, sf) -> DataFrame:
    return s.index(spark, sf).withColumnRenamed("key", "query_id")


@query("sim_join_dense", f"WITH {_NN} SELECT query_id, key, CAST(rank AS INT) AS rank, similarity, similarity >= 0.80 AS is_duplicate_candidate FROM nn")
def sim_join_dense(spark, sf):
    found = retrieval.dense_matches(_queries(spark, sf), s.index(spark, sf), 5, exclude_self=True)
    return found.select("query_id", "key", "rank", "similarity", "is_duplicate_candidate")


_NORMED = """n AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / (sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) + 1e-9)) AS v FROM embeddings),
 p AS (SELECT a.vec_id AS query_id, b.vec_id AS key, round(list_inner_product(a.v, b.v), 6) AS similarity FROM n a JOIN n b ON a.vec_id <> b.vec_id)"""


@query("sim_join_dense_strict", f"""WITH {_NORMED} SELECT query_id, key, similarity, similarity >= 0.55 AS is_duplicate_candidate
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, key) AS r FROM p) WHERE r <= 5 AND similarity >= 0.40""")
def sim_join_dense_strict(spark, sf):
    # The default thresholds 0.70 and 0.88 find nothing in random vectors.
    found = retrieval.dense_matches(
        _queries(spark, sf), s.index(spark, sf), lx.DENSE_TOP_K, similar=0.40,
        duplicate=0.55, exclude_self=True, normalise=True,
    )
    return found.select("query_id", "key", "similarity", "is_duplicate_candidate")


@query("topk_per_query", """SELECT o_custkey AS query_id, o_orderkey AS key, similarity, CAST(rank AS INT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY similarity DESC, o_orderkey) AS rank FROM
  (SELECT o_custkey, o_orderkey, o_totalprice AS similarity FROM orders)) WHERE rank <= 3""")
def topk_per_query(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("similarity")
    )
    return retrieval.topk_per_query(rows, 3)


# Two sources: documents with a vector, and pages with a vector as local tickets;
# the benchmark texts with a vector ask.
_SOURCES = """asks AS (SELECT item_id AS query_id, text, embedding::DOUBLE[] AS v FROM benchmark JOIN embeddings ON item_id = vec_id),
 src AS (SELECT 'index' AS source, concat('DOC-', doc_id) AS key, text, embedding::DOUBLE[] AS v FROM documents JOIN embeddings ON doc_id = vec_id
   UNION ALL SELECT 'tickets', concat('TKT-', page_id), url, embedding::DOUBLE[] FROM pages JOIN embeddings ON page_id = vec_id),
 cand AS (SELECT query_id, source, key, round(list_inner_product(a.v, b.v), 6) AS similarity FROM asks a, src b),
 pool AS (SELECT query_id, source, key, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY similarity DESC, key) AS r FROM cand) WHERE r <= 30)"""


def _two_sources(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    vec = s.index(spark, sf).drop("label")
    asks = _asked(spark, sf).join(vec.withColumnRenamed("key", "query_id"), "query_id")
    docs = s.index_with_text(spark, sf).withColumn("key", F.concat(F.lit("DOC-"), F.col("key").cast("string")))
    pages = table(spark, sf, "pages").select(F.col("page_id").alias("key"), F.col("url").alias("text")).join(vec, "key")
    return asks, docs, pages.withColumn("key", F.concat(F.lit("TKT-"), F.col("key").cast("string")))


@query("sim_join_two_source", f"WITH {_SOURCES} SELECT * FROM pool")
def sim_join_two_source(spark, sf):
    asks, docs, pages = _two_sources(spark, sf)
    return retrieval.two_source_recall(asks, docs, pages).select("query_id", "source", "key", "similarity")


@query("union_candidates", """SELECT doc_id AS key, 'index' AS source FROM documents UNION ALL SELECT item_id, 'tickets' FROM benchmark""")
def union_candidates(spark, sf):
    return retrieval.union_candidates(
        table(spark, sf, "documents").select(F.col("doc_id").alias("key")),
        table(spark, sf, "benchmark").select(F.col("item_id").alias("key")),
    )


_TOKENS = "list_distinct(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]{{2,}}'))"
_RERANKED = f"""{_SOURCES}, scored AS (SELECT p.query_id, p.source, p.key, p.similarity AS cosine, len(list_intersect(qt, ct)) AS shared, len(list_distinct(list_concat(qt, ct))) AS either
   FROM pool p JOIN (SELECT query_id, {_TOKENS.format('text')} AS qt FROM asks) a USING (query_id)
   JOIN (SELECT source, key, {_TOKENS.format('text')} AS ct FROM src) b USING (source, key)),
 final AS (SELECT *, round(CASE WHEN n <= 10 THEN cosine ELSE 1 / (1 + exp(-(CASE WHEN either > 0 THEN shared::DOUBLE / either * 8 - 2 ELSE -2.0 END))) END, 6) AS similarity
   FROM (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM scored)),
 reranked AS (SELECT query_id, CAST(rank AS INT) AS rank, source, key, similarity, cosine, cosine >= 0.80 AS is_duplicate_candidate FROM
   (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, cosine DESC, source, key) AS rank FROM final) WHERE rank <= 10)"""


@query("rerank_two_stage", f"WITH {_RERANKED} SELECT * FROM reranked")
def rerank_two_stage(spark, sf):
    return retrieval.rerank_two_stage(*_two_sources(spark, sf))


@query("gate_relevance", f"""WITH {_RERANKED} SELECT item_id AS query_id, count_if(similarity >= 0.15)::BIGINT AS kept, count(similarity) AS total,
  coalesce(max(similarity), 0.0::DOUBLE) AS top_relevance_score, coalesce(max(similarity), 0.0) < 0.15 AS is_low_confidence
  FROM benchmark LEFT JOIN reranked ON query_id = item_id GROUP BY item_id""")
def gate_relevance(spark, sf):
    matches = retrieval.rerank_two_stage(*_two_sources(spark, sf))
    return retrieval.relevance_summary(_asked(spark, sf), matches, threshold=0.15)


@query("reasoning_matches", f"WITH {_RERANKED} SELECT query_id, key, similarity FROM reranked WHERE similarity >= 0.15")
def reasoning_matches(spark, sf):
    matches = retrieval.rerank_two_stage(*_two_sources(spark, sf))
    return retrieval.gate_relevance(matches, 0.15).select("query_id", "key", "similarity")


@query("top_match", f"WITH {_NN} SELECT query_id, key, similarity, CASE WHEN similarity >= 0.38 THEN key END AS duplicate_of FROM nn WHERE rank = 1")
def top_match(spark, sf):
    found = retrieval.dense_matches(_queries(spark, sf), s.index(spark, sf), 5, duplicate=lx.TFIDF_DUPLICATE, exclude_self=True)
    return retrieval.top_match(found)


@query("dup_candidate_flag", f"WITH {_NN} SELECT query_id, key, similarity >= 0.38 AS is_duplicate_candidate FROM nn")
def dup_candidate_flag(spark, sf):
    found = retrieval.dense_matches(_queries(spark, sf), s.index(spark, sf), 5, duplicate=lx.TFIDF_DUPLICATE, exclude_self=True)
    return found.select("query_id", "key", "is_duplicate_candidate")


@query("lsh_sim_join")
def lsh_sim_join(spark, sf):
    found = retrieval.approximate_join(_queries(spark, sf), s.index(spark, sf), k=30, min_similarity=0.3)
    return found.select("query_id", "key", "similarity")


# --- duplicates ---------------------------------------------------------------------------

# Verdicts: for every vector one proposed key, sometimes a candidate, with a
# confidence that is sometimes no number.
_VERDICTS = """SELECT vec_id AS query_id, CASE WHEN vec_id % 3 = 0 THEN vec_id + 1 ELSE best END AS key,
  CASE vec_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN '0.93' WHEN 2 THEN '0.80' ELSE '0.41' END AS confidence FROM embeddings JOIN top ON vec_id = query_id WHERE vec_id IS NOT NULL"""
_VERDICT_CTE = f"{_NN}, top AS (SELECT query_id, key AS best FROM nn WHERE rank = 1), verdicts AS ({_VERDICTS})"
_CHECKED = """checked AS (SELECT v.query_id, CASE WHEN n.key IS NOT NULL AND coalesce(try_cast(v.confidence AS DOUBLE), 0) >= 0.80 THEN v.key END AS duplicate_of,
  round(coalesce(try_cast(v.confidence AS DOUBLE), 0.0), 3) AS duplicate_confidence FROM verdicts v LEFT JOIN nn n ON n.query_id = v.query_id AND n.key = v.key)"""


def _verdicts(nn: DataFrame) -> DataFrame:
    v = F.col("query_id")
    conf = F.when(v % 4 == 0, "high").when(v % 4 == 1, "0.93").when(v % 4 == 2, "0.80").otherwise("0.41")
    return nn.filter(F.col("rank") == 1).select(
        "query_id", F.when(v % 3 == 0, v + 1).otherwise(F.col("key")).alias("key"), conf.alias("confidence")
    )


def _nn(spark, sf) -> DataFrame:
    return retrieval.cached_matches(s.neighbours(spark, sf, 5))


@query("candidate_key_check", f"WITH {_VERDICT_CTE}, {_CHECKED} SELECT * FROM checked")
def candidate_key_check(spark, sf):
    nn = _nn(spark, sf)
    return dedup.candidate_key_check(_verdicts(nn), nn)


@query("decide_duplicates", f"""WITH {_VERDICT_CTE}, {_CHECKED}, judged AS (SELECT * FROM checked WHERE query_id % 2 = 0)
  SELECT t.query_id, CASE WHEN j.query_id IS NOT NULL THEN j.duplicate_of WHEN t.similarity >= 0.38 THEN t.key END AS duplicate_of,
   CASE WHEN j.query_id IS NOT NULL THEN j.duplicate_confidence ELSE round(t.similarity, 3) END AS duplicate_confidence,
   CASE WHEN j.query_id IS NOT NULL THEN 'verdict' ELSE 'rule' END AS method
  FROM (SELECT * FROM nn WHERE rank = 1) t LEFT JOIN judged j USING (query_id)""")
def decide_duplicates(spark, sf):
    # Half the reports have a second opinion, the others go by the rule.
    nn = _nn(spark, sf)
    verdicts = _verdicts(nn).filter(F.col("query_id") % 2 == 0)
    return dedup.decide_duplicates(nn, _queries(spark, sf), verdicts)


@query("reflag_matches", f"""WITH {_VERDICT_CTE}, {_CHECKED} SELECT n.query_id, n.key, coalesce(n.key = c.duplicate_of, false) AS is_duplicate_candidate
  FROM nn n LEFT JOIN checked c USING (query_id)""")
def reflag_matches(spark, sf):
    nn = _nn(spark, sf)
    decisions = dedup.candidate_key_check(_verdicts(nn), nn)
    return dedup.reflag(nn, decisions).select("query_id", "key", "is_duplicate_candidate")


@query("regression_flag", f"""WITH {_NN} SELECT query_id, key AS duplicate_of, o_orderstatus AS status, coalesce(o_orderstatus IN ('F'), false) AS possible_regression
  FROM nn LEFT JOIN orders ON o_orderkey = key WHERE rank = 1""")
def regression_flag(spark, sf):
    decisions = _nn(spark, sf).filter(F.col("rank") == 1).select("query_id", F.col("key").alias("duplicate_of"))
    states = table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"))
    return dedup.regression_flag(decisions, states, ["F"])
