"""Queries for classification, priority and owner routing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline import lexicons as lx
from faultline.functions import text as t
from faultline.operators import classify, extraction, leaveout, priority, quality, routing
from faultline.plans import standins as s
from faultline.plans.queries_extraction import CORPUS, PARSED, hits_sql, parsed
from faultline.plans.queries_retrieval import counts_sql, tfidf_ctes
from faultline.plans.registry import q, query, sql_case, table
from faultline.session import materialise

_NN = s.PAIRS_CTE.format(k=5)
_M = s.MATCHES_CTE.format(k=5)

# --- neighbour vote -----------------------------------------------------------------------


def _vote_cte(methods: tuple[str, str, str, str]) -> str:
    return f"""votes AS (SELECT query_id, label, sum(pow(greatest(similarity, 0.0), 2)) AS v, min(rank) AS fr FROM nn GROUP BY query_id, label),
 win AS (SELECT * FROM (SELECT *, sum(v) OVER (PARTITION BY query_id) AS total, row_number() OVER (PARTITION BY query_id ORDER BY round(v, 9) DESC, fr) AS p FROM votes) WHERE p = 1),
 knn AS (SELECT w.query_id, CASE WHEN t.similarity >= 0.85 THEN CAST(t.label AS VARCHAR) WHEN total = 0 OR v / total < 0.40 THEN 'bugs' ELSE CAST(w.label AS VARCHAR) END AS component,
   round(CASE WHEN t.similarity >= 0.85 THEN t.similarity WHEN total = 0 THEN 0.0 ELSE v / total END, 6) AS confidence,
   CASE WHEN t.similarity >= 0.85 THEN '{methods[0]}' WHEN total = 0 THEN '{methods[1]}' WHEN v / total < 0.40 THEN '{methods[2]}' ELSE '{methods[3]}' END AS method,
   t.similarity < 0.85 AND (total = 0 OR v / total < 0.40) AS fell_back
   FROM win w JOIN (SELECT * FROM nn WHERE rank = 1) t USING (query_id))"""


_KNN = _vote_cte(("k=1-exact-knn-fallback", "knn-no-positive", "knn-low-conf", "knn-weighted-vote"))
_LOO = _vote_cte(("k=1-exact", "no-positive-neighbours", "k=5-weighted-vote-low-conf", "k=5-weighted-vote"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("confidence", F.round("confidence", 6))


@query("vote_knn", f"WITH {_NN}, {_KNN} SELECT * FROM knn")
def vote_knn(spark, sf):
    return _rounded(classify.vote_knn(s.neighbours(spark, sf, 5)))


_SELF = """pairs AS (SELECT a.vec_id AS query_id, b.vec_id AS key, b.label AS label, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity
  FROM embeddings a, embeddings b), nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, key) AS rank FROM pairs) WHERE rank <= 5)"""


@query("predict_component_knn", f"WITH {_SELF}, {_KNN} SELECT * FROM knn")
def predict_component_knn(spark, sf):
    idx = s.index(spark, sf)
    return _rounded(classify.predict_component_knn(idx.withColumnRenamed("key", "query_id"), idx))


@query("neighbours_explain", f"""WITH {_NN} SELECT query_id, string_agg(concat(key, ':', label, ':', similarity), ' ' ORDER BY rank) AS top_neighbours FROM nn GROUP BY query_id""")
def neighbours_explain(spark, sf):
    found = classify.neighbours_explain(s.neighbours(spark, sf, 5))
    text = F.transform("top_neighbours", lambda n: F.concat_ws(":", n["key"], n["label"], n["similarity"].cast("string")))
    return found.select("query_id", F.array_join(text, " ").alias("top_neighbours"))


@query("loo_predictions", f"WITH {_NN}, {_LOO} SELECT knn.*, e.label FROM knn JOIN embeddings e ON vec_id = query_id")
def loo_predictions(spark, sf):
    return _rounded(classify.loo_predictions(s.index(spark, sf)))


@query("loo_evaluate", f"""WITH {_NN}, {_LOO}, pr AS (SELECT CAST(e.label AS VARCHAR) AS label, component FROM knn JOIN embeddings e ON vec_id = query_id),
 cls AS (SELECT label AS class FROM pr UNION SELECT component FROM pr),
 m AS (SELECT class, (SELECT count(*) FROM pr WHERE label = class) AS support, (SELECT count(*) FROM pr WHERE component = class) AS said,
   (SELECT count(*) FROM pr WHERE component = class AND label = class) AS hit FROM cls),
 r AS (SELECT *, CASE WHEN said > 0 THEN hit::DOUBLE / said ELSE 0.0 END AS pc, CASE WHEN support > 0 THEN hit::DOUBLE / support ELSE 0.0 END AS rc FROM m)
 SELECT class, support, round(pc, 6) AS precision, round(rc, 6) AS recall, round(CASE WHEN pc + rc > 0 THEN 2 * pc * rc / (pc + rc) ELSE 0.0 END, 6) AS f1,
   round((SELECT sum(hit)::DOUBLE / sum(support) FROM m), 6) AS accuracy FROM r""")
def loo_evaluate(spark, sf):
    out = classify.evaluation(classify.loo_predictions(s.index(spark, sf)))
    return out.select("class", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "accuracy")])


@query("loo_proba", f"""WITH {_NN}, v AS (SELECT query_id, label, sum(pow(greatest(similarity, 0.0), 2)) AS v FROM nn GROUP BY 1, 2),
 t AS (SELECT query_id, sum(v) AS t FROM v GROUP BY 1)
 SELECT e.vec_id AS query_id, c.label, round(CASE WHEN coalesce(t.t, 0) = 0 THEN 0.1 ELSE coalesce(v.v, 0) / t.t END, 6) AS probability
 FROM embeddings e CROSS JOIN (SELECT DISTINCT label FROM embeddings) c LEFT JOIN v ON v.query_id = e.vec_id AND v.label = c.label LEFT JOIN t ON t.query_id = e.vec_id""")
def loo_proba(spark, sf):
    idx = s.index(spark, sf)
    out = classify.loo_proba(s.neighbours(spark, sf, 5), idx.withColumnRenamed("key", "query_id"), idx)
    return out.withColumn("probability", F.round("probability", 6))


# --- training set and models ------------------------------------------------------------------

_COMPONENT = "CASE WHEN l.quality IS NULL THEN NULL WHEN d.lang = 'es' THEN 'unmapped' ELSE d.source END"
_ELIGIBLE = f"""el AS (SELECT doc_id, component, CASE WHEN coalesce(component, '') = '' THEN 'no_component' WHEN component = 'unmapped' THEN 'unmapped_component'
   WHEN regexp_replace(text, '^\\s+|\\s+$', '', 'g') = '' THEN 'no_text' ELSE 'ok' END AS reason
  FROM (SELECT d.doc_id, {_COMPONENT} AS component, CASE WHEN l.toxic = 1 THEN '  ' ELSE d.text END AS text FROM documents d LEFT JOIN labels l USING (doc_id)))"""


def _eligible(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    comp = F.when(F.col("quality").isNotNull(), F.when(F.col("lang") == "es", "unmapped").otherwise(F.col("source")))
    rows = d.select("doc_id", comp.alias("component"), F.when(F.col("toxic") == 1, "  ").otherwise(F.col("text")).alias("text"))
    sources = table(spark, sf, "documents").select(F.col("source").alias("component"))
    return classify.training_eligibility(rows, sources)


@query("training_eligibility", f"WITH {_ELIGIBLE} SELECT doc_id, component, reason FROM el")
def training_eligibility(spark, sf):
    return _eligible(spark, sf).select("doc_id", "component", "reason")


@query("class_counts", f"""WITH {_ELIGIBLE} SELECT CASE WHEN reason = 'ok' THEN 'label' ELSE 'skipped' END AS kind,
  CASE WHEN reason = 'ok' THEN component ELSE reason END AS name, count(*) AS n FROM el GROUP BY 1, 2""")
def class_counts(spark, sf):
    return classify.class_counts(_eligible(spark, sf))


@query("class_weights", """SELECT label, count(*) AS n, round((SELECT count(*) FROM embeddings)::DOUBLE / ((SELECT count(DISTINCT label) FROM embeddings) * count(*)), 9) AS weight
  FROM embeddings GROUP BY label""")
def class_weights(spark, sf):
    return classify.class_weights(s.index(spark, sf)).withColumn("weight", F.round("weight", 9))


def _lr(spark, sf) -> DataFrame:
    idx = s.index(spark, sf)
    model, classes = classify.train_component_lr(idx)
    return classify.predict_component_lr(idx.withColumnRenamed("key", "query_id"), model, classes)


@query("train_component_lr")
def train_component_lr(spark, sf):
    idx = s.index(spark, sf)
    model, classes = classify.train_component_lr(idx)
    scored = classify.predict_component_lr(idx.withColumnRenamed("key", "query_id"), model, classes)
    labelled = scored.join(idx.select(F.col("key").alias("query_id"), "label"), "query_id")
    return labelled.groupBy("label").agg(
        F.count("*").alias("n"), F.count_if(F.col("component") == F.col("label").cast("string")).alias("right")
    )


@query("predict_component_lr")
def predict_component_lr(spark, sf):
    return _rounded(_lr(spark, sf)).select("query_id", "component", "confidence", "method", "fell_back")


@query("lr_optimum", "SELECT label, count(*) AS n, true AS flat FROM embeddings GROUP BY label")
def lr_optimum(spark, sf):
    """The fitted model is the optimum: the gradient of weighted loss and penalty is zero for each class."""
    idx = s.index(spark, sf)
    model, classes = classify.train_component_lr(idx, tol=1e-9)
    weights = classify.class_weights(idx).select("label", "weight")
    scored = classify.predict_component_lr(idx.withColumnRenamed("key", "query_id"), model, classes)
    rows = scored.join(idx.withColumnRenamed("key", "query_id"), "query_id").join(F.broadcast(weights), "label")
    pull = rows.select(
        "label", "weight", "vec", F.explode("probabilities").alias("class", "p")
    ).withColumn("pull", F.col("weight") * (F.col("p") - (F.col("class") == F.col("label").cast("string")).cast("double")))
    terms = F.concat(F.col("vec").cast("array<double>"), F.array(F.lit(1.0)))
    sums = pull.select("class", "pull", F.posexplode(terms).alias("j", "x")).groupBy("class", "j").agg(F.sum(F.col("pull") * F.col("x")).alias("g"))
    table_ = [
        (str(c), j, float(v)) for c, row in zip(classes, model.coefficientMatrix.toArray()) for j, v in enumerate([*row, 0.0])
    ]
    penalty = spark.createDataFrame(table_, "class string, j int, beta double")
    flat = sums.join(penalty, ["class", "j"]).groupBy("class").agg(F.max(F.abs(F.col("g") + F.col("beta"))).alias("steep"))
    counts = idx.groupBy("label").agg(F.count("*").alias("n"))
    return counts.join(flat, F.col("label").cast("string") == F.col("class")).select("label", "n", (F.col("steep") < 0.02).alias("flat"))


@query("loo_logistic")
def loo_logistic(spark, sf):
    """Every vector classified by the logistic model as if it had not been trained on it."""
    idx = s.index(spark, sf)
    model, classes = classify.train_component_lr(idx)
    return leaveout.approximate_loo(idx, model, classes).withColumn("confidence", F.round("confidence", 6))


@query("embed_text", """SELECT doc_id, 1.0::DOUBLE AS norm, len(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}'))) AS n_tokens, true AS entries_fit, true AS copies_agree FROM documents""")
def embed_text(spark, sf):
    """Length one; no more entries than tokens; equal texts have equal vectors."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    vec = classify.embed_text(docs, classify.fit_encoder(docs, 1024))
    length = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    entries = F.size(F.filter("vec", lambda x: x != 0))
    rows = vec.select(
        "doc_id", F.md5("text").alias("copy"), F.round(F.sqrt(length), 4).alias("norm"),
        F.size(F.array_distinct(t.tokens(F.col("text")))).cast("bigint").alias("n_tokens"), entries.alias("entries"),
        F.xxhash64("vec").alias("hash"),
    )
    copies = rows.groupBy("copy").agg((F.min("hash") == F.max("hash")).alias("copies_agree"))
    fit = (F.col("entries") > 0) & (F.col("entries") <= F.col("n_tokens"))
    return rows.join(copies, "copy").select("doc_id", "norm", "n_tokens", fit.alias("entries_fit"), "copies_agree")


# --- from probabilities: vote shares stand in for model scores ----------------------------------

_SHARES = f"""{_NN}, v AS (SELECT query_id, label, sum(pow(greatest(similarity, 0.0), 2)) AS v FROM nn GROUP BY 1, 2),
 sc AS (SELECT query_id, label, round(v / sum(v) OVER (PARTITION BY query_id), 6) AS probability FROM v)"""


def _scores(spark, sf) -> DataFrame:
    idx = s.index(spark, sf)
    full = classify.loo_proba(s.neighbours(spark, sf, 5), idx.withColumnRenamed("key", "query_id"), idx)
    return full.filter(F.col("probability") > 0).withColumn("probability", F.round("probability", 6))


@query("argmax_class", f"WITH {_SHARES} SELECT query_id, label, probability AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY probability DESC, label) AS p FROM sc) WHERE p = 1")
def argmax_class(spark, sf):
    return classify.argmax_class(_scores(spark, sf))


@query("top3_classes", f"WITH {_SHARES} SELECT query_id, label, probability, CAST(p AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY probability DESC, label) AS p FROM sc) WHERE p <= 3")
def top3_classes(spark, sf):
    return classify.top_classes(_scores(spark, sf))


@query("probabilities_ranked", f"WITH {_SHARES} SELECT query_id, label, probability, CAST(row_number() OVER (PARTITION BY query_id ORDER BY probability DESC, label) AS INT) AS rank FROM sc")
def probabilities_ranked(spark, sf):
    return classify.probabilities_ranked(_scores(spark, sf))


@query("fallback_band", f"WITH {_NN}, {_KNN} SELECT query_id, CASE WHEN confidence < 0.40 THEN 'bugs' ELSE component END AS component, confidence FROM knn WHERE confidence < 0.60")
def fallback_band(spark, sf):
    verdicts = _rounded(classify.vote_knn(s.neighbours(spark, sf, 5)))
    return classify.fallback_band(verdicts).select("query_id", "component", "confidence")


@query("gate_low_confidence", f"WITH {_NN}, {_KNN} SELECT query_id, confidence, method FROM knn WHERE confidence < 0.60")
def gate_low_confidence(spark, sf):
    verdicts = _rounded(classify.vote_knn(s.neighbours(spark, sf, 5)))
    return quality.gate_low_confidence(verdicts).select("query_id", "confidence", "method")


_CONTEXT = f"""{_SHARES}, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY probability DESC, label) AS p FROM sc) WHERE p <= 3),
 docs AS (SELECT CAST(n_nationkey % 10 AS VARCHAR) AS team, '' AS repo, 'guide ' || n_name AS text FROM nation
   UNION ALL SELECT CAST(s_nationkey % 10 AS VARCHAR), s_name, 'notes ' || s_name FROM supplier)"""


@query("candidate_team_context", f"""WITH {_CONTEXT} SELECT query_id, string_agg(CASE WHEN repo = '' THEN 'team ' || team || chr(10) || text ELSE 'repo ' || team || ' / ' || repo || chr(10) || text END,
  chr(10) || chr(10) ORDER BY p, repo, text) AS context FROM top JOIN docs ON team = CAST(label AS VARCHAR) GROUP BY query_id""")
def candidate_team_context(spark, sf):
    nation, supplier = table(spark, sf, "nation"), table(spark, sf, "supplier")
    teams = nation.select(
        (F.col("n_nationkey") % 10).cast("string").alias("team"), F.concat(F.lit("guide "), "n_name").alias("text"))
    repos = supplier.select(
        (F.col("s_nationkey") % 10).cast("string").alias("team"), F.col("s_name").alias("repo"), F.concat(F.lit("notes "), "s_name").alias("text"))
    return classify.candidate_team_context(_scores(spark, sf), teams, repos)


# --- priority ---------------------------------------------------------------------------------


@query("priority_dim", f"""SELECT key, priority, {sql_case('priority', lx.PRIORITY_ID)} AS priority_id, {sql_case('priority', lx.SEVERITY)} AS severity FROM ({s.TICKETS_SQL})""")
def priority_dim(spark, sf):
    return priority.priority_dim(s.tickets(spark, sf).select("key", "priority"))


_TIER3 = "CASE WHEN priority IN ('P0', 'P1', 'P2') THEN priority ELSE 'P2' END"


@query("priority_three_tier", f"""SELECT key, priority, {sql_case('priority', lx.PRIORITY_ID)} AS priority_id, {sql_case('priority', lx.SEVERITY)} AS severity
  FROM (SELECT key, {_TIER3} AS priority FROM ({s.TICKETS_SQL}))""")
def priority_three_tier(spark, sf):
    return priority.priority_three_tier(s.tickets(spark, sf).select("key", "priority"))


_VOTE = f"""vsum AS (SELECT query_id, sum(CASE WHEN similarity >= 0.20 THEN similarity * ({sql_case('priority', lx.PRIORITY_NUMBER)}) END) AS sm,
   coalesce(sum(CASE WHEN similarity >= 0.20 THEN similarity END), 0) AS w, count_if(similarity >= 0.20) AS n_voters FROM matches GROUP BY query_id),
 vote AS (SELECT query_id, round(w, 6) AS weight, n_voters, CASE WHEN round(w, 9) >= 0.25 THEN 'P' || CAST(CAST(least(3, greatest(0, round_even(sm / w, 0))) AS INT) AS VARCHAR) END AS vote FROM vsum)"""


@query("vote_priority", f"WITH {_M}, {_VOTE} SELECT * EXCLUDE (n_voters) FROM vote")
def vote_priority(spark, sf):
    return priority.vote_priority(s.vector_matches(spark, sf, 5))


_TEMPLATE_ROWS = ", ".join(
    f"({q(f'{tier}-{i:03d}')}, {q(tier)}, {q(text)})" for tier, group in lx.TEMPLATES.items() for i, text in enumerate(group)
)
_TEMPLATE = f"""templates(tid, tier, text) AS (VALUES {_TEMPLATE_ROWS}), {tfidf_ctes('templates', 'tid', 'text', 10_000, 't')},
 rraw AS (SELECT doc_id AS report_id, term, (1 + ln(tf)) * idf AS raw FROM ({counts_sql('corpus', 'report_id', 'corpus')}) JOIN tvocab USING (term)),
 rw AS (SELECT report_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY report_id)) AS w FROM rraw),
 tsim AS (SELECT report_id, tier, max(sim) AS sim FROM (SELECT report_id, doc_id, sum(w * weight) AS sim FROM rw JOIN tweights USING (term) GROUP BY 1, 2) JOIN templates ON tid = doc_id GROUP BY 1, 2),
 tbest AS (SELECT c.report_id, min(CASE WHEN (tier = 'P0' AND sim >= 0.28) OR (tier = 'P1' AND sim >= 0.22) OR (tier = 'P2' AND sim >= 0.18) OR (tier = 'P3' AND sim >= 0.15) THEN tier END) AS template_tier
   FROM corpus c LEFT JOIN tsim USING (report_id) GROUP BY c.report_id),
 tpl AS (SELECT b.report_id, template_tier, coalesce(round(sim, 3), 0.0::DOUBLE) AS template_score FROM tbest b LEFT JOIN tsim t ON t.report_id = b.report_id AND t.tier = template_tier)"""


@query("template_best", f"{PARSED}{CORPUS}, {_TEMPLATE} SELECT * FROM tpl")
def template_best(spark, sf):
    corpus = parsed(spark, sf).select("report_id", extraction.scoring_corpus().alias("corpus"))
    return priority.template_best(corpus)


_FACTS = "facts AS (SELECT report_id, " + ", ".join(f"{hits_sql(tier, ps)} AS {tier}" for tier, ps in lx.SIGNALS.items()) + " FROM corpus)"
_IMPACT = "CASE " + " ".join(
    "WHEN " + " OR ".join(f"contains(lower(impact), {q(w)})" for w in ws) + f" THEN '{tier}'" for tier, ws in lx.IMPACT_WORDS
) + " ELSE 'P2' END"
_STEPS = [
    ("len(p0_hard) > 0", "'P0'", "'L1-keyword: ' || p0_hard[1]"),
    ("len(p0_soft) > 0 AND reproducibility = '100%'", "'P0'", "'L1-keyword: ' || p0_soft[1]"),
    ("dup AND tp = 'P0'", "'P0'", "'L1-duplicate: ' || tkey"),
    ("template_tier = 'P0'", "'P0'", "'L2-template: P0 (score=' || CAST(template_score AS VARCHAR) || ')'"),
    ("len(p1_hard) > 0", "'P1'", "'L1-keyword: ' || p1_hard[1]"),
    ("len(p1_soft) >= 2", "'P1'", "'L1-keyword: ' || p1_soft[1]"),
    ("len(p1_soft) > 0 AND NOT vague", "'P1'", "'L1-soft: ' || p1_soft[1]"),
    ("template_tier = 'P1'", "'P1'", "'L2-template: P1 (score=' || CAST(template_score AS VARCHAR) || ')'"),
    ("dup AND tp = 'P1' AND NOT vague", "'P1'", "'L1-duplicate: ' || tkey"),
    ("len(p2) > 0", "'P2'", "'L1-keyword: ' || p2[1]"),
    ("vote IS NOT NULL AND NOT vague", "vote", "'L3-similar-weighted: ' || vote"),
    ("vague", "'P3'", "'L1-vague'"),
    ("len(p3) > 0", "'P3'", "'L1-keyword: ' || p3[1]"),
]
SCORED = f"""{PARSED}{CORPUS}, {_TEMPLATE}, {_FACTS}, {_M}, {_VOTE},
 joined AS (SELECT p.report_id, impact, reproducibility, length(regexp_replace(raw_text, '^\\s+|\\s+$', '', 'g')) < 350 AND len(steps) = 0 AS vague, f.* EXCLUDE (report_id),
   template_tier, template_score, vote, n_voters, m.similarity AS tsim, coalesce(m.similarity >= 0.80, false) AS dup, m.priority AS tp, CAST(m.key AS VARCHAR) AS tkey
   FROM parsed p JOIN facts f USING (report_id) JOIN tpl USING (report_id) LEFT JOIN vote ON vote.query_id = p.report_id LEFT JOIN (SELECT * FROM matches WHERE rank = 1) m ON m.query_id = p.report_id),
 sc1 AS (SELECT report_id, CASE {" ".join(f"WHEN {c} THEN {p}" for c, p, _ in _STEPS)} ELSE {_IMPACT} END AS priority,
   CASE {" ".join(f"WHEN {c} THEN {path}" for c, _, path in _STEPS)} ELSE 'L4-impact-fallback' END AS scoring_path FROM joined)"""


def summarised_matches(spark, sf) -> DataFrame:
    m = s.vector_matches(spark, sf, 5)
    return m.withColumns({
        "summary": F.concat(F.lit("ticket "), F.col("key").cast("string")),
        "is_duplicate_candidate": F.col("similarity") >= lx.VECTOR_DUPLICATE,
    })


def scored(spark, sf) -> DataFrame:
    reports = materialise(parsed(spark, sf), "parsed")  # read by two branches
    return priority.score_priority(reports, summarised_matches(spark, sf))


@query("score_priority", f"{SCORED} SELECT report_id, priority, {sql_case('priority', lx.PRIORITY_ID)} AS priority_id, {sql_case('priority', lx.SEVERITY)} AS severity, scoring_path FROM sc1")
def score_priority(spark, sf):
    return scored(spark, sf).drop("justification")


@query("priority_justification", f"""{SCORED} SELECT report_id, s.priority, concat_ws(' ', s.priority || ' decided by ' || scoring_path || '.', CASE WHEN vague THEN 'The report is vague.' END,
  CASE WHEN tkey IS NOT NULL THEN 'Nearest ticket: ' || tkey || ' (' || coalesce(tp, 'no priority') || ', similarity ' || CAST(floor(tsim * 100) AS BIGINT) || ' %).' END,
  CASE WHEN vote IS NOT NULL THEN n_voters || ' similar tickets vote for ' || vote || '.' END) AS justification FROM sc1 s JOIN joined USING (report_id)""")
def priority_justification(spark, sf):
    return scored(spark, sf).select("report_id", "priority", "justification")


# --- owners -----------------------------------------------------------------------------------

_STAFF = f"""mgr AS ({s.MANAGERS_SQL}), tmgr AS ({s.TEAM_MANAGERS_SQL}),
 roster AS (SELECT component, assignee AS name, count(*) AS bug_count FROM ({s.TICKETS_SQL}) WHERE assignee NOT IN (SELECT manager FROM mgr) GROUP BY 1, 2 HAVING count(*) >= {{n}}),
 routed AS ({s.ROUTED_SQL})"""


def _roster(spark, sf, minimum: int = 2) -> DataFrame:
    return routing.roster_build(s.tickets(spark, sf), s.managers(spark, sf), minimum)


@query("roster_build", f"WITH {_STAFF.format(n=2)} SELECT component, name, bug_count, CAST(row_number() OVER (PARTITION BY component ORDER BY bug_count DESC, name) AS INT) AS place FROM roster")
def roster_build(spark, sf):
    return _roster(spark, sf).select("component", "name", "bug_count", "place")


_SAME = f"{_M}, {_STAFF.format(n=10)}, same AS (SELECT m.* FROM matches m JOIN routed r ON r.query_id = m.query_id AND r.component = m.component)"


@query("component_match_join", f"WITH {_SAME} SELECT query_id, key, component FROM same")
def component_match_join(spark, sf):
    return routing.component_match_join(s.vector_matches(spark, sf, 5), s.routed(spark, sf)).select("query_id", "key", "component")


@query("roster_semi_join", f"WITH {_SAME} SELECT query_id, key, assignee FROM matches m WHERE EXISTS (SELECT 1 FROM roster r WHERE r.component = m.component AND r.name = m.assignee)")
def roster_semi_join(spark, sf):
    return routing.roster_semi_join(s.vector_matches(spark, sf, 5), _roster(spark, sf, 10)).select("query_id", "key", "assignee")


@query("manager_anti_join", f"WITH {_SAME} SELECT query_id, key, assignee FROM matches WHERE assignee NOT IN (SELECT manager FROM mgr)")
def manager_anti_join(spark, sf):
    return routing.manager_anti_join(s.vector_matches(spark, sf, 5), s.managers(spark, sf)).select("query_id", "key", "assignee")


@query("manager_lookup", f"WITH {_STAFF.format(n=2)} SELECT query_id, component, manager FROM routed LEFT JOIN tmgr USING (component)")
def manager_lookup(spark, sf):
    return routing.manager_lookup(s.routed(spark, sf), s.team_managers(spark, sf)).select("query_id", "component", "manager")


_CLOSEST = """near AS (SELECT * FROM (SELECT query_id, assignee AS manager, key, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, rank) AS p
  FROM {} WHERE assignee IN (SELECT manager FROM mgr)) WHERE p = 1)"""


@query("closest_manager", f"WITH {_SAME}, {_CLOSEST.format('matches')} SELECT query_id, manager, key, similarity FROM near")
def closest_manager(spark, sf):
    return routing.closest_manager(s.vector_matches(spark, sf, 5), s.managers(spark, sf))


_ROUTED = f"""WITH {_SAME}, {_CLOSEST.format('same')}, eng AS (SELECT query_id, assignee, count(*) AS n, min(rank) AS fr FROM same s WHERE assignee NOT IN (SELECT manager FROM mgr)
   AND EXISTS (SELECT 1 FROM roster r WHERE r.component = s.component AND r.name = s.assignee) GROUP BY 1, 2),
 best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, fr) AS p FROM eng) WHERE p = 1),
 owner AS (SELECT r.query_id, CASE WHEN b.assignee IS NOT NULL THEN b.assignee WHEN n.manager IS NOT NULL THEN n.manager ELSE t.manager END AS suggested_owner,
   CASE WHEN b.assignee IS NOT NULL THEN 'frequency-fallback' WHEN n.manager IS NOT NULL THEN 'manager-from-similar-bug' WHEN t.manager IS NOT NULL THEN 'manager-escalation' ELSE 'no-candidates' END AS method
   FROM routed r LEFT JOIN best b USING (query_id) LEFT JOIN near n USING (query_id) LEFT JOIN tmgr t USING (component))"""


def owners(spark, sf) -> DataFrame:
    return routing.owner_routed(
        s.routed(spark, sf), s.vector_matches(spark, sf, 5), _roster(spark, sf, 10), s.managers(spark, sf), s.team_managers(spark, sf)
    )


@query("owner_routed", f"{_ROUTED} SELECT * FROM owner")
def owner_routed(spark, sf):
    return owners(spark, sf).select("query_id", "suggested_owner", "method")


@query("owner_options", f"""WITH {_STAFF.format(n=10)}, rows AS (SELECT manager AS name, 0 AS pref, 'Manager' AS team FROM mgr UNION ALL SELECT name, 1, component FROM roster
   UNION ALL SELECT s_name, 2, '?' FROM supplier)
  SELECT name, team FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY pref, team) AS p FROM rows) WHERE p = 1""")
def owner_options(spark, sf):
    suggested = table(spark, sf, "supplier").select(F.col("s_name").alias("suggested_owner"))
    return routing.owner_options(_roster(spark, sf, 10), s.managers(spark, sf), suggested)
