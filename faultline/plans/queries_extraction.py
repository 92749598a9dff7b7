"""Queries over report text: extraction, gates on text, keyword signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline import lexicons as lx
from faultline.functions import extract as x
from faultline.functions import text as t
from faultline.operators import extraction, priority, quality
from faultline.plans import standins as s
from faultline.plans.registry import q, query, sql_any, sql_ladder, sql_list, sql_pattern, sql_strip, sql_word, table
from faultline.sources import issues as src
from faultline.sources import reports as rep
from faultline.session import materialise

PRODUCT = "App"
BASE = f"WITH {s.REPORTS_CTE}, r AS (SELECT *, {sql_strip('raw_text')} AS t FROM rep)"

# --- SQL of the single fields, over column t -------------------------------------
EMAIL = r"nullif(regexp_extract(regexp_extract(t, '(?im)^From:\s*(.+)$', 1), '[\w.+\-]+@[\w.\-]+\.\w+', 0), '')"
_BARE = sql_strip(r"nullif(regexp_extract(t, '(?m)^\s*From:\s*([^\n<]+?)\s*$', 1), '')")
_PARTS = f"list_filter(string_split_regex(split_part({EMAIL}, '@', 1), '[._]'), lambda p: p <> '')"
NAME = f"""coalesce(
  nullif(regexp_extract(t, '(?m)^\\s*From:\\s*"?([^"<\\n]+?)"?\\s*<[^>]+>\\s*$', 1), ''),
  CASE WHEN NOT contains({_BARE}, '@') THEN {_BARE} END,
  nullif(regexp_extract(t, '(?m)(?:Regards|Thanks|Cheers|Best)[,\\s]*\\n\\s*([A-Z][a-z]+(?: [A-Z][a-z]+)+)', 1), ''),
  nullif(regexp_extract(t, '(?m)^-\\s*([A-Z][a-z]+(?: [A-Z][a-z]+)+)\\s*$', 1), ''),
  array_to_string(list_transform({_PARTS}, lambda p: upper(substr(p, 1, 1)) || lower(substr(p, 2))), ' '))"""
_RAW_SUBJECT = sql_strip(r"regexp_extract(t, '(?im)^Subject:(.*)$', 1)")
_SUBJECT = sql_strip(f"regexp_replace({_RAW_SUBJECT}, '^(Re|Fwd|FW):\\s*', '', 'i')")
_SUBJECT = sql_strip(f"regexp_replace({_SUBJECT}, '\\[(URGENT|{PRODUCT}|BUG|CRITICAL)\\]\\s*', '', 'gi')")
_LINE = f"""list_filter(string_split(t, chr(10)), lambda l: {sql_strip('l')} <> ''
  AND NOT regexp_matches(l, '(?i)^(From|To|Subject|Date):'))[1]"""
TITLE = f"""CASE WHEN regexp_matches(t, '(?im)^Subject:')
  THEN CASE WHEN starts_with({_SUBJECT}, '[') THEN {_SUBJECT}
    ELSE concat({sql_ladder(f'lower({_SUBJECT})', lx.MODULE_RULES, f'[{PRODUCT}]')}, ': ', {_SUBJECT}) END
  ELSE concat({sql_ladder(f'lower({_LINE})', lx.MODULE_RULES, f'[{PRODUCT}]')}, ': ', substr({sql_strip(_LINE)}, 1, 80)) END"""
_PLATFORM = r"lower(regexp_extract(t, '(?i)Platform:\s*([\w,/ ]+)', 1))"
PLATFORM = f"""CASE WHEN contains({_PLATFORM}, 'android') AND (contains({_PLATFORM}, 'ios') OR contains({_PLATFORM}, 'web')) THEN 'Android, iOS, Web'
  WHEN contains({_PLATFORM}, 'android') THEN 'Android' WHEN contains({_PLATFORM}, 'ios') THEN 'iOS' WHEN contains({_PLATFORM}, 'web') THEN 'Web'
  ELSE coalesce(nullif(concat_ws(', ', CASE WHEN regexp_matches(t, '(?i)' || {q(sql_word('android'))}) THEN 'Android' END,
    CASE WHEN regexp_matches(t, '(?i)' || {q(sql_word('ios'))}) THEN 'iOS' END, CASE WHEN regexp_matches(t, '(?i)' || {q(sql_word('web'))}) THEN 'Web' END), ''), 'Unknown') END"""
VERSION = r"""coalesce(
  nullif(regexp_extract(t, '(?i)(?:App\s*Version|Version):\s*v?(\d+\.\d+(?:\.\d+)?)', 1), ''),
  nullif(regexp_extract(t, '(?i)\bv(\d+\.\d+\.\d+)\b', 1), ''),
  nullif(regexp_extract(t, '(?i)\bversion\s+(\d+\.\d+(?:\.\d+)?)\b', 1), ''))"""
_REPRO = sql_strip(r"lower(regexp_extract(t, '(?i)Reproducibility[:\s]+(.+?)(?:\.|$|\n)', 1))")
_PERCENT = f"regexp_extract({_REPRO}, '~?(\\d+)%', 1)"
REPRO = f"""CASE WHEN {sql_any(_REPRO, ['100', 'every time', 'always', 'consistent'])} THEN '100%'
  WHEN {sql_any(_REPRO, ['intermittent', 'sometimes', 'occasional'])} THEN 'intermittent'
  WHEN contains({_REPRO}, 'conditional') THEN 'conditional' WHEN {_PERCENT} <> '' THEN concat('~', {_PERCENT}, '%')
  WHEN {sql_any('lower(t)', ['100% reproducible', 'every single time', '100% consistent'])} THEN '100%'
  WHEN regexp_matches(lower(t), '\\b100%\\b') THEN '100%'
  WHEN {sql_any('lower(t)', ['every time', 'always'])} THEN '100%' WHEN contains(lower(t), 'intermittent') THEN 'intermittent'
  ELSE 'unknown' END"""


def _run(lines: str, item: str) -> str:
    """Item lines from the first one up to the next blank line, marks removed."""
    first = f"coalesce(list_position(list_transform({lines}, lambda l: regexp_matches(l, '{item}')), true), 0)"
    rest = f"CASE WHEN {first} > 0 THEN ({lines})[{first}:] ELSE []::VARCHAR[] END"
    blank = f"coalesce(list_position({rest}, ''), 0)"
    run = f"CASE WHEN {blank} > 0 THEN ({rest})[1:{blank} - 1] ELSE {rest} END"
    return (f"list_transform(list_filter({run}, lambda l: regexp_matches(l, '{item}')), "
            f"lambda l: {sql_strip(f'''regexp_replace(l, '{item}', '')''')})")


# Fields that need several steps get a CTE each.
STEPS = f""", st AS (SELECT *,
   list_transform(string_split(regexp_replace(regexp_extract(t,
     '(?i)(?:Steps to Reproduce|Steps|Reproduction Steps)[:\\s]*\\n((?s:.+))$', 1), '(?is)\\n\\s*\\n\\s*[A-Z].*$', ''), chr(10)),
     lambda l: {sql_strip('l')}) AS block,
   string_split(t, chr(10)) AS ls FROM r),
 st2 AS (SELECT *, coalesce(list_position(list_transform(ls, lambda l: regexp_matches(l, '(?i)steps?\\s*(to\\s*)?(reproduce|repro)')), true), 0) AS m FROM st),
 st3 AS (SELECT *, CASE WHEN m > 0 THEN list_transform(list_filter(ls[m:], lambda l: NOT regexp_matches(l, '(?i)steps?\\s*(to\\s*)?(reproduce|repro)')),
   lambda l: {sql_strip('l')}) ELSE []::VARCHAR[] END AS after FROM st2),
 stp AS (SELECT report_id, CASE WHEN len(a) > 0 THEN a ELSE b END AS steps FROM
   (SELECT report_id, {_run('block', '^([0-9]+[.)]|[-•*])\\s+')} AS a, {_run('after', '^[0-9]+[.)]\\s+')} AS b FROM st3))"""


def labelled(label: str) -> str:
    rest = (f"regexp_extract(t || chr(10) || chr(10), '(?i)(?:^|\\n)\\**\\s*{label}(?:\\s+Result)?\\s*[:*]+\\s*\\**\\n?((?s:.+))$', 1)")
    cut = (f"regexp_replace({rest}, '(?is)(\\n\\s*\\n|\\n\\s*(Actual|Expected|Impact|Environment|Repro|Steps|Regards|Thanks)|\\n\\s*$).*$', '')")
    return f"nullif({sql_strip(f'''regexp_replace({cut}, '[*]+', '', 'g')''')}, '')"


EXPECTED = f"coalesce({labelled('Expected Result')}, {labelled('Expected')}, 'Not provided.')"
ACTUAL = f"coalesce({labelled('Actual Result')}, {labelled('Actual')}, 'Not provided.')"
IMPACT = f"coalesce({labelled('Impact')}, 'Not provided.')"
COMPONENT = "CASE " + " ".join(
    f"WHEN {sql_any('c', ps)}" + (f" OR regexp_matches(c, {q(sql_word('anr'))})" if label == "immersive" else "") + f" THEN {q(label)}"
    for label, ps in lx.COMPONENT_RULES
) + " ELSE 'bugs' END"
_HDR = "(?i)^(From|To|Subject|Date):"
_SEC = "(?i)^(Steps|Expected|Actual|Impact|Environment|Reproducibility|Additional)"
DESCRIPTION = f""", d1 AS (SELECT report_id, string_split(t, chr(10)) AS ls FROM r),
 d2 AS (SELECT *, coalesce(list_position(list_transform(ls, lambda l: regexp_matches(l, '{_HDR}')), true), 0) AS h FROM d1),
 d3 AS (SELECT report_id, CASE WHEN h > 0 THEN list_transform(list_filter(ls[h:], lambda l: NOT regexp_matches(l, '{_HDR}')), lambda l: {sql_strip('l')}) ELSE []::VARCHAR[] END AS b FROM d2),
 d4 AS (SELECT report_id, b, coalesce(list_position(list_transform(b, lambda l: l <> ''), true), 0) AS p FROM d3),
 d5 AS (SELECT report_id, CASE WHEN p > 0 THEN b[p:] ELSE []::VARCHAR[] END AS b FROM d4),
 d6 AS (SELECT report_id, CASE WHEN coalesce(list_position(b, ''), 0) > 0 THEN b[1:list_position(b, '') - 1] ELSE b END AS b FROM d5),
 d7 AS (SELECT report_id, b, coalesce(list_position(list_transform(b, lambda l: regexp_matches(l, '{_SEC}')), true), 0) AS c FROM d6),
 d8 AS (SELECT report_id, CASE WHEN c = 1 THEN []::VARCHAR[] WHEN c > 1 THEN b[1:c - 1] ELSE b END AS b FROM d7),
 d9 AS (SELECT report_id, array_to_string(list_transform(b[1:6], lambda l: regexp_replace(l, '[*]+', '', 'g')), ' ') AS raw FROM d8),
 d10 AS (SELECT report_id, raw, array_to_string(string_split(regexp_replace(raw, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))[1:3], ' ') AS short FROM d9),
 dsc AS (SELECT report_id, CASE WHEN raw = '' THEN 'See full bug report for details.'
   WHEN length(short) > 450 THEN substr(short, 1, 450) || '...' ELSE short END AS description FROM d10)"""
TITLED = f", ti AS (SELECT *, {TITLE} AS title FROM r), co AS (SELECT *, lower(t || ' ' || title) AS c FROM ti)"


for _name, _id, _make, _sql in [
    ("reporter_email", "x_reporter_email", lambda c: x.reporter_email(c), EMAIL),
    ("reporter_name", "x_reporter_name", lambda c: x.reporter_name(c), NAME),
    ("title", "x_title", lambda c: x.title(c, product=PRODUCT), TITLE),
    ("module", "x_module_prefix", lambda c: x.module_prefix(c, default=f"[{PRODUCT}]"), sql_ladder("lower(t)", lx.MODULE_RULES, f"[{PRODUCT}]")),
    ("platform", "x_platform", lambda c: x.platform(c), PLATFORM),
    ("app_version", "x_version", lambda c: x.version(c), VERSION),
    ("reproducibility", "x_reproducibility", lambda c: x.reproducibility(c), REPRO),
]:
    def _register(name=_name, id_=_id, make=_make, sql=_sql):
        @query(id_, f"{BASE} SELECT report_id, {sql} AS {name} FROM r")
        def run(spark, sf):
            texts = s.reports(spark, sf).select("report_id", t.strip(F.col("raw_text")).alias("t"))
            return texts.select("report_id", make(F.col("t")).alias(name))

    _register()


def _texts(spark, sf) -> DataFrame:
    return s.reports(spark, sf).select("report_id", t.strip(F.col("raw_text")).alias("t"))


@query("x_steps", f"{BASE}{STEPS} SELECT report_id, len(steps) AS n_steps, array_to_string(steps, ' > ') AS steps FROM stp")
def x_steps(spark, sf):
    found = _texts(spark, sf).select("report_id", x.steps(F.col("t")).alias("s"))
    return found.select("report_id", F.size("s").cast("bigint").alias("n_steps"), F.array_join("s", " > ").alias("steps"))


@query("x_labeled_field", f"{BASE} SELECT report_id, {EXPECTED} AS expected_result, {ACTUAL} AS actual_result, {IMPACT} AS impact FROM r")
def x_labeled_field(spark, sf):
    c = F.col("t")
    return _texts(spark, sf).select(
        "report_id",
        x.labelled_field(c, ["Expected Result", "Expected"]).alias("expected_result"),
        x.labelled_field(c, ["Actual Result", "Actual"]).alias("actual_result"),
        x.labelled_field(c, ["Impact"]).alias("impact"),
    )


@query("x_component", f"{BASE}{TITLED} SELECT report_id, {COMPONENT} AS component_hint FROM co")
def x_component(spark, sf):
    titled = _texts(spark, sf).withColumn("title", x.title(F.col("t"), product=PRODUCT))
    return titled.select("report_id", x.component(F.col("t"), F.col("title")).alias("component_hint"))


@query("x_description", f"{BASE}{DESCRIPTION} SELECT report_id, description FROM dsc")
def x_description(spark, sf):
    return _texts(spark, sf).select("report_id", x.description(F.col("t")).alias("description"))


PARSED = f"""{BASE}{STEPS}{DESCRIPTION}{TITLED}, parsed AS (
  SELECT co.report_id, title, description, steps, {EXPECTED} AS expected_result, {ACTUAL} AS actual_result, {IMPACT} AS impact,
    {PLATFORM} AS platform, {VERSION} AS app_version, {COMPONENT} AS component_hint, {REPRO} AS reproducibility,
    {EMAIL} AS reporter_email, {NAME} AS reporter_name, raw_text
  FROM co JOIN stp USING (report_id) JOIN dsc USING (report_id))"""


def parsed(spark, sf) -> DataFrame:
    return extraction.parse_reports(s.reports(spark, sf), product=PRODUCT)


@query("parse_reports", f"""{PARSED} SELECT report_id, title, description, array_to_string(steps, ' > ') AS steps, expected_result,
  actual_result, impact, platform, app_version, component_hint, reproducibility, reporter_email, reporter_name FROM parsed""")
def parse_reports(spark, sf):
    return parsed(spark, sf).select(
        "report_id", "title", "description", F.array_join("steps_to_reproduce", " > ").alias("steps"), "expected_result",
        "actual_result", "impact", "platform", "app_version", "component_hint", "reproducibility", "reporter_email", "reporter_name",
    )


# --- gates on text ---------------------------------------------------------------

_LOW = f"lower({sql_strip('raw_text')})"
MISSING = "list_filter([" + ", ".join(
    [f"CASE WHEN length({sql_strip('raw_text')}) < 300 THEN 'fewer than 300 characters' END"]
    + [f"CASE WHEN NOT {sql_any(_LOW, ps)} THEN {q(f'''section '{label}' is missing''')} END" for label, ps in lx.REQUIRED_SECTIONS]
    + [f"CASE WHEN len(steps) = 0 AND {sql_any(_LOW, lx.REQUIRED_SECTIONS[0][1])} THEN 'steps are announced but cannot be read' END"]
).replace("\nsteps:", "' || chr(10) || 'steps:") + "], lambda m: m IS NOT NULL)"
VAGUE_CTE = f""", vague AS (SELECT report_id, 'vague_report' AS type,
  concat('Details are missing: ', array_to_string(m, '; '), '.') AS message
  FROM (SELECT report_id, {MISSING} AS m FROM r JOIN stp USING (report_id)) WHERE len(m) >= 2)"""


@query("gate_vague_report", f"{BASE}{STEPS}{VAGUE_CTE} SELECT * FROM vague")
def gate_vague_report(spark, sf):
    return quality.gate_vague_report(parsed(spark, sf)).select("report_id", "type", "message")


def _words(expr: str) -> str:
    return (f"list_distinct(list_filter(regexp_extract_all(lower({expr}), '[a-z]+'), "
            f"lambda w: length(w) > 2 AND w NOT IN ({sql_list(lx.CONSISTENCY_STOP_WORDS)})))")


CONSISTENCY_CTE = f""", words AS (SELECT report_id, {_words('title')} AS tw, {_words('description')} AS sw, {_words("array_to_string(steps, ' ')")} AS stw FROM parsed),
 apart AS (SELECT report_id, 'form_fields_inconsistent' AS type FROM words
  WHERE len(tw) >= 6 AND len(sw) >= 6 AND NOT list_has_any(tw, sw) AND NOT list_has_any(tw, stw))"""


# The title of a stand-in report is the start of its own text, so the gate is
# run on the report of the next number as the description.
@query("gate_field_consistency", f"""{PARSED}, nxt AS (SELECT a.report_id, a.title, b.description, a.steps FROM parsed a JOIN parsed b ON b.report_id = a.report_id + 1),
 words AS (SELECT report_id, {_words('title')} AS tw, {_words('description')} AS sw, {_words("array_to_string(steps, ' ')")} AS stw FROM nxt)
 SELECT report_id, 'form_fields_inconsistent' AS type FROM words
  WHERE len(tw) >= 6 AND len(sw) >= 6 AND NOT list_has_any(tw, sw) AND NOT list_has_any(tw, stw)""")
def gate_field_consistency(spark, sf):
    own = parsed(spark, sf)
    other = own.select((F.col("report_id") - 1).alias("report_id"), "description")
    mixed = own.select("report_id", "title", "steps_to_reproduce").join(other, "report_id")
    return quality.gate_field_consistency(mixed).select("report_id", "type")


@query("quality_issue_rollup", f"""{PARSED}{VAGUE_CTE}{CONSISTENCY_CTE},
  issues AS (SELECT report_id, type FROM vague UNION ALL SELECT report_id, type FROM apart)
  SELECT report_id, count(*) AS n_issues, array_to_string(list_sort(list_distinct(list(type))), ',') AS kinds,
    CASE WHEN bool_or(type = 'vague_report') THEN 'vague_report' ELSE 'form_fields_inconsistent' END AS banner
  FROM issues GROUP BY report_id""")
def quality_issue_rollup(spark, sf):
    p = parsed(spark, sf)
    return quality.quality_issue_rollup(quality.quality_issues(quality.gate_vague_report(p), quality.gate_field_consistency(p)))


@query("releasable_drafts", f"{BASE}{STEPS}{VAGUE_CTE} SELECT report_id FROM r WHERE report_id NOT IN (SELECT report_id FROM vague)")
def releasable_drafts(spark, sf):
    p = parsed(spark, sf)
    return quality.releasable(p.select("report_id"), quality.gate_vague_report(p))


@query("is_vague", f"{BASE}{STEPS} SELECT report_id, length(t) < 350 AND len(steps) = 0 AS vague FROM r JOIN stp USING (report_id)")
def is_vague(spark, sf):
    p = parsed(spark, sf)
    return p.select("report_id", priority.is_vague(F.col("raw_text"), F.col("steps_to_reproduce")).alias("vague"))


# --- signals ------------------------------------------------------------------------

CORPUS = """, corpus AS (SELECT report_id, lower(concat_ws(' ', nullif(title, ''), nullif(description, ''), nullif(impact, ''), nullif(actual_result, ''), nullif(raw_text, ''))) AS corpus FROM parsed)"""


def hits_sql(tier: str, patterns: list[str]) -> str:
    tests = [
        (f"regexp_matches(corpus, {q(sql_pattern(p))})" if tier in lx.REGEX_TIERS else f"contains(corpus, {q(p)})") + f" THEN {q(p)}"
        for p in patterns
    ]
    return "list_filter([" + ", ".join(f"CASE WHEN {c} END" for c in tests) + "], lambda h: h IS NOT NULL)"


@query("keyword_hits", f"{PARSED}{CORPUS} SELECT report_id, " + ", ".join(
    f"array_to_string({hits_sql(tier, ps)}, ' | ') AS {tier}" for tier, ps in lx.SIGNALS.items()) + " FROM corpus")
def keyword_hits(spark, sf):
    corpus = parsed(spark, sf).select("report_id", extraction.scoring_corpus().alias("corpus"))
    hits = extraction.keyword_hits(corpus)
    return hits.select("report_id", *[F.array_join(tier, " | ").alias(tier) for tier in lx.SIGNALS])


_ENTRIES = [(i, label, p) for i, (label, p) in enumerate(((label, p) for label, ps in lx.COMPONENT_RULES for p in ps), 1)]


@query("lexicon_join", f"""{BASE}, lex(rank, label, pattern) AS (VALUES {", ".join(f"({i}, {q(l)}, {q(p)})" for i, l, p in _ENTRIES)})
  SELECT report_id, rank, label, pattern FROM r JOIN lex ON contains(lower(t), pattern)""")
def lexicon_join(spark, sf):
    corpus = s.reports(spark, sf).select("report_id", F.lower(t.strip(F.col("raw_text"))).alias("corpus"))
    return extraction.lexicon_join(corpus, lx.COMPONENT_RULES)


# A lexicon of the size of a real one: the 10,000 most frequent pairs of neighbouring words.
_PAIRS = """pairs AS (SELECT w[k] || ' ' || w[k + 1] AS pattern, count(*) AS n
   FROM (SELECT w, unnest(range(1, len(w))) AS k FROM (SELECT string_split(lower(text), ' ') AS w FROM documents)) GROUP BY 1),
 lex AS (SELECT row_number() OVER (ORDER BY n DESC, pattern) AS rank, split_part(pattern, ' ', 1) AS label, pattern
   FROM (SELECT * FROM pairs WHERE length(pattern) >= 5 ORDER BY n DESC, pattern LIMIT 10000))"""


def pair_lexicon(spark, sf) -> DataFrame:
    words = table(spark, sf, "documents").select(F.split(F.lower("text"), " ", -1).alias("w"))
    firsts = F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0)))
    pairs = F.zip_with(firsts, F.slice("w", 2, F.size("w")), lambda a, b: F.concat(a, F.lit(" "), b))
    counts = words.select(F.explode_outer(pairs).alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n"))
    top = counts.where("length(pattern) >= 5").orderBy(F.desc("n"), "pattern").limit(10_000)
    ranked = top.select("pattern", F.row_number().over(Window.orderBy(F.desc("n"), "pattern")).alias("rank"))
    return materialise(ranked.withColumn("label", F.split_part("pattern", F.lit(" "), F.lit(1))), "lexicon")


@query("lexicon_table_join", f"""WITH {_PAIRS}
 SELECT doc_id AS report_id, count(*) AS n_entries, sum(rank)::BIGINT AS ranks, max(pattern) AS last_pattern
 FROM documents JOIN lex ON contains(lower(text), pattern) GROUP BY 1""")
def lexicon_table_join(spark, sf):
    corpus = table(spark, sf, "documents").select(F.col("doc_id").alias("report_id"), F.lower("text").alias("corpus"))
    found = extraction.lexicon_join(corpus, pair_lexicon(spark, sf))
    return found.groupBy("report_id").agg(
        F.count("*").alias("n_entries"), F.sum("rank").alias("ranks"), F.max("pattern").alias("last_pattern")
    )


@query("component_table", f"""WITH {_PAIRS}
 SELECT doc_id AS report_id, coalesce(arg_min(label, rank), {q(lx.CATCH_ALL)}) AS component_hint
 FROM documents LEFT JOIN lex ON contains(lower(text), pattern) GROUP BY 1""")
def component_table(spark, sf):
    corpus = table(spark, sf, "documents").select(F.col("doc_id").alias("report_id"), F.lower("text").alias("corpus"))
    return extraction.route_components(corpus, pair_lexicon(spark, sf))


# --- other text sources -----------------------------------------------------------------


@query("issue_text", f"SELECT page_id, {sql_strip('''url || chr(10) || ''' + sql_strip('''regexp_replace(html, '<[^>]+>', ' ', 'g')'''))} AS text FROM pages")
def issue_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", src.issue_text(F.col("url"), F.col("html")).alias("text"))


@query("issue_training_text", f"""SELECT doc_id, CASE WHEN starts_with(text, first) THEN text ELSE {sql_strip("first || chr(10) || text")} END AS text
  FROM (SELECT doc_id, text, CASE WHEN doc_id % 2 = 0 THEN split_part(text, '.', 1) ELSE source END AS first FROM documents)""")
def issue_training_text(spark, sf):
    summary = F.when(F.col("doc_id") % 2 == 0, F.split_part("text", F.lit("."), F.lit(1))).otherwise(F.col("source"))
    return table(spark, sf, "documents").select("doc_id", src.training_text(summary, F.col("text")).alias("text"))


def _tree() -> Column:
    """A document whose lines are paragraphs, each with an empty second text."""

    def node(line: Column) -> Column:
        return F.struct(F.lit("text").alias("type"), line.alias("text"))

    paragraphs = F.transform(
        F.split("text", "\n"),
        lambda line: F.struct(F.lit("paragraph").alias("type"), F.array(node(line), node(F.lit(""))).alias("content")),
    )
    return F.to_json(F.struct(F.lit("doc").alias("type"), paragraphs.alias("content")))


@query("doc_tree_text", "SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda l: l <> ''), ' ') AS text FROM documents")
def doc_tree_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", src.doc_tree_text(_tree()).alias("text"))


@query("ticket_search_text", f"SELECT doc_id, concat_ws(chr(10), nullif({sql_strip('source')}, ''), nullif({sql_strip('text')}, '')) AS text FROM documents")
def ticket_search_text(spark, sf):
    from faultline.operators.tickets import ticket_search_text as make

    return table(spark, sf, "documents").select("doc_id", make(F.col("source"), F.col("text")).alias("text"))


_FORM_SQL = """SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '' ELSE concat('  ', split_part(text, chr(10), 1)) END AS title,
  CASE turn % 4 WHEN 0 THEN 'Unknown' WHEN 1 THEN 'Android' WHEN 2 THEN '' ELSE 'iOS' END AS platform,
  CASE WHEN turn % 5 = 0 THEN '' ELSE text END AS summary,
  CASE WHEN turn % 2 = 0 THEN concat('1. ', text, chr(10), chr(10), '- last') ELSE '' END AS steps,
  CASE WHEN turn % 3 = 1 THEN role ELSE '' END AS reporter FROM conversations"""


@query("src_form_reports", f"""WITH f AS ({_FORM_SQL}), g AS (SELECT conv_id, turn, {sql_strip('title')} AS title, platform, {sql_strip('summary')} AS summary, reporter,
   list_filter(list_transform(string_split(steps, chr(10)), lambda l: {sql_strip('l')}), lambda l: l <> '') AS st FROM f),
 h AS (SELECT *, list_transform(st, lambda l, i: CAST(i AS VARCHAR) || '. ' || regexp_replace(l, '^\\s*(?:\\d+[\\.\\)]\\s*|[-*]\\s*)', '')) AS ns FROM g)
 SELECT conv_id || '-' || turn AS report_id, CASE WHEN title = '' AND summary = '' THEN '' ELSE regexp_replace(array_to_string(list_filter([
   CASE WHEN reporter <> '' THEN 'From: ' || reporter END, CASE WHEN title <> '' THEN 'Subject: ' || title END,
   CASE WHEN reporter <> '' OR title <> '' THEN '' END,
   CASE WHEN platform NOT IN ('', 'Unknown') THEN 'Platform: ' || platform || chr(10) END,
   CASE WHEN summary <> '' THEN 'Description:' || chr(10) || summary || chr(10) END,
   CASE WHEN len(ns) > 0 THEN 'Steps to Reproduce:' || chr(10) || array_to_string(ns, chr(10)) || chr(10) END], lambda p: p IS NOT NULL), chr(10)), '\\s+$', '') || chr(10) END AS raw_text FROM h""")
def src_form_reports(spark, sf):
    s.views(spark, sf, "conversations")
    forms = spark.sql(_FORM_SQL).withColumn("report_id", F.concat_ws("-", "conv_id", "turn"))
    return rep.form_reports(forms)


@query("json_from_text", """SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL ELSE props END AS json FROM events""")
def json_from_text(spark, sf):
    p = F.col("props")
    reply = (
        F.when(F.col("event_id") % 4 == 0, p)
        .when(F.col("event_id") % 4 == 1, F.concat(F.lit("```json\n"), p, F.lit("\n```")))
        .when(F.col("event_id") % 4 == 2, F.concat(F.lit("Let me think: "), p, F.lit(" and {more}")))
        .otherwise(F.concat(F.lit("no "), F.col("event_type")))
    )
    return table(spark, sf, "events").select("event_id", t.json_from_text(reply).alias("json"))
