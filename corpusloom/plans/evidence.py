"""Queries over the keyword hits of benchmark passages: scores, gates, selection, sentences and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import dictionaries as D
from corpusloom.functions import text as T
from corpusloom.operators import evidence as E
from corpusloom.operators.querylog import classify_intent
from corpusloom.plans.base import ladder_sql, query
from corpusloom.plans.retrieval import HITS, hits, overlap_sql, passages, terms_sql
from corpusloom.sources.tables import table


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hits(spark, sf_dir).withColumn("method", F.lit("keyword")).withColumn("rrf", 2.0 / (60 + F.col("rank")))
    return E.evidence_score(rows.withColumn("score", F.col("score") / 2))


def _named(column: str) -> str:
    words = "list_filter(list_distinct(regexp_extract_all(lower(query), '[a-z0-9]+')), lambda x: length(x) >= 4)"
    return f"len(list_filter({words}, lambda x: contains(lower({column}), x))) > 0"


SCORED = f"""{HITS}, scored AS (SELECT *, round(least(1.0::DOUBLE, score / 2 + 0.0::DOUBLE + 0.15::DOUBLE + CASE WHEN {_named("heading")} THEN 0.10::DOUBLE ELSE 0.0 END
  + CASE WHEN {_named("section")} THEN 0.05::DOUBLE ELSE 0.0 END + CASE WHEN {_named("filename")} THEN 0.10::DOUBLE ELSE 0.0 END
  + 0.5::DOUBLE * (2.0::DOUBLE / (60 + rank)) + 0.20::DOUBLE * {overlap_sql("query", "text")}), 6) AS evidence_score FROM hits)"""


@query(f"WITH {SCORED} SELECT query_id, chunk_id, evidence_score FROM scored")
def evidence_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("query_id", "chunk_id", "evidence_score")


@query(
    rf"""WITH {SCORED}, g AS (SELECT CASE WHEN chunk_type = 'heading' AND length(text) < 50 THEN 'HEADING_ONLY' WHEN len(regexp_extract_all(text, '[^\s]+')) < 60 THEN 'TOO_SHORT'
WHEN evidence_score < 0.6 THEN 'BELOW_THRESHOLD' END AS reason FROM scored) SELECT coalesce(reason, 'ACCEPTED') AS reason, count(*) AS chunks FROM g GROUP BY 1"""
)
def evidence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).withColumn("rerank_score", F.col("evidence_score"))
    return E.hits_by_reason(E.gate(rows, weak=0.6, min_words=60))


TIERS = f"""{SCORED}, b AS (SELECT query_id, max(evidence_score) AS best FROM scored GROUP BY 1),
tiers AS (SELECT q.query_id, coalesce(best, 0.0)::DOUBLE AS best, CASE WHEN coalesce(best, 0.0) < {E.REJECT} THEN 'LOW' WHEN best < {E.MEDIUM} THEN 'MEDIUM' ELSE 'HIGH' END AS tier FROM q LEFT JOIN b USING (query_id))"""


@query(f"WITH {TIERS} SELECT query_id, best, tier FROM tiers")
def confidence_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.confidence_tier(passages(spark, sf_dir), scored(spark, sf_dir))


@query(
    f"""WITH {SCORED}, b AS (SELECT query_id, max(round((evidence_score - 0.8) * 40, 4)) AS best FROM scored GROUP BY 1)
SELECT q.query_id, coalesce(best, 0.0)::DOUBLE AS best, CASE WHEN best > 2 THEN 'HIGH' WHEN best > 0 THEN 'MEDIUM' ELSE 'LOW' END AS tier FROM q LEFT JOIN b USING (query_id)"""
)
def confidence_tier_logit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line through the evidence score stands for the reranker's logits."""
    logits = scored(spark, sf_dir).withColumn("logit", F.round((F.col("evidence_score") - 0.8) * 40, 4))
    return E.logit_tier(passages(spark, sf_dir), logits)


@query(
    f"""WITH {TIERS}, r AS (SELECT s.*, tier, row_number() OVER w AS place, coalesce(round(sum(evidence_score) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6), 0) AS before
FROM scored s JOIN tiers USING (query_id) WHERE evidence_score >= {E.REJECT} WINDOW w AS (PARTITION BY query_id ORDER BY evidence_score DESC, chunk_id))
SELECT query_id, chunk_id, place, tier FROM r WHERE NOT ((tier = 'HIGH' AND before > 1.5 AND place > 2) OR (tier = 'MEDIUM' AND place > 4) OR place > 6)"""
)
def adaptive_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir)
    return E.adaptive_select(rows, E.confidence_tier(passages(spark, sf_dir), rows)).select("query_id", "chunk_id", "place", "tier")


_SENT = r"list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) > 0)"
SENTENCES = f"""{HITS}, st AS (SELECT query_id, query, rank, heading, section, {_SENT} AS l FROM hits),
se AS (SELECT query_id, query, rank, heading, section, i - 1 AS pos, l[i] AS sentence FROM st, unnest(range(1, len(l) + 1)) AS t(i) WHERE length(l[i]) >= 15),
sd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, lower(sentence) ORDER BY rank, pos) AS rn FROM se) WHERE rn = 1),
ss AS (SELECT *, {terms_sql("query")} AS qw FROM sd),
sr AS (SELECT *, len(list_intersect(qw, {terms_sql("sentence")})) + len(list_filter(qw, lambda x: contains(lower(heading), x) OR contains(lower(section), x))) AS score FROM ss),
ranked AS (SELECT query_id, sentence, score, place, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank, pos) AS place FROM sr) WHERE place <= 5)"""


@query(f"WITH {SENTENCES} SELECT * FROM ranked")
def rank_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.rank_sentences(hits(spark, sf_dir))


@query()
def mmr_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.mmr_select(E.rank_sentences(hits(spark, sf_dir), 40), 6)


@query(
    f"""WITH {HITS}, f AS (SELECT query_id, filename, chunk_index + 1 AS page, min(rank) AS first FROM hits GROUP BY ALL)
SELECT query_id, filename, page, row_number() OVER (PARTITION BY query_id ORDER BY first, filename, page) AS citation FROM f"""
)
def citation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.citation_index(hits(spark, sf_dir).withColumn("page", F.col("chunk_index") + 1))


MAPPED = f"""{SENTENCES}, drafts AS (SELECT query_id, place, CASE WHEN place = 5 THEN sentence || ' unsaid' ELSE sentence END AS sentence FROM ranked),
met AS (SELECT query_id, place, arg_min(chunk_id, h.rank) AS chunk_id FROM drafts JOIN hits h USING (query_id) WHERE contains(replace(text, ' ', ''), replace(sentence, ' ', '')) GROUP BY ALL),
mapped AS (SELECT query_id, place, sentence, chunk_id FROM drafts LEFT JOIN met USING (query_id, place))"""


def mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best sentences of each query, the fifth with a word that no chunk has."""
    rows = hits(spark, sf_dir)
    sentence = F.when(F.col("place") == 5, F.concat("sentence", F.lit(" unsaid"))).otherwise(F.col("sentence"))
    return E.map_citations(E.rank_sentences(rows).select("query_id", "place", sentence.alias("sentence")), rows)


@query(f"WITH {MAPPED} SELECT * FROM mapped")
def map_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapped(spark, sf_dir)


@query(
    f"""WITH {MAPPED}, e AS (SELECT DISTINCT query_id, chunk_id, 1 AS known FROM hits WHERE rank <= 3)
SELECT query_id, count(*) AS sentences, count(chunk_id) AS cited, count(*) FILTER (chunk_id IS NOT NULL AND known IS NULL) AS unknown,
count(*) = count(chunk_id) AND count(*) FILTER (chunk_id IS NOT NULL AND known IS NULL) = 0 AS supported FROM mapped LEFT JOIN e USING (query_id, chunk_id) GROUP BY query_id"""
)
def grounding_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against the first three hits of each query."""
    return E.grounding_check(mapped(spark, sf_dir), hits(spark, sf_dir).filter("rank <= 3"))


@query(
    rf"""WITH {HITS}, b AS (SELECT *, string_split(regexp_replace(text, '([.!?]) +', '\1' || chr(1), 'g'), chr(1)) AS l FROM hits)
SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY version_id, chunk_index) AS place, array_to_string(l[1:4], ' ') AS excerpt FROM b"""
)
def build_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.build_context(hits(spark, sf_dir)).select("query_id", "chunk_id", "place", "excerpt")


@query(
    f"""WITH {SCORED}, t AS (SELECT *, length(text) // 4 AS tokens FROM scored),
u AS (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY evidence_score DESC, chunk_id ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM t) SELECT query_id, chunk_id, used, row_number() OVER (PARTITION BY query_id ORDER BY version_id, chunk_index) AS place FROM u WHERE used <= 2000"""
)
def fit_token_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).withColumns({"tokens": T.estimate_tokens(F.col("text")), "relevance": F.col("evidence_score")})
    return E.fit_token_window(rows, 2000).select("query_id", "chunk_id", "used", "place")


@query(
    f"""WITH {HITS}, t AS (SELECT *, length(text) // 4 AS tokens, 2512 - 512 - length(query) // 4 AS budget FROM hits),
u AS (SELECT *, sum(tokens) OVER w AS used, budget - sum(tokens) OVER w <= 0 AS over_ FROM t WINDOW w AS (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING)),
v AS (SELECT *, sum(over_::INT) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS overs, (budget - used + tokens) * 4 AS chars FROM u)
SELECT query_id, chunk_id, CASE WHEN over_ THEN substr(text, 1, chars::BIGINT) || '... [TRUNCATED]' ELSE text END AS text, over_ AS truncated FROM v WHERE overs = 0 OR (over_ AND overs = 1 AND chars > 100)"""
)
def truncate_to_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.truncate_to_budget(hits(spark, sf_dir), window=2512).select("query_id", "chunk_id", "text", "truncated")


INTENTS = ("Definition", "Summary", "Timeline", "Comparison", "Steps", "Unknown")


def plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    intent = F.element_at(F.array(*[F.lit(i) for i in INTENTS]), (F.col("query_id") % len(INTENTS) + 1).cast("int"))
    return E.plan_response(passages(spark, sf_dir).select("query_id", intent.alias("intent")))


@query()
def compress_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.compress_context(hits(spark, sf_dir), plans(spark, sf_dir))


def _plan_case(i: int) -> str:
    show = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return "CASE intent " + " ".join(f"WHEN '{k}' THEN {show(v[i])}" for k, v in E.PLAN_ROWS.items()) + f" ELSE {show(E.DEFAULT_PLAN[i])} END"


_PLANNED = ", ".join(f"({_plan_case(i)}){'::INT' if i in (1, 2, 3) else ''} AS {c}" for i, c in enumerate(E.PLAN_COLUMNS))
_KNOWN = [*E.PLANS, "Unknown"]


@query(f"WITH i AS (SELECT conv_id, turn, ({_KNOWN})[(conv_id * 7 + turn) % {len(_KNOWN)} + 1] AS intent FROM conversations WHERE role = 'user') SELECT *, {_PLANNED} FROM i")
def plan_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    intent = F.get(F.array(*[F.lit(k) for k in _KNOWN]), ((F.col("conv_id") * 7 + F.col("turn")) % len(_KNOWN)).cast("int"))
    return E.plan_response(table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", intent.alias("intent")))


_STRATEGIES = "CASE intent " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in E.STRATEGIES.items()) + " ELSE 'Standard' END"


@query(f"WITH i AS (SELECT conv_id, turn, {ladder_sql('lower(text)', D.INTENTS, 'Unknown')} AS intent FROM conversations WHERE role = 'user') SELECT *, {_STRATEGIES} AS strategy FROM i")
def plan_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").filter("role = 'user'").withColumn("intent", classify_intent(F.col("text")))
    return turns.select("conv_id", "turn", "intent", E.plan_strategy(F.col("intent")).alias("strategy"))


FORMATS = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(lower(text), {chr(39)}{t}{chr(39)})' for t in terms)} THEN '{k}'" for k, terms in E.FORMATS.items()) + " ELSE 'Paragraph' END"


@query(f"SELECT conv_id, turn, {FORMATS} AS format FROM conversations WHERE role = 'user'")
def plan_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").filter("role = 'user'")
    return turns.select("conv_id", "turn", E.plan_format(F.col("text")).alias("format"))


@query(
    rf"""WITH {HITS}, e AS (SELECT query_id, rank, list_filter(list_transform(string_split_regex(text, '[.\n]+'), lambda x: trim(x)), lambda x: length(x) > 10) AS l FROM hits),
a AS (SELECT query_id, flatten(list(l ORDER BY rank)) AS l FROM e GROUP BY query_id), k AS (SELECT query_id, l[1:CASE query_id % 6 WHEN 0 THEN 12 WHEN 3 THEN 25 ELSE 18 END] AS l FROM a)
SELECT query_id, len(l)::INT AS sentences, array_to_string(l, '.' || chr(10)) || '.' AS draft FROM k"""
)
def compose_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.compose_extract(hits(spark, sf_dir), plans(spark, sf_dir))


ANSWER_FORMATS = [*E.FORMATS, "Paragraph"]
_HEAD = "CASE WHEN section = 'General' THEN '' ELSE '{} ' || section || chr(10) END"
_END = "CASE WHEN section = 'General' THEN '' ELSE chr(10) END"
_NUMBERED = "array_to_string(list_transform(range(1, len(texts) + 1), lambda i: (before + i)::BIGINT || '. ' || texts[i] || chr(10)), '')"
_BULLETS = "array_to_string(list_transform(texts, lambda x: '- ' || x || chr(10)), '')"
_FLAT = "array_to_string(texts, ' ')"


@query(
    rf"""WITH {SENTENCES}, x AS (SELECT r.query_id, h.section, r.place, r.sentence FROM ranked r JOIN (SELECT query_id, rank, section FROM hits) h USING (query_id, rank)),
g AS (SELECT query_id, section, min(place) AS first, list(sentence ORDER BY place) AS texts FROM x GROUP BY ALL),
b AS (SELECT *, coalesce(sum(len(texts)) OVER (PARTITION BY query_id ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g),
fm AS (SELECT query_id, ({ANSWER_FORMATS})[query_id % {len(ANSWER_FORMATS)} + 1] AS format FROM q),
p AS (SELECT query_id, any_value(format) AS format, string_agg(CASE format WHEN 'Markdown table' THEN '| **' || section || '** | ' || {_FLAT} || ' |' || chr(10)
  WHEN 'Numbered steps' THEN {_HEAD.format('###')} || {_NUMBERED} || {_END} WHEN 'Bullet list' THEN {_HEAD.format('###')} || {_BULLETS} || {_END}
  WHEN 'FAQ' THEN CASE WHEN section = 'General' THEN '' ELSE '**Q: What about ' || section || '?**' || chr(10) END || 'A: ' || {_FLAT} || chr(10) || chr(10)
  WHEN 'Policy' THEN {_HEAD.format('####')} || {_FLAT} || chr(10) || chr(10) ELSE {_HEAD.format('###')} || {_FLAT} || chr(10) || chr(10) END, '' ORDER BY first) AS body FROM b JOIN fm USING (query_id) GROUP BY query_id),
f AS (SELECT query_id, filename, chunk_index + 1 AS page, min(rank) AS first FROM hits GROUP BY ALL),
c AS (SELECT query_id, filename, page, row_number() OVER (PARTITION BY query_id ORDER BY first, filename, page) AS citation FROM f),
s AS (SELECT query_id, string_agg('[' || citation || '] ' || filename || ', page ' || page, chr(10) ORDER BY citation) AS sources FROM c GROUP BY query_id)
SELECT query_id, regexp_replace(CASE format WHEN 'Markdown table' THEN '| Section | Detail |' || chr(10) || '|---------|--------|' || chr(10) ELSE '' END || body || coalesce(chr(10) || '**Sources:**' || chr(10) || sources, ''), '\A\s+|\s+\z', '', 'g') AS answer
FROM p LEFT JOIN s USING (query_id)"""
)
def format_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hits(spark, sf_dir)
    sentences = E.rank_sentences(rows).join(rows.select("query_id", "rank", "section"), ["query_id", "rank"])
    names = ANSWER_FORMATS
    formats = passages(spark, sf_dir).select("query_id", F.get(F.array(*[F.lit(n) for n in names]), (F.col("query_id") % len(names)).cast("int")).alias("format"))
    return E.format_answer(sentences, formats, E.citation_index(rows.withColumn("page", F.col("chunk_index") + 1)))


_LEAK = " OR ".join(f"contains(lower(text), '{k}')" for k in E.LEAKS)


@query(
    rf"""WITH a AS (SELECT conv_id, turn, CASE turn % 5 WHEN 1 THEN text || chr(10) || '- x' || chr(10) || '- x' WHEN 2 THEN text || ' ```' WHEN 3 THEN text || ' score: 0.93' ELSE text END AS text FROM conversations WHERE role = 'assistant'),
l AS (SELECT *, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) > 0) AS l FROM a),
b AS (SELECT *, list_filter(l, lambda x: regexp_matches(x, '^[•*-]')) AS bl, list_filter(l, lambda x: NOT regexp_matches(x, '^[•*-]') AND length(x) > 50) AS pl FROM l)
SELECT conv_id, turn, CASE WHEN length(trim(text)) = 0 THEN 'empty' WHEN {_LEAK} THEN 'leak' WHEN regexp_matches(lower(text), '{E.UUID}') THEN 'uuid' WHEN regexp_matches(lower(text), '(score|similarity)[:=]\s*0\.\d+') THEN 'score'
WHEN len(regexp_extract_all(text, '```')) % 2 <> 0 THEN 'fence' WHEN len(list_distinct(bl)) < len(bl) THEN 'bullets' WHEN len(list_distinct(pl)) < len(pl) THEN 'paragraphs' END AS reason FROM b"""
)
def answer_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns, some with a fault added."""
    turns = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    faulty = F.expr("CASE turn % 5 WHEN 1 THEN concat(text, '\\n- x\\n- x') WHEN 2 THEN concat(text, ' ```') WHEN 3 THEN concat(text, ' score: 0.93') ELSE text END")
    return turns.select("conv_id", "turn", E.answer_quality(faulty).alias("reason"))


@query("SELECT conv_id, sum(CASE WHEN role = 'user' THEN length(text) // 4 ELSE 0 END)::BIGINT AS prompt_tokens, sum(CASE WHEN role = 'assistant' THEN length(text) // 4 ELSE 0 END)::BIGINT AS answer_tokens FROM conversations GROUP BY conv_id")
def estimate_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = T.estimate_tokens(F.col("text"))
    of = lambda role: F.sum(F.when(F.col("role") == role, n).otherwise(0))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(of("user").alias("prompt_tokens"), of("assistant").alias("answer_tokens"))
