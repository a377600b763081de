"""Queries over the sessions of `conversations`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import sessions as S
from corpusloom.functions import dictionaries as D
from corpusloom.plans.base import ladder_sql, query
from corpusloom.sources.tables import table

KEYS = ["conv_id", "turn"]
ENTITIES = ["the", "and", "que"]
TOPICS = (("First", "eren"), ("Second", "that|with"), ("Third", "ing"))
_TOPIC = "CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{p}') THEN '{n}'" for n, p in TOPICS) + " END"
_WORDS = r"len(regexp_extract_all(text, '[^\s]+'))"
_B, _E = r"(?:^|[^\pL\pN_])", r"(?:$|[^\pL\pN_])"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(*KEYS, "role", "text")


@query(
    """WITH h AS (SELECT *, list(role || ': ' || text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS h FROM conversations)
SELECT conv_id, turn, coalesce(len(h), 0)::INT AS n, md5(coalesce(array_to_string(h, '|'), '')) AS digest FROM h WHERE role = 'user'"""
)
def history_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.history_window(turns(spark, sf_dir)).select(*KEYS, F.size("history").alias("n"), F.md5(F.array_join("history", "|").cast("binary")).alias("digest"))


@query(
    rf"""WITH b AS (SELECT *, last_value(CASE WHEN role = 'user' AND length(trim(regexp_replace(lower(text), '\b(hi|hello|gm|hey|tell|about|what|is|the)\b', '', 'g'))) > 3 THEN text END IGNORE NULLS)
  OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS topic FROM conversations)
SELECT conv_id, turn, CASE WHEN topic IS NOT NULL AND (regexp_matches(lower(text), '{_B}({'|'.join(S.PRONOUNS)}){_E}') OR {_WORDS} <= 5 OR regexp_matches(lower(text), '{'|'.join(S.SUMMARY_WORDS)}'))
THEN text || ' regarding ' || regexp_replace(topic, '[#*>\n]', ' ', 'g') ELSE text END AS resolved FROM b WHERE role = 'user'"""
)
def resolve_followup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.resolve_followup(turns(spark, sf_dir)).select(*KEYS, "resolved")


_WORDS_AND_GAPS = r"regexp_extract_all(text, '[\pL\pN_]+|[^\pL\pN_]+')"


def _put(words: str, value: str) -> str:
    return f"WHEN list_has_any(list_transform(l, lambda x: lower(x)), {words}) THEN array_to_string(list_transform(l, lambda x: CASE WHEN list_contains({words}, lower(x)) THEN {value} ELSE x END), '')"


_OWNED = _put("['its', 'their']", "noun || chr(39) || 's'")
_SAID = _put("['it', 'they', 'this', 'that', 'he', 'she']", "noun")


@query(
    rf"""WITH u AS (SELECT conv_id, turn, text, {_WORDS_AND_GAPS} AS l, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations WHERE role = 'user'),
n AS (SELECT *, coalesce(trim(replace(regexp_replace(b, '^(what|who|where|when|why|how|tell me about|explain|summarize) (is|was|are|does|the|a|an)?\s*', '', 'i'), '?', '')), '') AS noun FROM u)
SELECT conv_id, turn, CASE WHEN noun = '' THEN text {_OWNED} {_SAID} ELSE text || ' of ' || noun END AS rewritten FROM n"""
)
def substitute_pronoun(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.substitute_pronoun(turns(spark, sf_dir)).select(*KEYS, "rewritten")


RECENT = rf"""re AS (SELECT *, list_filter(regexp_extract_all(lower(text), '[\pL\pN_]+'), lambda x: x IN {tuple(ENTITIES)}) AS es FROM conversations),
rc AS (SELECT *, last_value(es[len(es)] IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS recent_entity,
  regexp_matches(lower(text), '{_B}(it|they|them|this|that|he|she){_E}') AS pronoun FROM re)"""


@query(f"WITH {RECENT} SELECT conv_id, turn, recent_entity, pronoun AND recent_entity IS NULL AS ambiguous FROM rc")
def recent_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.recent_entity(turns(spark, sf_dir), ENTITIES).select(*KEYS, "recent_entity", "ambiguous")


SWITCH = f"""{RECENT}, tp AS (SELECT *, {_TOPIC} AS topic FROM rc WHERE role = 'user'),
sw AS (SELECT *, last_value(topic IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS active_topic FROM tp)"""


@query(f"WITH {SWITCH} SELECT conv_id, turn, topic, active_topic, coalesce(topic <> active_topic, FALSE) AS switched FROM sw")
def topic_switches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.topic_switches(turns(spark, sf_dir), TOPICS).select(*KEYS, "topic", "active_topic", "switched")


RESOLVED = rf"""{SWITCH}, resolved AS (SELECT conv_id, turn, least(CASE WHEN regexp_matches(lower(text), '^(what about|and) ') AND coalesce(topic, active_topic) IS NULL THEN 0.3 ELSE 1.0 END,
CASE WHEN NOT pronoun THEN 1.0 WHEN recent_entity IS NOT NULL THEN 0.8 WHEN coalesce(topic, active_topic) IS NOT NULL THEN 0.7 ELSE 0.2 END)::DOUBLE AS confidence FROM sw)"""


@query(f"WITH {RESOLVED} SELECT *, confidence < 0.5 AS needs_clarification FROM resolved")
def resolution_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.resolution_confidence(turns(spark, sf_dir), ENTITIES, TOPICS).select(*KEYS, "confidence", "needs_clarification")


@query(
    f"""WITH t AS (SELECT conv_id, turn, sum(floor({_WORDS} * 1.3::DOUBLE)) OVER (PARTITION BY conv_id ORDER BY turn) AS total FROM conversations)
SELECT conv_id, max(total)::BIGINT AS tokens, min(turn) FILTER (total > 100) AS over_turn FROM t GROUP BY conv_id"""
)
def session_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.session_tokens(turns(spark, sf_dir), 100)


@query(
    f"""WITH RECURSIVE t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, floor({_WORDS} * 1.3::DOUBLE)::BIGINT AS n FROM conversations),
m AS (SELECT conv_id, 0::BIGINT AS i, 0::BIGINT AS kept, 0::BIGINT AS tokens, 0::BIGINT AS summaries FROM t WHERE i = 1
UNION ALL SELECT conv_id, t.i, CASE WHEN tokens + n > 100 THEN kept + 1 - (kept + 1) // 2 ELSE kept + 1 END, CASE WHEN tokens + n > 100 THEN (tokens + n) // 2 ELSE tokens + n END, summaries + (tokens + n > 100)::INT FROM m JOIN t USING (conv_id) WHERE t.i = m.i + 1)
SELECT conv_id, arg_max(kept, i) AS kept, arg_max(tokens, i) AS tokens, arg_max(summaries, i) AS summaries FROM m GROUP BY conv_id"""
)
def session_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.session_memory(turns(spark, sf_dir), 100)


@query(
    """WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS last, count(*) OVER (PARTITION BY conv_id) AS size FROM conversations),
a AS (SELECT conv_id, count(*) FILTER (last <= 2) AS kept, max('First') FILTER (last > 2 AND regexp_matches(lower(text), 'eren')) AS a, max('Second') FILTER (last > 2 AND regexp_matches(lower(text), 'with')) AS b FROM t WHERE size > 4 GROUP BY conv_id)
SELECT conv_id, kept, coalesce(nullif(concat_ws(', ', a, b), ''), 'various topics') AS summary FROM a"""
)
def compress_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions over four messages, the last two kept."""
    return S.compress_sessions(turns(spark, sf_dir), 4, 2, (("First", "eren"), ("Second", "with")))


@query(f"SELECT conv_id, turn FROM (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN ' Thanks ' ELSE text END AS text FROM conversations) WHERE trim(lower(text)) NOT IN {S.PLEASANTRIES}")
def filter_pleasantries(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = turns(spark, sf_dir).withColumn("text", F.when(F.col("turn") % 3 == 0, " Thanks ").otherwise(F.col("text")))
    return S.filter_pleasantries(said).select(*KEYS)


@query(
    rf"""WITH t AS (SELECT conv_id, turn, role, CASE WHEN role = 'user' AND turn % 3 = 0 THEN 'Hello my name is ann ' || text ELSE text END AS text FROM conversations),
a AS (SELECT conv_id, count(*) AS turns, min(turn) AS first_turn, max(turn) AS last_turn, count(*) FILTER (role = 'user' AND regexp_matches(lower(text), '^(hi|hello|hey|good (morning|afternoon|evening))\b')) AS greetings,
  arg_max(nullif(regexp_extract(lower(text), '\bmy name is ([a-z]+)', 1), ''), turn) AS name, arg_max(text, turn) FILTER (role = 'assistant') AS answer,
  arg_max({ladder_sql("lower(text)", D.INTENTS, "Unknown")}, turn) FILTER (role = 'user') AS last_intent FROM t GROUP BY conv_id)
SELECT conv_id, turns, first_turn, last_turn, greetings, name, last_intent, CASE WHEN length(answer) > 200 THEN substr(answer, 1, 200) || '...' ELSE answer END AS preview FROM a"""
)
def session_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.when((F.col("role") == "user") & (F.col("turn") % 3 == 0), F.concat(F.lit("Hello my name is ann "), "text")).otherwise(F.col("text"))
    return S.session_profile(turns(spark, sf_dir).withColumn("text", named))


@query(
    """WITH l AS (SELECT *, lead(role) OVER w AS r, lead(text) OVER w AS t FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, text, CASE WHEN r = 'assistant' THEN t END AS reply FROM l WHERE role = 'user'"""
)
def pair_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.pair_turns(turns(spark, sf_dir)).select(*KEYS, "text", "reply")
