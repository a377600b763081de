"""Queries that search: benchmark passages against the chunks of `documents`, and `embeddings` against each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import STOP_WORDS
from corpusloom.operators import ann as A
from corpusloom.operators import chunk
from corpusloom.operators import retrieve as R
from corpusloom.plans.base import query
from corpusloom.sources.tables import spread, table, written

K = 10


def passages(spark: SparkSession, sf_dir: str, parts: bool = True) -> DataFrame:
    """(query_id, text): every sentence of every benchmark passage is a query; with parts=False, every passage is one."""
    items = table(spark, sf_dir, "benchmark")
    if not parts:
        return items.select(F.col("item_id").alias("query_id"), "text")
    each = items.select("item_id", F.posexplode(F.split("text", SENTENCE)).alias("i", "text"))
    return each.select((F.col("item_id") * 1000 + F.col("i")).alias("query_id"), F.trim("text").alias("text")).filter("text <> ''")


SENTENCE = r"[.!?\n]+"


def of_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, text): the whole passage that a query of passages() is a sentence of."""
    whole = passages(spark, sf_dir, False).withColumnRenamed("query_id", "item_id")
    return passages(spark, sf_dir).select("query_id", F.expr("query_id div 1000").alias("item_id")).join(whole, "item_id").select("query_id", "text")


def q_sql(parts: bool = True, name: str = "q") -> str:
    if not parts:
        return f"{name} AS (SELECT item_id AS query_id, text FROM benchmark)"
    return rf"""{name} AS (SELECT item_id * 1000 + i - 1 AS query_id, trim(l[i]) AS text FROM (SELECT item_id, string_split_regex(text, '{SENTENCE}') AS l FROM benchmark), unnest(range(1, len(l) + 1)) AS t(i) WHERE trim(l[i]) <> '')"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_id, version_id, chunk_index, filename, heading, section, chunk_type, status, text)."""
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", "source", "lang", F.regexp_extract("text", r"^[^.\n]*", 0).alias("heading"), "text", F.length("text").alias("n"))
    cut = chunk.chunk_fixed(docs)
    return cut.select(
        F.concat_ws("-", "doc_id", "chunk_index").alias("chunk_id"),
        F.col("doc_id").alias("version_id"),
        "chunk_index",
        F.concat("source", F.lit(".txt")).alias("filename"),
        "heading",
        F.col("source").alias("section"),
        F.expr("CASE lang WHEN 'fr' THEN 'table' WHEN 'de' THEN 'list' WHEN 'en' THEN 'text' END").alias("chunk_type"),
        F.when(F.col("n") >= 200, "ready_for_search").otherwise("failed").alias("status"),
        F.col("chunk_text").alias("text"),
    )


CHUNKS = r"""chunks AS (SELECT doc_id || '-' || i AS chunk_id, doc_id AS version_id, i AS chunk_index, source || '.txt' AS filename,
  regexp_extract(text, '^[^.\n]*', 0) AS heading, source AS section, CASE lang WHEN 'fr' THEN 'table' WHEN 'de' THEN 'list' WHEN 'en' THEN 'text' END AS chunk_type,
  CASE WHEN length(text) >= 200 THEN 'ready_for_search' ELSE 'failed' END AS status, substr(text, i * 3000 + 1, 3000) AS text
  FROM documents, unnest(range(0, ceil(length(text) / 3000)::BIGINT)) AS t(i))"""


def terms_sql(column: str, shortest: int = 1) -> str:
    """The content words of a text, as a set."""
    return f"list_filter(list_distinct(regexp_extract_all(lower({column}), '[a-z0-9]+')), lambda x: x NOT IN {STOP_WORDS} AND length(x) >= {shortest})"


def keyword_sql(k: int, q: str = "q", name: str = "keyword") -> str:
    n = name
    return f"""{n}_terms AS (SELECT query_id, unnest(t) AS term, len(t) AS n_terms FROM (SELECT query_id, {terms_sql("text")} AS t FROM {q})),
{n}_w AS (SELECT chunk_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS l FROM chunks),
{n}_size AS (SELECT count(*) AS n_chunks, avg(len(l)) AS avg_len FROM {n}_w),
{n}_post AS (SELECT term, chunk_id, count(*) AS tf, any_value(n) AS len FROM (SELECT chunk_id, len(l) AS n, unnest(l) AS term FROM {n}_w)
  WHERE term IN (SELECT term FROM {n}_terms) GROUP BY term, chunk_id),
{n}_df AS (SELECT term, count(*) AS df FROM {n}_post GROUP BY term),
{n}_part AS (SELECT query_id, chunk_id, n_terms, ln(1 + (n_chunks - df + 0.5) / (df + 0.5)::DOUBLE) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25 + 0.75::DOUBLE * len / avg_len)) AS part
  FROM {n}_post JOIN {n}_df USING (term) JOIN {n}_terms USING (term), {n}_size),
{n}_hit AS (SELECT query_id, chunk_id, round(sum(part), 6) AS bm25 FROM {n}_part GROUP BY query_id, chunk_id, n_terms HAVING count(*) = n_terms),
{n}_rank AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, chunk_id) AS rank FROM {n}_hit),
{n} AS (SELECT query_id, chunk_id, bm25, round(CASE WHEN bm25 / max(bm25) OVER p <= 0 THEN 0.5 ELSE least(2 * (bm25 / max(bm25) OVER p), 0.95) END, 6)::DOUBLE AS score, rank
  FROM {n}_rank WHERE rank <= {k} WINDOW p AS (PARTITION BY query_id))"""


def metadata_sql(k: int, q: str, name: str = "metadata") -> str:
    return f"""{name}_hit AS (SELECT query_id, chunk_id, (CASE WHEN contains(lower(filename), lower(trim(q.text))) THEN 0.95 WHEN contains(lower(heading), lower(trim(q.text))) THEN 0.92
  WHEN contains(lower(section), lower(trim(q.text))) THEN 0.88
  WHEN len(list_filter(string_split(lower(trim(q.text)), ' '), lambda w: length(w) >= 4 AND contains(lower(filename) || ' ' || lower(heading) || ' ' || lower(section), w))) > 0 THEN 0.80 END)::DOUBLE AS score
  FROM {q} q, chunks WHERE trim(q.text) <> ''),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM {name}_hit WHERE score IS NOT NULL) WHERE rank <= {k})"""


VECTORS = """vq AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 100 = 0),
vs AS (SELECT query_id, vec_id AS chunk_id, round(list_dot_product(e::DOUBLE[], embedding::DOUBLE[]) / sqrt(list_dot_product(e::DOUBLE[], e::DOUBLE[]))
  / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS score FROM vq, embeddings WHERE vec_id <> query_id)"""


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every vector whose id is divisible by 100 is a query against all others."""
    every = table(spark, sf_dir, "embeddings")
    return every.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), every.select(F.col("vec_id").alias("chunk_id"), "embedding")


@query(f"WITH {VECTORS} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM vs) WHERE rank <= {K}")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.dense_topk(*vectors(spark, sf_dir), K, self_match=False)


def _ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, every = vectors(spark, sf_dir)
    return A.dense_topk_ann(asked, every, K, self_match=False, tune_on=every.filter("chunk_id % 100 <> 0"))


@query()
def dense_topk_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tuned on vectors that are no queries."""
    return _ann(spark, sf_dir)


@query(f"SELECT count(*) AS queries, TRUE AS enough FROM embeddings WHERE vec_id % 100 = 0 AND (SELECT count(*) FROM embeddings) > {K}")
def dense_topk_ann_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the approximate search finds 90 % of what the exact one does, for queries that it wasn't tuned on."""
    exact = R.dense_topk(*vectors(spark, sf_dir), K, self_match=False).select("query_id", "chunk_id")
    both = exact.join(_ann(spark, sf_dir).select("query_id", "chunk_id", F.lit(1).alias("met")), ["query_id", "chunk_id"], "left")
    return both.agg(F.count_distinct("query_id").alias("queries"), (F.count("met") >= 0.9 * F.count("*")).alias("enough"))


@query(f"WITH {q_sql()}, {CHUNKS}, {keyword_sql(K)} SELECT * FROM keyword")
def keyword_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.keyword_topk(passages(spark, sf_dir), chunks(spark, sf_dir), K)


@query(f"WITH {q_sql(False)}, {CHUNKS}, {keyword_sql(K)} SELECT * FROM keyword")
def keyword_topk_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole passages: finds the chunks that hold all of a passage's words."""
    return R.keyword_topk(passages(spark, sf_dir, False), chunks(spark, sf_dir), K)


@query(
    f"""WITH {CHUNKS}, b AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM benchmark),
p AS (SELECT item_id * 1000 + j AS query_id, w[6 * j + 1:6 * j + 6] AS w FROM b, unnest(range(0, len(w) // 6)) AS t(j)),
g AS (SELECT query_id, kind, place, w[i] AS term FROM p, (VALUES ('phrase', 0, 1), ('phrase', 1, 2), ('any', 0, 3), ('any', 1, 4), ('not', 0, 5), ('may', 0, 6)) AS v(kind, place, i)
  WHERE kind <> 'may' OR (length(w[6]) > 1 AND w[6] NOT IN {STOP_WORDS})),
t AS (SELECT chunk_id, l[i] AS term, i FROM (SELECT chunk_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS l FROM chunks), unnest(range(1, len(l) + 1)) AS u(i)),
s AS (SELECT query_id, chunk_id, kind, count(DISTINCT place) AS places, count(*) AS times FROM t JOIN g USING (term) GROUP BY query_id, chunk_id, kind, CASE kind WHEN 'phrase' THEN i - place END),
h AS (SELECT query_id, chunk_id, sum(times)::DOUBLE AS score FROM s WHERE kind <> 'phrase' OR places = 2 GROUP BY query_id, chunk_id
  HAVING count(DISTINCT kind) FILTER (kind IN ('phrase', 'any')) = 2 AND count(*) FILTER (kind = 'not') = 0)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM h) WHERE rank <= 40"""
)
def keyword_topk_websearch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every six words of a passage: the first two as a phrase, the third or the fourth, not the fifth, and the sixth as an
    abbreviation that may be missing."""
    w = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    each = table(spark, sf_dir, "benchmark").select("item_id", w.alias("w")).filter(F.size("w") >= 6)
    cut = each.select("item_id", "w", F.explode(F.sequence(F.lit(0), F.floor(F.size("w") / 6).cast("int") - 1)).alias("j"))
    cut = cut.select((F.col("item_id") * 1000 + F.col("j")).alias("query_id"), F.slice("w", 6 * F.col("j") + 1, F.lit(6)).alias("w"))
    last = F.get("w", F.lit(5))
    text = F.format_string('"%s %s" %s or %s -%s %s', *[F.get("w", F.lit(i)) for i in range(5)], F.when(F.length(last) > 1, F.upper(last)).otherwise(""))
    return R.keyword_topk_websearch(cut.select("query_id", text.alias("text")), chunks(spark, sf_dir))


@query(f"WITH {q_sql()}, {CHUNKS}, {metadata_sql(K, 'q')} SELECT * FROM metadata")
def metadata_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.metadata_search(passages(spark, sf_dir), chunks(spark, sf_dir), K, match="words")


def _fuse_sql(legs: str, top: int = K) -> str:
    return f"""fused AS (SELECT query_id, chunk_id, round(sum(CASE leg WHEN 'metadata' THEN 3.0::DOUBLE WHEN 'keyword' THEN 2.0 WHEN 'vector' THEN 1.0 END / (60 + rank)), 6) AS rrf, max(score)::DOUBLE AS score,
  string_agg(DISTINCT leg, ',' ORDER BY leg) AS methods FROM {legs} GROUP BY query_id, chunk_id),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, chunk_id) AS rank FROM fused) WHERE rank <= {top})"""


LEGS = f"""{q_sql(True, "q2")}, {q_sql()}, {CHUNKS}, {metadata_sql(50, "q2")}, {keyword_sql(50)},
vq AS (SELECT query_id, embedding AS e FROM q JOIN embeddings ON vec_id = query_id // 1000),
vs AS (SELECT query_id, vec_id || '-0' AS chunk_id, vec_id, round(list_dot_product(e::DOUBLE[], embedding::DOUBLE[]) / sqrt(list_dot_product(e::DOUBLE[], e::DOUBLE[]))
  / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS score FROM vq, embeddings),
vector AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM vs) WHERE rank <= 50),
legs AS (SELECT query_id, 'metadata' AS leg, rank, chunk_id, score FROM metadata UNION ALL SELECT query_id, 'keyword', rank, chunk_id, score FROM keyword
  UNION ALL SELECT query_id, 'vector', rank, chunk_id, score FROM vector)"""


def legs(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The three legs of the sentences; vec_id stands for the document and for the passage of that number."""
    parts, every = chunks(spark, sf_dir), table(spark, sf_dir, "embeddings")
    asked = passages(spark, sf_dir).select("query_id", F.expr("query_id div 1000").alias("vec_id")).join(every, "vec_id")
    near = R.dense_topk(asked.select("query_id", "embedding"), every.select(F.col("vec_id").alias("chunk_id"), "embedding"), 50)
    return {
        "metadata": R.metadata_search(passages(spark, sf_dir), parts, 50, match="words"),
        "keyword": R.keyword_topk(passages(spark, sf_dir), parts, 50),
        "vector": near.withColumn("chunk_id", F.concat("chunk_id", F.lit("-0"))),
    }


@query(f"WITH {LEGS}, {_fuse_sql('legs')} SELECT * FROM best")
def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = [R.leg(hits, name) for name, hits in legs(spark, sf_dir).items()]
    return R.rrf_fuse(named[0].unionByName(named[1]).unionByName(named[2]))


def _has(column: str, terms: tuple) -> str:
    return "(" + " OR ".join(f"contains({column}, '{t}')" for t in terms) + ")"


PLAN = f"""p AS (SELECT query_id, text, CASE WHEN {_has("lower(text)", R.LISTING)} THEN 'listing' WHEN {_has("lower(text)", R.DOCUMENT_WORDS)} AND short THEN 'document'
  WHEN {_has("lower(text)", R.COMPLEX_WORDS)} THEN 'all' WHEN short THEN 'vector' ELSE 'all' END AS kind FROM asked),
plan AS (SELECT query_id, text, kind IN ('listing', 'document', 'all') AS use_metadata, kind IN ('document', 'all') AS use_keyword, kind IN ('vector', 'all') AS use_vector FROM p)"""
_ASKED = r"asked AS (SELECT *, len(regexp_extract_all(text, '[^\s]+')) <= 3 AS short FROM {})"
_MIXED = "asked_q AS (SELECT query_id, CASE query_id % 4 WHEN 0 THEN 'page ' || text WHEN 1 THEN 'how ' || text ELSE text END AS text FROM q2)"


def mixed_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sentence, some with a word that names a document or a complex question."""
    text = F.expr("CASE query_id % 4 WHEN 0 THEN 'page ' || text WHEN 1 THEN 'how ' || text ELSE text END")
    return passages(spark, sf_dir).select("query_id", text.alias("text"))


@query(f"WITH {LEGS}, {_MIXED}, {_ASKED.format('asked_q')}, {PLAN}, on_ AS (SELECT l.* FROM legs l JOIN plan USING (query_id) WHERE CASE leg WHEN 'metadata' THEN use_metadata WHEN 'keyword' THEN use_keyword ELSE use_vector END), {_fuse_sql('on_')} SELECT * FROM best")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.hybrid_search(R.plan_retrieval(mixed_queries(spark, sf_dir)), legs(spark, sf_dir))


@query(f"WITH {q_sql(True, 'q2')}, {_MIXED}, {_ASKED.format('asked_q')}, {PLAN} SELECT * FROM plan")
def plan_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.plan_retrieval(mixed_queries(spark, sf_dir))


INTENTS = ("Definition", "Comparison", "Workflow", "Policy", "Architecture", "Troubleshooting", "Unknown")
_INTENT = f"CASE conv_id % {len(INTENTS)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(INTENTS)) + " END"
_EXPECT = "CASE turn % 3 WHEN 0 THEN 'table' ELSE 'standard' END"


def intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with an intent and an expectation by their numbers."""
    turns = table(spark, sf_dir, "conversations").filter("role = 'user'")
    return turns.select("conv_id", "turn", F.expr(_INTENT).alias("intent"), F.expr(_EXPECT).alias("expectation"))


def _strategy_sql(i: int) -> str:
    pick = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    return "CASE intent " + " ".join(f"WHEN '{k}' THEN {pick(v[i])}" for k, v in R.STRATEGIES.items()) + f" ELSE {pick(R.DEFAULT_STRATEGY[i])} END"


STRATEGY = f"""i AS (SELECT conv_id, turn, {_INTENT} AS intent, {_EXPECT} AS expectation FROM conversations WHERE role = 'user'),
strategy AS (SELECT *, {_strategy_sql(0)} AS strategy, {_strategy_sql(1)}::DOUBLE AS dense_weight, {_strategy_sql(2)}::DOUBLE AS sparse_weight, {_strategy_sql(3)}::INT AS top_k,
  CASE WHEN expectation = 'table' THEN 'table' ELSE {_strategy_sql(4)} END AS chunk_types, expectation <> 'table' AS expand_neighbors FROM i)"""


@query(f"WITH {STRATEGY} SELECT * FROM strategy")
def retrieval_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.retrieval_strategy(intents(spark, sf_dir)).withColumn("chunk_types", F.array_join("chunk_types", ","))


@query(
    f"WITH i AS (SELECT conv_id, turn, {_INTENT} AS intent FROM conversations WHERE role = 'user') SELECT *, CASE WHEN intent IN ('Comparison', 'Architecture') THEN 10 "
    "WHEN intent = 'Definition' THEN 3 ELSE 5 END AS top_k, intent <> 'Definition' AS expand_neighbors, intent IN ('Comparison', 'Architecture') AS multi_query FROM i"
)
def adaptive_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.adaptive_config(intents(spark, sf_dir).drop("expectation"))


@query(
    f"""WITH {q_sql()}, {CHUNKS}, {keyword_sql(K)}, s AS (SELECT query_id, CASE query_id % 3 WHEN 0 THEN ['table'] WHEN 1 THEN ['list', 'text'] ELSE ['text', 'table', 'list', 'code_block'] END AS types FROM q)
SELECT query_id, chunk_id, k.score, k.rank, chunk_type FROM keyword k JOIN chunks c USING (chunk_id) JOIN s USING (query_id)
WHERE status = 'ready_for_search' AND (chunk_type IS NULL OR list_contains(types, chunk_type))"""
)
def metadata_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = chunks(spark, sf_dir)
    hits = R.keyword_topk(passages(spark, sf_dir), parts, K)
    types = F.expr("CASE query_id % 3 WHEN 0 THEN array('table') WHEN 1 THEN array('list', 'text') ELSE array('text', 'table', 'list', 'code_block') END")
    wanted = passages(spark, sf_dir).select("query_id", types.alias("chunk_types"))
    return R.metadata_filter(wanted, parts, hits).select("query_id", "chunk_id", "score", "rank", "chunk_type")


#: Frequent words of the invented prose stand for the synonyms of two topics.
SYNONYMS = {"the": "article definite", "a": "article indefinite", "of": "relation genitive", "and": "relation copula", "le": "article definite", "der": "article definite"}
_SYN = "syn AS (SELECT unnest({}) AS word, unnest({}) AS topic)".format(list(SYNONYMS), list(SYNONYMS.values()))


@query(
    rf"""WITH {q_sql(False)}, {_SYN}, w AS (SELECT query_id, i, regexp_replace(l[i], '^[?,.!:;()"'']+|[?,.!:;()"'']+$', '', 'g') AS word FROM (SELECT query_id, regexp_extract_all(lower(text), '[^\s]+') AS l FROM q), unnest(range(1, len(l) + 1)) AS t(i)),
m AS (SELECT w.*, topic, min(i) OVER (PARTITION BY query_id, topic) AS first FROM w LEFT JOIN syn USING (word)),
j AS (SELECT query_id, string_agg(coalesce(topic, word), ' ' ORDER BY topic IS NULL, i) AS t, count(topic) AS n FROM m WHERE topic IS NULL OR i = first GROUP BY query_id)
SELECT query_id, CASE WHEN n > 0 THEN trim(t) ELSE lower(text) END AS expanded FROM q LEFT JOIN j USING (query_id)"""
)
def expand_synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = R.dimension(spark, list(SYNONYMS.items()), "word string, topic string")
    return R.expand_synonyms(passages(spark, sf_dir, False), words)


@query(
    rf"""WITH {q_sql(False)}, s AS (SELECT query_id, lower(text) AS low, CASE WHEN contains(lower(text), ' as well as ') THEN string_split(lower(text), ' as well as ') WHEN contains(lower(text), ' along with ') THEN string_split(lower(text), ' along with ')
  WHEN contains(lower(text), ' and ') THEN string_split(lower(text), ' and ') WHEN contains(lower(text), ' or ') THEN string_split(lower(text), ' or ') ELSE [lower(text)] END AS l FROM q),
e AS (SELECT query_id, i, CASE WHEN len(regexp_extract_all(l[i], '[^\s]+')) < 3 THEN low ELSE trim(l[i]) END AS text FROM s, unnest(range(1, len(l) + 1)) AS t(i)),
d AS (SELECT query_id, text, min(i) AS i FROM e GROUP BY ALL)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY i) - 1)::INT AS sub_query, text FROM d"""
)
def split_multi_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.split_multi_query(passages(spark, sf_dir, False))


@query(
    rf"""WITH {q_sql(False)}, i AS (SELECT query_id, text, CASE WHEN query_id % 2 = 0 AND regexp_matches(lower(text), '\band\b') THEN
  list_transform(list_filter(list_transform(string_split_regex(lower(text), '\band\b'), lambda x: trim(x)), lambda x: length(x) > 0), lambda x: x || ' features') ELSE [] END AS l FROM q), e AS (SELECT query_id, list_prepend(text, l) AS l FROM i)
SELECT query_id, (i - 1)::INT AS sub_query, l[i] AS text FROM e, unnest(range(1, len(l) + 1)) AS t(i)"""
)
def comparison_subqueries(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = passages(spark, sf_dir, False).withColumn("intent", F.when(F.col("query_id") % 2 == 0, "Comparison").otherwise("Definition"))
    return R.comparison_subqueries(asked)


@query(
    f"""WITH {q_sql()}, q2 AS (SELECT query_id, b.text FROM q JOIN benchmark b ON item_id = query_id // 1000), {CHUNKS}, {keyword_sql(K, "q", "k0")}, {keyword_sql(K, "q2", "k1")},
h AS (SELECT query_id, 0 AS sub_query, rank, chunk_id, text FROM k0 JOIN chunks USING (chunk_id) UNION ALL SELECT query_id, 1, rank, chunk_id, text FROM k1 JOIN chunks USING (chunk_id))
SELECT query_id, sub_query, rank, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id, text ORDER BY sub_query, rank, chunk_id) AS rn FROM h) WHERE rn = 1"""
)
def union_dedupe_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = chunks(spark, sf_dir)
    asked = (passages(spark, sf_dir), of_passages(spark, sf_dir))
    found = [R.keyword_topk(q, parts, K).withColumn("sub_query", F.lit(i)) for i, q in enumerate(asked)]
    hits = found[0].unionByName(found[1]).join(parts.select("chunk_id", "text"), "chunk_id")
    return R.union_dedupe_hits(hits).select("query_id", "sub_query", "rank", "chunk_id")


@query(
    f"""WITH {q_sql(False)}, {CHUNKS}, {keyword_sql(K)}, none AS (SELECT * FROM q WHERE query_id NOT IN (SELECT query_id FROM keyword)),
f AS (SELECT query_id, array_to_string([x FOR x IN l IF TRUE][1:3], ' ') AS text FROM (SELECT query_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: x NOT IN {STOP_WORDS} AND length(x) > 3) AS a FROM none),
  LATERAL (SELECT list(x ORDER BY i) AS l FROM (SELECT x, min(i) AS i FROM (SELECT a[i] AS x, i FROM unnest(range(1, len(a) + 1)) AS t(i)) GROUP BY x)) WHERE len(a) > 0),
{keyword_sql(K, "f", "again")} SELECT query_id, chunk_id, bm25, score, rank FROM again"""
)
def keyword_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts, asked = chunks(spark, sf_dir), passages(spark, sf_dir, False)
    return R.keyword_fallback(asked, R.keyword_topk(asked, parts, K), parts, K)


@query()
def static_fuzzy_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages found in no chunk against a small registry of first words."""
    asked = passages(spark, sf_dir, False)
    hits = R.keyword_topk(asked, chunks(spark, sf_dir), K)
    names = [(e,) for e in ("the reason and the", "of the other", "in that", "with one and")]
    return R.static_fuzzy_fallback(passages(spark, sf_dir, False), hits, R.dimension(spark, names, "entry string"))


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword hits of the sentences with what is known of their chunks."""
    parts, asked = chunks(spark, sf_dir), passages(spark, sf_dir)
    found = R.keyword_topk(asked, parts, K)
    # Written, as evidence queries use the hits more than once.
    return written(found.join(parts, "chunk_id").join(asked.select("query_id", F.col("text").alias("query")), "query_id"), "hits")


HITS = f"{q_sql()}, {CHUNKS}, {keyword_sql(K)}, hits AS (SELECT k.*, c.* EXCLUDE (chunk_id), q.text AS query FROM keyword k JOIN chunks c USING (chunk_id) JOIN q USING (query_id))"


def overlap_sql(q: str, text: str) -> str:
    words = f"list_filter(list_distinct(regexp_extract_all(lower({q}), '[a-z0-9]+')), lambda x: length(x) >= 4)"
    return f"coalesce(len(list_filter({words}, lambda x: contains(lower({text}), x))) / nullif(len({words}), 0)::DOUBLE, 0.0)"


@query(f"WITH {HITS}, r AS (SELECT query_id, chunk_id, round({overlap_sql('query', 'text')}, 6) AS rerank_score FROM hits) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, chunk_id) AS rank FROM r WHERE rerank_score >= 0.3) WHERE rank <= 4")
def rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.rerank(hits(spark, sf_dir).drop("rank")).select("query_id", "chunk_id", "rerank_score", "rank")


@query(
    f"""WITH {HITS}, e AS (SELECT query_id, version_id, chunk_index, chunk_id, score FROM hits UNION ALL
SELECT query_id, version_id, c.chunk_index, c.chunk_id, 0.0 FROM hits h JOIN chunks c USING (version_id) WHERE c.chunk_index BETWEEN h.chunk_index - 1 AND h.chunk_index + 1)
SELECT query_id, version_id, chunk_index, chunk_id, max(score)::DOUBLE AS score FROM e GROUP BY ALL"""
)
def expand_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.expand_neighbors(hits(spark, sf_dir), chunks(spark, sf_dir))
