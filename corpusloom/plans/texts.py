"""Queries that clean and describe the texts of `documents`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import clean, embed
from corpusloom.plans.base import SQL, query
from corpusloom.sources.tables import spread, table

_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def source_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of a source as the pages of one document."""
    return _docs(spark, sf_dir).select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), "text")


@query(
    """WITH p AS (SELECT source AS doc, doc_id AS page, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) > 0) AS l FROM documents),
e AS (SELECT doc, zone, unnest(list_distinct(l2)) AS line FROM (
  SELECT doc, 'header' AS zone, l[1:2] AS l2 FROM p UNION ALL SELECT doc, 'footer', l[greatest(len(l) - 1, 1):len(l)] FROM p)),
c AS (SELECT doc, zone, line, count(*) AS n FROM e GROUP BY ALL), s AS (SELECT doc, count(*) AS pages FROM p GROUP BY doc),
drop_ AS (SELECT DISTINCT doc, line FROM c JOIN s USING (doc) WHERE pages >= 3 AND n >= greatest(2, floor(pages * 0.1))),
k AS (SELECT source AS doc, doc_id AS page, i, string_split(text, chr(10))[i] AS line FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS t(i))
SELECT doc, page, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text FROM (
  SELECT k.*, EXISTS (SELECT 1 FROM drop_ d WHERE d.doc = k.doc AND d.line = trim(k.line)) AS gone FROM k) GROUP BY doc, page"""
)
def strip_headers_footers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.strip_headers_footers(source_pages(spark, sf_dir), 0.1).select("doc", "page", "text")


def _dirty(column: str = "text") -> F.Column:
    """What the corpus lacks: marks and breaks put where its texts have blanks and ends."""
    return F.regexp_replace(F.regexp_replace(column, " the ", " the\u200b \ufeff“the” "), r"\. ", " — end.....\n\n\nPage 7\r\n")


_DIRTY = "regexp_replace(regexp_replace(text, ' the ', ' the' || chr(8203) || ' ' || chr(65279) || '“the” ', 'g'), '\\. ', ' — end.....' || chr(10) || chr(10) || chr(10) || 'Page 7' || chr(13) || chr(10), 'g')"


@query(f"SELECT doc_id, regexp_replace({_DIRTY}, '[' || chr(8203) || chr(8204) || chr(8205) || chr(65279) || ']', '', 'g') AS text FROM documents")
def clean_unicode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.clean_unicode(_dirty()).alias("text"))


@query(f"SELECT doc_id, regexp_replace(translate({_DIRTY}, '’‘”“–—', '''''\"\"--'), '\\.{{4,}}', '...', 'g') AS text FROM documents")
def normalize_punct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.normalize_punct(_dirty()).alias("text"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(text, ' ([a-z])', '-' || chr(10) || ' \1', 'g'), '([\pL\pM\pN_]+)-\s*\n\s*([\pL\pM\pN_]+)', '\1\2', 'g') AS text FROM documents")
def repair_hyphenation(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = F.regexp_replace("text", " ([a-z])", "-\n $1")
    return _docs(spark, sf_dir).select("doc_id", T.repair_hyphenation(broken).alias("text"))


def _unwrapped(x: str) -> str:
    """Twice, as a single letter between two breaks is used up by the first."""
    for _ in range(2):
        x = rf"regexp_replace({x}, '([a-zA-Z,])\n([a-z])', '\1 \2', 'g')"
    return x


def _without_singles(x: str) -> str:
    for _ in range(2):
        x = f"regexp_replace({x}, ' [b-hj-zB-HJ-Z] ', '  ', 'g')"
    return x


@query(f"SELECT doc_id, {_unwrapped("replace(text, ', ', ',' || chr(10))")} AS text FROM documents")
def merge_wrapped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.merge_wrapped_lines(F.replace("text", F.lit(", "), F.lit(",\n"))).alias("text"))


@query(f"SELECT doc_id, {_without_singles("replace(text, ' the ', ' x the ')")} AS text FROM documents")
def drop_ocr_singletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.drop_ocr_singletons(F.replace("text", F.lit(" the "), F.lit(" x the "))).alias("text"))


def _collapsed(x: str) -> str:
    lines = f"list_transform(string_split(replace({x}, chr(13), ''), chr(10)), lambda y: trim(regexp_replace(y, '[ \\t]+', ' ', 'g')))"
    return f"trim(regexp_replace(array_to_string({lines}, chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10))"


@query(f"SELECT doc_id, {_collapsed(_DIRTY)} AS text FROM documents")
def collapse_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.collapse_whitespace(_dirty()).alias("text"))


@query(
    f"SELECT doc_id, {_STRIP.format('x')} AS text FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace({_DIRTY}, chr(13), ''), "
    f"'(?im)^Page[ \\t]+\\d+[ \\t]*$', '', 'g'), '\\.{{4,}}', '...', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g') AS x FROM documents)"
)
def sanitize_extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.sanitize_extracted(F.translate(_dirty(), "\r", "")).alias("text"))


_PLAIN = "regexp_replace(translate(regexp_replace(text, '[' || chr(8203) || chr(8204) || chr(8205) || chr(65279) || ']', '', 'g'), '’‘”“–—', '''''\"\"--'), '\\.{4,}', '...', 'g')"
_JOINED = rf"regexp_replace({_PLAIN}, '([\pL\pM\pN_]+)-\s*\n\s*([\pL\pM\pN_]+)', '\1\2', 'g')"


@query(f"SELECT doc, page, {_collapsed(_without_singles(_unwrapped(_JOINED)))} AS text FROM ({SQL['strip_headers_footers']})")
def clean_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.clean_corpus(source_pages(spark, sf_dir), 0.1).select("doc", "page", "text")


@query(
    r"""WITH b AS (SELECT doc_id, regexp_replace(regexp_replace(replace(text, ' the ', ' [1] <b>**the**</b> '), '\[.*?\]|<[^>]+>', ' ', 'g'), '[#*|_`]', '', 'g') AS x FROM documents),
s AS (SELECT doc_id, string_split(regexp_replace(trim(regexp_replace(x, '\s+', ' ', 'g')), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS l FROM b)
SELECT doc_id, array_to_string(list_filter(l, lambda y: length(y) > 0)[1:3], ' ') AS excerpt FROM s"""
)
def clean_markdown_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some words put in brackets, tags and marks."""
    marked = F.replace("text", F.lit(" the "), F.lit(" [1] <b>**the**</b> "))
    return _docs(spark, sf_dir).select("doc_id", T.clean_markdown_excerpt(marked).alias("excerpt"))


#: Patterns that occur in the invented prose stand for the type and topic terms.
_POINTS = {
    kind: " + ".join(f"CASE WHEN regexp_matches(lower(source), '{p}') THEN 5 ELSE 0 END + len(regexp_extract_all(lower(text), '{p}'))" for p in patterns)
    for kind, patterns in T.DOC_TYPES.items()
}


@query(
    "WITH s AS (SELECT doc_id, "
    + ", ".join(f"{v} AS p{i}" for i, v in enumerate(_POINTS.values()))
    + " FROM documents) SELECT doc_id, CASE WHEN greatest(p0, p1, p2, p3, p4) = 0 THEN 'General Document' "
    + " ".join(f"WHEN p{i} = greatest(p0, p1, p2, p3, p4) THEN '{k}'" for i, k in enumerate(_POINTS))
    + " END AS document_type FROM s"
)
def detect_doc_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.doc_type(F.col("text"), F.col("source")).alias("document_type"))


@query(
    rf"""WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\pL\pM\pN_]+'), lambda x: regexp_full_match(x, '[a-z]{{4,}}')) AS l FROM documents),
t AS (SELECT doc_id, i, l[i] AS word FROM w, unnest(range(1, len(l) + 1)) AS u(i)),
c AS (SELECT doc_id, word, count(*) AS n, min(i) AS pos FROM t WHERE word NOT IN {T.STOP_WORDS} GROUP BY ALL)
SELECT doc_id, rank, word, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, pos) AS rank FROM c) WHERE rank <= 10"""
)
def top_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.top_keywords(_docs(spark, sf_dir))


_TOPIC_SQL = ", ".join("CASE WHEN " + " OR ".join(f"contains(lower(text), '{t}')" for t in terms) + f" THEN '{k}' END" for k, terms in T.TOPICS.items())


@query(f"WITH t AS (SELECT doc_id, list_filter([{_TOPIC_SQL}], lambda x: x IS NOT NULL) AS l FROM documents) SELECT doc_id, CASE WHEN len(l) > 0 THEN array_to_string(l, ',') ELSE 'General' END AS topics FROM t")
def detect_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.array_join(T.topics(F.col("text")), ",").alias("topics"))


@query("SELECT doc_id, " + ", ".join(f"regexp_matches(lower(text), '{p}') AS {k}" for k, p in T.FLAGS.items()) + " FROM documents")
def content_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", *T.content_flags(F.col("text")))


def _tech(x: str) -> str:
    """(doc_id, technologies). Whole words are matched, as this engine's word bounds know ASCII only."""
    pattern = T.TECH.replace(r"\b", "")
    words = rf"SELECT doc_id, list_filter(regexp_extract_all({x}, '[\pL\pM\pN_]+'), lambda y: regexp_full_match(y, '{pattern}')) AS w FROM documents"
    return f"SELECT doc_id, array_to_string(list_filter(w, lambda y, i: list_position(w, y) = i)[1:15], ',') AS technologies FROM ({words})"


_NAMED = "replace(text, ' the ', ' GPU SparkSQL Http2 GPU ')"


@query(_tech(_NAMED))
def extract_tech_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some words made technical names."""
    named = F.replace("text", F.lit(" the "), F.lit(" GPU SparkSQL Http2 GPU "))
    return _docs(spark, sf_dir).select("doc_id", F.array_join(T.tech_entities(named), ",").alias("technologies"))


@query(
    r"""SELECT doc_id, greatest(1, ceil(length(text) / 3000))::BIGINT AS pages,
len(list_filter(string_split(text, chr(10) || chr(10)), lambda x: regexp_matches(x, '[^\s]')))::INT AS paragraphs, length(text)::INT AS characters, len(regexp_extract_all(text, '[^\s]+'))::INT AS words FROM documents"""
)
def document_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.document_stats(_docs(spark, sf_dir))


@query(
    f"""WITH k AS (SELECT doc_id, string_agg(word, ',' ORDER BY rank) AS keywords FROM ({SQL["top_keywords"]}) GROUP BY doc_id)
SELECT doc_id, document_type, 'en' AS language, coalesce(keywords, '') AS keywords, topics, technologies, {", ".join(T.FLAGS)}
FROM ({_tech("text")}) JOIN ({SQL["detect_doc_type"]}) USING (doc_id) JOIN ({SQL["detect_topics"]}) USING (doc_id) JOIN ({SQL["content_flags"]}) USING (doc_id) LEFT JOIN k USING (doc_id)"""
)
def document_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = clean.document_metadata(_docs(spark, sf_dir)).select("doc_id", "metadata.*")
    return flat.withColumns({c: F.array_join(c, ",") for c in ("keywords", "topics", "technologies")})


@query(r"SELECT doc_id, coalesce(nullif(trim(regexp_extract('# ' || text, '(?m)^#[ \t]+(.+)$', 1)), ''), source) AS title FROM documents")
def markdown_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text's first line made a heading."""
    return _docs(spark, sf_dir).select("doc_id", T.markdown_title(F.concat(F.lit("# "), "text"), F.col("source")).alias("title"))


@query(
    r"""SELECT doc_id, array_to_string([x FOR x IN ['Document: ' || source || '.txt', 'Topic: ' || CASE lang WHEN 'en' THEN 'English' END, 'Heading: ' || regexp_extract(text, '^[^.\n]*', 0)] IF x IS NOT NULL], ' | ')
|| chr(10) || chr(10) || text AS input FROM documents"""
)
def embedding_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    named = _docs(spark, sf_dir).select(
        "doc_id", "text", F.concat("source", F.lit(".txt")).alias("filename"), none.alias("document_type"), F.expr("CASE lang WHEN 'en' THEN 'English' END").alias("topic"),
        none.alias("section"), F.regexp_extract("text", r"^[^.\n]*", 0).alias("heading"), none.alias("chunk_type"),
    )
    return named.select("doc_id", embed.embedding_input().alias("input"))


@query()
def embed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.embed(_docs(spark, sf_dir).select("doc_id", "text"), "text").select("doc_id", "embedding")


@query(
    """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * (1 + vec_id % 7)) AS v FROM embeddings),
s AS (SELECT vec_id, v, sqrt(list_reduce(list_prepend(0.0::DOUBLE, list_transform(v, lambda x: x * x)), lambda a, b: a + b)) AS n FROM e)
SELECT vec_id, round(list_sum(list_transform(v, lambda x: round(x / n, 6))), 4) AS total, round(list_max(list_transform(v, lambda x: x / n)), 6) AS largest FROM s"""
)
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = F.transform("embedding", lambda x: x.cast("double") * (1 + F.col("vec_id") % 7))
    unit = table(spark, sf_dir, "embeddings").select("vec_id", scaled.alias("v")).select("vec_id", embed.l2_normalize(F.col("v")).alias("unit"))
    total = F.aggregate("unit", F.lit(0.0), lambda a, x: a + F.round(x, 6))
    return unit.select("vec_id", F.round(total, 4).alias("total"), F.round(F.array_max("unit"), 6).alias("largest"))


@query("SELECT len(embedding)::BIGINT AS dimension, count(*) AS rows, len(embedding) = 64 AS fits FROM embeddings GROUP BY 1, 3")
def dimension_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.dimension_check(table(spark, sf_dir, "embeddings"), 64)
