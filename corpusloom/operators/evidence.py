"""Evidence: scoring, gating and selecting hits, and composing answers from their sentences."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import text as T
from corpusloom.operators.retrieve import dimension, lexical_overlap, top_k

REJECT, MEDIUM, HIGH = 0.30, 0.45, 0.65


def _query_words(query: Column) -> Column:
    return F.filter(F.array_distinct(F.regexp_extract_all(F.lower(query), F.lit("[a-z0-9]+"), F.lit(0))), lambda w: F.length(w) >= 4)


def evidence_score(hits: DataFrame) -> DataFrame:
    """hits (query, score, method, heading, section, filename, rrf, text) with evidence_score, 1 at most."""
    words = hits.withColumn("words__", _query_words(F.col("query")))
    named = lambda c: F.exists("words__", lambda w: F.contains(F.lower(F.coalesce(c, F.lit(""))), w))
    score = (
        F.col("score")
        + F.when(F.col("method").startswith("metadata"), 0.20).otherwise(0.0)
        + F.when(F.col("method") == "keyword", 0.15).otherwise(0.0)
        + F.when(named("heading"), 0.10).otherwise(0.0)
        + F.when(named("section"), 0.05).otherwise(0.0)
        + F.when(named("filename"), 0.10).otherwise(0.0)
        + 0.5 * F.coalesce("rrf", F.lit(0.0))
        + 0.20 * lexical_overlap(F.col("query"), F.col("text"))
    )
    return words.withColumn("evidence_score", F.round(F.least(F.lit(1.0), score), 6)).drop("words__")


def gate(hits: DataFrame, weak: float = REJECT, min_words: int = 10) -> DataFrame:
    """hits (chunk_type, text, rerank_score) with the reason against each, or null."""
    words = F.size(F.regexp_extract_all("text", F.lit(r"[^\s]+"), F.lit(0)))
    reason = (
        F.when((F.col("chunk_type") == "heading") & (F.length("text") < 50), "HEADING_ONLY")
        .when(words < min_words, "TOO_SHORT")
        .when(F.coalesce("rerank_score", F.lit(0.0)) < weak, "BELOW_THRESHOLD")
    )
    return hits.withColumn("reason", reason)


def confidence_tier(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Every query with its best score and tier; one without evidence is LOW."""
    best = hits.groupBy("query_id").agg(F.max("evidence_score").alias("best"))
    joined = queries.select("query_id").join(best, "query_id", "left").withColumn("best", F.coalesce("best", F.lit(0.0)))
    return joined.withColumn("tier", F.when(F.col("best") < REJECT, "LOW").when(F.col("best") < MEDIUM, "MEDIUM").otherwise("HIGH"))


def logit_tier(queries: DataFrame, hits: DataFrame, medium: float = 0.0, high: float = 2.0) -> DataFrame:
    """As confidence_tier, from the reranker's logits (hits.logit): over `high` HIGH, over `medium` MEDIUM."""
    best = hits.groupBy("query_id").agg(F.max("logit").alias("best"))
    joined = queries.select("query_id").join(best, "query_id", "left").withColumn("best", F.coalesce("best", F.lit(0.0)))
    return joined.withColumn("tier", F.when(F.col("best") > high, "HIGH").when(F.col("best") > medium, "MEDIUM").otherwise("LOW"))


def adaptive_select(hits: DataFrame, tiers: DataFrame) -> DataFrame:
    """Hits in order of score until the tier's stop: HIGH with two or more once their sum is over 1.5, MEDIUM with four, any
    with six."""
    by = Window.partitionBy("query_id").orderBy(F.desc("evidence_score"), "chunk_id")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    ok = hits.filter(F.col("evidence_score") >= REJECT).join(tiers.select("query_id", "tier"), "query_id")
    numbered = ok.withColumn("place", F.row_number().over(by)).withColumn("sum__", F.coalesce(F.round(F.sum("evidence_score").over(before), 6), F.lit(0.0)))
    taken = F.col("place") - 1
    stopped = ((F.col("tier") == "HIGH") & (F.col("sum__") > 1.5) & (taken >= 2)) | ((F.col("tier") == "MEDIUM") & (taken >= 4)) | (taken >= 6)
    return numbered.filter(~stopped).drop("sum__")


def sentence_table(hits: DataFrame, shortest: int = 15) -> DataFrame:
    """(query_id, rank, at, sentence): sentences of each hit that are long enough; of equal ones the first of a query."""
    cut = F.transform(T.sentences(F.col("text")), lambda s: F.trim(s))
    each = hits.select("query_id", "query", "rank", "heading", "section", F.posexplode(cut).alias("at", "sentence")).filter(F.length("sentence") >= shortest)
    order = Window.partitionBy("query_id", F.lower("sentence")).orderBy("rank", "at")
    return each.withColumn("rn", F.row_number().over(order)).filter("rn = 1").drop("rn")


def rank_sentences(hits: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, sentence, score, place): content words shared with the query, plus one for each in heading or section."""
    asked = sentence_table(hits).withColumn("q__", T.content_words(F.col("query")))
    shared = F.size(F.array_intersect("q__", T.content_words(F.col("sentence"))))
    low = [F.lower(F.coalesce(c, F.lit(""))) for c in ("heading", "section")]
    extra = F.size(F.filter("q__", lambda w: F.contains(low[0], w) | F.contains(low[1], w)))
    scored = asked.withColumn("score", shared + extra)
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "rank", "at")
    return scored.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= k).select("query_id", "sentence", "score", "place", "rank")


def mmr(sentences: list[str], scores: list[float], most: int = 6, share: float = 0.7) -> list[int]:
    """Greedy choice of what is relevant and unlike what has been chosen."""
    words = [set(re.findall(r"\w+", s.lower())) for s in sentences]
    left, out = list(range(len(sentences))), []
    alike = [0.0] * len(sentences)
    while left and len(out) < most:
        best = max(left, key=lambda i: (share * scores[i] - (1 - share) * 10 * alike[i], -i))
        left.remove(best)
        out.append(best)
        for i in left:
            union = len(words[i] | words[best])
            alike[i] = max(alike[i], len(words[i] & words[best]) / union if union else 0.0)
    return out


def mmr_select(ranked: DataFrame, most: int = 6, share: float = 0.7) -> DataFrame:
    """ranked (query_id, sentence, score, place; a bounded number for each query) -> (query_id, pick, sentence)."""

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("place")
        picks = mmr(group["sentence"].tolist(), group["score"].tolist(), most, share)
        return pd.DataFrame({"query_id": group["query_id"].iloc[0], "pick": range(1, len(picks) + 1), "sentence": group["sentence"].iloc[picks].tolist()})

    return ranked.groupBy("query_id").applyInPandas(choose, "query_id bigint, pick int, sentence string")


def citation_index(hits: DataFrame) -> DataFrame:
    """(query_id, filename, page, citation): sources numbered by first appearance."""
    first = hits.groupBy("query_id", "filename", "page").agg(F.min("rank").alias("first"))
    return first.withColumn("citation", F.row_number().over(Window.partitionBy("query_id").orderBy("first", "filename", "page"))).drop("first")


def map_citations(drafts: DataFrame, hits: DataFrame) -> DataFrame:
    """drafts (query_id, place, sentence) with the chunk_id of the first hit that holds the sentence, blanks aside."""
    bare = lambda c: F.replace(F.col(c), F.lit(" "))
    met = drafts.join(hits.select("query_id", "chunk_id", "rank", "text"), "query_id").filter(F.contains(bare("text"), bare("sentence")))
    first = met.groupBy("query_id", "place").agg(F.min_by("chunk_id", "rank").alias("chunk_id"))
    return drafts.join(first, ["query_id", "place"], "left")


def grounding_check(mapped: DataFrame, evidence: DataFrame) -> DataFrame:
    """(query_id, sentences, cited, unknown, supported): every sentence cites a chunk that is in the query's evidence."""
    known = evidence.select("query_id", "chunk_id").distinct().withColumn("known__", F.lit(1))
    joined = mapped.join(known, ["query_id", "chunk_id"], "left")
    out = joined.groupBy("query_id").agg(
        F.count("*").alias("sentences"), F.count("chunk_id").alias("cited"), F.count_if(F.col("chunk_id").isNotNull() & F.col("known__").isNull()).alias("unknown")
    )
    return out.withColumn("supported", (F.col("sentences") == F.col("cited")) & (F.col("unknown") == 0))


def build_context(hits: DataFrame, most: int = 4) -> DataFrame:
    """Per query and hit, in reading order: the first sentences of each chunk."""
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("version_id", "chunk_index"))
    head = F.array_join(F.slice(F.split("text", r"(?<=[.!?]) +"), 1, most), " ")
    return hits.withColumn("place", order).withColumn("excerpt", head)


def fit_token_window(context: DataFrame, budget: int = 8000) -> DataFrame:
    """context (query_id, chunk_id, relevance, tokens, version_id, chunk_index): the most relevant ones while their running
    total fits, with their place in reading order."""
    by = Window.partitionBy("query_id").orderBy(F.desc("relevance"), "chunk_id").rowsBetween(Window.unboundedPreceding, 0)
    reading = Window.partitionBy("query_id").orderBy("version_id", "chunk_index")
    return context.withColumn("used", F.sum("tokens").over(by)).filter(F.col("used") <= budget).withColumn("place", F.row_number().over(reading))


def truncate_to_budget(context: DataFrame, window: int = 4096, reserved: int = 512) -> DataFrame:
    """context (query_id, query, rank, text): chunks while tokens remain; the first that doesn't fit is cut when over 100
    characters remain, and the rest goes."""
    budget = window - reserved - F.floor(F.length("query") / 4)
    by = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    tokens = F.floor(F.length("text") / 4)
    run = context.withColumn("tokens", tokens).withColumn("sum__", F.sum("tokens").over(by)).withColumn("over__", budget - F.col("sum__") <= 0)
    run = run.withColumn("overs__", F.sum(F.col("over__").cast("int")).over(by)).withColumn("chars__", (budget - F.col("sum__") + F.col("tokens")) * 4)
    kept = run.filter((F.col("overs__") == 0) | (F.col("over__") & (F.col("overs__") == 1) & (F.col("chars__") > 100)))
    cut = F.concat(F.substring(F.col("text"), F.lit(1), F.col("chars__").cast("int")), F.lit("... [TRUNCATED]"))
    return kept.withColumn("text", F.when(F.col("over__"), cut).otherwise(F.col("text"))).withColumn("truncated", F.col("over__")).drop("sum__", "over__", "overs__", "chars__")


#: Words of a question that say nothing about its subject.
QUESTION_WORDS = frozenset("what is the a an how where who when why are do does in of and or for to with".split())
#: What sentences of an intent show.
INTENT_MARKS = {
    "Definition": r"\b(is a|refers to|means|defined as|represents)\b",
    "Timeline": r"\b(19\d{2}|20\d{2}|january|february|march|april|may|june|july|august|september|october|november|december)\b",
    "Comparison": r"\b(vs|versus|difference|compared to|while|however|both|advantages?|disadvantages?)\b",
    "Steps": r"\b(step|first|then|finally|click|use|open|run|execute)\b",
    "FAQ": r"(\?|\b(how|what|why|when|where)\b)",
}


def compress(texts: list[str], tokens: list[int], query: str, intent: str, level: str, max_chunks: int, budget: int) -> list[tuple[int, str, int]]:
    """(chunk, text, tokens) of what is left: repeated, noisy and unrelated short sentences go, then chunks that don't fit."""
    asked = set(re.findall(r"\w+", query.lower())) - QUESTION_WORDS
    mark = INTENT_MARKS.get(intent) if level == "high" else None
    seen, used, out = set(), 0, []
    for i, (text, n) in enumerate(zip(texts[:max_chunks], tokens, strict=False)):
        kept = []
        for part in text.split("."):
            s = part.strip() + "."
            words = set(re.findall(r"\w+", s.lower()))
            key = re.sub(r"[ .]", "", s.lower())
            noise = len(part.strip()) <= 5 or re.fullmatch(r"page \d+", part.strip().lower()) or ("|" in s and "---" in s)
            unrelated = asked and not words & asked and len(words) < 12
            off = mark and not re.search(mark, s, re.I) and len(s.split()) < 15
            if not (noise or key in seen or unrelated or off):
                seen.add(key)
                kept.append(s)
        joined = " ".join(kept)
        size = int(n * len(joined) / max(len(text), 1))
        if kept and used + size <= budget:
            used += size
            out.append((i, joined, size))
    return out


def compress_context(hits: DataFrame, plans: DataFrame) -> DataFrame:
    """hits (query_id, query, rank, text) under plans (query_id, intent, compression, max_chunks, token_budget)."""

    def squeeze(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rank")
        p = group.iloc[0]
        rows = compress(group["text"].tolist(), [len(t) // 4 for t in group["text"]], p["query"], p["intent"], p["compression"], int(p["max_chunks"]), int(p["token_budget"]))
        return pd.DataFrame([(p["query_id"], int(group["rank"].iloc[i]), t, n) for i, t, n in rows], columns=["query_id", "rank", "text", "tokens"])

    joined = hits.select("query_id", "query", "rank", "text").join(plans.select("query_id", "intent", "compression", "max_chunks", "token_budget"), "query_id")
    return joined.groupBy("query_id").applyInPandas(squeeze, "query_id bigint, rank int, text string, tokens int")


#: intent -> format, token budget, words, chunks, compression (fixed values).
PLANS = {
    "Greeting": ("short_answer", 0, 25, 0, "low"),
    "Thanks": ("short_answer", 0, 25, 0, "low"),
    "Help": ("short_answer", 0, 25, 0, "low"),
    "Goodbye": ("short_answer", 0, 25, 0, "low"),
    "Definition": ("definition", 350, 120, 2, "low"),
    "Summary": ("paragraph", 700, 180, 4, "high"),
    "Timeline": ("timeline", 800, 180, 5, "medium"),
    "Comparison": ("comparison_table", 1000, 250, 6, "low"),
    "Table": ("Markdown Table", 1000, 180, 6, "low"),
    "List": ("bullet_list", 800, 180, 5, "low"),
    "Advantages": ("bullet_list", 800, 180, 4, "low"),
    "Disadvantages": ("bullet_list", 800, 180, 4, "low"),
    "Steps": ("numbered_steps", 800, 180, 5, "low"),
    "FAQ": ("faq", 800, 180, 4, "low"),
    "Explanation": ("long_answer", 1200, 180, 5, "low"),
    "ConversationFollowUp": ("paragraph", 500, 180, 3, "high"),
    "Clarification": ("short_answer", 200, 180, 1, "low"),
    "AssistantIdentity": ("paragraph", 1000, 40, 5, "low"),
}
#: intent -> sections of the reply, other than "Answer" (fixed values).
SECTIONS = {
    "Summary": "Executive Summary", "Timeline": "Chronology", "Comparison": "Comparison Table|Summary", "Table": "Table", "List": "Key Points", "Advantages": "Key Points",
    "Disadvantages": "Key Points", "Steps": "Procedure", "FAQ": "Questions and Answers", "Explanation": "Explanation|Details",
}
#: intent -> structure of the reply, other than "Standard" (fixed values).
STRATEGIES = {
    "Comparison": "Comparison Table", "Procedure": "Workflow", "Architecture": "Architecture Overview", "Policy": "Checklist", "Troubleshooting": "Debug Steps",
    "Definition": "Standard Definition",
}
PLAN_ROWS = {k: (*v, SECTIONS.get(k, "Answer")) for k, v in PLANS.items()}
DEFAULT_PLAN = ("paragraph", 1000, 180, 5, "low", "Answer")
PLAN_COLUMNS = ("format", "token_budget", "max_words", "max_chunks", "compression", "sections")


def plan_response(queries: DataFrame) -> DataFrame:
    """queries (intent) with format, budgets, compression and sections (joined by |)."""
    kinds = ("string", "int", "int", "int", "string", "string")
    schema = ", ".join(f"{c} {kind}" for c, kind in zip(PLAN_COLUMNS, kinds, strict=True))
    table = dimension(queries.sparkSession, [(k, *v) for k, v in PLAN_ROWS.items()], f"intent string, {schema}")
    joined = queries.join(F.broadcast(table), "intent", "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in zip(PLAN_COLUMNS, DEFAULT_PLAN, strict=True)})


def plan_strategy(intent: Column) -> Column:
    """The structure that an intent calls for."""
    return F.coalesce(F.create_map(*[F.lit(x) for pair in STRATEGIES.items() for x in pair])[intent], F.lit("Standard"))


#: format -> words that ask for it, in order (fixed values).
FORMATS = {
    "Markdown table": ("compare", "difference between", "vs"),
    "Numbered steps": ("how to", "steps", "guide", "process"),
    "Bullet list": ("list", "what are the", "features", "benefits"),
    "FAQ": ("faq", "frequently asked"),
    "Policy": ("policy", "rules", "handbook"),
}


def plan_format(text: Column) -> Column:
    """The format that the words of a query ask for."""
    low, out = F.lower(text), None
    for name, terms in FORMATS.items():
        hit = F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(low, t))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("Paragraph")


def compose_extract(hits: DataFrame, plans: DataFrame) -> DataFrame:
    """(query_id, sentences, draft): sentences over 10 characters in order, max(10, words * 1.5 / 15) at most."""
    parts = F.filter(F.transform(F.split("text", r"[.\n]+"), lambda s: F.trim(s)), lambda s: F.length(s) > 10)
    each = hits.select("query_id", F.struct("rank", parts.alias("parts")).alias("x"))
    joined = each.groupBy("query_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["parts"])).alias("all")).join(plans.select("query_id", "max_words"), "query_id")
    most = F.greatest(F.lit(10), F.floor(F.col("max_words") * 1.5 / 15)).cast("int")
    short = joined.withColumn("kept", F.slice("all", F.lit(1), most))
    return short.select("query_id", F.size("kept").alias("sentences"), F.concat(F.array_join("kept", ".\n"), F.lit(".")).alias("draft"))


def format_answer(sentences: DataFrame, formats: DataFrame, sources: DataFrame) -> DataFrame:
    """sentences (query_id, section, place, sentence), formats (query_id, format), sources (query_id, citation, filename,
    page) -> (query_id, answer)."""
    s = sentences.groupBy("query_id", "section").agg(F.min("place").alias("first"), F.sort_array(F.collect_list(F.struct("place", "sentence"))).alias("rows"))
    s = s.withColumn("texts", F.transform("rows", lambda r: r["sentence"]))
    own = F.struct("first", F.col("section").alias("section"), F.col("texts").alias("texts"))
    grouped = s.groupBy("query_id").agg(F.sort_array(F.collect_list(own)).alias("sections")).join(formats, "query_id")
    general = lambda x: x["section"] == "General"
    head = lambda mark: lambda x: F.when(general(x), "").otherwise(F.concat(F.lit(mark), x["section"], F.lit("\n")))
    flat = lambda x: F.array_join(x["texts"], " ")
    each = lambda f: F.array_join(F.transform("sections", f), "")
    before = lambda x: F.aggregate("sections", F.lit(0), lambda a, y: a + F.when(y["first"] < x["first"], F.size(y["texts"])).otherwise(0))
    end = lambda x: F.when(general(x), "").otherwise("\n")
    body = (
        F.when(F.col("format") == "Markdown table", F.concat(F.lit("| Section | Detail |\n|---------|--------|\n"), each(lambda x: F.concat(F.lit("| **"), x["section"], F.lit("** | "), flat(x), F.lit(" |\n")))))
        .when(F.col("format") == "Numbered steps", each(lambda x: F.concat(head("### ")(x), F.array_join(F.transform(x["texts"], lambda t, i: F.concat((before(x) + i + 1).cast("string"), F.lit(". "), t, F.lit("\n"))), ""), end(x))))
        .when(F.col("format") == "Bullet list", each(lambda x: F.concat(head("### ")(x), F.array_join(F.transform(x["texts"], lambda t: F.concat(F.lit("- "), t, F.lit("\n"))), ""), end(x))))
        .when(F.col("format") == "FAQ", each(lambda x: F.concat(F.when(general(x), "").otherwise(F.concat(F.lit("**Q: What about "), x["section"], F.lit("?**\n"))), F.lit("A: "), flat(x), F.lit("\n\n"))))
        .when(F.col("format") == "Policy", each(lambda x: F.concat(head("#### ")(x), flat(x), F.lit("\n\n"))))
        .otherwise(each(lambda x: F.concat(head("### ")(x), flat(x), F.lit("\n\n"))))
    )
    line = F.concat(F.lit("["), F.col("citation").cast("string"), F.lit("] "), F.col("filename"), F.lit(", page "), F.col("page").cast("string"))
    cited = sources.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("citation", line.alias("line")))), lambda x: x["line"]), "\n").alias("sources"))
    joined = grouped.withColumn("body", body).join(cited, "query_id", "left")
    return joined.select("query_id", F.regexp_replace(F.concat("body", F.coalesce(F.concat(F.lit("\n**Sources:**\n"), "sources"), F.lit(""))), r"\A\s+|\s+\z", "").alias("answer"))


#: What an answer must not show.
LEAKS = ("chunk_id", "similarity", "telemetry", "embedding", "system prompt", "instruction", "rag_eligible", "confidence_tier", "retrievedchunks", "metadata", "fastpathmatched")
UUID = r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"


def answer_quality(text: Column) -> Column:
    """Why an answer is rejected; null if it isn't."""
    low = F.lower(text)
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: F.length(x) > 0)
    bullet = lambda x: x.startswith("•") | x.startswith("-") | x.startswith("*")
    bullets = F.filter(lines, bullet)
    paragraphs = F.filter(lines, lambda x: ~bullet(x) & (F.length(x) > 50))
    repeated = lambda a: F.size(F.array_distinct(a)) < F.size(a)
    return (
        F.when(F.length(F.trim(text)) == 0, "empty")
        .when(F.exists(F.array(*[F.lit(k) for k in LEAKS]), lambda k: F.contains(low, k)), "leak")
        .when(low.rlike(UUID), "uuid")
        .when(low.rlike(r"(score|similarity)[:=]\s*0\.\d+"), "score")
        .when(F.regexp_count(text, F.lit("```")) % 2 != 0, "fence")
        .when(repeated(bullets), "bullets")
        .when(repeated(paragraphs), "paragraphs")
    )


def hits_by_reason(gated: DataFrame) -> DataFrame:
    return gated.groupBy(F.coalesce("reason", F.lit("ACCEPTED")).alias("reason")).agg(F.count("*").alias("chunks"))


def best_hits(hits: DataFrame, k: int) -> DataFrame:
    return top_k(hits, k, "evidence_score")
