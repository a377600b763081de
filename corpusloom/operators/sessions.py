"""Conversation analytics: windows over the turns (conv_id, turn, role, text) of each session. A session is bounded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from corpusloom.operators.querylog import classify_intent

#: Words that point back, words that ask for a summary, topics with their patterns.
PRONOUNS = ("it", "they", "he", "she", "this", "that", "its", "their")
SUMMARY_WORDS = ("brief", "summarize", "short", "summary", "detail")
TOPICS = (("Policy", "policy"), ("Company Info", "project|service"), ("HR Policies", "hr|leave"), ("Security", "security"))
PLEASANTRIES = ("hi", "hello", "thanks", "thank you", "goodbye", "ok")


def by_session() -> WindowSpec:
    return Window.partitionBy("conv_id").orderBy("turn")


def before() -> WindowSpec:
    return by_session().rowsBetween(Window.unboundedPreceding, -1)


def history_window(turns: DataFrame, n: int = 6) -> DataFrame:
    """User turns with the up to n messages before each."""
    item = F.concat_ws(": ", "role", "text")
    return turns.withColumn("history", F.collect_list(item).over(by_session().rowsBetween(-n, -1))).filter("role = 'user'")


def _words(text: Column) -> Column:
    return F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda w: F.length(w) > 0))


def resolve_followup(turns: DataFrame) -> DataFrame:
    """User turns with `resolved`: a short, pronominal or summarising one gets the last substantive user turn."""
    bare = F.trim(F.regexp_replace(F.lower("text"), r"\b(hi|hello|gm|hey|tell|about|what|is|the)\b", ""))
    topic = F.last(F.when((F.col("role") == "user") & (F.length(bare) > 3), F.col("text")), ignorenulls=True).over(before())
    low = F.lower("text")
    depends = low.rlike(rf"\b({'|'.join(PRONOUNS)})\b") | (_words(F.col("text")) <= 5) | low.rlike("|".join(SUMMARY_WORDS))
    clean = F.regexp_replace("topic__", r"[#*>\n]", " ")
    out = turns.withColumn("topic__", topic).filter("role = 'user'")
    return out.withColumn("resolved", F.when(depends & F.col("topic__").isNotNull(), F.concat("text", F.lit(" regarding "), clean)).otherwise(F.col("text"))).drop("topic__")


def substitute_pronoun(turns: DataFrame) -> DataFrame:
    """User turns with `rewritten`: pronouns replaced by the noun phrase of the question before, or "of" it added."""
    users = turns.filter("role = 'user'").withColumn("before__", F.lag("text").over(by_session()))
    noun = F.trim(F.replace(F.regexp_replace("before__", r"(?i)^(what|who|where|when|why|how|tell me about|explain|summarize) (is|was|are|does|the|a|an)?\s*", ""), F.lit("?")))
    low = F.lower("text")
    # What is put in is plain text to the pattern.
    plain = F.regexp_replace("noun__", r"([\\$])", r"\\$1")
    users = users.withColumn("noun__", noun)
    text = (
        F.when(F.coalesce("noun__", F.lit("")) == "", F.col("text"))
        .when(low.rlike(r"\b(its|their)\b"), F.regexp_replace("text", F.lit(r"(?i)\b(its|their)\b"), F.concat(plain, F.lit("'s"))))
        .when(low.rlike(r"\b(it|they|this|that|he|she)\b"), F.regexp_replace("text", F.lit(r"(?i)\b(it|they|this|that|he|she)\b"), plain))
        .otherwise(F.concat("text", F.lit(" of "), "noun__"))
    )
    return users.withColumn("rewritten", text).drop("before__", "noun__")


def recent_entity(turns: DataFrame, entities: list[str]) -> DataFrame:
    """Turns with the entity that was mentioned last before each; ambiguous where a pronoun has none."""
    pattern = "|".join(rf"\b{e}\b" for e in entities)
    found = F.element_at(F.regexp_extract_all(F.lower("text"), F.lit(f"({pattern})"), F.lit(1)), -1)
    own = F.when(F.lower("text").rlike(pattern), found)
    out = turns.withColumn("own__", own).withColumn("recent_entity", F.last("own__", ignorenulls=True).over(before()))
    pronoun = F.lower("text").rlike(r"\b(it|they|them|this|that|he|she)\b")
    return out.withColumn("ambiguous", pronoun & F.col("recent_entity").isNull()).drop("own__")


def topic_of(text: Column, topics: tuple = TOPICS) -> Column:
    out = None
    for name, pattern in topics:
        hit = F.lower(text).rlike(pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def topic_switches(turns: DataFrame, topics: tuple = TOPICS) -> DataFrame:
    users = turns.filter("role = 'user'").withColumn("topic", topic_of(F.col("text"), topics))
    users = users.withColumn("active_topic", F.last("topic", ignorenulls=True).over(before()))
    return users.withColumn("switched", F.coalesce(F.col("topic") != F.col("active_topic"), F.lit(False)))


def resolution_confidence(turns: DataFrame, entities: list[str], topics: tuple = TOPICS, followups: tuple[str, ...] = ("tell me more", "more", "why", "how", "when", "where")) -> DataFrame:
    """User turns with confidence and needs_clarification (below 0.5)."""
    both = topic_switches(recent_entity(turns, entities), topics)
    low = F.trim(F.regexp_replace(F.lower("text"), r"[^\w\s]", ""))
    follow = low.isin(*followups) | F.lower("text").rlike("^(what about|and) ")
    known = F.coalesce("topic", "active_topic").isNotNull()
    by_follow = F.when(low.isin(*followups) & known, 0.9).when(follow & ~known, 0.3).otherwise(1.0)
    pronoun = F.lower("text").rlike(r"\b(it|they|them|this|that|he|she)\b")
    by_pronoun = F.when(~pronoun, 1.0).when(F.col("recent_entity").isNotNull(), 0.8).when(known, 0.7).otherwise(0.2)
    out = both.withColumn("confidence", F.least(by_follow, by_pronoun))
    return out.withColumn("needs_clarification", F.col("confidence") < 0.5)


def pair_turns(turns: DataFrame) -> DataFrame:
    """User turns with the assistant's reply that follows, if one does."""
    reply = F.when(F.lead("role").over(by_session()) == "assistant", F.lead("text").over(by_session()))
    return turns.withColumn("reply", reply).filter("role = 'user'")


def session_tokens(turns: DataFrame, limit: int = 4000) -> DataFrame:
    """(conv_id, tokens, over_turn): the running estimate at the end and the turn at which it passes the limit."""
    run = turns.withColumn("tokens", F.floor(_words(F.col("text")) * 1.3)).withColumn("total", F.sum("tokens").over(by_session()))
    return run.groupBy("conv_id").agg(F.max("total").alias("tokens"), F.min(F.when(F.col("total") > limit, F.col("turn"))).alias("over_turn"))


def session_memory(turns: DataFrame, limit: int = 4000) -> DataFrame:
    """(conv_id, kept, tokens, summaries): a session's memory after its last turn. Whenever its tokens pass the limit, the
    older half of its messages makes way for a summary and the tokens are halved. A fold over the session's token counts."""
    counts = F.floor(_words(F.col("text")) * 1.3).cast("bigint")
    lists = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", counts.alias("n")))).alias("l"))
    state = lambda kept, tokens, summaries: F.struct(kept.cast("bigint").alias("kept"), tokens.cast("bigint").alias("tokens"), summaries.cast("bigint").alias("summaries"))

    def step(s: Column, x: Column) -> Column:
        kept, tokens = s["kept"] + 1, s["tokens"] + x["n"]
        over = tokens > limit
        return state(
            F.when(over, kept - F.floor(kept / 2)).otherwise(kept), F.when(over, F.floor(tokens / 2)).otherwise(tokens), s["summaries"] + over.cast("bigint")
        )

    return lists.select("conv_id", F.aggregate("l", state(F.lit(0), F.lit(0), F.lit(0)), step).alias("s")).select("conv_id", "s.*")


def compress_sessions(turns: DataFrame, most: int = 20, keep: int = 4, topics: tuple = (("Policy", "policy"), ("Projects", "project"))) -> DataFrame:
    """(conv_id, kept, summary) of sessions over `most` messages: the last ones stay, of the rest the topics."""
    last = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    size = F.count("*").over(Window.partitionBy("conv_id"))
    split = turns.withColumn("last", last).withColumn("size", size).filter(F.col("size") > most)
    found = [F.max(F.when((F.col("last") > keep) & F.lower("text").rlike(p), name)) for name, p in topics]
    agg = split.groupBy("conv_id").agg(F.count_if(F.col("last") <= keep).alias("kept"), *[f.alias(f"t{i}") for i, f in enumerate(found)])
    names = F.array_join(F.array(*[F.col(f"t{i}") for i in range(len(topics))]), ", ")
    return agg.select("conv_id", "kept", F.when(names == "", "various topics").otherwise(names).alias("summary"))


def filter_pleasantries(turns: DataFrame) -> DataFrame:
    return turns.filter(~F.trim(F.lower("text")).isin(*PLEASANTRIES))


def greets(role: Column, text: Column) -> Column:
    return (role == "user") & F.lower(text).rlike(r"^(hi|hello|hey|good (morning|afternoon|evening))\b")


def name_in(text: Column) -> Column:
    """The name that a turn introduces, or null."""
    return F.nullif(F.regexp_extract(F.lower(text), r"\bmy name is ([a-z]+)", 1), F.lit(""))


def preview_of(answer: Column) -> Column:
    return F.when(F.length(answer) > 200, F.concat(F.substring(answer, 1, 200), F.lit("..."))).otherwise(answer)


def session_profile(turns: DataFrame) -> DataFrame:
    """Per session: turns, first and last turn, greetings, the name introduced last, the last user turn's intent, a preview of
    the last answer."""
    name = name_in(F.col("text"))
    answered = (F.col("role") == "assistant") & F.col("text").isNotNull()
    answer = F.max_by(F.when(answered, F.col("text")), F.when(answered, F.col("turn")))
    out = turns.groupBy("conv_id").agg(
        F.count("*").alias("turns"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count_if(greets(F.col("role"), F.col("text"))).alias("greetings"),
        F.max_by(name, F.when(name.isNotNull(), F.col("turn"))).alias("name"), answer.alias("answer"),
        F.max_by(classify_intent(F.col("text")), F.when(F.col("role") == "user", F.col("turn"))).alias("last_intent"),
    )
    return out.withColumn("preview", preview_of(F.col("answer"))).drop("answer")
