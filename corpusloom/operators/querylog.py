"""Query-log text: normalising, classifying and routing a table of user turns (text column: text)."""

from __future__ import annotations

import difflib
import unicodedata
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import dictionaries as D
from corpusloom.functions import text as T
from corpusloom.operators.retrieve import char_runs, dimension, held
from corpusloom.sources.tables import counted, written

KEYWORD_STOP = (*T.STOP_WORDS, "please", "tell", "me", "about", "show", "give", "provide", "details", "information")


def nfkc(text: Column) -> Column:
    """Unicode NFKC, which Spark has no expression for."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        # Arrow's utf8_normalize leaves letters decomposed, whatever form it is asked for.
        return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")

    return run(text)


def _letters(word: str) -> str:
    return "".join(f"{c}+" if c != " " else r"\s*" for c in word)


#: Stretched greetings and what they stand for, in order.
STRETCHED = [(r"h+e+y+a*", "hey"), (r"h+e+l+l+o+", "hello"), (r"h+e+l+o+", "hello"), (r"h+i+e*", "hi"), (r"h+y+", "hi")] + [
    (_letters(w), w) for w in ("good morning", "good evening", "good afternoon", "good night", "morning", "night")
]


def normalize_text(text: Column) -> Column:
    """13 steps: NFKC, lower case, zero-width, white space, emoji, punctuation, symbols, spaced letters, stretched greetings,
    corrections, digits after greetings, blanks, ends."""
    t = F.lower(nfkc(text))
    t = F.regexp_replace(t, r"[\u200b-\u200d\ufeff]", "")
    t = F.regexp_replace(t, r"[\x{1F000}-\x{1FAF6}\u2600-\u27bf]", "")
    t = F.regexp_replace(t, "[’'‘]", "")
    t = F.regexp_replace(t, r"[?,.!;:()\-+=\[\]{}@#$%^&*~_/\\|<>]", " ")
    t = F.trim(F.regexp_replace(F.regexp_replace(t, r"[^a-zA-Z0-9\s]", ""), r"\s+", " "))
    words = F.split(t, " ")
    # Letters typed apart: every token is one letter, perhaps repeated.
    spaced = F.forall(words, lambda w: w.rlike(r"^([a-z])\1*$"))
    t = F.when(spaced, F.array_join(words, "")).otherwise(t)
    for pattern, word in STRETCHED:
        t = F.regexp_replace(t, rf"\b{pattern}(?=[0-9\s]|$)", word)
    t = F.array_join(F.transform(F.split(t, " "), lambda w: F.coalesce(_map(D.CORRECTIONS)[w], w)), " ")
    greetings = sorted({p for g in D.GREETINGS.values() for p in g} | set(D.CORRECTIONS), key=len, reverse=True)
    t = F.regexp_replace(t, r"\b(" + "|".join(g.replace(" ", r"\s+") for g in greetings) + r")\s*[0-9]+\b", "$1")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


STRETCHED_ASCII = ((r"h(i+)", "hi"), (r"h(i+)(y+)(a*)", "hiya"), (r"h(e+)(y+)(a*)", "hey"), (r"h(e+)(l+)(o+)", "hello"), (r"b(y+)(e+)", "bye"), (r"thank(s+)", "thanks"))
SHORT_ASCII = (("gm", "good morning"), ("goodmorning", "good morning"), ("goodnight", "good night"))


def normalize_ascii(text: Column) -> Column:
    """ASCII only, without punctuation; stretched greetings and characters repeated three times or more are collapsed."""
    t = F.regexp_replace(F.lower(F.trim(F.regexp_replace(nfkc(text), r"[^\x00-\x7F]", ""))), r"[^\w\s]", "")
    for pattern, word in STRETCHED_ASCII:
        t = F.regexp_replace(t, rf"\b{pattern}\b", word)
    t = F.regexp_replace(t, r"(.)\1{2,}", "$1")
    for short, long in SHORT_ASCII:
        t = F.regexp_replace(t, rf"\b{short}\b", long)
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def simple_ascii(text: Column) -> Column:
    """Lower case, ASCII words and blanks only."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9_\s]", ""), r"\s+", " "))


def ladder(text: Column, patterns: dict[str, str], otherwise: str) -> Column:
    """The name of the first pattern that is found."""
    out = None
    for name, pattern in patterns.items():
        out = F.when(text.rlike(pattern), name) if out is None else out.when(text.rlike(pattern), name)
    return out.otherwise(otherwise)


def query_analysis(turns: DataFrame) -> DataFrame:
    t = F.regexp_replace(F.translate(F.regexp_replace(F.trim(F.lower("text")), r"\s+", " "), "’‘", "''"), r"\?+$", "")
    for pattern, word in ((r"\bhi+\b", "hi"), (r"\bhe+y+\b", "hey"), (r"\bhe+l+o+\b", "hello")):
        t = F.regexp_replace(t, pattern, word)
    return turns.withColumn("normalized", t).withColumns(
        {
            "question_type": ladder(F.col("normalized"), D.QUESTION_TYPES, "statement"),
            "expectation": ladder(F.col("normalized"), D.EXPECTATIONS, "standard"),
            "abbreviations": F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b[A-Z]{2,}\b"), F.lit(0))),
        }
    )


def tokenize(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: F.length(w) > 0)


def extract_keywords(text: Column) -> Column:
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9\-]+"), F.lit(0)))
    stop = F.array(*[F.lit(w) for w in KEYWORD_STOP])
    return F.filter(F.array_except(words, stop), lambda w: F.length(w) > 2)


def apply_corrections(text: Column, corrections: dict[str, str] = D.CORRECTIONS) -> Column:
    fixes = _map(corrections)
    return F.array_join(F.transform(F.split(text, " "), lambda w: F.coalesce(fixes[w], w)), " ")


def fuzzy_correct(tokens: DataFrame, vocabulary: DataFrame, least: float = 0.75, short: float = 0.85) -> DataFrame:
    """tokens (token) -> (token, corrected): the nearest vocabulary word by Ratcliff/Obershelp at `least` or above (`short`
    under five characters), else the token. Only distinct tokens are compared, and only with words of a fitting length that
    share two letters in a row."""
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(2))))
    each = tokens.select("token").distinct()
    left = each.join(vocabulary.select(F.col("word").alias("token")), "token", "left_anti").withColumn("g", F.explode(grams(F.col("token"))))
    right = vocabulary.select("word", F.explode(grams(F.col("word"))).alias("g"))
    fits = F.least(F.length("token"), F.length("word")) * 2 >= least * (F.length("token") + F.length("word"))
    pairs = left.join(counted(right), "g").filter(fits).select("token", "word").distinct()

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, y, x, autojunk=False).ratio() for x, y in zip(a, b, strict=True)])

    scored = pairs.withColumn("ratio", ratio("token", "word")).filter(F.col("ratio") >= F.when(F.length("token") < 5, short).otherwise(least))
    best = scored.groupBy("token").agg(F.max_by("word", F.struct("ratio", "word")).alias("word"))
    return each.join(best, "token", "left").select("token", F.coalesce("word", "token").alias("corrected"))


def _phrases(*groups: dict[str, list[str]]) -> list[str]:
    return sorted({p for g in groups for ps in g.values() for p in ps}, key=lambda p: (-len(p.split()), -len(p), p))


def alias_table(spark, aliases: dict[str, str] = D.ALIASES) -> DataFrame:
    """(alias, replacement)."""
    return dimension(spark, list(aliases.items()), "alias string, replacement string")


def resolve_aliases(texts: DataFrame, aliases: DataFrame | None = None, protected: tuple[str, ...] | None = None, text: str = "text", out: str = "resolved") -> DataFrame:
    """texts with `out`: whole alias phrases (alias, replacement) replaced, conversational phrases (`protected`) left as they are.

    Words and what stands between them are pieces; runs of pieces meet aliases by an equal key, so their number costs
    nothing. From left to right, the first hit counts, at one place a protected one before aliases and longer ones before
    shorter ones; what overlaps a hit that counts is left out. Case is ignored. Distinct texts are resolved once."""
    spark = texts.sparkSession
    aliases = alias_table(spark) if aliases is None else aliases
    kept = _phrases(D.GREETINGS, D.GOODBYES, D.THANKS, D.SMALL_TALK) if protected is None else protected
    pieces = lambda c: F.regexp_extract_all(c, F.lit(r"(?U)\w+|[^\w]+"), F.lit(0))
    table = aliases.select(F.lower("alias").alias("run"), "replacement", F.lit(1).alias("kind"))
    if kept:
        table = table.unionByName(dimension(spark, [(p.lower(),) for p in kept], "run string").select("run", F.lit(None).cast("string").alias("replacement"), F.lit(0).alias("kind")))
    # Of equal phrases the protected one, else the least replacement.
    table = table.filter("run <> ''").groupBy("run").agg(F.min_by("replacement", F.struct("kind", "replacement")).alias("replacement"), F.min("kind").alias("kind"))
    table = written(table.withColumn("n", F.size(pieces(F.col("run")))), "aliases")
    lengths = sorted(r.n for r in table.select("n").distinct().collect())
    each = texts.select(F.col(text).alias("text__")).filter("text__ is not null").distinct()
    each = written(each.select(F.md5("text__").alias("tid"), pieces(F.col("text__")).alias("pieces"), pieces(F.lower("text__")).alias("low")), "pieces")
    none = F.array().cast("array<struct<start:int,n:int,run:string>>")
    run = lambda n: F.transform(F.sequence(F.lit(1), F.size("low") - n + 1), lambda i: F.struct(i.alias("start"), F.lit(n).alias("n"), F.array_join(F.slice("low", i, F.lit(n)), "").alias("run")))
    runs = F.concat(none, *[F.coalesce(F.when(F.size("low") >= n, run(n)), none) for n in lengths])
    hits = each.select("tid", F.explode(runs).alias("r")).select("tid", "r.*").join(counted(table.select("run", "replacement", "kind")), "run")
    n_words = F.size(F.split("run", " "))
    order = F.struct("start", "kind", (-n_words).alias("words"), (-F.length("run")).alias("chars"), "n", "replacement")
    found = hits.groupBy("tid").agg(F.sort_array(F.collect_list(order)).alias("hits"))
    part = "struct<at:int,parts:array<string>>"
    both = each.join(found, "tid")

    def step(p: Column):
        def choose(s: Column, h: Column) -> Column:
            before = F.array_join(F.slice(p, s["at"], h["start"] - s["at"]), "")
            own = F.coalesce(h["replacement"], F.array_join(F.slice(p, h["start"], h["n"]), ""))
            taken = F.struct((h["start"] + h["n"]).cast("int").alias("at"), F.concat(s["parts"], F.array(before, own)).alias("parts"))
            return F.when(h["start"] >= s["at"], taken).otherwise(s)

        return choose

    begin = F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("parts")).cast(part)
    walked = both.select("tid", "pieces", F.aggregate("hits", begin, step(F.col("pieces"))).alias("s"))
    rest = F.array_join(F.slice("pieces", F.col("s.at"), F.size("pieces")), "")
    done = walked.select("tid", F.concat(F.array_join("s.parts", ""), rest).alias("new__"))
    named = texts.withColumn("tid__", F.md5(F.col(text)))
    return named.join(done.withColumnRenamed("tid", "tid__"), "tid__", "left").withColumn(out, F.coalesce("new__", text)).drop("tid__", "new__")


def phrase_table(spark, groups: dict[str, list[str]]) -> DataFrame:
    """(group, phrase, n_words)."""
    return dimension(spark, [(g, p, len(p.split())) for g, ps in groups.items() for p in ps], "grp string, phrase string, n_words int")


def longest_phrase_match(turns: DataFrame, phrases: DataFrame, keys: list[str], longest: int = 4) -> DataFrame:
    """keys, phrase, grp, start, n_words, remainder: the longest phrase anywhere in the turn's tokens (most words, then most
    characters, then the first place); turns without one are left out."""
    w = turns.select(*keys, tokenize(F.lower("text")).alias("w"))
    none = F.array().cast("array<struct<start:int,phrase:string>>")

    def runs(n: int) -> Column:
        of = F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.struct(i.alias("start"), F.array_join(F.slice("w", i, F.lit(n)), " ").alias("phrase")))
        return F.when(F.size("w") >= n, of).otherwise(none)

    grams = w.withColumn("g", F.explode(F.concat(*[runs(n) for n in range(1, longest + 1)]))).select(*keys, "w", "g.start", "g.phrase")
    met = grams.join(counted(phrases), "phrase")
    best = met.groupBy(*keys).agg(F.max_by(F.struct("phrase", "grp", "start", "n_words", "w"), F.struct("n_words", F.length("phrase"), -F.col("start"), "grp")).alias("b"))
    rest = F.concat(F.slice("b.w", F.lit(1), F.col("b.start") - 1), F.slice("b.w", F.col("b.start") + F.col("b.n_words"), F.size("b.w")))
    return best.select(*keys, "b.phrase", "b.grp", (F.col("b.start") - 1).alias("start"), "b.n_words", F.array_join(rest, " ").alias("remainder"))


def profane_words(text: Column, profane: tuple[str, ...] = D.PROFANITY) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9_]+"), F.lit(0))
    return F.array_sort(F.array_intersect(words, F.array(*[F.lit(w) for w in profane])))


def prompt_injection(text: Column) -> Column:
    return F.lower(text).rlike("|".join(D.INJECTION))


def is_empty(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s\u200b-\u200d\ufeff]+", "")) == 0


_CONSONANT = "[bcdfghjklmnpqrstvwxz]"
_VOWELS = "aeiouy"
#: (condition on the token t, confidence), in order; conditions are patterns or templates that Spark and DuckDB both take.
GIBBERISH_RULES: list[tuple[str, float]] = [
    ("regexp(t, '^[b-hj-z]$')", 0.8),
    ("length(t) >= 2 AND replace(t, substr(t, 1, 1), '') = '' AND t NOT IN ('ok', 'hi', 'yo', 'no', 'go')", 0.9),
    (f"regexp(t, '{'|'.join(c * 3 for c in 'abcdefghijklmnopqrstuvwxyz0123456789')}')", 0.9),
    *[(f"length(t) >= {max(4, 2 * n - 1)} AND substr(repeat(substr(t, 1, {n}), length(t)), 1, length(t)) = t AND t NOT IN ('haha', 'meme', 'dada', 'papa', 'coco', 'test')", 0.8) for n in (2, 3)],
    (f"regexp(t, '{'|'.join(r[i : i + 4] for row in D.KEYBOARD for r in (row, row[::-1]) for i in range(len(row) - 3))}')", 1.0),
    ("regexp(t, '[0-9]') AND regexp(t, '[a-z]')", 0.8),
    ("NOT regexp(t, '[aeiouy]') AND length(t) >= 4", 0.9),
    ("NOT regexp(t, '[aeiouy]')", 0.8),
    (f"regexp(t, '{_CONSONANT}{{6}}')", 0.9),
    ("length(t) >= 6 AND 4 * length(translate(t, 'bcdfghjklmnpqrstvwxz', '')) < length(t)", 0.8),
    ("length(t) <= 3 AND length(t) >= 2", 0.8),
    *[(f"regexp(t, '^[{row}]+$')", 0.9) for row in D.KEYBOARD],
    (f"regexp(t, '[jq]{_CONSONANT}|{_CONSONANT}q|v[bcdfghjkmnpqstvwxz]|x[bdgjklmnqrvwxz]|h[bcdfghjklmnpqsvxz]')", 0.7),
    (f"regexp(t, '{'|'.join(''.join(v) for v in product(_VOWELS, repeat=3) if ''.join(v) not in D.ALLOWED_VOWELS)}')", 0.9),
]


def gibberish_sql(regexp: str) -> str:
    """The rules as a CASE over t (a bare token) and known; `regexp` is the engine's function."""
    whens = " ".join(f"WHEN {c.replace('regexp(', regexp + '(')} THEN {v}" for c, v in GIBBERISH_RULES)
    return f"CASE WHEN t = '' OR {regexp}(t, '^[0-9]+$') OR known THEN 0.0 {whens} ELSE 0.1 END"


def token_gibberish(tokens: DataFrame, known: DataFrame) -> DataFrame:
    """(token, confidence) of each distinct token; known: (word)."""
    bare = tokens.select("token").distinct().withColumn("t", F.regexp_replace(F.lower("token"), "[^a-z0-9]", ""))
    joined = bare.join(known.select(F.col("word").alias("t"), F.lit(True).alias("known")), "t", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    return joined.select("token", F.expr(gibberish_sql("regexp")).cast("double").alias("confidence"))


def flag_gibberish(turns: DataFrame, known: DataFrame, content: DataFrame, keys: list[str]) -> DataFrame:
    """keys, gibberish. known: words that are never gibberish, content: those that save a whole turn."""
    s = turns.select(*keys, F.trim("text").alias("s"), F.split(F.translate(F.trim("text"), "_", " "), " ").alias("w"))
    each = s.select(*keys, F.explode_outer(F.filter("w", lambda x: F.length(x) > 0)).alias("token"))
    scored = each.join(token_gibberish(each.filter("token is not null"), known), "token", "left")
    t = F.regexp_replace(F.lower("token"), "[^a-z0-9]", "")
    mark = lambda df, name: df.select(F.col("word").alias("t"), F.lit(True).alias(name))
    joined = scored.withColumn("t", t).join(mark(known, "known"), "t", "left").join(mark(content, "content"), "t", "left")
    bad = F.col("confidence") >= 0.7
    plain = F.coalesce("known", F.lit(False)) & F.col("content").isNull()
    sums = joined.groupBy(*keys).agg(
        F.count("token").alias("n"), F.count_if(bad).alias("bad"), F.count("content").alias("content"), F.count_if(~bad & (F.col("known") | F.col("token").rlike("^[0-9]+$"))).alias("known"),
        F.count_if(bad | plain).alias("structural"),
    )
    rule = (
        F.when(F.col("s") == "", False)
        .when(~F.col("s").rlike(r"[\p{L}\p{N}]"), True)
        .when(~F.col("s").rlike(r"\p{L}") & (F.length("s") >= 6), True)
        .when((F.col("n") == 0) | (F.col("content") > 0), False)
        .when(F.col("n") == 1, F.col("bad") == 1)
        .otherwise((2 * F.col("bad") >= F.col("n")) | (F.col("structural") == F.col("n")) | (F.col("known") < 0.35 * F.col("n")))
    )
    return s.join(sums, keys).select(*keys, rule.alias("gibberish"))


def classify_intent(text: Column) -> Column:
    return ladder(F.lower(text), D.INTENTS, "Unknown")


def short_or_symbol(text: Column) -> Column:
    """Gibberish of the fast path: short, or with odd symbols, unless a plain question word is in it."""
    plain = F.arrays_overlap(F.split(text, " "), F.array(*[F.lit(w) for w in D.PLAIN_WORDS]))
    return ~plain & ((F.length(F.trim(text)) < 6) | text.rlike(r"[^a-zA-Z0-9\s.,?!]"))


def classify_fastpath(turns: DataFrame, norm: str = "norm") -> DataFrame:
    """turns (norm) with intent, confidence, greeting_matched and what the greeting leaves (processed)."""
    greeted = F.col(norm).rlike(D.GREETING)
    left = F.trim(F.regexp_replace(F.trim(F.regexp_replace(norm, D.GREETING, "")), D.AFTER_GREETING, ""))
    t = turns.withColumn("greeting_matched", greeted).withColumn("processed", F.when(greeted, left).otherwise(F.col(norm)))
    p = F.col("processed")
    intent = F.when(F.col(norm) == "", "Empty").when(p == "", "Greeting").when(short_or_symbol(p), "Gibberish")
    sure = F.when(F.col(norm) == "", 1.0).when(p == "", 1.0).when(short_or_symbol(p), 0.99)
    for name, (pattern, confidence) in D.FASTPATH.items():
        intent, sure = intent.when(p.rlike(pattern), name), sure.when(p.rlike(pattern), confidence)
    poor = (F.length(F.replace(p, F.lit(" "))) < 4) & ~p.isin("who", "why", "how", "what", "when")
    many = F.size(F.split(p, " ")) >= 2
    intent = intent.when(poor, "Gibberish").when(many, "KnowledgeQuery").otherwise("Unknown")
    sure = sure.when(poor, 0.99).when(many, 0.85).otherwise(0.35)
    return t.withColumns({"intent": intent, "confidence": sure})


def knowledge_table(spark, entries=D.KNOWLEDGE) -> DataFrame:
    rows = [(i, e[0], e[1], "|".join(e[2]), "|".join(e[3]), e[4]) for i, e in enumerate(entries)]
    flat = dimension(spark, rows, "place int, intent_id string, title string, keywords string, phrases string, threshold double")
    return flat.withColumns({"keywords": F.split("keywords", r"\|"), "phrases": F.split("phrases", r"\|")})


def _ratio(a: Column, b: Column) -> Column:
    """Ratcliff/Obershelp similarity of a and b, 0 to 1."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, j, i, autojunk=False).ratio() for i, j in zip(x, y, strict=True)], dtype="float64")

    return run(a, b)


def _alike(x: str, y: str, least: float) -> Column:
    """Whether lengths allow the ratio."""
    return 2 * F.least(F.length(x), F.length(y)) >= least * (F.length(x) + F.length(y))


#: The score of a text that shares but a part of a word with an entry.
PART = 0.63
#: Characters of a keyword whose parts are listed.
LONG_WORD = 32


def _word_relations(tokens: DataFrame, keywords: DataFrame, low: DataFrame, fuzzy: bool) -> DataFrame:
    """(token, keyword, kind) of distinct tokens and keywords: equal (same), and with fuzzy near (from five letters, the first
    three alike), else, of the keywords in `low`, with one inside the other (part)."""
    same = tokens.join(keywords, F.col("token") == F.col("keyword")).select("token", "keyword", F.lit("same").alias("kind"))
    if fuzzy:
        long = tokens.filter(F.length("token") > 4).withColumn("start", F.left("token", F.lit(3)))
        met = long.join(keywords.withColumn("start", F.left("keyword", F.lit(3))), "start").filter((F.abs(F.length("token") - F.length("keyword")) <= 2) & _alike("token", "keyword", 0.8))
        near = met.filter(_ratio(F.col("token"), F.col("keyword")) >= 0.8)
        return same.unionByName(near.select("token", "keyword", F.lit("near").alias("kind")))
    # Keywords are words: their parts are few, and tokens are cut to their lengths only. Longer ones go by the index.
    words, usual = tokens.filter(F.length("token") >= 3), low.filter(F.length("keyword") <= LONG_WORD)
    lengths = sorted(r.n for r in usual.select(F.length("keyword").alias("n")).distinct().collect())
    if lengths:
        parts = F.concat(*[char_runs(F.col("keyword"), n) for n in range(3, lengths[-1] + 1)]) if lengths[-1] >= 3 else F.array().cast("array<string>")
        inner = usual.select("keyword", F.explode(F.array_distinct(parts)).alias("token")).join(words, "token").select("token", "keyword")
        cuts = F.concat(*[char_runs(F.col("token"), n) for n in lengths])
        outer = words.select("token", F.explode(F.array_distinct(cuts)).alias("keyword")).join(counted(usual), "keyword").select("token", "keyword")
        same = same.unionByName(inner.unionByName(outer).select("token", "keyword", F.lit("part").alias("kind")))
    large = low.filter(F.length("keyword") > LONG_WORD)
    if large.isEmpty():
        return same
    inner = held(words.select(F.col("token").alias("needle")), large.select(F.col("keyword").alias("item"), F.col("keyword").alias("text")))
    outer = held(large.select(F.col("keyword").alias("needle")), words.select(F.col("token").alias("item"), F.col("token").alias("text")))
    part = inner.select(F.col("needle").alias("token"), F.col("item").alias("keyword")).unionByName(outer.select(F.col("item").alias("token"), F.col("needle").alias("keyword")))
    return same.unionByName(part.select("token", "keyword", F.lit("part").alias("kind")))


def _knowledge_evidence(texts: DataFrame, entries: DataFrame, fuzzy: bool) -> DataFrame:
    """(qid, place, kind, word): what texts (qid, q, pieces, w) share with entries. Texts meet an entry by its whole names,
    by its phrases as runs of words, or by words that its keywords or phrases hold; nothing else is compared."""
    words = texts.select("qid", F.explode("w").alias("token"))
    keywords = entries.select("place", F.explode(F.array_distinct("keywords")).alias("keyword")).filter("keyword <> ''")
    # A part of a word alone scores PART, so only entries that take so little need these pairs.
    low = entries.filter(F.col("threshold") <= PART).select(F.explode("keywords").alias("keyword")).filter("keyword <> ''").distinct()
    related = _word_relations(written(words.select("token").distinct(), "tokens"), keywords.select("keyword").distinct(), low, fuzzy)
    found = words.join(related, "token").join(counted(keywords), "keyword").select("qid", "place", "kind", F.col("keyword").alias("word"))

    names = F.concat(F.array(F.lower("title"), F.lower(F.translate("intent_id", "_", " "))), "phrases")
    full = counted(entries.select("place", F.explode(F.array_distinct(names)).alias("q")))
    found = found.unionByName(texts.join(full, "q").select("qid", "place", F.lit("exact").alias("kind"), F.lit("").alias("word")))

    phrases = entries.select("place", F.explode(F.array_distinct("phrases")).alias("phrase")).filter(F.trim("phrase") != "")
    several = phrases.filter(F.contains("phrase", F.lit(" "))).withColumn("n", F.size(F.split("phrase", " ")))
    lengths = sorted(r.n for r in several.select("n").distinct().collect())
    if lengths:
        run = lambda n: F.when(F.size("pieces") >= n, F.transform(F.sequence(F.lit(1), F.size("pieces") - n + 1), lambda i: F.array_join(F.slice("pieces", i, F.lit(n)), " ")))
        runs = F.concat(*[F.coalesce(run(n), F.array().cast("array<string>")) for n in lengths])
        said = texts.select("qid", F.explode(F.array_distinct(runs)).alias("phrase")).join(counted(several.select("place", "phrase")), "phrase")
        found = found.unionByName(said.select("qid", "place", F.lit("phrase").alias("kind"), F.lit("").alias("word")))
    if fuzzy:
        of = phrases.select("phrase").distinct().withColumn("token", F.explode(F.array_distinct(F.split(F.trim("phrase"), r"\s+"))))
        sized = texts.filter(F.length("q") > 4).select("qid", F.length("q").alias("long"), F.explode("w").alias("token"))
        fits = 2 * F.least("long", F.length("phrase")) >= 0.85 * (F.col("long") + F.length("phrase"))
        pairs = sized.join(counted(of), "token").filter(fits).select("qid", "phrase").distinct()
        near = pairs.join(texts.select("qid", "q"), "qid").filter(_ratio(F.col("q"), F.col("phrase")) >= 0.85)
        near = near.select("qid", "phrase").join(counted(phrases), "phrase")
        found = found.unionByName(near.select("qid", "place", F.lit("near phrase").alias("kind"), F.lit("").alias("word")))
    return found


def score_knowledge(turns: DataFrame, entries: DataFrame, keys: list[str], fuzzy: bool = False) -> DataFrame:
    """keys, intent_id, score: the best entry that reaches its threshold. Exact 1.00, phrase 0.99, two keywords 0.95, one
    0.82, part of one 0.63; with `fuzzy`, near phrases 0.90 and near keywords count, a single word alone doesn't, and two
    entries less than 0.15 apart below 0.99 give none. An entry that shares nothing with a turn has no score, nor have empty
    keywords. Distinct texts are scored, and only against the entries that they share something with."""
    q = F.trim(F.lower("text"))
    said = turns.select(*keys, q.alias("q")).filter("q is not null").withColumn("qid", F.md5("q"))
    texts = said.select("qid", "q").distinct().select("qid", "q", F.split("q", " ").alias("pieces"), F.array_distinct(tokenize(F.col("q"))).alias("w"))
    texts, entries = written(texts, "asked"), written(entries, "entries")
    has = lambda kind: F.count_if(F.col("kind") == kind) > 0
    sums = _knowledge_evidence(texts, entries, fuzzy).groupBy("qid", "place").agg(
        has("exact").alias("exact"), has("phrase").alias("phrase"), has("near phrase").alias("near_phrase"), has("near").alias("near"), has("part").alias("part"),
        F.count_distinct(F.when(F.col("kind") == "same", F.col("word"))).alias("shared"),
    )
    known = sums.join(counted(entries.select("place", "intent_id", "threshold", F.size("keywords").alias("n_keywords"))), "place")
    known = known.join(texts.select("qid", F.size("w").alias("n_words")), "qid")
    score = F.when(F.col("exact"), 1.0).when(F.col("phrase"), 0.99)
    if fuzzy:
        one = (F.col("shared") == 1) | ((F.col("shared") == 0) & F.col("near"))
        alone = one & (F.col("n_words") == 1) & (F.col("n_keywords") > 1)
        score = score.when(F.col("near_phrase"), 0.90).when(F.col("shared") >= 2, 0.95).when(alone, 0.0).when(one, 0.82).otherwise(0.0)
    else:
        score = score.when(F.col("shared") >= 2, 0.95).when(F.col("shared") == 1, 0.82).when(F.col("part"), PART).otherwise(0.0)
    ok = known.withColumn("score", score).filter((F.col("score") >= F.col("threshold")) & (F.col("score") > 0))
    by = Window.partitionBy("qid").orderBy(F.desc("score"), "place")
    ranked = ok.withColumn("rn", F.row_number().over(by)).withColumn("next", F.lead("score").over(by)).filter("rn = 1")
    if fuzzy:
        ranked = ranked.filter(~(F.col("score").between(0.80, 0.9899) & (F.col("next") > 0) & (F.col("score") - F.col("next") < 0.15)) | F.col("next").isNull())
    return said.select(*keys, "qid").join(ranked.select("qid", "intent_id", "score"), "qid").select(*keys, "intent_id", "score")


def flow_partition(turns: DataFrame, phrases: DataFrame, business: list[str], keys: list[str]) -> DataFrame:
    """keys, phrase, flow, confidence: what a turn with a phrase of the group holds besides it."""
    m = longest_phrase_match(turns, phrases, keys)
    rest = F.filter(F.split("remainder", " "), lambda w: F.length(w) > 0)
    noise = F.array(*[F.lit(w) for w in D.NOISE])
    is_noise = lambda w: F.array_contains(noise, w) | w.rlike(r"^[^a-z]*$")
    has_business = F.exists(rest, lambda w: F.array_contains(F.array(*[F.lit(b) for b in business]), w))
    flow = F.when(F.size(rest) == 0, "PURE").when(F.forall(rest, is_noise), "PURE_WITH_NOISE").when(has_business, "PREFIX_QUERY").otherwise("PREFIX_GARBAGE")
    sure = F.when(F.exists(rest, lambda w: w.rlike("[0-9]")), 0.95).when(F.col("phrase") == F.col("grp"), 1.0).otherwise(0.98)
    return m.select(*keys, "phrase", "grp", flow.alias("flow"), sure.alias("confidence"))


def time_of_day(ts: Column, zone: str = "Asia/Kolkata") -> Column:
    """The greeting that fits the hour: 05-12 morning, 12-17 afternoon, 17-21 evening, else night."""
    h = F.hour(F.from_utc_timestamp(ts, zone))
    return F.when((h >= 5) & (h < 12), "morning").when((h >= 12) & (h < 17), "afternoon").when((h >= 17) & (h < 21), "evening").otherwise("night")


INTRODUCTION = r"\b(?:my name is|i am|this is|im|myself) ([a-z]+)"


def greeting_flow(turns: DataFrame, phrases: DataFrame, business: list[str], keys: list[str]) -> DataFrame:
    """flow_partition for greetings, with the name that an introduction gives."""
    name = F.nullif(F.regexp_extract(F.lower("text"), INTRODUCTION, 1), F.lit(""))
    known = F.array(*[F.lit(w) for w in (*D.NOISE, *business)])
    named = turns.select(*keys, F.initcap(F.when(~F.array_contains(known, name), name)).alias("name"))
    flows = flow_partition(turns, phrases, business, keys)
    both = named.join(flows, keys, "left").filter("flow is not null or name is not null")
    return both.withColumn("flow", F.when(F.col("name").isNotNull(), "INTRODUCTION").otherwise(F.col("flow"))).select(*keys, "flow", "name")


def split_multi_intent(turns: DataFrame, keys: list[str]) -> DataFrame:
    parts = F.filter(F.transform(F.split(F.lower("text"), r"\s+and\s+|,\s+|\s+also\s+"), lambda p: F.trim(p)), lambda p: F.length(p) > 0)
    return turns.select(*keys, F.posexplode(parts).alias("part", "text"))


def flag_clarification(turns: DataFrame, headings: DataFrame, keys: list[str], broad: tuple[str, ...] = D.BROAD, unsure: DataFrame | None = None) -> DataFrame:
    """Turns of four distinct words or fewer with a broad concept, with up to four of the longest headings that hold it; also
    those that `unsure` (keys, needs_clarification) marks, whose concept is the first of `broad` if they have none."""
    words = F.array_distinct(F.filter(F.split(F.lower(F.trim("text")), r"\s+"), lambda w: F.length(w) > 0))
    concept = F.get(F.array_sort(F.array_intersect(words, F.array(*[F.lit(b) for b in broad]))), F.lit(0))
    asked = turns.select(*keys, concept.alias("concept"), F.size(words).alias("n"))
    if unsure is None:
        asked = asked.filter("n <= 4 and concept is not null")
    else:
        asked = asked.join(unsure.select(*keys, "needs_clarification"), keys, "left").filter("(n <= 4 and concept is not null) or needs_clarification")
        asked = asked.withColumn("concept", F.coalesce("concept", F.lit(broad[0])))
    # Headings meet the few concepts, not the turns; each concept keeps four.
    concepts = dimension(turns.sparkSession, [(b,) for b in broad], "concept string")
    met = headings.select("heading").distinct().crossJoin(F.broadcast(concepts)).filter(F.contains("heading", F.col("concept")))
    rank = F.row_number().over(Window.partitionBy("concept").orderBy(F.desc(F.length("heading")), "heading"))
    best = met.withColumn("rank", rank).filter("rank <= 4").groupBy("concept").agg(F.sort_array(F.collect_list(F.struct("rank", "heading"))).alias("o"))
    return asked.join(F.broadcast(best), "concept", "left").select(*keys, "concept", F.array_join(F.transform("o", lambda x: x["heading"]), "|").alias("options"))


def friendly_intent(intent: Column) -> Column:
    return F.coalesce(_map(D.FRIENDLY)[F.upper(intent)], F.initcap(F.translate(F.lower(intent), "_", " ")))


def route(turns: DataFrame, known: DataFrame, content: DataFrame, entries: DataFrame, vocabulary: DataFrame, keys: list[str]) -> DataFrame:
    """keys, decision, reason: EMPTY, GIBBERISH, GREETING, GOODBYE, THANKS, SMALL_TALK, IDENTITY, FASTPATH, RAG or FALLBACK."""
    spark = turns.sparkSession
    norm = turns.withColumn("text", normalize_text(F.col("text")))
    out = turns.select(*keys, is_empty(F.col("text")).alias("empty"))
    out = out.join(norm.select(*keys, F.col("text").alias("norm")), keys)
    for name, groups in (("greeting", D.GREETINGS), ("goodbye", D.GOODBYES), ("thanks", D.THANKS), ("small_talk", D.SMALL_TALK), ("identity", D.IDENTITY)):
        flow = flow_partition(norm, phrase_table(spark, groups), [e for k in D.KNOWLEDGE for e in k[2]], keys)
        out = out.join(flow.select(*keys, F.col("flow").alias(name)), keys, "left")
    out = out.join(flag_gibberish(norm, known, content, keys), keys, "left")
    out = out.join(score_knowledge(norm, entries, keys, fuzzy=True).select(*keys, "intent_id"), keys, "left")
    terms = norm.select(*keys, F.explode(tokenize(F.col("text"))).alias("term")).join(vocabulary.select("term").distinct(), "term", "left_semi")
    out = out.join(terms.select(*keys).distinct().withColumn("indexed", F.lit(True)), keys, "left")
    pure = lambda c: F.col(c).isin("PURE", "PURE_WITH_NOISE")
    decision = (
        F.when(F.col("empty"), "EMPTY").when(F.col("norm") == "", "GIBBERISH")
        .when(pure("identity"), "IDENTITY").when(pure("greeting"), "GREETING").when(pure("goodbye"), "GOODBYE").when(pure("thanks"), "THANKS").when(pure("small_talk"), "SMALL_TALK")
        .when(F.col("gibberish"), "GIBBERISH").when(F.col("intent_id").isNotNull(), "FASTPATH").when(F.col("indexed"), "RAG").otherwise("FALLBACK")
    )
    reason = F.coalesce("intent_id", F.when(F.col("indexed"), "indexed vocabulary"), F.lit("rules"))
    return out.select(*keys, decision.alias("decision"), reason.alias("reason"))
