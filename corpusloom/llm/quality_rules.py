"""Quality rules with adaptive thresholds, in DataFrame functions only.

Each text gives counts and, from them, shares in integer steps: symbols, repeated lines and repeated words in thousandths,
the mean length of words in tenths, the words of a line. A group's sketch of a share is its histogram over these steps
(the last step is open): sketches add up, so rows are pre-aggregated before the shuffle, and the sketch of a language is
the sum of its sources', that of the corpus the sum of all. Equal texts of a group count once, so copies can't make
themselves the rule.

A sketch gives the quantiles at 10, 50 and 95 %. A language's are drawn towards the corpus's and a group's (language and
source) towards its language's by ``pull`` texts, so a group of any size has thresholds of its own, and small ones lean on
what is known. The usual rate of a share is the median + ``fences`` times the distance from the 10 % quantile to it: only
the lower half decides, which less than half of junk doesn't reach. It is at most ``bound`` times what 95 % of the
language's texts keep to, so that a group of junk can't switch its rule off. A text fails if its count is above the usual
rate by more than ``sigmas`` standard deviations of a count of events: sqrt(usual * w + w * w) for events of weight w, which
is 1 and for repeated words twice the words of a usual line. So one repeated line in a short text isn't held against it.

Defined cases: a null text has no words; texts without a word aren't in a sketch and fail the base rule; whole texts of any
length are measured; rows that repeat get the same verdict each; a null language or source is a group of its own; ties at
a threshold are kept; an empty table gives no rows. Only the four named columns are read, so no other name can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import BROADCAST_ROWS, join_small, null_key, written

#: Texts by which a group's quantiles are drawn towards its language's, and a language's towards the corpus's.
PULL = 10
FENCES = 6
SIGMAS = 3
BOUND = 2
QUANTILES = (10, 50, 95)
MAX_STEP = 1000
#: Share -> (its count, what it is a share of, steps in 1); `width` gives no rule but the words of a usual line.
SHARES = {
    "symbols": ("n_symbols", "word_chars", 1000),
    "lines": ("n_dup_lines", "n_lines", 1000),
    "repeats": ("n_repeat_words", "n_words", 1000),
    "length": ("word_chars", "n_words", 10),
    "width": ("n_words", "n_lines", 1),
}
RULES = [k for k in SHARES if k != "width"]
#: ASCII white space.
BLANK = " \t\n\x0b\f\r"


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeat_words(w: Column) -> Column:
    """Words in 3-word windows that are found twice or more in the array w, first ones included."""

    def covered(starts: Column) -> Column:
        steps = F.transform(starts, lambda x, i: F.when(i == 0, 3).otherwise(F.least(F.lit(3), x - F.get(starts, i - 1))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def repeated(s: Column) -> Column:
        here = F.transform(s, lambda x, i: F.when((x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]), x["i"]))
        return let(F.sort_array(F.filter(here, lambda x: x.isNotNull())), covered)

    def of_hashes(h: Column) -> Column:
        pairs = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(F.sort_array(pairs), repeated))

    def of_words(v: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(v) - 3)
        return let(F.transform(at, lambda i: F.xxhash64(F.get(v, i), F.get(v, i + 1), F.get(v, i + 2))), of_hashes)

    return F.coalesce(F.when(F.size(w) > 3, let(w, of_words)), F.lit(0))


def parts(text: Column) -> list[Column]:
    """The text with its words and its lines with a word."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    # A single-character split isn't a regular expression to Java, and array_remove is generated code.
    w = F.array_remove(F.split(F.translate(text, BLANK[1:], " " * 5), " "), "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, BLANK, "")) > 0)
    return [text.alias("text__"), w.alias("words__"), lines.alias("lines__")]


def counts() -> dict[str, Column]:
    """The counts from the columns of parts(); n_lines (lines with a word) beside those that the rules report."""
    text, w, lines = F.col("text__"), F.col("words__"), F.col("lines__")
    out = {
        "n_words": F.size(w),
        "word_chars": F.length(F.translate(text, BLANK, "")),
        "n_symbols": F.length(text) - F.length(F.translate(text, "#*$%&|<>", "")),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": repeat_words(w),
    }
    return {k: c.cast("bigint") for k, c in out.items()}


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _steps() -> Column:
    """Each share of a text with its step."""
    at = lambda n, of, unit: F.expr(f"cast(least({MAX_STEP}, {unit} * {n} div {of}) as int)")
    return F.explode(F.array(*[F.struct(F.lit(k).alias("share"), at(*v).alias("step")) for k, v in SHARES.items()]))


def sketches(measured: DataFrame) -> DataFrame:
    """(lang_key, source_key, share, step) -> rows; bounded by the groups times MAX_STEP."""
    counted = [n for n in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")]
    texts = measured.filter("n_words > 0").groupBy("lang_key", "source_key", "text_hash").agg(*[F.first(n).alias(n) for n in counted])
    flat = texts.select("lang_key", "source_key", _steps().alias("s"))
    return flat.groupBy("lang_key", "source_key", F.col("s.share").alias("share"), F.col("s.step").alias("step")).agg(F.count("*").alias("rows"))


def _quantiles(sketch: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Texts and quantiles of each group of a sketch; a histogram has MAX_STEP + 1 steps at most."""
    merged = sketch.groupBy(*keys, "share", "step").agg(F.sum("rows").alias("rows"))
    held = merged.groupBy(*keys, "share").agg(F.sum("rows").alias(f"{name}_n"), F.sort_array(F.collect_list(F.struct("step", "rows"))).alias("h"))

    def at(percent: int) -> Column:
        return F.expr(
            f"aggregate(h, named_struct('below', 0L, 'step', -1), (a, x) -> if(a.step >= 0, a, named_struct('below', a.below + x.rows, "
            f"'step', if((a.below + x.rows) * 100 >= {name}_n * {percent}, x.step, -1))), a -> double(a.step))"
        )

    return held.select(*keys, "share", f"{name}_n", *[at(p).alias(f"{name}_{p}") for p in QUANTILES])


def _drawn(df: DataFrame, name: str, towards: str, pull: float) -> DataFrame:
    n = F.col(f"{name}_n")
    return df.withColumns({f"{name}_{p}": (n * F.col(f"{name}_{p}") + pull * F.col(f"{towards}_{p}")) / (n + pull) for p in QUANTILES})


def thresholds(sketch: DataFrame, pull: float = PULL, fences: float = FENCES, bound: float = BOUND) -> DataFrame:
    """One row for each language and source: the usual step of each share (usual_...) and the words of a usual line."""
    own = _quantiles(sketch, ["lang_key", "source_key"], "own")
    lang = _quantiles(sketch, ["lang_key"], "lang")
    every = _quantiles(sketch, [], "every")
    both = own.join(lang, ["lang_key", "share"]).join(F.broadcast(every), "share")
    both = _drawn(_drawn(both, "lang", "every", pull), "own", "lang", pull)
    usual = F.least(F.col("own_50") + fences * (F.col("own_50") - F.col("own_10")), bound * F.col("lang_95"))
    at = [F.max(F.when(F.col("share") == k, usual)).alias(f"usual_{k}") for k in RULES]
    return both.groupBy("lang_key", "source_key").agg(*at, F.max(F.when(F.col("share") == "width", F.col("own_50"))).alias("line_words"))


def _failed(share: str, sigmas: float) -> Column:
    n, of, unit = SHARES[share]
    usual = F.col(f"usual_{share}") * F.col(of) / unit
    w = 2 * F.col("line_words") if share == "repeats" else F.lit(1.0)
    return F.coalesce(F.col(n) > usual + sigmas * F.sqrt(usual * w + w * w), F.lit(False))


def _hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def judge(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    pull: float = PULL,
    fences: float = FENCES,
    sigmas: float = SIGMAS,
    bound: float = BOUND,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Per row: the id, the counts, the usual step of each share, failed_... of each rule, base_failed and kept."""
    return _judged(documents, id_col, text_col, lang_col, source_col, pull, fences, sigmas, bound, broadcast_rows).drop("lang_key", "source_key", "text_hash")


def _judged(documents, id_col, text_col, lang_col, source_col, pull, fences, sigmas, bound, broadcast_rows) -> DataFrame:
    text = F.col(text_col)
    keys = [null_key(F.col(lang_col)).alias("lang_key"), null_key(F.col(source_col)).alias("source_key")]
    texts = documents.select(F.col(id_col).alias("id__"), *keys, _hash(text).alias("text_hash"), *parts(text))
    # The texts are read and measured once; the counts are a small table.
    measured = written(texts.select("id__", "lang_key", "source_key", "text_hash", *[c.alias(k) for k, c in counts().items()]), "counts")
    usual = written(thresholds(written(sketches(measured), "sketch"), pull, fences, bound), "thresholds")
    joined = join_small(measured, usual, ["lang_key", "source_key"], F.col("text_hash"), broadcast_rows)
    joined = joined.withColumn("base_failed", base_failed()).withColumns({f"failed_{k}": _failed(k, sigmas) for k in RULES})
    good = ~F.col("base_failed")
    for k in RULES:
        good &= ~F.col(f"failed_{k}")
    return joined.withColumn("kept", good).withColumnRenamed("id__", id_col)


def filter_documents(documents: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", **options) -> DataFrame:
    """The rows of `documents` that are kept. A verdict depends on text, language and source alone, so rows are told apart by
    these and not by an id."""
    given = {"pull": PULL, "fences": FENCES, "sigmas": SIGMAS, "bound": BOUND, "broadcast_rows": BROADCAST_ROWS} | options
    numbered = documents.select(F.lit(0).alias("n"), *[F.col(c).alias(k) for c, k in ((text_col, "t"), (lang_col, "l"), (source_col, "s"))])
    failed = _judged(numbered, "n", "t", "l", "s", **given).filter("not kept")
    failed = written(failed.select(F.col("lang_key").alias("l__"), F.col("source_key").alias("s__"), F.col("text_hash").alias("h__")).distinct(), "failed")
    same = (null_key(documents[lang_col]) == failed["l__"]) & (null_key(documents[source_col]) == failed["s__"]) & (_hash(documents[text_col]) == failed["h__"])
    return documents.join(failed, same, "left_anti")
