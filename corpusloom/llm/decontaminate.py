"""Benchmark decontamination: one Aho-Corasick automaton over the normalised benchmark, one scan of each text.

A text is normalised to lower-cased words between single blanks. Every run of ``window`` consecutive words of an item is
a pattern, an item with fewer words is one pattern. A match gives back the positions of its words, and word positions
give back the offsets in the original text (``spans``).

Defined cases: a null or empty text has no words; repeated rows each get their own result; an item without words matches
nothing; two items with the same words are both found; an item whose id is null marks words but isn't listed; an empty
benchmark leaves every text clean; texts are scanned whole, however long; an empty table stays empty. Other columns of
``documents`` pass through untouched; where one has the name of the result, the result gets an underscore behind its own.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import WORD, free_name, utf8, words, written

#: Words of a pattern.
WINDOW = 10
#: Normalised characters of benchmark windows that one automaton takes; a larger benchmark is scanned in blocks.
BLOCK_CHARS = 32_000_000
RESULT = "struct<n_words:bigint,hits:array<int>,items:array<string>>"


def patterns(items: list[tuple[str | None, bytes | None]], window: int) -> dict[str, tuple[int, frozenset[str]]]:
    """Pattern -> (its words, ids of the items that have it). Bytes are kept one to a character."""
    found: dict[str, tuple[int, set[str]]] = {}
    for item, raw in items:
        w = words(raw)
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            key = f" {b' '.join(w[i : i + size]).decode('latin-1')} "
            ids = found.setdefault(key, (size, set()))[1]
            if item is not None:
                ids.add(item)
    return {k: (n, frozenset(ids)) for k, (n, ids) in found.items()}


@lru_cache(maxsize=2)
def _automaton(items: tuple, window: int):
    """Built once in each Python worker."""
    machine = ahocorasick.Automaton()
    for key, (size, ids) in patterns(list(items), window).items():
        machine.add_word(key, (len(key), size, ids))
    if len(machine):
        machine.make_automaton()
    return machine


def scan_text(machine, raw: bytes | None) -> tuple[int, list[int], list[str]]:
    """(words, positions of the words inside a match, sorted ids of the items found) of one text."""
    w = words(raw)
    if not w or not len(machine):
        return len(w), [], []
    text = f" {b' '.join(w).decode('latin-1')} "
    found = [(end - length + 1, size, ids) for end, (length, size, ids) in machine.iter(text)]
    if not found:
        return len(w), [], []
    blanks = np.cumsum(np.frombuffer(text.encode("latin-1"), np.uint8) == 32)
    edges, items = np.zeros(len(w) + 1, np.int64), set()
    for start, size, ids in found:
        at = blanks[start] - 1
        edges[at] += 1
        edges[at + size] -= 1
        items |= ids
    return len(w), np.flatnonzero(np.cumsum(edges[:-1])).tolist(), sorted(items)


def _scanner(items: tuple, window: int, spark):
    shared = spark.sparkContext.broadcast(items)

    @F.arrow_udf(RESULT)
    def scan(texts: pa.Array) -> pa.Array:
        machine = _automaton(shared.value, window)
        rows = [scan_text(machine, raw) for raw in texts.to_pylist()]
        return pa.StructArray.from_arrays(
            [
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([r[1] for r in rows], pa.list_(pa.int32())),
                pa.array([r[2] for r in rows], pa.list_(pa.string())),
            ],
            ["n_words", "hits", "items"],
        )

    return scan


def blocks(benchmark: DataFrame, window: int, block_chars: int, item_col: str, text_col: str) -> list[tuple]:
    """The benchmark's items as blocks, each small enough for one automaton. A benchmark is a test set: the driver reads
    it item by item, and what reaches an executor at once is bounded by block_chars."""
    out, block, size = [], [], 0
    rows = benchmark.select(F.col(item_col).cast("string").alias("i"), utf8(F.col(text_col)).alias("t"))
    for r in rows.filter(F.length("t") > 0).orderBy("i", "t").toLocalIterator():
        raw = bytes(r.t)
        # A word is in at most `window` patterns.
        size += window * len(raw)
        if block and size > block_chars:
            out.append(tuple(block))
            block, size = [], window * len(raw)
        block.append((r.i, raw))
    return [*out, tuple(block)]


def scan(
    documents: DataFrame,
    benchmark: DataFrame,
    out: str = "contamination",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """documents with the struct column `out`: n_words, hits (positions of contaminated words), items (ids as strings).

    One block (the usual case) is scanned without any shuffle. With more, the rows that a block hits are joined back by
    the text's digest; so no more than one automaton is in a worker's memory.
    """
    out = free_name(out, documents)
    spark = documents.sparkSession
    parts = blocks(benchmark, window, block_chars, item_col, item_text_col)
    raw = utf8(F.col(text_col))
    if len(parts) == 1:
        return documents.withColumn(out, _scanner(parts[0], window, spark)(raw))
    key = free_name("key", documents)
    keyed = documents.withColumn(key, F.sha2(raw, 256))
    distinct = keyed.select(key, raw.alias("t")).dropDuplicates([key])
    found = None
    for part in parts:
        one = distinct.select(F.col(key).alias("k"), _scanner(part, window, spark)("t").alias("r"))
        one = written(one.filter(F.size("r.hits") > 0), "scan")
        found = one if found is None else found.unionByName(one)
    merged = found.groupBy("k").agg(
        F.struct(
            F.max("r.n_words").alias("n_words"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("r.hits")))).alias("hits"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("r.items")))).alias("items"),
        ).alias(out)
    )
    clean = _scanner((), window, spark)(raw)
    joined = keyed.join(merged.withColumnRenamed("k", key), key, "left")
    return joined.select(*[f"`{c}`" for c in documents.columns], F.coalesce(out, clean).alias(out))


def runs(text: str | None, hits: list[int] | None) -> list[dict]:
    """The runs of consecutive words among `hits`, as offsets of the text."""
    out: list[dict] = []
    if not text or not hits:
        return out
    places = [m.span() for m in re.finditer(WORD, _folded(text))]
    before = None
    for i in hits:
        if before is not None and i == before + 1:
            out[-1]["end"] = places[i][1]
        else:
            out.append({"start": places[i][0], "end": places[i][1]})
        before = i
    return out


def spans(text: Column, hits: Column) -> Column:
    """Runs of contaminated words as [start, end) offsets, in code points, of the original text."""

    @F.arrow_udf("array<struct<start:int,end:int>>")
    def located(texts: pa.Array, at: pa.Array) -> pa.Array:
        out = [runs(t, h) for t, h in zip(texts.to_pylist(), at.to_pylist(), strict=True)]
        return pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))

    return located(text, hits)


_FOLD = {c: c + 32 for c in range(65, 91)}


def _folded(text: str) -> str:
    return text.translate(_FOLD)


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without any occurrence of a benchmark window."""
    out = free_name("contamination", documents)
    found = scan(documents, benchmark, out=out, **options)
    return found.filter(F.size(f"{out}.hits") == 0).drop(out)


def digest(result: Column) -> list[Column]:
    """The columns of the report, from scan()'s struct."""
    items = result["items"]
    return [
        result["n_words"].alias("n_words"),
        F.size(result["hits"]).cast("bigint").alias("n_hit"),
        F.size(items).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        (F.size(result["hits"]) > 0).alias("contaminated"),
    ]
