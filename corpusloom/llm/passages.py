"""Substring dedup by collinear chaining: passages that documents share, word for word or nearly so.

1. Seeds: of the hashes of all runs of ``K`` words, the smallest in each window of ``WINDOW`` runs (winnowing), so two
   texts that share K + WINDOW - 1 words in a row share a seed. Documents with equal words are one from here on.
2. Each seed that several documents hold has a lead, the document with the smallest id and its first place there. Joining
   seeds with leads gives anchors (place here, place in the lead): as many as seeds, however many documents share one.
3. Chains: anchors of a document and a lead that ascend in both texts are chained for the best score, K for an anchor less
   GAP for each word skipped in either text. A Fenwick tree over the lead's places holds the best chain so far. A lone
   anchor is a chain, too.
4. Alignment: word hashes of both sides of a chain are compared along its diagonals, and outwards from its ends until the
   score drops by DROP. A passage has at least ``MIN_WORDS`` words here, of which ``MIN_SHARE`` match.
5. Runs: what leads hide. All seeds of a passage may lead to documents that hold pieces of it only, so wherever seeds that
   several documents hold follow each other and no passage was found, the runs of MIN_WORDS words themselves are hashed
   and joined; runs that several documents hold are anchors of steps 3 and 4, and passages in any case.
6. Passages of a document are merged; those of a document stand for all that have the same words.

Defined cases: a null or empty text has no passage; rows that repeat an id or a text have equal passages (each row of a
text of MIN_WORDS or more that others repeat is a passage as a whole); of equal chains the earliest wins; an empty table
gives no rows. A passage repeated within one document only isn't one. Ids are integers; rows without one are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm.common import BROADCAST_ROWS, WORD, utf8, words, written

K = 8
WINDOW = 12
GAP = 0.1
MIN_WORDS = 50
MIN_SHARE = 0.8
DROP = 12
#: Kept seeds of a run of words are less than this apart (two windows, where one seed is said over and over).
REACH = 2 * WINDOW
#: Words beyond a chain's ends that the alignment sees, and the grid to which a lead's regions are widened.
MARGIN = 64
GRID = 64
#: Bytes of regions that a task hands on at once.
REGION_BYTES = 1 << 22
_MUL = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(raw: bytes | None) -> np.ndarray:
    w = words(raw)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))


def seeds(h: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places) of the seeds of a text's word hashes."""
    n = len(h) - k + 1
    if n < 1:
        return np.empty(0, np.int64), np.empty(0, np.int32)
    grams = np.zeros(n, np.uint64)
    for i in range(k):
        grams = grams * _MUL + h[i : i + n]
    grams ^= grams >> np.uint64(31)
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    grams ^= grams >> np.uint64(29)
    if n <= window:
        at = np.array([int(grams.argmin())])
    else:
        view = np.lib.stride_tricks.sliding_window_view(grams, window)
        at = np.unique(view.argmin(axis=1) + np.arange(len(view)))
        # Of one seed in a row (a word said over and over), one in each window is enough.
        same = np.r_[False, (grams[at[1:]] == grams[at[:-1]]) & (np.diff(at) < window)]
        begin = at[np.flatnonzero(~same)][np.cumsum(~same) - 1]
        step = (at - begin) // window
        at = at[~same | np.r_[True, step[1:] != step[:-1]]]
    return grams[at].view(np.int64), at.astype(np.int32)


def chains(here: list[int], there: list[int], k: int = K, gap: float = GAP, least: int = 2) -> list[list[int]]:
    """Chains of the anchors (here[i], there[i]), best first, each as anchor numbers in ascending order; every anchor is
    in one chain at most and chains have `least` anchors or more."""
    order = sorted(range(len(here)), key=lambda i: (here[i], -there[i]))
    rank = {v: r + 1 for r, v in enumerate(sorted(set(there)))}
    tree: list[tuple[float, int]] = [(float("-inf"), -1)] * (len(rank) + 1)
    score, before = [0.0] * len(here), [-1] * len(here)
    for i in order:
        # The gap costs part into what either anchor adds, so the tree keeps score + gap * (place here + place there).
        r, best = rank[there[i]] - 1, (float("-inf"), -1)
        while r > 0:
            best = max(best, tree[r])
            r &= r - 1
        through = best[0] - gap * (here[i] + there[i])
        score[i] = k + max(0.0, through)
        before[i] = best[1] if through > 0 and here[best[1]] < here[i] else -1
        if before[i] < 0:
            score[i] = float(k)
        entry, r = (score[i] + gap * (here[i] + there[i]), i), rank[there[i]]
        while r < len(tree):
            if entry > tree[r]:
                tree[r] = entry
            r += r & -r
    used, out = set(), []
    for i in sorted(order, key=lambda i: (-score[i], here[i], there[i])):
        chain = []
        while i >= 0 and i not in used:
            used.add(i)
            chain.append(i)
            i = before[i]
        if len(chain) >= least:
            out.append(chain[::-1])
    return out


def _reach(equal: np.ndarray, drop: int) -> tuple[int, int]:
    """How far to go along comparisons until the score has dropped, and the matches on that way."""
    if not len(equal):
        return 0, 0
    s = np.cumsum(np.where(equal, 1, -2))
    best = np.maximum.accumulate(np.maximum(s, 0))
    stop = np.flatnonzero(best - s > drop)
    s = s[: stop[0]] if len(stop) else s
    if not len(s) or s.max() <= 0:
        return 0, 0
    far = int(s.argmax()) + 1
    return far, int(equal[:far].sum())


def _between(x: np.ndarray, y: np.ndarray) -> int:
    """Matching words of two stretches on either diagonal; with a shift between the two, at the best place to change over."""
    m = min(len(x), len(y))
    first, last = x[:m] == y[:m], x[len(x) - m :] == y[len(y) - m :]
    if len(x) == len(y):
        return int(first.sum())
    return int((np.r_[0, np.cumsum(first)] + np.r_[np.cumsum(last[::-1])[::-1], 0]).max())


def align(x: np.ndarray, y: np.ndarray, here: list[int], there: list[int], k: int = K, drop: int = DROP) -> list[tuple[int, int, int, int, int]]:
    """(start, end) in x, (start, end) in y and the matching words, of each passage along a chain of anchors. A chain is
    parted where more than `drop` words between two anchors don't match."""
    pieces, matches = [[0]], [0]
    for i in range(1, len(here)):
        a, b, c, d = here[i - 1], here[i], there[i - 1], there[i]
        inside = _between(x[a:b], y[c:d])
        if max(b - a, d - c) - inside > drop:
            pieces.append([i])
            matches.append(0)
        else:
            pieces[-1].append(i)
            matches[-1] += inside
    out = []
    for piece, inside in zip(pieces, matches, strict=True):
        a, b, c, d = here[piece[0]], here[piece[-1]], there[piece[0]], there[piece[-1]]
        left, right = min(a, c), min(len(x) - b, len(y) - d)
        back, before = _reach((x[a - left : a] == y[c - left : c])[::-1], drop)
        on, after = _reach(x[b : b + right] == y[d : d + right], drop)
        on, after = max(on, k), max(after, k)
        out.append((a - back, b + on, c - back, d + on, before + inside + after))
    return out


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, key, seed = [], [], []
        for raw in batch.column(1).to_pylist():
            h = word_hashes(raw)
            s, at = seeds(h)
            n.append(len(h))
            key.append(xxhash.xxh3_128_digest(h.tobytes()))
            seed.append(s.tobytes() + at.tobytes())
        yield pa.record_batch([batch.column(0), pa.array(n, pa.int32()), pa.array(key, pa.binary()), pa.array(seed, pa.binary())], ["id", "n", "word_key", "seeds"])


def _explode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        s, at, doc = [], [], []
        for d, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            m = len(raw) // 12
            s.append(np.frombuffer(raw, np.int64, m))
            at.append(np.frombuffer(raw, np.int32, m, 8 * m))
            doc.append(np.full(m, d, np.int64))
        if s:
            yield pa.record_batch([pa.array(np.concatenate(c)) for c in (s, doc, at)], ["seed", "doc", "place"])


def _chained(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
    names = ["doc", "lead", "here", "there"]
    for batch in batches:
        out = []
        for doc, lead, anchors in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            here, there = [a["place"] for a in anchors], [a["there"] for a in anchors]
            for chain in chains(here, there, least=1):
                out.append((doc, lead, [here[i] for i in chain], [there[i] for i in chain]))
        if out:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


def stretches(places: np.ndarray, shared: np.ndarray, n: int, min_words: int = MIN_WORDS) -> list[tuple[int, int]]:
    """(start, end) of the stretches, in words, of a text of n words with seeds at `places` outside which no run of
    min_words words has `shared` seeds only."""
    bound = np.r_[-1, np.setdiff1d(places, shared), max(n - K + 1, 0)].tolist()
    return [(a + 1, b + K - 1) for a, b in zip(bound, bound[1:], strict=False) if b + K - 2 - a >= min_words]


def close(places: np.ndarray, low: int, high: int, min_words: int = MIN_WORDS) -> list[tuple[int, int]]:
    """The parts of a stretch, in words, outside which no run of min_words words has all its seeds among `places`."""
    p = np.unique(places[(places >= low) & (places + K <= high)])
    if not len(p):
        return []
    parted = np.flatnonzero(np.diff(p) >= REACH)
    ends = zip(p[np.r_[0, parted + 1]].tolist(), p[np.r_[parted, len(p) - 1]].tolist(), strict=True)
    return [(a, b) for a, b in ((max(low, a - REACH + 1), min(high, b + K + REACH - 1)) for a, b in ends) if b - a >= min_words]


def hidden(places: np.ndarray, parts: list[tuple[int, int]], found: list[tuple[int, int]], min_words: int = MIN_WORDS) -> np.ndarray:
    """For each place whether its seed is in a run of a stretch that no passage of `found` holds as a whole."""
    out = np.zeros(len(places), bool)
    for low, high in parts:
        free = np.ones(high - min_words - low + 1, bool)
        for a, b in found:
            free[max(a - low, 0) : max(b - min_words + 1 - low, 0)] = False
        upto = np.r_[0, np.cumsum(free)]
        at = np.flatnonzero((places >= low) & (places + K <= high))
        first = np.maximum(places[at] + K - min_words - low, 0)
        last = np.minimum(places[at] - low + 1, len(free))
        out[at] |= upto[last] > upto[np.minimum(first, last)]
    return out


def runs(h: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each run of m words."""
    n = max(len(h) - m + 1, 0)
    one, two = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    for i in range(m if n else 0):
        one = one * _MUL + h[i : i + n]
        two = two * np.uint64(0xD6E8FEB86659FD93) + (h[i : i + n] ^ (h[i : i + n] >> np.uint64(32)))
    return one.view(np.int64), two.view(np.int64)


_PARTS = "array<struct<low: int, high: int>>"
_PART = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))


def _hidden(min_words: int):
    """(doc, parts, seeds): a text's stretches of shared seeds, and the seeds there that no passage holds."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            columns = zip(*[batch.column(k).to_pylist() for k in (0, 1, 2, 4)], batch.column(3), strict=True)
            for doc, n, raw, found, held in columns:
                m = len(raw) // 12
                seed, place = np.frombuffer(raw, np.int64, m), np.frombuffer(raw, np.int32, m, 8 * m)
                parts = stretches(place, held.values.to_numpy(zero_copy_only=False), n, min_words)
                if parts:
                    at = hidden(place, parts, [(r["start_word"], r["end_word"]) for r in found or ()], min_words)
                    out.append((doc, [{"low": a, "high": b} for a, b in parts], np.unique(seed[at])))
            if out:
                kinds = (pa.int64(), _PART, pa.list_(pa.int64()))
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["doc", "parts", "seeds"])

    return run


def _close(min_words: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, parts, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                p = places.values.to_numpy(zero_copy_only=False)
                if kept := [{"low": a, "high": b} for r in parts for a, b in close(p, r["low"], r["high"], min_words)]:
                    out.append((doc, kept))
            if out:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), _PART), strict=True)], ["id", "parts"])

    return run


def _runs(min_words: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[np.empty(0, k)] for k in (np.int64, np.int64, np.int64, np.int32)]
            for doc, raw, parts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                h = word_hashes(raw)
                for r in parts:
                    one, two = runs(h[r["low"] : r["high"]], min_words)
                    for c, v in zip(out, (one, two, np.full(len(one), doc), np.arange(len(one), dtype=np.int32) + np.int32(r["low"])), strict=True):
                        c.append(v)
            yield pa.record_batch([pa.array(np.concatenate(c)) for c in out], ["one", "two", "doc", "place"])

    return run


def _ends(min_words: int):
    """Runs that follow each other as one: (doc, lead, start, end, there, upto), where its first run begins and its last
    one ends in the lead, and, once for a document and a lead, all that the runs hold of the lead (parts)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["doc", "lead", "start", "end", "there", "upto", "parts"], [pa.int64(), pa.int64(), *[pa.int32()] * 4, _PART]
        for batch in batches:
            out = []
            for doc, lead, anchors in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                at, there = (anchors.values.field(k).to_numpy(zero_copy_only=False) for k in ("place", "there"))
                order = np.argsort(at)
                at, there, theirs = at[order], there[order], np.unique(there)
                first, last = _islands(at)
                low, high = _islands(theirs)
                parts = [{"low": a, "high": b + min_words} for a, b in zip(theirs[low].tolist(), theirs[high].tolist(), strict=True)]
                for i, j in zip(first.tolist(), last.tolist(), strict=True):
                    out.append((doc, lead, int(at[i]), int(at[j]) + min_words, int(there[i]), int(there[j]) + min_words, parts))
                    parts = []
            if out:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return run


def _islands(ascending: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each row of successive numbers begins and ends."""
    parted = np.flatnonzero(np.diff(ascending) != 1)
    return np.r_[0, parted + 1], np.r_[parted, len(ascending) - 1]


def _regions(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The word hashes of regions of texts: (id, low, high, hashes)."""
    names, kinds = ["id", "low", "high", "hashes"], [pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    for batch in batches:
        out, held = [], 0
        for i, raw, parts in zip(*batch.columns, strict=True):
            i, h = i.as_py(), word_hashes(raw.as_py())
            for r in parts.as_py():
                out.append((i, r["low"], r["high"], h[r["low"] : r["high"]].tobytes()))
                held += len(out[-1][3])
                if held > REGION_BYTES:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                    out, held = [], 0
        if out:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


def _aligned(min_words: int, min_share: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc", "start", "end", "lead", "lead_start", "lead_end", "matches"]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
        for batch in batches:
            out = []
            for row in zip(*batch.columns, strict=True):
                doc, lead, here, there, low, x, lead_low, y = (v.as_py() for v in row)
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                for a, b, c, d, m in align(x, y, [p - low for p in here], [p - lead_low for p in there]):
                    if min(b - a, d - c) >= min_words and m >= min_share * max(b - a, d - c):
                        out.append((doc, a + low, b + low, lead, c + lead_low, d + lead_low, m))
            if out:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return run


def _of(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """One text for each id of a written table of different ids."""
    return texts.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, "id", "left_semi").dropDuplicates(["id"])


def _passages(texts: DataFrame, anchors: DataFrame, min_words: int, min_share: float) -> DataFrame:
    """The passages along the anchors (doc, lead, place, there)."""
    paired = anchors.groupBy("doc", "lead").agg(F.collect_list(F.struct("place", "there")).alias("anchors"))
    found = written(paired.mapInArrow(_chained, "doc bigint, lead bigint, here array<int>, there array<int>"), "chains")

    def wide(places: str, grid: int) -> list[Column]:
        low = F.greatest(F.lit(0), F.element_at(places, 1) - MARGIN)
        high = F.element_at(places, -1) + K + MARGIN
        return [(F.floor(low / grid) * grid).cast("int"), (F.ceil(high / grid) * grid).cast("int")]

    # A lead's regions lie on a grid, so that the many chains to one lead share few of them.
    low, high = wide("here", 1)
    lead_low, lead_high = wide("there", GRID)
    found = found.select("*", low.alias("low"), high.alias("high"), lead_low.alias("lead_low"), lead_high.alias("lead_high"))
    wanted = found.select(F.col("doc").alias("id"), "low", "high").unionByName(
        found.select(F.col("lead").alias("id"), F.col("lead_low").alias("low"), F.col("lead_high").alias("high"))
    )
    wanted = wanted.distinct()
    # A text comes once, with all its regions.
    wanted = written(wanted.groupBy("id").agg(F.collect_list(F.struct("low", "high")).alias("parts")), "wanted")
    held = _of(texts, wanted.select("id")).join(wanted, "id").select("id", "raw", "parts")
    regions = written(held.mapInArrow(_regions, "id bigint, low int, high int, hashes binary"), "regions")
    mine = regions.select(F.col("id").alias("doc"), "low", "high", F.col("hashes").alias("x"))
    theirs = regions.select(F.col("id").alias("lead"), F.col("low").alias("lead_low"), F.col("high").alias("lead_high"), F.col("hashes").alias("y"))
    both = found.join(mine, ["doc", "low", "high"]).join(theirs, ["lead", "lead_low", "lead_high"])
    schema = "doc bigint, start int, end int, lead bigint, lead_start int, lead_end int, matches int"
    aligned = both.select("doc", "lead", "here", "there", "low", "x", "lead_low", "y").mapInArrow(_aligned(min_words, min_share), schema)
    return written(aligned, "aligned")


def _sides(aligned: DataFrame) -> DataFrame:
    """Passages (doc, start, end, lead) on both sides."""
    theirs = aligned.select(F.col("lead").alias("doc"), F.col("lead_start").alias("start"), F.col("lead_end").alias("end"), "lead")
    return aligned.select("doc", "start", "end", "lead").unionByName(theirs)


def _merged(parts: DataFrame) -> DataFrame:
    # As many rows a document as it has words, at most.
    parts = parts.groupBy("doc", "start").agg(F.max("end").alias("end"), F.min("lead").alias("lead"))
    by = Window.partitionBy("doc").orderBy("start")
    reached = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce((F.col("start") > reached).cast("int"), F.lit(1))
    islands = parts.withColumn("new", new).withColumn("island", F.sum("new").over(by))
    return islands.groupBy("doc", "island").agg(F.min("start").alias("start_word"), F.max("end").alias("end_word"), F.min("lead").alias("first_doc"))


def find(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, min_share: float = MIN_SHARE) -> DataFrame:
    """One row for each passage of each document that other documents share: id_col, start_word, end_word (words from 0,
    end not included), n_words, and first_doc, the smallest id among the leads (the id itself where the passage leads)."""
    texts = documents.select(F.col(id_col).cast("bigint").alias("id"), utf8(F.col(text_col)).alias("raw")).filter("id is not null")
    each = written(texts.mapInArrow(_cut, "id bigint, n int, word_key binary, seeds binary"), "seeds")
    keyed = each.filter("n > 0").groupBy("word_key")
    rows = written(keyed.agg(F.min("id").alias("doc"), F.max("id").alias("last"), F.first("n").alias("n"), F.first("seeds").alias("seeds")), "texts")

    places = rows.select("doc", "seeds").mapInArrow(_explode, "seed bigint, doc bigint, place int")
    leads = places.groupBy("seed").agg(F.min(F.struct("doc", "place")).alias("lead"), F.max("doc").alias("last"))
    leads = leads.filter("lead.doc < last").select("seed", F.col("lead.doc").alias("lead"), F.col("lead.place").alias("there"))
    # Written, so that the join below is one of two plain shuffles, whose skewed seeds Spark splits.
    leads = written(leads, "leads")
    shared = written(places.join(leads, "seed"), "shared")
    aligned = _passages(texts, shared.filter("doc <> lead").select("doc", "lead", "place", "there"), min_words, min_share)
    whole = rows.filter((F.col("doc") < F.col("last")) & (F.col("n") >= min_words)).select("doc", F.lit(0).alias("start"), F.col("n").alias("end"), F.col("doc").alias("lead"))

    found = _merged(_sides(aligned).unionByName(whole)).groupBy("doc").agg(F.collect_list(F.struct("start_word", "end_word")).alias("found"))
    held = shared.groupBy("doc").agg(F.collect_list("place").alias("held")).join(found, "doc", "left")
    held = rows.select("doc", "n", "seeds").join(held, "doc").select("doc", "n", "seeds", "held", "found")
    unled = written(held.mapInArrow(_hidden(min_words), f"doc bigint, parts {_PARTS}, seeds array<bigint>"), "unled")
    sought = written(unled.select(F.explode("seeds").alias("seed")).distinct(), "sought")
    near = shared.join(sought, "seed").groupBy("doc").agg(F.collect_list("place").alias("places")).join(unled, "doc")
    parts = written(near.select("doc", "parts", "places").mapInArrow(_close(min_words), f"id bigint, parts {_PARTS}"), "stretches")
    hashed = written(_of(texts, parts.select("id")).join(parts, "id").select("id", "raw", "parts").mapInArrow(_runs(min_words), "one bigint, two bigint, doc bigint, place int"), "runs")
    first = hashed.groupBy("one", "two").agg(F.min(F.struct("doc", "place")).alias("lead"), F.max("doc").alias("last"))
    first = written(first.filter("lead.doc < last").select("one", "two", F.col("lead.doc").alias("lead"), F.col("lead.place").alias("there")), "firsts")
    same = hashed.join(first, ["one", "two"]).filter("doc <> lead").groupBy("doc", "lead").agg(F.collect_list(F.struct("place", "there")).alias("anchors"))
    same = written(same.mapInArrow(_ends(min_words), f"doc bigint, lead bigint, start int, end int, there int, upto int, parts {_PARTS}"), "same")
    sides = _sides(aligned).unionByName(whole)
    if not same.isEmpty():
        ends = F.array(F.struct(F.col("start").alias("place"), "there"), F.struct((F.col("end") - K).alias("place"), (F.col("upto") - K).alias("there")))
        more = _passages(texts, same.select("doc", "lead", F.explode(ends).alias("a")).select("doc", "lead", "a.place", "a.there"), min_words, min_share)
        theirs = same.select("lead", F.explode("parts").alias("p")).select(F.col("lead").alias("doc"), F.col("p.low").alias("start"), F.col("p.high").alias("end"), "lead")
        sides = sides.unionByName(_sides(more)).unionByName(same.select("doc", "start", "end", "lead")).unionByName(theirs)
    merged = _merged(sides)
    copies = each.join(rows.select("word_key", "doc"), "word_key").select("id", "doc")
    kind = documents.schema[id_col].dataType
    return copies.join(merged, "doc").select(
        F.col("id").cast(kind).alias(id_col),
        "start_word",
        "end_word",
        (F.col("end_word") - F.col("start_word")).alias("n_words"),
        F.col("first_doc").cast(kind).alias("first_doc"),
    )


_FOLD = {c: c + 32 for c in range(65, 91)}


def without(text: str | None, ranges: list[tuple[int, int]]) -> str | None:
    """The text without the words of the ranges, the characters between them included."""
    if not text or not ranges:
        return text
    places = [m.span() for m in re.finditer(WORD, text.translate(_FOLD))]
    out, at = [], 0
    for a, b in sorted(ranges):
        out.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return "".join([*out, text[at:]])


def cut_repeats(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """documents with each shared passage cut from all texts but that of its first document; every column is kept."""
    found = find(documents, id_col, text_col, **options).filter(F.col("first_doc") != F.col(id_col))
    ranges = found.groupBy(F.col(id_col).alias("id__")).agg(F.collect_list(F.struct("start_word", "end_word")).alias("ranges__"))

    @F.arrow_udf("string")
    def cut(texts: pa.Array, at: pa.Array) -> pa.Array:
        rows = zip(texts.to_pylist(), at.to_pylist(), strict=True)
        return pa.array([without(t, [(r["start_word"], r["end_word"]) for r in a or ()]) for t, a in rows], pa.string())

    joined = documents.join(ranges.dropDuplicates(["id__"]), documents[id_col] == ranges["id__"], "left")
    return joined.withColumn(text_col, cut(F.col(text_col), F.col("ranges__"))).select(*documents.columns)
