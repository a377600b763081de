"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence.

The product's rows are documents, its columns distinct n-grams, and an entry of (incidence x incidence transposed) is the
overlap of two documents. Only what size-derived bounds leave is multiplied:

1. Column sums: every task counts the n-grams of its texts in sorted runs, ranges of hashes add them up, and n-grams in
   at least ``HOT`` documents are broadcast (at most ``MAX_HOT``, the most frequent ones: an order, so never an error).
2. Columns are ordered, rare ones first. Documents that reach the threshold share one of the first n - ceil(t n) + 1
   n-grams of either, so only these are entries. Documents with equal sets are one row from here on.
3. The entries of a column meet in one run. A run of up to ``SHORT`` rows gives each of its rows the list of the others of
   a fitting size, so rows stay as many as entries.
4. Longer runs are first multiplied with a leader for each class of sizes only, and what links is contracted; after
   ``ROUNDS`` rounds with other leaders, just pairs of rows in different components are left, so a cluster of near copies
   costs a few entries a row and not all its pairs. They are listed as in 3, in square blocks of ``LIST`` rows.
5. A row adds up its overlaps. A pair whose count, plus what both can still share behind the shorter prefix, is below
   the overlap that the sizes ask for is dropped.
6. What is left is multiplied exactly, in blocks of some ``BLOCK`` rows by ``BLOCK`` rows of one neighbourhood, or fewer
   with large sets: the whole sets of a block's documents come together once, pairs already connected in the block are
   skipped, and links come out as a spanning forest. Components of all forests give the classes.

Defined cases: a null text or one without words has an empty set and is linked with nothing (its component is its id);
fewer words than n are one n-gram; rows that repeat a set (or an id) share its component; a null id gets no component;
texts are read whole, however long; an empty table gives no rows. Only the id and the text are read, so no other column's
name can clash. Ids are integers. N-grams are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import BROADCAST_ROWS, join_small, tokens, utf8, written
from corpusloom.llm.components import components

HOT = 64
MAX_HOT = 1_000_000
SHORT = 32
ROUNDS = 1
LIST = 256
BLOCK = 512
#: N-grams to a row of a block on average, at most.
SET = 1024
FLUSH = 1_000_000
#: Pairs that a task holds before it writes them out.
PAIRS = 200_000
TOP = 1 << 62
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
_CAND = np.dtype([("doc", "<i8"), ("last", "<i8"), ("n", "<i4"), ("c", "<i4")])


def shingle_set(raw: bytes | None, width: int) -> np.ndarray:
    """The sorted distinct hashes of a text's n-grams."""
    w = tokens(raw)
    if not w:
        return np.empty(0, np.uint64)
    if len(w) < width:
        return np.array([xxhash.xxh3_64_intdigest(b"\0" + b" ".join(w))], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    s = np.zeros(len(w) - width + 1, np.uint64)
    for i in range(width):
        s += h[i : len(h) - width + 1 + i] * (_MIX[i % 5] + np.uint64(2 * (i // 5)))
    s ^= s >> np.uint64(32)
    s *= _MIX[1]
    s ^= s >> np.uint64(29)
    s.sort()
    return s[np.r_[True, s[1:] != s[:-1]]]


def prefix_length(n, percent: int):
    """How many of its n n-grams a document must show so that every partner at the threshold shares one of them."""
    return n + 1 - (percent * n + 99) // 100


def overlap_needed(n, m, percent: int):
    return -(-percent * (n + m) // (100 + percent))


def linked(n: int, m: int, overlap: int, percent: int) -> bool:
    return 100 * overlap >= percent * (n + m - overlap)


def _rows(names: list[str], *columns) -> pa.RecordBatch:
    return pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)


def _slices(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values: the bytes of `values` cut at `ends` (counted in elements)."""
    offsets = np.r_[0, ends].astype(np.int64) * values.dtype.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values).tobytes())]).cast(pa.binary())


def _joined(column: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column in a row, and how many each row has."""
    parts = column.to_pylist()
    size = np.dtype(dtype).itemsize
    return np.frombuffer(b"".join(parts), dtype), np.array([len(p) // size for p in parts], np.int64)


def whole_runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Sorted batches, regrouped so that no run of equal keys is cut."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            v = batch.column(k).to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
            change[0] |= bool(held) and v[0] != held[-1].column(k)[-1].as_py()
        at = np.flatnonzero(change)
        if not len(at):
            held.append(batch)
            continue
        done = [*held, batch.slice(0, at[-1])] if at[-1] else held
        if done:
            yield pa.Table.from_batches(done).combine_chunks()
        held = [batch.slice(at[-1])]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _numpy(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


# --- 1. column sums


def frequent(texts: DataFrame, width: int, hot: int, bits: int) -> DataFrame:
    """(fp, df): n-grams, by the first bits + 32 bits of their hash, that at least `hot` rows hold."""
    shift = np.uint64(32 - bits)

    def flush(parts: list[np.ndarray]) -> pa.RecordBatch:
        values, n = np.unique(np.concatenate(parts) >> shift, return_counts=True)
        low, at = values.astype(np.uint32), (values >> np.uint64(32)).astype(np.int32)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        ends = np.r_[first[1:], len(at)]
        more = np.column_stack([low, (n - 1).astype(np.uint32)])[n > 1]
        below = np.cumsum(n > 1)[ends - 1]
        return _rows(["part", "once", "more"], at[first], _slices(low, ends), _slices(more.view("V8").ravel(), below))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                s = shingle_set(raw, width)
                parts.append(s)
                size += len(s)
                if size >= FLUSH:
                    yield flush(parts)
                    parts, size = [], 0
        if size:
            yield flush(parts)

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, ["part"]):
            at = _numpy(table, "part")
            first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            for a, b in zip(first, np.r_[first[1:], len(at)], strict=True):
                once, _ = _joined(table.column("once").slice(a, b - a).combine_chunks(), np.uint32)
                more, _ = _joined(table.column("more").slice(a, b - a).combine_chunks(), np.uint32)
                values, n = np.unique(once, return_counts=True)
                n = n.astype(np.int64)
                np.add.at(n, np.searchsorted(values, more[::2]), more[1::2])
                keep = n >= hot
                fp = (np.int64(at[a]) << 32) + values[keep].astype(np.int64)
                yield _rows(["fp", "df"], fp, n[keep])

    runs = texts.select("raw").mapInArrow(count, "part int, once binary, more binary")
    return runs.repartition("part").sortWithinPartitions("part").mapInArrow(add, "fp bigint, df bigint")


class Order:
    """The order of columns: n-grams that aren't frequent by hash, then the frequent ones by their counts."""

    def __init__(self, fp: np.ndarray, bits: int):
        """fp: the frequent n-grams, the most frequent one first."""
        o = np.argsort(fp)
        self.fp, self.rank, self.shift = fp[o].view(np.uint64), (len(fp) - 1 - o).astype(np.int32), np.uint64(32 - bits)

    def keys(self, s: np.ndarray) -> np.ndarray:
        """The columns' numbers in order."""
        k = (s >> np.uint64(2)).astype(np.int64)
        if len(self.fp):
            fp = s >> self.shift
            at = np.searchsorted(self.fp, fp)
            at[at == len(self.fp)] = 0
            hot = self.fp[at] == fp
            k[hot] = TOP + self.rank[at[hot]].astype(np.int64)
        k.sort()
        return k


# --- 2. prefixes


def prefixes(texts: DataFrame, order, width: int, percent: int) -> DataFrame:
    """(id, n, rare, set_key, last, prefix) of each row: rare counts its columns that aren't frequent, last is the last column of
    the prefix."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, rare, key, last, prefix = [], [], [], [], []
            for raw in batch.column(1).to_pylist():
                s = shingle_set(raw, width)
                k = order.value.keys(s)
                rare.append(int(np.searchsorted(k, TOP)))
                k = k[: prefix_length(len(s), percent) if len(s) else 0]
                n.append(len(s))
                key.append(xxhash.xxh3_128_digest(s.tobytes()))
                last.append(int(k[-1]) if len(k) else -1)
                prefix.append(k.tobytes())
            yield _rows(["id", "n", "rare", "set_key", "last", "prefix"], batch.column(0), pa.array(n, pa.int32()), pa.array(rare, pa.int32()), pa.array(key, pa.binary()), pa.array(last, pa.int64()), pa.array(prefix, pa.binary()))

    return texts.select("id", "raw").mapInArrow(cut, "id bigint, n int, rare int, set_key binary, last bigint, prefix binary")


# --- 3. to 5. the bounded product


def _lists(values: pa.Array | np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), values if isinstance(values, pa.Array) else pa.array(values))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column in a row, and how many each row has."""
    return column.flatten().to_numpy(), np.diff(column.offsets.to_numpy())


def _hashed(*values: np.ndarray) -> np.ndarray:
    h = np.zeros(np.broadcast(*values).shape, np.uint64)
    for i, v in enumerate(values):
        h = (h ^ v.astype(np.uint64)) * _MIX[i] + _MIX[4]
        h ^= h >> np.uint64(29)
    return h


def entries(rows: DataFrame) -> DataFrame:
    """(column, doc, last, n): a document's entry in each column of its prefix."""

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, size = _joined(batch.column(3), np.int64)
            yield _rows(["column", "doc", "last", "n"], column, *(np.repeat(batch.column(i).to_numpy(), size) for i in (0, 1, 2)))

    return rows.select("doc", "last", "n", "prefix").mapInArrow(spread, "column bigint, doc bigint, last bigint, n int")


class _Emitter:
    """Gathers pairs and gives them out as (owner, last, n, others): the fitting other rows of each row, with counts."""

    def __init__(self, percent: int):
        self.percent, self.pairs, self.size = percent, [], 0

    def add(self, a: np.ndarray, b: np.ndarray, doc: np.ndarray, last: np.ndarray, n: np.ndarray, fit: np.ndarray | bool = True) -> None:
        small, large = np.minimum(n[a], n[b]).astype(np.int64), np.maximum(n[a], n[b]).astype(np.int64)
        fit = fit & (100 * small >= self.percent * large) & (doc[a] != doc[b])
        a, b = a[fit], b[fit]
        lo, hi = np.minimum(doc[a], doc[b]).astype(np.uint64), np.maximum(doc[a], doc[b]).astype(np.uint64)
        swap = ((((lo * _MIX[0] + hi * _MIX[1]) >> np.uint64(40)) & np.uint64(1)) == 1) != (doc[a] < doc[b])
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        self.pairs.append((doc[a], doc[b], last[a], last[b], n[a], n[b]))
        self.size += len(a)

    def lists(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        own, other, own_last, other_last, own_n, other_n = (np.concatenate(c) for c in zip(*self.pairs, strict=True))
        self.pairs, self.size = [], 0
        o = np.lexsort((other, own))
        own, other, own_last, other_last, own_n, other_n = (c[o] for c in (own, other, own_last, other_last, own_n, other_n))
        first = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (other[1:] != other[:-1])])
        cand = np.empty(len(first), _CAND)
        cand["doc"], cand["last"], cand["n"], cand["c"] = other[first], other_last[first], other_n[first], np.diff(np.r_[first, len(own)])
        own, own_last, own_n = own[first], own_last[first], own_n[first]
        start = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        return own[start], own_last[start], own_n[start], _slices(cand, np.r_[start[1:], len(own)])


def _pairs_within(first: np.ndarray, length: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of places within runs, some PAIRS at a time."""
    for k in np.unique(length[length > 1]):
        i, j = np.triu_indices(k, 1)
        starts = first[length == k]
        step = max(1, PAIRS // len(i))
        for at in range(0, len(starts), step):
            s = starts[at : at + step, None]
            yield (s + i).ravel(), (s + j).ravel()


_PAIR_LISTS = ["owner", "last", "n", "others"]


def runs(table: DataFrame, percent: int, short: int) -> DataFrame:
    """(column, owner, last, n, others): of short runs the lists of pairs, of longer ones the entries, with others null."""
    names = ["column", *_PAIR_LISTS]

    def multiply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Emitter(percent)

        def emit() -> pa.RecordBatch:
            lists = out.lists()
            return _rows(names, pa.nulls(len(lists[0]), pa.int64()), *lists)

        for run in whole_runs(batches, ["column"]):
            column, doc, last, n = (_numpy(run, c) for c in ("column", "doc", "last", "n"))
            first = np.flatnonzero(np.r_[True, column[1:] != column[:-1]])
            length = np.diff(np.r_[first, len(column)])
            long = np.repeat(length > short, length)
            if long.any():
                yield _rows(names, column[long], doc[long], last[long], n[long], pa.nulls(int(long.sum()), pa.binary()))
            for a, b in _pairs_within(first, np.where(length > short, 0, length)):
                out.add(a, b, doc, last, n)
                if out.size >= PAIRS:
                    yield emit()
        if out.size:
            yield emit()

    sorted_runs = table.repartition("column").sortWithinPartitions("column")
    return sorted_runs.mapInArrow(multiply, "column bigint, owner bigint, last bigint, n int, others binary")


def stars(long: DataFrame, rows: DataFrame, percent: int, salt: int) -> DataFrame:
    """(owner, n, others, sizes): rows of long runs (column, doc, n, root) with the leader of their size class in the run, and
    leaders with those of the next class, where they are in different components. First, the leader is the row with the fewest
    rare n-grams: copies have edits of their own, their original hasn't. Later ones are drawn by `salt`."""
    size_class = F.floor(F.log("n") / float(np.log(100 / min(percent, 99)))).cast("int")
    classed = long.select("column", "doc", "n", "root", size_class.alias("class"))
    order = [F.xxhash64("doc", "column", F.lit(salt))]
    if salt == 0:
        classed = written(classed.join(rows.groupBy("doc").agg(F.min("rare").alias("rare")), "doc"), "classed")
        order = [F.col("rare"), F.xxhash64("doc")]
    led = classed.groupBy("column", "class").agg(F.min_by(F.struct("doc", "n", "root"), F.struct(*order)).alias("leader"))
    led = written(led, "leaders")
    pairs = join_small(classed.drop("rare"), led, ["column", "class"], F.col("doc")).select(F.struct("doc", "n", "root").alias("own"), "leader")
    above = led.select("column", (F.col("class") + 1).alias("class"), F.col("leader").alias("own"))
    pairs = pairs.unionByName(above.join(led, ["column", "class"]).select("own", "leader")).filter("own.root <> leader.root")
    pairs = pairs.filter(100 * F.least("own.n", "leader.n") >= percent * F.greatest("own.n", "leader.n"))
    lists = pairs.groupBy(F.col("own.doc").alias("owner"), F.col("own.n").alias("n")).agg(F.collect_set(F.struct("leader.doc", "leader.n")).alias("o"))
    return lists.select("owner", "n", F.col("o.doc").alias("others"), F.col("o.n").alias("sizes"))


def mixed(long: DataFrame) -> DataFrame:
    """Rows of the runs (column, doc, last, n, root) that hold several components, with the largest one (major), its rows (large)
    and the others' (small)."""
    counted = long.groupBy("column", "root").agg(F.count("*").alias("k"))
    of = counted.groupBy("column").agg(F.max_by("root", F.struct("k", "root")).alias("major"), F.max("k").alias("large"), F.sum("k").alias("k"))
    of = written(of.filter("k > large").select("column", "major", "large", (F.col("k") - F.col("large")).alias("small")), "mixed")
    return join_small(long, of, ["column"], F.col("doc")).filter("major is not null")


def crossing(rows: DataFrame, percent: int, size: int) -> DataFrame:
    """(owner, last, n, others) of the pairs in different components of mixed() runs. Rows outside a run's largest component
    meet each other and that component in blocks of `size` rows a side."""
    names = ["column", "part", "cross", "side", "doc", "last", "n", "root"]

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, doc, last, n, root, major, large, small = (c.to_numpy() for c in batch.columns)
            few, many, minor = -(-small // size), -(-large // size), root != major
            own = (_hashed(doc) >> np.uint64(33)).astype(np.int64) % np.where(minor, few, many)
            copies = np.where(minor, few + many, few)
            upto = np.cumsum(copies)
            bounds = np.unique(np.r_[0, np.searchsorted(upto, np.arange(PAIRS, upto[-1] + PAIRS, PAIRS)), len(doc)])
            for begin, end in zip(bounds[:-1], bounds[1:], strict=True):
                at = np.repeat(np.arange(begin, end), copies[begin:end])
                c = np.arange(len(at)) - np.repeat(upto[begin:end] - copies[begin:end] - (upto[begin - 1] if begin else 0), copies[begin:end])
                f, m, o, is_minor = few[at], many[at], own[at], minor[at]
                among = is_minor & (c < f)
                part = np.where(among, np.minimum(o, c) * f + np.maximum(o, c), f * f + np.where(is_minor, o * m + c - f, c * m + o))
                cross = ~among | (o != c)
                side = np.where(among, o, np.where(is_minor, 0, 1)).astype(np.int32)
                yield _rows(names, column[at], part, cross, side, doc[at], last[at], n[at], root[at])

    def multiply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Emitter(percent)
        for run in whole_runs(batches, ["column", "part"]):
            column, part, side, doc, last, n, root = (_numpy(run, c) for c in ("column", "part", "side", "doc", "last", "n", "root"))
            cross = run.column("cross").to_numpy()
            first = np.flatnonzero(np.r_[True, (column[1:] != column[:-1]) | (part[1:] != part[:-1])])
            for a, b in _pairs_within(first, np.diff(np.r_[first, len(column)])):
                out.add(a, b, doc, last, n, (root[a] != root[b]) & (~cross[a] | (side[a] != side[b])))
                if out.size >= PAIRS:
                    yield _rows(_PAIR_LISTS, *out.lists())
        if out.size:
            yield _rows(_PAIR_LISTS, *out.lists())

    schema = "column bigint, part bigint, cross boolean, side int, doc bigint, last bigint, n int, root bigint"
    spread_out = rows.select("column", "doc", "last", "n", "root", "major", "large", "small").mapInArrow(spread, schema)
    sorted_runs = spread_out.repartition("column", "part").sortWithinPartitions("column", "part")
    return sorted_runs.mapInArrow(multiply, "owner bigint, last bigint, n int, others binary")


def bounded(lists: DataFrame, percent: int) -> DataFrame:
    """(owner, n, others, sizes): partners whose count, plus all that both can share behind the shorter prefix, is enough."""

    def prune(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in whole_runs(batches, ["owner"]):
            cand, size = _joined(run.column("others").combine_chunks(), _CAND)
            own, last, n = (np.repeat(_numpy(run, c), size) for c in ("owner", "last", "n"))
            o = np.lexsort((cand["doc"], own))
            cand, own, last, n = cand[o], own[o], last[o], n[o].astype(np.int64)
            first = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (cand["doc"][1:] != cand["doc"][:-1])])
            count = np.add.reduceat(cand["c"].astype(np.int64), first)
            cand, own, last, n = cand[first], own[first], last[first], n[first]
            m = cand["n"].astype(np.int64)
            rest = np.where(last <= cand["last"], n - prefix_length(n, percent), m - prefix_length(m, percent))
            keep = count + rest >= overlap_needed(n, m, percent)
            own, n, other, m = own[keep], n[keep], np.ascontiguousarray(cand["doc"][keep]), m[keep]
            if len(own):
                start = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                ends = np.r_[start[1:], len(own)]
                yield _rows(["owner", "n", "others", "sizes"], own[start], n[start].astype(np.int32), _lists(other, ends), _lists(m.astype(np.int32), ends))

    sorted_runs = lists.repartition("owner").sortWithinPartitions("owner")
    return sorted_runs.mapInArrow(prune, "owner bigint, n int, others array<bigint>, sizes array<int>")


# --- 6. exact blocks


def _labels(candidates: DataFrame) -> DataFrame:
    """(owner, label): the smallest neighbour of each owner of candidates (or itself)."""

    def least(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            other, size = _flat(batch.column(1))
            own = np.repeat(batch.column(0).to_numpy(), size)
            doc, label = np.r_[own, other], np.minimum(np.r_[other, own], np.r_[own, other])
            o = np.lexsort((label, doc))
            first = np.flatnonzero(np.r_[True, doc[o][1:] != doc[o][:-1]]) if len(o) else o
            yield _rows(["owner", "label"], doc[o][first], label[o][first])

    return candidates.select("owner", "others").mapInArrow(least, "owner bigint, label bigint").groupBy("owner").agg(F.min("label").alias("label"))


def _blocks(candidates: DataFrame, block: int) -> DataFrame:
    """(block, owner, others): neighbourhoods with many or large rows, on the owners' side or the others', get many blocks."""

    def sides(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, own, n = (batch.column(i).to_numpy() for i in (0, 1, 2))
            other, size = _flat(batch.column(3))
            rows = np.column_stack([np.r_[label, np.repeat(label, size)], np.r_[np.zeros(len(own), np.int64), np.ones(len(other), np.int64)], np.r_[own, other], np.r_[n, batch.column(4).flatten().to_numpy()]])
            rows = np.unique(rows, axis=0)
            yield _rows(["label", "side", "doc", "n"], *(np.ascontiguousarray(rows[:, i]) for i in range(4)))

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, own, left, right = (batch.column(i).to_numpy() for i in (0, 1, 2, 3))
            other, size = _flat(batch.column(4))
            row = np.repeat(np.arange(len(own)), size)
            i, j = _hashed(own) % left.astype(np.uint64), _hashed(other) % right[row].astype(np.uint64)
            o = np.lexsort((other, j, row))
            row, j, other = row[o], j[o], other[o]
            start = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (j[1:] != j[:-1])]) if len(row) else row
            at = row[start]
            key = _hashed(label[at], i[at], j[start]).view(np.int64)
            yield _rows(["block", "owner", "others"], key, own[at], _lists(other, np.r_[start[1:], len(other)]) if len(start) else pa.array([], pa.list_(pa.int64())))

    labelled = written(candidates.join(_labels(candidates), "owner"), "labelled")
    rows = labelled.select("label", "owner", "n", "others", "sizes").mapInArrow(sides, "label bigint, side bigint, doc bigint, n bigint").distinct()
    parts = [F.ceil(F.greatest(F.count_if(F.col("side") == s) / block, F.sum(F.when(F.col("side") == s, F.col("n"))) / (block * SET))) for s in (0, 1)]
    sized = rows.groupBy("label").agg(parts[0].alias("left"), parts[1].alias("right"))
    placed = join_small(labelled, written(sized, "sizes"), ["label"], F.col("owner"))
    return placed.select("label", "owner", "left", "right", "others").mapInArrow(split, "block bigint, owner bigint, others array<bigint>")


def _members(blocks: DataFrame) -> DataFrame:
    """(block, doc): the documents whose sets a block needs."""

    def unique(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, own = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            other, size = _flat(batch.column(2))
            pairs = np.unique(np.column_stack([np.r_[block, np.repeat(block, size)], np.r_[own, other]]), axis=0)
            yield _rows(["block", "doc"], np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1]))

    return blocks.select("block", "owner", "others").mapInArrow(unique, "block bigint, doc bigint").distinct()


def _links(blocks: DataFrame, members: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b): a spanning forest of the links between each block's documents."""

    def multiply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, have, parent = None, {}, {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        for batch in batches:
            edges = []
            for at, doc, texts, others in zip(*batch.columns, strict=True):
                at, doc, texts, others = at.as_py(), doc.as_py(), texts.as_py(), others.as_py()
                if at != block:
                    block, have, parent = at, {}, {}
                if texts is not None:
                    have[doc] = [shingle_set(raw, width) for raw in texts]
                    continue
                for other in others:
                    if root(doc) == root(other):
                        continue
                    for x in have.get(doc, ()):
                        if any(linked(len(x), len(y), len(np.intersect1d(x, y, True)), percent) for y in have.get(other, ())):
                            parent[root(doc)] = root(other)
                            edges.append((doc, other))
                            break
            if edges:
                yield _rows(["a", "b"], *[pa.array(c, pa.int64()) for c in zip(*edges, strict=True)])

    rows = members.select("block", "doc", "texts", F.lit(None).cast("array<bigint>").alias("others"))
    rows = rows.unionByName(blocks.select("block", F.col("owner").alias("doc"), F.lit(None).cast("array<binary>").alias("texts"), "others"))
    dealt = rows.repartition("block").sortWithinPartitions("block", F.col("texts").isNull(), "doc")
    return dealt.mapInArrow(multiply, "a bigint, b bigint")


def multiplied(candidates: DataFrame, texts: DataFrame, width: int, percent: int, block: int) -> DataFrame:
    """The links (a, b) among candidates (owner, n, others, sizes), a written table, by their whole sets."""
    blocks = written(_blocks(candidates, block), "blocks")
    members = written(_members(blocks), "members")
    needed = written(members.select(F.col("doc").alias("id")).distinct(), "needed")
    found = texts.join(F.broadcast(needed) if needed.count() <= BROADCAST_ROWS else needed, "id", "left_semi")
    # Texts are a third of their n-grams, so these are made in the blocks. The join needs no other shuffle of the texts.
    each = found.groupBy(F.col("id").alias("doc")).agg(F.collect_set("raw").alias("texts")).join(members, "doc")
    return written(_links(blocks, each, width, percent), "links")


def range_bits(texts: DataFrame) -> int:
    """log2 of the hash ranges: some two million n-grams a range, if a word has six bytes."""
    size = texts.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
    return min(28, max(8, (size // 12_000_000).bit_length()))


def join(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 4,
    percent: int = 85,
    hot: int = HOT,
    max_hot: int = MAX_HOT,
    block: int = BLOCK,
    short: int = SHORT,
    rounds: int = ROUNDS,
    size: int = LIST,
) -> DataFrame:
    """Per row: id_col, n_shingles and component_id, the smallest id that links (Jaccard >= percent / 100) reach."""
    if not 50 <= percent <= 100:
        raise ValueError("percent must be from 50 to 100")
    spark = documents.sparkSession
    texts = documents.select(F.col(id_col).cast("bigint").alias("id"), utf8(F.col(text_col)).alias("raw"))
    bits = range_bits(texts)
    counted = written(frequent(texts.filter("id is not null"), width, hot, bits), "frequent")
    # One number each goes through the driver; the order of the rows says the rest.
    top = counted.orderBy(F.desc("df"), "fp").limit(max_hot).select("fp").toArrow()
    order = spark.sparkContext.broadcast(Order(_numpy(top, "fp"), bits))
    del top

    each = written(prefixes(texts, order, width, percent), "prefixes")
    distinct = each.filter("n > 0 and id is not null").groupBy("set_key")
    rows = written(distinct.agg(F.min("id").alias("doc"), F.first("n").alias("n"), F.first("rare").alias("rare"), F.first("last").alias("last"), F.first("prefix").alias("prefix")), "rows")

    met = written(runs(entries(rows), percent, short), "runs")
    lists = met.filter("others is not null").select(*_PAIR_LISTS)
    long = met.filter("others is null").select("column", F.col("owner").alias("doc"), "last", "n")
    roots = None
    if not long.isEmpty():
        left = long.withColumn("root", F.col("doc"))
        for salt in range(rounds):
            found = multiplied(written(stars(left, rows, percent, salt), "stars"), texts, width, percent, block)
            if found.isEmpty():
                break
            roots = written(components(found if roots is None else found.unionByName(roots.toDF("a", "b"))), "roots")
            left = written(mixed(long.join(roots.toDF("doc", "root"), "doc", "left").withColumn("root", F.coalesce("root", "doc"))), "left")
        if "major" not in left.columns:
            left = written(mixed(left), "left")
        if not left.isEmpty():
            lists = lists.unionByName(crossing(left, percent, size))
    candidates = written(bounded(lists, percent), "candidates")
    found = multiplied(candidates, texts, width, percent, block)
    roots = components(found if roots is None else found.unionByName(roots.toDF("a", "b")))

    keyed = each.join(rows.select("set_key", "doc"), "set_key", "left").join(roots, F.col("doc") == F.col("node"), "left")
    alone = F.when((F.col("n") == 0) | F.col("id").isNull(), F.col("id"))
    kind = documents.schema[id_col].dataType
    return keyed.select(
        F.col("id").cast(kind).alias(id_col),
        F.col("n").cast("bigint").alias("n_shingles"),
        F.coalesce(alone, F.when(F.col("id").isNotNull(), F.coalesce("root", "doc"))).cast(kind).alias("component_id"),
    )


def keep_one(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each component: that with the smallest id, and where rows repeat it, the one with the smallest text. Rows
    without an id are kept."""
    joined = join(documents, id_col, text_col, **options)
    keep = joined.filter(F.col("component_id") == F.col(id_col)).select(F.col(id_col).alias("id__")).distinct()
    named = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row__"), F.col(id_col).alias("id__"), F.col(text_col).alias("text__"))
    kept = named.join(keep, "id__", "left_semi").groupBy("id__").agg(F.min_by("row__", F.coalesce("text__", F.lit(""))).alias("row__")).select("row__.*")
    return kept.unionByName(documents.filter(F.col(id_col).isNull()))
