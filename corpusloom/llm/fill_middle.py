"""Fill-in-middle transformation by content-defined chunk memoization.

The cuts of a document are drawn as places between code points, and a text comes as UTF-8 bytes. A rolling hash over
``WINDOW`` bytes parts the bytes into chunks wherever the content says so, thus passages that documents share fall into the
same chunks. A chunk is summarised once: how many code points begin in it, whether it holds a marker, and its outermost bytes,
in which a marker could cross into its neighbour. The summaries are kept by content in a cache of ``CACHE_BYTES`` in each
task; one that is found by its hash is verified byte by byte. Adding up the chunks' counts leads to the chunks that hold the
cuts, and only in these are code points looked for. The cache changes costs, never results.

Defined cases: a null or empty text stays as it is (form `plain`, n 0, output null or empty); a text that contains a marker is
plain, so that every output can be taken apart again; a null id draws as the empty text; repeated rows are cut alike; texts of
any length are cut as a whole; bytes that are no UTF-8 count by their lead bytes; an empty table stays empty; the result is a
column of its own, so columns of any name may stand beside it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.llm.common import utf8

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKERS = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
#: Percent of the texts that are transformed, and of these the share whose suffix comes first.
RATE, SUFFIX_FIRST = 90, 20
SEED = "1"

#: Bytes that decide on a boundary: a 32-bit hash that shifts by one bit a byte forgets what lies further back.
WINDOW = 32
#: A boundary falls on one of 2 ** CHUNK_BITS bytes; chunks have from LEAST to MOST bytes.
CHUNK_BITS, LEAST, MOST = 9, 64, 4096
#: Chunk bytes that a task's cache holds.
CACHE_BYTES = 32 << 20
_GEAR = np.array([xxhash.xxh32_intdigest(bytes([b])) for b in range(256)], np.uint32)


def chunk_ends(raw: bytes) -> list[int]:
    """Where the chunks of a text end."""
    n = len(raw)
    if n <= LEAST:
        return [n] if n else []
    h, width = _GEAR[np.frombuffer(raw, np.uint8)], 1
    while width < WINDOW:
        # The hash of 2 w bytes from those of w bytes.
        h[width:] = h[width:] + (h[:-width] << np.uint32(width))
        width *= 2
    at = np.flatnonzero(h >> np.uint32(32 - CHUNK_BITS) == 0) + 1
    ends, start = [], 0
    while start < n:
        k = int(np.searchsorted(at, start + LEAST))
        end = int(at[k]) if k < len(at) else n
        start = min(end, start + MOST, n)
        ends.append(start)
    return ends


def _leads(chunk: bytes) -> np.ndarray:
    """Which bytes begin a code point."""
    return np.frombuffer(chunk, np.uint8) & 0xC0 != 0x80


class Summaries:
    """Chunk -> (code points that begin in it, whether it holds a marker, first two bytes, last two bytes).

    Two generations: what isn't asked for while `room` / 2 bytes of chunks come in is forgotten."""

    def __init__(self, room: int = CACHE_BYTES):
        self.room, self.size, self.young, self.old = room, 0, {}, {}
        self.hits = 0

    def of(self, chunk: bytes) -> tuple[int, bool, bytes, bytes]:
        key = xxhash.xxh3_64_intdigest(chunk)
        known = self.young.get(key) or self.old.get(key)
        if known and known[0] == chunk:
            self.hits += 1
        else:
            known = (chunk, (int(np.count_nonzero(_leads(chunk))), any(m in chunk for m in MARKERS), chunk[:2], chunk[-2:]))
        if self.young.get(key) is not known:
            self.young[key] = known
            self.size += len(chunk)
            if 2 * self.size > self.room:
                self.young, self.old, self.size = {}, self.young, 0
        return known[1]


def summary(raw: bytes, summaries: Summaries) -> tuple[list[int], list[int], bool]:
    """(ends of the chunks, code points up to each end, whether the text holds a marker)."""
    ends, upto, marked, start, total, before = chunk_ends(raw), [], False, 0, 0, b""
    for end in ends:
        n, inside, head, tail = summaries.of(raw[start:end])
        marked = marked or inside or any(m in before + head for m in MARKERS)
        total += n
        upto.append(total)
        start, before = end, (before + tail)[-2:]
    return ends, upto, marked


def byte_of(raw: bytes, ends: list[int], upto: list[int], point: int) -> int:
    """The byte at which code point number `point` begins; the text's length for the number behind the last."""
    k = int(np.searchsorted(upto, point, "right"))
    if k == len(ends):
        return len(raw)
    start = ends[k - 1] if k else 0
    return start + int(np.flatnonzero(_leads(raw[start : ends[k]]))[point - (upto[k - 1] if k else 0)])


def transform_text(raw: bytes | None, draws: list[int], summaries: Summaries, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> tuple:
    """(n, form, code points of the prefix, of the middle, output) of a text; draws are the four numbers of its document."""
    ends, upto, marked = summary(raw, summaries) if raw else ([], [], False)
    n = upto[-1] if upto else 0
    if not n or marked or draws[2] % 100 >= rate:
        return n, "plain", None, None, raw
    low, high = sorted(h % (n + 1) for h in draws[:2])
    a, b = byte_of(raw, ends, upto, low), byte_of(raw, ends, upto, high)
    p, s, m = (mark + part for mark, part in zip(MARKERS, (raw[:a], raw[b:], raw[a:b]), strict=True))
    if draws[3] % 100 < suffix_first:
        return n, "spm", low, high - low, s + p + m
    return n, "psm", low, high - low, p + s + m


RESULT = "struct<n:bigint,form:string,prefix_chars:bigint,middle_chars:bigint,output:string>"


def draws(key: Column, seed: str = SEED) -> Column:
    """The four numbers of a document: 8-digit groups of the SHA-256 of the seed, a colon and the document's id."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)])


def transform(key: Column, text: Column, seed: str = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, cache_bytes: int = CACHE_BYTES) -> Column:
    """n, form, prefix_chars, middle_chars and output of a text whose document is `key`."""

    @F.arrow_udf(RESULT)
    def transformed(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        summaries = Summaries(cache_bytes)
        for numbers, texts in batches:
            rows = [transform_text(t.as_py(), d, summaries, rate, suffix_first) for d, t in zip(numbers.to_pylist(), texts, strict=True)]
            n, form, prefix, middle, output = zip(*rows, strict=True) if rows else [()] * 5
            counts = [pa.array(c, pa.int64()) for c in (n, prefix, middle)]
            columns = [counts[0], pa.array(form, pa.string()), counts[1], counts[2], pa.array(output, pa.binary()).cast(pa.string(), safe=False)]
            yield pa.StructArray.from_arrays(columns, ["n", "form", "prefix_chars", "middle_chars", "output"])

    return transformed(draws(key, seed), utf8(text))


def restored(form: Column, output: Column) -> Column:
    """The text that an output was made of. No part of a transformed text holds a marker."""
    part = F.split(output, "<[PSM]>", -1)
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)


def digest(r: Column) -> list[Column]:
    """The columns of the report, from transform()'s struct."""
    sha = [F.sha2(F.coalesce(c, F.lit("")).cast("binary"), 256) for c in (r["output"], restored(r["form"], r["output"]))]
    return [r["n"].alias("n"), r["form"].alias("form"), r["prefix_chars"].alias("prefix_chars"), r["middle_chars"].alias("middle_chars"), sha[0].alias("output_sha256"), sha[1].alias("restored_sha256")]
