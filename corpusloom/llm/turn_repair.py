"""Conversation structure repair by Wagner-Fischer alignment with the grammar of turns.

A good conversation's role initials read ``(s?(ua)+)?``: nothing, or users and assistants in turns with a system row before
them at most. For each length there is one such string, so turns are aligned with the string of each feasible length, and
of all cheapest alignments the one with the ASCII-least audit (D, I, K, R for delete, insert, keep and rerole) is taken:

1. Rows lose their texts: a row is a role initial and a fault. Equal rows of a turn are counted before they are shuffled, and
   the first of equal rows of a conversation is a partial minimum and a join.
2. Ranges of (conversation, turn) hold the rows in order, so a conversation of any size is spread over tasks. Each piece
   of up to ``SEGMENT`` rows is aligned where it lies. Strings of different lengths share their ends, so one table of costs
   (rows left by letters left) serves all lengths; its rows are computed inside Ukkonen's band, which the cost of a greedy
   alignment bounds. The cheapest lengths are traced from the front, least letter first, and their audits compared.
3. A piece that is no whole conversation is aligned from each state of the grammar to each other; the pieces of a conversation
   are folded in order, and what all its open audits share is put aside. Equal prices never leave one audit a prefix of the
   other, so least audits of pieces make the least audit of the whole.
4. Texts are shuffled once, sorted behind their audit, and edited as they stream by.

Defined cases: rows go by turn, null turns first, then by role and by the MD5 of the text; a null role or text is one space, so
such a text is blank; null conversation ids are one conversation; empty roles have no initial and must be rerolled or deleted;
repeated rows are duplicates from the second on; a conversation without rows needs nothing; an empty table stays empty; texts
of any length are hashed as they stream; columns of other names are ignored, so they can't clash.
An audit is one cell and a SHA-256 one chain: a byte for each row of one conversation, and its texts as a stream, go through
one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import null_key, written

#: Prices of the edits; an undeleted truncated row adds TRUNCATED. Keeping is free.
INSERT, REROLE, DELETE, TRUNCATED = 3, 3, 4, 3
ROLES = ("user", "assistant")
SPACE = " \t\n\x0b\x0c\r"

#: Rows of a piece that is aligned at once.
SEGMENT = 512
#: Alignments of whole conversations that a task remembers by their codes.
MEMO = 1 << 16

INITIALS = {"s": 0, "u": 1, "a": 2}
OTHER = 3
FINE, CUT_OFF, BLANK, DUPLICATE = range(4)
#: States of the grammar: nothing yet, after s, after u, after a.
NOTHING, AFTER_S, AFTER_U, AFTER_A = range(4)
_FAR = 1 << 29


class Alignment:
    """Costs of a piece's rows from each row on, against the last letters of an alternating string that ends with `end`."""

    def __init__(self, codes: bytes, end: int):
        code = np.frombuffer(codes, np.uint8)
        self.n, self.end = len(code), end
        self.initial, fault = code & 3, code >> 2
        self.lost = fault >= BLANK
        self.extra = np.where(fault == CUT_OFF, TRUNCATED, 0).astype(np.int32)
        alive = np.r_[np.cumsum(~self.lost[::-1])[::-1], 0]
        spare = _greedy(self.initial, self.lost, self.extra) - DELETE * int(self.lost.sum())
        low, high = np.maximum(alive - spare // DELETE, 0), alive + spare // INSERT
        price = {t: np.where(self.lost, _FAR, np.where(self.initial == t, 0, REROLE) + self.extra).astype(np.int32) for t in (1, 2)}
        self.keep_s = np.where((self.initial == 0) & ~self.lost, self.extra, _FAR).astype(np.int32)
        width = int(high.max()) + 1
        ramp = INSERT * np.arange(width, dtype=np.int32)
        odd = np.arange(width) % 2 == 1
        self.cost = np.full((self.n + 1, width), _FAR, np.int32)
        self.cost[self.n] = ramp
        self.with_s = np.full((self.n + 1, width), _FAR, np.int32) if (self.keep_s < _FAR).any() else None
        for i in range(self.n - 1, -1, -1):
            a, b = int(low[i]), int(high[i]) + 1
            below = self.cost[i + 1]
            here = below[a:b] + DELETE
            if not self.lost[i]:
                # A string of r letters begins with its last letter where r is odd, else with the other one.
                letter = np.where(odd[a:b], price[end][i], price[3 - end][i])
                here[1 if a == 0 else 0 :] = np.minimum(here[1 if a == 0 else 0 :], letter[1 if a == 0 else 0 :] + below[max(a, 1) - 1 : b - 1])
            here = np.minimum.accumulate(here - ramp[a:b]) + ramp[a:b]
            self.cost[i, a:b] = np.minimum(here, _FAR)
            if self.with_s is not None:
                self.with_s[i] = np.minimum(np.minimum(self.with_s[i + 1] + DELETE, below + self.keep_s[i]), _FAR)

    def trace(self, left: int, s: bool) -> bytes:
        """The least audit of the cheapest alignments with `left` letters (behind an s)."""
        out, i = bytearray(), 0
        while i < self.n or left or s:
            if s:
                deleted = i < self.n and self.with_s[i + 1, left] + DELETE == self.with_s[i, left]
                out += b"D" if deleted else b"K"
                i, s = i + 1, deleted
                continue
            here = self.cost[i, left]
            if i < self.n and self.cost[i + 1, left] + DELETE == here:
                out += b"D"
                i += 1
            elif left and self.cost[i, left - 1] + INSERT == here:
                out += b"I"
                left -= 1
            else:
                letter = self.end if left % 2 else 3 - self.end
                out += b"K" if self.initial[i] == letter else b"R"
                i, left = i + 1, left - 1
        return bytes(out)

    def best(self, lengths: Iterable[tuple[int, int]]) -> tuple[int, bytes] | None:
        """The cheapest and then least alignment; lengths: (first, whether behind an s), each with every second one beyond."""
        rows = [(self.with_s if s else self.cost, first, s) for first, s in lengths if not s or self.with_s is not None]
        least = min((int(t[0, first::2].min(initial=_FAR)) for t, first, _ in rows), default=_FAR)
        if least >= _FAR:
            return None
        return least, min(self.trace(first + 2 * int(k), bool(s)) for t, first, s in rows for k in np.flatnonzero(t[0, first::2] == least))


def _greedy(initial: np.ndarray, lost: np.ndarray, extra: np.ndarray) -> int:
    """A cost that no cheapest alignment exceeds, wherever in the grammar it begins and ends: rows are kept or rerolled in turns,
    and a letter inserted at either side where it must be."""
    live = initial[~lost]
    wrong = int(np.count_nonzero(live != 1 + np.arange(len(live)) % 2))
    return DELETE * int(lost.sum()) + REROLE * wrong + int(extra[~lost].sum()) + INSERT * (len(live) % 2) + 2 * INSERT


@lru_cache(MEMO)
def align(codes: bytes) -> tuple[int, bytes]:
    """(cost, audit) of a whole conversation."""
    found = Alignment(codes, 2).best([(2, False), (2, True)])
    return min([(DELETE * len(codes), b"D" * len(codes)), *([found] if found else [])])


def transfers(codes: bytes) -> list[tuple[int, int, int, bytes]]:
    """(state before, state after, cost, audit) of a piece of a conversation."""
    n, to_a, to_u = len(codes), Alignment(codes, 2), Alignment(codes, 1)
    gone = (DELETE * n, b"D" * n)
    only = [(DELETE * (n - 1) + int(c), b"D" * i + b"K" + b"D" * (n - 1 - i)) for i, c in enumerate(to_a.keep_s) if c < _FAR]
    found = {
        (NOTHING, NOTHING): gone,
        (NOTHING, AFTER_S): min(only, default=None),
        (NOTHING, AFTER_U): to_u.best([(1, False), (1, True)]),
        (NOTHING, AFTER_A): to_a.best([(2, False), (2, True)]),
        (AFTER_S, AFTER_S): gone,
        (AFTER_S, AFTER_U): to_u.best([(1, False)]),
        (AFTER_S, AFTER_A): to_a.best([(2, False)]),
        (AFTER_U, AFTER_U): to_u.best([(0, False)]),
        (AFTER_U, AFTER_A): to_a.best([(1, False)]),
        (AFTER_A, AFTER_U): to_u.best([(1, False)]),
        (AFTER_A, AFTER_A): to_a.best([(0, False)]),
    }
    return [(*k, *v) for k, v in found.items() if v]


class Fold:
    """The least audits of a conversation's pieces so far, by state."""

    def __init__(self):
        self.shared, self.open = bytearray(), {NOTHING: (0, b"")}

    def add(self, steps: Iterable[tuple[int, int, int, bytes]]) -> None:
        now: dict[int, tuple[int, bytes]] = {}
        for before, after, cost, audit in steps:
            if before in self.open:
                c, a = self.open[before]
                now[after] = min(now.get(after, (_FAR << 32, b"")), (c + cost, a + audit))
        same = len(commonprefix([a for _, a in now.values()]))
        self.shared += next(iter(now.values()))[1][:same]
        self.open = {k: (c, a[same:]) for k, (c, a) in now.items()}

    def end(self) -> tuple[int, bytes]:
        cost, audit = min(self.open[k] for k in (NOTHING, AFTER_A) if k in self.open)
        return cost, bytes(self.shared) + audit


# --- rows without texts


def _prepared(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(k, turn, role, text, d): d is what stands for the text where rows are compared and sorted."""
    said = F.coalesce(F.col(text).cast("string"), F.lit(" "))
    return rows.select(null_key(F.col(conv)).alias("k"), F.col(turn).cast("bigint").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"), said.alias("text"), F.unhex(F.md5(said)).alias("d"))


def _coded(rows: DataFrame) -> DataFrame:
    """(k, turn, role, d, one, more, n): distinct rows of a turn, the code of their first copy and that of the others."""
    end = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = F.when(end == "", BLANK).when(F.right(end, F.lit(1)).isin(".", "!", "?"), FINE).otherwise(CUT_OFF)
    initial = F.lit(OTHER)
    for letter, number in INITIALS.items():
        initial = F.when(F.left("role", F.lit(1)) == letter, number).otherwise(initial)
    counted = rows.select("k", "turn", "role", "d", initial.alias("initial"), fault.alias("fault"))
    counted = written(counted.groupBy("k", "turn", "role", "d", "initial", "fault").agg(F.count("*").alias("n")), "turns")
    place = F.struct(F.col("turn").isNotNull(), "turn")
    firsts = counted.groupBy("k", "role", "d").agg(F.min(place).alias("first"))
    again = F.when(F.col("fault") == BLANK, BLANK).otherwise(DUPLICATE)
    fault = F.when(F.col("first") == place, F.col("fault")).otherwise(again)
    return counted.join(firsts, ["k", "role", "d"]).select("k", "turn", "role", "d", (F.col("initial") + 4 * fault).alias("one"), (F.col("initial") + 4 * again).alias("more"), "n")


ORDER = ["k", "turn", "role", "d"]
_COUNTS = ["blank", "duplicate", "truncated", "illegal"]
_STEP = pa.struct([("before", pa.int32()), ("after", pa.int32()), ("cost", pa.int64()), ("audit", pa.binary())])
_PIECE = pa.schema([
    ("k", pa.string()), ("part", pa.int32()), ("seq", pa.int32()), ("first", pa.int32()), ("last", pa.int32()), *[(c, pa.int64()) for c in _COUNTS],
    ("cost", pa.int64()), ("audit", pa.binary()), ("steps", pa.list_(_STEP)),
])
_PIECE_SQL = f"k string, part int, seq int, first int, last int, {', '.join(f'{c} bigint' for c in _COUNTS)}, cost bigint, audit binary, steps array<struct<before:int,after:int,cost:bigint,audit:binary>>"


def counts(codes: bytes) -> dict[str, int]:
    code = np.frombuffer(codes, np.uint8)
    initial, fault = code & 3, code >> 2
    pair = 4 * initial[:-1] + initial[1:]
    return {
        "blank": int(np.count_nonzero(fault == BLANK)),
        "duplicate": int(np.count_nonzero(fault == DUPLICATE)),
        "truncated": int(np.count_nonzero(fault == CUT_OFF)),
        "illegal": len(pair) - int(np.isin(pair, _LEGAL).sum()),
    }


#: su, ua, au.
_LEGAL = [4 * INITIALS[p[0]] + INITIALS[p[1]] for p in ("su", "ua", "au")]


def _pieces(coded: DataFrame, segment: int) -> DataFrame:
    """Pieces in order (k, part, seq) with their counts; steps is null where a piece is a whole conversation."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, key, seq, held, run, out = TaskContext.get().partitionId(), None, 0, bytearray(), 0, []

        def piece(codes: bytes, whole: bool) -> dict:
            row = {"k": key, "part": part, "seq": seq, "first": codes[0] & 3, "last": codes[-1] & 3, **counts(codes)}
            if whole:
                row["cost"], row["audit"] = align(codes)
            else:
                row["steps"] = [dict(zip(_STEP.names, step, strict=True)) for step in transfers(codes)]
            return row

        for batch in batches:
            keys, one, more, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            upto = np.cumsum(n)
            codes = np.repeat(more.astype(np.uint8), n)
            codes[upto - n] = one
            edges = np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys)] if len(keys) else []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if keys[a] != key:
                    if key is not None:
                        out.append(piece(bytes(held), seq == 0 and run > 1))
                    key, seq, held, run = keys[a], 0, bytearray(), run + 1
                held += codes[upto[a] - n[a] : upto[b - 1]].tobytes()
                while len(held) > segment:
                    out.append(piece(bytes(held[:segment]), False))
                    seq, held = seq + 1, held[segment:]
                if len(out) >= 1000:
                    yield pa.RecordBatch.from_pylist(out, _PIECE)
                    out = []
        if key is not None:
            out.append(piece(bytes(held), False))
        if out:
            yield pa.RecordBatch.from_pylist(out, _PIECE)

    return coded.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).select("k", "one", "more", "n").mapInArrow(cut, _PIECE_SQL)


_REPORT = pa.schema([("k", pa.string()), *[(c, pa.int64()) for c in _COUNTS], ("cost", pa.int64()), ("audit", pa.string())])
_REPORT_SQL = f"k string, {', '.join(f'{c} bigint' for c in _COUNTS)}, cost bigint, audit string"


def _folded(pieces: DataFrame) -> DataFrame:
    """The reports of conversations in several pieces."""

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, folded, last = None, None, None

        def report() -> pa.RecordBatch:
            cost, audit = folded.end()
            return pa.RecordBatch.from_pylist([row | {"cost": cost, "audit": audit.decode()}], _REPORT)

        for batch in batches:
            for p in batch.to_pylist():
                if row is None or p["k"] != row["k"]:
                    if row is not None:
                        yield report()
                    row, folded, last = {"k": p["k"], **dict.fromkeys(_COUNTS, 0)}, Fold(), None
                for c in _COUNTS:
                    row[c] += p[c]
                row["illegal"] += last is not None and 4 * last + p["first"] not in _LEGAL
                last = p["last"]
                folded.add(tuple(s.values()) for s in p["steps"])
        if row is not None:
            yield report()

    order = ["k", "part", "seq"]
    return pieces.filter("steps is not null").repartition("k").sortWithinPartitions(*order).mapInArrow(fold, _REPORT_SQL)


def audits(prepared: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(k, gaps, blank, duplicate, truncated, illegal, cost, audit) of the conversations that have rows."""
    coded = _coded(prepared)
    pieces = written(_pieces(coded, segment), "pieces")
    whole = pieces.filter("steps is null").select("k", *_COUNTS, "cost", F.col("audit").cast("string").alias("audit"))
    turns = coded.select("k", "turn").distinct().groupBy("k")
    gaps = turns.agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
    return written(whole.unionByName(_folded(pieces)).join(gaps, "k"), "audits")


# --- rows with texts


def _edits(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, str, str, str]]:
    """(k, edit, role, text) of sorted rows (k, audit, role, text), in which a conversation's audit precedes its rows."""
    key, audit, at, place, odd = None, "", 0, 0, 0

    def inserts() -> Iterator[tuple[str, str, str, str]]:
        nonlocal at, place
        while at < len(audit) and audit[at] == "I":
            yield key, "I", ROLES[(place - odd) % 2], ""
            at, place = at + 1, place + 1

    for batch in batches:
        for k, audit_, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if audit_ is not None:
                yield from inserts()
                key, audit, at, place = k, audit_, 0, 0
                odd = (len(audit) - audit.count("D")) % 2
                continue
            yield from inserts()
            edit = audit[at]
            at += 1
            yield key, edit, ROLES[(place - odd) % 2] if edit == "R" else role, text
            place += edit != "D"
    yield from inserts()


def _edited(prepared: DataFrame, reports: DataFrame) -> DataFrame:
    """Rows behind their audits: (k, audit, role, text)."""
    said = prepared.select(*ORDER, "text", F.lit(None).cast("string").alias("audit"))
    head = reports.select("k", F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("role"), F.lit(None).cast("binary").alias("d"), F.lit(None).cast("string").alias("text"), "audit")
    both = head.unionByName(said).repartition("k").sortWithinPartitions("k", F.col("audit").isNull(), *ORDER[1:])
    return both.select("k", "audit", "role", "text")


def fingerprints(prepared: DataFrame, reports: DataFrame) -> DataFrame:
    """(k, repaired_sha256): the hash of the lines `role:text` of each repaired conversation."""

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha, begun, out = None, None, False, []
        for k, edit, role, text in _edits(batches):
            if k != key:
                if key is not None:
                    out.append((key, sha.hexdigest()))
                key, sha, begun = k, hashlib.sha256(), False
            if edit != "D":
                sha.update(f"{chr(10) if begun else ''}{role}:{text}".encode(errors="surrogatepass"))
                begun = True
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["k", "repaired_sha256"])
                out = []
        if key is not None:
            out.append((key, sha.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["k", "repaired_sha256"])

    return _edited(prepared, reports).mapInArrow(hashed, "k string, repaired_sha256 string")


def repaired(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", segment: int = SEGMENT) -> DataFrame:
    """(conv, place, edit, role, text): the rows of the repaired conversations, numbered from 0."""

    def edited(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, key, place, out, size = ["k", "place", "edit", "role", "text"], None, 0, [], 0
        for k, edit, r, t in _edits(batches):
            if k != key:
                key, place = k, 0
            if edit != "D":
                out.append((k, place, edit, r, t))
                place, size = place + 1, size + len(t)
            if len(out) >= 10_000 or size >= 1 << 24:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names)

    prepared = _prepared(rows, conv, turn, role, text)
    made = _edited(prepared, audits(prepared, segment)).mapInArrow(edited, "k string, place bigint, edit string, role string, text string")
    back = F.when(F.col("k") != "", F.substr("k", F.lit(2))).cast(rows.schema[conv].dataType)
    return made.select(back.alias(conv), "place", "edit", "role", "text")


def report(rows: DataFrame, originals: DataFrame | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", segment: int = SEGMENT) -> DataFrame:
    """One row for each conversation of `originals` (or of rows): conv, gaps, blank, duplicate, truncated, illegal, cost, audit and
    repaired_sha256."""
    prepared = _prepared(rows, conv, turn, role, text)
    reports = audits(prepared, segment)
    ids = (rows if originals is None else originals).select(F.col(conv).alias("conv__")).distinct().withColumn("k", null_key(F.col("conv__")))
    told = ids.join(reports, "k", "left").join(fingerprints(prepared, reports), "k", "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", *_COUNTS, "cost")]
    return told.select(F.col("conv__").alias(conv), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


# --- faults put into good rows


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text) with faults by the CRC-32 of `conv:turn` modulo 20: 0 drops a row, 1 empties its text, 2 takes the
    text's `[.!?]`, 3 repeats the row, 4 makes its role user. Nulls are one space."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col(conv).cast("string"), blank), F.lit(":"), F.coalesce(F.col(turn).cast("string"), blank))
    said, by = F.coalesce(F.col(text).cast("string"), blank), F.coalesce(F.col(role).cast("string"), blank)
    hit = rows.select(conv, turn, by.alias("role__"), said.alias("text__"), F.pmod(F.crc32(key.cast("binary")), F.lit(20)).alias("hit__")).filter("hit__ <> 0")
    said = F.when(F.col("hit__") == 1, "").when(F.col("hit__") == 2, F.regexp_replace("text__", "[.!?]", "")).otherwise(F.col("text__"))
    by = F.when(F.col("hit__") == 4, ROLES[0]).otherwise(F.col("role__"))
    copies = F.explode(F.when(F.col("hit__") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return hit.select(conv, turn, by.alias(role), said.alias(text), copies.alias("copy__")).drop("copy__")

