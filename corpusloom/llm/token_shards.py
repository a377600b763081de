"""Training-order materialisation: token sequences at keyed pseudo-random global slots, in fixed-stride binary shards.

Texts become token ids of a public vocabulary (its rank file is a parameter), each text closed by ``end``. The texts of an
input partition are packed one after another into sequences of ``length`` ids; the last one of a partition is filled with
``end``. Sequences are numbered through all partitions, and a keyed Feistel permutation over the next power of four,
walking its cycle until it falls below the number of sequences, gives each its slot: a bijection without any sort or
state. Shard s holds the slots from s * records on, as little-endian ids of 2 or 4 bytes, so slot -> file and byte
offset is arithmetic and a reader resumes anywhere. A task writes a shard under a temporary name and moves it; the
manifest is a table of what finished tasks wrote.

Each text is encoded once. The sequences of a partition are written in compressed runs of ``RUN`` to a table, which also
gives their numbers; a task then deals its sequences to shards, in compressed rows of up to ``RUN`` of one shard, so the
shuffle moves compressed ids, too. A shard is in memory as a whole when it is written (records * length ids).

Defined cases: a null text is an empty one and gives only `end`; repeated rows are encoded each; a document may span
many sequences, and a sequence many documents, whatever a text's length; an empty table writes no shard and gives no
rows; columns other than id and text aren't read, so their names can't clash.
"""

from __future__ import annotations

import base64
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import new_path, written

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pattern of the vocabulary: what is split before merging (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LENGTH = 1024
RECORDS = 8192
ROUNDS = 6
END = 50256
#: Sequences that are compressed together, and bytes of ids that a task holds before it deals them to shards.
RUN = 128
HELD = 8 << 20
LEVEL = 7


# --- the permutation


def _round(half: np.ndarray, key: int, i: int, mask: np.uint64) -> np.ndarray:
    x = half + np.uint64((key + (i + 1) * 0x9E3779B97F4A7C15) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) & mask


def _pass(x: np.ndarray, key: int, half: int, backwards: bool) -> np.ndarray:
    mask = np.uint64((1 << half) - 1)
    left, right = x >> np.uint64(half), x & mask
    for i in range(ROUNDS):
        if backwards:
            left, right = right ^ _round(left, key, ROUNDS - 1 - i, mask), left
        else:
            left, right = right, left ^ _round(right, key, i, mask)
    return (left << np.uint64(half)) | right


def permute(x: np.ndarray, n: int, key: int, backwards: bool = False) -> np.ndarray:
    """The slots of the numbers x below n, or with `backwards` the numbers of slots."""
    half = max(1, -(-max(1, n - 1).bit_length() // 2))
    out = _pass(np.asarray(x, np.uint64), key, half, backwards)
    while (over := out >= np.uint64(n)).any():
        out[over] = _pass(out[over], key, half, backwards)
    return out.astype(np.int64)


# --- encoding


@lru_cache(maxsize=2)
def _encoding(ranks: bytes) -> tiktoken.Encoding:
    pairs = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=pairs, special_tokens={})


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """A file of the driver's disk, or with a scheme one of a shared store."""
    if "://" in path:
        return bytes(spark.read.format("binaryFile").load(path).first()["content"])
    with open(path, "rb") as f:
        return f.read()


@dataclass(frozen=True)
class Layout:
    sequences: int
    length: int
    records: int
    width: int
    key: int

    @property
    def stride(self) -> int:
        return self.length * self.width

    @property
    def shards(self) -> int:
        return -(-self.sequences // self.records)

    def place(self, slot: int) -> tuple[int, int]:
        """(shard, byte offset) of a slot."""
        return slot // self.records, slot % self.records * self.stride


def _packed(texts: DataFrame, ranks, length: int, end: int, width: int) -> DataFrame:
    """(part, first, n, docs, many, ids): runs of an input partition's sequences, the first one's number there, and for each
    the id of its first text and how many texts it touches."""
    code, kind = "H" if width == 2 else "I", f"<u{width}"
    doc = texts.schema["doc_id"].dataType.simpleString()

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encode = TaskContext.get().partitionId(), _encoding(ranks.value).encode_ordinary
        compress = zstandard.ZstdCompressor(level=LEVEL).compress
        held, docs, ends, number, id_type = array(code), [], [], 0, None

        def cut(n: int) -> pa.RecordBatch:
            nonlocal held, docs, ends, number
            bounds, starts = np.array(ends, np.int64), np.arange(n, dtype=np.int64) * length
            first = np.searchsorted(bounds, starts, side="right")
            last = np.searchsorted(bounds, np.minimum(starts + length, bounds[-1]) - 1, side="right")
            ids = np.array(held[: n * length], kind).tobytes()
            columns = [
                pa.array([part], pa.int32()), pa.array([number], pa.int64()), pa.array([n], pa.int64()),
                pa.array([[docs[i] for i in first]], pa.list_(id_type)), pa.array([last - first + 1], pa.list_(pa.int32())), pa.array([compress(ids)], pa.binary()),
            ]
            done = int(np.searchsorted(bounds, n * length, side="right"))
            held, docs, ends, number = held[n * length :], docs[done:], (bounds[done:] - n * length).tolist(), number + n
            return pa.record_batch(columns, ["part", "first", "n", "docs", "many", "ids"])

        for batch in batches:
            id_type = batch.schema.field(0).type
            # Texts are taken one by one, as a batch of them is large.
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.extend(encode(text.as_py() or ""))
                held.append(end)
                docs.append(i)
                ends.append(len(held))
                while len(held) >= RUN * length:
                    yield cut(RUN)
        if held:
            n = -(-len(held) // length)
            held.extend([end] * (n * length - len(held)))
            yield cut(n)

    return texts.mapInArrow(pack, f"part int, first bigint, n bigint, docs array<{doc}>, many array<int>, ids binary")


def _dealt(packed: DataFrame, starts, layout: Layout) -> DataFrame:
    """(shard, slots, sequences, docs, many, ids): a task's sequences of one shard together, ordered by slot, in rows of RUN."""
    kind = f"<u{layout.width}"

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress, expand = zstandard.ZstdCompressor(level=LEVEL).compress, zstandard.ZstdDecompressor().decompress
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            sequence, docs, many, ids = (pa.concat_arrays(c) if isinstance(c[0], pa.Array) else np.concatenate(c) for c in zip(*held, strict=True))
            slot = permute(sequence, layout.sequences, layout.key)
            o = np.argsort(slot)
            slot, sequence, many, ids, docs = slot[o], sequence[o], many[o], ids[o], docs.take(pa.array(o))
            shard = slot // layout.records
            first = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
            within = np.arange(len(shard)) - np.repeat(first, np.diff(np.r_[first, len(shard)]))
            at = np.r_[np.flatnonzero(within % RUN == 0), len(shard)]
            offsets = pa.array(at, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, c if isinstance(c, pa.Array) else pa.array(c)) for c in (slot, sequence, docs, many)]
            blocks = pa.array([compress(ids[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())
            return pa.record_batch([pa.array(shard[at[:-1]]), *lists, blocks], ["shard", "slots", "sequences", "docs", "many", "ids"])

        for batch in batches:
            part, first, n = (batch.column(i).to_pylist() for i in (0, 1, 2))
            for i in range(batch.num_rows):
                ids = np.frombuffer(expand(batch.column(5)[i].as_py()), kind).reshape(n[i], layout.length)
                held.append((starts.value[part[i]] + first[i] + np.arange(n[i]), batch.column(3)[i].values, batch.column(4)[i].values.to_numpy(), ids))
                size += ids.nbytes
                if size >= HELD:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    docs = packed.schema["docs"].dataType.simpleString()
    return packed.mapInArrow(deal, f"shard bigint, slots array<bigint>, sequences array<bigint>, docs {docs}, many array<int>, ids binary")


def _write(rows: DataFrame, path: str, layout: Layout) -> DataFrame:
    """Writes the shards; (slot, shard, sequence, doc_id, docs, crc) of each record in them is what comes back."""
    kind = f"<u{layout.width}"

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pafs.FileSystem.from_uri(path)
        fs.create_dir(folder)
        expand = zstandard.ZstdDecompressor().decompress
        shard, held = None, []

        def close() -> pa.RecordBatch:
            slot, sequence, docs, many = (pa.concat_arrays([h[i] for h in held]) for i in range(4))
            o = np.argsort(slot.to_numpy())
            slot, sequence, docs, many = (c.take(pa.array(o)) for c in (slot, sequence, docs, many))
            place = np.empty(len(o), np.int64)
            place[o] = np.arange(len(o))
            ids, at = np.empty((len(o), layout.length), kind), 0
            for h in held:
                ids[place[at : at + len(h[0])]] = np.frombuffer(expand(h[4]), kind).reshape(-1, layout.length)
                at += len(h[0])
            due = np.arange(shard * layout.records, min((shard + 1) * layout.records, layout.sequences))
            if not np.array_equal(slot.to_numpy(), due):
                raise RuntimeError(f"shard {shard} has not the slots that are due")
            temporary = f"{folder}/{uuid.uuid4().hex}.tmp"
            with fs.open_output_stream(temporary, compression=None) as sink:
                sink.write(memoryview(ids).cast("B"))
            fs.move(temporary, f"{folder}/shard-{shard:08d}.bin")
            crc = pa.array([zlib.crc32(r) for r in ids], pa.int64())
            return pa.record_batch([slot, pa.array(np.full(len(o), shard)), sequence, docs, many, crc], ["slot", "shard", "sequence", "doc_id", "docs", "crc"])

        for batch in batches:
            for i, s in enumerate(batch.column(0).to_pylist()):
                if s != shard:
                    if held:
                        yield close()
                    shard, held = s, []
                held.append([*(batch.column(k)[i].values for k in (1, 2, 3, 4)), batch.column(5)[i].as_py()])
        if held:
            yield close()

    doc = rows.schema["docs"].dataType.elementType.simpleString()
    # The shards are ranges of slots, so dealing by shard is a range partitioning without a sampling pass.
    dealt = rows.repartition("shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(write, f"slot bigint, shard bigint, sequence bigint, doc_id {doc}, docs int, crc bigint")


def read_shards(spark: SparkSession, path: str, layout: Layout, first_slot: int = 0) -> DataFrame:
    """(slot, ids) in the order of slots within each shard, from first_slot on."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pafs.FileSystem.from_uri(path)
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                slot = max(first_slot, shard * layout.records)
                with fs.open_input_file(f"{folder}/shard-{shard:08d}.bin") as source:
                    source.seek(slot % layout.records * layout.stride)
                    while raw := source.read(512 * layout.stride):
                        if len(raw) % layout.stride:
                            raise RuntimeError(f"shard {shard} is cut off")
                        ids = [raw[i : i + layout.stride] for i in range(0, len(raw), layout.stride)]
                        yield pa.record_batch([pa.array(range(slot, slot + len(ids)), pa.int64()), pa.array(ids, pa.binary())], ["slot", "ids"])
                        slot += len(ids)

    shards = spark.range(first_slot // layout.records, layout.shards)
    return shards.repartition(max(1, min(layout.shards, 2000))).mapInArrow(read, "slot bigint, ids binary")


def materialise(
    documents: DataFrame,
    path: str,
    key: int = 20240101,
    length: int = LENGTH,
    records: int = RECORDS,
    ranks_path: str = RANKS,
    end: int = END,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> tuple[Layout, DataFrame]:
    """Writes the shards of `documents` under `path`; the layout and the manifest, one row a sequence."""
    spark = documents.sparkSession
    texts = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ranks = spark.sparkContext.broadcast(read_bytes(spark, ranks_path))
    width = 2 if end < 65536 else 4
    packed = written(_packed(texts, ranks, length, end, width), "packed")
    # One row for each input partition: the driver's own bookkeeping.
    starts, total = {}, 0
    for part, n in sorted(packed.groupBy("part").agg(F.sum("n")).collect()):
        starts[part], total = total, total + n
    layout = Layout(total, length, records, width, key)
    rows = _dealt(packed, spark.sparkContext.broadcast(starts), layout)
    return layout, written(_write(rows, path, layout), "manifest")


def verified(documents: DataFrame, path: str | None = None, **options) -> DataFrame:
    """The manifest joined with what is read back from the shards: each record's place and checksum, once more."""
    spark = documents.sparkSession
    path = path or new_path(spark, "token-shards")
    layout, manifest = materialise(documents, path, **options)

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1).to_pylist()
            yield pa.record_batch([batch.column(0), pa.array([zlib.crc32(r) for r in raw], pa.int64())], ["slot", "read_crc"])

    back = read_shards(spark, path, layout).mapInArrow(check, "slot bigint, read_crc bigint")
    offset = F.col("slot") % layout.records * layout.stride
    joined = manifest.join(back, "slot", "full")
    return joined.select("slot", "shard", offset.alias("byte_offset"), "sequence", "doc_id", "docs", "crc", "read_crc")
