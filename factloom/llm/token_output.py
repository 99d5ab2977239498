"""Token ids as binary shards with Elias-Fano document boundaries.

A shard holds the ids of consecutive documents in one array and, in place of a table of 64-bit offsets, the Elias-Fano code of the
boundaries: `low` bits of each boundary packed together, the rest in unary, about 2 + log2(ids / documents) bits a document. A count of
ones before every 512th bit answers `select`, so that any document's offset is read without decoding its neighbours. The ascending
document ids are coded the same way.

Shards are rows of a Parquet table in the shared folder, so any store that Spark can write holds them.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import encoder
from .shared import new_path
from .textarrow import pieces

MAGIC = b"FLT1"
BLOCK = 512


class EliasFano:
    """A non-decreasing sequence of integers from 0 on."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        words = np.concatenate([high, np.zeros(-len(high) % (BLOCK // 8), np.uint8)]).reshape(-1, BLOCK // 8)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words).sum(1, dtype=np.uint32), dtype=np.uint32)])
        self.blocks = words

    @classmethod
    def of(cls, values: np.ndarray) -> "EliasFano":
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        low = (values[:, None] >> np.arange(low_bits)[None, :]) & 1
        ones = np.zeros((top >> low_bits) + n + 1, np.uint8)
        ones[(values >> low_bits) + np.arange(n)] = 1
        return cls(n, low_bits, np.packbits(low.astype(np.uint8).ravel(), bitorder="little"), np.packbits(ones, bitorder="little"))

    def to_bytes(self) -> bytes:
        return struct.pack("<QBQQ", self.n, self.low_bits, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def read(cls, data: bytes, at: int) -> tuple["EliasFano", int]:
        n, low_bits, n_low, n_high = struct.unpack_from("<QBQQ", data, at)
        at += struct.calcsize("<QBQQ")
        low, high = np.frombuffer(data, np.uint8, n_low, at), np.frombuffer(data, np.uint8, n_high, at + n_low)
        return cls(n, low_bits, low, high), at + n_low + n_high

    def select(self, i: np.ndarray) -> np.ndarray:
        """The values at places `i`: the block that holds each one, then its place in that block."""
        i = np.asarray(i, np.int64)
        block = np.searchsorted(self.before, i, side="right") - 1
        out = np.empty(len(i), np.int64)
        for start in range(0, len(i), 8192):
            part, own = slice(start, start + 8192), block[start : start + 8192]
            bits = np.unpackbits(self.blocks[own], axis=1, bitorder="little")
            nth = (i[part] - self.before[own] + 1)[:, None]
            out[part] = own * BLOCK + (np.cumsum(bits, axis=1, dtype=np.int32) >= nth).argmax(1)
        value = (out - i) << self.low_bits
        if self.low_bits:
            at = i[:, None] * self.low_bits + np.arange(self.low_bits)[None, :]
            value |= (((self.low[at >> 3] >> (at & 7)) & 1).astype(np.int64) << np.arange(self.low_bits)).sum(1)
        return value


def pack_shard(doc_ids: list, sizes: np.ndarray, ids: np.ndarray) -> bytes:
    """The bytes of a shard: ids of ascending documents, nulls first. Ids take two bytes where all fit, else four."""
    own = np.array([x for x in doc_ids if x is not None], np.int64)
    base = int(own[0]) if len(own) else 0
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    head = MAGIC + struct.pack("<BQQq", width, len(doc_ids) - len(own), len(ids), base)
    return head + EliasFano.of(own - base).to_bytes() + EliasFano.of(np.concatenate([[0], np.cumsum(sizes)])).to_bytes() + ids.astype(f"<u{width}").tobytes()


def unpack_shard(data: bytes) -> tuple[list, EliasFano, np.ndarray]:
    """Document ids, boundaries and ids of a shard."""
    if data[:4] != MAGIC:
        raise ValueError("not a shard")
    width, nulls, n_ids, base = struct.unpack_from("<BQQq", data, 4)
    names, at = EliasFano.read(data, 4 + struct.calcsize("<BQQq"))
    bounds, at = EliasFano.read(data, at)
    doc_ids = [None] * nulls + (names.select(np.arange(names.n)) + base).tolist()
    return doc_ids, bounds, np.frombuffer(data, f"<u{width}", n_ids, at)


def write_shards(docs: DataFrame, tokenizer: str, end_id: int = 0, max_ids: int = 1 << 22, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encode whole texts, append `end_id` to each, write them as shards in ascending id order. Returns the table's path.

    Null texts are empty. Null ids come first, rows of one id in the order of their texts; every row is kept. A shard has at most
    `max_ids` ids, unless a single document has more. An empty table gives a table without shards.
    """

    def encode(batches):
        to_ids, part = encoder(tokenizer), TaskContext.get().partitionId()
        seq, start, names, sizes, held = 0, 0, [], [], []

        def shard():
            nonlocal seq, start, names, sizes, held
            ids = np.concatenate(held)
            row = [[part], [seq], [start], [len(ids)], [pack_shard(names, np.array(sizes), ids)]]
            seq, start, names, sizes, held = seq + 1, start + len(ids), [], [], []
            return pa.RecordBatch.from_arrays([pa.array(row[0], pa.int32()), pa.array(row[1], pa.int32()), pa.array(row[2], pa.int64()), pa.array(row[3], pa.int64()), pa.array(row[4], pa.binary())], ["part", "seq", "start", "n_ids", "content"])

        for batch in pieces(batches, "text", 16 << 20):
            ids, per, _, at = to_ids(batch.column("text"))
            ends = np.concatenate([[0], np.cumsum(per)])[at]
            total = sum(sizes)
            for name, a, b in zip(batch.column("doc_id").to_pylist(), ends[:-1], ends[1:]):
                size = int(b - a) + 1
                if names and total + size > max_ids:
                    yield shard()
                    total = 0
                names.append(name)
                sizes.append(size)
                held += [ids[a:b], np.array([end_id], np.uint32)]
                total += size
        if names:
            yield shard()

    spark = docs.sparkSession
    path = new_path(spark, "token-shards")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(encode, "part int, seq int, start long, n_ids long, content binary").write.option("compression", "none").parquet(path)
    return path


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """Documents of the shards: `doc_id, start` (ids before it in the whole output), `n_tokens, ids_crc32` (of the ids as unsigned 32-bit)."""

    def decode(batches):
        for batch in batches:
            for part, first, content in zip(*(batch.column(c).to_pylist() for c in ("part", "start", "content"))):
                names, bounds, ids = unpack_shard(content)
                at = bounds.select(np.arange(len(names) + 1))
                wide = ids.astype("<u4")
                crc = [zlib.crc32(wide[a:b]) for a, b in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int64()), pa.array(np.full(len(names), part, np.int32)), pa.array(at[:-1] + first), pa.array(np.diff(at)), pa.array(crc, pa.int64())],
                    ["doc_id", "part", "start", "n_tokens", "ids_crc32"],
                )

    shards = spark.read.schema("part int, seq int, start long, n_ids long, content binary").parquet(path)
    # A row for each partition of the writing job: its number bounds this table.
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    found = shards.select("part", "start", "content").mapInArrow(decode, "doc_id long, part int, start long, n_tokens long, ids_crc32 long")
    return found.join(F.broadcast(before), "part").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def token_output(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write the shards of `docs`, and give what reading them back says of each document."""
    return read_shards(docs.sparkSession, write_shards(docs, tokenizer, **options))
