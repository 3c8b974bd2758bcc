"""Token ids on disk: a wavelet matrix for each shard, in one compressed file.

File: MAGIC, then a zstd frame for each part. The header (JSON) has the number
of tokens and bits, the zeros of each bit-plane and the documents' ids and
lengths; each bit-plane follows as a frame of its own, opened when it is first
needed, so that who wants the documents alone opens none. Ranks come from
counts of ones before each 512 bits. ``tokens_at``, ``token_counts`` and
``occurrences`` answer from the shards of a folder, each task from its own.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanewise.llm.common import new_path, small_batches, text_or_empty, written
from lanewise.llm.files import contents, put
from lanewise.llm.tokens import default_path, encoder

MAGIC, END_ID, BLOCK = b"LWWM0001", 0, 64
#: Elements that are put back at once, few enough for a processor's cache; whole bytes of a plane.
PIECE = 1 << 16
#: Tokens after which a task begins its next shard, at the end of a document.
SHARD_TOKENS = 1 << 21


def _parted(now: np.ndarray, plane: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Elements whose bit in a plane is 0, and those whose is 1, in their order; Arrow's filter reads the bits as they are."""
    ones = pa.Array.from_buffers(pa.bool_(), len(now), [None, pa.py_buffer(np.ascontiguousarray(plane))])
    column = pa.array(now)
    return pc.filter(column, pc.invert(ones)).to_numpy(), pc.filter(column, ones).to_numpy()


class WaveletMatrix:
    """A sequence of small unsigned integers as bit-planes, with access, rank (counting) and select (occurrence lookup)."""

    def __init__(self, n: int, planes: Sequence[np.ndarray], zeros: list[int]):
        self.n, self.planes, self.zeros = n, planes, zeros
        self.before: list[np.ndarray | None] = [None] * len(planes)

    @classmethod
    def of(cls, values: np.ndarray, bits: int) -> WaveletMatrix:
        now = values.astype(np.uint16 if bits <= 16 else np.uint32)
        planes, zeros = [], []
        for level in range(bits - 1, -1, -1):
            if level == 7:
                now = now.astype(np.uint8)  # higher bits are on their planes
            ones = now & now.dtype.type(1 << level)
            planes.append(np.packbits(ones if level < 8 else ones != 0, bitorder="little"))
            if level:
                low, high = _parted(now, planes[-1])
                zeros.append(len(low))
                now = np.concatenate([low, high])
            else:  # nothing follows
                zeros.append(len(now) - int(np.count_nonzero(ones)))
        return cls(len(values), planes, zeros)

    def values(self) -> np.ndarray:
        """The whole sequence: the planes undone from the lowest upwards, in as few bytes as have bits by then."""
        lowest, *planes = reversed(self.planes)
        now = np.unpackbits(lowest, count=self.n, bitorder="little")
        for level, (plane, zero) in enumerate(zip(planes, reversed(self.zeros[:-1]), strict=True), 1):
            if level in (8, 16):
                now = now.astype(np.uint16 if level == 8 else np.uint32)
            now[zero:] |= now.dtype.type(1 << level)
            out = np.empty_like(now)
            low, high = 0, zero
            for a in range(0, self.n, PIECE):
                ones = np.unpackbits(plane[a // 8 : (a + PIECE) // 8], count=min(PIECE, self.n - a), bitorder="little").view(bool)
                ones, rest = np.flatnonzero(ones), np.flatnonzero(~ones)
                part = out[a : a + PIECE]
                part[rest], part[ones] = now[low : low + len(rest)], now[high : high + len(ones)]
                low, high = low + len(rest), high + len(ones)
            now = out
        return now.astype(np.uint16 if len(self.planes) <= 16 else np.uint32, copy=False)

    def _ones(self, level: int, i: int) -> int:
        """Ones of a plane before position i."""
        if self.before[level] is None:
            words = np.pad(self.planes[level], (0, -len(self.planes[level]) % BLOCK)).reshape(-1, BLOCK)
            self.before[level] = np.concatenate([[0], np.cumsum(np.bitwise_count(words).sum(axis=1, dtype=np.int64))])
        block = i // (8 * BLOCK)
        part = self.planes[level][block * BLOCK : i // 8]
        rest = int(self.planes[level][i // 8]) & ((1 << i % 8) - 1) if i % 8 else 0
        return int(self.before[level][block]) + int(np.bitwise_count(part).sum()) + rest.bit_count()

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(len(self.planes)):
            bit = self.planes[level][i // 8] >> i % 8 & 1
            ones = self._ones(level, i)
            value, i = value << 1 | int(bit), self.zeros[level] + ones if bit else i - ones
        return value

    def _down(self, value: int, i: int) -> tuple[int, int]:
        """Where the occurrences of value begin on the last level, and where those before position i end."""
        lo = 0
        for level in range(len(self.planes)):
            if value >> (len(self.planes) - 1 - level) & 1:
                lo, i = self.zeros[level] + self._ones(level, lo), self.zeros[level] + self._ones(level, i)
            else:
                lo, i = lo - self._ones(level, lo), i - self._ones(level, i)
        return lo, i

    def rank(self, value: int, i: int) -> int:
        """Occurrences of value before position i."""
        if value >> len(self.planes):
            return 0
        lo, hi = self._down(value, min(max(i, 0), self.n))
        return hi - lo

    def select(self, value: int, k: int) -> int:
        """Position of the k-th occurrence of value, from 0."""
        if not 0 <= k < self.rank(value, self.n):
            raise IndexError(k)
        at = self._down(value, self.n)[0] + k
        for level in range(len(self.planes) - 1, -1, -1):
            one = bool(value >> (len(self.planes) - 1 - level) & 1)
            want = at - self.zeros[level] if one else at
            lo, hi = 0, self.n  # the want-th bit of this kind, by bisection over ranks
            while hi - lo > 1:
                mid = (lo + hi) // 2
                ones = self._ones(level, mid)
                lo, hi = (mid, hi) if (ones if one else mid - ones) <= want else (lo, mid)
            at = lo
        return at


def dump(values: np.ndarray, bits: int, documents: list[tuple[int | None, int]]) -> bytes:
    """A shard file of the ids of (doc_id, n_tokens) documents in their order."""
    m = WaveletMatrix.of(values, bits)
    pack = zstandard.ZstdCompressor(level=1).compress
    head = json.dumps({"n": m.n, "bits": bits, "zeros": m.zeros, "doc_ids": [d for d, _ in documents], "lengths": [n for _, n in documents]}).encode()
    frames = [pack(head), *(pack(p.tobytes()) for p in m.planes)]
    return MAGIC + struct.pack(f"<{len(frames) + 1}I", len(frames), *map(len, frames)) + b"".join(frames)


def load(data: bytes) -> tuple[WaveletMatrix, list[tuple[int | None, int]]]:
    """The matrix and documents of a shard file; ValueError where it is none."""
    if data[:8] != MAGIC:
        raise ValueError("not a shard file")
    (count,) = struct.unpack_from("<I", data, 8)
    ends = 12 + 4 * count + np.cumsum([0, *struct.unpack_from(f"<{count}I", data, 12)])
    frame = lambda k: zstandard.ZstdDecompressor().decompress(data[int(ends[k]) : int(ends[k + 1])])
    head = json.loads(frame(0))
    return WaveletMatrix(head["n"], _Planes(head["bits"], lambda k: np.frombuffer(frame(k + 1), np.uint8)), head["zeros"]), list(zip(head["doc_ids"], head["lengths"], strict=True))


class _Planes(Sequence):
    """Bit-planes that are opened when they are first asked for."""

    def __init__(self, n: int, opened: Callable[[int], np.ndarray]):
        self.opened, self.kept = opened, [None] * n

    def __len__(self) -> int:
        return len(self.kept)

    def __getitem__(self, k: int) -> np.ndarray:
        k = range(len(self.kept))[k]
        if self.kept[k] is None:
            self.kept[k] = self.opened(k)
        return self.kept[k]


def _sharder(path: str, bits: int, folder: str, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path), np.uint32(END_ID).tobytes()
        part, size = None, 0
        ids: list[bytes] = []
        documents: list[tuple[int | None, int]] = []
        made: list[tuple[str, int, int, int]] = []

        def close() -> None:
            nonlocal ids, documents, size
            name = f"{part:08d}-{len(made):06d}.wm"
            put(f"{folder}/{name}", dump(np.frombuffer(b"".join(ids), "<u4"), bits, documents))
            made.append((name, part, len(made), sum(n for _, n in documents)))
            ids, documents, size = [], [], 0

        for b in batches:
            part = b.column("part")[0].as_py() if part is None and b.num_rows else part
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                one = encode(text) + end
                ids.append(one)
                documents.append((doc, len(one) // 4))
                size += len(one) // 4
                if size >= most:
                    close()
        if documents:
            close()
        columns = list(zip(*made, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["name", "part", "number", "tokens"])

    return run


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for name, content in zip(b.column("name").to_pylist(), b.column("content"), strict=True):
            matrix, documents = load(content.as_buffer())
            ids = matrix.values().astype("<u4")
            ends = np.cumsum([n for _, n in documents], dtype=np.int64)
            starts = ends - [n for _, n in documents]
            crc = [zlib.crc32(ids[s:e].tobytes()) for s, e in zip(starts, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(crc), pa.string()), pa.array([d for d, _ in documents], pa.int64()), pa.array(starts), pa.array(ends - starts), pa.array(crc, pa.int64())], ["name", "doc_id", "at", "n_tokens", "ids_crc32"])


def write_shards(docs: DataFrame, path: str | None = None, folder: str | None = None, shard_tokens: int = SHARD_TOKENS) -> tuple[str, DataFrame]:
    """Shards of docs(doc_id, text, ...) in ascending doc_id order; (folder, table of name, part, number, tokens).

    Documents are dealt by ranges of doc_id, nulls first, rows of one doc_id by
    their text; a range makes one shard after another. Null texts are empty.
    """
    spark = docs.sparkSession
    small_batches(spark)
    path, folder = path or default_path(), folder or new_path(spark, "shards")
    bits = max(1, (len(encoder(path).four) - 1).bit_length())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    ranges = max(rows.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    sorted_ = rows.repartitionByRange(ranges, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text").withColumn("part", F.spark_partition_id())
    return folder, written(sorted_.mapInArrow(_sharder(path, bits, folder, shard_tokens), "name string, part int, number int, tokens long"), "shards")


def shard_starts(shards: DataFrame) -> DataFrame:
    """name, start (tokens of all shards before it), tokens. Sums are over the shards of a range, then over ranges, one row for each."""
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda w: F.coalesce(F.sum("tokens").over(before(w)), F.lit(0))
    ranges = shards.groupBy("part").agg(F.sum("tokens").alias("tokens")).select("part", earlier(Window.orderBy("part")).alias("base"))
    within = shards.withColumn("at", earlier(Window.partitionBy("part").orderBy("number")))
    return within.join(ranges, "part").select("name", (F.col("base") + F.col("at")).alias("start"), "tokens")


def _named(spark: SparkSession, folder: str) -> DataFrame:
    """name, content of the shards in a folder."""
    return contents(spark, folder, "*.wm").select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")


def tokens_at(spark: SparkSession, folder: str, shards: DataFrame, positions: list[int]) -> DataFrame:
    """position, token for each of the positions, a stated set, among the tokens of all shards; none for one that is past the end.

    Only the shards that hold one of them are read, no more than there are positions.
    """
    asked = F.filter(F.array(*map(F.lit, sorted(set(positions)))).cast("array<long>"), lambda p: (p >= F.col("start")) & (p < F.col("start") + F.col("tokens")))
    here = {r.name: (r.start, r.asked) for r in shard_starts(shards).withColumn("asked", asked).where(F.size("asked") > 0).collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("name").to_pylist(), b.column("content"), strict=True):
                start, asked = here[name]
                matrix, _ = load(content.as_buffer())
                yield pa.RecordBatch.from_arrays([pa.array(asked, pa.int64()), pa.array([matrix.access(p - start) for p in asked], pa.int64())], ["position", "token"])

    if not here:
        return spark.createDataFrame([], "position long, token long")
    pattern = "{" + ",".join(sorted(here)) + "}"
    return contents(spark, folder, pattern).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content").mapInArrow(run, "position long, token long")


def token_counts(spark: SparkSession, folder: str, tokens: list[int]) -> DataFrame:
    """token, n: how often each of the tokens, a stated set, occurs in all shards of a folder, by rank."""
    wanted = sorted(set(tokens))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content"):
                matrix, _ = load(content.as_buffer())
                yield pa.RecordBatch.from_arrays([pa.array(wanted, pa.int64()), pa.array([matrix.rank(t, matrix.n) for t in wanted], pa.int64())], ["token", "n"])

    return _named(spark, folder).mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def occurrences(spark: SparkSession, folder: str, shards: DataFrame, token: int) -> DataFrame:
    """doc_id, position, place for each place of a token: its position among the tokens of all shards, by select, and its place in its document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("name").to_pylist(), b.column("content"), strict=True):
                matrix, documents = load(content.as_buffer())
                at = np.array([matrix.select(token, k) for k in range(matrix.rank(token, matrix.n))], np.int64)
                starts = np.cumsum([0, *(n for _, n in documents)])
                doc = np.searchsorted(starts, at, side="right") - 1
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array([documents[d][0] for d in doc], pa.int64()), pa.array(at), pa.array(at - starts[doc])], ["name", "doc_id", "at", "place"])

    found = _named(spark, folder).mapInArrow(run, "name string, doc_id long, at long, place long")
    return found.join(shard_starts(shards), "name").select("doc_id", (F.col("start") + F.col("at")).alias("position"), "place")


def read_back(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 for every row of docs, from shards written by write_shards."""
    spark = docs.sparkSession
    folder, shards = write_shards(docs, path)
    if shards.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    rows = _named(spark, folder).mapInArrow(_reader, "name string, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(shard_starts(shards), "name").select("doc_id", (F.col("start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
