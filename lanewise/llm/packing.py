"""Best-fit packing of token pieces into sequences by linear grouping.

What is to be packed is known by its histogram: lengths are whole numbers up
to the capacity, so however many documents there are, the driver sees at most
``capacity`` counts. Pieces as long as the capacity are sequences by
themselves. Other lengths over a share of the capacity are put into groups of
equal cardinality and rounded up to the largest of their group; the linear
programme over configurations of these few sizes is solved by column
generation (a revised simplex priced by an integer knapsack) and rounded down;
actual lengths take the places of the rounded ones, each place the longest that
fits beside the rounded sizes still to come; what is left goes in by best fit,
longest first. This is done for each share in LARGE, and the plan of the fewest
sequences stands. A plan is a list of intervals "pieces number lo to lo + n of
this length go to these sequences", which the executors apply by each piece's
rank among those of its length.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanewise.llm.common import small_batches, text_or_empty, written
from lanewise.llm.tokens import default_path, encoder

CAPACITY, END_ID, GROUPS, GAP = 1024, 2, 128, 1e-3
#: Lengths over these parts of the capacity are large: grouped, rounded and placed by configurations (over a half, of one large piece each).
LARGE = 4, 3, 2


@dataclass
class Plan:
    """Rows (length, lo, n, per, first, offset): pieces lo..lo+n-1 of a length, per of them to a sequence from number first on, from offset on; pieces that configurations placed."""

    rows: np.ndarray
    sequences: int
    grouped: int = 0


class _Packer:
    def __init__(self, counts: np.ndarray, capacity: int):
        self.capacity, self.left, self.next = capacity, counts.astype(np.int64).copy(), np.zeros(len(counts), np.int64)
        self.rows: list[tuple[int, ...]] = []
        self.free: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> runs of sequences (first, how many)
        self.sequences = 0

    def new(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n

    def put(self, length: int, n: int, per: int, first: int, offset: int) -> None:
        self.rows.append((length, int(self.next[length]), n, per, first, offset))
        self.next[length] += n
        self.left[length] -= n

    def configurations(self, groups: int, part: int) -> int:
        """The part by linear grouping: how many pieces it places."""
        whole, before = self.capacity, int(self.left.sum())
        if n := int(self.left[whole]):
            self.put(whole, n, 1, self.new(n), 0)
        least = whole // part + 1
        sizes = np.flatnonzero(self.left[least:])[::-1] + least
        upto = np.cumsum(self.left[sizes])
        if not len(sizes):
            return before - int(self.left.sum())
        groups = min(groups, int(upto[-1]))
        edges = np.arange(groups + 1) * int(upto[-1]) // groups
        longest = sizes[np.searchsorted(upto, edges[:-1], side="right")]
        rounded, of = np.unique(longest, return_inverse=True)  # groups that round to one size count as one
        demand = np.bincount(of, weights=np.diff(edges))
        for pattern, amount in sorted(_column_generation(rounded, demand, whole), key=lambda x: -int(x[0] @ rounded)):
            if copies := int(amount + 1e-9):
                self._substitute(np.repeat(rounded, pattern)[::-1].tolist(), copies, least)
        return before - int(self.left.sum())

    def _substitute(self, places: list[int], copies: int, least: int) -> None:
        """Actual lengths in the places of ``copies`` sequences of one configuration: each the longest for which there is room."""
        runs = [(self.new(copies), copies, 0)]  # alike sequences: first, how many, filled
        to_come = sum(places)
        for place in places:
            to_come -= place
            after = []
            for b, n, filled in runs:
                room = self.capacity - filled - to_come
                while n:
                    fits = np.flatnonzero(self.left[least : room + 1])
                    if not len(fits):
                        after.append((b, n, filled))
                        break
                    length = least + int(fits[-1])
                    take = min(n, int(self.left[length]))
                    self.put(length, take, 1, b, filled)
                    after.append((b, take, filled + length))
                    b, n = b + take, n - take
            runs = after
        for b, n, filled in runs:
            self.free[self.capacity - filled].append((b, n))

    def best_fit(self) -> None:
        """All that is left, longest first, each where it leaves the least room."""
        for x in range(self.capacity, 0, -1):
            while c := int(self.left[x]):
                room = min((r for r, runs in self.free.items() if r >= x and runs), default=None)
                if room is None:
                    per = self.capacity // x
                    n = -(-c // per)
                    room = self.capacity
                    self.free[room].append((self.new(n), n))
                b, n = self.free[room].pop()
                per = room // x
                if full := min(n, c // per):
                    self.put(x, full * per, per, b, self.capacity - room)
                    self.free[room - per * x].append((b, full))
                    if n > full:
                        self.free[room].append((b + full, n - full))
                else:
                    self.put(x, c, c, b, self.capacity - room)
                    self.free[room - c * x].append((b, 1))
                    if n > 1:
                        self.free[room].append((b + 1, n - 1))


def _knapsack(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes within the capacity."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(sizes)
    s, v = sizes[order], values[order]
    for room in range(int(s[0]), capacity + 1):
        k = int(np.searchsorted(s, room, side="right"))
        got = best[room - s[:k]] + v[:k]
        i = int(np.argmax(got))
        best[room], choice[room] = (got[i], i) if got[i] > best[room - 1] else (best[room - 1], -1)
    pattern, room = np.zeros(len(sizes), np.int64), capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
            continue
        pattern[order[choice[room]]] += 1
        room -= int(s[choice[room]])
    return float(best[capacity]), pattern


def _column_generation(sizes: np.ndarray, demand: np.ndarray, capacity: int, most: int = 2000) -> list[tuple[np.ndarray, float]]:
    """A basic optimal solution of: least number of patterns that cover the demand.

    The basis is inverted by pinv: inv (threaded LU) was seen to hang in a driver beside its JVM from 128 sizes on.
    """
    m = len(sizes)
    basis = np.diag(np.maximum(1, capacity // sizes)).astype(np.float64)
    inverse = np.linalg.pinv(basis)
    x = inverse @ demand
    for step in range(most):
        if step % 50 == 49:
            inverse = np.linalg.pinv(basis)
            x = inverse @ demand
        duals = inverse.sum(axis=0)
        value, pattern = _knapsack(sizes, np.maximum(duals, 0), capacity)
        if value <= 1 + GAP:  # within this share of the least number
            break
        way = inverse @ pattern
        rises = way > 1e-9
        if not rises.any():
            break
        ratio = np.where(rises, x / np.where(rises, way, 1), np.inf)
        leave = int(np.argmin(ratio))
        basis[:, leave] = pattern
        pivot = inverse[leave] / way[leave]
        inverse = inverse - np.outer(way, pivot)
        inverse[leave] = pivot
        amount = ratio[leave]
        x = x - amount * way
        x[leave] = amount
    return [(np.round(basis[:, i]).astype(np.int64), max(0.0, x[i])) for i in range(m)]


def plan(counts: np.ndarray, capacity: int = CAPACITY, groups: int = GROUPS) -> Plan:
    """The placement of counts[length] pieces of each length 1..capacity: the best of linear grouping by the shares in LARGE."""
    best = None
    for part in LARGE:
        p = _Packer(counts, capacity)
        grouped = p.configurations(groups, part)
        p.best_fit()
        used = _renumbered(p, grouped)
        if best is None or used.sequences < best.sequences:
            best = used
    return best


def _renumbered(p: _Packer, grouped: int) -> Plan:
    """Without sequences that stayed empty."""
    empty = sorted((b, n) for b, n in p.free.get(p.capacity, []))
    rows = np.array(p.rows, np.int64).reshape(-1, 6)
    if empty:
        starts = np.array([b for b, _ in empty])
        gone = np.concatenate([[0], np.cumsum([n for _, n in empty])])
        rows[:, 4] -= gone[np.searchsorted(starts, rows[:, 4], side="right")]
    return Plan(rows[np.lexsort((rows[:, 1], rows[:, 0]))], p.sequences - sum(n for _, n in empty), grouped)


def _cut(path: str, capacity: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, part = encoder(path), np.uint32(END_ID).tobytes(), TaskContext.get().partitionId()
        ranks = [0] * (capacity + 1)
        for b in batches:
            rows: list[tuple] = []
            for i, (doc, text) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True)):
                ids = encode(text) + end
                n = len(ids) // 4
                start = 0
                for k in range(-(-n // capacity)):
                    length = n - start if k else (n - 1) % capacity + 1
                    length = min(length, capacity)
                    piece = ids[4 * start : 4 * (start + length)]
                    rows.append((doc, k, start, length, zlib.crc32(piece), ranks[length], piece if keep_ids else None))
                    ranks[length] += 1
                    start += length
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            arrays = [pa.array(x, k) for x, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([part] * len(rows), pa.int32())], ["doc_id", "piece", "start", "length", "ids_crc32", "rank", "ids", "part"])

    return run


def _placed(rows: np.ndarray):
    key = rows[:, 0] << 44 | rows[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            r = rows[np.searchsorted(key, length << 44 | rank, side="right") - 1] if len(rows) else np.zeros((0, 6), np.int64)
            nth = rank - r[:, 1]
            out = {n: b.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
            out |= {"sequence_id": pa.array(r[:, 4] + nth // np.maximum(r[:, 3], 1)), "offset": pa.array(r[:, 5] + nth % np.maximum(r[:, 3], 1) * length)}
            yield pa.RecordBatch.from_pydict(out)

    return run


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of docs(doc_id, text, ...).

    A document's ids are those of its text (null: empty) and END_ID, so that
    empty texts make a piece of one id. Documents of over ``capacity`` ids are
    cut into pieces of that length, the first of which may be shorter. doc_id
    may be null or repeated: every row is packed. An empty table gives no
    pieces. Other columns are ignored. keep_ids adds each piece's ids as bytes.
    """
    small_batches(docs.sparkSession)
    path = path or default_path()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, rank long, ids binary, part int"
    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(_cut(path, capacity, keep_ids), schema)
    pieces = written(pieces, "pieces")
    each = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for r in each.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` rows
        counts[r.length] = r.n
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = each.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(base, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("base"))
    out = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "ids", "rank").mapInArrow(_placed(plan(counts, capacity).rows), "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, sequence_id long, offset long")
    return out if keep_ids else out.drop("ids")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids (bytes of little-endian unsigned 32-bit ids), doc_ids and starts of the pieces, from pack_documents(keep_ids=True).

    A sequence has at most ``capacity`` ids, which bounds its group.
    """
    listed = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "ids"))).alias("p"))
    joined = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return listed.select("sequence_id", joined.alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.offset").alias("starts"))
