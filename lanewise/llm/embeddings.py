"""Near-duplicate embeddings by a subspace pigeonhole join.

Unit vectors with cosine >= t lie within d2 = 2 - 2t of squared distance.
Vectors are rotated to the principal axes of a bounded sample, which go in turn
to BLOCKS subspaces; if the squared distances within all subspaces add up to d2
or less, one of them is at most d2 / BLOCKS. So each subspace is range-joined
under that budget: its leading coordinate is cut into slabs as wide as the
budget's radius, and a vector meets its own slab and the next. A slab is
compared in parts of bounded size, part against part; what lies within the
subspace's budget is verified by cosine in double precision and counted in the
first subspace that admits it. Equal vectors form a class at once. Each
comparison returns sums of links and a spanning set of them, never pairs by
the square.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.llm.common import drop, small_batches, spread_join, written
from lanewise.llm.components import connected_components

#: Subspaces, vectors of a part, rows compared at once, and vectors of the sample that sets the axes.
BLOCKS, PART, ROWS, SAMPLE = 4, 16384, 1024, 4096
#: Added to every budget, so that rounding in the rotation never loses a pair; and to those of the first, single-precision pass.
SLACK, LOOSE = 1e-6, 1e-4


def _axes(sample: np.ndarray) -> np.ndarray:
    """Principal axes of unit vectors as columns, widest first, dealt in turn so that every subspace begins with a wide one."""
    n = sample.shape[1]
    axes = np.linalg.eigh(sample.T @ sample + 1e-12 * np.eye(n))[1][:, ::-1]
    return np.ascontiguousarray(axes[:, [i for j in range(BLOCKS) for i in range(j, n, BLOCKS)]])


def _budget(least: float) -> float:
    return (2 - 2 * least) / BLOCKS + SLACK


def _splits(n: int) -> list[slice]:
    sizes = [len(range(j, n, BLOCKS)) for j in range(BLOCKS)]
    edges = [0, *itertools.accumulate(sizes)]
    return [slice(a, b) for a, b in itertools.pairwise(edges)]


def _units(column: pa.Array | pa.ChunkedArray, n: int) -> np.ndarray:
    """Unit vectors in double precision of lists of n numbers."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    v = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # so that no square overflows or vanishes
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _turned(unit: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Coordinates by the axes; without BLAS, so that a row's digits don't depend on the rows beside it."""
    return np.einsum("ij,jk->ik", unit, axes, optimize=False)


def _cells(least: float, axes: dict[int, np.ndarray]):
    """row -> (cell, home): a vector at home in its slab of each subspace, and a guest in the next."""
    width = np.sqrt(_budget(least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = b.column("v").value_lengths().to_numpy(zero_copy_only=False)
            for n in np.unique(lengths):
                at = pa.array(np.flatnonzero(lengths == n))
                rows = b.take(at)
                turned = _turned(_units(rows.column("v"), int(n)), axes[int(n)])
                for j, s in enumerate(_splits(int(n))):
                    if s.start == s.stop:
                        continue
                    slab = np.floor(turned[:, s.start] / width).astype(np.int64)
                    for step in (0, 1):
                        key = [f"{n}:{j}:{k}" for k in (slab + step).tolist()]
                        yield pa.RecordBatch.from_arrays([rows.column("cid"), pa.array(key, pa.string()), pa.array([step == 0] * len(key))], ["cid", "cell", "home"])

    return run


def _links(least: float, axes: dict[int, np.ndarray]):
    def run(t: pa.Table) -> pa.Table:
        ids, mult, own, home = (t.column(n).to_numpy() for n in ("cid", "mult", "own", "home"))
        x, y = t.column("x")[0].as_py(), t.column("y")[0].as_py()
        n, block = map(int, t.column("cell")[0].as_py().split(":")[:2])
        unit = _units(t.column("v"), n)
        turned = _turned(unit, axes[n])
        splits, budget = _splits(n), _budget(least)
        part = turned[:, splits[block]].astype(np.float32)
        half = (part.astype(np.float64) ** 2).sum(axis=1, keepdims=True).astype(np.float32) / 2
        one = np.ones_like(half)
        rows, columns = np.hstack([part, -half, one]), np.hstack([part, one, -half])  # their product is minus half of the squared distance
        left = np.flatnonzero(home & (own == x))  # at least one of a pair is at home
        right = left if x == y else np.flatnonzero(home & (own == y))
        guests = np.flatnonzero(~home & (own == y))
        more = np.flatnonzero(~home & (own == x)) if x != y else np.empty(0, np.int64)
        count = np.zeros(len(ids), np.int64)
        src, dst = [], []
        for a, b, same in ((left, right, x == y), (left, guests, False), (right, more, False)):
            to = np.ascontiguousarray(columns[b].T)
            for lo in range(0, len(a) if len(b) else 0, ROWS):
                some = a[lo : lo + ROWS]
                near = rows[some] @ to >= -(budget + LOOSE) / 2
                at = np.flatnonzero(near)
                i, j = at // len(b), at % len(b)
                if same:
                    i, j = i[j > i + lo], j[j > i + lo]
                kept = [np.empty(0, np.int64)] * 2
                for c in range(0, len(i), 1 << 16):
                    k, m = i[c : c + (1 << 16)], j[c : c + (1 << 16)]
                    ok = (unit[some[k]] * unit[b[m]]).sum(axis=1) >= least
                    k, m = k[ok], m[ok]
                    square = (turned[some[k]] - turned[b[m]]) ** 2
                    admits = np.stack([square[:, s].sum(axis=1) <= budget for s in splits], axis=1)
                    first = admits.argmax(axis=1) == block  # counted in no other subspace
                    kept = [np.concatenate([kept[0], k[first]]), np.concatenate([kept[1], m[first]])]
                if not len(kept[0]):
                    continue
                np.add.at(count, some[kept[0]], mult[b[kept[1]]])
                np.add.at(count, b[kept[1]], mult[some[kept[0]]])
                linked = np.zeros((len(some), len(b)), bool)
                linked[kept[0], kept[1]] = True
                for r, c in _spanning(linked):
                    src.append(ids[some[r]])
                    dst.append(ids[b[c]])
        found = np.flatnonzero(count)
        total = np.concatenate([count[found], np.zeros(len(src), np.int64)])
        return pa.table({"cid": np.concatenate([ids[found], np.array(src, np.int64)]), "to": pa.array([None] * len(found) + dst, pa.int64()), "n": total})

    return run


def _spanning(linked: np.ndarray) -> list[tuple[int, int]]:
    """Links (row, column) that connect what all links connect, fewer than rows and columns together."""
    out: list[tuple[int, int]] = []
    seen_r, seen_c = np.zeros(linked.shape[0], bool), np.zeros(linked.shape[1], bool)
    for start in np.flatnonzero(linked.any(axis=1)):
        if seen_r[start]:
            continue
        seen_r[start] = True
        rows = np.array([start])
        while len(rows):
            step = linked[rows]
            cols = np.flatnonzero(step.any(axis=0) & ~seen_c)
            if not len(cols):
                break
            seen_c[cols] = True
            out += zip(rows[step[:, cols].argmax(axis=0)].tolist(), cols.tolist(), strict=True)
            step = linked[:, cols].T
            new = np.flatnonzero(step.any(axis=0) & ~seen_r)
            out += zip(new.tolist(), cols[step[:, new].argmax(axis=0)].tolist(), strict=True)
            seen_r[new] = True
            rows = new
    return out


def near_embeddings(vectors: DataFrame, least: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors(vec_id, embedding, ...).

    Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing and are components of their own, nor do vectors of unlike
    lengths link. Equal vectors link like any others. Rows that share a vec_id
    count as vectors of their own in n_links and as one node in components. A
    row with a null vec_id links with nothing. An empty table gives an empty
    result. Exact, and of no better order than the pairs of a slab.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    kind = vectors.schema["embedding"].dataType.simpleString()
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    all_ = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("v"))
    finite = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False)) & F.col("vec_id").isNotNull()
    rows = all_.where(finite).select(F.col("vec_id").alias("id"), "v")
    classes = written(rows.groupBy("v").agg(F.count(F.lit(1)).alias("mult"), F.min("id").alias("least")).withColumn("cid", F.monotonically_increasing_id()), "vectors")
    total = classes.agg(F.sum("mult")).first()[0] or 0
    members = written(spread_join(rows, classes.select("v", "cid", "mult"), "v", "mult", total, "id").select("id", "cid"), "members")
    axes = {}
    for n in [r[0] for r in classes.groupBy(F.size("v")).count().collect()]:  # one for each length of vectors
        of = classes.where(F.size("v") == n)
        few = of.where(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < F.lit(int(min(1.0, SAMPLE / max(of.count(), 1)) * (1 << 30)))).select("v").toArrow()
        axes[n] = _axes(_units(few.column("v"), n)) if few.num_rows else np.eye(n)[:, [i for j in range(BLOCKS) for i in range(j, n, BLOCKS)]]
    cells = written(classes.select("cid", "v").mapInArrow(_cells(least, axes), "cid long, cell string, home boolean"), "cells")
    sizes = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("m"), F.sum(F.col("home").cast("int")).alias("h")).where("m > 1 and h > 0")
    placed = spread_join(cells, sizes.select("cell", "m", F.ceil(F.col("m") / PART).cast("int").alias("k")), "cell", "m", cells.count(), "cid").withColumn("own", F.pmod(F.xxhash64("cid"), "k").cast("int"))
    placed = placed.join(classes, "cid").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    parts = placed.select("cell", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "home", "cid", "mult", "v")
    found = written(parts.groupBy("cell", "x", "y").applyInArrow(_links(least, axes), "cid long, to long, n long"), "links")
    counts = found.groupBy("cid").agg(F.sum("n").alias("linked"))
    once = members.distinct()
    shared = once.groupBy("id").agg(F.min("cid").alias("src"), F.count(F.lit(1)).alias("n")).where("n > 1")
    same_id = spread_join(once, shared, "id", "n", total, "cid").select("src", F.col("cid").alias("dst"))
    edges = found.where("to is not null").select(F.col("cid").alias("src"), F.col("to").alias("dst")).union(same_id)
    # classes first, then the rows of each
    joined = classes.select("cid", "mult", "least").join(connected_components(edges).withColumnRenamed("id", "cid"), "cid", "left").join(counts, "cid", "left")
    joined = written(joined.select("cid", "mult", "least", F.coalesce("component", "cid").alias("root"), (F.coalesce("linked", F.lit(0)) + F.col("mult") - 1).alias("n_links")), "joined")
    roots = joined.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    each = spread_join(joined, roots, "root", "n", joined.count(), "cid").select("cid", "mult", "n_links", "component_id")
    out = spread_join(members, each, "cid", "mult", total, "id").select(F.col("id").alias("vec_id"), "n_links", "component_id")
    drop(cells, found)
    out = out.union(all_.where(~finite).select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
