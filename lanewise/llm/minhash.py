"""Near-duplicate documents by bottom-k sketches of one hash function.

1. A document's set of word shingles is hashed by one 64-bit function; its k
   smallest hashes are its sketch. Equal sets form a class at once, so that
   only one member of each class goes on.
2. Inverted lists of retained values give candidates. With at least ``t`` of
   similarity, of the k smallest hashes of the union a binomial share lies in
   both sketches; ``least_overlap`` is a count that this share misses with a
   probability under ``MISS`` (and the exact bound where sketches hold whole
   sets). Two sketches that share so many values share one of their rarest
   ``size - overlap + 1`` values, so only these enter lists, and passages that
   many documents share don't.
3. Candidates are first each list's members against one pivot of it. The union
   sketch (k smallest of both) estimates; full sets decide exactly.
4. Documents of lists that this leaves with more than one component are listed
   anew, by the rarest values of their full sets, for which the same bound is
   exact. Lists of up to ``SHORT`` entries give pairs of different components,
   which then are made distinct. Longer ones are compared
   in blocks of bounded size, block against block, on full sets, and each such
   comparison returns no more links than it has documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.llm.common import bit_filter, drop, may_hold, slot, small_batches, spread_join, utf8, written
from lanewise.llm.components import connected_components

WORDS, K, MISS = 5, 64, 1e-8
#: Lists in which a document meets a pivot in the first round.
STARS = 4
#: The longest list that is turned into pairs; documents and shingles of a block, at most about; columns of a dense slice.
SHORT, BLOCK_DOCS, BLOCK_SHINGLES, SLICE = 64, 512, 1 << 16, 4096


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a UTF-8 text, A-Z lower-cased.

    Words are runs of anything but ASCII space and \\x09-\\x0D. A text of fewer
    words gives one shingle of all of them, a text without words none.
    """
    found = text.lower().split()
    if not found:
        return np.empty(0, np.int64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    width = min(words, len(each))
    h = np.full(len(each) - width + 1, width, np.uint64)
    for i in range(width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + each[i : len(each) - width + 1 + i]
    return np.unique(_mixed(h).view(np.int64))


def least_overlap(percent: int, k: int, miss: float = MISS) -> int:
    """The largest c for which k draws with this chance of success give under c with probability < miss (Chernoff)."""
    t, best = percent / 100, 1
    for c in range(2, math.ceil(t * k)):
        p = (c - 1) / k
        if math.exp(-k * (p * math.log(p / t) + (1 - p) * math.log((1 - p) / (1 - t)))) < miss:
            best = c
    return best


def _sketcher(words: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, digest, sketch = [], [], []
            for text in b.column("text"):
                h = shingle_hashes(text.as_py(), words)
                n.append(len(h))
                digest.append(xxhash.xxh3_128_digest(h.tobytes()))
                sketch.append(h[:k])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sketch, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "digest", "sketch"])

    return run


def _whole_sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_hashes(x.as_py(), words) for x in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))], ["id", "shingles"])

    return run


def _block_links(percent: int):
    """Of one block against another, or of a block within itself: links that connect what its links connect."""

    def run(t: pa.Table) -> pa.Table:
        x, y = t.column("x")[0].as_py(), t.column("y")[0].as_py()
        own, rep, c = (t.column(n).to_numpy() for n in ("own", "rep", "c"))
        shingles = t.column("shingles").combine_chunks()
        n = np.diff(shingles.offsets.to_numpy())
        row = np.repeat(np.arange(len(n)), n)
        values, column, df = np.unique(shingles.values.to_numpy()[shingles.offsets[0].as_py() : shingles.offsets[-1].as_py()], return_inverse=True, return_counts=True)
        keep = df[column] > 1
        order = np.argsort(column[keep], kind="stable")
        row, column = row[keep][order], np.unique(column[keep][order], return_inverse=True)[1]
        left = np.flatnonzero(own == x)
        right = left if x == y else np.flatnonzero(own == y)
        common = np.zeros((len(left), len(right)), np.float32)
        cuts = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + SLICE, SLICE))
        for i, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
            part = np.zeros((len(n), SLICE), np.float32)
            part[row[lo:hi], column[lo:hi] - i * SLICE] = 1
            common += part[left] @ part[right].T
        common = common.astype(np.int64)
        linked = (100 * common >= percent * (n[left][:, None] + n[right][None, :] - common)) & (c[left][:, None] != c[right][None, :])
        # breadth first over the two sides; each document is reached once, from one that it links with
        src, dst = [], []
        sides, seen = (left, right), (np.zeros(len(left), bool), np.zeros(len(right), bool))
        for start in np.flatnonzero(linked.any(axis=1)):
            if seen[0][start]:
                continue
            seen[0][start] = True
            side, front = 0, np.array([start])
            while len(front):
                step = linked[front] if side == 0 else linked[:, front].T
                new = np.flatnonzero(step.any(axis=0) & ~seen[1 - side])
                src.append(sides[side][front[step[:, new].argmax(axis=0)]])
                dst.append(sides[1 - side][new])
                seen[1 - side][new] = True
                side, front = 1 - side, new
        src, dst = (rep[np.concatenate(z)] if z else np.empty(0, np.int64) for z in (src, dst))
        return pa.table({"src": np.minimum(src, dst), "dst": np.maximum(src, dst)})

    return run


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs whose id is among ids, without a shuffle of all texts: a filter of bounded size goes first, and what it lets through by accident the semi join takes out."""
    sent = bit_filter(ids.select(slot("doc_id").alias("s")))
    return docs.where(may_hold(sent, slot("doc_id"))).join(ids, "doc_id", "left_semi")


def near_pairs(docs: DataFrame, percent: int = 85, words: int = WORDS, k: int = K) -> tuple[DataFrame, DataFrame]:
    """(members, links) of docs(doc_id, text): classes of equal shingle sets, and links between classes.

    members: doc_id, n_shingles, rep (the class's smallest doc_id; null for
    documents without words), one row per row of docs. links: src, dst, two
    reps with 100 * |intersection| >= percent * |union|, enough of them to
    connect whatever is connected. Rows of one doc_id count as one document;
    rows with a null doc_id or a null or empty text link with nothing.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text"))
    each = written(texts.mapInArrow(_sketcher(words, k), "doc_id long, n_shingles long, digest binary, sketch array<long>"), "sketches")
    linked = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    full = each.where(linked)
    reps = written(full.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"), F.count(F.lit(1)).alias("rows")), "classes")
    several_rows = reps.where("rows > 1").select("digest", "rep", "rows")
    rows = full.select("doc_id", "n_shingles", "digest")
    members = spread_join(rows, several_rows, "digest", "rows", rows.count(), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep"))
    members = members.union(each.where(~linked).select("doc_id", "n_shingles", F.lit(None).cast("long")))

    few = least_overlap(percent, k)
    overlap = F.when(F.col("n") * percent <= k * percent * percent // 100, F.ceil(F.col("n") * percent / 100)).otherwise(F.lit(few))
    total = reps.agg(F.sum(F.size("sketch"))).first()[0] or 0
    values = reps.select("rep", "n", F.explode("sketch").alias("v"))
    shared = values.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    ranked = spread_join(values, shared, "v", "df", total, "rep").groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("p"))
    room = F.least(F.col("n"), F.lit(k)) - overlap + 1 - (F.least(F.col("n"), F.lit(k)) - F.size("p"))
    prefixes = written(ranked.withColumn("room", room.cast("int")).where("room > 0").select("rep", "n", F.expr("transform(slice(p, 1, greatest(room, 0)), x -> x.v)").alias("p")), "prefixes")
    sets = written(_texts_of(texts, prefixes.select(F.col("rep").alias("doc_id"))).mapInArrow(_whole_sets(words), "id long, shingles array<long>").dropDuplicates(["id"]), "sets")

    def sizes(a: str, b: str) -> Column:
        return (100 * F.least(a, b) >= percent * F.greatest(a, b))

    def verified(pairs: DataFrame) -> DataFrame:
        of = lambda c: reps.select(F.col("rep").alias(c), F.col("sketch").alias(f"{c}_sketch"))
        union = F.slice(F.array_sort(F.array_union("src_sketch", "dst_sketch")), 1, k)
        seen = pairs.join(of("dst"), "dst").join(of("src"), "src").withColumn("u", union)
        seen = seen.withColumn("x", F.size(F.array_intersect(F.array_intersect("u", "src_sketch"), "dst_sketch")))
        likely = seen.where(F.when(F.size("u") < k, 100 * F.col("x") >= percent * F.size("u")).otherwise(F.col("x") >= few)).select("src", "dst")
        of = lambda c: sets.select(F.col("id").alias(c), F.col("shingles").alias(f"{c}_set"))
        both = likely.join(of("dst"), "dst").join(of("src"), "src")
        both = both.select("src", "dst", F.size(F.array_intersect("src_set", "dst_set")).alias("i"), (F.size("src_set") + F.size("dst_set")).alias("s"))
        return both.where(100 * F.col("i") >= percent * (F.col("s") - F.col("i"))).select("src", "dst")

    listed = prefixes.select("rep", "n", F.explode(F.slice(F.reverse("p"), 1, STARS)).alias("v"))
    pivots = listed.groupBy("v").agg(F.min_by(F.struct("rep", "n"), F.xxhash64("rep", "v")).alias("q"), F.count(F.lit(1)).alias("c")).where("c > 1")
    sums = prefixes.agg(F.sum(F.least(F.size("p"), F.lit(STARS))).alias("listed"), F.sum(F.size("p")).alias("all")).first()
    first = spread_join(listed, pivots, "v", "c", sums["listed"] or 0, "rep").where((F.col("rep") != F.col("q.rep")) & sizes("n", "q.n"))
    first = first.select(F.least("rep", "q.rep").alias("src"), F.greatest("rep", "q.rep").alias("dst")).distinct()
    links = written(verified(first), "links")

    joined = connected_components(links)
    component = joined.withColumnRenamed("id", "rep")
    entries = prefixes.select("rep", F.explode("p").alias("v")).join(component, "rep", "left").select("rep", "v", F.coalesce("component", "rep").alias("c"))
    several = lambda e: e.groupBy("v").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("m"), F.sum("n").alias("s")).where("lo < hi").drop("lo", "hi")
    open_ = spread_join(entries, several(entries.withColumn("n", F.lit(0))).select("v", "m"), "v", "m", sums["all"] or 0, "rep").select("rep", "c").distinct()
    open_ = written(open_.join(sets, F.col("rep") == F.col("id")).select("rep", "c", F.size("shingles").alias("n"), "shingles"), "open")
    values = open_.select("rep", "c", "n", F.explode("shingles").alias("v"))
    shared = values.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    ranked = spread_join(values, shared, "v", "df", open_.agg(F.sum("n")).first()[0] or 0, "rep").groupBy("rep", "c", "n").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("p"))
    room = F.size("p") - F.ceil(F.col("n") * percent / 100) + 1
    lists = written(ranked.withColumn("room", room.cast("int")).where("room > 0").select("rep", "c", "n", F.expr("transform(slice(p, 1, greatest(room, 0)), x -> x.v)").alias("p")), "lists")
    entries = lists.select("rep", "c", "n", F.explode("p").alias("v"))
    entries = written(spread_join(entries, several(entries), "v", "m", lists.agg(F.sum(F.size("p"))).first()[0] or 0, "rep"), "entries")

    short = entries.where(F.col("m") <= SHORT)
    a, b = (short.select("v", *(F.col(x).alias(f"{side}_{x}") for x in ("rep", "n", "c"))) for side in "ab")
    rest = a.join(b, "v").where((F.col("a_c") < F.col("b_c")) & sizes("a_n", "b_n"))
    rest = written(rest.select(F.least("a_rep", "b_rep").alias("src"), F.greatest("a_rep", "b_rep").alias("dst")).distinct(), "pairs")

    blocks = F.greatest(F.ceil(F.col("m") / BLOCK_DOCS), F.ceil(F.col("s") / BLOCK_SHINGLES)).cast("int")
    long = entries.where(F.col("m") > SHORT).select("rep", "v", blocks.alias("k"))
    long = long.withColumn("own", F.pmod(F.xxhash64("rep"), "k").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    long = long.join(open_.select("rep", "c", "shingles"), "rep").select("v", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "rep", "c", "shingles")
    dense = long.groupBy("v", "x", "y").applyInArrow(_block_links(percent), "src long, dst long").distinct()
    found = written(verified(rest).union(dense).union(links), "links")
    drop(prefixes, sets, links, open_, lists, entries, rest)
    return members, found


def near_duplicates(docs: DataFrame, percent: int = 85, words: int = WORDS, k: int = K) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs(doc_id, text, ...).

    component_id is the smallest doc_id reachable through links of near_pairs,
    the document's own where it has none; kept says that it is the document's
    own. Other columns of docs are ignored. A null doc_id stays a row of its
    own with a null component_id, kept.
    """
    members, links = near_pairs(docs, percent, words, k)
    roots = connected_components(links)
    out = members.join(roots.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component_id", F.coalesce("component", "rep", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def without_near_duplicates(docs: DataFrame, percent: int = 80, words: int = WORDS, k: int = K) -> DataFrame:
    """Of each component of near_duplicates the rows of its smallest doc_id, with all columns of docs.

    Rows with a null doc_id stay, and so do all rows that share a kept doc_id.
    """
    gone = near_duplicates(docs.select("doc_id", "text"), percent, words, k).where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col("__gone"), "left_anti").select(*(docs[c] for c in docs.columns))
