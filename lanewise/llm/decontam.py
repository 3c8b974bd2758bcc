"""Benchmark decontamination by latent semantic retrieval.

Passages become TF-IDF rows over the words of the benchmark (document
frequencies counted over the halves of all passages). A randomised SVD of all
passages of the corpus and of the benchmark, whose products with the row matrix
are distributed sums, gives one latent space of RANK dimensions, far fewer than
rows. Every passage of every document is projected
and compared by cosine with every benchmark passage, the stated query set.
Candidates are those over the threshold whose surroundings hold enough words of
the item; and, as an exact second way, all that share so many words with a
passage that the common subsequence can be long enough, whatever their cosine.
They are decided on the texts: longest common subsequence of words against the
item's length, and the same for its answer, the last part of the item.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.llm.common import drop, small_batches, utf8, written

#: Words of half a passage; a passage is two halves, and every half begins one.
HALF = 32
#: Dimensions of the latent space, further ones while it is sought, and power steps.
RANK, OVERSAMPLED, POWERS = 128, 16, 2
COSINE, LCS, ANSWER = 0.5, 0.7, 0.6
#: The part of an item that counts as its answer.
ANSWER_PART = 4
#: Benchmark items of one pass over the corpus and passages of a block of them; halves of text and bytes of words at once: bounds of memory, without effect on what is found.
ITEMS_AT_ONCE, PASSAGES_AT_ONCE, HALVES_AT_ONCE, BYTES_AT_ONCE = 20_000, 256, 1024, 1 << 20
#: Halves of a row of encoded halves, and rows that are multiplied at once.
FEW, ROWS_AT_ONCE = 255, 16
#: Words, the most frequent ones of these rows, that are multiplied as dense columns: a matter of speed.
DENSE = 128
ENCODED = "half binary, word binary, here binary, after binary, begins binary, counts binary"
RESULT = "doc_id long, item_id long, cosine double, lcs double, answer double, first_word long, end_word long"

AS_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters (lower-cased), digits and non-ASCII bytes."""
    return text.translate(AS_WORDS).split()


def word_ids(text: bytes, vocabulary: dict[bytes, int]) -> np.ndarray:
    """Ids of the words of a text, -1 where not in the vocabulary; a stretch at a time, so that long texts need no list of all their words."""
    plain, at, out = text.translate(AS_WORDS), 0, []
    while at < len(plain):
        end = plain.find(b" ", at + BYTES_AT_ONCE)
        words = plain[at : end if end >= 0 else len(plain)].split()
        out.append(np.fromiter(map(vocabulary.get, words, repeat(-1)), np.int32, len(words)))
        at = end if end >= 0 else len(plain)
    return np.concatenate(out) if out else np.empty(0, np.int32)


def longest_common(item: list[int], region: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel over the item."""
    masks: dict[int, int] = defaultdict(int)
    for i, w in enumerate(item):
        masks[w] |= 1 << i
    full = (1 << len(item)) - 1
    v = full
    for w in region:
        if m := masks.get(w):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(item) - v.bit_count()


def _halves(batch: pa.RecordBatch, vocabulary: dict[bytes, int]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Word ids of each text (-1: not in the vocabulary), and where they are placed."""
    ids = [word_ids(text, vocabulary) for text in batch.column("text").to_pylist()]
    return ids, *_placed(ids)


def _placed(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all known words their half and id; the first half of each text, with an empty one after each."""
    before = np.concatenate([[0], np.cumsum([-(-len(x) // HALF) + 1 for x in ids])]).astype(np.int64)
    at = [np.flatnonzero(x >= 0) for x in ids]
    half = np.concatenate([before[i] + a // HALF for i, a in enumerate(at)]) if at else np.empty(0, np.int64)
    word = np.concatenate([x[a] for x, a in zip(ids, at, strict=True)]) if at else np.empty(0, np.int32)
    return half.astype(np.int64), word.astype(np.int32), before


def _encoded(half: np.ndarray, word: np.ndarray, before: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of FEW halves and the known words of these and of the half after them, as bytes.

    Of each word its half and id and how often that half and the next one hold
    it; of each half whether a passage begins with it. To counts are added the
    halves that hold each word and, in the last two places, all halves and the
    passages with a known word.
    """
    width, last = len(counts) - 2, int(before[-1])
    begins, known = np.ones(last, bool), np.zeros(last + 1, bool)
    begins[before[1:] - 1] = False
    begins[before[1:][np.diff(before) > 2] - 2] = False  # the last half alone only where it is the whole
    known[half] = True
    counts[-2:] += last - len(before) + 1, np.count_nonzero(begins & (known[:-1] | known[1:]))
    kind = np.uint16 if width <= 1 << 16 else np.int32
    held = np.zeros((FEW + 2) * width, np.uint8)
    made = []
    for a in range(0, last, FEW):
        lo, hi = np.searchsorted(half, [a, a + FEW + 1])
        if lo < hi:
            h = half[lo:hi] - a
            key = h * width + word[lo:hi]
            np.add.at(held, key, np.uint8(1))
            counts[:width] += (held[: FEW * width] > 0).reshape(FEW, width).sum(axis=0, dtype=np.uint8)
            made.append((h.astype(np.uint8), word[lo:hi].astype(kind), held[key], held[key + width], np.packbits(begins[a : a + FEW])))
            held[key] = 0
    for some in itertools.batched(made, 64):
        yield pa.RecordBatch.from_arrays([*(pa.array([x.tobytes() for x in c], pa.binary()) for c in zip(*some, strict=True)), pa.nulls(len(some), pa.binary())], ["half", "word", "here", "after", "begins", "counts"])


def _encoder(sent: Broadcast):
    """Texts -> encoded halves; the last row of a task holds its counts instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = sent.value
        counts = np.zeros(len(vocabulary) + 2, np.int64)
        for b in batches:
            yield from _encoded(*_halves(b, vocabulary)[1:], counts)
        yield pa.RecordBatch.from_arrays([*[pa.nulls(1, pa.binary())] * 5, pa.array([counts.tobytes()], pa.binary())], ["half", "word", "here", "after", "begins", "counts"])

    return run


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for one in b.column("counts"):
            n = np.frombuffer(one.as_buffer(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n)), pa.array(n[n > 0])], ["w", "n"])


def _passages(words: np.ndarray) -> list[np.ndarray]:
    """Two halves from every half on, the last half alone only where it is the whole."""
    return [words[a : a + 2 * HALF] for a in range(0, max(1, len(words) - HALF), HALF)]


def _weighted(words: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and TF-IDF weights, of length one, of the words that have a weight."""
    w, tf = np.unique(words[words >= 0], return_counts=True)
    x = tf * idf[w]
    w, x = w[x > 0], x[x > 0]
    return w, x / max(float(np.sqrt(x @ x)), 1e-12)


def _add_product(out: np.ndarray, rows: pa.RecordBatch, q: np.ndarray, idf: np.ndarray) -> None:
    """Add C^T N C q to out: C the word counts of the passages of encoded halves, N the inverse squares of their TF-IDF lengths.

    A passage is the sum of two halves, so that each word of a half is taken
    up once for both passages that hold it.
    """
    read = lambda name, kind: [np.frombuffer(x.as_buffer(), kind) for x in rows.column(name)]
    half = np.concatenate([h.astype(np.int64) + i * (FEW + 1) for i, h in enumerate(read("half", np.uint8))])
    word = np.concatenate(read("word", np.uint16 if len(q) <= 1 << 16 else np.int32))
    begins = np.zeros((rows.num_rows, FEW + 1), bool)
    for i, bits in enumerate(read("begins", np.uint8)):
        some = np.unpackbits(bits)[:FEW]
        begins[i, : len(some)] = some
    n, square = begins.size, idf[word] ** 2
    length = np.bincount(half, np.concatenate(read("here", np.uint8)) * square, n + 1)
    length = length[:-1] + length[1:] + 2 * np.bincount(half, np.concatenate(read("after", np.uint8)) * square, n)
    weight = np.where(begins.ravel() & (length > 0), 1 / np.maximum(length, 1e-24), 0).astype(q.dtype)

    dense = np.argsort(-np.bincount(word, minlength=len(q)), kind="stable")[:DENSE]
    column = np.full(len(q), -1)
    column[dense] = np.arange(len(dense))
    at = column[word]
    rest = at < 0
    often = np.zeros(n * len(dense), q.dtype)
    np.add.at(often, half[~rest] * len(dense) + at[~rest], q.dtype.type(1))
    often = often.reshape(n, len(dense))
    half, word = half[rest], word[rest]

    sums = often @ q[dense]
    starts = np.flatnonzero(np.diff(half, prepend=-1))
    sums[half[starts]] += _sums(q, word, starts)
    sums[:-1] += sums[1:]
    sums *= weight[:, None]
    sums[1:] += sums[:-1].copy()

    out[dense] += often.T @ sums
    order = np.argsort(word, kind="stable")
    half, word = half[order], word[order]
    starts = np.flatnonzero(np.diff(word.astype(np.int64), prepend=-1))
    out[word[starts]] += _sums(sums, half, starts)


def latent_space(rows: DataFrame, own: list[pa.RecordBatch], idf: np.ndarray, rank: int, seed: int = 11) -> np.ndarray:
    """Leading right singular vectors (words x rank), orthonormal, of the TF-IDF rows, of length one, of all passages of encoded halves.

    Randomised SVD: a power step is A^T (A Q); each partition sums it over its
    passages, the sums are added up word by word, and only a matrix of the
    words by rank + OVERSAMPLED comes to the driver, which adds the product of
    its own rows, those of the benchmark.
    """
    spark, width = rows.sparkSession, len(idf)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, min(width, rank + OVERSAMPLED))))[0]

    def product(q: np.ndarray) -> np.ndarray:
        weighted = (idf[:, None] * q).astype(np.float32)
        sent = spark.sparkContext.broadcast((weighted, idf))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weighted, idf = sent.value
            out = np.zeros(weighted.shape)
            for b in batches:
                for a in range(0, b.num_rows, ROWS_AT_ONCE):
                    _add_product(out, b.slice(a, ROWS_AT_ONCE), weighted, idf)
            used = np.flatnonzero(out.any(axis=1))
            sums = pa.ListArray.from_arrays(np.arange(len(used) + 1, dtype=np.int32) * out.shape[1], out[used].ravel())
            yield pa.RecordBatch.from_arrays([pa.array(used), sums], ["c", "y"])

        full = np.zeros(q.shape)
        for b in own:
            for a in range(0, b.num_rows, ROWS_AT_ONCE):
                _add_product(full, b.slice(a, ROWS_AT_ONCE), weighted, idf)
        summed = rows.where("counts IS NULL").mapInArrow(run, "c long, y array<double>").groupBy("c").agg(*(F.sum(F.col("y")[k]).alias(f"y{k}") for k in range(q.shape[1])))
        got = summed.toPandas()
        sent.unpersist()
        full[got["c"].to_numpy(np.int64)] += got.drop(columns="c").to_numpy()
        return idf[:, None] * full

    for _ in range(POWERS):
        q = np.linalg.qr(product(q))[0]
    inner = q.T @ product(q)
    value, vector = np.linalg.eigh((inner + inner.T) / 2)
    keep = np.argsort(-value)[:rank]
    return q @ vector[:, keep[value[keep] > max(value.max(), 0) * 1e-10]]


@dataclass
class _Block:
    """Some passages: row of each word of the vocabulary (-1: in none), counts of these words by passage; unit latent rows, items and the least words that two halves, or the surroundings, must share with each."""

    row: np.ndarray
    counts: np.ndarray
    latent: np.ndarray
    owner: np.ndarray
    least: np.ndarray
    around: np.ndarray


@dataclass
class _Fit:
    """idf times latent vector of each word; blocks of passages; (item_id, word ids) of the items."""

    vocabulary: dict[bytes, int]
    latent: np.ndarray
    blocks: list[_Block]
    items: list[tuple[int | None, list[int]]]

    def reach(self) -> int:
        """Halves that the region of any match of a passage takes, from ``before`` halves before it."""
        return 4 + 2 * self.longest()

    def longest(self) -> int:
        return -(-max((len(words) for _, words in self.items), default=0) // HALF)


def least_shared(n: int) -> int:
    """Words of a passage of n that some two halves in a row hold wherever the passage begins, if LCS of them are there in n places.

    Up to HALF + 1 words lie in two halves as a whole; of more, at least all but half of what is over HALF.
    """
    return max(1, math.ceil(LCS * n - max(0, n - HALF) // 2 - 1e-9))


def _searcher(sent: Broadcast):
    """Batches of (doc_id, text) -> confirmed matches."""

    def judged(ids: np.ndarray, lo: int, hi: int, item: list[int]) -> tuple[float, float, int, int] | None:
        region = ids[lo:hi].tolist()
        lcs = longest_common(item, region) / len(item)
        if lcs < LCS:
            return None
        answer = item[-max(1, len(item) // ANSWER_PART) :]
        return lcs, longest_common(answer, region) / len(answer), lo, hi

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit: _Fit = sent.value
        counts = [list(Counter(words).items()) for _, words in fit.items]
        longest = fit.longest() * HALF
        for b in batches:
            ids, half, word, before = _halves(b, fit.vocabulary)
            seen = None
            best: dict[tuple[int, int], tuple] = {}
            for at, k, c in _candidates(fit, half, word):
                doc = int(np.searchsorted(before, at, side="right")) - 1
                here, words = at - int(before[doc]), ids[doc]
                if at != seen:
                    held = set(words[max(0, (here - 1) * HALF - longest) : (here + 3) * HALF + longest].tolist())
                    seen = at
                item = fit.items[k][1]
                # words of the item that are there at all bound the subsequence
                if sum([n for w, n in counts[k] if w in held]) < LCS * len(item):
                    continue
                got = judged(words, max(0, (here - 1) * HALF - len(item)), min(len(words), (here + 3) * HALF + len(item)), item)
                if got and got[1] >= ANSWER and ((doc, k) not in best or got[0] > best[doc, k][1]):
                    best[doc, k] = (c, *got)
            docs = b.column("doc_id").to_pylist()
            found = [(docs[d], fit.items[k][0], *v) for (d, k), v in sorted(best.items())]
            columns = list(zip(*found, strict=True)) or [[]] * 7
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "cosine", "lcs", "answer", "first_word", "end_word"])

    return run


def _candidates(fit: _Fit, half: np.ndarray, word: np.ndarray) -> Iterator[tuple[int, int, float]]:
    """Half, item and cosine of passages that may hold an item, by half; some halves at a time, however long a text."""
    reach, before = fit.reach(), 1 + fit.longest()
    last = int(half[-1]) + 1 if len(half) else 0
    for lo in range(0, last, HALVES_AT_ONCE):
        hi = min(lo + HALVES_AT_ONCE, last)
        first = (max(0, lo - before) // reach) * reach  # the surroundings of the first half, in stretches of ``reach``
        cut = slice(*np.searchsorted(half, [first, hi + 1 + 2 * reach]))
        h, w = half[cut] - first, word[cut]
        at, starts = np.unique(h, return_index=True)
        own = (at >= lo - first) & (at < hi - first)
        if not own.any():
            continue
        both = _sums(fit.latent, w, starts)
        follows = np.append(at[1:] == at[:-1] + 1, False)
        both[follows] += both[1:][follows[:-1]]
        both = both[own]
        both /= np.maximum(np.linalg.norm(both, axis=1), 1e-12)[:, None]
        stretch = np.maximum(at[own] + first - before, 0) // reach - first // reach
        near, shares = [], []
        for block in fit.blocks:
            shared = _shared(block, h, w, int(at[-1]) + 2)[at[own][:, None] + [0, 1]].sum(axis=1)
            around = _shared(block, np.concatenate([h // reach, np.maximum(h // reach - 1, 0)]), np.concatenate([w, w]), int(at[-1]) // reach + 2)
            cosine = both @ block.latent.T
            rows, found = np.nonzero((shared >= block.least) | ((cosine >= COSINE) & (around[stretch] >= block.around)))
            some, place = np.unique(rows, return_inverse=True)
            begin, end = np.searchsorted(h, at[own][some] - before + [[0], [reach]])
            group = np.repeat(np.arange(len(some)), end - begin)
            there = np.arange(len(group)) + np.repeat(begin - np.cumsum(end - begin) + end - begin, end - begin)
            closely = _shared(block, group, w[there], len(some))[place, found] >= block.around[found]  # the region itself, not the stretches it lies in
            rows, found = rows[closely], found[closely]
            near.append(np.stack([at[own][rows] + first, block.owner[found]]))
            shares.append(cosine[rows, found])
        pairs, cosines = np.concatenate(near, axis=1), np.concatenate(shares)
        order = np.argsort(pairs[0], kind="stable")
        yield from zip(pairs[0][order].tolist(), pairs[1][order].tolist(), cosines[order].tolist(), strict=True)


def _shared(block: _Block, group: np.ndarray, word: np.ndarray, groups: int) -> np.ndarray:
    """Words of each passage that each group of words holds; one that a group holds twice counts once."""
    row = block.row[word]
    once = np.sort(group[row >= 0] * len(block.counts) + row[row >= 0])
    once = once[np.diff(once, prepend=-1) > 0]
    at, starts = np.unique(once // len(block.counts), return_index=True)
    out = np.zeros((groups, block.counts.shape[1]), np.int32)
    out[at] = _sums(block.counts, once % len(block.counts), starts)
    return out


def _sums(weighted: np.ndarray, w: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the rows of w between starts: the first of each stretch, then the second of those that have one, and so on."""
    n = np.diff(np.append(starts, len(w)))
    order = np.argsort(-n, kind="stable")
    begin, n = starts[order], n[order]
    out = np.zeros((len(starts), weighted.shape[1]), weighted.dtype)
    for j, some in enumerate(np.searchsorted(-n, -np.arange(int(n[0]) if len(n) else 0), side="left")):
        out[:some] += weighted[w[begin[:some] + j]]
    back = np.empty_like(out)
    back[order] = out
    return back


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, cosine, lcs, answer, first_word, end_word: benchmark items found in docs(doc_id, text, ...).

    One row for each row of docs and item of benchmark(item_id, text, ...) that
    meet the thresholds of LCS and answer, with the region where the common
    subsequence is longest (of equally long ones the first) and the cosine of
    the passage that led there, which may be under COSINE where shared words
    made it a candidate; documents without a match give none. Null and empty
    texts, on either side, match nothing. Repeated rows each match; ids may be
    null. Other columns are ignored. An empty table on either side gives an
    empty result. The benchmark is the query set: its items come to the driver,
    the space is fitted once to all of them, and they go out in a broadcast of
    at most ITEMS_AT_ONCE items (some 10 KB each) for each pass over docs.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text"))
    out = spark.createDataFrame([], RESULT)
    for sent in _fitted(texts, _items(benchmark)):
        out = out.union(texts.mapInArrow(_searcher(sent), RESULT))
    return out


def _items(benchmark: DataFrame) -> list[tuple[int | None, list[bytes]]]:
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), utf8().alias("text")).orderBy("item_id", "text").collect()
    return [(r.item_id, w) for r in rows if (w := words_of(bytes(r.text)))]


def _fitted(texts: DataFrame, items: list[tuple[int | None, list[bytes]]]) -> list[Broadcast]:
    """What the searcher needs, fitted to texts(doc_id, text) and all items, in parts of ITEMS_AT_ONCE items."""
    if not items:
        return []
    send = texts.sparkSession.sparkContext.broadcast
    vocabulary = {w: i for i, w in enumerate(sorted({w for _, words in items for w in words}))}
    ids = [[vocabulary[w] for w in words] for _, words in items]
    rows = written(texts.select("text").mapInArrow(_encoder(send(vocabulary)), ENCODED), "halves")
    counted = {r.w: r.n for r in rows.where("counts IS NOT NULL").select("counts").mapInArrow(_counts, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()}
    *df, total, passages = (counted.get(i, 0) for i in range(len(vocabulary) + 2))
    df = np.array(df)
    # no word that the corpus holds is without weight, however frequent; one it doesn't hold can't be found and would only dilute its item
    idf = np.where(df > 0, np.log((1 + total) / (1 + df)) + 1, 0)
    counts = np.zeros(len(vocabulary) + 2, np.int64)
    own = list(_encoded(*_placed([np.where(df[x] > 0, x, -1) for x in map(np.array, ids)]), counts))
    space = latent_space(rows, own, idf, max(1, min(RANK, (passages + int(counts[-1])) // 4)))
    drop(rows)
    latent = (idf[:, None] * space).astype(np.float32)
    return [send(_Fit(vocabulary, latent, _blocks(ids[a : a + ITEMS_AT_ONCE], idf, space), [(i, w) for (i, _), w in zip(items[a : a + ITEMS_AT_ONCE], ids[a : a + ITEMS_AT_ONCE], strict=True)])) for a in range(0, len(items), ITEMS_AT_ONCE)]


def _blocks(items: list[list[int]], idf: np.ndarray, space: np.ndarray) -> list[_Block]:
    passages = [(k, p) for k, words in enumerate(items) for p in _passages(np.array(words)) if idf[p].any()]
    out = []
    for a in range(0, len(passages), PASSAGES_AT_ONCE):
        some = passages[a : a + PASSAGES_AT_ONCE]
        used = np.unique(np.concatenate([p for _, p in some]))
        row = np.full(len(idf), -1)
        row[used] = np.arange(len(used))
        counts, latent = np.zeros((len(used), len(some)), np.uint8), np.zeros((len(some), space.shape[1]))
        for j, (_, p) in enumerate(some):
            w, tf = np.unique(p, return_counts=True)
            counts[row[w], j] = tf
            w, x = _weighted(p, idf)
            latent[j] = x @ space[w]
        latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
        size, whole = np.array([len(p) for _, p in some]), np.array([len(items[k]) for k, _ in some])
        # of an item's words those outside the passage may all be there
        around = np.ceil(LCS * whole - 1e-9) - (whole - size)
        out.append(_Block(row, counts, latent.astype(np.float32), np.array([k for k, _ in some]), np.array([least_shared(n) for n in size]), around))
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of docs in which no benchmark item is found, with all their columns; found and dropped in one pass for each ITEMS_AT_ONCE items."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text"))
    for sent in _fitted(texts, _items(benchmark)):
        docs = docs.where(~_holds_item(sent)(utf8()))
    return docs


def _holds_item(sent: Broadcast):
    search = _searcher(sent)

    @F.arrow_udf("boolean")
    def found(texts: pa.Array) -> pa.Array:
        out = np.zeros(len(texts), bool)
        for b in search([pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), texts], ["doc_id", "text"])]):
            out[b.column("doc_id").to_numpy()] = True
        return pa.array(out)

    return found
