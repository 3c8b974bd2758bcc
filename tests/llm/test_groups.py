"""Near-duplicates, archives, embeddings, decontamination, toxicity and the pipeline against brute force and planted cases."""

import dataclasses
import hashlib
import io
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lanewise.llm import common, components, decontam, embeddings, minhash, toxicity, warc
from lanewise.llm.common import spread_join, written
from lanewise.llm.components import connected_components

DOCS = "doc_id long, text string, source string, v string, component long"


def closed(n, pairs, key):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        up[root(a)] = root(b)
    least = {}
    for i in range(n):
        least[root(i)] = min(least.get(root(i), key[i]), key[i])
    return [least[root(i)] for i in range(n)]


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def corpus(seed, n=160):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    common = " ".join(rng.choice(vocabulary, 40))
    texts = [None, "", "  \n", "one", "ONE", "one two three"]
    base = [list(rng.choice(vocabulary, rng.integers(5, 220))) for _ in range(12)]
    for _ in range(n):
        words = list(base[rng.integers(len(base))])
        for _ in range(rng.integers(0, 5)):
            words[rng.integers(len(words))] = str(rng.choice(vocabulary))
        texts.append(" ".join(words) + (" " + common if rng.random() < 0.3 else ""))
    return texts + ["x " * 30_000]


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(spark, seed):
    texts = corpus(seed)
    sets = [shingles(t) for t in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    want = closed(len(sets), pairs, list(range(len(sets))))
    df = spark.createDataFrame([(i, t, "s", "v", 9) for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r for r in minhash.near_duplicates(df).collect()}
    assert [got[i].component_id for i in range(len(texts))] == want and len(pairs) > 50
    assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_one_of_each_group_stays(spark):
    text = " ".join(f"a{i}" for i in range(50))
    rows = [(5, text), (2, text), (2, text), (None, text), (7, None), (8, "b " * 9)]
    df = spark.createDataFrame([(*r, "s", "v", 1) for r in rows], DOCS)
    out = minhash.without_near_duplicates(df)
    assert sorted(map(str, (r.doc_id for r in out.collect()))) == ["2", "2", "7", "8", "None"] and out.columns == df.columns
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_long_lists_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SHORT", 4)
    monkeypatch.setattr(minhash, "BLOCK_DOCS", 8)
    texts = corpus(3)
    sets = [shingles(t) for t in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df).collect()}
    assert [got[i] for i in range(len(texts))] == closed(len(sets), pairs, list(range(len(sets))))


def test_tables_grow_in_proportion_to_long_texts(spark, monkeypatch):
    sizes = {}

    def recorded(df, tag):
        out = written(df, tag)
        sizes[tag] = sizes.get(tag, 0) + sum(f.stat().st_size for f in Path(out._written_path.removeprefix("file://")).rglob("*.parquet"))
        return out

    monkeypatch.setattr(minhash, "written", recorded)
    total = []
    for n in (20_000, 80_000):
        sizes.clear()
        words = [f"w{i}" for i in range(n)]
        other = ["changed" if i % 57 == 5 else w for i, w in enumerate(words)]  # a similarity just under 0.85
        df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other))], "doc_id long, text string")
        assert sorted(r.component_id for r in minhash.near_duplicates(df).collect()) == [1, 2]
        assert "entries" in sizes
        total.append(sum(sizes.values()))
    assert total[1] < 5 * total[0] < 5 * 20_000 * 100


def test_rows_of_hot_keys_are_spread(spark):
    rows = [(i, 7 if i % 3 == 0 else i) for i in range(6000)] + [(9, None)]
    big = spark.createDataFrame(rows, "i long, k long")
    small = big.where("k is not null").groupBy("k").count().withColumn("w", F.col("k") * 10)
    got = spread_join(big, small, "k", "count", 6000, "i")
    assert sorted((r.i, r.w) for r in got.collect()) == sorted((i, k * 10) for i, k in rows if k is not None)
    left = spread_join(big, small.where("count > 1"), "k", "count", 6000, "i", "left")
    assert sorted(map(str, ((r.i, r.w) for r in left.collect()))) == sorted(str((i, 70 if k == 7 else None)) for i, k in rows)


@pytest.mark.parametrize("few", [1 << 20, 0])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW", few)
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 101), (None, 3), (100, 101)] + [(200, k) for k in range(201, 300)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100, 101: 100} | {k: 200 for k in range(200, 300)}


def test_archives(spark, monkeypatch):
    big, small = "é<p>" * 400, "tiny"
    rows = [(1, "http://a", big, 0), (9, "http://b\r\nX: y", big, 0), (4, None, big, 0), (2, "u", small, 0), (3, "u", small, 0), (5, "u", None, 0), (6, "u", "WARC/1.1\r\n\r\n" * 300, 0), (None, "u", big, 0), (7, "u", "x" * 1000, 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in warc.archived(df).collect())
    want = []
    for i, _, html, _ in rows:
        data = (html or "").encode()
        last = max((p for p, _, h, _ in rows if h == html and p is not None), default=None)
        revisit = len(data) >= 1000 and i != last
        want.append((str(i), len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", str(last if revisit else None)))
    assert got == sorted(want)
    assert warc.archived(df.limit(0)).count() == 0
    monkeypatch.setattr(common, "FILTER_BITS", 64)  # nearly every key is let through by accident
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in warc.archived(df).collect()) == got


def test_several_archives_and_one_of_another_attempt(spark, tmp_path):
    texts = [f"<p>{i % 4}</p>" * 300 for i in range(40)]
    df = spark.createDataFrame([(min(i, 37), t) for i, t in enumerate(texts)], "page_id long, html string").coalesce(2)
    (tmp_path / "000000-000099-left.warc.gz").write_bytes(warc.record(99, "u", b"x", hashlib.sha1(b"x").digest(), 1, None))
    archives = warc.write_archives(df, tmp_path.as_uri(), archive_bytes=1)
    got = warc.read_archives(archives).collect()
    assert archives.count() == len(got) == 40 and all(r.page_id != 99 for r in got)
    last = {k: max(min(i, 37) for i in range(40) if i % 4 == k) for k in range(4)}
    assert sorted(r.page_id for r in got if r.record_type == "response") == sorted(min(i, 37) for i in range(40) if min(i, 37) == last[i % 4])


def test_archive_faults():
    good = warc.record(1, "u", b"abc" * 500, hashlib.sha1(b"abc" * 500).digest(), 1500, None)
    two = list(warc.read_records(io.BytesIO(good + good)))
    assert [r.payload for r in two] == [b"abc" * 500] * 2
    wrong = warc.record(1, "u", b"abd", hashlib.sha1(b"abc").digest(), 3, None)
    for bad in (good[:-5], wrong):
        with pytest.raises(ValueError):
            list(warc.read_records(io.BytesIO(bad)))


def test_embeddings(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((12, 10))
    rows = [(int(i if rng.random() < 0.97 else i // 2), [float(np.float32(x)) for x in base[rng.integers(12)] + rng.standard_normal(10) * rng.choice([0, 0.02, 0.15, 0.3, 1.0])]) for i in range(500)]
    rows += [(9001, None), (9002, []), (9003, [0.0] * 10), (9004, [float("nan")] + [1.0] * 9), (9005, [None] * 10), (9006, [1.0, 2.0]), (9007, [2.0, 4.0]), (9009, [float("inf")] * 10), (None, [1.0] * 10), (9010, [3.0]), (9011, [1.0])]
    ok = [i for i, (k, v) in enumerate(rows) if k is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    pairs, links = [], [0] * len(rows)
    for i in ok:
        for j in ok:
            if i != j and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1]), np.array(rows[j][1])
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.9:
                    links[i] += 1
                    pairs.append((i, j))
    first = {}
    pairs += [(i, first.setdefault(rows[i][0], i)) for i in ok]
    component = closed(len(rows), pairs, [float("inf") if k is None else k for k, _ in rows])
    want = sorted((str(k), links[i], str(k if k is None else component[i])) for i, (k, _) in enumerate(rows))
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, label int")
    for part in (embeddings.PART, 64):  # one part, and many compared with one another
        monkeypatch.setattr(embeddings, "PART", part)
        assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in embeddings.near_embeddings(df).collect()) == want
    assert embeddings.near_embeddings(df.limit(0)).count() == 0


def test_decontamination(spark):
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 8)))
    vocabulary = [word() for _ in range(4000)]
    say = lambda n: list(rng.choice(vocabulary, n))
    items = [say(30) for _ in range(20)]
    docs, leaky = [], set()
    for i in range(300):
        words = say(rng.integers(1, 400))
        if i % 15 == 0:
            item = list(items[i // 15])
            if i % 30:
                for k in range(3, 30, 9):
                    item[k] = "instead"
            at = rng.integers(len(words) + 1)
            words[at:at] = item
            leaky.add(i)
        docs.append((i, " ".join(words), 0))
    docs += [(900, None, 0), (901, "", 0), (None, " ".join(items[0]), 0), (902, "y " * 50_000, 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(k, " ".join(w).upper()) for k, w in enumerate(items)] + [(50, None), (51, " ")], "item_id long, text string")
    found = decontam.leaks(df, bench).collect()
    assert {r.doc_id for r in found} == leaky | {None}
    assert all(r.doc_id is None or r.item_id == r.doc_id // 15 for r in found)
    out = decontam.without_leaks(df, bench)
    assert {r.doc_id for r in out.collect()} == {d[0] for d in docs} - leaky - {None} and out.columns == df.columns
    assert decontam.leaks(df, bench.limit(0)).count() == 0 and decontam.leaks(df.limit(0), bench).count() == 0


def test_items_paraphrased_in_much_of_the_corpus(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"v{i}" for i in range(3000)]
    say = lambda n: list(rng.choice(vocabulary, n))
    item = [f"q{i}" for i in range(30)]
    copy = ["instead" if k in (1, 5, 9, 13, 17) else w for k, w in enumerate(item)]
    docs = [(i, " ".join([*say(20), *(copy if i % 3 == 0 else []), *say(20)])) for i in range(300)]
    bench = spark.createDataFrame([(0, " ".join(item))] + [(k, " ".join(say(30))) for k in range(1, 9)], "item_id long, text string")
    for some in (docs, docs[:2], [docs[0], docs[3]]):
        found = decontam.leaks(spark.createDataFrame(some, "doc_id long, text string"), bench).collect()
        assert {(r.doc_id, r.item_id) for r in found} == {(i, 0) for i, _ in some if i % 3 == 0}


def test_more_passages_than_dimensions(spark, monkeypatch):
    monkeypatch.setattr(decontam, "RANK", 16)
    rng = np.random.default_rng(6)
    vocabulary = [f"v{i}" for i in range(400)]
    say = lambda n: list(rng.choice(vocabulary, n))
    items = [say(rng.integers(15, 60)) for _ in range(60)]
    docs = []
    for k, item in enumerate(items):
        kept = list(item)
        if k % 2:
            changed = rng.permutation(len(item) * 3 // 4)[: len(item) // 4]  # the answer stays
            kept = ["instead" if i in changed else w for i, w in enumerate(item)]
        docs.append((k, " ".join([*say(rng.integers(0, 90)), *kept, *say(rng.integers(0, 90))])))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontam.leaks(df, bench).collect()}
    assert not {(k, k) for k in range(len(items))} - found


def _share_of_best(fit, texts, items):
    """What the fitted space holds of all passages' TF-IDF rows, as a share of what the best one of its size holds."""
    docs = [decontam.word_ids(t.encode(), fit.vocabulary) for t in texts]
    held = np.array([np.isin(np.arange(len(fit.vocabulary)), x[a : a + decontam.HALF]) for x in docs for a in range(0, len(x), decontam.HALF)])
    idf = np.where(held.any(axis=0), np.log((1 + len(held)) / (1 + held.sum(axis=0))) + 1, 0)
    whole = np.zeros((len(idf), len(idf)))
    for x in [*docs, *(np.array([fit.vocabulary[w] for w in words]) for _, words in items)]:
        for p in decontam._passages(x):
            w, weight = decontam._weighted(p, idf)
            whole[np.ix_(w, w)] += np.outer(weight, weight)
    space = fit.latent[idf > 0] / idf[idf > 0, None]
    whole = whole[np.ix_(idf > 0, idf > 0)]
    assert space.shape[1] == decontam.RANK and np.allclose(space.T @ space, np.eye(decontam.RANK), atol=1e-5)
    return np.trace(space.T @ whole @ space) / np.linalg.eigvalsh(whole)[-decontam.RANK :].sum()


def test_latent_space_of_all_passages(spark, monkeypatch):
    monkeypatch.setattr(decontam, "RANK", 8)
    monkeypatch.setattr(decontam, "OVERSAMPLED", 100)  # all dimensions, so that the space is exact
    monkeypatch.setattr(decontam, "DRAWN_DOCS", 3, raising=False)  # once a bound of the documents that the space was fitted to
    rng = np.random.default_rng(9)
    vocabulary = [f"v{i}" for i in range(70)]
    share = 1 / np.arange(1, 71)
    items = [list(rng.choice(vocabulary, 30)) for _ in range(12)] + [["nowhere"] * 3 + vocabulary[:4]]
    sizes = [0, 1, 31, 32, 33, 63, 64, 65, 96, 97, 700, 20_000, *rng.integers(0, 300, 200)]
    texts = [" ".join(w if rng.random() < 0.7 else "other" for w in rng.choice(vocabulary, n, p=np.roll(share, k) / share.sum())) for k, n in enumerate(sizes)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    made = decontam._items(bench)
    for dense in (128, 5):
        monkeypatch.setattr(decontam, "DENSE", dense, raising=False)
        (sent,) = decontam._fitted(df.select("doc_id", common.utf8().alias("text")), made)
        assert abs(_share_of_best(sent.value, texts, made) - 1) < 1e-5

    # the pipeline's stage searches with the same space
    used, holds = [], decontam._holds_item
    monkeypatch.setattr(decontam, "_holds_item", lambda sent: used.append(sent.value) or holds(sent))
    monkeypatch.setattr(corpus_pipeline, "table", lambda spark, sf_dir, name: bench)
    left = {r.doc_id for r in corpus_pipeline.decontamination(spark, df, "").collect()}
    assert left == set(range(len(texts))) - {r.doc_id for r in decontam.leaks(df, bench).collect()}
    assert len(used) == 1 and abs(_share_of_best(used[0], texts, made) - 1) < 1e-5


def test_frequent_words_among_rare_ones_of_other_items(spark):
    rng = np.random.default_rng(7)
    rare = [f"r{i}" for i in range(60)]
    item = [f"c{i}" for i in range(15)]
    docs = [(i, " ".join([*rng.choice(rare, 40), *item, *rng.choice(rare, 40)])) for i in range(6)]
    docs += [(100 + i, " ".join(rng.permutation(item))) for i in range(400)]
    bench = [(0, " ".join(item))] + [(k, " ".join(rng.choice(rare, 30))) for k in range(1, 81)]
    found = decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).where("item_id = 0").collect()
    assert {r.doc_id for r in found} == set(range(6))


class _Sent:
    def __init__(self, value):
        self.value = value


def _altered(rng, item, kind):
    kept = list(item)
    body = len(item) - max(1, len(item) // decontam.ANSWER_PART)
    if kind:
        for i in rng.permutation(body)[: len(item) // (4 if kind == 1 else 6)]:
            kept[i] = "instead"
    return kept if kind < 2 else [w for i, x in enumerate(kept) for w in ([x, "besides"] if i % 3 == 2 and i < body else [x])]


def test_retrieval_against_an_exhaustive_pass(spark, sf_dir, monkeypatch):
    rng = np.random.default_rng(12)
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    bench, docs = read("benchmark"), read("documents").select("doc_id", "text").orderBy("doc_id").collect()
    items = decontam._items(bench)
    texts = [(d.doc_id, (d.text or "").encode()) for d in docs]
    for n, (_, item) in enumerate(items * 3):
        around = decontam.words_of(texts[rng.integers(len(docs))][1])
        at = rng.integers(len(around) + 1)
        texts.append((10_000 + n, b" ".join([*around[:at], *(w.encode() if isinstance(w, str) else w for w in _altered(rng, item, n // len(items))), *around[at:]])))
    df = spark.createDataFrame([(i, bytearray(t)) for i, t in texts], "doc_id long, text binary")
    (sent,) = decontam._fitted(df, items)
    fit = sent.value
    rows = sum(len(decontam._passages(np.empty(-(-len(t.split()))))) for _, t in texts)
    assert fit.latent.shape[1] == decontam.RANK < rows / 4
    batch = pa.RecordBatch.from_pydict({"doc_id": [i for i, _ in texts], "text": [t for _, t in texts]})

    def found(value):
        (out,) = decontam._searcher(_Sent(value))([batch])
        return {(r["doc_id"], r["item_id"]): r["lcs"] for r in out.to_pylist()}

    got = found(fit)
    for name, value in (("HALVES_AT_ONCE", 9), ("BYTES_AT_ONCE", 100)):  # long texts are cut without effect
        monkeypatch.setattr(decontam, name, value)
    assert found(fit) == got
    alone = found(dataclasses.replace(fit, blocks=[dataclasses.replace(b, least=np.full(len(b.least), 10**6)) for b in fit.blocks]))
    wanted = {}
    for doc, text in texts:
        words = decontam.word_ids(text, fit.vocabulary)
        for at in range(-(-len(words) // decontam.HALF)):
            for key, item in fit.items:
                region = words[max(0, (at - 1) * decontam.HALF - len(item)) : (at + 3) * decontam.HALF + len(item)]
                held = set(region.tolist())
                if sum(w in held for w in item) < decontam.LCS * len(item):
                    continue
                lcs = decontam.longest_common(item, region.tolist()) / len(item)
                answer = item[-max(1, len(item) // decontam.ANSWER_PART) :]
                if lcs >= decontam.LCS and decontam.longest_common(answer, region.tolist()) >= decontam.ANSWER * len(answer):
                    wanted[doc, key] = max(lcs, wanted.get((doc, key), 0))
    assert got.keys() <= wanted.keys() and len(wanted) >= 3 * len(items) - 6
    print("exhaustive", len(wanted), "found", len(got), "by the latent space alone", len(alone))
    assert len(got) >= 0.99 * len(wanted) and len(alone) >= 0.9 * len(wanted)


def test_items_in_several_parts(spark, monkeypatch):
    bench = spark.createDataFrame([(k, " ".join(f"w{k}x{i}" for i in range(20))) for k in range(9)], "item_id long, text string")
    docs = spark.createDataFrame([(k, f"some words {' '.join(f'w{k}x{i}' for i in range(20))} and more") for k in range(9)] + [(99, " ".join(f"w{k}x{i}" for k in range(2) for i in range(20)))], "doc_id long, text string")
    want = [(k, k, 1.0) for k in range(9)] + [(99, 0, 1.0), (99, 1, 1.0)]
    for n in (100, 4):
        monkeypatch.setattr(decontam, "ITEMS_AT_ONCE", n)
        assert sorted((r.doc_id, r.item_id, r.lcs) for r in decontam.leaks(docs, bench).collect()) == want
        assert decontam.without_leaks(docs, bench).count() == 0


def test_least_shared_words_lie_in_two_halves():
    for n in range(1, 2 * decontam.HALF + 1):
        matched = -(-7 * n // 10)
        for at in range(decontam.HALF):
            there = [n - sum(not 0 <= at + i - first < 2 * decontam.HALF for i in range(n)) for first in (0, decontam.HALF)]
            assert decontam.least_shared(n) <= max(1, matched - (n - max(there)))


def test_longest_common():
    rng = np.random.default_rng(0)
    for _ in range(100):
        a, b = rng.integers(0, 6, rng.integers(1, 30)).tolist(), rng.integers(0, 6, rng.integers(0, 40)).tolist()
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert decontam.longest_common(a, b) == t[-1][-1]


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.score_documents(docs, labels).join(labels, "doc_id").where("held_out").select("score", "toxic", "predicted").collect()
    pos, neg = ([r.score for r in rows if r.toxic == k] for k in (1, 0))
    auc = np.mean([[(p > n) + 0.5 * (p == n) for n in neg] for p in pos])
    assert auc >= 0.9
    out = toxicity.score_documents(docs, labels).collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out) and len(out) == docs.count()


def test_pu_risk_and_its_gradient():
    rng = np.random.default_rng(3)
    xp, xu, prior = rng.integers(0, 2, (7, 4)).astype(float), rng.integers(0, 2, (11, 4)).astype(float), 0.2
    w = rng.standard_normal(5)
    loss = lambda z: np.log1p(np.exp(-z))
    score = lambda x, w: x @ w[:4] + w[4]
    by_hand = lambda w: (prior * np.mean([loss(score(x, w)) for x in xp]), np.mean([loss(-score(x, w)) for x in xu]) - prior * np.mean([loss(-score(x, w)) for x in xp]))
    got = toxicity.risk(w, xp, xu, prior)
    assert got[:2] == pytest.approx(by_hand(w))
    for term in (0, 1):
        slope = [(by_hand(w + h)[term] - by_hand(w - h)[term]) / 2e-6 for h in np.eye(5) * 1e-6]
        assert got[2 + term] == pytest.approx(slope, abs=1e-6)


def test_unlabelled_positives_are_not_learned_as_negatives():
    rng = np.random.default_rng(9)
    toxic = rng.random(4000) < 0.1
    x = (rng.random((4000, 6)) < np.where(toxic, 0.7, 0.05)[:, None]).astype(np.uint8)
    labelled = toxic & (rng.random(4000) < 0.3)
    weights, bias = toxicity.fit_nnpu(x, labelled, float(toxic[~labelled].mean()), 1e-4)
    z = x @ weights + bias
    hidden, clean = z[toxic & ~labelled], z[~toxic]
    assert np.mean(hidden[:, None] > clean[None, :]) > 0.97 and (hidden > 0).mean() > 0.8 and (clean > 0).mean() < 0.02


def test_bounds_of_the_training_sample(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    few = toxicity.train(docs, labels, most_positive=5, most_unlabelled=20)
    assert all(0 < few.scorer()(t) < 1 for t in (b"", b"idiot " * 100_000))


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (None, "x", 5), (3, "y " * 9, 5)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, toxic int")
    assert toxicity.score_documents(docs, labels).count() == 4
    assert toxicity.without_toxic(docs, labels.limit(0)).columns == docs.columns
    assert toxicity.score_documents(docs.limit(0), labels).count() == 0


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    read = lambda t: spark.read.parquet(f"{sf}/{t}.parquet")
    docs = read("documents")
    last = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = spark.createDataFrame(stage(spark, last, sf).collect(), docs.schema)
        assert now.columns == docs.columns and now.count() <= last.count()
        if name == "near_duplicates":
            rows = last.collect()
            sets = [shingles(r.text) for r in rows]
            pairs = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
            key = [r.doc_id for r in rows]
            assert {r.doc_id for r in now.collect()} == {k for k, c in zip(key, closed(len(rows), pairs, key), strict=True) if k == c}
        last = now
    packed = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in last.collect()}


def test_pipeline_on_empty_and_clashing_tables(spark, tmp_path):
    tables = {
        "documents": spark.createDataFrame([(1, None, "en", "s", 1, "x", 1.0), (None, "a b", None, None, None, None, None), (2, "idiot " * 9, "en", "s", 1, "y", 2.0)], "doc_id long, text string, lang string, source string, n_chars int, component string, score double"),
        "labels": spark.createDataFrame([(1, 0, 0), (None, None, None)], "doc_id long, quality int, toxic int"), "benchmark": spark.createDataFrame([(1, None), (None, "")], "item_id long, text string"),
    }
    for n, name in enumerate(("some", "none")):
        for t, df in tables.items():
            (df.limit(0) if n else df).coalesce(1).write.parquet(str(tmp_path / name / f"{t}.parquet"))
        assert corpus_pipeline.run(spark, str(tmp_path / name)).count() == (0 if n else 3)
        last = spark.read.parquet(str(tmp_path / name / "documents.parquet"))
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, last, str(tmp_path / name)).columns == last.columns
