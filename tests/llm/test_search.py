"""Ops 1, 4 and 7 against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from shotlens.llm import ann, neardup
from shotlens.llm import search as search_module
from shotlens.llm.neardup import Shingler, buckets_of, link_texts, near_duplicates, parities, signature
from shotlens.llm.search import search


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")


def brute(x, ids, q, k):
    s = [(-float(np.add.reduce(a * q[1])), i) for i, a in zip(ids, x, strict=True) if i != q[0]]
    return sorted(s)[:k]


def test_nearest_neighbours_small_is_exact(spark, no_rows):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=6).astype("float32").tolist(), 1) for i in range(60)]
    rows += [(100 + i, rows[0][1], 1) for i in range(45)]  # copies of one vector
    bad = [(200, None, 1), (201, [0.0] * 6, 1), (202, [1.0, None] + [0.0] * 4, 1), (203, [float("nan")] + [1.0] * 5, 1), (204, [float("inf")] + [1.0] * 5, 1), (205, [1.0], 1), (206, [], 1), (None, rows[1][1], 1), rows[5]]
    got = ann.nearest_neighbours(spark, vectors(spark, rows + bad), F.col("vec_id") % 20 == 0, 20).collect()
    x, ids = np.array([np.array(r[1], "float32") for r in rows], float), [r[0] for r in rows]
    for q in [i for i in ids if i % 20 == 0]:
        want = brute(x, ids, (q, x[ids.index(q)]), 20)
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["vec_id"] for r in mine] == [i for _, i in want] and [r["rank"] for r in mine] == list(range(1, 21))
        assert [-r["score"] for r in mine] == [s for s, _ in want]
    few = ann.nearest_neighbours(spark, vectors(spark, rows[:3]), F.lit(True), 20)
    assert few.count() == 6
    assert ann.nearest_neighbours(spark, no_rows, F.lit(True)).count() == 0


def test_nearest_neighbours_recall_through_the_forest(spark, monkeypatch):
    monkeypatch.setattr(ann, "LEAF", 32)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16))
    x = (centres[rng.integers(0, 40, 3000)] + 0.3 * rng.normal(size=(3000, 16))) * rng.uniform(0.5, 2, (3000, 1))
    x = x.astype("float32")
    got = ann.nearest_neighbours(spark, vectors(spark, [(i, v.tolist(), 1) for i, v in enumerate(x)]), F.col("vec_id") % 50 == 0, 10).collect()
    found: dict = {}
    for r in got:
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    xd = x.astype(float)
    hits = [len(found[q] & {i for _, i in brute(xd, range(3000), (q, xd[q]), 10)}) for q in range(0, 3000, 50)]
    assert sum(hits) / (10 * len(hits)) >= 0.9


def links_of(rows):
    sets = {}
    for k, t in enumerate(rows):
        w = (t or "").encode().lower().split()
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    return sets, [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]


def test_near_duplicates_against_all_pairs(spark, corpus, no_rows):
    rng = random.Random(7)
    word = lambda: "w" + str(rng.randint(0, 3000))
    texts = []
    for _ in range(25):
        base = [word() for _ in range(rng.randint(6, 120))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 8)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(("  " if rng.random() < 0.3 else " ").join(copy).upper() if rng.random() < 0.2 else " ".join(copy))
    sets, links = links_of(texts)
    root = {k: k for k in sets}
    for _ in range(len(sets)):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["doc_id"]: r for r in near_duplicates(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for k in sets:
        assert (got[k]["n_shingles"], got[k]["component_id"], got[k]["kept"]) == (len(sets[k]), root[k], root[k] == k)
    odd = near_duplicates(spark, corpus).collect()
    assert len(odd) == corpus.count()
    by = {}
    for r in odd:
        by.setdefault(r["doc_id"], []).append(r)
    assert [(r["n_shingles"], r["component_id"], r["kept"]) for i in (1, 2, 3) for r in by[i]] == [(0, i, True) for i in (1, 2, 3)]
    assert by[None][0]["component_id"] is None and by[None][0]["kept"]
    assert {(r["component_id"], r["kept"]) for r in by[6]} == {(5, False)} and by[5][0]["n_shingles"] == 1
    assert near_duplicates(spark, no_rows).count() == 0


def test_near_duplicates_in_a_large_bucket(spark):
    """400 texts that share 70 % in one bucket, and pairs of them of 76 % or a little more."""
    rng = random.Random(5)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    common = fresh(174)  # 170 shingles of 206: two texts have 170 of 242 in common
    texts = [common + fresh(36) for _ in range(400)]
    want = set()
    for k in range(20):
        a, b = 40 + 9 * k, 390 - 8 * k
        own = fresh(9)  # 179 of 233
        texts[a], texts[b] = common + own + fresh(27), common + own + fresh(27)
        want.add((a, b))
    rows = [" ".join(t) for t in texts]
    sh = Shingler()
    sizes = [sh.shingles(sh.split(t.encode())) for t in rows]
    share = lambda a, b: len(np.intersect1d(sizes[a], sizes[b])) / len(np.union1d(sizes[a], sizes[b]))
    assert all(0.75 < share(a, b) < 0.78 for a, b in want) and share(0, 1) < 0.71
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    keys = [xxhash.xxh3_128_digest(" ".join(t).encode()) for t in texts]
    nodes = spark.createDataFrame([(i, k, i, len(s), [7]) for i, (k, s) in enumerate(zip(keys, sizes, strict=True))], "node long, key binary, doc long, size long, buckets array<long>")
    groups: dict = {}
    for r in link_texts(spark, docs, nodes, "doc_id", "text").collect():
        groups.setdefault(r["root"], set()).add(r["node"])
    assert sorted(map(tuple, map(sorted, groups.values()))) == sorted(want)


@pytest.mark.parametrize(("n", "small", "parts"), [(100, 24, 500_000), (300, 24, 500_000), (100, 3, 40)])
def test_near_duplicates_around_a_hub(spark, monkeypatch, n, small, parts):
    """One text that each of n others is linked with, though few of those with each other; links contracted by several tasks too."""
    monkeypatch.setattr(neardup, "SMALL", small)
    monkeypatch.setattr(neardup, "TASK_LINKS", parts)
    rng = random.Random(n)
    hub = [[f"w{rng.randrange(10**9)}" for _ in range(20)] for _ in range(100)]
    texts = [hub]
    for _ in range(n):
        own = list(hub)
        for k in rng.sample(range(100), 11):
            own[k] = [f"w{rng.randrange(10**9)}" for _ in range(20)]
        texts.append(own)
    rows = [(7 + i, " ".join(w for part in t for w in part)) for i, t in enumerate(texts)]
    sh = Shingler()
    sets = [sh.shingles(sh.split(t.encode())) for _, t in rows]
    assert all(len(np.intersect1d(sets[0], s)) >= 0.75 * len(np.union1d(sets[0], s)) for s in sets)
    assert {r["component_id"] for r in near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {7}


def test_parities_bound_the_difference():
    rng = np.random.default_rng(4)
    for _ in range(50):
        both, a, b = (np.unique(rng.integers(0, 1 << 63, rng.integers(1, 300)).astype(np.uint64)) for _ in range(3))
        x, y = np.union1d(both, a), np.union1d(both, b)
        apart = sum(bin(int(p) & 0xFFFFFFFFFFFFFFFF ^ int(q) & 0xFFFFFFFFFFFFFFFF).count("1") for p, q in zip(parities(x), parities(y), strict=True))
        assert apart <= len(np.setxor1d(x, y))


def test_signature_agrees_as_often_as_the_sets():
    rng = np.random.default_rng(3)
    for n in (4, 40, 4000):
        agree = []
        for _ in range(60):
            common, a, b = (np.unique(rng.integers(0, 1 << 63, m).astype(np.uint64)) for m in (6 * n, n, n))
            x, y = (signature(np.unique(np.concatenate([common, z])), 128) for z in (a, b))
            agree.append((x == y).mean())
        assert abs(np.mean(agree) - 0.75) < 0.04
    assert len(buckets_of(Shingler().shingles([b"a"]))) == 32


def test_bm25_skips_blocks_and_stays_exact():
    rng = np.random.default_rng(9)
    texts = [rng.integers(0, 40, 30) + 100 * (i // 50) for i in range(400)]  # eight groups with words of their own
    texts = [np.concatenate([t, rng.integers(1000, 1010, 5)]) for t in texts]
    pairs = [np.unique(t.astype(np.uint64), return_counts=True) for t in texts]
    mean = np.mean([c.sum() for _, c in pairs])
    shard = search_module.Shard(list(range(400)), [t for t, _ in pairs], [c for _, c in pairs], mean, block_docs=16)
    for q in range(0, 400, 37):
        t = pairs[q][0]
        w = rng.random(len(t)) + 0.5
        scores = [(-sum(x * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * pairs[d][1].sum() / mean)) for x, i in zip(w, t, strict=True) for j, c in zip(*pairs[d], strict=True) if i == j), d) for d in range(400) if d != q]
        want = sorted((round(s, 9), d) for s, d in scores if s < 0)[:10]
        for least in (0.0, -want[-1][0] * 0.99):
            assert sorted((round(s, 9), d) for s, d in shard.search(q, t, w, 10, least)) == want
    assert shard.skipped > 2 * shard.read


def test_bm25_leaves_out_blocks_by_the_sums_of_their_documents(monkeypatch):
    """Each of a block's documents has one of the query's two terms; no postings are read where both together don't reach."""
    monkeypatch.setattr(search_module, "COMMON", 0)
    one = np.array([1])
    shard = search_module.Shard([1, 2], [np.array([t], np.uint64) for t in (5, 6)], [one, one], 1.0)
    both = np.array([5, 6], np.uint64)
    assert shard.search(9, both, np.ones(2), 1, 1.5) == [] and (shard.skipped, shard.read) == (1, 0)
    assert shard.search(9, both, np.ones(2), 1, 0.5) == [(-1.0, 1)]
    read = []
    monkeypatch.setattr(shard, "_postings", lambda at, df, plain=shard._postings: (read.append(int(df.sum())), plain(at, df))[1])
    assert shard.search(9, both, np.ones(2), 1, 2.5) == [] and sum(read) == 0


def test_bm25_scores_common_terms_by_a_product_and_stays_exact(monkeypatch):
    rng = np.random.default_rng(4)
    pairs = [np.unique(rng.zipf(1.3, rng.integers(1, 60)).astype(np.uint64) % np.uint64(5000), return_counts=True) for _ in range(500)]
    pairs += [pairs[0]] * 25  # ties
    ids, terms, counts = list(range(525)), [t for t, _ in pairs], [c for _, c in pairs]
    asked = [(i, terms[i], rng.random(len(terms[i])) + 0.1, 0.0) for i in range(0, 525, 3)]
    shards = []
    for columns, cells in ((0, 1 << 20), (1024, 1 << 20), (1024, 525 * 3)):
        monkeypatch.setattr(search_module, "COMMON", columns)
        monkeypatch.setattr(search_module, "COMMON_CELLS", cells)
        monkeypatch.setattr(search_module, "SUM_CELLS", cells)
        shards.append(search_module.Shard(ids, terms, counts, 30.0, block_docs=16))
    assert [s.common.shape[1] for s in shards][::2] == [0, 3] and shards[1].common.shape[1] > 50
    plain, by_product, few = (s.search_many(asked, 10) for s in shards)
    assert plain == by_product == few and all(len({i for _, i in best}) == len(best) for best in plain)
    for (own, t, w, _), best in zip(asked, plain, strict=True):
        shards[0]._ask(t, w)
        scores = shards[0]._exact(np.arange(525))
        shards[0].q[:] = 0
        assert best == sorted((-s, i) for s, i in zip(scores.tolist(), shards[0].ids.tolist(), strict=True) if s > 0 and i != own)[:10]


@pytest.mark.parametrize(("postings", "block"), [(search_module.SHARD_POSTINGS, search_module.BLOCK_DOCS), (300, 4)])
def test_bm25_against_brute_force(spark, corpus, no_rows, postings, block):
    rng = random.Random(5)
    rows = [(i, " ".join("t" + str(int(rng.paretovariate(0.7))) for _ in range(rng.randint(1, 60))), 1) for i in range(300)]
    rows += [(400 + i, rows[0][1], 1) for i in range(15)] + [(500, None, 1), (501, "", 1), (None, "t1", 1)]
    got = search(spark, spark.createDataFrame(rows, "doc_id long, text string, rank int"), F.col("doc_id") % 50 == 0, 10, shard_postings=postings, block_docs=block).collect()  # some 20 shards in the second case
    docs = {i: Counter(re.findall("[a-z0-9]+", (t or "").lower())) for i, t, _ in rows if i is not None}
    n, df = len(docs), Counter(w for c in docs.values() for w in c)
    size = {i: sum(c.values()) for i, c in docs.items()}
    mean = sum(size.values()) / n
    for q in [i for i in docs if i % 50 == 0]:
        want = []
        for i, c in docs.items():
            s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * size[i] / mean)) for w in docs[q] if w in c)
            if i != q and s > 0:
                want.append((-round(s, 8), i))
        mine = sorted((r["rank"], r["doc_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [(-round(s, 8), i) for _, i, s in mine] == sorted(want)[:10]
    assert search(spark, corpus, F.lit(True)).count() > 0
    assert search(spark, no_rows, F.lit(True)).count() == 0


def test_bm25_last_of_equal_scores():
    """Of 30 copies, 20 at a time: what comes before the score and id of a row found elsewhere."""
    one = np.array([3, 7], np.uint64), np.array([1, 2])
    shard = search_module.Shard(list(range(30)), [one[0]] * 30, [one[1]] * 30, 3.0, block_docs=4)
    best = shard.search(99, one[0], np.ones(2), 20)
    assert [i for _, i in best] == list(range(20)) and len({s for s, _ in best}) == 1
    least = -best[0][0]
    asked = [(99, one[0], np.ones(2), x, last) for x, last in ((least, 5), (least, 0), (least * 0.999, 0), (least * 1.001, 40))]
    assert [[i for _, i in b] for b in shard.search_many(asked, 20)] == [list(range(5)), [], list(range(20)), []]


def test_bm25_rows_between_shards_do_not_follow_their_number(spark, monkeypatch):
    made, plain = spark.sparkContext.accumulator(0), search_module.map_arrow

    def counted(df, f, schema):
        def run(batches):
            for b in f(batches):
                if schema.startswith("query_id"):
                    made.add(b.num_rows)
                yield b

        return plain(df, run, schema)

    rng = random.Random(8)
    rows = [(i, " ".join("t" + str(int(rng.paretovariate(0.7))) for _ in range(20)), 1) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rank int")
    want = [tuple(r) for r in search(spark, docs, F.col("doc_id") % 50 == 0, 2).orderBy("query_id", "rank").collect()]
    monkeypatch.setattr(search_module, "map_arrow", counted)
    got = search(spark, docs, F.col("doc_id") % 50 == 0, 2, shard_postings=200, block_docs=8).toPandas()  # some 100 shards
    assert [tuple(r) for r in got.sort_values(["query_id", "rank"]).itertuples(index=False)] == want
    assert 32 <= made.value < 16 * 50


def test_bm25_few_shards_share_the_queries_among_tasks(spark, monkeypatch):
    made, plain = spark.sparkContext.accumulator(0), search_module.map_arrow

    def counted(df, f, schema):
        def run(batches):
            rows = 0
            for b in f(batches):
                rows += b.num_rows
                yield b
            made.add(int(rows > 0))

        return plain(df, run if schema.startswith("query_id") else f, schema)

    rng = random.Random(3)
    rows = [(i, " ".join("t" + str(int(rng.paretovariate(0.7))) for _ in range(20)), 1) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rank int")
    want = [tuple(r) for r in search(spark, docs, F.col("doc_id") % 5 == 0, 3).orderBy("query_id", "rank").collect()]
    for name, value in (("map_arrow", counted), ("TOGETHER", 16), ("TASK_QUERIES", 30)):
        monkeypatch.setattr(search_module, name, value)
    got = search(spark, docs, F.col("doc_id") % 5 == 0, 3).toPandas()  # one shard, 120 queries
    assert [tuple(r) for r in got.sort_values(["query_id", "rank"]).itertuples(index=False)] == want
    assert made.value == 4
