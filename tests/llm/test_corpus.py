"""Ops 11 to 13 by brute force: odd rows, ties, repeated rows, hot groups and long texts."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shotlens.llm import merkle, quality, resample

H = lambda s: hashlib.sha256(s.encode()).hexdigest()
SCHEMA = "doc_id long, source string, lang string, n_chars int, text string, place int, grp string, node string"


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def siblings(levels, i):
    out = []
    for nodes in levels[:-1]:
        run = i // 8 * 8
        out.append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + 8])))
        i //= 8
    return out


def naive_manifest(rows):
    coded = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: H("".join(map(coded, (r[0], r[1], r[2], r[3], text))))
    lower = lambda t: None if t is None else re.sub("[A-Z]", lambda m: m[0].lower(), t)
    by: dict = {}
    for r in rows:
        by.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r, r[4]), r))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: levels_of([x[2] for x in sorted(by[g], key=lambda x: x[:3])]) for g in langs}
    top = levels_of([trees[g][-1][0] for g in langs])
    out = []
    for at, g in enumerate(langs):
        for i, (_, _, mine, r) in enumerate(sorted(by[g], key=lambda x: x[:3])):
            path = siblings(trees[g], i) + siblings(top, at)
            node = leaf(r, lower(r[4])) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else mine
            for a, b in path:
                node = H(a + node + b)
            out.append((r[0], mine, trees[g][-1][0], top[-1][0], H("".join(a + b for a, b in path)), node, node == top[-1][0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 9}, {None: 3, "": 1, "a": 1200, "ä": 64, "b": 8, "c": 65}, {f"l{i:02d}": 2 for i in range(70)}, {"a": 513}])
def test_manifest_against_brute_force(spark, sizes):
    rng = random.Random(sum(sizes.values()))
    rows = [(i, rng.choice(["s", None]), g, rng.choice([1, None]), rng.choice(["Some Text", "plain text", "", None, "ÄÖ Ü"])) for g, n in sizes.items() for i in rng.sample(range(5000), n)]
    if len(rows) > 100:
        rows += [(None, "s", "a", 1, "x"), (None, "s", "a", 1, "Y"), rows[5], rows[5]]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA)
    got = merkle.manifest(spark, docs, changed=merkle.tampered(), levels=1 if None in sizes else merkle.LEVELS)  # four storeys of blocks
    cols = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert sorted([tuple(r[c] for c in cols) for r in got.collect()], key=repr) == naive_manifest(rows)


def test_manifest_of_nothing_and_unchanged(spark):
    docs = spark.createDataFrame([(i, "s", "a", 1, "Text") + (1, "x", "y") for i in range(20)], SCHEMA)
    assert all(r["verified"] for r in merkle.manifest(spark, docs).collect())
    assert merkle.manifest(spark, docs.limit(0)).count() == 0


def test_traversal_needs_little_memory():
    leaves = [H(str(i)) for i in range(4096)]
    walk = merkle.Traversal(leaves, 4)
    levels = levels_of(leaves)
    assert all(sides == siblings(levels, i) for i, sides in enumerate(walk)) and walk.root == levels[-1][0]
    assert walk.most <= 8 * 4 * 3  # digests, for 4,096 leaves


def naive_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {i + k for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_measures_against_brute_force(monkeypatch):
    monkeypatch.setattr(quality, "BATCH_BYTES", 64)  # texts are cut into pieces
    rng = random.Random(4)
    texts = [None, "", " \n\t ", "a", "a a a a a a a a", "a " * 9, "x\n\n x\nx\n\r\nx\r\n", "é ü ß   # | <b>", "\x1f\x1c a\x0bb\x85c"]
    for _ in range(150):
        texts.append("".join(rng.choice(["a", "b", "c", "dé"]) + rng.choice([" ", "\n", "  ", "\t"]) for _ in range(rng.randint(1, 120))))
        some = [rng.choice("abcdefgh") * 2 for _ in range(12)]
        texts.append(" ".join(some + [str(k) for k in range(rng.randint(0, 20))] + some))
    for t in texts:
        assert quality.measures((t or "").encode()) == naive_measures(t), repr(t)


def test_limits_adapt_to_the_group(spark):
    """A source whose words are long keeps its documents; the odd one out of each source goes; small groups lean on all."""
    rng = random.Random(2)
    text = lambda n, k: " ".join("".join(rng.choice("abcdefghij") for _ in range(n + rng.randint(-1, 1))) for _ in range(k))
    rows = [(i, text(5, 40), "en", "web") for i in range(400)] + [(1000 + i, text(14, 40), "de", "law") for i in range(3000)] + [(5000, text(14, 40), "en", "web"), (5001, text(3, 40), "de", "law"), (5002, text(5, 40) + "".join(f" #{k}" for k in range(30)), "en", "web"), (5003, text(5, 40), None, None)]
    rows += [(6000, None, "en", "web"), (6001, "", None, "web"), (None, text(5, 30), "en", "web"), (6002, "one two " * 40, "en", "web"), (7, rows[7][1], "en", "web")]
    docs = spark.createDataFrame([(*r, True, 1) for r in rows], "doc_id long, text string, lang string, source string, kept boolean, n_words int")
    got = {r["doc_id"]: r for r in quality.filter_quality(spark, docs).collect()}
    for i, t, _, _ in rows:
        assert tuple(got[i][c] for c in quality.MEASURES) == naive_measures(t)
    gone = {i for i, r in got.items() if not r["kept"]}
    assert gone == {5000, 5001, 5002, 6000, 6001, 6002} and {i for i, r in got.items() if r["base_failed"]} == {6000, 6001, 6002}
    assert got[5000]["broken"] == ["word_length"] and got[5002]["broken"] == ["symbols"] and got[6000]["broken"] == []
    assert quality.filter_quality(spark, docs.limit(0)).count() == 0


def test_sketches_merge_and_bound_the_error(spark):
    rng = random.Random(3)
    values = [int(rng.lognormvariate(6, 2)) for _ in range(4000)]
    df = spark.createDataFrame([(v, i % 7) for i, v in enumerate(values)], "n_words long, part int").selectExpr("part", "1L AS n_words", "n_words AS word_chars", "0L AS n_symbols", "0L AS n_dup_lines", "0L AS n_repeat_words")
    whole = quality.sketches(df, ()).where("rule = 'word_length'").select("cell", "n").collect()
    merged = quality.sketches(df, ("part",)).where("rule = 'word_length'").groupBy("cell").agg(F.sum("n").alias("n")).select("cell", "n").collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, merged)) and sum(r["n"] for r in whole) == 4000
    upto, ordered = 0, sorted(1000 * v for v in values)
    for r in sorted(whole):
        upto += r["n"]
        exact = ordered[upto - 1]
        assert r["cell"] <= exact <= r["cell"] * (1 + 2 ** -(quality.BITS - 1)) + 1


def naive_resample(rows, target):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    runs = lambda t: [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for w in [words(t)] for k in (1, 2, 3) for i in range(len(w) - k + 1)]
    s, t = Counter(b for r in rows for b in runs(r[1])), Counter(b for x in target for b in runs(x))
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in range(10000)]
    out = []
    for i, text in rows:
        f = runs(text)
        w = sum(gain[b] for b in f)
        h = int(H(f"42:{'' if i is None else i}")[:8], 16)
        out.append([i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text)) >= 20])
    drawn = sorted((x for x in out if x[5]), key=lambda x: (-x[3], x[0] is not None, x[0] or 0))
    for k, x in enumerate(drawn[: 5 * len(drawn) // 100], 1):
        x[4] = k
    return sorted([tuple(x[:5]) for x in out], key=repr)


def test_resample_against_brute_force(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdeÄéß9") for _ in range(rng.randint(1, 4)))
    text = lambda n: " ".join(rng.choice([word(), word().upper(), "The", "the-end", "x_y"]) for _ in range(n))
    rows = [(i, text(rng.randint(0, 60))) for i in range(300)] + [(400, None), (401, ""), (402, "--- ???"), (None, text(40)), (403, "İ K ſ " * 10), (404, text(30_000)), (405, text(19)), (406, text(20))]
    rows.append(rows[3])
    target = [text(50) for _ in range(20)] + [None, ""]
    docs = spark.createDataFrame([(*r, 5, 1, "x") for r in rows], "doc_id long, text string, rank int, uid int, b0 string")
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = resample.resample(spark, docs, bench)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=repr) == naive_resample(rows, target)
    assert resample.resample(spark, docs.limit(0), bench).count() == 0
    assert sorted(map(tuple, resample.resample(spark, docs, bench.limit(0)).collect()), key=repr) == naive_resample(rows, [])
    empty = docs.withColumn("text", F.lit(None).cast("string"))
    assert {(r["n_features"], r["weight"], r["rank"]) for r in resample.resample(spark, empty, bench).collect()} == {(0, 0, None)}


def test_long_texts_take_bounded_memory():
    """Two million words of one text: the labels of language spans and the repeated words, with what they allocate."""
    import tracemalloc

    from shotlens.llm.langid import Labeller, Model

    rng = np.random.default_rng(1)
    vocabulary = [f"w{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}".encode() for i in range(676)]
    text = b" ".join(vocabulary[i] for i in rng.integers(0, 676, 400_000))
    lab = Labeller(Model(["a", "b", "c", "d"], {c: i for i, c in enumerate("abcdefgh")}, np.log(rng.random((9, 4))), {}), 8.0)
    tracemalloc.start()
    letters, labels = lab.label([text])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(labels[0]) == 400_000 and letters.sum() == 3 * 400_000
    assert most < 400_000 * (8 + 4 + 16) + (48 << 20)
    tracemalloc.start()
    assert quality.measures(text)[0] == 400_000
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 400_000 * 60 + (200 << 20)
