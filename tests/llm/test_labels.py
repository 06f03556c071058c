"""Ops 8 and 10 by held-out accuracy and brute force, and the pipeline against its stages."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shotlens.llm import langid, toxicity
from shotlens.llm.langid import Labeller, Model, fit, identify

DATA = "/root/testdata/sf0.01"


def viterbi(scores, switch):
    best, back = [list(scores[0])], []
    for row in scores[1:]:
        top = int(np.argmax(best[-1]))
        now, src = [], []
        for k, e in enumerate(row):
            jump = best[-1][k] < best[-1][top] - switch
            now.append((best[-1][top] - switch if jump else best[-1][k]) + e)
            src.append(top if jump else k)
        best.append(now)
        back.append(src)
    path = [int(np.argmax(best[-1]))]
    for src in reversed(back):
        path.append(src[path[-1]])
    return path[::-1]


def test_viterbi_over_many_texts_is_viterbi_over_each():
    rng = np.random.default_rng(0)
    m = Model(["a", "b", "c"], {}, np.zeros((1, 3)), {})
    lab = Labeller(m, 2.0)
    lab.scores, lab.size = -rng.exponential(2, (50, 3)), np.ones(50)
    seqs = [rng.integers(0, 50, n).astype(np.int32) for n in (0, 1, 7, 30, 2, 30)]
    letters, labels = lab._viterbi(seqs)
    for s, x, n in zip(seqs, labels, letters, strict=True):
        assert x.tolist() == (viterbi(lab.scores[s], 2.0) if len(s) else [])
        assert n.tolist() == np.bincount(x, minlength=3).tolist()


def test_language_accuracy_and_cases(spark, corpus, no_rows):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = langid.op8_language(spark, DATA).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()
    model = fit(spark, docs, F.lit(True), sample_docs=50)
    odd = identify(spark, corpus, model, spans=True).collect()
    assert len(odd) == corpus.count()
    assert {r["doc_id"]: r["lang_pred"] for r in odd if r["doc_id"] in (1, 2, 3)} == {1: "und", 2: "und", 3: "und"}
    none = fit(spark, no_rows, F.lit(True))
    assert {r["lang_pred"] for r in identify(spark, corpus, none).collect()} == {"und"}
    assert identify(spark, no_rows, model).count() == 0
    digits = spark.createDataFrame([(1, "123 ½ ² !!")], "doc_id long, text string")
    assert identify(spark, digits, model).head()["lang_pred"] == "und"
    mixed = spark.createDataFrame([(1, "the of and is that with by for " * 3 + "der die und den mit das ein von " * 3)], "doc_id long, text string")
    assert [s["lang"] for s in identify(spark, mixed, model, spans=True).head()["spans"]] == ["en", "de"]


def test_block_max_neighbours_are_exact():
    rng = random.Random(4)
    vectors = []
    for _ in range(700):
        t = np.array(sorted(rng.sample(range(30), rng.randint(1, 5))))
        w = np.array([rng.random() + 0.1 for _ in t])
        vectors.append((t, w / np.sqrt((w * w).sum())))
    ids = np.array(rng.sample(range(10_000), 700))
    ix = toxicity.Index(vectors, ids, np.array([rng.randint(0, 1) for _ in ids], float), 30)
    dense = np.zeros((700, 30))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    for q, _ in zip(vectors[::9], range(60), strict=False):
        at, cos = ix.nearest(*q, 15)
        x = np.zeros(30)
        x[q[0]] = q[1]
        s = dense @ x
        want = sorted((-round(s[i], 9), ids[i]) for i in range(700) if s[i] > 1e-12)[:15]
        assert sorted((-round(c, 9), ix.ids[a]) for a, c in zip(at, cos, strict=True)) == sorted(want)


def naive_language(texts, trained, switch):
    """The model and its predictions by plain loops: (language, score) of each text."""
    words_of = lambda t: langid.LETTERS.findall((t or "").lower())
    langs, count, letters = sorted({lang for _, lang in trained}), {}, {}
    for text, lang in trained:
        for w in words_of(text):
            for g in langid.grams(w):
                count.setdefault(g, dict.fromkeys(langs, 0))[lang] += 1
            letters.setdefault(langid.script_of(w[0]), dict.fromkeys(langs, 0))[lang] += len(w)
    total = {k: sum(c[k] for c in count.values()) for k in langs}
    logp = lambda g, k: np.log(((count[g][k] if g in count else 0) + 0.5) / (total[k] + 0.5 * (len(count) + 1)))
    whole = {k: sum(c[k] for c in letters.values()) for k in langs}

    def word_scores(w):
        s = {k: sum(logp(g, k) for g in langid.grams(w)) for k in langs}
        own = {k for k in langs if letters.get(langid.script_of(w[0]), whole).get(k, 0) >= langid.OWN_SCRIPT * max(whole[k], 1)}
        if own and len(own) < len(langs):
            s = {k: v if k in own else max(s[o] for o in own) + langid.FLOOR for k, v in s.items()}
        return [max(s[k] - max(s.values()), langid.FLOOR) for k in langs]

    out = []
    for text in texts:
        words = words_of(text)
        if not words:
            out.append(("und", 0.0))
            continue
        sums = np.zeros(len(langs))
        for w, k in zip(words, viterbi([word_scores(w) for w in words], switch), strict=True):
            sums[k] += len(w)
        out.append((langs[int(sums.argmax())], sums.max() / sums.sum()))
    return out


def test_language_against_brute_force(spark):
    rng = random.Random(12)
    alphabets = {"aa": "abcdeio", "bb": "bcdfuxyz", "cc": "абвгдеио"}
    word = lambda a: "".join(rng.choice(alphabets[a]) for _ in range(rng.randint(1, 7)))
    rows = [(i, " ".join(word(lang if rng.random() < 0.8 else rng.choice(list(alphabets))) for _ in range(rng.randint(1, 60))), lang) for i in range(150) for lang in [rng.choice(list(alphabets))]]
    rows += [(200, None, "aa"), (201, "123 !", "bb"), (202, "abc", None), (None, "abc abc", "aa"), (203, " ".join(word("bb") for _ in range(20_000)), "bb"), (7, rows[7][1], rows[7][2])]
    docs = spark.createDataFrame([(*r, 0.0) for r in rows], "doc_id long, text string, lang string, score double")
    model = fit(spark, docs, F.col("doc_id") % 3 != 0)
    seen = sorted({(i, t, lang) for i, t, lang in rows if i is not None and i % 3 and t is not None and lang}, key=str)
    repeated = [(t, lang) for i, t, lang in rows if i is not None and i % 3 and t is not None and lang]
    assert len(repeated) == len(seen) + 1  # a repeated row counts twice
    want = naive_language([t for _, t, _ in rows], repeated, langid.SWITCH)
    got = {(r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in identify(spark, docs, model).collect()}
    assert got == {(i, lang, round(s, 9)) for (i, _, _), (lang, s) in zip(rows, want, strict=True)}
    equal = Model(["a", "b"], {"x": 0}, np.zeros((2, 2)), {})
    assert identify(spark, spark.createDataFrame([(1, "x y x")], "doc_id long, text string"), equal).head()["lang_pred"] == "a"  # of equal languages the first


def test_calibration_rises():
    rng = np.random.default_rng(2)
    v = rng.random(500)
    steps, values = toxicity.calibrate(v, (rng.random(500) < v).astype(float))
    assert (np.diff(steps) > 0).all() and (np.diff(values) > -0.2).all() and abs(values[-1] - 1) < 0.35


def test_toxicity_finds_marked_documents(spark, corpus, no_rows):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdeinorst") for _ in range(5))
    rows, labels = [], []
    for i in range(600):
        words, y = [word() for _ in range(30)], int(i % 6 == 0)
        if y:
            words[3:6] = rng.sample(["vileone", "viletwo", "vilethree", "vilestuff"], 3)
        rows.append((i, " ".join(words)))
        labels.append((i, y))
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (3, None), (None, 1)], "doc_id long, toxic int")
    model, counted = toxicity.fit(spark, docs, lab, ~toxicity.held_out())
    out = toxicity.score_documents(spark, docs, model).toPandas().set_index("doc_id")
    y = pd.Series(dict(labels))
    assert (out.predicted[y.index] == y).mean() > 0.99 and out.score.between(0, 1).all()
    odd = toxicity.score_documents(spark, corpus, model).collect()
    assert len(odd) == corpus.count() and not any(r["predicted"] for r in odd)
    none, nothing = toxicity.fit(spark, docs, no_rows, F.lit(True))
    assert none.index is None and nothing is None and toxicity.score_documents(spark, docs, none).where("predicted = 1").count() == 0
    assert toxicity.score_documents(spark, no_rows, model).count() == 0
    kept = toxicity.score_corpus(spark, corpus, spark.createDataFrame([(4, 1), (5, 0)], "doc_id long, toxic int"), F.lit(True), keep=("rank", "text", "component_id"))
    assert sorted(map(repr, kept.select("doc_id", "rank", "text", "component_id").collect())) == sorted(map(repr, corpus.select("doc_id", "rank", "text", "component_id").collect()))
    clash = corpus.withColumnRenamed("component_id", "predicted_by")
    assert toxicity.score_corpus(spark, clash.limit(0), no_rows, F.lit(True)).count() == 0


def test_toxicity_against_brute_force(spark):
    """Whole scores and neighbours by a plain cosine over all terms; string ids; ties of equal examples; rare wording."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdeinorst") for _ in range(rng.randint(2, 6)))
    rows, labels = [], []
    for i in range(260):
        words, y = [word() for _ in range(rng.randint(5, 40))], int(i % 5 == 0)
        rows.append((f"d{i:03d}", " ".join(words + ["vilestuff"] * (y and i % 3))))
        labels.append((f"d{i:03d}", y))
    rows += [(f"e{k}", rows[0][1]) for k in range(20)] + [("f", rows[7][1] + " " + word()), ("g", ""), ("h", None)]
    labels += [(f"e{k}", 1) for k in range(20)]
    docs, lab = spark.createDataFrame(rows, "doc_id string, text string"), spark.createDataFrame(labels, "doc_id string, toxic int")
    model, counted = toxicity.fit(spark, docs, lab, F.lit(True), sample_docs=500)
    texts, examples = dict(rows), {}
    for i, y in labels:
        examples.setdefault((texts[i], y), (i, y))
    of = {i: set(toxicity.terms_of(t or "")) for i, t in rows}
    assert sorted(model.term_no) == sorted(set().union(*(of[i] for i, _ in labels)))
    idf = {t: np.log((1 + len(rows)) / (1 + sum(t in s for s in of.values()))) + 1 for t in model.term_no}
    assert all(toxicity.LEAST * idf[t] - 1e-9 <= model.factor[n] <= (1 + toxicity.LEAST) * idf[t] for t, n in model.term_no.items())

    def vector(text):
        found = toxicity.terms_of(text or "")
        v = {t: (1 + np.log(found.count(t))) * model.factor[model.term_no[t]] for t in set(found) if t in model.term_no}
        n = np.sqrt(sum(x * x for x in v.values()))
        return {t: x / n for t, x in v.items()}

    held = {r["doc_id"]: r for r in toxicity.score_documents(spark, docs, model).collect()}
    assert sorted(map(repr, toxicity.score_counted(spark, counted, model).collect())) == sorted(map(repr, held.values()))
    ex = [(k, y, vector(texts[k])) for k, y in zip(model.index.ids, model.index.labels, strict=True)]
    assert len(ex) == len(examples)
    for i, text in rows:
        q = vector(text)
        every = sorted(((-round(sum(x * v.get(t, 0) for t, x in q.items()), 11), k, y) for k, y, v in ex))
        want = [e for e in every if e[0] < 0][: toxicity.NEIGHBOURS]
        near = held[i]["neighbours"]
        assert np.allclose([n["cosine"] for n in near], [-c for c, _, _ in want], atol=1e-9)
        assert [(n["id"], n["label"]) for n in near] == [(k, y) for _, k, y in want]
        if not want:
            assert held[i]["score"] == model.none and not near
            continue
        c = np.array([n["cosine"] for n in near])
        w = c / (1 - np.minimum(c, 1) + toxicity.NEAR)
        votes = (w @ np.array([n["label"] for n in near]) + toxicity.PRIOR * model.base) / (w.sum() + toxicity.PRIOR)
        assert abs(held[i]["score"] - model.score(votes)) < 1e-9
    assert held["f"]["neighbours"][0]["id"] == "d007" and held["f"]["neighbours"][0]["cosine"] > 0.9  # copied rare wording
    bounded, _ = toxicity.fit(spark, docs, lab, F.lit(True), sample_docs=500, sample_chars=3000)
    assert 0 < sum(len(texts[i]) for i in bounded.index.ids) <= 3000


def test_pipeline_over_odd_rows(spark, tmp_path):
    """Nulls in every column, empty texts, repeated rows, copies and near copies; then empty tables. The kept documents are
    told by what the stages are to do, and their tokens by the library."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from tokenizers import Tokenizer

    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdeinorst") for _ in range(rng.randint(2, 8)))
    rows, labels = [], []
    for i in range(240):
        y = int(i % 6 == 0)
        words = [word() for _ in range(40)]
        words[3:6] = rng.sample(["vileone", "viletwo", "vilethree", "vilestuff"], 3) if y else words[3:6]
        rows.append((i, " ".join(words), "en", "web", 1))
        labels.append((i, 1, y))
    copy = rows[1][1].split()
    rows += [(300, rows[1][1], "en", None, None), (301, " ".join([*copy, word()]), None, "web", 1), (2, rows[2][1], "en", "web", 1), (302, None, None, None, None), (303, "", "en", "web", 0), (304, "12 34", "en", "web", 5), (None, rows[5][1], "en", "web", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars int"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/a/documents.parquet")
    spark.createDataFrame([*labels, (None, 1, 1), (301, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/a/labels.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/a").collect()
    keeps = [r for r in rows if r[1] and any(c.isalpha() for c in r[1]) and not (r[0] is not None and r[0] < 240 and r[0] % 6 == 0) and r[0] not in (300, 301)]
    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted((str(i), len(tok.encode(t, add_special_tokens=False).ids) + 1) for i, t, *_ in keeps)
    pieces: dict = {}
    for r in got:
        pieces[str(r["doc_id"])] = pieces.get(str(r["doc_id"]), 0) + r["length"]
    sums: dict = {}
    for i, n in want:
        sums[i] = sums.get(i, 0) + n
    assert pieces == sums
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/b/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/b/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0


def test_pipeline_stages(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id < 300").cache()
    seen = {r["doc_id"]: r["text"] for r in docs.collect()}
    toxic = corpus_pipeline.drop_toxic(spark, docs, DATA).cache()
    assert toxic.columns == list(corpus_pipeline.COLUMNS)
    lab = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in toxic.collect()}
    assert all(i in kept for i in seen if lab.get(i) == 0)
    assert corpus_pipeline.keep_languages(spark, docs, DATA).count() == sum(any(c.isalpha() for c in t or "") for t in seen.values())
    from tests.llm.test_search import links_of

    ids = sorted(seen)
    sets, links = links_of([seen[i] for i in ids])
    root = {k: k for k in sets}
    for _ in range(20):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    unique = corpus_pipeline.drop_near_duplicates(spark, docs, DATA)
    assert sorted(r["doc_id"] for r in unique.select("doc_id").collect()) == [ids[k] for k in sorted(sets) if root[k] == k]
    assert corpus_pipeline.pack(spark, docs, DATA).select("doc_id").distinct().count() == len(seen)
