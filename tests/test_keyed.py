"""The keyed table: repeated and crashed batches, writers side by side, compaction, streams that resume."""

import pytest

from shotlens.sources.keyed import KeyedTable, Manifest

SCHEMA = "k string, ord long, answer string"


def rows(t):
    return {r["k"]: (r["ord"], r["answer"]) for r in t.read().collect()}


def test_batches_count_once(spark, tmp_path):
    t = KeyedTable(spark, f"{tmp_path}/t", SCHEMA, ["k"], "ord")
    df = lambda *x: spark.createDataFrame(x, SCHEMA)
    assert rows(t) == {} and t.manifest() == Manifest()
    assert t.merge(df(("a", 1, "x"), ("b", 1, "y"), ("a", 3, "z")), 0)
    assert not t.merge(df(("a", 9, "other")), 0)  # the number is in
    assert t.merge(df(("a", 2, "late"), ("c", 1, None), (None, 1, "n")), 1)
    assert rows(t) == {"a": (3, "z"), "b": (1, "y"), "c": (1, None), None: (1, "n")}
    assert t.merge(df(("c", 2, "w")), 0, writer="other") and rows(t)["c"] == (2, "w")


def test_a_crash_before_the_manifest_leaves_nothing(spark, tmp_path, monkeypatch):
    t = KeyedTable(spark, f"{tmp_path}/t", SCHEMA, ["k"], "ord")
    batch = spark.createDataFrame([("a", 1, "x")], SCHEMA)
    with monkeypatch.context() as m:
        m.setattr(KeyedTable, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("crash")))
        with pytest.raises(RuntimeError, match="crash"):
            t.merge(batch, 0)
    assert rows(t) == {}
    assert t.merge(batch, 0) and rows(t) == {"a": (1, "x")}
    (tmp_path / "t" / "manifest" / "000000000002.json").write_text('{"folders": ["da')  # a manifest that was cut off
    assert rows(t) == {"a": (1, "x")} and t.merge(spark.createDataFrame([("b", 1, "y")], SCHEMA), 1)
    assert t.manifest().version == 3 and rows(t) == {"a": (1, "x"), "b": (1, "y")}
    assert t.clean() == 1 and rows(t) == {"a": (1, "x"), "b": (1, "y")}


def test_writers_side_by_side(spark, tmp_path):
    t = KeyedTable(spark, f"{tmp_path}/t", SCHEMA, ["k"], "ord")
    t.merge(spark.createDataFrame([("a", 1, "x")], SCHEMA), 0)
    calls = []

    def change(m):
        calls.append(m.version)
        if len(calls) == 1:  # another writer commits between reading and writing
            t.merge(spark.createDataFrame([("b", 1, "y")], SCHEMA), 0, writer="other")
        return Manifest(0, m.folders, m.batches | {"mine": 7})

    assert t._commit(change) and calls == [1, 2]
    assert t.manifest().batches == {"stream": 0, "other": 0, "mine": 7} and set(rows(t)) == {"a", "b"}


def test_compaction(spark, tmp_path):
    t = KeyedTable(spark, f"{tmp_path}/t", SCHEMA, ["k"], "ord")
    for n in range(4):
        t.merge(spark.createDataFrame([(f"k{i % 30}", n, f"{n}") for i in range(n, 60, n + 1)], SCHEMA), n)
    before = rows(t)
    assert t.compact(parts=3) and rows(t) == before and len(t.manifest().folders) == 1 and not t.compact()
    files = sorted((tmp_path / "t" / t.manifest().folders[0]).glob("*.parquet"))
    spans = sorted(tuple(spark.read.parquet(str(f)).selectExpr("min(k)", "max(k)").head()) for f in files)
    assert len(spans) == 3 and all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert t.clean() == 4 and rows(t) == before and not t.merge(spark.createDataFrame([("k1", 9, "x")], SCHEMA), 3)


def test_a_stream_resumes(spark, tmp_path):
    t = KeyedTable(spark, f"{tmp_path}/t", SCHEMA, ["k"], "ord")
    put = lambda *x: spark.createDataFrame(x, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run = lambda: t.feed(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), f"{tmp_path}/c", compact_every=2).awaitTermination()
    put(("a", 1, "x"), ("b", 1, "x"))
    put(("a", 2, "y"))
    run()
    assert rows(t) == {"a": (2, "y"), "b": (1, "x")} and len(t.manifest().folders) == 1
    put(("b", 5, "z"))
    run()
    run()
    assert rows(t) == {"a": (2, "y"), "b": (5, "z")} and t.manifest().batches == {"stream": 2}
