"""Searches over parts of a gallery, and vectors of length 1."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from shotlens.functions.geometry import unit
from shotlens.operators import gallery, similarity


def test_the_length_of_a_vector_is_computed_once(spark):
    df = spark.createDataFrame([(0, [3.0, 4.0]), (1, None), (2, []), (3, [0.0])], "id int, v array<double>")
    got = df.select("id", unit(F.col("v")).alias("u"))
    assert {r["id"]: r["u"] for r in got.collect()} == {0: [0.6, 0.8], 1: [], 2: [], 3: []}
    plan = got._jdf.queryExecution().analyzed().toString().lower()
    assert plan.count("sqrt(") == 1


def test_gallery_in_many_parts(spark, monkeypatch):
    for module in (similarity, gallery):
        monkeypatch.setattr(module, "PROTOTYPES", 50)
    monkeypatch.setattr(similarity, "QUERIES", 20)
    rng = np.random.default_rng(8)
    made = rng.normal(size=(230, 8))
    made[100:170] = made[7]  # a cell that is larger than a part
    g = spark.createDataFrame([(i, f"nm{i % 3}", v.tolist()) for i, v in enumerate(made)], "proto int, label string, v array<double>")
    asks = rng.normal(size=(90, 8))
    q = spark.createDataFrame([(i, v.tolist(), ["nm1"] if i % 2 else []) for i, v in enumerate(asks)] + [(90, made[7].tolist(), None)], "id int, v array<double>, may array<string>")
    args = ("id", "v", "proto", "label", -1.0, 0.0)
    found = [{r["id"]: r for r in f(q, g, *args, allow="may").collect()} for f in (similarity.best_match, gallery.nearest_two)]
    of = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    scores = of(np.vstack([asks, made[7]])) @ of(made).T
    for i, row in enumerate(scores):
        free = [j for j in range(230) if i % 2 == 0 or j % 3 == 1]
        best = sorted(free, key=lambda j: (-round(row[j], 12), -j))[:2]
        for by in found:
            assert by[i]["prototype_id"] == best[0]
            assert np.allclose([by[i]["top_score"], by[i]["second_score"]], row[best])
