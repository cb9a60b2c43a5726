import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from strandloom.llm import toxicity
from strandloom.llm.toxicity import fit, fit_ordinal, severity, toxicity_stage


def corpus(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        ws = [f"w{rng.randint(0, 300)}" for _ in range(rng.randint(5, 80))]
        bad = i % 6 == 0
        if bad:
            for _ in range(rng.randint(1, 5)):
                ws.insert(rng.randint(0, len(ws)), rng.choice(["Idiot,", "moron", "LOUT."]))
        rows.append((i, " ".join(ws), int(bad)))
    return rows


def test_ordinal_recovers_order():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 3))
    s = x @ np.array([2.0, -1.0, 0.0]) + rng.logistic(size=4000)
    grade = (s > -1).astype(int) + (s > 1.5)
    w, cut = fit_ordinal(x, grade, l2=0)
    assert np.allclose(w, [2, -1, 0], atol=0.2) and np.allclose(cut, [-1, 1.5], atol=0.2)


def test_held_out(spark):
    rows = corpus(1200, 1)
    docs = spark.createDataFrame([(a, b, 1.5) for a, b, _ in rows], "doc_id long, text string, p_toxic double")
    labels = spark.createDataFrame([(a, 1, c) for a, _, c in rows], "doc_id long, quality int, toxic int")
    model = fit(docs, labels)
    fresh = corpus(600, 2)
    extra = [(7000, None, 0), (7001, "", 0), (7002, "moron " * 20000, 1), (7003, "w1", 0), (7003, "w1", 0), (None, "idiot moron lout idiot", 1)]
    df = spark.createDataFrame([(a, b, 1.5) for a, b, _ in fresh + extra], "doc_id long, text string, p_toxic double")
    got = severity(df, model).collect()
    assert len(got) == len(fresh) + len(extra)
    want = {a: bool(c) for a, _, c in fresh + extra}
    assert np.mean([r["toxic"] == want[r["doc_id"]] for r in got]) > 0.97
    assert all(0 <= r["expected_severity"] <= 2 and r["toxic"] == (r["p_toxic"] >= model.reject) for r in got)
    most = {r["doc_id"]: r["expected_severity"] for r in got}
    assert most[7002] > most[7000] == most[7001]


def test_scores_equal_a_plain_sum(spark):
    rows = corpus(600, 4)
    docs = spark.createDataFrame([(a, b) for a, b, _ in rows] + [(5000, "!!! ... " + "idiot" * 40 + " moron-lout idiotic"), (5001, None)], "doc_id long, text string")
    model = fit(docs, spark.createDataFrame([(a, c) for a, _, c in rows], "doc_id long, toxic int"))
    weight = dict(zip(model.features, model.weights))
    for r in severity(docs, model).collect():
        text = dict([(a, b) for a, b, _ in rows] + [(5000, "!!! ... " + "idiot" * 40 + " moron-lout idiotic"), (5001, "")])[r["doc_id"]]
        times = Counter(f for w in text.split() for f in toxicity.features_of(w.strip(toxicity.EDGES).lower()))
        score = sum(weight.get(f, 0) * math.log1p(n) for f, n in times.items())
        above = [1 / (1 + math.exp(t - score)) for t in model.thresholds]
        assert math.isclose(r["p_toxic"], above[0], rel_tol=1e-6, abs_tol=1e-12) and math.isclose(r["expected_severity"], sum(above), rel_tol=1e-6)
        assert r["grade"] == sum(p >= 0.5 for p in above)


def test_held_out_labels(spark):
    """Fitted on one half of the labels; the other half's labels are noisy, so some toxic documents hold no sign."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    half = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2))
    model = fit(docs, labels.filter(half == 0))
    got = severity(docs, model).join(labels.filter(half == 1).select("doc_id", F.col("toxic").alias("label")), "doc_id")
    caught, kept = got.agg(F.avg(F.when(F.col("label") == 1, F.col("toxic").cast("int"))), F.avg(F.when(F.col("label") == 0, (~F.col("toxic")).cast("int")))).first()
    assert caught >= 0.85 and kept >= 0.97


def test_threshold():
    score, toxic = np.array([5.0, 4, 3, 2, 1, 0]), np.array([True, True, False, True, False, False])
    assert toxicity.reject_from(score, toxic, 0.01, 5.0) == 3.5
    assert toxicity.reject_from(score, toxic, 1.0, 0.1) == 1.5
    assert toxicity.reject_from(-score, toxic) > 0


def test_stage_and_empty(spark):
    rows = corpus(300, 3)
    docs = spark.createDataFrame([(a, b, "x") for a, b, _ in rows] + [(None, None, None)], "doc_id long, text string, grade string")
    spark.createDataFrame([(a, 1, c) for a, _, c in rows], "doc_id long, quality int, toxic int").write.mode("overwrite").parquet("/tmp/strandloom-tox/labels.parquet")
    kept = toxicity_stage(spark, docs, "/tmp/strandloom-tox")
    assert kept.columns == docs.columns
    left = {r["doc_id"] for r in kept.collect()}
    assert None in left and all(a in left for a, _, c in rows if not c) and sum(a in left for a, _, c in rows if c) <= 12
    none = docs.limit(0)
    model = fit(none, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert severity(none, model).collect() == [] and not severity(docs, model).filter("toxic").count()
    assert isinstance(model, toxicity.Severity)
