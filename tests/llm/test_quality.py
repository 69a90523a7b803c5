import numpy as np
from pyspark.sql import functions as F

from conftest import SF
from sightline.llm import quality

SCHEMA = "doc_id long, text string, quality string, tail double"


def graded(n=300):
    """Texts of growing junk, graded 3, 2, 1."""
    rng = np.random.default_rng(1)
    rows = []
    for i in range(n):
        grade = i % 3 + 1
        words = ["ship", "lake", "garden", "reads", "fine", "book"]
        parts = [w + ("###" if rng.random() < (3 - grade) * 0.3 else "") for w in rng.choice(words, 40)]
        rows.append((i, " ".join(parts), grade))
    return rows


def frames(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 0.5) for i, t, _ in rows], SCHEMA)
    return docs, spark.createDataFrame([(i, g) for i, _, g in rows], "doc_id long, quality int")


def test_three_grades(spark):
    rows = graded()
    docs, ratings = frames(spark, rows)
    model = quality.fit(docs, ratings, learn=F.col("doc_id") % 4 != 0)
    assert model.grades.tolist() == [1, 2, 3] and (np.diff(model.thresholds) > 0).all()
    found = quality.score(docs, model, at_least=2.0, result="r").select("doc_id", "r.*").collect()
    grade = {i: g for i, _, g in rows}
    held = [r for r in found if r.doc_id % 4 == 0]
    assert np.mean([round(r.expected_grade) == grade[r.doc_id] for r in held]) > 0.9
    assert np.mean([(r.tail >= 0.5) == (grade[r.doc_id] >= 2) for r in held]) > 0.9
    assert all(1 <= r.expected_grade <= 3 and 0 <= r.tail <= 1 for r in found)


def test_gradient_reaches_the_maximum():
    rng = np.random.default_rng(2)
    x = rng.normal(size=400)
    y = np.digitize(1.5 * x + rng.logistic(size=400), [-1, 1])
    row, bucket = np.arange(400), np.full(400, 5)
    model = quality.fit_ordinal(row, bucket, x, y, ridge=0.0, steps=1500)

    def loss(w, cuts):
        edges = np.concatenate(([-np.inf], cuts, [np.inf]))
        p = 1 / (1 + np.exp(-(edges[y + 1] - w * x))) - 1 / (1 + np.exp(-(edges[y] - w * x)))
        return -np.log(p).mean()

    best = loss(model.weights[5], model.thresholds)
    for dw, da, db in rng.normal(size=(200, 3)) * 0.05:
        assert loss(model.weights[5] + dw, model.thresholds + [da, db]) > best - 1e-5


def test_odd_rows(spark):
    docs, ratings = frames(spark, graded(60))
    odd = [(1000, None, "x", None), (1001, "", "x", 0.0), (1002, " \n", None, 0.0), (1003, "ship " * 50_000, "x", 0.0), (None, "lake", "x", 0.0), (1003, "ship " * 50_000, "x", 0.0)]
    docs = docs.union(spark.createDataFrame(odd, SCHEMA))
    more = spark.createDataFrame([(1000, 1), (None, 2), (5, None), (777, 3)], "doc_id long, quality int")
    model = quality.fit(docs, ratings.union(more))
    found = {r.doc_id: r for r in quality.score(docs, model, result="r").select("doc_id", "r.*").collect()}
    assert found[1000] [1:] == found[1001][1:] == found[1002][1:] and len(found) == 65
    kept = quality.select(docs, model, at_least=3.0)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


def test_nothing_or_one_grade_to_learn(spark):
    docs, ratings = frames(spark, graded(30))
    assert quality.fit(docs, ratings.limit(0)) is None
    assert quality.select(docs, None).count() == 30
    model = quality.fit(docs, ratings.where("quality = 2"))
    found = quality.score(docs, model, at_least=2.0, result="r").select("r.*").distinct().collect()
    assert [tuple(r) for r in found] == [(2.0, 1.0)]
    assert quality.score(docs.limit(0), model, result="r").count() == 0


def test_held_out_accuracy(spark):
    from sightline.llm.catalog import QUERIES

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    found = QUERIES["op4_quality"](spark, SF).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.selected == (r.quality == 1) for r in found]) > 0.85
