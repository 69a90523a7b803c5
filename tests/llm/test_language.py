import numpy as np
from pyspark.sql import functions as F

from conftest import SF
from sightline.llm import language

TEXTS = {
    "en": ["the house of the king and the queen", "she was reading and writing in the garden", "this is what they have done with the thing"],
    "de": ["das haus des königs und der königin", "sie schrieb und las im garten des hauses", "das ist nicht was sie gemacht haben"],
    "ru": ["дом короля и королевы стоит на горе", "она читала и писала в саду", "это то что они сделали"],
}


def table(spark, rows):
    return spark.createDataFrame([(t, lang, "x", 1) for t, lang in rows], "text string, lang string, language string, score int")


def train(spark):
    return table(spark, [(t, lang) for lang, texts in TEXTS.items() for t in texts * 3])


def test_predicts_and_marks_unknown(spark):
    model = language.fit(train(spark))
    assert model[0] == sorted(TEXTS)
    rows = [("the king was in the garden", "en"), ("der könig war im garten", "de"), ("король был в саду", "ru"), (None, None), ("", None), ("123 -- !!", None), ("the garden of the king " * 20_000, "en")]
    found = language.predict(table(spark, rows), model, result="r").select("text", "lang", "language", "score", "r.*")
    assert found.columns[:4] == ["text", "lang", "language", "score"]
    for r in found.toDF("text", "want", "a", "b", "lang", "score").collect():
        assert r.lang == (r.want or "und") and 0 <= r.score <= 1
        assert r.want or r.score == 0


def test_vectors_are_bundles_of_bound_letters():
    text = "Ab, ab!"
    letters = language._letters()[2].astype(int)
    sequence = [0, 1, 2, 0, 1, 2, 0]
    want = sum(
        np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c] for a, b, c in zip(sequence, sequence[1:], sequence[2:])
    )
    vectors, sizes = language.text_vectors([text, None, "7"])
    assert (vectors[0] == want).all() and sizes.tolist() == [5, 0, 0] and not vectors[1:].any()


def test_chunks_do_not_change_vectors(monkeypatch):
    texts = [t for texts in TEXTS.values() for t in texts]
    whole = language._judge(texts, *[["a"], np.ones((1, language.DIMENSIONS))])
    monkeypatch.setattr(language, "CHUNK_DOCS", 2)
    monkeypatch.setattr(language, "BLOCK", 7)
    assert np.allclose(language._judge(texts, ["a"], np.ones((1, language.DIMENSIONS))).score, whole.score)


def test_nothing_to_learn_and_order_of_rows(spark):
    assert language.fit(train(spark).limit(0))[0] == []
    assert language.fit(table(spark, [("abc", None), (None, "en")]))[0] == []
    empty = language.predict(table(spark, [("abc", "en")]), ([], np.empty((0, language.DIMENSIONS))), result="r")
    assert empty.first().asDict()["r"].lang == "und"
    a, b = language.fit(train(spark)), language.fit(train(spark).repartition(5).orderBy(F.rand(3)))
    assert (a[1] == b[1]).all()


def test_held_out_accuracy(spark):
    from sightline.llm.catalog import QUERIES

    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    found = QUERIES["op10_language"](spark, SF).join(truth, "doc_id").where("held_out")
    right, n = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert n > 20 and right > 0.95
