import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.llm import toxicity

PLAIN = ["the weather is fine in the garden today", "we read a good book about ships", "lunch was served at noon by the lake"]
BAD = ["stupid", "moron", "idiot"]
SCHEMA = "doc_id long, text string, toxicity double, label string"


def corpus(spark):
    rows = [(i, PLAIN[i % 3] + f" number {i % 7}", 0.0, "x") for i in range(60)]
    rows += [(100 + i, f"{PLAIN[i // 3 % 3]} {BAD[i % 3]} number {i % 7}", 0.0, "x") for i in range(20)] + [(500, None, 0.0, "x"), (501, "", None, None)]
    labels = [(i, 0) for i in range(60)] + [(100 + i, 1) for i in range(20)] + [(None, 1), (3, None), (4, 7), (9999, 1), (500, 0), (100, 1)]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")


@pytest.fixture(scope="module")
def model(spark):
    return toxicity.fit(*corpus(spark))


def scores(spark, model, texts):
    frame = spark.createDataFrame([(i, t, 0.0, "x") for i, t in enumerate(texts)], SCHEMA)
    return [r.s for r in toxicity.score(frame, model, result="s").orderBy("doc_id").collect()]


def test_disguised_words_score_like_plain_ones(spark, model):
    bad = ["a stupid man", "a st*pid man", "a $tup1d man", "what a m0r0n", "so stuuuupid", "he is s.t.u.p.i.d", "s t u p i d he said", "such an 1DI0T!!"]
    assert min(scores(spark, model, bad)) > 0.5
    good = [None, "", "the garden is fine", "20 ships at 12.30", "the lake " * 30_000, "a b c d"]
    assert max(scores(spark, model, good)) < 0.5
    assert scores(spark, model, ["the lake " * 30_000 + "stupid"])[0] > 0.5


def test_clean_keeps_columns_and_clean_rows(spark, model):
    docs, labels = corpus(spark)
    kept = toxicity.clean(docs, model)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [*range(60), 500, 501]
    assert toxicity.clean(docs.limit(0), model).count() == 0


def test_viterbi_finds_the_cheapest_reading(model):
    language = toxicity.LanguageModel(model.counts)
    classes = toxicity._classes()

    def cost(letters):
        ids = [0, 0, *(int(classes[ord(c)]) for c in letters if c)]
        kept = [ids[0], ids[1]]
        total = 0.0
        for k in ids[2:]:
            total += language.cost[kept[-2]][kept[-1]][k]
            if k or kept[-1]:
                kept.append(k)
        return total + language.cost[kept[-2]][kept[-1]][0]

    for token in ["m0r0n", "st*p1d", "aa", "b@@k", "s.t.u", "$$a"]:
        options = list(toxicity._options(token))
        best = min(sum(p for _, p in way) + cost([c for c, _ in way]) for way in itertools.product(*options))
        got = toxicity.decode(token, language)
        reach = [way for way in itertools.product(*options) if "".join(c for c, _ in way) == got]
        assert math.isclose(min(sum(p for _, p in w) + cost([c for c, _ in w]) for w in reach), best, abs_tol=1e-4), token


def test_language_model_counts_all_texts(spark):
    docs, _ = corpus(spark)
    one, two = toxicity.gram_counts(docs), toxicity.gram_counts(docs.union(docs))
    assert one.sum() > 0 and (two == 2 * one).all()


def test_reruns_agree(spark, model):
    docs, labels = corpus(spark)
    again = toxicity.fit(docs.repartition(6), labels.repartition(3))
    assert again.numbers == model.numbers and np.array_equal(again.weights, model.weights)


def test_nothing_to_learn(spark):
    docs, labels = corpus(spark)
    for some, want in [(labels.limit(0), 0.0), (labels.where("toxic = 0"), 0.0), (labels.where("toxic = 1"), 1.0)]:
        fitted = toxicity.fit(docs, some)
        assert {r.s for r in toxicity.score(docs, fitted, result="s").select(F.round("s", 6).alias("s")).collect()} == {want}
    assert toxicity.fit(docs.limit(0), labels).numbers == {}


def test_held_out_quality(spark):
    from sightline.llm.catalog import QUERIES

    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    found = QUERIES["op9_toxicity"](spark, sf).join(labels, "doc_id").where("held_out").select("toxic", "predicted").collect()
    caught = sum(r.predicted for r in found if r.toxic) / sum(r.toxic for r in found)
    false = sum(r.predicted for r in found if not r.toxic) / sum(not r.toxic for r in found)
    assert caught > 0.8 and false < 0.01
