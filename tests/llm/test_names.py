"""Given columns named like results or helpers: results replace none of them, helpers pass by."""

import pytest
from pyspark.sql import functions as F

from sightline.llm import decontaminate, language, mixing, quality, substrings, topk, urls
from sightline.llm.q_urls import RULES

HELPERS = ["id", "d", "h", "p", "v", "q", "sha", "_sha", "own_sha", "kept", "words", "block", "rank", "running", "plan", "part", "share", "group", "n", "f"]


def docs(spark, *more):
    row = [(i, f"Some words of text number {i} that go on a little " * 3, "en", "s1", 9) for i in range(4)]
    df = spark.createDataFrame(row, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(f"given {c}") for c in (*HELPERS, *more)})


def operators(spark):
    benchmark = spark.createDataFrame([(1, "nothing of the kind")], "item_id long, text string")
    return {
        "contamination": lambda df, **o: decontaminate.scan(df, benchmark, **o),
        "quality": lambda df, **o: quality.score(df, None, **o),
        "language": lambda df, **o: language.predict(df, language.fit(df), **o),
        "mix": lambda df, **o: mixing.draw(df, **o),
        "filter": lambda df, **o: urls.judge(df.withColumn("url", F.lit("http://a.org/x")), RULES, **o).drop("url"),
    }


@pytest.mark.parametrize("result", ["contamination", "quality", "language", "mix", "filter"])
def test_results_and_helpers(spark, result):
    run = operators(spark)[result]
    given = docs(spark, result.upper())
    with pytest.raises(ValueError, match=f"(?i){result}"):
        run(given, result=result)
    out = run(given, result="free")
    assert out.columns == [*given.columns, "free"]
    for row in out.collect():
        assert all(row[c] == f"given {c}" for c in (*HELPERS, result.upper()))


def test_dedup_and_top_k(spark):
    out = substrings.dedup(docs(spark), window=8).collect()
    assert len(out) == 4 and all(r[c] == f"given {c}" for r in out for c in HELPERS)
    vectors = docs(spark).withColumn("vec_id", F.col("doc_id")).withColumn("embedding", F.array(F.lit(1.0), F.col("doc_id").cast("double")))
    assert topk.top_k(vectors, F.col("vec_id") == 0).count() == 3
