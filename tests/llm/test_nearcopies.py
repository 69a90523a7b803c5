import random
import tracemalloc

import numpy as np
import pytest

import corpus_pipeline
from sightline.llm import nearcopies, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def slow_shingles(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def first_of_components(texts):
    """Smallest id of each component at Jaccard >= 0.8, by comparing all."""
    sets = {i: slow_shingles(t) for i, t in texts.items()}
    label = {i: i for i in texts}
    for a in sorted(texts):
        for b in sorted(texts):
            if a < b and label[a] != label[b] and jaccard(sets[a], sets[b]) >= 0.8:
                low, high = sorted((label[a], label[b]))
                label = {i: low if x == high else x for i, x in label.items()}
    return sorted(set(label.values()))


def corpus():
    """Texts, each with copies in which a few words are changed, around similarity 0.8."""
    rng = random.Random(5)
    texts, i = {}, 0
    for base in range(30):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice((12, 40, 120, 400)))]
        for copy in range(6):
            changed = list(words)
            for at in rng.sample(range(len(words)), round(len(words) * rng.choice((0, 0.01, 0.02, 0.03, 0.05)))):
                changed[at] = f"x{base}c{copy}"
            texts[i] = " ".join(changed).upper() if copy == 5 else " ".join(changed)
            i += 1
    for extra in (None, "", " \t", "one two", "One  TWO", "one", "a a a a a a", "a a a a a", "a a a a"):
        texts[i] = extra
        i += 1
    return texts


@pytest.mark.parametrize("stage", [corpus_pipeline.drop_near_duplicates, lambda spark, docs, _: nearcopies.keep_one(docs)])
def test_pairs_like_brute_force(spark, stage):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts.items()], SCHEMA)
    kept = stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == first_of_components(texts)


def test_buckets_of_texts_that_are_not_alike(spark, monkeypatch):
    """Weak keys put everything into a few buckets, which take several turns."""
    monkeypatch.setattr(nearcopies, "CENTRES", 8)
    monkeypatch.setattr(nearcopies, "GROWTH", 4)
    texts = dict(list(corpus().items())[:36])
    docs = spark.createDataFrame([(i, t.encode()) for i, t in texts.items()], "doc_id long, text binary")
    nodes = nearcopies._nodes(docs).withColumn("keys", nearcopies.F.array(nearcopies.F.lit(1)))
    nodes = nodes.withColumn("keys", nodes["keys"].cast("array<long>"))
    found = nearcopies.roots(docs, nodes)
    groups = nodes.join(found, "node", "left").groupBy(nearcopies.F.coalesce("root", "node")).agg(nearcopies.F.min("first"))
    assert sorted(r[1] for r in groups.collect()) == first_of_components(texts)


def test_repeated_and_missing_ids(spark):
    long = " ".join(f"w{i}" for i in range(50))
    data = [(4, long), (2, long), (2, long), (2, "quite another text"), (None, long), (None, long), (7, "Quite another  text")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in data], SCHEMA)
    assert sorted(str(r.doc_id) for r in nearcopies.keep_one(docs).collect()) == ["2", "None", "None"]
    assert nearcopies.keep_one(docs.limit(0)).count() == 0


def grouped(docs, nodes):
    found = nearcopies.roots(docs, nodes)
    first = nearcopies.F.min("first")
    return sorted(r[1] for r in nodes.join(found, "node", "left").groupBy(nearcopies.F.coalesce("root", "node")).agg(first).collect())


def test_rows_of_a_bucket_that_is_not_alike(spark, monkeypatch):
    """A group at similarities around 0.72, in one bucket: every pair is decided, no table has a row per pair."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    texts = {}
    for i in range(400):
        words = list(base)
        for at in rng.sample(range(150), rng.choice((1, 4, 5, 6))):
            words[at] = f"x{rng.randrange(40)}"
        texts[i] = " ".join(words)
    docs = spark.createDataFrame([(i, t.encode()) for i, t in texts.items()], "doc_id long, text binary")
    nodes = nearcopies._nodes(docs).withColumn("keys", nearcopies.F.array(nearcopies.F.lit(1).cast("long")))
    sizes, write = [], nearcopies.cut_lineage

    def counted(table):
        out = write(table)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(nearcopies, "cut_lineage", counted)
    monkeypatch.setattr(nearcopies, "HELD", 4000)
    monkeypatch.setattr(nearcopies, "PASSED", 100)
    monkeypatch.setattr(nearcopies, "COUNTED", 5000)
    assert grouped(docs, nodes) == first_of_components(texts)
    assert max(sizes) <= 3 * len(texts)


def test_fingerprints_find_pairs_without_keys(spark):
    """SimHash alone makes candidates; they are linked by their shingles only."""
    rng = random.Random(8)
    texts = {}
    for base in range(0, 40, 2):
        words = [f"w{rng.randrange(3000)}" for _ in range(300)]
        texts[base], texts[base + 1] = " ".join(words), " ".join(words[:-1] + ["x"])
    docs = spark.createDataFrame([(i, t.encode()) for i, t in texts.items()], "doc_id long, text binary")
    nodes = nearcopies._nodes(docs)
    assert {r.first: r.fp for r in nodes.collect()} == {i: simhash.fingerprint(t.encode(), 5) for i, t in texts.items()}
    nodes = nodes.withColumn("keys", nearcopies.F.array().cast("array<long>"))
    assert grouped(docs, nodes) == first_of_components(texts) == list(range(0, 40, 2))
    one = nodes.withColumn("fp", nearcopies.F.lit(7).cast("long"))
    assert grouped(docs, one) == list(range(0, 40, 2))


def test_index_holds_little_beside_its_centres():
    """Nodes that share all their shingles with every centre are compared a few at a time."""
    shared = np.arange(20, dtype=np.uint64)
    sets = [np.append(shared, np.uint64(1000 + i)) for i in range(1200)]
    index = nearcopies._Index((0, 0, 0))
    index.hold(np.arange(400), sets[:400])
    tracemalloc.start()
    try:
        links = [*index.close(), *index.meet(np.arange(400, 1200), sets[400:])]
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(links) == 1199 and len({x for link in links for x in link}) == 1200
    assert most < 48 << 20
