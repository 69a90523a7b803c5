import random

import numpy as np
import xxhash

from sightline.llm import simhash
from sightline.llm.components import components
from sightline.session import cut_lineage

UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def slow_fingerprint(text, size=3):
    words = (text or "").encode().translate(UPPER).split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    counts = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g, 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(grams))


def linked(values, distance):
    """Value -> smallest value of its component, by comparing all."""
    label = {v: v for v in values}
    changed = True
    while changed:
        changed = False
        for a in values:
            for b in values:
                if bin(a ^ b).count("1") <= distance and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


def test_fingerprints():
    for text in [None, "", " \t ", "One", "one TWO", "a b c", "A b\x0bc d " * 40, "é ñ ü ß", "x\x1cy z \x85 q"]:
        assert simhash.fingerprint(None if text is None else text.encode()) % (1 << 64) == slow_fingerprint(text)


def test_masks_catch_every_difference():
    rng = random.Random(1)
    for distance in (1, 2, 3, 5):
        below = simhash.masks(0, distance)
        deeper = simhash.masks(below[3], distance)
        for _ in range(300):
            a = rng.getrandbits(64)
            b = a
            for bit in rng.sample(range(64), distance):
                b ^= 1 << bit
            assert any((a ^ b) & m == 0 for m in below)
            if (a ^ b) & below[3] == 0:
                assert any((a ^ b) & m == 0 for m in deeper)


def check_links(spark, values, distance):
    nodes = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    edges = [(a % (1 << 64), b % (1 << 64)) for a, b in simhash.links(nodes, distance).collect()]
    got = {v: v for v in values}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if got[a] != got[b]:
                got[a] = got[b] = min(got[a], got[b])
                changed = True
    assert got == linked(values, distance)
    return edges


def near(rng, base, n, bits):
    out = set()
    while len(out) < n:
        v = base
        for bit in rng.sample(range(64), bits):
            v ^= 1 << bit
        out.add(v)
    return out


def test_links_like_brute_force(spark):
    rng = random.Random(2)
    values = {rng.getrandbits(64) for _ in range(40)} | {0, (1 << 64) - 1}
    for _ in range(6):
        values |= near(rng, rng.getrandbits(64), 12, rng.randint(1, 3))
    for distance in (2, 3, 5):
        check_links(spark, sorted(values), distance)


def test_crowded_buckets_split(spark, monkeypatch):
    """Many fingerprints share a segment: hot segments skip a level, large runs go deeper."""
    monkeypatch.setattr(simhash, "BUCKET", 8)
    monkeypatch.setattr(simhash, "SMALL", 4)
    rng = random.Random(3)
    values = {0xABCDEF0123456789 ^ rng.getrandbits(31) for _ in range(60)} | near(rng, 0xABCDEF0123456789, 40, 1)
    edges = check_links(spark, sorted(values), 2)
    assert len(set(edges)) < len(values) * 20


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(60)]
    star = [(1000, 1001 + i) for i in range(60)]
    frame = spark.createDataFrame(chain + star + chain[:3] + [(5000, 5000)], "a long, b long")
    found = {r.node: r.root for r in components(frame, "a", "b").collect()}
    assert set(found) == set(range(61)) | set(range(1000, 1061))
    assert len({found[i] for i in range(61)}) == 1 and len({found[i] for i in range(1000, 1061)}) == 1
    assert components(frame.limit(0), "a", "b").count() == 0


def estimated(frame):
    """Spark's estimate of the size of a table, as text; Python converts no number of so many digits."""
    return frame._jdf.queryExecution().optimizedPlan().stats().simpleString()


def test_estimates_do_not_grow_with_the_rounds(spark):
    """Spark estimates joins as products and checkpoints keep that: the driver's memory went into the digits."""
    frame = spark.range(400).selectExpr("id a", "id + 1 b")
    found = components(frame, "a", "b")
    assert estimated(found) == "sizeInBytes=8.0 EiB"
    assert found.count() == 401 and found.select("root").distinct().count() == 1


def test_checkpoints_keep_rows_partitions_and_small_estimates(spark):
    small = cut_lineage(spark.range(10).selectExpr("id", "cast(id as string) s"))
    assert "EiB" not in estimated(small)
    other = small.selectExpr("id", "s r")
    for _ in range(12):
        other = other.join(small.select("id"), "id")
    dealt = other.crossJoin(small.selectExpr("id n")).repartition(3, "n").sortWithinPartitions("n")
    made = cut_lineage(dealt)
    assert estimated(made) == "sizeInBytes=8.0 EiB"
    assert made.schema == dealt.schema and sorted(made.collect()) == sorted(dealt.collect())
    assert made.rdd.getNumPartitions() == 3
    assert made.join(small, "id").count() == 100


BASE = " ".join(f"w{i * i % 97} v{i}" for i in range(150))
DOCS = [
    (4, BASE), (2, BASE), (2, BASE), (9, BASE.upper()), (7, "quite another text of some words"), (8, None), (5, ""), (6, " \n"),
    (None, BASE), (None, "alone and without an id"), (3, "w " * 30_000), (11, "short"), (12, "Short"),
]


def test_documents_like_brute_force(spark):
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in DOCS], "doc_id long, text string, fp int, root string")
    found = simhash.near_duplicates(docs).collect()
    assert len(found) == len(DOCS)
    values = {slow_fingerprint(t) for _, t in DOCS}
    label = linked(sorted(values), 2)
    smallest = {}
    for i, t in DOCS:
        key = label[slow_fingerprint(t)]
        ids = [x for x in (i, smallest.get(key)) if x is not None]
        smallest[key] = min(ids) if ids else None
    want = sorted((str(i), slow_fingerprint(t), str(smallest[label[slow_fingerprint(t)]])) for i, t in DOCS)
    assert sorted((str(r.doc_id), r.fp % (1 << 64), str(r.component_id)) for r in found) == want


def test_keep_one(spark):
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in DOCS], "doc_id long, text string, keeper int, root string")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["11", "2", "3", "5", "7", "None", "None"]
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_streamed_runs_may_cross_batches():
    rng = np.random.default_rng(4)
    mask = np.full(400, np.uint64(0xFFFFFFFF00000000))
    value = np.repeat(rng.integers(0, 1 << 32, 8, dtype=np.uint64) << np.uint64(32), 50)
    fps = value | np.tile(np.arange(50, dtype=np.uint64), 8)
    order = np.argsort(fps)
    whole, cut = simhash._Runs(1), simhash._Runs(1)
    edges = [p for p in whole.feed(mask, fps[order])] + list(whole.end())
    parts = [p for i in range(0, 400, 33) for p in cut.feed(mask[i : i + 33], fps[order][i : i + 33])] + list(cut.end())
    pairs = lambda found: {(int(a), int(b)) for _, x, y in found for a, b in zip(x, y)}
    assert pairs(edges) == pairs(parts) and len(pairs(edges)) == 8 * 49
