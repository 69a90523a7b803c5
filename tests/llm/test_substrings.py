import hashlib
import random
from collections import Counter

import pytest

from sightline.llm import substrings

SEPARATORS = " \t\n\x0b\x0c\r"


def words(text):
    for s in SEPARATORS[1:]:
        text = (text or "").replace(s, " ")
    return [w for w in text.split(" ") if w]


def brute(rows, window):
    """(id, words, removed, kept) of every row, comparing all windows."""
    first = {}
    key = lambda i: (i is None, i or 0)
    for i, t in rows:
        w = words(t)
        for p in range(len(w) - window + 1):
            g = tuple(w[p : p + window])
            first[g] = min(first.get(g, (key(i), p)), (key(i), p))
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < (key(i), p):
                gone |= set(range(p, p + window))
        out.append((str(i), len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return sorted(out)


def found(spark, rows, window, **options):
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, d int")
    texts = {hashlib.sha256(" ".join(words(t)).encode()).digest(): " ".join(words(t)) for _, t in rows}
    got = substrings.repeats(docs, window=window, **options).collect()
    return sorted((str(r.doc_id), r.n_words, r.n_removed, texts[bytes(r.sha)] if r.kept is None else r.kept) for r in got)


def made(seed, n=60, vocabulary=60):
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(vocabulary)] + ["é", "a\x01", "a", "a\x1c"]
    passages = [" ".join(rng.choices(pool, k=rng.randint(5, 40))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [" ".join(rng.choices(pool, k=rng.randint(0, 30))) if rng.random() < 0.6 else rng.choice(passages) for _ in range(rng.randint(0, 6))]
        rows.append((rng.randint(0, 2 * n), rng.choice([" ", "\n", "\t "]).join(parts)))
    return rows


ODD = [
    (1, None), (2, ""), (3, " \n\t"), (4, "x"), (5, "la " * 50), (6, "la " * 30), (7, "a b " * 40), (None, "la " * 40),
    (None, "b a " * 25), (8, "one two three " * 9), (8, "one two three " * 9), (8, "two three one " * 9), (9, "y " + "z" * 5000 + " y " * 30),
    (10, "p q r s t u v w x y z"), (0, "p q r s t u v w x y z"),
]


@pytest.mark.parametrize("seed", [1, 2])
def test_like_brute_force(spark, seed):
    rows = made(seed) + ODD
    assert found(spark, rows, 8) == brute(rows, 8)


def test_production_window(spark):
    rows = made(3, n=80) + [(500 + i, " ".join(f"k{j}" for j in range(i, 60 + i))) for i in range(5)] + ODD
    assert found(spark, rows, 20) == brute(rows, 20)


def test_frequent_prefixes_grow_to_the_window(spark, monkeypatch):
    monkeypatch.setattr(substrings, "GROUP", 2)
    rows = made(4) + ODD
    assert found(spark, rows, 8) == brute(rows, 8)


def test_anchors_do_not_depend_on_chunks(monkeypatch):
    texts = [" ".join(words(t)).encode() for _, t in made(5) + ODD]
    runs = lambda some: [(int(f), int(z), int(h)) for f, z, h in zip(some.first, some.last, some.anchor)]
    alone = [runs(substrings.Stretches([t], 8)) for t in texts]
    whole = substrings.Stretches(texts, 8)
    assert runs(whole) == [r for part in alone for r in part]
    monkeypatch.setattr(substrings, "BYTES", 64)
    assert runs(substrings.Stretches(texts[:-4], 8)) == [r for part in alone[:-4] for r in part]
    monkeypatch.setattr(substrings, "CHUNK", 300)
    cut = [r for _, _, part in substrings._chunks(texts[:-4], 8) for r in runs(part)]
    assert cut == [r for part in alone[:-4] for r in part]


def test_equal_windows_have_equal_anchors():
    texts = [" ".join(words(t)).encode() for _, t in made(8) + ODD]
    runs, seen = substrings.Stretches(texts, 8), {}
    for text, first, last, anchor in zip(runs.text, runs.first, runs.last, runs.anchor):
        for start in range(first, last + 1):
            assert seen.setdefault(runs.words(text, start, start + 8), anchor) == anchor


def test_short_windows_and_digests(spark):
    rows = made(6, n=20)
    assert found(spark, rows, 3) == brute(rows, 3)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.n_removed, r.kept or bytes(r.sha).hex()) for r in substrings.repeats(docs, window=8, digest_only=True).collect())
    assert got == Counter((r[2], hashlib.sha256(r[3].encode()).hexdigest()) for r in brute(rows, 8))


def test_dedup_keeps_columns_and_untouched_texts(spark):
    rows = made(7, n=30) + ODD
    docs = spark.createDataFrame([(i, t, "c", 2, "s", "o") for i, t in rows], "doc_id long, text string, sha string, kept int, _sha string, own_sha string")
    out = substrings.dedup(docs, window=8)
    assert out.columns == docs.columns
    assert {(r.sha, r.kept, r["_sha"], r.own_sha) for r in out.collect()} == {("c", 2, "s", "o")}
    got = sorted((str(r.doc_id), r.text or "") for r in out.collect())
    texts = {(str(i), " ".join(words(t))): t or "" for i, t in rows}
    want = sorted((d, kept if removed else texts[d, kept]) for d, _, removed, kept in brute(rows, 8))
    assert [(d, words(t)) for d, t in got] == [(d, words(t)) for d, t in want]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert substrings.repeats(docs).count() == 0


def rare_anchor():
    """Four words whose hash is smaller than that of about a million others."""
    import numpy as np

    pool = [f"a{i}".encode() for i in range(40)]
    joined = b" ".join(pool)
    ends = np.cumsum([len(w) + 1 for w in pool]) - 1
    ids = substrings._word_hashes(joined, np.concatenate(([0], ends[:-1] + 1)), ends)
    at = np.stack(np.meshgrid(*[np.arange(40)] * 4, indexing="ij")).reshape(4, -1)
    grams = substrings._mix(sum(ids[at[j]] * substrings._ODD[j] for j in range(4)))
    return [pool[i].decode() for i in at[:, int(grams.argmin())]]


def test_run_of_more_than_65535_windows(spark):
    """All windows differ and share one anchor: nothing may go, but for a planted repeat."""
    anchor, fill = rare_anchor(), iter(range(10**6))
    text = [w for _ in range(5000) for w in [*anchor, *(f"n{next(fill)}" for _ in range(13))]]
    runs = substrings.Stretches([" ".join(text).encode()], 20)
    assert len(set(runs.anchor.tolist())) == 1
    copy = text[40_000:40_030]
    rows = [(1, " ".join(text)), (2, " ".join([*copy, "end"])), (3, "other words only " * 2)]
    assert found(spark, rows, 20) == [("1", 85_000, 0, rows[0][1]), ("2", 31, 30, "end"), ("3", 6, 0, rows[2][1].strip())]


@pytest.mark.parametrize("start, n", [(0, 1), (0, 65_536), (70_000, 1 << 20), ((1 << 31) - 1, (1 << 31) - 1)])
def test_packed_runs(start, n):
    assert substrings.unpacked(substrings.packed(start, n)) == slice(start, start + n)


def test_many_rows_without_an_id(spark):
    rows = [(None, f"{i} " + " ".join(f"v{j}" for j in range(i, i + 30))) for i in range(300)]
    assert found(spark, rows, 20) == brute(rows, 20)
