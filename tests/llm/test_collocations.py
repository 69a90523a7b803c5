"""Summaries against exact counts, and the operator against brute force on small corpora."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from sightline.llm import collocations as c
from sightline.llm import ngrams


def brute(rows, threshold=30, longest=4, top=2000):
    f, words = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        for piece in re.split("[.,;:!?\n-\r]", text):
            w = re.findall("[^ \t]+", piece)
            words[lang] += len(w)
            for n in range(1, longest + 1):
                for i in range(len(w) - n + 1):
                    f[lang][tuple(w[i : i + n])] += 1
    out = set()
    for lang, counts in f.items():
        found = []
        for p, a in counts.items():
            if len(p) < 2 or a < threshold:
                continue
            outer = max(
                (b for q, b in counts.items() if len(q) > len(p) and b >= threshold and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))),
                default=0,
            )
            if outer and 100 * outer >= 80 * a:
                continue
            score, k = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, l, r, words[lang], -score))
    return out


def corpus(seed, n=120):
    draw = random.Random(seed)
    vocabulary = ["the", "Red", "fox", "été", "a\x00b", "中文", "x-y", "new york", "of  the", "\tcity"]
    rows = [(draw.choice(["en", "en", "en", "fr", None, "und"]), " ".join(draw.choice(vocabulary) + draw.choice(["", "", "", ".", ",\n"]) for _ in range(40))) for _ in range(n)]
    return [*rows, ("en", None), ("en", ""), (None, " .. \t "), *[("fr", "same row twice")] * 35]


def test_against_brute_force(spark):
    rows = corpus(1, 800)
    df = spark.createDataFrame([(i, lang, text, "x") for i, (lang, text) in enumerate(rows)], "doc_id long, lang string, text string, phrase string")
    got = {tuple(r) for r in c.mine(df).collect()}
    assert got == brute(rows) and len(got) > 50


def test_top_and_threshold(spark):
    rows = corpus(2)
    df = spark.createDataFrame(rows, "lang string, text string")
    assert {tuple(r) for r in c.mine(df, threshold=7, longest=3, top=9).collect()} == brute(rows, 7, 3, 9)


def test_empty(spark):
    df = spark.createDataFrame([], "lang string, text string")
    assert c.mine(df).count() == 0
    assert c.mine(spark.createDataFrame([(None, None)], "lang string, text string")).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_summary_keeps_what_is_frequent(seed):
    draw = np.random.default_rng(seed)
    items = np.minimum(draw.zipf(1.3, 60_000), 20_000).astype(np.uint32)
    summary = c.Summary(len(items) // 30 // 3, 30)  # a third of what the mass asks for: it has to grow
    for part in np.array_split(items, 40):
        keys, counts = np.unique(part, return_counts=True)
        summary.add(*c.unpack(c.pack(keys, counts), len(keys)))
    keys, counts = np.unique(items, return_counts=True)
    kept = set(summary.survivors().tolist())
    assert set(keys[counts >= 30].tolist()) <= kept
    assert summary.taken_off < 30 and len(kept) <= summary.capacity
    left = dict(zip(summary.keys.tolist(), summary.counts.tolist()))
    assert all(n - summary.taken_off <= left.get(k, 0) <= n for k, n in zip(keys.tolist(), counts.tolist()))


def test_chunks_keep_pieces_whole(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(ngrams, "CHUNK", 16)
    text = "a b c.d e f g h i j k,l\n" * 9 + "long run without any break at all " * 5
    batch = pa.record_batch([["en"], [text.encode()]], ["g", "t"])
    got = Counter()
    for chunk in ngrams.chunks(iter([batch])):
        for n in (1, 3):
            got.update(chunk.phrase(i, n) for i in chunk.starts(n).tolist())
    want = Counter()
    for piece in re.split("[.,\n]", text):
        w = piece.encode().split()
        for n in (1, 3):
            want.update(b" ".join(w[i : i + n]) for i in range(len(w) - n + 1))
    assert got == want


def test_equal_hashes_change_nothing(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(ngrams.xxhash, "xxh64_intdigest", lambda *a: 7)
    rows = pa.record_batch([["en"], [b"a b a b c"]], ["g", "t"])

    class Held:
        value = b"\xff" * 8

    out = Counter()
    for batch in c._totals(1)(c._counts(Held, 1, 64, 2, 3)(iter([rows]))):
        for n, phrase, f in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
            out[n, phrase] += f
    assert out == {(0, b""): 5, (1, b"a"): 2, (1, b"b"): 2, (1, b"c"): 1, (2, b"a b"): 2, (2, b"b a"): 1, (2, b"b c"): 1}


def test_large_products(spark):
    big = 4 * 10**18
    rows = [("en", 1, "a", big), ("en", 1, "b", big), ("en", 2, "a b", big), ("en", 0, "", big)]
    df = spark.createDataFrame(rows, "group string, n int, phrase string, f long")
    assert c.scored(df).first()["score"] == 1_000_000
