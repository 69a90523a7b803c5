"""Token ids against the library on whole texts and against the merges done by hand."""

import hashlib
import random

import public_tokenizers as P
import pytest
import regex
from pyspark.sql import Row

from conftest import SF
from sightline.llm import bpe
from sightline.llm.catalog import QUERIES

RAW = bpe.read_rank_file(P.path("byte_bpe_multi_50k.tiktoken"))
RANKS = bpe.load_ranks(RAW)
CODER = bpe.encoding(RAW, P.PATTERN)


def by_hand(text):
    """Split by the pattern; in each match join the pair of lowest rank, leftmost first."""
    ids = []
    for match in regex.findall(P.PATTERN, text):
        piece = match.encode()
        parts = [piece] if piece in RANKS else [piece[i : i + 1] for i in range(len(piece))]
        while True:
            pairs = [(RANKS.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            if not pairs or min(pairs)[0] == 1 << 60:
                break
            i = min(pairs)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        ids += [RANKS[p] for p in parts]
    return ids


def noise(seed, n):
    draw = random.Random(seed)
    kinds = ["  ", " ", "\n", "\t ", "don't", "'s", "'", "été", "中文", "　", "\xa0", "🙂", "12", "x", "Zeit", "...", "\x1c", "́"]
    return "".join(draw.choice(kinds) for _ in range(n))


@pytest.mark.parametrize("seed", range(5))
def test_parts_encode_as_the_whole(seed, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK", 7)
    monkeypatch.setattr(bpe, "_LONG_SPACE", bpe.re.compile(f"[{bpe.SPACE}]{{3,}}"))
    text = noise(seed, 400)
    assert len(list(bpe.cuts(text))) > 5
    assert "".join(part for _, part in bpe.cuts(text)) == text
    assert bpe.encode_text(CODER, text) == CODER.encode_ordinary(text) == by_hand(text)


@pytest.mark.parametrize("text", ["a" + " " * 300_000 + "b", "\n" * 250_000, " " * 5000 + "\n" + "x", "word " * 9000 + " " * 4096])
def test_long_space(text):
    ids = bpe.encode_text(CODER, text)
    assert CODER.decode_bytes(ids).decode() == text
    if len(text) < 60_000:
        assert ids == CODER.encode_ordinary(text)
    else:
        run = max(bpe._LONG_SPACE.finditer(text), key=lambda m: len(m[0]))
        ends = run.end() - (run.end() < len(text))
        head = CODER.encode_ordinary(text[: run.start()])
        assert ids == head + CODER._encode_single_piece(text[run.start() : ends].encode()) + CODER.encode_ordinary(text[ends:])


def test_odd_rows(spark):
    texts = [None, "", "a", "a", "été 🙂", "x" * 100_000, "<|endoftext|>"]
    df = spark.createDataFrame([Row(doc_id=None if i == 2 else i, text=t, raw="given") for i, t in enumerate(texts)])
    out = bpe.decode(bpe.encode(df, RAW, P.PATTERN), RAW, P.PATTERN, raw="back").collect()
    assert len(out) == len(texts)
    for row in out:
        assert row["raw"] == "given" and bytes(row["back"]).decode() == (row["text"] or "")
        assert row["ids"] == (CODER.encode_ordinary(row["text"]) if row["text"] else [])
    with pytest.raises(ValueError, match="raw"):
        bpe.decode(bpe.encode(df, RAW, P.PATTERN), RAW, P.PATTERN)
    with pytest.raises(ValueError, match="IDS"):
        bpe.encode(df, RAW, P.PATTERN, ids="IDS").transform(lambda x: bpe.encode(x, RAW, P.PATTERN, ids="IDS"))
    assert bpe.encode(df.limit(0), RAW, P.PATTERN).count() == 0


def test_broken_text_and_ids(spark):
    df = spark.sql("select cast(x'61ff62' as string) as text")
    row = bpe.encode(df, RAW, P.PATTERN).first()
    assert row["ids"] == CODER.encode_ordinary("a�b")
    assert bpe.decode(spark.sql("select cast(null as array<int>) as ids"), RAW, P.PATTERN).first()["raw"] is None
    half = CODER.encode_ordinary("🙂")[:1]
    assert bytes(bpe.decode(spark.createDataFrame([(half,)], "ids array<int>"), RAW, P.PATTERN).first()["raw"]) == CODER.decode_bytes(half)


def test_query_against_the_library(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = QUERIES["op12_bpe"](spark, SF).collect()
    assert len(found) == len(docs)
    for row in found:
        ids = CODER.encode_ordinary(docs[row["doc_id"]])
        text = ",".join(map(str, ids)).encode()
        assert row["n_tokens"] == len(ids) and row["ids_sha256"] == hashlib.sha256(text).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(docs[row["doc_id"]].encode()).hexdigest()
