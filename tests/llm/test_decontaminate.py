import hashlib
import re

from sightline.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEM = "one two three four five six seven eight nine ten eleven"
DOCS = [
    (1, None), (2, ""), (3, "  ...  "), (4, "x " + ITEM.upper().replace(" ", ", ") + " y"), (5, "nothing here at all"),
    (6, "a Short, ITEM ends. short item"), (6, "a Short, ITEM ends. short item"), (7, "é" * 5 + " " + ITEM[4:] + "!"),
    (8, "word " * 50_000 + ITEM), (None, "short item"), (9, "one two three four five six seven eight nine"),
    (10, "same same same same same same same same same same same same"),
]
ITEMS = [(10, ITEM), (9, "Short item"), (2, "short ITEM"), (3, None), (4, "..."), (None, "nothing here"), (5, "same " * 10)]


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def brute(text):
    w, hit, ids = words(text), set(), set()
    for item, body in ITEMS:
        v = words(body)
        if item is None or not v:
            continue
        size = min(10, len(v))
        grams = {tuple(v[i : i + size]) for i in range(len(v) - size + 1)}
        for i in range(len(w) - size + 1):
            if tuple(w[i : i + size]) in grams:
                hit |= set(range(i, i + size))
                ids.add(str(item))
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def frames(spark):
    docs = spark.createDataFrame([(i, t, "mine", 7) for i, t in DOCS], "doc_id long, text string, contamination string, n_hit int")
    return docs, spark.createDataFrame(ITEMS, "item_id long, text string")


def test_counts_are_those_of_brute_force(spark):
    docs, items = frames(spark)
    found = decontaminate.scan(docs, items, result="r").select("doc_id", "text", "r.*").collect()
    assert len(found) == len(DOCS)
    for r in found:
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == brute(r.text)


def test_spans_point_into_the_original(spark):
    docs, items = frames(spark)
    found = {r.doc_id: r for r in decontaminate.scan(docs, items, result="r").select("doc_id", "text", "r.*").collect()}
    assert [found[4].text[s.start : s.end] for s in found[4].spans] == [ITEM.upper().replace(" ", ", ")]
    assert [found[7].text[s.start : s.end] for s in found[7].spans] == [ITEM[4:]]
    assert [found[6].text[s.start : s.end] for s in found[6].spans] == ["Short, ITEM", "short item"]
    assert found[1].spans == [] and found[2].n_words == 0


def test_clean_keeps_columns_and_clean_rows(spark):
    docs, items = frames(spark)
    kept = decontaminate.clean(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 5, 9]


def test_empty_tables(spark):
    docs, items = frames(spark)
    assert decontaminate.clean(docs.limit(0), items).count() == 0
    assert decontaminate.clean(docs, items.limit(0)).count() == len(DOCS)
