from collections import Counter

from sightline.llm import urls
from sightline.llm.q_urls import RULES

SCHEMA = "page_id long, url string, filter string, h int, host string"


def pages(spark, found):
    return spark.createDataFrame([(i, u, "x", 1, "y") for i, u in enumerate(found)], SCHEMA)


def judged(spark, found, rules=RULES, **options):
    out = urls.judge(pages(spark, found), rules, result="r", **options)
    return [r.asDict() for r in out.select("page_id", "r.*").orderBy("page_id").collect()]


def test_hosts_paths_and_rules(spark):
    cases = {
        "http://A.Example.ORG/es/1": ("a.example.org", "/es/1", "example.org/es/", "block"),
        "https://example.org/en/12?x#y": ("example.org", "/en/12", "example.org/en/1", "block"),
        "https://notexample.org/es/1": ("notexample.org", "/es/1", "org/", "allow"),
        "x://b.com/de/1?q": ("b.com", "/de/1", "com/de/", "block"),
        "http://b.com/fr": ("b.com", "/fr", None, None),
        "http://b.com?x=/fr/": ("b.com", "", None, None),
        "http://b.com#/de/": ("b.com", "", None, None),
        "http://ÄB.com/fr/ü": ("Äb.com", "/fr/ü", "com/fr/", "allow"),
        "no scheme/at all": ("", "", None, None),
        None: ("", "", None, None),
        "": ("", "", None, None),
        "://": ("", "", None, None),
        "http://example.org": ("example.org", "", None, None),
        "http://b.com/de/" + "x/" * 5000: ("b.com", "/de/" + "x/" * 5000, "com/de/", "block"),
    }
    for (url, (host, path, rule, verdict)), r in zip(cases.items(), judged(spark, list(cases))):
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), url
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")


def test_numbers_become_placeholders_and_long_paths_end_in_a_wildcard(spark):
    rows = judged(spark, ["http://h.x/a/12/b.html", "http://h.x/1/2/3/4/5/6", "http://h.x//a//", "http://h.x/0123456789abcdef0"], rules=[])
    assert {r["verdict"] for r in rows} == {"allow"} and {r["template"] for r in rows} == {"/*/*/*", "/*/*/*/*", "/*"}


def test_differing_branches_keep_their_own_template(spark):
    rules = [urls.Rule("block", "h.x", "/bad/a"), urls.Rule("allow", "h.x", "/good/a")]
    seen = [f"http://h.x/{kind}/a{i}" for kind in ("bad", "good") for i in range(30)] + ["http://h.x/bad/b1", "http://h.x/good/b1", "http://h.x/new/b"]
    rows = judged(spark, seen, rules)
    assert [(r["template"], r["verdict"]) for r in rows[-3:]] == [("/bad/*", "block"), ("/good/*", "allow"), ("/*/*", "allow")]
    # Branches that do not differ are one.
    same = judged(spark, [u.replace("/good/", "/bad2/") for u in seen[:61]], [urls.Rule("block", "h.x", "/bad/a"), urls.Rule("block", "h.x", "/bad2/a")])
    assert {r["template"] for r in same} == {"/*/*"} and same[-1]["verdict"] == "block"


def test_rows_columns_and_empty_table(spark):
    frame = pages(spark, ["http://a.org/x"] * 5 + [None, None])
    out = urls.judge(frame, RULES, result="r")
    assert out.columns == [*frame.columns, "r"]
    assert Counter(r.r.verdict for r in out.collect()).total() == 7
    assert urls.judge(frame.limit(0), RULES, result="r").count() == 0
