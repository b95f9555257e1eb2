from helpers import by_id

from sluice.llm.url_filter import RULES, url_filter

SCHEMA = "page_id long, url string, host string, rule string, digest string"


def run(spark, urls, rules=RULES, **kw):
    pages = spark.createDataFrame([(i, u, "h", "r", "d") for i, u in enumerate(urls)], SCHEMA)
    table = spark.createDataFrame(list(rules), "host string, path string, verdict string")
    got = by_id(url_filter(pages, table, **kw), "page_id")
    return [tuple(got[i][0])[1:] for i in range(len(urls))]


def test_rules(spark):
    assert run(spark, ["http://A.Example.ORG/en/12?x#y", "https://example.org/es/", "https://example.org/es", "http://x.org",
                       "http://fr.com/fr/1", "http://com/de/#", "http://notexample.org.net/es/", "http://badexample.org/es/1"]) == [
        ("a.example.org", "/en/12", "example.org/en/1", "block"), ("example.org", "/es/", "example.org/es/", "block"),
        ("example.org", "/es", "org/", "allow"), ("x.org", "", None, "allow"), ("fr.com", "/fr/1", "com/fr/", "allow"),
        ("com", "/de/", "com/de/", "block"), ("notexample.org.net", "/es/", None, "allow"), ("badexample.org", "/es/1", "org/", "allow")]


def test_edges(spark):
    long = "http://" + "a." * 3000 + "com/de/" + "x/" * 5000
    got = run(spark, [None, "", "example.org/es/", "http://?q=http://x.org/", "ftp://com/de/://y", long], default="block")
    assert got[:5] == [("", "", None, "block"), ("", "", None, "block"), ("", "", None, "block"), ("", "", None, "block"),
                       ("com", "/de/://y", "com/de/", "block")]
    assert got[5][2:] == ("com/de/", "block")


def test_no_rules_ties_and_empty_tables(spark):
    assert run(spark, ["http://x.org/"], rules=[]) == [("x.org", "/", None, "allow")]
    assert run(spark, ["http://x.org/"] * 2, rules=[("org", "/", "allow"), ("org", "/", "block")]) == [("x.org", "/", "org/", "block")] * 2
    assert run(spark, []) == []


def test_short_prefix_is_confirmed(spark):
    assert run(spark, ["http://x.org/", "http://y.net/"], prefix_chars=0) == [("x.org", "/", "org/", "allow"), ("y.net", "/", None, "allow")]
