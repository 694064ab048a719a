import random

import pytest

from corpusloom.llm import url_filter
from corpusloom.llm.url_filter import bloom_blocks, canonical_url, judge_urls
from pyspark.sql import functions as F

ENTRIES = "host string, path string, action string, ruled boolean"
RULES = [("com", "/en/", "block", True), ("example.com", "/en/7", "allow", True), ("net", "/de/", "allow", True), ("example.net", "/de/8", "block", True), ("spam.org", "", "block", False), ("a.org", "/page?x=1", "block", False), (None, "/x", "block", True)]
CASES = {
    "https://example.com/en/712?q#f": ("example.com", "/en/712", "example.com/en/7", "allow"), "http://WWW.Example.COM/en/812": ("www.example.com", "/en/812", "com/en/", "block"),
    "https://x.example.net/de/8": ("x.example.net", "/de/8", "example.net/de/8", "block"), "https://x.net/de/": ("x.net", "/de/", "net/de/", "allow"), "https://net/de": ("net", "/de", None, "allow"),
    "https://deep.spam.org": ("deep.spam.org", "", None, "block"), "https://notspam.org/": ("notspam.org", "/", None, "allow"), "no scheme/en/": ("", "", None, "allow"), "": ("", "", None, "allow"), None: ("", "", None, "allow"),
    "https://a.org/page/?utm_source=z&x=1#t": ("a.org", "/page/", None, "block"), "a://b://com/en/": ("b:", "//com/en/", None, "allow"), "https://?x": ("", "", None, "allow"), "x://com/en/\nline": ("com", "/en/\nline", "com/en/", "block"),
    "https://com/en/" + "a" * 50000: ("com", "/en/" + "a" * 50000, "com/en/", "block"),
}


@pytest.mark.parametrize("bound", [200_000, 0])
def test_cases_by_broadcast_and_by_shuffles(spark, monkeypatch, bound):
    monkeypatch.setattr(url_filter, "BROADCAST_KEYS", bound)
    rows = [(i, u, "x") for i, u in enumerate(CASES)] * 2
    got = judge_urls(spark.createDataFrame(rows, "page_id bigint, url string, verdict string"), spark.createDataFrame(RULES, ENTRIES)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == CASES[r["url"]]


def test_empty_list_empty_table_and_opposed_entries(spark):
    pages = spark.createDataFrame([(1, "https://com/en/")], "page_id bigint, url string")
    none = spark.createDataFrame([], ENTRIES)
    assert judge_urls(pages, none).first()["verdict"] == "allow" and judge_urls(pages.limit(0), spark.createDataFrame(RULES, ENTRIES)).collect() == []
    both = spark.createDataFrame([("com", "/en/", "allow", True), ("com", "/en/", "block", True)], ENTRIES)
    assert judge_urls(pages, both).first()["verdict"] == "block"


def test_filter_holds_every_key_and_few_others(spark):
    rnd = random.Random(0)
    keys = spark.createDataFrame([(f"k{i}",) for i in range(3000)], "key string")
    blocks = 256
    rows = {r["block"]: r for r in bloom_blocks(keys, blocks).collect()}

    def passes(frame):
        h = F.xxhash64("key")
        got = frame.select(url_filter._block(h, blocks).alias("b"), *(url_filter._mask(h, i).alias(f"m{i}") for i in range(4))).collect()
        return sum(all(rows[r["b"]][f"w{i}"] & r[f"m{i}"] for i in range(4)) for r in got if r["b"] in rows)

    assert passes(keys) == 3000
    others = spark.createDataFrame([(f"other{rnd.random()}",) for _ in range(5000)], "key string")
    assert passes(others) < 150


def test_canonical_urls(spark):
    urls = ["http://www.A.com:80/p/?b=2&utm_x=1&a=1#f", "https://a.com/p?a=1&b=2", "https://a.com:443/p/?ref=q&a=1&b=2"]
    got = {r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(canonical_url(F.col("u"))).collect()}
    assert got == {"a.com/p?a=1&b=2"}


def test_rules_take_hosts_with_their_ports_and_other_entries_without(spark):
    rows = [("http://example.com:80/en/7", None, "allow"), ("http://example.net:80/de/8", None, "allow"), ("https://com:443/en/", None, "allow"), ("https://example.com:8080/en/7", None, "allow"), ("http://example.com/en/7", "example.com/en/7", "allow")]
    rows += [("http://spam.org:80/x", None, "block"), ("http://www.spam.org:443", None, "block"), ("http://spam.org:8080/x", None, "allow"), ("http://WWW.a.org:80/page?x=1&ref=2", None, "block")]
    got = judge_urls(spark.createDataFrame([(u, 1, 2) for u, _, _ in rows], "url string, raw int, key int"), spark.createDataFrame(RULES, ENTRIES)).collect()
    assert {(r["url"], r["rule"], r["verdict"]) for r in got} == set(rows) and all(":" in r["host"] for r in got if ":80" in r["url"] or ":443" in r["url"])


def test_a_rule_and_another_entry_of_one_key(spark):
    both = spark.createDataFrame([("com", "/en/", "allow", True), ("com", "/en/", "block", False)], ENTRIES)
    urls = spark.createDataFrame([("http://com/en/",), ("http://com:80/en/",)], "url string")
    assert [(r["rule"], r["verdict"]) for r in judge_urls(urls, both).orderBy("url").collect()] == [("com/en/", "allow"), (None, "block")]


@pytest.mark.parametrize("blocks", [1, 4])
def test_a_filter_that_is_too_small_loses_nothing(spark, monkeypatch, blocks):
    monkeypatch.setattr(url_filter, "MAX_BLOCKS", blocks)
    entries = spark.createDataFrame([(f"h{i}.com", "", "block", False) for i in range(500)], ENTRIES)
    got = judge_urls(spark.createDataFrame([(f"https://h{i}.com/x",) for i in range(1000)], "url string"), entries)
    assert {r["url"] for r in got.where("verdict = 'block'").collect()} == {f"https://h{i}.com/x" for i in range(500)}


def test_the_sql_agrees_on_ports(spark, tmp_path):
    import duckdb

    from corpusloom.llm import queries

    urls = ["http://example.com:80/en/7", "http://example.net:443/de/8", "http://casino-win.example.net:80/de/", "http://x.casino-win.example.net:443", "http://casino-win.example.net:81/", "https://example.com/en/7", None, "plain"]
    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], "page_id bigint, url string, html string")
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    duckdb.sql(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    expected = sorted(duckdb.sql(queries.ORACLES["op9_url_filter"]).fetchall(), key=str)
    assert sorted((tuple(r) for r in queries.QUERIES["op9_url_filter"](spark, str(tmp_path)).collect()), key=str) == expected


def test_columns_of_any_name_stay(spark):
    names = ["url", "__u", "__rule", "__action", "u", "b", "key", "row", "action", "a.b"]
    pages = spark.createDataFrame([("http://a.com/x", *"123456789"), (None, *"abcdefghi")], ", ".join(f"`{n}` string" for n in names))
    entries = spark.createDataFrame([("a.com", "/x", "block", True)], "host string, path string, action string, ruled boolean")
    got = judge_urls(pages, entries)
    assert got.columns == [*names, "host", "path", "rule", "verdict"]
    assert {tuple(r) for r in got.collect()} == {("http://a.com/x", *"123456789", "a.com", "/x", "a.com/x", "block"), (None, *"abcdefghi", "", "", None, "allow")}
