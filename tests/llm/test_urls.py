import random
import re

from sheetlark.llm import urls
from sheetlark.llm.queries import RULES

SCHEMA = "page_id long, url string, host string, rule string"


def brute(url, rules, hosts):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    under = lambda h: host == h or host.endswith("." + h)
    fit = sorted(((len(h) + len(p), len(h), a == "block", h + p) for a, h, p in rules if h and under(h) and path.startswith(p)), reverse=True)
    listed = any(under(h) for h in hosts if h)
    if fit:
        return host, path, fit[0][3], "block" if fit[0][2] else "allow", listed
    return host, path, None, "block" if listed else "allow", listed


def check(spark, table, rules, hosts, **options):
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in table], SCHEMA).repartition(3)
    got = urls.filter_urls(df, rules, hosts, **options)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict", "listed"]
    want = [(i, *brute(u, rules, hosts)) for i, u in table]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    return got


def test_odd_urls(spark):
    table = [
        (1, None), (2, ""), (3, "no scheme.org/en/1"), (4, "http://EXAMPLE.Org/en/12?x=://a"), (5, "http://example.org"), (6, "http://org/"), (7, "x://a.example.org/es/#f"), (8, "http://notexample.org/es/"), (9, "http://a.com/de/q"),
        (10, "http://a.com/fr/"), (11, "http://a.com/fr"), (12, "http://.org/x"), (13, "http://example.org:80/es/"), (14, "http:///es/"), (15, "http://a.b.c.d.e.f.example.org/es/1/://"), (16, "http://ÄÖ.org/ß"), (17, "http://cheap-pills.example.com/en/1"),
        (18, "http://www.cheap-pills.example.com/fr/1"), (19, "http://xcheap-pills.example.com/"), (20, "://"), (1, None), (1, "http://example.org/es/"), (1, "http://example.org/es/"), (None, "http://a.com/de/"), (21, "http://a\n.com/de/\n?"),
        (22, "http://" + "a." * 20_000 + "org/" + "p" * 50_000), (23, "http://a.com?/de/"), (24, "http://a.com#/de/"),
    ]
    got = check(spark, table, RULES, urls.BLOCKED_HOSTS)
    plan = got._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Join|Cartesian", plan)


def test_empty_table_and_empty_lists(spark):
    assert urls.filter_urls(spark.createDataFrame([], SCHEMA), RULES).count() == 0
    check(spark, [(1, "http://a.org/x"), (2, None)], [], [])
    check(spark, [(1, "http://a.org/x"), (2, None)], [("block", "", "/"), ("allow", "org", "no slash")], [""])
    check(spark, [(1, "http://a.org/x"), (2, "http://b.org/")], [], ["a.org"])


def test_many_keys_and_ties(spark):
    """Lists of hundreds of keys, keys that the corpus lacks, clashing actions, ties in length, several parts."""
    g = random.Random(7)
    word = lambda: "".join(g.choice("abc") for _ in range(g.randint(1, 2)))
    host = lambda: ".".join(word() for _ in range(g.randint(1, 3)))
    path = lambda: g.choice(["", "/", "/" + word(), "/" + word() + "/" + word()])
    rules = list({(g.choice(["allow", "block"]), host(), path()) for _ in range(300)})
    hosts = sorted({host() for _ in range(60)})
    table = [(i, f"http://{host()}{path()}{g.choice(['', '?q', '#f'])}") for i in range(1500)]
    check(spark, table, rules, hosts)
    check(spark, table, rules, hosts, most_keys=100)


def test_cascade_is_exact_where_level_one_is_not(spark):
    """With half of the universe listed the first filter passes many wrongly."""
    keys = spark.range(6000).selectExpr("concat('k', id) AS key", "id")
    cascade = urls.cascades({"a": keys.where("id % 2 = 0").select("key"), "b": keys.where("id = 17").select("key"), "c": keys.where("id < 0").select("key")}, keys.select("key"))
    assert len(cascade["a"].levels) > 2 and not cascade["c"].levels
    for name, want in (("a", 3000), ("b", 1), ("c", 0)):
        from pyspark.sql import functions as F

        met = urls.bound(keys, cascade[name].levels).where(cascade[name].contains(F.col("key")))
        assert met.count() == want
        assert met.where("id % 2 = 0" if name == "a" else "id = 17").count() == want
