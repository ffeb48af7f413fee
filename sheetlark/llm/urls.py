"""URL filters by Bloom filter cascades, in DataFrame functions only.

A rule is an action, a host and the beginning of a path. It fits its host and all subdomains where
the url's path begins so; the longest rule that fits wins (by characters of host and path; on a tie
that with the longer host). Urls that no rule fits are judged by a list of blocked hosts, which
holds for their subdomains too; what is not listed is allowed.

Every url has one key for each shape that occurs in the rules and the list (so many labels of the
host, so many characters of the path). The keys of all urls are the universe, and each of the three
lists (rules that block, rules that allow, blocked hosts) gets a cascade over it:

1. level 1 is a Bloom filter of the listed keys. Its rate of false positives follows from the number
   of listed and of all different keys, so that no more keys pass wrongly than are listed;
2. the universe is sifted by it where it stands, without a shuffle; the few keys that pass and are
   not listed make level 2; listed keys that pass level 2 make level 3, and so on;
3. the cascade ends at the level that nothing passes wrongly. A key of the universe is listed exactly
   if the first level that it fails is an even one, or if it fails none and the last one is odd.

The rule of a url is then the longest of its keys that is listed, without a join. Filters are one
row each and reach the tasks as scalar subqueries. A list of more than ``most_keys`` keys is cut by hash into parts
with cascades of their own, one pass over the urls each, so what a task holds stays bounded
(``most_keys`` keys take about 1.44 bits for each halving of listed to all keys, and 5 more).

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there
up to ``?``, ``#`` or the end. Both are empty for urls that are null, empty or without ``://``, which
no rule fits; those are allowed. Urls of any length are judged whole. Rows are judged one by one, so repeated rows
and null ids come out as often as they come in. A rule with both actions blocks; rules and hosts
without host are left out, and so are rules with a path that does not begin with ``/``, which no url has. An empty table gives no rows; without rules and list all is allowed. Extra columns are not read.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MOST_KEYS = 4_000_000
MOST_HASHES = 40

#: Default list of blocked hosts; any table with a column ``host`` can take its place.
BLOCKED_HOSTS = ("ads-track.example.org", "cheap-pills.example.com", "free-bets.example.com", "spam-farm.example.org")
LISTS = ("block", "allow", "listed")


def lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty where it has none."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    whole = F.coalesce(F.substring_index(F.substring_index(rest, "#", 1), "?", 1), F.lit(""))
    host = F.substring_index(whole, "/", 1)
    return lower(host), F.substring(whole, F.length(host) + 1, F.length(whole))


def labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."))) + 1


# ---------------------------------------------------------------- filters and cascades


class Level:
    """A Bloom filter of ``words`` 64-bit words with ``hashes`` bits a key, kept as a one-row table."""

    def __init__(self, keys: DataFrame, n: int, rate: float, seed: int):
        self.words = max(1, math.ceil(n * -math.log(rate) / math.log(2) ** 2 / 64))
        self.hashes = min(MOST_HASHES, max(1, round(64 * self.words / n * math.log(2))))
        self.seed = seed
        spark = keys.sparkSession
        at = keys.select(F.explode(F.transform(self._every(), lambda i: self._bit(F.col("key"), i))).alias("bit"))
        each = at.select(F.shiftright("bit", 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % 64).cast("int")).alias("bits"))
        dense = each.unionByName(spark.range(self.words).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))).groupBy("word").agg(F.bit_or("bits").alias("bits"))
        # one row of ``words`` numbers, which the number of keys of a part bounds
        row = dense.agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("all")).select(F.transform("all", lambda x: x["bits"]).alias("bits"))
        self.table, self.name = materialize(row, "bloom"), f"_bloom_{uuid.uuid4().hex}"

    def _every(self) -> Column:
        return F.sequence(F.lit(0), F.lit(self.hashes - 1))

    def _bit(self, key: Column, i: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(self.seed), i, key), F.lit(64 * self.words))

    def passes(self, key: Column) -> Column:
        """For rows to which :func:`bound` has given the filter."""

        def is_set(i: Column) -> Column:
            bit = self._bit(key, i)
            return F.getbit(F.get(F.col(self.name), F.shiftright(bit, 6).cast("int")), (bit % 64).cast("int")) == 1

        return F.forall(self._every(), is_set)


def bound(df: DataFrame, levels: list[Level]) -> DataFrame:
    """``df`` with the filters as columns, each a scalar subquery: one array that all rows of a task refer to."""
    return df.withColumns({level.name: level.table.scalar() for level in levels})


def passing(keys: DataFrame, level: Level) -> DataFrame:
    return bound(keys, [level]).where(level.passes(F.col("key"))).select("key")


class Cascade:
    """Exact membership in ``listed`` for every key of the universe that ``sifted`` comes from."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    def contains(self, key: Column) -> Column:
        out = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels) - 1, -1, -1):
            out = F.when(self.levels[i].passes(key), out).otherwise(F.lit(i % 2 == 1))
        return out


def cascades(lists: dict[str, DataFrame], universe: DataFrame) -> dict[str, Cascade]:
    """A cascade for each list of different keys; ``universe`` holds the corpus's keys, repeated or not."""
    sizes = {name: keys.count() for name, keys in lists.items()}
    every = universe.agg(F.approx_count_distinct("key")).first()[0]
    first = {name: Level(lists[name], n, min(0.5, n * math.sqrt(0.5) / max(1, every)), 1 + i) for i, (name, n) in enumerate(sizes.items()) if n}
    if not first:
        return {name: Cascade([]) for name in lists}
    met = None
    for level in first.values():
        met = level.passes(F.col("key")) if met is None else met | level.passes(F.col("key"))
    sifted = materialize(bound(universe, list(first.values())).where(met).select("key").distinct(), "sifted")
    out = {}
    for i, name in enumerate(lists):
        if name not in first:
            out[name] = Cascade([])
            continue
        levels = [first[name]]
        encode, against = materialize(passing(sifted, first[name]).join(lists[name], "key", "left_anti"), "wrong"), lists[name]
        while n := encode.count():
            levels.append(level := Level(encode, n, 0.5, 1 + i + len(LISTS) * len(levels)))
            encode, against = materialize(passing(against, level), "wrong"), encode
        out[name] = Cascade(levels)
    return out


# ---------------------------------------------------------------- rules


def _table(spark: SparkSession, rows: list[tuple], names: tuple[str, ...]) -> DataFrame:
    """A short list as a table, without Python on the executors."""
    if not rows:
        return spark.range(0).select(*(F.lit(None).cast("string").alias(n) for n in names))
    each = F.array(*(F.struct(*(F.lit(v).cast("string").alias(n) for v, n in zip(r, names, strict=True))) for r in rows))
    return spark.range(1).select(F.explode(each).alias("r")).select("r.*")


def _part(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(0), key), F.lit(parts))


def filter_urls(df: DataFrame, rules: DataFrame | list[tuple[str, str, str]], hosts: DataFrame | list[str] | tuple[str, ...] = BLOCKED_HOSTS, *, id: str = "page_id", url: str = "url", most_keys: int = MOST_KEYS) -> DataFrame:
    """``(id, host, path, rule, verdict, listed)``; ``rules`` are (action, host, path), actions ``allow`` and ``block``.

    ``listed`` says whether the list of blocked hosts holds the host, also where a rule decides.
    """
    spark = df.sparkSession
    rules = rules if isinstance(rules, DataFrame) else _table(spark, list(rules), ("action", "host", "path"))
    hosts = hosts if isinstance(hosts, DataFrame) else _table(spark, [(h,) for h in hosts], ("host",))
    named = rules.select("action", lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
    named = named.unionByName(hosts.select(F.lit("listed").alias("action"), lower(F.col("host")).alias("host"), F.lit("").alias("path")))
    sound = (F.length("host") > 0) & ((F.col("path") == "") | F.col("path").startswith("/")) & F.col("action").isin(*LISTS)
    named = materialize(named.where(sound).select("action", F.concat("host", "path").alias("key"), labels(F.col("host")).alias("n"), F.length("path").alias("l")).distinct(), "rules")
    # shapes: as many as there are lengths of hosts and paths in the list, each url has those that it is long enough for
    shapes = [(r.n, r.l) for r in named.select("n", "l").distinct().collect()]
    pieces = dict(zip(("host", "path"), host_and_path(F.col(url)), strict=True))
    rows = df.select(F.col(id).alias("row_id"), *(c.alias(n) for n, c in pieces.items()))
    if not shapes:
        return rows.select(F.col("row_id").alias(id), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"), F.lit(False).alias("listed"))
    known = F.array(*(F.struct(F.lit(n).alias("n"), F.lit(length).alias("l")) for n, length in sorted(shapes)))
    fits = F.filter(known, lambda s: (s["n"] <= labels(F.col("host"))) & (s["l"] <= F.length("path")))

    def key(s: Column) -> Column:
        host = F.call_function("substring_index", F.col("host"), F.lit("."), -s["n"])
        return F.struct((F.length(host) + s["l"]).alias("size"), F.length(host).alias("own"), F.concat(host, F.left(F.col("path"), s["l"])).alias("key"))

    rows = rows.withColumn("keys", F.transform(fits, key))
    for name in LISTS:
        rows = rows.withColumn(name, F.array().cast("array<struct<size:int,own:int,key:string>>"))
    parts = -(-named.count() // most_keys)
    for p in range(parts):  # one, unless the list is very long
        mine = _part(F.col("key"), parts) == p
        lists = {name: named.where((F.col("action") == name) & mine).select("key") for name in LISTS}
        cascade = cascades(lists, rows.select(F.explode("keys.key").alias("key")).where(mine))

        def found(name: str, p: int = p, cascade: dict = cascade) -> Column:
            return F.filter("keys", lambda k: (_part(k["key"], parts) == p) & cascade[name].contains(k["key"]))

        levels = [level for name in LISTS for level in cascade[name].levels]
        rows = bound(rows, levels).withColumns({name: F.concat(name, found(name)) for name in LISTS if cascade[name].levels}).drop(*(level.name for level in levels))
        if p + 1 < parts:
            rows = materialize(rows, "urls")  # a part's filters are gone before the next one's are read
    rule = F.array_max(F.concat("block", "allow"))
    judged = rows.select("row_id", "host", "path", rule.alias("rule"), F.array_max("block").alias("blocks"), (F.size("listed") > 0).alias("listed"))
    verdict = F.when(F.coalesce(F.col("rule") == F.col("blocks"), F.col("rule").isNull() & F.col("listed")), "block").otherwise("allow")
    return judged.select(F.col("row_id").alias(id), "host", "path", F.col("rule.key").alias("rule"), verdict.alias("verdict"), "listed")
