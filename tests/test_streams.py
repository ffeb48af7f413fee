"""Streams against the same question asked of the whole table."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from sheetlark.streaming import events, returns

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"
START = datetime(2024, 1, 1)


def files(spark, folder, *batches, schema=SCHEMA):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def at(minutes):
    return START + timedelta(minutes=minutes)


def test_windows_equal_the_batch_result_and_late_rows_are_apart(spark, tmp_path):
    folder = f"{tmp_path}/in"
    one = [(i, at(i), 1, "a", 1.0) for i in range(0, 100, 7)] + [(200, None, 1, "a", 1.0), (201, at(3), 1, None, 1.0), (0, at(0), 1, "a", 1.0)]
    two = [(i, at(i), 1, "b", 2.0) for i in range(100, 300, 7)]
    three = [(i, at(i), 1, "a", 3.0) for i in range(300, 330, 7)]
    late = [(900, at(5), 1, "a", 9.0), (901, at(325), 1, "a", 9.0), (902, at(5), 1, "a", 9.0)]
    files(spark, folder, one, two, three, late, [(-1, at(10**6), 0, "end", 0.0)])
    source = events.stream(spark, folder, SCHEMA)
    events.run_windows(source, lambda e: events.windows(e, "1 hour"), "10 minutes", f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    whole = spark.createDataFrame([r for r in one + two + three + late if r[0] not in (900, 902)], SCHEMA)
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()))
    assert got == sorted(map(tuple, events.windows(whole, "1 hour").collect())) and len(got) == 7
    events.run_late(events.stream(spark, folder, SCHEMA), "1 hour", 600, f"{tmp_path}/late", f"{tmp_path}/marks").awaitTermination()
    assert [(r.event_type, r.start, r.n_late) for r in spark.read.parquet(f"{tmp_path}/late/late").collect()] == [("a", START, 2)]
    # run again over the same checkpoints: nothing new has come, nothing is told twice
    events.run_windows(events.stream(spark, folder, SCHEMA), lambda e: events.windows(e, "1 hour"), "10 minutes", f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == got


def test_sessions_and_empty_tables(spark):
    rows = [(i, at(m), u, "a", 1.5) for i, (u, m) in enumerate([(1, 0), (1, 10), (1, 45), (2, 0), (2, 0), (None, 5)])]
    got = {(r.user_id, r.start, r.end, r.n, str(r.total)) for r in events.sessions(spark.createDataFrame(rows, SCHEMA), "30 minutes").collect()}
    assert got == {(1, at(0), at(40), 2, "3.00"), (1, at(45), at(75), 1, "1.50"), (2, at(0), at(30), 2, "3.00")}
    none = spark.createDataFrame([], SCHEMA)
    assert events.sessions(none, "1 hour").count() == events.windows(none, "2 hours", "1 hour").count() == 0


def test_versions_that_return(spark, tmp_path):
    schema = "key string, side string, time timestamp, value string"
    folder, out = f"{tmp_path}/in", f"{tmp_path}/out"
    setting = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(setting, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def go():
        told = returns.returned(events.stream(spark, folder, schema), patience=3600)
        told.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        return sorted(((r.key, r.outcome, r.old, r.new) for r in spark.read.schema(returns.TOLD).parquet(out).collect()), key=str)

    try:
        files(spark, folder, [("a", "sent", at(0), "1"), ("b", "sent", at(0), "1"), ("c", "sent", at(0), "1"), ("e", "returned", at(0), "9"), ("t", "sent", at(0), "1"), ("t", "sent", at(0), "2"), ("n", "sent", at(0), None), (None, "sent", at(0), "x"), ("q", "other", at(0), "x")], schema=schema)
        files(spark, folder, [("a", "returned", at(10), "1"), ("b", "returned", at(10), "2"), ("t", "returned", at(9), "2"), ("n", "returned", at(9), None)], schema=schema)
        first = [("a", "unchanged", "1", "1"), ("b", "changed", "1", "2"), ("n", "unchanged", None, None), ("t", "unchanged", "2", "2")]
        assert go() == first
        assert go() == first  # started again: nothing is told twice
        files(spark, folder, [("a", "returned", at(20), "7"), ("e", "sent", at(30), "8")], schema=schema)
        second = sorted([*first, ("a", "again", "1", "7"), ("e", "changed", "8", "9")], key=str)
        assert go() == second
        files(spark, folder, [("z", "sent", at(10_000), "z")], schema=schema)
        assert go() == sorted([*second, ("c", "never_returned", "1", None)], key=str)
    finally:
        spark.conf.unset(setting)


def test_windows_hold_decimal_sums(spark):
    rows = spark.range(1000).select(F.col("id").alias("event_id"), F.lit(START).alias("ts"), F.lit(1).cast("long").alias("user_id"), F.lit("a").alias("event_type"), F.lit(0.1).alias("value"))
    assert str(events.windows(rows, "1 hour").first().total) == "100.00"


class Store:
    """The state of one bucket, and how often it was asked."""

    def __init__(self):
        self.value, self.timers, self.n = None, set(), 0

    def getValueState(self, name, schema):
        return self

    def _said(self):
        self.n += 1

    def get(self):
        self._said()
        return self.value

    def update(self, value):
        self._said()
        self.value = value

    def clear(self):
        self._said()
        self.value = None

    def registerTimer(self, at):
        self._said()
        self.timers.add(at)

    def deleteTimer(self, at):
        self._said()
        self.timers.remove(at)

    def getCurrentWatermarkInMs(self):
        return self.mark


def test_a_bucket_of_versions_takes_a_few_messages():
    """However many keys it holds; the timer is the earliest of theirs."""
    import pandas as pd

    store, pairing, out = Store(), returns.Pairing(60), []
    pairing.init(store)

    def come(rows):
        frame = pd.DataFrame(rows, columns=["key", "side", "at", "value"])
        for pdf in pairing.handleInputRows((7,), iter([frame[: len(rows) // 2], frame[len(rows) // 2 :]]), store):
            out.extend(pdf.itertuples(index=False, name=None))
        return store.n

    def passes(mark):
        store.mark = mark
        while due := [t for t in store.timers if t < mark]:
            store.timers -= set(due)
            for pdf in pairing.handleExpiredTimer((7,), store, None):
                out.extend(pdf.itertuples(index=False, name=None))

    assert come([(str(i), "sent", i * 1_000_000, "x") for i in range(1000)]) <= 4 and store.timers == {60_000}
    assert come([(str(i), "returned", 2_000_000_000, "x" if i % 2 else "y") for i in range(0, 1000, 5)]) <= 8 and store.timers == {61_000}
    assert sorted(out) == sorted((str(i), "unchanged" if i % 2 else "changed", "x", "x" if i % 2 else "y", 2_000_000_000) for i in range(0, 1000, 5))
    out.clear()
    passes(61_000)
    assert not out and store.timers == {61_000}  # what is due then expires after it
    passes(560_000)
    assert sorted(out) == sorted((str(i), "never_returned", "x", None, i * 1_000_000) for i in range(500) if i % 5) and store.timers == {561_000}
    out.clear()
    come([("0", "returned", 2_000_000_001, "z")])
    assert out == [("0", "again", "x", "z", 2_000_000_001)]
    passes(10**10)
    assert len(out) == 401 and store.value is None and not store.timers
