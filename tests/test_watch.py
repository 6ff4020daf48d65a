"""Requests to reconcile, by a clock that the events set."""

import datetime

import pytest

from quern.streaming import watch as W

T = W.Times(quiet=1000, latency=10_000, poll=60_000, safety=600_000)


def story(events, until, times=T):
    m = W.Machine(times)
    return [*W.run(m, events), *m.advance(until)]


@pytest.mark.parametrize("events,until,want", [
    ([(0, "hint"), (500, "hint")], 60_000, [(1500, "quiet", 2, 0)]),
    ([(900 * i, "hint") for i in range(24)], 60_000, [(10_000, "latency", 12, 0), (20_800, "latency", 12, 0)]),  # never quiet: at most 10 s
    ([(0, "overflow"), (800, "overflow"), (1500, "hint")], 60_000, [(2500, "quiet", 1, 2)]),
    ([(900 * i, "overflow") for i in range(13)], 60_000, [(10_000, "latency", 0, 12), (11_800, "quiet", 0, 1)]),
    ([(0, "hint")], 1_300_000, [(1000, "quiet", 1, 0), (600_000, "safety", 0, 0), (1_200_000, "safety", 0, 0)]),
    ([(0, "exhausted"), (5000, "hint")], 130_000, [(60_000, "poll", 0, 0), (120_000, "poll", 0, 0)]),
    ([(0, "hint"), (500, "root_gone"), (5000, "hint")], 2_000_000, []),
    ([(0, "hint"), (599_500, "hint")], 700_000, [(1000, "quiet", 1, 0), (600_000, "safety", 1, 0)]),
    ([(599_000, "hint"), (0, "hint")], 599_100, [(1000, "quiet", 1, 0)]),
    ([], 10**9, []),
])
def test_machine(events, until, want):
    assert story(events, until) == want


def at(ms):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(milliseconds=ms)


BASE = int(datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC).timestamp() * 1000)
ROWS = [("a", "hint", at(900 * i)) for i in range(24)] + [("b", "overflow", at(300)), ("b", "hint", at(9000)), ("c", "exhausted", at(0)), ("d", "root_gone", at(10))]
WANT = {("a", 10_000, "latency"), ("a", 20_800, "latency"), ("b", 1300, "quiet"), ("b", 10_000, "quiet")}


def test_table(spark):
    got = W.requests_of(spark.createDataFrame(ROWS, W.EVENTS), T, until=BASE + 59_000).collect()
    assert {(r.worktree, r.at - BASE, r.reason) for r in got} == WANT


def test_stream_equals_table(spark, tmp_path):
    """In four batches and with a restart between each two, timers and all."""
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rows = sorted(ROWS, key=lambda r: r[2])
        parts = [rows[:10], rows[10:20], rows[20:], [("z", "hint", at(59_000 + 1000))]]
        for part in parts:
            spark.createDataFrame(part, W.EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            source = spark.readStream.schema(W.EVENTS).parquet(f"{tmp_path}/in")
            q = W.requests(source, T, "0 seconds").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
            assert q.awaitTermination(200)
        got = spark.read.parquet(f"{tmp_path}/out").where("worktree != 'z'").collect()
        assert {(r.worktree, r.at - BASE, r.reason) for r in got} - {("c", 60_000, "poll")} == WANT and len(got) <= len(WANT) + 1
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass") if old is None else spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
