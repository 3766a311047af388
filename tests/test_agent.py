"""Replay of runs against a plain fold, as a table and as a stream that is stopped and started again."""

import datetime
import random

import pytest

from tracevale.streaming import agent

T0 = datetime.datetime(2024, 1, 1)


def steps_of(seed, runs=6, n=60):
    rng, out = random.Random(seed), []
    for run in range(runs):
        at, goal = T0 + datetime.timedelta(seconds=run * 7), 0
        for k in range(n):
            at += datetime.timedelta(seconds=rng.choice([0, 1, 5, 20, 30 * run]))
            goal += rng.random() < 0.08
            e = rng.randrange(30)
            out.append((f"r{run}", f"g{goal}", at, k, rng.choice(["/a", "/b", None]), f"e{e}", rng.choice(["link", "button"]), f"name {e % 7}" + rng.choice(["", " #2"]), rng.choice([False, False, False, None, True])))
    return out


def plain(rows, per_flow=15, per_run=80, seconds=900):
    out = []
    for run in sorted({r[0] for r in rows}):
        start = goal = None
        total = count = 0
        latch, seen = False, set()
        for _, g, at, seq, path, element, role, name, outage in sorted((r for r in rows if r[0] == run), key=lambda r: (r[2], r[3])):
            start = start or at
            reason = None
            if (at - start).total_seconds() > seconds:
                reason = "time"
            else:
                if g != goal:
                    goal, count, latch, seen = g, 0, False, set()
                base = name.removesuffix(" #2")
                here = {(path or "", element), (path or "", role, base)}
                if count >= per_flow:
                    reason = "flow-budget"
                elif total >= per_run:
                    reason = "run-budget"
                else:
                    latch = latch or bool(outage)
                    if here & seen:
                        reason = "already-executed"
                    else:
                        seen |= here
                        count, total = count + 1, total + 1
            out.append((run, g, at, seq, element, reason is None, reason, latch, count, total))
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("budget", [agent.Budget(), agent.Budget(4, 12, 300)])
def test_replay_of_a_table(spark, budget):
    s = steps_of(1)
    df = spark.createDataFrame([*s, (None, "g", T0, 1, "/", "e", "r", "n", False), ("r0", "g", None, 1, "/", "e", "r", "n", False)], agent.STEP).repartition(5)
    got = rows(agent.replay(df, budget))
    assert got == plain(s, budget.per_flow, budget.per_run, budget.seconds)
    assert {r[6] for r in got} >= ({"already-executed", "flow-budget", "run-budget", "time", None} if budget.per_flow == 4 else {"already-executed", "time", None})
    assert agent.replay(df.where("false")).count() == 0


def test_replay_of_a_stream_that_is_started_again(spark, tmp_path):
    """Rows come out of order within the lateness; the stream stops after each few files and goes on from its checkpoint."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        s = steps_of(2, runs=4, n=40)
        rng = random.Random(3)
        arriving = sorted(s, key=lambda r: r[2] + datetime.timedelta(seconds=rng.randrange(60)))
        end = ("end", "g", T0 + datetime.timedelta(days=2), 0, "/", "e", "r", "n", False)
        source, done, checkpoint = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/checkpoint"
        cuts = [0, 50, 90, 130, len(arriving)]
        for k, part in enumerate([*(arriving[a:b] for a, b in zip(cuts, cuts[1:])), [end], [(*end[:2], end[2] + datetime.timedelta(days=1), *end[3:])]]):
            spark.createDataFrame(part, agent.STEP).coalesce(1).write.mode("append").parquet(source)
            stream = agent.replay_stream(spark.readStream.schema(agent.STEP).parquet(source), agent.Budget(5, 14, 400), "2 minutes")
            query = stream.writeStream.format("parquet").option("path", done).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
            query.awaitTermination()
            assert query.exception() is None, k
        got = [r for r in rows(spark.read.schema(agent.REPLAYED).parquet(done)) if r[0] != "end"]
        assert got == plain(s, 5, 14, 400) == rows(agent.replay(spark.createDataFrame(s, agent.STEP), agent.Budget(5, 14, 400)))
    finally:
        spark.conf.set(provider, was)
