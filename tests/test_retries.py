"""Retries of a stream against the same attempts in one batch."""

import datetime as dt

import pytest

from areasignal.session import ship
from areasignal.streaming import retries

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "unit string, ok boolean, error string, at timestamp"


def attempts(n, start=0):
    return [(f"u{i % 7}", (i * i) % 5 == 0, None if (i * i) % 5 == 0 else f"e{i % 3}", T0 + dt.timedelta(seconds=40 * i)) for i in range(start, start + n)]


def expected(rows):
    state, done = {}, 0
    for unit, ok, error, at in sorted(rows, key=lambda r: r[3]):
        if ok:
            done += unit in state
            state.pop(unit, None)
        else:
            n = state.get(unit, (None, 0))[1] + 1
            state[unit] = error, n, at + dt.timedelta(milliseconds=retries.wait(n))
    return state, done


def test_waits():
    assert [retries.wait(n) for n in (1, 2, 3, 20, 90)] == [60_000, 120_000, 240_000, 3_600_000, 3_600_000]


def test_two_runs_and_a_failure_equal_one_batch(spark, tmp_path, request):
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", retries.STORE)
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.streaming.stateStore.providerClass"))
    rows, source = attempts(60), tmp_path / "in"

    def add(part):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(source))

    def run(fail=False):
        def sink(df, batch):
            df.write.mode("overwrite").parquet(str(tmp_path / "out" / f"b={batch}"))
            if fail:
                raise RuntimeError("stopped")

        stream = retries.tracked(spark.readStream.schema(SCHEMA).parquet(str(source)))
        query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).outputMode("append").start()
        query.awaitTermination()

    add(rows[:25])
    run()
    add(rows[25:])
    with pytest.raises(Exception):
        run(fail=True)
    run()
    run()
    events = spark.read.parquet(str(tmp_path / "out"))
    state, done = expected(rows)
    failed = sorted((r.unit, r.error, r.attempts, r.due) for r in events.where("event = 'failed'").collect())
    n, want = {}, []
    for unit, ok, error, at in rows:
        n[unit] = 0 if ok else n.get(unit, 0) + 1
        if not ok:
            want.append((unit, error, n[unit], at + dt.timedelta(milliseconds=retries.wait(n[unit]))))
    assert failed == sorted(want) and events.where("event = 'done'").count() == done
    assert events.where("event = 'retry'").count() > 0
    late = {(r.unit, r.attempts, r.due) for r in events.where("event = 'retry'").collect()}
    assert late <= {(u, a, d) for u, _, a, d in want}
