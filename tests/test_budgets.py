"""Budgets that are gone through row by row, with no group of requests held in a task."""

from __future__ import annotations

import random

from skyloom.operators import archive, meters


def test_no_meter_holds_a_group(spark):
    """A day, a client or a stretch of one was a pandas table of its own."""
    asks = spark.createDataFrame([("d", "x", 1, 1, 1)], "day string, client string, at long, seq long, want long")
    for out in (archive.spend(asks, 10, 100), archive.hourly(asks, 10), meters.metered(asks, 10)):
        plan = out._jdf.queryExecution().toString()
        assert "MapInArrow" in plan and "InPandas" not in plan


def test_a_day_of_many_batches(spark):
    """Requests of some days and clients, over several Arrow batches, nulls included."""
    rng = random.Random(4)
    asks = [(rng.choice(["d1", "d2", None]), i, rng.choice(["a", "b", "c", None]), rng.choice([1, 2, 5, -2])) for i in range(3000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        got = {r.seq: (r.granted, r.client_calls, r.global_calls) for r in archive.spend(spark.createDataFrame(asks, "day string, seq long, client string, want long").repartition(3), 40, 90).collect()}
        hours = spark.createDataFrame([(c, s, s // 7, w) for _, s, c, w in asks], "client string, seq long, at long, want long")
        allowed = {r.seq: (r.allowed, r.used) for r in archive.hourly(hours, 6, 5).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    calls, wanted, windows, passed = {}, {}, {}, {}
    for day, seq, client, want in asks:
        mine, every = calls.get((day, client), 0), calls.get(day or "none", 0)
        grant = want if want < 0 else max(0, min(want, 90 - every, 40 - mine))
        calls[day, client], calls[day or "none"] = max(0, mine + grant), max(0, every + grant)
        wanted[seq] = (grant, calls[day, client], calls[day or "none"])
        opened, used = windows.get(client, (None, 0))
        if opened is None or seq // 7 >= opened + 5:
            opened, used = seq // 7, 0
        ok = used + want <= 6
        windows[client] = (opened, used + want if ok else used)
        passed[seq] = (ok, windows[client][1])
    assert got == wanted and allowed == passed
