"""Keyed state on streams against the same requests taken in order by a loop."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from skyloom.operators import meters
from skyloom.streaming import ordered


def requests(seed, n=120):
    rng = random.Random(seed)
    return [(rng.choice(["a", "b", "hot", "hot", None]), 1_700_000_000 + rng.randint(0, 40) * 1800, i, rng.choice([1, 2, 5, -2, -1])) for i in range(n)]


def frame(spark, rows):
    df = spark.createDataFrame(rows, "client string, at long, seq long, want long").repartition(3)
    return df.select("client", F.timestamp_seconds("at").alias("ts"), "seq", "want")


def metered(rows, cap):
    used, out = {}, []
    for client, _, seq, want in sorted(rows, key=lambda r: (r[1], r[2])):
        had = used.get(client, 0)
        used[client] = max(0, min(cap, had + want))
        out.append((client, seq, want, want if want < 0 else used[client] - had, used[client]))
    return sorted(out, key=lambda r: r[1])


def wanted(rows, keep):
    open_, out = {}, []
    for client, at, _, _ in sorted(rows, key=lambda r: (r[1], r[2])):
        uses, first, last = open_.get(client, (0, at, at))
        if uses and at >= last + keep:
            out.append((client, uses, first * 1000, last * 1000))
            uses, first = 0, at
        open_[client] = (uses + 1, first, at)
    return sorted([*out, *((c, u, a * 1000, b * 1000) for c, (u, a, b) in open_.items())], key=repr)


def test_meter_by_nights_equals_the_loop(spark):
    rows = requests(1)
    got = ordered.nightly(frame(spark, rows), lambda s: ordered.meter(s, 6), nights=3)
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[1]) == metered(rows, 6)


def test_last_wanted_by_nights_equals_the_loop(spark):
    rows = requests(2)
    got = ordered.nightly(frame(spark, rows), lambda s: ordered.last_wanted(s, 7_200_000), nights=2)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == wanted(rows, 7200)


def test_meter_in_parts_equals_the_loop(spark):
    """One client has most requests, so its day is several stretches."""
    rows = requests(3, 500)
    df = spark.createDataFrame(rows, "client string, at long, seq long, want long")
    for parts in (1, 7):
        out = meters.metered(df, 6, parts)
        assert sorted((tuple(r) for r in out.collect()), key=lambda r: r[1]) == metered(rows, 6)
    assert meters.metered(df.limit(0), 6, 3).collect() == []


def test_a_killed_run_leaves_what_an_unbroken_one_does(spark, tmp_path):
    from skyloom.streaming import incremental, ledger

    calls, broken = [], {"left": 2}

    def fresh(rows):
        calls.append("fresh")
        return rows.where("want > 0")

    def counted(rows):
        if broken["left"]:
            broken["left"] -= 1
            raise RuntimeError("lost")
        return rows.groupBy("client").agg(F.count("*").alias("n"), F.sum("want").alias("total"))

    def run(name):
        stream = spark.readStream.schema("client string, ts timestamp, seq long, want long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        each = ledger.staged(str(tmp_path / name), "nightly", [("fresh", fresh), ("counted", counted)])
        incremental.run_available(stream, str(tmp_path / f"{name}-checkpoint"), each)

    for k in range(3):
        frame(spark, requests(10 + k, 30)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for _ in range(2):
        try:
            run("killed")
        except Exception as error:  # noqa: BLE001  the stream reports what its batch raised
            assert "lost" in str(error)
    assert calls == ["fresh"]  # the second start found the first stage done
    run("killed")
    run("killed")
    run("whole")
    tables = [sorted((r.client or "", r.n, r.total, r.batch) for r in ledger.result(spark, str(tmp_path / name), "counted").collect()) for name in ("killed", "whole")]
    assert tables[0] == tables[1] and len({r[3] for r in tables[0]}) == 3
    done = ledger.ledger(spark, str(tmp_path / "killed"), ["fresh", "counted"])
    assert sorted((r.stage, r.batch) for r in done.collect()) == [(s, b) for s in ("counted", "fresh") for b in range(3)]
    again = ledger.staged(str(tmp_path / "killed"), "nightly", [("fresh", fresh), ("counted", counted)])
    again(frame(spark, requests(10, 30)), 0)  # a batch that comes again changes nothing
    assert sorted((r.client or "", r.n, r.total, r.batch) for r in ledger.result(spark, str(tmp_path / "killed"), "counted").collect()) == tables[0]


def test_keys_of_the_state_are_buckets(spark, monkeypatch):
    """All clients in one bucket, and more clients than buckets, give what the loop does; the state has no key for each client."""
    rng = random.Random(8)
    rows = [(rng.choice([None, *(f"c{k}" for k in range(60))]), 1_700_000_000 + rng.randint(0, 60) * 1800, i, rng.choice([1, 3, -2])) for i in range(500)]
    monkeypatch.setattr(ordered, "BUCKETS", 1)
    got = ordered.nightly(frame(spark, rows), lambda s: ordered.meter(s, 6), nights=2)
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[1]) == metered(rows, 6)
    monkeypatch.setattr(ordered, "BUCKETS", 7)
    got = ordered.nightly(frame(spark, rows), lambda s: ordered.last_wanted(s, 7_200_000), nights=2)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == wanted(rows, 7200)
