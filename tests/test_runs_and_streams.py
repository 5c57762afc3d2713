"""Runs that are applied once, and the life of roles as a stream."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pairwright.operators import run
from pairwright.plans.gazetteer import places
from pairwright.streaming import jobs, lifecycle

from .test_core import harvest

DAYS = {0: "2026-01-10", 1: "2026-01-17", 2: "2026-01-24"}


def board_of(spark, path, name="roles"):
    drop = {"batch"}
    return sorted((str([v for c, v in sorted(r.asDict().items()) if c not in drop]), r["batch"]) for r in run.read_table(spark, path, name).collect())


def test_a_batch_that_dies_between_two_tables_is_run_again(spark, tmp_path, monkeypatch):
    """Readers never see half a run, and the redone batch leaves what an undisturbed one leaves."""
    sources, landed = harvest(spark, ["S1", "S2"])
    more, landed2 = harvest(spark, ["S1", "S2", "S3"], failed=("S2",))
    plain, torn = str(tmp_path / "plain"), str(tmp_path / "torn")
    for path in (plain, torn):
        assert run.run_batch(spark, path, 0, sources, landed, places(spark), DAYS[0])
    assert run.run_batch(spark, plain, 1, more, landed2, places(spark), DAYS[1])
    put, written = run._put, []

    def dies(rows, path, batch):
        if len(written) == 3:
            raise OSError("lost")
        written.append(path)
        put(rows, path, batch)

    monkeypatch.setattr(run, "_put", dies)
    with pytest.raises(OSError, match="lost"):
        run.run_batch(spark, torn, 1, more, landed2, places(spark), DAYS[1])
    assert len(written) == 3 and set(run.committed(spark, torn)) == {0}
    assert {b for _, b in board_of(spark, torn)} == {0}
    monkeypatch.setattr(run, "_put", put)
    assert run.run_batch(spark, torn, 1, more, landed2, places(spark), DAYS[1])
    assert not run.run_batch(spark, torn, 1, more, landed2, places(spark), DAYS[1])  # applied already
    for name in ("roles", "pairs", "areas", "digest", "coverage", "run"):
        assert board_of(spark, torn, name) == board_of(spark, plain, name), name


def test_a_torn_stream_goes_on_from_its_checkpoint(spark, tmp_path, monkeypatch):
    sources, landed = harvest(spark, ["S1", "S2"])
    landing, checkpoint, path = (str(tmp_path / x) for x in ("landing", "checkpoint", "board"))
    start = lambda: jobs.harvest_runs(spark, landing, checkpoint, path, sources, places(spark), DAYS.__getitem__)
    landed.write.mode("append").json(landing)
    start().awaitTermination()
    landed.filter("source_name = 'S1'").write.mode("append").json(landing)
    put = run._put
    monkeypatch.setattr(run, "_put", lambda rows, p, b: (_ for _ in ()).throw(OSError("lost")) if p.endswith("digest") else put(rows, p, b))
    with pytest.raises(Exception, match="lost"):
        start().awaitTermination()
    assert set(run.committed(spark, path)) == {0}
    monkeypatch.setattr(run, "_put", put)
    start().awaitTermination()
    assert {k: str(v) for k, v in run.committed(spark, path).items()} == {0: DAYS[0], 1: DAYS[1]}
    assert {(r.batch, r.roles, r.carried, r.new_roles) for r in run.read_table(spark, path, "run").collect()} == {(0, 4, 0, 0), (1, 4, 2, 0)}  # S2 didn't answer


def test_no_run_yet(spark, tmp_path):
    assert run.committed(spark, str(tmp_path / "none")) == {}


def plain_life(rows, end, days=14):
    """All changes of roles, by their own rows in order."""
    day, out, held = dt.timedelta(days=days), [], {}
    for at, key, failed in sorted(rows):
        first, stale = held.get(key, (None, None))
        if stale and at >= stale + day:
            out.append((key, "evicted", stale + day, first, stale))
            first = stale = None
        if failed and first and not stale:
            stale = at
            out.append((key, "stale", at, first, stale))
        elif not failed and not first:
            first = at
            out.append((key, "first", at, first, None))
        elif not failed and stale:
            out.append((key, "alive", at, first, stale))
            stale = None
        held[key] = (first, stale)
    return sorted((*out, *((k, "evicted", s + day, f, s) for k, (f, s) in held.items() if s and s + day <= end)), key=repr)


def test_roles_live_and_go_over_batches_and_restarts(spark, tmp_path):
    rng, start = random.Random(3), dt.datetime(2026, 1, 1)
    rows = [(start + dt.timedelta(hours=h, seconds=k), f"r{rng.randrange(40)}", rng.random() < 0.6) for h in range(0, 24 * 70, 9) for k in range(2)]
    landing, checkpoint = str(tmp_path / "landing"), str(tmp_path / "checkpoint")
    schema = "at timestamp, id string, failed boolean"
    third = len(rows) // 3
    for k in range(3):  # each time a new query goes on with the state of the last one
        part = rows[k * third : (k + 1) * third] if k < 2 else rows[2 * third :]
        rng.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(landing)
        changes = lifecycle.run_changes(spark.readStream.schema(schema).json(landing), checkpoint)
    got = sorted((tuple(r) for r in changes.collect()), key=repr)
    want = plain_life(rows, max(r[0] for r in rows))
    assert got == want and {c for _, c, *_ in got} == {"first", "stale", "alive", "evicted"}


def test_evicted_roles_leave_no_state(spark, tmp_path):
    start = dt.datetime(2026, 1, 1)
    rows = [(start, f"r{i}", False) for i in range(50)] + [(start + dt.timedelta(days=1), f"r{i}", True) for i in range(50)] + [(start + dt.timedelta(days=40), "other", False), (None, "no time", False), (start + dt.timedelta(days=40), None, None)]
    schema = "at timestamp, id string, failed boolean"
    landing = str(tmp_path / "landing")
    spark.createDataFrame(rows, schema).write.json(landing)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", lifecycle.PROVIDER)
    try:
        q = lifecycle.role_changes(spark.readStream.schema(schema).json(landing)).writeStream.format("memory").queryName("lives").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert {r["change"]: r["n"] for r in spark.table("lives").groupBy("change").agg(F.count("*").alias("n")).collect()} == {"first": 52, "stale": 50, "evicted": 50}
    seen = spark.read.format("statestore").option("stateVarName", "life").load(str(tmp_path / "ck"))
    assert seen.count() == 2


def test_roles_share_the_state_of_their_bucket(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lifecycle, "BUCKETS", 2)
    start = dt.datetime(2026, 1, 1)
    rows = [(start + dt.timedelta(days=d, hours=i), f"r{i}", failed) for i in range(6) for d, failed in ((0, False), (1, True))] + [(start + dt.timedelta(days=15, hours=2), "r0", False), (start + dt.timedelta(days=15, hours=2), "r6", False)]
    schema = "at timestamp, id string, failed boolean"
    spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / "landing"))
    changes = lifecycle.run_changes(spark.readStream.schema(schema).json(str(tmp_path / "landing")), str(tmp_path / "ck"))
    assert sorted((tuple(r) for r in changes.collect()), key=repr) == plain_life(rows, max(r[0] for r in rows))
    assert spark.read.format("statestore").option("stateVarName", "life").load(str(tmp_path / "ck")).count() <= 2
