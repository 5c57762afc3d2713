"""The table of marks, merged by copy on write."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from pairwright.operators import board, marks

SCHEMA = "board_id string, role_id string, pinned boolean, status string, note string, by string, updated_at timestamp, seq long"
AT = dt.datetime(2026, 1, 1)


def row(b, r, note, hours=0, seq=0, status="new"):
    return (f"board-{b}", f"role-{r}", False, status, note, "me", AT + dt.timedelta(hours=hours), seq)


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def notes(spark, path, **options):
    return {(r.board_id, r.role_id): r.note for r in marks.read_marks(spark, path, **options).collect()}


def test_only_touched_buckets_are_written(spark, tmp_path):
    path = str(tmp_path / "marks")
    assert notes(spark, path) == {}
    first = marks.merge_marks(spark, path, spark.createDataFrame([row(b, r, f"{b}{r}") for b in range(20) for r in range(5)], SCHEMA))
    before, held = files(f"{path}/data"), marks.versions(spark, path)
    touched = marks.merge_marks(spark, path, spark.createDataFrame([row(3, 1, "newer", 1), row(3, 9, "added"), row(3, 2, "older", -1), row(3, 0, "invalid", 5, status="lost")], SCHEMA))
    assert len(touched) == 1 and len(first) > 5
    now = files(f"{path}/data")
    assert all(now[f] == t for f, t in before.items())  # nothing that was read before has changed
    after = marks.versions(spark, path)
    assert {b for b in held if b >= 0 and after[b] != held[b]} == set(touched)
    got = notes(spark, path)
    assert got[("board-3", "role-1")] == "newer" and got[("board-3", "role-9")] == "added" and got[("board-3", "role-2")] == "32" and got[("board-3", "role-0")] == "30" and len(got) == 101
    assert set(notes(spark, path, boards=["board-3", "board-7"])) == {(b, f"role-{r}") for b in ("board-3", "board-7") for r in range(5)} | {("board-3", "role-9")}
    assert marks.merge_marks(spark, path, spark.createDataFrame([], SCHEMA)) == []


def test_a_merge_that_dies_is_not_seen(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "marks")
    marks.merge_marks(spark, path, spark.createDataFrame([row(1, 1, "a")], SCHEMA))
    monkeypatch.setattr(marks, "_publish", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        marks.merge_marks(spark, path, spark.createDataFrame([row(1, 1, "b", 1)], SCHEMA))
    monkeypatch.undo()
    assert notes(spark, path) == {("board-1", "role-1"): "a"}
    marks.merge_marks(spark, path, spark.createDataFrame([row(1, 1, "c", 2)], SCHEMA))
    assert notes(spark, path) == {("board-1", "role-1"): "c"}


def test_stamps_and_order_of_one_instant(spark, tmp_path):
    path = str(tmp_path / "marks")
    rows = spark.createDataFrame([row(1, 1, "first", seq=1), row(1, 1, "last", seq=2)], SCHEMA)
    marks.merge_marks(spark, path, rows, now=F.lit("2026-02-01 00:00:00"))
    assert notes(spark, path) == {("board-1", "role-1"): "last"}
    log = str(tmp_path / "log")
    board.append_marks(rows.drop("seq", "updated_at").coalesce(1), log, F.lit("2026-02-01 00:00:00").cast("timestamp"))
    assert [r.note for r in board.latest_marks(spark.read.parquet(log)).collect()] == ["last"]
