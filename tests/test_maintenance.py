"""Retention reasons, waiting order, shared runs, listings, safe JSON, and an index kept by a stream of paths."""

import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from orrery.api import Project
from orrery.functions import scalars as S
from orrery.operators import retention, tables
from orrery.streaming import changes


def test_reasons_idle_and_order(spark):
    now = F.lit("2024-03-31 00:00:00").cast("timestamp")
    rows = [("gone", False, "2024-02-01 00:00:00", False), ("gone lately", False, "2024-03-30 00:00:00", False), ("old", True, "2024-03-01 00:00:00", True), ("new", True, "2024-03-30 23:00:00", None)]
    df = spark.createDataFrame(rows, "key string, path_exists boolean, at string, busy boolean").withColumn("last_access", F.col("at").cast("timestamp"))
    assert {r["key"]: r["why"] for r in df.withColumn("why", retention.prune_reason(now)).collect()} == {"gone": "missing", "gone lately": None, "old": "idle", "new": None}
    assert {r["key"] for r in retention.idle(df, now).collect()} == {"gone", "gone lately"}
    calls = [(1, "2024-03-30 23:59:50", 1), (5, "2024-03-30 23:59:59", 2), (1, "2024-03-30 23:50:00", 3), (5, "2024-03-31 00:00:00", 4), (9, "2024-03-31 00:00:00", 5)]
    waiting = spark.createDataFrame(calls, "priority int, at string, ticket int").withColumn("since", F.col("at").cast("timestamp"))
    assert [r["ticket"] for r in retention.aged_order(waiting, now, 5, 7).collect()] == [5, 3, 2, 4, 1]


def test_runs_are_shared():
    flight, calls, got = changes.SingleFlight(), [], []

    def slow():
        calls.append(1)
        time.sleep(0.3)
        return len(calls)

    threads = [threading.Thread(target=lambda: got.append(flight.run("k", slow))) for _ in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert calls == [1] and got == [1] * 4 and flight.run("k", slow) == 2
    for _ in range(2):
        with pytest.raises(ZeroDivisionError):
            flight.run("bad", lambda: 1 / 0)


def test_safe_json(spark):
    text = "</script><!-- &   é"
    out = spark.createDataFrame([(text,)], "t string").select(S.script_safe_json(F.struct("t")).alias("j")).first()["j"]
    assert json.loads(out) == {"t": text} and not set("<>& ") & set(out)


def test_index_kept_by_a_stream(spark, tmp_path):
    root, events = tmp_path / "repo", tmp_path / "events"
    (root / "pkg" / "sub").mkdir(parents=True)
    events.mkdir()
    for name in ("a.py", "pkg/b.py", "pkg/sub/c.py", "pkgs.py"):
        (root / name).write_text("def f():\n    return 1\n")
    p = Project(spark, str(root), str(tmp_path / "store"))
    (events / "1.json").write_text('{"path": "pkg/"}\n{"path": "a.py"}\n{"path": null}\n{"path": "none.py"}\n')
    stream = spark.readStream.schema("path string").json(str(events))
    changes.maintain(stream, p.index_paths, str(tmp_path / "ck"), once=True, as_table=True, reconcile=p.index_project).awaitTermination(120)
    assert {r["path"] for r in p.get_symbols().collect()} == {"a.py", "pkg/b.py", "pkg/sub/c.py", "pkgs.py"}
    (root / "pkg" / "b.py").write_text("def g():\n    return 1\n")
    (root / "pkg" / "sub" / "c.py").unlink()
    (root / "pkgs.py").write_text("def h():\n    return 1\n")
    (events / "2.json").write_text('{"path": "pkg"}\n')
    changes.maintain(stream, p.index_paths, str(tmp_path / "ck"), once=True, as_table=True).awaitTermination(120)
    assert {(r["path"], r["name"]) for r in p.get_symbols().collect()} == {("a.py", "f"), ("pkg/b.py", "g"), ("pkgs.py", "f")}
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "VERSION-000000000001").write_text('{"version": 1, "tables": {"files": "nowhere"}}')
    got = {r["project"]: (r["version"], r["files"], r["error"]) for r in tables.listing(spark, {"x": str(tmp_path / "store"), "none": str(tmp_path / "no"), "bad": str(tmp_path / "broken")}).collect()}
    assert got["x"][1:] == (3, None) and got["none"] == (0, 0, None) and got["bad"][2] is not None
