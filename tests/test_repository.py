"""Repository facts, references, reports and the index of a small project, without anything stored by hand."""

import os
import subprocess
import time

import pytest
from pyspark.sql import functions as F

from orrery.api import Project
from orrery.operators import edges, graph, references, rules, tables
from orrery.options import DEFAULTS, Options
from orrery.sources import python_code, repository


def git(root, *args):
    subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@example.com", *args], check=True, capture_output=True)


def test_visible_and_ignored_paths(spark, tmp_path):
    root = tmp_path / "w"
    (root / "build").mkdir(parents=True)
    assert repository.visible_paths(spark, str(root)) is None and repository.commit_id(str(root)) is None
    for name, text in {".gitignore": "*.log\n", "a.py": "x = 1\n", "b.py": "", "c.log": "", "build/d.py": "", "new file.py": "y = 2\n"}.items():
        (root / name).write_text(text)
    git(root, "init", "-q")
    git(root, "add", ".gitignore", "a.py", "b.py", "build/d.py")
    git(root, "commit", "-q", "-m", "x")
    (root / "b.py").unlink()
    assert {r["path"] for r in repository.visible_paths(spark, str(root)).collect()} == {".gitignore", "a.py", "new file.py"}
    assert repository.is_ignored(str(root), ["a.py", "c.log", "build/d.py", "none.py"]) == {"a.py": False, "c.log": True, "build/d.py": True, "none.py": False}
    p = Project(spark, str(root), str(tmp_path / "store"))
    p.index_project()
    assert p.freshness() == "equal" and {r["path"] for r in p.tables.read("files").collect()} == {"a.py", "new file.py"}
    git(root, "commit", "-q", "--allow-empty", "-m", "y")
    assert p.freshness() == "stale" and repository.freshness(None, "x") == "unknown"


def test_paths_stay_inside(tmp_path):
    root = tmp_path / "r"
    root.mkdir()
    (tmp_path / "out").mkdir()
    os.symlink(tmp_path / "out", root / "link")
    assert repository.contained(str(root), "a/../b.py") == str(root / "b.py") and repository.contained(str(root), str(root / "x")) == str(root / "x")
    for bad in ("../out", "/etc/passwd", "link/x", "a/../../r2"):
        with pytest.raises(ValueError):
            repository.contained(str(root), bad)


def test_scripts(tmp_path):
    assert repository.script_functions(str(tmp_path)) == set()
    (tmp_path / "pyproject.toml").write_text('[project.scripts]\nrun = "pkg.cli:main"\nother = "pkg:App.start"\nbad = "nothing"\n[project.gui-scripts]\nwin = "pkg.gui:show [extra]"\n')
    assert repository.script_functions(str(tmp_path)) == {"main", "start", "show"}
    (tmp_path / "pyproject.toml").write_text("[project")
    assert repository.script_functions(str(tmp_path)) == set()


def test_go_imports(spark):
    text = 'package a\n\nimport "fmt"\nimport m "math"\nimport (\n\t"os"\n\t_ "side/effect"\n\t. "dot" // all\n\n\tj `raw/path`\n)\n\nvar s = "no import"\nfunc f() {\n\t"not"\n}\n'
    df = spark.createDataFrame([("x/a.go", text), ("b.py", 'import "fmt"'), ("c.go", None), ("d.go", "")], "path string, text string")
    got = {(r["path"], r["line"], r["alias"], r["module"]) for r in repository.go_imports(df).collect()}
    assert got == {("x/a.go", 3, None, "fmt"), ("x/a.go", 4, "m", "math"), ("x/a.go", 6, None, "os"), ("x/a.go", 7, "_", "side/effect"), ("x/a.go", 8, ".", "dot"), ("x/a.go", 10, "j", "raw/path")}


def test_descriptions(spark):
    rows = [
        ("a/b/c.py", "import x\n\n# Reads the tables. And more.\n", "Reads the tables."), ("a/main.go", "package a\n// Package a is what it is and this sentence is longer than that\n", "Package a is what it is and this sentence is lon"), ("x/y.js", "/* ---- */\n/** Shows it */", "Shows it"),
        ("dir/none.txt", "no comment here", "dir .txt"), ("dir/late.py", "\n" * 60 + "# too late", "dir .py"), ("top.py", None, ".py"), ("LICENSE", "", ""),
    ]
    df = spark.createDataFrame(rows, "path string, text string, want string")
    for r in df.withColumn("got", repository.description("path", "text")).collect():
        assert r["got"] == r["want"], r


def test_occurrences_and_candidates(spark):
    lines = [("a.py", 1, "hub(hub) + my_hub hub"), ("a.py", 2, "hubs"), ("b.py", 1, "é hub"), ("c.py", 1, ""), ("c.py", 2, None)]
    df = spark.createDataFrame(lines, "path string, line int, txt string")
    assert sorted((r["path"], r["line"], r["col"]) for r in references.word_occurrences(df, "hub").collect()) == [("a.py", 1, 0), ("a.py", 1, 4), ("a.py", 1, 18), ("b.py", 1, 2)]
    t = spark.createDataFrame([(f"f{i:02d}", 1, "hub", 1) for i in range(7)], "path string, line int, name string, mult long")
    got = references.candidate_files(t, "hub", Options(candidate_files=5)).collect()
    assert [r["path"] for r in got] == [f"f{i:02d}" for i in range(5)] and all(r["truncated"] for r in got)
    assert not any(r["truncated"] for r in references.candidate_files(t, "hub", Options(candidate_files=7)).collect()) and references.candidate_files(t, "no").collect() == []


def test_rules_and_numbers(spark):
    assert [edges.adaptive_file_cap(n) for n in (0, 1_400, 70_000, 10**9)] == [5_000, 5_000, 100, 12]
    o = Options.from_env({"ORRERY_MAX_HOPS": "7", "ORRERY_MIN_SIMILARITY": "nan", "ORRERY_DAMPING": "x", "ORRERY_QUOTA_RATIO": "0.5"})
    assert (o.max_hops, o.min_similarity, o.damping, o.quota_ratio) == (7, DEFAULTS.min_similarity, DEFAULTS.damping, 0.5)
    report = spark.createDataFrame([(1.0, False), (None, True), (0.5, True)], "health double, dead boolean")
    assert rules.health_coverage(report).first().asDict() == {"total": 3, "covered": 2, "coverage": 0.667, "dead": 2}
    calls = spark.createDataFrame([("b", 1, "low"), ("z", 2, "high"), ("a", 2, "high"), ("c", 1, "high")], "name string, depth int, confidence string").withColumn("path", F.lit("p"))
    assert [r["name"] for r in graph.display_order(calls).collect()] == ["c", "a", "z", "b"]
    imports = spark.createDataFrame([("a.py", "os", None, "os", 1), ("a.py", "m.n", "x", "y", 2)], "path string, module string, name string, alias string, line int")
    tokens = spark.createDataFrame([("a.py", 1, "os", 1), ("a.py", 2, "y", 1), ("a.py", 3, "y", 1)], "path string, line int, name string, mult long")
    assert {r["verdict"] for r in rules.unused_imports(imports).collect()} == {"UNKNOWN_NO_LINTER"}
    assert {r["name"]: r["verdict"] for r in rules.unused_imports(imports, tokens).collect()} == {"os": "UNUSED_BY_NAME", "y": "KEEP"}
    assert len(rules.advisory({"LIKELY_UNUSED": 2, "UNKNOWN_NO_RESOLVER": 1, "KEEP": 5})) == 2 and rules.advisory({}) == []


def test_positions_in_order(spark):
    rows = [("common-prefix/" + f"{i * 37 % 500:05d}", i) for i in range(500)]
    df = spark.createDataFrame(rows, "path string, position0 int")
    got = {r["path"]: r["position"] for r in edges.positions(df, ["path"]).collect()}
    assert got == {p: i for i, (p, _) in enumerate(sorted(rows))} and edges.positions(df.limit(0), ["path"]).count() == 0


def test_versions_are_whole(spark, tmp_path, monkeypatch):
    t = tables.Snapshots(spark, str(tmp_path / "db"))
    files = spark.createDataFrame([("a.py", "1", 0.0)], "path string, content_hash string, indexed_at double")
    assert t.commit({"files": files}, 0) == 1
    # a writer that died left half a file: readers keep the last whole version, others wait, then pass it by
    left = tmp_path / "db" / "VERSION-000000000002"
    left.write_text('{"version": 2, "tab')
    assert t.version == 1 and t.read("files").count() == 1
    with pytest.raises(tables.StaleVersion):
        t.commit({"files": files}, 1)
    os.utime(left, (time.time() - 600,) * 2)
    assert t.commit({"files": files.limit(0)}, 1) == 3 and t.version == 3 and t.read("files").count() == 0
    # the check of the version and the creation of the file are not one step, but only one writer creates it
    real = tables.Snapshots.state
    monkeypatch.setattr(tables.Snapshots, "state", lambda self: real(self) | {"version": 2})
    with pytest.raises(tables.StaleVersion):
        t.commit({"files": files}, 2)
    monkeypatch.undo()
    assert t.replace("files", files, files.withColumn("content_hash", F.lit("9")), 3) == 4 and t.read("files").first()["content_hash"] == "9"


def test_exported_and_decorated_symbols():
    text = '__all__ = ["a", "C"]\n__all__ += ["X"]\n\n@app.route("/x")\ndef a():\n    def a(): pass\n\n\nclass C:\n    pass\n\n\nX = 1\nY = 2\n'
    got = {(r["name"], r["line"]): (r["exported"], r["decorators"]) for k, r in python_code.rows_of("m.py", text) if k == "symbol"}
    assert got[("a", 5)] == (True, ["@app.route('/x')"]) and got[("a", 6)][0] is False and got[("C", 9)][0] and got[("X", 13)][0] and not got[("Y", 14)][0]


def test_reports_of_a_fresh_index(spark, tmp_path):
    root = tmp_path / "repo"
    root.mkdir()
    (root / "core.py").write_text('"""The core of it. More."""\nimport click\nimport os\n\n__all__ = ["offered"]\n\n\ndef hub():\n    return 1\n\n\n@click.command()\ndef cli():\n    return hub()\n\n\ndef offered():\n    return 2\n\n\ndef main():\n    return 3\n\n\ndef lonely():\n    return 4\n')
    (root / "pyproject.toml").write_text('[project.scripts]\nrun = "core:main"\n')
    p = Project(spark, str(root), str(tmp_path / "store"))
    p.index_project()
    report = p.deadcode_report(by_name=True)
    verdicts = {r["name"]: r["verdict"] for r in report["symbols"].collect()}
    assert {k: verdicts[k] for k in ("hub", "cli", "offered", "main", "lonely")} == {"hub": "KEEP", "cli": "PUBLIC_API", "offered": "PUBLIC_API", "main": "PUBLIC_API", "lonely": "LIKELY_UNUSED"}
    assert report["summary"]["PUBLIC_API"] == 3 and len(report["advisory"]) == 1
    assert {r["name"]: r["verdict"] for r in report["imports"].collect()} == {"click": "KEEP", "os": "UNUSED_BY_NAME"}
    assert {r["verdict"] for r in p.deadcode_report()["imports"].collect()} == {"UNKNOWN_NO_LINTER"}
    assert [(r["symbol_name"], r["def_line"]) for r in p.definition_at("core.py", 14).collect()] == [("hub", 8)]
    assert sorted((r["line"], r["col"]) for r in p.occurrences("hub").collect()) == [(8, 4), (14, 11)]
    assert [r["path"] for r in p.candidate_files("hub").collect()] == ["core.py"] and {r["confidence"] for r in p.find_references("click").collect()} == {"low"}
    assert [(r["name"], r["important"]) for r in p.impact("hub", with_important=True).collect()] == [("cli", True)] and p.impact("hub", max_hops=0).collect() == []
    assert [r["description"] for r in p.describe_files().collect()] == ["The core of it."]
    assert p.health_coverage().first()["covered"] == 5 and p.comment_report()["files"].first()["n_comments"] == 1
    assert {k: v.count() for k, v in p.ai_usage_report().items()} == {"sites": 0, "channels": 0, "edges": 0, "providers": 0}
