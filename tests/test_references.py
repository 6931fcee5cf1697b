"""Which names mean which definition: imports, aliases, stars, modules, names handed on."""

from orrery.api import Project
from orrery.operators import references


def test_bindings_through_packages(spark, tmp_path):
    files = {
        "pkg/__init__.py": "from .core import hub\nfrom . import util as tools\n",
        "pkg/core.py": "def hub():\n    return 1\n\n\ndef spare():\n    return hub()\n\n\ndef idle():\n    return 0\n",
        "pkg/util.py": "def helper():\n    return 1\n\n\ndef lost():\n    return 2\n",
        "pkg/all.py": "from pkg.util import *\n",
        "other/core.py": "def hub():\n    return 3\n",
        "a.py": "from pkg import hub as h\n\n\ndef one():\n    return h()\n",
        "b.py": "import pkg.core\n\n\ndef two():\n    return pkg.core.spare()\n",
        "c.py": "from pkg.all import helper\n\nx = helper()\n",
        "d.py": "def hub():\n    return idle\n",
        "e.py": "from other.core import hub\n\nhub()\n",
    }
    for path, text in files.items():
        target = tmp_path / "repo" / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(text)
    p = Project(spark, str(tmp_path / "repo"), str(tmp_path / "store"))
    p.index_project()
    hub = {(r["src_path"], r["src_line"]): r["confidence"] for r in p.find_references("hub", def_path="pkg/core.py").collect()}
    assert hub == {
        ("pkg/__init__.py", 1): "high", ("pkg/core.py", 6): "high", ("a.py", 1): "high", ("a.py", 5): "high", ("d.py", 1): "low", ("e.py", 1): "low", ("e.py", 3): "low", ("other/core.py", 1): "low",
    }
    other = {(r["src_path"], r["src_line"]) for r in p.find_references("hub", def_path="other/core.py", include_low=False).collect()}
    assert other == {("e.py", 1), ("e.py", 3)}
    found = {(r["path"], r["name"]): (r["verdict"], r["high"], r["low"]) for r in p.find_deadcode().collect()}
    assert found["pkg/core.py", "spare"] == ("KEEP", 1, 0) and found["pkg/util.py", "helper"] == ("KEEP", 2, 0)
    assert found["pkg/util.py", "lost"] == ("LIKELY_UNUSED", 0, 0) and found["pkg/core.py", "idle"] == ("LIKELY_UNUSED", 0, 1)
    assert found["pkg/core.py", "hub"][0] == "KEEP" and found["pkg/core.py", "hub"][1:] == (4, 4)
    # counted by name or laid out, the low references are as many
    laid = references.resolved(p.tables.read("tokens"), p.tables.read("imports"), p.get_symbols()).groupBy("def_path", "symbol_name", "confidence").count().collect()
    laid = {(r["def_path"], r["symbol_name"], r["confidence"]): r["count"] for r in laid}
    for (path, name), (_, high, low) in found.items():
        assert (laid.get((path, name, "high"), 0), laid.get((path, name, "low"), 0)) == (high, low), (path, name)
    callers = {(r["name"], r["direction"]) for r in p.call_hierarchy("hub", def_path="pkg/core.py", max_hops=1).collect()}
    assert callers == {("one", "up"), ("spare", "up")}


def test_cycles_and_empty_tables(spark):
    imports = spark.createDataFrame([("a.py", "b", "f", "f", 1), ("b.py", "a", "f", "f", 1), ("a.py", None, None, None, 2)], "path string, module string, name string, alias string, line int")
    defs = spark.createDataFrame([("f", "c.py", 1)], "name string, def_path string, def_line int")
    assert references.bindings(imports, defs).collect() == []
    start = imports.union(spark.createDataFrame([("a.py", "c", "f", "f", 3)], imports.schema))
    assert {(r["path"], r["bound"]) for r in references.bindings(start, defs).collect()} == {("a.py", "f"), ("b.py", "f")}
    assert references.bindings(imports.limit(0), defs).collect() == references.bindings(start, defs.limit(0)).collect() == []
