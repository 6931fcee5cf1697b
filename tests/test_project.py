"""A small repository, indexed and asked."""

import ast

import pytest

from orrery.api import NotIndexed, Project
from orrery.sources import python_code

SAMPLE = 'class Animal:\n    def speak(self):\n        return "woof"\n\n    def nested_owner(self):\n        def inner():\n            return 1\n        return inner\n\n\ndef top_level(x):\n    return x\n\n\nCONST_X = 42\nconfig = {"a": 1}\n'


def test_symbols_of_a_sample():
    got = [(r["kind"], r["name"], r["line"], r["end_line"], r["scope"]) for k, r in python_code.rows_of("s.py", SAMPLE) if k == "symbol"]
    assert got == [
        ("class", "Animal", 1, 8, ""), ("function", "speak", 2, 3, "Animal"), ("function", "nested_owner", 5, 8, "Animal"), ("function", "inner", 6, 7, "Animal.nested_owner"), ("function", "top_level", 11, 12, ""),
        ("variable", "CONST_X", 15, 15, ""), ("variable", "config", 16, 16, ""),
    ]
    assert list(python_code.rows_of("bad.py", "def (")) == []


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("return 1", 0), ("if a:\n  pass", 1), ("if a:\n  pass\nelif b:\n  pass\nelse:\n  pass", 3), ("for x in y:\n  if x:\n    pass", 3), ("return a and b and c", 1), ("return a and b or c", 2),
        ("try:\n  pass\nexcept E:\n  if a:\n    pass", 3), ("return f(n - 1)", 1), ("return 1 if a else 2", 1), ("return [x for x in y if x]", 2), ("while a:\n  break\nelse:\n  pass", 1),
    ],
)
def test_cognitive_complexity(body, want):
    tree = ast.parse("def f(n):\n" + "\n".join("  " + line for line in body.split("\n")))
    assert python_code.cognitive(tree.body[0]) == want


def test_project(spark, tmp_path):
    root = tmp_path / "repo"
    (root / "pkg").mkdir(parents=True)
    (root / "node_modules").mkdir()
    (root / "node_modules" / "x.py").write_text("def hidden(): pass\n")
    loop = "def {n}({a}):\n    total = 0\n    for i in range({a}):\n        if i % 2:\n            total += i\n    return total\n"
    (root / "pkg" / "core.py").write_text('"""Module."""\n\n\ndef hub():\n    """Doc."""\n    return 1\n\n\ndef lonely():\n    # TODO wire\n    return 2\n')
    (root / "pkg" / "use.py").write_text("from pkg.core import hub\n\n\ndef caller():\n    return hub() + hub()\n")
    (root / "pkg" / "loops.py").write_text(loop.format(n="one", a="k") + "\n\n" + loop.format(n="two", a="m"))
    p = Project(spark, str(root), str(tmp_path / "store"))
    assert p.status() == {"indexed": False, "version": 0}
    with pytest.raises(NotIndexed):
        p.get_map()
    assert p.index_project() == {"new": 3}
    assert p.index_project() == {"same": 3} and p.status()["version"] == 1
    assert {r["name"] for r in p.get_symbols().collect()} == {"hub", "lonely", "caller", "one", "two"}
    refs = {(r["src_path"], r["src_line"], r["confidence"], r["multiplicity"]) for r in p.find_references("hub").collect()}
    assert refs == {("pkg/use.py", 1, "high", 1), ("pkg/use.py", 5, "high", 2)} and p.reference_level("hub") == "high"
    p.build_refs("hub")
    assert [(r["name"], r["direction"]) for r in p.call_hierarchy("hub").collect()] == [("caller", "up")]
    assert [r["bucket"] for r in p.impact("hub").collect()] == ["prod"]
    ranks = {r["id"]: r["score"] for r in p.get_map().collect()}
    assert ranks["pkg/core.py:4:function"] > ranks["pkg/core.py:9:function"]
    assert {r["name"] for r in p.find_unwired().collect()} >= {"lonely", "caller"}
    assert {r["name"]: r["verdict"] for r in p.find_deadcode("pkg/core.py").collect()} == {"hub": "KEEP", "lonely": "LIKELY_UNUSED"}
    assert [(r["line"], r["tag"]) for r in p.find_comment_tags().collect()] == [(10, "TODO")]
    assert {r["kind"]: r["documented"] for r in p.get_comment_overview().collect()}["function"] == 1
    assert {(r["verdict"], r["size"]) for r in p.find_duplicates().collect()} == {("RENAMED_DUP", 2)}
    assert p.get_health().count() == 5 and p.find_ai_usage().collect() == []
    (root / "pkg" / "use.py").unlink()
    (root / "pkg" / "core.py").write_text("def hub():\n    return 1\n")
    p.index_paths(["pkg/use.py", "pkg/core.py"])
    assert {r["name"] for r in p.get_symbols().collect()} == {"hub", "one", "two"} and p.status()["refs"] == 0


def test_deadcode_and_hierarchy_of_a_fresh_index(spark, tmp_path):
    root = tmp_path / "repo"
    root.mkdir()
    (root / "core.py").write_text("def hub():\n    return 1\n\n\ndef lonely():\n    return 2\n\n\ndef named():\n    return 3\n")
    (root / "other.py").write_text("def hub():\n    return 0\n")
    (root / "use.py").write_text("from core import hub\n\n\ndef caller():\n    named = 4\n    return hub() + named\n")
    p = Project(spark, str(root), str(tmp_path / "store"))
    p.index_project()
    # names in a file that does not import them are low, and the hub that nobody imports is unused
    verdicts = {(r["path"], r["name"]): (r["verdict"], r["high"], r["low"]) for r in p.find_deadcode().collect()}
    assert verdicts[("core.py", "hub")] == ("KEEP", 2, 1) and verdicts[("other.py", "hub")] == ("LIKELY_UNUSED", 0, 3)
    assert verdicts[("core.py", "lonely")] == ("LIKELY_UNUSED", 0, 0) and verdicts[("core.py", "named")] == ("LIKELY_UNUSED", 0, 2)
    assert p.status()["refs"] == 0 and p.call_hierarchy("hub", build_edges=False).collect() == []
    assert [(r["name"], r["direction"]) for r in p.call_hierarchy("hub").collect()] == [("caller", "up")]
    assert p.status()["refs"] == 2 and p.call_hierarchy("hub", def_path="other.py").collect() == [] and p.status()["refs"] == 2
    q = Project(spark, str(root), str(tmp_path / "store2"))
    q.index_project()
    assert [(r["name"], r["bucket"]) for r in q.impact("hub").collect()] == [("caller", "prod")]
    assert q.impact("nothing").collect() == []
