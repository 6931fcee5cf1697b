"""Duplicates, comments, rules, snapshots, sections, retention, streaming."""

import zlib

import pytest
from pyspark.sql import functions as F

from orrery.operators import clones, comments, retention, rules, sections, tables
from orrery.functions import scalars as S
from orrery.options import DEFAULTS, Options
from orrery.streaming import changes

FP = "path string, name string, kind string, line int, end_line int, scope string, shape_hash string, raw_token_hash string, call_hash string, node_count int, nstmts int, has_control_flow boolean, cognitive int"


def fp(path, line, shape, raw, *, call=None, nodes=20, flow=True, cognitive=None):
    return (path, f"f{line}", "function", line, line + 5, "", shape, raw, call, nodes, 3, flow, cognitive)


def test_exact_and_renamed_in_one_shape(spark):
    rows = [fp("a.py", 1, "s", "r1"), fp("b.py", 1, "s", "r1"), fp("c.py", 1, "s", "r2"), fp("d.py", 1, "g", "r3", nodes=5), fp("e.py", 1, "g", "r3", nodes=5)]
    df = spark.createDataFrame(rows, FP)
    got = {(r["verdict"], r["size"], tuple(m["path"] for m in r["members"])) for r in clones.shape_groups(df).collect()}
    assert got == {("EXACT_DUP", 2, ("a.py", "b.py")), ("RENAMED_DUP", 2, ("a.py", "c.py"))}
    assert [r["shape_hash"] for r in clones.suppressed_shapes(df).collect()] == ["g"]
    scoped = clones.duplicates(df, spark.createDataFrame([], "path string, line int, fp_value bigint"), scope_file="b.py")
    assert {r["verdict"] for r in scoped.collect()} == {"EXACT_DUP"}


def test_call_patterns_need_two_shapes(spark):
    df = spark.createDataFrame([fp("a.py", 1, "s1", "r1", call="c"), fp("b.py", 1, "s2", "r2", call="c"), fp("c.py", 1, "s3", "r3", call="d"), fp("d.py", 1, "s3", "r4", call="d"), fp("e.py", 1, "s4", "r5")], FP)
    assert [(r["call_hash"], r["shapes"]) for r in clones.call_patterns(df).collect()] == [("c", 2)]


def winnowed(tokens, k=5, w=4):
    if not tokens:
        return set()
    grams = [zlib.crc32(" ".join(tokens[i : i + k]).encode()) for i in range(max(1, len(tokens) - k + 1))]
    return {min(grams[i : i + w]) for i in range(max(1, len(grams) - w + 1))}


def test_winnow_short_and_long(spark):
    cases = [[], ["a"], list("abcd"), list("abcde"), list("abcdef"), list("abcdefgh"), list("abcabcabcabcabcabc"), [str(i * i % 17) for i in range(60)]]
    df = spark.createDataFrame([(str(i), i, t) for i, t in enumerate(cases)], "path string, line int, tokens array<string>")
    got = {}
    for r in clones.fingerprint_index(df, digest=F.crc32).collect():
        assert r["fp_value"] not in got.setdefault(r["line"], set())
        got[r["line"]].add(r["fp_value"])
    assert all(got.get(i, set()) == winnowed(t) for i, t in enumerate(cases))


def test_near_pairs_scope_and_flood(spark):
    sets = {"a": range(100, 120), "b": range(101, 121), "c": range(100, 140), "d": range(500, 504)}
    rows = [(u, v) for u, vs in sets.items() for v in vs] + [(u, 7) for u in "abcd"] + [(f"x{i}", 7) for i in range(60)]
    idx = spark.createDataFrame(rows, "unit string, fp_value bigint")
    units = spark.createDataFrame([(u, u) for u in sets], "unit string, shape_hash string")
    assert [(r["a"], r["b"], r["shared"], r["similarity"]) for r in clones.near_pairs(idx, units).collect()] == [("a", "b", 19, 0.905)]
    scope = spark.createDataFrame([("a",)], "unit string")
    whole = {(r["a"], r["b"]) for r in clones.near_pairs(idx, units, scope=scope).collect()}
    cut = {(r["a"], r["b"]): r["similarity"] for r in clones.near_pairs(idx, units, scope=scope, compat=True).collect()}
    # c's set is cut to a's values, which makes them look the same
    assert whole == {("a", "b")} and cut[("a", "c")] == 1.0


COMMENT = "path string, line int, end_line int, kind string, is_doc boolean, tag string, scope string, owner_line int, text string"


def test_markers_report_their_own_line(spark):
    df = spark.createDataFrame([("a.py", 10, 12, "block", False, "TODO", "", None, "x\n TODO one\nFIXME two TODO three"), ("a.py", 20, 20, "line", False, None, "", None, "TODOS are none, todo neither")], COMMENT)
    rows = {(r["line"], r["tag"]) for r in comments.tag_lines(df).collect()}
    assert rows == {(11, "TODO"), (12, "FIXME")}
    assert {(r["tag"], r["n"]) for r in comments.tag_counts(df).collect()} == {("TODO", 1), ("FIXME", 1)}
    assert comments.select_comments(df, tag="todo").count() == 1 and comments.tag_lines(df, tag="fixme").count() == 1


def test_coverage_and_density(spark):
    s = spark.createDataFrame([("a.py", "function", "f", 1, 3, ""), ("a.py", "function", "_g", 5, 6, ""), ("a.py", "class", "K", 8, 17, ""), ("a.py", "function", "m", 9, 10, "K")], "path string, kind string, name string, line int, end_line int, scope string")
    c = spark.createDataFrame([("a.py", 2, 2, "doc", True, None, "f", 1, "d"), ("a.py", 9, 9, "line", False, None, "", None, "x")], COMMENT)
    rows = comments.documented(s, c)
    got = {r["kind"]: (r["documented"], r["total"], r["pct"]) for r in comments.coverage(rows).collect()}
    assert got == {"function": (1, 2, 50.0), "class": (0, 1, 0.0), None: (1, 3, 33.3)}
    assert [r["name"] for r in comments.undocumented(rows).collect()] == ["K", "m"]
    assert comments.density(c, s).first()["density"] == round(2 / 15, 3)


def test_health_renormalises(spark):
    df = spark.createDataFrame([(200, 1, None), (80, 2, None), (10, 1, 25), (None, 1, 3), (140, 1, 8)], "n int, c int, g int")
    got = [r[0] for r in df.select(S.health(F.col("n"), F.col("c"), F.col("g"))).collect()]
    assert got == [round(1 - 0.25 / 0.55, 4), round(1 - 0.3 / 0.55, 4), round(1 - 0.3 / 0.85, 4), None, round(1 - 0.125 / 0.85, 4)]


def test_entry_points(spark):
    cases = [("src/pages/x.tsx", "pages"), ("a/app/b/route.ts", "app router"), ("t/test_x.py", "pytest"), ("tests/u.py", "test directory"), ("x/__main__.py", "module"), ("src/main.ts", "front-end"), ("src/core.py", None), ("win\\tests\\a.py", "test directory")]
    for r, (_, want) in zip(spark.createDataFrame(cases, "path string, want string").select(rules.entry_reason("path").alias("x")).collect(), cases, strict=True):
        assert (r["x"] is None) == (want is None) and (want is None or want in r["x"])
    decorators = [(["@app.get('/x')"], True), (["@functools.cache"], False), (["@task"], True), ([], False)]
    assert [r[0] for r in spark.createDataFrame(decorators, "d array<string>, w boolean").select(rules.decorated_entry("d")).collect()] == [w for _, w in decorators]


def sites(spark, *texts):
    df = spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(texts)], "path string, text string")
    return {(r["path"], r["line"], r["provider"], r["channel"]) for r in rules.provider_sites(df).collect()}


def test_provider_context(spark):
    got = sites(
        spark,
        'from openai import OpenAI\nc = OpenAI(base_url="https://api.deepseek.com/v1")',
        "from openai import OpenAI\nc = OpenAI()\nx = c.chat.completions.create()",
        'from openai import OpenAI\nc = OpenAI(base_url="http://localhost:11434/v1")\n',
        "model.generate_content(1)",
        'subprocess.run(["gemini-cli"])\n\nrequests.get("https://api.groq.com")',
    )
    assert got == {("f0", 2, "deepseek", "direct"), ("f1", 2, "openai", "direct"), ("f1", 3, "openai", "direct"), ("f2", 2, "ollama", "local"), ("f4", 1, "gemini", "cli"), ("f4", 3, "groq", "direct")}


def test_orphans(spark):
    s = spark.createDataFrame([("a.py", "function", n, i, i, "") for i, n in enumerate("fghk", 1)] + [("tests/t.py", "function", "t", 1, 1, "")], "path string, kind string, name string, line int, end_line int, scope string")
    r = spark.createDataFrame([("a.py", 1, "high", False), ("a.py", 2, "high", True), ("a.py", 3, "low", False)], "def_path string, def_line int, confidence string, reexport boolean")
    got = {x["name"]: x["verdict"] for x in rules.orphans(s, r, engine=F.lit("relational")).collect()}
    assert got == {"f": "KEEP", "g": "REEXPORT_ONLY", "h": "LIKELY_UNUSED", "k": "LIKELY_UNUSED", "t": "PUBLIC_API"}
    assert {x["verdict"] for x in rules.orphans(s.limit(4), r, engine=F.lit("none")).collect()} == {"UNKNOWN_NO_RESOLVER"}


def test_sections():
    part = sections.Section
    assert sections.allocate([part("a", 3), part("b", 4)], 10) == {"a": 3, "b": 4}
    assert sections.allocate([part("a", 10, 1, 4), part("b", 10, 1, 4)], 0) == {"a": 4, "b": 4}
    got = sections.allocate([part("hi", 20, 3, 1), part("lo", 20, 1, 1)], 12)
    assert sum(got.values()) == 12 and got["hi"] > got["lo"] >= 1
    assert sections.allocate([part("a", 9)], 2, full=True) == {"a": 9}


def test_sections_keep_a_low_priority_floor_and_deal_the_whole_budget():
    part = sections.Section
    got = sections.allocate([part("hi", 50, 10), part("crit", 10, 1, 3)], 10)
    assert got["crit"] >= 3 and sum(got.values()) == 10
    assert sections.allocate([part("a", 0), part("b", 10)], 3) == {"a": 0, "b": 3}
    even = sections.allocate([part(x, 30) for x in "abc"], 31)
    assert sum(even.values()) == 31 and max(even.values()) - min(even.values()) <= 1
    # no claim that was met is dearer than one that was not
    parts = [part("a", 17, 2, 1), part("b", 40, 1), part("c", 5, 7), part("d", 9, 0)]
    for budget in range(1, 72):
        got = sections.allocate(parts, budget)
        assert sum(got.values()) == min(71, budget)
        price = lambda s, k: k / (s.priority * (s.size - s.min_keep)) if s.priority else float("inf")
        met = [price(s, k) for s in parts for k in range(1, got[s.name] - s.min_keep + 1)]
        unmet = [price(s, k) for s in parts for k in range(got[s.name] - s.min_keep + 1, s.size - s.min_keep + 1)]
        assert max(met, default=0) <= min(unmet, default=float("inf"))


def test_sections_of_a_table(spark):
    parts = [("a", 17, 2, 1), ("b", 40, 1, 0), ("c", 5, 7, 9), ("d", 9, 0, 0), ("e", 0, 3, 2), ("f", 4, None, None)]
    df = spark.createDataFrame(parts, "name string, size int, priority int, min_keep int")
    own = [sections.Section(n, s, 1 if p is None else p, m or 0) for n, s, p, m in parts]
    for budget in (0, 3, 20, 70, 200):
        got = {r["name"]: r["shown"] for r in sections.allotted(df, budget).collect()}
        assert got == sections.allocate(own, budget)
    assert all(r["shown"] == r["size"] and r["elided"] == 0 for r in sections.allotted(df, 2, full=True).collect())
    assert sections.allotted(df.limit(0), 5).count() == 0
    rows = spark.createDataFrame([(n, i) for n, s, *_ in parts for i in range(s)], "name string, at int")
    kept = sections.take_sections(rows, "name", ["at"], sections.allotted(df, 20)).collect()
    shown = sections.allocate(own, 20)
    assert sorted((r["name"], r["at"]) for r in kept) == sorted((n, i) for n, k in shown.items() for i in range(k))


def test_retention(spark):
    rows = spark.createDataFrame([("a", 1, 40), ("b", 2, 40), ("c", 3, 40)], "key string, last_access long, bytes long")
    got = {r["key"]: r["evict"] for r in retention.evictions(rows, 100, 0.9, bucket=F.floor(F.col("last_access") / 2)).collect()}
    assert got == {"a": True, "b": False, "c": False}
    assert not any(r["evict"] for r in retention.evictions(rows, 1000, 0.9, bucket=F.lit(0)).collect())


def test_snapshots_replace_and_fence(spark, tmp_path):
    t = tables.Snapshots(spark, str(tmp_path / "db"))
    assert t.version == 0 and t.read("files").count() == 0
    files = spark.createDataFrame([("a.py", "1", 0.0), ("b.py", "2", 0.0)], "path string, content_hash string, indexed_at double")
    refs = spark.createDataFrame([("a.py", 1, "f", "b.py", 1, "high"), ("b.py", 1, "g", "a.py", 1, "high"), ("c.py", 1, "h", "c.py", 2, "high")], "src_path string, src_line int, symbol_name string, def_path string, def_line int, confidence string")
    assert t.commit({"files": files, "refs": refs}, 0) == 1
    gone = spark.createDataFrame([("b.py",)], "path string")
    assert t.replace_files(gone, {}, 1) == 2
    assert [r["path"] for r in t.read("files").collect()] == ["a.py"] and [r["src_path"] for r in t.read("refs").collect()] == ["c.py"]
    with pytest.raises(tables.StaleVersion):
        t.commit({"files": files}, 1)
    assert t.put_meta({"sha": "x"}, 2) == 3 and t.put_meta({"sha": "x"}, 3) == 3
    assert t.replace_refs("c.py", "h", refs.limit(0), 3) == 4 and t.read("refs").count() == 0


def test_stream_debounce_and_maintenance(spark, tmp_path):
    events = spark.createDataFrame([("a.py", "2024-01-01 00:00:00"), ("b.py", "2024-01-01 00:00:01"), ("a.py", "2024-01-01 00:00:10")], "path string, ts string").withColumn("ts", F.to_timestamp("ts")).withColumn("k", F.lit(1))
    got = sorted((r["n_events"], tuple(r["changed"])) for r in changes.debounced(events, "k", "ts", "2 seconds", "path").collect())
    assert got == [(1, ("a.py",)), (2, ("a.py", "b.py"))]
    events.select("path").write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema("path string").parquet(str(tmp_path / "in"))
    changes.maintain(stream, seen.append, str(tmp_path / "ck"), once=True).awaitTermination(60)
    assert sorted(p for batch in seen for p in batch) == ["a.py", "b.py"]


def test_options_are_guarded():
    assert Options(min_similarity=7).min_similarity == 1.0 and Options(min_similarity=float("nan")).min_similarity == 0.8 and DEFAULTS.max_hops == 5


def test_text_index_equals_the_expressions(spark):
    import random

    from orrery.operators import winnow

    rnd = random.Random(4)
    texts = [None, "", " ,.", "One", "a b c d", "A b, c-d e", "Kelvin İx Été a1 B2 c3", "x " * 40]
    # five words and four spaces: one block holds 55 bytes
    texts += [" ".join(["q" * 10] * 4 + ["q" * n]) for n in range(9, 15)] + ["w" * 500, " ".join(["z" * 70] * 9)]
    texts += ["; ".join("".join(rnd.choice("abcXYZ09") for _ in range(rnd.choice([1, 3, 8, 13]))) for _ in range(n)) for n in (5, 6, 7, 8, 9, 10, 200, 5000)]
    # an id that repeats has the values of all its rows
    docs = spark.createDataFrame([(max(i, 1), t) for i, t in enumerate(texts)], "doc_id int, text string")
    words = F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda x: x != "")
    want = clones.fingerprint_index(docs, words, keys=("doc_id",))
    got = winnow.text_index(docs, "doc_id")
    assert got.dtypes == want.dtypes and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_near_pairs_deal_the_index_out_once(spark):
    rows = [(u, v) for u in "ab" for v in range(30)] * 2 + [(f"x{i}", 7) for i in range(60)]
    got = clones.near_pairs(spark.createDataFrame(rows, "unit string, fp_value bigint"), spark.createDataFrame([(u, u) for u in "ab"], "unit string, shape_hash string"))
    assert [tuple(r) for r in got.collect()] == [("a", "b", 29, 1.0)]
    # values were counted, filtered and joined by shuffles of their own
    assert "hashpartitioning(fp_value" not in got._jdf.queryExecution().executedPlan().toString()
