"""Ranking and traversal: worked goldens, a dense model, and traps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.functions import scalars as S
from orrery.operators import edges, graph
from orrery.plans import ranking

SYM = "path string, kind string, name string, line int, end_line int, scope string"
REF = "src_path string, src_line int, symbol_name string, def_path string, def_line int, confidence string"


def syms(spark, rows):
    return spark.createDataFrame([(p, "function", n, a, b, "") for p, n, a, b in rows], SYM)


def refs(spark, rows):
    return spark.createDataFrame([(p, line, n, dp, dl, c) for p, line, n, dp, dl, c in rows], REF)


# fixed values: published scores of small graphs
GOLDEN = [
    ([("a.py", "a", 1, 5), ("b.py", "b", 1, 5), ("c.py", "c", 1, 5)], [("b.py", 3, "c", "c.py", 1, "high"), ("a.py", 3, "b", "b.py", 1, "high")], (), {"a": 0.18441687554671377, "b": 0.3411710064820744, "c": 0.47441211797121147}),
    ([("a.py", "a", 1, 2), ("a.py", "b", 3, 4)], [], (), {"a": 0.5, "b": 0.5}),
    ([("a.py", "alpha", 1, 2), ("a.py", "beta", 3, 4)], [], ("alpha",), {"alpha": 0.9166666666666665, "beta": 0.08333333333333333}),
    ([("hub.py", "h", 1, 5), ("x.py", "x", 1, 5), ("y.py", "y", 1, 5)], [("x.py", 3, "h", "hub.py", 1, "high"), ("y.py", 3, "h", "hub.py", 1, "high")], (), {"h": 0.5744682493359963, "x": 0.2127658753320017, "y": 0.2127658753320017}),
    ([("t.py", "t", 1, 5)], [("nowhere.py", 1, "t", "t.py", 1, "high")], (), {"t": 6.666661843244464}),
    ([("f.py", "outer", 1, 10), ("f.py", "inner", 3, 5), ("g.py", "g", 1, 2)], [("f.py", 4, "g", "g.py", 1, "high")], (), {"outer": 0.2597402794376637, "inner": 0.2597402794376637, "g": 0.4805194411246723}),
    (
        [("a.py", "caller_a", 1, 5), ("b.py", "caller_b", 1, 5), ("good.py", "calculate_total", 1, 5), ("bad.py", "x", 1, 5)],
        [("a.py", 3, "calculate_total", "good.py", 1, "high"), ("b.py", 3, "x", "bad.py", 1, "high")],
        (),
        {"caller_a": 0.1754385605886293, "caller_b": 0.1754385605886293, "calculate_total": 0.3245614394113706, "x": 0.3245614394113706},
    ),
]


@pytest.mark.parametrize("case", GOLDEN)
def test_golden_scores(spark, case):
    symbols, rows, focus, want = case
    s, r = syms(spark, symbols), refs(spark, rows)
    out = ranking.symbol_map(s, r, budget=2000, focus_names=list(focus))
    got = {x["id"].split(":")[0] + x["id"].split(":")[1]: x["score"] for x in out.collect()}
    assert got == pytest.approx({p + str(a): want[n] for p, n, a, _ in symbols}, abs=1e-8)


def dense(n, rows, ext, n_refs, p, rounds):
    w = np.zeros((n, n))
    for a, b, x in rows:
        w[a, b] += x
    out = w.sum(axis=1)
    t = np.divide(w, out[:, None], out=np.zeros_like(w), where=out[:, None] > 0)
    s = p.copy()
    for _ in range(rounds):
        s = (0.15 + 0.85 * s[out == 0].sum()) * p + 0.85 * (s @ t + ext / n_refs)
    return s


def test_pagerank_equals_a_dense_model(spark):
    rnd = np.random.default_rng(4)
    n, p = 30, rnd.random(30)
    p /= p.sum()
    rows = [(int(rnd.integers(20)), int(rnd.integers(25)), float(rnd.random() + 0.1)) for _ in range(40)]
    ext = np.zeros(n)
    ext[3], ext[29] = 2.0, 0.5
    nodes = spark.createDataFrame([(i, float(p[i])) for i in range(n)], "id int, weight double")
    e = spark.createDataFrame(rows, "src int, dst int, weight double")
    inflow = spark.createDataFrame([(3, 2.0), (29, 0.5)], "id int, weight double")
    got = {r["id"]: r["score"] for r in graph.pagerank(nodes, e, inflow=inflow, n_refs=7, rounds=7, tolerance=None).collect()}
    assert np.allclose([got[i] for i in range(n)], dense(n, rows, ext, 7, p, 7), atol=1e-12)


def test_name_quality(spark):
    # fixed values: names, defining files and multipliers
    cases = [("_helper", 1, 0.1), ("calculate_total", 1, 10.0), ("calculate_total", 10, 1.0), ("run", 1, 1.0), ("getValue", 1, 10.0), ("x", 1, 1.0), ("MyLongClassName", 1, 10.0), ("MyLongClassName", 6, 1.0), ("_x", 8, 0.01)]
    df = spark.createDataFrame(cases, "name string, files int, want double").withColumn("got", S.quality("name", "files"))
    assert all(abs(r["got"] - r["want"]) < 1e-12 for r in df.collect())
    names = [("get_value", True), ("getValue", True), ("MyClass", True), ("_x", False), ("run", False), ("HTTP", False), ("a", False), ("_private_long", False)]
    assert all(r["got"] == r["want"] for r in spark.createDataFrame(names, "name string, want boolean").withColumn("got", S.well_named("name")).collect())


def chain(spark):
    s = syms(spark, [("l.py", "leaf", 1, 3), ("m.py", "mid", 1, 3), ("t.py", "top", 1, 3)])
    return s, refs(spark, [("m.py", 2, "leaf", "l.py", 1, "high"), ("t.py", 2, "mid", "m.py", 1, "low")])


def seed(spark, name, path):
    return spark.createDataFrame([(name, path)], "name string, path string")


def test_traversal_depth_confidence_and_cap(spark):
    s, r = chain(spark)
    up = {x["name"]: (x["depth"], x["confidence"]) for x in graph.traverse(r, s, seed(spark, "leaf", "l.py")).collect()}
    assert up == {"mid": (1, "high"), "top": (2, "low")}
    assert {x["name"] for x in graph.traverse(r, s, seed(spark, "leaf", "l.py"), max_hops=1).collect()} == {"mid"}
    down = {x["name"]: x["depth"] for x in graph.traverse(r, s, seed(spark, "top", "t.py"), "down").collect()}
    assert down == {"mid": 1, "leaf": 2}
    assert graph.traverse(r, s, seed(spark, "none", "x.py")).collect() == []
    with pytest.raises(ValueError):
        graph.traverse(r, s, seed(spark, "leaf", "l.py"), "sideways")


def test_cycle_brings_the_seed_back(spark):
    s = syms(spark, [("a.py", "a", 1, 3), ("b.py", "b", 1, 3)])
    r = refs(spark, [("a.py", 2, "b", "b.py", 1, "high"), ("b.py", 2, "a", "a.py", 1, "high")])
    assert {(x["name"], x["depth"]) for x in graph.traverse(r, s, seed(spark, "a", "a.py")).collect()} == {("b", 1), ("a", 2)}


def test_all_enclosing_symbols_are_callers(spark):
    s = spark.createDataFrame([("c.py", "class", "K", 1, 9, ""), ("c.py", "function", "m", 2, 4, "K"), ("d.py", "function", "f", 1, 2, "")], SYM)
    r = refs(spark, [("c.py", 3, "f", "d.py", 1, "high"), ("c.py", 20, "f", "d.py", 1, "high")])
    assert {x["name"] for x in graph.traverse(r, s, seed(spark, "f", "d.py")).collect()} == {"K", "m"}
    inner = {(x["src_line"]): x["node_name"] for x in edges.innermost(r, s).collect()}
    assert inner == {3: "m", 20: "K"}


def tokens_of(spark, files):
    lines = [(p, i, t) for p, text in files.items() for i, t in enumerate(text.split("\n"), 1)]
    return edges.tokens(spark.createDataFrame(lines, "path string, line int, txt string"))


def test_name_graph_traps(spark):
    files = {"a.py": "def shared():\n  return shared", "b.py": "def shared():\n  pass", "use.py": "shared() + shared() + shared()", "d.py": "dup"}
    s = syms(spark, [("a.py", "shared", 1, 2), ("b.py", "shared", 1, 2)] + [(f"x{i}.py", "dup", 1, 1) for i in range(21)])
    rows = edges.name_edges(tokens_of(spark, files), s).collect()
    got = {(r["src_path"], r["src_line"], r["def_path"]): r["multiplicity"] for r in rows}
    assert got == {("use.py", 1, "a.py"): 3, ("use.py", 1, "b.py"): 3, ("a.py", 1, "b.py"): 1, ("a.py", 2, "b.py"): 1, ("b.py", 1, "a.py"): 1}
    usage = {(r["path"], r["name"]): r["usage"] for r in edges.external_usage(s, edges.name_edges(tokens_of(spark, files), s)).collect()}
    direct = {(r["path"], r["name"]): r["usage"] for r in edges.direct_usage(tokens_of(spark, files), s).collect()}
    assert usage == direct and usage[("a.py", "shared")] == 4 and usage[("x0.py", "dup")] == 0
    assert {r["verdict"] for r in edges.unwired(s, edges.direct_usage(tokens_of(spark, files), s)).collect()} == {"UNKNOWN_FANOUT"}


def test_multiplicity_equals_repeated_edges(spark):
    one = refs(spark, [("a.py", 1, "f", "b.py", 1, "low")])
    thrice = edges.collapse(one.union(one).union(one)).first()["mult"]
    assert thrice == edges.collapse(one.withColumn("multiplicity", F.lit(3))).first()["mult"] == 3
    assert edges.collapse(one.withColumn("multiplicity", F.lit(-2))).first()["mult"] == 1


def test_impact_buckets(spark):
    rows = spark.createDataFrame([("t", "tests/test_a.py", 1, 1, "high"), ("p", "pkg/pages/x.py", 1, 1, "high"), ("q", "src/q.py", 1, 2, "high"), ("u", "src/u.py", 1, 1, "low")], "name string, path string, line int, depth int, confidence string")
    s = graph.impact_summary(graph.impact(rows, rows.filter("name = 'q'"), entry=F.col("path").contains("/pages/"))).first()
    assert (s["direct"], s["transitive"], s["test"], s["entrypoint"], s["prod"], s["uncertain"], s["important"], s["files"]) == (2, 1, 1, 1, 1, 1, 1, 3)


def map_by_hand(docs):
    """Scores of all symbols and the rounds that the tolerance took, in plain Python."""
    symbols, toks = [], []
    for doc_id, source, text in docs:
        path, lines = f"{source}/{doc_id}", text.split("\n")
        toks += [(path, i, t, lines[i - 1].split().count(t)) for i in range(1, len(lines) + 1) for t in set(lines[i - 1].split())]
        symbols += [(path, "module", lines[0].split()[0], 1, len(lines))] + [(path, "block", lines[k].split()[0], k + 1, min(k + 5, len(lines))) for k in range(0, len(lines), 5)]
    defs, last, weight = {}, {}, {}
    for s in symbols:
        defs.setdefault(s[2], []).append(s)
        last[s[0], s[3]] = max(last.get((s[0], s[3]), ((0, "", ""), ""))[0], (s[4], s[1], s[2])), s[2]
    edges = {}
    for path, line, name, n in toks:
        for place in {(d[0], d[3]) for d in defs.get(name, []) if len(defs[name]) <= 20 and not (d[0] == path and d[3] <= line <= d[4])}:
            edges[path, line, *place] = edges.get((path, line, *place), 0) + n
    for (path, line, dpath, dline), n in edges.items():
        (_, kind, name), _ = last[dpath, dline]
        _, _, k, at = max((s[3], s[4], s[1], s[3]) for s in symbols if s[0] == path and s[3] <= line <= s[4])
        src, dst = f"{path}:{at}:{k}", f"{dpath}:{dline}:{kind}"
        files = len({d[0] for d in defs[name]})
        q = (0.1 if name[0] == "_" else 10.0 if len(name) >= 8 and "_" in name else 1.0) * (0.1 if files > 5 else 1.0)
        if src != dst:
            weight[src, dst] = weight.get((src, dst), 0) + 0.25 * n * q
    ids = [f"{s[0]}:{s[3]}:{s[1]}" for s in symbols]
    out = {}
    for (src, _), w in weight.items():
        out[src] = out.get(src, 0) + w
    score = dict.fromkeys(ids, 1 / len(ids))
    for rounds in range(1, 101):
        mass = sum(v for i, v in score.items() if i not in out)
        new = {i: (0.15 + 0.85 * mass) / len(ids) for i in ids}
        for (src, dst), w in weight.items():
            new[dst] += 0.85 * score[src] * w / out[src]
        moved, score = sum(abs(new[i] - score[i]) for i in ids), new
        if moved < 1e-6:
            break
    return score, rounds


def test_map_of_all_sources(spark, tmp_path):
    import random

    from orrery.plans.ranking import map_whole

    rnd = random.Random(4)
    names = [f"n{i}" for i in range(30)] + ["_own", "well_named", "other_name", "src"]
    docs = [(i, f"src{i % 4}", "\n".join(" ".join(rnd.choice(names) for _ in range(rnd.randrange(1, 5))) for _ in range(rnd.randrange(1, 14)))) for i in range(24)]
    spark.createDataFrame(docs, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want, rounds = map_by_hand(docs)
    got = {r["id"]: r["score"] for r in map_whole(spark, str(tmp_path)).collect()}
    assert 5 < rounds < 100 and len(got) == min(len(want), 166) and {i.split("/")[0] for i in got} == {"src0", "src1", "src2", "src3"}
    assert all(abs(want[i] - v) < 2e-8 for i, v in got.items())
    assert min(got.values()) >= sorted(want.values(), reverse=True)[len(got) - 1] - 2e-8


def odd_docs(spark, path, twice=False):
    texts = ["a b a\nc a\n\n1\nb\nb b\nx", "1\n2 a\n\n\n\na c\nq a q\n\n\n\n7\na", "7\nb b\n8", "", None, "dup x\n" * 12, "one"]
    texts += [f"dup w{i} well_named\n_p a\n\n\n\ndup dup b\n\n\n\n\n9\ndup well_named _p" for i in range(24)]
    rows = [(i, f"src{i % 3}", t) for i, t in enumerate(texts)] + ([(0, "src0", "b a\nwell_named")] if twice else [])
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{path}/documents.parquet")
    return spark.read.parquet(f"{path}/documents.parquet")


@pytest.mark.parametrize("twice", [False, True])
def test_tokens_inside_rows(spark, tmp_path, twice):
    from orrery.sources import corpus

    docs = odd_docs(spark, tmp_path, twice)
    assert corpus.paths_differ(docs) is not twice
    want = sorted(map(tuple, edges.tokens(corpus.lines(docs), lower=True).collect()))
    fast = corpus.tokens(docs)
    assert sorted(map(tuple, fast.collect())) == want
    # counted inside the row: the plan deals nothing out
    assert twice or "Exchange" not in fast._jdf.queryExecution().executedPlan().toString()


def test_tokens_meet_names_before_the_shuffle(spark, tmp_path, monkeypatch):
    from orrery.sources import corpus

    docs = odd_docs(spark, tmp_path)
    rows, names = corpus.tokens(docs), corpus.symbols(docs).select("name")
    kept = edges.known(rows, names)
    assert kept.join(names.distinct(), "name").count() == kept.count() < rows.count()
    monkeypatch.setattr(edges, "MOST_HASHES", 0)
    assert edges.known(rows, names).count() == rows.count()


def test_placed_tokens_and_their_edges(spark, tmp_path):
    from orrery.sources import corpus

    docs = odd_docs(spark, tmp_path)
    placed, symbols = corpus.placed_tokens(docs), corpus.symbols(docs)
    assert sorted(map(tuple, placed.select("path", "line", "name", "mult").collect())) == sorted(map(tuple, corpus.tokens(docs).collect()))
    points = placed.select(F.col("path").alias("src_path"), F.col("line").alias("src_line"), "node_line", "node_kind").distinct()
    want = edges.innermost(points, symbols).select("src_path", "src_line", "node_line", "node_kind")
    assert {tuple(r) for r in points.collect()} == {tuple(r) for r in want.collect()}
    fix = lambda df: sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.collect())
    assert fix(edges.node_edges(corpus.refs_demo(docs, placed=True), symbols)) == fix(edges.node_edges(corpus.refs_demo(docs), symbols)) != []


@pytest.mark.parametrize("cap", [3, 20, None])
@pytest.mark.parametrize("twice", [False, True])
def test_map_without_edges(spark, tmp_path, cap, twice):
    from dataclasses import replace

    from orrery.options import DEFAULTS
    from orrery.sources import corpus

    docs, o = odd_docs(spark, tmp_path, twice), replace(DEFAULTS, max_fanout=cap)
    how = {"budget": 12 * 1000, "rounds": 6, "tolerance": None}
    got = {r["id"]: r["score"] for r in ranking.name_map(docs, o, **how).collect()}
    want = {r["id"]: r["score"] for r in ranking.symbol_map(corpus.symbols(docs), corpus.name_edges(docs, o), **how).collect()}
    assert got == pytest.approx(want, abs=2e-8)


def test_whole_map_has_common_names(spark, tmp_path, monkeypatch):
    from functools import partial

    odd_docs(spark, tmp_path)
    monkeypatch.setattr(ranking, "name_map", partial(ranking.name_map, rounds=3, tolerance=None))
    got = {r["id"]: r["score"] for r in ranking.map_whole(spark, str(tmp_path)).collect()}
    # "dup" has more than 20 definitions: with the cap they got nothing and all scored alike
    assert got["src2/5:1:module"] > 1.5 * got["src2/5:1:block"]


@pytest.mark.parametrize("twice", [False, True])
def test_usage_counts_bodies_in_their_rows(spark, tmp_path, monkeypatch, twice):
    from dataclasses import replace

    from orrery.options import DEFAULTS
    from orrery.plans import code_graph
    from orrery.sources import corpus

    docs = odd_docs(spark, tmp_path, twice)
    for cap in (3, 20, None):
        o = replace(DEFAULTS, max_fanout=cap)
        want = edges.external_usage(corpus.symbols(docs), corpus.name_edges(docs, o))
        assert sorted(map(tuple, corpus.usage(docs, o).collect())) == sorted(map(tuple, want.collect())) != []
    # tokens are only dealt out by name: no filter by name and path, which was given up at a few million definitions
    seen = []
    monkeypatch.setattr(edges, "known", lambda rows, keys, f=edges.known: (seen.append((keys.columns, rows.columns)), f(rows, keys))[1])
    code_graph.external_usage(spark, str(tmp_path)).collect()
    assert twice or seen == [(["name"], ["name"])]


@pytest.mark.parametrize("most", [0, 1])
def test_only_lines_of_shared_paths_are_added_up_by_a_shuffle(spark, tmp_path, monkeypatch, most):
    from orrery.sources import corpus

    docs = odd_docs(spark, tmp_path, True)
    want = sorted(map(tuple, edges.tokens(corpus.lines(docs), lower=True).collect()))
    usage = sorted(map(tuple, edges.external_usage(corpus.symbols(docs), corpus.name_edges(docs)).collect()))
    seen = []

    def spy(rows, *, lower=False, apart=False, f=edges.tokens):
        seen.append((apart, {r["path"] for r in rows.collect()}))
        return f(rows, lower=lower, apart=apart)

    monkeypatch.setattr(edges, "tokens", spy)
    monkeypatch.setattr(corpus, "MOST_PATHS", most)
    assert sorted(map(tuple, corpus.tokens(docs).collect())) == want
    # one repeated path took all lines that way before; beyond the bound it still does
    (inside, apart), (added, shared) = seen
    assert inside and not added and (shared == {"src0/0"} and "src0/0" not in apart if most else not apart and len(shared) > 20)
    assert sorted(map(tuple, corpus.usage(docs).collect())) == usage


@pytest.mark.parametrize("twice", [False, True])
def test_more_names_than_hashes_still_keep_tokens_from_the_shuffle(spark, tmp_path, monkeypatch, twice):
    from orrery.sources import corpus

    docs = odd_docs(spark, tmp_path, twice)
    rows, fix = corpus.tokens(docs), lambda df: sorted(map(tuple, df.collect()))
    names = spark.createDataFrame([("a",), ("b",), ("well_named",), ("w3",), ("w7",), ("not_there",)], "name string")
    want, refs = fix(rows.join(names, "name", "left_semi")), fix(corpus.refs_demo(docs))
    monkeypatch.setattr(edges, "MOST_HASHES", 5)
    kept = edges.known(rows, names)
    # all rows stayed before, where there were more names than hashes
    assert fix(kept.join(names, "name", "left_semi")) == want and len(want) <= kept.count() < rows.count() / 2
    assert fix(corpus.refs_demo(docs)) == refs != []
    # lines of shared paths meet the names before they are added up, too
    plan = kept._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not twice or max(i for i, x in enumerate(plan) if "LeftSemi" in x and "_bits" in x) > min(i for i, x in enumerate(plan) if "Aggregate [" in x)


def test_bloom_words_lose_no_key_and_let_few_others_pass(spark, monkeypatch):
    monkeypatch.setattr(edges, "MOST_HASHES", 4_000)
    name = F.concat(F.lit("n"), F.col("id").cast("string")).alias("name")
    keys, others = spark.range(20_000).select(name), spark.range(20_000, 60_000).select(name)
    assert edges.known(keys, keys).count() == 20_000
    assert edges.known(others, keys).count() < 0.02 * 40_000


def test_references_take_the_texts_apart_once(spark, tmp_path, monkeypatch):
    from orrery.plans import code_graph
    from orrery.sources import corpus

    odd_docs(spark, tmp_path)
    made = []
    monkeypatch.setattr(corpus, "symbols", lambda docs, f=corpus.symbols: (made.append(1), f(docs))[1])
    graphs = (code_graph.orphan_verdict_blocks(spark, str(tmp_path)), ranking.call_up(spark, str(tmp_path)))
    # the plans read stored symbols: no text is split for them again
    assert len(made) == 2 and "regexp_extract(" not in graphs[0]._jdf.queryExecution().optimizedPlan().toString()
