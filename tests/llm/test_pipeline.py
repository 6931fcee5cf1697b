"""The pipeline against the same stages worked by hand."""

import hashlib
import random

import corpus_pipeline
from orrery.llm import quality
from orrery.llm.queries import ORACLE_SQL, QUERIES
from test_operators import ODD, SCHEMA, bare, components_by_hand, words


def test_stages_are_the_agreed_ones():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "decontaminate", "encode"]
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11)) and set(ORACLE_SQL) <= set(QUERIES)


def test_pipeline(spark, tmp_path):
    import public_tokenizers
    import tiktoken

    from orrery.llm.bpe import read_ranks

    rnd = random.Random(12)
    items = [(i, words(rnd, 25)) for i in range(4)]
    rows = [(i, words(rnd, rnd.randrange(20, 120)).capitalize() + ".") for i in range(120)]
    rows += [(120 + i, " ".join(w.upper() + "!!" for w in words(rnd, rnd.randrange(20, 60)).split())) for i in range(60)]
    rows += [(180, rows[3][1] + " \n"), (181, rows[3][1]), (182, rows[4][1] + " more"), (183, words(rnd, 30) + " " + items[2][1] + " " + words(rnd, 30)), (184, ""), (185, None)]
    spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 120), 0) for i in range(180)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    docs, labels = (spark.read.parquet(f"{tmp_path}/{n}.parquet") for n in ("documents", "labels"))
    good = {r["doc_id"] for r in quality.classify(docs, labels).collect() if r["predicted"]}
    assert good >= set(range(120)) and not good & set(range(120, 180))
    left = [(i, t) for i, t in rows if i in good]
    best = {}
    for i, t in left:
        best[bare(t)] = min(best.get(bare(t), (1, 0)), (-len(t or ""), i))
    left = [(i, t) for i, t in left if best[bare(t)][1] == i]
    component, _ = components_by_hand(left)
    left = [(i, t) for i, t in left if component[i] == i]
    left = [(i, t) for i, t in left if not any(x in (t or "") for _, x in items)]
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})
    want = {i: (library.encode_ordinary(t or ""), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in left}
    got = {r["doc_id"]: (r["ids"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want and 183 not in got and len({180, 181, 3} & set(got)) == 1


def test_pipeline_of_odd_and_empty_tables(spark, tmp_path):
    for name, rows in (("odd", ODD), ("empty", [])):
        path = f"{tmp_path}/{name}"
        docs = spark.createDataFrame(rows, SCHEMA)
        docs.write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
        now = spark.read.parquet(f"{path}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, path)
            assert now.columns == docs.columns and [f.dataType for f in now.schema] == [f.dataType for f in docs.schema]
        got = sorted(r["decoded_sha256"] for r in corpus_pipeline.run(spark, path).collect())
        # one row of each text but for white space; nothing is near to anything else
        texts = {bare(t): t or "" for _, t, *_ in rows}
        assert got == sorted(hashlib.sha256(t.encode()).hexdigest() for t in texts.values())


def test_stages_keep_clashing_columns(spark, tmp_path):
    from pyspark.sql import functions as F

    rnd = random.Random(2)
    docs = spark.createDataFrame([(i, words(rnd, 30), "en", "a", 1) for i in range(8)], SCHEMA)
    for c in ("row", "id", "node", "stats", "score", "row_number", "text_bytes", "comp", "name", "level", "kk", "item_id"):
        docs = docs.withColumn(c, F.lit("clash"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, words(rnd, 20))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        now = stage(spark, now, str(tmp_path))
    assert sorted(map(tuple, now.collect()), key=lambda r: r[0]) == sorted(map(tuple, docs.collect()), key=lambda r: r[0])
