"""Exact, renamed, near and pattern duplicates of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clones, winnow
from ..sources.corpus import table
from .catalog import query


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query("SELECT sha256(text) AS hash, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).select(F.sha2("text", 256).alias("hash"), "doc_id")
    return d.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).filter("n > 1")


@query(
    """WITH s AS (SELECT doc_id, sha256(text) AS raw, md5(regexp_replace(regexp_replace(lower(text), '[0-9]+', '0', 'g'), '[a-z]+', 'w', 'g')) AS shape FROM documents)
SELECT shape, count(DISTINCT raw) AS variants, count(*) AS n, min(doc_id) AS first_id FROM s GROUP BY shape HAVING count(DISTINCT raw) > 1"""
)
def renamed_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of one shape (words and numbers masked) and several texts."""
    shape = F.md5(F.regexp_replace(F.regexp_replace(F.lower("text"), "[0-9]+", "0"), "[a-z]+", "w"))
    raw = _docs(spark, sf_dir).select(shape.alias("shape"), F.sha2("text", 256).alias("raw"), "doc_id")
    # one row a raw text first: a plain count of rows then counts distinct texts
    once = raw.groupBy("shape", "raw").agg(F.count(F.lit(1)).alias("m"), F.min("doc_id").alias("first"))
    return once.groupBy("shape").agg(F.count(F.lit(1)).alias("variants"), F.sum("m").alias("n"), F.min("first").alias("first_id")).filter("variants > 1")


_INDEX = """toks AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS t FROM documents),
 grams AS (SELECT doc_id, list_transform(range(1, greatest(1, len(t) - 4) + 1), lambda i: ('0x' || substr(md5(array_to_string(t[i:i + 4], ' ')), 1, 8))::BIGINT) AS g FROM toks WHERE len(t) > 0),
 idx AS (SELECT doc_id, unnest(list_distinct(list_transform(range(1, greatest(1, len(g) - 3) + 1), lambda i: list_min(g[i:i + 3])))) AS fp_value FROM grams)"""


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.text_index(_docs(spark, sf_dir), "doc_id")


@query(f"WITH {_INDEX} SELECT doc_id, fp_value FROM idx")
def winnow_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winnowed five-gram hashes of every document."""
    return index(spark, sf_dir)


@query(f"WITH {_INDEX} SELECT fp_value, count(*) AS df FROM idx GROUP BY 1 HAVING count(*) > 50")
def flood_fps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clones.flood(index(spark, sf_dir))


_PAIRS = """kept AS (SELECT * FROM idx WHERE fp_value NOT IN (SELECT fp_value FROM idx GROUP BY 1 HAVING count(*) > 50)),
 sizes AS (SELECT doc_id, count(*) AS n FROM kept GROUP BY 1),
 h AS (SELECT doc_id, sha256(text) AS h FROM documents)"""


@query(
    f"""WITH {_INDEX}, {_PAIRS}, p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM kept a JOIN kept b USING (fp_value) WHERE a.doc_id < b.doc_id GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT a, b, shared, round(shared / (x.n + y.n - shared), 3) AS similarity FROM p JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b JOIN h hx ON hx.doc_id = a JOIN h hy ON hy.doc_id = b
WHERE shared / (x.n + y.n - shared) >= 0.8 AND hx.h <> hy.h"""
)
def near_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different texts with similar winnowed sets, by an exact self-join."""
    units = _docs(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("h"))
    return clones.near_pairs(index(spark, sf_dir), units, "doc_id", "h")


@query(
    f"""WITH {_INDEX}, {_PAIRS}, scope AS (SELECT doc_id FROM documents WHERE source = 'src1'),
 vals AS (SELECT DISTINCT fp_value FROM kept JOIN scope USING (doc_id)), cand AS (SELECT * FROM kept WHERE fp_value IN (SELECT fp_value FROM vals)),
 csizes AS (SELECT doc_id, count(*) AS n FROM cand GROUP BY 1),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM cand a JOIN cand b USING (fp_value) WHERE a.doc_id < b.doc_id AND (a.doc_id IN (SELECT doc_id FROM scope) OR b.doc_id IN (SELECT doc_id FROM scope)) GROUP BY 1, 2 HAVING count(*) >= 3),
 v AS (SELECT 'whole' AS variant, doc_id, n FROM sizes UNION ALL SELECT 'compat', doc_id, n FROM csizes)
SELECT x.variant, a, b, shared, round(shared / (x.n + y.n - shared), 3) AS similarity FROM p JOIN v x ON x.doc_id = a JOIN v y ON y.doc_id = b AND x.variant = y.variant JOIN h hx ON hx.doc_id = a JOIN h hy ON hy.doc_id = b
WHERE shared / (x.n + y.n - shared) >= 0.8 AND hx.h <> hy.h"""
)
def near_dup_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with a member in one source: with whole sets, and with sets cut to the source's values."""
    d = _docs(spark, sf_dir)
    units = d.select("doc_id", F.sha2("text", 256).alias("h"))
    scope = d.filter("source = 'src1'").select("doc_id")
    # both variants read the index: hashed and dealt out once
    idx = clones.dealt(index(spark, sf_dir), "doc_id")
    both = [clones.near_pairs(idx, units, "doc_id", "h", scope=scope, compat=c).withColumn("variant", F.lit("compat" if c else "whole")) for c in (False, True)]
    return both[0].unionByName(both[1])


@query(
    """WITH c AS (SELECT doc_id, sha256(text) AS raw, list_sort(regexp_extract_all(text, '[A-Z][a-z]+')) AS w FROM documents)
SELECT md5(array_to_string(w, chr(2))) AS call_hash, count(*) AS n, count(DISTINCT raw) AS variants, min(doc_id) AS first_id FROM c WHERE len(w) > 0 GROUP BY 1 HAVING count(*) >= 2 AND count(DISTINCT raw) >= 2"""
)
def call_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of different texts with one multiset of capitalised words."""
    words = F.array_sort(F.regexp_extract_all("text", F.lit("([A-Z][a-z]+)"), F.lit(1)))
    rows = _docs(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("raw"), words.alias("w")).filter(F.size("w") > 0)
    once = rows.groupBy(F.md5(F.array_join("w", "\x02")).alias("call_hash"), "raw").agg(F.count(F.lit(1)).alias("m"), F.min("doc_id").alias("first"))
    return once.groupBy("call_hash").agg(F.sum("m").alias("n"), F.count(F.lit(1)).alias("variants"), F.min("first").alias("first_id")).filter("n >= 2 AND variants >= 2")


@query("WITH h AS (SELECT doc_id, sha256(text) AS h FROM documents), f AS (SELECT h, min(doc_id) AS first FROM h GROUP BY h) SELECT first, doc_id AS other FROM h JOIN f USING (h) WHERE doc_id <> first")
def clone_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A star from the first document of each text to its copies."""
    return clones.clone_pairs(_docs(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("h")), "doc_id", "h")
