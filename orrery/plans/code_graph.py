"""Scans, tokens, name edges, usage and interval mapping on the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import orphan_verdict, reliability
from ..operators import edges, references, rules, tables
from ..runtime import stored
from ..sources import corpus
from ..sources.corpus import table, with_views
from .catalog import ORACLES, query


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query(with_views("symbols") + " SELECT path, kind, name, line, end_line, scope FROM symbols WHERE path = (SELECT min(path) FROM symbols)")
def scan_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All symbols of the first file."""
    s = corpus.symbols(_docs(spark, sf_dir))
    first = F.broadcast(s.agg(F.min("path").alias("path")))
    return s.join(first, "path", "left_semi").select("path", "kind", "name", "line", "end_line", "scope")


@query(with_views("symbols") + " SELECT path, kind, name, line, end_line FROM symbols WHERE name = (SELECT max(name) FROM (SELECT name FROM symbols GROUP BY name HAVING count(*) BETWEEN 2 AND 5))")
def symbol_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All definitions of one name."""
    s = corpus.symbols(_docs(spark, sf_dir))
    counts = s.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n BETWEEN 2 AND 5")
    return s.join(F.broadcast(counts.agg(F.max("name").alias("name"))), "name").select("path", "kind", "name", "line", "end_line")


@query(
    """WITH now AS (SELECT source || '/' || doc_id AS path, sha256(text) AS h FROM documents),
 before AS (SELECT source || '/' || doc_id AS path, CASE WHEN quality = 1 THEN sha256(text) ELSE sha256(text || 'x') END AS h FROM documents JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY 1) USING (doc_id)
  UNION ALL SELECT 'page/' || page_id, sha256(html) FROM pages)
SELECT coalesce(now.path, before.path) AS path, CASE WHEN now.h IS NULL THEN 'removed' WHEN before.h IS NULL THEN 'new' WHEN before.h <> now.h THEN 'changed' ELSE 'same' END AS status
FROM now FULL JOIN before ON now.path = before.path"""
)
def hash_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against an older state: the labelled ones (altered where of low quality), and the pages, since removed."""
    path = F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path")
    d = _docs(spark, sf_dir)
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    text = F.when(F.col("quality") == 1, F.col("text")).otherwise(F.concat("text", F.lit("x")))
    old = d.join(labels, "doc_id").select(path, F.sha2(text, 256).alias("content_hash"))
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("page/"), F.col("page_id").cast("string")).alias("path"), F.sha2("html", 256).alias("content_hash"))
    return tables.hash_diff(d.select(path, F.sha2("text", 256).alias("content_hash")), old.unionByName(pages))


@query(with_views("tokens") + " SELECT name, sum(mult)::BIGINT AS occurrences, count(*) AS lines FROM tokens GROUP BY name")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences of every identifier, and lines that have it."""
    return corpus.tokens(_docs(spark, sf_dir)).groupBy("name").agg(F.sum("mult").alias("occurrences"), F.count(F.lit(1)).alias("lines"))


@query(with_views("symbols") + " SELECT name, count(*) AS defs FROM symbols GROUP BY name HAVING count(*) > 20")
def fanout_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.fanout_names(corpus.symbols(_docs(spark, sf_dir)))


@query(with_views("name_edges") + " SELECT * FROM name_edges")
def name_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All edges of the name graph."""
    return corpus.name_edges(_docs(spark, sf_dir))


@query(with_views("usage") + " SELECT * FROM usage")
def external_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage of every definition, computed without making the edges."""
    return corpus.usage(_docs(spark, sf_dir))


@query(with_views("usage") + " SELECT path, line, name, usage FROM usage ORDER BY usage DESC, path, line, name LIMIT 40")
def top_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 40 most used definitions: the flagship query."""
    return external_usage(spark, sf_dir).orderBy(F.desc("usage"), "path", "line", "name").limit(40)


@query(
    with_views("usage")
    + """ SELECT s.path, s.line, s.name, s.kind, CASE WHEN c.defs > 20 THEN 'UNKNOWN_FANOUT' ELSE 'UNWIRED_CANDIDATE' END AS verdict, false AS low_confidence_kind
FROM symbols s JOIN (SELECT name, count(*) AS defs FROM symbols GROUP BY name) c USING (name) JOIN usage u USING (path, line, name)
WHERE s.scope = '' AND s.kind = 'module' AND (c.defs > 20 OR u.usage = 0)"""
)
def unwired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-level definitions without outside use."""
    d = _docs(spark, sf_dir)
    return edges.unwired(corpus.symbols(d), corpus.usage(d))


@query(with_views("symbols") + " SELECT path, min(line) AS line, min_by(kind, (line, end_line, kind)) AS kind, min_by(end_line, (line, end_line, kind)) AS end_line, min_by(name, (line, end_line, kind)) AS name FROM symbols GROUP BY path")
def file_rep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.file_rep(corpus.symbols(_docs(spark, sf_dir)))


@query(
    with_views("symbols")
    + """, points AS (SELECT path AS src_path, line AS src_line FROM lines),
 best AS (SELECT p.src_path, p.src_line, max((s.line, s.end_line, s.kind, s.name)) AS b FROM points p JOIN symbols s ON s.path = p.src_path AND p.src_line BETWEEN s.line AND s.end_line GROUP BY 1, 2),
 rep AS (SELECT path, min((line, end_line, kind, name)) AS r FROM symbols GROUP BY path)
SELECT p.src_path, p.src_line, coalesce(b, r)[1] AS node_line, coalesce(b, r)[2] AS node_end, coalesce(b, r)[3] AS node_kind, coalesce(b, r)[4] AS node_name
FROM points p LEFT JOIN best USING (src_path, src_line) LEFT JOIN rep ON rep.path = p.src_path"""
)
def innermost_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The innermost symbol around every line."""
    d = _docs(spark, sf_dir)
    points = corpus.lines(d).select(F.col("path").alias("src_path"), F.col("line").alias("src_line"))
    return edges.innermost(points, corpus.symbols(d))


@query(
    with_views("refs_demo")
    + """, e AS (SELECT src_path, src_line, def_path, def_line, confidence, sum(greatest(multiplicity, 1)) AS mult FROM refs_demo GROUP BY 1, 2, 3, 4, 5),
 tgt AS (SELECT path, line, max((end_line, kind, name)) AS t FROM symbols GROUP BY 1, 2),
 files AS (SELECT name, count(DISTINCT path) AS files FROM symbols GROUP BY name),
 hit AS (SELECT e.*, t[2] AS dst_kind, t[3] AS name, f.files FROM e JOIN tgt ON tgt.path = e.def_path AND tgt.line = e.def_line JOIN files f ON f.name = t[3]),
 best AS (SELECT p.src_path, p.src_line, max((s.line, s.end_line, s.kind)) AS b FROM (SELECT DISTINCT src_path, src_line FROM hit) p JOIN symbols s ON s.path = p.src_path AND p.src_line BETWEEN s.line AND s.end_line GROUP BY 1, 2),
 rep AS (SELECT path, min((line, end_line, kind)) AS r FROM symbols GROUP BY path),
 placed AS (SELECT hit.*, coalesce(b, r)[1] AS node_line, coalesce(b, r)[3] AS node_kind FROM hit LEFT JOIN best USING (src_path, src_line) LEFT JOIN rep ON rep.path = hit.src_path)
SELECT CASE WHEN node_line IS NOT NULL THEN src_path END AS src_path, node_line AS src_node_line, node_kind AS src_kind, def_path AS dst_path, def_line AS dst_line, dst_kind,
 round(sum((CASE WHEN confidence = 'high' THEN 1.0::DOUBLE ELSE 0.25::DOUBLE END) * mult
  * (CASE WHEN name LIKE '\\_%' ESCAPE '\\' THEN 0.1::DOUBLE WHEN length(name) >= 8 AND (name LIKE '%\\_%' ESCAPE '\\' OR (lower(name) <> name AND upper(name) <> name)) THEN 10.0::DOUBLE ELSE 1.0::DOUBLE END)
  * (CASE WHEN files > 5 THEN 0.1::DOUBLE ELSE 1.0::DOUBLE END)), 6) AS weight
FROM placed WHERE NOT coalesce(src_path = def_path AND node_line = def_line AND node_kind = dst_kind, false) GROUP BY 1, 2, 3, 4, 5, 6""".replace("\\\\", "\\")
)
def edge_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted edges between symbols."""
    d = _docs(spark, sf_dir)
    return edges.node_edges(corpus.refs_demo(d, placed=corpus.paths_differ(d)), corpus.symbols(d)).withColumn("weight", F.round("weight", 6))


@query(
    with_views("usage", "refs_demo")
    + """, r AS (SELECT def_path AS path, def_line AS line, count(*) FILTER (confidence = 'high') AS high, count(*) FILTER (confidence = 'low') AS low FROM refs_demo GROUP BY 1, 2)
SELECT s.path, s.line, s.name, s.kind, coalesce(high, 0) AS high, coalesce(low, 0) AS low,
 CASE WHEN s.path LIKE 'src5/%' THEN 'PUBLIC_API' WHEN s.path LIKE 'src9/%' THEN 'UNKNOWN_NO_RESOLVER' WHEN coalesce(high, 0) > 0 THEN 'KEEP' ELSE 'LIKELY_UNUSED' END AS verdict
FROM symbols s LEFT JOIN r USING (path, line) WHERE s.kind = 'block'"""
)
def orphan_verdict_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict chain over blocks: one source is an entry point, one has no resolver."""
    d = _docs(spark, sf_dir)
    symbols = stored(corpus.symbols(d), "symbols")
    sums = corpus.refs_demo(d, narrow=symbols).groupBy(F.col("def_path").alias("path"), F.col("def_line").alias("line")).agg(F.count_if(F.col("confidence") == "high").alias("high"), F.count_if(F.col("confidence") == "low").alias("low"))
    rows = symbols.filter("kind = 'block'").join(sums, ["path", "line"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("high", "low")})
    engine = F.when(F.col("path").startswith("src9/"), "none").otherwise("relational")
    verdict = orphan_verdict(F.col("path").startswith("src5/"), engine, F.lit(False), F.lit(True), F.col("high"), F.lit(-1))
    return rows.select("path", "line", "name", "kind", "high", "low", verdict.alias("verdict"))


@query(f"SELECT verdict, count(*) AS n FROM ({ORACLES['orphan_verdict_blocks']}) GROUP BY 1")
def verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many blocks have each verdict."""
    return rules.verdict_histogram(orphan_verdict_blocks(spark, sf_dir))


_WORD = "the"


@query(
    with_views("lines")
    + rf""", p AS (SELECT path, line, regexp_split_to_array(txt, '\b{_WORD}\b') AS pieces FROM lines),
 q AS (SELECT path, line, pieces, unnest(range(1, len(pieces))) AS i FROM p WHERE len(pieces) > 1)
SELECT path, line, (list_sum(list_transform(pieces[1:i], lambda x: length(x))) + (i - 1) * {len(_WORD)})::INT AS col FROM q"""
)
def word_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every occurrence of one word, with its column."""
    return references.word_occurrences(corpus.lines(_docs(spark, sf_dir)), _WORD)


@query(with_views("tokens") + f", f AS (SELECT DISTINCT path FROM tokens WHERE name = '{_WORD}') SELECT path, (SELECT count(*) FROM f) > 400 AS truncated FROM f ORDER BY path LIMIT 400")
def candidate_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 400 files that have the word, and whether there are more: the prefilter of an interactive call."""
    return references.candidate_files(corpus.tokens(_docs(spark, sf_dir)), _WORD)


@query(with_views("refs_demo") + " SELECT symbol_name, count(DISTINCT (def_path, def_line)) AS definitions, count(*) FILTER (confidence = 'high') AS high, count(*) FILTER (confidence = 'low') AS low, count(DISTINCT src_path) AS files FROM refs_demo GROUP BY 1")
def reference_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions, references and files of every name."""
    return references.reference_summary(corpus.refs_demo(_docs(spark, sf_dir)))


@query(
    with_views("refs_demo")
    + """, r AS (SELECT symbol_name AS name, count(*) FILTER (confidence = 'high') AS high, count(*) FILTER (confidence = 'low') AS low, count(*) FILTER (def_path LIKE 'src7/%') AS foreign_defs FROM refs_demo GROUP BY 1)
SELECT name, high, low, CASE WHEN foreign_defs > 0 THEN 'low' WHEN high = 0 AND low = 0 THEN 'medium' WHEN low > 3 * high AND low > 5 THEN 'medium' ELSE 'high' END AS level FROM r""",
    name="reliability",
)
def reliability_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the references of each name can be relied on."""
    refs = corpus.refs_demo(_docs(spark, sf_dir))
    sums = refs.groupBy(F.col("symbol_name").alias("name")).agg(F.count_if(F.col("confidence") == "high").alias("high"), F.count_if(F.col("confidence") == "low").alias("low"), F.count_if(F.col("def_path").startswith("src7/")).alias("foreign"))
    level = reliability(F.when(F.col("foreign") > 0, "name-match").otherwise("relational"), F.lit(True), F.col("high"), F.col("low"))
    return sums.select("name", "high", "low", level.alias("level"))


@query(
    """WITH n AS (SELECT count(*) AS n FROM documents), ranked AS (SELECT source || '/' || doc_id AS path, row_number() OVER (ORDER BY source || '/' || doc_id) - 1 AS position FROM documents)
SELECT path, 'stratified' AS label FROM ranked, n WHERE position IN (SELECT least(n - 1, floor((i + 0.5) * n / 12)::BIGINT) FROM range(12) t(i))"""
)
def sample_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve files at the midpoints of equal parts of all paths: a sampling operator."""
    return edges.sample_paths(_docs(spark, sf_dir).select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path")), 12)


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS rows FROM {t}" for t in corpus.TABLES))
def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.stats({t: table(spark, sf_dir, t) for t in corpus.TABLES})
