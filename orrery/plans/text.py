"""Comments, markers, coverage, rules and roll-ups on documents and pages."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import health as health_score
from ..operators import comments, rules
from ..options import DEFAULTS
from ..sources import corpus
from ..sources.corpus import table, with_views
from .catalog import query


@query(
    """WITH c AS (SELECT page_id, html, regexp_extract_all(html, '(?s)<!--(.*?)-->', 1) AS c, string_split_regex(html, '(?s)<!--.*?-->') AS p FROM pages),
 x AS (SELECT page_id, unnest(range(1, len(c) + 1)) AS ordinal, unnest(c) AS text, p, c FROM c)
SELECT page_id, ordinal::INT AS ordinal, (1 + length(b) - length(replace(b, chr(10), '')))::INT AS line, trim(text) AS text
FROM (SELECT *, array_to_string(p[1:ordinal], '') || array_to_string(c[1:ordinal - 1], '') AS b FROM x)"""
)
def html_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comments.html_comments(table(spark, sf_dir, "pages"))


_MARKERS = ("the", "de", "und")


@query(
    with_views("lines")
    + """, m AS (SELECT path, line, regexp_extract(txt, '(?:^|[^\\p{L}\\p{N}_])(the|de|und)(?:[^\\p{L}\\p{N}_]|$)', 1) AS tag, trim(txt) AS text FROM lines)
SELECT path, line, tag, text FROM m WHERE tag <> ''"""
)
def marker_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a marker; three frequent words stand for markers."""
    docs = table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.lit(1).alias("line"), "text")
    return comments.tag_lines(docs, replace(DEFAULTS, markers=_MARKERS))


@query(
    with_views("lines")
    + """, m AS (SELECT regexp_extract(txt, '(?:^|[^\\p{L}\\p{N}_])(the|de|und)(?:[^\\p{L}\\p{N}_]|$)', 1) AS tag FROM lines)
SELECT tag, count(*) AS n FROM m WHERE tag <> '' GROUP BY tag"""
)
def marker_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marker_lines(spark, sf_dir).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("documented", F.lit(True))
    return table(spark, sf_dir, "documents").join(labels, "doc_id", "left").withColumn("documented", F.coalesce("documented", F.lit(False)))


@query(
    """WITH r AS (SELECT lang, doc_id IN (SELECT doc_id FROM labels) AS ok FROM documents)
SELECT lang, count(*) FILTER (ok) AS documented, count(*) AS total, round(count(*) FILTER (ok) * 100.0::DOUBLE / count(*), 1) AS pct FROM r GROUP BY ROLLUP (lang)"""
)
def doc_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of documents with a label, by language and for all."""
    return comments.coverage(_labelled(spark, sf_dir).select("lang", "documented"), "lang")


@query("SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY doc_id LIMIT 30")
def undocumented_top30(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(labels, "doc_id", "left_anti").orderBy("doc_id").limit(30)


@query("SELECT page_id, round(list_sum(list_transform(regexp_extract_all(html, '(?s)<!--.*?-->'), lambda x: length(x)))::DOUBLE / length(html), 3) AS density FROM pages")
def density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each page that is comments; computed inside the row."""
    found = F.regexp_extract_all("html", F.lit(r"(?s)(<!--.*?-->)"), F.lit(1))
    chars = F.aggregate(found, F.lit(0), lambda acc, x: acc + F.length(x))
    return table(spark, sf_dir, "pages").select("page_id", F.round(chars.cast("double") / F.length("html"), 3).alias("density"))


@query(
    """WITH d AS (SELECT doc_id, n_chars / 40.0::DOUBLE AS nodes, count(*) OVER (PARTITION BY sha256(text)) AS copies FROM documents),
 q AS (SELECT doc_id, max(quality) * 20 AS cog FROM labels GROUP BY 1),
 x AS (SELECT d.doc_id, copies, cog, least(1, greatest(0, (nodes - 80) / 120.0::DOUBLE)) AS tb, least(1, greatest(0, (cog - 8) / 17.0::DOUBLE)) AS tc FROM d LEFT JOIN q USING (doc_id))
SELECT doc_id, round(1 - (tb * tb * (3 - 2 * tb) * 0.25::DOUBLE + CASE WHEN copies > 1 THEN 0.3::DOUBLE ELSE 0::DOUBLE END + CASE WHEN cog IS NULL THEN 0::DOUBLE ELSE tc * tc * (3 - 2 * tc) * 0.3::DOUBLE END)
 / (0.55::DOUBLE + CASE WHEN cog IS NULL THEN 0::DOUBLE ELSE 0.3::DOUBLE END), 4) AS health FROM x"""
)
def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Health of documents: size stands for nodes, copies for shapes, the label for complexity."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.sha2("text", 256).alias("h"))
    copies = d.groupBy("h").agg(F.count(F.lit(1)).alias("copies"))
    q = table(spark, sf_dir, "labels").groupBy("doc_id").agg((F.max("quality") * 20).alias("cog"))
    rows = d.join(copies, "h").join(q, "doc_id", "left")
    return rows.select("doc_id", health_score(F.col("n_chars") / 40.0, F.col("copies"), F.col("cog")).alias("health"))


_URL_RULES = ((r"[?&]page=", "paged"), (r"\.html$", "static"), (r"#", "fragment"), (r"^https?://m\.", "mobile"), (r"/(fr|de|es)/", "translated"))


@query("SELECT page_id, CASE " + " ".join(f"WHEN regexp_matches(url, '{p}') THEN '{r}'" for p, r in _URL_RULES) + " END AS reason FROM pages")
def entry_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of ordered rules that a page's address meets."""
    return table(spark, sf_dir, "pages").select("page_id", rules.entry_reason("url", rules=_URL_RULES).alias("reason"))


_SITE_IMPORTS = ((r"<!-- ad [0-9]*[05] -->", "fives"), (r"lang=.en.", "english"))
_SITE_RULES = ((r"track\([0-9]*0\)", "tracker", "direct", "fives"), (r"href=./(qu[a-z]*)", "$1", "cli", None), (r"href=./und", "und", "local", "english"), (r"href=./de[rm]?\b", "de", "direct", None), (r"<nav", "nav", "cli", "english"))


@query(
    """WITH f AS (SELECT page_id::VARCHAR AS path, html, regexp_matches(html, '<!-- ad [0-9]*[05] -->') AS fives, regexp_matches(html, 'lang=.en.') AS english FROM pages),
 l AS (SELECT path, fives, english, unnest(range(1, len(p) + 1))::INT AS line, trim(unnest(p)) AS txt FROM (SELECT *, string_split(html, chr(10)) AS p FROM f)),
 r AS (SELECT path, line, CASE WHEN regexp_matches(txt, 'track\\([0-9]*0\\)') AND fives THEN ['tracker', 'direct'] WHEN regexp_extract(txt, 'href=./(qu[a-z]*)', 1) <> '' THEN [regexp_extract(txt, 'href=./(qu[a-z]*)', 1), 'cli']
   WHEN regexp_matches(txt, 'href=./und') AND english THEN ['und', 'local'] WHEN regexp_matches(txt, 'href=./de[rm]?\\b') THEN ['de', 'direct'] WHEN regexp_matches(txt, '<nav') AND english THEN ['nav', 'cli'] END AS hit FROM l WHERE txt <> '')
SELECT path, line, hit[1] AS provider, hit[2] AS channel FROM r WHERE hit IS NOT NULL"""
)
def provider_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ordered rule table with context guards on every line of every page."""
    files = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), F.col("html").alias("text"))
    return rules.provider_sites(files, _SITE_RULES, _SITE_IMPORTS).select("path", "line", "provider", "channel")


@query(
    """WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2), t AS (SELECT source, sum(n) AS total, max(n) AS most, min_by(lang, (-n, lang)) AS top FROM c GROUP BY 1)
SELECT source, CASE WHEN most / total >= 0.6 THEN top END AS dominant, round(most / total, 4) AS ratio FROM t"""
)
def dominant_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.dominant(table(spark, sf_dir, "documents"), ["source"], "lang")


@query(with_views("symbols") + " SELECT kind, (scope = '') AS top_level, count(*) AS n, count(DISTINCT name) AS names, sum(end_line - line + 1)::BIGINT AS lines FROM symbols GROUP BY 1, 2")
def symbol_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, names and lines by kind."""
    s = corpus.symbols(table(spark, sf_dir, "documents"))
    return s.groupBy("kind", (F.col("scope") == "").alias("top_level")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("name").alias("names"), F.sum(F.col("end_line") - F.col("line") + 1).alias("lines"))
