"""Comments, markers, documentation coverage and density."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import percent
from ..options import DEFAULTS, Options


def marker_pattern(markers: tuple[str, ...]) -> str:
    # word borders as letters, digits and underscores of any script make them
    return r"(?<![\p{L}\p{N}_])(" + "|".join(markers) + r")(?![\p{L}\p{N}_])"


def first_tag(text: Column | str, o: Options = DEFAULTS) -> Column:
    """The first marker in the text; null without one."""
    t = F.col(text) if isinstance(text, str) else text
    tag = F.regexp_extract(t, marker_pattern(o.markers), 1)
    return F.when(tag != "", tag)


def tag_lines(comments: DataFrame, o: Options = DEFAULTS, tag: str | None = None) -> DataFrame:
    """Every marked line of every comment: (``path``, ``line``, ``tag``, ``text``); the line is the marker's own, not the comment's."""
    rows = comments.select("path", F.col("line").alias("base"), F.posexplode(F.split("text", "\n", -1)).alias("offset", "part"))
    out = rows.select("path", (F.col("base") + F.col("offset")).alias("line"), first_tag("part", o).alias("tag"), F.trim("part").alias("text")).filter("tag IS NOT NULL")
    return out.filter(F.col("tag") == tag.upper()) if tag else out


def tag_counts(comments: DataFrame, o: Options = DEFAULTS) -> DataFrame:
    return tag_lines(comments, o).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def select_comments(comments: DataFrame, *, path: str | None = None, is_doc: bool | None = None, tag: str | None = None, scope: str | None = None) -> DataFrame:
    """Stored comments by optional tests; ``tag`` compares the first stored tag."""
    for name, value in (("path", path), ("is_doc", is_doc), ("tag", tag.upper() if tag else None), ("scope", scope)):
        if value is not None:
            comments = comments.filter(F.col(name) == value)
    return comments.orderBy("path", "line")


def documented(symbols: DataFrame, comments: DataFrame, o: Options = DEFAULTS, *, skip_private: bool = True) -> DataFrame:
    """Symbols that count for coverage, with ``documented``."""
    wanted = symbols.filter(F.col("kind").isin(*o.coverage_kinds))
    if skip_private:
        wanted = wanted.filter(~F.col("name").startswith("_"))
    owners = comments.filter("is_doc AND owner_line IS NOT NULL").select("path", F.col("owner_line").alias("line")).distinct().withColumn("documented", F.lit(True))
    return wanted.join(owners, ["path", "line"], "left").withColumn("documented", F.coalesce("documented", F.lit(False)))


def coverage(rows: DataFrame, by: str = "kind") -> DataFrame:
    """Documented, total and per cent by a column, with a row of null for all: one rollup."""
    done = F.count_if(F.col("documented"))
    total = F.count(F.lit(1))
    return rows.rollup(by).agg(done.alias("documented"), total.alias("total"), percent(done, total).alias("pct"))


def undocumented(rows: DataFrame, most: int = 30) -> DataFrame:
    return rows.filter(~F.col("documented")).orderBy("path", "line").limit(most)


def density(comments: DataFrame, symbols: DataFrame) -> DataFrame:
    """Comment lines over lines of top-level symbols, the latter 1 at least."""
    span = F.coalesce(F.sum(F.col("end_line") - F.col("line") + 1), F.lit(0))
    a = comments.agg(span.alias("comment_lines"))
    b = symbols.filter("scope = ''").agg(span.alias("code_lines"))
    return a.crossJoin(F.broadcast(b)).withColumn("density", F.round(F.col("comment_lines") / F.greatest(F.col("code_lines"), F.lit(1)), 3))


def html_comments(pages: DataFrame) -> DataFrame:
    """(``page_id``, ``ordinal``, ``line``, ``text``) of ``<!-- -->`` in ``html``; the line is the one the comment starts on."""
    bodies = F.regexp_extract_all("html", F.lit(r"(?s)<!--(.*?)-->"), F.lit(1))
    before = F.split("html", r"(?s)<!--.*?-->", -1)
    rows = pages.withColumn("before", before).select("page_id", "html", "before", F.posexplode(bodies).alias("at", "raw"))
    newlines = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    ahead = F.concat(F.array_join(F.slice("before", F.lit(1), F.col("at") + 1), ""), F.array_join(F.slice(F.regexp_extract_all("html", F.lit(r"(?s)<!--(.*?)-->"), F.lit(0)), F.lit(1), F.col("at")), ""))
    return rows.select("page_id", (F.col("at") + 1).alias("ordinal"), (newlines(ahead) + 1).cast("int").alias("line"), F.trim("raw").alias("text"))
