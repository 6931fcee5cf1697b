"""Rule classification: entry points, orphans, health, provider call sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.rule_tables import BASE_URL, COMPATIBLE_HOSTS, ENTRY_BARE, ENTRY_PATHS, ENTRY_VERBS, IMPORT_MARKERS, LOCAL_HOSTS, SEVERITY, SITE_RULES
from ..options import DEFAULTS, Options


def entry_reason(path: Column | str, extra: tuple[str, ...] = (), rules=ENTRY_PATHS) -> Column:
    """The first entry point rule that the repository-relative path meets; null if none."""
    p = S.posix(path)
    tests = [(p.rlike(pattern), reason) for pattern, reason in rules] + [(p.contains(x), f"configured: {x}") for x in extra]
    return S.first_rule(tests)


def decorated_entry(decorators: Column | str) -> Column:
    """Whether one of an array of decorators (with @) calls its function by reflection."""
    verbs = r"^\s*@\w+(?:\.\w+)*\.(" + "|".join(ENTRY_VERBS) + r")\b"
    head = lambda d: F.trim(F.substring_index(d, "(", 1))
    return F.exists(S.col(decorators), lambda d: d.rlike(verbs) | head(d).isin(*ENTRY_BARE))


def orphans(symbols: DataFrame, refs: DataFrame, *, engine: Column, scripts: set[str] = frozenset(), named: DataFrame | None = None, o: Options = DEFAULTS) -> DataFrame:
    """Top-level referenceable symbols with the verdict of their references (``reexport`` marks re-exports among high ones).

    With ``named`` (``name``, ``named``: lines that have the name) the low references are those lines but for the definition's own
    and those of high references by that name (``aliased`` marks the others).
    """
    top = symbols.filter((F.col("scope") == "") & F.col("kind").isin(*o.referenceable))
    reexport = F.col("reexport") if "reexport" in refs.columns else F.lit(False)
    sums = refs.groupBy(F.col("def_path").alias("path"), F.col("def_line").alias("line")).agg(
        F.count_if(F.col("confidence") == "high").alias("high"), F.count_if((F.col("confidence") == "high") & reexport).alias("reexports"), F.count_if(F.col("confidence") == "low").alias("low"),
        F.count_if((F.col("confidence") == "high") & ~(F.col("aliased") if "aliased" in refs.columns else F.lit(False))).alias("plain"),
    )
    rows = top.join(sums, ["path", "line"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("high", "reexports", "low", "plain")})
    if named is not None:
        rows = rows.join(named, "name", "left").withColumn("low", F.greatest(F.coalesce("named", F.lit(0)) - 1 - F.col("plain"), F.lit(0)))
    entry = entry_reason("path").isNotNull()
    if "decorators" in symbols.columns:
        entry = entry | F.coalesce(decorated_entry("decorators"), F.lit(False))
    if "exported" in symbols.columns:
        entry = entry | F.coalesce("exported", F.lit(False))
    if scripts:
        entry = entry | F.col("name").isin(*sorted(scripts))
    verdict = S.orphan_verdict(entry, engine, F.lit(False), F.lit(True), F.col("high"), F.col("reexports"))
    return rows.select("path", "line", "name", "kind", "high", "low", verdict.alias("verdict"))


#: Extensions that references can be resolved for here.
RESOLVERS = {".py": "relational", ".pyi": "relational"}


def resolver(path: Column | str) -> Column:
    """The engine that resolves a file's references; ``none`` where there is none."""
    lookup = F.create_map(*(F.lit(x) for kv in RESOLVERS.items() for x in kv))
    return F.coalesce(lookup[S.extension(path)], F.lit("none"))


def verdict_histogram(rows: DataFrame, by: list[str] = ()) -> DataFrame:
    """``verdict`` and ``n``: one row each, by group if asked."""
    return rows.groupBy(*by, "verdict").agg(F.count(F.lit(1)).alias("n"))


def unused_imports(imports: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """(``path``, ``line``, ``name``, ``verdict``): no linter is at hand, so the verdict is UNKNOWN_NO_LINTER.

    With ``tokens`` (the opt-in) imports whose alias occurs once only in their file, where it is imported, are UNUSED_BY_NAME: a
    statement about names, not about meaning. Re-exports are not told apart.
    """
    name = F.substring_index(F.coalesce("alias", "name", "module"), ".", 1)
    rows = imports.select("path", "line", name.alias("name"))
    if tokens is None:
        return rows.withColumn("verdict", F.lit("UNKNOWN_NO_LINTER"))
    uses = tokens.groupBy("path", "name").agg(F.sum("mult").alias("uses"))
    joined = rows.join(uses, ["path", "name"], "left")
    return joined.select("path", "line", "name", F.when(F.coalesce("uses", F.lit(0)) <= 1, "UNUSED_BY_NAME").otherwise("KEEP").alias("verdict"))


def advisory(histogram: dict[str, int]) -> list[str]:
    """What the counts of verdicts can't see, one sentence each."""
    said = []
    if n := histogram.get("UNKNOWN_NO_RESOLVER", 0):
        said.append(f"{n} symbols are in languages without a resolver here; nothing is known of their use.")
    if n := histogram.get("UNKNOWN_UNRESOLVED", 0):
        said.append(f"{n} symbols could not be resolved.")
    if n := histogram.get("LIKELY_UNUSED", 0):
        said.append(f"{n} symbols have no reference; calls by reflection, by configuration or from outside are not seen.")
    if n := histogram.get("REEXPORT_ONLY", 0):
        said.append(f"{n} symbols are only exported again.")
    return said


def health_coverage(report: DataFrame) -> DataFrame:
    """One row: symbols, those with a health, their share, and the dead ones."""
    counts = report.agg(F.count(F.lit(1)).alias("total"), F.count("health").alias("covered"), F.count_if("dead").alias("dead"))
    return counts.select("total", "covered", F.when(F.col("total") == 0, F.lit(0.0)).otherwise(F.round(F.col("covered") / F.col("total"), 3)).alias("coverage"), "dead")


def health_report(symbols: DataFrame, fingerprints: DataFrame, dead: DataFrame | None = None, o: Options = DEFAULTS) -> DataFrame:
    """Symbols with ``health``; duplicates are counted over all fingerprints, with no gate."""
    shapes = fingerprints.groupBy("shape_hash").agg(F.count(F.lit(1)).alias("shape_count"))
    last = fingerprints.groupBy("path", "line").agg(F.max(F.struct("end_line", "name", "node_count", "cognitive", "shape_hash")).alias("f"))
    fp = last.select("path", "line", "f.node_count", "f.cognitive", "f.shape_hash").join(shapes, "shape_hash")
    rows = symbols.join(fp, ["path", "line"], "left")
    if dead is not None:
        rows = rows.join(dead.select("path", "line").distinct().withColumn("dead", F.lit(True)), ["path", "line"], "left")
    else:
        rows = rows.withColumn("dead", F.lit(False))
    score = S.health(F.col("node_count"), F.coalesce("shape_count", F.lit(1)), F.col("cognitive"), o)
    return rows.select("path", "line", "name", "kind", "node_count", "cognitive", F.coalesce("shape_count", F.lit(0)).alias("shape_count"), F.coalesce("dead", F.lit(False)).alias("dead"), score.alias("health"))


def worst_health(report: DataFrame, most: int = DEFAULTS.output_budget) -> DataFrame:
    return report.filter("health IS NOT NULL").orderBy("health", "path", "line").limit(most)


def _host(url: Column) -> Column:
    u = F.trim(url)
    return F.lower(F.when(u.contains("://"), F.regexp_extract(u, r"://([^/?#]*)", 1)).otherwise(F.substring_index(u, "/", 1)))


def provider_sites(files: DataFrame, rules=SITE_RULES, imports=IMPORT_MARKERS, hosts: dict[str, str] = COMPATIBLE_HOSTS, local_hosts: tuple[str, ...] = LOCAL_HOSTS) -> DataFrame:
    """(``path``, ``line``, ``provider``, ``channel``, ``snippet``): the first rule of each line that resolves.

    A file's context (imports, base URLs) is computed once on its row; its lines are exploded beside it, so there is no join.
    The rules are one CASE chain: a rule whose import is missing or whose provider is unknown gives way to the next.
    """
    urls = F.transform(F.regexp_extract_all("text", F.lit(BASE_URL), F.lit(1)), _host)
    bare = lambda h: F.substring_index(h, ":", 1)
    is_local = F.exists(urls, lambda h: bare(h).isin(*local_hosts) | h.isin(*local_hosts))
    lookup = F.create_map(*(F.lit(x) for kv in hosts.items() for x in kv))
    known = F.filter(urls, lambda h: h.isin(*hosts) & ~(bare(h).isin(*local_hosts)))
    provider = F.when(F.size(known) > 0, F.element_at(lookup, F.element_at(known, 1)))
    context = files.select("path", "text", is_local.alias("local"), provider.alias("base"), *(F.col("text").rlike(p).alias(f"has_{m}") for p, m in imports))
    lines = context.select("*", F.posexplode(F.split("text", r"\r\n|[\n\r\x0b\f\x1c-\x1e\x85  ]", -1)).alias("at", "raw")).withColumn("txt", F.trim(F.regexp_replace("raw", r"^\s+|\s+$", ""))).filter("txt <> ''")
    found = None
    for pattern, who, channel, need in rules:
        test = F.col("txt").rlike(pattern)
        if need:
            test = test & F.col(f"has_{need}")
        if who == "?":
            value = F.struct(F.when(F.col("local"), "ollama").when(F.col("base").isNotNull(), F.col("base")).otherwise("openai").alias("provider"), F.when(F.col("local"), "local").otherwise(channel).alias("channel"))
        elif who == "$1":
            name = F.regexp_extract("txt", pattern, 1)
            test = test & (name != "")
            value = F.struct(name.alias("provider"), F.lit(channel).alias("channel"))
        else:
            value = F.struct(F.lit(who).alias("provider"), F.lit(channel).alias("channel"))
        found = F.when(test, value) if found is None else found.when(test, value)
    return lines.withColumn("hit", found).filter("hit IS NOT NULL").select("path", (F.col("at") + 1).alias("line"), "hit.provider", "hit.channel", S.squeezed("txt").alias("snippet"))


def provider_edges(sites: DataFrame) -> DataFrame:
    """(``path``, ``provider``, ``channel`` of most severity, ``n_sites``)."""
    rank = F.create_map(*(F.lit(x) for kv in SEVERITY.items() for x in kv))[F.col("channel")]
    return sites.groupBy("path", "provider").agg(F.max_by("channel", rank).alias("channel"), F.count(F.lit(1)).alias("n_sites"))


def site_counts(sites: DataFrame) -> DataFrame:
    """Call sites by channel."""
    return sites.groupBy("channel").agg(F.count(F.lit(1)).alias("n_sites"), F.countDistinct("path").alias("n_files"))


def provider_nodes(sites: DataFrame) -> DataFrame:
    rank = F.create_map(*(F.lit(x) for kv in SEVERITY.items() for x in kv))[F.col("channel")]
    return sites.groupBy("provider").agg(F.max_by("channel", rank).alias("channel"), F.countDistinct("path").alias("n_files"), F.count(F.lit(1)).alias("n_sites"))


def dominant(files: DataFrame, by: list[str], value: str, ratio: float = DEFAULTS.language_ratio) -> DataFrame:
    """The most frequent ``value`` of each group where its share reaches the ratio, else null; ties go to the smaller value."""
    counts = files.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy(*by).agg(F.sum("n").alias("total"), F.max("n").alias("most"), F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias("top"))
    share = F.col("most") / F.col("total")
    return top.select(*by, F.when(share >= ratio, F.col("top")).alias("dominant"), F.round(share, 4).alias("ratio"))
