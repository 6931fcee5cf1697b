"""The calls of the service as one class over versioned tables: an index is built, everything else reads it."""

from __future__ import annotations

from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.scalars import reliability
from .operators import clones, comments, edges, graph, references, rules, tables
from .options import DEFAULTS, Options
from .plans.ranking import symbol_map
from .schemas import conform
from .sources import python_code, repository
from .sources.lexer import ALL_SUFFIXES


class NotIndexed(RuntimeError):
    """The project has no index yet."""


class Project:
    def __init__(self, spark: SparkSession, root: str, store: str, options: Options = DEFAULTS):
        self.spark, self.root, self.options = spark, root.rstrip("/"), options
        self.tables = tables.Snapshots(spark, store)

    def files(self) -> DataFrame:
        """All source files below the root; in a worktree those that git shows."""
        found = python_code.scan(self.spark, self.root, ALL_SUFFIXES)
        visible = repository.visible_paths(self.spark, self.root)
        return found if visible is None else found.join(visible, "path", "left_semi")

    def _need(self) -> dict:
        state = self.tables.state()
        if "symbols" not in state["tables"]:
            raise NotIndexed(self.root)
        return state

    def index_project(self, *, force: bool = False) -> dict[str, int]:
        """Index what changed since the last version, drop what is gone; returns counts by status."""
        state, now = self.tables.state(), self.files()
        diff = tables.hash_diff(now, self.tables.read("files", state)).cache()
        counts = {r["status"]: r["n"] for r in diff.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
        changed = diff.filter("status IN ('new', 'changed')" if not force else "status <> 'removed'").select("path")
        removed = diff.filter("status = 'removed'").select("path")
        if force or set(counts) - {"same"}:
            self._write(now.join(changed, "path", "left_semi"), changed, removed, state)
        diff.unpersist()
        return counts

    def index_paths(self, paths: list[str] | DataFrame) -> int:
        """Index changed paths (a list, or a table with ``path``): files, directories (all below them) or what is gone; returns the version.

        Files meet the paths by their own folders, one equality join however many paths there are.
        """
        state = self.tables.state()
        asked = paths.select("path") if isinstance(paths, DataFrame) else self.spark.createDataFrame([(p,) for p in paths], "path string")
        asked = asked.select(F.regexp_replace("path", "/+$", "").alias("prefix")).distinct()
        parts = F.split("path", "/")
        prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))

        def hit(files: DataFrame) -> DataFrame:
            found = files.select("path", F.explode(prefixes).alias("prefix")).join(asked, "prefix").select("path").distinct()
            return files.join(found, "path", "left_semi")

        now = hit(self.files())
        old = hit(self.tables.read("files", state)).select("path")
        return self._write(now, now.select("path"), old.join(now, "path", "left_anti"), state)

    def _write(self, now: DataFrame, changed: DataFrame, removed: DataFrame, state: dict) -> int:
        rows = python_code.extract(now)
        units = rows["fingerprint"]
        index = clones.fingerprint_index(units.filter(F.col("has_control_flow") & (F.col("node_count") >= self.options.min_nodes)), o=self.options, joiner="\x1f", digest=F.crc32)
        new = {
            "imports": rows["import"], "tokens": edges.tokens(self._lines(now)),
            "files": now.select("path", "content_hash", F.unix_micros(F.current_timestamp()).cast("double").alias("at")).withColumn("indexed_at", F.col("at") / 1e6),
            "symbols": rows["symbol"], "comments": rows["comment"], "fingerprints": units, "fingerprint_index": index,
        }
        commit = repository.commit_id(self.root)
        if commit:
            new["meta"] = self.spark.createDataFrame([("commit", commit)], "key string, value string")
        return self.tables.replace_files(changed, new, state["version"], removed)

    def freshness(self) -> str:
        """Whether the index is of the commit that is checked out."""
        known = {r["key"]: r["value"] for r in self.tables.read("meta").collect()}
        return repository.freshness(known.get("commit"), repository.commit_id(self.root))

    def get_symbols(self, file: str | None = None) -> DataFrame:
        s = self.tables.read("symbols")
        return s.filter(F.col("path") == file).orderBy("line") if file else s.orderBy("path", "line")

    def _lines(self, files: DataFrame) -> DataFrame:
        lines = files.select("path", F.posexplode(F.split("text", "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", -1)).alias("at", "txt"))
        return lines.select("path", (F.col("at") + 1).alias("line"), "txt")

    def _tokens(self) -> DataFrame:
        return self.tables.read("tokens", self._need())

    def occurrences(self, word: str) -> DataFrame:
        """Every place of a word, with its column, in the files that have it; no cap."""
        hit = self._tokens().filter(F.col("name") == word).select("path").distinct()
        return references.word_occurrences(self._lines(self.files().join(hit, "path", "left_semi")), word)

    def candidate_files(self, word: str) -> DataFrame:
        return references.candidate_files(self._tokens(), word, self.options)

    def find_references(self, symbol: str, *, def_path: str | None = None, include_low: bool = True) -> DataFrame:
        """Occurrences of a name but for its definition line: high in its own file or where an import binds it, else low.

        Definitions in languages without a resolver are matched by name only: low everywhere.
        """
        self._need()
        seed = self._definition(symbol, def_path)
        out = references.name_matches(self._tokens(), symbol) if seed.isEmpty() and not def_path else self._references(seed)
        return out if include_low else out.filter("confidence = 'high'")

    def _references(self, definitions: DataFrame, *, low: bool = True) -> DataFrame:
        """``find_references`` of many definitions (``path``, ``line``, ``name``) in one join by name."""
        return references.resolved(self._tokens(), self.tables.read("imports"), definitions, low=low)

    def _definition(self, symbol: str, def_path: str | None = None) -> DataFrame:
        """The first definition of a name that references can point at."""
        symbols = self.tables.read("symbols").filter((F.col("name") == symbol) & F.col("kind").isin(*self.options.referenceable))
        return (symbols.filter(F.col("path") == def_path) if def_path else symbols).orderBy("path", "line").limit(1)

    def reference_level(self, symbol: str) -> str:
        """How far the references of a name can be trusted; low where its language has no resolver or nothing defines it."""
        self._need()
        known = self._definition(symbol).select(rules.resolver("path").alias("engine")).first()
        if known is None or known["engine"] == "none":
            return "low"
        r = self.find_references(symbol).agg(F.count_if(F.col("confidence") == "high").alias("high"), F.count_if(F.col("confidence") == "low").alias("low"))
        return r.select(reliability(F.lit("relational"), F.lit(True), F.col("high"), F.col("low"))).first()[0]

    def build_refs(self, symbol: str, *, def_path: str | None = None) -> int:
        """Store a name's high references (of the definition in one file, if given), unless the index moved meanwhile."""
        state = self._need()
        refs = self.find_references(symbol, def_path=def_path, include_low=False)
        same = F.col("symbol_name") == symbol
        old = self.tables.read("refs", state).filter(~(same & (F.col("def_path") == def_path) if def_path else same))
        return self.tables.commit({"refs": conform(old, "refs").unionByName(conform(refs, "refs"))}, state["version"])

    def call_hierarchy(self, symbol: str, *, direction: str = "both", max_hops: int | None = None, def_path: str | None = None, build_edges: bool = True) -> DataFrame:
        """Callers and callees over the stored references; the symbol's own are found and stored first, unless told not to."""
        state = self._need()
        symbols = self.tables.read("symbols", state)
        seed = symbols.filter(F.col("name") == symbol)
        seed = (seed.filter(F.col("path") == def_path) if def_path else seed).orderBy("path", "line").limit(1)
        if build_edges and (row := seed.first()) is not None:
            # another writer came first: what is stored has to do
            with suppress(tables.StaleVersion):
                self.build_refs(symbol, def_path=row["path"])
            state = self._need()
            symbols = self.tables.read("symbols", state)
        return graph.hierarchy(self.tables.read("refs", state), symbols, seed, direction, self.options.max_hops if max_hops is None else max_hops)

    def impact(self, symbol: str, *, max_hops: int | None = None, def_path: str | None = None, with_important: bool = False) -> DataFrame:
        """Callers by bucket; ``with_important`` marks those among the thirty symbols of most rank."""
        callers = self.call_hierarchy(symbol, direction="up", max_hops=max_hops, def_path=def_path)
        important = None
        if with_important:
            ids = F.concat_ws(":", "path", F.col("line").cast("string"), "kind")
            important = self.get_map().join(self.get_symbols().select(ids.alias("id"), "name"), "id").select("name", "score")
        return graph.impact(callers, important, entry=rules.entry_reason("path").isNotNull())

    def definition_at(self, path: str, line: int) -> DataFrame:
        """Where the names on a line are defined, by the references of every definition of those names."""
        here = self._tokens().filter((F.col("path") == path) & (F.col("line") == line)).select("name").distinct()
        found = self._references(self.tables.read("symbols").join(here, "name", "left_semi"))
        return references.definition_at(found, path, line)

    def name_edges(self) -> DataFrame:
        return edges.name_edges(self._tokens(), self.tables.read("symbols", self._need()), self.options)

    def get_map(self, token_budget: int | None = None, *, focus_symbols=(), focus_files=(), with_name_edges: bool = True) -> DataFrame:
        state = self._need()
        refs = self.tables.read("refs", state)
        if with_name_edges:
            refs = refs.withColumn("multiplicity", F.lit(1).cast("long")).unionByName(self.name_edges())
        return symbol_map(self.tables.read("symbols", state), refs, budget=token_budget or self.options.token_budget, focus_names=list(focus_symbols), focus_files=list(focus_files))

    def status(self) -> dict:
        state = self.tables.state()
        if "symbols" not in state["tables"]:
            return {"indexed": False, "version": state["version"]}
        counts = tables.stats({t: self.tables.read(t, state) for t in ("files", "symbols", "refs", "fingerprints", "comments")})
        return {"indexed": True, "version": state["version"]} | {r["table_name"]: r["rows"] for r in counts.collect()}

    def find_deadcode(self, scope_file: str | None = None) -> DataFrame:
        """Verdicts of top-level symbols by the references found now; nothing needs to be stored before."""
        state = self._need()
        s = self.tables.read("symbols", state)
        s = s.filter(F.col("path") == scope_file) if scope_file else s
        judged = s.filter((F.col("scope") == "") & F.col("kind").isin(*self.options.referenceable) & rules.entry_reason("path").isNull())
        # what a name alone gives is counted by name, never laid out
        named = self._tokens().groupBy("name").agg(F.count(F.lit(1)).alias("named"))
        return rules.orphans(s, self._references(judged, low=False), engine=rules.resolver("path"), scripts=repository.script_functions(self.root), named=named, o=self.options)

    def deadcode_report(self, scope_file: str | None = None, *, by_name: bool = False) -> dict:
        """Verdicts of symbols and imports, the counts of each, and what they can't see; ``by_name`` opts in to unused imports by name."""
        symbols = self.find_deadcode(scope_file)
        imports = self.tables.read("imports")
        imports = imports.filter(F.col("path") == scope_file) if scope_file else imports
        imports = rules.unused_imports(imports, self._tokens() if by_name else None)
        counts = {r["verdict"]: r["n"] for r in rules.verdict_histogram(symbols).collect()}
        return {"symbols": symbols, "imports": imports, "summary": counts, "advisory": rules.advisory(counts)}

    def find_unwired(self) -> DataFrame:
        s = self.tables.read("symbols", self._need())
        exempt = s.filter(rules.entry_reason("path").isNotNull()).select("path", "line")
        return edges.unwired(s, edges.direct_usage(self._tokens(), s, self.options), self.options, exempt)

    def find_ai_usage(self, scope_file: str | None = None) -> DataFrame:
        files = self.files()
        return rules.provider_sites(files.filter(F.col("path") == scope_file) if scope_file else files)

    def ai_usage_report(self, scope_file: str | None = None) -> dict[str, DataFrame]:
        """Sites, their counts by channel, the worst channel of each file and provider, and of each provider."""
        sites = self.find_ai_usage(scope_file)
        return {"sites": sites, "channels": rules.site_counts(sites), "edges": rules.provider_edges(sites), "providers": rules.provider_nodes(sites)}

    def describe_files(self) -> DataFrame:
        return self.files().select("path", repository.description("path", "text").alias("description"))

    def comment_report(self) -> dict[str, DataFrame]:
        """Coverage by kind, marks by tag, and comments by file."""
        c = self.tables.read("comments", self._need())
        return {"coverage": self.get_comment_overview(), "tags": comments.tag_counts(c, self.options), "files": c.groupBy("path").agg(F.count(F.lit(1)).alias("n_comments"), F.sum(F.col("end_line") - F.col("line") + 1).alias("n_lines"))}

    def get_comment_overview(self) -> DataFrame:
        state = self._need()
        return comments.coverage(comments.documented(self.tables.read("symbols", state), self.tables.read("comments", state), self.options))

    def find_comment_tags(self, tag: str | None = None) -> DataFrame:
        return comments.tag_lines(self.tables.read("comments", self._need()), self.options, tag)

    def get_comments(self, **tests) -> DataFrame:
        return comments.select_comments(self.tables.read("comments", self._need()), **tests)

    def get_health(self, *, with_dead: bool = False) -> DataFrame:
        """``with_dead`` flags the symbols that nothing refers to."""
        state = self._need()
        dead = self.find_deadcode().filter("verdict = 'LIKELY_UNUSED'") if with_dead else None
        return rules.health_report(self.tables.read("symbols", state), self.tables.read("fingerprints", state), dead, self.options)

    def health_coverage(self) -> DataFrame:
        return rules.health_coverage(self.get_health(with_dead=True))

    def find_duplicates(self, **how) -> DataFrame:
        state = self._need()
        return clones.duplicates(self.tables.read("fingerprints", state), self.tables.read("fingerprint_index", state), self.options, **how)
