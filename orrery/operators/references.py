"""Where a name occurs: files that could refer to it, places on their lines, references with their confidence."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..options import DEFAULTS, Options
from ..runtime import stored
from .rules import resolver

#: Modules that a name may be handed on through.
MAX_REEXPORTS = 32


def word_occurrences(lines: DataFrame, word: str) -> DataFrame:
    """(``path``, ``line``, ``col``): every whole-word occurrence; columns count from 0. From (``path``, ``line``, ``txt``).

    A line without the word is dropped by a plain containment test that needs no pattern; the pieces between the occurrences give
    the columns.
    """
    pieces = F.split("txt", rf"(?<!\w){re.escape(word)}(?!\w)", -1)
    some = lines.filter(F.col("txt").contains(word)).withColumn("pieces", pieces).filter(F.size("pieces") > 1)
    heads = F.transform(F.col("pieces"), lambda p: F.length(p))
    at = some.select("path", "line", heads.alias("lengths")).select("path", "line", "lengths", F.posexplode(F.slice("lengths", F.lit(1), F.size("lengths") - 1)).alias("i", "own"))
    before = F.aggregate(F.slice("lengths", F.lit(1), F.col("i") + 1), F.lit(0), lambda acc, n: acc + n)
    return at.select("path", "line", (before + F.col("i") * len(word)).alias("col"))


def candidate_files(tokens: DataFrame, word: str, o: Options = DEFAULTS) -> DataFrame:
    """(``path``, ``truncated``): the first files, by path, that have the word; ``truncated`` if there are more than the cap.

    The cap is the feature of an interactive call; ``word_occurrences`` has none.
    """
    paths = tokens.filter(F.col("name") == word).select("path").distinct().orderBy("path").limit(o.candidate_files + 1)
    n = paths.agg((F.count(F.lit(1)) > o.candidate_files).alias("truncated"))
    return paths.orderBy("path").limit(o.candidate_files).crossJoin(F.broadcast(n))


def reference_summary(refs: DataFrame) -> DataFrame:
    """By name: definitions referred to, references of each confidence, and files."""
    return refs.groupBy("symbol_name").agg(
        F.countDistinct("def_path", "def_line").alias("definitions"), F.count_if(F.col("confidence") == "high").alias("high"), F.count_if(F.col("confidence") == "low").alias("low"), F.countDistinct("src_path").alias("files")
    )


def module_of(path: Column | str) -> Column:
    """The dotted module of a Python file; a package for its ``__init__``."""
    p = F.col(path) if isinstance(path, str) else path
    return F.regexp_replace(F.regexp_replace(p, r"(/__init__)?\.pyi?$", ""), "/", ".")


def _last(module: Column | str) -> Column:
    return F.substring_index(module, ".", -1)


def _within(module: Column, known: Column) -> Column:
    """Whether an import's module is the end of a known one: roots differ and relative imports leave the package out."""
    return F.concat(F.lit("."), known).endswith(F.concat(F.lit("."), module))


def bindings(imports: DataFrame, definitions: DataFrame) -> DataFrame:
    """(``path``, ``bound``, ``at``, ``imported``, ``name``, ``def_path``, ``def_line``): which names of a file mean which definition.

    A definition is a name of its module; a file that imports the name (or all names, by a star) has it under its alias, and hands it
    on as a name of its own module. So the rounds go on from what the last one found new, until there is nothing. Importing the
    module itself binds the name too: it is then reached as an attribute.
    """
    keys = ["name", "def_path", "def_line"]
    own = imports.select("path", F.coalesce("module", F.lit("")).alias("module"), "name", "alias", F.col("line").alias("at"))
    # "from . import name" states no module: it is the file's own package
    package = module_of(F.regexp_replace("path", r"[^/]*$", "__init__.py"))
    names = own.filter("name IS NOT NULL").withColumn("module", F.when(F.col("module") == "", package).otherwise(F.col("module")))
    names = names.select("path", "module", F.col("name").alias("imported"), "alias", "at", _last("module").alias("stem"))
    seed = definitions.select(*keys, module_of("def_path").alias("known"), F.col("name").alias("exported")).distinct()
    frontier = seen = seed.withColumn("stem", _last("known"))
    found = []
    for _ in range(MAX_REEXPORTS):
        hit = names.join(frontier, "stem").filter(_within(F.col("module"), F.col("known")) & ((F.col("imported") == F.col("exported")) | (F.col("imported") == "*")))
        hit = hit.filter(F.col("path") != F.col("def_path"))
        bound = F.when(F.col("imported") == "*", F.col("exported")).otherwise(F.col("alias"))
        step = stored(hit.select("path", bound.alias("bound"), "at", F.when(F.col("imported") != "*", F.col("imported")).alias("imported"), *keys).distinct(), "bindings")
        found.append(step)
        new = step.select(*keys, module_of("path").alias("known"), F.col("bound").alias("exported")).distinct().withColumn("stem", _last("known"))
        frontier = new.join(seen, [*keys, "known", "exported"], "left_anti")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(new)
    whole = own.select("path", "at", F.when(F.col("name").isNull(), F.col("module")).otherwise(F.concat_ws(".", F.nullif("module", F.lit("")), "name")).alias("module"))
    whole = whole.withColumn("stem", _last("module")).join(seed.select(*keys, "known", _last("known").alias("stem")), "stem").filter(_within(F.col("module"), F.col("known")))
    out = whole.select("path", F.col("name").alias("bound"), "at", F.lit(None).cast("string").alias("imported"), *keys)
    for step in found:
        out = out.unionByName(step)
    return out.filter(F.col("path") != F.col("def_path")).distinct()


def resolved(tokens: DataFrame, imports: DataFrame, definitions: DataFrame, *, low: bool = True) -> DataFrame:
    """References of definitions (``path``, ``line``, ``name``): high in their own file and where an import binds them, else low.

    Definitions in languages without a resolver have low ones only. ``aliased`` marks references by another name. Without ``low`` no
    token meets a definition by its name alone.
    """
    defs = definitions.select("name", F.col("path").alias("def_path"), F.col("line").alias("def_line")).distinct()
    known = defs.filter(resolver("def_path") != "none")
    bound = bindings(imports, known)
    here = known.withColumnRenamed("name", "symbol_name")
    own = tokens.join(here, (F.col("path") == F.col("def_path")) & (F.col("name") == F.col("symbol_name"))).filter(F.col("line") != F.col("def_line"))
    own = own.select(F.col("path").alias("src_path"), F.col("line").alias("src_line"), "symbol_name", "def_path", "def_line", F.col("mult").alias("multiplicity"), F.lit(False).alias("aliased"))
    names = bound.select("path", "bound", F.col("name").alias("symbol_name"), "def_path", "def_line").distinct()
    by_import = tokens.withColumnRenamed("name", "bound").join(names, ["path", "bound"])
    by_import = by_import.select(F.col("path").alias("src_path"), F.col("line").alias("src_line"), "symbol_name", "def_path", "def_line", F.col("mult").alias("multiplicity"), (F.col("bound") != F.col("symbol_name")).alias("aliased"))
    renamed = bound.filter("imported = name AND bound <> name").select(F.col("path").alias("src_path"), F.col("at").alias("src_line"), F.col("name").alias("symbol_name"), "def_path", "def_line", F.lit(1).cast("long").alias("multiplicity"), F.lit(False).alias("aliased"))
    rows = own.unionByName(by_import).unionByName(renamed).withColumn("sure", F.lit(True))
    if low:
        every = tokens.join(defs, "name").filter(~((F.col("path") == F.col("def_path")) & (F.col("line") == F.col("def_line"))))
        every = every.select(F.col("path").alias("src_path"), F.col("line").alias("src_line"), F.col("name").alias("symbol_name"), "def_path", "def_line", F.col("mult").alias("multiplicity"), F.lit(False).alias("aliased"))
        rows = rows.unionByName(every.withColumn("sure", F.lit(False)))
    out = rows.groupBy("src_path", "src_line", "symbol_name", "def_path", "def_line").agg(F.max("sure").alias("sure"), F.max("multiplicity").alias("multiplicity"), F.min("aliased").alias("aliased"))
    return out.withColumn("confidence", F.when(F.col("sure"), "high").otherwise("low")).drop("sure")


def name_matches(tokens: DataFrame, word: str) -> DataFrame:
    """References by name alone, for a name without a known definition: every line that has it, as low."""
    hit = tokens.filter(F.col("name") == word)
    none = lambda t: F.lit(None).cast(t)
    return hit.select(F.col("path").alias("src_path"), F.col("line").alias("src_line"), F.col("name").alias("symbol_name"), none("string").alias("def_path"), none("int").alias("def_line"), F.lit("low").alias("confidence"), F.col("mult").alias("multiplicity"))


def definition_at(refs: DataFrame, path: str, line: int) -> DataFrame:
    """Definitions that the references on a line point at, high ones first."""
    own = refs.filter((F.col("src_path") == path) & (F.col("src_line") == line) & F.col("def_path").isNotNull())
    return own.select("symbol_name", "def_path", "def_line", "confidence").distinct().orderBy(F.col("confidence") != "high", "symbol_name", "def_path", "def_line")
