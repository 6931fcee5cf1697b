"""What a repository says of itself: visible files, ignored paths, scripts, its commit; and facts read off a file's text."""

from __future__ import annotations

import os
import subprocess
import tomllib
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rule_tables import SKIP_DIRS
from ..functions.scalars import extension, posix


def _git(root: str, *args: str, data: str | None = None) -> str | None:
    """Output of a git command, or null where git, the worktree or the answer is missing."""
    try:
        done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=60, input=data, check=False)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout if done.returncode in (0, 1) else None


def visible_paths(spark: SparkSession, root: str) -> DataFrame | None:
    """(``path``) tracked or untracked but not ignored, that exist, outside skipped directories; null if there is no worktree."""
    listed = _git(root, "ls-files", "--cached", "--others", "--exclude-standard", "-z")
    if listed is None or _git(root, "rev-parse", "--is-inside-work-tree") != "true\n":
        return None
    rows = [(p,) for p in sorted(set(listed.split("\0"))) if p and (Path(root) / p).is_file()]
    paths = spark.createDataFrame(rows, "path string")
    return paths.filter(~skipped("path"))


def skipped(path: Column | str) -> Column:
    return F.exists(F.split(posix(path), "/"), lambda p: p.isin(*SKIP_DIRS))


def is_ignored(root: str, paths: list[str]) -> dict[str, bool]:
    """Whether each path lies in a skipped directory or is ignored by git: one call for all of them."""
    out = {p: bool(set(Path(p).parts) & set(SKIP_DIRS)) for p in paths}
    rest = [p for p, skip in out.items() if not skip]
    said = _git(root, "check-ignore", "-z", "--stdin", data="\0".join(rest)) if rest else None
    return out | {p: True for p in (said or "").split("\0") if p}


def contained(root: str, raw: str) -> str:
    """The absolute path of ``raw`` below the root; a path that leaves it, by dots or by a link, is refused."""
    base = os.path.abspath(root)
    target = os.path.abspath(os.path.join(base, raw))
    for a, b in ((base, target), (os.path.realpath(base), os.path.realpath(target))):
        if os.path.commonpath([a, b]) != a:
            raise ValueError(f"outside of the repository: {raw}")
    return target


def script_functions(root: str) -> set[str]:
    """Names of the functions that the project file makes scripts of; an unreadable file has none."""
    try:
        project = tomllib.loads((Path(root) / "pyproject.toml").read_text(encoding="utf-8")).get("project", {})
    except (OSError, tomllib.TOMLDecodeError, UnicodeDecodeError):
        return set()
    targets = [t for table in ("scripts", "gui-scripts") for t in (project.get(table) or {}).values() if isinstance(t, str) and ":" in t]
    return {t.split(":", 1)[1].split("[")[0].strip().split(".")[-1] for t in targets}


def commit_id(root: str) -> str | None:
    said = _git(root, "rev-parse", "HEAD")
    return said.strip() if said and len(said.strip()) >= 40 else None


def freshness(indexed: str | None, now: str | None) -> str:
    """``equal``, ``stale``, or ``unknown`` where one of the commits is."""
    return "unknown" if not indexed or not now else "equal" if indexed == now else "stale"


def go_imports(files: DataFrame) -> DataFrame:
    """(``path``, ``line``, ``alias``, ``module``) of Go files: single imports and blocks, from (``path``, ``text``)."""
    spec = r'^\s*(?:import\s+)?(?:([A-Za-z_][A-Za-z0-9_]*|\.)\s+)?(?:"([^"]+)"|`([^`]+)`)\s*;?\s*(?://.*)?$'
    lines = files.filter(extension("path") == ".go").select("path", F.posexplode(F.split(F.regexp_replace("text", "\r", ""), "\n", -1)).alias("at", "txt"))
    # a line's block: opened by "import (" and closed by ")" before any other declaration
    marks = lines.withColumn("mark", F.when(F.col("txt").rlike(r"^\s*import\s*\("), 1).when(F.col("txt").rlike(r"^\s*\)|^(func|var|const|type)\b"), 0))
    from pyspark.sql import Window

    inside = F.last("mark", ignorenulls=True).over(Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    rows = marks.withColumn("inside", inside).filter((F.col("inside") == 1) | F.col("txt").rlike(r"^\s*import\s+[^(]")).filter(F.col("txt").rlike(spec))
    alias = F.regexp_extract("txt", spec, 1)
    module = F.coalesce(F.nullif(F.regexp_extract("txt", spec, 2), F.lit("")), F.regexp_extract("txt", spec, 3))
    return rows.select("path", (F.col("at") + 1).alias("line"), F.nullif(alias, F.lit("")).alias("alias"), module.alias("module"))


def description(path: Column | str, text: Column | str) -> Column:
    """What a file is about: the first sentence of a comment in its first 40 lines, at most 48 characters; else its folder and suffix."""
    p, t = posix(path), F.col(text) if isinstance(text, str) else text
    head = F.slice(F.split(t, "\r?\n", 42), 1, 40)
    comment = r'^\s*(?:#+(?!!)|//+|/\*+|\*(?!/)|"""|' + r"'''" + r"|<!--|--)\s*(.*?)\s*(?:\*/|-->|\"\"\")?\s*$"
    said = F.filter(F.transform(head, lambda x: F.regexp_extract(x, comment, 1)), lambda x: x.rlike(r"[\p{L}\p{N}]"))
    sentence = F.trim(F.substring(F.regexp_extract(F.element_at(said, 1), r"^(.*?[.!?。](?=\s|$)|.*)", 1), 1, 48))
    folder = F.element_at(F.split(p, "/"), -2)
    fallback = F.concat_ws(" ", F.when(F.size(F.split(p, "/")) > 1, folder), F.nullif(extension(p), F.lit("")))
    return F.when(F.size(said) > 0, sentence).otherwise(fallback)
