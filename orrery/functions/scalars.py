"""Scalar expressions shared by the operators. All stay inside generated code: no Python runs on rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..options import DEFAULTS, Options

IDENTIFIER = "[A-Za-z_][A-Za-z0-9_]*"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def posix(path: Column | str) -> Column:
    return F.replace(col(path), F.lit("\\"), F.lit("/"))


def basename(path: Column | str) -> Column:
    return F.substring_index(posix(path), "/", -1)


def extension(path: Column | str) -> Column:
    """Lower-cased, with its dot; empty where there is none."""
    return F.lower(F.regexp_extract(basename(path), r"(\.[^.]+)$", 1))


def squeezed(text: Column | str, most: int = 140) -> Column:
    return F.substring(F.trim(F.regexp_replace(col(text), r"\s+", " ")), 1, most)


def script_safe_json(value: Column | str) -> Column:
    """JSON of a struct, map or array that may stand inside a script element of a page."""
    out = F.to_json(col(value))
    for c in "<>&\u2028\u2029":
        out = F.replace(out, F.lit(c), F.lit(f"\\u{ord(c):04x}"))
    return out


def symbol_id(path: Column | str = "path", scope: Column | str = "scope", name: Column | str = "name", line: Column | str = "line") -> Column:
    return F.concat_ws("::", col(path), col(scope), col(name), col(line).cast("string"))


def id_line(symbol: Column | str) -> Column:
    return F.substring_index(col(symbol), "::", -1).cast("int")


def hash32(value: Column | str) -> Column:
    """The first 32 bits of the MD5: a portable stand-in for CRC-32."""
    return F.conv(F.substring(F.md5(col(value)), 1, 8), 16, 10).cast("long")


def smoothstep(low: float, high: float, x: Column | str) -> Column:
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (col(x) - F.lit(low)) / F.lit(high - low)))
    return t * t * (F.lit(3.0) - F.lit(2.0) * t)


def well_named(name: Column | str) -> Column:
    """Not private, and an underscore or both cases in it."""
    n = col(name)
    return ~n.startswith("_") & (n.contains("_") | ((F.lower(n) != n) & (F.upper(n) != n)))


def quality(name: Column | str, defining_files: Column | str, o: Options = DEFAULTS) -> Column:
    """What a target's name says of its worth: private less, well-named more, common less."""
    n = col(name)
    by_name = F.when(n.startswith("_"), F.lit(o.private_mult)).when((F.length(n) >= o.well_named_length) & well_named(n), F.lit(o.well_named_mult)).otherwise(F.lit(1.0))
    return by_name * F.when(col(defining_files) > o.common_threshold, F.lit(o.common_mult)).otherwise(F.lit(1.0))


def confidence_weight(confidence: Column | str, o: Options = DEFAULTS) -> Column:
    return F.when(col(confidence) == "high", F.lit(o.confidence_high)).otherwise(F.lit(o.confidence_low))


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(part * 100.0 / whole, 1))


def first_rule(rules: Sequence[tuple[Column, str]], otherwise: Column | None = None) -> Column:
    """The label of the first rule that holds."""
    (test, label), *rest = rules
    chain = reduce(lambda w, r: w.when(r[0], F.lit(r[1])), rest, F.when(test, F.lit(label)))
    return chain if otherwise is None else chain.otherwise(otherwise)


def is_test_path(path: Column | str) -> Column:
    p = F.lower(posix(path))
    base = basename(p)
    return base.startswith("test_") | base.rlike(r"(_test|\.test|\.spec|_spec)\.[a-z0-9]+$") | (base == "conftest.py") | p.rlike(r"(^|/)(tests?|__tests__|spec)/")


def reliability(engine: Column, has_definition: Column, high: Column, low: Column) -> Column:
    return (
        F.when(engine == "name-match", "low").when(~has_definition, "low").when((high == 0) & (low == 0), "medium").when((low > high * 3) & (low > 5), "medium").otherwise("high")
    )


def orphan_verdict(entry: Column, engine: Column, error: Column, has_definition: Column, high: Column, reexports: Column) -> Column:
    return (
        F.when(entry, "PUBLIC_API")
        .when(~engine.isin("jedi", "ts-morph", "relational"), "UNKNOWN_NO_RESOLVER")
        .when(error | ~has_definition, "UNKNOWN_UNRESOLVED")
        .when((high > 0) & (reexports == high), "REEXPORT_ONLY")
        .when(high > 0, "KEEP")
        .otherwise("LIKELY_UNUSED")
    )


def health(node_count: Column, shape_count: Column, cognitive: Column, o: Options = DEFAULTS) -> Column:
    """1 less the weighted penalties over the axes that are known; null without a fingerprint."""
    bloat = smoothstep(*o.bloat_range, node_count.cast("double")) * o.weight_bloat
    duplicate = F.when(shape_count > 1, F.lit(o.weight_duplicate)).otherwise(F.lit(0.0))
    known = cognitive.isNotNull()
    cog = F.when(known, smoothstep(*o.cognitive_range, cognitive.cast("double")) * o.weight_cognitive).otherwise(F.lit(0.0))
    weight = F.lit(o.weight_bloat + o.weight_duplicate) + F.when(known, F.lit(o.weight_cognitive)).otherwise(F.lit(0.0))
    return F.when(node_count.isNotNull(), F.round(F.lit(1.0) - (bloat + duplicate + cog) / weight, 4))
