"""Fixed schemas of the stored relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _struct(text: str) -> T.StructType:
    return T._parse_datatype_string(text)


META = "key string, value string"
FILES = "path string, content_hash string, indexed_at double"
SYMBOLS = "path string, kind string, name string, line int, end_line int, scope string, decorators array<string>, exported boolean"
IMPORTS = "path string, module string, name string, alias string, line int"
TOKENS = "path string, line int, name string, mult bigint"
REFS = "src_path string, src_line int, symbol_name string, def_path string, def_line int, confidence string"
FINGERPRINTS = "path string, name string, kind string, line int, end_line int, scope string, shape_hash string, raw_token_hash string, call_hash string, node_count int, nstmts int, has_control_flow boolean, cognitive int"
FINGERPRINT_INDEX = "path string, line int, fp_value bigint"
COMMENTS = "path string, line int, end_line int, kind string, is_doc boolean, tag string, scope string, owner_line int, text string"
TABLES = {"meta": META, "files": FILES, "symbols": SYMBOLS, "refs": REFS, "fingerprints": FINGERPRINTS, "fingerprint_index": FINGERPRINT_INDEX, "comments": COMMENTS, "imports": IMPORTS, "tokens": TOKENS}
#: Columns that name the file of a row; a file's replacement deletes by them.
OWNERS = {"files": ("path",), "symbols": ("path",), "refs": ("src_path", "def_path"), "fingerprints": ("path",), "fingerprint_index": ("path",), "comments": ("path",), "imports": ("path",), "tokens": ("path",)}


def conform(df: DataFrame, table: str) -> DataFrame:
    """``df`` with exactly the table's columns and types; missing columns are null."""
    have = set(df.columns)
    from pyspark.sql import functions as F

    fields = [c.strip().split(" ") for c in TABLES[table].split(",")]
    return df.select(*((F.col(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t in fields))
