"""The fields at the head of an entry file, between two lines of three hyphens.

Read as YAML where that library can be imported: flow and nested mappings, quoted keys, anchors, block texts; every scalar is its text, and lists of scalars are joined by spaces. Without the library: top-level
`key: value` lines, quotes taken off; what is indented below a key is its nested text, and a value that starts with | or > is its
indented lines.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

try:
    import yaml
except ImportError:
    yaml = None

from capsift.config import DEFAULT_VERSION
from capsift.functions import paths
from capsift.operators.closure import entry_files

_BLOCK = r"(?s)\A---\r?\n(.*?)\r?\n---(?:\r?\n|\z)"
_KEY = r"(?s)\A([A-Za-z0-9_-]+):[ \t]*(.*)\z"


def block(content: Column) -> Column:
    return F.regexp_extract(content, _BLOCK, 1)


def fields(text: Column) -> Column:
    """map of the top-level fields of a block; of equal keys the last."""
    # a line break before a character that is not indented parts two fields
    parts = F.filter(F.split(text, r"\r?\n(?=[A-Za-z0-9_-]+:)"), lambda p: F.rlike(p, F.lit(_KEY)))
    value = lambda p: paths.trim(F.regexp_extract(p, _KEY, 2))
    bare = lambda v: F.when(F.rlike(v, F.lit(r"\A[|>]")), F.regexp_replace(F.regexp_replace(v, r"\A[|>][+-]?[ \t]*\r?\n?", ""), r"(?m)^[ \t]+", "")).otherwise(F.regexp_replace(F.regexp_replace(v, r"(?s)\A\"(.*)\"\z", "$1"), r"(?s)\A'(.*)'\z", "$1"))
    pairs = F.transform(parts, lambda p: F.struct(F.regexp_extract(p, _KEY, 1).alias("key"), bare(value(p)).alias("value")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def _parsed(text: str) -> dict:
    """fields, the version of the metadata, error. Nested values count as empty: they are never written out, so aliases can't blow up."""
    try:
        found = yaml.load(text, Loader=yaml.BaseLoader) if text else None
    except (yaml.YAMLError, RecursionError, ValueError) as e:
        return {"fields": {}, "version": None, "error": "invalid YAML: " + str(e).splitlines()[0]}
    if not isinstance(found, dict):
        return {"fields": {}, "version": None, "error": "no fields" if text else None}

    def plain(v) -> str:
        if isinstance(v, list) and all(isinstance(x, str) for x in v):
            return " ".join(v)
        return v.strip() if isinstance(v, str) else ""

    meta = found.get("metadata")
    version = meta.get("version") if isinstance(meta, dict) else None
    return {"fields": {k: plain(v) for k, v in found.items() if isinstance(k, str)}, "version": version if isinstance(version, str) and version else None, "error": None}


def _parsed_all(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_parsed(t or "") for t in text], columns=["fields", "version", "error"])


def parsed(text: Column) -> Column:
    """struct of fields, version, error."""
    return F.pandas_udf(_parsed_all, "fields map<string,string>, version string, error string")(text)


def frontmatter(files: DataFrame) -> DataFrame:
    """A row for each package with an entry file: skill_key, path, name, description, license, compatibility, allowed_tools, version, keys, end_line, error."""
    roots = files.where(F.lower("path") == "skill.md")  # before the join: no other file's content is moved
    entries = roots.join(entry_files(files), ["skill_key", "path"]).select("skill_key", "path", F.coalesce("content", F.lit("")).alias("content"))
    rows = entries.withColumn("text", block(F.col("content")))
    if yaml:
        rows = rows.withColumn("p", parsed(F.col("text"))).withColumns({"m": F.col("p.fields"), "version": F.col("p.version"), "bad": F.col("p.error")})
    else:
        rows = rows.withColumn("m", fields(F.col("text")))
        nested = F.regexp_extract(F.coalesce(F.try_element_at("m", F.lit("metadata")), F.lit("")), r"(?m)^[ \t]*version:[ \t]*[\"']?([^\"'\r\n]+?)[\"']?[ \t]*$", 1)
        rows = rows.withColumns({"version": F.nullif(nested, F.lit("")), "bad": F.lit(None).cast("string")})
    of = lambda k: F.try_element_at("m", F.lit(k))
    missing = F.concat_ws(", ", *(F.when(F.coalesce(of(k), F.lit("")) == "", F.lit(k)) for k in ("name", "description")))
    return rows.select(
        "skill_key", "path", of("name").alias("name"), of("description").alias("description"), of("license").alias("license"), of("compatibility").alias("compatibility"), of("allowed-tools").alias("allowed_tools"),
        F.coalesce("version", F.lit(DEFAULT_VERSION)).alias("version"), F.map_keys("m").alias("keys"), F.when(F.length("text") > 0, F.size(F.split("text", "\n")) + 2).cast("int").alias("end_line"),
        F.when(F.length("text") == 0, "no frontmatter").when(F.col("bad").isNotNull(), F.col("bad")).when(missing != "", F.concat(F.lit("missing: "), missing)).alias("error"),
    )
