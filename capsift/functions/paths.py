"""Paths: file types, roles, host paths, references in text, code-block paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File types by extension, in natural order.
TYPE_BY_EXTENSION = {
    "md": "markdown", "txt": "text", "sh": "bash", "bash": "bash", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript",
    "py": "python", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "ini": "config", "sql": "sql", "csv": "csv", "xml": "xml",
}
# Extensions of binary files.
BINARY_EXTENSIONS = ["zip", "tar", "gz", "png", "jpg", "jpeg", "gif", "pdf"]
# File types by the language that a fence names.
TYPE_BY_FENCE = {
    "bash": "bash", "sh": "bash", "shell": "bash", "zsh": "bash", "js": "javascript", "javascript": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "typescript": "typescript",
    "py": "python", "python": "python", "md": "markdown", "markdown": "markdown", "text": "text", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "sql": "sql", "csv": "csv", "xml": "xml",
}
#: Types whose content is scanned.
SCANNED_TYPES = ["markdown", "text", "bash", "javascript", "typescript", "python"]
# Fixed value: a relative path with an extension, as it stands in prose. Word characters are ASCII.
BARE_PATH = r"(?:\.\.?/)?[A-Za-z0-9_./-]+\.[A-Za-z0-9_-]+"
HOST_PATH = r"^~/|^\$[A-Z_][A-Z0-9_]*/|^/"
CONFIG_NAME = r"(?i)\.(env\.example|sample\.|template|example\.)"


def _lookup(key: Column, table: dict[str, str]) -> Column:
    pairs = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.try_element_at(pairs, key)


def trim(text: Column) -> Column:
    """All white space at both ends, not spaces alone."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def file_type(path: Column) -> Column:
    """By what follows the last dot; a bare name counts as its own extension."""
    ext = F.substring_index(F.lower(path), ".", -1)
    return F.coalesce(_lookup(ext, TYPE_BY_EXTENSION), F.when(ext.isin(BINARY_EXTENSIONS), "binary"), F.lit("unknown"))


def fence_type(language: Column) -> Column:
    """Of a fence's info string; null if it names no known language."""
    return _lookup(F.lower(trim(language)), TYPE_BY_FENCE)


def file_role(path: Column) -> Column:
    low = F.lower(path)
    base = F.substring_index(low, "/", -1)
    return (
        F.when(base == "skill.md", "entrypoint")
        .when((base == "reference.md") | F.contains(low, F.lit("/references/")), "reference")
        .when(F.startswith(base, F.lit("license")), "license")
        .when(F.startswith(base, F.lit("readme")), "readme")
        .when(F.contains(low, F.lit("/scripts/")), "script")
        .when(F.rlike(base, F.lit(CONFIG_NAME)), "config")
        .otherwise("regular")
    )


def is_host_path(path: Column) -> Column:
    return F.rlike(path, F.lit(HOST_PATH))


def is_url(text: Column) -> Column:
    return F.rlike(text, F.lit(r"(?i)^https?://"))


def looks_like_path(text: Column) -> Column:
    return F.contains(text, F.lit("/")) | (file_type(text) != "unknown")


def bare_paths(line: Column) -> Column:
    """All candidates in a line of prose."""
    return F.regexp_extract_all(line, F.lit(BARE_PATH), F.lit(0))


def normalize_path(path: Column) -> Column:
    return trim(F.replace(F.regexp_replace(path, "^/+", ""), F.lit("\\"), F.lit("/")))


def block_path(parent: Column, start: Column, end: Column) -> Column:
    return F.concat(parent, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


def decode_block_path(path: Column) -> Column:
    """struct(parent, start_line, end_line), or null where the path names no lines."""
    pattern = r"^(.+):(\d+)-(\d+)$"
    part = lambda i: F.regexp_extract(path, pattern, i)
    start, end = F.try_to_number(part(2), F.lit("999999999")).cast("int"), F.try_to_number(part(3), F.lit("999999999")).cast("int")
    return F.when((part(1) != "") & (start > 0) & (end >= start), F.struct(part(1).alias("parent"), start.alias("start_line"), end.alias("end_line")))


def role_rank(role: Column) -> Column:
    order = ["entrypoint", "readme", "reference", "license", "script", "library", "config"]
    return F.coalesce(*(F.when(role == r, i) for i, r in enumerate(order)), F.lit(len(order)))


def type_rank(kind: Column) -> Column:
    groups = [("markdown", "text"), ("bash", "javascript", "typescript", "python"), ("json", "yaml")]
    return F.coalesce(*(F.when(kind.isin(*g), i) for i, g in enumerate(groups)), F.lit(len(groups)))
