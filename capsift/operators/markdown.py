"""Markdown: fenced blocks, inline code, references.

A task reads each text once (`functions.prose`), with a stack of its block quotes and list items, and gives rows: fences, lines of paragraphs, code spans. Everything behind that is declared on columns.
"""

from __future__ import annotations

from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from capsift.functions import paths, prose

MAX_INLINE = 200
#: Of references to one path on one line the most specific stays.
PRIORITY = {"markdown-link": 3, "url": 3, "inline-code": 2, "import": 2, "source": 2, "bare-path": 1}
#: Rows and characters that leave a task together.
_ROWS, _CHARS = 2000, 1 << 23
_READ = pa.schema([("kind", pa.string()), ("no", pa.int32()), ("line", pa.int32()), ("line_end", pa.int32()), ("paragraph_line", pa.int32()), ("text", pa.string()), ("info", pa.string())])
_SQL = "kind string, no int, line int, line_end int, paragraph_line int, text string, info string"


def _read(kinds: list[str], batches):
    """For each row (keys, content) what its text holds."""
    for b in batches:
        keys, rows, at, size = b.drop_columns(["content"]), [], [], 0

        def out():
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), _READ)]
            return pa.RecordBatch.from_arrays([*keys.take(pa.array(at)).columns, *columns], names=[*keys.schema.names, *_READ.names])

        for i, text in enumerate(b.column("content")):
            count = dict.fromkeys(kinds, 0)
            for kind, line, last, first, found, info in prose.read(text.as_py() or ""):
                if kind in count:
                    rows.append((kind, count[kind], line, last, first, found, info))
                    at.append(i)
                    count[kind] += 1
                    size += len(found)
                    if len(rows) >= _ROWS or size >= _CHARS:
                        yield out()
                        rows, at, size = [], [], 0
        if rows:
            yield out()


def parts(files: DataFrame, *kinds: str) -> DataFrame:
    """files: skill_key, path, content. Returns skill_key, path, and of each `fence`, `line` of a paragraph (its code spans are a space each) and code `span`: kind, no (its number in the file), line, line_end, paragraph_line (the
    first line of its paragraph), text, info."""
    own = files.select("skill_key", "path", "content")
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema if f.name != "content")
    return own.mapInArrow(partial(_read, list(kinds)), f"{keys}, {_SQL}")


def fenced_blocks(files: DataFrame) -> DataFrame:
    """skill_key, path, block_seq, language, content, start_line, end_line, type: fenced blocks that are not blank, without the marks of quotes and items around them; unknown languages are text."""
    out = parts(files, "fence").withColumn("content", F.regexp_replace("text", r"\s+\z", "")).where(paths.trim(F.col("content")) != "")
    language = F.coalesce(paths.fence_type(F.element_at(F.split(paths.trim(F.col("info")), r"\s"), 1)), F.lit("text"))
    return out.select("skill_key", "path", F.col("no").alias("block_seq"), language.alias("language"), "content", F.col("line").alias("start_line"), F.col("line_end").alias("end_line"), F.lit("script").alias("type"))


def inline_blocks(files: DataFrame) -> DataFrame:
    """Inline code that begins with a letter and is not too long, as bash blocks at its paragraph's first line."""
    each = parts(files, "span").withColumn("content", paths.trim(F.col("text"))).where(F.rlike("content", F.lit("^[A-Za-z]")) & (F.length("content") <= MAX_INLINE))
    seq = F.row_number().over(Window.partitionBy("skill_key", "path").orderBy("no")) - 1
    return each.select("skill_key", "path", seq.alias("block_seq"), F.lit("bash").alias("language"), "content", F.col("paragraph_line").alias("start_line"), F.col("paragraph_line").alias("end_line"), F.lit("inline").alias("type"))


def references(files: DataFrame, by_line: bool = False) -> DataFrame:
    """skill_key, path, ref_seq, ref_path, line, via: link destinations, inline code words and bare paths in prose. by_line: at their own line, not their paragraph's first."""
    rows = parts(files, "line", "span")
    text, kind = F.col("text"), F.col("kind")
    link = r"\[[^\]]+\]\(([^)\s]+)[^)]*\)"
    empty = F.array().cast("array<string>")
    links = F.filter(F.transform(F.regexp_extract_all(text, F.lit(link), F.lit(1)), paths.trim), lambda p: (p != "") & ~paths.is_url(p) & ~F.startswith(p, F.lit("#")))
    # the first word of a snippet counts only if it holds a slash or a dot
    used = F.filter(F.split(paths.trim(text), r"\s+"), lambda w, i: ((i > 0) | F.contains(w, F.lit("/")) | F.contains(w, F.lit("."))) & paths.looks_like_path(w) & ~paths.is_url(w))
    masked = F.regexp_replace(text, r"\[[^\]]*\]\([^)]*\)", "")
    bare = F.filter(paths.bare_paths(masked), lambda p: paths.looks_like_path(p) & ~paths.is_url(p))
    tagged = lambda values, via: F.transform(F.coalesce(values, empty), lambda p: F.struct(p.alias("ref_path"), F.lit(via).alias("via"), F.lit(PRIORITY[via]).alias("priority")))
    line = F.col("line") if by_line else F.col("paragraph_line")
    of = F.when(kind == "line", F.concat(tagged(links, "markdown-link"), tagged(bare, "bare-path"))).otherwise(tagged(used, "inline-code"))
    each = rows.select("skill_key", "path", line.alias("line"), F.col("line").alias("at"), F.col("no").alias("part"), F.posexplode(of).alias("no", "r")).select("*", "r.*")
    order = [F.desc("priority"), "at", "part", "no"]
    best = Window.partitionBy("skill_key", "path", "ref_path", "line").orderBy(*order)
    kept = each.withColumn("rank", F.row_number().over(best)).where("rank = 1")
    seq = F.row_number().over(Window.partitionBy("skill_key", "path").orderBy("line", *order)) - 1
    return kept.select("skill_key", "path", seq.alias("ref_seq"), "ref_path", "line", "via")
