"""Which files a package's entry file reaches: references of all blocks, then a bounded breadth-first closure.

The references of every file are extracted and resolved (a file's path contains the reference) once; the closure then works on a narrow table of links. Each round joins the frontier with
its links, drops what earlier rounds have found and keeps the first of equals.
There are as many rounds as the depth bound and one; each is written down, so cycles end and lost executors cost little.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capsift.functions import paths
from capsift.operators import commands, markdown
from capsift.plans.tables import dealt, fan_out, large_groups, materialize, numbered

_CHAIN = "array<struct<file:string,line:int,line_end:int,type:string>>"
FOUND = ["skill_key", "path", "source_type", "file_type", "role", "depth", "via", "ref_file", "ref_line", "ref_line_end", "ref_type", "ref_chain"]


def entry_files(files: DataFrame) -> DataFrame:
    """skill_key, path: the first root file named skill.md, whatever its case."""
    roots = files.where(F.lower("path") == "skill.md")
    return roots.groupBy("skill_key").agg(F.min_by("path", F.struct("list_seq", "path")).alias("path"))


def blocks(files: DataFrame) -> DataFrame:
    """skill_key, path, block_seq, language, content, start_line, end_line, type: fenced, inline, and last each file as a whole (start_line 0)."""
    kind = paths.file_type(F.col("path"))
    scanned = files.where(F.col("content").isNotNull() & (F.col("content") != "") & kind.isin(paths.SCANNED_TYPES))
    prose = scanned.where(kind.isin("markdown", "text"))
    inline = markdown.inline_blocks(prose).withColumn("block_seq", F.col("block_seq") + 1_000_000)
    whole = scanned.select("skill_key", "path", F.lit(2_000_000_000).alias("block_seq"), kind.alias("language"), "content", F.lit(0).alias("start_line"), F.size(F.split("content", "\n")).alias("end_line"), F.lit("content").alias("type"))
    return markdown.fenced_blocks(prose).unionByName(inline).unionByName(whole)


def references(blocks_: DataFrame) -> DataFrame:
    """All references of blocks, with the block's columns: ref_seq, ref_path (normalised), line (of the file), via."""
    keys = ["skill_key", "path", "block_seq"]
    of = lambda *kinds: blocks_.where(F.col("language").isin(*kinds)).select(*keys, "content")
    prose = of("markdown", "text").withColumn("path", F.struct("path", "block_seq")).drop("block_seq")
    found = [
        markdown.references(prose).withColumn("block_seq", F.col("path.block_seq")).withColumn("path", F.col("path.path")).select(*keys, "ref_seq", "ref_path", "line", "via"),
        commands.shell_references(of("bash"), keys),
        commands.python_references(of("python"), keys),
        commands.script_references(of("javascript", "typescript"), keys),
    ]
    every = reduce(DataFrame.unionByName, found)
    about = blocks_.select(*keys, "language", "start_line", "end_line", "type")
    line = (F.col("line") + F.col("start_line") - 1).cast("int")
    return every.join(about, keys).select(*keys, "language", "type", "ref_seq", paths.normalize_path(F.col("ref_path")).alias("ref_path"), line.alias("line"), "via").where("ref_path <> ''")


def classify(refs: DataFrame) -> DataFrame:
    """What a reference that no file answers is: source_type, file_type and role; role null where it is dropped."""
    path, via = F.col("ref_path"), F.col("via")
    role = F.when(paths.is_host_path(path), "host-fs").when(paths.is_url(path) | (via == "markdown-link"), "regular").when(via.isin("import", "source"), "library")
    kind = F.when(role == "library", F.col("language")).otherwise("unknown")
    return refs.withColumns({"source_type": F.lit("external"), "file_type": kind, "role": role})


#: Packages whose references and files make more pairs than this are resolved by grams.
PAIRS = 1_000_000
#: The length of a gram. A reference that is shorter is one gram of its own length.
GRAM = 4


def _grams(text: str, size: Column) -> Column:
    """The distinct substrings of a length."""
    at = F.sequence(F.lit(1), F.length(text) - size + 1)
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(at, lambda i: F.substring(text, i, size)))).otherwise(F.array().cast("array<string>"))


def contained_by_grams(refs: DataFrame, listed: DataFrame) -> DataFrame:
    """refs: skill_key, ref_path, each once; listed: skill_key, file, list_seq. The pairs of which the file contains the reference, by an inverted index.

    Each path is listed under its grams. A path that contains a reference has all its grams, so a reference is looked up under the one that the fewest of the package's paths have, and each path there is compared
    with it. A gram of many paths is dealt over several tasks."""
    length = F.least(F.length("ref_path"), F.lit(GRAM))
    asked = refs.where(F.length("ref_path") > 0).withColumn("size", length)
    sizes = asked.groupBy("skill_key").agg(F.collect_set("size").alias("sizes"))  # four at most
    index = listed.join(sizes, "skill_key").withColumn("size", F.explode("sizes")).select("skill_key", "file", "list_seq", F.explode(_grams("file", F.col("size"))).alias("gram"))
    index = materialize(index, "grams")
    counts = materialize(index.groupBy("skill_key", "gram").agg(F.count("*").alias("n")), "gram_counts")
    own = asked.select("skill_key", "ref_path", F.explode(_grams("ref_path", F.col("size"))).alias("gram"))
    # a gram that no path has: no path contains the reference
    rated = own.join(counts, ["skill_key", "gram"], "left").groupBy("skill_key", "ref_path").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.min(F.col("n").isNotNull()).alias("known"))
    lookups = materialize(rated.where("known").drop("known"), "lookups")
    found = fan_out(index, lookups, counts.join(lookups.select("skill_key", "gram").distinct(), ["skill_key", "gram"]), ["skill_key", "gram"], ["file"])
    return found.where(F.contains("file", "ref_path")).select("skill_key", "ref_path", "file", "list_seq")


def contained(refs: DataFrame, listed: DataFrame, pairs: int = PAIRS) -> DataFrame:
    """As contained_by_grams(). Small packages, whose references meet all their files in one task, are joined by containment alone."""
    large = large_groups(refs, listed, ["skill_key"], pairs)
    few, many = (refs, None) if large is None else (refs.join(large, "skill_key", "left_anti"), refs.join(large, "skill_key"))
    met = few.join(listed, "skill_key").where(F.contains("file", "ref_path")).select("skill_key", "ref_path", "file", "list_seq")
    return met if many is None else met.unionByName(contained_by_grams(many, listed))


def edges(files: DataFrame, every: DataFrame) -> DataFrame:
    """What each file leads to, resolved once for all rounds: skill_key, path (the file), ref_path (null for a block of its own), new, source_type, file_type and role (null for a file: its path has them), via, at, ord2 (its place in
    the file)."""
    refs = materialize(dealt(references(every), "skill_key", "path", "ref_path"), "refs")
    listed = files.select("skill_key", F.col("path").alias("file"), "list_seq")
    at = F.struct(F.col("path").alias("file"), F.col("line").cast("int").alias("line"), F.lit(None).cast("int").alias("line_end"), F.col("type").alias("type"))
    place = lambda kind, ref, file: F.array(*(F.lit(x).cast("long") if isinstance(x, int) else F.col(x).cast("long") for x in ("block_seq", kind, ref, file)))
    asked = refs.withColumn("at", at).join(entry_files(files).select("skill_key", F.col("path").alias("ref_path")), ["skill_key", "ref_path"], "left_anti")
    # each reference is looked up once, however often it is made
    answers = materialize(contained(materialize(asked.select("skill_key", "ref_path").distinct(), "asked"), listed), "answers")
    columns = ["skill_key", "path", "ref_path", "new", "source_type", "file_type", "role", "via", "at", "ord2"]
    none = F.lit(None).cast("string")
    local = asked.join(answers.hint("merge"), ["skill_key", "ref_path"]).withColumns({"new": F.col("file"), "source_type": F.lit("local"), "file_type": none, "role": none, "ord2": place(0, "ref_seq", "list_seq")})
    unanswered = classify(asked.join(answers, ["skill_key", "ref_path"], "left_anti")).where("role is not null").withColumns({"new": F.col("ref_path"), "ord2": place(0, "ref_seq", 0)})
    name = F.when(F.col("type") == "content", F.col("path")).otherwise(paths.block_path(F.col("path"), F.col("start_line"), F.col("end_line")))
    whole = F.struct(F.col("path").alias("file"), F.col("start_line").alias("line"), F.col("end_line").alias("line_end"), "type")
    own = every.drop("content").withColumns({"ref_path": F.lit(None).cast("string"), "new": name, "source_type": F.lit("local"), "file_type": F.col("language"), "role": F.lit("script"), "via": F.lit("code-block"), "at": whole, "ord2": place(1, 0, 0)})
    return local.select(*columns).unionByName(unanswered.select(*columns)).unionByName(own.select(*columns))


def closure(files: DataFrame, max_depth: int = 5) -> DataFrame:
    """files: skill_key, path, content, list_seq. Returns FOUND and discovery_seq: local files, external references and code blocks, each path once in a package, by the order of discovery."""
    links = materialize(edges(files, materialize(blocks(files), "blocks")), "edges")
    frontier = entry_files(files).select("skill_key", "path", F.array().cast("array<bigint>").alias("order"), F.array().cast(_CHAIN).alias("chain"))
    found = links.select("skill_key", "path").limit(0)
    rounds = []
    for depth in range(max_depth + 1):
        known = lambda name: found.select("skill_key", F.col("path").alias(name))  # noqa: B023, E731
        new = frontier.join(links, ["skill_key", "path"]).join(known("ref_path"), ["skill_key", "ref_path"], "left_anti").join(known("new"), ["skill_key", "new"], "left_anti")
        # the places on the way from the entry file, as many in each row of a round: in this order files are discovered
        new = new.withColumn("order", F.concat("order", "ord2"))
        first = new.groupBy("skill_key", "new").agg(F.min("order").alias("order"), F.min_by(F.struct("source_type", "file_type", "role", "via", "at", "chain"), "order").alias("s"))
        # files are far fewer than the links that lead to them
        kind, role = F.coalesce("file_type", paths.file_type(F.col("new"))), F.coalesce("role", paths.file_role(F.col("new")))
        step = first.select("skill_key", "new", "order", "s.*").select(
            "skill_key", F.col("new").alias("path"), "source_type", kind.alias("file_type"), role.alias("role"), F.lit(depth + 1).alias("depth"), "via",
            F.col("at.file").alias("ref_file"), F.col("at.line").alias("ref_line"), F.col("at.line_end").alias("ref_line_end"), F.col("at.type").alias("ref_type"), F.concat(F.array("at"), "chain").cast(_CHAIN).alias("ref_chain"), "order",
        )
        step = materialize(step, f"round{depth}")
        rounds.append(step)
        found = reduce(DataFrame.unionByName, rounds).select("skill_key", "path")
        frontier = step.where("source_type = 'local' and via <> 'code-block'").select("skill_key", "path", "order", F.col("ref_chain").alias("chain"))
        if depth < max_depth and frontier.isEmpty():
            break
    every = reduce(DataFrame.unionByName, rounds)
    return numbered(every, [F.col("depth"), F.col("order")], "discovery_seq").select(*FOUND, "discovery_seq")


def scan_queue(found: DataFrame, files: DataFrame, max_size: float, max_count: int) -> tuple[DataFrame, DataFrame]:
    """(queue with queue_seq, skipped with reason): by role, type and discovery; binary and too large files go first, then what exceeds the count."""
    entry = entry_files(files).select(
        "skill_key", "path", F.lit("local").alias("source_type"), paths.file_type(F.col("path")).alias("file_type"), F.lit("entrypoint").alias("role"), F.lit(0).alias("depth"), *(F.lit(None).cast("string").alias(c) for c in ("via", "ref_file")),
        *(F.lit(None).cast("int").alias(c) for c in ("ref_line", "ref_line_end")), F.lit(None).cast("string").alias("ref_type"), F.array().cast(_CHAIN).alias("ref_chain"), F.lit(2_000_000_000).alias("discovery_seq"),
    )
    about = files.select("skill_key", "path", "size", "content_type")
    every = found.select(*FOUND, "discovery_seq").unionByName(entry).join(about, ["skill_key", "path"], "left")
    reason = F.when(F.col("content_type") == "binary", "binary").when(F.coalesce("size", F.lit(0)) > max_size, "too_large")
    order = [paths.role_rank(F.col("role")), paths.type_rank(F.col("file_type")), F.col("discovery_seq")]
    ranked = numbered(every.withColumn("reason", reason), order, "place", {"accepted": F.when(F.col("reason").isNull(), 1).otherwise(0)}, of=found)
    # written: both parts read it
    ranked = materialize(ranked.withColumn("reason", F.coalesce("reason", F.when(F.col("accepted") > max_count, "too_many"))), "ranked")
    return ranked.where("reason is null").select(*FOUND, F.col("place").alias("queue_seq")), ranked.where("reason is not null").select("skill_key", "path", "reason", F.col("place").alias("queue_seq"))
