"""Permissions: what a package asks for and what its files do, merged by id."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capsift import config as cfg
from capsift.functions import ids, paths, shell
from capsift.operators import rules
from capsift.plans.tables import fan_out, materialize, numbered

_REF = "struct<file:string,line:int,line_end:int,type:string>"
_META = "map<string,string>"
#: Scalar columns of a permission; of equal ids the first row's stay.
SCALARS = ["tool", "scope", "permission", "args", "file_role", "metadata", "source", "comment"]
TARGET = ["skill_key", "queue_seq", "target_seq"]


def scan_targets(queue: DataFrame, files: DataFrame) -> DataFrame:
    """TARGET, file, file_type, role, content, line_offset, type: whole files, fenced slices and inline commands of local queue entries."""
    local = queue.where((F.col("source_type") == "local") & F.col("file_type").isin(paths.SCANNED_TYPES))
    text = files.select("skill_key", F.col("path").alias("file"), F.col("content").alias("whole")).where("whole <> ''")
    base = ["skill_key", "queue_seq", "file_type", "role"]
    plain = local.where("via is null or via <> 'code-block'").withColumn("file", F.col("path")).join(text, ["skill_key", "file"])
    plain = plain.select(*base, F.lit(0).alias("target_seq"), "file", F.col("whole").alias("content"), F.lit(0).alias("line_offset"), F.lit("content").alias("type"))
    coded = local.where("via = 'code-block'").withColumn("at", paths.decode_block_path(F.col("path"))).where("at is not null").withColumn("file", F.col("at.parent")).join(text, ["skill_key", "file"])
    lines = F.split("whole", "\n")
    cut = F.array_join(F.slice(lines, F.col("at.start_line"), F.col("at.end_line") - F.col("at.start_line") + 1), "\n")
    # a fence in quotes is read without their marks: as many on each line as stand before the fence
    before = F.regexp_extract(cut, r"\A(?:[ \t]*(?:>|[-+*](?=[ \t])|[0-9]{1,9}[.)](?=[ \t])))+", 0)
    marks = F.length(before) - F.length(F.replace(before, F.lit(">"), F.lit("")))
    cut = F.when(marks == 0, F.substring(cut, F.length(before) + 1, F.length(cut))).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(marks, F.lit(1))), F.substring(cut, F.length(before) + 1, F.length(cut)), lambda s, _: F.regexp_replace(s, r"(?<=\n)[ \t]*>[ ]?", "")))
    fenced = coded.where("ref_type <> 'inline'").withColumn("content", cut).where(paths.trim(F.col("content")) != "")
    fenced = fenced.select(*base, F.lit(0).alias("target_seq"), "file", "content", (F.col("at.start_line") - 1).alias("line_offset"), F.lit("script").alias("type"))
    line = F.coalesce(F.get(lines, F.col("at.start_line") - 1), F.lit(""))
    spans = coded.where("ref_type = 'inline'").select(*base, "file", (F.col("at.start_line") - 1).alias("line_offset"), line.alias("line_text"), F.posexplode(shell.inline_snippets(line)).alias("target_seq", "snippet"))
    inline = rules.inline_commands(spans, TARGET).select(*base, "target_seq", "file", F.col("snippet").alias("content"), "line_offset", F.lit("inline").alias("type"))
    return plain.unionByName(fenced).unionByName(inline)


def findings(targets: DataFrame) -> DataFrame:
    """skill_key, finding_seq, queue_seq, rule_id, file, line, line_end, type, role, extracted: matches of all rules, in the order of queue, target, rule, pattern and place.

    Equal contents are matched once, whatever package, file or block they stand in: a content is named by its SHA-256 and its length, and what is found in it goes to all targets that hold it."""
    grammar = F.when(F.col("file_type").isin("javascript", "typescript"), "javascript").when(F.col("file_type").isin("bash", "python"), F.col("file_type"))
    named = targets.withColumn("text_key", F.concat_ws(":", F.sha2("content", 256), F.octet_length("content").cast("string"))).withColumn("scans", F.array_compact(F.array(grammar, F.when(F.col("type") == "content", "prompt"))))
    holders = materialize(named.drop("content").withColumn("scan", F.explode("scans")).drop("scans"), "holders")
    texts = materialize(named.groupBy("text_key").agg(F.any_value("content").alias("content"), F.array_distinct(F.flatten(F.collect_set("scans"))).alias("scans")), "texts")
    of = lambda scan: texts.where(F.array_contains("scans", F.lit(scan))).select("text_key", "content")
    key = ["text_key"]
    found = [
        rules.shell_matches(of("bash"), key).withColumns({"scan": F.lit("bash"), "phase": F.lit(0)}),
        *(rules.code_matches(of(g), key, g).withColumns({"scan": F.lit(g), "phase": F.lit(0)}) for g in ("javascript", "python")),
        rules.prompt_matches(of("prompt"), key).withColumns({"scan": F.lit("prompt"), "phase": F.lit(1)}),
    ]
    matches = materialize(reduce(DataFrame.unionByName, found), "matches")
    counts = holders.groupBy("text_key", "scan").agg(F.count("*").alias("n"))
    every = fan_out(holders, matches, counts, ["text_key", "scan"], TARGET)
    order = [F.col(c) for c in ("queue_seq", "target_seq", "phase", "rule_seq", "pattern_seq", "line", "cmd_seq")]
    end = F.when(F.col("phase") == 0, F.coalesce("line_end", "line") + F.col("line_offset")).cast("int")
    return numbered(every, order, "finding_seq").select(
        "skill_key", "finding_seq", "queue_seq", "rule_id", "file", (F.col("line") + F.col("line_offset")).cast("int").alias("line"), end.alias("line_end"), "type", "role", "extracted"
    )


def _reference(file: Column, line: Column, line_end: Column, kind: Column) -> Column:
    return F.struct(file.alias("file"), line.cast("int").alias("line"), line_end.cast("int").alias("line_end"), kind.alias("type")).cast(_REF)


def _row(df: DataFrame, order: list[Column], **columns: Column) -> DataFrame:
    """skill_key, ord, id, SCALARS, ref."""
    null = F.lit(None)
    values = {"file_role": null.cast("string"), "metadata": null.cast(_META), "comment": null.cast("string")} | columns
    return df.select("skill_key", F.array(*(o.cast("long") for o in order)).alias("ord"), values["id"].alias("id"), *(values[c].alias(c) for c in SCALARS), values["ref"].alias("ref"))


def grants(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in cfg.TOOL_GRANTS.items()], "name string, g_tool string, g_scope string, g_permission string")


def from_allowed_tools(frontmatter: DataFrame) -> DataFrame:
    """frontmatter: skill_key, path, allowed_tools, end_line. Unknown tools are shell tools of their own name."""
    each = frontmatter.where(paths.trim(F.coalesce("allowed_tools", F.lit(""))) != "").select("skill_key", "path", "end_line", F.posexplode(shell.allowed_tools(F.col("allowed_tools"))).alias("no", "t"))
    each = each.select("*", F.col("t.name").alias("name"), F.col("t.args").alias("args")).join(F.broadcast(grants(frontmatter.sparkSession)), "name", "left")
    tool = F.coalesce("g_tool", F.lower("name"))
    return _row(
        each, [F.lit(0), F.lit(0), F.col("no")], id=ids.permission_id(tool, F.col("args")), tool=tool, scope=F.coalesce("g_scope", F.lit("sys")), permission=F.coalesce("g_permission", F.lit("shell")), args=F.col("args"),
        source=F.lit("frontmatter"), ref=_reference(F.col("path"), F.lit(1), F.col("end_line"), F.lit("frontmatter")),
    )


def from_findings(found: DataFrame) -> DataFrame:
    """A permission for each finding of a rule that has one."""
    table = F.broadcast(rules.rule_table(found.sparkSession).where("grammar <> 'prompt'").select("rule_id", F.col("tool").alias("r_tool"), "permission", "scope"))
    each = found.join(table, "rule_id")
    tool = F.when(F.col("r_tool") == "detected", F.lower(F.try_element_at("extracted", F.lit("tool")))).otherwise(F.col("r_tool"))
    each = each.withColumn("tool", tool).where("tool is not null").withColumn("found_args", shell.permission_args(F.col("extracted"), F.col("tool")))
    args = F.when(F.size("found_args") > 0, F.col("found_args")).otherwise(F.array(F.lit("*")))
    return _row(
        each, [F.lit(1), F.col("queue_seq"), F.col("finding_seq")], id=ids.permission_id(F.col("tool"), args, F.col("extracted")), tool=F.col("tool"), scope=F.col("scope"), permission=F.col("permission"), args=args,
        file_role=F.col("role"), metadata=F.col("extracted"), source=F.lit("detected"), ref=_reference(F.col("file"), F.col("line"), F.col("line_end"), F.col("type")),
    )


def from_externals(queue: DataFrame) -> DataFrame:
    """Host paths, imports and external references of the queue; of equal ids the first."""
    outside = queue.where("source_type = 'external'")
    path, kind = F.col("path"), F.coalesce("file_type", F.lit("unknown"))
    order = [F.lit(1), F.col("queue_seq"), F.lit(0)]
    ref = _reference(F.coalesce("ref_file", "path"), F.coalesce("ref_line", F.lit(1)), F.col("ref_line_end"), F.coalesce("ref_type", F.lit("content")))
    meta = F.map_filter(F.create_map(F.lit("language"), kind, F.lit("discoveryMethod"), F.col("via")), lambda k, v: v.isNotNull())
    host = _row(
        outside.where("role = 'host-fs'"), order, id=ids.permission_id(F.lit("read"), F.array(path)), tool=F.lit("read"), scope=F.lit("fs"), permission=F.lit("read"), args=F.array(path), source=F.lit("inferred"),
        comment=F.concat(F.lit("Host filesystem access: "), path), ref=_reference(F.coalesce("ref_file", F.lit("SKILL.md")), F.coalesce("ref_line", F.lit(1)), F.lit(None), F.lit("content")),
    )
    dep = lambda rows, name, what: _row(rows, order, id=ids.permission_id(F.lit(name), F.array(kind, path)), tool=kind, scope=F.lit("dep"), permission=F.lit(what), args=F.array(path), metadata=meta, source=F.lit("inferred"), ref=ref)
    imports = dep(outside.where("role <> 'host-fs' and via = 'import'"), "dep-import", "import")
    others = dep(outside.where("role <> 'host-fs' and via <> 'import'"), "dep-externalreference", "externalreference")
    every = host.unionByName(imports).unionByName(others)
    rest = [c for c in every.columns if c not in ("skill_key", "id")]
    first = every.groupBy("skill_key", "id").agg(F.min_by(F.struct(*rest), "ord").alias("first"))
    return first.select("skill_key", "id", "first.*").select(*every.columns)


def merge(rows: DataFrame) -> DataFrame:
    """rows: skill_key, ord, id, SCALARS, ref. One row for each id: the first row's scalars, all references once in order; perm_seq numbers them by first appearance."""
    keyed = rows.withColumn("ref_key", F.concat_ws(":", "ref.file", F.col("ref.line").cast("string"), F.coalesce("ref.line_end", "ref.line").cast("string"), "ref.type"))
    refs = keyed.groupBy("skill_key", "id", "ref_key").agg(F.min_by("ref", "ord").alias("ref"), F.min("ord").alias("ord"), F.min_by(F.struct(*SCALARS), "ord").alias("s"))
    got = refs.groupBy("skill_key", "id").agg(F.min_by("s", "ord").alias("s"), F.min("ord").alias("ord"), F.array_sort(F.collect_list(F.struct("ord", "ref_key", "ref"))).alias("all"))
    return numbered(got, [F.col("ord"), F.col("id")], "perm_seq", of=rows).select("skill_key", "perm_seq", "id", "s.*", F.transform("all", lambda x: x["ref"]).alias("refs"))


def unsupported(queue: DataFrame) -> DataFrame:
    """Local queue entries of types that are not scanned: skill_key, path, message."""
    rest = queue.where((F.col("source_type") == "local") & ~F.col("file_type").isin(paths.SCANNED_TYPES))
    return rest.select("skill_key", "path", F.concat(F.lit("File type '"), "file_type", F.lit("' is not supported yet for analysis: "), "path").alias("message"))


def skipped(queue: DataFrame) -> DataFrame:
    """Queue entries that are not scanned: skill_key, path, reason, queue_seq. Host paths are permissions and not skipped."""
    library = (F.col("via") == "import") | (F.col("role") == "library")
    # The reasons.
    outside = F.when(F.col("role") == "host-fs", None).when(library, "external_library_dependency").otherwise("external_reference")
    unread = F.when(~F.col("file_type").isin(paths.SCANNED_TYPES), F.concat(F.lit("unsupported_type_"), "file_type"))
    reason = F.when(F.col("source_type") == "external", outside).otherwise(unread)
    return queue.select("skill_key", "path", reason.alias("reason"), "queue_seq").where("reason is not null")


def unknown_fields(frontmatter: DataFrame) -> DataFrame:
    """frontmatter: skill_key, keys. The fields that are not known: skill_key, field."""
    known = F.array(*(F.lit(k) for k in cfg.KNOWN_FIELDS))
    return frontmatter.select("skill_key", F.explode(F.array_except("keys", known)).alias("field"))
