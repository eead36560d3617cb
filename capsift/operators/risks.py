"""Risks: findings joined with the permissions that own them, mapped, filtered by policy, linked and deduplicated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from capsift import config as cfg
from capsift.functions import ids, risk, urls
from capsift.operators import rules
from capsift.plans.tables import dealt, large_groups, materialize, numbered

RCE = "NETWORK:remote_code_execution"
REMOTE_WARNING = "Remote script content analysis is NOT_IMPLEMENTED"
_META = "map<string,string>"
_MAPPED = "array<struct<code:string,severity:string,message:string,metadata:map<string,string>>>"
GRAMMARS = ["bash", "javascript", "typescript", "tsx", "python", "markdown"]


def policy(spark: SparkSession, config: dict) -> tuple[DataFrame, DataFrame]:
    """(imports: grammar, name, p_import; domains: host, p_host): verdict `denied` or `allowed` of each listed name; deny beats allow. As large as the config."""
    imports: dict[tuple[str, str], str] = {}
    domains: dict[str, str] = {}
    for field, verdict in (("allowlist", "allowed"), ("denylist", "denied")):
        for grammar, p in config[field]["languages"].items():
            imports.update({(grammar, n): verdict for n in cfg.names(p["imports"])})
        domains.update(dict.fromkeys(cfg.names(config[field]["network"]["domains"]), verdict))
    return (
        spark.createDataFrame([(*k, v) for k, v in imports.items()], "grammar string, name string, p_import string"),
        spark.createDataFrame(list(domains.items()), "host string, p_host string"),
    )


#: Files whose findings and permissions make more pairs than this are joined by bins of lines.
PAIRS = 1_000_000
#: A bin of level k holds 4 ** k lines: a shift by twice the level takes a line to its bin.
BITS = 2


def _at(line: Column, level: Column) -> Column:
    """The bin of a line."""
    return F.call_function("shiftright", line.cast("long"), level * BITS)


def _own_level(first: Column, last: Column) -> Column:
    """The first level whose bins are not shorter than the interval."""
    span = F.greatest(last.cast("long") - first.cast("long") + 1, F.lit(1))
    return F.ceil(F.round(F.log(float(1 << BITS), span.cast("double")), 9)).cast("int")


def _in_bins(df: DataFrame, first: str, last: str, levels: Column) -> DataFrame:
    """df with `level` and `bin`: a row for each bin of these levels that the interval touches; at its own level or above it these are two at most."""
    each = F.transform(levels, lambda k: F.transform(F.sequence(_at(F.col(first), k), _at(F.greatest(last, first), k)), lambda b: F.struct(k.alias("level"), b.alias("bin"))))
    return df.withColumn("b", F.explode(F.flatten(each))).select("*", F.col("b.level").alias("level"), F.col("b.bin").alias("bin")).drop("b")


def overlaps_by_bins(own: DataFrame, refs: DataFrame) -> DataFrame:
    """own: skill_key, file, line, end; refs: skill_key, file, first, last. The pairs whose lines meet, each once.

    Of two intervals that meet, the longer one's own level lists both; the pair counts there only, in the bin where the later of them starts. The one that is at its own level fills a fourth of that bin at least, so few
    pairs are compared that don't meet, and a long interval is listed in few bins of its own size. An interval is listed above its own level only on levels that the other side has intervals of.

    What is listed is many times what the plan knows of, so the joins ask for a sort-merge join: else one side might be broadcast."""
    a = own.where("line is not null and end is not null").withColumn("own_a", _own_level(F.col("line"), F.col("end")))
    b = refs.where("first is not null and last is not null").withColumn("own_b", _own_level(F.col("first"), F.col("last")))
    levels = lambda df, name: F.array(*(F.lit(k) for k in sorted(r[0] for r in df.select(name).distinct().collect()))).cast("array<int>")  # noqa: E731  a few dozen at most
    of_a, of_b = levels(a, "own_a"), levels(b, "own_b")
    keys = ["skill_key", "file", "level", "bin"]
    longer = _in_bins(a, "line", "end", F.array("own_a")).join(_in_bins(b, "first", "last", F.filter(of_a, lambda k: k >= F.col("own_b"))).hint("merge"), keys)
    shorter = _in_bins(a, "line", "end", F.filter(of_b, lambda k: k > F.col("own_a"))).join(_in_bins(b, "first", "last", F.array("own_b")).hint("merge"), keys)
    later = _at(F.greatest("first", "line"), F.col("level"))
    met = longer.unionByName(shorter).where((F.col("first") <= F.col("end")) & (F.col("last") >= F.col("line")) & (F.col("bin") == later))
    return met.drop("level", "bin", "own_a", "own_b")


def meeting(own: DataFrame, refs: DataFrame, pairs: int = PAIRS) -> DataFrame:
    """As overlaps_by_bins(); files with few pairs are joined by file alone."""
    keys = ["skill_key", "file"]
    large = large_groups(own, refs, keys, pairs)
    plain = lambda a: dealt(a, *keys).join(dealt(refs, *keys).hint("merge"), keys).where((F.col("first") <= F.col("end")) & (F.col("last") >= F.col("line")))
    if large is None:
        return plain(own)
    return plain(own.join(large, keys, "left_anti")).unionByName(overlaps_by_bins(own.join(large, keys), refs.join(large, keys)))


def _before(refs: DataFrame) -> DataFrame:
    """refs: skill_key, perm_seq, p, n_refs, file, first, last. The same with `before`, the last line that those of a permission's references to a file reach that start earlier; null for the first."""
    one = refs.where("n_refs = 1").withColumn("before", F.lit(None).cast("int"))
    of_file = Window.partitionBy("skill_key", "perm_seq", "file").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    more = refs.where("n_refs > 1 and first is not null").withColumn("before", F.max("last").over(of_file))
    return one.unionByName(more).drop("n_refs")


def overlapping(found: DataFrame, permissions: DataFrame) -> DataFrame:
    """skill_key, finding_seq and of each permission whose lines meet the finding's: perm_seq, id, tool, scope, args, metadata.

    A permission may meet a finding by many references: it counts by the first, the one before which none reaches the finding's lines. So nothing has to be grouped, and a task holds no rows of pairs."""
    refs = permissions.select("skill_key", F.struct("perm_seq", "id", "tool", "scope", "args", "metadata").alias("p"), "perm_seq", F.size("refs").alias("n_refs"), F.explode("refs").alias("r"))
    refs = refs.select("skill_key", "perm_seq", "p", "n_refs", F.col("r.file").alias("file"), F.col("r.line").alias("first"), F.coalesce("r.line_end", "r.line").alias("last"))
    own = found.select("skill_key", "file", "finding_seq", "line", F.coalesce("line_end", "line").alias("end"))
    return meeting(own, _before(refs)).where("before is null or before < line").select("skill_key", "finding_seq", "p.*")


def owners(met: DataFrame) -> DataFrame:
    """The first permission of each finding: skill_key, finding_seq, owner."""
    return dealt(met, "skill_key", "finding_seq").groupBy("skill_key", "finding_seq").agg(F.min_by(F.struct("perm_seq", "id", "tool", "scope", "args", "metadata"), "perm_seq").alias("owner"))


def with_network_risks(df: DataFrame, metadata: Column, args: Column, name: str) -> DataFrame:
    """df with a column of the risks of a request: writes to or reads from outside, and secrets sent. Step by step: one expression would repeat the host's pattern in each of its parts."""
    own = {k: f"__capsift_{k}" for k in ("metadata", "url", "host", "method", "where", "secret")}
    url, host, method, where = (F.col(own[k]) for k in ("url", "host", "method", "where"))
    each = df.withColumns({own["metadata"]: metadata, own["url"]: risk.request_url(metadata, args)}).withColumns({own["host"]: urls.host(url), own["method"]: risk.request_method(metadata, args)})
    each = each.withColumns({own["where"]: urls.destination(host), own["secret"]: risk.secret_in_request(F.col(own["metadata"]), url)})
    about = F.create_map(F.lit("host"), host, F.lit("method"), method, F.lit("destination"), where, F.lit("url"), urls.clean_url(url))
    entry = lambda code, severity, message: F.struct(code.alias("code"), severity.alias("severity"), message.alias("message"), about.alias("metadata"))
    outside, writes = where == "external", method.isin(risk.WRITE_METHODS)
    either = lambda ok, a, b: F.when(ok, a).otherwise(b)
    # Codes and messages.
    told = either(writes, F.concat(F.lit("Writes data to external host "), host, F.lit(" via "), method), F.concat(F.lit("Reads from external host "), host))
    access = F.when(outside, entry(either(writes, "NETWORK:data_exfiltration", "NETWORK:external_network_access"), either(writes, "critical", "warning"), told))
    sent = entry(either(outside, "NETWORK:credential_leak", "NETWORK:localhost_secret_exposure"), either(outside, "critical", "warning"), F.concat(F.lit("Potential secret transmission detected for "), host))
    found = F.when(host.isNotNull(), F.filter(F.array(access, F.when(F.col(own["secret"]), sent)), lambda r: r.isNotNull())).cast(_MAPPED)
    return each.withColumn(name, found).drop(*own.values())


#: Sets of a package's permissions that a whole category of risks is linked with, and the scopes of each (None: any).
SETS = {"PROMPT": ("all", None), "INJECTION": ("active", ("sys", "net"))}


def _in_sets(scope: Column) -> Column:
    """The names of the sets that a permission of this scope is in."""
    named = [F.lit(name) if scopes is None else F.when(scope.isin(*scopes), name) for name, scopes in SETS.values()]
    return F.array_compact(F.array(*named))


def permission_sets(permissions: DataFrame) -> DataFrame:
    """skill_key, link_set, links (perm_seq and id, in order): each set of a package once."""
    each = permissions.select("skill_key", F.explode(_in_sets(F.col("scope"))).alias("link_set"), F.struct("perm_seq", "id").alias("p"))
    return each.groupBy("skill_key", "link_set").agg(F.array_sort(F.collect_list("p")).alias("links"))


def expand_links(risks: DataFrame, sets: DataFrame) -> DataFrame:
    """risks with the members of their set in `linked`; sets: the output of permission_sets()."""
    return risks.join(sets.hint("merge"), ["skill_key", "link_set"], "left").withColumn("linked", F.coalesce("links", "linked")).select(*risks.columns)


def with_permissions(deduped: DataFrame, sets: DataFrame) -> DataFrame:
    """The output of dedupe() with the ids of a set's members in `permissions`."""
    names = F.array_distinct(F.transform("links", lambda x: x["id"]))
    each = deduped.join(sets.hint("merge"), ["skill_key", "link_set"], "left").withColumn("permissions", F.coalesce(names, "permissions"))
    return each.select(*(c for c in deduped.columns if c != "link_set"))


def link_counts(risks: DataFrame, permissions: DataFrame) -> DataFrame:
    """skill_key, n_risks, n_links: how many risks a package has and how many links to permissions, those of sets counted, not made."""
    members = permissions.select("skill_key", F.explode(_in_sets(F.col("scope"))).alias("link_set")).groupBy("skill_key", "link_set").agg(F.count("*").alias("members"))
    each = risks.groupBy("skill_key", "link_set").agg(F.count("*").alias("n"), F.sum(F.size("linked").cast("long")).alias("own")).join(members, ["skill_key", "link_set"], "left")
    return each.groupBy("skill_key").agg(F.sum("n").alias("n_risks"), F.sum(F.col("own") + F.col("n") * F.coalesce("members", F.lit(0).cast("long"))).alias("n_links"))


def _linked(mapped: DataFrame, met: DataFrame, permissions: DataFrame) -> DataFrame:
    """mapped with permissions by the risk's category: the ids of single ones in `linked`, or the name of a set of the package in `link_set`. Rows without any permission are left out."""
    category = F.substring_index("code", ":", 1)
    rows = mapped.withColumn("category", category).withColumn("link_set", F.lit(None).cast("string"))
    key = ["skill_key", "finding_seq", "k"]
    ids_of = lambda df: df.groupBy(*key).agg(F.array_sort(F.collect_set(F.struct("perm_seq", "id"))).alias("linked"))
    # a prompt is linked with all permissions of its package, an injection with those of sys and net: by name, so no row holds them
    named = F.coalesce(*(F.when(F.col("category") == c, name) for c, (name, _) in SETS.items()))
    present = permissions.select("skill_key", F.explode(_in_sets(F.col("scope"))).alias("link_set")).distinct()
    none = F.array().cast("array<struct<perm_seq:int,id:string>>")
    wide = rows.where(F.col("category").isin(*SETS)).withColumn("link_set", named).join(present.hint("merge"), ["skill_key", "link_set"], "left_semi").withColumn("linked", none)
    owned = rows.where((F.col("category") == "NETWORK") & (F.col("code") != RCE) & F.col("owner").isNotNull()).withColumn("linked", F.array(F.struct(F.col("owner.perm_seq").alias("perm_seq"), F.col("owner.id").alias("id"))))
    rest = rows.where((F.col("code") == RCE) | F.col("category").isin("SECRETS", "DESTRUCTIVE", "PRIVILEGE", "PERSISTENCE"))
    of = lambda *scopes: F.array(*(F.lit(s) for s in scopes))
    wanted = F.when(F.col("category") == "SECRETS", of("env")).when(F.startswith("rule_id", F.lit("fs-")) & (F.col("code") != RCE), of("fs", "sys")).otherwise(of("sys"))
    # narrow rows, dealt by finding: they are joined and grouped in one task's share, and the wide ones come back by key
    finding = ["skill_key", "finding_seq"]
    asked = dealt(rest.select(*key, wanted.alias("wanted")), *finding)
    offered = dealt(met.where(F.col("scope").isin("env", "fs", "sys")).select(*finding, "perm_seq", "id", "scope"), *finding)
    some = ids_of(asked.join(offered.hint("merge"), finding).where(F.array_contains("wanted", F.col("scope"))))
    near = rest.join(some.hint("merge"), key)
    return wide.unionByName(owned).unionByName(near).where("link_set is not null or size(linked) > 0")


def rule_risks(found: DataFrame, permissions: DataFrame, config: dict) -> DataFrame:
    """Risks of findings: skill_key, ord, type, group_key, severity, message, file, line, line_end, ref_type, linked, link_set, metadata."""
    spark = found.sparkSession
    met = materialize(overlapping(found, permissions), "overlaps")
    table = F.broadcast(rules.rule_table(spark).where("risk <> ''").select("rule_id", "grammar", "risk", "severity", "message"))
    each = found.join(table, "rule_id").join(owners(met).hint("merge"), ["skill_key", "finding_seq"], "left")
    static = F.array(F.struct(F.col("risk").alias("code"), "severity", "message", F.col("extracted").alias("metadata"))).cast(_MAPPED)
    # written: a filter that the explode below implies would else repeat the host's expression for each of its uses
    each = materialize(with_network_risks(each, F.coalesce("owner.metadata", F.from_json(F.lit("{}"), _META)), F.col("owner.args"), "dynamic"), "requests")
    each = each.withColumn("mapped", F.when(F.col("risk") != "dynamic", static).otherwise(F.when(F.col("owner").isNotNull(), F.col("dynamic"))))
    each = each.drop("severity", "message", "metadata", "dynamic").select("*", F.posexplode("mapped").alias("k", "m")).select("*", "m.*").drop("mapped", "m")
    imports, domains = policy(spark, config)
    host = F.when(F.startswith("code", F.lit("NETWORK:")), F.lower(F.trim(F.try_element_at("metadata", F.lit("host")))))
    each = each.withColumn("host", host).join(F.broadcast(domains), "host", "left")
    name = F.coalesce(*(F.try_element_at(m, F.lit(k)) for m in (F.col("extracted"), F.col("owner.metadata")) for k in ("import", "module", "package", "dependency")))
    each = each.withColumn("name", F.lower(F.trim(name))).join(F.broadcast(imports), ["grammar", "name"], "left")
    each = each.where("coalesce(p_host, '') <> 'allowed' and coalesce(p_import, '') <> 'allowed'")
    denied = F.when(F.coalesce("p_host", "p_import").isNotNull(), F.create_map(F.lit("policy"), F.to_json(F.struct(F.when(F.col("p_host") == "denied", F.struct("host", F.lit("denylist").alias("source"))).alias("network"), F.when(F.col("p_import") == "denied", F.struct("grammar", "name", F.lit("denylist").alias("source"))).alias("language")))))
    each = each.withColumn("metadata", F.when(denied.isNotNull(), F.map_concat("metadata", denied)).otherwise(F.col("metadata")))
    # five parts of the linking read these rows: written once
    columns = ["skill_key", "finding_seq", "k", "rule_id", "code", "severity", "message", "metadata", "owner", "file", "line", "line_end", "type"]
    each = materialize(each.select(*columns), "mapped")
    linked = _linked(each, met, permissions)
    group = F.concat_ws(":", "code", "owner.tool")
    return linked.select(
        "skill_key", F.array(*(F.col(c).cast("long") for c in ("finding_seq", "k"))).alias("ord"), F.col("code").alias("type"), group.alias("group_key"), "severity", "message", "file", "line", "line_end", F.col("type").alias("ref_type"), "linked", "link_set", "metadata"
    )


def dependency_risks(permissions: DataFrame, config: dict) -> DataFrame:
    """Risks of imports and external references, in the order of permissions."""
    imports, _ = policy(permissions.sparkSession, config)
    dep = permissions.where("scope = 'dep'").withColumn("name", F.trim(F.get("args", 0))).withColumn("grammar", F.when(F.col("tool").isin(GRAMMARS), F.col("tool"))).withColumn("low", F.lower("name"))
    dep = dep.join(F.broadcast(imports.withColumnRenamed("name", "low")), ["grammar", "low"], "left")
    first = F.get("refs", 0)
    where = [F.coalesce(first["file"], F.lit("SKILL.md")).alias("file"), F.coalesce(first["line"], F.lit(1)).alias("line"), first["line_end"].alias("line_end"), F.coalesce(first["type"], F.lit("content")).alias("ref_type")]
    tail = [F.array(F.struct("perm_seq", "id")).alias("linked"), F.lit(None).cast("string").alias("link_set")]
    head = ["skill_key", F.array(F.col("perm_seq").cast("long"), F.lit(0).cast("long")).alias("ord")]
    denied = F.col("p_import") == "denied"
    verdict = F.when(F.col("grammar").isNotNull(), F.create_map(F.lit("policy"), F.to_json(F.struct(F.struct("grammar", F.col("name").alias("importName"), F.when(denied, "denylist").otherwise("default").alias("source")).alias("language")))))
    message = F.when(denied, F.concat(F.lit("Import '"), "name", F.lit("' is denied by config for "), "grammar", F.lit(" and may execute untrusted dependency code."))).otherwise(F.concat(F.lit("External import not explicitly configured: "), "name"))
    imported = dep.where("permission = 'import' and name <> '' and coalesce(p_import, '') <> 'allowed'").select(
        *head, F.lit("DEPENDENCY:external_import").alias("type"), F.concat(F.lit("DEPENDENCY:external_import:"), F.coalesce("grammar", F.lit("unknown"))).alias("group_key"), F.when(denied, "critical").otherwise("warning").alias("severity"), message.alias("message"), *where, *tail, verdict.alias("metadata")
    )
    sourced = F.coalesce(F.try_element_at("metadata", F.lit("discoveryMethod")) == "source", F.lit(False))
    told = F.concat(F.when(sourced, "Sourced external file not analyzed yet: ").otherwise("External reference not analyzed yet: "), F.coalesce(F.get("args", 0), "tool"))
    outside = dep.where("permission = 'externalreference'").select(
        *head, F.lit("REFERENCE:external_file").alias("type"), F.concat(F.lit("REFERENCE:external_file:"), "tool").alias("group_key"), F.lit("warning").alias("severity"), told.alias("message"), *where, *tail, F.when(sourced, F.create_map(F.lit("discoveryMethod"), F.lit("source"))).alias("metadata")
    )
    return imported.unionByName(outside)


def number(dependency: DataFrame, ruled: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """All risks with risk_seq and id: those of dependencies first. of: as that of numbered()."""
    every = dependency.withColumn("phase", F.lit(0)).unionByName(ruled.withColumn("phase", F.lit(1)))
    every = numbered(every, [F.col("phase"), F.col("ord")], "risk_seq", of=of).drop("phase", "ord")
    return every.withColumn("id", ids.risk_id(F.col("type"), F.col("risk_seq")))


def dedupe(risks: DataFrame) -> DataFrame:
    """Of equal type, file and line the first row stays; its permissions are those of all, in order. Equal types have the same set, if any, so its name stays beside them."""
    key = ["skill_key", "type", "file", "line"]
    rest = [c for c in risks.columns if c not in (*key, "linked", "risk_seq")]
    got = risks.groupBy(*key).agg(F.min("risk_seq").alias("risk_seq"), F.min_by(F.struct(*rest), "risk_seq").alias("s"), F.array_sort(F.collect_list(F.struct("risk_seq", "linked"))).alias("all"))
    names = F.array_distinct(F.transform(F.flatten(F.transform("all", lambda x: x["linked"])), lambda x: x["id"]))
    return got.select(*key, "risk_seq", "s.*", names.alias("permissions"))


def back_links(risks: DataFrame) -> DataFrame:
    """risks before dedupe. skill_key, perm_seq, risks: the ids of each permission's risks, in order. Links by sets are not among them, see with_risks()."""
    return _own_risks(risks).select("skill_key", "perm_seq", F.transform("own", lambda x: x["id"]).alias("risks"))


def _own_risks(risks: DataFrame) -> DataFrame:
    each = risks.select("skill_key", "risk_seq", "id", F.explode("linked").alias("p"))
    return each.groupBy("skill_key", F.col("p.perm_seq").alias("perm_seq")).agg(F.array_sort(F.collect_set(F.struct("risk_seq", "id"))).alias("own"))


def risk_sets(risks: DataFrame) -> DataFrame:
    """risks before dedupe. skill_key and of each set its risks (risk_seq and id, in order): once a package."""
    listed = lambda name: F.array_sort(F.collect_list(F.when(F.col("link_set") == name, F.struct("risk_seq", "id")))).alias(f"of_{name}")
    return risks.where("link_set is not null").groupBy("skill_key").agg(*(listed(name) for name, _ in SETS.values()))


def with_own_risks(permissions: DataFrame, risks: DataFrame) -> DataFrame:
    """permissions with `own`: the risks that are linked with single permissions."""
    return permissions.join(_own_risks(risks).hint("merge"), ["skill_key", "perm_seq"], "left")


def with_risks(permissions: DataFrame, sets: DataFrame) -> DataFrame:
    """The output of with_own_risks() with the ids of all its risks, those of its sets too, in order. sets: the output of risk_sets()."""
    none = F.array().cast("array<struct<risk_seq:int,id:string>>")
    parts = [F.when(F.array_contains(_in_sets(F.col("scope")), name), F.col(f"of_{name}")) for name, _ in SETS.values()]
    every = F.sort_array(F.concat(*(F.coalesce(p, none) for p in (F.col("own"), *parts))))
    # told apart by id: structs would be compared each with each
    each = permissions.join(sets.hint("merge"), "skill_key", "left").withColumn("risks", F.array_distinct(F.transform(every, lambda x: x["id"])))
    return each.select(*(c for c in permissions.columns if c != "own"), "risks")


def remote_warnings(risks: DataFrame) -> DataFrame:
    """Packages that pipe remote content to a shell: skill_key, message."""
    return risks.where(F.col("type") == RCE).select("skill_key").distinct().withColumn("message", F.lit(REMOTE_WARNING))
