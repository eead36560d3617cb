"""Mixing sources to target weights by hierarchical budgeting, in DataFrame functions only.

The sources form a tree: domain, language, source. A node's capacity is what its documents hold times the most
epochs. The total budget flows from the root down: each node shares its budget among its children by weight, and
where a child's share exceeds its capacity, the rest goes to its siblings by weight; only what a whole
subtree can't hold goes to the siblings of its ancestor, since that subtree's capacity has bounded its budget before.
All of it is integer arithmetic; shares are rounded down.

A leaf with budget b and supply s takes whole epochs while b lasts, and of the next one a prefix:
documents in the order of a hash of seed, epoch and document, the last one cut to the tokens that are left.
The cut is found by descent over the hash's digits, so no task sorts a whole source.

Tokens are words here. Defined cases: a null language or source counts as "unknown"; texts without a word (null, empty) have no
tokens and are never taken; a leaf without documents leaves its share to its siblings, a weight of 0 or below or null takes
nothing; rows equal in id and text take equal parts of what is left where the cut falls on them; an empty table gives
no rows; other columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from capsift.llm import common

SEED = 42
MAX_EPOCHS = 4
#: Weights of the query and the pipeline: of a domain, of a language within it; sources of one language weigh alike.
DOMAIN_WEIGHTS = {"web": 3, "curated": 1}
LANG_WEIGHTS = {"en": 2}
_LEVELS = ["domain", "lang", "source"]
_OWN = "__capsift_mix"
#: Hex digits of the hash that each descent fixes: 256 sums for a leaf.
_DIGITS = 2


def _share(nodes: DataFrame, parent: list[str], budget: str = "budget") -> DataFrame:
    """nodes: parent's columns, its budget, and of each child name, capacity and weight. Adds `share`."""
    big = lambda c: F.col(c).cast("decimal(38,0)")
    of = Window.partitionBy(*parent)
    order = of.orderBy(F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")).otherwise(F.lit(0.0)), "name")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    df = nodes.withColumn("weight", F.greatest(F.coalesce("weight", F.lit(0)), F.lit(0))).withColumn("capacity", F.when(F.col("weight") > 0, F.col("capacity")).otherwise(0).cast("long"))
    df = df.withColumn("held", F.coalesce(F.sum("capacity").over(before), F.lit(0))).withColumn("weights", F.sum("weight").over(of) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    full = (big(budget) - big("held")) * F.col("weight") >= big("capacity") * F.col("weights")
    df = df.withColumn("full", full)
    open_held = F.min(F.when(~F.col("full"), F.col("held"))).over(of)
    open_weights = F.max(F.when(~F.col("full"), F.col("weights"))).over(of)
    df = df.withColumn("open_held", open_held).withColumn("open_weights", open_weights)
    part = F.call_function("div", (big(budget) - big("open_held")) * F.col("weight"), big("open_weights"))  # whole numbers throughout
    return df.withColumn("share", F.when(F.col("full"), F.col("capacity")).otherwise(part).cast("long")).drop("held", "weights", "full", "open_held", "open_weights")


def budgets(leaves: DataFrame, total: int | None = None, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """leaves: domain, lang, source, supply (tokens), w_domain, w_lang, w_source (whole numbers, equal throughout a node). Adds `budget`. total: all the supply by default."""
    cap = leaves.withColumn("capacity", F.when((F.col("w_domain") > 0) & (F.col("w_lang") > 0) & (F.col("w_source") > 0), F.col("supply") * max_epochs).otherwise(0).cast("long"))
    root = cap.groupBy("domain").agg(F.sum("capacity").alias("capacity"), F.max("w_domain").alias("weight"), F.sum("supply").alias("supply"))
    every = F.lit(total).cast("long") if total is not None else F.sum("supply").over(Window.partitionBy("one"))
    root = _share(root.withColumn("one", F.lit(0)).withColumn("budget", every).withColumn("name", F.col("domain")), ["one"])
    langs = cap.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity"), F.max("w_lang").alias("weight"))
    langs = _share(langs.join(root.select("domain", F.col("share").alias("budget")), "domain").withColumn("name", F.col("lang")), ["domain"])
    own = cap.withColumn("weight", F.col("w_source")).join(langs.select("domain", "lang", F.col("share").alias("budget")), ["domain", "lang"])
    return _share(own.withColumn("name", F.col("source")), ["domain", "lang"]).select(*_LEVELS, "supply", F.col("share").alias("budget"))


def _order_key(seed: int, epoch: Column, id_: Column, digest: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(id_.cast("string"), F.lit("")), digest))


def _cuts(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows: leaf, key, n. plan: leaf, rest (tokens of the last epoch's prefix). Returns leaf, cut (the key where the prefix ends), cut_take (what each row with it gives)."""
    rows = common.materialize(rows, "keys")
    by_leaf = Window.partitionBy(*_LEVELS)
    at = plan.select(*_LEVELS, F.lit("").alias("prefix"), "rest")
    for depth in (_DIGITS, 2 * _DIGITS):
        sums = rows.join(at, _LEVELS).where(F.startswith("key", "prefix")).groupBy(*_LEVELS, "rest", F.substring("key", 1, depth).alias("prefix")).agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(by_leaf.orderBy("prefix"))
        found = sums.withColumn("upto", upto).where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("n") <= F.col("rest")))
        at = common.materialize(found.select(*_LEVELS, "prefix", (F.col("rest") - F.col("upto") + F.col("n")).alias("rest")), "cut")
    last = rows.join(at, _LEVELS).where(F.startswith("key", "prefix")).groupBy(*_LEVELS, "rest", "key").agg(F.sum("n").alias("n"), F.count("*").alias("many"))
    last = last.withColumn("upto", F.sum("n").over(by_leaf.orderBy("key"))).where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("n") <= F.col("rest")))
    return last.select(*_LEVELS, F.col("key").alias("cut"), F.floor((F.col("rest") - F.col("upto") + F.col("n")) / F.col("many")).cast("long").alias("cut_take"))


def mix(docs: DataFrame, domain: Column, w_domain: Column, w_lang: Column, w_source: Column, total: int | None = None, seed: int = SEED, max_epochs: int = MAX_EPOCHS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The columns of docs and a struct `__capsift_mix`: domain, lang, source, n_tokens, epoch (from 1), taken (tokens), a row for each document and epoch that takes any.

    domain: of the columns of docs. The weights: whole numbers, of the columns domain, lang and source of a leaf.
    """
    known = lambda c: F.coalesce(c, F.lit("unknown"))
    leaf = {"domain": known(domain), "lang": known(F.col(lang_col)), "source": known(F.col(source_col))}
    n = common.count_words(F.col(text_col))
    own = [c.alias(f"{_OWN}_{k}") for k, c in leaf.items()]
    small = docs.select(*(c.alias(k) for k, c in leaf.items()), F.col(id_col).alias("id"), F.md5(F.coalesce(text_col, F.lit(""))).alias("digest"), n.alias("n")).where("n > 0")
    with common.scratch(docs.sparkSession):
        small = common.materialize(small, "supply")
        leaves = small.groupBy(*_LEVELS).agg(F.sum("n").alias("supply")).withColumns({"w_domain": w_domain, "w_lang": w_lang, "w_source": w_source})
        plan = budgets(leaves, total, max_epochs).withColumn("whole", F.floor(F.col("budget") / F.col("supply")).cast("long"))
        plan = common.materialize(plan.withColumn("rest", F.col("budget") - F.col("whole") * F.col("supply")), "budgets")
        part = plan.where("rest > 0")
        keyed = small.join(part.select(*_LEVELS, "whole"), _LEVELS).select(*_LEVELS, _order_key(seed, F.col("whole") + 1, F.col("id"), F.col("digest")).alias("key"), "n")
        plan = common.materialize(plan.join(_cuts(keyed, part), _LEVELS, "left").select(*(F.col(k).alias(f"{_OWN}_{k}") for k in _LEVELS), *(F.col(k).alias(f"{_OWN}_{k}") for k in ("whole", "cut", "cut_take"))), "plan", keep=True)
    joined = docs.select("*", *own, n.alias(f"{_OWN}_n")).where(F.col(f"{_OWN}_n") > 0).join(plan, [f"{_OWN}_{k}" for k in _LEVELS])
    key = _order_key(seed, F.col(f"{_OWN}_whole") + 1, F.col(id_col), F.md5(F.coalesce(text_col, F.lit(""))))
    cut, take = F.col(f"{_OWN}_cut"), F.col(f"{_OWN}_cut_take")
    last = F.when(cut.isNull() | (key > cut), 0).when(key == cut, take).otherwise(F.col(f"{_OWN}_n"))
    joined = joined.withColumn(f"{_OWN}_last", last.cast("long"))
    whole = F.col(f"{_OWN}_whole")
    epochs = F.transform(F.sequence(F.lit(1).cast("long"), whole + 1), lambda e: F.struct(e.cast("int").alias("epoch"), F.when(e <= whole, F.col(f"{_OWN}_n")).otherwise(F.col(f"{_OWN}_last")).alias("taken")))
    each = joined.select(*docs.columns, *(f"{_OWN}_{k}" for k in (*_LEVELS, "n")), F.explode(F.filter(epochs, lambda x: x["taken"] > 0)).alias(f"{_OWN}_e"))
    parts = [F.col(f"{_OWN}_{k}").alias(k) for k in _LEVELS] + [F.col(f"{_OWN}_n").alias("n_tokens"), F.col(f"{_OWN}_e.epoch").alias("epoch"), F.col(f"{_OWN}_e.taken").alias("taken")]
    return each.select(*docs.columns, F.struct(*parts).alias(_OWN))


def taken_text(text_col: str = "text") -> Column:
    """The text, cut after the words that were taken."""
    whole = F.col(f"{_OWN}.taken") >= F.col(f"{_OWN}.n_tokens")
    first = F.array_join(F.slice(F.regexp_extract_all(text_col, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), 0), F.lit(1), F.col(f"{_OWN}.taken").cast("int")), "")
    return F.when(whole, F.col(text_col)).otherwise(first)


def domain_of(source: Column) -> Column:
    """The query's and the pipeline's domains: sources src0 to src9 are web, all others curated."""
    return F.when(source.rlike("^src[0-9]$"), "web").otherwise("curated")


def _weight(key: str, weights: dict[str, int]) -> Column:
    out = F.lit(1)
    for name, w in weights.items():
        out = F.when(F.col(key) == name, w).otherwise(out)
    return out


def mix_default(docs: DataFrame) -> DataFrame:
    return mix(docs, domain_of(F.col("source")), _weight("domain", DOMAIN_WEIGHTS), _weight("lang", LANG_WEIGHTS), F.lit(1))


def op1_hierarchical_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix_default(common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return found.select("doc_id", *(F.col(f"{_OWN}.{k}").alias(k) for k in (*_LEVELS, "n_tokens", "epoch", "taken")))


def _share_sql(nodes: str, parent: str, out: str) -> str:
    """CTEs of _share: nodes has parent, budget, name, capacity, weight."""
    return f"""
{out}_a AS (SELECT * REPLACE (CASE WHEN weight > 0 THEN capacity ELSE 0 END AS capacity) FROM {nodes}),
{out}_b AS (SELECT *, coalesce(sum(capacity) OVER b, 0) AS held, sum(weight) OVER (PARTITION BY {parent}) - coalesce(sum(weight) OVER b, 0) AS weights FROM {out}_a
  WINDOW b AS (PARTITION BY {parent} ORDER BY CASE WHEN weight > 0 THEN capacity::DOUBLE / weight ELSE 0.0 END, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{out}_c AS (SELECT *, (budget - held)::HUGEINT * weight >= capacity::HUGEINT * weights AS is_full FROM {out}_b),
{out}_d AS (SELECT *, min(held) FILTER (NOT is_full) OVER (PARTITION BY {parent}) AS open_held, max(weights) FILTER (NOT is_full) OVER (PARTITION BY {parent}) AS open_weights FROM {out}_c),
{out} AS MATERIALIZED (SELECT *, (CASE WHEN is_full THEN capacity ELSE (budget - open_held)::HUGEINT * weight // open_weights END)::BIGINT AS share FROM {out}_d)"""


def mix_sql(docs: str) -> str:
    """CTEs up to `mixed`: doc_id, text, domain, lang, source, n_tokens, epoch, taken."""
    case = lambda key, w: "CASE " + " ".join(f"WHEN {key} = '{k}' THEN {v}" for k, v in w.items()) + " ELSE 1 END"
    return f"""
md AS MATERIALIZED (SELECT doc_id, text, CASE WHEN regexp_matches(source, '^src[0-9]$') THEN 'web' ELSE 'curated' END AS domain, coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source,
  len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n, md5(coalesce(text, '')) AS digest FROM {docs} WHERE regexp_matches(text, '[^\\x20\\x09-\\x0D]')),
ml AS MATERIALIZED (SELECT domain, lang, source, sum(n)::BIGINT AS supply, sum(n)::BIGINT * {MAX_EPOCHS} AS capacity FROM md GROUP BY ALL),
m1 AS (SELECT 0 AS one, domain, domain AS name, sum(capacity)::BIGINT AS capacity, {case("domain", DOMAIN_WEIGHTS)} AS weight, (SELECT sum(supply)::BIGINT FROM ml) AS budget FROM ml GROUP BY domain),{_share_sql("m1", "one", "s1")},
m2 AS (SELECT domain, lang, lang AS name, sum(capacity)::BIGINT AS capacity, {case("lang", LANG_WEIGHTS)} AS weight, any_value(s1.share) AS budget FROM ml JOIN (SELECT domain, share FROM s1) AS s1 USING (domain) GROUP BY domain, lang),{_share_sql("m2", "domain", "s2")},
m3 AS (SELECT domain, lang, source, source AS name, capacity, 1 AS weight, supply, s2.share AS budget FROM ml JOIN (SELECT domain, lang, share FROM s2) AS s2 USING (domain, lang)),{_share_sql("m3", "domain, lang", "s3")},
mp AS (SELECT domain, lang, source, share // supply AS whole, share % supply AS rest FROM s3),
mk AS (SELECT md.*, whole, rest, md5(concat_ws(':', '{SEED}', (whole + 1)::VARCHAR, coalesce(doc_id::VARCHAR, ''), digest)) AS key FROM md JOIN mp USING (domain, lang, source)),
mu AS (SELECT *, sum(n) OVER (PARTITION BY domain, lang, source ORDER BY key) AS upto FROM mk),
mixed AS MATERIALIZED (SELECT * FROM (SELECT doc_id, text, domain, lang, source, n AS n_tokens, e::INTEGER AS epoch, (CASE WHEN e <= whole THEN n ELSE greatest(least(n, rest - upto + n), 0) END)::BIGINT AS taken
  FROM (SELECT *, unnest(range(1, whole + 2)) AS e FROM mu)) WHERE taken > 0)"""


def sql() -> str:
    return f"WITH {mix_sql('documents')}\nSELECT doc_id, domain, lang, source, n_tokens, epoch, taken FROM mixed"
