"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only.

The unit is the word: two lines are near if one word inserted, deleted or replaced makes one of the other. A line goes
if an equal or near line stands earlier, by document id and then by line number; what counts as earlier is judged on the
input, so a line goes even if its earlier neighbour goes too.

Near lines: each line emits, as hashed keys, what is left without its word i, split at i, and itself, split at
each gap. Lines share a key exactly if they are within one edit of each other by the word at that split, so all lines of
one key are near each other, and the key's earliest is the witness against the rest: no pairs are made.
Each removal is verified against its witness word by word.

Only lines that can have a neighbour emit keys: of two near lines, the first or the last half is equal, so
a line whose halves occur nowhere else has none. Lines of fewer than `min_words` words (five: one edit would be
over a fifth of them) are compared for equality alone.

Defined cases: lines without a word stay and are compared with nothing; white space within a line does not count; null
and empty texts come back as they are; rows equal in id and text are one document and come back alike; null
ids stand first; an empty table gives no rows; other columns stay as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from capsift.llm import common

MIN_WORDS = 5
_OWN = "__capsift_line_dedup"
_KEY, _GONE, _LINES = "__capsift_row", "__capsift_gone", "__capsift_lines"
_PLACE = ["doc_id", "k", "no"]


def _halves(w: Column, n: Column, min_words: int) -> Column:
    """Hashes of the first and last half, also as a line of one word less would cut them; the lowest bit is 1 for a last half."""
    down = lambda x: F.floor(x / 2).cast("int")
    first = [down(n), down(n - 1)]
    last = [n - down(n), n - 1 - down(n - 1)]
    keys = [F.xxhash64(a, F.slice(w, 1, a)).bitwiseAND(-2) for a in first] + [F.xxhash64(b, F.slice(w, n - b + 1, b)).bitwiseOR(1) for b in last]
    return F.when(n >= min_words, F.array_distinct(F.array(*keys))).otherwise(F.array().cast("array<bigint>"))


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """A row for each line with a word: doc_id, k (the row), no, h1, h2 (the line), halves."""
    # the key in a step of its own: beside the explode it would be computed for each line
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), common.row_key(id_col, text_col).alias("k"), F.col(text_col).alias("text"))
    split = keyed.select("doc_id", "k", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    worded = split.where(F.col("line").rlike(r"[^\x20\x09-\x0D]")).withColumn("w", common.words(F.col("line")))
    return worded.select(*_PLACE, F.xxhash64("w").alias("h1"), F.xxhash64(F.lit(1), "w").alias("h2"), _halves(F.col("w"), F.size("w"), min_words).alias("halves"))


def _candidates(distinct: DataFrame) -> DataFrame:
    """k, no of the lines that share a half with another, and which: by_first, by_last."""
    halves = distinct.select("k", "no", F.explode("halves").alias("half"))
    shared = common.materialize(halves.groupBy("half").agg(F.count("*").alias("n")).where("n > 1"), "halves")
    last = F.col("half").bitwiseAND(1) == 1
    return common.spread_join(halves, shared, ["half"], "n", ["k", "no"], "left_semi").groupBy("k", "no").agg(F.bool_or(~last).alias("by_first"), F.bool_or(last).alias("by_last"))


def _variants(found: DataFrame) -> DataFrame:
    """found: places, words, by_first, by_last. Returns places and key: of each line its words without one, and itself, at every split.

    Two lines with equal first halves differ behind them, so only these splits are needed, and the other way round.
    """
    total = F.aggregate(F.transform("w", lambda w, i: F.xxhash64(w, F.size("w") - 1 - i, F.lit(1))), F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x))
    each = found.repartition(common.partitions(found.sparkSession), "k", "no").withColumn("all", total).withColumn("n", F.size("w"))
    each = each.select(*_PLACE, "by_first", "by_last", "all", "n", F.posexplode("w").alias("i", "word"))
    each = each.withColumn("left", F.xxhash64("word", "i")).withColumn("right", F.xxhash64("word", F.col("n") - 1 - F.col("i"), F.lit(1))).drop("word")
    run = Window.partitionBy("k", "no").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("upto", F.bit_xor("left").over(run)).withColumn("after", F.col("all").bitwiseXOR(F.bit_xor("right").over(run)))
    before = F.col("upto").bitwiseXOR(F.col("left"))
    i, n, last = F.col("i"), F.col("n"), F.col("n") - 1 - F.col("i")
    each = each.where((F.col("by_first") & (i >= F.floor((n - 1) / 2))) | (F.col("by_last") & (i <= F.floor(n / 2))))
    deleted = F.xxhash64(before, "after", i, last)
    gap = F.xxhash64(before, F.col("after").bitwiseXOR(F.col("right")), i, last + 1)
    end = F.xxhash64("upto", F.lit(0).cast("long"), i + 1, F.lit(0))
    keys = F.when(last == 0, F.array(deleted, gap, end)).otherwise(F.array(deleted, gap))
    return each.select(*_PLACE, F.explode(keys).alias("key"))


def _near(a: Column, b: Column) -> Column:
    """Whether word arrays are equal but for one word inserted, deleted or replaced."""
    n, m = F.size(a), F.size(b)
    differ = F.size(F.filter(F.zip_with(a, b, lambda x, y: ~F.equal_null(x, y)), lambda x: x))

    def without_one(long: Column, short: Column) -> Column:
        # the first place where they differ: there the longer one has a word more
        at = F.coalesce(F.array_position(F.zip_with(long, short, lambda x, y: ~F.equal_null(x, y)), F.lit(True)), F.lit(0)).cast("int")
        return F.slice(long, at + 1, F.size(long)) == F.slice(short, at, F.size(short))

    return F.when(n == m, differ <= 1).when(n == m + 1, without_one(a, b)).when(m == n + 1, without_one(b, a)).otherwise(False)


def near_lines(docs: DataFrame, distinct: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """place: the distinct lines (by their first places) that have an earlier near line."""
    wanted = _candidates(distinct).groupBy("k").agg(F.collect_list(F.struct("no", "by_first", "by_last")).alias("at"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), common.row_key(id_col, text_col).alias("k"), F.col(text_col).alias("text"))
    # exploded once, so that the split isn't moved into the lambda and run for each line
    both = texts.join(wanted.hint("merge"), "k").select("doc_id", "k", "at", F.explode(F.array(F.split("text", "\n"))).alias("lines"))
    both = both.select("doc_id", "k", F.explode(F.transform("at", lambda a: F.struct(a["no"].alias("no"), a["by_first"].alias("by_first"), a["by_last"].alias("by_last"), F.get("lines", a["no"]).alias("line")))).alias("x"))
    found = common.materialize(both.select("doc_id", "k", "x.no", "x.by_first", "x.by_last", common.words(F.col("x.line")).alias("w")).dropDuplicates(["k", "no"]), "candidates")
    place = F.struct(*_PLACE)
    variants = common.materialize(_variants(found), "variants")
    first = variants.groupBy("key").agg(F.min(place).alias("witness"), F.max(place).alias("latest"), F.count("*").alias("n")).where("witness < latest").select("key", "witness", "n")
    hits = common.spread_join(variants, common.materialize(first, "keys"), ["key"], "n", _PLACE).select(place.alias("place"), "witness").where("place > witness").distinct()
    words = found.select(place.alias("place"), "w")
    pairs = common.materialize(hits, "hits").join(words, "place").join(words.select(F.col("place").alias("witness"), F.col("w").alias("v")), "witness")
    return pairs.where(_near(F.col("w"), F.col("v"))).select("place").distinct()


def duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """k (the row), gone: the numbers of its lines that have an equal or near earlier line. Rows without any are left out."""
    every = common.materialize(lines(docs, id_col, text_col, min_words), "lines")
    place = F.struct(*_PLACE)
    distinct = every.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n"), F.first("halves").alias("halves"))
    distinct = common.materialize(distinct.select("h1", "h2", "first.*", "n", "halves"), "distinct")
    near = common.materialize(near_lines(docs, distinct, text_col, id_col), "near").withColumn("near", F.lit(True))
    judged = distinct.select("h1", "h2", place.alias("place"), "n").join(near, "place", "left").where("near or n > 1")
    judged = common.materialize(judged.select("h1", "h2", F.col("place").alias("first"), "n", F.coalesce("near", F.lit(False)).alias("near")), "judged")
    gone = common.spread_join(every.drop("halves"), judged, ["h1", "h2"], "n", _PLACE).where(F.col("near") | (place > F.col("first")))
    return gone.groupBy("k").agg(F.collect_set("no").alias("gone"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the duplicate lines taken out of the text, and a struct column `__capsift_line_dedup`: n_lines (all) and n_removed. min_words: lines of fewer words are compared for equality alone (3 is the least)."""
    if min_words < 3:
        raise ValueError("any two lines of two words or one that share a word are near")
    with common.scratch(docs.sparkSession):
        gone = common.materialize(duplicate_lines(docs, id_col, text_col, min_words), "gone", keep=True)
    gone = gone.select(F.col("k").alias(_KEY), F.col("gone").alias(_GONE))
    split = F.col(_LINES)  # a column: within a lambda a split would run for each line
    left = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col(_GONE))
    text = F.when(F.col(_GONE).isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(F.array_sort(left), lambda i: F.get(split, i)), "\n"))
    n = F.coalesce(F.length(text_col) - F.length(F.replace(F.col(text_col), F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")
    removed = F.when(F.col(_GONE).isNull(), 0).otherwise(F.size(_GONE)).cast("long")
    joined = docs.withColumn(_KEY, common.row_key(id_col, text_col)).join(gone.hint("merge"), _KEY, "left").withColumn(_LINES, F.when(F.col(_GONE).isNotNull(), F.split(text_col, "\n")))
    return joined.select(*(F.col(c) if c != text_col else text.alias(c) for c in docs.columns), F.struct(n.alias("n_lines"), removed.alias("n_removed")).alias(_OWN))


def op10_deletion_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", f"{_OWN}.n_lines", f"{_OWN}.n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def lines_sql(docs: str) -> str:
    """CTEs up to `deduped` (doc_id, t: the text without its duplicate lines, n_lines (all), n_removed). Ids must be unique."""
    return f"""
ld AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM {docs}),
ll AS (SELECT doc_id, no, regexp_extract_all(l[no], '[^\\x20\\x09-\\x0D]+') AS w FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS no FROM ld)),
lo AS MATERIALIZED (SELECT doc_id, no, w, array_to_string(w, ' ') AS line, row_number() OVER (ORDER BY doc_id, no) AS place FROM ll WHERE len(w) > 0),
lf AS MATERIALIZED (SELECT line, min(place) AS place, any_value(w) AS w, len(any_value(w)) AS n FROM lo GROUP BY line),
li AS (SELECT place, w, n, unnest(range(0, n + 1)) AS i FROM lf WHERE n >= {MIN_WORDS}),
lk AS MATERIALIZED (SELECT place, array_to_string(w[1:i], ' ') || chr(10) || array_to_string(w[i + 2:], ' ') AS key FROM li WHERE i < n
  UNION ALL SELECT place, array_to_string(w[1:i], ' ') || chr(10) || array_to_string(w[i + 1:], ' ') FROM li),
ln AS (SELECT DISTINCT place FROM (SELECT place, min(place) OVER (PARTITION BY key) AS witness FROM lk) WHERE witness < place),
lg AS (SELECT doc_id, list(no) AS gone FROM lo JOIN (SELECT line, lf.place AS place, ln.place IS NOT NULL AS near FROM lf LEFT JOIN ln USING (place)) AS f USING (line) WHERE near OR lo.place > f.place GROUP BY doc_id),
deduped AS (SELECT doc_id, CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_transform(list_filter(range(1, len(l) + 1), lambda i: NOT list_contains(gone, i)), lambda i: l[i]), chr(10)) END AS t,
  coalesce(len(l), 0)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_removed FROM ld LEFT JOIN lg USING (doc_id))"""


def sql() -> str:
    return f"WITH {lines_sql('documents')}\nSELECT doc_id, n_lines, n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM deduped"
