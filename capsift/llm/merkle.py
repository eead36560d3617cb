"""Merkle dataset manifest: a tree of hashes over a table's rows, by source, with each row's proof.

A leaf is the hash of a row's columns, each with its length before it. The leaves of a source, in the order of their ids, are hashed three by three, level by level, to the source's subroot; the
subroots in the order of their sources likewise to the root. A run at the end of a level may be shorter, even one node.

What is stored of a tree are its parents' preimages: the concatenated hashes of each parent's children, 64 characters a child. The preimages of six levels, of up to 729 nodes, are one row (a
block); the blocks' tops are the nodes of the next round, so a tree of n leaves takes log(n) / log(729) rounds. Going down, each block hands its ancestors' preimages to the blocks below, and the last hand them to the
leaves. A leaf's siblings at a level are the preimage without its own 64 characters, its parent is folded again by splicing its hash in their place.

Nodes are numbered by range: rows are sorted by (group, order) over partitions, numbered within, and each partition's first group goes on where the partitions before it end, which is one number
a partition. No window or task holds a source.

Defined cases: a null column counts as `-`, a null source is a source of its own and comes first, null ids come first; rows equal in source and id stand in the order of their leaves; a source of one row has its leaf
as subroot, a table of one source that subroot as root; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from capsift.llm import common

ARITY, LEVELS, WIDTH = 3, 6, 64
BLOCK = ARITY**LEVELS


def _part(c: Column) -> Column:
    text = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(columns: list[Column]) -> Column:
    """Lower-case hex SHA-256 of the columns, each `-` if null, else its length in bytes, a colon and its value."""
    return F.sha2(F.concat(*(_part(c) for c in columns)), 256)


def preimages(hashes: list[str]) -> list[list[str]]:
    """The preimages of each level above the hashes, up to one node or six levels; only the last level of a list may have one node alone."""
    out: list[list[str]] = []
    while len(out) < LEVELS and (len(hashes) > 1 or not out):
        out.append(["".join(hashes[i : i + ARITY]) for i in range(0, len(hashes), ARITY)])
        hashes = [sha256(p.encode()).hexdigest() for p in out[-1]]
    return out


def lift(levels: list[list[str]], to: int) -> list[list[str]]:
    """The levels continued to the number `to`, each further one of one node."""
    while len(levels) < to:
        levels = [*levels, [sha256(p.encode()).hexdigest() for p in levels[-1]]]
    return levels


def siblings(preimage: str, slot: int) -> str:
    return preimage[: WIDTH * slot] + preimage[WIDTH * (slot + 1) :]


def fold(node: str, path: list[str], slots: list[int]) -> str:
    """The root that a node leads to: its hash takes the place of its slot in each ancestor's preimage."""
    for preimage, slot in zip(path, slots):
        node = sha256((preimage[: WIDTH * slot] + node + preimage[WIDTH * (slot + 1) :]).encode()).hexdigest()
    return node


def proof(path: list[str], slots: list[int]) -> str:
    return sha256("".join(map(siblings, path, slots)).encode()).hexdigest()


def _count(group: int, batches):
    """Numbers rows within the partition's runs of equal groups: at; run: the run's number, from 0."""
    from pyspark import TaskContext

    part, last, run, n = TaskContext.get().partitionId(), None, -1, 0
    for b in batches:
        runs, ats = [], []
        for g in b.column(group).to_pylist():
            if g != last or run < 0:
                last, run, n = g, run + 1, 0
            runs.append(run)
            ats.append(n)
            n += 1
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * len(ats), pa.int32()), pa.array(runs, pa.int64()), pa.array(ats, pa.int64())], names=[*b.schema.names, "part", "run", "at"])


def numbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """nodes (grp, ...) with pos: its place among the nodes of its group by the columns `order`, from 0."""
    by = ["grp", *order]
    sorted_ = nodes.repartitionByRange(common.partitions(nodes.sparkSession), *by).sortWithinPartitions(*by)
    schema = nodes.limit(0).withColumns({"part": F.lit(0), "run": F.lit(0).cast("long"), "at": F.lit(0).cast("long")}).schema
    placed = common.materialize(sorted_.mapInArrow(partial(_count, nodes.columns.index("grp")), schema), "placed")
    runs = placed.groupBy("part", "run", "grp").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # only a partition's first run can go on from earlier partitions: one row a partition
    offsets = runs.withColumn("before", before).where("run = 0").select("part", "run", "before")
    joined = placed.join(F.broadcast(offsets), ["part", "run"], "left")
    return joined.select(*nodes.columns, (F.col("at") + F.coalesce("before", F.lit(0))).alias("pos"))


def _rows(batches) -> Iterator[dict]:
    """One row at a time: a block is some 200 kB, a batch may hold thousands."""
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


def _build(batches):
    """Rows: grp, block, nodes in order. Adds the preimages of the levels above the nodes, as far as one node, the hash where they end (alone), and that of all six levels (full)."""
    for b in batches:
        nodes = b.column(b.schema.get_field_index("nodes"))
        every, ends = nodes.flatten().field("hash").to_pylist(), nodes.offsets.to_numpy() - nodes.offsets[0].as_py()
        levels, alone, full = [], [], []
        for lo, hi in zip(ends, ends[1:]):
            own = preimages(every[lo:hi])
            levels.append(own)
            alone.append(every[lo] if hi == lo + 1 else sha256(own[-1][0].encode()).hexdigest())
            full.append(sha256(lift(own, LEVELS)[-1][0].encode()).hexdigest())
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(levels, pa.list_(pa.list_(pa.string()))), pa.array(alone), pa.array(full)], names=[*b.schema.names, "levels", "alone", "full"])


def blocks(nodes: DataFrame) -> DataFrame:
    """grp, block, nodes (pos, hash and what else the nodes carry), levels, alone, full: 729 nodes a row at most."""
    rest = [c for c in nodes.columns if c not in ("grp", "pos")]
    each = nodes.groupBy("grp", F.floor(F.col("pos") / BLOCK).alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", *rest))).alias("nodes"))
    schema = each.withColumns({"levels": F.lit(None).cast("array<array<string>>"), "alone": F.lit(""), "full": F.lit("")}).schema
    return common.materialize(each.mapInArrow(_build, schema), "blocks")


def _above(row: dict) -> list[tuple[list[str], list[int]]]:
    """Of each node of a block: the preimages of its ancestors up to the root, and its slot in each. A block that is its group's only one ends where one node is left."""
    n = len(row["nodes"])
    levels = ([] if n == 1 else row["levels"]) if row["only"] else lift(row["levels"], LEVELS)
    return [([p[i // ARITY ** (k + 1)] for k, p in enumerate(levels)] + row["path"], [i // ARITY**k % ARITY for k in range(len(levels))] + row["slots"]) for i in range(n)]


def _hand_down(batches):
    """A row for each node of a block: grp, pos, path, slots, subroot."""
    for row in _rows(batches):
        path, slots = zip(*_above(row))
        n = len(path)
        yield pa.RecordBatch.from_arrays(
            [pa.array([row["grp"]] * n), pa.array([x["pos"] for x in row["nodes"]], pa.int64()), pa.array(path, pa.list_(pa.string())), pa.array(slots, pa.list_(pa.int32())), pa.array([row["subroot"]] * n, pa.string())],
            names=["grp", "pos", "path", "slots", "subroot"],
        )


_HANDED = "grp string, pos long, path array<string>, slots array<int>, subroot string"


def _climb(nodes: DataFrame) -> tuple[list[tuple[DataFrame, DataFrame]], DataFrame]:
    """From the nodes (grp, pos, hash, ...) up, the blocks of each round and which of them are their group's only one; and the trees' roots: grp, hash."""
    rounds, roots = [], []
    while not rounds or not nodes.isEmpty():
        every = blocks(nodes)
        sizes = common.materialize(every.groupBy("grp").agg(F.count("*").alias("n")), "sizes")
        marked = common.spread_join(every.select("grp", "block", "alone", "full"), sizes.withColumn("only", F.col("n") == 1), ["grp"], "n", ["block"])
        marked = common.materialize(marked, "marked")
        rounds.append((every, marked))
        roots.append(marked.where("only").select("grp", F.col("alone").alias("hash")))
        nodes = marked.where("not only").select("grp", F.col("block").alias("pos"), F.col("full").alias("hash"))
    return rounds, common.materialize(reduce(DataFrame.unionByName, roots), "roots")


def _with_paths(rounds: list[tuple[DataFrame, DataFrame]], above: DataFrame) -> DataFrame:
    """The blocks of the first round with what stands above them: path, slots, subroot. above: grp, path, slots, subroot of the trees' roots."""
    handed = None
    for every, marked in reversed(rounds):
        known = marked.where("only").select("grp", "block", "only").join(above.hint("merge"), "grp")
        if handed is not None:
            known = known.unionByName(handed.select("grp", F.col("pos").alias("block"), F.lit(False).alias("only"), "path", "slots", "subroot"))
        found = every.select("grp", "block", "nodes", "levels").join(known.hint("merge"), ["grp", "block"])
        handed = common.materialize(found.mapInArrow(_hand_down, _HANDED), "paths") if every is not rounds[0][0] else None
    return found


def _prove(root: str, batches):
    """A row for each leaf."""
    for row in _rows(batches):
        out = []
        for x, (path, slots) in zip(row["nodes"], _above(row)):
            folded = fold(x["tampered"], path, slots)
            out.append((x["doc_id"], x["hash"], row["subroot"], root, proof(path, slots), folded, folded == root, len(path)))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _TYPES)], names=_NAMES)


_NAMES = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "n_levels"]
_TYPES = [pa.int64(), *[pa.string()] * 5, pa.bool_(), pa.int32()]
_SQL = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, n_levels int"


def manifest(docs: DataFrame, columns: list[str], checked: dict[str, Column] | None = None, id_col: str = "doc_id", group_col: str = "source") -> DataFrame:
    """A row for each row of docs: doc_id, leaf, subroot, root, proof_sha256 (of the siblings, level by level), folded_root, verified, n_levels.

    Folded and verified is the row as it reads with the columns `checked` in place of those of the same names; the siblings are the manifest's own."""
    own = [F.col(c) for c in columns]
    seen = [(checked or {}).get(c, F.col(c)) for c in columns]
    group = F.when(F.col(group_col).isNull(), "n").otherwise(F.concat(F.lit("v"), F.col(group_col)))
    leaves = docs.select(group.alias("grp"), F.col(id_col).cast("long").alias("doc_id"), leaf_hash(own).alias("hash"), leaf_hash(seen).alias("tampered"))
    with common.scratch(docs.sparkSession):
        # numbered rows that are equal in all else may stand in several tasks
        leaves = common.materialize(leaves, "leaves").withColumn("tie", F.monotonically_increasing_id())
        rounds, subroots = _climb(numbered(leaves, ["doc_id", "hash", "tampered", "tie"]))
        tops = common.materialize(numbered(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("source"), "hash"), ["source"]), "tops")
        upper, root = _climb(tops)
        above = root.select("grp", F.array().cast("array<string>").alias("path"), F.array().cast("array<int>").alias("slots"), F.lit("").alias("subroot"))
        handed = _with_paths(upper, above).mapInArrow(_hand_down, _HANDED).drop("subroot")
        found = tops.join(handed.hint("merge"), ["grp", "pos"]).select(F.col("source").alias("grp"), "path", "slots", F.col("hash").alias("subroot"))
        one = root.first()
        proved = _with_paths(rounds, common.materialize(found, "sources"))
        return common.materialize(proved.mapInArrow(partial(_prove, one and one["hash"]), _SQL), "manifest", keep=True)


#: Columns that make a document's leaf.
DOCUMENT = ["doc_id", "source", "lang", "n_chars", "text"]


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select(*DOCUMENT)
    hit = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return manifest(docs, DOCUMENT, {"text": F.when(hit, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))})


def sql() -> str:
    nil = lambda c, text: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({text})::VARCHAR || ':' || ({text}) END"
    leaf = lambda text: "sha256(" + " || ".join(nil(c, text if c == "text" else f"{c}::VARCHAR") for c in DOCUMENT) + ")"
    level = lambda name, base: f"""{name} AS (SELECT * FROM {base} UNION ALL
  SELECT grp, lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM {name} WHERE n > 1 GROUP BY grp, lvl, pos // 3, n)"""  # noqa: E731
    family = lambda name: f"""SELECT grp, lvl, pos // 3 AS parent, list(h ORDER BY pos) AS hs FROM {name} WHERE n > 1 GROUP BY grp, lvl, pos // 3"""
    return f"""
WITH RECURSIVE tab AS (SELECT list(list_reduce(range(0, 8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) ORDER BY i) AS t FROM range(0, 256) AS r(i)),
crc AS (SELECT doc_id, xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda a, b: xor(t[xor(a % 256, b) + 1], a // 256), 4294967295), 4294967295) AS crc
  FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL), tab),
d AS (SELECT doc_id, CASE WHEN source IS NULL THEN 'n' ELSE 'v' || source END AS grp, {leaf("text")} AS h,
  CASE WHEN crc % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf("text")} END AS seen FROM documents LEFT JOIN crc USING (doc_id)),
p AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM d),
b AS (SELECT grp, 0 AS lvl, pos, h, n FROM p),
{level("a", "b")},
s AS (SELECT grp AS source, h, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n, lvl AS height FROM a WHERE n = 1),
sb AS (SELECT '' AS grp, 0 AS lvl, pos, h, n FROM s),
{level("u", "sb")},
fam AS MATERIALIZED (SELECT f.grp, lvl, parent, hs FROM ({family("a")}) AS f UNION ALL
  SELECT source, height + lvl, parent, hs FROM ({family("u")}) AS f JOIN s ON s.pos // (3 ** (lvl + 1))::BIGINT = f.parent),
top AS (SELECT source AS grp, s.h AS subroot, s.pos AS spos, height, u.h AS root, height + u.lvl AS levels FROM s, u WHERE u.n = 1),
walk AS (SELECT p.doc_id, p.grp, p.pos, p.h AS leaf, 0 AS lvl, p.pos AS at, p.seen AS node, '' AS sib FROM p UNION ALL
  SELECT w.doc_id, w.grp, w.pos, leaf, w.lvl + 1, parent, sha256(array_to_string(hs[1:slot], '') || node || array_to_string(hs[slot + 2:], '')), sib || array_to_string(hs[1:slot], '') || array_to_string(hs[slot + 2:], '')
  FROM (SELECT w.*, CASE WHEN w.lvl = height THEN spos ELSE w.at END AS here, here % 3 AS slot FROM walk AS w JOIN top USING (grp) WHERE w.lvl < levels) AS w JOIN fam ON fam.grp = w.grp AND fam.lvl = w.lvl AND fam.parent = here // 3)
SELECT doc_id, leaf, subroot, root, sha256(sib) AS proof_sha256, node AS folded_root, node = root AS verified, levels::INT AS n_levels FROM walk JOIN top USING (grp) WHERE lvl = levels"""
