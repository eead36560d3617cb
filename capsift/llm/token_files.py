"""Token-ID output: documents as wavelet matrix files, in ascending order of their ids.

`write` deals documents by id ranges to tasks; each task encodes its documents and closes a
file at the first document end after `shard_tokens` tokens. Files get their names from the
partition, are written under another name and renamed, so a repeated task leaves the same
files. `read` gives the documents back from the files alone.

Defined cases: null text counts as empty (the end id alone); a null id sorts first; rows with equal ids
stand by text; an empty table gives no file; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from capsift.llm import common, textbuf, tokens, wavelet

SHARD_TOKENS = 2_000_000
SUFFIX = ".wvm"


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _put(uri: str, name: str, data: bytes) -> None:
    """Write under a name of this attempt, then rename: a reader sees whole files only."""
    where, path = _filesystem(uri)
    attempt = f"{path}/.{name}.{TaskContext.get().taskAttemptId()}"
    with where.open_output_stream(attempt) as out:
        out.write(data)
    where.move(attempt, f"{path}/{name}")


def write(docs: DataFrame, path: str, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS, parts: int | None = None) -> DataFrame:
    """Write the files to the folder `path` (a URI that pyarrow opens) and return the manifest: file, part, n_docs, n_tokens. Runs at once."""
    spark = docs.sparkSession
    tokenizer = tokenizer or tokens.default_tokenizer()
    where, folder = _filesystem(path)
    where.create_dir(f"{folder}/files", recursive=True)
    files = f"{path}/files"

    def encode(batches):
        part, k, ids, held, counts = TaskContext.get().partitionId(), 0, [], [], []
        coder = tokens.encoder(tokenizer)

        def close():
            name = f"{part:06d}-{k:05d}{SUFFIX}"
            n = np.concatenate(counts)
            _put(files, name, wavelet.build(np.concatenate(held), ids, n))
            return pa.RecordBatch.from_pydict({"file": [name], "part": [part], "n_docs": [len(ids)], "n_tokens": [int(n.sum())]}, schema=pa.schema([("file", pa.string()), ("part", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

        for b in textbuf.slices(batches, 1):
            got, at = coder.encode(b.column(1))
            ids += b.column(0).to_pylist()
            held.append(got)
            counts.append(np.diff(at))
            if sum(map(len, held)) >= shard_tokens:
                yield close()
                k, ids, held, counts = k + 1, [], [], []
        if ids:
            yield close()

    dealt = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange(parts or common.partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    dealt.mapInArrow(encode, "file string, part int, n_docs long, n_tokens long").write.parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def bases(manifest: DataFrame) -> DataFrame:
    """file, base: the ids of all files before it. Sums over the files of a part, then over parts: a row for each part of the writing stage."""
    own = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("all")).withColumn("before", F.sum("all").over(Window.orderBy("part")) - F.col("all"))
    within = manifest.select("file", "part", F.coalesce(F.sum("n_tokens").over(own), F.lit(0)).alias("upto"))
    return within.join(parts, "part").select("file", (F.col("before") + F.col("upto")).alias("base"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Documents from the files: doc_id, start (ids of all documents before it), n_tokens, ids (binary: little-endian unsigned 32-bit). The list of files is dealt to tasks, which open them; no ids are shuffled."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
    where = f"{path}/files"

    def decode(batches):
        for b in batches:
            for file, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                fs, folder = _filesystem(where)
                with fs.open_input_file(f"{folder}/{file}") as f:
                    m = wavelet.WaveletMatrix(f.read())
                data, n = m.tokens(), m.counts()
                ends = np.cumsum(n)
                ids = m.doc_ids()
                for i in range(0, len(ids), 1000):
                    a, z = slice(i, i + 1000), range(i, min(i + 1000, len(ids)))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a], pa.int64()), pa.array(base + (ends - n)[a]), pa.array(n[a]), pa.array([data[ends[j] - n[j] : ends[j]].tobytes() for j in z], pa.binary())], schema=schema)

    files = bases(spark.read.parquet(f"{path}/manifest"))
    return files.repartition(common.partitions(spark)).mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")


def op3_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.new_dir(spark, "wavelet")
    write(common.table(spark, sf_dir, "documents"), path)
    return read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
