"""Packages from folders, git references, manifests and archives, as one relation of files.

skill_key, path (within the package), size, content_type (text or binary), content (null if binary), list_seq.
"""

from __future__ import annotations

import io
import re
import subprocess
import zipfile
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from capsift.functions import paths, urls

COLUMNS = ["skill_key", "path", "size", "content_type", "content", "list_seq"]
SAMPLE = 2048
#: Bytes of an archive's members that leave a task together.
_HELD = 1 << 24
MANIFEST = "struct<version:int,basePath:string,name:string,compression:string,files:array<struct<path:string,size:bigint,contentType:string>>>"


def is_text(content: Column) -> Column:
    """By the first 2,048 bytes: no zero byte, and fewer than a tenth control bytes."""
    pairs = F.regexp_replace(F.hex(F.substring(content, 1, SAMPLE)), "(..)", "$1 ")
    control = F.size(F.regexp_extract_all(pairs, F.lit("(?:0[1-8BEF]|0C|1[0-9A-F]) "), F.lit(0)))
    n = F.least(F.length(content), F.lit(SAMPLE))
    return ~F.contains(pairs, F.lit("00 ")) & ((n == 0) | (control < n * 0.1))


def _files(rows: DataFrame) -> DataFrame:
    """rows: skill_key, path, bytes, and size where bytes may be null: of a file that was not read, whose kind then follows its name."""
    seq = F.row_number().over(Window.partitionBy("skill_key").orderBy("path")) - 1
    size = F.coalesce("size", F.length("bytes").cast("long")) if "size" in rows.columns else F.length("bytes").cast("long")
    text = F.coalesce(is_text(F.col("bytes")), paths.file_type(F.col("path")) != "binary")
    kind = F.when(text, "text").otherwise("binary")
    return rows.select("skill_key", "path", size.alias("size"), kind.alias("content_type"), F.when(text, F.decode("bytes", "UTF-8")).alias("content"), seq.alias("list_seq"))


def local(spark: SparkSession, folder: str, sub: str = "", many: bool = True, max_size: int | None = None) -> DataFrame:
    """All files below a folder that Spark can read. many: each direct sub-folder is a package; else the folder is one. max_size: larger files are listed with their sizes and not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    # the source compares lengths before it opens a file, and opens none for its path and length alone
    read = (found if max_size is None else found.where(F.col("length") <= max_size)).select("path", F.col("length").alias("size"), F.col("content").alias("bytes"))
    if max_size is not None:
        read = read.unionByName(found.where(F.col("length") > max_size).select("path", F.col("length").alias("size"), F.lit(None).cast("binary").alias("bytes")))
    root = re.sub(r"^[a-z0-9]+:/*", "/", folder).rstrip("/") + "/"
    name = F.regexp_replace("path", "^[a-z0-9]+:/*", "/")
    rest = F.substring(name, F.instr(name, F.lit(root)) + len(root), F.length(name))
    rows = read.select(rest.alias("rest"), "bytes", "size")
    if many:
        rows = rows.where(F.contains("rest", F.lit("/"))).select(F.substring_index("rest", "/", 1).alias("skill_key"), F.regexp_replace("rest", "^[^/]*/", "").alias("path"), "bytes", "size")
    else:
        rows = rows.select(F.lit(folder).alias("skill_key"), F.col("rest").alias("path"), "bytes", "size")
    return _files(within(rows, sub))


def within(rows: DataFrame, sub: str) -> DataFrame:
    """The files below a sub-folder, by their paths in it."""
    prefix = sub.strip("/")
    if not prefix:
        return rows
    return rows.where(F.startswith("path", F.lit(prefix + "/"))).withColumn("path", F.substring("path", len(prefix) + 2, 1 << 30))


def _git(folder: str, *args: str) -> bytes:
    done = subprocess.run(["git", "-C", folder, *args], capture_output=True)
    if done.returncode:
        raise ValueError(done.stderr.decode(errors="replace").strip())
    return done.stdout


def git(spark: SparkSession, folder: str, ref: str, sub: str = "") -> DataFrame:
    """A repository's files at a reference; sizes are not known. The repository is on the driver: one package's files."""
    top = _git(folder, "rev-parse", "--show-toplevel").decode().strip()
    if not ref or ref.startswith("-"):
        raise ValueError(f"not a reference: {ref!r}")
    _git(top, "rev-parse", "--verify", f"{ref}^{{commit}}")
    names = [n for n in _git(top, "ls-tree", "-r", "-z", "--name-only", ref).decode().split("\0") if n]
    rows = spark.createDataFrame([(folder, n, _git(top, "show", f"{ref}:{n}")) for n in names], "skill_key string, path string, bytes binary")
    return _files(within(rows, sub)).withColumn("size", F.lit(None).cast("long"))


def tree(spark: SparkSession, entries: DataFrame, sub: str = "") -> DataFrame:
    """A repository's listing with blobs, as its service gives them: skill_key, path, encoded (base64)."""
    return _files(within(entries.select("skill_key", "path", F.unbase64(F.regexp_replace("encoded", r"\s", "")).alias("bytes")), sub))


def manifest(df: DataFrame, column: str = "value") -> DataFrame:
    """JSON manifests parsed: version, base_path, name, compression, files; invalid ones give nulls. Version 2 must be a compressed archive."""
    m = F.from_json(column, MANIFEST)
    ok = (m["version"] == 1) | ((m["version"] == 2) & m["compression"].isNotNull())
    return df.withColumn("manifest", F.when(ok, m))


def manifest_of(files: DataFrame, version: int = 1, compression: str | None = None) -> DataFrame:
    """skill_key, manifest (JSON) of each package's files."""
    item = F.struct("path", "size", F.col("content_type").alias("contentType"))
    got = files.groupBy("skill_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("list_seq", item.alias("f")))), lambda x: x["f"]).alias("files"))
    return got.select("skill_key", F.to_json(F.struct(F.lit(version).alias("version"), F.col("skill_key").alias("name"), F.lit(compression).alias("compression"), "files")).alias("manifest"))


def archives(spark: SparkSession, folder: str, corrupt: bool = False, max_size: int = 1 << 26) -> DataFrame:
    """The members of all zip archives below a folder; each archive is a package. A member is read when it is its turn, and leaves the task with a few others; one that is larger than max_size when unpacked is listed
    with its size and not unpacked, however small its packed form. What can't be read
    (a corrupt archive or member, one with a password) is left out: with `corrupt`, the result is instead what was left out: skill_key, path (null: the archive), error."""
    columns = ["skill_key", "path", "bytes", "size", "error"]

    def members(batches):
        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"]):
                key, rows, held = re.sub(r".*/|\.zip$", "", name), [], 0
                try:
                    listed = zipfile.ZipFile(io.BytesIO(data))
                except (zipfile.BadZipFile, NotImplementedError, ValueError, OSError) as e:
                    rows.append((key, None, None, None, f"{type(e).__name__}: {e}"))
                else:
                    for m in listed.infolist():
                        if m.is_dir():
                            continue
                        if m.file_size > max_size:
                            rows.append((key, m.filename, None, m.file_size, None))
                            continue
                        try:
                            rows.append((key, m.filename, listed.read(m), m.file_size, None))
                        except (zipfile.BadZipFile, NotImplementedError, RuntimeError, ValueError, EOFError, OSError, zlib.error) as e:
                            rows.append((key, m.filename, None, None, f"{type(e).__name__}: {e}"))
                        held += m.file_size
                        if held >= _HELD:
                            yield pd.DataFrame(rows, columns=columns).astype({"size": "Int64"})
                            rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=columns).astype({"size": "Int64"})

    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.zip").load(folder).select("path", "content")
    every = found.mapInPandas(members, "skill_key string, path string, bytes binary, size long, error string")
    if corrupt:
        return every.where("error is not null").select("skill_key", "path", "error")
    return _files(every.where("error is null").drop("error"))


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """The packages below a folder that have a manifest.json beside their files (version 1), or an archive that it names (version 2): only what the manifest lists, in its order and of its kind.

    Files that a manifest lists and that are not there, or not of the kind that it says, are there with null content."""
    read = lambda glob: spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    parent = lambda path: F.regexp_replace(path, r"/[^/]*$", "")
    found = manifest(read("manifest.json").select(parent(F.col("path")).alias("root"), F.decode("content", "UTF-8").alias("value"))).where("manifest is not null")
    each = found.select("root", F.regexp_extract("root", r"[^/]+$", 0).alias("folder"), "manifest", F.posexplode("manifest.files").alias("list_seq", "f"))
    each = each.select("root", F.coalesce("manifest.name", "folder").alias("skill_key"), F.col("manifest.compression").isNotNull().alias("packed"), F.coalesce("manifest.basePath", F.lit("")).alias("base"), "list_seq", F.col("f.path").alias("path"), F.col("f.size").alias("size"), F.coalesce("f.contentType", F.lit("text")).alias("content_type"))
    full = F.concat("root", F.lit("/"), F.when(F.rtrim("base", F.lit("/")) != "", F.concat(F.rtrim("base", F.lit("/")), F.lit("/"))).otherwise(""), "path")
    plain = read("*").select(F.col("path").alias("full"), F.col("content").alias("bytes"))
    loose = each.where("not packed").withColumn("full", full).join(plain, "full", "left").drop("full")
    zipped = archives(spark, folder).select("skill_key", "path", F.encode("content", "UTF-8").alias("bytes"))
    packed = each.where("packed").join(zipped, ["skill_key", "path"], "left")
    columns = ["skill_key", "path", F.coalesce("size", F.length("bytes").cast("long")).alias("size"), "content_type", F.when((F.col("content_type") != "binary") & is_text(F.col("bytes")), F.decode("bytes", "UTF-8")).alias("content"), "list_seq"]
    return loose.select(*columns).unionByName(packed.select(*columns))


def load(spark: SparkSession, source: str, ref: str | None = None, sub: str = "", many: bool = False, max_size: int | None = None) -> DataFrame:
    """By what the source is: a folder, or a folder at a git reference. Addresses need a network and are refused with their parts. max_size: as of local()."""
    if re.match(r"^https?://", source):
        parts = spark.range(1).select(urls.repository(F.lit(source)).alias("r")).first()["r"]
        raise ValueError(f"not a repository's address: {source}" if parts is None else f"no network: list {parts['owner']}/{parts['name']} elsewhere and pass its blobs to tree()")
    return git(spark, source, ref, sub) if ref else local(spark, source, sub, many, max_size)
