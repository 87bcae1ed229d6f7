"""Folder listings, change detection, content fingerprints and small text sources."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions import media
from lumenframe.functions.text import base_name

MIB = 1 << 20


def filesystem(path: str):
    """(file system, path within it) of a URI or a local path, on whichever machine this runs."""
    from urllib.parse import urlparse

    from pyarrow import fs

    u = urlparse(path)
    if u.scheme in ("", "file"):
        return fs.LocalFileSystem(), u.path if u.scheme else path
    return fs.FileSystem.from_uri(path)


def _below(prefix: str, folder: str):
    """(files, folders, error) right below a folder; a file is (path, size, mtime)."""
    from pyarrow import fs

    files, folders = [], []
    try:
        system, at = filesystem(folder)
        for x in system.get_file_info(fs.FileSelector(at)):
            path = prefix + x.path
            if x.type == fs.FileType.Directory:
                if not x.base_name.startswith("."):
                    folders.append(path)
            elif x.type == fs.FileType.File:
                files.append((path, x.size, (x.mtime_ns or 0) // 1_000_000))
    except OSError as e:
        return [], [], str(e)
    return files, folders, ""


def walk_roots(spark: SparkSession, roots: list[str], folders_a_task: int = 4) -> tuple[DataFrame, list[str]]:
    """(path, size, mtime in ms, kind of the stored files under ``roots``; the roots that were read without an error).

    Every file counts, empty ones and names with '_' too; dot folders are skipped. File contents aren't read. The driver
    lists folders from the top until there are some for each task; tasks walk what is below those. A root that can't be
    listed, or a part of it, isn't clean: nothing under it may be taken for missing."""
    rows, open_folders = [], [(r, r if "://" in r else r.rstrip("/") or "/") for r in roots]
    enough = folders_a_task * spark.sparkContext.defaultParallelism
    prefixes = {r: r[: r.index("://") + 3] + r[r.index("://") + 3 :].split("/")[0] if "://" in r and not r.startswith("file:") else "" for r in roots}
    while open_folders and len(open_folders) < enough:
        deeper = []
        for root, folder in open_folders:
            files, folders, error = _below(prefixes[root], folder)
            rows += [(root, *f, "") for f in files] + ([(root, folder, 0, 0, error)] if error else [])
            deeper += [(root, f) for f in folders]
        open_folders = deeper
    schema = "root string, path string, size long, mtime long, error string"
    here = spark.createDataFrame(rows, schema)
    if open_folders:

        def run(batches):
            for pdf in batches:
                for root, top in zip(pdf["root"], pdf["path"]):
                    todo = [top]
                    while todo:
                        folder = todo.pop()
                        files, folders, error = _below(prefixes[root], folder)
                        todo += folders
                        out = [(root, *f, "") for f in files] + ([(root, folder, 0, 0, error)] if error else [])
                        if out:
                            yield pd.DataFrame(out, columns=["root", "path", "size", "mtime", "error"])

        tops = spark.createDataFrame(open_folders, "root string, path string").repartition(min(len(open_folders), enough))
        here = here.unionByName(tops.mapInPandas(run, schema))
    here = here.checkpoint() if spark.sparkContext.getCheckpointDir() else here.cache()  # one look at the folders for both answers
    bad = {r["root"] for r in here.where("error <> ''").select("root").distinct().collect()}  # at most the roots
    files = here.where("error = ''").select("path", "size", "mtime").withColumn("kind", media.kind("path"))
    return files.where(media.stored("kind")), [r for r in roots if r not in bad]


def walk(spark: SparkSession, root: str) -> DataFrame:
    """The files of ``walk_roots`` under one root."""
    return walk_roots(spark, [root])[0]


def fingerprint_bytes(head: bytes, tail: bytes | None, size: int) -> str:
    """First 32 hex digits of SHA-256 over the whole content (up to 2 MiB) or its first and last MiB, and the size as 8 bytes, low first; '' if empty."""
    if size == 0:
        return ""
    h = hashlib.sha256(head)
    if tail is not None:
        h.update(tail)
    h.update(size.to_bytes(8, "little"))
    return h.hexdigest()[:32]


def fingerprint_file(path: str) -> str:
    """Of a local path or a URI that ``pyarrow`` can open; only the first and last MiB of a large file are read."""
    system, at = filesystem(path)
    with system.open_input_file(at) as f:
        size = f.size()
        if size <= 2 * MIB:
            return fingerprint_bytes(f.read(), None, size)
        head = f.read(MIB)
        f.seek(size - MIB)
        return fingerprint_bytes(head, f.read(MIB), size)


def fingerprints(files: DataFrame) -> DataFrame:
    """files(path, ...) with fingerprint of each: ranged reads by path, so a file's size doesn't matter. Unreadable now: null."""

    def run(batches):
        for pdf in batches:
            out = []
            for p in pdf["path"]:
                try:
                    out.append(fingerprint_file(p))
                except OSError:
                    out.append(None)
            yield pdf.assign(fingerprint=out)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields if f.name != "fingerprint")
    return files.drop("fingerprint").mapInPandas(run, f"{schema}, fingerprint string")


def content_fingerprint(content, size):
    """The same fingerprint of a binary column of at most 2 MiB, inside the JVM: SHA-256 of content and its size in 8 bytes."""
    tail = F.unhex(F.concat(*[F.lpad(F.hex(F.shiftright(size, 8 * i).bitwiseAND(F.lit(255))), 2, "0") for i in range(8)]))
    return F.when(size == 0, "").otherwise(F.substring(F.sha2(F.concat(content, tail), 256), 1, 32))


def changed(listing: DataFrame, known: DataFrame) -> DataFrame:
    """listing with the known fingerprint where size and mtime still agree, else null (to be hashed). Empty files and those never hashed are hashed again."""
    k = known.select("path", F.col("size").alias("_s"), F.col("mtime").alias("_m"), F.col("fingerprint").alias("_f"))
    same = (F.col("_s") == F.col("size")) & (F.col("_m") == F.col("mtime")) & (F.col("_f") != "") & (F.col("size") > 0)
    return listing.join(k, "path", "left").withColumn("fingerprint", F.when(~media.fingerprinted("kind"), "").when(same, F.col("_f"))).drop("_s", "_m", "_f")


def scan(listing: DataFrame, known: DataFrame) -> DataFrame:
    """A scan's files: unchanged ones keep their fingerprint, the others are hashed. One that can't be read now keeps all
    that is known of it; a new one has no fingerprint until a later scan can read it."""
    rows = changed(listing, known)
    hashed = fingerprints(rows.where("fingerprint is null"))
    state = ("size", "mtime", "kind", "fingerprint")
    before = known.select("path", *[F.col(c).alias(f"_{c}") for c in state])
    lost = F.col("fingerprint").isNull()
    old = {c: F.when(lost, F.coalesce(f"_{c}", F.lit("") if c == "fingerprint" else c)).otherwise(F.col(c)).alias(c) for c in state}
    hashed = hashed.join(before, "path", "left").select(*[old.get(c, F.col(c)) for c in rows.columns])
    return rows.where("fingerprint is not null").unionByName(hashed)


def nfo_ids(texts: DataFrame) -> DataFrame:
    """dir, imdb_id: the first id in the first 64 KiB of a folder's info files, in path order. texts: path, text."""
    found = F.regexp_extract(F.substring("text", 1, 65536), r"tt\d{7,8}", 0)
    rows = texts.select(F.regexp_extract("path", "^(.*)/", 1).alias("dir"), "path", found.alias("imdb_id")).where("imdb_id <> ''")
    return rows.groupBy("dir").agg(F.min_by("imdb_id", "path").alias("imdb_id"))


def check_roots(roots: list[str]) -> list[str]:
    """Normal form of configured roots; repeated or nested ones are refused."""
    out = []
    for r in roots:
        r = r.replace("\\", "/").rstrip("/") or "/"
        if r in out:
            raise ValueError(f"repeated root: {r}")
        out.append(r)
    for a in out:
        for b in out:
            if a != b and b.startswith(a + "/"):
                raise ValueError(f"{b} is inside {a}")
    return out


def root_of(path, roots: list[str]):
    """The first root that holds a path, '' if none does."""
    out = F.lit("")
    for r in reversed(roots):
        out = F.when(path.startswith(r.rstrip("/") + "/"), r).otherwise(out)
    return out


def under_any(path, roots: list[str]):
    return root_of(path, roots) != ""


def status(files: DataFrame, media_rows: DataFrame) -> DataFrame:
    """Counters of a catalog: files, present, hashed, probed, failed."""
    f = files.agg(F.count("*").alias("files"), F.count_if(~F.col("missing")).alias("present"), F.count_if(F.col("fingerprint") != "").alias("hashed"))
    m = media_rows.agg(F.count_if(F.col("error") == "").alias("probed"), F.count_if(F.col("error") != "").alias("failed"))
    return f.join(m)


def file_name(path):
    return base_name(path)

