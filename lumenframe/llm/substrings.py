"""Incremental removal of repeated passages with a log-structured fingerprint index.

A window is ``WINDOW`` consecutive words of one document. Every window is filed under its anchor, the least hash of
its ``GRAM``-word grams: equal windows have equal anchors, and neighbouring windows mostly share one, so the index
holds some 8 entries for 100 words and misses no window. Each batch of documents becomes an immutable run of
(anchor, document), sorted and bucketed by anchor; it is merge-joined with the earlier runs without moving them.
Documents that share an anchor are then read again, and their windows under it are compared by a hash made from other
64-bit hashes of their words (verification: two windows are taken for equal if 128 bits that share no step agree). Runs
are compacted into one when there are too many. A manifest beside the runs lists them, so a later session goes on.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.common import WordIds, lean, partitions, ready, saved, scratch, table

WINDOW, GRAM = 50, 25
#: Odd bases of the two polynomial hashes, and their inverses modulo 2^64.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
INVERSES = tuple(pow(b, -1, 1 << 64) for b in BASES)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    if base not in _POWERS or len(_POWERS[base]) < n:
        with np.errstate(over="ignore"):
            _POWERS[base] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n, 1 << 15), base, np.uint64))])
    return _POWERS[base][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def rolled(words: np.ndarray, n: int, which: int) -> np.ndarray:
    """Hash of every run of ``n`` words, from prefix sums of words * base^i."""
    at = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers(BASES[which], len(words)))])
    return mixed((at[n:] - at[:-n]) * powers(INVERSES[which], len(at) - n))


def anchors(words: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window: the place of its anchor (the leftmost least gram), and the hashes of all grams."""
    g = rolled(words, gram, 0)
    span = window - gram + 1
    val, at, have = g, np.arange(len(g)), 1
    while have < span:
        step = min(have, span - have)
        left, right = val[: len(val) - step], val[step:]
        less = right < left
        at = np.where(less, at[step:], at[: len(at) - step])
        val = np.where(less, right, left)
        have += step
    return at, g


def word_hashes(seed: int = 0) -> WordIds:
    import xxhash

    return WordIds(lambda w: xxhash.xxh3_64_intdigest(w, seed))


def split(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ in UTF-8: what bytes.split() cuts at is exactly that white space."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, key, text; key tells rows of one doc_id apart."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", text).alias("key"), text.alias("text"))


MANIFEST = "generation long, name string, location string, buckets int, window int, gram int, most_runs int, hot_docs int"


class FingerprintIndex:
    """Runs of the documents seen so far, under ``path``. add(batch) files a batch and gives the rows to verify."""

    def __init__(self, spark: SparkSession, window: int = WINDOW, gram: int = GRAM, most_runs: int = 4, hot_docs: int = 1000, buckets: int | None = None, path: str | None = None):
        self.spark, self.window, self.gram = ready(spark), window, gram
        self.most_runs, self.hot_docs, self.buckets = most_runs, hot_docs, buckets or partitions(spark)
        self.path, self.generation = path or scratch(spark, "index"), 0
        self.runs: list[str] = []

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> FingerprintIndex:
        """The index that an earlier session left under ``path``, as of its last whole generation."""
        rows = spark.read.schema(MANIFEST).json(f"{path}/manifest")
        last = rows.where(F.col("generation") == (rows.agg(F.max("generation")).first()[0] or 0)).orderBy("name").collect()  # a row a run
        if not last:
            raise FileNotFoundError(f"no index under {path}")
        one = last[0]
        out = cls(spark, one["window"], one["gram"], one["most_runs"], one["hot_docs"], one["buckets"], path)
        out.generation, out.runs = one["generation"], [r["name"] for r in last]
        for r in last:
            if not spark.catalog.tableExists(r["name"]):
                spark.sql(f"CREATE TABLE {r['name']} (g BIGINT, doc_id BIGINT, key BIGINT) USING parquet CLUSTERED BY (g) SORTED BY (g) INTO {r['buckets']} BUCKETS LOCATION '{r['location']}'")
        return out

    def _commit(self) -> None:
        """Add a generation to the manifest: readers see all of its runs or none."""
        self.generation += 1
        rows = [(self.generation, name, f"{self.path}/{name}", self.buckets, self.window, self.gram, self.most_runs, self.hot_docs) for name in self.runs]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").json(f"{self.path}/manifest")

    def _write(self, rows: DataFrame) -> str:
        name = f"lumenframe_run_{uuid.uuid4().hex}"
        (
            rows.repartition(self.buckets, "g").write.format("parquet").option("compression", "zstd")
            .bucketBy(self.buckets, "g").sortBy("g").option("path", f"{self.path}/{name}").saveAsTable(name)
        )
        return name

    def add(self, docs: DataFrame) -> DataFrame:
        """File the windows of ``docs``; return (doc_id, key, g, hot) of all documents, old and new, that share an anchor with a new one and another document.

        hot: more than ``hot_docs`` documents have the anchor. Rows without doc_id aren't filed.
        """
        window, gram = self.window, self.gram

        def run(batches):
            ids = word_hashes()
            for b in batches:
                g, doc, key = [], [], []
                for d, k, t in zip(b.column("doc_id").to_pylist(), b.column("key").to_pylist(), b.column("text").to_pylist()):
                    words = split(t)
                    if len(words) >= window:
                        at, grams = anchors(np.fromiter(map(ids.__getitem__, words), np.uint64, len(words)), window, gram)
                        got = np.unique(grams[np.unique(at)])
                        g.append(got)
                        doc.append(np.full(len(got), d, np.int64))
                        key.append(np.full(len(got), k, np.int64))
                cat = lambda x, k: np.concatenate([np.zeros(0, k), *x])
                yield pa.RecordBatch.from_arrays([pa.array(cat(g, np.uint64).view(np.int64)), pa.array(cat(doc, np.int64)), pa.array(cat(key, np.int64))], names=["g", "doc_id", "key"])

        new = self._write(_keyed(docs).where("doc_id is not null").mapInArrow(lean(run), "g long, doc_id long, key long"))
        ends = lambda name: self.spark.table(name).groupBy("g").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z"), F.count("*").alias("n"))
        # merge joins of tables that are bucketed and sorted alike: nothing is moved
        both = ends(new)
        for name in self.runs:
            old = ends(name).select("g", F.col("a").alias("oa"), F.col("z").alias("oz"), F.col("n").alias("on"))
            both = both.join(old, "g", "left").select("g", F.least("a", "oa").alias("a"), F.greatest("z", "oz").alias("z"), (F.col("n") + F.coalesce("on", F.lit(0))).alias("n"))
        shared = saved(both.where("a < z").select("g", (F.col("n") > self.hot_docs).alias("hot")), "shared-anchors")
        out = None
        for name in [*self.runs, new]:
            rows = self.spark.table(name).join(shared.hint("merge"), "g").select("doc_id", "key", "g", "hot")
            out = rows if out is None else out.unionByName(rows)
        self.runs.append(new)
        if len(self.runs) > self.most_runs:
            out = saved(out, "shared-rows")  # it reads the runs that go now
            self.compact()
        else:
            self._commit()
        return out

    def compact(self) -> None:
        """One run of all. Files of the old ones stay, for what reads them still, until ``vacuum``."""
        old, rows = self.runs, None
        for name in old:
            rows = self.spark.table(name) if rows is None else rows.unionByName(self.spark.table(name))
        self.runs = [self._write(rows)]
        self._commit()
        for name in old:
            self.spark.sql(f"DROP TABLE {name}")

    def vacuum(self) -> None:
        """Remove the files of runs that the last generation doesn't list; rows that add() gave before must have been used."""
        top = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for f in files.listStatus(top):
            if f.getPath().getName().startswith("lumenframe_run_") and f.getPath().getName() not in self.runs:
                files.delete(f.getPath(), True)


def repeated(docs: DataFrame, shared: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, key, spans: runs of first words [a, z] of windows that also start in a document with a smaller doc_id.

    shared: doc_id, key, g, hot (from FingerprintIndex.add). An anchor's documents meet in one task, in order of
    doc_id, with only the first document of each window in memory; hot anchors go window by window through partial
    minima and a join that Spark splits, however many documents have them.
    """
    spark = ready(docs.sparkSession)
    n = partitions(spark)
    lists = shared.groupBy("doc_id", "key").agg(F.collect_set(F.struct("g", "hot")).alias("gs"))

    def run(batches):
        ids, others = word_hashes(), word_hashes(1)
        for b in batches:
            cols = [[] for _ in range(6)]
            for d, k, t, gs in zip(*(b.column(c).to_pylist() for c in ("doc_id", "key", "text", "gs"))):
                words = split(t)
                if len(words) < window:
                    continue
                h = np.fromiter(map(ids.__getitem__, words), np.uint64, len(words))
                at, g = anchors(h, window, gram)
                hashes = rolled(np.fromiter(map(others.__getitem__, words), np.uint64, len(words)), window, 1).view(np.int64)
                hot = dict(sorted((x["g"], x["hot"]) for x in gs))  # an anchor that has become hot since: True comes last
                first = np.nonzero(np.concatenate([[True], at[1:] != at[:-1]]))[0]
                last = np.concatenate([first[1:], [len(at)]])
                for a, z, x in zip(first.tolist(), last.tolist(), g[at[first]].view(np.int64).tolist()):
                    if x in hot:
                        for c, v in zip(cols, (x, hot[x], d, k, a, hashes[a:z])):
                            c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64())))], names=["g", "hot", "doc_id", "key", "at", "hashes"])

    # written once: both ways read it
    rows = saved(_keyed(docs).join(lists, ["doc_id", "key"]).mapInArrow(lean(run), "g long, hot boolean, doc_id long, key long, at int, hashes array<long>"), "windows")

    def compare(batches):
        now, seen = None, {}
        for b in batches:
            out = [[] for _ in range(4)]
            for g, d, k, at, hashes in zip(*(b.column(c).to_pylist() for c in ("g", "doc_id", "key", "at", "hashes"))):
                if g != now:
                    now, seen = g, {}
                start = None
                for s, h in enumerate(hashes, at):
                    if seen.setdefault(h, d) < d:
                        start = s if start is None else start
                    elif start is not None:
                        for c, v in zip(out, (d, k, start, s - 1)):
                            c.append(v)
                        start = None
                if start is not None:
                    for c, v in zip(out, (d, k, start, at + len(hashes) - 1)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["doc_id", "key", "a", "z"])

    usual = rows.where("not hot").drop("hot").repartition(n, "g").sortWithinPartitions("g", "doc_id").mapInArrow(lean(compare), "doc_id long, key long, a int, z int")
    each = rows.where("hot").select("g", "doc_id", "key", F.posexplode("hashes").alias("i", "h"), "at")
    # minima and join are queries of their own, written: Spark splits a skewed join's partitions only between plain exchanges
    firsts = saved(each.groupBy("g", "h").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("g", "h", "first"), "hot-firsts")
    place = (F.col("at") + F.col("i")).alias("a"), (F.col("at") + F.col("i")).alias("z")
    hot = saved(each.join(firsts.hint("merge"), ["g", "h"]).where("first < doc_id").select("doc_id", "key", *place), "hot-windows")
    return usual.unionByName(hot).groupBy("doc_id", "key").agg(F.collect_list(F.struct("a", "z")).alias("spans"))


def removed(docs: DataFrame, spans: DataFrame, window: int = WINDOW, texts: bool = False) -> DataFrame:
    """n_words, n_removed and kept_sha256 (or, with ``texts``, the kept words as text and n_removed) of every row, beside its other columns."""
    ready(docs.sparkSession)
    names = docs.columns
    rows = docs.withColumn("_key", F.xxhash64(F.col("doc_id"), F.col("text").cast("string"))).withColumn("_id", F.col("doc_id").cast("long"))
    joined = rows.join(spans.select(F.col("doc_id").alias("_id2"), F.col("key").alias("_key2"), F.col("spans").alias("_spans")), F.expr("_id = _id2 and _key = _key2"), "left").drop("_key", "_key2", "_id", "_id2")
    if not texts:
        joined = joined.select("doc_id", F.col("text").cast("string").alias("text"), "_spans")

    def kept(text, spans):
        words = split(text)
        if not spans:
            return words, len(words)
        edge = np.zeros(len(words) + 1, np.int32)
        np.add.at(edge, [x["a"] for x in spans], 1)
        np.add.at(edge, [x["z"] + window for x in spans], -1)
        keep = np.cumsum(edge[:-1]) == 0
        return [w for w, k in zip(words, keep.tolist()) if k], len(words)

    def digest(batches):
        for b in batches:
            got = [kept(t, s) for t, s in zip(b.column("text").to_pylist(), b.column("_spans").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([n for _, n in got], pa.int64()), pa.array([n - len(w) for w, n in got], pa.int64()), pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w, _ in got], pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    if not texts:
        return joined.mapInArrow(lean(digest), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string")

    def rewrite(batches):
        for b in batches:
            got = [kept(t, s) if s else (None, 0) for t, s in zip(b.column("text").to_pylist(), b.column("_spans").to_pylist())]
            text = [t if w is None else b" ".join(w).decode("utf-8", "surrogatepass") for t, (w, _) in zip(b.column("text").to_pylist(), got)]
            cut = [0 if w is None else n - len(w) for w, n in got]
            cols = {c: b.column(c) for c in names} | {"text": pa.array(text, pa.string()), "n_removed": pa.array(cut, pa.int64())}
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    kind = ", ".join(f"`{f.name}` {'string' if f.name == 'text' else f.dataType.simpleString()}" for f in docs.schema.fields)
    return joined.mapInArrow(lean(rewrite), f"{kind}, n_removed long")


def shared_rows(docs: DataFrame, n_batches: int = 2, **options) -> DataFrame:
    """File ``docs`` in ``n_batches`` batches of rising doc_id, as they would come in over time."""
    index = FingerprintIndex(docs.sparkSession, **options)
    edges = [int(x) for x in docs.select(F.col("doc_id").cast("long").alias("doc_id")).approxQuantile("doc_id", [i / n_batches for i in range(1, n_batches)], 0.01)]
    edges = sorted(set(edges))
    out = None
    for lo, hi in zip([None, *edges], [*edges, None]):
        batch = docs if lo is None else docs.where(F.col("doc_id") >= lo)
        rows = index.add(batch if hi is None else batch.where(F.col("doc_id") < hi))
        out = rows if out is None else out.unionByName(rows)
    return out


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document without the words of repeated windows: doc_id, n_words, n_removed, kept_sha256.

    Null text: no words. Rows of one doc_id aren't earlier than each other; a row without doc_id is kept whole."""
    docs = table(spark, sf_dir, "documents")
    return removed(docs, repeated(docs, shared_rows(docs)))


OP4_SQL = """
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
h AS (SELECT doc_id, i, sha256(array_to_string(list_slice(w, i, i + 49), ' ')) AS h FROM s),
f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS first FROM h),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM f WHERE first < doc_id),
r AS (SELECT doc_id, list(p) AS gone FROM c GROUP BY doc_id),
k AS (SELECT d.doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed, CASE WHEN gone IS NULL THEN w ELSE list_select(w, list_filter(range(1, len(w) + 1), lambda p: NOT list_contains(gone, p))) END AS kept FROM d LEFT JOIN r USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""
