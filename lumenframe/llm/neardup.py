"""Near duplicates by improved consistent weighted sampling.

A document is the weighted set of its 5-word shingles: times in the text, by the mean inverse document frequency of
the shingle's words (counted over all documents; a shingle's own document frequency is that of its copies, which would
make the words that copies share light and what sets them apart heavy). Weighted samples agree with the probability of
the weighted Jaccard similarity; bands of samples propose, the weighted Jaccard similarity itself decides.

Texts that are equal are one node. In a bucket every node is compared with one hub, not with each other. Buckets in
which the links found so far leave several classes are looked at again. Where that may be much work, the bucket is
first dealt into random groups of bounded size, a few times over, whose documents are compared until one class joins
them: what belongs together mostly is together then. In what still holds several classes, documents outside the first
class are compared with all others of the bucket that they aren't joined to yet: in one task where that is little work,
else as further hubs, 4 times as many a bucket in each round. So no two documents of a bucket stay apart without having
been compared with each other, or with what joins them, and rounds grow with the logarithm of a bucket.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenframe.llm.common import hashed_words, lean, partitions, ready, saved, table
from lumenframe.llm.substrings import mixed

SHINGLE, LEAST_SIMILARITY = 5, 0.8
SAMPLES, ROWS = 64, 4  # 16 bands of 4: a pair at 0.8 is missed with probability 0.0002
BITS, TABLE = 18, 1 << 14
BUCKETS = 1 << BITS


class Shingles:
    """texts -> sorted shingle hashes and their weights of each. Words: runs of letters and digits, lower case. A text of fewer than 5 words is one shingle."""

    def __init__(self, idf: np.ndarray):
        self.idf = idf

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        return self.many([text])[0]

    def many(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        return [self._of(h) if len(h) else (h, np.zeros(0)) for h in hashed_words(texts, 64)]

    def _of(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s, weight, tf = self.counted(h)
        return s, weight * tf

    def counted(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted shingle hashes of a text's word hashes, the weight of one occurrence of each (the same in every text), and how often it has each."""
        w = self.idf[(h >> np.uint64(64 - BITS)).astype(np.int64)]
        n = min(SHINGLE, len(h))
        s, v = np.zeros(len(h) - n + 1, np.uint64), np.zeros(len(h) - n + 1)
        for i in range(n):
            s = mixed(s + h[i : len(h) - n + 1 + i])
            v += w[i : len(w) - n + 1 + i]
        s, first, tf = np.unique(s, return_index=True, return_counts=True)
        return s, v[first] / n, tf


def similarity(a, b) -> float:
    """Weighted Jaccard of two (hashes, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = np.minimum(a[1][i], b[1][j]).sum()
    both = a[1].sum() + b[1].sum() - low
    return float(low / both) if both > 0 else 0.0


_RANDOM: list[tuple] = []


def _random():
    """r, 1/r, ln c and beta of each table row and sample, the same in every process."""
    if not _RANDOM:
        g = np.random.Generator(np.random.PCG64(20_240_229))
        r = g.gamma(2, 1, (TABLE, SAMPLES)).astype(np.float32)
        _RANDOM.append((r, 1 / r, np.log(g.gamma(2, 1, (TABLE, SAMPLES))).astype(np.float32), g.random((TABLE, SAMPLES), np.float32)))
    return _RANDOM[0]


def samples(hashes: np.ndarray, weights: np.ndarray, block: int = 1024) -> np.ndarray:
    """One 64-bit sample (shingle and quantum) for each of SAMPLES; the least of equal ones by hash."""
    r, inv, lnc, beta = _random()
    best, at, quantum = np.full(SAMPLES, np.inf, np.float32), np.zeros(SAMPLES, np.int64), np.zeros(SAMPLES, np.float32)
    k = np.arange(SAMPLES)
    kept = np.empty((4, min(block, len(hashes)), SAMPLES), np.float32)  # one buffer for all blocks
    for i in range(0, len(hashes), block):
        row = (hashes[i : i + block] >> np.uint64(20)).astype(np.int64) & (TABLE - 1)
        t, be, a, of = kept[:, : len(row)]
        for x, out in ((inv, t), (beta, be), (r, a), (lnc, of)):
            np.take(x, row, 0, out, "clip")
        t *= np.log(weights[i : i + block]).astype(np.float32)[:, None]
        t += be
        np.floor(t, out=t)
        np.subtract(t, be, out=be)
        be += 1
        a *= be
        np.subtract(of, a, out=a)
        j = a.argmin(0)
        low = a[j, k]
        less = low < best
        best[less], at[less], quantum[less] = low[less], j[less] + i, t[j, k][less]
    return mixed(hashes[at] + quantum.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def bands(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    x = samples(hashes, weights).reshape(-1, ROWS)
    out = np.arange(1, len(x) + 1, dtype=np.uint64)
    for i in range(ROWS):
        out = mixed(out + x[:, i])
    return out.view(np.int64)


def word_idf(docs: DataFrame) -> np.ndarray:
    """Inverse document frequency of each word bucket, over all documents. The driver gets at most BUCKETS rows."""

    def count(batches):
        df, n = np.zeros(BUCKETS, np.int64), 0
        for b in batches:
            for w in hashed_words(b.column("text").to_pylist(), BITS):
                df[w] += 1  # once a document: repeated places of an index count once
                n += 1
        at = np.nonzero(df)[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], names=["b", "n"])

    got = docs.select(F.col("text").cast("string")).mapInArrow(lean(count), "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).toArrow()
    at, sums = got["b"].to_numpy(), got["n"].to_numpy()
    df, n = np.zeros(BUCKETS), int(sums[at < 0].sum()) if len(at) else 1
    df[at[at >= 0]] = sums[at >= 0]
    return np.log((n + 1) / (df + 0.5)).clip(0.1)


def nodes(docs: DataFrame, idf) -> DataFrame:
    """doc_id, same (digest of the text), size (of the text) and bands of every document with a text; written once."""

    def run(batches):
        shingles = Shingles(idf.value)
        for b in batches:
            out = [bands(h, w) if len(h) else np.zeros(0, np.int64) for h, w in shingles.many(b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("same"), b.column("size"), pa.array(out, pa.list_(pa.int64()))], names=["doc_id", "same", "size", "bands"])

    text = F.col("text").cast("string")
    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.encode(text, "UTF-8")).alias("same"), F.length(text).alias("size"), text.alias("text"))
    return saved(rows.mapInArrow(lean(run), "doc_id long, same string, size int, bands array<long>"), "near-nodes")


def star(pairs: DataFrame, texts: DataFrame, idf, least: float, salt_rows: int = 500) -> DataFrame:
    """doc_id, hub and sim of the pairs that are at least so similar. A hub's text meets its documents' in as many tasks as they need."""
    spark = pairs.sparkSession
    # written: Spark splits a skewed join's partitions only between plain exchanges
    per = saved(pairs.groupBy("hub").agg(F.ceil(F.count("*") / salt_rows).cast("int").alias("salts")), "near-salts")
    left = pairs.join(per, "hub").select("hub", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int").alias("salt"), "doc_id", F.lit(1).alias("o"))
    hubs = per.select("hub", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("hub").alias("doc_id"), F.lit(0).alias("o"))
    rows = left.unionByName(hubs).join(texts, "doc_id").repartition(partitions(spark), "hub", "salt").sortWithinPartitions("hub", "salt", "o", "doc_id")

    def run(batches):
        shingles, now, mine = Shingles(idf.value), None, None
        for b in batches:
            out = []
            for hub, salt, doc, o, t in zip(*(b.column(c).to_pylist() for c in ("hub", "salt", "doc_id", "o", "text"))):
                if o == 0:
                    if now != (hub, salt):
                        now, mine = (hub, salt), shingles(t)
                elif now == (hub, salt):
                    s = similarity(shingles(t), mine)
                    if s >= least:
                        out.append((doc, hub, s))
            yield _links(out)

    return rows.select("hub", "salt", "doc_id", "o", "text").mapInArrow(lean(run), LINKS)


def similarities(sets: list[tuple], few: np.ndarray, often: int = 32, block: int = 2048) -> np.ndarray:
    """Weighted Jaccard of the sets (hashes, weight of one, times) at ``few`` with all sets: len(few) x len(sets).

    A shingle that a set has k times is k features of one weight, so what two sets share is a sum over features: of those
    in more than ``often`` sets by products of blocks of 0s and 1s, of the others pair by pair."""
    n = len(sets)
    times = np.concatenate([x[2] for x in sets])
    level = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    key = mixed(np.repeat(np.concatenate([x[0] for x in sets]), times) + level.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    weight = np.repeat(np.concatenate([x[1] for x in sets]), times)
    doc = np.repeat(np.arange(n), [int(x[2].sum()) for x in sets])
    total = np.bincount(doc, weight, n)
    _, feature, df = np.unique(key, return_inverse=True, return_counts=True)
    row = np.full(n, -1)
    row[few] = np.arange(len(few))
    both = np.zeros(len(few) * n)
    some = (df[feature] > 1) & (df[feature] <= often)
    by = np.argsort(feature[some], kind="stable")
    f, d, w = feature[some][by], doc[some][by], weight[some][by]
    for lag in range(1, often):
        at = np.nonzero(f[lag:] == f[: len(f) - lag])[0]
        if not len(at):
            break
        for x, y in ((d[at], d[at + lag]), (d[at + lag], d[at])):
            mine = row[x] >= 0
            both += np.bincount(row[x[mine]] * n + y[mine], w[at][mine], len(both))
    both = both.reshape(len(few), n)
    rank = np.cumsum(df > often) - 1
    some = df[feature] > often
    f, d, w = rank[feature[some]], doc[some], weight[some]
    by = np.argsort(f, kind="stable")
    f, d, w = f[by], d[by], w[by]
    for i in range(0, int(rank[-1]) + 1 if len(rank) else 0, block):
        a, z = np.searchsorted(f, (i, i + block))
        has = np.zeros((n, block), np.float32)
        has[d[a:z], f[a:z] - i] = 1
        worth = np.zeros(block, np.float32)
        worth[f[a:z] - i] = w[a:z]
        both += (has[few] * worth) @ has.T
    return both / np.maximum(total[few][:, None] + total - both, 1e-12)


def small_groups(groups: DataFrame, texts: DataFrame, idf, least: float) -> DataFrame:
    """Links within groups (gid, doc_id, label) of bounded size, between documents that no link joins so far (label: their class)."""
    spark = groups.sparkSession

    def settle(ids: list[int], labels: list[int], texts: list, shingles: Shingles) -> list:
        root: dict = {x: x for x in labels}

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        classes, size = np.unique(labels, return_counts=True)
        few = np.nonzero(np.array(labels) != classes[size.argmax()])[0] if ids else []
        if not len(few):
            return []
        words = hashed_words(texts, 64)
        sim = similarities([shingles.counted(h) for h in words], few)
        out = []
        for k, j in zip(*(x.tolist() for x in np.nonzero(sim >= least))):
            i = int(few[k])
            a, b = find(labels[i]), find(labels[j])
            if a != b:  # enough links to join what belongs together
                root[a] = b
                out.append((max(ids[i], ids[j]), min(ids[i], ids[j]), min(1.0, float(sim[k, j]))))
        return out

    def run(batches):
        shingles, now, held = Shingles(idf.value), None, ([], [], [])
        for b in batches:
            out: list = []
            for g, d, x, t in zip(*(b.column(c).to_pylist() for c in ("gid", "doc_id", "label", "text"))):
                if g != now:
                    out += settle(*held, shingles)
                    now, held = g, ([], [], [])
                for c, v in zip(held, (d, x, t)):
                    c.append(v)
            yield _links(out)
        yield _links(settle(*held, shingles))

    rows = groups.join(texts, "doc_id").select("gid", "doc_id", "label", "text").repartition(partitions(spark), "gid").sortWithinPartitions("gid", "doc_id")
    return rows.mapInArrow(lean(run), LINKS)


LINKS = "doc_id long, hub long, sim double"


def _links(out: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 3, (pa.int64(), pa.int64(), pa.float64()))], names=["doc_id", "hub", "sim"])


def mixed_buckets(members: DataFrame, found: DataFrame, task_pairs: int, task_bytes: int) -> DataFrame:
    """band, n, bytes, doc_id, label (class so far), out (of the bucket's first class) and little (work enough for a task)
    of the buckets that hold several classes; written. Aggregates are written before they are joined on their own key."""
    rows = saved(members.join(components(found), "doc_id", "left").select("band", "n", "bytes", "doc_id", F.coalesce("class_id", "doc_id").alias("label")), "near-labels")
    first = rows.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("band", "lo")
    rows = saved(rows.join(saved(first, "near-mixed").hint("merge"), "band").withColumn("out", F.col("label") != F.col("lo")).drop("lo"), "near-outside")
    work = rows.groupBy("band").agg((F.sum(F.col("out").cast("long")) * F.first("n")).alias("pairs"), F.first("bytes").alias("all"))
    work = saved(work.select("band", ((F.col("pairs") <= task_pairs) & (F.col("all") <= task_bytes)).alias("little")), "near-work")
    return saved(rows.join(work.hint("merge"), "band"), "near-rest")


def links(docs: DataFrame, reps: DataFrame, idf, least: float = LEAST_SIMILARITY, task_pairs: int = 4_000_000, task_bytes: int = 16 << 20, group_docs: int = 1024, deals: int = 3, more_hubs: int = 4) -> DataFrame:
    """Links the bands propose between texts that differ, as (doc_id, hub, sim): enough of them to join all that belongs together.

    First every document of a bucket against one hub. Then only buckets that still hold several classes. Those of more
    than ``task_pairs`` comparisons or ``task_bytes`` of text are dealt into groups of ``group_docs``, each document in
    one group (of its largest bucket) a deal. Then buckets of little work are settled in a task, the others against
    some ``more_hubs`` to the power of the round's number documents outside the first class, until all such have been hubs."""
    members = reps.select("doc_id", "size", F.explode("bands").alias("band"))
    # aggregates are written before they are joined on their own key, so Spark can split a bucket that many documents share
    shared = saved(members.groupBy("band").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.min("doc_id").alias("hub")).where("n > 1"), "near-buckets")
    members = saved(members.drop("size").join(shared.hint("merge"), "band"), "near-members")
    ids = members.select("doc_id").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    texts = saved(texts.join(ids.hint("merge"), "doc_id", "left_semi"), "near-texts")
    found = saved(star(members.where("doc_id <> hub").select("doc_id", "hub").distinct(), texts, idf, least), "near-stars")
    members = members.drop("hub")
    rest = mixed_buckets(members, found, task_pairs, task_bytes)
    for deal in range(deals):
        much = rest.where("not little")
        if much.isEmpty():
            break
        own = much.groupBy("doc_id").agg(F.max(F.struct("n", F.xxhash64("band", F.lit(deal)).alias("h"), "band", "bytes")).alias("x"), F.first("label").alias("label"))
        groups = F.ceil(F.greatest(F.col("x.n") / group_docs, F.col("x.bytes") / task_bytes))
        dealt = own.select(F.xxhash64("x.band", F.pmod(F.xxhash64("doc_id", F.lit(deal)), groups)).alias("gid"), "doc_id", "label")
        found = found.unionByName(saved(small_groups(dealt, texts, idf, least), "near-dealt"))
        rest = mixed_buckets(members, found, task_pairs, task_bytes)
    same = rest.where("little").groupBy("band").agg(F.sort_array(F.collect_list(F.struct("doc_id", "label"))).alias("m")).select("m").distinct()
    groups = same.select(F.xxhash64("m").alias("gid"), F.explode("m").alias("x")).select("gid", "x.doc_id", "x.label")
    found = found.unionByName(saved(small_groups(groups, texts, idf, least), "near-small"))
    rest = rest.where("not little")
    tried = rest.select("band", "doc_id").limit(0)
    share = more_hubs / (rest.agg(F.max("n")).first()[0] or 1)
    turn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))  # a document is a hub in all its buckets at once
    while share < more_hubs and not rest.isEmpty():
        hubs = rest.where("out").where(turn < share).join(tried, ["band", "doc_id"], "left_anti")
        hubs = saved(hubs.select("band", F.col("doc_id").alias("hub"), F.col("label").alias("hub_label")), "near-hubs")
        # a band's hubs are a stated set of queries against its documents of other classes that haven't been hubs before
        pairs = rest.join(tried, ["band", "doc_id"], "left_anti").join(hubs, "band").where("label <> hub_label")
        pairs = pairs.select(F.greatest("doc_id", "hub").alias("doc_id"), F.least("doc_id", "hub").alias("hub")).distinct()
        found = found.unionByName(saved(star(pairs, texts, idf, least), "near-stars"))
        tried = tried.unionByName(hubs.select("band", F.col("hub").alias("doc_id")))
        rest = mixed_buckets(members.join(rest.select("band").distinct(), "band", "left_semi"), found, task_pairs, task_bytes)
        share *= more_hubs
    return found


def components(edges: DataFrame) -> DataFrame:
    """doc_id, class_id (the least doc_id that links lead to), by least labels over links and pointer jumps; every round is written."""
    both = saved(edges.select(F.col("doc_id").alias("a"), F.col("hub").alias("b")).unionByName(edges.select(F.col("hub").alias("a"), F.col("doc_id").alias("b"))).distinct(), "edges")
    label = saved(both.groupBy("a").agg(F.min("b").alias("l")).select(F.col("a").alias("doc_id"), F.least("a", "l").alias("l")), "labels")
    while True:
        near = both.join(label.withColumnRenamed("doc_id", "b"), "b").groupBy("a").agg(F.min("l").alias("m"))
        step = label.join(near, label["doc_id"] == near["a"]).select("doc_id", F.col("l").alias("was"), F.least("l", "m").alias("l"))
        up = step.select(F.col("doc_id").alias("p"), F.col("l").alias("pl"))
        new = saved(step.join(up, step["l"] == up["p"], "left").select("doc_id", "was", F.least("l", "pl").alias("l")), "labels")
        label = new.select("doc_id", "l")
        if new.where("was <> l").isEmpty():
            return label.select("doc_id", F.col("l").alias("class_id"))


def copies(every: DataFrame) -> DataFrame:
    """doc_id, same, local and rep: the least doc_ids with the same text, of a share of them and of all; written.

    A text's documents are dealt into as many shares as there are partitions, so one that a third of all rows have is no
    task's alone."""
    n = partitions(every.sparkSession)
    share = F.pmod(F.xxhash64("doc_id"), F.lit(n))
    own = saved(every.select("doc_id", "same", F.min("doc_id").over(Window.partitionBy("same", share)).alias("local")), "near-copies")
    least = own.where("doc_id = local").select("same", "local").distinct()
    reps = saved(least.withColumn("rep", F.min("local").over(Window.partitionBy("same"))), "near-reps")
    return saved(own.join(reps.hint("merge"), ["same", "local"]), "near-own")


def classes(docs: DataFrame, least: float = LEAST_SIMILARITY) -> DataFrame:
    """doc_id, class_id and n_links of every document. Documents are of one class if links of at least ``least`` join them.

    Equal texts are always linked (empty ones too); null text: a class of its own; texts of fewer than 5 words are linked
    only if their words are equal. Rows of one doc_id are one document. Rows without doc_id are left out. n_links: the
    verified links of a document's text with other texts (each text with the hubs of its buckets, not with all partners).
    """
    spark = ready(docs.sparkSession)
    idf = spark.sparkContext.broadcast(word_idf(docs))
    every = nodes(docs, idf)
    own = copies(every)
    reps = every.where(F.size("bands") > 0).join(own.where("doc_id = rep").select("doc_id", "same").distinct(), ["doc_id", "same"], "left_semi").dropDuplicates(["doc_id", "same"])
    found = saved(links(docs, reps, idf, least).select("doc_id", "hub").distinct(), "near-links")
    # a repeated doc_id joins the classes of its texts
    several = own.groupBy("doc_id").agg(F.min("same").alias("lo"), F.max("same").alias("hi")).where("lo <> hi").select("doc_id")
    label = components(found.unionByName(own.join(several, "doc_id", "left_semi").where("doc_id <> rep").select("doc_id", F.col("rep").alias("hub"))))
    degree = found.select("doc_id").unionByName(found.select(F.col("hub").alias("doc_id"))).groupBy("doc_id").agg(F.count("*").alias("n_links"))
    known = own.select("same", "local", "rep").distinct().join(label.withColumnRenamed("doc_id", "rep"), "rep", "left").join(degree.withColumnRenamed("doc_id", "rep"), "rep", "left")
    known = saved(known.select("same", "local", F.coalesce("class_id", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "near-known")
    got = own.join(known.hint("merge"), ["same", "local"]).groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.max("n_links").alias("n_links"))
    ids = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return ids.join(got, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def op9_icws_neardup(spark, sf_dir: str) -> DataFrame:
    """Class of every document: doc_id, class_id, n_links (verified links between texts that differ)."""
    return classes(table(spark, sf_dir, "documents"))


def stage_near(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each class; rows without doc_id stay."""
    gone = classes(docs).where("class_id <> doc_id").select(F.col("doc_id").alias("_gone"))
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti").select(*docs.columns)
