"""Severity of toxic language by a cumulative-link (ordinal logistic) model over sparse text features.

P(grade >= k | x) = sigmoid(w.x - t_k) with thresholds t_1 < t_2 < ...: one weight vector shared by all thresholds.
Features are the distinct words of the whole text and their beginnings, hashed. The model is fitted on a bounded sample of labelled rows.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import WordIds, bare, crc, lean, ready, saved, spare, table


#: Lengths of the word beginnings that are features besides whole words: inflected and compounded insults share them.
STEMS = (4, 5, 6, 7, 8)


def parts(word: str, buckets: int) -> list[int]:
    """Feature numbers of one bare word: itself and its beginnings."""
    return [crc(word) % buckets, *(crc(f"{word[:n]}^{n}") % buckets for n in STEMS if len(word) >= n)]


def word_features(buckets: int) -> WordIds:
    """raw word -> its feature numbers."""
    return WordIds(lambda w: parts(bare(w), buckets), 200_000)


def features(text: str | None, ids: WordIds) -> np.ndarray:
    """Sorted distinct feature numbers of a whole text; null text: none."""
    got = set(chain.from_iterable(map(ids.__getitem__, set(text.split())))) if text else ()
    return np.sort(np.fromiter(got, np.int64, len(got)))


class Ordinal:
    """A fitted model: w (a weight a feature) and thresholds (one less than there are grades)."""

    def __init__(self, w: np.ndarray, thresholds: np.ndarray):
        self.w, self.thresholds = w.astype(np.float64), np.asarray(thresholds, np.float64)

    def at_least(self, z: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ...: a row a document."""
        return 1 / (1 + np.exp(-np.clip(np.asarray(z)[:, None] - self.thresholds, -50, 50)))


LEAST_DOCS, LEAST_Z = 5, 4.0


def screened(n_in: np.ndarray, g_in: np.ndarray, mean: float, sd: float, least_docs: int = LEAST_DOCS, least_z: float = LEAST_Z) -> np.ndarray:
    """Which features tell something: n_in rows have one, with grades that sum to g_in; mean and sd are those of all rows' grades."""
    return (n_in >= least_docs) & (np.abs(g_in - n_in * mean) >= least_z * max(sd, 1e-9) * np.sqrt(np.maximum(n_in, 1)))


def fit(rows: list[np.ndarray], grades: np.ndarray, weights: np.ndarray, buckets: int, n_grades: int, l2: float = 5e-3, least_docs: int = LEAST_DOCS, least_z: float = LEAST_Z, steps: int = 200, rate: float = 0.05) -> Ordinal:
    """Weighted maximum likelihood with a small L2 penalty, by Adam over the whole sample.

    Features of fewer than ``least_docs`` rows, or whose rows' mean grade is within ``least_z`` standard errors of the
    mean of all, stay 0: else a model with more features than rows remembers its sample."""
    weights = weights / weights.sum()
    n_in, g_in = np.zeros(buckets), np.zeros(buckets)
    for x, g in zip(rows, grades):
        n_in[x] += 1
        g_in[x] += g
    useful = screened(n_in, g_in, grades.mean(), float(grades.std()), least_docs, least_z)
    rows = [x[useful[x]] for x in rows]
    row = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    col = np.concatenate([*rows, np.zeros(0, np.int64)])
    used, col = np.unique(col, return_inverse=True)
    share = np.array([weights[grades >= k].sum() for k in range(1, n_grades)]).clip(1e-6, 1 - 1e-6)
    start = np.log((1 - share) / share)  # thresholds of a model without features
    gaps = np.log(np.maximum(np.diff(start), 1e-3))
    p = np.concatenate([np.zeros(len(used)), start[:1], gaps])
    n, m, v = len(used), np.zeros(len(p)), np.zeros(len(p))
    i, lo, hi = np.arange(len(rows)), grades, grades + 1  # P(y = g) = P(y >= g) - P(y >= g + 1)
    for step in range(1, steps + 1):
        t = np.concatenate([p[n : n + 1], p[n] + np.cumsum(np.exp(p[n + 1 :]))])
        z = np.bincount(row, p[col], minlength=len(rows))
        s = 1 / (1 + np.exp(-np.clip(z[:, None] - t, -500, 500)))
        up = np.concatenate([np.ones((len(z), 1)), s, np.zeros((len(z), 1))], 1)
        a, b = up[i, lo], up[i, hi]
        gz = -weights * (1 - a - b)  # the logistic's (a(1-a) - b(1-b)) / (a - b), without its small differences
        gt = np.zeros(n_grades + 1)
        np.add.at(gt, lo, weights * np.where(hi == n_grades, 1 - a, a * (1 - a) / np.maximum(a - b, 1e-12)))
        np.add.at(gt, hi, -weights * np.where(lo == 0, b, b * (1 - b) / np.maximum(a - b, 1e-12)))
        gt = gt[1:-1]
        tail = np.cumsum(gt[::-1])[::-1]
        g = np.concatenate([np.bincount(col, gz[row], minlength=n) + l2 * p[:n] / max(1, n) ** 0.5, tail[:1], tail[1:] * np.exp(p[n + 1 :])])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p = p - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    w = np.zeros(buckets)
    w[used] = p[:n]
    return Ordinal(w, np.concatenate([p[n : n + 1], p[n] + np.cumsum(np.exp(p[n + 1 :]))]))


def learn(docs: DataFrame, labels: DataFrame, per_grade: int = 8000, buckets: int = 1 << 19) -> tuple[Ordinal, int]:
    """Fit on at most about ``per_grade`` labelled documents of each grade (those of least hash), weighted back to their shares.

    labels: doc_id, grade (0, 1, 2, ...). Null grades and labels without a document are left out; of several labels of
    one document the largest counts. Without two grades, every document gets grade 0.
    """
    spark = ready(docs.sparkSession)
    ids = labels.where("grade is not null and doc_id is not null").groupBy("doc_id").agg(F.max("grade").cast("int").alias("grade"))
    sizes = {r["grade"]: r["n"] for r in ids.groupBy("grade").agg(F.count("*").alias("n")).collect()}
    n_grades = max(sizes, default=0) + 1
    if n_grades < 2 or len(sizes) < 2:
        return Ordinal(np.zeros(buckets), np.full(max(1, n_grades - 1), 50.0)), max(2, n_grades)
    share = F.coalesce(*[F.when(F.col("grade") == g, F.lit(min(1.0, per_grade / n))) for g, n in sizes.items()])
    u = (F.xxhash64(F.col("doc_id").cast("string")) % 1_000_000 + 1_000_000) % 1_000_000 / 1e6
    sample = ids.where(u < share)  # about grades x per_grade ids at most: a proven bound for the broadcast
    chosen = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(sample), "doc_id").select("text", "grade")

    def run(batches):
        ids = word_features(buckets)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("grade"), pa.array([features(t, ids).astype("<i4").tobytes() for t in b.column("text").to_pylist()], pa.binary())], names=["grade", "x"])

    def count(batches):
        n_in, g_in = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for b in batches:
            for g, x in zip(b.column("grade").to_pylist(), b.column("x").to_pylist()):
                x = np.frombuffer(x, "<i4")
                n_in[x] += 1
                g_in[x] += g
        at = np.nonzero(n_in)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n_in[at]), pa.array(g_in[at])], names=["f", "n", "g"])

    sample = saved(chosen.mapInArrow(lean(run), "grade int, x binary"), "toxicity-sample")
    got = np.bincount(np.concatenate([np.zeros(0, np.int64), sample.select("grade").toArrow()["grade"].to_numpy()]), minlength=n_grades)
    sums = sample.mapInArrow(lean(count), "f long, n long, g long").groupBy("f").agg(F.sum("n").alias("n"), F.sum("g").alias("g")).toArrow()  # a row a bucket at most
    n_in, g_in = np.zeros(buckets), np.zeros(buckets)
    n_in[sums["f"].to_numpy()], g_in[sums["f"].to_numpy()] = sums["n"].to_numpy(), sums["g"].to_numpy()
    grade = np.arange(n_grades)
    mean = (got * grade).sum() / max(1, got.sum())
    useful = screened(n_in, g_in, mean, max(0.0, (got * grade**2).sum() / max(1, got.sum()) - mean**2) ** 0.5)
    kept = spark.sparkContext.broadcast(useful)

    def some(batches):
        for b in batches:
            xs = [np.frombuffer(x, "<i4") for x in b.column("x").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("grade"), pa.array([x[kept.value[x]].tobytes() for x in xs], pa.binary())], names=["grade", "x"])

    table = sample.mapInArrow(lean(some), "grade int, x binary").toArrow()  # in one job; only the screened features of the sample
    rows, grades = [np.frombuffer(x, "<i4") for x in table["x"].to_pylist()], table["grade"].to_numpy().astype(np.int64)
    weights = np.array([sizes.get(g, 0) / max(1, got[g]) for g in range(n_grades)])[grades]
    return fit(rows, grades, weights, buckets, n_grades), n_grades


def score(docs: DataFrame, model: Ordinal, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, severity (expected grade), grade (the largest that is at least as likely as not) and toxic (grade of 1 or more).

    Null and empty texts have no features: their severity is that of a text without any known word.
    """
    spark = ready(docs.sparkSession)
    buckets = len(model.w)
    shared = spark.sparkContext.broadcast((model.w, model.thresholds))  # as long as the buckets, whatever the corpus
    rows = docs.select(*keep, F.col("text").cast("string").alias(spare(keep)))
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches):
        w, t = shared.value
        m, ids = Ordinal(w, t), word_features(buckets)
        for b in batches:
            z = np.array([w[features(x, ids)].sum() for x in b.column(b.num_columns - 1).to_pylist()])
            p = m.at_least(z)
            grade = (p >= 0.5).sum(1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 1)), pa.array(p.sum(1)), pa.array(grade), pa.array(grade > 0)], names=[*b.schema.names[:-1], "severity", "grade", "toxic"])

    return rows.mapInArrow(lean(run), f"{kind}, severity double, grade int, toxic boolean")


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    """Expected severity of every document: doc_id, severity, grade, toxic. The grades are those of the label table (0 and 1)."""
    docs = table(spark, sf_dir, "documents")
    model, _ = learn(docs, table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("grade")))
    return score(docs, model)
