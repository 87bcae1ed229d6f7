"""Language identification as mixture inference.

Each language is a distribution over character n-grams (hashed). A document is a mixture of languages: expectation-
maximisation estimates its proportions from the n-gram likelihoods, and the set of languages is the one with the
best likelihood less a penalty for each language (as in BIC), found by dropping the weakest language while that helps.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import lean, ready, spare, table

LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"


def grams(text: str, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed trigrams of a whole text (lower case, runs of anything but letters as one space) and their counts."""
    code = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.where(_letters(code), code, 32)
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 32) | (code[:-1] != 32)
    c = code[keep].astype(np.uint64)
    if len(c) < 3:
        return np.zeros(0, np.int64), np.zeros(0)
    h = (c[:-2] * np.uint64(0x1F123BB5) + c[1:-1]) * np.uint64(0x9E3779B1) + c[2:]
    h = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - (buckets.bit_length() - 1))
    return _distinct(h.astype(np.int64))


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = np.sort(h)
    at = np.nonzero(np.concatenate([[True], h[1:] != h[:-1]]))[0]
    return h[at], np.diff(np.concatenate([at, [len(h)]])).astype(np.float64)


_TABLE: list[np.ndarray] = []


def _letters(code: np.ndarray) -> np.ndarray:
    if not _TABLE:
        _TABLE.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _TABLE[0][code]


def fit(docs: DataFrame, per_lang: int = 5000, buckets: int = 1 << 16, smooth: float = 0.5) -> tuple[list[str], np.ndarray]:
    """Languages and log p(n-gram | language), from at most about ``per_lang`` labelled documents of each (those of least hash).

    docs: text, lang and key (a stable string). Rows without text or lang aren't used. The driver gets the languages'
    document counts and at most languages x buckets sums.
    """
    spark = ready(docs.sparkSession)
    rows = docs.where("lang is not null and text is not null").select("text", "lang", ((F.xxhash64("key") % 1_000_000 + 1_000_000) % 1_000_000 / 1e6).alias("u"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((buckets, 0), np.float32)
    share = spark.createDataFrame([(x, min(1.0, per_lang / sizes[x])) for x in langs], "lang string, share double")
    sample = rows.join(F.broadcast(share), "lang").where("u < share").select("text", "lang")
    number = {x: i for i, x in enumerate(langs)}

    def count(batches):
        sums = np.zeros((len(langs), buckets))
        for b in batches:
            for t, x in zip(b.column("text").to_pylist(), b.column("lang").to_pylist()):
                g, c = grams(t, buckets)
                sums[number[x], g] += c
        i, g = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(g.astype(np.int32)), pa.array(sums[i, g])], names=["i", "g", "n"])

    sums = np.full((buckets, len(langs)), smooth)
    got = sample.mapInArrow(lean(count), "i int, g int, n double").groupBy("i", "g").agg(F.sum("n").alias("n")).toArrow()
    sums[got["g"].to_numpy(), got["i"].to_numpy()] += got["n"].to_numpy()
    return langs, np.log(sums / sums.sum(0)).astype(np.float32)


def mixtures(texts: list, logp: np.ndarray, penalty: float = 1.0, rounds: int = 12) -> np.ndarray:
    """Proportions (texts x languages; zero rows where a text has no letter), by EM over all texts at once.

    A language leaves a text's set while the log-likelihood lost is under penalty * log(n-grams) / 2.
    """
    n_lang, buckets = logp.shape[1], logp.shape[0]
    out = np.zeros((len(texts), n_lang))
    got = [grams(t, buckets) if t and LETTER.search(t) else (np.zeros(0, np.int64), np.zeros(0)) for t in texts]
    rows = [i for i, (g, _) in enumerate(got) if len(g)]
    if not rows or not n_lang:
        return out
    g, c = np.concatenate([got[i][0] for i in rows]), np.concatenate([got[i][1] for i in rows])
    at = np.concatenate([[0], np.cumsum([len(got[i][0]) for i in rows])])[:-1]
    size = np.diff(np.concatenate([at, [len(g)]]))
    like = np.exp(logp[g] - logp[g].max(1, keepdims=True)).astype(np.float32)
    total = np.add.reduceat(c, at)
    weight = (c / np.repeat(total, size)).astype(np.float32)

    def em(pi, sel_like, sel_weight, sel_at, sel_size, n):
        for _ in range(n):
            mix = sel_like * np.repeat(pi, sel_size, 0)
            mix *= (sel_weight / np.maximum(mix.sum(1), 1e-30))[:, None]
            pi = np.add.reduceat(mix, sel_at, 0)
        return pi

    def loglik(pi, sel_like, sel_weight, sel_at, sel_size, sel_total):
        return np.add.reduceat(sel_weight * np.log(np.maximum((sel_like * np.repeat(pi, sel_size, 0)).sum(1), 1e-30)), sel_at) * sel_total

    pi = em(np.full((len(rows), n_lang), 1 / n_lang, np.float32), like, weight, at, size, rounds)
    pi[pi < 1e-3] = 0
    pi /= pi.sum(1, keepdims=True)
    ll = loglik(pi, like, weight, at, size, total)
    open_rows = np.nonzero((pi > 0).sum(1) > 1)[0]
    while len(open_rows):  # each round drops one language of each text that is still open, or closes it
        pick = np.concatenate([np.arange(at[r], at[r] + size[r]) for r in open_rows])
        s_size = size[open_rows]
        s_at = np.concatenate([[0], np.cumsum(s_size)])[:-1]
        less = pi[open_rows].copy()
        weakest = np.where(less > 0, less, 9).argmin(1)
        less[np.arange(len(less)), weakest] = 0
        less /= less.sum(1, keepdims=True)
        s_like, s_weight = like[pick], weight[pick]
        less = em(less, s_like, s_weight, s_at, s_size, 4) if less.shape[1] > 2 else less
        s_ll = loglik(less, s_like, s_weight, s_at, s_size, total[open_rows])
        drop = ll[open_rows] - s_ll < penalty * np.log(np.maximum(total[open_rows], 2)) / 2
        done = open_rows[drop]
        pi[done], ll[done] = less[drop], s_ll[drop]
        open_rows = done[(pi[done] > 0).sum(1) > 1]
    out[rows] = pi
    return out


def predict(docs: DataFrame, langs: list[str], logp: np.ndarray, keep: tuple[str, ...] = (), penalty: float = 1.0) -> DataFrame:
    """``keep`` columns, lang_pred, score (proportion of that language, 0 to 1) and mixture (languages and proportions, largest first).

    Null text or text without a letter: ``und`` with score 0 and an empty mixture. Ties: the language first in the alphabet.
    """
    spark = ready(docs.sparkSession)
    shared = spark.sparkContext.broadcast(logp)  # buckets x languages, whatever the corpus
    rows = docs.select(*keep, F.col("text").cast("string").alias(spare(keep)))
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches):
        for b in batches:
            pi = mixtures(b.column(b.num_columns - 1).to_pylist(), shared.value, penalty)
            top = pi.argmax(1) if len(langs) else np.zeros(len(pi), int)
            best = pi[np.arange(len(pi)), top] if len(langs) else np.zeros(len(pi))
            order = [[(langs[j], float(p[j])) for j in np.argsort(-p, kind="stable") if p[j] > 0] for p in pi]
            cols = [b.column(i) for i in range(b.num_columns - 1)]
            cols += [pa.array([langs[j] if s > 0 else UNKNOWN for j, s in zip(top, best)], pa.string()), pa.array(np.minimum(best, 1.0), pa.float64())]
            cols += [pa.array([[x for x, _ in o] for o in order], pa.list_(pa.string())), pa.array([[p for _, p in o] for o in order], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names[:-1], "lang_pred", "score", "langs", "proportions"])

    return rows.mapInArrow(lean(run), f"{kind + ', ' if kind else ''}lang_pred string, score double, langs array<string>, proportions array<double>")


def training_rows(docs: DataFrame) -> DataFrame:
    """The rows that may be learned from: crc32 of doc_id (as text) mod 5 isn't 0, and a language is given."""
    key = F.col("doc_id").cast("string")
    return docs.where("lang is not null").where(F.crc32(F.encode(key, "UTF-8")) % 5 != 0).select("text", "lang", key.alias("key"))


def op1_langid(spark, sf_dir: str) -> DataFrame:
    """Language of every document: doc_id, held_out, lang_pred, score, langs, proportions."""
    docs = table(spark, sf_dir, "documents")
    langs, logp = fit(training_rows(docs))
    held = F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0, F.lit(False))
    out = predict(docs.withColumn("held_out", held), langs, logp, ("doc_id", "held_out"))
    return out


def stage_language(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language; those without any letter (``und``) go. Learns from the documents that it is given; where they
    teach no language, all with a letter stay."""
    langs, logp = fit(training_rows(docs))
    if not langs:
        return docs.where(F.col("text").cast("string").rlike(r"\p{L}"))
    return predict(docs, langs, logp, tuple(docs.columns)).where(f"lang_pred <> '{UNKNOWN}'").select(*docs.columns)
