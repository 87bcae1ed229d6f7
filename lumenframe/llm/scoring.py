"""Masked pseudo-likelihood: a window network predicts every word from the words on both sides.

A word is what stands between white space, in lower case and without the marks at its ends; it is known by its 64-bit
hash. The vocabulary is the corpus's most frequent words (counted over all documents) and hash buckets for the others;
a word of a bucket also has its probability within the bucket, from counts of every word of all documents. The network
adds a projected embedding for each place of the window, goes through tanh, and gives a two-level softmax (class, then
word of the class; classes are runs of frequency ranks). It is trained in numpy by rounds of local Adagrad on every
task's documents, after which the tasks' weights are averaged. A document's score is the sum of its words' conditional
log-probabilities. Counts of rare words stay on the executors, dealt by the words' hashes.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import bare_spans, hashed_words, lean, partitions, ready, saved, table

CLASSES, INNER, UNKNOWN = 64, 64, 64
VOCAB = CLASSES * INNER
SIDE, DIM, HIDDEN = 2, 16, 32
PLACES = 2 * SIDE
PIECE = 1 << 13  # words scored at once
DEAL_WORDS = 2_000_000  # rare words that are counted at once


def words_of(texts: list[str | None]) -> list[np.ndarray]:
    """Hashes of each text's words, in order."""
    return hashed_words(texts, 64, spans=bare_spans)


def vocabulary(docs: DataFrame, size: int = VOCAB - UNKNOWN, held: int = 1 << 20) -> list[tuple[int, int]]:
    """The ``size`` most frequent words (hashes) of all documents with their counts (ties: by hash)."""

    def count(batches):
        parts, size = [], 0
        for b in batches:
            parts.append(np.concatenate([np.zeros(0, np.uint64), *words_of(b.column("text").to_pylist())]))
            size += len(parts[-1])
            if size > held:
                yield counted(parts)
                parts, size = [], 0
        yield counted(parts)

    def counted(parts: list[np.ndarray]) -> pa.RecordBatch:
        word, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *parts]), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], names=["word", "n"])

    rows = docs.select(F.col("text").cast("string")).mapInArrow(lean(count), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [(r["word"], r["n"]) for r in rows.orderBy(F.desc("n"), "word").limit(size).collect()]


class TokenIds:
    """hashes -> ids: a word's rank, or its bucket among the last UNKNOWN ids; and the same with 48 bits of the hash above it."""

    def __init__(self, words: np.ndarray):
        self.order = np.argsort(words).astype(np.uint16)
        self.words = np.append(words[self.order], np.uint64(0))  # hashes are never 0

    def __call__(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.words[:-1], h)
        ids = (VOCAB - UNKNOWN + (h >> np.uint64(8)) % np.uint64(UNKNOWN)).astype(np.uint16)
        known = self.words[at] == h
        ids[known] = self.order[at[known]]
        rare = ~known
        return ids, (h[rare] >> np.uint64(16)) << np.uint64(16) | ids[rare]


def encoded(docs: DataFrame, words: list[int]) -> DataFrame:
    """doc_id, row (a number of the row's own), ids (packed 16-bit) and rare (packed 64-bit: id and hash of each word outside ``words``)
    of every document, written once; null text: no ids."""
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(np.array(words, np.int64).view(np.uint64))  # at most VOCAB words

    def run(batches):
        from pyspark import TaskContext

        number, row = TokenIds(ranks.value), TaskContext.get().partitionId() << 32
        for b in batches:
            got = words_of(b.column("text").to_pylist())
            ids, rare = number(np.concatenate([np.zeros(0, np.uint64), *got]))
            ends = np.cumsum([0, *map(len, got)])
            seen = np.concatenate([[0], np.cumsum(ids >= VOCAB - UNKNOWN)])[ends]
            cols = [pa.array(range(row, row + len(got)), pa.int64()), _cut(ids.tobytes(), 2 * ends), _cut(rare.tobytes(), 8 * seen)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], names=["doc_id", "row", "ids", "rare"])
            row += len(got)

    return saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(lean(run), "doc_id long, row long, ids binary, rare binary"), "lm-ids")


def _cut(blob: bytes, ends: np.ndarray) -> pa.Array:
    """A binary value between each two of ``ends``."""
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(blob)]).cast(pa.binary())


def id_counts(ids: DataFrame) -> np.ndarray:
    """How often each id is in all documents, the buckets' included; at most VOCAB rows come to the driver."""

    def count(batches):
        n = np.zeros(VOCAB, np.int64)
        for b in batches:
            n += np.bincount(np.frombuffer(b"".join(b.column("ids").to_pylist()), np.uint16), minlength=VOCAB)
        at = np.nonzero(n)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["id", "n"])

    got = ids.select("ids").mapInArrow(lean(count), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(VOCAB)
    out[got["id"].to_numpy()] = got["n"].to_numpy()
    return out


def within_buckets(ids: DataFrame, counts: np.ndarray, deal_words: int = DEAL_WORDS, chunk_words: int = 1 << 21) -> DataFrame:
    """row, inside: the sum of log p(word | bucket) over the rare words of each row that has any.

    p is the word's count in all of ``ids`` by its bucket's plus one; that one is left to words that were never seen.
    Words go to tasks by their hashes and their sums go back by the task that read the rows, both packed (a value a
    pair of tasks): a word's occurrences are sorted where they meet, and no count leaves its task."""
    spark = ids.sparkSession
    tasks = max(partitions(spark), -(-int(counts[VOCAB - UNKNOWN :].sum()) // deal_words))

    def deal(batches):
        held, rows, size = [], [], 0
        for b in batches:
            blobs = b.column("rare").to_pylist()
            held += blobs
            rows.append(np.repeat(b.column("row").to_numpy(), [len(x) // 8 for x in blobs]))
            size += len(rows[-1])
            if size >= chunk_words:
                yield dealt(held, rows)
                held, rows, size = [], [], 0
        yield dealt(held, rows)

    def dealt(blobs: list[bytes], rows: list[np.ndarray]) -> pa.RecordBatch:
        key, row = np.frombuffer(b"".join(blobs), np.uint64), np.concatenate([np.zeros(0, np.int64), *rows])
        to = ((key >> np.uint64(16)) % np.uint64(tasks)).astype(np.uint16 if tasks < 1 << 16 else np.int64)
        order = np.argsort(to, kind="stable")
        some, at = np.unique(to[order], return_index=True)
        ends = 8 * np.append(at, len(key))
        return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), _cut(key[order].tobytes(), ends), _cut(row[order].tobytes(), ends)], names=["task", "keys", "at"])

    def sums(keys: list[bytes], at: list[bytes]):
        key, row = np.frombuffer(b"".join(keys), np.uint64), np.frombuffer(b"".join(at), np.int64)
        _, word, n = np.unique(key, return_inverse=True, return_counts=True)
        lp = np.log(n)[word] - np.log(counts[(key & np.uint64(0xFFFF)).astype(np.int64)] + 1)
        rows, doc = np.unique(row, return_inverse=True)
        inside = np.bincount(doc, lp, len(rows)).astype(np.float64)  # of nothing it is whole numbers
        some, first = np.unique(rows >> 32, return_index=True)
        ends = 8 * np.append(first, len(rows))
        return pa.RecordBatch.from_arrays([pa.array(some), _cut(rows.tobytes(), ends), _cut(inside.tobytes(), ends)], names=["source", "rows", "inside"])

    def back(rows: list[bytes], inside: list[bytes]):
        row, doc = np.unique(np.frombuffer(b"".join(rows), np.int64), return_inverse=True)
        return pa.RecordBatch.from_arrays([pa.array(row), pa.array(np.bincount(doc, np.frombuffer(b"".join(inside)), len(row)).astype(np.float64))], names=["row", "inside"])

    def by(key: str, one: str, two: str, run):
        """``run`` on the values of each key, which come one after another."""

        def each(batches):
            now, xs, ys = None, [], []
            for b in batches:
                for k, x, y in zip(*(b.column(c).to_pylist() for c in (key, one, two))):
                    if k != now:
                        yield run(xs, ys)
                        now, xs, ys = k, [], []
                    xs.append(x)
                    ys.append(y)
            yield run(xs, ys)

        return lean(each)

    words = ids.select("row", "rare").mapInArrow(lean(deal), "task long, keys binary, at binary").repartition(tasks, "task").sortWithinPartitions("task")
    found = words.mapInArrow(by("task", "keys", "at", sums), "source long, rows binary, inside binary").repartition(partitions(spark), "source").sortWithinPartitions("source")
    return found.mapInArrow(by("source", "rows", "inside", back), "row long, inside double")


class Network:
    """Weights by name: E (embeddings, the last row pads), W and b (window to hidden), C (hidden and 1 to classes), I (to words in a class)."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @classmethod
    def start(cls, counts: np.ndarray, seed: int = 1) -> Network:
        """Small random weights; the biases are those of the words' own frequencies."""
        g = np.random.Generator(np.random.PCG64(seed))
        n = (counts + 1.0).reshape(CLASSES, INNER)
        f = lambda *s: g.standard_normal(s).astype(np.float32)
        w = {"E": f(VOCAB + 1, DIM) * 0.3, "W": f(PLACES * DIM, HIDDEN) * 0.2, "b": np.zeros(HIDDEN, np.float32), "C": f(HIDDEN + 1, CLASSES) * 0.05, "I": f(CLASSES, HIDDEN + 1, INNER) * 0.05}
        w["C"][HIDDEN], w["I"][:, HIDDEN] = np.log(n.sum(1) / n.sum()), np.log(n / n.sum(1, keepdims=True))
        return cls(w)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.w[k].ravel() for k in sorted(self.w)])

    def unflat(self, x: np.ndarray) -> Network:
        out, at = {}, 0
        for k in sorted(self.w):
            n = self.w[k].size
            out[k] = x[at : at + n].reshape(self.w[k].shape).astype(np.float32)
            at += n
        return Network(out)

    def step(self, context: np.ndarray, target: np.ndarray, sums: dict[str, np.ndarray], rate: float) -> None:
        """One Adagrad step on a batch (gradients are sums over it). Rows that no gradient reaches are left out of it."""
        w, n = self.w, len(target)
        order = np.argsort((target // INNER).astype(np.uint8), kind="stable")  # by class: its words are one slice
        context, target = context[order], target[order]
        cls, word, rows = target // INNER, target % INNER, np.arange(n)
        edge = np.searchsorted(cls, np.arange(CLASSES + 1)).tolist()
        spans = [(k, slice(a, z)) for k, (a, z) in enumerate(zip(edge, edge[1:])) if a < z]
        x = w["E"][context].reshape(n, -1)
        a = np.ones((n, HIDDEN + 1), np.float32)
        z = x @ w["W"]
        z += w["b"]
        np.tanh(z, out=a[:, :HIDDEN])
        pc = _softmax(a @ w["C"])
        p = np.empty((n, INNER), np.float32)
        for k, r in spans:
            np.matmul(a[r], w["I"][k], out=p[r])
        p = _softmax(p)
        pc[rows, cls] -= 1
        p[rows, word] -= 1
        dz = pc @ w["C"][:HIDDEN].T
        inner = np.empty((len(spans), HIDDEN + 1, INNER), np.float32)
        for j, (k, r) in enumerate(spans):
            np.matmul(a[r].T, p[r], out=inner[j])
            dz[r] += p[r] @ w["I"][k, :HIDDEN].T
        dz *= 1 - a[:, :HIDDEN] ** 2
        dx = (dz @ w["W"].T).reshape(-1, DIM)
        flat = context.ravel().astype(np.uint16)
        by = np.argsort(flat, kind="stable")
        flat = flat[by]
        first = np.nonzero(np.diff(flat.astype(np.int32), prepend=-1))[0]
        near = np.add.reduceat(dx[by], first, 0)
        hit = slice(None) if len(spans) == CLASSES else [k for k, _ in spans]
        for k, at, v in (("C", ..., a.T @ pc), ("W", ..., x.T @ dz), ("b", ..., dz.sum(0)), ("I", hit, inner), ("E", flat[first], near)):
            root = sums[k][at]
            root = root + v * v
            sums[k][at] = root
            root = np.sqrt(root, out=root)
            root += 1e-3
            v *= rate
            v /= root
            w[k][at] -= v

    def prepared(self) -> list[np.ndarray]:
        """The first layer as one table a place of the window."""
        return [self.w["E"] @ self.w["W"][j * DIM : (j + 1) * DIM] for j in range(PLACES)]

    def log_probs(self, tables: list[np.ndarray], x: np.ndarray) -> np.ndarray:
        """log p of each word of ``x`` but the first and last SIDE, from its neighbours; padding among them gets the last word's."""
        n = len(x) - 2 * SIDE
        z = tables[0][x[:n]]
        z += self.w["b"]
        for t, j in zip(tables[1:], [j for j in range(1, 2 * SIDE + 1) if j != SIDE]):
            z += t[x[j : j + n]]
        target = np.minimum(x[SIDE : SIDE + n], VOCAB - 1)
        order = np.argsort((target // INNER).astype(np.uint8), kind="stable")
        target = target[order]
        cls, word = target // INNER, target % INNER
        a = np.ones((n, HIDDEN + 1), np.float32)
        np.tanh(z[order], out=a[:, :HIDDEN])
        sums = _log_softmax_at(a @ self.w["C"], cls)
        p = np.empty((n, INNER), np.float32)
        edge = np.searchsorted(cls, np.arange(CLASSES + 1)).tolist()
        for k, (i, j) in enumerate(zip(edge, edge[1:])):
            if i < j:
                np.matmul(a[i:j], self.w["I"][k], out=p[i:j])
        sums += _log_softmax_at(p, word)
        out = np.empty_like(sums)
        out[order] = sums
        return out


#: Logits up to here need no shift before exp.
SAFE = 60.0


def _shifted(x: np.ndarray) -> np.ndarray:
    """Logits that exp can take, in place: less their row's largest, unless none is far from 0."""
    if len(x) and (x.max() > SAFE or x.min() < -SAFE):
        x -= x.max(1, keepdims=True)
    return x


def _softmax(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.exp(_shifted(x), out=x)
    x *= (1 / x.sum(1))[:, None]
    return x


def _log_softmax_at(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """log softmax of each row at one place; in place."""
    out = _shifted(x)[np.arange(len(x)), at]
    np.exp(x, out=x)
    return out - np.log(x.sum(1))


def padded(ids: np.ndarray) -> np.ndarray:
    edge = np.full(SIDE, VOCAB, np.int64)
    return np.concatenate([edge, ids.astype(np.int64), edge])


def windows(ids: np.ndarray, stride: int, phase: int) -> tuple[np.ndarray, np.ndarray]:
    """Contexts and targets at every ``stride``-th word from ``phase``."""
    x = padded(ids)
    at = np.arange(phase, len(ids), stride) + SIDE
    return np.stack([x[at + j] for j in range(-SIDE, SIDE + 1) if j], 1) if len(at) else np.zeros((0, PLACES), np.int64), x[at]


def places(blobs: list[bytes], stride: int, phase: int) -> tuple[np.ndarray, np.ndarray]:
    """``windows`` of many packed documents at once, each from (phase + its length) mod stride on."""
    edge = np.full(SIDE, VOCAB, np.uint16).tobytes()
    x = np.frombuffer(edge + b"".join(v + edge for v in blobs), np.uint16)
    size = np.array([len(v) // 2 for v in blobs], np.int64)
    first = (phase + size) % stride
    n = np.maximum(0, -((first - size) // stride))
    start = np.cumsum(size + SIDE) - size + first  # of each document's first word taken, in x
    at = np.repeat(start - stride * (np.cumsum(n) - n), n) + stride * np.arange(n.sum())
    return np.stack([x[at + j] for j in range(-SIDE, SIDE + 1) if j], 1), x[at].astype(np.int64)


def train(ids: DataFrame, counts: np.ndarray, rounds: int = 6, stride: int = 6, batch: int = 4096, rate: float = 0.05, block: int = 1 << 14, adders: int = 8) -> Network:
    """Average of the tasks' networks after each round. Each round takes every ``stride``-th word of every document, from
    another one on: as many rounds as the stride train on every word of every document once."""
    spark = ids.sparkSession
    net = Network.start(counts)
    size = len(net.flat())
    for r in range(rounds):
        shared = spark.sparkContext.broadcast(net.flat())  # of one size, whatever the corpus
        phase = (r * stride) // rounds

        def run(batches, shared=shared, phase=phase):
            own, seen = net0().unflat(shared.value.copy()), 0
            sums = {k: np.full_like(v, 1e-2) for k, v in own.w.items()}
            xs, ys = np.zeros((0, PLACES), np.uint16), np.zeros(0, np.int64)
            for b in batches:
                c, t = places(b.column("ids").to_pylist(), stride, phase)  # the first words aren't all of one round
                xs, ys = np.concatenate([xs, c]), np.concatenate([ys, t])
                whole = len(ys) - len(ys) % batch
                for i in range(0, whole, batch):
                    own.step(xs[i : i + batch], ys[i : i + batch], sums, rate)
                seen, xs, ys = seen + whole, xs[whole:], ys[whole:]
            if len(ys):
                own.step(xs, ys, sums, rate)
                seen += len(ys)
            if seen:
                flat = own.flat() * np.float64(seen)
                cut = [flat[i : i + block].tobytes() for i in range(0, size, block)]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(cut)), pa.int32()), pa.array([seen] * len(cut)), pa.array(cut, pa.binary())], names=["block", "n", "w"])

        def add(batches):
            sums: dict[int, list] = {}
            for b in batches:
                for k, n, w in zip(*(b.column(c).to_pylist() for c in ("block", "n", "w"))):
                    v = sums.setdefault(k, [0, 0.0])
                    v[0] += n
                    v[1] = v[1] + np.frombuffer(w)
            if sums:
                yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v[0] for v in sums.values()]), pa.array([v[1].tobytes() for v in sums.values()], pa.binary())], names=["block", "n", "w"])

        # sums of blocks in ``adders`` tasks, however many tasks trained; adders x blocks rows come to the driver
        parts = ids.select("ids").mapInArrow(lean(run), "block int, n long, w binary").repartition(adders).mapInArrow(lean(add), "block int, n long, w binary")
        got: dict[int, list] = {}
        for row in parts.collect():
            v = got.setdefault(row["block"], [0, 0.0])
            v[0], v[1] = v[0] + row["n"], v[1] + np.frombuffer(row["w"])
        if got:
            net = net.unflat(np.concatenate([got[k][1] / got[k][0] for k in sorted(got)]))
    return net


@functools.cache
def net0() -> Network:
    """For its shapes."""
    return Network.start(np.zeros(VOCAB))


def score(ids: DataFrame, net: Network, counts: np.ndarray | None = None) -> DataFrame:
    """doc_id, n_tokens, pll (sum of log-probabilities) and mean_logprob (null without words). counts: those of ``ids``, if known."""
    shared = ids.sparkSession.sparkContext.broadcast(net.w)

    def run(batches):
        own = Network(shared.value)
        tables = own.prepared()
        for b in batches:
            blobs = [np.frombuffer(x, np.uint16) for x in b.column("ids").to_pylist()]
            sums = np.zeros(len(blobs))
            # documents one after another, padding between them, in pieces of bounded size
            held, places, size = [], [], 0
            for i, v in enumerate(blobs):
                whole = padded(v)
                for a in range(0, len(v), PIECE):
                    z = min(len(v), a + PIECE)
                    edge = whole[a : z + 2 * SIDE]
                    held.append(edge)
                    places.append((i, size, z - a))
                    size += len(edge)
                    if size > PIECE:
                        _add(own, tables, held, places, sums)
                        held, places, size = [], [], 0
            if held:
                _add(own, tables, held, places, sums)
            n = np.array([len(v) for v in blobs], np.int64)
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), pa.array(n), pa.array(sums)], names=["row", "doc_id", "n_tokens", "pll"])

    known = ids.select("row", "doc_id", "ids").mapInArrow(lean(run), "row long, doc_id long, n_tokens long, pll double")
    inside = within_buckets(ids, id_counts(ids) if counts is None else counts).select("row", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("n_tokens"), F.col("inside").alias("pll"))
    # a document is one row of the first, so the largest doc_id and count are its own
    every = known.unionByName(inside).groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.sum("pll").alias("pll"))
    return every.select("doc_id", "n_tokens", "pll", F.when(F.col("n_tokens") > 0, F.col("pll") / F.col("n_tokens")).alias("mean_logprob"))


def _add(net: Network, tables, held, places, sums: np.ndarray) -> None:
    lp = net.log_probs(tables, np.concatenate(held))
    for i, at, n in places:
        sums[i] += lp[at : at + n].sum(dtype=np.float64)


def op2_masked_pll(spark, sf_dir: str) -> DataFrame:
    """Pseudo-log-likelihood of every document: doc_id, n_tokens, pll, mean_logprob."""
    docs = table(ready(spark), sf_dir, "documents")
    words = vocabulary(docs)
    ids = encoded(docs, [w for w, _ in words])
    counts = id_counts(ids)
    return score(ids, train(ids, counts), counts)
