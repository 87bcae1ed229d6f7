"""Benchmark decontamination by latent semantic retrieval.

TF-IDF vectors of passages are projected on the leading right singular directions of a matrix of corpus passages and
benchmark items, each direction divided by its singular value. The decomposition is a distributed randomised one
(subspace iteration: tasks add up their passages' products, only sums of fixed size reach the driver) over all words of
all documents and items; every passage of every document is projected and searched. Passages whose latent cosine with an item is
high enough are candidates, and so is every place that holds one of the words that no leak of a short item (which a
passage dilutes) can do without; a longest common subsequence of words, weighted by idf, and a check of the answer decide.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import hashed_words, lean, ready, table

BITS, LATENT_BITS = 18, 15  # of a word's hash: for idf and the exact checks; for the latent space
BUCKETS, TERMS = 1 << BITS, 1 << LATENT_BITS
PASSAGE, STRIDE = 32, 16
RANK, SPARE = 128, 16  # directions kept, and those beside them while iterating
LEAST_COSINE = 0.4
FULL, PART, ANSWER = 0.8, 0.6, 0.8  # shares of the idf weight: of the item by itself; of the item, if so much of its answer is there
LONGEST_ITEM, SHORT_ITEM = 64, 8
LOOKED_UP = 16  # items of at most so many words are looked up by their words
BLOCK_PARTS = 8_192  # item parts searched in one pass (only so many are ever broadcast)

ANSWER_START = re.compile(r"[.?!:\n]\s*(?=\S)")


def words_of(texts: list) -> list[np.ndarray]:
    return hashed_words(texts, BITS)


def word_idf(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Inverse document frequency of each word bucket over all documents, and how many have a text; at most BUCKETS rows come to the driver."""

    def count(batches):
        df, n = np.zeros(BUCKETS, np.int64), 0
        for b in batches:
            for w in words_of(b.column("text").to_pylist()):
                df[w] += 1  # once a document: repeated places of an index count once
                n += 1
        at = np.nonzero(df)[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], names=["b", "n"])

    got = docs.select(F.col("text").cast("string")).where("text is not null").mapInArrow(lean(count), "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).toArrow()
    at, sums = got["b"].to_numpy(), got["n"].to_numpy()
    df, n = np.zeros(BUCKETS), int(sums[at < 0].sum()) if len(at) else 0
    df[at[at >= 0]] = sums[at >= 0]
    return np.log((n + 1) / (df + 0.5)).clip(0.05).astype(np.float32), n


class Item:
    """A benchmark passage: its words' buckets, and the buckets of its answer (what follows the last sentence end or colon)."""

    def __init__(self, item_id, text: str, answer: str | None = None):
        self.item_id = item_id
        self.words = words_of([text])[0]
        self.word_list = self.words.tolist()
        if answer is None:
            ends = [m.end() for m in ANSWER_START.finditer(text)]
            answer = text[ends[-1] :] if ends else ""
        self.answer = np.unique(words_of([answer])[0])


def parts(item_id, text: str, answer: str | None) -> list[Item]:
    """A benchmark row in parts of LONGEST_ITEM words (the answer goes with the last)."""
    w = text.split()
    if not len(words_of([text])[0]):
        return []
    if len(w) <= LONGEST_ITEM:
        return [Item(item_id, text, answer)]
    starts = range(0, len(w), LONGEST_ITEM)
    return [Item(item_id, " ".join(w[i : i + LONGEST_ITEM]), answer if i == starts[-1] else "") for i in starts]


def blocks(benchmark: DataFrame, most: int):
    """Lists of at most ``most`` parts (or one row's, if that has more), in the table's order; one is on the driver at a time."""
    block: list[Item] = []
    for r in benchmark.toLocalIterator():
        new = parts(r["item_id"], r["text"], (r["answer"] or "") if "answer" in benchmark.columns else None)
        if block and len(block) + len(new) > most:
            yield block
            block = []
        block += new
    if block:
        yield block


def passages(texts: list) -> pa.ListArray:
    """Words (hashes) of the passages of PASSAGE words that cover every text, evenly placed (the last ends with the text; shorter texts are one)."""
    docs = [w for w in words_of(texts) if len(w)]
    n = np.array([len(w) for w in docs], np.int64)
    k = -(-n // PASSAGE)
    doc = np.repeat(np.arange(len(docs)), k)
    start = (np.arange(len(doc)) - (np.cumsum(k) - k)[doc]) * np.maximum(n - PASSAGE, 0)[doc] // np.maximum(k - 1, 1)[doc]
    size, place = np.minimum(n, PASSAGE)[doc], np.arange(PASSAGE)
    at = ((np.cumsum(n) - n)[doc] + start)[:, None] + place
    words = np.concatenate([*docs, np.zeros(0, np.int64)]).astype(np.int32)[at[place < size[:, None]]]
    return pa.ListArray.from_arrays(np.append(0, np.cumsum(size)).astype(np.int32), words)


def summed(at: np.ndarray, x: np.ndarray, row: np.ndarray, y: np.ndarray, z: np.ndarray, often: int = 50, rows: int = 4096, most: int = 2048) -> None:
    """z[at] += x * y[row]; entries by row, at most one of a place in a row. Places in more than one of ``often`` rows by
    products of ``rows`` rows, the others by a product each, those of like length (``most`` entries) together."""
    n = np.bincount(at, minlength=len(z))
    much = np.nonzero(n * often > len(y))[0]
    rank = np.full(len(z), -1)
    rank[much] = np.arange(len(much))
    rank = rank[at]
    some = np.nonzero(rank >= 0)[0]
    stops = np.searchsorted(row[some], np.arange(0, len(y) + rows, rows)).tolist()
    sums = np.zeros((len(much), y.shape[1]), np.float32)
    for i, lo, hi in zip(range(0, len(y), rows), stops, stops[1:]):
        has, k = np.zeros((min(rows, len(y) - i), len(much)), np.float32), some[lo:hi]
        has[row[k] - i, rank[k]] = x[k]
        sums += has.T @ y[i : i + rows]
    z[much] += sums
    rest = np.nonzero(rank < 0)[0]
    if not len(rest):
        return
    rest = rest[np.argsort(at[rest].astype(np.uint16 if len(z) <= 1 << 16 else np.int64), kind="stable")]
    n[much] = 0
    places = np.nonzero(n)[0]
    n = n[places]
    by = np.argsort(n, kind="stable")
    start, places, n = (np.cumsum(n) - n)[by], places[by], n[by]
    x, row = np.append(x[rest], np.zeros(n[-1], x.dtype)), np.append(row[rest], np.zeros(n[-1], row.dtype))
    width = y.shape[1]
    kept = np.empty(max(most, int(n[-1])) * width, y.dtype)  # one buffer for all gathers: a new one each costs as much again
    i = 0
    while i < len(n):
        j = min(len(n), i + max(1, most // int(n[i])))
        while (j - i) * int(n[j - 1]) * width > len(kept):
            j = i + max(1, (j - i) // 2)
        place = np.arange(n[j - 1])
        k = start[i:j, None] + place
        here = np.take(y, row[k], 0, kept[: k.size * width].reshape(*k.shape, width), "clip")
        z[places[i:j]] += np.matmul(np.where(place < n[i:j, None], x[k], 0)[:, None], here)[:, 0]
        i = j


def orthonormal(z: np.ndarray, block: int = 2048) -> np.ndarray:
    """Orthonormal columns that span those of z, by its Gram matrix; z isn't copied but by ``block`` rows."""
    for _ in range(2):  # the second time for what rounding leaves
        values, turn = np.linalg.eigh(sum(x.T @ x for x in (z[i : i + block].astype(np.float64) for i in range(0, len(z), block))))
        keep = values > 1e-12 * max(values.max(initial=0), 1e-30)
        turn = (turn[:, keep] / np.sqrt(values[keep])).astype(np.float32)
        out = z if keep.all() else np.empty((len(z), turn.shape[1]), np.float32)
        for i in range(0, len(z), block):
            out[i : i + block] = z[i : i + block] @ turn
        z = out
    return z


def decomposed(rows: DataFrame, idf: np.ndarray, rank: int = RANK, iterations: int = 2, tasks: int | None = None, block: int = 2048, held: int = 32_768) -> tuple[np.ndarray, np.ndarray]:
    """(V, s): the leading right singular vectors (TERMS x at most ``rank``) and values of the matrix whose rows are the
    unit TF-IDF vectors of all of ``rows`` (words; or text: all its passages), by randomised subspace iteration.

    A pass gives each task's sums of a^T (a Q), which are added by block of terms in tasks, so the driver gets TERMS x
    (rank + SPARE) numbers a pass, whatever the rows. The last pass's Z = A^T A Q also gives the values: A^T A is about
    Z (Q^T Z)^-1 Z^T (Nystrom), so no further pass reads the rows. As many ``tasks`` as there are cores read
    the rows, so the sums don't grow with them; each takes ``held`` rows at once. No rows: no directions.
    """
    spark = rows.sparkSession
    width, tasks = rank + SPARE, tasks or spark.sparkContext.defaultParallelism
    rows = rows.coalesce(tasks)
    weights = spark.sparkContext.broadcast(idf)

    def vectors(lists: list[pa.ListArray]) -> tuple[np.ndarray, np.ndarray]:
        """Term and weight of each word, rows x the words of the longest: 0 beyond a row's last, and but once for a term that it has twice."""
        size = np.concatenate([x.value_lengths().to_numpy() for x in lists])
        words = np.full((len(size), size.max()), -1, np.int32)
        words[np.arange(size.max()) < size[:, None]] = np.concatenate([x.flatten().to_numpy() for x in lists])
        words.sort(1)
        term, x = np.maximum(words, 0) >> (BITS - LATENT_BITS), np.where(words >= 0, weights.value[words], 0)
        first = np.ones(words.shape, bool)  # of a term's entries in its row
        first[:, 1:] = term[:, 1:] != term[:, :-1]
        first = np.nonzero(first.ravel())[0]
        whole, row = np.add.reduceat(x.ravel(), first), first // words.shape[1]
        x = np.zeros(words.shape, np.float32)
        x.ravel()[first] = whole / np.sqrt(np.bincount(row, whole.astype(np.float64) ** 2, len(size)))[row]
        return term, x

    def product(q: np.ndarray) -> np.ndarray:
        """A^T A q."""
        shared = spark.sparkContext.broadcast(q)
        width = q.shape[1]

        def run(batches):
            z = np.zeros((TERMS, width), np.float32)

            def take(lists: list[pa.ListArray], most: int = 32) -> None:
                term, x = vectors(lists)
                y = np.empty((len(term), 1, width), np.float32)
                kept = np.empty((most, term.shape[1], width), np.float32)
                for i in range(0, len(term), most):
                    here = term[i : i + most]
                    np.matmul(x[i : i + most, None], np.take(shared.value, here, 0, kept[: len(here)], "clip"), out=y[i : i + most])
                some = np.nonzero(x.ravel())[0]
                summed(term.ravel()[some], x.ravel()[some], some // x.shape[1], y[:, 0], z)

            lists: list[pa.ListArray] = []
            for b in batches:
                new = b.column("words") if "words" in b.schema.names else passages(b.column("text").to_pylist())
                lists.append(new.filter(pa.compute.greater(new.value_lengths(), 0)))
                if sum(map(len, lists)) >= held:
                    take(lists)
                    lists = []
            if sum(map(len, lists)):
                take(lists)
            for i in range(0, len(z), block):
                if z[i : i + block].any():
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([z[i : i + block].tobytes()], pa.binary())], names=["i", "x"])

        def add(batches):
            sums: dict[int, np.ndarray] = {}
            for b in batches:
                for i, x in zip(b.column("i").to_pylist(), b.column("x").to_pylist()):
                    x = np.frombuffer(x, np.float32)
                    sums[i] = sums[i] + x if i in sums else x
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["i", "x"])

        z = np.zeros((TERMS, width), np.float32)
        got = rows.mapInArrow(lean(run), "i int, x binary").repartition(2, "i").mapInArrow(lean(add), "i int, x binary").toArrow()
        for i, x in zip(got["i"].to_pylist(), got["x"]):
            z[i : i + block] = np.frombuffer(x.as_buffer(), np.float32).reshape(-1, width)
        shared.destroy()
        return z

    def between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """a^T b."""
        return sum(a[i : i + block].T.astype(np.float64) @ b[i : i + block] for i in range(0, TERMS, block))

    r, z = np.random.Generator(np.random.PCG64(7)), np.empty((TERMS, width), np.float32)
    for i in range(0, TERMS, block):
        z[i : i + block] = r.standard_normal((block, width))
    for k in range(iterations):
        q = orthonormal(z) if k else z
        z = product(q)
        if not z.any():
            return z[:, :0], np.zeros(0)
    core = between(q, z)
    values, turn = np.linalg.eigh((core + core.T) / 2)
    keep = values > 1e-6 * values.max()
    z = z @ (turn[:, keep] / np.sqrt(values[keep])).astype(np.float32)  # A^T A is about z z^T
    values, turn = np.linalg.eigh(between(z, z))
    keep = np.argsort(-values)[:rank]
    keep = keep[values[keep] > 1e-9 * values.max()]
    return z @ (turn[:, keep] / np.sqrt(values[keep])).astype(np.float32), np.sqrt(values[keep])


class Retriever:
    """Candidates of some items: passages whose latent cosine with an item is high enough, and places of short items' words."""

    def __init__(self, its: list[Item], v: np.ndarray, idf: np.ndarray):
        """v: TERMS x directions, as many numbers a word as there are directions."""
        self.its, self.idf, self.v = its, idf, v
        self.z = np.array([self.whole(it.words) for it in its], np.float32).reshape(len(its), v.shape[1])

        # short items by their heaviest words, until what is left is under PART of the item: a leak holds at least one of them
        self.anchors: dict[int, list[int]] = {}
        for i, it in enumerate(its):
            if len(it.words) <= LOOKED_UP:
                words, tf = np.unique(it.words, return_counts=True)
                w = idf[words].astype(np.float64) * tf
                left, least = w.sum(), (1 - 1e-6 if len(it.words) < SHORT_ITEM else PART - 1e-6) * w.sum()
                for k in np.argsort(-w, kind="stable"):
                    if left < least:
                        break
                    left -= w[k]
                    self.anchors.setdefault(int(words[k]), []).append(i)
        self.anchored = np.zeros(len(idf), bool)
        self.anchored[list(self.anchors)] = True
        #: Each item's words, with the weight of all their places in it.
        self.heavy = [dict(zip(w.tolist(), (idf[w] * n).tolist())) for w, n in (np.unique(it.words, return_counts=True) for it in its)]
        self.least = [(PART - 1e-6) * sum(w.values()) for w in self.heavy]
        #: The same as arrays, for likely(): each word's number among all items' (0: in none), each item's numbers and weights.
        self.number = np.zeros(len(idf), np.int32)
        vocab = np.unique(np.concatenate([it.words for it in its])) if its else np.zeros(0, np.int64)
        self.number[vocab] = np.arange(1, len(vocab) + 1)
        self.n_words = len(vocab) + 1
        size = np.array([len(w) for w in self.heavy], np.int64)
        inside = np.arange(size.max(initial=0)) < size[:, None]
        self.has, self.weight = np.zeros(inside.shape, np.int32), np.zeros(inside.shape)
        self.has[inside] = self.number[[x for w in self.heavy for x in w]]
        self.weight[inside] = [x for w in self.heavy for x in w.values()]
        self.enough = np.array(self.least) * (1 - 1e-6)  # lower, for another order of the sum

    def can_be(self, i: int, near: set[int]) -> bool:
        """Whether the words of a place are enough for the item, in whatever order."""
        w = self.heavy[i]
        return sum([w[x] for x in w.keys() & near]) >= self.least[i]

    def likely(self, docs: list[np.ndarray], doc: np.ndarray, item: np.ndarray, at: np.ndarray, most: int = 1 << 22) -> np.ndarray:
        """Which of these places (document, item, first word) can_be() may hold for, all at once: every one that it holds
        for, and next to no others. Those of a place follow each other; tables of ``most`` bytes."""
        reach = np.arange(PASSAGE + 2 * LONGEST_ITEM)
        sizes = np.array([len(w) for w in docs], np.int64)
        number = np.append(self.number[np.concatenate(docs)], 0)
        base = np.cumsum(sizes) - sizes
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (at[1:] != at[:-1])
        firsts, group = np.nonzero(new)[0], np.cumsum(new) - 1
        out = np.zeros(len(doc), bool)
        step = max(1, most // self.n_words)
        stops = np.append(firsts, len(doc))
        for i in range(0, len(firsts), step):
            k = firsts[i : i + step]
            lo, hi = np.maximum(at[k] - LONGEST_ITEM, 0), np.minimum(at[k] + PASSAGE + LONGEST_ITEM, sizes[doc[k]])
            near = number[np.where(reach < (hi - lo)[:, None], (base[doc[k]] + lo)[:, None] + reach, len(number) - 1)]
            there = np.zeros((len(k), self.n_words), bool)
            there.ravel()[near + np.arange(0, there.size, self.n_words)[:, None]] = True
            end = int(stops[min(i + step, len(firsts))])
            for j in range(int(k[0]), end, 1 << 14):
                some = slice(j, min(j + (1 << 14), end))
                it = item[some]
                out[some] = (there[(group[some] - i)[:, None], self.has[it]] * self.weight[it]).sum(1) >= self.enough[it]
        return out

    def short(self, docs: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        """Document, item and first word of a passage of every place where a short item may be."""
        sizes = np.array([len(w) for w in docs], np.int64)
        words = np.concatenate(docs)
        p = np.nonzero(self.anchored[words])[0]
        d = np.searchsorted(np.cumsum(sizes), p, "right")
        of = [self.anchors[w] for w in words[p].tolist()]
        n = np.array([len(x) for x in of], np.int64)
        at = np.maximum(0, p - (np.cumsum(sizes) - sizes)[d] - PASSAGE // 2)
        return np.repeat(d, n), np.array([i for x in of for i in x], np.int64), np.repeat(at, n)

    def latent(self, words: np.ndarray, starts: np.ndarray, sizes: np.ndarray, most: int = 64) -> np.ndarray:
        """Sums of the latent vectors of ``sizes`` words (STRIDE at most) from each start; ``most`` starts at a time."""
        padded = np.append(words, 0)
        place = np.arange(STRIDE)
        out = np.empty((len(starts), 1, self.v.shape[1]), np.float32)
        kept = np.empty((most, STRIDE, self.v.shape[1]), np.float32)  # one buffer for all gathers
        for j in range(0, len(starts), 1 << 14):
            n = sizes[j : j + (1 << 14), None]
            w = padded[np.where(place < n, starts[j : j + (1 << 14), None] + place, len(words))]
            x, term = np.where(place < n, self.idf[w], 0), w >> (BITS - LATENT_BITS)
            for i in range(0, len(w), most):
                here = term[i : i + most]
                np.matmul(x[i : i + most, None], np.take(self.v, here, 0, kept[: len(here)], "clip"), out=out[j + i : j + i + len(here)])
        return out[:, 0]

    def whole(self, words: np.ndarray) -> np.ndarray:
        """Unit latent vector of all of ``words``."""
        starts = np.arange(0, len(words), STRIDE)
        x = self.latent(words, starts, np.minimum(STRIDE, len(words) - starts)).sum(0)
        return x / max(float(np.linalg.norm(x)), 1e-9)

    def cosine(self, i: int, passage: np.ndarray) -> float:
        return float(np.clip(self.z[i] @ self.whole(passage), 0, 1))

    def candidates(self, docs: list[np.ndarray], most: int = 1 << 21) -> tuple[np.ndarray, ...]:
        """Document, item, first word of the passage and cosine of documents that have words, document by document.

        A passage is two blocks of STRIDE words that follow each other (a document of one block is one passage)."""
        sizes = np.array([len(w) for w in docs], np.int64)
        n_blocks = -(-sizes // STRIDE)
        first = np.cumsum(n_blocks) - n_blocks
        doc = np.repeat(np.arange(len(docs)), n_blocks)
        inside = np.arange(len(doc)) - first[doc]
        x = self.latent(np.concatenate(docs), (np.cumsum(sizes) - sizes)[doc] + STRIDE * inside, np.minimum(STRIDE, sizes[doc] - STRIDE * inside))
        last = inside == n_blocks[doc] - 1
        at = np.nonzero(~last | (n_blocks[doc] == 1))[0]
        step = max(1, min(2048, most // max(1, len(self.its))))
        found = []
        for i in range(0, len(at), step):
            k = at[i : i + step]
            both = np.nonzero(~last[k])[0]
            y = x[k]
            y[both] += x[k[both] + 1]
            y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-9)
            score = y @ self.z.T
            p, item = np.divmod(np.nonzero((score >= LEAST_COSINE).ravel())[0], max(1, len(self.its)))
            place = k[p]
            found.append((doc[place], item, STRIDE * inside[place], np.minimum(score[p, item], 1.0)))
        return tuple(np.concatenate(x) for x in zip(*found))

    def places(self, docs: list[np.ndarray]):
        """(document, item, first word, cosine or None) of the candidates of documents that have words which can be leaks
        by the words there: those by their cosines, then those of short items."""
        doc, item, at, cosine = self.candidates(docs)
        some = self.likely(docs, doc, item, at)
        yield from zip(doc[some].tolist(), item[some].tolist(), at[some].tolist(), cosine[some].tolist())
        doc, item, at = self.short(docs)
        some = self.likely(docs, doc, item, at)
        yield from zip(doc[some].tolist(), item[some].tolist(), at[some].tolist(), [None] * len(doc))

    def coverage(self, item: Item, window: np.ndarray) -> tuple[float, float]:
        """Share of the item's idf weight in a longest (heaviest) common subsequence with the window, and of its answer's weight in the window."""
        if len(item.words) < SHORT_ITEM:  # too short for a subsequence to mean anything: the words in a row
            n = len(item.words)
            hit = any(np.array_equal(window[i : i + n], item.words) for i in np.nonzero(window == item.words[0])[0])
            return (1.0, 1.0) if hit else (0.0, 0.0)
        w = self.idf[item.words]
        here = set(window.tolist())  # no subsequence weighs more than the words that are there at all
        if sum([x for x, word in zip(w.tolist(), item.word_list) if word in here]) < (PART - 1e-6) * w.sum():
            return 0.0, 0.0
        best = np.zeros(len(window) + 1)
        for word, x in zip(item.words, w):
            best[1:] = np.maximum.accumulate(np.maximum(best[1:], best[:-1] + x * (window == word)))
        a = self.idf[item.answer]
        answer = float(a[np.isin(item.answer, window)].sum() / a.sum()) if len(a) else 0.0
        return float(best[-1] / w.sum()), answer


def leaks(docs: DataFrame, benchmark: DataFrame, block_parts: int = BLOCK_PARTS) -> DataFrame:
    """doc_id, item_id, cosine, coverage, answer and at (a word's place) of each document and item that it leaks.

    A leak: a common subsequence with FULL of the item's idf weight, or with PART of it and the answer. Items are searched
    together, all in one pass over the documents; where they have more than ``block_parts`` parts, in as many passes as
    that takes (only a block is ever broadcast). Null or empty items and texts match nothing; repeated item_ids are
    items of their own and repeated doc_ids documents of their own; item_id may be of any type; other columns are left out.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = ready(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bench = benchmark.where("trim(text) <> ''").select("item_id", F.col("text").cast("string").alias("text"), *[F.col("answer").cast("string").alias("answer") for c in benchmark.columns if c == "answer"])
    idf, _ = word_idf(docs)
    kind, id_type = bench.schema["item_id"].dataType.simpleString(), to_arrow_type(bench.schema["item_id"].dataType)
    schema = f"doc_id long, item_id {kind}, cosine double, coverage double, answer double, at long"
    v, out = None, None
    for its in blocks(bench, block_parts):
        if v is None:  # one latent space for all blocks
            v, s = decomposed(docs.select("text").unionByName(bench.select("text")), idf)
            v /= s.astype(np.float32)
        shared = spark.sparkContext.broadcast((its, v, idf))

        def run(batches, shared=shared):
            find = Retriever(*shared.value)
            for b in batches:
                cols = [[] for _ in range(6)]
                ids, words = b.column("doc_id").to_pylist(), words_of(b.column("text").to_pylist())
                some = [k for k, w in enumerate(words) if len(w)]
                best: dict = {}
                if some:
                    here, near = None, frozenset()
                    for d, i, a, cosine in find.places([words[k] for k in some]):
                        k = some[d]
                        it, w = find.its[i], words[k]
                        if here != (k, a):  # the words around a passage, for all its candidates
                            here, near = (k, a), set(w[max(0, a - LONGEST_ITEM) : a + PASSAGE + LONGEST_ITEM].tolist())
                        if not find.can_be(i, near):
                            continue
                        n = len(it.words)
                        cover, answer = find.coverage(it, w[max(0, a - n) : a + PASSAGE + n])
                        if cover >= FULL or (cover >= PART and answer >= ANSWER):
                            cosine = find.cosine(i, w[a : a + PASSAGE]) if cosine is None else cosine
                            if (cover, cosine, -a) > best.get((k, it.item_id), (0,)):
                                best[k, it.item_id] = (cover, cosine, -a, answer)
                for (k, item), (cover, cosine, a, answer) in best.items():
                    for c, x in zip(cols, (ids[k], item, cosine, cover, answer, -a)):
                        c.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], id_type), *(pa.array(c, pa.float64()) for c in cols[2:5]), pa.array(cols[5], pa.int64())], names=["doc_id", "item_id", "cosine", "coverage", "answer", "at"])

        found = docs.mapInArrow(lean(run), schema)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def op6_lsi_decontam(spark, sf_dir: str) -> DataFrame:
    """Leaks of the benchmark table in all documents: doc_id, item_id, cosine, coverage, answer, at."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage_decontam(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    gone = leaks(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_gone"))
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti").select(*docs.columns)
