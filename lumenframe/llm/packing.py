"""Packing by lexical retrieval: a sharded BM25 index hands each seed its unused neighbours, which fill its window.

Terms are token ids. Document frequencies and the mean length are those of the whole corpus. A shard is a run of
documents that follow each other in an order by the least hashes of their terms (documents that share terms tend to
be near each other there), so shards are of one size however the corpus is spread: a term, a source or a group of
copies that holds a third of all rows is simply cut into more shards.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import lean, partitions, ready, saved
from lumenframe.llm.tokens import encoder

K1, B = 1.2, 0.75
NONE = np.uint32((1 << 32) - 1)  # above all hashes


def token_table(docs: DataFrame, tokenizer: str, kind: str, end_id: int) -> DataFrame:
    """doc_id, route (the two least hashes of the document's terms), n_terms and ids (packed) of every document; written once."""

    def encode(batches):
        enc = encoder(tokenizer, kind)
        end = np.array([end_id], enc.dtype).tobytes()
        vocab = enc.tok.get_vocab_size()
        mixed = ((np.arange(vocab, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.uint32)
        for b in batches:
            blobs = [x + end for x in enc.many(b.column("text").to_pylist())]
            n = np.array([len(x) // enc.dtype.itemsize for x in blobs], np.int64)
            first = np.cumsum(n) - n
            h = mixed[np.frombuffer(b"".join(blobs), enc.dtype)]
            low = np.minimum.reduceat(h, first) if len(n) else h
            h[h == np.repeat(low, n)] = NONE
            low2 = np.minimum.reduceat(h, first) if len(n) else h
            route = (low.astype(np.uint64) << np.uint64(31)) | np.where(low2 == NONE, low, low2)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(route.view(np.int64)), pa.array(n), pa.array(blobs, pa.binary())], names=["doc_id", "route", "n_terms", "ids"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return saved(rows.mapInArrow(lean(encode), "doc_id long, route long, n_terms long, ids binary"), "packing-tokens")


def corpus_terms(tokens: DataFrame, dtype, vocab: int) -> tuple[np.ndarray, int, float]:
    """Document frequency of each term, documents, mean length: over all documents. At most one row a term comes to the driver."""

    def count(batches):
        df = np.zeros(vocab, np.int64)
        for b in batches:
            for x in b.column("ids").to_pylist():
                df[np.frombuffer(x, dtype)] += 1  # once a document: repeated places of an index count once
        at = np.nonzero(df)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], names=["term", "df"])

    df = np.zeros(vocab, np.int64)
    got = tokens.select("ids").mapInArrow(lean(count), "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df[got["term"].to_numpy()] = got["df"].to_numpy()
    n, mean = tokens.agg(F.count("*"), F.avg("n_terms")).first()
    return df, n, mean or 1.0


class Shard:
    """A BM25 index of some documents; rank(seed) gives the others by falling score, best first, those without a shared query term left out."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float, query_terms: int = 24):
        self.n = len(docs)
        size = np.array([len(x) for x in docs])
        # each document's terms and their counts: one sort of all ids of the shard
        kind, vocab = (np.uint32 if len(docs) * len(idf) < 1 << 32 else np.uint64), len(idf)
        key = np.concatenate(docs).astype(kind)
        key += np.repeat(np.arange(len(docs), dtype=kind) * kind(vocab), size)
        key.sort()
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        first = np.nonzero(new)[0]
        tf = np.diff(first, append=len(key))
        row, term = (x.astype(t) for x, t in zip(np.divmod(key[first], kind(vocab)), (np.int32, np.int64)))
        w = (idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[row] / mean))).astype(np.float32)
        in_shard = np.bincount(term, minlength=len(idf))
        # the terms a seed asks with: its highest weights among those that another document of the shard has
        use = np.nonzero(in_shard[term] > 1)[0]
        bits = max(1, (len(idf) - 1).bit_length())
        if self.n.bit_length() + 31 + bits <= 64:  # in one number: row, falling weight (a float above 0 is ordered as its bits are), term
            low = np.uint64((1 << bits) - 1)
            key = row[use].astype(np.uint64) << np.uint64(31 + bits) | (0x7FFFFFFF - w[use].view(np.int32)).astype(np.uint64) << np.uint64(bits) | term[use].astype(np.uint64)
            key.sort()
            ask_row, ask_term = (key >> np.uint64(31 + bits)).astype(np.int32), (key & low).astype(np.int64)
        else:
            use = use[np.lexsort((term[use], -w[use], row[use]))]
            ask_row, ask_term = row[use], term[use]
        first = np.searchsorted(ask_row, np.arange(self.n))
        asked = np.arange(len(ask_row)) - first[ask_row] < query_terms
        self.ask_row, self.ask_term = ask_row[asked], ask_term[asked]
        self.ask_at = np.searchsorted(self.ask_row, np.arange(self.n + 1))
        by = np.argsort(term.astype(np.uint16) if bits <= 16 else term, kind="stable")
        self.post_doc, self.post_w = row[by], w[by]
        self.post_at = np.concatenate([[0], np.cumsum(in_shard)])

    def rank(self, seed: int) -> np.ndarray:
        a, z = self.ask_at[seed], self.ask_at[seed + 1]
        if a == z:
            return np.zeros(0, np.int64)
        spans = [slice(self.post_at[t], self.post_at[t + 1]) for t in self.ask_term[a:z]]
        s = np.bincount(np.concatenate([self.post_doc[x] for x in spans]), np.concatenate([self.post_w[x] for x in spans]), minlength=self.n)
        s[seed] = 0
        some = np.nonzero(s > 0)[0]
        return some[np.argsort(-s[some], kind="stable")]


def chain(shard: Shard, sizes: np.ndarray, window: int, room: int):
    """The shard's documents in packing order. A seed is the document that opens (or runs on into) a window; its unused
    neighbours follow until the window is full, and the one cut there seeds the next window. room: left in the open window."""
    unused = np.ones(shard.n, bool)
    nxt = 0
    while True:
        while nxt < shard.n and not unused[nxt]:
            nxt += 1
        if nxt == shard.n:
            return
        seed, fresh = nxt, True
        while fresh:
            fresh = False
            if unused[seed]:
                unused[seed] = False
                yield seed
                room -= int(sizes[seed])
            if room <= 0:
                room += window * math.ceil((1 - room) / window)
            near = shard.rank(seed)
            for d in near[unused[near]].tolist():
                unused[d] = False
                yield d
                room -= int(sizes[d])
                if room <= 0:  # cut here: it seeds the next window
                    room += window * math.ceil((1 - room) / window)
                    seed, fresh = d, True
                    break


def pack(docs: DataFrame, tokenizer: str, kind: str = "byte", end_id: int = 1, window: int = 2048, shard_docs: int = 1024, query_terms: int = 24, ids_column: bool = True) -> DataFrame:
    """Pieces of all documents in sequences of at most ``window`` ids (a power of two).

    doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (packed little-endian 32-bit; left out without
    ``ids_column``, as no column that a Python operator makes is pruned by what follows it). Every window
    is full but the last of a task, which is cut into sequences whose lengths are powers of two: nothing is padded.
    Null or empty text: the end id alone. Repeated rows are documents of their own. Extra columns are left out.
    Sequence ids are unique, not gapless.
    """
    spark = ready(docs.sparkSession)
    enc = encoder(tokenizer, kind)
    dtype, vocab = enc.dtype, enc.tok.get_vocab_size()
    tokens = token_table(docs, tokenizer, kind, end_id)
    df, n_docs, mean = corpus_terms(tokens, dtype, vocab)
    idf = spark.sparkContext.broadcast(np.log1p((n_docs - df + 0.5) / (df + 0.5)).astype(np.float32))  # as long as the vocabulary

    def run(batches):
        from pyspark import TaskContext

        seq, pieces = TaskContext.get().partitionId() << 32, []
        held: list[tuple] = []  # documents of the shard that is being gathered
        open_at = 0

        def put(doc, ids):
            """Cut one document into the open window and those after it."""
            nonlocal seq, open_at
            at = 0
            while at < len(ids):
                n = min(window - open_at, len(ids) - at)
                pieces.append([doc, at, n, ids[at : at + n], len(ids), seq, open_at])
                at, open_at = at + n, open_at + n
                if open_at == window:
                    seq, open_at = seq + 1, 0

        def shard():
            ids = [x for _, x in held]
            index = Shard(ids, idf.value, mean, query_terms)
            for i in chain(index, np.array([len(x) for x in ids]), window, window - open_at):
                put(*held[i])
            held.clear()

        def flushed(last: bool):
            nonlocal pieces, seq
            out, pieces = (pieces, []) if last else ([p for p in pieces if p[5] < seq], [p for p in pieces if p[5] == seq])
            if last and open_at:  # the last window: cut at powers of two
                tail, out = [p for p in out if p[5] == seq], [p for p in out if p[5] != seq]
                at, rest = 0, open_at
                edges = []
                while rest:
                    n = 1 << (rest.bit_length() - 1)
                    edges.append((at, at + n))
                    at, rest = at + n, rest - n
                for a, z in edges:
                    for doc, start, n, ids, all_ids, _, off in tail:
                        lo, hi = max(a, off), min(z, off + n)
                        if lo < hi:
                            out.append([doc, start + lo - off, hi - lo, ids[lo - off : hi - off], all_ids, seq, lo - a])
                    seq += 1
            blobs = [p[3].astype("<u4").tobytes() for p in out]
            cols = [pa.array([p[i] for p in out], pa.int64()) for i in (0, 1, 2)] + [pa.array([zlib.crc32(x) for x in blobs], pa.int64())] + [pa.array([p[i] for p in out], pa.int64()) for i in (4, 5, 6)]
            cols += [pa.array(blobs, pa.binary())] * ids_column
            return pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"][: len(cols)])

        for b in batches:
            for doc, x in zip(b.column("doc_id").to_pylist(), b.column("ids").to_pylist()):
                held.append((doc, np.frombuffer(x, dtype)))
                if len(held) == shard_docs:
                    shard()
                    yield flushed(False)
        if held:
            shard()
        yield flushed(True)

    dealt = tokens.repartitionByRange(partitions(spark), "route", "doc_id").sortWithinPartitions("route", "doc_id", "ids")
    return dealt.select("doc_id", "ids").mapInArrow(lean(run), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * ids_column)


def op3_retrieval_packing(spark, sf_dir: str) -> DataFrame:
    """Every document in sequences of 2048: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), "byte", 1, ids_column=False)
