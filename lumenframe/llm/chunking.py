"""Fingerprints of documents by content-defined chunking.

A gear hash (each byte's random number, shifted in: it depends on the last 32 bytes) sets chunk boundaries where its
top bits are zero: more bits before the normal size, fewer after it (normalised chunking), none below the least size,
always at the largest. A fingerprint is the set of the chunks' digests with their lengths; boundaries depend on nearby
bytes only, so an insertion changes the chunks around it and no others. Containment weighs digests by length.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import lean, partitions, ready, spare, table

#: Least, normal and largest chunk, and the zero bits asked for before and after the normal size.
NORMAL = (12, 32, 128, 6, 4)
#: Texts of at most SHORT bytes are cut finely as well; two of them are compared by their fine chunks.
FINE, SHORT = (2, 5, 16, 3, 2), 512

GEAR = np.frombuffer(b"".join(hashlib.blake2b(bytes([i]), digest_size=4).digest() for i in range(256)), "<u4")


def gear(data: np.ndarray) -> np.ndarray:
    """Gear hashes at every byte: sum of GEAR[b[i - j]] << j over j < 32, by doubling."""
    h = GEAR[data]
    for k in (1, 2, 4, 8, 16):
        if len(h) <= k:
            break
        more = h.copy()
        more[k:] += h[:-k] << np.uint32(k)
        h = more
    return h


def cuts(data: bytes, sizes=NORMAL) -> list[int]:
    """Ends of the chunks of ``data``."""
    least, normal, most, hard_bits, easy_bits = sizes
    n = len(data)
    if n <= least:
        return [n] if n else []
    h = gear(np.frombuffer(data, np.uint8))
    easy = np.nonzero((h >> np.uint32(32 - easy_bits)) == 0)[0]
    hard = easy[(h[easy] >> np.uint32(32 - hard_bits)) == 0].tolist()
    easy = easy.tolist()
    hard.append(n)
    easy.append(n)
    out, at, i, j, ni, nj = [], 0, 0, 0, len(hard) - 1, len(easy) - 1
    while at < n:
        i = bisect_left(hard, at + least - 1, i, ni)
        end = hard[i] + 1
        if end > at + normal:
            j = bisect_left(easy, at + normal, j, nj)
            end = min(easy[j] + 1, at + most)
        at = min(end, n)
        out.append(at)
    return out


def digests(data: bytes, sizes=NORMAL) -> dict[int, int]:
    """Digest (32 bits) of each distinct chunk -> its length."""
    out, a = {}, 0
    for z in cuts(data, sizes):
        out[zlib.crc32(data[a:z])] = z - a
        a = z
    return out


def chunks(text: str) -> tuple[dict[int, int], dict[int, int] | None]:
    """A text's fingerprint: its chunks, and its fine chunks if it is short."""
    data = text.encode("utf-8", "replace")
    return digests(data), digests(data, FINE) if len(data) <= SHORT else None


def text_of(prints) -> str:
    """Sorted digests and lengths: '1a2b3c4d:2f' (hex), joined by spaces; a short text's fine ones follow after '| '. Empty text: '|'.

    Some 12 characters a chunk of about 32 bytes: a third of the text, for short texts some 2.4 times as long as they are."""
    both = [" ".join([f"{d:08x}:{n:x}" for d, n in sorted(x.items())]) for x in prints if x is not None]
    return " | ".join(both).strip()


def containment(a, b) -> float:
    """Length of the shared chunks over that of the smaller set; 1 for two empty texts, 0 for one."""
    a, b = (a[1], b[1]) if a[1] is not None and b[1] is not None else (a[0], b[0])
    if not a or not b:
        return 1.0 if a == b else 0.0
    small, big = (a, b) if len(a) <= len(b) else (b, a)
    both = sum([small[d] for d in small.keys() & big.keys()])
    return min(1.0, both / min(sum(a.values()), sum(b.values())))


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, fingerprint and n_chunks of every whole text (null: empty)."""
    ready(docs.sparkSession)
    rows = docs.select(*[F.col(c) for c in keep], F.col("text").cast("string").alias(spare(keep)))
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches):
        for b in batches:
            got = [chunks(t or "") for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 1)), pa.array([text_of(x) for x in got], pa.string()), pa.array([len(x[0]) for x in got], pa.int32())], names=[*b.schema.names[:-1], "fingerprint", "n_chunks"])

    return rows.mapInArrow(lean(run), f"{kind}, fingerprint string, n_chunks int")


def with_next(docs: DataFrame, fn, schema: str) -> DataFrame:
    """Apply ``fn(pairs)`` to (doc_id, text, next text) of all rows in falling doc_id; after the last comes the first.

    Rows go to ranges of doc_id (so many as there are shuffle partitions, equal in rows), one shuffle of the texts. Each range also gets
    the row that comes next after its last one, so ranges need nothing of each other. The driver sees the least and
    the largest id of each range. Repeated ids: in falling order of their texts; null ids: last.
    """
    spark = ready(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = partitions(spark) + 1  # null ids are a part of their own
    edges = sorted({int(x) for x in rows.approxQuantile("doc_id", [i / (n - 1) for i in range(1, n - 1)], 0.2 / n)}) if n > 2 else []
    # null ids count as below all others
    split = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(F.size(F.filter(F.lit(edges).cast("array<long>"), lambda e: e <= F.col("doc_id"))))
    rows = rows.withColumn("part", split.cast("int"))
    # only ids are read here; the next row's text of a part is that of the largest (id, text) in the part below
    tops = sorted((r["part"], r["top"]) for r in rows.groupBy("part").agg(F.max("doc_id").alias("top")).collect())
    if not tops:
        return rows.mapInArrow(lambda batches: iter(()), schema)
    after = [(tops[i][1], tops[(i + 1) % len(tops)][0]) for i in range(len(tops))]  # that part's last row is followed by this id
    after = F.broadcast(spark.createDataFrame(after, "top long, target int"))  # a row a part
    rows = rows.join(after, F.col("doc_id").eqNullSafe(F.col("top")), "left")
    own, guest = F.struct("part", F.lit(False).alias("guest")), F.when(F.col("target").isNotNull(), F.struct(F.col("target").alias("part"), F.lit(True).alias("guest")))
    twice = rows.select("doc_id", "text", F.explode(F.array_compact(F.array(own, guest))).alias("p"))
    dealt = twice.select("p.part", "p.guest", "doc_id", "text").repartitionById(n, F.col("part") + 1)  # a task a part
    dealt = dealt.sortWithinPartitions(F.col("part"), F.col("guest"), F.col("doc_id").desc_nulls_last(), F.col("text").desc())

    def run(batches):
        part, held, done = None, None, True
        out: list[tuple] = []
        for b in batches:
            for p, guest, doc, text in zip(*(b.column(c).to_pylist() for c in ("part", "guest", "doc_id", "text"))):
                if p != part:
                    part, held, done = p, None, False
                if done:
                    continue  # further guests: repeats of an id; the first of them is next
                if held is not None:
                    out.append((*held, text))
                held, done = (doc, text), guest
            if out:
                yield fn(out)
                out = []

    return dealt.mapInArrow(lean(run), schema)


def op7_chunk_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprint of every text and of its edited text, and their likeness: see the contract's columns."""

    def compare(rows):
        cols = [[] for _ in range(7)]
        last = None  # the next text of one row is the text of the following one
        for doc, text, nxt in rows:
            n = len(text)
            cut = n // 3
            edited = text[: n - cut] + nxt[:cut]
            own = last[1] if last is not None and last[0] is text else chunks(text)
            other = chunks(nxt)
            last = (nxt, other)
            new = chunks(edited)
            for c, v in zip(cols, (doc, n, hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest(), text_of(own), text_of(new), containment(own, new), containment(own, other))):
                c.append(v)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return with_next(table(spark, sf_dir, "documents"), compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
