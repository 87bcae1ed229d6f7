"""What the operators of this subpackage share: scratch tables, code shipping, word caches."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: Rows of an Arrow batch: some MB of text at usual lengths, so a worker's memory stays small.
BATCH_ROWS, BATCH_BYTES = 512, 32 << 20


def ready(spark: SparkSession) -> SparkSession:
    """Ship this package to the executors and bound their Arrow batches; call it before any Python operator."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    sc = spark.sparkContext
    if getattr(sc, "_lumenframe_zip", None) is None:
        top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        fd, name = tempfile.mkstemp(suffix=".zip", prefix="lumenframe-")
        os.close(fd)
        with zipfile.ZipFile(name, "w") as z:
            for d, _, files in os.walk(top):
                for f in files:
                    if f.endswith(".py"):
                        z.write(os.path.join(d, f), os.path.relpath(os.path.join(d, f), os.path.dirname(top)))
        sc.addPyFile(name)
        sc._lumenframe_zip = name
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster; a folder of our own only where the setting is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        root = tempfile.mkdtemp(prefix="lumenframe-")
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir()
    return root


def scratch(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark).rstrip('/')}/lumenframe/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a table in the shared folder: written once, read by all that follows."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spare(names, name: str = "_text") -> str:
    """``name``, longer until none of ``names`` is it in any case."""
    taken = {x.lower() for x in names}
    while name in taken:
        name = f"_{name}"
    return name


def lean(run):
    """``run`` for mapInArrow, that gives memory back to the system when its task is done: workers are kept, several an executor."""

    def out(batches):
        yield from run(batches)
        import ctypes
        import gc

        import pyarrow as pa

        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return out


class WordIds(dict):
    """word -> number by a rule; remembers the first ``most`` words (frequent ones come early), so memory is bounded."""

    def __init__(self, rule, most: int = 200_000):
        super().__init__()
        self.rule, self.most = rule, most

    def __missing__(self, word):
        out = self.rule(word)
        if len(self) < self.most:
            self[word] = out
        return out


WORD_EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def bare(word: str) -> str:
    """Lower case, without punctuation at the ends; a word of punctuation only stays itself."""
    low = word.lower()
    if low.isalpha():
        return low
    if low[:-1].isalpha() and low[-1] in ".,":
        return low[:-1]
    return WORD_EDGES.sub("", low) or low


def crc(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass"))


_INSIDE = np.array([chr(i).isalnum() if i < 128 else True for i in range(256)])
_INSIDE_TABLE = _INSIDE.astype(np.uint8).tobytes()
_MARKS = re.compile("[\xa0-\xbf\xd7\xf7\u2000-\u206f\u3000-\u303f\uff00-\uff0f]")
#: Masks of the first n bytes of a little-endian word.
FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
LONG = 256  # longer spans are hashed or compared one by one


def eights(raw: bytes) -> np.ndarray:
    """The eight bytes from each place of ``raw`` on, as little-endian words (zeros after its end): a view, nothing is copied per place."""
    return np.ndarray((len(raw) + 1,), "<u8", raw + bytes(8), 0, (1,))


def span_hashes(raw: bytes, a: np.ndarray, z: np.ndarray, words: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of the spans raw[a:z]. Eight bytes at a time, each mixed in by steps that aren't linear, so no family
    of spans collides as those of a polynomial do; spans over LONG bytes by xxh3. Every step can be undone, so spans of
    one length of at most eight bytes never share a hash."""
    words = eights(raw) if words is None else words
    n = z - a
    h = n.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    todo, at = slice(None), a
    left = n
    long = np.nonzero(n > LONG)[0]
    while True:
        x = h[todo] ^ (words[at] & FIRST[np.minimum(left, 8)])
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        h[todo] = x ^ (x >> np.uint64(32))
        more = np.nonzero((left > 8) & (left <= LONG))[0]
        if not len(more):
            break
        todo = more if isinstance(todo, slice) else todo[more]
        at, left = at[more] + 8, left[more] - 8
    if len(long):
        import xxhash

        h[long] = [xxhash.xxh3_64_intdigest(raw[i:j]) for i, j in zip(a[long].tolist(), z[long].tolist())]
    return h


def runs(data: np.ndarray, table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that ``table`` (0 or 1 for each byte) has 1 for; the last byte has 0."""
    x = np.frombuffer(b"\0" + data.tobytes().translate(table), np.uint8)
    edges = np.nonzero(x[1:] != x[:-1])[0]
    return edges[::2], edges[1::2]


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of letters and digits (any byte of a character outside ASCII counts as one); the last byte is no letter."""
    return runs(data, _INSIDE_TABLE)


_SPACE = np.isin(np.arange(256), [0, 9, 10, 11, 12, 13, 28, 29, 30, 31, 32])


def bare_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words between white space, without the marks at their ends; a word of marks only stays
    itself. The last byte of ``data`` is white space."""
    edge = np.diff((~_SPACE[data]).astype(np.int8), prepend=0)
    a, z = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    letters = np.nonzero(_INSIDE[data])[0]
    i, j = np.searchsorted(letters, a), np.searchsorted(letters, z)
    some = np.nonzero(i < j)[0]
    a[some], z[some] = letters[i[some]], letters[j[some] - 1] + 1
    return a, z


def hashed_words(texts: list[str | None], bits: int, chunk: int = 1 << 18, spans=word_spans) -> list[np.ndarray]:
    """Hashes of ``bits`` bits (64: unsigned, never 0) of each text's words (those of ``spans``, in lower case), in order, all in numpy."""
    none = np.zeros(0, np.uint64 if bits == 64 else np.int64)
    out, held, places, size = [none] * len(texts), [], [], 0

    def flush() -> None:
        raw = b"\0".join(held) + b"\0"
        a, z = spans(np.frombuffer(raw, np.uint8))
        h = span_hashes(raw, a, z) | np.uint64(1)
        h = h if bits == 64 else (h >> np.uint64(64 - bits)).astype(np.int64)
        stops = np.searchsorted(a, np.cumsum([len(x) + 1 for x in held])).tolist()
        for i, lo, hi in zip(places, [0, *stops], stops):
            out[i] = h[lo:hi]

    for i, t in enumerate(texts):
        if not t:
            continue
        t = t.lower()
        held.append((t if t.isascii() or not _MARKS.search(t) else _MARKS.sub(" ", t)).encode("utf-8", "surrogatepass"))
        places.append(i)
        size += len(held[-1])
        if size >= chunk:
            flush()
            held, places, size = [], [], 0
    if held:
        flush()
    return out
