"""Token ids by the ``tokenizers`` library, and a Parquet format of them.

Both vocabularies used here never merge across white space, nor across the parts that their own patterns cut, so a
text's ids are those of its parts one after another. Parts repeat: each distinct one is encoded by the library once and
remembered (white-space pieces first, the parts of new pieces next); texts are cut, and their pieces looked up, in
numpy (by a hash, then by their bytes). Pieces with other than Latin letters, and texts with unusual white space, go
through the library's whole chain of steps; texts that hold one of a vocabulary's special tokens go to it whole.
``tests/llm`` holds the two ways against each other.
"""

from __future__ import annotations

import codecs
import gc
import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.common import FIRST, LONG, eights, lean, partitions, ready, runs, scratch, span_hashes

#: Python takes these for white space, the library doesn't.
ODD = re.compile(r"[\x1c-\x1f]")
BYTE_PIECES = re.compile(r" ?\S+|\s+(?!\S)|\s+").findall
#: Letters whose classes and lower case are the same in every Unicode version, and which no normal form changes.
PLAIN = re.compile("[\0-\u012f\u0131-\u024f]*").fullmatch
#: A mark that stands alone as a part after a word.
MARKS = tuple(".,;:!?)")
#: The patterns of the two vocabularies' own files.
BYTE_PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
WORD_PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall


#: The letter that a byte-level vocabulary has for each byte, and what stands between parts (never in plain ones, in lower case either).
BYTE_LETTERS = "".join(chr(b) if b in {*range(33, 127), *range(161, 173), *range(174, 256)} else chr(256 + b - sum(x <= b for x in (*range(33, 127), *range(161, 173), *range(174, 256)))) for b in range(256))
BETWEEN = "\u0250"
BETWEEN_LETTERS = codecs.charmap_decode(BETWEEN.encode(), "strict", BYTE_LETTERS)[0]
#: White space that isn't one ASCII byte, and characters that the two libraries class differently: such texts go piece by piece.
WIDE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\x00]")
END = 0x1C  # between texts
SPACES = (9, 10, 11, 12, 13, 32)
SPACE_TABLE = bytes(b in SPACES for b in range(256))
TEXT_TABLE = bytes(b != END and b not in SPACES for b in range(256))


class Pool:
    """piece -> its ids: an open-addressing table by hash in numpy, the pieces' bytes, and one array of ids; some 50 bytes a piece."""

    def __init__(self, dtype, bits: int):
        self.mask = (1 << bits) - 1
        self.keys = np.zeros(1 << bits, np.uint64)
        self.at, self.n = np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.int32)
        self.byte_at, self.byte_n = np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.int32)
        self.ids, self.used, self.count, self.most = np.zeros(1 << 16, dtype), 0, 0, (1 << bits) * 6 // 10
        self.bytes, self.bytes_used = np.zeros(1 << 18, np.uint8), 0
        self._view()

    def _view(self) -> None:
        self.words = np.ndarray((len(self.bytes) - 8,), "<u8", self.bytes, 0, (1,))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Slot of each hash, -1 where it isn't known."""
        slot = (h & np.uint64(self.mask)).astype(np.int64)
        key = self.keys[slot]
        out = np.where((key == h) & (h != 0), slot, -1)
        todo = np.nonzero((key != h) & (key != 0) & (h != 0))[0]
        while len(todo):
            s = (slot[todo] + 1) & self.mask
            slot[todo] = s
            key = self.keys[s]
            hit = key == h[todo]
            out[todo[hit]] = s[hit]
            todo = todo[~hit & (key != 0)]
        return out

    def verified(self, slot: np.ndarray, raw: bytes, words: np.ndarray, a: np.ndarray, z: np.ndarray) -> np.ndarray:
        """``slot``, with -1 where the piece raw[a:z] isn't, byte for byte, the one that the slot holds. (Of at most eight
        bytes, one length and one hash are one piece.)"""
        n = z - a
        good = (slot >= 0) & (self.byte_n[slot] == n)
        todo, here = np.nonzero(good & (n > 8))[0], 0
        at = self.byte_at[slot]
        while len(todo):
            left = n[todo] - here
            same = (words[a[todo] + here] ^ self.words[at[todo] + here]) & FIRST[np.minimum(left, 8)] == 0
            good[todo[~same]] = False
            here += 8
            todo = todo[same & (left > 8) & (n[todo] <= LONG)]
        for i in np.nonzero(good & (n > LONG))[0].tolist():
            good[i] = raw[a[i] : z[i]] == self.bytes[at[i] : at[i] + n[i]].tobytes()
        return np.where(good, slot, -1)

    def add(self, h: np.ndarray, pieces: list[bytes], blobs: list[bytes]) -> None:
        """Add pieces with distinct new hashes."""
        size = self.ids.itemsize
        n = np.array([len(b) // size for b in blobs], np.int32)
        new = np.frombuffer(b"".join(blobs), self.ids.dtype)
        while self.used + len(new) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(new)] = new
        at = self.used + np.concatenate([[0], np.cumsum(n)[:-1]])
        self.used += len(new)
        self.count += len(h)
        byte_n = np.array([len(x) for x in pieces], np.int32)
        text = np.frombuffer(b"".join(pieces), np.uint8)
        if self.bytes_used + len(text) + 8 > len(self.bytes):
            self.bytes = np.concatenate([self.bytes, np.zeros(len(self.bytes) + len(text), np.uint8)])
            self._view()
        self.bytes[self.bytes_used : self.bytes_used + len(text)] = text
        byte_at = self.bytes_used + np.concatenate([[0], np.cumsum(byte_n)[:-1]])
        self.bytes_used += len(text)
        slot, todo = (h & np.uint64(self.mask)).astype(np.int64), np.arange(len(h))
        while len(todo):
            s = slot[todo]
            free = np.nonzero(self.keys[s] == 0)[0]
            s_free, first = np.unique(s[free], return_index=True)
            won = todo[free[first]]
            self.keys[s_free], self.at[s_free], self.n[s_free], self.byte_at[s_free], self.byte_n[s_free] = h[won], at[won], n[won], byte_at[won], byte_n[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & self.mask


class Encoder:
    """ids(text) -> bytes of little-endian unsigned 16- or 32-bit ids, those of the library with add_special_tokens=False.
    kind: 'byte' keeps white space, 'word' drops it and case.

    A piece is found by a 64-bit hash and compared byte by byte. The first pieces of up to LONGEST bytes fill the table
    (frequent ones come early); others are encoded each time they occur in a call."""

    LONGEST = 4096

    def __init__(self, path: str, kind: str, bits: int = 21, most_parts: int = 300_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tok, self.bare = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.specials = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False, use_regex=False)
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 65536 else "<u4")
        self.model, self.per_call = Tokenizer(self.tok.model), 1000  # a call's words: with more, its work grows faster than they do
        suffix = getattr(self.tok.model, "end_of_word_suffix", None) or ""
        self.id_bytes = np.zeros(self.tok.get_vocab_size(), np.int64)  # of text that an id stands for: a character of its name is a byte
        for name, i in self.tok.get_vocab().items():
            self.id_bytes[i] = len(name) - len(suffix) * (bool(suffix) and name.endswith(suffix))
        self.word = kind == "word"
        self.pieces, self.parts = (str.split, WORD_PARTS) if self.word else (BYTE_PIECES, BYTE_PARTS)
        self.pool, self.most_parts = Pool(self.dtype, bits), most_parts
        self.part_cache: dict[str, bytes] = {}

    def _run(self, tok, pieces: list[str], into: dict[str, bytes]) -> None:
        for i in range(0, len(pieces), 20_000):
            part = pieces[i : i + 20_000]
            got = [e.ids for e in tok.encode_batch_fast(part, add_special_tokens=False)]
            at = np.concatenate([[0], np.cumsum([*map(len, got)])]) * self.dtype.itemsize
            blob, at = np.fromiter(chain.from_iterable(got), self.dtype, int(at[-1]) // self.dtype.itemsize).tobytes(), at.tolist()
            into.update(zip(part, (blob[a:z] for a, z in zip(at, at[1:]))))

    def _run_parts(self, parts: list[str], into: dict[str, bytes]) -> None:
        """Ids of parts of plain letters, many in a call of the library: each is a word of its own to it, written as its byte
        letters. It gives one list of ids for all; where a part's ids end follows from the bytes that each id stands for."""
        for i in range(0, len(parts), self.per_call):
            some = parts[i : i + self.per_call]
            raw = BETWEEN.join(some).encode()
            words = codecs.charmap_decode(raw, "strict", BYTE_LETTERS)[0].split(BETWEEN_LETTERS)
            ids = np.array(self.model.encode_batch_fast([words], is_pretokenized=True, add_special_tokens=False)[0].ids, self.dtype)
            ends, want = np.cumsum(self.id_bytes[ids]), np.cumsum([*map(len, words)])
            at = np.searchsorted(ends, want)
            if len(words) != len(some) or not len(ends) or ends[-1] != want[-1] or (ends[at] != want).any():  # a vocabulary without all bytes
                self._run(self.bare, some, into)
                continue
            blob, at = ids.tobytes(), ((at + 1) * self.dtype.itemsize).tolist()
            into.update(zip(some, [blob[a:z] for a, z in zip([0, *at], at)]))

    def learn(self, new: list[str]) -> list[bytes]:
        """Ids of pieces, in order."""
        whole, cut = [], []
        word, parts = self.word, self.parts
        for p in new:
            if not (p.isascii() or PLAIN(p)):
                whole.append(p)
                cut.append(None)
                continue
            body = p.lower() if word else p
            core = body if word or body[0] != " " else body[1:]
            if core.isalpha():  # most words: one part, or one and a mark
                cut.append((body,))
            elif core[-1:] in MARKS and core[:-1].isalpha():
                cut.append((body[:-1], body[-1]))
            else:
                cut.append(parts(body))
        known = self.part_cache
        missing = list({x for xs in cut if xs is not None for x in xs}.difference(known))
        here = known if len(known) + len(missing) <= self.most_parts else {}
        self._run_parts(missing, here)
        get = here.__getitem__ if here is known else lambda x: here[x] if x in here else known[x]
        odd: dict[str, bytes] = {}
        self._run(self.tok, whole, odd)
        return [odd[p] if xs is None else get(xs[0]) if len(xs) == 1 else b"".join(map(get, xs)) for p, xs in zip(new, cut)]

    def spans(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pieces of texts that END follows: the rules of BYTE_PIECES, or of a split at white space."""
        a, z = runs(data, TEXT_TABLE)  # data ends with END
        if self.word:
            return a, z
        ra, rz = runs(data, SPACE_TABLE)
        before = data[rz] != END  # a word follows: it takes a last blank with it; what else is last stands alone
        alone = before & (data[rz - 1] != 32)
        more = before & (rz - ra > 1)
        starts = np.concatenate([np.where((a > 0) & (data[a - 1] == 32), a - 1, a), ra[~before], ra[more], rz[alone] - 1])
        ends = np.concatenate([z, rz[~before], rz[more] - 1, rz[alone]])
        order = np.argsort(starts, kind="stable")
        return starts[order], ends[order]

    def _some(self, texts: list[bytes]) -> list[bytes]:
        raw = b"\x1c".join(texts) + b"\x1c"
        data = np.frombuffer(raw, np.uint8)
        a, z = self.spans(data)
        words = eights(raw)
        h = span_hashes(raw, a, z, words)
        slot = self.pool.find(h)
        slot = self.pool.verified(slot, raw, words, a, z)
        extra_at = np.zeros(0, np.int64)
        new = np.nonzero(slot < 0)[0]
        if len(new):
            number: dict[bytes, int] = {}
            back = np.array([number.setdefault(raw[i:j], len(number)) for i, j in zip(a[new].tolist(), z[new].tolist())], np.int64)
            pieces = list(number)
            blobs = self.learn([x.decode() for x in pieces])
            first = np.full(len(pieces), -1, np.int64)
            first[back[::-1]] = new[::-1]
            keys, one = np.unique(h[first], return_index=True)  # of pieces that share a hash, one has its place
            fits = (keys != 0) & (self.pool.find(keys) < 0) & (z[first[one]] - a[first[one]] <= self.LONGEST)
            keys, one = keys[fits], one[fits]
            if len(keys) and self.pool.count + len(keys) <= self.pool.most:
                self.pool.add(keys, [pieces[i] for i in one.tolist()], [blobs[i] for i in one.tolist()])
                kept = np.zeros(len(pieces), bool)
                kept[one] = True
                slot[new] = np.where(kept[back], self.pool.find(h[new]), -1)
            extra_at = new[slot[new] < 0]
            back = back[slot[new] < 0]
        n, at, ids = self.pool.n[slot].astype(np.int64), self.pool.at[slot].astype(np.int64), self.pool.ids
        if len(extra_at):  # ids of pieces that the table has no room for stand behind its own, for this call
            size = self.dtype.itemsize
            m = np.array([len(b) // size for b in blobs], np.int64)
            ids = np.concatenate([ids[: self.pool.used], np.frombuffer(b"".join(blobs), self.dtype)])
            n[extra_at], at[extra_at] = m[back], (self.pool.used + np.concatenate([[0], np.cumsum(m)[:-1]]))[back]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        flat = ids[np.repeat(at - (ends - n), n) + np.arange(total)].tobytes()
        stops = np.cumsum([len(t) + 1 for t in texts])
        to = np.concatenate([[0], ends])[np.searchsorted(a, stops)] * self.dtype.itemsize
        to = [0, *to.tolist()]
        return [flat[i:j] for i, j in zip(to, to[1:])]

    def many(self, texts: list[str | None], chunk: int = 1 << 18) -> list[bytes]:
        gc.disable()  # only lists, strings and arrays here: nothing that could form a cycle
        try:
            out: list[bytes] = [b""] * len(texts)
            held, places, size = [], [], 0
            for i, t in enumerate(texts):
                if not t:
                    continue
                special = any([x in t for x in self.specials])
                if special or WIDE.search(t):
                    out[i] = np.array(self.tok.encode(t, add_special_tokens=False).ids, self.dtype).tobytes() if special or ODD.search(t) else b"".join(self.learn(self.pieces(t)))
                    continue
                held.append(t.encode())
                places.append(i)
                size += len(held[-1])
                if size >= chunk:
                    for k, x in zip(places, self._some(held)):
                        out[k] = x
                    held, places, size = [], [], 0
            if held:
                for k, x in zip(places, self._some(held)):
                    out[k] = x
            return out
        finally:
            gc.enable()

    def ids(self, text: str | None) -> bytes:
        return self.many([text])[0]


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, kind: str) -> Encoder:
    """One for each worker process and vocabulary."""
    if (path, kind) not in _ENCODERS:
        _ENCODERS[path, kind] = Encoder(path, kind)
    return _ENCODERS[path, kind]


def write_tokens(docs: DataFrame, out: str, tokenizer: str, kind: str = "word", end_id: int = 2, row_group_mb: int = 64, page_rows: int = 256, n: int | None = None) -> str:
    """Write ``documents`` as token ids, in ascending doc_id, into Parquet files under ``out``.

    One row per document: doc_id, part (number of the file's range), local_start (ids of the part before it),
    n_tokens, ids list<int>. Ids are dictionary-encoded, the ascending columns delta-encoded (Parquet v2 pages);
    row groups and pages are small enough that the column and offset indexes, which the writer always adds,
    let a reader take the pages of some documents, or the metadata columns without any id.
    Null or empty text: only the end id. Repeated doc_ids: in the order of their texts. Extra columns are left out.
    """
    spark = ready(docs.sparkSession)
    n = n or partitions(spark)

    def encode(batches):
        from pyspark import TaskContext

        enc, part, seen = encoder(tokenizer, kind), TaskContext.get().partitionId(), 0
        end = np.array([end_id], enc.dtype).tobytes()
        for b in batches:
            blobs = [x + end for x in enc.many(b.column("text").to_pylist())]
            sizes = np.array([len(x) // enc.dtype.itemsize for x in blobs], np.int64)
            at = np.concatenate([[0], np.cumsum(sizes)])
            ids = np.frombuffer(b"".join(blobs), enc.dtype).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(np.full(len(blobs), part, np.int32)), pa.array(seen + at[:-1]), pa.array(sizes), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids))],
                names=["doc_id", "part", "local_start", "n_tokens", "ids"],
            )
            seen += int(at[-1])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange(n, "doc_id").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    (
        rows.mapInArrow(lean(encode), "doc_id long, part int, local_start long, n_tokens long, ids array<int>")
        .write.option("compression", "zstd")
        .option("parquet.writer.version", "v2")
        .option("parquet.block.size", row_group_mb << 20)
        .option("parquet.page.row.count.limit", page_rows)
        .option("parquet.enable.dictionary#doc_id", "false")
        .option("parquet.enable.dictionary#local_start", "false")
        .parquet(out)
    )
    return out


def read_tokens(spark: SparkSession, path: str, where=None, columns: tuple[str, ...] = ("ids",)) -> DataFrame:
    """doc_id, start, n_tokens and ``columns`` of the documents that ``where`` selects.

    ``where`` on doc_id reaches the scan, so row groups and pages without such documents aren't read; the parts'
    first positions come from two metadata columns. One row a part (as many as shuffle partitions) goes to the driver.
    """
    rows = spark.read.parquet(path)
    sums = sorted(rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    base, at = [], 0
    for r in sums:
        base.append((r["part"], at))
        at += r["n"]
    bases = spark.createDataFrame(base, "part int, base long")
    if where is not None:
        rows = rows.where(where)
    return rows.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", *columns)


def op10_token_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written in ascending doc_id and read back: doc_id, start, n_tokens, ids_crc32."""
    import public_tokenizers

    ready(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = write_tokens(docs, scratch(spark, "tokens"), public_tokenizers.path("word_bpe_49k.json"), "word", 2)

    def digest(batches):
        for b in batches:
            lists = b.column("ids")
            at, ids = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            ids = ids.astype("<u4")
            crc = [zlib.crc32(ids[i:j].tobytes()) for i, j in zip(at[:-1], at[1:])]
            n = np.diff(at).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), pa.array(n), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return read_tokens(spark, path).mapInArrow(lean(digest), "doc_id long, start long, n_tokens long, ids_crc32 long")
