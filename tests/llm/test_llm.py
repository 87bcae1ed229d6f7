"""Operators of the llm subpackage: brute force, exact round trips, held-out accuracy, and odd inputs."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from lumenframe.llm import chunking, decontam, langid, neardup, packing, scoring, substrings, tokens, toxicity, warc

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls, empty and odd texts, ties and repeats.
ODD = [(None, "no id at all"), (1, None), (2, ""), (3, "  \n\t "), (4, "one"), (4, "one"), (5, "\x1c odd \x00 ends\x85 ŧ 漢字 👍🏽 ́"), (6, "1 2 3 4 5 6 7 8 9 0"), (7, "word " * 3000), (8, "Ångström ẞtraße ΣΑΣ İI"), (9, "x" * 5000), (9, "another text of nine")]


def docs_of(spark, rows, extra=False):
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)
    return df.withColumns({"text2": F.lit("x"), "spans": F.lit(1), "bands": F.lit(2), "part": F.lit(3), "_text": F.lit("z"), "ids": F.lit(4), "key": F.lit(5)}) if extra else df


def prose(seed, n, vocab=400):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(vocab)]
    return [" ".join(r.choice(words) for _ in range(r.randint(60, 200))) for _ in range(n)]


# --- tokens and packing ---

FILES = {"word": "word_bpe_49k.json", "byte": "byte_bpe_50k.json"}


@pytest.mark.parametrize("kind", ["word", "byte"])
def test_encoder_is_the_library(kind):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(FILES[kind])
    lib = Tokenizer.from_file(path)
    own = tokens.Encoder(path, kind, bits=6, most_parts=50)  # so small that everything overflows
    r = random.Random(2)
    letters = "ab'sS tΣσİſé́  \n\t \x1c\x85\x00  .,1²٣½ñ漢가😀‍_ÅÅ"
    texts = [t for _, t in ODD if t] + ["<|endoftext|> it's", "hello <|endoftext|> world", "<|startoftext|>x<|ENDOFTEXT|> <|endoftext", "a  b   c\n\n d ", " lead", "x " * 200] + ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(1500)]
    for got, t in zip(own.many(texts), texts):
        assert got == np.array(lib.encode(t, add_special_tokens=False).ids, own.dtype).tobytes(), repr(t)


@pytest.mark.parametrize("kind", ["word", "byte"])
def test_parts_are_encoded_many_in_a_call(kind):
    """Ids of parts from one call of the library for all are those of a call each, also where their ends can't be told."""
    own = tokens.Encoder(public_tokenizers.path(FILES[kind]), kind)
    own.per_call = 70
    r = random.Random(6)
    letters = "abcdeETS'.,!019éñüßſ\u0180\u0181\u01c5\u023a\u024f"
    parts = list(dict.fromkeys([" " * (kind == "byte") * r.randint(0, 1) + "".join(r.choice(letters) for _ in range(r.randint(1, 12))) for _ in range(500)] + ["\n\n", "\t", " ", "x" * 3000]))
    parts = parts if kind == "byte" else list(dict.fromkeys(p.strip().lower() for p in parts if p.strip()))
    want, got, calls = {}, {}, []
    own._run(own.bare, parts, want)
    run, own._run = own._run, lambda tok, some, into: (calls.append(len(some)), run(tok, some, into))
    own._run_parts(parts, got)
    assert got == want and list(got) == parts and not calls
    own.id_bytes = own.id_bytes + 1
    got = {}
    own._run_parts(parts, got)
    assert got == want and sum(calls) == len(parts)


@pytest.mark.parametrize("vocab", [300, (1 << 22) + 1])
def test_shard_index(vocab):
    """Terms, counts and the heaviest query terms of a shard against a count and a sort of each document; a vocabulary too large for one number, too."""
    r = np.random.default_rng(8)
    docs = [np.append(r.zipf(1.4, r.integers(0, 40)) % vocab, 1).astype(np.uint32) for _ in range(1024)]
    idf, mean = (r.integers(1, 9, vocab) / 4).astype(np.float32), 20.0
    got = packing.Shard(docs, idf, mean, 5)
    held = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=vocab)
    assert np.array_equal(np.diff(got.post_at), held)
    posts = []
    for i, d in enumerate(docs):
        t, tf = np.unique(d, return_counts=True)
        w = (idf[t] * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(d) / mean))).astype(np.float32)
        posts += zip(t.tolist(), [i] * len(t), w.tolist())
        some = held[t] > 1
        best = t[some][np.lexsort((t[some], -w[some]))][:5]
        assert got.ask_term[got.ask_at[i] : got.ask_at[i + 1]].tolist() == best.tolist()
    posts.sort()
    assert got.post_doc.tolist() == [i for _, i, _ in posts] and np.allclose(got.post_w, [w for *_, w in posts], rtol=1e-6)


@pytest.mark.parametrize("kind", ["word", "byte"])
def test_encoder_tells_like_words_apart(kind):
    """Thue-Morse words and their complements, which polynomial hashes modulo 2^64 confuse; and pieces whose hashes are made equal."""
    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(public_tokenizers.path(FILES[kind])), tokens.Encoder(public_tokenizers.path(FILES[kind]), kind)
    for n in (64, 1024, 2048, 8192):
        a = "".join("ab"[i.bit_count() & 1] for i in range(n))
        text = f"x {a} {a.translate(str.maketrans('ab', 'ba'))}"
        for _ in range(2):
            assert own.many([text]) == [np.array(lib.encode(text, add_special_tokens=False).ids, own.dtype).tobytes()]


@pytest.mark.parametrize("kind", ["word", "byte"])
def test_encoder_compares_bytes(kind, monkeypatch):
    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(public_tokenizers.path(FILES[kind])), tokens.Encoder(public_tokenizers.path(FILES[kind]), kind)
    real = tokens.span_hashes
    # pieces of more than eight bytes nearly all collide, with shorter ones too; some have the hash that marks a free slot
    monkeypatch.setattr(tokens, "span_hashes", lambda raw, a, z, words=None: np.where(z - a > 8, real(raw, np.zeros_like(a), np.full_like(a, 3)) * ((z - a) % 3 > 0).astype(np.uint64), real(raw, a, z, words)))
    texts = ["one two three four five six", "six seven eightandmore nine ten eightandmire", "eightandmore eightandless " + "z" * 300 + " " + "z" * 299 + "y", "two six one"]
    for _ in range(2):
        for t, got in zip(texts, own.many(texts)):
            assert got == np.array(lib.encode(t, add_special_tokens=False).ids, own.dtype).tobytes()


def test_word_hashes():
    from lumenframe.llm import common

    a = "".join("ab"[i.bit_count() & 1] for i in range(2048))
    b = a.translate(str.maketrans("ab", "ba"))
    for n in (8, 64, 256, 300, 1024, 2048):
        assert n > 8 or len({int(common.span_hashes(bytes([i, j]) + b"abc", np.array([0]), np.array([5]))[0]) for i in range(64) for j in range(64)}) == 4096
        x = common.hashed_words([f"{a[:n]} {b[:n]} {a[:n]}", "é x"], 64)
        assert x[0][0] != x[0][1] and x[0][0] == x[0][2] and len(x[1]) == 2
    odd = "... don't (Foo) 漢字 \x1c a, --- _b_ 3.5% é"
    got = common.hashed_words([odd], 64, spans=common.bare_spans)[0]
    want = [common.hashed_words([common.bare(w)], 64, spans=common.bare_spans)[0][0] for w in odd.split()]
    assert got.tolist() == [int(x) for x in want] and len(set(got.tolist())) == len(got)


def test_token_files(spark, tmp_path):
    rows = ODD + [(100 + i, t) for i, t in enumerate(prose(1, 40))]
    path = tokens.write_tokens(docs_of(spark, rows, True), f"file://{tmp_path}/t", public_tokenizers.path(FILES["word"]), "word", 2, n=5)
    got = sorted((tuple(r) for r in tokens.read_tokens(spark, path).select("start", "n_tokens", "doc_id", "ids").collect()), key=lambda r: r[0])
    assert [r[0] for r in got] == [sum(x[1] for x in got[:i]) for i in range(len(got))] and all(len(r[3]) == r[1] and r[3][-1] == 2 for r in got)
    assert [r[2] for r in got] == sorted([d for d, _ in rows], key=lambda d: (d is not None, d))
    some = tokens.read_tokens(spark, path, "doc_id = 110")
    assert [r.start for r in some.collect()] == [r[0] for r in got if r[2] == 110] and "PushedFilters" in some._jdf.queryExecution().toString()
    assert tokens.write_tokens(docs_of(spark, []), f"file://{tmp_path}/e", public_tokenizers.path(FILES["word"])) and tokens.read_tokens(spark, f"{tmp_path}/e").count() == 0


def test_packing(spark):
    rows = ODD + [(100 + i, t) for i, t in enumerate(prose(3, 120))] + [(400 + i, "the same copy again and again " * 9) for i in range(60)]
    path = public_tokenizers.path(FILES["byte"])
    out = packing.pack(docs_of(spark, rows, True), path, "byte", 1, window=256, shard_docs=50).collect()
    enc, seqs, by = tokens.Encoder(path, "byte"), {}, {}
    for r in out:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length and zlib.crc32(r.ids) == r.ids_crc32
        by.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, ids.tolist()))
    for pieces in seqs.values():
        at = 0
        for off, n in sorted(pieces):
            assert off == at
            at += n
        assert at == 256 or at & (at - 1) == 0
    want = {}
    for d, t in rows:
        ids = [*np.frombuffer(enc.ids(t), enc.dtype).tolist(), 1]
        want.setdefault((d, len(ids)), []).append(ids)
    for k, pieces in by.items():
        total = sorted(x for _, ids in pieces for x in ids)
        assert total == sorted(x for ids in want[k] for x in ids)
    assert by.keys() == want.keys()
    assert packing.pack(docs_of(spark, []), path).count() == 0
    bare = packing.pack(docs_of(spark, rows, True), path, "byte", 1, window=256, shard_docs=50, ids_column=False)
    assert sorted(map(repr, bare.collect())) == sorted(repr(r) for r in packing.pack(docs_of(spark, rows, True), path, "byte", 1, window=256, shard_docs=50).drop("ids").collect())


def test_bm25_ranks_by_definition():
    r = np.random.default_rng(0)
    docs = [r.integers(0, 60, r.integers(5, 40)) for _ in range(30)]
    idf = r.random(60).astype(np.float32)
    shard = packing.Shard(docs, idf, 20.0, query_terms=60)
    for q in range(30):
        want = np.zeros(30)
        for t in np.unique(docs[q]):
            if sum(t in d for d in docs) < 2:
                continue
            for j, d in enumerate(docs):
                tf = (d == t).sum()
                want[j] += idf[t] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / 20.0)) if tf else 0
        want[q] = 0
        got = shard.rank(q)
        assert np.allclose(want[got], np.sort(want[want > 0])[::-1], rtol=1e-5)


# --- language ---

LANGS = {"en": "the of and to in that it was for with thing ation ing", "de": "der die und das schön nicht ein für über keit ung schlich", "fr": "le la les des une être où ça qué eaux tion ment elle"}


def lang_docs(n, seed):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        lang = r.choice(sorted(LANGS))
        rows.append((i, " ".join(r.choice(LANGS[lang].split()) + r.choice(["", r.choice(LANGS[lang].split())]) for _ in range(r.randint(5, 80))), lang))
    return rows


def test_language(spark):
    rows = lang_docs(300, 1)
    df = spark.createDataFrame([(i, t, x, None, None) for i, t, x in rows], DOCS)
    langs, logp = langid.fit(langid.training_rows(df))
    assert langs == ["de", "en", "fr"]
    test = lang_docs(200, 2)
    got = {r.doc_id: r for r in langid.predict(spark.createDataFrame([(i, t, None, None, None) for i, t, x in test], DOCS), langs, logp, ("doc_id",)).collect()}
    assert sum(got[i].lang_pred == x for i, _, x in test) >= 198 and all(0 <= r.score <= 1 for r in got.values())
    mixed = LANGS["en"] * 10 + " " + LANGS["de"] * 10
    pi = dict(zip(langs, langid.mixtures([mixed], logp)[0]))
    assert pi["en"] > 0.25 and pi["de"] > 0.25 and pi["fr"] < 0.05  # the language set is the two that are there
    odd = langid.predict(docs_of(spark, ODD, True), langs, logp, ("doc_id",)).collect()
    assert len(odd) == len(ODD) and {(r.doc_id, r.lang_pred, r.score) for r in odd if r.doc_id in (1, 2, 3, 6)} == {(i, "und", 0.0) for i in (1, 2, 3, 6)}
    kept = langid.stage_language(spark, spark.createDataFrame([(i, t, x, None, None) for i, t, x in rows] + [(900, "123 ...", "en", None, None)], DOCS), "")
    assert kept.count() == 300 and kept.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert langid.fit(langid.training_rows(docs_of(spark, ODD)))[0] == []
    clash = spark.createDataFrame([(i, t, x, None, None) for i, t, x in rows], DOCS).withColumns({c: F.lit("x") for c in ("_text", "lang_pred_", "u", "share")})
    assert langid.stage_language(spark, clash, "").columns == clash.columns
    assert toxicity.score(clash, toxicity.Ordinal(np.zeros(8), [1.0]), ("doc_id", "_text")).count() == chunking.fingerprints(clash, ("doc_id", "_text")).count() == 300
    whole = langid.predict(docs_of(spark, [(1, LANGS["de"] * 3000)]), langs, logp, ("doc_id",)).first()  # a very long text
    assert whole.lang_pred == "de"


def test_stage_without_labels(spark):
    """Where no language can be learned, documents with a letter stay."""
    kept = langid.stage_language(spark, docs_of(spark, [(1, "some text"), (2, "漢字"), (3, "1 2 3 ..."), (4, ""), (5, None)]), "")
    assert {r.doc_id for r in kept.collect()} == {1, 2} and kept.columns == [c.split()[0] for c in DOCS.split(", ")]


# --- language-model scoring ---


def test_network_learns():
    """A word that its neighbours settle becomes likely; gradients agree with finite differences."""
    r = np.random.default_rng(0)
    seqs = [np.array([10 + k, 200 + k, 3000 + k, 500 + k, 900 + k] * 12, np.uint16) for k in r.integers(0, 5, 60)]
    net = scoring.Network.start(np.bincount(np.concatenate(seqs), minlength=scoring.VOCAB))
    before = net.log_probs(net.prepared(), scoring.padded(seqs[0])).mean()
    sums = {k: np.full_like(v, 1e-2) for k, v in net.w.items()}
    for _ in range(25):
        for i in range(0, 60, 10):
            c, t = zip(*[scoring.windows(s, 1, 0) for s in seqs[i : i + 10]])
            net.step(np.concatenate(c), np.concatenate(t), sums, 0.1)
    assert net.log_probs(net.prepared(), scoring.padded(seqs[0])).mean() > before + 2
    x = scoring.padded(seqs[0][:7])
    lp = net.log_probs(net.prepared(), x)
    assert len(lp) == 7 and (lp <= 1e-4).all()
    total = 0.0  # the two levels make one distribution
    for w in range(scoring.VOCAB):
        y = x.copy()
        y[scoring.SIDE + 3] = w
        total += np.exp(net.log_probs(net.prepared(), y[3 : 3 + 2 * scoring.SIDE + 1])[0])
    assert abs(total - 1) < 1e-3


def test_scores(spark):
    text = prose(7, 60, 60)
    rows = [(i, t) for i, t in enumerate(text)]
    df = docs_of(spark, ODD + [(100 + i, t) for i, t in rows], True)
    words = scoring.vocabulary(df)
    assert words == sorted(words, key=lambda w: (-w[1], w[0]))
    seen = {}
    for _, t in ODD + [(0, t) for _, t in rows]:
        for h in scoring.words_of([t])[0].view(np.int64).tolist():
            seen[h] = seen.get(h, 0) + 1
    assert words == sorted(seen.items(), key=lambda w: (-w[1], w[0]))[: scoring.VOCAB - scoring.UNKNOWN]
    assert scoring.vocabulary(df, 7, held=10) == words[:7]
    ids = scoring.encoded(df, [w for w, _ in words])
    counts = np.zeros(scoring.VOCAB)
    counts[: len(words)] = [n for _, n in words]
    net = scoring.train(ids, counts, rounds=2, stride=2)
    got = {r.doc_id: r for r in scoring.score(ids, net).collect()}
    assert (got[2].n_tokens, got[2].pll, got[2].mean_logprob) == (0, 0.0, None)
    v = np.frombuffer(ids.where("doc_id = 103").first().ids, np.uint16)
    assert got[103].n_tokens == len(v) and abs(got[103].pll - net.log_probs(net.prepared(), scoring.padded(v)).sum()) < 1e-2
    long = np.frombuffer(ids.where("doc_id = 7").first().ids, np.uint16)
    assert abs(got[7].pll - net.log_probs(net.prepared(), scoring.padded(long)).sum(dtype=np.float64)) < 0.5
    for none in (docs_of(spark, []), docs_of(spark, [(1, None), (2, None)])):  # no rows, no words
        ids = scoring.encoded(none, [w for w, _ in scoring.vocabulary(none)])
        out = scoring.score(ids, scoring.train(ids, scoring.id_counts(ids), rounds=1, stride=1)).collect()
        assert [(r.n_tokens, r.pll, r.mean_logprob) for r in out] == [(0, 0.0, None)] * none.count()


def test_large_logits():
    net = scoring.Network.start(np.ones(scoring.VOCAB))
    net.w["C"][scoring.HIDDEN] = np.linspace(-500, 500, scoring.CLASSES)
    assert np.isfinite(net.log_probs(net.prepared(), scoring.padded(np.arange(300)))).all()


def test_rounds_cover_every_word():
    """The rounds of the query's training take each word of each document once, in documents of one word too."""
    import inspect

    use = inspect.signature(scoring.train).parameters
    rounds, stride = use["rounds"].default, use["stride"].default
    docs = [np.arange(n) + 100 * n for n in range(1, 40)] + [np.zeros(0, int)]
    blobs = [d.astype(np.uint16).tobytes() for d in docs]
    got = [scoring.places(blobs, stride, (r * stride) // rounds) for r in range(rounds)]
    assert sorted(np.concatenate([t for _, t in got]).tolist()) == sorted(np.concatenate(docs).tolist())
    for k, (c, t) in enumerate(got):
        each = [scoring.windows(d, stride, ((k * stride) // rounds + len(d)) % stride) for d in docs]
        assert np.array_equal(c, np.concatenate([x for x, _ in each])) and np.array_equal(t, np.concatenate([x for _, x in each]))


def test_rare_words_have_their_own_probability(spark):
    """Words outside the vocabulary get p(bucket) p(word | bucket) from all documents' counts, in whichever task they are counted."""
    rows = [(i, f"aa bb common{i % 2} " * 3) for i in range(20)] + [(30, "seldom " * 8), (31, "gibberish"), (32, "Seldom, seldom"), (33, None), (33, "gibberish aa")]
    df = docs_of(spark, rows)
    hashes = lambda *words: scoring.words_of([" ".join(words)])[0]
    ids = scoring.encoded(df, hashes("aa", "bb").view(np.int64).tolist())
    counts = scoring.id_counts(ids)
    count, first = {"common0": 30, "common1": 30, "seldom": 10, "gibberish": 2}, scoring.VOCAB - scoring.UNKNOWN
    bucket = dict(zip(count, scoring.TokenIds(hashes("aa", "bb"))(hashes(*count))[0].tolist()))
    assert all(first <= b < scoring.VOCAB for b in bucket.values())
    for b in range(first, scoring.VOCAB):
        assert counts[b] == sum(n for w, n in count.items() if bucket[w] == b)
    assert (counts[0], counts[1]) == (61, 60) and counts.sum() == 61 + 60 + 72
    inside = {w: np.log(count[w] / (counts[bucket[w]] + 1)) for w in count}
    net = scoring.Network.start(counts)
    stored = {r.row: r for r in ids.collect()}
    for deal in (scoring.DEAL_WORDS, 5):  # one task or many
        sums = {}
        for r in scoring.within_buckets(ids, counts, deal).collect():
            sums[stored[r.row].doc_id] = sums.get(stored[r.row].doc_id, 0) + r.inside
        assert abs(sums[30] - 8 * inside["seldom"]) < 1e-6 and abs(sums[31] - inside["gibberish"]) < 1e-6 and abs(sums[32] - 2 * inside["seldom"]) < 1e-6 and abs(sums[0] - 3 * inside["common0"]) < 1e-6
    got = [(r.doc_id, r.n_tokens, r.pll) for r in scoring.score(ids, net).collect()]
    assert sorted((d, n) for d, n, _ in got) == sorted((d, len((t or "").split())) for d, t in rows)
    alone = {r.doc_id: net.log_probs(net.prepared(), scoring.padded(np.frombuffer(r.ids, np.uint16))).sum() for r in stored.values() if r.doc_id != 33}
    for d, _, p in got:
        if d in (30, 31, 32):
            assert abs(p - alone[d] - sums[d]) < 1e-3


# --- substring deduplication ---


def brute_removed(rows, window):
    split = {i: (t or "").encode().split() for i, t in rows}
    first = {}
    for i in sorted(split):
        for k in range(len(split[i]) - window + 1):
            first.setdefault(tuple(split[i][k : k + window]), i)
    out = {}
    for i, w in split.items():
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        out[i] = (len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest())
    return out


@pytest.mark.parametrize("hot,runs,batches", [(1000, 4, 2), (1, 4, 2), (1000, 1, 4)])
def test_substrings(spark, hot, runs, batches):
    r = random.Random(5)
    base = prose(11, 30, 200)
    rows = []
    for i in range(60):
        a, b = r.choice(base).split(), r.choice(base).split()
        rows.append((i, " ".join(a[r.randint(0, 20) :] + b[: r.randint(0, len(b))])))
    rows += [(70, "same " * 40), (71, "same " * 60), (72, None), (73, ""), (74, rows[3][1]), (75, " \x85 " + rows[4][1])]
    df = docs_of(spark, rows, True)
    shared = substrings.shared_rows(df, batches, window=12, gram=6, most_runs=runs, hot_docs=hot, buckets=3)
    got = {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in substrings.removed(df, substrings.repeated(df, shared, 12, 6), 12).collect()}
    assert got == brute_removed(rows, 12)


def test_index_outlives_its_session(spark, tmp_path):
    """Batches filed in three sessions, compaction among them, give what brute force gives; old runs' files go."""
    base = [" ".join(t.split()[:60]) for t in prose(13, 12, 150)]
    r = random.Random(6)
    rows = [(i, " ".join(r.choice(base).split()[r.randint(0, 9) :] + r.choice(base).split()[: r.randint(0, 50)])) for i in range(48)]
    path, out = f"file://{tmp_path}/index", None
    for k in range(4):
        index = substrings.FingerprintIndex(spark, 12, 6, most_runs=2, buckets=3, path=path) if k == 0 else substrings.FingerprintIndex.open(spark, path)
        assert len(index.runs) == [0, 1, 2, 1][k]
        shared = index.add(docs_of(spark, rows[12 * k : 12 * k + 12]))
        out = shared if out is None else out.unionByName(shared)
        out = substrings.saved(out, "test")
        for name in index.runs:  # the next session knows only the files
            spark.sql(f"DROP TABLE {name}")
    index.vacuum()
    assert sorted(p.name for p in (tmp_path / "index").iterdir() if p.name != "manifest") == sorted(index.runs)
    df = docs_of(spark, rows)
    got = {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in substrings.removed(df, substrings.repeated(df, out, 12, 6), 12).collect()}
    assert got == brute_removed(rows, 12) and sum(n for _, n, _ in got.values()) > 100
    with pytest.raises(Exception):
        substrings.FingerprintIndex.open(spark, f"file://{tmp_path}/none")


def test_substring_odd_rows(spark):
    df = docs_of(spark, ODD, True)
    spans = substrings.repeated(df, substrings.shared_rows(df))
    out = substrings.removed(df, spans).collect()
    assert len(out) == len(ODD) and sum(r.n_removed for r in out) == 0
    texts = substrings.removed(docs_of(spark, ODD), spans, texts=True)
    assert texts.columns == [*(c.split()[0] for c in DOCS.split(", ")), "n_removed"] and texts.count() == len(ODD)
    assert substrings.removed(docs_of(spark, []), substrings.repeated(docs_of(spark, []), substrings.shared_rows(docs_of(spark, [])))).count() == 0


# --- archives ---


def test_warc(spark, tmp_path):
    pages = [(1, "http://a/", "<p>x"), (2, "http://b/", "<p>x"), (3, None, "<p>x"), (4, "http://c\r\nX: y", None), (5, "http://d", ""), (6, "http://e", "ñandú 漢"), (6, "http://e", "ñandú 漢"), (None, "http://f", "<p>x")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("sha", F.lit("clash"))
    index = warc.write_warc(df, f"file://{tmp_path}/w", roll_mb=0)
    got = {(r.page_id, r.record_type, r.refers_to) for r in warc.read_warc(index).collect()}
    assert got == {(1, "revisit", 3), (2, "revisit", 3), (3, "response", None), (4, "revisit", 5), (5, "response", None), (6, "response", None), (None, "response", None)}
    back = warc.read_warc(index.where("page_id = 6"), payloads=True).collect()
    assert [bytes(r.payload).decode() for r in back] == ["ñandú 漢"] * 2 and back[0].payload_digest == warc.base32_sha1("ñandú 漢".encode()) and back[0].payload_bytes == len("ñandú 漢".encode())
    alone = warc.write_warc(df, f"file://{tmp_path}/v", least_bytes=5)
    assert {r.page_id for r in warc.read_warc(alone).where("record_type = 'revisit'").collect()} == set()
    assert warc.read_warc(warc.write_warc(df.limit(0), f"file://{tmp_path}/u")).count() == 0


def test_coalescing():
    rows = [("a", 0, 10), ("a", 12, 10), ("a", 100, 10), ("a", 110, 500), ("b", 0, 5)]
    assert [[r[1] for r in g] for g in warc.coalesced(rows, 5, 100)] == [[0, 12], [100], [110], [0]]


# --- decontamination ---


def test_decontamination(spark):
    corpus = prose(21, 150, 900)
    bench = [" ".join(t.split()[: 20 + i]) + ". " + " ".join(t.split()[-6:]) for i, t in enumerate(prose(22, 25, 900))]
    r = random.Random(3)
    planted = {}
    for i in range(0, 100, 4):
        item = (i // 4) % 25
        words = bench[item].split()
        if i % 8:  # a paraphrase: some words dropped, some put in
            words = [w for k, w in enumerate(words) if k % 9 != 4]
            words.insert(5, "zzz")
        at = r.randint(0, 60)
        w = corpus[i].split()
        corpus[i] = " ".join(w[:at] + words + w[at:])
        planted[i] = item
    df = docs_of(spark, [*enumerate(corpus), (1000, None), (1001, ""), (1002, "a b")], True)
    b = spark.createDataFrame([*enumerate(bench), (90, None), (91, " "), (92, "short one here")], "item_id int, text string")
    for block in (8192, 10):
        got = {(x.doc_id, x.item_id) for x in decontam.leaks(df, b, block).collect()}
        assert got == set(planted.items())
    assert decontam.leaks(df, b.limit(0)).count() == 0 and decontam.leaks(df.limit(0), b).count() == 0
    for kind in ("short", "decimal(5,0)", "date"):  # ids of any type; a repeated document
        cast = F.date_add(F.lit("2020-01-01"), F.col("item_id")) if kind == "date" else F.col("item_id").cast(kind)
        some = df.where("doc_id in (0, 8)")
        assert decontam.leaks(some.unionByName(some), b.withColumn("item_id", cast)).count() == 4


def test_decomposition(spark):
    """Distributed singular directions against those of the dense matrix, at a rank far below its own."""
    r = np.random.default_rng(1)
    idf = (r.random(decontam.BUCKETS) * 8 + 0.5).astype(np.float32)
    topics = r.integers(0, decontam.BUCKETS, (12, 40))
    rows = [r.choice(topics[i % 12], 24).tolist() + r.integers(0, decontam.BUCKETS, 3 + i % 5).tolist() for i in range(600)]
    dense = np.zeros((600, decontam.TERMS))
    for i, x in enumerate(rows):
        for w in x:
            dense[i, w >> (decontam.BITS - decontam.LATENT_BITS)] += idf[w]
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    want_s, want = np.linalg.svd(dense, full_matrices=False)[1:]
    v, s = decontam.decomposed(spark.createDataFrame([(x,) for x in [*rows, []]], "words array<int>"), idf, rank=12)
    assert v.shape == (decontam.TERMS, 12) and np.allclose(v.T @ v, np.eye(12), atol=1e-3)
    assert np.allclose(s, want_s[:12], rtol=0.02)
    assert np.linalg.svd(want[:12] @ v, compute_uv=False).min() > 0.98  # the same subspace
    none = decontam.decomposed(spark.createDataFrame([], "words array<int>"), idf)
    assert none[0].shape == (decontam.TERMS, 0)



def test_decomposition_reads_rows_once_an_iteration(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    rows = spark.createDataFrame([([i << 3, (i + 1) << 3, (i * i) << 3],) for i in range(50)], "words array<int>")
    v, s = decontam.decomposed(rows.mapInArrow(seen, "words array<int>"), np.ones(decontam.BUCKETS, np.float32), rank=5)
    assert v.shape == (decontam.TERMS, 5) and read.value == 2 * 50


def test_latent_space_is_of_all_passages(spark, monkeypatch):
    """The matrix holds every word of every document and item, however many there are (more than 16,384 passages, 4,096 items)."""
    docs = [(i, " ".join(f"w{(i * 37 + j) % 5003}" for j in range(1000 + i % 70))) for i in range(600)] + [(600, None), (601, ""), (602, "one two")]
    items = [(i, f"item{i} has words of its own") for i in range(4200)]
    held = []

    def spy(rows, idf):
        held.extend(r.text for r in rows.collect())
        return np.zeros((decontam.TERMS, 0), np.float32), np.zeros(0)

    monkeypatch.setattr(decontam, "decomposed", spy)
    decontam.leaks(docs_of(spark, docs), spark.createDataFrame(items, "item_id int, text string"))
    texts = [t for _, t in docs + items]
    assert sorted(t for t in held if t) == sorted(t for t in texts if t)
    rows, words = decontam.passages(held).to_pylist(), [w for w in decontam.words_of(held) if len(w)]
    assert len(rows) == sum(-(-len(w) // decontam.PASSAGE) for w in words) > 16_384 + 4_096
    rows = iter(rows)
    for w in words:
        seen = [next(rows) for _ in range(-(-len(w) // decontam.PASSAGE))]
        assert seen[0] == w[: decontam.PASSAGE].tolist() and seen[-1] == w[-decontam.PASSAGE :].tolist() and set(sum(seen, [])) == set(w.tolist())


def test_sums_by_place():
    r = np.random.default_rng(2)
    n, width = 700, 9
    has = np.where(r.random((n, 300)) < np.linspace(0, 0.2, 300), r.random((n, 300)), 0).astype(np.float32)
    y, z = r.random((n, width)).astype(np.float32), r.random((300, width)).astype(np.float32)
    row, at = np.nonzero(has)
    for often, rows, most in ((50, 128, 64), (1, 4096, 1024), (10_000, 100, 16)):
        got = z.copy()
        decontam.summed(at, has[row, at], row, y, got, often, rows, most)
        assert np.allclose(got, z + has.T @ y, rtol=1e-4)


def paraphrase(r, words, share):
    """Words with a ``share`` of them replaced or dropped, a few put in."""
    out = []
    for w in words:
        if r.random() >= share:
            out.append(w)
        elif r.random() < 0.5:
            out.append("instead%d" % r.randrange(50))
        if r.random() < share / 3:
            out.append("and")
    return out


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_retrieval_recall(spark):
    """All leaks that a search without retrieval finds (every item at every place), with paraphrases planted in real documents."""
    r = random.Random(9)
    docs = [(x.doc_id, x.text or "") for x in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    bench = [(x.item_id, x.text) for x in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for k in range(0, 160):
        i = r.randrange(len(docs))
        w = docs[i][1].split()
        at = r.randint(0, len(w))
        docs[i] = (docs[i][0], " ".join(w[:at] + paraphrase(r, r.choice(bench)[1].split(), r.choice([0, 0.05, 0.1, 0.15, 0.2])) + w[at:]))
    df = docs_of(spark, docs)
    got = {(x.doc_id, x.item_id) for x in decontam.leaks(df, spark.createDataFrame(bench, "item_id long, text string")).collect()}
    idf, _ = decontam.word_idf(df)
    find, want = decontam.Retriever([p for i, t in bench for p in decontam.parts(i, t, None)], np.zeros((decontam.TERMS, 1), np.float32), idf), set()
    for d, t in docs:
        words = decontam.words_of([t])[0]
        for a in range(0, len(words), decontam.STRIDE):
            near = words[max(0, a - 64) : a + 96]
            for i, it in enumerate(find.its):
                if find.can_be(i, set(near.tolist())):
                    n = len(it.words)
                    cover, answer = find.coverage(it, words[max(0, a - n) : a + decontam.PASSAGE + n])
                    if cover >= decontam.FULL or (cover >= decontam.PART and answer >= decontam.ANSWER):
                        want.add((d, it.item_id))
    assert len(want) > 120 and len(got & want) >= 0.98 * len(want)


def test_places_are_screened_in_arrays():
    """Only places that can_be() holds for, and all of them, are looked at one by one, whatever the documents' ends."""
    r = np.random.default_rng(4)
    idf = (r.random(decontam.BUCKETS) * 8 + 0.5).astype(np.float32)
    some = r.integers(0, decontam.BUCKETS, 60)
    its = [decontam.Item(i, "w") for i in range(30)]
    for i, it in enumerate(its):
        it.words = r.choice(some[: 20 + i], 3 + 2 * i)
        it.word_list = it.words.tolist()
    docs = [r.choice(some, n) if n % 2 else r.choice([*some[:30], *range(500)], n) for n in (1, 2, 16, 17, 40, 160, 161, 700, 1501)]
    find = decontam.Retriever(its, r.standard_normal((decontam.TERMS, 6)).astype(np.float32), idf)
    every = [(d, i, a) for d, w in enumerate(docs) for a in range(0, len(w), decontam.STRIDE) for i in range(len(its))]
    want = [find.can_be(i, set(docs[d][max(0, a - 64) : a + 96].tolist())) for d, i, a in every]
    assert 50 < sum(want) < len(want) - 50
    for most in (1 << 22, 200):
        assert find.likely(docs, *np.array(every).T, most).tolist() == want
    can = {x for x, yes in zip(every, want) if yes}
    near = {(d, i, a): c for d, i, a, c in zip(*(x.tolist() for x in find.candidates(docs)))}
    got = [(d, i, a) for d, i, a, c in find.places(docs) if c is not None]
    assert len(near) > len(got) > 50 and sorted(got) == sorted(near.keys() & can)
    for (d, i, a), c in near.items():
        assert abs(find.cosine(i, docs[d][a : a + decontam.PASSAGE]) - c) < 1e-4
    short = {(d, i, a) for d, i, a, c in find.places(docs) if c is None}
    assert short == {(d, i, max(0, p - 16)) for d, w in enumerate(docs) for p, x in enumerate(w.tolist()) for i in find.anchors.get(x, []) if find.can_be(i, set(w[max(0, max(0, p - 16) - 64) : max(0, p - 16) + 96].tolist()))}


def test_short_items_are_found(spark):
    """Copies of items of 3 to 15 words among rare words, and copies without a word, against brute force."""
    r = random.Random(5)
    bench = [" ".join(f"item{i % 9}w{k}" if k % 3 else f"q{r.randrange(40)}" for k in range(3 + i % 13)) for i in range(39)]
    rows = []
    for d in range(156):
        w, rare = bench[d % 39].split(), [f"rare{d}x{k}" for k in range(120)]
        if d % 2 and len(w) >= 8:
            del w[r.randrange(len(w))]
        at = r.randint(0, 120)
        rows.append((d, " ".join(rare[:at] + (w if d % 4 < 3 else w[: len(w) // 3]) + rare[at:])))
    df = docs_of(spark, rows)
    idf, _ = decontam.word_idf(df)
    its = [decontam.Item(i, t) for i, t in enumerate(bench)]
    find, want = decontam.Retriever(its, np.zeros((decontam.TERMS, 1), np.float32), idf), set()
    for d, t in rows:
        words = decontam.words_of([t])[0]
        for it in its:
            cover, answer = find.coverage(it, words)
            if cover >= decontam.FULL or (cover >= decontam.PART and answer >= decontam.ANSWER):
                want.add((d, it.item_id))
    got = {(x.doc_id, x.item_id) for x in decontam.leaks(df, spark.createDataFrame(list(enumerate(bench)), "item_id int, text string")).collect()}
    assert got == want and len(want) > 90


# --- fingerprints ---


def test_gear_by_definition():
    data = bytes(random.Random(1).randrange(256) for _ in range(300))
    h = chunking.gear(np.frombuffer(data, np.uint8))
    for i in range(300):
        assert int(h[i]) == sum(int(chunking.GEAR[data[i - j]]) << j for j in range(min(32, i + 1))) & 0xFFFFFFFF


def test_chunks_resist_shifts():
    text = " ".join(prose(31, 20))
    a, b = chunking.chunks(text), chunking.chunks("some words put in front " + text)
    assert chunking.containment(a, b) > 0.97 and chunking.containment(a, chunking.chunks(" ".join(prose(32, 20, 300)))) < 0.2
    for n in (0, 1, 5, 40, 513):
        x = chunking.chunks(text[:n])
        assert chunking.containment(x, x) == 1.0
        assert sum(z - y for y, z in zip([0, *chunking.cuts(text[:n].encode())], chunking.cuts(text[:n].encode()))) == n
    assert chunking.containment(chunking.chunks(""), a) == 0.0 and chunking.text_of(chunking.chunks("")) == "|"


def test_next_documents(spark, monkeypatch, tmp_path):
    rows = [(i, t) for i, t in ODD if i not in (4, 9, None)] + [(100 + i, t) for i, t in enumerate(prose(33, 30))]
    docs_of(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in chunking.op7_chunk_fingerprints(spark, str(tmp_path)).collect()}
    down = sorted(rows, reverse=True)
    for k, (i, t) in enumerate(down):
        t, nxt = t or "", down[(k + 1) % len(down)][1] or ""
        edited = t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == chunking.text_of(chunking.chunks(t)) and r.near_next == chunking.containment(chunking.chunks(t), chunking.chunks(nxt))
    every = chunking.with_next(docs_of(spark, ODD), lambda p: __import__("pyarrow").RecordBatch.from_pydict({"d": [str(x[0]) for x in p]}), "d string")
    assert every.count() == len(ODD)
    assert chunking.fingerprints(docs_of(spark, ODD, True)).count() == len(ODD)


# --- toxicity ---


def test_ordinal_model():
    """Severity grades 0..3 that follow the number of bad words, on rows it hasn't seen."""
    r = np.random.default_rng(0)

    def make(n):
        rows, grades = [], []
        for _ in range(n):
            g = int(r.integers(0, 4))
            rows.append(np.unique(np.concatenate([r.integers(50, 2000, 40), r.choice(10, 2 * g, replace=False)])))
            grades.append(g)
        return rows, np.array(grades)

    x, y = make(1500)
    m = toxicity.fit(x, y, np.ones(1500), 2000, 4, least_z=3.0)
    assert (np.diff(m.thresholds) > 0).all()
    tx, ty = make(400)
    p = m.at_least([m.w[a].sum() for a in tx])
    assert (np.diff(p, axis=1) <= 1e-12).all() and np.abs(p.sum(1) - ty).mean() < 0.35 and ((p >= 0.5).sum(1) == ty).mean() > 0.8


def test_toxicity(spark):
    r = random.Random(4)
    clean, rows, labels = prose(41, 400), [], []
    for i, t in enumerate(clean):
        bad = i % 5 == 0
        w = t.split()
        if bad:
            for _ in range(4):
                w.insert(r.randint(0, len(w)), r.choice(["moroner", "scumbag,", "Idiotic", "trashy"]))
        rows.append((i, " ".join(w)))
        if i < 250:
            labels.append((i, int(bad)))
    lab = spark.createDataFrame([*labels, (0, 0), (None, 1), (5000, 1), (3, None)], "doc_id long, grade int")
    model, n = toxicity.learn(docs_of(spark, rows), lab)
    out = {x.doc_id: x for x in toxicity.score(docs_of(spark, [*rows, (900, None), (901, "")], True), model).collect()}
    assert n == 2 and all(out[i].toxic == (i % 5 == 0) for i in range(250, 400)) and not out[900].toxic and not out[901].toxic
    none, _ = toxicity.learn(docs_of(spark, rows), lab.limit(0))
    assert toxicity.score(docs_of(spark, rows), none).where("toxic").count() == 0


# --- near duplicates ---


def near_rows():
    r = random.Random(8)
    rows, n = [], 0
    for t in prose(51, 25, 3000):
        for _ in range(r.randint(1, 6)):
            w = t.split()
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = "edit" + str(r.randrange(99))
            rows.append((n, " ".join(w)))
            n += 1
    return rows + [(n, rows[0][1]), (n + 1, None), (n + 2, ""), (n + 3, ""), (n + 4, "two words"), (n + 5, "two words"), (n + 6, None)]


def brute_classes(rows, idf, least=0.8):
    """Classes by the weighted similarity of every two texts; and those pairs."""
    shingles = neardup.Shingles(idf)
    sets = {i: dict(zip(*(x.tolist() for x in shingles(t)))) for i, t in rows}
    text, where = dict(rows), {}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, w in sets.items():
        for h in w:
            where.setdefault(h, []).append(i)
    total = {i: sum(w.values()) for i, w in sets.items()}
    near, pairs = {}, []
    for i, w in sets.items():
        low = {}
        for h, x in w.items():
            for j in where[h]:
                if j < i:
                    low[j] = low.get(j, 0) + min(x, sets[j][h])
        near.update({(j, i): s for j, x in low.items() if (s := x / (total[i] + total[j] - x)) >= least})
    same = {}
    for i, t in text.items():
        if t is not None:
            same.setdefault(t, []).append(i)
    for (a, b), s in [*near.items(), *(((x[0], y), 1) for x in same.values() for y in x[1:])]:
        lo, hi = sorted((find(a), find(b)))
        root[hi] = lo
        pairs.append((a, b))
    return {i: find(i) for i in sets}, pairs


@pytest.mark.parametrize("task_pairs,group_docs,deals", [(4_000_000, 1024, 3), (0, 4, 1), (0, 4, 0)])
def test_near_duplicates(spark, task_pairs, group_docs, deals, monkeypatch):
    """Small buckets in a task; all dealt into groups, then by rounds of hubs; by rounds of hubs alone."""
    rows = near_rows()
    monkeypatch.setattr(neardup.links, "__defaults__", (neardup.LEAST_SIMILARITY, task_pairs, 16 << 20, group_docs, deals, 2))
    df = docs_of(spark, rows, True)
    got = {r.doc_id: r.class_id for r in neardup.classes(df).collect()}
    assert got == brute_classes(rows, neardup.word_idf(df))[0]
    kept = neardup.stage_near(spark, docs_of(spark, rows), "")
    assert {r.doc_id for r in kept.collect()} == set(got.values())


def test_group_similarities():
    """Blocks and pairs give what comparing two sets gives, with shingles that repeat within a text."""
    r, idf = random.Random(3), np.random.default_rng(0).random(neardup.BUCKETS) * 5 + 0.1
    shingles = neardup.Shingles(idf)
    base = prose(55, 1, 300)[0].split()
    texts = [" ".join(w if r.random() > 0.03 else f"x{r.randrange(9)}" for w in base[r.randrange(9) :]) for _ in range(50)] + ["same " * 40, "same " * 60, "a b", "a b", "b a", " ".join(base) * 2]
    sets = [shingles.counted(h) for h in neardup.hashed_words(texts, 64)]
    few = np.array([0, 3, 7, 50, 51, 52, 55])
    for often, block in ((32, 2048), (2, 7), (1, 5), (100, 8)):
        got = neardup.similarities(sets, few, often, block)
        for k, i in enumerate(few):
            want = np.array([neardup.similarity(shingles(texts[i]), shingles(x)) for x in texts])
            others = np.arange(len(texts)) != i
            assert np.allclose(got[k][others], want[others], atol=1e-5)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_near_recall(spark):
    """Every pair of the table at 0.8 and more, found by comparing all that share a shingle, is in one class, and classes hold nothing else."""
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = {r.doc_id: r.class_id for r in neardup.classes(df).collect()}
    want, pairs = brute_classes(rows, neardup.word_idf(df))
    assert len(pairs) > 20 and sum(got[a] == got[b] for a, b in pairs) >= 0.99 * len(pairs)
    assert all(want[i] == want[c] for i, c in got.items())


def test_near_several_texts_of_one_id(spark):
    a, b, c = (" ".join(t.split()[:80]) for t in prose(52, 3, 3000))
    rows = [(5, a), (5, b), (2, a), (7, b), (9, c), (3, c)]
    got = {r.doc_id: (r.class_id, r.n_links) for r in neardup.classes(docs_of(spark, rows)).collect()}
    assert got == {5: (2, 0), 2: (2, 0), 7: (2, 0), 9: (3, 0), 3: (3, 0)}


@pytest.mark.parametrize("n", [600, 60_000])
def test_samples_estimate_weighted_jaccard(n):
    r = np.random.default_rng(3)
    h = np.unique(r.integers(1, 1 << 63, n).astype(np.uint64))
    w = r.random(len(h)) * 5 + 0.5
    a, b = np.arange(len(h)) < n * 5 // 6, np.arange(len(h)) >= n // 10
    true = neardup.similarity((h[a], w[a]), (h[b], w[b]))
    times = 20 if n < 1000 else 4
    got = np.mean([(neardup.samples(neardup.mixed(h[a] + np.uint64(k)), w[a]) == neardup.samples(neardup.mixed(h[b] + np.uint64(k)), w[b])).mean() for k in range(times)])
    assert abs(got - true) < 0.06


def test_near_odd_rows(spark):
    out = {r.doc_id: r.class_id for r in neardup.classes(docs_of(spark, ODD, True)).collect()}
    assert out == {i: i for i in {i for i, _ in ODD} - {None}}
    assert neardup.classes(docs_of(spark, [])).count() == 0
    assert neardup.stage_near(spark, docs_of(spark, ODD), "").count() == len(ODD)


# --- the pipeline ---


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    leak = " ".join(prose(61, 1)[0].split()[:30])
    base = prose(62, 40, 3000)
    shared = " ".join(prose(63, 1, 500)[0].split()[:55])
    rows = [(i, t, "en") for i, t in enumerate(base)] + [(100, base[0], "en"), (101, "1 2 3", "en"), (102, " ".join(prose(66, 1)) + " " + leak, "en"), (103, shared + " " + " ".join(prose(64, 1)), "en"), (104, " ".join(prose(65, 1)) + " " + shared, "en"), (105, None, None)]
    spark.createDataFrame([(i, t, x, "s", len(t or "")) for i, t, x in rows], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == list(corpus_pipeline.COLUMNS)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name == "repeated_passages":
            assert shared in docs.where("doc_id = 103").first().text and shared not in docs.where("doc_id = 104").first().text
    every = set(range(40)) | {103, 104}
    assert seen["language"] == every | {100, 102} and seen["near_duplicates"] == every | {102} and seen["benchmark_leaks"] == every and seen["packing"] == every


def test_samples_are_those_of_the_formula():
    g = np.random.default_rng(3)
    h, w = np.unique(g.integers(0, 1 << 63, 300).astype(np.uint64)), g.random(300) * 5 + 0.1
    w = w[: len(h)]
    r, inv, lnc, beta = neardup._random()
    row = (h >> np.uint64(20)).astype(np.int64) & (neardup.TABLE - 1)
    t = np.floor(np.log(w).astype(np.float32)[:, None] * inv[row] + beta[row])
    j = (lnc[row] - r[row] * (t - beta[row] + 1)).argmin(0)
    want = neardup.mixed(h[j] + t[j, np.arange(neardup.SAMPLES)].astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for block in (1024, 300, 64, 7):
        assert np.array_equal(neardup.samples(h, w, block), want)
