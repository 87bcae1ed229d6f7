"""Versions, grouping, mutations, sources and header readers."""

import struct

import pytest
from pyspark.sql import functions as F

from lumenframe import schema
from lumenframe.operators import grouping, match, mutate, versions
from lumenframe.sources import feeds, headers, listing

# --- grouping ---


def grouped(files, root=False, folder="../cine/Film"):
    return grouping.build_dir(folder, [(f"{folder}/{n}", s, k) for n, s, k in files], root)


def test_parts_and_bonus():
    got = grouped([("Film CD1.avi", 700, "video"), ("Film CD2.avi", 690, "video"), ("Bonus stuff.avi", 300, "video")])
    assert len(got) == 1 and (got[0]["parts"], got[0]["size"]) == (2, 1390)
    assert [m["role"] for m in got[0]["members"]] == ["main", "main", "extra"]


def test_releases_stay_apart():
    got = grouped([("Alpha 1999.mkv", 700, "video"), ("Beta 2001.mkv", 800, "video")])
    assert [(v["title"], v["year"]) for v in got] == [("Alpha", 1999), ("Beta", 2001)]


def test_subtitles():
    got = grouped([("A.avi", 700, "video"), ("B.avi", 700, "video"), ("A.srt", 1, "subtitle"), ("B.en.srt", 1, "subtitle")])
    assert [v["sub_langs"] for v in got] == ["?", "en"]


def test_extra_goes_to_the_larger():
    got = grouped([("F.avi", 700, "video"), ("F.mkv", 900, "video"), ("F trailer.avi", 300, "video")])
    assert [len(v["members"]) for v in got] == [1, 2]


def test_part_sets():
    four = grouped([(f"Shoah - Part {i} - {n}.mkv", s, "video") for i, n, s in ((1, "One", 900), (2, "Two", 900), (3, "Three", 900), (4, "Four", 90))])
    assert len(four) == 1 and four[0]["parts"] == 4
    rips = grouped([(f"F CD{i} {r}.avi", 700, "video") for i in (1, 2) for r in ("720p", "1080p")])
    assert sorted(v["parts"] for v in rips) == [2, 2]
    sequels = grouped([("F Part 1 (2014).mkv", 700, "video"), ("F Part 2 (2015).mkv", 700, "video")])
    assert len(sequels) == 2
    making = grouped([("F Part 1.mkv", 900, "video"), ("F Part 2 Making of.mkv", 700, "video")])
    assert len(making) == 1 and making[0]["parts"] == 1


def test_dvd_and_roots():
    dvd = grouped([("VTS_01_0.IFO", 1, "dvd"), ("VTS_01_1.VOB", 900, "dvd"), ("x.srt", 1, "subtitle")])
    assert len(dvd) == 1 and dvd[0]["parts"] == 1 and dvd[0]["title"] == "Film"
    loose = grouped([("Attenberg.avi", 9, "video")], root=True)
    assert loose[0]["title"] == "Attenberg"
    assert grouped([("a.srt", 1, "subtitle")]) == []


def test_build(spark):
    rows = [("../cine/F (1999)/F.mkv", 900), ("../cine/F (1999)/Extras/x.mkv", 900), ("../cine/F (1999)/Subs/F.en.srt", 1), ("../cine/G.avi", 5)]
    df = spark.createDataFrame([(p, s, "subtitle" if p.endswith("srt") else "video") for p, s in rows], "path string, size long, kind string")
    got = {r.dir: r for r in grouping.numbered(grouping.build(df, ["../cine"])).collect()}
    assert {d: (r.title, r.year, r.sub_langs, len(r.members)) for d, r in got.items()} == {"../cine": ("G", 0, "", 1), "../cine/F (1999)": ("F", 1999, "en", 3)}
    assert [got[d].id for d in sorted(got)] == [1, 2]


# --- versions ---


def files_of(spark, rows):
    cols = "path string, size long, mtime long, fingerprint string, kind string, version_id long, part int"
    df = spark.createDataFrame(rows, cols)
    return schema.complete(df.withColumn("role", F.lit("main")).withColumn("missing", F.lit(False)).withColumn("first_seen", F.lit(1)), "files")


def media_of(spark, rows):
    track = lambda c, l, n=0: {"codec": c, "lang": l, "channels": n}
    out = [(p, s, m, e, d, w, h, v, [track(*x) for x in a], [track(*x) for x in b]) for p, s, m, e, d, w, h, v, a, b in rows]
    df = spark.createDataFrame(out, f"path string, size long, mtime long, error string, duration_ms long, width int, height int, video_codec string, audio array<{schema.TRACK}>, subs array<{schema.TRACK}>")
    return schema.complete(df.withColumn("probe_version", F.lit(1)), "media")


def test_media_merge(spark):
    f = files_of(spark, [("e/p1.mkv", 10, 1, "f1", "video", 1, 1), ("e/p2.mkv", 9, 1, "f2", "video", 1, 2), ("c/VTS_01_0.IFO", 1, 1, "d1", "dvd", 2, 0), ("c/VTS_02_0.IFO", 1, 1, "d2", "dvd", 2, 0), ("b/S.avi", 5, 1, "s", "video", 3, 0)])
    m = media_of(spark, [("e/p1.mkv", 10, 1, "", 3_600_000, 1920, 800, "h264", [("ac3", "es", 6)], []), ("e/p2.mkv", 9, 1, "", 3_000_000, 1920, 800, "h264", [("ac3", "es", 6), ("aac", "en", 2)], [("srt", "it")]),
                         ("c/VTS_01_0.IFO", 1, 1, "", 600_000, 720, 576, "mpeg2", [], []), ("c/VTS_02_0.IFO", 1, 1, "", 6_000_000, 720, 480, "mpeg2", [("ac3", "fr", 2)], []), ("b/S.avi", 5, 1, "bad", 0, 0, 0, "", [], [])])
    got = {r.version_id: r for r in versions.merged_media(f, m).collect()}
    assert (got[1].duration_ms, got[1].width, [a.lang for a in got[1].audio], [s.lang for s in got[1].subs]) == (6_600_000, 1920, ["es", "en"], ["it"])
    assert (got[2].duration_ms, got[2].height, len(got[2].audio)) == (6_000_000, 480, 1) and 3 not in got
    strict = {r.version_id: r.duration_ms for r in versions.strict_durations(f, m).collect()}
    assert strict == {1: 6_600_000, 2: 6_000_000, 3: 0}
    v = schema.complete(spark.createDataFrame([(1, "e", "E", "720p"), (2, "c", "C", ""), (3, "b", "S", "576p")], "id long, dir string, title string, resolution string"), "versions")
    view = {r.id: r for r in versions.version_view(f, v, m, schema.empty(spark, "identifications"), schema.empty(spark, "movies"), schema.empty(spark, "part_links")).collect()}
    assert (view[1].resolution, view[2].resolution, view[3].resolution, view[3].duration_ms, view[1].fingerprint, view[1].present, view[1].status) == ("1080p", "480p", "576p", 0, "f1", True, "none")
    stale = m.withColumn("mtime", F.when(F.col("path") == "e/p1.mkv", 0).otherwise(F.col("mtime")))
    assert {r.version_id: r.duration_ms for r in versions.merged_media(f, stale).collect()}[1] == 3_000_000
    assert [r.path for r in versions.pending_probes(f, stale, has_tool=True).orderBy("path").collect()] == ["b/S.avi", "e/p1.mkv"]


def test_best(spark):
    rows = [(1, "Amarcord", "720p", "h264", 4, True), (2, "Amarcord", "1080p", "mpeg4", 9, True), (3, "Amarcord", "1080p", "hevc", 3, True), (4, "amarcord", "2160p", "hevc", 50, False), (5, "Stalker", "1080p", "h264", 5, True)]
    df = spark.createDataFrame(rows, "id long, title string, resolution string, codec_name string, size long, present boolean").withColumn("year", F.lit(1973)).withColumn("movie_id", F.lit(0))
    assert [r.id for r in versions.with_best(df).where("best").collect()] == [3]


def test_targets(spark):
    f = files_of(spark, [("a/2.avi", 710, 1, "a2", "video", 1, 2), ("a/1.avi", 700, 1, "a1", "video", 1, 1), ("copy/1.avi", 700, 1, "a1", "video", 2, 0), ("d/VTS_01_0.IFO", 10, 1, "i", "dvd", 3, 0), ("d/v1.VOB", 900, 1, "vob1", "dvd", 3, 0), ("d/v2.VOB", 950, 1, "vob2", "dvd", 3, 0)])
    v = schema.complete(spark.createDataFrame([(1, "a", "Amarcord"), (2, "copy", "Amarcord"), (3, "d", "Stalker")], "id long, dir string, title string"), "versions")
    infos = spark.createDataFrame([("d/movie.nfo",), ("d/b.nfo",)], "path string")
    got = {r.fingerprint: r for r in versions.identify_targets(f, v, schema.empty(spark, "media"), schema.empty(spark, "identifications"), infos).collect()}
    assert set(got) == {"a1", "vob2"} and got["a1"].id == 1 and got["vob2"].nfos == ["d/b.nfo", "d/movie.nfo"]


# --- mutations ---


def test_sync_and_corrections(spark):
    known = schema.complete(spark.createDataFrame([("r/a", "f1", 5, False), ("r/b", "f2", 6, False), ("q/c", "f3", 7, False), ("r/old", "f4", 2, True)], "path string, fingerprint string, first_seen long, missing boolean"), "files")
    seen = spark.createDataFrame([("r/a", 1, 1, "f1", "video"), ("r/moved", 1, 1, "f4", "video"), ("r/new", 1, 1, "f9", "video")], "path string, size long, mtime long, fingerprint string, kind string")
    got = {r.path: (r.missing, r.first_seen) for r in mutate.sync_files(known, seen, ["r"], 100).collect()}
    assert got == {"r/a": (False, 5), "r/b": (True, 6), "q/c": (False, 7), "r/old": (True, 2), "r/moved": (False, 2), "r/new": (False, 100)}
    ids = schema.complete(spark.createDataFrame([("x", "manual", 1), ("y", "auto", 2)], "fingerprint string, status string, tmdb_id int"), "identifications")
    new = schema.complete(spark.createDataFrame([("x", "auto", 9), ("y", "unmatched", 0), ("z", "auto", 3)], "fingerprint string, status string, tmdb_id int"), "identifications")
    assert {r.fingerprint: (r.status, r.tmdb_id) for r in mutate.save_identifications(ids, new).collect()} == {"x": ("manual", 1), "y": ("unmatched", 0), "z": ("auto", 3)}
    assert mutate.invalidate_movie(schema.empty(spark, "movies"), ids, 2)[1].count() == 1
    assert {r.path: r.missing for r in mutate.mark_outside(known, ["r"]).collect()}["q/c"] is True


def test_part_links(spark):
    f = files_of(spark, [("S/p1.mkv", 100, 1, "s1", "video", 1, 0), ("S/p2.mkv", 90, 1, "s2", "video", 2, 0), ("S/p3.mkv", 80, 1, "s3", "video", 3, 0)])
    v = schema.complete(spark.createDataFrame([(1, 100, 1), (2, 90, 1), (3, 80, 1)], "id long, size long, parts int"), "versions")
    links = spark.createDataFrame([("s2", "s1", 1), ("s3", "s2", 1), ("x", "y", 1), ("y", "x", 1)], schema.struct("part_links"))
    assert {r.follower: r.leader for r in mutate.final_leaders(links).collect()} == {"s2": "s1", "s3": "s1"}
    nf, nv = mutate.apply_part_links(f, v, links)
    assert [(r.id, r.size, r.parts) for r in nv.collect()] == [(1, 270, 3)]
    assert [(r.path, r.version_id, r.part) for r in nf.orderBy("path").collect()] == [("S/p1.mkv", 1, 1), ("S/p2.mkv", 1, 2), ("S/p3.mkv", 1, 3)]
    again = mutate.apply_part_links(nf, nv, links)
    assert sorted(map(tuple, again[0].collect())) == sorted(map(tuple, nf.collect())) and again[1].collect() == nv.collect()
    assert {r.fingerprint for r in mutate.unlink(links, "s1").collect()} == {"x", "y"}
    with pytest.raises(ValueError):
        mutate.set_part_link(links, f, "s1", "s3", 2)
    with pytest.raises(ValueError):
        mutate.set_part_link(links, f, "s1", "s1", 2)


def test_lists_and_catalog(spark, tmp_path):
    cat = mutate.Catalog(spark, f"file://{tmp_path}/cat")
    assert cat.generation() == 0 and cat.read("lists").count() == 0
    lists = mutate.create_list(cat.read("lists"), " Ver ", 5)
    cat.commit(lists=lists)
    with pytest.raises(ValueError):
        mutate.create_list(cat.read("lists"), "VER", 6)
    refs = spark.createDataFrame([("fp:a",), ("fp:b",)], "ref string")
    l, e = mutate.add_entries(cat.read("lists"), cat.read("list_entries"), 1, refs, 7)
    cat.commit(lists=l, list_entries=e)
    l, e = mutate.add_entries(cat.read("lists"), cat.read("list_entries"), 1, refs, 9)
    assert l.first().updated_at == 7 and {r.added_at for r in e.collect()} == {7}
    l, e = mutate.remove_entries(cat.read("lists"), cat.read("list_entries"), 1, refs.limit(1), 11)
    assert l.first().updated_at == 11 and e.count() == 1
    t = cat.snapshot()
    fps = spark.createDataFrame([("k1",)], "fingerprint string")
    done = mutate.import_collection(t, "c/K", "K", 0, fps, 12)
    assert done["lists"].count() == 2 and done["collection_folders"].first().status == "imported" and done["collection_seen"].count() == 1
    assert mutate.dismiss_collection(t | done, "c/K", fps, 13)["collection_folders"].first().status == "imported"
    assert mutate.dismiss_collection(t, "c/L", fps, 13)["collection_folders"].first().status == "dismissed"
    assert mutate.import_choice("ver", cat.read("lists"), "").first().kind == "existing" and mutate.import_choice("zz", cat.read("lists"), "").first().kind == "new"
    assert mutate.delete_list(cat.read("lists"), cat.read("list_entries"), done["collection_folders"], 2)[2].first().list_id is None
    assert cat.generation() == 2 and schema.violations(cat.read("list_entries"), "list_entries").isEmpty()


def test_replace_versions(spark):
    f = files_of(spark, [("r/a", 1, 1, "a", "video", 1, 0), ("q/b", 1, 1, "b", "video", 2, 0)])
    v = schema.complete(spark.createDataFrame([(1, "r"), (2, "q")], "id long, dir string"), "versions")
    new = spark.createDataFrame([(1, "r", [("r/a", "main", 0, "")])], f"id long, dir string, members array<{grouping.MEMBER}>")
    nv, nf = mutate.replace_versions(v, f, new, ["r"], ["r", "q"])
    assert sorted((r.id, r.dir) for r in nv.collect()) == [(2, "q"), (3, "r")] and {r.path: r.version_id for r in nf.collect()} == {"r/a": 3, "q/b": 2}
    with pytest.raises(Exception, match="unknown file"):
        mutate.replace_versions(v, f, spark.createDataFrame([(1, "r", [("r/zz", "main", 0, "")])], new.schema), ["r"], ["r", "q"])[1].collect()


# --- matching ---


def test_identify(spark):
    q = spark.createDataFrame([("1", "Amarcord", 1973, "", 0, ""), ("2", "Loulou Pialat", 1980, "", 0, ""), ("3", "Nada", 1990, "", 0, ""), ("4", "x", 0, "", 0, "tt0000001")], "qid string, title string, year int, director string, minutes int, imdb_id string")
    c = spark.createDataFrame([("amarcord", 1973, "es", 0, 7857, "Amarcord", "Amarcord", "1973-12-13", ""), ("loulou", 1980, "es", 0, 50, "Loulou", "Loulou", "1980-01-01", "")], "query_title string, year int, lang string, ord int, id int, title string, original_title string, release_date string, poster_path string")
    d = spark.createDataFrame([(7857, "tt1", "Amarcord", "Amarcord", 1973, 123, [(1, "Federico Fellini")]), (50, "", "Loulou", "Loulou", 1980, 105, [(2, "Maurice Pialat")]), (9, "tt0000001", "X", "X", 2000, 90, [(3, "Z")])], "id int, imdb_id string, title string, original_title string, year int, runtime int, directors array<struct<id:int,name:string>>")
    r = spark.createDataFrame([("2", "Loulou", "Pialat")], "qid string, title string, director string")
    got = {x.qid: (x.status, x.tmdb_id) for x in match.identify(q, c, d, "es", r).collect()}
    assert got == {"1": ("auto", 7857), "2": ("auto", 50), "3": ("unmatched", None), "4": ("auto", 9)}


# --- sources ---


def test_walk_and_scan(spark, tmp_path):
    root = tmp_path / "cine"
    for name, n in {"F [X, 1973]/a.mkv": 4096, "F [X, 1973]/a.spa.srt": 100, "F [X, 1973]/info.nfo": 10, "Thumbs.db": 5, ".hid/x.mkv": 9, "e.avi": 0, "_G/_c.mkv": 7, "a/b/c/d/e/f.mkv": 8}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"x" * n)
    found = listing.walk(spark, f"file://{root}")
    assert {r.path.rpartition("/")[2]: r.kind for r in found.collect()} == {"a.mkv": "video", "a.spa.srt": "subtitle", "info.nfo": "info", "e.avi": "video", "_c.mkv": "video", "f.mkv": "video"}
    for share in (1, 100):  # tasks walk below folders, or the driver has listed all
        files, clean = listing.walk_roots(spark, [str(root), f"{tmp_path}/gone"], share)
        assert files.count() == 6 and clean == [str(root)]
    first = listing.scan(found, schema.empty(spark, "files")).cache()
    fps = {r.path.rpartition("/")[2]: r.fingerprint for r in first.collect()}
    assert len(fps["a.mkv"]) == 32 and fps["a.spa.srt"] == "" and listing.fingerprint_file(str(root / "e.avi")) == ""
    assert fps["e.avi"] == "" and {r.path.rpartition("/")[2] for r in listing.changed(found, first).where("fingerprint is null").collect()} == {"e.avi"}
    known = schema.complete(first, "files").cache()
    assert known.count() == 6
    (root / "_G" / "_c.mkv").write_bytes(b"y" * 9)
    (root / "new.mkv").write_bytes(b"z")
    later = listing.walk(spark, str(root)).cache()
    assert later.count() == 7
    (root / "_G" / "_c.mkv").unlink()  # listed, but not to be read when its turn comes
    (root / "new.mkv").unlink()
    again = {r.path.rpartition("/")[2]: r for r in listing.scan(later, known).collect()}
    assert len(again) == 7 and (again["_c.mkv"].size, again["_c.mkv"].fingerprint) == (7, fps["_c.mkv"]) and (again["new.mkv"].size, again["new.mkv"].fingerprint) == (1, "")
    native = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"file://{root}").where("path like '%a.mkv'")
    assert native.select(listing.content_fingerprint(F.col("content"), F.col("length")).alias("f")).first().f == fps["a.mkv"]
    big = tmp_path / "big"
    big.write_bytes(bytes(range(256)) * 9000)
    assert listing.fingerprint_file(str(big)) == listing.fingerprint_bytes(big.read_bytes()[: 1 << 20], big.read_bytes()[-(1 << 20) :], 256 * 9000)
    with pytest.raises(ValueError):
        listing.check_roots(["../a", "../a/b"])


def test_feeds(spark):
    b = spark.createDataFrame([("5", "http://x/Q9", "tt1", "it", "Fellini", "1973-01-01"), ("5", "http://x/Q9", "", "fr", "Q77", "1972-05-01"), ("z", "", "", "", "", "")], "tmdb string, item string, imdb string, country string, director string, date string")
    e = feeds.entities(b)
    r = e.first()
    assert (r.tmdb_id, r.wikidata_id, r.imdb_id, r.countries, r.directors, r.year) == (5, "Q9", "tt1", ["FR", "IT"], ["Fellini"], 1972)
    m = schema.complete(spark.createDataFrame([(5, "T", "o", 0)], "tmdb_id int, title string, overview string, year int"), "movies")
    f = feeds.filled(m, e).first()
    assert (f.year, f.countries, [tuple(x) for x in f.directors]) == (1972, ["FR", "IT"], [(0, "Fellini")])
    t = spark.createDataFrame([(5, "es-MX", "Uno", ""), (5, "en", "One", "Text"), (5, "es", "", "")], "tmdb_id int, lang string, title string, overview string")
    x = feeds.translated(m, t, "es").first()
    assert (x.title, x.overview) == ("Uno", "Text")
    j = '{"format":{"format_name":"matroska,webm","duration":"61.5"},"streams":[{"codec_type":"video","codec_name":"png","disposition":{"attached_pic":1}},{"codec_type":"video","codec_name":"hevc","width":1920,"height":800},{"codec_type":"audio","codec_name":"pcm_s16le","channels":2,"tags":{"language":"spa"}}]}'
    p = feeds.probed(spark.createDataFrame([(j,)], "json string")).first()
    assert (p.container, p.duration_ms, p.width, p.video_codec, [tuple(a) for a in p.audio]) == ("matroska", 61500, 1920, "hevc", [("pcm", "es", 2)])


# --- header readers ---


def el(eid, body):
    n = (eid.bit_length() + 7) // 8
    return eid.to_bytes(n, "big") + (0x01 << 56 | len(body)).to_bytes(8, "big") + body


def make_mkv():
    h = headers
    video = el(h.TRACK_ENTRY, el(h.TRACK_TYPE, b"\1") + el(h.CODEC_ID, b"V_MPEG4/ISO/AVC") + el(h.VIDEO, el(h.WIDTH, b"\x07\x80") + el(h.HEIGHT, b"\x03\x20")))
    audio = el(h.TRACK_ENTRY, el(h.TRACK_TYPE, b"\2") + el(h.CODEC_ID, b"A_AC3") + el(h.LANGUAGE, b"spa") + el(h.AUDIO, el(h.CHANNELS, b"\6")))
    sub = el(h.TRACK_ENTRY, el(h.TRACK_TYPE, b"\x11") + el(h.CODEC_ID, b"S_TEXT/UTF8"))
    info = el(h.INFO, el(h.DURATION, struct.pack(">d", 60_000.0)))
    return el(h.EBML, el(h.DOC_TYPE, b"matroska")) + el(h.SEGMENT, info + el(h.TRACKS, video + audio + sub) + el(h.CLUSTER, b"\0" * 64))


def box(kind, body):
    return struct.pack(">I4s", 8 + len(body), kind.encode("latin-1")) + body


def make_mp4():
    def trak(i, kind, entry):
        tkhd = box("tkhd", b"\0" * 12 + struct.pack(">I", i) + b"\0" * 68)
        mdhd = box("mdhd", b"\0" * 12 + struct.pack(">II", 1000, 5000) + struct.pack(">HH", 0x15C7, 0))
        hdlr = box("hdlr", b"\0" * 8 + kind.encode() + b"\0" * 12)
        stsd = box("stsd", b"\0" * 4 + struct.pack(">I", 1) + entry)
        return box("trak", tkhd + box("mdia", mdhd + hdlr + box("minf", box("stbl", stsd))))

    video = box("avc1", b"\0" * 24 + struct.pack(">HH", 1280, 528) + b"\0" * 50)
    audio = box("mp4a", b"\0" * 16 + struct.pack(">H", 2) + b"\0" * 10 + box("esds", b"\0" * 4 + bytes([3, 25, 0, 0, 0, 4, 17, 0x40]) + b"\0" * 12 + bytes([5, 2, 0x11, 0xB0])))
    moov = box("moov", box("mvhd", b"\0" * 12 + struct.pack(">II", 600, 60_000) + b"\0" * 80) + trak(1, "vide", video) + trak(2, "soun", audio) + trak(3, "sbtl", box("tx3g", b"\0" * 20)))
    return box("ftyp", b"isom\0\0\0\0") + moov


def make_avi():
    c = lambda k, b: k + struct.pack("<I", len(b)) + b + b"\0" * (len(b) & 1)
    l = lambda k, b: c(b"LIST", k + b)
    avih = struct.pack("<IIIIIIIIII", 40_000, 0, 0, 0, 2500, 0, 2, 0, 640, 352)
    strh = lambda k, scale, rate, n: k + b"\0" * 16 + struct.pack("<IIII", scale, rate, 0, n) + b"\0" * 20
    video = l(b"strl", c(b"strh", strh(b"vids", 1, 25, 2500)) + c(b"strf", struct.pack("<IiiHH4s", 40, 640, 352, 1, 24, b"XVID") + b"\0" * 20))
    audio = l(b"strl", c(b"strh", strh(b"auds", 1, 48000, 1)) + c(b"strf", struct.pack("<HHIIHH", 0x2000, 5, 48000, 0, 0, 0)))
    body = b"AVI " + l(b"hdrl", c(b"avih", avih) + video + audio) + l(b"movi", b"\0" * 16)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def test_avi_rules():
    """A main header is needed and enough; a picture format of under 20 bytes tells nothing, the main header's frame counts then."""
    whole = make_avi()
    assert headers.probe(headers.Source.of(whole.replace(b"avih", b"xxxx")))["error"] != ""
    alone = headers.probe(headers.Source.of(whole.replace(b"strh", b"xxxx")))
    assert (alone["error"], alone["duration_ms"], alone["width"], alone["video_codec"], alone["audio"]) == ("", 100_000, 640, "", [])
    at = whole.index(b"strf")
    short = whole[:at] + b"strf" + struct.pack("<I", 16) + whole[at + 8 : at + 24] + whole[at + 8 + struct.unpack_from("<I", whole, at + 4)[0] :]
    cut = struct.unpack_from("<I", whole, at + 4)[0] - 16
    for name in (b"strl", b"hdrl"):  # the lists around it are shorter too
        k = short.index(name) - 4
        short = short[:k] + struct.pack("<I", struct.unpack_from("<I", short, k)[0] - cut) + short[k + 4 :]
    got = headers.probe(headers.Source.of(short))
    assert (got["error"], got["video_codec"], got["width"], [x["codec"] for x in got["audio"]]) == ("", "", 640, ["ac3"])


def make_ifo():
    h = bytearray(4096)
    h[:12] = b"DVDVIDEO-VTS"
    struct.pack_into(">I", h, 0xCC, 1)
    struct.pack_into(">H", h, 0x200, 1 << 12)
    struct.pack_into(">H", h, 0x202, 1)
    h[0x204:0x208] = bytes([1 << 2, 5]) + b"es"
    struct.pack_into(">H", h, 0x254, 1)
    h[0x256:0x25A] = bytes([1, 0]) + b"en"
    struct.pack_into(">H", h, 2048, 1)
    struct.pack_into(">I", h, 2048 + 12, 100)
    h[2048 + 104 : 2048 + 108] = bytes([0x01, 0x30, 0x00, 0x40])
    return bytes(h)


@pytest.mark.parametrize("data,want", [
    (make_mkv(), ("mkv", 60_000, 1920, 800, "h264", [("ac3", "es", 6)], [("srt", "en", 0)])), (make_mp4(), ("mp4", 100_000, 1280, 528, "h264", [("aac", "en", 6)], [("mov_text", "en", 0)])),
    (make_avi(), ("avi", 100_000, 640, 352, "mpeg4", [("ac3", "", 6)], [])), (make_ifo(), ("ifo", 5_400_000, 720, 576, "mpeg2", [("ac3", "es", 6)], [("vobsub", "en", 0)])),
])
def test_readers(spark, tmp_path, data, want):
    tracks = lambda xs: [(x["codec"], x["lang"], x["channels"]) for x in xs]
    r = headers.probe(headers.Source.of(data))
    assert r["error"] == "" and (r["prober"], r["duration_ms"], r["width"], r["height"], r["video_codec"], tracks(r["audio"]), tracks(r["subs"])) == want
    for n in (0, 3, 9, 20, len(data) // 2, len(data) - 70):
        headers.probe(headers.Source.of(data[:n]))  # cut files give a row, never an exception
    (tmp_path / "x").write_bytes(data)
    df = headers.probe_files(spark.createDataFrame([(str(tmp_path / "x"), len(data), 1), ("/none", 1, 1)], "path string, size long, mtime long"))
    assert [x.prober for x in df.collect()] == [want[0]]
    assert spark.createDataFrame([(data[:16],)], "h binary").select(headers.magic(F.col("h")).alias("m")).first().m == want[0]


def test_stream(spark, tmp_path):
    from lumenframe.streaming.ingest import ingest

    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text('{"path":"r/a","size":1,"mtime":1,"kind":"video","fingerprint":"f"}\n')
    run = lambda: ingest(spark, str(src), f"file://{tmp_path}/cat", f"{tmp_path}/ck", ["r"], now=5)
    assert [r.path for r in run().read("files").collect()] == ["r/a"]
    (src / "2.json").write_text('{"path":"r/b","size":1,"mtime":1,"kind":"video","fingerprint":"f"}\n{"path":"r/a","size":2,"mtime":2,"kind":"video","fingerprint":"g"}\n')
    assert {r.path: (r.fingerprint, r.first_seen) for r in run().read("files").collect()} == {"r/a": ("g", 5), "r/b": ("f", 5)}
    began = (src / "1.json").stat().st_mtime
    dated = ingest(spark, str(src), f"file://{tmp_path}/cat2", f"{tmp_path}/ck2", ["r"])
    assert {r.first_seen // 1000 - int(began) in range(300) for r in dated.read("files").collect()} == {True}
