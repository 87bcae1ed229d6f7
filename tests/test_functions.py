"""Scalar functions against hand-made cases."""

import pytest
from pyspark.sql import functions as F

from lumenframe.functions import media, text


def value(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


@pytest.mark.parametrize("s,want", [("El Ángel Exterminador", "angel exterminador"), ("The", "the"), ("8½", "8"), ("Łódź Æon ß", "lodz aeon ss"), ("", ""), ("LA  Notte!", "notte"), ("árbol", "arbol")])
def test_norm_title(spark, s, want):
    assert value(spark, text.norm_title(F.lit(s))) == want


def test_text(spark):
    got = spark.range(1).select(
        text.strip_accents(F.lit("Ñandú ÆGIR ßé")).alias("strip"), text.ascii_lower(F.lit("AÉ")).alias("low"), text.group_key(F.lit("The Thing"), F.lit(1982)).alias("key"), text.group_key(F.lit("!"), F.lit(1)).alias("none"),
        text.similarity(F.lit("Amarcord"), F.lit("AMARCORD")).alias("s1"), text.similarity(F.lit("Solyaris"), F.lit("Solaris")).alias("s2"), text.similarity(F.lit(""), F.lit("x")).alias("s3"), text.similarity(F.lit("abc"), F.lit("xyz")).alias("s4"),
        text.title_variants(F.lit("Novecento (1900) [cut]")).alias("var"), text.terms(F.lit("8½ mujeres")).alias("t"), text.terms(F.lit("a")).alias("t0"), text.list_name(F.lit("  x ")).alias("ln"), text.list_name(F.lit(" ")).alias("ln0"),
        text.stem(F.lit("a/b.c/Film.en.srt")).alias("stem"), text.ext(F.lit("a/B.MKV")).alias("ext"), text.parent(F.lit("a/b/c.x")).alias("par"), text.image_version(F.lit("/aB-1.jpg")).alias("iv"), text.image_version(F.lit("/../x.jpg")).alias("iv0"),
        text.format_duration(F.lit(7_380_000)).alias("dur"), text.format_size(F.lit(1536)).alias("size"), text.percent(F.lit(0.876)).alias("pct"), text.decade(F.lit(1987)).alias("dec"),
        text.relative_path(F.lit("/m/cine/a.avi"), "/m/app").alias("rel"), text.absolute_path(F.lit("../cine/a.avi"), "/m/app").alias("abs"), text.same_title(F.lit(" Él"), F.lit("el ")).alias("same"),
    ).first()
    assert (got.strip, got.low, got.key, got.none) == ("Nandu ÆGIR ße", "aÉ", "thing|1982", "")
    assert (got.s1, got.s2, got.s3, got.s4) == (1.0, 0.875, 0.0, 0.0)
    assert list(got["var"]) == ["Novecento", "1900", "cut"]
    assert (list(got.t), list(got.t0), got.ln, got.ln0) == (["8", "mujeres"], [], "x", None)
    assert (got.stem, got.ext, got.par, got.iv, got.iv0) == ("Film.en", ".mkv", "a/b", "aB-1", "")
    assert (got.dur, got.size, got.pct, got.dec, got.rel, got["abs"], got.same) == ("2 h 3 min", "1,5 KB", "88 %", 1980, "../cine/a.avi", "/m/cine/a.avi", True)


@pytest.mark.parametrize("a,b,want", [(1973, 1973, 0.25), (1973, 1974, 0.15), (1973, 1975, 0.0), (1973, 0, 0.0), (0, 1990, 0.10)])
def test_year_score(spark, a, b, want):
    assert value(spark, text.year_score(F.lit(a), F.lit(b))) == want


@pytest.mark.parametrize("f,parsed,people,want", [("director_matches", "Polanski", ["Roman Polański"], True), ("director_matches", "Donner", ["Richard Lester"], False), ("surname_matches", "M. Pialat", ["Maurice Pialat"], True), ("surname_matches", "Maurice", ["Maurice Pialat"], False), ("director_matches", "", ["X"], False)])
def test_directors(spark, f, parsed, people, want):
    assert value(spark, getattr(text, f)(F.lit(parsed), F.array(*[F.lit(p) for p in people]))) is want


@pytest.mark.parametrize("rt,m,want", [(100, 105, True), (100, 110, False), (0, 3, False), (160, 150, True), (163, 150, False)])
def test_runtime(spark, rt, m, want):
    assert value(spark, text.runtime_matches(F.lit(rt), F.lit(m))) is want


@pytest.mark.parametrize("name,want", [("a/X.MKV", "video"), ("VTS_01_1.VOB", "dvd"), ("x.srt", "subtitle"), ("x.nfo", "info"), ("Thumbs.db", "junk"), ("._x.mkv", "junk"), ("x.txt", "junk"), ("x", "other")])
def test_kind(spark, name, want):
    assert value(spark, media.kind(F.lit(name))) == want


@pytest.mark.parametrize("w,h,want", [(0, 0, ""), (3840, 1600, "2160p"), (1920, 800, "1080p"), (1280, 528, "720p"), (720, 576, "576p"), (720, 480, "480p"), (640, 352, "SD")])
def test_frame(spark, w, h, want):
    assert value(spark, media.frame_label(F.lit(w), F.lit(h))) == want


def test_media(spark):
    got = spark.range(1).select(
        media.codec_rank(F.lit("av1")).alias("a"), media.codec_rank(F.lit("mpeg1")).alias("b"), media.codec_rank(F.lit("x")).alias("c"), media.codec_rank(F.lit("")).alias("d"), media.bucket(F.lit("1080i")).alias("e"), media.bucket(F.lit("576p")).alias("f"),
        media.ff_codec(F.lit("PCM_S16LE")).alias("g"), media.ff_codec(F.lit("subrip")).alias("h"), media.language(F.lit(" en_US")).alias("i"), media.language(F.lit("ger")).alias("j"), media.language(F.lit("und")).alias("k"),
        media.subtitle_language(F.lit("Movie.en.forced")).alias("l"), media.subtitle_language(F.lit("English")).alias("m"), media.subtitle_language(F.lit("Movie")).alias("n"), media.codec_from_name(F.lit("H.265")).alias("o"),
        media.packed_language(F.lit(0x15C7)).alias("p"), media.dvd_time(F.lit(0x01), F.lit(0x02), F.lit(0x03), F.lit(0x52)).alias("q"), media.dvd_time(F.lit(0x0A), F.lit(0), F.lit(0), F.lit(0x40)).alias("r"), media.year_of(F.lit("1973-12-13")).alias("s"), media.year_of(F.lit("n/a")).alias("t"),
        media.mp4_duration(F.lit(90_000), F.lit(1000), F.lit(4_294_967_295)).alias("u"),
    ).first()
    assert list(got) == [11, 2, 1, 0, "1080p", "SD", "pcm", "srt", "en", "de", "", "en", "en", "", "hevc", "eng", 3_723_480, 0, 1973, 0, 90_000]
