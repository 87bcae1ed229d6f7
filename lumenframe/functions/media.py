"""Media vocabulary: file kinds, resolutions, codecs, languages, and the small decoders of header fields."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenframe.functions.text import base_name, col, ext

# File kinds.
VIDEO_EXT = (".mkv", ".mp4", ".m4v", ".avi", ".mov", ".wmv", ".mpg", ".mpeg", ".ts", ".m2ts", ".webm", ".ogm", ".rmvb", ".rm", ".divx", ".flv", ".3gp")
DVD_EXT = (".vob", ".ifo", ".bup")
SUBTITLE_EXT = (".srt", ".sub", ".idx", ".ass", ".ssa", ".vtt", ".smi")
JUNK_EXT = (".txt", ".url", ".sfv", ".md5", ".db", ".ini", ".torrent", ".html", ".htm", ".lnk", ".log", ".par2")
JUNK_NAMES = ("thumbs.db", "desktop.ini", ".ds_store", "sync.ffs_db")

# Ranks.
RESOLUTION_RANK = {"2160p": 7, "1080p": 6, "1080i": 6, "720p": 5, "576p": 4, "480p": 3, "SD": 2}
CODECS_BEST_FIRST = ("av1", "hevc", "vp9", "h264", "vp8", "mpeg4", "wmv", "rv", "mpeg2", "mpeg1")
BUCKET_RANK = {"4K": 4, "1080p": 3, "720p": 2, "SD": 1}

# Codec names of the probing tool, of AVI headers and of WAV tags.
FF_CODECS = {
    "h264": "h264", "hevc": "hevc", "av1": "av1", "vp9": "vp9", "vp8": "vp8", "mpeg4": "mpeg4", "msmpeg4v1": "mpeg4", "msmpeg4v2": "mpeg4", "msmpeg4v3": "mpeg4",
    "mpeg2video": "mpeg2", "mpeg1video": "mpeg1", "wmv1": "wmv", "wmv2": "wmv", "wmv3": "wmv", "vc1": "wmv", "rv10": "rv", "rv20": "rv", "rv30": "rv", "rv40": "rv",
    "theora": "theora", "mjpeg": "mjpeg", "aac": "aac", "ac3": "ac3", "eac3": "eac3", "dts": "dts", "truehd": "truehd", "flac": "flac", "mp3": "mp3", "mp2": "mp2",
    "opus": "opus", "vorbis": "vorbis", "wmav1": "wma", "wmav2": "wma", "wmapro": "wma", "subrip": "srt", "srt": "srt", "ass": "ass", "ssa": "ass",
    "hdmv_pgs_subtitle": "pgs", "dvd_subtitle": "vobsub", "dvb_subtitle": "dvbsub", "mov_text": "mov_text", "webvtt": "webvtt",
}
FOURCCS = {
    "xvid": "mpeg4", "divx": "mpeg4", "dx50": "mpeg4", "fmp4": "mpeg4", "mp4v": "mpeg4", "3iv2": "mpeg4", "m4s2": "mpeg4", "xvix": "mpeg4", "dxgm": "mpeg4",
    "div3": "mpeg4", "div4": "mpeg4", "mp43": "mpeg4", "mp42": "mpeg4", "mpg4": "mpeg4", "h264": "h264", "x264": "h264", "avc1": "h264", "hevc": "hevc",
    "h265": "hevc", "hvc1": "hevc", "mpg2": "mpeg2", "mpg1": "mpeg1", "mjpg": "mjpeg", "wmv1": "wmv", "wmv2": "wmv", "wmv3": "wmv", "wvc1": "wmv",
    "vp80": "vp8", "vp90": "vp9", "av01": "av1",
}
WAV_TAGS = {
    0x0001: "pcm", 0x0003: "pcm", 0xFFFE: "pcm", 0x0050: "mp2", 0x0055: "mp3", 0x2000: "ac3", 0x2001: "dts", 0x00FF: "aac", 0x1600: "aac", 0x1601: "aac", 0x706D: "aac",
    0x0161: "wma", 0x0162: "wma", 0x0163: "wma", 0x674F: "vorbis", 0x6750: "vorbis", 0x6751: "vorbis", 0x676F: "vorbis", 0x6770: "vorbis", 0x6771: "vorbis", 0xF1AC: "flac",
}

# ISO 639-2 (both forms) to ISO 639-1; names of languages in subtitle names.
ISO_639_2 = {
    "spa": "es", "eng": "en", "fre": "fr", "fra": "fr", "ger": "de", "deu": "de", "ita": "it", "por": "pt", "rus": "ru", "jpn": "ja", "chi": "zh", "zho": "zh", "kor": "ko",
    "dut": "nl", "nld": "nl", "swe": "sv", "dan": "da", "nor": "no", "nob": "no", "fin": "fi", "pol": "pl", "cze": "cs", "ces": "cs", "hun": "hu", "gre": "el", "ell": "el",
    "tur": "tr", "ara": "ar", "heb": "he", "hin": "hi", "per": "fa", "fas": "fa", "rum": "ro", "ron": "ro", "cat": "ca", "glg": "gl", "baq": "eu", "eus": "eu", "ukr": "uk",
    "bul": "bg", "hrv": "hr", "srp": "sr", "slv": "sl", "slo": "sk", "slk": "sk", "tha": "th", "vie": "vi", "ind": "id", "may": "ms", "msa": "ms", "ice": "is", "isl": "is", "lat": "la",
}
SUBTITLE_LANGUAGES = {
    "es": "es", "spa": "es", "esp": "es", "spanish": "es", "español": "es", "espanol": "es", "castellano": "es", "latino": "es", "en": "en", "eng": "en", "english": "en",
    "ingles": "en", "inglés": "en", "it": "it", "ita": "it", "italian": "it", "italiano": "it", "fr": "fr", "fre": "fr", "fra": "fr", "french": "fr", "frances": "fr",
    "francés": "fr", "de": "de", "ger": "de", "deu": "de", "german": "de", "aleman": "de", "alemán": "de", "pt": "pt", "por": "pt", "portuguese": "pt", "portugues": "pt",
    "português": "pt", "ru": "ru", "rus": "ru", "russian": "ru", "ja": "ja", "jpn": "ja", "japanese": "ja",
}
SUBTITLE_QUALIFIERS = ("forced", "sdh", "hi", "cc")
WEEK_MS = 7 * 24 * 3600 * 1000


def lookup(values: dict, key: Column) -> Column:
    """The value of a fixed table, null for other keys."""
    return F.try_element_at(F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())]), key)


def kind(name) -> Column:
    """video, dvd, subtitle, info, junk or other; junk names come first."""
    low, e = F.lower(base_name(name)), ext(name)
    return (
        F.when(low.isin(*JUNK_NAMES) | low.startswith("._"), "junk").when(e.isin(*VIDEO_EXT), "video").when(e.isin(*DVD_EXT), "dvd")
        .when(e.isin(*SUBTITLE_EXT), "subtitle").when(e == ".nfo", "info").when(e.isin(*JUNK_EXT), "junk").otherwise("other")
    )


def stored(k) -> Column:
    return col(k).isin("video", "dvd", "subtitle", "info")


def fingerprinted(k) -> Column:
    return col(k).isin("video", "dvd")


def frame_label(width, height) -> Column:
    """Width counts as much as height: a 1920 x 800 picture is 1080p."""
    w, h = col(width), col(height)
    out = F.when((w <= 0) & (h <= 0), "")
    for label, least_w, least_h in (("2160p", 3200, 2000), ("1080p", 1800, 1000), ("720p", 1200, 700), ("576p", 1 << 30, 540), ("480p", 1 << 30, 400)):
        out = out.when((w >= least_w) | (h >= least_h), label)
    return out.otherwise("SD")


def bucket(resolution) -> Column:
    """The four buckets of the resolution facet; '' stays ''."""
    r = col(resolution)
    return F.when(r == "2160p", "4K").when(r.isin("1080p", "1080i"), "1080p").when(r == "720p", "720p").when(r != "", "SD").otherwise("")


def bucket_rank(b) -> Column:
    return F.coalesce(lookup(BUCKET_RANK, col(b)), F.lit(0))


def resolution_rank(r) -> Column:
    return F.coalesce(lookup(RESOLUTION_RANK, col(r)), F.lit(0))


def codec_rank(c) -> Column:
    """Best first; other known codecs 1, unknown 0."""
    n = len(CODECS_BEST_FIRST)
    return F.coalesce(lookup({x: n + 1 - i for i, x in enumerate(CODECS_BEST_FIRST)}, col(c)), F.when(col(c) != "", 1).otherwise(0))


def codec_from_name(c) -> Column:
    low = F.lower(col(c))
    return F.coalesce(lookup({"h.264": "h264", "h.265": "hevc", "xvid": "mpeg4", "divx": "mpeg4"}, low), low)


def ff_codec(c) -> Column:
    low = F.lower(col(c))
    return F.when(low.startswith("pcm_"), "pcm").otherwise(F.coalesce(lookup(FF_CODECS, low), low))


def language(c) -> Column:
    """'spa', 'es', 'es-419' or 'en_US' to ISO 639-1; '' for anything else."""
    s = F.element_at(F.split(F.lower(F.trim(col(c))), "[-_]"), 1)
    return F.when(s.isin(*sorted(set(ISO_639_2.values()))), s).otherwise(F.coalesce(lookup(ISO_639_2, s), F.lit("")))


def subtitle_language(stem) -> Column:
    """Language of a subtitle's stem: its last token that isn't a qualifier."""
    tokens = F.filter(F.split(F.lower(col(stem)), r"[\s._\-\[\]()]+"), lambda t: (t != "") & ~t.isin(*SUBTITLE_QUALIFIERS))
    return F.coalesce(lookup(SUBTITLE_LANGUAGES, F.try_element_at(tokens, F.lit(-1))), F.lit(""))


def sane_ms(ms) -> Column:
    m = col(ms)
    return F.when((m > 0) & (m < WEEK_MS), m.cast("long")).otherwise(F.lit(0).cast("long"))


def sane_dim(n) -> Column:
    return F.when(col(n).between(1, 65535), col(n)).otherwise(0)


def sane_channels(n) -> Column:
    return F.when(col(n).between(1, 64), col(n)).otherwise(0)


def packed_language(code) -> Column:
    """Three letters of five bits each, from 0x60 up."""
    c = col(code)
    return F.concat(*[F.char(F.shiftright(c, n).bitwiseAND(F.lit(31)) + 96) for n in (10, 5, 0)])


def mp4_duration(duration, scale, unknown) -> Column:
    d, s = col(duration), col(scale)
    return F.when((d == col(unknown)) | (s <= 0), F.lit(0).cast("long")).otherwise(sane_ms(F.floor(d * 1000 / s)))


def dvd_time(h, m, s, frames) -> Column:
    """BCD hours, minutes, seconds and frames (their top bits: 1 is 25 a second, 3 is 29.97) in ms; 0 where a digit is out of range."""
    two = lambda x: F.shiftright(x, 4) * 10 + x.bitwiseAND(F.lit(15))
    good = lambda x: (F.shiftright(x, 4) <= 9) & (x.bitwiseAND(F.lit(15)) <= 9)
    h, m, s, f = (col(x) for x in (h, m, s, frames))
    fps, n = F.shiftright(f, 6), f.bitwiseAND(F.lit(63))
    rate = F.when(fps == 1, 25.0).when(fps == 3, 30000 / 1001)
    ok = good(h) & good(m) & good(s) & good(n) & (two(m) < 60) & (two(s) < 60) & rate.isNotNull()
    return F.when(ok, (((two(h) * 60 + two(m)) * 60 + two(s)) * 1000 + F.floor(two(n) * 1000 / rate)).cast("long")).otherwise(F.lit(0).cast("long"))


def year_of(date) -> Column:
    """The first four characters of a date as a number, 0 if they are none."""
    return F.coalesce(F.substring(col(date), 1, 4).try_cast("int"), F.lit(0))
