"""Readers of media headers: Matroska, MP4, AVI and DVD title sets, from bounded ranged reads.

``probe_files`` runs them on paths; the reader is chosen by the first bytes. Every reader returns container, duration_ms,
width, height, video_codec, audio and subs (tracks of codec, lang, channels). Values out of range count as unknown (0).
"""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.media import FOURCCS, ISO_639_2, WAV_TAGS, WEEK_MS
from lumenframe.schema import TRACK

BUDGET = 16 << 20
READER_VERSION = 1


class FormatError(ValueError):
    """The bytes aren't what the reader expects: another tool may do better."""


class Source:
    """Reads at offsets of a file (or bytes), at most BUDGET bytes in all."""

    def __init__(self, file, size: int):
        self.file, self.size, self.left = file, size, BUDGET

    @classmethod
    def of(cls, data: bytes) -> Source:
        import io

        return cls(io.BytesIO(data), len(data))

    def read(self, at: int, n: int) -> bytes:
        if at < 0 or n < 0 or at + n > self.size:
            raise FormatError("beyond the end")
        if n > self.left:
            raise FormatError("read budget used up")
        self.left -= n
        self.file.seek(at)
        out = self.file.read(n)
        if len(out) < n:
            raise FormatError("short read")
        return out


def sane_ms(ms: float) -> int:
    return int(ms) if 0 < ms < WEEK_MS else 0


def dim(n: int) -> int:
    return n if 0 < n <= 65535 else 0


def channels(n: int) -> int:
    return n if 0 < n <= 64 else 0


def lang(s: str) -> str:
    s = s.strip().lower().replace("_", "-").split("-")[0]
    return s if s in ISO_639_2.values() else ISO_639_2.get(s, "")


def fourcc(b: bytes) -> str:
    if b == b"\0\0\0\0":
        return "rawvideo"
    s = b.rstrip(b"\0 ").decode("latin-1").lower()
    return FOURCCS.get(s, s)


def track(codec: str, language: str, n: int) -> dict:
    return {"codec": codec, "lang": language, "channels": channels(n)}


def blank(container: str) -> dict:
    return {"container": container, "duration_ms": 0, "width": 0, "height": 0, "video_codec": "", "audio": [], "subs": []}


def aac_channels(config: bytes) -> int:
    """channelConfiguration of an AudioSpecificConfig: after 5 bits of type and 4 of frequency (24 more if those are 15)."""
    if len(config) < 2 or config[0] >> 3 == 31:
        return 0
    bits = int.from_bytes(config[:6].ljust(6, b"\0"), "big")
    rate = bits >> 39 & 15
    if rate == 15 and len(config) < 5:
        return 0
    n = bits >> (11 if rate == 15 else 35) & 15
    return n if n <= 6 else 8 if n == 7 else 0


# --- Matroska ---

# Element ids.
SEGMENT, SEEK_HEAD, SEEK, SEEK_ID, SEEK_AT, INFO, SCALE, DURATION, TRACKS, TRACK_ENTRY, CLUSTER = 0x18538067, 0x114D9B74, 0x4DBB, 0x53AB, 0x53AC, 0x1549A966, 0x2AD7B1, 0x4489, 0x1654AE6B, 0xAE, 0x1F43B675
TRACK_TYPE, CODEC_ID, CODEC_PRIVATE, LANGUAGE, LANGUAGE_IETF, VIDEO, AUDIO, WIDTH, HEIGHT, CHANNELS, DOC_TYPE, EBML = 0x83, 0x86, 0x63A2, 0x22B59C, 0x22B59D, 0xE0, 0xE1, 0xB0, 0xBA, 0x9F, 0x4282, 0x1A45DFA3
# Codec ids; a trailing '*' stands for any ending.
MKV_VIDEO = {"V_MPEG4/ISO/AVC": "h264", "V_MPEGH/ISO/HEVC": "hevc", "V_AV1": "av1", "V_VP9": "vp9", "V_VP8": "vp8", "V_MPEG4/ISO/*": "mpeg4", "V_MPEG4/MS/*": "mpeg4", "V_MPEG2": "mpeg2", "V_MPEG1": "mpeg1", "V_REAL/*": "rv", "V_THEORA": "theora", "V_MJPEG": "mjpeg"}
MKV_AUDIO = {"A_AAC*": "aac", "A_AC3": "ac3", "A_EAC3": "eac3", "A_DTS*": "dts", "A_TRUEHD": "truehd", "A_FLAC": "flac", "A_MPEG/L3": "mp3", "A_MPEG/L2": "mp2", "A_OPUS": "opus", "A_VORBIS": "vorbis", "A_PCM/*": "pcm"}
MKV_SUBS = {"S_TEXT/UTF8": "srt", "S_TEXT/ASCII": "srt", "S_TEXT/SSA": "ass", "S_TEXT/ASS": "ass", "S_SSA": "ass", "S_ASS": "ass", "S_HDMV/PGS": "pgs", "S_VOBSUB": "vobsub", "S_DVBSUB": "dvbsub", "S_TEXT/WEBVTT": "webvtt"}


def mkv_codec(table: dict, codec_id: str) -> str:
    for k, v in table.items():
        if codec_id == k or k.endswith("*") and codec_id.startswith(k[:-1]):
            return v
    return codec_id[2:].lower() if codec_id[1:2] == "_" else codec_id.lower()


def element(src: Source, at: int, end: int) -> tuple[int, int, int]:
    """(id, start of the content, its end) of the element at ``at``; a size of all ones runs to ``end``."""
    head = src.read(at, min(12, end - at))
    n = 9 - head[0].bit_length() if head else 0
    if not 1 <= n <= 4 or len(head) < n + 1:
        raise FormatError("bad element id")
    eid = int.from_bytes(head[:n], "big")
    m = 9 - head[n].bit_length()
    if m > 8 or len(head) < n + m:
        raise FormatError("bad element size")
    size = int.from_bytes(head[n : n + m], "big") & ((1 << 7 * m) - 1)
    start = at + n + m
    stop = end if size == (1 << 7 * m) - 1 else start + size
    if stop > end:
        if eid != SEGMENT:
            raise FormatError("element past its parent")
        stop = end
    return eid, start, stop


def children(src: Source, at: int, end: int):
    while at < end:
        eid, start, stop = element(src, at, end)
        yield eid, start, stop
        at = stop


def number(b: bytes) -> int:
    return int.from_bytes(b, "big")


def mkv(src: Source) -> dict:
    out, doc = blank("matroska"), ""
    eid, a, z = element(src, 0, src.size)
    for k, s, e in children(src, a, z):
        if k == DOC_TYPE:
            doc = src.read(s, e - s).rstrip(b"\0").decode("latin-1")
    out["container"] = "webm" if doc == "webm" else "matroska"
    eid, seg, end = element(src, z, src.size)
    if eid != SEGMENT:
        raise FormatError("no segment")
    have, seeks = set(), {}

    def take(k: int, s: int, e: int) -> None:
        if k in have or k not in (INFO, TRACKS):
            return
        have.add(k)
        if k == INFO:
            parts = {x: src.read(p, q - p) for x, p, q in children(src, s, e) if x in (SCALE, DURATION)}
            d = parts.get(DURATION, b"")
            length = struct.unpack(">f" if len(d) == 4 else ">d", d)[0] if len(d) in (4, 8) else 0.0
            out["duration_ms"] = sane_ms(length * (number(parts[SCALE]) if SCALE in parts else 1_000_000) / 1e6)
        else:
            for x, p, q in children(src, s, e):
                if x == TRACK_ENTRY:
                    mkv_track(src, p, q, out)

    for k, s, e in children(src, seg, end):
        if k == CLUSTER:
            break
        if k == SEEK_HEAD:
            for x, p, q in children(src, s, e):
                if x == SEEK:
                    f = {y: number(src.read(i, j - i)) for y, i, j in children(src, p, q) if y in (SEEK_ID, SEEK_AT)}
                    if len(f) == 2:
                        seeks[f[SEEK_ID]] = seg + f[SEEK_AT]
        take(k, s, e)
        if have == {INFO, TRACKS}:
            break
    for k in (INFO, TRACKS):
        if k not in have and k in seeks:
            x, s, e = element(src, seeks[k], end)
            if x == k:
                take(x, s, e)
    if TRACKS not in have:
        raise FormatError("no tracks")
    return out


def mkv_track(src: Source, at: int, end: int, out: dict) -> None:
    f: dict = {}
    for k, s, e in children(src, at, end):
        if k in (VIDEO, AUDIO):
            f |= {x: number(src.read(p, q - p)) for x, p, q in children(src, s, e) if x in (WIDTH, HEIGHT, CHANNELS)}
        elif k in (TRACK_TYPE, CODEC_ID, CODEC_PRIVATE, LANGUAGE, LANGUAGE_IETF):
            f[k] = src.read(s, e - s)
    kind, cid, private = number(f.get(TRACK_TYPE, b"\0")), f.get(CODEC_ID, b"").rstrip(b"\0").decode("latin-1"), f.get(CODEC_PRIVATE, b"")
    language = lang(f.get(LANGUAGE_IETF, f.get(LANGUAGE, b"eng")).rstrip(b"\0").decode("latin-1"))
    if kind == 1 and not out["video_codec"]:
        codec = fourcc(private[16:20]) if cid == "V_MS/VFW/FOURCC" and len(private) >= 20 else mkv_codec(MKV_VIDEO, cid)
        out.update(video_codec=codec, width=dim(f.get(WIDTH, 0)), height=dim(f.get(HEIGHT, 0)))
    elif kind == 2:
        codec = WAV_TAGS.get(struct.unpack("<H", private[:2])[0], "") if cid == "A_MS/ACM" and len(private) >= 2 else mkv_codec(MKV_AUDIO, cid)
        out["audio"].append(track(codec, language, f.get(CHANNELS, 1)))
    elif kind == 17:
        out["subs"].append(track(mkv_codec(MKV_SUBS, cid), language, 0))


# --- MP4 ---

# Sample entries and object types.
MP4_VIDEO = {"avc1": "h264", "avc3": "h264", "hvc1": "hevc", "hev1": "hevc", "dvh1": "hevc", "dvhe": "hevc", "av01": "av1", "vp09": "vp9", "vp08": "vp8", "mp4v": "mpeg4", "jpeg": "mjpeg", "mjpa": "mjpeg", "mjpb": "mjpeg", "mjp2": "mjpeg"}
MP4_AUDIO = {"mp4a": "aac", "ac-3": "ac3", "ec-3": "eac3", "dtsc": "dts", "dtsh": "dts", "dtsl": "dts", "dtse": "dts", "mlpa": "truehd", "fLaC": "flac", "Opus": "opus", ".mp3": "mp3", "ms\0U": "mp3", "lpcm": "pcm", "sowt": "pcm", "twos": "pcm", "in24": "pcm", "in32": "pcm", "fl32": "pcm", "fl64": "pcm", "raw ": "pcm"}
MP4_SUBS = {"tx3g": "mov_text", "text": "mov_text", "wvtt": "webvtt", "stpp": "ttml", "c608": "eia_608", "mp4s": "vobsub"}
AUDIO_OBJECTS = {0x40: "aac", 0x66: "aac", 0x67: "aac", 0x68: "aac", 0x69: "mp3", 0x6B: "mp3", 0xA5: "ac3", 0xA6: "eac3", 0xA9: "dts", 0xDD: "vorbis"}
VIDEO_OBJECTS = {0x20: "mpeg4", 0x60: "mpeg2", 0x61: "mpeg2", 0x62: "mpeg2", 0x63: "mpeg2", 0x64: "mpeg2", 0x65: "mpeg2", 0x6A: "mpeg1", 0x6C: "mjpeg", 0x21: "h264"}
AC3_CHANNELS = (2, 1, 2, 3, 3, 4, 4, 5)


def boxes(src: Source, at: int, end: int):
    """(type, start of the content, end) of the boxes in a range; sizes of 64 bits and 'to the end' included."""
    while at + 8 <= end:
        size, kind = struct.unpack(">I4s", src.read(at, 8))
        start = at + 8
        if size == 1:
            size, start = struct.unpack(">Q", src.read(start, 8))[0], at + 16
        stop = end if size == 0 else at + size
        if stop < start or stop > end:
            raise FormatError("bad box size")
        yield kind.decode("latin-1"), start, stop
        at = stop


def mp4(src: Source) -> dict:
    out, tracks, chapters = blank("mp4"), [], set()
    moov = next(((s, e) for k, s, e in boxes(src, 0, src.size) if k == "moov"), None)
    if moov is None:
        raise FormatError("no moov")
    for k, s, e in boxes(src, *moov):
        if k == "mvhd":
            out["duration_ms"] = header_ms(src.read(s, min(e - s, 32)))
        elif k == "trak":
            t = mp4_track(src, s, e)
            tracks.append(t)
            chapters |= t["chapters"]
    for t in tracks:
        if not out["duration_ms"]:
            out["duration_ms"] = t["ms"]
        if t["kind"] == "vide" and not out["video_codec"]:
            out.update(video_codec=t["codec"], width=dim(t["width"]), height=dim(t["height"]))
        elif t["kind"] == "soun":
            out["audio"].append(track(t["codec"], t["lang"], t["channels"]))
        elif t["kind"] in ("sbtl", "subt", "text", "subp", "clcp") and t["id"] not in chapters:
            out["subs"].append(track(t["codec"], t["lang"], 0))
    if not tracks:
        raise FormatError("no tracks")
    return out


def header_ms(b: bytes) -> int:
    """Duration of an mvhd or mdhd box, version 0 or 1; all ones: unknown."""
    at, kind, ones = (20, ">IQ", (1 << 64) - 1) if b[0] == 1 else (12, ">II", (1 << 32) - 1)
    scale, length = struct.unpack_from(kind, b, at)
    return 0 if length == ones or not scale else sane_ms(length * 1000 // scale)


def mp4_track(src: Source, at: int, end: int) -> dict:
    t = {"id": 0, "kind": "", "codec": "", "lang": "", "channels": 0, "width": 0, "height": 0, "ms": 0, "chapters": set()}
    for k, s, e in boxes(src, at, end):
        if k == "tkhd":
            b = src.read(s, e - s)
            t["id"] = struct.unpack_from(">I", b, 20 if b[0] == 1 else 12)[0]
        elif k == "tref":
            for x, p, q in boxes(src, s, e):
                if x == "chap":
                    t["chapters"] |= set(struct.unpack(f">{(q - p) // 4}I", src.read(p, (q - p) // 4 * 4)))
        elif k == "mdia":
            mdia = list(boxes(src, s, e))
            for x, p, q in mdia:
                if x == "mdhd":
                    b = src.read(p, q - p)
                    t["ms"] = header_ms(b)
                    code = struct.unpack_from(">H", b, 32 if b[0] == 1 else 20)[0]
                    t["lang"] = lang("".join(chr((code >> n & 31) + 0x60) for n in (10, 5, 0)))
                elif x == "hdlr":
                    t["kind"] = src.read(p + 8, 4).decode("latin-1")
            for x, p, q in mdia:
                if x == "minf":
                    for y, i, j in boxes(src, p, q):
                        if y == "stbl":
                            for z, u, v in boxes(src, i, j):
                                if z == "stsd":
                                    sample_entry(src, u, v, t)
    return t


def sample_entry(src: Source, at: int, end: int, t: dict) -> None:
    kind, s, e = next(boxes(src, at + 8, end), (None, 0, 0))
    if kind is None:
        return
    if t["kind"] == "vide":
        t["width"], t["height"] = struct.unpack(">HH", src.read(s + 24, 4))
        t["codec"] = MP4_VIDEO.get(kind) or fourcc(kind.encode("latin-1"))
        inner = s + 78
    elif t["kind"] == "soun":
        version, t["channels"] = struct.unpack(">H6xH", src.read(s + 8, 10))
        t["codec"] = MP4_AUDIO.get(kind) or kind.strip().lower()
        inner = s + 28 + {1: 16, 2: 36}.get(version, 0)
    else:
        t["codec"] = MP4_SUBS.get(kind) or kind.strip().lower()
        return
    try:
        for k, p, q in boxes(src, min(inner, e), e):
            if k == "wave":
                for x, i, j in boxes(src, p, q):
                    detail(src, x, i, j, t)
            detail(src, k, p, q, t)
    except FormatError:
        pass  # what the entry itself says stays


def detail(src: Source, kind: str, at: int, end: int, t: dict) -> None:
    """Corrections by esds (object type, AAC channels) and AC-3 boxes (channels)."""
    if kind == "dac3":
        bits = number(src.read(at, 3))
        t["channels"] = AC3_CHANNELS[bits >> 11 & 7] + (bits >> 10 & 1)
    elif kind == "esds":
        b, i = src.read(at, end - at)[4:], 0
        while i < len(b):
            tag, i, n = b[i], i + 1, 0
            while i < len(b):
                n, more, i = n << 7 | b[i] & 127, b[i] & 128, i + 1
                if not more:
                    break
            if tag == 3:
                i += 3
            elif tag == 4 and i < len(b):
                t["codec"] = AUDIO_OBJECTS.get(b[i], "aac") if t["kind"] == "soun" else VIDEO_OBJECTS.get(b[i], "mpeg4")
                i += 13
            elif tag == 5:
                if t["codec"] == "aac" and (k := aac_channels(b[i : i + n])):
                    t["channels"] = k
                return
            else:
                i += n


# --- AVI ---


def avi(src: Source) -> dict:
    out = blank("avi")
    riff = struct.unpack("<4sI4s", src.read(0, 12))
    if riff[0] != b"RIFF" or riff[2] != b"AVI ":
        raise FormatError("no AVI")
    state = {"avih": None, "strh": [], "frames": 0}

    def chunks(at: int, end: int):
        while at + 8 <= end:
            kind, n = struct.unpack("<4sI", src.read(at, 8))
            stop = min(at + 8 + n, end)
            yield kind, at + 8, stop
            at = stop + (n & 1)

    def walk(at: int, end: int) -> None:
        stream = None
        for kind, s, e in chunks(at, end):
            if kind == b"LIST":
                name = src.read(s, 4)
                if name in (b"hdrl", b"strl", b"odml"):
                    walk(s + 4, e)
                elif name == b"movi":
                    return
            elif kind == b"avih" and e - s >= 40:
                b = src.read(s, 40)
                state["avih"] = struct.unpack_from("<I", b, 0)[0], struct.unpack_from("<I", b, 16)[0], *struct.unpack_from("<II", b, 32)
            elif kind == b"strh":
                stream = src.read(s, min(56, e - s))
            elif kind == b"strf" and stream is not None:
                avi_stream(stream, src.read(s, min(40, e - s)), state, out)
            elif kind == b"dmlh":
                state["frames"] = struct.unpack("<I", src.read(s, 4))[0]

    walk(12, src.size)
    if state["avih"] is None:
        raise FormatError("no main header")
    per_frame, frames, width, height = state["avih"]
    if not out["width"] and not out["height"]:
        out["width"], out["height"] = dim(width), dim(height)
    rate = state["strh"]
    by_stream = sane_ms(rate[0] * 1000 / rate[1]) if rate and rate[1] else 0
    out["duration_ms"] = by_stream or sane_ms((state["frames"] or frames) * per_frame / 1000)
    return out


def avi_stream(head: bytes, fmt: bytes, state: dict, out: dict) -> None:
    """One stream's header and format; those too short to tell are left out."""
    if len(head) < 36:
        return
    kind = head[:4]
    scale, rate, _, length = struct.unpack_from("<IIII", head, 20)
    if kind == b"vids" and not out["video_codec"] and len(fmt) >= 20:
        out["video_codec"] = fourcc(fmt[16:20])
        w, h = struct.unpack_from("<ii", fmt, 4)
        out["width"], out["height"] = dim(w), dim(abs(h))
        state["strh"] = (length * scale, rate)
    elif kind == b"auds" and len(fmt) >= 4:
        tag, n = struct.unpack_from("<HH", fmt)
        codec = WAV_TAGS.get(tag, "")
        out["audio"].append(track(codec, "", 6 if codec in ("ac3", "dts") and n == 5 else n))


# --- DVD title sets ---

# Offsets of the title set's attributes.
IFO_PGCI, IFO_VIDEO, IFO_AUDIO_COUNT, IFO_AUDIO, IFO_SUB_COUNT, IFO_SUB, IFO_HEADER, SECTOR = 0xCC, 0x200, 0x202, 0x204, 0x254, 0x256, 0x400, 2048
IFO_CODECS = {0: "ac3", 2: "mp2", 3: "mp2", 4: "pcm", 6: "dts"}


def bcd(b: int) -> int:
    if b >> 4 > 9 or b & 15 > 9:
        raise ValueError
    return (b >> 4) * 10 + (b & 15)


def dvd_time(b: bytes) -> int:
    """BCD hours, minutes, seconds and frames to ms; 0 if a digit is out of range."""
    try:
        h, m, s, n = bcd(b[0]), bcd(b[1]), bcd(b[2]), bcd(b[3] & 63)
    except ValueError:
        return 0
    rate = {1: 25.0, 3: 30000 / 1001}.get(b[3] >> 6)
    return ((h * 60 + m) * 60 + s) * 1000 + int(n * 1000 / rate) if rate and m < 60 and s < 60 else 0


def ifo(src: Source) -> dict:
    h = src.read(0, IFO_HEADER)
    if h[:12] != b"DVDVIDEO-VTS":
        raise FormatError("no title set")
    out, video = blank("dvd"), struct.unpack_from(">H", h, IFO_VIDEO)[0]
    size = video >> 2 & 3
    height = 576 if video >> 12 & 3 == 1 else 480
    out.update(video_codec="mpeg2", width=(720, 704, 352, 352)[size], height=height // 2 if size == 3 else height)
    two = lambda used, code: lang(code.decode("latin-1")) if used == 1 else ""
    for i in range(min(struct.unpack_from(">H", h, IFO_AUDIO_COUNT)[0], 8)):
        a = h[IFO_AUDIO + 8 * i : IFO_AUDIO + 8 * i + 8]
        out["audio"].append(track(IFO_CODECS.get(a[0] >> 5, ""), two(a[0] >> 2 & 3, a[2:4]), (a[1] & 7) + 1))
    for i in range(min(struct.unpack_from(">H", h, IFO_SUB_COUNT)[0], 32)):
        a = h[IFO_SUB + 6 * i : IFO_SUB + 6 * i + 6]
        out["subs"].append(track("vobsub", two(a[0] & 3, a[2:4]), 0))
    at = struct.unpack_from(">I", h, IFO_PGCI)[0] * SECTOR
    if at:
        n = min(struct.unpack(">H", src.read(at, 2))[0], 256)
        for i in range(n):
            off = struct.unpack(">I", src.read(at + 8 + 8 * i + 4, 4))[0]
            out["duration_ms"] = max(out["duration_ms"], dvd_time(src.read(at + off + 4, 4)))
    out["duration_ms"] = sane_ms(out["duration_ms"])
    return out


def reader_of(head: bytes):
    """The reader for a file's first 16 bytes, by magic and never by extension; None if no reader knows them."""
    if head[:4] == b"\x1aE\xdf\xa3":
        return "mkv", mkv
    if head[:4] == b"RIFF" and head[8:12] == b"AVI ":
        return "avi", avi
    if head[:12] == b"DVDVIDEO-VTS":
        return "ifo", ifo
    if head[4:8] in (b"ftyp", b"moov", b"mdat", b"free", b"skip", b"wide", b"pnot"):
        return "mp4", mp4
    return None


def probe(src: Source) -> dict:
    """One file's media row: prober, error ('' if read) and the fields."""
    found = reader_of(src.read(0, min(16, src.size)))
    if found is None:
        return blank("") | {"prober": "", "error": "unknown format"}
    try:
        return found[1](src) | {"prober": found[0], "error": ""}
    except (FormatError, struct.error, IndexError) as e:
        return blank("") | {"prober": found[0], "error": f"format: {e}"}


def probe_files(files: DataFrame) -> DataFrame:
    """files(path, size, mtime) to media rows. Files that can't be opened get no row: they are tried again."""

    def run(batches):
        for pdf in batches:
            rows = []
            for p, size, mtime in pdf[["path", "size", "mtime"]].itertuples(index=False):
                try:
                    with open(p, "rb") as f:
                        rows.append({"path": p, "size": size, "mtime": mtime, **probe(Source(f, size)), "probe_version": READER_VERSION, "with_ffprobe": False})
                except OSError:
                    continue
            yield pd.DataFrame(rows, columns=_COLUMNS)

    return files.select("path", "size", "mtime").mapInPandas(run, _SCHEMA)


_SCHEMA = f"path string, size long, mtime long, prober string, error string, container string, duration_ms long, width int, height int, video_codec string, audio array<{TRACK}>, subs array<{TRACK}>, probe_version int, with_ffprobe boolean"
_COLUMNS = ["path", "size", "mtime", "prober", "error", "container", "duration_ms", "width", "height", "video_codec", "audio", "subs", "probe_version", "with_ffprobe"]


def magic(head):
    """Reader by a binary column's first bytes, inside the JVM."""
    h = F.hex(head)
    return (
        F.when(h.startswith("1A45DFA3"), "mkv").when(h.startswith("52494646") & (F.substring(h, 17, 8) == "41564920"), "avi").when(h.startswith(b"DVDVIDEO-VTS".hex().upper()), "ifo")
        .when(F.substring(h, 9, 8).isin(*[x.encode().hex().upper() for x in ("ftyp", "moov", "mdat", "free", "skip", "wide", "pnot")]), "mp4").otherwise("")
    )
