"""Files of a folder to versions: parts, subtitles and extras. One folder is one group of one Arrow function."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.functions import names
from lumenframe.functions.media import SUBTITLE_LANGUAGES, SUBTITLE_QUALIFIERS
from lumenframe.functions.text import base_name, parent

# Patterns and folder names.
PART = re.compile(r"(?i)[\s._\-(\[]*(?a:\b)(?:part|pt|cd|disc|disk|parte)[\s._\-]*(\d{1,2})(?a:\b)[)\]]?")
EXTRA = re.compile(r"(?i)(?a:\b)(?:bonus|extras?|featurettes?|trailer|sample|making[\s._-]?of|behind[\s._-]the[\s._-]scenes|deleted[\s._-]scenes)(?a:\b)")
EXTRA_DIRS = ("extras", "extra", "bonus", "featurettes", "special features")
SUBTITLE_DIRS = ("subs", "subtitles", "subtitulos", "subtítulos")
SMALL_SHARE = 15  # a video under this percentage of the largest is an extra

MEMBER = "struct<path:string,role:string,part:int,lang:string>"
SCHEMA = "dir string, title string, year int, director string, countries string, resolution string, source string, codec string, language string, release_group string, imdb_id string, size long, parts int, sub_langs string, members array<" + MEMBER + ">"


def owner_dir(path):
    """Folder that owns a file: its own, or the one above for VIDEO_TS, extras and subtitle folders."""
    d = parent(path)
    return F.when(F.lower(base_name(d)).isin("video_ts", *EXTRA_DIRS, *SUBTITLE_DIRS), parent(d)).otherwise(d)


def stem(path: str) -> str:
    name = path.rpartition("/")[2]
    return name[: name.rfind(".")] if "." in name else name


def split_part(name: str) -> tuple[str, str, int]:
    """(name without its part marker, what stands before the marker, part number or 0)."""
    m = PART.search(name)
    if not m:
        return name, "", 0
    return (name[: m.start()] + name[m.end() :]).strip(), name[: m.start()].strip(" ._-([").strip(), int(m[1])


def marked_extra(path: str) -> bool:
    """Whether the folder or the name says that a video is an extra."""
    folder = path.rpartition("/")[0].rpartition("/")[2]
    return folder.lower() in EXTRA_DIRS or bool(EXTRA.search(stem(path)))


def part_sets(videos: list[tuple]) -> dict[str, bool]:
    """Prefix (lower case) of each set of parts of one film -> whether the names differ after the marker.

    A set has at least two part numbers and none twice (twice: several rips, which stay apart); names that differ after
    the marker must not give different years (those are sequels)."""
    seen: dict[tuple[str, str], list] = {}
    for path, _, _ in videos:
        if marked_extra(path):
            continue
        base, prefix, part = split_part(stem(path))
        if part:
            seen.setdefault(prefix.lower(), []).append((part, base.lower(), names.parse(base)["year"]))
    out = {}
    for prefix, rows in seen.items():
        numbers = [r[0] for r in rows]
        varying = len({r[1] for r in rows}) > 1
        if len(set(numbers)) >= 2 and len(set(numbers)) == len(numbers) and (not varying or (prefix and len({r[2] for r in rows if r[2]}) <= 1)):
            out[prefix] = varying
    return out


def subtitle_language(name: str) -> str:
    tokens = [t for t in re.split(r"[\s._\-\[\]()]+", name.lower()) if t and t not in SUBTITLE_QUALIFIERS]
    return SUBTITLE_LANGUAGES.get(tokens[-1], "") if tokens else ""


def build_dir(folder: str, files: list[tuple[str, int, str]], is_root: bool) -> list[dict]:
    """Versions of one folder. files: (path, size, kind)."""
    files = sorted(files)
    videos = [f for f in files if f[2] == "video"]
    sets, largest = part_sets(videos), max((f[1] for f in videos), default=0)
    versions: dict[str, dict] = {}
    extras = []

    def version(key: str, base: str, title_from: str) -> dict:
        return versions.setdefault(key, {"base": base.lower(), "from": title_from, "mains": [], "others": [], "dvd": False})

    for path, size, kind in files:
        if kind == "dvd":
            v = version("\0dvd", "", "")
            v["dvd"] = True
            v["mains"].append((path, size, 0))
        elif kind == "video":
            base, prefix, part = split_part(stem(path))
            in_set = bool(part) and prefix.lower() in sets
            if marked_extra(path) or (not in_set and size * 100 < largest * SMALL_SHARE):
                extras.append(path)
                continue
            if in_set and sets[prefix.lower()]:
                base = prefix
            key = base.lower() if part else f"{base.lower()}|{path.rpartition('.')[2].lower()}"
            version(key, base, base)["mains"].append((path, size, part))
    if not versions:
        return []
    order = list(versions.values())
    size_of = lambda v: sum(m[1] for m in v["mains"])
    biggest = max(order, key=size_of)  # the first of equals
    for path, _, kind in files:
        if kind in ("subtitle", "info"):
            low = stem(path).lower()
            fitting = [v for v in order if v["base"] and low.startswith(v["base"])]
            owner = max(fitting, key=lambda v: len(v["base"])) if fitting else order[0] if len(order) == 1 else biggest
            if kind == "subtitle":
                owner["others"].append((path, "subtitle", subtitle_language(stem(path)) or "?"))
    for path in extras:
        (order[0] if len(order) == 1 else biggest)["others"].append((path, "extra", ""))
    out = []
    for v in order:
        parsed = names.parse(v["from"]) if v["from"] else None
        above = names.parse(folder.rpartition("/")[2]) if not is_root else None
        if parsed is None:
            parsed = above or names.parse(folder.rpartition("/")[2])
        elif above is not None and len(order) == 1:
            parsed = merged(parsed, above)
        members = [{"path": p, "role": "main", "part": n, "lang": ""} for p, _, n in v["mains"]]
        members += [{"path": p, "role": r, "part": 0, "lang": "" if x == "?" else x} for p, r, x in v["others"]]
        rank = {"main": 0, "subtitle": 1, "extra": 2}
        members.sort(key=lambda m: (rank[m["role"]], m["part"], m["path"]))
        langs = sorted({x for _, r, x in v["others"] if r == "subtitle"})
        out.append({"dir": folder, **parsed, "countries": ", ".join(parsed["countries"]), "size": size_of(v), "parts": 1 if v["dvd"] else len(v["mains"]), "sub_langs": ",".join(langs), "members": members})
    return out


def merged(a: dict, b: dict) -> dict:
    """The more informative of two parses, its blanks filled from the other."""
    tells = lambda p: 2 * (p["year"] > 0) + (p["director"] != "")
    one, two = (b, a) if tells(b) > tells(a) else (a, b)
    return {k: v if v else two[k] for k, v in one.items()}


def build(entries: DataFrame, roots: list[str]) -> DataFrame:
    """entries(path, size, kind) to versions with their members. roots: folders whose own name isn't a title."""
    top = [r.rstrip("/") for r in roots]

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = build_dir(key[0], list(pdf[["path", "size", "kind"]].itertuples(index=False, name=None)), key[0] in top)
        return pd.DataFrame(rows, columns=["dir", *names.FIELDS, "size", "parts", "sub_langs", "members"]) if rows else pd.DataFrame({c: [] for c in ["dir", *names.FIELDS, "size", "parts", "sub_langs", "members"]})

    kept = entries.where(F.col("kind").isin("video", "dvd", "subtitle", "info"))
    return kept.withColumn("dir", owner_dir("path")).groupBy("dir").applyInPandas(run, SCHEMA)


def numbered(versions: DataFrame) -> DataFrame:
    """Ids in order of folder and first member's path: the lowest id wins ties everywhere."""
    from pyspark.sql import Window

    # a running number over all rows needs one order: ids are per-folder ranks on top of folder offsets
    first = F.col("members")[0]["path"]
    ranked = versions.withColumn("_p", first).withColumn("_r", F.row_number().over(Window.partitionBy("dir").orderBy("_p")))
    counts = ranked.groupBy("dir").agg(F.count("*").alias("_n"))
    bucketed = counts.withColumn("_b", F.substring("dir", 1, 12))
    inside = bucketed.withColumn("_in", F.coalesce(F.sum("_n").over(Window.partitionBy("_b").orderBy("dir").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    per = bucketed.groupBy("_b").agg(F.sum("_n").alias("_s"))
    before = per.withColumn("_off", F.coalesce(F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_b", "_off")
    offsets = inside.join(before, "_b").select("dir", (F.col("_in") + F.col("_off")).alias("_start"))
    return ranked.join(offsets, "dir").withColumn("id", (F.col("_start") + F.col("_r")).cast("long")).drop("_p", "_r", "_start")
