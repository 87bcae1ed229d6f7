"""Table schemas. Text and numbers use '' and 0 for unknown, never null; arrays may be empty."""

from __future__ import annotations

from pyspark.sql import types as T

TRACK = "struct<codec:string,lang:string,channels:int>"
PERSON = "struct<id:int,name:string>"
CANDIDATE = "struct<tmdb_id:int,title:string,original_title:string,year:int,poster_path:string,score:double>"

DDL = {
    "files": "path string, size long, mtime long, fingerprint string, kind string, missing boolean, version_id long, role string, part int, lang string, first_seen long",
    "versions": "id long, dir string, title string, year int, director string, countries string, resolution string, source string, codec string, language string, release_group string, imdb_id string, size long, parts int, sub_langs string",
    "media": f"path string, size long, mtime long, prober string, error string, container string, duration_ms long, width int, height int, video_codec string, audio array<{TRACK}>, subs array<{TRACK}>, probe_version int, with_ffprobe boolean",
    "movies": f"tmdb_id int, title string, original_title string, year int, runtime int, original_lang string, overview string, directors array<{PERSON}>, cast array<struct<id:int,name:string,character:string>>, genres array<string>, countries array<string>, collection_id int, collection string, poster_path string, backdrop_path string, imdb_id string, wikidata_id string, language string, fetched_at long, wikidata_state int",
    "identifications": f"fingerprint string, status string, tmdb_id int, confidence double, candidates array<{CANDIDATE}>, query string, matcher_version int, updated_at long",
    "part_links": "fingerprint string, leader string, created_at long",
    "lists": "id long, name string, created_at long, updated_at long",
    "list_entries": "list_id long, ref string, added_at long",
    "collection_folders": "path string, status string, list_id long, decided_at long",
    "collection_seen": "path string, fingerprint string",
}

KEYS = {
    "files": ["path"], "versions": ["id"], "media": ["path"], "movies": ["tmdb_id"], "identifications": ["fingerprint"], "part_links": ["fingerprint"],
    "lists": ["id"], "list_entries": ["list_id", "ref"], "collection_folders": ["path"], "collection_seen": ["path", "fingerprint"],
}

STATUSES = ("auto", "manual", "unmatched", "extra", "ignored")


def struct(name: str) -> T.StructType:
    return T._parse_datatype_string(DDL[name])


def empty(spark, name: str):
    return spark.createDataFrame([], struct(name))


def complete(df, name: str):
    """``df`` with every column of the table's schema, in order; absent ones get their sentinel."""
    from pyspark.sql import functions as F

    blank = {"string": "''", "boolean": "false", "double": "0D"}
    cols = []
    for f in struct(name).fields:
        kind = f.dataType.simpleString()
        default = F.expr(f"cast(array() as {kind})") if kind.startswith("array") else F.expr(f"cast({blank.get(kind, '0')} as {kind})")
        if f.name in ("version_id", "list_id") and name in ("files", "collection_folders"):
            default = F.lit(None).cast(kind)
        cols.append((F.col(f.name).cast(f.dataType) if f.name in df.columns else default).alias(f.name))
    return df.select(*cols)


def violations(df, name: str):
    """Keys that occur more than once: parquet doesn't enforce them, so this is the check."""
    from pyspark.sql import functions as F

    return df.groupBy(*KEYS[name]).agg(F.count("*").alias("n")).where("n > 1")
