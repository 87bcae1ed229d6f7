"""The driver's tables in the roles of the catalog's. Column roles are stated at each view; every view covers its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe import schema
from lumenframe.functions import media

RESOLUTIONS = {"R": "1080p", "A": "720p", "N": "SD"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def movies(spark, d) -> DataFrame:
    """part: title p_name, year 1950 + p_size, director p_brand (id: its number), genre p_type."""
    p = table(spark, d, "part")
    person = F.struct(F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int").alias("id"), F.col("p_brand").alias("name"))
    return schema.complete(p.select(F.col("p_partkey").cast("int").alias("tmdb_id"), F.col("p_name").alias("title"), F.col("p_name").alias("original_title"), (F.col("p_size") + 1950).cast("int").alias("year"), F.array(person).alias("directors"), F.array("p_type").alias("genres"), F.lit("en").alias("original_lang"), F.concat(F.lit("/p"), F.col("p_partkey").cast("string"), F.lit(".jpg")).alias("backdrop_path")), "movies")


def items(spark, d) -> DataFrame:
    """part as items: size in cents, added by key; one version each."""
    m = movies(spark, d)
    p = table(spark, d, "part").select(F.col("p_partkey").cast("int").alias("tmdb_id"), (F.col("p_retailprice") * 100).cast("long").alias("size"))
    strings = lambda *x: F.array(*[F.lit(v) for v in x]) if x else F.expr("cast(array() as array<string>)")
    return m.join(p, "tmdb_id").select(
        F.concat(F.lit("movie:"), F.col("tmdb_id").cast("string")).alias("item_key"), F.col("tmdb_id").alias("movie_id"), "title", "original_title", "year", "original_lang", "directors", "genres", "countries", "collection_id", "collection", "cast",
        "poster_path", "backdrop_path", "size", F.col("tmdb_id").cast("long").alias("added"), F.lit("").alias("resolution"), strings().alias("resolutions"), strings().alias("subs"), strings().alias("locations"), F.lit(1).cast("long").alias("versions"),
        F.lit(1).cast("long").alias("contents"), F.lit(False).alias("identical"), strings().alias("states"), strings().alias("file_titles"), F.lit("").alias("fingerprint"), F.expr("cast(array() as array<struct<id:bigint,name:string,added_at:bigint>>)").alias("lists"),
    )


def view(spark, d) -> DataFrame:
    """lineitem as the version view: movie l_partkey, content (part, supplier), size l_quantity, resolution by l_returnflag, missing where l_linestatus is O, added the ship day."""
    rows = table(spark, d, "lineitem")
    vid = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    return rows.select(
        vid.cast("long").alias("id"), F.concat(F.lit("../cine/"), F.col("l_returnflag")).alias("dir"), F.lit("t").alias("title"), F.lit(0).alias("year"), media.lookup(RESOLUTIONS, F.col("l_returnflag")).alias("resolution"),
        F.lit("h264").alias("codec_name"), F.col("l_quantity").cast("long").alias("size"), F.concat_ws("-", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("fingerprint"), F.lit("auto").alias("status"),
        F.col("l_partkey").cast("int").alias("movie_id"), F.col("l_partkey").cast("int").alias("identified_id"), F.lit(True).alias("movie_stored"), (F.col("l_linestatus") == "F").alias("present"), F.lit("").alias("sub_langs"),
        F.expr(f"cast(array() as array<{schema.TRACK}>)").alias("subs"), F.unix_date(F.col("l_shipdate").cast("date")).cast("long").alias("added"), F.expr(f"cast(array() as array<{schema.CANDIDATE}>)").alias("candidates"), F.lit(False).alias("best"),
    )


def files(spark, d) -> DataFrame:
    """documents: path source/lang/doc<id>.mkv, size n_chars, content by SHA-256 of the text, first_seen doc_id."""
    docs = table(spark, d, "documents")
    path = F.concat_ws("/", "source", F.coalesce("lang", F.lit("-")), F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".mkv")))
    fp = F.when(F.coalesce("text", F.lit("")) == "", "").otherwise(F.substring(F.sha2(F.col("text"), 256), 1, 32))
    return docs.select(path.alias("path"), F.col("n_chars").alias("size"), F.col("doc_id").alias("mtime"), fp.alias("fingerprint"), F.lit("video").alias("kind"), F.lit(False).alias("missing"), F.col("doc_id").alias("version_id"), F.lit("main").alias("role"), F.lit(0).alias("part"), F.lit("").alias("lang"), F.col("doc_id").alias("first_seen"))


def identifications(spark, d) -> DataFrame:
    """labels of a content's least document: toxic is ignored, good quality auto, else unmatched."""
    l = table(spark, d, "labels")
    f = files(spark, d).where("fingerprint <> ''").groupBy("fingerprint").agg(F.min("version_id").alias("doc_id"))
    status = F.when(F.col("toxic") == 1, "ignored").when(F.col("quality") == 1, "auto").otherwise("unmatched")
    return schema.complete(f.join(l, "doc_id").select("fingerprint", status.alias("status"), F.when(status == "auto", F.col("doc_id")).otherwise(0).cast("int").alias("tmdb_id")), "identifications")


def list_entries(spark, d) -> DataFrame:
    """events: list event_type (numbered by name), entry 'movie:' user_id, date the second of ts."""
    kinds = {"click": 1, "error": 2, "purchase": 3, "signup": 4, "view": 5}
    return table(spark, d, "events").select(media.lookup(kinds, F.col("event_type")).cast("long").alias("list_id"), F.concat(F.lit("movie:"), F.col("user_id").cast("string")).alias("ref"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("added_at"))
