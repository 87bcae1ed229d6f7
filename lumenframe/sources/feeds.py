"""Recorded remote data as tables: movie details, translations, SPARQL bindings, probe output."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.functions import media

# Order of regional variants.
VARIANTS = {"es": ("es-MX", "es-ES"), "pt": ("pt-BR", "pt-PT"), "en": ("en-US", "en-GB")}


def directors_of(crew):
    """Directors of a crew array(id, name, job): distinct by id, in order."""
    only = F.filter(crew, lambda c: c["job"] == "Director")
    return F.aggregate(
        only, F.expr("cast(array() as array<struct<id:int,name:string>>)"),
        lambda acc, c: F.when(F.exists(acc, lambda x: x["id"] == c["id"]), acc).otherwise(F.array_append(acc, F.struct(c["id"].cast("int").alias("id"), c["name"].alias("name")))),
    )


def movies_from(details: DataFrame, lang: str) -> DataFrame:
    """details(id, title, original_title, release_date, runtime, original_language, overview, crew, cast, genres, countries, ...) as movie rows; cast: first ten by billing."""
    billed = F.slice(F.array_sort("cast", lambda a, b: a["order"] - b["order"]), 1, 10)
    opt = lambda c, d: F.col(c) if c in details.columns else F.lit(d)
    return details.select(
        F.col("id").cast("int").alias("tmdb_id"), "title", "original_title", media.year_of("release_date").alias("year"), F.coalesce("runtime", F.lit(0)).cast("int").alias("runtime"),
        F.col("original_language").alias("original_lang"), "overview", directors_of(F.col("crew")).alias("directors"),
        F.transform(billed, lambda c: F.struct(c["id"].cast("int").alias("id"), c["name"].alias("name"), c["character"].alias("character"))).alias("cast"),
        F.transform("genres", lambda g: g["name"]).alias("genres"), F.transform("countries", lambda c: c["iso"]).alias("countries"),
        opt("collection_id", 0).cast("int").alias("collection_id"), opt("collection", "").alias("collection"), opt("poster_path", "").alias("poster_path"),
        opt("backdrop_path", "").alias("backdrop_path"), opt("imdb_id", "").alias("imdb_id"), F.lit(lang).alias("language"),
    )


def chain_rank(lang_tag, lang: str):
    """0 for the language itself, then its regional variants in order, then any other variant; English after all of them."""
    known = VARIANTS.get(lang, ())
    out = F.when(lang_tag == lang, 0)
    for i, v in enumerate(known):
        out = out.when(lang_tag == v, 1 + i)
    out = out.when(lang_tag.startswith(lang + "-"), 10)
    if lang != "en":
        out = out.when(lang_tag == "en", 20).when(lang_tag.startswith("en-"), 21)
    return out


def translated(movies: DataFrame, translations: DataFrame, lang: str) -> DataFrame:
    """Titles and overviews in the language, each from the first of the chain that isn't empty. translations: tmdb_id, lang, title, overview."""
    rank = chain_rank(F.col("lang"), lang)
    rows = translations.withColumn("_r", rank).where("_r is not null")
    pick = lambda c: F.min_by(F.col(c), F.when(F.col(c) != "", F.struct("_r", "lang"))).alias(f"_{c}")
    best = rows.groupBy("tmdb_id").agg(pick("title"), pick("overview"))
    use = lambda c: F.coalesce(F.when(F.col(f"_{c}") != "", F.col(f"_{c}")), F.col(c))
    return movies.join(best, "tmdb_id", "left").withColumn("title", use("title")).withColumn("overview", use("overview")).drop("_title", "_overview")


def entities(bindings: DataFrame) -> DataFrame:
    """SPARQL bindings (tmdb, item, imdb, country, director, date) to one row an id: sorted country and director sets, first year after 1800."""
    label = F.col("director")
    year = F.try_element_at(F.split("date", "-"), F.lit(1)).try_cast("int")
    country = F.upper("country")
    return bindings.where("tmdb rlike '^[0-9]+$'").groupBy(F.col("tmdb").cast("int").alias("tmdb_id")).agg(
        F.min(F.element_at(F.split("item", "/"), -1)).alias("wikidata_id"), F.coalesce(F.min(F.when(F.col("imdb") != "", F.col("imdb"))), F.lit("")).alias("imdb_id"),
        F.sort_array(F.collect_set(F.when(country.rlike("^[A-Z]{2}$"), country))).alias("countries"), F.sort_array(F.collect_set(F.when((label != "") & ~label.rlike("^Q[0-9]+$"), label))).alias("directors"),
        F.coalesce(F.min(F.when(year > 1800, year)), F.lit(0)).alias("year"),
    )


def bindings_of(raw: DataFrame) -> DataFrame:
    """Rows of a recorded SPARQL JSON answer (results.bindings)."""
    b = raw.select(F.explode("results.bindings").alias("b"))
    have = set(b.schema["b"].dataType.names)
    get = lambda n: F.coalesce(F.col(f"b.{n}.value"), F.lit("")) if n in have else F.lit("")
    return b.select(get("tmdb").alias("tmdb"), get("item").alias("item"), get("imdb").alias("imdb"), get("countryIso").alias("country"), get("directorLabel").alias("director"), get("date").alias("date"))


def filled(movies: DataFrame, facts: DataFrame) -> DataFrame:
    """Blanks of movies from entities: imdb id, countries, directors (with id 0) and year, only where empty."""
    e = facts.select("tmdb_id", *[F.col(c).alias(f"_{c}") for c in ("wikidata_id", "imdb_id", "countries", "directors", "year")])
    blank = lambda c: (F.size(c) == 0) if c in ("countries", "directors") else (F.col(c) == 0) if c == "year" else (F.col(c) == "")
    people = F.transform("_directors", lambda d: F.struct(F.lit(0).alias("id"), d.alias("name")))
    new = {"imdb_id": F.col("_imdb_id"), "countries": F.col("_countries"), "directors": people, "year": F.col("_year")}
    out = movies.join(e, "tmdb_id", "left")
    for c, v in new.items():
        out = out.withColumn(c, F.when(blank(c) & v.isNotNull(), v).otherwise(F.col(c)))
    return out.withColumn("wikidata_id", F.coalesce(F.col("_wikidata_id"), F.col("wikidata_id") if "wikidata_id" in movies.columns else F.lit(""))).drop("_wikidata_id", "_imdb_id", "_countries", "_directors", "_year")


PROBE_JSON = "format struct<format_name:string,duration:string>, streams array<struct<codec_type:string,codec_name:string,width:int,height:int,channels:int,tags:struct<language:string>,disposition:struct<attached_pic:int>>>"


def probed(rows: DataFrame, column: str = "json") -> DataFrame:
    """Recorded output of the probing tool (JSON text) to container, duration_ms, width, height, video_codec, audio, subs; attached pictures are skipped."""
    j = F.from_json(column, PROBE_JSON)
    s = F.filter(F.coalesce(F.col("_j.streams"), F.expr("cast(array() as array<struct<codec_type:string,codec_name:string,width:int,height:int,channels:int,tags:struct<language:string>,disposition:struct<attached_pic:int>>>)")), lambda x: F.coalesce(x["disposition"]["attached_pic"], F.lit(0)) == 0)
    video = F.try_element_at(F.filter(F.col("_s"), lambda x: x["codec_type"] == "video"), F.lit(1))
    tracks = lambda kind: F.transform(F.filter(F.col("_s"), lambda x: x["codec_type"] == kind), lambda x: F.struct(media.ff_codec(x["codec_name"]).alias("codec"), media.language(F.coalesce(x["tags"]["language"], F.lit(""))).alias("lang"), media.sane_channels(F.coalesce(x["channels"], F.lit(0))).cast("int").alias("channels")))
    return rows.withColumn("_j", j).withColumn("_s", s).select(
        *rows.columns, F.coalesce(F.element_at(F.split("_j.format.format_name", ","), 1), F.lit("")).alias("container"), F.coalesce(media.sane_ms(F.col("_j.format.duration").try_cast("double") * 1000), F.lit(0)).alias("duration_ms"),
        F.coalesce(media.sane_dim(video["width"]), F.lit(0)).alias("width"), F.coalesce(media.sane_dim(video["height"]), F.lit(0)).alias("height"),
        F.coalesce(media.ff_codec(video["codec_name"]), F.lit("")).alias("video_codec"), tracks("audio").alias("audio"), tracks("subtitle").alias("subs"),
    )
