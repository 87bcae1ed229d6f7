"""The version view: versions with their files, probe data, identity, movie and best flag. The base relation of all page queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions import media, text
from lumenframe.schema import TRACK

NO_TRACKS = f"cast(array() as array<{TRACK}>)"


def present_mains(files: DataFrame) -> DataFrame:
    return files.where("role = 'main' and not missing and version_id is not null")


def nested_files(files: DataFrame) -> DataFrame:
    """version_id, files (mains, subtitles, extras; by part and path) and added (least first_seen of present mains)."""
    rank = F.when(F.col("role") == "main", 0).when(F.col("role") == "subtitle", 1).otherwise(2)
    one = F.struct(rank.alias("rank"), "part", "path", "size", "mtime", "fingerprint", "kind", "missing", "role", "lang")
    seen = F.when((F.col("role") == "main") & ~F.col("missing"), F.col("first_seen"))
    return files.where("version_id is not null").groupBy("version_id").agg(F.sort_array(F.collect_list(one)).alias("files"), F.coalesce(F.min(seen), F.lit(0)).alias("added"))


def current_media(files: DataFrame, probes: DataFrame) -> DataFrame:
    """Probes of present mains that are still valid: same size and mtime, no error."""
    m = probes.where("error = ''").select("path", F.col("size").alias("_s"), F.col("mtime").alias("_m"), "duration_ms", "width", "height", "video_codec", "audio", "subs")
    f = present_mains(files).select("version_id", "path", "part", "kind", "size", "mtime")
    return f.join(m, "path").where("size = _s and mtime = _m").drop("_s", "_m", "size", "mtime")


def merged_media(files: DataFrame, probes: DataFrame) -> DataFrame:
    """Per version, in part order: first known frame and codec, summed duration, distinct tracks. A DVD keeps its longest title set (the first of equals)."""
    rows = current_media(files, probes)
    dvd = F.col("kind") == "dvd"
    w = Window.partitionBy("version_id").orderBy(F.col("duration_ms").desc(), "part", "path")
    kept = rows.withColumn("_n", F.when(dvd, F.row_number().over(w)).otherwise(1)).where("_n = 1")
    one = F.struct("part", "path", "duration_ms", "width", "height", "video_codec", "audio", "subs")
    out = kept.groupBy("version_id").agg(F.sort_array(F.collect_list(one)).alias("m"))
    first = lambda cond, get, none: F.coalesce(F.try_element_at(F.transform(F.filter("m", cond), get), F.lit(1)), F.lit(none))
    return out.select(
        "version_id", F.aggregate("m", F.lit(0).cast("long"), lambda a, x: a + x["duration_ms"]).alias("duration_ms"),
        first(lambda x: x["width"] > 0, lambda x: x["width"], 0).alias("width"), first(lambda x: x["width"] > 0, lambda x: x["height"], 0).alias("height"),
        first(lambda x: x["video_codec"] != "", lambda x: x["video_codec"], "").alias("video_codec"),
        F.array_distinct(F.flatten(F.transform("m", lambda x: x["audio"]))).alias("audio"), F.array_distinct(F.flatten(F.transform("m", lambda x: x["subs"]))).alias("subs"),
    )


def strict_durations(files: DataFrame, probes: DataFrame, dvd_strict: bool = True) -> DataFrame:
    """version_id, duration_ms: the sum only where every present main has a valid probe, else 0 (the matcher's rule). dvd_strict=False counts a DVD's probed title sets only."""
    mains = present_mains(files)
    if not dvd_strict:
        mains = mains.where("kind <> 'dvd' or upper(path) rlike '/VTS_[0-9][0-9]_0[.]IFO$'")
    n = mains.groupBy("version_id").agg(F.count("*").alias("mains"))
    rows = current_media(files, probes)
    total = F.when(F.max(F.col("kind") == "dvd"), F.max("duration_ms")).otherwise(F.sum("duration_ms"))
    valid = rows.groupBy("version_id").agg(F.count_if(F.col("duration_ms") > 0).alias("valid"), total.alias("total"))
    return n.join(valid, "version_id", "left").select("version_id", F.when(F.col("valid") == F.col("mains"), F.col("total")).otherwise(0).cast("long").alias("duration_ms"))


def representatives(files: DataFrame) -> DataFrame:
    """version_id, fingerprint, path of each version's representative: present hashed main of lowest part, largest size, lowest path."""
    order = F.struct("part", -F.col("size"), "path")
    pick = present_mains(files).where("fingerprint <> ''").groupBy("version_id").agg(F.min_by(F.struct("fingerprint", "path"), order).alias("r"))
    return pick.select("version_id", "r.fingerprint", "r.path")


def is_representative(files: DataFrame, fingerprint: str) -> DataFrame:
    return representatives(files).where(F.col("fingerprint") == fingerprint).limit(1)


def with_best(view: DataFrame) -> DataFrame:
    """best: of at least two present versions of a movie (or of a title and year), the first by resolution, codec and size, lowest id on ties."""
    key = F.when(F.col("movie_id") > 0, text.ref_movie("movie_id")).otherwise(text.group_key("title", "year"))
    inside = (F.col("_key") != "") & F.col("present")
    w = Window.partitionBy("_key", "_in")
    order = w.orderBy(media.resolution_rank("resolution").desc(), media.codec_rank("codec_name").desc(), F.col("size").desc(), "id")
    out = view.withColumn("_key", key).withColumn("_in", inside)
    # versions outside any group would all meet under one key: spread them
    out = out.withColumn("_key", F.when(F.col("_in"), F.col("_key")).otherwise(F.concat(F.lit("-"), F.col("id").cast("string"))))
    out = out.withColumn("best", F.col("_in") & (F.row_number().over(order) == 1) & (F.count("*").over(w) > 1))
    return out.drop("_key", "_in")


def version_view(files: DataFrame, versions: DataFrame, probes: DataFrame, identifications: DataFrame, movies: DataFrame, part_links: DataFrame | None = None) -> DataFrame:
    """One row a version with nested files, merged media, identity and flags.

    fingerprint: of the representative. status: of its identification, 'none' without one. movie_id: that of an auto or manual one."""
    rep = representatives(files).select(F.col("version_id").alias("id"), "fingerprint")
    ids = identifications.select("fingerprint", F.col("status").alias("_status"), F.col("tmdb_id").alias("_tmdb"), "confidence", "candidates")
    view = (
        versions.join(nested_files(files).withColumnRenamed("version_id", "id"), "id", "left")
        .join(merged_media(files, probes).withColumnRenamed("version_id", "id"), "id", "left").join(rep, "id", "left").join(ids, "fingerprint", "left")
    )
    empty = F.expr(NO_TRACKS)
    probed = F.col("width") > 0
    view = view.withColumns({
        "fingerprint": F.coalesce("fingerprint", F.lit("")), "status": F.coalesce("_status", F.lit("none")), "identified_id": F.coalesce("_tmdb", F.lit(0)),
        "duration_ms": F.coalesce("duration_ms", F.lit(0)), "audio": F.coalesce("audio", empty), "subs": F.coalesce("subs", empty), "video_codec": F.coalesce("video_codec", F.lit("")),
        "added": F.coalesce("added", F.lit(0)), "present": F.coalesce(F.exists("files", lambda f: (f["role"] == "main") & ~f["missing"]), F.lit(False)),
        "resolution": F.when(probed, media.frame_label("width", "height")).otherwise(F.col("resolution")),
    }).drop("_status", "_tmdb")
    view = view.withColumn("codec_name", F.when(F.col("video_codec") != "", F.col("video_codec")).otherwise(media.codec_from_name("codec")))
    view = view.withColumn("movie_id", F.when(F.col("status").isin("auto", "manual"), F.col("identified_id")).otherwise(0))
    m = movies.select(F.col("tmdb_id").alias("movie_id"), F.lit(True).alias("movie_stored"))
    view = view.join(m, "movie_id", "left").withColumn("movie_stored", F.coalesce("movie_stored", F.lit(False)))
    if part_links is not None:
        from lumenframe.operators.mutate import final_leaders

        leaders = final_leaders(part_links).select(F.col("leader").alias("fingerprint"), F.lit(True).alias("has_parts")).distinct()
        view = view.join(leaders, "fingerprint", "left").withColumn("has_parts", F.coalesce("has_parts", F.lit(False)))
    return with_best(view)


def ordered(view: DataFrame) -> DataFrame:
    """Catalog order: title without regard to ASCII case, year, id."""
    return view.orderBy(text.ascii_lower("title"), "year", "id")


def pending_probes(files: DataFrame, probes: DataFrame, reader_version: int = 1, has_tool: bool = False) -> DataFrame:
    """Files whose headers have to be read: never, changed, by an older reader, or failed without the tool that there is now."""
    dvd_ok = (F.col("kind") != "dvd") | F.upper("path").rlike(r"/VTS_[0-9][0-9]_0\.IFO$")
    f = present_mains(files).where(F.col("kind").isin("video", "dvd") & dvd_ok).select("path", "size", "mtime", "kind")
    m = probes.select("path", F.col("size").alias("_s"), F.col("mtime").alias("_m"), F.col("probe_version").alias("_v"), F.col("error").alias("_e"), F.col("with_ffprobe").alias("_t"))
    again = F.col("_s").isNull() | (F.col("_s") != F.col("size")) | (F.col("_m") != F.col("mtime")) | (F.col("_v") < reader_version) | ((F.col("_e") != "") & ~F.col("_t") & F.lit(has_tool))
    return f.join(m, "path", "left").where(again).select("path", "size", "mtime", "kind")


def identify_targets(files: DataFrame, versions: DataFrame, probes: DataFrame, identifications: DataFrame, infos: DataFrame | None = None) -> DataFrame:
    """One row a distinct representative fingerprint (its lowest version id): version, current identification, minutes, info files that apply.

    infos: files of kind 'info' (path). In a folder of several versions only those apply whose stem begins the representative's."""
    reps = representatives(files).withColumnRenamed("version_id", "id").withColumnRenamed("path", "rep_path")
    w = Window.partitionBy("fingerprint").orderBy("id")
    firsts = reps.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    out = firsts.join(versions, "id").join(strict_durations(files, probes).withColumnRenamed("version_id", "id"), "id", "left")
    out = out.withColumn("minutes", F.floor((F.coalesce("duration_ms", F.lit(0)) + 30000) / 60000).cast("int"))
    out = out.join(identifications.select("fingerprint", F.col("status").alias("current_status"), F.col("query").alias("current_query"), F.col("matcher_version").alias("current_version")), "fingerprint", "left")
    if infos is not None:
        shared = versions.groupBy("dir").agg(F.count("*").alias("_versions"))
        per = infos.select(F.regexp_extract("path", "^(.*)/", 1).alias("dir"), "path").groupBy("dir").agg(F.sort_array(F.collect_list("path")).alias("_infos"))
        out = out.join(shared, "dir", "left").join(per, "dir", "left")
        fits = F.filter("_infos", lambda p: F.lower(text.stem("rep_path")).startswith(F.lower(F.regexp_replace(F.element_at(F.split(p, "/"), -1), r"\.[^.]*$", ""))))
        out = out.withColumn("nfos", F.coalesce(F.when(F.col("_versions") == 1, F.col("_infos")).otherwise(fits), F.expr("cast(array() as array<string>)"))).drop("_versions", "_infos")
    return out


def movies_to_enrich(files: DataFrame, identifications: DataFrame, movies: DataFrame, lang: str) -> DataFrame:
    """Ids of movies that present files refer to and that aren't stored, or are in another language."""
    present = files.where("not missing and fingerprint <> ''").select("fingerprint")
    ids = identifications.where("status in ('auto','manual') and tmdb_id > 0").join(present, "fingerprint", "left_semi").select("tmdb_id").distinct()
    m = movies.select("tmdb_id", F.col("language").alias("_l"))
    return ids.join(m, "tmdb_id", "left").where(F.col("_l").isNull() | (F.col("_l") != lang)).select("tmdb_id")


def pending_wikidata(movies: DataFrame, limit: int = 50) -> DataFrame:
    return movies.where("wikidata_state = 0").orderBy("tmdb_id").limit(limit)


def movie(movies: DataFrame, tmdb_id: int) -> DataFrame:
    return movies.where(F.col("tmdb_id") == tmdb_id)


def has_file(files: DataFrame, path: str) -> DataFrame:
    return files.where((F.col("path") == path) & ~F.col("missing")).limit(1)


def duplicate_files(files: DataFrame) -> DataFrame:
    """fingerprint, size, paths of present files whose content occurs more than once, largest first."""
    out = files.where("not missing and fingerprint <> ''").groupBy("fingerprint").agg(F.max("size").alias("size"), F.sort_array(F.collect_list("path")).alias("paths"))
    return out.where(F.size("paths") > 1).orderBy(F.desc("size"), "fingerprint")
