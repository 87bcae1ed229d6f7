"""Items: one card a movie with all its versions, or one unidentified content."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions import media, text

NO_STRINGS = "cast(array() as array<string>)"


def version_key(fingerprint="fingerprint", vid="id"):
    return F.when(F.col(fingerprint) != "", F.col(fingerprint)).otherwise(F.concat(F.lit("id:"), F.col(vid).cast("string")))


def sub_langs():
    """Embedded, then external subtitle languages; known ones, each once."""
    inside = F.transform("subs", lambda s: s["lang"])
    return F.filter(F.array_distinct(F.concat(inside, F.split("sub_langs", ","))), lambda x: ~x.isin("", "?"))


def locations(dir_col: str, roots: list[str]):
    """[root, root/first folder] by the first root that holds the folder; a root's leading '../' isn't shown."""
    out = F.expr(NO_STRINGS)
    for r in reversed(roots):
        top = r.rstrip("/")
        label = top.removeprefix("../").lstrip("./") if top.startswith("../") else top
        rest = F.element_at(F.split(F.substring(F.col(dir_col), len(top) + 2, 1 << 30), "/"), 1)
        inside = F.col(dir_col).startswith(top + "/") & (rest != "")
        out = F.when(inside, F.array(F.lit(label), F.concat(F.lit(label + "/"), rest))).when(F.col(dir_col) == top, F.array(F.lit(label))).otherwise(out)
    return out


def routed(view: DataFrame) -> DataFrame:
    """Present versions with item_key: their movie's if it is stored, else that of their content. Ignored ones and extras belong to none."""
    kept = view.where("present and status not in ('ignored', 'extra')")
    return kept.withColumn("item_key", F.when(F.col("movie_stored"), text.ref_movie("movie_id")).otherwise(version_key()))


def distinct_in_order(rows: DataFrame, value: str, name: str) -> DataFrame:
    """item_key, distinct values of an array column over an item's versions, in order of first sight (by title, year, id)."""
    one = F.struct(text.ascii_lower("title").alias("t"), "year", "id", F.col(value).alias("v"))
    return rows.groupBy("item_key").agg(F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["v"]))).alias(name))


def build(view: DataFrame, movies: DataFrame, roots: list[str]) -> DataFrame:
    """The item rollup: sizes, dates, resolutions, subtitles, places, version and content counts, and the movie's attributes."""
    rows = routed(view).withColumns({"_bucket": media.bucket("resolution"), "_subs": sub_langs(), "_places": locations("dir", roots)})
    # contents: a version without fingerprint is one of its own
    copies = rows.groupBy("item_key", version_key().alias("_content")).agg(F.count("*").alias("n"), F.max(F.col("fingerprint") != "").alias("hashed"))
    contents = copies.groupBy("item_key").agg(F.count("*").alias("contents"), F.max(F.col("hashed") & (F.col("n") > 1)).alias("identical"))
    one = F.struct(text.ascii_lower("title").alias("t"), "year", "id", F.when(F.col("_bucket") != "", F.array("_bucket")).otherwise(F.expr(NO_STRINGS)).alias("r"), F.col("_subs").alias("s"), F.col("_places").alias("p"), "title", "fingerprint", "status", "candidates")
    rolled = rows.groupBy("item_key").agg(
        F.sum("size").alias("size"), F.coalesce(F.min(F.when(F.col("added") > 0, F.col("added"))), F.lit(0)).alias("added"), F.max_by("_bucket", media.bucket_rank("_bucket")).alias("resolution"),
        F.count("*").alias("versions"), F.max("movie_id").alias("_movie"), F.max("movie_stored").alias("_stored"), F.sort_array(F.collect_list(one)).alias("_v"),
    )
    each = lambda k: F.array_distinct(F.flatten(F.transform("_v", lambda x: x[k])))
    rolled = rolled.withColumns({"resolutions": each("r"), "subs": each("s"), "locations": each("p"), "_first": F.element_at("_v", 1)}).join(contents, "item_key")
    m = movies.select(F.col("tmdb_id").alias("_movie"), *[F.col(c).alias(f"m_{c}") for c in ("title", "original_title", "year", "original_lang", "directors", "genres", "countries", "collection_id", "collection", "cast", "poster_path", "backdrop_path")])
    out = rolled.join(m, "_movie", "left")
    own = lambda c, other: F.when(F.col("_stored"), F.col(f"m_{c}")).otherwise(other)
    unknown = F.col("_first.status").isin("none", "unmatched") | ~F.col("_stored")
    state = F.filter(F.array(F.when(unknown, "unidentified"), F.when(F.col("contents") > 1, "several-versions"), F.when(F.col("identical"), "identical-copy")), lambda x: x.isNotNull())
    persons = "cast(array() as array<struct<id:int,name:string>>)"
    return out.select(
        "item_key", F.when(F.col("_stored"), F.col("_movie")).otherwise(0).cast("int").alias("movie_id"), own("title", F.col("_first.title")).alias("title"), own("original_title", F.lit("")).alias("original_title"),
        own("year", F.col("_first.year")).cast("int").alias("year"), own("original_lang", F.lit("")).alias("original_lang"), own("directors", F.expr(persons)).alias("directors"), own("genres", F.expr(NO_STRINGS)).alias("genres"),
        own("countries", F.expr(NO_STRINGS)).alias("countries"), own("collection_id", F.lit(0)).alias("collection_id"), own("collection", F.lit("")).alias("collection"), own("cast", F.expr("cast(null as array<struct<id:int,name:string,character:string>>)")).alias("cast"),
        own("poster_path", F.lit("")).alias("poster_path"), own("backdrop_path", F.lit("")).alias("backdrop_path"), "size", "added", "resolution", "resolutions", "subs", "locations", "versions", "contents", "identical", state.alias("states"),
        F.array_distinct(F.filter(F.transform("_v", lambda x: x["title"]), lambda t: t != "")).alias("file_titles"), F.col("_first.fingerprint").alias("fingerprint"),
    )


def ref_targets(view: DataFrame, built: DataFrame) -> DataFrame:
    """ref, item_key: what a list entry may name. 'movie:' refs of stored movies' items, and 'fp:' refs of every routed content."""
    movies = built.where("movie_id > 0").select(text.ref_movie("movie_id").alias("ref"), "item_key")
    contents = routed(view).where("fingerprint <> ''").select(text.ref_fingerprint("fingerprint").alias("ref"), "item_key").distinct()
    return movies.unionByName(contents)


def memberships(view: DataFrame, built: DataFrame, entries: DataFrame) -> DataFrame:
    """item_key, list_id, added_at: the least date of all entries that lead to the item. Dangling refs vanish."""
    return entries.join(ref_targets(view, built), "ref").groupBy("item_key", "list_id").agg(F.min("added_at").alias("added_at"))


def with_lists(built: DataFrame, view: DataFrame, lists: DataFrame, entries: DataFrame) -> DataFrame:
    """Items with lists: array(id, name, added_at) by id."""
    m = memberships(view, built, entries).join(lists.select(F.col("id").alias("list_id"), "name"), "list_id")
    per = m.groupBy("item_key").agg(F.sort_array(F.collect_list(F.struct(F.col("list_id").alias("id"), "name", "added_at"))).alias("lists"))
    return built.join(per, "item_key", "left").withColumn("lists", F.coalesce("lists", F.expr("cast(array() as array<struct<id:bigint,name:string,added_at:bigint>>)")))


def item_ref(built: DataFrame, tmdb_id: int = 0, key: str = "") -> DataFrame:
    """The ref to add for an item: its movie's, else its content's."""
    one = built.where(F.col("movie_id") == tmdb_id) if tmdb_id else built.where(F.col("item_key") == key)
    return one.select(F.when(F.col("movie_id") > 0, text.ref_movie("movie_id")).when(F.col("fingerprint") != "", text.ref_fingerprint("fingerprint")).alias("ref")).where("ref is not null")


def refs_to(view: DataFrame, built: DataFrame, entries: DataFrame, list_id: int, tmdb_id: int = 0, key: str = "") -> DataFrame:
    """Refs of a list to remove with an item: the direct ref, those of the movie's identified versions (missing ones too), and all that lead to the same item."""
    mine = entries.where(F.col("list_id") == list_id).select("ref")
    item = F.concat(F.lit("movie:"), F.lit(str(tmdb_id))) if tmdb_id else F.lit(key)
    leading = ref_targets(view, built).where(F.col("item_key") == item).select("ref")
    direct = built.sparkSession.range(1).select((item if tmdb_id else F.concat(F.lit("fp:"), item)).alias("ref"))
    own = view.where((F.col("movie_id") == tmdb_id) & (F.lit(tmdb_id) > 0) & (F.col("fingerprint") != "")).select(text.ref_fingerprint("fingerprint").alias("ref"))
    return mine.join(leading.unionByName(direct).unionByName(own).distinct(), "ref", "left_semi").distinct()


def sort_columns(order: str = "year", direction: str | None = None, list_id: int | None = None) -> list:
    """Sort expressions: the key (year 0 last either way), then normal title and item key. Only titles rise by nature."""
    direction = direction or ("asc" if order == "title" else "desc")
    key = {
        "year": F.col("year"), "title": text.norm_title("title"), "added": F.col("added"), "size": F.col("size"),
        "list-added": F.coalesce(F.try_element_at(F.transform(F.filter("lists", lambda x: x["id"] == list_id), lambda x: x["added_at"]), F.lit(1)), F.lit(0)) if order == "list-added" else F.lit(0),
    }[order]
    head = [(F.col("year") == 0).asc()] if order == "year" else []
    return [*head, key.asc() if direction == "asc" else key.desc(), text.norm_title("title").asc(), F.col("item_key").asc()]


def sort(built: DataFrame, order: str = "year", direction: str | None = None, list_id: int | None = None) -> DataFrame:
    return built.orderBy(*sort_columns(order, direction, list_id))
