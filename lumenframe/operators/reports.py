"""Page queries on items and versions: duplicates, details, collections, lists, unidentified, suggestions, home."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions import media, text
from lumenframe.operators import items as it

ROW_ITEMS, LIST_ROWS, LIST_LEAST = 20, 2, 3
LEAST = {"random": 6, "decade": 6, "director": 3, "country": 6, "genre": 6, "collection": 2}
PREVIEW = 8


def copy_counts(view: DataFrame) -> DataFrame:
    return view.where("present and fingerprint <> ''").groupBy("fingerprint").agg(F.count("*").alias("copies"))


def cards(view: DataFrame) -> DataFrame:
    """Versions in card order: best, present, resolution, size; then catalog order."""
    return view.orderBy(F.desc("best"), F.desc("present"), media.resolution_rank("resolution").desc(), F.desc("size"), text.ascii_lower("title"), "year", "id")


def duplicates(view: DataFrame, built: DataFrame) -> DataFrame:
    """Items with identical copies or several contents: item_key, title, identical, several, reclaimable, versions.

    Kept is the last best version, else the first of the largest. Reclaimable: every further copy of a content, and
    every content other than the kept one. Sorted by reclaimable bytes, then title."""
    rows = it.routed(view).withColumn("_content", it.version_key()).withColumn("_ord", F.struct(text.ascii_lower("title").alias("t"), "year", "id"))
    w = Window.partitionBy("item_key", "_content").orderBy("_ord")
    best_last = Window.partitionBy("item_key").orderBy(F.desc("best"), F.when(F.col("best"), F.col("_ord")).desc_nulls_last(), F.desc("size"), F.col("_ord"))
    rows = rows.withColumn("_copy", F.row_number().over(w)).withColumn("_kept", F.first("_content").over(best_last))
    free = F.when((F.col("_copy") > 1) | (F.col("_content") != F.col("_kept")), F.col("size")).otherwise(0)
    card = F.struct((~F.col("best")).alias("b"), (-F.col("size")).alias("s"), "_ord", "id", "dir", "size", "fingerprint", "resolution")
    out = rows.groupBy("item_key").agg(F.sum(free).alias("reclaimable"), F.sort_array(F.collect_list(card)).alias("versions"))
    heads = built.where("identical or contents > 1").select("item_key", "title", "identical", (F.col("contents") > 1).alias("several"))
    return out.join(heads, "item_key").orderBy(F.desc("reclaimable"), text.norm_title("title"), "item_key")


def reclaimable_total(report: DataFrame) -> DataFrame:
    return report.agg(F.coalesce(F.sum("reclaimable"), F.lit(0)).alias("total"))


def movie_page(view: DataFrame, movies: DataFrame, tmdb_id: int) -> tuple[DataFrame, DataFrame]:
    """(the movie, cards of its versions with their extras, and the number of copies of each)."""
    versions = view.where((F.col("movie_id") == tmdb_id) | ((F.col("status") == "extra") & (F.col("identified_id") == tmdb_id)))
    return movies.where(F.col("tmdb_id") == tmdb_id), cards(versions.join(copy_counts(view), "fingerprint", "left"))


def version_page(view: DataFrame, key: str) -> DataFrame:
    """All versions of a content, by fingerprint or 'id:<n>'."""
    return cards(view.where(it.version_key() == key).join(copy_counts(view), "fingerprint", "left"))


def unidentified(view: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(number of contents that wait for a first match, contents that were left unmatched), one row a content in catalog order."""
    w = Window.partitionBy("fingerprint").orderBy(text.ascii_lower("title"), "year", "id")
    firsts = view.where("present and fingerprint <> ''").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return firsts.agg(F.count_if(F.col("status") == "none").alias("pending")), firsts.where("status = 'unmatched'").orderBy(text.ascii_lower("title"), "year", "id")


def suggestions(movies: DataFrame, view: DataFrame, q: str, near: str = "", limit: int = 20) -> DataFrame:
    """Movies whose title or original title contains q, those with a version in the same folder first, then in its parent, then others."""
    want = text.norm_title(F.lit(q))
    parent = near.rpartition("/")[0]
    closeness = F.when(F.col("dir") == near, 0).when((F.col("dir") == parent) | F.col("dir").startswith(parent + "/") & (F.lit(parent) != ""), 1).otherwise(2)
    close = view.where("movie_id > 0").groupBy(F.col("movie_id").alias("tmdb_id")).agg(F.min(closeness).alias("near"))
    hits = movies.where((want != "") & (F.contains(text.norm_title("title"), want) | F.contains(text.norm_title("original_title"), want)))
    return hits.join(close, "tmdb_id", "left").withColumn("near", F.coalesce("near", F.lit(2))).orderBy("near", text.norm_title("title"), "tmdb_id").limit(limit)


def collection_path(dir_col: str):
    """The path through the child of the first folder named 'collections' (any case), null if there is none."""
    parts = F.split(F.col(dir_col), "/")
    at = F.array_position(F.transform(parts, lambda x: F.lower(x)), "collections")
    return F.when((at > 0) & (F.size(parts) > at), F.array_join(F.slice(parts, F.lit(1), (at + 1).cast("int")), "/"))


def collections(view: DataFrame, decisions: DataFrame, seen: DataFrame, lists: DataFrame) -> DataFrame:
    """Collection folders to offer: path, total and new contents, preview of up to eight items; dismissed ones, and those imported into a list that is gone, aren't."""
    rows = view.where("present and fingerprint <> '' and status not in ('extra', 'ignored')").withColumn("path", collection_path("dir")).where("path is not null")
    rows = rows.withColumn("item_key", F.when(F.col("movie_stored"), text.ref_movie("movie_id")).otherwise(F.col("fingerprint")))
    d = decisions.join(lists.select(F.col("id").alias("list_id"), F.lit(True).alias("_there")), "list_id", "left").select("path", F.col("status").alias("decision"), "list_id", "_there")
    rows = rows.join(d, "path", "left").where("decision is null or (decision <> 'dismissed' and _there)")
    fresh = seen.select("path", "fingerprint", F.lit(1).alias("_seen"))
    rows = rows.join(fresh.distinct(), ["path", "fingerprint"], "left")
    w = Window.partitionBy("path", "item_key").orderBy(text.ascii_lower("title"), "year", "id")
    rows = rows.withColumn("_first", F.row_number().over(w))
    out = rows.groupBy("path").agg(
        F.countDistinct("fingerprint").alias("total"), F.countDistinct(F.when(F.col("_seen").isNull(), F.col("fingerprint"))).alias("new"), F.max("list_id").alias("list_id"),
        F.slice(F.transform(F.sort_array(F.collect_list(F.when(F.col("_first") == 1, F.struct(text.ascii_lower("title").alias("t"), "year", "id", "item_key")))), lambda x: x["item_key"]), 1, PREVIEW).alias("preview"),
    )
    return out.where("new > 0").orderBy("path")


def list_cards(built: DataFrame, view: DataFrame, lists: DataFrame, entries: DataFrame) -> DataFrame:
    """Lists with the number of present items and the backdrop of the movie added last that has one, by name."""
    m = it.memberships(view, built, entries).join(built.select("item_key", "backdrop_path", "title", "year"), "item_key")
    last = F.max_by("backdrop_path", F.when(F.col("backdrop_path") != "", F.struct("added_at", "item_key")))
    per = m.groupBy("list_id").agg(F.count("*").alias("n"), last.alias("cover"))
    return lists.join(per, lists["id"] == per["list_id"], "left").select("id", "name", "updated_at", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("cover", F.lit("")).alias("cover")).orderBy(text.norm_title("name"), "id")


def lists_of(with_lists: DataFrame, lists: DataFrame, key: str) -> DataFrame:
    """An item's lists, those changed last first."""
    own = with_lists.where(F.col("item_key") == key).select(F.explode("lists").alias("l")).select(F.col("l.id").alias("id"))
    return lists.join(own, "id").orderBy(F.desc("updated_at"), "id")


def drawn(seed: int, *key):
    """A number for each key and seed: orders by it are the same draw every time."""
    return F.xxhash64(F.lit(seed), *key)


def home(built: DataFrame, lists: DataFrame, seed: int = 0) -> DataFrame:
    """Rows of the home page: kind, value, label, pos, item_key. Kinds: recent, random, one drawn decade, director, country, genre and collection with enough movies, and up to two lists."""
    from lumenframe.operators.facets import tagged

    movies = built.where("movie_id > 0")
    recent = movies.select(F.lit("recent").alias("kind"), F.lit("").alias("value"), F.lit("").alias("label"), "item_key", F.struct(-F.col("added"), text.norm_title("title"), "item_key").alias("o"))
    # the drawn order is a long, the recent one a struct: bring both to a rank
    rank = lambda df, limit: df.orderBy("o").limit(limit).withColumn("pos", F.row_number().over(Window.partitionBy("kind").orderBy("o"))).drop("o")
    random = movies.select(F.lit("random").alias("kind"), F.lit("").alias("value"), F.lit("").alias("label"), "item_key", drawn(seed, "item_key").alias("o"))
    # as many random movies as the row needs, or none: the count is taken over the limited draw
    few = rank(random, ROW_ITEMS).withColumn("_n", F.count("*").over(Window.partitionBy("kind"))).where(F.col("_n") >= LEAST["random"]).drop("_n")
    out = rank(recent, ROW_ITEMS).unionByName(few)
    kinds = F.array(*[tagged(f, "kind") for f in ("decade", "director", "country", "genre", "collection")])
    each = movies.select("item_key", F.explode(F.flatten(kinds)).alias("g")).select("item_key", "g.*").distinct()
    groups = each.groupBy("kind", "value").agg(F.count("*").alias("n"), F.min("label").alias("label"))
    least = F.coalesce(media.lookup(LEAST, F.col("kind")), F.lit(1))
    w = Window.partitionBy("kind").orderBy(drawn(seed, "kind", "value"), "value")
    chosen = groups.where(F.col("n") >= least).withColumn("_n", F.row_number().over(w)).where("_n = 1").select("kind", "value", "label")
    members = each.drop("label").join(F.broadcast(chosen), ["kind", "value"]).withColumn("pos", F.row_number().over(Window.partitionBy("kind").orderBy(drawn(seed, "item_key"), "item_key"))).where(F.col("pos") <= ROW_ITEMS)
    out = out.unionByName(members.select("kind", "value", "label", "item_key", "pos"))
    if "lists" in built.columns:
        in_lists = movies.select("item_key", text.norm_title("title").alias("t"), F.explode("lists").alias("l")).select("item_key", "t", F.col("l.id").alias("id"), F.col("l.added_at").alias("added_at"))
        big = in_lists.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") >= LIST_LEAST).join(lists, "id").orderBy(F.desc("updated_at"), "id").limit(LIST_ROWS).select("id", "name")
        rows = in_lists.join(F.broadcast(big), "id").withColumn("pos", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("added_at"), "t", "item_key"))).where(F.col("pos") <= ROW_ITEMS)
        out = out.unionByName(rows.select(F.lit("list").alias("kind"), F.col("id").cast("string").alias("value"), F.col("name").alias("label"), "item_key", "pos"))
    return out
