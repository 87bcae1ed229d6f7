"""Further registered queries: one operator each over the driver's tables, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.functions import media, text
from lumenframe.operators import facets, items, mutate, versions
from lumenframe.plans import adapters as a
from lumenframe.plans.demo import ENTRIES, FILES, ITEMS, query
from lumenframe.sources import listing

ROOTS = ["src0", "src1", "src2"]


@query("mark_outside", f"SELECT path, NOT ({' OR '.join(f'''starts_with(path, '{r}/')''' for r in ROOTS)}) AS missing FROM ({FILES})")
def mark_outside(spark, d):
    return mutate.mark_outside(a.files(spark, d), ROOTS).select("path", "missing")


@query("under_roots", f"SELECT CASE {' '.join(f'''WHEN starts_with(path, '{r}/') THEN '{r}' ''' for r in ROOTS)} ELSE '' END AS root, count(*) AS n FROM ({FILES}) GROUP BY 1")
def under_roots(spark, d):
    return a.files(spark, d).groupBy(listing.root_of(F.col("path"), ROOTS).alias("root")).agg(F.count("*").alias("n"))


@query("save_probes", f"SELECT path, CASE WHEN doc_id % 3 = 0 THEN size + 1 ELSE size END AS size FROM ({FILES}) WHERE doc_id % 2 = 0 OR doc_id % 3 = 0")
def save_probes(spark, d):
    """Stored probes of every second file, new ones of every third: both parts are roles of the table, not a sample of it."""
    f = a.files(spark, d).select("path", "size", "mtime")
    return mutate.save_probes(f.where("mtime % 2 = 0"), f.where("mtime % 3 = 0").withColumn("size", F.col("size") + 1)).select("path", "size")


@query("first_seen_migration", f"SELECT path, doc_id AS first_seen FROM ({FILES})")
def first_seen_migration(spark, d):
    return mutate.add_first_seen(a.files(spark, d).drop("first_seen")).select("path", "first_seen")


MINE = f"(SELECT list_id, 'movie:' || user_id AS ref, min(added_at) AS added_at FROM ({ENTRIES}) GROUP BY ALL)"


def _entries(spark, d):
    lists = spark.createDataFrame([(i, n, 0, 0) for i, n in enumerate(("click", "error", "purchase", "signup", "view"), 1)], "id long, name string, created_at long, updated_at long")
    return lists, a.list_entries(spark, d).groupBy("list_id", "ref").agg(F.min("added_at").alias("added_at"))


@query("list_add", f"SELECT list_id, ref, added_at FROM {MINE} UNION ALL SELECT 1, ref, 99 FROM {MINE} WHERE list_id = 2 AND ref NOT IN (SELECT ref FROM {MINE} WHERE list_id = 1)")
def list_add(spark, d):
    lists, entries = _entries(spark, d)
    return mutate.add_entries(lists, entries, 1, entries.where("list_id = 2"), 99)[1].select("list_id", "ref", "added_at")


@query("list_remove", f"SELECT list_id, ref, added_at FROM {MINE} WHERE list_id <> 1 OR ref NOT IN (SELECT ref FROM {MINE} WHERE list_id = 2)")
def list_remove(spark, d):
    lists, entries = _entries(spark, d)
    return mutate.remove_entries(lists, entries, 1, entries.where("list_id = 2"), 99)[1].select("list_id", "ref", "added_at")


@query("list_delete", f"SELECT list_id, count(*) AS n FROM {MINE} WHERE list_id <> 3 GROUP BY list_id")
def list_delete(spark, d):
    lists, entries = _entries(spark, d)
    folders = a.schema.empty(spark, "collection_folders")
    return mutate.delete_list(lists, entries, folders, 3)[1].groupBy("list_id").agg(F.count("*").alias("n"))


@query("unlink", """
WITH RECURSIVE e AS (SELECT c_custkey AS f, c_custkey // 2 AS l FROM customer WHERE c_custkey > 1), r AS (SELECT f FROM e WHERE l = 2 UNION ALL SELECT e.f FROM r JOIN e ON e.l = r.f)
SELECT CAST(f AS VARCHAR) AS fingerprint, CAST(l AS VARCHAR) AS leader FROM e WHERE f NOT IN (SELECT f FROM r)""")
def unlink(spark, d):
    links = a.table(spark, d, "customer").where("c_custkey > 1").select(F.col("c_custkey").cast("string").alias("fingerprint"), F.expr("cast(c_custkey div 2 as string)").alias("leader"))
    return mutate.unlink(links, "2").select("fingerprint", "leader")


@query("invalidate_movie", "SELECT CAST(p_partkey AS INTEGER) AS tmdb_id, p_name AS title FROM part WHERE p_partkey <> 3")
def invalidate_movie(spark, d):
    return mutate.invalidate_movie(a.movies(spark, d), a.identifications(spark, d), 3)[0].select("tmdb_id", "title")


@query("movie_lookup", "SELECT CAST(p_partkey AS INTEGER) AS tmdb_id, p_name AS title FROM part WHERE p_partkey = 3")
def movie_lookup(spark, d):
    return versions.movie(a.movies(spark, d), 3).select("tmdb_id", "title")


@query("wikidata_queue", "SELECT CAST(p_partkey AS INTEGER) AS tmdb_id FROM part ORDER BY p_partkey LIMIT 50")
def wikidata_queue(spark, d):
    return versions.pending_wikidata(a.movies(spark, d)).select("tmdb_id")


@query("identify_targets", """
WITH r AS (SELECT l_orderkey AS v, l_partkey || '-' || l_suppkey AS fp, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, -CAST(l_quantity AS BIGINT), l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || l_orderkey) AS n FROM lineitem WHERE l_linestatus = 'F')
SELECT fp AS fingerprint, min(v) AS id FROM r WHERE n = 1 GROUP BY fp""")
def identify_targets(spark, d):
    """Orders are versions and their lines files; the content of an order's first line stands for it."""
    key = [F.col(c).cast("string") for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_orderkey")]
    files = a.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("version_id"), F.concat_ws("-", *key).alias("path"), F.col("l_linenumber").alias("part"), F.col("l_quantity").cast("long").alias("size"), F.lit(1).cast("long").alias("mtime"), F.concat_ws("-", *key[1:3]).alias("fingerprint"), F.lit("video").alias("kind"), F.lit("main").alias("role"), (F.col("l_linestatus") != "F").alias("missing"))
    rows = a.schema.complete(files.select(F.col("version_id").alias("id")).distinct(), "versions")
    return versions.identify_targets(files, rows, a.schema.empty(spark, "media"), a.schema.empty(spark, "identifications")).select("fingerprint", "id")


@query("facet_menu", f"SELECT genre AS value, count(*) AS n FROM ({ITEMS}) WHERE contains(lower(genre), 'a') GROUP BY genre")
def facet_menu(spark, d):
    return facets.menu(facets.counts(a.items(spark, d), {}, ("genre",)), "genre", "A").select("value", "n")


@query("years_in_decade", f"SELECT CAST(year AS VARCHAR) AS value, count(*) AS n FROM ({ITEMS}) WHERE year // 10 = 197 GROUP BY year")
def years_in_decade(spark, d):
    return facets.years_of(facets.counts(a.items(spark, d), {}, ("year",)), "1970").select("value", "n")


@query("version_picker", "SELECT l_orderkey * 8 + l_linenumber AS id FROM lineitem WHERE l_partkey || '-' || l_suppkey <> '1-1' ORDER BY 1 LIMIT 20")
def version_picker(spark, d):
    return facets.match_versions(a.view(spark, d), "CINE", "1-1").select("id")


@query("sight_order", f"SELECT 'movie:' || l_partkey AS item_key, string_agg(flag, ',' ORDER BY first) AS flags FROM (SELECT l_partkey, l_returnflag AS flag, min(l_orderkey * 8 + l_linenumber) AS first FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2) GROUP BY 1")
def sight_order(spark, d):
    rows = items.routed(a.view(spark, d)).withColumn("flags", F.array(F.element_at(F.split("dir", "/"), -1)))
    return items.distinct_in_order(rows, "flags", "flags").select("item_key", F.array_join("flags", ",").alias("flags"))


@query("title_variants", "SELECT p_partkey AS id, p_name || '|' || p_type || '|' || p_brand AS variants FROM part")
def title_variants(spark, d):
    name = F.concat("p_name", F.lit(" ("), "p_type", F.lit(") ["), "p_brand", F.lit("] ("), "p_type", F.lit(")"))
    return a.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array_join(text.title_variants(name), "|").alias("variants"))


@query("runtime_match", "SELECT p_partkey AS id, p_size * 5 > 0 AND 150 > 0 AND abs(p_size * 5 - 150) <= greatest(5, 12) AS hit FROM part")
def runtime_match(spark, d):
    return a.table(spark, d, "part").select(F.col("p_partkey").alias("id"), text.runtime_matches(F.col("p_size") * 5, F.lit(150)).alias("hit"))


@query("group_keys", "SELECT p_partkey AS id, lower(p_name) || '|' || (p_size + 1950) AS key FROM part")
def group_keys(spark, d):
    return a.table(spark, d, "part").select(F.col("p_partkey").alias("id"), text.group_key(F.concat(F.lit("The  "), F.upper("p_name"), F.lit("!")), F.col("p_size") + 1950).alias("key"))


@query("decades", "SELECT CAST((p_size + 1950) // 10 * 10 AS INTEGER) AS decade, count(*) AS n FROM part GROUP BY 1")
def decades(spark, d):
    return a.table(spark, d, "part").groupBy(text.decade(F.col("p_size") + 1950).alias("decade")).agg(F.count("*").alias("n"))


@query("release_years", "SELECT o_orderkey AS id, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders")
def release_years(spark, d):
    return a.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), media.year_of(F.col("o_orderdate").cast("string")).alias("year"))


@query("durations_text", "SELECT p_partkey AS id, CASE WHEN m < 60 THEN m || ' min' WHEN m % 60 = 0 THEN (m // 60) || ' h' ELSE (m // 60) || ' h ' || (m % 60) || ' min' END AS shown FROM (SELECT p_partkey, p_size * 6 AS m FROM part)")
def durations_text(spark, d):
    return a.table(spark, d, "part").select(F.col("p_partkey").alias("id"), text.format_duration(F.col("p_size") * 360000 + 1000).alias("shown"))


@query("info_ids", "SELECT source AS dir, arg_min('tt' || lpad(CAST(doc_id AS VARCHAR), 7, '0'), source || '/' || lpad(CAST(doc_id AS VARCHAR), 9, '0') || '.nfo') AS imdb_id FROM documents GROUP BY source")
def info_ids(spark, d):
    """Every document's text as an info file that names an id after 'see'."""
    number = F.col("doc_id").cast("string")
    rows = a.table(spark, d, "documents").select(F.concat("source", F.lit("/"), F.lpad(number, 9, "0"), F.lit(".nfo")).alias("path"), F.concat(F.lit("see tt"), F.lpad(number, 7, "0"), F.lit(" "), F.coalesce("text", F.lit(""))).alias("text"))
    return listing.nfo_ids(rows)


@query("image_versions", "SELECT p_partkey AS id, 'p' || p_partkey AS token FROM part")
def image_versions(spark, d):
    return a.table(spark, d, "part").select(F.col("p_partkey").alias("id"), text.image_version(F.concat(F.lit("/p"), F.col("p_partkey").cast("string"), F.lit(".jpg"))).alias("token"))


@query("portable_paths", f"SELECT path, '../' || path AS relative FROM ({FILES})")
def portable_paths(spark, d):
    """Paths go to their relative form and back."""
    rows = a.files(spark, d).select("path", F.concat(F.lit("C:/media/"), "path").alias("full"))
    rows = rows.withColumn("relative", text.relative_path(F.replace("full", F.lit("/"), F.lit("\\")), "C:/media/app"))
    return rows.select(F.regexp_replace(text.absolute_path("relative", "C:/media/app"), "^C:/media/", "").alias("path"), "relative")
