"""Registered queries over the driver's tables, and their SQL. Each applies an operator to whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenframe.functions import media, text
from lumenframe.operators import facets, items, match, mutate, reports, search, versions
from lumenframe.plans import adapters as a
from lumenframe.sources import feeds, listing

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql.strip()
        return f

    return add


ITEMS = "SELECT p_partkey AS id, p_name AS title, 1950 + p_size AS year, CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INTEGER) AS director, p_brand, p_type AS genre, CAST(p_retailprice * 100 AS BIGINT) AS size FROM part"
COUNTS = """
WITH i AS ({items}), v AS (
  SELECT 'decade' AS facet, CAST(year // 10 * 10 AS VARCHAR) AS value, CAST(year // 10 * 10 AS VARCHAR) || 's' AS label, {a} AS ok FROM i
  UNION ALL SELECT 'year', CAST(year AS VARCHAR), CAST(year AS VARCHAR), {b} FROM i
  UNION ALL SELECT 'director', CAST(director AS VARCHAR), p_brand, {b} FROM i
  UNION ALL SELECT 'genre', genre, genre, {c} FROM i
  UNION ALL SELECT 'language', 'en', 'en', {b} FROM i)
SELECT facet, value, min(label) AS label, CAST(count(*) AS BIGINT) AS n FROM v WHERE ok GROUP BY facet, value
"""


@query("facet_counts", COUNTS.format(items=ITEMS, a="genre = 'SMALL'", b="genre = 'SMALL'", c="true"))
def facet_counts(spark, d):
    return facets.counts(a.items(spark, d), {"genre": "SMALL"}).select("facet", "value", "label", "n")


@query("facet_decade_ignores_year", COUNTS.format(items=ITEMS, a="true", b="year // 10 * 10 = 1970 AND year = 1975", c="year // 10 * 10 = 1970 AND year = 1975").replace("'year', CAST(year AS VARCHAR), CAST(year AS VARCHAR), year // 10 * 10 = 1970 AND year = 1975", "'year', CAST(year AS VARCHAR), CAST(year AS VARCHAR), year // 10 * 10 = 1970"))
def facet_decade_ignores_year(spark, d):
    return facets.counts(a.items(spark, d), {"decade": "1970", "year": "1975"}).select("facet", "value", "label", "n")


@query("facet_filter", f"SELECT id AS movie_id, title, year FROM ({ITEMS}) WHERE year // 10 * 10 = 1960 AND director = 7")
def facet_filter(spark, d):
    return facets.filtered(a.items(spark, d), {"decade": "1960", "director": "7"}).select(F.col("movie_id").cast("long").alias("movie_id"), "title", "year")


@query("facet_value_order", f"WITH c AS (SELECT genre AS value, count(*) AS n FROM ({ITEMS}) GROUP BY genre) SELECT value, CAST(n AS BIGINT) AS n, CAST(row_number() OVER (ORDER BY n DESC, value) AS INTEGER) AS rank FROM c")
def facet_value_order(spark, d):
    return facets.counts(a.items(spark, d), {}, ("genre",)).select("value", "n", "rank")


@query("item_sort_year_last", f"SELECT id AS movie_id, CAST(row_number() OVER (PARTITION BY director ORDER BY (year = 0), year DESC, title, 'movie:' || id) AS INTEGER) AS rank FROM ({ITEMS})")
def item_sort_year_last(spark, d):
    rows = a.items(spark, d)
    return rows.select(F.col("movie_id").cast("long").alias("movie_id"), F.row_number().over(Window.partitionBy(F.col("directors")[0]["id"]).orderBy(*items.sort_columns("year", "desc"))).alias("rank"))


@query("item_sort_title", f"SELECT id AS movie_id, CAST(row_number() OVER (PARTITION BY genre ORDER BY title, 'movie:' || id) AS INTEGER) AS rank FROM ({ITEMS})")
def item_sort_title(spark, d):
    rows = a.items(spark, d)
    return rows.select(F.col("movie_id").cast("long").alias("movie_id"), F.row_number().over(Window.partitionBy(F.col("genres")[0]).orderBy(*items.sort_columns("title"))).alias("rank"))


@query("topk_recent", "SELECT p_partkey AS movie_id, p_name AS title FROM part ORDER BY p_partkey DESC LIMIT 20")
def topk_recent(spark, d):
    return items.sort(a.items(spark, d), "added").limit(reports.ROW_ITEMS).select(F.col("movie_id").cast("long").alias("movie_id"), "title")


PRESENT = "SELECT l_orderkey * 8 + l_linenumber AS id, l_partkey AS movie, l_partkey || '-' || l_suppkey AS fp, CAST(l_quantity AS BIGINT) AS size, l_returnflag AS flag, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS added FROM lineitem WHERE l_linestatus = 'F'"


@query("item_rollup", f"""
WITH v AS ({PRESENT}), c AS (SELECT movie, fp, count(*) AS n FROM v GROUP BY movie, fp),
k AS (SELECT movie, count(*) AS contents, bool_or(n > 1) AS identical FROM c GROUP BY movie)
SELECT v.movie AS movie_id, p_name AS title, CAST(sum(v.size) AS BIGINT) AS size, CAST(min(v.added) AS BIGINT) AS added, CAST(count(*) AS BIGINT) AS versions, CAST(any_value(contents) AS BIGINT) AS contents, bool_or(identical) AS identical,
CASE max(CASE flag WHEN 'R' THEN 3 WHEN 'A' THEN 2 ELSE 1 END) WHEN 3 THEN '1080p' WHEN 2 THEN '720p' ELSE 'SD' END AS resolution
FROM v JOIN k USING (movie) JOIN part ON p_partkey = v.movie GROUP BY v.movie, p_name""")
def item_rollup(spark, d):
    return items.build(a.view(spark, d), a.movies(spark, d), ["../cine"]).select(F.col("movie_id").cast("long").alias("movie_id"), "title", "size", "added", "versions", "contents", "identical", "resolution")


@query("best_version", f"""
WITH v AS ({PRESENT}) SELECT movie AS movie_id, id FROM (SELECT *, row_number() OVER (PARTITION BY movie ORDER BY CASE flag WHEN 'R' THEN 6 WHEN 'A' THEN 5 ELSE 2 END DESC, size DESC, id) AS r, count(*) OVER (PARTITION BY movie) AS n FROM v) WHERE r = 1 AND n > 1""")
def best_version(spark, d):
    return versions.with_best(a.view(spark, d)).where("best").select(F.col("movie_id").cast("long").alias("movie_id"), "id")


@query("representative_file", """
SELECT l_orderkey AS version_id, fp AS fingerprint, path FROM (SELECT l_orderkey, l_partkey || '-' || l_suppkey AS fp, 'f' || (l_orderkey * 8 + l_linenumber) || '-' || l_partkey || '-' || l_suppkey AS path,
row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, -CAST(l_quantity AS BIGINT), 'f' || (l_orderkey * 8 + l_linenumber) || '-' || l_partkey || '-' || l_suppkey) AS r FROM lineitem WHERE l_linestatus = 'F') WHERE r = 1""")
def representative_file(spark, d):
    rows = a.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("version_id"), F.concat(F.lit("f"), F.concat_ws("-", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))).alias("path"), F.col("l_linenumber").alias("part"), F.col("l_quantity").cast("long").alias("size"), F.concat_ws("-", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("fingerprint"), F.lit("main").alias("role"), (F.col("l_linestatus") != "F").alias("missing"))
    return versions.representatives(rows)


FILES = "SELECT doc_id, source || '/' || coalesce(lang, '-') || '/doc' || doc_id || '.mkv' AS path, n_chars AS size, CASE WHEN coalesce(text, '') = '' THEN '' ELSE substr(sha256(text), 1, 32) END AS fp FROM documents"


@query("duplicate_files", f"SELECT fp AS fingerprint, max(size) AS size, list_aggregate(list_sort(list(path)), 'string_agg', '|') AS paths FROM ({FILES}) WHERE fp <> '' GROUP BY fp HAVING count(*) > 1")
def duplicate_files(spark, d):
    return versions.duplicate_files(a.files(spark, d)).select("fingerprint", "size", F.array_join("paths", "|").alias("paths"))


@query("copy_counts", f"SELECT fp AS fingerprint, CAST(count(*) AS BIGINT) AS copies FROM ({FILES}) WHERE fp <> '' GROUP BY fp")
def copy_counts(spark, d):
    return reports.copy_counts(a.files(spark, d).withColumn("present", ~F.col("missing")))


@query("presence_filter", f"SELECT movie AS movie_id, CAST(count(*) AS BIGINT) AS n FROM ({PRESENT}) GROUP BY movie")
def presence_filter(spark, d):
    return items.routed(a.view(spark, d)).groupBy(F.col("movie_id").cast("long").alias("movie_id")).agg(F.count("*").alias("n"))


@query("duplicates_report", f"""
WITH v AS ({PRESENT}), w AS (SELECT *, row_number() OVER (PARTITION BY movie, fp ORDER BY id) AS copy, first_value(fp) OVER (PARTITION BY movie ORDER BY size DESC, id) AS kept FROM v),
t AS (SELECT movie, CAST(sum(CASE WHEN copy > 1 OR fp <> kept THEN size ELSE 0 END) AS BIGINT) AS reclaimable, count(*) > count(DISTINCT fp) AS identical, count(DISTINCT fp) > 1 AS several FROM w GROUP BY movie)
SELECT movie AS movie_id, reclaimable, identical, several FROM t WHERE identical OR several""")
def duplicates_report(spark, d):
    view = a.view(spark, d)
    out = reports.duplicates(view, items.build(view, a.movies(spark, d), ["../cine"]))
    return out.select(F.regexp_extract("item_key", r"(\d+)$", 1).cast("long").alias("movie_id"), "reclaimable", "identical", "several")


IDENTS = f"SELECT f.fp, doc_id, CASE WHEN toxic = 1 THEN 'ignored' WHEN quality = 1 THEN 'auto' ELSE 'unmatched' END AS status FROM (SELECT fp, min(doc_id) AS doc_id FROM ({FILES}) WHERE fp <> '' GROUP BY fp) f JOIN labels USING (doc_id)"


@query("identity_join", f"SELECT f.doc_id AS id, coalesce(i.status, 'none') AS status, CASE WHEN i.status = 'auto' THEN i.doc_id ELSE 0 END AS movie_id FROM ({FILES}) f LEFT JOIN ({IDENTS}) i ON f.fp = i.fp")
def identity_join(spark, d):
    rows = a.files(spark, d).select(F.col("version_id").alias("id"), "fingerprint")
    ids = a.identifications(spark, d).select("fingerprint", "status", "tmdb_id")
    out = rows.join(ids, "fingerprint", "left").withColumn("status", F.coalesce("status", F.lit("none")))
    return out.select("id", "status", F.when(F.col("status").isin("auto", "manual"), F.col("tmdb_id")).otherwise(0).cast("long").alias("movie_id"))


@query("unidentified_queue", f"""
WITH f AS (SELECT fp, min(doc_id) AS doc_id FROM ({FILES}) WHERE fp <> '' GROUP BY fp), j AS (SELECT f.doc_id, coalesce(i.status, 'none') AS status FROM f LEFT JOIN ({IDENTS}) i ON f.fp = i.fp)
SELECT 'none' AS status, count(*) AS n, NULL::BIGINT AS first FROM j WHERE status = 'none' UNION ALL SELECT 'unmatched', 1, doc_id FROM j WHERE status = 'unmatched'""")
def unidentified_queue(spark, d):
    rows = a.files(spark, d).select(F.col("version_id").alias("id"), "fingerprint", F.lit(True).alias("present"), F.lit("t").alias("title"), F.lit(0).alias("year"))
    view = rows.join(a.identifications(spark, d).select("fingerprint", "status"), "fingerprint", "left").withColumn("status", F.coalesce("status", F.lit("none")))
    pending, unmatched = reports.unidentified(view)
    waiting = pending.select(F.lit("none").alias("status"), F.col("pending").alias("n"), F.lit(None).cast("long").alias("first"))
    return waiting.unionByName(unmatched.select("status", F.lit(1).cast("long").alias("n"), F.col("id").alias("first")))


@query("pending_probes", f"SELECT f.path FROM ({FILES}) f LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL OR l.quality = 0")
def pending_probes(spark, d):
    f = a.files(spark, d)
    probes = f.join(a.table(spark, d, "labels").withColumnRenamed("doc_id", "version_id"), "version_id").select("path", (F.col("size") + F.when(F.col("quality") == 0, 1).otherwise(0)).alias("size"), "mtime", F.lit(1).alias("probe_version"), F.lit("").alias("error"), F.lit(False).alias("with_ffprobe"))
    return versions.pending_probes(f, probes).select("path")


@query("movies_to_enrich", "SELECT DISTINCT o_custkey AS tmdb_id FROM orders LEFT JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus <> 'P' AND o_custkey > 0 AND (c_custkey IS NULL OR c_mktsegment <> 'MACHINERY')")
def movies_to_enrich(spark, d):
    o = a.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("fingerprint"), F.col("o_custkey").alias("tmdb_id"), (F.col("o_orderstatus") == "P").alias("missing"))
    movies = a.table(spark, d, "customer").select(F.col("c_custkey").alias("tmdb_id"), F.col("c_mktsegment").alias("language"))
    return versions.movies_to_enrich(o, o.select("fingerprint", "tmdb_id", F.lit("auto").alias("status")), movies, "MACHINERY")


@query("location_facet", "SELECT l AS value, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest([r_name, r_name || '/' || n_name]) AS l FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey) GROUP BY l")
def location_facet(spark, d):
    s = a.table(spark, d, "supplier").join(a.table(spark, d, "nation"), F.expr("n_nationkey = s_nationkey")).join(a.table(spark, d, "region"), F.expr("r_regionkey = n_regionkey"))
    rows = s.select(F.concat_ws("/", F.lit(".."), "r_name", "n_name", F.lit("x")).alias("dir"))
    roots = ["../AFRICA", "../AMERICA", "../ASIA", "../EUROPE", "../MIDDLE EAST"]
    return rows.select(F.explode(items.locations("dir", roots)).alias("value")).groupBy("value").agg(F.count("*").alias("n"))


KINDS = "CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 WHEN 'view' THEN 5 END"
ENTRIES = f"SELECT CAST({KINDS} AS BIGINT) AS list_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS added_at FROM events"


@query("list_membership_min", f"SELECT 'movie:' || user_id AS item_key, list_id, min(added_at) AS added_at FROM ({ENTRIES}) WHERE user_id > 0 AND user_id IN (SELECT p_partkey FROM part) GROUP BY user_id, list_id")
def list_membership_min(spark, d):
    return items.memberships(a.view(spark, d).limit(0), a.items(spark, d), a.list_entries(spark, d))


@query("list_cards", f"""
WITH m AS (SELECT list_id, user_id, min(added_at) AS added_at FROM ({ENTRIES}) WHERE user_id > 0 AND user_id IN (SELECT p_partkey FROM part) GROUP BY list_id, user_id)
SELECT list_id AS id, CAST(count(*) AS BIGINT) AS n, arg_max('/p' || user_id || '.jpg', {{'a': added_at, 'b': 'movie:' || user_id}}) AS cover FROM m GROUP BY list_id""")
def list_cards(spark, d):
    lists = spark.createDataFrame([(i, n, 0, 0) for i, n in enumerate(("click", "error", "purchase", "signup", "view"), 1)], "id long, name string, created_at long, updated_at long")
    nothing = a.view(spark, d).limit(0)
    return reports.list_cards(a.items(spark, d), nothing, lists, a.list_entries(spark, d)).select("id", "n", "cover")


@query("list_ref_resolution", f"SELECT DISTINCT list_id, 'movie:' || user_id AS ref FROM ({ENTRIES}) WHERE user_id NOT IN (SELECT p_partkey FROM part)")
def list_ref_resolution(spark, d):
    targets = a.items(spark, d).select(text.ref_movie("movie_id").alias("ref"))
    return a.list_entries(spark, d).join(targets, "ref", "left_anti").select("list_id", "ref").distinct()


@query("new_contents_anti", f"SELECT source AS path, CAST(count(DISTINCT fp) AS BIGINT) AS total, CAST(count(DISTINCT CASE WHEN NOT known THEN fp END) AS BIGINT) AS new FROM (SELECT d.source, f.fp, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = f.doc_id) AS known0, bool_or(l2.doc_id IS NOT NULL) OVER (PARTITION BY d.source, f.fp) AS known FROM ({FILES}) f JOIN documents d USING (doc_id) LEFT JOIN labels l2 USING (doc_id) WHERE f.fp <> '') GROUP BY source")
def new_contents_anti(spark, d):
    f = a.files(spark, d).where("fingerprint <> ''").select(F.element_at(F.split("path", "/"), 1).alias("path"), "fingerprint", F.col("version_id").alias("doc_id"))
    seen = f.join(a.table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").select("path", "fingerprint").distinct()
    new = f.select("path", "fingerprint").distinct().join(seen, ["path", "fingerprint"], "left_anti").groupBy("path").agg(F.count("*").alias("new"))
    return f.groupBy("path").agg(F.countDistinct("fingerprint").alias("total")).join(new, "path", "left").select("path", "total", F.coalesce("new", F.lit(0)).cast("long").alias("new"))


@query("collection_folders", f"SELECT 'r/Collections/' || source AS path, CAST(count(DISTINCT fp) AS BIGINT) AS total FROM (SELECT d.source, f.fp FROM ({FILES}) f JOIN documents d USING (doc_id) WHERE f.fp <> '') GROUP BY source")
def collection_folders(spark, d):
    f = a.files(spark, d).select(F.concat(F.lit("r/Collections/"), text.parent("path")).alias("dir"), "fingerprint", F.lit("t").alias("title"), F.lit(0).alias("year"), F.col("version_id").alias("id"), F.lit(True).alias("present"), F.lit("none").alias("status"), F.lit(False).alias("movie_stored"), F.lit(0).alias("movie_id"))
    from lumenframe.schema import empty

    return reports.collections(f, empty(spark, "collection_folders"), empty(spark, "collection_seen"), empty(spark, "lists")).select("path", "total")


@query("director_hits", "SELECT CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INTEGER) AS id, p_brand AS name, CAST(count(*) AS BIGINT) AS n FROM part WHERE p_brand IN (SELECT p_brand FROM part WHERE p_type = 'SMALL') AND regexp_extract(p_brand, '([0-9]+)$', 1) LIKE '1%' GROUP BY p_brand ORDER BY n DESC, name, id LIMIT 5")
def director_hits(spark, d):
    every = a.items(spark, d)
    return search.directors(every, facets.filtered(every, {"genre": "SMALL"}), "brand 1")


FOLD = "translate(lower({c}), 'áàäâãåéèëêíìïîóòöôõøúùüûñç', 'aaaaaaeeeeiiiioooooouuuunc')"


@query("norm_title", f"WITH w AS (SELECT doc_id, list_filter(string_split_regex({FOLD.format(c='lang')} || ' ' || {FOLD.format(c='source')}, '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents) SELECT doc_id, array_to_string(CASE WHEN len(w) > 1 AND w[1] IN ('the','el','la','los','las','le','les','il','lo') THEN w[2:] ELSE w END, ' ') AS title FROM w")
def norm_title(spark, d):
    return a.table(spark, d, "documents").select("doc_id", text.norm_title(F.concat_ws(" ", "lang", "source")).alias("title"))


@query("words", r"SELECT doc_id, CAST(len(list_filter(string_split_regex(regexp_replace(text, '\p{Mn}', '', 'g'), '[^\p{L}\p{Nd}]+'), lambda x: x <> '')) AS BIGINT) AS n FROM documents WHERE text IS NOT NULL")
def words(spark, d):
    return a.table(spark, d, "documents").where("text is not null").select("doc_id", F.size(text.words("text")).cast("long").alias("n"))


@query("strip_accents", "SELECT doc_id, md5(translate(text, 'áàäâãåéèëêíìïîóòöôõøúùüûñçÁÀÄÂÃÅÉÈËÊÍÌÏÎÓÒÖÔÕØÚÙÜÛÑÇ', 'aaaaaaeeeeiiiioooooouuuuncAAAAAAEEEEIIIIOOOOOOUUUUNC')) AS h FROM documents")
def strip_accents(spark, d):
    return a.table(spark, d, "documents").select("doc_id", F.md5(F.encode(text.strip_accents("text"), "UTF-8")).alias("h"))


@query("title_similarity", "SELECT p_partkey AS movie_id, 1 - levenshtein(p_name, 'red widget') / greatest(length(p_name), 10) AS sim FROM part")
def title_similarity(spark, d):
    return a.table(spark, d, "part").select(F.col("p_partkey").alias("movie_id"), text.similarity("p_name", F.lit("red widget")).alias("sim"))


@query("year_score", "SELECT p_partkey AS movie_id, CASE WHEN p_size = 25 THEN 0.25 WHEN abs(p_size - 25) = 1 THEN 0.15 ELSE 0.0 END AS score FROM part".replace("0.25", "CAST(0.25 AS DOUBLE)").replace("0.15", "CAST(0.15 AS DOUBLE)").replace("0.0 END", "CAST(0 AS DOUBLE) END"))
def year_score(spark, d):
    return a.table(spark, d, "part").select(F.col("p_partkey").alias("movie_id"), text.year_score(F.lit(1975), F.col("p_size") + 1950).alias("score"))


@query("match_decision", """
WITH q AS (SELECT DISTINCT p_name AS title, p_size + 1950 AS year FROM part), c AS (SELECT p_name AS title, p_partkey AS id, p_size + 1950 AS year FROM part),
h AS (SELECT q.title || '|' || q.year AS qid, c.id, round((0.6 + CASE WHEN q.year = c.year THEN 0.25 WHEN abs(q.year - c.year) = 1 THEN 0.15 ELSE 0 END) / 0.85, 9) AS s, row_number() OVER (PARTITION BY q.title, q.year ORDER BY c.id) AS n FROM q JOIN c ON q.title = c.title),
r AS (SELECT qid, id, s, lead(s, 1, 0) OVER (PARTITION BY qid ORDER BY s DESC, id) AS nxt, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS k FROM h WHERE n <= 10)
SELECT qid, CASE WHEN s >= 0.8 AND round(s - nxt, 9) >= 0.1 THEN 'auto' ELSE 'unmatched' END AS status, CAST(CASE WHEN s >= 0.8 AND round(s - nxt, 9) >= 0.1 THEN id ELSE 0 END AS INTEGER) AS tmdb_id, s AS confidence FROM r WHERE k = 1""")
def match_decision(spark, d):
    p = a.table(spark, d, "part")
    q = p.select(F.col("p_name").alias("title"), (F.col("p_size") + 1950).cast("int").alias("year")).distinct().select(F.concat_ws("|", "title", F.col("year").cast("string")).alias("qid"), "title", "year", F.lit("").alias("director"), F.lit(0).alias("minutes"), F.lit("").alias("imdb_id"))
    cand = p.select(F.col("p_name").alias("query_title"), F.lit(0).alias("year"), F.lit("en").alias("lang"), F.col("p_partkey").cast("int").alias("ord"), F.col("p_partkey").cast("int").alias("id"), F.col("p_name").alias("title"), F.col("p_name").alias("original_title"), F.concat((F.col("p_size") + 1950).cast("string"), F.lit("-01-01")).alias("release_date"), F.lit("").alias("poster_path"))
    hits = match.merged(match.retrieve(q, cand, "en"))
    return match.decide(match.score(q, hits)).select("qid", "status", "tmdb_id", F.round("confidence", 9).alias("confidence"))


@query("longest_prefix_join", "SELECT e.event_type || n AS sub, max(p) AS owner FROM (SELECT DISTINCT event_type FROM events) e, range(1, 40) t(n), LATERAL (SELECT b AS p FROM (SELECT event_type || g AS b FROM (SELECT DISTINCT event_type FROM events), range(1, 10) s(g)) WHERE starts_with(e.event_type || n, b) ORDER BY length(b) DESC LIMIT 1) GROUP BY 1")
def longest_prefix_join(spark, d):
    kinds = a.table(spark, d, "events").select("event_type").distinct()
    subs = kinds.select("event_type", F.explode(F.sequence(F.lit(1), F.lit(39))).alias("n")).select("event_type", F.concat("event_type", F.col("n").cast("string")).alias("sub"))
    bases = kinds.select("event_type", F.explode(F.sequence(F.lit(1), F.lit(9))).alias("g")).select("event_type", F.concat("event_type", F.col("g").cast("string")).alias("base"))
    hits = subs.join(bases, "event_type").where(F.col("sub").startswith(F.col("base")))
    return hits.groupBy("sub").agg(F.max_by("base", F.length("base")).alias("owner"))


@query("strict_duration", "SELECT l_orderkey AS version_id, CAST(CASE WHEN bool_and(l_returnflag <> 'R') THEN sum(CAST(l_quantity AS BIGINT)) ELSE 0 END AS BIGINT) AS duration_ms FROM lineitem WHERE l_linestatus = 'F' GROUP BY l_orderkey")
def strict_duration(spark, d):
    """A line is a file; its probe failed (R by an error, or by another time of the file) or gives the quantity as duration."""
    path = F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")])
    rows = a.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("version_id"), path.alias("path"), F.col("l_linenumber").alias("part"), F.lit(1).alias("size"), F.lit(1).alias("mtime"), F.lit("video").alias("kind"), F.lit("main").alias("role"), (F.col("l_linestatus") != "F").alias("missing"), F.col("l_quantity").cast("long").alias("duration_ms"), (F.col("l_returnflag") == "R").alias("failed"))
    stale = F.col("failed") & (F.col("part") % 2 == 0)
    blank = [F.lit(0).alias("width"), F.lit(0).alias("height"), F.lit("").alias("video_codec"), F.lit(None).alias("audio"), F.lit(None).alias("subs")]
    probes = rows.select("path", "size", (F.col("mtime") + stale.cast("int")).alias("mtime"), F.when(F.col("failed") & ~stale, "broken").otherwise("").alias("error"), "duration_ms", *blank)
    return versions.strict_durations(rows, probes)


@query("sync_files_merge", f"""
WITH f AS ({FILES}), k AS (SELECT * FROM f WHERE doc_id % 3 <> 0), s AS (SELECT * FROM f WHERE doc_id % 3 <> 1), first AS (SELECT fp, min(doc_id) AS m FROM k WHERE fp <> '' GROUP BY fp)
SELECT f.path, f.doc_id % 3 = 1 AS missing, CASE WHEN f.doc_id % 3 <> 0 THEN f.doc_id ELSE coalesce(first.m, 1000000000) END AS first_seen FROM f LEFT JOIN first ON f.fp = first.fp""")
def sync_files_merge(spark, d):
    """The known table and the scan overlap by a third each way; both take part whole."""
    f = a.files(spark, d)
    seen = f.where(F.col("mtime") % 3 != 1).select("path", "size", "mtime", "fingerprint", "kind")
    roots = [f"src{i}" for i in range(100)]
    return mutate.sync_files(f.where(F.col("mtime") % 3 != 0), seen, roots, 1_000_000_000).select("path", "missing", "first_seen")


@query("guarded_upsert", f"SELECT fp AS fingerprint, CASE WHEN status = 'ignored' THEN 'ignored' ELSE 'auto' END AS status FROM ({IDENTS})")
def guarded_upsert(spark, d):
    now = a.identifications(spark, d)
    new = now.withColumn("status", F.lit("auto"))
    return mutate.save_identifications(now, new).select("fingerprint", "status")


@query("final_leader", """
WITH RECURSIVE e AS (SELECT c_custkey AS f, c_custkey // 2 AS l FROM customer WHERE c_custkey > 1), r AS (SELECT f, l FROM e UNION ALL SELECT r.f, e.l FROM r JOIN e ON r.l = e.f)
SELECT CAST(f AS VARCHAR) AS follower, CAST(min(l) AS VARCHAR) AS leader FROM r GROUP BY f""")
def final_leader(spark, d):
    edges = a.table(spark, d, "customer").where("c_custkey > 1").select(F.col("c_custkey").cast("string").alias("fingerprint"), F.expr("cast(c_custkey div 2 as string)").alias("leader"))
    return mutate.final_leaders(edges)


@query("json_extract_tracks", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def json_extract_tracks(spark, d):
    return a.table(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("path_split", r"SELECT page_id, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '\.[^.]*$', '') AS stem, lower(regexp_extract(regexp_extract(url, '([^/]*)$', 1), '(\.[^.]*)$', 1)) AS ext, regexp_extract(url, '^(.*)/[^/]*$', 1) AS dir FROM pages")
def path_split(spark, d):
    return a.table(spark, d, "pages").select("page_id", text.stem("url").alias("stem"), text.ext("url").alias("ext"), text.parent("url").alias("dir"))


@query("file_kinds", "SELECT CASE n_chars % 5 WHEN 0 THEN 'video' WHEN 1 THEN 'dvd' WHEN 2 THEN 'subtitle' WHEN 3 THEN 'junk' ELSE 'other' END AS kind, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY 1")
def file_kinds(spark, d):
    name = F.concat(F.col("source"), F.element_at(F.array(*[F.lit(x) for x in (".MKV", ".ifo", ".srt", ".txt", ".xyz")]), (F.col("n_chars") % 5 + 1).cast("int")))
    return a.table(spark, d, "documents").groupBy(media.kind(name).alias("kind")).agg(F.count("*").alias("n"))


@query("resolution_labels", "SELECT p_partkey AS id, CASE WHEN p_size * 80 >= 3200 OR p_size * 40 >= 2000 THEN '2160p' WHEN p_size * 80 >= 1800 OR p_size * 40 >= 1000 THEN '1080p' WHEN p_size * 80 >= 1200 OR p_size * 40 >= 700 THEN '720p' WHEN p_size * 40 >= 540 THEN '576p' WHEN p_size * 40 >= 400 THEN '480p' ELSE 'SD' END AS label FROM part")
def resolution_labels(spark, d):
    return a.table(spark, d, "part").select(F.col("p_partkey").alias("id"), media.frame_label(F.col("p_size") * 80, F.col("p_size") * 40).alias("label"))


@query("suggest_topk", "SELECT CAST(p_partkey AS INTEGER) AS tmdb_id, p_name AS title FROM part WHERE contains(p_name, 'ring') ORDER BY p_name, p_partkey LIMIT 20")
def suggest_topk(spark, d):
    return reports.suggestions(a.movies(spark, d), a.view(spark, d).limit(0), "ring").select("tmdb_id", "title")


@query("sparql_entities", "SELECT CAST(o_custkey AS INTEGER) AS tmdb_id, CAST(min(year(o_orderdate)) AS INTEGER) AS year, list_aggregate(list_sort(list(DISTINCT substr(o_orderpriority, 3))), 'string_agg', ',') AS directors FROM orders GROUP BY o_custkey")
def sparql_entities(spark, d):
    rows = a.table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("tmdb"), F.lit("http://x/Q1").alias("item"), F.lit("").alias("imdb"), F.lit("es").alias("country"), F.substring("o_orderpriority", 3, 100).alias("director"), F.col("o_orderdate").cast("string").alias("date"))
    return feeds.entities(rows).select("tmdb_id", "year", F.array_join("directors", ",").alias("directors"))


@query("catalog_status", f"SELECT CAST(count(*) AS BIGINT) AS files, CAST(count(*) AS BIGINT) AS present, CAST(count(*) FILTER (fp <> '') AS BIGINT) AS hashed FROM ({FILES})")
def catalog_status(spark, d):
    f = a.files(spark, d)
    return listing.status(f, f.select(F.lit("").alias("error")).limit(0)).select("files", "present", "hashed")


@query("search_bm25", f"""
WITH c AS (SELECT CAST(doc_id AS VARCHAR) AS key, 10 AS weight, coalesce(text, '') AS t FROM documents UNION ALL SELECT CAST(doc_id AS VARCHAR), 2, source FROM documents),
w AS (SELECT key, weight, unnest(list_filter(string_split_regex(replace({FOLD.format(c='t')}, 'ß', 'ss'), '[^\\p{{L}}\\p{{Nd}}]+'), lambda x: x <> '')) AS term FROM c),
size AS (SELECT key, count(*) AS words FROM w GROUP BY key), total AS (SELECT count(*) AS docs, avg(words) AS mean FROM size),
hit AS (SELECT CASE WHEN term = 'the' THEN 0 WHEN term = 'of' THEN 1 ELSE 2 END AS pos, key, sum(weight) AS wtf FROM w WHERE term IN ('the', 'of') OR starts_with(term, 'an') GROUP BY 1, 2),
df AS (SELECT pos, count(*) AS df FROM hit GROUP BY pos)
SELECT key, round(sum(greatest(ln((docs - df + 0.5) / (df + 0.5)), 1e-6) * wtf * 2.2 / (wtf + 1.2 * (0.25 + 0.75 * words / mean))), 6) AS score FROM hit JOIN df USING (pos) JOIN size USING (key), total GROUP BY key HAVING count(*) = 3""")
def search_bm25(spark, d):
    docs = a.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("key"), F.coalesce("text", F.lit("")).alias("title"), F.lit("").alias("original"), F.lit("").alias("directors"), F.lit("").alias("cast"), F.col("source").alias("files"), F.struct("doc_id").alias("ord"))
    return search.query(search.postings(docs), "the of an").select("key", F.round("score", 6).alias("score"))


@query("home_rows_seeded")
def home_rows_seeded(spark, d):
    lists = spark.createDataFrame([], "id long, name string, created_at long, updated_at long")
    return reports.home(a.items(spark, d), lists, 7)


@query("name_parse")
def name_parse(spark, d):
    from lumenframe.functions.names import alternative_readings, parse_name

    rows = a.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.regexp_replace("p_name", " ", "."), F.lit("."), (F.col("p_size") + 1950).cast("string"), F.lit(".1080p.BluRay.x264-"), F.col("p_type")).alias("name"))
    return rows.withColumn("p", parse_name("name")).select("id", "p.title", "p.year", "p.resolution", "p.release_group", F.size(alternative_readings(F.col("p.title"), F.col("p.director"))).alias("n_readings"))


@query("directory_grouping")
def directory_grouping(spark, d):
    from lumenframe.operators import grouping

    entries = a.files(spark, d).select(F.concat(F.lit("r/"), "path").alias("path"), "size", "kind")
    return grouping.build(entries, ["r"]).select("dir", "title", "size", "parts", F.size("members").alias("members"))
