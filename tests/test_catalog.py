"""One snapshot drives items, facets, sorts, duplicates, lists, collections, search and pages."""

import pytest
from pyspark.sql import functions as F

from lumenframe import schema
from lumenframe.operators import facets, items, reports, search, versions

ROOTS = ["../cine", "../cine-ordenar"]
ROWS = [  # id, dir, file, fingerprint, title, year, resolution, size, added, status, movie, sub_langs, missing
    (1, "../cine/1970s/Amarcord", "a1", "Amarcord", 1973, "1080p", 9800, 100, "auto", 7857, "", False), (2, "../cine-ordenar", "a2", "Amarcord", 0, "SD", 1400, 200, "manual", 7857, "es,?", False),
    (3, "../cine/Collections/Fellini", "a2", "Amarcord", 0, "SD", 1400, 300, "manual", 7857, "es", False), (4, "../cine/1970s/Amarcord/Extras", "e1", "Making of", 0, "", 350, 100, "extra", 7857, "", False),
    (5, "../cine/1970s/Roma", "r1", "Roma", 1972, "1080p", 5000, 50, "auto", 7858, "", False), (6, "../cine/1970s", "n1", "Novecento", 1976, "720p", 700, 400, "unmatched", 0, "", False),
    (7, "../cine-ordenar/Tarkovsky", "s1", "Stalker", 1979, "576p", 800, 500, "none", 0, "", False), (8, "../cine-ordenar", "x1", "sample", 0, "", 10, 500, "ignored", 0, "", False),
    (9, "../cine-ordenar", "", "Vacío", 0, "", 0, 600, "none", 0, "", False), (10, "../cine-ordenar", "p1", "Solaris", 1972, "", 900, 700, "auto", 555, "", False), (11, "../cine/1980s", "g1", "Gone", 1985, "", 100, 10, "none", 0, "", True),
]
MOVIES = [(7857, "Amarcord", 1973, "it", [(4415, "Federico Fellini")], ["Comedia", "Drama"], ["IT", "FR"], 0, "", "/a.jpg"), (7858, "Roma", 1972, "it", [(4415, "Federico Fellini")], ["Drama"], ["IT"], 99, "Fellini", "/r.jpg")]


def make_view(spark, extra=()):
    df = spark.createDataFrame([*ROWS, *extra], "id long, dir string, fingerprint string, title string, year int, resolution string, size long, added long, status string, identified_id int, sub_langs string, missing boolean")
    movies = spark.createDataFrame([(m[0],) for m in MOVIES], "identified_id int").withColumn("movie_stored", F.lit(True))
    v = df.join(movies, "identified_id", "left").withColumns({
        "movie_stored": F.coalesce("movie_stored", F.lit(False)) & F.col("status").isin("auto", "manual"), "movie_id": F.when(F.col("status").isin("auto", "manual"), F.col("identified_id")).otherwise(0), "present": ~F.col("missing"), "codec_name": F.lit(""),
        "subs": F.when(F.col("id") == 1, F.expr("array(struct('srt' as codec, 'en' as lang, 0 as channels))")).otherwise(F.expr(f"cast(array() as array<{schema.TRACK}>)")), "candidates": F.expr(f"cast(array() as array<{schema.CANDIDATE}>)"),
    })
    return versions.with_best(v)


def make_movies(spark):
    df = spark.createDataFrame(MOVIES, "tmdb_id int, title string, year int, original_lang string, directors array<struct<id:int,name:string>>, genres array<string>, countries array<string>, collection_id int, collection string, backdrop_path string")
    return schema.complete(df.withColumn("original_title", F.col("title")), "movies")


@pytest.fixture(scope="module")
def snap(spark):
    view = make_view(spark).cache()
    movies = make_movies(spark)
    lists = spark.createDataFrame([(1, "Fellini", 1, 20), (2, "Por ver", 1, 30), (3, "vacía", 1, 10)], schema.struct("lists"))
    entries = spark.createDataFrame([(1, "fp:a2", 5), (1, "movie:7857", 3), (1, "movie:7858", 7), (1, "fp:e1", 8), (1, "fp:g1", 9), (1, "movie:1", 9), (2, "fp:s1", 1), (2, "fp:p1", 2)], schema.struct("list_entries"))
    built = items.with_lists(items.build(view, movies, ROOTS), view, lists, entries).cache()
    return view, movies, built, lists, entries


def keys(df):
    return [r.item_key for r in df.select("item_key").collect()]


def test_items(snap):
    view, movies, built, lists, entries = snap
    rows = {r.item_key: r for r in built.collect()}
    assert set(rows) == {"movie:7857", "movie:7858", "n1", "s1", "id:9", "p1"}
    a = rows["movie:7857"]
    assert (a.size, a.added, a.resolution, a.versions, a.contents, a.identical) == (12600, 100, "1080p", 3, 2, True)
    assert (sorted(a.resolutions), sorted(a.subs), sorted(a.states)) == (["1080p", "SD"], ["en", "es"], ["identical-copy", "several-versions"])
    assert [(x.id, x.added_at) for x in a.lists] == [(1, 3)]
    assert [(x.id, x.added_at) for x in rows["s1"].lists] == [(2, 1)] and [(x.id, x.added_at) for x in rows["p1"].lists] == [(2, 2)]


@pytest.mark.parametrize("chosen,want", [
    ({"decade": "1970"}, {"movie:7857", "movie:7858", "n1", "p1", "s1"}), ({"resolution": "SD"}, {"movie:7857", "s1"}), ({"location": "cine/1970s"}, {"movie:7857", "movie:7858", "n1"}), ({"state": "several-versions"}, {"movie:7857"}),
    ({"state": "identical-copy"}, {"movie:7857"}), ({"decade": "1970", "director": "4415", "resolution": "1080p"}, {"movie:7857", "movie:7858"}), ({"list": "2"}, {"s1", "p1"}),
])
def test_filter(snap, chosen, want):
    assert set(keys(facets.filtered(snap[2], chosen))) == want


def counted(built, chosen):
    out = {}
    for r in facets.counts(built, chosen).orderBy("facet", "rank").collect():
        out.setdefault(r.facet, []).append((r.label, r.n))
    return out


def test_counts(snap):
    got = counted(snap[2], {"country": "IT", "resolution": "1080p"})
    assert got["resolution"] == [("1080p", 2), ("SD", 1)] and got["country"] == [("IT", 2), ("FR", 1)] and got["genre"] == [("Drama", 2), ("Comedia", 1)]
    assert got["director"] == [("Federico Fellini", 2)] and got["collection"] == [("Fellini", 1)]
    assert counted(snap[2], {"decade": "1970", "year": "1976"})["decade"] == [("1970s", 5)]
    every = counted(snap[2], {})
    assert every["year"] == [("1979", 1), ("1976", 1), ("1973", 1), ("1972", 2)]
    assert every["location"] == [("cine", 3), ("cine-ordenar", 4), ("cine-ordenar/Tarkovsky", 1), ("cine/1970s", 3), ("cine/Collections", 1)]


def test_counts_agree_with_filters(snap):
    """A value's count is the size of the filter with that value, whatever else is chosen."""
    built = snap[2]
    for chosen in ({}, {"decade": "1970"}, {"resolution": "SD", "country": "IT"}):
        for r in facets.counts(built, chosen).collect():
            rest = {k: v for k, v in chosen.items() if k != r.facet and not (r.facet == "decade" and k == "year")}
            assert facets.filtered(built, rest | {r.facet: r.value}).count() == r.n, (chosen, r)


@pytest.mark.parametrize("order,direction,want", [
    ("year", "desc", ["s1", "n1", "movie:7857", "movie:7858", "p1", "id:9"]), ("year", "asc", ["movie:7858", "p1", "movie:7857", "n1", "s1", "id:9"]), ("title", "asc", ["movie:7857", "n1", "movie:7858", "p1", "s1", "id:9"]),
    ("added", "desc", ["p1", "id:9", "s1", "n1", "movie:7857", "movie:7858"]), ("size", "desc", ["movie:7857", "movie:7858", "p1", "s1", "n1", "id:9"]),
])
def test_sort(snap, order, direction, want):
    assert keys(items.sort(snap[2], order, direction)) == want


def test_list_order(snap):
    assert keys(items.sort(facets.filtered(snap[2], {"list": "1"}), "list-added", "desc", 1)) == ["movie:7858", "movie:7857"]


def test_query_parameters(snap):
    q = facets.Query.from_params({"decada": "1975", "pais": "it", "resolucion": "SD", "orden": "titulo", "estado": "copia-identica"})
    assert (q.facets, q.order, q.direction) == ({"resolution": "SD", "state": "identical-copy"}, "title", "asc")
    assert facets.Query.from_params({"list": "7"}).order == "list-added"
    assert facets.Query.from_params({"list": "7"}).without_missing_list(snap[3]) == facets.Query({}, "year", "desc")


def test_duplicates(spark, snap):
    view = make_view(spark, [(12, "../cine/1970s/Stalker", "s1", "Stalker", 1979, "576p", 800, 500, "none", 0, "", False)])
    built = items.build(view, snap[1], ROOTS)
    rows = [(r.item_key, r.identical, r.several, r.reclaimable) for r in reports.duplicates(view, built).collect()]
    assert rows == [("movie:7857", True, True, 2800), ("s1", True, False, 800)]
    assert reports.reclaimable_total(reports.duplicates(view, built)).first().total == 3600


def test_collections(spark, snap):
    extra = [(20, "../cine/Collections/Fellini/Roma (1972)", "r2", "Roma", 1972, "", 1, 1, "auto", 7858, "", False), (21, "../cine/collections/Kubrick", "k1", "K", 0, "", 1, 1, "none", 0, "", False), (22, "../cine/collections/Kubrick/Extras", "k2", "K2", 0, "", 1, 1, "extra", 7857, "", False),
             (23, "../cine/Collections", "c0", "C", 0, "", 1, 1, "none", 0, "", False), (24, "../cine/Collections/Nada/Gone", "g2", "G", 0, "", 1, 1, "none", 0, "", True), (25, "../cine/Collections/Wong/Collections/Otra", "w1", "W", 0, "", 1, 1, "none", 0, "", False)]
    none = [schema.empty(spark, n) for n in ("collection_folders", "collection_seen", "lists")]
    got = [(r.path, r.total, r.new) for r in reports.collections(make_view(spark, extra), *none).collect()]
    assert got == [("../cine/Collections/Fellini", 2, 2), ("../cine/Collections/Wong", 1, 1), ("../cine/collections/Kubrick", 1, 1)]
    seen = spark.createDataFrame([("../cine/Collections/Fellini", "a2")], schema.struct("collection_seen"))
    dismissed = spark.createDataFrame([("../cine/Collections/Wong", "dismissed", None, 1)], schema.struct("collection_folders"))
    got = [(r.path, r.total, r.new) for r in reports.collections(make_view(spark, extra), dismissed, seen, none[2]).collect()]
    assert got == [("../cine/Collections/Fellini", 2, 1), ("../cine/collections/Kubrick", 1, 1)]


def test_pages(spark, snap):
    view, movies, built, lists, entries = snap
    pending, left = reports.unidentified(view)
    assert pending.first().pending == 1 and [r.fingerprint for r in left.collect()] == ["n1"]
    assert [r.id for r in reports.version_page(view, "a2").collect()] == [2, 3]
    assert [r.id for r in reports.movie_page(view, movies, 7857)[1].collect()][0] == 1
    assert [r.tmdb_id for r in reports.suggestions(movies, view, "amar", "../cine/1970s/Amarcord").collect()] == [7857]
    assert [(r.name, r.n, r.cover) for r in reports.list_cards(built, view, lists, entries).collect()] == [("Fellini", 2, "/r.jpg"), ("Por ver", 2, ""), ("vacía", 0, "")]
    assert [r.id for r in reports.lists_of(built, lists, "movie:7857").collect()] == [1]
    assert {r.ref for r in items.refs_to(view, built, entries, 1, 7857).collect()} == {"movie:7857", "fp:a2"}
    assert items.item_ref(built, key="s1").first().ref == "fp:s1"


def test_home(spark):
    rows = [(f"movie:{100 + i}", 100 + i, f"T{i}", (1970 if i < 7 else 1980) + i % 7, [(1, "Director Uno")] if i < 8 else [(0, "x")], ["Drama"], ["IT" if i % 2 else "FR"], 5 if i in (3, 9) else 0, "Col" if i in (3, 9) else "", 1000 + i) for i in range(14)]
    built = spark.createDataFrame(rows, "item_key string, movie_id int, title string, year int, directors array<struct<id:int,name:string>>, genres array<string>, countries array<string>, collection_id int, collection string, added long")
    for c in ("original_lang", "original_title"):
        built = built.withColumn(c, F.lit(""))
    got = reports.home(built, schema.empty(spark, "lists"), 3).orderBy("kind", "pos").collect()
    assert {r.kind for r in got} == {"collection", "country", "decade", "director", "genre", "random", "recent"}
    assert [r.item_key for r in got if r.kind == "recent"] == [f"movie:{i}" for i in range(113, 99, -1)]
    assert got == reports.home(built, schema.empty(spark, "lists"), 3).orderBy("kind", "pos").collect()


DOCS = [("movie:1", "El ángel exterminador", "", "Luis Buñuel", "", ""), ("movie:2", "Roma", "", "Federico Fellini", "", ""), ("movie:3", "La piel que habito", "", "Pedro Almodóvar", "Antonio Banderas", ""), ("movie:4", "Banderas", "", "", "", ""), ("movie:5", "8½", "Otto e mezzo", "Federico Fellini", "Antonio Banderas", ""), ("f123", "Mentecato", "", "", "", "")]


@pytest.mark.parametrize("q,first,n", [("angel", "movie:1", 1), ("ÁNGEL EXTER", "movie:1", 1), ("bunu", "movie:1", 1), ("almodóvar piel", "movie:3", 1), ("mentecato", "f123", 1), ("otto mezzo", "movie:5", 1), ("banderas", "movie:4", 3), ("8", None, 0), ("a", None, 0), ('"x OR', None, 0), ("zzz", None, 0)])
def test_search(spark, q, first, n):
    docs = spark.createDataFrame([(*d, (d[1], d[0])) for d in DOCS], "key string, title string, original string, directors string, cast string, files string, ord struct<t:string,k:string>")
    got = [r.key for r in search.query(search.postings(docs), q).collect()]
    assert len(got) == n and (not n or got[0] == first)


def test_find(snap):
    built = snap[2]
    found, people, total = search.find(built, search.postings(search.documents(built)), "fellini")
    assert set(keys(found)) == {"movie:7857", "movie:7858"} and total.first().total == 2
    assert [(r.id, r.n) for r in people.collect()] == [(4415, 2)]
