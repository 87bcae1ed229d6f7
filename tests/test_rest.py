"""Operators that no registered query calls: corrections, lists, lookups, folder answers, details."""

import pytest
from pyspark.sql import functions as F

from lumenframe import schema
from lumenframe.functions import text
from lumenframe.operators import facets, match, mutate, versions
from lumenframe.plans import adapters
from lumenframe.sources import feeds, listing

FILES = "path string, size long, mtime long, fingerprint string, kind string, missing boolean, version_id long, role string, part int"


@pytest.fixture(scope="module")
def files(spark):
    rows = [("r/a.mkv", 9, 1, "a", "video", False, 1, "main", 0), ("r/b.mkv", 9, 1, "b", "video", False, 2, "main", 0), ("r/c.mkv", 9, 1, "c", "video", True, 3, "main", 0), ("r/a.srt", 1, 1, "", "subtitle", False, 1, "subtitle", 0)]
    return schema.complete(spark.createDataFrame(rows, FILES), "files")


def test_corrections(spark, files):
    now = schema.complete(spark.createDataFrame([("a", "auto", 5, 0.9, "q")], "fingerprint string, status string, tmdb_id int, confidence double, query string"), "identifications")
    done = mutate.set_correction(now, files, "a", "manual", 7, 50)
    r = done.first()
    assert (r.status, r.tmdb_id, r.confidence, r.query, r.updated_at) == ("manual", 7, 0.9, "q", 50)
    both = mutate.set_correction(done, files, "b", "ignored", 0, 60)
    assert {(r.fingerprint, r.status, r.query) for r in both.collect()} == {("a", "manual", "q"), ("b", "ignored", "")}
    for fp, status in (("c", "manual"), ("zz", "manual"), ("a", "auto")):  # not represented, unknown, no correction
        with pytest.raises(ValueError):
            mutate.set_correction(now, files, fp, status, 1, 1)
    later = mutate.save_identifications(both, now.withColumn("tmdb_id", F.lit(9)))
    assert {(r.fingerprint, r.tmdb_id) for r in later.collect()} == {("a", 7), ("b", 0)}
    assert [r.fingerprint for r in mutate.reset_identification(both, "a").collect()] == ["b"]


def test_lists(spark):
    lists = mutate.create_list(schema.empty(spark, "lists"), " One ", 1)
    lists = mutate.create_list(lists, "Two", 2)
    assert {(r.id, r.name) for r in mutate.rename_list(lists, 2, "Three", 9).collect()} == {(1, "One"), (2, "Three")}
    with pytest.raises(ValueError):
        mutate.rename_list(lists, 2, "one", 9).collect()
    assert [r.name for r in facets.match_lists(lists, "TW").collect()] == ["Two"]


def test_movies(spark):
    old = schema.complete(spark.createDataFrame([(1, "A"), (2, "B")], "tmdb_id int, title string"), "movies")
    new = schema.complete(spark.createDataFrame([(2, "b"), (3, "C")], "tmdb_id int, title string"), "movies")
    assert {(r.tmdb_id, r.title) for r in mutate.save_movies(old, new).collect()} == {(1, "A"), (2, "b"), (3, "C")}
    crew, cast = "crew array<struct<id:int,name:string,job:string>>", "cast array<struct<id:int,name:string,character:string,order:int>>"
    kinds = f"id int, title string, original_title string, release_date string, runtime int, original_language string, overview string, {crew}, {cast}, genres array<struct<name:string>>, countries array<struct<iso:string>>"
    people = [(i, f"n{i}", f"c{i}", 20 - i) for i in range(12)]
    row = (5, "T", "O", "1973-12-18", None, "it", "", [(1, "X", "Director"), (2, "Y", "Writer"), (1, "X", "Director"), (3, "Z", "Director")], people, [("Drama",)], [("IT",), ("FR",)])
    m = feeds.movies_from(spark.createDataFrame([row], kinds), "es").first()
    assert (m.tmdb_id, m.year, m.runtime, m.language, m.genres, m.countries) == (5, 1973, 0, "es", ["Drama"], ["IT", "FR"])
    assert [tuple(d) for d in m.directors] == [(1, "X"), (3, "Z")] and [c.id for c in m.cast] == list(range(11, 1, -1))


def test_lookups(spark, files):
    assert [r.path for r in versions.has_file(files, "r/a.mkv").collect()] == ["r/a.mkv"] and versions.has_file(files, "r/c.mkv").isEmpty()
    assert versions.is_representative(files, "b").count() == 1 and versions.is_representative(files, "c").isEmpty()
    view = spark.createDataFrame([(1, "b", 0), (2, "A", 1), (3, "a", 1), (4, "Á", 0)], "id long, title string, year int")
    assert [r.id for r in versions.ordered(view).collect()] == [2, 3, 1, 4]
    assert files.select(listing.file_name("path").alias("n")).first().n == "a.mkv"
    got = spark.range(1).select(text.title_score(F.lit("red widget"), F.lit("The Red Widget"), F.lit("x")).alias("s"), text.percent(F.lit(0.295)).alias("p"), text.format_size(F.lit(1536)).alias("b"), text.same_title(F.lit(" Amélie"), F.lit("amelie ")).alias("t")).first()
    assert (round(got.s, 6), got.p, got.b, got.t) == (0.6, "30 %", "1,5 KB", True)


def test_directors(spark):
    """By the last word: any word of a director will do, or only a last one."""
    rows = [("F Fellini", True, True), ("fellini", True, True), ("X Federico", True, False), ("Fell", False, False), ("", False, False), ("Vittorio De Sica", True, True)]
    directors = F.array(F.lit("Federico Fellini"), F.lit("De Sica"))
    df = spark.createDataFrame(rows, "a string, lenient boolean, strict boolean")
    got = df.select("*", text.director_matches("a", directors).alias("l"), text.surname_matches("a", directors).alias("s")).collect()
    assert [(r.l, r.s) for r in got] == [(r.lenient, r.strict) for r in got]


def test_folder_answers(spark):
    kind = "qid string, status string, tmdb_id int, confidence double"
    own = spark.createDataFrame([("a", "auto", 1, 0.8), ("b", "unmatched", 0, 0.5), ("c", "unmatched", 0, 0.6)], kind)
    folder = spark.createDataFrame([("a", "auto", 2, 0.9), ("b", "auto", 3, 0.9), ("c", "unmatched", 0, 0.7)], kind)
    got = {r.qid: (r.status, r.tmdb_id, r.confidence) for r in match.with_folder(own, folder).collect()}
    assert got == {"a": ("auto", 1, 0.8), "b": ("auto", 3, 0.9), "c": ("unmatched", 0, 0.7)}


def test_jobs(spark):
    kind = "id long, dir string, title string, year int, director string, imdb_id string, minutes int, current_status string, current_query string, current_version int"
    rows = [(1, "r/Amarcord (1973)", "Amarcord", 0, "", "", 120, None, None, None), (2, "r/Films", "Roma", 1972, "", "", 0, "auto", "old", 1), (3, "r/x", "Y", 0, "", "", 0, "manual", "old", 1)]
    got = {r.id: (r.query, r.folder_key) for r in match.jobs(spark.createDataFrame(rows, kind)).collect()}
    assert set(got) == {1, 2} and "1973" in got[1][1] and got[2][1] == "" and got[1][0].endswith("|es")
    again = spark.createDataFrame([(2, "r/Films", "Roma", 1972, "", "", 0, "auto", got[2][0], match.VERSION)], kind)
    assert match.jobs(again).isEmpty()


def test_explore(spark):
    rows = adapters.items(spark, "/root/testdata/sf0.001")
    found, counted = facets.explore(rows, facets.Query({"genre": "SMALL"}))
    assert found.count() == rows.where("array_contains(genres, 'SMALL')").count() > 0 and counted.count() > 0
