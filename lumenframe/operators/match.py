"""Matching names to movies: retrieval, scoring, staged search, decision. Remote searches are a candidates table.

candidates: query_title (normal form, accents stripped), year (0: without one), lang, ord (the remote order), id, title,
original_title, release_date, poster_path."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions import media, text

# Fixed values.
TITLE_WEIGHT, YEAR_WEIGHT, DIRECTOR_WEIGHT = 0.60, 0.25, 0.15
THRESHOLD, MARGIN, VERSION = 0.80, 0.10, 5
MOST_HITS, CONFIRMED, KEPT = 10, 3, 5


def retrieve(queries: DataFrame, candidates: DataFrame, lang: str) -> DataFrame:
    """qid, variant, ord and candidate: at most ten hits of each variant's search with the year; without it where that finds none.

    queries: qid, title, year, director, minutes, imdb_id."""
    v = queries.select("*", F.posexplode(text.title_variants("title")).alias("variant", "vtitle")).withColumn("q", text.norm_title(text.strip_accents("vtitle")))
    c = candidates.where(F.col("lang") == lang).select(F.col("query_title").alias("q"), F.col("year").alias("_y"), "ord", F.col("id").alias("cand_id"), F.col("title").alias("cand_title"), F.col("original_title").alias("cand_original"), media.year_of("release_date").alias("cand_year"), "poster_path")
    hits = v.join(c, "q").where((F.col("_y") == F.col("year")) | (F.col("_y") == 0))
    w = Window.partitionBy("qid", "variant")
    hits = hits.withColumn("_dated", F.max(F.when((F.col("_y") == F.col("year")) & (F.col("year") > 0), 1).otherwise(0)).over(w))
    hits = hits.where(F.when(F.col("_dated") == 1, F.col("_y") == F.col("year")).otherwise(F.col("_y") == 0))
    return hits.withColumn("_n", F.row_number().over(w.orderBy("ord"))).where(F.col("_n") <= MOST_HITS).drop("_n", "_dated", "_y", "q")


def merged(hits: DataFrame, english: DataFrame | None = None) -> DataFrame:
    """One row a query and candidate: first seen order, ten at most, the English title where an English search gave it."""
    rows = hits.withColumn("_pass", F.lit(0)).withColumn("english_title", F.lit(""))
    if english is not None:
        rows = rows.unionByName(english.withColumn("_pass", F.lit(1)).withColumn("english_title", F.col("cand_title")))
    seen = F.struct("_pass", "variant", "ord")
    firsts = rows.groupBy("qid", "cand_id").agg(F.min(seen).alias("seen"), F.min_by("cand_title", seen).alias("cand_title"), F.min_by("cand_original", seen).alias("cand_original"), F.min_by("cand_year", seen).alias("cand_year"), F.min_by("poster_path", seen).alias("poster_path"), F.max("english_title").alias("english_title"))
    return firsts.withColumn("ord", F.row_number().over(Window.partitionBy("qid").orderBy("seen", "cand_id"))).where(F.col("ord") <= MOST_HITS).drop("seen")


def score(queries: DataFrame, hits: DataFrame, alternative: bool = False) -> DataFrame:
    """score of each hit: the best title score over the variants and titles, and the year's; without a director (and not for another reading) over the most that both can give."""
    q = queries.select("qid", "year", "director", text.title_variants("title").alias("variants"))
    rows = hits.join(q, "qid")
    best = F.aggregate("variants", F.lit(0.0), lambda a, v: F.greatest(a, text.similarity(v, F.col("cand_title")), text.similarity(v, F.col("cand_original")), text.similarity(v, F.col("english_title"))))
    raw = TITLE_WEIGHT * best + text.year_score("year", "cand_year")
    scale = F.lit(1.0) if alternative else F.when(F.col("director") == "", TITLE_WEIGHT + YEAR_WEIGHT).otherwise(1.0)
    return rows.withColumn("score", raw / scale).drop("variants", "year", "director")


def confirmed(queries: DataFrame, scored: DataFrame, details: DataFrame, strict: bool = False) -> DataFrame:
    """The director's weight for the best three whose movie has that director. details: id, runtime, directors array(id, name)."""
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "ord")
    rows = scored.withColumn("_r", F.row_number().over(w)).join(queries.select("qid", "director"), "qid")
    d = details.select(F.col("id").alias("cand_id"), "runtime", F.transform("directors", lambda x: x["name"]).alias("_names"))
    rows = rows.join(d, "cand_id", "left")
    fits = text.surname_matches("director", "_names") if strict else text.director_matches("director", "_names")
    hit = (F.col("_r") <= CONFIRMED) & (F.col("director") != "") & F.coalesce(fits, F.lit(False))
    return rows.withColumn("by_director", hit).withColumn("score", F.col("score") + F.when(hit, DIRECTOR_WEIGHT).otherwise(0.0)).drop("_r", "_names", "director")


def pooled(*parts: DataFrame) -> DataFrame:
    """One row a query and candidate with its best score."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p, allowMissingColumns=True)
    cols = [c for c in rows.columns if c not in ("qid", "cand_id")]
    best = rows.groupBy("qid", "cand_id").agg(F.max_by(F.struct(*cols), F.struct("score", -F.col("ord"))).alias("b"))
    return best.select("qid", "cand_id", "b.*")


def ranked(scored: DataFrame, minutes: DataFrame | None = None) -> DataFrame:
    """rank of each candidate, five kept: by score and remote order; then those whose runtime fits first. margin: to the next one's score."""
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "ord")
    rows = scored.withColumn("rank", F.row_number().over(w)).withColumn("place", F.col("rank")).withColumn("margin", F.col("score") - F.coalesce(F.lead("score").over(w), F.lit(0.0))).where(F.col("rank") <= KEPT)
    if minutes is None:
        return rows
    fits = rows.join(minutes.select("qid", "minutes"), "qid", "left").withColumn("_fits", F.coalesce(text.runtime_matches(F.coalesce("runtime", F.lit(0)), "minutes"), F.lit(False)))
    return fits.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("_fits"), "rank"))).drop("_fits", "minutes")


def decide(scored: DataFrame, minutes: DataFrame | None = None) -> DataFrame:
    """qid, status, tmdb_id, confidence, candidates: auto if the best scores 0.80 or more and leads by 0.10 or more, else unmatched (for review)."""
    rows = ranked(scored, minutes)
    by = Window.partitionBy("qid")
    rows = rows.withColumn("_top", F.max("score").over(by)).withColumn("_lead", F.max(F.when(F.col("place") == 1, F.col("margin"))).over(by))
    one = F.struct("rank", F.col("cand_id").cast("int").alias("tmdb_id"), F.col("cand_title").alias("title"), F.col("cand_original").alias("original_title"), F.col("cand_year").alias("year"), "poster_path", "score")
    out = rows.groupBy("qid").agg(F.max("_top").alias("confidence"), F.max("_lead").alias("_lead"), F.max_by("cand_id", F.struct("score", -F.col("ord"))).alias("_best"), F.sort_array(F.collect_list(one)).alias("_c"))
    auto = (F.round("confidence", 9) >= THRESHOLD) & (F.round("_lead", 9) >= MARGIN)
    return out.select("qid", F.when(auto, "auto").otherwise("unmatched").alias("status"), F.when(auto, F.col("_best")).otherwise(0).cast("int").alias("tmdb_id"), "confidence", F.transform("_c", lambda x: x.dropFields("rank")).alias("candidates"))


def identify(queries: DataFrame, candidates: DataFrame, details: DataFrame, lang: str = "es", readings: DataFrame | None = None) -> DataFrame:
    """The staged search. Stages would stop once conclusive; here each stage is decided on what it and those before it found, and the first conclusive one counts:

    0 an id that a movie has: 1.0 at once; 1 searches in the language; 2 with English ones, and the director's confirmation;
    3 other readings (readings: qid, title, director), which need their director confirmed by surname. Else the last stage's review."""
    direct = queries.where("imdb_id <> ''").join(details.where("imdb_id <> ''").select("imdb_id", F.col("id").alias("cand_id"), F.col("title").alias("_t"), F.col("original_title").alias("_o"), F.col("year").alias("_y")), "imdb_id")
    zero = direct.select("qid", F.lit("auto").alias("status"), F.col("cand_id").cast("int").alias("tmdb_id"), F.lit(1.0).alias("confidence"), F.array(F.struct(F.col("cand_id").cast("int").alias("tmdb_id"), F.col("_t").alias("title"), F.col("_o").alias("original_title"), F.col("_y").cast("int").alias("year"), F.lit("").alias("poster_path"), F.lit(1.0).alias("score"))).alias("candidates"), F.lit(0).alias("stage"))
    local = merged(retrieve(queries, candidates, lang))
    one = confirmed(queries, score(queries, local), details)
    stages = [zero, decide(one, queries).withColumn("stage", F.lit(1))]
    every = one
    if lang != "en":
        both = merged(retrieve(queries, candidates, lang), retrieve(queries, candidates, "en"))
        every = confirmed(queries, score(queries, both), details)
        stages.append(decide(every, queries).withColumn("stage", F.lit(2)))
    if readings is not None:
        alt = queries.drop("title", "director").join(readings, "qid").withColumn("_q", F.monotonically_increasing_id())
        alt = alt.withColumn("rid", F.concat_ws("|", F.col("qid").cast("string"), "title", "director"))
        asked = alt.select(F.col("rid").alias("qid"), "title", "director", "year", "minutes", "imdb_id")
        found = confirmed(asked, score(asked, merged(retrieve(asked, candidates, lang)), alternative=True), details, strict=True).where("by_director")
        back = found.withColumnRenamed("qid", "rid").join(alt.select("rid", "qid").distinct(), "rid").drop("rid")
        stages.append(decide(pooled(every.withColumn("score", F.least(F.col("score"), F.lit(THRESHOLD - MARGIN))), back), queries).withColumn("stage", F.lit(3)))
    rows = stages[0]
    for s in stages[1:]:
        rows = rows.unionByName(s)
    pick = F.struct(F.when(F.col("status") == "auto", F.col("stage")).otherwise(100 - F.col("stage")))
    best = rows.groupBy("qid").agg(F.min_by(F.struct("status", "tmdb_id", "confidence", "candidates", "stage"), pick).alias("b")).select("qid", "b.*")
    return queries.select("qid").join(best, "qid", "left").withColumn("status", F.coalesce("status", F.lit("unmatched")))


def with_folder(own: DataFrame, folder: DataFrame) -> DataFrame:
    """An automatic answer of either query, the file's first; else the more confident one."""
    rows = own.withColumn("_f", F.lit(0)).unionByName(folder.withColumn("_f", F.lit(1)))
    key = F.struct((F.col("status") == "auto").cast("int"), F.coalesce("confidence", F.lit(0.0)), -F.col("_f"))
    auto_first = F.when((F.col("status") == "auto") & (F.col("_f") == 0), 2).when(F.col("status") == "auto", 1).otherwise(0)
    return rows.groupBy("qid").agg(F.max_by(F.struct(*[c for c in own.columns if c != "qid"]), F.struct(auto_first, key)).alias("b")).select("qid", "b.*")


def needs_match(targets: DataFrame, query_key: str = "query", version: int = VERSION) -> DataFrame:
    """Targets without an identification, or with an automatic or open one by another query or an older matcher."""
    again = F.col("current_status").isNull() | (F.col("current_status").isin("auto", "unmatched") & ((F.col("current_query") != F.col(query_key)) | (F.col("current_version") < version)))
    return targets.where(again)


def jobs(targets: DataFrame, lang: str = "es") -> DataFrame:
    """Queries of identify targets: the version's parse, its minutes and id, and the folder's parse where that has a year and differs."""
    from lumenframe.functions.names import parse_name

    rows = targets.withColumn("folder", parse_name(F.element_at(F.split("dir", "/"), -1)))
    other = (F.col("folder.year") > 0) & ((F.col("folder.title") != F.col("title")) | (F.col("folder.year") != F.col("year")))
    rows = rows.withColumn("folder_key", F.when(other, text.query_key("folder.title", "folder.year", "folder.director", F.lit(""), "minutes")).otherwise(""))
    return needs_match(rows.withColumn("query", text.query_key("title", "year", "director", "imdb_id", "minutes", "folder_key", F.lit(lang))))
