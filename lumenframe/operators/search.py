"""Full-text search: an inverted index as a table, all-terms queries with a prefix last term, weighted BM25."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.functions import text

#: Weights of the columns.
WEIGHTS = {"title": 10.0, "original": 8.0, "directors": 4.0, "cast": 1.0, "files": 2.0}
K1, B = 1.2, 0.75
LIMIT, MOST, DIRECTORS = 8, 200, 5


def documents(built: DataFrame) -> DataFrame:
    """key, title, original, directors, cast, files and ord (title order) of each item."""
    names = lambda c: F.array_join(F.transform(F.coalesce(F.col(c), F.expr("cast(array() as array<struct<id:int,name:string>>)")), lambda p: p["name"]), " ")
    cast = F.coalesce(F.array_join(F.transform("cast", lambda p: p["name"]), " "), F.lit(""))
    return built.select(F.col("item_key").alias("key"), "title", F.col("original_title").alias("original"), names("directors").alias("directors"), cast.alias("cast"), F.array_join("file_titles", " ").alias("files"), F.struct(text.norm_title("title").alias("t"), "item_key").alias("ord"))


def postings(docs: DataFrame) -> DataFrame:
    """term, key, column, tf, of all columns, with the document's length (words of all columns)."""
    each = F.array(*[F.struct(F.lit(c).alias("column"), text.words(c).alias("w")) for c in WEIGHTS])
    rows = docs.select("key", "ord", F.explode(each).alias("e")).select("key", "ord", "e.column", F.explode("e.w").alias("term"))
    tf = rows.groupBy("term", "key", "ord", "column").agg(F.count("*").alias("tf"))
    size = rows.groupBy("key").agg(F.count("*").alias("words"))
    return tf.join(size, "key")


def query(index: DataFrame, q: str, n_docs: int | None = None) -> DataFrame:
    """key, score: documents with every term (the last as a word's beginning), best first, ties in title order. None for fewer than two letters or digits.

    q goes through the same folding as the index, in the JVM; its terms are a one-row table joined to the postings."""
    spark = index.sparkSession
    asked = spark.range(1).select(F.posexplode(text.terms(F.lit(q))).alias("pos", "term"), F.size(text.terms(F.lit(q))).alias("n"))
    whole = asked.where("pos < n - 1").select("pos", "n", F.col("term").alias("asked"))
    last = asked.where("pos = n - 1").select("pos", "n", F.col("term").alias("asked"))
    hits = index.join(F.broadcast(whole), F.col("term") == F.col("asked")).unionByName(index.join(F.broadcast(last), F.col("term").startswith(F.col("asked"))))
    # one term of the query in one column: all words that answer it together
    tf = hits.groupBy("pos", "n", "key", "ord", "words", "column").agg(F.sum("tf").alias("tf"))
    total = index.select("key", "words").distinct().agg(F.count("*").alias("docs"), F.avg("words").alias("mean"))
    df = hits.groupBy("pos").agg(F.countDistinct("key").alias("df"))
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv]), F.col("column"))
    per = tf.groupBy("pos", "n", "key", "ord", "words").agg(F.sum(F.col("tf") * weight).alias("wtf")).join(F.broadcast(df), "pos").join(F.broadcast(total))
    idf = F.greatest(F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    norm = K1 * (1 - B + B * F.col("words") / F.col("mean"))
    score = F.sum(idf * F.col("wtf") * (K1 + 1) / (F.col("wtf") + norm))
    return per.groupBy("key", "ord", "n").agg(score.alias("score"), F.count("*").alias("_have")).where("_have = n").select("key", "score", "ord").orderBy(F.desc("score"), "ord")


def directors(every: DataFrame, found: DataFrame, q: str, limit: int = DIRECTORS) -> DataFrame:
    """id, name, n: directors of found items whose name answers the terms, with their number of items among all."""
    each = lambda df: df.select("item_key", F.explode(F.filter("directors", lambda d: d["id"] > 0)).alias("d")).select("item_key", "d.id", "d.name")
    named = each(found).where(text.name_matches("name", text.terms(F.lit(q)))).select("id").distinct()
    return each(every).join(named, "id", "left_semi").groupBy("id").agg(F.min("name").alias("name"), F.countDistinct("item_key").alias("n")).orderBy(F.desc("n"), text.norm_title("name"), "id").limit(limit)


def find(built: DataFrame, index: DataFrame, q: str, limit: int = LIMIT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items by rank, directors, total of hits). limit outside 1..200 is the default."""
    limit = limit if 1 <= limit <= MOST else LIMIT
    hits = query(index, q)
    found = built.join(hits.select(F.col("key").alias("item_key"), "score", "ord"), "item_key")
    return found.orderBy(F.desc("score"), "ord").limit(limit), directors(built, found, q), hits.agg(F.count("*").alias("total"))
