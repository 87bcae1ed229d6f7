"""Table changes as rewrites: each function gives the next generation of a table; ``Catalog`` writes it and flips a manifest."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe import schema
from lumenframe.functions import text
from lumenframe.operators.versions import representatives
from lumenframe.sources.listing import under_any


class Catalog:
    """A folder of table generations and a manifest that names the current ones; a changed set of tables becomes visible at once.

    The manifest is a Parquet row under a rising number: readers take the largest."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def generation(self) -> int:
        try:
            return self.spark.read.parquet(f"{self.path}/manifest").agg(F.max("generation")).first()[0] or 0
        except Exception as e:  # no manifest yet
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER" in str(e):
                return 0
            raise

    def _tables(self) -> dict[str, str]:
        g = self.generation()
        if not g:
            return {}
        return json.loads(self.spark.read.parquet(f"{self.path}/manifest").where(F.col("generation") == g).first()["tables"])

    def read(self, name: str) -> DataFrame:
        """A table of the current generation, completed to the schema (older ones may lack columns)."""
        at = self._tables().get(name)
        return schema.complete(self.spark.read.parquet(at), name) if at else schema.empty(self.spark, name)

    def snapshot(self) -> dict[str, DataFrame]:
        """All tables of one generation."""
        at = self._tables()
        return {n: schema.complete(self.spark.read.parquet(at[n]), n) if n in at else schema.empty(self.spark, n) for n in schema.DDL}

    def commit(self, **tables: DataFrame) -> int:
        """Write next generations of some tables and flip to them; returns the new generation's number."""
        at, g = self._tables(), self.generation()
        for name, df in tables.items():
            to = f"{self.path}/{name}/{uuid.uuid4().hex}"
            schema.complete(df, name).write.parquet(to)
            at[name] = to
        self.spark.createDataFrame([(g + 1, json.dumps(at))], "generation long, tables string").coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        return g + 1


def replaced(current: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Rows of ``current`` whose key isn't in ``new``, and all of ``new``."""
    return current.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def sync_files(files: DataFrame, seen: DataFrame, clean_roots: list[str], now: int) -> DataFrame:
    """Files after a scan. seen: path, size, mtime, fingerprint, kind. A new path takes the first date of its content (missing files count too), else now; present files under clean roots that weren't seen are missing."""
    first = files.where("fingerprint <> ''").groupBy("fingerprint").agg(F.min("first_seen").alias("_first"))
    s = seen.select("path", *[F.col(c).alias(f"_{c}") for c in ("size", "mtime", "fingerprint", "kind")], F.lit(True).alias("_seen"))
    both = files.withColumn("_known", F.lit(True)).join(s, "path", "full")
    both = both.join(first.withColumnRenamed("fingerprint", "_fp"), F.expr("_known is null and _fingerprint = _fp"), "left")
    gone = F.col("_seen").isNull() & under_any(F.col("path"), clean_roots)
    use = lambda c: F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c)
    return both.select(
        "path", use("size"), use("mtime"), use("fingerprint"), use("kind"), F.when(F.col("_seen"), False).when(gone, True).otherwise(F.col("missing")).alias("missing"),
        "version_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("part", F.lit(0)).alias("part"), F.coalesce("lang", F.lit("")).alias("lang"),
        F.coalesce("first_seen", "_first", F.lit(now)).cast("long").alias("first_seen"),
    )


def mark_outside(files: DataFrame, roots: list[str]) -> DataFrame:
    return files.withColumn("missing", F.col("missing") | ~under_any(F.col("path"), roots))


def replace_versions(versions: DataFrame, files: DataFrame, new: DataFrame, roots: list[str] | None = None, configured: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(versions, files) with ``new`` (with members) in place of all, or of those that have a file under ``roots``, or none under ``configured``, or no file.

    Ids of new versions continue after those that stay. A member that isn't a known file is an error when it is written."""
    if roots is None:
        stay = versions.limit(0)
    else:
        f = files.where("version_id is not null").groupBy(F.col("version_id").alias("id")).agg(F.max(under_any(F.col("path"), roots)).alias("_in"), F.max(under_any(F.col("path"), configured or roots)).alias("_conf"))
        stay = versions.join(f, "id").where("not _in and _conf").drop("_in", "_conf")
    top = stay.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    fresh = new.join(F.broadcast(top)).withColumn("id", F.col("id") + F.col("_top")).drop("_top")
    members = fresh.select(F.col("id").alias("_id"), F.explode("members").alias("m")).select("_id", F.col("m.path").alias("path"), F.col("m.role").alias("_role"), F.col("m.part").alias("_part"), F.col("m.lang").alias("_lang"))
    linked = files.withColumn("_there", F.lit(True)).join(members, "path", "full").where(F.when(F.col("_there").isNull(), F.raise_error(F.concat(F.lit("unknown file: "), F.col("path")))).otherwise(True).cast("boolean"))
    kept = linked.join(stay.select(F.col("id").alias("version_id"), F.lit(True).alias("_stays")), "version_id", "left")
    out = kept.select(
        "path", "size", "mtime", "fingerprint", "kind", "missing", F.coalesce("_id", F.when(F.col("_stays"), F.col("version_id"))).alias("version_id"), F.coalesce("_role", F.when(F.col("_stays"), F.col("role")), F.lit("")).alias("role"),
        F.coalesce("_part", F.when(F.col("_stays"), F.col("part")), F.lit(0)).alias("part"), F.coalesce("_lang", F.when(F.col("_stays"), F.col("lang")), F.lit("")).alias("lang"), "first_seen",
    )
    return stay.unionByName(schema.complete(fresh, "versions")), out


def save_probes(probes: DataFrame, results: DataFrame) -> DataFrame:
    return replaced(probes, results, "path")


def save_movies(movies: DataFrame, new: DataFrame) -> DataFrame:
    return replaced(movies, new, "tmdb_id")


def invalidate_movie(movies: DataFrame, identifications: DataFrame, tmdb_id: int) -> tuple[DataFrame, DataFrame]:
    """Without the movie and the automatic identifications of it."""
    return movies.where(F.col("tmdb_id") != tmdb_id), identifications.where(~((F.col("status") == "auto") & (F.col("tmdb_id") == tmdb_id)))


def save_identifications(current: DataFrame, new: DataFrame) -> DataFrame:
    """New results, but only over automatic and unmatched rows: corrections win."""
    fixed = current.where("status not in ('auto', 'unmatched')")
    take = new.join(fixed.select("fingerprint"), "fingerprint", "left_anti")
    return replaced(current, take, "fingerprint")


def set_correction(current: DataFrame, files: DataFrame, fingerprint: str, status: str, tmdb_id: int, now: int) -> DataFrame:
    """Status and movie of one content (only a representative's), its candidates and query kept."""
    if status not in ("manual", "extra", "ignored"):
        raise ValueError(f"not a correction: {status}")
    if representatives(files).where(F.col("fingerprint") == fingerprint).isEmpty():
        raise ValueError("no version is represented by this content")
    one = current.sparkSession.range(1).select(F.lit(fingerprint).alias("fingerprint"), F.lit(status).alias("status"), F.lit(tmdb_id).alias("tmdb_id"), F.lit(now).alias("updated_at"))
    old = current.where(F.col("fingerprint") == fingerprint).select("fingerprint", "confidence", "candidates", "query", "matcher_version")
    return replaced(current, schema.complete(one.join(old, "fingerprint", "left"), "identifications").na.fill({"confidence": 0.0, "query": "", "matcher_version": 0}), "fingerprint")


def reset_identification(current: DataFrame, fingerprint: str) -> DataFrame:
    return current.where(F.col("fingerprint") != fingerprint)


# --- part links ---


def final_leaders(links: DataFrame) -> DataFrame:
    """follower, leader: the end of each chain of links; chains that run in a circle lead nowhere. Pointers jump, so 2^n links take n rounds."""
    rows = links.select(F.col("fingerprint").alias("follower"), F.col("leader"))
    for _ in range(links.count().bit_length() + 1):  # chains are done by then: what goes on runs in a circle
        nxt = rows.select(F.col("follower").alias("_f"), F.col("leader").alias("_l"))
        step = rows.join(nxt, rows["leader"] == nxt["_f"], "left")
        new = step.select("follower", F.coalesce("_l", "leader").alias("leader"), F.col("_l").isNotNull().alias("moved"))
        new = new.where("follower <> leader").checkpoint() if new.sparkSession.sparkContext.getCheckpointDir() else new.where("follower <> leader").cache()
        rows = new.select("follower", "leader")
        if new.where("moved").isEmpty():
            break
    # what still points at a follower runs in a circle, or into one
    circle = rows.select(F.col("follower").alias("leader"))
    return rows.join(circle, "leader", "left_anti").select("follower", "leader")


def set_part_link(links: DataFrame, files: DataFrame, follower: str, leader: str, now: int) -> DataFrame:
    """A link of two represented contents that are not the same and close no circle."""
    reps = representatives(files).where(F.col("fingerprint").isin(follower, leader)).select("fingerprint").distinct().count()
    if follower == leader or reps != 2:
        raise ValueError("both ends must be different contents that represent versions")
    one = links.sparkSession.createDataFrame([(follower, leader, now)], schema.struct("part_links"))
    out = replaced(links, one, "fingerprint")
    if final_leaders(out).where(F.col("follower") == follower).isEmpty():  # what runs in a circle has no end
        raise ValueError("the link would close a circle")
    return out


def followers_of(links: DataFrame, leader: str) -> DataFrame:
    """All that lead to a content, directly or not, however long the chain: those whose end it is once its own link is cut."""
    cut = links.where(F.col("fingerprint") != leader)
    return final_leaders(cut).where(F.col("leader") == leader).select(F.col("follower").alias("fingerprint"))


def unlink(links: DataFrame, leader: str) -> DataFrame:
    return links.join(followers_of(links, leader), "fingerprint", "left_anti")


def apply_part_links(files: DataFrame, versions: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, versions) with followers' versions merged into their leaders': mains after the leader's last part, in order of the followers' paths; sizes, parts and languages anew. Doing it again changes nothing.

    Either end is the lowest version that its content represents; a follower whose contents the leader already has is left out."""
    reps = representatives(files)
    at = reps.groupBy("fingerprint").agg(F.min("version_id").alias("vid"), F.min_by("path", "version_id").alias("path"))
    ends = final_leaders(links).join(at.select(F.col("fingerprint").alias("follower"), F.col("vid").alias("from_id"), F.col("path").alias("from_path")), "follower").join(at.select(F.col("fingerprint").alias("leader"), F.col("vid").alias("to_id")), "leader")
    mains = files.where("role = 'main' and version_id is not null")
    held = mains.where("fingerprint <> ''").select(F.col("version_id").alias("to_id"), F.col("fingerprint").alias("_h")).distinct()
    moves = ends.where("from_id <> to_id").groupBy("from_id").agg(F.min("to_id").alias("to_id"), F.min("from_path").alias("from_path"))
    twice = moves.join(mains.select(F.col("version_id").alias("from_id"), F.col("fingerprint").alias("_h")).distinct(), "from_id").join(held, ["to_id", "_h"], "left_semi").select("from_id").distinct()
    moves = moves.join(twice, "from_id", "left_anti")
    last = mains.groupBy(F.col("version_id").alias("to_id")).agg(F.greatest(F.max("part"), F.lit(1)).alias("_last"))
    w = Window.partitionBy("to_id").orderBy("from_path", "part", "path")
    moved = mains.join(moves.withColumnRenamed("from_id", "version_id"), "version_id").join(last, "to_id").withColumn("_part", F.col("_last") + F.row_number().over(w)).select("path", F.col("to_id").alias("_to"), F.col("_part").cast("int"))
    others = files.where("role <> 'main'").join(moves.withColumnRenamed("from_id", "version_id"), "version_id").select("path", F.col("to_id").alias("_to"), F.lit(None).cast("int").alias("_part"))
    lead = mains.join(moves.select(F.col("to_id").alias("version_id")).distinct(), "version_id", "left_semi").where("part = 0").select("path", F.col("version_id").alias("_to"), F.lit(1).alias("_part"))
    changes = moved.unionByName(others).unionByName(lead)
    new_files = files.join(changes, "path", "left").withColumn("version_id", F.coalesce("_to", "version_id")).withColumn("part", F.coalesce("_part", "part")).select(*files.columns)
    lang = F.when(F.col("role") == "subtitle", F.when(F.col("lang") == "", "?").otherwise(F.col("lang")))
    fresh = new_files.where("version_id is not null").groupBy(F.col("version_id").alias("id")).agg(F.sum(F.when(F.col("role") == "main", F.col("size")).otherwise(0)).alias("_size"), F.count_if(F.col("role") == "main").cast("int").alias("_n"), F.array_join(F.sort_array(F.collect_set(lang)), ",").alias("_langs"))
    touched = moves.select(F.col("to_id").alias("id")).distinct().withColumn("_t", F.lit(True))
    out = versions.join(moves.select(F.col("from_id").alias("id")), "id", "left_anti").join(touched, "id", "left").join(fresh, "id", "left")
    for c, n in (("size", "_size"), ("parts", "_n"), ("sub_langs", "_langs")):
        out = out.withColumn(c, F.when(F.col("_t"), F.col(n)).otherwise(F.col(c)))
    return new_files, out.select(*versions.columns)


# --- lists and collection folders ---


def _taken(lists: DataFrame, name: str, but: int = 0) -> bool:
    return not lists.where((F.lower("name") == name.lower()) & (F.col("id") != but)).isEmpty()


def checked_name(name: str) -> str:
    name = name.strip()
    if not 1 <= len(name) <= 100:
        raise ValueError("a list's name has 1 to 100 characters")
    return name


def create_list(lists: DataFrame, name: str, now: int) -> DataFrame:
    name = checked_name(name)
    if _taken(lists, name):
        raise ValueError("there is a list of that name")
    new = lists.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("id")).select("id", F.lit(name).alias("name"), F.lit(now).cast("long").alias("created_at"), F.lit(now).cast("long").alias("updated_at"))
    return lists.unionByName(new)


def rename_list(lists: DataFrame, list_id: int, name: str, now: int) -> DataFrame:
    name = checked_name(name)
    if _taken(lists, name, list_id):
        raise ValueError("there is a list of that name")
    mine = F.col("id") == list_id
    return lists.withColumn("name", F.when(mine, name).otherwise(F.col("name"))).withColumn("updated_at", F.when(mine, now).otherwise(F.col("updated_at")))


def delete_list(lists: DataFrame, entries: DataFrame, folders: DataFrame, list_id: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Without the list and its entries; folders imported into it lose their link."""
    return lists.where(F.col("id") != list_id), entries.where(F.col("list_id") != list_id), folders.withColumn("list_id", F.when(F.col("list_id") != list_id, F.col("list_id")))


def add_entries(lists: DataFrame, entries: DataFrame, list_id: int, refs: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """(lists, entries): refs that aren't there yet; the list's date changes only if one is added."""
    new = refs.select("ref").distinct().join(entries.where(F.col("list_id") == list_id).select("ref"), "ref", "left_anti").select(F.lit(list_id).cast("long").alias("list_id"), "ref", F.lit(now).cast("long").alias("added_at"))
    return _touched(lists, list_id, now, not new.isEmpty()), entries.unionByName(new)


def remove_entries(lists: DataFrame, entries: DataFrame, list_id: int, refs: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    gone = entries.where(F.col("list_id") == list_id).join(refs.select("ref").distinct(), "ref", "left_semi").select("list_id", "ref")
    return _touched(lists, list_id, now, not gone.isEmpty()), entries.join(gone, ["list_id", "ref"], "left_anti").select(*entries.columns)


def _touched(lists: DataFrame, list_id: int, now: int, changed: bool) -> DataFrame:
    return lists.withColumn("updated_at", F.when(F.col("id") == list_id, now).otherwise(F.col("updated_at"))) if changed else lists


def mark_seen(seen: DataFrame, path: str, fingerprints: DataFrame) -> DataFrame:
    return seen.unionByName(fingerprints.select(F.lit(path).alias("path"), "fingerprint")).distinct()


def import_collection(tables: dict[str, DataFrame], path: str, name: str, list_id: int, fingerprints: DataFrame, now: int) -> dict[str, DataFrame]:
    """lists, list_entries, collection_folders and collection_seen after a folder's contents go to a list (a new one if list_id is 0)."""
    lists = tables["lists"] if list_id else create_list(tables["lists"], name, now)
    if not list_id:
        list_id = lists.agg(F.max("id")).first()[0]
    refs = fingerprints.select(text.ref_fingerprint("fingerprint").alias("ref"))
    lists, entries = add_entries(lists, tables["list_entries"], list_id, refs, now)
    folder = lists.sparkSession.createDataFrame([(path, "imported", list_id, now)], schema.struct("collection_folders"))
    return {"lists": lists, "list_entries": entries, "collection_folders": replaced(tables["collection_folders"], folder, "path"), "collection_seen": mark_seen(tables["collection_seen"], path, fingerprints)}


def dismiss_collection(tables: dict[str, DataFrame], path: str, fingerprints: DataFrame, now: int) -> dict[str, DataFrame]:
    """A folder without a decision is dismissed for good; an imported one keeps its status. Its contents are seen."""
    folders = tables["collection_folders"]
    one = folders.sparkSession.createDataFrame([(path, "dismissed", None, now)], schema.struct("collection_folders"))
    new = one.join(folders.select("path"), "path", "left_anti")
    return {"collection_folders": folders.unionByName(new.select(*folders.columns)), "collection_seen": mark_seen(tables["collection_seen"], path, fingerprints)}


def import_choice(folder_name: str, lists: DataFrame, typed: str, list_id: int = 0) -> DataFrame:
    """kind ('append', 'existing', 'new' or 'invalid') and list id of an import: to the folder's own list, to one of that name, or to a new one."""
    name = (typed or folder_name).strip()
    same = lists.where(F.lower("name") == name.lower()).agg(F.min("id").alias("same"))
    kind = F.when(F.lit(list_id) > 0, "append").when(F.col("same").isNotNull(), "existing").when(F.lit(1 <= len(name) <= 100), "new").otherwise("invalid")
    return same.select(kind.alias("kind"), F.when(F.lit(list_id) > 0, F.lit(list_id)).otherwise(F.coalesce("same", F.lit(0))).cast("long").alias("list_id"), F.lit(name).alias("name"))


def add_first_seen(files: DataFrame) -> DataFrame:
    """Migration: first_seen of an older table is its mtime."""
    return files if "first_seen" in files.columns else files.withColumn("first_seen", F.col("mtime"))
