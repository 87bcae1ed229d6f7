"""Continuous ingestion: listings that arrive as files are folded into the catalog batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.operators.mutate import Catalog, sync_files
from lumenframe.sources.listing import scan

LISTING = "path string, size long, mtime long, kind string, fingerprint string"


def ingest(spark: SparkSession, source: str, catalog_path: str, checkpoint: str, roots: list[str], hashing: bool = False, now=None):
    """Run all listings that there are and stop. Each batch upserts files by path; a batch that is run again after a failure gives the same table.

    hashing: fingerprints of changed files are read from the files (the listing's own are used otherwise). now: the date
    (ms) of new files; if unset, that of the batch's latest listing file, which is the same when a batch is run again."""
    listings = spark.readStream.schema(LISTING).json(source).select("*", F.unix_millis("_metadata.file_modification_time").alias("_at"))

    def fold(batch: DataFrame, number: int) -> None:
        catalog = Catalog(spark, catalog_path)
        files = catalog.read("files")
        latest = batch.groupBy("path").agg(F.max_by(F.struct("size", "mtime", "kind", "fingerprint"), "mtime").alias("x")).select("path", "x.*")
        seen = scan(latest, files) if hashing else latest
        at = batch.agg(F.max("_at")).first()[0] if now is None else now
        if at is None:  # no listing at all
            return
        # one file's listing isn't a whole scan: nothing is missing because of it
        catalog.commit(files=sync_files(files, seen, [], at))

    q = listings.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(fold).start()
    q.awaitTermination()
    return Catalog(spark, catalog_path)
