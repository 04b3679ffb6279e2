"""A corpus in hash buckets of the id, whose merges rewrite only the buckets that a fetch touches.

A bucket's rows are files of one run; a manifest, written last and numbered, names each bucket's run. Readers take the newest
whole manifest, so they see all of a merge or nothing of it. A merge copies the manifest and replaces the touched buckets' runs; the
files of all other buckets stay where they are. Streams name themselves and their epoch in the manifest, so an epoch
that comes again changes nothing. The last ``keep`` manifests stay; with an older one go the runs' buckets that no later one
names. One writer at a time: a second one fails on the manifest's number.

Bucket count is the table's own and bounds what the driver sees: choose it so that a bucket is some hundred megabytes. A larger bucket is written by
several tasks, of about ``PART_ROWS`` rows each, as a file each.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import STORED, conform
from ..sources.folders import children, exists, remove
from .lifecycle import merge

BUCKETS, KEEP = 64, 3
#: Rows of a bucket that one task sorts and writes.
PART_ROWS = 100_000


@dataclass
class Manifest:
    """What one version of the table is made of."""

    version: int
    buckets: int
    runs: dict[int, str] = field(default_factory=dict)
    epochs: dict[str, int] = field(default_factory=dict)

    def folders(self) -> set[str]:
        return {f"run={run}/bucket={b}" for b, run in self.runs.items()}


def _place(buckets: int) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the whole manifests, oldest first."""
    found = (int(name[2:]) for name in children(spark, f"{folder}/manifest") if name.startswith("v="))
    return sorted(v for v in found if exists(spark, f"{folder}/manifest/v={v}/_SUCCESS"))


def manifest(spark: SparkSession, folder: str, version: int | None = None) -> Manifest:
    """The newest version's manifest, or that of a version: a row per bucket comes to the driver."""
    version = versions(spark, folder)[-1] if version is None else version
    out = Manifest(version, 0)
    for r in spark.read.schema("bucket int, run string, buckets int, epochs map<string,long>").parquet(f"{folder}/manifest/v={version}").collect():
        out.buckets, out.epochs = r["buckets"], r["epochs"] or {}
        if r["run"]:
            out.runs[r["bucket"]] = r["run"]
    return out


def _commit(spark: SparkSession, folder: str, new: Manifest, keep: int) -> None:
    rows = [(b, run, new.buckets, new.epochs) for b, run in sorted(new.runs.items())] or [(0, None, new.buckets, new.epochs)]
    frame = spark.createDataFrame(rows, "bucket int, run string, buckets int, epochs map<string,long>")
    frame.coalesce(1).write.parquet(f"{folder}/manifest/v={new.version}")
    known = versions(spark, folder)
    kept, gone = known[-keep:], known[:-keep]
    if gone:
        used = set().union(*(manifest(spark, folder, v).folders() for v in kept))
        for v in gone:
            for old in sorted(manifest(spark, folder, v).folders() - used):
                remove(spark, f"{folder}/data/{old}")
            remove(spark, f"{folder}/manifest/v={v}")


def _write(rows: DataFrame, folder: str, buckets: int, most: int, count: int) -> str:
    """Rows, ``most`` of them at most and in ``count`` buckets, as the files of a new run, by bucket; its name."""
    run = uuid.uuid4().hex
    parts = -(-most // (max(count, 1) * PART_ROWS))
    placed = rows.withColumn("bucket", _place(buckets))
    part = F.pmod(F.xxhash64("id", F.lit("part")), F.lit(parts))  # other bits than those of the bucket
    dealt = placed.repartition("bucket") if parts <= 1 else placed.repartition(count * parts, "bucket", part)
    dealt.write.partitionBy("bucket").parquet(f"{folder}/data/run={run}")
    return run


def create(rows: DataFrame, folder: str, buckets: int = BUCKETS, schema: str = STORED) -> None:
    """A new table of ``rows``."""
    spark = rows.sparkSession
    run = _write(conform(rows, schema), folder, buckets, rows.count(), buckets)
    written = [int(name.split("=")[1]) for name in children(spark, f"{folder}/data/run={run}") if name.startswith("bucket=")]
    _commit(spark, folder, Manifest(1, buckets, dict.fromkeys(written, run)), KEEP)


def _rows(spark: SparkSession, folder: str, head: Manifest, schema: str, only: set[int] | None = None) -> DataFrame:
    paths = [f"{folder}/data/run={run}/bucket={b}" for b, run in sorted(head.runs.items()) if only is None or b in only]
    if not paths:
        return spark.createDataFrame([], schema)
    return conform(spark.read.schema(schema).parquet(*paths), schema)


def read(spark: SparkSession, folder: str, schema: str = STORED) -> DataFrame:
    """The newest version; columns added since a bucket was written are filled in."""
    return _rows(spark, folder, manifest(spark, folder), schema)


def merge_into(fetch: DataFrame, folder: str, now: Column, close: bool = False, stream: str = "", epoch: int | None = None, keep: int = KEEP, schema: str = STORED) -> Manifest:
    """Merge a fetch (see ``lifecycle.merge``) as a new version; the manifest then.

    Only buckets that hold an id of the fetch are read, joined and written. ``close`` closes open rows that the fetch lacks, which touches every bucket.
    A ``stream``'s ``epoch`` that is merged already, or a fetch without rows that closes nothing, changes nothing.
    """
    spark = fetch.sparkSession
    head = manifest(spark, folder)
    if epoch is not None and epoch <= head.epochs.get(stream, -1):
        return head
    came = dict(map(tuple, fetch.groupBy(_place(head.buckets).alias("bucket")).count().collect()))  # at most a row per bucket
    touched = set(came)
    if close:
        touched |= set(head.runs)
    if not touched:
        return head
    had = _rows(spark, folder, head, schema, touched)
    run = _write(merge(had, fetch, now, close), folder, head.buckets, had.count() + sum(came.values()), len(touched))
    epochs = head.epochs if epoch is None else {**head.epochs, stream: epoch}
    new = Manifest(head.version + 1, head.buckets, {**head.runs, **dict.fromkeys(touched, run)}, epochs)
    _commit(spark, folder, new, keep)
    return new
