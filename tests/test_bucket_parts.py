"""A bucket beyond the rows of a part is written by several tasks, and merges give what they gave."""

from pyspark.sql import functions as F

from siftwell.operators import buckets, lifecycle
from siftwell.schemas import STORED, conform
from siftwell.sources.folders import children


def test_large_buckets_are_written_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(buckets, "PART_ROWS", 50, raising=False)
    folder, day = f"file://{tmp_path}/corpus", F.lit("2024-03-01").cast("timestamp")
    rows = spark.range(1000).select(F.col("id").cast("string").alias("id"), F.lit("old").alias("title"), F.lit(True).alias("desc_available"), F.lit("text").alias("description"))
    buckets.create(conform(rows.withColumns({"first_seen": day, "last_seen": day}), STORED), folder, buckets=2)
    fetch = conform(rows.where("id % 2 = 0").union(rows.limit(10).withColumn("id", F.concat(F.lit("n"), "id"))).withColumn("title", F.lit("new")), STORED.split(", first_seen")[0])
    head = buckets.merge_into(fetch, folder, day)
    for at in {f"{folder}/data/{run}" for version in buckets.versions(spark, folder) for run in buckets.manifest(spark, folder, version).folders()}:
        files = [name for name in children(spark, at) if name.endswith(".parquet")]
        counts = [spark.read.parquet(f"{at}/{name}").count() for name in files]
        assert len(files) > 3 and max(counts) < 300, counts  # some 500 rows in parts of 50, of which some share a task
    assert head.version == 2
    got = {r["id"]: r["title"] for r in buckets.read(spark, folder).collect()}
    assert len(got) == 1010 == buckets.read(spark, folder).count()
    assert all(got[str(i)] == ("new" if i % 2 == 0 else "old") for i in range(1000)) and sum(k.startswith("n") for k in got) == 10


def test_a_fetch_is_dealt_out_before_rows_are_picked(spark):
    """The sort of the first aggregate is over a shuffle's partition, not over a part of a file."""
    rows = conform(spark.range(10).select(F.col("id").cast("string").alias("id"), F.lit(True).alias("desc_available")), STORED)
    plan = lifecycle.merge(rows, conform(rows, STORED.split(", first_seen")[0]), F.lit("2024-03-01").cast("timestamp"))._jdf.queryExecution().optimizedPlan().toString()
    picked = plan.index("Aggregate [id")
    assert "RepartitionByExpression [id" in plan[picked : picked + 2000]
