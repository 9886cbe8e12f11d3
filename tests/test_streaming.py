"""Counts of a stream against those of the table."""

from pyspark.sql import functions as F

from roomweave.operators import voxels
from roomweave.plans.queries import evpts
from roomweave.streaming import confidence
from roomweave.streaming.counts import voxel_counts


def test_counts(spark, sf_dir, tmp_path):
    rows = evpts(spark, sf_dir).select("pid", "x", "y", "z", F.col("ts").cast("timestamp").alias("ts"))
    # In the order of time, and one late row far ahead that closes all windows before it.
    last = rows.agg(F.max("ts")).first()[0]
    rows.repartitionByRange(3, "ts").sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    end = spark.sql(f"SELECT -1L AS pid, 0D AS x, 0D AS y, 0D AS z, TIMESTAMP '{last}' + INTERVAL 2 DAYS AS ts")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out, at = str(tmp_path / "out"), str(tmp_path / "state")
    start = lambda: voxel_counts(stream, 0.5, late="100 days").writeStream.format("parquet").option("checkpointLocation", at).outputMode("append").trigger(availableNow=True).start(out).awaitTermination()
    start()
    end.select(*(F.col(c).cast(t).alias(c) for c, t in rows.dtypes)).withColumn("ts", F.expr("ts + INTERVAL 200 DAYS")).write.mode("append").parquet(str(tmp_path / "in"))
    start()
    start()
    want = rows.groupBy(F.window("ts", "1 hour").start.alias("start"), *(F.floor(F.col(c) / 0.5).alias(n) for n, c in zip("ijk", "xyz"))).agg(F.count("*").alias("n"))
    got = spark.read.parquet(out)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_confidence(spark, sf_dir, tmp_path):
    """After each micro-batch the map is that of all points so far; a row behind the watermark does not count, and a started-again stream goes on."""
    rows = evpts(spark, sf_dir).select("pid", "x", "y", "z", F.col("ts").cast("timestamp").alias("ts")).checkpoint()
    shape = voxels.grid(rows, 0.5).checkpoint()
    cameras = rows.where("pid % 50 = 0").select("x", "y", "z", F.lit(0.0).alias("fx"), F.lit(0.0).alias("fy"), F.lit(1.0).alias("fz"))
    covered = voxels.coverage(cameras, shape, 0.5, 1.0).select("i", "j", "k", "coverage").checkpoint()
    folder, ordered = str(tmp_path / "in"), rows.orderBy("ts", "pid").collect()
    late = rows.agg(F.min("ts")).first()[0]
    cuts = [0, len(ordered) // 2, len(ordered) - 10, len(ordered)]
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(rows.schema).parquet(folder)
    for k in range(3):
        part = ordered[cuts[k] : cuts[k + 1]]
        extra = spark.createDataFrame(part, rows.schema)
        if k == 2:  # the watermark has passed the first rows long ago
            extra = extra.unionByName(spark.createDataFrame([(-1, part[0].x, part[0].y, part[0].z, late)] * 50, rows.schema))
        extra.coalesce(1).write.mode("append").parquet(folder)
        changed = confidence.running_counts(stream, shape, 0.5, late="1 second")
        confidence.keep_confidence(changed, str(tmp_path / "out"), covered).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        versions = sorted(int(p.name) for p in (tmp_path / "out").iterdir())
        sofar = spark.createDataFrame(ordered[: cuts[k + 1]], rows.schema)
        want = voxels.confidence(voxels.density(sofar, shape, 0.5), covered)
        got = confidence.version(spark, str(tmp_path / "out"), versions[-1])
        plain = lambda df: sorted((r.i, r.j, r.k, round(r.confidence, 9)) for r in df.collect())
        assert plain(got) == plain(want)
