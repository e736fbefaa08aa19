from datetime import datetime, timedelta, timezone

from docloom.streaming import rescrape

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def at(minutes):
    return START + timedelta(minutes=minutes)


def write(spark, rows, folder):
    spark.createDataFrame([(u, c, None if m is None else at(m)) for u, c, m in rows], "u string, c string, t timestamp").coalesce(1).write.mode("append").parquet(folder)


def tidy(rows):
    return sorted(((u, float(m), *x, float(f)) for u, m, *x, f in rows), key=str)


def go(spark, folder):
    stream = spark.readStream.schema("u string, c string, t timestamp").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    out = rescrape.visits(stream, "u", "c", "t", timedelta(hours=1), "10 minutes")
    rescrape.run(spark, out, f"{folder}/out", f"{folder}/checkpoint")
    rows = spark.read.schema(out.schema).parquet(f"{folder}/out").selectExpr("*", "unix_micros(first_seen) AS f", "unix_micros(last_seen) AS l").collect()
    minute = lambda x: (x - int(START.timestamp()) * 1_000_000) / 60e6
    return sorted(((r.url, minute(r.l), r.change, r.content, r.attempts, minute(r.f)) for r in rows), key=str)


def test_restarts_late_rows_and_removals(spark, tmp_path):
    folder = f"file://{tmp_path}"
    write(spark, [("a", "1", 0), ("a", "1", 10), ("b", "x", 5), ("a", "1", 10), (None, "1", 3), ("d", "1", None), ("c", None, 6)], f"{folder}/in")
    first = [("a", 0, "new", "1", 1, 0), ("a", 10, "unchanged", "1", 2, 0), ("b", 5, "new", "x", 1, 5), ("c", 6, "new", None, 1, 6)]
    assert go(spark, folder) == tidy(first)
    # restarted: a changes, an older row of a is repeated, b comes back after it was gone
    write(spark, [("a", "2", 20), ("a", "9", 4), ("b", "x", 200)], f"{folder}/in")
    second = [*first, ("a", 20, "updated", "2", 3, 0), ("b", 5, "removed", "x", 1, 5), ("b", 200, "new", "x", 1, 200)]
    # the watermark (190) has passed a's and c's hour
    second += [("a", 20, "removed", "2", 3, 0), ("c", 6, "removed", None, 1, 6)]
    assert go(spark, folder) == tidy(second)
    # behind the watermark: dropped
    write(spark, [("a", "3", 21)], f"{folder}/in")
    assert go(spark, folder) == tidy(second)
    write(spark, [("a", "3", 230), ("e", "1", 400)], f"{folder}/in")
    third = [*second, ("a", 230, "new", "3", 1, 230), ("e", 400, "new", "1", 1, 400), ("a", 230, "removed", "3", 1, 230), ("b", 200, "removed", "x", 1, 200)]
    assert go(spark, folder) == tidy(third)


def test_replay_deals_a_piece_over_tasks(spark, tmp_path):
    import glob

    from pyspark.sql import functions as F

    rows = spark.range(1000).select(F.timestamp_seconds(F.col("id") * 60).alias("ts"), "id")
    stream = rescrape.replay(rows, "ts", f"{tmp_path}/in", rows_per_file=100)
    files = sorted(glob.glob(f"{tmp_path}/in/*.parquet"), key=lambda p: spark.read.parquet(p).agg(F.min("id")).first()[0])
    assert len(files) == 2 * min(4, spark.sparkContext.defaultParallelism)
    first = {r.id for p in files[: len(files) // 2] for r in spark.read.parquet(p).collect()}
    assert max(first) < 500 and len(first) == 500 and stream.isStreaming
