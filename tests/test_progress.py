import threading
import time

from pyspark.sql import functions as F

from termloom.plans.profile import profile
from termloom.plans.progress import watching
from termloom.sources.readers import load
from termloom.streaming.ingest import read_files, running_counts


def test_tasks_of_a_running_job(spark):
    """Numbers arrive while one job runs, rise, and end with all tasks; no job runs for them."""

    def slow(batches):
        for b in batches:
            time.sleep(0.4)
            yield b

    told, done = [], []
    df = spark.range(0, 16, 1, 16).mapInPandas(slow, "id long")
    with watching(spark, lambda a, b: told.append((a, b, len(done))), 0.05):
        df.write.format("noop").mode("overwrite").save()
        done.append(1)
    assert told[-1][:2] == (16, 16) and [t[:2] for t in told] == sorted(t[:2] for t in told)
    assert sum(t[2] == 0 and 0 < t[0] < 16 for t in told) >= 2


def test_rows_come_from_the_job_that_reads(spark, tmp_path):
    spark.range(1000).write.parquet(str(tmp_path / "t.parquet"))
    told, come = [], threading.Event()
    df = load(spark, str(tmp_path / "t.parquet"), progress=lambda n: (told.append(n), come.set()))
    time.sleep(0.3)
    assert not told  # nothing has run
    assert df.agg(F.sum("id")).first()[0] == 499500
    assert come.wait(10) and told == [1000]


def test_rows_of_a_stream(spark, tmp_path):
    spark.range(300).selectExpr("id % 3 as k").repartition(5).write.parquet(str(tmp_path / "in"))
    told = []
    counts = running_counts(read_files(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema), "k", str(tmp_path / "out"), told.append)
    assert {r["k"]: r["n"] for r in counts.collect()} == {0: 100, 1: 100, 2: 100}
    assert told == sorted(told) and told[-1] == 300 and len(told) == 5


def test_profile_tells_finished_work(spark):
    df = spark.createDataFrame([(i, f"2024-01-{i:02d}", i * 1.5, "ab"[i % 2]) for i in range(1, 29)], "id long, data string, valor double, x string")
    told = []
    found = profile(df, progress=lambda a, b: told.append((a, b)))
    assert told == [(1, 3), (2, 3), (3, 3)]
    assert found.dates.first()["max"] == "2024-01-28 00:00:00" and found.tables.count() == 2
