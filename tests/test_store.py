import json
import threading

import pytest
from pyspark.sql import functions as F

from termloom.sources import readers, sinks
from termloom.streaming.ingest import KEPT, latest, publish


def test_two_sessions(spark, tmp_path):
    """What one session publishes another reads; old versions go, readers of the one before still can."""
    place, other = f"file://{tmp_path}/store", spark.newSession()
    assert latest(other, place) is None
    publish(spark.range(3), place)
    before = latest(other, place)
    publish(spark.range(7), place)
    assert (before.count(), latest(other, place).count()) == (3, 7)
    for n in range(5):
        publish(spark.range(n), place)
    assert len([p for p in (tmp_path / "store").iterdir() if p.is_dir()]) == KEPT and latest(other, place).count() == 4


def test_old_or_new_never_half(spark, tmp_path):
    place, seen, stop = str(tmp_path / "store"), set(), threading.Event()
    publish(spark.range(0, 100, 1, 4), place)

    def read():
        other = spark.newSession()
        while not stop.is_set():
            seen.add(latest(other, place).count())

    thread = threading.Thread(target=read)
    thread.start()
    publish(spark.range(0, 200, 1, 4), place)
    publish(spark.range(0, 300, 1, 4), place)
    with pytest.raises(Exception):  # a write that fails leaves the latest
        publish(spark.range(5).select(F.raise_error(F.lit("no")).cast("string").alias("x")), place)
    stop.set()
    thread.join()
    assert seen <= {100, 200, 300} and latest(spark, place).count() == 300


@pytest.mark.parametrize("body,refused", [(None, True), ("", True), (" \n", True), ("{}", True), ("[ ]", True), ("null", True), ("0", True), ('""', True), ("{", True), ('{"a": 1}', False), ('{"coluna": "x", "tabela": []}', False)])
def test_received(spark, body, refused):
    row = spark.createDataFrame([(body,)], "b string").select(readers.received(F.col("b")).alias("r")).first()["r"]
    assert row["refused"] is refused and (row["report"] is None) == refused


def test_header_is_one_file(spark, tmp_path):
    sinks.write_header(spark.createDataFrame([("é", 3, None)], "id_coluna string, total_linhas long, total_colunas int"), str(tmp_path / "h.json"))
    text = (tmp_path / "h.json").read_text()
    assert json.loads(text) == {"id_coluna": "é", "total_linhas": 3, "total_colunas": None} and text.count("\n") == 4 and "é" in text


def test_max_rows(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n" + "1,2\n" * 20)
    path = str(tmp_path / "t.csv")
    assert readers.validate_file(spark, path, max_rows=20) and readers.validate_file(spark, path)
    with pytest.raises(ValueError):
        readers.validate_file(spark, path, max_rows=19)
    with pytest.raises(ValueError):
        readers.validate_file(spark, path, max_size_mb=1e-6)
