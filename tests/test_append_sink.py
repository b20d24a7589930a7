"""Appending CSV in commits: attempts that fail leave nothing, and nothing is there twice."""

import csv
import os

import pytest
from pyspark.sql import functions as F

from topicweave.sources.append_sink import BOM, append_committed
from topicweave.sources.csv_tables import read_csv

ROWS = [(1, 'a "quoted"\nline', "x"), (2, "", None), (3, "é, semi;", "y")]


def files(path):
    return sorted(os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs)


def test_round_trip(spark, tmp_path):
    path = str(tmp_path / "out")
    frame = spark.createDataFrame(ROWS, "id long, text string, lang string")
    append_committed(frame.coalesce(1), path)
    append_committed(frame.withColumn("id", F.col("id") + 10).repartition(3), path)
    append_committed(frame.limit(0), path)
    for f in files(path):
        lines = open(f, encoding="utf-8", newline="").read()
        assert lines.startswith(BOM + '"id","text","lang"\n') and all(len(r) == 3 for r in csv.reader(lines.splitlines(keepends=True)))
    got = sorted(tuple(r) for r in read_csv(spark, path, frame.schema, glob="*.csv").collect())
    assert got == sorted([(i + k, t or None, x) for k in (0, 10) for i, t, x in ROWS])


def test_a_failing_job_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    frame = spark.createDataFrame([(i, "t") for i in range(40)], "id long, text string").repartition(4)
    append_committed(frame, path)
    before = files(path)
    with pytest.raises(Exception):
        append_committed(frame.withColumn("text", F.when(F.col("id") == 7, F.raise_error(F.lit("lost"))).otherwise(F.col("text"))), path)
    assert files(path) == before and read_csv(spark, path, frame.schema, glob="*.csv").count() == 40


def test_leftovers_of_an_attempt_are_not_committed(tmp_path):
    """Two attempts of one task write; only the one whose message arrives is moved."""
    import pyarrow as pa
    from pyspark.sql.types import LongType, StructField, StructType

    from topicweave.sources.append_sink import AppendWriter

    writer = AppendWriter(StructType([StructField("id", LongType())]), str(tmp_path / "out"))
    batch = pa.RecordBatch.from_pydict({"id": [1, 2]})
    first, again = writer.write(iter([batch])), writer.write(iter([batch]))
    assert first.file != again.file and again.rows == 2
    writer.commit([again, None])
    assert [os.path.basename(f) for f in files(tmp_path / "out")] == [again.file]
    assert not os.path.exists(tmp_path / "out" / "_pending" / writer.job)
