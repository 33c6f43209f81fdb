"""Sinks written by users: what counts is what commit was told."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

from sluice.semantics import scratch_path
from sluice.sinks.partitioned import FilesSink, PartitionSink, refill_partitions


def content(spark, sink):
    return sorted(r["id"] for r in sink.read(spark, "id bigint").collect())


def test_every_partition_is_written_where_it_is_and_replaced_whole(spark):
    sink = FilesSink(scratch_path(spark, "sink"))
    refill_partitions(spark.range(0, 1000, 1, 7), sink)
    assert content(spark, sink) == list(range(1000)) and len(sink.files()) == 7
    refill_partitions(spark.range(0, 10, 1, 2), sink)
    assert content(spark, sink) == list(range(10)) and len(sink.files()) == 2


def test_an_empty_table_empties_the_content(spark):
    sink = FilesSink(scratch_path(spark, "sink"))
    with pytest.raises(FileNotFoundError):
        sink.read(spark, "id bigint")
    refill_partitions(spark.range(3), sink)
    refill_partitions(spark.range(0), sink)
    assert content(spark, sink) == [] and sink.files() == []


def test_a_failing_task_leaves_the_old_content(spark):
    class Failing(FilesSink):
        """Writes its rows, then fails in the partition that has row 5."""

        def write(self, batches):
            held = list(batches)
            name = super().write(iter(held))
            if any(5 in b.column("id").to_pylist() for b in held):
                raise ValueError("the sink refused row 5")
            return name

    folder = scratch_path(spark, "sink")
    refill_partitions(spark.range(100, 110), FilesSink(folder))
    before = FilesSink(folder).files()
    with pytest.raises(Exception, match="refused row 5"):
        refill_partitions(spark.range(0, 40, 1, 4), Failing(folder))
    assert FilesSink(folder).files() == before and content(spark, FilesSink(folder)) == list(range(100, 110))


def test_messages_travel_to_the_driver(spark, tmp_path):
    class Counting(PartitionSink):
        def __init__(self, seen):
            self.seen = seen

        def write(self, batches):
            return sum(b.num_rows for b in batches)

        def commit(self, messages):
            Path(self.seen).write_text(",".join(map(str, sorted(messages))))

    refill_partitions(spark.range(0, 90, 1, 3), Counting(str(tmp_path / "seen")))
    assert (tmp_path / "seen").read_text() == "30,30,30"


RETRIED = """
import os, sys
from pyspark import TaskContext
from pyspark.sql import SparkSession
from sluice.sinks.partitioned import FilesSink, refill_partitions

class Stumbling(FilesSink):
    def write(self, batches):
        name = super().write(batches)
        if TaskContext.get().attemptNumber() == 0:
            raise ValueError("first attempts fail after they have written")
        return name

spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").getOrCreate()
sink = Stumbling(sys.argv[1])
refill_partitions(spark.range(0, 50, 1, 5), sink)
print("ROWS", sorted(r["id"] for r in sink.read(spark, "id bigint").collect()) == list(range(50)), len(sink.files()), len(os.listdir(sys.argv[1] + "/files")))
"""


def test_a_retried_task_writes_once(tmp_path):
    script = tmp_path / "retried.py"
    script.write_text(RETRIED)
    root = str(Path(__file__).resolve().parent.parent)
    done = subprocess.run([sys.executable, str(script), str(tmp_path / "sink")], env={**os.environ, "PYTHONPATH": root}, capture_output=True, text=True, timeout=180)
    # ten files are there, five of them of attempts that failed
    assert "ROWS True 5 10" in done.stdout, done.stderr[-2000:]
