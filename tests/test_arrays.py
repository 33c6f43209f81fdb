"""JSON arrays read by byte range equal the same files read whole."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sluice.sources import arrays
from sluice.sources.arrays import array_items
from sluice.sources.declared import Format, scan_declared

TEXTS = ['plain', '}', '{', '"', '\\', '\\"', '}{"a":[', ']', '[', '\\\\', 'é 門 😀', '\n\t', '"}]', '\\"}', '', ',', '{"x":"\\""}', ' }']


def record(rng, depth=0):
    value = {"id": rng.randrange(10**6), "t": rng.choice(TEXTS) * rng.randint(0, 4), "l": [rng.choice(TEXTS) for _ in range(rng.randint(0, 4))]}
    if depth < 3 and rng.random() < 0.5:
        value["o"] = record(rng, depth + 1)
    if rng.random() < 0.2:
        value[rng.choice(TEXTS)] = None
    return value


@pytest.fixture
def small_blocks(spark):
    """Files are cut into blocks of a few bytes."""
    names = {"spark.sql.files.maxPartitionBytes": None, "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in names}

    def cut(size):
        for k, v in names.items():
            spark.conf.set(k, v or str(size))

    yield cut
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def items(spark, path):
    return sorted(json.dumps(json.loads(r["item"]), sort_keys=True) for r in array_items(spark, str(path)).collect())


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("size", [1 << 20, 300, 37])
def test_blocks_may_begin_anywhere(spark, tmp_path, small_blocks, indent, size):
    rng = random.Random(size)
    every = [record(rng) for _ in range(60)]
    for i, ascii_ in enumerate((True, False)):
        (tmp_path / f"f{i}.json").write_text(json.dumps(every[30 * i : 30 * i + 30], indent=indent, ensure_ascii=ascii_), "utf-8")
    small_blocks(size)
    assert items(spark, tmp_path) == sorted(json.dumps(r, sort_keys=True) for r in every)


def test_an_object_may_span_many_blocks(spark, tmp_path, small_blocks):
    every = [{"id": 1, "t": "x} " * 2000}, {"id": 2, "t": [{"a": i} for i in range(900)]}, {"id": 3}]
    (tmp_path / "f.json").write_text(json.dumps(every))
    small_blocks(256)
    assert items(spark, tmp_path) == sorted(json.dumps(r, sort_keys=True) for r in every)


def test_a_long_array_is_read_by_many_tasks(spark, tmp_path, small_blocks):
    rng = random.Random(1)
    some = [record(rng) for _ in range(500)]
    body = ",\n".join(json.dumps(some[i % 500] | {"id": i}) for i in range(60_000))
    (tmp_path / "f.json").write_text(f"[{body}]")
    small_blocks(64 << 10)
    found = array_items(spark, str(tmp_path))
    size = (tmp_path / "f.json").stat().st_size
    tasks = found.select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks > size / (64 << 10) / 2 > 40
    schema = "id bigint, t string, l array<string>"
    ours = found.select(F.from_json("item", schema).alias("r")).select("r.*")
    whole = spark.read.schema(schema).option("multiLine", True).json(str(tmp_path))
    mark = [F.count("*"), F.bit_xor(F.xxhash64("id", "t", "l")), F.sum("id")]
    assert ours.agg(*mark).first() == whole.agg(*mark).first()


def test_states_may_be_joined_by_a_shuffle(spark, tmp_path, small_blocks, monkeypatch):
    rng = random.Random(3)
    every = [record(rng) for _ in range(80)]
    (tmp_path / "f.json").write_text(json.dumps(every))
    small_blocks(200)
    monkeypatch.setattr(arrays, "SENT", 0)
    assert items(spark, tmp_path) == sorted(json.dumps(r, sort_keys=True) for r in every)


@pytest.mark.parametrize("text, found", [
    ("[]", []), (" [ ] \n", []), ('[{}]', ["{}"]), ('{"a": 1}', ['{"a": 1}']), ('{"a": 1}\n', ['{"a": 1}']), ('\n[ {"a": "}"} , {"a": 2} ]\n\n', ['{"a": "}"}', '{"a": 2}']),
])
def test_small_files(spark, tmp_path, text, found):
    (tmp_path / "f.json").write_text(text)
    assert items(spark, tmp_path) == sorted(found)


@pytest.mark.parametrize("text", ['[{"a": 1}', '[{"a": 1', '[{"a": "x', '[1, 2]', '[{"a": 1}, 2]', '[[{"a": 1}]]', '[{"a": 1}, null]', '[{"a": 1}]]', '[{"a": 1}} ]'])
def test_broken_files_end_the_job(spark, tmp_path, text):
    (tmp_path / "f.json").write_text(text)
    with pytest.raises(Exception, match="JSON array"):
        items(spark, tmp_path)


def test_a_declared_format_reads_arrays(spark, tmp_path, small_blocks):
    rows = [{"k": i, "s": f"a}} {i}", "at": "2024-05-01T00:00:00Z"} for i in range(300)]
    (tmp_path / "f.json").write_text(json.dumps(rows))
    small_blocks(500)
    fmt = Format(spark.createDataFrame([], "k bigint, s string, at timestamp").schema)
    found = scan_declared(spark, fmt, str(tmp_path))
    assert sorted((r["k"], r["s"], r["at"].isoformat()) for r in found.collect()) == [(i, f"a}} {i}", "2024-05-01T00:00:00") for i in range(300)]
    (tmp_path / "f.json").write_text('[{"k": "not a number", "s": "x", "at": null}]')
    with pytest.raises(Exception):
        scan_declared(spark, fmt, str(tmp_path)).collect()


def test_objects_are_cut_as_one_array():
    cutter = arrays.Cutter(False, 0, 1)
    parts, objects = cutter.cut(b'[{"a": 1},\n{"a": "}"} , {"a": 3')
    assert parts == [] and objects.to_pylist() == [b'{"a": 1}', b'{"a": "}"}']
    parts, objects = cutter.cut(b'}, {"a": {"b": 4}}, {')
    assert parts == [("whole", b'{"a": 3}')] and objects.to_pylist() == [b'{"a": {"b": 4}}']
    assert cutter.rest() == [("tail", b"{")]
