from collections import Counter

from sluice.llm.shards import fisher_yates, shuffle_into_shards, size_of, write_shards


def dealt(df, **how):
    return [(r["doc_id"], r["text"], r["shard"], r["slot"]) for r in shuffle_into_shards(df, **how).collect()]


def lawful(rows, shards):
    sizes = Counter(r[2] for r in rows)
    assert max(sizes[s] for s in range(shards)) - min(sizes[s] for s in range(shards)) <= 1
    for s in range(shards):
        assert sorted(r[3] for r in rows if r[2] == s) == list(range(sizes[s]))


def test_rows_are_dealt_out_evenly_and_once(spark, documents, odd):
    rows = dealt(documents(odd), shards=3, bucket_bytes=50_000)
    assert Counter(r[:2] for r in rows) == Counter(odd)
    lawful(rows, 3)


def test_order_is_the_same_for_any_partitioning(spark, documents):
    rows = [(i, f"text {i}") for i in range(300)]
    one, other = documents(rows).repartition(7), documents(rows[::-1]).coalesce(2)
    assert sorted(dealt(one, bucket_bytes=500)) == sorted(dealt(other, bucket_bytes=500))
    assert sorted(dealt(one, bucket_bytes=500)) != sorted(dealt(one, bucket_bytes=500, seed=12))


def test_order_is_not_that_of_the_input(spark, documents):
    rows = sorted(dealt(documents([(i, "t") for i in range(400)]), shards=1), key=lambda r: r[3])
    ids = [r[0] for r in rows]
    assert ids != sorted(ids)
    assert abs(sum(a < b for a, b in zip(ids, ids[1:])) - 200) < 60


def test_a_key_of_most_rows_is_spread(spark, documents):
    rows = [(None, "same")] * 6000 + [(i, "own") for i in range(3000)]
    found = dealt(documents(rows), shards=4, bucket_bytes=2000)
    assert Counter(r[:2] for r in found) == Counter(rows)
    lawful(found, 4)


def test_empty_table_sizes_and_files(spark, documents, tmp_path):
    assert dealt(documents([])) == []
    df = documents([(1, None), (2, "é")])
    assert [r[0] for r in df.select(size_of(df.text)).collect()] == [1, 3]
    write_shards(shuffle_into_shards(df, shards=2), str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == 2


def test_permutations_are_fair():
    assert sorted(fisher_yates(50, 1, 2)) == list(range(50))
    seen = Counter(tuple(fisher_yates(3, 5, b)) for b in range(3000))
    assert len(seen) == 6 and min(seen.values()) > 400
    assert list(fisher_yates(0, 1, 1)) == [] and list(fisher_yates(1, 1, 1)) == [0]


def test_equal_to_a_plain_rebuild_of_both_passes(spark, documents, odd, monkeypatch):
    from pyspark.sql import functions as F

    from sluice.llm import shards

    monkeypatch.setattr(shards, "BLOCK_BUCKETS", 3)
    df = documents(odd + [(100 + i, f"text {i}") for i in range(200)])
    total = sum(len((t or "").encode()) + 1 for t in [r["text"] for r in df.collect()])
    buckets = -(-total // 9000)
    hashed = df.select("doc_id", "text", F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(buckets)).alias("b"), F.xxhash64("text").alias("h")).collect()
    expected, before = [], 0
    for b in range(buckets):
        own = sorted((r for r in hashed if r["b"] == b), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["h"]))
        for place, at in enumerate(fisher_yates(len(own), 11, b).tolist(), before):
            expected.append((own[at]["doc_id"], own[at]["text"], place % 5, place // 5))
        before += len(own)
    assert buckets > 9
    assert sorted(dealt(df, shards=5, bucket_bytes=9000), key=str) == sorted(expected, key=str)
