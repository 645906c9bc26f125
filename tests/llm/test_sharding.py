import zlib
from collections import Counter

from kgweave.llm.sharding import op10_shards, shard_rows, write_shards


def test_shards(spark, odd, nothing, sf):
    out = op10_shards(spark, sf(odd)).collect()
    assert len(out) == odd.count()
    size = Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in odd.collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == size
    for s in {r.shard for r in out}:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    assert op10_shards(spark, sf(nothing)).count() == 0


def test_order_is_a_seeded_permutation(spark):
    df = spark.range(5000).withColumnRenamed("id", "doc_id")
    a = {r.doc_id: (r.shard, r.slot, r.grown_shard) for r in shard_rows(df, "doc_id", shards=3, bucket_rows=100).collect()}
    assert a == {r.doc_id: (r.shard, r.slot, r.grown_shard) for r in shard_rows(df.repartition(5), "doc_id", shards=3, bucket_rows=100).collect()}
    assert len({v[:2] for v in a.values()}) == 5000
    assert all(g in (s, 3) for s, _, g in a.values()) and 800 < sum(g == 3 for _, _, g in a.values()) < 1700
    rows = sorted((s, slot, d) for d, (s, slot, _) in a.items())
    rises = sum(x[2] < y[2] for x, y in zip(rows, rows[1:]))
    assert 2200 < rises < 2800


def test_one_key_repeated_and_written(spark, tmp_path):
    df = spark.range(3000).selectExpr("if(id < 2000, 7, id) doc_id", "if(id < 2000, 'same', concat('t', id)) text")
    out = shard_rows(df, "doc_id", shards=2, bucket_rows=50)
    write_shards(out, f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == 3000 and back.select("shard", "slot").distinct().count() == 3000
    assert back.filter("doc_id = 7").select("shard").distinct().count() == 1
