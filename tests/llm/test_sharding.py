import zlib
from collections import defaultdict

from millrace.llm import sharding

WRAP = (1 << 64) - 1


def plain_jump(key, n):
    key &= WRAP
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & WRAP
        j = int(float(b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_against_the_published_walk(spark):
    from pyspark.sql import functions as F

    keys = [0, 1, -1, 2**63 - 1, -(2**63), 12345678901234] + [i * 7919 for i in range(500)]
    table = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 7, 40):
        shard, grown = sharding.jump(F.col("k"), n)
        for r in table.select("k", shard.alias("s"), grown.alias("g")).collect():
            assert (r.s, r.g) == (plain_jump(r.k, n), plain_jump(r.k, n + 1))


def test_documents(docs, odd, none):
    for df in (docs, odd):
        rows = df.select("doc_id", "text").collect()
        got = sharding.shard_documents(df).collect()
        assert sorted((r.doc_id or -1, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in rows) == sorted(
            (g.doc_id or -1, g["size"], g.text_crc32) for g in got
        )
        slots = defaultdict(list)
        for g in got:
            assert g.law == "key" and g.shard == plain_jump(g.doc_id or 0, 40) and g.grown_shard in (g.shard, 40)
            slots[g.shard].append(g.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_documents(none).count() == 0


def test_evenness_and_string_keys(spark):
    rows = spark.range(20000).selectExpr("cast(id as string) k", "id")
    sizes = [r[1] for r in sharding.sharded(rows, "k", 10, ["id"]).groupBy("shard").count().collect()]
    assert len(sizes) == 10 and max(sizes) < 2300 and min(sizes) > 1700
