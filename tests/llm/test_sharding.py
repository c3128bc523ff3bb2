import zlib

from tidelog.llm.sharding import place, shard_rows, topology
from pyspark.sql import functions as F


def test_law_key_slots_and_growth(spark):
    texts = [None, "", "é" * 10, "x" * 100_000]
    rows = [(i, texts[i % 4]) for i in range(3000)] + [(None, "n")] * 3 + [(5, texts[1])] * 2
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, SHARD int")
    out = shard_rows(docs).collect()
    assert len(out) == len(rows)
    by: dict = {}
    for r in out:
        by.setdefault(r["doc_id"], set()).add((r["shard"], r["grown_shard"]))
        if r["doc_id"] is not None:
            t = (texts[r["doc_id"] % 4] or "").encode()
            assert r["size"] == len(t) + 1 and r["text_crc32"] == zlib.crc32(t)
        assert r["grown_shard"] in (r["shard"], 16) and r["law"] == "key"
    assert all(len(v) == 1 for v in by.values())
    for s in range(16):
        slots = sorted(r["slot"] for r in out if r["shard"] == s)
        assert slots == list(range(len(slots))) and 100 < len(slots) < 280
    assert shard_rows(docs.limit(0)).count() == 0


def test_weights_and_confined_movement(spark):
    ids = spark.range(20_000)
    even, heavy = topology(16), topology(16, weights={3: 3.0})
    moved = ids.select(place(even, F.col("id")).alias("a"), place(heavy, F.col("id")).alias("b")).toPandas()
    assert abs((moved.b == 3).mean() - 3 / 18) < 0.02
    # The other region's rows only leave towards the heavier region; inside it nothing is shuffled about.
    left = moved[(moved.a != moved.b) & (moved.a >= 8)]
    assert (left.b < 8).all()
    assert ((moved.a < 8) | (moved.b < 8) | (moved.a == moved.b)).all()


def test_one_more_shard_takes_rows_only_into_itself(spark):
    """From 1 to 40 shards, founded with that number or with a smaller one."""
    trees = [(n, topology(n), topology(n + 1, n)) for n in range(1, 41)]
    trees += [(n, topology(n, 5), topology(n + 1, 5)) for n in range(5, 41, 7)]
    for lo in range(0, len(trees), 8):
        cols = [place(t, F.col("id")).alias(f"{x}{i}") for i, (_, a, b) in enumerate(trees[lo : lo + 8]) for x, t in (("a", a), ("b", b))]
        got = spark.range(4_000).select(*cols).toPandas()
        for i, (n, _, _) in enumerate(trees[lo : lo + 8]):
            a, b = got[f"a{i}"], got[f"b{i}"]
            assert (b[a != b] == n).all() and a.max() < n
            assert abs((b == n).mean() - 1 / (n + 1)) < 0.04


def test_grown_shard_is_the_shard_of_one_more(spark):
    docs = spark.range(500).selectExpr("id doc_id", "string(id) text")
    a = {r["doc_id"]: r["grown_shard"] for r in shard_rows(docs, 7).collect()}
    b = {r["doc_id"]: r["shard"] for r in shard_rows(docs, 8, founded=7).collect()}
    assert a == b and 7 in a.values()
