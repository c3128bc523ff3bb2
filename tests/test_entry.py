import __spark_entry__ as entry


def test_contract(spark):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(sql) >= 40
    out = entry.entry(spark)
    assert out.count() > 0 and out.columns == ["id", "pubkey", "created_at", "kind", "content"]


def test_queries_equal_their_sql(spark):
    """On the smallest tables, a part of the pairs; the driver compares all of them on larger ones."""
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in "customer supplier orders lineitem events nation conversations pages documents".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name in ("filter_recall", "supersession", "erase_by_deletions", "vanish", "batch_insert_outcomes", "reputation", "search_phrase", "snapshot", "compaction", "store_after_two_inserts", "vanish_guard", "gift_wrap_owner", "merge_of_mixed_profiles", "search_negation_only", "search_scored_bookmarks", "search_ranked_profiles"):
        got, want = entry.queries()[name](spark, sf), con.sql(entry.oracle_sql()[name])
        assert sorted(got.columns) == sorted(want.columns)
        order = sorted(got.columns)
        rows = sorted(map(repr, (tuple(r[c] for c in order) for r in got.collect())))
        at = [want.columns.index(c) for c in order]
        assert rows == sorted(map(repr, (tuple(r[i] for i in at) for r in want.fetchall()))), name


def test_snapshot_is_whole(spark):
    """Its SQL has no limit, so neither has its plan, however many rows there are."""
    plan = entry.queries()["snapshot"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan and "Limit" not in plan
