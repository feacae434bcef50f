"""The driver contract."""

import __spark_entry__ as entry


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_names_agree():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 60


def test_queries_equal_sql(spark):
    """A sample of kinds at the smallest size; the driver compares all of them."""
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "events", "benchmark", "conversations", "labels", "pages"):
        con.execute(f"create view {t} as select * from '{entry.SMOKE}/{t}.parquet'")
    from gramlake.plans import catalog

    for name in ("char_counts", "ngram_counts_sparse", "backoff_probability", "count_patterns", "generate_seeded", "split_model", "encode_greedy_suffix", "event_transitions"):
        got = catalog.queries()[name](spark, entry.SMOKE).toPandas()
        want = con.execute(catalog.oracle_sql()[name]).fetchdf()[list(got.columns)]
        key = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.itertuples(index=False, name=None))
        assert key(got) == key(want), name
