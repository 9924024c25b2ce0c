import __spark_entry__ as entry


def test_entry_runs(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert set(df.columns) >= {"split", "shard", "n_tokens"}


def test_every_query_has_a_name_and_most_have_oracles():
    q = entry.queries()
    o = entry.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 60


def test_every_oracle_binds_in_duckdb():
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ["documents", "conversations", "events", "embeddings", "benchmark", "labels", "pages"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, sql in entry.oracle_sql().items():
        con.execute(f"EXPLAIN {sql}")  # parses and binds without running
