"""Queries that ask rank and select at every position and occurrence, and just beyond the last."""

from symweave.plans import catalog

DATA = "/root/testdata/sf0.001"


def test_probes_grow_with_the_table(spark):
    orders, events = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("orders", "events"))
    n, ones = orders.count(), orders.where("o_orderstatus = 'F'").count()
    count = lambda name: catalog.QUERIES[name](spark, DATA).count()
    assert [count(f"bits_{x}_all") for x in ("rank_at", "select1", "select0")] == [n + 1, ones + 1, n - ones + 1]
    symbols = events.select("event_type").distinct().count()
    assert count("symbol_rank_all") == symbols * (events.count() + 1)
    assert count("symbol_select_all") == events.count() + symbols
