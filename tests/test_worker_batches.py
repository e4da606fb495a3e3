"""What Spark hands to the Python workers of whole queries, and that it starts no others."""

import os
import random
import uuid

import pytest

from symweave.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    """Tables of DATA, but 12 MB of texts in a row group and 8 MB of order keys."""
    folder = tmp_path_factory.mktemp("large")
    for name in os.listdir(DATA):
        if name not in ("documents.parquet", "orders.parquet"):
            os.symlink(f"{DATA}/{name}", folder / name)
    texts = [(i, "".join(random.Random(i).choices("abcdef ", k=1000)) * 4, "en") for i in range(3000)]
    spark.createDataFrame(texts, "doc_id bigint, text string, lang string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.range(1_000_000).selectExpr("id as o_orderkey", "'F' as o_orderstatus").write.parquet(f"{folder}/orders.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["context_model_4", "context_model_2", "context_model_3", "context_model_0", "blob_deltas", "blob_headers"])
def test_workers_get_small_batches(spark, large, tmp_path, monkeypatch, name):
    folder = str(tmp_path)

    def sizes(batches):
        for batch in batches:
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as out:
                out.write(str(batch.nbytes))
        yield from ()

    plain = type(spark.range(1)).mapInArrow
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda df, fn, *a, **b: plain(df, sizes, *a, **b))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        catalog.QUERIES[name](spark, large).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    seen = [int(p.read_text()) for p in tmp_path.iterdir()]
    assert sum(seen) > 8e6 and max(seen) < 5e6  # all rows, 4 MB at a time


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n in ("blob_headers", "blob_tree") or n.startswith("tree_")])
def test_trees_start_no_python_for_local_rows(spark, name):
    plan = catalog.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in plan  # rows from the driver's Python pass through Python workers of their own
