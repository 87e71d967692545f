"""Multi-index search against brute force over all codes."""

import duckdb
import numpy as np
from helixloom.llm import code_search as X
from pyspark.sql import functions as F


def plain(ids, codes, queries, k):
    out = []
    for q in queries:
        d = np.bitwise_count(codes ^ codes[q])
        order = sorted(range(len(ids)), key=lambda i: (d[i], ids[i]))[:k]
        out += [(ids[q], ids[i], int(d[i]), r + 1) for r, i in enumerate(order)]
    return sorted(out)


def test_search_is_exact_with_shards_copies_and_clusters(spark):
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 2**64, 700, dtype=np.uint64)
    codes[100:250] = codes[100]
    codes[300:400] = codes[300] ^ (np.uint64(1) << rng.integers(0, 64, 100).astype(np.uint64))
    ids = list(range(700))
    df = spark.createDataFrame([(i, int(c)) for i, c in zip(ids, codes.view(np.int64), strict=True)], "id long, code long")
    want = plain(ids, codes, range(0, 700, 20), 10)
    for how in ({}, {"shard": 100, "block": 7}):
        got = sorted(map(tuple, X.nearest(df, df.where("id % 20 = 0"), **how).collect()))
        assert got == want
    assert X.nearest(df.limit(0), df.limit(0)).count() == 0
    few = df.where("id < 3")
    assert X.nearest(few, few.where("id = 0")).count() == 3


def test_query_equals_sql(spark, sf):
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    assert sorted(map(tuple, X.op10_code_search(spark, sf).collect())) == sorted(c.execute(X.OP10_SQL).fetchall())


def test_codes_of_odd_vectors(spark):
    df = spark.createDataFrame([(None,), ([],), ([1.0, None, 2.0],), ([-0.0] + [1.0] * 70,)], "v array<float>")
    assert [r[0] for r in df.select(X.binary_code(F.col("v"))).collect()] == [0, 0, 5, -2]
