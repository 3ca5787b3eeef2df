import numpy as np
from pyspark.sql import functions as F

from parsewright.operators import generation as G
from parsewright.operators import retrieval as R


def test_top_k_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(7)
    v = rng.normal(size=(60, 8)).round(3)
    v[5] = 0
    v[7] = v[8]
    store = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)] + [(99, None)], "vec_id long, embedding array<float>").repartition(5)
    queries = store.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    f = v.astype(np.float32).astype(np.float64)
    n = np.sqrt((f * f).sum(1))
    for block in (64 << 20, 100):
        monkeypatch.setattr(R, "BLOCK_BYTES", block)
        got = {(r.query_id, r["rank"]): r.vec_id for r in R.top_k(store, queries, 4).collect()}
        want = {}
        for q in range(0, 60, 10):
            s = np.round(f[q] @ f.T / (n[q] * n + 1e-10), 9)
            for rank, i in enumerate(sorted(range(60), key=lambda j: (-s[j], j))[:4], 1):
                want[q, rank] = i
        assert got == want
    assert R.top_k(store.limit(0), queries, 3).count() == 0 and R.top_k(store, queries.limit(0), 3).count() == 0


def hits(spark, rows):
    return spark.createDataFrame([(1, *r) for r in rows], "q int, chunk_id int, score double, n_tokens int, text string")


def test_limits_and_budgets(spark):
    df = hits(spark, [(1, 0.9, 3, "a b c"), (2, 0.8, 200, "x " * 200), (3, 0.7, 2, "d e")])
    assert [r.chunk_id for r in R.take_top(df, 3, ("q",), token_limit=10).collect()] == [1]
    assert [r.chunk_id for r in R.take_budget(df, 50, ("q",)).collect()] == [1]
    one = R.take_budget(hits(spark, [(1, 0.95, 100, "w " * 100)]), 20, ("q",)).collect()
    assert len(one) == 1 and one[0].used == 20 and len(one[0].text.split()) == 20
    assert R.take_budget(df.limit(0), 10, ("q",)).count() == 0


def test_rerank_keeps_first_order_of_ties(spark):
    df = hits(spark, [(1, 0.9, 1, "a"), (2, 0.8, 1, "b"), (3, 0.7, 1, "c"), (4, 0.6, 1, "d")])
    best = R.rerank(df, 3, 2, ("q",), lambda x: x.withColumn("rerank_score", (F.col("chunk_id") >= 2).cast("int"))).orderBy("rank").collect()
    assert [r.chunk_id for r in best] == [2, 3]


def test_models_in_batches(spark):
    df = spark.createDataFrame([("ab",), (None,)], "t string")
    assert sorted(len(r.embedding) for r in R.embed_with(df, "t", lambda: lambda texts: [[float(len(t)), 1.0] for t in texts]).collect()) == [2, 2]
    assert [r.raw_output for r in G.generate(df.where("t is not null"), "t", lambda: lambda ps: [p.upper() for p in ps]).collect()] == ["AB"]


def test_responses_and_alignment(spark):
    rows = [('{"choices": [{"message": {"content": "<think>x</think>A"}}]}', "A"), ('{"text": "B"}', "B"), ("plain", "plain"), (None, "")]
    df = spark.createDataFrame([(r[0],) for r in rows], "v string")
    assert [r.x for r in df.select(G.response_text(F.col("v")).alias("x")).collect()] == [r[1] for r in rows]
    df = spark.createDataFrame([(["The", " A", " A", "zz"], [-1.0, -2.0, -3.0, -4.0], "The A A")], "t array<string>, l array<double>, c string")
    assert df.select(G.align_logprobs(F.col("t"), F.col("l"), F.col("c")).alias("m")).first().m == {"The": -1.0, " A": -3.0}


def test_relevance(spark):
    df = spark.createDataFrame([('{"relevance_score": 7}',), ("bad",), ('{"relevance_score": "x"}',)], "v string")
    assert [r.x for r in df.select(R.relevance_of(F.col("v")).alias("x")).collect()] == [7, 0, 0]
