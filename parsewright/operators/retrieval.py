"""Embeddings and search: features, exact top-k in blocks, token budgets, two-stage reranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parsewright.functions import text as T

#: Bytes of query vectors that one pass over the store carries to the workers; more queries take more passes.
BLOCK_BYTES = 64 << 20
#: Products that a task holds at a time, queries times rows.
TILE = 4 << 20


def embed_checksum(df: DataFrame, text_col: str, out: str = "embedding") -> DataFrame:
    """The offline default embedder; null texts count as empty."""
    return df.withColumn(out, T.checksum_features(F.coalesce(F.col(text_col), F.lit(""))))


def embed_with(df: DataFrame, text_col: str, make_model: Callable[[], Callable[[list[str]], list[list[float]]]], out: str = "embedding") -> DataFrame:
    """An embedding model in Arrow batches. ``make_model`` is called once a task, on the worker."""
    from pyspark.sql import types as S

    schema = S.StructType([*df.schema.fields, S.StructField(out, S.ArrayType(S.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for batch in batches:
            model = model or make_model()
            vectors = model([t or "" for t in batch.column(batch.schema.names.index(text_col)).to_pylist()]) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(vectors, pa.list_(pa.float32()))], names=[*batch.schema.names, out])

    return df.mapInArrow(run, schema)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double of two array columns; 0 for a zero vector. For single pairs; ``top_k`` is for many."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + 1e-10)


def _matrix(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one width as rows of a matrix, taken from the flat values."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 1))


def _best(scores: np.ndarray, ranks: np.ndarray, k: int) -> np.ndarray:
    """Columns of each row's k best scores, in any order; of equal scores those with the smaller rank."""
    n, width = scores.shape
    if width <= k:
        return np.tile(np.arange(width), (n, 1))
    out = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    least = np.take_along_axis(scores, out, 1).min(1)
    # where scores equal to the least one are left out, the ranks decide
    for r in np.flatnonzero((scores >= least[:, None]).sum(1) > k):
        out[r] = np.lexsort((ranks[r], -scores[r]))[:k]
    return out


def top_k(store: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", query_id_col: str = "query_id", digits: int = 9) -> DataFrame:
    """Exact cosine top-k of each query over the whole store: query id, ``rank`` from 1, id, ``score``.

    Each task multiplies its rows with a block of query vectors, TILE products at a time, and keeps k rows a query, so that what
    is shuffled is tasks times queries times k, not the products. A block of BLOCK_BYTES is fetched and sent out before the
    next one, and each reads the store once. Ties go to the smaller id; scores are compared at ``digits`` decimals. Vectors
    that are null are left out; zero vectors score 0. All vectors have one width.
    """
    # the queries' vectors are the stated query set
    wanted = queries.where(F.col(vector_col).isNotNull()).select(F.col(query_id_col).alias("query_id"), F.col(vector_col).alias("vector"))
    n, width = wanted.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    blocks = max(1, -(-n * max(1, width) * 8 // BLOCK_BYTES))
    kinds = {c: df.schema[name].dataType.simpleString() for c, df, name in (("query", queries, query_id_col), ("id", store, id_col))}
    rows = store.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    parts = []
    for b in range(blocks):
        block = wanted.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) if blocks > 1 else wanted
        table = block.toArrow()
        if not table.num_rows and blocks > 1:
            continue
        shared = store.sparkSession.sparkContext.broadcast((table.column("query_id").combine_chunks(), _matrix(table.column("vector"))))
        del table

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            if not len(ids):
                return
            qn = np.sqrt((q * q).sum(1))
            kept_scores, kept_rows = np.zeros((len(ids), 0)), np.zeros((len(ids), 0), np.int64)
            known: list = []  # ids of the rows that are kept, by number
            for batch in batches:
                if not batch.num_rows:
                    continue
                v = _matrix(batch.column("vector"))
                vn = np.sqrt((v * v).sum(1))
                own = batch.column("id").to_pylist()
                first = len(known)
                known += own
                place = {x: i for i, x in enumerate(sorted(set(known)))}
                rank = np.array([place[x] for x in known], np.int64)
                step = max(1, TILE // (len(own) + kept_scores.shape[1]))
                scores_out, rows_out = [], []
                numbers = np.arange(first, first + len(own))
                for at in range(0, len(ids), step):
                    part = slice(at, at + step)
                    s = np.hstack([kept_scores[part], np.round(q[part] @ v.T / (qn[part, None] * vn[None, :] + 1e-10), digits)])
                    r = np.hstack([kept_rows[part], np.broadcast_to(numbers, (len(s), len(own)))])
                    best = _best(s, rank[r], k)
                    scores_out.append(np.take_along_axis(s, best, 1))
                    rows_out.append(np.take_along_axis(r, best, 1))
                kept_scores, kept_rows = np.vstack(scores_out), np.vstack(rows_out)
                # rows that no query keeps are forgotten
                still, numbered = np.unique(kept_rows, return_inverse=True)
                known = [known[i] for i in still]
                kept_rows = numbered.reshape(kept_rows.shape)
            if kept_scores.shape[1]:
                per = kept_scores.shape[1]
                of = pa.array(known)
                for at in range(0, len(ids), max(1, 100_000 // per)):
                    part = slice(at, at + max(1, 100_000 // per))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.repeat(np.arange(len(ids))[part], per))), of.take(pa.array(kept_rows[part].ravel())), pa.array(kept_scores[part].ravel())], names=["query_id", "id", "score"])

        parts.append(rows.mapInArrow(run, f"query_id {kinds['query']}, id {kinds['id']}, score double"))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(F.col("query_id").alias(query_id_col), "rank", F.col("id").alias(id_col), "score")


def scored(pairs: DataFrame, group: tuple[str, ...], score: str = "score", tie: str = "chunk_id") -> Window:
    return Window.partitionBy(*group).orderBy(F.desc(score), tie)


def take_top(pairs: DataFrame, k: int, group: tuple[str, ...], score: str = "score", tie: str = "chunk_id", token_limit: int | None = None, tokens: str = "n_tokens") -> DataFrame:
    """The k best rows of each group, with ``rank``; with a limit, the longest prefix of them whose tokens fit it."""
    out = pairs.withColumn("rank", F.row_number().over(scored(pairs, group, score, tie))).where(F.col("rank") <= k)
    if token_limit is not None:
        running = Window.partitionBy(*group).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn("_running", F.sum(tokens).over(running)).where(F.col("_running") <= token_limit).drop("_running")
    return out


def take_budget(pairs: DataFrame, budget: int, group: tuple[str, ...], score: str = "score", tie: str = "chunk_id", tokens: str = "n_tokens", text: str | None = "text") -> DataFrame:
    """Rows in order of score while their tokens fit ``budget``; a first row that is larger by itself is cut to it.

    Adds ``rank``, ``used`` (tokens taken) and, with ``text``, cuts the text of a first row that is too large.
    """
    order = scored(pairs, group, score, tie)
    out = pairs.withColumn("rank", F.row_number().over(order)).withColumn("_sum", F.sum(tokens).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    first_too_large = (F.col("rank") == 1) & (F.col(tokens) > budget)
    # running sums only grow, so the rows that fit are a prefix; behind a first row that is cut nothing fits
    out = out.where((F.col("_sum") <= budget) | first_too_large).withColumn("used", F.least(F.col(tokens), F.lit(budget)))
    if text:
        out = out.withColumn(text, F.when(first_too_large, F.array_join(F.slice(T.tokens(F.col(text)), 1, budget), " ")).otherwise(F.col(text)))
    return out.drop("_sum")


def cut_to_used(text: Column, tokens: str = "n_tokens") -> Column:
    """The text of a row of ``take_budget``, cut to the ``used`` tokens where not all of its tokens were taken."""
    return F.when(F.col("used") < F.col(tokens), F.array_join(F.slice(T.tokens(text), 1, F.col("used")), " ")).otherwise(text)


def rerank(pairs: DataFrame, first_k: int, k: int, group: tuple[str, ...], scorer: Callable[[DataFrame], DataFrame], score: str = "score", second: str = "rerank_score", tie: str = "chunk_id") -> DataFrame:
    """Two stages: the ``first_k`` best rows go through ``scorer`` (which adds ``second``), and of those the k best
    come out. Equal second scores keep the first order. The scorer sees only the first stage's rows."""
    first = pairs.withColumn("first_rank", F.row_number().over(scored(pairs, group, score, tie))).where(F.col("first_rank") <= first_k)
    again = Window.partitionBy(*group).orderBy(F.desc(second), "first_rank")
    return scorer(first).withColumn("rank", F.row_number().over(again)).where(F.col("rank") <= k)


def relevance_of(response: Column) -> Column:
    """The whole number that a JSON answer gives as relevance_score; 0 if there is none."""
    return F.coalesce(F.get_json_object(response, "$.relevance_score").try_cast("int"), F.lit(0))


def labelled_query(concept: Column, definition: Column, additional: Column, answers: Column) -> Column:
    """Query text in lines for embedding; absent and empty parts drop out."""
    given = lambda c, lead: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(lead), c))
    options = F.when(F.size(answers) > 0, F.concat(F.lit("Possible answers: "), F.array_join(answers, ", ")))
    return F.concat_ws("\n", given(concept, "Concept: "), given(definition, "Definition: "), given(additional, "Additional info: "), options)


def label_definition(label: Column, description: Column, choices: Column) -> Column:
    """Label, description and choices in one line; empty parts drop out."""
    options = F.when(F.size(choices) > 0, F.concat(F.lit("Choices: "), F.array_join(F.transform(choices, lambda c: F.concat(c["key"], F.lit(": "), c["value"])), ", ")))
    return F.concat_ws(" ", F.nullif(label, F.lit("")), F.nullif(description, F.lit("")), options)
