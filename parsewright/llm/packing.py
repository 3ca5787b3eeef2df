"""Problem 7: texts, sized in tokens, put into containers of fixed capacity.

Shortest-pack-first over the length histogram: the histogram of sizes (bounded by the capacity, however
many texts there are) goes to the driver, lengths are placed longest first into the emptiest pack that
has room, and only counts of packing patterns are kept. Patterns meet the texts again by rank: the n-th
text of a length takes the n-th place that the patterns hold for that length.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parsewright.llm.tokenizers import TOKENIZERS_DIR, counter, tokenizer_file
from parsewright.session import cut_lineage, spread

#: Parts in which texts of one length are ranked, so that no task ranks all of a frequent length.
SALTS = 32


@dataclass
class Places:
    """Of one budget: per length, rank -> container as runs (first rank, first container)."""

    runs: dict[int, tuple[np.ndarray, np.ndarray]]
    containers: int


def pack_histogram(histogram: dict[int, int], capacity: int) -> Places:
    """Shortest-pack-first packing of ``histogram`` (length -> count, lengths 1 to ``capacity``).

    A group is a pattern with a count: ``count`` packs that hold the same lengths. Each length is put
    into the groups with the most room, one text per pack; a group larger than what is left is parted.
    Without room anywhere, packs are opened. Lengths cause at most one parting each, so groups stay
    within twice the number of lengths.
    """
    heap: list[tuple[int, int]] = []  # (-room, group)
    groups: list[tuple[int, tuple]] = []  # (count, lengths as a linked list)

    def put(room: int, count: int, lengths: tuple) -> None:
        groups.append((count, lengths))
        heapq.heappush(heap, (-room, len(groups) - 1))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left > 0:
            if heap and -heap[0][0] >= length:
                room, g = -heap[0][0], heapq.heappop(heap)[1]
                count, lengths = groups[g]
                groups[g] = (0, ())
                used = min(count, left)
                if count > used:
                    put(room, count - used, lengths)
                put(room - length, used, (length, lengths))
            else:
                # as many texts of this length as a pack holds, then packs of what remains
                used, fits = left, capacity // length
                full = left // fits
                if full:
                    pack: tuple = ()
                    for _ in range(fits):
                        pack = (length, pack)
                    put(capacity - fits * length, full, pack)
                if rest := left - full * fits:
                    pack = ()
                    for _ in range(rest):
                        pack = (length, pack)
                    put(capacity - rest * length, 1, pack)
            left -= used
    first: dict[int, list[int]] = {}
    target: dict[int, list[int]] = {}
    taken: dict[int, int] = {}
    base = 0
    for count, lengths in groups:
        if not count:
            continue
        node = lengths
        while node:
            length, node = node
            first.setdefault(length, []).append(taken.get(length, 0))
            target.setdefault(length, []).append(base)
            taken[length] = taken.get(length, 0) + count
        base += count
    return Places({k: (np.array(first[k], np.int64), np.array(target[k], np.int64)) for k in first}, base)


def text_sizes(df: DataFrame, tokenizers: list[str], id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZERS_DIR) -> DataFrame:
    """``id_col`` and ``sizes``: tokens of the text by each tokenizer in turn; 0 for null and empty texts."""
    files = [tokenizer_file(t, folder) for t in tokenizers]
    shared = df.sparkSession.sparkContext.broadcast(files)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = [counter(*f) for f in shared.value]
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            sizes = list(zip(*(c(texts) for c in count))) if texts else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([list(s) for s in sizes], pa.list_(pa.int32()))], names=[id_col, "sizes"])

    return spread(df.select(id_col, text_col)).mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, sizes array<int>")


def pack_texts(df: DataFrame, budgets: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZERS_DIR) -> DataFrame:
    """For each budget, each text's container: ``budget_id``, id, ``piece``, ``n_pieces``, ``first_token``, ``size``, ``container``.

    A text larger than the capacity is cut after each ``capacity`` tokens; its full pieces fill a
    container each and the rest is packed like any text. Null and empty texts have size 0 and lie in
    container 0. Budgets with a null tokenizer or a capacity under 1 give no rows; an unknown tokenizer
    is an error. Equal rows are texts of their own. Other columns play no part.
    """
    rows = [r for r in budgets.select("budget_id", "tokenizer", F.col("capacity").cast("int").alias("capacity")).distinct().collect() if r.tokenizer and r.capacity and r.capacity > 0]  # a table of settings
    kind = df.schema[id_col].dataType.simpleString()
    budget_kind = budgets.schema["budget_id"].dataType.simpleString()
    out = f"budget_id {budget_kind}, `{id_col}` {kind}, piece int, n_pieces int, first_token int, size int, container bigint"
    if not rows:
        return df.sparkSession.createDataFrame([], out)
    tokenizers = sorted({r.tokenizer for r in rows})
    sizes = cut_lineage(text_sizes(df, tokenizers, id_col, text_col, folder))  # read for the histogram and for the placing
    settings = F.array(*(F.struct(F.lit(i).alias("budget"), F.lit(tokenizers.index(r.tokenizer)).alias("which"), F.lit(r.capacity).alias("capacity")) for i, r in enumerate(rows)))
    each = sizes.select(F.col(id_col).alias("id"), "sizes", F.explode(settings).alias("s")).select("id", "s.budget", "s.capacity", F.col("sizes")[F.col("s.which")].alias("tokens"))
    whole, rest = F.floor(F.col("tokens") / F.col("capacity")).cast("int"), F.col("tokens") % F.col("capacity")
    items = each.withColumn("n_pieces", F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.col("capacity")).cast("int"))).withColumn("full", whole).withColumn("rest", rest)
    histogram = items.groupBy("budget", "rest").agg(F.count("*").alias("n"), F.sum("full").alias("n_full")).collect()  # at most capacity rows a budget
    places, full_base = [], []
    for i, r in enumerate(rows):
        own = pack_histogram({h.rest: h.n for h in histogram if h.budget == i and h.rest > 0}, r.capacity)
        places.append(own.runs)
        full_base.append(own.containers)
    # container 0 is there for the texts without tokens even if nothing else is
    shared = df.sparkSession.sparkContext.broadcast(places)

    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")
    lone = items.where((F.col("rest") == 0) & (F.col("full") == 0)).select("budget", "id", F.lit(0).alias("piece"), "n_pieces", F.lit(0).alias("first_token"), F.lit(0).alias("size"), F.lit(0).cast("bigint").alias("container"))
    packed = _ranked(items.where("rest > 0").select("budget", "id", "n_pieces", (F.col("n_pieces") - 1).alias("piece"), (F.col("full") * F.col("capacity")).alias("first_token"), F.col("rest").alias("size"), salt.alias("salt")))
    filled = items.where("full > 0").select("budget", "id", "n_pieces", "capacity", F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("piece"))
    filled = _ranked(filled.select("budget", "id", "n_pieces", "piece", (F.col("piece") * F.col("capacity")).alias("first_token"), F.col("capacity").alias("size"), salt.alias("salt")))
    base = F.element_at(F.array(*map(F.lit, full_base)), F.col("budget") + 1).cast("bigint")
    filled = filled.select("budget", "id", "piece", "n_pieces", "first_token", "size", (base + F.col("rank")).alias("container"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            budget, size, rank = (batch.column(c).to_numpy() for c in ("budget", "size", "rank"))
            container = np.empty(len(rank), np.int64)
            order = np.lexsort((size, budget))
            edges = np.flatnonzero(np.diff(budget[order]) | np.diff(size[order])) + 1
            for part in np.split(order, edges) if len(order) else []:
                firsts, targets = shared.value[budget[part[0]]][int(size[part[0]])]
                k = np.searchsorted(firsts, rank[part], "right") - 1
                container[part] = targets[k] + rank[part] - firsts[k]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("budget", "id", "piece", "n_pieces", "first_token", "size")), pa.array(container)], names=["budget", "id", "piece", "n_pieces", "first_token", "size", "container"])

    placed = packed.mapInArrow(run, f"budget int, id {kind}, piece int, n_pieces int, first_token int, size int, container bigint")
    name = F.element_at(F.array(*(F.lit(r.budget_id) for r in rows)), F.col("budget") + 1).cast(budget_kind)
    every = placed.unionByName(filled).unionByName(lone)
    return every.select(name.alias("budget_id"), F.col("id").alias(id_col), "piece", "n_pieces", "first_token", "size", "container")


def _ranked(items: DataFrame) -> DataFrame:
    """``rank`` from 0 within budget and size: ranks within a salt, plus the sizes of the salts before."""
    order = Window.partitionBy("budget", "size", "salt").orderBy("id", "piece")
    before = Window.partitionBy("budget", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = items.groupBy("budget", "size", "salt").agg(F.count("*").alias("n")).select("budget", "size", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inner = items.withColumn("rank", F.row_number().over(order) - 1)
    return inner.join(counts, ["budget", "size", "salt"]).select("budget", "id", "piece", "n_pieces", "first_token", "size", (F.col("rank") + F.col("offset")).cast("bigint").alias("rank"))
