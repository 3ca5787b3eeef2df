"""Corpus counts that several operators share."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parsewright.session import spread

WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
#: Distinct words that a task counts before it hands its counts on.
FLUSH = 200_000


def count_words(df: DataFrame, text_col: str) -> DataFrame:
    """``word`` (lower case), ``n`` and ``n_inside`` over all texts, counted in each task before the shuffle.

    ``n`` leaves out a text's last word, as it may be cut off; ``n_inside`` also the first and last of each line, as
    they may be parts of one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        inside: Counter = Counter()

        def out() -> pa.RecordBatch:
            words = list(counts)
            batch = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array([c[w] for w in words], pa.int64()) for c in (counts, inside))], names=["word", "n", "n_inside"])
            counts.clear()
            inside.clear()
            return batch

        for batch in batches:
            for text in batch.column(0).to_pylist():
                lines = [found for line in text.lower().split("\n") if (found := WORD.findall(line))]
                for k, words in enumerate(lines, 1):
                    counts.update(words if k < len(lines) else words[:-1])
                    inside.update(words[1:-1])
            if len(counts) > FLUSH:
                yield out()
        yield out()

    counted = spread(df.where(F.col(text_col).isNotNull()).select(text_col)).mapInArrow(run, "word string, n bigint, n_inside bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_inside").alias("n_inside"))
