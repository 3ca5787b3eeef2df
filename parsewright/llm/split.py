"""Problem 1: items larger than their limit are cut into pieces at natural boundaries.

Byte-range processing. A text is looked at in ranges of ``RANGE`` characters with a halo on both
sides; a worker finds the boundaries of its range and counts the range's units. Prefix sums of the ranges' lengths
stitch the boundary tables of a text; the cuts are chosen in one go over its ranges in order, which holds only the
ranges that the open piece touches; and pieces are emitted by offset from the ranges they touch. No step needs a whole
text at once, nor its whole table; ``split_files`` reads giant files range by range as well.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parsewright.session import cut_lineage

#: Characters in a range, and characters of context on either side of it.
RANGE, HALO = 16_384, 64
#: A limit's share after which a natural boundary is taken rather than a fuller piece.
LEAST_FILL = 0.4
#: The boundary table keeps the best boundary of each stretch of ``chunk_size / STRETCHES`` units.
STRETCHES = 32

# Boundaries by rank: a cut is made after the match. Alternatives in order of strength.
_RANKS = ((6, r"\n[ \t\r]*\n\s*"), (5, r"</(?:div|p|section|article|table|row|tr|item|list|li|ul|ol|head|h[1-6])>\s*|\r?\n"), (4, r"[.!?][\"'”’)\]]*[ \t]+|[。！？]+[」』）]?|[؟।][ \t]*"), (3, r"[;:][ \t]+|[；：]|[}\]],?[ \t]*|</[A-Za-z][^<>]{0,40}>"), (2, r",[ \t]+|[，、،][ \t]*"), (1, r"[ \t]+|>"))
_BOUNDARY = re.compile("|".join(f"(?P<r{rank}>{pattern})" for rank, pattern in _RANKS))
_TOKEN = re.compile(r"[^ \t\r\n]+")
# Characters that belong to the one before them: no cut is made in front of these.
_JOINED = re.compile("[̀-ًͯ-ٟऀ-ःऺ-ॏ‍⃐-⃿︀-️︠-︯\U0001f3fb-\U0001f3ff]")

_PARTS = "key struct<id:{id},hash:bigint>, unit string, range_no int, parts array<struct<piece:int,n_parts:int,lo:bigint,hi:bigint,first:boolean,last:boolean>>"
_PART = pa.list_(pa.struct([("piece", pa.int32()), ("n_parts", pa.int32()), ("lo", pa.int64()), ("hi", pa.int64()), ("first", pa.bool_()), ("last", pa.bool_())]))
#: Rows that a task hands on together.
ROWS_OUT = 256


def units_of(text: Column, unit: Column) -> Column:
    """Size of ``text``: code points, or with ``unit`` token runs of characters other than space, tab, CR and LF."""
    return F.when(unit == "token", F.size(F.regexp_extract_all(text, F.lit(r"[^ \t\r\n]+"), F.lit(0)))).otherwise(F.length(text))


def boundaries(body: str, before: str, after: str, unit: str, stretch: int) -> tuple[int, list[int], list[int]]:
    """Units of one range, and its cuts as (units before the cut, rank), the best of each stretch.

    A cut's rank is that of the separator that ends there; a match is looked for with both halos, so
    ranges that part a separator find the same cuts as a whole text would. In tokens, a range counts
    the tokens that begin in it, and cuts lie only where a token begins.
    """
    text, lo, hi = before + body + after, len(before), len(before) + len(body)
    best: dict[int, tuple[int, int]] = {}
    if unit == "token":
        starts = [m.start() for m in _TOKEN.finditer(text, lo, hi)]
        if starts and lo and starts[0] == lo and text[lo - 1] not in " \t\r\n":
            starts.pop(0)
        place = {s: k for k, s in enumerate(starts)}
        n_units = len(starts)
    else:
        n_units = len(body)
    for m in _BOUNDARY.finditer(text):
        end, rank = m.end(), int(m.lastgroup[1:])
        if not lo <= end < hi:
            continue
        if unit == "token":
            at = place.get(end)
            if at is None:
                continue
        else:
            at = end - lo
            if _JOINED.match(text, end):
                continue
        k = at // stretch
        if k not in best or (rank, at) >= (best[k][1], best[k][0]):
            best[k] = (at, rank)
    found = sorted(best.values())
    return n_units, [a for a, _ in found], [r for _, r in found]


class Cutter:
    """Chooses the pieces of one text from its ranges in order, and says what part each range has of them.

    A piece starts ``overlap`` units before the end of the one before. Its end is the highest-ranked boundary, and of those
    the last, that leaves the piece no larger than ``size`` and gives it at least ``LEAST_FILL`` of the new units that it has
    room for; without any, the piece is filled to ``size``. Ranges are held only while the open piece may touch them.
    """

    def __init__(self, total: int, size: int, overlap: int, unit: str):
        self.total, self.size, self.overlap, self.unit = total, size, min(overlap, size - 1), unit
        self.ranges: list[tuple[int, int, int, list[dict]]] = []  # number, offset, units, parts
        self.at: list[int] = []
        self.ranks: list[int] = []
        self.done = self.piece = self.seen = 0

    def add(self, no: int, offset: int, units: int, at: list[int], ranks: list[int], last: bool) -> list[tuple[int, list[dict]]]:
        """The ranges that are done with, and their parts."""
        self.ranges.append((no, offset, units, []))
        self.at += [offset + a for a in at]
        self.ranks += ranks
        self.seen = offset + units
        while True:
            start = max(0, self.done - self.overlap) if self.piece else 0
            if self.total - start <= self.size:
                if not last:
                    return self._passed(start)
                self._cut(start, self.total, True)
                out, self.ranges = self.ranges, []
                return [(n, parts) for n, _, _, parts in out if parts]
            most = start + self.size
            if self.seen <= most and not last:
                return self._passed(start)
            least = max(self.done + max(1, int((most - self.done) * LEAST_FILL)), self.overlap)  # the first piece must hold what it shares
            lo, hi = bisect.bisect_left(self.at, least), bisect.bisect_right(self.at, most)
            end = max(((self.ranks[k], self.at[k]) for k in range(lo, hi)), default=(0, most))[1]
            self._cut(start, end, False)
            self.done = end
            self.piece += 1

    def _cut(self, start: int, end: int, final: bool) -> None:
        offsets = [r[1] for r in self.ranges]
        a = bisect.bisect_right(offsets, start) - 1 if self.piece else 0
        # in tokens a piece goes on to where the next one begins, be it in a later range
        b = len(offsets) - 1 if final else (bisect.bisect_right if self.unit == "token" else bisect.bisect_left)(offsets, end) - 1
        for k in range(a, b + 1):
            _, offset, units, parts = self.ranges[k]
            parts.append({"piece": self.piece, "n_parts": b - a + 1, "lo": max(0, start - offset), "hi": min(end - offset, units), "first": k == a and self.piece > 0, "last": k == b and not final})

    def _passed(self, start: int) -> list[tuple[int, list[dict]]]:
        k = bisect.bisect_right([r[1] for r in self.ranges], start) - 1 if self.piece else 0
        out, self.ranges = self.ranges[:k], self.ranges[k:]
        old = bisect.bisect_left(self.at, self.done)
        self.at, self.ranks = self.at[old:], self.ranks[old:]
        return [(n, parts) for n, _, _, parts in out if parts]


def _detect(ranges: DataFrame, id_type: str) -> DataFrame:
    schema = f"key struct<id:{id_type},hash:bigint>, unit string, chunk_size int, overlap int, range_no int, n_units bigint, at array<int>, ranks array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, before, after, unit, size = (batch.column(c).to_pylist() for c in ("body", "before", "after", "unit", "chunk_size"))
            got = [boundaries(b, x, y, u, max(1, s // STRETCHES)) for b, x, y, u, s in zip(body, before, after, unit, size)]
            kept = [batch.column(c) for c in ("key", "unit", "chunk_size", "overlap", "range_no")]
            new = [pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.list_(pa.int32())), pa.array([g[2] for g in got], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*kept, *new], names=["key", "unit", "chunk_size", "overlap", "range_no", "n_units", "at", "ranks"])

    return ranges.mapInArrow(run, schema)


def _stitched(tables: DataFrame) -> DataFrame:
    """The tables of oversized texts with ``offset``, the units before the range, and ``total``, all units of the text;
    ranges of a text in order in one task. A row that is there twice counts once."""
    same, whole = Window.partitionBy("key", "range_no").orderBy("n_units"), Window.partitionBy("key")
    once = tables.repartition("key").withColumn("_copy", F.row_number().over(same)).where("_copy = 1").drop("_copy")
    before = F.sum("n_units").over(whole.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1))
    summed = once.withColumn("offset", F.coalesce(before, F.lit(0))).withColumn("total", F.sum("n_units").over(whole)).withColumn("n_ranges", F.count("*").over(whole))
    return summed.where(F.col("total") > F.col("chunk_size").cast("bigint") + F.col("overlap")).sortWithinPartitions("key", "range_no")


def _parts(tables: DataFrame, id_type: str) -> DataFrame:
    """The pieces of each range: from and to in the range's own units, one row per range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            keys = pa.array([r[0] for r in rows], key_type)
            batch = pa.RecordBatch.from_arrays([keys, pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], _PART)], names=["key", "unit", "range_no", "parts"])
            rows.clear()
            return batch

        cutter = current = None
        key_type = None
        for batch in batches:
            key_type = batch.schema.field("key").type
            for key, unit, size, overlap, no, units, at, ranks, offset, total, n_ranges in zip(*(batch.column(c).to_pylist() for c in ("key", "unit", "chunk_size", "overlap", "range_no", "n_units", "at", "ranks", "offset", "total", "n_ranges"))):
                if key != current:
                    cutter, current, left = Cutter(total, size, overlap, unit), key, n_ranges
                left -= 1
                rows += [(key, unit, n, parts) for n, parts in cutter.add(no, offset, units, at, ranks, left == 0)]
                if len(rows) >= ROWS_OUT:
                    yield out()
        if rows:
            yield out()

    return _stitched(tables).mapInArrow(run, _PARTS.format(id=id_type))


def cut_range(body: str, before: str, unit: str, parts: list[dict]) -> list[str]:
    """The text that each part has of this range."""
    if unit != "token":
        return [body[p["lo"] : p["hi"]] for p in parts]
    starts = [m.start() for m in _TOKEN.finditer(body)]
    if starts and before and starts[0] == 0 and before[-1] not in " \t\r\n":
        starts.pop(0)
    starts.append(len(body))
    # before a piece's first token nothing is taken, after its last one all up to the next token
    return [body[starts[p["lo"]] if p["first"] else 0 : starts[p["hi"]] if p["last"] else len(body)] for p in parts]


def _emit(parts: DataFrame, ranges: DataFrame, id_type: str) -> DataFrame:
    texts = ranges.select("key", "range_no", "body", "before").dropDuplicates(["key", "range_no"])
    joined = parts.alias("p").join(texts.alias("t"), F.col("p.key").eqNullSafe(F.col("t.key")) & (F.col("p.range_no") == F.col("t.range_no"))).select("p.key", "p.unit", "p.range_no", "p.parts", "t.body", "t.before")
    same = ("key", "unit", "range_no")
    schema = f"key struct<id:{id_type},hash:bigint>, unit string, range_no int, piece int, n_parts int, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, piece, n_parts, texts = [], [], [], []
            for i, (unit, p, body, before) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("unit", "parts", "body", "before")))):
                texts += cut_range(body, before, unit, p)
                take += [i] * len(p)
                piece += [x["piece"] for x in p]
                n_parts += [x["n_parts"] for x in p]
            at = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in same), pa.array(piece, pa.int32()), pa.array(n_parts, pa.int32()), pa.array(texts, pa.string())], names=[*same, "piece", "n_parts", "text"])

    pieces = joined.mapInArrow(run, schema)
    whole = pieces.where("n_parts = 1").select("key", "unit", "piece", "text")
    # most pieces lie in one range; only the others are gathered
    across = pieces.where("n_parts > 1").groupBy("key", "unit", "piece").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("range_no", "text"))), lambda x: x["text"]), "").alias("text"))
    return whole.unionByName(across)


def to_ranges(df: DataFrame, id_col: str = "chunk_id", text_col: str = "text", unit_col: str = "unit", size_col: str = "chunk_size", overlap_col: str = "chunk_overlap", metadata_col: str | None = None) -> DataFrame:
    """Texts as ranges with halos, in one pass over each; the first range bears ``metadata`` if asked for. A text that fits its
    limit by an upper bound of its units is left out."""
    size, overlap = F.col(size_col).cast("int"), F.greatest(F.coalesce(F.col(overlap_col).cast("int"), F.lit(0)), F.lit(0))
    text, unit = F.col(text_col), F.when(F.col(unit_col) == "token", "token").otherwise("char")
    # tokens are at most the blanks between them and one
    most_units = F.when(F.col(unit_col) == "token", F.length(text) - F.length(F.translate(text, " \t\r\n", "")) + 1).otherwise(F.length(text))
    known = df.where((size > 0) & (most_units > size.cast("bigint") + overlap))
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(text, unit, size, overlap).alias("hash"))
    rows = known.select(key.alias("key"), unit.alias("unit"), size.alias("chunk_size"), overlap.alias("overlap"), *([F.col(metadata_col).alias("metadata")] if metadata_col else []), text.alias("whole"))
    kept = [f for f in rows.schema.fields if f.name != "whole"]
    schema = T.StructType([*kept, T.StructField("range_no", T.IntegerType()), *(T.StructField(c, T.StringType()) for c in ("body", "before", "after"))])
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts: list[tuple] = []

            def out() -> pa.RecordBatch:
                take = pa.array([c[0] for c in cuts], pa.int64())
                first = pa.array([c[0] if c[1] == 0 else None for c in cuts], pa.int64())
                columns = [batch.column(f.name).take(first if f.name == "metadata" else take) for f in kept]
                done = pa.RecordBatch.from_arrays([*columns, pa.array([c[1] for c in cuts], pa.int32()), *(pa.array([c[k] for c in cuts], pa.string()) for k in (2, 3, 4))], names=names)
                cuts.clear()
                return done

            for i, whole in enumerate(batch.column("whole").to_pylist()):
                for no, at in enumerate(range(0, len(whole), RANGE)):
                    cuts.append((i, no, whole[at : at + RANGE], whole[max(0, at - HALO) : at], whole[at + RANGE : at + RANGE + HALO]))
                    if len(cuts) >= ROWS_OUT:
                        yield out()
            if cuts:
                yield out()

    return rows.mapInArrow(run, schema).repartition("key", "range_no")


def _id_type(df: DataFrame, id_col: str) -> str:
    return df.schema[id_col].dataType.simpleString()


def oversized(df: DataFrame, id_col: str = "chunk_id", **columns: str) -> DataFrame:
    """Ids of the oversized texts, each once: the sums of their ranges' units exceed the limit.

    Oversized is a text of more than ``chunk_size + chunk_overlap`` units. Null, empty and blank-only
    texts, a null or non-positive size: no row. A null or negative overlap is 0.
    """
    tables = _detect(to_ranges(df, id_col, **columns), _id_type(df, id_col))
    once = tables.groupBy("key", "range_no").agg(F.max("n_units").alias("n"), F.first("chunk_size").alias("size"), F.first("overlap").alias("overlap"))
    texts = once.groupBy("key").agg(F.sum("n").alias("n"), F.first("size").alias("size"), F.first("overlap").alias("overlap"))
    return texts.where(F.col("n") > F.col("size").cast("bigint") + F.col("overlap")).select(F.col("key.id").alias(id_col)).distinct()


def split_oversized(df: DataFrame, id_col: str = "chunk_id", metadata_col: str | None = "metadata", **columns: str) -> DataFrame:
    """Pieces of the oversized texts: id, ``piece`` from 0, ``n_pieces``, ``text``, ``n_units``, and the text's metadata.

    No piece has more than ``chunk_size`` units, each shares ``chunk_overlap`` units with the one before,
    and without the shared units the pieces make up the text again. An overlap of ``chunk_size`` or more is taken as
    ``chunk_size - 1``; rows that are equal in id, text and settings give their pieces once. For other cases see
    ``oversized``; other columns of ``df`` play no part, whatever their names. Empty tables give empty results.
    """
    kind = _id_type(df, id_col)
    ranges = cut_lineage(to_ranges(df, id_col, metadata_col=metadata_col, **columns))  # read for the tables and for the pieces
    parts = cut_lineage(_parts(_detect(ranges, kind), kind))
    pieces = _emit(parts, ranges, kind)
    texts = parts.groupBy("key").agg((F.max(F.array_max("parts.piece")) + 1).alias("n_pieces"))
    if metadata_col is not None:
        meta = ranges.where("range_no = 0").groupBy("key").agg(F.first("metadata", ignorenulls=True).alias("metadata"))
        texts = texts.alias("t").join(meta.alias("m"), F.col("t.key").eqNullSafe(F.col("m.key"))).select("t.key", "t.n_pieces", "m.metadata")
    joined = pieces.alias("a").join(texts.alias("t"), F.col("a.key").eqNullSafe(F.col("t.key")))
    return joined.select(F.col("a.key.id").alias(id_col), "a.piece", "t.n_pieces", "a.text", units_of(F.col("a.text"), F.col("a.unit")).cast("int").alias("n_units"), *(["t.metadata"] if metadata_col is not None else []))


def file_ranges(spark: SparkSession, paths: DataFrame, chunk_size: int, chunk_overlap: int = 0, unit: str = "char", range_bytes: int = 4 << 20) -> DataFrame:
    """Ranges of giant UTF-8 files (``paths`` has ``path`` and ``length``), each read by offset from the file.

    A range owns the characters that begin in its bytes; the few bytes of halo complete a character
    that is parted and give the boundary search its context. Files are reached through Arrow's file
    systems, by path or URI. Bytes that are no UTF-8 become U+FFFD.
    """
    at = paths.select("path", F.col("length").cast("bigint").alias("length"), F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), ((F.col("length") - 1) / range_bytes).cast("int")))).alias("range_no")).repartition("path", "range_no")
    halo = HALO * 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            rows = []
            for path, length, no in zip(*(batch.column(c).to_pylist() for c in ("path", "length", "range_no"))):
                system, inside = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
                lo, hi = no * range_bytes, min(length, (no + 1) * range_bytes)
                first = max(0, lo - halo)
                with system.open_input_file(inside) as f:
                    data = f.read_at(min(length, hi + halo) - first, first)
                edge = lambda i: next((k for k in range(i, min(i + 4, len(data))) if data[k] & 0xC0 != 0x80), len(data)) if 0 < i < len(data) else i
                a, b = edge(lo - first), edge(hi - first)
                text = lambda x: x.decode("utf-8", "replace")
                rows.append((path, no, text(data[a:b]), text(data[edge(1) if first else 0 : a])[-HALO:], text(data[b:])[:HALO]))
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.string()) for c in cols[2:])], names=["path", "range_no", "body", "before", "after"])

    read = at.mapInArrow(run, "path string, range_no int, body string, before string, after string")
    return read.select(F.struct(F.col("path").alias("id"), F.lit(0).cast("bigint").alias("hash")).alias("key"), F.lit(unit).alias("unit"), F.lit(chunk_size).alias("chunk_size"), F.lit(chunk_overlap).alias("overlap"), "range_no", "body", "before", "after")


def split_files(spark: SparkSession, paths: DataFrame, chunk_size: int, chunk_overlap: int = 0, unit: str = "char", range_bytes: int = 4 << 20) -> DataFrame:
    """Pieces of text files of any length: ``path``, ``piece``, ``text``; files within the limit come out nowhere."""
    ranges = file_ranges(spark, paths, chunk_size, chunk_overlap, unit, range_bytes)
    return _emit(_parts(_detect(ranges, "string"), "string"), ranges, "string").select(F.col("key.id").alias("path"), "piece", "text")
