"""Cutting documents into chunks: token and character windows, sentences, paragraphs, sections.

All are column expressions over one row's text, so nothing is shuffled. What a lambda uses more than once is bound to a
variable first (``let``), else it would be computed anew for each element. Only an XML tree and pretty JSON, which Spark
has no expression for, come from an Arrow function, and only for texts that need it.
"""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from parsewright.functions import text as T
from parsewright.session import spread

# The grid that chunk sweeps go through.
GRID_SIZES, GRID_OVERLAPS = (50, 100, 250, 500, 750, 1000, 2500, 5000), (0, 250, 750)
# Elements that hold paragraphs, and those that begin a section.
PARAGRAPH_TAGS = frozenset(("p", "section", "article", "div"))
_HEADING = r"<h\d[^>]*>.*?</h\d>"
_BLOCK = r"<(?:section|article|chapter|div|part)[^>]*>.*?</(?:section|article|chapter|div|part)>"


def check_sizes(size: int, overlap: int) -> None:
    if size < 1 or overlap < 0 or overlap >= size:
        raise ValueError("a chunk's size must be positive and its overlap smaller than it")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a variable that holds ``value``, which is computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _starts(n: Column, size: int, overlap: int) -> Column:
    """Where windows begin (from 0): every ``size - overlap`` until one reaches the end."""
    step = max(1, size - overlap)
    return F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((n - size) / step).cast("int")) * step, F.lit(step))


def token_windows(text: Column, size: int, overlap: int = 0) -> Column:
    """Array of windows of ``size`` words; the one of a blank text is an empty string, to be dropped after exploding."""
    check_sizes(size, overlap)
    return let(T.tokens(text), lambda words: F.transform(_starts(F.size(words), size, overlap), lambda s: F.array_join(F.slice(words, s + 1, F.lit(size)), " ")))


def char_windows(text: Column, size: int, overlap: int = 0) -> Column:
    """Array of windows of ``size`` characters. The text is cut once into blocks of a step; a window is some blocks in a row."""
    check_sizes(size, overlap)
    step = max(1, size - overlap)
    blocks = F.struct(F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{step}}}"), F.lit(0)).alias("blocks"), F.length(text).alias("n"))
    in_a_row = -(-size // step)
    cut = lambda b: F.transform(_starts(b["n"], size, overlap), lambda s: F.left(F.array_join(F.slice(b["blocks"], (s / step).cast("int") + 1, F.lit(in_a_row)), ""), F.lit(size)))
    return F.when(text == "", F.array(F.lit(""))).otherwise(let(blocks, cut))


def with_overlap(chunks: Column, overlap: int) -> Column:
    """Each chunk after the first with the last ``overlap`` characters of the emitted one before in front of it.

    Those are the last characters of all chunks before it: of the one before, or where that is shorter of as many as it takes.
    """
    if not overlap:
        return chunks

    def tail(c: Column, i: Column) -> Column:
        before = F.get(c, i - 1)
        several = F.array_join(F.slice(c, F.greatest(F.lit(1), i + 1 - overlap), F.least(i, F.lit(overlap))), "")
        return F.right(F.when(F.length(before) >= overlap, before).otherwise(several), F.lit(overlap))

    return let(chunks, lambda c: F.transform(c, lambda x, i: F.when(i == 0, x).otherwise(F.concat(tail(c, i), x))))


def pack_parts(parts: Column, size: int, between: str = " ") -> Column:
    """Texts packed greedily: one joins the chunk while both and what stands between fit ``size``; a longer one stays whole.
    Empty ones drop out."""
    # the open chunk is kept as numbers (where it begins, its length): texts are joined once, when it is closed
    first = F.struct(F.expr("cast(array() as array<struct<first:int,last:int>>)").alias("done"), F.lit(1).alias("first"), F.lit(0).alias("last"), F.lit(0).alias("length"))
    known = F.filter(parts, lambda x: x != "")

    def add(state: Column, n: Column) -> Column:
        joined = F.when(state["length"] == 0, n).otherwise(state["length"] + len(between) + n)
        fits = (state["length"] == 0) | (state["length"] + len(between) + n <= size)
        closed = F.concat(state["done"], F.array(F.struct(state["first"].alias("first"), state["last"].alias("last"))))
        return F.struct(F.when(fits, state["done"]).otherwise(closed).alias("done"), F.when(fits, state["first"]).otherwise(state["last"] + 1).alias("first"), (state["last"] + 1).alias("last"), F.when(fits, joined).otherwise(n).alias("length"))

    def spans(p: Column) -> Column:
        close = lambda s: F.when(s["length"] == 0, s["done"]).otherwise(F.concat(s["done"], F.array(F.struct(s["first"].alias("first"), s["last"].alias("last")))))
        return F.aggregate(F.transform(p, F.length), first, add, close)

    return let(known, lambda p: F.transform(spans(p), lambda r: F.array_join(F.slice(p, r["first"], r["last"] - r["first"] + 1), between)))


def pack_sentences(text: Column, size: int) -> Column:
    """Sentences packed greedily into chunks of at most ``size`` characters; a longer sentence stays whole."""
    return pack_parts(T.sentences(text), size)


def markdown_sections(text: Column) -> Column:
    """Array of struct<heading, text>: what stands before the first heading, then each heading to the next. Blank ones drop out."""
    parts = F.filter(F.split(text, r"(?md)(?=^#+ .+$)"), lambda x: T.strip(x) != "")
    return F.transform(parts, lambda x: F.struct(F.nullif(F.regexp_extract(x, r"(?d)^(#+ .+)(?:\n|$)", 1), F.lit("")).alias("heading"), x.alias("text")))


@F.pandas_udf(S.StringType())
def pretty_json(texts: pd.Series) -> pd.Series:
    """JSON with indents of two; what is no JSON as it is."""

    def pretty(t: str | None) -> str | None:
        try:
            return None if t is None else json.dumps(json.loads(t), indent=2, ensure_ascii=False)
        except ValueError:
            return t

    return texts.map(pretty)


@F.pandas_udf(S.ArrayType(S.ArrayType(S.StructType([S.StructField("text", S.StringType()), S.StructField("tag", S.StringType())]))))
def xml_paragraphs(texts: pd.Series) -> pd.Series:
    """Of each text that is well-formed XML, the elements of PARAGRAPH_TAGS in order of the document with all text in them
    (one inside another counts in both); null for other texts and where no element has any."""

    def of(t: str | None) -> list[dict[str, str]] | None:
        try:
            root = ET.fromstring(t.strip()) if t and t.lstrip().startswith("<") else None
        except (ET.ParseError, ValueError):
            root = None
        named = [(e, str(e.tag).lower()) for e in root.iter()] if root is not None else []
        found = [{"text": text, "tag": tag} for e, tag in named if tag in PARAGRAPH_TAGS and (text := "".join(e.itertext()).strip())]
        return found or None

    return texts.map(lambda own: None if own is None else [of(t) for t in own])


def json_sections(text: Column) -> Column:
    """Blocks of a JSON text, pretty; null where the text doesn't begin like one. Blocks are parted by blank lines, so mostly
    there is one; what is no JSON after all is one block as it is."""
    bare = T.strip(text)
    looks = bare.rlike(r"^[{\[]")
    return F.when(looks, F.filter(F.split(pretty_json(F.when(looks, bare)), r"\n\n"), lambda x: T.strip(x) != ""))


def html_sections(text: Column) -> Column:
    """Array of struct<heading, text>: a heading element with what follows it up to the next element, a block element by itself
    with the first heading in it, and what stands between as sections without a heading."""
    either = rf"(?is){_HEADING}|{_BLOCK}"
    section = lambda heading, body: F.struct(heading.cast("string").alias("heading"), body.alias("text"))
    elements = F.struct(F.regexp_extract_all(text, F.lit(either), F.lit(0)).alias("elements"), F.split(text, either, -1).alias("gaps"))

    def around(p: Column) -> Column:
        def one(element: Column, i: Column) -> Column:
            gap = F.get(p["gaps"], i + 1)
            inner = F.regexp_extract(element, rf"(?is){_HEADING}", 0)
            heading = F.nullif(T.sanitize(inner, True), F.lit(""))
            return F.when(element.rlike("(?i)^<h"), F.array(section(heading, F.concat(element, gap)))).otherwise(F.array(section(heading, element), section(F.lit(None), gap)))

        return F.concat(F.array(section(F.lit(None), F.get(p["gaps"], F.lit(0)))), F.flatten(F.transform(p["elements"], one)))

    return F.filter(let(elements, around), lambda s: T.strip(s["text"]) != "")


def explode_chunks(df: DataFrame, chunks: Column, *keep: str) -> DataFrame:
    """``keep``, ``chunk_index`` and ``text``, one row per chunk that is not empty, numbered without gaps."""
    found = F.filter(chunks, lambda x: x != "")
    return df.select(*keep, F.posexplode(found).alias("chunk_index", "text"))


def length_chunks(df: DataFrame, text_col: str, size: int = 1000, overlap: int = 100, unit: str = "token", keep: tuple[str, ...] = ()) -> DataFrame:
    """Windows over the sanitised text, in words or characters."""
    clean = T.sanitize(F.col(text_col), remove_tags=True)
    df = spread(df)
    return explode_chunks(df, token_windows(clean, size, overlap) if unit == "token" else char_windows(clean, size, overlap), *keep)


def chunk_grid(df: DataFrame, sizes: tuple[int, ...] = GRID_SIZES, overlaps: tuple[int, ...] = GRID_OVERLAPS) -> DataFrame:
    """Every row with every valid pair of size and overlap; the pairs are a literal array, so nothing is joined."""
    pairs = [(s, o) for s in sizes for o in overlaps if o < s]
    return df.withColumn("grid", F.explode(F.array(*(F.struct(F.lit(s).alias("chunk_size"), F.lit(o).alias("chunk_overlap")) for s, o in pairs)))).select(*df.columns, "grid.chunk_size", "grid.chunk_overlap")


def window_count(n: Column, size: Column, overlap: Column) -> Column:
    """How many windows n units make."""
    return F.when(n <= 0, 0).when(n <= size, 1).otherwise(1 + F.ceil((n - size) / F.greatest(F.lit(1), size - overlap))).cast("int")


# --- chunks by structure ---------------------------------------------------------------------------------------------


def _cut_down(text: Column, size: int, overlap: int) -> Column:
    """A text over ``size`` and ``overlap`` together packed by sentence again, and what is still over cut by characters."""
    small = lambda t: F.length(t) <= size + overlap
    again = lambda t: F.flatten(F.transform(pack_sentences(t, size), lambda x: F.when(small(x), F.array(x)).otherwise(char_windows(x, size, overlap))))
    return F.when(small(text), F.array(text)).otherwise(again(text))


def _finished(chunks: Column, overlap: int) -> Column:
    """Chunks of struct<text, ...> without tags and blanks, empty ones left out, with overlaps."""
    fields = lambda c, text: c.withField("text", text)
    clean = F.filter(F.transform(chunks, lambda c: fields(c, T.sanitize(c["text"], True))), lambda c: c["text"] != "")
    return let(clean, lambda c: F.zip_with(c, with_overlap(F.transform(c, lambda x: x["text"]), overlap), fields))


def paragraph_chunks(text: Column, of_xml: Column, size: int, overlap: int) -> Column:
    """Array of struct<text, tag>: paragraphs (``of_xml``, or the text's own parted by blank lines), those over ``size`` packed by
    sentence, and short ones joined while they fit and their elements have one name."""
    own = F.transform(F.split(T.sanitize(text, True), rf"\n{T._WS}*\n"), lambda p: F.struct(T.strip(p).alias("text"), F.lit("paragraph").alias("tag")))
    clean = F.transform(F.coalesce(of_xml, own), lambda p: p.withField("text", T.sanitize(p["text"], True)))
    # a long paragraph's packs may be joined by what follows, but don't join what is before them
    parts = F.flatten(F.transform(clean, lambda p: F.transform(F.when(F.length(p["text"]) > size, pack_sentences(p["text"], size)).otherwise(F.array(p["text"])), lambda t: F.struct(t.alias("text"), p["tag"].alias("tag"), (F.length(p["text"]) <= size).alias("joins")))))
    known = F.filter(parts, lambda p: p["text"] != "")
    first = F.struct(F.expr("cast(array() as array<struct<first:int,last:int>>)").alias("done"), F.lit(1).alias("first"), F.lit(0).alias("last"), F.lit(0).alias("length"), F.lit("").alias("tag"))
    span = lambda s: F.array(F.struct(s["first"].alias("first"), s["last"].alias("last")))

    def add(s: Column, p: Column) -> Column:
        n = F.length(p["text"])
        joins = (s["last"] > 0) & p["joins"] & (s["tag"] == p["tag"]) & (s["length"] + n + 2 <= size)
        done = F.when(joins | (s["last"] == 0), s["done"]).otherwise(F.concat(s["done"], span(s)))
        return F.struct(done.alias("done"), F.when(joins, s["first"]).otherwise(s["last"] + 1).alias("first"), (s["last"] + 1).alias("last"), F.when(joins, s["length"] + 2 + n).otherwise(n).alias("length"), p["tag"].alias("tag"))

    spans = lambda k: F.aggregate(k, first, add, lambda s: F.when(s["last"] == 0, s["done"]).otherwise(F.concat(s["done"], span(s))))
    joined = lambda k: F.transform(spans(k), lambda r: F.struct(F.array_join(F.transform(F.slice(k, r["first"], r["last"] - r["first"] + 1), lambda p: p["text"]), "\n\n").alias("text"), F.get(k, r["first"] - 1)["tag"].alias("tag")))
    cut = F.flatten(F.transform(let(known, joined), lambda c: F.transform(_cut_down(c["text"], size, overlap), lambda t: F.struct(t.alias("text"), c["tag"].alias("tag")))))
    return _finished(cut, overlap)


def _of_type(kind: str, sections: Column) -> Column:
    """Array of struct<type, heading, text, clean>; sections without text drop out."""
    made = F.transform(sections, lambda s: F.struct(F.lit(kind).alias("type"), s["heading"].cast("string").alias("heading"), s["text"].alias("text"), T.sanitize(s["text"], True).alias("clean")))
    return F.filter(made, lambda s: s["clean"] != "")


def _json_parts(text: Column) -> Column:
    return _of_type("json", F.transform(json_sections(text), lambda t: F.struct(F.lit(None).alias("heading"), t.alias("text"))))


def _headed_parts(text: Column) -> Column:
    """Sections of markup (what begins with ``<``) or markdown."""
    bare = T.strip(text)
    headed = lambda s: F.nullif(T.sanitize(F.regexp_replace(s["heading"], "^#+", ""), True), F.lit(""))
    return F.when(bare.startswith("<"), _of_type("html", html_sections(bare))).otherwise(_of_type("markdown", F.transform(markdown_sections(bare), lambda s: s.withField("heading", headed(s)))))


def structured_chunks(df: DataFrame, id_col: str, text_col: str, chunker: str = "StructureChunker", size: int = 1000, overlap: int = 100) -> DataFrame:
    """``id_col``, ``chunk_index``, ``text``, ``metadata`` of chunks that keep to the text's structure; null texts have none.

    ``TextStructureChunker`` goes by paragraphs (metadata ``source_tag``). ``StructureChunker`` goes by sections (metadata
    ``section_type``, ``section_heading``); one over ``size`` goes by its paragraphs, with the metadata of both. Chunks hold no
    tags; sizes are characters, and a chunk has at most ``size`` and ``overlap`` besides the overlaps put in front of it. Rows
    equal in id are chunked each.
    """
    check_sizes(size, overlap)
    if chunker not in ("TextStructureChunker", "StructureChunker"):
        raise ValueError(f"no such chunker: {chunker}")
    by_section = chunker == "StructureChunker"
    rows = spread(df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    is_json = T.strip(F.col("text")).rlike(r"^[{\[]") if by_section else F.lit(False)
    whole = F.array(F.struct(F.lit(None).cast("string").alias("heading"), F.col("text").alias("text")))
    # two columns and two Arrow functions that don't feed each other
    parted = rows.select("id", "text", F.when(~is_json, _headed_parts(F.col("text")) if by_section else _of_type("", whole)).alias("headed"))
    small = lambda s: (F.length(s["clean"]) <= size) if by_section else F.lit(False)
    markup = F.transform("headed", lambda s: F.when(~small(s) & F.ltrim(s["text"]).startswith("<"), s["text"]))
    with_trees = parted.withColumn("xml", xml_paragraphs(F.when(F.exists(markup, lambda t: t.isNotNull()), markup)))
    trees = with_trees.withColumn("sections", F.when(is_json, _json_parts(F.col("text"))).otherwise(F.col("headed")) if by_section else F.col("headed"))
    # beside the sections and not asked for inside the lambda, where no Arrow function can be called
    paired = F.zip_with("sections", F.coalesce("xml", F.expr("cast(array() as array<array<struct<text:string,tag:string>>>)")), lambda s, x: s.withField("xml", x))

    def of_section(s: Column) -> Column:
        named = lambda text, tag: F.struct(text.alias("text"), F.nullif(s["type"], F.lit("")).alias("section_type"), s["heading"].alias("section_heading"), tag.cast("string").alias("source_tag"))
        long = F.flatten(F.transform(paragraph_chunks(s["text"], s["xml"], size, overlap), lambda c: F.transform(_cut_down(c["text"], size, overlap) if by_section else F.array(c["text"]), lambda t: named(t, c["tag"]))))
        return F.when(small(s), F.array(named(s["clean"], F.lit(None)))).otherwise(long)

    every = F.flatten(F.transform(paired, of_section))
    chunks = _finished(every, overlap) if by_section else every
    given = lambda k: F.when(F.col(f"c.{k}").isNotNull(), F.struct(F.lit(k).alias("key"), F.col(f"c.{k}").alias("value")))
    metadata = F.map_from_entries(F.array_compact(F.array(*map(given, ("section_type", "section_heading", "source_tag")))))
    return trees.select("id", F.posexplode(chunks).alias("chunk_index", "c")).select(F.col("id").alias(id_col), "chunk_index", "c.text", metadata.alias("metadata"))
