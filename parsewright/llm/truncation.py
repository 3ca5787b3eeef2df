"""Problem 2: texts that were cut off by a field limit or in transfer.

Lengths are computed anew as they were before storage: in several encodings, with entities or JSON
escapes, with other line ends. Where many of a parser's texts have one and the same length in one of
these measures, a hidden limit shows; each text speaks for one limit alone, that which explains most texts. Then the
endings are inspected: markup left open, a table row, a sentence, a word that stops; what stands after the cut (a mark of
omission, a page number, a running header) is looked through. Both together decide: at a limit, an ending that might be
complete counts as cut off if whole texts of that length are rare enough.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parsewright.llm.corpus import count_words
from parsewright.llm.quality import cells_of
from parsewright.session import cut_lineage, spread

#: A limit shows if the texts of that length exceed what the lengths around lead to expect by so many deviations and texts.
DEVIATIONS, LEAST_EXCESS = 6.0, 4
#: Lengths around, on either side, that tell how many texts to expect.
AROUND = 60

#: How much rarer an end that looks complete is among texts cut off than among whole ones.
COMPLETE_ENDS = 0.05 / 0.95

#: A last word is a piece if the words that it begins are so many times as frequent as itself.
LONGER = 50

_OMISSION = re.compile(r"(?:\[\s*(?:\.\.\.|…|truncated|cut|snip|more|continued|cont\.?)[^\]]{0,40}\]|\((?:cont(?:inued|\.|['’]d)?|truncated|more|cut|abridged)[^)]{0,30}\)?|<\s*truncated\s*>|…|\.\.\.|(?:read|show|see) more\W*|\btruncated\b\W*|[\[<(](?:[a-z]+ ){0,4}(?:cut|cut off|limit|reached|exceeded|omitted|remainder|abridged|incomplete)(?: [a-z]+){0,3}[\]>)]|\(continued on [^)]*\)?|<!--[^>]*(?:-->)?)\s*$", re.I)
_PAGE = re.compile(r"^\W*(?:(?:p|pp|page|seite|página|pág|s)\b\.?\s*)?(?:\d{1,4}|[ivxlc]{1,7})(?:\s*(?:of|/|von|de|sur)\s*\d{1,4})?[\s|*»\])–—-]*(?:\|?\s*p\s?a\s?g\s?e)?[\s|*»\])–—-]*$", re.I)
_HEAD = re.compile(r"\(\d{4}\)\s*\d+\s*[–-]\s*\d+|\bet al\.?\s*(?:\d+)?$", re.I)
# Beginnings of notes that stand after a paper's text and end without a mark.
_NOTE = re.compile(r"^\W*(?:©|\(c\)|copyright\b|word count\b|received\b|accepted\b|keywords?\b|key words\b|\(?correspond|this work was supported|supported by|funding\b|doi\b|https?:|license|licence|table \d|figure \d|note\b|conflicts?\b)", re.I)
_REFERENCE_END = re.compile(r"\b(?:1[89]|20)\d\d;\s*\d+(?:\(\d+\))?:\s*\d+[–-]\d+$|\d+(?:\(\d+\))?,\s*\d+[–-]\d+$|(?:doi|https?)[:.]\S{12,}\d$", re.I)
_SENTENCE_END = re.compile(r"[.!?。！？][\"'”’»)\]*_]*$")
_CLOSERS = re.compile(r"(?:\s*</[A-Za-z][\w:.-]*>)+\s*$")
_LISTED = re.compile(r"^\s*(?:[-*•–—▪◦+]\s|\(?\d{1,3}[.)]\s|\d+(?:\.\d+)+\s|#{1,6}\s)")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
# a sign of a formula, or a single letter as in "vitamin D"
_SYMBOL = re.compile(r"(?:[=+*/^−<>]\s*[^\W\d_]|(?<!\S)[A-ZÀ-Ý])$")
_ITEM = re.compile(r"\s*\S{1,24}(?:\s\S{1,24}){0,3}\s*([=:])\s+\S")
_TAG_OR_ENTITY = re.compile(r"</?[A-Za-z][\w:.-]*[^<>]*>|&\w+;")
_SIGNS = re.compile(r"[^\w\s.|\-–,;:()\[\]&]|_")
_STRANGE = re.compile("[\ufffd\x00-\x08\x0e-\x1f]")
_LETTERS = re.compile(r"[^\W\d_]+")
_NO_VOWEL = re.compile(r"(?<![^\W\d_])[b-df-hj-np-tv-xzB-DF-HJ-NP-TV-XZ]{2,}(?![^\W\d_])")
_BEFORE_ROOT = re.compile(r"\s*(?:<[?!][^>]*>\s*)*")
_ROOT = re.compile(r"<([A-Za-z][\w:.-]*)(?=[\s>])")
_OPEN_TAG = re.compile(r"<[A-Za-z/][^<>]*$")
_OPEN_MARK = re.compile(r"<[A-Za-z/][^<>\n]*$|</?$|&[a-z]{1,5}$|&#\d*$")
_ANY_TAG = re.compile(r"<[A-Za-z/!?][^<>]*>")
_ENVIRONMENTS = (("<table", "</table>"), ("\\begin{tabular}", "\\end{tabular}"), ("<row", "</row>"), ("<cell", "</cell>"), ("<list", "</list>"), ("<item", "</item>"))
_NOT_LETTERS = re.compile(r"[\W\d_]+")
#: An end is read over so many characters at least, in whole paragraphs.
READ_AT_LEAST = 500


MEASURES = ("characters", "utf8", "utf16", "entities", "entities_quot", "entities_utf8", "json", "json_utf8", "crlf", "crlf_utf8", "lf", "lf_utf8")


def measures(text: str) -> list[int]:
    """Lengths that a field may have been limited by, in the order of MEASURES."""
    chars, octets = len(text), len(text.encode("utf-8", "surrogatepass"))
    utf16 = chars if octets == chars else len(text.encode("utf-16-le", "surrogatepass")) // 2
    count = text.count
    crlf, lf = count("\r\n"), count("\n")
    quot = count('"')
    entities = count("&") * 4 + (count("<") + count(">")) * 3
    json = quot + count("\\") + lf + count("\t") + count("\r")
    return [chars, octets, utf16, chars + entities, chars + entities + quot * 5, octets + entities, chars + json, octets + json, chars + lf - crlf, octets + lf - crlf, chars - crlf, octets - crlf]


def inspect(df: DataFrame, id_col: str, source_col: str, content_col: str) -> DataFrame:
    """``id``, ``source``, ``hash``, ``state`` and ``detail`` of the ending, ``sizes`` by MEASURES; one row per row with text."""
    kind = df.schema[id_col].dataType.simpleString()
    content = F.col(content_col)
    known = df.where(content.rlike(r"(?U)\S")).select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(content).alias("hash"), content.alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("content").to_pylist()
            states = [ending(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("id", "source", "hash")] + [pa.array([s for s, _ in states], pa.string()), pa.array([d for _, d in states], pa.string()), pa.array([measures(t) for t in texts], pa.list_(pa.int32()))], names=["id", "source", "hash", "state", "detail", "sizes"])

    return spread(known).mapInArrow(run, f"id {kind}, source string, hash bigint, state string, detail string, sizes array<int>")


def _limits(ends: DataFrame) -> DataFrame:
    """``source``, ``measure``, ``size``, ``n``, ``expected`` of each limit that the rows of ``inspect`` show."""
    texts = ends.groupBy("source", "hash").agg(F.first("sizes").alias("sizes"))
    each = texts.select("source", "hash", F.posexplode("sizes").alias("at", "size"))
    sizes = each.groupBy("source", "at", "size").agg(F.count("*").alias("n"))
    around = Window.partitionBy("source", "at").orderBy("size").rangeBetween(-AROUND, AROUND)
    judged = sizes.withColumn("expected", (F.sum("n").over(around) - F.col("n")) / (2.0 * AROUND))
    rare = lambda n: (n >= F.col("expected") + DEVIATIONS * F.sqrt("expected") + LEAST_EXCESS) & (n >= 5 * F.col("expected"))
    possible = judged.where(rare(F.col("n"))).withColumnRenamed("n", "all_n")
    same = F.col("e.source").eqNullSafe(F.col("l.source")) & (F.col("e.at") == F.col("l.at")) & (F.col("e.size") == F.col("l.size"))
    # a text speaks for the limit that explains most texts, of such for the plainest measure; what is left of the others is judged again
    best = each.alias("e").join(possible.alias("l"), same).groupBy("e.source", "e.hash").agg(F.max(F.struct("l.all_n", (-F.col("l.at")).alias("minus_at"), "l.size", "l.expected")).alias("b"))
    kept = best.groupBy("source", (-F.col("b.minus_at")).alias("at"), F.col("b.size").alias("size")).agg(F.count("*").alias("n"), F.first("b.expected").alias("expected")).where(rare(F.col("n")))
    return kept.select("source", F.element_at(F.array(*map(F.lit, MEASURES)), F.col("at").cast("int") + 1).alias("measure"), "size", "n", "expected")


def length_limits(df: DataFrame, source_col: str = "parser", content_col: str = "content") -> DataFrame:
    """``source``, ``measure``, ``size``, ``n``, ``expected`` of each hidden limit.

    Equal texts count once, and each for one limit. Expected is the mean count of the lengths around. A source and measure with
    few texts shows no limit.
    """
    return _limits(cut_lineage(inspect(df.withColumn("_no", F.lit(0)), "_no", source_col, content_col)))


def _plain(line: str) -> str:
    return _NOT_LETTERS.sub(" ", line.lower()).strip()


def ending(content: str) -> tuple[str, str | None]:
    """State of a text's end: ``complete``; ``cut`` with a reason; or ``open`` with the last word, which the corpus must judge."""
    text = content.rstrip()
    if not text or unreadable(text):
        return "complete", None
    head = _BEFORE_ROOT.match(text)
    root = _ROOT.match(text, head.end())
    if root and (head.end() and text.lstrip().startswith("<?xml") or root.group(1).lower() in ("tei", "html", "article") or text.lstrip()[:9].lower() == "<!doctype"):
        if not re.search(rf"</{re.escape(root.group(1))}>\Z", text):
            return "cut", "markup"
    elif root and _OPEN_TAG.search(text, max(text.rfind("<"), 0)):
        return "cut", "markup"
    low = text.lower()
    if any(opening in low and low.count(opening) > low.count(closing) for opening, closing in _ENVIRONMENTS):
        return "cut", "markup"
    if _OPEN_MARK.search(text, max(0, text.rfind("<"), text.rfind("&"))) and (text.rfind("<") >= 0 or text.rfind("&") >= 0):
        return "cut", "markup"
    marked = False
    closed = _CLOSERS.sub("", text)
    in_markup = closed != text
    text = _ANY_TAG.sub("\n", closed) if in_markup else text
    text = text.rstrip()
    m = _OMISSION.search(text)
    while m and m.start() > 0:
        if not re.match(r"\.\.\.", m.group()) or not re.search(r"\.{4,}$", text[: m.end()].rstrip()):
            marked = True
            text = text[: m.start()].rstrip()
            m = _OMISSION.search(text)
        else:
            break
    if marked:
        return "cut", "omission"
    lines = [x.rstrip() for x in text.replace("\x0c", "\n").split("\n")]
    filled = [x for x in lines if x.strip()]
    if not filled:
        return "complete", None
    plain = [_plain(x) for x in filled]
    title = " ".join(plain[:3])
    k = len(filled) - 1
    # page numbers, running headers and footers at the end
    while k > 0 and (_PAGE.match(filled[k]) or _HEAD.search(filled[k]) and len(filled[k]) < 80 or _furniture(filled[k], plain, k, title)):
        k -= 1
    last = filled[k].strip()
    paragraph = _paragraph(filled, lines, k)
    if _NOTE.match(paragraph):
        if _NOTE.match(paragraph).group().lower().lstrip("( ") in ("table", "figure"):
            return "complete", None
        return ("open", _last_word(last)) if re.search(r"[^\W\d_]$", last) else ("cut", "bracket") if _unclosed(last) else ("complete", None)
    if last.startswith("|") or last.count("|") >= 3:
        return ("complete", None) if last.endswith("|") else ("cut", "row")
    if _SENTENCE_END.search(last) or last.endswith((":", ";")) and len(cells_of(last)) < 3:
        return "complete", None
    if re.search(r"[^\W\d_]-$", last):
        return "cut", "word"
    if last.endswith(("$$", "\\]", "```", "\\\\", "\\end{tabular}", "|")):
        return "complete", None
    if _REFERENCE_END.search(last):
        return "complete", None
    words = _WORD.findall(last)
    cells = cells_of(last)
    if len(cells) >= 3 or len(words) <= 1 and re.search(r"\d", last):
        return ("cut", "row") if _unclosed(last) or re.search(r"[.,(\[]$", last) else ("open", _last_word(last)) if re.search(r"[^\W\d_]$", last) else ("complete", None)
    if not _is_item(filled, k) and _running(paragraph, last) and not _listing(filled, k):
        return "cut", "sentence"
    if _unclosed(last):
        return "cut", "bracket"
    return ("open", _last_word(last)) if re.search(r"[^\W\d_]$", last) else ("complete", None)


def unreadable(text: str) -> bool:
    """Whether the end of a text, its last paragraphs, is nothing that one could read: where that stops, nothing is cut off."""
    at = len(text)
    while at > 0 and len(text) - at < READ_AT_LEAST:
        at = max(0, text.rfind("\n\n", 0, at))
    return is_garbled(text[at:])


def is_garbled(text: str) -> bool:
    """Whether a stretch of text, tags aside, is signs, broken characters, or words without vowels."""
    if sum(map(text.count, "aeiou")) > 0.25 * len(text) and text.count(" ") > 0.1 * len(text):
        return False  # written as most languages with Latin letters are
    bare = _TAG_OR_ENTITY.sub(" ", text) if "<" in text or "&" in text else text
    parts = bare.split()
    n = sum(map(len, parts))
    if n < 80:
        return False
    if len(_STRANGE.findall(bare)) > 0.15 * n or len(_SIGNS.findall(bare)) > 0.4 * n or sum(len(t) for t in parts if len(t) > 40) > 0.5 * n:
        return True
    return len(_NO_VOWEL.findall(bare)) > 0.4 * max(8, len(_LETTERS.findall(bare)))


def _furniture(line: str, plain: list[str], k: int, title: str) -> bool:
    """A short line that stands in the text elsewhere as well, or begins the title, or names its authors."""
    p = plain[k]
    if len(p) > 70 or len(p) < 4 or _SENTENCE_END.search(line.rstrip()) or _LISTED.match(line) or line.lstrip().startswith("|") or len(cells_of(line)) >= 3:
        return False
    squeezed = p.replace(" ", "")
    return any(i != k and (q == p or len(p) >= 12 and q.replace(" ", "").startswith(squeezed)) for i, q in enumerate(plain[:-1])) or len(p) >= 12 and title.replace(" ", "").startswith(squeezed)


def _paragraph(filled: list[str], lines: list[str], k: int) -> str:
    """The lines up to the k-th filled one without a blank line between."""
    seen, at = -1, 0
    for at, x in enumerate(lines):
        seen += bool(x.strip())
        if seen == k:
            break
    first = at
    while first > 0 and lines[first - 1].strip():
        first -= 1
    return " ".join(x.strip() for x in lines[first : at + 1])


def _is_item(filled: list[str], k: int) -> bool:
    """Whether the last line gives a name and what it stands for, as most of the lines before it do."""
    own = _ITEM.match(filled[k])
    return bool(own) and sum(bool((m := _ITEM.match(x)) and m.group(1) == own.group(1)) for x in filled[max(0, k - 3) : k]) >= min(2, k)


def _listing(filled: list[str], k: int) -> bool:
    """Whether the last lines are items of a list: short, of uneven length, without the marks of sentences."""
    near = [x.strip() for x in filled[max(0, k - 4) : k]]
    if len(near) < 2 or any(_SENTENCE_END.search(x) or len(x) > 75 for x in near):
        return False
    if any(re.search(r"[.!?]\s+[A-ZÀ-Ý]|,$|-$", x) for x in near):
        return False
    return max(map(len, near)) - min(map(len, near)) > 12 or all(x.count(";") == 1 for x in near)


def _last_word(text: str) -> str | None:
    found = _WORD.findall(text)
    return found[-1].lower() if found and not _SYMBOL.search(text) else None


def _unclosed(text: str) -> bool:
    return text.count("(") > text.count(")") or text.count("[") > text.count("]") or text.count("“") > text.count("”")


# Frequent short words of running text in the four languages of the contents.
_RUNNING = frozenset("the of and to in is was were that for with as by on from at which are be an we not or it had have der die und den von das mit sich des auf für ist im dem ein eine wurde wurden war bei dass la de que el en los se del las un por con una su al le les des est dans par sur pour qui au une du ont été a à".split())


def _running(paragraph: str, last: str) -> bool:
    """Whether the end stands in running text: a line or paragraph with sentences or with function words as sentences have."""
    if _LISTED.match(last) and len(_WORD.findall(last)) < 9:
        return False
    words = [w.lower() for w in _WORD.findall(paragraph)]
    tail = re.split(r"(?<=[.!?])\s+", paragraph)[-1]
    own = [w.lower() for w in _WORD.findall(tail)]
    sentences = len(re.findall(r"[a-zà-ÿ)\]%][.!?][\"”)]?\s+[A-ZÀ-Ý“(]", paragraph))
    function = sum(w in _RUNNING for w in words) / max(1, len(words))
    if sentences and function >= 0.15:
        return True
    return len(own) >= 5 and function >= 0.2 and not re.search(r"\b(?:19|20)\d\d\b.*\d+\s*[:;(]", paragraph) and last[-1:] not in ")]”" or len(own) >= 3 and tail[:1].isupper() and not last.startswith("#") and sum(w in _RUNNING for w in own) >= 2


def _whole_words(counts: DataFrame, asked: DataFrame) -> DataFrame:
    """``word`` of those asked for that stand elsewhere as words of their own: not only at line ends, where scans leave
    pieces, beside far more longer words that begin with them."""
    begun = counts.select("word", "n", "n_inside", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("k")).select(F.substring("word", F.lit(1), F.col("k")).alias("begin"), "word", "n", "n_inside")
    own = F.col("begin") == F.col("c.word")
    sums = asked.alias("a").join(begun.alias("c"), F.col("a.word") == F.col("c.begin")).groupBy("a.word")
    known = sums.agg(F.sum(F.when(own, F.col("n"))).alias("n"), F.sum(F.when(own, F.col("n_inside")).otherwise(0)).alias("whole"), F.sum(F.when(~own, F.col("n_inside")).otherwise(0)).alias("longer"))
    return known.where((F.col("n") >= 2) & (F.col("longer") <= LONGER * F.greatest("whole", F.lit(1)))).select("word")


def find_truncated(df: DataFrame, id_col: str = "parse_id", content_col: str = "content", source_col: str = "parser") -> DataFrame:
    """``id_col``, ``source`` and ``reason`` of each row whose text was cut off; equal rows come out each.

    Reasons: ``limit`` (at a hidden limit), ``markup``, ``omission``, ``row``, ``word``, ``sentence``,
    ``bracket``. Null, empty and blank texts are no case; a null source counts as a source of its own.
    Other columns play no part.
    """
    ends = cut_lineage(inspect(df, id_col, source_col, content_col))  # numbers alone, no texts
    limits = _limits(ends).groupBy("source").agg(F.collect_list(F.struct("measure", "size", "n", "expected")).alias("limits"))
    number = F.create_map(*(x for k, m in enumerate(MEASURES) for x in (F.lit(m), F.lit(k + 1))))

    def reached(limit: Column) -> Column:
        size = F.element_at("e.sizes", number[limit["measure"]])
        # a character that a limit of bytes would part is left out as a whole
        return (size <= limit["size"]) & (size >= limit["size"] - F.when(limit["measure"].like("%utf8"), 3).otherwise(0))

    odds = lambda x: (x["n"] - x["expected"]) / F.greatest(x["expected"], F.lit(1.0 / (2 * AROUND)))
    at = F.filter("l.limits", reached)
    joined = ends.alias("e").join(limits.alias("l"), F.col("e.source").eqNullSafe(F.col("l.source")), "left").select("e.id", "e.source", "e.state", "e.detail", F.coalesce(F.size(at) > 0, F.lit(False)).alias("at_limit"), F.coalesce(F.array_max(F.transform(at, odds)), F.lit(0.0)).alias("odds"))
    sure = joined.where((F.col("state") == "cut") | F.col("at_limit") & ((F.col("state") == "open") | (F.col("odds") * COMPLETE_ENDS > 1)))
    reason = F.when(F.col("state") == "cut", F.col("detail")).otherwise("limit")
    opened = joined.where("state = 'open' and detail is not null and not at_limit")
    # only these are judged by their last words, which are few and short
    words = opened.select(F.col("detail").alias("word")).distinct()
    unknown = words.join(_whole_words(count_words(df, content_col), words), "word", "left_anti")
    pieces = opened.join(unknown, F.col("detail") == F.col("word"), "left_semi")
    return sure.select("id", "source", reason.alias("reason")).unionByName(pieces.select("id", "source", F.lit("word").alias("reason"))).withColumnRenamed("id", id_col)


def truncation_rates(df: DataFrame, id_col: str = "parse_id", content_col: str = "content", source_col: str = "parser") -> DataFrame:
    """``source``, ``n_rows``, ``n_truncated``, ``share``: of each source's rows with text, how many are cut off."""
    cut = find_truncated(df, id_col, content_col, source_col).groupBy("source").agg(F.count("*").alias("n_truncated"))
    rows = df.where(F.col(content_col).rlike(r"(?U)\S")).groupBy(F.col(source_col).cast("string").alias("source")).agg(F.count("*").alias("n_rows"))
    joined = rows.alias("r").join(cut.alias("c"), F.col("r.source").eqNullSafe(F.col("c.source")), "left")
    n = F.coalesce("c.n_truncated", F.lit(0)).cast("bigint")
    return joined.select("r.source", "r.n_rows", n.alias("n_truncated"), (n / F.col("r.n_rows")).alias("share"))
