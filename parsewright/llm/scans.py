"""Problem 5: noise in text from scanned pages.

Running headers and footers are found by their fuzzy repetition at page edges, page numbers as sequences.
What is left is running text: words split at line ends are joined by rules that ask the corpus'
vocabulary, and misrecognised characters are found as rare words that a known confusion turns into a
word that is far more frequent.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache
from heapq import nsmallest

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parsewright.llm.corpus import FLUSH
from parsewright.llm.quality import cells_of, to_lines
from parsewright.llm.truncation import _RUNNING, is_garbled
from parsewright.session import cut_lineage, spread

#: A word is misread if a confusion makes it a word this many times as frequent, that occurs so often at least.
RATIO, LEAST_COUNT = 12, 6
#: Characters of the longest line that can be a running header or footer.
LONGEST_HEAD = 300
#: Likeness from which two running lines are the same, and a line begins the title.
SAME_LINE, SAME_TITLE = 0.88, 0.86
#: Lines up to which each is compared with all; more are compared by an index, with the same result.
FEW_LINES = 48
#: Entries of the lookup table up to which it is broadcast to the workers; a larger one is joined.
MOST_BROADCAST = 300_000

# What a character or pair is read as.
CONFUSIONS = (
    ("rn", "m"), ("m", "rn"), ("cl", "d"), ("d", "cl"), ("vv", "w"), ("w", "vv"), ("li", "h"), ("h", "li"), ("ii", "u"), ("u", "ii"), ("in", "m"), ("ri", "n"), ("n", "ri"),
    ("h", "b"), ("b", "h"), ("e", "c"), ("c", "e"), ("n", "u"), ("u", "n"), ("t", "f"), ("f", "t"), ("i", "l"), ("l", "i"), ("i", "j"), ("o", "c"), ("a", "o"), ("o", "a"), ("e", "o"), ("s", "5"), ("5", "s"), ("g", "9"), ("g", "q"), ("q", "g"), ("y", "v"), ("v", "y"),
    ("l", "1"), ("i", "1"), ("l", "|"), ("i", "|"), ("i", "!"), ("l", "!"), ("o", "0"), ("a", "@"), ("s", "$"), ("b", "6"), ("b", "8"), ("t", "7"), ("z", "2"), ("e", "3"), ("a", "4"), ("g", "6"), ("r", "f"), ("t", "l"), ("l", "t"), ("c", "o"), ("s", "8"), ("e", "€"), ("c", "("), ("k", "lc"), ("i", "í"), ("b", "lo"), ("m", "nn"), ("nn", "m"), ("d", "ol"), ("a", "ci"), ("t", "+"), ("m", "in"), ("n", "r1"),
)
# Words before which a hyphen at a line's end stands for a part left out.
_SUSPENDED = frozenset("and or to und oder bis sowie y e o u et ou a as als versus vs but".split())

# Short words of several languages, which differ from each other by single characters.
_SHORT = frozenset("do lo la le li da di du de no so si su se es et en un um am im an in on or of if is it he be by my me we us up to go as at ya yo al el ne na ni ou tu te il ce ci ab ob zu er den dem der des die das les los las una uno une".split())

_HYPHENS = "-¬­‐‑"
_PAGE = re.compile(r"^[\s\f]*(?P<pre>[-–—\[(|*«\s]*(?:(?:page|p|pp|seite|s|página|pág)\b\.?\s*)?)(?P<num>\d{1,4}|[ivxlc]{1,7})(?P<of>\s*(?:of|/|von|de|sur)\s*\d{1,4})?(?P<post>[\s|\])*»–—-]*(?:p\s?a\s?g\s?e)?[\s|\])*»–—-]*)$", re.I)
_JOURNAL = re.compile(r"\(?(?:1[89]|20)\d\d\)?[\s,;:]+\d+\s*[–-]\s*\d+\s*(?:\d{1,4})?$")
_ET_AL = re.compile(r"^\W*(?:\d{1,4}\s+)?[^\W\d_][\w'’-]+(?:\s+(?:&|and|und|y|et)\s+[\w'’-]+)?\s+et\s+al\W*(?:\d{1,4}\W*)?$", re.I)
_NUMBERED = re.compile(r"^(?:\d{1,4}|[ivxlc]{1,6}) {2,}\S|\S {2,}(?:\d{1,4}|[ivxlc]{1,6})$", re.I)
_END = re.compile(r"[.!?:][\"'”’»)\]]*$")
_NUMBER_ONLY = re.compile(r"^\s*[-–]?[\d.,%()<=\s]+$")
_LISTED = re.compile(r"#|\||[-*•–]\s|\d+(?:\.\d+)*\.?\s+[A-ZÀ-Ý][a-zà-ÿ]+(?:\s[a-zà-ÿ]+){0,4}$")
_TOKEN = re.compile(r"[^\W_](?:[^\s,;:?\"“”()\[\]<>/=.…–—]*[^\W_])?|[@|!$€(][^\W\d_][\w|@!$€]+")
_LETTER = re.compile(r"[^\W\d_]")
_LEFT, _LEFT_PIECE = re.compile(r"[^\W\d_]\S*$"), re.compile(r"[^\W_][^\s(\[“\"]*$")
_RIGHT_PIECE, _BULLET = re.compile(r"[^\W_][^\s,;:.?!)\]”\"]*"), re.compile(r"\s*[-*•–]\s")


def _key(line: str) -> str:
    return "".join(filter(str.isalpha, line.lower()))


def _grams(k: str) -> set[str]:
    return {k[i : i + 3] for i in range(len(k) - 2)}


def _alike(a: str, b: str, least: float) -> bool:
    return SequenceMatcher(None, a, b, autojunk=False).ratio() >= least


class Repeats:
    """Which of some lines, by their letters, stand there again, exactly or nearly so.

    Letters that two lines don't share destroy three of their three-letter groups each at most, so alike lines share
    groups among the rarest of either; only lines that do are compared. Nothing that is alike is missed, and the cost
    grows with the lines, not with their pairs.
    """

    def __init__(self, keys: list[str]):
        self.counts = Counter(keys)
        self.known: dict[str, bool] = {}
        self.grams: dict[str, set[str]] = {}
        self.rare: dict[str, list[str]] = {}
        self.index: dict[tuple[str, int], list[str]] = {}

    def _build(self) -> None:
        self.grams = {k: _grams(k) for k in self.counts if len(k) >= 8}
        if len(self.grams) <= FEW_LINES:
            return
        frequent = Counter(g for grams in self.grams.values() for g in grams)
        for k, grams in self.grams.items():
            self.rare[k] = nsmallest(_lost(k, SAME_LINE) + 1, grams, key=lambda g: (frequent[g], g))
            for g in self.rare[k]:
                self.index.setdefault((g, len(k)), []).append(k)

    def repeated(self, k: str) -> bool:
        """Whether ``k``, one of the lines, has another like it."""
        if self.counts[k] > 1:
            return True
        if len(k) < 8:
            return False
        if k not in self.known:
            if not self.grams:
                self._build()
            lengths = range(len(k) - 2, len(k) + 3)
            others = {x for g in self.rare[k] for n in lengths for x in self.index.get((g, n), ())} if self.rare else (x for x in self.grams if len(x) in lengths)
            least = len(self.grams[k]) - _lost(k, SAME_LINE)
            self.known[k] = any(x != k and len(self.grams[k] & self.grams[x]) >= least and _alike(k, x, SAME_LINE) for x in others)
        return self.known[k]


def _lost(k: str, least: float) -> int:
    """Three-letter groups that a line as like ``k`` as ``least`` may lack at most."""
    return 3 * int((1 - least) * (len(k) + 1) + 1)


def _roman(s: str) -> int:
    values = [dict(i=1, v=5, x=10, l=50, c=100)[c] for c in s.lower()]
    return sum(-v if any(w > v for w in values[i + 1 : i + 2]) else v for i, v in enumerate(values))


def page_lines(lines: list[str], garbled: frozenset[int] = frozenset()) -> tuple[set[int], set[int]]:
    """Indexes of the lines that are page numbers, and of those that are running headers or footers. Garbled lines are neither."""
    filled = [i for i, x in enumerate(lines) if x.strip() and i not in garbled]
    if len(filled) < 2:
        return set(), set()
    place = {i: k for k, i in enumerate(filled)}
    first, last = filled[0], filled[-1]
    feeds: set[int] = set()
    for i, x in enumerate(lines):
        if "\f" in x:
            k = bisect.bisect_left(filled, i)
            if k < len(filled) and filled[k] == i:
                feeds.add(i)
            if k > 0:
                feeds.add(filled[k - 1])
    found = []
    for i in filled:
        m = _PAGE.match(lines[i])
        if not m:
            continue
        num = m["num"]
        roman = not num.isdigit()
        signature = (re.sub(r"\s", "", m["pre"]).lower(), bool(m["of"]), re.sub(r"\s", "", m["post"]).lower(), roman)
        found.append((i, signature, _roman(num) if roman else int(num)))
    numeric = {i for i in filled if _NUMBER_ONLY.match(lines[i])}
    pages: set[int] = set()
    by_signature: dict[tuple, list[int]] = {}
    for _, signature, value in found:
        by_signature.setdefault(signature, []).append(value)
    passed: Counter = Counter()
    for i, signature, value in found:
        same, at = by_signature[signature], passed[signature]
        passed[signature] += 1
        chained = at > 0 and same[at - 1] + 1 == value or at + 1 < len(same) and same[at + 1] - 1 == value
        edge = i in (first, last) or i in feeds
        strong = bool(re.search(r"p|s\.?$|[-–—]|seite", signature[0]) or "page" in signature[2] or signature[1])
        beside = [j for j in (place[i] - 1, place[i] + 1) if 0 <= j < len(filled)]
        in_table = not strong and not signature[0] and not signature[3] and any(filled[j] in numeric for j in beside)
        if in_table and not chained:
            continue
        if in_table and sum(filled[j] in numeric for j in range(max(0, place[i] - 2), min(len(filled), place[i] + 3))) >= 3:
            continue
        if strong or chained or edge or signature[0] in ("[", "(") and not signature[3]:
            pages.add(i)
    edges = set(pages) | feeds | {first, last}
    near = {filled[j] for i in edges for j in (place[i] - 2, place[i] - 1, place[i], place[i] + 1, place[i] + 2) if 0 <= j < len(filled)}

    body = [i for i in filled if i not in pages]
    head = body[:6]
    start = 0
    while start + 1 < len(head) and (_heading_like(lines[head[start]]) or len(_key(lines[head[start]])) >= 10 and _key(" ".join(lines[i] for i in head[start + 1 : start + 4])).startswith(_key(lines[head[start]]))):
        start += 1
    title_lines = head[start : start + 3]
    title = _key(" ".join(lines[i] for i in title_lines))
    titled = any(_author_line(lines[i]) for i in head[start + 1 : start + 4])  # else the first lines may be running text
    names = {_key(w) for i in head[start + 1 : start + 4] if _author_line(lines[i]) for w in re.findall(r"[^\W\d_][\w'’-]+(?=\s*(?:,|;|&|$|\band\b))", lines[i])}
    running: set[int] = set()
    keys = {i: _key(lines[i]) for i in body}
    breaks = pages | feeds
    repeats = Repeats([keys[i] for i in near if i in keys])
    title_grams = _grams(title)
    for i in body:
        line = lines[i].strip()
        k = keys[i]
        if len(line) > LONGEST_HEAD or not k or i in title_lines[:1] and not _heading_like(line) or _LISTED.match(line):
            continue
        numbered = bool(_NUMBERED.search(line))
        if len(line) <= 90 and _JOURNAL.search(line) and (i in near or k in repeats.counts) and not re.search(r"\.\s+[A-Z][a-z]+ [a-z]", line):
            running.add(i)
        elif _ET_AL.match(line) and (i in near or numbered):
            running.add(i)
        elif k in names and len(line.split()) <= 3 and (i in near or numbered):
            running.add(i)
        elif len(k) >= 10 and i not in title_lines and (titled or line.isupper() or numbered) and _is_prefix(k, title, title_grams) and not _END.search(line.rstrip(": ")):
            running.add(i)
    for i in body:
        line = lines[i].strip()
        if i in running or i in title_lines or i not in near or _LISTED.match(line) or len(line) > LONGEST_HEAD or not keys[i] or _END.search(line) and not _ET_AL.match(line):
            continue
        if _NUMBERED.search(line) and len(cells_of(line)) < 3 and len(keys[i]) >= 3 and not re.match(r"^\d+\s{2,}[a-z]", line):
            running.add(i)
        elif len(keys[i]) >= 4 and len(line) <= 70 and "=" not in line and (line.isupper() or line[:1].isupper() and _beside_number(i, filled, place, breaks) and sum(w in _RUNNING for w in line.lower().split()) < 3) and repeats.repeated(keys[i]):
            running.add(i)
    # a header stands above the head of the paper as well; a title, which authors follow, doesn't count as one
    for i in head[:1]:
        own = keys[i]
        same = [j for j in running if own and (keys[j] == own or len(own) >= 12 and _alike(keys[j], own, SAME_LINE))]
        if i not in running and same and not any(_author_line(lines[j]) for j in head[1:3]) and len(lines[i].strip()) <= LONGEST_HEAD:
            running.add(i)
    return pages, running


def _beside_number(i: int, filled: list[int], place: dict[int, int], edges: set[int]) -> bool:
    k = place[i]
    return i in edges or any(0 <= j < len(filled) and filled[j] in edges for j in (k - 1, k + 1))


def _heading_like(line: str) -> bool:
    line = line.strip()
    return bool(_ET_AL.match(line) or len(line) <= 90 and _JOURNAL.search(line) or len(line.split()) == 1 and len(line) < 25 and line[:1].isupper() and not _END.search(line))


def _author_line(line: str) -> bool:
    words = [w for w in re.findall(r"[^\W\d_][\w'’-]*", line)]
    return 1 < len(words) <= 16 and sum(w[:1].isupper() for w in words) >= 0.8 * len(words)


def _is_prefix(k: str, title: str, title_grams: set[str]) -> bool:
    if not title or len(k) > len(title) + 2:
        return False
    if title.startswith(k):
        return True
    # as in Repeats: alike strings share all but a few of their three-letter groups
    grams = _grams(k)
    return len(k) >= 14 and len(grams & title_grams) >= len(grams) - _lost(k, SAME_TITLE) and _alike(k, title[: len(k)], SAME_TITLE)


def is_markup(content: str) -> bool:
    """Whether a content is a markup document, which has no lines of pages."""
    return content.lstrip()[:9].lower().startswith(("<?xml", "<tei", "<html", "<!doctype"))


def garbled_lines(lines: list[str]) -> frozenset[int]:
    """Indexes of the lines of paragraphs that nobody can read."""
    out: set[int] = set()
    start = 0
    for i in range(len(lines) + 1):
        if i == len(lines) or not lines[i].strip():
            if i > start and is_garbled("\n".join(lines[start:i])):
                out.update(range(start, i))
            start = i + 1
    return frozenset(out)


class Spelling(dict):
    """Token as read -> word in lower case without marks around, or None; remembers what it has seen, in bounds."""

    def __missing__(self, token: str) -> str | None:
        if len(self) > FLUSH:
            self.clear()
        t = token.strip("-'’" + _HYPHENS)
        word = self[token] = t.lower() if len(t) > 1 and _LETTER.search(t) else None
        return word


_SPELLING = Spelling()


def tokens_of(line: str) -> list[str]:
    """Words as they were read, with signs inside and without marks around."""
    return [w for t in _TOKEN.findall(line) if (w := _SPELLING[t])]


@lru_cache(maxsize=1)
def _by_read() -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for true, read in CONFUSIONS:
        out.setdefault(read, []).append(true)
    return out


def readings(word: str) -> set[str]:
    """Words that ``word`` may stand for: one confusion undone, with letters only."""
    out = set()
    for read, trues in _by_read().items():
        at = word.find(read)
        while at >= 0:
            for true in trues:
                out.add(word[:at] + true + word[at + len(read) :])
            at = word.find(read, at + 1)
    if word in _SHORT or len(word) < 3 and not word.isalpha():
        return set()
    return {w for w in out if w != word and all(c.isalpha() or c in "-'’" for c in w)}


class Page:
    """A content's lines with their parts: page numbers, running lines, and the pairs at line ends."""

    def __init__(self, content: str):
        self.lines = [x.rstrip("\r") for x in content.split("\n")]
        garbled = garbled_lines(self.lines)
        self.pages, self.running = page_lines(self.lines, garbled)
        self.body = [i for i, x in enumerate(self.lines) if x.strip() and i not in self.pages and i not in self.running and i not in garbled]

    def line_ends(self) -> Iterator[tuple[int, int, str, str]]:
        """Line that a hyphen ends, next line of running text, the word piece at the end and at the beginning."""
        for i, j in zip(self.body, self.body[1:]):
            before = self.lines[i].rstrip()
            if before[-1:] not in _HYPHENS:
                continue
            left = _LEFT.search(before, max(before.rfind(" "), before.rfind("\t")) + 1, len(before) - 1)
            right = self.lines[j].split(None, 1)
            if not left or not right or len(cells_of(before)) >= 3 or _BULLET.match(self.lines[j]):
                continue
            a = _LEFT_PIECE.search(left.group())
            b = _RIGHT_PIECE.match(right[0])
            if a and b:
                yield i, j, a.group().lower(), b.group().strip(_HYPHENS).lower()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def out() -> pa.RecordBatch:
        keys = list(counts)
        batch = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([counts[k] for k in keys], pa.int64())], names=["word", "right", "n"])
        counts.clear()
        return batch

    for batch in batches:
        for content in batch.column(0).to_pylist():
            if is_markup(content):  # its words count as well
                for line in to_lines(content):
                    if len(cells_of(line)) < 3:
                        counts.update((w, None) for w in tokens_of(line))
                continue
            page = Page(content)
            split = list(page.line_ends())
            cut_ends, cut_starts = {x[0] for x in split} | {page.body[-1]} if page.body else set(), {x[1] for x in split}
            for i in page.body:
                if len(cells_of(page.lines[i])) < 3:
                    own = tokens_of(page.lines[i])
                    counts.update((w, None) for w in own[i in cut_starts : len(own) - (i in cut_ends)])
            for *_, a, b in split:
                counts[a, b] += 1
                counts[a + b, ""] += 1
        if len(counts) > FLUSH:
            yield out()
    yield out()


def build_lookup(df: DataFrame, content_col: str = "content") -> DataFrame:
    """``key`` and ``value`` over the whole corpus: ``m:word`` -> what it should read, ``s:left|right`` -> how the
    pieces of a word at a line's end go together (``joined``, ``hyphen`` or ``apart``)."""
    counted = cut_lineage(spread(df.where(F.col(content_col).isNotNull()).select(content_col)).mapInArrow(_count, "word string, right string, n bigint").groupBy("word", "right").agg(F.sum("n").alias("n")))
    words = counted.where("right is null").select("word", "n")

    def variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(w, n, v) for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for v in readings(w)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], names=["word", "n", "variant"])

    known = words.select(F.col("word").alias("variant"), F.col("n").alias("variant_n"))
    # a word put together from two lines is no evidence of how words are written, but may be misread itself
    readable = counted.where("right is null or right = ''").groupBy("word").agg(F.sum("n").alias("n"))
    possible = readable.mapInArrow(variants, "word string, n bigint, variant string").join(known, "variant")
    signs = F.col("word").rlike(r"[^\p{L}'’-]")
    misread = possible.where((F.col("variant_n") >= LEAST_COUNT) & ((F.col("variant_n") >= RATIO * F.col("n")) | signs & (F.col("variant_n") >= F.col("n")))).groupBy("word").agg(F.max_by("variant", F.struct("variant_n", "variant")).alias("value"))
    pairs = counted.where("right <> ''").select(F.col("word").alias("left"), "right")
    joined = known.select(F.col("variant").alias("whole"), F.col("variant_n").alias("joined_n"))
    hyphened = known.select(F.col("variant").alias("whole_hyphen"), F.col("variant_n").alias("hyphen_n"))
    right = known.select(F.col("variant").alias("right"), F.col("variant_n").alias("right_n"))
    judged = pairs.withColumn("whole", F.concat("left", "right")).withColumn("whole_hyphen", F.concat("left", F.lit("-"), "right")).join(joined, "whole", "left").join(hyphened, "whole_hyphen", "left").join(right, "right", "left").na.fill(0, ["joined_n", "hyphen_n", "right_n"])
    how = F.when((F.col("joined_n") > 0) & (F.col("joined_n") >= F.col("hyphen_n")), "joined").when(F.col("hyphen_n") > 0, "hyphen").when(F.col("right").isin(*sorted(_SUSPENDED)), "apart").otherwise("joined")
    return misread.select(F.concat(F.lit("m:"), "word").alias("key"), "value").unionByName(judged.select(F.concat(F.lit("s:"), "left", F.lit("|"), "right").alias("key"), how.alias("value")))


def doc_keys(content: str) -> list[str]:
    """All lookup keys that a content can need."""
    if is_markup(content):
        return []
    page = Page(content)
    keys = {f"m:{w}" for i in page.body for w in tokens_of(page.lines[i])}
    for *_, a, b in page.line_ends():
        keys |= {f"s:{a}|{b}", f"m:{a}{b}"}
    return sorted(keys)


def noise_of(content: str, lookup: dict[str, str]) -> list[tuple[int, str]]:
    """(line number from 1, kind) of each line with noise."""
    if is_markup(content):
        return []
    page = Page(content)
    out = {(i + 1, "page_number") for i in page.pages} | {(i + 1, "running") for i in page.running}
    first_piece: dict[int, str] = {}
    last_piece: dict[int, str] = {}
    for i, j, a, b in page.line_ends():
        how = lookup.get(f"s:{a}|{b}", "apart" if b in _SUSPENDED else "joined")
        if how == "apart":
            continue
        out.add((i + 1, "split_word"))
        last_piece[i], first_piece[j] = a, b
        fixed = lookup.get(f"m:{a}{b}") if how == "joined" else None
        if fixed:  # the line that holds the wrong character
            at = next((k for k, (x, y) in enumerate(zip(a + b, fixed)) if x != y), len(a))
            out.add(((i if at < len(a) else j) + 1, "misread"))
    for i in page.body:
        if len(cells_of(page.lines[i])) >= 3:
            continue
        own = tokens_of(page.lines[i])
        if own and i in first_piece and first_piece[i].startswith(own[0][:3]):
            own = own[1:]
        if own and i in last_piece and last_piece[i].endswith(own[-1][-3:]):
            own = own[:-1]
        if any(f"m:{w}" in lookup for w in own):
            out.add((i + 1, "misread"))
    return sorted(out)


def repair(content: str, lookup: dict[str, str]) -> str:
    """The text in paragraphs: page lines taken out, lines joined, split words put together, misread words corrected.
    Paragraphs end at blank lines (unless a page break parts a sentence), at indented lines, and around short lines
    without an end mark; table rows and list items keep lines of their own. Other contents come back as they are."""
    if is_markup(content):
        return content
    page = Page(content)
    ends = {i: (j, lookup.get(f"s:{a}|{b}", "apart" if b in _SUSPENDED else "joined")) for i, j, a, b in page.line_ends()}
    correct = lambda line: _TOKEN.sub(lambda m: _like(m.group(), lookup), line)
    width = max((len(page.lines[i]) for i in page.body), default=0)
    out: list[str] = []
    for k, i in enumerate(page.body):
        line = page.lines[i].replace("\f", "")
        text = correct(line.strip())
        before = page.body[k - 1] if k else None
        if before is None:
            out.append(text)
            continue
        gap = range(before + 1, i)
        broken = any(g in page.pages or g in page.running for g in gap) or "\f" in page.lines[i]
        blank = any(not page.lines[g].strip() for g in gap)
        previous = page.lines[before].strip()
        goes_on = not _END.search(previous) and (text[:1].islower() or before in ends)
        short = len(previous) < 0.55 * width and not _END.search(previous) and before not in ends
        separate = len(cells_of(line)) >= 3 or len(cells_of(previous)) >= 3 or bool(re.match(r"\s*(?:[-*•–]|\d+[.)])\s", line))
        if separate or blank and not (broken and goes_on) or line[:2] == "  " and not goes_on or short and not text[:1].islower():
            out += [text] if separate and not blank else ["", text]
        elif before in ends and ends[before][1] != "apart":
            stem = out[-1].rstrip().rstrip(_HYPHENS)
            out[-1] = stem + ("-" if ends[before][1] == "hyphen" else "") + text
        else:
            out[-1] += " " + text
    return "\n".join(out)


def _like(token: str, lookup: dict[str, str]) -> str:
    bare = token.strip("-'’" + _HYPHENS)
    fixed = lookup.get(f"m:{bare.lower()}")
    if not fixed:
        return token
    shaped = fixed.upper() if bare.isupper() and len(bare) > 2 else fixed.capitalize() if bare[:1].isupper() else fixed
    return token.replace(bare, shaped)


def _with_lookup(df: DataFrame, id_col: str, content_col: str, most_broadcast: int, make, schema: str) -> DataFrame:
    """``make(content, lookup)`` for each row; the lookup is broadcast if its size allows, else each row gets its own part by a join."""
    kind = df.schema[id_col].dataType.simpleString()
    lookup = cut_lineage(build_lookup(df, content_col))
    known = df.where(F.col(content_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(content_col).alias("content"))
    if lookup.limit(most_broadcast + 1).count() <= most_broadcast:
        table = {r.key: r.value for r in lookup.collect()}  # bounded by the check
        shared = df.sparkSession.sparkContext.broadcast(table)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield make(batch.column("id"), batch.column("content").to_pylist(), [shared.value] * batch.num_rows)

        return spread(known).mapInArrow(run, f"id {kind}, {schema}")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [doc_keys(c) for c in batch.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("content"), pa.array(found, pa.list_(pa.string()))], names=["id", "content", "keys"])

    # rows are told apart by id and content; equal ones have equal keys
    hashed = known.mapInArrow(keys, f"id {kind}, content string, keys array<string>").withColumn("row", F.struct("id", F.xxhash64("content")))
    wanted = hashed.select("row", F.explode("keys").alias("key")).distinct()
    own = wanted.join(lookup, "key").groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("lookup"))
    joined = hashed.alias("h").join(own.alias("o"), F.col("h.row").eqNullSafe(F.col("o.row")), "left").select("h.id", "h.content", "o.lookup")

    def run_own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield make(batch.column("id"), batch.column("content").to_pylist(), [dict(m) if m else {} for m in batch.column("lookup").to_pylist()])

    return joined.mapInArrow(run_own, f"id {kind}, {schema}")


def find_noise(df: DataFrame, id_col: str = "parse_id", content_col: str = "content", most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """``id_col``, ``line_no`` (from 1, by LF) and ``kind`` (split_word, misread, running, page_number) of each line with noise.

    Null, empty and blank contents, markup documents and unreadable ones have none. Equal rows come out
    each. Other columns play no part.
    """

    def make(ids: pa.Array, contents: list[str], lookups: list[dict[str, str]]) -> pa.RecordBatch:
        rows = [(k, no, kind) for k, (c, lookup) in enumerate(zip(contents, lookups)) for no, kind in noise_of(c, lookup)]
        return pa.RecordBatch.from_arrays([ids.take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string())], names=["id", "line_no", "kind"])

    return _with_lookup(df, id_col, content_col, most_broadcast, make, "line_no int, kind string").withColumnRenamed("id", id_col)


def repair_texts(df: DataFrame, id_col: str = "parse_id", content_col: str = "content", most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """``id_col`` and ``text``: each content that is not null, repaired as ``repair`` says; empty ones stay empty."""

    def make(ids: pa.Array, contents: list[str], lookups: list[dict[str, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids, pa.array([repair(c, lookup) for c, lookup in zip(contents, lookups)], pa.string())], names=["id", "text"])

    return _with_lookup(df, id_col, content_col, most_broadcast, make, "text string").withColumnRenamed("id", id_col)
