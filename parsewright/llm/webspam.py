"""Problem 8: keyword-stuffed and link-list pages.

An n-gram model over sequences of function words and word classes is trained on prose. Each page gets its mean
log-perplexity per symbol under it, set against what the model expects after the same histories; pages outside the range
of prose pages are abnormal, at the high end (links, tags, signs) or the low one (content words in a row). An exact check
of an abnormal page's loose text then tells keywords, links and product tags from reference lists, indexes, tables and
codebooks, which are no prose either. Pages inside the range are never spam, whatever they hold.

Function words, n-gram counts and the range of prose pages are those of all pages. Texts are read twice, to count words and
to take tokens; what n-grams and scores need of the tokens, two bytes each, is kept. The range is then found exactly among
the scores. Texts become arrays of numbers, one a token, and all that
follows is array arithmetic over many pages at once.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parsewright.session import cut_lineage, spread

#: Function words: so many of the most frequent words of at most MAX_LETTERS letters (or CJK characters) under each
#: language label that LEAST_SHARE of the words bear.
N_FUNCTION_WORDS, MAX_LETTERS, LEAST_SHARE = 25, 5, 0.004
#: Pages are labelled prose for the fit if so much of them is sentences; abnormal is what lies beyond the outer TAIL of them.
PROSE_SHARE, TAIL = 0.8, 0.04
#: An abnormal page is spam if this share of its characters is keywords, links or tags.
MOST = 0.3
#: Keywords: share that the ten most frequent content words have, distinct words per word, numbers per token.
REPEATED, DISTINCT, NUMBERS = 0.45, 0.55, 0.24
#: Characters that are turned into arrays together.
BLOCK_CHARS = 1 << 17

_INVISIBLE = re.compile("[­​-‏‪-‮⁠-⁤﻿]")
_URL_TEXT = r"(?:https?://|www\.)[^\s<>()\[\]\"'|]+"
_URL = re.compile(_URL_TEXT)
_CJK = r"぀-ヿ㐀-䶿一-鿿豈-﫿"
_MARKS = r"̀-ͯؐ-ًؚ-ٰٟۖ-ۭऀ-ः़-ॏ"
# what goes on with a word; runs of plain letters are taken at once
_REST = rf"[a-z]*(?:(?:[^\W{_CJK}]|[{_MARKS}@$]|['’-](?=[^\W\d_]))[a-z]*)*"
# word that can't begin a link | line end | link | CJK character | word | number | hashtag | markup | end of a sentence | any other sign
_TOKEN = re.compile(rf" ?([A-Za-gi-vx-z]{_REST}|\n|{_URL_TEXT}|[{_CJK}]|[^\W\d_]{_REST}|\d(?:[\w@$.,:/–-]*[\w%])?|\#\w+|</?[A-Za-z!?][^<>\n]*>|[.!?؟][\"'”’)\]]*(?!\S)|\S)")
_YEAR = re.compile(r"\b(?:1[89]|20)\d\d\b|\b\d\d?:\d\d\b")  # also the times of a programme
_AMOUNT = re.compile(r"\d+\.\d\d")
_CODE = re.compile(r"[A-Za-z@$]")
_CLASSES = ("edge", "url", "hashtag", "markup", "lower", "title", "upper", "mixed", "script", "cjk", "number", "comma", "stop", "bracket", "bar", "dash", "other")
EDGE, URL, HASHTAG, MARKUP, LOWER, TITLE, UPPER, MIXED, SCRIPT, CJK, NUMBER, COMMA, STOP, BRACKET, BAR, DASH, OTHER = range(len(_CLASSES))
NAMED = len(_CLASSES)
_PUNCT = dict.fromkeys(",;:，、；：،", COMMA) | dict.fromkeys(".!?。！？؟", STOP) | dict.fromkeys("()[]{}（）「」\"'“”‘’«»", BRACKET) | dict.fromkeys("|/\\•*#>=+~", BAR) | dict.fromkeys("-–—_", DASH)
# Cyrillic and Greek letters, digits and signs that stand in for Latin letters, and those.
_ALIKE = str.maketrans("асеорхуіѕјԁһαεορν034@$1", "aceopxyisjdhaeopvoeaasl")

# A token as a number: class, what else is known of it, its length, and a hash of the word it stands for.
CLASS_BITS, FLAG_BITS, LENGTH_BITS, WORD_BITS = 10, 11, 22, 20
CAN_END, SHORT_NUMBER, DATED, AMOUNT, CURRENCY, ENDS, SMALL, UNDERSCORE, CLOSING, LINE, CJK_FUNCTION = (1 << i for i in range(FLAG_BITS))


def normal(text: str) -> str:
    """Compatible characters made alike, invisible ones made spaces, line ends LF."""
    if not text.isascii():
        text = _INVISIBLE.sub(" ", unicodedata.normalize("NFKC", text))
    return text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text


def script_of(word: str) -> str:
    c = ord(word[0])
    if c < 0x250 or 0x1E00 <= c <= 0x1EFF:
        return "latin"
    return "cjk" if c >= 0x2E80 else "cyrillic" if 0x400 <= c < 0x530 else "greek" if 0x370 <= c < 0x400 else "arabic" if 0x600 <= c < 0x780 else "other"


def tokens_of(text: str) -> Iterator[list[str]]:
    """The tokens of a text in stretches of whole lines, so that no long list of strings is held."""
    at = 0
    while at < len(text):
        end = len(text) if len(text) - at <= BLOCK_CHARS else text.find("\n", at + BLOCK_CHARS) + 1 or len(text)
        yield _TOKEN.findall(text, at, end)
        at = end


class Lexer(dict):
    """Token -> number; function words have classes of their own after the named ones. Emptied when large, to bound memory."""

    def __init__(self, words: list[str]):
        super().__init__()
        self.words = {w: NAMED + i for i, w in enumerate(words)}
        self.size = NAMED + len(words)

    def __missing__(self, x: str) -> int:
        if len(self) > 200_000:
            self.clear()
        low = x.lower()
        c = self._class(x, low)
        last = x[-1]
        flags = CAN_END * (last.islower() or last.isdigit() or last in "%)]" or unicodedata.category(last) == "Lo")
        flags |= SHORT_NUMBER * (c == NUMBER and len(x) <= 3) | AMOUNT * bool(_AMOUNT.fullmatch(x)) | CURRENCY * (x in "$€£") | SMALL * x[0].islower() | UNDERSCORE * ("_" in x) | CLOSING * (x in "\"'”’»)]")
        flags |= DATED * bool(_YEAR.search(x)) | ENDS * (c == STOP and (x in "。！？" or len(x) > 1 or x in ".!?؟")) | LINE * (x == "\n") | CJK_FUNCTION * (c >= NAMED and script_of(x) == "cjk")
        size = sum(map(len, _URL.findall(x))) if c == MARKUP else 0 if x == "\n" else len(x)
        word = zlib.crc32((low.translate(_ALIKE) if c == MIXED else low).encode("utf-8", "replace")) & (1 << WORD_BITS) - 1
        code = self[x] = c | flags << CLASS_BITS | min(size, (1 << LENGTH_BITS) - 1) << CLASS_BITS + FLAG_BITS | word << CLASS_BITS + FLAG_BITS + LENGTH_BITS
        return code

    def _class(self, x: str, low: str) -> int:
        if low in self.words:
            return self.words[low]
        c = x[0]
        if c == "\n":
            return EDGE
        if len(x) > 7 and low.startswith(("http", "www.")) and _URL.match(low):
            return URL
        if c == "#" and len(x) > 1:
            return HASHTAG
        if c == "<" and len(x) > 1:
            return MARKUP
        if c.isalpha():
            kind = script_of(x)
            if kind == "cjk":
                return CJK
            if kind != "latin":
                return SCRIPT if all(ord(k) >= 0x300 for k in x if k.isalpha()) else MIXED
            if any(ord(k) >= 0x370 or k in "0123456789@$" for k in x):
                return MIXED
            if x.islower():
                return LOWER
            return TITLE if len(x) == 1 or x[1:].islower() else UPPER if x.isupper() else MIXED
        if c.isnumeric():
            return MIXED if _CODE.search(x) and len(x) > 3 else NUMBER
        return _PUNCT.get(c, OTHER)

    def codes(self, text: str) -> list[np.ndarray]:
        """The tokens of a text as arrays."""
        return [np.fromiter(map(self.__getitem__, found), np.int64, len(found)) for found in tokens_of(text)]


@dataclass
class Tokens:
    """The tokens of some pages without line ends: arrays of class, flags, length, word, and number of unit and page.
    A unit is a sentence or a line; a line that was wrapped inside a sentence goes on in the next."""

    n_pages: int
    cls: np.ndarray
    flags: np.ndarray
    length: np.ndarray
    word: np.ndarray
    unit: np.ndarray
    page: np.ndarray
    unit_page: np.ndarray = field(init=False)
    first: np.ndarray = field(init=False)
    _sentences: np.ndarray | None = field(init=False, default=None)

    def __post_init__(self) -> None:
        self.first = np.flatnonzero(np.diff(self.unit, prepend=-1)) if len(self.unit) else np.zeros(0, np.int64)
        self.unit_page = self.page[self.first]

    @property
    def n_units(self) -> int:
        return len(self.first)

    def per_unit(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.unit, values, self.n_units)

    def per_page(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.page, values, self.n_pages)

    @classmethod
    def of(cls, texts: list[str], lexer: Lexer) -> Tokens:
        line_end = np.array([lexer["\n"]], np.int64)
        parts: list[np.ndarray] = []
        sizes = []
        for text in texts:
            own = [*lexer.codes(normal(text)), line_end]
            sizes.append(sum(map(len, own)))
            parts += own
        code = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        page = np.repeat(np.arange(len(texts)), sizes)
        kind = code & (1 << CLASS_BITS) - 1
        flags = code >> CLASS_BITS & (1 << FLAG_BITS) - 1
        length = code >> CLASS_BITS + FLAG_BITS & (1 << LENGTH_BITS) - 1
        line = (flags & LINE) > 0
        before = lambda x, k=1: np.concatenate([np.zeros(k, x.dtype), x[:-k]]) if len(x) >= k else np.zeros_like(x)
        # a line end inside a sentence parts nothing: the line is long, bears no mark of a list, and goes on in lower case
        number = np.cumsum(line) - line
        n_lines = int(number[-1]) + 1 if len(number) else 0
        long = np.bincount(number, length, n_lines) >= 34
        listed = np.bincount(number, (kind == URL) | (kind == HASHTAG) | (kind == BAR), n_lines) > 0
        stopped = before(kind == STOP)
        small_next = np.concatenate([(flags[1:] & SMALL) > 0, [False]]) if len(code) else np.zeros(0, bool)
        same = np.concatenate([page[1:] == page[:-1], [False]]) if len(code) else np.zeros(0, bool)
        parted = line & ~(long[number] & ~listed[number] & ~stopped & small_next & same)
        last = before(flags)
        ended = (flags & ENDS > 0) & ((last & CAN_END > 0) & (last & SHORT_NUMBER == 0) | (kind == STOP) & (code >> CLASS_BITS + FLAG_BITS + LENGTH_BITS == _cjk_stops()[:, None]).any(0))
        unit = np.cumsum(parted | before(ended))
        keep = ~line
        unit = unit[keep]
        unit = np.cumsum(np.diff(unit, prepend=unit[:1]) > 0)
        return cls(len(texts), kind[keep], flags[keep], length[keep], code[keep] >> CLASS_BITS + FLAG_BITS + LENGTH_BITS, unit, page[keep])

    def sentences(self) -> np.ndarray:
        """Whether each unit is one: it ends like one, has words enough and function words among them, no links or tags, and
        doesn't repeat its content words."""
        if self._sentences is None:
            self._sentences = self._found_sentences()
        return self._sentences

    def _found_sentences(self) -> np.ndarray:
        c = self.cls
        function = self.per_unit((c >= NAMED) & (self.flags & CJK_FUNCTION == 0))
        cjk = self.per_unit((c == CJK) | (self.flags & CJK_FUNCTION > 0))
        script, linked = self.per_unit(c == SCRIPT), self.per_unit((c == URL) | (c == HASHTAG))
        is_content = (c >= LOWER) & (c <= MIXED)
        content = self.per_unit(is_content)
        pairs = np.unique((self.unit[is_content] << WORD_BITS) | self.word[is_content])
        twice = content - np.bincount(pairs >> WORD_BITS, minlength=self.n_units)
        final = np.concatenate([self.first[1:], [len(c)]]) - 1 if self.n_units else self.first
        closing = (self.flags[final] & CLOSING > 0) & (final > self.first)
        ends = (c[final] == STOP) | closing & (c[np.maximum(final - 1, 0)] == STOP)
        plain = (content + function >= 5) & (function >= 0.1 * (content + function)) & ((twice < 2) | (twice < 0.25 * content))
        return ends & (linked == 0) & ((cjk >= 6) | (script + function >= 3) & (script >= content) | plain)

    def packed(self) -> pa.Array:
        """The classes of each page as bytes, two a token, with a mark after each unit: SENTENCE or EDGE."""
        out = np.empty(len(self.cls) + self.n_units, np.uint16)
        out[np.arange(len(self.cls)) + self.unit] = self.cls
        out[np.concatenate([self.first[1:], [len(self.cls)]])[: self.n_units] + np.arange(self.n_units)] = np.where(self.sentences(), SENTENCE, EDGE)
        sizes = np.bincount(self.page, minlength=self.n_pages) + np.bincount(self.unit_page, minlength=self.n_pages)
        ends = np.concatenate([[0], 2 * np.cumsum(sizes)]).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), self.n_pages, [None, pa.py_buffer(ends), pa.py_buffer(out)])

    @classmethod
    def unpacked(cls, pages: pa.Array) -> Iterator[Tokens]:
        """What ``packed`` keeps of pages in order, BLOCK_CHARS tokens or one page together: classes, units and sentences."""
        ends = np.frombuffer(pages.buffers()[1], np.int32)[pages.offset : pages.offset + len(pages) + 1]
        at = 0
        while at < len(pages):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + 2 * BLOCK_CHARS, "right")) - 1)
            code = np.frombuffer(pages.buffers()[2] or b"", np.uint8)[ends[at] : ends[to]].view(np.uint16).astype(np.int64)
            mark = (code == EDGE) | (code == SENTENCE)
            keep = ~mark
            page = np.repeat(np.arange(to - at), np.diff(ends[at : to + 1]) // 2)
            none = np.zeros(0, np.int64)
            t = cls(to - at, code[keep], none, none, none, (np.cumsum(mark) - mark)[keep], page[keep])
            t._sentences = code[mark] == SENTENCE
            yield t
            at = to

    def bigrams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(history, symbol, unit) of all classes, with an edge before and after each unit."""
        n = len(self.cls)
        history = np.concatenate([[EDGE], self.cls[:-1]]) if n else self.cls.copy()
        history[self.first] = EDGE
        final = np.concatenate([self.first[1:], [n]]) - 1 if self.n_units else self.first
        return np.concatenate([history, self.cls[final]]), np.concatenate([self.cls, np.zeros(self.n_units, self.cls.dtype)]), np.concatenate([self.unit, np.arange(self.n_units)])

    def skeleton(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(history, symbol, unit) of function and content words alone: a symbol is 0 for content or a function word's
        number; a history is the function word before, or how many content words were in a row."""
        c = self.cls
        keep = (c >= NAMED) | (c >= LOWER) & (c <= CJK)
        symbol, unit = np.where(c[keep] >= NAMED, c[keep] - NAMED + 1, 0), self.unit[keep]
        n = len(symbol)
        begins = np.diff(unit, prepend=-1) > 0
        at = np.arange(n)
        # where the run of content words before a word begins: at its unit's start, or after the last function word
        reset = np.maximum.accumulate(np.where(begins, at, np.where(np.concatenate([[0], symbol[:-1]]) > 0, at, 0))) if n else at
        run = np.minimum(at - reset, RUNS)
        after = np.concatenate([[0], symbol[:-1]]) if n else symbol
        return np.where(~begins & (after > 0), RUNS + after, run), symbol, unit


def _cjk_stops() -> np.ndarray:
    return np.array([zlib.crc32(x.encode()) & (1 << WORD_BITS) - 1 for x in "。！？"])


#: The mark of a unit that is a sentence; no class has it.
SENTENCE = (1 << 16) - 1
#: Content words in a row that a history tells apart.
RUNS = 5


@dataclass
class Scale:
    """Log-probabilities of next symbols by history, and what is expected after each history."""

    logp: np.ndarray
    mean: np.ndarray

    @classmethod
    def fit(cls, counts: np.ndarray, order: int = 2) -> Scale:
        p = ((counts.sum(0) + 0.5) / (counts.sum() + 0.5 * counts.shape[1]))[None, :]
        if order > 1:
            p = (counts + 5 * p) / (counts.sum(1, keepdims=True) + 5)
        logp = np.log(p)
        return cls(logp, (p * logp).sum(1))

    def page_means(self, histories: np.ndarray, symbols: np.ndarray, pages: np.ndarray, n_pages: int) -> np.ndarray:
        """Mean log-probability of each page's symbols less what is expected: low is a high perplexity, 0 that of prose."""
        excess = self.logp[histories, symbols] - self.mean[histories]
        return np.bincount(pages, excess, n_pages) / np.maximum(1, np.bincount(pages, minlength=n_pages))


SCALES = ("class_score", "word_score", "share_score")


@dataclass
class ClassModel:
    """The n-gram model: bigrams of classes (words, punctuation, links), and of function and content words alone both
    by history and without one; and the range of prose pages on each."""

    function_words: list[str]
    classes: Scale
    words: Scale
    shares: Scale
    low: np.ndarray = field(default_factory=lambda: np.zeros(3))
    high: np.ndarray = field(default_factory=lambda: np.zeros(3))

    @classmethod
    def fit(cls, function_words: list[str], class_counts: np.ndarray, word_counts: np.ndarray) -> ClassModel:
        return cls(function_words, Scale.fit(class_counts), Scale.fit(word_counts), Scale.fit(word_counts, 1))

    def scores(self, t: Tokens) -> np.ndarray:
        """Pages by SCALES."""
        h, s, unit = t.bigrams()
        wh, ws, w_unit = t.skeleton()
        page, w_page = t.unit_page[unit], t.unit_page[w_unit]
        return np.column_stack([self.classes.page_means(h, s, page, t.n_pages), self.words.page_means(wh, ws, w_page, t.n_pages), self.shares.page_means(np.zeros_like(wh), ws, w_page, t.n_pages)])

    def abnormal(self, scores: np.ndarray) -> np.ndarray:
        """High perplexity of classes or words, or low perplexity of words: too many content words in a row."""
        return (scores[:, :2] < self.low[:2]).any(1) | (scores[:, 1:] > self.high[1:]).any(1)


_STATS = ("n", "sentences", "links", "tags", "products", "loose", "words", "top", "distinct", "numbers", "codes", "years")


def loose_text(t: Tokens, wanted: np.ndarray) -> dict[str, np.ndarray]:
    """Of each page (blanks and markup aside): characters in all, in sentences, links, tags, products and other loose text;
    and of the pages ``wanted`` how their loose text repeats itself."""
    c, size = t.cls, t.length
    unit_size, url, tag = t.per_unit(size), t.per_unit(size * ((c == URL) | (c == MARKUP))), t.per_unit(size * (c == HASHTAG))
    words, numbers = t.per_unit((c >= LOWER) & (c <= CJK)), t.per_unit(c == NUMBER)
    sentence = t.sentences()
    # a year before the first link: a reference
    is_link = (c == URL) | (c == MARKUP) & (size > 0)
    links_before = np.cumsum(is_link)
    start = (links_before - is_link)[t.first] if t.n_units else links_before
    dated = t.per_unit((t.flags & DATED > 0) & ~is_link & (links_before == start[t.unit])) > 0
    shift = lambda x, k: np.concatenate([np.zeros(k, x.dtype), x[:-k]]) if len(x) >= k else np.zeros_like(x)
    same = lambda k: shift(t.unit + 1, k) == t.unit + 1
    bar, other, money = c == BAR, (c == OTHER) | (c == BAR), t.flags & CURRENCY > 0
    next_bar = np.concatenate([bar[1:] & (t.unit[1:] == t.unit[:-1]), [False]]) if len(c) else bar
    priced = (c == NUMBER) & shift(money, 1) & same(1) | (t.flags & AMOUNT > 0) & next_bar & (shift(bar, 1) & same(1) | shift(other, 1) & shift(bar, 2) & same(2))
    price = t.per_unit(priced) > 0
    of_link = ~sentence & (url > 0) & (url >= 0.3 * unit_size) & ~dated
    of_tag = ~sentence & ~of_link & (tag > 0) & (tag >= 0.5 * unit_size)
    of_product = ~sentence & ~of_link & ~of_tag & price & (numbers <= 3) & (words >= 3)
    of_loose = ~(sentence | of_link | of_tag | of_product)
    page = lambda mask: np.bincount(t.unit_page, unit_size * mask, t.n_pages)
    out = {"n": page(1), "sentences": page(sentence), "links": page(of_link), "tags": page(of_tag), "products": page(of_product), "loose": page(of_loose)}
    out |= {k: np.zeros(t.n_pages) for k in _STATS[6:]}
    if not len(c):
        return out
    loose = of_loose[t.unit] & wanted[t.page]
    parts = t.per_page(loose & (c != MARKUP))
    out["numbers"] = t.per_page(loose & (c == NUMBER)) / np.maximum(1, parts)
    is_word = loose & (c >= LOWER) & (c <= SCRIPT)
    # CJK characters in a row are one word
    cjk = loose & (c == CJK)
    begins = cjk & ~(shift(cjk, 1) & same(1))
    run = np.cumsum(begins)[cjk] - 1
    at = np.flatnonzero(cjk)
    place = at - at[begins[cjk]][run] if len(at) else at
    run_word = np.bincount(run, t.word[cjk] * (2 * place + 1) % (1 << WORD_BITS)).astype(np.int64) % (1 << WORD_BITS) if len(at) else np.zeros(0, np.int64)
    all_pages, all_words = np.concatenate([t.page[is_word], t.page[begins]]), np.concatenate([t.word[is_word], run_word])
    out["words"] = total = np.bincount(all_pages, minlength=t.n_pages).astype(float)
    keys, n = np.unique(all_pages << WORD_BITS | all_words, return_counts=True)
    key_page = keys >> WORD_BITS
    order = np.lexsort((-n, key_page))
    key_page, n = key_page[order], n[order]
    rank = np.arange(len(n)) - np.searchsorted(key_page, key_page)
    some = np.maximum(1, total)
    out["top"] = np.bincount(key_page[rank < 10], n[rank < 10], t.n_pages) / some
    out["distinct"] = np.bincount(key_page, minlength=t.n_pages) / some
    out["codes"] = t.per_page(is_word & (t.flags & UNDERSCORE > 0)) / some
    out["years"] = t.per_page(loose & (t.flags & DATED > 0)) / some
    return out


def loose_is_spam(s: dict[str, np.ndarray]) -> np.ndarray:
    """The exact check: whether links, tags, products and repeated keywords are much of the page."""
    distinct = np.where(s["words"] > 60, DISTINCT, DISTINCT + 0.15)
    repeated = (s["top"] >= REPEATED) & (s["distinct"] <= distinct) | (s["words"] >= 40) & (s["top"] >= 0.4) & (s["distinct"] <= 0.4)
    keywords = (s["words"] >= 8) & repeated & (s["numbers"] <= NUMBERS) & (s["codes"] < 0.05) & (s["years"] < 0.03) & (s["sentences"] <= 0.5 * s["n"])
    return (s["n"] > 0) & (s["links"] + s["tags"] + s["products"] + s["loose"] * keywords > MOST * s["n"])


def in_blocks(texts: list[str]) -> Iterator[list[str]]:
    """Texts in order, BLOCK_CHARS or one text together."""
    block, size = [], 0
    for text in texts:
        if block and size + len(text) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append(text)
        size += len(text)
    if block:
        yield block


def label_of(lang_col: str | None) -> Column:
    return F.coalesce(F.substring(F.lower(F.trim(F.col(lang_col).cast("string"))), 1, 2), F.lit("")) if lang_col else F.lit("")


def function_words(df: DataFrame, text_col: str, label: Column) -> list[str]:
    """The most frequent short words under each language label that LEAST_SHARE of the words bear; labels that bear less
    give none, so at most N_FUNCTION_WORDS / LEAST_SHARE rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = defaultdict(Counter)

        def out() -> pa.RecordBatch:
            rows = [(label, w, n) for label, own in counts.items() for w, n in own.items() if len(w) <= MAX_LETTERS and w[0].isalpha()]
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.string()), pa.array([x[1] for x in rows], pa.string()), pa.array([x[2] for x in rows], pa.int64())], names=["label", "word", "n"])

        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for found in tokens_of(normal(text).lower()):
                    counts[label].update(found)
                    if sum(map(len, counts.values())) > 200_000:
                        yield out()
        yield out()

    counted = cut_lineage(df.select(text_col, label.alias("label")).mapInArrow(run, "label string, word string, n bigint").groupBy("label", "word").agg(F.sum("n").alias("n")))
    all_n = counted.agg(F.sum("n")).first()[0] or 0
    borne = [r.label for r in counted.groupBy("label").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_SHARE * all_n).collect()]  # at most 1 / LEAST_SHARE
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("n"), "word"))
    return sorted({r.word for r in counted.where(F.col("label").isin(borne)).withColumn("place", place).where(F.col("place") <= N_FUNCTION_WORDS).select("word").distinct().collect()})


def count_ngrams(scanned: DataFrame, words: list[str]) -> ClassModel:
    """The n-gram model of the sentences of all pages, without a range. Counts that reach the driver are bounded by the
    square of the number of classes."""
    size, skeleton_size = NAMED + len(words), 1 + len(words)
    shape = (size * size, (RUNS + skeleton_size) * skeleton_size)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(n, np.int64) for n in shape]
        for batch in batches:
            for t in Tokens.unpacked(batch.column(0)):
                sentence = t.sentences()
                for (h, s, unit), total, width in zip((t.bigrams(), t.skeleton()), counts, (size, skeleton_size)):
                    of = sentence[unit]
                    total += np.bincount(h[of] * width + s[of], minlength=len(total))
        for which, total in enumerate(counts):
            code = total.nonzero()[0]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), which, np.int32)), pa.array(code.astype(np.int64)), pa.array(total[code])], names=["which", "code", "n"])

    arrays = [np.zeros(n) for n in shape]
    for r in scanned.select("packed").mapInArrow(count, "which int, code bigint, n bigint").groupBy("which", "code").agg(F.sum("n").alias("n")).collect():
        arrays[r.which][r.code] = r.n
    return ClassModel.fit(words, arrays[0].reshape(size, size), arrays[1].reshape(RUNS + skeleton_size, skeleton_size))


#: Bits of a score that each round of ``exact_quantiles`` tells apart.
ROUND_BITS = 16


def exact_quantiles(df: DataFrame, cols: tuple[str, ...], at: tuple[float, ...]) -> np.ndarray | None:
    """``np.quantile`` of columns of doubles without nulls, ``at`` by ``cols``; None without rows.

    The values next to each quantile are found from their leading bits on: each round counts the next ROUND_BITS of the
    values that agree with one of them so far, so what is held is bounded, however many rows there are.
    """
    n = df.count()
    if not n:
        return None
    below = [int((n - 1) * q) for q in at]
    ranks = np.array([[k, min(k + 1, n - 1)] for k in below] * len(cols)).ravel()
    of = np.repeat(np.arange(len(cols)), 2 * len(at))
    found = np.zeros(len(ranks), np.uint64)  # the bits so far
    top = np.uint64(1 << 63)

    for done in range(0, 64, ROUND_BITS):
        wanted = sorted(set(zip(of.tolist(), found.tolist())))
        # typed shifts, as numpy mixes no signs
        shift, digits = np.uint64(64 - done - ROUND_BITS), np.uint64((1 << ROUND_BITS) - 1)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(wanted), 1 << ROUND_BITS), np.int64)
            for batch in batches:
                for c in range(len(cols)):
                    bits = batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64).view(np.uint64)
                    bits = np.where(bits & top > 0, ~bits, bits | top)  # in the order of the values
                    for k, (col, prefix) in enumerate(wanted):
                        if col == c:
                            own = bits if not done else bits[bits >> np.uint64(64 - done) == np.uint64(prefix)]
                            total[k] += np.bincount((own >> shift & digits).astype(np.int64), minlength=1 << ROUND_BITS)
            k, digit = total.nonzero()
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(digit.astype(np.int32)), pa.array(total[k, digit])], names=["k", "digit", "n"])

        sums = np.zeros((len(wanted), 1 << ROUND_BITS), np.int64)
        got = df.select(*cols).mapInArrow(count, "k int, digit int, n bigint").groupBy("k", "digit").agg(F.sum("n").alias("n")).toArrow()
        sums[got["k"].to_numpy(), got["digit"].to_numpy()] = got["n"].to_numpy()
        before = sums.cumsum(1)
        for i, key in enumerate(zip(of.tolist(), found.tolist())):
            row = before[wanted.index(key)]
            digit = int(np.searchsorted(row, ranks[i], "right"))
            ranks[i] -= row[digit - 1] if digit else 0
            found[i] = np.uint64(int(found[i]) << ROUND_BITS | digit)
    values = np.where(found & top > 0, found & ~top, ~found).view(np.float64).reshape(len(cols), len(at), 2)
    return np.array([[np.quantile(values[c, k], (n - 1) * q - below[k]) for c in range(len(cols))] for k, q in enumerate(at)])


def _pages(df: DataFrame, text_col: str) -> DataFrame:
    return df.where(F.col(text_col).isNotNull() & F.col(text_col).rlike(r"(?U)\S"))


def _scan(df: DataFrame, words: list[str], id_col: str, text_col: str) -> DataFrame:
    """``id_col``, ``packed`` (``Tokens.packed``), _STATS, ``prose`` and whether the page's text would be ``spam`` if it were abnormal."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexer = Lexer(words)
        for batch in batches:
            done = 0
            for texts in in_blocks(batch.column(1).to_pylist()):
                t = Tokens.of(texts, lexer)
                stats = loose_text(t, np.ones(t.n_pages, bool))
                prose = stats["sentences"] > PROSE_SHARE * stats["n"]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(texts)), t.packed(), *(pa.array(stats[c].astype(float)) for c in _STATS), pa.array(prose), pa.array(loose_is_spam(stats))], names=[id_col, "packed", *_STATS, "prose", "spam"])
                done += len(texts)

    return spread(_pages(df, text_col).select(id_col, text_col)).mapInArrow(run, f"`{id_col}` {kind}, packed binary, {', '.join(f'{c} double' for c in _STATS)}, prose boolean, spam boolean")


def _score(scanned: DataFrame, model: ClassModel, id_col: str) -> DataFrame:
    """``_scan`` with SCALES in place of ``packed``."""
    shared = scanned.sparkSession.sparkContext.broadcast(model)  # a few hundred classes squared
    kind = scanned.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [shared.value.scores(t) for t in Tokens.unpacked(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x) for x in (np.concatenate(scores) if scores else np.zeros((0, len(SCALES)))).T), *batch.columns[2:]], names=[id_col, *SCALES, *_STATS, "prose", "spam"])

    return scanned.select(id_col, "packed", *_STATS, "prose", "spam").mapInArrow(run, f"`{id_col}` {kind}, {', '.join(f'{c} double' for c in (*SCALES, *_STATS))}, prose boolean, spam boolean")


def set_range(model: ClassModel, scanned: DataFrame) -> None:
    """The range of all prose pages."""
    found = exact_quantiles(scanned.where("prose"), SCALES, (TAIL, 1 - TAIL))
    if found is not None:
        model.low, model.high = found


def _judged(scanned: DataFrame, model: ClassModel, id_col: str) -> DataFrame:
    low, high = ([F.lit(float(x)) for x in side] for side in (model.low, model.high))
    c, w, s = (F.col(x) for x in SCALES)
    # as ClassModel.abnormal
    abnormal = scanned.withColumn("abnormal", (c < low[0]) | (w < low[1]) | (w > high[1]) | (s > high[2]))
    repeats = [F.when(F.col("abnormal"), F.col(x)).otherwise(0.0).alias(x) for x in _STATS[6:]]
    return abnormal.select(id_col, *SCALES, "abnormal", *_STATS[:6], *repeats, (F.col("abnormal") & F.col("spam")).alias("spam"))


def _fit(df: DataFrame, id_col: str, text_col: str, lang_col: str | None) -> tuple[ClassModel, DataFrame]:
    """The model of all pages with its range, and their scores."""
    words = function_words(spread(_pages(df, text_col)), text_col, label_of(lang_col))
    scanned = cut_lineage(_scan(df, words, id_col, text_col))
    model = count_ngrams(scanned, words)
    scored = cut_lineage(_score(scanned, model, id_col))
    set_range(model, scored)
    return model, scored


def fit_prose_model(df: DataFrame, text_col: str = "text", lang_col: str | None = "lang", id_col: str = "doc_id") -> ClassModel:
    """The n-gram model of the sentences of all pages, and the range of its scale on all those that are prose."""
    return _fit(df, id_col, text_col, lang_col)[0]


def score_pages(df: DataFrame, model: ClassModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, the page's SCALES, ``abnormal``, the statistics of its loose text (how it repeats itself only of abnormal
    pages) and ``spam``, one row per row whose text is not null or blank."""
    return _judged(_score(_scan(df, model.function_words, id_col, text_col), model, id_col), model, id_col)


def score_all(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """``score_pages`` under ``fit_prose_model`` of the same rows, which are scanned once for both."""
    model, scored = _fit(df, id_col, text_col, lang_col)
    return _judged(scored, model, id_col)


def find_spam(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """Ids of the pages most of whose text is keywords, links or product tags; equal rows come out each.

    Null, empty and blank texts are no pages. The model is fitted on all of the same rows; with
    an empty table it knows nothing and the result is empty. Other columns play no part.
    """
    return score_all(df, id_col, text_col, lang_col).where("spam").select(id_col)
