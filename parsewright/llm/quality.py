"""Problem 3: statistics of each document's text, and from them prose, list, table or junk.

The statistics are computed row by row, but for one corpus figure: how likely letters follow each other
in all contents. Gradient-boosted trees are fitted on them with weak labels, given only to rows that are plainly one
kind, and on half of the hand-checked rows; the other half, never fitted, calibrates the probabilities.
"""

from __future__ import annotations

import html
import json
import math
import re
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parsewright.llm.boosting import BoostedTrees
from parsewright.session import cut_lineage, spread

KINDS = ("prose", "list", "table", "junk")
#: The trees are fitted on at most so many weakly labelled rows of each kind, those with the smallest hash.
SAMPLE_PER_KIND = 1000
#: Weakly labelled rows of each kind that are held out of the fit, to report how well it does.
HELD_PER_KIND = 300

_TAG = re.compile(r"<(/?)([A-Za-z][\w:-]*)[^<>]{0,500}?/?>|<[?!][^<>]{0,500}>")
_ROW_END = {"row", "tr", "item", "li", "p", "div", "head", "title", "author", "h1", "h2", "h3", "h4", "note", "br", "label", "list", "table"}
_CELL_END = {"cell", "td", "th"}
_HEADER = re.compile(r"<teiHeader\b.*?</teiHeader>", re.S)
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_END = re.compile(r"[.!?:;…。！？][\"'”’»)\]]*$")
_LEADER = re.compile(r"(?:\.\s?){4,}\s*\w*$|…{2,}")
_MARK = re.compile(r"^\s*(?:[-*•–—▪◦+]\s|\(?\d{1,3}[.)]\s|\d+(?:\.\d+)+\s|\(?[a-z]\)\s|item\s*\d+\s*[:.])", re.I)
_YEAR = re.compile(r"\b(?:1[89]|20)\d\d[a-z]?\b")
_SOURCE = re.compile(r"\d+\s*\(\d+\)|\d+\s*[:;,]\s*\d+\s*[–-]\s*\d+|doi\b|https?:")
_PAIR = re.compile(r"^\S{1,24}(?:\s\S{1,24}){0,3}\s*[=:;]\s+\S")
_NUMERIC = re.compile(r"^[\s($\[]*[-–<>=]?\s*(?:p\s*[<=]\s*)?[-–]?\d*\.?\d+[\d.,;:%\s)\]–-]*$|^[-–—]?$")
_RULE = re.compile(r"^[\s|:=+-]+$|^\\(?:begin|end|hline|toprule|midrule|bottomrule)\b.*$")

_DIGIT = re.compile(r"\d")
_SYMBOL = re.compile(r"[^\w\s]|_")
_VOWEL = re.compile("[aeiouyàáâäåèéêëìíîïòóôöùúûü]")
_CONSONANTS = re.compile("[bcdfghjklmnpqrstvwxz]{5}")
_SIGNS = re.compile(r"[^\w\s.](?:\s?[^\w\s.]){3,}")
_RUNS = re.compile(r"([^\w\s.])(?:\s?\1){3,}")
_CODES = re.compile(r"(?:\(cid:\d+\)\s?){2,}|(?:/G\d+\s?){2,}")

FEATURES = ("word_count", "mean_word_length", "symbol_ratio", "punctuated_lines", "common_words", "letters_logp", "letter_share", "digit_share", "odd_words", "vowels", "cells", "numeric_cells", "marked", "leaders", "sources", "pairs", "bare", "sentences", "line_length", "distinct_words", "repeated_symbols", "long_words")


def to_lines(content: str, fmt: str | None = None) -> list[str]:
    """Lines of the text without its markup; table cells are parted by tabs, items and paragraphs stand on lines of their own."""
    if "<" in content and _TAG.search(content):
        content = _HEADER.sub("", content)

        def swap(m: re.Match) -> str:
            name = (m.group(2) or "").lower()
            if name in _CELL_END:
                return "\t" if m.group(1) else ""
            return "\n" if name in _ROW_END else ""

        content = html.unescape(_TAG.sub(swap, content))
    return [line for line in content.replace("\r\n", "\n").replace("\r", "\n").split("\n") if line.strip() and not _RULE.match(line)]


def cells_of(line: str) -> list[str]:
    """Cells of a table row in any notation; a line that is none gives one cell."""
    s = line.strip()
    for mark in ("\t", "|", " & ", ";"):
        if s.count(mark) >= (2 if mark != ";" else 2):
            cells = [c.strip(" \\") for c in s.strip(mark).split(mark)]
            if mark == ";" and (sum(map(len, cells)) > 45 * len(cells) or sum(bool(_NUMERIC.match(c)) for c in cells) < 0.4 * len(cells)):
                continue
            return cells
    cells = re.split(r" {2,}", s)
    return cells if len(cells) >= 3 and sum(map(len, cells)) < 40 * len(cells) else [s]


_BASE = str.maketrans("àáâãäåçèéêëìíîïñòóôõöùúûüýÿß", "aaaaaaceeeeiiiinooooouuuuyys")


def _letter_table() -> np.ndarray:
    codes = np.zeros(256, np.uint8)
    for k in range(256):
        c = chr(k).lower().translate(_BASE)
        codes[k] = ord(c) - 96 if "a" <= c <= "z" else 27 if k >= 192 else 0
    return codes


_LETTER_CODES = _letter_table()


def letter_codes(text: str) -> np.ndarray:
    """Letters as 1 to 26 (accented ones by their base, others 27), all else 0, as an array."""
    return _LETTER_CODES[np.frombuffer(text.encode("latin-1", "replace"), np.uint8)]


PAIRS = 28 * 28
_INNER = np.outer(np.arange(28) > 0, np.arange(28) > 0).ravel()  # letter after letter


def letter_pairs(text: str) -> np.ndarray:
    a = letter_codes(text).astype(np.int64)
    return np.bincount(a[:-1] * 28 + a[1:], minlength=PAIRS) if len(a) > 1 else np.zeros(PAIRS, np.int64)


class Words(dict):
    """Word in lower case -> whether letters stand in it as in no word; remembers what it has seen, in bounds."""

    def __missing__(self, w: str) -> bool:
        if len(self) > 200_000:
            self.clear()
        odd = self[w] = len(w) > 2 and not _VOWEL.search(w) or bool(_CONSONANTS.search(w))
        return odd


_ODD = Words()


def languages_of(common: dict[str, frozenset[str]]) -> dict[str, tuple[str, ...]]:
    """Common word -> its languages."""
    out: dict[str, tuple[str, ...]] = {}
    for lang, words in common.items():
        for w in words:
            out[w] = (*out.get(w, ()), lang)
    return out


def statistics(content: str, fmt: str | None, language: str | None, common: dict[str, tuple[str, ...]], logp: np.ndarray) -> list[float]:
    """The FEATURES of one content that is not blank. Shares of lines are shares of their characters. ``common`` is that of
    ``languages_of``."""
    lines = to_lines(content, fmt)
    text = "\n".join(lines)
    words: list[str] = []
    weight = dict.fromkeys(("ends", "cells", "leaders", "sources", "marked", "pairs", "sentences", "bare"), 0)
    n = long_words = numeric = n_cells = 0
    for line in lines:
        parts = line.split()
        size = sum(map(len, parts))
        n += size
        if size > 30:
            long_words += sum(len(t) for t in parts if len(t) > 30)
        cells = cells_of(line)
        own = _WORD.findall(line.lower())
        words += own
        bare = line.rstrip()
        ends = bool(_END.search(bare, len(bare) - 6 if len(bare) > 6 else 0)) or bare[-1:] in "\"'”’»)]" and bool(_END.search(bare))
        if ends:
            weight["ends"] += size
        if len(cells) >= 3:
            weight["cells"] += size
            n_cells += len(cells)
            numeric += sum(bool(_NUMERIC.match(c)) for c in cells)
            continue
        known = sum(map(common.__contains__, own)) / max(1, len(own))
        dotted = "." in bare or "…" in bare
        if dotted and _LEADER.search(bare):
            weight["leaders"] += size
        elif _YEAR.search(line) and ("," in line or ":" in line) and _SOURCE.search(line):
            weight["sources"] += size
        elif _MARK.match(line):
            weight["marked"] += size
        elif len(line) < 90 and not ends and _PAIR.match(line):
            weight["pairs"] += size
        elif len(own) >= 6 and known >= 0.2 or ends and len(own) >= 4 and known >= 0.12:
            weight["sentences"] += size
        elif len(line) < 80 and not ends:
            weight["bare"] += size
    n = max(1, n)
    n_words = max(1, len(words))
    joined = "".join(words)
    letters = len(joined) - joined.count("'") - joined.count("’") - joined.count("-")
    digits, symbols = len(_DIGIT.findall(text)), len(_SYMBOL.findall(text))
    counted = Counter(words)
    hits: Counter = Counter()
    odd = 0
    for w, c in counted.items():
        for lang in common.get(w, ()):
            hits[lang] += c
        if _ODD[w]:
            odd += c
    declared = (language or "").strip().lower()[:2]
    share = hits[declared] if hits[declared] >= 0.15 * n_words else max(hits.values(), default=0)
    pairs = letter_pairs(text)
    inner = pairs[_INNER]
    plausible = float((inner * logp[_INNER]).sum() / inner.sum()) if inner.sum() >= 30 else -2.6
    vowels = len(_VOWEL.findall(joined)) / max(1, letters)
    # signs beside signs are rare: only there signs can repeat
    runs = sum(len(m.group()) for stretch in _SIGNS.finditer(text) for m in _RUNS.finditer(stretch.group())) if symbols >= 4 else 0
    runs += text.count("\ufffd")
    if "(cid:" in text or "/G" in text:
        runs += sum(len(m.group()) for m in _CODES.finditer(text))
    at_line = [weight[k] / n for k in ("cells", "leaders", "sources", "marked", "pairs", "sentences", "bare")]
    return [len(words), len(joined) / n_words, symbols / n, weight["ends"] / n, share / n_words, plausible, letters / n, digits / n, odd / n_words, vowels, at_line[0], numeric / max(1, n_cells), at_line[3], at_line[1], at_line[2], at_line[4], at_line[6], at_line[5], min(400.0, n / max(1, len(lines))), len(counted) / n_words, runs / n, long_words / n]


_AT = {f: i for i, f in enumerate(FEATURES)}


def weak_kind(s: list[float]) -> str | None:
    """The kind of a row that is plainly and almost wholly one; None for most rows, which the trees decide."""
    get = lambda name: s[_AT[name]]
    if get("cells") > 0.85 and get("numeric_cells") > 0.45 and get("letters_logp") > -3.2:
        return "table"
    if get("repeated_symbols") > 0.5 or get("long_words") > 0.8 or get("letter_share") < 0.2 and get("symbol_ratio") > 0.6 or get("letters_logp") < -4.2 or get("odd_words") > 0.5 and get("common_words") < 0.05:
        return "junk"
    if max(get("leaders"), get("sources"), get("marked"), get("pairs")) > 0.85 and get("letters_logp") > -3.1:
        return "list"
    if get("sentences") + 0.5 * get("bare") > 0.7 and get("common_words") > 0.24:
        return "prose"
    return None


def _common(common_words: DataFrame) -> dict[str, frozenset[str]]:
    out: dict[str, set[str]] = {}
    for r in common_words.collect():  # a fixed list
        if r.word and r.lang:
            out.setdefault(r.lang.lower(), set()).add(r.word.lower())
    return {k: frozenset(v) for k, v in sorted(out.items())}


def letter_model(df: DataFrame, content_col: str = "content") -> np.ndarray:
    """Log-probability of each letter after the one before, over all contents; 784 numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(PAIRS, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total += letter_pairs(_TAG.sub(" ", text) if "<" in text else text)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(PAIRS, dtype=np.int32)), pa.array(total)], names=["pair", "n"])

    counts = np.zeros(PAIRS)
    for r in spread(df.where(F.col(content_col).isNotNull()).select(content_col)).mapInArrow(run, "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        counts[r.pair] = r.n
    table = counts.reshape(28, 28) + 1.0
    return np.log(table / table.sum(1, keepdims=True)).ravel()


def text_statistics(df: DataFrame, common_words: DataFrame, id_col: str = "parse_id", content_col: str = "content", format_col: str = "format", metadata_col: str = "metadata") -> DataFrame:
    """``id_col``, the FEATURES as doubles and the weak label; contents that are null or blank have no row."""
    shared = df.sparkSession.sparkContext.broadcast((languages_of(_common(common_words)), letter_model(df, content_col)))
    kind = df.schema[id_col].dataType.simpleString()
    language = F.col(metadata_col)["lang"] if metadata_col else F.lit(None).cast("string")
    known = df.where(F.col(content_col).rlike(r"(?U)\S")).select(F.col(id_col).alias("id"), F.col(content_col).alias("content"), F.col(format_col).cast("string").alias("format"), language.alias("language"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, logp = shared.value
        for batch in batches:
            rows = [statistics(c, f, lang, common, logp) for c, f, lang in zip(*(batch.column(k).to_pylist() for k in ("content", "format", "language")))]
            columns = [pa.array([float(r[i]) for r in rows], pa.float64()) for i in range(len(FEATURES))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns, pa.array([weak_kind(r) for r in rows], pa.string())], names=[id_col, *FEATURES, "weak_kind"])

    return spread(known).mapInArrow(run, f"`{id_col}` {kind}, {', '.join(f'{f} double' for f in FEATURES)}, weak_kind string")


def holdout() -> tuple[np.ndarray, np.ndarray]:
    """Hand-checked rows: statistics and class numbers."""
    rows = json.loads(Path(__file__).with_name("holdout_kinds.json").read_text())
    return np.array([r["statistics"] for r in rows]), np.array([KINDS.index(r["kind"]) for r in rows])


def hand_checked() -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Every other hand-checked row of each kind for the fit, and the others, which only calibrate and test."""
    x, y = holdout()
    place = np.array([(y[:i] == k).sum() for i, k in enumerate(y)])
    return (x[place % 2 == 0], y[place % 2 == 0]), (x[place % 2 == 1], y[place % 2 == 1])


def labelled_sample(stats: DataFrame, id_col: str = "parse_id") -> tuple[np.ndarray, np.ndarray]:
    """Statistics and class numbers of at most SAMPLE_PER_KIND + HELD_PER_KIND weakly labelled rows of each kind, in order of a
    hash. Each task hands on no more than that of each kind (a sorted limit), however frequent it is."""
    x, y = [np.zeros((0, len(FEATURES)))], []
    order = F.xxhash64(F.col(id_col), F.col("word_count"), F.col("mean_word_length"))
    for k, kind in enumerate(KINDS):
        rows = stats.where(F.col("weak_kind") == kind).select(F.array(*FEATURES).alias("x"), order.alias("h")).orderBy("h").limit(SAMPLE_PER_KIND + HELD_PER_KIND).collect()
        if rows:
            x.append(np.array([r.x for r in rows]))
            y += [k] * len(rows)
    return np.concatenate(x), np.array(y, np.int64)


def _fit(x: np.ndarray, y: np.ndarray) -> tuple[BoostedTrees, np.ndarray]:
    """The calibrated trees, and which of the labelled rows were held out of the fit: a fifth of each kind, at most HELD_PER_KIND."""
    place = np.array([(y[:i] == k).sum() for i, k in enumerate(y)], np.int64) if len(y) < 2 else np.arange(len(y)) - np.searchsorted(y, y)
    held = (place % 5 == 4) & (place // 5 < HELD_PER_KIND)
    (x_own, y_own), (x_test, y_test) = hand_checked()
    return BoostedTrees(list(KINDS)).fit(np.concatenate([x[~held], x_own]), np.concatenate([y[~held], y_own])).calibrate(x_test, y_test), held


def fit_kinds(stats: DataFrame, id_col: str = "parse_id") -> BoostedTrees:
    """Trees fitted on a bounded sample of weakly labelled rows and half of the hand-checked ones, calibrated on the other half."""
    return _fit(*labelled_sample(stats, id_col))[0]


def calibration(stats: DataFrame, id_col: str = "parse_id") -> DataFrame:
    """How well the trees and the rules of the weak labels do on rows that were never fitted: ``rows`` (hand_checked or
    weakly_labelled), ``model``, ``n``, ``decided`` (rows that the model gives a kind), ``accuracy`` (of all rows), and
    ``calibration_error``, the mean gap between probability and accuracy over ten bins (null for rules)."""
    x, y = labelled_sample(stats, id_col)
    model, held = _fit(x, y)
    out = []
    for name, (tx, ty) in (("hand_checked", hand_checked()[1]), ("weakly_labelled", (x[held], y[held]))):
        if not len(ty):
            continue
        p = model.probabilities(tx)
        right, sure = p.argmax(1) == ty, p.max(1)
        bins = np.minimum((sure * 10).astype(int), 9)
        gap = sum(abs(sure[bins == b].mean() - right[bins == b].mean()) * (bins == b).mean() for b in np.unique(bins))
        rules = [weak_kind(list(r)) for r in tx]
        out.append((name, "trees", len(ty), len(ty), float(right.mean()), float(gap)))
        out.append((name, "rules", len(ty), sum(r is not None for r in rules), float(np.mean([r == KINDS[k] for r, k in zip(rules, ty)])), None))
    return stats.sparkSession.createDataFrame(out, "rows string, model string, n int, decided int, accuracy double, calibration_error double")


def classify(df: DataFrame, common_words: DataFrame, id_col: str = "parse_id", **columns: str) -> DataFrame:
    """``id_col``, ``kind``, ``probability``, and the statistics: words, mean word length, symbol ratio, share of text in
    lines that end in punctuation, share of common words.

    Null, empty and blank contents have no row; a null format or metadata is allowed, a wrong language
    is overruled by the text. Equal rows come out each. Other columns play no part.
    """
    stats = cut_lineage(text_statistics(df, common_words, id_col, **columns))  # a few numbers a row, read for the fit and for the result
    shared = df.sparkSession.sparkContext.broadcast(fit_kinds(stats, id_col))
    kind = df.schema[id_col].dataType.simpleString()
    named = FEATURES[:5]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            x = np.column_stack([batch.column(f).to_numpy() for f in FEATURES]) if batch.num_rows else np.zeros((0, len(FEATURES)))
            p = model.probabilities(x)
            best = p.argmax(1) if len(p) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array([KINDS[b] for b in best], pa.string()), pa.array(p[np.arange(len(p)), best] if len(p) else [], pa.float64()), *(batch.column(f) for f in named)], names=[id_col, "kind", "probability", *named])

    return stats.select(id_col, *FEATURES).mapInArrow(run, f"`{id_col}` {kind}, kind string, probability double, {', '.join(f'{f} double' for f in named)}")


def find_not_prose(df: DataFrame, common_words: DataFrame, id_col: str = "parse_id", **columns: str) -> DataFrame:
    """``id_col`` and ``kind`` of the rows that are no prose."""
    return classify(df, common_words, id_col, **columns).where("kind <> 'prose'").select(id_col, "kind")
