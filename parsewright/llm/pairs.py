"""Problem 4: broken pairs of a question and an answer.

Each output is taken out of its wrapping (reasoning, JSON, markup, lead-ins). What is left is compared
with the question: a naive Bayes model of character n-grams gives the language of both, the likelihood that a text
ends after its last characters, by a character n-gram model with an end symbol, tells cut-off endings, an alignment
tells copies, and a naive Bayes model of words and word pairs tells refusals. All models are fitted on all distinct
answers, weakly labelled, and on all questions.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parsewright.session import cut_lineage, spread

#: Character n-grams are hashed into so many cells; n-gram lengths.
CELL_BITS, NGRAMS = 15, (1, 2, 3, 4)
CELLS = 1 << CELL_BITS
#: An answer is in another language if its best language beats the question's by so many nats, and nats a character.
MARGIN, MARGIN_PER_CHAR = 1.2, 0.05
#: Character n-grams before an end, in ascending order; how much evidence the shorter of two is worth; and the likelihood of
#: an end below which a text that has no end mark is cut off.
ENDING_NGRAMS, BACKOFF, LEAST_END = (2, 3, 4, 5, 6, 8, 10, 13, 16), 2.0, 0.04
#: Cells of the filter that keeps n-grams from being counted that no ending asks for.
FILTER_BITS = 1 << 23
#: What a language's answers, and all questions, weigh in n-grams at most.
MOST_WEIGHT = 200_000
#: Log-odds of a refusal, over the root of the number of features, from which a text is one; a feature's odds in millionths, at
#: most so large; and the share of texts that is added to each feature's, in refusals and in answers.
REFUSED, UNIT, MOST_ODDS, RARE = 4.5, 1_000_000, 3.0, 1e-5
#: Cells that hold the largest odds of the features hashed into them, a power of two.
ODDS_CELLS = 1 << 20
#: Hashes of features that a worker remembers.
REMEMBERED_KEYS = 200_000
#: Questions up to which the catalogue is broadcast; a larger one is joined to the answers.
MOST_QUESTIONS = 20_000
#: Answers whose result a task remembers.
REMEMBERED = 50_000

DEFECTS = ("empty", "truncated", "refusal", "copy", "language")

_LEAD = re.compile(r"^[\s*_#>-]*(?:(?:final|my|the|short)\s+)?(?:answer|response|result|output)\b\s*(?:is\s*)?[*_]*\s*[:：]\s*[*_]*\s*", re.I)
_LATER = re.compile(r"(?:^|\n|\.\s)[\s*_#>-]*(?:final\s+)?answer[*_]*\s*[:：][*_]*", re.I)
_STEPS = re.compile(r"^\s*(?:step\s*\d+\s*[:.)]|(?:the\s+)?answer\s+follows\s+from|let me\b|let us\b|let's\b|first,\s+i\b)", re.I)
_NOTHING = re.compile(r"^[\W_]*$")
_NONE = re.compile(r"^[\W_]*(?:null|none|n/?a|nan|undefined)?[\W_]*$", re.I)
_LETTERS = re.compile(r"[^\W\d_]+")
_PLAIN_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|\d+")
_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
_SIMPLE = re.compile(r"^\W*(?:[A-Za-z](?:\W+[A-Za-z])*|[-+−]?\d[\d.,\s]*%?)\W*$")
_CLOSED = re.compile(r"[.!?…。！？؟][\"'”’»)\]}*_]*$|[)\]}”»]$")
_QUOTED = re.compile(r"[“\"«„][^“”\"«»„]{0,200}[”\"»“]")
_DIGITS = re.compile(r"\d+")
_SEGMENT = re.compile(r"([^.,;:!?()\[\]\n…“”\"]+)([.,;:!?()\[\]\n…“”\"]*)")
_SELF = re.compile(r"\b(?:i|i'm|i’m|i'd|i'll|me|my|mine|this assistant|this model)\b|\bas an? (?:ai|language model|assistant)", re.I)
# Ways to decline a task, in the first person; they only give weak labels.
_DECLINE = re.compile(
    r"can(?:no|['’])t\b|can not|won['’]?t|will not|\bunable\b|\bnot able\b|n['’]?o?t (?:be )?(?:possible|able|appropriate|permitted|allowed|comfortable|willing|something|in a position)|not (?:feel|permitted|allowed|willing)"
    r"|refrain|declin|prefer not|keeps? me from|prevents? me|stops? me|against my|outside (?:of )?(?:what|my)|beyond (?:what|my)|no ability|do not have (?:the ability|access)|don['’]t have (?:the ability|access)|refus|must not|should not|no answer can be given|not going to",
    re.I,
)
_TASK = re.compile(r"answer|cod(?:e|ing)|judg|classif|extract|read|open|complet|task|request|comply|help|process|assist|decid|provid|respond|discuss|attachment|document|paper|study|excerpt|this|that|do\b", re.I)
_ASIDE = re.compile(r"^\W*(?:the authors|participants|they|we)\b", re.I)


def unwrap(raw: str | None) -> tuple[str, str]:
    """State and text of an output: ``empty``, ``truncated`` (in its wrapping or reasoning) or ``text``."""
    if raw is None:
        return "empty", ""
    text = raw.strip()
    while True:  # each round takes something off
        before = text
        low = text[:16].lower()
        if re.match(r"<think", low):
            end = re.search(r"</think(?:ing)?>", text, re.I)
            if not end:
                return "truncated", ""
            text = text[end.end() :]
        elif re.match(r"<(?:t|th|thi|thin)?$", low):
            return "truncated", ""
        elif low.startswith("<!--"):
            if "-->" not in text:
                return "truncated", ""
            text = text.split("-->", 1)[1]
        elif re.match(r"\((?:reasoning|rationale|thoughts?)\b", low):
            depth = 0
            for i, c in enumerate(text):
                depth += (c == "(") - (c == ")")
                if not depth:
                    break
            if depth:
                return "truncated", ""
            text = text[i + 1 :]
        elif low.startswith("```"):
            body = text[3:]
            if "```" not in body:
                return "truncated", body
            inner, after = body.split("```", 1)
            text = re.sub(r"^[a-z]*\n", "", inner).strip() or after
        elif text.startswith(("{", "[")) and len(text) > 1 and re.match(r"\{\s*(?:\"|$)|\[\s*(?:\"|\]|\{)", text):
            try:
                found = json.loads(text)
            except ValueError:
                if text.rstrip()[-1] not in "}]":
                    return "truncated", ""
                return "text", text
            if isinstance(found, dict):
                key = next((k for k in found if re.search("answer|response|result|output", str(k), re.I)), None)
                found = found.get(key) if key else None
            if isinstance(found, list):
                found = ", ".join(str(x) for x in found if x is not None)
            text = "" if found is None else str(found)
        elif m := re.match(r"<answer>", low):
            end = re.search(r"</answer>", text, re.I)
            text = text[m.end() : end.start()] if end else text[m.end() :]
            if not end and not text.strip():
                return "truncated", ""
        elif _STEPS.match(text):
            later = list(_LATER.finditer(text))
            if not later:
                return "truncated", text
            text = text[later[-1].end() :]
        else:
            text = _LEAD.sub("", text, count=1)
        text = text.strip()
        if text == before:
            break
    return ("empty", "") if _NONE.match(text) else ("text", text)


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def looks_refused(text: str) -> bool:
    """The weak label: the text declines in its own name. What the paper's authors or participants decline is no refusal."""
    low = _QUOTED.sub(" ", text)
    if _ASIDE.match(low):
        return False
    return bool(_DECLINE.search(low) and (_SELF.search(low) or re.search(r"\bno answer can be given\b|^\W*(?:sorry|apolog|my apolog|unfortunately)", low, re.I)) and _TASK.search(low)) or bool(re.search(r"\bas an? (?:ai|language) (?:model|assistant)\b|^\W*(?:sorry\W+)?i (?:must|have to) (?:decline|refuse)\W*$", low, re.I))


# Refusals and answers that are always counted, so that a table without any has a model as well.
_SEED_REFUSALS = (
    "I'm sorry, but I can't help with that.", "I cannot answer this question.", "I am unable to code this item.", "Sorry, I can't process this document.", "I must decline.", "As an AI assistant, I am not able to judge this.",
    "I won't complete this task.", "My guidelines do not allow me to answer.", "I would rather not answer that.", "I am not permitted to read this excerpt.", "Unfortunately, I cannot assist with this request.", "I don't feel comfortable answering this.",
    "My policy prohibits me from coding such content.", "This assistant will not answer the question.", "I have to refuse this request.", "I prefer not to classify this paper.", "Answering would be against my rules.", "I apologize, but I can't do this.",
)
_SEED_ANSWERS = (
    "This cannot be determined from the excerpt.", "The authors do not report this.", "The paper doesn't say.", "Not reported.", "No information was given on the sample.", "The study could not answer this question.", "The participants declined to answer.", "It is not possible to tell from the text.",
    "The authors cannot rule out confounding.", "The item was not coded by the raters.", "No policy was studied.", "The model was not able to predict the outcome.", "Two parents refused to take part.", "The guidelines were followed.",
)


def refusal_features(text: str) -> set[str]:
    """Words and pairs of neighbouring words, quotations aside."""
    words = ["^", *_PLAIN_WORD.findall(_QUOTED.sub(" ", text).lower().replace("\u2019", "'")), "$"]
    return {*words[1:-1], *(f"{a} {b}" for a, b in zip(words, words[1:]))}


class Keys(dict):
    """Feature -> 64-bit hash. Emptied when large; it only saves time."""

    def __missing__(self, feature: str) -> int:
        if len(self) > REMEMBERED_KEYS:
            self.clear()
        key = self[feature] = int.from_bytes(blake2b(feature.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)
        return key


_KEYS = Keys()
#: The feature that every text has; it isn't one of ``refusal_features``.
ANY = Keys()[""]


def refusal_keys(text: str) -> list[int]:
    return [_KEYS[f] for f in refusal_features(text)]


def odds(yes, no, refusals: int, answers: int, log: Callable):  # noqa: ANN001, ANN201
    """Log-odds of features that so many refusals and answers have, as numbers, arrays or columns; 0 if no text has them."""
    return log(yes / (refusals + 1) + RARE) - log(no / (answers + 1) + RARE)


class Refusals:
    """Naive Bayes on the presence of features; features that no labelled text has count for neither side.

    Each cell has the largest odds of its features, so a score is that of the text or, where features share cells, higher.
    """

    def __init__(self, refusals: list[str], answers: list[str]):
        refusals, answers = [*refusals, *_SEED_REFUSALS], [*answers, *_SEED_ANSWERS]
        yes, no = (Counter(k for t in texts for k in refusal_keys(t)) for texts in (refusals, answers))
        keys = list(yes | no)
        found = odds(np.array([yes[k] for k in keys]), np.array([no[k] for k in keys]), len(refusals), len(answers), np.log)
        self.most = np.full(ODDS_CELLS, -UNIT * 10, np.int32)
        np.maximum.at(self.most, np.array([k & ODDS_CELLS - 1 for k in keys]), np.rint(np.clip(found, -MOST_ODDS, MOST_ODDS) * UNIT).astype(np.int32))
        self.most[self.most == -UNIT * 10] = 0

    @classmethod
    def of(cls, weights: DataFrame) -> Refusals:
        """The model of ``refusal_weights``: at most ODDS_CELLS numbers reach the driver."""
        self = cls.__new__(cls)
        cells = ODDS_CELLS
        got = weights.groupBy(F.pmod("key", F.lit(cells)).alias("cell")).agg(F.max("weight").alias("most")).toArrow()
        self.most = np.zeros(cells, np.int32)
        self.most[got["cell"].to_numpy()] = got["most"].to_numpy()
        return self

    def score(self, text: str) -> float:
        keys = refusal_keys(text)
        mask = len(self.most) - 1
        return int(self.most[[k & mask for k in keys]].sum(dtype=np.int64)) / UNIT / math.sqrt(len(keys))

    def refused(self, text: str) -> bool:
        return self.score(text) >= REFUSED


class Question:
    """What an answer could be a copy of: each text of the question on its own, and all of them."""

    def __init__(self, label: str | None, description: str | None, others: list[str | None]):
        self.label = words_of(label or "")
        self.main = words_of(description or "")
        self.texts = [w for w in {tuple(words_of(t)) for t in (description, *others) if t} if w]

    def copied(self, text: str) -> bool:
        """Nearly all words of ``text`` stand in one of the question's texts in the same order, they are most of that
        text or of the question proper, and none come after it."""
        own = words_of(text)
        if len(own) < 3:
            return False
        if own[: len(self.label)] == self.label and len(own) > len(self.label) + 2:
            tail = own[len(self.label) :]
            if self._near(tail, tuple(self.main)):
                return True
        return self._near(own, tuple(self.main)) or any(self._near(own, t) for t in self.texts)

    def _near(self, own: list[str], text: tuple[str, ...]) -> bool:
        if not text or len(set(own) & set(text)) < 0.7 * len(set(own)):
            return False
        blocks = SequenceMatcher(None, own, text, autojunk=False).get_matching_blocks()
        same = sum(b.size for b in blocks)
        last = next((b for b in reversed(blocks) if b.size), None)
        after = len(own) - (last.a + last.size) if last else len(own)
        return same >= 0.8 * len(own) and not after and (same >= 0.6 * len(text) or same >= 6 and same >= 0.95 * len(own))


def ngram_cells(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash cells of the n-grams of the texts' letters, words set apart by spaces, and the numbers of their texts."""
    flat = [" " + " ".join(_LETTERS.findall(t.lower())) + " " for t in texts]
    c = np.frombuffer("".join(flat).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(t) for t in flat], np.int64)
    no = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(len(c)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    some = np.repeat(sizes > 3, sizes)
    h, cells, numbers = np.zeros(len(c), np.uint64), [], []
    power = np.uint64(1)
    for n in range(1, NGRAMS[-1] + 1):
        if n <= len(c):
            h[n - 1 :] += c[: len(c) - n + 1] * power
        power *= np.uint64(0x9E3779B97F4A7C15)
        own = some & (place >= n - 1)
        cells.append(((h[own] + np.uint64(n)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - CELL_BITS)).astype(np.int64))
        numbers.append(no[own])
    return np.concatenate(cells), np.concatenate(numbers)


class Languages:
    """Naive Bayes over hashed character n-grams; the first language is the one that questions are mostly in."""

    def __init__(self, names: list[str], counts: np.ndarray):
        self.names = names
        smooth = counts + 0.05
        self.logp = np.log(smooth / smooth.sum(1, keepdims=True)).astype(np.float32)

    def scores(self, text: str) -> np.ndarray | None:
        """Log-likelihoods by language, in nats for each letter's worth of n-grams; None without letters."""
        cells, _ = ngram_cells([text])
        return self.logp[:, cells].sum(1) / len(NGRAMS) if len(cells) else None

    def differs(self, text: str, language: int) -> bool:
        letters = [c for c in text if c.isalpha()]
        if len(letters) >= 2 and sum(ord(c) >= 0x370 for c in letters) > 0.5 * len(letters):
            return True  # no script of the languages that the model knows
        if len(letters) < 3:
            return False
        s = self.scores(text)
        gap = float(s.max() - s[language])
        if gap <= MARGIN or gap <= MARGIN_PER_CHAR * len(letters):
            return False
        words = text.split()
        if len(words) > 1 and not _CLOSED.search(text):  # the last word may be cut off; the others must speak for themselves
            rest = self.scores(" ".join(words[:-1]))
            if rest is not None:
                others = float(np.delete(rest, language).max())
                return others > float(rest[language]) - 0.5 if gap > 2 * MARGIN else others > float(rest[language]) + 0.25 * MARGIN
        return True


def _weak_language(words: list[str], common: dict[str, dict[str, int]]) -> str | None:
    """Language whose common words the text has most of, if by far."""
    hits = Counter(lang for w in words for lang in common.get(w, ()))
    best = hits.most_common(2)
    if not best or best[0][1] < 2 or len(best) > 1 and best[0][1] < 2 * best[1][1]:
        return None
    return best[0][0]


def segments(text: str) -> list[tuple[list[str], str]]:
    """Parts of a text between marks, as words, each with what follows it: a mark, or nothing at the text's end."""
    out = []
    for m in _SEGMENT.finditer(text):
        if w := words_of(_DIGITS.sub("0", m.group(1))):
            out.append((w, m.group(2)))
    return out


def is_open(text: str) -> bool:
    """Whether a text has words and no mark at its end that closes it."""
    text = text.strip()
    return not (_CLOSED.search(text) or _SIMPLE.match(text)) and bool(_WORD.search(text))


def end_keys(texts: list[str]) -> tuple[np.ndarray, ...]:
    """All n-grams of ENDING_NGRAMS that end with a letter or digit, in arrays: length, hash, number of the text, whether the text goes
    on after it (with a letter, blank or hyphen), whether it ends (with the text, a sentence, a bracket, or an item of a list
    of short ones), and whether it is the last of its text. After commas in sentences and before quotations neither is counted.
    """
    flat = ["^" + _DIGITS.sub("0", t.lower()) + "\x00" for t in texts]
    c = np.frombuffer("".join(flat).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(t) for t in flat], np.int64)
    no = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(len(c)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    known, inverse = np.unique(c, return_inverse=True)
    solid = np.array([chr(int(k)).isalnum() for k in known], bool)[inverse]
    following = np.concatenate([c[1:], [0]]) if len(c) else c
    within = lambda marks: np.isin(following, [ord(m) for m in marks])
    lists = np.array([_is_list(t) for t in texts], bool)[no]
    ends = within("\x00.!?;\u2026)") | within(",") & lists
    neither = within(":(\u201d\",") & ~ends
    at = np.flatnonzero(solid & (place > 0))
    # the last letter or digit of each text, whatever follows it
    last = np.zeros(len(c), bool)
    if len(at):
        last[at[np.concatenate([no[at][1:] != no[at][:-1], [True]])]] = True
    h, out = np.zeros(len(c), np.uint64), []
    power = np.uint64(1)
    for n in range(1, ENDING_NGRAMS[-1] + 1):
        if n <= len(c):
            h[n - 1 :] += c[: len(c) - n + 1] * power
        power *= np.uint64(0x9E3779B97F4A7C15)
        if n in ENDING_NGRAMS:
            own = at[place[at] >= n - 1]
            mixed = (h[own] + np.uint64(n)) * np.uint64(0xD6E8FEB86659FD93)
            out.append((np.full(len(own), n, np.int32), (mixed ^ (mixed >> np.uint64(32))).astype(np.int64), no[own], ~(ends | neither)[own], ends[own], last[own]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _is_list(text: str) -> bool:
    parts = segments(text)
    return len(parts) > 1 and all(len(w) <= 5 for w, _ in parts) and all(c in ",;" for _, c in parts[:-1])


def _unclosed(text: str) -> bool:
    return text.count("(") > text.count(")") or text.count("“") > text.count("”") or text.rstrip()[-1:] in (",", ";")


def _question(label: str | None, description: str | None, detailed: str | None, instructions: str | None, prompts: dict | None) -> Question:
    p = prompts or {}
    others = [detailed, instructions, *(v for k, v in p.items() if isinstance(v, str) and "examples" not in k), *(x for x in p.get("binary_prompts") or [])]
    if description and detailed:
        others.append(f"{description} {detailed}")
    return Question(label, description, others)


_ASKED = ("label", "description", "description_detailed", "instructions", "prompts")


def catalogue(queries: DataFrame) -> dict[str, Question] | None:
    """Questions by id, of ids that are there twice either; None if there are more than MOST_QUESTIONS."""
    if queries.limit(MOST_QUESTIONS + 1).count() > MOST_QUESTIONS:
        return None
    return {r.query_id: _question(*r[1:5], r.prompts.asDict() if r.prompts else None) for r in queries.select("query_id", *_ASKED).collect()}


def distinct_answers(results: DataFrame, text_col: str = "raw_output") -> DataFrame:
    """``text`` of all answers out of their wrapping, each once, with ``n``, the rows that give it, and ``refused``, its weak label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(text, n) for raw, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for state, text in [unwrap(raw)] if state == "text"]
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64()), pa.array([looks_refused(t) for t, _ in found], pa.bool_())], names=["text", "n", "refused"])

    raw = results.where(F.col(text_col).isNotNull()).groupBy(text_col).agg(F.count("*").alias("n"))
    return raw.mapInArrow(run, "text string, n bigint, refused boolean").groupBy("text").agg(F.sum("n").alias("n"), F.first("refused").alias("refused"))


def refusal_weights(answers: DataFrame) -> DataFrame:
    """``key`` and ``weight``, the odds in units of 1 / UNIT, of each feature of all ``distinct_answers``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys: list[int] = []
            sizes, yes, no = [], [], []
            for text, refused in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = refusal_keys(text)
                keys += own
                keys.append(ANY)
                sizes.append(len(own) + 1)
                yes.append(refused)
                # texts in the first person that bear no label teach nothing
                no.append(not refused and not _SELF.search(_QUOTED.sub(" ", text)))
            found, at = np.unique(np.array(keys, np.int64), return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), *(pa.array(np.bincount(at, np.repeat(x, sizes), len(found)).astype(np.int64)) for x in (yes, no))], names=["key", "yes", "no"])

    seeds = answers.sparkSession.createDataFrame([(t, True) for t in _SEED_REFUSALS] + [(t, False) for t in _SEED_ANSWERS], "text string, refused boolean")
    counted = cut_lineage(answers.select("text", "refused").unionByName(seeds.coalesce(1)).mapInArrow(count, "key bigint, yes bigint, no bigint").groupBy("key").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")))
    n = counted.where(F.col("key") == ANY).first()
    found = F.greatest(F.lit(-MOST_ODDS), F.least(F.lit(MOST_ODDS), odds(F.col("yes"), F.col("no"), n.yes, n.no, F.log)))
    return counted.where(F.col("key") != ANY).select("key", F.round(found * UNIT).cast("bigint").alias("weight"))


def refused_texts(texts: DataFrame, weights: DataFrame) -> DataFrame:
    """Those ``text`` that are refusals by all ``refusal_weights``, which are joined to the features of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [refusal_keys(t) for t in batch.column(0).to_pylist()]
            sizes = np.array([len(k) for k in keys], np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(len(keys)), sizes))), pa.array(np.repeat(sizes, sizes)), pa.array([x for k in keys for x in k], pa.int64())], names=["text", "size", "key"])

    return texts.select("text").mapInArrow(run, "text string, size int, key bigint").join(weights, "key").groupBy("text", "size").agg(F.sum("weight").alias("weight")).where(F.col("weight") / UNIT / F.sqrt("size") >= REFUSED).select("text")


def fit_languages(answers: DataFrame, common_words: DataFrame, queries: DataFrame) -> Languages:
    """Naive Bayes fitted on all ``distinct_answers``, labelled weakly by common words, and on all questions and word lists themselves.

    Per partition only the table of cells is kept, so what reaches the driver is bounded by languages times cells.
    """
    common: dict[str, dict[str, int]] = {}
    for r in common_words.collect():  # a fixed list
        if r.word and r.lang:
            common.setdefault(r.word.lower(), {})[r.lang] = 1
    names = sorted({lang for v in common.values() for lang in v}, key=lambda x: (x != "en", x)) or ["en"]
    at = {n: i for i, n in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(names), CELLS), np.int64)
        for batch in batches:
            texts, rows = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            labels = [_weak_language(words_of(t), common) for t in texts]
            cells, no = ngram_cells([t if lang else "" for t, lang in zip(texts, labels)])
            weight = np.array([math.isqrt(n) for n in rows], np.int64)
            np.add.at(counts, (np.array([at.get(lang, 0) for lang in labels], np.int64)[no], cells), weight[no])
        lang, cell = counts.nonzero()
        yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(cell.astype(np.int32)), pa.array(counts[lang, cell])], names=["lang", "cell", "n"])

    counts = np.zeros((len(names), CELLS))
    for r in answers.where(F.length("text") >= 12).select("text", "n").mapInArrow(run, "lang int, cell int, n bigint").groupBy("lang", "cell").agg(F.sum("n").alias("n")).collect():
        counts[r.lang, r.cell] = r.n
    # languages count alike, however many answers there are in each; the lists keep rare ones from being empty
    totals = counts.sum(1, keepdims=True)
    counts = np.where(totals > 0, counts / np.maximum(totals, 1) * np.minimum(totals, MOST_WEIGHT), 0)
    for word, langs in common.items():
        for lang in langs:
            np.add.at(counts[at[lang]], ngram_cells([word])[0], 3)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            cells, _ = ngram_cells([f"{label or ''} {description or ''}" for label, description in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())])
            total += np.bincount(cells, minlength=CELLS)
        cell = total.nonzero()[0]
        yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(total[cell])], names=["cell", "n"])

    # the questions are labelled texts of the first language
    asked = np.zeros(CELLS)
    for r in queries.select("label", "description").mapInArrow(ask, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        asked[r.cell] = 3 * r.n
    counts[0] += asked * min(1.0, MOST_WEIGHT / max(1.0, asked.sum()))
    return Languages(names, counts)


def cut_endings(answers: DataFrame, endings: DataFrame) -> DataFrame:
    """``text`` of those ``endings`` that are cut off: by all ``answers`` it is unlikely that a text ends there.

    The likelihood of an end is taken from shorter n-grams to longer ones, each weighed against BACKOFF observations of the
    one before; a text is no evidence for itself, but the root of the number of rows that give it is. Only n-grams that
    endings ask for are counted: a filter of FILTER_BITS cells holds the others back before the shuffle (a full filter
    lets all pass and changes no result).
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, key, no, _, _, last = end_keys(batch.column(0).to_pylist())
            take = pa.array(no[last])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(size[last]), pa.array(key[last])], names=["text", "n", "size", "key"])

    asked = cut_lineage(endings.join(answers.select("text", "n"), "text").mapInArrow(ask, "text string, n bigint, size int, key bigint"))
    word = F.pmod(F.col("key"), F.lit(FILTER_BITS))
    cells = asked.select((word / 64).cast("int").alias("at"), word.alias("word")).selectExpr("at", "shiftleft(1L, cast(word % 64 as int)) as bit").groupBy("at").agg(F.bit_or("bit").alias("bits")).collect()
    table = np.zeros(FILTER_BITS // 64, np.int64)
    for r in cells:  # at most FILTER_BITS / 64
        table[r.at] = r.bits
    shared = answers.sparkSession.sparkContext.broadcast(table)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value.view(np.uint64)
        for batch in batches:
            _, key, _, goes_on, ends, _ = end_keys(batch.column(0).to_pylist())
            cell = np.mod(key, FILTER_BITS)
            some = (wanted[cell // 64] >> (cell % 64).astype(np.uint64) & np.uint64(1) > 0) & (goes_on | ends)
            found, at = np.unique(key[some], return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), *(pa.array(np.bincount(at, x[some], len(found)).astype(np.int64)) for x in (goes_on, ends))], names=["key", "goes_on", "ends"])

    counted = answers.select("text").mapInArrow(count, "key bigint, goes_on bigint, ends bigint").groupBy("key").agg(F.sum("goes_on").alias("goes_on"), F.sum("ends").alias("ends"))

    # at most as many a text as there are n-gram lengths, the shortest first
    found = asked.join(counted, "key").groupBy("text", "n").agg(F.array_sort(F.collect_list(F.struct("size", "goes_on", "ends"))).alias("found"))
    own = F.sqrt("n") - 2  # its own end taken off, and what the rows add
    weigh = lambda p, x: (F.greatest(F.lit(0.0), x["ends"] + own) + BACKOFF * p) / (F.greatest(F.lit(0.0), x["ends"] + own) + x["goes_on"] + BACKOFF)
    return found.where(F.aggregate("found", F.lit(0.1), weigh) < LEAST_END).select("text")


def find_defects(results: DataFrame, queries: DataFrame, common_words: DataFrame, id_col: str = "result_id") -> DataFrame:
    """``id_col`` and ``defect`` of each defective row; at most one defect a row, equal rows come out each.

    In order: ``empty``, ``truncated`` in its wrapping, ``refusal``, ``copy``, ``language``, ``truncated`` at its end.
    A null output is empty. A row whose question is unknown or null is checked without a question to
    compare with. An answer without an end mark counts as cut off if other answers mostly go on after its last
    characters, so a corpus of a few rows shows little. Answers of a single letter or number are sound in any language.
    Columns other than ``query_id``, ``raw_output`` and the id play no part.
    """
    spark = results.sparkSession
    answers = cut_lineage(distinct_answers(results))
    weights = refusal_weights(answers)
    questions, languages, refusals = catalogue(queries), fit_languages(answers, common_words, queries), Refusals.of(weights)
    shared = spark.sparkContext.broadcast((questions, languages, refusals))
    kind = results.schema[id_col].dataType.simpleString()

    def language_of(question: Question | None, languages: Languages) -> int:
        s = languages.scores(" ".join(question.main)) if question else None
        return 0 if s is None else int(s.argmax())

    def judge(raw: str | None, question: Question | None, language: int) -> tuple[str | None, str | None, bool, bool]:
        """Defect but for refusals and open ends, the text if those are to be looked at, and which of them."""
        _, languages, refusals = shared.value
        state, text = unwrap(raw)
        if state != "text":
            return state, None, False, False
        if _SIMPLE.match(text):
            return None, None, False, False
        own = _QUOTED.sub(" ", text)
        maybe = refusals.refused(text)
        if question and question.copied(text):
            defect = "copy"
        elif languages.differs(own if words_of(own) else text, language):
            defect = "language"
        else:
            defect = "truncated" if _unclosed(text) else None
        opened = defect is None and is_open(text)
        return defect, text if maybe or opened else None, maybe, opened

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, languages, _ = shared.value
        asked: dict = {k: (q, language_of(q, languages)) for k, q in known.items()} if known is not None else {}
        seen: dict = {}
        for batch in batches:
            out = []
            given = [None] * batch.num_rows if known is not None else batch.column("asked").to_pylist()
            for raw, query, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), given):
                if own is not None and query not in asked:
                    if len(asked) > MOST_QUESTIONS:
                        asked.clear()
                    q = _question(*(own[c] for c in _ASKED))
                    asked[query] = q, language_of(q, languages)
                found = seen.get((raw, query))
                if found is None:
                    if len(seen) > REMEMBERED:
                        seen.clear()
                    found = seen[raw, query] = judge(raw, *asked.get(query, (None, 0)))
                out.append(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[k] for x in out], t) for k, t in enumerate((pa.string(), pa.string(), pa.bool_(), pa.bool_())))], names=["id", "defect", "text", "maybe", "opened"])

    rows = results.select(F.col(id_col).alias("id"), F.col("raw_output").alias("raw"), F.col("query_id").cast("string").alias("query"))
    if questions is None:
        texts = queries.groupBy(F.col("query_id").cast("string").alias("query")).agg(F.first(F.struct(*_ASKED)).alias("asked"))
        rows = rows.join(texts, "query", "left").select("id", "raw", "query", "asked")
    else:
        rows = spread(rows)
    checked = cut_lineage(rows.mapInArrow(run, f"id {kind}, defect string, text string, maybe boolean, opened boolean").where("defect is not null or text is not null"))
    # of the texts whose score could be a refusal's, those whose score is one
    maybe = checked.where("maybe")
    refused = refused_texts(maybe.select("text").distinct(), weights).withColumn("refused", F.lit(True))
    looked = maybe.join(refused, "text", "left").withColumn("defect", F.when(F.col("refused"), "refusal").otherwise(F.col("defect")))
    known = cut_lineage(checked.where("not maybe").select("id", "defect", "text", "opened").unionByName(looked.select("id", "defect", "text", "opened")))
    opened = known.where("opened and defect is null")
    # every ending once, however often it is given; the join has the open rows alone
    cut = cut_endings(answers, opened.select("text").distinct())
    found = opened.join(cut, "text", "left_semi").select("id", F.lit("truncated").alias("defect"))
    return known.where("defect is not null").select("id", "defect").unionByName(found).withColumnRenamed("id", id_col)
