"""Text functions as column expressions: no Python worker, so that they stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as Unicode has it, written out: patterns with Java's flag (?U) look every character up.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_WS = r"[\s\x0B\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
# ASCII punctuation.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# Removals of reasoning marks from model output, in order.
REASONING_MARKS = (
    r"(?is)<(think|reason|thought)>.*?</\1>",
    r"(?is)\((thinking|reasoning|step-by-step reasoning):.*?\)",
    r"(?is)<!--\s*(think|reasoning|steps).*?-->",
    r"(?imd)^(Thoughts?:|Reasoning:|Step\s*\d*:|Internal monologue:|Chain-of-thought:)\s*",
)
NUMBER = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(text, F.lit(BLANKS))


def sanitize(text: Column, remove_tags: bool = False) -> Column:
    """Line ends made LF, tags blanked if asked, indents and blank lines closed up, runs of blanks made one, ends stripped."""
    out = F.regexp_replace(text, r"\r\n?", "\n")
    if remove_tags:
        out = F.regexp_replace(out, r"<[^>]+>", " ")
    out = F.regexp_replace(out, rf"\n{_WS}+", "\n")
    out = F.regexp_replace(out, r"[\t ]+", " ")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    return strip(out)


def tokens(text: Column) -> Column:
    """Words parted by white space; an empty array for blank text."""
    return F.filter(F.split(text, rf"{_WS}+"), lambda x: x != "")


def sentences(text: Column) -> Column:
    """Parts that end in . ! or ?, without the white space after them."""
    return F.split(text, rf"(?<=[.!?]){_WS}+")


def code_point_sum(text: Column) -> Column:
    """Sum of the code points of a text's characters."""
    return F.aggregate(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), F.ascii), F.lit(0).cast("bigint"), lambda a, x: a + x)


def checksum_features(text: Column) -> Column:
    """The deterministic offline embedding: stripped length, words, code point sum modulo 10,000."""
    return F.array(F.length(strip(text)).cast("float"), F.size(tokens(text)).cast("float"), (code_point_sum(text) % 10000).cast("float"))


def without_reasoning(text: Column) -> Column:
    """Model output without the reasoning marks, stripped."""
    for pattern in REASONING_MARKS:
        text = F.regexp_replace(text, pattern, "")
    return strip(text)


def first_answer(text: Column) -> Column:
    """The first word of an answer in upper case: tags and signs around are dropped; empty if nothing is left."""
    out = F.regexp_replace(strip(text), r"<[^>]*>", "")
    out = F.regexp_replace(F.regexp_replace(out, r"(?U)^\W+", ""), r"(?U)\W+$", "")
    return F.upper(F.coalesce(F.try_element_at(tokens(out), F.lit(1)), F.lit("")))


def word_characters(text: Column) -> Column:
    """Lower case, word characters only."""
    return F.regexp_replace(F.lower(strip(text)), r"(?U)\W+", "")


def plain(text: Column) -> Column:
    """Lower case without ASCII punctuation, white space made single blanks."""
    return strip(F.regexp_replace(F.translate(F.lower(text), PUNCTUATION, ""), rf"{_WS}+", " "))


def to_number(text: Column) -> Column:
    """The double that a text spells; null where it spells none (also for forms such as ``1d``)."""
    return F.when(text.rlike(NUMBER), strip(text).try_cast("double"))


def html_escape(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def leading_number(name: Column) -> Column:
    """Leading digits of a name, else the name."""
    digits = F.regexp_extract(name, r"^(\d+)", 1)
    return F.when(digits != "", digits).otherwise(name)


def natural_key(dotted: Column) -> Column:
    """Sort key of dotted numbers, 2.10 after 2.9."""
    return F.transform(F.split(dotted, r"\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))


def fenced_json(text: Column) -> Column:
    """What a fenced JSON block holds, else the text from the first [ to the last ], else null."""
    fenced = strip(F.regexp_extract(text, r"(?s)```json(.*?)```", 1))
    bare = F.regexp_extract(text, r"(?s)\[.*\]", 0)
    return F.when(fenced != "", fenced).when(bare != "", bare)
