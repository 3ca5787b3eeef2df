import re
import string

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parsewright.functions import text as T
from parsewright.operators import chunking as K


def column(spark, values, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in rows.select("i", make(F.col("v")).alias("x")).orderBy("i").collect()]


CASES = ["", " ", "a\r\nb\rc", "x\t\ty", "\n\n\n a\n\n\nb", "a b   c", "<p>one</p> two", None, "  tail   end  ", "é ñ ü", "Step 2: go", "\u2003a\n\xa0 \u3000b\n\x0bc\x85"]


def test_sanitize(spark):
    assert column(spark, CASES, T.sanitize) == ["", "", "a\nb\nc", "x y", "a\nb", CASES[5], "<p>one</p> two", None, CASES[8].strip(), "é ñ ü", "Step 2: go", "a\nb\nc"]
    assert column(spark, CASES, lambda c: T.sanitize(c, True))[6] == "one two"


def test_reasoning_marks(spark):
    cases = {"<think>x</think> A": "A", "<THINK>x\ny</THINK>B": "B", "(Reasoning: because) C": "C", "<!-- steps 1 2 -->D": "D", "Step 2: E": "E", "<think>x</reason>F": "<think>x</reason>F"}
    assert column(spark, list(cases), T.without_reasoning) == list(cases.values())


def test_numbers(spark):
    cases = {"1": 1.0, " -2.5e3 ": -2500.0, ".5": 0.5, "1d": None, "1_000": None, "": None, "x": None, None: None}
    assert column(spark, list(cases), T.to_number) == list(cases.values())


def test_answers(spark):
    cases = {"<b>a)</b> yes": "A)", "  --B. second": "B.", "": "", "é1 x": "É1", "Z": "Z", "<i></i>": "", "(c) or (d)?": "C)"}
    assert column(spark, list(cases), T.first_answer) == list(cases.values())


def test_fenced_json(spark):
    assert column(spark, ["a ```json\n[1]\n``` b", "x [2, 3] y", "none"], T.fenced_json) == ["[1]", "[2, 3]", None]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet=string.ascii_letters + " .!?\n é-", max_size=80), min_size=1, max_size=20))
def test_words_sentences_and_packing(spark, texts):
    assert column(spark, texts, T.tokens) == [t.split() for t in texts]
    assert column(spark, texts, T.plain) == [re.sub(r"\s+", " ", t.lower().translate(str.maketrans("", "", string.punctuation))).strip() for t in texts]
    for text, packs in zip(texts, column(spark, texts, lambda c: K.pack_sentences(c, 30))):
        parts = [p for p in re.split(r"(?<=[.!?])\s+", text) if p]
        assert " ".join(packs) == " ".join(parts)
        assert all(len(p) <= 30 or p in parts for p in packs)
        assert all(len(a) + 1 + len(b.split(" ")[0]) > 0 and not any(len(a) + 1 + len(q) <= 30 and b.startswith(q) and (b == q or b[len(q)] == " ") for q in parts) for a, b in zip(packs, packs[1:]))
