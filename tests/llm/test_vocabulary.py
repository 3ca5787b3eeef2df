"""Pieces of words at line ends are no words of the vocabulary by which endings are judged."""

from parsewright.llm.corpus import count_words
from parsewright.llm.truncation import find_truncated


def test_words_at_line_edges_are_told_apart(spark):
    df = spark.createDataFrame([(1, "the tes\nting of tests in it\nend"), (2, None), (3, "")], "id int, t string")
    got = {r.word: (r.n, r.n_inside) for r in count_words(df, "t").collect()}
    assert got == {"the": (1, 0), "tes": (1, 0), "ting": (1, 0), "of": (1, 1), "tests": (1, 1), "in": (1, 1), "it": (1, 0)}


def test_pieces_at_line_ends_are_not_known(spark):
    texts = [f"We gave {k} tests to all of them in the first year and the tests had to be taken again.\nSo the neuropsychological tes\nting went on, and vitamin D was given.\n" for k in range(90)]
    ends = ["# Results\n\n1. Neuropsychological tes", "# Results\n\n1. Neuropsychological tests", "# Results\n\n1. Vitamin D", "y = a + t"]
    df = spark.createDataFrame([(i, t, "p") for i, t in enumerate([*texts, *ends])], "parse_id int, content string, parser string")
    assert {r.parse_id: r.reason for r in find_truncated(df).collect() if r.parse_id >= 90} == {90: "word"}
