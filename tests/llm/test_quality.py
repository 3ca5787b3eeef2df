"""Statistics against plain counting, and a fit that never sees the rows that judge it."""

import numpy as np

from parsewright.llm import quality

TEXT = "The sample – of nurses – was small (n = 12).\r\nIt's  self-report; Ärzte said so!\n* * * * *\n| a | b | 1 |\nqwrtzp xxxxx"
COMMON = {"en": frozenset(["the", "of", "was"]), "de": frozenset(["was", "der"])}


def stats(text, language=None):
    return dict(zip(quality.FEATURES, quality.statistics(text, None, language, quality.languages_of(COMMON), np.zeros(quality.PAIRS))))


def test_statistics_equal_plain_counting():
    s = stats(TEXT)
    lines = [x for x in TEXT.replace("\r\n", "\n").split("\n")]
    words = ["the", "sample", "of", "nurses", "was", "small", "n", "it's", "self-report", "ärzte", "said", "so", "a", "b", "qwrtzp", "xxxxx"]
    solid = "".join("".join(lines).split())
    assert s["word_count"] == len(words) and s["mean_word_length"] == sum(map(len, words)) / len(words)
    assert s["symbol_ratio"] == sum(not (c.isalnum() or c.isspace()) for c in solid) / len(solid)
    ended = [x for x in lines if x.rstrip()[-1] in ".!"]
    assert s["punctuated_lines"] == sum(len("".join(x.split())) for x in ended) / len(solid)
    assert s["common_words"] == 3 / len(words) and stats(TEXT, "de")["common_words"] == 3 / len(words) and stats("was der was der was", "de_AT")["common_words"] == 1
    assert s["letter_share"] == sum(c.isalpha() for c in solid) / len(solid) and s["odd_words"] == 2 / len(words)
    assert s["repeated_symbols"] == len("* * * * *") / len(solid) and stats("�� a")["repeated_symbols"] == 2 / 3


def test_a_plain_letter_is_coded_by_its_base():
    assert quality.letter_codes("aZéÉÿ÷語 1").tolist() == [1, 26, 5, 5, 25, 27, 0, 0, 0]


def test_rows_that_judge_are_never_fitted(monkeypatch):
    (x_own, _), (x_test, _) = quality.hand_checked()
    assert not {tuple(r) for r in x_own} & {tuple(r) for r in x_test}
    fitted, tested = [], []
    monkeypatch.setattr(quality.BoostedTrees, "fit", lambda self, x, y: fitted.append(x) or self)
    monkeypatch.setattr(quality.BoostedTrees, "calibrate", lambda self, x, y: tested.append(x) or self)
    rng = np.random.default_rng(0)
    y = np.sort(rng.integers(0, 4, 300))
    x = rng.random((300, len(quality.FEATURES)))
    _, held = quality._fit(x, y)
    rows = lambda a: {tuple(r) for r in a}
    assert held.sum() >= 50 and not rows(fitted[0]) & rows(tested[0]) and not rows(fitted[0]) & rows(x[held]) and len(fitted[0]) == 300 - held.sum() + len(x_own)


def test_calibration_is_reported(spark):
    import os

    import pytest

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables here")
    import __spark_entry__ as e

    rows = {(r.rows, r.model): r for r in e.queries()["p3_calibration"](spark, "/root/testdata/sf0.001").collect()}
    assert rows["hand_checked", "trees"].accuracy >= 0.8 and rows["hand_checked", "trees"].calibration_error <= 0.2
    assert rows["hand_checked", "rules"].decided < rows["hand_checked", "rules"].n


def test_the_cost_grows_with_the_text():
    import time

    def cost(n):
        text = "The sample consisted of nurses, and they were asked about sleep.\n" * n
        began = time.perf_counter()
        stats(text)
        return time.perf_counter() - began

    cost(100)
    assert min(cost(8000) for _ in range(2)) < 8 * min(cost(2000) for _ in range(2))
