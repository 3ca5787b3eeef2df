"""Noise of scanned pages: no language is needed, nothing is missed by the index, and cost grows with the text."""

import random
import time
from difflib import SequenceMatcher

import pytest

from parsewright.llm import scans

ITALIAN = "Il campione comprendeva gli insegnanti delle scuole elementari e ogni persona ha dato il proprio consenso prima della prova".split()


def words(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choices("abcdefghilmnoprstuv", k=rng.randint(2, 9))) for _ in range(n)]


def test_pages_in_any_language_are_looked_at(spark):
    lines = []
    for k in range(4):
        lines += [" ".join(ITALIAN[i:] + ITALIAN[:i]) for i in range(3)] + ["il cam-", "pione comprendeva gli insegnanti della scuola", f"- {k + 11} -", "ROSSI ET AL."]
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, "a\n- 3 -"), (3, None), (4, "\n \n")], "parse_id int, content string")
    got = {(r.line_no, r.kind) for r in scans.find_noise(df).where("parse_id = 1").collect()}
    assert got == {(7 * k + n, kind) for k in range(4) for n, kind in ((4, "split_word"), (6, "page_number"), (7, "running"))}


def test_a_garbled_paragraph_hides_itself_alone():
    noisy = ["the sample con-", "sisted of nurses and of teachers in the city", "", "- 12 -"]
    garbled = ["", "x#q! vb$$ trk& (( zz ~~ ##" * 8, "- 13 -", ""]
    assert scans.noise_of("\n".join(noisy + garbled), {}) == scans.noise_of("\n".join([*noisy, ""]), {}) == [(1, "split_word"), (4, "page_number")]


@pytest.mark.parametrize("few", [0, 10_000])
def test_repeats_equal_brute_force(monkeypatch, few):
    monkeypatch.setattr(scans, "FEW_LINES", few)
    rng = random.Random(3)
    keys = ["".join(words(rng.randint(1, 6), i)) for i in range(150)]
    keys += ["".join(c for c in k if rng.random() > 0.06) for k in keys[:60]] + ["aaaaaaaaaa", "aaaaaaaaa", "abcdefgh", "abcdefg", "rnodelsofmood", "modelsofmood"]
    repeats = scans.Repeats(keys)
    alike = lambda a, b: len(a) >= 8 and len(b) >= 8 and abs(len(a) - len(b)) <= 2 and SequenceMatcher(None, a, b, autojunk=False).ratio() >= scans.SAME_LINE
    for i, k in enumerate(keys):
        assert repeats.repeated(k) == (keys.count(k) > 1 or any(alike(k, x) for j, x in enumerate(keys) if j != i)), k


def test_a_misread_title_is_found_as_a_header():
    title = "modelsofmoodinnursesonrotatingshifts"
    assert scans._is_prefix("rnodelsofmoodinnursesonrotating", title, scans._grams(title)) and not scans._is_prefix("predictorsofsleepinteachers", title, scans._grams(title))


def test_the_cost_grows_with_the_pages():
    vocabulary = words(3000)

    def cost(pages):
        rng = random.Random(2)
        lines = [x for k in range(pages) for x in (f"- {k + 1} -", "DOE ET AL.", *(" ".join(rng.choices(vocabulary, k=10)) for _ in range(20)))]
        began = time.perf_counter()
        found = scans.page_lines(lines)
        assert len(found[0]) == len(found[1]) == pages
        return time.perf_counter() - began

    assert cost(800) < 8 * max(cost(200), 0.05)
