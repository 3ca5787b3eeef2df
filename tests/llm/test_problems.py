import math
import os
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from parsewright.llm import boosting, packing, pairs, quality, scans, split, tokenizers, truncation, webspam

CHUNKS = "chunk_id long, text string, unit string, chunk_size int, chunk_overlap int, metadata map<string,string>, piece int, n_units string"
DOCS = "parse_id long, parser string, format string, content string, metadata map<string,string>, id string, kind string"
COMMON = [("en", w) for w in "the of and to in a is was that for with as were by on are from at".split()] + [("de", w) for w in "der die und das ist nicht ein eine wurde im den von".split()] + [("es", w) for w in "el la los de que en se una por con para del".split()]

SENTENCES = [
    "The sample consisted of nurses who worked in the city and were asked about sleep.",
    "We found that the model was accurate for most of the participants in the study.",
    "The items were answered by the parents at home, and the answers were coded by two raters.",
    "In the second wave, the teachers were interviewed about the mood of the class.",
    "It was not clear from the tables which of the predictors were used in the end.",
]


def units(text, unit):
    return len(text) if unit == "char" else len(re.findall(r"[^ \t\r\n]+", text))


def prose(n, seed=0):
    rng = random.Random(seed)
    return " ".join(rng.choice(SENTENCES) for _ in range(n))


# --- 1: splitting ---------------------------------------------------------------------------------------------


def cases():
    rng = random.Random(5)
    words = lambda n: " ".join("".join(rng.choices("abcdé", k=rng.randint(1, 9))) + rng.choice(["", ".", ",", "\n\n"]) for _ in range(n))
    out = [(words(300), "char", 100, 20), (words(300), "token", 40, 7), ("x" * 1000, "char", 90, 10), ("語" * 700 + "。" + "字" * 700, "char", 200, 0), (words(9000), "char", 700, 50), (words(9000), "token", 150, 30), (" \n " + words(50), "token", 10, 0), ("", "char", 5, 0), (None, "char", 5, 0), (" \n" * 400, "token", 3, 1), (" " * 50, "char", 5, 1), ("a b " * 20, "token", 5, None), ("abc " * 30, "char", 10, 30), ("abc", "char", None, 0), ("abc", "char", 0, 0), ("word " * 30, None, 20, -3)]
    return [(i, *row, {"k": str(i)}, 7, "clash") for i, row in enumerate(out)]


@pytest.mark.parametrize("size", [64, 16_384])
def test_split_round_trip(spark, monkeypatch, size):
    monkeypatch.setattr(split, "RANGE", size)
    rows = cases()
    df = spark.createDataFrame([*rows, rows[0]], CHUNKS)
    found: dict = {}
    for r in split.split_oversized(df).orderBy("chunk_id", "piece").collect():
        found.setdefault(r.chunk_id, []).append(r)
    wanted = set()
    for i, text, unit, limit, overlap, meta, *_ in rows:
        unit, overlap = unit or "char", max(0, overlap or 0)
        if text is None or not limit or limit <= 0 or units(text, unit) <= limit + overlap:
            continue
        wanted.add(i)
        overlap = min(overlap, limit - 1)
        pieces = [p.text for p in found[i]]
        assert [p.piece for p in found[i]] == list(range(len(pieces))) and found[i][0].n_pieces == len(pieces) and found[i][0].metadata == meta
        whole = pieces[0]
        for a, b in zip(pieces, pieces[1:]):
            if unit == "char":
                shared = b[:overlap]
            else:
                starts = [m.start() for m in re.finditer(r"[^ \t\r\n]+", b)]
                shared = b[: starts[overlap]] if overlap < len(starts) else b
            assert whole.endswith(shared) and units(shared, unit) == overlap
            whole += b[len(shared) :]
        assert whole == text and all(units(p, unit) <= limit for p in pieces)
    assert set(found) == wanted
    assert {r.chunk_id for r in split.oversized(df).collect()} == wanted
    assert split.split_oversized(df.limit(0)).count() == 0


def test_split_prefers_natural_boundaries(spark):
    df = spark.createDataFrame([(1, prose(12), "char", 300, 0, None, 0, "")], CHUNKS)
    pieces = [r.text for r in split.split_oversized(df).orderBy("piece").collect()]
    assert all(p.rstrip().endswith(".") for p in pieces)


def test_split_files_by_ranges(spark, tmp_path):
    text = "".join(f"Zeile {i} über 語 und 🙂. " + ("\n\n" if i % 7 == 0 else "") for i in range(400))
    path = tmp_path / "big.txt"
    path.write_text(text, encoding="utf-8")
    paths = spark.createDataFrame([(str(path), os.path.getsize(path))], "path string, length long")
    for size in (257, 1 << 20):
        pieces = [r.text for r in split.split_files(spark, paths, 200, 15, range_bytes=size).orderBy("piece").collect()]
        assert pieces[0] + "".join(p[15:] for p in pieces[1:]) == text and max(map(len, pieces)) <= 200


# --- 2: truncation --------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("content", "state"),
    [
        (prose(4), "complete"), (prose(4)[:-20], "cut"), (prose(4) + " The mod", "cut"), ("<?xml version='1.0'?>\n<TEI><body><p>" + prose(2), "cut"), ("<TEI><body><p>" + prose(2) + "</p></body></TEI>", "complete"),
        (prose(3) + "\n\n| a | b |\n|---|---|\n| x | 1 |", "complete"), (prose(3) + "\n\n| a | b |\n|---|---|\n| x | 1", "cut"), (prose(3)[:-9] + " [...]", "cut"), (prose(3) + "\n\n© 2012 The Authors", "open"), (prose(3) + "\n\nPage 3 of 3", "complete"),
        (prose(3)[:-12] + "\n- 12 -", "cut"), ("Doe, J. (2001). On sleep. Journal of Tests 2001; 12: 34–56", "complete"), ("", "complete"), ("   ", "complete"), (prose(3) + " These were impor-", "cut"), ("\\begin{tabular}{ll}\na & b", "cut"),
    ],
)
def test_endings(content, state):
    assert truncation.ending(content)[0] == state


def test_nothing_is_too_far_back_to_be_seen():
    long_table = "<table>" + "<tr><td>a</td></tr>\n" * 3000
    assert truncation.ending(long_table) == ("cut", "markup") and truncation.ending("<!-- " + "so " * 300 + " -->\n<article><p>" + prose(2)) == ("cut", "markup")
    assert not truncation.unreadable(prose(8) + "\n\n" + prose(2)) and truncation.unreadable(prose(8) + "\n\n" + "x#!q " * 300)
    items = "\n".join(f"AB{i} = the area under the curve" for i in range(6))
    assert truncation.ending(items)[0] == "open" and truncation.ending(prose(2) + "\n\nIt was said that the mean = the area under the cur")[0] == "cut"


def test_measures_equal_the_encoded_lengths():
    import html
    import json

    for text in ("", "a & b < c > \"d\"\n\t\\ é 語 🙂\r\ne\n", prose(2)):
        lf, crlf = text.replace("\r\n", "\n"), text.replace("\r\n", "\n").replace("\n", "\r\n")
        size = lambda t: len(t.encode())
        dumped = json.dumps(text, ensure_ascii=False)[1:-1]
        assert truncation.measures(text) == [len(text), size(text), len(text.encode("utf-16-le")) // 2, len(html.escape(text, quote=False)), len(text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace(chr(34), "&quot;")), size(html.escape(text, quote=False)), len(dumped), size(dumped), len(crlf), size(crlf), len(lf), size(lf)]


def test_limits_weigh_in_the_verdict(spark):
    texts = [prose(25, i) for i in range(60)]
    cut = [t[:800] for t in texts[:30]]
    heads = [prose(9, 100 + i) for i in range(2)]
    whole = [(h + " " + "It was so for all of them in the end and for the rest of it as well in every one of them, year by year by year by year.")[:799].rstrip(". ") for h in heads]
    complete = [w + "." * (800 - len(w)) for w in whole]
    rows = [(i, "A", None, t, None, "", "") for i, t in enumerate(cut)] + [(100 + i, "A", None, t, None, "", "") for i, t in enumerate(complete)] + [(200 + i, "B", None, t, None, "", "") for i, t in enumerate(complete)]
    df = spark.createDataFrame(rows, DOCS)
    assert [(r.source, r.measure, r["size"]) for r in truncation.length_limits(df).collect()] == [("A", "characters", 800)]
    found = {r.parse_id: r.reason for r in truncation.find_truncated(df).collect()}
    assert {i for i in found if i < 100} == set(range(30)) and found[100] == found[101] == "limit" and not {200, 201} & set(found)


def test_limits_and_found(spark):
    full = [prose(20, i) for i in range(40)]
    rows = [(i, "A", None, t[:600], None, "x", "y") for i, t in enumerate(full)] + [(100 + i, "B", None, t[: 400 + 31 * i].rpartition(". ")[0] + ".", None, "x", "y") for i, t in enumerate(full)] + [(200, None, None, None, None, "", ""), (201, "A", None, "", None, "", ""), (202, "A", None, " ", None, "", ""), (203, None, None, prose(2), None, "", "")]
    df = spark.createDataFrame(rows, DOCS)
    assert {(r.source, r["size"]) for r in truncation.length_limits(df).where("measure = 'characters'").collect()} == {("A", 600)}
    found = {r.parse_id for r in truncation.find_truncated(df).collect()}
    assert found == set(range(40))
    rates = {r.source: (r.n_rows, r.n_truncated, r.share) for r in truncation.truncation_rates(df).collect()}
    assert rates == {"A": (40, 40, 1.0), "B": (40, 0, 0.0), None: (1, 0, 0.0)}
    assert truncation.find_truncated(df.limit(0)).count() == 0


# --- 3: statistics and kinds ----------------------------------------------------------------------------------


def kinds_table(n=30):
    rng = random.Random(3)
    names = ["sleep duration", "mood reports", "peer relations", "income", "parental education"]
    rows = []
    for i in range(n):
        rows.append((i, "prose", prose(12, i)))
        rows.append((1000 + i, "list", "\n".join(f"- {rng.choice(names)} ({rng.choice(names)})" for _ in range(12))))
        rows.append((2000 + i, "table", "| name | n | M |\n|---|---|---|\n" + "\n".join(f"| {rng.choice(names)} | {rng.randint(1, 999)} | {rng.random():.2f} |" for _ in range(12))))
        rows.append((3000 + i, "junk", "".join(rng.choice("ABCDEFabcdefghijkXYZ0123456789+/") for _ in range(900))))
    return rows


def test_kinds_on_held_out_rows(spark):
    rows = kinds_table()
    common = spark.createDataFrame(COMMON, "lang string, word string")
    df = spark.createDataFrame([(i, "p", "markdown", text, {"lang": "xx"} if i % 2 else None, "a", "b") for i, _, text in rows] + [(9001, "p", None, None, None, "", ""), (9002, "p", None, " \n", None, "", "")], DOCS)
    got = {r.parse_id: r for r in quality.classify(df, common).collect()}
    truth = {i: kind for i, kind, _ in rows}
    assert set(got) == set(truth) and sum(got[i].kind == truth[i] for i in truth) >= 0.97 * len(truth)
    assert all(0 <= r.probability <= 1 for r in got.values())
    assert {r.parse_id for r in quality.find_not_prose(df, common).collect()} == {i for i in got if got[i].kind != "prose"}
    assert quality.classify(df.limit(0), common).count() == 0


def test_markup_is_set_aside():
    lines = quality.to_lines("<TEI><teiHeader>skip</teiHeader><table><row><cell>a</cell><cell>1</cell><cell>2</cell></row></table><list><item>x</item><item>y &amp; z</item></list></TEI>")
    assert [x.strip() for x in lines] == ["a\t1\t2", "x", "y & z"]
    assert quality.cells_of("a;1;2") == ["a", "1", "2"] and quality.cells_of("one two three") == ["one two three"]


def test_boosted_trees_learn_and_calibrate():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 4))
    y = ((x[:, 0] * x[:, 1] > 0).astype(int) + (x[:, 2] > 1)).clip(0, 2)
    model = boosting.BoostedTrees(["a", "b", "c"]).fit(x[:400], y[:400]).calibrate(x[400:], y[400:])
    p = model.probabilities(x[400:])
    assert (p.argmax(1) == y[400:]).mean() > 0.85 and np.allclose(p.sum(1), 1)


# --- 4: pairs -------------------------------------------------------------------------------------------------

QUESTION = "Which population was studied, and how was it recruited?"


@pytest.mark.parametrize(
    ("raw", "state", "text"),
    [
        (None, "empty", ""), ("", "empty", ""), ("<think>x</think> ", "empty", ""), ('{"answer": null}', "empty", ""), ("**Answer:**", "empty", ""), ("```\n```", "empty", ""), ("''", "empty", ""), ("[]", "empty", ""),
        ("<think>so the", "truncated", ""), ('{"reasoning": "it was', "truncated", ""), ("(Reasoning: p (1", "truncated", ""), ("Step 1: a.\nStep 2: b", "truncated", "Step 1: a.\nStep 2: b"),
        ("<think>x</think>B", "text", "B"), ('{"answer": "3"}', "text", "3"), ("Final answer: nurses", "text", "nurses"), ("(Reasoning: p (1) ok.) 7", "text", "7"), ("Step 1: a.\nAnswer: C", "text", "C"), ("**Answer:** x", "text", "x"),
    ],
)
def test_unwrap(raw, state, text):
    assert pairs.unwrap(raw) == (state, text)


def test_refusals_are_learned():
    few = [f"{a} {b}" for a in ("Sorry, I cannot", "I am unable to", "I will not", "As an AI, I can't") for b in ("code this item.", "read the document.", "answer for legal reasons.", "process this request.")]
    assert all(map(pairs.looks_refused, few)) and not pairs.looks_refused("Answering this would breach my guidelines.")
    model = pairs.Refusals(few, SENTENCES)
    declined = ("Sorry, I cannot code this item for legal reasons.", "As a language model, I cannot read the document.", "I'd rather not code this item.", "Answering this would breach my guidelines.", "My policy prohibits coding such content.", "I can't answer this question. " + "I am not able to read such an excerpt and my guidelines do not allow me to judge it. " * 8)
    for text in declined:
        assert model.refused(text), text
    for sound in ("The authors write that they cannot rule out confounding; nurses", "Two participants declined to answer; nurses", "This cannot be determined from the excerpt.", "Sorry to say, the sample is small: nurses", "I dati mancanti sono stati sostituiti prima di ogni analisi.", "nurses"):
        assert not model.refused(sound), sound


def test_copies():
    q = pairs.Question("Population", QUESTION, [f"Read the excerpt.\nTarget Variable: Population\nDescription: {QUESTION}\nAnswer:"])
    for copy in (QUESTION.upper(), "Which  population was studied, and how was it", "Which was studied, and how was it recruited?", f"Population: {QUESTION}", f"Target Variable: Population\nDescription: {QUESTION}"):
        assert q.copied(copy), copy
    for sound in (f"{QUESTION} Nurses", "nurses", "Population: nurses", "older adults who were recruited by mail"):
        assert not q.copied(sound), sound


@pytest.mark.parametrize("most", [20_000, 1])
def test_defects_in_a_table(spark, monkeypatch, most):
    good = [f"The sample consisted of {n} nurses who were recruited at the hospital." for n in range(60)] + ["nurses on rotating shifts"] * 12 + ["the learning rate, the penalty term"] * 12 + ["We asked nurses on rotating shifts who were there.", "the penalty term, the learning rate."] * 3
    spanish = ["La muestra incluyó a los enfermeros que se reclutaron en el hospital de la ciudad."] * 10 + ["Los participantes fueron reclutados por los autores en la ciudad."] * 10
    bad = {900: (None, "empty"), 901: ("The sample consisted of 7 nur", "truncated"), 902: ("I'm sorry, but I can't answer this question.", "refusal"), 903: (QUESTION, "copy"), 904: (spanish[0], "language"), 905: ("文中没有提到。", "language"), 906: ("The scale (“Fragebogen zum Alltag”) was used by the nurses.", None), 907: ("Z", None), 908: ("the learning rate, the penal", "truncated"), 909: ("<think>a</think>" * 20 + "nurses on rotating shifts", None), 910: ("I cannot answer this question, as I am not able to read it. " * 12, "refusal")}
    rows = [(i, "1.1", t) for i, t in enumerate(good + spanish)] + [(i, "1.1", t) for i, (t, _) in bad.items()] + [(950, None, "nurses on rotating shifts"), (951, "?", QUESTION)]
    results = spark.createDataFrame([(*r, "clash", 1.0) for r in rows], "result_id long, query_id string, raw_output string, defect string, ends double")
    questions = spark.createDataFrame([("1.1", "Population", QUESTION, "", "", {"base_prompt": f"Answer. {QUESTION}"}), ("1.2", "Other", "What else?", None, None, None)], "query_id string, label string, description string, description_detailed string, instructions string, prompts struct<base_prompt:string>")
    common = spark.createDataFrame(COMMON, "lang string, word string")
    monkeypatch.setattr(pairs, "MOST_QUESTIONS", most)
    got = {r.result_id: r.defect for r in pairs.find_defects(results, questions, common).collect()}
    assert {i: got.get(i) for i in bad} == {i: d for i, (_, d) in bad.items()}
    assert not set(got) & set(range(len(good))) and all(got.get(len(good) + i) == "language" for i in range(len(spanish))) and 950 not in got and 951 not in got
    assert pairs.find_defects(results.limit(0), questions, common).count() == 0


def test_ends_are_counted_as_by_hand(spark):
    texts = ["the penalty term", "The penalty term.", "penalty, rate, term", "a (penalty) b", "ab", "é語", ""]
    size, key, no, goes_on, ends, last = pairs.end_keys(texts)
    expected = Counter()
    for k, t in enumerate(texts):
        flat = "^" + t.lower()
        for i in range(1, len(flat)):
            if flat[i].isalnum():
                after = flat[i + 1 : i + 2]
                end = after in ("", ".", ")") or after == "," and k == 2
                for n in pairs.ENDING_NGRAMS:
                    if i + 1 >= n:
                        expected[k, n, end, not end and after not in "(,"] += 1
    assert Counter(zip(no.tolist(), size.tolist(), ends.tolist(), goes_on.tolist())) == expected
    apart = {(t[i - n : i].lower(), n) for t in ("^" + x for x in texts) for i in range(2, len(t) + 1) if t[i - 1].isalnum() for n in pairs.ENDING_NGRAMS if i >= n}
    assert len(set(key.tolist())) == len(apart) and last.sum() == sum(min(len(pairs.ENDING_NGRAMS), sum(n <= 1 + max(i for i, c in enumerate("^" + t) if c.isalnum()) for n in pairs.ENDING_NGRAMS)) for t in texts if t)


@pytest.mark.parametrize("bits", [1 << 23, 64])
def test_a_full_filter_changes_nothing(spark, monkeypatch, bits):
    monkeypatch.setattr(pairs, "FILTER_BITS", bits)
    rows = [(f"the learning rate and the penalty term {k}", 1, False) for k in range(40)] + [("the learning ra", 2, False), ("the learning rate and the penalty", 900, False), ("xylophon", 1, False)]
    answers = spark.createDataFrame(rows, "text string, n long, refused boolean")
    assert {r.text for r in pairs.cut_endings(answers, answers.select("text").where("text not like '%term%'")).collect()} == {"the learning ra"}


def test_all_questions_teach_the_language(spark, monkeypatch):
    answers = spark.createDataFrame([("the nurses were recruited at the hospital", 3, False)], "text string, n long, refused boolean")
    texts = [f"{a} {b}" for a in ("vexing", "quixotic", "zephyr", "jumbled") for b in ("population", "sample", "wave")]
    questions = spark.createDataFrame([(t, f"What about {t}?") for t in texts], "label string, description string").repartition(3)
    common = spark.createDataFrame(COMMON, "lang string, word string")
    monkeypatch.setattr(pairs, "MOST_QUESTIONS", 1)
    few = pairs.fit_languages(answers, common, questions)
    assert np.array_equal(few.logp, pairs.fit_languages(answers, common, questions.coalesce(1)).logp)
    assert np.array_equal(few.logp, pairs.fit_languages(answers.limit(1), common, questions.orderBy("label")).logp)
    none = pairs.fit_languages(answers, common, questions.limit(0))
    cells = pairs.ngram_cells(texts)[0]
    assert (few.logp[0, cells] > none.logp[0, cells]).mean() > 0.9
    # however many there are, they weigh no more than a language's answers may
    monkeypatch.setattr(pairs, "MOST_WEIGHT", 10)
    assert np.abs(np.exp(pairs.fit_languages(answers, common, questions).logp[0]).sum() - 1) < 1e-3


def test_all_answers_teach_refusals(spark):
    sound = [f"The authors report value {k} of scale {k % 97}." for k in range(8_500)]
    declined = [f"I cannot answer item {k}." for k in range(2_200)]
    own = [f"In my study {k} nurses took part." for k in range(20)]
    rows = [(t, 1, False) for t in sound + own] + [(t, 1, True) for t in declined]
    got = {r.key: r.weight for r in pairs.refusal_weights(spark.createDataFrame(rows, "text string, n long, refused boolean").repartition(3)).collect()}
    yes, no = (Counter(f for t in texts for f in pairs.refusal_features(t)) for texts in ((*declined, *pairs._SEED_REFUSALS), (*sound, *pairs._SEED_ANSWERS)))
    a, b = len(declined) + len(pairs._SEED_REFUSALS), len(sound) + len(pairs._SEED_ANSWERS)
    every = {f for t, *_ in rows for f in pairs.refusal_features(t)} | set(yes) | set(no)
    expected = {pairs.Keys()[f]: round(min(3.0, max(-3.0, math.log(yes[f] / (a + 1) + pairs.RARE) - math.log(no[f] / (b + 1) + pairs.RARE))) * pairs.UNIT) for f in every}
    assert set(got) == set(expected) and all(abs(got[k] - w) <= 1 for k, w in expected.items())
    assert len(expected) == len(every) and got[pairs.Keys()["my study"]] == 0


@pytest.mark.parametrize("cells", [1 << 20, 1])
def test_shared_cells_change_nothing(spark, monkeypatch, cells):
    sound = ["The authors report that nurses took part.", "Nurses on the wards.", "The scale was read aloud by two raters.", "Two parents declined to answer."]
    declined = ["I'm sorry, but I cannot answer this question.", "I am unable to code this item.", "I won't read this document for policy reasons."]
    exact = pairs.Refusals(declined, sound)
    monkeypatch.setattr(pairs, "ODDS_CELLS", cells)
    rows = [(i, "1.1", t) for i, t in enumerate(sound * 2 + declined * 2 + ["I am unable to read this question.", None, "B"])]
    results = spark.createDataFrame(rows, "result_id long, query_id string, raw_output string")
    questions = spark.createDataFrame([("1.1", "Population", QUESTION, "", "", None)], "query_id string, label string, description string, description_detailed string, instructions string, prompts struct<base_prompt:string>")
    got = pairs.find_defects(results, questions, spark.createDataFrame(COMMON, "lang string, word string")).collect()
    assert {r.result_id for r in got if r.defect == "refusal"} == {i for i, _, t in rows if t and exact.refused(t)} == {8, 9, 10, 11, 12, 13, 14}
    assert {r.result_id: r.defect for r in got if r.defect != "refusal"} == {15: "empty"}


# --- 5: scans -------------------------------------------------------------------------------------------------


def wrap(text, width=60):
    lines, cur = [], ""
    for w in text.split():
        if cur and len(cur) + len(w) + 1 > width:
            lines.append(cur)
            cur = w
        else:
            cur = f"{cur} {w}" if cur else w
    return [*lines, cur]


def scanned_table(spark):
    clean = [(i, "p", None, "\n".join(wrap(prose(15, i))), None, "", "") for i in range(20)]
    body = wrap(prose(10, 99))
    body[3] = body[3].replace("the", "tbe", 1) if "the" in body[3] else body[3] + " tbe"
    page = [*body[:5], "– 12 –", "DOE ET AL.", "The sample con-", "sisted of nurses who worked in the city and were asked about sleep.", *body[5:9], "– 13 –", "DOE ET AL.", *body[9:]]
    expected = {(4, "misread"), (6, "page_number"), (7, "running"), (8, "split_word"), (14, "page_number"), (15, "running")}
    rows = [*clean, (50, "p", None, "\n".join(page), None, "", ""), (51, "p", None, None, None, "", ""), (52, "p", None, "", None, "", ""), (53, "p", "tei_xml", "<TEI><p>1</p></TEI>", None, "", "")]
    return spark.createDataFrame(rows, DOCS), expected, page


@pytest.mark.parametrize("bound", [10_000, 0])
def test_noise_by_broadcast_and_by_join(spark, bound):
    df, expected, _ = scanned_table(spark)
    got = {(r.parse_id, r.line_no, r.kind) for r in scans.find_noise(df, most_broadcast=bound).collect()}
    assert got == {(50, *e) for e in expected}


def test_repair(spark):
    df, _, page = scanned_table(spark)
    text = {r.parse_id: r.text for r in scans.repair_texts(df).collect()}
    assert set(text) == {*range(20), 50, 52, 53} and text[52] == ""
    assert "consisted of nurses" in text[50] and "tbe" not in text[50] and "DOE" not in text[50] and "– 12 –" not in text[50]
    assert scans.find_noise(df.limit(0)).count() == 0 and scans.repair_texts(df.limit(0)).count() == 0


# --- 6 and 7: tokens ------------------------------------------------------------------------------------------

TEXTS = ["", None, " ", "Hello, world!  It's  fine.\n\n", "<|endoftext|> a", "naïve 語語語 🙂🙂", "x" * 500, "the" * 300, "\u200b\u202e", "a\r\n\tb 'll'LL don't", "12345678901234567890", "=" * 77 + "\n" + " " * 33 + "e"]


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    data = tokenizers.tokenizer_file("byte_bpe_50k.tiktoken")[1]
    return tiktoken.Encoding("t", pat_str=tokenizers.PATTERN, mergeable_ranks=tokenizers.read_ranks(data), special_tokens={}), tokenizers.PrefixBPE(tokenizers.read_ranks(data))


def test_encoding_equals_the_library(spark, reference):
    known, _ = reference
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "a", "x"), (0, "", "x")], "doc_id long, text string, ids string")
    rows = tokenizers.encode_texts(df).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in rows) == Counter([(i, tuple(known.encode_ordinary(t or ""))) for i, t in enumerate(TEXTS)] + [(None, tuple(known.encode_ordinary("a"))), (0, ())])
    assert tokenizers.encode_texts(df.limit(0)).count() == 0


def test_appends_and_edits_are_exact(reference):
    known, bpe = reference
    rng = random.Random(2)
    alphabet = "ab cé'lsr1 \n\t語."
    text, state = "", tokenizers.EncodedText(bpe)
    for _ in range(150):
        new = "".join(rng.choices(alphabet, k=rng.randint(0, 6)))
        if rng.random() < 0.5:
            text += new
            state.append(new)
        else:
            a = rng.randint(0, len(text))
            b = min(len(text), a + rng.randint(0, 5))
            text = text[:a] + new + text[b:]
            state.edit(a, b, new)
        assert state.text == text and state.ids == known.encode_ordinary(text)


def test_packing(spark, reference):
    known, _ = reference
    rng = random.Random(4)
    texts = [" word" * rng.randint(0, 60) for _ in range(400)] + [None, "", " word" * 700, " word" * 128]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(0, texts[0], 1)], "doc_id long, text string, container int")
    budgets = spark.createDataFrame([(1, "byte_bpe_50k", 64), (2, "byte_bpe_50k", 1000), (3, None, 5), (4, "byte_bpe_50k", 0)], "budget_id int, tokenizer string, capacity int")
    rows = packing.pack_texts(df, budgets).collect()
    sizes = Counter()
    for i, t in [*enumerate(texts), (0, texts[0])]:
        sizes[i] += len(known.encode_ordinary(t or ""))
    for budget, capacity in ((1, 64), (2, 1000)):
        own = [r for r in rows if r.budget_id == budget]
        total, used = Counter(), Counter()
        for r in own:
            total[r.doc_id] += r["size"]
            used[r.container] += r["size"]
        assert total == sizes and {r.doc_id for r in own} == set(range(len(texts))) and max(used.values()) <= capacity
        assert len(used) <= -(-sum(sizes.values()) // capacity) * 1.02 + 1
        assert all(r.n_pieces == 1 for r in own if sizes[r.doc_id] <= capacity)
    assert {r.budget_id for r in rows} == {1, 2}
    assert packing.pack_texts(df.limit(0), budgets).count() == 0 and packing.pack_texts(df, budgets.limit(0)).count() == 0


def test_histogram_packing_is_tight():
    rng = random.Random(6)
    histogram = Counter(min(512, int(rng.lognormvariate(4.5, 0.8)) + 1) for _ in range(20_000))
    places = packing.pack_histogram(dict(histogram), 512)
    load = Counter()
    for length, n in histogram.items():
        firsts, targets = places.runs[length]
        for rank in range(n):
            k = np.searchsorted(firsts, rank, "right") - 1
            load[int(targets[k] + rank - firsts[k])] += length
    assert max(load.values()) <= 512 and len(load) == places.containers and sum(load.values()) / (512 * len(load)) > 0.99


# --- 8: spam --------------------------------------------------------------------------------------------------


def test_spam_pages(spark):
    good = [(i, prose(10, i)) for i in range(60)]
    legit = [(100, "References\n\n" + "\n".join(f"Doe, J. ({1990 + i}). On the sleep of nurses. Journal of Tests, {i}(2), 1–{i + 9}." for i in range(12))), (101, prose(12) + "\n\nhttps://a.example/x\nhttps://a.example/y")]
    spam = [(200, "cheap shoes, best shoes, cheap shoes online, buy shoes, shoes discount, cheap shoes, best shoes online, buy cheap shoes, shoes, shoes, " * 3), (201, "\n".join(f"cheap shoes :: https://shop{i}.example/cheap-shoes" for i in range(9))), (202, " ".join(["#CheapShoes", "#BestShoes", "#BuyShoes"] * 8)), (203, prose(1) + "\n" + "\n".join(f"BUY shoes | {i}.99 | in stock | running shoes" for i in range(12)))]
    odd = [(300, None), (301, ""), (302, " \n ")]
    df = spark.createDataFrame([(i, t, "en", 1) for i, t in good + legit + spam + odd] + [(200, spam[0][1], None, 1)], "doc_id long, text string, lang string, spam int")
    assert Counter(r.doc_id for r in webspam.find_spam(df).collect()) == Counter({200: 2, 201: 1, 202: 1, 203: 1})
    assert webspam.find_spam(df.limit(0)).count() == 0
    assert webspam.find_spam(df, lang_col=None).count() == 5


def test_queries_are_registered():
    import __spark_entry__ as e

    assert {"p1_found", "p2_found", "p3_found", "p4_found", "p5_found", "p6_ids", "p7_containers", "p8_found"} <= set(e.queries())


def test_rates_of_the_test_tables_are_whole(spark):
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables here")
    import __spark_entry__ as e

    ids = e.queries()["p6_ids"](spark, folder)
    assert ids.count() == spark.read.parquet(f"{folder}/documents.parquet").count() and ids.where(F.size("ids") < 0).count() == 0


def test_the_cost_of_splitting_grows_with_the_text(spark):
    import time

    def cost(n):
        df = spark.createDataFrame([(1, prose(8, 1) * n, "char", 1000, 100, None, 0, "")], CHUNKS)
        began = time.perf_counter()
        assert split.split_oversized(df).count() > n / 3
        return time.perf_counter() - began

    cost(500)
    assert cost(8000) < 8 * max(cost(2000), 1)


def test_a_cutter_holds_only_the_open_ranges():
    cutter = split.Cutter(100_000, 250, 20, "char")
    most = 0
    for no in range(1000):
        cutter.add(no, no * 100, 100, [33, 66], [1, 4], no == 999)
        most = max(most, len(cutter.ranges), len(cutter.at))
    assert most <= 20 and not cutter.ranges
