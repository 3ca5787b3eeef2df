"""The perplexity under the prose model decides which pages can be spam at all."""

import random
from collections import Counter

import numpy as np

from parsewright.llm import webspam

WORDS = [a + b for a in "sleep mood model wave table parent city score sample rater school report answer".split() for b in ("ing", "ers", "less", "ward", "ship", "ment")]
JOINTS = "of the in a by with on from and for".split()


def sentence(rng, numbers):
    words = rng.sample(WORDS, 12)
    parts = (f"{rng.choice(JOINTS)} {words[2 * k]} " + (f"({rng.randint(1, 99)})" if rng.random() < numbers else words[2 * k + 1]) for k in range(1, rng.randint(3, 6)))
    return " ".join(["The", words[0], *parts]) + "."


def prose(n, seed):
    rng = random.Random(seed)
    numbers = rng.random() ** 3  # pages differ in how many they hold
    return " ".join(sentence(rng, numbers) for _ in range(n))


def table(spark):
    good = [(i, prose(8, i)) for i in range(120)]
    links = "\n".join(f"https://archive{i}.example/" + "nurses/sleep/reports/of/the/samples/" * 50 for i in range(1))
    spam = [(200 + i, "\n".join(f"https://shop{i}{k}.example/cheap" for k in range(9))) for i in range(3)]
    return spark.createDataFrame([*good, (300, prose(40, 300) + "\n" + links), *spam], "doc_id long, text string")


def test_pages_like_prose_are_no_spam_whatever_they_hold(spark):
    df = table(spark)
    model = webspam.fit_prose_model(df, lang_col=None)
    found = lambda: {r.doc_id for r in webspam.score_pages(df, model).where("spam").collect()}
    assert found() == {200, 201, 202}
    model.high[:] = -99.0  # without the score, that is with every page taken for abnormal
    assert found() == {200, 201, 202, 300}


def test_pages_are_scored_alike_in_any_block(monkeypatch):
    texts = [prose(5, 1), "", " \n\n ", "a - b\nc d e f | 12.50 |\n#x #y https://a.example", "データ分析。科学研究。", "x" * 5000 + "\n" + prose(3, 2), "\r\nJ. Doe (2001). On sleep. Journal of Tests 12: 3-9"]
    words = ["the", "of", "and"]
    model = webspam.ClassModel.fit(words, np.ones((webspam.NAMED + 3,) * 2), np.arange(36.0).reshape(9, 4))

    def run(size):
        monkeypatch.setattr(webspam, "BLOCK_CHARS", size)
        lexer = webspam.Lexer(words)
        out = []
        for block in webspam.in_blocks(texts):
            t = webspam.Tokens.of(block, lexer)
            stats = webspam.loose_text(t, np.ones(t.n_pages, bool))
            out.append(np.column_stack([model.scores(t), *stats.values()]))
        return np.concatenate(out)

    assert np.allclose(run(10), run(1 << 20))


def test_the_cost_of_a_page_grows_in_proportion():
    import time

    lexer = webspam.Lexer(["the"])
    model = webspam.ClassModel.fit(["the"], np.ones((webspam.NAMED + 1,) * 2), np.ones((7, 2)))

    def cost(n):
        text = prose(n, 1)
        began = time.perf_counter()
        t = webspam.Tokens.of([text], lexer)
        model.scores(t), webspam.loose_text(t, np.ones(1, bool))
        return time.perf_counter() - began

    cost(500)
    assert min(cost(20_000) for _ in range(3)) < 8 * min(cost(5_000) for _ in range(3))


def test_a_table_of_one_page_and_of_none(spark):
    one = spark.createDataFrame([(1, prose(3, 1), None, 2)], "doc_id long, text string, lang string, spam int")
    assert webspam.find_spam(one).count() == 0 and webspam.find_spam(one.limit(0)).count() == 0


def test_the_model_is_fitted_on_all_pages(spark):
    texts = [prose(2, i) + (" Of cats." if i % 3 else " #tag") for i in range(5_000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    model = webspam.fit_prose_model(df, lang_col=None)
    words = Counter(w for t in texts for w in webspam._TOKEN.findall(t.lower()) if len(w) <= webspam.MAX_LETTERS and w[0].isalpha())
    assert model.function_words == sorted(sorted(words, key=lambda w: (-words[w], w))[: webspam.N_FUNCTION_WORDS])
    t = webspam.Tokens.of(texts, webspam.Lexer(model.function_words))
    sentence = t.sentences()
    counts = []
    for (h, s, unit), shape in zip((t.bigrams(), t.skeleton()), (model.classes.logp.shape, model.words.logp.shape)):
        counts.append(np.zeros(shape))
        np.add.at(counts[-1], (h[sentence[unit]], s[sentence[unit]]), 1)
    expected = webspam.ClassModel.fit(model.function_words, *counts)
    assert all(np.array_equal(getattr(model, k).logp, getattr(expected, k).logp) for k in ("classes", "words", "shares"))
    stats = webspam.loose_text(t, np.zeros(len(texts), bool))
    prose_scores = expected.scores(t)[stats["sentences"] > webspam.PROSE_SHARE * stats["n"]]
    assert len(prose_scores) > 4_000 and np.allclose([model.low, model.high], np.quantile(prose_scores, [webspam.TAIL, 1 - webspam.TAIL], axis=0), rtol=1e-12, atol=0)
    # one scan for both gives the same
    rows = lambda scores: sorted(map(tuple, scores.collect()))
    assert rows(webspam.score_all(df, lang_col=None)) == rows(webspam.score_pages(df, model))


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(1)
    x = np.column_stack([rng.normal(size=999), rng.integers(-2, 2, 999) * 1.0, np.zeros(999)])
    at = (0.0, 0.04, 0.5, 0.96, 1.0)
    df = spark.createDataFrame(x.tolist(), "a double, b double, c double")
    assert np.array_equal(webspam.exact_quantiles(df, ("a", "b", "c"), at), np.quantile(x, at, axis=0))
    assert np.array_equal(webspam.exact_quantiles(df.limit(1), ("a",), at), np.full((5, 1), df.first().a)) and webspam.exact_quantiles(df.limit(0), ("a",), at) is None


def test_links_and_words_are_told_apart():
    text = "word http://a.b www.x www. hat's don't w h2o -- a@b\n中文 été 5% #tag <b>x</b> end.)  Way"
    assert webspam._TOKEN.findall(text) == ["word", "http://a.b", "www.x", "www", ".", "hat's", "don't", "w", "h2o", "-", "-", "a@b", "\n", "中", "文", "été", "5%", "#tag", "<b>", "x", "</b>", "end", ".)", "Way"]


def test_packed_pages_keep_their_classes(monkeypatch):
    texts = [prose(3, 1), "", "a - b\nc d | 12.50 |\n#x https://a.example", prose(2, 2) + "\n中文。", ""]
    t = webspam.Tokens.of(texts, webspam.Lexer(["the", "of"]))
    for size in (1, 1 << 20):
        monkeypatch.setattr(webspam, "BLOCK_CHARS", size)
        for skip in (0, 2):
            parts = list(webspam.Tokens.unpacked(t.packed().slice(skip)))
            kept, unit = t.page >= skip, t.unit_page >= skip
            assert sum(x.n_pages for x in parts) == len(texts) - skip and len(parts) == (1 if size > 1 else len(texts) - skip)
            assert np.concatenate([x.cls for x in parts]).tolist() == t.cls[kept].tolist()
            assert np.concatenate([x.sentences() for x in parts]).tolist() == t.sentences()[unit].tolist()
            assert sum(([len(h) for h, _, _ in (x.bigrams(),)] for x in parts), []) and sum(x.n_units for x in parts) == unit.sum()
            assert list(webspam.Tokens.unpacked(t.packed().slice(5))) == []
