import json

import pytest
from pyspark.sql import functions as F

from parsewright.operators import catalogue as C
from parsewright.operators import evaluation as E
from parsewright.operators import trials as S
from parsewright.sources import documents as D
from parsewright.streaming.incremental import chunk_stream, run_available


def one(spark, schema, values, column):
    return spark.createDataFrame([values], schema).select(column.alias("x")).first().x


CHOICES = [("A", "Age, sex", ""), ("B", "Income", ""), ("Y", "Other", ""), ("Z", "Not reported", "")]
SCHEMA = "answer string, truth array<string>, choices array<struct<key:string,value:string,description:string>>, type string"


@pytest.mark.parametrize(
    ("kind", "answer", "truth", "accuracy"),
    [
        ("single_choice", "(1 yes)", ["1"], 1), ("single_choice", "1) yes", ["1"], 0), ("single_choice", "Z", ["0"], 1), ("single_choice", None, ["1"], 0), ("single_choice", "2", [], 0),
        ("multiple_choice", "B, A", ["income", "Age sex"], 1), ("multiple_choice", "Z", ["0"], 1), ("multiple_choice", "A", ["Income"], 0), ("multiple_choice", None, None, 1),
        ("numeric", "10", ["10.0"], 1), ("numeric", "Z", ["0"], 1), ("numeric", "ten", ["10"], 0), ("numeric", "1", [], 0),
        ("list", "b, a", ["a", "b"], 1), ("list", "A", ["a"], 0), ("open_ended", "The  Mean.", ["the mean"], 1), ("open_ended", "x", [], 0),
    ],
)
def test_scores(spark, kind, answer, truth, accuracy):
    df = spark.createDataFrame([(answer, truth, CHOICES, kind)], SCHEMA)
    assert E.score(df).select("scored.accuracy").first().accuracy == accuracy


def test_unknown_type_is_an_error(spark):
    with pytest.raises(Exception, match="unknown question type"):
        E.score(spark.createDataFrame([("a", ["a"], CHOICES, "essay")], SCHEMA)).collect()


def test_applicability_and_levels(spark):
    results = spark.createDataFrame([("d1", "4.1", ["3"]), ("d2", "4.1", ["Three."]), ("d3", "4.1", []), ("d4", "9", ["1"])], "doc_name string, query_id string, values array<string>")
    rules = spark.createDataFrame([("5", "4.1", "3.0"), ("6", "5", "x")], "query_id string, depends_on string, blocked string")
    got = {(r.doc_name, r.query_id): (r.ready, r.applicable) for r in E.applicability(results, rules).collect()}
    assert got["d1", "5"] == (True, False) and got["d2", "5"] == (True, True) and got["d3", "5"] == (True, False) and got["d4", "5"] == (False, True)
    assert E.dependency_levels(rules) == {"4.1": 0, "5": 1, "6": 2}
    scored = spark.createDataFrame([("d1", "5", "text", ["7"], 0), ("d2", "5", "text", ["7"], 0)], "doc_name string, query_id string, raw_output string, pred_value array<string>, accuracy int")
    by = {r.doc_name: r for r in E.with_not_applicable(scored, E.applicability(results, rules)).collect()}
    assert by["d1"].pred_value == ["-99"] and by["d1"].accuracy == 1 and by["d2"].raw_output == "text"


def test_truth(spark):
    schema = "a array<string>, p array<string>"
    assert one(spark, schema, (["Other: x, y", "Yes indeed", "z", None, " "], ["Other:", "Yes"]), C.cleaned_truth(F.col("a"), F.col("p"))) == ["x", "y", "z"]
    assert one(spark, schema, (["yes", ""], ["Yes"]), C.without_prefilled(F.col("a"), F.col("p"))) == ["-99"]
    wide = spark.createDataFrame([(1, "1.1", "a", "nan"), (2, "1.1", "b", None)], "row int, item string, `021` string, `023` string")
    assert {(r.doc_name, tuple(r.answers)) for r in C.unpivot_truth(wide, "item", "row").collect()} == {("021", ("a", "b")), ("023", ())}


def test_sheet(spark):
    sheet = spark.createDataFrame([(1, "1.1", ""), (2, "", "x"), (3, "0.1", ""), (4, "1.2", ""), (5, "1.1", ""), (6, "note", "")], "row int, item string, v string")
    assert [r.item for r in C.item_codes(sheet, "item", "row", ("0.1",)).orderBy("place").collect()] == ["1.1", "1.2"]
    assert [r.item for r in C.fill_down(sheet.limit(2), "item", "row").orderBy("row").collect()] == ["1.1", "1.1"]
    lines = (["1. Kinds", "[ ] Forms:", "[ ] Texts", "[ ] Other", "[ ] Not reported", "-99"],)
    assert [(c.key, c.value) for c in one(spark, "v array<string>", lines, C.normalise_choices(F.col("v")))] == [("A", "Forms"), ("B", "Texts"), ("Y", "Other"), ("Z", "Not reported")]
    assert [one(spark, "v array<string>", (v,), C.infer_type(F.col("v"))) for v in (["[ ] a"], ["Numeric"], ["1 = yes"], [])] == ["multiple_choice", "numeric", "single_choice", "open_ended"]
    assert [tuple(c) for c in one(spark, "v array<string>", (["1 = a=b"],), C.key_value_choices(F.col("v")))] == [("1", "a=b")]
    wide = spark.createDataFrame([("q", "p1", "a1", " ", "a2")], "query_id string, paragraph_1 string, correct_answer_1 string, paragraph_2 string, correct_answer_2 string")
    assert [tuple(e) for e in C.unpivot_examples(wide, "query_id", ("1", "2")).first().examples] == [("p1", "a1")]
    metrics = C.expand_metrics(spark.createDataFrame([("4.5", ["AUC", "Specify other"])], "query_id string, prefilled array<string>"), "query_id", "prefilled").collect()
    assert [(m.metric_id, m.metric_type) for m in metrics] == [("4.5.1", "numeric"), ("4.5.2", "open_ended")]
    assert one(spark, "v string", ("AUC: 0.81 (CI)",), C.metric_number(F.col("v"), "AUC")) == "0.81"
    assert one(spark, "v array<string>", (["z", "b", "a"],), C.ordered_columns(F.col("v"), ("b", "c"))) == ["b", "a", "z"]


def test_trials(spark):
    grid = S.grid(spark, size=[100, 200], overlap=[0, 150]).where("overlap < size")
    assert grid.count() == 3
    done = grid.where("size = 100")
    assert S.not_done(grid, done, ("size", "overlap")).count() == 2
    keys = [r.k for r in grid.select(S.config_key("size", "overlap").alias("k")).collect()]
    assert len(set(keys)) == 3


def test_files(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw/021.pdf").write_bytes("# Title\ntext".encode())
    (tmp_path / "raw/x.meta.json").write_text("{}")
    files = D.raw_files(spark, str(tmp_path / "raw"))

    def fails():
        def parse(data):
            raise ValueError("no " + "x" * 400)

        return parse

    assert len(D.parse(files, "p", fails).first().error) == 300
    from parsewright.registry import PARSERS

    parsed = D.parse(files, "TextParser", PARSERS["TextParser"]).first()
    assert parsed.content == "# Title\ntext" and parsed.format == "markdown"
    with pytest.raises(KeyError, match="unknown parser"):
        PARSERS["none"]
    folder = tmp_path / "parsed"
    folder.mkdir()
    (folder / "a.json").write_text('["one", "two"]')
    (folder / "b.md").write_text("text")
    (folder / "b.meta.json").write_text("{}")
    assert {(r.doc_name, r.content) for r in D.parsed_files(spark, str(folder), "p").collect()} == {("a", "one\n\ntwo"), ("b", "text")}
    chunks = tmp_path / "chunks"
    chunks.mkdir()
    (chunks / "a.json").write_text('[{"text": "x", "metadata": {"k": "v"}}]')
    (chunks / "b.json").write_text('["y", "z"]')
    (chunks / "c.json").write_text("u\n\nv")
    assert sorted((r.doc_name, r.chunk_index, r.text) for r in D.chunk_files(spark, str(chunks)).collect()) == [("a", 0, "x"), ("b", 0, "y"), ("b", 1, "z"), ("c", 0, "u"), ("c", 1, "v")]
    (tmp_path / "q.json").write_text(json.dumps({"1.1": {"label": "L", "type": "list", "choices": [], "prompts": {"base_prompt": "b"}}}))
    assert D.query_file(spark, str(tmp_path / "q.json")).first().prompts == {"base_prompt": "b"}
    (tmp_path / "r.json").write_text(json.dumps({"2": {"depends_on": ["1"], "not_applicable_if": [{"1": "0"}]}}))
    assert tuple(D.rules_file(spark, str(tmp_path / "r.json")).first()) == ("2", "1", "0")
    (tmp_path / "t1").mkdir()
    (tmp_path / "t1/trial_summary.json").write_text(json.dumps({"trial_number": 3, "overall_average_accuracy": 0.5, "parameters": {"k": "5"}, "query_aggregates": {"1.1": 0.5}}))
    (tmp_path / "t2").mkdir()
    (tmp_path / "t2/trial_summary.json").write_text("{broken")
    summaries = D.summary_files(spark, str(tmp_path))
    assert [r.trial_number for r in summaries.collect()] == [3] and S.aggregate_points(summaries, "query_aggregates", "query_id").first().overall == 0.5


def test_tei(spark):
    tei = '<TEI xmlns="urn:x"><title>T</title><author><persName><surname>S</surname></persName></author><head>H</head><p>a</p></TEI>'
    df = spark.createDataFrame([(1, tei), (2, "<TEI><p>cut"), (3, None), (4, "text")], "parse_id int, content string")
    r = D.tei_parts(df).collect()
    assert len(r) == 1 and r[0].title == "T" and r[0].authors == ["S"] and r[0].heads == ["H"] and r[0].paragraphs == 1


def test_stream_takes_new_files_only(spark, tmp_path):
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    spark.createDataFrame([(1, "a b c")], "doc_id long, text string").write.parquet(source)
    run_available(chunk_stream(spark, source, "doc_id", "text", 2, 0), target, state)
    assert spark.read.parquet(target).count() == 2
    spark.createDataFrame([(2, "d")], "doc_id long, text string").write.mode("append").parquet(source)
    run_available(chunk_stream(spark, source, "doc_id", "text", 2, 0), target, state)
    assert spark.read.parquet(target).count() == 3


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 26 * 5
    assert set(e.oracle_sql()) <= set(e.queries())
