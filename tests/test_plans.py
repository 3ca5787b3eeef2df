"""Registered queries over small tables, against plain Python."""

import datetime
import hashlib

from parsewright.operators import trials as S
from parsewright.plans import queries as Q

TYPES = ("numeric", "open_ended", "single_choice", "multiple_choice", "list")


def write(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def test_retrieval_ranks_every_question(spark, tmp_path):
    texts = {i: " ".join(f"w{i}x{j}" for j in range(i * 37 % 151 + 1)) for i in range(60)}
    docs = {i: ("a", "b", None)[i % 3] for i in texts}
    write(spark, tmp_path, "chunks", [(i, docs[i], t) for i, t in texts.items()] + [(60, "a", None)], "chunk_id long, doc_name string, text string")
    write(spark, tmp_path, "queries", [(f"{k}.1", t) for k, t in enumerate(TYPES)], "query_id string, type string")
    run = lambda f: {(r.doc_name, r.query_id, getattr(r, "rank", 0)): tuple(r)[2:] for r in f(spark, str(tmp_path)).collect()}

    def score(i, q):
        digest = hashlib.md5(f"{i}:{q}".encode()).hexdigest()
        return ord(digest[0]) * 16 + ord(digest[1])

    limit, budget, reranked, contexts = {}, {}, {}, {}
    for doc in ("a", "b", None):
        for q in (f"{k}.1" for k in range(len(TYPES))):
            order = sorted((i for i in texts if docs[i] == doc), key=lambda i: (-score(i, q), i))
            n = {i: len(texts[i].split()) for i in order}
            total = 0
            for rank, i in enumerate(order[:10], 1):
                total += n[i]
                if total <= 300:
                    limit[doc, q, rank] = (rank, i)
            total = 0
            for rank, i in enumerate(order, 1):
                total += n[i]
                if total <= 120:
                    budget[doc, q, rank] = (rank, i, n[i], texts[i])
                elif rank == 1:
                    budget[doc, q, rank] = (rank, i, 120, " ".join(texts[i].split()[:120]))
            for rank, (_, _, i) in enumerate(sorted((-(len(texts[i]) % 17), at, i) for at, i in enumerate(order[:10]))[:3], 1):
                reranked[doc, q, rank] = (rank, i)
            contexts[doc, q, 0] = ("\n".join(texts[i] for i in order[:3]),)
    assert any(used == 120 < len(texts[i].split()) for _, i, used, _ in budget.values())
    assert run(Q.top_k_token_limit) == limit
    assert run(Q.token_budget) == budget
    assert run(Q.rerank_two_stage) == reranked
    assert run(Q.context_assembly) == contexts


def letter(prompt):
    return hashlib.md5(prompt.encode()).hexdigest().upper().translate(str.maketrans("0123456789", "GHIJKLMNOP"))[0]


def test_inference_reads_the_documents(spark, tmp_path):
    at = [datetime.datetime(2024, 1, k) for k in (1, 2, 3)]
    long = "wörter und {braces} " * 5000
    parsed = [(1, "a", "x", "old", at[0]), (2, "a", "x", long, at[1]), (3, "a", "x", None, at[2]), (4, "a", "y", "same", at[0]), (5, "b", "x", "same", at[0]), (6, "b", "y", None, at[0]), (7, "c", "x", "tie 7", at[0]), (8, "c", "x", "tie 8", at[0])]
    newest = {("a", "x"): long, ("a", "y"): "same", ("b", "x"): "same", ("b", "y"): "", ("c", "x"): "tie 8"}
    choices = [(k, f"value {k}", None) for k in "ABCDE"]
    base = {"1.1": "Read {context} now", "1.2": "No mark", "1.3": None}
    binary = {"1.1": [f"Does {k} apply to {{context}}?" for k in "ABCDE"], "1.2": [f"Is {k} so?" for k in "ABCDE"], "1.3": []}
    write(spark, tmp_path, "parsed_docs", parsed, "parse_id long, doc_name string, parser string, content string, parsed_at timestamp")
    write(spark, tmp_path, "queries", [(q, choices, (base[q], binary[q])) for q in base], "query_id string, choices array<struct<key:string,value:string,description:string>>, prompts struct<base_prompt:string,binary_prompts:array<string>>")
    write(spark, tmp_path, "outcomes", [(n, None) for n in "abc"], "doc_name string, outcome string")

    prompts = {(*k, q): base[q].replace("{context}", text) for k, text in newest.items() for q in ("1.1", "1.2")}
    got = {(r.doc_name, r.parser, r.query_id): (r.raw_output, r.digest) for r in Q.full_inference(spark, str(tmp_path)).collect()}
    assert got == {k: (letter(p), hashlib.md5(p.encode()).hexdigest()) for k, p in prompts.items()}

    want = {}
    for k, text in newest.items():
        for q in ("1.1", "1.2"):
            want[*k, q] = ",".join(key for key, p in zip("ABCDE", binary[q]) if letter(p.replace("{context}", text)) in "ABCDGH") or "Z"
    rows = Q.binary_decomposition(spark, str(tmp_path)).collect()
    assert len(rows) == len(want) and {(r.doc_name, r.parser, r.query_id): r.raw_output for r in rows} == want
    assert len({want[*k, "1.1"] for k in newest}) > 1


def test_resume_in_every_trial(spark, tmp_path):
    done = [(1, "a", "1.1"), (1, "a", "1.1"), (1, "b", "1.2"), (2, "a", "1.2"), (2, "z", "1.1"), (9, "a", "1.1"), (3, "a", None), (None, "a", "1.1"), (3, "b", "1.1"), (3, "b", "1.2")]
    write(spark, tmp_path, "results", done, "trial_id int, doc_name string, query_id string")
    write(spark, tmp_path, "trials", [(1,), (2,), (3,), (4,)], "trial_id int")
    write(spark, tmp_path, "outcomes", [("a",), ("b",)], "doc_name string")
    write(spark, tmp_path, "queries", [("1.1",), ("1.2",)], "query_id string")
    rows = [tuple(r) for r in Q.resume_not_done(spark, str(tmp_path)).collect()]
    assert sorted(rows) == sorted((t, n, q) for t in (1, 2, 3, 4) for n in "ab" for q in ("1.1", "1.2") if (t, n, q) not in done)
    nulls = spark.createDataFrame([(1, None), (2, None)], "k int, d string")
    items = spark.createDataFrame([(None,), ("x",)], "q string")
    answered = spark.createDataFrame([(1, None, None), (2, None, "x")], "k int, d string, q string")
    assert {tuple(r) for r in S.not_done_items(nulls, items, answered, ("k", "d"), "q").collect()} == {(1, None, "x"), (2, None, None)}


def test_applicability_within_each_trial(spark, tmp_path):
    rows = [
        (1, 1, "a", "4.1", ["3"]), (2, 1, "a", "4.1", ["1"]),
        (3, 2, "a", "4.1", ["1"]), (4, 2, "a", "4.1", ["3"]), (5, 2, "a", "4.1", None),
        (6, 3, "a", "4.1", None), (7, 3, "a", "2.6", ["2"]), (8, 3, "a", "1.3", ["2"]), (9, 4, "b", "5.3", ["x"]), (10, 5, None, "4.1", ["3"]),
    ]
    write(spark, tmp_path, "results", [(*r, "single_choice") for r in rows], "result_id long, trial_id int, doc_name string, query_id string, pred_indicator array<string>, type string")
    got = {(r.trial_id, r.doc_name, r.query_id): (r.ready, r.applicable) for r in Q.dependency_applicability(spark, str(tmp_path)).collect()}
    held = {(1, "a"): {"4.1": ["1"]}, (2, "a"): {"4.1": ["3"]}, (3, "a"): {"4.1": [], "2.6": ["2"], "1.3": ["2"]}, (4, "b"): {"5.3": ["x"]}}
    want = {}
    for key, answers in held.items():
        for q in {r[0] for r in Q._RULES}:
            rules = [(on, blocked) for x, on, blocked in Q._RULES if x == q]
            want[*key, q] = (all(on in answers for on, _ in rules), not any(on in answers and all(v == blocked for v in answers[on]) for on, blocked in rules))
    assert got == want
