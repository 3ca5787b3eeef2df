"""Queries of the engine's own operators over whole tables, and SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parsewright.functions import text as T
from parsewright.operators import catalogue as C
from parsewright.operators import chunking as K
from parsewright.operators import evaluation as E
from parsewright.operators import generation as G
from parsewright.operators import retrieval as R
from parsewright.operators import trials as S
from parsewright.session import read_table, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# White space in DuckDB's patterns as Python and Java's (?U) see it.
_WS = r"[\t-\r \x{85}\p{Z}]"
_STRIP_SQL = rf"regexp_replace(regexp_replace({{0}}, '^{_WS}+', ''), '{_WS}+$', '')"
_TOKENS_SQL = rf"list_filter(regexp_split_to_array({{0}}, '{_WS}+'), lambda x: x <> '')"


def _sql_strip(x: str) -> str:
    return _STRIP_SQL.replace("{0}", x)


def _sql_tokens(x: str) -> str:
    return _TOKENS_SQL.replace("{0}", x)


def _sql_sanitize(x: str, tags: bool) -> str:
    out = rf"regexp_replace({x}, '\r\n?', chr(10), 'g')"
    if tags:
        out = rf"regexp_replace({out}, '<[^>]+>', ' ', 'g')"
    out = rf"regexp_replace({out}, '\n{_WS}+', chr(10), 'g')"
    out = rf"regexp_replace({out}, '[\t ]+', ' ', 'g')"
    out = rf"regexp_replace({out}, '\n{{3,}}', chr(10) || chr(10), 'g')"
    return _sql_strip(out)


def _sql_plain(x: str) -> str:
    return _sql_strip(rf"regexp_replace(translate(lower({x}), '!\"#$%&''()*+,-./:;<=>?@[\]^_`{{|}}~', ''), '{_WS}+', ' ', 'g')")


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Documents, sanitised and cut into windows of words, embedded and searched for each question."""
    docs = read_table(spark, d, "documents").where("text is not null").select("doc_id", "text")
    chunks = K.length_chunks(docs, "text", 100, 20, keep=("doc_id",))
    store = R.embed_checksum(chunks, "text").select(F.concat_ws("-", "doc_id", "chunk_index").alias("chunk_key"), "embedding")
    questions = R.embed_checksum(read_table(spark, d, "queries"), "description").select("query_id", "embedding")
    return R.top_k(store, questions, 5, "chunk_key")


# --- text ------------------------------------------------------------------------------------------------------


@_query(f"SELECT doc_id, md5({_sql_sanitize('text', True)}) AS digest, CAST(length({_sql_sanitize('text', True)}) AS INTEGER) AS n_chars_clean FROM documents WHERE text IS NOT NULL")
def sanitize_documents(spark: SparkSession, d: str) -> DataFrame:
    clean = spread(read_table(spark, d, "documents").where("text is not null").select("doc_id", "text")).select("doc_id", T.sanitize(F.col("text"), True).alias("clean"))
    return clean.select("doc_id", F.md5("clean").alias("digest"), F.length("clean").alias("n_chars_clean"))


@_query(f"SELECT doc_id, CAST(len({_sql_tokens('text')}) AS INTEGER) AS n_words, CAST(length({_sql_strip('text')}) AS INTEGER) AS n_stripped, CAST(list_sum(list_transform(string_split(text, ''), lambda c: unicode(c))) % 10000 AS BIGINT) AS checksum FROM documents WHERE length(text) > 0")
def checksum_embedding(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    return read_table(spark, d, "documents").where(F.length("text") > 0).select("doc_id", F.size(T.tokens(text)).alias("n_words"), F.length(T.strip(text)).alias("n_stripped"), (T.code_point_sum(text) % 10000).alias("checksum"))


_REASONING_SQL = "raw_output"
for _p in (r"(?is)<think>.*?</think>|<reason>.*?</reason>|<thought>.*?</thought>", r"(?is)\((thinking|reasoning|step-by-step reasoning):.*?\)", rf"(?is)<!--{_WS}*(think|reasoning|steps).*?-->", rf"(?im)^(Thoughts?:|Reasoning:|Step{_WS}*\d*:|Internal monologue:|Chain-of-thought:){_WS}*"):
    _REASONING_SQL = f"regexp_replace({_REASONING_SQL}, '{_p}', '', 'g')"


@_query(f"SELECT result_id, {_sql_strip(_REASONING_SQL)} AS answer FROM results WHERE raw_output IS NOT NULL")
def reasoning_removed(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "results").where("raw_output is not null").select("result_id", T.without_reasoning(F.col("raw_output")).alias("answer"))


@_query(f"SELECT result_id, md5({_sql_strip(_REASONING_SQL)}) AS plain_digest, md5({_sql_strip(_REASONING_SQL)}) AS content_digest, md5({_sql_strip(_REASONING_SQL)}) AS choices_digest FROM results WHERE raw_output IS NOT NULL AND NOT starts_with({_sql_strip('raw_output')}, '{{')")
def response_texts(spark: SparkSession, d: str) -> DataFrame:
    """The text of an answer as it is, in a message, and in a list of choices."""
    raw = F.col("raw_output")
    found = read_table(spark, d, "results").where(raw.isNotNull() & ~T.strip(raw).startswith("{"))
    content = F.to_json(F.struct(F.struct(raw.alias("content")).alias("message")))
    choices = F.to_json(F.struct(F.array(F.struct(F.struct(raw.alias("content")).alias("message"))).alias("choices")))
    return found.select("result_id", *(F.md5(G.response_text(c)).alias(f"{name}_digest") for name, c in (("plain", raw), ("content", content), ("choices", choices))))


_W = r"[\p{L}\p{M}\p{N}\p{Pc}\x{200C}\x{200D}]"
_NW = r"[^\p{L}\p{M}\p{N}\p{Pc}\x{200C}\x{200D}]"
_FIRST_SQL = rf"regexp_replace(regexp_replace(regexp_replace({_sql_strip('raw_output')}, '<[^>]*>', '', 'g'), '^{_NW}+', ''), '{_NW}+$', '')"


@_query(f"SELECT result_id, upper(coalesce({_sql_tokens(_FIRST_SQL)}[1], '')) AS first_answer, {_sql_plain('raw_output')} AS plain, regexp_replace(lower({_sql_strip('raw_output')}), '{_NW}+', '', 'g') AS letters FROM results WHERE raw_output IS NOT NULL")
def answers_normalised(spark: SparkSession, d: str) -> DataFrame:
    raw = F.col("raw_output")
    return read_table(spark, d, "results").where(raw.isNotNull()).select("result_id", T.first_answer(raw).alias("first_answer"), T.plain(raw).alias("plain"), T.word_characters(raw).alias("letters"))


# --- chunks ----------------------------------------------------------------------------------------------------


@_query(rf"""
WITH w AS (SELECT doc_id, {_sql_tokens(_sql_sanitize('text', True))} AS words FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, words, unnest(range(0, CAST(greatest(0, ceil((len(words) - 100) / 80.0)) AS BIGINT) + 1)) AS i FROM w WHERE len(words) > 0)
SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, array_to_string(words[i * 80 + 1 : i * 80 + 100], ' ') AS text FROM s
""")
def token_windows(spark: SparkSession, d: str) -> DataFrame:
    return K.length_chunks(read_table(spark, d, "documents").where("text is not null"), "text", 100, 20, keep=("doc_id",))


@_query(r"""
WITH s AS (SELECT doc_id, text, unnest(range(0, CAST(greatest(0, ceil((length(text) - 1000) / 900.0)) AS BIGINT) + 1)) AS i FROM documents WHERE length(text) > 0)
SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, substring(text, i * 900 + 1, 1000) AS text FROM s
""")
def char_windows(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents").where(F.length("text") > 0)
    return K.explode_chunks(docs, K.char_windows(F.col("text"), 1000, 100), "doc_id")


@_query(r"""
WITH s AS (SELECT doc_id, text, unnest(range(0, CAST(greatest(0, ceil((length(text) - 400) / 400.0)) AS BIGINT) + 1)) AS i FROM documents WHERE length(text) > 0),
c AS (SELECT doc_id, i, substring(text, i * 400 + 1, 400) AS text FROM s)
SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, CASE WHEN i = 0 THEN text ELSE right(lag(text) OVER (PARTITION BY doc_id ORDER BY i), 50) || text END AS text FROM c
""")
def overlap_prefix(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents").where(F.length("text") > 0)
    return K.explode_chunks(docs, K.with_overlap(K.char_windows(F.col("text"), 400), 50), "doc_id")


@_query(rf"""
WITH s AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?]){_WS}+', '\1' || chr(1), 'g'), chr(1)) AS parts FROM documents WHERE length(text) > 0)
SELECT doc_id, CAST(len(parts) AS INTEGER) AS n_sentences, md5(array_to_string(parts, chr(2))) AS digest FROM s
""")
def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    parts = read_table(spark, d, "documents").where(F.length("text") > 0).select("doc_id", T.sentences(F.col("text")).alias("parts"))
    return parts.select("doc_id", F.size("parts").alias("n_sentences"), F.md5(F.array_join("parts", "\x02")).alias("digest"))


@_query(rf"""
WITH RECURSIVE s AS (SELECT doc_id, list_filter(string_split(regexp_replace({_sql_sanitize('text', False)}, '([.!?]){_WS}+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS parts FROM documents WHERE text IS NOT NULL),
r AS (SELECT doc_id, parts, 1 AS i, parts[1] AS cur, 0 AS chunk_index FROM s WHERE len(parts) > 0
  UNION ALL SELECT doc_id, parts, i + 1, CASE WHEN length(cur) + 1 + length(parts[i + 1]) <= 1000 THEN cur || ' ' || parts[i + 1] ELSE parts[i + 1] END, chunk_index + CASE WHEN length(cur) + 1 + length(parts[i + 1]) <= 1000 THEN 0 ELSE 1 END FROM r WHERE i < len(parts))
SELECT doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, arg_max(cur, i) AS text FROM r GROUP BY doc_id, chunk_index
""")
def sentence_pack(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(read_table(spark, d, "documents").where("text is not null").select("doc_id", "text"))
    return K.explode_chunks(docs, K.pack_sentences(T.sanitize(F.col("text")), 1000), "doc_id")


@_query(rf"""
WITH s AS (SELECT parse_id, unnest(string_split(regexp_replace(content, '(?m)^(#+ [^\n]+)$', chr(1) || '\1', 'g'), chr(1))) AS part, generate_subscripts(string_split(regexp_replace(content, '(?m)^(#+ [^\n]+)$', chr(1) || '\1', 'g'), chr(1)), 1) AS i FROM parsed_docs WHERE content IS NOT NULL),
f AS (SELECT parse_id, part, i FROM s WHERE {_sql_strip('part')} <> '')
SELECT parse_id, CAST(row_number() OVER (PARTITION BY parse_id ORDER BY i) - 1 AS INTEGER) AS section_index, nullif(regexp_extract(part, '^(#+ [^\n]+)(?:\n|$)', 1), '') AS heading, md5(part) AS digest FROM f
""")
def markdown_sections(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "parsed_docs").where("content is not null")
    parts = docs.select("parse_id", F.posexplode(K.markdown_sections(F.col("content"))).alias("section_index", "s"))
    return parts.select("parse_id", "section_index", "s.heading", F.md5("s.text").alias("digest"))


@_query()
def structure_chunks(spark: SparkSession, d: str) -> DataFrame:
    return K.structured_chunks(read_table(spark, d, "parsed_docs"), "parse_id", "content", "StructureChunker", 1000, 100)


@_query()
def text_structure_chunks(spark: SparkSession, d: str) -> DataFrame:
    return K.structured_chunks(read_table(spark, d, "parsed_docs"), "parse_id", "content", "TextStructureChunker", 1000, 100)


@_query(rf"""
WITH n AS (SELECT doc_id, len({_sql_tokens('text')}) AS n FROM documents WHERE text IS NOT NULL),
g AS (SELECT s.chunk_size, o.chunk_overlap FROM (SELECT unnest([50, 100, 250, 500, 750, 1000, 2500, 5000]) AS chunk_size) s, (SELECT unnest([0, 250, 750]) AS chunk_overlap) o WHERE o.chunk_overlap < s.chunk_size)
SELECT chunk_size, chunk_overlap, CAST(sum(CASE WHEN n = 0 THEN 0 WHEN n <= chunk_size THEN 1 ELSE 1 + ceil((n - chunk_size) / CAST(chunk_size - chunk_overlap AS DOUBLE)) END) AS BIGINT) AS n_chunks, count(*) AS n_docs FROM n, g GROUP BY ALL
""")
def chunk_grid(spark: SparkSession, d: str) -> DataFrame:
    sized = read_table(spark, d, "documents").where("text is not null").select("doc_id", F.size(T.tokens(F.col("text"))).alias("n"))
    counted = K.chunk_grid(sized).select("chunk_size", "chunk_overlap", K.window_count(F.col("n"), F.col("chunk_size"), F.col("chunk_overlap")).alias("k"))
    return counted.groupBy("chunk_size", "chunk_overlap").agg(F.sum("k").cast("bigint").alias("n_chunks"), F.count("*").alias("n_docs"))


# --- search ----------------------------------------------------------------------------------------------------


_COS = "list_dot_product({0}::DOUBLE[], {1}::DOUBLE[]) / (sqrt(list_dot_product({0}::DOUBLE[], {0}::DOUBLE[])) * sqrt(list_dot_product({1}::DOUBLE[], {1}::DOUBLE[])) + 1e-10)"


@_query(f"""
WITH p AS (SELECT q.vec_id AS query_id, e.vec_id, round({_COS.format('q.embedding', 'e.embedding')}, 9) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, round(score, 6) AS score FROM r WHERE rank <= 5
""")
def cosine_top_k(spark: SparkSession, d: str) -> DataFrame:
    store = read_table(spark, d, "embeddings")
    wanted = store.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")  # the stated query set
    return R.top_k(store, wanted, 5).select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


@_query("SELECT a.vec_id, round(coalesce(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 0), 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def neighbour_cosine(spark: SparkSession, d: str) -> DataFrame:
    """The cosine of each vector and the one with the next id, pair by pair."""
    store = read_table(spark, d, "embeddings").select("vec_id", "embedding")
    following = store.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("following"))
    return store.join(following, "vec_id").select("vec_id", F.round(R.cosine(F.col("embedding"), F.col("following")), 6).alias("score"))


# a made-up score that both engines compute alike: bits of a digest of chunk and question
_SCORED_SQL = f"""
scored AS (SELECT c.doc_name, q.query_id, c.chunk_id, c.text, len({_sql_tokens('c.text')}) AS n_tokens, (ascii(md5(c.chunk_id || ':' || q.query_id)) * 16 + ascii(substring(md5(c.chunk_id || ':' || q.query_id), 2, 1))) / 2000.0 AS score
  FROM chunks c, queries q WHERE c.text IS NOT NULL)"""


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk with every question, without texts: those of the few rows that are kept are joined to them."""
    chunks = read_table(spark, d, "chunks").where("text is not null").select("doc_name", "chunk_id", F.size(T.tokens(F.col("text"))).alias("n_tokens"))
    questions = read_table(spark, d, "queries").select("query_id")
    digest = F.md5(F.concat_ws(":", "chunk_id", "query_id"))
    score = (F.ascii(digest) * 16 + F.ascii(F.substring(digest, 2, 1))) / F.lit(2000.0)
    return chunks.crossJoin(F.broadcast(questions)).withColumn("score", score)  # questions are a fixed list


def _with_text(spark: SparkSession, d: str, hits: DataFrame) -> DataFrame:
    return hits.join(read_table(spark, d, "chunks").select("chunk_id", "text"), "chunk_id")


@_query(f"""
WITH {_SCORED_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_name, query_id ORDER BY score DESC, chunk_id) AS rank FROM scored),
c AS (SELECT *, sum(n_tokens) OVER (PARTITION BY doc_name, query_id ORDER BY rank) AS running FROM r WHERE rank <= 10)
SELECT doc_name, query_id, CAST(rank AS INTEGER) AS rank, chunk_id FROM c WHERE running <= 300
""")
def top_k_token_limit(spark: SparkSession, d: str) -> DataFrame:
    return R.take_top(_scored(spark, d), 10, ("doc_name", "query_id"), token_limit=300).select("doc_name", "query_id", "rank", "chunk_id")


@_query(f"""
WITH {_SCORED_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_name, query_id ORDER BY score DESC, chunk_id) AS rank FROM scored),
c AS (SELECT *, sum(n_tokens) OVER (PARTITION BY doc_name, query_id ORDER BY rank) AS running FROM r)
SELECT doc_name, query_id, CAST(rank AS INTEGER) AS rank, chunk_id, CAST(least(n_tokens, 120) AS INTEGER) AS used, CASE WHEN rank = 1 AND n_tokens > 120 THEN array_to_string({_sql_tokens('text')}[1:120], ' ') ELSE text END AS text
FROM c WHERE running <= 120 OR (rank = 1 AND n_tokens > 120)
""")
def token_budget(spark: SparkSession, d: str) -> DataFrame:
    taken = _with_text(spark, d, R.take_budget(_scored(spark, d), 120, ("doc_name", "query_id"), text=None))
    return taken.select("doc_name", "query_id", "rank", "chunk_id", "used", R.cut_to_used(F.col("text")).alias("text"))


@_query(f"""
WITH {_SCORED_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_name, query_id ORDER BY score DESC, chunk_id) AS first_rank FROM scored),
s AS (SELECT *, length(text) % 17 AS rerank_score FROM r WHERE first_rank <= 10),
t AS (SELECT *, row_number() OVER (PARTITION BY doc_name, query_id ORDER BY rerank_score DESC, first_rank) AS rank FROM s)
SELECT doc_name, query_id, CAST(rank AS INTEGER) AS rank, chunk_id FROM t WHERE rank <= 3
""")
def rerank_two_stage(spark: SparkSession, d: str) -> DataFrame:
    best = R.rerank(_scored(spark, d), 10, 3, ("doc_name", "query_id"), lambda first: _with_text(spark, d, first).withColumn("rerank_score", F.length("text") % 17))
    return best.select("doc_name", "query_id", "rank", "chunk_id")


@_query(f"""
WITH {_SCORED_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_name, query_id ORDER BY score DESC, chunk_id) AS rank FROM scored)
SELECT doc_name, query_id, string_agg(text, chr(10) ORDER BY rank) AS context FROM r WHERE rank <= 3 GROUP BY ALL
""")
def context_assembly(spark: SparkSession, d: str) -> DataFrame:
    return G.assemble_context(_with_text(spark, d, R.take_top(_scored(spark, d), 3, ("doc_name", "query_id"))), ("doc_name", "query_id"))


@_query("""
SELECT query_id, concat_ws(' ', nullif(label, ''), nullif(description, ''), CASE WHEN len(choices) > 0 THEN 'Choices: ' || array_to_string(list_transform(choices, lambda c: c.key || ': ' || c.value), ', ') END) AS label_definition,
  concat_ws(chr(10), 'Concept: ' || nullif(label, ''), 'Definition: ' || nullif(description, ''), 'Additional info: ' || nullif(description_detailed, ''), CASE WHEN len(choices) > 0 THEN 'Possible answers: ' || array_to_string(list_transform(choices, lambda c: c.value), ', ') END) AS labelled
FROM queries
""")
def query_texts(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    values = F.transform("choices", lambda x: x["value"])
    return read_table(spark, d, "queries").select("query_id", R.label_definition(c("label"), c("description"), c("choices")).alias("label_definition"), R.labelled_query(c("label"), c("description"), c("description_detailed"), values).alias("labelled"))


# --- questions, truth, prompts -----------------------------------------------------------------------------------

_TEMPLATE = "Question: {concept}\nDetails: {description}\nRules: {instructions}\nOptions:\n{choices}\n\n{context}"
_CHOICE_LINES = "array_to_string(list_transform(choices, lambda c: c.key || ': ' || c.value || CASE WHEN coalesce(trim(c.description), '') <> '' THEN ' - ' || trim(c.description) ELSE '' END), chr(10))"


@_query(f"""
SELECT query_id, 'base' AS category, replace(replace(replace(replace({"'" + _TEMPLATE.replace(chr(10), "' || chr(10) || '") + "'"}, '{{concept}}', coalesce(description, '')), '{{description}}', coalesce(description_detailed, '')), '{{instructions}}', coalesce(instructions, '')), '{{choices}}', CASE WHEN len(choices) > 0 THEN {_CHOICE_LINES} ELSE '{{choices}}' END) AS prompt
FROM queries WHERE type IN ('single_choice', 'multiple_choice') UNION ALL SELECT query_id, 'system', 'Answer from the excerpt alone.' FROM queries
""")
def prompts_rendered(spark: SparkSession, d: str) -> DataFrame:
    rows = [(t, "base", _TEMPLATE) for t in ("single_choice", "multiple_choice")] + [(None, "system", "Answer from the excerpt alone.")]
    return C.render_prompts(read_table(spark, d, "queries"), spark.createDataFrame(rows, "type string, category string, template string"))


@_query("""
WITH s AS (SELECT query_id, coalesce(len(prompts.binary_prompts) > 0 AND type IN ('multiple_choice', 'single_choice') AND len(choices) > 2, false) AS b, prompts FROM queries)
SELECT query_id, CASE WHEN b THEN 'binary' ELSE 'true_few_shot_prompt' END AS kind, CASE WHEN NOT b THEN coalesce(prompts.true_few_shot_prompt, prompts.synthetic_few_shot_prompt) END AS prompt FROM s
""")
def prompt_selected(spark: SparkSession, d: str) -> DataFrame:
    chosen = C.select_prompt(F.col("prompts"), F.col("type"), F.col("choices"), "true_few_shot_prompt", False)
    return read_table(spark, d, "queries").select("query_id", chosen.alias("s")).select("query_id", "s.kind", "s.prompt")


@_query("""
SELECT query_id, CASE WHEN len(examples) > 0 THEN array_to_string(list_transform(examples, lambda e: 'Excerpt:' || chr(10) || e.context || chr(10) || 'Answer: ' || e.answer), chr(10) || chr(10)) || chr(10) || chr(10) || prompts.base_prompt ELSE prompts.base_prompt END AS prompt FROM queries
""")
def few_shot_prompts(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "queries").select("query_id", C.few_shot(F.col("prompts.base_prompt"), F.col("examples")).alias("prompt"))


_ESC = "replace(replace(replace(replace(replace(coalesce({0}, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


@_query(f"""
SELECT '<table><tr><th>query_id</th><th>label</th><th>description</th></tr>' || string_agg('<tr><td>' || {_ESC.format('query_id')} || '</td><td>' || {_ESC.format('label')} || '</td><td>' || {_ESC.format('description')} || '</td></tr>', '' ORDER BY query_id) || '</table>' AS html FROM queries
""")
def prompts_html(spark: SparkSession, d: str) -> DataFrame:
    return C.html_table(read_table(spark, d, "queries"), ("query_id", "label", "description"), "query_id")


@_query("""
WITH p AS (SELECT t.doc_name, t.query_id, t.answers, q.prefilled FROM true_answers t JOIN queries q USING (query_id)),
k AS (SELECT doc_name, query_id, list_filter(coalesce(answers, []), lambda a: a IS NOT NULL AND trim(a) <> '' AND len(list_filter(coalesce(prefilled, []), lambda p: p <> '' AND starts_with(lower(trim(a)), lower(trim(p))))) = 0) AS kept FROM p)
SELECT doc_name, query_id, array_to_string(CASE WHEN len(kept) > 0 THEN kept ELSE ['-99'] END, '|') AS answers FROM k
""")
def truth_without_prefilled(spark: SparkSession, d: str) -> DataFrame:
    both = read_table(spark, d, "true_answers").join(F.broadcast(read_table(spark, d, "queries").select("query_id", "prefilled")), "query_id")  # questions are a fixed list
    return both.select("doc_name", "query_id", F.array_join(C.without_prefilled(F.coalesce("answers", F.expr("cast(array() as array<string>)")), F.col("prefilled")), "|").alias("answers"))


@_query("""
WITH v AS (SELECT t.doc_name, t.query_id, q.choices, list_filter(coalesce(t.answers, []), lambda a: a IS NOT NULL) AS values FROM true_answers t JOIN queries q USING (query_id) WHERE q.type = 'multiple_choice')
SELECT doc_name, query_id, array_to_string(list_sort(list_distinct(list_transform(values, lambda v: CASE WHEN trim(v) = '0' THEN 'Z' ELSE coalesce(list_filter(choices, lambda c: lower(trim(c.value)) = lower(trim(v)))[1].key, 'Y') END))), ',') AS letters FROM v
""")
def truth_letters(spark: SparkSession, d: str) -> DataFrame:
    both = read_table(spark, d, "true_answers").join(F.broadcast(read_table(spark, d, "queries").where("type = 'multiple_choice'").select("query_id", "choices")), "query_id")
    values = F.filter(F.coalesce("answers", F.expr("cast(array() as array<string>)")), lambda a: a.isNotNull())
    return both.select("doc_name", "query_id", F.array_join(C.value_letters(values, F.col("choices")), ",").alias("letters"))


@_query("""
SELECT doc_name, CASE WHEN regexp_extract(doc_name, '^(\\d+)', 1) <> '' THEN regexp_extract(doc_name, '^(\\d+)', 1) ELSE doc_name END AS doc_key, CASE WHEN coalesce(outcome, '') = '' THEN 'One outcome.' ELSE replace('Several outcomes; here {OUTCOME}.', '{OUTCOME}', outcome) END AS prompt FROM outcomes
""")
def outcome_prompts(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "outcomes").select("doc_name", T.leading_number(F.col("doc_name")).alias("doc_key"), C.outcome_prompt(F.col("outcome"), "One outcome.", "Several outcomes; here {OUTCOME}.").alias("prompt"))


@_query("""
SELECT chunk_id, last_value(nullif(metadata['section_heading'], '') IGNORE NULLS) OVER (PARTITION BY doc_name, parser, chunker, unit, chunk_size, chunk_overlap ORDER BY chunk_index, chunk_id ROWS UNBOUNDED PRECEDING) AS heading FROM chunks
""")
def headings_filled_down(spark: SparkSession, d: str) -> DataFrame:
    chunks = read_table(spark, d, "chunks").select("chunk_id", "doc_name", "parser", "chunker", "unit", "chunk_size", "chunk_overlap", F.col("metadata")["section_heading"].alias("heading"), F.struct("chunk_index", "chunk_id").alias("at"))
    return C.fill_down(chunks, "heading", "at", ("doc_name", "parser", "chunker", "unit", "chunk_size", "chunk_overlap")).select("chunk_id", "heading")


@_query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY doc_name, parser ORDER BY parsed_at DESC, parse_id DESC) AS k FROM parsed_docs WHERE content IS NOT NULL)
SELECT doc_name, parser, parse_id, md5(content) AS digest FROM r WHERE k = 1
""")
def latest_parse(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "parsed_docs").where("content is not null").select("doc_name", "parser", "parsed_at", "parse_id", F.md5("content").alias("digest"))
    return C.newest_by(docs, ("doc_name", "parser"), ("parsed_at", "parse_id")).select("doc_name", "parser", "parse_id", "digest")


@_query(r"""
SELECT query_id, CAST(i AS INTEGER) AS place, c.key AS key, c.value AS value FROM (SELECT query_id, unnest(choices) AS c, generate_subscripts(choices, 1) AS i FROM queries)
""")
def choices_exploded(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "queries").select("query_id", F.posexplode("choices").alias("i", "c"))
    return rows.select("query_id", (F.col("i") + 1).alias("place"), "c.key", "c.value")


@_query("SELECT query_id, CAST(row_number() OVER (ORDER BY list_transform(string_split(query_id, '.'), lambda x: coalesce(try_cast(x AS INTEGER), 0)), query_id) AS INTEGER) AS place FROM (SELECT DISTINCT query_id FROM queries)")
def natural_query_order(spark: SparkSession, d: str) -> DataFrame:
    return S.natural_order(read_table(spark, d, "queries"), "query_id")


# --- answers and scores ------------------------------------------------------------------------------------------


def _to_score(spark: SparkSession, d: str, kind: str) -> DataFrame:
    results = read_table(spark, d, "results").where(F.col("type") == kind).select("result_id", "query_id", "type", F.col("raw_output").alias("answer"), F.col("true_value").alias("truth"))
    return results.join(F.broadcast(read_table(spark, d, "queries").select("query_id", "choices")), "query_id", "left")


@_query(f"""
WITH a AS (SELECT result_id, raw_output, true_value, upper(coalesce({_sql_tokens(_FIRST_SQL)}[1], '')) AS f FROM results WHERE type = 'single_choice'),
b AS (SELECT *, CASE WHEN f = 'Z' THEN '0' ELSE f END AS k FROM a)
SELECT result_id, coalesce(k, '') AS pred, CAST(coalesce(coalesce(k, '') = true_value[1], false) AS INTEGER) AS accuracy FROM b
""")
def score_single_choice(spark: SparkSession, d: str) -> DataFrame:
    return E.score(_to_score(spark, d, "single_choice")).select("result_id", F.col("scored.pred_indicator")[0].alias("pred"), "scored.accuracy")


_LETTERS = "list_sort(list_distinct(regexp_extract_all(upper(coalesce(raw_output, '')), '[A-Z]')))"


@_query(f"""
WITH a AS (SELECT r.result_id, {_LETTERS} AS letters, q.choices, list_transform(list_filter(coalesce(r.true_value, []), lambda x: x IS NOT NULL), lambda x: {_sql_plain('x')}) AS truth FROM results r LEFT JOIN queries q USING (query_id) WHERE r.type = 'multiple_choice'),
b AS (SELECT *, CASE WHEN list_contains(letters, 'Z') THEN ['0'] ELSE list_transform(list_filter(list_transform(letters, lambda k: list_filter(choices, lambda c: upper(c.key) = k)[1].value), lambda x: x IS NOT NULL AND x <> ''), lambda x: {_sql_plain('x')}) END AS pred FROM a)
SELECT result_id, array_to_string(letters, ',') AS letters, CAST(list_sort(list_distinct(pred)) = list_sort(list_distinct(truth)) AS INTEGER) AS accuracy FROM b
""")
def score_multiple_choice(spark: SparkSession, d: str) -> DataFrame:
    return E.score(_to_score(spark, d, "multiple_choice")).select("result_id", F.array_join("scored.pred_indicator", ",").alias("letters"), "scored.accuracy")


_NUM = rf"CASE WHEN regexp_matches({{0}}, '^[\t-\r ]*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?[\t-\r ]*$') THEN try_cast(trim({{0}}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS DOUBLE) END"


@_query(f"""
WITH a AS (SELECT result_id, CASE WHEN upper({_sql_strip('raw_output')}) = 'Z' THEN 0.0 ELSE {_NUM.replace('{0}', 'raw_output')} END AS pred, {_NUM.replace('{0}', 'true_value[1]')} AS truth FROM results WHERE type = 'numeric')
SELECT result_id, round(pred, 6) AS pred, CAST(coalesce(pred = truth, false) AS INTEGER) AS accuracy FROM a
""")
def score_numeric(spark: SparkSession, d: str) -> DataFrame:
    return E.score(_to_score(spark, d, "numeric")).select("result_id", F.round("scored.pred_num", 6).alias("pred"), "scored.accuracy")


@_query(f"""
WITH a AS (SELECT result_id, list_sort(list_distinct(list_transform(string_split(coalesce(raw_output, ''), ','), lambda x: {_sql_strip('x')}))) AS pred, list_sort(list_distinct(coalesce(true_value, []))) AS truth FROM results WHERE type = 'list')
SELECT result_id, array_to_string(pred, '|') AS pred, CAST(pred = truth AS INTEGER) AS accuracy FROM a
""")
def score_list(spark: SparkSession, d: str) -> DataFrame:
    return E.score(_to_score(spark, d, "list")).select("result_id", F.array_join("scored.pred_value", "|").alias("pred"), "scored.accuracy")


@_query(f"SELECT result_id, CAST(coalesce({_sql_plain('coalesce(raw_output, chr(0))')} = {_sql_plain('true_value[1]')}, false) AS INTEGER) AS accuracy FROM results WHERE type = 'open_ended' AND raw_output IS NOT NULL")
def score_open_stand_in(spark: SparkSession, d: str) -> DataFrame:
    return E.score(_to_score(spark, d, "open_ended")).where("answer is not null").select("result_id", "scored.accuracy")


_RULES = [("2.6", "4.1", "3"), ("4.2", "1.3", "2"), ("4.2", "2.6", "1"), ("5.3", "4.1", "0")]


@_query(f"""
WITH rules(query_id, depends_on, blocked) AS (VALUES {", ".join(str(r) for r in _RULES)}),
l AS (SELECT trial_id, doc_name, query_id, arg_max(pred_indicator, result_id) AS values FROM results WHERE type = 'single_choice' AND doc_name IS NOT NULL GROUP BY ALL),
p AS (SELECT d.trial_id, d.doc_name, r.* FROM (SELECT DISTINCT trial_id, doc_name FROM l) d, rules r),
h AS (SELECT p.trial_id, p.doc_name, p.query_id, l.query_id IS NOT NULL AS there, len(list_filter(coalesce(l.values, []), lambda v: NOT coalesce({_sql_plain('v')} = {_sql_plain('p.blocked')}, false))) = 0 AS all_blocked FROM p LEFT JOIN l ON l.trial_id = p.trial_id AND l.doc_name = p.doc_name AND l.query_id = p.depends_on)
SELECT trial_id, doc_name, query_id, bool_and(there) AS ready, NOT bool_or(there AND all_blocked) AS applicable FROM h GROUP BY ALL
""")
def dependency_applicability(spark: SparkSession, d: str) -> DataFrame:
    rules = spark.createDataFrame(_RULES, "query_id string, depends_on string, blocked string")
    # of each trial's answers the last that isn't null, and null where all are
    last = F.max_by("pred_indicator", F.when(F.col("pred_indicator").isNotNull(), F.col("result_id"))).alias("values")
    answers = read_table(spark, d, "results").where("type = 'single_choice' and doc_name is not null").groupBy("trial_id", "doc_name", "query_id").agg(last)
    return E.applicability(answers, rules, ("trial_id", "doc_name"))


@_query("""
SELECT CASE WHEN grouping(doc_name) = 0 THEN 'doc_name' WHEN grouping(query_id) = 0 THEN 'query_id' ELSE 'total' END AS level, doc_name, query_id, round(avg(accuracy), 6) AS mean_accuracy, count(accuracy) AS n FROM results GROUP BY GROUPING SETS ((doc_name), (query_id), ())
""")
def accuracy_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    return S.accuracy_sets(read_table(spark, d, "results"), "doc_name", "query_id").withColumn("mean_accuracy", F.round("mean_accuracy", 6))


@_query("""
WITH m AS (SELECT trial_id, doc_name, avg(accuracy) AS a FROM results WHERE accuracy IS NOT NULL GROUP BY ALL)
SELECT trial_id, round(avg(a), 6) AS mean_accuracy, count(*) AS n_docs FROM m GROUP BY ALL
""")
def trial_means(spark: SparkSession, d: str) -> DataFrame:
    return S.trial_means(read_table(spark, d, "results")).withColumn("mean_accuracy", F.round("mean_accuracy", 6))


# --- trials ------------------------------------------------------------------------------------------------------

_KEYS = ("chunk_overlap", "chunk_size", "embedder", "k", "parser", "retriever")


@_query(f"SELECT trial_id, md5({" || '|' || ".join(f"'{k}=' || coalesce(CAST({k} AS VARCHAR), 'null')" for k in _KEYS)}) AS config_key FROM trials")
def trial_keys(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "trials").select("trial_id", S.config_key(*_KEYS).alias("config_key"))


@_query("""
SELECT t.trial_id, w.doc_name, q.query_id FROM trials t, outcomes w, queries q
WHERE NOT EXISTS (SELECT 1 FROM results r WHERE r.trial_id = t.trial_id AND r.doc_name = w.doc_name AND r.query_id = q.query_id)
""")
def resume_not_done(spark: SparkSession, d: str) -> DataFrame:
    # trials, outcomes and questions are small beside the results; their product isn't, so questions are added after the join
    wanted = F.broadcast(read_table(spark, d, "trials").select("trial_id")).crossJoin(read_table(spark, d, "outcomes").select("doc_name"))
    return S.not_done_items(wanted, read_table(spark, d, "queries").select("query_id"), read_table(spark, d, "results"), ("trial_id", "doc_name"), "query_id")


@_query("SELECT result_id FROM results WHERE trial_id IN (SELECT trial_id FROM trials WHERE mode = 'full')")
def allowed_trials(spark: SparkSession, d: str) -> DataFrame:
    return S.allowed(read_table(spark, d, "results"), read_table(spark, d, "trials").where("mode = 'full'"), "trial_id").select("result_id")


@_query("""
SELECT r.result_id, coalesce(nullif(o.outcome, ''), 'none') AS outcome FROM results r LEFT JOIN outcomes o USING (doc_name)
""")
def outcome_lookup(spark: SparkSession, d: str) -> DataFrame:
    joined = read_table(spark, d, "results").select("result_id", "doc_name").join(read_table(spark, d, "outcomes"), "doc_name", "left")
    return joined.select("result_id", F.coalesce(F.nullif("outcome", F.lit("")), F.lit("none")).alias("outcome"))


@_query("""
WITH e AS (SELECT doc_name, row_number() OVER (ORDER BY doc_name) - 1 AS doc_number FROM outcomes WHERE outcome IS NOT NULL AND outcome <> ''),
n AS (SELECT DISTINCT doc_name FROM outcomes WHERE doc_name NOT IN (SELECT doc_name FROM e))
SELECT doc_name, CAST(doc_number AS BIGINT) AS doc_number FROM e UNION ALL SELECT doc_name, CAST((SELECT max(doc_number) FROM e) + row_number() OVER (ORDER BY doc_name) AS BIGINT) FROM n
""")
def stable_doc_numbers(spark: SparkSession, d: str) -> DataFrame:
    outcomes = read_table(spark, d, "outcomes")
    known = outcomes.where("outcome is not null and outcome <> ''").select("doc_name", (F.row_number().over(Window.orderBy("doc_name")) - 1).alias("doc_number"))
    return S.assign_ids(known, outcomes)


@_query("""
WITH r AS (SELECT *, row_number() OVER (ORDER BY overall_average_accuracy DESC, trial_id) AS rank FROM trials WHERE overall_average_accuracy IS NOT NULL),
l AS (SELECT rank, trial_id, overall_average_accuracy, unnest(['parser', 'chunker', 'k']) AS parameter, unnest([parser, chunker, CAST(k AS VARCHAR)]) AS setting FROM r),
c AS (SELECT parameter, count(DISTINCT setting) > 2 AND NOT bool_and(try_cast(setting AS DOUBLE) IS NOT NULL) AS categorical FROM l WHERE setting IS NOT NULL GROUP BY ALL)
SELECT CAST(rank AS INTEGER) AS rank, trial_id, overall_average_accuracy, l.parameter, CASE WHEN setting = 'LengthChunker' THEN 'Length' ELSE setting END AS setting, coalesce(categorical, false) AS categorical FROM l LEFT JOIN c USING (parameter)
""")
def spec_curve(spark: SparkSession, d: str) -> DataFrame:
    return S.spec_curve(read_table(spark, d, "trials"), ("parser", "chunker", "k"), labels={"LengthChunker": "Length"})


@_query("""
SELECT trial_id, overall_average_accuracy, count(overall_average_accuracy) OVER w = 10 AND max(overall_average_accuracy) OVER w - min(overall_average_accuracy) OVER w < 0.3 AS stop FROM trials WHERE overall_average_accuracy IS NOT NULL WINDOW w AS (ORDER BY trial_id ROWS 9 PRECEDING)
""")
def early_stop(spark: SparkSession, d: str) -> DataFrame:
    return S.should_stop(read_table(spark, d, "trials"), spread=0.3)


@_query("""
SELECT parser, mode, round(avg(overall_average_accuracy), 6) AS mean_accuracy, count(*) AS n FROM trials GROUP BY CUBE (parser, mode)
""")
def accuracy_cube(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "trials").cube("parser", "mode").agg(F.round(F.avg("overall_average_accuracy"), 6).alias("mean_accuracy"), F.count("*").alias("n"))


_PARSED_SQL = """parsed AS (SELECT doc_name, parser, content FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_name, parser ORDER BY content IS NOT NULL DESC, parsed_at DESC NULLS LAST, parse_id DESC) AS place FROM parsed_docs) WHERE place = 1)"""
_STUB_SQL = "substring(translate(upper(md5({0})), '0123456789', 'GHIJKLMNOP'), 1, 1)"


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    """The newest content of each document by each parser; a null one only where there is no other."""
    docs = read_table(spark, d, "parsed_docs").select("doc_name", "parser", F.col("content").isNotNull().alias("there"), "parsed_at", "parse_id", "content")
    return C.newest_by(docs, ("doc_name", "parser"), ("there", "parsed_at", "parse_id")).select("doc_name", "parser", "content")


@_query(f"""
WITH {_PARSED_SQL}, p AS (SELECT doc_name, parser, query_id, replace(prompts.base_prompt, '{{context}}', coalesce(content, '')) AS prompt FROM parsed, queries WHERE prompts.base_prompt IS NOT NULL)
SELECT doc_name, parser, query_id, {_STUB_SQL.format('prompt')} AS raw_output, md5(prompt) AS digest FROM p
""")
def full_inference(spark: SparkSession, d: str) -> DataFrame:
    questions = read_table(spark, d, "queries").select("query_id", F.col("prompts.base_prompt").alias("base"))
    pairs = G.full_inference(_parsed(spark, d), questions, lambda df: G.fill_context(F.col("base"), F.col("content")))
    return pairs.select("doc_name", "parser", "query_id", G.stub_answer(F.col("prompt")).alias("raw_output"), F.md5("prompt").alias("digest"))


@_query(f"""
WITH {_PARSED_SQL}, a AS (SELECT query_id, choices, unnest(prompts.binary_prompts) AS p, generate_subscripts(prompts.binary_prompts, 1) AS i FROM queries WHERE len(prompts.binary_prompts) > 0),
s AS (SELECT doc_name, parser, query_id, i, choices[i].key AS key, {_STUB_SQL.format("replace(p, '{context}', coalesce(content, ''))")} IN ('A', 'B', 'C', 'D', 'G', 'H') AS yes FROM parsed, a)
SELECT doc_name, parser, query_id, coalesce(string_agg(key, ',' ORDER BY i) FILTER (WHERE yes), 'Z') AS raw_output FROM s GROUP BY ALL
""")
def binary_decomposition(spark: SparkSession, d: str) -> DataFrame:
    asked = read_table(spark, d, "queries").where(F.size("prompts.binary_prompts") > 0).select("query_id", "choices", F.col("prompts.binary_prompts").alias("binary_prompts"))
    yes = lambda p: F.when(G.stub_answer(p).isin("A", "B", "C", "D", "G", "H"), "A").otherwise("B")
    pairs = _parsed(spark, d).crossJoin(F.broadcast(asked))  # questions are a fixed list
    return G.binary_answers(pairs, ("doc_name", "parser", "query_id"), "binary_prompts", "choices", F.col("content"), yes)


@_query(r"""
SELECT parse_id, CAST(len(regexp_extract_all(content, '(?m)^\|[^\n]*\|[ \t\r]*$')) AS INTEGER) AS table_lines, CAST(len(regexp_extract_all(content, '(?s)\$\$.+?\$\$')) AS INTEGER) AS equations, nullif(regexp_extract(content, '^# ([^\n\r]+)', 1), '') AS title FROM parsed_docs WHERE content IS NOT NULL
""")
def markdown_structure(spark: SparkSession, d: str) -> DataFrame:
    from parsewright.sources.documents import markdown_counts

    return markdown_counts(read_table(spark, d, "parsed_docs"))


@_query()
def tei_structure(spark: SparkSession, d: str) -> DataFrame:
    from parsewright.sources.documents import tei_parts

    return tei_parts(read_table(spark, d, "parsed_docs"))


@_query(f"""
WITH w AS (SELECT doc_id, {_sql_tokens(_sql_sanitize('text', True))} AS words FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, words, unnest(range(0, CAST(greatest(0, ceil((len(words) - 500) / 450.0)) AS BIGINT) + 1)) AS i FROM w WHERE len(words) > 0),
c AS (SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, array_to_string(words[i * 450 + 1 : i * 450 + 500], ' ') AS text FROM s)
SELECT doc_id, chunk_index, md5(text) AS digest, CAST(length(text) AS INTEGER) AS n_chars, CAST(len({_sql_tokens('text')}) AS INTEGER) AS n_words FROM c
""")
def incremental_chunks(spark: SparkSession, d: str) -> DataFrame:
    from parsewright.streaming.incremental import chunk_available

    chunks = chunk_available(spark, f"{d}/documents.parquet", "doc_id", "text")
    return chunks.select("doc_id", "chunk_index", F.md5("text").alias("digest"), F.col("embedding")[0].cast("int").alias("n_chars"), F.col("embedding")[1].cast("int").alias("n_words"))
