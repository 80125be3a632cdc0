"""Named queries over the input tables, each with SQL that another engine can check it against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import codecs, crypto
from tessera.functions import text as T
from tessera.functions import vectors as V
from tessera.operators import conversation, features, quantize, retrieval, topk
from tessera.plans.tables import DOMAIN_NAMES, first_parts, named_documents, table, vector_queries
from tessera.sources import dims, search
from tessera.streaming import flush

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


# --- SQL pieces -------------------------------------------------------------------------------------

TRIM = lambda x: rf"regexp_replace(regexp_replace({x}, '\A[{T.WS}]+', ''), '[{T.WS}]+\z', '')"
CLEAN = (
    rf"regexp_replace(array_to_string(list_filter(list_transform(string_split({TRIM('text')}, chr(10)), lambda x: {TRIM('x')}), lambda x: x <> ''), ' '), "
    rf"'[^\x00-\x7F{T.WS}]', '', 'g')"
)
DOT = lambda a, b: f"list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"
L2 = lambda a, b: f"list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)))"
NORM = lambda a: f"sqrt({DOT(a, a)})"
COSINE = lambda a, b: f"{DOT(a, b)} / greatest({NORM(a)} * {NORM(b)}, 1.1920929e-07)"

# --- text and features --------------------------------------------------------------------------------


@query(f"""SELECT doc_id, c AS cleaned, CASE WHEN text IS NULL OR {TRIM("text")} = '' OR {TRIM("c")} = '' THEN 'empty_input' WHEN strlen(c) > 10000 THEN 'too_long' ELSE 'ok' END AS status
FROM (SELECT doc_id, text, {CLEAN} AS c FROM documents)""")
def clean_documents(spark, sf_dir):
    return features.cleaned(table(spark, sf_dir, "documents")).select("doc_id", "cleaned", "status")


TOKENS = rf"list_filter(regexp_split_to_array(lower(c), '[{T.WS}]+'), lambda t: t <> '')"


@query(f"""SELECT doc_id, len(t)::INT AS word_count, greatest(length(regexp_replace(c, '[^.!?]', '', 'g')), 1)::INT AS sentence_count, array_to_string(t[1:10], ' ') AS token_preview,
CASE WHEN len(t) = 0 THEN 'no_tokens' WHEN len(t) > 2000 THEN 'too_many_tokens' ELSE 'ok' END AS token_status
FROM (SELECT doc_id, c, {TOKENS} AS t FROM (SELECT doc_id, {CLEAN} AS c FROM documents))""")
def token_stats(spark, sf_dir):
    rows = features.tokenized(features.cleaned(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "word_count", "sentence_count", T.token_preview(F.col("tokens")).alias("token_preview"), "token_status")


DOMAIN_VALUES = ", ".join(f"({i}, '{n}', {m}::FLOAT, '{c}')" for i, (n, m, c) in enumerate((n, m, c) for c, held in dims.DOMAINS.items() for n, m in held.items()))
FEATURES_SQL = f"""WITH dim(i, domain, multiplier, category) AS (VALUES {DOMAIN_VALUES}),
w AS (SELECT doc_id, len({TOKENS})::INT AS word_count FROM (SELECT doc_id, {CLEAN} AS c FROM documents)),
d AS (SELECT doc_id, word_count, coalesce(domain, 'gardening') AS domain, coalesce(category, 'general') AS domain_category,
  least((word_count::FLOAT / 100::FLOAT) * coalesce(multiplier, 1::FLOAT), 5::FLOAT)::FLOAT AS complexity_score, ['Beginner', 'Intermediate', 'Advanced', 'Expert'][1 + doc_id % 4] AS proficiency
  FROM w LEFT JOIN dim ON doc_id % 65 = i),
f AS (SELECT *, least(greatest(trunc(word_count::FLOAT * 0.1::FLOAT)::INT + trunc(complexity_score * 10::FLOAT)::INT, 5), 300)::INT AS estimated_processing_time,
  CASE proficiency WHEN 'Beginner' THEN 'Detailed' WHEN 'Expert' THEN 'Brief' WHEN 'Intermediate' THEN CASE WHEN complexity_score > 3 THEN 'Comprehensive' ELSE 'Standard' END
  ELSE CASE WHEN complexity_score > 4 THEN 'Comprehensive' ELSE 'Standard' END END AS suggested_response_length,
  CASE WHEN complexity_score < 1 THEN 'simple' WHEN complexity_score < 2.5 THEN 'moderate' WHEN complexity_score < 4 THEN 'complex' ELSE 'advanced' END AS complexity_tier,
  ['novice', 'intermediate', 'advanced', 'expert'][1 + doc_id % 4] AS proficiency_level FROM d)"""
FEATURES = ["doc_id", "word_count", "domain", "domain_category", "complexity_score", "proficiency", "estimated_processing_time", "suggested_response_length", "complexity_tier", "proficiency_level"]


def _featured(spark, sf_dir):
    return features.featured(features.tokenized(features.cleaned(named_documents(spark, sf_dir))))


@query(f"{FEATURES_SQL} SELECT {', '.join(FEATURES)} FROM f")
def complexity_features(spark, sf_dir):
    return _featured(spark, sf_dir).select(*FEATURES)


@query(f"{FEATURES_SQL} SELECT domain_category, complexity_tier, proficiency_level, count(*) AS n FROM f WHERE domain = 'rust' OR domain_category = 'natural_language' GROUP BY ALL")
def search_filters(spark, sf_dir):
    rows = _featured(spark, sf_dir).withColumn("filters", features.search_filters())
    rows = rows.where((F.col("filters")["domain"] == "rust") | (F.col("filters")["domain_category"] == "natural_language"))
    return rows.groupBy("domain_category", "complexity_tier", "proficiency_level").agg(F.count(F.lit(1)).alias("n"))


@query(f"""{FEATURES_SQL} SELECT f.doc_id::VARCHAR AS id, len(t)::BIGINT AS n_tokens, domain_category, complexity_score, 1700000000::BIGINT AS created_at
FROM f JOIN (SELECT doc_id, {TOKENS} AS t FROM (SELECT doc_id, {CLEAN} AS c FROM documents)) USING (doc_id)""")
def flat_record(spark, sf_dir):
    rows = _featured(spark, sf_dir).withColumns({"vector": F.array(F.lit(0.0).cast("float")), "action": F.lit("explain"), "topic": F.lit(""), "mode": F.lit("Tutor"), "personality": F.lit("Erika")})
    out = features.record(rows, now=F.lit(1_700_000_000), ident=F.col("doc_id").cast("string"))
    return out.select("id", F.col("word_count").alias("n_tokens"), "domain_category", "complexity_score", "created_at")


@query("""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'Tutor' WHEN 1 THEN 'Assistant' END AS mode, CASE doc_id % 6 WHEN 0 THEN 'Beginner' WHEN 1 THEN 'Intermediate' WHEN 2 THEN 'Advanced' WHEN 3 THEN 'Expert' END AS proficiency,
CASE doc_id % 6 WHEN 0 THEN 'Erika' WHEN 1 THEN 'Aurora' WHEN 2 THEN 'Ekaterina' WHEN 3 THEN 'Viktor' END AS personality, CASE WHEN doc_id % 6 > 3 THEN 'invalid' ELSE 'ok' END AS status FROM documents""")
def enum_decode(spark, sf_dir):
    code = F.pmod("doc_id", F.lit(6))
    named = table(spark, sf_dir, "documents").select("doc_id", dims.decoded(code, dims.MODES).alias("mode"), dims.decoded(code, dims.PROFICIENCIES).alias("proficiency"), dims.decoded(code, dims.PERSONALITIES).alias("personality"))
    return named.withColumn("status", F.when(F.col("personality").isNull(), "invalid").otherwise("ok"))


@query(f"""SELECT conv_id, turn, CASE WHEN starts_with(x, '/') THEN 'command' ELSE 'chat' END AS kind, CASE WHEN starts_with(x, '/') THEN {TRIM("substr(x, 2)")} ELSE x END AS arg
FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '/ ' || text || ' ' ELSE text END AS x FROM conversations)""")
def parse_task(spark, sf_dir):
    said = F.when(F.pmod("turn", F.lit(3)) == 0, F.concat(F.lit("/ "), F.col("text"), F.lit(" "))).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.parse_task(said).alias("task")).select("conv_id", "turn", "task.kind", "task.arg")


# --- conversations --------------------------------------------------------------------------------------

PAIRS_SQL = """WITH n AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS next_role, lead(text) OVER w AS output FROM conversations WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
pairs AS (SELECT conv_id, turn, text AS input, output FROM n WHERE role = 'user' AND next_role = 'assistant')"""


@query(f"{PAIRS_SQL} SELECT * FROM pairs")
def turn_pairs(spark, sf_dir):
    return conversation.turn_pairs(table(spark, sf_dir, "conversations"))


@query(f"{PAIRS_SQL} SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 20")
def history_window(spark, sf_dir):
    return conversation.history(turn_pairs(spark, sf_dir))


@query(f"{PAIRS_SQL} SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2")
def history_window_2(spark, sf_dir):
    return conversation.history(turn_pairs(spark, sf_dir), 2)


@query(f"{PAIRS_SQL} SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id ORDER BY turn ROWS 1 PRECEDING)::INT AS held FROM pairs")
def rolling_state(spark, sf_dir):
    return conversation.rolling(turn_pairs(spark, sf_dir), 2).select("conv_id", "turn", F.size("window").alias("held"))


CHAT_SQL = """SELECT conv_id, arg_min(text, turn) FILTER (WHERE role = 'system') AS system, arg_max(text, turn) FILTER (WHERE role = 'user') AS "user" FROM conversations GROUP BY conv_id"""


@query(f"""SELECT conv_id, system, "user", CASE WHEN "user" IS NULL THEN 'no_user_message' ELSE 'ok' END AS status FROM ({CHAT_SQL})""")
def chat_selection(spark, sf_dir):
    return conversation.chat_selection(table(spark, sf_dir, "conversations"))


@query(f"""SELECT conv_id, CASE WHEN coalesce(system, '') <> '' THEN '<|im_start|>system' || chr(10) || system || '<|im_end|>' || chr(10) ELSE '' END || '<|im_start|>user' || chr(10) || "user" || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS prompt FROM ({CHAT_SQL})""")
def chatml_prompt(spark, sf_dir):
    return chat_selection(spark, sf_dir).select("conv_id", conversation.chat_prompt(F.col("system"), F.col("user")).alias("prompt"))


@query("SELECT conv_id, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id")
def latest_payload(spark, sf_dir):
    return conversation.latest(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


def _numbered_pairs(spark, sf_dir):
    return turn_pairs(spark, sf_dir).select((F.col("conv_id") * 1000 + F.col("turn")).alias("pair_id"), "input", "output", (F.lit(1_700_000_000_999) + F.col("turn") * 1000).alias("output_ts_ms"))


@query(f"""{PAIRS_SQL} SELECT conv_id * 1000 + turn AS pair_id, s.side::INT AS side, (1700000000999 + turn * 1000) // 1000 AS "timestamp", strlen(CASE s.side WHEN 0 THEN input ELSE output END)::INT AS content_bytes FROM pairs, (VALUES (0), (1)) s(side)""")
def flush_records(spark, sf_dir):
    records = conversation.flush_records(_numbered_pairs(spark, sf_dir))
    return records.select("pair_id", "side", "timestamp", F.octet_length(F.get_json_object(F.col("payload").cast("string"), "$.content")).alias("content_bytes"))


# --- vectors ------------------------------------------------------------------------------------------


def _topk_sql(score: str, where: str = "") -> str:
    return f"""SELECT query_id, rank, vec_id, score FROM (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM (
    SELECT q.vec_id AS query_id, e.vec_id, round({score}, 6) AS score FROM embeddings q JOIN embeddings e ON q.vec_id % 100 = 0 {where})) WHERE rank <= 5"""


def _search(spark, sf_dir, metric, same=None):
    rows = table(spark, sf_dir, "embeddings")
    return topk.nearest(vector_queries(rows), rows, retrieval.TOP_K, metric, same)


@query(_topk_sql(COSINE("q.embedding", "e.embedding")))
def cosine_topk(spark, sf_dir):
    return _search(spark, sf_dir, "cosine")


@query(_topk_sql(DOT("q.embedding", "e.embedding")))
def dot_topk(spark, sf_dir):
    return _search(spark, sf_dir, "dot")


@query(_topk_sql(f"0 - sqrt({L2('q.embedding', 'e.embedding')})"))
def l2_topk(spark, sf_dir):
    return _search(spark, sf_dir, "l2")


@query(_topk_sql(COSINE("q.embedding", "e.embedding"), "AND q.label = e.label"))
def filtered_topk(spark, sf_dir):
    return _search(spark, sf_dir, "cosine", F.col("label") == F.col("query_label"))


@query(f"""SELECT query_id, vec_id, distance FROM (SELECT q.vec_id AS query_id, e.vec_id, round(sqrt({L2("q.embedding", "e.embedding")}), 6) AS distance FROM embeddings q JOIN embeddings e ON q.vec_id % 100 = 0) WHERE distance <= 1.1""")
def radius_search(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return topk.within(vector_queries(rows), rows, 1.1)


@query(f"""SELECT vec_id, round(n1, 6) AS centred_norm, round(sqrt(list_sum(list_transform(v, lambda x: (x / s / (n2 + 1e-12)) * (x / s / (n2 + 1e-12))))), 6) AS out_norm, round(v[1] / s / (n2 + 1e-12), 6) AS first FROM (
SELECT *, sqrt(list_sum(list_transform(v, lambda x: (x / s) * (x / s)))) AS n2 FROM (SELECT vec_id, v, {NORM("v")} AS n1, sqrt({DOT("v", "v")} + 1e-12) AS s FROM (
SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE - m) AS v FROM (SELECT vec_id, embedding, list_sum(list_transform(embedding, lambda x: x::DOUBLE)) / len(embedding) AS m FROM embeddings))))""")
def vector_preprocess(spark, sf_dir):
    e = F.col("embedding")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", V.norm(V.mean_center(e)).alias("n"), V.preprocess(e).alias("p"))
    return rows.select("vec_id", F.round("n", 6).alias("centred_norm"), F.round(V.norm(F.col("p")), 6).alias("out_norm"), F.round(F.col("p")[0], 6).alias("first"))


@query("""SELECT vec_id, vec_id & 1 <> 0 AS immutable, vec_id & 2 <> 0 AS hot_path, CASE WHEN vec_id = 0 THEN 'zero_id' ELSE 'ok' END AS id_status, CASE WHEN len(embedding) % 48 <> 0 THEN 'not_divisible' ELSE 'ok' END AS dim_status FROM embeddings""")
def value_checks(spark, sf_dir):
    ident = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", V.has_flag(ident, V.IMMUTABLE).alias("immutable"), V.has_flag(ident, V.HOT_PATH).alias("hot_path"), V.vector_id_status(ident).alias("id_status"), V.vector_status(F.col("embedding"), 48).alias("dim_status")
    )


# --- retrieval ------------------------------------------------------------------------------------------

#: Replies of a web search: three topics per query, the second without a text.
WEB_JSON = """'{"RelatedTopics":[{"Text":"topic ' || %s || '"},{"Name":"none"},{"Text":"note ' || (%s // 100) %% 7 || '"}]}'"""


def _replies(queries: DataFrame) -> DataFrame:
    q = F.col("query_id").cast("string")
    body = F.concat(F.lit('{"RelatedTopics":[{"Text":"topic '), q, F.lit('"},{"Name":"none"},{"Text":"note '), F.expr("(query_id div 100) % 7").cast("string"), F.lit('"}]}'))
    return queries.select("query_id", body.alias("json"))


WEB_SQL = """SELECT query_id, 0.5::DOUBLE AS score, content, 'web' AS source, 2 AS src_ord, pos FROM (
SELECT vec_id AS query_id, t.pos, CASE t.pos WHEN 1 THEN 'topic ' || vec_id WHEN 3 THEN 'note ' || (vec_id // 100) % 7 END AS content FROM embeddings, (VALUES (1), (2), (3)) t(pos) WHERE vec_id % 100 = 0) WHERE content IS NOT NULL"""


@query(WEB_SQL)
def web_topics(spark, sf_dir):
    return search.web_source(_replies(vector_queries(table(spark, sf_dir, "embeddings"))), retrieval.TOP_K)


def _answers(spark, sf_dir):
    """Odd vectors pair up as cache entries, even ones are memory; contents repeat across both."""
    rows, k = table(spark, sf_dir, "embeddings"), retrieval.TOP_K
    queries = vector_queries(rows).select("query_id", "query")
    content = F.concat(F.lit("note "), (F.expr("vec_id div 2") % 7).cast("string"), F.lit(" of "), F.col("label").cast("string"))
    odd = rows.where(F.pmod("vec_id", F.lit(2)) == 1)
    entries = odd.select(F.expr("vec_id div 2").alias("pos"), content.alias("input"), F.col("embedding").alias("input_vec"), F.concat(content, F.lit("!")).alias("output"), F.transform("embedding", lambda x: -x).alias("output_vec"))
    memory = rows.where(F.pmod("vec_id", F.lit(2)) == 0).select(F.col("vec_id").alias("rec_id"), F.col("embedding").alias("vector"), content.cast("binary").alias("payload"))
    return [search.cache_source(queries, entries, k), search.memory_source(queries, memory, k), search.web_source(_replies(queries), k)]


ANSWERS_SQL = f"""WITH q AS (SELECT vec_id AS query_id, embedding AS query FROM embeddings WHERE vec_id % 100 = 0),
e AS (SELECT vec_id, embedding, 'note ' || (vec_id // 2) % 7 || ' of ' || label AS content FROM embeddings),
c AS (SELECT query_id, round({COSINE("query", "embedding")}, 6) AS score, content, vec_id - 1 AS place FROM q, e WHERE vec_id % 2 = 1
      UNION ALL SELECT query_id, round({COSINE("query", "list_transform(embedding, lambda x: -x)")}, 6), content || '!', vec_id FROM q, e WHERE vec_id % 2 = 1),
cache AS (SELECT query_id, score, content, 'cache' AS source, 0 AS src_ord, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, place) AS pos FROM c WHERE score > 0 QUALIFY pos <= 5),
memory AS (SELECT query_id, round({COSINE("query", "embedding")}, 6) AS score, content, 'memory' AS source, 1 AS src_ord, row_number() OVER (PARTITION BY query_id ORDER BY round({COSINE("query", "embedding")}, 6) DESC, vec_id) AS pos FROM q, e WHERE vec_id % 2 = 0 QUALIFY pos <= 5),
al AS (SELECT * FROM cache UNION ALL SELECT * FROM memory UNION ALL {WEB_SQL}),
merged AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, src_ord, pos)::INT AS rank FROM (SELECT * FROM al QUALIFY row_number() OVER (PARTITION BY query_id, content ORDER BY src_ord, pos) = 1))"""


@query(f"{ANSWERS_SQL} SELECT query_id, rank, score, content, source FROM merged")
def retrieval_merge(spark, sf_dir):
    return retrieval.reranked(retrieval.merged(_answers(spark, sf_dir))).select("query_id", "rank", "score", "content", "source")


def _block(source: str, title: str) -> str:
    return f"coalesce('## {title}' || chr(10) || string_agg('- ' || content || chr(10), '' ORDER BY rank) FILTER (WHERE source = '{source}') || chr(10), '')"


@query(f"""{ANSWERS_SQL} SELECT query_id, '{retrieval.BASE_SYSTEM}' || chr(10) || chr(10) || 'Persona: Erika' || chr(10) || chr(10) || {" || ".join(_block(s, t) for s, t in retrieval.BLOCKS)} AS prompt FROM merged GROUP BY query_id""")
def prompt_blocks(spark, sf_dir):
    return retrieval.prompts(_answers(spark, sf_dir), retrieval.persona_system(F.lit("Erika")))


@query()
def semantic_search(spark, sf_dir):
    """Benchmark items against all documents, by the default hashed embedding: every document ranked for every item."""
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    return topk.nearest_texts(queries, texts)


# --- replies ----------------------------------------------------------------------------------------------

FENCED = "CASE turn % 3 WHEN 0 THEN '```' || chr(10) || text || chr(10) || '```' WHEN 1 THEN ' ``````' || text || '``` ' ELSE text END"


def _fenced():
    t, mark = F.col("text"), F.pmod("turn", F.lit(3))
    return F.when(mark == 0, F.concat(F.lit("```\n"), t, F.lit("\n```"))).when(mark == 1, F.concat(F.lit(" ``````"), t, F.lit("``` "))).otherwise(t)


@query(rf"""SELECT conv_id, turn, {TRIM(rf"regexp_replace(regexp_replace({TRIM(FENCED)}, '\A(```)+', ''), '(```)+\z', '')")} AS reply FROM conversations""")
def post_clean(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.clean_reply(_fenced()).alias("reply"))


@query("""SELECT conv_id, turn, CASE WHEN strlen(r) > 4096 THEN 'response too long' WHEN contains(r, '<script>') THEN 'unsafe html' ELSE 'ok' END AS status
FROM (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN text || '<script>' WHEN 1 THEN repeat(text, 40) WHEN 2 THEN text || '<SCRIPT>' ELSE text END AS r FROM conversations)""")
def post_validate(spark, sf_dir):
    t, mark = F.col("text"), F.pmod("turn", F.lit(4))
    reply = F.when(mark == 0, F.concat(t, F.lit("<script>"))).when(mark == 1, F.repeat(t, 40)).when(mark == 2, F.concat(t, F.lit("<SCRIPT>"))).otherwise(t)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.reply_status(reply).alias("status"))


@query("""SELECT conv_id, turn, 'Assistant: [2024-01-02T03:04:05] ' || CASE conv_id % 4 WHEN 0 THEN '*giggles* ' WHEN 3 THEN '[stern] ' ELSE '' END || text AS reply FROM conversations""")
def persona_apply(spark, sf_dir):
    name = dims.decoded(F.pmod("conv_id", F.lit(4)), dims.PERSONALITIES)
    at = F.lit("2024-01-02 03:04:05").cast("timestamp")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.wrap_reply(T.stamp_reply(at, T.persona_reply(name, F.col("text")))).alias("reply"))


@query(r"""SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN trim(text) ELSE text END AS reply FROM conversations""")
def post_interpret(spark, sf_dir):
    t = F.col("text")
    fenced = F.when(F.pmod("turn", F.lit(2)) == 0, F.concat(F.lit("```json\n"), t, F.lit("\n```"))).otherwise(t)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.interpret_reply(fenced).alias("reply"))


# --- dimensions -------------------------------------------------------------------------------------------


@query("""SELECT * FROM (VALUES ('Erika', true, true, true, 'Well, that was quite the strategic decision, wasn''t it?', 0.7::DOUBLE, 0.9::DOUBLE), ('Aurora', true, true, false, 'Probability calculated. Risk adjusted. Alpha delivered.', 0.3, 0.8),
('Ekaterina', true, false, true, 'I design the future of time—and you merely watch in awe.', 0.8, 0.9), ('Viktor', true, true, false, 'Stack overflow contained. Heap rebalanced.', 0.3, 0.7)) t(name, is_formal, is_direct, supports_humor, catchphrase, temperature, top_p)""")
def persona_flags(spark, sf_dir):
    return dims.persona_flags(dims.persona_dim(spark))


@query("SELECT * FROM (VALUES ('Erika', 8), ('Aurora', 7), ('Ekaterina', 7), ('Viktor', 7)) t(name, n_areas)")
def expertise_areas(spark, sf_dir):
    return dims.expertise(dims.persona_dim(spark)).select("name", F.size("areas").alias("n_areas"))


TEXT_VALUES = ", ".join(f"('{lang}', '{key}', '{text}')" for lang, held in dims.TEXTS.items() for key, text in held.items())


@query(f"""WITH d(lang, key, text) AS (VALUES {TEXT_VALUES}), r AS (SELECT doc_id, lang, ['light', 'dark', 'assistant', 'tutor', 'beginner', 'expert', 'nothing'][1 + doc_id % 7] AS key FROM documents)
SELECT r.doc_id, r.lang, r.key, coalesce(d.text, r.key) AS text FROM r LEFT JOIN d ON d.key = r.key AND d.lang = CASE WHEN r.lang IN ('en', 'de', 'es', 'fr', 'it', 'pt') THEN r.lang ELSE 'en' END""")
def i18n_lookup(spark, sf_dir):
    keys = F.array(*[F.lit(k) for k in ("light", "dark", "assistant", "tutor", "beginner", "expert", "nothing")])
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", F.get(keys, F.pmod("doc_id", F.lit(7)).cast("int")).alias("key"))
    return dims.translate(rows, dims.text_dim(spark))


# --- quantization -------------------------------------------------------------------------------------------

M, SUB, K = 8, 8, 16


def _book(rows: DataFrame) -> quantize.Codebook:
    return quantize.Codebook([first_parts(rows, K, SUB)], M)


PQ_SQL = f"""WITH c AS (SELECT vec_id AS k, embedding[1:8] AS cent FROM embeddings WHERE vec_id < {K}),
s AS (SELECT vec_id, m, embedding[m * 8 + 1 : m * 8 + 8] AS sub FROM embeddings, range({M}) t(m)),
codes AS (SELECT vec_id, m, k::SMALLINT AS code, cent FROM s, c QUALIFY row_number() OVER (PARTITION BY vec_id, m ORDER BY {L2("sub", "cent")}, k) = 1)"""


@query(f"{PQ_SQL} SELECT vec_id, m::INT AS m, code::INT AS code FROM codes")
def pq_encode(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return rows.select("vec_id", F.posexplode(quantize.encode(F.col("embedding"), _book(rows))).alias("m", "code")).withColumn("code", F.col("code").cast("int"))


@query(f"{PQ_SQL} SELECT vec_id, round(sum(list_sum(list_transform(cent, lambda x: x::DOUBLE))), 5) AS total, round(arg_min(cent[1]::DOUBLE, m), 6) AS first FROM codes GROUP BY vec_id")
def pq_decode(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    book = _book(rows)
    back = rows.select("vec_id", quantize.decode(quantize.encode(F.col("embedding"), book), book).alias("v"))
    return back.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 5).alias("total"), F.round(F.col("v")[0], 6).alias("first"))


@query(f"""{PQ_SQL}, q AS (SELECT vec_id AS query_id, m, embedding[m * 8 + 1 : m * 8 + 8] AS sub FROM embeddings, range({M}) t(m) WHERE vec_id % 100 = 0),
d AS (SELECT query_id, vec_id, round(sum({L2("sub", "cent")}), 6) AS distance FROM q JOIN codes USING (m) GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INT AS rank, vec_id, distance FROM d QUALIFY rank <= 5""")
def pq_adc_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    book = _book(rows)
    queries = vector_queries(rows).select("query_id", quantize.lookup_table(F.col("query"), book).alias("lut"))
    coded = rows.select("vec_id", quantize.encode(F.col("embedding"), book).alias("codes"))
    scored = topk.pairs(queries, coded).select("query_id", "vec_id", F.round(quantize.table_distance(F.col("lut"), F.col("codes"), M), 6).alias("distance"))
    return topk.best(scored, retrieval.TOP_K, [F.asc("distance"), F.asc("vec_id")]).select("query_id", "rank", "vec_id", "distance")


STEP_SQL = f"""WITH c AS (SELECT vec_id AS k, embedding AS cent FROM embeddings WHERE vec_id < 8),
p AS (SELECT vec_id, embedding, k::INT AS k FROM embeddings, c QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY {L2("embedding", "cent")}, c.k) = 1)"""


def _starts(rows: DataFrame, count: int = 8) -> list[list[float]]:
    return first_parts(rows, count, 64)


@query(f"{STEP_SQL} SELECT k, count(*) AS n, round(avg(embedding[1]::DOUBLE), 6) AS first, round(avg(embedding[64]::DOUBLE), 6) AS last FROM p GROUP BY k")
def kmeans_step(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    step = quantize.kmeans_step(rows, _starts(rows))
    return step.select("k", "n", F.round(F.col("centroid")[0], 6).alias("first"), F.round(F.element_at("centroid", -1), 6).alias("last"))


@query()
def kmeans_fit(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    model = quantize.kmeans(rows, 8, start=_starts(rows))
    return spark.createDataFrame([(i, n, c) for i, (n, c) in enumerate(zip(model.counts, model.centroids))], "k int, n int, centroid array<double>")


@query("""SELECT i::INT AS i, j::INT AS j, round(covar_pop(embedding[i + 1]::DOUBLE, embedding[j + 1]::DOUBLE), 6) + 0.0 AS cov FROM embeddings, range(64) a(i), range(64) b(j) WHERE i <= j GROUP BY i, j""")
def pca_cov(spark, sf_dir):
    return quantize.covariance(table(spark, sf_dir, "embeddings"), 64).withColumn("cov", F.round("cov", 6) + F.lit(0.0))


@query(f"{STEP_SQL} SELECT k AS centroid, vec_id AS id, row_number() OVER (PARTITION BY k ORDER BY vec_id) - 1 AS \"offset\" FROM p")
def ivf_list(spark, sf_dir):
    from tessera.sources.store import index_entries

    rows = table(spark, sf_dir, "embeddings")
    return index_entries(quantize.placed(rows, _starts(rows))).select("centroid", "id", "offset")


@query(f"""{STEP_SQL}, a AS (SELECT vec_id AS query_id, embedding AS query, k FROM embeddings, c WHERE vec_id % 100 = 0 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY {L2("embedding", "cent")}, c.k) <= 3),
d AS (SELECT query_id, vec_id, round({L2("query", "embedding")}, 6) AS distance FROM a JOIN p ON a.k = p.k)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INT AS rank, vec_id, distance FROM d QUALIFY rank <= 5""")
def ivf_search(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return quantize.search_lists(quantize.placed(rows, _starts(rows)), vector_queries(rows).drop("query_label"), _starts(rows), 3, retrieval.TOP_K)


@query()
def pq_trained(spark, sf_dir):
    """A codebook trained on all vectors: codes and squared reconstruction error of each."""
    rows = table(spark, sf_dir, "embeddings")
    book = quantize.train_codebook(rows, 64, M, bits=4, max_iters=10)
    coded = rows.select("vec_id", "embedding", quantize.encode(F.col("embedding"), book).alias("codes"))
    return coded.select("vec_id", "codes", F.round(V.l2_squared(F.col("embedding"), quantize.decode(F.col("codes"), book)), 6).alias("error"))


@query()
def pca_project(spark, sf_dir):
    """The four leading principal components of all vectors."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select("vec_id", F.transform(quantize.project(F.col("embedding"), quantize.pca(rows, 4)), lambda x: F.round(x, 6)).alias("components"))


# --- codecs -------------------------------------------------------------------------------------------------


@query("""WITH r AS (SELECT user_id, event_id, event_type AS value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS g FROM events)
SELECT user_id, value, min(event_id) AS run_start, count(*) AS length FROM r GROUP BY user_id, value, g""")
def rle_runs(spark, sf_dir):
    return codecs.runs(table(spark, sf_dir, "events"), "event_id", "event_type", ["user_id"])


@query("""WITH l AS (SELECT l_orderkey, l_linenumber AS v, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS i FROM lineitem WHERE l_linenumber <= 15),
b AS (SELECT l_orderkey, i // 2 AS byte, sum(v * CASE WHEN i % 2 = 0 THEN 1 ELSE 16 END)::INT AS x FROM l GROUP BY ALL)
SELECT l_orderkey, string_agg(printf('%02x', x), '' ORDER BY byte) AS packed FROM b GROUP BY l_orderkey""")
def bitpack4(spark, sf_dir):
    held = table(spark, sf_dir, "lineitem").where("l_linenumber <= 15").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("v"))
    return held.select("l_orderkey", T.to_hex(codecs.pack_bits_sql(F.col("v"), 4)).alias("packed"))


@query("""WITH b AS (SELECT ascii(unnest(string_split(regexp_replace(event_type, '', ''), '')))::INT AS byte FROM events), f AS (SELECT byte, count(*) AS freq FROM b GROUP BY byte)
SELECT byte, freq, coalesce(sum(freq) OVER (ORDER BY byte ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS cum FROM f""")
def byte_histogram(spark, sf_dir):
    return codecs.byte_histogram(table(spark, sf_dir, "events"), "event_type")


def _round_trip(name: str, source: str, key: str, column: str):
    def run(spark, sf_dir):
        packed = table(spark, sf_dir, source).select(key, codecs.codec_udf(name)(F.col(column).cast("binary")).alias("p"))
        return packed.select(key, codecs.codec_udf(name, decode=True)("p").cast("string").alias(column))

    run.__name__ = f"{name}_round_trip"
    return query(f"SELECT {key}, {column} FROM {source}")(run)


for _name in ("zstd", "huffman", "ans12", "ans14", "rle"):
    _round_trip(_name, "documents", "doc_id", "text")


@query("SELECT doc_id, text, true AS smaller FROM documents")
def codec_best(spark, sf_dir):
    packed = table(spark, sf_dir, "documents").select("doc_id", "text", codecs.smallest_udf()(F.col("text").cast("binary")).alias("p"))
    zstd = F.octet_length(codecs.codec_udf("zstd")(F.col("text").cast("binary")))
    return packed.select("doc_id", codecs.expand_udf()("p.codec", "p.bytes").cast("string").alias("text"), (F.octet_length("p.bytes") <= zstd).alias("smaller"))


# --- encryption -----------------------------------------------------------------------------------------------

KEY = bytes(range(32))


@query("SELECT c_custkey, c_name, strlen(c_name) + 16 AS sealed_bytes FROM customer")
def aes_round_trip(spark, sf_dir):
    sealed = table(spark, sf_dir, "customer").withColumn("nonce", crypto.counter_nonce(F.col("c_custkey"))).withColumn("s", crypto.aes_seal(F.col("c_name").cast("binary"), KEY, F.col("nonce")))
    return sealed.select("c_custkey", crypto.aes_open(F.col("s"), KEY, F.col("nonce")).cast("string").alias("c_name"), F.octet_length("s").cast("long").alias("sealed_bytes"))


@query("SELECT c_custkey, c_name, strlen(c_name) + 16 AS sealed_bytes FROM customer")
def chacha_round_trip(spark, sf_dir):
    sealed = table(spark, sf_dir, "customer").withColumn("nonce", crypto.counter_nonce(F.col("c_custkey"))).withColumn("s", crypto.chacha_udf(KEY)(F.col("c_name").cast("binary"), F.col("nonce")))
    return sealed.select("c_custkey", crypto.chacha_udf(KEY, decrypt=True)("s", "nonce").cast("string").alias("c_name"), F.octet_length("s").cast("long").alias("sealed_bytes"))


@query("SELECT c_custkey, lower(hex(encode(c_name))) AS hexed, c_name AS back, NULL::VARCHAR AS odd FROM customer")
def hex_codec(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", T.to_hex(F.col("c_name").cast("binary")).alias("hexed"))
    return rows.select("c_custkey", "hexed", T.from_hex(F.col("hexed")).cast("string").alias("back"), T.from_hex(F.concat("hexed", F.lit("a"))).cast("string").alias("odd"))


@query()
def hkdf_subkeys(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", T.to_hex(crypto.subkey_udf(KEY)(F.col("c_name").cast("binary"))).alias("subkey"))


@query("SELECT c_custkey, lpad(lower(printf('%x', c_custkey)), 24, '0') AS nonce FROM customer")
def nonce_counter(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", T.to_hex(crypto.counter_nonce(F.col("c_custkey"))).alias("nonce"))


@query(f"{PQ_SQL} SELECT vec_id, string_agg(printf('%02x', code::INT), '' ORDER BY m) AS codes FROM codes GROUP BY vec_id")
def pack_unpack_vector(spark, sf_dir):
    """Quantize, compress, encrypt and all of it back to the codes."""
    rows = table(spark, sf_dir, "embeddings")
    codes = quantize.encode(F.col("embedding"), _book(rows))
    raw = F.unhex(F.array_join(F.transform(codes, lambda c: F.lpad(F.hex(c.cast("long")), 2, "0")), ""))
    sealed = rows.select("vec_id", crypto.counter_nonce(F.col("vec_id")).alias("nonce"), codecs.codec_udf("zstd")(raw).alias("z"))
    sealed = sealed.select("vec_id", "nonce", crypto.chacha_udf(KEY)("z", "nonce").alias("s"))
    return sealed.select("vec_id", T.to_hex(codecs.codec_udf("zstd", decode=True)(crypto.chacha_udf(KEY, decrypt=True)("s", "nonce"))).alias("codes"))


# --- ingest -------------------------------------------------------------------------------------------------

CAPACITY, TTL = 5, 86_400.0


@query("SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 5 AS flush_id FROM events")
def cache_flush_capacity(spark, sf_dir):
    return flush.by_capacity(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], CAPACITY).select("user_id", "event_id", "flush_id")


FLUSH_SQL = """WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
f AS (SELECT user_id, event_id, rn, t, 0::BIGINT AS flush_id, false AS fires, 0::BIGINT AS nflush, 1 AS nheld, t AS nlast FROM o WHERE rn = 1
UNION ALL SELECT o.user_id, o.event_id, o.rn, o.t, f.nflush, f.nheld + 1 >= 5 OR o.t - f.nlast >= 86400, CASE WHEN f.nheld + 1 >= 5 OR o.t - f.nlast >= 86400 THEN f.nflush + 1 ELSE f.nflush END,
 CASE WHEN f.nheld + 1 >= 5 OR o.t - f.nlast >= 86400 THEN 0 ELSE f.nheld + 1 END, CASE WHEN f.nheld + 1 >= 5 OR o.t - f.nlast >= 86400 THEN o.t ELSE f.nlast END FROM f JOIN o ON o.user_id = f.user_id AND o.rn = f.rn + 1)"""


@query(f"""{FLUSH_SQL} SELECT user_id, event_id, flush_id, CASE WHEN NOT bool_or(fires) OVER (PARTITION BY user_id, flush_id) THEN 'manual' WHEN fires THEN 'flush' ELSE 'hold' END AS "trigger" FROM f""")
def cache_flush_ttl(spark, sf_dir):
    return flush.by_capacity_or_age(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", CAPACITY, TTL)


@query("""WITH RECURSIVE a AS (SELECT user_id, flush_id, max(t) AS arrival FROM (SELECT user_id, epoch_us(ts) // 1000000 AS t, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 5 AS flush_id FROM events) GROUP BY ALL),
d AS (SELECT user_id, flush_id, arrival, arrival + 1 AS done FROM a WHERE flush_id = 0 UNION ALL SELECT a.user_id, a.flush_id, a.arrival, greatest(a.arrival, d.done) + 1 FROM d JOIN a ON a.user_id = d.user_id AND a.flush_id = d.flush_id + 1)
SELECT user_id, flush_id, arrival, done FROM d""")
def flusher_done(spark, sf_dir):
    batches = cache_flush_capacity(spark, sf_dir).join(table(spark, sf_dir, "events").select("event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("t")), "event_id")
    arrivals = batches.groupBy("user_id", "flush_id").agg(F.max("t").alias("arrival"))
    return flush.serial_done(arrivals, "user_id", "arrival", "flush_id")


assert len(DOMAIN_NAMES) == 64
