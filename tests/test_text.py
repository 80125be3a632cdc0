from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import conversation, features, retrieval
from tessera.sources import dims


def col(spark, values, expr, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in rows.orderBy("i").select(expr(F.col("x"))).collect()]


def test_clean(spark):
    got = col(spark, ["", "   ", "éé", "a\r\n\r\n  b  c \n", "x y　z é", None], T.clean)
    assert got == ["", "", "", "a b  c", "x y　z ", None]
    status = col(spark, ["", "éé", "a" * 10_000, "a" * 10_001, None], lambda x: T.clean_status(x, T.clean(x)))
    assert status == ["empty_input", "empty_input", "ok", "too_long", "empty_input"]


def test_tokens(spark):
    assert col(spark, ["Hello  World", "", "a"], lambda x: F.size(T.tokens(x))) == [2, 0, 1]
    assert col(spark, ["none", "...", "a. b! c?"], T.sentence_count) == [1, 3, 3]
    assert col(spark, [0, 2000, 2001], T.token_status, "int") == ["no_tokens", "ok", "too_many_tokens"]


def test_tasks_and_replies(spark):
    assert [tuple(r) for r in col(spark, ["/", "/ help ", " /x"], T.parse_task)] == [("command", ""), ("command", "help"), ("chat", " /x")]
    assert col(spark, ["```\nhello\n```", "``````a", "plain"], T.clean_reply) == ["hello", "a", "plain"]
    assert col(spark, ["safe text", "<script>alert()</script>", "<SCRIPT>", "é" * 2048, "é" * 2049], T.reply_status) == ["ok", "unsafe html", "ok", "ok", "response too long"]
    assert col(spark, ["hi"], lambda x: T.persona_reply(F.lit("Erika"), x)) == ["*giggles* hi"]
    assert col(spark, ["```json\n{}\n```", "x"], T.interpret_reply) == ["{}", "x"]
    assert col(spark, ['{"action":"write","domain":"rust","topic":"x"}<end>', "no"], T.analysis_answer)[0].domain == "rust"
    assert col(spark, ["a b&c"], T.url_encoded) == ["a%20b%26c"]
    assert col(spark, ["pt-BR", "ja"], T.locale_language) == ["pt", "en"]


def test_hex(spark):
    assert col(spark, ["6A6b", "abc", "zz", ""], T.from_hex) == [b"jk", None, None, b""]
    assert col(spark, [b"abc"], lambda x: T.zero_pad(x, 4), "binary") == [b"abc\x00"]


def test_features(spark):
    rows = spark.createDataFrame([(4, "C++", "Beginner"), (1000, "rust", "Expert"), (200, "nothing", "Intermediate"), (140, "sql", "Advanced")], "word_count int, domain string, proficiency string")
    got = {r.domain: r for r in features.featured(rows).collect()}
    assert abs(got["C++"].complexity_score - 0.1) < 1e-6 and got["C++"].complexity_tier == "simple" and got["C++"].suggested_response_length == "Detailed"
    assert got["rust"].complexity_score == 5.0 and got["rust"].estimated_processing_time == 150 and got["rust"].proficiency_level == "expert"
    assert got["nothing"].domain_category == "general" and got["nothing"].suggested_response_length == "Standard"


def test_prompt_and_merge(spark):
    row = "query_id long, score double, content string, source string, src_ord int, pos int"
    cache = spark.createDataFrame([(1, 0.5, "same", "cache", 0, 1)], row)
    memory = spark.createDataFrame([(1, 0.9, "same", "memory", 1, 1), (1, 0.9, "m1", "memory", 1, 2)], row)
    merged = {(r.content, r.source, r.score) for r in retrieval.merged([cache, memory]).collect()}
    assert merged == {("same", "cache", 0.5), ("m1", "memory", 0.9)}
    only = memory.where("content = 'm1'")
    assert retrieval.prompts([only], F.lit("sys")).first().prompt == "sys\n\n## Memory\n- m1\n\n"


def test_conversation(spark):
    turns = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "a"), (1, 2, "assistant", "b"), (1, 3, "user", "c"), (2, 0, "system", "x")], "conv_id long, turn long, role string, text string")
    assert [(r.input, r.output) for r in conversation.turn_pairs(turns).collect()] == [("a", "b")]
    got = {r.conv_id: r for r in conversation.chat_selection(turns).collect()}
    assert (got[1].system, got[1].user, got[2].status) == ("s", "c", "no_user_message")


def test_dims(spark):
    flags = {r.name: r for r in dims.persona_flags(dims.persona_dim(spark)).collect()}
    assert flags["Aurora"].temperature == 0.3 and not flags["Aurora"].supports_humor and flags["Erika"].is_formal and flags["Viktor"].is_direct
    asked = spark.createDataFrame([("erika",), ("nonexistent",)], "persona string")
    found = {r.persona: r.name for r in dims.find_persona(asked, dims.persona_dim(spark)).collect()}
    assert found == {"erika": "Erika", "nonexistent": None}
    rows = spark.createDataFrame([("de", "light"), ("xx", "light"), ("de", "zzz")], "lang string, key string")
    assert sorted(r.text for r in dims.translate(rows, dims.text_dim(spark)).collect()) == ["Hell", "Light", "zzz"]
