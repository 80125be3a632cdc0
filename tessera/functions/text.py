"""Text cleaning, tokenizing, routing and reply polishing as Column expressions.

Blank means Unicode White_Space throughout; lengths are UTF-8 bytes. A bad row never fails a job: it
gets a status and nulls behind it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode White_Space, as a regular-expression class body.
WS = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
MAX_INPUT_BYTES, MAX_TOKENS, MAX_REPLY_BYTES = 10_000, 2_000, 4_096
FENCE = "```"


def trim_ws(text: Column) -> Column:
    # The look-behind lets a run of blanks be tried once, at its start.
    return F.regexp_replace(F.regexp_replace(text, rf"\A[{WS}]+", ""), rf"(?<![{WS}])[{WS}]+\z", "")


def is_blank(text: Column) -> Column:
    return ~F.regexp_like(text, F.lit(rf"[^{WS}]"))


def clean(text: Column) -> Column:
    """Trimmed non-blank lines joined by a space, without characters that are neither ASCII nor blank. Inner spaces and case stay."""
    joined = F.regexp_replace(trim_ws(text), rf"(?<![{WS}])[{WS}]*\n[{WS}]*", " ")
    return F.regexp_replace(joined, rf"[^\x{{0}}-\x{{7F}}{WS}]", "")


def clean_status(raw: Column, cleaned: Column) -> Column:
    """ok, empty_input (blank, or empty after cleaning) or too_long (more than MAX_INPUT_BYTES bytes after cleaning)."""
    return (
        F.when(raw.isNull() | is_blank(raw) | is_blank(cleaned), "empty_input")
        .when(F.octet_length(cleaned) > MAX_INPUT_BYTES, "too_long")
        .otherwise("ok")
    )


def tokens(text: Column) -> Column:
    """Lower-cased runs of non-blank characters."""
    return F.filter(F.split(F.lower(text), rf"[{WS}]+"), lambda t: t != "")


def token_status(word_count: Column) -> Column:
    return F.when(word_count == 0, "no_tokens").when(word_count > MAX_TOKENS, "too_many_tokens").otherwise("ok")


def sentence_count(text: Column) -> Column:
    """Number of . ! and ? characters, at least 1."""
    return F.greatest(F.length(F.regexp_replace(text, r"[^.!?]", "")), F.lit(1))


def token_preview(words: Column, count: int = 10) -> Column:
    return F.array_join(F.slice(words, 1, count), " ")


def parse_task(text: Column) -> Column:
    """STRUCT<kind, arg>: a leading slash makes a command with the trimmed rest, all else is chat."""
    command = F.struct(F.lit("command").alias("kind"), trim_ws(F.substr(text, F.lit(2))).alias("arg"))
    return F.when(F.startswith(text, F.lit("/")), command).otherwise(F.struct(F.lit("chat").alias("kind"), text.alias("arg")))


def command_reply(arg: Column) -> Column:
    return F.concat(F.lit("[command: "), arg, F.lit("]"))


def url_encoded(text: Column) -> Column:
    """Percent encoding with %20 for a space."""
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))


def locale_language(locale: Column) -> Column:
    head = F.lower(F.substring(locale, 1, 2))
    return F.when(head.isin("pt", "es", "fr", "it", "de"), head).otherwise("en")


def now_ms() -> Column:
    return F.unix_millis(F.current_timestamp())


def message_time(ts_ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ts_ms), "HH:mm")


def sendable(text: Column) -> Column:
    """The trimmed message, or null for a blank one."""
    return F.nullif(trim_ws(text), F.lit(""))


# --- replies ------------------------------------------------------------------------------------


def clean_reply(text: Column) -> Column:
    """Trim, strip repeated code fences at both ends, trim. A language tag stays."""
    body = F.regexp_replace(F.regexp_replace(trim_ws(text), r"\A(?:```)+", ""), r"(?:```)+\z", "")
    return trim_ws(body)


def interpret_reply(text: Column) -> Column:
    """Content of a JSON fence; other replies unchanged. The opening fence must start the untrimmed reply to be stripped."""
    inside = F.regexp_replace(F.regexp_replace(text, r"\A(?:```json)+", ""), r"(?:```)+\z", "")
    return F.when(F.regexp_like(text, F.lit(rf"\A[{WS}]*```json")), trim_ws(inside)).otherwise(text)


def reply_status(text: Column) -> Column:
    return F.when(F.octet_length(text) > MAX_REPLY_BYTES, "response too long").when(F.contains(text, F.lit("<script>")), "unsafe html").otherwise("ok")


def persona_reply(name: Column, text: Column) -> Column:
    return F.when(name == "Erika", F.concat(F.lit("*giggles* "), text)).when(name == "Viktor", F.concat(F.lit("[stern] "), text)).otherwise(text)


def stamp_reply(ts: Column, text: Column) -> Column:
    return F.concat(F.lit("["), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("] "), text)


def wrap_reply(text: Column) -> Column:
    return F.concat(F.lit("Assistant: "), text)


def analysis_answer(reply: Column) -> Column:
    """STRUCT<action, domain, topic> from a model's reply, null where it isn't such JSON."""
    return F.from_json(trim_ws(F.substring_index(reply, "<", 1)), "action string, domain string, topic string", {"mode": "PERMISSIVE"})


# --- hex and bytes ------------------------------------------------------------------------------


def to_hex(data: Column) -> Column:
    return F.lower(F.hex(data))


def from_hex(text: Column) -> Column:
    """Null for an odd length or a character that is no hex digit."""
    return F.when((F.length(text) % 2 == 0) & F.regexp_like(text, F.lit(r"\A[0-9a-fA-F]*\z")), F.unhex(text))


def zero_pad(data: Column, align: int) -> Column:
    size = (F.octet_length(data) + (align - 1)).bitwiseAND(F.lit(-align))
    return F.rpad(data, size, F.lit(b"\x00"))


def lossy_text(data: Column) -> Column:
    return F.make_valid_utf8(data.cast("string"))
