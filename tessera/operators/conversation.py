"""Turns, pairs, rolling history and chat prompts of conversations (conv_id, turn, role, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

HISTORY = 20


def turn_pairs(turns: DataFrame) -> DataFrame:
    """conv_id, turn, input, output: a user turn with the assistant turn right behind it."""
    order = W.partitionBy("conv_id").orderBy("turn")
    after = turns.where(F.col("role").isin("user", "assistant")).select("*", F.lead("role").over(order).alias("next_role"), F.lead("text").over(order).alias("output"))
    return after.where("role = 'user' AND next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("input"), "output")


def history(pairs: DataFrame, limit: int = HISTORY) -> DataFrame:
    """The last ``limit`` pairs of each conversation, oldest first by ``turn``."""
    place = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))
    return pairs.withColumn("back", place).where(F.col("back") <= limit).drop("back")


def rolling(pairs: DataFrame, limit: int = HISTORY) -> DataFrame:
    """Adds window: what the state held after each pair."""
    frame = W.partitionBy("conv_id").orderBy("turn").rowsBetween(-(limit - 1), 0)
    return pairs.withColumn("window", F.collect_list(F.struct("turn", "input", "output")).over(frame))


def chat_selection(turns: DataFrame) -> DataFrame:
    """conv_id, system (first), user (last), status."""
    picked = turns.groupBy("conv_id").agg(
        F.expr("min_by(text, turn) FILTER (WHERE role = 'system')").alias("system"), F.expr("max_by(text, turn) FILTER (WHERE role = 'user')").alias("user")
    )
    return picked.withColumn("status", F.when(F.col("user").isNull(), "no_user_message").otherwise("ok"))


def chat_prompt(system: Column, user: Column) -> Column:
    """ChatML: an optional system part, the user part, the assistant's header."""
    head = F.when(F.coalesce(system, F.lit("")) != "", F.concat(F.lit("<|im_start|>system\n"), system, F.lit("<|im_end|>\n"))).otherwise("")
    return F.concat(head, F.lit("<|im_start|>user\n"), user, F.lit("<|im_end|>\n<|im_start|>assistant\n"))


# Fixed value: the instruction of input analysis.
ANALYSIS = (
    "<|im_start|>system\nYou are an input analyzer. Extract exactly these REQUIRED elements:\n1. Action (verb: explain, write, debug, compare, etc.)\n2. Domain (subject: Rust, Python, math, etc.)\n"
    '3. Topic (specific concept: lifetimes, vectors, etc.)\n\nRespond ONLY with this JSON format:\n{"action":"...","domain":"...","topic":"..."}\nNo commentary or additional text!<|im_end|>\n'
)


def analysis_prompt(text: Column) -> Column:
    return F.concat(F.lit(ANALYSIS + "<|im_start|>user\n"), text, F.lit("\n<|im_end|>\n<|im_start|>assistant\n"))


def flush_records(pairs: DataFrame) -> DataFrame:
    """Two records per pair, both stamped with the output's second. pairs: pair_id, input, output, output_ts_ms."""
    both = F.array(F.struct(F.lit(0).alias("side"), F.col("input").alias("content")), F.struct(F.lit(1).alias("side"), F.col("output").alias("content")))
    return pairs.select("pair_id", F.explode(both).alias("r"), F.expr("output_ts_ms div 1000").alias("timestamp")).select("pair_id", "r.side", "timestamp", F.to_json(F.struct("r.content")).cast("binary").alias("payload"))


def latest(rows: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """The last value per key."""
    return rows.groupBy(by).agg(F.max_by(value, at).alias(value))
