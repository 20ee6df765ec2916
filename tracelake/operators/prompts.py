"""Prompt contracts: hashes, scans and response parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Substrings that no prompt may contain (fixed values).
FORBIDDEN = (
    "rng_state",
    "random_state",
    "_rng",
    "private_",
    "cache",
    "_cache",
    "world_",
    "internal_",
    "global_",
    "total_",
    "checkpoint",
    "parent_episode_id",
    "fork_group_id",
    "branch_id",
    "branch_group_id",
    "source_commit",
    "source_dirty",
    "api_key",
    "secret",
    "token",
)

SCHEMA_VERSION = "0.1.0"


def forbidden_hits(text: Column, words: tuple[str, ...] = FORBIDDEN) -> Column:
    """The forbidden substrings that a text contains, in text order; null text has none."""
    return F.array_sort(F.filter(F.array(*map(F.lit, words)), lambda w: F.coalesce(F.contains(text, w), F.lit(False))))


def forbidden_keys(text: Column, words: tuple[str, ...] = FORBIDDEN) -> Column:
    """The stricter variant: only substrings of the JSON object's keys."""
    keys = F.regexp_extract_all(text, F.lit(r'"((?:[^"\\]|\\.)*)"\s*:'), F.lit(1))
    return F.array_sort(F.filter(F.array(*map(F.lit, words)), lambda w: F.exists(F.coalesce(keys, F.array().cast("array<string>")), lambda k: F.contains(k, w))))


def text_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))


def prompt_hashes(system: Column, contract: Column, observation_hash: Column, message: Column) -> dict[str, Column]:
    """The four hashes of a prompt and the hash over them together."""
    found = {"system_prompt_hash": text_hash(system), "scenario_contract_hash": text_hash(contract), "observation_hash": observation_hash, "user_message_hash": text_hash(message)}
    return found | {"combined_prompt_hash": text_hash(F.concat(*found.values()))}


def valid_hash(value: Column) -> Column:
    return F.coalesce(value.rlike("^sha256:.{64}$"), F.lit(False))


def unfenced(text: Column) -> Column:
    """The text without a Markdown fence around it."""
    bare = F.regexp_replace(text, r"^\s+|\s+$", "")
    inner = F.when(F.contains(bare, F.lit("\n")), F.regexp_replace(bare, r"^```[^\n]*\n", "")).otherwise("")
    inner = F.regexp_replace(F.regexp_replace(inner, r"\s+$", ""), r"```$", "")
    return F.when(F.startswith(bare, F.lit("```")), F.regexp_replace(inner, r"^\s+|\s+$", "")).otherwise(bare)


def parse_status(text: Column) -> Column:
    """ok for a JSON object, not_dict for other JSON, json_decode_error for none, no_content for a null or blank text."""
    body = unfenced(text)
    kind = F.schema_of_variant(F.try_parse_json(body))
    return (
        F.when(text.isNull() | (F.trim(text) == ""), "no_content").when(kind.isNull(), "json_decode_error").when(F.startswith(kind, F.lit("OBJECT")), "ok").otherwise("not_dict")
    )


def error_status(parse_error: Column, has_body: Column) -> Column:
    """The status that an error message stands for."""
    return (
        F.when(has_body, "ok").when(F.startswith(parse_error, F.lit("json_decode_error")), "json_decode_error").when(F.startswith(parse_error, F.lit("json_not_object")), "not_dict").otherwise("no_content")
    )


def action_schema(legal: DataFrame) -> DataFrame:
    """The first legal action of each type, in order, for each observation; legal: observation_id, ord, action_type, params_schema."""
    w = Window.partitionBy("observation_id", "action_type").orderBy("ord")
    first = legal.withColumn("__i", F.row_number().over(w)).filter("__i = 1")
    return first.groupBy("observation_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "action_type", "params_schema"))), lambda x: F.struct(x["action_type"], x["params_schema"])).alias("action_schema"))


def type_name(value: Column) -> Column:
    """The schema type of a parameter given as JSON text: booleans before integers."""
    kind = F.schema_of_variant(F.try_parse_json(value))
    return (
        F.when(kind == "BOOLEAN", "boolean").when(kind == "BIGINT", "integer").when(kind.rlike("^(DOUBLE|DECIMAL|FLOAT)"), "number").when(kind == "VOID", "null").otherwise("string")
    )


def contract_errors(observed: Column, declared: Column) -> Column:
    """Action types missing from the contract, and those that are not legal."""
    missing, extra = F.array_sort(F.array_except(observed, declared)), F.array_sort(F.array_except(declared, observed))
    return F.concat(F.transform(missing, lambda x: F.concat(F.lit("missing:"), x)), F.transform(extra, lambda x: F.concat(F.lit("extra:"), x)))


def scalar_params(params: Column) -> Column:
    """Parameters (map<string,string> of JSON texts) of which arrays and objects become plain text."""
    return F.transform_values(params, lambda k, v: F.when(v.rlike(r"^\s*[\[{]"), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('\\"')), F.lit('"'))).otherwise(v))
