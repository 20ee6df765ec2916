"""Inference telemetry: attempts roll up to decisions, decisions to rates and gates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Tier:
    """What a run level allows."""

    fallback_allowed: bool
    fallback_rate_max: float
    fail_on_mock: bool
    fail_on_missing_key: bool


#: Run levels (fixed values).
TIERS = {
    "dev": Tier(True, 1.0, False, False),
    "smoke": Tier(True, 0.5, True, False),
    "evidence": Tier(False, 0.0, True, True),
    "safety_demo": Tier(True, 1.0, False, False),
}


def decisions(attempts: DataFrame) -> DataFrame:
    """One row per decision: token and latency totals, effective backend, mock calls.

    attempts: decision_id, attempt_index, started_at, finished_at (seconds), latency_ms, retry_backoff_ms, input_tokens,
    output_tokens, cached_tokens, effective_backend, mock_call, requested_backend, error_category, final_origin.
    End to end is from the first attempt's start to the last finish, never negative.
    """
    backend = F.col("effective_backend")
    end = F.max("finished_at") - F.min_by("started_at", "attempt_index")
    return attempts.groupBy("decision_id").agg(
        F.count("*").alias("attempt_count"),
        *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(f"total_{c}") for c in ("input_tokens", "output_tokens", "cached_tokens")],
        F.sum("retry_backoff_ms").alias("retry_backoff_total_ms"),
        (F.greatest(F.lit(0.0), end) * 1000).alias("total_latency_ms"),
        F.when(F.bool_or(backend == "mock"), "mock").when(F.bool_or(backend == "fake"), "fake").otherwise("real").alias("effective_backend"),
        F.count_if("mock_call").alias("mock_calls"),
        F.bool_or(F.coalesce(F.col("error_category") == "LLMAuthError", F.lit(False))).alias("auth_error"),
        F.max_by("requested_backend", "attempt_index").alias("requested_backend"),
        F.max_by("final_origin", "attempt_index").alias("final_origin"),
    )


def with_decisions(all_decisions: DataFrame, attempts: DataFrame) -> DataFrame:
    """Every decision, those without attempts included: they have the requested backend and zero totals."""
    found = decisions(attempts).drop("requested_backend", "final_origin")
    both = all_decisions.join(found, "decision_id", "left")
    zero = {c: 0 for c in ("attempt_count", "total_input_tokens", "total_output_tokens", "total_cached_tokens", "mock_calls")} | {"retry_backoff_total_ms": 0.0, "total_latency_ms": 0.0}
    return both.na.fill(zero).withColumn("effective_backend", F.coalesce("effective_backend", "requested_backend")).withColumn("auth_error", F.coalesce("auth_error", F.lit(False)))


def effective_backend(attempts: DataFrame) -> DataFrame:
    """The second rule: any mock call makes it mock, then fake, then real; else what was requested."""
    backend = F.col("effective_backend")
    mocks = F.count_if("mock_call")
    kind = F.when(mocks > 0, "mock").when(F.bool_or(backend == "fake"), "fake").when(F.bool_and(backend == "real"), "real").otherwise(F.max("requested_backend"))
    return attempts.groupBy("decision_id").agg(kind.alias("backend"), mocks.alias("mock_calls"))


def latency_split(found: DataFrame, attempts: DataFrame) -> DataFrame:
    """One row of mean latencies; 0 where nothing is to be averaged."""
    per_attempt = attempts.agg(F.coalesce(F.avg("latency_ms"), F.lit(0.0)).alias("provider_per_attempt_ms"))
    total = F.col("total_latency_ms")
    mean = lambda x: F.coalesce(F.avg(x), F.lit(0.0))
    totals = found.agg(
        F.coalesce(F.sum("retry_backoff_total_ms"), F.lit(0.0)).alias("retry_backoff_total_ms"),
        mean(total).alias("decision_end_to_end_ms"),
        mean(F.when(F.col("final_origin") == "fallback", total)).alias("fallback_decision_ms"),
        mean(F.when(F.col("final_origin") == "llm", total)).alias("successful_llm_origin_ms"),
    )
    return per_attempt.join(totals, F.lit(True))


def evidence_violation(tier: str) -> Column:
    """Why a decision can't count as evidence, null if it can; only the evidence tier and real requests are judged."""
    t = TIERS[tier]
    reason = (
        F.when(F.col("effective_backend") != "real", "backend_not_real")
        .when(F.col("mock_calls") > 0, "mock_calls")
        .when(F.lit(t.fail_on_missing_key) & F.col("auth_error"), "auth_error")
        .when(F.lit(not t.fallback_allowed) & (F.col("final_origin") == "fallback"), "fallback")
    )
    return F.when(F.lit(tier == "evidence") & (F.col("requested_backend") == "real"), reason)


def fallback_gate(found: DataFrame, tier: str) -> DataFrame:
    """fallback_rate, its maximum and whether it holds; no decisions hold."""
    most = TIERS[tier].fallback_rate_max
    rate = F.avg((F.col("final_origin") == "fallback").cast("double"))
    return found.agg(F.coalesce(rate, F.lit(0.0)).alias("fallback_rate"), F.lit(most).alias("fallback_rate_max")).withColumn("ok", F.col("fallback_rate") <= F.col("fallback_rate_max"))


class EvidenceError(RuntimeError):
    """Decisions that can't be recorded as evidence."""


def require_evidence(found: DataFrame, tier: str) -> None:
    """Raises for the first decision that violates the tier, then for the batch's fallback rate."""
    bad = found.withColumn("reason", evidence_violation(tier)).filter("reason is not null").orderBy("decision_id").select("decision_id", "reason").first()
    if bad:
        raise EvidenceError(f"decision {bad.decision_id}: {bad.reason}")
    gate = fallback_gate(found, tier).first()
    if not gate.ok:
        raise EvidenceError(f"fallback rate {gate.fallback_rate:.4f} exceeds {gate.fallback_rate_max:.4f}")


def inference_config_hash(model: Column, temperature: Column, max_tokens: Column, max_retries: Column, fallback_mode: Column) -> Column:
    """SHA-256 of the configuration as JSON with sorted keys and spaces after separators; temperature as text of a float."""
    text = F.format_string(
        '{"fallback_mode": "%s", "max_retries": %s, "max_tokens": %s, "model": "%s", "temperature": %s}', fallback_mode, max_retries.cast("string"), max_tokens.cast("string"), model, temperature.cast("string")
    )
    return F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))


def action_space_hash(actions: Column) -> Column:
    """SHA-256 of the legal actions (array<struct<action_type, params map<string,string>>>) as JSON with sorted keys."""
    quoted = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    params = lambda m: F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(quoted(e["key"]), F.lit(": "), quoted(e["value"]))), ", "), F.lit("}"))
    items = F.transform(actions, lambda a: F.concat(F.lit('{"action_type": '), quoted(a["action_type"]), F.lit(', "params": '), params(a["params"]), F.lit("}")))
    return F.concat(F.lit("sha256:"), F.sha2(F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]")).cast("binary"), 256))
