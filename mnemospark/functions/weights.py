"""Weight, decay, gating and feedback columns. ``now`` is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from mnemospark import fixed_values as V


def days_between(a: Column, b: Column) -> Column:
    """Absolute fractional days."""
    return F.abs(F.unix_micros(b) - F.unix_micros(a)) / F.lit(86400000000.0)


def access_contribution(accessed_at: Column, now: Column) -> Column:
    return F.exp(-V.LAMBDA_ACCESS * days_between(accessed_at, now))


def decayed_weight(frequency: Column, created: Column, accessed: Column, now: Column,
                   surprise: Column | None = None) -> Column:
    """Frequency damped by age and idle time; surprise stretches both half-lives."""
    scale = F.lit(1.0) if surprise is None else surprise_scale(surprise)
    age = F.exp(-V.ALPHA_AGE * days_between(created, now) * scale)
    idle = F.exp(-V.BETA_IDLE * days_between(accessed, now) * scale)
    return frequency * age * idle


def surprise_scale(surprise: Column) -> Column:
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), surprise))
    return 1.0 / (1.0 + V.SURPRISE_STRETCH * s)


def is_cooled(weight: Column, threshold: float = V.COOLING_THRESHOLD) -> Column:
    return weight < threshold


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def surprise_score(confirmed: Column, correction: Column, behaviour: Column) -> Column:
    """0 for an explicit instruction, else the capped sum of the error signals."""
    total = (
        F.when(correction, F.lit(V.CORRECTION_SURPRISE)).otherwise(0.0)
        + F.when(behaviour, F.lit(V.BEHAVIOUR_SURPRISE)).otherwise(0.0)
    )
    return F.when(confirmed, F.lit(0.0)).otherwise(F.least(F.lit(1.0), total))


def gating_boost(context_task: Column, context_language: Column, language: Column) -> Column:
    """1, +0.2 for a valid task context, +0.1 for the same non-empty language."""
    task = F.when(context_task.isin(V.TASK_TYPES), F.lit(V.TASK_BOOST)).otherwise(0.0)
    same = (context_language != "") & (context_language == language)
    return 1.0 + task + F.when(same, F.lit(V.LANGUAGE_BOOST)).otherwise(0.0)


def _lookup(key: Column, values: dict, default: Column) -> Column:
    out = default
    for name, value in values.items():
        out = F.when(key == name, F.lit(value)).otherwise(out)
    return out


def feedback_delta(action: Column, user_corrected: Column) -> Column:
    """Signed weight change of one feedback; NULL for an unknown action."""
    extra = F.when((action == "corrected") & user_corrected, F.lit(V.FEEDBACK_USER_EXTRA)).otherwise(0.0)
    return _lookup(action, V.FEEDBACK_DELTAS, F.lit(None).cast("double")) + extra


def pitfall_delta(action: Column) -> Column:
    return _lookup(action, V.PITFALL_DELTAS, F.lit(None).cast("double"))


def source_trust(source_type: Column) -> Column:
    return _lookup(source_type, V.SOURCE_TRUST, F.lit(V.TRUST_DEFAULT))


def protection_decayed_weight(weight: Column, level: Column, days: Column) -> Column:
    """Thirty-day decay whose rate halves with each protection level (at most 3)."""
    lvl = F.greatest(F.lit(0), F.least(F.lit(V.PROTECTION_MAX), level))
    decayed = clamp01(weight * F.exp(-days / V.DECAY_DAYS * F.pow(F.lit(2.0), -lvl)))
    return F.when(days <= 0, weight).otherwise(decayed)


def normal_status(status: Column) -> Column:
    return F.when(status.isin(V.PITFALL_STATUSES), status).otherwise(F.lit("proposed"))


def injectable(status: Column, occurrences: Column, weight: Column) -> Column:
    """Confirmed, or proposed with at least two occurrences and weight 0.6."""
    s = normal_status(status)
    return (s == "confirmed") | ((s == "proposed") & (occurrences >= 2) & (weight >= 0.6))


def interference_rate(shown: Column, suppressed: Column) -> Column:
    return F.when(shown <= 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), suppressed / F.greatest(shown, F.lit(1))))


def risk_contribution(occurrences: Column, trust: Column, last_occurred: Column, now: Column) -> Column:
    """Density x trust x recency of one pitfall; no date means no decay."""
    days = (F.unix_micros(now) - F.unix_micros(last_occurred)) / F.lit(86400000000.0)
    recency = F.coalesce(F.exp(-days / V.DECAY_DAYS), F.lit(1.0))
    return F.least(F.lit(1.0), occurrences / F.lit(3.0)) * (trust / F.lit(float(V.TRUST_MAX))) * recency


def complexity_factor(complexity: Column) -> Column:
    return (
        F.when(complexity <= 0, F.lit(0.5)).when(complexity > 1, F.lit(1.5)).otherwise(0.5 + complexity)
    )


def file_complexity(size_bytes: Column) -> Column:
    """Log-scaled size; an unknown size counts 0.5."""
    return F.coalesce(F.least(F.lit(1.0), F.log10(size_bytes + 1.0) / 7.0), F.lit(0.5))
