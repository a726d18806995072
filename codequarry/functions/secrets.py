"""Secret detection on one line of text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from codequarry import fixed_values as fixed
from codequarry.functions import names, regex as rx


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in fixed.SEVERITIES]), severity).cast("int") - 1


def could_hold_secret(text: Column) -> Column:
    """A cheap necessary condition of all rules, to skip most texts before 26 patterns run."""
    marks = ["AKIA", "ABIA", "ACCA", "ASIA", "github_pat_", "glpat-", "hooks.slack.com", "-----BEGIN", "://", "npm_",
             "pypi-", "SG.", "SK", "earer", "asic", "AccountKey", "DefaultEndpointsProtocol", "xox", "sk_", "pk_",
             "ghp_", "gho_", "ghu_", "ghs_", "ghr_"]
    words = ["key", "KEY", "secret", "SECRET", "password", "PASSWORD", "passwd", "PASSWD", "token", "TOKEN"]
    assigns = F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))
    return (assigns & rx.any_contains(text, words)) | rx.any_contains(text, marks)


def findings(line: Column, min_severity: str = "info") -> Column:
    """All rule matches of a line: ``array<struct<rule_no, secret_type, severity, description, recommendation, matched>>``."""
    floor = fixed.SEVERITIES.index(min_severity)

    def rule(number: int, kind: str, severity: str, regex: str, description: str, recommendation: str) -> Column:
        constant = [F.lit(number).alias("rule_no"), F.lit(kind).alias("secret_type"), F.lit(severity).alias("severity"),
                    F.lit(description).alias("description"), F.lit(recommendation).alias("recommendation")]
        return F.transform(rx.find_all(line, regex), lambda m: F.struct(*constant, m.alias("matched")))

    chosen = [(i, *r) for i, r in enumerate(fixed.SECRET_RULES) if fixed.SEVERITIES.index(r[1]) >= floor]
    return F.flatten(F.array(*[rule(*r) for r in chosen]))


def confidence(line: Column, matched: Column, secret_type: Column) -> Column:
    """How likely a match is real, from its line."""
    lowered = F.lower(rx.strip(line))
    placeholder = rx.any_contains(F.lower(matched), fixed.PLACEHOLDER_WORDS) | rx.any_contains(lowered, fixed.PLACEHOLDER_WORDS)
    score = (
        F.lit(0.85)
        - F.when(placeholder, 0.4).otherwise(0.0)
        - F.when(rx.any_prefix(lowered, fixed.COMMENT_STARTS), 0.2).otherwise(0.0)
        + F.when(rx.matches(line, r"[=:]\s*[\"']"), 0.05).otherwise(0.0)
    )
    score = F.when(secret_type.isin(*fixed.CERTAIN_SECRETS), F.greatest(score, F.lit(0.9))).otherwise(score)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def redacted(matched: Column) -> Column:
    return names.redact(matched)
