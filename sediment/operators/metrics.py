"""Figures about a run: table profile, impact, confidence, efficiency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sediment.functions.columns import CHANGED, DELETED, IS_CURRENT, NEW, UNCHANGED, ROW_ORDER
from sediment.operators.explain import TEMPLATE
from sediment.operators.validate import rule_summary

# Providers that earn the higher bonus, points for rules and bonuses.
ONLINE_PROVIDERS = ("gemini", "groq")
RULE_POINTS = 80
ONLINE_BONUS = 20
OFFLINE_BONUS = 10

# The sentences that go with the labels, from failed rules down the scores.
SENTENCES = (
    "One or more critical validation rules failed! This indicates overlapping date intervals, "
    "duplicate active records, or missing business keys. Immediate correction is required.",
    "All 5 deterministic validation rules passed. Business key auto-detected successfully. "
    "Online LLM provider completed batch explanations with structured schema validation.",
    "All deterministic validation rules passed. However, the system is running in offline template "
    "fallback mode for natural-language explanations.",
    "SCD2 transformation completed, but validation warnings were triggered. "
    "Review date boundaries and tracked attributes for potential data quality issues.",
    "Validation integrity check failed or critical configurations are missing.",
)


def table_profile(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows, columns, current rows, and historical rows (all that are not current)."""
    flag = F.col(IS_CURRENT) if IS_CURRENT in df.columns else F.lit(False)
    # Without the flag a table has neither current nor historical rows.
    historical = F.count(F.lit(1)) - F.count_if(flag) if IS_CURRENT in df.columns else F.lit(0)
    return df.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.lit(len([c for c in df.columns if c != ROW_ORDER])).alias("column_count"),
        F.count_if(flag).alias("current_count"),
        historical.cast("long").alias("historical_count"),
    )


def impact(summary: DataFrame, rules: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Records processed, changes found, history preserved, rules passed.

    ``summary`` comes from ``diff.summary`` and ``rules`` from a validation, both as a
    whole (a row each) or by the same segments.
    """
    both = summary.unionByName(rule_summary(rules, by), allowMissingColumns=True)
    changes = F.col(NEW) + F.col(CHANGED) + F.col(DELETED)
    # One row of each kind per segment: max picks the one that is there.
    return both.groupBy(*(by or [])).agg(
        F.max("total").alias("total_records"),
        F.max(changes).alias("changes"),
        F.max(UNCHANGED).alias("historical_preserved"),
        F.max("pass_count").alias("rules_passed"),
        F.max("total_count").alias("rules_total"),
    )


def confidence(
    rules: DataFrame, provider: str | Column = TEMPLATE, by: list[str] | None = None
) -> DataFrame:
    """Score from 0 to 100 and its label, for a rule table or each segment of it."""
    return explained_confidence(rules, provider, by).drop("explanation")


def explained_confidence(
    rules: DataFrame, provider: str | Column = TEMPLATE, by: list[str] | None = None
) -> DataFrame:
    """``confidence`` with a sentence, ``explanation``, that goes with the label."""
    provider = F.lit(provider) if isinstance(provider, str) else provider
    verdict = rule_summary(rules, by)
    total = F.greatest(F.col("total_count"), F.lit(1))
    bonus = F.when(provider.isin(*ONLINE_PROVIDERS), ONLINE_BONUS).otherwise(OFFLINE_BONUS)
    score = F.least(F.col("pass_count") / total * RULE_POINTS + bonus, F.lit(100.0))
    # The labels and their limits.
    label = (
        F.when(F.col("fail_count") > 0, "Low")
        .when(score >= 90, "Very High")
        .when(score >= 75, "High")
        .when((F.col("warn_count") > 0) | (score >= 50), "Medium")
        .otherwise("Low")
    )
    sentence = (
        F.when(F.col("fail_count") > 0, SENTENCES[0])
        .when(score >= 90, SENTENCES[1])
        .when(score >= 75, SENTENCES[2])
        .when((F.col("warn_count") > 0) | (score >= 50), SENTENCES[3])
        .otherwise(SENTENCES[4])
    )
    return verdict.select(
        *(by or []), score.alias("score"), label.alias("label"), sentence.alias("explanation")
    )


def efficiency(avg_tokens: Column, provider: Column) -> Column:
    """Badge for the average number of tokens per change."""
    # The badges and their limits.
    return (
        F.when(provider == TEMPLATE, "Offline")
        .when(avg_tokens <= 150, "Excellent")
        .when(avg_tokens <= 350, "Good")
        .when(avg_tokens <= 750, "Moderate")
        .otherwise("Expensive")
    )
