"""Triage of case notes and labelling of calls by rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast import rules
from holdfast.functions.rates import count_true, rate, rows
from holdfast.functions.text import note_sentiment, topic_label


def label_sentiment(notes: DataFrame, text: str, patterns: Mapping[str, str] = rules.SENTIMENT_PATTERNS) -> DataFrame:
    return notes.withColumn("sentiment", note_sentiment(F.col(text), patterns))


def sentiment_triage(labelled: DataFrame, by: str) -> DataFrame:
    """Notes per class for each case or agent, the angriest first."""
    def of(name: str) -> Column:
        return count_true(F.col("sentiment") == name)

    return labelled.groupBy(by).agg(
        rows().alias("notes"), of("negative").alias("negative"), of("at_risk").alias("at_risk"),
        of("neutral").alias("neutral"), rate(of("negative"), rows()).alias("negative_rate"),
    ).orderBy(F.desc("negative"), F.desc("at_risk"), by)


def topic_label_rules(
    texts: DataFrame, text: str, patterns: Mapping[str, Sequence[str]] = rules.TOPIC_PATTERNS, out: str = "topic"
) -> DataFrame:
    return texts.withColumn(out, topic_label(F.col(text), patterns))


def unlabeled_filter(calls: DataFrame, key: str = "call_id", prefix: str = "CALL-NEW-") -> DataFrame:
    """Calls of new drops, told by the prefix of their id (a test that reaches the file scan)."""
    return calls.where(F.col(key).startswith(prefix))
