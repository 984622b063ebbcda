"""Scoring completions as they arrive."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from gradus.functions.rewards import ACTIVE
from gradus.operators.scoring import score, total_reward


def score_stream(
    completions: DataFrame,
    target: str,
    checkpoint: str,
    names: Iterable[str] = ACTIVE,
    *,
    keep: Iterable[str] = ("prompt_id", "gen_id"),
    trigger: dict | None = None,
) -> StreamingQuery:
    """Append keys, rewards and their total to ``target`` (Parquet). Rewards
    keep no state, and the file sink commits each batch once."""
    names = list(names)
    scored = total_reward(score(completions, names), names)
    return (
        scored.select(*keep, *names, "total")
        .writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
