"""Gradus: build and score reasoning datasets with Spark.

Pages of a programming contest become problem/solution records, records become
chat prompts, and model completions get rule-based reward columns.
"""

from gradus.functions.registry import batch_reward, register_reward, reward
from gradus.functions.rewards import ACTIVE, ALL
from gradus.operators.collect import collect_increment
from gradus.operators.prompts import build_prompt, render_chat
from gradus.operators.scoring import (
    group_advantage,
    reward_summary,
    score,
    total_reward,
)

__all__ = [
    "ACTIVE",
    "ALL",
    "batch_reward",
    "build_prompt",
    "collect_increment",
    "group_advantage",
    "register_reward",
    "render_chat",
    "reward",
    "reward_summary",
    "score",
    "total_reward",
]
