"""Prompts as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The sentences that prompts are made of, in their order.
HINDSIGHT_OPEN = "\n<hindsight>\nA better branch from this exact search state later retrieved:\n"
NO_EVIDENCE = "(no retrieval evidence was returned)"
HINDSIGHT_VALUE, HINDSIGHT_LOCAL = "\nIts branch value was ", "; its local advantage over the alternatives was "
HINDSIGHT_OTHERS = ".\nOutcomes of other attempted searches from the same state (query text withheld to prevent copying):\n"
OTHER_BRANCH, OTHER_VALUE, NO_OTHERS = "- anonymized alternative branch ", ": value ", "- (no textual alternative available)"
HINDSIGHT_CLOSE = "\n</hindsight>\nUse this hindsight only to correct the direction of the agent's private reasoning and next search. Never state or imply a final answer, and never claim access to future information. Continue as an agent that only knows the visible current state.\n"
ATTEMPT_OPEN, ATTEMPT_BETWEEN, ATTEMPT_CLOSE = "\n<student_attempt>\n<think>", "</think>\n<search>", "</search>\n</student_attempt>\n"
CORRECT = "The student's attempted reasoning/search may be wrong. Correct its direction using only the visible state and any permitted hindsight above. Do not state or imply the final answer. Return exactly one corrected action as <think>...</think><search>...</search>.\n"
SKILL_OPEN, SKILL_CLOSE = "\n<analyzer_skill>\n", "\n</analyzer_skill>\nUse this answer-free procedural skill to choose the next action from the current visible state.\n"


def _four(x: Column) -> Column:
    return F.format_string("%.4f", F.bround(x.cast("double"), 4))  # ties to even


def hindsight(evidence: Column, value: Column, advantage: Column, others: Column) -> Column:
    """What a better branch found, its value and those of the others (an array), without their queries."""
    rows = F.array_join(F.transform(others, lambda v, i: F.concat(F.lit(OTHER_BRANCH), (i + 1).cast("string"), F.lit(OTHER_VALUE), _four(v))), "\n")
    found = F.when(F.coalesce(evidence, F.lit("")) == "", NO_EVIDENCE).otherwise(evidence)
    listed = F.when(F.coalesce(F.size(others), F.lit(0)) < 1, NO_OTHERS).otherwise(rows)
    return F.concat(F.lit(HINDSIGHT_OPEN), found, F.lit(HINDSIGHT_VALUE), _four(value), F.lit(HINDSIGHT_LOCAL), _four(advantage), F.lit(HINDSIGHT_OTHERS), listed, F.lit(HINDSIGHT_CLOSE))


def correction(prefix: Column, think: Column, asked: Column, sheet: Column) -> Column:
    """A state with an attempt (its texts redacted by the caller), what is known better, and the order to correct it."""
    return F.concat(prefix, F.lit(ATTEMPT_OPEN), think, F.lit(ATTEMPT_BETWEEN), asked, F.lit(ATTEMPT_CLOSE), F.coalesce(sheet, F.lit("")), F.lit(CORRECT))


def with_skill(state: Column, skill: Column) -> Column:
    """A state and a skill as compact JSON text."""
    return F.concat(state, F.lit(SKILL_OPEN), skill, F.lit(SKILL_CLOSE))
