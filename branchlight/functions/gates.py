"""What decides whether a candidate, a consumer or a training row may go on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The reason that marks a failed request, the form of its status and the states that no retry mends.
API_FAILURE = "deepseek_api_failed"
API_STATUS = r"(?i)DeepSeek HTTP (\d{3})"
SYSTEMIC_STATUS = (400, 401, 402, 403, 404)
#: An action as a whole response, the artifact of redaction, and columns that no training row may have.
ACTION = r"(?s)<think>.+?</think>\n<search>[^\n<>]+</search>"
REDACTED = "[redacted]"
FORBIDDEN = ("ground_truth", "answer", "answers", "raw_response")


def has_generation(turns: Column, trajectory: Column, answer: Column) -> Column:
    """Whether a model wrote anything: a turn, a trajectory or an answer."""
    return (F.coalesce(F.size(turns), F.lit(0)) > 0) | (F.coalesce(trajectory, F.lit("")) != "") | answer.isNotNull()


def api_failure(flag: Column, reasons: Column) -> Column:
    named = F.exists(reasons, lambda r: F.trim(F.split(r, ":")[0]) == API_FAILURE)
    return F.coalesce(flag, F.lit(False)) | F.coalesce(named, F.lit(False))


def api_status(stated: Column, reasons: Column) -> Column:
    """The stated status, else that of the first reason that names one."""
    told = F.filter(F.transform(reasons, lambda r: F.regexp_extract(r, API_STATUS, 1)), lambda x: x != "")
    return F.coalesce(stated, F.try_element_at(told, F.lit(1)).cast("int"))


def annotations(turns: Column, trajectory: Column, answer: Column, flag: Column, stated: Column, reasons: Column) -> dict[str, Column]:
    """Columns of an audited candidate. One whose request failed before anything was written may be tried again and uses up no budget; a
    systemic failure is one of those with a status that no retry mends."""
    wrote, failed, status = has_generation(turns, trajectory, answer), api_failure(flag, reasons), api_status(stated, reasons)
    retry = failed & ~wrote
    systemic = F.when(retry & status.isin(*SYSTEMIC_STATUS), F.concat(F.lit("http_"), status.cast("string")))
    return {"actual_generation": wrote, "api_failure": failed, "retryable_api_failure": retry, "api_failure_status_code": status, "effective": ~retry, "systemic_failure": systemic}


def whole_action(response: Column) -> Column:
    """Whether a response is one thought and one search, and nothing else."""
    return F.regexp_like(response, F.lit(rf"\A(?:{ACTION})\z"))


def unredacted(response: Column) -> Column:
    return ~F.contains(F.lower(response), F.lit(REDACTED))


def valid_consumer(gap: Column, response: Column, skill: Column, least: float = 0.1) -> Column:
    """Enough gap, a whole action without redactions, and a skill."""
    response = F.coalesce(response, F.lit(""))
    return (F.coalesce(gap, F.lit(0.0)) >= least) & unredacted(response) & whole_action(response) & skill.isNotNull()


def strict_consumer(gap: Column, response: Column, least: float = 0.25) -> Column:
    response = F.coalesce(response, F.lit(""))
    return (F.coalesce(gap, F.lit(0.0)) >= least) & unredacted(response) & whole_action(response)


def answer_agnostic(text: Column) -> Column:
    """No years and no numbers of up to four digits."""
    return ~F.regexp_like(text, F.lit(r"\b(?:19|20)\d{2}\b|\b\d{1,4}\b"))


def accepted_input(accepted: Column, reasons: Column, response: Column, keys: tuple[str, ...] = ("episode_skill", "episode_summary")) -> Column:
    """Why an audited row may not be exported; null if it may."""
    fields = F.array_sort(F.json_object_keys(response))
    return F.when(~F.coalesce(accepted, F.lit(False)), "not_accepted").when(F.coalesce(F.size(reasons), F.lit(0)) > 0, "has_rejection_reasons").when(~F.coalesce(fields == F.array(*map(F.lit, sorted(keys))), F.lit(False)), "invalid_response_schema")


def require_columns(columns: list[str]) -> None:
    bad = sorted(set(columns) & set(FORBIDDEN))
    if bad:
        raise ValueError(f"sensitive columns: {bad}")


#: Fields of the answer that a task type asks for.
TASK_FIELDS = {"analyzer_generation": ("episode_skill", "episode_summary"), "node_skill_generation": ("failure_type", "missing_relation", "next_operation", "stop_condition")}


def task_row(task: Column, response: Column) -> Column:
    """Why a training row does not fit its task type; null if it does."""
    task = F.coalesce(task, F.lit("analyzer_generation"))
    out = F.when(task.isin("skill_consumer", "action_replay"), F.when(~whole_action(response), "invalid_action").when(~unredacted(response), "redacted_target"))
    for name, fields in TASK_FIELDS.items():
        wrong = ~F.coalesce(F.array_sort(F.json_object_keys(response)) == F.array(*map(F.lit, fields)), F.lit(False))
        reason = F.when(wrong, "invalid_response")
        if name == "node_skill_generation":
            empty = F.lit(False)
            for f in fields:
                empty = empty | (F.trim(F.get_json_object(response, f"$.{f}")) == "")
            reason = reason.when(empty, "empty_field").when(~unredacted(response), "redacted_target")
        out = F.when(task == name, reason).otherwise(out)
    known = task.isin("skill_consumer", "action_replay", *TASK_FIELDS)
    return F.when(known, out).otherwise("unknown_task_type")


def plain_replay(prompt: Column, order: str = "Choose the next action from the current visible state. Return exactly <think>...</think><search>...</search>; do not state a final answer.\n") -> Column:
    """A prompt without the skill block and with a plain order in the place of the one that refers to it."""
    bare = F.regexp_replace(prompt, r"(?s)\n<analyzer_skill>\n.*?\n</analyzer_skill>\n", "\n")
    return F.regexp_replace(bare, r"(?s)Use this answer-free procedural skill.*?do not state a final answer\.\n?", order)


def outcome_bucket(is_root: Column, after_search: Column, depth: Column) -> Column:
    """Where on its trajectory a node was expanded."""
    deep = F.when(depth <= 1, "after_search_depth1").when(depth == 2, "after_search_depth2").otherwise("after_search_depth3plus")
    return F.when(is_root, "root").when(after_search, deep).otherwise("pre_search")


def forced_handoff(handoff: Column, actions: Column) -> Column:
    """The handoff with the second action's query demanded, if that action is valid and has one. actions: array of structs with valid and query."""
    bridge = F.try_element_at(actions, F.lit(2))
    base = F.coalesce(handoff, F.lit("Read the first evidence and identify the unresolved relation."))
    asked = F.concat(base, F.lit(" Before giving any answer, your next action must be exactly one search that verifies the remaining relation. Use this query: "), bridge["query"], F.lit("."))
    return F.when(bridge["valid"] & (F.coalesce(bridge["query"], F.lit("")) != ""), asked).otherwise(handoff)
