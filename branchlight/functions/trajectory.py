"""Turns and trajectories: classification with reasons, messages, web results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TAGS = ("think", "search", "information", "answer")
#: A turn record: what the agent wrote and what came back.
TURN = "struct<turn_index:int,raw_output:string,information:string,hit_max_new_tokens:boolean>"


def _bodies(text: Column, tag: str) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1))


def _none_if_empty(x: Column) -> Column:
    return F.when(F.length(F.trim(x)) > 0, F.trim(x))


def _reasons(*pairs: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(r)) for c, r in pairs]))


def strict_content(text: Column, tag: str) -> Column:
    """Content of the block where the turn is one think block and then that block, else null."""
    whole = rf"(?s)^\s*<think>.*?</think>\s*<{tag}>(.*?)</{tag}>\s*$"
    return F.when(F.regexp_like(text, F.lit(whole)), _none_if_empty(F.regexp_extract(text, whole, 1)))


def parse_turn(raw: Column) -> Column:
    """Struct of action (search, answer, failure), strict, query, answer and reasons.

    A well-formed search comes before a well-formed answer; of malformed turns an answer comes before a search.
    """
    text = F.trim(F.coalesce(raw, F.lit("")))
    query, answer = strict_content(text, "search"), strict_content(text, "answer")
    last_answer = _none_if_empty(F.try_element_at(_bodies(text, "answer"), F.lit(-1)))
    first_query = _none_if_empty(F.try_element_at(_bodies(text, "search"), F.lit(1)))
    has = lambda tag: F.size(_bodies(text, tag)) > 0
    opened = F.lit(False)
    for tag in TAGS:
        opened = opened | F.contains(text, F.lit(f"<{tag}>"))

    def turn(action: str, strict: bool, q: Column, a: Column, reasons: Column) -> Column:
        text_or_null = lambda c: c.cast("string")
        return F.struct(F.lit(action).alias("action"), F.lit(strict).alias("strict"), text_or_null(q).alias("query"), text_or_null(a).alias("answer"), reasons.cast("array<string>").alias("reasons"))

    null, none = F.lit(None), F.array().cast("array<string>")
    return (
        F.when(query.isNotNull(), turn("search", True, query, null, none))
        .when(answer.isNotNull(), turn("answer", True, null, answer, none))
        .when(last_answer.isNotNull(), turn("answer", False, first_query, last_answer, _reasons((F.lit(True), "answer_turn_not_exact_think_then_answer"), (first_query.isNotNull(), "answer_turn_contains_search_tag"))))
        .when(first_query.isNotNull(), turn("search", False, first_query, null, _reasons((F.lit(True), "search_turn_not_exact_think_then_search"), (has("answer"), "search_turn_contains_answer_tag"))))
        .otherwise(turn("failure", False, null, null, _reasons((F.lit(True), "no_nonempty_answer_or_search_action"), (opened, "unclosed_or_empty_recognized_tag"), (text != "", "turn_not_parseable"))))
    )


#: Tags of a search turn and of a final turn, those that must stand there once and those that must not, in the order of reasons.
SEARCH_ONCE = ("<think>", "</think>", "<search>", "</search>")
SEARCH_NEVER = ("<answer>", "</answer>", "<information>", "</information>")
FINAL_ONCE = ("<think>", "</think>", "<answer>", "</answer>")
FINAL_NEVER = ("<search>", "</search>", "<information>", "</information>")


def _wrong_tags(raw: Column, once: tuple[str, ...], never: tuple[str, ...], prefix: str) -> Column:
    """Reasons for tags that do not stand once in a turn, and for those that stand there at all."""
    count = lambda t: F.regexp_count(F.coalesce(raw, F.lit("")), F.lit(t))
    return _reasons(*[(count(t) != 1, f"{prefix}tag_count_{t}") for t in once], *[(count(t) > 0, f"{prefix}tag_{t}") for t in never])


def validate_trajectory(turns: Column, answered: Column, max_searches: int = 3) -> Column:
    """Distinct reasons, in order of appearance, why turns are not 1 to max_searches strict searches and then a
    strict answer; an empty array if they are."""
    parsed = F.transform(turns, lambda t: F.struct(t.alias("t"), parse_turn(t["raw_output"]).alias("p")))
    no_end = _reasons((~answered, "trajectory_did_not_end_with_nonempty_answer"))

    def judge(rows: Column) -> Column:
        last = F.element_at(rows, -1)
        ends = last["p"]["action"] == "answer"
        before = F.when(ends, F.slice(rows, 1, F.size(rows) - 1)).otherwise(rows)
        searches = F.size(F.filter(before, lambda r: r["p"]["action"] == "search"))
        head = _reasons((~ends, "final_turn_is_not_answer"))
        final = F.when(last["p"]["strict"], F.array().cast("array<string>")).otherwise(last["p"]["reasons"])
        counts = _reasons((last["p"]["answer"].isNull(), "empty_final_answer"), (searches < 1, "requires_at_least_one_search_round"), (searches > max_searches, "too_many_search_rounds"))

        def of_search(r: Column) -> Column:
            info = r["t"]["information"]
            inside = F.regexp_like(F.coalesce(info, F.lit("")), F.lit(r"</?(?:think|search|information|answer)>"))
            malformed = F.when(r["p"]["strict"], F.array().cast("array<string>")).otherwise(r["p"]["reasons"])
            told = F.concat(malformed, _reasons((info.isNull(), "missing_information_after_search"), (inside, "control_tag_inside_information")), _wrong_tags(r["t"]["raw_output"], SEARCH_ONCE, SEARCH_NEVER, "unexpected_"))
            return F.when(r["p"]["action"] == "search", told).otherwise(F.array(F.lit("non_search_turn_before_final_answer")))

        cut = _reasons((F.exists(rows, lambda r: F.coalesce(r["t"]["hit_max_new_tokens"], F.lit(False))), "generation_hit_max_new_tokens"))
        return F.concat(no_end, head, final, counts, F.flatten(F.transform(before, of_search)), _wrong_tags(last["t"]["raw_output"], FINAL_ONCE, FINAL_NEVER, "unexpected_final_"), cut)

    return F.when(F.coalesce(F.size(turns), F.lit(0)) < 1, F.concat(no_end, F.array(F.lit("no_generation_turn")))).otherwise(F.array_distinct(judge(parsed)))


def normalize_thinking(text: Column) -> tuple[Column, Column]:
    """Text with the tag spelled think, and how many spellings were replaced."""
    bare = F.trim(text)
    n = F.regexp_count(bare, F.lit(r"(?i)<thinking\b")) + F.regexp_count(bare, F.lit(r"(?i)</thinking\s*>"))
    return F.regexp_replace(F.regexp_replace(bare, r"(?i)<thinking\b", "<think"), r"(?i)</thinking\s*>", "</think>"), n


def web_results(snippets: Column, most: int = 10, length: int = 1000) -> Column:
    """Distinct non-empty snippets as numbered pages, cut in number and length."""
    kept = F.slice(F.array_distinct(F.filter(F.transform(snippets, lambda s: F.trim(s)), lambda s: F.length(s) > 0)), 1, most)
    pages = F.transform(kept, lambda s, i: F.concat(F.lit("Page "), (i + 1).cast("string"), F.lit(": "), F.substring(s, 1, length)))
    return F.when(F.coalesce(F.size(kept), F.lit(0)) > 0, F.array_join(pages, "\n")).otherwise("No search results found.")


def clip_observation(tokens: Column, most: int, closing: Column) -> Column:
    """Tokens of an observation, cut so that its closing tokens still fit."""
    return F.when(F.size(tokens) > most, F.concat(F.slice(tokens, F.lit(1), F.lit(most) - F.size(closing)), closing)).otherwise(tokens)


def loss_mask(roles: Column, lengths: Column) -> Column:
    """Per token: one in assistant messages, zero elsewhere, from message token counts."""
    return F.flatten(F.zip_with(roles, lengths, lambda r, n: F.array_repeat(F.when(r == "assistant", 1).otherwise(0), n.cast("int"))))


def keep_head_and_tail(tokens: Column, head: int, budget: int) -> Column:
    """The first head tokens and as much of the end as the budget allows."""
    size = F.size(tokens)
    return F.when(size <= budget, tokens).otherwise(F.concat(F.slice(tokens, 1, head), F.slice(tokens, size - (budget - head) + 1, budget - head)))
