"""Trajectories as text, parts and messages, and what is read out of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TAG = r"</?(?:think|search|information|answer)>"
#: A block whose body holds none of the tags.
_BODY = rf"((?:(?!{TAG}).)*+)"


def _block(tag: str, body: str = _BODY) -> str:
    return rf"<{tag}>{body}</{tag}>"


_LOOSE = r"\s*"
_ROUND = _LOOSE.join(map(_block, ("think", "search", "information")))
_FINAL = _LOOSE.join(map(_block, ("think", "answer")))
_OPEN = lambda pattern: pattern.replace("((?:", "(?:(?:")


def parts(trajectory: Column, least: int = 1, most: int = 3) -> Column:
    """Struct of rounds (think, query, information), final_think, answer and fault. A trajectory is `least` to `most` rounds and a final
    thought with its answer, blanks between blocks aside; bodies are kept as they are. With a fault there are no parts."""
    text = F.coalesce(trajectory, F.lit(""))
    whole = F.regexp_like(text, F.lit(rf"(?s)\A{_LOOSE}(?:{_OPEN(_ROUND)}{_LOOSE})*{_OPEN(_FINAL)}{_LOOSE}\z"))
    take = lambda pattern, i: F.regexp_extract_all(text, F.lit(rf"(?s){pattern}"), F.lit(i))
    rounds = F.arrays_zip(*[take(_ROUND, i + 1).alias(n) for i, n in enumerate(("think", "query", "information"))])
    final = lambda i: F.regexp_extract(text, rf"(?s){_FINAL}{_LOOSE}\z", i)
    n = F.size(take(_ROUND, 0))
    fault = (
        F.when(~whole, "malformed")
        .when(F.exists(rounds, lambda r: F.trim(r["query"]) == ""), "empty_query")
        .when(F.trim(final(2)) == "", "empty_answer")
        .when(~n.between(least, most), "number_of_searches")
    )
    ok = fault.isNull()
    return F.struct(F.when(ok, rounds).alias("rounds"), F.when(ok, final(1)).alias("final_think"), F.when(ok, final(2)).alias("answer"), fault.alias("fault"))


def wrapped(tag: str, body: Column) -> Column:
    return F.concat(F.lit(f"<{tag}>"), body, F.lit(f"</{tag}>"))


def messages(instruction: Column, found: Column) -> Column:
    """Chat messages of parts(): the instruction, each round's action with its information as the user's turn, and the answer."""
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    rounds = F.flatten(F.transform(found["rounds"], lambda r: F.array(turn("assistant", F.concat(wrapped("think", r["think"]), wrapped("search", r["query"]))), turn("user", wrapped("information", r["information"])))))
    return F.concat(F.array(turn("user", instruction)), rounds, F.array(turn("assistant", F.concat(wrapped("think", found["final_think"]), wrapped("answer", found["answer"])))))


def trajectory(chat: Column) -> Column:
    """messages() undone; null where the messages do not alternate or do not have the form of an action, its information or the answer."""
    rest = F.slice(chat, F.lit(2), F.greatest(F.size(chat) - 1, F.lit(0)))
    action, final = F.lit(rf"(?s)\A{_OPEN(_block('think') + _block('search'))}\z"), F.lit(rf"(?s)\A{_OPEN(_block('think') + _block('answer'))}\z")
    info = F.lit(rf"(?s)\A{_OPEN(_block('information'))}\z")
    last = F.size(rest) - 1
    good = lambda m, i: F.when(i == last, (m["role"] == "assistant") & F.regexp_like(m["content"], final)).when(i % 2 == 0, (m["role"] == "assistant") & F.regexp_like(m["content"], action)).otherwise((m["role"] == "user") & F.regexp_like(m["content"], info))
    sound = (F.size(rest) % 2 == 1) & (F.lower(chat[0]["role"]) == "user") & F.forall(F.transform(rest, good), lambda x: x)
    return F.when(sound, F.array_join(F.transform(rest, lambda m: m["content"]), ""))


def only_information_changed(before: Column, after: Column) -> Column:
    """Whether two message lists differ in nothing but what stands between information tags."""
    info = rf"(?s)\A{_OPEN(_block('information'))}\z"
    same = lambda a, b: (a["role"] == b["role"]) & ((a["content"] == b["content"]) | (F.regexp_like(a["content"], F.lit(info)) & F.regexp_like(b["content"], F.lit(info))))
    return (F.size(before) == F.size(after)) & F.coalesce(F.forall(F.zip_with(before, after, same), lambda x: F.coalesce(x, F.lit(False))), F.lit(False))


def flat_faults(query_turn: Column, information: Column, answer_turn: Column) -> Column:
    """Reasons why two turns are not a one-search trajectory; empty if they are."""
    ask, say = (F.coalesce(c, F.lit("")) for c in (query_turn, answer_turn))
    stage = lambda tag: rf"(?s)\A\s*<think>(.*?)</think>\s*<{tag}>(.*?)</{tag}>\s*\z"
    asked, said = F.regexp_like(ask, F.lit(stage("search"))), F.regexp_like(say, F.lit(stage("answer")))
    both = F.concat(ask, F.lit("\n"), say)
    found = [(~asked, "query_stage_not_exactly_think_then_search"), (~said, "answer_stage_not_exactly_think_then_answer")]
    found += [(asked & (F.trim(F.regexp_extract(ask, stage("search"), 2)) == ""), "empty_search_query"), (said & (F.trim(F.regexp_extract(say, stage("answer"), 2)) == ""), "empty_final_answer")]
    for tag, n in (("think", 2), ("search", 1), ("answer", 1)):
        found += [(F.regexp_count(both, F.lit(f"<{tag}>")) != n, f"tag_count_{tag}"), (F.regexp_count(both, F.lit(f"</{tag}>")) != n, f"tag_count_close_{tag}")]
    found += [(F.regexp_like(both, F.lit("</?information>")), "information_tag_in_teacher_output"), (F.regexp_like(F.coalesce(information, F.lit("")), F.lit(TAG)), "control_tag_inside_information")]
    return F.array_compact(F.array(*[F.when(c, F.lit(r)) for c, r in found]))


def assembled(turns: Column) -> Column:
    """Turns (structs of raw_output and information) as one text, with blank lines between."""
    said = F.transform(turns, lambda t: F.array(F.when(F.trim(F.coalesce(t["raw_output"], F.lit(""))) != "", F.trim(t["raw_output"])), F.when(t["information"].isNotNull(), wrapped("information", F.trim(t["information"])))))
    return F.array_join(F.array_compact(F.flatten(said)), "\n\n")


def question(prompt: Column, last: bool = False) -> Column:
    """What follows `Question:` in the user's message (the first, else the first of all): from its first place, or its last."""
    asked = F.try_element_at(F.filter(prompt, lambda m: m["role"] == "user"), F.lit(1))["content"]
    text = F.coalesce(F.when(asked != "", asked), prompt[0]["content"])
    after = F.substring_index(text, "Question:", -1) if last else F.regexp_replace(text, r"(?s)\A.*?Question:", "")
    return F.trim(after)


def _lines(found: Column) -> Column:
    return F.filter(F.transform(found, lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")


def queries(text: Column) -> Column:
    return _lines(F.regexp_extract_all(text, F.lit(r"(?is)<search>(.*?)</search>"), F.lit(1)))


def titles(text: Column) -> Column:
    return _lines(F.regexp_extract_all(text, F.lit(r"(?i)Title:\s*[\"']([^\"']+)[\"']"), F.lit(1)))


def edge(parent: Column, child: Column) -> Column:
    """What a child adds to its parent's text; null if it does not begin with that."""
    return F.when(F.startswith(F.coalesce(child, F.lit("")), F.coalesce(parent, F.lit(""))), F.substr(F.coalesce(child, F.lit("")), F.length(F.coalesce(parent, F.lit(""))) + 1))


def _first(text: Column, tag: str) -> Column:
    found = F.trim(F.regexp_extract(text, rf"(?is)<{tag}>(.*?)</{tag}>", 1))
    return F.when(found != "", found)


def action_parts(text: Column) -> Column:
    """Struct of think and search of an edge, both not empty; null without one of them."""
    think, search = _first(text, "think"), _first(text, "search")
    return F.when(think.isNotNull() & search.isNotNull(), F.struct(think.alias("think"), search.alias("search")))


def evidence(text: Column, most: int) -> Column:
    return F.coalesce(F.substring(_first(text, "information"), 1, most), F.lit(""))


def correction(text: Column) -> Column:
    """action_parts() whose search is one line without a tag."""
    found = action_parts(text)
    return F.when(~F.regexp_like(found["search"], F.lit(r"[<\n]")), found)


def hop(text: Column, fallback: str) -> Column:
    """Struct of think and query, read tolerantly: fences and what surrounds the blocks do not matter, a long query is cut to thirty
    words; null without a usable query."""
    bare = F.regexp_replace(F.trim(text), r"(?i)^```(?:json|html|text)?\s*|\s*```$", "")
    spaced = lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))
    cut = F.array_join(F.slice(F.split(F.trim(spaced(F.regexp_extract(bare, r"(?is)<search>\s*(.*?)\s*</search>", 1)), F.lit("\"'")), " "), 1, 30), " ")
    n = F.size(F.filter(F.split(cut, " "), lambda w: w != ""))
    think = F.trim(F.regexp_replace(spaced(F.regexp_extract(bare, r"(?is)<think>\s*(.*?)\s*</think>", 1)), r"(?is)<answer>.*?</answer>", ""))
    fine = (n >= 3) & (F.length(cut) <= 240) & ~F.regexp_like(cut, F.lit(TAG))
    return F.when(fine, F.struct(F.when(think != "", think).otherwise(fallback).alias("think"), cut.alias("query")))


def kept_ends(text: Column, kept: Column, marker: str) -> Column:
    """The first and last halves of `kept` characters around a marker; the text itself if it is no longer."""
    n = F.greatest(F.lit(0), F.least(kept.cast("int"), F.length(text)))
    head, tail = F.substr(text, F.lit(1), F.floor((n + 1) / 2).cast("int")), F.substr(text, F.length(text) - F.floor(n / 2).cast("int") + 1, F.floor(n / 2).cast("int"))
    return F.when(n >= F.length(text), text).otherwise(F.array_join(F.filter(F.array(head, F.lit(marker), tail), lambda x: x != ""), " "))


#: How a credential begins in text.
CREDENTIAL = r"(?i)(bearer\s+|api[_ -]?key\s*[:=]\s*)([^\s,\"']+)"


def redacted(text: Column, key: str | None = None) -> Column:
    """Text without a known key and without what follows a word for credentials."""
    bare = F.replace(text, F.lit(key), F.lit("[REDACTED_API_KEY]")) if key else text
    return F.regexp_replace(bare, CREDENTIAL, r"$1[REDACTED_API_KEY]")


def redacted_value(value: Column, kind, key: str | None = None) -> Column:
    """redacted() on every string within a value of a Spark type: structs, arrays and the values of maps, however deep."""
    from pyspark.sql import types as T

    if isinstance(kind, T.StringType):
        return redacted(value, key)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: redacted_value(x, kind.elementType, key))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, x: redacted_value(x, kind.valueType, key))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[redacted_value(value[f.name], f.dataType, key).alias(f.name) for f in kind.fields]))
    return value


def normalized_messages(messages: Column) -> Column:
    """Messages (structs of role and content) with roles and contents trimmed; null where they must be rejected: none, one without a role or a
    content, or an end that is no assistant's word."""
    neat = F.transform(messages, lambda m: F.struct(F.trim(m["role"]).alias("role"), F.trim(m["content"]).alias("content")))
    sound = (F.size(messages) > 0) & F.forall(neat, lambda m: m["content"].isNotNull() & (F.coalesce(m["role"], F.lit("")) != ""))
    last = F.try_element_at(neat, F.lit(-1))
    return F.when(F.coalesce(sound & (last["role"] == "assistant") & (last["content"] != ""), F.lit(False)), neat)


def stable_id(*parts: Column) -> Column:
    """16 hex digits of a SHA-256 over the parts, joined by colons; a null part counts as empty."""
    return F.substring(F.sha2(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"), 256), 1, 16)
