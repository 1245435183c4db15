"""Whether a text gives an answer away, and what may be told instead."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import phrase_present, quoted, words

#: Words too common to show relevance.
STOP_WORDS = ("what", "which", "where", "when", "with", "from", "that", "this", "were", "their")


def _spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def aliases(*answers: Column) -> Column:
    """All answers of several arrays, trimmed, without blanks and repeats, in order."""
    return F.array_distinct(F.filter(F.transform(F.flatten(F.array(*[F.coalesce(a, F.array().cast("array<string>")) for a in answers])), lambda a: F.trim(a)), lambda a: a != ""))


def _within(text: Column, part: Column) -> Column:
    return F.contains(F.lower(text), F.lower(part))


def newly_told(text: Column, question: Column, answer: Column, longer_than: int = 3) -> Column:
    """Whether an answer of more than so many characters stands in the text but not in the question."""
    return F.coalesce((F.length(answer) > longer_than) & _within(text, answer) & ~_within(question, answer), F.lit(False))


def leaks_answer(text: Column, answer: Column, visible: Column) -> Column:
    """Whether a text reveals an answer: one that was not visible, or a visible one that it claims to be right."""
    plain, right = F.array_join(words(text), " "), quoted(F.array_join(words(answer), " "))
    claim = F.concat(F.lit(r"(?:correct|final) (?:answer|title|person|film|place) (?:is|was) "), right, F.lit("|answer (?:is|was) "), right, F.lit("|therefore "), right, F.lit(" (?:is|was)"))
    return phrase_present(text, answer) & (~phrase_present(visible, answer) | F.regexp_like(plain, claim))


def query_fault(query: Column, question: Column, answers: Column, tags: bool = True) -> Column:
    """What is wrong with a search query: its length, tags or instructions in it, or an answer that the question does not hold; else empty."""
    n = F.size(F.filter(F.split(_spaced(query), " "), lambda w: w != ""))
    order = F.regexp_like(query, F.lit(r"(?i)<[^>]+>|\b(?:answer|search for|look up|verify that)\b")) if tags else F.lit(False)
    told = F.exists(answers, lambda a: newly_told(query, question, a))
    return F.when(~n.between(3, 30) | (F.length(query) > 240), "length").when(order, "instruction_or_tag").when(told, "privileged_answer").otherwise("")


def safe_handoff(text: Column, question: Column, answers: Column, most: int = 360) -> Column:
    """The text with single blanks, cut to a length; empty if it tells an answer."""
    cut = F.substring(_spaced(text), 1, most)
    return F.when(F.exists(answers, lambda a: newly_told(cut, question, a)), "").otherwise(cut)


def answer_hit(docs: Column, answers: Column) -> Column:
    """Whether a document holds an answer of more than two characters."""
    return F.exists(docs, lambda d: F.exists(answers, lambda a: (F.length(a) > 2) & _within(d, a)))


def relevance(query: Column, docs: Column) -> Column:
    """Over documents, the number of the query's words (four letters or more, common ones aside) that each has."""
    terms = lambda c: F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z]{4,})"), F.lit(1))), F.array(*map(F.lit, STOP_WORDS)))
    return F.aggregate(docs, F.lit(0), lambda s, d: s + F.size(F.array_intersect(terms(query), terms(d))))


def gold_titles(source: Column, titles: Column, hops: Column) -> Column:
    """Titles that hold the evidence, by kind of source: stated ones, or those of the hops (structs with title and question)."""
    return F.when(source.isin("hotpotqa", "2wikimultihopqa"), F.array_distinct(titles)).when(source == "musique", F.array_distinct(F.filter(F.transform(hops, lambda h: h["title"]), lambda t: t != ""))).otherwise(F.array().cast("array<string>"))


def gold_questions(source: Column, hops: Column) -> Column:
    return F.when(source == "musique", F.filter(F.transform(hops, lambda h: h["question"]), lambda q: q != "")).otherwise(F.array().cast("array<string>"))


#: Words that a skill may not use.
PRIVILEGED = r"(?i)\b(?:reward|score|gold|branch|hindsight|better action|correct answer)\b"


def skill_faults(fields: dict[str, Column], answers: Column, good_query: Column, bad_query: Column, titles: Column, keys: Column | None = None) -> Column:
    """Sorted reasons why a generated skill may not be used; fields by name. keys: names that the skill as written has; others than the fields, or
    fewer, are the fault `schema`."""
    whole = F.array_join(F.array(*[F.trim(F.coalesce(fields[k], F.lit(""))) for k in sorted(fields)]), "\n")
    n = F.size(words(whole))
    blank = F.lit(False)
    for c in fields.values():
        blank = blank | (F.trim(F.coalesce(c, F.lit(""))) == "")
    copied = lambda c, least: (F.size(words(c)) >= least) & phrase_present(whole, c)
    faults = {
        "answer_leak": F.exists(answers, lambda a: phrase_present(whole, a)),
        "bad_query_copy": copied(bad_query, 3),
        "empty": blank,
        "length": ~n.between(14, 120),
        "privileged_meta": F.regexp_like(whole, F.lit(PRIVILEGED)),
        "redaction_artifact": F.contains(F.lower(whole), F.lit("[redacted]")),
        "schema": F.lit(False) if keys is None else ~F.coalesce(F.array_sort(F.array_distinct(keys)) == F.array(*map(F.lit, sorted(fields))), F.lit(False)),
        "target_query_copy": copied(good_query, 3),
        "title_copy": F.exists(titles, lambda t: copied(t, 2)),
    }
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in faults.items()]))
