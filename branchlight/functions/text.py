"""Answer normalisation and scoring, redaction and phrase tests, column by column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII punctuation as a Java character class.
PUNCTUATION = r"[!-/:-@\[-\x60{-~]"
TAGS = ("think", "search", "information", "answer")


def normalize_answer(s: Column) -> Column:
    """Lower case, no ASCII punctuation, no articles, single blanks, in this order."""
    bare = F.regexp_replace(F.lower(s), PUNCTUATION, "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?U)\b(a|an|the)\b", " "), r"(?U)\s+", " "))


def em_check(prediction: Column, golds: Column) -> Column:
    return F.exists(golds, lambda g: normalize_answer(g) == normalize_answer(prediction))


def subem_check(prediction: Column, golds: Column) -> Column:
    return F.exists(golds, lambda g: F.contains(normalize_answer(prediction), normalize_answer(g)))


def answer_em(prediction: Column, golds: Column) -> Column:
    """As em_check(), but an empty prediction is never right."""
    return (F.length(normalize_answer(prediction)) > 0) & em_check(prediction, golds)


def last_answer(response: Column, at_least: int = 1) -> Column:
    """Stripped content of the last answer block; null with fewer than at_least blocks."""
    found = F.regexp_extract_all(response, F.lit(r"(?s)<answer>(.*?)</answer>"), F.lit(1))
    return F.when(F.size(found) >= at_least, F.trim(F.element_at(found, -1)))


def extract_solution(sequence: Column) -> Column:
    """The last answer block, where the prompt holds one itself."""
    return last_answer(sequence, 2)


def score(prediction: Column, right: Column, full: float = 1.0, form: float = 0.1) -> Column:
    """Zero without a prediction, full if right, else the score for form."""
    return F.when(prediction.isNull(), 0.0).when(right, F.lit(full)).otherwise(F.lit(form))


def tokens(normalized: Column) -> Column:
    return F.filter(F.split(normalized, " "), lambda t: t != "")


def token_f1(prediction: Column, gold: Column) -> Column:
    """Multiset F1 of normalised tokens; yes, no and noanswer must match whole."""
    # Normalised once, as fields of one struct, and read from there.
    form = lambda s: F.struct(normalize_answer(s).alias("s"), tokens(normalize_answer(s)).alias("t"))
    return F.transform(F.array(F.struct(form(prediction).alias("p"), form(gold).alias("g"))), lambda x: f1_of(x["p"]["s"], x["g"]["s"], x["p"]["t"], x["g"]["t"]))[0]


def f1_of(p: Column, g: Column, a: Column, b: Column) -> Column:
    """token_f1() of texts already normalised and cut."""
    times = lambda xs, t: F.size(xs) - F.size(F.array_remove(xs, t))
    same = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda s, t: s + F.least(times(a, t), times(b, t)))
    special = [F.lit(x) for x in ("yes", "no", "noanswer")]
    whole = (p.isin(*special) | g.isin(*special)) & (p != g)
    # 2 P R / (P + R), with P and R the common share of either side.
    return F.when(whole | (same == 0), 0.0).otherwise(2 * same / (F.size(a) + F.size(b)))


def best_f1(prediction: Column, golds: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(golds, lambda g: token_f1(prediction, g))), F.lit(0.0))


def words(s: Column) -> Column:
    """Casefolded runs of word characters."""
    return F.regexp_extract_all(F.lower(s), F.lit(r"(?U)(\w+)"), F.lit(1))


def phrase_present(haystack: Column, needle: Column) -> Column:
    """Whether the words of needle stand in haystack in a row; empty needles do not."""
    pad = lambda s: F.concat(F.lit(" "), F.array_join(words(s), " "), F.lit(" "))
    return (F.size(words(needle)) > 0) & F.contains(pad(haystack), pad(needle))


def jaccard(a: Column, b: Column) -> Column:
    """Of distinct tokens; zero if either side has none."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def question_key(s: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(s, r"(?U)\s+", " ")))


def quoted(s: Column) -> Column:
    """s as a pattern that matches itself."""
    return F.regexp_replace(s, r"([\\.\[\](){}*+?^$|])", r"\\$1")


def redact(text: Column, aliases: Column, mark: str = "[REDACTED]") -> Column:
    """Aliases, longest first, replaced where no word character touches them."""
    longest = F.array_sort(F.filter(aliases, lambda a: F.length(a) > 0), lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0))
    return F.aggregate(longest, text, lambda t, a: F.regexp_replace(t, F.concat(F.lit(r"(?iU)(?<!\w)"), quoted(a), F.lit(r"(?!\w)")), F.lit(mark.replace("[", r"\[").replace("]", r"\]"))))


def tag_count(text: Column, tag: str) -> Column:
    return F.regexp_count(text, F.lit(f"<{tag}>"))


def first_action(response: Column) -> Column:
    """Struct of action and content of the first search or answer block; nulls without one."""
    action = F.regexp_extract(response, r"(?s)<(search|answer)>(.*?)</\1>", 1)
    content = F.trim(F.regexp_extract(response, r"(?s)<(search|answer)>(.*?)</\1>", 2))
    return F.struct(F.when(action != "", action).alias("action"), F.when(action != "", content).alias("content"))


def cut_at_action(response: Column) -> Column:
    """Text up to the first </search>, if there is one, else up to the first </answer>."""
    upto = lambda tag: F.concat(F.substring_index(response, tag, 1), F.lit(tag))
    return F.when(F.contains(response, F.lit("</search>")), upto("</search>")).when(F.contains(response, F.lit("</answer>")), upto("</answer>")).otherwise(response)


_TAG = r"</?(?:think|search|information|answer)>"
#: Anything but a tag, and a block whose body is that.
_FREE = rf"(?:(?!{_TAG}).)*+"


def _blocks(between: str, *tags: str) -> str:
    return between.join(f"<{t}>{_FREE}</{t}>" for t in tags)


#: The strict form: searches with their information after a thought each, then a thought with the answer; blanks between.
STRICT = rf"\s*(?:{_blocks(chr(92) + 's*', 'think', 'search', 'information')}\s*)*{_blocks(chr(92) + 's*', 'think', 'answer')}\s*"
#: The lax form: a search may open the sequence, an answer may follow information, and free text may stand between blocks.
_SEARCH, _THINK, _ANSWER = _blocks(_FREE, "search", "information"), _blocks(_FREE, "think"), _blocks(_FREE, "answer")
LAX = rf"{_FREE}(?:{_THINK}{_FREE}{_ANSWER}|(?:{_THINK}{_FREE})?{_SEARCH}{_FREE}(?:{_THINK}{_FREE}{_SEARCH}{_FREE})*(?:{_THINK}{_FREE})?{_ANSWER}){_FREE}"
#: Where the assistant begins to speak.
ASSISTANT = r"<\|im_start\|>assistant\s*"


def valid_sequence(text: Column, form: str = STRICT, marker: bool = False) -> Column:
    """Whether text has the form; with marker, what follows the assistant's first marker, which must be there."""
    start = rf"(?:(?!{ASSISTANT}).)*+{ASSISTANT}" if marker else ""
    return F.regexp_like(text, F.lit(rf"(?s)\A{start}{form}\z"))


def sequence_fault(text: Column, form: str = STRICT) -> Column:
    """Why a text with an assistant's marker is not valid: no marker, tags that do not balance (the first kind of them), or their order; else empty."""
    said = F.regexp_extract(text, rf"(?s)\A(?:(?!{ASSISTANT}).)*+{ASSISTANT}(.*)\z", 1)
    fault = F.when(~F.regexp_like(text, F.lit(ASSISTANT)), "missing_assistant_marker")
    for tag in TAGS:
        fault = fault.when(F.regexp_count(said, F.lit(f"<{tag}>")) != F.regexp_count(said, F.lit(f"</{tag}>")), f"unbalanced_{tag}")
    return fault.when(~valid_sequence(said, form), "order_or_content").otherwise("")


def information_blocks(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?s)<information>(.*?)</information>"), F.lit(1)), lambda b: F.trim(b))


def retrieval_correct(text: Column, golds: Column) -> Column:
    return F.exists(information_blocks(text), lambda b: F.exists(golds, lambda g: F.contains(normalize_answer(b), normalize_answer(g))))


def shaped_f1(valid: Column, f1: Column, found: Column, prediction: Column, structure: float = 0.2, retrieval: float = 0.1) -> Column:
    """As shaped_score() with a graded answer: the F1 if above zero, less the structure's share if the form is
    broken; wrong answers in broken form give nothing."""
    form = F.when(valid, F.when(found, F.lit(structure + retrieval)).otherwise(F.lit(structure))).otherwise(F.lit(0.0))
    return F.when(prediction.isNull() | (f1 == 0), form).otherwise(F.when(valid, f1).otherwise(f1 - structure))


def shaped_score(valid: Column, right: Column, found: Column, prediction: Column, structure: float = 0.2, final: float = 0.1, retrieval: float = 0.1) -> Column:
    """Right: one, less the structure's share if the form is broken. Wrong: the structure's share (with the
    retrieval's if evidence was found) for good form, else the final form's; nothing without an answer."""
    return (
        F.when(prediction.isNull(), F.when(valid, F.when(found, F.lit(structure + retrieval)).otherwise(F.lit(structure))).otherwise(F.lit(0.0)))
        .when(right, F.when(valid, F.lit(1.0)).otherwise(F.lit(1 - structure)))
        .when(valid, F.when(found, F.lit(structure + retrieval)).otherwise(F.lit(structure)))
        .otherwise(F.lit(final))
    )


def heldout(uid: Column, seed: int, fraction: float) -> Column:
    """Whether the first 64 bits of sha256("seed:uid"), as a share of all, lie below fraction."""
    head = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), uid).cast("binary"), 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return head.cast("double") / float(2**64) < fraction


def redact_credentials(text: Column) -> Column:
    """Values of keys that name credentials, and bearer tokens, blanked in JSON text."""
    named = F.regexp_replace(text, r'(?i)("(?:api_?key|authorization|token|secret|password)"\s*:\s*)"[^"]*"', r'$1"[REDACTED]"')
    return F.regexp_replace(named, r"(?i)bearer\s+[A-Za-z0-9._-]+", "Bearer [REDACTED]")
