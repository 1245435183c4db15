"""Reward checkers by data source: arithmetic, products, boxed answers."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType

from ..operators.answers import arithmetic, last_boxed

#: Sources whose answers must match; the others are graded by F1.
EXACT_SOURCES = ("nq", "triviaqa", "popqa", "web_questions", "hotpotqa", "2wikimultihopqa", "musique", "bamboogle", "strategyqa")


def by_source(source: Column, exact: Column, graded: Column | None = None) -> Column:
    """The reward of a source: exact match where it is listed, else the graded one; without a graded one, other sources are an error."""
    other = graded if graded is not None else F.raise_error(F.concat(F.lit("no reward for source "), source)).cast("double")
    return F.when(source.isin(*EXACT_SOURCES), exact).otherwise(other)


#: Rewards by name, for a source's configuration: functions of (response, truth) columns.
REGISTRY: dict[str, Callable[[Column, Column], Column]] = {}


def reward(name: str):
    def register(f: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
        REGISTRY[name] = f
        return f

    return register


def assistant_answer(text: Column) -> Column:
    """The last answer on one line after the first `Assistant:`, stripped; null without either."""
    said = F.substr(text, F.locate("Assistant:", text) + len("Assistant:"))
    found = F.regexp_extract_all(said, F.lit("<answer>([^\n]*?)</answer>"), F.lit(1))
    return F.when(F.contains(text, F.lit("Assistant:")) & (F.size(found) > 0), F.trim(F.try_element_at(found, F.lit(-1))))


@reward("multiply")
def multiply(text: Column, truth: Column, form: float = 0.1, full: float = 1.0) -> Column:
    """Full for the right whole number, form for another one, nothing for anything else."""
    got = F.regexp_extract(assistant_answer(text), r"^([+-]?\d+)$", 1).try_cast("long")
    return F.when(got.isNull(), 0.0).when(got == truth.cast("long"), F.lit(full)).otherwise(F.lit(form))


@F.pandas_udf(DoubleType())
def evaluated(equation: pd.Series) -> pd.Series:
    allowed = re.compile(r"[\d+\-*/().\s]+")
    return equation.map(lambda t: None if t is None or not allowed.fullmatch(t) else arithmetic(t)).astype(float)


def uses_each_once(equation: Column, numbers: Column) -> Column:
    """Whether the whole numbers of an equation are these, each once."""
    found = F.transform(F.regexp_extract_all(equation, F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("long"))
    return F.array_sort(found) == F.array_sort(F.transform(numbers, lambda x: x.cast("long")))


def countdown(text: Column, numbers: Column, target: Column, form: float = 0.1, full: float = 1.0) -> Column:
    """Full for an equation that uses each number once and comes to the target, form for any other, nothing without one."""
    said = assistant_answer(text)
    right = uses_each_once(said, numbers) & (F.abs(evaluated(said) - target) < 1e-5)
    return F.when(said.isNull(), 0.0).when(F.coalesce(right, F.lit(False)), F.lit(full)).otherwise(F.lit(form))


#: What is dropped from a LaTeX answer or written in another way, in this order.
DROPPED = (("\n", ""), ("\\!", ""), ("\\\\", "\\"), ("tfrac", "frac"), ("dfrac", "frac"), ("\\left", ""), ("\\right", ""), ("^{\\circ}", ""), ("^\\circ", ""), ("\\$", ""))
UNITS, PERCENT, ZEROS = "\\text{ ", "\\%", ((" .", " 0."), ("{.", "{0."))


def plain_latex(text: str) -> str:
    """A LaTeX answer in the form in which answers are compared."""
    for old, new in DROPPED:
        text = text.replace(old, new)
    if text.count(UNITS) > 1:
        raise ValueError("units twice")
    text = text.split(UNITS)[0].replace(PERCENT, "")
    for old, new in ZEROS:
        text = text.replace(old, new)
    text = "0" + text if text.startswith(".") else text
    name, equals, value = text.partition("=")
    if equals and "=" not in value and len(name) <= 2:
        text = value
    # An argument of one character gets its braces; a root or a fraction that ends the text is malformed.
    if re.search(r"\\sqrt$", text):
        raise ValueError("root of nothing")
    text = re.sub(r"\\sqrt([^{])", r"\\sqrt{\1}", text).replace(" ", "")
    if re.search(r"\\frac$", text):
        raise ValueError("fraction of nothing")
    if not re.search(r"\\frac[^{](?:$|\\frac)", text):
        text = re.sub(r"\\frac([^{])([^{])", r"\\frac{\1}{\2}", text)
        text = re.sub(r"\\frac([^{])(?=\{)", r"\\frac{\1}", text)
    text = "\\frac{1}{2}" if text == "0.5" else text
    return re.sub(r"\A(-?(?:0|[1-9]\d*))/(-?(?:0|[1-9]\d*))\Z", r"\\frac{\1}{\2}", text)


def same_answer(a: str | None, b: str | None) -> bool:
    if a is None or b is None:
        return a is b
    try:
        return plain_latex(a) == plain_latex(b)
    except ValueError:
        return a == b


def boxed(text: str | None) -> str | None:
    """Content of the last box: braces matched, or what follows `\\boxed ` up to a dollar."""
    if text and "\\boxed " in text:
        return text.rsplit("\\boxed ", 1)[1].split("$")[0]
    return last_boxed(text)


@F.pandas_udf(StringType())
def boxed_answer(text: pd.Series) -> pd.Series:
    return text.map(boxed)


@F.pandas_udf(BooleanType())
def equivalent(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([same_answer(x, y) for x, y in zip(a, b, strict=True)])


@reward("math")
def math(text: Column, truth: Column) -> Column:
    """One for a boxed answer equivalent to the truth, else nothing."""
    said = boxed_answer(text)
    return F.when(said.isNotNull() & equivalent(said, truth), 1.0).otherwise(0.0)


def upgraded(score: Column, judged: Column, valid: Column, structure: float = 0.2) -> Column:
    """The score, or where a judge holds the answer equivalent, one, less the structure's share if the form is broken."""
    return F.when(F.coalesce(judged, F.lit(False)), F.when(valid, 1.0).otherwise(F.lit(1 - structure))).otherwise(score)


def judged(rows, judge: Callable[[list[tuple]], list[bool]], columns: list[str], batch: int = 64, into: str = "equivalent"):
    """rows with a judge's verdicts. It is asked for `batch` rows at a time; a failure or a wrong number of answers makes all of them false."""

    def ask(frames):
        for frame in frames:
            verdicts: list[bool] = []
            for at in range(0, len(frame), batch):
                part = list(frame[columns].iloc[at : at + batch].itertuples(index=False, name=None))
                try:
                    got = [bool(x) for x in judge(part)]
                except Exception:  # whatever the judge's service raises
                    got = []
                verdicts += got if len(got) == len(part) else [False] * len(part)
            yield frame.assign(**{into: verdicts})

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(ask, f"{names}, `{into}` boolean")
