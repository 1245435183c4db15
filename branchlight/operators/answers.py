"""Answer checkers that need more than column functions: arithmetic, braces, JSON in prose, token budgets."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Callable
from operator import add, mul, sub, truediv

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

_OPS = {ast.Add: add, ast.Sub: sub, ast.Mult: mul, ast.Div: truediv}


def arithmetic(text: str) -> float | None:
    """Value of + - * / over numbers and brackets; None for anything else."""

    def value(node: ast.AST) -> float:
        if isinstance(node, ast.Expression):
            return value(node.body)
        if isinstance(node, ast.Constant) and isinstance(node.value, int | float) and not isinstance(node.value, bool):
            return node.value
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
            return -value(node.operand)
        if isinstance(node, ast.BinOp) and type(node.op) in _OPS:
            return _OPS[type(node.op)](value(node.left), value(node.right))
        raise ValueError(text)

    try:
        return value(ast.parse(text.strip(), mode="eval"))
    except (SyntaxError, ValueError, ZeroDivisionError, RecursionError, MemoryError):
        return None


def countdown_score(equation: str | None, numbers: list[int], target: float, form: float = 0.1, full: float = 1.0) -> float:
    """Full if the equation uses each number once and gives the target, form for any other equation."""
    if equation is None:
        return 0.0
    if sorted(int(n) for n in re.findall(r"\d+", equation)) != sorted(numbers):
        return form
    got = arithmetic(equation)
    return full if got is not None and abs(got - target) < 1e-5 else form


def last_boxed(text: str | None) -> str | None:
    """Content of the last \\boxed{...}, braces matched; None if there is none or it does not close."""
    at = (text or "").rfind("\\boxed{")
    if at < 0:
        return None
    depth = 0
    for i in range(at + 6, len(text)):
        depth += (text[i] == "{") - (text[i] == "}")
        if not depth:
            return text[at + 7 : i]
    return None


def first_json_object(text: str | None) -> dict | None:
    """The first object that parses, fenced blocks before the rest."""
    decoder = json.JSONDecoder()
    for part in [*re.findall(r"```(?:json)?\s*(.*?)```", text or "", re.S), text or ""]:
        for m in re.finditer(r"\{", part):
            try:
                got, _ = decoder.raw_decode(part[m.start() :])
            except ValueError:
                continue
            if isinstance(got, dict):
                return got
    return None


def compress_to_budget(text: str, budget: int, count: Callable[[str], int], marker: str = "\n[...]\n", steps: int = 40) -> str:
    """Head and tail of equal share around a marker, as long as count() allows; the text itself if it fits."""
    if count(text) <= budget:
        return text
    low, high = 0.0, 1.0
    for _ in range(steps):
        share = (low + high) / 2
        n = int(len(text) * share / 2)
        low, high = (share, high) if count(text[:n] + marker + text[len(text) - n :]) <= budget else (low, share)
    n = int(len(text) * low / 2)
    short = text[:n] + marker + text[len(text) - n :]
    if count(short) > budget:
        raise ValueError("the fixed part alone is over the budget")
    return short


@F.pandas_udf(StringType())
def last_boxed_column(text: pd.Series) -> pd.Series:
    return text.map(last_boxed)


@F.pandas_udf(DoubleType())
def arithmetic_column(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else arithmetic(t)).astype(float)


def compressing(budget: int, count: Callable[[str], int], marker: str = "\n[...]\n"):
    """compress_to_budget() as a column function, with a count of tokens given from outside."""

    @F.pandas_udf(StringType())
    def shorten(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else compress_to_budget(t, budget, count, marker))

    return shorten


def gsm8k_answer(text, strict: bool = True):
    """Number after ####, without commas and dollars; or the last number that is more than a dot."""
    if strict:
        got = F.regexp_replace(F.regexp_extract(text, r"#### (-?[0-9.,]+)", 1), "[,$]", "")
        return F.when(F.regexp_like(text, F.lit(r"#### -?[0-9.,]+")), got)
    found = F.regexp_extract_all(text, F.lit(r"(-?[0-9.,]+)"), F.lit(1))
    good = F.filter(found, lambda x: ~x.isin("", "."))
    # Where all are dots, the first of them is what remains.
    return F.when(F.size(good) > 0, F.element_at(good, -1)).when(F.size(found) > 0, found[0])
