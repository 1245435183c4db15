"""Public tokenizers over columns: ids, texts from ids, and the token arrays that training rows are made of.

A vocabulary is a file (`*.json` of tokenizers, `*.tiktoken` ranks with their pattern, `*.model` of sentencepiece) whose path is given; every worker
reads it from there once. Texts go to Python in Arrow batches and as a whole. Nothing is trained here.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what a label that does not count is.
IGNORED = -100
#: Characters or ids that go to a vocabulary at a time.
PART = 1 << 18


@lru_cache(maxsize=4)
def _loaded(path: str, pattern: str | None):
    """(encode many, decode many) of a vocabulary file."""
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        return lambda xs: [e.ids for e in t.encode_batch(xs, add_special_tokens=False)], lambda rows: t.decode_batch(rows, skip_special_tokens=False)
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        e = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return lambda xs: [e.encode_ordinary(x) for x in xs], lambda rows: [e.decode(r) for r in rows]
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda xs: [p.encode(x) for x in xs], lambda rows: [p.decode(r) for r in rows]


def _in_parts(items: list, convert, kind: pa.DataType) -> pa.Array:
    """What convert makes of the items, null of null. PART characters or ids at a time, as an encoding takes many times the memory of its text."""
    done, part, size = [], [], 0

    def finish() -> None:
        found = iter(convert([x for x in part if x is not None]))
        done.append(pa.array([None if x is None else next(found) for x in part], kind))

    for x in items:
        if part and x and size + len(x) > PART:
            finish()
            part, size = [], 0
        part.append(x)
        size += len(x or ())
    if part:
        finish()
    return pa.concat_arrays(done) if done else pa.array([], kind)


def encoded(text: Column, path: str, pattern: str | None = None) -> Column:
    """Token ids of a text; null of null."""

    @F.arrow_udf("array<int>")
    def ids(column: pa.Array) -> pa.Array:
        return _in_parts(column.to_pylist(), _loaded(path, pattern)[0], pa.list_(pa.int32()))

    return ids(text)


def decoded(ids: Column, path: str, pattern: str | None = None) -> Column:
    @F.arrow_udf("string")
    def texts(column: pa.Array) -> pa.Array:
        return pa.concat_arrays([pa.array([], pa.string()), *(_in_parts(c.to_pylist(), _loaded(path, pattern)[1], pa.string()) for c in (column.slice(at, 256) for at in range(0, len(column), 256)))])

    return texts(ids)


def fitted(ids: Column, length: int, pad: int, left: bool = False, cut: str = "right") -> Column:
    """ids in exactly `length` places, filled with pad on one side, cut on the right or left, or an error if they are too many (cut=`error`)."""
    n = F.size(ids)
    if cut not in ("left", "right", "error"):
        raise ValueError(f"unknown cut {cut!r}")
    over = F.raise_error(F.concat(F.lit("too many tokens: "), n.cast("string"))).cast("array<int>") if cut == "error" else F.slice(ids, n - length + 1, length) if cut == "left" else F.slice(ids, 1, length)
    fill = F.array_repeat(F.lit(pad), F.greatest(F.lit(0), F.lit(length) - n))
    return F.when(n > length, over).otherwise(F.concat(fill, ids) if left else F.concat(ids, fill))


def training_row(prompt: Column, response: Column, length: int, least_prompt: int = 256, most_head: int = 768) -> Column:
    """struct(input_ids, labels) of at most `length` tokens: of a prompt that is too long its head (up to `most_head`, at most half) and its newest tail;
    labels are the response's, prompt tokens are ignored. A response that leaves the prompt under `least_prompt` tokens is an error."""
    keep = F.lit(length) - F.size(response)
    head = F.least(F.lit(most_head), F.floor(keep / 2).cast("int"))
    n = F.size(prompt)
    kept = F.when(keep < least_prompt, F.raise_error(F.lit(f"response too long for {length} tokens")).cast("array<int>")).when(n > keep, F.concat(F.slice(prompt, F.lit(1), head), F.slice(prompt, n - (keep - head) + 1, keep - head))).otherwise(prompt)
    return F.struct(F.concat(kept, response).alias("input_ids"), F.concat(F.transform(kept, lambda _: F.lit(IGNORED)), response).alias("labels"))


def preference_sides(prompt: Column, chosen: Column, rejected: Column, length: int, eos: int, pad: int) -> Column:
    """array of two struct(input_ids, attention_mask): prompt with the chosen and with the rejected answer, an end token, cut and filled on the right."""
    side = lambda answer: F.concat(prompt, answer, F.array(F.lit(eos)))
    made = lambda ids: F.struct(fitted(ids, length, pad).alias("input_ids"), F.transform(F.sequence(F.lit(1), F.lit(length)), lambda i: (i <= F.size(ids)).cast("int")).alias("attention_mask"))
    return F.array(made(side(chosen)), made(side(rejected)))


def unpadded(ids: Column, mask: Column) -> Column:
    """The ids whose mask is not zero."""
    return F.transform(F.filter(F.arrays_zip(ids.alias("i"), mask.alias("m")), lambda x: x["m"] != 0), lambda x: x["i"])


def split(ids: Column, size: int) -> Column:
    """An array cut into arrays of `size`, the last maybe shorter."""
    return F.when(F.size(ids) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(ids) - 1) / size).cast("int")), lambda i: F.slice(ids, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<array<int>>"))
