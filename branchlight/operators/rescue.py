"""Rescued rows spliced into a batch of token arrays, and seeded trees that grow the same from any node."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .selection import leaf_kd_mask
from .trees import paths


def padded(x: Column, width: Column, fill: Column) -> Column:
    """x with fill behind it up to the width."""
    return F.concat(x, F.array_repeat(fill, F.greatest(F.lit(0), width - F.size(x))))


def attention(ids: Column, pad: int) -> Column:
    return F.transform(ids, lambda t: (t != pad).cast("int"))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def positions(mask: pd.Series) -> pd.Series:
    """Place of each token that counts among those that do, zero elsewhere: a running sum, in one pass over each array."""
    return mask.map(lambda m: None if m is None else ((np.cumsum(m) - 1).clip(0) * np.asarray(m)).astype(np.int32))


def spliced(batch: DataFrame, rescued: DataFrame, pad: int, zeroed: tuple[str, ...] = ("branch_advantages", "branch_credit_mask"), carried: tuple[str, ...] = ()) -> DataFrame:
    """batch (row_idx, prompts, responses, info_mask, token_level_scores and arrays as long as the responses) with the rows of rescued (row_idx, response,
    info, turns, kd, score and `carried` columns) in place of its own. All responses are padded to the longest; of a rescued row the scores are zero but for
    the last token, which gets the score; `zeroed` arrays are zero, turns_mask is that of the rescue, info_mask tells which response tokens the model wrote, kd which of
    them a teacher did. input_ids, attention_mask, position_ids and the whole info_mask are made anew. A rescued row whose info is not as long as its response is an error."""
    given = ("response", "info", "turns", "kd", "score", *carried)
    new = rescued.select("row_idx", *[F.col(c).alias(f"__{c}") for c in given])
    length = F.size("__response")
    checked = F.when(F.size("__info") != length, F.raise_error(F.lit("rescue info mask length mismatch")).cast("array<int>")).otherwise(F.col("__response"))
    got = batch.join(new.withColumn("__response", checked), "row_idx", "left").withColumn("__is", F.col("__response").isNotNull())
    widths = got.agg(F.max(F.greatest(F.size("responses"), F.coalesce(length, F.lit(0)))).alias("__width"))  # one row
    got = got.crossJoin(F.broadcast(widths))
    width, none = F.col("__width"), F.array_repeat(F.lit(0), F.col("__width"))
    kinds = {f.name: f.dataType for f in batch.schema.fields}
    new_or = lambda mine, theirs: F.when(F.col("__is"), mine).otherwise(theirs)
    same = lambda c, name: c.cast(kinds[name])
    out = {"responses": new_or(padded(F.col("__response"), width, F.lit(pad)), padded(F.col("responses"), width, F.lit(pad))), "kd": new_or(padded(F.col("__kd"), width, F.lit(False)), F.array_repeat(F.lit(False), width))}
    wrote = padded(attention(F.col("__info"), pad), width, F.lit(0))
    info = new_or(wrote, padded(F.slice("info_mask", F.size("info_mask") - F.size("responses") + 1, F.size("responses")), width, F.lit(0)))
    out["token_level_scores"] = new_or(F.transform(F.sequence(F.lit(1), width), lambda i: F.when(i == F.size("__response"), F.col("__score")).otherwise(0.0)), padded(F.col("token_level_scores"), width, F.lit(0.0)))
    if "turns_mask" in kinds:
        out["turns_mask"] = same(new_or(padded(F.slice("__turns", F.lit(1), length), width, F.lit(pad)), padded(F.col("turns_mask"), width, F.lit(pad))), "turns_mask")
    for c in zeroed:
        if c in kinds:
            out[c] = same(new_or(none.cast(kinds[c]), padded(F.col(c), width, F.lit(0).cast(kinds[c].elementType))), c)
    for c in carried:
        out[c] = F.coalesce(F.col(f"__{c}"), F.col(c)) if c in kinds else F.col(f"__{c}")
    got = got.withColumns({**out, "__info_new": info})
    prompt = attention(F.col("prompts"), pad)
    mask = F.concat(prompt, attention(F.col("responses"), pad))
    got = got.withColumns({"input_ids": F.concat("prompts", "responses"), "attention_mask": mask, "info_mask": F.concat(prompt, F.col("__info_new"))}).withColumn("position_ids", positions(F.col("attention_mask")))
    return got.drop("__is", "__width", "__info_new", *[f"__{c}" for c in given])


def child_uid(parent: Column, k: Column) -> Column:
    """Stable ids: 16 hex digits of a SHA-256 of parent and number."""
    return F.substring(F.sha2(F.concat_ws(":", parent, k.cast("string")).cast("binary"), 256), 1, 16)


def spread(rows: DataFrame, key: str, most: int = 10_000) -> DataFrame:
    """rows dealt by the key to as many tasks as it takes for about `most` rows each: what a small table grows into then grows in more tasks, not in larger ones."""
    return rows.repartition(max(1, -(-rows.count() // most)), key)


def grown(frontier: DataFrame, children: int, levels: int, piece: Callable[[Column, Column], Column]) -> DataFrame:
    """frontier and what grows from it in `levels` levels of `children` each: (tree_uid, node_uid, parent_node_uid, depth, response, kd).

    piece(node_uid, number) gives a child's own tokens as struct(tokens, kd); draws in it are to hash the uid, not a running generator. So a subtree
    depends on its node alone, and growing on from any nodes gives what growing the whole would have. A level is one projection of the one above; nothing is shuffled."""
    found = level = frontier.select("tree_uid", "node_uid", "parent_node_uid", "depth", "response", "kd")
    for _ in range(levels):
        born = level.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(children - 1)))).withColumn("__uid", child_uid(F.col("node_uid"), F.col("__k")))
        born = born.withColumn("__p", piece(F.col("__uid"), F.col("__k")))
        level = born.select("tree_uid", F.col("__uid").alias("node_uid"), F.col("node_uid").alias("parent_node_uid"), (F.col("depth") + 1).alias("depth"), F.concat("response", "__p.tokens").alias("response"), F.concat("kd", "__p.kd").alias("kd"))
        found = found.unionByName(level)
    return found


def seeded(prompts: DataFrame, first: Column, second: Column) -> DataFrame:
    """Two nodes for each tree of prompts (tree_uid, ...): a root that holds the teacher's first hop and its child with both, so that a tree may fork before the
    second. first and second are struct(tokens, kd)."""
    root = F.struct(F.concat(F.col("tree_uid").cast("string"), F.lit("-1")).alias("node_uid"), F.lit(None).cast("string").alias("parent_node_uid"), F.lit(1).alias("depth"), first["tokens"].alias("response"), first["kd"].alias("kd"))
    child = F.struct(F.concat(F.col("tree_uid").cast("string"), F.lit("-2")).alias("node_uid"), F.concat(F.col("tree_uid").cast("string"), F.lit("-1")).alias("parent_node_uid"), F.lit(2).alias("depth"), F.concat(first["tokens"], second["tokens"]).alias("response"), F.concat(first["kd"], second["kd"]).alias("kd"))
    return prompts.select("tree_uid", F.explode(F.array(root, child)).alias("n")).select("tree_uid", "n.*")


def leaf_masks(nodes: DataFrame, plans: DataFrame) -> DataFrame:
    """(tree_uid, node_uid, length, mask) of each leaf of nodes (with response): which of its tokens the teacher wrote. plans: (tree_uid, hop2_uid, kd1, kd2)."""
    ends = paths(nodes, {"length": F.max(F.size("response"))}).filter("leaf").join(plans, "tree_uid")
    through = F.array_contains("path.uid", F.col("hop2_uid"))
    return ends.select("tree_uid", "node_uid", "length", leaf_kd_mask(F.col("length"), F.col("kd1"), F.col("kd2"), through).alias("mask"))
