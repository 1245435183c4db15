"""Math on token arrays: masks, KL, GAE and losses, by higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F




def masked_sum(values: Column, mask: Column) -> Column:
    return F.aggregate(F.zip_with(values, mask, lambda v, m: v * m), F.lit(0.0), lambda s, x: s + x)


def masked_mean(values: Column, mask: Column) -> Column:
    return F.try_divide(masked_sum(values, mask), F.aggregate(mask, F.lit(0.0), lambda s, m: s + m))


def kl_penalty(log_prob: Column, ref: Column, kind: str) -> Column:
    """Per token: kl, abs, mse, or the low-variance estimate, clamped."""
    forms = {
        "kl": lambda a, b: a - b,
        "abs": lambda a, b: F.abs(a - b),
        "mse": lambda a, b: 0.5 * (a - b) * (a - b),
        "low_var_kl": lambda a, b: _clamp(F.exp(_clamp(b - a, 20.0)) - _clamp(b - a, 20.0) - 1, 10.0),
    }
    if kind not in forms:
        raise NotImplementedError(kind)
    return F.zip_with(log_prob, ref, forms[kind])


def _clamp(x: Column, by: float) -> Column:
    return F.least(F.lit(by), F.greatest(F.lit(-by), x))


def gae(rewards: Column, values: Column, gamma: float, lam: float) -> Column:
    """Generalised advantages by a fold from the last token back."""
    pairs = F.reverse(F.arrays_zip(rewards.alias("r"), values.alias("v")))
    start = F.struct(F.lit(0.0).alias("next"), F.lit(0.0).alias("last"), F.array().cast("array<double>").alias("out"))

    def step(s, x):
        last = x["r"] + gamma * s["next"] - x["v"] + gamma * lam * s["last"]
        return F.struct(x["v"].alias("next"), last.alias("last"), F.concat(s["out"], F.array(last)).alias("out"))

    return F.reverse(F.aggregate(pairs, start, step, lambda s: s["out"]))


def score_at_last(score: Column, length: Column) -> Column:
    """Zeros but for the score at the last valid token."""
    return F.transform(F.sequence(F.lit(1), length), lambda i: F.when(i == length, score).otherwise(0.0))


def eos_mask(ids: Column, eos) -> Column:
    """Ones up to and including the first end token, zeros after it."""
    at = F.array_position(ids, eos)
    return F.transform(ids, lambda _, i: F.when((at == 0) | (i + 1 <= at), 1).otherwise(0))


def position_ids(mask: Column) -> Column:
    """Running count of attended tokens, from zero."""
    return F.aggregate(mask, F.array().cast("array<int>"), lambda s, m: F.concat(s, F.array((F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(-1)) + m).cast("int"))))


def pad(values: Column, length: int, with_value, left: bool = False) -> Column:
    """Cut or fill up to a length; the kept end is the one away from the padding."""
    size = F.size(values)
    fill = F.array_repeat(F.lit(with_value), F.greatest(F.lit(0), F.lit(length) - size))
    kept = F.slice(values, F.greatest(F.lit(1), size - length + 1), F.lit(length)) if left else F.slice(values, 1, length)
    return F.concat(fill, kept) if left else F.concat(kept, fill)


def entropy(logits: Column) -> Column:
    """Of the softmax of an array of logits."""
    top = F.array_max(logits)
    z = F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    mean = F.aggregate(logits, F.lit(0.0), lambda s, x: s + x * F.exp(x - top)) / z
    return F.log(z) + top - mean


def log_prob(logits: Column, label: Column) -> Column:
    """Log-softmax of the logit numbered label, from zero."""
    top = F.array_max(logits)
    return F.element_at(logits, label + 1) - top - F.log(F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top)))


def jsd(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence of two probability arrays."""
    part = lambda a, b: F.when(a > 0, a * F.log(2 * a / (a + b))).otherwise(0.0)
    return 0.5 * F.aggregate(F.zip_with(p, q, lambda a, b: part(a, b) + part(b, a)), F.lit(0.0), lambda s, x: s + x)


def clipped_objective(ratio: Column, advantage: Column, clip: float = 0.2) -> Column:
    """PPO's token loss: the larger of the plain and the clipped one."""
    return F.greatest(-advantage * ratio, -advantage * F.least(F.lit(1 + clip), F.greatest(F.lit(1 - clip), ratio)))


def dual_clipped_objective(ratio: Column, advantage: Column, clip: float = 0.2, bound: float = 3.0) -> Column:
    """clipped_objective(), held below bound times the advantage's size where the advantage is negative."""
    loss = clipped_objective(ratio, advantage, clip)
    return F.when(advantage < 0, F.least(loss, -advantage * bound)).otherwise(loss)


def adaptive_kl(divergences: Column, start: float, target: float, horizon: float, steps: Column) -> Column:
    """Coefficient after these divergences in turn: each changes it by its distance from the target, a fifth at most, in proportion to steps / horizon."""
    by = lambda kl: 1 + F.least(F.lit(0.2), F.greatest(F.lit(-0.2), kl / target - 1)) * steps / horizon
    return F.aggregate(divergences, F.lit(start), lambda c, kl: c * by(kl))


def action_log_prob(log_probs: Column, ids: Column, padding: int) -> Column:
    """Mean of finite log-probabilities over tokens that are no padding; zero without any."""
    valid = F.filter(F.zip_with(log_probs, ids, lambda p, i: F.when((i != padding) & ~F.isnan(p) & (F.abs(p) < float("inf")), p)), lambda p: p.isNotNull())
    return F.aggregate(valid, F.lit(0.0), lambda s, p: s + p) / F.greatest(F.size(valid), F.lit(1))


def mean_lift(student: Column, teacher: Column, mask: Column) -> Column:
    """Mean of teacher less student over masked tokens; zero without any."""
    lift = F.aggregate(F.zip_with(F.zip_with(teacher, student, lambda a, b: a - b), mask, lambda d, m: d * m), F.lit(0.0), lambda s, x: s + x)
    return lift / F.greatest(F.aggregate(mask, F.lit(0.0), lambda s, m: s + m), F.lit(1.0))


def event_gate(student: Column, teacher: Column, mask: Column, valid: Column, least: float = 0.0) -> Column:
    """Whether a valid event has tokens and its teacher raises their mean log-probability by more than `least`."""
    return valid & (F.aggregate(mask, F.lit(0.0), lambda s, m: s + m) > 0) & (mean_lift(student, teacher, mask) > least)


def span_weights(think: Column, query: Column, of_think: float = 0.2, of_query: float = 1.0) -> Column:
    """Per token: each span's share, spread evenly over its tokens."""
    spread = lambda m, c: F.transform(m, lambda x: x * c / F.greatest(F.aggregate(m, F.lit(0.0), lambda s, y: s + y), F.lit(1.0)))
    return F.zip_with(spread(think, of_think), spread(query, of_query), lambda a, b: a + b)


def sampled_nll(student: Column, skill: Column, mask: Column, spans: Column, valid: Column, advantage: Column, least: float = 0.0) -> Column:
    """Struct of numerator and weight: each token of a valid event weighs by what the skill adds to it above `least`, by the event's advantage
    (none below zero) and by its span."""
    lift = F.zip_with(F.zip_with(skill, student, lambda a, b: F.greatest(a - b - least, F.lit(0.0))), mask, lambda d, m: d * m)
    w = F.transform(F.zip_with(lift, spans, lambda d, s: d * s), lambda x: F.when(valid, x * F.greatest(advantage, F.lit(0.0))).otherwise(0.0))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    return F.struct((-total(F.zip_with(student, w, lambda p, x: p * x))).alias("numerator"), total(w).alias("weight"))


def skill_advantage(skill: Column, ordinary: Column, valid: Column) -> Column:
    """Per token: what a skill adds to the log-probability where valid, zero elsewhere."""
    return F.zip_with(F.zip_with(skill, ordinary, lambda a, b: a - b), valid, lambda d, v: F.when(v > 0, d).otherwise(0.0))


def masked_cross_entropy(logits: Column, labels: Column, mask: Column) -> Column:
    """Sum over masked tokens of the negative log-softmax of the label's logit."""
    losses = F.zip_with(logits, labels, lambda x, y: -log_prob(x, y))
    return F.aggregate(F.zip_with(losses, mask, lambda x, m: F.when(m != 0, x * m).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)


def with_information(prompt: Column, response: Column, information: Column, most: int, turn: Column) -> Column:
    """Struct of tokens, mask (zero on information) and turns (the turn's number on the response): the last `most` of the three put together."""
    of = lambda xs, v: F.transform(xs, lambda _: v)
    tail = lambda xs: F.slice(xs, F.greatest(F.size(xs) - most, F.lit(0)) + 1, F.lit(most))
    info = F.coalesce(information, F.slice(response, 1, 0))
    return F.struct(
        tail(F.concat(prompt, response, info)).alias("tokens"),
        tail(F.concat(of(prompt, F.lit(1)), of(response, F.lit(1)), of(info, F.lit(0)))).alias("mask"),
        tail(F.concat(of(prompt, F.lit(0)), of(response, turn), of(info, F.lit(0)))).alias("turns"),
    )


def interval_scores(length: Column, intervals: Column) -> Column:
    """Per token the sum of the scores of intervals (structs of start, stop and score) that hold it; an interval's last token gets none."""
    return F.transform(F.sequence(F.lit(0), length - 1), lambda i: F.aggregate(F.filter(intervals, lambda x: (x["start"] <= i) & (i < x["stop"] - 1)), F.lit(0.0), lambda s, x: s + x["score"]))
