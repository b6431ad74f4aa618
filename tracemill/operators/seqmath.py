"""Sequence arithmetic over arrays: divergences, importance weights, masks, ragged rows.

All are higher-order expressions: they run in the JVM, row by row, without a shuffle.
Empty arrays and masks give 0 where a mean is asked; null arrays give NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracemill.functions.common import array_sum, clipped, masked_sum


def dot(a: Column, b: Column) -> Column:
    return array_sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def divergence(new: Column, old: Column, kind: str) -> Column:
    """Per-token estimate of KL(new, old) from log-probabilities: k1, k2, k3, or k3 of a clamped difference (low)."""
    d = F.zip_with(old, new, lambda o, n: o.cast("double") - n.cast("double"))
    if kind == "k1":
        return F.transform(d, lambda x: -x)
    if kind == "k2":
        return F.transform(d, lambda x: x * x / 2)
    if kind == "low":
        d = F.transform(d, lambda x: clipped(x, -10.0, 10.0))
    k3 = F.transform(d, lambda x: F.exp(x) - x - 1)
    return F.transform(k3, lambda x: clipped(x, -10.0, 10.0)) if kind == "low" else k3


def masked_mean(values: Column, mask: Column) -> Column:
    """Mean over the mask, 0 for an empty one."""
    n = masked_sum(mask, mask)
    return F.when(n > 0, masked_sum(values, mask) / n).otherwise(F.when(values.isNotNull() & mask.isNotNull(), 0.0))


def importance_weights(new: Column, old: Column, mask: Column, level: str, low: float, high: float, mode: str) -> Column:
    """exp(new - old) per token, per sequence (sum) or geometric (mean), truncated, clipped or masked."""
    d = F.zip_with(new, old, lambda n, o: n.cast("double") - o.cast("double"))
    if level == "sequence":
        d = F.transform(d, lambda _: masked_sum(F.zip_with(new, old, lambda n, o: n.cast("double") - o.cast("double")), mask))
    elif level == "geometric":
        d = F.transform(d, lambda _: masked_mean(F.zip_with(new, old, lambda n, o: n.cast("double") - o.cast("double")), mask))
    w = F.transform(d, lambda x: F.exp(clipped(x, -20.0, 20.0)))
    if mode == "truncate":
        return F.transform(w, lambda x: F.least(x, F.lit(high)))
    if mode == "clip":
        return F.transform(w, lambda x: clipped(x, low, high))
    return F.transform(w, lambda x: F.when((x < low) | (x > high), 0.0).otherwise(x))


def clipped_objective(ratio: Column, advantage: Column, low: float, high: float, dual: float | None = None) -> Column:
    """The clipped policy loss; with ``dual`` losses of negative advantages are bounded."""
    loss = F.greatest(-advantage * ratio, -advantage * clipped(ratio, 1 - low, 1 + high))
    return loss if dual is None else F.when(advantage < 0, F.least(loss, -advantage * dual)).otherwise(loss)


def response_length(mask: Column) -> Column:
    """From the first 1 of a loss mask to its end; 0 without one."""
    at = F.array_position(mask, F.lit(1))
    return F.when(at > 0, F.size(mask) - at + 1).otherwise(0).cast("int")


def sublist_positions(values: Column, sub: Column) -> Column:
    """Zero-based starts of every occurrence of a non-empty sublist."""
    n = F.size(values) - F.size(sub)
    at = F.when(n >= 0, F.sequence(F.lit(0), n)).otherwise(F.array().cast("array<int>"))
    return F.filter(at, lambda i: F.slice(values, i + 1, F.size(sub)) == sub)


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix."""
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.eqNullSafe(y))
    return F.coalesce(F.nullif(F.array_position(same, F.lit(False)), F.lit(0)) - 1, n.cast("bigint")).cast("int")


def ragged_kept(offsets: Column, mask: Column) -> Column:
    """Mean slice length of a ragged row over its masked tokens; offsets have one element more."""
    lengths = F.zip_with(F.slice(offsets, 2, F.size(offsets)), F.slice(offsets, 1, F.size(offsets) - 1), lambda b, a: b - a)
    return masked_mean(lengths, mask)


def merge_ragged(ids: Column, offsets: Column, more_ids: Column, more_offsets: Column) -> tuple[Column, Column]:
    """Concatenated ids and offsets of two ragged rows."""
    base = F.element_at(offsets, -1)
    return F.concat(ids, more_ids), F.concat(offsets, F.transform(F.slice(more_offsets, 2, F.size(more_offsets)), lambda x: x + base))


def tail_slice(values: Column, n: Column) -> Column:
    """Without the first element, the last n."""
    rest = F.slice(values, 2, F.greatest(F.size(values), F.lit(1)))
    take = F.least(n, F.size(rest))
    return F.when(take > 0, F.slice(rest, -F.greatest(take, F.lit(1)), F.greatest(take, F.lit(1)))).otherwise(F.slice(rest, 1, 0))


def length_quarter(length: Column, longest: Column) -> Column:
    """1 to 4: the first quarter of the maximum that holds the length; NULL over the maximum."""
    return F.when((length <= longest) & (length >= 0), F.greatest(F.ceil(length * 4 / longest), F.lit(1)).cast("int"))


def forward_flops(length: Column, layers: int, hidden: int, ffn: int, vocabulary: int) -> Column:
    """Multiply-adds, doubled, of a forward pass: projections, attention, feed-forward, output."""
    per_token = layers * (8 * hidden * hidden + 6 * hidden * ffn) + 2 * hidden * vocabulary
    return length.cast("double") * per_token + F.lit(4.0 * layers * hidden) * length * length


def sequence_kl(new: Column, old: Column, mask: Column) -> Column:
    """Mean of old - new over the mask, one value a sequence; 0 for an empty mask."""
    d = F.zip_with(old, new, lambda o, n: o.cast("double") - n.cast("double"))
    return masked_sum(d, mask) / F.greatest(masked_sum(mask, mask), F.lit(1.0))


def off_policy_keep(advantage: Column, kl: Column, delta: float) -> Column:
    """1, or 0 for a sequence of negative advantage that has drifted by more than ``delta``."""
    return F.when((advantage < 0) & (kl > delta), 0).otherwise(1)


def mismatch_metrics(train: Column, rollout: Column, mask: Column, bound: float = 20.0) -> dict[str, Column]:
    """How far the training policy's log-probabilities are from the rollout's: perplexities, KL, k3, chi squared by token and sequence."""
    r = F.zip_with(train, rollout, lambda t, o: t.cast("double") - o.cast("double"))
    mean = lambda f: masked_mean(F.transform(r, f), mask)
    total = clipped(masked_sum(r, mask), -bound, bound)
    return {
        "train_log_ppl": -masked_mean(train, mask), "rollout_log_ppl": -masked_mean(rollout, mask), "kl": mean(lambda x: -x), "k3": mean(lambda x: F.exp(x) - x - 1),
        "ppl_ratio": F.exp(masked_mean(rollout, mask) - masked_mean(train, mask)), "chi2_token": mean(lambda x: F.exp(2 * clipped(x, -bound, bound))) - 1, "chi2_sequence": F.exp(2 * total) - 1,
    }


def veto(new: Column, old: Column, mask: Column, floor: float) -> Column:
    """0 for a sequence in which some trained token's ratio is under ``floor``, else 1."""
    low = F.zip_with(F.zip_with(new, old, lambda n, o: F.exp(n.cast("double") - o.cast("double"))), mask, lambda w, m: (m == 1) & (w < floor))
    return F.when(F.exists(low, lambda x: x), 0).otherwise(1)


def distilled(advantages: Column, student: Column, teacher: Column, weight: float) -> Column:
    """Advantages less the weighted excess of the student's log-probabilities over the teacher's."""
    gap = F.zip_with(student, teacher, lambda s, t: s.cast("double") - t.cast("double"))
    return F.zip_with(advantages, gap, lambda a, g: a - weight * g)


def role_mask(messages: Column, lead: int = 0) -> Column:
    """Loss mask of an array of (role, tokens, step_loss_mask): an assistant's tokens after its first ``lead`` count, unless its step is masked."""
    ones = lambda n, v: F.transform(F.sequence(F.lit(1), n), lambda _: F.lit(v))
    part = lambda n, v: F.when(n > 0, ones(n, v)).otherwise(F.array().cast("array<int>"))
    one = lambda m: F.when((m["role"] == "assistant") & (F.coalesce(m["step_loss_mask"], F.lit(1)) == 1), F.concat(part(F.least(m["tokens"], F.lit(lead)), 0), part(m["tokens"] - lead, 1))).otherwise(part(m["tokens"], 0))
    return F.flatten(F.transform(messages, one))
