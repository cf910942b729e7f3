"""Scores, hashes and small numeric rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ACCEPT, REVIEW = 0.90, 0.60


def softmax(logits: Column) -> Column:
    """Probabilities of an array of logits, shifted by the largest."""
    top = F.array_max(logits)
    parts = F.transform(logits, lambda v: F.exp(v - top))
    total = F.aggregate(parts, F.lit(0.0), lambda acc, v: acc + v)
    return F.transform(parts, lambda v: v / total)


def argmax(values: Column) -> Column:
    """Index of the first largest value, from 0."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def top_probability(logits: Column) -> Column:
    """Probability of the largest logit: one pass, without the other probabilities."""
    top = F.array_max(logits)
    return F.lit(1.0) / F.aggregate(logits, F.lit(0.0), lambda acc, v: acc + F.exp(v - top))


def decide_status(p: Column, accept: float = ACCEPT, review: float = REVIEW) -> Column:
    return F.when(p >= accept, "accepted").when(p >= review, "review").otherwise("suspect")


def required_rotation(source: Column, target: Column) -> Column:
    return F.pmod(target - source, F.lit(360))


def cosine_rate(base: float, epoch: Column, epochs: int) -> Column:
    """Learning rate logged for an epoch (from 1), before the scheduler steps."""
    return F.lit(0.5 * base) * (1 + F.cos(F.lit(3.141592653589793) * (epoch - 1) / epochs))


def hash_bits(block: Column) -> Column:
    """Perceptual hash of 64 values: a bit for each above the median of all but the first; the first bit is 0."""
    rest = F.sort_array(F.slice(block, 2, 63))
    median = F.element_at(rest, 32)
    return F.aggregate(F.slice(block, 2, 63), F.lit(0).cast("long"), lambda acc, v: F.shiftleft(acc, 1).bitwiseOR(F.when(v > median, 1).otherwise(0).cast("long")))


def hash_hex(bits: Column) -> Column:
    return F.lpad(F.lower(F.hex(bits)), 16, "0")


def canonical_hash(hashes: Column) -> Column:
    """Least hash of the four rotations."""
    return F.array_min(hashes)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def imbalance(largest: Column, least: Column) -> Column:
    return F.when(least == 0, F.lit(float("inf"))).otherwise(largest / least)


def imbalance_advice(ratio: Column) -> Column:
    """What to do about a ratio of the largest to the least class; an infinite one has an empty class."""
    return F.when(ratio == float("inf"), "missing").when(ratio <= 1.5, "balanced").when(ratio <= 3, "moderate").otherwise("severe")
