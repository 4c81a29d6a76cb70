"""Model replies and probabilities as expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventlens.schema import CLASSES, NORMAL

#: JSON texts that count as false.
_FALSE = ["false", "null", "0", "0.0", "-0", "-0.0", '""', "[]", "{}"]


def parse_reply(text: Column, classes: list[str] | None = None) -> Column:
    """struct<class_name, is_anomaly> of a reply's outermost braces; anything unusable is (normal, false)."""
    known = classes or CLASSES[1:]
    obj = F.try_parse_json(F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit("")))
    name = F.try_variant_get(obj, "$.class_name", "string")
    flag = F.to_json(F.struct(F.try_variant_get(obj, "$.is_anomaly", "variant").alias("v")))
    raw = F.regexp_extract(flag, r'(?s)^\{"v":(.*)\}$', 1)
    good = F.coalesce(name.isin(known) & (raw != "") & ~raw.isin(_FALSE), F.lit(False))
    return F.struct(F.when(good, name).otherwise(F.lit(NORMAL)).alias("class_name"), good.alias("is_anomaly"))


def first_class(text: Column, classes: list[str] | None = None, normal_first: bool = False) -> Column:
    """The first listed class that a loose reply contains; normal if none (or, first, if it is quoted)."""
    low = F.lower(text)
    out = F.when(low.contains('"normal"'), F.lit(NORMAL)) if normal_first else F.when(low.isNull(), F.lit(NORMAL))
    for c in classes or CLASSES[1:]:
        out = out.when(low.contains(c), F.lit(c))
    return out.otherwise(F.lit(NORMAL))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once however often `use` names it: inside a lambda an expression is evaluated anew wherever it stands."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def softmax(logits: Column) -> Column:
    """Shifted by the maximum, over an array of doubles."""

    def shares(powers: Column) -> Column:
        return bound(F.aggregate(powers, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(powers, lambda x: x / total))

    return bound(F.array_max(logits), lambda top: bound(F.transform(logits, lambda x: F.exp(x - top)), shares))


def pair_probability(t: Column, f: Column) -> Column:
    """p(true) / (p(true) + p(false)) of two masses."""
    return F.try_divide(t, t + f)


def boolean_probability(steps: Column, true_ids: list[int], false_ids: list[int]) -> Column:
    """P(anomaly) from steps array<struct<piece string, logits array<double>>>.

    The first step whose piece starts with true or false decides; the mass of true ids against that of
    false ids (shared ids left out). Without a way to separate them it is a hard 1 or 0; without such a step null.
    """
    both = set(true_ids) & set(false_ids)
    t, f = [i for i in true_ids if i not in both], [i for i in false_ids if i not in both]
    first = F.get(F.filter(steps, lambda s: F.lower(F.trim(s["piece"])).rlike("^(true|false)")), F.lit(0))

    def of(step: Column) -> Column:
        hard = F.when(F.lower(F.trim(step["piece"])).startswith("true"), 1.0).otherwise(0.0)

        def soft(probs: Column) -> Column:
            def mass(ids: list[int]) -> Column:
                return sum((F.coalesce(F.get(probs, F.lit(i)), F.lit(0.0)) for i in ids), F.lit(0.0))

            both = F.struct(mass(t).alias("t"), (mass(t) + mass(f)).alias("total"))
            return bound(both, lambda m: F.when(m["total"] > 0, m["t"] / F.nullif(m["total"], F.lit(0.0))).otherwise(hard))

        return F.when(step.isNotNull(), bound(softmax(step["logits"]), soft) if t and f else hard)

    return bound(first, of)


def verdict(reply: Column, probability: Column) -> Column:
    """struct<class_name, score>: an anomaly keeps its class and probability (1 if there is none); normal scores 0."""
    bad = reply["is_anomaly"]
    return F.struct(
        F.when(bad, reply["class_name"]).otherwise(F.lit(NORMAL)).alias("class_name"),
        F.when(bad, F.coalesce(probability, F.lit(1.0))).otherwise(0.0).alias("score"),
    )


def labels(known: list[str], own: Column) -> Column:
    """The sorted set of valid labels: known ones and a row's own (an array, or null); nulls aren't labels."""
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_union(F.array(*map(F.lit, known)) if known else none, F.array_compact(F.coalesce(own, none))))


def looked_up(entries: Column, key: Column, default: Column) -> Column:
    """A map's value, or the default for a key that it lacks; a null map or key has the default, a null value stays."""
    return F.when(F.coalesce(F.map_contains_key(entries, key), F.lit(False)), F.try_element_at(entries, key)).otherwise(default)
