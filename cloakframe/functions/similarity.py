"""Similarities of two texts, from 0 to 1, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakframe.schema import let


def levenshtein(a: Column, b: Column) -> Column:
    """1 - distance / longer length; equal texts (two empty ones too) have 1."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / F.greatest(longer, F.lit(1)))


def _unused(a: Column, b: Column) -> Column:
    """A character that neither text holds: the first of more private ones than they have characters."""
    both = F.concat(a, b)
    others = F.transform(F.sequence(F.lit(0xE001), F.lit(0xE001) + F.length(both)), lambda i: F.decode(F.unhex(F.hex(i)), "UTF-16BE"))
    return F.when(~F.contains(both, F.lit("\ue000")), F.lit("\ue000")).otherwise(F.element_at(F.filter(others, lambda c: ~F.contains(both, c)), 1))


def jaro(a: Column, b: Column) -> Column:
    """Characters match within half the longer length, less one; out-of-order pairs count half, without rounding.

    Both texts are computed once; a character's match is looked up in `rest`, the second text with a mark for those that are taken.
    """
    return let(F.struct(a.alias("a"), b.alias("b")), lambda x: F.when(x["a"] == x["b"], F.lit(1.0)).when((F.coalesce(F.length(x["a"]), F.lit(0)) == 0) | (F.coalesce(F.length(x["b"]), F.lit(0)) == 0), F.lit(0.0)).otherwise(_jaro(x["a"], x["b"])))


def _jaro(a: Column, b: Column) -> Column:
    """The same for two texts that aren't empty, given as variables."""
    facts = F.struct(F.length(a).alias("n"), F.length(b).alias("m"), _unused(a, b).alias("mark"))
    return let(facts, lambda f: _folded(a, b, f["n"], f["m"], f["mark"]))


def _folded(a: Column, b: Column, n: Column, m: Column, mark: Column) -> Column:
    window = F.greatest(F.floor(F.greatest(n, m) / 2).cast("int") - 1, F.lit(0))
    nothing = F.struct(b.alias("rest"), F.array().cast("array<int>").alias("used"), F.lit("").alias("chars"))

    def step(acc: Column, i: Column) -> Column:
        char = F.substring(a, i, F.lit(1))

        def take(at: Column) -> Column:
            hit = F.struct(F.overlay(acc["rest"], mark, at, F.lit(1)).alias("rest"), F.concat(acc["used"], F.array(at)).alias("used"), F.concat(acc["chars"], char).alias("chars"))
            return F.when((at > 0) & (at <= i + window), hit).otherwise(acc)

        return let(F.position(char, acc["rest"], F.greatest(i - window, F.lit(1))), take)

    def finish(acc: Column) -> Column:
        k = F.size(acc["used"])
        moved = F.size(F.filter(F.transform(F.array_sort(acc["used"]), lambda j, r: F.substring(b, j, F.lit(1)) != F.substring(acc["chars"], r + 1, F.lit(1))), lambda x: x)) / 2
        return F.when(k == 0, F.lit(0.0)).otherwise((k / n + k / m + (k - moved) / k) / 3)

    return F.aggregate(F.sequence(F.lit(1), n), nothing, step, finish)


def jaro_winkler(a: Column, b: Column, prefix_weight: float = 0.1) -> Column:
    """Jaro with a bonus for up to four equal first characters."""

    def raised(x: Column) -> Column:
        a, b, same = x["a"], x["b"], F
        for n in (4, 3, 2, 1):
            same = same.when((F.length(a) >= n) & (F.length(b) >= n) & (F.substring(a, 1, n) == F.substring(b, 1, n)), F.lit(n))
        same = same.otherwise(F.lit(0))
        return F.when(a == b, F.lit(1.0)).otherwise(let(jaro(a, b), lambda j: j + same * F.lit(float(prefix_weight)) * (1 - j)))

    return let(F.struct(a.alias("a"), b.alias("b")), raised)
