"""Markov randomness of a string: mean log-probability of its trigrams between those of natural and of random text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# log2 of the probability of a trigram by its kind.
COMMON, MIXED, RARE = -4.322, -9.966, -13.288


def trigram_score(t: Column) -> Column:
    same = (F.substring(t, 1, 1) == F.substring(t, 2, 1)) & (F.substring(t, 2, 1) == F.substring(t, 3, 1))
    return F.when(same | t.rlike("^[a-z]{3}$"), COMMON).when(t.rlike("^([A-Z]{3}|[0-9]{3})$"), MIXED).when(t.rlike("[0-9_-]"), RARE).otherwise(MIXED)


def trigrams(kept: Column) -> Column:
    """All runs of three characters, in time linear in the length: those that begin at every third place, three times over."""
    every_third = lambda x: F.regexp_extract_all(x, F.lit("(?s).{3}"), F.lit(0))
    return F.concat(every_third(kept), every_third(F.substring(kept, 2, 2**31 - 1)), every_third(F.substring(kept, 3, 2**31 - 1)))


def trigram_sum(text: Column) -> Column:
    """(total, n): the scores of all trigrams of letters, digits, _ and -, added up, and their number; other characters are passed over."""
    kept = F.regexp_replace(text, "[^A-Za-z0-9_-]", "")

    def added(grams: Column) -> Column:
        return F.struct(F.aggregate(grams, F.lit(0.0).cast("double"), lambda s, t: s + trigram_score(t).cast("double")).alias("total"), F.size(grams).alias("n"))

    return F.element_at(F.transform(F.array(trigrams(kept)), added), 1)


def mean_score(total: Column, n: Column) -> Column:
    """0 (natural) to 1 (random), by the mean of n trigrams; 0 if there are none."""
    return F.when(n == 0, 0.0).otherwise(F.least(F.greatest((F.lit(COMMON) - total / n) / (COMMON - RARE), F.lit(0.0)), F.lit(1.0)))


def markov_score(text: Column) -> Column:
    """0 (natural) to 1 (random); 0 for fewer than three letters, digits, _ or -; other characters are passed over."""
    return F.element_at(F.transform(F.array(trigram_sum(text)), lambda x: mean_score(x["total"], x["n"])), 1)
