"""Set-containment joins of names: which names are choices of another name's words, found without listing the choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def name_words(name: Column) -> Column:
    """A name's words as they stand between white space, in lower case and in order."""
    return F.array_remove(F.split(F.lower(name), r"\s+"), "")


def in_order(part: Column, whole: Column) -> Column:
    """Whether the words of part stand in whole, in their order, with other words between them or not."""
    met = F.aggregate(whole, F.lit(0), lambda at, w: F.when(F.coalesce(F.get(part, at) == w, F.lit(False)), at + 1).otherwise(at))
    return met == F.size(part)


def contained(parts: DataFrame, wholes: DataFrame) -> DataFrame:
    """(group, part, whole): the rows of parts (group, part, words) whose words are a choice of those of a row of wholes (group,
    whole, words), in order. Parts without words are in nothing; nulls meet nothing.

    A choice of n words is one of 2^n, so choices are not listed. A part can only be in a whole that has all of its words, so it is
    enough to look it up by one of them, the one that the fewest parts of its group have: an inverted index from word to parts in which
    each part stands once. Wholes meet the index by each of their different words, and what they meet is verified word by word.
    Equal lists of words are met once. Long names cost as many rows as they have words.
    """
    asked = parts.filter(F.size("words") > 0).select("group", "words").distinct()
    each = asked.select("group", "words", F.explode(F.array_distinct("words")).alias("word"))
    often = each.groupBy("group", "word").agg(F.count("*").alias("n"))
    index = each.join(often, ["group", "word"]).groupBy("group", "words").agg(F.min(F.struct("n", "word")).getField("word").alias("word"))
    lists = wholes.select("group", F.col("words").alias("all_words")).distinct()
    met = lists.select("group", "all_words", F.explode(F.array_distinct("all_words")).alias("word")).join(index, ["group", "word"])
    found = met.filter(in_order(F.col("words"), F.col("all_words"))).select("group", "words", "all_words")
    named = found.join(parts.select("group", "part", "words"), ["group", "words"])
    return named.join(wholes.select("group", "whole", F.col("words").alias("all_words")), ["group", "all_words"]).select("group", "part", "whole")
