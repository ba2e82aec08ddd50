"""Spelling variants of words by permuterm rotations (operator 13)."""

from __future__ import annotations

import math
import string

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanwarden.llm.shared import written

#: Letters of words after A-Z are lower-cased, and the mark that stands after the last letter of a word.
LETTERS, END = r"[a-zÀ-ÿ]", "$"


def word_counts(docs: DataFrame, ident: str = "doc_id", text: str = "text", least_length: int = 6, least_n: int = 5,
                slip_every: int = 199) -> DataFrame:
    """``word`` and ``n`` of all words with at least ``least_length`` letters that occur ``least_n`` times or more.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF with A-Z lower-cased. A word whose crc32 together with the id is a multiple of
    ``slip_every`` loses one letter before it is counted: such slips test what the grouping finds. A null text has no
    words, a null id counts as an empty one; repeated rows count each; an empty table gives no rows; other columns are ignored.
    """
    lowered = F.translate(F.col(text).cast("string"), string.ascii_uppercase, string.ascii_lowercase)
    runs = docs.select(F.coalesce(F.col(ident).cast("string"), F.lit("")).alias("id"),
                       F.explode(F.regexp_extract_all(lowered, F.lit(LETTERS + "{%d,}" % least_length), F.lit(0))).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run"))
    at = (h % F.length("run")).cast("int")
    run = F.col("run")
    slip = F.concat(run.substr(F.lit(1), at), run.substr(at + 2, F.length(run)))
    words = runs.select(F.when(h % slip_every == 0, slip).otherwise(run).alias("word")).where(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n)


def rotations(words: DataFrame) -> DataFrame:
    """``key``, ``word``, ``n``, ``whole`` and ``first``: all rotations of each word with ``END``, each once whole, and once without
    its last letter unless that is ``END``.

    Words that differ by one replaced letter share the rotation that ends just before it. A word without one of
    its letters is, whole, the rotation of the longer word that ends before that letter. ``first`` marks the first of a run of
    equal letters: any of them may be the one too many, and one is counted.
    """
    turned = words.select("word", "n", F.explode(F.sequence(F.lit(0), F.length("word"))).alias("i"))
    word, i = F.col("word"), F.col("i")
    head = F.concat(F.lit(END), word.substr(F.lit(1), i))
    skipped, before = word.substr(i + 1, F.lit(1)), word.substr(i, F.lit(1))
    whole = F.struct(F.concat(word.substr(i + 1, F.length(word)), head).alias("key"), F.lit(True).alias("whole"), F.lit(False).alias("first"))
    short = F.struct(F.concat(word.substr(i + 2, F.length(word)), head).alias("key"), F.lit(False).alias("whole"),
                     ((i == 0) | (skipped != before)).alias("first"))
    kinds = F.when(i < F.length(word), F.array(whole, short)).otherwise(F.array(whole))
    return turned.select("word", "n", F.inline(kinds)).select("key", "word", "n", "whole", "first")


def neighbours(words: DataFrame) -> DataFrame:
    """``word``, ``n_near`` (words that differ by exactly one inserted, deleted or replaced letter), ``near`` and ``near_n`` (the most
    frequent of those; of equal ones the smallest), for words that have any.

    Sorted rotations are scanned group by group. A group holds one whole rotation at most, and one shortened for each letter of
    the alphabet, so it is small however many words there are; its members are all near to each other, and each takes its
    count and the best of the others from the group without pairs being made.
    """
    w = Window.partitionBy("key").orderBy(F.desc("n"), "word").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    whole, first = F.col("whole"), F.col("first")
    best = F.struct((-F.col("n")).alias("n"), F.col("word").alias("word"))
    seen = rotations(words).select(
        "word", "whole", "first", F.count("*").over(w).alias("members"), F.sum(whole.cast("int")).over(w).alias("wholes"),
        F.sum(first.cast("int")).over(w).alias("firsts"), F.first(best).over(w).alias("best"), F.nth_value(best, 2).over(w).alias("next"))
    seen = seen.where(F.col("members") > 1)
    near = F.when(whole, F.col("firsts")).otherwise(
        F.col("members") - F.col("wholes") - 1 + F.when(first, F.col("wholes")).otherwise(0))
    other = F.when(F.col("best")["word"] == F.col("word"), F.col("next")).otherwise(F.col("best"))
    found = seen.select("word", near.alias("near"), other.alias("other")).groupBy("word").agg(
        F.sum("near").alias("n_near"), F.min("other").alias("other"))
    return found.select("word", "n_near", F.col("other")["word"].alias("near"), (-F.col("other")["n"]).alias("near_n"))


def spelling_variants(words: DataFrame, times: int = 5) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` for each row of ``words`` (``word``, ``n``; distinct words).

    The form of a word is the most frequent near word if that is ``times`` as frequent or more; the root is where
    forms lead, the word itself without one. Counts grow by ``times`` with each step, so a way has at most log(largest n) steps
    and roots are found by a few joins that each double the way. Words of any length are taken whole; an empty table gives no rows.
    """
    words = written(words.select("word", "n"))
    near = written(words.join(neighbours(words), "word", "left"))
    has = F.col("near_n") >= times * F.col("n")
    rows = near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                       F.when(has, F.col("near")).alias("form"), F.when(has, F.col("near_n")).alias("form_n"))
    least, most = words.agg(F.min("n"), F.max("n")).first()
    steps = int(math.log(max(most, 1) / max(least, 1)) / math.log(times) + 1e-9) if most else 0
    ways = rows.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    for _ in range(max(steps - 1, 0).bit_length()):
        ahead = ways.select(F.col("word").alias("root"), F.col("root").alias("further"))
        ways = written(ways.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root")))
    return rows.join(ways, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
