"""Words of a text that may want a definition: uncommon ones, and headwords of dictionaries that are not among the commonest.

Lines have ``by``, ``idx`` and ``text``; word lists are tables with ``word``, in lower case. Lists are met by the forms of
distinct words, never word by word against a list. Null texts are empty; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kept import kept
from . import order

#: Endings that inflections may add; fixed values.
SUFFIXES = ("'s", "'d", "'st", "s", "es", "ed", "d", "ing", "er", "est", "eth", "st", "ly")


def _stems(word: Column) -> Column:
    """A word and the stems that its inflections could come from."""
    found = [F.array(word)]
    for suffix in SUFFIXES:
        stem = F.substring(word, F.lit(1), F.length(word) - len(suffix))
        undoubled = F.when(stem.rlike(r"([^aeiou])\1$"), F.substring(stem, F.lit(1), F.length(stem) - 1))
        with_y = F.when(stem.endswith("i"), F.concat(F.substring(stem, F.lit(1), F.length(stem) - 1), F.lit("y")))
        found.append(F.when(word.endswith(suffix) & (F.length(stem) >= 2), F.array(stem, F.concat(stem, F.lit("e")), undoubled, with_y)).otherwise(F.array().cast("array<string>")))
    return F.array_compact(F.concat(*found))


def lowered(word: Column) -> Column:
    return F.replace(F.lower(word), F.lit("’"), F.lit("'"))


def forms(word: Column) -> Column:
    """A word in lower case and the stems it could come from, an elided letter (``wat'ry``, ``o'er``) read as e, v or none."""
    low = F.replace(lowered(word), F.lit("è"), F.lit("e"))
    elided = r"^(.*?(?<=\p{L}))'(?=\p{L}{2})"
    spelled = F.when(F.contains(low, F.lit("'")), F.array(low, *[F.regexp_replace(low, elided, f"$1{letter}") for letter in ("e", "v", "")])).otherwise(F.array(low))
    return F.array_distinct(F.flatten(F.transform(spelled, _stems)))


def tokens(lines: DataFrame, by: str) -> DataFrame:
    """``by``, ``idx``, ``n``, ``start``, ``end``, ``printed``: words of letters with inner apostrophes, and where they are."""
    runs = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\p{L}+(?:['’]\p{L}+)*|[^\p{L}]+"), F.lit(0))
    dealt = order.running_offset(lines.select(by, "idx", F.posexplode(runs).alias("n", "printed")), [by, "idx"], "n", F.length("printed"), "start")
    return dealt.where(F.col("printed").rlike(r"^\p{L}")).select(by, "idx", "n", F.col("start").cast("int").alias("start"), (F.col("start") + F.length("printed")).cast("int").alias("end"), "printed")


def glossary_tokens(lines: DataFrame, by: str) -> DataFrame:
    """As ``tokens``, of letters, apostrophes and hyphens, without those at the ends."""
    runs = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[\p{L}’'-]+|[^\p{L}’'-]+"), F.lit(0))
    dealt = order.running_offset(lines.select(by, "idx", F.posexplode(runs).alias("n", "run")), [by, "idx"], "n", F.length("run"), "at")
    bare = F.regexp_replace(F.col("run"), r"^['’-]+|['’-]+$", "")
    ahead = F.length("run") - F.length(F.regexp_replace("run", r"^['’-]+", ""))
    return dealt.where(F.col("run").rlike(r"^[\p{L}’'-]")).select(by, "idx", "n", (F.col("at") + F.when(bare == "", 0).otherwise(ahead)).cast("int").alias("start"), bare.alias("printed")).withColumn("end", F.col("start") + F.length("printed"))


def _any_form(words: DataFrame, known: DataFrame, name: str) -> DataFrame:
    """``words`` (``word``, ``form``) of which a form is in ``known``, with ``name`` true."""
    return words.join(known.select(F.col("word").alias("form")).distinct(), "form", "left_semi").select("word", F.lit(True).alias(name)).distinct()


def candidates(lines: DataFrame, by: str, common: DataFrame, commonest: DataFrame, headwords: DataFrame, names: DataFrame, defined: DataFrame, function_words: Iterable[str] = ()) -> DataFrame:
    """``by``, ``word``, ``turn`` (by first occurrence), ``occurrences`` (``idx``, ``start``, ``end``, ``printed``, in order).

    A word is one if no form of it is in ``common``, or if it is a headword and no form is in ``commonest``. Words of one
    letter, ``function_words``, numerals, ``names`` (``by``, ``name``) unless a part of them is a headword, and places that a
    definition covers (``defined``: ``by``, ``idx``, ``start``, ``end``) are none.
    """
    said = kept(tokens(lines, by).withColumn("word", lowered(F.col("printed"))))
    covered = said.alias("t").join(defined.select(by, "idx", F.col("start").alias("a"), F.col("end").alias("b")), [by, "idx"]).where("a < end and start < b").select(by, "idx", "n").distinct()
    parts = names.select(by, F.explode(F.filter(F.split("name", r"[^\p{L}'’]+"), lambda p: p != "")).alias("part")).withColumn("word", F.lower("part"))
    part_forms = parts.select("word", F.explode(forms(F.col("part"))).alias("form")).distinct()
    called = parts.join(_any_form(part_forms, headwords, "head"), "word", "left_anti").select(by, F.col("word").alias("bare")).distinct()
    fit = said.where((F.length("word") >= 2) & ~F.col("word").isin(*function_words or [""]) & ~F.col("printed").rlike("^[IVXLC]{2,}$"))
    fit = fit.withColumn("bare", F.regexp_replace("word", "'s$", "")).join(called, [by, "bare"], "left_anti").join(covered, [by, "idx", "n"], "left_anti")
    distinct = kept(fit.select("word").distinct())
    of = kept(distinct.select("word", F.explode(forms(F.col("word"))).alias("form")))
    told = distinct.join(_any_form(of, common, "common"), "word", "left").join(_any_form(of, headwords, "head"), "word", "left").join(_any_form(of, commonest, "very"), "word", "left")
    wanted = told.where(F.col("common").isNull() | (F.col("head").isNotNull() & F.col("very").isNull())).select("word")
    listed = F.array_sort(F.collect_list(F.struct("idx", "start", "end", "printed")))
    grouped = fit.join(wanted, "word", "left_semi").groupBy(by, "word").agg(listed.alias("occurrences"))
    turn = F.row_number().over(Window.partitionBy(by).orderBy(F.col("occurrences")[0]))
    return grouped.select(by, "word", turn.alias("turn"), "occurrences")
