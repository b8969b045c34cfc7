"""Phrases looked up in a lexicon, level by level."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import metrics

# The names of the levels.
LEVELS = ("exact_phrase", "simple_lemma_phrase", "phrase_subspan", "simple_lemma_subspan", "token_or_token_lemma")


def lookups(phrases: DataFrame) -> DataFrame:
    """(id, term, level, place): what each phrase (id, phrase) is looked up as, each term once, ``place`` being its turn.

    First the phrase, then its base forms, then its parts of three and of two words
    from left to right, each followed by its base forms, then the base forms of its
    words. Base forms of one text come in alphabetical order.
    """
    words = F.filter(F.split("phrase", " "), lambda w: w != "")
    own = phrases.where("phrase IS NOT NULL").select("id", "phrase", words.alias("words"))

    def spans(width: int):
        starts = F.sequence(F.lit(0), F.size("words") - width)
        made = F.transform(starts, lambda i: F.struct((F.lit(3 - width)).alias("narrow"), i.alias("start"), F.concat_ws(" ", F.slice("words", i + 1, width)).alias("part")))
        return F.when(F.size("words") >= width, made).otherwise(F.array().cast("array<struct<narrow:int,start:int,part:string>>"))

    parts = own.select("id", "phrase", F.explode(F.concat(F.array(F.struct(F.lit(-1).alias("narrow"), F.lit(0).alias("start"), F.col("phrase").alias("part"))), spans(3), spans(2), spans(1))).alias("p"))
    parts = parts.select("id", "phrase", "p.*").where("narrow = -1 OR narrow = 2 OR part != phrase")
    each = parts.select("*", F.explode(T.lemmas(F.col("part"))).alias("term"))
    base, whole, word = F.col("term") != F.col("part"), F.col("narrow") == -1, F.col("narrow") == 2
    level = F.when(whole & ~base, 0).when(whole, 1).when(word, 4).when(base, 3).otherwise(2)
    # Parts come before words, a part's own text before its base forms.
    place = F.struct(F.when(whole, 0).when(word, 2).otherwise(1).alias("group"), "narrow", "start", F.when(word, 0).otherwise(base.cast("int")).alias("base"), "term")
    return each.where("term != ''").select("id", "term", level.alias("level"), place.alias("place")).groupBy("id", "term").agg(F.min_by("level", "place").alias("level"), F.min("place").alias("place"))


def looked_up(phrases: DataFrame, lexicon: DataFrame, most: int) -> DataFrame:
    """(id, rank, entry, how): the first ``most`` entries of ``lexicon`` (entry) for each phrase (id, phrase), with the level that found each."""
    # A turn makes hundreds of terms, which the size of the phrases' files does not tell: neither side is broadcast.
    hits = lookups(phrases).hint("merge").join(lexicon.select(F.col("entry").alias("term")).distinct(), "term")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("place"))
    ranked = metrics.top(hits, most, ["id"], F.asc("place")).withColumn("rank", rank)
    return ranked.select("id", "rank", F.col("term").alias("entry"), F.element_at(F.array(*map(F.lit, LEVELS)), F.col("level") + 1).alias("how"))
