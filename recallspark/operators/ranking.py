"""Lexical scores within groups of candidates, bounded histories and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallspark.functions.text import tokens


def first_per_group(rows: DataFrame, group: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The n first rows of each group with their rank from 1; the engine cuts groups before it shuffles them. n below 1: none."""
    over = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(over)).where(F.col(rank) <= n)


def _idf_weight(f: Column, df: Column, n: Column, length: Column, mean: Column, k1: float, b: float) -> Column:
    """What a term that occurs f times adds to a text's score."""
    one, half, f, df = F.lit(1.0), F.lit(0.5), f.cast("double"), df.cast("double")
    below = F.when(mean > 0, f + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * length / mean)).otherwise(f)
    return F.when(f > 0, F.ln(one + (n - df + half) / (df + half)) * (f * F.lit(k1 + 1) / below)).otherwise(0.0)


def bm25_of_bounded(candidates: DataFrame, query_col: str, text_col: str, group: list[str], out_col: str = "lexical_score", k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """As bm25, for groups of bounded size, as a query's candidates are: windows over one exchange, and each row is read once."""
    words, terms = tokens(F.col(text_col)), F.array_distinct(tokens(F.col(query_col)))
    rows = candidates.withColumn("__words", words).withColumn("__terms", terms)
    rows = rows.withColumn("__tf", F.transform("__terms", lambda t: F.size(F.filter("__words", lambda x: x == t)))).withColumn("__length", F.size("__words")).drop("__words", "__terms")
    whole = Window.partitionBy(*group)
    rows = rows.withColumn("__n", F.count(F.lit(1)).over(whole).cast("double")).withColumn("__mean", F.avg("__length").over(whole)).withColumn("__all", F.collect_list("__tf").over(whole))
    df = F.transform("__tf", lambda _, k: F.size(F.filter("__all", lambda t: F.get(t, k) > 0)))
    each = F.zip_with("__tf", df, lambda f, d: _idf_weight(f, d, F.col("__n"), F.col("__length"), F.col("__mean"), k1, b))
    rows = rows.withColumn("__raw", F.aggregate(each, F.lit(0.0), lambda s, x: s + x)).drop("__all", "__tf")
    top = F.max("__raw").over(whole)
    return rows.withColumn("__top", top).withColumn(out_col, F.when(F.col("__top") > 0, F.col("__raw") / F.col("__top")).otherwise(0.0)).drop("__n", "__mean", "__length", "__raw", "__top")


def bm25(candidates: DataFrame, query_col: str, text_col: str, group: list[str], row: list[str], out_col: str = "lexical_score", k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """candidates with BM25 of their texts for the query of their group, divided by the group's largest; 0 for all if none is above 0.

    Counts of documents, their lengths and frequencies are those of the group: partial sums, joined back. What is shuffled
    is a row's length and the frequencies of the query's terms, dealt by the row, so a group may be of any size; all that
    follows reads this one exchange, and texts are cut into tokens once.
    """
    words, terms = tokens(F.col(text_col)), F.array_distinct(tokens(F.col(query_col)))
    rows = candidates.select(*group, *row, words.alias("__words"), terms.alias("__terms"))
    tf = F.transform("__terms", lambda t: F.size(F.filter("__words", lambda x: x == t)))
    rows = rows.select(*group, *row, F.size("__words").alias("__length"), tf.alias("__tf")).repartition(*group, *row)
    # a row for the text itself (place -1) and one for each term; rows are counted by their key, so that all columns of the exchange are read
    own = F.array(F.struct(F.lit(-1).alias("place"), F.lit(1).alias("f"), F.col("__length").alias("length")))
    each = F.concat(own, F.transform("__tf", lambda f, k: F.struct(k.alias("place"), f.alias("f"), F.lit(0).alias("length"))))
    sums = rows.select(*group, F.struct(*row).alias("__row"), F.inline(F.filter(each, lambda x: x["f"] > 0))).groupBy(*group, "place")
    sums = sums.agg(F.count("__row").alias("n"), F.sum("length").alias("length"))
    stats = sums.groupBy(*group).agg(
        F.sum(F.when(F.col("place") < 0, F.col("n"))).alias("__n"), F.sum("length").alias("__total"),
        F.map_from_entries(F.collect_list(F.when(F.col("place") >= 0, F.struct("place", "n")))).alias("__df"),
    )
    n = F.col("__n").cast("double")
    weight = lambda f, place: _idf_weight(f, F.element_at("__df", place), n, F.col("__length"), F.col("__total") / n, k1, b)
    raw = F.aggregate(F.transform("__tf", weight), F.lit(0.0), lambda s, x: s + x)
    raw = rows.join(stats, group).select(*group, *row, raw.alias("__raw"))
    top = raw.groupBy(*group).agg(F.max("__raw").alias("__top"), F.count(F.struct(*row)).alias("__rows"))
    scored = raw.join(top, group).select(*group, *row, F.when(F.col("__top") > 0, F.col("__raw") / F.col("__top")).otherwise(0.0).alias(out_col))
    return candidates.join(scored, [*group, *row])
