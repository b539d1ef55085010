"""Names that mean one entity (P6): abbreviations and slips of one letter, found by keys and then verified."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import cut
from .joins import MOST_RULES

#: Letters of a word that a key holds at most.
HEAD = 3
#: Names longer than this are matched by abbreviation and equality, but not by slips.
LONGEST = 60


def _words(df: DataFrame, id: str, name: str) -> DataFrame:
    """id, n (the name in lower case, dots as blanks, one blank between words) and its words; names without words are left out."""
    plain = F.trim(F.regexp_replace(F.lower(F.col(name)), r"[.\s·・]+", " "))
    return df.select(F.col(id).alias("id"), plain.alias("n")).where(F.col("id").isNotNull() & (F.length("n") > 0)).withColumn("w", F.split("n", " "))


def match_names(short: DataFrame, full: DataFrame, id: str, target: str, name: str, full_name: str) -> DataFrame:
    """id, target, kind ('equal', 'abbreviated' or 'slip'), ambiguous (the id fits several targets by its best kind) of every fit.

    A name abbreviates another if it has as many words, and each is the beginning of the other's word in its place ("j. smi" of "John Smith"). A slip
    is one letter changed, added or left out. Of a pair the best kind counts, in that order; an id's worse kinds are dropped. An abbreviation is looked for under
    its number of words, their first letters and the head of its longest word, which the full name has at every place; a slip under the name with each letter left out. So names
    meet by equal keys, and each pair that meets is verified. Null and blank names fit nothing; repeated names of several ids each fit.

    A name is matched once, however many ids have it. Rows laid out by their keys are sorted into joins, never broadcast: they are many more than Spark reckons from the files.
    """
    named, b = _words(short, id, name), _words(full, target, full_name)
    a = named.select(F.col("n").alias("id"), "n", "w").distinct()
    initials = F.array_join(F.transform("w", lambda x: F.substring(x, 1, 1)), "")
    a, b = a.withColumn("i", initials), b.withColumn("i", initials)
    longest = F.array_max(F.transform("w", lambda x, k: F.struct(F.least(F.length(x), F.lit(HEAD)).alias("size"), (-k).alias("at"), F.substring(x, 1, HEAD).alias("head"))))
    a_keys = a.withColumn("l", longest).withColumn("key", F.concat_ws("|", F.size("w").cast("string"), "i", (-F.col("l.at")).cast("string"), "l.head")).drop("l")
    heads = F.flatten(F.transform("w", lambda x, k: F.transform(F.sequence(F.lit(1), F.least(F.length(x), F.lit(HEAD))), lambda n: F.concat_ws("|", k.cast("string"), F.substring(x, F.lit(1), n)))))
    b_keys = b.withColumn("h", F.explode(F.array_distinct(heads))).withColumn("key", F.concat_ws("|", F.size("w").cast("string"), "i", "h"))
    prefix = F.forall(F.zip_with(F.col("a.w"), F.col("b.w"), lambda x, y: F.startswith(y, x)), lambda ok: ok)
    pair = (F.col("a.id").alias("id"), F.col("b.id").alias("target"))
    shortened = a_keys.alias("a").join(b_keys.hint("merge").alias("b"), F.col("a.key") == F.col("b.key")).where((F.size("a.w") == F.size("b.w")) & prefix).select(*pair, F.when(F.col("a.n") == F.col("b.n"), 0).otherwise(1).alias("k"))

    def near(df):
        left_out = F.transform(F.sequence(F.lit(1), F.length("n")), lambda i: F.concat(F.substring("n", F.lit(1), i - 1), F.substring("n", i + 1, F.length("n"))))
        return df.where(F.length("n").between(4, LONGEST)).select("id", "n", F.explode(F.array_distinct(F.concat(F.array("n"), left_out))).alias("key"))

    slips = near(a).alias("a").join(near(b).hint("merge").alias("b"), F.col("a.key") == F.col("b.key")).where(F.levenshtein("a.n", "b.n") <= 1).select(*pair, F.lit(2).alias("k"))
    best = lambda df, *by: df.withColumn("_best", F.min("k").over(W.partitionBy(*by))).where("k = _best").drop("_best")
    fits = cut(best(shortened.unionByName(slips).groupBy("id", "target").agg(F.min("k").alias("k")), "id").withColumnRenamed("id", "n"), "name-fits")
    few = fits.limit(MOST_RULES + 1).count() <= MOST_RULES
    # an id may come with several names
    found = named.select("id", "n").join(F.broadcast(fits) if few else fits.hint("merge"), "n").repartition("id").groupBy("id", "target").agg(F.min("k").alias("k"))
    kind = F.element_at(F.array(F.lit("equal"), F.lit("abbreviated"), F.lit("slip")), F.col("k") + 1)
    return best(found, "id").select("id", "target", kind.alias("kind"), (F.count("*").over(W.partitionBy("id")) > 1).alias("ambiguous"))
