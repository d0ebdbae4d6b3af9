"""Substring search over names, titles, ids and URLs through a stored trigram index.

``build`` writes two tables: the texts of all rows, keyed by content, and one posting per
trigram and row, bucketed and sorted by trigram, with the number of rows of each trigram.  ``find``
looks the needle's trigrams up, intersects the RAREST of their lists and tests the needle on the
texts of what is left, so it reads a few posting lists and at most the candidates' texts,
however many rows there are.  Every row that contains the needle holds all of its trigrams, so
results equal those of a scan.  A needle of fewer than three characters has no trigram and scans
the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.sinks.keyed import KeyedTable

GRAM = 3
RAREST = 3


def _grams(text: Column) -> Column:
    """Distinct trigrams of a text."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - GRAM + 1, F.lit(1)))
    return F.array_distinct(F.filter(F.transform(starts, lambda i: F.substring(text, i, GRAM)),
                                     lambda g: F.length(g) == GRAM))


class SearchIndex:
    """A folder with the tables of one index."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path = spark, path.rstrip("/")
        self.texts = KeyedTable(spark, f"{self.path}/texts", ["row"], buckets=buckets)
        self.postings = KeyedTable(spark, f"{self.path}/postings", ["gram", "row"], ["gram"], buckets, blooms=False)

    def build(self, **tables: tuple[DataFrame, str, list[str]]) -> SearchIndex:
        """name=(table, id column, text columns); the first text column is the label."""
        parts = [df.select(
            F.lit(kind).alias("entity"), F.col(key).cast("string").alias("id"),
            F.col(columns[0]).cast("string").alias("label"),
            F.array(*[F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]).alias("texts"))
            for kind, (df, key, columns) in tables.items()]
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        facts = ["entity", "id", "label", "texts"]
        # Equal rows are kept once, with their number.
        self.texts.append(rows.groupBy(*facts).agg(F.count(F.lit(1)).alias("times")).withColumn(
            "row", F.sha2(F.to_json(F.struct(*facts)), 256)))
        stored = self.texts.read()
        if stored is not None:
            grams = stored.select("row", F.explode(F.array_distinct(F.flatten(F.transform("texts", _grams)))).alias("gram"))
            self.postings.append(grams)
        return self

    def _lists(self, grams: list[str]) -> DataFrame | None:
        """Postings of some trigrams, from their buckets only."""
        asked = self.spark.createDataFrame([(g, None) for g in grams], "gram string, row string")
        stored = self.postings.read(buckets=self.postings.touched(asked))
        return None if stored is None else stored.filter(F.col("gram").isin(grams))

    def candidates(self, needle: str) -> DataFrame | None:
        """Keys of the rows that hold the needle's rarest trigrams; None if it has none."""
        needle = needle.lower()
        grams = sorted({needle[k:k + GRAM] for k in range(len(needle) - GRAM + 1)})
        if not grams:
            return None
        lists = self._lists(grams)
        if lists is None:
            return self.spark.createDataFrame([], "row string")
        sizes = {r.gram: r["count"] for r in lists.groupBy("gram").count().collect()}
        rarest = sorted(grams, key=lambda g: (sizes.get(g, 0), g))[:RAREST]
        met = lists.filter(F.col("gram").isin(rarest)).groupBy("row").agg(F.count(F.lit(1)).alias("n"))
        return met.filter(F.col("n") == len(rarest)).select("row")

    def find(self, needle: str) -> DataFrame:
        """Rows with a text that contains the needle, whatever the case: entity, id, label."""
        chosen = self.candidates(needle)
        texts = self.texts.read() if chosen is None else self.texts.rows_for(chosen)
        if texts is None:
            return self.spark.createDataFrame([], "entity string, id string, label string")
        hit = F.exists("texts", lambda t: F.contains(t, F.lit(needle.lower())))
        return texts.filter(hit).withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select(
            "entity", "id", "label")
