"""Benchmark decontamination with a distributed positional inverted index.

One pass over the training texts stores the postings (row, position, term) of every
benchmark term.  A window is ten consecutive words of an item.  Its rarest term by corpus
count gives candidate places, offset-adjusted to where the item would start; the list of
its second rarest term, adjusted likewise, is intersected next, and only what survives is
checked term by term.  A window occurs as a phrase where all its terms stand at their
offsets, and in proximity where each stands within ``slack`` of its offset.

Only DataFrame functions run here.  The term table is broadcast only while its counted
size is within ``BROADCAST_TERMS``; beyond, Spark joins by shuffle.

Defined cases: null texts have no words; an item of fewer than ten words is one window,
one of none has no window; repeated document rows are separate rows, each counted by
itself; an item_id that several rows share is one item; an item without id hits but is not
listed; empty tables give no rows or no hits; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import lowered, stored

RUN, SLACK = 10, 2
BROADCAST_TERMS = 200_000
# Upper case is still in the class: words are lowered one by one afterwards.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _lower(word: Column) -> Column:
    plain = F.octet_length(word) == F.char_length(word)
    return F.when(plain, F.lower(word)).otherwise(lowered(word))


def _words(text: str) -> Column:
    return F.coalesce(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0)),
                      F.array().cast("array<string>"))


@dataclass
class Index:
    terms: DataFrame     # word, term, small: its size was checked
    items: DataFrame     # item, item_id, ipos, term, size
    postings: DataFrame  # row, pos, term
    rows: DataFrame      # row, doc_id, n_words
    small: bool

    def sized(self, df: DataFrame) -> DataFrame:
        """Broadcast tables derived from the terms only if the check passed."""
        return F.broadcast(df) if self.small else df


def build_index(docs: DataFrame, items: DataFrame, broadcast_terms: int = BROADCAST_TERMS) -> Index:
    wordlist = stored(items.select(
        F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("string"),
        _words("text").alias("words")), "items").select(
        "item", "item_id", F.size("words").alias("size"), F.posexplode("words").alias("ipos", "w")
    ).withColumn("word", _lower(F.col("w"))).drop("w")
    terms = stored(wordlist.select("word").distinct().select(
        "word", F.monotonically_increasing_id().alias("term")), "terms")
    named = stored(wordlist.join(terms, "word").drop("word"), "item-terms")
    small = named.count() <= broadcast_terms
    # The empty word closes each text; its position is the number of words.
    end = docs.sparkSession.createDataFrame([("", -1)], "word string, term long")
    known = terms.union(end)
    known = F.broadcast(known) if small else known
    # The row number is given before the words are dealt out, one for each document.
    postings = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
        "text").select(
        "row", "doc_id",
        F.posexplode(F.concat(_words("text"), F.array(F.lit("")))).alias("pos", "w"),
    ).withColumn("word", _lower(F.col("w"))).join(known, "word").select(
        "row", F.when(F.col("term") == -1, F.col("doc_id")).alias("doc_id"), "pos", "term")
    postings = stored(postings, "postings")
    return Index(
        terms, named, postings.filter("term >= 0").select("row", "pos", "term"),
        postings.filter("term = -1").select("row", "doc_id", F.col("pos").cast("long").alias("n_words")),
        small)


def windows(index: Index, run: int = RUN) -> DataFrame:
    """(item, start, length, p1, t1, p2, t2): each window with its two rarest terms."""
    counts = index.postings.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    placed = index.items.join(counts, "term", "left").withColumn(
        "place", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "ipos", "term"))
    ahead = Window.partitionBy("item").orderBy("ipos").rowsBetween(0, run - 1)
    two = F.slice(F.sort_array(F.collect_list("place").over(ahead)), 1, 2)  # run places at most
    return placed.withColumn("two", two).filter(
        F.col("ipos") <= F.greatest(F.lit(0), F.col("size") - run)).select(
        "item", F.col("ipos").alias("start"), F.least("size", F.lit(run)).alias("length"),
        F.col("two")[0]["ipos"].alias("p1"), F.col("two")[0]["term"].alias("t1"),
        F.coalesce(F.get("two", F.lit(1)), F.col("two")[0])["ipos"].alias("p2"),
        F.coalesce(F.get("two", F.lit(1)), F.col("two")[0])["term"].alias("t2"))


def _shifts(slack: int) -> Column:
    return F.explode(F.sequence(F.lit(-slack), F.lit(slack)))


def matches(index: Index, run: int = RUN, slack: int = SLACK) -> DataFrame:
    """(row, item, start, at, length, phrase): window ``start`` of an item stands at word
    ``at`` of a text, as a phrase or else in proximity."""
    views = stored(windows(index, run), "windows")
    anchors = views.select("item", "p1", "t1", "p2", "t2").distinct()
    first = index.postings.join(index.sized(anchors), F.col("term") == F.col("t1")).select(
        "row", "item", "p1", "p2", "t2", (F.col("pos") - F.col("p1")).alias("diagonal"))
    second = first.withColumn("shift", _shifts(slack)).withColumn(
        "pos", F.col("diagonal") + F.col("p2") + F.col("shift"))
    seconds = index.postings.join(
        index.sized(anchors.select(F.col("t2").alias("term")).distinct()), "term", "left_semi")
    kept = second.join(seconds.withColumnRenamed("term", "t2"), ["row", "pos", "t2"]).select(
        "row", "item", "p1", "p2", "diagonal").distinct()
    places = kept.join(index.sized(views.drop("t1", "t2")), ["item", "p1", "p2"]).select(
        "row", "item", "start", "length", "diagonal")
    terms = index.items.select(F.col("item").alias("i"), "ipos", "term")
    asked = places.join(index.sized(terms), (F.col("item") == F.col("i"))
                        & F.col("ipos").between(F.col("start"), F.col("start") + F.col("length") - 1)
                        ).withColumn("shift", _shifts(slack)).withColumn(
        "pos", F.col("diagonal") + F.col("ipos") + F.col("shift"))
    met = asked.join(index.postings, ["row", "pos", "term"]).select(
        "row", "item", "start", "length", "diagonal", "ipos", "shift")
    each = met.groupBy("row", "item", "start", "length", "diagonal", "ipos").agg(
        F.max((F.col("shift") == 0).cast("int")).alias("exact"))
    return each.groupBy("row", "item", "start", "length", "diagonal").agg(
        F.count(F.lit(1)).alias("near"), F.sum("exact").alias("exact")).filter(
        F.col("near") == F.col("length")).select(
        "row", "item", "start", (F.col("diagonal") + F.col("start")).alias("at"), "length",
        (F.col("exact") == F.col("length")).alias("phrase"))


def contamination(docs: DataFrame, items: DataFrame, run: int = RUN, slack: int = SLACK,
                  broadcast_terms: int = BROADCAST_TERMS) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near
    (windows met in proximity only)."""
    index = build_index(docs, items, broadcast_terms)
    found = stored(matches(index, run, slack), "matches")
    phrases = found.filter("phrase")
    words = phrases.select("row", F.explode(F.sequence(
        F.col("at"), F.col("at") + F.col("length") - 1)).alias("pos")).distinct().groupBy(
        "row").agg(F.count(F.lit(1)).alias("n_hit"))
    ids = index.items.select("item", "item_id").distinct()
    listed = phrases.select("row", "item").distinct().join(index.sized(ids), "item").groupBy(
        "row").agg(F.sort_array(F.collect_set("item_id")).alias("ids"))
    near = found.filter("not phrase").groupBy("row").agg(F.count(F.lit(1)).alias("n_near"))
    return index.rows.join(words, "row", "left").join(listed, "row", "left").join(
        near, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("ids", ","), F.lit("")), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        F.coalesce("n_near", F.lit(0)).alias("n_near"))
