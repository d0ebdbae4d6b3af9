"""Language identification by fusing Bayesian evidence.

Text: naive Bayes over hashed byte trigrams, its table summed by Spark over all labelled
documents.  Declared markup language and address suffix: how often each value meets each
language that texts alone show, counted over the whole input and smoothed.  Host: a prior
smoothed along a hierarchy, host towards domain towards all, from the same grouped counts,
each row's own vote taken out of them.  The logarithms are added and normalised.

One hypothesis more stands for none of the languages: its trigrams fall on all buckets
alike, it has a small fixed prior, and markup and suffix say about it what they say overall.
Trigrams of other languages and of random letters are rarer in every language than that, and
the evidence grows with the text, so short clean texts stay.

The trigram table and the list of languages have a fixed bound; tables by host, domain,
markup or suffix value grow with the input and are broadcast only up to ``BROADCAST_ROWS``.

Defined cases: missing markup, suffix or host is no evidence; text without a letter gives
no text evidence, so such a row gets its language from the rest and is not kept; rows best
explained by none of the languages have no language and are not kept, nor are rows of less
than ``LEAST`` confidence; ties go to the language first in the alphabet;
null labels train nothing, and without labels there is no language; repeated rows are
separate rows; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import (
    arrow_fold, forget_pieces, lowered, slices, small_batches, stored, whole_text,
)

BUCKETS, BLOCK, MOST_LANGUAGES, BROADCAST_ROWS = 1 << 14, 1 << 20, 500, 100_000
TEMPER, SMOOTH, STRENGTH, LEAST, NONE_PRIOR = 0.3, 0.5, 10.0, 0.3, 0.01

# Letters to lower case, every other ASCII byte to a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def _trigrams(data: bytes) -> Iterator[np.ndarray]:
    """Buckets of the byte trigrams of one text that hold a letter, in blocks."""
    for at in range(0, max(len(data) - 2, 0), BLOCK):
        b = np.frombuffer(data[at:at + BLOCK + 2], np.uint8).astype(np.uint32)
        joined = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
        joined = joined[joined != 0x202020]
        yield ((joined * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int64)


def _folded(text: str | None) -> bytes:
    data = (text or "").encode("utf-8").translate(_FOLD).strip()
    return b" " + data + b" " if data else b""


def train(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities by bucket and language) from columns text and lang."""

    def body(batches):
        votes: dict[str, np.ndarray] = {}
        for part in (part for batch in batches for part in slices(batch)):
            for text, lang in zip(part.column("text").to_pylist(), part.column("lang").to_pylist()):
                counts = votes.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for found in _trigrams(_folded(text)):
                    counts += np.bincount(found, minlength=BUCKETS)
        for lang, counts in votes.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()),
                 pa.array(counts[at], pa.int64())], ["lang", "bucket", "n"])

    rows = arrow_fold(labelled.filter("lang is not null").select("text", "lang"), body,
                     "lang string, bucket int, n long").groupBy("lang", "bucket").agg(
        F.sum("n").alias("n"))
    # One array per language, at most MOST_LANGUAGES times BUCKETS numbers.
    tables = rows.groupBy("lang").agg(F.collect_list("bucket"), F.collect_list("n")).limit(
        MOST_LANGUAGES + 1).collect()
    if len(tables) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} language labels")
    tables.sort(key=lambda r: r[0])
    counts = np.zeros((BUCKETS, len(tables)))
    for i, (_, buckets, n) in enumerate(tables):
        counts[buckets, i] = n
    smooth = counts + SMOOTH
    return [r[0] for r in tables], np.log(smooth / smooth.sum(axis=0)).astype(np.float32)


def likelihood(table: np.ndarray):
    """A column function: tempered log likelihood per language and, last, of none of them;
    null without a letter."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        forget_pieces()
        for texts in batches:
            out = []
            for value in texts:  # one text is a Python object at a time
                total, n = np.zeros(table.shape[1]), 0
                for found in _trigrams(_folded(value.as_py())):
                    total += table[found].sum(axis=0, dtype=np.float64)
                    n += len(found)
                none = -n * np.log(BUCKETS)
                out.append((np.append(total, none) * TEMPER).tolist() if n else None)
            yield pa.array(out, pa.list_(pa.float64()))

    return score


def page_evidence(pages: DataFrame) -> DataFrame:
    """Pages as text with evidence columns markup, suffix, host, domain."""
    html, url = F.coalesce("html", F.lit("")), lowered(F.coalesce("url", F.lit("")))
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*+>.*?</\1\s*+>|<!--.*?-->|<[^>]*+>", " ")
    host = F.nullif(F.regexp_extract(url, r"^[a-z][a-z0-9+.-]*+://(?:[^/?#@]*+@)?([^/:?#]++)", 1), F.lit(""))
    markup = F.regexp_extract(html, r"(?i)<html\b[^>]*?\slang\s*+=\s*+[\"']?([A-Za-z]++)", 1)
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), bare.alias("text"),
        F.nullif(lowered(markup), F.lit("")).alias("markup"),
        F.nullif(F.regexp_extract(host, r"\.([^.]++)$", 1), F.lit("")).alias("suffix"),
        host.alias("host"), F.regexp_extract(host, r"([^.]++(?:\.[^.]++)?+)$", 1).alias("domain"))


def document_evidence(docs: DataFrame) -> DataFrame:
    """Documents with their source as host; they declare nothing and have no address."""
    none = F.lit(None).cast("string")
    return docs.withColumns({
        "markup": none, "suffix": none, "host": F.col("source").cast("string"), "domain": none})


def _best(scores: Column, languages: list[str]) -> Column:
    names = F.array(*[F.lit(x) for x in languages])
    return F.get(names, (F.array_position(scores, F.array_max(scores)) - 1).cast("int"))


def _text_lang(languages: list[str]) -> Column:
    """The language of the text alone; null if none of them explains it better."""
    own, none = F.slice("__text", 1, len(languages)), F.get("__text", F.lit(len(languages)))
    return F.when(F.array_max(own) >= none, _best(own, languages))


def _sized(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def fuse(scored: DataFrame, languages: list[str], votes_of: DataFrame | None = None) -> DataFrame:
    """Add lang, confidence, text_lang and kept to rows with column ``__text`` and evidence.

    ``votes_of`` may hold the same rows stored, so that counting does not score texts anew.
    """
    size = len(languages)
    if not size:
        return scored.drop("__text").withColumns({
            "text_lang": F.lit(None).cast("string"), "lang": F.lit(None).cast("string"),
            "confidence": F.lit(0.0), "kept": F.lit(False)})
    votes = scored.withColumn("text_lang", _text_lang(languages))
    cells = [F.sum((F.col("text_lang") == x).cast("long")) for x in languages]
    seen = scored if votes_of is None else votes_of
    seen = seen.withColumn("text_lang", _text_lang(languages)).filter("text_lang is not null")
    total = [n or 0 for n in seen.agg(*cells).first()]
    share = [(n + 1) / (sum(total) + size) for n in total]

    def counted(column: str) -> DataFrame:
        return _sized(stored(seen.filter(F.col(column).isNotNull()).groupBy(
            F.col(column).alias(f"__{column}")).agg(F.array(*[
                F.coalesce(c, F.lit(0)) for c in cells]).alias(f"__n_{column}")), f"{column}-votes"))

    out = votes
    for column in ("markup", "suffix", "host", "domain"):
        out = out.join(counted(column), F.col(column) == F.col(f"__{column}"), "left")
    own = [F.coalesce((F.col("text_lang") == x).cast("int"), F.lit(0)) for x in languages]

    def pulled(column: str, towards: list[Column]) -> list[Column]:
        """Counts without the row's own vote, smoothed towards the level above."""
        counts = [F.coalesce(F.get(f"__n_{column}", F.lit(i)) - own[i], F.lit(0)) for i in range(size)]
        of = sum(counts[1:], counts[0]) + F.lit(STRENGTH)
        return [(c + t * STRENGTH) / of for c, t in zip(counts, towards)]

    prior = pulled("domain", [F.lit(s) for s in share])
    out = out.withColumn("__domain_prior", F.array(*prior))
    prior = pulled("host", [F.get("__domain_prior", F.lit(i)) for i in range(size)])
    out = out.withColumn("__prior", F.array(*prior))

    def told(column: str, i: int) -> Column:
        n = F.get(f"__n_{column}", F.lit(i)) - own[i]
        return F.coalesce(F.log((n + F.lit(SMOOTH)) / F.lit(float(total[i] + size))), F.lit(0.0))

    scores = [F.coalesce(F.get("__text", F.lit(i)), F.lit(0.0)) + F.log(F.get("__prior", F.lit(i)))
              + told("markup", i) + told("suffix", i) for i in range(size)]
    out = out.withColumn("__scores", F.array(*scores))

    def told_overall(column: str) -> Column:
        n = sum((F.get(f"__n_{column}", F.lit(i)) - own[i] for i in range(size)), F.lit(0))
        return F.coalesce(F.log((n + F.lit(SMOOTH)) / F.lit(float(sum(total) + size))), F.lit(0.0))

    # Without text there is no evidence for or against none of the languages.
    none = F.when(F.col("__text").isNotNull(), F.get("__text", F.lit(size)) + F.lit(float(np.log(
        NONE_PRIOR))) + told_overall("markup") + told_overall("suffix"))
    out = out.withColumn("__none", none)
    top = F.array_max("__scores")
    mass = F.aggregate(F.transform("__scores", lambda s: F.exp(s - F.array_max("__scores"))),
                       F.lit(0.0), lambda a, x: a + x)
    # The exponent is bounded for exp; none wins at any value above the top.
    other = F.coalesce(F.exp(F.least(F.col("__none") - top, F.lit(700.0))), F.lit(0.0))
    known = F.coalesce(F.col("__none") <= top, F.lit(True))
    out = out.withColumn("lang", F.when(known, _best(F.col("__scores"), languages)))
    out = out.withColumn("confidence", F.lit(1.0) / (mass + other))
    kept = F.col("__text").isNotNull() & known & (F.col("confidence") >= LEAST)
    out = out.withColumn("kept", kept)
    return out.drop("__text", "__scores", "__none", "__prior", "__domain_prior", *[
        f"__{p}{c}" for c in ("markup", "suffix", "host", "domain") for p in ("", "n_")])


def score_text(evidence: DataFrame, table: np.ndarray) -> DataFrame:
    return small_batches(evidence).withColumn("__text", likelihood(table)(whole_text()))


EVIDENCE = ("markup", "suffix", "host", "domain")


def identified(docs: DataFrame, evidence=document_evidence) -> DataFrame:
    """The rows that are kept, with their own columns unchanged, whatever their names."""
    languages, table = train(docs)
    source = docs["source"] if "source" in docs.columns else F.lit(None).cast("string")
    view = evidence(docs.select(F.struct("*").alias("__row"), "text", source.alias("source")))
    scored = score_text(view, table)
    votes = stored(scored.select("__text", *EVIDENCE), "text-evidence")
    return fuse(scored, languages, votes).filter("kept").select("__row.*")
