"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Four plain patterns give the seed entities of a text.  Identifier-like words, whole runs of two
to eight digit groups (7 to 19 digits) and addresses with a written "at" or "dot" that no seed
covers are candidates.  The words around seeds and candidates are lexical patterns (the
two words before; the word before and the word after), and patterns and distinct values form a
bipartite graph.  Rounds of scoring follow: a pattern's confidence is the share of its
values believed to be entities of the kind, an unseen value's belief is the noisy-or of its
confident patterns, and values believed strongly count as seeds of the next round.  What
is believed at the end is added to the seed spans wherever it stands.  Copies of a text
add nothing, for only distinct values count.

Each text is read once; the rows kept from it hold spans and contexts, not text.

Defined cases: null text is empty and has no span; the counts are of seed entities; a
candidate that overlaps a seed span is none; of believed candidates one inside another is
not added; patterns with fewer than ``SUPPORT`` believed
values never act; rows that repeat are separate rows; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import lowered, stored, whole_text

KINDS = ("email", "ip", "card", "phone")
ROUNDS, SUPPORT, CONFIDENT, BELIEVED, NEAR = 3, 3, 0.6, 0.8, 80

# Possessive forms match the same texts as plain ones and neither backtrack nor recurse.
EMAIL = r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
CANDIDATE = r"(?<![^\s,;|])(?=[^\s,;|0-9]*+[0-9])[A-Za-z0-9+(#][^\s,;|]{4,}(?<=[A-Za-z0-9])"
# Groups of digits: a run that no further group precedes or follows.
_JOIN = r"(?:\)[\x20./-]?+|[\x20./-]\(?+)"
_NUMBER = (rf"(?<![^\s,;|])(?<![0-9][\x20])(?=(?:\(?+[0-9]{_JOIN}?+){{7}})(?!(?:\(?+[0-9]{_JOIN}?+){{20}})"
           rf"\(?+[0-9]++(?:{_JOIN}[0-9]++){{1,7}}+(?!{_JOIN}?[0-9]|[A-Za-z_@]|-[A-Za-z])")
# Addresses: (at), [dot] and the like, or " at " with " dot ".
_AT, _DOT = (rf"\x20?[(\[{{{{]\x20?(?i:{w})\x20?[)\]}}}}]\x20?".replace("{{", "{").replace("}}", "}")
             for w in ("at", "dot"))
_LABEL = "[A-Za-z0-9-]++"
_ADDRESS = (rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:(?:@|{_AT}){_LABEL}(?:(?:\.|{_DOT}|\x20(?i:dot)\x20){_LABEL})++"
            rf"|\x20(?i:at)\x20{_LABEL}(?:\.{_LABEL})*+(?:(?:{_DOT}|\x20(?i:dot)\x20){_LABEL})++)")
_WRITTEN = r"(?i)[(\[{]\x20?(?:at|dot)\x20?[)\]}]|\x20at\x20\S++\x20dot\x20"
_PART = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = _digits(value)

    def add(total, i):
        x = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int") * (
            F.when(i % 2 == 0, 2).otherwise(1))
        return total + x - F.when(x > 9, 9).otherwise(0)

    size = F.length(digits)
    total = F.aggregate(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), F.lit(0), add)
    return size.between(12, 19) & F.when(size.between(12, 19), total % 10 == 0).otherwise(False)


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return _luhn(value)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _found(df: DataFrame, name: str, pattern: str, guard: Column, valid, order: int) -> DataFrame:
    """Add column ``name``: the spans of valid matches, leftmost and not overlapping.

    Matches and the gaps between them alternate, so a span starts after the lengths of all
    gaps and matches before it.  Only valid matches are placed.
    """
    text, m, g, n = F.col("text"), f"{name}_m", f"{name}_g", f"{name}_n"
    none = F.array().cast("array<string>")
    df = df.withColumns({
        m: F.when(guard, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none),
        g: F.when(guard, F.split(text, pattern, -1)).otherwise(none)})
    df = df.withColumn(n, F.zip_with(m, g, lambda a, b: F.coalesce(F.length(a), F.lit(0))
                                     + F.coalesce(F.length(b), F.lit(0))))
    where = F.filter(F.sequence(F.lit(0), F.size(m) - 1), lambda i: valid(F.get(m, i)))
    where = F.when(F.size(m) > 0, where).otherwise(F.array().cast("array<int>"))

    def place(i):
        value = F.get(m, i)
        end = F.aggregate(F.slice(n, F.lit(1), i + 1), F.lit(0), lambda a, x: a + x)
        return F.struct((end - F.length(value)).alias("start"), F.lit(order).alias("k"),
                        end.alias("end"), value.alias("value"))

    return df.withColumn(name, F.transform(where, place)).drop(m, g, n)


def _word(text: Column, which: str) -> Column:
    """Shape of a neighbouring word: lower case, digits as 0."""
    pattern = {"before": r"(\S+)\s*$", "second": r"(\S+)\s+\S+\s*$", "after": r"^\s*(\S+)"}[which]
    return F.regexp_replace(lowered(F.regexp_extract(text, pattern, 1)), "[0-9]", "0")


def _with_context(spans: str) -> Column:
    def add(s):
        before = F.substring(F.col("text"), F.greatest(s["start"] - NEAR, F.lit(0)) + 1,
                             F.least(s["start"], F.lit(NEAR)))
        after = F.substring(F.col("text"), s["end"] + 1, F.lit(NEAR))
        one = _word(before, "before")
        return F.struct(
            s["start"].alias("start"), s["k"].alias("k"), s["end"].alias("end"),
            lowered(s["value"]).alias("value"),
            F.concat_ws(" ", F.lit("2"), _word(before, "second"), one).alias("left"),
            F.concat_ws(" ", F.lit("1"), one, F.lit("_"), _word(after, "after")).alias("both"))

    return F.transform(spans, add)


def scan(docs: DataFrame) -> DataFrame:
    """(row, doc_id, base, free): seed spans and candidates with their contexts, stored."""
    text = F.col("text")
    df = docs.select(F.monotonically_increasing_id().alias("row"),
                     F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    digits = text.rlike("[0-9]")
    guards = {"email": F.contains(text, F.lit("@")), "ip": digits & F.contains(text, F.lit(".")),
              "card": digits, "phone": digits & F.contains(text, F.lit("+"))}
    for order, (kind, pattern) in enumerate(zip(KINDS, (EMAIL, IP, CARD, PHONE))):
        df = _found(df, kind, pattern, guards[kind], lambda v, kind=kind: _valid(kind, v), order)
    parts = (("free", CANDIDATE, digits), ("runs", _NUMBER, digits),
             ("written", _ADDRESS, text.rlike(_WRITTEN)))
    for name, pattern, guard in parts:
        df = _found(df, name, pattern, guard, lambda v: F.lit(True), -1)
    df = df.withColumn("free", F.array_distinct(F.concat(*[p[0] for p in parts]))).drop("runs", "written")
    df = df.withColumn("base", F.sort_array(F.concat(*KINDS))).drop(*KINDS)
    apart = F.filter("free", lambda c: ~F.exists(
        "base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    df = df.withColumn("free", apart)
    return stored(df.select("row", "doc_id", _with_context("base").alias("base"),
                            _with_context("free").alias("free")), "personal-data")


def graph(found: DataFrame) -> DataFrame:
    """(pattern, value, k): distinct edges; k is the seed's kind, -1 for a candidate."""
    each = found.select(F.explode(F.concat("base", "free")).alias("s")).select("s.*")
    edges = each.select("k", "value", F.explode(F.array("left", "both")).alias("pattern")).distinct()
    # A value known as a seed anywhere is no candidate elsewhere.
    wide = edges.groupBy("pattern").agg(F.approx_count_distinct("value").alias("n")).filter(
        F.col("n") >= SUPPORT - 1).select("pattern")
    return stored(edges.join(wide, "pattern"), "pattern-graph")


def believed(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(value, kind, belief): candidates that confident patterns mark as entities of a kind."""
    seeds = edges.filter("k >= 0").select("value", F.col("k").alias("kind"), F.lit(1.0).alias("belief"))
    sizes = edges.select("pattern", "value").distinct().groupBy("pattern").agg(
        F.count(F.lit(1)).alias("n"))
    free = edges.filter("k < 0").select("pattern", "value")
    known, new = seeds.distinct(), None
    ends = edges.select("pattern", "value").distinct()
    for _ in range(rounds):
        held = ends.join(known, "value").groupBy("pattern", "kind").agg(
            F.sum("belief").alias("mass"), F.count(F.lit(1)).alias("support"))
        confident = held.join(sizes, "pattern").filter(F.col("support") >= SUPPORT).select(
            "pattern", "kind", (F.col("mass") / (F.col("n") + 1)).alias("confidence")).filter(
            F.col("confidence") >= CONFIDENT)
        doubt = F.exp(F.sum(F.log(F.lit(1.0) - F.least("confidence", F.lit(0.999)))))
        new = stored(free.join(confident, "pattern").groupBy("value", "kind").agg(
            (F.lit(1.0) - doubt).alias("belief")).filter(F.col("belief") >= BELIEVED), "believed")
        known = seeds.distinct().union(new)
    return new.groupBy("value").agg(F.max_by("kind", F.struct("belief", -F.col("kind"))).alias("kind"))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["k"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added."""
    found = scan(docs)
    unseen = believed(graph(found))
    added = found.select("row", F.explode("free").alias("s")).select(
        "row", "s.start", "s.end", "s.value").join(unseen, "value").groupBy("row").agg(
        F.collect_list(F.struct("start", F.col("kind").alias("k"), "end")).alias("added"))
    plain = F.transform("base", lambda s: F.struct(s["start"], s["k"], s["end"]))
    none = F.array().cast("array<struct<start:int,k:int,end:int>>")
    rows = found.select("row", "doc_id", plain.cast("array<struct<start:int,k:int,end:int>>").alias("base"))
    rows = rows.join(added, "row", "left").withColumn(
        "added", F.coalesce(F.col("added").cast("array<struct<start:int,k:int,end:int>>"), none))
    rows = rows.withColumn("added", F.filter("added", lambda s: ~F.exists(
        "added", lambda o: (o["start"] <= s["start"]) & (s["end"] <= o["end"])
        & (o["end"] - o["start"] > s["end"] - s["start"]))))
    order = F.transform("base", lambda s: s["k"])
    counts = [(F.size(order) - F.size(F.array_remove(order, i))).cast("long").alias(f"n_{k}")
              for i, k in enumerate(KINDS)]
    return rows.select(
        "doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.sort_array(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("long").alias("n_added"))
