"""Language-model scores from a hashed maximum-entropy model with class-factored softmax.

P(word | context) = P(class | context) P(word | class).  The class distribution is a
softmax over hashed features of the context: the last word, the last two, the word before
the last (a skip) and the last three classes.  Its weights are trained by distributed
gradient updates: in each round the tasks start from the same weights, take mini-batch
steps over their share of the training texts, and Spark averages the updates of each feature
weighted by its use; rounds divide the texts among them, so every training token is used.
Within its class a word has its smoothed corpus frequency.

Classes come from the corpus too.  The frequent words are grouped by the frequent words
around them, counted over all training texts, and each group is cut into bands of frequency;
rarer words take the group of frequent words that end alike.

Word counts are exact and stay in Spark.  The most frequent words, at most ``KNOWN``, are a
table in each worker; counts of all others are joined by word, after each text has
merged its own repeats.

Defined cases: null text is empty, and a text without words is its end alone; a null doc_id
is a training text; repeated rows count and are scored each; an empty table gives no rows;
ids whose training part is empty score with N = 0; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import arrow_fold, slices, small_batches, stored, whole_text

ADD = 0.1
KNOWN, CLUSTERED, ANCHORS, REACH = 1 << 18, 1 << 14, 64, 3
GROUPS, BANDS = 8, 3
CLASSES = GROUPS * BANDS + GROUPS
SLOTS, FEATURES = 1 << 16, 4
ROUNDS, STEP, MINI, SLICE = 2, 0.5, 4096, 1 << 17
TASK_TOKENS, HELD = 2_000_000, 300_000
END = b"\n"  # no word: white space never is

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def words(text: bytes) -> list[bytes]:
    """Lower-case words and the end."""
    return [*text.translate(_LOWER).split(), END]


def corpus(docs: DataFrame) -> DataFrame:
    """(doc_id, text, part): part is crc32 of the id modulo 10; 0 is held out."""
    return small_batches(docs).select(
        F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"),
        F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10, F.lit(1)).cast("int").alias("part"))


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    for part in slices(batch):
        yield from pc.cast(part.column("text"), pa.binary()).to_pylist()


def vocabulary(train: DataFrame) -> DataFrame:
    """(word, c): exact counts of training tokens."""

    def rows(found):
        return pa.RecordBatch.from_arrays(
            [pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.int64())],
            ["word", "c"])

    def body(batches):
        found: Counter[bytes] = Counter()
        for batch in batches:
            for text in _texts(batch):
                found.update(words(text))
            if len(found) > HELD:
                yield rows(found)
                found = Counter()
        yield rows(found)

    return stored(arrow_fold(train.select("text"), body, "word binary, c long").groupBy("word").agg(
        F.sum("c").alias("c")), "vocabulary")


@dataclass
class Lexicon:
    """What a worker knows of words.  All tables have fixed bounds."""

    place: dict[bytes, int]            # known word to its rank
    groups: np.ndarray                 # class of each known word
    endings: dict[bytes, int]          # group by last two and three bytes
    common: int = 0                    # group where no ending tells
    memo: dict[bytes, int] = field(default_factory=dict)

    def __getstate__(self):
        return {**self.__dict__, "memo": {}}

    def tail_group(self, word: bytes) -> int:
        return self.endings.get(word[-3:], self.endings.get(word[-2:], self.common))

    def _code(self, word: bytes) -> int:
        rank = self.place.get(word, -1)
        kind = int(self.groups[rank]) if rank >= 0 else GROUPS * BANDS + self.tail_group(word)
        return (crc32(word) << 28) | (kind << 20) | (rank + 1)

    def codes(self, text: bytes) -> tuple[list[bytes], np.ndarray]:
        """Words and their codes: hash, class and rank + 1 (0: not known) in one integer."""
        held = words(text)
        memo = self.memo
        if len(memo) > 300_000:
            memo.clear()
        found = list(map(memo.get, held))
        if None in found:
            for word in {w for w, c in zip(held, found) if c is None}:
                memo[word] = self._code(word)
            found = [memo[w] if c is None else c for w, c in zip(held, found)]
        return held, np.fromiter(found, np.int64, len(held))


RANK, KIND = (1 << 20) - 1, 255


def signatures(train: DataFrame, place: dict[bytes, int]) -> np.ndarray:
    """How often each of the clustered words stands near each anchor word."""
    sc = train.sparkSession.sparkContext
    near = sc.broadcast({w: r for w, r in place.items() if r < CLUSTERED})
    size = CLUSTERED * ANCHORS

    def body(batches):
        get = near.value.get
        total, apart = np.zeros(size, np.int64), [-1] * REACH
        held: list[int] = []

        def count():
            at, pairs = np.array(held, np.int64), []
            for d in range(1, REACH + 1):
                for a, b in ((at[d:], at[:-d]), (at[:-d], at[d:])):
                    good = (a >= 0) & (b >= 0) & (b < ANCHORS)
                    pairs.append(a[good] * ANCHORS + b[good])
            held.clear()
            return np.bincount(np.concatenate(pairs), minlength=size)

        for text in (text for batch in batches for text in _texts(batch)):
            held += [get(w, -1) for w in words(text)]
            held += apart
            if len(held) >= SLICE:
                total += count()
        total += count()
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(cell, pa.int64()), pa.array(total[cell], pa.int64())], ["cell", "n"])

    out = np.zeros(size)
    summed = arrow_fold(train.select("text"), body, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    for row in summed.toArrow().to_batches():  # at most CLUSTERED * ANCHORS cells
        out[row.column(0).to_numpy()] = row.column(1).to_numpy()
    return out.reshape(CLUSTERED, ANCHORS)


def group_words(near: np.ndarray, mass: np.ndarray, passes: int = 20) -> np.ndarray:
    """Group of each clustered word: k-means on square roots of neighbour shares."""
    points = np.sqrt(near / np.maximum(near.sum(1, keepdims=True), 1))
    weight = mass * (near.sum(1) > 0)
    centres = [points[int(np.argmax(weight))]]
    for _ in range(GROUPS - 1):
        far = np.min([((points - c) ** 2).sum(1) for c in centres], axis=0)
        centres.append(points[int(np.argmax(far * weight))])
    centres = np.array(centres)
    for _ in range(passes):
        groups = np.argmax(points @ centres.T - (centres ** 2).sum(1) / 2, axis=1)
        for g in range(GROUPS):
            w = weight * (groups == g)
            if w.sum() > 0:
                centres[g] = (points * w[:, None]).sum(0) / w.sum()
    return groups


def frequent(counts: DataFrame, known: int = KNOWN) -> DataFrame:
    """Words above a count that at most ``known`` words reach, found from a histogram of
    counts in eighths of powers of two: no task sorts or gathers the vocabulary."""
    level = F.floor(F.log2("c") * 8)
    least, held = 1 << 20, 0
    levels = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()
    for row in sorted(levels, reverse=True):  # at most 512 rows
        held += row.n
        if held > known:
            break
        least = row.level
    return counts.filter(level >= least)


def lexicon(train: DataFrame, counts: DataFrame) -> tuple[Lexicon, np.ndarray]:
    """The known words with their classes, and their counts by rank."""
    top = frequent(counts).toArrow()
    ranked = sorted(zip(top.column("c").to_pylist(), top.column("word").to_pylist()),
                    key=lambda x: (-x[0], x[1]))
    names, c = [bytes(w) for _, w in ranked], np.array([n for n, _ in ranked], float)
    place = {w: r for r, w in enumerate(names)}
    clustered = min(len(names), CLUSTERED)
    groups = np.zeros(len(names), np.int64)
    votes: dict[bytes, np.ndarray] = {}
    if clustered:
        found = group_words(signatures(train, place)[:clustered], c[:clustered])
        groups[:clustered] = found
        for word, g in zip(names[:clustered], found):
            for n in (2, 3):
                votes.setdefault(word[-n:], np.zeros(GROUPS))[g] += 1
    endings = {e: int(np.argmax(v)) for e, v in votes.items()}
    common = int(np.argmax(np.bincount(groups[:clustered], minlength=GROUPS))) if clustered else 0
    made = Lexicon(place, groups, endings, common)
    for r in range(clustered, len(names)):
        groups[r] = made.tail_group(names[r])
    kinds = np.zeros(len(names), np.int64)
    for g in range(GROUPS):  # bands of equal mass; ranks are in order of frequency
        at = np.flatnonzero(groups == g)
        if len(at):
            share = (np.cumsum(c[at]) - c[at]) / c[at].sum()
            kinds[at] = g * BANDS + np.minimum((share * BANDS).astype(int), BANDS - 1)
    made.groups = kinds
    return made, c


def class_mass(counts: DataFrame, lex: Lexicon, c: np.ndarray, total: int, types: int) -> np.ndarray:
    """log10 of the smoothed frequency of each class, all words counted.  Each class of
    rarer words also holds one unseen word."""
    sc = counts.sparkSession.sparkContext
    held = sc.broadcast(lex)

    def body(batches):
        lex = held.value
        sums = np.zeros((GROUPS, 2))
        for batch in batches:
            for word, n in zip(batch.column("word").to_pylist(), batch.column("c").to_pylist()):
                if word not in lex.place:
                    sums[lex.tail_group(word)] += (n, 1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(GROUPS), pa.int32()), pa.array(sums[:, 0], pa.float64()),
             pa.array(sums[:, 1], pa.float64())], ["g", "n", "v"])

    mass = np.zeros(CLASSES)
    np.add.at(mass, lex.groups, c + ADD)
    mass[GROUPS * BANDS:] += ADD
    rows = arrow_fold(counts, body, "g int, n double, v double").groupBy("g").agg(F.sum("n"), F.sum("v"))
    for g, n, v in rows.collect():  # GROUPS rows
        mass[GROUPS * BANDS + g] += n + ADD * v
    return np.log10(np.maximum(mass, ADD) / (total + ADD * (types + GROUPS)))


def _features(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(feature slots, classes) of the tokens of several texts, none looking over a start."""
    pad = np.zeros(3, np.int64)
    line = np.concatenate([x for p in parts for x in (pad, p)])
    real = np.concatenate([x for p in parts for x in (np.zeros(3, bool), np.ones(len(p), bool))])
    at = np.flatnonzero(real)
    word, kind = (line >> 28).astype(np.uint64), ((line >> 20) & KIND).astype(np.uint64)
    w1, w2 = word[at - 1], word[at - 2]
    prime = np.uint64(0x9E3779B97F4A7C15)

    def slot(x, salt):
        # SLOTS is 2**16; integers of 16 bits also sort fastest.
        return (((x + np.uint64(salt)) * prime) >> np.uint64(48)).astype(np.uint16)

    history = (kind[at - 1] << np.uint64(16)) | (kind[at - 2] << np.uint64(8)) | kind[at - 3]
    return np.stack([slot(w1, 1 << 40), slot(w1 * np.uint64(31) + w2, 2 << 40), slot(w2, 3 << 40),
                     slot(history, 4 << 40)], axis=1), kind[at].astype(np.int64)


def _scores(weights: np.ndarray, bias: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Scores of the classes, the greatest of each row taken off."""
    scores = np.take(weights, slots[:, 0], axis=0)
    scores += bias
    for k in range(1, FEATURES):
        scores += np.take(weights, slots[:, k], axis=0)
    scores -= scores.max(axis=1, keepdims=True)
    return scores


def _log_softmax(weights: np.ndarray, bias: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """All classes; the rounds and the scores use the two shorter forms below."""
    scores = _scores(weights, bias, slots)
    return scores - np.log(np.exp(scores).sum(axis=1, keepdims=True))


def _minus_softmax(weights: np.ndarray, bias: np.ndarray, slots: np.ndarray) -> np.ndarray:
    shares = _scores(weights, bias, slots)
    np.exp(shares, out=shares)
    shares /= -shares.sum(axis=1, keepdims=True)
    return shares


def _log_softmax_at(weights: np.ndarray, bias: np.ndarray, slots: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    scores = _scores(weights, bias, slots)
    chosen = scores[np.arange(len(kinds)), kinds]
    np.exp(scores, out=scores)
    return chosen - np.log(scores.sum(axis=1))


def _sliced(lex: Lexicon, texts: Iterable[bytes]):
    """Groups of (words, codes) of whole texts, each with about SLICE tokens."""
    held, size = [], 0
    for text in texts:
        held.append(lex.codes(text))
        size += len(held[-1][1])
        if size >= SLICE:
            yield held
            held, size = [], 0
    if held:
        yield held


def round_of_updates(train: DataFrame, lex, weights: np.ndarray, bias: np.ndarray, tasks: int):
    """One round: tasks step from the given weights, Spark averages what they changed.

    A task sends a row for every slot it has used, so tiny partitions are put together
    until ``tasks`` are left, about TASK_TOKENS tokens each.
    """
    sc = train.sparkSession.sparkContext
    given = sc.broadcast((weights, bias))
    names = [f"d{k}" for k in range(CLASSES)]

    def run(batches):
        w0, bias = given.value
        w, used = w0.copy(), np.zeros(SLOTS)
        for batch in batches:
            for held in _sliced(lex.value, _texts(batch)):
                slots, kinds = _features([codes for _, codes in held])
                for i in range(0, len(kinds), MINI):
                    s, y = slots[i:i + MINI], kinds[i:i + MINI]
                    grad = _minus_softmax(w, bias, s)
                    grad[np.arange(len(y)), y] += 1
                    for k in range(FEATURES):
                        order = np.argsort(s[:, k], kind="stable")
                        f = s[order, k]
                        first = np.flatnonzero(np.concatenate(([True], f[1:] != f[:-1])))
                        rows, n = f[first], np.diff(np.append(first, len(f)))
                        used[rows] += n
                        step = np.add.reduceat(np.take(grad, order, axis=0), first, axis=0)
                        rate = (STEP / np.sqrt((1 + used[rows]) * n)).astype(np.float32)
                        w[rows] += rate[:, None] * step
        at = np.flatnonzero(used)
        delta = (w[at] - w0[at]) * used[at, None]
        yield pa.RecordBatch.from_arrays(
            [pa.array(at, pa.int32()), pa.array(used[at], pa.float64()),
             *[pa.array(delta[:, k].astype(np.float32), pa.float32()) for k in range(CLASSES)]],
            ["slot", "n", *names])

    schema = "slot int, n double, " + ", ".join(f"{x} float" for x in names)
    moved = train.select("text").coalesce(tasks).mapInArrow(run, schema).groupBy("slot").agg(
        F.sum("n").alias("n"), *[F.sum(x).cast("float").alias(x) for x in names])
    out = weights.copy()
    for batch in moved.toArrow().to_batches():  # at most SLOTS rows
        n = batch.column("n").to_numpy()[:, None]
        delta = np.column_stack([batch.column(x).to_numpy() for x in names])
        out[batch.column("slot").to_numpy()] += (delta / n).astype(np.float32)
    return out


def score(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    texts = corpus(docs)
    train = texts.filter("part <> 0")
    counts = vocabulary(train)
    total, types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    lex, c = lexicon(train, counts)
    mass = class_mass(counts, lex, c, total, types)
    held = spark.sparkContext.broadcast(lex)
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // TASK_TOKENS))
    weights, bias = np.zeros((SLOTS, CLASSES), np.float32), (mass * math.log(10)).astype(np.float32)
    for r in range(ROUNDS):
        weights = round_of_updates(
            train.filter((F.col("part") % ROUNDS) == r), held, weights, bias, tasks)
    model = spark.sparkContext.broadcast((weights, bias))
    floor = math.log10(total + ADD * (types + 1))
    base = np.concatenate(([0.0], np.log10(c + ADD) - floor))  # by rank + 1; rarer words come later

    def run(batches):
        weights, bias = model.value
        row = TaskContext.get().partitionId() << 33
        names = ["row", "doc_id", "part", "n_tokens", "n_known", "base", "model", "words", "times"]
        for batch in batches:
            ids, parts = batch.column("doc_id").to_pylist(), batch.column("part").to_pylist()
            done = 0
            for group in _sliced(held.value, _texts(batch)):
                slots, kinds = _features([codes for _, codes in group])
                chosen = np.empty(len(kinds))
                for i in range(0, len(kinds), MINI):
                    y = kinds[i:i + MINI]
                    chosen[i:i + MINI] = _log_softmax_at(weights, bias, slots[i:i + MINI], y)
                each = chosen / math.log(10) - mass[kinds]
                columns = [[] for _ in names]
                at = 0
                for words_, codes in group:
                    ranks = codes & RANK
                    rare = Counter(words_[j] for j in np.flatnonzero(ranks == 0))
                    known = float(base[ranks].sum())
                    values = (row, ids[done], parts[done], len(codes), int((ranks > 0).sum()), known,
                              known + float(each[at:at + len(codes)].sum()), list(rare), list(rare.values()))
                    for column, value in zip(columns, values):
                        column.append(value)
                    at += len(codes)
                    row += 1
                    done += 1
                kinds_ = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(),
                          pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(columns, kinds_)], names)

    scored = stored(texts.mapInArrow(
        run, "row long, doc_id long, part int, n_tokens long, n_known long, base double, "
             "model double, words array<binary>, times array<long>"), "scored")
    rare = scored.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select(
        "row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    tail = rare.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.col("times") * (F.log10(F.coalesce("c", F.lit(0)) + F.lit(ADD)) - F.lit(floor))).alias("rare"),
        F.sum(F.when(F.col("c").isNotNull(), F.col("times"))).alias("rare_known"))
    rest = F.coalesce("rare", F.lit(0.0))
    return scored.drop("words", "times").join(tail, "row", "left").select(
        "doc_id", (F.col("part") == 0).alias("held_out"), "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + rest).alias("base_score"), (F.col("model") + rest).alias("score"))
