"""Ranked search, line de-duplication and whitening against brute force on small tables."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tidewatch.llm import line_dedup, ranked_search, whitening

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


# --- ranked search ---------------------------------------------------------------

def terms(text):
    return [t.translate(FOLD) for t in TERM.findall(text or "")]


def plain_ranking(docs, items, top=10):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, length = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in dict.fromkeys(items):
        scores = []
        for i, bag in bags:
            n, score = sum(bag.values()), 0
            for t in terms(text):
                if bag[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * ((1000000000 * bag[t]) // (1000 * bag[t] + 8 * (25 + 75 * n * n_docs // length)))
            if score > 0:
                scores.append((-score, i is None, i))
        scores.sort(key=lambda s: (s[0], s[1], s[2] or 0))
        out += [(item, k + 1, i, -s) for k, (s, _, i) in enumerate(scores[:top])]
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(60)] + ["the", "Ñandú", "É", "一", "o'clock", "x9"]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    docs = [(k, " ".join(rng.choices(vocabulary, weights, k=rng.randint(1, 40)))) for k in range(400)]
    docs += [(1000, None), (1001, ""), (1002, "...!"), (None, "w1 w2 w59"), (7, "w1 w2 w59"), (7, "w1 w2 w59"),
             (8, "the " * 30000 + "W59"), (9, "É é W3w\x00w4")]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(1, 12)))) for k in range(30)]
    items += [(50, None), (51, "unheard of"), (52, "the THE the"), (None, "w1 w2 w59"), (53, "w3 é"), (53, "w3 é"),
              (54, "w0 the")]
    return docs, items


def frame(spark, rows, key, **more):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows],
                                 f"{key} long, text string, score int, rank string")


@pytest.mark.parametrize("block_terms", [100, 200_000])
def test_ranking(spark, block_terms):
    docs, items = corpus()
    got = ranked_search.rank(frame(spark, docs, "doc_id").repartition(5), frame(spark, items, "item_id"),
                             block_terms=block_terms)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_ranking(docs, items)


def test_ranking_without_rows(spark):
    docs, items = corpus()
    for d, i in (([], items), (docs, []), ([(1, None)], items)):
        assert ranked_search.rank(frame(spark, d, "doc_id"), frame(spark, i, "item_id")).count() == 0


def test_skipping_scores_few_and_finds_all():
    """In many documents, most are never scored in full, and the best are those of scoring all."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    rows, often, rare = 60_000, 4, 2
    lists = [np.flatnonzero(rng.random(rows) < 0.4) for _ in range(often)]
    lists += [np.sort(rng.choice(rows, 200, replace=False)) for _ in range(rare)]
    held = [[] for _ in range(rows)]
    for term, docs in enumerate(lists):
        for doc in docs.tolist():
            held[doc].append(term)
    tf = [rng.integers(1, 5, len(h)).tolist() for h in held]
    n = rng.integers(5, 50, rows)
    batch = pa.RecordBatch.from_arrays(
        [pa.array(np.arange(rows)), pa.array(n), pa.array(held, pa.list_(pa.int32())),
         pa.array(tf, pa.list_(pa.int64()))], ["doc_id", "n", "terms", "counts"])
    df = np.array([len(docs) for docs in lists])
    weights = np.floor(1000 * np.log((2 * rows + 2) / (2 * df + 1))).astype(np.int64)
    facts = ranked_search.Statistics(rows, int(n.sum()), weights, df <= rows / 16)
    assert facts.short.tolist() == [False] * often + [True] * rare
    segment = ranked_search.Segment(batch, facts)
    query = ranked_search.Query(0, tuple((t, 1) for t in range(often + rare)))
    best = ranked_search.Best()
    scored = ranked_search.search(segment, query, facts.short, best)
    total = np.zeros(rows, np.int64)
    for t in range(often + rare):
        docs, adds = segment.list_of(t, 1)
        total[docs] += adds
    expected = sorted(((s, True, -d) for d, s in enumerate(total.tolist())), reverse=True)[:10]
    assert sorted(best.heap, reverse=True) == expected
    assert scored < rows / 50


# --- lines ------------------------------------------------------------------

def plain_lines(docs, min_docs):
    keys = [[line.strip(" \t\n\x0b\x0c\r").translate(FOLD) for line in (t or "").split("\n")] for _, t in docs]
    df = Counter(k for some in keys for k in set(some))
    out = []
    for (i, t), some in zip(docs, keys):
        lines = (t or "").split("\n")
        stay = "\n".join(line for line, k in zip(lines, some) if not k or df[k] < min_docs)
        gone = sum(bool(k) and df[k] >= min_docs for k in some)
        out.append((i, len(lines), gone, hashlib.sha256(stay.encode()).hexdigest(), stay))
    return sorted(out, key=repr)


def line_corpus():
    rng = random.Random(5)
    shared = [f"Shared line {k}" for k in range(40)]
    docs = []
    for k in range(300):
        lines = [f"own {k} {j}" for j in range(rng.randint(0, 6))]
        lines += [rng.choice(["", " ", "\t", "  "]) + rng.choice(shared) + rng.choice(["", "\r", " "])
                  for _ in range(rng.randint(0, 5))]
        rng.shuffle(lines)
        docs.append((k, "\n".join(lines)))
    docs += [(500 + k, f"EVERYWHERE\nq{k}\n\n \nÉcole") for k in range(150)]
    docs += [(None, "everywhere"), (None, None), (1, ""), (1, "\n\n"), (2, "\x0b everywhere \x0c"),
             (2, "\x0b everywhere \x0c"), (3, "a b\nécole"), (4, "long\n" * 30000 + "everywhere"),
             (5, " everywhere")]
    return docs


@pytest.mark.parametrize("broadcast_bytes, shard_keys", [(1 << 20, 1 << 18), (1 << 20, 7), (-1, 7), (-1, 1 << 18)])
def test_lines(spark, monkeypatch, broadcast_bytes, shard_keys):
    monkeypatch.setattr(line_dedup, "CELL_PROBES", 50)
    docs = line_corpus()
    table = spark.createDataFrame([(i, t, 1, True) for i, t in docs],
                                  "doc_id long, text string, often int, shard boolean").repartition(4)
    for min_docs in (2, 10):
        got = line_dedup.drop_frequent_lines(table, min_docs, True, broadcast_bytes, shard_keys)
        assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256", "kept_text"]
        assert sorted(map(tuple, got.collect()), key=repr) == plain_lines(docs, min_docs)


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, -1])
def test_lines_without_rows(spark, broadcast_bytes):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.drop_frequent_lines(empty, broadcast_bytes=broadcast_bytes).count() == 0
    none = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert [tuple(r)[:3] for r in line_dedup.drop_frequent_lines(
        none, broadcast_bytes=broadcast_bytes).collect()] == [(1, 1, 0)]


@pytest.mark.parametrize("size", [0, 1, 2, 1000, 50_000])
def test_hash_is_minimal_and_perfect(size):
    rng = np.random.default_rng(size)
    high, low = (rng.integers(0, 2**63, size, dtype=np.uint64) for _ in range(2))
    high[: size // 2] = 5  # halves alone need not differ
    counts = rng.integers(1, 100, size)
    shard = line_dedup.Shard.build(high, low, counts)
    assert sorted(shard.places(high, low).tolist()) == list(range(size))
    assert shard.probe(high, low).tolist() == counts.tolist()
    copy = line_dedup.Shard.from_row(*shard.row())
    assert copy.probe(high, low).tolist() == counts.tolist()
    assert not copy.probe(high, low ^ np.uint64(1 << 40)).any()
    if size == 50_000:
        assert 8 * len(shard.words) * 8 / size < 5  # bits per hash without fingerprint and count


# --- vectors ----------------------------------------------------------------

def plain_whitening(rows, components=4):
    good = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows
            if v and all(c is not None and math.isfinite(c) for c in v)]
    size = Counter(len(x) for _, x in good).most_common(1)[0][0]
    good = [(i, x) for i, x in good if len(x) == size]
    fit = np.array(sorted({tuple(x) for _, x in good}), float)
    centred = fit - fit.mean(axis=0)
    values, vectors = np.linalg.eigh(centred.T @ centred / len(fit))
    return good, fit, values[::-1][:components], vectors[:, ::-1][:, :components]


def vector_rows():
    rng = np.random.default_rng(8)
    mix = rng.standard_normal((6, 6))
    rows = [(k, (rng.standard_normal(6) @ mix).astype(np.float32).tolist()) for k in range(500)]
    rows += [(600 + k, rows[3][1]) for k in range(300)]
    rows += [(900, None), (901, []), (902, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (903, [float("nan")] + [0.0] * 5),
             (904, [float("inf")] + [0.0] * 5), (905, [1.0, 2.0]), (None, rows[5][1]), (4, rows[6][1])]
    return rows


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows],
                                 "vec_id long, embedding array<float>, n string, component int")


def test_whitening(spark):
    rows = vector_rows()
    got = whitening.whiten(vectors(spark, rows).repartition(4)).collect()
    good, fit, values, basis = plain_whitening(rows)
    n, sums = len(fit), [int(s) for s in fit.sum(axis=0)]
    assert len(got) == 4 * len(good) and {r.n for r in got} == {n}
    exact = Counter((i, sum((n * e - s) ** 2 for e, s in zip(x, sums))) for i, x in good)
    for component in range(1, 5):
        mine = [r for r in got if r.component == component]
        assert Counter((r.vec_id, r.deviation) for r in mine) == exact
        white = {(i, tuple(x)): (np.array(x) - fit.mean(axis=0)) @ basis[:, component - 1]
                 / math.sqrt(values[component - 1]) for i, x in good}
        for sign in (1, -1):
            expected = sorted((i if i is not None else -1, round(sign * w, 8) + 0.0) for (i, _), w in white.items())
            found = sorted({(r.vec_id if r.vec_id is not None else -1, round(r.whitened, 8) + 0.0) for r in mine})
            if np.allclose(np.array(expected), np.array(found), atol=2e-8):
                break
        else:
            raise AssertionError(component)
        total = np.var(fit, axis=0).sum()
        assert {r.explained for r in mine} == {mine[0].explained}
        assert mine[0].explained == pytest.approx(values[component - 1] / total, rel=1e-9)
    assert len({r.identity_error for r in got}) == 1 and 0 <= got[0].identity_error < 1e-9


def test_whitening_without_variance(spark):
    for rows in ([], [(1, [1.0, 2.0])], [(1, [0.5, 2.0]), (2, [0.5, 2.0])], [(1, None)]):
        assert whitening.whiten(vectors(spark, rows)).count() == 0
    got = whitening.whiten(vectors(spark, [(1, [1.0, 0.0]), (2, [-1.0, 0.0])])).collect()
    assert sorted((r.vec_id, r.component, abs(round(r.whitened, 9))) for r in got) == [(1, 1, 1.0), (2, 1, 1.0)]


def test_deviation_beyond_64_bits():
    x = np.array([[1, 2], [10**6, 0]])
    assert whitening.exact_deviation(x, 10, [5, 5]) == [5**2 + 15**2, (10**7 - 5)**2 + 25]
    assert whitening.exact_deviation(x, 10**5, [0, 0]) == [5 * 10**10, None]


@pytest.mark.parametrize("spectrum", [
    np.arange(1, 41) * 10.0, np.ones(12), np.zeros(5), np.r_[np.ones(30), 2.0], 10.0 ** -np.arange(30),
    np.r_[5.0, 5.0, 5.0, np.zeros(9)], 1 + 1e-9 * np.arange(20)])
@pytest.mark.parametrize("turned", [True, False])
def test_components_of_spectra(spectrum, turned):
    d = len(spectrum)
    q = np.linalg.qr(np.random.default_rng(d).standard_normal((d, d)))[0] if turned else np.eye(d)
    v = (q * spectrum) @ q.T
    v = (v + v.T) / 2
    for wanted in (None, 4):
        values, basis = whitening.spectral_components(v, wanted)
        size = max(np.abs(spectrum).max(), 1e-300)
        assert len(values) == min(wanted or d, d)
        assert np.allclose(values, np.sort(spectrum)[::-1][:len(values)], atol=1e-13 * size, rtol=0)
        assert np.abs(v @ basis - basis * values).max() <= 1e-13 * size
        assert np.abs(basis.T @ basis - np.eye(len(values))).max() < 1e-13
