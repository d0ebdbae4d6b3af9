"""Exact, near and substring de-duplication against brute force on small tables."""

import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash

from tidewatch.llm import components, exact_dedup, simhash, substring_dedup

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", True) for i, t in rows],
                                 "doc_id long, text string, keep_id string, kept boolean")


def words(n, seed):
    return " ".join(f"w{zlib.crc32(f'{seed}:{k}'.encode()) % 5000}" for k in range(n))


LONG = words(9000, "long")
ROWS = [(5, "a  b\tc"), (3, "a b c"), (9, "a b c "), (2, None), (1, ""), (7, LONG), (6, LONG + " end"),
        (4, LONG.replace(" ", "\n")), (8, " a b c"), (8, " a b c"), (None, "a b c"), (11, "\x0b"), (10, " ")]


def expected_groups(rows):
    normal = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows]
    out = []
    for i, t in normal:
        ids = [j for j, u in normal if u == t]
        keep = min((j for j in ids if j is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_exact_groups(spark):
    got = exact_dedup.deduplicate(frame(spark, ROWS))
    assert sorted(map(tuple, got.collect()), key=repr) == expected_groups(ROWS)


def test_names_that_collide_are_made_anew(spark):
    tried = []

    def weak(chunk, seed):  # one byte a name at first
        return xxhash.xxh3_128_digest(chunk, seed=seed)[: 1 if seed < 2 else 16]

    texts = exact_dedup._normal(frame(spark, ROWS + [(100 + k, words(800, k)) for k in range(300)]))
    for seed in range(3):
        tried.append(exact_dedup.is_verified(texts, seed, weak))
    assert tried == [False, False, True]


def test_exact_empty(spark):
    assert exact_dedup.deduplicate(frame(spark, [])).count() == 0


def test_cuts_depend_on_content_only():
    data = words(20000, "cut").encode()
    moved = b"some other opening. " + data
    ends = {len(data) - e for e in exact_dedup.cuts(data)}
    others = {len(moved) - e for e in exact_dedup.cuts(moved)}
    assert len(ends & others) > 0.9 * len(ends)
    assert max(np.diff([0, *exact_dedup.cuts(b"a" * 300_000)])) <= exact_dedup.LONGEST


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 3]).encode(), seed=42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(values):
    """Least id reachable from each fingerprint over links of two or fewer bits."""
    label = dict(values)
    changed = True
    while changed:
        changed = False
        for a in values:
            for b in values:
                if bin(a ^ b).count("1") <= 2 and label[b] < label[a]:
                    label[a], changed = label[b], True
    return label


def test_fingerprints_and_components(spark):
    base = words(300, "near").split()
    rows = [(i, t) for i, t in ROWS if i is not None]
    for k in range(40):
        changed = list(base)
        changed[k] = "X"
        rows.append((50 + k, " ".join(changed)))
    rows += [(200, "One"), (201, "one two"), (202, "one TWO three")]
    got = {r.doc_id: r for r in simhash.near_duplicates(frame(spark, rows)).collect()}
    fps = {}
    for i, t in sorted(rows):
        fps.setdefault(plain_fingerprint(t), i)
    label = plain_components(fps)
    for i, t in rows:
        assert got[i].fingerprint == f"{plain_fingerprint(t):016x}"
        assert got[i].component_id == label[plain_fingerprint(t)]


@pytest.mark.parametrize("crowd", [0, 3, 65])
def test_links_lose_nothing_however_crowded(spark, crowd):
    rng = np.random.default_rng(3)
    values = set(rng.integers(0, 1 << 64, 60, dtype=np.uint64).tolist())
    for centre in list(values)[:6]:
        for _ in range(25):  # dense families
            bits = rng.choice(64, rng.integers(1, 3), replace=False)
            values.add(int(np.uint64(centre) ^ np.bitwise_or.reduce(np.uint64(1) << bits.astype(np.uint64))))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    groups, radii = simhash.plan(fps)
    assert sum(radii) == simhash.REACH - len(groups) + 1
    found = {r.node: r.component for r in components.components(
        simhash.links(fps, groups, radii, crowd)).collect()}
    mask = (1 << 64) - 1
    label = plain_components({v & mask: v for v in signed})
    for v in signed:
        assert found.get(v, v) == label[v & mask]


@pytest.mark.parametrize("radii_of", [1, 2, 3])
def test_every_number_of_groups_is_complete(spark, radii_of):
    groups = [list(range(g, 64, radii_of)) for g in range(radii_of)]
    _, radii = simhash.allocate([len(g) for g in groups], [[1.0, 5.0, 9.0]] * radii_of)
    values = [0, 3, 1 << 40, (1 << 40) | 1, 0xFF << 20, (0xFF << 20) ^ (1 << 63) ^ 1, -1, -2]
    signed = [v - (1 << 64) if v >> 63 == 1 else v for v in values]
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    found = {r.node: r.component for r in components.components(simhash.links(fps, groups, radii)).collect()}
    mask = (1 << 64) - 1
    label = plain_components({v & mask: v for v in signed})
    assert all(found.get(v, v) == label[v & mask] for v in signed)


def test_near_empty(spark):
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(None, 4), (7, 7)], "u long, v long")
    found = {r.node: r.component for r in components.components(edges).collect()}
    assert found == {k: 0 for k in range(61)}


def word_windows(key, size):
    """(words, begin, end) of every run of ``size`` words; an end is where the next word begins."""
    found = list(re.finditer(r"\S+", key[1]))
    ends = [m.start() for m in found[1:]] + [len(key[1])]
    return [(tuple(m.group() for m in found[i:i + size]), found[i].start(), ends[i + size - 1])
            for i in range(len(found) - size + 1)]


def plain_bounds(rows):
    """By (doc_id, text): characters that may go, as a run of LEAST words that stands elsewhere
    before holds them, and runs of WINDOW + LEAST words of which something must go."""
    least, sure = substring_dedup.LEAST, substring_dedup.LEAST + substring_dedup.WINDOW
    texts = sorted({(-1 if i is None else i, t or "") for i, t in rows})
    may, must, seen = {k: set() for k in texts}, {k: [] for k in texts}, {least: {}, sure: {}}
    for key in texts:
        for size in (least, sure):
            for name, begin, end in word_windows(key, size):
                if seen[size].setdefault(name, (key, begin)) != (key, begin):
                    if size == least:
                        may[key].update(range(begin, end))
                    else:
                        must[key].append((begin, end))
    return may, must


PASSAGE = words(14, "p1") + ". " + words(12, "p2") + ". " + words(16, "p3") + "! " + words(13, "p4") + "."


def test_repeated_passages_go_and_clean_texts_stay(spark):
    rows = [(1, words(20, 1) + ". " + PASSAGE + " " + words(30, 2) + ". " + words(8, 3)),
            (2, words(9, 4) + " " + PASSAGE + " " + words(20, 5) + "."),
            (3, words(60, 6)), (4, words(10, 7) + ". Of. The. " + words(9, 8)), (5, "Of. The."),
            (6, None), (7, ""), (8, words(300, 9) + " " + words(120, "run") + " " + words(100, 10)),
            (9, words(200, 11) + " " + words(120, "run") + " " + words(80, 12)), (10, words(25, 13) + "."),
            (10, words(25, 13) + "."), (None, "x" * 5000)]
    got = substring_dedup.remove_repeats(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    may, must = plain_bounds(rows)
    by_id = {}
    for r in got:
        key = next(k for k in may if k[0] == (-1 if r.doc_id is None else r.doc_id))
        holes = [tuple(map(int, h.split(":"))) for h in r.removed.split(",") if h]
        gone = {c for a, b in holes for c in range(a, b)}
        assert gone <= may[key] and (r.n_removed > 0) == bool(gone)
        assert all(gone & set(range(a, b)) for a, b in must[key])
        assert r.clean_text == "".join(c for k, c in enumerate(key[1]) if k not in gone)
        by_id[r.doc_id] = r
    assert words(12, "p2") in by_id[1].clean_text and words(12, "p2") not in by_id[2].clean_text
    assert by_id[9].n_removed > 0 and by_id[8].n_removed == 0  # no stops at all
    assert all(by_id[k].n_removed == 0 for k in (1, 3, 4, 5, 6, 7, 10))
    assert substring_dedup.remove_repeats(frame(spark, [])).count() == 0


def test_no_run_below_the_least_goes(spark):
    shared = words(substring_dedup.LEAST - 1, "s")
    rows = [(k, words(60, k) + ". " + shared + ". " + words(60, k + 10)) for k in range(5)]
    assert all(r.n_removed == 0 for r in substring_dedup.remove_repeats(frame(spark, rows)).collect())
