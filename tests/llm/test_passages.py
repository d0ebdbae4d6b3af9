"""Passages of 48 and 51 words are found wherever they stand."""

import random

import pytest

from tidewatch.llm import substring_dedup

from .test_copies import frame


def prose(rng, n, least, most):
    """n words in sentences of least to most words; most = 0: no stops."""
    out, left = [], rng.randint(least, most) if most else 0
    for _ in range(n):
        out.append(f"w{rng.randint(0, 3000)}")
        left -= 1
        if most and left <= 0:
            out[-1] += "."
            left = rng.randint(least, most)
    return " ".join(out)


@pytest.mark.parametrize("size", [48, 51, 60])
@pytest.mark.parametrize("least, most", [(0, 0), (15, 24), (10, 24), (3, 9), (25, 60)])
def test_hosts_share_a_span_of_a_passage(size, least, most):
    rng = random.Random(size + most)
    for _ in range(400):
        passage = prose(rng, size, least, most)
        names = []
        for _ in range(2):
            host = " ".join([prose(rng, rng.randint(1, 40), least, most).rstrip("."), passage,
                             prose(rng, rng.randint(1, 40), least, most)])
            names.append({n for _, _, n in substring_dedup.spans(host)})
        assert names[0] & names[1]


def test_clauses_begin_often_and_spans_have_the_least_words():
    rng = random.Random(1)
    text = "  " + prose(rng, 500, 0, 0) + "\n  " + prose(rng, 300, 5, 40) + "  tail \x1c x"
    found, at, first = substring_dedup.begins(text)
    assert found == text.split() and at[-1] == len(text)
    assert first[0] == 0 and max(b - a for a, b in zip(first, first[1:])) <= 2 * substring_dedup.WINDOW
    made = substring_dedup.spans(text)
    assert made and all(len(text[a:b].split()) == substring_dedup.LEAST for a, b, _ in made)


def test_mid_sentence_passages_go(spark):
    rng = random.Random(6)
    rows = []
    for k in range(60):
        passage = prose(rng, 51, *((0, 0) if k % 2 else (15, 24)))
        for side in range(2):
            rows.append((2 * k + side, " ".join([prose(rng, 30, 0, 0), passage, prose(rng, 30, 0, 0)])))
    got = {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(frame(spark, rows)).collect()}
    assert all((got[i] > 0) == (i % 2 == 1) for i in got)
