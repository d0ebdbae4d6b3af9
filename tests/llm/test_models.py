"""Language-model scores and language identification."""

import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from tidewatch.llm import language, maxent

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SYLLABLES = {"en": "th er on an ing re at", "de": "sch ein ung ver zu keit ö", "fr": "eau tion re é oi ai"}


def sentence(lang, rng, n):
    parts = SYLLABLES[lang].split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 2))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    rows = [(k, sentence(("en", "de", "fr")[k % 3], rng, rng.randint(5, 120))) for k in range(240)]
    return rows + [(300, None), (301, ""), (302, " \t"), (303, "Never-Seen words"), (303, "Never-Seen words"),
                   (None, "no id here"), (304, "word " * 30000)]


def test_base_scores_are_exact_and_the_model_gains(spark, texts):
    docs = spark.createDataFrame([(i, t, 1, 2.0) for i, t in texts], "doc_id long, text string, part int, score double")
    got = maxent.score(docs).collect()
    held = [i is not None and crc32(str(i).encode()) % 10 == 0 for i, _ in texts]
    split = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD)) + ["\n"] for _, t in texts]
    counts = Counter(w for out, ws in zip(held, split) if not out for w in ws)
    total, types = sum(counts.values()), len(counts)
    expected = sorted(
        ((-1 if i is None else i), out, len(ws), sum(1 for w in ws if counts[w]), total,
         round(sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (types + 1))) for w in ws), 5))
        for (i, _), out, ws in zip(texts, held, split))
    found = sorted(((-1 if r.doc_id is None else r.doc_id), r.held_out, r.n_tokens, r.n_known,
                    r.train_tokens, round(r.base_score, 5)) for r in got)
    assert found == expected
    judged = [r for r in got if r.held_out and r.n_tokens > 3]
    assert len(judged) > 10
    assert sum(r.score for r in judged) > sum(r.base_score for r in judged)
    assert all(r.score < 0 for r in got)


def test_empty_and_all_held_out(spark):
    docs = spark.createDataFrame([(k, "some text") for k in range(200) if crc32(str(k).encode()) % 10 == 0],
                                 "doc_id long, text string")
    assert all(r.train_tokens == 0 and r.held_out and r.n_known == 0 for r in maxent.score(docs).collect())
    assert maxent.score(docs.limit(0)).count() == 0


def test_class_probabilities_add_up():
    rng = np.random.default_rng(1)
    weights = rng.normal(size=(maxent.SLOTS, maxent.CLASSES)).astype(np.float32)
    slots = rng.integers(0, maxent.SLOTS, (50, maxent.FEATURES))
    out = np.exp(maxent._log_softmax(weights, np.zeros(maxent.CLASSES, np.float32), slots)).sum(1)
    assert np.allclose(out, 1, atol=1e-4)


def test_short_forms_of_the_softmax_agree():
    deal = np.random.default_rng(3)
    weights = deal.normal(size=(maxent.SLOTS, maxent.CLASSES)).astype(np.float32)
    slots = deal.integers(0, maxent.SLOTS, (200, maxent.FEATURES)).astype(np.uint16)
    bias, kinds = np.zeros(maxent.CLASSES, np.float32), deal.integers(0, maxent.CLASSES, 200)
    full = maxent._log_softmax(weights, bias, slots)
    assert np.allclose(maxent._minus_softmax(weights, bias, slots), -np.exp(full), atol=1e-6)
    assert np.allclose(maxent._log_softmax_at(weights, bias, slots, kinds), full[np.arange(200), kinds], atol=1e-5)


def test_features_do_not_look_over_a_start():
    one = np.array([(5 << 28) | (3 << 20), (7 << 28) | (4 << 20), (9 << 28)], np.int64)
    alone, _ = maxent._features([one])
    behind, _ = maxent._features([one + (1 << 28), one])
    assert (behind[3:] == alone).all()


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(3)
    rows = [(k, sentence(lang, rng, 40), lang, f"src{k % 4}", "junk") for k, lang in
            enumerate(["en", "de", "fr"] * 40)]
    rows += [(500, None, "en", "src0", ""), (501, "", None, None, ""), (502, "12 34 !!", "en", "src1", ""),
             (503, "x", None, "src0", ""), (503, "x", None, "src0", ""), (504, "einung " * 40000, None, None, "")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, host string")


def test_documents_keep_their_columns_and_clean_ones_stay(labelled):
    kept = language.identified(labelled)
    assert kept.columns == labelled.columns
    ids = [r.doc_id for r in kept.collect()]
    assert set(range(120)) | {504} <= set(ids) and not {500, 501, 502} & set(ids)
    assert language.identified(labelled.limit(0)).count() == 0


def test_pages_fuse_their_evidence(spark, labelled):
    languages, table = language.train(labelled)
    assert languages == ["de", "en", "fr"]
    rng = random.Random(5)
    rows = []
    for k in range(90):
        lang = ("en", "de", "fr")[k % 3]
        rows.append((k, f"https://www.{lang}{k % 5}.example.{lang}/a", f'<html lang="{lang}"><p>{sentence(lang, rng, 30)}</p>'))
    rows += [(100, "https://www.de0.example.de:80/b?x", "<html lang='DE-at'><script>the on an</script>77</html>"),
             (101, None, None), (102, "not a url", "<p>ungkeit einsch</p>"), (102, "not a url", "<p>ungkeit einsch</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    scored = language.score_text(language.page_evidence(pages), table)
    got = {r.page_id: r for r in language.fuse(scored, languages).collect()}
    assert all(got[k].lang == ("en", "de", "fr")[k % 3] and got[k].kept for k in range(90))
    # No letter in the text: told by markup, suffix and host, but not kept.
    assert got[100].lang == "de" and got[100].text_lang is None and not got[100].kept
    assert got[101].lang is not None and not got[101].kept
    assert got[102].lang == "de" and got[102].kept
    assert language.fuse(scored, []).filter("kept or lang is not null").count() == 0


def test_frequent_words_are_bounded(spark):
    counts = spark.createDataFrame([(f"w{k}".encode(), 1 + 100 // (k + 1)) for k in range(300)], "word binary, c long")
    got = [r.c for r in maxent.frequent(counts, 30).collect()]
    assert 20 < len(got) <= 30 and min(got) > max(c for c in (1 + 100 // (k + 1) for k in range(300)) if c not in got)
    assert maxent.frequent(counts, 5000).count() == 300
    assert maxent.frequent(counts.filter("c = 1"), 3).count() == 0
