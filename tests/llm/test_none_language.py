"""Texts in none of the known languages are not kept."""

import base64
import random

from tidewatch.llm import language

from .test_models import sentence

FOREIGN = [
    "Москва является столицей России и крупнейшим по численности населения городом страны",
    "Polska jest państwem położonym w Europie Środkowej nad Morzem Bałtyckim, w dorzeczu Wisły i Odry",
    "北京是中华人民共和国的首都，是全国的政治中心和文化中心",
]


def corpus():
    rng = random.Random(3)
    rows = [(k, sentence(lang, rng, 60), lang, f"src{k % 4}") for k, lang in enumerate(["en", "de", "fr"] * 60)]
    letters = "abcdefghijklmnopqrstuvwxyz"
    junk = ["".join(rng.choice(letters) for _ in range(200)),
            " ".join("".join(rng.choice(letters) for _ in range(7)) for _ in range(30)),
            base64.b64encode(rng.randbytes(300)).decode()]
    rows += [(500 + k, t, None, "src0") for k, t in enumerate(FOREIGN + junk)]
    return rows + [(600, "ing.", None, "src0"), (601, "The on re", None, "src1"), (602, "Schung", None, "src2"),
                   (603, "Eau oi", None, "src3")]


def test_foreign_and_random_texts_are_rejected_and_short_ones_stay(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string")
    ids = {r.doc_id for r in language.identified(docs).collect()}
    assert ids == set(range(180)) | {600, 601, 602, 603}


def test_rejected_pages_have_no_language(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string")
    languages, table = language.train(docs)
    rng = random.Random(8)
    rows = [(k, f"https://a.example.{lang}/x", f"<html lang='{lang}'><p>{sentence(lang, rng, 30)}</p>")
            for k, lang in enumerate(["en", "de", "fr"] * 10)]
    rows += [(100 + k, "https://b.example.de/x", f"<html lang='de'><p>{t}</p>") for k, t in enumerate(FOREIGN)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in language.fuse(
        language.score_text(language.page_evidence(pages), table), languages).collect()}
    assert all(got[k].kept and got[k].lang == ("en", "de", "fr")[k % 3] for k in range(30))
    assert all(not got[100 + k].kept and got[100 + k].lang is None and got[100 + k].text_lang is None
               and got[100 + k].confidence < 0.5 for k in range(3))
