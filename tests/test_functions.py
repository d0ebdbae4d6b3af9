"""Scalar functions, one table of inputs at a time."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import csvcells, places, text, times, urls


def column(spark, expression, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in df.select("i", expression(F.col("v")).alias("o")).orderBy("i").collect()]


def test_normalize_url(spark):
    pairs = {
        "HTTPS://Villa.Example:443/Book/?utm_source=x&b=2&a=1#top": "https://villa.example/Book?a=1&b=2",
        "http://a.example:80": "http://a.example/",
        "http://a.example:8080/x//": "http://a.example:8080/x",
        "https://a.example/?ref=1&S=2&FBCLID=3": "https://a.example/",
        "https://a.example/p?k": "https://a.example/p?k=",
        " https://a.example/a/../b/./c ": "https://a.example/b/c",
        "https://a.example/é?q=a b": "https://a.example/%C3%A9?q=a+b",
        "https://bücher.example/": "https://xn--bcher-kva.example/",
        "https://a.example/p?x=1=2": "https://a.example/p?x=1%3D2",
        "ftp://a.example/x": None, "not a url": None, "": None, "mailto:a@b.example": None,
    }
    assert column(spark, urls.normalize_url, list(pairs)) == list(pairs.values())


def test_long_hostile_url_is_quick(spark):
    hostile = "https://a.example/" + "a" * 5000 + "/" * 500 + "{"
    assert column(spark, urls.normalize_url, [hostile]) == [hostile.rstrip("/").replace("{", "%7B")]


def test_parse_http_url_keeps_everything(spark):
    pairs = {
        "HTTP://A.Example:80/x/?ref=a#f": "http://a.example/x/?ref=a#f",
        "https://a.example": "https://a.example/", "ftp://a": None,
    }
    assert column(spark, urls.parse_http_url, list(pairs)) == list(pairs.values())


def test_listing_ids(spark):
    pairs = {
        "https://x.example/rooms/12345": "12345", "/rooms/plus/77?x=1": "77",
        "https://x.example/s?a=1&room_id=9": "9", "https://x.example/rooms/abc": None,
        "/rooms/12a": None, "": None,
    }
    assert column(spark, urls.listing_id_from_url, list(pairs)) == list(pairs.values())


def test_text_normalisation(spark):
    raw = ["  a \t b 　c﻿", "été", "", None]
    want = [None if v is None else " ".join(unicodedata.normalize("NFC", v).replace("﻿", " ").split())
            for v in raw]
    assert column(spark, text.normalize_text, raw) == want


def test_number_text(spark):
    assert column(spark, text.num_text, [3.0, 35000000.0, 4.92, -8.6478, 12345678.5, None], "double") == [
        "3", "35000000", "4.92", "-8.6478", "12345678.5", None]


def test_parsers(spark):
    assert column(spark, text.parse_decimal, ["4.5", " -3 ", "4.", "1e3", "x", None]) == [
        4.5, -3.0, None, None, None, None]
    assert column(spark, text.parse_number, ["1,234.5", "1 2", ""]) == [1234.5, None, None]
    assert column(spark, text.leading_number, ["4.9 stars", "+2", ".5x", "x1", "1e2z"]) == [
        4.9, 2.0, 0.5, None, 100.0]
    assert column(spark, text.leading_integer, ["-3.9", "7.9"]) == [-3, 7]
    assert column(spark, times.parse_timestamp, ["2026-07-18", "bad-date", "1998", "10:11"]) != [None] * 4


def test_coordinates_round_towards_plus_infinity(spark):
    assert column(spark, places.round_coordinate, [-8.6475, 8.6475, float("nan")], "double")[:2] == [
        -8.647, 8.648]


@pytest.mark.parametrize("raw, cell", [
    ("=1+1", "'=1+1"), ("-5", "'-5"), ('a"b', '"a""b"'), ("a,b", '"a,b"'), ("@x,y", '"\'@x,y"'),
    ("\tx", "'\tx"), ("plain", "plain"), (None, ""), ("two\nlines", '"two\nlines"')])
def test_csv_cells(spark, raw, cell):
    assert column(spark, csvcells.csv_cell, [raw]) == [cell]
