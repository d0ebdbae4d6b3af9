"""Listing pages: page state, search cards, detail records and listing links.

Everything is regular expressions over the html column, so pages parse in the JVM
and in parallel; Python never sees a page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.constants import MANUAL_ACTION_REASONS, PAGE_STATES
from tidewatch.functions import text as tx
from tidewatch.functions.urls import (
    ROOM, ROOM_PARAMETER, listing_id_from_url, normalize_listing_id,
)

# The markup contract and the phrases that give a page state away,
# tried in this order.
STATE_META, ID_META, URL_META = "page-state", "listing-id", "canonical-url"
STATE_PHRASES = (
    ("captcha", ("unusual traffic", "verify you(?:'|&#39;)?re a human", "are you a robot",
                 "solve the captcha")),
    ("account_verification",
     ("confirm your account", "verify your account", "account verification")),
    ("login_challenge",
     ("log in or sign up", "please log in", "login required", "sign in to continue")),
    ("access_denied",
     ("access denied", "403 forbidden", "you don(?:'|&#39;)?t have permission")),
    ("blocked", ("temporarily blocked", "too many requests", "rate limit", "429")),
    ("no_results", ("no exact matches", "no results found", "0 results")),
)
CARD = r'(?i)<article\b[^>]*\bdata-testid="listing-card"[^>]*>[\s\S]*?</article>'
DETAIL = r'(?i)<main\b([^>]*\bdata-testid="listing-detail"[^>]*)>([\s\S]*?)</main>'
ANCHOR = r'(?i)<a\b([^>]*\bhref="[^"]*"[^>]*)>([\s\S]*?)</a>'


def _first(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match; NULL without a match."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def _attr(tag: Column, name: str) -> Column:
    return F.nullif(tx.strip(F.regexp_extract(tag, rf'(?i)\b{name}="([^"]*)"', 1)), F.lit(""))


def _meta(html: Column, name: str) -> Column:
    found = F.regexp_extract(html, rf'(?i)<meta[^>]*name="{name}"[^>]*content="([^"]*)"', 1)
    return F.nullif(tx.strip(found), F.lit(""))


def plain_text(c: Column | str) -> Column:
    """Text without tags, white space collapsed; blank is NULL."""
    return F.nullif(tx.collapse(F.regexp_replace(c, "<[^>]*>", "")), F.lit(""))


def _says(lowered: Column, phrases: tuple[str, ...]) -> Column:
    """Whether a text holds one of the phrases.  Their plain beginnings are looked for first:
    that is many times cheaper than trying every pattern at every character."""
    found = F.lit(False)
    for phrase in phrases:
        plain = phrase.partition("(?:")[0]
        one = F.contains(lowered, F.lit(plain))
        found = found | (one if plain == phrase else one & lowered.rlike(phrase))
    return found


def page_state(html: Column | str, state_meta: str = STATE_META,
               lowered: Column | None = None) -> Column:
    """A declared state wins; otherwise the first phrase list that matches.

    ``lowered`` may be a column that already holds the page in lower case.
    """
    html = F.col(html) if isinstance(html, str) else html
    declared = _meta(html, state_meta)
    lowered = F.lower(html) if lowered is None else lowered
    state = F.when(declared.isin(*PAGE_STATES), declared)
    for name, phrases in STATE_PHRASES:
        state = state.when(_says(lowered, phrases), name)
    return state.otherwise("ok")


def manual_action_reason(state: Column | str) -> Column:
    state = F.col(state) if isinstance(state, str) else state
    pairs = []
    for name, reason in MANUAL_ACTION_REASONS.items():
        pairs += [F.lit(name), F.lit(reason)]
    return F.create_map(*pairs).getItem(state)


def is_blocking(state: Column | str) -> Column:
    state = F.col(state) if isinstance(state, str) else state
    return state.isin(*MANUAL_ACTION_REASONS)


def with_state(pages: DataFrame, state_meta: str = STATE_META) -> DataFrame:
    """Add the page state; the page is put in lower case once."""
    df = pages.withColumn("__lower", F.lower("html"))
    return df.withColumn("state", page_state("html", state_meta, F.col("__lower"))).drop("__lower")


def _blocks(pages: DataFrame, state_meta: str) -> DataFrame:
    """Add the page state and, for readable pages, the card blocks of the markup."""
    df = with_state(pages, state_meta)
    found = F.regexp_extract_all("html", F.lit(CARD), F.lit(0))
    return df.withColumn("__blocks", F.when(
        F.col("state").isin("ok", "no_results"), found).otherwise(
        F.array().cast("array<string>")))


def _filled(c: Column) -> Column:
    return tx.once(c, lambda v: F.when(v != "", v))


def _block_listing(block: Column, url: Column) -> Column:
    named = F.regexp_extract(block, r'(?i)^<article\b[^>]*\bdata-listing-id="([^"]*)"', 1)
    return F.coalesce(_filled(tx.strip(named)), tx.once(tx.strip(url), lambda u: F.coalesce(
        _filled(F.regexp_extract(u, ROOM, 1)), _filled(F.regexp_extract(u, ROOM_PARAMETER, 1)))))


def _block_url(block: Column) -> Column:
    """The first link, which may be empty; without one the canonical URL of the tag."""
    link = F.regexp_extract_all(block, F.lit(r'(?i)^<article\b[^>]*>[\s\S]*?href="([^"]*)"'), F.lit(1))
    canonical = r'(?i)^<article\b[^>]*\bdata-canonical-url="([^"]*)"'
    return F.coalesce(F.get(link, F.lit(0)), _filled(tx.strip(F.regexp_extract(block, canonical, 1))))


def _card(block: Column) -> Column:
    """Listing, link, tag and content of one block, each cut out once."""
    return tx.once(_block_url(block), lambda url: F.struct(
        _block_listing(block, url).alias("source_listing_id"), url.alias("canonical_url"),
        block.alias("block")))


def search_pages(pages: DataFrame, state_meta: str = STATE_META) -> DataFrame:
    """Add state, card_count and malformed_count to a table with an html column."""
    df = _blocks(pages, state_meta)
    named = F.size(F.filter("__blocks", lambda b: _block_listing(b, _block_url(b)).isNotNull()))
    empty = (F.col("state") == "ok") & (F.size("__blocks") == 0)
    return df.withColumn("card_count", named.cast("bigint")).withColumns({
        "malformed_count": F.size("__blocks") - F.col("card_count"),
        "state": F.when(empty, "no_results").otherwise(F.col("state")),
    }).drop("__blocks")


def cards(pages: DataFrame, *keep: str, state_meta: str = STATE_META) -> DataFrame:
    """One row per usable card, with its position on the page.

    Blocks become rows first, so tag and content are cut out once per card.
    """
    # An outer explode keeps the card as one value: filters on it are not moved below, where
    # every expression they name would be worked out again.
    card = F.transform(F.col("__blocks"), lambda b: _card(b))
    block, tag = F.col("card.block"), F.col("open_tag")
    df = _blocks(pages, state_meta).select(*keep, F.posexplode_outer(card).alias("position", "card")).filter(
        F.col("card.source_listing_id").isNotNull()).select(
        *keep, "position", "card.source_listing_id", "card.canonical_url",
        F.regexp_extract(block, r"(?i)^<article\b([^>]*)>", 1).alias("open_tag"),
        F.regexp_extract(block, r"(?i)^<article\b[^>]*>[\s\S]*?<a\b[^>]*>([\s\S]*?)</a>", 1)
        .alias("__label"))
    title = plain_text("__label")
    names = ("title", "area", "rating", "review-count", "price", "currency", "guests", "bedrooms", "image",
             "lat", "lng")
    df = df.select("*", *[_attr(tag, f"data-{n}").alias(f"__{n}") for n in names])
    own = {n: F.col(f"`__{n}`") for n in names}
    return df.select(
        *keep, "position", "source_listing_id", "canonical_url",
        F.coalesce(title, own["title"]).alias("title"), own["area"].alias("area"),
        tx.leading_number(own["rating"]).alias("rating"),
        tx.leading_integer(own["review-count"]).alias("review_count"),
        own["price"].alias("displayed_price"), own["currency"].alias("currency"),
        tx.leading_integer(own["guests"]).alias("guest_capacity"),
        tx.leading_integer(own["bedrooms"]).alias("bedrooms"), own["image"].alias("image_url"),
        tx.leading_number(own["lat"]).alias("latitude"),
        tx.leading_number(own["lng"]).alias("longitude"), "open_tag")


def _items(inner: Column, block: str, item: str) -> Column:
    return F.regexp_extract_all(F.regexp_extract(inner, block, 1), F.lit(item), F.lit(1))


def detail_pages(pages: DataFrame, state_meta: str = STATE_META, id_meta: str = ID_META,
                 url_meta: str = URL_META) -> DataFrame:
    """Add state and the detail record; the record is NULL when no listing is named."""
    html = F.col("html")
    df = with_state(pages, state_meta).withColumns({
        "__tag": F.regexp_extract(html, DETAIL, 1), "__inner": F.regexp_extract(html, DETAIL, 2),
    })
    tag, inner = F.col("__tag"), F.col("__inner")
    ok = F.col("state") == "ok"
    blocked = is_blocking("state") & (F.col("state") != "navigation_error")
    observed = F.when(ok, "collected").when(F.col("state") == "no_results", "unavailable").when(
        blocked, "blocked").otherwise("error")
    listing = F.when(ok, F.coalesce(
        normalize_listing_id(_attr(tag, "data-listing-id")),
        listing_id_from_url(_attr(tag, "data-canonical-url")))).otherwise(F.coalesce(
            normalize_listing_id(_meta(html, id_meta)),
            listing_id_from_url(_meta(html, url_meta))))

    def seen(value: Column) -> Column:
        return F.when(ok, value)

    amenities = F.filter(F.transform(_items(
        inner, r'(?i)data-testid="amenities"[^>]*>([\s\S]*?)</ul>',
        r"(?i)<li[^>]*>([\s\S]*?)</li>"), plain_text), lambda a: a.isNotNull())
    photos = F.filter(_items(
        inner, r'(?i)data-testid="photos"[^>]*>([\s\S]*?)</div>',
        r'(?i)<img[^>]*\bsrc="([^"]*)"'), lambda u: u != "")
    nothing = F.array().cast("array<string>")
    record = F.struct(
        listing.alias("source_listing_id"), observed.alias("observed_status"),
        seen(plain_text(F.regexp_extract(
            inner, r'(?i)data-testid="description"[^>]*>([\s\S]*?)<', 1)))
        .alias("description"),
        seen(_attr(tag, "data-property-type")).alias("property_type"),
        seen(tx.leading_number(_attr(tag, "data-bedrooms"))).alias("bedrooms"),
        seen(tx.leading_number(_attr(tag, "data-beds"))).alias("beds"),
        seen(tx.leading_number(_attr(tag, "data-bathrooms"))).alias("bathrooms"),
        seen(tx.leading_number(_attr(tag, "data-max-guests"))).alias("max_guests"),
        F.coalesce(seen(amenities), nothing).alias("amenities"),
        seen(_attr(tag, "data-host-name")).alias("host_name"),
        seen(_attr(tag, "data-host-id")).alias("source_host_id"),
        seen(tx.flag_boolean(_attr(tag, "data-superhost"))).alias("is_superhost"),
        F.coalesce(seen(photos), nothing).alias("photo_urls"),
    )
    return df.withColumn("__d", record).withColumn("detail", F.when(
        F.col("__d.source_listing_id").isNotNull(), F.col("__d"))).drop("__d", "__tag", "__inner")


def listing_links(pages: DataFrame, base_url: str, marker: str = "/rooms/") -> DataFrame:
    """First link per listing and page, with absolute URL and label.

    Anchors that carry the marker but no listing id are left to ``malformed_links``.
    """
    anchors = _anchors(pages, marker).filter(F.col("listing_id").isNotNull())
    first = anchors.groupBy("page_id", "listing_id").agg(
        F.min_by(F.struct("href", "label", "position"), "position").alias("a"))
    href = F.col("a.href")
    absolute = F.when(href.startswith("http"), href).when(
        href.startswith("/"), F.concat(F.lit(base_url), href)).otherwise(
        F.concat(F.lit(base_url + "/"), href))
    return first.select("page_id", "listing_id", absolute.alias("url"),
                        F.col("a.label").alias("label"), F.col("a.position").alias("position"))


def malformed_links(pages: DataFrame, marker: str = "/rooms/") -> DataFrame:
    return _anchors(pages, marker).groupBy("page_id").agg(
        F.count_if(F.col("listing_id").isNull()).alias("malformed"))


def _anchors(pages: DataFrame, marker: str) -> DataFrame:
    found = F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(0))
    tag, inner = F.regexp_extract("a", ANCHOR, 1), F.regexp_extract("a", ANCHOR, 2)
    href = F.regexp_extract(tag, r'(?i)\bhref="([^"]*)"', 1)
    label = F.coalesce(_first(tag, r'(?i)\baria-label="([^"]*)"'),
                       F.regexp_replace(inner, "<[^>]*>", ""))
    return (
        pages.select("page_id", F.posexplode(found).alias("position", "a"))
        .select("page_id", "position", href.alias("href"), label.alias("label"))
        .filter(F.contains("href", F.lit(marker)))
        .withColumn("listing_id", listing_id_from_url("href"))
    )
