"""Text: places, map links, share codes, formats."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .angles import col, let

NUMBER = r"-?[0-9]{1,3}(?:\.[0-9]+)?"
#: Coordinate patterns of map links, tried in this order.
COORDINATES = (
    rf"!3d({NUMBER})!4d({NUMBER})", rf"[?&#](?:q|query|ll|center|destination|daddr)=(?:loc:)?({NUMBER})[, ]+({NUMBER})",
    rf"/@({NUMBER}),({NUMBER})", rf"/(?:search|place|dir)/({NUMBER}),\+?({NUMBER})",
)
HOSTS = r"^(?:www\.|maps\.)?google\.[a-z.]{2,6}$|^maps\.app\.goo\.gl$|^goo\.gl$"


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility normal form, lower case, without white space."""
    return text.map(lambda t: None if t is None else "".join(unicodedata.normalize("NFKC", t).lower().split()))


def ascii_normal(text) -> Column:
    """As ``nfkc`` for ASCII text, in built-in functions."""
    return F.regexp_replace(F.lower(col(text)), r"\s+", "")


def title_score(query: Column, title: Column) -> Column:
    """0 for an equal title, 1 for one that begins with the query, 2 contains it, 3 is contained in it, else 4."""
    return F.when(title == query, 0).when(title.startswith(query), 1).when(F.contains(title, query), 2).when(F.contains(query, title), 3).otherwise(4)


def literal_place(text) -> Column:
    """Latitude and longitude of a text "lat, lon"; null otherwise."""
    t = F.trim(col(text))
    pattern = r"^(-?[0-9]+(?:\.[0-9]+)?)\s*,\s*(-?[0-9]+(?:\.[0-9]+)?)$"
    lat, lon = (F.nullif(F.regexp_extract(t, pattern, k), F.lit("")).cast("double") for k in (1, 2))
    return F.when(lat.between(-90, 90) & lon.between(-180, 180), F.struct(lat.alias("lat"), lon.alias("lon")))


def focal_length(text) -> Column:
    """A focal length in mm from 9 to 1600 typed in half or full width; null otherwise."""
    t = F.trim(F.translate(col(text), "０１２３４５６７８９．", "0123456789."))
    v = F.when(t.rlike(r"^[0-9]+(\.[0-9]+)?$"), t.cast("double"))
    return F.when(v.between(9, 1600), v)


def decode_link(url) -> Column:
    """A link with entities and escapes undone and up to four rounds of percent decoding."""
    t = col(url)
    for a, b in (("&amp;", "&"), ("&#38;", "&"), ("&#x26;", "&"), ("&quot;", '"'), ("\\u002f", "/"), ("\\u003a", ":"), ("\\u003d", "="), ("\\u0026", "&"), ("\\u002c", ","), ("\\/", "/")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.aggregate(F.sequence(F.lit(1), F.lit(4)), t, lambda s, _: F.coalesce(F.try_url_decode(s), s))


def link_host(url) -> Column:
    return F.lower(F.regexp_extract(col(url), r"^https?://([^/?#:]+)", 1))


def is_map_link(url) -> Column:
    return link_host(url).rlike(HOSTS)


def decoded_place(link) -> Column:
    """Latitude and longitude of a decoded map link by the first pattern that fits; null if none does."""
    t = col(link)
    found = []
    for p in COORDINATES:
        lat, lon = (F.nullif(F.regexp_extract(t, p, k), F.lit("")).cast("double") for k in (1, 2))
        found.append(F.when(lat.between(-90, 90) & lon.between(-180, 180), F.struct(lat.alias("lat"), lon.alias("lon"))))
    return F.coalesce(*found)


def link_ids(link) -> Column:
    """Place id, feature id and its decimal customer id, and the place name in a decoded map link."""
    t = col(link)
    none = lambda c: F.nullif(c, F.lit(""))
    feature = none(F.regexp_extract(t, r"(0x[0-9a-fA-F]+:0x[0-9a-fA-F]+)", 1))
    return F.struct(
        none(F.regexp_extract(t, r"(?:place_id[=:]|!19s)(ChIJ[0-9A-Za-z_-]+)", 1)).alias("place_id"),
        feature.alias("feature_id"),
        F.coalesce(F.conv(F.regexp_extract(feature, r":0x([0-9a-fA-F]+)$", 1), 16, 10), none(F.regexp_extract(t, r"[?&]cid=([0-9]+)", 1))).alias("cid"),
        none(F.trim(F.translate(F.regexp_extract(t, r"/maps/place/([^/@?]+)", 1), "+", " "))).alias("name"),
    )


def first_known(*sources: Column) -> Column:
    """Per field the first value that is known in a row of structs of the same fields."""
    return F.struct(*[F.coalesce(*[s[f] for s in sources]).alias(f) for f in ("place_id", "feature_id", "cid", "name")])


def place_queries(text) -> Column:
    """Search texts for an address: whole, without postal code, and for Japanese the last word and the last two."""
    t = F.trim(F.regexp_replace(col(text), r"\s+", " "))
    bare = F.trim(F.regexp_replace(t, r"^〒?[0-9]{3}-?[0-9]{4}\s*", ""))
    words = F.filter(F.split(bare, " "), lambda w: w != "")
    japanese = t.rlike(r"^〒?[0-9]{3}-?[0-9]{4}") | t.rlike(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]")
    tail = F.when(japanese & (F.size(words) > 1), F.array(F.element_at(words, -1), F.array_join(F.slice(words, -2, 2), " "))).otherwise(F.array().cast("array<string>"))
    every = F.transform(F.concat(F.array(t, bare), tail), lambda q: F.substring(q, 1, 200))
    return F.array_distinct(F.filter(every, lambda q: q != ""))


def share_encode(payload: Column) -> Column:
    """URL-safe base64 without padding of a struct's JSON."""
    return F.rtrim(F.translate(F.base64(F.encode(F.to_json(payload), "UTF-8")), "+/\r\n", "-_"), F.lit("="))


SHARE_SCHEMA = T.StructType(
    [
        T.StructField("v", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("zone", T.StringType()), T.StructField("shooting", T.StringType()),
        *[T.StructField(p, T.StructType([T.StructField("latitude", T.DoubleType()), T.StructField("longitude", T.DoubleType()), T.StructField("label", T.StringType())])) for p in ("subject", "tripod")],
        T.StructField("focal_mm", T.DoubleType()), T.StructField("lens_m", T.DoubleType()),
    ]
)


def share_decode(code) -> Column:
    """The payload of a share code; null for a broken one, another version, or places out of range."""
    c = F.translate(col(code), "-_", "+/")
    raw = F.try_to_binary(F.rpad(c, (F.ceil(F.length(c) / 4) * 4).cast("int"), F.lit("=")), F.lit("base64"))
    return let(F.from_json(F.decode(raw, "UTF-8"), SHARE_SCHEMA), _valid_share)  # parsed once


def _valid_share(p: Column) -> Column:
    inside = lambda q: p[q]["latitude"].between(-90, 90) & p[q]["longitude"].between(-180, 180) & p[q]["label"].isNotNull()
    complete = p["name"].isNotNull() & p["zone"].isNotNull() & p["shooting"].isNotNull() & p["focal_mm"].isNotNull() & p["lens_m"].isNotNull()
    return F.when((p["v"] == 1) & inside("subject") & inside("tripod") & complete, p)


def distance_text(metres) -> Column:
    m = col(metres)
    return F.when(m < 1000, F.format_string("%d m", F.floor(m + 0.5).cast("long"))).otherwise(F.format_string("%.1f km", m / 1000))


def duration_text(seconds) -> Column:
    s = F.floor(col(seconds) + 0.5).cast("long")
    return F.when(s < 60, F.format_string("%d s", s)).when(s < 3600, F.format_string("%d min %d s", F.floor(s / 60), s % 60)).otherwise(F.format_string("%d h %d min", F.floor(s / 3600), F.floor(s / 60) % 60))


def percent_text(part, whole) -> Column:
    return F.format_string("%d %%", F.floor(F.try_divide(col(part) * F.lit(100.0), col(whole)) + 0.5).cast("long"))


def cache_key(*parts) -> Column:
    """A key for numbers rounded to five decimals and other values, by hash."""
    return F.sha2(F.concat_ws("|", *[F.format_string("%.5f", p) if isinstance(p, Column) else F.lit(str(p)) for p in parts]), 256)
