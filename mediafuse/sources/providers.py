"""Streaming providers: which origin a url belongs to and the content id it carries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Offer packages and the origins they stand for. Fixed values.
PACKAGES = {"cru": "cr", "nfx": "nf", "dnp": "disney", "amp": "amazon", "atp": "appletv", "hlu": "hulu", "hbm": "hbo", "pcp": "peacock", "pmp": "paramount", "fuv": "fubo"}
#: Parts of host names and the origins they stand for. Fixed values.
HOSTS = [(r"crunchyroll\.com", "cr"), (r"netflix\.com", "nf"), (r"hulu\.com", "hulu"), (r"disneyplus\.com", "disney"), (r"(primevideo|amazon)\.", "amazon"), (r"(hbomax|max)\.com", "hbo")]
#: Where urls carry a content id: host and place in the path; the first that fits counts. Fixed values.
CONTENT_IDS = [
    (r"^(netflix|paramountplus)\.com$", "^/+[^/]+/+([^/]+)"),
    (r"^crunchyroll\.com$", "^/+series/+([^/]+)"),
    (r"^(amazon\.|peacocktv\.com$)", "([^/]+)/*$"),
    (r"^hulu\.com$", "(?i)([0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})/*$"),
    (r"^hulu\.com$", "([^/]+)/*$"),
    (r"^(disneyplus|tv\.apple)\.com$", "^/+[^/]+/+[^/]+/+([^/]+)"),
]
#: Offers that count. Fixed values.
OFFERS = ("FLATRATE", "FLATRATE_AND_BUY", "FREE", "ADS")


def host_of(url: Column) -> Column:
    return F.regexp_replace(F.try_parse_url(url, F.lit("HOST")), r"^www\.", "")


def path_parts(url: Column) -> Column:
    return F.filter(F.split(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/", -1), lambda p: p != "")


def stream_origin(url: Column) -> Column:
    return F.coalesce(*(F.when(url.rlike(p), F.lit(o)) for p, o in HOSTS))


def package_origin(code: Column) -> Column:
    return F.coalesce(*(F.when(code == k, F.lit(v)) for k, v in PACKAGES.items()))


def content_id(url: Column) -> Column:
    """The id in a provider's own space, null where its urls carry none."""
    host, path = host_of(url), F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    return F.coalesce(*(F.when(host.rlike(h), F.nullif(F.regexp_extract(path, p, 1), F.lit(""))) for h, p in CONTENT_IDS))


def episode_content_id(url: Column) -> Column:
    """The id in a watch page's url, null for any other page."""
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    return F.when(host_of(url) == "crunchyroll.com", F.nullif(F.regexp_extract(path, "^/+watch/+([^/]+)", 1), F.lit("")))


def real_url(affiliate: Column) -> Column:
    """The url that an affiliate link leads to."""
    query = lambda k: F.try_url_decode(F.try_parse_url(affiliate, F.lit("QUERY"), F.lit(k)))
    return F.coalesce(query("u"), query("r"))


def usable_offers(offers: DataFrame, key: str) -> DataFrame:
    """Offers of a counted kind, the first of each package of a title, with the package's origin."""
    rows = offers.where(F.col("monetization").isin(*OFFERS)).withColumn("origin", package_origin(F.col("package"))).where("origin is not null")
    first = F.row_number().over(Window.partitionBy(key, "package").orderBy("pos"))
    return rows.withColumn("_r", first).where("_r = 1").drop("_r")
