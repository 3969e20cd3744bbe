"""Column functions over URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Query parameters that only track where a reader came from.
TRACKING = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    "fbclid", "gclid", "mc_cid", "mc_eid",
]


def host_of(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def host_domain(url: Column) -> Column:
    """Host without a leading ``www.``; null when the URL cannot be parsed."""
    return F.regexp_replace(host_of(url), r"^www\.", "")


def url_path(url: Column) -> Column:
    path = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    return F.when(path == "", "/").otherwise(path)


def _encode(c: Column) -> Column:
    # form encoding leaves the tilde and escapes the star
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _decode(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), c)


def canonical_url(url: Column) -> Column:
    """URL without fragment, tracking parameters and valueless parameters; order kept."""
    bare = F.regexp_extract(url, r"^([^?#]*)", 1)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    pairs = F.transform(
        F.split(query, "&"),
        lambda p: F.struct(
            _decode(F.substring_index(p, "=", 1)).alias("name"),
            F.when(F.contains(p, F.lit("=")), _decode(F.regexp_replace(p, "^[^=]*=", ""))).alias("value"),
        ),
    )
    kept = F.filter(
        pairs,
        lambda p: (F.coalesce(p["value"], F.lit("")) != "") & ~F.lower(p["name"]).isin(TRACKING),
    )
    text = F.array_join(
        F.transform(kept, lambda p: F.concat(_encode(p["name"]), F.lit("="), _encode(p["value"]))), "&"
    )
    return F.when(text == "", bare).otherwise(F.concat(bare, F.lit("?"), text))


def registered_domains(urls: DataFrame, suffixes: DataFrame, url: str = "url") -> DataFrame:
    """Registered domain per distinct host: the longest public suffix plus one label.

    Hosts are made distinct first, so a popular host costs one row. Columns:
    ``host, registered_domain``; a host under no listed suffix keeps its last label,
    an address stays whole, and a bare suffix is its own domain.
    """
    hosts = urls.select(host_of(F.col(url)).alias("host")).where("host is not null").distinct()
    labels = F.split("host", r"\.")
    tails = hosts.select(
        "host",
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.size(labels)),
                lambda n: F.struct(
                    n.alias("n"),
                    F.array_join(F.slice(labels, F.size(labels) - n + 1, n), ".").alias("suffix"),
                ),
            )
        ).alias("tail"),
    ).select("host", "tail.n", "tail.suffix")
    known = tails.join(suffixes.select("suffix", F.lit(1).alias("listed")), "suffix", "left")
    longest = known.groupBy("host").agg(F.max(F.when(F.col("listed") == 1, F.col("n"))).alias("n"))
    size = F.size(labels)
    take = F.least(F.coalesce("n", F.lit(0)) + 1, size)
    domain = F.array_join(F.slice(labels, size - take + 1, take), ".")
    address = F.col("host").rlike(r"^(\d{1,3}\.){3}\d{1,3}$|^\[")
    return longest.select("host", F.when(address, F.col("host")).otherwise(domain).alias("registered_domain"))
