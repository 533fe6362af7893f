"""Location lookup of addresses in a table of disjoint ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netspark.functions.ip import ip_number, is_local_or_reserved
from netspark.operators.scan import Running, scan
from netspark.session import stage


def parse_asn(as_text: Column) -> Column:
    """``AS15169 Some Name`` to 15169; null when it does not start that way."""
    return F.regexp_extract(as_text, r"^AS(\d+)(\s|$)", 1).try_cast("bigint")


def display(private: Column, resolved: Column, city: Column, country: Column, org: Column) -> Column:
    place = F.concat_ws(", ", F.when(city != "", city), F.when(country != "", country))
    place = F.when(place != "", place).otherwise("location unknown")
    named = F.when(org != "", F.concat(place, F.lit(" ("), org, F.lit(")"))).otherwise(place)
    return F.when(private, "local network").when(~resolved, "location unknown").otherwise(named)


#: Numbers of a chunk of the address space: 65 536 chunks, whose totals are one small window.
BLOCK = (1 << 16,)
PLACE = ["country", "country_code", "city", "latitude", "longitude", "as_text", "org"]


def geo_lookup(addresses: DataFrame, ip: str, ranges: DataFrame) -> DataFrame:
    """One row per distinct address with its location columns.

    Ranges are disjoint, so the range that can hold an address is the last one that starts at or before it: one ordered
    ``scan`` over range starts and distinct address numbers carries it along, cut into blocks of the address space. No
    range is copied, and a large range or a crowded block costs no more than its rows. Local and malformed addresses
    take no part.
    """
    distinct = addresses.select(F.col(ip)).filter(F.col(ip).isNotNull()).distinct()
    local = is_local_or_reserved(F.col(ip))
    # Read twice below: for their numbers and to name what was found.
    known = stage(distinct.select(ip, local.alias("is_private"), F.when(~local, ip_number(F.col(ip))).alias("_n")), "addresses")
    place = F.struct("end_ip", *PLACE)
    starts = ranges.select(F.col("start_ip").alias("_n"), place.alias("_place"), F.lit(False).alias("_sought"))
    sought = known.filter("_n is not null").select("_n", F.lit(None).cast(starts.schema["_place"].dataType).alias("_place"), F.lit(True).alias("_sought"))
    points = starts.unionByName(sought).groupBy("_n").agg(F.first("_place", ignorenulls=True).alias("_place"), F.max("_sought").alias("_sought"))
    found = scan(points, [], "_n", {"_at": Running("last", "_place")}, BLOCK)
    hits = found.filter(F.col("_sought") & (F.col("_at.end_ip") >= F.col("_n"))).select("_n", "_at")
    hit = known.join(hits, "_n", "left")
    resolved = F.col("_at").isNotNull()
    of = {name: F.col(f"_at.{name}") for name in PLACE}
    return hit.select(
        ip, "is_private", resolved.alias("resolved"), *(of[c].alias(c) for c in PLACE[:5]),
        parse_asn(of["as_text"]).alias("asn"), of["org"].alias("org"),
        display(F.col("is_private"), resolved, of["city"], of["country"], of["org"]).alias("location"),
    )


#: Distinct addresses up to which the lookup is broadcast, and copies of it that share a hot address beyond.
MOST_SENT, COPIES = 100_000, 16


def geo_enrich(df: DataFrame, ip: str, ranges: DataFrame) -> DataFrame:
    """``df`` with the location columns of its ``ip`` column; each distinct address is looked up once.

    A hot address never meets in one task: the lookup is broadcast while it is small, by its checked size, and beyond that the rows
    of an address are dealt over ``COPIES`` copies of its row.
    """
    lookup = stage(geo_lookup(df, ip, ranges), "locations")
    if lookup.count() <= MOST_SENT:
        return df.join(F.broadcast(lookup), ip, "left")
    salt = F.pmod(F.xxhash64(*(F.col(c) for c in df.columns)), F.lit(COPIES))
    copies = lookup.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(COPIES - 1).cast("bigint"))))
    return df.withColumn("_copy", salt).join(copies, [ip, "_copy"], "left").drop("_copy")
