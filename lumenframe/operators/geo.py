"""Nearest places and values at a time."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RADIUS = 6371.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Kilometres between two points."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * RADIUS * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def nearest(points: DataFrame, places: DataFrame, most_km: float) -> DataFrame:
    """``id, city, km``: the nearest ``(city, clat, clon)`` within ``most_km`` of each
    ``(id, lat, lon)``; the lower city number wins ties. Places are listed under every latitude
    band and longitude cell that ``most_km`` reaches, so points meet near places only. Points of one
    spot are asked for once, and of the cities of one spot only the lowest can win."""
    places = places.groupBy("clat", "clon").agg(F.min("city").alias("city"))
    spots = points.select("lat", "lon").distinct()
    band = math.degrees(most_km / RADIUS) * 1.001
    wide = F.degrees(F.asin(F.least(F.lit(1.0), F.lit(math.sin(most_km / RADIUS)) / F.greatest(F.cos(F.radians(F.abs("clat"))), F.lit(1e-9))))) * 1.001
    reach = F.when(F.abs("clat") + band >= 90, F.lit(180.0)).otherwise(wide)
    rows = F.explode(F.sequence(F.floor((F.col("clat") - band) / band), F.floor((F.col("clat") + band) / band))).alias("row")
    spread = places.select("city", "clat", "clon", reach.alias("reach"), rows)
    columns = F.sequence(F.floor((F.col("clon") - F.col("reach")) / band), F.floor((F.col("clon") + F.col("reach")) / band))
    cells = spread.select("city", "clat", "clon", "row", F.explode(columns).alias("column"))
    # A point is looked up in its own turn and in both next ones, so the date line is no border.
    own = spots.select("lat", "lon", F.floor(F.col("lat") / band).alias("row"), F.explode(F.array(F.col("lon"), F.col("lon") + 360, F.col("lon") - 360)).alias("x"))
    own = own.select("lat", "lon", "row", F.floor(F.col("x") / band).alias("column"))
    km = haversine(F.col("lat"), F.col("lon"), F.col("clat"), F.col("clon"))
    found = own.join(cells, ["row", "column"]).withColumn("km", km).where(F.col("km") <= most_km)
    best = found.groupBy("lat", "lon").agg(F.min(F.struct("km", F.col("city").isNull().alias("none"), "city")).alias("m"))
    # An id of several spots has the nearest city of them all.
    best = points.join(best, ["lat", "lon"]).groupBy("id").agg(F.min("m").alias("m"))
    return best.select("id", "m.city", "m.km")


def locate(points: DataFrame, probes: DataFrame, key: str, most_apart: float, most_gap: float) -> DataFrame:
    """``probes`` (key, t, ...) with ``v`` from ``points`` (key, t, v): the value at the same time,
    else interpolated between neighbours at most ``most_apart`` apart, else that of the nearer one
    within ``most_gap``, the earlier on a tie. One shuffle by key serves both directions."""
    extra = [c for c in probes.columns if c not in (key, "t")]
    kinds = dict(probes.dtypes)
    a = points.select(key, "t", F.struct("t", "v").alias("p"), F.lit(0).alias("probe"), *[F.lit(None).cast(kinds[c]).alias(c) for c in extra])
    b = probes.select(key, "t", F.lit(None).cast("struct<t:double,v:double>").alias("p"), F.lit(1).alias("probe"), *extra)
    w = Window.partitionBy(key)
    before = F.last("p", ignorenulls=True).over(w.orderBy("t", "probe").rowsBetween(Window.unboundedPreceding, 0))
    after = F.last("p", ignorenulls=True).over(w.orderBy(F.col("t").desc(), "probe").rowsBetween(Window.unboundedPreceding, 0))
    rows = a.unionByName(b).withColumn("b", before).withColumn("a", after).where("probe = 1")
    t, t0, v0, t1, v1 = F.col("t"), F.col("b.t"), F.col("b.v"), F.col("a.t"), F.col("a.v")
    between = v0 + (v1 - v0) * (t - t0) / F.nullif(t1 - t0, F.lit(0.0))
    v = F.when(t0 == t, v0).when(t1 - t0 <= most_apart, between)
    v = v.when((t - t0 <= most_gap) & (t1.isNull() | (t - t0 <= t1 - t)), v0).when(t1 - t <= most_gap, v1)
    return rows.select(key, "t", *extra, v.alias("v"))
