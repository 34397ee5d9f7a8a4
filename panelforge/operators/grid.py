"""Gridded and spatial operators re-aimed to tables.

A raster collection is a long pixel table ``(pixel, ts, band columns...)``.
Compositing and zonal statistics are two aggregates in one job for all
months at once (no per-month loop).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.session import cut_lineage


def composite(pixels: DataFrame, pixel: str, ts: str, bands: Sequence[str], grain: str = "month",
              start: str | None = None, end: str | None = None) -> DataFrame:
    """Mean per pixel per period (date-range filter pushed to the scan)."""
    d = pixels
    if start is not None:
        d = d.where(F.col(ts) >= F.lit(start).cast(pixels.schema[ts].dataType))
    if end is not None:
        d = d.where(F.col(ts) < F.lit(end).cast(pixels.schema[ts].dataType))
    return d.groupBy(pixel, F.date_trunc(grain, F.col(ts)).alias("period")).agg(*[F.avg(b).alias(b) for b in bands])


def zonal_mean(comp: DataFrame, pixel: str, zones: DataFrame, zone: str, bands: Sequence[str],
               by: Sequence[str] = ("period",)) -> DataFrame:
    """Pixel -> zone mapping joined, then mean of the pixel values per
    zone and period."""
    return comp.join(zones.select(pixel, zone), pixel, "inner").groupBy(zone, *by).agg(*[F.avg(b).alias(b) for b in bands])


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    r = EARTH_KM
    p1, p2 = F.radians(lat1), F.radians(lat2)
    dphi, dl = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dphi / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dl / 2), 2)
    return 2 * r * F.asin(F.sqrt(a))


EARTH_KM = 6371.0088
#: Grid levels of the nearest-site search: level 0 has two rows of 90 degrees, each further one halves them.
MOST_LEVELS = 20


def _rows(level: Column) -> Column:
    return F.pow(F.lit(2.0), level + 1).cast("int")


def grid_row(lat: Column, level: Column) -> Column:
    """Row of a latitude: ``2 ** (level + 1)`` rows from the south pole."""
    rows = _rows(level)
    return F.least(F.greatest(F.floor((lat + 90) * rows / 180), F.lit(0)), rows - 1).cast("int")


def grid_columns(row: Column, level: Column) -> Column:
    """Columns of a row: as many as keep cells about as wide as high, one at the poles."""
    rows = _rows(level)
    middle = F.radians((row + 0.5) * 180 / rows - 90)
    return F.greatest(F.ceil(2 * rows * F.cos(middle)), F.lit(1)).cast("int")


def grid_column(lon: Column, columns: Column) -> Column:
    return F.least(F.floor(F.pmod(lon + 180, F.lit(360.0)) * columns / 360), columns - 1).cast("int")


def _cells(lat: Column, lon: Column, level: Column) -> Column:
    row = grid_row(lat, level)
    return F.struct(level.alias("level"), row.alias("row"), grid_column(lon, grid_columns(row, level)).alias("column"))


def reached_cells(lat: Column, lon: Column, degrees: Column, level: Column) -> Column:
    """The cells of a level that a circle of ``degrees`` around a place meets, as an array of structs.

    A circle with a pole in it meets all columns of its rows; otherwise it spans ``asin(sin r / cos lat)``
    degrees of longitude to either side, also across the date line."""
    south, north = grid_row(lat - degrees, level), grid_row(lat + degrees, level)
    polar = (lat + degrees >= 90) | (lat - degrees <= -90)
    ratio = F.sin(F.radians(degrees)) / F.cos(F.radians(lat))
    side = F.when(polar | (ratio >= 1), F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(ratio, F.lit(1.0)))) + 1e-9)

    def row_cells(row: Column) -> Column:
        columns = grid_columns(row, level)
        first = F.floor((lon - side + 180) * columns / 360)
        last = F.least(F.floor((lon + side + 180) * columns / 360), first + columns - 1)
        return F.transform(F.sequence(first, last), lambda c: F.struct(
            level.alias("level"), row.alias("row"), F.pmod(c, columns).cast("int").alias("column")))

    return F.flatten(F.transform(F.sequence(south, north), row_cells))


def nearest(points: DataFrame, key: str, lat: str, lon: str, sites: DataFrame, slat: str, slon: str, name: str) -> DataFrame:
    """Distance to the nearest site and its name (ties: smallest name), exact at any number of sites.
    Points without a place get NULL, sites without one are left out; ``key`` is unique in ``points``.

    Of sites at one place only the smallest name counts, and points at one place are searched once. Sites stand
    in the cells of nested latitude / longitude grids, down to cells of a few places each. For every occupied
    finest cell of the points, rings of cells are expanded level by level until one holds a site; that site's distance bounds
    each point's search. A second join then takes the sites in the cells that the bounding circle meets, on
    the level whose cells are about as large as the circle, and drops those outside it before anything is sorted: the
    rows joined for a point are the sites around it, however many there are elsewhere."""
    s = sites.select(F.col(slat).cast("double").alias("__slat"), F.col(slon).cast("double").alias("__slon"), F.col(name).alias("__name"))
    s = s.where("__slat is not null and __slon is not null and not isnan(__slat) and not isnan(__slon)")
    s = cut_lineage(s.groupBy("__slat", "__slon").agg(F.min("__name").alias("__name"), F.count_if(F.col("__name").isNull()).alias("__unnamed"))
                    .withColumn("__name", F.when(F.col("__unnamed") == 0, F.col("__name"))).drop("__unnamed"))
    p = points.select(F.col(lat).cast("double").alias("__lat"), F.col(lon).cast("double").alias("__lon"))
    p = p.where("__lat is not null and __lon is not null and not isnan(__lat) and not isnan(__lon)").distinct()
    n = s.count()
    if not n:
        return points.withColumns({"dist_km": F.lit(None).cast("double"), "nearest_site": F.lit(None).cast(sites.schema[name].dataType)})
    finest = _finest_level(s, n)
    levels = F.sequence(F.lit(0), F.lit(finest))
    s = cut_lineage(s.withColumn("__level", F.explode(levels)).withColumn(
        "__cell", _cells(F.col("__slat"), F.col("__slon"), F.col("__level"))))
    one = s.groupBy("__cell").agg(F.min(F.struct("__slat", "__slon")).alias("__site"))
    # per finest cell of the points: the finest level on which a site stands in the cell or next to it
    p = p.withColumn("__at", _cells(F.col("__lat"), F.col("__lon"), F.lit(finest)))
    spots = p.select("__at").distinct()
    middle = (F.col("__at.row") + 0.5) * (180.0 / 2 ** (finest + 1)) - 90
    across = (F.col("__at.column") + 0.5) * 360.0 / grid_columns(F.col("__at.row"), F.lit(finest)) - 180
    size = F.lit(180.0) / _rows(F.col("__level"))
    rings = (spots.withColumn("__level", F.explode(levels))
             .select("__at", "__level", F.posexplode(reached_cells(middle, across, size, F.col("__level"))).alias("__turn", "__cell")))
    order = F.shiftleft(F.col("__level").cast("long"), 32) + F.col("__turn")  # no two cells of a spot share it
    whole = s.where("__level = 0").agg(F.min(F.struct("__slat", "__slon")).alias("__any"))
    met = (rings.join(one, "__cell").select("__at", "__site.*", order.alias("__order")).groupBy("__at")
           .agg(F.max_by("__slat", "__order").alias("__slat"), F.max_by("__slon", "__order").alias("__slon"))
           .select("__at", F.struct("__slat", "__slon").alias("__site")))
    bounds = spots.join(met, "__at", "left").withColumn("__k", F.lit(0)).join(F.broadcast(whole.withColumn("__k", F.lit(0))), "__k")
    bounds = bounds.select("__at", F.coalesce("__site", "__any").alias("__site"))
    reach = haversine_km(F.col("__lat"), F.col("__lon"), F.col("__site.__slat"), F.col("__site.__slon")) / EARTH_KM
    q = p.join(bounds, "__at").withColumn("__reach", F.degrees(reach) * (1 + 1e-9) + 1e-7)
    fits = F.floor(F.log2(F.lit(90.0) / F.col("__reach")))
    q = q.withColumn("__level", F.least(F.greatest(fits, F.lit(0)), F.lit(finest)).cast("int"))
    q = q.select("__lat", "__lon", "__reach",
                 F.explode(reached_cells(F.col("__lat"), F.col("__lon"), F.col("__reach"), F.col("__level"))).alias("__cell"))
    d = haversine_km(F.col("__lat"), F.col("__lon"), F.col("__slat"), F.col("__slon"))
    inside = q.join(s.select("__cell", "__slat", "__slon", "__name"), "__cell").withColumn("__d", d)
    inside = inside.where(F.degrees(F.col("__d") / EARTH_KM) <= F.col("__reach"))
    best = (inside.groupBy("__lat", "__lon")
            .agg(F.min(F.struct(F.col("__d").alias("d"), F.col("__name").alias("name"))).alias("__best")))
    # back to the points; rows that share a key share the nearest place of all of them
    at = points.select(key, F.col(lat).cast("double").alias("__plat"), F.col(lon).cast("double").alias("__plon"))
    best = (at.join(best, (F.col("__plat") == F.col("__lat")) & (F.col("__plon") == F.col("__lon")))
            .select(key, "__best").repartition(key).groupBy(key).agg(F.min("__best").alias("__best")))
    return points.join(best, key, "left").withColumns({"dist_km": F.col("__best.d"), "nearest_site": F.col("__best.name")}).drop("__best")


def _finest_level(s: DataFrame, n: int) -> int:
    """The first level on which a place shares its cell with three others or fewer on average."""
    tried = F.sequence(F.lit(1), F.lit(MOST_LEVELS))
    cells = s.select("__slat", "__slon", F.explode(tried).alias("__level"))
    cells = cells.groupBy(_cells(F.col("__slat"), F.col("__slon"), F.col("__level")).alias("__cell")).agg(F.count(F.lit(1)).alias("n"))
    crowd = {r["level"]: r["crowd"] for r in cells.groupBy("__cell.level").agg(F.sum(F.col("n") * F.col("n")).alias("crowd")).collect()}
    return next((i for i in sorted(crowd) if crowd[i] <= 4 * n), MOST_LEVELS)


def range_check(df: DataFrame, ranges: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Per band, value range in the data and count outside the expected
    range -- one aggregate over the band columns present."""
    present = [b for b in ranges if b in df.columns]
    aggs = [F.count(F.lit(1)).alias("__n")]
    for b in present:
        lo, hi = ranges[b]
        aggs += [F.min(b).alias(f"{b}|min"), F.max(b).alias(f"{b}|max"),
                 F.count_if((F.col(b) < F.lit(lo)) | (F.col(b) > F.lit(hi))).alias(f"{b}|out")]
    wide = df.agg(*aggs)
    rows = [F.struct(F.lit(b).alias("band"), F.lit(float(ranges[b][0])).alias("expected_min"),
                     F.lit(float(ranges[b][1])).alias("expected_max"), F.col(f"`{b}|min`").cast("double").alias("min"),
                     F.col(f"`{b}|max`").cast("double").alias("max"), F.col(f"`{b}|out`").alias("n_out_of_range"))
            for b in present]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


# Expected band value ranges of the reference (36 bands).
BAND_RANGES = {
    "Albedo_inst": (4.99, 82.25), "AvgSurfT_inst": (187.48, 1323.35), "CanopInt_inst": (0, 0.5),
    "ECanop_tavg": (0, 1273.66), "ESoil_tavg": (0, 2275.63), "Evap_tavg": (0, 0.002),
    "LWdown_f_tavg": (26.85, 600.9), "Lwnet_tavg": (-13792.7, 196.97), "PotEvap_tavg": (-227.75, 18977.9),
    "Psurf_f_inst": (44063.1, 108344), "Qair_f_inst": (-0.02, 0.07), "Qg_tavg": (-552.64, 1538.41),
    "Qh_tavg": (-1005.15, 18190.6), "Qle_tavg": (-227.75, 5072.25), "Qs_acc": (0, 170.93),
    "Qsb_acc": (0, 50.6), "Qsm_acc": (0, 42.87), "Rainf_f_tavg": (0, 0.01), "Rainf_tavg": (0, 0.01),
    "RootMoist_inst": (2, 949.6), "SWE_inst": (0, 120787), "SWdown_f_tavg": (-56.93, 30462.8),
    "SnowDepth_inst": (0, 301.96), "Snowf_tavg": (0, 0.009), "SoilMoi0_10cm_inst": (1.99, 47.59),
    "SoilMoi10_40cm_inst": (5.99, 142.8), "SoilMoi40_100cm_inst": (11.99, 285.6),
    "SoilMoi100_200cm_inst": (20, 476), "SoilTMP0_10cm_inst": (221.98, 377.5),
    "SoilTMP10_40cm_inst": (227.43, 319.44), "SoilTMP40_100cm_inst": (232.97, 316.2),
    "SoilTMP100_200cm_inst": (238.52, 314.11), "Swnet_tavg": (-48.96, 23741.3), "Tair_f_inst": (206.8, 327.66),
    "Tveg_tavg": (0, 3455.14), "Wind_f_inst": (0, 57.7),
}


def horizon_slice(df: DataFrame, month: str, last_month: int) -> DataFrame:
    """Only the features known by ``last_month`` (Feb..Aug cut-offs)."""
    return df.where(F.col(month) <= last_month)
