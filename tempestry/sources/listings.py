"""Fields of file names, as columns: scene listings, overpass files and near-real-time granules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempestry.functions.columns import one_decimal

GRANULE = r"(\d{8})-S(\d{6})-E(\d{6})"


def _nonempty(x: Column) -> Column:
    return F.when(x != "", x)


def product_fields(name: Column) -> tuple[Column, Column, Column]:
    """The words of a product's name, those of a satellite's file (environment_product_satellite_start_end_created),
    and its start. Tenths of a second are dropped."""
    fields = F.split(F.element_at(F.split(name, "/"), -1), "_")
    start = F.get(fields, F.lit(3))
    start = F.when(start.startswith("s"), F.try_to_timestamp(F.substring(start, 2, 13), F.lit("yyyyDDDHHmmss")))
    return F.split(F.get(fields, F.lit(1)), "-"), F.get(fields, F.lit(2)), start


def scene(name: Column) -> Column:
    """struct of sector, band, satellite, start of a radiance file: instrument-level-Rad<sector>-M<mode>C<band>."""
    product, satellite, start = product_fields(name)
    kind, channel = F.get(product, F.lit(2)), F.get(product, F.lit(3))
    band = F.element_at(F.split(channel, "C"), -1).try_cast("int")
    ok = kind.startswith("Rad") & channel.startswith("M") & satellite.startswith("G") & band.isNotNull()
    return F.when(
        ok, F.struct(F.substring(kind, 4, 2).alias("sector"), band.alias("band"), satellite.alias("satellite"), start.alias("start"))
    )


def lightning(name: Column) -> Column:
    """struct of satellite and start of a lightning file: instrument-level-LCFA."""
    product, satellite, start = product_fields(name)
    ok = F.get(product, F.lit(2)) == "LCFA"
    return F.when(ok, F.struct(satellite.alias("satellite"), start.alias("start")))


def radar_scan(name: Column) -> Column:
    """struct of station and time of a radar volume: four letters, date, underscore, time."""
    stem = F.element_at(F.split(name, "/"), -1)
    fields = F.split(F.substring(stem, 5, 40), "_")
    day, clock = F.get(fields, F.lit(0)), F.substring(F.get(fields, F.lit(1)), 1, 6)
    time = F.when(F.length(day) == 8, F.try_to_timestamp(F.concat(day, clock), F.lit("yyyyMMddHHmmss")))
    return F.when(time.isNotNull(), F.struct(F.substring(stem, 1, 4).alias("station"), time.alias("time")))


def sensor_of(name: Column) -> Column:
    """The sensor that a file's name speaks of, the first of these; NULL if of none."""
    upper = F.upper(name)
    has = lambda *words: sum((upper.contains(w).cast("int") for w in words), F.lit(0)) > 0
    return F.when(has("SSMIS"), "SSMIS").when(has("WSFM", "MWI"), "WSFM").when(has("GMI"), "GMI")


def channels(long_name: Column) -> Column:
    """map from a channel's number to its frequency and polarisation, of a long name "1) 10.65 GHz V-Pol and ..."."""
    pattern = r"(\d+)\)\s*([0-9.]+)\s*GHz\s*([VH])-?Pol"
    part = lambda k: F.regexp_extract_all(long_name, F.lit(pattern), F.lit(k))
    entries = F.transform(
        F.arrays_zip(part(1).alias("i"), part(2).alias("f"), part(3).alias("p")),
        lambda x: F.struct(
            x["i"].cast("int").alias("i"), F.struct(x["f"].cast("double").alias("ghz"), x["p"].alias("polarisation"))
        ),
    )
    return F.map_from_entries(entries)


def overpass_file(name: Column) -> Column:
    """struct of basin, storm_num, season, instrument, platform, granule, start; NULL for other and environment files."""
    p = F.split(F.regexp_replace(name, r"\.nc$", ""), "_")
    storm = p[2]
    ok = (F.size(p) == 7) & (p[0] == "TCPRIMED") & (F.length(storm) == 8) & (p[3] != "era5")
    return F.when(ok, F.struct(F.substring(storm, 1, 2).alias("basin"), F.substring(storm, 3, 2).try_cast("int").alias("storm_num"), F.substring(storm, 5, 4).try_cast("int").alias("season"), p[3].alias("instrument"), p[4].alias("platform"), p[5].alias("granule"), F.try_to_timestamp(p[6], F.lit("yyyyMMddHHmmss")).alias("start")))


def granule(name: Column) -> Column:
    """struct of start and end of a granule name; an end before the start is on the next day."""
    part = lambda k: F.regexp_extract(name, GRANULE, k)
    start = F.try_to_timestamp(F.concat(part(1), part(2)), F.lit("yyyyMMddHHmmss"))
    end = F.try_to_timestamp(F.concat(part(1), part(3)), F.lit("yyyyMMddHHmmss"))
    return F.when(part(1) != "", F.struct(start.alias("start"), F.when(end < start, end + F.expr("INTERVAL 1 DAY")).otherwise(end).alias("end")))


def hour_prefixes(start: Column, end: Column, product: str) -> Column:
    """Hourly folder names between two times, to prune a listing by."""
    hours = F.sequence(F.date_trunc("hour", start), F.date_trunc("hour", end), F.expr("INTERVAL 1 HOUR"))
    return F.transform(hours, lambda h: F.concat(F.lit(product + "/"), F.date_format(h, "yyyy/DDD/HH")))


def links(pages: DataFrame, text: str = "value") -> DataFrame:
    """href: the distinct links of an HTML listing read as text."""
    return pages.select(F.explode(F.regexp_extract_all(text, F.lit(r'href="([^"?/][^"]*)"'), 1)).alias("href")).distinct()


def human_bytes(n: Column, largest: str = "TB") -> Column:
    """Sizes in steps of 1024, one decimal from KB on; larger ones stay in the largest unit."""
    units = ("KB", "MB", "GB", "TB")
    units = units[: units.index(largest) + 1]
    text = lambda k, unit: F.concat(one_decimal(n / float(1024**k)), F.lit(f" {unit}"))
    out = F.when(n < 1024, F.format_string("%d B", n))
    for k, unit in enumerate(units[:-1], 1):
        out = out.when(n < 1024 ** (k + 1), text(k, unit))
    return out.when(n.isNotNull(), text(len(units), units[-1]))
