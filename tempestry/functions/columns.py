"""Column -> Column formulas: clipping and ramps, geometry, time, microwave products, surface and radial terms."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tempestry.functions import constants as K

Number = Column | float


def lit(x: Number) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def clip(x: Column, low: Number, high: Number) -> Column:
    """x within [low, high]; NULL stays NULL, though greatest and least skip it."""
    return F.when(x.isNotNull(), F.greatest(lit(low), F.least(lit(high), x)))


def ramp(x: Column, start: Number, end: Number) -> Column:
    """0 at start, 1 at end, clipped; start may be the larger."""
    return clip((x - lit(start)) / (lit(end) - lit(start)), 0, 1)


def interpolate(x: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """Piecewise linear through the knots, constant beyond them."""
    out = F.when(x <= knots[0][0], knots[0][1])
    for (x0, y0), (x1, y1) in zip(knots, knots[1:], strict=False):
        out = out.when(x <= x1, y0 + (x - x0) / (x1 - x0) * (y1 - y0))
    return out.when(x.isNotNull(), knots[-1][1])


def wrap180(lon: Column) -> Column:
    """Longitude in [-180, 180)."""
    return F.pmod(lon + 180, F.lit(360.0)) - 180


def lon_delta(start: Column, end: Column) -> Column:
    """Shortest signed way from start to end, in degrees."""
    return wrap180(end - start)


def seconds(t: Column) -> Column:
    """Seconds since 1970 of a timestamp, with or without zone (UTC), as double."""
    return F.unix_micros(t.cast("timestamp")) / 1e6


def hours_between(start: Column, end: Column) -> Column:
    return (seconds(end) - seconds(start)) / 3600


def distance_km(lat: Column, lon: Column, lat0: Number, lon0: Number, per_degree: float = K.KM_DEG_DISTANCE) -> Column:
    """Equirectangular about (lat0, lon0), safe at the date line."""
    dy = (lat - lit(lat0)) * per_degree
    dx = lon_delta(lit(lon0), lon) * per_degree * F.cos(F.radians(lit(lat0)))
    return F.sqrt(dx * dx + dy * dy)


def haversine(lat0: Column, lon0: Column, lat1: Column, lon1: Column, radius: float = K.EARTH_KM) -> Column:
    a = F.pow(F.sin(F.radians(lat1 - lat0) / 2), 2) + F.cos(F.radians(lat0)) * F.cos(F.radians(lat1)) * F.pow(F.sin(F.radians(lon1 - lon0) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(clip(a, 0, 1)))


def bearing(dlat: Column, dlon: Column) -> Column:
    """Compass bearing of a small displacement in degrees."""
    return F.pmod(F.degrees(F.atan2(dlon, dlat)) + 360, F.lit(360.0))


def central_angle(lat: Column, lon: Column, sub_lon: Number) -> Column:
    """Degrees between a point and a sub-satellite point on the equator."""
    return F.degrees(F.acos(clip(F.cos(F.radians(lat)) * F.cos(F.radians(lon - lit(sub_lon))), -1, 1)))


def zenith_angle(lat: Column, lon: Column, sub_lon: Number) -> Column:
    """Satellite zenith angle in degrees, over a sphere."""
    c = F.radians(central_angle(lat, lon, sub_lon))
    return F.degrees(F.atan2(F.sin(c), F.cos(c) - K.EARTH_KM / K.ORBIT_KM))


def solar_elevation(lat: Column, lon: Column, t: Column) -> Column:
    """Degrees above the horizon from the fractional year (Fourier series of the equation of time and declination)."""
    hour = F.hour(t) + F.minute(t) / 60.0 + F.second(t) / 3600.0
    g = 2 * F.pi() / 365 * (F.dayofyear(t) - 1 + (hour - 12) / 24)
    equation = 229.18 * (0.000075 + 0.001868 * F.cos(g) - 0.032077 * F.sin(g) - 0.014615 * F.cos(2 * g) - 0.040849 * F.sin(2 * g))
    declination = 0.006918 - 0.399912 * F.cos(g) + 0.070257 * F.sin(g) - 0.006758 * F.cos(2 * g) + 0.000907 * F.sin(2 * g) - 0.002697 * F.cos(3 * g) + 0.00148 * F.sin(3 * g)
    angle = F.radians((hour * 60 + equation + 4 * lon) / 4 - 180)
    up = F.sin(F.radians(lat)) * F.sin(declination) + F.cos(F.radians(lat)) * F.cos(declination) * F.cos(angle)
    return F.degrees(F.asin(clip(up, -1, 1)))


def scan_angles(lat: Column, lon: Column, sub_lon: float) -> tuple[Column, Column, Column]:
    """Fixed-grid x and y (radians) of a geodetic point, and whether the satellite sees it."""
    ratio = K.R_EQ_M**2 / K.R_POL_M**2
    ecc = 1 - K.R_POL_M**2 / K.R_EQ_M**2
    c = F.atan(F.tan(F.radians(lat)) / ratio)
    r = K.R_POL_M / F.sqrt(1 - ecc * F.cos(c) * F.cos(c))
    d = F.radians(lon - sub_lon)
    sx = K.ORBIT_M - r * F.cos(c) * F.cos(d)
    sy = -r * F.cos(c) * F.sin(d)
    sz = r * F.sin(c)
    visible = K.ORBIT_M * (K.ORBIT_M - sx) >= sy * sy + ratio * sz * sz
    return F.asin(-sy / F.sqrt(sx * sx + sy * sy + sz * sz)), F.atan(sz / sx), visible


def scan_to_geodetic(x: Column, y: Column, sub_lon: float) -> tuple[Column, Column]:
    """Latitude and longitude of fixed-grid angles; NULL off the disk."""
    ratio = K.R_EQ_M**2 / K.R_POL_M**2
    a = F.pow(F.sin(x), 2) + F.pow(F.cos(x), 2) * (F.pow(F.cos(y), 2) + ratio * F.pow(F.sin(y), 2))
    b = -2 * K.ORBIT_M * F.cos(x) * F.cos(y)
    root = b * b - 4 * a * (K.ORBIT_M**2 - K.R_EQ_M**2)
    r = F.when(root >= 0, (-b - F.sqrt(root)) / (2 * a))
    sx, sy, sz = r * F.cos(x) * F.cos(y), -r * F.sin(x), r * F.cos(x) * F.sin(y)
    lat = F.degrees(F.atan(ratio * sz / F.sqrt((K.ORBIT_M - sx) * (K.ORBIT_M - sx) + sy * sy)))
    return lat, sub_lon - F.degrees(F.atan(sy / (K.ORBIT_M - sx)))


def cloud_top_km(ir: Column) -> Column:
    return clip((300 - ir) / 6.5, 0, 17)


def inverse_planck(radiance: Column, fk1: float, fk2: float, bc1: float, bc2: float) -> Column:
    """Brightness temperature; NULL for a radiance that isn't positive."""
    return F.when(radiance > 0, (fk2 / F.log(fk1 / radiance + 1) - bc1) / bc2)


def pct(v: Column, h: Column, theta: float) -> Column:
    return (1 + theta) * v - theta * h


def redness(v: Column, h: Column, frequency: int) -> Column:
    low, high = K.RED_RANGE[frequency]
    return ramp(pct(v, h, K.RED_THETA[frequency]), high, low)


def byte(x: Column) -> Column:
    """0 to 1 as 0 to 255, truncated."""
    return F.floor(x * 255).cast("int")


def composite(v: Column, h: Column, frequency: int) -> tuple[Column, Column, Column]:
    """Red, green and blue, 0 to 255."""
    channel = {"v": v, "h": h}
    return (byte(redness(v, h, frequency)), *(byte(ramp(channel[c], low, high)) for c, low, high in K.GREEN_BLUE[frequency]))


def segment_colour(x: Column, product: str) -> Column:
    """(r, g, b), 0 to 1, of the first closed segment that holds x; end colours beyond, black in gaps and for NULL."""
    rgb = lambda c: F.array(*(F.lit(v / 255) for v in c))
    table = K.SEGMENTS[product]
    out = F.when(x < table[0][0], rgb(table[0][2])).when(x > table[-1][1], rgb(table[-1][3]))
    for low, high, start, end in table:
        out = out.when(x.between(low, high), F.array(*(a / 255 + (x - low) / (high - low) * (b / 255 - a / 255) for a, b in zip(start, end, strict=True))))
    return out.otherwise(rgb((0, 0, 0)))


def pack(tb: Column) -> Column:
    """Kelvin in steps of 0.01 as 1 to 65535; 0 is missing or not positive."""
    return F.coalesce(F.when(tb > 0, F.least(F.lit(65535), F.rint(tb / 0.01).cast("int"))), F.lit(0))


def unpack(packed: Column) -> Column:
    return F.when(packed > 0, packed * 0.01)


def scattering(ir: Column, warm: float = 273.0) -> Column:
    return ramp(ir, warm, 185)


def vapour_mask(wv: Column, ir: Column) -> Column:
    return 1 - clip((wv - ir) / 25, 0, 1)


def convective(ir: Column, wv: Column, texture: Number = 0.0) -> Column:
    return clip((0.25 + 0.60 * vapour_mask(wv, ir)) * scattering(ir) + 0.15 * lit(texture), 0, 1)


def rmw_km(rmw_nm: Column, vmax: Column, lat: Column) -> Column:
    """Radius of maximum wind; by intensity and latitude where the track has none (or zero)."""
    return F.coalesce(F.when(rmw_nm != 0, rmw_nm * K.NM_KM), 46.29 * F.exp(-0.0153 * vmax + 0.0166 * F.abs(lat)))


def tilted_radius(rmw: Column) -> Column:
    return rmw + F.least(F.lit(10.0), 0.35 * rmw)


def ring_width(rmw: Column, vmax: Column) -> Column:
    return clip(interpolate(vmax, K.RING_WIDTH) * rmw, 8, 60)


def envelope_km(vmax: Column, roci: Column) -> Column:
    return F.coalesce(clip(0.55 * roci, 80, 600), interpolate(vmax, K.ENVELOPE_KM))


def radial_weight(r: Column, rmw: Column, vmax: Column, roci: Column, width: Column | None = None, scale: Column | None = None) -> Column:
    """Ring about the tilted eyewall, exponential envelope and a suppressed eye; width and scale where they are known already."""
    width = ring_width(rmw, vmax) if width is None else width
    scale = envelope_km(vmax, roci) if scale is None else scale
    ring = F.exp(-0.5 * F.pow((r - tilted_radius(rmw)) / width, 2))
    eye = 1 - ramp(vmax, 50, 130) * F.exp(-0.5 * F.pow(r / (0.35 * rmw + 1e-6), 2))
    return clip((0.55 * ring + 0.65 * F.exp(-r / scale)) / 1.20 * eye, 0, 1)


def surface_wind(r: Column, vmax: Column, rmw: Column) -> Column:
    """Modified Rankine profile in m/s over an ambient wind."""
    peak = vmax * 0.514444
    wind = F.when(r <= rmw, peak * r / rmw).otherwise(peak * F.pow(rmw / F.greatest(r, F.lit(1e-6)), K.RANKINE))
    return F.greatest(F.lit(K.AMBIENT_MS), wind)


def roughening(wind: Column, frequency: int, polarisation: str, land: Column) -> Column:
    key = (frequency, polarisation)
    return clip(K.WIND_SLOPE[key] * (wind - K.AMBIENT_MS), 0, K.WIND_CAP[key]) * (1 - land)


def moisture(wv: Column, frequency: int, polarisation: str, land: Column) -> Column:
    return (ramp(wv, 250, 225) - 0.5) * K.MOISTURE_SWING[frequency, polarisation] * (1 - land)


def saturate(response: Column) -> Column:
    return (1 - F.exp(-K.SATURATION * clip(response, 0, 1))) / (1 - F.exp(F.lit(-K.SATURATION)))


def ice_depth(lat: Column) -> Column:
    return clip(interpolate(F.abs(lat), K.FREEZING) / 4.9, 0.5, 1)


def age_confidence(hours: Column) -> Column:
    """1 to 1.5 h, then linear to 0.15 at 6 h and beyond."""
    return F.when(hours <= 1.5, 1.0).when(hours >= 6, 0.15).otherwise(1 - (hours - 1.5) / 4.5 * 0.85)


def crossfade_confidence(minutes: Column) -> Column:
    """Towards a pass that comes in so many minutes: 1 at hand, 0 from an hour on."""
    return F.when(minutes <= 0, 1.0).when(minutes >= 60, 0.0).otherwise(1 - minutes / 60)


def gain(lever: str, channel: str, vmax: Column) -> Column:
    """A lever's fitted curve at an intensity; 0 for a channel without one."""
    curve = K.CURVES[lever].get(channel)
    return interpolate(vmax, [*zip(K.CURVE_KNOTS, curve, strict=True)]) if curve else F.lit(0.0)


def novelty_scale(sigma: Column) -> Column:
    return F.when(sigma <= 1, 1.0).when(sigma >= 2.5, 0.25).otherwise(1 - (sigma - 1) / 1.5 * 0.75)


def intensity_band(vmax: Column) -> Column:
    return F.when(vmax < 34, "TD").when(vmax < 64, "TS").when(vmax < 96, "C1-2").otherwise("C3-5")


def shear_asymmetry(dx: Column, dy: Column, lat0: Column, shear_deg: Column) -> Column:
    """1 downshear left of the centre, -1 upshear right; 0 without a shear heading and in the south."""
    off = F.radians(F.degrees(F.atan2(dx, dy)) - shear_deg - K.ASYMMETRY_DEG)
    return F.when(shear_deg.isNull() | (lat0 < 0), 0.0).otherwise(F.cos(off))


def footprint_sigma(km: Column, spacing_km: Column) -> Column:
    """Gaussian sigma in pixels of a footprint's width; 0 where it's half a pixel or less."""
    sigma = km / (2 * math.sqrt(2 * math.log(2))) / spacing_km
    return F.when(sigma > 0.5, sigma).otherwise(0.0)


def spread_widening(measured: Column) -> Column:
    return F.when(measured > 0, clip(measured, 1.0, 6.0)).otherwise(K.SPREAD_DEFAULT)


def one_decimal(x: Column) -> Column:
    """x in text as C's printf("%.1f") has it: by the exact binary value, halves to even. Java's format rounds the shortest
    decimal that names the value, halves up: 2.15, in truth a little less, becomes 2.2 there and 2.1 here."""
    a, b = 8 * x, 2 * x  # exact, and so is total + rest, the tenfold
    total = a + b
    part = total - a
    rest = (a - (total - part)) + (b - part)
    tenfold = F.when((total - F.floor(total) == 0.5) & (rest != 0), F.floor(total) + (rest > 0).cast("int")).otherwise(F.rint(total))
    return F.when(x.isNotNull(), F.format_string("%.1f", tenfold / 10))


def hours_text(h: Column) -> Column:
    minutes = F.concat(F.round(h * 60, 0).cast("long").cast("string"), F.lit(" min"))
    return F.when(h < 1, minutes).otherwise(F.format_string("%.1f h", F.round(h, 1)))
