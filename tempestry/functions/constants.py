"""Fixed values of the domain: published instrument, orbit and colour-table constants and fitted coefficients."""

# Kilometres per degree, each used where its operator was calibrated with it.
KM_DEG_DISTANCE, KM_DEG_OFFSET, KM_DEG_WEIGHT = 111.32, 111.2, 111.0
NM_KM, EARTH_KM, EARTH_MI = 1.852, 6371.0, 3958.8

# GRS80 ellipsoid and geostationary orbit (metres), spherical counterparts (km).
R_EQ_M, R_POL_M, ORBIT_M = 6378137.0, 6356752.31414, 42164160.0
ORBIT_KM = 42164.0

# Polarisation-corrected temperature coefficients, standalone and in the composites' red.
PCT_THETA = {37: 1.15, 89: 0.70}
RED_THETA = {37: 1.181, 89: 0.818}
RED_RANGE = {37: (260.0, 280.0), 89: (220.0, 310.0)}
# Green and blue of the composites by channel and range.
GREEN_BLUE = {37: (("v", 180.0, 300.0), ("h", 160.0, 300.0)), 89: (("h", 240.0, 300.0), ("v", 270.0, 290.0))}

# Colour segments (from, to, start colour, end colour) of the single-channel products.
SEGMENTS = {
    "h37": [
        (125.0, 180.0, (255, 255, 224), (139, 0, 139)), (180.0, 195.0, (128, 0, 127), (0, 128, 255)), (195.0, 210.0, (0, 128, 255), (58, 185, 255)),
        (210.0, 220.0, (58, 185, 255), (125, 253, 255)), (220.0, 230.0, (125, 253, 255), (128, 255, 130)), (230.0, 240.0, (128, 255, 130), (255, 255, 128)),
        (240.0, 260.0, (255, 255, 128), (255, 128, 0)), (260.0, 280.0, (255, 128, 0), (128, 0, 0)), (280.0, 310.0, (192, 192, 192), (0, 0, 0)),
    ],
    "h89": [
        (105.0, 180.0, (255, 255, 255), (0, 0, 0)), (180.0, 212.0, (164, 100, 26), (252, 6, 3)), (212.0, 228.0, (244, 205, 3), (242, 244, 3)),
        (228.1, 254.0, (140, 243, 3), (15, 181, 3)), (254.1, 280.0, (6, 220, 253), (7, 8, 181)), (280.0, 305.0, (0, 0, 128), (255, 255, 255)),
    ],
    "pct37": [(230.0, 240.0, (0, 255, 255), (255, 255, 0)), (240.0, 260.0, (255, 255, 0), (255, 0, 0)), (260.0, 280.0, (255, 0, 0), (139, 0, 0))],
    "pct89": [
        (105.0, 125.0, (255, 165, 0), (210, 105, 30)), (125.0, 150.0, (210, 105, 30), (205, 92, 92)), (150.0, 175.0, (205, 92, 92), (178, 34, 34)),
        (175.0, 212.0, (178, 34, 34), (255, 0, 0)), (212.0, 230.0, (255, 215, 0), (255, 255, 0)), (230.0, 250.0, (0, 255, 0), (50, 205, 50)),
        (250.0, 265.0, (0, 191, 255), (0, 0, 255)), (265.0, 280.0, (0, 0, 128), (106, 90, 205)),
    ],
}

# Plausible ranges of the microwave channels.
BOUNDS = {"v37": (130.0, 310.0), "h37": (80.0, 300.0), "v89": (150.0, 310.0), "h89": (90.0, 300.0)}

# Satellites, their sub-points and the spans in which they were operational.
SATELLITES = [
    ("GOES-16", -75.2, "2017-07-10", "2025-04-07"), ("GOES-19", -75.2, "2025-04-07", "2100-01-01"),
    ("GOES-17", -137.0, "2019-02-12", "2023-01-10"), ("GOES-18", -137.0, "2023-01-10", "2100-01-01"),
]

# Wind sensitivity (K per m/s), its cap (K) and the moisture swing (K) by frequency and polarisation.
WIND_SLOPE = {(37, "v"): 0.25, (37, "h"): 0.75, (89, "v"): 0.20, (89, "h"): 0.50}
WIND_CAP = {(37, "v"): 18.0, (37, "h"): 50.0, (89, "v"): 14.0, (89, "h"): 35.0}
MOISTURE_SWING = {(37, "v"): 10.0, (37, "h"): 22.0, (89, "v"): 8.0, (89, "h"): 16.0}
AMBIENT_MS, RANKINE, SATURATION = 7.0, 0.5, 0.75

# Freezing level (km) by latitude; ring width and envelope scale by intensity.
FREEZING = [(0.0, 4.9), (15.0, 4.7), (25.0, 4.3), (35.0, 3.6), (45.0, 2.9)]
RING_WIDTH = [(20.0, 1.30), (60.0, 1.00), (100.0, 0.75), (140.0, 0.55), (180.0, 0.45)]
ENVELOPE_KM = [(20.0, 150.0), (60.0, 220.0), (100.0, 300.0), (140.0, 380.0), (180.0, 420.0)]

# Fitted lever curves over intensity (kt) by lever and channel.
CURVE_KNOTS = (20.0, 45.0, 70.0, 95.0, 125.0)
CURVES = {
    "dep": {"v37": (-1.00, -1.00, -1.00, -0.96, -0.91), "h37": (-1.00, -1.00, -1.00, -0.99, -0.98), "v89": (0.52, -0.16, -0.43, 0.09, 0.34), "h89": (0.33, -0.16, -0.38, 0.26, 0.66)},
    "em": {"v37": (0.16, -0.17, -0.04, 0.21, 0.12), "h37": (-0.02, -0.18, -0.08, 0.07, -0.01), "h89": (-1.00, -1.00, -1.00, -1.00, -1.00)},
    "out": {"v37": (-1.00, -1.00, -1.00, -0.98, -0.96), "h37": (-1.00, -1.00, -1.00, -1.00, -1.00), "v89": (3.00, 1.91, 1.05, 0.98, 0.98), "h89": (2.89, 1.72, 0.93, 0.94, 1.01)},
    "far": {"v89": (3.00, 3.00, 2.82, 1.78, 0.49), "h89": (3.00, 3.00, 2.67, 1.51, 0.20)},
    "aem": {"v37": (0.04, 0.24, 0.36, 0.19, 0.16), "h37": (0.07, 0.26, 0.38, 0.21, 0.20)},
    "adep": {"v89": (0.07, 0.31, 0.37, 0.36, 0.37), "h89": (0.05, 0.34, 0.42, 0.40, 0.40)},
}
#: Weights of the sources in a fused field.
FUSION = {"goes": 0.1, "mw": 0.3, "radar": 0.6}

# Footprints (km across, km along) of the microwave sensors by frequency; full width at half maximum.
FOOTPRINT_KM = {
    "GMI": {37: (8.6, 14.0), 89: (4.4, 7.2)},
    "AMSR2": {37: (7.0, 12.0), 89: (3.0, 5.0)},
    "AMSR3": {37: (7.0, 12.0), 89: (3.0, 5.0)},
    "SSMIS": {37: (27.5, 44.2), 89: (13.1, 14.4)},
    "WSFM": {37: (27.5, 44.2), 89: (13.1, 14.4)},
}
# Exponent of the convective response by frequency, and the smoothing (km) of its 37 GHz form.
RESPONSE_POWER = {37: 0.70, 89: 1.35}
LIQUID_KM = 12.0
# Downshear-left centre (degrees from the shear), bound of a calibration offset (K), widening of a spread.
ASYMMETRY_DEG, OFFSET_BOUND_K, SPREAD_DEFAULT = 315.0, 40.0, 1.95
