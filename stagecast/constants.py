"""Values the results depend on, kept in one place. Operators take them as defaults."""

from datetime import date

# --- fixed values -----------------------------------------------------------
HORIZONS = (1, 6, 24, 48, 72)
HEADLINE_HORIZONS = (1, 6, 24)
QUANTILES = (0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95)
LOOKBACK_HOURS = 168
STAGE = "00065"
DISCHARGE = "00060"
NULL_SENTINELS = (-999999.0, -9999.0, -999.0)
BULLETIN_MISSING = ("M", "MSG", "-9999", "-9999.0")
ZONES = {
    "Z": "UTC",
    "E": "America/New_York",
    "C": "America/Chicago",
    "M": "America/Denver",
    "P": "America/Los_Angeles",
}
SEASONS = {
    "winter": (12, 1, 2),
    "spring": (3, 4, 5),
    "summer": (6, 7, 8),
    "autumn": (9, 10, 11),
}
# (name, first day, last day); no last day means up to the archive cutoff
SPLITS = (
    ("training", date(2007, 10, 1), date(2017, 12, 31)),
    ("validation", date(2018, 1, 1), date(2020, 12, 31)),
    ("calibration", date(2021, 1, 1), date(2023, 12, 31)),
    ("test", date(2024, 1, 1), None),
)
ARCHIVE_START = date(2007, 10, 1)
REQUIRED_CLUSTERS = {"training": 30, "validation": 10, "calibration": 10}
REQUIRED_EPISODES = {"training": 3, "calibration": 3}
RECONCILIATION_HOURS = {"frequent": 6, "nightly": 30 * 24, "monthly": 366 * 24}
# z offsets of the persistence interval, by quantile
PERSISTENCE_OFFSETS = {
    0.05: -1.64,
    0.10: -1.28,
    0.25: -0.67,
    0.50: 0.0,
    0.75: 0.67,
    0.90: 1.28,
    0.95: 1.64,
}
RIDGE_PENALTY = 1e-3
RIDGE_MODEL = "direct-ridge-stage-v1"
PERSISTENCE_MODEL = "persistence-damped-v1"
RELEASE_PROXIES = {"02089000": "02087183"}
# slug, name, target name, gauge id, forecast-point id, flood stage ft, latitude, longitude, river
BASINS = (
    ("cedar-ia", "Cedar, Iowa", "Cedar Rapids", "05464500", "CIDI4", 12.0, 41.971, -91.667, "Cedar River"),
    ("james-va", "James, Virginia", "Cartersville", "02035000", "CARV2", 20.0, 37.671, -78.086, "James River"),
    ("neuse-nc", "Neuse, North Carolina", "Goldsboro", "02089000", "GLDN7", 18.0, 35.337, -77.992, "Neuse River"),
)
# ----------------------------------------------------------------------------

SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE
DAY = 24 * HOUR
