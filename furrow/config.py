"""Configuration: fixed domain values and the analysis settings.

Everything a stage needs (names, maps, thresholds, feature lists) lives in an
``AnalysisConfig``. Two presets exist: ``PRODUCE`` for the real produce feeds
and ``DRIVER`` for the TPC-H-style test tables (see ``sources.testmap``).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

# ---------------------------------------------------------------------------
# FIXED VALUES — these must equal the published analysis for equal results.
# ---------------------------------------------------------------------------

# Shipment feed: raw district spelling -> standard spelling (unmatched kept).
SHIPMENT_NAME_FIX = [
    ("Salinas-watsonville", "Salinas-Watsonville"),
    ("Salinas-watsonville California", "Salinas-Watsonville"),
    ("Salinas Valley California", "Salinas Valley"),
    ("Imperial Valley District", "Imperial Valley"),
    ("Imperial Valley California", "Imperial Valley"),
    ("Oxnard District", "Oxnard"),
    ("Oxnard District California", "Oxnard"),
    ("Santa Maria California", "Santa Maria"),
    ("San Joaquin Valley District", "San Joaquin Valley"),
    ("San Joaquin Valley California", "San Joaquin Valley"),
    ("Central San Joaquin Valley", "Central San Joaquin Valley"),
    ("Central San Joaquin Valley California", "Central San Joaquin Valley"),
    ("Coachella Valley", "Coachella Valley"),
    ("Coachella Valley California", "Coachella Valley"),
    ("Palo Verde Valley", "Palo Verde Valley"),
    ("Palo Verde Valley California", "Palo Verde Valley"),
    ("Kern District", "Kern"),
    ("Central Arizona", "Central Arizona"),
    ("Western Arizona", "Western Arizona"),
]

# Panel: shipment district -> panel district (unmatched dropped).
SHIPMENT_DISTRICT_MAP = [
    ("Western Arizona", "Western Arizona"),
    ("Central Arizona", "Western Arizona"),
    ("Salinas-Watsonville", "Salinas-Watsonville"),
    ("Salinas Valley", "Salinas-Watsonville"),
    ("Santa Maria", "Santa Maria"),
    ("Imperial Valley", "Imperial Valley"),
    ("Coachella Valley", "Imperial Valley"),
    ("Palo Verde Valley", "Imperial Valley"),
    ("Oxnard", "Oxnard"),
    ("Central San Joaquin Valley", "San Joaquin Valley"),
    ("San Joaquin Valley", "San Joaquin Valley"),
    ("Kern", "San Joaquin Valley"),
]

# Panel: price report district -> panel district (unmatched dropped).
PRICE_DISTRICT_MAP = [
    ("WESTERN ARIZONA", "Western Arizona"),
    ("SALINAS-WATSONVILLE CALIFORNIA", "Salinas-Watsonville"),
    ("SANTA MARIA CALIFORNIA", "Santa Maria"),
    ("IMPERIAL VALLEY CALIFORNIA", "Imperial Valley"),
    ("IMPERIAL, COACHELLA AND PALO VERDE VALLEYS CALIFORNIA", "Imperial Valley"),
    ("IMPERIAL AND COACHELLA VALLEYS CALIFORNIA", "Imperial Valley"),
    ("IMPERIAL AND PALO VERDE VALLEYS CALIFORNIA", "Imperial Valley"),
    ("COACHELLA VALLEY CALIFORNIA", "Imperial Valley"),
    ("OXNARD DISTRICT CALIFORNIA", "Oxnard"),
    ("SOUTH AND CENTRAL DISTRICT CALIFORNIA", "San Joaquin Valley"),
    ("CENTRAL SAN JOAQUIN VALLEY CALIFORNIA", "San Joaquin Valley"),
    ("SAN JOAQUIN VALLEY CALIFORNIA", "San Joaquin Valley"),
    ("KERN DISTRICT CALIFORNIA", "San Joaquin Valley"),
]

# Price ingest keeps only these report districts.
PRICE_KEEP_DISTRICTS = [
    "WESTERN ARIZONA",
    "SALINAS-WATSONVILLE CALIFORNIA",
    "SANTA MARIA CALIFORNIA",
    "SOUTH AND CENTRAL DISTRICT CALIFORNIA",
    "IMPERIAL VALLEY CALIFORNIA",
    "IMPERIAL, COACHELLA AND PALO VERDE VALLEYS CALIFORNIA",
    "IMPERIAL AND COACHELLA VALLEYS CALIFORNIA",
    "IMPERIAL AND PALO VERDE VALLEYS CALIFORNIA",
    "OXNARD DISTRICT CALIFORNIA",
    "CENTRAL SAN JOAQUIN VALLEY CALIFORNIA",
    "SAN JOAQUIN VALLEY CALIFORNIA",
    "KERN DISTRICT CALIFORNIA",
    "COACHELLA VALLEY CALIFORNIA",
]

# Weather station -> panel district.
WEATHER_LOCATIONS = [
    # (location, lat, lon, elev, district)
    ("yuma_az", 32.6927, -114.6277, 42, "Western Arizona"),
    ("salinas_ca", 36.6744, -121.6550, 16, "Salinas-Watsonville"),
    ("imperial_ca", 32.8421, -115.5694, -18, "Imperial Valley"),
    ("oxnard_ca", 34.1975, -119.1771, 13, "Oxnard"),
    ("santa_maria_ca", 34.9530, -120.4357, 66, "Santa Maria"),
    ("san_joaquin_ca", 36.7378, -119.7871, 94, "San Joaquin Valley"),
]

MAIN_COMMODITIES = [
    "Lettuce, Iceberg",
    "Lettuce, Romaine",
    "Lettuce, Green Leaf",
    "Lettuce, Red Leaf",
    "Lettuce, Boston",
]

CORE_DISTRICTS = ["Salinas-Watsonville", "Western Arizona", "Imperial Valley"]
AZ_DISTRICTS = ["Western Arizona"]

# Price defaults for absent columns in a report file.
PRICE_COLUMN_DEFAULTS = [
    ("variety", "N/A"),
    ("package", ""),
    ("item_size", ""),
    ("organic", "N"),
    ("low_price", ""),
    ("high_price", ""),
    ("mostly_low_price", ""),
    ("mostly_high_price", ""),
    ("market_tone_comments", ""),
    ("supply_tone_comments", ""),
    ("demand_tone_comments", ""),
    ("commodity_comments", ""),
]
PRICE_DEDUP_KEY = ["report_date", "district", "commodity", "variety", "package",
                   "item_size", "organic"]

# Weather thresholds (deg C, mm / week).
HEAT_DAY_BASE = 40.0
FREEZE_DAY_BASE = 0.0
EXTREME_HEAT_ABOVE = 40.0
FREEZE_RISK_BELOW = 0.0
HEAVY_RAIN_ABOVE = 25.0

# Windows: (rows, minimum non-missing).
ROLL_WINDOW = (4, 2)
LABEL_WINDOW = (8, 4)
SPIKE_SD = 2.0
LOW_SUPPLY_SD = 1.5
LAGS = [1, 2, 4]

# Season months and transition weeks.
AZ_SEASON_MONTHS = [11, 12, 1, 2, 3]
CA_SEASON_MONTHS = [4, 5, 6, 7, 8, 9, 10]
QUARTER_MONTHS = {"q1": [1, 2, 3], "q2": [4, 5, 6], "q3": [7, 8, 9]}
TRANSITION_WEEKS = [(15, 20), (45, 50)]

# Back-test settings.
MIN_TRAIN_YEARS = 4
ROLLING_YEARS = 5
ROLLING_MIN_TRAIN = 50
PERIOD_MIN_ROWS = 30

# Coverage bins for error diagnostics: lower bound inclusive, upper exclusive.
COVERAGE_BINS = [
    (0.0, 0.5, "Very low (<0.5)"),
    (0.5, 0.7, "Low (0.5-0.7)"),
    (0.7, 0.85, "Medium (0.7-0.85)"),
    (0.85, 0.95, "High (0.85-0.95)"),
    (0.95, 1.01, "Very high (>0.95)"),
]
COVERAGE_BINS_3 = [
    (0.0, 0.7, "Low (<0.7)"),
    (0.7, 0.9, "Mid (0.7-0.9)"),
    (0.9, 1.01, "High (>0.9)"),
]

# Feature lists of the market price models.
WEATHER_NOW = ["tmax_avg", "tmin_avg", "ppt_total", "diurnal_range",
               "dd_heat", "dd_freeze", "heavy_rain"]
WEATHER_HIST = ["tmax_lag1", "tmax_lag2", "ppt_lag1",
                "tmax_avg_roll4_mean", "ppt_total_roll4_mean"]
MARKET_VARS = ["volume_lag1", "volume_lag2", "volume_roll4_mean",
               "coverage", "n_districts", "month", "week_of_year"]
PRICE_LAGS = ["price_lag1", "price_lag2", "price_lag4"]
CHANGE_FEATURES = WEATHER_NOW + WEATHER_HIST + MARKET_VARS
LEVEL_FEATURES = CHANGE_FEATURES + PRICE_LAGS

# Baseline in-sample specifications.
BASE_LAGS = ["price_lag1", "price_lag2", "price_lag4", "volume_lag1", "volume_lag2",
             "tmax_lag1", "tmax_lag2", "ppt_lag1"]
BASE_ROLLING = ["volume_roll4_mean", "tmax_avg_roll4_mean", "ppt_total_roll4_mean"]
BASE_CALENDAR = ["month", "week_of_year"]
BASE_OTHER = ["coverage", "n_districts"]
BASELINE_SPEC_1 = WEATHER_NOW + BASE_CALENDAR
BASELINE_SPEC_2 = WEATHER_NOW + BASE_LAGS + BASE_ROLLING + BASE_CALENDAR + BASE_OTHER

# Tree learner settings (trees, depth, step, row share, column share, min rows per leaf).
# The published boosted models also use leaf penalties L1 = 1.0 / L2 = 5.0
# (conservative) and L1 = 1.0 / L2 = 3.0 (imputation); Spark ML's GBT has no
# such penalty, so they are listed here but not applied.
BOOST_CONSERVATIVE = dict(trees=200, depth=3, step=0.03, rows=0.7, cols=0.7, min_leaf=10)
BOOST_DEEP = dict(trees=300, depth=5, step=0.05, rows=0.8, cols=0.8, min_leaf=5)
BOOST_IMPUTE = dict(trees=200, depth=4, step=0.05, rows=0.8, cols=0.8, min_leaf=5)
FOREST = dict(trees=500, depth=6, cols=0.7, min_leaf=10)
SEED = 42

# Volume models.
VOLUME_LEVEL_FEATURES = (WEATHER_NOW + WEATHER_HIST
                         + ["volume_lag1", "volume_lag2", "volume_roll4_mean"]
                         + BASE_CALENDAR + BASE_OTHER)
VOLUME_CHANGE_FEATURES = WEATHER_NOW + WEATHER_HIST + BASE_CALENDAR + BASE_OTHER

# District panel specifications.
DISTRICT_WEATHER_LAGS = ["tmax_lag1", "tmax_lag2", "ppt_lag1"]
DISTRICT_SEASON = ["q1", "q2", "q3"]
DISTRICT_INTERACT = ["az_winter", "az_spring"]
DISTRICT_MARKET = ["volume_lag1", "volume_change", "volume_roll4_mean"]
DISTRICT_TRANSITION = ["transition_week", "freeze_x_transition",
                       "heat_x_transition", "ppt_x_transition"]

# Missing-price model features (district dummies are added per district found).
IMPUTE_WEATHER = ["tmax_avg", "tmin_avg", "ppt_total", "diurnal_range",
                  "dd_heat", "dd_freeze", "heavy_rain", "tmax_lag1", "ppt_lag1"]
IMPUTE_VOLUME = ["volume", "volume_lag1", "volume_lag2", "volume_roll4"]
IMPUTE_SEASON = ["q1", "q2", "q3", "month", "week_of_year", "year"]

# Sequence model input.
SEQUENCE_LENGTH = 8

# Significance stars: (p below, stars), checked in order.
STARS = [(0.01, "***"), (0.05, "**"), (0.1, "*")]


def commodity_suffix(name: str, prefix: str = "") -> str:
    """'Lettuce, Green Leaf' -> 'green_leaf' (column-name normalisation)."""
    if prefix and name.startswith(prefix):
        name = name[len(prefix):]
    return re.sub(r"\s+", "_", name.strip()).lower()


@dataclass(frozen=True)
class AnalysisConfig:
    """All knobs of one analysis run."""

    commodities: tuple[str, ...]
    commodity_prefix: str
    main_series: str
    second_series: str
    core_districts: tuple[str, ...]
    az_districts: tuple[str, ...]
    partial_year: int
    extreme_year: int
    early_last_year: int
    periods: tuple[tuple[str, int, int], ...]
    organic_keep: str = "N"
    organic_flag: str = "Y"  # the early/late price profile skips only this flag
    price_early_last: int = 2015
    price_late_first: int = 2020
    min_train_years: int = MIN_TRAIN_YEARS
    rolling_years: int = ROLLING_YEARS
    rolling_min_train: int = ROLLING_MIN_TRAIN
    weighted_weather_rule: str = "reference"  # or "clean"

    def suffix(self, commodity: str) -> str:
        return commodity_suffix(commodity, self.commodity_prefix)

    def with_(self, **kw) -> "AnalysisConfig":
        return replace(self, **kw)


PRODUCE = AnalysisConfig(
    commodities=tuple(MAIN_COMMODITIES),
    commodity_prefix="Lettuce, ",
    main_series="Lettuce, Iceberg",
    second_series="Lettuce, Romaine",
    core_districts=tuple(CORE_DISTRICTS),
    az_districts=tuple(AZ_DISTRICTS),
    partial_year=2026,
    extreme_year=2022,
    early_last_year=2018,
    periods=(("2010-2015", 2010, 2015), ("2016-2020", 2016, 2020), ("2021-2026", 2021, 2026)),
)

# Test-table preset: p_type plays the commodity, region the district,
# 2001 the partial year (see FIXTURES.md section 3).
DRIVER = AnalysisConfig(
    commodities=("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"),
    commodity_prefix="",
    main_series="PROMO",
    second_series="STANDARD",
    core_districts=("ASIA", "AMERICA", "EUROPE"),
    az_districts=("AMERICA",),
    partial_year=2001,
    extreme_year=2000,
    early_last_year=1999,
    periods=(("1995-1996", 1995, 1996), ("1997-1998", 1997, 1998), ("1999-2001", 1999, 2001)),
    price_early_last=1996,
    price_late_first=2000,
)
