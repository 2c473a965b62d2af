"""Study parameters: sites, scenarios and the constants of the method.

Sites and scenarios are data.  Adding one adds a tuple here (or a row in the
caller's own list); no code path depends on a particular site.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Site:
    code: str
    name: str
    history: tuple[int, int]
    projection: tuple[int, int]
    training_year: int


@dataclass(frozen=True)
class Scenario:
    code: str
    label: str
    warming: float


# The two sites of the study.
SITES = (
    Site("jkt", "Jakarta", (1992, 2021), (2022, 2051), 2021),
    Site("smg", "Semarang", (1991, 2020), (2021, 2050), 2020),
)

# Emission scenarios with the bias added to their temperature (K).
SCENARIOS = (
    Scenario("26", "RCP 2.6", 1.0),
    Scenario("45", "RCP 4.5", 1.4),
    Scenario("85", "RCP 8.5", 2.0),
)

ZONE = "Asia/Jakarta"
SHIFT_YEARS = 30
SHIFT_DAYS = 10958  # 30 * 365.25 days and half a day, to the whole day
RESET_HOUR = 8  # local hour at which accumulated fluxes start again
DRY_MONTHS = (5, 10)  # first and last month of the dry season

WEATHER = ["dewpoint_temp", "temp", "ssrd", "precip", "wind_speed"]
DAILY_VARIABLES = ["hurs", "pr", "rsds", "sfcWind", "tas"]
RATIOS = {
    "dewpoint_temp": "ratio_dewpoint",
    "temp": "ratio_temp",
    "wind_speed": "ratio_wind_speed",
    "ssrd": "ratio_ssrd",
    "precip": "ratio_precip",
}
LAGGED = ["dewpoint_temp", "temp", "ssrd", "precip"]
FEATURES = LAGGED + [f"ph_{c}" for c in LAGGED] + ["dry", "xhour", "yhour"]
LABEL = "avg_cooling_load"

# Largest dimension table (rows) that joins may ask Spark to broadcast.
BROADCAST_ROWS = 100_000


def scenario_table(spark: SparkSession, scenarios: Iterable[Scenario] = SCENARIOS) -> DataFrame:
    """Scenarios as a local relation (no job, no Python row conversion)."""
    return spark.createDataFrame(pa.Table.from_pylist([asdict(s) for s in scenarios])).withColumnRenamed(
        "code", "scenario"
    )


def history_spans(sites: Iterable[Site] = SITES) -> dict[str, tuple[int, int]]:
    return {s.code: s.history for s in sites}


def projection_spans(sites: Iterable[Site] = SITES) -> dict[str, tuple[int, int]]:
    return {s.code: s.projection for s in sites}


def training_years(sites: Iterable[Site] = SITES) -> dict[str, int]:
    return {s.code: s.training_year for s in sites}
