"""What describes a feed: column roles, types, bounds, clock and thresholds."""

from __future__ import annotations

from dataclasses import dataclass, field

# Fixed values of the feed's contract.
METRICS = {"D": "actual_demand_mwh", "DF": "day_ahead_forecast_mwh", "NG": "net_generation_mwh", "TI": "interchange_mwh"}
HARD_BOUNDS = {"D": (10_000.0, 300_000.0), "DF": (10_000.0, 300_000.0), "NG": (0.0, 300_000.0), "TI": (-100_000.0, 100_000.0)}
PUBLICATION_LAG_HOURS = {"D": 3, "DF": 5, "NG": 30, "TI": 30}
WEATHER_BOUNDS = {
    "temperature_c": (-60.0, 60.0),
    "apparent_temperature_c": (-75.0, 75.0),
    "dew_point_c": (-60.0, 45.0),
    "relative_humidity_pct": (0.0, 100.0),
    "wind_speed_kmh": (0.0, 500.0),
    "precipitation_mm": (0.0, 500.0),
}
WEATHER_VARIABLES = {
    "temperature_2m": "temperature_c",
    "apparent_temperature": "apparent_temperature_c",
    "dew_point_2m": "dew_point_c",
    "relative_humidity_2m": "relative_humidity_pct",
    "wind_speed_10m": "wind_speed_kmh",
    "precipitation": "precipitation_mm",
}
WEATHER_POINTS = {
    "chicago_comed": (41.88, -87.63),
    "philadelphia_peco": (39.95, -75.17),
    "washington_pepco": (38.90, -77.04),
    "baltimore_bge": (39.29, -76.61),
    "newark_pseg": (40.74, -74.17),
    "pittsburgh_duq": (40.44, -79.99),
    "cleveland_atsi": (41.50, -81.69),
    "richmond_dom": (37.54, -77.44),
}
DEGREE_DAY_BASE_C = 18.333333


@dataclass(frozen=True)
class FeedConfig:
    """Parameters of one hourly feed. The defaults are the electricity feed's."""

    tz: str = "America/New_York"
    metrics: dict[str, str] = field(default_factory=lambda: dict(METRICS))
    bounds: dict[str, tuple[float, float]] = field(default_factory=lambda: dict(HARD_BOUNDS))
    anomaly_ratio: float = 1.30
    record_ceiling: float = 165_563.0
    cutoff_local_hour: int = 10
    publication_lag_hours: dict[str, int] = field(default_factory=lambda: dict(PUBLICATION_LAG_HOURS))
    extreme_quantile: float = 0.95


DEFAULT = FeedConfig()
