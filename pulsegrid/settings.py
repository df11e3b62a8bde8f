"""Thresholds and durations. Every operator takes them as a parameter, so the same code runs at any time scale."""

from __future__ import annotations

from dataclasses import dataclass, field

# Names and their order, most severe first.
RISK_ORDER = ("high", "elevated_vitals", "elevated_labs", "normal")
STATUS_ORDER = ("critical", "warning", "no_signal", "normal")


@dataclass(frozen=True)
class Limits:
    """Fixed clinical and plausibility values."""

    patient_id: str = r"^P\d{3,}$"
    normal_heart_rate: tuple[int, int] = (60, 100)
    normal_spo2_from: float = 95.0
    normal_temperature_to: float = 37.5
    plausible_heart_rate: tuple[int, int] = (20, 250)
    plausible_spo2: tuple[float, float] = (50.0, 100.0)
    plausible_temperature: tuple[float, float] = (30.0, 45.0)
    plausible_pressure: tuple[int, int] = (30, 260)
    critical_spo2_below: float = 90.0
    critical_heart_rate_below: int = 50
    critical_heart_rate_above: int = 130
    critical_temperature_from: float = 39.0
    abnormal_share_from: float = 0.20


@dataclass(frozen=True)
class Times:
    """Durations of the live deployment: windows of 30 s every 10 s, simulated days of 120 s."""

    window: str = "30 seconds"
    slide: str = "10 seconds"
    watermark: str = "30 seconds"
    raw_trigger: str = "5 seconds"
    window_trigger: str = "10 seconds"
    day_seconds: int = 120
    grace_seconds: int = 10
    wait_seconds: int = 120
    max_age_seconds: int = 6 * 3600
    max_files: int = 5
    monitored_seconds: int = 120
    alert_active_seconds: int = 60
    no_signal_seconds: int = 120


@dataclass(frozen=True)
class Settings:
    limits: Limits = field(default_factory=Limits)
    times: Times = field(default_factory=Times)


DEFAULT = Settings()
