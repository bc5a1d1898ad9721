"""The final service calls as one-line functions over log DataFrames.

``state_times`` (A24), ``machine_alarms`` (B12 + B13), ``energy_consumption``
(E9) take a period as ``yyyy-MM-dd[ HH:mm:ss]`` strings (UTC, date-only
bounds cover whole days) and return DataFrames; ``dashboard_kpis`` combines
them (K2) and ``respond`` wraps a small result in the JSON envelope (I6).
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from machlog import config as C
from machlog.operators import activity as A
from machlog.operators import alarms as B
from machlog.operators import energy as E
from machlog.operators import kpi as K
from machlog.sources.logs import to_envelope


def state_times(fl: DataFrame, from_date: str, until_date: str, bucket_s: int = 1,
                low: float = C.FOUR_STATE_LOW, mid: float = C.FOUR_STATE_INTERMEDIATE) -> DataFrame:
    """Hours per state: True Idle (Off) gaps + Low / Intermediate / High Activity."""
    return A.four_state_totals(fl, from_date, until_date, bucket_s=bucket_s, low=low, mid=mid)


def machine_alarms(sl: DataFrame, from_date: str, until_date: str,
                   noise: list[str] | None = None) -> DataFrame:
    """Incidents and last start per (alarm_code, alarm_text), most frequent first."""
    inc = B.alarm_incidents(sl, from_date, until_date, noise=noise or C.NOISE_CODES)
    return B.alarm_statistics(inc)


def energy_consumption(fl: DataFrame, from_date: str, until_date: str,
                       var_id: int = C.ENERGY_VAR_FINAL) -> DataFrame:
    """kWh per day from the load-percent variable."""
    return E.daily_energy(fl, from_date, until_date, var_id=var_id)


def dashboard_kpis(fl: DataFrame, sl: DataFrame, from_date: str, until_date: str, bucket_s: int = 1,
                   low: float = C.FOUR_STATE_LOW, mid: float = C.FOUR_STATE_INTERMEDIATE,
                   load: DataFrame | None = None) -> DataFrame:
    """Total / active / idle hours, availability, kWh and alarm occurrences of one period.
    ``load`` is the log that holds the load-percent variable (default: ``fl``)."""
    return K.core_state_kpis(state_times(fl, from_date, until_date, bucket_s, low, mid),
                             energy_consumption(fl if load is None else load, from_date, until_date),
                             machine_alarms(sl, from_date, until_date))


def respond(df: DataFrame, from_date: str, until_date: str) -> DataFrame:
    """One-row JSON response for a small result (status, period, count, data)."""
    return to_envelope(df, from_date, until_date)
