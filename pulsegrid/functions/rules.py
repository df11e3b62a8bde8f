"""Rules as column expressions; one definition for batch and stream."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from pulsegrid.settings import DEFAULT, RISK_ORDER, Limits

LIMITS = DEFAULT.limits


def sure(condition: Column) -> Column:
    """A condition that counts as false where it's unknown."""
    return F.coalesce(condition, F.lit(False))


def once(value: Column) -> Column:
    """The same value, worked out once for each row: explode of one element.

    A filter on columns that come from a costly expression would else be moved before it, with the expression in each of
    its conditions.
    """
    return F.explode(F.array(value))


#: Parts of a unit in which measurements are added up, the greatest measurement that is, and how far arithmetic may have
#: left it beside such a part (36.1 + 0.2 isn't 36.3), as a share of it.
GRID, MOST, NOISE = 1e6, 1e4, 2.0**-50


def mean(name: str) -> Column:
    """The mean of a column of measurements, the same in whatever order and parts the rows come.

    A floating-point sum depends on that order, which tips a mean that lies on a limit. Values of up to six decimals (and
    the last bits' noise) are added up as whole numbers of millionths, which is exact, and divided once, so that the mean
    is rounded once; others (and very large ones) are added up as they are.
    """
    x = F.col(name).cast("double")
    parts = F.rint(x * GRID)
    fits = (F.abs(x) <= MOST) & (F.abs(parts / GRID - x) <= F.abs(x) * NOISE)
    whole, rest, n = F.sum(F.when(fits, parts.cast("long"))), F.sum(F.when(~fits, x)), F.count(x)
    return F.when(rest.isNull(), F.try_divide(whole, n * GRID)).otherwise((F.coalesce(whole, F.lit(0)) / GRID + rest) / n)


def checks(limits: Limits = LIMITS) -> dict[str, Column]:
    """What a plausible reading fulfils, by code."""
    return {
        "patient_id": F.col("patient_id").rlike(limits.patient_id),
        "event_time": F.col("event_time").isNotNull(),
        "heart_rate": F.col("heart_rate").between(*limits.plausible_heart_rate),
        "spo2": F.col("spo2").between(*limits.plausible_spo2),
        "temperature": F.col("temperature").between(*limits.plausible_temperature),
        "systolic_bp": F.col("systolic_bp").between(*limits.plausible_pressure),
        "diastolic_bp": F.col("diastolic_bp").between(*limits.plausible_pressure),
        "pressure_order": F.col("systolic_bp") > F.col("diastolic_bp"),
    }


def reject_reasons(limits: Limits = LIMITS) -> Column:
    """Why a reading isn't plausible: an array of codes, empty for a valid reading. Unknown values are reasons."""
    return F.filter(F.array(*(F.when(~sure(ok), F.lit(code)) for code, ok in checks(limits).items())), lambda x: x.isNotNull())


def plausible(limits: Limits = LIMITS) -> Column:
    """Whether there is no such reason; without the array of reasons, so that a filter stays in generated code."""
    return sure(reduce(and_, checks(limits).values()))


def abnormal(limits: Limits = LIMITS) -> Column:
    """Outside the normal range; boundaries are normal, unknown values aren't abnormal."""
    low, high = limits.normal_heart_rate
    return sure(
        ~F.col("heart_rate").between(low, high) | (F.col("spo2") < limits.normal_spo2_from) | (F.col("temperature") > limits.normal_temperature_to)
    )


def concerning(limits: Limits = LIMITS) -> Column:
    """Vitals of a period that give concern: a high share of abnormal readings, or a mean outside the normal range."""
    low, high = limits.normal_heart_rate
    shifted = (
        ~F.col("avg_heart_rate").between(low, high)
        | (F.col("avg_spo2") < limits.normal_spo2_from)
        | (F.col("avg_temperature") > limits.normal_temperature_to)
    )
    return sure((F.col("total_readings") > 0) & ((F.col("abnormal_ratio") >= limits.abnormal_share_from) | shifted))


def risk_flag(vitals: Column, labs: Column) -> Column:
    high, by_vitals, by_labs, normal = RISK_ORDER
    return F.when(vitals & labs, high).when(vitals, by_vitals).when(labs, by_labs).otherwise(normal)


def rank_in(order: tuple[str, ...], value: Column) -> Column:
    """Place of a name in a fixed order, from 1; unknown names come last."""
    place = F.array_position(F.array(*map(F.lit, order)), value)
    return F.when(F.coalesce(place, F.lit(0)) == 0, len(order) + 1).otherwise(place).cast("int")


def breach_reasons(limits: Limits = LIMITS) -> Column:
    """Why a window alerts: structs (code, value), critical ones if there are any, else the count of abnormal readings."""
    reason = lambda code, value: F.struct(F.lit(code).alias("code"), value.cast("double").alias("value"))
    spo2, rate, temperature = F.col("avg_spo2"), F.col("avg_heart_rate"), F.col("avg_temperature")
    critical = F.filter(
        F.array(
            F.when(spo2 < limits.critical_spo2_below, reason("spo2_low", spo2)),
            F.when(rate < limits.critical_heart_rate_below, reason("heart_rate_low", rate)),
            F.when(rate > limits.critical_heart_rate_above, reason("heart_rate_high", rate)),
            F.when(temperature >= limits.critical_temperature_from, reason("temperature_high", temperature)),
        ),
        lambda x: x.isNotNull(),
    )
    warning = F.when(F.col("abnormal_count") > 0, F.array(reason("abnormal_readings", F.col("abnormal_count"))))
    return F.when(F.size(critical) > 0, critical).otherwise(warning)


def severity(reasons: Column) -> Column:
    """critical, warning, or null where nothing alerts."""
    code = F.element_at(reasons, 1)["code"]
    return F.when(code == "abnormal_readings", "warning").when(code.isNotNull(), "critical")
