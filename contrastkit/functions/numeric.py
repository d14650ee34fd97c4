"""Numbers: units, censored labels, order statistics, signs and guards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A difference up to this is none.
EPS = 1e-12
#: Factors to nM by unit in lower case; both micro signs.
TO_NM = {"pm": 0.001, "nm": 1.0, "um": 1000.0, "µm": 1000.0, "μm": 1000.0, "umol/l": 1000.0}


def in_nm(value: Column, units: Column) -> Column:
    """The value in nM; null for other units or no number."""
    unit = F.lower(F.btrim(units))
    factor = F.coalesce(*[F.when(unit == name, F.lit(f)) for name, f in TO_NM.items()])
    number = value.try_cast("double")
    return F.when(unit == "pm", number / 1000.0).otherwise(number * factor)


def threshold_label(relation: Column, value: Column, threshold: float = 10.0) -> Column:
    """1 if the measured value is surely at or below the threshold, 0 if surely above, null if that is open.

    relation says on which side of `value` the truth lies.
    """
    t = F.lit(float(threshold))
    finite = ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))
    sure = (
        F.when(relation == "=", (value <= t).cast("int"))
        .when(relation.isin("<", "<=") & (value <= t), F.lit(1))
        .when((relation == ">") & (value >= t), F.lit(0))
        .when((relation == ">=") & (value > t), F.lit(0))
    )
    return F.when(finite, sure)


def floor_percentile(values: Column, q: float = 0.95) -> Column:
    """An aggregate: the sorted value at place floor(q * (n - 1)), without interpolation."""
    ordered = F.array_sort(F.collect_list(values))
    return F.get(ordered, F.floor((F.size(ordered) - 1) * F.lit(q)).cast("int"))


def linear_percentile(values: Column, q: float) -> Column:
    """An aggregate: the exact percentile, interpolated at q * (n - 1)."""
    return F.percentile(values, F.lit(q))


def sign(x: Column) -> Column:
    """-1, 0 or 1, with a dead zone of EPS; null is 0."""
    return F.when(F.abs(x) <= EPS, 0).when(x > 0, 1).when(x < 0, -1).otherwise(0)


def enum_order(column: Column, order: Sequence[str]) -> Column:
    """A sort key: declared places first, then all others by code point."""
    place = F.coalesce(*[F.when(column == name, F.lit(k)) for k, name in enumerate(order)], F.lit(len(order)))
    return F.struct(place.alias("place"), column.alias("name"))


def int_or(column: Column, default: int) -> Column:
    return F.coalesce(column.try_cast("int"), F.lit(default))


def clamped(p: Column, margin: float = 1e-15) -> Column:
    return F.least(F.greatest(p, F.lit(margin)), F.lit(1 - margin))


def ratio(a: Column, b: Column) -> Column:
    """a / b in double precision; null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))
