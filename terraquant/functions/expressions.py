"""Pure Column -> Column expressions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Rounded for output, with negative zero normalised."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, digits) + F.lit(0.0)


def finite(c: Column | str) -> Column:
    """NaN becomes NULL, so aggregates skip it."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def to_number(column: str) -> Column:
    """Text to double; anything that is not a number becomes NULL."""
    return finite(F.expr(f"try_cast(`{column}` AS DOUBLE)"))


def litres_to_cubic_metres(column: str, default: float) -> Column:
    """Loading rate from L to m3, with a default where it is missing or unreadable."""
    return F.coalesce(to_number(column) / F.lit(1000.0), F.lit(default))


def flux_to_annual(log_flux: Column, hlr: Column, gwp: float, volume: float) -> Column:
    """Log10 areal flux (ug m-2 h-1) to annual t CO2-eq for a treated water volume (m3 yr-1).

    A day's flux over a day's water depth is a concentration in ug m-3; the rest is
    the warming potential, the volume, and ug -> t (1e12, taken in the order
    mg, g, t).
    """
    per_volume = F.pow(F.lit(10.0), log_flux) * F.lit(24.0) / hlr / F.lit(1000.0)
    return per_volume * F.lit(float(gwp)) / F.lit(1000.0) * F.lit(float(volume)) / F.lit(1_000_000.0)


def rename_by(label: Column | str, names: Iterable[tuple[str, str]]) -> Column:
    """Trimmed label replaced through a fixed lookup; unknown labels pass through."""
    label = F.col(label) if isinstance(label, str) else label
    trimmed = F.trim(label)
    pairs = [F.lit(x) for pair in names for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), trimmed), trimmed)


def flagged(column: str, focus: Sequence[str]) -> Column:
    return F.col(column).isin(list(focus))
