"""Functions of one value. What is not finite becomes a gap."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import SeriesFrame

V = "value"


def fn_abs(sf: SeriesFrame) -> SeriesFrame:
    return sf.values(F.abs(V))


def fn_log2(sf: SeriesFrame) -> SeriesFrame:
    return sf.values(F.log2(F.when(F.col(V) > 0, F.col(V))))


def fn_log10(sf: SeriesFrame) -> SeriesFrame:
    return sf.values(F.log10(F.when(F.col(V) > 0, F.col(V))))


def fn_ceil(sf: SeriesFrame) -> SeriesFrame:
    return sf.values(F.ceil(V))


def fn_floor(sf: SeriesFrame) -> SeriesFrame:
    return sf.values(F.floor(V))


def fn_round(sf: SeriesFrame, digits: int = 0) -> SeriesFrame:
    """Half away from zero, after scaling by a power of ten; numbers from 1e16 on stay as they are."""
    if not 0 <= digits <= 15:
        raise ValueError("digits: 0 to 15")
    scaled = F.col(V) * float(10**digits)
    away = F.signum(scaled) * F.floor(F.abs(scaled) + 0.5)
    return sf.values(F.when(F.abs(V) >= 1e16, F.col(V)).otherwise(away / float(10**digits) + 0.0))


def fn_clamp_min(sf: SeriesFrame, bound: float) -> SeriesFrame:
    return sf.values(F.greatest(F.col(V), F.lit(float(bound))))


def fn_clamp_max(sf: SeriesFrame, bound: float) -> SeriesFrame:
    return sf.values(F.least(F.col(V), F.lit(float(bound))))


def fn_cutoff_min(sf: SeriesFrame, bound: float) -> SeriesFrame:
    return sf.with_df(sf.df.where(F.col(V) >= bound))


def fn_cutoff_max(sf: SeriesFrame, bound: float) -> SeriesFrame:
    return sf.with_df(sf.df.where(F.col(V) <= bound))
