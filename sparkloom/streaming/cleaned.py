"""Fitted cleaning steps on a stream: what was learned from a batch is applied to rows as they come.

Only steps that are projections or filters can run so; steps that need the whole table (duplicates) can't.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..operators import clean


@dataclass
class Fitted:
    dropped: list[str] = field(default_factory=list)
    numeric_like: list[str] = field(default_factory=list)
    bounds: dict[str, tuple[float, float]] = field(default_factory=dict)
    signs: dict[str, str] = field(default_factory=dict)
    medians: dict[str, float] = field(default_factory=dict)
    modes: dict[str, str] = field(default_factory=dict)


def fit(df: DataFrame, settings: clean.Settings = clean.Settings()) -> Fitted:
    out = Fitted(dropped=clean.fit_high_null(df, settings.null_threshold))
    df = df.drop(*out.dropped)
    out.numeric_like = clean.fit_numeric_like(df, settings.numeric_share)
    df = clean.transform_numeric_like(df, out.numeric_like)
    out.bounds = clean.fit_iqr(df, settings.iqr_multiplier)
    df = clean.transform_iqr(df, out.bounds)
    out.signs = clean.fit_signs(df, settings.sign_share)
    df = clean.transform_signs(df, out.signs)
    out.medians, out.modes = clean.fit_medians(df), clean.fit_modes(df)
    return out


def transform(df: DataFrame, fitted: Fitted) -> DataFrame:
    """Works on a batch and on a stream alike: no step holds state."""
    df = clean.transform_numeric_like(df.drop(*fitted.dropped), fitted.numeric_like)
    df = clean.transform_signs(clean.transform_iqr(df, fitted.bounds), fitted.signs)
    return clean.transform_modes(clean.transform_medians(df, fitted.medians), fitted.modes)
