"""Token budgets of images."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def vision_tokens(w: Column, h: Column, max_px: int, patch: int = 14, merge: int = 2, min_px: int = 3136, proc_max_px: int = 12845056) -> Column:
    """Tokens of an image: shrunk to max_px, sides rounded to whole units, and
    scaled into the processor's bounds where they fall outside."""
    unit = patch * merge
    shrink = F.least(F.lit(1.0), F.sqrt(F.lit(float(max_px)) / (w * h)))
    w0, h0 = F.greatest(F.lit(1.0), F.floor(w * shrink).cast("double")), F.greatest(F.lit(1.0), F.floor(h * shrink).cast("double"))
    wr, hr = (F.greatest(F.lit(float(unit)), F.rint(v / unit) * unit) for v in (w0, h0))
    over, under = F.sqrt(w0 * h0 / proc_max_px), F.sqrt(F.lit(float(min_px)) / (w0 * h0))

    def fit(v: Column, r: Column) -> Column:
        return (
            F.when(wr * hr > proc_max_px, F.greatest(F.lit(float(unit)), F.floor(v / over / unit) * unit))
            .when(wr * hr < min_px, F.ceil(v * under / unit) * unit)
            .otherwise(r)
        )

    return (fit(w0, wr) / unit * (fit(h0, hr) / unit)).cast("bigint")
