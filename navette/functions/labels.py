"""Texts shown with shares and legends."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# The labels of a share over two lines, and what stands for a missing value.
SHARE_LABEL = "Part modale : %s %% \nTrajets : %s / %s"
OD_SHARE_LABEL = "%s \nPart modale : %s %%\nTrajets : %s / %s"
MISSING_TEXT = "NA"


def number_text(value: Column, digits: int = 0) -> Column:
    """Rounded number without a trailing ``.0``; a missing number reads ``NA``."""
    if digits == 0:
        text = F.round(value, 0).cast("bigint").cast("string")
    else:
        text = F.format_string(f"%.{digits}f", F.round(value, digits))
        text = F.when(value.isNotNull(), F.regexp_replace(text, r"\.0+$", ""))
    return F.coalesce(text, F.lit(MISSING_TEXT))


def share_label(part: Column, total: Column, share: Column) -> Column:
    """Share in percent, then trips out of all trips."""
    return F.format_string(SHARE_LABEL, number_text(share * 100, 1), number_text(part), number_text(total))


def od_share_label(mode: Column, part: Column, total: Column, share: Column) -> Column:
    """The matrix form of the label: the mode first, then share and trips."""
    shown = F.coalesce(mode, F.lit(MISSING_TEXT))
    return F.format_string(OD_SHARE_LABEL, shown, number_text(share * 100, 1), number_text(part), number_text(total))


def legend_label(value: Column) -> Column:
    """A legend entry: numbers above 1 as they are, shares as whole percents.

    Percents are rounded half to even, as C-style number formatting does.
    """
    percent = F.concat(F.bround(value * 100, 0).cast("bigint").cast("string"), F.lit(" %"))
    as_is = F.regexp_replace(F.format_string("%.6f", value), r"\.?0+$", "")
    return F.when(value > 1, as_is).when(value.isNotNull(), percent)
