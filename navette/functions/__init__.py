"""Column expressions: null rules, mode recoding, labels."""

from navette.functions.labels import legend_label, number_text, od_share_label, share_label
from navette.functions.modes import (
    MODE_COLUMNS,
    MODE_LABELS,
    MODES,
    mode_comparable,
    recode_mode,
)
from navette.functions.nulls import in_set, ratio, row_sum, wsum

__all__ = [
    "MODES",
    "MODE_COLUMNS",
    "MODE_LABELS",
    "in_set",
    "legend_label",
    "mode_comparable",
    "number_text",
    "od_share_label",
    "ratio",
    "recode_mode",
    "row_sum",
    "share_label",
    "wsum",
]
