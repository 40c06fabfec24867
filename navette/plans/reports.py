"""The three views of one group and one year, as tables ready for display.

Each takes the flow mart, so the choice of year and group prunes its scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from navette.functions.labels import legend_label
from navette.operators import classify, flows, od, ranking, shares
from navette.operators.lookup import Lookup


def matrix(mart: DataFrame, year: int, epci: str) -> DataFrame:
    """Modal share of every pair of communes, largest communes of residence first."""
    inside = flows.within(mart, year, epci)
    order = Lookup.of(ranking.order_lookup(ranking.commune_order(inside, "year"), "year"), "code")
    cells = shares.with_od_share_label(shares.share_of_total(inside, "resid_code", "work_code"))
    return ranking.in_display_order(ranking.with_display_order(cells, order, "year"), "year").select(
        "resid_code", "resid_name", "resid_position",
        "work_code", "work_name", "work_position",
        "mode", "flow", "total", "share", "label",
    )


def residence(mart: DataFrame, year: int, epci: str) -> DataFrame:
    """Modal share by commune of residence, trips inside the group."""
    inside = flows.within(mart, year, epci)
    return shares.with_share_label(shares.mode_shares(inside, "resid_code", "resid_name"))


def flow_map(mart: DataFrame, centroids: Lookup, year: int, epci: str) -> DataFrame:
    """Undirected lines with total, both shares, their classes and legend texts."""
    inside = flows.within(mart, year, epci)
    lines = od.desire_lines(
        od.with_shares(od.od_oneway_from_flows(inside, "year")), centroids, "code_a", "code_b"
    )
    shown = ["code_a", "code_b", "line", "total"]
    for kind in ("active", "sustainable"):
        share = F.col(f"share_{kind}")
        lines = lines.withColumns(
            {
                f"class_{kind}": classify.fixed_class(share, classify.SHARE_BREAKS),
                f"label_{kind}": legend_label(share),
            }
        )
        shown += [f"share_{kind}", f"class_{kind}", f"label_{kind}"]
    return lines.select(*shown)
