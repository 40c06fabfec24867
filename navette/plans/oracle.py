"""SQL counterparts of the registered queries, for an independent engine.

Shares use the totals-and-join form, undirected pairs the union form and so on:
another formulation than the operators have, so the comparison checks both.
"""

from __future__ import annotations

EPCI = "EUROPE"
YEAR = 1997
COMMUNE = "3"

PRELUDE = f"""
WITH flux AS (
  SELECT CAST(c_nationkey AS VARCHAR) AS resid_code,
         CAST(s_nationkey AS VARCHAR) AS work_code,
         l_quantity AS weight,
         CAST(l_linenumber AS VARCHAR) AS mode_code,
         CAST(year(o_orderdate) AS INTEGER) AS year
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey
),
moded AS (
  SELECT *,
         CASE mode_code WHEN '1' THEN 'Aucun' WHEN '2' THEN 'Marche' WHEN '3' THEN 'Vélo'
                        WHEN '4' THEN 'Moto' WHEN '5' THEN 'Voiture' WHEN '6' THEN 'TC'
                        ELSE mode_code END AS mode
  FROM flux
),
registry AS (
  SELECT CAST(n_nationkey AS VARCHAR) AS code, n_name AS name, r_name AS epci
  FROM nation JOIN region ON n_regionkey = r_regionkey
),
centroids AS (
  SELECT CAST(n_nationkey AS VARCHAR) AS code,
         CAST(-5 + 0.5 * n_nationkey AS DECIMAL(9,6)) AS lon,
         CAST(42 + 0.25 * n_nationkey AS DECIMAL(9,6)) AS lat
  FROM nation
),
members AS (SELECT code, name FROM registry WHERE epci = '{EPCI}'),
labelled AS (
  SELECT m.*, r.name AS resid_name, r.epci AS resid_epci, w.name AS work_name, w.epci AS work_epci
  FROM moded m
  LEFT JOIN registry r ON m.resid_code = r.code
  LEFT JOIN registry w ON m.work_code = w.code
),
touching AS (
  SELECT m.year, r.code AS resid_code, r.name AS resid_name,
         w.code AS work_code, w.name AS work_name, m.mode, m.weight,
         m.resid_code AS any_resid_code, m.work_code AS any_work_code
  FROM moded m
  LEFT JOIN members r ON m.resid_code = r.code
  LEFT JOIN members w ON m.work_code = w.code
  WHERE m.resid_code IN (SELECT code FROM members) OR m.work_code IN (SELECT code FROM members)
),
touching_all AS (
  SELECT resid_epci AS epci, year, resid_code, resid_name,
         CASE WHEN work_epci = resid_epci THEN work_code END AS work_code, mode, weight
  FROM labelled
  UNION ALL
  SELECT work_epci, year, NULL, NULL, work_code, mode, weight
  FROM labelled WHERE work_epci <> resid_epci
),
intra AS (
  SELECT resid_epci AS epci, year, resid_code, resid_name, work_code, work_name, mode, weight
  FROM labelled WHERE resid_epci = work_epci
)
"""


def _num(value: str) -> str:
    return f"CAST(CAST(round({value}, 0) AS BIGINT) AS VARCHAR)"


def _pct(value: str) -> str:
    return rf"regexp_replace(printf('%.1f', round({value} * 100, 1)), '\.0$', '')"


def _shares(source: str, keys: list[str], names: list[str]) -> str:
    """Aggregate, totals in a second aggregate, null-safe join of both."""
    k = ", ".join(keys)
    picked = ", ".join(f"a.{c}" for c in keys + names)
    same = " AND ".join(f"a.{c} IS NOT DISTINCT FROM t.{c}" for c in keys)
    grouped = ", ".join(keys + names)
    return f"""
, a AS (SELECT {grouped}, mode, sum(weight) AS flow FROM {source} GROUP BY {grouped}, mode),
t AS (SELECT {k}, sum(weight) AS total FROM {source} GROUP BY {k})
SELECT {picked}, a.mode, a.flow, t.total, a.flow / t.total AS share
FROM t LEFT JOIN a ON {same}
"""


def _labels(source: str, keys: list[str], names: list[str], shown: str, label: str) -> str:
    return f"{_with(_shares(source, keys, names))} SELECT {shown}, {label} AS label FROM s"


def _with(select: str) -> str:
    """Turn ``, a AS (..), t AS (..) SELECT ..`` into a CTE named s."""
    head, tail = select.split("\nSELECT ", 1)
    return f"{head}, s AS (SELECT {tail})"


MODE_SUMS = """
  sum(weight) FILTER (WHERE mode = 'Aucun') AS aucun,
  sum(weight) FILTER (WHERE mode = 'Marche') AS marche,
  sum(weight) FILTER (WHERE mode = 'Vélo') AS velo,
  sum(weight) FILTER (WHERE mode = 'Moto') AS moto,
  sum(weight) FILTER (WHERE mode = 'Voiture') AS voiture,
  sum(weight) FILTER (WHERE mode = 'TC') AS tc,
  sum(weight) FILTER (WHERE mode IS NULL OR mode NOT IN
    ('Aucun', 'Marche', 'Vélo', 'Moto', 'Voiture', 'TC')) AS other
"""

MODE_COLUMNS = ["aucun", "marche", "velo", "moto", "voiture", "tc", "other"]

WIDE = f"""
, wide AS (
  SELECT year, resid_code, resid_name, work_code, work_name, {MODE_SUMS}, sum(weight) AS total
  FROM touching GROUP BY ALL
),
pairs AS (
  SELECT * FROM wide
  WHERE resid_code IS NOT NULL AND work_code IS NOT NULL AND resid_code <> work_code
)
"""

ONEWAY = f"""
, both_ways AS (
  SELECT year, resid_code AS code_a, work_code AS code_b, {", ".join(MODE_COLUMNS)}, total FROM pairs
  UNION ALL
  SELECT year, work_code, resid_code, {", ".join(MODE_COLUMNS)}, total FROM pairs
),
oneway AS (
  SELECT year, code_a, code_b,
         {", ".join(f"coalesce(sum({c}), 0) AS {c}" for c in MODE_COLUMNS)}, sum(total) AS total
  FROM both_ways WHERE code_a < code_b GROUP BY year, code_a, code_b
)
"""

ONEWAY_ALL = """
, both_ways AS (
  SELECT year, epci, resid_code AS code_a, work_code AS code_b, mode, weight FROM intra
  UNION ALL
  SELECT year, epci, work_code, resid_code, mode, weight FROM intra
),
oneway AS (
  SELECT year, epci, code_a, code_b, sum(weight) AS total,
         coalesce(sum(weight) FILTER (WHERE mode IN ('Vélo', 'Marche')), 0) / sum(weight)
           AS share_active,
         coalesce(sum(weight) FILTER (WHERE mode IN ('Vélo', 'Marche', 'TC')), 0) / sum(weight)
           AS share_sustainable
  FROM both_ways WHERE code_a < code_b GROUP BY ALL
)
"""

MEASURES = """
, home AS (SELECT year, resid_code AS code, sum(weight) AS domicile FROM moded GROUP BY ALL),
jobs AS (SELECT year, work_code AS code, sum(weight) AS travail FROM moded GROUP BY ALL),
measures AS (
  SELECT coalesce(h.year, j.year) AS year, coalesce(h.code, j.code) AS code, domicile, travail
  FROM home h FULL OUTER JOIN jobs j ON h.year = j.year AND h.code = j.code
),
commune AS (
  SELECT shown.year, epci, registry.code, name, domicile, travail
  FROM registry CROSS JOIN (SELECT DISTINCT year FROM flux) shown
  LEFT JOIN measures ON registry.code = measures.code AND shown.year = measures.year
)
"""


def _line(a: str, b: str) -> str:
    return (
        f"'LINESTRING (' || {a}.lon || ' ' || {a}.lat || ', ' || {b}.lon || ' ' || {b}.lat || ')'"
    )


def _bins(value: str, limits: list[str]) -> str:
    last = len(limits) - 1
    cases = " ".join(
        f"WHEN {value} >= {limits[i]} AND {value} < {limits[i + 1]} THEN {i + 1}"
        for i in range(last)
    )
    return f"CAST(CASE {cases} WHEN {value} = {limits[last]} THEN {last} END AS INTEGER)"


FLOW_LIMITS = ["100", "7500", "15000", "30000", "60000", "120000", "180000", "200000"]
SHARE_LIMITS = [f"CAST({i / 10} AS DOUBLE)" for i in range(11)]


def _legend(value: str) -> str:
    return (
        rf"CASE WHEN {value} > 1 THEN regexp_replace(printf('%.6f', {value}), '\.?0+$', '') "
        f"WHEN {value} IS NOT NULL THEN CAST(CAST(round_even({value} * 100, 0) AS BIGINT) AS VARCHAR) || ' %' END"
    )


RESIDENT = "any_resid_code IN (SELECT code FROM members)"
WORKER = "any_work_code IN (SELECT code FROM members)"

STATS = f"""
, stats AS (
  SELECT any_work_code AS work_code,
         count(*) FILTER (WHERE {RESIDENT}) AS n_resid,
         count(*) FILTER (WHERE {WORKER}) AS n_work,
         count(*) FILTER (WHERE {RESIDENT} AND {WORKER}) AS n_both,
         count(*) FILTER (WHERE NOT ({RESIDENT}) AND {WORKER}) AS n_work_not_resid
  FROM touching GROUP BY any_work_code
)
"""

MART = """
SELECT year, resid_code, work_code, mode, count(*) AS n_obs, sum(weight) AS flow,
       resid_name, resid_epci, work_name, work_epci
FROM labelled GROUP BY ALL
"""

# the mart of the survey rows as corrected: weights of mode code 3 raised, homes of one commune withdrawn
CORRECTED = """
SELECT year, resid_code, work_code, mode, count(*) AS n_obs,
       sum(weight + CASE WHEN mode_code = '3' THEN 1 ELSE 0 END) AS flow,
       resid_name, resid_epci, work_name, work_epci
FROM labelled WHERE resid_code IS DISTINCT FROM '7' AND year IS NOT NULL
GROUP BY year, resid_code, work_code, mode, resid_name, resid_epci, work_name, work_epci
"""

SHARE_LABEL = (
    f"'Part modale : ' || {_pct('share')} || ' % ' || chr(10) || 'Trajets : ' || "
    f"{_num('flow')} || ' / ' || {_num('total')}"
)
OD_SHARE_LABEL = (
    f"mode || ' ' || chr(10) || 'Part modale : ' || {_pct('share')} || ' %' || chr(10) || "
    f"'Trajets : ' || {_num('flow')} || ' / ' || {_num('total')}"
)

CHOSEN = f"(FROM intra WHERE year = {YEAR} AND epci = '{EPCI}')"
PAIR_NAMES = ["resid_name", "work_name"]

SELECTS = {
    # sources and sinks
    "scan_flux_subset": "SELECT resid_code, work_code, weight, mode_code FROM flux",
    "scan_flux_trimmed": """
SELECT resid_code, '0' || work_code AS abroad_code, lpad(resid_code, 2, '0') AS region_code, weight
FROM flux""",
    "scan_mode_labels": "SELECT mode_code, mode, count(*) AS n_obs FROM moded GROUP BY ALL",
    "ingest_years_union": """
SELECT resid_code, work_code, weight, mode_code, year, mode, TRUE AS mode_comparable FROM moded""",
    "scan_zip_member": "SELECT resid_code, work_code, weight, mode_code FROM flux",
    "registry_scan": "SELECT code, name, epci FROM registry",
    "geojson_communes": """
SELECT code, name, epci, lon, lat, 'POINT (' || lon || ' ' || lat || ')' AS wkt
FROM centroids JOIN registry USING (code)""",
    "geojson_contours": """
, box AS (
  SELECT code, name, epci, i, lon - 0.125 + i AS w, lon + 0.125 + i AS e, lat - 0.125 AS s, lat + 0.125 AS n
  FROM centroids JOIN registry USING (code), range(2) t(i)
),
ring AS (
  SELECT code, name, epci, i, '((' || w || ' ' || s || ', ' || e || ' ' || s || ', ' || e || ' ' || n || ', '
         || w || ' ' || n || ', ' || w || ' ' || s || '))' AS text
  FROM (SELECT code, name, epci, i, w::DECIMAL(9,6) AS w, e::DECIMAL(9,6) AS e, s::DECIMAL(9,6) AS s, n::DECIMAL(9,6) AS n FROM box)
)
SELECT code, name, epci,
       CASE WHEN code::INT % 5 = 0 THEN 'MULTIPOLYGON (' || string_agg(text, ', ' ORDER BY i) || ')'
            ELSE 'POLYGON ' || min(text) FILTER (WHERE i = 0) END AS wkt
FROM ring GROUP BY code, name, epci""",
    "geojson_rejects": """
SELECT 'kind' AS reason, 'Point' AS kind, count(*) AS n FROM registry WHERE code::INT % 5 <> 0
UNION ALL SELECT 'code', 'Polygon', count(*) FROM registry WHERE code::INT % 6 = 0""",
    "mart_roundtrip": MART,
    "mart_pruned_scan": f"""
, mart AS ({MART})
SELECT * FROM mart WHERE year = {YEAR} AND resid_epci = '{EPCI}' AND work_epci = '{EPCI}'""",
    "mart_build_if_absent": MART,
    "mart_corrected": CORRECTED,
    "mart_corrected_compacted": CORRECTED,
    "mart_as_first_published": f"SELECT * FROM ({MART}) WHERE year IS NOT NULL",
    "enriched_roundtrip": "SELECT * FROM labelled",
    "enriched_pruned_scan": f"""
SELECT * FROM labelled WHERE year = {YEAR} AND resid_epci = '{EPCI}' AND work_epci = '{EPCI}'""",
    # registry, labels, selections
    "registry_slice": "SELECT code, name FROM members",
    "epci_choices": "SELECT DISTINCT epci FROM registry ORDER BY epci",
    "flux_labelled": """
SELECT resid_code, work_code, weight, mode_code, year, mode, TRUE AS mode_comparable,
       resid_name AS commune_residence, resid_epci AS epci_residence,
       work_name AS commune_travail, work_epci AS epci_travail
FROM labelled""",
    "recode_modes": """
SELECT year, mode_code, sum(weight) AS flow, count(*) AS n_obs, mode, TRUE AS mode_comparable
FROM moded GROUP BY year, mode_code, mode""",
    "flux_residents": "SELECT * FROM flux WHERE resid_code IN (SELECT code FROM members)",
    "flux_workers": "SELECT * FROM flux WHERE work_code IN (SELECT code FROM members)",
    "flux_epci_any": """
SELECT moded.resid_code, moded.work_code, weight, mode_code, year, mode,
       r.name AS resid_name, w.name AS work_name
FROM moded
LEFT JOIN members r ON moded.resid_code = r.code
LEFT JOIN members w ON moded.work_code = w.code
WHERE moded.resid_code IN (SELECT code FROM members)
   OR moded.work_code IN (SELECT code FROM members)""",
    "flux_epci_any_all": """
SELECT resid_epci AS epci, year, resid_code, work_code, weight, mode_code, resid_name, work_name
FROM labelled
UNION ALL
SELECT work_epci, year, resid_code, work_code, weight, mode_code, resid_name, work_name
FROM labelled WHERE work_epci <> resid_epci""",
    "flux_epci_intra": f"""
SELECT resid_code, work_code, weight, mode_code, mode, resid_name, work_name
FROM labelled WHERE year = {YEAR} AND resid_epci = '{EPCI}' AND work_epci = '{EPCI}'""",
    # aggregates
    "flow_mart": MART,
    "weighted_by_residence": """
SELECT year, resid_code, resid_name, sum(weight) AS flow FROM labelled GROUP BY ALL""",
    "weighted_by_work": """
SELECT year, work_code, work_name, sum(weight) AS flow FROM labelled GROUP BY ALL""",
    "weighted_by_residence_mode": """
SELECT year, resid_code, resid_name, mode, sum(weight) AS flow FROM labelled GROUP BY ALL""",
    "count_by_residence": """
SELECT year, resid_code, resid_name, count(*) AS n_obs FROM touching GROUP BY ALL""",
    "od_pair_totals": """
SELECT year, resid_code, work_code, resid_name, work_name, sum(weight) AS flow
FROM labelled GROUP BY ALL""",
    "od_mode_flows": """
SELECT year, resid_code, work_code, mode, resid_name, work_name, sum(weight) AS flow
FROM labelled GROUP BY ALL""",
    "membership_stats": f"{STATS} SELECT * FROM stats ORDER BY n_resid DESC, work_code",
    "top10_work_communes": f"""
{STATS}, top AS (SELECT * FROM stats ORDER BY n_resid DESC, work_code LIMIT 10)
SELECT top.*, registry.name AS work_name FROM top LEFT JOIN registry ON work_code = code""",
    "work_commune_residency": f"""
SELECT year, work_code, work_name, count(*) AS n_total,
       count(*) FILTER (WHERE {RESIDENT}) AS n_resident_in_epci,
       count(*) FILTER (WHERE NOT ({RESIDENT})) AS n_nonresident,
       count(*) FILTER (WHERE any_resid_code = any_work_code) AS n_own_commune,
       count(*) FILTER (WHERE NOT ({RESIDENT})) / CAST(count(*) AS DOUBLE) AS share_nonresident
FROM touching WHERE {WORKER} GROUP BY year, work_code, work_name""",
    "headline_counts": f"""
SELECT year, count(*) AS n_touching,
       count(*) FILTER (WHERE {RESIDENT}) AS n_residents,
       count(*) FILTER (WHERE {WORKER}) AS n_workers,
       count(*) FILTER (WHERE {RESIDENT} AND {WORKER}) AS n_both,
       count(*) FILTER (WHERE NOT ({RESIDENT}) AND {WORKER}) AS n_incoming
FROM touching GROUP BY year""",
    "top3_inflow": f"""
SELECT resid_code, resid_name, sum(weight) AS flow FROM labelled
WHERE work_code = '{COMMUNE}' AND resid_code <> '{COMMUNE}'
GROUP BY ALL ORDER BY flow DESC, resid_name LIMIT 3""",
    # shares
    "share_by_residence_mode": _shares("touching", ["year", "resid_code"], ["resid_name"]),
    "share_by_residence_mode_all": _shares(
        "touching_all", ["year", "epci", "resid_code"], ["resid_name"]
    ),
    "group_directions": """
, ends AS (
  SELECT year, resid_epci AS epci, CASE WHEN work_epci = resid_epci THEN 'inside' ELSE 'leaving' END AS way, weight
  FROM labelled WHERE resid_epci IS NOT NULL
  UNION ALL
  SELECT year, work_epci, 'entering', weight FROM labelled
  WHERE work_epci IS NOT NULL AND work_epci IS DISTINCT FROM resid_epci
)
SELECT year, epci, coalesce(sum(weight) FILTER (WHERE way = 'inside'), 0) AS inside,
       coalesce(sum(weight) FILTER (WHERE way = 'leaving'), 0) AS leaving,
       coalesce(sum(weight) FILTER (WHERE way = 'entering'), 0) AS entering
FROM ends GROUP BY year, epci""",
    "flow_mart_as_of": """
, moved AS (
  SELECT year, mode, weight, CASE
      WHEN resid_code = '24' AND year >= 1997 THEN '22' WHEN resid_code = '24' AND year >= 1994 THEN '23'
      WHEN resid_code = '23' AND year >= 1997 THEN '22' ELSE resid_code END AS resid_code, CASE
      WHEN work_code = '24' AND year >= 1997 THEN '22' WHEN work_code = '24' AND year >= 1994 THEN '23'
      WHEN work_code = '23' AND year >= 1997 THEN '22' ELSE work_code END AS work_code
  FROM moded
),
dated AS (
  SELECT n_nationkey::VARCHAR AS code, n_name AS name, y.year, r_name AS epci
  FROM nation, (SELECT DISTINCT year FROM moded) y, region
  WHERE r_regionkey = CASE WHEN y.year >= 1996 AND n_nationkey % 5 = 0 THEN (n_regionkey + 1) % 5 ELSE n_regionkey END
)
SELECT m.year, m.resid_code, m.work_code, m.mode, sum(weight) AS flow, count(*) AS n_obs,
       r.name AS resid_name, r.epci AS resid_epci, w.name AS work_name, w.epci AS work_epci
FROM moved m
LEFT JOIN dated r ON r.code = m.resid_code AND r.year = m.year
LEFT JOIN dated w ON w.code = m.work_code AND w.year = m.year
GROUP BY ALL""",
    "share_by_residence_mode_from_mart": _shares(
        "touching", ["year", "resid_code"], ["resid_name"]
    ),
    "share_by_residence_intra_all": _labels(
        "intra", ["year", "epci", "resid_code"], ["resid_name"], "*", SHARE_LABEL
    ),
    "share_by_work_mode": _shares("touching", ["year", "work_code"], ["work_name"]),
    "share_labels": _labels(
        "touching", ["year", "resid_code"], ["resid_name"], "year, resid_name, mode", SHARE_LABEL
    ),
    "od_mode_share": _shares("labelled", ["year", "resid_code", "work_code"], PAIR_NAMES),
    "od_mode_share_from_mart": _shares("labelled", ["year", "resid_code", "work_code"], PAIR_NAMES),
    "od_mode_share_all": _shares("intra", ["year", "epci", "resid_code", "work_code"], PAIR_NAMES),
    "od_mode_share_selected": _labels(
        CHOSEN,
        ["resid_code", "work_code"],
        PAIR_NAMES,
        "*",
        OD_SHARE_LABEL,
    ),
    "od_share_labels": _labels(
        "intra",
        ["year", "epci", "resid_code", "work_code"],
        PAIR_NAMES,
        "year, epci, resid_name, work_name, mode",
        OD_SHARE_LABEL,
    ),
    "commune_order": """
, per_commune AS (
  SELECT year, resid_epci AS epci, resid_code, resid_name, sum(weight) AS flow
  FROM labelled WHERE resid_name IS NOT NULL GROUP BY ALL
)
SELECT *, CAST(row_number() OVER (PARTITION BY year, epci ORDER BY flow DESC, resid_name)
               AS INTEGER) AS position
FROM per_commune""",
    "od_display_order": """
, per_commune AS (
  SELECT year, epci, resid_code AS code, resid_name, sum(weight) AS flow FROM intra GROUP BY ALL
),
ordered AS (
  SELECT year, epci, code,
         CAST(row_number() OVER (PARTITION BY year, epci ORDER BY flow DESC, resid_name)
              AS INTEGER) AS position
  FROM per_commune
),
cells AS (
  SELECT year, epci, resid_code, work_code, mode, sum(weight) AS flow FROM intra GROUP BY ALL
)
SELECT cells.*, r.position AS resid_position, w.position AS work_position
FROM cells
LEFT JOIN ordered r ON r.year = cells.year AND r.epci = cells.epci AND r.code = resid_code
LEFT JOIN ordered w ON w.year = cells.year AND w.epci = cells.epci AND w.code = work_code""",
    # origin-destination
    "od_wide": f"{WIDE} SELECT * EXCLUDE (total) FROM wide",
    "od_wide_totals": f"""
{WIDE}
SELECT * EXCLUDE (resid_name, work_name),
       {" + ".join(f"coalesce({c}, 0)" for c in MODE_COLUMNS)} AS total_of_modes
FROM wide""",
    "od_filtered": f"{WIDE} SELECT * FROM pairs",
    "od_desire_lines": f"""
{WIDE}
SELECT pairs.* EXCLUDE (resid_name, work_name), {_line("a", "b")} AS line
FROM pairs JOIN centroids a ON resid_code = a.code JOIN centroids b ON work_code = b.code""",
    "od_oneway": f"""
{WIDE} {ONEWAY}
SELECT oneway.*, {_line("a", "b")} AS line
FROM oneway JOIN centroids a ON code_a = a.code JOIN centroids b ON code_b = b.code""",
    "od_oneway_shares": f"""
{WIDE} {ONEWAY}
SELECT year, code_a, code_b, total, (velo + marche) / total AS share_active,
       (velo + marche + tc) / total AS share_sustainable
FROM oneway""",
    "od_oneway_shares_all": f"{ONEWAY_ALL} SELECT * FROM oneway",
    "od_oneway_shares_2016": f"""
{ONEWAY_ALL}
SELECT CASE WHEN year = {YEAR} THEN 2016 ELSE year END AS year, epci, code_a, code_b, total,
       CASE WHEN year <> {YEAR} THEN share_active END AS share_active,
       CASE WHEN year <> {YEAR} THEN share_sustainable END AS share_sustainable
FROM oneway""",
    # map tables
    "choropleth_measures": f"""
{MEASURES}
SELECT commune.*, 'POINT (' || lon || ' ' || lat || ')' AS wkt
FROM commune JOIN centroids USING (code)""",
    "class_fixed": f"""
{MEASURES}
SELECT year, epci, code, domicile, travail, {_bins("domicile", FLOW_LIMITS)} AS class_domicile,
       {_bins("travail", FLOW_LIMITS)} AS class_travail
FROM commune""",
    "class_share_bins": f"""
{ONEWAY_ALL}
SELECT year, epci, code_a, code_b,
       {_bins("share_active", SHARE_LIMITS[:6])} AS active_half,
       {_bins("share_active", SHARE_LIMITS)} AS active_full,
       {_bins("share_sustainable", SHARE_LIMITS[:6])} AS sustainable_half,
       {_bins("share_sustainable", SHARE_LIMITS)} AS sustainable_full
FROM oneway""",
    "class_continuous": f"""
{MEASURES}
SELECT year, epci, code, travail,
       (travail - min(travail) OVER g) / nullif(max(travail) OVER g - min(travail) OVER g, 0) AS scale
FROM commune WINDOW g AS (PARTITION BY year, epci)""",
    "class_order": f"""
{MEASURES}
SELECT a.year, a.epci, a.code, a.travail,
       CASE WHEN a.travail IS NOT NULL THEN
         CAST(1 + (SELECT count(*) FROM commune b
                   WHERE b.year = a.year AND b.epci = a.epci AND b.travail < a.travail)
              AS INTEGER) END AS rank
FROM commune a""",
    "class_natural_breaks": f"""
{MEASURES},
sorted AS (
  SELECT year, epci, travail AS v, count(*) AS n,
         row_number() OVER (PARTITION BY year, epci ORDER BY travail) AS i
  FROM commune WHERE travail IS NOT NULL GROUP BY year, epci, travail
),
cuts AS (
  SELECT a.year, a.epci, a.i AS start2, b.i AS start3
  FROM sorted a JOIN sorted b ON a.year = b.year AND a.epci = b.epci AND a.i > 1 AND b.i > a.i
),
assigned AS (
  SELECT c.year, c.epci, c.start2, c.start3, s.v, s.n,
         CASE WHEN s.i < start2 THEN 1 WHEN s.i < start3 THEN 2 ELSE 3 END AS class
  FROM cuts c JOIN sorted s ON c.year = s.year AND c.epci = s.epci
),
spread AS (
  SELECT year, epci, start2, start3, class, sum(n * v * v) - sum(n * v) ** 2 / sum(n) AS squares
  FROM assigned GROUP BY year, epci, start2, start3, class
),
scored AS (
  SELECT year, epci, start2, start3, sum(squares) AS squares
  FROM spread GROUP BY year, epci, start2, start3
),
best AS (
  SELECT * FROM scored
  QUALIFY row_number() OVER (PARTITION BY year, epci ORDER BY squares, start3, start2) = 1
)
SELECT c.year, c.epci, c.code, c.travail,
       CAST(CASE WHEN b.start2 IS NULL THEN s.i WHEN s.v IS NULL THEN NULL WHEN s.i < start2 THEN 1
                 WHEN s.i < start3 THEN 2 ELSE 3 END AS INTEGER) AS natural_class
FROM commune c
LEFT JOIN sorted s ON s.year = c.year AND s.epci = c.epci AND s.v = c.travail
LEFT JOIN best b ON b.year = c.year AND b.epci = c.epci""",
    "legend_labels": f"""
{ONEWAY_ALL}
SELECT year, epci, code_a, code_b, {_legend("total")} AS label_total,
       {_legend("share_active")} AS label_active,
       {_legend("share_sustainable")} AS label_sustainable
FROM oneway""",
    # one group and year, as shown to a reader
    "report_matrix": f"""
{_with(_shares(CHOSEN, ["resid_code", "work_code"], PAIR_NAMES))},
ordered AS (
  SELECT resid_code AS code,
         CAST(row_number() OVER (ORDER BY sum(weight) DESC, resid_name) AS INTEGER) AS position
  FROM {CHOSEN} GROUP BY resid_code, resid_name
)
SELECT s.*, r.position AS resid_position, w.position AS work_position, {OD_SHARE_LABEL} AS label
FROM s LEFT JOIN ordered r ON r.code = resid_code LEFT JOIN ordered w ON w.code = work_code""",
    "report_residence": _labels(CHOSEN, ["resid_code"], ["resid_name"], "*", SHARE_LABEL),
    "report_flow_map": f"""
{ONEWAY_ALL}
SELECT code_a, code_b, {_line("a", "b")} AS line, total, share_active, share_sustainable,
       {_bins("share_active", SHARE_LIMITS)} AS class_active,
       {_bins("share_sustainable", SHARE_LIMITS)} AS class_sustainable,
       {_legend("share_active")} AS label_active,
       {_legend("share_sustainable")} AS label_sustainable
FROM oneway JOIN centroids a ON code_a = a.code JOIN centroids b ON code_b = b.code
WHERE year = {YEAR} AND epci = '{EPCI}'""",
    # control totals
    "control_total_recon": """
, computed AS (SELECT resid_code, work_code, sum(weight) AS computed FROM flux GROUP BY ALL),
control AS (
  SELECT resid_code, work_code,
         computed + CASE WHEN (CAST(resid_code AS INTEGER) + CAST(work_code AS INTEGER)) % 7 = 0
                         THEN 1 ELSE 0 END AS published
  FROM computed WHERE resid_code <> work_code
)
SELECT coalesce(a.resid_code, b.resid_code) AS resid_code,
       coalesce(a.work_code, b.work_code) AS work_code,
       computed, published, computed - published AS difference,
       CASE WHEN published IS NULL THEN 'not published' WHEN computed IS NULL THEN 'not computed'
            WHEN abs(computed - published) > 0.5 THEN 'different' ELSE 'equal' END AS status
FROM computed a FULL OUTER JOIN control b
  ON a.resid_code = b.resid_code AND a.work_code = b.work_code""",
}

ORACLE = {name: PRELUDE + select for name, select in SELECTS.items()}
