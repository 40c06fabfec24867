"""Registered queries: each takes (session, folder of tables) and returns a frame."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from navette.functions.labels import legend_label
from navette.functions.modes import MODE_LABELS, recode_mode
from navette.operators import classify, corrections, editions, flows, od, ranking, reconcile, residency, shares
from navette.plans import ingest, reports
from navette.plans.census import Census
from navette.sources import corrections as stored
from navette.sources import archive, delimited, enriched, geojson, mart, registry

# The selection of the step-by-step analysis.
EPCI = "EUROPE"
YEAR = 1997
COMMUNE = "3"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(build: Callable[[Census], DataFrame]) -> Callable[[Census], DataFrame]:
    QUERIES[build.__name__] = lambda spark, sf_dir: build(Census(spark, sf_dir))
    return build


# --- sources and sinks -------------------------------------------------------


def _flow_file(flux: DataFrame, *extra) -> DataFrame:
    """Columns as a yearly flow file names and orders them, among unread ones."""
    return flux.select(
        F.lit("x").alias("AGEREVQ"),
        F.col("work_code").alias("DCLT"),
        F.col("resid_code").alias("COMMUNE"),
        F.col("weight").alias("IPONDI"),
        *extra,
        F.col("mode_code").alias("TRANS"),
    )


@query
def scan_flux_subset(census: Census) -> DataFrame:
    path = census.written(
        "flux_csv",
        lambda p: _flow_file(census.flux()).write.option("sep", ";").option("header", True).csv(p),
    )
    return delimited.read_flux(census.spark, path)


@query
def scan_flux_trimmed(census: Census) -> DataFrame:
    def write(path: str) -> None:
        extra = [
            F.concat(F.lit("0"), "work_code").alias("DCFLT"),
            F.lpad("resid_code", 2, "0").alias("REGLT"),
        ]
        cells = _flow_file(census.flux(), *extra)
        padded = [F.concat(F.lit("  "), F.col(c).cast("string"), F.lit(" ")).alias(c) for c in cells.columns]
        (
            cells.select(*padded)
            .write.option("sep", ";")
            .option("header", True)
            .option("ignoreLeadingWhiteSpace", False)
            .option("ignoreTrailingWhiteSpace", False)
            .csv(path)
        )

    types = {"COMMUNE": "string", "DCFLT": "string", "REGLT": "string", "IPONDI": "double"}
    path = census.written("flux_padded_csv", write)
    return delimited.read_delimited(census.spark, path, types, trim=True).toDF(
        "resid_code", "abroad_code", "region_code", "weight"
    )


@query
def scan_mode_labels(census: Census) -> DataFrame:
    """Codes found in the survey, labelled from a code table instead of the fixed map."""
    counted = census.flux().groupBy("mode_code").agg(F.count("*").alias("n_obs"))

    def write(path: str) -> None:
        codes = census.table("lineitem").select("l_linenumber").distinct()
        code = F.col("l_linenumber").cast("string")
        listed = codes.select(
            F.lit("TRANS").alias("COD_VAR"),
            code.alias("COD_MOD"),
            recode_mode(code).alias("LIB_MOD"),
        ).filter(code.isin(list(MODE_LABELS)))
        other = listed.withColumns({"COD_VAR": F.lit("SEXE"), "LIB_MOD": F.lit("x")})
        listed.unionByName(other).write.option("sep", ";").option("header", True).csv(path)

    labels = delimited.read_mode_labels(census.spark, census.written("mode_labels", write))
    return counted.join(labels, "mode_code", "left").select(
        "mode_code", F.coalesce("mode", "mode_code").alias("mode"), "n_obs"
    )


@query
def ingest_years_union(census: Census) -> DataFrame:
    def write(path: str) -> None:
        cells = _flow_file(census.flux(), F.col("year").alias("ANNEE"))
        cells.write.partitionBy("ANNEE").option("sep", ";").option("header", True).csv(path)

    path = census.written("flux_by_year_csv", write)
    found = census.table("orders").select(F.year("o_orderdate").alias("year"))
    years = sorted(row["year"] for row in found.distinct().collect())
    return ingest.read_years(census.spark, path + "/ANNEE={year}", years)


@query
def scan_zip_member(census: Census) -> DataFrame:
    """Archives on disk, each task's rows in one member, read back in two steps."""
    path = census.written(
        "flux_zip",
        lambda p: archive.write_zip_archives(_flow_file(census.flux()), p, "FD_MOBPRO.csv"),
    )
    archives = archive.read_zip_archives(census.spark, f"{path}/*.zip")
    return archive.read_flux_zip(archives, "FD_MOBPRO*.csv")


@query
def registry_scan(census: Census) -> DataFrame:
    def write(path: str) -> None:
        head = census.spark.createDataFrame(
            [
                (0, "Composition communale"),
                (1, "Geographie au 01/01"),
                (2, ""),
                (3, "Code;Libelle;Code du groupe;Libelle du groupe"),
                (4, "Mise en ligne;x;y;z"),
                (5, "CODGEO;LIBGEO;EPCI;LIBEPCI"),
            ],
            "at INT, value STRING",
        )
        body = census.registry_frame().select(
            (F.col("code").cast("int") + 6).alias("at"),
            F.concat_ws(";", "code", "name", F.lit("200"), "epci").alias("value"),
        )
        # The parts of the sheet are named in the order of its lines.
        head.unionByName(body).orderBy("at").select("value").write.text(path)

    return registry.read_registry_sheet(census.spark, census.written("registry_sheet", write))


@query
def geojson_communes(census: Census) -> DataFrame:
    def write(path: str) -> None:
        feature = F.struct(
            F.lit("Feature").alias("type"),
            F.struct("code", F.col("code").alias("nom")).alias("properties"),
            F.struct(
                F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")
            ).alias("geometry"),
        )
        census.centroid_frame().select(
            F.lit("FeatureCollection").alias("type"), F.array(feature).alias("features")
        ).write.json(path)

    features = geojson.read_features(census.spark, census.written("centres", write))
    return geojson.named_geometry(geojson.commune_points(features), census.registry())


def _contours(census: Census) -> str:
    """Boxes as polygons, of every fifth commune two as a multipolygon; some points and some features without a code."""

    def write(path: str) -> None:
        half = F.lit(0.125).cast(geojson.COORDINATE)
        corners = [(-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1)]

        def box(east: int):
            lon = F.col("lon") + F.lit(east).cast(geojson.COORDINATE)
            return F.array(F.array(*[F.array(lon + half * i, F.col("lat") + half * j) for i, j in corners]))

        several, known = F.col("code").cast("int") % 5 == 0, F.col("code").cast("int") % 6 != 0
        code = F.col("code")
        for kind, kept, shape, named in (
            ("Polygon", ~several, box(0), code),
            ("MultiPolygon", several, F.array(box(0), box(1)), code),
            ("Point", ~several, F.array("lon", "lat"), code),
            ("Polygon", ~known, box(0), F.lit(None).cast("string")),
        ):
            census.centroid_frame().where(kept).select(
                F.lit("Feature").alias("type"),
                F.struct(named.alias("code"), code.alias("nom")).alias("properties"),
                F.struct(F.lit(kind).alias("type"), shape.alias("coordinates")).alias("geometry"),
            ).write.mode("append").json(path)

    return census.written("contours", write)


@query
def geojson_contours(census: Census) -> DataFrame:
    features = geojson.read_features(census.spark, _contours(census))
    return geojson.named_geometry(geojson.commune_contours(features), census.registry())


@query
def geojson_rejects(census: Census) -> DataFrame:
    """What ``geojson_contours`` leaves out, by reason and kind."""
    features = geojson.read_features(census.spark, _contours(census), with_code=False)
    return geojson.rejected(features, geojson.CONTOURS)


@query
def mart_roundtrip(census: Census) -> DataFrame:
    return census.stored_mart()


@query
def mart_pruned_scan(census: Census) -> DataFrame:
    return flows.within(census.stored_mart(), YEAR, EPCI)


@query
def mart_build_if_absent(census: Census) -> DataFrame:
    """Published once at a path of its own; the second call finds it and must not build."""

    def unwanted() -> DataFrame:
        raise AssertionError("the mart is present")

    path = f"{census.mart_path()}-published"
    mart.build_mart_if_absent(census.spark, path, census.mart)
    return mart.build_mart_if_absent(census.spark, path, unwanted)


def _stored_corrections(census: Census) -> str:
    """Year by year the mart as first published, then two corrections: weights of one mode raised, homes of one commune withdrawn."""

    def write(path: str) -> None:
        spark, registry = census.spark, census.registry()
        rows = spark.read.parquet(census.written("survey_rows", lambda p: census.flux_with_mode().write.partitionBy("year").parquet(p)))
        old = F.col("mode_code") == "3"
        gone = F.coalesce(F.col("resid_code") == "7", F.lit(False))
        raised = rows.where(old).withColumn("weight", F.col("weight") + 1)
        left = rows.where(gone & ~old).unionByName(raised.where(gone))
        first = corrections.correction(rows.where(old), raised, registry)
        second = corrections.correction(left, None, registry)
        for year in census.years():
            if year is not None:
                of = F.col("year") == year
                stored.publish_base(spark, path, year, lambda of=of: census.stored_mart().where(of))
                stored.publish_correction(spark, path, year, 1, lambda of=of: first.where(of))
                stored.publish_correction(spark, path, year, 2, lambda of=of: second.where(of))

    return census.written("corrected_mart", write)


def _corrected_years(census: Census, read) -> DataFrame:
    path = _stored_corrections(census)
    return reduce(DataFrame.unionByName, [read(census.spark, path, y) for y in census.years() if y is not None])


@query
def mart_corrected(census: Census) -> DataFrame:
    """Every year with its corrections added as it is read."""
    return _corrected_years(census, stored.read_corrected)


@query
def mart_corrected_compacted(census: Census) -> DataFrame:
    """Every year written again with its corrections in it."""
    return _corrected_years(census, stored.compact)


@query
def mart_as_first_published(census: Census) -> DataFrame:
    """Every year as it was before its corrections."""
    return _corrected_years(census, lambda spark, path, year: stored.read_corrected(spark, path, year, upto=0))


def _enriched(census: Census) -> DataFrame:
    def write(path: str) -> None:
        rows = flows.label_ends(census.flux_with_mode(), census.registry())
        staged = census.written("labelled_rows", lambda p: rows.write.parquet(p))
        stored = census.spark.read.schema(rows.schema).parquet(staged)
        enriched.write_enriched(stored, path, census.registry())

    path = census.written("enriched_rows", write)
    return enriched.read_enriched(census.spark, path)


@query
def enriched_roundtrip(census: Census) -> DataFrame:
    return _enriched(census)


@query
def enriched_pruned_scan(census: Census) -> DataFrame:
    return flows.within(_enriched(census), YEAR, EPCI)


# --- registry, labels, selections --------------------------------------------


@query
def registry_slice(census: Census) -> DataFrame:
    return census.members(EPCI).frame.select("code", "name")


@query
def epci_choices(census: Census) -> DataFrame:
    return registry.epci_choices(census.registry_frame())


@query
def flux_labelled(census: Census) -> DataFrame:
    labelled = flows.label_ends(flows.with_mode(census.flux()), census.registry())
    return labelled.withColumnsRenamed(
        {
            "resid_name": "commune_residence",
            "resid_epci": "epci_residence",
            "work_name": "commune_travail",
            "work_epci": "epci_travail",
        }
    )


@query
def flow_mart_as_of(census: Census) -> DataFrame:
    """The mart with codes and labels of each survey year, from two registry editions and two merged communes."""
    years = census.stored_mart().select("year")
    by_year = editions.editions_by_year(census.editions_frame(), years)
    changes = editions.changes_by_year(census.changes_frame(), years)
    return editions.flow_mart_as_of(census.stored_mart(), by_year, changes)


@query
def recode_modes(census: Census) -> DataFrame:
    per_code = flows.totals(flows.as_flows(census.flux()), "year", "mode_code")
    return flows.with_mode(per_code)


@query
def flux_residents(census: Census) -> DataFrame:
    return census.flux(residents=census.members(EPCI))


@query
def flux_workers(census: Census) -> DataFrame:
    return census.flux(workers=census.members(EPCI))


@query
def flux_epci_any(census: Census) -> DataFrame:
    selected = flows.touching(flows.with_mode(census.flux()), census.members(EPCI))
    return selected.drop("resid_epci", "work_epci", "mode_comparable")


@query
def flux_epci_any_all(census: Census) -> DataFrame:
    touched = flows.by_touched_group(flows.label_ends(census.flux(), census.registry()))
    return touched.select(
        "epci", "year", "resid_code", "work_code", "weight", "mode_code", "resid_name", "work_name"
    )


@query
def flux_epci_intra(census: Census) -> DataFrame:
    members = census.members(EPCI)
    chosen = census.flux(YEAR, residents=members, workers=members)
    labelled = flows.label_ends(flows.with_mode(chosen), census.registry())
    return flows.within(labelled, YEAR, EPCI).drop(
        "year", "resid_epci", "work_epci", "mode_comparable"
    )


def _touching(census: Census) -> DataFrame:
    """Flows of every year that touch the chosen group, from the mart."""
    return flows.touching_group(census.stored_mart(), EPCI)


def _touching_selection(census: Census) -> DataFrame:
    """The same, outsiders as one NULL end."""
    return flows.outsiders_to_null(_touching(census))


def _touching_all(census: Census) -> DataFrame:
    """The same for every group, from the copy of the mart that is bucketed by the touched group."""
    return flows.outsiders_of_group_to_null(census.touched_mart())


def _within_all(census: Census) -> DataFrame:
    """Flows of every year inside every group, from the mart."""
    return flows.within(census.stored_mart())


# --- aggregates --------------------------------------------------------------


@query
def flow_mart(census: Census) -> DataFrame:
    return census.mart()


@query
def weighted_by_residence(census: Census) -> DataFrame:
    per_commune = flows.totals(census.stored_mart(), "year", "resid_code")
    return flows.name_ends(per_commune, census.registry(), "resid").drop("n_obs")


@query
def weighted_by_work(census: Census) -> DataFrame:
    per_commune = flows.totals(census.stored_mart(), "year", "work_code")
    return flows.name_ends(per_commune, census.registry(), "work").drop("n_obs")


@query
def weighted_by_residence_mode(census: Census) -> DataFrame:
    per_mode = flows.totals(census.stored_mart(), "year", "resid_code", "mode")
    return flows.name_ends(per_mode, census.registry(), "resid").drop("n_obs")


@query
def count_by_residence(census: Census) -> DataFrame:
    counted = flows.totals(_touching_selection(census), "year", "resid_code")
    return flows.name_ends(counted, census.members(EPCI), "resid").drop("flow")


@query
def od_pair_totals(census: Census) -> DataFrame:
    pairs = flows.totals(census.stored_mart(), "year", "resid_code", "work_code")
    return flows.name_ends(pairs, census.registry(), "resid", "work").drop("n_obs")


@query
def od_mode_flows(census: Census) -> DataFrame:
    pairs = flows.totals(census.stored_mart(), *flows.MART_KEYS)
    return flows.name_ends(pairs, census.registry(), "resid", "work").drop("n_obs")


@query
def membership_stats(census: Census) -> DataFrame:
    return residency.membership_stats(_touching(census))


@query
def top10_work_communes(census: Census) -> DataFrame:
    stats = residency.membership_stats(_touching(census))
    return residency.top_work_communes(stats, census.registry(), 10)


@query
def work_commune_residency(census: Census) -> DataFrame:
    working = flows.workers_of_group(census.stored_mart(), EPCI)
    return residency.work_commune_residency(working, census.members(EPCI), "year")


@query
def headline_counts(census: Census) -> DataFrame:
    return residency.headline_counts(_touching(census), "year")


@query
def top3_inflow(census: Census) -> DataFrame:
    return ranking.top_origins(census.stored_mart(), census.registry(), COMMUNE, 3)


# --- shares ------------------------------------------------------------------


@query
def share_by_residence_mode(census: Census) -> DataFrame:
    found = shares.mode_shares(_touching_selection(census), "year", "resid_code")
    return flows.name_ends(found, census.members(EPCI), "resid")


@query
def share_by_residence_mode_all(census: Census) -> DataFrame:
    return shares.mode_shares(_touching_all(census), "year", "epci", "resid_code", "resid_name")


@query
def group_directions(census: Census) -> DataFrame:
    """Flows inside, out of and into every group and year, by the bucketed copy."""
    home, job = (F.col(f"{end}_epci").eqNullSafe(F.col("epci")) for end in ("resid", "work"))
    amounts = {"inside": home & job, "leaving": home & ~job, "entering": ~home & job}
    sums = [F.sum(F.when(test, F.col("flow")).otherwise(0.0)).alias(name) for name, test in amounts.items()]
    return census.touched_mart().groupBy("year", "epci").agg(*sums)


@query
def share_by_residence_mode_from_mart(census: Census) -> DataFrame:
    """The same as ``share_by_residence_mode``, read from the written mart."""
    touched = flows.touching_group(census.stored_mart(), EPCI)
    outsiders = flows.outsiders_to_null(touched)
    return shares.mode_shares(outsiders, "year", "resid_code", "resid_name")


@query
def share_by_residence_intra_all(census: Census) -> DataFrame:
    """Share by home commune of the trips inside every group, with its label."""
    found = shares.mode_shares(_within_all(census), "year", "epci", "resid_code", "resid_name")
    return shares.with_share_label(found)


@query
def share_by_work_mode(census: Census) -> DataFrame:
    found = shares.mode_shares(_touching_selection(census), "year", "work_code")
    return flows.name_ends(found, census.members(EPCI), "work")


@query
def share_labels(census: Census) -> DataFrame:
    found = shares.mode_shares(_touching_selection(census), "year", "resid_code")
    labelled = shares.with_share_label(found)
    return flows.name_ends(labelled, census.members(EPCI), "resid").select(
        "year", "resid_name", "mode", "label"
    )


@query
def od_mode_share(census: Census) -> DataFrame:
    """Modal share of every ordered pair of communes in every year.

    The one share that is worked out from survey rows, as a check of the mart.
    """
    found = shares.mode_shares(census.flows(), "year", "resid_code", "work_code")
    return flows.name_ends(found, census.registry(), "resid", "work")


@query
def od_mode_share_from_mart(census: Census) -> DataFrame:
    """The same result from the written mart."""
    stored = census.stored_mart()
    found = shares.share_of_total(stored, "year", "resid_code", "work_code")
    return found.drop("n_obs", "resid_epci", "work_epci")


@query
def od_mode_share_all(census: Census) -> DataFrame:
    """Modal matrix of every group and year, flows inside the group."""
    found = shares.share_of_total(_within_all(census), "year", "resid_code", "work_code")
    return found.drop("n_obs", "resid_epci", "work_epci")


@query
def od_mode_share_selected(census: Census) -> DataFrame:
    """One request: the modal matrix of the chosen group and year, from the mart."""
    chosen = flows.within(census.stored_mart(), YEAR, EPCI)
    found = shares.with_od_share_label(
        shares.share_of_total(chosen, "resid_code", "work_code")
    )
    return found.drop("n_obs", "year", "resid_epci", "work_epci")


@query
def od_share_labels(census: Census) -> DataFrame:
    found = shares.share_of_total(_within_all(census), "year", "resid_code", "work_code")
    return shares.with_od_share_label(found).select(
        "year", "epci", "resid_name", "work_name", "mode", "label"
    )


@query
def commune_order(census: Census) -> DataFrame:
    """Display order of the communes of every group and year, all trips counted."""
    living = census.stored_mart().filter(F.col("resid_epci").isNotNull())
    return ranking.commune_order(living.withColumnRenamed("resid_epci", "epci"), "year", "epci")


@query
def od_display_order(census: Census) -> DataFrame:
    """Matrix cells of every group and year with the positions of both communes."""
    cells = _within_all(census).select("year", "epci", "resid_code", "work_code", "mode", "flow")
    return ranking.with_display_order(cells, census.display_order(), "year", "epci")


# --- origin-destination ------------------------------------------------------


def _wide_selection(census: Census) -> DataFrame:
    return od.od_wide(_touching_selection(census), "year", "resid_code", "work_code")


@query
def od_wide(census: Census) -> DataFrame:
    named = flows.name_ends(_wide_selection(census), census.members(EPCI), "resid", "work")
    return named.drop("total")


@query
def od_wide_totals(census: Census) -> DataFrame:
    return od.with_row_total(_wide_selection(census))


@query
def od_filtered(census: Census) -> DataFrame:
    pairs = od.between_communes(_wide_selection(census))
    return flows.name_ends(pairs, census.members(EPCI), "resid", "work")


@query
def od_desire_lines(census: Census) -> DataFrame:
    pairs = od.between_communes(_wide_selection(census))
    return od.desire_lines(pairs, census.centroids(), "resid_code", "work_code")


@query
def od_oneway(census: Census) -> DataFrame:
    merged = od.od_oneway(_wide_selection(census), "year")
    return od.desire_lines(merged, census.centroids(), "code_a", "code_b")


@query
def od_oneway_shares(census: Census) -> DataFrame:
    merged = od.with_shares(od.od_oneway(_wide_selection(census), "year"))
    return merged.select("year", "code_a", "code_b", "total", "share_active", "share_sustainable")


def _oneway_all(census: Census) -> DataFrame:
    """Undirected pairs inside every group, from the mart."""
    return od.with_shares(od.od_oneway_from_flows(_within_all(census), "year", "epci"))


@query
def od_oneway_shares_all(census: Census) -> DataFrame:
    return _oneway_all(census).select(
        "year", "epci", "code_a", "code_b", "total", "share_active", "share_sustainable"
    )


@query
def od_oneway_shares_2016(census: Census) -> DataFrame:
    """One survey year read as 2016, whose modes cannot be compared: totals stay, shares are NULL."""
    year = F.when(F.col("year") == YEAR, 2016).otherwise(F.col("year"))
    flux = flows.with_mode(census.flux().withColumn("year", year))
    inside = flows.within(flows.flow_mart(flux, census.registry()))
    shown = od.with_shares(od.od_oneway_from_flows(inside, "year", "epci"))
    return shown.select("year", "epci", "code_a", "code_b", "total", "share_active", "share_sustainable")


# --- map tables --------------------------------------------------------------


@query
def choropleth_measures(census: Census) -> DataFrame:
    return classify.choropleth_measures(census.stored_mart(), census.layer(), census.years())


def _measures(census: Census) -> DataFrame:
    """Map measures, stored, so that limits and classes come from the same sums."""

    def frame() -> DataFrame:
        registry, years = census.registry(), census.years()
        measures = classify.choropleth_measures(census.stored_mart(), registry, years)
        return measures.select("year", "epci", "code", "domicile", "travail")

    path = census.written("map_measures", lambda p: frame().write.parquet(p))
    types = "year INT, epci STRING, code STRING, domicile DOUBLE, travail DOUBLE"
    return census.spark.read.schema(types).parquet(path)


@query
def class_fixed(census: Census) -> DataFrame:
    classes = {
        f"class_{m}": classify.fixed_class(F.col(m), classify.FLOW_BREAKS)
        for m in ("domicile", "travail")
    }
    return _measures(census).withColumns(classes)


@query
def class_share_bins(census: Census) -> DataFrame:
    active, sustainable = F.col("share_active"), F.col("share_sustainable")
    return (
        _oneway_all(census)
        .withColumns(
            {
                "active_half": classify.fixed_class(active, classify.HALF_SHARE_BREAKS),
                "active_full": classify.fixed_class(active, classify.SHARE_BREAKS),
                "sustainable_half": classify.fixed_class(sustainable, classify.HALF_SHARE_BREAKS),
                "sustainable_full": classify.fixed_class(sustainable, classify.SHARE_BREAKS),
            }
        )
        .select(
            "year", "epci", "code_a", "code_b",
            "active_half", "active_full", "sustainable_half", "sustainable_full",
        )
    )


@query
def class_continuous(census: Census) -> DataFrame:
    scaled = classify.continuous_scale(_measures(census), "travail", "year", "epci")
    return scaled.select("year", "epci", "code", "travail", "scale")


@query
def class_order(census: Census) -> DataFrame:
    ranked = classify.rank_scale(_measures(census), "travail", "year", "epci")
    return ranked.select("year", "epci", "code", "travail", "rank")


@query
def class_natural_breaks(census: Census) -> DataFrame:
    classed = classify.natural_breaks(_measures(census), "travail", 3, "year", "epci")
    return classed.select("year", "epci", "code", "travail", "natural_class")


@query
def legend_labels(census: Census) -> DataFrame:
    return _oneway_all(census).select(
        "year",
        "epci",
        "code_a",
        "code_b",
        legend_label(F.col("total")).alias("label_total"),
        legend_label(F.col("share_active")).alias("label_active"),
        legend_label(F.col("share_sustainable")).alias("label_sustainable"),
    )


# --- one group and year, as shown to a reader ---------------------------------


@query
def report_matrix(census: Census) -> DataFrame:
    return reports.matrix(census.stored_mart(), YEAR, EPCI)


@query
def report_residence(census: Census) -> DataFrame:
    return reports.residence(census.stored_mart(), YEAR, EPCI)


@query
def report_flow_map(census: Census) -> DataFrame:
    return reports.flow_map(census.stored_mart(), census.centroids(), YEAR, EPCI)


# --- control totals ----------------------------------------------------------


@query
def control_total_recon(census: Census) -> DataFrame:
    computed = flows.totals(census.stored_mart(), "resid_code", "work_code")
    return reconcile.reconcile(computed, census.control())
