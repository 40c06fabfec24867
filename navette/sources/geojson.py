"""Commune geometry from GeoJSON features, joined to the registry by code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from navette.operators.lookup import Lookup

# Coordinates are printed and compared with six decimals (about 10 cm).
COORDINATE = "decimal(9,6)"

# ``coordinates`` stays text here because its depth depends on the geometry type.
PROPERTIES = "STRUCT<code: STRING, nom: STRING>"
GEOMETRY = "STRUCT<type: STRING, coordinates: STRING>"
FEATURE_SCHEMA = (
    f"type STRING, properties {PROPERTIES}, geometry {GEOMETRY}, "
    f"features ARRAY<STRUCT<properties: {PROPERTIES}, geometry: {GEOMETRY}>>"
)


# Geometry types that are read as points and as contours.
POINTS = ("Point",)
CONTOURS = ("Polygon", "MultiPolygon")


def read_features(
    spark: SparkSession, path: str, whole_files: bool = False, with_code: bool = True
) -> DataFrame:
    """Features as (code, geometry type, coordinate text); those without a code only if asked for.

    Accepts feature collections and single features, one per line or, with
    ``whole_files``, one per file. Anything else fails: a file spread over lines
    would otherwise give no rows and no error.
    """
    raw = (
        spark.read.schema(FEATURE_SCHEMA)
        .option("multiLine", whole_files)
        .option("mode", "FAILFAST")
        .json(path)
    )
    neither = F.raise_error(F.lit("a row of the GeoJSON input is neither a feature nor a collection"))
    known = F.col("properties").isNotNull() | F.col("geometry").isNotNull()
    single = F.when(known, F.array(F.struct("properties", "geometry"))).otherwise(neither)
    feature = raw.select(F.explode(F.coalesce("features", single)).alias("f"))
    features = feature.select(
        F.col("f.properties.code").alias("code"),
        F.col("f.geometry.type").alias("kind"),
        F.col("f.geometry.coordinates").alias("coordinates"),
    )
    return features.filter(F.col("code").isNotNull()) if with_code else features


def rejected(features: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """(reason, kind, n) of the features a reader of these kinds leaves out: ``code`` missing, or another ``kind``.

    ``features`` is read with those that have no code.
    """
    other = ~F.coalesce(F.col("kind").isin(*kinds), F.lit(False))
    reason = F.when(F.col("code").isNull(), "code").when(other, "kind")
    return features.select(reason.alias("reason"), "kind").where("reason is not null").groupBy("reason", "kind").agg(
        F.count(F.lit(1)).alias("n")
    )


def _pair_text(pair: Column) -> Column:
    return F.concat_ws(" ", pair[0].cast(COORDINATE), pair[1].cast(COORDINATE))


def commune_points(features: DataFrame) -> DataFrame:
    """Point features with longitude, latitude and WKT."""
    pair = F.from_json("coordinates", "array<double>")
    return (
        features.filter(F.col("kind").isin(*POINTS))
        .select("code", pair.alias("pair"))
        .select(
            "code",
            F.col("pair")[0].cast(COORDINATE).alias("lon"),
            F.col("pair")[1].cast(COORDINATE).alias("lat"),
            F.concat(F.lit("POINT ("), _pair_text(F.col("pair")), F.lit(")")).alias("wkt"),
        )
    )


def _rings_text(rings: Column) -> Column:
    ring_text = F.transform(
        rings,
        lambda ring: F.concat(
            F.lit("("), F.concat_ws(", ", F.transform(ring, _pair_text)), F.lit(")")
        ),
    )
    return F.concat(F.lit("("), F.concat_ws(", ", ring_text), F.lit(")"))


def commune_contours(features: DataFrame) -> DataFrame:
    """Polygon and multipolygon features with WKT, parts and rings in file order."""
    one = F.from_json("coordinates", "array<array<array<double>>>")
    many = F.from_json("coordinates", "array<array<array<array<double>>>>")
    parts = F.concat(F.lit("("), F.concat_ws(", ", F.transform(many, _rings_text)), F.lit(")"))
    wkt = F.when(F.col("kind") == "Polygon", F.concat(F.lit("POLYGON "), _rings_text(one))).when(
        F.col("kind") == "MultiPolygon", F.concat(F.lit("MULTIPOLYGON "), parts)
    )
    return features.filter(F.col("kind").isin(*CONTOURS)).select(
        "code", wkt.alias("wkt")
    )


def named_geometry(geometry: DataFrame, registry: Lookup) -> DataFrame:
    """Geometry of the communes in the registry, the name ahead of the shape."""
    named = registry.attach(geometry, "code", {"name": "name", "epci": "epci"}, "inner")
    shape = [c for c in geometry.columns if c != "code"]
    return named.select("code", "name", "epci", *shape)
