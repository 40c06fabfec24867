"""Column names and types shared by sources, operators and the flow mart."""

from __future__ import annotations

from pyspark.sql import types as T

# The columns read from a yearly flow file and their names here.
FLOW_FILE_COLUMNS = {
    "COMMUNE": "resid_code",
    "DCLT": "work_code",
    "IPONDI": "weight",
    "TRANS": "mode_code",
}

FLOW_FILE_TYPES = {
    "COMMUNE": "string",
    "DCLT": "string",
    "IPONDI": "double",
    "TRANS": "string",
}

# The registry columns and their names here.
REGISTRY_COLUMNS = {
    "CODGEO": "code",
    "LIBGEO": "name",
    "LIBEPCI": "epci",
}

# The columns of the enriched rows as stored, and their names here.
ENRICHED_COLUMNS = {
    "COMMUNE": "resid_code",
    "DCLT": "work_code",
    "IPONDI": "weight",
    "TRANS": "mode_code",
    "Mode de transport": "mode",
    "annee": "year",
    "epci_resid": "resid_epci",
    "Commune de résidence": "resid_name",
    "epci_travail": "work_epci",
    "Commune de travail": "work_name",
}

ENRICHED_SCHEMA = T.StructType(
    [
        T.StructField("COMMUNE", T.StringType()),
        T.StructField("DCLT", T.StringType()),
        T.StructField("IPONDI", T.DoubleType()),
        T.StructField("TRANS", T.StringType()),
        T.StructField("Mode de transport", T.StringType()),
        T.StructField("annee", T.IntegerType()),
        T.StructField("epci_resid", T.StringType()),
        T.StructField("Commune de résidence", T.StringType()),
        T.StructField("epci_travail", T.StringType()),
        T.StructField("Commune de travail", T.StringType()),
    ]
)

MART_SCHEMA = T.StructType(
    [
        T.StructField("resid_code", T.StringType()),
        T.StructField("work_code", T.StringType()),
        T.StructField("mode", T.StringType()),
        T.StructField("n_obs", T.LongType()),
        T.StructField("flow", T.DoubleType()),
        T.StructField("resid_name", T.StringType()),
        T.StructField("resid_epci", T.StringType()),
        T.StructField("work_name", T.StringType()),
        T.StructField("work_epci", T.StringType()),
        T.StructField("year", T.IntegerType()),
    ]
)
