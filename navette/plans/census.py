"""The commuting domain as views over the star-schema tables.

An order line stands for a surveyed worker: the customer's nation is the home
commune, the supplier's nation the work commune, quantity the weight, line number
the mode code, order year the survey year. Nations are communes and regions are
groups of communes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from navette.functions.modes import recode_mode
from navette.operators.flows import as_flows, flow_mart, residents_of, totals, within, workers_in
from navette.operators.lookup import Lookup
from navette.operators.ranking import commune_order, order_lookup
from navette.sources.delimited import read_delimited
from navette.sources.geojson import COORDINATE
from navette.sources.mart import read_mart, write_mart
from navette.sources.registry import communes_of
from navette.sources.shared import fresh_path
from navette.sources.touched import read_touched, write_touched

# The columns read from each table, declared so that no file is opened to infer them.
TABLES = {
    "lineitem": {
        "l_orderkey": "BIGINT",
        "l_suppkey": "BIGINT",
        "l_linenumber": "INT",
        "l_quantity": "DOUBLE",
    },
    "orders": {"o_orderkey": "BIGINT", "o_custkey": "BIGINT", "o_orderdate": "TIMESTAMP_NTZ"},
    "customer": {"c_custkey": "BIGINT", "c_nationkey": "INT"},
    "supplier": {"s_suppkey": "BIGINT", "s_nationkey": "INT"},
    "nation": {"n_nationkey": "INT", "n_name": "STRING", "n_regionkey": "INT"},
    "region": {"r_regionkey": "INT", "r_name": "STRING"},
}

# Measures of side tables and paths of written tables, per application and data set.
_MEASURED: dict[tuple, tuple[int, int]] = {}
_WRITTEN: dict[tuple, str] = {}


def _table_name(path: str) -> str:
    return "navette_" + path.rsplit("/", 1)[1].replace("-", "_")


@dataclass(frozen=True)
class Census:
    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        schema = ", ".join(f"{column} {kind}" for column, kind in TABLES[name].items())
        return self.spark.read.schema(schema).parquet(f"{self.sf_dir}/{name}.parquet")

    def flux(
        self,
        year: int | None = None,
        residents: Lookup | None = None,
        workers: Lookup | None = None,
    ) -> DataFrame:
        """Survey rows, optionally of one year, of some homes or of some work places.

        A year reaches the scan as a date range, and a selection of communes acts on
        its own side, so both come before the widest join. Lines and orders both grow
        with the survey, so that join is a sort-merge join at every size. Customers
        and suppliers are broadcast only if their files are below the session's
        threshold; above it they are joined by shuffle, with the partitions of
        frequent keys split at run time.
        """
        orders = self.table("orders")
        if year is not None:
            ordered = F.col("o_orderdate")
            start, end = (
                F.lit(f"{y}-01-01 00:00:00").cast("timestamp_ntz") for y in (year, year + 1)
            )
            orders = orders.filter((ordered >= start) & (ordered < end))
        # Keys stay numbers until after the join, which keeps its shuffle narrow.
        homes = orders.join(
            self.table("customer"), F.col("o_custkey") == F.col("c_custkey")
        ).select("o_orderkey", "c_nationkey", F.year("o_orderdate").alias("year"))
        jobs = (
            self.table("lineitem")
            .join(self.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
            .select("l_orderkey", "s_nationkey", "l_quantity", "l_linenumber")
        )
        resid_code = F.col("c_nationkey").cast("string").alias("resid_code")
        work_code = F.col("s_nationkey").cast("string").alias("work_code")
        if residents is not None:
            homes = residents_of(homes.select("*", resid_code), residents).drop("resid_code")
        if workers is not None:
            jobs = workers_in(jobs.select("*", work_code), workers).drop("work_code")
        return jobs.join(
            homes.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey")
        ).select(
            resid_code,
            work_code,
            F.col("l_quantity").alias("weight"),
            F.col("l_linenumber").cast("string").alias("mode_code"),
            "year",
        )

    def flux_with_mode(self) -> DataFrame:
        flux = self.flux()
        return flux.withColumn("mode", recode_mode(F.col("mode_code"), F.col("year")))

    def flows(self) -> DataFrame:
        """Survey rows with their mode label, ready for the operators."""
        return as_flows(self.flux_with_mode())

    def registry_frame(self) -> DataFrame:
        nation = self.table("nation")
        region = self.table("region")
        return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
            F.col("n_nationkey").cast("string").alias("code"),
            F.col("n_name").alias("name"),
            F.col("r_name").alias("epci"),
        )

    def centroid_frame(self) -> DataFrame:
        key = F.col("n_nationkey")
        return self.table("nation").select(
            key.cast("string").alias("code"),
            (key * F.lit(0.5) - 5).cast(COORDINATE).alias("lon"),
            (key * F.lit(0.25) + 42).cast(COORDINATE).alias("lat"),
        )

    def layer_frame(self) -> DataFrame:
        """Registry with the point of each commune as text."""
        point = F.concat(F.lit("POINT ("), F.concat_ws(" ", "lon", "lat"), F.lit(")"))
        points = self.centroid_frame().select("code", point.alias("wkt"))
        return self.registry_frame().join(points, "code")

    def control(self) -> DataFrame:
        """Published pair totals, read from a delimited file."""
        path = self.written(
            "control_csv",
            lambda p: self.control_frame()
            .write.option("sep", ";")
            .option("header", True)
            .csv(p),
        )
        types = {"resid_code": "string", "work_code": "string", "published": "double"}
        return read_delimited(self.spark, path, types)

    def control_frame(self) -> DataFrame:
        """Pair totals with known differences: some one too high, some pairs absent."""
        resid, work = F.col("resid_code"), F.col("work_code")
        extra = F.when((resid.cast("int") + work.cast("int")) % 7 == 0, 1.0).otherwise(0.0)
        pairs = totals(self.stored_mart(), "resid_code", "work_code").filter(resid != work)
        return pairs.select("resid_code", "work_code", (F.col("flow") + extra).alias("published"))

    def registry(self) -> Lookup:
        return self._measured("registry", self.registry_frame())

    def centroids(self) -> Lookup:
        return self._measured("centroids", self.centroid_frame())

    def layer(self) -> Lookup:
        return self._measured("layer", self.layer_frame())

    def members(self, epci: str) -> Lookup:
        return communes_of(self.registry(), epci)

    def mart(self) -> DataFrame:
        """The flow mart as a plan over the tables."""
        return flow_mart(self.flux_with_mode(), self.registry())

    def mart_path(self) -> str:
        return self.written("flow_mart", lambda path: write_mart(self.mart(), path))

    def stored_mart(self) -> DataFrame:
        """The written flow mart: survey rows are joined and summed only once."""
        return read_mart(self.spark, self.mart_path())

    def touched_mart(self) -> DataFrame:
        """The mart under the groups it touches, bucketed by them."""
        path = self.written("touched_mart", lambda p: write_touched(self.stored_mart(), p, _table_name(p)))
        return read_touched(self.spark, path, _table_name(path))

    def display_order(self) -> Lookup:
        """Positions of the communes of every group and year, ranked once and stored."""

        def write(path: str) -> None:
            inside = within(self.stored_mart())
            order_lookup(commune_order(inside, "year", "epci"), "year", "epci").write.parquet(path)

        path = self.written("display_order", write)
        return self._measured("display_order", self.spark.read.schema("code STRING, position INT").parquet(path))

    def editions_frame(self) -> DataFrame:
        """Two editions: from 1996 on, every fifth commune belongs to the next group."""
        key = F.col("n_nationkey")
        group = F.when(key % 5 == 0, (F.col("n_regionkey") + 1) % 5).otherwise(F.col("n_regionkey"))
        nation, region = self.table("nation"), self.table("region")

        def edition(of_group, first, last):
            return nation.join(region, F.col("r_regionkey") == of_group).select(
                key.cast("string").alias("code"), F.col("n_name").alias("name"), F.col("r_name").alias("epci"),
                F.lit(first).alias("valid_from"), F.lit(last).cast("int").alias("valid_to"),
            )

        return edition(F.col("n_regionkey"), 1990, 1996).union(edition(group, 1996, None))

    def changes_frame(self) -> DataFrame:
        """Merged communes: 24 into 23 from 1994, and 23 into 22 from 1997."""
        key = F.col("n_nationkey")
        since = F.when(key == 24, 1994).otherwise(1997)
        return self.table("nation").where(key >= 23).select(
            key.cast("string").alias("old_code"), (key - 1).cast("string").alias("new_code"), since.alias("since")
        )

    def years(self) -> list[int | None]:
        """Survey years of the mart, its partitions, in order."""
        found = self.stored_mart().select("year").distinct().collect()
        return sorted((row["year"] for row in found), key=lambda y: (y is None, y))

    def written(self, name: str, write) -> str:
        """Path of a table that ``write(path)`` has filled, once per application."""
        key = self._key(name)
        if key not in _WRITTEN:
            path = fresh_path(self.spark, name)
            write(path)
            _WRITTEN[key] = path
        return _WRITTEN[key]

    def _measured(self, name: str, frame: DataFrame) -> Lookup:
        key = self._key(name)
        if key not in _MEASURED:
            lookup = Lookup.of(frame, "code")
            _MEASURED[key] = (lookup.rows, lookup.size_bytes)
        return Lookup(frame, "code", *_MEASURED[key])

    def _key(self, name: str) -> tuple:
        return (self.spark.sparkContext.applicationId, self.sf_dir, name)
