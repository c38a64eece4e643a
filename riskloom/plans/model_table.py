"""The enriched table that every estimator reads: all feature groups, stored by year once per session."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskloom.catalog import CATEGORICAL, FEATURE_GROUPS, RENAME
from riskloom.operators import history
from riskloom.operators.cohort import add_flags, eligible, temporal_split
from riskloom.plans import binding as B, flights as P
from riskloom.plans.feature_queries import processed
from riskloom.plans.graph_queries import lagged
from riskloom.session import at_once, materialize, scratch_dir

FEATURES = [f for columns in FEATURE_GROUPS.values() for f in columns]
CATEGORIES = [f for f in FEATURES if f in CATEGORICAL]
NUMBERS = [f for f in FEATURES if f not in CATEGORICAL]
#: Processed columns the table is made of; the others are left out before the joins, not after them.
PROCESSED = [
    "row_key", "year", "FlightDate", "ArrDelay", "ArrDel15", "primary_eligible",
    *dict.fromkeys(c for c, name in {"Origin": "origin_airport", "Dest": "destination_airport", **RENAME}.items() if name in FEATURES),
]
#: Columns of the bound flights that these and the looked-up tables are made of.
BOUND = ["row_key", "FlightDate", "airlines", "Origin", "Dest", "CRSDepTime", "CRSElapsedTime", "Cancelled", "Diverted", "ArrDel15", "ArrDelay"]
#: Years of the bound flights: fit, validation, test.
YEARS = (1999, 2000, 2001)

_STORED: dict[tuple[str, str], str] = {}


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eligible flights with every feature group, outcome and key.

    Built once per session and table folder and read again from the shared folder, year by year.
    """
    known = (spark.sparkContext.applicationId, sf_dir)
    if known not in _STORED:
        # The tables are joined once: outcomes, network and processed rows all read these flights.
        bound = materialize(B.raw_flights(spark, sf_dir, *BOUND), "bound")
        flights, rates, measures, hubs = at_once(
            spark,
            lambda: eligible(processed(spark, sf_dir, B.with_airline(bound))).select(*PROCESSED),
            lambda: materialize(history.trailing_features(eligible(add_flags(bound))), "rates"),
            lambda: lagged(spark, sf_dir, bound),
            lambda: materialize(P.hub_dimension(B.hub_classes(spark, sf_dir)).select("airport", "faa_hub_category"), "hubs"),
        )
        table = P.enrich(flights, rates, measures, hubs)
        table = table.withColumn("label", F.col("arrival_delay_15min").cast("int"))
        path = f"{scratch_dir(spark)}/enriched-{uuid.uuid4().hex}"
        kept = ["row_key", "year", "flight_date", "ArrDelay", "label", *FEATURES]
        # Tasks write their rows of each year as they are: another shuffle of whole rows would only merge files.
        table.select(*kept).write.partitionBy("year").parquet(path, compression="zstd")
        _STORED[known] = path
    return spark.read.parquet(_STORED[known])


def split(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return temporal_split(enriched(spark, sf_dir), *YEARS)
