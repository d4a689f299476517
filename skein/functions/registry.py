"""Functions and a table function for SQL texts: register(spark) makes them known to a session."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .address import candidates, street_of

# Expressions of the SQL functions; the session inlines them, so they stay within generated code.
SQL_FUNCTIONS = {
    "haversine_km(lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE) RETURNS DOUBLE": "12742.0 * asin(sqrt(power(sin((radians(lat2) - radians(lat1)) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * power(sin(radians(lon2 - lon1) / 2), 2)))",
    "price_score(price DOUBLE, typical DOUBLE, budget DOUBLE) RETURNS DOUBLE": "CASE WHEN price < least(greatest(typical, budget * 0.7), budget) THEN least(price / least(greatest(typical, budget * 0.7), budget), 1.0D) "
    "ELSE 1.0D - 0.5D * (price - least(greatest(typical, budget * 0.7), budget)) / greatest(budget - least(greatest(typical, budget * 0.7), budget), 1.0D) END",
    "wilson_low(successes DOUBLE, n DOUBLE) RETURNS DOUBLE": "(successes / n + 1.96D * 1.96D / (2 * n) - 1.96D * sqrt(successes / n * (1 - successes / n) / n + 1.96D * 1.96D / (4 * n * n))) / (1 + 1.96D * 1.96D / n)",
}


@F.udtf(returnType="pos int, level string, query string, name string, alley string")
class AddressCandidates:
    """address_candidates(address, ward, district): a row for each geocoding query, the most exact first."""

    def eval(self, address: str, ward: str, district: str):
        for k, c in enumerate(candidates(address, ward, district)):
            yield k, c.level, c.query, c.name, c.alley


def register(spark: SparkSession) -> None:
    """haversine_km, price_score, wilson_low, street_of (Arrow batches) and the table function address_candidates."""
    for head, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")

    @F.pandas_udf("string")
    def street(address: pd.Series) -> pd.Series:
        return address.map(lambda a: street_of(a)[0])

    spark.udf.register("street_of", street)
    spark.udtf.register("address_candidates", AddressCandidates)
