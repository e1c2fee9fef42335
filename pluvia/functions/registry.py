"""The scalar functions under SQL names: SQL functions, which Catalyst inlines; no Python runs."""

from __future__ import annotations

from pyspark.sql import SparkSession

from pluvia.functions.scalars import D8

_D8_ROW = " ".join(f"WHEN {code} THEN named_struct('dr', {dr}, 'dc', {dc})" for code, dr, dc in D8)

FUNCTIONS = {
    "scs_runoff(p DOUBLE, cn DOUBLE)": """CASE WHEN cn > 0 AND cn <= 100 AND p > 0.2D * (25400.0D / cn - 254.0D)
        THEN CASE WHEN cn = 100 THEN p ELSE pow(p - 0.2D * (25400.0D / cn - 254.0D), 2) / (p + 0.8D * (25400.0D / cn - 254.0D)) END ELSE 0.0D END""",
    "dbz_to_rain(dbz DOUBLE)": "CASE WHEN NOT isnan(dbz) THEN pow(pow(10.0D, dbz / 10) / 200, 1 / 1.6D) END",
    "risk_class(v DOUBLE)": """CASE WHEN v BETWEEN 0 AND 1 THEN CASE WHEN v <= 0.25 THEN 'R1' WHEN v <= 0.5 THEN 'R2' WHEN v <= 0.75 THEN 'R3' ELSE 'R4' END
        WHEN v > 1 AND v <= 4.5 THEN concat('R', CAST(CAST(rint(v) AS INT) AS STRING)) END""",
    "d8_offset(code INT)": f"CASE code {_D8_ROW} END",
    "cf_hours(t TIMESTAMP)": "(unix_micros(t) / 1000000.0D + 2208988800) / 3600.0D",
}


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session's SQL."""
    for signature, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
