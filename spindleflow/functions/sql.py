"""SQL names for the column functions, so that they can be called from ``spark.sql``."""

from pyspark.sql import SparkSession

from spindleflow.functions.labels import STATUS_WORDS
from spindleflow.functions.signal import spectral_features


def _status_body() -> str:
    cases = " ".join(
        f"WHEN lower(trim(status)) IN ({', '.join(repr(w) for w in words)}) THEN '{label}'"
        for label, words in STATUS_WORDS.items()
    )
    number = "try_cast(lower(trim(status)) AS DOUBLE)"
    return (
        f"CASE WHEN status IS NULL THEN 'unknown' {cases} WHEN {number} > 0.5 THEN 'slight'"
        f" WHEN {number} IS NOT NULL THEN 'stable' ELSE 'unknown' END"
    )


_SIG = "1 / (1 + exp(-({0})))"
_SIGNAL = (
    "least(1D, 0.55D * "
    + _SIG.format("(log10(chatter / greatest(tooth, 1e-18) + 1e-12) + 0.4D) * 2D")
    + " + 0.25D * "
    + _SIG.format("(crest - 4D) / 1.5D")
    + " + 0.2D * "
    + _SIG.format("(entropy - 0.55D) * 6D")
    + ")"
)


def register(spark: SparkSession) -> None:
    """``spectral_features(series, rate, rpm, flutes, modal)``, ``status_to_label(text)``, ``risk_score(...)``."""
    spark.udf.register("spectral_features", spectral_features)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION status_to_label(status STRING) RETURNS STRING RETURN {_status_body()}")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION risk_score(chatter DOUBLE, tooth DOUBLE, crest DOUBLE, entropy DOUBLE,"
        " margin DOUBLE) RETURNS DOUBLE RETURN least(1D, greatest(0D, 0.55D * "
        + _SIG.format("-margin / 0.2D")
        + f" + 0.45D * {_SIGNAL}))"
    )
