"""Label vocabulary: ids, severities, text to label, risk to label."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from spindleflow.schema import LABEL_ID, POSITIVE_LABELS, SEVERITY

# Status words per label.
STATUS_WORDS = {
    "unknown": (
        "", "unknown", "nan", "none", "null", "-1", "no machining", "nomachining", "sensorerror", "sensor error",
    ),
    "stable": ("0", "false", "no", "normal", "stable", "non-chatter", "non_chatter", "nochatter"),
    "transition": ("transition", "incipient", "warning"),
    "severe": ("severe", "heavy", "strong"),
    "slight": ("1", "true", "yes", "chatter", "slight", "mild", "unstable"),
}


def _lookup(key: Column, table: dict, default) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.coalesce(key, F.lit("unknown"))), F.lit(default))


def id_of_label(label: Column) -> Column:
    return _lookup(label, LABEL_ID, LABEL_ID["unknown"])


def severity_of_label(label: Column) -> Column:
    return _lookup(label, SEVERITY, SEVERITY["unknown"])


def label_of_id(label_id: Column) -> Column:
    names = F.array(*[F.lit(name) for name in LABEL_ID])
    return F.coalesce(F.get(names, label_id), F.lit("unknown"))


def is_positive(label: Column) -> Column:
    return F.coalesce(label.isin(*POSITIVE_LABELS), F.lit(False))


def status_to_label(text: Column) -> Column:
    """Free status text to a label: word table first, then a number above 0.5 is slight, else unknown."""
    word = F.lower(F.trim(text))
    result = F.lit(None).cast("string")
    for label, words in STATUS_WORDS.items():
        result = F.when(word.isin(*words), F.lit(label)) if label == "unknown" else result.when(
            word.isin(*words), F.lit(label)
        )
    number = word.try_cast("double")
    return (
        F.when(text.isNull(), F.lit("unknown"))
        .otherwise(
            F.coalesce(
                result,
                F.when(number > 0.5, F.lit("slight")).when(number.isNotNull(), F.lit("stable")),
                F.lit("unknown"),
            )
        )
    )


def comment_to_label(text: Column) -> Column:
    """Trial comment: empty or a plain operation name is stable, any mention of chatter is slight."""
    word = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return (
        F.when(word == "", F.lit("stable"))
        .when(word.contains("chatter"), F.lit("slight"))
        .when(word.isin("roughing", "finishing"), F.lit("stable"))
        .otherwise(F.lit("unknown"))
    )


def vote_to_label(*votes: Column) -> Column:
    """Largest operator vote: 0 stable, below 2 slight, else severe; a missing vote counts as 0."""
    filled = [F.coalesce(v.try_cast("double"), F.lit(0.0)) for v in votes]
    vote = F.greatest(*filled) if len(filled) > 1 else filled[0]
    return F.when(vote <= 0, F.lit("stable")).when(vote < 2, F.lit("slight")).otherwise(F.lit("severe"))


def quality_to_label(quality: Column) -> Column:
    return F.when(quality == "good", F.lit("stable")).otherwise(F.lit("severe"))


def risk_to_label(risk: Column) -> Column:
    return (
        F.when(risk < 0.30, F.lit("stable"))
        .when(risk < 0.55, F.lit("transition"))
        .when(risk < 0.80, F.lit("slight"))
        .otherwise(F.lit("severe"))
    )


def set_label(df, label: Column):
    """Rewrite the label together with its id, its positive flag and its time sentinel."""
    positive = is_positive(F.col("label"))
    return (
        df.withColumn("label", label)
        .withColumn("label_id", id_of_label(F.col("label")))
        .withColumn("chatter_within_horizon", positive)
        .withColumn("time_to_chatter_s", F.when(positive, F.lit(0.0)).otherwise(F.lit(-1.0)))
    )
