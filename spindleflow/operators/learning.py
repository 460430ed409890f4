"""Risk models on Spark ML: softmax, boosted trees, probability calibration, margin calibration, scoring."""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindleflow.functions.labels import label_of_id
from spindleflow.functions.physics import CONTEXT_FEATURES, MarginCalibration, context_features
from spindleflow.operators import forest
from spindleflow.operators.forest import Forest
from spindleflow.operators.metrics import chatter_score, class_weights, standard_scaler
from spindleflow.operators.scan import seeded, unit_interval
from spindleflow.operators.staging import staged
from spindleflow.schema import LABELS
from spindleflow.session import shared_folder


@dataclass
class RiskModel:
    """A fitted scorer: adds ``probability`` (five labels), ``predicted_id``, ``predicted_label`` and the chatter score.

    ``kind`` is softmax, trees or calibrated. ``stages`` are fitted Spark ML models; trees grown from cells are a
    ``forest`` instead; a calibrated model has ``parts``: models with one map for each of their labels, a fitted isotonic
    model or the two numbers of a sigmoid.
    """

    kind: str
    features: tuple[str, ...]
    classes: list[int]
    stages: list = field(default_factory=list)
    stats: dict[str, tuple[float, float]] = field(default_factory=dict)
    parts: list[tuple[RiskModel, dict]] = field(default_factory=list)
    forest: Forest | None = None

    def scorer(self, rows: DataFrame) -> DataFrame:
        return {"softmax": _score_softmax, "trees": _score_trees, "calibrated": _score_calibrated}[self.kind](self, rows)

    def transform(self, df: DataFrame) -> DataFrame:
        return add_predictions(self.scorer(df))

    def save(self, spark: SparkSession, path: str) -> None:
        """Write all that scoring needs under ``path``: the stages, and a line of JSON for the rest."""
        base = path.rstrip("/")
        facts = {
            "kind": self.kind, "features": list(self.features), "classes": self.classes, "stats": self.stats,
            "stages": [type(s).__name__ for s in self.stages], "parts": [], "forest": self.forest and asdict(self.forest),
        }
        for i, stage in enumerate(self.stages):
            stage.write().overwrite().save(f"{base}/stage-{i}")
        for k, (model, maps) in enumerate(self.parts):
            model.save(spark, f"{base}/part-{k}")
            for c, fitted in maps.items():
                if not isinstance(fitted, tuple):
                    fitted.write().overwrite().save(f"{base}/map-{k}-{c}")
            facts["parts"].append([[c, list(m) if isinstance(m, tuple) else None] for c, m in maps.items()])
        spark.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.mode("overwrite").text(f"{base}/model")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> RiskModel:
        """The model saved under ``path``; its scores equal those of the saved one."""
        base = path.rstrip("/")
        facts = json.loads(spark.read.text(f"{base}/model").first()[0])
        readers = {c.__name__: c for c in (LogisticRegressionModel, GBTClassificationModel)}
        parts = []
        for k, maps in enumerate(facts["parts"]):
            held = {c: tuple(m) if m else IsotonicRegressionModel.load(f"{base}/map-{k}-{c}") for c, m in maps}
            parts.append((cls.load(spark, f"{base}/part-{k}"), held))
        stages = [readers[name].load(f"{base}/stage-{i}") for i, name in enumerate(facts["stages"])]
        stats = {name: tuple(pair) for name, pair in facts["stats"].items()}
        grown = Forest(**facts["forest"]) if facts.get("forest") else None
        return cls(facts["kind"], tuple(facts["features"]), facts["classes"], stages, stats, parts, grown)


def _score_softmax(model: RiskModel, rows: DataFrame) -> DataFrame:
    assembled = rows.withColumn("_x", array_to_vector(F.array(*_scaled(list(model.features), model.stats))))
    out = model.stages[0].transform(assembled)
    return out.withColumn("probability", _aligned(F.col("_p"), model.classes)).drop("_x", "_p", "_r", "_c")


def _score_trees(model: RiskModel, rows: DataFrame) -> DataFrame:
    if model.forest:
        out = rows.withColumn("_s", model.forest.scores([F.col(f) for f in model.features]))
        out = out.withColumns({f"_s{c}": F.col("_s")[i] for i, c in enumerate(model.classes)})
        return normalised(out, model.classes).drop("_s", *[f"_s{c}" for c in model.classes])
    out = VectorAssembler(inputCols=list(model.features), outputCol="_x").transform(rows)
    for c, stage in zip(model.classes, model.stages):
        out = stage.transform(out).withColumn(f"_s{c}", vector_to_array("probability")[1])
        out = out.drop("probability", "rawPrediction", "prediction")
    return normalised(out, model.classes).drop("_x", *[f"_s{c}" for c in model.classes])


def _score_calibrated(model: RiskModel, rows: DataFrame) -> DataFrame:
    """The mean of the parts' calibrated scores, normalised."""
    out = rows
    for k, (part, maps) in enumerate(model.parts):
        out = part.scorer(out)
        for c, fitted in maps.items():
            s = F.col("probability")[c]
            if isinstance(fitted, tuple):
                out = out.withColumn(f"_m{k}_{c}", 1.0 / (1.0 + F.exp(-(fitted[1] + fitted[0] * s))))
            else:
                out = fitted.transform(out.withColumn("s", s)).drop("s").withColumnRenamed(f"_q{c}", f"_m{k}_{c}")
        out = out.drop("probability")
    for c in model.classes:
        shares = [F.col(f"_m{k}_{c}") for k, (_, maps) in enumerate(model.parts) if c in maps]
        out = out.withColumn(f"_s{c}", sum(shares[1:], shares[0]) / len(model.parts))
    used = [f"_m{k}_{c}" for k, (_, maps) in enumerate(model.parts) for c in maps]
    return normalised(out, model.classes).drop(*used, *[f"_s{c}" for c in model.classes])


def add_predictions(df: DataFrame) -> DataFrame:
    p = F.col("probability")
    best = (F.array_position(p, F.array_max(p)) - 1).cast("int")
    return df.withColumns(
        {"predicted_id": best, "predicted_label": label_of_id(best), "predicted_chatter_score": chatter_score()}
    )


def balanced(df: DataFrame, label: str, weight: str = "weight") -> DataFrame:
    """Attach balanced class weights; the weight table has one row per label, so it goes to the rows: a join by label
    would leave each label's rows to one task."""
    return df.join(F.broadcast(class_weights(df, label).select(label, F.col("weight").alias(weight))), label)


def _scaled(features: list[str], stats: dict[str, tuple[float, float]]) -> list[Column]:
    return [((F.col(f) - stats[f][0]) / stats[f][1]).alias(f) for f in features]


def _statistics(df: DataFrame, features: list[str]) -> dict[str, tuple[float, float]]:
    """One (mean, scale) pair per feature: as many driver values as the model has inputs."""
    return {r["name"]: (r["mean"], r["scale"]) for r in standard_scaler(df, features).collect()}


def _aligned(vector: Column, classes: list[int]) -> Column:
    """Probabilities of the seen classes spread over all five labels."""
    values = vector_to_array(vector)
    return F.array(*[values[classes.index(i)] if i in classes else F.lit(0.0) for i in range(len(LABELS))])


def seen_classes(df: DataFrame, label: str) -> list[int]:
    return sorted(r[0] for r in df.select(label).distinct().collect())


def train_softmax(
    df: DataFrame, features: tuple[str, ...], label: str, l2: float = 1e-3, max_iter: int = 100
) -> RiskModel:
    """Weighted multinomial logistic regression on z-scored features, L2 on the weights only."""
    names = list(features)
    stats = _statistics(df, names)
    classes = seen_classes(df, label)

    def assemble(rows: DataFrame) -> DataFrame:
        z = F.array(*_scaled(names, stats))
        return rows.withColumn("_x", array_to_vector(z))

    index = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label).cast("int")) - 1
    train = assemble(balanced(df, label)).withColumn("_y", index.cast("double")).select("_x", "_y", "weight").persist()
    model = LogisticRegression(
        featuresCol="_x", labelCol="_y", weightCol="weight", family="multinomial", standardization=False, regParam=l2,
        maxIter=max_iter, probabilityCol="_p", rawPredictionCol="_r", predictionCol="_c",
    ).fit(train)
    train.unpersist()

    return RiskModel("softmax", tuple(features), classes, [model], stats)


def train_trees(
    df: DataFrame, features: tuple[str, ...], label: str, max_iter: int = 250, step: float = 0.05, depth: int = 4,
    min_rows: int = 5, seed: int = 303,
) -> RiskModel:
    """Boosted trees, one forest per seen label against the rest, balanced weights, normalised probabilities.

    Trees are grown from cells (rows counted by their bins), whatever the number of rows. Where rows are alike so seldom
    that the cells exceed a task, Spark's own trees are grown over the rows.
    """
    weights = {r[label]: r["weight"] for r in class_weights(df, label).collect()}
    classes = sorted(weights)
    if not classes:
        return RiskModel("trees", tuple(features), classes)
    edges = forest.bin_edges(df, features, label)
    cells = forest.count_cells(df, features, label, classes, edges)
    if cells.count() <= forest.CELLS:
        grown = forest.grow(cells, [weights[c] for c in classes], edges, max_iter, step, depth, min_rows)
        return RiskModel("trees", tuple(features), classes, forest=grown)

    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:  # else each tree would carry all before it in its lineage
        context.setCheckpointDir(shared_folder(df.sparkSession))
    assembler = VectorAssembler(inputCols=list(features), outputCol="_x")
    train = assembler.transform(balanced(df, label)).select("_x", label, "weight").persist()
    models = []
    for c in classes:
        binary = train.withColumn("_y", (F.col(label) == c).cast("double"))
        models.append(
            GBTClassifier(
                featuresCol="_x", labelCol="_y", weightCol="weight", maxIter=max_iter, stepSize=step, maxDepth=depth,
                minInstancesPerNode=min_rows, seed=seed,
            ).fit(binary)
        )
    train.unpersist()

    return RiskModel("trees", tuple(features), classes, models)


def normalised(df: DataFrame, classes: list[int], prefix: str = "_s") -> DataFrame:
    total = sum((F.col(f"{prefix}{c}") for c in classes), F.lit(0.0))
    share = [
        F.coalesce(F.try_divide(F.col(f"{prefix}{c}"), total), F.lit(1.0 / len(classes))) if c in classes else F.lit(0.0)
        for c in range(len(LABELS))
    ]
    return df.withColumn("probability", F.array(*share))


def calibration_plan(df: DataFrame, label: str, method: str) -> dict[str, object]:
    """Folds for a calibration method; skipped when some class has fewer than two rows."""
    if method == "none":
        return {"method": None, "status": "disabled", "folds": None}
    if method not in ("sigmoid", "isotonic"):
        raise ValueError("calibration must be none, sigmoid or isotonic")
    least = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n")).collect()[0][0] or 0
    if least < 2:
        return {"method": method, "status": "skipped", "folds": None}
    return {"method": method, "status": "enabled", "folds": min(3, least)}


def calibrate_scores(
    df: DataFrame, fit: Callable[[DataFrame], RiskModel], label: str, key: str, method: str, folds: int, seed: int = 303
) -> RiskModel:
    """Fit on all folds but one, calibrate each label's score on the fold left out, average the calibrated models."""
    fold = F.floor(unit_interval(seeded(seed, F.col(key))) * folds).cast("int")
    tagged = df.withColumn("_fold", fold).persist()
    pairs, scores = [], []
    for k in range(folds):
        model = fit(tagged.where(F.col("_fold") != k).drop("_fold"))
        held = model.scorer(tagged.where(F.col("_fold") == k).drop("_fold"))
        scores.append(held.select(F.lit(k).alias("fold"), F.col("probability").alias("p"), F.col(label).alias("label")))
        pairs.append((model, {}))
    # Each row is scored once, for the maps of all its labels.
    held = staged(reduce(DataFrame.unionByName, scores), "calibration-scores")
    tagged.unpersist()
    if method == "isotonic":
        for k, (model, maps) in enumerate(pairs):
            for c in model.classes:
                rows = held.where(F.col("fold") == k).select(F.col("p")[c].alias("s"), (F.col("label") == c).cast("double").alias("y"))
                maps[c] = IsotonicRegression(featuresCol="s", labelCol="y", predictionCol=f"_q{c}").fit(rows)
    else:
        fitted = sigmoid_maps(held, sorted((k, c) for k, (model, _) in enumerate(pairs) for c in model.classes))
        for (k, c), line in fitted.items():
            pairs[k][1][c] = line
    classes = sorted({c for model, _ in pairs for c in model.classes})

    return RiskModel("calibrated", pairs[0][0].features, classes, parts=pairs)


def sigmoid_maps(rows: DataFrame, wanted: list[tuple[int, int]], most: int = 100) -> dict[tuple[int, int], tuple[float, float]]:
    """Slope and intercept of a logistic map of one score for each (fold, class), at the optimum without a penalty.

    ``rows`` have fold, p (scores of all classes) and label. Newton steps of all maps go together: one aggregate of five
    sums a map each step. A step that makes a map worse is halved; a score that never varies has slope 0, and a class
    without or with nothing but rows of its own an infinite intercept.
    """
    y = {c: (F.col("label") == c).cast("double") for _, c in wanted}
    counts = {
        r["fold"]: r
        for r in rows.groupBy("fold").agg(
            F.count(F.lit(1)).cast("double").alias("n"),
            *[f(e).alias(f"{name}{c}") for c in y for name, f, e in (("y", F.sum, y[c]), ("low", F.min, F.col("p")[c]), ("high", F.max, F.col("p")[c]))],
        ).collect()
    }
    done, now, steps, loss = {}, {}, {}, {}
    for k, c in wanted:
        n, positive = (counts[k]["n"], counts[k][f"y{c}"]) if k in counts else (0.0, 0.0)
        if positive in (0.0, n):
            done[k, c] = (0.0, math.inf if positive else -math.inf)
            continue
        now[k, c] = (0.0, math.log(positive / (n - positive)))
        if counts[k][f"low{c}"] == counts[k][f"high{c}"]:
            done[k, c] = now.pop((k, c))
    for _ in range(most):
        if not now:
            break
        # The maps of one step are a literal of a few numbers, looked up by fold.
        classes = sorted({c for _, c in now})
        sums = []
        for c in classes:
            line = [_by_fold({k: value[j] for (k, d), value in now.items() if d == c}) for j in (0, 1)]
            s = F.col("p")[c]
            z = line[0] * s + line[1]
            p = 1.0 / (1.0 + F.exp(-z))
            away, weight = y[c] - p, p * (1.0 - p)
            # log(1 + exp(z)) - y z, without overflow
            cost = F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - y[c] * z
            parts = (cost, away, away * s, weight, weight * s, weight * s * s)
            sums += [F.sum(e).alias(f"_{j}_{c}") for j, e in enumerate(parts)]
        found = {r["fold"]: r for r in rows.where(F.col("fold").isin(sorted({k for k, _ in now}))).groupBy("fold").agg(*sums).collect()}
        for k, c in list(now):
            cost, g0, g1, h00, h01, h11 = (found[k][f"_{j}_{c}"] for j in range(6))
            if (k, c) in loss and cost > loss[k, c] + 1e-12 * abs(cost):
                a, b = steps[k, c]
                now[k, c] = (now[k, c][0] - a / 2, now[k, c][1] - b / 2)
                steps[k, c] = (a / 2, b / 2)
                if max(abs(a), abs(b)) < 1e-9:
                    done[k, c] = now.pop((k, c))
                continue
            det = h00 * h11 - h01 * h01
            if not det > 1e-14 * h00 * h11:
                done[k, c] = now.pop((k, c))
                continue
            a, b = (h00 * g1 - h01 * g0) / det, (h11 * g0 - h01 * g1) / det
            # Half of the gain that the step promises; what it is worth beside the loss decides the end.
            gain = 0.5 * (a * g1 + b * g0)
            loss[k, c], steps[k, c] = cost, (a, b)
            now[k, c] = (now[k, c][0] + a, now[k, c][1] + b)
            if gain <= max(1e-10 * cost, 1e-12 * counts[k]["n"]):
                done[k, c] = now.pop((k, c))
    return done | now


def _by_fold(values: dict[int, float]) -> Column:
    found = F.lit(0.0)
    for k, value in values.items():
        found = F.when(F.col("fold") == k, F.lit(value)).otherwise(found)
    return found


def fit_margin_calibration(df: DataFrame, margin: str, positive: str, context: bool = False) -> MarginCalibration:
    """Balanced logistic of the positive flag on the raw margin or the 13 context features."""
    counts = df.agg(F.sum(F.col(positive).cast("long")), F.count(F.lit(1))).collect()[0]
    if not counts[0] or counts[0] == counts[1]:
        raise ValueError("margin calibration needs both target classes")
    names = list(CONTEXT_FEATURES) if context else ["raw_margin"]
    values = context_features(df.columns, F.col(margin))
    rows = df.select(*[values[n].alias(n) for n in names], F.col(positive).cast("double").alias("_y"))
    stats = _statistics(rows, names)
    train = balanced(rows, "_y").withColumn("_x", array_to_vector(F.array(*_scaled(names, stats)))).persist()
    total = train.agg(F.sum("weight")).collect()[0][0]
    model = LogisticRegression(
        featuresCol="_x", labelCol="_y", weightCol="weight", standardization=False, regParam=1.0 / total, maxIter=200
    ).fit(train)
    train.unpersist()
    coefs, intercept = [float(c) for c in model.coefficients], float(model.intercept)
    if not context:
        mean, scale = stats["raw_margin"]
        return MarginCalibration(intercept - coefs[0] * mean / scale, coefs[0] / scale)
    return MarginCalibration(
        intercept, 0.0, tuple(coefs), tuple(names), tuple(stats[n][0] for n in names), tuple(stats[n][1] for n in names)
    )
