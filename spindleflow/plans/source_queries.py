"""Scan and sink queries: Spark writes files from the shared tables, then the scans under test read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindleflow.operators import metrics, runs, timebase
from spindleflow.operators.scan import with_position
from spindleflow.operators.staging import staged
from spindleflow.plans.catalog import pick, query, read
from spindleflow.plans.inputs import LAYOUT, PRED_SQL, TRACE_SQL, WIN_SQL, trace, windows, with_probabilities
from spindleflow.plans.ingest import WindowPlan, ingest_controller, ingest_machine_run, ingest_packages, ingest_samples, ingest_sound, machine_windows
from spindleflow.schema import struct_of
from spindleflow.session import shared_folder
from spindleflow.sources import packages, tables
from spindleflow.sources.machine_run import align_run


def folder_for(spark: SparkSession, name: str) -> str:
    return tables.fresh_path(shared_folder(spark), name)


_SLIM = "window_id:L scenario:S episode:L start_time_s:D label:S label_id:I rms:D chatter_band_energy:D"


@query(
    "s1_read_windows",
    f"WITH {WIN_SQL} SELECT {pick('window_id scenario episode label', 'start_time_s rms chatter_band_energy', 'label_id')} FROM win",
)
def s1(spark: SparkSession, folder: str) -> DataFrame:
    schema = struct_of(_SLIM)
    path = folder_for(spark, "windows-csv")
    tables.write_table(windows(spark, folder).select(*schema.names), path, "csv")
    return tables.read_windows(spark, path, "csv", schema)


def _package_files(spark: SparkSession, folder: str, wide: bool) -> str:
    """Embeddings as package CSV files: vector cells, or one column for each value of an axis (half a vector)."""
    x = F.col("embedding").cast("array<double>")
    rows = read(spark, folder, "embeddings").select(
        F.col("vec_id").cast("string").alias("timestamp"),
        F.when(F.col("vec_id") % 7 == 0, "bad").otherwise("1000").alias("fs"),
        (F.col("label") * 100.0).cast("string").alias("spindlespeed"),
        F.when(F.col("label") < 2, "No Machining").when(F.col("label") < 6, "0").otherwise("chatter").alias("status"),
        x.alias("x"),
    )
    if wide:
        axes = [(a, F.slice("x", 1 + 32 * j, 32)) for j, a in enumerate(("x", "y"))]
        rows = rows.select(
            "timestamp", "fs", "spindlespeed", "status",
            *[F.get(v, F.lit(i)).cast("string").alias(f"{a}_channel_{i}") for a, v in axes for i in (k * 13 % 32 for k in range(32))],
        )
    else:
        text = F.concat(F.lit("["), F.array_join(F.col("x").cast("array<string>"), ";"), F.lit("]"))
        broken = F.when(F.col("timestamp").cast("long") % 11 == 3, F.lit("1 2 x 4")).otherwise(text)
        rows = rows.select("timestamp", "fs", "spindlespeed", "status", broken.alias("x_channel"),
                           F.array_join(F.transform(F.slice("x", 1, 60), lambda v: v / 2).cast("array<string>"), " ").alias("y_channel"))
    path = folder_for(spark, "packages")
    rows.write.option("header", True).csv(path)
    return path


@query(
    "s2_read_packages",
    """WITH p AS (SELECT vec_id, label, embedding::DOUBLE[] AS x, vec_id % 11 = 3 AS broken FROM embeddings),
    u AS (SELECT *, CASE WHEN label < 2 THEN 'unknown' WHEN label < 6 THEN 'stable' ELSE 'slight' END AS state FROM p)
    SELECT state AS label, count(*) AS packages, count(*) FILTER (NOT broken AND state <> 'unknown') AS kept, round(sum(CASE WHEN vec_id % 7 = 0 THEN 500e0 ELSE 1000e0 END), 6) AS rate_sum,
      round(sum(CASE WHEN label > 0 THEN label * 100e0 ELSE 9000e0 END), 6) AS rpm_sum, CAST(sum(CASE WHEN broken THEN 0 ELSE 60 END) AS BIGINT) AS samples,
      round(sum(CASE WHEN broken THEN 0e0 ELSE list_sum(x[1:60]) END), 5) + 0.0 AS x_sum FROM u GROUP BY 1""",
)
def s2(spark: SparkSession, folder: str) -> DataFrame:
    rows = packages.read_packages(spark, _package_files(spark, folder, False), default_rate=500.0)
    xs = F.aggregate("signal", F.lit(0.0), lambda a, s: a + s[0])
    return rows.groupBy("label").agg(
        F.count(F.lit(1)).alias("packages"),
        F.sum(F.col("kept").cast("long")).alias("kept"),
        F.sum("fs").alias("rate_sum"),
        F.sum("spindle_rpm").alias("rpm_sum"),
        F.sum(F.coalesce(F.when(F.col("signal").isNotNull(), F.size("signal")), F.lit(0))).alias("samples"),
        F.round(F.sum(F.coalesce(xs, F.lit(0.0))), 5).alias("x_sum"),
    )


@query(
    "s2_read_wide_packages",
    """SELECT CASE WHEN label < 2 THEN 'unknown' WHEN label < 6 THEN 'stable' ELSE 'slight' END AS label, count(*) AS packages,
      
      round(sum(list_sum(list_transform(range(1, 33), lambda i: i * embedding[i]::DOUBLE))), 5) + 0.0 AS x_in_place, round(sum(list_sum(list_transform(range(1, 33), lambda i: i * embedding[i + 32]::DOUBLE))), 5) + 0.0 AS y_in_place,
      CAST(sum(len(embedding)) AS BIGINT) AS numbers FROM embeddings GROUP BY 1""",
)
def s2_wide(spark: SparkSession, folder: str) -> DataFrame:
    rows = packages.read_packages(spark, _package_files(spark, folder, True), include_unknown=True)
    return rows.groupBy("label").agg(
        F.count(F.lit(1)).alias("packages"),
        F.round(F.sum(_in_place(0)), 5).alias("x_in_place"),
        F.round(F.sum(_in_place(1)), 5).alias("y_in_place"),
        F.sum(F.size("signal") * F.size(F.col("signal")[0])).alias("numbers"),
    )


def _in_place(axis: int):
    """Sum of an axis' samples, each weighted by its place, so that a value out of order shows."""
    weighed = F.transform("signal", lambda s, i: s[axis] * (i + 1))
    return F.aggregate(weighed, F.lit(0.0), lambda a, x: a + x)


def _recordings(spark: SparkSession, folder: str) -> str:
    base = folder_for(spark, "recordings")
    rows = read(spark, folder, "events").select("event_id", "event_type", F.col("value").alias("x"), (F.col("value") * 2).alias("y"), F.lit(1.5).alias("z"))
    bad = F.col("event_type") == "error"
    # One file for each third of the ids.
    last = rows.agg(F.max("event_id") + 1).first()[0]
    rows = rows.withColumn("third", F.expr(f"event_id * 3 div {last}"))
    for quality, kept in (("good", ~bad), ("bad", bad)):
        part = rows.where(kept).repartition("third").sortWithinPartitions("third", "event_id")
        part.drop("event_type").write.partitionBy("third").option("header", True).csv(f"{base}/M01/OP07/{quality}")
    return base


@query(
    "s3_discover_files",
    """SELECT 'M01' AS machine, 'OP07' AS operation, CASE event_type WHEN 'error' THEN 'bad' ELSE 'good' END AS quality, count(*) AS samples,
      CAST(sum(length(CAST(event_id AS VARCHAR))) AS BIGINT) AS digits FROM events GROUP BY ALL""",
)
def s3(spark: SparkSession, folder: str) -> DataFrame:
    """Every discovered file with the rows it holds, by the attributes of its folder."""
    base = _recordings(spark, folder)
    inside = F.regexp_extract("path", r"(/M\d+/.*)$", 1)
    found = tables.discover_files(spark, base, "*.csv").withColumn("name", inside).where("length > 0")
    lines = spark.read.option("header", True).option("recursiveFileLookup", True).csv(base)
    lines = lines.select(F.col("_metadata.file_path").alias("path"), "event_id").withColumn("name", inside).drop("path")
    return found.join(lines, "name").groupBy("machine", "operation", "quality").agg(
        F.count(F.lit(1)).alias("samples"), F.sum(F.length("event_id")).alias("digits")
    )


@query(
    "s4_read_triaxial",
    """SELECT 'M01_OP07' AS scenario, CASE event_type WHEN 'error' THEN 'bad' ELSE 'good' END AS quality, count(*) AS samples, count(*) AS numbered, round(sum(value), 6) AS x, round(sum(value * 2), 6) AS y
    FROM events GROUP BY ALL""",
)
def s4(spark: SparkSession, folder: str) -> DataFrame:
    samples = tables.read_triaxial(spark, _recordings(spark, folder), 2000.0)
    per_file = samples.groupBy("scenario", "quality", "recording").agg(
        F.count(F.lit(1)).alias("n"), (F.max("sample_idx") + 1).alias("last"), F.sum(F.col("ch")[0]).alias("x"), F.sum(F.col("ch")[1]).alias("y")
    )
    return per_file.groupBy("scenario", "quality").agg(
        F.sum("n").alias("samples"), F.sum("last").alias("numbered"), F.sum("x").alias("x"), F.sum("y").alias("y")
    )


@query(
    "s5_read_controller",
    "SELECT count(*) AS samples, round(sum(value), 6) AS load_sum, round(sum(value / 2), 6) AS current_sum FROM events WHERE event_type <> 'signup'",
)
def s5(spark: SparkSession, folder: str) -> DataFrame:
    path = folder_for(spark, "controller")
    read(spark, folder, "events").select(
        F.col("event_id").alias("CYCLE"),
        F.when(F.col("event_type") == "signup", "n/a").otherwise(F.col("value").cast("string")).alias("LOAD|6"),
        (F.col("value") / 2).alias("CURRENT|6"),
    ).write.option("header", True).csv(path)
    rows = tables.read_controller_hf(spark, path, ("LOAD|6", "CURRENT|6"), 500.0)
    return rows.agg(
        F.count(F.lit(1)).alias("samples"), F.sum(F.col("ch")[0]).alias("load_sum"), F.sum(F.col("ch")[1]).alias("current_sum")
    )


@query(
    "s6_read_trial_sheet",
    """SELECT 'T' || p_partkey AS trial, CASE p_partkey // 100 % 3 WHEN 0 THEN 'Thermoforming mold' WHEN 1 THEN 'Injection mold' ELSE 'Impeller' END AS component, p_name AS comment,
      p_size * 100e0 AS spindle_rpm, CASE WHEN p_size % 2 = 0 THEN p_size / 10e0 ELSE p_size / 20e0 END AS axial_depth_mm, 4 AS flutes FROM part WHERE p_partkey % 100 > 1""",
)
def s6(spark: SparkSession, folder: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    section = F.get(F.array(*[F.lit(s) for s in tables.SHEET_SECTIONS]), (F.floor(k / 100) % 3).cast("int"))
    blank = F.lit("")
    header = F.array(*[F.lit(h) for h in ("Trial", "Comment", "Spindle Speed [U/min]", "Cutting depth [mm]", "Optimal Cutting depth [mm]", "Number of teeth")])
    data = F.array(
        F.concat(F.lit("T"), k.cast("string")),
        F.col("p_name"),
        (size * 100).cast("string"),
        F.when(size % 2 == 0, (size / 10.0).cast("string")).otherwise(blank),
        (size / 20.0).cast("string"),
        F.lit("4"),
    )
    rows = read(spark, folder, "part").select(
        k.alias("row"), F.when(k % 100 == 0, F.array(section, blank)).when(k % 100 == 1, header).otherwise(data).alias("cells")
    )
    return tables.read_trial_sheet(rows).select("trial", "component", "comment", "spindle_rpm", "axial_depth_mm", "flutes")


@query(
    "s9_read_cutting_intervals",
    f"""WITH {WIN_SQL} SELECT count(*) AS intervals, round(sum(k - 10.5e0), 6) AS length_sum FROM win WHERE k - 10.5e0 > 0""",
)
def s9(spark: SparkSession, folder: str) -> DataFrame:
    path = folder_for(spark, "cutting")
    windows(spark, folder).select(
        F.col("value").alias("Start"), (F.col("value") + F.col("k") - 10.5).alias("End")
    ).write.option("header", True).csv(path)
    found = tables.read_cutting_intervals(spark, path)
    return found.agg(F.count(F.lit(1)).alias("intervals"), F.sum(F.col("end") - F.col("start")).alias("length_sum"))


@query(
    "s9_read_label_intervals",
    f"""WITH {WIN_SQL} SELECT CASE k % 5 WHEN 0 THEN 'stable' WHEN 1 THEN 'slight' WHEN 2 THEN 'stable' WHEN 3 THEN 'unknown' ELSE 'severe' END AS label, count(*) AS intervals,
      round(sum(k + 0.5e0), 6) AS length_sum, round(min(value), 6) AS first_start FROM win GROUP BY 1""",
)
def s9_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Label intervals written from the windows, in names, numbers and free text, and read back."""
    path = folder_for(spark, "label-intervals")
    words = F.array(*[F.lit(w) for w in ("stable", "Slight", "0", "", "SEVERE")])
    windows(spark, folder).select(
        F.col("value").alias("start_time_s"), (F.col("value") + F.col("k") + 0.5).alias("end_time_s"), F.get(words, (F.col("k") % 5).cast("int")).alias("label")
    ).write.option("header", True).csv(path)
    found = tables.read_label_intervals(spark, path)
    length = F.col("end_time_s") - F.col("start_time_s")
    return found.groupBy("label").agg(
        F.count(F.lit(1)).alias("intervals"), F.sum(length).alias("length_sum"), F.min("start_time_s").alias("first_start")
    )


@query(
    "s10_operator_labels",
    """SELECT p_partkey AS position, CASE WHEN greatest(p_size % 3, p_size % 2) <= 0 THEN 'stable' WHEN greatest(p_size % 3, p_size % 2) < 2 THEN 'slight' ELSE 'severe' END AS label,
      2 AS flutes, greatest(p_size * 90e0, 1e0) AS spindle_rpm, round(1e6 * greatest(p_size * 0.0254e0 / (greatest(p_size * 90e0, 1e0) * 2), 1e-9), 6) AS feed_um,
      round(1e3 * (p_size / 7e0) * 0.0254e0, 6) AS depth_mm FROM part WHERE p_size % 5 <> 0""",
)
def s10(spark: SparkSession, folder: str) -> DataFrame:
    size = F.col("p_size")
    rows = read(spark, folder, "part").select(
        F.col("p_partkey").alias("position"),
        F.when(size % 5 == 0, "").otherwise(F.col("p_partkey").cast("string")).alias("No."),
        F.lit('3/8" 2-Flute end mill').alias("Tool"),
        (size * 90).cast("string").alias("Spindle speed [RPM]"),
        size.cast("string").alias("Feedrate [IPM]"),
        (size / 7.0).cast("string").alias("Depth of cut [inch]"),
        F.lit("n/a").alias("Width of cut [inch]"),
        (size % 3).cast("string").alias("Chatter (operator 1)"),
        (size % 2).cast("string").alias("Chatter (operator 2)"),
    )
    done = tables.operator_labels(rows)
    return done.select(
        "position", "label", "flutes", "spindle_rpm", (F.col("feed_per_tooth_m") * 1e6).alias("feed_um"), (F.col("axial_depth_m") * 1e3).alias("depth_mm")
    )


def _run_files(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """One metrics file per (algorithm, seed); requested are these runs and one named after each nation, which has none."""
    run = F.concat_ws("-", "training_algorithm", F.col("seed").cast("string"))
    stats = trace(spark, folder).groupBy(run.alias("run")).agg(
        F.avg("risk_now").alias("a"), F.avg("reward").alias("b"), F.avg("raw_feed_override").alias("c")
    )
    f1 = lambda name: F.struct(F.col(name).alias("f1"))
    nested = stats.select(
        "run",
        F.struct(F.lit("episode").alias("mode")).alias("split"),
        F.struct(F.lit("horizon").alias("mode")).alias("target"),
        F.struct(F.col("a").alias("accuracy"), F.col("b").alias("binary_chatter_f1")).alias("test"),
        F.struct(f1("c").alias("test"), F.struct(f1("a").alias("test_at_selected_threshold")).alias("threshold_selection")).alias("lead_time"),
        F.struct(f1("b").alias("test")).alias("event_warning"),
    )
    base = folder_for(spark, "runs")
    nested.withColumn("dir", F.col("run")).repartition("dir").write.partitionBy("dir").json(base)
    asked = stats.select(F.concat(F.lit("dir="), F.col("run")).alias("run")).union(
        read(spark, folder, "nation").select(F.concat(F.lit("dir="), F.col("n_name")).alias("run"))
    )

    number = T.StructType().add("f1", "double")
    schema = (
        T.StructType()
        .add("split", T.StructType().add("mode", "string"))
        .add("target", T.StructType().add("mode", "string"))
        .add("test", T.StructType().add("accuracy", "double").add("binary_chatter_f1", "double").add("intervention_f1", "double"))
        .add(
            "lead_time",
            T.StructType().add("test", number).add("threshold_selection", T.StructType().add("test_at_selected_threshold", number)),
        )
        .add("event_warning", T.StructType().add("test", number))
    )
    return tables.read_runs(spark, asked, f"{base}/dir=*/*.json", schema)


@query(
    "a29_benchmark_row",
    f"""WITH {TRACE_SQL} SELECT 'dir=' || training_algorithm || '-' || seed AS run, 'episode' AS split_type, 'horizon' AS target, round(avg(risk_now), 6) AS test_accuracy, round(avg(reward), 6) + 0.0 AS chatter_f1,
      NULL::DOUBLE AS intervention_f1, round(avg(raw_feed_override), 6) AS lead_time_f1, round(avg(risk_now), 6) AS selected_lead_time_f1, round(avg(reward), 6) + 0.0 AS event_warning_f1
    FROM tr GROUP BY training_algorithm, seed""",
)
def a29(spark: SparkSession, folder: str) -> DataFrame:
    return runs.benchmark_row(_run_files(spark, folder)[0])


@query(
    "s11_skipped_runs",
    """SELECT 'dir=' || n_name AS run, 'missing metrics.json' AS reason FROM nation""",
)
def s11(spark: SparkSession, folder: str) -> DataFrame:
    return _run_files(spark, folder)[1]


@query(
    "s12_window_dataset",
    f"""WITH {WIN_SQL} SELECT 'chatter-window-v5' AS schema_version, count(*) AS total_windows, (SELECT string_agg(label || ':' || n, ';' ORDER BY label) FROM (SELECT label, count(*) AS n FROM win GROUP BY label)) AS label_counts FROM win""",
)
def s12(spark: SparkSession, folder: str) -> DataFrame:
    path = folder_for(spark, "dataset")
    tables.write_window_dataset(windows(spark, folder).drop("value"), path, 0.1, 0.05)
    stored = tables.read_window_dataset(spark, path)
    facts = tables.manifest(stored, 0.1, 0.05)
    pairs = F.transform(F.map_entries("label_counts"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))
    return facts.select("schema_version", "total_windows", F.array_join(pairs, ";").alias("label_counts"))


@query(
    "s12_waveforms",
    """WITH p AS (SELECT CASE WHEN label < 6 THEN 'stable' ELSE 'slight' END AS label, CASE WHEN vec_id % 7 = 0 THEN 40 ELSE 16 END AS size, embedding::DOUBLE[] AS x FROM embeddings WHERE label >= 2 AND vec_id % 11 <> 3),
    w AS (SELECT label, size, x, unnest(range(0, 60 - size + 1, size // 2)) AS s FROM p)
    SELECT label, count(*) AS windows, CAST(sum(size) AS BIGINT) AS samples, CAST(2 * sum(size) AS BIGINT) AS numbers, round(sum(list_sum(x[s + 1 : s + size])), 4) + 0.0 AS x_sum, round(sum(list_sum(x[s + 1 : s + size]) / 2), 4) + 0.0 AS y_sum FROM w GROUP BY label""",
)
def s12_waveforms(spark: SparkSession, folder: str) -> DataFrame:
    """Package files to a stored dataset with waveforms, read back."""
    plan = WindowPlan(0.016, 0.008, 0.02, 1.0, waveforms=True)
    path = folder_for(spark, "dataset")
    tables.write_window_dataset(ingest_packages(spark, _package_files(spark, folder, False), plan, default_rate=2500.0), path, 0.016, 0.008)
    stored = tables.read_window_dataset(spark, path)
    total = lambda axis: F.round(F.sum(F.aggregate("sensor_window", F.lit(0.0), lambda a, s: a + s[axis])), 4)
    return stored.groupBy("label").agg(
        F.count(F.lit(1)).alias("windows"), F.sum(F.size("sensor_window").cast("long")).alias("samples"), F.sum(F.size(F.flatten("sensor_window")).cast("long")).alias("numbers"),
        total(0).alias("x_sum"), total(1).alias("y_sum"),
    )


@query(
    "s13_prediction_sink",
    f"WITH {WIN_SQL}, {PRED_SQL.replace('FROM hz', 'FROM win')} SELECT label, predicted_label, count(*) AS windows FROM pred GROUP BY 1, 2",
)
def s13(spark: SparkSession, folder: str) -> DataFrame:
    path = folder_for(spark, "predictions")
    tables.write_table(with_probabilities(windows(spark, folder)).select("window_id", "label", "predicted_label", "probability"), path, "csv")
    stored = spark.read.option("header", True).csv(path)
    return metrics.label_counts(stored, ("label", "predicted_label"))


@query(
    "s2_ingest_packages",
    """WITH p AS (SELECT vec_id, label FROM embeddings WHERE label >= 2 AND vec_id % 11 <> 3),
    w AS (SELECT CASE WHEN label < 6 THEN 'stable' ELSE 'slight' END AS label, CASE WHEN vec_id % 7 = 0 THEN (60 - 40) // 20 + 1 ELSE (60 - 16) // 8 + 1 END AS n FROM p)
    SELECT label, CAST(sum(n) AS BIGINT) AS windows, count(*) AS episodes FROM w GROUP BY label""",
)
def s2_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """Package files to the full window table."""
    plan = WindowPlan(0.016, 0.008, 0.02, 1.0)
    table = ingest_packages(spark, _package_files(spark, folder, False), plan, default_rate=2500.0)
    return table.groupBy("label").agg(F.count(F.lit(1)).alias("windows"), F.count_distinct("episode").alias("episodes"))


@query(
    "s4_ingest_triaxial",
    """WITH e AS (SELECT event_id, CASE event_type WHEN 'error' THEN 'severe' ELSE 'stable' END AS label, event_id * 3 // (SELECT max(event_id) + 1 FROM events) AS third, sqrt(5 * value * value + 2.25e0) AS m FROM events),
    n AS (SELECT *, row_number() OVER (PARTITION BY label, third ORDER BY event_id) - 1 AS i FROM e),
    w AS (SELECT label, third, m, unnest(range(CAST(greatest(0, ceil((i - 7) / 4.0)) AS BIGINT), i // 4 + 1)) AS w FROM n),
    g AS (SELECT label, third, w, stddev_pop(m) AS rms FROM w GROUP BY ALL HAVING count(*) = 8)
    SELECT label, label AS horizon_label, count(*) AS windows, round(avg(rms), 6) + 0.0 AS rms FROM g GROUP BY label""",
)
def s4_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """Triaxial recordings to the full window table."""
    samples = tables.read_triaxial(spark, _recordings(spark, folder), 10.0)
    files = timebase.dense_number(samples.select("recording").distinct(), "recording", "episode")
    rows = samples.join(files, "recording").withColumn("label", F.when(F.col("quality") == "good", "stable").otherwise("severe"))
    table = ingest_samples(rows, WindowPlan(0.8, 0.4, 1.6, 60.0), 10.0, 1.0)
    return table.groupBy("label", "horizon_label").agg(F.count(F.lit(1)).alias("windows"), F.avg("rms").alias("rms"))




_S7_SQL = f"""WITH {WIN_SQL}, o AS (SELECT *, row_number() OVER (ORDER BY start_time_s, window_id) - 1 AS i FROM win),
c AS (SELECT count(*) AS n, min(start_time_s) AS t0 FROM o),
w AS (SELECT unnest(range(CAST(greatest(0, ceil((i - 15) / 8.0)) AS BIGINT), i // 8 + 1)) AS w, start_time_s - t0 AS t FROM o CROSS JOIN c),
g AS (SELECT w, min(t) AS a, max(t) AS b, count(*) AS n FROM w GROUP BY w HAVING count(*) = 16),
iv AS (SELECT start_time_s - t0 AS a, start_time_s - t0 + 400e0 AS b, label FROM o CROSS JOIN c WHERE label IN ('slight', 'severe') AND k > 60),
h AS (SELECT g.w, max(CASE iv.label WHEN 'slight' THEN 2 ELSE 3 END) AS sv FROM g JOIN iv ON 0.5e0 * (g.a + g.b) BETWEEN iv.a AND iv.b GROUP BY g.w)
SELECT CASE sv WHEN 2 THEN 'slight' WHEN 3 THEN 'severe' ELSE 'stable' END AS label, count(*) AS windows, round(sum(a), 3) AS start_sum FROM g LEFT JOIN h USING (w) GROUP BY 1"""


@query("s7_machine_run", _S7_SQL)
def s7(spark: SparkSession, folder: str) -> DataFrame:
    """The whole event table as one machine run: aligned context, slices, margins, interval labels, look-ahead."""
    rows = windows(spark, folder)
    span = LAYOUT.span / 30
    sensors = with_position(
        rows, [], F.floor(F.col("start_time_s") / span).cast("long"), ["start_time_s", "window_id"], "_p"
    ).select(
        F.lit("run").alias("run"), (F.col("_p") - 1).alias("sample_idx"), F.col("start_time_s").alias("time_s"), F.array("rms", "value").alias("ch")
    )
    context = rows.where("label = 'stable'").select(
        F.lit("run").alias("run"), F.col("window_id").alias("row"), F.col("start_time_s").alias("time_s"), "spindle_rpm", "feed_per_tooth_m"
    )
    first = rows.agg(F.min("start_time_s")).scalar()
    marks = rows.where("label IN ('slight', 'severe') AND k > 60").select(
        (F.col("start_time_s") - first).alias("start_time_s"), (F.col("start_time_s") - first + 400.0).alias("end_time_s"), "label"
    )
    aligned = staged(align_run(sensors, context, span), "aligned")
    clock = aligned.agg(F.max("time_s") - F.min("time_s"), F.count(F.lit(1))).first()
    step = clock[0] / (clock[1] - 1)
    plan = WindowPlan(16.2 * step, 8.1 * step, 20.0 * step, span)
    defaults = [F.lit(v).alias(k) for group in tables.METADATA_DEFAULTS.values() for k, v in group.items()]
    one = spark.range(1).select(F.lit("run").alias("run"), F.lit("run").alias("run_id"), *defaults)
    table = machine_windows(aligned, marks.withColumn("run", F.lit("run")), one, plan, "stable")
    return table.groupBy("label").agg(F.count(F.lit(1)).alias("windows"), F.round(F.sum("start_time_s"), 3).alias("start_sum"))


def _write_run_folders(spark: SparkSession, folder: str) -> str:
    """A run folder for every 2,000 events or so: 10 samples a second, tools and depths that differ between runs."""
    base = folder_for(spark, "run-folders")
    rows = windows(spark, folder).select("window_id", "label", "k", "rms", "value")
    count, last = rows.agg(F.count(F.lit(1)), F.max("window_id")).first()
    runs = max(1, count // 2000)
    dealt = rows.withColumn("run", F.floor(F.col("window_id") * F.lit(runs) / F.lit((last or 0) + 1)))

    def write(key, table):
        import json

        import pyarrow as pa
        from pyarrow import fs

        run, rows = key[0].as_py(), table.sort_by("window_id").to_pylist()
        system, root = fs.FileSystem.from_uri(base)
        home = f"{root}/run{run:06d}"
        system.create_dir(home, recursive=True)
        clock = [5.0 + i / 10 for i in range(len(rows))]

        def put(name, lines):
            with system.open_output_stream(f"{home}/{name}") as out:
                out.write("\n".join(lines).encode())

        put("sensors.csv", ["time_s,accel_x,accel_y,accel_z", *(f"{t!r},{r['rms']!r},{r['value']!r},{r['k']!r}" for t, r in zip(clock, rows))])
        marks = range(0, len(rows) + 10, 10)
        put("cnc_context.csv", ["time_s,spindle_rpm,feed_mm_min", *(f"{5.0 + i / 10!r},{6000 + 300 * (run % 7)},600" for i in marks)])
        marked = [(5.0 + i / 10, r["label"]) for i, r in enumerate(rows) if r["label"] in ("slight", "severe") and r["k"] > 90]
        put("labels.csv", ["start_time_s,end_time_s,label", *(f"{t - 0.02!r},{t + 1.01!r},{label}" for t, label in marked)])
        if run % 5 != 4:  # the others take the defaults
            facts = {"run_id": f"part{run // 2}", "tool": {"flute_count": 2 + run % 3}, "process": {"axial_depth_m": 0.0004 + 0.0001 * (run % 3)}}
            put("metadata.json", [json.dumps(facts)])
        return pa.table({"run": [run], "samples": [len(rows)]})

    dealt.groupBy("run").applyInArrow(write, "run long, samples long").agg(F.sum("samples")).collect()
    return base


@query(
    "s7_run_folders",
    f"""WITH {WIN_SQL}, m AS (SELECT greatest(1, count(*) // 2000) AS runs, max(window_id) + 1 AS ids FROM win),
    n AS (SELECT label, k, CAST(floor(window_id * runs / ids) AS BIGINT) AS run, row_number() OVER (PARTITION BY CAST(floor(window_id * runs / ids) AS BIGINT) ORDER BY window_id) - 1 AS i FROM win CROSS JOIN m),
    w AS (SELECT run, unnest(range(CAST(greatest(0, ceil((i - 15) / 8.0)) AS BIGINT), i // 8 + 1)) AS w FROM n),
    g AS (SELECT run, w, 0.8e0 * w + 0.75e0 AS centre FROM w GROUP BY ALL HAVING count(*) = 16),
    iv AS (SELECT run, i / 10e0 - 0.02e0 AS a, i / 10e0 + 1.01e0 AS b, CASE label WHEN 'slight' THEN 2 ELSE 3 END AS sv FROM n WHERE label IN ('slight', 'severe') AND k > 90),
    h AS (SELECT g.run, g.w, max(sv) AS sv FROM g JOIN iv ON g.run = iv.run AND centre BETWEEN a AND b GROUP BY ALL),
    f AS (SELECT g.run, g.w, CASE sv WHEN 2 THEN 'slight' WHEN 3 THEN 'severe' ELSE 'stable' END AS label, g.run % 5 = 4 AS bare, 6000e0 + 300 * (g.run % 7) AS rpm FROM g LEFT JOIN h ON g.run = h.run AND g.w = h.w),
    t AS (SELECT *, CASE WHEN bare THEN 'run' || lpad(CAST(run AS VARCHAR), 6, '0') ELSE 'part' || CAST(run // 2 AS VARCHAR) END AS scenario, CASE WHEN bare THEN 4 ELSE 2 + run % 3 END AS flutes, CASE WHEN bare THEN 0.0006e0 ELSE 0.0004e0 + 0.0001e0 * (run % 3) END AS depth FROM f)
    SELECT scenario, label, count(*) AS windows, count(DISTINCT run) AS episodes, round(sum(0.8e0 * w), 3) AS start_sum, round(avg(rpm * flutes / 60e0), 4) AS tooth_hz, round(avg(600e3 / (rpm * flutes)), 4) AS feed_um, round(avg(depth * 1e6), 3) AS depth_um
    FROM t GROUP BY scenario, label""",
)
def s7_run_folders(spark: SparkSession, folder: str) -> DataFrame:
    """Run folders written from the events, read and ingested together: a tool, a rate and labels for each run."""
    table = ingest_machine_run(spark, _write_run_folders(spark, folder), WindowPlan(1.6, 0.8, 3.2, 60.0), "stable")
    return table.groupBy("scenario", "label").agg(
        F.count(F.lit(1)).alias("windows"), F.count_distinct("episode").alias("episodes"), F.round(F.sum("start_time_s"), 3).alias("start_sum"),
        F.round(F.avg("tooth_frequency_hz"), 4).alias("tooth_hz"), F.round(F.avg(F.col("feed_per_tooth_m") * 1e6), 4).alias("feed_um"),
        F.round(F.avg(F.col("axial_depth_m") * 1e6), 3).alias("depth_um"),
    )


def _write_sounds(spark: SparkSession, folder: str) -> str:
    """Three 16-bit sound files and a list of cuts for each label and thousand vectors, written by the tasks that hold their samples."""
    base = folder_for(spark, "sounds")
    parts = read(spark, folder, "embeddings").select(
        F.concat_ws("x", F.concat(F.lit("Exp"), F.col("label").cast("string")), F.floor(F.col("vec_id") / 1000).cast("string")).alias("experiment"), "vec_id", F.col("embedding").cast("array<double>").alias("x")
    )

    def write(frames):
        import io
        import wave

        import numpy as np
        import pandas as pd
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(base)
        experiment, blocks = None, []

        def close():
            samples = np.concatenate(blocks)
            system.create_dir(f"{root}/{experiment}", recursive=True)
            for sensor in range(3):
                held = io.BytesIO()
                with wave.open(held, "wb") as out:
                    out.setnchannels(1)
                    out.setsampwidth(2)
                    out.setframerate(1000)
                    out.writeframes(np.floor(samples * 10_000 / 2**sensor).astype("<i2").tobytes())
                with system.open_output_stream(f"{root}/{experiment}/cut_sensor{sensor}.wav") as out:
                    out.write(held.getvalue())
            cuts = ["Start,End", *(f"{i * 64 / 1000 + 0.003!r},{i * 64 / 1000 + 0.303!r}" for i in range(0, len(blocks), 8))]
            with system.open_output_stream(f"{root}/{experiment}/cutting.csv") as out:
                out.write("\n".join(cuts).encode())
            return pd.DataFrame({"experiment": [experiment], "samples": [len(samples)]})

        for frame in frames:
            for name, x in zip(frame["experiment"], frame["x"]):
                if name != experiment and blocks:
                    yield close()
                    blocks = []
                experiment = name
                blocks.append(np.asarray(x))
        if blocks:
            yield close()

    dealt = parts.repartition("experiment").sortWithinPartitions("experiment", "vec_id")
    dealt.mapInPandas(write, "experiment string, samples long").agg(F.sum("samples")).collect()
    return base


@query(
    "s8_read_sound",
    """WITH v AS (SELECT 'Exp' || label || 'x' || vec_id // 1000 AS experiment, unnest(embedding)::DOUBLE * 10000e0 AS x FROM embeddings),
    q AS (SELECT experiment, floor(x) / 32768e0 AS a, floor(x / 2e0) / 32768e0 AS b, floor(x / 4e0) / 32768e0 AS c FROM v)
    SELECT experiment, count(*) AS samples, round(var_pop(a), 6) + 0.0 AS power0, round(var_pop(b), 6) + 0.0 AS power1, round(covar_pop(a, c), 6) + 0.0 AS joint02 FROM q GROUP BY 1""",
)
def s8(spark: SparkSession, folder: str) -> DataFrame:
    """Sound files of every experiment, read back as aligned channels; powers need the mean removed, the joint one the order."""
    rows = packages.read_sound(spark, _write_sounds(spark, folder))
    ch = F.col("ch")
    return rows.groupBy("experiment").agg(
        F.count(F.lit(1)).alias("samples"), F.avg(ch[0] * ch[0]).alias("power0"), F.avg(ch[1] * ch[1]).alias("power1"), F.avg(ch[0] * ch[2]).alias("joint02")
    )


@query(
    "s8_ingest_sound",
    """WITH v AS (SELECT 'Exp' || label || 'x' || vec_id // 1000 AS e, row_number() OVER (PARTITION BY label, vec_id // 1000 ORDER BY vec_id) - 1 AS i, embedding FROM embeddings),
    u AS (SELECT e, i * 64 + unnest(range(64)) AS n, unnest(embedding)::DOUBLE * 10000e0 AS x FROM v),
    q AS (SELECT e, n, floor(x) / 32768e0 AS a, floor(x / 2e0) / 32768e0 AS b, floor(x / 4e0) / 32768e0 AS c FROM u),
    m AS (SELECT e, avg(a) AS a, avg(b) AS b, avg(c) AS c, count(*) AS n FROM q GROUP BY e),
    s AS (SELECT q.e, q.n, sqrt((q.a - m.a) ** 2 + (q.b - m.b) ** 2 + (q.c - m.c) ** 2) AS r FROM q JOIN m USING (e)),
    iv AS (SELECT e, unnest(range(1, CAST((n // 64 + 7) // 8 + 1 AS BIGINT))) AS p, (n // 64 + 7) // 8 AS cuts FROM m),
    f AS (SELECT e, p, (p - 1) * 512 + 3 AS lo, p < cuts AS known, greatest(p % 3, p % 2) AS vote, 3000e0 + 100 * (p % 5) AS rpm FROM iv WHERE cuts > 1),
    k AS (SELECT f.e, f.p, n - lo AS i, r FROM f JOIN s ON s.e = f.e AND n >= lo AND n < lo + 300),
    w AS (SELECT e, p, r, unnest(range(CAST(greatest(0, ceil((i - 99) / 50e0)) AS BIGINT), CAST(i // 50 + 1 AS BIGINT))) AS w FROM k),
    g AS (SELECT e, p, w, stddev_pop(r) AS rms FROM w GROUP BY ALL HAVING count(*) = 100)
    SELECT g.e AS scenario, CASE WHEN NOT known OR vote <= 0 THEN 'stable' WHEN vote < 2 THEN 'slight' ELSE 'severe' END AS label, count(*) AS windows, count(DISTINCT g.p) AS episodes, round(avg(rms), 6) + 0.0 AS rms,
      round(avg(CASE WHEN known THEN rpm * 2 ELSE 4e0 END / 60e0), 4) + 0.0 AS tooth_hz, round(avg(1e6 * CASE WHEN known THEN 30 * 0.0254e0 / (rpm * 2) ELSE 1e-9 END), 4) + 0.0 AS feed_um, round(sum(w * 0.05e0), 3) + 0.0 AS start_sum
    FROM g JOIN f USING (e, p) GROUP BY 1, 2""",
)
def s8_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """Sound files, their cuts and operator labels (none for an experiment's last cut) to the full window table."""
    names = F.concat_ws("x", F.concat(F.lit("Exp"), F.col("label").cast("string")), F.floor(F.col("vec_id") / 1000).cast("string"))
    cuts = read(spark, folder, "embeddings").groupBy(names.alias("experiment")).agg(F.floor((F.count(F.lit(1)) + 7) / 8).alias("cuts"))
    p = F.col("position")
    rows = cuts.where("cuts > 1").select("experiment", F.explode(F.sequence(F.lit(1).cast("long"), F.col("cuts") - 1)).alias("position")).select(
        "experiment", "position", p.cast("string").alias("No."), F.lit('3/8" 2-Flute end mill').alias("Tool"),
        (3000 + 100 * (p % 5)).cast("string").alias("Spindle speed [RPM]"), F.lit("30").alias("Feedrate [IPM]"),
        F.lit("0.1").alias("Depth of cut [inch]"), F.lit("n/a").alias("Width of cut [inch]"),
        (p % 3).cast("string").alias("Chatter (operator 1)"), (p % 2).cast("string").alias("Chatter (operator 2)"),
    )
    labels = staged(tables.operator_labels(rows), "operator-labels")
    return _by_label(ingest_sound(spark, _write_sounds(spark, folder), labels))


def _by_label(table: DataFrame) -> DataFrame:
    return table.groupBy("scenario", "label").agg(
        F.count(F.lit(1)).alias("windows"), F.count_distinct("episode").alias("episodes"), F.avg("rms").alias("rms"),
        F.round(F.avg("tooth_frequency_hz"), 4).alias("tooth_hz"), F.round(F.avg(F.col("feed_per_tooth_m") * 1e6), 4).alias("feed_um"),
        F.round(F.sum("start_time_s"), 3).alias("start_sum"),
    )


def _write_trials(spark: SparkSession, folder: str) -> str:
    """A controller file for every 500 events, one value in 50 unreadable."""
    base = folder_for(spark, "trials")
    rows = read(spark, folder, "events").select(F.floor(F.col("event_id") / 500).alias("trial"), "event_id", "value")

    def write(key, table):
        import pyarrow as pa
        from pyarrow import fs

        trial = key[0].as_py()
        system, root = fs.FileSystem.from_uri(base)
        system.create_dir(f"{root}/T{trial}", recursive=True)
        lines = ["CYCLE,LOAD|6,CURRENT|6"]
        for row in table.sort_by("event_id").to_pylist():
            load = "n/a" if row["event_id"] % 50 == 7 else repr(row["value"])
            lines.append(f"{row['event_id']},{load},{row['value'] / 2!r}")
        with system.open_output_stream(f"{root}/T{trial}/T{trial}_hfdata.csv") as out:
            out.write("\n".join(lines).encode())
        return pa.table({"trial": [trial], "rows": [table.num_rows]})

    rows.groupBy("trial").applyInArrow(write, "trial long, rows long").agg(F.sum("rows")).collect()
    return base


@query(
    "s5_ingest_controller",
    """WITH n AS (SELECT event_id // 500 AS t, row_number() OVER (PARTITION BY event_id // 500 ORDER BY event_id) - 1 AS i, sqrt(value * value + (value / 2e0) * (value / 2e0)) AS m FROM events WHERE event_id % 50 <> 7),
    w AS (SELECT t, m, unnest(range(CAST(greatest(0, ceil((i - 9) / 5.0)) AS BIGINT), i // 5 + 1)) AS w FROM n WHERE t % 4 <> 3),
    g AS (SELECT t, w, stddev_pop(m) AS rms FROM w GROUP BY ALL HAVING count(*) = 10)
    SELECT 'T' || t AS scenario, CASE t % 4 WHEN 2 THEN 'slight' ELSE 'stable' END AS label, count(*) AS windows, 1 AS episodes, round(avg(rms), 6) + 0.0 AS rms, round(avg((600e0 + t % 9 * 60) * (2 + t % 3) / 60e0), 4) + 0.0 AS tooth_hz,
      round(avg(CASE WHEN t % 5 = 0 THEN 1e-3 ELSE (t % 5) * 10e0 END), 4) + 0.0 AS feed_um, round(sum(w * 0.5e0), 3) + 0.0 AS start_sum FROM g GROUP BY t""",
)
def s5_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """Controller files with a trial sheet to the full window table; one comment in four is of another kind and is left out."""
    t = F.col("t")
    trials = read(spark, folder, "events").select(F.floor(F.col("event_id") / 500).alias("t")).distinct()
    cells = [
        F.concat(F.lit("T"), t.cast("string")), F.get(F.array(*[F.lit(c) for c in ("", "Roughing", "some chatter heard", "tool broke")]), (t % 4).cast("int")),
        (600 + t % 9 * 60).cast("string"), ((t % 5) / 100.0).cast("string"), (2 + t % 3).cast("string"),
    ]
    head = [F.lit(h) for h in ("Trial", "Comment", "Spindle Speed [U/min]", "fz [mm]", "Number of teeth")]
    # Every trial brings its own section title and header, so titles and headers repeat through the sheet.
    lines = F.array(F.array(F.lit(tables.SHEET_SECTIONS[0])), F.array(*head), F.array(*cells))
    sheet = trials.select(t, F.posexplode(lines).alias("i", "cells")).select((t * 3 + F.col("i")).alias("row"), "cells")
    known = tables.read_trial_sheet(sheet)
    return _by_label(ingest_controller(spark, _write_trials(spark, folder), known, ("LOAD|6", "CURRENT|6"), 10.0))
