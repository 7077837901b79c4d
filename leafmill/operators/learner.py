"""Deciding which images are worth recognising, and learning from the outcomes."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.functions.signing import sign, verify
from leafmill.functions.strings import percent, reason_probability
from leafmill.operators.features import FEATURES, vector
from leafmill.operators.order import by_ranges, with_blocks, with_ordinal, with_range_sum
from leafmill.operators.status import one_row

# Samples before predictions, between trainings and until exploration halves.
LEAST_SAMPLES, RETRAIN_EVERY, HALF_LIFE = 30, 100, 200
# Bounds of the exploration rate, skip bound and skip validation rate.
MOST_EXPLORATION, LEAST_EXPLORATION, SKIP_BELOW, VALIDATE = 0.50, 0.05, 0.15, 0.10
#: Predictions looked back on, and how many it takes.
RECENT, LEAST_RECENT = 100, 20
WORTH = "heuristic: worth trying"
REGION_KEY = ("size_bin", "brightness_bin", "region")


def region_bins() -> dict[str, Column]:
    """Size and brightness bins of an image."""
    size = F.when(F.col("area") < 10000, "small").when(F.col("area") < 50000, "medium").otherwise("large")
    light = F.when(F.col("brightness_mean") < 100, "dark").when(F.col("brightness_mean") < 200, "medium").otherwise("bright")
    return {"size_bin": size, "brightness_bin": light}


def region_counts(outcomes: DataFrame) -> DataFrame:
    """Recognised samples of each size, brightness and region bin; at most 9 rows per region."""
    return outcomes.where("ocr_performed").withColumns(region_bins()).groupBy(*REGION_KEY).agg(F.count("*").alias("samples"))


def heuristic_reason() -> Column:
    """Why an image is skipped, or that it is worth trying; the first rule that holds counts."""
    edge = F.col("region").isin("header", "footer")
    return (
        F.when(F.col("area") < 400, "heuristic: tiny image")
        .when(edge & (F.col("area") < 10000), "heuristic: small header/footer")
        .when(edge & (F.col("aspect_ratio") > 2), "heuristic: wide decoration")
        .when((F.col("region") == "body") & (F.col("area") < 2500), "heuristic: small body image")
        .when((F.col("area") > 50000) & (F.col("brightness_mean") < 150), "heuristic: dark large image")
        .when(F.col("is_mostly_white") & ~F.col("has_contrast"), "heuristic: blank/white")
        .when((F.col("region") == "margin") & ((F.col("aspect_ratio") > 5) | (F.col("aspect_ratio") < 0.2)), "heuristic: margin decoration")
        .otherwise(WORTH)
    )


def exploration_rate(samples: Column) -> Column:
    decayed = MOST_EXPLORATION * F.pow(F.lit(0.5), samples / HALF_LIFE)
    return F.when(samples < LEAST_SAMPLES, MOST_EXPLORATION).otherwise(F.greatest(F.lit(LEAST_EXPLORATION), decayed))


def adaptive_exploration(samples: Column, error: Column, recent: Column) -> Column:
    """Exploration rate raised by the share of wrong recent predictions, once there are enough of them."""
    rate = exploration_rate(samples)
    raised = F.when(error > 0.5, F.greatest(F.lit(0.35), rate + 0.30)).when(error > 0.3, rate + error * 0.5).otherwise(rate + error * 0.3)
    bounded = F.greatest(F.lit(LEAST_EXPLORATION), F.least(F.lit(MOST_EXPLORATION), raised))
    return F.when(F.coalesce(recent, F.lit(0)) < LEAST_RECENT, rate).otherwise(bounded)


def skip_validation(total: Column, useful: Column) -> Column:
    """Share of skips that are recognised all the same, by how often they turned out wrong."""
    error = useful / total
    tuned = F.greatest(F.lit(0.05), F.least(F.lit(0.5), VALIDATE * F.sqrt(error / 0.10)))
    return F.when(total < 20, VALIDATE).when(error > 0.3, F.least(F.lit(0.5), 0.3 + (error - 0.3))).otherwise(tuned)


def ucb_bonus(total: Column, region_samples: Column) -> Column:
    """Bonus for rarely seen kinds of images."""
    n = F.coalesce(region_samples, F.lit(0))
    bound = F.sqrt(2.0 * F.log(total.cast("double")) / n)
    return F.when(n < 5, 0.30).when(total < LEAST_SAMPLES, 0.15).otherwise(F.least(F.lit(0.30), bound))


def explores(probability: Column, rate: Column, bonus: Column, draw: Column) -> Column:
    """Whether an uncertain prediction is explored."""
    uncertainty = 1 - F.abs(probability - 0.5) * 2
    return draw < uncertainty * rate * 4 + bonus


def decide(
    images: DataFrame, counts: DataFrame, samples: Column, probability: Column, error: Column, recent: Column,
    validated: Column, validated_useful: Column, draws: tuple[Column, Column], enabled: bool = True,
) -> DataFrame:
    """Adds ``do_ocr``, ``reason`` and ``is_exploration``.

    Samples, counts and probabilities are frozen for a batch of images. Without enough samples or without a
    probability the heuristic rules decide, apart from a share of random exploration. ``draws`` are uniform
    numbers, one for exploration and one for skip validation.
    """
    if not enabled:
        return images.withColumns({"do_ocr": F.lit(True), "reason": F.lit("learning disabled"), "is_exploration": F.lit(False)})
    df = images.withColumns(region_bins()).join(F.broadcast(counts), list(REGION_KEY), "left")
    heuristic = heuristic_reason()
    base = exploration_rate(samples)
    early = (samples < LEAST_SAMPLES) | probability.isNull()
    random_one = early & (draws[0] < base)
    rate = adaptive_exploration(samples, error, recent)
    uncertain = ~early & explores(probability, rate, ucb_bonus(samples, F.col("samples")), draws[0])
    unlikely = ~early & (probability < SKIP_BELOW)
    validation = skip_validation(validated, validated_useful)
    checked = unlikely & (draws[1] < validation)

    def shown(p: Column) -> Column:
        return F.concat(percent(p).cast("string"), F.lit("%"))

    reason = (
        F.when(random_one, F.concat(F.lit("exploration ("), shown(base), F.lit(")")))
        .when(early, heuristic)
        .when(uncertain, F.concat(F.lit("uncertainty exploration (p="), shown(probability), F.lit(")")))
        .when(checked, F.concat(F.lit("skip-validation (p="), shown(probability), F.lit(", rate="), shown(validation), F.lit(")")))
        .otherwise(F.concat(F.lit("classifier: "), shown(probability), F.lit(" useful")))
    )
    do = F.when(random_one, True).when(early, heuristic == WORTH).when(uncertain, True).otherwise(~unlikely | checked)
    return df.withColumns({"do_ocr": do, "reason": reason, "is_exploration": random_one | uncertain | checked}).drop(*REGION_KEY[:2], "samples")


def account(outcomes: DataFrame) -> DataFrame:
    """Session counters from rows ``(ocr_performed, is_useful, is_exploration, reason)`` in one pass."""
    o, u = F.col("ocr_performed"), F.coalesce("is_useful", F.lit(False))
    validation = F.col("reason").startswith("skip-validation")
    exploring = F.col("is_exploration") & ~validation
    return outcomes.agg(
        F.count_if(o & u).alias("ocr_useful"), F.count_if(o & ~u).alias("ocr_empty"),
        F.count_if(o & validation).alias("skip_validation_ocrs"), F.count_if(o & validation & u).alias("skip_validation_useful"),
        F.count_if(o & exploring & u).alias("exploration_useful"), F.count_if(o & exploring & ~u).alias("exploration_empty"),
    )


def running_samples(outcomes: DataFrame) -> DataFrame:
    """Adds how many recognised samples there were up to each row, in all and of its bin, and the model version.

    Rows are ``(recorded_at, id, ...)``, unique by both. They are summed within ranges of the order and the sums of the ranges before are added.
    """
    order = ("recorded_at", "id")
    done = F.col("ocr_performed").cast("int")
    ranged = by_ranges(outcomes.withColumns(region_bins()), *order)
    out = with_range_sum(with_range_sum(ranged, done, "total_samples", [], *order), done, "region_samples", list(REGION_KEY), *order)
    return out.withColumn("model_version", F.floor(F.col("total_samples") / RETRAIN_EVERY).cast("long")).drop("_range")


def recent_error(predictions: DataFrame) -> DataFrame:
    """Adds ``recent_error`` and ``recent_count`` over the last predictions up to each row.

    Rows are ``(recorded_at, id, pred_prob, is_useful)``; a prediction is wrong if it was below one half and the
    text useful, or the other way round. Fewer than the least number give no error.
    """
    ordered = with_ordinal(predictions, "recorded_at", "id")
    blocked = with_blocks(ordered, "ordinal", RECENT - 1)
    w = Window.partitionBy("_block").orderBy("ordinal").rowsBetween(-(RECENT - 1), 0)
    wrong = ((F.col("pred_prob") < 0.5) == F.col("is_useful")).cast("int")
    out = blocked.withColumn("recent_count", F.count(wrong).over(w)).withColumn("_e", F.sum(wrong).over(w))
    return out.where("_own").withColumn(
        "recent_error", F.when(F.col("recent_count") >= LEAST_RECENT, F.col("_e") / F.col("recent_count"))
    ).drop("_block", "_own", "_e")


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    """Records, recognised and useful ones, and the useful share."""
    o = F.col("ocr_performed")
    counted = outcomes.agg(
        F.count("*").alias("total_records"), F.count_if(o).alias("ocrd_records"), F.count_if(o & F.col("is_useful")).alias("useful_records")
    )
    return counted.withColumn("useful_rate", F.col("useful_records") / F.greatest("ocrd_records", F.lit(1)))


def file_stats(files: DataFrame) -> DataFrame:
    """Files, pages, images and quality changes of processed files in one pass."""
    from leafmill.functions.text_quality import IMPROVED, REGRESSED

    scored = F.col("quality_score").isNotNull()
    d = F.when(scored, F.col("quality_delta"))

    def zero(c: Column) -> Column:
        return F.coalesce(c, F.lit(0))

    return files.agg(
        F.count("*").alias("processed_files"), zero(F.sum("page_count")).alias("total_pages"), zero(F.sum("image_count")).alias("total_images"),
        F.count_if(scored).alias("files_with_quality"), F.count_if(scored & F.col("previous_quality_score").isNotNull()).alias("files_with_comparison"),
        zero(F.avg("quality_score")).alias("avg_quality_score"),
        F.count_if(d > IMPROVED).alias("quality_improved"), F.count_if(d.between(REGRESSED, IMPROVED)).alias("quality_unchanged"),
        F.count_if(d < REGRESSED).alias("quality_regressed"),
        zero(F.avg(F.when(d > IMPROVED, d))).alias("avg_improvement"), zero(F.avg(F.when(d < REGRESSED, d))).alias("avg_regression"),
    )


def learning_report(outcomes: DataFrame, files: DataFrame, session: DataFrame) -> DataFrame:
    """One row on both tables and the session counters; shares without a base are null."""
    s = session.withColumns(
        {
            "skip_accuracy": 1 - F.try_divide(F.col("exploration_useful"), F.col("exploration_useful") + F.col("exploration_empty")),
            "skip_validation_error_rate": F.try_divide(F.col("skip_validation_useful"), F.col("skip_validation_ocrs")),
        }
    )
    counted = outcome_counts(outcomes).withColumn("exploration_rate", exploration_rate(F.col("ocrd_records")))
    return one_row(counted, file_stats(files), s)


def training_set(outcomes: DataFrame) -> DataFrame:
    """``(features, label, weight)`` of recognised samples with all features; weights balance the classes."""
    rows = outcomes.where(F.col("ocr_performed") & F.col("is_useful").isNotNull()).select(vector().alias("v"), F.col("is_useful").cast("double").alias("label")).where("v IS NOT NULL")
    sizes = rows.groupBy("label").agg(F.count("*").alias("c"))
    total = F.sum("c").over(Window.partitionBy(F.lit(1)))  # over two rows
    weights = sizes.select("label", (total / (2.0 * F.col("c"))).alias("weight"))
    return rows.join(F.broadcast(weights), "label").select("v", "label", "weight")


def train(outcomes: DataFrame, path: str | None = None):
    """Balanced decision tree over the samples, saved at ``path``; None with too few samples or one class."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.functions import array_to_vector

    data = training_set(outcomes)
    have = data.agg(F.count("*").alias("n"), F.count_distinct("label").alias("k")).first()
    if have.n < LEAST_SAMPLES or have.k < 2:
        return None
    tree = DecisionTreeClassifier(featuresCol="features", labelCol="label", weightCol="weight", maxDepth=10, seed=42)
    model = tree.fit(data.withColumn("features", array_to_vector("v")))
    if path:
        model.write().overwrite().save(path)
    return model


def _files(spark, root: str) -> list:
    """Files below a folder in order of path, and their file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found, walk = [], fs.listFiles(path, True)
    while walk.hasNext():
        found.append(walk.next().getPath())
    return [fs, sorted(found, key=lambda p: p.toString())]


def model_digest(spark, path: str) -> bytes:
    """SHA-256 over names and contents of a saved model's files; a model has a few small files."""
    digest, (fs, files) = hashlib.sha256(), _files(spark, path)
    for file in files:
        stream = fs.open(file)
        try:
            content = bytes(stream.readAllBytes())
        finally:
            stream.close()
        name = file.toString().split("/model/")[-1]
        digest.update(f"{name}:{len(content)}:".encode() + content)
    return digest.digest()


def save_signed(model, root: str, key: bytes, samples: int) -> None:
    """Saves a model below ``root/model`` and, beside it, the signed digest of its files with the samples it was trained on."""
    spark = SparkSession.active()
    model.write().overwrite().save(f"{root}/model")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/model.signed")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(path, True)
    out.write(bytearray(sign(model_digest(spark, f"{root}/model") + samples.to_bytes(8, "big"), key)))
    out.close()


def load_signed(root: str, key: bytes):
    """``(model, samples)`` if the signature fits the files; ``(None, 0)`` for a missing, changed or foreign model."""
    from pyspark.ml.classification import DecisionTreeClassificationModel

    spark = SparkSession.active()
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/model.signed")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None, 0
    stream = fs.open(path)
    try:
        blob = verify(bytes(stream.readAllBytes()), key)
    finally:
        stream.close()
    try:
        if blob is None or len(blob) != 40 or blob[:32] != model_digest(spark, f"{root}/model"):
            return None, 0
    except Exception:  # files that cannot be read are not trusted either
        return None, 0
    return DecisionTreeClassificationModel.load(f"{root}/model"), int.from_bytes(blob[32:], "big")


def load_or_train(root: str, outcomes: DataFrame | None, key: bytes):
    """``(model, samples)``: the stored model, a new one if it cannot be trusted or enough samples came since, or None."""
    model, trained = load_signed(root, key)
    samples = outcomes.where("ocr_performed").count() if outcomes is not None else 0
    if samples >= LEAST_SAMPLES and (model is None or samples - trained >= RETRAIN_EVERY):
        fresh = train(outcomes)
        if fresh is not None:
            save_signed(fresh, root, key, samples)
            return fresh, samples
    return model, trained


def adaptive_inputs(outcomes: DataFrame) -> DataFrame:
    """One row ``(recent_error, recent_count, validated, validated_useful)`` from outcomes with ``reason``.

    Recent ones are the last recognised images whose reason states a probability, by time and id.
    """
    p = reason_probability(F.col("reason"))
    stated = outcomes.where(F.col("ocr_performed") & F.col("is_useful").isNotNull() & p.isNotNull())
    last = stated.orderBy(F.desc("recorded_at"), F.desc("id")).limit(RECENT)
    wrong = ((p < 0.5) == F.col("is_useful")).cast("int")
    recent = last.agg(F.coalesce(F.avg(wrong), F.lit(0.0)).alias("recent_error"), F.count("*").alias("recent_count"))
    checks = outcomes.where(F.col("ocr_performed") & F.col("reason").startswith("skip-validation"))
    return one_row(recent, checks.agg(F.count("*").alias("validated"), F.count_if(F.coalesce("is_useful", F.lit(False))).alias("validated_useful")))


def predict(model, images: DataFrame) -> DataFrame:
    """Adds ``probability`` of being useful, null for images without all features."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = images.withColumn("_v", vector())
    features = array_to_vector(F.coalesce("_v", F.array_repeat(F.lit(0.0), 14)))
    scored = model.transform(rows.withColumn("features", features))
    return scored.withColumn("_p", F.when(F.col("_v").isNotNull(), vector_to_array("probability")[1])).drop(
        "_v", "features", "rawPrediction", "probability", "prediction"
    ).withColumnRenamed("_p", "probability")


FEATURE_COLUMNS = FEATURES
