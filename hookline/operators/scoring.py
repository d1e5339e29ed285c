"""Scoring on model probabilities (M4–M7) and evaluation.

Probabilities are plain double columns ``<model>_<class>``; everything is a
column expression or a grouped aggregate, so scoring is one projection and
evaluation a handful of small aggregations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hookline import constants as K

MODELS = ["xgb", "lgb", "rf"]


def first_argmax(values: list[Column]) -> Column:
    """0-based index of the first maximum."""
    m = F.greatest(*values)
    out = F.lit(len(values) - 1)
    for i in reversed(range(len(values))):
        out = F.when(values[i] == m, F.lit(i)).otherwise(out)
    return out


def soft_vote(df: DataFrame, digits: int = 4) -> DataFrame:
    """M4: .3 xgb + .2 rf + .5 lgb per class; first maximum wins; rounded."""
    w = K.VOTE_WEIGHTS
    probs = [
        F.lit(w["xgb"]) * F.col(f"xgb_{c}") + F.lit(w["rf"]) * F.col(f"rf_{c}") + F.lit(w["lgb"]) * F.col(f"lgb_{c}")
        for c in K.CLASSES
    ]
    x = df.withColumns({f"_v_{c}": p for c, p in zip(K.CLASSES, probs)})
    vals = [F.col(f"_v_{c}") for c in K.CLASSES]
    idx = first_argmax(vals)
    classes = F.array(*[F.lit(c) for c in K.CLASSES])
    return x.withColumns(
        {
            "vote_pred": F.element_at(classes, idx + 1),
            "vote_confidence": F.round(F.greatest(*vals), digits),
            **{f"vote_{c}": F.round(F.col(f"_v_{c}"), digits) for c in K.CLASSES},
        }
    ).drop(*[f"_v_{c}" for c in K.CLASSES])


def verdict_response(pred: Column, confidence: Column, probs: dict[str, Column], reasons: Column) -> Column:
    """M5: struct(threat_detected, category, confidence, probabilities map, reasons)."""
    return F.struct(
        (pred != "benign").alias("threat_detected"),
        pred.alias("category"),
        confidence.alias("confidence"),
        F.create_map(*[x for c in K.CLASSES for x in (F.lit(c), probs[c])]).alias("probabilities"),
        reasons.alias("reasons"),
    )


def ensemble_verdicts(spark: SparkSession, df: DataFrame, url_col: str = "url", with_ratios: bool = True) -> DataFrame:
    """M3–M5 (and O7 per micro-batch): three models' probabilities ``<model>_<class>``, each
    through the override cascade, then the vote on the overridden probabilities and the
    verdict record with the three models' details."""
    from hookline.operators.lookalike import cascade, with_profile

    x = with_profile(spark, df, url_col, with_ratios)
    classes = F.array(*[F.lit(c) for c in K.CLASSES])
    for m in MODELS:
        probs = {c: F.col(f"{m}_{c}") for c in K.CLASSES}
        pred = F.element_at(classes, first_argmax(list(probs.values())) + 1)
        x = cascade(x, pred, probs, {"pred": f"{m}_pred", "reason": f"{m}_reason", **{c: f"_f_{m}_{c}" for c in K.CLASSES}}, with_ratios)
    x = x.drop(*[f"{m}_{c}" for m in MODELS for c in K.CLASSES])
    x = soft_vote(x.withColumnsRenamed({f"_f_{m}_{c}": f"{m}_{c}" for m in MODELS for c in K.CLASSES}))
    reasons = F.array_distinct(F.filter(F.array(*[F.col(f"{m}_reason") for m in MODELS]), lambda r: r != "model_decision"))
    details = F.struct(*[
        F.struct(F.col(f"{m}_pred").alias("prediction"), F.greatest(*[F.col(f"{m}_{c}") for c in K.CLASSES]).alias("confidence"),
                 F.col(f"{m}_reason").alias("reason"), (F.col(f"{m}_reason") != "model_decision").alias("heuristic_applied")).alias(m)
        for m in MODELS
    ])
    verdict = verdict_response(F.col("vote_pred"), F.col("vote_confidence"), {c: F.col(f"vote_{c}") for c in K.CLASSES}, reasons)
    own = [c for c in df.columns if c not in {f"{m}_{k}" for m in MODELS for k in K.CLASSES}]
    return x.select(*own, verdict.alias("verdict"), details.alias("model_details"))


def base_prob_vector(df: DataFrame) -> DataFrame:
    """M6: 12 columns in model order xgb, lgb, rf; a missing class is 0, a
    missing model (all four null) is 0.25 each."""
    cols = {}
    for m in MODELS:
        all_null = F.lit(True)
        for c in K.CLASSES:
            all_null = all_null & F.col(f"{m}_{c}").isNull()
        for c in K.CLASSES:
            cols[f"{m}_{c}"] = F.when(all_null, F.lit(0.25)).otherwise(F.coalesce(F.col(f"{m}_{c}"), F.lit(0.0)))
    return df.withColumns(cols)


META_NAMES = (
    [f"{m}_{c}" for m in MODELS for c in K.CLASSES]
    + [f"mean_{c}" for c in K.CLASSES]
    + [f"std_{c}" for c in K.CLASSES]
    + ["max_prob", "min_prob", "agreement", "entropy", "margin"]
)


def meta_features(df: DataFrame) -> DataFrame:
    """M7: the 12 probabilities plus 13 derived columns (means, population
    sds, max, min, top-class agreement, entropy of the means, top-2 margin)."""
    x = df
    means = {}
    for c in K.CLASSES:
        s = F.col(f"xgb_{c}") + F.col(f"lgb_{c}") + F.col(f"rf_{c}")
        means[f"mean_{c}"] = s / 3.0
    x = x.withColumns(means)
    stds = {}
    for c in K.CLASSES:
        m = F.col(f"mean_{c}")
        sq = [(F.col(f"{mm}_{c}") - m) * (F.col(f"{mm}_{c}") - m) for mm in MODELS]
        stds[f"std_{c}"] = F.sqrt((sq[0] + sq[1] + sq[2]) / 3.0)
    allp = [F.col(f"{m}_{c}") for m in MODELS for c in K.CLASSES]
    tops = [first_argmax([F.col(f"{m}_{c}") for c in K.CLASSES]) for m in MODELS]
    counts = [sum([F.when(t == i, F.lit(1)).otherwise(F.lit(0)) for t in tops]) for i in range(len(K.CLASSES))]
    agreement = F.greatest(*counts) / 3.0
    mcols = [F.col(f"mean_{c}") for c in K.CLASSES]
    ent = -(
        mcols[0] * F.ln(mcols[0] + 1e-10)
        + mcols[1] * F.ln(mcols[1] + 1e-10)
        + mcols[2] * F.ln(mcols[2] + 1e-10)
        + mcols[3] * F.ln(mcols[3] + 1e-10)
    )
    srt = F.array_sort(F.array(*mcols))
    margin = F.element_at(srt, 4) - F.element_at(srt, 3)
    return x.withColumns(stds).withColumns(
        {
            "max_prob": F.greatest(*allp),
            "min_prob": F.least(*allp),
            "agreement": agreement,
            "entropy": ent,
            "margin": margin,
        }
    )


# ------------------------------------------------------------ evaluation

def confidence_band(p: Column) -> Column:
    return F.when(p > K.HIGH_BAND, F.lit("HIGH")).when(p > K.MEDIUM_BAND, F.lit("MEDIUM")).otherwise(F.lit("LOW"))


def class_frame(spark) -> DataFrame:
    return spark.createDataFrame([(i, c) for i, c in enumerate(K.CLASSES)], "class_ord int, class string")


def classification_report(preds: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """Per class precision, recall, f1, support (zero division → 0),
    then accuracy, macro avg and weighted avg rows."""
    spark = preds.sparkSession
    t = preds.groupBy(F.col(label).alias("class")).agg(F.count(F.lit(1)).alias("support"))
    p = preds.groupBy(F.col(pred).alias("class")).agg(F.count(F.lit(1)).alias("n_pred"))
    tp = preds.where(F.col(label) == F.col(pred)).groupBy(F.col(label).alias("class")).agg(F.count(F.lit(1)).alias("tp"))
    cls = class_frame(spark)
    per = (
        cls.join(t, "class", "left").join(p, "class", "left").join(tp, "class", "left")
        .fillna(0, ["support", "n_pred", "tp"])
    )
    prec = F.when(F.col("n_pred") > 0, F.col("tp") / F.col("n_pred")).otherwise(F.lit(0.0))
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    per = per.withColumns({"precision": prec, "recall": rec})
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0))
    per = per.withColumn("f1", f1)
    tot = per.agg(
        F.sum("support").alias("n"), F.sum("tp").alias("correct"),
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
        (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("wp"),
        (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("wr"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("wf"),
    )
    acc = F.col("correct") / F.col("n")
    summary = tot.select(
        F.explode(
            F.array(
                F.struct(F.lit(4).alias("class_ord"), F.lit("accuracy").alias("class"), acc.alias("precision"),
                         acc.alias("recall"), acc.alias("f1"), F.col("n").alias("support")),
                F.struct(F.lit(5).alias("class_ord"), F.lit("macro avg").alias("class"), F.col("mp").alias("precision"),
                         F.col("mr").alias("recall"), F.col("mf").alias("f1"), F.col("n").alias("support")),
                F.struct(F.lit(6).alias("class_ord"), F.lit("weighted avg").alias("class"), F.col("wp").alias("precision"),
                         F.col("wr").alias("recall"), F.col("wf").alias("f1"), F.col("n").alias("support")),
            )
        ).alias("r")
    ).select("r.*")
    rows = per.select("class_ord", "class", "precision", "recall", "f1", "support")
    return rows.unionByName(summary).withColumn("support", F.col("support").cast("long"))


def confusion_matrix(preds: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """True class × predicted class counts, every class shown."""
    spark = preds.sparkSession
    m = preds.groupBy(F.col(label).alias("true_class")).pivot(pred, K.CLASSES).count()
    cls = class_frame(spark).select(F.col("class").alias("true_class"), "class_ord")
    out = cls.join(m, "true_class", "left")
    return out.select("class_ord", "true_class", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in K.CLASSES])


def confidence_distribution(preds: DataFrame, conf: str = "confidence") -> DataFrame:
    """Count and share per band (HIGH, MEDIUM, LOW all shown)."""
    spark = preds.sparkSession
    bands = spark.createDataFrame([(0, "HIGH"), (1, "MEDIUM"), (2, "LOW")], "band_ord int, band string")
    c = preds.groupBy(confidence_band(F.col(conf)).alias("band")).agg(F.count(F.lit(1)).alias("n"))
    total = preds.agg(F.count(F.lit(1)).alias("total"))
    return (
        bands.join(c, "band", "left").crossJoin(total)
        .select("band_ord", "band", F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n"),
                (F.coalesce(F.col("n"), F.lit(0)) / F.col("total")).alias("share"))
    )


def error_summary(preds: DataFrame, label: str = "label", pred: str = "pred", conf: str = "confidence",
                  key: str = "id", top: int = 5, prefix: str = "vote_") -> DataFrame:
    """False positives and negatives (any threat against benign), misclassified
    count and share, low-confidence-but-correct count, and the first ``top`` errors by
    key with their probabilities (a top-k report)."""
    benign, called_benign = F.col(label) == "benign", F.col(pred) == "benign"
    wrong = F.col(label) != F.col(pred)
    agg = preds.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(wrong, 1).otherwise(0)).alias("misclassified"),
        F.sum(F.when(~wrong & (F.col(conf) < K.MEDIUM_BAND), 1).otherwise(0)).alias("low_confidence_correct"),
        F.sum(F.when(benign & ~called_benign, 1).otherwise(0)).alias("false_positives"),
        F.sum(F.when(~benign & called_benign, 1).otherwise(0)).alias("false_negatives"),
    ).withColumn("misclassified_share", F.col("misclassified") / F.col("n"))
    first = (
        preds.where(wrong).orderBy(key).limit(top)
        .agg(F.collect_list(F.struct(F.col(key).alias("key"), F.col(label).alias("true"), F.col(pred).alias("pred"),
                                     F.col(conf).alias("confidence"),
                                     F.array(*[F.col(f"{prefix}{c}") for c in K.CLASSES]).alias("probabilities"))).alias("first_errors"))
    )
    first = first.select(F.array_sort(F.col("first_errors")).alias("first_errors"))
    return agg.crossJoin(first)


def weighted_roc_auc(scores: DataFrame, label: str = "label", prefix: str = "vote_", partitions: int | None = None) -> DataFrame:
    """One-vs-rest AUC per class from the rank-sum statistic with tied
    scores sharing half credit, and the support-weighted average.

    Scores are first aggregated per (class, score) — a map-side combined
    count — then ranked inside range partitions of (class, score) with a
    per-partition offset, so no class is gathered into one task."""
    per = scores.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("cls"), F.col(f"{prefix}{c}").alias("score"),
                                     (F.col(label) == c).alias("pos")) for c in K.CLASSES])).alias("x")
    ).select("x.*")
    agg = per.groupBy("cls", "score").agg(
        F.sum(F.when(F.col("pos"), 1).otherwise(0)).alias("npos"), F.sum(F.when(F.col("pos"), 0).otherwise(1)).alias("nneg")
    )
    from hookline.session import materialize, parallelism

    n_parts = partitions or parallelism(scores.sparkSession)
    # One materialisation: both uses below must see the same partition ids.
    r = materialize(agg.repartitionByRange(n_parts, "cls", "score").withColumn("pid", F.spark_partition_id()))
    ptot = r.groupBy("cls", "pid").agg(F.sum("nneg").alias("pneg"))
    off = ptot.withColumn(
        "off", F.coalesce(F.sum("pneg").over(Window.partitionBy("cls").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).select("cls", "pid", "off")
    within = F.coalesce(F.sum("nneg").over(Window.partitionBy("cls", "pid").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    r = r.withColumn("below", within).join(F.broadcast(off), ["cls", "pid"])
    auc = r.groupBy("cls").agg(
        F.sum(F.col("npos") * (F.col("off") + F.col("below") + 0.5 * F.col("nneg"))).alias("u"),
        F.sum("npos").alias("P"), F.sum("nneg").alias("N"),
    ).withColumn("auc", F.when((F.col("P") > 0) & (F.col("N") > 0), F.col("u") / (F.col("P") * F.col("N"))))
    w = auc.agg((F.sum(F.col("auc") * F.col("P")) / F.sum(F.when(F.col("auc").isNotNull(), F.col("P")))).alias("auc"))
    return auc.select("cls", "auc", F.col("P").alias("support")).unionByName(
        w.select(F.lit("weighted").alias("cls"), "auc", F.lit(None).cast("long").alias("support"))
    )
