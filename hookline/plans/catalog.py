"""Registered queries: one per operator group of the coverage checklist.

Each entry maps a name to a Spark builder ``(spark, sf_dir) -> DataFrame`` and,
where the operator is expressible in SQL, a DuckDB oracle string over the
driver's views.  Every query reads the driver's tables (or data Spark derives
from them), so its work grows with the scale factor.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hookline.functions import features as FT
from hookline.functions import urls as U
from hookline.plans import derived as D
from hookline.plans import oracle as O
from hookline.session import materialize

ROUND = O.ROUND

Builder = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: Callable[[], str] | None = None):
    def deco(fn: Builder) -> Builder:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql()
        return fn

    return deco


def round_doubles(df: DataFrame, digits: int = ROUND) -> DataFrame:
    return df.withColumns(
        {f.name: F.round(F.col(f.name), digits) for f in df.schema.fields if f.dataType.typeName() == "double"}
    )


# ------------------------------------------------------------- URL features

@register("url_features", O.url_features_sql)
def q_url_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1–D60, D63–D66 over every derived URL (66-column profile, native part)."""
    return round_doubles(FT.featurize_main(D.typed_urls(spark, sf_dir)))


@register("url_split", O.url_split_sql)
def q_url_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1–C4, C6 and B7–B9, B11, B15 over every derived URL."""
    t = D.typed_urls(spark, sf_dir)
    parts = FT.url_parts(t, "url", "_p_")
    url = F.col("url")
    return parts.select(
        "id", "source", "url",
        F.col("_p_scheme").alias("scheme"),
        F.col("_p_netloc").alias("netloc"),
        F.col("_p_path").alias("path"),
        F.col("_p_query").alias("query"),
        F.col("_p_fragment").alias("fragment"),
        F.col("_p_sub").alias("subdomain"),
        F.col("_p_dom").alias("domain"),
        F.col("_p_sfx").alias("suffix"),
        F.col("_p_bad").alias("invalid"),
        U.ensure_scheme_https(url).alias("url_https"),
        U.ensure_scheme_http(url).alias("url_http"),
        U.strict_clean(url).alias("strict_url"),
        U.strict_clean_ok(url).alias("strict_ok"),
        U.netloc_by_slash(url).alias("netloc_by_slash"),
        U.url_host_key(url).alias("host_key"),
        U.browser_hostname(url).alias("hostname"),
    )


@register("url_features_v1", O.v1_features_sql)
def q_url_features_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DV1: 29-column first-generation profile."""
    t = D.typed_urls(spark, sf_dir).drop("type")
    return round_doubles(FT.featurize_v1(t))


@register("url_features_host29", O.host29_features_sql)
def q_url_features_host29(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DV5: 29-column host profile on the percent-decoded URL."""
    t = D.typed_urls(spark, sf_dir).drop("type")
    return round_doubles(FT.featurize_host29(t))


@register("url_features_mini11_py", O.mini11_py_sql)
def q_url_features_mini11_py(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DV6: eleven columns of the small dataset script."""
    return FT.featurize_mini11_py(D.typed_urls(spark, sf_dir).drop("type"))


@register("url_features_mini11_js", O.mini11_js_sql)
def q_url_features_mini11_js(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DV7: eleven columns of the browser side."""
    return FT.featurize_mini11_js(D.typed_urls(spark, sf_dir).drop("type"))


# ------------------------------------------------------------- look-alikes

from hookline import constants as K  # noqa: E402
from hookline.operators import lookalike as LK  # noqa: E402


@register("typo_urls", lambda: O.typo_urls_sql())
def q_typo_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H2: typo variants (homoglyph, omission, duplication, swap, affixes,
    digrams) of the brand picked by each part key, as URLs."""
    return D.typo_urls(spark, sf_dir)


@register("lookalike_patterns", O.lookalike_patterns_sql)
def q_lookalike_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E2, E4, E5 (pattern rules), E6 per distinct domain of the derived URLs."""
    parts = U.add_url_parts(D.typed_urls(spark, sf_dir), "url", "_p_", clean=True)
    prof = LK.domain_profile(spark, parts.select(F.col("_p_dom").alias("domain")), "domain", with_ratios=False)
    return prof.select(
        "domain",
        F.col("e5.flag").alias("typo_flag"),
        F.col("e5.brand").alias("typo_brand"),
        F.round(F.col("e5.confidence"), ROUND).alias("typo_confidence"),
        F.col("e6").alias("homograph"),
        F.col("subst").alias("char_substitution"),
    )


def _override(spark: SparkSession, sf_dir: str, with_ratios: bool) -> DataFrame:
    scored = D.url_model_probs(D.typed_urls(spark, sf_dir))
    out = LK.apply_override(spark, scored, "url", "model_pred", "p_", with_ratios=with_ratios)
    return round_doubles(out)


@register("url_override_rules", O.override_rules_sql)
def q_url_override_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E8 + E9 cascade with the pattern rules (no sequence-ratio rules)."""
    return _override(spark, sf_dir, with_ratios=False)


@register("url_override")
def q_url_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E8 full cascade, including the sequence-ratio rules."""
    return _override(spark, sf_dir, with_ratios=True)


def _flat_verdict(df: DataFrame) -> DataFrame:
    """The verdict record as flat columns."""
    v, d = F.col("verdict"), F.col("model_details")
    return df.select(
        "id", "source", "url", v["threat_detected"].alias("threat_detected"), v["category"].alias("category"),
        v["confidence"].alias("confidence"), F.array_join(v["reasons"], ",").alias("reasons"),
        *[F.element_at(v["probabilities"], c).alias(f"prob_{c}") for c in K.CLASSES],
        *[d[m]["prediction"].alias(f"{m}_pred") for m in S.MODELS],
        *[d[m]["reason"].alias(f"{m}_reason") for m in S.MODELS],
        *[F.round(d[m]["confidence"], ROUND).alias(f"{m}_confidence") for m in S.MODELS],
    )


@register("ensemble_verdicts", lambda: O.ensemble_verdicts_sql(O.typed_urls_sql()))
def q_ensemble_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4 on overridden probabilities and the M5 record (pattern rules)."""
    probs = D.ensemble_probs(D.typed_urls(spark, sf_dir))
    return _flat_verdict(S.ensemble_verdicts(spark, probs, "url", with_ratios=False))


@register("typosquat_profile")
def q_typosquat_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1, E3, E5, E7 per distinct domain of the derived URLs."""
    parts = U.add_url_parts(D.typed_urls(spark, sf_dir), "url", "_p_", clean=True)
    prof = LK.domain_profile(spark, parts.select(F.col("_p_dom").alias("domain")), "domain", with_ratios=True)
    return prof.select(
        "domain",
        F.col("e3.flag").alias("adv_flag"), F.round(F.col("e3.score"), ROUND).alias("adv_score"), F.col("e3.brand").alias("adv_brand"),
        F.col("e5.flag").alias("typo_flag"), F.col("e5.brand").alias("typo_brand"),
        F.round(F.col("e5.confidence"), ROUND).alias("typo_confidence"),
        F.round(F.col("e7.score"), ROUND).alias("suspicion_score"), F.array_join(F.col("e7.reasons"), "_").alias("suspicion_reasons"),
    )


@register("url_features_full")
def q_url_features_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole 66-column profile, D61/D62 included."""
    return round_doubles(FT.featurize_urls(D.typed_urls(spark, sf_dir), "url", "main"))


# ----------------------------------------------------------- rules and pages

from hookline.operators import rules as R  # noqa: E402


@register("risk_navigation", lambda: O.risk_navigation_sql())
def q_risk_navigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1, F2, F3, F5, F6 over navigation requests against the threat list."""
    nav = D.navigations(spark, sf_dir)
    x = R.threat_match(nav, D.threats(spark, sf_dir), "url", "threat")
    x = x.withColumn("risk", R.quick_risk_score(F.col("url")))
    x = x.withColumn("decision", R.navigation_decision(F.col("resource_type"), F.col("known_threat"), F.col("risk")))
    return x.select(
        "id", "source", "url", "resource_type", F.round("risk", ROUND).alias("risk"), "known_threat",
        F.col("decision.action").alias("action"), F.col("decision.reason").alias("reason"),
        F.when(F.col("decision.action") == "block", R.threat_type(F.col("decision.reason"))).alias("threat_type"),
        R.scam_categories(F.col("url")).alias("scam_categories"),
    )


@register("model_gate", lambda: O.model_gate_sql())
def q_model_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F4, F5, F7, F8 on one model's verdict per URL."""
    s = D.url_model_probs(D.typed_urls(spark, sf_dir))
    conf = F.greatest(*[F.col(f"p_{c}") for c in K.CLASSES])
    gate = R.model_block_gate(F.col("model_pred") == "phishing", conf)
    reason = F.when(gate == "block", R.model_block_reason(conf))
    band = R.confidence_band(conf)
    return s.select(
        "id", "source", "url", "model_pred", F.round(conf, ROUND).alias("confidence"), gate.alias("gate"),
        reason.alias("reason"), F.when(gate == "block", R.threat_type(reason)).alias("threat_type"),
        band.alias("band"), R.route_action(band).alias("route"),
    )


@register("page_scans", lambda: O.page_scans_sql())
def q_page_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1, G2, G3, G5 over every page."""
    return R.page_scan(D.page_html(spark, sf_dir)).drop("html")


@register("xss_params", lambda: O.xss_params_sql())
def q_xss_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C5 + G4: query pairs and the keys whose values look like XSS."""
    t = D.typed_urls(spark, sf_dir)
    q = U.url_query(F.col("url"))
    return t.select(
        "id", "source", "url",
        F.size(U.query_pairs(q)).cast("int").alias("n_params"),
        R.xss_params(F.col("url")).alias("xss_keys"),
    )


# --------------------------------------------------------- scoring, metrics

from hookline.operators import scoring as S  # noqa: E402


def _preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = S.soft_vote(D.given_probs(spark, sf_dir))
    return v.select("id", "label", F.col("vote_pred").alias("pred"), F.col("vote_confidence").alias("confidence"),
                    *[f"vote_{c}" for c in K.CLASSES])


@register("soft_vote", lambda: O.soft_vote_sql())
def q_soft_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted soft vote of three models per order."""
    v = S.soft_vote(D.given_probs(spark, sf_dir))
    band = R.confidence_band(F.col("vote_confidence"))
    return v.select(
        "id", "label", "vote_pred", "vote_confidence", *[f"vote_{c}" for c in K.CLASSES],
        (F.col("vote_pred") != "benign").alias("threat_detected"), band.alias("band"), R.route_action(band).alias("route"),
    )


@register("meta_features", lambda: O.meta_features_sql())
def q_meta_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6, M7: the 25-column meta-feature matrix."""
    m = S.meta_features(S.base_prob_vector(D.given_probs(spark, sf_dir)))
    return round_doubles(m.select("id", "label", *S.META_NAMES))


@register("classification_report", lambda: O.classification_report_sql())
def q_classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-class precision/recall/F1/support plus accuracy, macro, weighted."""
    return round_doubles(S.classification_report(_preds(spark, sf_dir)))


@register("confusion_matrix", lambda: O.confusion_matrix_sql())
def q_confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N5."""
    return S.confusion_matrix(_preds(spark, sf_dir))


@register("confidence_distribution", lambda: O.confidence_distribution_sql())
def q_confidence_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N9."""
    return round_doubles(S.confidence_distribution(_preds(spark, sf_dir)))


@register("error_summary", lambda: O.error_summary_sql())
def q_error_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N6, N7 (first five errors by key), N8."""
    return round_doubles(S.error_summary(_preds(spark, sf_dir)))


@register("prediction_table", lambda: O.prediction_table_sql())
def q_prediction_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N12."""
    p = _preds(spark, sf_dir).join(D.odd_urls(spark, sf_dir).select("id", "url"), "id")
    return p.select("id", "url", "label", "pred", "confidence", S.confidence_band(F.col("confidence")).alias("band"),
                    (F.col("label") == F.col("pred")).alias("correct"))


@register("weighted_roc_auc", lambda: O.weighted_roc_auc_sql())
def q_weighted_roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-vs-rest AUC per class and support-weighted."""
    return round_doubles(S.weighted_roc_auc(_preds(spark, sf_dir), "label", "vote_"))


@register("model_comparison", lambda: O.model_comparison_sql())
def q_model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy per base model and of the vote, gain over the best base."""
    v = S.soft_vote(D.given_probs(spark, sf_dir))
    classes = F.array(*[F.lit(c) for c in K.CLASSES])
    cols = {m: F.element_at(classes, S.first_argmax([F.col(f"{m}_{c}") for c in K.CLASSES]) + 1) for m in S.MODELS}
    cols["vote"] = F.col("vote_pred")
    acc = v.select(
        F.explode(F.array(*[F.struct(F.lit(m).alias("model"), (c == F.col("label")).cast("double").alias("hit")) for m, c in cols.items()])).alias("x")
    ).select("x.*").groupBy("model").agg(F.avg("hit").alias("accuracy"))
    best = acc.where(F.col("model") != "vote").agg(F.max("accuracy").alias("best"))
    return round_doubles(acc.crossJoin(best).select("model", "accuracy", (F.col("accuracy") - F.col("best")).alias("improvement_over_best_base")))


# ------------------------------------------------------ corpus and statistics

from hookline.operators import corpus as CO  # noqa: E402
from hookline.operators import stats as ST  # noqa: E402


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = D.typed_urls(spark, sf_dir)
    return t.withColumn("key", F.concat_ws(":", F.col("source"), F.col("id").cast("string")))


@register("stratified_split", lambda: O.stratified_split_sql())
def q_stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact per-class 80/10/10 split, 5 folds, 10-step ladder."""
    s = CO.split_assignments(_keyed(spark, sf_dir), "type", "key", 42)
    return s.select("key", "type", "cls_rank", "cls_n", "split", "fold", "step")


@register("shuffle", lambda: O.shuffle_sql())
def q_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All URLs in a seeded random order, as positions."""
    return CO.shuffle(_keyed(spark, sf_dir), "key", 42).select("key", "url", "position")


@register("class_stats", lambda: O.class_stats_sql())
def q_class_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1, K2, K4 (B6 label normalisation)."""
    return round_doubles(ST.class_stats(D.typed_urls(spark, sf_dir), "type"))


@register("sample_weights", lambda: O.sample_weights_sql())
def q_sample_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5: balanced class weight per row."""
    return round_doubles(ST.sample_weights(_keyed(spark, sf_dir), "type").select("key", "type", "weight"))


def _mini_js(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FT.featurize_mini11_js(D.typed_urls(spark, sf_dir).drop("type"))


@register("median_fill", lambda: O.median_fill_sql())
def q_median_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3: exact-median fill of the browser features (null when unparsable)."""
    return round_doubles(ST.median_fill(_mini_js(spark, sf_dir).drop("url"), FT.MINI11_FEATURES))


@register("standardise", lambda: O.standardise_sql())
def q_standardise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6: population standardisation of five URL features."""
    f = FT.featurize_main(D.typed_urls(spark, sf_dir)).select("id", "source", *O.STD_COLS)
    return round_doubles(ST.standardise(f, O.STD_COLS))


@register("profile_columns", lambda: O.profile_columns_sql())
def q_profile_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, nulls, distinct, min, max per feature column."""
    return ST.profile_columns(_mini_js(spark, sf_dir), FT.MINI11_FEATURES)


@register("dataset_summary", lambda: O.dataset_summary_sql())
def q_dataset_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7: rows, feature count, class distribution."""
    return ST.dataset_summary(D.typed_urls(spark, sf_dir), "type", FT.MAIN_NATIVE_FEATURES)


@register("ranked_urls", lambda: O.ranked_urls_sql())
def q_ranked_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank slices of the ranked list as benign URLs."""
    r = D.ranked_domains(spark, sf_dir)
    return CO.domains_to_urls(CO.rank_slices(r, K.RANK_HEAD, *K.RANK_SLICE))


@register("coverage_check", lambda: O.coverage_check_sql())
def q_coverage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which named sites the ranked list holds, with rank."""
    return CO.coverage_check(D.ranked_domains(spark, sf_dir), CO.site_table(spark))


@register("merged_sample", lambda: O.merged_sample_sql())
def q_merged_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I1 (common columns, union all) then J1 (seeded sample of 5,000)."""
    ranked = CO.domains_to_urls(D.ranked_domains(spark, sf_dir))
    merged = CO.merge_on_common_columns([D.typed_urls(spark, sf_dir), ranked])
    return CO.sample_up_to(merged, 5000, 42, "url")


@register("synthetic_corpus", lambda: O.synthetic_corpus_sql())
def q_synthetic_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pattern, brand-path and numeric look-alike
    URLs for the generator brands, de-duplicated and tagged."""
    b = D.synth_brands(spark, sf_dir)
    urls = (
        CO.pattern_urls(b).select("url")
        .unionByName(CO.brand_path_urls(b).select("url"))
        .unionByName(CO.numeric_brand_urls(b).select("url"))
    )
    return CO.tag_seed(CO.dedupe_urls(urls), "phishing", 42)


# ----------------------------------------------------------------- training

from hookline.operators import balance as BA  # noqa: E402
from hookline.operators import boosting as BO  # noqa: E402
from hookline.operators import train as TR  # noqa: E402

# The registered queries fit models of the original sizes (the library defaults) on all labelled rows.


def _train_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls, key = D.typed_urls(spark, sf_dir), F.concat_ws(":", F.col("source"), F.col("id").cast("string"))
    f = FT.featurize_main(urls, batches=True).withColumn("key", key)
    return CO.split_assignments(f, "type", "key", 42, counted=urls.select("type", key.alias("key")))


def _report(model, test: DataFrame) -> DataFrame:
    pred = TR.score(model, test).select(F.col("type").alias("label"), F.col("model_pred").alias("pred"))
    return round_doubles(S.classification_report(pred), 6)


@register("train_random_forest")
def q_train_random_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1 (+ J3, K4, K5, N4): class-weighted random forest on URL features,
    evaluated on the held-out test split."""
    d = _train_frame(spark, sf_dir)
    model = TR.fit(d.where(F.col("split") == "train"), FT.MAIN_NATIVE_FEATURES, TR.random_forest())
    return _report(model, d.where(F.col("split") == "test"))


def _boosted(spark: SparkSession, sf_dir: str, params) -> DataFrame:
    d = materialize(_train_frame(spark, sf_dir).select("key", "type", "split", *FT.MAIN_NATIVE_FEATURES))
    model = BO.fit(d.where(F.col("split") != "test"), FT.MAIN_NATIVE_FEATURES, params, valid="split = 'valid'")
    test = model.score(d.where(F.col("split") == "test"))
    report = S.classification_report(test.select(F.col("type").alias("label"), F.col("model_pred").alias("pred")))
    return round_doubles(report, 6)


@register("train_boosted_trees")
def q_train_boosted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L2: 500 rounds of leaf-wise boosted trees (64 leaves) on URL features, held-out
    loss on the validation split, report on the test split."""
    return _boosted(spark, sf_dir, BO.LEAF_WISE)


@register("train_boosted_trees_depth")
def q_train_boosted_trees_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L3: 500 rounds to depth 7 with L1 and L2 penalties, as above."""
    return _boosted(spark, sf_dir, BO.DEPTH_WISE)


def _meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = S.meta_features(S.base_prob_vector(D.given_probs(spark, sf_dir)))
    return m.withColumn("key", F.col("id").cast("string")).withColumnRenamed("label", "type")


@register("train_meta_logistic")
def q_train_meta_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L4 on M6/M7 meta features of the three models' probabilities."""
    d = CO.split_assignments(_meta(spark, sf_dir), "type", "key", 42)
    train = d.where(F.col("split") == "train")
    total_w = train.count()
    model = TR.fit(train, S.META_NAMES, TR.meta_logistic(total_weight=float(total_w)))
    return _report(model, d.where(F.col("split") == "test"))


@register("score_with_model")
def q_score_with_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1, M3, M5, M9: score every URL with a forest trained on the train
    split, then the look-alike override cascade and the verdict fields."""
    # Kept rows are written with the partitions that a fit sees, whose places its bootstrap draws by.
    made = _train_frame(spark, sf_dir).persist()
    try:
        d = materialize(made)
    finally:
        made.unpersist()
    model = TR.fit(d.where(F.col("split") == "train"), FT.MAIN_NATIVE_FEATURES, TR.random_forest())
    scored = TR.score(model, d).select("id", "source", "url", "model_pred", *[f"p_{c}" for c in K.CLASSES])
    out = LK.apply_override(spark, scored, "url", "model_pred", "p_", with_ratios=True)
    conf = F.greatest(*[F.col(f"final_{c}") for c in K.CLASSES])
    return out.select(
        "id", "source", "url", "model_pred", "final_pred", (F.col("final_pred") != "benign").alias("threat_detected"),
        F.round(conf, 6).alias("confidence"), "reason", "heuristic_applied",
    )


@register("feature_importance")
def q_feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 15 feature importances of the forest."""
    d = _train_frame(spark, sf_dir)
    model = TR.fit(d.where(F.col("split") == "train"), FT.MAIN_NATIVE_FEATURES, TR.random_forest())
    return TR.feature_importance(model, FT.MAIN_NATIVE_FEATURES, 15)


@register("cross_validate")
def q_cross_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-fold accuracy and macro F1 of the forest."""
    d = materialize(_train_frame(spark, sf_dir))
    res = TR.cross_validate(d, FT.MAIN_NATIVE_FEATURES, TR.random_forest, "type", "fold", 5)
    return round_doubles(res, 6)


# ---------------------------------------------------------------- streaming

from hookline.streaming import streams as SS  # noqa: E402


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.read(spark, sf_dir, "events")


def _pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    p = D.read(spark, sf_dir, "pages").select("page_id", "url")
    return p, p.count()


@register("nav_stats", lambda: O.nav_stats_sql())
def q_nav_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O2 (batch twin): blocked / scanned / safe counters per user."""
    return SS.running_stats(_events(spark, sf_dir))


@register("stream_running_stats", lambda: O.nav_stats_sql())
def q_stream_running_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O2 as a Structured Streaming aggregation (update mode, keyed upsert)."""
    stats = SS.running_stats(SS.event_stream(spark, sf_dir))
    return SS.run_upsert(stats, SS.stream_folder(spark, "running_stats"), ["user_id"])


@register("event_report", lambda: O.event_report_sql())
def q_event_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reported events per type."""
    return SS.report_counts(_events(spark, sf_dir))


@register("redirect_alerts", lambda: O.redirect_alerts_sql())
def q_redirect_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O3 (batch twin): redirect alerts after the third per page view."""
    return SS.redirect_alerts(_events(spark, sf_dir))


@register("stream_redirect_alerts", lambda: O.redirect_alerts_sql())
def q_stream_redirect_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O3 as a stream: page views touched by a micro-batch are counted anew."""
    folder = SS.stream_folder(spark, "redirect_alerts")
    return SS.run_page_views(SS.event_stream(spark, sf_dir), folder, SS.only("redirect"), SS.redirect_alerts)


@register("warning_dwell", lambda: O.warning_dwell_sql())
def q_warning_dwell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Milliseconds from a block to the next event of the page view."""
    return SS.warning_dwell(_events(spark, sf_dir)).drop("day")


@register("stream_warning_dwell", lambda: O.warning_dwell_sql())
def q_stream_warning_dwell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O6 as a stream."""
    folder = SS.stream_folder(spark, "warning_dwell")
    return SS.run_page_views(SS.event_stream(spark, sf_dir), folder, SS.only(None), SS.warning_dwell).drop("day")


@register("feedback_count", lambda: O.feedback_count_sql())
def q_feedback_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback records appended by a stream, then counted."""
    pages, n = _pages(spark, sf_dir)
    records = SS.feedback_records(SS.event_stream(spark, sf_dir), pages, n)
    fb = SS.run_append(records, SS.stream_folder(spark, "feedback"))
    return SS.feedback_counts(fb)


@register("navigation_events", lambda: O.navigation_events_sql())
def q_navigation_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O1 + O7 (batch twin): decision per navigation event."""
    pages, n = _pages(spark, sf_dir)
    return SS.navigation_decisions(_events(spark, sf_dir), pages, n, D.threats(spark, sf_dir))


@register("stream_navigation", lambda: O.navigation_events_sql())
def q_stream_navigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O1 as a stream: the batch decision on every micro-batch."""
    pages, n = _pages(spark, sf_dir)
    threats = D.threats(spark, sf_dir)

    def decide(events: DataFrame) -> DataFrame:
        return SS.navigation_decisions(events, pages, n, threats)

    schema = decide(spark.createDataFrame([], SS.EVENT_SCHEMA)).schema
    return SS.run_batches(SS.event_stream(spark, sf_dir), SS.stream_folder(spark, "navigation"), decide, schema)


@register("stream_score", lambda: O.ensemble_verdicts_sql(O.event_urls_sql()))
def q_stream_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The models' probabilities, overrides, vote and verdict record on a URL stream."""
    pages, n = _pages(spark, sf_dir)

    def score(events: DataFrame) -> DataFrame:
        urls = SS.attach_urls(events, pages, n).select(F.col("event_id").alias("id"), F.lit("event").alias("source"), "url")
        return _flat_verdict(S.ensemble_verdicts(spark, D.ensemble_probs(urls), "url", with_ratios=False))

    schema = score(spark.createDataFrame([], SS.EVENT_SCHEMA)).schema
    return SS.run_batches(SS.event_stream(spark, sf_dir), SS.stream_folder(spark, "score"), score, schema)


# ------------------------------------------------------ sources and cleaning

from hookline.sources import io as IO  # noqa: E402

RECORD_FEATURES = FT.MINI11_FEATURES + ["index"]


@register("feature_records", lambda: O.feature_records_sql())
def q_feature_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6 + B3: browser feature JSON per URL parsed back into the model's
    feature order, missing keys (and the stray ``index``) as 0."""
    f = FT.featurize_mini11_js(D.typed_urls(spark, sf_dir).drop("type"))
    js = f.select("id", "source", F.to_json(F.struct(*FT.MINI11_FEATURES)).alias("features_json"))
    return js.select("id", "source", *IO.feature_record_from_json("features_json", RECORD_FEATURES))


def _file(spark: SparkSession, name: str) -> str:
    return f"{SS.stream_folder(spark, 'files')}/{name}"


@register("corpus_file", lambda: O.corpus_file_sql())
def q_corpus_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus written as CSV without its id and read again."""
    path = _file(spark, "corpus")
    df = IO.drop_column(D.typed_urls(spark, sf_dir).where("url <> ''").select("id", "url", "type"), "id")
    IO.write_table(df, path, "csv")
    return IO.read_url_corpus(spark, path)


@register("ranked_file", lambda: O.ranked_file_sql())
def q_ranked_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: the first ranks of a file of ranked domains."""
    path = _file(spark, "ranked")
    D.ranked_domains(spark, sf_dir).write.csv(path)
    return IO.read_ranked_domains(spark, path, 500)


@register("threat_file", lambda: O.threat_file_sql())
def q_threat_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A threat list, one substring per line."""
    path = _file(spark, "threats")
    D.threats(spark, sf_dir).write.text(path)
    return IO.read_threat_list(spark, path)


@register("aligned_records", lambda: O.aligned_records_sql())
def q_aligned_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns in a model's order, missing ones 0, others dropped."""
    u = F.col("url")
    x = D.typed_urls(spark, sf_dir).where("url <> ''").select(
        "id", (F.length(u) - F.length(F.replace(u, F.lit("."), F.lit("")))).alias("num_dots"),
        F.length(u).alias("url_length"), F.lit(1).alias("other"),
    )
    return IO.align_to_schema(x, ["url_length", "missing_feature", "num_dots"], ["id"])


@register("stacked_corpus", lambda: O.stacked_corpus_sql())
def q_stacked_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of one schema stacked by name."""
    from hookline.operators.corpus import merge_same_schema

    t = D.typed_urls(spark, sf_dir).select("id", "source", "url")
    return merge_same_schema([t.where("source = 'legit'"), t.where("source = 'odd'").select("url", "source", "id")])


@register("tld_one_hot", lambda: O.tld_one_hot_sql())
def q_tld_one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suffix indicators with the first (alphabetical) level dropped."""
    parts = U.add_url_parts(D.typed_urls(spark, sf_dir), "url", "_p_", clean=True)
    x = parts.select("id", "source", F.col("_p_sfx").alias("suffix"))
    from pyspark.ml.functions import vector_to_array

    return IO.one_hot(x, "suffix", "suffix_onehot").withColumn("suffix_onehot", vector_to_array("suffix_onehot"))


@register("phishing_head", lambda: O.phishing_head_sql())
def q_phishing_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised columns, phishing rows, the first 1,000 by key."""
    t = D.typed_urls(spark, sf_dir).toDF("ID", " Source", "URL ", "Type")
    n = IO.normalise_columns(t)
    return IO.read_first(IO.filter_by_label(n, "PHISHING", "label"), 1000, ["source", "id"])


@register("url_features_decoded", lambda: O.decoded_features_sql(False))
def q_url_features_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DV3: 58 columns on the percent-decoded URL."""
    return round_doubles(FT.featurize_decoded(D.typed_urls(spark, sf_dir).drop("type")))


@register("url_features_decoded_https", lambda: O.decoded_features_sql(True))
def q_url_features_decoded_https(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DV4: DV3 after the https prefix."""
    return round_doubles(FT.featurize_decoded(D.typed_urls(spark, sf_dir).drop("type"), https_first=True))


@register("url_features_v2", lambda: O.v2_features_sql())
def q_url_features_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DV2: 57-column second-generation profile."""
    return round_doubles(FT.featurize_v2(D.typed_urls(spark, sf_dir).drop("type")))


@register("smote_balanced")
def q_smote_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Meta features of all orders and the rows made until every class has as many
    as the largest, counted and averaged per class."""
    got = BA.smote(_meta(spark, sf_dir), S.META_NAMES, "type", "key")
    return round_doubles(got.groupBy("type", "synthetic").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in S.META_NAMES]), 6)


@register("train_meta_calibrated")
def q_train_meta_calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L5 + L6: in each of three folds, meta features scaled and oversampled on the other
    two → 100 rounds of boosted trees (depth 5, 31 leaves) → isotonic calibration on the
    fold; report on the test split."""
    d = materialize(CO.split_assignments(_meta(spark, sf_dir), "type", "key", 42).select("key", "type", "split", "fold", *S.META_NAMES))
    cal = TR.calibrate_isotonic(d.where(F.col("split") == "train"), S.META_NAMES, None, "type", "fold", 3,
                                fit_member=lambda rows: TR.fit_meta_boosted(rows, S.META_NAMES))
    pred = cal.transform(d.where(F.col("split") == "test")).select(F.col("type").alias("label"), F.col("model_pred").alias("pred"))
    return round_doubles(S.classification_report(pred), 6)


@register("learning_curve")
def q_learning_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted F1 against training fraction (10 ladder steps x 5 folds, mean and sd)."""
    d = materialize(_train_frame(spark, sf_dir))
    estimator = TR.random_forest(num_trees=200, max_depth=20)
    return round_doubles(TR.learning_curve(d, FT.MAIN_NATIVE_FEATURES, lambda: estimator), 6)


@register("random_search")
def q_random_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash-drawn parameter sets of a forest scored by 3-fold weighted F1."""
    d = materialize(_train_frame(spark, sf_dir).where(F.col("split") == "train"))
    grid = {"trees": [100, 200, 300], "depth": [10, 20, 30, None], "least_split": [2, 5, 10], "least_leaf": [1, 2, 4],
            "features": ["sqrt", "log2", "all"]}
    return round_doubles(TR.random_search(d, FT.MAIN_NATIVE_FEATURES, grid, draws=10, folds=3), 6)


@register("model_bundle")
def q_model_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model saved with its metadata, loaded again, and its scores of the test
    split beside those of the model that was saved."""
    import uuid

    from hookline.session import checkpoint_dir

    d = materialize(CO.split_assignments(_meta(spark, sf_dir), "type", "key", 42))
    train = d.where(F.col("split") == "train")
    model = TR.fit(train, S.META_NAMES, TR.meta_logistic(total_weight=float(train.count())))
    test = d.where(F.col("split") == "test")
    pred = TR.score(model, test).select(F.col("type").alias("label"), F.col("model_pred").alias("pred"))
    metrics = S.classification_report(pred).where(F.col("class") == "accuracy").select(F.col("f1").alias("accuracy"))
    path = f"{checkpoint_dir(spark)}/bundle-{uuid.uuid4().hex}"
    TR.save_bundle(model, TR.model_metadata("logistic", S.META_NAMES, metrics, {"C": 1.0, "max_iter": 2000}), path)
    loaded, metadata = TR.load_bundle(spark, path)
    probs = [f"p_{c}" for c in K.CLASSES]
    before = TR.score(model, test).select("id", *probs)
    after = TR.score(loaded, test).select("id", F.col("model_pred").alias("pred"), *[F.col(p).alias(f"again_{p}") for p in probs])
    drift = F.greatest(*[F.abs(F.col(p) - F.col(f"again_{p}")) for p in probs])
    return after.join(before, "id").select("id", "pred", drift.alias("drift")).crossJoin(
        F.broadcast(metadata.select("model_type", "n_features", F.round("accuracy", 6).alias("accuracy"))))


@register("coefficient_topk")
def q_coefficient_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten meta features with the largest phishing coefficients."""
    m = S.meta_features(S.base_prob_vector(D.given_probs(spark, sf_dir))).withColumnRenamed("label", "type")
    model = TR.fit(m, S.META_NAMES, TR.meta_logistic(total_weight=float(m.count())))
    return TR.coefficient_topk(model, S.META_NAMES, "phishing", 10)


@register("predict_from_record")
def q_predict_from_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8: browser feature JSON per URL scored by a binary forest trained on
    the eleven-column set (phishing vs the rest)."""
    f = FT.featurize_mini11_py(D.typed_urls(spark, sf_dir))
    f = f.withColumn("is_phishing", (F.col("type") == "phishing").cast("double"))
    data = VectorAssemblerStage(FT.MINI11_FEATURES).transform(f)
    from pyspark.ml.classification import RandomForestClassifier

    rf = RandomForestClassifier(numTrees=100, maxDepth=10, labelCol="is_phishing", featuresCol="features", seed=42, cacheNodeIds=True)
    # The columns that a fit reads, made once and left in their partitions, whose places its bootstrap draws by.
    data = data.select("is_phishing", "features").persist()
    try:
        rf = rf.fit(data)
    finally:
        data.unpersist()
    from pyspark.ml import PipelineModel

    model = PipelineModel(stages=[VectorAssemblerStage(FT.MINI11_FEATURES), rf])
    js = f.select("id", "source", F.to_json(F.struct(*FT.MINI11_FEATURES)).alias("features_json"))
    return TR.predict_from_record(model, js, "features_json", FT.MINI11_FEATURES)


def VectorAssemblerStage(cols):
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(cols), outputCol="features", handleInvalid="keep")


@register("labelled_case_check", lambda: O.labelled_case_check_sql())
def q_labelled_case_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source category, share of verdicts (override cascade) that
    match the expectation (benign sources benign, the others not)."""
    v = _override(spark, sf_dir, with_ratios=False)
    expect_benign = F.col("source").isin("real", "legit")
    ok = F.when(expect_benign, F.col("final_pred") == "benign").otherwise(F.col("final_pred") != "benign")
    return round_doubles(
        v.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.avg(ok.cast("double")).alias("accuracy"))
    )


@register("typo_tld_urls", lambda: O.typo_tld_urls_sql())
def q_typo_tld_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H3 (+ H2, H8): 15 typos per generator brand × 8 drawn TLDs."""
    return CO.typo_tld_urls(D.synth_brands(spark, sf_dir))


@register("brand_pair_urls", lambda: O.brand_pair_urls_sql())
def q_brand_pair_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H5: brand-pair hosts kept with p=0.03."""
    return CO.brand_pair_urls(D.synth_brands(spark, sf_dir))


@register("five_pattern_urls", lambda: O.five_pattern_urls_sql())
def q_five_pattern_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H9: five phishing shapes and legitimate URLs, one per part key."""
    return CO.five_pattern_urls(D.read(spark, sf_dir, "part").select("p_partkey"), "p_partkey")


@register("host_diverse_sample", lambda: O.host_diverse_sample_sql())
def q_host_diverse_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host-diverse sample of 5,000 synthetic URLs."""
    return CO.host_diverse_sample(q_synthetic_corpus(spark, sf_dir).select("url"), 5000)


@register("url_features_subst_aware", lambda: O.subst_aware_features_sql())
def q_url_features_subst_aware(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DV8 (native part): strict cleaning and substitution-aware brand tests."""
    return round_doubles(FT.featurize_subst_aware(D.typed_urls(spark, sf_dir)))


@register("brand_substitution", lambda: O.brand_substitution_sql())
def q_brand_substitution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E10 per distinct domain: brand contained as is or under cumulative
    leetspeak substitutions, and which brand."""
    parts = U.add_url_parts(D.typed_urls(spark, sf_dir), "url", "_p_", clean=True)
    d = parts.select(F.col("_p_dom").alias("domain")).distinct()
    return d.select("domain", FT.brand_with_substitution(F.col("domain")).alias("flag"),
                    FT.brand_with_substitution_match(F.col("domain")).alias("brand"))


@register("url_features_draft63", lambda: O.draft63_features_sql())
def q_url_features_draft63(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DV9 (native part): the 63-column first draft minus its ratio pair."""
    return round_doubles(FT.featurize_draft63(D.typed_urls(spark, sf_dir), native_only=True))


@register("url_features_draft63_full")
def q_url_features_draft63_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DV9 with the best-ratio pair (Arrow UDF against 11 brands)."""
    return round_doubles(FT.featurize_draft63(D.typed_urls(spark, sf_dir)))


@register("crafted_urls", lambda: O.crafted_urls_sql())
def q_crafted_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H7: one crafted look-alike URL per line item."""
    li = D.read(spark, sf_dir, "lineitem").select(
        F.concat_ws("|", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("k")
    )
    return CO.crafted_urls(li, "k", spark)
