"""Registry of runnable queries: key -> callable(spark, sf_dir) -> DataFrame.

Keys follow SURVEY §2.  Every query reads the driver tables (or data Spark
derives from them) in full.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlens.operators import profile as P
from wardlens.operators.sampling import sample_per_group, stratified_split
from wardlens.plans import eda, explain as N, forecast as FC, hypothesis as H, kpi as X, load as L, marts, modelling as M, similarity as R, warehouse as W
from wardlens.streaming import los_alert as J
from wardlens.session import cut_lineage, ensure_checkpoint_dir, ship_package, tune_session
from wardlens.sources import files
from wardlens.sources.tables import derived, load_fact, load_master, pollution_daily, pollution_readings, stored_fact

Query = Callable[[SparkSession, str], DataFrame]


def round_cols(df: DataFrame, cols, digits: int = 6) -> DataFrame:
    """Round un-rounded statistics for engine-independent comparison."""
    return df.withColumns({c: F.round(F.col(c), digits) for c in cols})


def _on_fact(fn, post=None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = fn(stored_fact(spark, sf_dir))
        return post(df) if post else df
    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


def mart_queries() -> dict[str, Query]:
    q: dict[str, Query] = {}
    for name in dir(marts):
        fn = getattr(marts, name)
        if callable(fn) and re.match(r"^[qi]\d+_", name):
            q[name] = _on_fact(fn)
    q["q11_weekly_z_outliers"] = _on_fact(
        marts.q11_weekly_z_outliers, lambda d: round_cols(d, ["mean_los", "stddev_los", "z_score"]))
    # The flagship query derives the fact itself, so its plan shows all that the stored one has behind it.
    q["q01_department_mortality"] = lambda spark, sf: marts.q01_department_mortality(load_fact(spark, sf))
    return dict(sorted(q.items()))


def _daily(spark, sf):
    return derived(spark, sf, "pollution-daily", lambda _, lines: pollution_daily(lines))


def _enriched(spark, sf):
    return derived(spark, sf, "enriched", lambda _, lines: W.enrich_master(*W.raw_inputs(load_master(spark, sf), pollution_readings(lines))))


def _scratch(spark, name: str) -> str:
    """A per-run folder under the shared checkpoint directory."""
    import uuid
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def _csv_roundtrip(spark, sf):
    """Sink the staging table as header CSV, read it back as text and coerce
    its dates and numbers (A1/A2/A5); ``sno`` goes from text to a whole number directly."""
    path = _scratch(spark, "staging-csv")
    files.write_csv(load_master(spark, sf), path)
    back = files.read_csv_text(spark, path, null_value=files.NULL_TOKEN)
    return files.coerce_numeric(files.coerce_dates(back, ["doa", "dod"]),
                                ["age", "duration_of_stay"]).select(
        F.col("sno").try_cast("bigint").alias("sno"), "mrd_no", "doa", "dod", F.col("age").cast("int").alias("age"),
        F.col("duration_of_stay").cast("int").alias("duration_of_stay"), "outcome", "hb", "bnp")


def warehouse_queries() -> dict[str, Query]:
    def dimpol(spark, sf):
        return W.dim_pollution(load_master(spark, sf), _daily(spark, sf))

    def fact2(spark, sf):
        return W.fact_from_staging(load_master(spark, sf), dimpol(spark, sf))

    def fkv(spark, sf):
        stg = load_master(spark, sf)
        return W.fk_violations(stored_fact(spark, sf), W.dim_patient(stg), W.dim_department(stg))

    return {
        "a1_csv_roundtrip": _csv_roundtrip,
        "k0a_dim_patient": lambda s, sf: W.dim_patient(load_master(s, sf)),
        "k0b_dim_department": lambda s, sf: W.dim_department(load_master(s, sf)),
        "k0c_dim_pollution": dimpol,
        "k0d_fact_admissions": fact2,
        "k0e_enrich_master": _enriched,
        "k0f_profile_nulls": lambda s, sf: round_cols(P.null_summary(_enriched(s, sf)), ["null_percent"]),
        "k0f_profile_numeric": lambda s, sf: round_cols(P.numeric_describe(_enriched(s, sf)), ["mean", "std"]),
        "k0f_profile_categorical": lambda s, sf: P.categorical_describe(_enriched(s, sf)),
        "k0f_profile_unique": lambda s, sf: P.unique_counts(_enriched(s, sf)),
        "k0f_profile_overview": lambda s, sf: round_cols(W.profile_overview(_enriched(s, sf)),
                                                         ["mortality_rate_percent"]),
        "k0g_fk_violations": fkv,
    }


#: Admissions from this day on are the first batch of the loads below, all of them the second.
BATCH_DAY = "1998-01-01"


def load_queries() -> dict[str, Query]:
    """The warehouse as tables; each key builds its own database in the shared folder and reads it back."""
    def database(spark):
        path = _scratch(spark, "warehouse")
        name = path.rsplit("/", 1)[1].replace("-", "_")
        L.create(spark, name, path)
        return name

    def loaded(spark, sf):
        db, staging = database(spark), load_master(spark, sf)
        L.load(staging.where(F.col("doa") >= F.lit(BATCH_DAY).cast("date")), db, _daily(spark, sf))
        L.load(staging, db, _daily(spark, sf))
        return db

    def after_reset(spark, sf):
        db = loaded(spark, sf)
        L.reset(spark, db)
        L.create(spark, db)
        return L.row_counts(spark, db)

    def after_second_run(spark, sf):
        db = loaded(spark, sf)
        L.create(spark, db)
        L.load(load_master(spark, sf), db, _daily(spark, sf))
        return L.row_counts(spark, db)

    def drift(spark, sf):
        fact = stored_fact(spark, sf)
        actual = fact.drop("so2").withColumn("age", F.col("age").cast("string")).withColumn("ward", F.lit(1))
        return L.schema_differences(L.declared(spark, "fact_admissions"), actual)

    def orphans(spark, sf):
        known = load_master(spark, sf).where((F.col("mrd_no").cast("bigint") % 97 != 0) & (F.col("type_of_admissionemergencyopd") != "5-LOW"))
        return W.fk_violations(stored_fact(spark, sf), W.dim_patient(known), W.dim_department(known))

    types = {"sno": "bigint", "mrd_no": "string", "doa": "date", "age": "int", "duration_of_stay": "int", "outcome": "string"}

    def ingested(spark, sf):
        """A CSV file of the staging table with planted faults, read once and checked."""
        m, path, n = load_master(spark, sf), _scratch(spark, "ingest"), F.col("sno")
        fields = [n.cast("string"), F.when(n % 59 == 0, "").otherwise(F.col("mrd_no")),
                  F.when(n % 53 == 0, "1998-13-45").otherwise(F.col("doa").cast("string")),
                  F.when(n % 50 == 0, "abc").otherwise(F.col("age").cast("string")), F.coalesce(F.col("duration_of_stay").cast("string"), F.lit("")),
                  F.when(n % 61 == 0, F.concat("outcome", F.lit(",more"))).otherwise(F.col("outcome"))]
        m.select(F.concat_ws(",", *fields)).write.text(path)
        schema = ", ".join(f"{c} STRING" for c in [*types, L.CORRUPT])
        raw = spark.read.schema(schema).options(mode="PERMISSIVE", columnNameOfCorruptRecord=L.CORRUPT).csv(path)
        return cut_lineage(L.checked(raw, types, ["sno", "mrd_no"]))

    def refreshed(keys, read):
        def run(spark, sf):
            fact, path = stored_fact(spark, sf), _scratch(spark, "sums")
            late = F.col("doa") >= F.lit(BATCH_DAY).cast("date")
            for batch, rows in (("late", late), ("early", ~late), ("late", late)):
                L.refresh(fact.where(rows), keys(), batch, path)
            return read(spark, path)
        return run

    def sql(text):
        def run(spark, sf):
            L.register_views(stored_fact(spark, sf))
            return spark.sql(text)
        return run

    def with_copies(spark, sf):
        rows = stored_fact(spark, sf).select("admission_id", "mrd_no", "doa", "department")
        return rows.unionByName(rows.where("admission_id % 50 = 0").withColumn("admission_id", F.col("admission_id") + 10**9))

    def imputed(spark, sf):
        some = F.when(F.col("sno") % 6 != 0, F.col("duration_of_intensive_unit_stay")).alias("duration_of_intensive_unit_stay")
        m = load_master(spark, sf)
        return M.risk_features(m.select(*[some if c == "duration_of_intensive_unit_stay" else c for c in m.columns])).select(
            "sno", "length_of_stay", "duration_of_intensive_unit_stay")

    return {
        "a3_ingest_accepted": lambda s, sf: L.accepted(ingested(s, sf), types),
        "a3_ingest_rejected": lambda s, sf: L.rejected(ingested(s, sf), types),
        "a7_load_fact": lambda s, sf: s.table(f"{loaded(s, sf)}.fact_admissions"),
        "a8_reset": after_reset, "a9_create_again": after_second_run, "a10_schema_drift": drift,
        "b7_imputed_stay": imputed,
        "b8_male_flag": lambda s, sf: load_master(s, sf).select("sno", L.male_flag().alias("male")),
        "c5_fk_orphans": orphans, "c6_insert_ignore": lambda s, sf: s.table(f"{loaded(s, sf)}.dim_patient"),
        "d28_type_report": lambda s, sf: L.type_report(_enriched(s, sf)),
        "f6_sample_sizes": lambda s, sf: sample_per_group(load_master(s, sf), "type_of_admissionemergencyopd", "sno", 500).groupBy(
            F.col("type_of_admissionemergencyopd").alias("department")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("sno").alias("n_distinct")),
        "f7_split_sizes": lambda s, sf: stratified_split(load_master(s, sf).select("sno", "outcome"), "outcome", ["sno"], 0.2).groupBy("outcome").agg(
            F.count(F.lit(1)).alias("n"), F.count_if("is_test").alias("n_test")),
        "g2_copies_but_for_id": lambda s, sf: L.without_copies(with_copies(s, sf), "admission_id"),
        "i1_sql_high_risk_view": sql("SELECT * FROM vw_high_risk_admissions"),
        "i3_refreshed_monthly_summary": refreshed(lambda: [L.month_key()], L.monthly_summary),
        "i4_refreshed_department_summary": refreshed(lambda: ["department"], L.department_summary),
        "i5_sql_department_efficiency": sql("SELECT e.* FROM (SELECT DISTINCT department FROM fact_admissions) d, LATERAL department_efficiency(d.department) e"),
        "i6_sql_weekly_mortality_view": sql("SELECT * FROM vw_weekly_mortality_ma"),
    }


def _on_master(fn) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(load_master(spark, sf_dir))
    return run


def eda_queries() -> dict[str, Query]:
    def kde(value, by=None):
        return _on_master(lambda m: eda.kde(m, value, by).withColumns(
            {"x": F.round("x", 9), "density": F.round("density", 10)}))
    return {
        "eda_nulls_top10": _on_master(eda.nulls_top),
        "eda_duplicates": _on_master(eda.duplicates),
        "eda_hist": _on_master(lambda m: eda.histogram(m, ["age", "duration_of_stay"])),
        "eda_kde_age": kde("age"),
        "eda_kde_los": kde("duration_of_stay"),
        "eda_kde_los_by_outcome": kde("duration_of_stay", "outcome"),
        "eda_box_los_by_age": _on_master(lambda m: eda.box_stats(m, "duration_of_stay", "age_bucket")),
        "eda_corr": _on_master(lambda m: round_cols(eda.correlation_matrix(m), ["corr"])),
        "eda_counts": _on_master(lambda m: eda.category_counts(
            m, ["gender", "type_of_admissionemergencyopd", "outcome"])),
        "eda_readmits": _on_master(eda.repeat_patients),
    }


def stats_queries() -> dict[str, Query]:
    q: dict[str, Query] = {}
    names = ["l01_htn_vs_outcome_chi2", "l02_los_by_gender_ttest", "l03_los_by_ckd_ttest",
             "l04_los_by_age_bucket_anova", "l05_admission_type_vs_outcome_chi2", "l06_los_vs_age_pearson",
             "l10_los_by_gender_levene", "l12_los_by_ckd_mannwhitney", "l13_los_by_age_bucket_kruskal",
             "l14_smoking_by_death_prop_z", "l15_dm_vs_outcome_chi2", "l16_glucose_by_death_ttest",
             "l17_platelets_by_age_bucket_anova", "l18_gender_vs_outcome_chi2", "l19_bnp_vs_los_spearman",
             "l20_los_by_shock_ttest", "l21_icu_stay_by_death_ttest", "l22_af_vs_outcome_chi2",
             "l23_age_bucket_vs_ckd_chi2", "l24_hfref_vs_outcome_chi2", "l25_stemi_vs_outcome_chi2"]

    def one(key):
        def run(spark, sf):
            r = H.battery(load_master(spark, sf))[key]()
            return round_cols(r, [c for c in ("statistic", "z") if c in r.columns])
        return run
    for k in names:
        q[k] = one(k)

    def direct(key):
        return lambda spark, sf: H.direct_tests(load_master(spark, sf))[key]()
    for k in ("l08_los_shapiro", "l09_age_shapiro"):
        q[k] = direct(k)
    q["l11_los_ks_normal"] = lambda spark, sf: round_cols(H.direct_tests(load_master(spark, sf))["l11_los_ks_normal"](), ["statistic", "p_direct"])
    q["l00_all_tests"] = lambda spark, sf: H.all_tests(load_master(spark, sf))
    return q


def ml_queries() -> dict[str, Query]:
    def feats_of(spark, sf):
        # iterative training reads its input many times: materialise once
        return cut_lineage(M.ml_features(load_master(spark, sf)))

    def mortality(spark, sf):
        feats = feats_of(spark, sf)
        model, split = M.train_mortality(feats)
        return M.score_mortality(model, split).select("sno", "mrd_no", "mortality_flag", "is_test",
                                                      "mortality_risk_score", "mortality_risk_flag")

    def los(spark, sf):
        feats = feats_of(spark, sf)
        model, split = M.train_los(feats)
        return M.score_los(model, split).select("sno", "mrd_no", "duration_of_stay", "is_test",
                                                "predicted_los", "los_risk_flag")

    def eval_cls(spark, sf):
        feats = feats_of(spark, sf)
        model, split = M.train_mortality(feats)
        return M.eval_classifier(M.score_mortality(model, split.where("is_test")))

    def eval_reg(spark, sf):
        feats = feats_of(spark, sf)
        model, split = M.train_los(feats)
        return M.eval_regressor(M.score_los(model, split.where("is_test")))

    def export(spark, sf):
        path = _scratch(spark, "predictions")
        files.write_parquet(M.export_predictions(M.predictions(load_master(spark, sf))[0]), path)
        return spark.read.parquet(path)

    def flags(spark, sf):
        return M.risk_flags(load_master(spark, sf)).select(*M.RISK_OUTPUT)

    def dept(spark, sf):
        return M.department_flags(M.risk_flags(load_master(spark, sf)))

    def by_rule(finish, source=M.ml_features):
        """The evaluation and the flags on scores of a fixed rule, which any engine computes alike."""
        return lambda spark, sf: finish(cut_lineage(M.rule_scores(source(load_master(spark, sf)))))

    return {"m1_ml_features": lambda s, sf: M.ml_features(load_master(s, sf)),
            "m4_eval_cls_of_rule": by_rule(lambda d: round_cols(M.eval_classifier(d.where("is_test")), ["value"])),
            "m5_eval_reg_of_rule": by_rule(lambda d: round_cols(M.eval_regressor(d.where("is_test")), ["mae", "rmse", "r2"])),
            "o3_risk_flags_of_rule": by_rule(lambda d: round_cols(M.flagged(d).select("sno", *M.RISK_OUTPUT), ["predicted_mortality_prob", "predicted_los"]),
                                             M.risk_features),
            "o4_dept_flags_of_rule": by_rule(lambda d: round_cols(M.department_flags(M.flagged(d)), ["avg_predicted_los"]), M.risk_features),
            "m2_ml_mortality": mortality, "m3_ml_los": los, "m4_ml_eval_cls": eval_cls,
            "m5_ml_eval_reg": eval_reg, "m6_ml_export": export,
            "o1_risk_features": lambda s, sf: M.risk_features(load_master(s, sf)),
            "o3_risk_flags": flags, "o4_dept_flags": dept}


def similarity_queries() -> dict[str, Query]:
    def feats(spark, sf):
        return R.sim_features(stored_fact(spark, sf))

    def topk(spark, sf):
        d = cut_lineage(feats(spark, sf))  # read by 3 scalar subqueries and the scan
        return round_cols(R.top_similar(d, R.first_admission_of(d)), ["score"])

    def rec(spark, sf):
        d = cut_lineage(feats(spark, sf))
        return round_cols(R.recommend(d, R.first_admission_of(d)), ["score"])

    def of_patient(spark, sf):
        d = cut_lineage(feats(spark, sf))
        return round_cols(R.top_similar(d, R.first_admission_of(d, "40")), ["score"])

    return {"r1_sim_features": feats, "r3_sim_topk": topk, "r3_sim_topk_of_patient": of_patient,
            "r4_neighbour_lists": lambda s, sf: round_cols(R.neighbour_lists(cut_lineage(feats(s, sf))), ["score"]),
            "r5_interventions": lambda s, sf: R.suggestions(feats(s, sf)), "r6_recommend": rec}


def forecast_queries() -> dict[str, Query]:
    def series(spark, sf):
        return FC.monthly_series(stored_fact(spark, sf))

    def long(spark, sf):
        return FC.trend_data(series(spark, sf))

    def fc(model):
        return lambda spark, sf: FC.forecast(long(spark, sf), model)

    return {"p1_monthly_series": lambda s, sf: round_cols(series(s, sf), ["avg_los"]),
            "p2_trend_data": lambda s, sf: round_cols(long(s, sf), ["value"]),
            "p3_forecast_sarima": fc("sarima"), "p4_forecast_additive": lambda s, sf: round_cols(fc("additive")(s, sf), ["yhat", "yhat_lower", "yhat_upper"]),
            "p5_forecast_eval": lambda s, sf: round_cols(FC.forecast_eval(FC.fitted_values(long(s, sf))), ["mae", "rmse"]),
            "p6_forecast_all": lambda s, sf: FC.forecast(long(s, sf), "sarima").unionByName(
                FC.forecast(long(s, sf), "additive"))}


def streaming_queries() -> dict[str, Query]:
    def stream(spark, sf):
        """Write the fact as files, stream them through the alert job, read
        the alerts table back (must equal the batch alerts)."""
        root = _scratch(spark, "los-alert")
        files.write_parquet(stored_fact(spark, sf).repartition(4), f"{root}/incoming")
        J.run_stream(spark, f"{root}/incoming", f"{root}/fact", f"{root}/alerts", f"{root}/_checkpoint")
        return spark.read.parquet(f"{root}/alerts").drop("batch_id")

    return {"j1_los_alerts": lambda s, sf: J.alerts(stored_fact(s, sf)), "j1_los_alerts_stream": stream}


def explain_queries() -> dict[str, Query]:
    def phi(spark, sf):
        feats = cut_lineage(M.ml_features(load_master(spark, sf)))
        model, _ = M.train_mortality(feats)
        gbt = model.stages[-1]  # the classifier; the vector is built by the explainer
        return N.shapley_values(gbt, feats, M.FEATURES, "sno", permutations=8)

    def phi_los(spark, sf):
        feats = cut_lineage(M.ml_features(load_master(spark, sf)))
        model, _ = M.train_los(feats)
        return N.shapley_values(model.stages[-1], feats, M.FEATURES, "sno", permutations=8, output="prediction")

    def rule(spark, sf):
        """Attributions of a linear rule, which are exact: weight times distance from the mean."""
        feats = cut_lineage(M.ml_features(load_master(spark, sf)))
        return round_cols(N.shap_summary(N.shapley_values(M.RuleModel(), feats, M.FEATURES, "sno", permutations=2, output="prediction")),
                          ["mean_abs_phi"]).drop("mean_phi")

    def lime(which):
        def run(spark, sf):
            feats = cut_lineage(M.ml_features(load_master(spark, sf)))
            if which == "mortality":
                model, _ = M.train_mortality(feats)
                row, out = 5, "probability"
            else:
                model, _ = M.train_los(feats)
                row, out = 10, "prediction"
            # the explained admission: position ``row`` (0-based) in admission order
            target = feats.orderBy("sno").limit(row + 1).agg(F.max("sno")).scalar()
            inst = feats.where(F.col("sno") == target)
            return N.local_surrogate(model.stages[-1], feats, inst, M.FEATURES, "sno", output=out)
        return run

    return {"n1_shap_values": phi, "n4_lime_mortality": lime("mortality"), "n4_lime_los": lime("los"),
            "n1_shap_values_los": phi_los, "n2_shap_summary_los": lambda s, sf: N.shap_summary(phi_los(s, sf)), "n2_shap_summary_of_rule": rule,
            "n2_shap_summary": lambda s, sf: N.shap_summary(phi(s, sf)),
            "n3_shap_dependence": lambda s, sf: N.shap_dependence(phi(s, sf), "urea")}


def kpi_queries() -> dict[str, Query]:
    return {"x1_kpi_cube": _on_fact(X.kpi_cube),
            "x2_seasonal_index": _on_fact(X.seasonal_index,
                                          lambda d: round_cols(d, ["avg_admissions", "seasonal_index"])),
            "x3_pollution_corr": _on_fact(X.pollution_correlation,
                                          lambda d: round_cols(d, ["corr_pm25_admissions"]))}


def _shipped(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        tune_session(spark)
        return fn(spark, sf_dir)
    run.__name__ = getattr(fn, "__name__", "query")
    run.__doc__ = fn.__doc__
    return run


def all_queries() -> dict[str, Query]:
    q = mart_queries()
    q.update(warehouse_queries())
    q.update(load_queries())
    q.update(eda_queries())
    q.update(stats_queries())
    q.update(ml_queries())
    q.update(similarity_queries())
    q.update(forecast_queries())
    q.update(streaming_queries())
    q.update(kpi_queries())
    q.update(explain_queries())
    return {k: _shipped(v) for k, v in q.items()}
