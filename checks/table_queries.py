"""Queries over sources, splits, sampling and fault injection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import sqlparts as sp
from checks.registry import query, rounded, rounded_where
from checks.sqlparts import DETAILED, DF, OF, ORDERS24, RUNS, h, u, with_
from tidyorder.operators import faults, sampling
from tidyorder.session import materialize, scratch_path
from tidyorder.sources import loaders
from tidyorder.sources import tables as t

SEED = 42
NUM = ["x_total", "x_qty", "x_price", "x_disc", "x_tax"]
CAT = ["c_prio", "c_seg"]
ALL = NUM + CAT


def features(spark: SparkSession, d: str) -> DataFrame:
    return materialize(t.order_features(spark, d))


# --------------------------------------------------------------------------- sources
def _numeric_orders(spark, d):
    return t.table(spark, d, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", (F.col("o_orderstatus") == "F").cast("int").alias("Outcome"))


@query("s01_csv_without_header", "SELECT CAST(o_orderkey AS DOUBLE) AS x_c0, CAST(o_custkey AS DOUBLE) AS x_c1, o_totalprice AS x_c2, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label FROM orders")
def _s01(spark, d):
    path = scratch_path(spark, "plain-csv")
    _numeric_orders(spark, d).write.csv(path, header=False)
    return loaders.read_numeric_csv(spark, path)


@query("s01_csv_with_header", "SELECT CAST(o_orderkey AS DOUBLE) AS x_o_orderkey, CAST(o_custkey AS DOUBLE) AS x_o_custkey, o_totalprice AS x_o_totalprice, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label FROM orders")
def _s01_header(spark, d):
    path = scratch_path(spark, "named-csv")
    _numeric_orders(spark, d).write.csv(path, header=True)
    return loaders.read_numeric_csv(spark, path)


_CUSTOMER_TEXT = "SELECT CAST(c_custkey AS VARCHAR) AS custkey, NULLIF(c_mktsegment, 'BUILDING') AS segment, CAST(c_nationkey AS VARCHAR) AS nation FROM customer"


def _named(spark, d):
    path = scratch_path(spark, "token-csv")
    segment = F.when(F.col("c_mktsegment") == "BUILDING", "?").otherwise(F.col("c_mktsegment"))
    t.table(spark, d, "customer").select(F.concat_ws(", ", F.col("c_custkey").cast("string"), segment, F.col("c_nationkey").cast("string"))).write.text(path)
    return loaders.read_named_csv(spark, path, ["custkey", "segment", "nation"])


@query("s02_csv_with_null_token", _CUSTOMER_TEXT)
def _s02(spark, d):
    return _named(spark, d)


@query("s03_drop_null_rows", f"SELECT * FROM ({_CUSTOMER_TEXT}) WHERE segment IS NOT NULL")
def _s03(spark, d):
    return _named(spark, d).na.drop("any")


@query("s04_binary_target", "SELECT o_orderkey AS row_id, CASE WHEN trim(' ' || o_orderstatus || ' ') = 'F' THEN 1 ELSE 0 END AS label FROM orders")
def _s04(spark, d):
    padded = F.concat(F.lit(" "), "o_orderstatus", F.lit(" "))
    return t.table(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), loaders.binarise(padded, "F").alias("label"))


@query("s05_category_codes", with_(OF, "SELECT row_id, c_prio, c_seg FROM order_features"))
def _s05(spark, d):
    return t.order_features(spark, d).select("row_id", *CAT)


@query("s06_target_codes", "SELECT c_custkey AS row_id, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INTEGER) AS label, CAST(c_nationkey AS DOUBLE) AS x_c_nationkey, c_acctbal AS x_c_acctbal FROM customer")
def _s06(spark, d):
    spec = loaders.TableSpec("c_custkey", target="c_mktsegment", drop=("c_name",), text_target=True)
    return loaders.to_features(t.table(spark, d, "customer"), spec)


@query("s07_target_by_pattern", "SELECT o_orderkey AS row_id, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label, o_totalprice AS x_o_totalprice, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS c_o_orderpriority FROM orders")
def _s07(spark, d):
    flagged = t.table(spark, d, "orders").select(
        "o_orderkey", "o_custkey", (F.col("o_orderstatus") == "F").cast("int").alias("Default_Flag"), "o_totalprice", "o_orderpriority")
    return loaders.to_features(flagged, loaders.TableSpec("o_orderkey", drop=("o_custkey",)))


@query("s08_nominal_columns", "SELECT c_custkey AS row_id, CAST(c_acctbal > 0 AS INTEGER) AS label, c_nationkey AS c_c_nationkey, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INTEGER) AS c_c_mktsegment FROM customer")
def _s08(spark, d):
    base = t.table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", (F.col("c_acctbal") > 0).cast("int").alias("good"))
    return loaders.to_features(base, loaders.TableSpec("c_custkey", target="good", nominal=("C_NATIONKEY",)))


@query("s09_generic_table", "SELECT c_custkey AS row_id, c_acctbal AS x_c_acctbal, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INTEGER) AS c_c_mktsegment, CAST(dense_rank() OVER (ORDER BY CASE WHEN c_nationkey < 10 THEN 'low' ELSE 'high' END) - 1 AS INTEGER) AS label FROM customer")
def _s09(spark, d):
    base = t.table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment", F.when(F.col("c_nationkey") < 10, "low").otherwise("high").alias("band"))
    return loaders.to_features(base, loaders.TableSpec("c_custkey", text_target=True))


def registry() -> loaders.Registry:
    known = loaders.Registry()
    known.register("order_features", t.order_features)
    known.register("doc_features", t.doc_features)
    known.register("vec_features", t.vec_features)
    return known


_PROFILES = {"order_features": ALL, "doc_features": ["x_chars", "x_spaces", "x_digits", "c_lang"], "vec_features": sp.VECS}


def _profile_sql(name: str) -> str:
    cells = _PROFILES[name]
    nulls = " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in cells)
    return f"""SELECT '{name}' AS dataset, count(*) AS n_rows, {len(cells)} AS n_features, round(greatest(sum(label), sum(1 - label)) / least(sum(label), sum(1 - label)), 6) AS imbalance_ratio,
    round(100 * least(sum(label), sum(1 - label)) / count(*), 6) AS minority_pct, round(100 * ({nulls}) / (count(*) * {len(cells)}), 6) AS missing_pct FROM {name}"""


@query("s10_dataset_registry", with_(OF, DF, sp.VF, " UNION ALL ".join(_profile_sql(n) for n in _PROFILES)))
def _s10(spark, d):
    out = None
    for name in _PROFILES:
        one = loaders.profile(registry().load(name, spark, d)).select(F.lit(name).alias("dataset"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@query("s15_dataset_profile", with_(OF, _profile_sql("order_features")))
def _s15(spark, d):
    return loaders.profile(t.order_features(spark, d)).select(F.lit("order_features").alias("dataset"), "*")


def _stored_runs(spark, d) -> str:
    path = scratch_path(spark, "results")
    runs = t.runs_detailed(spark, d).withColumn("code_id", F.when(F.col("dataset") == "ds3", "b2").otherwise("a1"))
    loaders.write_results(runs.withColumn("stage", F.lit("main")), path)
    loaders.write_results(runs.where("dataset = 'ds1'").withColumn("stage", F.lit("clean")), path)
    return path


@query("s11_read_stage", with_(ORDERS24, DETAILED, "SELECT dataset, classifier, seed, cleaning_order, balanced_accuracy FROM detailed WHERE NOT failed"))
def _s11(spark, d):
    stage = loaders.read_stage(spark, _stored_runs(spark, d), "main")
    return loaders.drop_failed(stage).select("dataset", "classifier", "seed", "cleaning_order", "balanced_accuracy")


@query("s11_failed_counts", with_(ORDERS24, DETAILED, "SELECT dataset, count(*) AS n_rows, count(*) FILTER (WHERE failed) AS n_failed FROM detailed GROUP BY 1"))
def _s11_failed(spark, d):
    return loaders.failed_counts(loaders.read_stage(spark, _stored_runs(spark, d), "main"), ["dataset"])


@query("s12_result_write", with_(
    ORDERS24, DETAILED, "SELECT stage, dataset, seed, count(*) AS n_rows, round(sum(balanced_accuracy), 6) AS total FROM (SELECT 'main' AS stage, * FROM detailed UNION ALL SELECT 'clean', * FROM detailed WHERE dataset = 'ds1') GROUP BY 1, 2, 3"))
def _s12(spark, d):
    stored = spark.read.parquet(_stored_runs(spark, d))
    return stored.groupBy("stage", "dataset", "seed").agg(F.count("*").alias("n_rows"), F.round(F.sum("balanced_accuracy"), 6).alias("total"))


@query("s13_open_tasks", with_(
    ORDERS24, RUNS, "SELECT DISTINCT dataset, seed FROM runs WHERE NOT (dataset IN ('ds1', 'ds2', 'ds3') AND seed < 44 AND dataset <> 'ds3')"))
def _s13(spark, d):
    runs = materialize(t.runs(spark, d).withColumn("code_id", F.when(F.col("dataset") == "ds3", "b2").otherwise("a1")))
    finished = runs.where("dataset in ('ds1', 'ds2', 'ds3') and seed < 44")
    return loaders.open_tasks(runs.select("dataset", "seed").distinct(), finished, "a1", ["dataset", "seed"])


@query("s13_part_checks", with_(
    ORDERS24, DETAILED, "SELECT dataset, seed, count(*) FILTER (WHERE NOT failed) AS n_rows FROM detailed GROUP BY 1, 2 HAVING count(*) FILTER (WHERE NOT failed) <> 72"))
def _s13_parts(spark, d):
    return loaders.incomplete_parts(t.runs_detailed(spark, d).where("not failed"), ["dataset", "seed"], 72)


@query("s13_mixed_code", with_(ORDERS24, RUNS, "SELECT dataset, count(DISTINCT CASE WHEN dataset = 'ds3' AND seed < 44 THEN 'b2' ELSE 'a1' END) AS n_codes FROM runs GROUP BY 1 HAVING count(DISTINCT CASE WHEN dataset = 'ds3' AND seed < 44 THEN 'b2' ELSE 'a1' END) > 1"))
def _s13_mixed(spark, d):
    coded = t.runs(spark, d).withColumn("code_id", F.when((F.col("dataset") == "ds3") & (F.col("seed") < 44), "b2").otherwise("a1"))
    return loaders.mixed_code_parts(coded, ["dataset"])


@query("s14_rounded_export", "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, round(round_even(o_totalprice * pow(10.0, 3 - floor(log10(o_totalprice))), 0) / pow(10.0, 3 - floor(log10(o_totalprice))), 6) AS price FROM orders")
def _s14(spark, d):
    path = scratch_path(spark, "rounded-csv")
    loaders.write_rounded_csv(t.table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("price")), path, digits=4)
    back = spark.read.csv(path, header=True)
    return back.select("o_orderkey", F.round(F.col("price").cast("double"), 6).alias("price"))


# ------------------------------------------------------------------ splits and samples
_SPLIT = f"""cls AS (SELECT label, count(*) AS c, sum(count(*)) OVER () AS n FROM order_features GROUP BY label),
q0 AS (SELECT label, CAST(floor(ceil(n * 0.2) * c / n) AS BIGINT) AS k, ceil(n * 0.2) AS total,
    row_number() OVER (ORDER BY round(ceil(n * 0.2) * c / n - floor(ceil(n * 0.2) * c / n), 9) DESC, label) AS rn FROM cls),
quota AS (SELECT label, k + CASE WHEN rn <= total - sum(k) OVER () THEN 1 ELSE 0 END AS k FROM q0),
split AS (SELECT f.*, row_number() OVER (PARTITION BY label ORDER BY {h(SEED, 'label', 'row_id')}, row_id) <= k AS is_test FROM order_features f JOIN quota USING (label))"""


@query("p01_stratified_split", with_(OF, _SPLIT, "SELECT row_id, label, is_test FROM split"))
def _p01(spark, d):
    return sampling.stratified_split(features(spark, d), SEED).select("row_id", "label", "is_test")


@query("p02_stratified_folds", with_(OF, f"SELECT row_id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY {h(SEED, chr(39) + 'fold' + chr(39), 'row_id')}, row_id) - 1) % 5 AS INTEGER) AS fold FROM order_features"))
def _p02(spark, d):
    return sampling.stratified_folds(features(spark, d), SEED).select("row_id", "label", "fold")


@query("p03_sample_without_replacement", f"SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY {h(SEED, 'event_id')}, event_id) AS rn, count(*) OVER () AS n FROM events) WHERE rn <= floor(n * 0.1)")
def _p03(spark, d):
    events = t.table(spark, d, "events").select("event_id")
    return sampling.sample_without_replacement(events, "event_id", SEED, F.floor(F.col("n") * 0.1))


@query("p03_sample_within_groups", f"SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY {h(SEED, 'event_id')}, event_id) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE rn <= floor(n * 0.05)")
def _p03_groups(spark, d):
    events = t.table(spark, d, "events").select("event_type", "event_id")
    return sampling.sample_without_replacement(events, "event_id", SEED, F.floor(F.col("n") * 0.05), ["event_type"])


@query("p04_sample_with_replacement", with_(
    OF, f"ranked AS (SELECT row_id, row_number() OVER (ORDER BY {h(SEED, chr(39) + 'base' + chr(39), 'row_id')}, row_id) AS r, count(*) OVER () AS n FROM order_features)",
    f"picks AS (SELECT draw, 1 + CAST(floor({u(SEED, chr(39) + 'pick' + chr(39), 'draw')} * (SELECT max(n) FROM ranked)) AS BIGINT) AS r FROM range(1, (SELECT max(n) // 3 + 1 FROM ranked)) t(draw))",
    "SELECT draw, row_id FROM picks JOIN ranked USING (r)"))
def _p04(spark, d):
    base = features(spark, d).select("row_id")
    n = base.count()
    return sampling.sample_with_replacement(base, "row_id", SEED, n // 3, n).select("draw", "row_id")


@query("p05_bootstrap_slots", with_(
    f"sizes AS (SELECT event_type, count(DISTINCT user_id) AS size FROM events GROUP BY 1)",
    f"SELECT event_type, boot, slot, CAST(floor({u(SEED, 'event_type', 'boot', 'slot')} * size) AS BIGINT) AS pick FROM sizes CROSS JOIN range(1, 11) b(boot) CROSS JOIN LATERAL (SELECT unnest(range(1, size + 1)) AS slot)"))
def _p05(spark, d):
    sizes = t.table(spark, d, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("size"))
    return sampling.bootstrap_slots(sizes, ["event_type"], "size", 10, SEED)


# ------------------------------------------------------------------------------ faults
def _rank_h(purpose: str, part: str = "", seed: int = SEED, *more: str) -> str:
    keys = ", ".join(f"'{m}'" for m in (purpose, *more))
    return f"row_number() OVER ({part} ORDER BY md5(concat_ws('|', '{seed}', {keys}, row_id)), row_id)"


def flips_sql(kind: str, source: str = "order_features", out: str = "flipped", rate: float = 0.15, seed: int = SEED) -> str:
    """Label flips with exact counts per class."""
    if kind == "symmetric":
        hit = f"{_rank_h('label', '', seed)} <= floor((SELECT n FROM {out}_k) * {rate})"
    else:
        hit = f"{_rank_h('label', 'PARTITION BY label', seed)} <= CASE WHEN label = (SELECT minority FROM {out}_k) THEN (SELECT k_min FROM {out}_k) ELSE (SELECT k_maj FROM {out}_k) END"
    k_min, k_maj = {
        "asymmetric": (f"least(floor(floor(n * {rate}) * 0.7), n_min)", f"least(floor(n * {rate}) - least(floor(floor(n * {rate}) * 0.7), n_min), n_maj)"),
        "minority_anchored": (f"floor(n_min * {rate})", f"least(floor(n_min * {rate}), n_maj)"),
        "symmetric": ("0", "0"),
    }[kind]
    return f"""{out}_c AS (SELECT count(*) AS n, CASE WHEN sum(label) <= sum(1 - label) THEN 1 ELSE 0 END AS minority,
    least(sum(label), sum(1 - label)) AS n_min, greatest(sum(label), sum(1 - label)) AS n_maj FROM {source}),
{out}_k AS (SELECT *, {k_min} AS k_min, {k_maj} AS k_maj FROM {out}_c),
{out} AS (SELECT * EXCLUDE (label, hit), CASE WHEN hit THEN 1 - label ELSE label END AS label, hit AS f_label FROM (SELECT *, {hit} AS hit FROM {source}))"""


def missing_sql(mechanism: str, source: str, out: str = "gappy", features: list[str] = ALL, rate: float = 0.1, seed: int = SEED) -> str:
    """Cells nulled feature by feature, each step reading the result of the one before."""
    chosen = sp.keyed_names(features, seed, "feature")[: max(1, len(features) // 2)]
    ctes, at = [], source
    for i, f in enumerate(chosen):
        if mechanism == "MCAR":
            gone = f"{_rank_h('mcar', '', seed, f)} <= floor((SELECT count(*) FROM {source}) * {rate})"
        else:
            cond = sp.keyed_names([x for x in features if x != f], seed, "cond", f)[0]
            gone = f"coalesce({cond} > (SELECT quantile_cont({cond}, {1 - rate}) FROM {at}), false)"
        ctes.append(f"{out}_{i} AS (SELECT * REPLACE (CASE WHEN NOT gone_{f} THEN {f} END AS {f}) FROM (SELECT *, {gone} AS gone_{f} FROM {at}))")
        at = f"{out}_{i}"
    names = "concat_ws(',', " + ", ".join(f"CASE WHEN gone_{f} THEN '{f}' END" for f in sorted(chosen)) + ")"
    ctes.append(f"{out} AS (SELECT * EXCLUDE ({', '.join('gone_' + f for f in chosen)}), {names} AS f_missing FROM {at})")
    return ",\n".join(ctes)


def outliers_sql(source: str, out: str = "extreme", num: list[str] = NUM, rate: float = 0.05, seed: int = SEED) -> str:
    moved = ", ".join(
        f"CASE WHEN f_outlier THEN (SELECT avg({c}) FROM {source}) + CASE WHEN {u(seed, chr(39) + 'sign' + chr(39), chr(39) + c + chr(39), 'row_id')} > 0.5 THEN 1.0 ELSE -1.0 END"
        f" * (3.5 + {u(seed, chr(39) + 'size' + chr(39), chr(39) + c + chr(39), 'row_id')}) * (SELECT CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END FROM {source}) ELSE {c} END AS {c}" for c in num)
    return f"{out} AS (SELECT * REPLACE ({moved}) FROM (SELECT *, {_rank_h('outlier', '', seed)} <= floor((SELECT count(*) FROM {source}) * {rate}) AS f_outlier FROM {source}))"


def _cells(digits: int = 6) -> str:
    return ", ".join([f"round({c}, {digits}) + 0.0 AS {c}" for c in NUM] + CAT)


_MOVED = ", ".join([f"CASE WHEN f_outlier THEN round({c}, 4) ELSE round({c}, 6) END + 0.0 AS {c}" for c in NUM] + CAT)

for _kind in ("symmetric", "asymmetric", "minority_anchored"):
    def _flip(spark, d, kind=_kind):
        return faults.flip_labels(features(spark, d), SEED, faults.LabelNoise(kind=kind)).select("row_id", "label", "f_label")

    query(f"f0{('symmetric', 'asymmetric', 'minority_anchored').index(_kind) + 1}_label_noise_{_kind}",
          with_(OF, flips_sql(_kind), "SELECT row_id, label, f_label FROM flipped"))(_flip)

for _mechanism in ("MCAR", "MAR"):
    def _drop(spark, d, mechanism=_mechanism):
        out = faults.drop_cells(features(spark, d), SEED, faults.Missing(mechanism=mechanism))
        return rounded(out.select("row_id", *ALL, F.concat_ws(",", "f_missing").alias("f_missing")), 6)

    query(f"f0{6 + ('MCAR', 'MAR').index(_mechanism)}_missing_{_mechanism.lower()}",
          with_(OF, missing_sql(_mechanism, "order_features"), f"SELECT row_id, {_cells()}, f_missing FROM gappy"))(_drop)


@query("f08_outliers", with_(OF, outliers_sql("order_features"), f"SELECT row_id, {_MOVED}, f_outlier FROM extreme"))
def _f08(spark, d):
    return rounded_where(faults.make_outliers(features(spark, d), SEED).select("row_id", *ALL, "f_outlier"), "f_outlier")


INJECTED = [OF, flips_sql("asymmetric"), missing_sql("MAR", "flipped"), outliers_sql("gappy")]


@query("f09_all_faults", with_(*INJECTED, f"SELECT row_id, label, {_MOVED}, f_label, f_missing, f_outlier FROM extreme"))
def _f09(spark, d):
    out = faults.inject(features(spark, d), SEED)
    out = out.select("row_id", "label", *ALL, "f_label", F.concat_ws(",", "f_missing").alias("f_missing"), "f_outlier")
    return rounded_where(out, "f_outlier")


def _audit_sql(source: str) -> str:
    nulls = " + ".join(f"CASE WHEN s.{c} IS NULL THEN 1 ELSE 0 END" for c in ALL)
    return f"""SELECT count(*) AS n_train, round(avg(CASE WHEN c.label = m THEN 1.0 ELSE 0.0 END), 8) AS minority_share,
    round(avg(CASE WHEN c.label <> s.label THEN 1.0 ELSE 0.0 END), 8) AS labels_flipped,
    round(avg(CASE WHEN c.label <> s.label THEN 1.0 ELSE 0.0 END) FILTER (WHERE c.label = m), 8) AS minority_labels_flipped,
    round(sum({nulls}) / (count(*) * {len(ALL)}.0), 8) AS missing_cells,
    avg(CASE WHEN c.label <> s.label THEN 1.0 ELSE 0.0 END) FILTER (WHERE c.label = m) > 0.5 AS saturated
  FROM order_features c JOIN {source} s USING (row_id) CROSS JOIN (SELECT CASE WHEN sum(label) <= sum(1 - label) THEN 1 ELSE 0 END AS m FROM order_features)"""


@query("f11_fault_audit", with_(*INJECTED, _audit_sql("extreme")))
def _f11(spark, d):
    clean = features(spark, d)
    return faults.audit(clean, faults.inject(clean, SEED))


@query("f12_mean_audit", with_(
    OF, flips_sql("asymmetric", out="fa", seed=42), flips_sql("minority_anchored", out="fb", seed=43), flips_sql("symmetric", out="fc", seed=44),
    "audits AS (" + " UNION ALL ".join(_audit_sql(x) for x in ("fa", "fb", "fc")) + ")",
    "SELECT 'order_features' AS dataset, round(avg(n_train), 8) AS n_train, round(avg(minority_share), 8) AS minority_share, round(avg(labels_flipped), 8) AS labels_flipped, round(avg(minority_labels_flipped), 8) AS minority_labels_flipped, round(avg(missing_cells), 8) AS missing_cells FROM audits"))
def _f12(spark, d):
    clean, out = features(spark, d), None
    for seed, kind in ((42, "asymmetric"), (43, "minority_anchored"), (44, "symmetric")):
        one = faults.audit(clean, faults.flip_labels(clean, seed, faults.LabelNoise(kind=kind)))
        out = one if out is None else out.unionByName(one)
    return faults.mean_audit(out.withColumn("dataset", F.lit("order_features")))
