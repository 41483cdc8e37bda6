"""Experiment grid: orders, conditions, tasks, and evaluation into the run table."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidyorder.functions.steps import ARROW, EMPTY_ORDER, STEP_CODES, n_steps
from tidyorder.operators.faults import FaultPlan, LabelNoise, inject
from tidyorder.operators.models import CLASSIFIERS, Fit, eligible, train_and_evaluate
from tidyorder.operators.sampling import stratified_split
from tidyorder.plans.sequence import MethodSet, order_name, walk_orders
from tidyorder.session import materialize
from tidyorder.sources.loaders import nan_to_null, require_binary

SEEDS = (42, 43, 44, 45, 46)

# Fixed names of the study's datasets, small to large, and the groups its conditions use.
MAIN_DATASETS = (
    "pima", "breast_cancer", "ionosphere", "banknote", "credit_g",
    "qsar_biodeg", "spambase", "telescope", "adult", "credit_default",
)
HIGH_IMBALANCE = ("ozone", "kc1")
SUBSET_DATASETS = MAIN_DATASETS[:7]


@dataclass(frozen=True)
class Condition:
    """One experimental condition."""

    sequences: str = "all"
    faults: FaultPlan | None = FaultPlan()
    methods: MethodSet = MethodSet()
    datasets: tuple[str, ...] = MAIN_DATASETS
    seeds: tuple[int, ...] = SEEDS


def _noise(**changes) -> FaultPlan:
    return FaultPlan(labels=replace(LabelNoise(), **changes))


CONDITIONS = {
    "main": Condition(),
    "clean": Condition(faults=None, datasets=MAIN_DATASETS + HIGH_IMBALANCE),
    "subsets": Condition(sequences="subsets", datasets=SUBSET_DATASETS),
    "methods_b": Condition(methods=MethodSet("B")),
    "high_ir": Condition(faults=_noise(kind="minority_anchored"), datasets=HIGH_IMBALANCE),
    "smote_050": Condition(methods=MethodSet(ratio=0.5), datasets=SUBSET_DATASETS),
    "smote_100": Condition(methods=MethodSet(ratio=1.0), datasets=SUBSET_DATASETS),
    "noise_05": Condition(faults=_noise(rate=0.05), datasets=SUBSET_DATASETS),
    "noise_10": Condition(faults=_noise(rate=0.10), datasets=SUBSET_DATASETS),
    "noise_20": Condition(faults=_noise(rate=0.20), datasets=SUBSET_DATASETS),
    "noise_sym": Condition(faults=_noise(kind="symmetric"), datasets=SUBSET_DATASETS),
    "seeds20": Condition(datasets=SUBSET_DATASETS, seeds=tuple(range(42, 62))),
}


# ------------------------------------------------------------------------- orders
def orders_of_length(spark: SparkSession, length: int) -> DataFrame:
    """All orders of `length` distinct steps (the step table has four rows)."""
    codes = spark.createDataFrame([(c,) for c in STEP_CODES], "code string")
    out = spark.createDataFrame([([],)], "steps array<string>")
    for _ in range(length):
        grown = out.join(F.broadcast(codes), ~F.array_contains("steps", F.col("code")))
        out = grown.select(F.array_append("steps", F.col("code")).alias("steps"))
    name = F.when(F.size("steps") == 0, EMPTY_ORDER).otherwise(F.array_join("steps", ARROW))
    return out.select(name.alias("cleaning_order"), F.size("steps").alias("seq_len"))


def orders(spark: SparkSession, kind: str) -> DataFrame:
    """`all`: the 24 full orders; `subsets`: the 41 ordered subsets of up to three steps."""
    if kind == "all":
        return orders_of_length(spark, len(STEP_CODES))
    out = orders_of_length(spark, 0)
    for length in range(1, len(STEP_CODES)):
        out = out.unionByName(orders_of_length(spark, length))
    return out


def task_grid(spark: SparkSession, datasets: DataFrame | None = None) -> DataFrame:
    """One row per run: (stage, dataset, seed, cleaning_order, seq_len, classifier).

    `datasets` (stage, dataset) replaces the study's own lists. The dimension tables are
    fixed lists of a few rows, so their product is the grid itself.
    """
    stages = spark.createDataFrame([(s, c.sequences) for s, c in CONDITIONS.items()], "stage string, kind string")
    seeds = spark.createDataFrame([(s, x) for s, c in CONDITIONS.items() for x in c.seeds], "stage string, seed int")
    if datasets is None:
        datasets = spark.createDataFrame([(s, d) for s, c in CONDITIONS.items() for d in c.datasets], "stage string, dataset string")
    kinds = orders(spark, "all").withColumn("kind", F.lit("all")).unionByName(
        orders(spark, "subsets").withColumn("kind", F.lit("subsets"))
    )
    learners = spark.createDataFrame([(c,) for c in CLASSIFIERS], "classifier string")
    grid = datasets.join(F.broadcast(stages), "stage").join(F.broadcast(seeds), "stage").join(F.broadcast(kinds), "kind")
    return grid.join(F.broadcast(learners), eligible(F.col("cleaning_order"), F.col("classifier"))).select(
        "stage", "dataset", "seed", "cleaning_order", "seq_len", "classifier"
    )


def expected_rows(grid: DataFrame) -> DataFrame:
    return grid.groupBy("stage").agg(
        F.count("*").alias("n_runs"), F.countDistinct("dataset").alias("n_datasets"),
        F.countDistinct("seed").alias("n_seeds"), F.countDistinct("cleaning_order").alias("n_sequences"),
    )


def smoke_grid(grid: DataFrame, kind_size: int, number: str = "order_no") -> DataFrame:
    """First seed, every ceil(n/4)-th order."""
    step = max(1, kind_size // 4)
    first = grid.agg(F.min("seed").alias("_first"))
    return grid.crossJoin(F.broadcast(first)).where(  # exactly one row
        (F.col("seed") == F.col("_first")) & (F.col(number) % step == 0)
    ).drop("_first")


# --------------------------------------------------------------------- evaluation
RUN_SCHEMA = T.StructType([
    T.StructField("dataset", T.StringType()),
    T.StructField("cleaning_order", T.StringType()),
    T.StructField("permutation", T.StringType()),
    T.StructField("seq_len", T.IntegerType()),
    T.StructField("seed", T.IntegerType()),
    T.StructField("n_train_input", T.LongType()),
    T.StructField("smote_skipped", T.BooleanType()),
    T.StructField("smote_skip_reason", T.StringType()),
    T.StructField("n_relabelled", T.LongType()),
    T.StructField("imputation__n_imputed", T.LongType()),
    T.StructField("outliers__n_removed", T.LongType()),
    T.StructField("label_noise__n_relabelled", T.LongType()),
    T.StructField("label_noise__n_removed_noise", T.LongType()),
    T.StructField("balance__n_synthetic", T.LongType()),
    T.StructField("balance__skipped", T.BooleanType()),
    T.StructField("balance__reason", T.StringType()),
    T.StructField("balanced_accuracy", T.DoubleType()),
    T.StructField("converged", T.BooleanType()),
    T.StructField("n_train", T.LongType()),
    T.StructField("n_test", T.LongType()),
    T.StructField("failed", T.BooleanType()),
    T.StructField("error", T.StringType()),
    T.StructField("classifier", T.StringType()),
    T.StructField("stage", T.StringType()),
    T.StructField("code_id", T.StringType()),
])


#: Names of the steps in run tables.
STEP_NAMES = {"IMP": "imputation", "OUT": "outliers", "LNR": "label_noise", "BAL": "balance"}


def flatten_log(log: Sequence[dict[str, object]]) -> dict[str, object]:
    """Step log as run-table columns. A label step that never relabels counts 0; no label
    step counts NULL."""
    by_name = {e["operation"]: e for e in log}
    out: dict[str, object] = {
        f"{e['operation']}__{k}": v for e in log for k, v in e.items() if k not in ("operation", "skipped", "reason")
    }
    if "balance" in by_name:
        out["smote_skipped"] = bool(by_name["balance"].get("skipped", False))
        out["smote_skip_reason"] = by_name["balance"].get("reason", "")
        out["balance__skipped"] = bool(by_name["balance"].get("skipped", False))
        out["balance__reason"] = by_name["balance"].get("reason")
    if "label_noise" in by_name:
        out["n_relabelled"] = by_name["label_noise"].get("n_relabelled", 0)
    return out


def evaluate_orders(
    train: DataFrame, test: DataFrame, orders: Sequence[Sequence[str]], seed: int, *, dataset: str, stage: str,
    code_id: str, methods: MethodSet = MethodSet(), classifiers: Sequence[str] = CLASSIFIERS, fit: Fit = Fit(),
) -> list[dict[str, object]]:
    """Clean once per order (prefixes shared), evaluate every eligible classifier on it.

    The driver holds one result row per run; tables stay in Spark. The fits of one
    cleaned table are submitted together.
    """
    n_input = train.count()
    rows = []
    for order, cleaned, log, error in walk_orders(train, orders, seed, methods):
        steps = [] if order == EMPTY_ORDER else order.split(ARROW)
        usable = [c for c in classifiers if "IMP" in steps or c != "logistic_regression"]
        base = {
            "dataset": dataset, "stage": stage, "code_id": code_id, "cleaning_order": order,
            "permutation": str(tuple(STEP_NAMES[s] for s in steps)),
            "seq_len": len(steps), "seed": seed, "n_train_input": n_input, **flatten_log(log),
        }
        if cleaned is None:
            rows += [{**base, "classifier": c, "failed": True, "error": error} for c in usable]
            continue
        with ThreadPoolExecutor(max(1, len(usable))) as pool:
            results = list(pool.map(lambda c, t=cleaned: train_and_evaluate(t, test, c, seed, fit), usable))
        rows += [{**base, "classifier": c, **r} for c, r in zip(usable, results, strict=True)]
    return rows


def run_table(spark: SparkSession, rows: Sequence[dict[str, object]]) -> DataFrame:
    names = RUN_SCHEMA.fieldNames()
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], RUN_SCHEMA)


def run_condition(
    features: DataFrame, dataset: str, stage: str, *, orders: Sequence[Sequence[str]], seeds: Sequence[int],
    code_id: str, fit: Fit = Fit(), classifiers: Sequence[str] = CLASSIFIERS, condition: Condition | None = None,
) -> DataFrame:
    """Split, corrupt the training part, clean in every order, evaluate on the clean test part.
    NaN cells count as missing; a target that is not binary is an error."""
    spec = condition or CONDITIONS[stage]
    features = nan_to_null(require_binary(features))
    rows = []
    for seed in seeds:
        split = materialize(stratified_split(features, seed))
        train, test = (split.where(F.col("is_test") == flag).drop("is_test") for flag in (False, True))
        if spec.faults is not None:
            train = inject(train, seed, spec.faults).drop("f_label", "f_missing", "f_outlier")
        rows += evaluate_orders(
            materialize(train), materialize(test), orders, seed, dataset=dataset, stage=stage, code_id=code_id,
            methods=spec.methods, classifiers=classifiers, fit=fit,
        )
    return run_table(features.sparkSession, rows)
