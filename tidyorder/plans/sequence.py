"""Applying cleaning steps in sequence, alone or for many orders sharing prefixes."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyorder.functions.steps import ARROW, EMPTY_ORDER
from tidyorder.operators import balance, impute, labels, outliers
from tidyorder.session import materialize

OPERATIONS = {"IMP": "imputation", "OUT": "outliers", "LNR": "label_noise", "BAL": "balance"}


@dataclass(frozen=True)
class MethodSet:
    """One way to do each step. `kind` A (neighbours, isolation forest, relabelling, SMOTE) or
    B (median, local outliers, edited neighbours, oversampling); `ratio` is the balance target."""

    kind: str = "A"
    ratio: float = balance.TARGET_RATIO
    trees: int = 100
    depth: int = 10

    def __post_init__(self) -> None:
        if self.kind not in ("A", "B"):
            raise ValueError(f"unknown method set {self.kind!r}")


@dataclass(frozen=True)
class StepResult:
    df: DataFrame
    log: dict[str, object] = field(default_factory=dict)


def _counts(df: DataFrame) -> dict[str, int]:
    return df.agg(F.count("*").alias("rows"), impute.null_cells(df).alias("nulls")).first().asDict()


def _impute(df: DataFrame, seed: int, methods: MethodSet) -> StepResult:
    before = _counts(df)["nulls"]
    if before == 0:
        return StepResult(df, {"n_imputed": 0})
    out = materialize(impute.impute_neighbors(df) if methods.kind == "A" else impute.impute_median(df))
    return StepResult(out, {"n_imputed": before - _counts(out)["nulls"]})


def _outliers(df: DataFrame, seed: int, methods: MethodSet) -> StepResult:
    out = outliers.remove_isolated(df, seed, methods.trees) if methods.kind == "A" else outliers.remove_local_outliers(df)
    out = materialize(out)
    return StepResult(out, {"n_removed": df.count() - out.count()})


def _labels(df: DataFrame, seed: int, methods: MethodSet) -> StepResult:
    if methods.kind == "B":
        out = materialize(labels.edit_neighbors(df))
        return StepResult(out, {"n_removed_noise": df.count() - out.count()})
    out = materialize(labels.correct_labels(df, seed, trees=methods.trees, depth=methods.depth))
    changed = out.select("row_id", F.col("label").alias("new")).join(df.select("row_id", "label"), "row_id")
    return StepResult(out, {"n_relabelled": changed.where("new != label").count()})


def _balance(df: DataFrame, seed: int, methods: MethodSet) -> StepResult:
    plan = balance.balance_plan(df, methods.ratio)
    if plan.reason:
        return StepResult(df, {"skipped": True, "reason": plan.reason})
    grow = balance.smote if methods.kind == "A" else balance.oversample
    return StepResult(materialize(grow(df, seed, methods.ratio)), {"skipped": False, "n_synthetic": plan.n_new})


STEPS: dict[str, Callable[[DataFrame, int, MethodSet], StepResult]] = {
    "IMP": _impute,
    "OUT": _outliers,
    "LNR": _labels,
    "BAL": _balance,
}


def apply_step(df: DataFrame, code: str, seed: int, methods: MethodSet) -> StepResult:
    if code not in STEPS:
        raise ValueError(f"unknown operation {code!r}; valid: {list(STEPS)}")
    return STEPS[code](df, seed, methods)


def apply_sequence(
    df: DataFrame, steps: Sequence[str], seed: int, methods: MethodSet = MethodSet()
) -> tuple[DataFrame, list[dict[str, object]]]:
    """The cleaned table and one log entry per step."""
    log = []
    for code in steps:
        done = apply_step(df, code, seed, methods)
        df = done.df
        log.append({"operation": OPERATIONS[code], **done.log})
    return df, log


def log_table(spark, log: Sequence[dict[str, object]]) -> DataFrame:
    """Step log in long form: (step_no, operation, metric, value, reason)."""
    rows = []
    for number, entry in enumerate(log, 1):
        reason = entry.get("reason")
        for metric, value in entry.items():
            if metric not in ("operation", "reason"):
                rows.append((number, entry["operation"], metric, float(value), reason))
    return spark.createDataFrame(rows, "step_no int, operation string, metric string, value double, reason string")


def order_name(steps: Sequence[str]) -> str:
    return ARROW.join(steps) or EMPTY_ORDER


def walk_orders(
    df: DataFrame, orders: Sequence[Sequence[str]], seed: int, methods: MethodSet = MethodSet()
) -> Iterator[tuple[str, DataFrame | None, list[dict[str, object]], str | None]]:
    """Clean one table in many orders, running each shared prefix once.

    A step's result depends only on its input and the seed, so orders with the same
    prefix share it: all 24 orders take 64 steps instead of 96. Yields (order, cleaned
    table, log, error); a failing step fails only the orders below it.
    """
    wanted = {tuple(o) for o in orders}
    prefixes = {o[:i] for o in wanted for i in range(len(o) + 1)}

    def visit(prefix: tuple[str, ...], table: DataFrame, log: list[dict[str, object]]):
        if prefix in wanted:
            yield order_name(prefix), table, log, None
        for code in sorted(p[-1] for p in prefixes if len(p) == len(prefix) + 1 and p[:-1] == prefix):
            below = (*prefix, code)
            try:
                done = apply_step(table, code, seed, methods)
            except Exception as problem:  # noqa: BLE001 - recorded on every order below
                for order in sorted(o for o in wanted if o[: len(below)] == below):
                    yield order_name(order), None, log, f"cleaning: {problem}"
                continue
            yield from visit(below, done.df, [*log, {"operation": OPERATIONS[code], **done.log}])

    yield from visit((), df, [])
