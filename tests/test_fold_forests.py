"""Forests of all folds grown together: held-out purity, layout, quality, synthetic rows by fold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidyorder.operators import balance, impute, labels
from tidyorder.operators import fold_forests as ff
from tidyorder.operators.models import assemble, fixed_layout, forest, probabilities
from tidyorder.session import materialize, release


def learnable(spark, n=3000, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    y = (x[:, 0] + x[:, 1] ** 2 + 0.3 * rng.normal(size=n) > 1.2).astype(int)
    rows = [(i, int(y[i]), *map(float, x[i, :3]), int(x[i, 3] > 0)) for i in range(n)]
    return spark.createDataFrame(rows, "row_id long, label int, x_a double, x_b double, x_c double, c_k int")


def folds_of(df):
    return df.withColumn("fold", F.pmod(F.xxhash64("row_id"), F.lit(5)).cast("int")).withColumn("only", F.lit(-1))


def fitted(rows, trees=8, depth=3, weights=None, block_rows=ff.BLOCK_ROWS):
    layout = ff.lay_out(rows, ["x_a", "x_b", "x_c", "c_k"], np.zeros((5, 4)), 3, block_rows)
    grown = ff.grow(layout, 3, trees, depth, weights)
    return grown, {r.row_id: r.p1 for r in ff.held_out(layout, grown).collect()}


@pytest.fixture(scope="module")
def rows(spark):
    return materialize(folds_of(learnable(spark)))


def test_a_fold_never_sees_its_own_labels(rows):
    _, before = fitted(rows)
    _, after = fitted(rows.withColumn("label", F.when(F.col("fold") == 2, 1 - F.col("label")).otherwise(F.col("label"))))
    fold = {r.row_id: r.fold for r in rows.collect()}
    assert all(before[i] == after[i] for i in before if fold[i] == 2)
    assert any(before[i] != after[i] for i in before if fold[i] != 2)


def test_layout_does_not_matter(rows):
    assert fitted(rows, 3, 2)[1] == fitted(rows.repartition(13, "x_a"), 3, 2, block_rows=400)[1]


def test_trees_follow_their_counts(rows):
    """Every node's counts are those of the drawn rows that walk to it."""
    layout = ff.lay_out(rows, ["x_a", "x_b", "x_c", "c_k"], np.zeros((5, 4)), 3)
    grown = ff.grow(layout, 3, 2, 4)
    want = np.zeros_like(grown.counts)
    for r in layout.blocks.collect():
        block = ff._Block(r.asDict(), 4)
        for m in range(5):
            mine = block.trains(m)
            bins = block.bins(layout.fills[m], layout.edges[m], mine)
            for t in range(2):
                drawn = ff._draws(block.ids[mine], 3, m, t)
                for level in range(5):
                    at = ff._walk(bins, grown.feature[m, t], grown.cut[m, t], level)
                    here = (at >= 2**level - 1)
                    np.add.at(want[m, t], (at[here], block.label[mine][here]), drawn[here])
    assert (want == grown.counts).all()
    inner = grown.feature >= 0
    assert inner[:, :, 0].all() and (grown.counts[inner].min(axis=1) > 0).all()  # pure nodes are leaves


def test_draws_are_poisson():
    drawn = np.concatenate([ff._draws(np.arange(100_000), 1, 0, t) for t in range(4)])
    assert abs(drawn.mean() - 1) < 0.01 and abs((drawn == 0).mean() - np.exp(-1)) < 0.005 and abs(drawn.var() - 1) < 0.02


def test_as_good_as_the_library_forest(rows):
    _, p = fitted(rows, 60, 6)
    train = rows.where("fold <> 0")
    model = forest(3, 60, 6).fit(fixed_layout(assemble(train.drop("fold", "only"))))
    theirs = {r.row_id: r.p1 for r in probabilities(model, assemble(rows.where("fold = 0").drop("fold", "only"))).collect()}
    label = {r.row_id: r.label for r in rows.collect()}

    def right(of):
        return np.mean([(of[i] > 0.5) == label[i] for i in theirs])

    assert right(p) > 0.9 and right(p) > right(theirs) - 0.02
    assert np.corrcoef([p[i] for i in theirs], [theirs[i] for i in theirs])[0, 1] > 0.97


def test_class_weights_raise_the_rare_class(rows):
    _, plain = fitted(rows)
    _, weighted = fitted(rows, weights=np.array([[1.0, 4.0]] * 5))
    assert np.mean(list(weighted.values())) > np.mean(list(plain.values())) + 0.02


def test_empty_training_part_and_one_class(spark):
    one = spark.createDataFrame([(i, 0, float(i), 0.0, 1.0, 0) for i in range(30)], "row_id long, label int, x_a double, x_b double, x_c double, c_k int")
    assert set(fitted(folds_of(one), 3, 1)[1].values()) == {0.0}
    same = folds_of(one).withColumn("fold", F.lit(1))
    assert set(fitted(same, 3, 1)[1].values()) == {0.5}  # nothing was learnt
    with pytest.raises(ValueError, match="unknown mode"):
        labels.out_of_fold(one, 1, "other")


@pytest.mark.parametrize("nominal", [False, True])
def test_synthetic_rows_by_fold_equal_one_fold_at_a_time(spark, nominal):
    df = learnable(spark, 400)
    df = df.withColumn("x_a", F.when(F.col("row_id") % 17 != 0, F.col("x_a")))
    df = materialize(folds_of(df if nominal else df.drop("c_k")).drop("only"))
    fills = materialize(impute.fit_fill_by_fold(df, 5))
    got = {}
    features = [c for c in df.columns if c[:2] in ("x_", "c_")]
    for r in balance.smote_by_fold(df, fills, 7, 5).collect():
        got.setdefault(r.only, []).append((r.label, *(round(r[c], 9) for c in features)))
    assert set(got) == set(range(5))
    for fold in (0, 3):
        train = df.where(F.col("fold") != fold).drop("fold")
        one = balance.smote(impute.apply_fill(train, impute.fit_fill(train)), 7).where("origin = 'syn'").collect()
        assert sorted(got[fold]) == sorted((r.label, *(round(r[c], 9) for c in features)) for r in one)


@pytest.mark.parametrize("d", [3, 10, 23])
def test_packed_rows_walk_and_count_like_plain_ones(d):
    rng = np.random.default_rng(d)
    n, level, some = 20_000, 5, 3
    values, label = rng.integers(0, ff.BINS, (n, d)).astype(float), rng.integers(0, 2, n).astype(np.int8)
    fold = np.zeros(n, np.int16)
    block = ff._Block({"ids": np.arange(n).tobytes(), "label": label.tobytes(), "fold": fold.tobytes(), "only": (fold - 1).tobytes(), "values": values.tobytes()}, d)
    edges = [np.arange(ff.BINS - 1) + 0.5] * d
    bins, words = (f(np.zeros(d), edges, np.arange(n)) for f in (block.bins, block.words))
    feature, cut = rng.integers(-1, d, 2**level - 1).astype(np.int16), rng.integers(0, ff.BINS - 1, 2**level - 1).astype(np.uint8)
    feature[0] = d - 1
    at = ff._walk(bins, np.append(feature, np.full(2**level, -1)), cut, level) - (2**level - 1)
    arrived = at >= 0  # the others stay in a leaf above
    steps = ff._steps(feature, cut, d)
    assert (ff._descend(words, steps, level)[arrived] == at[arrived]).all() and 0 < arrived.sum() < n
    open_nodes = np.bincount(at[arrived], minlength=2**level) > 0
    drawn, looked = ff._draws(np.arange(n), 1, 0, 0), np.sort(rng.random((2**level, d)).argsort(axis=1)[:, :some], axis=1)
    want = np.zeros((some, 2**level, ff.BINS, 2), np.int64)
    for s in range(some):
        np.add.at(want[s], (at[arrived], bins[arrived, looked[at[arrived], s]], label[arrived]), drawn[arrived])
    assert (ff._counted(words, drawn, steps, looked, open_nodes, level) == want.ravel()).all()


def test_blocks_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(ff, "MOST_BLOCK_ROWS", 100)
    many = materialize(folds_of(learnable(spark, 8000)))
    layout = ff.lay_out(many, ["x_a", "x_b", "x_c", "c_k"], np.zeros((5, 4)), 3, 10)
    assert layout.blocks.count() == 80  # not 800: every block sends its counts of all trees


def test_synthetic_rows_do_not_depend_on_how_folds_are_joined(spark, monkeypatch):
    folded = materialize(folds_of(learnable(spark, 600)))
    fills = materialize(impute.fit_fill_by_fold(folded, 5))
    one = balance.smote_by_fold(folded, fills, 7, 5).collect()
    monkeypatch.setattr(balance, "JOIN_ROWS", 1)  # a join for each fold
    assert {r.only for r in one} == set(range(5))
    assert sorted(one) == sorted(balance.smote_by_fold(folded, fills, 7, 5).collect())


def test_forests_do_not_depend_on_the_passes(spark, monkeypatch):
    many = materialize(folds_of(learnable(spark, 600)))
    layout = ff.lay_out(many, ["x_a", "x_b", "x_c", "c_k"], np.zeros((5, 4)), 3)
    one = ff.grow(layout, 3, 4, 3)
    monkeypatch.setattr(ff, "COUNTS_AT_ONCE", 1)  # a pass for each model
    other = ff.grow(layout, 3, 4, 3)
    assert (one.feature == other.feature).all() and (one.cut == other.cut).all() and (one.counts == other.counts).all()


def test_files_of_a_correction_go_when_they_have_been_read(spark):
    """Of the checkpoints and shuffles of a correction only its result is left."""
    from pathlib import Path

    df = materialize(learnable(spark, 400))
    folder = spark._jvm.java.net.URI(spark.sparkContext.getCheckpointDir()).getPath()
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, kept = set(Path(folder).iterdir()), spark.conf.get(setting)
    probs = labels.out_of_fold(df, 7, "fold_smote", trees=2, depth=2)
    large = [p for p in set(Path(folder).iterdir()) - before if sum(f.stat().st_size for f in p.rglob("part-*")) > 8000]
    assert len(large) <= 1 and probs.count() == 400 and spark.conf.get(setting) == kept
    release(probs)
    assert df.count() == 400


def test_synthetic_rows_are_made_once(spark, monkeypatch):
    """The join behind them is not run again for each reader of the laid-out rows."""
    df = learnable(spark, 400)
    made, passed = balance.smote_by_fold, spark.sparkContext.accumulator(0)

    def counted(*args):
        out = made(*args)

        def through(batches):
            for batch in batches:
                passed.add(batch.num_rows)
                yield batch

        return out.mapInArrow(through, out.schema)

    monkeypatch.setattr(labels, "smote_by_fold", counted)
    assert labels.out_of_fold(df, 7, "fold_smote", trees=2, depth=2).count() == 400
    folded = materialize(labels.stratified_folds(df, 7, folds=5))
    expected = made(folded, materialize(impute.fit_fill_by_fold(folded, 5)), 7, 5).count()
    assert expected > 0 and passed.value == expected
