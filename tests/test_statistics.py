"""Statistics against brute force, with the distributed way forced and not."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortloom.functions import tails
from cohortloom.operators import association as assoc
from cohortloom.operators import bootstrap as boot
from cohortloom.operators import cutoffs, rank_scan, ranks, roc
from cohortloom.operators.ranks import histogram, prefix_sums


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(7)
    n = 500
    pdf = pd.DataFrame({"id": np.arange(n) * 10, "s": rng.integers(0, 27, n)})
    pdf["y"] = np.round(rng.exponential(10, n) * np.exp(-pdf.s / 15), 1)
    pdf.loc[:150, "y"] = 3.3  # one value holds about a third of the rows
    pdf["g"] = np.where(rng.random(n) < 0.5, "a", "b")
    pdf["e"] = (pdf.y < 3).astype(int)
    return pdf


@pytest.fixture(scope="module")
def df(spark, data):
    return spark.createDataFrame(data).cache()


def pairs(p):
    s, y = p.s.to_numpy(), p.y.to_numpy()
    lower = y[:, None] < y[None, :]
    conc = ((s[:, None] > s[None, :]) & lower).sum()
    tied = ((s[:, None] == s[None, :]) & lower).sum()
    return (conc + tied / 2) / lower.sum()


def test_prefix_sums_distributed_equals_single_window(spark):
    rng = np.random.default_rng(3)
    v = np.r_[rng.normal(0, 1, 800) * 10.0 ** rng.integers(-8, 8, 800), np.zeros(9),
              [5e-324, 1.7e308, -1.7e308, 2.0 ** 40, 2.0 ** 40 + 1, 8.0, np.nextafter(8, 0)]]
    pdf = pd.DataFrame({"g": rng.choice(["a", "b"], len(v)), "v": v})
    h = histogram(spark.createDataFrame(pdf), ["g", "v"])
    frames = [prefix_sums(h, "v", ["n"], ["g"], bounded=b).toPandas()
              .sort_values(["g", "v"]).reset_index(drop=True) for b in (True, False)]
    pd.testing.assert_frame_equal(frames[0], frames[1][frames[0].columns])


@pytest.mark.parametrize("bounded", [True, False])
def test_average_rank(df, data, bounded):
    out = ranks.average_rank(df, "y", ["g"], bounded=bounded).toPandas().set_index("id")["rank"]
    want = data.set_index("id").groupby("g").y.rank()
    assert (out.sort_index() == want.sort_index()).all()


def test_spearman_and_c_index(df, data):
    rows = {r.g: r for r in assoc.spearman(df, "s", "y", ["g"]).collect()}
    cs = {r.g: r for r in assoc.c_index(df, "s", "y", 5, ["g"]).collect()}
    for g, p in data.groupby("g"):
        assert rows[g].rho == pytest.approx(p.s.rank().corr(p.y.rank()), abs=1e-12)
        assert cs[g].c_index == pytest.approx(pairs(p), abs=1e-12)


def test_c_index_of_any_score_through_dense_index(df, data):
    odd = df.withColumn("s", F.exp(F.col("s") / 3.0))
    dense = assoc.dense_index(odd, "s", "i")
    assert assoc.c_index(dense, "i", "y", 5).first().c_index == pytest.approx(pairs(data))


def test_metric_relations(df):
    a = roc.discrimination(df, "s", "e").first().auroc
    minus = roc.discrimination(df.withColumn("s", -F.col("s")), "s", "e").first().auroc
    assert a + minus == pytest.approx(1.0)
    two = df.withColumn("y", 1.0 - F.col("e"))
    assert assoc.c_index(two, "s", "y", 5).first().c_index == pytest.approx(a)
    h = assoc.kruskal_wallis(df, "g", "y").first().h
    moved = df.withColumn("y", F.exp(F.col("y") / 50) + 7)
    assert assoc.kruskal_wallis(moved, "g", "y").first().h == pytest.approx(h)


def test_roc_ends_and_youden_tie(spark):
    rows = spark.createDataFrame([(1, 0), (2, 1), (3, 0), (4, 1)], "s int, e int")
    curve = roc.roc_curve(rows, "s", "e").orderBy("fpr", "tpr").collect()
    assert (curve[0].threshold, curve[0].tpr) == (None, 0.0)
    assert (curve[-1].tpr, curve[-1].fpr) == (1.0, 1.0)
    best = roc.youden(roc.roc_curve(rows, "s", "e")).first()
    assert best.threshold == 4.0  # equal at 2 and 4: the higher wins


def test_one_class_gives_null(spark):
    rows = spark.createDataFrame([(1, 0), (2, 0)], "s int, e int")
    assert roc.discrimination(rows, "s", "e").first().auroc is None
    assert roc.youden(roc.roc_curve(rows, "s", "e")).count() == 0


def test_chi_square_correction_and_empty_margin(spark):
    cells = [("a", 0, 10), ("a", 1, 20), ("b", 0, 20), ("b", 1, 10)]
    rows = [(r, c) for r, c, k in cells for _ in range(k)]
    out = assoc.chi_square(spark.createDataFrame(rows, "r string, c int"), "r", "c").first()
    assert out.dof == 1 and out.chi2 == pytest.approx(5.4)
    three = spark.createDataFrame(rows + [("c", 0)] * 6, "r string, c int")
    assert assoc.chi_square(three, "r", "c").first().dof == 2
    flat = spark.createDataFrame([("a", 0), ("b", 0)], "r string, c int")
    assert assoc.chi_square(flat, "r", "c").first().chi2 is None


def test_tails(spark):
    row = spark.range(1).select(
        tails.chi2_tail(F.lit(3.841458820694124), F.lit(1)).alias("c1"),
        tails.chi2_tail(F.lit(5.991464547107979), F.lit(2)).alias("c2"),
        tails.chi2_tail(F.lit(18.307038053275146), F.lit(10)).alias("c10"),
        tails.normal_two_sided(F.lit(-1.959963984540054)).alias("z"),
        tails.t_two_sided(F.lit(2.2281388519649385), F.lit(10)).alias("t"),
        tails.t_two_sided(F.lit(1.9600), F.lit(10 ** 9)).alias("tn"),
        tails.f_tail(F.lit(3.0), F.lit(2), F.lit(60)).alias("f")).first()
    for value in (row.c1, row.c2, row.c10, row.z, row.t):
        assert value == pytest.approx(0.05, abs=1e-9)
    assert row.tn == pytest.approx(0.0499958, abs=1e-6)
    assert row.f == pytest.approx((1 + 6 / 60) ** -30, abs=1e-10)


# --- bootstrap ---------------------------------------------------------------------

def test_weights_are_poisson():
    big = boot.weight_matrix(np.arange(20000) * 10, np.arange(1, 101), 42)
    assert abs(big.mean() - 1) < 0.01 and abs(big.var() - 1) < 0.01
    assert abs(np.corrcoef(big[:, 0], big[:, 1])[0, 1]) < 0.03
    assert big.mean(axis=0).std() * math.sqrt(20000) == pytest.approx(1, abs=0.25)
    shares = np.bincount(big.astype(int).ravel(), minlength=5)[:5] / big.size
    assert shares == pytest.approx([math.exp(-1) / math.factorial(k) for k in range(5)], abs=0.002)


@pytest.mark.parametrize("rows", [4096, 7])
@pytest.mark.parametrize("tasks", ["1", "5"])
def test_rank_replicates_equal_brute_force(spark, df, data, monkeypatch, rows, tasks):
    """Also with pieces far smaller than the tied third of all rows, in one range or many."""
    monkeypatch.setattr(rank_scan, "RANGE_ROWS", rows)
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", tasks)
    try:
        out = boot.rank_replicates(df, "id", "s", "y", 60, 42, ["g"], True)
        got = out.toPandas().set_index(["g", "b"])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    assert len(got) == 120
    w = boot.weight_matrix(data.id.to_numpy(), np.arange(1, 61), 42).astype(int)
    for g in ("a", "b"):
        for b in (1, 4, 50, 51, 60):
            p = data.loc[data.index.repeat(w[:, b - 1])]
            p = p[p.g == g]
            assert got.loc[(g, b)].spearman == pytest.approx(
                p.s.rank().corr(p.y.rank()), abs=1e-10)
            assert got.loc[(g, b)].c_index == pytest.approx(pairs(p), abs=1e-10)


def brute_area(p):
    r, pos = p.s.rank(), p.e.sum()
    order = np.sort(p.s.unique())[::-1]
    hits = np.array([((p.s >= t) & (p.e == 1)).sum() for t in order])
    flagged = np.array([(p.s >= t).sum() for t in order])
    return ((r[p.e == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(p) - pos)),
            (np.diff(hits, prepend=0) / pos * hits / flagged).sum())


def test_states_equal_brute_force(spark, df, data):
    """Every replicate of the mergeable metrics, a group per level, rows of a cell beyond any table."""
    w = boot.weight_matrix(data.id.to_numpy(), np.arange(1, 31), 42).astype(int)
    areas = boot.discrimination_replicates(df, "s", "e", 30, 42, ["g"], "id").toPandas()
    linear = boot.pearson_replicates(df, "id", "s", "y", 30, 42).toPandas().set_index("b")
    few = boot.discrimination_replicates(df.filter("e = 0"), "s", "e", 5, 42, [], "id").toPandas()
    assert len(areas) == 60 and len(linear) == 30 and few.auroc.isna().all() and len(few) == 5
    areas = areas.set_index(["g", "b"])
    for b in (1, 9, 30):
        p = data.loc[data.index.repeat(w[:, b - 1])]
        assert linear.loc[b].pearson == pytest.approx(p.s.corr(p.y), abs=1e-12)
        for g in ("a", "b"):
            area, precision = brute_area(p[p.g == g])
            assert areas.loc[(g, b)].auroc == pytest.approx(area, abs=1e-12)
            assert areas.loc[(g, b)].auprc == pytest.approx(precision, abs=1e-12)


def test_the_sample_is_replicate_zero(df, data):
    ranks = boot.estimates(boot.rank_replicates(df, "id", "s", "y", 60, 42, [], True, True),
                           {"rho": "spearman", "c": "c_index"}).first()
    areas = boot.estimates(boot.discrimination_replicates(df, "s", "e", 60, 42, [], "id", True),
                           {"auroc": "auroc", "auprc": "auprc"}, counts=["n", "events"]).first()
    linear = boot.estimates(boot.pearson_replicates(df, "id", "s", "y", 60, 42, [], True),
                            {"r": "pearson"}).first()
    area, precision = brute_area(data)
    assert (ranks.n, areas.n, areas.events, linear.n) == (500, 500, data.e.sum(), 500)
    assert ranks.rho == pytest.approx(data.s.rank().corr(data.y.rank()), abs=1e-12)
    assert ranks.c == pytest.approx(pairs(data), abs=1e-12)
    assert (areas.auroc, areas.auprc) == pytest.approx((area, precision), abs=1e-12)
    assert linear.r == pytest.approx(data.s.corr(data.y), abs=1e-12)
    w = boot.weight_matrix(data.id.to_numpy(), np.arange(1, 61), 42).astype(int)
    drawn = [data.loc[data.index.repeat(w[:, b])] for b in range(60)]
    limits = np.percentile([p.s.corr(p.y) for p in drawn], [2.5, 97.5])
    assert [linear.r_ci_low, linear.r_ci_high] == pytest.approx(limits, abs=1e-12)


def test_states_go_out_early_and_meet_again(spark, df, monkeypatch):
    rows = df.select("id", F.col("s").cast("double").alias("_x"), F.col("y").alias("_y"), "s")
    whole = boot.replicates(rows, boot.PEARSON, "id", 20, 42, ["s"]).toPandas()
    monkeypatch.setattr(boot, "STATE_BYTES", 5000)
    monkeypatch.setattr(boot, "WEIGHTS", 200)
    parts = boot.replicates(rows, boot.PEARSON, "id", 20, 42, ["s"]).toPandas()
    merged = whole.merge(parts, on=["s", "b"])
    assert len(merged) == len(whole) == len(parts)
    assert (merged.pearson_x.isna() == merged.pearson_y.isna()).all()
    assert np.allclose(merged.pearson_x.fillna(0), merged.pearson_y.fillna(0))


def test_a_metric_of_ones_own(spark, df, data):
    mean = boot.Metric(("y",), 2, lambda c, w: np.stack([c["y"] @ w, w.sum(axis=0)]),
                       lambda cells, states: {"value": states[0, 0] / states[0, 1]})
    got = boot.bootstrap(df, mean, "id", 200, 42).first()
    w = boot.weight_matrix(data.id.to_numpy(), np.arange(1, 201), 42)
    drawn = data.y.to_numpy() @ w / w.sum(axis=0)
    assert [got.ci_low, got.ci_high] == pytest.approx(np.percentile(drawn, [2.5, 97.5]))
    assert got.n_valid == 200


def test_discrimination_spread_matches_resampling(df, data):
    reps = boot.discrimination_replicates(df, "s", "e", 600, 42, [], "id")
    ci = boot.interval(reps, "auroc").first()
    rng, drawn = np.random.default_rng(1), []
    for _ in range(600):
        p = data.iloc[rng.integers(0, len(data), len(data))]
        r, pos = p.s.rank(), p.e.sum()
        drawn.append((r[p.e == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(p) - pos)))
    low, high = np.percentile(drawn, [2.5, 97.5])
    assert abs(ci.ci_low - low) < 0.02 and abs(ci.ci_high - high) < 0.02


def test_row_ids_beyond_the_modulus_differ():
    ids = np.array([5, 5 + boot.PRIME, 5 + 2 * boot.PRIME])
    w = boot.weight_matrix(ids, np.arange(1, 200), 42)
    assert (w[0] != w[1]).any() and (w[1] != w[2]).any()


def test_concordance_refuses_an_index_out_of_range(spark):
    rows = spark.createDataFrame([(40, 1.0), (8, 2.0)], "s int, y double")
    assert assoc.c_index(rows, "s", "y", 6).first().c_index == 1.0
    with pytest.raises(Exception, match="not an integer in"):
        assoc.c_index(rows, "s", "y", 5).collect()


def test_tails_agree_at_any_size(spark):
    row = spark.range(1).select(
        *[tails.f_tail(F.lit(3.8414588206941236), F.lit(1), F.lit(float(d))).alias(f"f{i}")
          for i, d in enumerate((4e6, 1e9, 1e10))],
        *[tails.t_two_sided(F.lit(1.959963984540054), F.lit(float(d))).alias(f"t{i}")
          for i, d in enumerate((4e6, 1e9, 1e10))]).first()
    for i in range(3):
        assert row[f"f{i}"] == pytest.approx(0.05, abs=1e-7)
        assert row[f"t{i}"] == pytest.approx(row[f"f{i}"], abs=1e-10)


def test_tails_of_degenerate_tests_do_not_fail(spark):
    """Behind a condition that is not met, arguments of any size are worked out all the same."""
    values = [0.0, -1.0, 1.0, float("nan"), None, -2.0, 1e308]
    rows = spark.createDataFrame([(a, b, c) for a in values for b in values for c in (0.0, -1.0, 2.0)],
                                 "a double, b double, c double")
    out = rows.select(*[F.when(F.col("c") > 5, tail).alias(name) for name, tail in (
        ("chi", tails.chi2_tail(F.col("a"), F.col("b"))), ("n", tails.normal_two_sided(F.col("a"))),
        ("t", tails.t_two_sided(F.col("a"), F.col("b"))),
        ("f", tails.f_tail(F.col("a"), F.col("b"), F.col("c"))))])
    assert all(v is None for r in out.collect() for v in r)
    two = spark.createDataFrame([(1, 2.0, "g"), (2, 3.0, "g"), (1, 1.0, "h")], "s int, y double, g string")
    assert [r.p for r in assoc.spearman(two, "s", "y", ["g"], bounded_x=True).collect()] == [None, None]


def test_interval_guard(spark):
    few = spark.createDataFrame([(float(i),) for i in range(10)], "m double")
    assert boot.interval(few, "m").first().ci_low is None
    with pytest.raises(Exception, match="too few valid"):
        boot.interval(few, "m", strict=True).collect()


def test_bootstrap_spread_matches_resampling(df, data):
    reps = boot.rank_replicates(df, "id", "s", "y", 400, 42)
    ci = boot.interval(reps, "spearman").first()
    rng = np.random.default_rng(1)
    drawn = []
    for _ in range(400):
        p = data.iloc[rng.integers(0, len(data), len(data))]
        drawn.append(p.s.rank().corr(p.y.rank()))
    low, high = np.percentile(drawn, [2.5, 97.5])
    assert abs(ci.ci_low - low) < 0.03 and abs(ci.ci_high - high) < 0.03


# --- cut-offs ----------------------------------------------------------------------

def test_grid():
    grid = cutoffs.candidate_grid(4, 20)
    assert len(grid) == 105 and grid[0] == (4, 6) and grid[-1] == (17, 19)


def test_tree_splits_where_classes_change(spark):
    rows = [(s, int(s > 10)) for s in range(20) for _ in range(30)]
    out = cutoffs.tree_cutoffs(spark.createDataFrame(rows, "s int, e int"), "s", "e", 50)
    assert [(r.node, r.threshold) for r in out.collect()] == [("root", 10.5)]


def test_best_candidate_prefers_smallest_of_equals(spark):
    rows = spark.createDataFrame([(5, 9, 2.0), (4, 8, 2.0), (6, 8, 1.0)],
                                 "low int, high int, h double")
    best = cutoffs.best_candidate(rows, "h").first()
    assert (best.low, best.high) == (4, 8)


def test_weights_equal_the_plain_arithmetic_in_little_memory():
    import tracemalloc

    import numpy as np

    from cohortloom.operators import bootstrap as boot

    def plain(ids, replicates, seed):
        out = []
        for i in map(int, ids):
            a = (i + (i >> 31) * 40692) % boot.PRIME
            row = []
            for b in map(int, replicates):
                x = (a * 48271 + b * 69621 + seed) % boot.PRIME
                x = (x * x + a) % boot.PRIME
                x = (x * 16807 + b * 39373) % boot.PRIME
                x = (x * x + b) % boot.PRIME
                x = (x * 48271 + 11) % boot.PRIME
                row.append(1 if b == 0 else sum(x >= limit for limit in boot.LIMITS))
            out.append(row)
        return np.array(out, dtype=float)

    ids = np.array([0, 1, -1, 10, 2**31 - 2, 2**31 - 1, 2**31, -2**62, 2**62 + 12345, *range(1000, 1090)])
    for seed in (42, -7, 2**40):
        for replicates in (np.arange(0, 301), np.arange(1, 4)):
            assert np.array_equal(boot.weight_matrix(ids, replicates, seed), plain(ids, replicates, seed))

    step = max(1, boot.WEIGHTS // 1001)
    tracemalloc.start()
    boot.weight_matrix(np.arange(step), np.arange(1001), 42)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 << 20


def test_rows_of_a_value_and_level_are_worked_on_as_one():
    """Their weights are added up for every group before any rank is taken."""
    rng = np.random.default_rng(11)
    ids = np.repeat(np.arange(40), 3)
    pdf = pd.DataFrame({"_id": ids, "g": np.tile(["a", "b", "c"], 40)[rng.permutation(120)],
                        "_y": np.repeat(rng.integers(0, 4, 40) / 2, 3),
                        "_x": np.repeat(rng.integers(0, 3, 40).astype(float), 3)})
    pdf = pdf.sort_values(["_y", "_x", "_id"]).reset_index(drop=True)
    unique, place = np.unique(pdf["_id"].to_numpy(), return_inverse=True)
    w = boot.weight_matrix(unique, np.arange(21), 42)
    cells, sums = boot.summed_cells(pdf, ["g"], place, w)
    want = pd.DataFrame(w[place]).groupby([pdf._y, pdf._x, pdf.g]).sum()
    assert len(cells) == len(want) < len(pdf) and (np.diff(cells._y) >= 0).all()
    for key, row in zip(cells[["_y", "_x", "g"]].itertuples(index=False), sums, strict=True):
        assert (want.loc[tuple(key)].to_numpy() == row).all()


def test_concordance_costs_no_pass_per_level():
    """Counting pairs takes a few times the ranks alone, however many levels a score has."""
    import time

    rng = np.random.default_rng(5)
    n, width = 2000, 400
    pdf = pd.DataFrame({"_x": rng.integers(0, 27, n).astype(float), "_y": np.sort(rng.random(n))})
    w = rng.poisson(1.0, (n, width)).astype(float)

    def seconds(concordance):
        best = math.inf
        for _ in range(3):
            begin = time.perf_counter()
            list(rank_scan._ranges([], lambda p: (p, w), width, concordance)(iter([pdf])))
            best = min(best, time.perf_counter() - begin)
        return best

    # a pass over the rows for each of 27 levels took some 20 times the ranks
    assert seconds(True) < 8 * seconds(False)


@pytest.mark.parametrize("held, weights, state_bytes", [(1 << 17, 1_000_000, 96 << 20),
                                                        (50, 200, 5000), (1 << 17, 60, 96 << 20)])
def test_sums_of_weights_equal_at_any_size_of_a_piece(spark, df, monkeypatch, held, weights, state_bytes):
    """Also where states go out early, and where a piece has too many keys for one product."""
    rows = df.withColumns({"h": F.col("id") % 17, "_score": F.col("s").cast("double"),
                           "_event": F.col("e").cast("int")})
    monkeypatch.setattr(boot, "HELD", held, raising=False)
    monkeypatch.setattr(boot, "WEIGHTS", weights)
    monkeypatch.setattr(boot, "STATE_BYTES", state_bytes)
    got = boot.replicates(rows, boot.DISCRIMINATION, "id", 20, 42, ["g", "h"], True).toPandas()
    data = rows.select("g", "h", "id", "s", "e").toPandas()
    w = boot.weight_matrix(data.id.to_numpy(), np.arange(21), 42)
    assert len(got) == 21 * data.groupby(["g", "h"]).ngroups
    got = got.set_index(["g", "h", "b"])
    for (g, h), part in data.groupby(["g", "h"]):
        for b in (0, 7, 20):
            mine = w[part.index, b]
            assert got.loc[(g, h, b)].n == mine.sum()
            assert got.loc[(g, h, b)].events == (mine * part.e).sum()


def test_the_overall_column_counts_rows_of_no_group(spark):
    from cohortloom import config
    from cohortloom.plans import validation as val

    n = 30
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"gender": ["M", "F"] * 15, "which": ["x", "y", None] * 10,
                        **{c: np.where(rng.random(n) < 0.2, np.nan, rng.integers(0, 9, n))
                           for c in config.BASELINE_MEAN + config.BASELINE_MEDIAN}})
    df = spark.createDataFrame(pdf).replace(float("nan"), None)
    got = val.baseline_continuous(df, F.col("which")).toPandas().set_index(["variable", "group"])
    for c in config.BASELINE_MEAN + config.BASELINE_MEDIAN:
        for name, part in (("x", pdf[pdf.which == "x"]), ("y", pdf[pdf.which == "y"]), ("Overall", pdf)):
            row = got.loc[(c, name)]
            assert (row.n, row.n_missing) == (part[c].count(), part[c].isna().sum())
            assert [row["mean"], row["sd"], row["median"]] == pytest.approx(
                [part[c].mean(), part[c].std(), part[c].median()])
