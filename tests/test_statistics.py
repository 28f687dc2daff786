"""Fixture expectations for quality, variability, tests and regression."""

from __future__ import annotations

import numpy as np
import pytest

from tidegauge.functions.columns import Roles
from tidegauge.operators import inference as N
from tidegauge.operators.bundle import build_bundle, explore
from tidegauge.operators.impute import impute, imputation_report
from tidegauge.operators.overview import target_overview
from tidegauge.operators.quality import display_warnings, quality_warnings, warning_rows
from tidegauge.operators.variability import variability_scores
from tidegauge.plans.counts import value_counts
from tidegauge.operators.variability import disorder

OWNERS = list("CABACBBCACAB")
SIZES = [7, 2, 5, 3, 11, 1, 8, 4, 6, 9, 2, 10]
TYPES = ["BOX" if i % 5 in (0, 2) else "TANK" for i in range(12)]
DAYS = [31, 4, 17, 9, 40, 12, 22, 28, 13, 37, 6, 26]


def codes(df):
    return {r["code"] for r in df.collect()}


@pytest.fixture(scope="module")
def out_frame(spark):
    rows = [(i, OWNERS[i], float(SIZES[i]), TYPES[i], OWNERS[i], 5, float(DAYS[i])) for i in range(12)]
    return spark.createDataFrame(rows, "`Unnamed: 0` int, Owner string, Size double, Type string, Quality string, week int, DaysInDeposit double")


def test_entropy_and_gini(spark):
    df = spark.createDataFrame([("k",), ("m",), ("k",), ("m",), ("k",), ("m",)], "v string")
    row = disorder(value_counts(df, ["v"])).first()
    assert (row["entropy"], row["gini_impurity"]) == (1.0, 0.5)
    mixed = spark.createDataFrame([("p", 3), ("q", 8), ("p", 1), ("r", 9)], "cat string, num int")
    scores = {r["column"]: r for r in variability_scores(mixed).collect()}
    assert scores["cat"]["custom_index"] == 1.0 and scores["num"]["coefficient_variation"] is not None
    assert scores["cat"]["entropy"] <= np.log2(3)


def test_quality_fixture(spark):
    df = spark.createDataFrame([(i, 5, o) for i, o in enumerate("ABCD")], "`Unnamed: 0` int, week int, Owner string")
    found = {(r["code"], r["column"]) for r in quality_warnings(df).collect()}
    assert ("week_constant", "week") in found and not any(c == "constant_column" for c, _ in found)
    numbers = spark.createDataFrame([(float(i),) for i in range(120)], "v double")
    assert quality_warnings(numbers).count() == 0
    labels = spark.createDataFrame([(f"l{i}",) for i in range(120)], "v string")
    assert [r["code"] for r in quality_warnings(labels).collect()] == ["high_cardinality"]
    shown = display_warnings(warning_rows(df, [("custom_non_informative", "info", c, f"m{c}", "s") for c in "ab"] + [("x", "info", "a", "m", "s")] * 2))
    assert shown.count() == 2


def direct_fit(y, columns):
    x = np.column_stack([np.ones(len(y)), *columns])
    inverse = np.linalg.pinv(x.T @ x, rcond=1e-12, hermitian=True)
    beta = np.linalg.pinv(x) @ y
    rank = np.linalg.matrix_rank(x)
    rss = float(((y - x @ beta) ** 2).sum())
    return beta, np.sqrt(np.diag(inverse) * rss / (len(y) - rank)), rss, rank


def test_full_rank_regression(out_frame):
    found = N.multiple_regression(out_frame.select("Unnamed: 0", "Owner", "Size", "Type", "DaysInDeposit"), "DaysInDeposit")
    y, size = np.array(DAYS, float), np.array(SIZES, float)
    dummies = {"Owner[B]": [o == "B" for o in OWNERS], "Owner[C]": [o == "C" for o in OWNERS], "Type[TANK]": [t == "TANK" for t in TYPES]}
    columns = [size, *[np.array(v, float) for v in dummies.values()]]
    beta, error, rss, rank = direct_fit(y, columns)
    got = {r["term"]: r for r in found.coefficients.collect()}
    for i, name in enumerate(["Size", *dummies], start=1):
        assert got[name]["estimate"] == pytest.approx(beta[i]) and got[name]["std_error"] == pytest.approx(error[i])
        assert (got[name]["ci_low"] + got[name]["ci_high"]) / 2 == pytest.approx(beta[i])
    _, _, without, _ = direct_fit(y, [size, columns[3]])
    owner = next(r for r in found.terms.collect() if r["feature"] == "Owner")
    assert owner["df"] == 2 and owner["sum_sq"] == pytest.approx(without - rss)
    summary = found.summary.first()
    tss = float(((y - y.mean()) ** 2).sum())
    assert summary["r_squared"] == pytest.approx(1 - rss / tss) and summary["n_features"] == 3
    loglik = -6 * (np.log(2 * np.pi) + np.log(rss / 12) + 1)
    assert summary["aic"] == pytest.approx(-2 * loglik + 2 * rank)
    assert all(r["sum_sq"] <= tss for r in found.terms.collect())


def test_collinear_regression(out_frame):
    """Owner and Quality coincide: minimum-norm coefficients, unchanged fit."""
    found = N.multiple_regression(out_frame, "DaysInDeposit")
    assert found.built and {"low_sample_for_multivariate_model", "feature_excluded_constant"} <= codes(found.warnings)
    flags = [[o == level for o in OWNERS] for level in "BC"]
    columns = [np.array(SIZES, float), *[np.array(f, float) for f in flags], np.array([t == "TANK" for t in TYPES], float), *[np.array(f, float) for f in flags]]
    beta, error, rss, rank = direct_fit(np.array(DAYS, float), columns)
    got = {r["term"]: r for r in found.coefficients.collect()}
    names = ["Size", "Owner[B]", "Owner[C]", "Type[TANK]", "Quality[B]", "Quality[C]"]
    assert [got[n]["estimate"] for n in names] == pytest.approx(beta[1:].tolist(), rel=1e-6)
    assert [got[n]["std_error"] for n in names] == pytest.approx(error[1:].tolist(), rel=1e-6)
    assert found.summary.first()["n_features"] == 4


def test_regression_guards(spark, out_frame):
    none = N.multiple_regression(out_frame.drop("DaysInDeposit"), "DaysInDeposit")
    assert not none.built and codes(none.warnings) == {"missing_target"}
    bare = N.multiple_regression(out_frame.select("Unnamed: 0", "week", "DaysInDeposit"), "DaysInDeposit")
    assert not bare.built and "no_features_after_cleaning" in codes(bare.warnings)
    wide = N.multiple_regression(out_frame, "DaysInDeposit", max_columns=3)
    assert not wide.built and "multiple_regression_fit_failed" in codes(wide.warnings)
    blank = spark.createDataFrame([("x",), (None,)], "DaysInDeposit string")
    assert codes(N.multiple_regression(blank, "DaysInDeposit").warnings) == {"target_all_missing"}


def test_group_tests_against_direct(out_frame):
    rows = {r["feature"]: r for r in N.feature_tests(out_frame, "DaysInDeposit").collect()}
    y = np.array(DAYS, float)
    groups = [y[[i for i, o in enumerate(OWNERS) if o == level]] for level in "ABC"]
    between = sum(len(g) * (g.mean() - y.mean()) ** 2 for g in groups)
    within = sum(((g - g.mean()) ** 2).sum() for g in groups)
    assert rows["Owner"]["statistic"] == pytest.approx(between / 2 / (within / 9))
    assert rows["Owner"]["effect_size"] == pytest.approx(between / (between + within))
    assert rows["Owner"]["small_groups"] == 3 and rows["Size"]["feature_type"] == "numeric"
    assert rows["week"]["effect_size"] == 0.0 and rows["week"]["statistic"] == pytest.approx(y.mean() * np.sqrt(12) / y.std(ddof=1))


def test_target_only(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([2, 19, 4, 33, 8, 8, 21, 13, 5, 27])], "`Unnamed: 0` int, DaysInDeposit double")
    found = target_overview(df, "DaysInDeposit")
    assert found.present and found.pearson.count() == 0 and found.mutual_information.count() == 0
    assert sum(r["count"] for r in found.histogram.collect()) == 10
    assert not target_overview(df, "absent").present


def test_imputation_fills_everything(spark):
    df = spark.createDataFrame([(1, None, 5, 1.0), (2, "b", None, None), (3, "a", 5, 4.0), (4, None, 6, None)], "row_id int, Owner string, week int, v double")
    done = impute(df)
    assert {tuple(r) for r in done.collect()} == {(1, "a", 5, 1.0), (2, "b", 5, 2.5), (3, "a", 5, 4.0), (4, "a", 6, 2.5)}
    report = {r["column"]: r for r in imputation_report(df).collect()}
    assert report["week"]["strategy"] == "mode" and report["v"]["fill"] == "2.5" and report["row_id"]["imputed"] == 0


def test_bundle(spark, out_frame):
    rows = [(str(i), "O" if i % 4 else "D", OWNERS[i % 12], "2", TYPES[i % 12], OWNERS[i % 12], 5) for i in range(24)]
    in_frame = spark.createDataFrame(rows, "`Unnamed: 0` string, Condition string, Owner string, Size string, Type string, Quality string, week int")
    found = build_bundle(in_frame, out_frame)
    facts = [r["fact"] for r in found.facts.orderBy("position").collect()]
    assert facts[0] == "nothing_imputed" and "dominant_condition" in facts and "dominant_owner" in facts and len(facts) <= 6
    assert found.sections["out"].overview.first()["n_rows"] == 12
    assert {r["column"] for r in found.sections["in"].dictionary.collect()} == set(in_frame.columns) - {"Unnamed: 0"}
    assert found.sections["in"].identifiers.first()["column"] == "Unnamed: 0"
    assert found.warnings.count() == found.warnings.dropDuplicates(["code", "column", "message"]).count()
    assert explore(in_frame, Roles()).warnings.filter("code = 'technical_columns_excluded'").count() == 1


def test_exact_fits_come_first(spark):
    rows = [(float(i), 2.0 * i + 1, "ab"[i % 2], float(i % 2), (i * 7) % 5 / 3.0) for i in range(12)]
    df = spark.createDataFrame(rows, "y double, line double, half string, part double, noise double")
    found = N.feature_tests(df.select("y", "line", "noise"), "y").collect()
    assert (found[0]["feature"], found[0]["p_value"], found[0]["statistic"]) == ("line", 0.0, float("inf"))
    grouped = N.group_tests(df, "part", ["half"]).first()
    assert (grouped["p_value"], grouped["effect_size"], grouped["statistic"]) == (0.0, 1.0, float("inf"))


def test_box_statistics_keep_the_group_of_null(spark):
    from tidegauge.operators.profile import box_stats

    df = spark.createDataFrame([(None, 1.0), (None, 3.0), (None, 2.0), ("a", 5.0), ("a", 7.0)], "g string, v double")
    for small in (True, False):
        found = {r["g"]: r for r in box_stats(df, ["g"], "v", small=small).collect()}
        assert set(found) == {None, "a"} and found[None]["p50"] == 2.0 and found["a"]["n"] == 2


def test_features_are_encoded_alike_at_every_size(spark):
    from tidegauge.operators.models import eligible_features
    from tidegauge.operators.temporal import temporal_split

    for levels in (5, 1500):
        rows = [(i, f"o{i % levels}", float(i % 9), 1 + i % 3) for i in range(2 * levels)]
        split = temporal_split(spark.createDataFrame(rows, "row_id int, Owner string, value double, week int"), "value", "week")
        assert eligible_features(split).hashed == () and eligible_features(split, ["Owner"]).hashed == ("Owner",)


@pytest.mark.parametrize("columns", [["Owner", "Size", "Type"], ["Owner", "Size"], ["Owner", "Type", "Size", "Quality"]])
def test_eliminating_the_widest_column_changes_nothing(spark, columns):
    rows = [(i, f"o{(i * i) % 13}", float((i * 7) % 11) if i % 9 else None, TYPES[i % 12], f"q{(i // 3) % 3}", float((i * 37) % 23) + i % 5) for i in range(150)]
    df = spark.createDataFrame(rows, "`Unnamed: 0` int, Owner string, Size double, Type string, Quality string, DaysInDeposit double")
    df = df.select("Unnamed: 0", *columns, "DaysInDeposit")
    whole, beside = N.multiple_regression(df, "DaysInDeposit"), N.multiple_regression(df, "DaysInDeposit", max_columns=8)
    assert beside.built
    for part, keys in (("summary", []), ("coefficients", ["term"]), ("terms", ["feature"])):
        a, b = (sorted(getattr(f, part).collect(), key=lambda r: [r[k] for k in keys]) for f in (whole, beside))
        assert len(a) == len(b)
        for left, right in zip(a, b):
            for name in left.asDict():
                assert left[name] == (pytest.approx(right[name], rel=1e-6, abs=1e-9) if isinstance(left[name], float) else right[name]), name
