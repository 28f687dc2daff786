"""Association and inference queries."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from queries.profiling import GRADED_SQL, graded, lines, rounded
from queries.tables import FLOW_ROLES, FLOW_SQL, flow, table
from tidegauge.operators import association as A
from tidegauge.operators import inference as N
from tidegauge.operators.overview import target_overview, target_stats

LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def line_numbers(spark, sf_dir):
    return lines(spark, sf_dir).select(*LINE_NUMBERS)


def gappy(spark, sf_dir):
    return graded(spark, sf_dir).select("row_id", "n_chars", "score", F.length("source").alias("source_length"))


def spearman_pairs(small):
    def run(spark, sf_dir):
        df = line_numbers(spark, sf_dir)
        return rounded(A.spearman(df, list(combinations(LINE_NUMBERS, 2)), small=small), digits=6)

    return run


def matrix(spark, sf_dir):
    return rounded(A.correlation_matrix(gappy(spark, sf_dir)), digits=6)


def line_categories(spark, sf_dir):
    return lines(spark, sf_dir).select("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string").alias("line"))


def doc_categories(spark, sf_dir):
    return graded(spark, sf_dir).select("lang", "source", "verdict")


def flow_tests(small=None):
    def run(spark, sf_dir):
        data = N.with_target(flow(spark, sf_dir), "value")
        return rounded(N.group_tests(data, "value", ["Owner", "Size", "Type"], small=small), digits=6)

    return run


def slopes(spark, sf_dir):
    data = N.with_target(lines(spark, sf_dir), "l_extendedprice").withColumn("flat", F.lit(3))
    found = N.simple_regressions(data, "l_extendedprice", ["l_quantity", "l_discount", "l_tax", "l_linenumber", "flat"])
    return rounded(found.select("feature", "statistic", "p_value", "effect_size", "n"), digits=6)


def all_tests(spark, sf_dir):
    found = N.feature_tests(flow(spark, sf_dir), "value")
    return found.select("feature", "feature_type", "n_groups", F.round("effect_size", 6).alias("effect_size"))


def tests_warned(spark, sf_dir):
    return N.test_warnings(N.feature_tests(flow(spark, sf_dir), "value")).select("code", "severity", "column")


def boxes(spark, sf_dir):
    found = N.box_groups(flow(spark, sf_dir).select("row_id", "Size", "Type", "value"), "value")
    return rounded(found.select("feature", "group", "n", "p50", "outlier_count"), digits=6)


def two_numbers(spark, sf_dir):
    return lines(spark, sf_dir).select("l_extendedprice", "l_quantity", "l_discount")


def number_and_label(spark, sf_dir):
    return lines(spark, sf_dir).select("l_extendedprice", "l_quantity", "l_linestatus")


def regression(source, part):
    def run(spark, sf_dir):
        found = getattr(N.multiple_regression(source(spark, sf_dir), "l_extendedprice"), part)
        if part == "terms":
            found = found.withColumn("sum_sq", F.round("sum_sq", 0)).withColumn("mean_sq", F.round("mean_sq", 0))
        return rounded(found.drop("ci_low", "ci_high"), digits=4)

    return run


def flow_model(part):
    def run(spark, sf_dir):
        found = getattr(N.multiple_regression(flow(spark, sf_dir), "value", FLOW_ROLES), part)
        return rounded(found.withColumns({n: F.round(n, 2) for n in ("sum_sq", "mean_sq")}), digits=5) if part == "terms" else found

    return run


def wide_regression(spark, sf_dir):
    """Price over quantity and part: thousands of levels, of which one table of sums remains."""
    rows = table(spark, sf_dir, "lineitem").select("l_extendedprice", "l_quantity", F.col("l_partkey").cast("string").alias("part"))
    found = N.multiple_regression(rows, "l_extendedprice")
    own = found.coefficients.filter("term = 'l_quantity'").select("term", F.round("estimate", 4).alias("estimate"), F.round("std_error", 4).alias("std_error"))
    return own.crossJoin(found.summary.select(F.round("r_squared", 6).alias("r_squared"), "n_obs"))


def two_wide_columns(spark, sf_dir):
    """Price over quantity, part and order: two label columns of thousands of levels each."""
    rows = table(spark, sf_dir, "lineitem").select(
        "l_extendedprice", "l_quantity", F.col("l_partkey").cast("string").alias("part"), F.col("l_orderkey").cast("string").alias("order"))
    found = N.multiple_regression(rows, "l_extendedprice")
    own = found.coefficients.filter("term = 'l_quantity'").select(
        "estimate", "std_error", F.lit("l_quantity").alias("feature"), F.lit(True).alias("one"))
    terms = found.terms.select("feature", "df", F.round("f_value", 4).alias("f_value")).join(own.drop("one"), "feature", "left")
    whole = found.summary.select(F.round("r_squared", 6).alias("r_squared"), "n_obs")
    return rounded(terms, digits=4).crossJoin(whole)


def lone_wide_column(spark, sf_dir):
    """Price over order alone: group means."""
    rows = table(spark, sf_dir, "lineitem").select("l_extendedprice", F.col("l_orderkey").cast("string").alias("order"))
    found = N.multiple_regression(rows, "l_extendedprice")
    return found.coefficients.select(
        "term", F.round("estimate", 6).alias("estimate"), F.round("std_error", 4).alias("std_error"))


def overview(part):
    def run(spark, sf_dir):
        return rounded(getattr(target_overview(flow(spark, sf_dir), "value", FLOW_ROLES), part), digits=6)

    return run


QUERIES = {
    "pearson_lineitem": lambda s, d: rounded(A.pearson(line_numbers(s, d), list(combinations(LINE_NUMBERS, 2))), digits=6),
    "spearman_lineitem": spearman_pairs(None),
    "spearman_lineitem_sliced": spearman_pairs(False),
    "correlation_matrix_gaps": matrix,
    "target_rankings_lineitem": lambda s, d: rounded(A.target_rankings(line_numbers(s, d), "l_extendedprice"), digits=6),
    "target_pearson_lineitem": lambda s, d: rounded(A.target_pearson(line_numbers(s, d), "l_extendedprice"), digits=6),
    "contingency_lineitem": lambda s, d: A.contingency(lines(s, d), "l_returnflag", "l_linestatus"),
    "chi2_pairs_lineitem": lambda s, d: rounded(A.chi2_pairs(line_categories(s, d)), digits=6),
    "chi2_pairs_documents": lambda s, d: rounded(A.chi2_pairs(doc_categories(s, d)), digits=6),
    "contingency_preview_documents": lambda s, d: A.contingency_preview(doc_categories(s, d)),
    "mutual_information_flow": lambda s, d: rounded(A.mutual_information(flow(s, d), "value"), digits=6),
    "slope_tests_lineitem": slopes,
    "group_tests_flow": flow_tests(),
    "group_tests_flow_sliced": flow_tests(False),
    "feature_tests_flow": all_tests,
    "feature_test_warnings_flow": tests_warned,
    "box_groups_flow": boxes,
    "regression_two_numbers_summary": regression(two_numbers, "summary"),
    "regression_two_numbers_coefficients": regression(two_numbers, "coefficients"),
    "regression_two_numbers_terms": regression(two_numbers, "terms"),
    "regression_label_summary": regression(number_and_label, "summary"),
    "regression_label_coefficients": regression(number_and_label, "coefficients"),
    "regression_label_terms": regression(number_and_label, "terms"),
    "regression_wide_parts": wide_regression,
    "regression_two_wide": two_wide_columns,
    "regression_lone_wide": lone_wide_column,
    "regression_flow_coefficients": flow_model("coefficients"),
    "regression_flow_terms": flow_model("terms"),
    "regression_flow_conclusions": flow_model("conclusions"),
    "target_outliers_flow": lambda s, d: N.target_outliers(flow(s, d), "value").select("code", "severity", "column"),
    "target_stats_flow": lambda s, d: rounded(target_stats(flow(s, d), "value"), digits=6),
    "target_overview_pearson": overview("pearson"),
    "target_overview_histogram": overview("histogram"),
}

PAIRS = list(combinations(LINE_NUMBERS, 2))


def gamma_tail(x, dof):
    """Upper chi-square tail from the positive series of the lower incomplete gamma function."""
    return (f"(1 - list_sum(list_transform(range(0, 3000), lambda i: exp(({dof}) / 2.0 * ln(({x}) / 2.0) + i * ln(({x}) / 2.0) - ({x}) / 2.0 "
            f"- lgamma(({dof}) / 2.0 + i + 1)))))")


def beta_lower(x, a, b):
    """Regularised incomplete beta from its positive series."""
    return (f"list_sum(list_transform(range(0, 8000), lambda i: exp(lgamma(({a}) + ({b}) + i) - lgamma(({a}) + 1 + i) - lgamma({b}) "
            f"+ (({a}) + i) * ln({x}) + ({b}) * ln(1 - ({x})))))")


def f_tail_sql(f, d1, d2):
    return f"(1 - {beta_lower(f'({d1}) * ({f}) / (({d1}) * ({f}) + ({d2}))', f'({d1}) / 2.0', f'({d2}) / 2.0')})"


def t_tail_sql(t, dof):
    return f_tail_sql(f"({t}) * ({t})", "1.0", dof)


def spearman_sql(x, y, source):
    return f"""SELECT '{x}' AS feature_x, '{y}' AS feature_y, round(corr(rx, ry), 6) AS spearman FROM (
      SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx,
             rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry
      FROM (SELECT {x} AS x, {y} AS y FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL))"""


_SPEARMAN = " UNION ALL ".join(spearman_sql(x, y, "lineitem") for x, y in PAIRS)
_GAPPY = f"gap AS (SELECT n_chars, score, length(source) AS source_length FROM graded)"
_GAP_COLUMNS = ["n_chars", "score", "source_length"]
_GAP_PAIRS = list(combinations(_GAP_COLUMNS, 2))


def chi2_sql(source, names):
    pairs = " UNION ALL ".join(
        f"SELECT '{x}' AS feature_x, '{y}' AS feature_y, CAST({x} AS VARCHAR) AS xv, CAST({y} AS VARCHAR) AS yv FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL"
        for x, y in combinations(names, 2))
    return f"""
t AS (SELECT feature_x, feature_y, xv, yv, count(*) AS o FROM ({pairs}) GROUP BY ALL),
rs AS (SELECT feature_x, feature_y, xv, sum(o) AS r FROM t GROUP BY ALL), cs AS (SELECT feature_x, feature_y, yv, sum(o) AS c FROM t GROUP BY ALL),
sh AS (SELECT feature_x, feature_y, sum(o) AS n, count(DISTINCT xv) AS nr, count(DISTINCT yv) AS nc FROM t GROUP BY ALL),
g AS (SELECT rs.feature_x, rs.feature_y, n, nr, nc, r * c / n AS e, abs(coalesce(o, 0) - r * c / n) AS gap, (nr - 1) * (nc - 1) AS dof
      FROM rs JOIN cs USING (feature_x, feature_y) JOIN sh USING (feature_x, feature_y) LEFT JOIN t USING (feature_x, feature_y, xv, yv)
      WHERE nr >= 2 AND nc >= 2),
x2 AS (SELECT feature_x, feature_y, n, nr, nc, dof, sum(pow(CASE WHEN dof = 1 THEN gap - least(0.5, gap) ELSE gap END, 2) / e) AS chi2 FROM g GROUP BY ALL),
v AS (SELECT *, greatest(0, chi2 / n - (nc - 1) * (nr - 1) / (n - 1)) AS phi, least(nc - pow(nc - 1, 2) / (n - 1), nr - pow(nr - 1, 2) / (n - 1)) - 1 AS bound FROM x2)
SELECT feature_x, feature_y, round(chi2, 6) AS chi2, dof, round({gamma_tail('chi2', 'dof')}, 6) AS p_value,
  round(CASE WHEN bound > 0 THEN sqrt(phi / bound) END, 6) AS cramers_v, n AS sample_size FROM v
ORDER BY coalesce(cramers_v, 0) DESC, feature_x, feature_y LIMIT 10
"""


def preview_sql(source, names):
    """First eight by eight labels of the pair that the chi-square statement puts first."""
    steps, _, last = chi2_sql(source, names).rpartition("SELECT feature_x, feature_y, round")
    return f"""{steps.rstrip()}, best AS (SELECT feature_x, feature_y, round{last} ),
top AS (SELECT feature_x, feature_y FROM best ORDER BY coalesce(cramers_v, 0) DESC, feature_x, feature_y LIMIT 1),
k AS (SELECT xv, yv, o FROM t JOIN top USING (feature_x, feature_y)),
kx AS (SELECT DISTINCT xv FROM k ORDER BY xv LIMIT 8), ky AS (SELECT DISTINCT yv FROM k ORDER BY yv LIMIT 8)
SELECT kx.xv AS x_value, ky.yv AS y_value, coalesce(k.o, 0) AS count FROM kx CROSS JOIN ky LEFT JOIN k ON k.xv = kx.xv AND k.yv = ky.yv"""


def group_sql():
    parts = " UNION ALL ".join(f"SELECT '{n}' AS feature, {n} AS level, value AS y FROM flow WHERE {n} IS NOT NULL" for n in ("Owner", "Size", "Type"))
    return f"""WITH {FLOW_SQL}, r AS ({parts}),
k AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY y) + (count(*) OVER (PARTITION BY feature, y) - 1) / 2.0 AS rk FROM r),
g AS (SELECT feature, level, count(*) AS n, avg(y) AS m, coalesce(var_samp(y), 0) * (count(*) - 1) AS ssw, avg(rk) AS mr FROM k GROUP BY ALL),
a AS (SELECT feature, count(*) AS kk, sum(g.n) AS n, sum(ssw) AS ssw, sum(g.n * pow(m - (SELECT avg(y) FROM r r2 WHERE r2.feature = g.feature), 2)) AS ssb,
        sum(g.n * pow(mr - ((SELECT count(*) FROM r r2 WHERE r2.feature = g.feature) + 1) / 2.0, 2)) AS rb, count(*) FILTER (g.n < 5) AS small_groups FROM g GROUP BY feature),
s AS (SELECT feature, sum(pow(rk, 2)) - count(*) * pow((count(*) + 1) / 2.0, 2) AS rss FROM k GROUP BY feature),
f AS (SELECT a.*, (ssb / (kk - 1)) / (ssw / (n - kk)) AS fv, (n - 1) * rb / rss AS h FROM a JOIN s USING (feature))
SELECT feature, 'categorical' AS feature_type, 'anova_kruskal' AS test_used, round(fv, 6) AS statistic, round({f_tail_sql('fv', '(kk - 1.0)', '(n - kk)')}, 6) AS p_value,
  round(ssb / (ssb + ssw), 6) AS effect_size, kk AS n_groups, round(h, 6) AS kruskal_statistic, round({gamma_tail('h', '(kk - 1)')}, 6) AS kruskal_p_value, small_groups, n FROM f"""


def slope_sql(x):
    return f"""SELECT '{x}' AS feature, r * sqrt((n - 2) / (1 - r * r)) AS t, n - 2.0 AS dof, r * r AS effect, n FROM (
      SELECT corr(l_extendedprice, {x}) AS r, count({x}) AS n FROM lineitem)"""


# Two-column least squares in closed form: x1, x2 centred through covariances.
def ols_sql(x2, name2, kind2, term2):
    return f"""
WITH d AS (SELECT l_extendedprice AS y, l_quantity AS x1, {x2} AS x2 FROM lineitem),
m AS (SELECT count(*) AS n, var_pop(x1) * count(*) AS s11, var_pop(x2) * count(*) AS s22, covar_pop(x1, x2) * count(*) AS s12,
        covar_pop(x1, y) * count(*) AS s1y, covar_pop(x2, y) * count(*) AS s2y, var_pop(y) * count(*) AS syy FROM d),
b AS (SELECT *, s11 * s22 - s12 * s12 AS det, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1, (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2 FROM m),
f AS (SELECT *, b1 * s1y + b2 * s2y AS ess, syy - b1 * s1y - b2 * s2y AS rss FROM b),
z AS (SELECT *, n - 3.0 AS dof, rss / (n - 3) AS s2 FROM f)
"""


# Fixed 97.5% normal-range point of the Student distribution at more than 5000 degrees of freedom is not
# tabulated in SQL, so the interval ends are left to the unit tests.
def ols_parts(x2, name2, kind2, term2):
    head = ols_sql(x2, name2, kind2, term2)
    coefs = f"""SELECT 'l_quantity' AS term, b1 AS est, sqrt(s2 * s22 / det) AS se, dof FROM z UNION ALL SELECT '{term2}', b2, sqrt(s2 * s11 / det), dof FROM z"""
    terms = f"""SELECT 'l_quantity' AS feature, 'numeric' AS kind, b1 * b1 * det / s22 AS ss, rss, s2, dof FROM z
      UNION ALL SELECT '{name2}', '{kind2}', b2 * b2 * det / s11, rss, s2, dof FROM z"""
    return {
        "summary": f"""{head} SELECT true AS model_built, n AS n_obs, 2 AS n_features, round(ess / syy, 4) AS r_squared, round(1 - (1 - ess / syy) * (n - 1) / dof, 4) AS adj_r_squared,
          round(ess / 2 / s2, 4) AS f_statistic, round({f_tail_sql('ess / 2 / s2', '2.0', 'dof')}, 4) AS f_p_value,
          round(n * (ln(2 * pi()) + ln(rss / n) + 1) + 6, 4) AS aic, round(n * (ln(2 * pi()) + ln(rss / n) + 1) + 3 * ln(n), 4) AS bic FROM z""",
        "coefficients": f"""{head} SELECT term, round(est, 4) AS estimate, round(se, 4) AS std_error, round(est / se, 4) AS t_value, round({t_tail_sql('est / se', 'dof')}, 4) AS p_value FROM ({coefs})""",
        "terms": f"""{head} SELECT feature, kind AS feature_type, 1.0 AS df, round(ss, 0) AS sum_sq, round(ss, 0) AS mean_sq, round(ss / s2, 4) AS f_value,
          round({f_tail_sql('ss / s2', '1.0', 'dof')}, 4) AS p_value, round(ss / (ss + rss), 4) AS partial_eta_squared FROM ({terms})""",
    }


_NUMBERS = ols_parts("l_discount", "l_discount", "numeric", "l_discount")
_LABEL = ols_parts("CASE WHEN l_linestatus = (SELECT max(l_linestatus) FROM lineitem) THEN 1.0 ELSE 0.0 END", "l_linestatus", "categorical", "l_linestatus[O]")

_MI_FEATURES = ["Owner", "Size", "Type"]
_MI = f"""WITH {FLOW_SQL},
e AS (SELECT list_distinct([quantile_cont(value, 0.1), quantile_cont(value, 0.2), quantile_cont(value, 0.3), quantile_cont(value, 0.4), quantile_cont(value, 0.5),
        quantile_cont(value, 0.6), quantile_cont(value, 0.7), quantile_cont(value, 0.8), quantile_cont(value, 0.9)]) AS ey,
      list_distinct([quantile_cont(week, 0.1), quantile_cont(week, 0.2), quantile_cont(week, 0.3), quantile_cont(week, 0.4), quantile_cont(week, 0.5),
        quantile_cont(week, 0.6), quantile_cont(week, 0.7), quantile_cont(week, 0.8), quantile_cont(week, 0.9)]) AS ew FROM flow),
b AS (SELECT Owner, Size, Type, len(list_filter(ew, lambda q: q <= week)) AS w, len(list_filter(ey, lambda q: q <= value)) AS y FROM flow, e WHERE value IS NOT NULL),
l AS ({" UNION ALL ".join(f"SELECT '{n}' AS feature, coalesce({n}, '<MISSING>') AS x, y FROM b" for n in _MI_FEATURES)} UNION ALL SELECT 'week', CAST(w AS VARCHAR), y FROM b),
j AS (SELECT feature, x, y, count(*) AS n FROM l GROUP BY ALL),
p AS (SELECT *, sum(n) OVER (PARTITION BY feature) AS t, sum(n) OVER (PARTITION BY feature, x) AS nx, sum(n) OVER (PARTITION BY feature, y) AS ny FROM j)
SELECT feature, round(greatest(sum(n / t * ln(n * t / (nx * ny))), 0), 6) AS mi FROM p GROUP BY feature"""

def two_wide_sql(sweeps=40):
    """Both label columns are taken out by turns until nothing changes; the other tests take out one alone."""
    def out(name, by, source):
        return f"""{name} AS MATERIALIZED (SELECT a, b, x - avg(x) OVER (PARTITION BY {by}) AS x, y - avg(y) OVER (PARTITION BY {by}) AS y FROM {source})"""

    steps = ["s0 AS MATERIALIZED (SELECT l_partkey AS a, l_orderkey AS b, l_quantity - avg(l_quantity) OVER () AS x, l_extendedprice - avg(l_extendedprice) OVER () AS y FROM lineitem)"]
    steps += [out(f"s{k + 1}", "ab"[k % 2], f"s{k}") for k in range(2 * sweeps)]
    steps.append(out("only_b", "b", "s0"))
    sums = "sum(x * x) AS sxx, sum(x * y) AS sxy, sum(y * y) AS syy, sum(y * y) - sum(x * y) * sum(x * y) / sum(x * x) AS rss"
    steps += [f"f AS (SELECT {sums} FROM s{2 * sweeps})", f"p AS (SELECT {sums} FROM s1)", f"o AS (SELECT {sums} FROM only_b)",
              "n AS (SELECT count(*) AS n, count(DISTINCT a) AS la, count(DISTINCT b) AS lb, sum(y * y) AS tot FROM s0)",
              "v AS (SELECT f.rss / (n - la - lb) AS s2 FROM f, n)"]
    part = "round(1 - f.rss / tot, 6) AS r_squared, n AS n_obs"
    return "WITH " + ", ".join(steps) + f"""
      SELECT 'l_quantity' AS feature, 1.0 AS df, round(sxy * sxy / sxx / s2, 4) AS f_value, round(sxy / sxx, 4) AS estimate, round(sqrt(s2 / sxx), 4) AS std_error, {part} FROM f, n, v
      UNION ALL SELECT 'part', la - 1, round((o.rss - f.rss) / (la - 1) / s2, 4), NULL, NULL, {part} FROM f, o, n, v
      UNION ALL SELECT 'order', lb - 1, round((p.rss - f.rss) / (lb - 1) / s2, 4), NULL, NULL, {part} FROM f, p, n, v"""


#: Model columns of the flow regression by feature, the first label of each left out.
FLOW_DESIGN = {
    "week": ["CAST(week AS DOUBLE)"],
    "Size": [f"(Size = '{v}')::INT::DOUBLE" for v in (1, 2, 3)],
    "Type": [f"(Type = '{v}')::INT::DOUBLE" for v in ("error", "purchase", "signup", "view")],
}


def flow_terms_sql():
    """Type-II sums by successive orthogonal columns: a term's columns come last, beside Owner taken out as group means."""
    steps, sums = [FLOW_SQL.strip()], []
    columns = [(n, e) for n, every in FLOW_DESIGN.items() for e in every]

    def chain(tag, last, by):
        order = [c for c in columns if c[0] != last] + [c for c in columns if c[0] == last]
        steps.append(f"{tag}0 AS MATERIALIZED (SELECT value - avg(value) OVER ({by}) AS y, "
                     + ", ".join(f"{e} - avg({e}) OVER ({by}) AS x{j}" for j, (_, e) in enumerate(order)) + " FROM flow)")
        for j in range(len(order)):
            rest = ["y", *[f"x{k}" for k in range(j + 1, len(order))]]
            steps.append(f"{tag}{j + 1} AS MATERIALIZED (SELECT " + ", ".join(
                f"{v} - x{j} * (SELECT sum(x{j} * {v}) / sum(x{j} * x{j}) FROM {tag}{j}) AS {v}" for v in rest) + f" FROM {tag}{j})")
        return f"(SELECT sum(y * y) FROM {tag}{len(order) - len(FLOW_DESIGN.get(last, []))})", f"(SELECT sum(y * y) FROM {tag}{len(order)})"

    for n, every in FLOW_DESIGN.items():
        before, whole = chain(f"g_{n}_", n, "PARTITION BY Owner")
        sums.append(f"SELECT '{n}' AS feature, '{'numeric' if n == 'week' else 'categorical'}' AS feature_type, {len(every)}.0 AS df, {before} - {whole} AS ss, {whole} AS rss")
    _, alone = chain("h_", None, "")
    sums.append(f"SELECT 'Owner', 'categorical', (SELECT count(DISTINCT Owner) FROM flow) - 1.0, {alone} - {whole}, {whole}")
    return f"""WITH {", ".join(steps)}, t AS ({" UNION ALL ".join(sums)}),
      d AS (SELECT count(*) - count(DISTINCT Owner) - {len(columns)} AS dof FROM flow), f AS (SELECT *, ss / df / (rss / dof) AS f FROM t, d)
      SELECT feature, feature_type, df, round(ss, 2) AS sum_sq, round(ss / df, 2) AS mean_sq, round(f, 5) AS f_value, round({f_tail_sql("f", "df", "dof")}, 5) AS p_value,
        round(ss / (ss + rss), 5) AS partial_eta_squared FROM f"""


SQL = {
    "pearson_lineitem": " UNION ALL ".join(
        f"SELECT '{x}' AS feature_x, '{y}' AS feature_y, count(*) AS n, round(corr({x}, {y}), 6) AS pearson FROM lineitem" for x, y in PAIRS),
    "spearman_lineitem": _SPEARMAN,
    "spearman_lineitem_sliced": _SPEARMAN,
    "correlation_matrix_gaps": f"""WITH {GRADED_SQL}, {_GAPPY},
      p AS ({" UNION ALL ".join(f"SELECT '{x}' AS feature_x, '{y}' AS feature_y, round(corr({x}, {y}), 6) AS pearson FROM gap" for x, y in _GAP_PAIRS)}),
      s AS ({" UNION ALL ".join(spearman_sql(x, y, "gap") for x, y in _GAP_PAIRS)}), u AS (SELECT * FROM p JOIN s USING (feature_x, feature_y))
      SELECT feature_x, feature_y, pearson, spearman FROM u UNION ALL SELECT feature_y, feature_x, pearson, spearman FROM u
      UNION ALL {" UNION ALL ".join(f"SELECT '{n}', '{n}', 1.0, 1.0" for n in _GAP_COLUMNS)}""",
    "target_rankings_lineitem": "WITH s AS (" + " UNION ALL ".join(spearman_sql(x, "l_extendedprice", "lineitem") for x in LINE_NUMBERS if x != "l_extendedprice")
        + "), p AS (" + " UNION ALL ".join(f"SELECT '{x}' AS feature_x, round(corr({x}, l_extendedprice), 6) AS pearson FROM lineitem" for x in LINE_NUMBERS if x != "l_extendedprice")
        + ") SELECT feature_x AS feature, pearson, spearman FROM p JOIN s USING (feature_x)",
    "target_pearson_lineitem": " UNION ALL ".join(
        f"SELECT '{x}' AS feature, round(corr({x}, l_extendedprice), 6) AS pearson FROM lineitem" for x in LINE_NUMBERS if x != "l_extendedprice"),
    "contingency_lineitem": "SELECT l_returnflag AS x_value, l_linestatus AS y_value, count(*) AS count FROM lineitem WHERE l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL GROUP BY ALL",
    "chi2_pairs_lineitem": "WITH src AS (SELECT l_returnflag, l_linestatus, CAST(l_linenumber AS VARCHAR) AS line FROM lineitem), " + chi2_sql("src", ["l_returnflag", "l_linestatus", "line"]),
    "chi2_pairs_documents": f"WITH {GRADED_SQL}, " + chi2_sql("graded", ["lang", "source", "verdict"]),
    "contingency_preview_documents": f"WITH {GRADED_SQL}, " + preview_sql("graded", ["lang", "source", "verdict"]),
    "mutual_information_flow": _MI,
    "slope_tests_lineitem": f"""WITH s AS ({" UNION ALL ".join(slope_sql(x) for x in ["l_quantity", "l_discount", "l_tax", "l_linenumber"])}
        UNION ALL SELECT 'flat', avg(l_extendedprice) * sqrt(count(*)) / stddev_samp(l_extendedprice), count(*) - 1.0, 0.0, count(*) FROM lineitem)
      SELECT feature, round(t, 6) AS statistic, CASE WHEN abs(t) > 100 THEN 0.0 ELSE round({t_tail_sql('t', 'dof')}, 6) END AS p_value, round(effect, 6) AS effect_size, n FROM s""",
    "group_tests_flow": group_sql(),
    "group_tests_flow_sliced": group_sql(),
    "feature_tests_flow": f"SELECT feature, feature_type, n_groups, effect_size FROM ({group_sql()}) UNION ALL SELECT * FROM (WITH {FLOW_SQL} SELECT 'week', 'numeric', NULL, round(pow(corr(value, week), 2), 6) FROM flow)",
    "feature_test_warnings_flow": f"SELECT 'small_groups' AS code, 'warning' AS severity, feature AS \"column\" FROM ({group_sql()}) WHERE small_groups > 0",
    "regression_two_numbers_summary": _NUMBERS["summary"],
    "regression_two_numbers_terms": _NUMBERS["terms"],
    "regression_two_numbers_coefficients": _NUMBERS["coefficients"],
    "regression_wide_parts": """WITH w AS (SELECT l_extendedprice AS p, l_partkey, l_quantity - avg(l_quantity) OVER g AS x, l_extendedprice - avg(l_extendedprice) OVER g AS y
        FROM lineitem WINDOW g AS (PARTITION BY l_partkey)),
      s AS (SELECT sum(x * x) AS sxx, sum(x * y) AS sxy, sum(y * y) AS syy, count(*) AS n, count(DISTINCT l_partkey) AS k, var_pop(p) * count(*) AS tot FROM w)
      SELECT 'l_quantity' AS term, round(sxy / sxx, 4) AS estimate, round(sqrt((syy - sxy * sxy / sxx) / (n - k - 1) / sxx), 4) AS std_error,
        round(1 - (syy - sxy * sxy / sxx) / tot, 6) AS r_squared, n AS n_obs FROM s""",
    "regression_two_wide": two_wide_sql(),
    "regression_lone_wide": """WITH g AS (SELECT CAST(l_orderkey AS VARCHAR) AS k, count(*) AS n, avg(l_extendedprice) AS m, var_pop(l_extendedprice) * count(*) AS ss FROM lineitem GROUP BY ALL),
      w AS (SELECT sum(ss) / (sum(n) - count(*)) AS s2, min(k) AS low FROM g), b AS (SELECT g.n, g.m FROM g, w WHERE k = low)
      SELECT 'order[' || k || ']' AS term, round(g.m - b.m, 6) AS estimate, round(sqrt(s2 * (1.0 / g.n + 1.0 / b.n)), 4) AS std_error FROM g, w, b WHERE k <> low""",
    "regression_flow_terms": flow_terms_sql(),
    "regression_label_summary": _LABEL["summary"],
    "regression_label_terms": _LABEL["terms"],
    "regression_label_coefficients": _LABEL["coefficients"],
    "target_outliers_flow": f"""WITH {FLOW_SQL}, q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM flow)
      SELECT 'target_outliers' AS code, 'warning' AS severity, 'value' AS "column" FROM flow, q WHERE value IS NOT NULL
      HAVING avg(CASE WHEN value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a) THEN 1.0 ELSE 0.0 END) > 0.05""",
    "target_stats_flow": f"""WITH {FLOW_SQL} SELECT count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS min,
      round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75, max(value) AS max FROM flow""",
    "target_overview_pearson": f"WITH {FLOW_SQL} SELECT 'week' AS feature, round(corr(week, value), 6) AS pearson FROM flow",
}


def _flow_histogram():
    from queries.profiling import HISTOGRAM_SQL

    body = HISTOGRAM_SQL.format(raw="SELECT 'value' AS \"column\", value AS v FROM flow").strip()[len("WITH "):]
    return f"WITH {FLOW_SQL}, {body}"


SQL["target_overview_histogram"] = _flow_histogram()
SQL["box_groups_flow"] = f"""WITH {FLOW_SQL}, r AS (SELECT 'Size' AS feature, Size AS "group", value AS v FROM flow UNION ALL SELECT 'Type', Type, value FROM flow),
q AS (SELECT feature, "group", count(*) AS n, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.75) AS b FROM r GROUP BY ALL)
SELECT feature, "group", any_value(n) AS n, round(any_value(p50), 6) AS p50, count(*) FILTER (v < a - 1.5 * (b - a) OR v > b + 1.5 * (b - a)) AS outlier_count
FROM r JOIN q USING (feature, "group") GROUP BY ALL"""
