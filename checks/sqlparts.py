"""Building blocks of the SQL twins: views, keyed hashes and recurring sub-queries."""

from __future__ import annotations

import itertools
from hashlib import md5

ARROW = "→"
CODES = ["IMP", "OUT", "LNR", "BAL"]
ORDERS = [ARROW.join(p) for p in itertools.permutations(CODES)]
PRIME = 2147483647


def h(*keys) -> str:
    """Hex digest of the keys; string arguments are SQL expressions, numbers literals."""
    return "md5(concat_ws('|', " + ", ".join(f"'{k}'" if isinstance(k, int) else k for k in keys) + "))"


def u(*keys) -> str:
    return f"(('0x' || substr({h(*keys)}, 1, 13))::BIGINT / 4503599627370496.0)"


def with_(*parts: str) -> str:
    """Join CTE definitions and a final body."""
    *ctes, body = parts
    return "WITH " + ",\n".join(ctes) + "\n" + body


ORDERS24 = "orders24(id, cleaning_order) AS (VALUES " + ", ".join(f"({i}, '{o}')" for i, o in enumerate(ORDERS)) + ")"

OF = """order_features AS (
  SELECT o_orderkey AS row_id, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label,
    o_totalprice AS x_total, q AS x_qty, p AS x_price, d AS x_disc, t AS x_tax,
    CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS c_prio,
    CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INTEGER) AS c_seg
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS q, round(avg(l_extendedprice), 6) AS p,
      round(avg(l_discount), 6) AS d, round(avg(l_tax), 6) AS t FROM lineitem GROUP BY l_orderkey) l
    ON l_orderkey = o_orderkey)"""

DF = """doc_features AS (
  SELECT doc_id AS row_id, toxic AS label, CAST(n_chars AS DOUBLE) AS x_chars,
    CAST(length(text) - length(replace(text, ' ', '')) AS DOUBLE) AS x_spaces,
    CAST(length(regexp_replace(text, '[^0-9]', '', 'g')) AS DOUBLE) AS x_digits,
    CAST(dense_rank() OVER (ORDER BY lang) - 1 AS INTEGER) AS c_lang
  FROM documents JOIN labels USING (doc_id))"""

VECS = [f"x_{i:02d}" for i in range(64)]
VF = "vec_features AS (SELECT vec_id AS row_id, CAST(label = 0 AS INTEGER) AS label, " + ", ".join(
    f"CAST(embedding[{i + 1}] AS DOUBLE) AS {c}" for i, c in enumerate(VECS)
) + " FROM embeddings)"

_CLF = "CASE l_returnflag WHEN 'A' THEN 'logistic_regression' WHEN 'N' THEN 'random_forest' ELSE 'xgboost' END"


def runs(name: str = "runs", measure: str = "l_discount", scale: float = 5.0, coarse: bool = False, seeds: int = 5) -> str:
    score = f"round(0.5 + {scale} * avg({measure}), 6)"
    score = f"floor(100 * {score} + 0.001) / 100" if coarse else score
    return f"""{name} AS (
  SELECT 'ds' || (l_suppkey % 10) AS dataset, {_CLF} AS classifier, CAST(42 + l_orderkey % {seeds} AS INTEGER) AS seed,
    o.cleaning_order, {score} AS balanced_accuracy, false AS failed
  FROM lineitem JOIN orders24 o ON l_partkey % 24 = o.id GROUP BY 1, 2, 3, 4)"""


RUNS = runs()

DETAILED = f"""base_runs AS (
  SELECT 'ds' || (l_suppkey % 10) AS dataset, {_CLF} AS classifier, CAST(42 + l_orderkey % 5 AS INTEGER) AS seed,
    o.cleaning_order, round(0.5 + 5 * avg(l_discount), 6) AS score,
    CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS n_relabelled, count(*) AS lines
  FROM lineitem JOIN orders24 o ON l_partkey % 24 = o.id GROUP BY 1, 2, 3, 4),
detailed AS (
  SELECT dataset, classifier, seed, cleaning_order, CASE WHEN substr(tag, 1, 2) <> '00' THEN score END AS balanced_accuracy,
    substr(tag, 1, 2) = '00' AS failed, n_relabelled, lines % 4 = 0 AS smote_skipped,
    CASE WHEN dataset IN ('ds0', 'ds1') THEN 0 ELSE lines END AS imputation__n_imputed,
    CASE WHEN classifier = 'logistic_regression' THEN substr(tag, 3, 1) <> '0' END AS converged
  FROM (SELECT *, md5(concat_ws('|', dataset, classifier, seed, cleaning_order)) AS tag FROM base_runs))"""

COARSE = """coarse AS (
  SELECT l_returnflag AS dataset, 'random_forest' AS classifier, CAST(l_linenumber AS INTEGER) AS seed, o.cleaning_order,
    round(0.5 + 5 * avg(l_discount), 6) AS balanced_accuracy, false AS failed
  FROM lineitem JOIN orders24 o ON l_partkey % 24 = o.id GROUP BY 1, 2, 3, 4)"""

AUDIT = """run_audit AS (
  SELECT 'ds' || (l_suppkey % 10) AS dataset,
    avg(CASE WHEN l_linestatus = 'F' AND l_quantity <= 25 THEN 1.0 ELSE 0.0 END) AS minority_share
  FROM lineitem GROUP BY 1)"""


def complete(source: str = "runs", out: str = "complete") -> str:
    """Runs of (dataset, classifier) groups with every order for every seed."""
    return f"""{out} AS (
  SELECT r.* FROM {source} r JOIN (
    SELECT dataset, classifier FROM (
      SELECT dataset, classifier, count(DISTINCT (cleaning_order, seed)) AS present FROM {source} GROUP BY 1, 2)
    JOIN (SELECT dataset, count(DISTINCT cleaning_order) * count(DISTINCT seed) AS expected FROM {source} GROUP BY 1)
      USING (dataset) WHERE present >= expected) USING (dataset, classifier))"""


def osi(source: str, out: str = "osi", by: str = "dataset, classifier") -> str:
    """Best and worst order per group, ties to the first order."""
    return f"""{out}_m AS (SELECT {by}, cleaning_order, round(avg(balanced_accuracy), 12) AS mean,
    stddev_samp(balanced_accuracy) AS sd, count(*) AS n FROM {source} GROUP BY ALL),
{out}_r AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY mean DESC, cleaning_order) AS rb,
    row_number() OVER (PARTITION BY {by} ORDER BY mean, cleaning_order) AS rw FROM {out}_m),
{out} AS (SELECT {by}, count(*) AS n_orderings, max(n) AS n_seeds,
    max(CASE WHEN rb = 1 THEN cleaning_order END) AS best_order, max(CASE WHEN rb = 1 THEN mean END) AS best_mean,
    max(CASE WHEN rb = 1 THEN sd END) AS best_sd, max(CASE WHEN rw = 1 THEN cleaning_order END) AS worst_order,
    max(CASE WHEN rw = 1 THEN mean END) AS worst_mean, max(CASE WHEN rw = 1 THEN sd END) AS worst_sd
  FROM {out}_r GROUP BY {by})"""


def permutation(source: str, draws: int, by: str = "dataset, classifier", out: str = "perm") -> str:
    """Permutation null by the integer hash: osi_null, p_osi, gap, p_gap per group."""
    def fifth(x: str) -> str:
        return f"((({x} * {x} % {PRIME}) * ({x} * {x} % {PRIME}) % {PRIME}) * {x} % {PRIME})"

    return f"""{out}_c AS (SELECT {by}, seed, cleaning_order, balanced_accuracy AS s,
    dense_rank() OVER (PARTITION BY {by} ORDER BY seed) - 1 AS si,
    dense_rank() OVER (PARTITION BY {by} ORDER BY cleaning_order) - 1 AS oi FROM {source}),
{out}_d AS (SELECT {by}, count(DISTINCT seed) AS ns, count(DISTINCT cleaning_order) AS k,
    ('0x' || substr(md5(concat_ws('|', {by})), 1, 7))::BIGINT AS g FROM {source} GROUP BY {by}),
{out}_o AS (SELECT {by}, max(m) AS best, min(m) AS worst FROM (
    SELECT {by}, cleaning_order, avg(balanced_accuracy) AS m FROM {source} GROUP BY ALL) GROUP BY {by}),
{out}_0 AS (SELECT *, (((b * ns + si) * k + oi) + 1013904223) % {PRIME} AS x
    FROM {out}_c JOIN {out}_d USING ({by}) CROSS JOIN range(0, {draws}) AS t(b)),
{out}_1 AS (SELECT * EXCLUDE (x), ({fifth('x')} + g + 1664525) % {PRIME} AS x FROM {out}_0),
{out}_2 AS (SELECT * EXCLUDE (x), ({fifth('x')} + 22695477) % {PRIME} AS x FROM {out}_1),
{out}_3 AS (SELECT *, row_number() OVER (PARTITION BY {by}, b, seed ORDER BY {fifth('x')}, oi) AS pos FROM {out}_2),
{out}_4 AS (SELECT {by}, b, pos, sum(s) / max(ns) AS m FROM {out}_3 GROUP BY ALL),
{out}_5 AS (SELECT {by}, b, max(m) AS hi, min(m) AS lo FROM {out}_4 GROUP BY ALL),
{out} AS (SELECT {by}, max((best - worst) / best) AS osi, avg((hi - lo) / hi) AS osi_null,
    (1 + count(*) FILTER (WHERE (hi - lo) / hi >= (best - worst) / best - 1e-12)) / ({draws} + 1.0) AS p_osi,
    max(best - worst) AS gap,
    (1 + count(*) FILTER (WHERE hi - lo >= best - worst - 1e-12)) / ({draws} + 1.0) AS p_gap
  FROM {out}_5 JOIN {out}_o USING ({by}) GROUP BY {by})"""


def resampled(source: str, n_boot: int, seed: int = 42, out: str = "boot") -> str:
    """Seed bootstrap of a run table: adds `boot`; `seed` becomes the slot."""
    by = "dataset, classifier"
    return f"""{out}_s AS (SELECT {by}, seed, row_number() OVER (PARTITION BY {by} ORDER BY seed) - 1 AS pick
    FROM (SELECT DISTINCT {by}, seed FROM {source})),
{out}_n AS (SELECT {by}, count(*) AS size FROM {out}_s GROUP BY {by}),
{out}_p AS (SELECT {by}, boot, slot, CAST(floor({u(seed, 'dataset', 'classifier', 'boot', 'slot')} * size) AS BIGINT) AS pick
    FROM {out}_n CROSS JOIN range(1, {n_boot + 1}) AS b(boot) CROSS JOIN LATERAL (SELECT unnest(range(1, size + 1)) AS slot)),
{out} AS (SELECT {by}, boot, slot AS seed, cleaning_order, balanced_accuracy
    FROM {out}_p JOIN {out}_s USING ({by}, pick) JOIN {source} r USING ({by}, seed))"""


def bh(source: str, p: str, out_col: str, out: str, by: str = "") -> str:
    """False-discovery-rate adjustment of non-NULL p-values."""
    part = f"PARTITION BY {by}" if by else ""
    return f"""{out}_r AS (SELECT *, row_number() OVER ({part} ORDER BY {p}) AS rk, count(*) OVER ({part}) AS nn
    FROM {source} WHERE {p} IS NOT NULL),
{out}_a AS (SELECT *, min(least(1.0, {p} * nn / rk)) OVER ({part} ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    AS {out_col} FROM {out}_r),
{out} AS (SELECT * EXCLUDE (rk, nn) FROM {out}_a)"""


def holm(source: str, p: str, out_col: str, out: str) -> str:
    return f"""{out}_r AS (SELECT *, row_number() OVER (ORDER BY {p}) AS rk, count(*) OVER () AS nn FROM {source} WHERE {p} IS NOT NULL),
{out} AS (SELECT * EXCLUDE (rk, nn), max(least(1.0, {p} * (nn - rk + 1))) OVER (ORDER BY rk ROWS UNBOUNDED PRECEDING) AS {out_col}
    FROM {out}_r)"""


def signed_rank(source: str, by: str, d: str, out: str) -> str:
    """w_plus per group from average ranks of |d|, zeros dropped."""
    return f"""{out}_r AS (SELECT {by}, {d} AS d, rank() OVER (PARTITION BY {by} ORDER BY abs({d}))
      + (count(*) OVER (PARTITION BY {by}, abs({d})) - 1) / 2.0 AS rk FROM {source} WHERE {d} <> 0),
{out} AS (SELECT {by}, count(*) AS n, count(*) FILTER (WHERE d > 0) AS positive,
    coalesce(sum(rk) FILTER (WHERE d > 0), 0.0) AS w_plus FROM {out}_r GROUP BY {by})"""


def exact_p(source: str, by: str, out: str, greater: bool = False) -> str:
    """Exact signed-rank p by listing all sign patterns (small n only)."""
    p = "upper_tail" if greater else "least(1.0, 2 * least(lower_tail, upper_tail))"
    return f"""{out}_s AS (SELECT n, pattern, sum(CASE WHEN (pattern >> (r - 1)) & 1 = 1 THEN r ELSE 0 END) AS w
    FROM (SELECT DISTINCT n FROM {source}) CROSS JOIN LATERAL (SELECT unnest(range(0, CAST(1 << CAST(n AS INTEGER) AS BIGINT))) AS pattern)
    CROSS JOIN LATERAL (SELECT unnest(range(1, CAST(n AS BIGINT) + 1)) AS r) GROUP BY n, pattern),
{out}_t AS (SELECT {by}, avg(CASE WHEN w <= w_plus THEN 1.0 ELSE 0.0 END) AS lower_tail,
    avg(CASE WHEN w >= w_plus THEN 1.0 ELSE 0.0 END) AS upper_tail
  FROM {source} JOIN {out}_s USING (n) GROUP BY {by}),
{out} AS (SELECT {by}, {p} AS p FROM {out}_t)"""


def hodges_lehmann(source: str, by: str, d: str, out: str) -> str:
    """Median of pairwise means and the exact signed-rank interval (small n only)."""
    eq = " AND ".join(f"a.{c.strip()} = b.{c.strip()}" for c in by.split(","))
    sel = ", ".join(f"a.{c.strip()}" for c in by.split(","))
    return f"""{out}_i AS (SELECT {by}, {d} AS d, row_number() OVER (PARTITION BY {by} ORDER BY {d}) AS i FROM {source}),
{out}_w AS (SELECT {sel}, (a.d + b.d) / 2 AS w FROM {out}_i a JOIN {out}_i b ON {eq} AND a.i <= b.i),
{out}_k AS (SELECT {by}, w, row_number() OVER (PARTITION BY {by} ORDER BY w) AS pos, count(*) OVER (PARTITION BY {by}) AS m FROM {out}_w),
{out}_n AS (SELECT {by}, count(*) AS n, count(*) FILTER (WHERE d > 0) AS positive FROM {out}_i GROUP BY {by}),
{out}_s AS (SELECT n, pattern, sum(CASE WHEN (pattern >> (r - 1)) & 1 = 1 THEN r ELSE 0 END) AS w
    FROM (SELECT DISTINCT n FROM {out}_n) CROSS JOIN LATERAL (SELECT unnest(range(0, CAST(1 << CAST(n AS INTEGER) AS BIGINT))) AS pattern)
    CROSS JOIN LATERAL (SELECT unnest(range(1, CAST(n AS BIGINT) + 1)) AS r) GROUP BY n, pattern),
{out}_c AS (SELECT n, w, sum(count(*)) OVER (PARTITION BY n ORDER BY w) / sum(count(*)) OVER (PARTITION BY n) AS cdf
    FROM {out}_s GROUP BY n, w),
{out}_q AS (SELECT n, count(*) FILTER (WHERE cdf <= 0.025) AS k FROM {out}_c GROUP BY n),
{out} AS (SELECT {by}, any_value(n) AS n, any_value(positive) AS positive, quantile_cont(w, 0.5) AS hl_pp,
    max(CASE WHEN pos = k THEN w END) AS ci_lo_pp, max(CASE WHEN k > 0 AND pos = m - k + 1 THEN w END) AS ci_hi_pp
  FROM {out}_k JOIN {out}_n USING ({by}) JOIN {out}_q USING (n) GROUP BY {by})"""


def avg_rank(x: str, by: str) -> str:
    return (
        f"(rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0)"
    )


def friedman(source: str, out: str = "fr") -> str:
    by = "dataset, classifier"
    return f"""{out}_r AS (SELECT {by}, seed, cleaning_order, {avg_rank('balanced_accuracy', by + ', seed')} AS r,
    count(*) OVER (PARTITION BY {by}, seed, balanced_accuracy) AS t FROM {source}),
{out}_o AS (SELECT {by}, cleaning_order, sum(r) AS rs, sum(t * t - 1) AS ties, count(*) AS s FROM {out}_r GROUP BY ALL),
{out}_g AS (SELECT {by}, sum(rs * rs) AS ss, CAST(sum(ties) AS DOUBLE) AS ties, CAST(max(s) AS DOUBLE) AS s, CAST(count(*) AS DOUBLE) AS k
    FROM {out}_o GROUP BY {by}),
{out} AS (SELECT {by}, chi2 AS friedman_chi2, chi2 / (s * (k - 1)) AS kendall_w FROM (
    SELECT *, CASE WHEN 1 - ties / (s * (k * k * k - k)) > 0 THEN (12 / (s * k * (k + 1)) * ss - 3 * s * (k + 1)) / (1 - ties / (s * (k * k * k - k))) END AS chi2
    FROM {out}_g))"""


def pos(order: str, code: str) -> str:
    return f"coalesce(list_position(string_split({order}, '{ARROW}'), '{code}'), 0)"


def swapped(order: str) -> str:
    return (
        f"replace(replace(replace({order}, 'LNR', '#'), 'BAL', 'LNR'), '#', 'BAL')"
    )


def keyed_names(names: list[str], *key) -> list[str]:
    prefix = "|".join(map(str, key))
    return sorted(names, key=lambda n: (md5(f"{prefix}|{n}".encode()).hexdigest(), n))
