"""SQL texts of the statistics, by the textbook formulas over ranked rows.

Tail probabilities come from closed forms or numeric integration of the density, the
bootstrap from the same whole-number row weights.
"""

from __future__ import annotations

from .. import config
from ..operators.bootstrap import LIMITS, PRIME
from .base import r6

B, SEED = config.BOOTSTRAP_RESAMPLES, config.BOOTSTRAP_SEED


def avg_rank(value: str, by: str) -> str:
    return (f"(rank() OVER (PARTITION BY {by} ORDER BY {value}) "
            f"+ (count(*) OVER (PARTITION BY {by}, {value}) - 1) / 2.0::DOUBLE)")


def tail_integral(density: str, steps: int = 4000) -> str:
    """Integral of a density in u from [x] to infinity, by Simpson's rule in v = x + v / (1 - v).

    The upper end of v is 1, where the densities used here vanish.
    """
    h = f"(1.0::DOUBLE / {steps})"
    inner = density.replace("[u]", f"([x] + i * {h} / (1 - i * {h}))")
    terms = (f"list_transform(range(0, {steps}), lambda i: "
             f"(CASE WHEN i = 0 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) "
             f"* ({inner}) / ((1 - i * {h}) * (1 - i * {h})))")
    return f"(list_sum({terms}) * {h} / 3)"


def normal_p(z: str) -> str:
    """Scaled by the density at the end of the tail, so that small ones keep their digits."""
    value = tail_integral("exp(-([u] - [x]) * ([u] + [x]) / 2)").replace("[x]", f"abs({z})")
    return f"CASE WHEN {z} IS NOT NULL THEN 2 * {value} * exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) END"


def t_p(t: str, dof: str) -> str:
    nu = f"CAST({dof} AS DOUBLE)"
    front = f"exp(lgamma(({nu} + 1) / 2) - lgamma({nu} / 2)) / sqrt({nu} * pi())"
    density = f"power(1 + [u] * [u] / {nu}, -({nu} + 1) / 2)"
    value = tail_integral(density).replace("[x]", f"abs({t})")
    return f"CASE WHEN {t} IS NOT NULL THEN 2 * {front} * {value} END"


def corr_p(r: str, n: str) -> str:
    return t_p(f"({r} * sqrt(({n} - 2) / (1 - {r} * {r})))", f"({n} - 2)")


def chi2_p(x: str, dof: str) -> str:
    """Closed forms for one to six degrees of freedom."""
    root = normal_p(f"sqrt({x})")
    e = f"exp(-({x}) / 2)"
    odd = f"sqrt(2 * ({x}) / pi()) * {e}"
    return (f"CASE {dof} WHEN 1 THEN {root} WHEN 2 THEN {e} "
            f"WHEN 3 THEN {root} + {odd} WHEN 5 THEN {root} + {odd} * (1 + ({x}) / 3) "
            f"WHEN 4 THEN {e} * (1 + ({x}) / 2) "
            f"WHEN 6 THEN {e} * (1 + ({x}) / 2 + ({x}) * ({x}) / 8) END")


def spearman(src: str, x: str, y: str, by: str) -> str:
    ranked = (f"SELECT *, {avg_rank(x, by)} AS rx, {avg_rank(y, by)} AS ry FROM ({src}) "
              f"WHERE {x} IS NOT NULL AND {y} IS NOT NULL")
    inner = f"SELECT {by}, count(*) AS n, corr(rx, ry) AS rho FROM ({ranked}) GROUP BY {by}"
    return f"SELECT *, {corr_p('rho', 'n')} AS p FROM ({inner})"


def pearson(src: str, x: str, y: str, by: str) -> str:
    inner = (f"SELECT {by}, count(*) AS n, corr({x}, {y}) AS r FROM ({src}) "
             f"WHERE {x} IS NOT NULL AND {y} IS NOT NULL GROUP BY {by}")
    return f"SELECT *, {corr_p('r', 'n')} AS p FROM ({inner})"


def c_index(src: str, score: str, y: str, by: str) -> str:
    """All pairs compared, per group (one grouping column)."""
    return (f"SELECT a.{by}, (SELECT count(*) FROM ({src}) z WHERE z.{by} = a.{by}) AS n, "
            "count(*) AS permissible, "
            f"sum(CASE WHEN a.{score} > b.{score} THEN 1.0 WHEN a.{score} = b.{score} THEN 0.5 "
            f"ELSE 0 END) / count(*) AS c_index FROM ({src}) a JOIN ({src}) b "
            f"ON a.{by} = b.{by} AND a.{y} < b.{y} GROUP BY a.{by}")


def auroc(src: str, score: str, event: str, by: str) -> str:
    """n, events, auroc from the rank sum of the events."""
    ranked = (f"SELECT *, {avg_rank(score, by)} AS r FROM ({src}) "
              f"WHERE {score} IS NOT NULL AND {event} IS NOT NULL")
    p, q = f"sum({event})", f"(count(*) - sum({event}))"
    return (f"SELECT {by}, count(*) AS n, CAST({p} AS BIGINT) AS events, "
            f"CASE WHEN {p} > 0 AND {q} > 0 THEN (sum(r * {event}) - {p} * ({p} + 1) / 2) "
            f"/ ({p} * CAST({q} AS DOUBLE)) END AS auroc FROM ({ranked}) GROUP BY {by}")


def curve(src: str, score: str, event: str, by: str) -> str:
    """Per score value: tp, fp, class totals, precision, recall step."""
    hist = (f"SELECT {by}, {score} AS s, CAST(sum({event}) AS BIGINT) AS p, "
            f"CAST(sum(1 - {event}) AS BIGINT) AS q FROM ({src}) "
            f"WHERE {score} IS NOT NULL AND {event} IS NOT NULL GROUP BY {by}, s")
    win = f"OVER (PARTITION BY {by} ORDER BY s DESC)"
    return (f"SELECT {by}, CAST(s AS DOUBLE) AS threshold, p, CAST(sum(p) {win} AS BIGINT) AS tp, "
            f"CAST(sum(q) {win} AS BIGINT) AS fp, CAST(sum(p) OVER (PARTITION BY {by}) AS BIGINT) AS p_total, "
            f"CAST(sum(q) OVER (PARTITION BY {by}) AS BIGINT) AS q_total FROM ({hist})")


def auprc(src: str, score: str, event: str, by: str) -> str:
    return (f"SELECT {by}, sum(p / CAST(p_total AS DOUBLE) * tp / (tp + fp)) AS auprc "
            f"FROM ({curve(src, score, event, by)}) GROUP BY {by}")


def roc_points(src: str, score: str, event: str, by: str) -> str:
    points = curve(src, score, event, by)
    return (f"SELECT {by}, threshold, tp, fp, tp / CAST(p_total AS DOUBLE) AS tpr, "
            f"fp / CAST(q_total AS DOUBLE) AS fpr, p_total, q_total FROM ({points}) "
            f"UNION ALL SELECT DISTINCT {by}, CAST(NULL AS DOUBLE), 0, 0, 0.0, 0.0, p_total, q_total "
            f"FROM ({points})")


def youden(src: str, score: str, event: str, by: str) -> str:
    return (f"SELECT {by}, threshold, tpr AS sensitivity, 1 - fpr AS specificity, "
            f"tpr - fpr AS youden_j FROM ({roc_points(src, score, event, by)}) "
            f"WHERE threshold IS NOT NULL AND p_total > 0 AND q_total > 0 QUALIFY row_number() OVER (PARTITION BY {by} "
            "ORDER BY CAST(tp AS HUGEINT) * q_total - CAST(fp AS HUGEINT) * p_total DESC, "
            "threshold DESC) = 1")


def operating_point(src: str, score: str, event: str, cut: int, by: str) -> str:
    return (f"SELECT {by}, sum(CASE WHEN {event} = 1 AND {score} >= {cut} THEN 1.0 ELSE 0 END) "
            f"/ sum({event}) AS sensitivity, sum(CASE WHEN {event} = 0 AND {score} < {cut} "
            f"THEN 1.0 ELSE 0 END) / sum(1 - {event}) AS specificity FROM ({src}) GROUP BY {by}")


def kruskal(src: str, group: str, y: str, by: str) -> str:
    ranked = (f"SELECT *, {avg_rank(y, by)} AS r, count(*) OVER (PARTITION BY {by}, {y}) AS t, "
              f"count(*) OVER (PARTITION BY {by}) AS big FROM ({src}) "
              f"WHERE {y} IS NOT NULL AND {group} IS NOT NULL")
    sums = (f"SELECT {by}, {group}, max(big) AS big, count(*) AS n, sum(r) AS rs, "
            f"sum(CAST(t AS DOUBLE) * t - 1) AS tt FROM ({ranked}) GROUP BY {by}, {group}")
    big = "CAST(max(big) AS DOUBLE)"
    h = (f"(12 / ({big} * ({big} + 1)) * sum(rs * rs / n) - 3 * ({big} + 1)) "
         f"/ (1 - sum(tt) / ({big} * {big} * {big} - {big}))")
    inner = (f"SELECT {by}, max(big) AS n, count(*) AS groups, {h} AS h FROM ({sums}) GROUP BY {by}")
    return f"SELECT *, {chi2_p('h', '(groups - 1)')} AS p FROM ({inner})"


def chi_square(src: str, row: str, column: str, by: str) -> str:
    """Full table with its empty cells; corrected for one degree of freedom only."""
    clean = f"SELECT {by}, {row} AS rr, {column} AS cc FROM ({src}) WHERE {row} IS NOT NULL AND {column} IS NOT NULL"
    rows = f"SELECT {by}, rr, count(*) AS rn FROM ({clean}) GROUP BY {by}, rr"
    cols = f"SELECT {by}, cc, count(*) AS cn FROM ({clean}) GROUP BY {by}, cc"
    cells = f"SELECT {by}, rr, cc, count(*) AS o FROM ({clean}) GROUP BY {by}, rr, cc"
    keys = [k.strip() for k in by.split(",")]
    same = " AND ".join(f"r.{k} = c.{k}" for k in keys)
    same_x = " AND ".join(f"x.{k} = r.{k}" for k in keys)
    picked = ", ".join(f"r.{k}" for k in keys)
    full = (f"SELECT {picked}, r.rr, c.cc, COALESCE(x.o, 0) AS o, rn, cn FROM ({rows}) r "
            f"JOIN ({cols}) c ON {same} LEFT JOIN ({cells}) x ON {same_x} AND x.rr = r.rr AND x.cc = c.cc")
    expected = (f"SELECT *, rn * CAST(cn AS DOUBLE) / sum(o) OVER (PARTITION BY {by}) AS e FROM ({full})")
    inner = (f"SELECT {by}, CAST(sum(o) AS BIGINT) AS n, (count(DISTINCT rr) - 1) * (count(DISTINCT cc) - 1) AS dof, "
             "sum((o - e) * (o - e) / e) AS plain, "
             f"sum(power(greatest(abs(o - e) - 0.5, 0), 2) / e) AS corrected FROM ({expected}) GROUP BY {by}")
    stat = f"SELECT {by}, n, dof, CASE WHEN dof = 1 THEN corrected WHEN dof > 1 THEN plain END AS chi2 FROM ({inner})"
    return f"SELECT *, {chi2_p('chi2', 'dof')} AS p FROM ({stat})"


def t_test(src: str, group: str, y: str, first: str, by: str) -> str:
    m = (f"SELECT {by}, count(*) FILTER (WHERE {group} = '{first}') AS n1, "
         f"count(*) FILTER (WHERE {group} <> '{first}') AS n2, "
         f"avg({y}) FILTER (WHERE {group} = '{first}') AS m1, avg({y}) FILTER (WHERE {group} <> '{first}') AS m2, "
         f"var_samp({y}) FILTER (WHERE {group} = '{first}') AS v1, "
         f"var_samp({y}) FILTER (WHERE {group} <> '{first}') AS v2 FROM ({src}) WHERE {y} IS NOT NULL GROUP BY {by}")
    inner = (f"SELECT {by}, n1 + n2 AS n, CAST(n1 + n2 - 2 AS DOUBLE) AS dof, (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) "
             f"/ (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)) AS t FROM ({m})")
    return f"SELECT *, {t_p('t', 'dof')} AS p FROM ({inner})"


def mann_whitney(src: str, group: str, y: str, first: str, by: str) -> str:
    ranked = (f"SELECT *, {avg_rank(y, by)} AS r, count(*) OVER (PARTITION BY {by}, {y}) AS t "
              f"FROM ({src}) WHERE {y} IS NOT NULL")
    sums = (f"SELECT {by}, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE {group} = '{first}') AS DOUBLE) AS n1, "
            f"sum(r) FILTER (WHERE {group} = '{first}') AS r1, sum(CAST(t AS DOUBLE) * t - 1) AS tt "
            f"FROM ({ranked}) GROUP BY {by}")
    u = (f"SELECT *, r1 - n1 * (n1 + 1) / 2 AS u, n1 * (n - n1) AS mn FROM ({sums})")
    z = (f"SELECT {by}, CAST(n AS BIGINT) AS n, u, greatest(abs(u - mn / 2) - 0.5, 0) / sqrt(mn * (n + 1) / 12 "
         f"* (1 - tt / (n * n * n - n))) AS z FROM ({u})")
    return f"SELECT *, {normal_p('z')} AS p FROM ({z})"


def anova(src: str, group: str, y: str, by: str) -> str:
    """F for three groups, where the tail has a closed form."""
    rows = (f"SELECT *, avg({y}) OVER (PARTITION BY {by}) AS g, avg({y}) OVER (PARTITION BY {by}, {group}) AS m "
            f"FROM ({src}) WHERE {y} IS NOT NULL")
    inner = (f"SELECT {by}, count(*) AS n, count(DISTINCT {group}) AS groups, "
             f"(sum(power(m - g, 2)) / (count(DISTINCT {group}) - 1)) "
             f"/ (sum(power({y} - m, 2)) / (count(*) - count(DISTINCT {group}))) AS f FROM ({rows}) GROUP BY {by}")
    return f"SELECT *, power(1 + 2 * f / (n - groups), -(n - groups) / 2.0::DOUBLE) AS p FROM ({inner})"


# --- bootstrap ---------------------------------------------------------------------

def replicates(src: str, columns: str, resamples: int = B, seed: int = SEED,
               row_id: str = "stay_id") -> str:
    p = PRIME
    text = (f"SELECT {columns}, ({row_id} + ({row_id} >> 31) * 40692) % {p} AS a_, CAST(b AS BIGINT) AS b "
            f"FROM ({src}) JOIN (SELECT unnest(range(1, {resamples + 1})) AS b) ON TRUE")
    text = f"SELECT *, (a_ * 48271 + b * 69621 + {seed}) % {p} AS x1 FROM ({text})"
    text = f"SELECT *, (x1 * x1 + a_) % {p} AS x2 FROM ({text})"
    text = f"SELECT *, (x2 * 16807 + b * 39373) % {p} AS x3 FROM ({text})"
    text = f"SELECT *, (x3 * x3 + b) % {p} AS x4 FROM ({text})"
    text = f"SELECT *, (x4 * 48271 + 11) % {p} AS x5 FROM ({text})"
    cases = " ".join(f"WHEN x5 < {limit} THEN {k}" for k, limit in enumerate(LIMITS))
    return f"SELECT {columns}, b, CASE {cases} ELSE {len(LIMITS)} END AS w FROM ({text})"


def interval(values: str, metric: str, by: str, low: str = "ci_low", high: str = "ci_high") -> str:
    return (f"SELECT {by}, CASE WHEN count({metric}) >= 50 THEN quantile_cont({metric}, 0.025) END AS {low}, "
            f"CASE WHEN count({metric}) >= 50 THEN quantile_cont({metric}, 0.975) END AS {high}, "
            f"count({metric}) AS n_valid FROM ({values}) GROUP BY {by}")


def boot_auroc(src: str, score: str, event: str, by: str, resamples: int = B) -> str:
    """by, b, auroc, auprc from the summed row weights per score and class."""
    rows = replicates(f"SELECT * FROM ({src}) WHERE {event} IS NOT NULL AND {score} IS NOT NULL",
                      f"{by}, {score} AS s, {event} AS e", resamples)
    rows = rows.replace(f"SELECT {by}, {score} AS s, {event} AS e, b, CASE", f"SELECT {by}, s, e, b, CASE")
    hist = (f"SELECT {by}, b, s, sum(w * e) AS p, sum(w * (1 - e)) AS q "
            f"FROM ({rows}) WHERE w > 0 GROUP BY {by}, b, s")
    win = f"OVER (PARTITION BY {by}, b ORDER BY s DESC)"
    run = (f"SELECT *, sum(p) {win} AS tp, sum(q) {win} AS fp, sum(p) OVER (PARTITION BY {by}, b) AS pt, "
           f"sum(q) OVER (PARTITION BY {by}, b) AS qt FROM ({hist})")
    return (f"SELECT {by}, b, CASE WHEN max(pt) > 0 AND max(qt) > 0 THEN "
            f"CAST(sum(q * (tp - p + p / 2.0)) AS DOUBLE) / max(CAST(pt AS DOUBLE) * qt) END AS auroc, "
            f"CASE WHEN max(pt) > 0 AND max(qt) > 0 THEN sum(p / CAST(pt AS DOUBLE) * tp / (tp + fp)) END AS auprc "
            f"FROM ({run}) GROUP BY {by}, b")


def boot_spearman(src: str, x: str, y: str, by: str, resamples: int = B) -> str:
    rows = replicates(f"SELECT * FROM ({src}) WHERE {x} IS NOT NULL AND {y} IS NOT NULL",
                      f"{by}, {x}, {y}", resamples)
    cells = (f"SELECT {by}, b, {x} AS x, {y} AS y, CAST(sum(w) AS DOUBLE) AS w FROM ({rows}) "
             f"WHERE w > 0 GROUP BY {by}, b, x, y")

    def rank(v: str) -> str:
        return (f"sum(w) OVER (PARTITION BY {by}, b ORDER BY {v}) "
                f"- (sum(w) OVER (PARTITION BY {by}, b, {v}) - 1) / 2 "
                f"- (sum(w) OVER (PARTITION BY {by}, b) + 1) / 2")

    ranked = f"SELECT {by}, b, w, {rank('x')} AS rx, {rank('y')} AS ry FROM ({cells})"
    return (f"SELECT {by}, b, sum(w * rx * ry) / nullif(sqrt(sum(w * rx * rx) * sum(w * ry * ry)), 0) AS spearman "
            f"FROM ({ranked}) GROUP BY {by}, b")


def boot_pearson(src: str, x: str, y: str, by: str, resamples: int = B) -> str:
    rows = replicates(f"SELECT * FROM ({src}) WHERE {x} IS NOT NULL AND {y} IS NOT NULL",
                      f"{by}, {x}, {y}", resamples)
    cov = f"(sum(w * {x} * {y}) - sum(w * {x}) * sum(w * {y}) / sum(w))"
    vx = f"(sum(w * {x} * {x}) - sum(w * {x}) * sum(w * {x}) / sum(w))"
    vy = f"(sum(w * {y} * {y}) - sum(w * {y}) * sum(w * {y}) / sum(w))"
    typed = f"SELECT {by}, b, CAST({x} AS DOUBLE) AS {x}, {y}, CAST(w AS DOUBLE) AS w FROM ({rows})"
    return f"SELECT {by}, b, {cov} / sqrt({vx} * {vy}) AS pearson FROM ({typed}) GROUP BY {by}, b"


def boot_c_index(src: str, x: str, y: str, by: str, resamples: int = B) -> str:
    """Running weight of each higher score level below an outcome, per replicate."""
    rows = replicates(src, f"{by}, {x}, {y}", resamples)
    cells = (f"SELECT {by}, b, {x} AS x, {y} AS y, CAST(sum(w) AS DOUBLE) AS w FROM ({rows}) "
             f"WHERE w > 0 GROUP BY {by}, b, x, y")
    spread = (f"SELECT {by}, b, y, x AS j, 0.0::DOUBLE AS add_, w AS ask FROM ({cells}) UNION ALL "
              f"SELECT {by}, b, y, unnest(range(0, x)) AS j, w, 0.0 FROM ({cells})")
    sums = f"SELECT {by}, b, j, y, sum(add_) AS add_, sum(ask) AS ask FROM ({spread}) GROUP BY {by}, b, j, y"
    run = f"SELECT *, sum(add_) OVER (PARTITION BY {by}, b, j ORDER BY y) - add_ AS below FROM ({sums})"
    conc = f"SELECT {by}, b, sum(ask * below) AS conc FROM ({run}) GROUP BY {by}, b"

    def squares(keys: str, name: str) -> str:
        return (f"SELECT {by}, b, sum(n * n) / 2 AS {name} FROM (SELECT {by}, b, sum(w) AS n "
                f"FROM ({cells}) GROUP BY {by}, b{keys}) GROUP BY {by}, b")

    keys = ", ".join([*(k.strip() for k in by.split(",")), "b"])
    return (f"SELECT {by}, b, (conc + (same_x - same_xy) / 2) / (same - same_y) AS c_index FROM ({conc}) "
            f"JOIN ({squares('', 'same')}) USING ({keys}) JOIN ({squares(', x', 'same_x')}) USING ({keys}) "
            f"JOIN ({squares(', y', 'same_y')}) USING ({keys}) JOIN ({squares(', x, y', 'same_xy')}) USING ({keys})")


def rounded_select(sql: str, plain: list[str], doubles: list[str]) -> str:
    return f"SELECT {', '.join([*plain, *[r6(c, c) for c in doubles]])} FROM ({sql})"
