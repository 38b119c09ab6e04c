"""DuckDB SQL with the same columns and values as each registered query.

Plain SQL over the plain tables: whole-key windows, direct quantiles, no blocks and no fitted objects.
"""

from __future__ import annotations

BASE = ("qty", "price", "tax")
LAGS = (1, 5, 21)
WINDOWS = (5, 21, 63)

SUPPLIER = """supplier AS (
  SELECT l_shipdate AS date, l_suppkey AS symbol, sum(l_quantity) AS qty,
    CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / (count(*) * 100.0) AS price,
    CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS DOUBLE)
      / nullif(count(*) FILTER (l_tax <> 0) * 100.0, 0) AS tax,
    CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) - sum(CAST(round(l_tax * 100) AS BIGINT))
      AS DOUBLE) / (count(*) * 100.0) AS excess_return,
    CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) * 40 AS DOUBLE) / (count(*) * 100.0) - 1.0
      AS forecast
  FROM lineitem GROUP BY l_shipdate, l_suppkey)"""

PRIORITY = """priority AS (
  SELECT o_orderdate AS date, o_orderpriority AS symbol,
    CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / (count(*) * 100.0) AS close,
    count(*) AS volume
  FROM orders GROUP BY o_orderdate, o_orderpriority)"""

EVENT_TYPE = """priority AS (
  SELECT symbol, date, close FROM (
    SELECT event_type AS symbol, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS date, value AS close,
      row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC)
        AS k
    FROM events) WHERE k = 1)"""

KEYED = "(PARTITION BY symbol ORDER BY date)"


#: Columns of rates, far below 1, which are compared with eight digits.
SMALL_COLUMNS = ("tax", "excess_return")


def r(expression: str, digits: int, name: str) -> str:
    if name.startswith(SMALL_COLUMNS):
        digits = max(digits, 8)
    return f"round({expression} + 1e-{digits + 4}::DOUBLE, {digits}) + 0.0 AS {name}"


def rs(names, digits: int) -> str:
    return ", ".join(r(n, digits, n) for n in names)


def frame(rows: int) -> str:
    return f"(PARTITION BY symbol ORDER BY date ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"


def clipped(c: str, low: str, high: str) -> str:
    return f"CASE WHEN {c} IS NOT NULL THEN least(greatest({c}, {low}), {high}) END"


def winsorized(source: str, columns, bounds: str | None = None) -> str:
    """CTEs ``{source}_b`` (bounds) and ``{source}_w`` (clipped rows)."""
    quantiles = ", ".join(
        f"quantile_cont({c}, 0.01) AS {c}_lo, quantile_cont({c}, 0.99) AS {c}_hi" for c in columns
    )
    own = bounds or f"{source}_b"
    clips = ", ".join(f"{clipped(c, f'{c}_lo', f'{c}_hi')} AS {c}" for c in columns)
    made = "" if bounds else f"{source}_b AS (SELECT {quantiles} FROM {source}),\n"
    return f"{made}{source}_w AS (SELECT date, symbol, {clips} FROM {source}, {own})"


def history_columns(columns, lags=LAGS, windows=WINDOWS, order=KEYED, frames=frame) -> str:
    parts = [f"lag({c}, {k}) OVER {order} AS {c}_lag_{k}" for k in lags for c in columns]
    for w in windows:
        for c in columns:
            parts.append(f"avg({c}) OVER {frames(w)} AS {c}_roll_mean_{w}")
            parts.append(f"stddev_samp({c}) OVER {frames(w)} AS {c}_roll_std_{w}")
    return ", ".join(parts)


def history_names(columns, lags=LAGS, windows=WINDOWS) -> list[str]:
    names = [f"{c}_lag_{k}" for k in lags for c in columns]
    for w in windows:
        for c in columns:
            names += [f"{c}_roll_mean_{w}", f"{c}_roll_std_{w}"]
    return names


FEATURES = [*BASE, *history_names(BASE)]


def history(source: str) -> str:
    return f"{source}_h AS (SELECT *, {history_columns(BASE)} FROM {source}_w)"


def statistics(source: str, names, fill: str = "median") -> str:
    """CTEs with fill values (``_f``) and with moments of the filled columns (``_s``)."""
    fills = ", ".join(f"{fill}({c}) AS {c}_f" for c in names)
    moments = ", ".join(
        f"avg(coalesce({c}, {c}_f)) AS {c}_m, stddev_pop(coalesce({c}, {c}_f)) AS {c}_s"
        for c in names
    )
    return (
        f"{source}_f AS (SELECT {fills} FROM {source}),\n"
        f"{source}_s AS (SELECT {moments} FROM {source}, {source}_f)"
    )


def scaled(c: str) -> str:
    return f"(coalesce({c}, {c}_f) - {c}_m) / CASE WHEN {c}_s <= 1e-12 * greatest(1, abs({c}_m)) THEN 1 ELSE {c}_s END"


WINSOR = [*BASE, "excess_return"]
FITTED = f"{SUPPLIER}, {winsorized('supplier', WINSOR)},\n{history('supplier')},\n{statistics('supplier_h', FEATURES)}"


def split_fit(fill: str = "median") -> str:
    return f"""{SUPPLIER},
old AS (SELECT * FROM supplier WHERE date < TIMESTAMP '2000-01-01'),
new AS (SELECT * FROM supplier WHERE date >= TIMESTAMP '2000-01-01'),
{winsorized('old', WINSOR)}, {history('old')}, {statistics('old_h', FEATURES, fill)}"""


def matrix(source: str, fitted: str, digits: int = 4) -> str:
    columns = ", ".join(r(scaled(c), digits, c) for c in FEATURES)
    return (
        f"SELECT date, symbol, {r('excess_return', digits, 'excess_return')}, {columns} "
        f"FROM {source}, {fitted}_f, {fitted}_s"
    )


# -- elastic net: coordinate descent on the moments, one coordinate for each step of the recursion -----

LIGHT_ALPHA, LIGHT_L1 = 1e-4, 0.5


def design(source: str, fitted: str, name: str) -> str:
    """CTE of the scaled features and the target ``y``."""
    columns = ", ".join(f"{scaled(c)} AS {c}" for c in FEATURES)
    return (
        f"{name} AS MATERIALIZED (SELECT date, symbol, excess_return AS y, {columns} "
        f"FROM {source}, {fitted}_f, {fitted}_s)"
    )


def elastic_net(x: str, sweeps: int = 60, alpha: float = LIGHT_ALPHA, l1: float = LIGHT_L1) -> str:
    """CTEs: moments ``{x}_m`` of the design, descent ``{x}_cd`` and weights ``{x}_w`` (list w, b)."""
    p, a1, a2 = len(FEATURES), alpha * l1, alpha * (1 - l1)
    pairs = ", ".join(
        f"covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})) AS g_{i}_{j}"
        for i, a in enumerate(FEATURES)
        for j, b in enumerate(FEATURES[: i + 1])
    )
    rows = ", ".join(
        "[" + ", ".join(f"g_{max(i, j)}_{min(i, j)}" for j in range(p)) + "]" for i in range(p)
    )
    each = lambda expression: "[" + ", ".join(expression.format(c) for c in FEATURES) + "]"
    rho = "c[j] - list_dot_product(g[j], w) + g[j][j] * w[j]"
    return f"""{x}_v AS MATERIALIZED (SELECT {pairs},
  {each('covar_pop({0}, y) / stddev_pop({0})')} AS c, {each('stddev_pop({0})')} AS s,
  {each('avg({0})')} AS mu, avg(y) AS my, var_pop(y) AS vy FROM {x}),
{x}_m AS MATERIALIZED (SELECT [{rows}] AS g, c, s, mu, my, vy FROM {x}_v),
{x}_cd AS (
  SELECT 0 AS k, list_transform(c, lambda e: 0.0::DOUBLE) AS w FROM {x}_m
  UNION ALL
  SELECT k + 1, list_concat(list_concat(w[1:j - 1],
    [sign(rho) * greatest(abs(rho) - {a1!r}::DOUBLE, 0) / (g[j][j] + {a2!r}::DOUBLE)]), w[j + 1:])
  FROM (SELECT k, w, g, j, {rho} AS rho FROM (SELECT *, k % {p} + 1 AS j FROM {x}_cd, {x}_m)
    WHERE k < {p * sweeps})),
{x}_w AS MATERIALIZED (SELECT list_transform(list_zip(w, s), lambda e: e[1] / e[2]) AS w, w AS scaled, g, c, mu, my, vy
  FROM (SELECT w FROM {x}_cd ORDER BY k DESC LIMIT 1), {x}_m)"""


def forecast_of(x: str, fitted: str) -> str:
    """Forecast of each row of the design ``x`` by the weights of ``fitted``."""
    row = "[" + ", ".join(FEATURES) + "]"
    return f"SELECT date, symbol, y, my - list_dot_product(w, mu) + list_dot_product(w, {row}) AS forecast FROM {x}, {fitted}_w"


# -- strategy -------------------------------------------------------------------------------------

SIZED = f"""{SUPPLIER}, sized AS (
  SELECT symbol, date, excess_return, least(greatest(forecast, 0.0), 2.0) AS position FROM supplier),
flows AS (SELECT symbol, date, position * excess_return AS pnl FROM sized)"""


def curve(source: str, by: str | None, order: str = "date, symbol", value: str = "pnl") -> str:
    part = f"PARTITION BY {by} " if by else ""
    w = f"({part}ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"""eq AS (SELECT *, sum({value}) OVER {w} AS equity FROM {source}),
pk AS (SELECT *, max(equity) OVER {w} AS peak FROM eq),
dd AS (SELECT *, CASE WHEN peak <> 0 THEN equity / peak - 1
  WHEN equity < 0 THEN CAST('-infinity' AS DOUBLE) END AS drawdown FROM pk)"""


def sharpe(penalty: float, value: str = "pnl") -> str:
    return (
        f"CASE WHEN stddev_pop({value}) <= 1e-8 THEN 0.0 "
        f"ELSE avg({value}) / nullif(stddev_pop({value}), 0) - {penalty} * stddev_pop({value}) END"
    )


HIT = "avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END)"


def report(digits: int) -> str:
    return ", ".join(
        [
            r(sharpe(0.03), digits, "competition_sharpe"),
            r("sum(pnl)", digits, "total_return"),
            r("min(drawdown)", digits, "max_drawdown"),
            r(HIT, digits, "hit_rate"),
        ]
    )


# -- indicators -----------------------------------------------------------------------------------


def full(aggregate: str, c: str, n: int) -> str:
    return f"CASE WHEN count({c}) OVER {frame(n)} = {n} THEN {aggregate}({c}) OVER {frame(n)} END"


def bands(digits: int) -> str:
    mid, dev = full("avg", "close", 20), full("stddev_samp", "close", 20)
    return (
        f"{r(f'{mid} + 2 * {dev}', digits, 'BB_upper')}, {r(f'{mid} - 2 * {dev}', digits, 'BB_lower')}"
    )


DELTAS = f"""changed AS (SELECT *, close - lag(close) OVER {KEYED} AS delta FROM priority),
sides AS (SELECT *, CASE WHEN delta > 0 THEN delta ELSE 0 END AS gain,
  CASE WHEN delta < 0 THEN -delta ELSE 0 END AS loss FROM changed)"""


def rsi(n: int, digits: int, name: str) -> str:
    gain, loss = full("avg", "gain", n), full("avg", "loss", n)
    value = f"CASE WHEN {loss} <> 0 THEN 100 - 100 / (1 + {gain} / nullif({loss}, 0)) WHEN {gain} > 0 THEN 100 END"
    return r(value, digits, name)


def averages(column: str, windows, prefix: str, digits: int) -> str:
    return ", ".join(r(full("avg", column, n), digits, f"{prefix}_{n}") for n in windows)


def ema_cte(name: str, source: str, column: str, span: int) -> str:
    """Recursive definition, one row of each symbol after the other."""
    a = f"(2.0::DOUBLE / {span + 1})"
    return f"""{name} AS (
  SELECT symbol, k, {column} AS e FROM {source} WHERE k = 1
  UNION ALL
  SELECT s.symbol, s.k, {a} * s.{column} + (1 - {a}) * p.e
  FROM {name} p JOIN {source} s ON s.symbol = p.symbol AND s.k = p.k + 1)"""


TECHNICAL = (
    f"SELECT symbol, date, {r('close', 3, 'close')}, {averages('close', (20, 50), 'SMA', 3)}, "
    f"{bands(3)}, {rsi(14, 3, 'RSI')} FROM sides"
)


# -- splits ---------------------------------------------------------------------------------------


def folds(source: str, n_splits: int, test_size: int, gap: int) -> str:
    """CTE ``folds`` with ranks and dates per fold."""
    return f"""dates AS (
  SELECT date, row_number() OVER (ORDER BY date) AS k, count(*) OVER () AS n
  FROM (SELECT DISTINCT date FROM {source})),
ranks AS (
  SELECT CAST(f AS BIGINT) AS fold_id, CAST(1 AS BIGINT) AS train_start_rank,
    CAST(start - {gap} AS BIGINT) AS train_end_rank, CAST(start + 1 AS BIGINT) AS valid_start_rank,
    CAST(start + {test_size} AS BIGINT) AS valid_end_rank
  FROM (SELECT f, max(n) - ({n_splits} - f) * {test_size} AS start
    FROM dates, range({n_splits}) t(f) GROUP BY f)),
folds AS (
  SELECT ranks.*, a.date AS train_start, b.date AS train_end, c.date AS valid_start,
    d.date AS valid_end
  FROM ranks JOIN dates a ON a.k = train_start_rank JOIN dates b ON b.k = train_end_rank
  JOIN dates c ON c.k = valid_start_rank JOIN dates d ON d.k = valid_end_rank)"""


# -- walk-forward evaluation ------------------------------------------------------------------------

ALPHAS, L1_RATIOS = (1e-4, 2e-4, 5e-4, 1e-3, 2e-3), (0.2, 0.5, 0.8)


def grid_descent(x: str, grid: str, sweeps: int = 60) -> str:
    """CTEs ``{x}_gd``, ``{x}_gw``: like :func:`elastic_net`, all penalties of ``grid`` (a1, a2) at once."""
    p = len(FEATURES)
    rho = "c[j] - list_dot_product(g[j], w) + g[j][j] * w[j]"
    return f"""{x}_gd AS (
  SELECT 0 AS k, alpha, l1_ratio, a1, a2, list_transform(c, lambda e: 0.0::DOUBLE) AS w FROM {x}_m, {grid}
  UNION ALL
  SELECT k + 1, alpha, l1_ratio, a1, a2, list_concat(list_concat(w[1:j - 1],
    [sign(rho) * greatest(abs(rho) - a1, 0) / (g[j][j] + a2)]), w[j + 1:])
  FROM (SELECT k, alpha, l1_ratio, a1, a2, w, g, j, {rho} AS rho FROM (SELECT *, k % {p} + 1 AS j FROM {x}_gd, {x}_m)
    WHERE k < {p * sweeps})),
{x}_gw AS MATERIALIZED (SELECT alpha, l1_ratio, w AS scaled, list_transform(list_zip(w, s), lambda e: e[1] / e[2]) AS w,
  g, c, mu, my, vy FROM {x}_gd, {x}_m WHERE k = {p * sweeps})"""


def _fold(f: int) -> str:
    """CTEs of one fold: ``x{f}`` and ``z{f}``, the designs of training and validation, and its weights."""
    sides = (("t", "s.date <= train_end"), ("v", "s.date BETWEEN valid_start AND valid_end"))
    parts = [
        f"{name}{f} AS (SELECT s.* FROM supplier s, folds WHERE fold_id = {f} AND {test}), "
        f"{winsorized(f'{name}{f}', WINSOR)}, {history(f'{name}{f}')}"
        for name, test in sides
    ]
    moments = elastic_net(f"x{f}").split(f"x{f}_cd AS (")[0].rstrip().rstrip(",")
    return (
        f"{', '.join(parts)}, {statistics(f't{f}_h', FEATURES)}, {design(f't{f}_h', f't{f}_h', f'x{f}')}, "
        f"{design(f'v{f}_h', f't{f}_h', f'z{f}')}, {moments}, {grid_descent(f'x{f}', 'grid')}"
    )


def _fold_flows(f: int) -> str:
    """Forecast and pnl of the validation rows of one fold under each penalty, and the training error."""
    row = "[" + ", ".join(FEATURES) + "]"
    inner = ", ".join(f"list_dot_product(g[{i}], scaled) * scaled[{i}]" for i in range(1, len(FEATURES) + 1))
    return f"""SELECT CAST({f} AS BIGINT) AS fold_id, alpha, l1_ratio, y, forecast, spread,
  least(greatest(forecast, 0.0), 2.0) * y AS pnl FROM (
  SELECT alpha, l1_ratio, y, my - list_dot_product(w, mu) + list_dot_product(w, {row}) AS forecast,
    sqrt(vy - 2 * list_dot_product(scaled, c) + list_sum([{inner}])) AS spread FROM z{f}, x{f}_gw)"""


def walk_forward_flows(alphas, l1_ratios) -> str:
    """CTE ``flows`` of all folds and penalties."""
    grid = ", ".join(f"({a!r}::DOUBLE, {q!r}::DOUBLE, {a * q!r}::DOUBLE, {a * (1 - q)!r}::DOUBLE)" for a in alphas for q in l1_ratios)
    return (
        f"{SUPPLIER}, {folds('supplier', 5, 100, 5)}, grid(alpha, l1_ratio, a1, a2) AS (VALUES {grid}), "
        f"{', '.join(map(_fold, range(5)))}, flows AS ({' UNION ALL '.join(map(_fold_flows, range(5)))})"
    )


def stump_rounds(rounds: int, rate: float, alpha: float, l2: float, least: int) -> str:
    """CTEs p0, p1, ...: cells of (day, month) with the forecast after each tree of two leaves."""
    shrink = lambda g: f"(sign({g}) * greatest(abs({g}) - {alpha!r}::DOUBLE, 0))"
    score = lambda g, n: f"({shrink(g)} * {shrink(g)} / ({n} + {l2!r}::DOUBLE))"
    out = ["p0 AS (SELECT c.*, (SELECT sum(s) / sum(n) FROM c) AS p FROM c)"]
    for i in range(rounds):
        sides = " UNION ALL ".join(
            f"SELECT {f} AS f, e.cut, sum(n * p - s) FILTER ({c} <= cut) AS gl, sum(n) FILTER ({c} <= cut) AS nl, "
            f"sum(n * p - s) FILTER ({c} > cut) AS gr, sum(n) FILTER ({c} > cut) AS nr "
            f"FROM p{i}, (SELECT DISTINCT {c} AS cut FROM c) e GROUP BY e.cut"
            for f, c in enumerate(("day", "month"))
        )
        leaf = lambda g, n: f"-{rate!r}::DOUBLE * {shrink(g)} / ({n} + {l2!r}::DOUBLE)"
        out.append(
            f"b{i} AS (SELECT * FROM ({sides}) WHERE nl >= {least} AND nr >= {least} "
            f"ORDER BY {score('gl', 'nl')} + {score('gr', 'nr')} DESC, f, cut LIMIT 1)"
        )
        out.append(
            f"p{i + 1} AS (SELECT day, month, n, s, p + CASE WHEN CASE f WHEN 0 THEN day ELSE month END <= cut "
            f"THEN {leaf('gl', 'nl')} ELSE {leaf('gr', 'nr')} END AS p FROM p{i}, b{i})"
        )
    return ", ".join(out)


def oracle_sql() -> dict[str, str]:
    measures = rs([*BASE, "excess_return"], 4)
    sql: dict[str, str] = {}

    sql["panel_project"] = f"WITH {SUPPLIER} SELECT date, symbol, {measures} FROM supplier"
    sql["winsorize_bounds"] = f"WITH {SUPPLIER} " + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {r(f'quantile_cont({c}, 0.01)', 4, 'lower')}, "
        f"{r(f'quantile_cont({c}, 0.99)', 4, 'upper')} FROM supplier"
        for c in WINSOR
    )
    sql["winsorize_panel"] = (
        f"WITH {SUPPLIER}, {winsorized('supplier', WINSOR)} "
        f"SELECT date, symbol, {measures} FROM supplier_w"
    )
    lag_names = [f"{c}_lag_{k}" for k in LAGS for c in BASE]
    sql["lag_features"] = (
        f"WITH {SUPPLIER}, h AS (SELECT *, {history_columns(BASE, windows=())} FROM supplier) "
        f"SELECT date, symbol, {measures}, {rs(lag_names, 4)} FROM h"
    )
    sql["rolling_stats"] = (
        f"WITH {SUPPLIER}, h AS (SELECT *, {history_columns(BASE, lags=())} FROM supplier) "
        f"SELECT date, symbol, {rs([*BASE, 'excess_return'], 3)}, "
        f"{rs(history_names(BASE, lags=()), 3)} FROM h"
    )
    for key, symbol in (("event_history", "user_id"), ("event_history_hot_keys", "event_type")):
        order = "(PARTITION BY symbol ORDER BY date, event_id)"
        columns = history_columns(
            ["value"],
            order=order,
            frames=lambda w: order[:-1] + f" ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)",
        )
        sql[key] = (
            f"WITH e AS (SELECT ts AS date, {symbol} AS symbol, event_id, value FROM events), "
            f"h AS (SELECT *, {columns} FROM e) SELECT date, symbol, event_id, "
            f"{rs(['value', *history_names(['value'])], 4)} FROM h"
        )
    for key, fill in (
        ("impute_median", "median({c})"),
        ("impute_mean", "avg({c})"),
        ("impute_constant", "0.0"),
        (
            "impute_mode",
            "(SELECT {c} FROM supplier WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)",
        ),
    ):
        fills = ", ".join(f"{fill.format(c=c)} AS {c}_f" for c in BASE)
        source = "FROM supplier" if "(" in fill and key != "impute_mode" else ""
        sql[key] = (
            f"WITH {SUPPLIER}, f AS (SELECT {fills} {source}) SELECT date, symbol, "
            f"{r('excess_return', 4, 'excess_return')}, "
            + ", ".join(r(f"coalesce({c}, {c}_f)", 4, c) for c in BASE)
            + " FROM supplier, f"
        )
    sql["standard_scale"] = (
        f"WITH {SUPPLIER}, {statistics('supplier', BASE, 'avg')} SELECT date, symbol, "
        f"{r('excess_return', 4, 'excess_return')}, "
        + ", ".join(r(scaled(c), 4, c) for c in BASE)
        + " FROM supplier, supplier_f, supplier_s"
    )
    sql["feature_matrix"] = f"WITH {FITTED} {matrix('supplier_h', 'supplier_h')}"
    statistic_rows = []
    for i, c in enumerate([*FEATURES, "excess_return"]):
        known = c in WINSOR
        low = r(f"{c}_lo", 4, "lower") if known else "CAST(NULL AS DOUBLE) AS lower"
        high = r(f"{c}_hi", 4, "upper") if known else "CAST(NULL AS DOUBLE) AS upper"
        if c in FEATURES:
            fitted = f"{r(f'{c}_f', 4, 'impute_value')}, {r(f'{c}_m', 4, 'mean')}, {r(f'{c}_s', 4, 'std')}"
        else:
            fitted = ", ".join(
                f"CAST(NULL AS DOUBLE) AS {n}" for n in ("impute_value", "mean", "std")
            )
        statistic_rows.append(
            f"SELECT '{c}' AS feature, {low}, {high}, {fitted}, CAST({i} AS BIGINT) AS position "
            "FROM supplier_b, supplier_h_f, supplier_h_s"
        )
    sql["feature_statistics"] = f"WITH {FITTED} " + " UNION ALL ".join(statistic_rows)
    sql["feature_transform_holdout"] = (
        f"WITH {split_fit()}, {winsorized('new', WINSOR)}, {history('new')} "
        f"{matrix('new_h', 'old_h')}"
    )
    sql["feature_transform_fitted_bounds"] = (
        f"WITH {split_fit('avg')}, {winsorized('new', WINSOR, 'old_b')}, {history('new')} "
        f"{matrix('new_h', 'old_h')}"
    )
    extremes = ", ".join(f"min({c}) AS {c}_lo, max({c}) AS {c}_hi" for c in BASE)
    sql["min_max_scale"] = (
        f"WITH {SUPPLIER}, x AS (SELECT {extremes} FROM supplier) SELECT date, symbol, "
        f"{r('excess_return', 4, 'excess_return')}, "
        + ", ".join(
            r(f"({c} - {c}_lo) / coalesce(nullif({c}_hi - {c}_lo, 0), 1)", 4, c) for c in BASE
        )
        + " FROM supplier, x"
    )
    sql["forward_fill"] = (
        f"WITH {SUPPLIER} SELECT date, symbol, {rs(['qty', 'price', 'excess_return'], 4)}, "
        + r(
            "last_value(tax IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date "
            "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
            4,
            "tax",
        )
        + " FROM supplier"
    )

    sql["trailing_window"] = (
        "SELECT ts AS date, user_id AS symbol, event_id, value FROM events "
        "WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 21 DAY"
    )
    fold_columns = (
        "fold_id, train_start_rank, train_end_rank, valid_start_rank, valid_end_rank, "
        "train_start, train_end, valid_start, valid_end"
    )
    sql["walk_forward_bounds"] = (
        f"WITH {PRIORITY}, {folds('priority', 5, 100, 5)} SELECT {fold_columns} FROM folds"
    )
    sql["walk_forward_bounds_instants"] = (
        f"WITH e AS (SELECT ts AS date FROM events), {folds('e', 3, 150, 10)} "
        f"SELECT {fold_columns} FROM folds"
    )
    sql["walk_forward_assign"] = f"""WITH {PRIORITY}, {folds('priority', 5, 100, 5)}
SELECT p.symbol, p.date, fold_id, 'train' AS role FROM priority p JOIN folds ON p.date <= train_end
UNION ALL
SELECT p.symbol, p.date, fold_id, 'valid' AS role FROM priority p
JOIN folds ON p.date BETWEEN valid_start AND valid_end"""

    sql["clip_positions"] = (
        f"WITH {SIZED} SELECT symbol, date, {rs(['excess_return', 'position'], 4)} FROM sized"
    )

    def damped(wanted: str, held: str) -> str:
        moved = f"{held} + ({wanted} - {held}) * exp(-0.05 * abs({wanted} - {held}))"
        return r(f"least(greatest({moved}, 0.0), 2.0)", 4, "position")

    sql["turnover_positions"] = (
        f"WITH {SIZED} SELECT symbol, date, {damped('position', '0.5')} FROM sized"
    )
    sql["turnover_from_previous"] = (
        f"WITH {SIZED}, p AS (SELECT *, coalesce(lag(position) OVER {KEYED}, 0.0) AS held FROM sized) "
        f"SELECT symbol, date, {damped('position', 'held')} FROM p"
    )
    sql["equity_curve_pooled"] = (
        f"WITH {SIZED}, {curve('flows', None)} SELECT symbol, date, {rs(['equity', 'peak'], 6)} FROM dd"
    )
    sql["equity_curve_by_symbol"] = (
        f"WITH {SIZED}, {curve('flows', 'symbol', 'date')} "
        f"SELECT symbol, date, {rs(['equity', 'peak'], 6)} FROM dd"
    )
    sql["equity_curve_hot_keys"] = (
        "WITH e AS (SELECT event_type AS symbol, ts AS date, event_id, value AS pnl FROM events), "
        f"{curve('e', 'symbol', 'date, event_id')} SELECT event_id, {rs(['equity', 'peak'], 2)} FROM dd"
    )
    sql["drawdown_curve"] = (
        f"WITH {SIZED}, {curve('flows', 'symbol', 'date')} "
        f"SELECT symbol, date, {rs(['drawdown'], 4)} FROM dd"
    )
    sql["sharpe_by_symbol"] = (
        f"WITH {SIZED} SELECT symbol, {r(sharpe(0.01), 6, 'competition_sharpe')} "
        "FROM flows GROUP BY symbol"
    )
    sql["sharpe_pooled"] = (
        f"WITH {SIZED} SELECT {r(sharpe(0.01), 6, 'competition_sharpe')} FROM flows"
    )
    sql["hit_rate"] = f"WITH {SIZED} SELECT symbol, {r(HIT, 6, 'hit_rate')} FROM flows GROUP BY symbol"
    sql["strategy_report"] = f"WITH {SIZED}, {curve('flows', None)} SELECT {report(4)} FROM dd"
    sql["strategy_report_by_symbol"] = (
        f"WITH {SIZED}, {curve('flows', 'symbol', 'date')} "
        f"SELECT symbol, {report(4)} FROM dd GROUP BY symbol"
    )
    sql["rmse_mean_model"] = (
        f"WITH {SUPPLIER} SELECT {r('stddev_pop(excess_return)', 8, 'rmse')} FROM supplier"
    )
    sql["tail_risk"] = (
        f"WITH {SIZED}, v AS (SELECT quantile_cont(pnl, 0.05) AS var FROM flows) "
        f"SELECT {r('max(var)', 6, 'value_at_risk')}, "
        f"{r('avg(CASE WHEN pnl <= var THEN pnl END)', 6, 'expected_shortfall')} FROM flows, v"
    )

    close = r("close", 4, "close")
    sql["first_difference"] = (
        f"WITH {PRIORITY} SELECT symbol, date, {close}, "
        f"{r(f'close - lag(close) OVER {KEYED}', 4, 'diff')} FROM priority"
    )
    close3 = r("close", 3, "close")
    sql["sma"] = (
        f"WITH {PRIORITY} SELECT symbol, date, {close3}, "
        f"{averages('close', (20, 50), 'SMA', 3)} FROM priority"
    )
    sql["sma_long"] = (
        f"WITH {PRIORITY} SELECT symbol, date, {close3}, "
        f"{averages('close', (5, 10, 21, 63, 126, 252), 'SMA', 3)} FROM priority"
    )
    sql["volume_averages"] = (
        f"WITH {PRIORITY} SELECT symbol, date, volume, "
        f"{averages('volume', (5, 21), 'volume_ma', 5)} FROM priority"
    )
    sql["bollinger"] = f"WITH {PRIORITY} SELECT symbol, date, {close3}, {bands(3)} FROM priority"
    sql["rsi"] = f"WITH {PRIORITY}, {DELTAS} SELECT symbol, date, {close}, {rsi(14, 4, 'RSI')} FROM sides"
    sql["rsi_many"] = (
        f"WITH {PRIORITY}, {DELTAS} SELECT symbol, date, {close}, "
        f"{rsi(14, 4, 'RSI_14')}, {rsi(21, 4, 'RSI_21')} FROM sides"
    )
    sql["technical_indicators"] = f"WITH {PRIORITY}, {DELTAS} {TECHNICAL}"
    sql["event_indicators"] = f"WITH {EVENT_TYPE}, {DELTAS} {TECHNICAL}"
    change = f"close / nullif(lag(close) OVER {KEYED}, 0) - 1"
    sql["pct_change"] = (
        f"WITH {PRIORITY} SELECT symbol, date, {close}, {r(change, 4, 'pct_change')} FROM priority"
    )
    sql["volatility"] = (
        f"WITH {PRIORITY}, ret AS (SELECT *, {change} AS ret FROM priority) SELECT symbol, date, {close}, "
        + ", ".join(r(full("stddev_samp", "ret", n), 4, f"volatility_{n}") for n in (5, 21, 63))
        + " FROM ret"
    )
    sql["compound_return"] = (
        f"WITH {SUPPLIER}, g AS (SELECT *, CASE WHEN excess_return > -1 THEN ln(1 + excess_return) END "
        f"AS growth FROM supplier) SELECT symbol, date, {r('excess_return', 4, 'excess_return')}, "
        f"{r('exp(' + full('sum', 'growth', 21) + ') - 1', 4, 'compound_return')} FROM g"
    )
    mean21, dev21 = full("avg", "excess_return", 21), full("stddev_pop", "excess_return", 21)
    ratio = f"CASE WHEN {dev21} <= 1e-8 THEN 0.0 ELSE {mean21} / nullif({dev21}, 0) END"
    sql["rolling_sharpe"] = (
        f"WITH {SUPPLIER} SELECT symbol, date, {r('excess_return', 4, 'excess_return')}, "
        f"{r(ratio, 4, 'rolling_sharpe')} FROM supplier"
    )
    sql["macd"] = f"""WITH RECURSIVE {PRIORITY},
p AS (SELECT *, row_number() OVER {KEYED} AS k FROM priority),
{ema_cte('fast', 'p', 'close', 12)}, {ema_cte('slow', 'p', 'close', 26)},
m AS (SELECT p.symbol, p.date, p.k, p.close, fast.e - slow.e AS macd FROM p
  JOIN fast ON fast.symbol = p.symbol AND fast.k = p.k
  JOIN slow ON slow.symbol = p.symbol AND slow.k = p.k),
{ema_cte('sig', 'm', 'macd', 9)}
SELECT m.symbol, m.date, {close3}, {r('macd', 3, '"MACD"')}, {r('sig.e', 3, '"MACD_signal"')},
  {r('macd - sig.e', 3, '"MACD_hist"')}
FROM m JOIN sig ON sig.symbol = m.symbol AND sig.k = m.k"""
    sql["macd_gaps"] = f"""WITH RECURSIVE {SUPPLIER},
p AS (SELECT symbol, date, tax, row_number() OVER {KEYED} AS k FROM supplier WHERE tax IS NOT NULL),
{ema_cte('fast', 'p', 'tax', 12)}, {ema_cte('slow', 'p', 'tax', 26)},
m AS (SELECT p.symbol, p.k, fast.e - slow.e AS macd FROM p
  JOIN fast ON fast.symbol = p.symbol AND fast.k = p.k
  JOIN slow ON slow.symbol = p.symbol AND slow.k = p.k),
{ema_cte('sig', 'm', 'macd', 9)},
a AS (SELECT symbol, date, tax, count(tax) OVER {KEYED} AS k FROM supplier)
SELECT a.symbol, a.date, {r('a.tax', 8, 'tax')}, {r('macd', 8, '"MACD"')}, {r('sig.e', 8, '"MACD_signal"')},
  {r('macd - sig.e', 8, '"MACD_hist"')}
FROM a LEFT JOIN m ON m.symbol = a.symbol AND m.k = a.k LEFT JOIN sig ON sig.symbol = a.symbol AND sig.k = a.k"""
    sql["time_features"] = (
        f"WITH {PRIORITY} SELECT symbol, date, CAST(isodow(date) - 1 AS BIGINT) AS day_of_week, "
        "CAST(day(date) AS BIGINT) AS day_of_month, CAST(month(date) AS BIGINT) AS month, "
        "CAST(quarter(date) AS BIGINT) AS quarter FROM priority"
    )

    sql["dq_duplicates"] = (
        "SELECT l_suppkey AS symbol, l_shipdate AS date, count(*) AS n_rows FROM lineitem "
        "GROUP BY ALL HAVING count(*) > 1"
    )
    sql["dq_gaps"] = (
        f"WITH {SUPPLIER}, g AS (SELECT symbol, date, "
        f"CAST(date_diff('day', lag(date) OVER {KEYED}, date) AS BIGINT) AS gap_days FROM supplier) "
        "SELECT * FROM g WHERE gap_days >= 7"
    )
    sql["dq_nulls"] = f"WITH {SUPPLIER} " + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count(*) AS n_rows, count(*) FILTER ({c} IS NULL) AS n_null "
        "FROM supplier"
        for c in WINSOR
    )
    sql["dq_outliers"] = f"WITH {SUPPLIER}, {winsorized('supplier', BASE)} " + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count(*) FILTER ({c} < {c}_lo OR {c} > {c}_hi) AS n_outliers "
        "FROM supplier, supplier_b"
        for c in BASE
    )
    sql["profile"] = f"WITH {SUPPLIER} " + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count({c}) AS n, "
        + ", ".join(
            r(e, 4, n)
            for e, n in (
                (f"avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END)", "missing_share"),
                (f"avg({c})", "mean"),
                (f"stddev_samp({c})", "std"),
                (f"min({c})", "min"),
                (f"quantile_cont({c}, 0.25)", "q25"),
                (f"quantile_cont({c}, 0.5)", "median"),
                (f"quantile_cont({c}, 0.75)", "q75"),
                (f"max({c})", "max"),
            )
        )
        + " FROM supplier"
        for c in BASE
    )
    sql["autocorr"] = (
        f"WITH {PRIORITY}, l AS (SELECT *, lag(close, 1) OVER {KEYED} AS l1, "
        f"lag(close, 5) OVER {KEYED} AS l5 FROM priority) SELECT symbol, "
        f"{r('corr(close, l1)', 4, 'autocorr_1')}, {r('corr(close, l5)', 4, 'autocorr_5')} "
        "FROM l GROUP BY symbol"
    )
    late = "date >= TIMESTAMP '2000-01-01'"
    sql["drift"] = f"WITH {SUPPLIER} " + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {r(f'avg({c}) FILTER (NOT {late})', 4, 'mean_before')}, "
        f"{r(f'avg({c}) FILTER ({late})', 4, 'mean_after')}, "
        + r(
            f"(avg({c}) FILTER ({late}) - avg({c}) FILTER (NOT {late})) "
            f"/ nullif(stddev_pop({c}) FILTER (NOT {late}), 0)",
            4,
            "drift",
        )
        + " FROM supplier"
        for c in BASE
    )

    sql["payload_explode"] = (
        "SELECT event_id, user_id AS symbol, ts AS date, value FROM events"
    )
    source = f"WITH {PRIORITY} SELECT date, symbol, {close}, volume FROM priority"
    sql["csv_roundtrip"] = sql["csv_inferred"] = sql["parquet_roundtrip"] = source
    sql["json_metrics_sink"] = (
        f"WITH {SIZED} SELECT {r(sharpe(0.01), 6, 'competition_sharpe')}, {r(HIT, 6, 'hit_rate')} "
        "FROM flows"
    )

    forecast = (
        f"0.8 + 0.5 * {scaled('qty')} - 0.25 * {scaled('price_lag_1')} + 0.4 * {scaled('tax_roll_mean_5')}"
    )
    sql["backtest_fixed_linear"] = (
        f"WITH {split_fit()}, {winsorized('new', WINSOR)}, {history('new')}, flows AS ("
        f"SELECT symbol, date, least(greatest({forecast}, 0.0), 2.0) * excess_return AS pnl "
        f"FROM new_h, old_h_f, old_h_s), {curve('flows', None)} SELECT {report(4)} FROM dd"
    )
    sql["elastic_net_single"] = f"""WITH {FITTED},
x AS (SELECT {scaled('tax')} AS x, excess_return AS y FROM supplier_h, supplier_h_f, supplier_h_s),
c AS (SELECT covar_pop(x, y) / stddev_pop(x) AS c, stddev_pop(x) AS s, avg(x) AS mx, avg(y) AS my FROM x),
w AS (SELECT sign(c) * greatest(abs(c) - 0.5e-4, 0.0) / (1 + 0.5e-4) / s AS w, mx, my FROM c)
SELECT 'tax' AS feature, {r('w', 6, 'weight')} FROM w
UNION ALL SELECT '(intercept)' AS feature, {r('my - w * mx', 6, 'weight')} FROM w"""

    light = f"{FITTED}, {design('supplier_h', 'supplier_h', 'x')}, {elastic_net('x')}"
    weights = " UNION ALL ".join(
        [f"SELECT '{c}' AS feature, {r(f'w[{i}]', 7, 'weight')} FROM x_w" for i, c in enumerate(FEATURES, 1)]
        + [f"SELECT '(intercept)' AS feature, {r('my - list_dot_product(w, mu)', 7, 'weight')} FROM x_w"]
    )
    sql["elastic_net_coefficients"] = f"WITH RECURSIVE {light} {weights}"
    inner = ", ".join(f"list_dot_product(g[{i}], scaled) * scaled[{i}]" for i in range(1, len(FEATURES) + 1))
    rmse = f"sqrt(vy - 2 * list_dot_product(scaled, c) + list_sum([{inner}]))"
    sql["train_job"] = (
        f"WITH RECURSIVE {light} SELECT CAST({len(FEATURES)} AS BIGINT) AS n_features, "
        f"{r(rmse, 8, 'rmse')} FROM x_w"
    )
    fitted = f"{split_fit()}, {design('old_h', 'old_h', 'x')}, {elastic_net('x')}"
    late = f"{winsorized('new', WINSOR)}, {history('new')}, {design('new_h', 'old_h', 'z')}, f AS ({forecast_of('z', 'x')})"
    sql["backtest_job"] = (
        f"WITH RECURSIVE {fitted}, {late}, flows AS (SELECT symbol, date, "
        "least(greatest(forecast, 0.0), 2.0) * y AS pnl FROM f), "
        f"{curve('flows', None)} SELECT {report(6)} FROM dd"
    )
    window = "WHERE date >= (SELECT max(date) FROM {0}) - INTERVAL 21 DAY"
    cut = f"cut AS (SELECT * FROM new {window.format('new')}), {winsorized('cut', WINSOR)}, {history('cut')}"
    sql["score_job"] = (
        f"WITH RECURSIVE {fitted}, {cut}, {design('cut_h', 'old_h', 'z')}, f AS ({forecast_of('z', 'x')}) "
        f"SELECT date, symbol, {r('forecast', 6, 'prediction')} FROM f"
    )
    sql["score_job_full_history"] = (
        f"WITH RECURSIVE {fitted}, {late} SELECT date, symbol, {r('forecast', 6, 'prediction')} "
        f"FROM f {window.format('f')}"
    )
    sql["ml_pipeline_forecast"] = (
        f"WITH RECURSIVE {fitted}, {late} SELECT date, symbol, {r('forecast', 6, 'prediction')} FROM f"
    )
    sql["payload_forecast"] = sql["score_job"]
    whole = (
        f"{winsorized('supplier', WINSOR, 'old_b')}, {history('supplier')}, "
        f"{design('supplier_h', 'old_h', 'z')}, f AS ({forecast_of('z', 'x')})"
    )
    sql["streaming_scores"] = (
        f"WITH RECURSIVE {fitted}, {whole} SELECT date, symbol, {r('forecast', 5, 'prediction')} "
        "FROM f WHERE date >= TIMESTAMP '2000-01-01'"
    )
    sql["gbt_stump"] = f"""WITH {SUPPLIER},
d AS (SELECT CAST(isodow(date) - 1 AS DOUBLE) AS day_of_week, count(*) AS n, sum(excess_return) AS s
  FROM supplier GROUP BY 1),
t AS (SELECT a.day_of_week AS upto,
    sum(b.n) FILTER (b.day_of_week <= a.day_of_week) AS n1, sum(b.s) FILTER (b.day_of_week <= a.day_of_week) AS s1,
    sum(b.n) FILTER (b.day_of_week > a.day_of_week) AS n2, sum(b.s) FILTER (b.day_of_week > a.day_of_week) AS s2
  FROM d a, d b GROUP BY a.day_of_week),
best AS (SELECT * FROM t WHERE n2 > 0 ORDER BY s1 * s1 / n1 + s2 * s2 / n2 DESC LIMIT 1)
SELECT day_of_week, {r('CASE WHEN day_of_week <= upto THEN s1 / n1 ELSE s2 / n2 END', 10, 'prediction')}
FROM d, best"""
    sql["walk_forward_job"] = (
        f"WITH RECURSIVE {walk_forward_flows((LIGHT_ALPHA,), (LIGHT_L1,))} SELECT fold_id, "
        f"{r('max(spread)', 5, 'train_rmse')}, {r('sqrt(avg((y - forecast) * (y - forecast)))', 5, 'valid_rmse')}, "
        f"{r(sharpe(0.03), 5, 'competition_sharpe')}, {r('sum(pnl)', 5, 'total_return')}, {r(HIT, 5, 'hit_rate')} "
        "FROM flows GROUP BY fold_id"
    )
    sql["parameter_search"] = (
        f"WITH RECURSIVE {walk_forward_flows(ALPHAS, L1_RATIOS)}, f AS (SELECT alpha, l1_ratio, "
        f"{sharpe(0.03)} AS sharpe, sqrt(avg((y - forecast) * (y - forecast))) AS rmse FROM flows GROUP BY fold_id, alpha, l1_ratio) "
        "SELECT format('{:.5f}', alpha) AS alpha, format('{:.1f}', l1_ratio) AS l1_ratio, "
        f"{r('avg(sharpe)', 5, 'mean_sharpe')}, {r('avg(rmse)', 5, 'mean_rmse')}, count(*) AS n_folds FROM f GROUP BY alpha, l1_ratio"
    )
    sql["feature_matrix_from_schema"] = sql["feature_matrix"]
    sql["dq_observed"] = f"WITH {SUPPLIER} " + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count(*) AS n_rows, count(*) FILTER ({c} IS NULL) AS n_null, "
        f"CAST(0 AS BIGINT) AS n_not_finite, CAST(min(date) AS VARCHAR) AS first_date, CAST(max(date) AS VARCHAR) AS last_date FROM supplier"
        for c in WINSOR
    )
    sql["dq_types"] = (
        f"WITH {PRIORITY} SELECT DISTINCT 'volume' AS column_name, 'int' AS expected, lower(typeof(volume)) AS actual FROM priority "
        "UNION ALL SELECT 'open' AS column_name, 'double' AS expected, 'missing' AS actual"
    )
    sql["winsorize_bounds_approx"] = f"WITH {SUPPLIER} " + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count({c}) AS n_values, true AS within_error, true AS error_small FROM supplier" for c in WINSOR
    )
    sql["boosted_stumps"] = f"""WITH {SUPPLIER},
c AS (SELECT CAST(isodow(date) - 1 AS DOUBLE) AS day, CAST(month(date) AS DOUBLE) AS month, count(*) AS n,
  sum(excess_return) AS s FROM supplier GROUP BY 1, 2),
{stump_rounds(3, 0.5, 0.05, 2.0, 20)} SELECT day, month, {r('p', 8, 'prediction')} FROM p3"""
    return sql
