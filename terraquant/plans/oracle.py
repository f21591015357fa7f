"""Text blocks for the SQL oracles.

The oracles restate each operator in plain SQL, by other means than the Spark
plans: dense windows instead of prefix counts, materialised scaled features
instead of moments with gaps, and a Gauss-Jordan sweep written out as column
arithmetic instead of a matrix solver.
"""

from __future__ import annotations

from collections.abc import Sequence

from ..sources.tables import FEATURES

OBS = """obs AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS obs_key, l_extendedprice AS tiebreak,
         n_name AS place, c_mktsegment AS scenario,
         CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_quantity END AS x_qty,
         CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_discount + 0.0 END AS x_disc,
         CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice END AS x_total,
         CAST(p_size AS DOUBLE) AS x_size, p_retailprice AS x_price, l_tax AS x_tax,
         c_acctbal AS x_cust, s_acctbal AS x_supp,
         log10(l_quantity * p_retailprice * (1 - l_discount)) AS y
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON c_nationkey = n_nationkey)"""
BOUNDS = "bounds AS (SELECT quantile_cont(y, 0.01) AS lo, quantile_cont(y, 0.99) AS hi FROM obs)"
CLIPPED = "clipped AS (SELECT obs.* FROM obs, bounds WHERE y BETWEEN lo AND hi)"


def with_(*ctes: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(ctes)}\n{select}"


def bits(tag: str, key: str = "obs_key") -> str:
    """Thirty-two bits of md5(tag:key); ``tag`` is an SQL expression."""
    return f"('0x' || substr(md5(concat({tag}, ':', {key})), 1, 8))::bigint"


def draw(seed: str | int, key: str = "obs_key") -> str:
    """Draw of a seed: four seeds share a digest."""
    return f"('0x' || substr(md5(concat(({seed}) // 4, ':', {key})), 1 + 8 * (({seed}) % 4), 8))::bigint"


def is_test(seed: str | int = 0, fraction: float = 0.3) -> str:
    return f"{draw(seed)} / 4294967296.0::double < {fraction}::double"


def r(expr: str, digits: int = 6) -> str:
    """Rounded, negative zero normalised."""
    return f"round({expr}, {digits}) + 0.0::double"


SPLIT = f"split AS (SELECT *, {is_test(0)} AS is_test FROM clipped)"


def prep(features: Sequence[str] = FEATURES, src: str = "split", train: str = "NOT is_test", scale: bool = True,
         by: str = "", name: str = "prepped") -> str:
    """Adds z1..zp: features imputed with training means, scaled by the training range."""
    stats = ", ".join(f"avg({f}) AS m_{f}, min({f}) AS lo_{f}, max({f}) AS hi_{f}" for f in features)
    if scale:
        z = ", ".join(
            f"CASE WHEN hi_{f} = lo_{f} THEN 0.0::double ELSE (coalesce({f}, m_{f}) - lo_{f}) / (hi_{f} - lo_{f}) END AS z{i}"
            for i, f in enumerate(features, 1)
        )
    else:
        z = ", ".join(f"coalesce({f}, m_{f}) AS z{i}" for i, f in enumerate(features, 1))
    group = f" GROUP BY {by}" if by else ""
    keys = f"{by}, " if by else ""
    join = f"JOIN {name}_stats USING ({by})" if by else f"CROSS JOIN {name}_stats"
    return (
        f"{name}_stats AS (SELECT {keys}{stats} FROM {src} WHERE {train}{group}), "
        f"{name} AS (SELECT {src}.*, {z} FROM {src} {join})"
    )


def gram(zs: Sequence[str], y: str, src: str, where: str = "true", by: Sequence[str] = (), name: str = "gram", ridge: str | None = None) -> str:
    """Centred cross products a{i}_{j} and means m{i} of (zs..., y)."""
    cols = [*zs, y]
    d = len(cols)
    out = [*by, "count(*) AS n"]
    out += [f"avg({c}) AS m{i}" for i, c in enumerate(cols, 1)]
    for i in range(1, d):
        for j in range(1, d + 1):
            extra = f" + {ridge}" if ridge and i == j else ""
            out.append(f"count(*) * covar_pop({cols[i - 1]}, {cols[j - 1]}){extra} AS a{i}_{j}")
    group = f" GROUP BY {', '.join(by)}" if by else ""
    return f"{name} AS (SELECT {', '.join(out)} FROM {src} WHERE {where}{group})"


def sweep(p: int, src: str = "gram", keep: Sequence[str] = (), name: str = "s") -> str:
    """Gauss-Jordan: after stage k the label column of rows 1..k holds the coefficients on the first k variables."""
    stages = []
    previous = src
    keep = [*keep, *[f"m{i}" for i in range(1, p + 2)]]
    for k in range(1, p + 1):
        cells = []
        for i in range(1, p + 1):
            for j in range(k + 1, p + 2):
                if i == k:
                    cells.append(f"a{k}_{j} / a{k}_{k} AS a{i}_{j}")
                else:
                    cells.append(f"a{i}_{j} - a{i}_{k} * a{k}_{j} / a{k}_{k} AS a{i}_{j}")
        stages.append(f"{name}{k} AS (SELECT {', '.join([*keep, *cells])} FROM {previous})")
        previous = f"{name}{k}"
    return ", ".join(stages)


def coefficients(p: int, src: str, keep: Sequence[str] = (), name: str = "coef") -> str:
    """b1..bp and intercept b0 from the last sweep stage."""
    b = [f"a{i}_{p + 1} AS b{i}" for i in range(1, p + 1)]
    b0 = f"m{p + 1} - " + " - ".join(f"a{i}_{p + 1} * m{i}" for i in range(1, p + 1))
    return f"{name} AS (SELECT {', '.join([*keep, *b, f'{b0} AS b0'])} FROM {src})"


def ols(features: Sequence[str] = FEATURES, src: str = "prepped", where: str = "NOT is_test", name: str = "coef", ridge: str | None = None) -> str:
    p = len(features)
    zs = [f"z{i}" for i in range(1, p + 1)]
    return ", ".join(
        [gram(zs, "y", src, where, name=f"{name}_gram", ridge=ridge), sweep(p, f"{name}_gram", name=f"{name}_s"), coefficients(p, f"{name}_s{p}", name=name)]
    )


def predicted(p: int = len(FEATURES), prefix: str = "z") -> str:
    return "b0 + " + " + ".join(f"b{i} * {prefix}{i}" for i in range(1, p + 1))


# Clipped, split, preprocessed on the training part, fitted and scored with least squares.
BASE = [OBS, BOUNDS, CLIPPED, SPLIT]
FITTED = [*BASE, prep(), ols()]
SCORED = [*FITTED, f"scored AS (SELECT prepped.*, {predicted()} AS prediction FROM prepped CROSS JOIN coef)"]


def tree(rows: str, target: str, depth: int, features: Sequence[str] = FEATURES, name: str = "tree", keep: str = "*") -> list[str]:
    """A regression tree grown level by level on the rows that are no test rows; ``{name}`` adds the column of its name.

    Every midpoint of neighbouring training values is a candidate, and the least squared error wins.
    """
    zs = [f"z{i}" for i in range(1, len(features) + 1)]
    long = lambda src, cols: " UNION ALL ".join(f"SELECT {cols}, {i} AS f, {z} AS v FROM {src} WHERE NOT is_test" for i, z in enumerate(zs, 1))
    value = "CASE b.f " + " ".join(f"WHEN {i} THEN {z}" for i, z in enumerate(zs, 1)) + " END"
    out = [
        f"{name}_values AS (SELECT f, v, lead(v) OVER (PARTITION BY f ORDER BY v) AS next FROM (SELECT DISTINCT f, v FROM ({long(rows, '0 AS node')})))",
        f"{name}_0 AS (SELECT *, 1 AS {name}_node FROM {rows})",
    ]
    for d in range(depth):
        src = f"{name}_{d}"
        out += [
            f"{src}_sums AS (SELECT node, f, v, count(*) AS n, sum(t) AS s FROM ({long(src, f'{name}_node AS node, {target} AS t')}) GROUP BY node, f, v)",
            f"""{src}_cuts AS (SELECT node, f, v, sum(n) OVER upto AS nl, sum(s) OVER upto AS sl, sum(n) OVER whole AS nt, sum(s) OVER whole AS st
                FROM {src}_sums WINDOW upto AS (PARTITION BY node, f ORDER BY v), whole AS (PARTITION BY node, f))""",
            f"""{src}_best AS (SELECT node, f, (v + next) / 2 AS cut FROM {src}_cuts JOIN {name}_values USING (f, v) WHERE nl < nt
                QUALIFY row_number() OVER (PARTITION BY node ORDER BY sl * sl / nl + (st - sl) * (st - sl) / (nt - nl) DESC, f, v) = 1)""",
            f"""{name}_{d + 1} AS (SELECT r.* REPLACE (2 * {name}_node + CASE WHEN {value} > b.cut THEN 1 ELSE 0 END AS {name}_node)
                FROM {src} r LEFT JOIN {src}_best b ON b.node = r.{name}_node)""",
        ]
    last = f"{name}_{depth}"
    out += [
        f"{name}_leaves AS (SELECT {name}_node, avg({target}) AS {name}_value FROM {last} WHERE NOT is_test GROUP BY {name}_node)",
        f"{name} AS (SELECT {keep} EXCLUDE ({name}_node) FROM {last} JOIN {name}_leaves USING ({name}_node))",
    ]
    return out
