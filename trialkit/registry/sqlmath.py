"""SQL text of small linear solves and Newton iterations, for checking the fits against another engine."""

from __future__ import annotations

from collections.abc import Sequence


def upper(n: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(n) for j in range(i, n)]


def solve(source: str, n: int, keep: Sequence[str], right: str = "g", left: str = "h", out: str = "x") -> str:
    """SELECT of `keep` and the solution x0.. of the symmetric system in columns h_i_j (i <= j) and g_i."""
    keep = list(keep)
    sql = source
    for k in range(n):
        cols = [f"{left}_{i}_{j}" for i, j in upper(n) if i <= k] + [f"{right}_{i}" for i in range(k + 1)]
        for i in range(k + 1, n):
            factor = f"({left}_{k}_{i} / {left}_{k}_{k})"
            cols += [f"{left}_{i}_{j} - {factor} * {left}_{k}_{j} AS {left}_{i}_{j}" for j in range(i, n)]
            cols.append(f"{right}_{i} - {factor} * {right}_{k} AS {right}_{i}")
        sql = f"(SELECT {', '.join([*keep, *cols])} FROM {sql})"
    for k in reversed(range(n)):
        known = "".join(f" - {left}_{k}_{j} * {out}{j}" for j in range(k + 1, n))
        sql = f"(SELECT *, ({right}_{k}{known}) / {left}_{k}_{k} AS {out}{k} FROM {sql})"
    return f"SELECT {', '.join([*keep, *[f'{out}{i}' for i in range(n)]])} FROM {sql}"


def logistic(rows: str, keys: Sequence[str], features: Sequence[str], label: str, weight: str = "1", l2: float = 1.0, steps: int = 12, name: str = "lb") -> str:
    """CTEs ending in {name}: one row per key with the ridge logistic coefficients b0.. (b0 the intercept)."""
    by = ", ".join(keys)
    x = ["1", *[f"r.{f}" for f in features]]
    n = len(x)
    match = " AND ".join(f"r.{k} = b.{k}" for k in keys)
    ctes = [f"{name}_0 AS (SELECT DISTINCT {by}, {', '.join(f'CAST(0 AS DOUBLE) AS b{i}' for i in range(n))} FROM {rows})"]
    for s in range(steps):
        eta = " + ".join(f"b.b{i} * {x[i]}" for i in range(n))
        own = ", ".join(f"r.{k}" for k in keys)
        points = (
            f"SELECT {own}, {', '.join(f'b.b{i}' for i in range(n))}, {', '.join(f'CAST({x[i]} AS DOUBLE) AS v{i}' for i in range(n))}, "
            f"r.{label} AS y, {weight} AS w, 1 / (1 + exp(-({eta}))) AS p FROM {rows} r JOIN {name}_{s} b ON {match}"
        )
        pen = lambda i: 0.0 if i == 0 else l2
        sums = [f"sum(w * (y - p) * v{i}) - {pen(i)} * any_value(b{i}) AS g_{i}" for i in range(n)]
        sums += [f"sum(w * p * (1 - p) * v{i} * v{j}){f' + {pen(i)}' if i == j else ''} AS h_{i}_{j}" for i, j in upper(n)]
        sums += [f"any_value(b{i}) AS b{i}" for i in range(n)]
        moved = solve(f"(SELECT {by}, {', '.join(sums)} FROM ({points}) GROUP BY {by})", n, [*keys, *[f"b{i}" for i in range(n)]])
        ctes.append(f"{name}_{s + 1} AS MATERIALIZED (SELECT {by}, {', '.join(f'b{i} + x{i} AS b{i}' for i in range(n))} FROM ({moved}))")
    ctes.append(f"{name} AS (SELECT * FROM {name}_{steps})")
    return ", ".join(ctes)


def least_squares(rows: str, keys: Sequence[str], features: Sequence[str], label: str, weight: str = "1", name: str = "ls") -> str:
    """CTE {name}: one row per key with least-squares coefficients c0.. (c0 the intercept)."""
    by = ", ".join(keys)
    x = ["1", *features]
    n = len(x)
    sums = [f"CAST(sum({weight} * {label} * {x[i]}) AS DOUBLE) AS g_{i}" for i in range(n)]
    sums += [f"CAST(sum({weight} * {x[i]} * {x[j]}) AS DOUBLE) AS h_{i}_{j}" for i, j in upper(n)]
    solved = solve(f"(SELECT {by}, {', '.join(sums)} FROM {rows} GROUP BY {by})", n, keys, out="c")
    return f"{name} AS ({solved})"


def half_normal(z: str) -> str:
    """Normal probability between 0 and |z|, by its power series (terms are all positive)."""
    odd = "(lgamma(2 * k + 2) - k * ln(2) - lgamma(k + 1))"  # log of (2k + 1)!!
    terms = f"list_transform(range(0, 200), lambda k: exp((2 * k + 1) * ln(abs({z})) - {odd} - {z} * {z} / 2))"
    return f"(CASE WHEN {z} = 0 THEN 0 ELSE list_sum({terms}) / sqrt(2 * pi()) END)"


def location_scale(rows: str, keys: Sequence[str], family: str, arm: bool, time: str = "days", event: str = "flag", steps: int = 45, name: str = "ls", weight: str | None = None) -> str:
    """CTEs of a Weibull, log-normal or log-logistic fit of log time: {name}_est (t0.., last one log scale)
    and {name}_at (rows with log likelihood terms and the negative Hessian columns at the estimate)."""
    by = ", ".join(keys)
    x = ["1", "r.treatment"] if arm else ["1"]
    n = len(x) + 1
    z, own = "z", ", ".join(f"r.{k}" for k in keys)
    on = " AND ".join(f"r.{k} = b.{k}" for k in keys)
    tail = f"(0.5 - sign({z}) * half)"
    hazard = f"(exp(-{z} * {z} / 2) / sqrt(2 * pi()) / {tail})"
    p = f"(1 / (1 + exp(-{z})))"
    event_part, tail_part = {
        "weibull": (("z - exp(z)", "1 - exp(z)", "-exp(z)"), ("-exp(z)", "-exp(z)", "-exp(z)")),
        "lognormal": (("-z * z / 2 - ln(2 * pi()) / 2", "-z", "-1"), (f"ln({tail})", f"-{hazard}", f"-{hazard} * ({hazard} - z)")),
        "loglogistic": (("z - 2 * ln(1 + exp(z))", f"1 - 2 * {p}", f"-2 * {p} * (1 - {p})"), ("-ln(1 + exp(z))", f"-{p}", f"-{p} * (1 - {p})")),
    }[family]
    half = half_normal("z") if family == "lognormal" else "0"

    def points(source: str) -> str:
        mean = " + ".join(f"b.t{i} * {x[i]}" for i in range(n - 1))
        based = (
            f"SELECT {own}, {', '.join(f'b.t{i}' for i in range(n))}, {', '.join(f'{x[i]} AS v{i}' for i in range(n - 1))}, r.{event} AS d, "
            f"CAST({f'r.{weight}' if weight else 1} AS DOUBLE) AS wt, ln(r.{time}) AS lt, exp(b.t{n - 1}) AS s, (ln(r.{time}) - ({mean})) / exp(b.t{n - 1}) AS z FROM {rows} r JOIN {source} b ON {on} WHERE r.{time} > 0"
        )
        return (
            f"SELECT *, CASE WHEN d = 1 THEN {event_part[0]} - ln(s) - lt ELSE {tail_part[0]} END AS ll, "
            f"CASE WHEN d = 1 THEN {event_part[1]} ELSE {tail_part[1]} END AS f1, CASE WHEN d = 1 THEN {event_part[2]} ELSE {tail_part[2]} END AS f2 "
            f"FROM (SELECT *, {half} AS half FROM ({based}))"
        )

    grads = [f"sum(wt * -f1 * v{i} / s) AS g_{i}" for i in range(n - 1)] + [f"sum(wt * (-f1 * z - d)) AS g_{n - 1}"]
    hess = []
    for i, j in upper(n):
        if j < n - 1:
            cell = f"f2 * v{i} * v{j} / (s * s)"
        elif i < n - 1:
            cell = f"(f2 * z + f1) * v{i} / s"
        else:
            cell = "f2 * z * z + f1 * z"
        hess.append(f"-sum(wt * ({cell})) AS h_{i}_{j}")
    sums = ", ".join([*grads, *hess, "sum(wt * ll) AS ll", *[f"any_value(t{i}) AS t{i}" for i in range(n)]])
    zero = ["CAST(0 AS DOUBLE) AS t1"] if arm else []
    # log time spreads wider than its standard error term by this factor
    wide = {"weibull": 1.2825498, "lognormal": 1.0, "loglogistic": 1.8137994}[family]
    first = ", ".join([f"avg(ln({time})) AS t0", *zero, f"ln(stddev_pop(ln({time})) / {wide}) AS t{n - 1}"])
    ctes = [f"{name}_0 AS (SELECT {by}, {first} FROM {rows} WHERE {time} > 0 GROUP BY {by})"]
    for k in range(steps):
        lifted = sums
        if k < 30:  # far from the optimum the Hessian may be indefinite
            for i in range(n):
                lifted = lifted.replace(f" AS h_{i}_{i}", f" + 2 * sum(wt) AS h_{i}_{i}")
        moved = solve(f"(SELECT {by}, {lifted} FROM ({points(f'{name}_{k}')}) GROUP BY {by})", n, [*keys, *[f"t{i}" for i in range(n)]])
        # short steps keep Newton's iteration where the likelihood is concave
        short = ", ".join(f"t{i} + greatest(-0.2, least(0.2, x{i})) AS t{i}" for i in range(n))
        ctes.append(f"{name}_{k + 1} AS MATERIALIZED (SELECT {by}, {short} FROM ({moved}))")
    ctes.append(f"{name}_at AS (SELECT {by}, {sums}, count(*) AS n, CAST(round(sum(wt * d)) AS BIGINT) AS n_events FROM ({points(f'{name}_{steps}')}) GROUP BY {by})")
    return ", ".join(ctes)


def adjusted_cox(rows: str, key: str, covariates: Sequence[str], weight: str, time: str = "days", event: str = "flag", penalizer: float = 0.1, steps: int = 10) -> str:
    """CTEs ending in `fitted`: per key b0.., robust se0.. on the standardized scale, and sd0.. ."""
    k = len(covariates)
    cells = upper(k)
    scaled = ", ".join(f"(r.{c} - m.m{i}) / m.sd{i} AS x{i}" for i, c in enumerate(covariates))
    moments = ", ".join(f"avg({c}) AS m{i}, stddev_samp({c}) AS sd{i}" for i, c in enumerate(covariates))
    ctes = [
        f"scales AS (SELECT {key}, count(*) AS n, {moments} FROM {rows} GROUP BY {key})",
        f"std AS (SELECT r.{key}, r.{time} AS t, r.{event} AS d, r.{weight} AS w, m.n, {scaled} FROM {rows} r JOIN scales m ON r.{key} = m.{key})",
        f"cb_0 AS (SELECT {key}, {', '.join(f'CAST(0 AS DOUBLE) AS b{i}' for i in range(k))} FROM scales)",
    ]

    def risky(source: str) -> str:
        eta = " + ".join(f"b.b{i} * s.x{i}" for i in range(k))
        return f"SELECT s.*, {', '.join(f'b.b{i}' for i in range(k))}, s.w * exp({eta}) AS r FROM std s JOIN {source} b ON s.{key} = b.{key}"

    def day_sums(source: str) -> str:
        def block(base: str, tag: str) -> list[str]:
            return (
                [f"sum({base}) AS {tag}"] + [f"sum({base} * x{i}) AS {tag}_{i}" for i in range(k)]
                + [f"sum({base} * x{i} * x{j}) AS {tag}_{i}_{j}" for i, j in cells]
            )

        tags = ["s", *[f"s_{i}" for i in range(k)], *[f"s_{i}_{j}" for i, j in cells]]
        daily = (
            f"SELECT {key}, t, any_value(n) AS n, {', '.join(f'any_value(b{i}) AS b{i}' for i in range(k))}, "
            f"{', '.join(block('r', 's') + block('(CASE WHEN d = 1 THEN r ELSE 0 END)', 'q'))}, CAST(sum(d) AS BIGINT) AS deaths, "
            f"sum(CASE WHEN d = 1 THEN w ELSE 0 END) AS dw, {', '.join(f'sum(CASE WHEN d = 1 THEN w * x{i} ELSE 0 END) AS dx_{i}' for i in range(k))} "
            f"FROM ({risky(source)}) GROUP BY {key}, t"
        )
        return (
            f"SELECT * REPLACE ({', '.join(f'sum({t}) OVER later AS {t}' for t in tags)}) FROM ({daily}) "
            f"WINDOW later AS (PARTITION BY {key} ORDER BY t DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        )

    def system(source: str) -> str:
        thin = lambda tag: f"(s{tag} - l * q{tag})"
        mean = [f"({thin(f'_{i}')} / {thin('')})" for i in range(k)]
        g = [f"sum(dx_{i} / deaths - dw / deaths * {mean[i]}) - {penalizer} * any_value(n) * any_value(b{i}) AS g_{i}" for i in range(k)]
        h = [
            f"sum(dw / deaths * ({thin(f'_{i}_{j}')} / {thin('')} - {mean[i]} * {mean[j]})){f' + {penalizer} * any_value(n)' if i == j else ''} AS h_{i}_{j}"
            for i, j in cells
        ]
        return (
            f"(SELECT {key}, {', '.join(g + h + [f'any_value(b{i}) AS b{i}' for i in range(k)])} FROM "
            f"(SELECT *, unnest(range(deaths)) / deaths AS l FROM ({day_sums(source)}) WHERE deaths > 0) GROUP BY {key})"
        )

    bs = [f"b{i}" for i in range(k)]
    for s in range(steps):
        moved = solve(system(f"cb_{s}"), k, [key, *bs])
        ctes.append(f"cb_{s + 1} AS MATERIALIZED (SELECT {key}, {', '.join(f'b{i} + x{i} AS b{i}' for i in range(k))} FROM ({moved}))")
    last = f"cb_{steps}"
    ctes.append(f"hz AS (SELECT {key}, t, {', '.join(f's_{i} / s AS e{i}' for i in range(k))}, sum(dw / s) OVER upto AS a, "
                f"{', '.join(f'sum(dw * s_{i} / (s * s)) OVER upto AS c{i}' for i in range(k))} FROM ({day_sums(last)}) "
                f"WINDOW upto AS (PARTITION BY {key} ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))")
    u = [f"(r.d * r.w * (r.x{i} - z.e{i}) - r.r * (r.x{i} * z.a - z.c{i}))" for i in range(k)]
    ctes.append(f"meat AS (SELECT r.{key}, {', '.join(f'sum({u[i]} * {u[j]}) AS q_{i}_{j}' for i, j in cells)} FROM ({risky(last)}) r "
                f"JOIN hz z ON r.{key} = z.{key} AND r.t = z.t GROUP BY r.{key})")
    ctes.append(f"bread AS (SELECT * FROM {system(last)})")
    for i in range(k):
        unit = ", ".join(f"CAST({int(i == j)} AS DOUBLE) AS e_{j}" for j in range(k))
        ctes.append(f"inv{i} AS ({solve(f'(SELECT *, {unit} FROM bread)', k, [key], right='e', out='y')})")
    def variance(i: int) -> str:
        terms = [f"{1 if a == b else 2} * inv{i}.y{a} * inv{i}.y{b} * q_{a}_{b}" for a, b in cells]
        return f"sqrt({' + '.join(terms)}) AS se{i}"
    joins = " ".join(f"JOIN inv{i} ON inv{i}.{key} = f.{key}" for i in range(k))
    ctes.append(f"fitted AS (SELECT f.{key}, {', '.join(f'f.b{i}, sd{i}, {variance(i)}' for i in range(k))} FROM {last} f "
                f"JOIN meat ON meat.{key} = f.{key} JOIN scales ON scales.{key} = f.{key} {joins})")
    return ", ".join(ctes)
