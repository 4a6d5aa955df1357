"""DuckDB SQL that trains and applies hidden Markov models of two states, a recursion over each sequence's rows at a time."""

from __future__ import annotations

STATES = (1, 2)


def _each(f, parts) -> str:
    return ", ".join(f(p) for p in parts)


def hmm_tables(features: str, dims: int, rounds: int, stay: float, floor: float) -> str:
    """Tables x (symbol, t, r, x1 ...) of scaled features and p0 ... p{rounds}, the models by symbol; ``features`` gives symbol, t and v0 ..."""
    d = range(1, dims + 1)
    both = [(j, k) for j in STATES for k in d]
    ways = [(i, j) for i in STATES for j in STATES]
    out = [
        f"f AS MATERIALIZED ({features})",
        f"st AS (SELECT symbol, {_each(lambda k: f'avg(v{k - 1}) AS c{k}, stddev_pop(v{k - 1}) AS s{k}', d)} FROM f GROUP BY 1)",
        f"x AS MATERIALIZED (SELECT f.symbol, f.t, row_number() OVER (PARTITION BY f.symbol ORDER BY f.t) AS r, count(*) OVER (PARTITION BY f.symbol) AS n, "
        f"{_each(lambda k: f'(v{k - 1} - c{k}) / CASE WHEN s{k} > 0 THEN s{k} ELSE 1 END AS x{k}', d)} FROM f JOIN st ON st.symbol = f.symbol)",
        f"p0 AS (SELECT symbol, 0.5 AS s1, 0.5 AS s2, {_each(lambda w: f'CAST({stay if w[0] == w[1] else 1 - stay} AS DOUBLE) AS a{w[0]}{w[1]}', ways)}, "
        f"{_each(lambda w: f'CAST({-1 if w[0] == 1 else 1} AS DOUBLE) AS m{w[0]}_{w[1]}, CAST(1 AS DOUBLE) AS v{w[0]}_{w[1]}', both)}, CAST(NULL AS DOUBLE) AS loglik FROM st)",
    ]
    for n in range(rounds):
        out += _expected(n, dims)
        moved = ", ".join(f"sum(CASE WHEN r > 1 THEN w{i}{j} / (w11 + w12 + w21 + w22) END) AS e{i}{j}" for i, j in ways)
        sums = ", ".join(f"sum(g{j} * x{k}) / sum(g{j}) AS m{j}_{k}, sum(g{j} * x{k} * x{k}) / sum(g{j}) AS q{j}_{k}" for j, k in both)
        out.append(f"c{n} AS MATERIALIZED (SELECT symbol, {_each(lambda j: f'sum(CASE WHEN r = 1 THEN g{j} END) AS s{j}', STATES)}, {moved}, {sums}, sum(ln(z) + top) AS loglik FROM g{n} GROUP BY 1)")
        out.append(
            f"p{n + 1} AS MATERIALIZED (SELECT symbol, s1, s2, {_each(lambda w: f'e{w[0]}{w[1]} / (e{w[0]}1 + e{w[0]}2) AS a{w[0]}{w[1]}', ways)}, "
            f"{_each(lambda w: f'm{w[0]}_{w[1]}, greatest(q{w[0]}_{w[1]} - m{w[0]}_{w[1]} * m{w[0]}_{w[1]}, {floor}) AS v{w[0]}_{w[1]}', both)}, loglik FROM c{n})"
        )
    return ",\n".join(out + _expected(rounds, dims))


def _expected(n: int, dims: int) -> list[str]:
    """Tables of the densities under model ``n``, of what lies before and after each row, and g{n} with the chances g1, g2 of the states."""
    d = range(1, dims + 1)
    log = lambda j: "-0.5 * (" + " + ".join(f"pow(x{k} - m{j}_{k}, 2) / v{j}_{k} + ln(2 * pi() * v{j}_{k})" for k in d) + ")"
    new = lambda j: f"(q.al1 * b.a1{j} + q.al2 * b.a2{j}) * b.b{j}"
    old = lambda i: f"(b.a{i}1 * b.b1 * q.be1 + b.a{i}2 * b.b2 * q.be2)"
    return [
        f"l{n} AS (SELECT x.*, p.* EXCLUDE (symbol), {log(1)} AS l1, {log(2)} AS l2 FROM x JOIN p{n} p ON p.symbol = x.symbol)",
        f"b{n} AS MATERIALIZED (SELECT *, greatest(l1, l2) AS top, exp(l1 - greatest(l1, l2)) AS b1, exp(l2 - greatest(l1, l2)) AS b2 FROM l{n})",
        f"u{n} AS (SELECT symbol, r, s1 * b1 / (s1 * b1 + s2 * b2) AS al1, s2 * b2 / (s1 * b1 + s2 * b2) AS al2, s1 * b1 + s2 * b2 AS z FROM b{n} WHERE r = 1 UNION ALL "
        f"SELECT b.symbol, b.r, {new(1)} / ({new(1)} + {new(2)}), {new(2)} / ({new(1)} + {new(2)}), {new(1)} + {new(2)} FROM u{n} q JOIN b{n} b ON b.symbol = q.symbol AND b.r = q.r + 1)",
        f"w{n} AS (SELECT symbol, r, CAST(1 AS DOUBLE) AS be1, CAST(1 AS DOUBLE) AS be2 FROM b{n} WHERE r = n UNION ALL "
        f"SELECT b.symbol, b.r - 1, {old(1)} / ({old(1)} + {old(2)}), {old(2)} / ({old(1)} + {old(2)}) FROM w{n} q JOIN b{n} b ON b.symbol = q.symbol AND b.r = q.r WHERE b.r > 1)",
        f"h{n} AS MATERIALIZED (SELECT b.*, u.al1, u.al2, u.z, w.be1, w.be2, lag(u.al1) OVER o AS o1, lag(u.al2) OVER o AS o2 FROM b{n} b JOIN u{n} u ON u.symbol = b.symbol AND u.r = b.r "
        f"JOIN w{n} w ON w.symbol = b.symbol AND w.r = b.r WINDOW o AS (PARTITION BY b.symbol ORDER BY b.r))",
        f"g{n} AS MATERIALIZED (SELECT *, al1 * be1 / (al1 * be1 + al2 * be2) AS g1, al2 * be2 / (al1 * be1 + al2 * be2) AS g2, "
        + ", ".join(f"o{i} * a{i}{j} * b{j} * be{j} AS w{i}{j}" for i in STATES for j in STATES)
        + f" FROM h{n})",
    ]


def hmm_model(n: int, dims: int) -> str:
    """The models after ``n`` rounds, a row for each symbol and state."""
    d = range(1, dims + 1)
    row = lambda j: f"SELECT symbol, {j - 1} AS state, round(s{j}, 6) AS start_p, round(a{j}{j}, 6) AS stay_p, {_each(lambda k: f'round(m{j}_{k}, 6) AS m{k}, round(v{j}_{k}, 6) AS v{k}', d)}, round(loglik, 4) AS loglik FROM p{n}"
    return f"{row(1)} UNION ALL {row(2)}"


def hmm_path(n: int) -> str:
    """Tables d and y of the likeliest path under model ``n``, and the rows with state and confidence."""
    way = lambda i, j: f"q.d{i} + ln(b.a{i}{j})"
    most = lambda j: f"greatest({way(1, j)}, {way(2, j)}) + b.l{j}"
    return f"""d AS (SELECT symbol, r, n, ln(s1) + l1 AS d1, ln(s2) + l2 AS d2, 0 AS k1, 0 AS k2 FROM b{n} WHERE r = 1 UNION ALL
    SELECT b.symbol, b.r, b.n, {most(1)}, {most(2)}, CAST({way(2, 1)} > {way(1, 1)} AS INT), CAST({way(2, 2)} > {way(1, 2)} AS INT) FROM d q JOIN b{n} b ON b.symbol = q.symbol AND b.r = q.r + 1),
    y AS (SELECT symbol, r, CAST(d2 > d1 AS INT) AS state FROM d WHERE r = n UNION ALL
    SELECT q.symbol, q.r - 1, CASE WHEN q.state = 1 THEN d.k2 ELSE d.k1 END FROM y q JOIN d ON d.symbol = q.symbol AND d.r = q.r WHERE q.r > 1)
    SELECT g.symbol, g.t, y.state, round(greatest(g.g1, g.g2), 6) AS confidence FROM g{n} g JOIN y ON y.symbol = g.symbol AND y.r = g.r"""
