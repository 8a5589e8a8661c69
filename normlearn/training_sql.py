"""DuckDB SQL of whole training runs, one common table expression a step of an iteration.

Written from the formulas alone: the objective is the sum of log(1 + exp(-y w.x))
over the joined rows plus half of lambda |w|^2.  A statement is unrolled for a
number of iterations, and takes a table ``t`` (label, x0, x1, ...).
"""

from __future__ import annotations

HALVINGS = 40


def _dot(a: list[str], b: list[str]) -> str:
    return "(" + " + ".join(f"{x} * {y}" for x, y in zip(a, b, strict=True)) + ")"


def _list(expressions: list[str], names: list[str]) -> str:
    return ", ".join(f"{e} AS {n}" for e, n in zip(expressions, names, strict=True))


class Run:
    """The common table expressions of a run.  Each is one row and has all columns of the one before."""

    def __init__(self, d: int, algo: str, iters: int, start: float, w0: float, regularizer: float) -> None:
        self.d, self.algo, self.regularizer = d, algo, regularizer
        self.tables: list[str] = []
        self.x = [f"x{i}" for i in range(d)]
        w = self.vector("w", 0)
        self.last = self.add("begin", f"SELECT {_list([f'{w0!r}::DOUBLE'] * d, w)}, {start!r}::DOUBLE AS start0", None)
        for k in range(iters):
            self.iteration(k)

    def vector(self, name: str, k: int) -> list[str]:
        return [f"{name}{k}_{i}" for i in range(self.d)]

    def add(self, name: str, body: str, source: str | None) -> str:
        self.tables.append(f"{name} AS MATERIALIZED ({body}{f' FROM {source}' if source else ''})")
        self.last = name
        return name

    def more(self, name: str, expressions: list[str], names: list[str]) -> None:
        """Another expression with the columns of the last one and more."""
        self.add(name, f"SELECT *, {_list(expressions, names)}", self.last)

    def iteration(self, k: int) -> None:
        w, g, p = self.vector("w", k), self.vector("g", k), self.vector("p", k)
        m = f"(label * {_dot(w, self.x)})"
        sums = [f"coalesce(sum(-label / (1 + exp({m})) * {x}), 0)" for x in self.x]
        loss = f"coalesce(sum(greatest(-{m}, 0) + ln(1 + exp(-abs({m})))), 0)"
        self.add(f"sums{k}", f"SELECT {loss} AS l, {_list(sums, [f's{i}' for i in range(self.d)])} FROM t, {self.last}", None)
        self.add(
            f"at{k}",
            f"SELECT q.*, l + {self.regularizer * 0.5!r}::DOUBLE * {_dot(w, w)} AS loss{k}, "
            + _list([f"s{i} + {self.regularizer!r}::DOUBLE * {w[i]}" for i in range(self.d)], g),
            f"sums{k}, {self._before(k)} q",
        )
        self.direction(k)
        start = "1.0::DOUBLE" if self.algo.startswith("lbfgs") else f"start{k}"
        self.more(f"slope{k}", [_dot(g, p), start], [f"slope{k}", f"first{k}"])
        moved = [f"(({a} + alpha * {b}))" for a, b in zip(w, p, strict=True)]
        z = f"(label * {_dot(moved, self.x)})"
        self.tables.append(
            f"trial{k} AS MATERIALIZED (SELECT h, any_value(alpha) AS alpha, sum(greatest(-{z}, 0) + ln(1 + exp(-abs({z})))) "
            f"+ {self.regularizer * 0.5!r}::DOUBLE * any_value({_dot(moved, moved)}) AS phi "
            f"FROM t, (SELECT *, first{k} * pow(0.5::DOUBLE, h) AS alpha FROM {self.last}, range({HALVINGS}) r(h)) GROUP BY h)"
        )
        self.tables.append(
            f"taken{k} AS MATERIALIZED (SELECT min(h) AS h FROM trial{k}, {self.last} "
            f"WHERE phi <= loss{k} + 0.0001::DOUBLE * alpha * slope{k})"
        )
        before = self.last
        self.add(f"step{k}", f"SELECT q.*, h + 1 AS trials{k}, first{k} * pow(0.5::DOUBLE, h) AS alpha{k}", f"{before} q, taken{k}")
        following = [f"{a} + 1.2::DOUBLE * alpha{k} * {b}" for a, b in zip(w, p, strict=True)]
        self.more(f"moved{k}", [*following, f"1.2::DOUBLE * alpha{k}"], [*self.vector("w", k + 1), f"start{k + 1}"])

    def _before(self, k: int) -> str:
        return f"moved{k - 1}" if k else "begin"

    def direction(self, k: int) -> None:
        g, p = self.vector("g", k), self.vector("p", k)
        if self.algo == "bgd" or not k:
            self.more(f"dir{k}", [f"-{x}" for x in g], p)
        elif self.algo == "cgd":
            old, way = self.vector("g", k - 1), self.vector("p", k - 1)
            beta = f"{_dot(g, g)} / {_dot(old, old)}"
            self.more(f"dir{k}", [f"-{a} + {beta} * {b}" for a, b in zip(g, way, strict=True)], p)
        else:
            self.quasi_newton(k)

    def quasi_newton(self, k: int) -> None:
        """Two passes over the last five differences of points (s) and of gradients (t)."""
        s = [f"{a} - {b}" for a, b in zip(self.vector("w", k), self.vector("w", k - 1), strict=True)]
        t = [f"{a} - {b}" for a, b in zip(self.vector("g", k), self.vector("g", k - 1), strict=True)]
        self.more(f"pair{k}", s + t, self.vector("s", k - 1) + self.vector("t", k - 1))
        kept = list(range(max(0, k - 5), k))
        q = self.vector("g", k)
        for j in reversed(kept):
            s, t, c = self.vector("s", j), self.vector("t", j), f"c{k}_{j}"
            self.more(f"c{k}x{j}", [f"{_dot(s, q)} / {_dot(s, t)}"], [c])
            new = [f"q{k}_{j}_{i}" for i in range(self.d)]
            self.more(f"q{k}x{j}", [f"{a} - {c} * {b}" for a, b in zip(q, t, strict=True)], new)
            q = new
        s, t = self.vector("s", k - 1), self.vector("t", k - 1)
        r = [f"r{k}_{i}" for i in range(self.d)]
        self.more(f"r{k}", [f"{_dot(s, t)} / {_dot(t, t)} * {a}" for a in q], r)
        for j in kept:
            s, t = self.vector("s", j), self.vector("t", j)
            c = f"{_dot(s, q)} / {_dot(s, t)}" if self.algo == "lbfgs_compat" else f"c{k}_{j}"
            self.more(f"e{k}x{j}", [f"{c} - {_dot(t, r)} / {_dot(s, t)}"], [f"e{k}_{j}"])
            new = [f"r{k}_{j}_{i}" for i in range(self.d)]
            self.more(f"r{k}x{j}", [f"{a} + e{k}_{j} * {b}" for a, b in zip(r, s, strict=True)], new)
            r = new
        self.more(f"dir{k}", [f"-{a}" for a in r], self.vector("p", k))

    def trace(self, iters: int) -> str:
        """iter, loss, grad_norm, ls_count, alpha."""
        rows = [
            f"SELECT {k + 1} AS iter, loss{k} AS loss, sqrt({_dot(self.vector('g', k), self.vector('g', k))}) AS grad_norm, "
            f"trials{k} AS ls_count, alpha{k} AS alpha FROM {self.last}"
            for k in range(iters)
        ]
        return " UNION ALL ".join(rows)


def trace(base: str, algo: str, iters: int, start: float, w0: float, regularizer: float, d: int = 5, tolerance: float | None = None) -> str:
    """The trace of a run over ``base`` (which defines t), rounded to 4 decimals (the step to 9).

    With a tolerance the run ends where the loss decreased by no more than this part;
    that row has no step.
    """
    run = Run(d, algo, iters, start, w0, regularizer)
    out = f"{base}, {', '.join(run.tables)}, trace AS ({run.trace(iters)})"
    step = "ls_count::INT AS ls_count, round(alpha, 9) + 0.0 AS alpha"
    rows = "trace"
    if tolerance is not None:
        out += f""", gain AS (SELECT *, lag(loss) OVER (ORDER BY iter) AS old FROM trace),
ended AS (SELECT coalesce(min(iter), {iters + 1}) AS stop FROM gain WHERE (old - loss) / old <= {tolerance!r}::DOUBLE)"""
        rows = "trace, ended WHERE iter <= stop"
        step = "CASE WHEN iter < stop THEN ls_count END::INT AS ls_count, CASE WHEN iter < stop THEN round(alpha, 9) + 0.0 END AS alpha"
    return f"{out} SELECT iter::INT AS iter, round(loss, 4) + 0.0 AS loss, round(grad_norm, 4) + 0.0 AS grad_norm, {step} FROM {rows}"


def model(base: str, algo: str, iters: int, start: float, w0: float, regularizer: float, d: int = 5) -> str:
    """The coefficients after a run, rounded to 6 decimals."""
    run = Run(d, algo, iters, start, w0, regularizer)
    rows = " UNION ALL ".join(f"SELECT {i} AS i, round({x}, 6) + 0.0 AS w FROM {run.last}" for i, x in enumerate(run.vector("w", iters)))
    return f"{base}, {', '.join(run.tables)} {rows}"
