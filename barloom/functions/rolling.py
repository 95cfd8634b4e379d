"""Full-window rolling statistics in O(log n) steps per row.

A sliding frame re-reads its ``n`` rows for every row.  Here statistics are *merged*
instead: if a column holds a statistic of the last ``m`` rows, combining it with its own
``lag(m)`` gives the last ``2m`` rows; a window of any length is a combination of such
power-of-two pieces.  Means and central moments use the pairwise update formulas, which
are exact zero on constant windows and do not cancel.  Every step only needs ``lag`` over
one shared window, so however many columns and window lengths are asked for the plan
keeps one exchange and one sort.

NULL propagates through the arithmetic, hence a value appears exactly when the window
holds ``n`` non-null rows.  For partially filled windows use ``Series.roll``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.expr import SD_FLOOR
from barloom.functions.series import Series

# Statistic -> the running quantities it is made of (s: sum, m2..m4: central sums).
PARTS = {
    "sum": ("s",),
    "mean": ("s",),
    "std": ("s", "m2"),
    "zscore": ("s", "m2"),
    "skew": ("s", "m2", "m3"),
    "kurt": ("s", "m2", "m3", "m4"),
    "min": ("min",),
    "max": ("max",),
}


def _merge(part: str, a: dict[str, str], b: dict[str, str], na: int, nb: int) -> str:
    """Formula for a quantity over two adjacent pieces of ``na`` and ``nb`` rows."""
    n = na + nb
    if part == "s":
        return f"{a['s']} + {b['s']}"
    if part in ("min", "max"):
        fn = "least" if part == "min" else "greatest"
        # least/greatest skip NULL; a missing piece must blank the window.
        return f"if({a[part]} is null or {b[part]} is null, null, {fn}({a[part]}, {b[part]}))"
    d = f"({b['s']} / {nb}D - {a['s']} / {na}D)"
    if part == "m2":
        return f"{a['m2']} + {b['m2']} + {d} * {d} * {na * nb / n!r}D"
    if part == "m3":
        skew = "" if na == nb else f" + {d} * {d} * {d} * {na * nb * (na - nb) / n**2!r}D"
        return f"{a['m3']} + {b['m3']}{skew} + 3D * {d} * ({na}D * {b['m2']} - {nb}D * {a['m2']}) / {n}D"
    if part == "m4":
        k = na * nb * (na * na - na * nb + nb * nb) / n**3
        return (
            f"{a['m4']} + {b['m4']} + {d} * {d} * {d} * {d} * {k!r}D"
            f" + 6D * {d} * {d} * ({na * na}D * {b['m2']} + {nb * nb}D * {a['m2']}) / {n * n}D"
            f" + 4D * {d} * ({na}D * {b['m3']} - {nb}D * {a['m3']}) / {n}D"
        )
    other = f"({b['t']} / {nb}D - {a['t']} / {na}D)"
    if part == "t":
        return f"{a['t']} + {b['t']}"
    if part == "t2":
        return f"{a['t2']} + {b['t2']} + {other} * {other} * {na * nb / n!r}D"
    return f"{a['c']} + {b['c']} + {d} * {other} * {na * nb / n!r}D"


# A pair (x, y) carries sums s, t, central sums m2, t2 and the cross sum c.
PAIR = ("s", "m2", "t", "t2", "c")


def _binary(n: int) -> list[int]:
    """Powers of two summing to ``n``, largest first."""
    return [1 << j for j in range(n.bit_length() - 1, -1, -1) if n >> j & 1]


def _pieces(n: int, idempotent: bool) -> list[tuple[int, int]]:
    """(length, offset) of the pieces covering the last ``n`` rows."""
    top = 1 << (n.bit_length() - 1)
    if idempotent:
        return [(top, 0)] if top == n else [(top, 0), (top, n - top)]
    out, offset = [], 0
    for size in _binary(n):
        out.append((size, offset))
        offset += size
    return out


def _final(stat: str, n: int, x: str, q: dict[str, str]) -> str:
    sd = f"sqrt({q['m2']} / {n - 1}D)" if "m2" in q else ""
    if stat in ("sum", "min", "max"):
        return q["s"] if stat == "sum" else q[stat]
    if stat == "mean":
        return f"{q['s']} / {n}D"
    if stat == "std":
        return sd
    guard = f"{sd} > {SD_FLOOR}D"
    if stat == "zscore":
        return f"if({guard}, ({x} - {q['s']} / {n}D) / {sd}, null)"
    if stat == "skew":
        scale = (n * (n - 1)) ** 0.5 / (n - 2) * n**0.5
        return f"if({guard}, {scale!r}D * {q['m3']} / power({q['m2']}, 1.5D), null)"
    if stat == "kurt":
        a, b = (n - 1) / ((n - 2) * (n - 3)), n + 1
        excess = f"({n}D * {q['m4']} / ({q['m2']} * {q['m2']}) - 3D)"
        return f"if({guard}, {a!r}D * ({b}D * {excess} + 6D), null)"
    if stat == "corr":
        sx, sy = sd, f"sqrt({q['t2']} / {n - 1}D)"
        return (
            f"if({sx} > {SD_FLOOR}D and {sy} > {SD_FLOOR}D, "
            f"{q['c']} / {n - 1}D / ({sx} * {sy}), null)"
        )
    raise ValueError(f"unknown statistic {stat!r}")


def add_rolling(df: DataFrame, series: Series, specs: dict[str, tuple]) -> DataFrame:
    """Add ``{output: (statistic, column, rows)}``.

    Statistics: sum, mean, std, zscore, skew, kurt, min, max and corr (whose column is
    a pair of names).
    """
    before = df.columns
    inputs: dict[object, str] = {}
    need: dict[str, set[str]] = {}
    deepest: dict[str, int] = {}
    plan = []
    for out, (stat, x, n) in specs.items():
        tag = inputs.setdefault(x, f"_q{len(inputs)}")
        parts = PAIR if stat == "corr" else PARTS[stat]
        need.setdefault(tag, set()).update(parts)
        deepest[tag] = max(deepest.get(tag, 1), 1 << (n.bit_length() - 1))
        plan.append((out, stat, x, n, tag, parts))
    name = lambda tag, part, m: f"{tag}_{part}_{m}"
    order = ("s", "t", "m2", "t2", "c", "m3", "m4", "min", "max")
    parts_of = {t: [p for p in order if p in ps] for t, ps in need.items()}

    base = {}
    for x, tag in inputs.items():
        if isinstance(x, tuple):
            a = f"if({x[1]} is null, null, {x[0]})"
            b = f"if({x[0]} is null, null, {x[1]})"
        else:
            a = b = x
        for p in parts_of[tag]:
            value = b if p == "t" else a if p in ("s", "min", "max") else f"if({a} is null, null, 0D)"
            base[name(tag, p, 1)] = F.expr(f"cast({value} as double)")
    df = df.withColumns(base)

    m = 1
    while m < max(deepest.values()):
        lags, merged = {}, {}
        for tag, parts in parts_of.items():
            if deepest[tag] > m:
                here = {p: name(tag, p, m) for p in parts}
                back = {p: f"_l_{here[p]}" for p in parts}
                lags.update({back[p]: series.lag(here[p], m) for p in parts})
                merged.update(
                    {name(tag, p, 2 * m): F.expr(_merge(p, here, back, m, m)) for p in parts}
                )
        df = df.withColumns(lags).withColumns(merged).drop(*lags)
        m *= 2

    # All pieces of all windows come from one more window operator ...
    lags, chains = {}, {}
    for _, stat, _, n, tag, parts in plan:
        for p in parts:
            key = (tag, p, n)
            if key in chains:
                continue
            chain = []
            for size, offset in _pieces(n, p in ("min", "max")):
                c = name(tag, p, size)
                if offset:
                    at = f"{c}_at_{offset}"
                    lags[at] = series.lag(c, offset)
                    c = at
                chain.append((size, c))
            chains[key] = chain
    df = df.withColumns(lags) if lags else df

    # ... and are merged left to right, one projection per further piece.
    state = {k: [c[0][0], c[0][1]] for k, c in chains.items()}
    for i in range(1, max(len(c) for c in chains.values())):
        merged, after = {}, {}
        for (tag, p, n), chain in chains.items():
            if i < len(chain):
                mates = [q for q in parts_of[tag] if (tag, q, n) in chains and len(chains[tag, q, n]) > i]
                a = {q: state[tag, q, n][1] for q in mates}
                b = {q: chains[tag, q, n][i][1] for q in mates}
                out = f"{tag}_{p}_w{n}_{i}"
                merged[out] = F.expr(_merge(p, a, b, state[tag, p, n][0], chain[i][0]))
                after[tag, p, n] = [state[tag, p, n][0] + chain[i][0], out]
        df = df.withColumns(merged)
        state.update(after)
    final = {}
    for out, stat, x, n, tag, parts in plan:
        final[out] = F.expr(_final(stat, n, x, {p: state[tag, p, n][1] for p in parts}))
    df = df.withColumns(final)
    return df.select(*before, *[c for c in specs if c not in before])
