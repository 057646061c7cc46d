"""SQL of numeric steps over windows held as lists, for the queries' oracles.

Written from the definitions (difference equations, least squares, Fourier sums) and not from the kernels, whose results
they check. Lists count from 1.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: Windows of a supplier's line items: a(subject_id, win, x, y), IR in x and red in y.
SIZE = 200
SUPPLIERS = f"""r AS (
  SELECT l_suppkey AS subject_id, l_extendedprice AS ir, l_quantity AS red,
    row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS seq FROM lineitem
), c AS (SELECT *, (seq - 1) // {SIZE} AS win, (seq - 1) % {SIZE} AS i, count(*) OVER (PARTITION BY subject_id, (seq - 1) // {SIZE}) AS n FROM r),
a AS (SELECT subject_id, CAST(win AS BIGINT) AS win, list(ir ORDER BY i) AS x, list(red ORDER BY i) AS y FROM c WHERE n = {SIZE} GROUP BY ALL)"""


def numbers(values: Sequence[float]) -> str:
    return "[" + ", ".join(repr(float(v)) for v in values) + "]::DOUBLE[]"


def savgol(x: str, n: int, window: int, degree: int) -> str:
    """Least-squares smoothing of the list x of length n; the ends from the first and the last whole window."""
    h = window // 2
    fit = [np.polyfit(np.arange(-h, h + 1), unit, degree) for unit in np.eye(window)]
    rows = np.array([[np.polyval(f, at) for f in fit] for at in range(-h, h + 1)])
    middle = f"list_transform(range(1, {n - 2 * h + 1}), lambda i: list_dot_product({x}[i:i + {window - 1}], {numbers(rows[h])}))"
    left = "[" + ", ".join(f"list_dot_product({x}[1:{window}], {numbers(r)})" for r in rows[:h]) + "]"
    right = "[" + ", ".join(f"list_dot_product({x}[{n - window + 1}:{n}], {numbers(r)})" for r in rows[h + 1 :]) + "]"
    return f"list_concat(list_concat({left}, {middle}), {right})"


def gradient(x: str, n: int, times: float = 1.0) -> str:
    return f"list_concat(list_concat([({x}[2] - {x}[1]) * {times}], list_transform(range(2, {n}), lambda i: ({x}[i + 1] - {x}[i - 1]) / 2 * {times})), [({x}[{n}] - {x}[{n - 1}]) * {times}])"


def median3(x: str, n: int) -> str:
    """Zeros lie outside."""
    at = lambda k: f"(CASE WHEN i + {k} BETWEEN 1 AND {n} THEN {x}[i + {k}] ELSE 0.0 END)"
    a, b, c = at(-1), at(0), at(1)
    return f"list_transform(range(1, {n + 1}), lambda i: greatest(least({a}, {b}), least(greatest({a}, {b}), {c})))"


def sections(hertz: float, fs: float, high: bool) -> list[tuple[float, ...]]:
    """Fourth-order Butterworth as two sections (b0 b1 b2 a1 a2), by the bilinear transform of each pole pair's quality."""
    k, out = np.tan(np.pi * hertz / fs), []
    for angle in (np.pi / 8, 3 * np.pi / 8):
        q = 1 / (2 * np.cos(angle))
        norm = 1 / (1 + k / q + k * k)
        b = (norm, -2 * norm, norm) if high else (k * k * norm, 2 * k * k * norm, k * k * norm)
        out.append((*b, 2 * (k * k - 1) * norm, (1 - k / q + k * k) * norm))
    return [tuple(float(v) for v in row) for row in out]


def zero_phase(name: str, source: str, n: int, hertz: float, fs: float, high: bool, keys: str = "subject_id, win") -> str:
    """CTEs that end in ``name`` (keys, x): the list x of ``source`` filtered forward and backward over an odd extension of 15."""
    (b0, b1, b2, a1, a2), (c0, c1, c2, d1, d2) = sections(hertz, fs, high)
    p, dc = 15, 0.0 if high else 1.0
    ext = f"list_concat(list_concat(list_transform(range(0, {p}), lambda i: 2 * x[1] - x[{p + 1} - i]), x), list_transform(range(1, {p + 1}), lambda i: 2 * x[{n}] - x[{n} - i]))"
    m = n + 2 * p

    def one(out: str, src: str) -> str:
        return f"""{out}_r AS (
  SELECT {keys}, 0 AS i, e, ({dc!r} - {b0!r}) * e[1] AS s1, ({b2!r} - {a2!r} * {dc!r}) * e[1] AS s2, ({dc!r} - {c0!r}) * {dc!r} * e[1] AS t1, ({c2!r} - {d2!r} * {dc!r}) * {dc!r} * e[1] AS t2, 0.0::DOUBLE AS v FROM {src}
  UNION ALL
  SELECT {keys}, i + 1, e, {b1!r} * e[i + 1] - {a1!r} * u + s2, {b2!r} * e[i + 1] - {a2!r} * u, {c1!r} * u - {d1!r} * z + t2, {c2!r} * u - {d2!r} * z, z
  FROM (SELECT *, {c0!r} * u + t1 AS z FROM (SELECT *, {b0!r} * e[i + 1] + s1 AS u FROM {out}_r WHERE i < {m}))
), {out} AS (SELECT {keys}, list(v ORDER BY i DESC) AS e FROM {out}_r WHERE i > 0 GROUP BY ALL)"""

    return f"{name}_0 AS (SELECT {keys}, {ext} AS e FROM {source}), {one(name + '_1', name + '_0')}, {one(name + '_2', name + '_1')}, {name} AS (SELECT {keys}, e[{p + 1}:{p + n}] AS x FROM {name}_2)"


def waves(name: str, n: int) -> str:
    """CTE of the Fourier waves of n samples: k, re, im."""
    wave = lambda f: f"list_transform(range(0, {n}), lambda i: {f}(2 * pi() * k * i / {n}))"
    return f"{name} AS (SELECT k, {wave('cos')} AS re, {wave('sin')} AS im FROM range(0, {n // 2 + 1}) t(k))"


def power(x: str, wave: str) -> str:
    """Squared magnitude of the list x at the waves of ``wave``."""
    return f"(list_dot_product({x}, {wave}.re) ** 2 + list_dot_product({x}, {wave}.im) ** 2)"


def hann(x: str, n: int) -> str:
    """The list x of length n under a periodic Hann window."""
    return f"list_transform({x}, lambda e, i: e * (0.5 - 0.5 * cos(2 * pi() * (i - 1) / {n})))"


def centred(x: str) -> str:
    return f"list_transform({x}, lambda v: v - list_avg({x}))"


def doubled(k: str, n: int) -> str:
    """Factor of a one-sided spectrum."""
    return f"(CASE WHEN {k} BETWEEN 1 AND {(n + 1) // 2 - 1} THEN 2.0 ELSE 1.0 END)"


def peaks(name: str, source: str, distance: float, least: str, keys: str = "subject_id, win") -> str:
    """CTEs that end in ``name`` (keys, i, h, m, from 0): strict maxima of the list x of ``source``, thinned to the distance
    (higher ones first), with a prominence m of at least ``least``, an expression over ``source``."""
    d = int(np.ceil(distance))
    on = " AND ".join(f"q.{k.strip()} = o.{k.strip()}" for k in keys.split(","))
    return f"""{name}_s AS (SELECT {keys}, x, {least} AS least FROM {source}),
{name}_l AS (SELECT {keys}, unnest(x) AS h, generate_subscripts(x, 1) - 1 AS i FROM {name}_s),
{name}_m AS (SELECT {keys}, i, h FROM (SELECT *, lag(h) OVER w AS before, lead(h) OVER w AS after FROM {name}_l WINDOW w AS (PARTITION BY {keys} ORDER BY i)) WHERE h > before AND h > after),
{name}_t AS (
  SELECT {keys}, list({{'h': h, 'i': i}} ORDER BY h DESC, i DESC) AS rest, []::BIGINT[] AS kept FROM {name}_m GROUP BY ALL
  UNION ALL
  SELECT {keys}, list_filter(rest, lambda p: abs(p.i - rest[1].i) >= {d}), list_append(kept, rest[1].i) FROM {name}_t WHERE len(rest) > 0
),
{name}_k AS (SELECT {keys}, unnest(kept) AS i FROM {name}_t WHERE len(rest) = 0),
{name}_b AS (
  SELECT {", ".join("o." + k.strip() for k in keys.split(","))}, o.i, x[o.i + 1] AS h, x, least,
    coalesce(list_max(list_filter(range(1, o.i + 1), lambda j: x[j] > x[o.i + 1])), 0) AS l, coalesce(list_min(list_filter(range(o.i + 2, len(x) + 1), lambda j: x[j] > x[o.i + 1])), len(x) + 1) AS r
  FROM {name}_k o JOIN {name}_s q ON {on}
),
{name} AS (SELECT {keys}, i, h, m FROM (SELECT *, h - greatest(list_min(x[l + 1:i + 1]), list_min(x[i + 1:r - 1])) AS m FROM {name}_b) WHERE m >= least)"""


def half_width(x: str, i: str, prominence: str) -> str:
    """Width in samples of the peak at i (from 0) of the list x where it has half its prominence."""
    level = f"({x}[{i} + 1] - {prominence} / 2)"
    j = f"list_max(list_filter(range(1, {i} + 2), lambda j: {x}[j] <= {level}))"
    k = f"list_min(list_filter(range({i} + 1, len({x}) + 1), lambda j: {x}[j] <= {level}))"
    left = f"CASE WHEN {j} IS NULL THEN 0.0 WHEN {x}[{j}] < {level} THEN {j} - 1 + ({level} - {x}[{j}]) / ({x}[{j} + 1] - {x}[{j}]) ELSE {j} - 1.0 END"
    right = f"CASE WHEN {k} IS NULL THEN len({x}) - 1.0 WHEN {x}[{k}] < {level} THEN {k} - 1 - ({level} - {x}[{k}]) / ({x}[{k} - 1] - {x}[{k}]) ELSE {k} - 1.0 END"
    return f"(({right}) - ({left}))"
