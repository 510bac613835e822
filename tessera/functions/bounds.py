"""Axis-aligned boxes: building, measuring and broad-phase predicates.

Boxes are six columns minx..maxz (with an optional prefix). Intervals are
closed. Divisions by a ray's direction are guarded, as a zero component makes
a slab a plain range test.
"""

from __future__ import annotations

from .vectors import AXES, Vec, vec

INF = "cast('Infinity' as double)"


def low(prefix: str = "") -> Vec:
    return vec(f"{prefix}min")


def high(prefix: str = "") -> Vec:
    return vec(f"{prefix}max")


def of_points(points: list[Vec], prefix: str = "") -> dict[str, str]:
    """Bounds of some vectors of one row."""
    return {f"{prefix}{f}{c}": f"{g}({', '.join(p[i] for p in points)})" for f, g in (("min", "least"), ("max", "greatest")) for i, c in enumerate(AXES)}


def union_of(prefix: str = "", out: str = "") -> dict[str, str]:
    """Aggregates: the bounds of the bounds of many rows."""
    return {f"{out}{f}{c}": f"{f}({prefix}{f}{c})" for f in ("min", "max") for c in AXES}


def overlap(a: str, b: str) -> str:
    return " and ".join(f"{a}min{c} <= {b}max{c} and {b}min{c} <= {a}max{c}" for c in AXES)


def contains_box(a: str, b: str) -> str:
    return " and ".join(f"{a}min{c} <= {b}min{c} and {b}max{c} <= {a}max{c}" for c in AXES)


def contains_point(a: str, p: Vec) -> str:
    return " and ".join(f"{a}min{c} <= {x} and {x} <= {a}max{c}" for c, x in zip(AXES, p))


def surface_area(prefix: str = "") -> str:
    x, y, z = (f"({prefix}max{c} - {prefix}min{c})" for c in AXES)
    return f"(2e0 * ({x} * {y} + {y} * {z} + {z} * {x}))"


def longest_axis(prefix: str = "") -> str:
    """0, 1 or 2; the first wins ties."""
    x, y, z = (f"({prefix}max{c} - {prefix}min{c})" for c in AXES)
    return f"case when {x} >= {y} and {x} >= {z} then 0 when {y} >= {z} then 1 else 2 end"


def distance2_to_point(prefix: str, p: Vec) -> str:
    """Squared distance from a point to the box; 0 inside."""
    gaps = [f"greatest({prefix}min{c} - {x}, 0e0, {x} - {prefix}max{c})" for c, x in zip(AXES, p)]
    return "(" + " + ".join(f"{g} * {g}" for g in gaps) + ")"


def sphere_overlaps(prefix: str, center: Vec, radius: str) -> str:
    return f"{distance2_to_point(prefix, center)} <= {radius} * {radius}"


def ray_interval(prefix: str, o: Vec, d: Vec) -> list[dict[str, str]]:
    """Steps: t_in and t_out of a ray's line in the box; t_in > t_out if it misses."""
    step: dict[str, str] = {}
    for c, x, y in zip(AXES, o, d):
        a, b = f"({prefix}min{c} - {x})", f"({prefix}max{c} - {x})"
        inside = f"{prefix}min{c} <= {x} and {x} <= {prefix}max{c}"
        step[f"in_{c}"] = f"case when {y} = 0e0 then case when {inside} then -{INF} else {INF} end when {y} > 0e0 then {a} / {y} else {b} / {y} end"
        step[f"out_{c}"] = f"case when {y} = 0e0 then case when {inside} then {INF} else -{INF} end when {y} > 0e0 then {b} / {y} else {a} / {y} end"
    return [step, {"t_in": "greatest(in_x, in_y, in_z)", "t_out": "least(out_x, out_y, out_z)"}]


def ray_hits(near: str = "0e0", far: str = INF) -> str:
    """After ray_interval: whether the box is met between near and far (in direction lengths)."""
    return f"t_in <= t_out and t_in <= {far} and t_out >= {near}"


def plane_side(prefix: str, normal: Vec, constant: str) -> str:
    """-1 wholly behind the plane n.p + constant = 0, 1 wholly in front, 0 across."""
    near = " + ".join(f"{n} * case when {n} >= 0e0 then {prefix}max{c} else {prefix}min{c} end" for n, c in zip(normal, AXES))
    away = " + ".join(f"{n} * case when {n} >= 0e0 then {prefix}min{c} else {prefix}max{c} end" for n, c in zip(normal, AXES))
    return f"case when {near} + {constant} < 0e0 then -1 when {away} + {constant} >= 0e0 then 1 else 0 end"
