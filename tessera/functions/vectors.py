"""Three-dimensional vectors as triples of SQL expressions."""

from __future__ import annotations

Vec = tuple[str, str, str]
AXES = ("x", "y", "z")


def vec(prefix: str) -> Vec:
    """The columns prefix_x.. as a vector: vec('a') is (ax, ay, az)."""
    return tuple(f"{prefix}{c}" for c in AXES)


def named(prefix: str, v: Vec) -> dict[str, str]:
    return dict(zip(vec(prefix), v))


def add(a: Vec, b: Vec) -> Vec:
    return tuple(f"({x} + {y})" for x, y in zip(a, b))


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(f"({x} - {y})" for x, y in zip(a, b))


def scale(a: Vec, s: str) -> Vec:
    return tuple(f"({x} * {s})" for x in a)


def dot(a: Vec, b: Vec) -> str:
    return "(" + " + ".join(f"{x} * {y}" for x, y in zip(a, b)) + ")"


def cross(a: Vec, b: Vec) -> Vec:
    (ax, ay, az), (bx, by, bz) = a, b
    return f"({ay} * {bz} - {az} * {by})", f"({az} * {bx} - {ax} * {bz})", f"({ax} * {by} - {ay} * {bx})"


def length2(a: Vec) -> str:
    return dot(a, a)


def length(a: Vec) -> str:
    return f"sqrt{dot(a, a)}"


def affine(m: list[str], v: Vec, w: str = "1e0") -> Vec:
    """Column-major 4x4 matrix (16 expressions) times (v, w), without the fourth row."""
    return tuple(f"({m[r]} * {v[0]} + {m[4 + r]} * {v[1]} + {m[8 + r]} * {v[2]} + {m[12 + r]} * {w})" for r in range(3))


def determinant(m: list[str]) -> str:
    """Of the upper left 3x3."""
    a, b, c = (tuple(m[4 * j : 4 * j + 3]) for j in range(3))
    return dot(a, cross(b, c))
