"""Exact predicates and constructions as steps of SQL expressions (published formulas).

Triangles are columns ax..az, vbx..vbz, cx..cz; rays ox..oz, dx..dz.
"""

from __future__ import annotations

from .staged import Steps
from .vectors import add, affine, cross, dot, length, length2, named, scale, sub, vec

A, B, C, O, D = vec("a"), vec("vb"), vec("c"), vec("o"), vec("d")


def ray_triangle(side: str = "double") -> tuple[Steps, str, Steps]:
    """(steps, hit condition, steps for hits) of the Moeller-Trumbore test with one late division.

    Hits have t (in direction lengths), distance (Euclidean), u and v (weights
    of b and c), w (of a), px..pz and the geometric normal nx..nz.
    """
    steps = [
        named("e1", sub(B, A)) | named("e2", sub(C, A)) | named("q", sub(O, A)),
        named("n", cross(vec("e1"), vec("e2"))),
        {"dn": dot(D, vec("n"))},
        {"s": "case when dn < 0e0 then -1e0 else 1e0 end", "area": "abs(dn)"},
        {"bu": f"s * {dot(D, cross(vec('q'), vec('e2')))}", "bv": f"s * {dot(D, cross(vec('e1'), vec('q')))}", "qn": f"-s * {dot(vec('q'), vec('n'))}"},
    ]
    facing = {"front": "dn < 0e0", "back": "dn > 0e0", "double": "dn <> 0e0"}[side]
    hit = f"{facing} and bu >= 0e0 and bv >= 0e0 and bu + bv <= area and qn >= 0e0"
    after = [
        {"t": "qn / area", "u": "bu / area", "v": "bv / area"},
        {"w": "1e0 - u - v"} | named("p", add(O, scale(D, "t"))),
        {"distance": length(sub(vec("p"), O))},
    ]
    return steps, hit, after


def closest_on_triangle(p=vec("p")) -> Steps:
    """k..: the closest point of the triangle to p, d2: its squared distance, by Voronoi regions."""
    return [
        named("ab", sub(B, A)) | named("ac", sub(C, A)) | named("ap", sub(p, A)) | named("bp", sub(p, B)) | named("cp", sub(p, C)),
        {"d1": dot(vec("ab"), vec("ap")), "dd2": dot(vec("ac"), vec("ap")), "d3": dot(vec("ab"), vec("bp")), "d4": dot(vec("ac"), vec("bp")), "d5": dot(vec("ab"), vec("cp")), "d6": dot(vec("ac"), vec("cp"))},
        {"va": "d3 * d6 - d5 * d4", "vb_": "d5 * dd2 - d1 * d6", "vc": "d1 * d4 - d3 * dd2"},
        {"region": "case when d1 <= 0e0 and dd2 <= 0e0 then 0 when d3 >= 0e0 and d4 <= d3 then 1 when vc <= 0e0 and d1 >= 0e0 and d3 <= 0e0 then 2 when d6 >= 0e0 and d5 <= d6 then 3 when vb_ <= 0e0 and dd2 >= 0e0 and d6 <= 0e0 then 4 when va <= 0e0 and (d4 - d3) >= 0e0 and (d5 - d6) >= 0e0 then 5 else 6 end"},
        {
            "kv": "case region when 0 then 0e0 when 1 then 1e0 when 2 then d1 / nullif(d1 - d3, 0e0) when 3 then 0e0 when 4 then 0e0 when 5 then 1e0 - (d4 - d3) / nullif((d4 - d3) + (d5 - d6), 0e0) else vb_ / nullif(va + vb_ + vc, 0e0) end",
            "kw": "case region when 0 then 0e0 when 1 then 0e0 when 2 then 0e0 when 3 then 1e0 when 4 then dd2 / nullif(dd2 - d6, 0e0) when 5 then (d4 - d3) / nullif((d4 - d3) + (d5 - d6), 0e0) else vc / nullif(va + vb_ + vc, 0e0) end",
        },
        {"wv": "coalesce(kv, 0e0)", "ww": "coalesce(kw, 0e0)"},
        named("k", add(A, add(scale(vec("ab"), "wv"), scale(vec("ac"), "ww")))),
        {"d2": length2(sub(p, vec("k")))},
    ]


def ray_point(p=vec("p")) -> Steps:
    """gap2: squared distance of a point from the half line; t: where on it, in direction lengths."""
    return [
        {"dd": length2(D), "along": dot(sub(p, O), D)},
        {"t": "greatest(along / nullif(dd, 0e0), 0e0)"},
        {"gap2": length2(sub(p, add(O, scale(D, "t"))))},
    ]


def ray_segment(p=vec("p"), q=vec("q")) -> Steps:
    """gap2: least squared distance of half line and segment; t on the ray, s on the segment (0..1)."""
    return [
        named("g", sub(q, p)) | named("r", sub(O, p)),
        {"dd": length2(D), "gg": length2(vec("g")), "dg": dot(D, vec("g")), "dr": dot(D, vec("r")), "gr": dot(vec("g"), vec("r"))},
        {"det": "dd * gg - dg * dg"},
        {"s0": "case when det > 0e0 then least(greatest((gr * dd - dr * dg) / nullif(det, 0e0), 0e0), 1e0) else 0e0 end"},
        {"t0": "(s0 * dg - dr) / nullif(dd, 0e0)"},
        {"t": "greatest(t0, 0e0)"},
        {"s": "least(greatest((t * dg + gr) / nullif(gg, 0e0), 0e0), 1e0)"},
        {"sg": "coalesce(s, 0e0)"},
        {"gap2": length2(sub(add(O, scale(D, "t")), add(p, scale(vec("g"), "sg"))))},
    ]


def line_line(p=vec("p"), d=vec("d"), q=vec("q"), e=vec("e")) -> Steps:
    """t, s: where the lines p + t d and q + s e are nearest to each other (0 and the foot of p for parallel ones); gap2: their squared distance."""
    return [
        named("r", sub(p, q)),
        {"dd": dot(d, d), "ee": dot(e, e), "de": dot(d, e), "dr": dot(d, vec("r")), "er": dot(e, vec("r"))},
        {"det": "dd * ee - de * de"},
        {"t": "case when det > 1e-15 * dd * ee then (de * er - ee * dr) / det else 0e0 end"},
        {"s": "coalesce((er + t * de) / nullif(ee, 0e0), 0e0)"},
        {"gap2": length2(sub(add(p, scale(d, "t")), add(q, scale(e, "s"))))},
    ]


#: Edges shorter than this are of no length (fixed value).
NO_LENGTH = "1e-15"


def degeneracy() -> Steps:
    """shape: 'point' where the corners of a triangle are one, 'segment' where two of them are, else 'triangle'."""
    edges = {f"l{i}": length(sub(y, x)) for i, (x, y) in enumerate(((A, B), (B, C), (C, A)))}
    short = [f"cast(l{i} < {NO_LENGTH} as int)" for i in range(3)]
    return [edges, {"shape": f"case {' + '.join(short)} when 0 then 'triangle' when 1 then 'segment' else 'point' end"}]


def box_point_local(m: list[str], p) -> dict[str, str]:
    """A point in the frame of an oriented box, given the inverse matrix."""
    return named("l", affine(m, p))


def triangle_box(center, half) -> tuple[Steps, str]:
    """(steps, condition) of the separating-axis test of the triangle with a box of given centre and half sides; touching counts."""
    t, edges = [vec(f"t{i}") for i in range(3)], [vec(f"f{i}") for i in range(3)]
    steps: Steps = [
        {k: v for i, x in enumerate((A, B, C)) for k, v in named(f"t{i}", sub(x, center)).items()} | named("h", half),
        {k: v for i in range(3) for k, v in named(f"f{i}", sub(t[(i + 1) % 3], t[i])).items()},
    ]
    half = vec("h")
    units = [("1e0", "0e0", "0e0"), ("0e0", "1e0", "0e0"), ("0e0", "0e0", "1e0")]
    tests = []
    for i in range(3):
        tests.append(f"least({t[0][i]}, {t[1][i]}, {t[2][i]}) <= {half[i]} and greatest({t[0][i]}, {t[1][i]}, {t[2][i]}) >= -{half[i]}")
    normal = cross(edges[0], edges[1])
    axes = [normal] + [cross(u, e) for u in units for e in edges]
    for axis in axes:
        reach = "(" + " + ".join(f"{h} * abs({x})" for h, x in zip(half, axis)) + ")"
        shadow = [dot(axis, x) for x in t]
        tests.append(f"least({', '.join(shadow)}) <= {reach} and greatest({', '.join(shadow)}) >= -{reach}")
    return steps, " and ".join(tests)
