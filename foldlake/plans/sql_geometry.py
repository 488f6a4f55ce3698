"""Geometry as SQL text, for the oracles. A point is a tuple of three expressions."""


def p(prefix: str) -> tuple[str, str, str]:
    return f"{prefix}x", f"{prefix}y", f"{prefix}z"


def minus(a, b):
    return tuple(f"({x} - {y})" for x, y in zip(a, b, strict=True))


def dot(a, b):
    return "(" + " + ".join(f"{x} * {y}" for x, y in zip(a, b, strict=True)) + ")"


def cross(a, b):
    return f"({a[1]} * {b[2]} - {a[2]} * {b[1]})", f"({a[2]} * {b[0]} - {a[0]} * {b[2]})", f"({a[0]} * {b[1]} - {a[1]} * {b[0]})"


def norm(a):
    return f"sqrt({dot(a, a)})"


def distance(a, b):
    return norm(minus(a, b))


def angle(a, b, c):
    u, v = minus(a, b), minus(c, b)
    return f"acos(greatest(-1.0, least(1.0, {dot(u, v)} / ({norm(u)} * {norm(v)}))))"


def dihedral(a, b, c, d):
    u, v, w = minus(b, a), minus(c, b), minus(d, c)
    n2 = cross(v, w)
    return f"atan2({norm(v)} * {dot(u, n2)}, {dot(cross(u, v), n2)})"


def bin10(x):
    return f"(round_even(round_even(degrees({x}), 0) / 10, 0) * 10)::int"


def r(x, n=4):
    return f"(round({x}, {n}) + 0.0)"
