"""Per-pixel algebra as Column expressions: all of it stays in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 2.0**-23
SUBPIXELS = 128


def finite_or(v: Column, fill: float) -> Column:
    return F.when(F.isnan(v) | (F.abs(v) == F.lit(float("inf"))) | v.isNull(), F.lit(float(fill))).otherwise(v)


def chopped(a: Column, b: Column, d: Column) -> Column:
    """b, or 0 where it is lost in rounding against a and d."""
    return F.when(F.abs(b) < F.lit(EPSILON) * (F.abs(a) + F.abs(d)), F.lit(0.0)).otherwise(b)


def eigen(a: Column, b: Column, d: Column) -> Column:
    """struct(l1, l2, e11, e12, e21, e22) of [[a, b], [b, d]] by one rotation.

    l2 is the eigenvalue next to a in the stable shift; the two are not sorted, and the
    signs of the vectors follow the rotation.
    """
    off = F.when(F.isnan(b), F.lit(0.0)).otherwise(chopped(a, b, d))
    s = F.struct(a.alias("a"), off.alias("b"), d.alias("d"))

    def rotation(m: Column) -> Column:
        half = (m["a"] - m["d"]) / F.lit(2.0)
        h = F.sqrt(half * half + m["b"] * m["b"])
        far = F.try_divide(m["b"] * m["b"], h + F.abs(half))
        x = F.when(half <= F.lit(0.0), far).otherwise(-far)
        return F.struct(m["a"].alias("a"), m["b"].alias("b"), m["d"].alias("d"), x.alias("x"))

    def angle(m: Column) -> Column:
        steep = F.abs(m["b"]) > F.abs(m["x"])
        q = F.when(steep, F.try_divide(-m["x"], m["b"])).otherwise(F.try_divide(-m["b"], m["x"]))
        return F.struct(m["a"].alias("a"), m["b"].alias("b"), m["d"].alias("d"), steep.alias("steep"), q.alias("q"), (F.lit(1.0) / F.sqrt(F.lit(1.0) + q * q)).alias("r"))

    def sides(m: Column) -> Column:
        turned = m["b"] != F.lit(0.0)
        c = F.when(turned, F.when(m["steep"], m["r"] * m["q"]).otherwise(m["r"])).otherwise(F.lit(1.0))
        s_ = F.when(turned, F.when(m["steep"], m["r"]).otherwise(m["r"] * m["q"])).otherwise(F.lit(0.0))
        return F.struct(m["a"].alias("a"), m["b"].alias("b"), m["d"].alias("d"), c.alias("c"), s_.alias("s"))

    def result(m: Column) -> Column:
        cc, ss, cross = m["c"] * m["c"], m["s"] * m["s"], F.lit(2.0) * (m["c"] * m["s"]) * m["b"]
        flat = m["b"] == F.lit(0.0)
        l1 = F.when(flat, m["a"]).otherwise((cc * m["a"] - cross) + ss * m["d"])
        l2 = F.when(flat, m["d"]).otherwise((ss * m["a"] + cross) + cc * m["d"])
        return F.struct(l1.alias("l1"), l2.alias("l2"), m["c"].alias("e11"), (-m["s"]).alias("e12"), m["s"].alias("e21"), m["c"].alias("e22"))

    out = s
    for step in (rotation, angle, sides, result):
        out = F.transform(F.array(out), step)[0]
    return out


def eigen_literal(a: Column, b: Column, d: Column) -> Column:
    """``eigen`` in the arithmetic of 32-bit floats, rounded after each step, with the literal shift.

    Where b is small against a - d the shift cancels and the rotation is not the spectrum's;
    kept for results that must equal single precision tools'.
    """
    f = lambda x: x.cast("float")
    n = lambda x: F.lit(float(x)).cast("float")
    named = lambda **columns: F.struct(*[c.alias(k) for k, c in columns.items()])
    size = f(F.abs(f(a)) + F.abs(f(d)))
    off = F.when(F.isnan(f(b)) | (F.abs(f(b)) < f(n(EPSILON) * size)), n(0)).otherwise(f(b))

    def shift(m: Column) -> Column:
        half = f((m["a"] - m["d"]) * n(0.5))
        h = f(F.sqrt(half.cast("double") * half.cast("double") + m["b"].cast("double") * m["b"].cast("double")))
        return named(a=m["a"], b=m["b"], d=m["d"], half=half, gap=F.when(half < 0, f(half + h)).otherwise(f(h - half)))

    def shifted(m: Column) -> Column:
        ratio = F.when(m["gap"] == 0, F.signum(m["b"]) * F.lit(float("inf"))).otherwise(F.try_divide(m["b"], m["gap"]))
        by = f(m["b"] * f(ratio))
        mu = F.when(m["half"] == 0, f(m["d"] - F.abs(m["b"]))).when(m["half"] < 0, f(m["d"] - by)).otherwise(f(m["d"] + by))
        mu = F.when(f(n(EPSILON) * F.abs(mu)) > f(F.abs(m["a"]) + F.abs(m["b"])), n(0)).otherwise(mu)
        return named(a=m["a"], b=m["b"], d=m["d"], x=f(m["a"] - mu))

    def angle(m: Column) -> Column:
        steep = F.abs(m["b"]) > F.abs(m["x"])
        q = f(F.when(steep, F.try_divide(-m["x"], m["b"])).otherwise(F.try_divide(-m["b"], m["x"])))
        return named(a=m["a"], b=m["b"], d=m["d"], steep=steep, q=q)

    def sides(m: Column) -> Column:
        r = f(n(1) / f(F.sqrt(f(n(1) + f(m["q"] * m["q"])))))
        turned, short = m["b"] != 0, f(r * m["q"])
        c = F.when(turned, F.when(m["steep"], short).otherwise(r)).otherwise(n(1))
        s = F.when(turned, F.when(m["steep"], r).otherwise(short)).otherwise(n(0))
        return named(a=m["a"], b=m["b"], d=m["d"], c=c, s=s)

    def turned_once(m: Column) -> Column:
        a, b, d, c, s = (m[k] for k in "abdcs")
        return named(a=a, b=b, d=d, c=c, s=s, p=f(f(c * a) - f(s * b)), q=f(f(s * a) + f(c * b)), u=f(f(c * b) - f(s * d)), w=f(f(s * b) + f(c * d)))

    def result(m: Column) -> Column:
        flat = m["b"] == 0
        l1 = F.when(flat, m["a"]).otherwise(f(f(m["p"] * m["c"]) - f(m["u"] * m["s"])))
        l2 = F.when(flat, m["d"]).otherwise(f(f(m["q"] * m["s"]) + f(m["w"] * m["c"])))
        return named(l1=l1, l2=l2, e11=m["c"], e12=-m["s"], e21=m["s"], e22=m["c"])

    out = named(a=f(a), b=off, d=f(d))
    for step in (shift, shifted, angle, sides, turned_once, result):
        out = F.transform(F.array(out), step)[0]
    return out


def strength(metric: str, t: float, l1: Column, l2: Column) -> Column:
    """M: t * max(|l1|, |l2|).  N: t^4 (l1^2 - l2^2)^2.  A: t^2 (l1 - l2)^2."""
    if metric == "M":
        a, b = F.abs(l1), F.abs(l2)
        return F.lit(float(t)) * F.when(F.isnan(a), b).when(F.isnan(b), a).otherwise(F.greatest(a, b))
    if metric == "N":
        d = l1 * l1 - l2 * l2
        return (F.lit((t * t) * (t * t)) * d) * d
    if metric == "A":
        d = l1 - l2
        return F.lit(t * t) * (d * d)
    raise ValueError(f"metric must be A, M or N, not {metric!r}")


def lerp(d: Column, x: Column, y: Column) -> Column:
    return (F.lit(1.0) - d) * x + d * y


def crossing(lp1: Column, lp2: Column, lpp1: Column, lpp2: Column) -> Column:
    """Place in [0, 1] where a bright ridge meets the edge between two pixels, or null."""
    sign = ~F.isnan(lp1) & ~F.isnan(lp2) & ((lp1 > 0) == (lp2 <= 0))
    x = F.when(sign, F.try_divide(lp1, lp1 - lp2))
    curve = lerp(x, lpp1, lpp2)
    return F.when(x.isNotNull() & (F.isnan(curve) | ~(curve > 0)), x)


def to_subpixel(fixed: Column) -> Column:
    return fixed / F.lit(float(SUBPIXELS))


def to_fixed(pixels: Column) -> Column:
    return F.rint(pixels * F.lit(float(SUBPIXELS))).cast("bigint")


def millionths(v: Column) -> Column:
    """A double as a whole number of millionths, for exact comparison."""
    return F.floor(v * F.lit(1e6) + F.lit(0.5)).cast("bigint")


def fine(v: Column, unit: float = 1e15) -> Column:
    """A double in parts of ``unit``: ten digits and more of a strength, for exact comparison."""
    return F.floor(v * F.lit(unit) + F.lit(0.5)).cast("bigint")
