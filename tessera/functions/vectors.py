"""Dense-vector column expressions on ``array<double>`` columns.

Everything here is a built-in higher-order function (``zip_with``,
``aggregate``, ``transform``), so it runs inside the JVM next to the scan;
no Python worker is involved.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: cosine norm guard (torch default), layer-norm epsilon (torch default)
COS_EPS = 1e-8
LN_EPS = 1e-5


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_double_vector(x) -> Column:
    return _c(x).cast("array<double>")


def vsum(a) -> Column:
    return F.aggregate(_c(a), F.lit(0.0), lambda s, v: s + v)


def dot(a, b) -> Column:
    return vsum(F.zip_with(_c(a), _c(b), lambda x, y: x * y))


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b, a_norm=None, b_norm=None) -> Column:
    an = norm(a) if a_norm is None else _c(a_norm)
    bn = norm(b) if b_norm is None else _c(b_norm)
    return dot(a, b) / (F.greatest(an, F.lit(COS_EPS)) * F.greatest(bn, F.lit(COS_EPS)))


def vadd(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x + y)


def vsub(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x - y)


def vscale(a, s) -> Column:
    s = F.lit(s) if isinstance(s, (int, float)) else _c(s)
    return F.transform(_c(a), lambda x: x * s)


def l1(a, b) -> Column:
    return vsum(F.zip_with(_c(a), _c(b), lambda x, y: F.abs(x - y)))


def context_difference(v1, v2, v_all) -> tuple[Column, Column]:
    """``v1 + (v_all - v2)`` and ``v2 + (v_all - v1)``."""
    return vadd(v1, vsub(v_all, v2)), vadd(v2, vsub(v_all, v1))


def argmax(a) -> Column:
    """0-based index of the largest element; ties go to the lowest index."""
    return (F.array_position(_c(a), F.array_max(_c(a))) - 1).cast("int")


def argmin(a) -> Column:
    return (F.array_position(_c(a), F.array_min(_c(a))) - 1).cast("int")


def bind(value, fn) -> Column:
    """Evaluate ``value`` once and hand it to ``fn`` as a lambda variable.

    Catalyst inlines a derived column into every lambda call that refers to
    it; binding through a one-element ``transform`` keeps it computed once.
    """
    return F.transform(F.array(_c(value)), fn)[0]


def softmax(a) -> Column:
    """Softmax of one array, max subtracted first."""
    def with_exp(e):
        return bind(vsum(e), lambda s: F.transform(e, lambda x: x / s))
    return bind(F.array_max(_c(a)), lambda m: bind(F.transform(_c(a), lambda x: F.exp(x - m)), with_exp))


def cos_to_unit(x) -> Column:
    """Map cosine in [-1, 1] to a distance in [0, 1]: ``-0.5 * (x - 1)``."""
    return F.lit(-0.5) * (_c(x) - F.lit(1.0))


def layer_norm(a, eps: float = LN_EPS) -> Column:
    """Per-vector normalisation: mean 0, biased variance, ``eps`` inside the root."""
    def with_vec(v):
        n = F.size(v).cast("double")
        return bind(vsum(v) / n, lambda mean: bind(
            vsum(F.transform(v, lambda x: (x - mean) * (x - mean))) / n,
            lambda var: F.transform(v, lambda x: (x - mean) / F.sqrt(var + F.lit(eps)))))
    return bind(a, with_vec)
