"""Column expressions: seeded draws, method names, clipping, array distances."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Method identifiers.
VALUE_METHODS = ("V_EUC_PAM", "V_COR_PAM")
RELATIONAL_METHODS = ("R_FOOT_PAM", "R_PAIR_PAM")
HYBRID_PREFIX = "H_EUC_PAIR_A"

_MANTISSA = float(2**52)


def hybrid_method(alpha: float) -> str:
    return f"{HYBRID_PREFIX}{round(alpha * 100):03d}_PAM"


def methods_for(alphas: tuple[float, ...]) -> tuple[str, ...]:
    return VALUE_METHODS + RELATIONAL_METHODS + tuple(hybrid_method(a) for a in alphas)


def family_of(method: Column) -> Column:
    """VALUE, RELATIONAL or HYBRID for a method id column; NULL for an unknown id."""
    return (
        F.when(method.isin(*VALUE_METHODS), "VALUE")
        .when(method.isin(*RELATIONAL_METHODS), "RELATIONAL")
        .when(method.startswith(HYBRID_PREFIX), "HYBRID")
    )


def alpha_of(method: Column) -> Column:
    """Mixing weight encoded in a hybrid method id, NULL for pure methods."""
    digits = F.regexp_extract(method, HYBRID_PREFIX + r"(\d+)_PAM$", 1)
    return F.when(digits != "", digits.cast("double") / 100.0)


def hybrid_method_of(alpha: Column) -> Column:
    return F.format_string(HYBRID_PREFIX + "%03d_PAM", F.round(alpha * 100).cast("int"))


def uniform(*parts) -> Column:
    """Uniform [0,1) number that depends only on ``parts``, never on the partition layout."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    text = F.concat_ws("|", *[c.cast("string") for c in cols])
    digits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")
    return digits / F.lit(_MANTISSA)


def normal(*parts) -> Column:
    """Standard normal draw (Box-Muller on two seeded uniforms)."""
    radius = F.sqrt(-2.0 * F.log(F.greatest(uniform("r", *parts), F.lit(1.0 / _MANTISSA))))
    return radius * F.cos(F.lit(2.0 * math.pi) * uniform("t", *parts))


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def rounded(value: Column, digits: int = 6) -> Column:
    """Rounded double without a negative zero."""
    return F.round(value, digits) + F.lit(0.0)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, also where ``body`` uses it inside a lambda.

    Without it the optimiser may copy a computed column into a lambda and evaluate it per element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def array_total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def array_mean(values: Column) -> Column:
    return array_total(values) / F.size(values)


def dot(left: Column, right: Column) -> Column:
    return array_total(F.zip_with(left, right, lambda a, b: a * b))


def euclidean(left: Column, right: Column) -> Column:
    return F.sqrt(array_total(F.zip_with(left, right, lambda a, b: (a - b) * (a - b))))


def centred(values: Column) -> Column:
    return let(array_mean(values), lambda mean: F.transform(values, lambda x: x - mean))
