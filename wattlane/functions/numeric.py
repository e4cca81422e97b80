"""Numeric column functions: coercion, missing-value defaults, display format."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nan_to_null(c: Column) -> Column:
    """NULL is the only missing marker: NaN becomes NULL."""
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


# decimal text, or a name of an infinite or missing value; a Java type suffix (12d, 1.5F) is not a number
_NUMBER = r"(?i)^\s*([+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?|[+-]?inf(inity)?|nan)\s*$"


def coerce_numeric(c: Column) -> Column:
    """Text or number → DOUBLE; anything unparsable becomes NULL (never raises)."""
    text = c.cast("string")
    return nan_to_null(F.when(text.rlike(_NUMBER), text.try_cast("double")))


def default_if_missing(c: Column, default: float, zero_is_missing: bool = True) -> Column:
    """``x || d`` — NULL, NaN and (by default) 0 take the default."""
    x = nan_to_null(c.cast("double"))
    if zero_is_missing:
        x = F.when(x == 0, F.lit(None).cast("double")).otherwise(x)
    return F.coalesce(x, F.lit(float(default)))


def default_if_absent(c: Column, default: float) -> Column:
    """P13, second form: only a missing value takes the default."""
    return F.coalesce(c.cast("double"), F.lit(float(default)))


_SPLIT = 134217729.0  # 2**27 + 1, splits a double into two 26-bit halves


def _split(v: float) -> tuple[float, float]:
    t = v * _SPLIT
    hi = t - (t - v)
    return hi, v - hi


def _two_product_error(a: Column, b: float) -> Column:
    """Exact rounding error of ``a * b`` (Dekker), so ``a*b + err`` is exact.
    ``b`` is a literal; when its significand fits 26 bits (10**d for d ≤ 11)
    its low half is zero and two terms drop out, keeping the expression small."""
    p = a * F.lit(b)
    ta = a * F.lit(_SPLIT)
    ah = ta - (ta - a)
    al = a - ah
    bh, bl = _split(b)
    err = ((ah * F.lit(bh) - p) + al * F.lit(bh))
    return err if bl == 0.0 else (err + ah * F.lit(bl)) + al * F.lit(bl)


def format_fixed(c: Column, decimals: int) -> Column:
    """Fixed decimals as text, rounding the exact binary value half up on
    the magnitude, the way a browser's ``toFixed`` does (``1.0005`` → ``1.000``,
    ``2.675`` → ``2.67``).  ``format_string`` would round the shortest decimal
    text instead.  Exact below 2**53 / 10**d; above that every double is an
    integer and prints through ``%.0f``."""
    d = int(decimals)
    m = 10 ** d
    x = c.cast("double")
    a_raw = F.abs(x)
    # beyond 2**53 / 10**d the scaled value no longer fits the exact path:
    # the arithmetic runs on a safe stand-in there and another branch prints it
    exact = a_raw < F.lit(float(2 ** 53) / m)
    a = F.when(exact, a_raw).otherwise(F.lit(0.0))
    p = a * F.lit(float(m))
    n0 = F.floor(p)
    frac_minus_half = (p - n0) - F.lit(0.5)
    up = (frac_minus_half > 0) | ((frac_minus_half == 0) & (_two_product_error(a, float(m)) >= 0))
    n = n0 + up.cast("long")                      # units of 10**-d, below 2**53
    low = n % F.lit(m)
    body = ((n - low) / F.lit(m)).cast("long").cast("string")
    if d:
        body = F.concat(body, F.lit("."), F.lpad(low.cast("string"), d, "0"))
    sign = F.when(x < 0, F.lit("-")).otherwise(F.lit(""))
    whole = F.concat(sign, F.format_string("%.0f", a_raw), F.lit("." + "0" * d if d else ""))
    return (F.when(x.isNull(), F.lit(None).cast("string"))
            .when(F.isnan(x), F.lit("NaN"))
            .when(a_raw == F.lit(float("inf")), F.concat(sign, F.lit("Infinity")))
            .when(~exact, whole)
            .otherwise(F.concat(sign, body)))


def valid_prediction(text: Column) -> Column:
    """Accept a numeric or numeric-looking response.

    Number() semantics: blank text is 0; decimal text, ``Infinity`` (in this
    spelling) and unsigned ``0x``/``0o``/``0b`` integers of up to 63 bits count;
    anything else (or NaN) is rejected.  Returns ``struct(valid BOOLEAN,
    prediction DOUBLE)``.
    """
    t = F.btrim(text.cast("string"), F.lit(" \t\n\r\x0b\x0c\u00a0\ufeff"))
    value = (F.when(t == "", F.lit(0.0))
             .when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), t.try_cast("double"))
             .when(t.rlike("^[+]?Infinity$"), F.lit(float("inf")))
             .when(t == "-Infinity", F.lit(float("-inf"))))
    for base, pattern in ((16, "^0[xX][0-9a-fA-F]+$"), (8, "^0[oO][0-7]+$"), (2, "^0[bB][01]+$")):
        value = value.when(t.rlike(pattern), F.conv(F.substr(t, F.lit(3)), base, 10).try_cast("double"))
    return F.struct(value.isNotNull().alias("valid"), value.alias("prediction"))


def r6(c: Column) -> Column:
    """Comparison rounding for computed doubles: ``round(x + 1e-9, 6)``."""
    return F.round(c + F.lit(1e-9), 6)
