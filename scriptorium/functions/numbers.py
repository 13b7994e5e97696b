"""Number formatting (X13) as a column: ``%.<digits>f`` of a double.

C rounds the exact binary value, to even where that lies halfway. Spark's
``format_string`` and ``round`` start from the shortest decimal form instead
(0.25 becomes 0.3, 2.675 becomes 2.68). Here the fraction is taken apart into a
whole number over a power of two and divided in exact decimals.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_DIGITS = 15
MOST = 2.0 ** 63  # larger whole numbers are spelt out from mantissa and exponent
LIMIT = 2.0 ** 126


def c_format(x: Column, digits: int) -> Column:
    """``x`` as C's ``printf("%.<digits>f")`` writes it: ``nan``, ``inf`` and
    ``-inf`` in words, the sign of a negative zero kept, null stays null.
    ``digits`` is at most 15; numbers of 2^126 and more give null."""
    if not isinstance(digits, int) or not 0 <= digits <= MOST_DIGITS:
        raise ValueError(f"digits must be a whole number from 0 to {MOST_DIGITS}")
    wide = lambda c: c.cast("decimal(38,0)")
    # a cast of a double to a decimal takes its shortest form: powers go by way of longs
    power = lambda e: wide(F.pow(F.lit(2.0), e).cast("bigint"))
    least = 10.0 ** -(digits + 1)  # less rounds to 0 whatever follows

    def rounded(a: Column, whole: Column, part: Column, k: Column) -> Column:
        """Digits of ``a``: ``part`` = m / 2^k with whole m."""
        top = wide((part * F.pow(F.lit(2.0), k)).cast("bigint")) * wide(F.lit(10 ** digits))
        den = power(F.least(k, F.lit(60))) * power(F.greatest(k - 60, F.lit(0)))

        def up(q: Column) -> Column:
            twice = wide(top - wide(q) * den) * wide(F.lit(2))
            odd = (q % 2 if digits else whole % 2) != 0  # of the last digit before rounding
            return F.coalesce(q + ((twice > den) | ((twice == den) & odd)).cast("bigint"), F.lit(0).cast("bigint"))

        return let(let(F.call_function("div", top, den), up), lambda q: spelt(a, whole, q))

    def spelt(a: Column, whole: Column, q: Column) -> Column:
        carry = (q >= 10 ** digits).cast("bigint")
        high = F.floor(a / F.lit(MOST))
        large = wide(high.cast("bigint")) * wide(F.lit(Decimal(2 ** 63))) + wide((a - high * F.lit(MOST)).cast("bigint"))
        first = F.when(a < MOST, (whole + carry).cast("string")).when(a < LIMIT, large.cast("string"))
        if not digits:
            return first
        after = F.when(a < MOST, F.lpad((q - carry * 10 ** digits).cast("string"), digits, "0")).otherwise("0" * digits)
        return F.concat(first, F.lit("."), after)

    def finite(a: Column) -> Column:
        whole = F.when(a < MOST, F.floor(a))          # a long
        part = F.when(a < MOST, a - F.floor(a))       # exact
        # one place more than log2 asks for, which may be off by one
        places = lambda p: F.when(p >= least, (F.lit(53) - F.floor(F.log2(p))).cast("int"))
        return let(whole, lambda w: let(part, lambda p: let(places(p), lambda k: rounded(a, w, p, k))))

    x = x.cast("double")
    sign = F.when(x.cast("string").startswith("-"), "-").otherwise("")
    return (F.when(x.isNull(), F.lit(None).cast("string")).when(F.isnan(x), "nan")
             .when(F.abs(x) == float("inf"), F.concat(sign, F.lit("inf"))).otherwise(F.concat(sign, let(F.abs(x), finite))))


def let(value: Column, fn) -> Column:
    """``fn`` of a value that is computed once, as a lambda variable: written
    out at every use, the steps of ``c_format`` would be a huge expression."""
    return F.transform(F.array(value), fn)[0]
