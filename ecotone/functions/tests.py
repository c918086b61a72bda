"""Two-sample tests of a lower mean, from counts, sums and sums of squares of integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lower-tail critical t at 95 %, by smallest degrees of freedom; one-sided, then two-sided.
ONE_SIDED = ((1, -6.314), (2, -2.920), (3, -2.353), (4, -2.132), (5, -2.015), (6, -1.943), (7, -1.895), (8, -1.860), (9, -1.833), (10, -1.812), (12, -1.782), (15, -1.753), (20, -1.725), (30, -1.697), (40, -1.684), (60, -1.671), (120, -1.658), (1000, -1.645))
TWO_SIDED = ((1, -12.706), (2, -4.303), (3, -3.182), (4, -2.776), (5, -2.571), (6, -2.447), (7, -2.365), (8, -2.306), (9, -2.262), (10, -2.228), (12, -2.179), (15, -2.131), (20, -2.086), (30, -2.042), (40, -2.021), (60, -2.000), (120, -1.980), (1000, -1.960))


def critical_t(df: Column, sided: int = 1) -> Column:
    """The table's value for the largest entry that df reaches; below one, the first."""
    table = ONE_SIDED if sided == 1 else TWO_SIDED
    out = F.when(df >= table[-1][0], F.lit(table[-1][1]))
    for least, value in reversed(table[1:-1]):
        out = out.when(df >= least, F.lit(value))
    return out.otherwise(F.lit(table[0][1]))


def mean(n: Column, s: Column) -> Column:
    return F.try_divide(s.cast("double"), n)


def variance(n: Column, s: Column, q: Column) -> Column:
    """Population variance; its numerator is exact, so equal values give exactly 0."""
    return F.try_divide((n * q - s * s).cast("double"), n * n)


def welch(nf, sf, qf, nn, sn, qn) -> dict[str, Column]:
    """Unequal variances: difference (second mean less first), standard error, t, degrees of freedom."""
    vf, vn = F.try_divide(variance(nf, sf, qf), nf), F.try_divide(variance(nn, sn, qn), nn)
    square = vf + vn
    return _test(nf, sf, nn, sn, F.sqrt(square), F.try_divide(square * square, F.try_divide(vf * vf, nf - 1) + F.try_divide(vn * vn, nn - 1)))


def pooled(nf, sf, qf, nn, sn, qn) -> dict[str, Column]:
    """Equal variances, pooled over both samples."""
    df = (nf + nn - 2).cast("double")
    spread = F.try_divide(variance(nf, sf, qf) * nf + variance(nn, sn, qn) * nn, df)
    return _test(nf, sf, nn, sn, F.sqrt(spread * (F.try_divide(F.lit(1.0), nf) + F.try_divide(F.lit(1.0), nn))), df)


def _test(nf, sf, nn, sn, error: Column, df: Column) -> dict[str, Column]:
    difference = mean(nn, sn) - mean(nf, sf)
    return {"difference": difference, "error": error, "t": F.try_divide(-difference, error), "df": df}


def upper(candidate: Column, nf: Column, nn: Column, test: dict[str, Column], least: int = 5, rise: float = 0.0, sided: int = 1) -> Column:
    """1 where a candidate has enough samples, some spread, a rise, and a significantly lower forest mean; else 0."""
    holds = (candidate == 1) & (nf >= least) & (nn >= least) & (test["error"] > 0) & (test["difference"] >= rise) & (test["t"] < critical_t(test["df"], sided))
    return F.coalesce(holds, F.lit(False)).cast("int")
