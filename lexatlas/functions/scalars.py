"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def number(c: str | Column) -> Column:
    """Double with NaN turned into null (Spark sorts NaN above every number)."""
    d = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(F.isnan(d), F.lit(None)).otherwise(d)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null when b is 0 or null, under any ANSI setting."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def correlation(a: str | Column, b: str | Column) -> Column:
    """Pearson correlation as an aggregate; null for a constant column under any ANSI setting."""
    a = (F.col(a) if isinstance(a, str) else a).cast("double")
    b = (F.col(b) if isinstance(b, str) else b).cast("double")
    both = a.isNotNull() & b.isNotNull()
    return ratio(F.covar_pop(a, b), F.stddev_pop(F.when(both, a)) * F.stddev_pop(F.when(both, b)))


def rounded(c: str | Column, digits: int = 6) -> Column:
    """Round and turn -0.0 into 0.0."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def id_hash(id_col: str | Column, seed: int = 42) -> Column:
    """60-bit hash of the id as text: the first 15 hex digits of md5('<id>#<seed>').

    Depends on the id only, so folds, samples and tie-breaks are the same under every
    partitioning, and any SQL engine with md5 can reproduce them.
    """
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    text = F.concat(c.cast("string"), F.lit(f"#{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def fold_of(id_col: str | Column, k: int, seed: int = 42) -> Column:
    """Fold number 0..k-1."""
    return F.pmod(id_hash(id_col, seed), F.lit(k)).cast("int")


def anonymous_key(id_col: str | Column) -> Column:
    """The first 16 hex digits of sha-256 of the id as text."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.substring(F.sha2(c.cast("string"), 256), 1, 16)


def p_value_text(p: Column) -> Column:
    """P17: '<0.00001' below 1e-5, otherwise five decimals."""
    return (
        F.when(p.isNull(), F.lit(None).cast("string"))
        .when(p < 1e-5, F.lit("<0.00001"))
        .otherwise(F.format_string("%.5f", p))
    )


def title(c: str | Column) -> Column:
    """P18 on a column."""
    c = F.col(c) if isinstance(c, str) else c
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


# -- arrays -----------------------------------------------------------------------------------


def doubles(v: str | Column) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_norm(v: str | Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def l2_normalised(v: str | Column) -> Column:
    """Unit vector; null for an all-zero vector."""
    norm = l2_norm(v)
    return F.when(norm > 0, F.transform(doubles(v), lambda x: x / norm))


def wide(array_col: str, n: int, prefix: str, suffix: str = "") -> list[Column]:
    """Array column to ``<prefix>0<suffix> .. <prefix>n-1<suffix>``."""
    return [F.col(array_col)[i].alias(f"{prefix}{i}{suffix}") for i in range(n)]


def narrow(prefix: str, n: int, suffix: str = "") -> Column:
    """Wide columns to one array."""
    return F.array(*[F.col(f"{prefix}{i}{suffix}").cast("double") for i in range(n)])


def gather(array_col: str | Column, indices) -> Column:
    """The chosen positions of an array, in the given order."""
    c = F.col(array_col) if isinstance(array_col, str) else array_col
    return F.array(*[c[int(i)] for i in indices])
