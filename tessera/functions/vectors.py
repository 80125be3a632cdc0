"""Vector math on ARRAY<FLOAT or DOUBLE> columns, with double accumulators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

F32_EPSILON = 1.1920929e-07
MAX_DIM = 1024


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    """Over the shorter vector's components."""
    return _sum(F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0))))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def safe_norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))) + 1e-12)


def cosine(a: Column, b: Column, variant: str = "retrieval") -> Column:
    """retrieval: the norms' product is at least F32_EPSILON; embedding: 0 for unlike dims or a zero norm; distance: 1 - cosine, eased by 1e-12."""
    if variant == "retrieval":
        return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(F32_EPSILON))
    if variant == "embedding":
        both = norm(a) * norm(b)
        return F.when((F.size(a) != F.size(b)) | (both == 0), 0.0).otherwise(dot(a, b) / both)
    if variant == "distance":
        return 1 - dot(a, b) / (norm(a) * norm(b) + 1e-12)
    raise ValueError(f"unknown variant {variant}")


def l2_squared(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def similarity(a: Column, b: Column, metric: str) -> Column:
    """cosine, dot or l2 (negated distance), so that more is nearer."""
    if metric == "cosine":
        return cosine(a, b)
    if metric == "dot":
        return dot(a, b)
    if metric == "l2":
        return 0.0 - F.sqrt(l2_squared(a, b))
    raise ValueError(f"unknown metric {metric}")


def _with(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row, not once per element of what body builds."""
    return F.transform(F.array(value), body)[0]


def mean_center(a: Column) -> Column:
    """Subtracts the mean of the vector's own components."""
    mean = _sum(F.transform(a, lambda x: x.cast("double"))) / F.size(a)
    return _with(mean, lambda m: F.transform(a, lambda x: x.cast("double") - m))


def l2_normalize(a: Column) -> Column:
    return _with(safe_norm(a), lambda n: F.transform(a, lambda x: x.cast("double") / n))


def whiten(a: Column) -> Column:
    """Divides by the norm once more."""
    return _with(norm(a) + 1e-12, lambda n: F.transform(a, lambda x: x.cast("double") / n))


def preprocess(a: Column) -> Column:
    return _with(mean_center(a), lambda v: _with(l2_normalize(v), whiten))


def vector_status(a: Column, multiple: int = 1) -> Column:
    n = F.size(a)
    return F.when(a.isNull() | (n <= 0), "empty").when(n > MAX_DIM, "too_many_dims").when(n % multiple != 0, "not_divisible").otherwise("ok")


# --- disk value types -----------------------------------------------------------------------------

IMMUTABLE, HOT_PATH = 1, 2


def has_flag(flags: Column, flag: int) -> Column:
    return flags.bitwiseAND(F.lit(flag)) != 0


def set_bits(flags: Column) -> Column:
    return F.bit_count(flags)


def vector_count(flat: Column, dims: int) -> Column:
    """Number of vectors in a flat array; null where a part of one is left over."""
    return F.when(F.size(flat) % dims == 0, F.floor(F.size(flat) / dims))


def vector_id_status(ident: Column) -> Column:
    return F.when(ident.isNull() | (ident == 0), "zero_id").otherwise("ok")


def check_search(top_k: int, metric: str) -> None:
    if top_k <= 0:
        raise ValueError("top_k must be positive")
    if metric not in ("cosine", "dot", "l2"):
        raise ValueError(f"unknown metric {metric}")
