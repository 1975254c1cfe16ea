"""Vector expressions: distances, norms, normalisation, augmentation and conversions.

Everything here is a column expression of built-in functions, computed in double from the first
component to the last, so a plan that uses it stays in the JVM and results are the same bit for bit
wherever they are computed in that order (operators.knn has the same sums over Arrow batches).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ("l2", "ip", "cosine", "fast_l2")
DTYPES = ("float", "int8", "uint8")
#: What each element type supports.
SUPPORTED = {"float": set(METRICS), "int8": {"l2", "cosine"}, "uint8": {"l2", "cosine"}}
SPARK_ELEMENT = {"float": "float", "int8": "tinyint", "uint8": "smallint"}


def check_metric(metric: str, dtype: str = "float") -> None:
    """Raises ValueError for an unknown metric or element type, or a pair that is not supported."""
    if dtype not in DTYPES:
        raise ValueError(f"element type must be one of {DTYPES}, not {dtype!r}")
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}, not {metric!r}")
    if metric not in SUPPORTED[dtype]:
        raise ValueError(f"metric {metric!r} is not supported for {dtype}")


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def l2_squared(a: Column, b: Column) -> Column:
    """Squared Euclidean distance; never its root."""
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def inner_product(a: Column, b: Column) -> Column:
    """The negative dot product, so smaller is nearer."""
    return -dot(a, b)


def cosine(a: Column, b: Column) -> Column:
    """1 - cos; NaN for a zero vector."""
    norms = norm(a) * norm(b)
    return F.when(norms == 0, F.lit(float("nan"))).otherwise(1 - F.try_divide(dot(a, b), norms))


def fast_l2(base: Column, query: Column) -> Column:
    """Squared Euclidean distance without the query's norm, which ranks alike."""
    return dot(base, base) - 2 * dot(base, query)


def distance(metric: str, base: Column, query: Column) -> Column:
    check_metric(metric)
    return {"l2": l2_squared, "ip": inner_product, "cosine": cosine, "fast_l2": fast_l2}[metric](base, query)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalised(v: Column, eps: float = 0.0) -> Column:
    """v over sqrt(eps + sum of squares); a zero vector stays zero."""
    n = F.sqrt(F.lit(float(eps)) + dot(v, v))
    return F.transform(v, lambda x: F.when(n == 0, F.lit(0.0)).otherwise(F.try_divide(x.cast("double"), n)))


def normalise(vectors: DataFrame, vector_col: str = "vec", eps: float = 1e-300) -> DataFrame:
    """Rows with their vectors scaled to length 1; eps keeps zero vectors zero."""
    return vectors.withColumn(vector_col, normalised(F.col(vector_col), eps))


def mips_augment(vectors: DataFrame, vector_col: str = "vec") -> DataFrame:
    """Inner product to Euclidean: divide by the largest norm M, append sqrt(max(0, 1 - |x|^2 / M^2)).

    Adds column max_norm. M is one aggregate of the table, joined as its only row.
    """
    largest = vectors.agg(F.max(norm(F.col(vector_col))).alias("max_norm"))
    scaled = F.transform(F.col(vector_col), lambda x: F.coalesce(F.try_divide(x.cast("double"), F.col("max_norm")), F.lit(0.0)))
    rest = F.sqrt(F.greatest(F.lit(0.0), 1 - dot(F.col("__scaled"), F.col("__scaled"))))
    rows = vectors.join(F.broadcast(largest))  # one row
    return rows.withColumn("__scaled", scaled).withColumn(vector_col, F.concat("__scaled", F.array(rest))).drop("__scaled")


def mips_query(q: Column) -> Column:
    """A query for augmented vectors: scaled to length 1, with a 0 appended."""
    return F.concat(normalised(q), F.array(F.lit(0.0)))


def quantise_int8(v: Column, bias: float, scale: float) -> Column:
    """(x - bias) * 254 / scale, cut towards zero."""
    return F.transform(v, lambda x: ((x.cast("double") - F.lit(float(bias))) * 254 / F.lit(float(scale))).cast("tinyint"))


def dequantise_int8(v: Column, bias: float = 0.0, scale: float = 1.0) -> Column:
    """(x - bias) * scale in float."""
    return F.transform(v, lambda x: ((x.cast("double") - F.lit(float(bias))) * F.lit(float(scale))).cast("float"))


def converted(v: Column, dtype: str) -> Column:
    """Elements cast to float, int8 (tinyint) or uint8 (smallint, as there is no unsigned type)."""
    if dtype not in DTYPES:
        raise ValueError(f"element type must be one of {DTYPES}, not {dtype!r}")
    return F.transform(v, lambda x: x.cast(SPARK_ELEMENT[dtype]))


def padded(v: Column, multiple: int = 8) -> Column:
    """v with zeros up to the next multiple of so many components."""
    more = F.pmod(-F.size(v), F.lit(multiple)).cast("int")
    return F.concat(v, F.array_repeat(F.lit(0.0), more))


def unpadded(v: Column, dim: int) -> Column:
    return F.slice(v, 1, dim)


def residual(v: Column, centre: Column) -> Column:
    return F.zip_with(v, centre, lambda x, c: x.cast("double") - c.cast("double"))


def restored(r: Column, centre: Column) -> Column:
    return F.zip_with(r, centre, lambda x, c: x.cast("double") + c.cast("double"))


def disk_query(q: Column, metric: str) -> Column:
    """How a query is prepared for an index of prepared vectors: cosine and ip scale it to length 1, ip appends 0."""
    check_metric(metric)
    return {"cosine": normalised(q), "ip": mips_query(q)}.get(metric, q)
