"""Shared plan fragments."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paddock.session import ensure_checkpoint_dir


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Whatever runs meanwhile removes its shuffles when it ends, not when the driver next collects garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder: lineage ends here.

    Unlike ``checkpoint()``, which runs its last stage a second time to save it, this computes it once. The shuffles
    behind the table are removed as soon as it is written."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stage-{name}-{uuid.uuid4().hex}"
    with brief_shuffles(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stage_path = path
    return out


def forget(df: DataFrame) -> None:
    """Remove a ``written`` table that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.stage_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def with_group_stats(df: DataFrame, keys: str | Sequence[str], *aggs: Column, how: str = "left") -> DataFrame:
    """Attach per-group aggregates to every row (pandas ``groupby().transform``).

    Written as aggregate + equi-join instead of an unordered window: the
    aggregate is combined map-side, so a group holding a large share of all
    rows never sits in one task's window buffer, and AQE's skew-join split
    handles the join back.  Rows with a null key get null statistics, as a
    null key forms no group.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    stats = df.groupBy(*keys).agg(*aggs)
    return df.join(stats, keys, how)


WIDE = 6  # reported doubles that are rounded in generated code


def round_to(c: Column, digits: int = 6) -> Column:
    """round(x * 10^d) / 10^d on the binary double (the SQL engines' rule).

    Spark's ``round(x, d)`` rounds the shortest decimal string of x instead,
    which disagrees on values such as 0.9894875; rounding the scaled value
    to an integer gives the same answer on both sides.
    """
    # snap to 9 digits first: two engines summing in different orders differ
    # in the last bits, which must not decide a 6-digit tie
    return _round_once(_round_once(c, digits + 3), digits)


def _round_once(x: Column, digits: int) -> Column:
    # half away from zero on the scaled double, in primitive arithmetic
    # (Spark's round goes through BigDecimal per value); |v| >= 1e15 is
    # already an integer in double precision and is left alone
    scale = F.lit(float(10 ** digits))
    v = x * scale
    r = F.when(F.abs(v) < F.lit(1e15), F.signum(v) * F.floor(F.abs(v) + F.lit(0.5))).otherwise(v)
    # no negative zero, which the SQL engines do not return: -0.0 + 0.0 is 0.0
    return r / scale + F.lit(0.0)


def report(c: Column, digits: int = 6) -> Column:
    """The rounding of reported doubles: ``digits`` decimals, and twice as many below 0.001, so that
    small differences and probabilities keep their leading digits."""
    return _report(c, _round_once(c, digits + 3), digits)


def _report(c: Column, snapped: Column, digits: int) -> Column:
    small = F.abs(c) < F.lit(1e-3)
    return F.when(small, _round_once(c, 2 * digits)).otherwise(_round_once(snapped, digits))


def round_cols(df: DataFrame, cols: Sequence[str], digits: int = 6) -> DataFrame:
    """Round computed doubles for stable value hashing across engines.

    In two steps, the snapped values between them: nested in one expression the inner rounding would stand
    there many times over, in code too long to compile."""
    if len(cols) <= WIDE:
        snapped = df.select("*", *[_round_once(F.col(c), digits + 3).alias(f"_snapped_{c}") for c in cols])
        return snapped.select(*[_report(F.col(c), F.col(f"_snapped_{c}"), digits).alias(c) if c in cols else F.col(c) for c in df.columns])
    # many columns: lambdas over an array, as the generated code of all of them would be too long to compile
    values = F.array(*[F.col(c).cast("double") for c in cols])
    rest = [c for c in df.columns if c not in cols]
    out = df.select(*rest, values.alias("_values"))
    snapped = F.transform("_values", lambda v: _round_once(v, digits + 3))
    out = out.select(*rest, F.zip_with("_values", snapped, lambda v, s: _report(v, s, digits)).alias("_rounded"))
    return out.select(*[F.col("_rounded")[list(cols).index(c)].alias(c) if c in cols else F.col(c) for c in df.columns])


def doubles(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    return round_cols(df, doubles(df), digits)
