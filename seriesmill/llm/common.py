"""What the operators share: written intermediate tables, free column names, word counts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Words are runs of anything but ASCII white space.
WORD = "[^\\x20\\x09-\\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors reach.

    The cluster names it in spark.checkpoint.dir. Where that is unset, as in tests, tables
    go below the warehouse folder, which is shared as well.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_sums_before(df: DataFrame, by: list[str], order: list[Column], sums: dict[str, str], name: str) -> DataFrame:
    """A written table: df and, for every sums entry (new column -> column), the sum over the rows before in its group.

    Rows are cut into sorted ranges, so neither a group nor all rows come into one task; what one
    range hands to the next is a row per range and group. The order has to be without ties.
    """
    part, offset = free_names(df, "range_number", "range_offset")
    groups = [named(x) for x in by]
    ranged = df.repartitionByRange(*groups, *order).withColumn(part, F.spark_partition_id())
    ranged = written(ranged, name)
    so_far = Window.partitionBy(part, *groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*groups).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranged.groupBy(part, *groups).agg(*[F.sum(named(x)).alias(new) for new, x in sums.items()])
    before = {new: F.coalesce(F.sum(new).over(earlier), F.lit(0)) for new in sums}
    ranges = ranges.select(part, *groups, F.struct(*[x.alias(new) for new, x in before.items()]).alias(offset))
    inside = ranged.withColumns({new: F.coalesce(F.sum(named(x)).over(so_far), F.lit(0)) for new, x in sums.items()})
    # null is a group like any other
    other = {x: f"{offset}_{i}" for i, x in enumerate(by)}
    ranges = ranges.withColumnsRenamed({part: f"{offset}_part", **other})
    same = F.col(part) == F.col(f"{offset}_part")
    for x, renamed in other.items():
        same &= named(x).eqNullSafe(F.col(renamed))
    found = inside.join(ranges, same).drop(f"{offset}_part", *other.values())
    found = found.withColumns({new: F.col(new) + F.col(offset)[new] for new in sums})
    return written(found.drop(part, offset), f"{name}-sums")


def named(column: str) -> Column:
    """A column by its plain name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names like the wanted ones that no column of df has."""
    taken, out = {x.lower() for x in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hex_number(digest: Column) -> Column:
    """The first 60 bits of a hexadecimal digest as a number."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
