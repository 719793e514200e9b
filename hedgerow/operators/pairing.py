"""Every row of one table with every row of another, where that is what is asked for."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUP_ROWS = 1000


def every_pair(many: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """Pairs through an equi-join: ``few`` is dealt into groups of about a thousand by ``key`` and each
    row of ``many`` is entered once per group.

    While ``few`` is small there is one group and Spark, which knows the sizes, broadcasts it; a large
    one is shuffled by group.  Nothing is gathered on the driver or in one row.
    """
    groups = few.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / GROUP_ROWS)).cast("int")).scalar()
    left = many.withColumn("_group", F.explode(F.sequence(F.lit(0), groups - 1)))
    right = few.withColumn("_group", F.pmod(F.xxhash64(key), groups).cast("int"))
    return left.join(right, "_group").drop("_group")
