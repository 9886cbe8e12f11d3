"""Exact percentiles of groups of any size, by counts of ranges that are narrowed until few values are left.

Counts are summed on the map side, a row a range; of each wanted rank only the range that holds it is cut further, and
at most FEW values of it are ever gathered.  So no task and no buffer holds a group, whatever its size and however
many values it has.  Values and order are those of Spark's percentile.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roomweave.storage import set_checkpoint_dir

FEW = 4096  # values of a range that are sorted
RANGES = 1024  # parts of a range
MOST_BROADCAST = 20_000  # wanted ranks that go to every task; more are joined


def _meet(values: DataFrame, wanted: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Each value beside the wanted ranks of its group in whose range it lies."""
    named = wanted.withColumnsRenamed({k: f"_of_{k}" for k in [*keys, "_axis"]})
    same = reduce(lambda a, k: a & F.col(k).eqNullSafe(F.col(f"_of_{k}")), keys, F.col("_axis") == F.col("_of__axis"))
    return values.join(F.broadcast(named) if n <= MOST_BROADCAST else named, same).where("_v BETWEEN _a AND _b").drop(*(f"_of_{k}" for k in [*keys, "_axis"]))


def percentiles(rows: DataFrame, wanted: dict[str, tuple[str, float]], keys: list[str] | None = None, count: str | None = None) -> DataFrame:
    """A row a group of keys (one row without keys) with a column for each wanted {name: (column, share)}.

    Nulls and NaN are left out; a group without values has nulls.  count: also how many values its fullest column has.
    rows is read a few times: checkpoint it where it costs much.
    """
    keys = keys or []
    spark, columns = rows.sparkSession, list(dict.fromkeys(c for c, _ in wanted.values()))
    set_checkpoint_dir(spark)
    values = rows.select(*keys, F.posexplode(F.array(*(F.col(c).cast("double") for c in columns))).alias("_axis", "_v")).where("_v IS NOT NULL AND NOT isnan(_v)")
    ends = values.groupBy(*keys, "_axis").agg(F.count("*").alias("_n"), F.min("_v").alias("_a"), F.max("_v").alias("_b"))
    names = spark.createDataFrame([(n, columns.index(c), float(q)) for n, (c, q) in wanted.items()], "_name string, _axis int, _q double")
    at = F.col("_q") * (F.col("_n") - 1)
    one = F.when(F.col("_a") == F.col("_b"), F.col("_a"))
    group = [*keys, "_axis", "_name", "_n", "_at", "_lo", "_hi"]
    state = ends.join(F.broadcast(names), "_axis").withColumns({"_at": at, "_lo": F.floor(at), "_hi": F.ceil(at)}).select(*group, F.lit(0).cast("long").alias("_below"), F.col("_n").alias("_within"), "_a", "_b", one.alias("_x"), one.alias("_y"))
    while True:
        state = state.checkpoint()
        wide = state.where((F.col("_within") > FEW) & F.col("_x").isNull())
        n = wide.count()
        if not n:
            break
        place = (F.col("_v") / 2 - F.col("_a") / 2) / (F.col("_b") / 2 - F.col("_a") / 2)  # halves, so that no difference overflows
        cut = _meet(values, wide, keys, n).withColumn("_range", F.least(F.lit(RANGES - 1), F.floor(place * RANGES)))
        counts = cut.groupBy(*group, "_below", "_range").agg(F.count("*").alias("_c"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        upto = counts.withColumn("_upto", F.sum("_c").over(W.partitionBy(*group).orderBy("_range")))  # RANGES rows at most
        first = lambda rank: F.min(F.when(F.col("_below") + F.col("_upto") > F.col(rank), F.struct("_range", "_c", "_low", "_high", "_upto")))
        held = upto.groupBy(*group, "_below").agg(first("_lo").alias("_p"), first("_hi").alias("_q"))
        same = F.col("_p._range") == F.col("_q._range")
        one = F.col("_p._low") == F.col("_p._high")
        narrower = held.select(*group, (F.col("_below") + F.col("_p._upto") - F.col("_p._c")).alias("_below"), F.col("_p._c").alias("_within"), F.col("_p._low").alias("_a"), F.col("_p._high").alias("_b"),
                               F.when(~same | one, F.col("_p._high")).alias("_x"), F.when(~same, F.col("_q._low")).when(one, F.col("_p._high")).alias("_y"))
        state = state.where((F.col("_within") <= FEW) | F.col("_x").isNotNull()).unionByName(narrower)
    few = state.where("_x IS NULL")
    lists = _meet(values, few, keys, few.count()).groupBy(*group, "_below").agg(F.sort_array(F.collect_list("_v")).alias("_list"))  # FEW values at most
    found = lists.select(*group, *(F.get("_list", (F.col(r) - F.col("_below")).cast("int")).alias(n) for r, n in (("_lo", "_x"), ("_hi", "_y"))))
    both = state.where("_x IS NOT NULL").select(*group, "_x", "_y").unionByName(found)
    value = F.when((F.col("_lo") == F.col("_hi")) | (F.col("_x") == F.col("_y")), F.col("_x")).otherwise((F.col("_hi") - F.col("_at")) * F.col("_x") + (F.col("_at") - F.col("_lo")) * F.col("_y"))
    return both.withColumn("_value", value).groupBy(*keys).agg(*(F.max(F.when(F.col("_name") == n, F.col("_value"))).alias(n) for n in wanted), *([F.coalesce(F.max("_n"), F.lit(0)).alias(count)] if count else []))
