"""One ranking from several differently-scaled scores (problem 5).

Method: in each request every score is standardised by its median and median absolute deviation, squashed by
the logistic function so that outliers stay bounded, and the bounded values are combined by a weighted
geometric mean (equal weights unless given).

Medians (the value at rank ceil(n / 2)) are exact at every size. ``percentile_approx`` at an accuracy of 10,000, combined on the map side, is exact
for a request of up to 10,000 candidates; for the median of a larger one it gives bounds, and the median is found among the
values between them, a share of about 4 in 10,000, so that one request may hold a third of all rows.
The medians are joined back to the candidates, and a request of more than HOT candidates is divided over tasks for that. Ranks within a request come from windows limited to the first few rows, which Spark prunes before the shuffle.

Defined cases: a null or NaN score is no score of its branch and counts as FLOOR in the mean; an infinite score
is an outlier; a spread of 0 makes every value of the branch the middle one, 0.5; equal combined values are
ordered by id; a re-delivered candidate counts once; a candidate without any score is ranked last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import materialize

FLOOR = 1e-3
ACCURACY = 10_000
HOT = 200_000  # rows of a group that meet in one task
# Metrics for which a smaller score is better.
SMALLER_IS_BETTER = ("squared_l2", "negative_dot")


def present(score: Column) -> Column:
    """The score, or null where it is NaN; infinities become the largest finite values."""
    top = 1.7e308
    return F.when(score.isNotNull() & ~F.isnan(score), F.greatest(F.least(score, F.lit(top)), F.lit(-top)))


def crowding(df: DataFrame, group: str) -> tuple[bool, dict]:
    """Whether a group has more rows than are surely exact in one pass, and into how many parts each group of more than HOT rows is divided.

    There are at most rows / HOT such groups; of none of the others anything reaches the driver.
    """
    counts = df.groupBy(group).agg(F.count("*").alias("_n")).filter(F.col("_n") > min(ACCURACY, HOT))
    if not counts.limit(1).count():
        return False, {}
    return True, {r[group]: -(-r["_n"] // HOT) for r in counts.filter(F.col("_n") > HOT).collect()}


def attached(df: DataFrame, small: DataFrame, group: str, hot: dict, spread: str) -> DataFrame:
    """``df`` with the columns of ``small`` (one row per group); hot groups are divided by the hash of ``spread``."""
    if not hot:
        return df.join(small, group, "left")
    parts = df.sparkSession.createDataFrame(list(hot.items()), T.StructType([df.schema[group], T.StructField("_parts", T.LongType())]))
    # at most one row per HOT rows of df
    salted = df.join(F.broadcast(parts), group, "left").withColumn("_salt", F.pmod(F.xxhash64(spread), F.coalesce("_parts", F.lit(1)))).drop("_parts")
    copies = small.join(F.broadcast(parts), group, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return salted.join(copies, [group, "_salt"], "left").drop("_salt")


def medians(df: DataFrame, group: str, values: dict[str, Column], crowded: bool) -> DataFrame:
    """``group`` and the exact median of each of ``values``, null where a group has no value.

    ``crowded`` says whether any group may have more rows than ACCURACY; only then the bounds are followed up.
    """
    rows = df.select(group, *[v.alias(n) for n, v in values.items()])
    near = rows.groupBy(group).agg(
        *[F.percentile_approx(n, F.array(F.lit(0.5 - 2 / ACCURACY), F.lit(0.5), F.lit(0.5 + 2 / ACCURACY)), ACCURACY).alias(n) for n in values],
        *[F.count(n).alias(f"_n_{n}") for n in values],
    )
    few = near.select(group, *[F.col(n)[1].alias(n) for n in values], *[F.when(F.col(f"_n_{n}") > ACCURACY, F.col(n)).alias(f"_b_{n}") for n in values], *[f"_n_{n}" for n in values])
    if not crowded:
        return few.select(group, *values)
    for n in values:
        bounds = few.filter(F.col(f"_b_{n}").isNotNull()).select(group, F.col(f"_b_{n}")[0].alias("_lo"), F.col(f"_b_{n}")[2].alias("_hi"), F.col(f"_n_{n}").alias("_n"))
        inside = rows.select(group, F.col(n).alias("_v")).join(bounds, group).filter(F.col("_v").isNotNull() & (F.col("_v") <= F.col("_hi")))
        # equal values, and all those below the bounds, become one row each on the map side
        counts = inside.groupBy(group, F.when(F.col("_v") >= F.col("_lo"), F.col("_v")).alias("_v")).agg(F.count("*").alias("_c"), F.max("_n").alias("_n"))
        reached = F.sum("_c").over(Window.partitionBy(group).orderBy(F.col("_v").asc_nulls_first()))
        exact = counts.withColumn("_s", reached).filter(F.col("_v").isNotNull() & (F.col("_s") * 2 >= F.col("_n"))).groupBy(group).agg(F.min("_v").alias("_exact"))
        few = few.join(exact, group, "left").withColumn(n, F.coalesce("_exact", n)).drop("_exact")
    return few.select(group, *values)


def combine(df: DataFrame, group: str, scores: dict[str, float], out: str = "combined") -> DataFrame:
    """``df`` with ``out``, the weighted geometric mean of the bounded values of ``scores`` (name -> weight).

    Every score must already be 'larger is better'. Two small aggregates per group are joined back.
    """
    names, (crowded, hot) = list(scores), crowding(df, group)
    centred = attached(df, medians(df, group, {f"_m{i}": F.col(n) for i, n in enumerate(names)}, crowded), group, hot, names[0])
    spread = medians(centred, group, {f"_s{i}": F.abs(F.col(n) - F.col(f"_m{i}")) for i, n in enumerate(names)}, crowded)
    wide = attached(centred, spread, group, hot, names[0])
    total, log = sum(scores.values()), F.lit(0.0)
    for i, n in enumerate(names):
        z = (F.col(n) - F.col(f"_m{i}")) / (F.lit(1.4826) * F.col(f"_s{i}"))
        z = F.when(F.col(f"_s{i}") > 0, z).otherwise(F.lit(0.0))
        bounded = F.greatest(F.lit(FLOOR), F.lit(1.0) / (F.lit(1.0) + F.exp(-z)))
        log = log + F.lit(scores[n] / total) * F.log(F.when(F.col(n).isNull(), F.lit(FLOOR)).otherwise(bounded))
    return wide.withColumn(out, F.exp(log)).drop(*[f"_{k}{i}" for k in "ms" for i in range(len(names))])


def candidates(df: DataFrame) -> DataFrame:
    """``request_id, object_id, lexical, vector`` once per key, both scores 'larger is better' and null if unusable."""
    vector = F.when(F.col("vector_metric").isin(*SMALLER_IS_BETTER), -F.col("vector")).otherwise(F.col("vector"))
    got = df.filter("request_id is not null and object_id is not null").select("request_id", "object_id", present(F.col("lexical")).alias("lexical"), present(vector).alias("vector"))
    return got.groupBy("request_id", "object_id").agg(F.max("lexical").alias("lexical"), F.max("vector").alias("vector"))


def ranking(df: DataFrame) -> DataFrame:
    """``request_id, object_id, combined`` of every candidate; order by combined descending, then object_id."""
    return combine(materialize(candidates(df)), "request_id", {"lexical": 1.0, "vector": 1.0}).select("request_id", "object_id", "lexical", "vector", "combined")


def agreed_first(df: DataFrame, first: int = 3) -> DataFrame:
    """``request_id, object_id``: first in the combined ranking and among the ``first`` of each score."""
    ranked = ranking(df)
    own = Window.partitionBy("request_id")
    best = ranked.withColumn("_r", F.row_number().over(own.orderBy(F.desc("combined"), "object_id"))).filter("_r = 1").drop("_r")
    for score in ("lexical", "vector"):
        # the value of the rank that still counts, by at most `first` rows per request
        last = (
            ranked.filter(F.col(score).isNotNull()).select("request_id", score)
            .withColumn("_r", F.row_number().over(own.orderBy(F.desc(score)))).filter(F.col("_r") <= first)
            .groupBy("request_id").agg(F.min(score).alias(f"_{score}"))
        )
        best = best.join(last, "request_id").filter(F.col(score) >= F.col(f"_{score}"))
    return best.select("request_id", "object_id")
