"""Alignment in time, gaps, runs, rolling windows and ordered stages. Time is a column of microseconds unless said otherwise.

Keys of more than ``hot`` rows are dealt into slices of time (robolake.functions.slices), so that no task holds a hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from robolake.functions.columns import ratio
from robolake.functions.quantiles import percentiles
from robolake.functions.slices import GHOST, HOT, SLICE, carried, real, sliced, upto

SECOND = 1_000_000


def align_asof(left: DataFrame, right: DataFrame, key: str, us: str, tol: int, value: str, tie: str) -> DataFrame:
    """left with value, tie and time of the latest right row of its key before it, strictly, and at most tol earlier; null if none.

    Of right rows at one time the one with the larger tie counts. Rows are dealt by key and a slice of time as long as tol; right rows
    stand in their slice and the next, so one slice holds all that a left row can see, and no task holds a whole key.
    """
    both = ["__side", "__us", "__r"]
    slice_of = F.floor(F.col(us) / max(1, tol))
    lefts = left.withColumn("__side", F.lit(0)).withColumn("__us", F.col(us)).withColumn("__slice", slice_of)
    pair = F.struct(F.col(us).alias("us"), F.col(tie).alias("id"), F.col(value).alias("value"))
    rights = right.select(
        key, F.lit(1).alias("__side"), F.col(us).alias("__us"), pair.alias("__r"),
        F.explode(F.array(slice_of, slice_of + 1)).alias("__slice")
    )
    rows = lefts.unionByName(rights, allowMissingColumns=True)
    w = Window.partitionBy(key, "__slice").orderBy("__us", "__side", F.col("__r.id")).rowsBetween(Window.unboundedPreceding, -1)
    found = rows.withColumn("__f", F.last("__r", ignorenulls=True).over(w)).filter("__side = 0")
    near = F.when(F.col("__us") - F.col("__f.us") <= tol, F.col("__f"))
    return found.select(*left.columns, near["id"].alias("match_id"), near["us"].alias("match_us"), near["value"].alias("match_value")).drop(*both)


def band_join(left: DataFrame, right: DataFrame, at_left: str, at_right: str, before: int, after: int) -> DataFrame:
    """Pairs whose right time lies from ``before`` before to ``after`` after the left one, ends included; no other column has to be equal.

    Time is cut into slices as long as the band. A left row stands in its own slice, a right row in its own and the ones that the band reaches into from there, so
    rows meet by the number of their slice and each pair in one place. Null times meet nothing. Columns of both sides must differ in name.
    """
    if before < 0 or after < 0:
        raise ValueError("before and after are lengths")
    width = max(1, before + after)
    place = lambda c: F.floor(c / width)
    lefts = left.withColumn("__slice", place(F.col(at_left)))
    rights = right.withColumn("__slice", F.explode(F.sequence(place(F.col(at_right) - after), place(F.col(at_right) + before))))
    return lefts.join(rights, "__slice").filter(F.col(at_right).between(F.col(at_left) - before, F.col(at_left) + after)).drop("__slice")


def _back(df: DataFrame, keys: tuple[str, ...], us: str, tie: str, hot: int, columns: dict[str, tuple[str, int]]) -> DataFrame:
    """df with, for each name, the value that a column had so many rows before in its key."""
    rows = carried(sliced(df, keys, us, hot), keys, (us, tie), max(n for _, n in columns.values()))
    w = Window.partitionBy(*keys, SLICE).orderBy(us, tie)
    return real(rows.withColumns({name: F.lag(c, n).over(w) for name, (c, n) in columns.items()}))


#: Grid points of a key that resample() makes from one row.
POINTS = 1000


def resample(df: DataFrame, key: str, us: str, value: str, tie: str, step: int) -> DataFrame:
    """A grid of step for each key, from its first to its last time, with the last value at or before each point (ties: larger tie).

    A key's grid is cut into pieces of POINTS; a piece is filled by itself and from the last value of the pieces before.
    """
    width = step * POINTS
    at = (F.ceil(F.col(us) / step) * step).cast("long")
    last = df.groupBy(key, at.alias("grid")).agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(us, tie)).alias("__v"))
    hi = (F.floor(F.col(us) / step) * step).cast("long")
    span = df.groupBy(key).agg(F.min(at).alias("lo"), F.max(hi).alias("hi")).filter("lo <= hi")
    pieces = span.select(key, "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))).alias("__p"))
    first, end = F.greatest("lo", F.col("__p") * width), F.least("hi", F.col("__p") * width + (width - step))
    first = (F.ceil(first / step) * step).cast("long")
    grid = pieces.select(key, "__p", first.alias("a"), end.alias("b")).filter("a <= b")
    grid = grid.select(key, "__p", F.explode(F.sequence("a", "b", F.lit(step).cast("long"))).alias("grid"))
    last = last.withColumn("__p", F.floor(F.col("grid") / width))
    tail = last.groupBy(key, "__p").agg(F.max_by("__v", "grid").alias("__t"))
    ends = pieces.select(key, "__p").join(tail, [key, "__p"], "left")
    before = F.last("__t", ignorenulls=True).over(Window.partitionBy(key).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    fill = F.last("__v", ignorenulls=True).over(Window.partitionBy(key, "__p").orderBy("grid").rowsBetween(Window.unboundedPreceding, 0))
    filled = grid.join(last, [key, "__p", "grid"], "left").withColumn("__f", fill)
    return filled.join(ends.select(key, "__p", before.alias("__b")), [key, "__p"]).select(key, "grid", F.coalesce("__f", "__b")["v"].alias("value"))


def jitter(df: DataFrame, key: str, us: str, tie: str, hot: int = HOT) -> DataFrame:
    """Of the times between neighbours of each key: count, mean, sample deviation and median."""
    d = _back(df, (key,), us, tie, hot, {"__b": (us, 1)}).withColumn("d", F.col(us) - F.col("__b")).filter("d is not null")
    middle = percentiles(d, (key,), "d", {"median": 0.5}).select(key, "median")
    stats = d.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("jitter"))
    return stats.join(middle, stats[key].eqNullSafe(middle[key])).drop(middle[key])


def gaps(df: DataFrame, key: str, us: str, tie: str, longest: int, hot: int = HOT) -> DataFrame:
    """Stretches of more than ``longest`` without a row: the key, the time before and the length."""
    d = _back(df, (key,), us, tie, hot, {"from_us": (us, 1)})
    return d.select(key, "from_us", (F.col(us) - F.col("from_us")).alias("length")).filter(F.col("length") > longest)


def tickets(df: DataFrame, key: str, us: str, tie: str, gap: int, hot: int = HOT) -> DataFrame:
    """Events of a key whose distances are at most gap as one ticket: number in its key, first, last, events."""
    rows = carried(sliced(df.select(key, us, tie), (key,), us, hot), (key,), (us, tie), 1)
    w = Window.partitionBy(key, SLICE).orderBy(us, tie)
    start = F.coalesce(F.col(us) - F.lag(us).over(w) > gap, F.lit(True)).cast("long")
    rows = upto(rows.withColumn("__s", start).filter(~F.col(GHOST)), (key,), {"__n": F.col("__s")})
    number = F.coalesce("__n", F.lit(0)) + F.sum("__s").over(w.rowsBetween(Window.unboundedPreceding, 0))
    ends = [F.min(us).alias("first_us"), F.max(us).alias("last_us"), F.count(F.lit(1)).alias("n_events")]
    return rows.withColumn("ticket", number).groupBy(key, "ticket").agg(*ends)


def stage_shares(df: DataFrame, key: str, stage: str, us: str, tie: str, names: tuple[str, ...], hot: int = HOT) -> DataFrame:
    """Share of each stage in a key's time, a stage lasting until the next row, and the longest stage (ties: last by name)."""
    spans = _back(df.select(key, stage, us, tie), (key,), us, tie, hot, {"__b": (us, 1), "__stage": (stage, 1)})
    spans = spans.withColumn("d", F.col(us) - F.col("__b")).filter("d is not null")
    wide = spans.groupBy(key).pivot("__stage", list(names)).agg(F.sum("d")).na.fill(0)
    total = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    top = F.sort_array(F.array(*[F.struct(F.col(n).alias("d"), F.lit(n).alias("s")) for n in names]), asc=False)[0]["s"]
    return wide.select(key, *[F.try_divide(F.col(n), total).alias(f"share_{n}") for n in names], top.alias("dominant"))


def smooth(df: DataFrame, key: str, us: str, tie: str, value: str, n: int, hot: int = HOT) -> DataFrame:
    """Mean of the last n values, best so far, and how many rows since it last improved.

    Over the slices of a hot key: the best of those before comes first, then the place of the last improvement before.
    """
    order = (us, tie)
    rows = sliced(df, (key,), us, hot)
    w = Window.partitionBy(key, SLICE).orderBy(*order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = carried(upto(rows, (key,), {"__rows": F.lit(1)}, {"__top": F.col(value)}), (key,), order, n)
    rows = rows.withColumn("smoothed", F.avg(value).over(w.rowsBetween(1 - n, 0))).filter(~F.col(GHOST)).drop(GHOST)
    best = F.greatest("__top", F.max(value).over(so_far))
    before = F.greatest("__top", F.max(value).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    place = F.row_number().over(w).cast("long") + F.coalesce("__rows", F.lit(0))
    rows = rows.withColumns({"best": best, "__k": place, "__better": F.coalesce(F.col(value) > before, F.lit(True))})
    last = F.when(F.col("__better"), F.col("__k"))
    rows = upto(rows, (key,), tops={"__last": last})
    rows = rows.withColumn("plateau", F.col("__k") - F.greatest("__last", F.max(last).over(so_far)))
    return rows.select(*df.columns, "smoothed", "best", "plateau")


def ripple(df: DataFrame, key: str, us: str, tie: str, value: str, n: int, times: float, hot: int = HOT) -> DataFrame:
    """Range and sample deviation of the last n values, and a spike where a value is more than ``times`` that deviation off the mean."""
    w = Window.partitionBy(key, SLICE).orderBy(us, tie).rowsBetween(1 - n, 0)
    r = carried(sliced(df, (key,), us, hot), (key,), (us, tie), n)
    stats = {"spread": F.max(value).over(w) - F.min(value).over(w), "sd": F.stddev_samp(value).over(w), "mean": F.avg(value).over(w)}
    r = real(r.withColumns(stats))
    return r.withColumn("spike", F.coalesce(F.abs(F.col(value) - F.col("mean")) > times * F.col("sd"), F.lit(False))).drop("mean")


def trailing_mean(df: DataFrame, key: str, us: str, tie: str, value: str, n: int, name: str, hot: int = HOT) -> DataFrame:
    """Mean of the last n values of each key."""
    w = Window.partitionBy(key, SLICE).orderBy(us, tie).rowsBetween(1 - n, 0)
    return real(carried(sliced(df, (key,), us, hot), (key,), (us, tie), n).withColumn(name, F.avg(value).over(w)))


def funnel(df: DataFrame, key: str, stage: str, us: str, stages: tuple[str, ...]) -> DataFrame:
    """How many keys reach each stage, in order: the first time of a stage not before that of the stage before."""
    first = df.groupBy(key).agg(*[F.min(F.when(F.col(stage) == s, F.col(us))).alias(f"t{i}") for i, s in enumerate(stages)])
    ok, reached = F.col("t0").isNotNull(), []
    for i in range(len(stages)):
        if i:
            ok = ok & F.coalesce(F.col(f"t{i}") >= F.col(f"t{i - 1}"), F.lit(False))
        reached.append(F.count_if(ok))
    counts = first.agg(F.array(*reached).alias("n"))
    rows = counts.select(F.posexplode(F.arrays_zip(F.array(*[F.lit(s) for s in stages]).alias("stage"), F.col("n"))).alias("k", "r"), "n")
    return rows.select(
        (F.col("k") + 1).cast("long").alias("step"), "r.stage", "r.n",
        F.when(F.col("k") > 0, F.try_divide(F.col("r.n"), F.get(F.col("n"), F.col("k") - 1))).alias("from_before")
    )


def between_failures(df: DataFrame, key: str, us: str) -> DataFrame:
    """Mean time between failures of each key, in hours: what lies between the first and the last, over one less than their number."""
    n = F.count(F.lit(1))
    mean = F.try_divide((F.max(us) - F.min(us)).cast("double"), n - 1)
    return df.groupBy(key).agg(n.alias("n_failures"), (mean / (3600 * SECOND)).alias("mtbf_hours"))


def throughput(df: DataFrame, us: str, value: str, step: int) -> DataFrame:
    """Rows, median and 95th percentile of each bucket of time, of any number of buckets."""
    bucketed = df.select((F.floor(F.col(us) / step) * step).cast("long").alias("bucket"), value)
    return percentiles(bucketed, ("bucket",), value, {"p50": 0.5, "p95": 0.95})


def deadline_miss(df: DataFrame, key: str, us: str, tie: str, budget: int, hot: int = HOT) -> DataFrame:
    """Share of periods longer than the budget, and the 99th percentile of the periods."""
    d = _back(df, (key,), us, tie, hot, {"__b": (us, 1)}).withColumn("d", F.col(us) - F.col("__b")).filter("d is not null")
    tail = percentiles(d, (key,), "d", {"p99": 0.99}).select(key, "p99")
    miss = F.count_if(F.col("d") > budget)
    stats = d.groupBy(key).agg(F.count(F.lit(1)).alias("n"), miss.alias("n_miss"), (miss / F.count(F.lit(1))).alias("miss_ratio"))
    return stats.join(tail, stats[key].eqNullSafe(tail[key])).drop(tail[key])


def predict_linear(df: DataFrame, key: str, us: str, tie: str, value: str, hot: int = HOT) -> DataFrame:
    """Value expected from the two rows before by constant velocity, and the error; null without two rows at different times."""
    r = _back(df, (key,), us, tie, hot, {"v1": (value, 1), "v2": (value, 2), "t1": (us, 1), "t2": (us, 2)})
    speed = F.try_divide(F.col("v1") - F.col("v2"), (F.col("t1") - F.col("t2")).cast("double"))
    r = r.withColumn("predicted", F.col("v1") + speed * (F.col(us) - F.col("t1")))
    return r.withColumn("error", F.abs(F.col(value) - F.col("predicted"))).drop("v1", "v2", "t1", "t2")


def displacement_errors(df: DataFrame, key: str, us: str, tie: str) -> DataFrame:
    """Mean error of a key's predictions and the error of the last one."""
    return df.filter("error is not null").groupBy(key).agg(F.avg("error").alias("ade"), F.max_by("error", F.struct(us, tie)).alias("fde"))


#: Copies of a key's one row in step_response(), so that its rows meet it in as many tasks.
SALTS = 16


def step_response(df: DataFrame, key: str, us: str, tie: str, value: str, band: float) -> DataFrame:
    """Overshoot over the last value, as a share of it (infinite over a last value of 0, NaN if there is none), and the time of the last row outside the band around it.

    The last value of a key is an aggregate; rows are dealt by key and SALTS by hash to meet it, and summed up again in two steps.
    """
    ends = df.groupBy(key).agg(
        F.max_by(F.struct(F.col(value).alias("v")), F.struct(us, tie)).alias("__last"), F.max(value).alias("__top"),
        F.min(us).alias("__begin")
    )
    named = ends.select(F.col(key).alias("__key"), F.col("__last.v").alias("final"), "__top", "__begin")
    salted = named.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = df.select(key, us, value, F.pmod(F.xxhash64(us, tie), F.lit(SALTS)).cast("int").alias("__s"))
    met = rows.join(salted, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__s") == F.col("__salt")))
    off = F.abs(F.col(value) - F.col("final")) > band * F.abs(F.col("final"))
    told = [F.first(c).alias(c) for c in ("final", "__top", "__begin")]  # as keys they would lose the sign of a zero
    late = met.groupBy(key, "__s").agg(F.max(F.when(off, F.col(us))).alias("__out"), *told)
    late = late.groupBy(key).agg(F.max("__out").alias("__out"), *told)
    overshoot = ratio(F.greatest(F.col("__top") - F.col("final"), F.lit(0.0)), F.col("final"))
    return late.select(key, "final", overshoot.alias("overshoot"), F.coalesce(F.col("__out") - F.col("__begin"), F.lit(0)).alias("settling_us"))


def first_match(rules: list[tuple[str, Column]], other: str) -> Column:
    """The name of the first rule that holds."""
    return F.coalesce(*[F.when(c, n) for n, c in rules], F.lit(other))
