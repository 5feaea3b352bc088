"""Success rates, tails, regressions, generalisation, and errors of detections, poses, vectors and distributions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from robolake.functions.columns import Z95, bin_of, hash_mod, wilson
from robolake.functions.quantiles import percentiles, ranked
from robolake.functions.scans import numbered
from robolake.functions.scratch import Rounds
from robolake.functions.slices import HOT, SLICE, carried, real, sliced
from robolake.operators.nearest import top_similar  # noqa: F401


def success_rate(df: DataFrame, by: tuple[str, ...], success: str, z: float = Z95) -> DataFrame:
    """n, k, rate and Wilson bounds of each group."""
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(success).alias("k"))
    p, lo, hi = wilson(F.col("k"), F.col("n"), z)
    return counts.select(*by, "n", "k", p.alias("p"), lo.alias("lo"), hi.alias("hi"))


def tail(df: DataFrame, by: tuple[str, ...], value: str) -> DataFrame:
    """Interpolated median and 95th percentile, exact; groups are cells of a report, each of any number of rows."""
    return percentiles(df, by, value, {"p50": 0.5, "p95": 0.95})


def tail_approx(df: DataFrame, by: tuple[str, ...], value: str, accuracy: int = 10_000) -> DataFrame:
    """The values at these ranks, not interpolated, for groups too large to sort: mergeable sketches say where they are, counts which they are."""
    return ranked(df, by, value, {"p50": 0.5, "p95": 0.95}, accuracy=accuracy)


def regression(df: DataFrame, cell: str, version: str, success: str, base: str, cand: str, z: float = Z95) -> DataFrame:
    """Per cell the candidate's rate minus the baseline's; regressed if its upper bound is below the baseline's lower, MISSING without either side.

    One aggregation holds both versions.
    """
    of = lambda v: F.count_if(F.col(version) == v)
    won = lambda v: F.count_if((F.col(version) == v) & F.col(success))
    c = df.groupBy(cell).agg(of(base).alias("nb"), won(base).alias("kb"), of(cand).alias("nc"), won(cand).alias("kc"))
    pb, lob, _ = wilson(F.col("kb"), F.col("nb"), z)
    pc, _, hic = wilson(F.col("kc"), F.col("nc"), z)
    status = F.when((F.col("nb") == 0) | (F.col("nc") == 0), "MISSING").when(hic < lob, "REGRESSED").otherwise("OK")
    return c.select(cell, (pc - pb).alias("delta"), status.alias("status"))


def generalisation(df: DataFrame, dims: tuple[str, str], success: str, seen: Column) -> DataFrame:
    """Rate of every combination and total of two dimensions minus the rate of the seen rows; grouping tells totals from null data."""
    cells = df.cube(*dims).agg(
        F.grouping_id().cast("long").alias("grouping"), F.count(F.lit(1)).alias("n"), F.avg(F.col(success).cast("double")).alias("p")
    )
    ref = df.filter(seen).agg(F.avg(F.col(success).cast("double")).alias("ref"))
    return cells.join(F.broadcast(ref)).select(*dims, "grouping", "n", "p", (F.col("p") - F.col("ref")).alias("degradation"))


def stability(df: DataFrame, cell: str, repeat: str, success: str) -> DataFrame:
    """Largest minus smallest rate over the repeats of a cell."""
    each = df.groupBy(cell, repeat).agg(F.avg(F.col(success).cast("double")).alias("p"))
    return each.groupBy(cell).agg(F.count(F.lit(1)).alias("n_repeats"), (F.max("p") - F.min("p")).alias("spread"))


def eval_matrix(df: DataFrame, dims: tuple[str, ...], success: str) -> DataFrame:
    """Rate of every combination of dimensions with all totals."""
    return df.cube(*dims).agg(
        F.grouping_id().cast("long").alias("grouping"), F.count(F.lit(1)).alias("n"), F.avg(F.col(success).cast("double")).alias("p")
    )


def rate_table(df: DataFrame, row: str, column: str, values: tuple[str, ...], success: str) -> DataFrame:
    return df.groupBy(row).pivot(column, list(values)).agg(F.avg(F.col(success).cast("double")))


#: Ids of predictions of equal confidence in a cell of detections().
RUN = 1_000_000


def _boxes(df: DataFrame, image: str) -> DataFrame:
    """Boxes with an area, and the level of their longer side: the power of two that holds it."""
    side = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    return df.filter("x1 > x0 and y1 > y0").withColumn("__level", F.ceil(F.log2(side)).cast("long"))


def _touched(df: DataFrame, level: Column) -> DataFrame:
    """A row for each cell of the grid of a level, 2 ** level wide, that a box touches."""
    place = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("__grid")))
    rows = df.withColumn("__grid", level)
    rows = rows.withColumn("__cx", F.explode(F.sequence(place("x0"), place("x1"))))
    return rows.withColumn("__cy", F.explode(F.sequence(place("y0"), place("y1"))))


def overlaps(pred: DataFrame, truth: DataFrame, image: str, iou: float) -> DataFrame:
    """id, conf, tid and o: the pairs of a prediction and a true box of its image whose intersection over union is iou or more.

    Boxes meet in cells of a grid. Sides of such a pair differ by a factor of 1 / iou at most, so each prediction lies on the grid of its own level,
    where it touches four cells at most, and each true box on those of the levels that near; so boxes of any size and images of any number of boxes
    bring about as many pairs together as lie near each other. A pair is taken in the one cell that holds the lower corner of its intersection.
    """
    if not 0 < iou <= 1:
        raise ValueError("iou lies above 0 and is 1 at most")
    near = math.ceil(-math.log2(iou))
    t = _boxes(truth.select(image, "id", "x0", "y0", "x1", "y1"), image)
    t = _touched(t, F.explode(F.sequence(F.col("__level") - near, F.col("__level") + near)))
    t = t.select(image, "__grid", "__cx", "__cy", F.col("id").alias("tid"), *[F.col(c).alias(f"t{c}") for c in ("x0", "y0", "x1", "y1")])
    p = _touched(_boxes(pred.select(image, "id", "conf", "x0", "y0", "x1", "y1"), image), F.col("__level"))
    met = p.join(t, [image, "__grid", "__cx", "__cy"])
    corner = lambda c: F.floor(F.greatest(f"{c}0", f"t{c}0") / F.pow(F.lit(2.0), F.col("__grid")))
    met = met.filter((corner("x") == F.col("__cx")) & (corner("y") == F.col("__cy")))
    side = lambda a: F.greatest(F.least(f"{a}1", f"t{a}1") - F.greatest(f"{a}0", f"t{a}0"), F.lit(0.0))
    inter = side("x") * side("y")
    area = lambda p: (F.col(f"{p}x1") - F.col(f"{p}x0")) * (F.col(f"{p}y1") - F.col(f"{p}y0"))
    return met.withColumn("o", inter / (area("") + area("t") - inter)).filter(F.col("o") >= iou).select("id", "conf", "tid", "o")


def matched(pairs: DataFrame) -> DataFrame:
    """Of overlaps() the one-to-one matching (id, tid) that taking predictions by confidence (ties: smaller id) gives, each the free true box with which it
    overlaps most (ties: smaller id).

    By rounds, not one by one: each prediction asks for the best box that hasn't turned it down, each box keeps the most confident one that asks, and
    the rounds end when none is turned down. That is the same matching, as all boxes rank predictions alike.
    """
    with Rounds(pairs.sparkSession) as rounds:
        left = rounds.written(pairs)
        while True:
            ask = left.groupBy("id", "conf").agg(F.max_by("tid", F.struct("o", -F.col("tid"))).alias("tid"))
            kept = ask.groupBy("tid").agg(F.min_by("id", F.struct(-F.col("conf"), "id")).alias("id"))
            no = rounds.written(ask.join(kept, ["id", "tid"], "left_anti").select("id", "tid"))
            if no.isEmpty():
                return rounds.result(kept.select("id", "tid"))
            left = rounds.written(left.join(no, ["id", "tid"], "left_anti"))


def detections(pred: DataFrame, truth: DataFrame, image: str, iou: float) -> DataFrame:
    """Precision, recall and average precision of boxes (id, a number; image, x0, y0, x1, y1; predictions also conf), matched one to one by confidence.

    Boxes meet within their image only; those without an area, or with a null, match nothing.
    """
    right = matched(overlaps(pred, truth, image, iou)).select("id", F.lit(1).alias("hit"))
    n_truth = truth.agg(F.count(F.lit(1)).alias("n_truth"))
    ranked = pred.select("id", "conf").join(right, "id", "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    # A running count over all predictions by confidence: sums of cells, which lie in that order, and inside each. Of equal confidences, which
    # may be all, the ids are cut into runs; so a cell is (confidence to 1/1000, confidence, run of ids), and bins of many confidences keep runs small.
    bin_ = F.greatest(F.least(F.floor(F.col("conf") * 1000), F.lit(1000)), F.lit(0)).cast("long")  # so there are 1001
    cell = [bin_.alias("bin"), F.floor(F.col("id") / RUN).alias("run")]
    cells = ranked.select("id", "conf", "hit", *cell)
    equal = cells.groupBy("bin").agg(F.min("conf").alias("c0"), F.max("conf").alias("c1")).filter("c0 = c1").select("bin", F.lit(True).alias("equal"))
    cells = cells.join(F.broadcast(equal), "bin", "left").withColumn("run", F.when(F.col("equal"), F.col("run")).otherwise(F.lit(0))).drop("equal")
    sums = cells.groupBy("bin", "run").agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("h"))
    above = Window.orderBy(F.desc("bin"), "run").rowsBetween(Window.unboundedPreceding, -1)
    totals = {c: F.coalesce(F.sum(x).over(above), F.lit(0)) for c, x in (("n0", "n"), ("h0", "h"))}
    before = sums.select("bin", "run", *[c.alias(n) for n, c in totals.items()])
    w = Window.partitionBy("bin", "run").orderBy(F.desc("conf"), "id").rowsBetween(Window.unboundedPreceding, 0)
    at = cells.join(before, ["bin", "run"]).withColumns({"tp": F.col("h0") + F.sum("hit").over(w), "k": F.col("n0") + F.count(F.lit(1)).over(w)})
    precision = F.sum(F.when(F.col("hit") == 1, F.col("tp") / F.col("k")))
    told = at.agg(F.count(F.lit(1)).alias("n_pred"), F.coalesce(F.sum("hit"), F.lit(0)).alias("tp"), precision.alias("s")).join(F.broadcast(n_truth))
    rates = [F.try_divide("tp", n).alias(c) for n, c in (("n_pred", "precision"), ("n_truth", "recall"))]
    return told.select("n_pred", "n_truth", "tp", *rates, F.try_divide(F.coalesce("s", F.lit(0.0)), "n_truth").alias("ap"))


def vector_errors(pred: DataFrame, truth: DataFrame, key: str, vec: str) -> DataFrame:
    """Per key the distance, the relative distance and the angle in degrees between two vectors of doubles."""
    p, t = pred.select(key, F.col(vec).alias("p")), truth.select(key, F.col(vec).alias("t"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    d = F.sqrt(F.aggregate(F.zip_with("p", "t", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    norm = F.sqrt(dot("t", "t"))
    cos = F.try_divide(dot("p", "t"), F.sqrt(dot("p", "p")) * norm)
    return p.join(t, key).select(
        key, d.alias("error"), F.try_divide(d, norm).alias("relative"),
        F.degrees(F.acos(F.greatest(F.least(cos, F.lit(1.0)), F.lit(-1.0)))).alias("angle")
    )


def pose_summary(pred: DataFrame, truth: DataFrame, key: str, vec: str, by: str) -> DataFrame:
    """Of the vectors of a group (``by`` is a column of pred): how many, the root of the mean squared error of an element, the mean distance and the largest angle."""
    p = pred.select(by, key, F.size(vec).alias("__d"))
    e = vector_errors(pred, truth, key, vec).join(p, key)
    rmse = F.sqrt(F.try_divide(F.sum(F.col("error") * F.col("error")), F.sum("__d")))
    return e.groupBy(by).agg(F.count(F.lit(1)).alias("n"), rmse.alias("rmse"), F.avg("error").alias("mean_error"), F.max("angle").alias("max_angle"))


def fuse(df: DataFrame, key: str, value: str, variance: str) -> DataFrame:
    """Inverse-variance weighted mean and its variance; rows without a positive variance don't count."""
    w = F.when(F.col(variance) > 0, 1 / F.col(variance))
    return df.groupBy(key).agg(F.try_divide(F.sum(F.col(value) * w), F.sum(w)).alias("fused"), F.try_divide(F.lit(1.0), F.sum(w)).alias("variance"))


def tracking(df: DataFrame, by: str, reference: str, actual: str, band: float) -> DataFrame:
    """RMSE, largest error and share within the band."""
    e = F.col(actual) - F.col(reference)
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.max(F.abs(e)).alias("max_error"),
        (F.count_if(F.abs(e) <= band) / F.count(F.lit(1))).alias("in_band")
    )


def joint_limits(df: DataFrame, key: str, vec: str, lo: float, hi: float) -> DataFrame:
    """Per row how many elements are outside the limits, the largest excess and the norm."""
    v = F.transform(vec, lambda x: x.cast("double"))
    excess = F.transform(v, lambda x: F.greatest(x - hi, lo - x, F.lit(0.0)))
    return df.select(
        key, F.size(F.filter(excess, lambda x: x > 0)).cast("long").alias("n_violations"), F.array_max(excess).alias("max_excess"),
        F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)).alias("norm")
    )


def tune(df: DataFrame, cells: tuple[str, ...], loss: str) -> DataFrame:
    """The cell of parameters with the smallest mean loss (ties: smallest cell)."""
    return df.groupBy(*cells).agg(F.avg(loss).alias("loss")).orderBy(F.round("loss", 9), *cells).limit(1)


def discretise(df: DataFrame, by: str, value: str, lo: float, hi: float, n: int) -> DataFrame:
    """Values as n tokens and back to the middle of their bin: tokens used, mean and largest error, by group."""
    token = F.greatest(F.least(bin_of(F.col(value), lo, hi, n), F.lit(n)), F.lit(1))
    back = lo + (token - 0.5) * ((hi - lo) / n)
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct(token).alias("n_tokens"), F.avg(F.abs(F.col(value) - back)).alias("mean_error"),
        F.max(F.abs(F.col(value) - back)).alias("max_error")
    )


def ranks(df: DataFrame, by: str, value: str, tie: str, parts: int, nth: int) -> DataFrame:
    """tie, an id, for each row with its place in its group by value and tie: which of ``parts`` equal parts it is in, its share of the rows before and up to it, its
    rank by value alone, and the id that stands nth (null in smaller groups). A group may have any number of rows. The result is written."""
    with Rounds(df.sparkSession) as rounds:
        rows = rounds.written(numbered(df.select(by, value, tie), by, (value, tie), rounds))
        k, n = F.col("__k"), F.col("__n")
        first = rows.groupBy(F.col(by).alias("__by"), F.col(value).alias("__value")).agg(F.min("__k").alias("rank"))
        at = rows.filter(k == nth).select(F.col(by).alias("__group"), F.col(tie).alias("nth"))
        size, more = F.expr(f"__n div {parts}"), n % parts
        part = F.when(k <= more * (size + 1), F.expr(f"(__k - 1) div (__n div {parts} + 1) + 1")).otherwise(more + F.expr(f"try_divide(__k - __n % {parts} * (__n div {parts} + 1) - 1, __n div {parts})").cast("long") + 1)
        met = rows.join(first, F.col(by).eqNullSafe(F.col("__by")) & F.col(value).eqNullSafe(F.col("__value"))).join(at, F.col(by).eqNullSafe(F.col("__group")), "left")
        share = F.coalesce(F.try_divide(k - 1, n - 1), F.lit(0.0)).alias("share")
        return rounds.result(met.select(tie, part.cast("long").alias("part"), share, (k / n).alias("upto"), F.col("rank").cast("long").alias("rank"), "nth"))


def horizon_error(df: DataFrame, key: str, us: str, tie: str, value: str, horizons: tuple[int, ...], hot: int = HOT) -> DataFrame:
    """Mean absolute error of repeating the value h rows before, for each h."""
    rows = carried(sliced(df.select(key, us, tie, value), (key,), us, hot), (key,), (us, tie), max(horizons))
    w = Window.partitionBy(key, SLICE).orderBy(us, tie)
    errors = real(rows.withColumns({f"h{h}": F.abs(F.col(value) - F.lag(value, h).over(w)) for h in horizons}))
    means = errors.agg(*[F.avg(f"h{h}").alias(f"h{h}") for h in horizons])
    return means.unpivot([], [f"h{h}" for h in horizons], "horizon", "error")


def top_choice(df: DataFrame, by: str, label: str, prob: str) -> DataFrame:
    """The likeliest label of each group (ties: the last by name) and its probability."""
    best = F.max(F.struct(prob, label)).alias("b")
    return df.groupBy(by).agg(best).select(by, F.col(f"b.{label}").alias("choice"), F.col(f"b.{prob}").alias("confidence"))


def teacher_student(df: DataFrame, by: str, label: str, teacher: str, student: str, least: float) -> DataFrame:
    """Per group the choices of both, whether they agree and whether the teacher's is confident, at least ``least``; the latter are the subset to learn from."""
    t = top_choice(df, by, label, teacher).select(by, F.col("choice").alias("teacher"), "confidence")
    s = top_choice(df, by, label, student).select(by, F.col("choice").alias("student"))
    both = t.join(s, by)
    return both.select(
        by, "teacher", "student", "confidence", (F.col("teacher") == F.col("student")).alias("agrees"),
        (F.col("confidence") >= least).alias("confident")
    )


def agreement_rate(choices: DataFrame) -> DataFrame:
    """Of teacher_student(): groups, the share that agrees, and both for the confident ones."""
    agrees, sure = F.col("agrees"), F.col("confident")
    n = F.count(F.lit(1))
    rates = [
        F.try_divide(F.count_if(agrees), n).alias("agreement"),
        F.try_divide(F.count_if(agrees & sure), F.count_if(sure)).alias("confident_agreement")
    ]
    return choices.agg(n.alias("n"), F.count_if(sure).alias("n_confident"), *rates)


def divergence(df: DataFrame, by: str, teacher: str, student: str) -> DataFrame:
    """Sum of p ln(p / q) over a group's outcomes; p = 0 adds nothing, q = 0 with p > 0 makes it null."""
    p, q = F.col(teacher), F.col(student)
    term = F.when(p == 0, 0.0).when(q > 0, p * F.ln(p / q))
    return df.groupBy(by).agg(F.when(F.count_if(term.isNull()) == 0, F.sum(term)).alias("kl"))


def distribution_gap(a: DataFrame, b: DataFrame, value: str, n: int = 10, floor: float = 1e-6) -> DataFrame:
    """PSI over n equal bins of a's range, KS as the largest gap of the cumulated bins, and the gap of the means.

    Values outside are in the end bins. Without values on a side all three are null.
    """
    lim = a.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    both = a.select(value, F.lit(0).alias("s")).unionByName(b.select(value, F.lit(1).alias("s"))).filter(F.col(value).isNotNull()).join(F.broadcast(lim))
    place = F.greatest(F.least(bin_of(F.col(value), F.col("lo"), F.col("hi"), n), F.lit(n)), F.lit(1))
    counts = [F.count_if(F.col("s") == k).alias(f"c{x}") for k, x in enumerate("ab")]
    sums = [F.sum(F.when(F.col("s") == k, F.col(value))).alias(f"s{x}") for k, x in enumerate("ab")]
    bins = both.groupBy(place.alias("bin")).agg(*counts, *sums)
    every = Window.partitionBy()
    share = lambda c: F.try_divide(F.col(c), F.sum(c).over(every))
    p = bins.withColumns({"pa": share("ca"), "pb": share("cb")})
    upto = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    p = p.withColumn("gap", F.abs(F.sum("pa").over(upto) - F.sum("pb").over(upto)))
    fa, fb = F.greatest("pa", F.lit(floor)), F.greatest("pb", F.lit(floor))
    both_there = F.min(F.col("pa").isNotNull() & F.col("pb").isNotNull())
    psi = F.when(both_there, F.sum((fa - fb) * F.ln(fa / fb)))
    means = F.try_divide(F.sum("sb"), F.sum("cb")) - F.try_divide(F.sum("sa"), F.sum("ca"))
    return p.agg(psi.alias("psi"), F.max("gap").alias("ks"), means.alias("mean_gap"))


def drift(df: DataFrame, by: str, x: Column, y: str, tol: float) -> DataFrame:
    """Slope and fit of a line through each group, and whether the slope is within the tolerance."""
    r = df.withColumn("__x", x).groupBy(by).agg(
        F.regr_slope(y, "__x").alias("slope"), F.regr_r2(y, "__x").alias("r2"), F.corr(y, "__x").alias("corr")
    )
    return r.withColumn("ok", F.abs("slope") <= tol)


def fit_linear(df: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """Least-squares scale and offset of each group, and the root of the mean squared residual."""
    r = df.groupBy(by).agg(
        F.regr_slope(y, x).alias("scale"), F.regr_intercept(y, x).alias("offset"), F.regr_syy(y, x).alias("syy"),
        F.regr_sxy(y, x).alias("sxy"), F.regr_count(y, x).alias("n")
    )
    return r.select(
        by, "n", "scale", "offset",
        F.sqrt(F.greatest(F.col("syy") - F.col("scale") * F.col("sxy"), F.lit(0.0)) / F.col("n")).alias("residual")
    )


def quantise(df: DataFrame, key: str, vec: str, bits: int) -> DataFrame:
    """Symmetric codes of a vector by its largest magnitude: scale, largest and mean error after restoring."""
    v = F.transform(vec, lambda x: x.cast("double"))
    top = 2 ** (bits - 1) - 1
    s = df.select(key, v.alias("v")).withColumn("scale", F.array_max(F.transform("v", F.abs)) / top)
    code = F.transform("v", lambda x: F.floor(F.try_divide(x, F.col("scale")) + 0.5))
    err = F.zip_with("v", code, lambda x, c: F.abs(x - F.coalesce(c * F.col("scale"), F.lit(0.0))))
    return s.withColumn("e", err).select(
        key, "scale", F.array_max("e").alias("max_error"),
        (F.aggregate("e", F.lit(0.0), lambda a, x: a + x) / F.size("e")).alias("mean_error")
    )
