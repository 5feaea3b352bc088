"""Profiling, acceptance, cleaning, deduplication, redaction, splitting and scoring of collected data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from robolake.functions.columns import hash_mod, text_key
from robolake.functions.quantiles import percentiles
from robolake.operators import recursive


def profile(df: DataFrame, required: tuple[str, ...] = ()) -> DataFrame:
    """A row a column: rows, nulls, distinct values, smallest and largest as text, and whether a required column has nulls.

    Each column is read and counted by itself: exact distinct counts of several columns in one aggregation would send every row once a column.
    """

    def one(c: str) -> DataFrame:
        v, n_null = F.col("v"), F.count_if(F.col("v").isNull())
        counts = [F.count(F.lit(1)).alias("n_rows"), n_null.alias("n_null"), F.countDistinct(v).alias("n_distinct")]
        ends = [F.min(v).cast("string").alias("min_value"), F.max(v).cast("string").alias("max_value")]
        return df.select(F.col(c).alias("v")).agg(*counts, *ends).select(
            F.lit(c).alias("column"), "*", (F.lit(c in required) & (F.col("n_null") > 0)).alias("violated")
        )

    return reduce(DataFrame.unionByName, [one(c) for c in df.columns])


def accept_collection(df: DataFrame, by: str, rules: dict[str, Column], least_rate: float) -> DataFrame:
    """For each source how many rows meet all rules, their share, and whether it reaches least_rate."""
    good = reduce(lambda a, b: a & b, [F.coalesce(r, F.lit(False)) for r in rules.values()])
    rate = F.count_if(good) / F.count(F.lit(1))
    counts = [F.count_if(~F.coalesce(r, F.lit(False))).alias(f"fail_{name}") for name, r in rules.items()]
    passed = [F.count(F.lit(1)).alias("n"), F.count_if(good).alias("n_pass")]
    return df.groupBy(by).agg(*passed, *counts, rate.alias("pass_rate"), (rate >= least_rate).alias("accepted"))


def clean(df: DataFrame, text: str, size: Column, short: int = 50, symbols: float = 0.3, repeats: float = 0.5, z: float = 3.0) -> DataFrame:
    """Adds reason, the first of: null, empty, short, symbols, repeated, outlier; null if the row is clean.

    symbols: share of characters that are neither letters, digits nor white space; repeated: share of lines that repeat an earlier one. An outlier's
    size lies more than z sample deviations from the mean; without deviation there is none. Mean and deviation are one small row that is joined.
    """
    v = F.col(text)
    n = F.length(v)
    odd = F.regexp_count(v, F.lit(r"[^\p{L}\p{N}\s]")) / n
    lines = F.split(v, "\n")
    again = 1 - F.size(F.array_distinct(lines)) / F.size(lines)
    stats = df.agg(F.avg(size).alias("__m"), F.stddev_samp(size).alias("__d"))
    reason = (
        F.when(v.isNull(), "null").when(F.trim(v) == "", "empty").when(n < short, "short").when(odd > symbols, "symbols").when(again > repeats, "repeated")
        .when((F.col("__d") > 0) & (F.abs(size - F.col("__m")) > z * F.col("__d")), "outlier")
    )
    return df.join(F.broadcast(stats)).withColumn("reason", reason).drop("__m", "__d")


def iqr_outliers(df: DataFrame, by: str, value: str, k: float = 1.5) -> DataFrame:
    """Rows outside the quartiles by more than k times their distance, by group, of any number and size. A null group or value is none."""
    q = percentiles(df, (by,), value, {"q1": 0.25, "q3": 0.75}).select(by, "q1", "q3")
    q = q.withColumn("reach", k * (F.col("q3") - F.col("q1"))).withColumnRenamed(by, "__by")
    out = (F.col(value) < F.col("q1") - F.col("reach")) | (F.col(value) > F.col("q3") + F.col("reach"))
    return df.join(q, F.col(by) == F.col("__by")).filter(out).select(*df.columns, "q1", "q3")


def dedup_exact(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """The smallest id of each normalised text, with the number of its rows; an aggregate, so copies are summed before the shuffle."""
    return df.groupBy(text_key(F.col(text)).alias("key")).agg(F.min(id_col).alias(id_col), F.count(F.lit(1)).alias("copies"))


def balance(df: DataFrame, cls: str, id_col: str, cap: int | None = None) -> DataFrame:
    """At most cap rows a class, by the order of a hash of the id, then the id; cap is the smallest class unless given.

    No class is sorted: counts of the hash's first digits, 4096 a class, tell up to which of them all rows are taken, and only rows
    with the next one are ranked. Classes are few.
    """
    digest = F.md5(F.col(id_col).cast("string"))
    rows = df.withColumn("__h", digest).withColumn("__b", F.substring("__h", 1, 3))
    bins = rows.groupBy(F.col(cls).alias("__c"), F.col("__b").alias("__d")).agg(F.count(F.lit(1)).alias("__n"))
    sizes = bins.groupBy("__c").agg(F.sum("__n").alias("n"))
    limit = sizes.agg(F.min("n").alias("__cap")) if cap is None else sizes.limit(1).select(F.lit(cap).cast("long").alias("__cap"))
    before = F.sum("__n").over(Window.partitionBy("__c").orderBy("__d")) - F.col("__n")
    bins = bins.withColumn("__before", before).join(F.broadcast(limit)).filter("__before < __cap")
    taken = rows.join(F.broadcast(bins), F.col(cls).eqNullSafe(F.col("__c")) & (F.col("__b") == F.col("__d")))
    whole = taken.filter("__before + __n <= __cap").select(*df.columns)
    place = F.row_number().over(Window.partitionBy("__c").orderBy("__h", id_col))
    part = taken.filter("__before + __n > __cap").withColumn("__k", place).filter("__k <= __cap - __before")
    return whole.unionByName(part.select(*df.columns))


#: Kind -> pattern, in the order in which they are replaced.
PERSONAL = {
    "EMAIL": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "IP": r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b",
    "PHONE": r"\+?[0-9][0-9 ()-]{7,}[0-9]",
    "SECRET": r"(?:AKIA[A-Z0-9]{12,}|[0-9a-f]{32,})",
}
#: What every match of a rule holds; texts without it aren't gone over.
SIGNS = {"EMAIL": "@"}


def _if_signed(kind: str, text: str, found: Column, none: Column) -> Column:
    return F.when(F.contains(F.col(text), F.lit(SIGNS[kind])), found).otherwise(none) if kind in SIGNS else found


def redact(df: DataFrame, text: str, rules: dict[str, str] = PERSONAL) -> DataFrame:
    """text with each match of each rule in turn replaced by the rule's name in angle brackets."""
    for kind, pattern in rules.items():
        df = df.withColumn(text, _if_signed(kind, text, F.regexp_replace(text, pattern, f"<{kind}>"), F.col(text)))
    return df


def redaction_report(df: DataFrame, text: str, by: str, rules: dict[str, str] = PERSONAL) -> DataFrame:
    """Matches of each rule in the unchanged texts, by group and kind."""
    none = F.lit(0)
    found = {kind: _if_signed(kind, text, F.coalesce(F.regexp_count(text, F.lit(p)), none), none) for kind, p in rules.items()}
    counts = df.groupBy(by).agg(*[F.sum(c).alias(kind) for kind, c in found.items()])
    return counts.unpivot(by, list(rules), "kind", "n")


def pseudonymise(df: DataFrame, cols: tuple[str, ...], salt: str) -> DataFrame:
    return df.withColumns({c: F.when(F.col(c).isNotNull(), F.sha2(F.concat(F.lit(salt), F.col(c).cast("string")), 256)) for c in cols})


def small_groups(df: DataFrame, cols: tuple[str, ...], k: int) -> DataFrame:
    """Combinations of identifying columns that fewer than k rows share."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") < k)


def split(df: DataFrame, id_col: str, train: int = 80, val: int = 90) -> DataFrame:
    """Adds split by the hash of the id modulo 100: train below train, val below val, else test."""
    h = hash_mod(F.col(id_col), 100)
    return df.withColumn("split", F.when(h < train, "train").when(h < val, "val").otherwise("test"))


def manifest(df: DataFrame, cls: str) -> DataFrame:
    """Rows of each class in each split."""
    return df.groupBy(cls).pivot("split", ["train", "val", "test"]).agg(F.count(F.lit(1))).na.fill(0, ["train", "val", "test"])


def leakage(train: DataFrame, held_out: DataFrame, text: str, held_text: str, id_col: str) -> DataFrame:
    """Training rows that hold a whole line of the held-out texts, with how many. Lines are compared by digest of their normal form; short ones don't count."""
    line = lambda c: F.explode(F.split(c, "\n"))
    held = held_out.select(line(held_text).alias("l")).filter(F.length("l") >= 40).select(text_key(F.col("l")).alias("k")).distinct()
    lines = train.select(id_col, line(text).alias("l")).filter(F.length("l") >= 40).select(id_col, text_key(F.col("l")).alias("k"))
    return lines.join(held, "k", "left_semi").groupBy(id_col).agg(F.countDistinct("k").alias("n_lines"))


def harmonise(frames: list[DataFrame], mappings: list[dict[str, str]]) -> DataFrame:
    """Frames of different columns as one; mappings name the columns each has, missing ones are null."""
    named = [f.select(*[F.expr(e).alias(c) for c, e in m.items()]) for f, m in zip(frames, mappings, strict=True)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def rank_weighted(df: DataFrame, key: str, weights: dict[str, float], name: str = "total") -> DataFrame:
    """Weighted sum of columns over the sum of weights, and its dense rank; equal totals share one. One row a key, so the global window is small."""
    total = reduce(lambda a, b: a + b, [F.col(c) * w for c, w in weights.items()]) / sum(weights.values())
    return df.select(key, F.round(total, 6).alias(name)).withColumn("rank", F.dense_rank().over(Window.orderBy(F.desc(name))).cast("long"))


def score(df: DataFrame, features: dict[str, tuple[Column, float]]) -> DataFrame:
    """Adds score, 0 to 100, the weighted mean of features from 0 to 1, and flagged if one is null, which counts as 0."""
    total = reduce(lambda a, b: a + b, [F.coalesce(f, F.lit(0.0)) * w for f, w in features.values()])
    flagged = reduce(lambda a, b: a | b, [f.isNull() for f, _ in features.values()])
    return df.withColumns({"score": 100 * total / sum(w for _, w in features.values()), "flagged": flagged})


def agreement(df: DataFrame, predicted: str, gold: str) -> DataFrame:
    """Precision and recall of a boolean against a gold boolean."""
    tp = F.count_if(F.col(predicted) & F.col(gold))
    wrong = [F.count_if(F.col(predicted) & ~F.col(gold)).alias("fp"), F.count_if(~F.col(predicted) & F.col(gold)).alias("fn")]
    rates = [F.try_divide(tp, F.count_if(c)).alias(n) for c, n in ((predicted, "precision"), (gold, "recall"))]
    return df.agg(F.count(F.lit(1)).alias("n"), tp.alias("tp"), *wrong, *rates)


def augment(df: DataFrame, id_col: str, value: str, n: int, spread: float, seed: int) -> DataFrame:
    """n variants of each row: the value times 1 + spread * u, u from -1 to 1 by a hash of seed, id and variant."""
    v = df.select(id_col, value, F.explode(F.sequence(F.lit(1).cast("long"), F.lit(n).cast("long"))).alias("variant"))
    u = hash_mod(F.concat_ws(":", F.lit(seed), F.col(id_col), F.col("variant")), 2001) / 1000 - 1
    return v.withColumn("augmented", F.col(value) * (1 + spread * u))


def staged(df: DataFrame, stages: list[tuple[str, Column]], path: str) -> list[tuple[str, int, int, int]]:
    """Put rows through rules in order while they are written, and count on the way: for each stage its name, and how many rows came, stayed and were rejected.

    A row goes to the folder of the first stage whose rule it doesn't meet (null doesn't), below path as ``stage=name``, or to ``stage=kept``. The counts are metrics that the
    writing job observes, so the input is read once and the output not at all.
    """
    failed = F.coalesce(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in stages], F.lit("kept"))
    seen = Observation()
    counts = [F.count_if(F.col("stage") == name).alias(f"n{k}") for k, (name, _) in enumerate(stages)]
    df.withColumn("stage", failed).observe(seen, F.count(F.lit(1)).alias("n"), *counts).write.partitionBy("stage").parquet(path)
    n, out = seen.get["n"], []
    for k, (name, _) in enumerate(stages):
        rejected = seen.get[f"n{k}"]
        out.append((name, n, n - rejected, rejected))
        n -= rejected
    return out


def new_rows(source: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't among those done."""
    return source.join(done.select(key).distinct(), key, "left_anti")


def pack_turns(df: DataFrame, key: str, order: str, size: Column, budget: int) -> DataFrame:
    """Ordered sequences cut into parts of at most budget: a step that would pass it begins the next part; a longer step has its own.

    Where a part begins depends on all steps before, so each task walks over its sorted rows once and keeps one part's size.
    """

    def step(state: tuple, n: float) -> tuple[tuple, tuple]:
        part, full = state
        state = (part, full + n) if full is not None and full + n <= budget else (0 if full is None else part + 1, n)
        return state, (float(state[0]),)

    sized = df.select(key, order, "role", size.alias("size"), size.alias("__n"))
    parts = recursive.scan(sized, key, (order, "role", "size"), "__n", lambda: (0, None), step, ("part",))
    roles = F.transform(F.sort_array(F.collect_list(F.struct(order, "role"))), lambda s: s["role"])
    sums = [F.count(F.lit(1)).alias("n_steps"), F.sum("size").alias("size"), F.array_join(roles, ">").alias("roles")]
    return parts.groupBy(key, F.col("part").cast("long").alias("part")).agg(*sums)


def hard_cases(train: DataFrame, failed: DataFrame, cls: str, base: float = 1.0, step: float = 0.5) -> DataFrame:
    """Sampling weight of each class: base, and step times its share of the failures more; without failures all are base."""
    f = failed.groupBy(cls).agg(F.count(F.lit(1)).alias("n_failed"))
    n = F.coalesce(F.col("n_failed"), F.lit(0))
    share = F.coalesce(F.try_divide(n, F.sum(n).over(Window.partitionBy())), F.lit(0.0))
    every = train.groupBy(cls).agg(F.count(F.lit(1)).alias("n")).join(f, cls, "left")
    return every.select(cls, "n", n.cast("long").alias("n_failed"), (base + step * share).alias("weight"))
