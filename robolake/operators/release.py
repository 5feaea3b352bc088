"""Contracts, degradation, fault cases, canaries, error budgets, and acceptance with evidence and report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from robolake.functions.columns import worst
from robolake.functions.slices import GHOST, HOT, SLICE, carried, sliced, upto

VERDICT = ("PASS", "WATCH", "ROLLBACK")
ACCEPT = ("PASS", "YELLOW", "FAIL")


def contract_audit(df: DataFrame, domains: dict[str, Column], refs: dict[str, tuple[str, DataFrame, str]]) -> DataFrame:
    """Rows that break each rule: domain rules (null breaks them) in one aggregation, references by anti-join."""
    counts = df.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in domains.items()])
    out = counts.unpivot([], list(domains), "rule", "n_violations")
    for name, (c, other, key) in refs.items():
        lost = df.filter(F.col(c).isNotNull()).join(other.select(F.col(key).alias(c)).distinct(), c, "left_anti")
        out = out.unionByName(lost.agg(F.lit(name).alias("rule"), F.count(F.lit(1)).alias("n_violations")))
    return out


def type_audit(df: DataFrame, expected: dict[str, str]) -> list[tuple[str, str, str | None]]:
    """Columns whose type isn't the expected one: name, expected, found (None: missing)."""
    have = dict(df.dtypes)
    return [(c, t, have.get(c)) for c, t in expected.items() if have.get(c) != t]


def type_violations(df: DataFrame, rules: dict[str, tuple[Column, str]]) -> DataFrame:
    """For each rule, a column and the type that its texts should have: how many values there are, and how many can't be read as that type. Nulls are none."""
    n = [F.count(c).alias(f"n{k}") for k, (c, _) in enumerate(rules.values())]
    bad = [F.count_if(c.isNotNull() & c.try_cast(t).isNull()).alias(f"b{k}") for k, (c, t) in enumerate(rules.values())]
    one = lambda k, name: F.struct(F.lit(name).alias("rule"), F.col(f"n{k}").alias("n_values"), F.col(f"b{k}").alias("n_violations"))
    return df.agg(*n, *bad).select(F.explode(F.array(*[one(k, name) for k, name in enumerate(rules)])).alias("r")).select("r.*")


def degrade(df: DataFrame, key: str, us: str, tie: str, bad: Column, warn: int, stop: int, hot: int = HOT) -> DataFrame:
    """State after each row: by the errors in a row so far, NORMAL below warn, DEGRADED below stop, else STOPPED; a good row resets.

    Errors in a row are the rows since the last good one. In a slice of a hot key without a good row yet, that one lies in an earlier slice.
    """
    rows = sliced(df.withColumn("__bad", bad.cast("long")), (key,), us, hot)
    w = Window.partitionBy(key, SLICE).orderBy(us, tie)
    rows = upto(rows, (key,), {"__rows": F.lit(1)}).withColumn("__k", F.row_number().over(w) + F.coalesce("__rows", F.lit(0)))
    good = F.when(F.col("__bad") == 0, F.col("__k"))
    rows = upto(rows, (key,), tops={"__g0": good})
    last = F.greatest("__g0", F.max(good).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    n = (F.col("__k") - F.coalesce(last, F.lit(0))).cast("long")
    state = F.when(F.col("errors_in_a_row") >= stop, "STOPPED").when(F.col("errors_in_a_row") >= warn, "DEGRADED").otherwise("NORMAL")
    return rows.withColumn("errors_in_a_row", n).withColumn("state", state).select(*df.columns, "errors_in_a_row", "state")


def replay_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one run that the other lacks, as multisets, with the side."""
    return a.exceptAll(b).withColumn("side", F.lit("only_a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("only_b")))


def replay_keys(a: DataFrame, b: DataFrame, key: str, cols: tuple[str, ...]) -> DataFrame:
    """For each key the rows of both runs and whether they are the same multiset, null equal to null.

    Equal rows of a key are counted up by one run and down by the other; the runs are the same if no count is left. Aggregates alone, so no key is gathered.
    """
    one = lambda df, n: df.select(F.col(key).alias("k"), F.struct(*cols).alias("row"), F.lit(n).alias("run"))
    n_a, n_b = F.count_if(F.col("run") == 1).alias("n_a"), F.count_if(F.col("run") == -1).alias("n_b")
    counts = one(a, 1).unionByName(one(b, -1)).groupBy("k", "row").agg(n_a, n_b)
    same = F.bool_and(F.col("n_a") == F.col("n_b")).alias("same")
    return counts.groupBy(F.col("k").alias(key)).agg(F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"), same)


def case_stats(df: DataFrame, key: str, cause: str, us: str, tie: str, within: int, hot: int = HOT) -> DataFrame:
    """By cause: cases, share of all, and share that the same key has again within the time.

    Whether a case comes again is asked of the later one: how long ago the one before it was.
    """
    keys = (key, cause)
    rows = carried(sliced(df.select(key, cause, us, tie), keys, us, hot), keys, (us, tie), 1)
    again = F.col(us) - F.lag(us).over(Window.partitionBy(*keys, SLICE).orderBy(us, tie)) <= within
    c = rows.withColumn("__again", F.coalesce(again, F.lit(False))).filter(~F.col(GHOST))
    c = c.groupBy(cause).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("__again").cast("double")).alias("recurrence"))
    return c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def health(df: DataFrame, us: str, step: int, bad: Column, n: int, margin: float) -> DataFrame:
    """Bad rate of each bucket, its mean over the n buckets before, and an alert if it is above that by more than margin."""
    b = df.groupBy((F.floor(F.col(us) / step) * step).cast("long").alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(bad.cast("double")).alias("rate")
    )
    base = F.avg("rate").over(Window.orderBy("bucket").rowsBetween(-n, -1))
    return b.withColumn("baseline", base).withColumn("alert", F.coalesce(F.round(F.col("rate") - F.col("baseline") - margin, 9) > 0, F.lit(False)))


def canary(df: DataFrame, by: str, version: str, base: str, cand: str, bad: Column, t1: float, t2: float, least: int) -> DataFrame:
    """Candidate's bad rate minus the baseline's: up to t1 PASS, up to t2 WATCH, else ROLLBACK; fewer than ``least`` rows on a side are WATCH."""
    of = lambda v: F.count_if(F.col(version) == v)
    hit = lambda v: F.count_if((F.col(version) == v) & bad)
    c = df.groupBy(by).agg(of(base).alias("nb"), hit(base).alias("kb"), of(cand).alias("nc"), hit(cand).alias("kc"))
    d = F.round(F.try_divide("kc", "nc") - F.try_divide("kb", "nb"), 9)
    level = F.when((F.col("nb") < least) | (F.col("nc") < least), 1).when(d <= t1, 0).when(d <= t2, 1).otherwise(2)
    return c.select(by, "nb", "nc", d.alias("delta"), worst(level, VERDICT).alias("verdict"))


def rollback_point(df: DataFrame, bucket: str, verdict: Column) -> DataFrame:
    """The first bucket to roll back and the last good one before it. Both are aggregates: no rows are sorted."""
    r = df.select(bucket, verdict.alias("v"))
    first = r.filter(F.col("v") == VERDICT[2]).agg(F.min(bucket).alias("rollback"))
    good = F.when((F.col("v") == VERDICT[0]) & (F.col(bucket) < F.col("rollback")), F.col(bucket))
    return r.join(F.broadcast(first)).groupBy("rollback").agg(F.max(good).alias("last_good"))


def error_budget(df: DataFrame, us: str, step: int, failed: Column, slo: float) -> DataFrame:
    """Failures of each bucket, spent so far, share of the whole budget (1 - slo) * n, and whether it is used up."""
    b = df.groupBy((F.floor(F.col(us) / step) * step).cast("long").alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(failed).alias("failures")
    )
    spent = F.sum("failures").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    whole = (1 - slo) * F.sum("n").over(Window.partitionBy())
    return b.withColumns({"spent": spent, "burn": F.try_divide(spent, whole)}).withColumn("exhausted", F.col("burn") > 1)


def incident_review(tickets: DataFrame, df: DataFrame, key: str, us: str, value: str, before: int, after: int) -> DataFrame:
    """Mean of a value in a time before, during and after each ticket (first_us, last_us). Rows and tickets meet by key and slice of time, so a key is not one group."""
    width = max(before, after, 1)
    t = tickets.withColumn("__s", F.explode(F.sequence(F.floor((F.col("first_us") - before) / width), F.floor((F.col("last_us") + after) / width))))
    rows = df.select(key, us, value).withColumn("__s", F.floor(F.col(us) / width))
    at, begin, end = F.col(us), F.col("first_us"), F.col("last_us")
    near = t.join(rows, [key, "__s"]).filter((at >= begin - before) & (at <= end + after))
    of = lambda c: F.avg(F.when(c, F.col(value)))
    means = [of(at < begin).alias("before"), of((at >= begin) & (at <= end)).alias("during"), of(at > end).alias("after")]
    return near.groupBy(key, "ticket").agg(*means)


def acceptance(df: DataFrame, metrics: dict[str, tuple[float, float]]) -> DataFrame:
    """df has entity, metric, value. Each metric against (lo, hi): at least hi PASS, at least lo YELLOW, else or missing FAIL; overall the worst."""
    limits = df.sparkSession.createDataFrame([(m, *v) for m, v in metrics.items()], "metric string, lo double, hi double")
    every = df.select("entity").distinct().join(F.broadcast(limits))
    r = every.join(df, ["entity", "metric"], "left")
    level = F.when(F.col("value") >= F.col("hi"), 0).when(F.col("value") >= F.col("lo"), 1).otherwise(2)
    counts = [F.count_if(level == k).alias(n) for k, n in enumerate(("n_pass", "n_yellow", "n_fail"))]
    return r.groupBy("entity").agg(*counts, worst(F.max(level), ACCEPT).alias("verdict"))


#: Values of the order column that one link of a chain of evidence covers.
LINK = 10_000


def framed(text: Column) -> Column:
    """A text with its length before it, null as a sign of its own: joined, such fields tell where each begins."""
    return F.coalesce(F.concat(F.char_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def evidence(df: DataFrame, entity: str, row: tuple[str, ...], order: str, link: int = LINK) -> DataFrame:
    """For each entity the rows behind its verdict and a chain of digests: one over the digests, in order, of the links' digests.

    Fields are joined with their lengths, so different rows have different texts; row should name all columns that the verdict comes from. A link covers
    ``link`` values of the order column, a number that no two rows of an entity share, and digests its rows' digests in order.
    So what is gathered at once is a link, or a digest a link of an entity.
    """
    h = F.sha2(F.concat(*[framed(F.col(c).cast("string")) for c in row]), 256)
    rows = df.select(entity, F.floor(F.col(order) / link).alias("__l"), F.col(order).alias("__o"), h.alias("h"))
    joined = lambda o: F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(o, "h"))), lambda x: x["h"]), ""), 256)
    links = rows.groupBy(entity, "__l").agg(F.count(F.lit(1)).alias("n"), joined("__o").alias("h"))
    return links.groupBy(entity).agg(F.sum("n").alias("n_rows"), joined("__l").alias("chain"))


def source_rows(verdicts: DataFrame, df: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """Each verdict joined back to the rows that it was made from."""
    return df.select(key, *columns).join(verdicts.select(key, "verdict"), key)


def report_md(verdicts: DataFrame, title: str) -> DataFrame:
    """Lines of a Markdown report with a table of verdicts and room for signatures: line number and text.

    A report is for readers: its verdicts, thousands at most, are numbered in one task.
    """
    cols = verdicts.columns
    head = [f"# {title}", "", "| " + " | ".join(cols) + " |", "|" + " --- |" * len(cols)]
    foot = ["", "## Sign-off", "", "| Role | Name | Date |", "| --- | --- | --- |", "| Test |  |  |", "| Release |  |  |"]
    cells = F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])
    place = F.row_number().over(Window.orderBy(*cols)).cast("long") + len(head)
    body = verdicts.select(place.alias("line"), F.concat(F.lit("| "), cells, F.lit(" |")).alias("text"))
    fixed = verdicts.sparkSession.createDataFrame(
        [(i + 1, t) for i, t in enumerate(head)] + [(1 << 40 | i, t) for i, t in enumerate(foot)], "line long, text string"
    )
    return body.unionByName(fixed).select(F.row_number().over(Window.orderBy("line")).cast("long").alias("line"), "text")


def write_report(report: DataFrame, path: str) -> None:
    """The report as one text file below path."""
    report.coalesce(1).sortWithinPartitions("line").select("text").write.mode("overwrite").text(path)


def gate_board(df: DataFrame, entity: str, gates: list[tuple[str, Column]]) -> DataFrame:
    """The highest gate passed with all before it; null if the first is missed."""
    passed = df.groupBy(entity).agg(*[F.coalesce(c, F.lit(False)).alias(f"g{i}") for i, (_, c) in enumerate(gates)])
    n, ok = F.lit(0), F.lit(True)
    for i in range(len(gates)):
        ok = ok & F.col(f"g{i}")
        n = n + ok.cast("int")
    gate = F.when(n > 0, F.element_at(F.array(*[F.lit(g) for g, _ in gates]), F.greatest(n, F.lit(1))))
    return passed.select(entity, n.cast("long").alias("n_gates"), gate.alias("gate"))
