"""Near-duplicate texts by their sets of tokens: counted by families of close ones rather than pair by pair, or listed.

The Jaccard distance is a metric. So two sets within half the distance threshold of one representative are similar for certain, and need not meet:
a family is a representative and such sets, and all of a family are linked with each other. Between families the distance of the representatives and
those of the members from them decide most cases: below, every member of a shell (members of equal distance) is linked with every one of another; above, none
is. Only what the triangle inequality leaves open is compared set by set. Representatives meet by a prefix filter on their rarest tokens.
similar_pairs() lists the links all the same, with their similarities: there all linked sets are compared, in blocks of a family.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from robolake.functions.scratch import Rounds, configured
from robolake.operators import ledger

#: Rounds in which sets look for a representative; those left over are their own.
ROUNDS = 3
#: Sets and tokens of a block of a family, about: blocks are what is paired.
BLOCK, BLOCK_TOKENS = 256, 1 << 16
#: Hash buckets in which tokens are counted for their order.
SKETCH = 1 << 20
#: Bits of a set's bitmap at least; it has two for each token, and their number is a power of two.
BITS = 1024
#: Every step is written: its shuffle files can go at once, not when the driver next collects garbage. Arrow batches are bounded by bytes.
SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}
#: Far above the error of a distance in doubles, far below the difference of two.
SLACK = 1e-9


def token_sets(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """Each text's distinct white-space tokens, as 64-bit hashes, and a digest of the tokens themselves; texts without tokens have none."""
    tokens = F.sort_array(F.array_distinct(F.array_remove(F.split(text, r"\s+"), "")))
    # by what the text holds: a filter on the tokens would take them twice
    rows = df.filter(F.col(text).rlike(r"\S")).select(F.col(id_col).alias("id"), tokens.alias("tokens"))
    named = rows.withColumn("set", F.unhex(F.sha2(F.array_join("tokens", " "), 256)))
    return named.withColumn("tokens", F.transform("tokens", lambda t: F.xxhash64(t)))


def _distinct(df: DataFrame, id_col: str, text: str, rounds: Rounds) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The texts (id, set); set, id, copies of the distinct sets; and id, tokens, n, copies of those that an id stands for, in buckets by id."""
    with Rounds(df.sparkSession) as parsed:
        rows = parsed.written(token_sets(df, id_col, text).withColumn("row", F.monotonically_increasing_id()))
        texts = rounds.written(rows.select("id", "set"))
        first = rows.groupBy("set").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("f"), F.count(F.lit(1)).alias("copies"))
        first = rounds.written(first.select("set", "f.id", F.col("f.row").alias("least"), "copies"))
        # rows of a repeated id are told apart by a difference: by equality they would be a part of the key, and the join not one by id
        sets = rows.drop("set").join(first.drop("set"), "id").filter(F.col("row") - F.col("least") == 0)
        sets = rounds.bucketed(sets.select("id", "tokens", F.size("tokens").alias("n"), "copies"), "id")
        return texts, first.select("set", "id", "copies"), sets


def _common(pairs: DataFrame, sets: DataFrame, x: str, y: str) -> DataFrame:
    """pairs with nx, ny and c, the sizes of both sets and of what they share."""
    side = lambda i, s: sets.select(F.col("id").alias(i), F.col("tokens").alias(f"t{s}"), F.col("n").alias(f"n{s}"))
    both = pairs.drop("nx", "ny").join(side(x, "x"), x).join(side(y, "y"), y)
    # as a row of its own, c is counted once; a filter on a column would count it again
    names = [*(c for c in pairs.columns if c not in ("nx", "ny")), "nx", "ny"]
    return both.select(*names, F.explode(F.array(F.size(F.array_intersect("tx", "ty")))).alias("c"))


def _close(pairs: DataFrame, postings: DataFrame, x: str, y: str, least: Column) -> DataFrame:
    """Those of pairs whose similarity may reach least: two sets differ in as many tokens at least as their bitmaps in bits.

    The longer bitmap is folded to the length of the shorter one, which is the bitmap that its tokens would have at that length.
    """
    side = lambda i, s: postings.select(F.col("id").alias(i), F.col("n").alias(f"n{s}"), F.col("bits").alias(f"b{s}"))
    words = F.least(F.size("bx"), F.size("by"))

    def folded(b: Column) -> Column:
        part = lambda j: F.slice(b, j * words + 1, words)
        times = F.sequence(F.lit(1), (F.size(b) / words).cast("int") - 1)
        return F.when(F.size(b) == words, b).otherwise(F.aggregate(times, part(F.lit(0)), lambda all_, j: F.zip_with(all_, part(j), lambda p, q: p.bitwiseOR(q))))

    short = sum((F.bit_count(F.col("bx")[i].bitwiseXOR(F.col("by")[i])) for i in range(BITS // 64)), F.lit(0))
    apart = F.zip_with(folded(F.col("bx")), folded(F.col("by")), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    long = F.aggregate(apart, F.lit(0), lambda total, n: total + n)
    differ = F.when((F.size("bx") == BITS // 64) & (F.size("by") == BITS // 64), short).otherwise(long)
    both = pairs.join(side(x, "x"), x).join(side(y, "y"), y)
    return both.filter(differ <= (F.col("nx") + F.col("ny")) * (1 - least) / (1 + least) + 1e-6).select(*pairs.columns, "nx", "ny")


def _in_parts(pairs: DataFrame, sets: DataFrame, rounds: Rounds, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """step(pairs) written part by part, so that the tokens that travel with one part's pairs are no more than about half of all sets'."""
    moved, held = pairs.agg(F.sum("nx")).first()[0] or 0, sets.agg(F.sum("n")).first()[0] or 1
    parts = 1 + 2 * moved // held
    part = F.pmod(F.xxhash64("x", "y"), F.lit(parts))
    done = [rounds.written(step(pairs.filter(part == i))) for i in range(parts)]
    return reduce(DataFrame.unionByName, done)


def _distance() -> Column:
    return 1 - F.col("c") / (F.col("nx") + F.col("ny") - F.col("c"))


def _prefix(share: Column) -> Column:
    """How many of a set's rarest tokens one of them must be shared with any set of at least that similarity."""
    return (F.col("n") - F.ceil(F.col("n") * share - SLACK) + 1).cast("int")


def _postings(sets: DataFrame, rounds: Rounds, longest: float) -> DataFrame:
    """id, n, a bitmap of the tokens, and the tokens t of the longest prefix in their order; before them stand skip tokens that no other set has.

    The order of all tokens is by the count of their hash bucket, then by themselves. Any order would be right; this one puts frequent tokens last.
    A table of the buckets' counts, on a scale of logarithms, is a byte for each bucket, however many tokens there are.
    """
    bucket = F.col("t").bitwiseAND(F.lit(SKETCH - 1)).cast("int").alias("b")
    counts = sets.select(F.explode("tokens").alias("t")).groupBy(bucket).agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    found = counts.select("b", F.least(F.floor(F.log2("m") * 4), F.lit(255)).cast("int").alias("level")).toArrow()
    levels = np.zeros(SKETCH, np.uint8)
    levels[found["b"].to_numpy()] = found["level"].to_numpy()

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch["tokens"]
            n, flat = batch["n"].to_numpy().astype(np.int64), tokens.flatten().to_numpy()
            starts = np.cumsum(n) - n
            row = np.repeat(np.arange(len(n)), n)
            level = levels[flat & (SKETCH - 1)]
            order = np.lexsort((flat, level, row))
            reach = n - np.ceil(n * longest - SLACK).astype(np.int64) + 1
            keep = (np.arange(len(flat)) - starts[row] < reach[row]) & (level[order] > 0)
            lengths = np.bincount(row[keep], minlength=len(n))
            skip = np.bincount(row[level == 0], minlength=len(n))
            offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
            t = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat[order][keep]))
            size = BITS << np.ceil(np.log2(np.maximum(2 * n / BITS, 1))).astype(np.int64)
            ends = np.cumsum(size // 64)
            bits = np.zeros(ends[-1] if len(n) else 0, np.uint64)
            place = (flat >> 32) & (size[row] - 1)
            np.bitwise_or.at(bits, (ends - size // 64)[row] + (place >> 6), np.left_shift(np.uint64(1), (place & 63).astype(np.uint64)))
            b = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(bits.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch["id"], batch["n"], b, pa.array(skip.astype(np.int32)), t], ["id", "n", "bits", "skip", "t"])

    kind = sets.schema["id"].dataType.simpleString()
    return rounds.written(sets.select("id", "n", "tokens").mapInArrow(prefixes, f"id {kind}, n int, bits array<bigint>, skip int, t array<bigint>"))


def _listed(postings: DataFrame, reach: Column, *cols: str) -> DataFrame:
    """(t, id, n, k and cols): a row for each token of the prefixes that reach so far, k its place."""
    near = F.slice("t", 1, F.greatest(reach - F.col("skip"), F.lit(0)))
    rows = postings.select("id", "n", "skip", *cols, F.posexplode(near).alias("p", "token"))
    return rows.select(F.col("token").alias("t"), "id", "n", (F.col("skip") + F.col("p") + 1).alias("k"), *cols)


def _families(sets: DataFrame, postings: DataFrame, rounds: Rounds, percent: int) -> DataFrame:
    """(id, root, d) for each set: its representative, within half the threshold, and the distance from it; alone it is its own.

    In a round each token of a prefix names the set of smallest hash that has it; a set joins the first of those named by its tokens that are close enough and
    don't join one themselves. A set that others have joined stays a representative.
    """
    close = (100 + percent) / 200
    near = postings.withColumn("t", F.slice("t", 1, F.greatest(_prefix(F.lit(close)) - F.col("skip"), F.lit(0)))).filter(F.size("t") > 0)
    near = rounds.written(near.drop("bits"))
    joined = rounds.written(sets.limit(0).select("id", F.col("id").alias("root"), F.lit(0.0).alias("d")))
    for r in range(ROUNDS):
        roots = joined.select(F.col("root").alias("id")).distinct().withColumn("old", F.lit(True))
        free = near.join(joined.select("id"), "id", "left_anti").join(roots, "id", "left").withColumn("old", F.coalesce("old", F.lit(False)))
        free = free.select("id", "n", "old", "skip", F.posexplode("t").alias("p", "t")).withColumn("k", F.col("skip") + F.col("p") + 1)
        free = free.withColumn("order", F.struct((~F.col("old")).alias("new"), F.xxhash64("id", F.lit(r)).alias("h"), "id"))
        named = free.groupBy("t").agg(F.min(F.struct("order", "n", "k")).alias("m"))
        size = F.least("n", "m.n") >= F.greatest("n", "m.n") * close - SLACK
        size &= (F.least(F.col("n") - F.col("k"), F.col("m.n") - F.col("m.k")) + 1) * (1 + close) >= (F.col("n") + F.col("m.n")) * close - SLACK
        found = free.filter(~F.col("old")).join(named, "t").filter((F.col("m.order.id") != F.col("id")) & size)
        found = rounds.written(found.select("id", F.col("m.order.id").alias("root"), F.col("m.order").alias("order")).distinct())
        found = rounds.written(_close(found, postings, "id", "root", F.lit(close)))
        enough = F.col("c") * 200 >= (F.col("nx") + F.col("ny") - F.col("c")) * (100 + percent)
        found = rounds.written(_common(found, sets, "id", "root").filter(enough).select("id", "root", "order", _distance().alias("d")))
        stay = found.join(found.select(F.col("id").alias("root")).distinct(), "root", "left_anti")
        new = rounds.written(stay.groupBy("id").agg(F.min(F.struct("order", "root", "d")).alias("b")).select("id", "b.root", "b.d"))
        if new.isEmpty():
            break
        joined = rounds.written(joined.unionByName(new))
    alone = sets.select("id").join(joined.select("id"), "id", "left_anti").select("id", F.col("id").alias("root"), F.lit(0.0).alias("d"))
    return rounds.written(joined.unionByName(alone))


def _root_pairs(sets: DataFrame, postings: DataFrame, roots: DataFrame, percent: int, rounds: Rounds | None = None) -> DataFrame:
    """Pairs x, y of representatives, each once, whose families may hold a link: they are no farther from each other than threshold and both radii."""
    far, widest = 1 - percent / 100, roots.agg(F.max("rho")).first()[0] or 0.0
    written = rounds.written if rounds else lambda df: df
    heads = written(postings.drop("bits").join(roots.select("id", "rho"), "id").withColumn("single", F.col("rho") == 0))
    side = lambda df, i: df.select("t", *[F.col(c).alias(f"{c}{i}") for c in df.columns if c != "t"])
    rho = lambda i: F.col(f"rho{i}")

    def fits(least: Column) -> Column:
        sized = F.least("nx", "ny") >= F.greatest("nx", "ny") * least
        return sized & ((F.least(F.col("nx") - F.col("kx"), F.col("ny") - F.col("ky")) + 1) * (1 + least) >= (F.col("nx") + F.col("ny")) * least)

    base = _listed(heads.filter("single"), _prefix(F.lit(1 - far)))
    wide = lambda which: _listed(heads.filter(which), _prefix(1 - far - widest - F.col("rho")), "rho")
    alone = side(base, "x").join(side(base, "y"), "t").filter((F.col("idx") < F.col("idy")) & fits(F.lit(1 - far - SLACK)))
    alone = alone.select(F.col("idx").alias("x"), F.col("idy").alias("y"), F.lit(0.0).alias("rhox"), F.lit(0.0).alias("rhoy")).distinct()
    mixed = side(wide("not single"), "x").join(side(wide("true"), "y"), "t").filter((F.col("idx") != F.col("idy")) & ((rho("y") == 0) | (F.col("idx") < F.col("idy"))))
    mixed = mixed.filter(fits(1 - far - rho("x") - rho("y") - SLACK)).select(F.col("idx").alias("x"), F.col("idy").alias("y"), "rhox", "rhoy").distinct()
    least = 1 - far - F.col("rhox") - F.col("rhoy")
    pairs = written(_close(written(alone).unionByName(written(mixed)), postings, "x", "y", least))

    def met(some: DataFrame) -> DataFrame:
        near = _common(some, sets, "x", "y").withColumn("d", _distance())
        return near.filter(F.col("d") <= far + F.col("rhox") + F.col("rhoy") + SLACK).select("x", "y", "nx", "ny", "c", "d")

    return _in_parts(pairs, sets, rounds, met) if rounds else met(pairs)


def _both_ways(df: DataFrame, x: tuple[str, ...], y: tuple[str, ...], keys: tuple[str, ...]) -> DataFrame:
    """Rows of df as what the y side gives to x and the x side to y: keys, and the sums n_sets, n_copies and least over a key."""
    one = lambda a, b, s: df.select(*[F.col(c).alias(k) for c, k in zip(a, keys, strict=True)], *[F.col(f"{c}{s}").alias(c) for c in ("n_sets", "n_copies", "least")])
    every = one(x, y, "y").unionByName(one(y, x, "x"))
    return every.groupBy(*keys).agg(F.sum("n_sets").alias("n_sets"), F.sum("n_copies").alias("n_copies"), F.min("least").alias("least"))


def _met(df: DataFrame, id_col: str, text: str, percent: int, rounds: Rounds) -> tuple[DataFrame, ...]:
    """Texts, distinct sets and the sets with tokens as _distinct() gives them, the members of families, the families with their radius rho, and the
    pairs of families that may hold links."""
    texts, known, sets = _distinct(df, id_col, text, rounds)
    postings = _postings(sets, rounds, 1 - 2 * (1 - percent / 100))
    member = rounds.written(_families(sets, postings, rounds, percent).join(sets.select("id", "copies"), "id"))
    families = rounds.written(member.groupBy("root").agg(*_sums(), F.max("d").alias("rho")))
    met = _root_pairs(sets, postings, families.select(F.col("root").alias("id"), "rho"), percent, rounds)
    return texts, known, sets, member, families, met


def _sums() -> list[Column]:
    return [F.count(F.lit(1)).alias("n_sets"), F.sum("copies").alias("n_copies"), F.min("id").alias("least")]


def similar_sets(df: DataFrame, id_col: str, text: str, percent: int, rounds: Rounds) -> tuple[DataFrame, DataFrame]:
    """The texts (id, set), and for each distinct set, which its smallest id stands for: set, id, copies, n_similar (other sets of a Jaccard
    similarity of percent or more), n_copies (texts of those), smallest (the smallest id of those and itself), cluster (the smallest that links reach)."""
    far = 1 - percent / 100
    texts, known, sets, member, families, met = _met(df, id_col, text, percent, rounds)
    shells = rounds.written(member.groupBy("root", "d").agg(*_sums()))

    shell = lambda s: shells.select(F.col("root").alias(s), *[F.col(c).alias(f"{c}{s}") for c in ("d", "n_sets", "n_copies", "least")])
    cases = met.join(shell("x"), "x").join(shell("y"), "y")
    a, b, c = F.col("d"), F.col("dx"), F.col("dy")
    exact = F.col("c") * 100 >= (F.col("nx") + F.col("ny") - F.col("c")) * percent
    sure = F.when((b == 0) & (c == 0), exact).when(a + b + c <= far - SLACK, True)
    sure = sure.when(F.greatest(a - b - c, b - a - c, c - a - b) > far + SLACK, False)
    cases = rounds.written(cases.withColumn("linked", sure))
    certain = cases.filter("linked")
    by_shell = _both_ways(certain, ("x", "dx"), ("y", "dy"), ("root", "d"))
    of = lambda s: member.select(F.col("root").alias(s), F.col("d").alias(f"d{s}"), F.col("id").alias(f"id{s}"), F.col("copies").alias(f"n_copies{s}"))
    open_ = cases.filter("linked is null").select("x", "dx", "y", "dy").join(of("x"), ["x", "dx"]).join(of("y"), ["y", "dy"])
    open_ = _common(open_, sets, "idx", "idy").filter(exact).select("x", "y", "idx", "idy", "n_copiesx", "n_copiesy")
    open_ = rounds.written(open_.withColumns({f"{c}{s}": F.lit(1) if c == "n_sets" else F.col(f"id{s}") for c in ("n_sets", "least") for s in "xy"}))
    by_set = _both_ways(open_, ("idx",), ("idy",), ("id",))

    edges = certain.select("x", "y").unionByName(open_.select("x", "y")).distinct()
    found = ledger.clusters(edges.select(F.col("x").alias("u"), F.col("y").alias("v")))
    labelled = families.join(found.select(F.col("node").alias("root"), F.col("cluster").alias("label")), "root", "left")
    labelled = labelled.withColumn("label", F.coalesce("label", "root"))
    least = labelled.groupBy("label").agg(F.min("least").alias("cluster"))
    named = lambda df, s: df.select(*[F.col(k) for k in ("root", "d", "id") if k in df.columns], *[F.col(k).alias(f"{s}_{k}") for k in ("n_sets", "n_copies", "least")])
    own = labelled.join(least, "label").select("root", "cluster", *[F.col(k).alias(f"own_{k}") for k in ("n_sets", "n_copies", "least")])
    told = member.join(own, "root").join(named(by_shell, "shell"), ["root", "d"], "left").join(named(by_set, "set"), "id", "left")
    plus = lambda k: F.col(f"own_{k}") + F.coalesce(f"shell_{k}", F.lit(0)) + F.coalesce(f"set_{k}", F.lit(0))
    told = told.join(known.select("id", "set"), "id").select(
        "set", "id", "copies", (plus("n_sets") - 1).alias("n_similar"), (plus("n_copies") - F.col("copies")).alias("n_copies"),
        F.least("own_least", "shell_least", "set_least").alias("smallest"), "cluster",
    )
    return texts, told


def _blocks(member: DataFrame, sets: DataFrame, roots: DataFrame, rounds: Rounds, far: float) -> DataFrame:
    """The sets of those families in blocks of some BLOCK sets and BLOCK_TOKENS tokens: block (root, band, part), low and high of the distances d
    from the root, and members. A band holds a narrow range of distances."""
    rows = member.join(roots, "root").join(sets.select("id", "n"), "id").withColumn("band", F.floor(F.col("d") * 8 / far).cast("int"))
    parts = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_TOKENS)).alias("parts")
    rows = rows.join(rows.groupBy("root", "band").agg(parts), ["root", "band"])
    part = F.pmod(F.xxhash64("id"), F.col("parts")).alias("part")
    rows = rows.select("id", F.struct("root", "band", part).alias("block"), "d").join(sets.select("id", "n", "tokens"), "id")
    members = F.collect_list(F.struct("id", "d", "n", "tokens")).alias("members")
    return rounds.written(rows.groupBy("block").agg(F.min("d").alias("low"), F.max("d").alias("high"), members))


def _apart(a: Column, b: tuple[Column, Column], c: tuple[Column, Column]) -> Column:
    """The least distance of two sets whose representatives are at distance a and which are between b and between c from them."""
    return F.greatest(a - b[1] - c[1], b[0] - a - c[1], c[0] - a - b[1])


def _linked_sets(sets: DataFrame, member: DataFrame, families: DataFrame, met: DataFrame, rounds: Rounds, percent: int) -> DataFrame:
    """(x, y, jaccard): each pair of sets of a similarity of percent or more once, x < y.

    Blocks of a family meet each other, and those of families that may hold links where their distances leave it open; a block's tokens travel with
    the block, not with each pair. Families of one set each have been counted already.
    """
    far = 1 - percent / 100
    single = families.select("root", (F.col("n_sets") == 1).alias("single"))
    of = lambda s: single.select(F.col("root").alias(s), F.col("single").alias(f"single{s}"))
    met = rounds.written(met.join(of("x"), "x").join(of("y"), "y").withColumn("alone", F.col("singlex") & F.col("singley")))
    wide = met.filter(~F.col("alone")).select("x", "y", "d")
    roots = single.filter(~F.col("single")).select("root").unionByName(wide.select(F.explode(F.array("x", "y")).alias("root"))).distinct()
    blocks = _blocks(member, sets, roots, rounds, far)
    head = lambda s: blocks.select(F.col("block.root").alias(s), *[F.col(c).alias(f"{c}{s}") for c in ("block", "low", "high")])
    inside = head("x").join(head("y").withColumnRenamed("y", "x"), "x").filter("blockx <= blocky").withColumn("a", F.lit(0.0))
    across = wide.withColumnRenamed("d", "a").join(head("x"), "x").join(head("y"), "y")
    across = across.filter(_apart(F.col("a"), (F.col("lowx"), F.col("highx")), (F.col("lowy"), F.col("highy"))) <= far + SLACK)
    meet = inside.select("blockx", "blocky", "a").unionByName(across.select("blockx", "blocky", "a"))

    side = lambda s: blocks.select(F.col("block").alias(f"block{s}"), F.col("members").alias(f"members{s}"))
    rows = rounds.written(meet).join(side("x"), "blockx").join(side("y"), "blocky")
    rows = rows.select("a", (F.col("blockx") == F.col("blocky")).alias("same"), F.explode("membersx").alias("p"), "membersy")
    rows = rows.select("a", "same", "p", F.explode("membersy").alias("q")).filter((F.col("p.id") != F.col("q.id")) & (~F.col("same") | (F.col("p.id") < F.col("q.id"))))
    d, e = F.col("p.d"), F.col("q.d")
    rows = rows.filter((_apart(F.col("a"), (d, d), (e, e)) <= far + SLACK) & (F.least("p.n", "q.n") * 100 >= F.greatest("p.n", "q.n") * percent))
    common = F.explode(F.array(F.size(F.array_intersect("p.tokens", "q.tokens")))).alias("c")
    near = rows.select(F.least("p.id", "q.id").alias("x"), F.greatest("p.id", "q.id").alias("y"), F.col("p.n").alias("nx"), F.col("q.n").alias("ny"), common)
    every = near.unionByName(met.filter("alone").select("x", "y", "nx", "ny", "c"))
    union = F.col("nx") + F.col("ny") - F.col("c")
    return every.filter(F.col("c") * 100 >= union * percent).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), (F.col("c") / union).alias("jaccard"))


def similar_pairs(df: DataFrame, id_col: str, text: str, percent: int = 80) -> DataFrame:
    """Pairs of distinct sets of a similarity of percent or more, and what texts have them: kind, x, y, jaccard.

    A row of kind 'pair' holds x < y, the smallest ids of two similar sets; one of kind 'member' each text with tokens, y, under the smallest id of
    its set, x. So two texts are similar if they have one x, or if their x are a pair. The result is written; it grows with the pairs.
    """
    with Rounds(df.sparkSession) as rounds, configured(df.sparkSession, SETTINGS):
        texts, known, sets, member, families, met = _met(df, id_col, text, percent, rounds)
        pairs = _linked_sets(sets, member, families, met, rounds, percent)
        members = texts.join(known.select("set", F.col("id").alias("x")), "set").select(F.lit("member").alias("kind"), "x", F.col("id").alias("y"), F.lit(1.0).alias("jaccard"))
        return rounds.result(members.unionByName(pairs.select(F.lit("pair").alias("kind"), "x", "y", "jaccard")))


def similar_representatives(df: DataFrame, id_col: str, text: str, percent: int = 80) -> DataFrame:
    """A row for each distinct set that is similar to another: its smallest id, how many sets are, and the smallest id among them and itself."""
    with Rounds(df.sparkSession) as rounds, configured(df.sparkSession, SETTINGS):
        _, told = similar_sets(df, id_col, text, percent, rounds)
        return rounds.result(told.filter("n_similar > 0").select(F.col("id").alias(id_col), "n_similar", "smallest"))


def similar_classes(df: DataFrame, id_col: str, text: str, percent: int = 80) -> DataFrame:
    """A row for each text with tokens: the smallest id of its set, of its cluster, and the number of texts that it is directly similar to.

    Clusters are what links between similar sets connect. Texts of one set are linked with each other and with all that the set is linked with. Sets
    without a similar one are clusters of their own; null and blank texts have no tokens and no row, nor has a set that only texts without an id have.
    The result is written.
    """
    with Rounds(df.sparkSession) as rounds, configured(df.sparkSession, SETTINGS):
        texts, told = similar_sets(df, id_col, text, percent, rounds)
        every = texts.join(told.withColumnRenamed("id", "rep"), "set")
        links = (F.col("n_copies") + F.col("copies") - 1).alias("n_links")
        return rounds.result(every.select(F.col("id").alias(id_col), F.col("rep").alias("class"), "cluster", links))
