"""Secrets in texts, and which of them look live: ownership frequency over the corpus. DataFrame operations only.

Base spans come from three patterns. The method then counts, for the hash of each candidate value, in how many distinct
repositories and by how many distinct owners it occurs over the corpus. A value that several owners have, or that stands in many
repositories of one, is a widely copied example; one in few repositories of a single owner looks live. Wider candidates, long mixed
tokens that no pattern names, are too common to be reported by their looks; those that look live are added as spans of kind ``live``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, lookup


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


KEYWORD = "(?:" + "|".join(map(_either, ("password", "passwd", "secret", "token", "api_?key"))) + ")"
#: kind -> (pattern, group of the value (0: the whole match), least length of that group, what a text with a match has, written to fail
#: at the first character: every text is gone over for it). A maximal run of
#: 32 or more is the leftmost match of "32 or more" too, and of AKIAs in a run the first has the longest rest; so these lengths stand in the patterns.
BASE = {
    "assign": (KEYWORD + r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 8, "(?=[pPsStTaA])" + KEYWORD + r"[\"']?\x20*[:=]"),
    "access": ("AKIA[A-Z0-9]{12,}", 0, 16, "AKIA[A-Z0-9]{12}"),
    "hex": ("[0-9a-f]{32,}", 0, 32, "[0-9a-f]{32}"),
}
#: Runs as long as a key; candidates have a digit, a small and a capital letter.
WIDE = ("[A-Za-z0-9+/_-]{24,}", 0, 24, "(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24}")
KINDS = ("assign", "access", "hex", "live")
#: Owners from which on a value counts as a copied example.
OWNERS = 2
#: Distinct repositories from which on a value of fewer owners counts as one too: an owner may use a credential in some.
REPOS = 10

_MATCH = "array<struct<kind:int,gap:long,size:long,good:boolean,hash:binary>>"


def _matches(text: Column, kind: int, pattern: str, group: int, least: int, hint: str) -> Column:
    """The matches in a text in order: the length of the gap before, the match's length, in code points, whether the value can be a secret, and its
    digest; values themselves are never written.

    The text is gone over for the hint, and if that holds for the gaps and the matches; the value comes from its short match. A base value
    has the least length, a wide one a digit, a small and a capital letter.
    """
    gaps, whole = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    size = lambda c: F.char_length(c).cast("long")
    value = lambda m: F.regexp_extract(m, pattern, group) if group else m
    places = lambda m: [size(m["gap"]).alias("gap"), size(m["whole"]).alias("size")]
    mixed = lambda v: v.rlike("[0-9]") & v.rlike("[a-z]") & v.rlike("[A-Z]")
    good = lambda v: F.char_length(v) >= least if kind < len(BASE) else mixed(v)
    told = lambda v: [good(v).alias("good"), F.unhex(F.md5(v)).alias("hash")]
    one = lambda m: F.struct(F.lit(kind).alias("kind"), *places(m), *told(value(m["whole"])))
    row = F.transform(F.arrays_zip(F.slice(gaps, F.lit(1), F.size(whole)).alias("gap"), whole.alias("whole")), one)
    return F.when(text.rlike(hint), row).otherwise(F.lit(None)).cast(_MATCH)


def _named(c: Column) -> Column:
    """A text that tells null from every value."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id",
    owners: int = OWNERS, repos: int = REPOS,
) -> DataFrame:
    """One row a document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, and by ownership n_live, n_example, n_added,
    n_owners and n_repos, the most owners and the most repositories that have a value of the document (wide candidates too), 0 without one.

    Spans are kind:start:end in code points, end exclusive, by start and then by kind. Base spans stay whatever the method says of them;
    n_live and n_example divide them by whether the value looks live: fewer than ``owners`` owners and fewer than ``repos`` distinct
    repositories have it. A wide candidate that doesn't overlap a base span and whose value looks live is added as ``live``.
    A repository is a name under an owner. Null texts are empty; a null owner or repository is one of its own, apart from an empty one;
    repeated rows are documents of their own; other columns aren't read. The result is a written table.
    One pass over the texts; what is shuffled are matches. Values are compared by 128-bit digests. A value in very many
    documents is counted by partial sums and looked up as a hot key.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    kinds = [_matches(F.col("text"), k, *p) for k, p in enumerate([*BASE.values(), WIDE])]
    keys = [F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id")]
    read = docs.select(*keys, _named(F.col(owner_col)).alias("owner"), _named(F.col(repo_col)).alias("repo"), text.alias("text"))
    with Scratch(docs.sparkSession) as tmp:
        rows = tmp.written(read.select("row", "doc_id", "owner", "repo", F.array_compact(F.array(*kinds)).alias("found")), "rows")
        spans = tmp.written(_spans(rows), "spans")
        by_repo = spans.groupBy("hash", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
        by_owner = by_repo.groupBy("hash", "owner").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("repos"))
        owned = by_owner.groupBy("hash").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_owners"), F.sum("repos").alias("n_repos"))
        judged = lookup(spans, tmp.written(owned, "owners"), "hash", "n")
        return tmp.result(_told(rows, judged.withColumn("alive", (F.col("n_owners") < owners) & (F.col("n_repos") < repos))), "op3")


def _spans(rows: DataFrame) -> DataFrame:
    """The candidates: base matches of the least length, and wide ones that look like a key and overlap no base match."""
    each = rows.select("row", "owner", "repo", F.explode("found").alias("one")).select("row", "owner", "repo", F.posexplode("one").alias("k", "m"))
    each = each.select("row", "owner", "repo", "k", "m.*")
    end = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("row", "kind").orderBy("k"))
    wide = len(BASE)
    placed = each.withColumn("end", end).withColumn("start", F.col("end") - F.col("size")).filter("good")
    of_row = Window.partitionBy("row").orderBy("start", "kind")
    base = F.col("kind") < wide
    before = F.max(F.when(base, F.col("end"))).over(of_row.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(base, F.col("start"))).over(of_row.rowsBetween(1, Window.unboundedFollowing))
    clear = base | ~(F.coalesce(before > F.col("start"), F.lit(False)) | F.coalesce(after < F.col("end"), F.lit(False)))
    kept = placed.withColumn("clear", clear).filter("clear")
    return kept.select("row", "owner", "repo", "kind", "start", "end", "hash")


def _told(rows: DataFrame, judged: DataFrame) -> DataFrame:
    base = F.col("kind") < len(BASE)
    one = F.struct("start", "kind", "end")
    kinds = [F.count_if(F.col("kind") == k).alias(f"n_{name}") for k, name in enumerate(BASE)]
    alive = F.col("alive")
    looks = [F.count_if(c).alias(n) for n, c in (("n_live", base & alive), ("n_example", base & ~alive), ("n_added", ~base & alive))]
    wide = [F.max("n_owners").alias("n_owners"), F.max("n_repos").alias("n_repos")]
    told = judged.groupBy("row").agg(*kinds, *looks, *wide, F.sort_array(F.collect_list(F.when(base | alive, one))).alias("all"))
    name = lambda k: F.element_at(F.array(*[F.lit(x) for x in KINDS]), k + 1)
    span = lambda x: F.concat_ws(":", name(x["kind"]), x["start"].cast("string"), x["end"].cast("string"))
    joined = lambda of: F.concat_ws(",", F.transform(of, span))
    digest = F.sha2(joined(F.filter("all", lambda x: x["kind"] < len(BASE))), 256)
    numbers = [c for c in told.columns if c.startswith("n_")]
    told = told.select("row", *numbers, digest.alias("base_sha256"), joined(F.col("all")).alias("spans"))
    every = rows.select("row", "doc_id").join(told.hint("merge"), "row", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers]
    none = [F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans")]
    return every.select("doc_id", *zero, *none)


def _sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    one = lambda k, p, g: (
        f"SELECT doc_id, owner, repo, {k} AS kind, regexp_split_to_array(text, {quoted(p)}) AS gaps, "
        f"regexp_extract_all(text, {quoted(p)}, 0) AS whole, regexp_extract_all(text, {quoted(p)}, {g}) AS value FROM d"
    )
    scans = "\n  UNION ALL ".join(one(k, p, g) for k, (p, g, *_) in enumerate([*BASE.values(), WIDE]))
    least = BASE["assign"][2]
    names = "[" + ", ".join(map(quoted, KINDS)) + "][kind + 1]"
    span = f"{names} || ':' || start || ':' || upto, ',' ORDER BY start, kind"
    named = lambda c: f"coalesce('=' || {c}::VARCHAR, '')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {named('source')} AS owner, {named('doc_id')} AS repo FROM documents),
m AS (
  {scans}
),
e AS (SELECT *, unnest(range(1, len(whole) + 1)) AS k FROM m),
p AS (SELECT doc_id, owner, repo, kind, value[k] AS value, length(whole[k]) AS size,
             (list_sum(list_transform(gaps[1:k], lambda x: length(x)))
              + coalesce(list_sum(list_transform(whole[1:k-1], lambda x: length(x))), 0))::BIGINT AS start FROM e),
g AS (SELECT *, start + size AS upto FROM p WHERE kind IN (1, 2) OR kind = 0 AND length(value) >= {least}
      OR kind = 3 AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]')),
c AS (SELECT * FROM g WHERE kind < 3
      OR NOT EXISTS (SELECT 1 FROM g b WHERE b.doc_id = g.doc_id AND b.kind < 3 AND b.start < g.upto AND b.upto > g.start)),
o AS (SELECT value, count(DISTINCT owner) AS n_owners, count(DISTINCT owner || chr(10) || repo) AS n_repos FROM c GROUP BY value),
j AS (SELECT c.*, o.n_owners, o.n_repos, o.n_owners < {OWNERS} AND o.n_repos < {REPOS} AS alive FROM c JOIN o USING (value))
SELECT d.doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
       count(*) FILTER (kind < 3 AND alive) AS n_live, count(*) FILTER (kind < 3 AND NOT alive) AS n_example,
       count(*) FILTER (kind = 3 AND alive) AS n_added, coalesce(max(n_owners), 0) AS n_owners, coalesce(max(n_repos), 0) AS n_repos,
       sha256(coalesce(string_agg({span}) FILTER (kind < 3), '')) AS base_sha256,
       coalesce(string_agg({span}) FILTER (kind < 3 OR alive), '') AS spans
FROM d LEFT JOIN j USING (doc_id) GROUP BY d.doc_id"""


SQL = _sql()
