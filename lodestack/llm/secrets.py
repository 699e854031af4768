"""Secret scan with corpus-wide ownership frequency. DataFrame functions only.

Kinds of span (offsets in code points, end exclusive):

* ``assign``, ``access``, ``hex``: the base patterns; always reported.
* ``token``: any other long mixed string, reported only if the corpus-wide
  ownership of its value says that it is owner specific (at most
  ``max_owners`` distinct owners and ``max_repos`` repositories hold it), for
  strings that many owners hold are documentation examples or public digests.

The value of every candidate is hashed; distinct (owner, repository) pairs of
each hash are counted in three shrinking aggregations, so a value that a third
of all rows holds becomes a handful of rows before any shuffle.

Null text counts as empty, null owner or repository as one owner or repository
of its own. Repeated rows are rows of their own. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import cut, require

#: Fixed patterns: letters of the key words in either case, spelled out so that no engine folds non-ASCII letters into them.
_KEYS = ("password", "passwd", "secret", "token", "api_?key")
_CASED = "|".join("".join(c if c in "_?" else f"[{c.upper()}{c}]" for c in k) for k in _KEYS)
ASSIGN = rf"""({_CASED})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = {"assign": 0, "access": 1, "hex": 2, "token": 3}
_EMPTY = "array<struct<start:bigint,kind:int,end:bigint,value:string>>"


def _spans(text: Column, kind: str, pattern: str, group: int = 0) -> Column:
    """Leftmost non-overlapping matches: the pieces between the matches give the offsets."""
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x).cast("long"))
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    rows = F.arrays_zip(F.slice(gaps, 1, F.size(whole)).alias("gap"), whole.alias("whole"), value.alias("value"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_EMPTY).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        first = acc["at"] + x["gap"]
        last = first + F.length(x["whole"])
        new = F.struct(first.alias("start"), F.lit(KINDS[kind]).alias("kind"), last.alias("end"), x["value"].alias("value"))
        return F.struct(last.alias("at"), F.concat(acc["out"], F.array(new)).alias("out"))

    found = F.aggregate(rows, start, step, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(_EMPTY))


def candidates(text: Column) -> Column:
    """Base spans and, where they don't overlap one of these, token spans; in order of start, then kind."""
    assign = F.filter(_spans(text, "assign", ASSIGN, 2), lambda x: F.length(x["value"]) >= 8)
    base = F.concat(assign, _spans(text, "access", ACCESS), _spans(text, "hex", HEX))
    token = F.filter(
        _spans(text, "token", TOKEN),
        lambda x: x["value"].rlike("[0-9]") & x["value"].rlike("[A-Za-z]") & (F.size(F.array_distinct(F.regexp_extract_all(x["value"], F.lit("."), F.lit(0)))) >= 10),
    )
    return base, token


def scan(docs: DataFrame, owner: Column | None = None, repo: Column | None = None, max_owners: int = 1, max_repos: int = 2, example_owners: int = 3) -> DataFrame:
    """One row per document: its spans, and how many of them are live looking or widely copied.

    Columns: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_token,
    n_live, n_example (spans whose value at least ``example_owners`` owners hold).
    """
    require(docs, "doc_id", "text")
    owner = F.col("source") if owner is None else owner
    repo = F.concat_ws("/", F.col("source"), F.col("lang")) if repo is None else repo
    text = F.coalesce(F.col("text"), F.lit(""))
    base, token = candidates(text)
    table = docs.select(F.col("doc_id"), F.coalesce(owner.cast("string"), F.lit("\x00")).alias("owner"), F.coalesce(repo.cast("string"), F.lit("\x00")).alias("repo"), base.alias("base"), token.alias("token"))
    clear = F.filter("token", lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    hashed = lambda c: F.transform(c, lambda x: F.struct(x["start"], x["kind"], x["end"], F.sha2(x["value"], 256).alias("h")))
    table = table.select("doc_id", "owner", "repo", hashed(F.concat("base", clear)).alias("found"))
    table = cut(table.withColumn("rid", F.monotonically_increasing_id()), "secrets")

    full = table.where(F.size("found") > 0)
    flat = full.select("rid", "owner", "repo", F.explode("found").alias("f")).select("rid", "owner", "repo", "f.*")
    stats = flat.groupBy("h", "owner", "repo").agg(F.count("*").alias("n")).groupBy("h", "owner").agg(F.count("*").alias("repos")).groupBy("h").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))
    judged = flat.select("rid", "start", "kind", "end", "h").join(stats, "h")
    live = (F.col("owners") <= max_owners) & (F.col("repos") <= max_repos)
    judged = judged.withColumn("live", live).where((F.col("kind") < KINDS["token"]) | F.col("live"))
    by_doc = judged.groupBy("rid").agg(
        F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"),
        F.sum(F.col("live").cast("long")).alias("n_live"),
        F.sum((F.col("owners") >= example_owners).cast("long")).alias("n_example"),
    )
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    some = full.select("rid", "doc_id").join(by_doc, "rid", "left").select("doc_id", F.coalesce("spans", none).alias("spans"), F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_example", F.lit(0)).alias("n_example"))
    rest = table.where(F.size("found") == 0).select("doc_id", none.alias("spans"), F.lit(0).cast("long").alias("n_live"), F.lit(0).cast("long").alias("n_example"))
    return report(some.unionByName(rest))


def report(df: DataFrame) -> DataFrame:
    names = F.array(*[F.lit(k) for k in KINDS])
    told = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == KINDS[k])).cast("long")
    base = F.filter("spans", lambda x: x["kind"] < KINDS["token"])
    return df.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(told(base), 256).alias("base_sha256"),
        told("spans").alias("spans"),
        count("token").alias("n_token"),
        "n_live",
        "n_example",
    )
