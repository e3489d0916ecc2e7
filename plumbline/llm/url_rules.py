"""URL filter by a sorted sweep over canonical keys.

A key is the reversed host and the path (``com.example.`` NUL ``/en/``).  A
rule covers every key that begins with its own, an interval of the sort order;
a URL asks once per parent domain of its host, since a rule holds for all
subdomains.  Rules and questions are dealt over ranges of the order (a rule
goes to each range its interval meets), each range is sorted once, and a
running "last rule seen" carries the stack of nested rules that are open
there: intervals of prefixes are nested or apart, so the innermost rule that
holds a question is on the stack of the last rule before it.

Defined results: a null URL, or one without ``://``, has empty host and path and
fits no rule with a host; a URL without path has the empty path; what no rule
fits is allowed; of the rules that fit, the longest ``host + path`` wins, then
the longer host; rows are judged one by one, so repeated rows are kept.
Columns of the input other than page_id and url are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT = "allow"
# The rules of the contract (host, path, verdict)
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block")]
_GAP = "\u0001"   # between host and path: sorts below every printable character
_TIE = "\u0000"   # before the hash that spreads equal questions over ranges
_SAMPLED = 4096   # questions that place the range borders (borders decide balance, never results)


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _key(host: Column, path: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("." + _GAP), path)


def _range_of(key: Column, borders: list[str]) -> Column:
    """Number of borders at or below the key, by binary search in a literal list."""
    if not borders:
        return F.lit(0)
    table = F.array(*[F.lit(b) for b in borders])
    steps = [1 << i for i in reversed(range(len(borders).bit_length()))]
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda low, s: F.when(
        (low + s <= len(borders)) & (F.get(table, low + s - 1) <= key), low + s).otherwise(low))


def with_stacks(rules: DataFrame) -> DataFrame:
    """Rules (host, path, verdict) with key and ``stack``: the rule itself and all rules whose interval holds it."""
    keyed = (rules.select("host", "path", "verdict").dropDuplicates(["host", "path"])
             .withColumn("key", _key(F.col("host"), F.col("path"))))
    starts = keyed.select(F.col("key").alias("inner"), F.explode(F.transform(
        F.sequence(F.lit(1), F.length("key")), lambda n: F.substring("key", F.lit(1), n))).alias("key"))
    each = F.struct(F.length("key").alias("n"), "key", "host", "path", "verdict")
    stacks = starts.join(keyed, "key").groupBy("inner").agg(F.array_sort(F.collect_list(each)).alias("stack"))
    return keyed.join(stacks.withColumnRenamed("inner", "key"), "key").select("key", "stack")


def judge(pages: DataFrame, rules: DataFrame, ranges: int) -> DataFrame:
    """Rows (page_id, host, path, rule, verdict) for ``pages`` (page_id, url)."""
    host, path = host_and_path(F.col("url"))
    asked = pages.select(F.monotonically_increasing_id().alias("row"), "page_id", host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)),
                          lambda n: F.array_join(F.slice(labels, n, F.size(labels)), "."))
    probes = (asked.withColumn("parent", F.explode(parents)).withColumn("key", _key(F.col("parent"), F.col("path")))
              .withColumn("spot", F.concat("key", F.lit(_TIE), F.hex(F.xxhash64("row")))))
    n = probes.count()
    sample = (probes.where(F.pmod(F.xxhash64("spot"), F.lit(max(1, n // _SAMPLED))) == 0)
              .select("spot").orderBy("spot").limit(2 * _SAMPLED).collect())  # about _SAMPLED strings
    borders = sorted({sample[i * len(sample) // ranges].spot for i in range(1, ranges)}) if sample else []
    probes = probes.withColumn("range", _range_of(F.col("spot"), borders))
    stacked = with_stacks(rules)
    first, last = _range_of(F.col("key"), borders), _range_of(F.concat("key", F.lit("\U0010FFFF")), borders)
    dealt = stacked.withColumn("range", F.explode(F.sequence(first, last)))
    both = (probes.select("range", F.col("key").alias("at"), F.lit(1).alias("kind"), "row", "page_id", "host", "path",
                          F.lit(None).cast(stacked.schema["stack"].dataType).alias("stack"))
            .unionByName(dealt.select("range", F.col("key").alias("at"), F.lit(0).alias("kind"), "stack"), allowMissingColumns=True))
    sweep = Window.partitionBy("range").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    open_rules = both.withColumn("open", F.last("stack", ignorenulls=True).over(sweep)).where("kind = 1")
    fits = F.filter("open", lambda r: F.col("at").startswith(r["key"]))
    inner = F.get(fits, F.size(fits) - 1)
    best = F.struct((F.length(inner["host"]) + F.length(inner["path"])).alias("n"), F.length(inner["host"]).alias("h"),
                    F.concat(inner["host"], inner["path"]).alias("rule"), inner["verdict"].alias("verdict"))
    found = (open_rules.select("row", "page_id", "host", "path", F.when(inner.isNotNull(), best).alias("best"))
             .groupBy("row").agg(F.first("page_id").alias("page_id"), F.first("host").alias("host"),
                                 F.first("path").alias("path"), F.max("best").alias("best")))
    return found.select("page_id", "host", "path", F.col("best.rule").alias("rule"),
                        F.coalesce("best.verdict", F.lit(DEFAULT)).alias("verdict"))
