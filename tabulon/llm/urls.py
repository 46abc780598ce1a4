"""URL filters as a sort-merge range join.

A host's labels are reversed and each is closed with a dot, so that a rule's host and all subdomains of it make one
interval of keys ("org.example." up to "org.example/"). Urls and rules are sorted together by key; a sweep over the
sorted rows keeps the rules whose interval is open on a stack, where hosts are nested in hosts. The paths of an open host
are looked up by prefix.

Urls are dealt to ranges of (key, path, id), so one frequent host, or even url, is split over many. A rule goes to
each range that its interval meets.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.common import partitions, table

#: Rules of the registered query: verdict, host, path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Ranges for each shuffle partition, and sampled keys for each range.
RANGES, SAMPLED = 4, 16
#: Code points of a path by which rows of one host are dealt to ranges.
HEAD = 64


def host_of(url: Column) -> Column:
    """From the first :// up to /, ?, # or the end, A-Z lower-cased; empty if there is none."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def _key(host: str) -> str:
    return ".".join(reversed(host.split("."))) + "."


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by range, key and kind, rules first. Columns: range, key, path, kind, rule, verdict, then the url's own."""
    stack: list[tuple[str, dict[str, tuple[str, str]], list[int]]] = []
    at = None
    for batch in batches:
        ranges, keys, paths, kinds, rules, verdicts = (batch.column(i).to_pylist() for i in range(6))
        found, taken = [], []
        for i, (rng, key, path, is_url) in enumerate(zip(ranges, keys, paths, kinds, strict=True)):
            if rng != at:
                at, stack = rng, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if not is_url:
                if not stack or stack[-1][0] != key:
                    stack.append((key, {}, []))
                _, by_path, lengths = stack[-1]
                if path not in by_path and len(path) not in lengths:
                    bisect.insort(lengths, len(path))
                # of two verdicts for one rule, block holds
                if path not in by_path or verdicts[i] == "block":
                    by_path[path] = (rules[i], verdicts[i])
                continue
            taken.append(i)
            best: tuple = (-1,)
            for _, by_path, lengths in stack:
                for n in reversed(lengths):
                    if n <= len(path) and (hit := by_path.get(path[:n])):
                        # the longest rule text wins; of equal ones the longer host, which comes later
                        if len(hit[0]) >= best[0]:
                            best = (len(hit[0]), *hit)
                        break
            found.append(best[1:] or (None, None))
        own = [batch.column(i).take(pa.array(taken, pa.int64())) for i in range(6, batch.num_columns)]
        names = batch.schema.names[6:]
        out = own + [pa.array([x[k] for x in found], pa.string()) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays(out, names=[*names, "rule", "verdict"])


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", keep: Sequence[str] = ("page_id",), order: str = "page_id", default: str = "allow") -> DataFrame:
    """Columns ``keep`` of ``pages``, then host, path, rule and verdict, for every row.

    ``rules`` has the columns verdict, host and path. A rule fits its host and all subdomains if the path starts with
    the rule's; the rule with the longest text wins, ``default`` is the verdict where none fits. Null urls and those
    without :// have an empty host and path. Repeated rows and rules are allowed; no rules at all are too.
    """
    spark = pages.sparkSession
    keep = [c for c in keep if c not in ("host", "path", "rule", "verdict")]
    urls = pages.select(*keep, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), F.xxhash64(order, url, F.monotonically_increasing_id()).alias("__tie"))
    urls = urls.withColumns({"__key": host_key(F.col("host")), "__head": F.substring("path", 1, HEAD)})
    ranges = RANGES * partitions(spark)
    # the rows of least hash, at most SAMPLED a range, set the bounds; a row's number in its partition tells repeated rows apart, so
    # that they spread over ranges too; only the balance depends on them, never a result
    sample = urls.select("__key", "__head", "__tie").orderBy(F.xxhash64("__tie", F.lit(3))).limit(ranges * SAMPLED)
    points = sorted((r[0], r[1], r[2]) for r in sample.collect())
    bounds = sorted({points[i * len(points) // ranges] for i in range(1, ranges)}) if points else []
    shared = spark.sparkContext.broadcast(bounds)

    shape = "__range int, __key string, __path string, __url boolean, __rule string, __verdict string"

    @F.pandas_udf("int")
    def range_of(key, path, tie):  # noqa: ANN001, ANN202
        return key.__class__([bisect.bisect_right(shared.value, x) for x in zip(key, path, tie, strict=True)], dtype="int32")

    @F.pandas_udf("array<int>")
    def ranges_of(key):  # noqa: ANN001, ANN202
        ends = [(bisect.bisect_left(shared.value, (k,)), bisect.bisect_right(shared.value, (f"{k[:-1]}/",))) for k in key]
        return key.__class__([list(range(a, b + 1)) for a, b in ends])

    left = urls.select(range_of("__key", "__head", "__tie").alias("__range"), "__key", F.col("path").alias("__path"), F.lit(True).alias("__url"), F.lit(None).cast("string").alias("__rule"), F.lit(None).cast("string").alias("__verdict"), *keep, "host", "path")
    named = rules.select(F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("h"), F.col("path").alias("p"), "verdict").where("h IS NOT NULL AND p IS NOT NULL").withColumn("__key", host_key(F.col("h")))
    right = named.select(F.explode(ranges_of("__key")).alias("__range"), "__key", F.col("p").alias("__path"), F.lit(False).alias("__url"), F.concat("h", "p").alias("__rule"), F.col("verdict").alias("__verdict"))
    events = left.unionByName(right, allowMissingColumns=True).repartition("__range").sortWithinPartitions("__range", "__key", "__url")
    fields = [pages.schema[c].simpleString().split(":", 1)[1] for c in keep]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in zip(keep, fields, strict=True)), "host string", "path string", "rule string", "verdict string"])
    judged = events.select(*shape.replace(",", "").split()[::2], *keep, "host", "path").mapInArrow(_sweep, schema)
    return judged.withColumn("verdict", F.coalesce("verdict", F.lit(default)))


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(RULES), "verdict string, host string, path string")
    return judge_urls(table(spark, sf_dir, "pages"), rules)


# The same rules for DuckDB: every rule against every page, the longest fitting one kept.
ORACLE = r"""
WITH rules(verdict, rhost, rpath) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
p AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
best AS (
  SELECT page_id, host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY page_id, host, path)
SELECT p.page_id, p.host, p.path, best.rule, coalesce(best.verdict, 'allow') AS verdict
FROM p LEFT JOIN best USING (page_id, host, path)
"""
