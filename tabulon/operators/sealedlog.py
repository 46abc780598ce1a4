"""A sealed audit log: who may write, what was written, and what still counts after a revocation.

Principals form a tree; a seal belongs to a principal and is valid in a half-open interval; an envelope is a write by a
seal, with witnesses and a named period, signed with the seal's secret. All of it is tables:

* principals (principal, parent), seals (seal, principal, secret, valid_from, valid_to), periods (period, name, start_ts)
* envelopes (seq, payload, by_seal, witnesses, period, written_at, signature)
"""

from __future__ import annotations

import hashlib
import hmac
import json
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tabulon.operators.ranks import ranked
from tabulon.sources.shared import kept


class Rejected(ValueError):
    """What a single call raises where a batch would list rejected rows."""


def rejected_principals(new: DataFrame, known: DataFrame) -> DataFrame:
    """(principal, parent, reason) of registrations that cannot stand: a name that is taken or repeated, a parent that is not there."""
    taken = known.select(F.col("principal").alias("k"))
    there = taken.unionByName(new.select(F.col("principal").alias("k"))).distinct()
    counted = new.withColumn("n", F.count("*").over(Window.partitionBy("principal")))
    marked = counted.join(taken.distinct().withColumn("dup", F.lit(True)), F.col("principal") == F.col("k"), "left").drop("k")
    marked = marked.join(there.withColumn("ok", F.lit(True)), F.col("parent") == F.col("k"), "left")
    reason = F.when(F.col("dup") | (F.col("n") > 1), "duplicate principal").when(F.col("parent").isNotNull() & F.col("ok").isNull(), "unknown parent")
    return marked.select("principal", "parent", reason.alias("reason")).where("reason IS NOT NULL")


def mint(principals: DataFrame, root: str, valid_from: Column) -> DataFrame:
    """A seal for each principal, its name and secret derived from a root secret: the same whenever it is run again."""

    @F.pandas_udf("string")
    def derived(names: pd.Series) -> pd.Series:
        return names.map(lambda x: None if x is None else hmac.new(root.encode(), x.encode(), hashlib.sha256).hexdigest())

    secret = derived(F.col("principal").cast("string"))
    return principals.select(F.concat(F.lit("seal-"), F.col("principal").cast("string")).alias("seal"), "principal", secret.alias("secret"), valid_from.alias("valid_from"), F.lit(None).cast("double").alias("valid_to"))


def revoke(seals: DataFrame, revoked: DataFrame, at: str = "at") -> DataFrame:
    """``seals`` with valid_to set where it was open; a seal revoked twice keeps the first time."""
    first = revoked.groupBy("seal").agg(F.min(at).alias("__at"))
    return seals.join(first, "seal", "left").withColumn("valid_to", F.coalesce("valid_to", "__at")).drop("__at").select(*seals.columns)


def descendants(principals: DataFrame, root: str | int) -> DataFrame:
    """(principal, depth): the root and all below it, in trees of any depth.

    Every principal points at an ancestor and knows how far off it is and whether the root came on the way. Each step follows
    the pointers of those pointed at, which doubles their reach, so a chain of n takes log n joins. Rows that have met the root or
    passed the top are done. In a cycle, which no tree has, pointers go round until they reach as far as there are rows.
    """
    top = F.lit(root)
    start = principals.select("principal", F.col("parent").alias("jump"), F.lit(1).cast("long").alias("reach"), F.when(F.col("principal") == top, 0).when(F.col("parent") == top, 1).cast("long").alias("depth"))
    state, rows = kept(start, "descendants"), None
    while True:
        moving = state.where("depth IS NULL AND jump IS NOT NULL")
        left = moving.agg(F.count("*").alias("n"), F.max("reach").alias("reach")).first()
        rows = state.count() if rows is None else rows
        if not left["n"] or left["reach"] > rows:
            return state.where("depth IS NOT NULL").select("principal", F.col("depth").cast("int").alias("depth"))
        met = state.select(F.col("principal").alias("jump"), F.col("jump").alias("__jump"), F.col("reach").alias("__reach"), F.col("depth").alias("__depth"))
        further = moving.drop("depth").join(met, "jump", "left").select("principal", F.col("__jump").alias("jump"), (F.col("reach") + F.col("__reach")).alias("reach"), (F.col("reach") + F.col("__depth")).alias("depth"))
        state = kept(state.where("depth IS NOT NULL OR jump IS NULL").unionByName(further), "descendants")


def cascade(seals: DataFrame, principals: DataFrame, root: str | int, at: float) -> DataFrame:
    """``seals`` after revoking every open seal of the root and all below it, with ``newly`` for those."""
    below = descendants(principals, root).select(F.col("principal").alias("__p"))
    hit = F.col("__p").isNotNull() & F.col("valid_to").isNull()
    joined = seals.join(below, F.col("principal") == F.col("__p"), "left").withColumn("newly", hit)
    return joined.withColumn("valid_to", F.when(F.col("newly"), F.lit(at)).otherwise(F.col("valid_to"))).drop("__p")


def active(valid_from: Column, valid_to: Column, ts: Column) -> Column:
    """valid_from <= ts < valid_to; an open end is forever."""
    return (valid_from <= ts) & (valid_to.isNull() | (ts < valid_to))


def canonical(payload: str, by_seal: str, witnesses: list[str], period: str, written_at: object, seq: int) -> bytes:
    """Sorted keys, no spaces, ASCII only: the same bytes for the same envelope. Datetimes become UTC epoch seconds."""
    if isinstance(written_at, datetime):
        written_at = written_at.replace(tzinfo=written_at.tzinfo or timezone.utc).timestamp()
    body = {"by_seal": by_seal, "payload": payload, "period": period, "seq": int(seq), "witnesses": list(witnesses), "written_at": written_at}
    return json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=True).encode("ascii")


@F.pandas_udf(StringType())
def signature(payload: pd.Series, by_seal: pd.Series, witnesses: pd.Series, period: pd.Series, written_at: pd.Series, seq: pd.Series, secret: pd.Series) -> pd.Series:
    """HMAC-SHA256 of the canonical bytes, in hexadecimal; null without a secret."""
    rows = zip(payload, by_seal, witnesses, period, written_at, seq, secret, strict=True)
    return pd.Series([None if s is None else hmac.new(s.encode(), canonical(p, b, w, d, t, q), hashlib.sha256).hexdigest() for p, b, w, d, t, q, s in rows], dtype=object)


_SIGNED = ("payload", "by_seal", "witnesses", "period", "written_at", "seq")


def _author(df: DataFrame, seals: DataFrame) -> DataFrame:
    s = seals.select(F.col("seal").alias("by_seal"), F.col("principal").alias("__principal"), F.col("secret").alias("__secret"), F.col("valid_from").alias("__from"), F.col("valid_to").alias("__to"))
    return df.join(s, "by_seal", "left")


def _bad_witnesses(df: DataFrame, seals: DataFrame, key: str) -> DataFrame:
    """(key, bad): how many witnesses of an envelope were unknown or not active when it was written."""
    one = df.select(key, "written_at", F.explode("witnesses").alias("w"))
    s = seals.select(F.col("seal").alias("w"), "valid_from", "valid_to")
    ok = F.coalesce(active(F.col("valid_from"), F.col("valid_to"), F.col("written_at")), F.lit(False))
    return one.join(s, "w", "left").groupBy(key).agg(F.sum((~ok).cast("int")).alias("bad"))


def _judged(requests: DataFrame, seals: DataFrame, periods: DataFrame, key: str) -> DataFrame:
    """``requests`` with ``reason`` and their author's ``__secret``."""
    p = periods.select(F.col("period").alias("__p")).distinct()
    rows = _author(requests, seals).join(_bad_witnesses(requests, seals, key), key, "left").join(p, F.col("period") == F.col("__p"), "left")
    ok = active(F.col("__from"), F.col("__to"), F.col("written_at"))
    reason = (
        F.when(F.col("__from").isNull(), "unknown seal")
        .when(~ok, "inactive seal")
        .when(F.coalesce("bad", F.lit(0)) > 0, "inactive witness")
        .when(F.col("__p").isNull(), "unknown period")
    )
    return rows.withColumn("reason", reason).select(*requests.columns, "reason", "__secret")


def judged(requests: DataFrame, seals: DataFrame, periods: DataFrame, key: str = "request") -> DataFrame:
    """``requests`` with ``reason``: null for those that may be written, else the first rule they break."""
    return _judged(requests, seals, periods, key).drop("__secret")


def post(requests: DataFrame, seals: DataFrame, periods: DataFrame, key: str = "request", first_seq: int = 0) -> DataFrame:
    """Envelopes for the requests that may be written, numbered in order of key and signed.

    Numbers come from counts of blocks of keys, so no task sorts all requests.
    """
    good = _judged(requests, seals, periods, key).where("reason IS NULL").drop("reason").withColumn("__b", F.floor(F.col(key) / 4096))
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # a row for 4,096 requests
    base = good.groupBy("__b").agg(F.count("*").alias("c")).select("__b", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base"))
    at = F.row_number().over(Window.partitionBy("__b").orderBy(key)) - 1
    numbered = good.withColumn("__at", at).join(base, "__b").withColumn("seq", F.col("base") + F.col("__at") + first_seq)
    signed = numbered.withColumn("signature", signature(*_SIGNED, "__secret"))
    return signed.select("seq", "payload", "by_seal", "witnesses", "period", "written_at", "signature")


def who_wrote(log: DataFrame, seals: DataFrame, seq: int) -> DataFrame:
    return _author(log.where(F.col("seq") == seq), seals).select("seq", "by_seal", F.col("__principal").alias("principal"))


def writes_by_seal(log: DataFrame, seal: str) -> DataFrame:
    return log.where(F.col("by_seal") == seal)


def writes_in_period(log: DataFrame, period: str) -> DataFrame:
    return log.where(F.col("period") == period)


def replay_as_of(log: DataFrame, seals: DataFrame, ts: float | Column) -> DataFrame:
    """Writes up to ``ts`` whose seal was active when they were written and still is at ``ts``."""
    ts = ts if isinstance(ts, Column) else F.lit(ts)
    rows = _author(log, seals).where(F.col("written_at") <= ts)
    then, now = (active(F.col("__from"), F.col("__to"), t) for t in (F.col("written_at"), ts))
    return rows.where(then & now).select(*log.columns)


def verified(log: DataFrame, seals: DataFrame, as_of: float | None = None) -> DataFrame:
    """``log`` with ``valid``: the signature holds, author and witnesses were active at the write, and, if asked, the author is at ``as_of``."""
    rows = _author(log, seals).join(_bad_witnesses(log, seals, "seq"), "seq", "left")
    ok = (F.col("signature") == signature(*_SIGNED, "__secret")) & active(F.col("__from"), F.col("__to"), F.col("written_at")) & (F.coalesce("bad", F.lit(0)) == 0)
    if as_of is not None:
        ok = ok & active(F.col("__from"), F.col("__to"), F.lit(as_of))
    return rows.withColumn("valid", F.coalesce(ok, F.lit(False))).select(*log.columns, "valid")


def verify_all(log: DataFrame, seals: DataFrame) -> DataFrame:
    return verified(log, seals).agg(F.sum(F.col("valid").cast("long")).alias("valid"), F.count("*").alias("total"))


def anonymous(log: DataFrame) -> DataFrame:
    """The same writes without author, witnesses, period and signature: nothing that could answer who, when or whether."""
    return log.select("seq", "payload", "written_at")


def size_bytes(df: DataFrame) -> Column:
    """Bytes of a row as JSON."""
    return F.octet_length(F.to_json(F.struct(*df.columns)))


def overhead(log: DataFrame) -> DataFrame:
    """Bytes of the sealed and the anonymous log, and the extra tokens a write at four bytes each."""
    plain = anonymous(log)
    sealed = log.agg(F.count("*").alias("writes"), F.sum(size_bytes(log)).alias("sealed_bytes"))
    out = sealed.crossJoin(plain.agg(F.sum(size_bytes(plain)).alias("anonymous_bytes")))  # a row each
    extra = F.col("sealed_bytes") - F.col("anonymous_bytes")
    return out.select("*", F.round(100 * extra / F.col("anonymous_bytes"), 4).alias("overhead_pct"), F.round(extra / F.col("writes") / 4, 4).alias("extra_tokens"))


def latency(samples: DataFrame, value: str) -> DataFrame:
    """Median and 95th percentile by the exclusive rule: place (n + 1) q, between neighbours in proportion."""
    some = samples.select(F.col(value).alias("v"), F.monotonically_increasing_id().alias("tie"))
    placed = ranked(some, [], [F.col("v"), F.col("tie")], "r").crossJoin(F.broadcast(samples.agg(F.count("*").alias("n"))))  # one row

    def at(q: float) -> Column:
        place = (F.col("n") + 1) * q
        low = F.greatest(F.lit(1), F.least(F.floor(place), F.col("n") - 1))
        part = place - low
        return F.sum(F.when(F.col("r") == low, F.col("v") * (1 - part)).when(F.col("r") == low + 1, F.col("v") * part).otherwise(0.0))

    return placed.agg(at(0.5).alias("median"), at(0.95).alias("p95"))


def fixture(spark, children: int = 10, writes: int = 50, t0: float = 1_000.0) -> tuple[DataFrame, DataFrame, DataFrame]:  # noqa: ANN001
    """Principals (a root and its children), three periods and round-robin requests, for tests and benchmarks."""
    principals = spark.range(children + 1).select(F.concat(F.lit("p"), F.col("id")).alias("principal"), F.when(F.col("id") > 0, F.lit("p0")).alias("parent"))
    periods = spark.range(3).select(F.concat(F.lit("period-"), F.col("id")).alias("period"), F.concat(F.lit("name-"), F.col("id")).alias("name"), (F.lit(t0) + F.col("id")).alias("start_ts"))
    requests = spark.range(writes).select(
        F.col("id").alias("request"), F.concat(F.lit("payload-"), F.col("id")).alias("payload"), F.concat(F.lit("seal-p"), F.pmod("id", F.lit(children)) + 1).alias("by_seal"),
        F.array().cast("array<string>").alias("witnesses"), F.concat(F.lit("period-"), F.pmod("id", F.lit(3))).alias("period"), (F.lit(t0) + F.col("id") * 0.1).alias("written_at"),
    )
    return principals, periods, requests


def unique_periods(periods: DataFrame) -> DataFrame:
    """Names that more than one period bears; must be empty."""
    return periods.groupBy("name").agg(F.count("*").alias("n")).where("n > 1")
