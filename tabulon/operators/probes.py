"""Probes: named patterns over texts, how often they hit, and how often a hit is what its name says."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions import patterns as R
from tabulon.functions import text as X
from tabulon.functions.stats import wilson
from tabulon.operators.ranks import ranked
from tabulon.sources.shared import kept


class Probe(NamedTuple):
    name: str
    pattern: str
    role: str


class Rule(NamedTuple):
    verdict: str
    label: str
    pattern: str


def hits(df: DataFrame, probes: Sequence[Probe], genre: str, key: str, text: str, ids: int = 5) -> DataFrame:
    """For each genre and probe with a hit: texts with one, coverage, matches in all and per text, and first ids.

    Patterns are run over a text once and the counts kept, which totals, hits and first ids are then taken from; rows of hits, not
    of texts times probes, are shuffled.
    """
    counted = kept(df.select(F.col(genre).alias("genre"), F.col(key).alias("id"), F.array(*(R.count(F.col(text), p.pattern) for p in probes)).alias("ns")), "hits")
    sizes = counted.groupBy("genre").agg(F.count("*").alias("texts"))
    each = F.array(*(F.struct(F.lit(p.name).alias("probe"), F.lit(p.role).alias("role"), F.get("ns", F.lit(i)).alias("n")) for i, p in enumerate(probes)))
    found = counted.select("genre", "id", F.explode(F.filter(each, lambda x: x["n"] > 0)).alias("h"))
    out = found.groupBy("genre", "h.probe", "h.role").agg(F.count("*").alias("texts_with_hit"), F.sum("h.n").alias("total_matches"))
    first = found.select("genre", "h.probe", "id")
    from tabulon.operators.sampling import top

    lists = top(first, ["genre", "probe"], [F.asc("id")], ids).groupBy("genre", "probe").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("first_ids"))
    joined = out.join(lists, ["genre", "probe"]).join(sizes, "genre")
    return joined.select(
        "genre", "probe", "role", "texts_with_hit", F.round(F.col("texts_with_hit") * 100 / F.col("texts"), 4).alias("coverage_pct"),
        "total_matches", F.round(F.col("total_matches") / F.col("texts"), 6).alias("matches_per_text"), "first_ids",
    )


def dead(df: DataFrame, probes: Sequence[Probe], text: str) -> DataFrame:
    """Probes that hit nothing anywhere."""
    names = df.sparkSession.createDataFrame([(p.name, p.role) for p in probes], "probe string, role string")
    each = F.array(*(F.when(R.found(F.col(text), p.pattern), F.lit(p.name)) for p in probes))
    alive = df.select(F.explode(F.array_compact(each)).alias("probe")).distinct()
    return names.join(alive, "probe", "left_anti")


def matrix(df: DataFrame, probes: Sequence[Probe], genre: str, text: str) -> DataFrame:
    """Share of texts with a hit, one column a probe."""
    rates = [F.round(F.avg(F.coalesce(R.found(F.col(text), p.pattern), F.lit(False)).cast("double")), 6).alias(p.name) for p in probes]
    return df.groupBy(F.col(genre).alias("genre")).agg(F.count("*").alias("texts"), *rates)


def verdict(match: Column, rules: Sequence[Rule], default: str = "UNCLEAR") -> Column:
    """(verdict, label) of the first rule that fits; the default's label is the match's first 34 code points."""
    out = None
    for r in rules:
        hit = F.struct(F.lit(r.verdict).alias("verdict"), F.lit(r.label).alias("label"))
        out = F.when(R.found(match, r.pattern), hit) if out is None else out.when(R.found(match, r.pattern), hit)
    rest = F.struct(F.lit(default).alias("verdict"), F.substring(match, 1, 34).alias("label"))
    return rest if out is None else out.otherwise(rest)


def audit(df: DataFrame, probe: Probe, rules: Sequence[Rule], text: str, default: str = "UNCLEAR") -> DataFrame:
    """(probe, verdict, label, n) over all matches of a probe; a match is the group's text where there is one."""
    match = df.select(F.explode(R.matches(F.col(text), probe.pattern)).alias("m")).select(X.collapsed(F.col("m")).alias("m"))
    judged = match.where("m <> ''").select(verdict(F.col("m"), rules, default).alias("v"))
    return judged.groupBy("v.verdict", "v.label").agg(F.count("*").alias("n")).select(F.lit(probe.name).alias("probe"), "verdict", "label", "n")


def audits(df: DataFrame, audited: Sequence[tuple[Probe, Sequence[Rule]]], text: str, default: str = "UNCLEAR") -> DataFrame:
    """``audit`` of several probes in one pass over the texts."""

    def judged(p: Probe, rules: Sequence[Rule]) -> Column:
        some = F.filter(F.transform(R.matches(F.col(text), p.pattern), X.collapsed), lambda m: m != "")
        return F.transform(some, lambda m: F.struct(F.lit(p.name).alias("probe"), verdict(m, rules, default).alias("v")))

    found = df.select(F.explode(F.concat(*(judged(p, rules) for p, rules in audited))).alias("j"))
    return found.groupBy("j.probe", "j.v.verdict", "j.v.label").agg(F.count("*").alias("n"))


def precision(audited: DataFrame) -> DataFrame:
    """True, false and unclear matches, precision (null without either), worst case and the band of the verdict."""

    def sums(v: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("verdict") == v, F.col("n"))), F.lit(0))

    out = audited.groupBy("probe").agg(sums("TRUE").alias("n_true"), sums("FALSE").alias("n_false"), sums("UNCLEAR").alias("n_unclear"))
    known = F.col("n_true") + F.col("n_false")
    p = F.try_divide(F.col("n_true"), known)
    worst = F.try_divide(F.col("n_true"), known + F.col("n_unclear"))
    return out.select("*", F.round(p, 6).alias("precision"), F.round(worst, 6).alias("worst_case"), band(p).alias("band"))


def band(p: Column) -> Column:
    return F.when(p >= 0.95, "RELIABLE").when(p >= 0.75, "USABLE").when(p >= 0.5, "WEAK").otherwise("DO_NOT_CITE")


def graduated(p: Column, worst: Column, gold: Column) -> Column:
    """All three criteria at once: precision .95, worst case .75, gold share .90."""
    return F.coalesce((p >= 0.95) & (worst >= 0.75) & (gold >= 0.90), F.lit(False))


def stamped(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """``rows`` with the audit status and note of their probe; probes without an audit say so."""
    return rows.join(audits.select("probe", "status", "note"), "probe", "left").withColumn("status", F.coalesce("status", F.lit("NOT_AUDITED")))


def gold(lemmas: DataFrame, heads: DataFrame) -> DataFrame:
    """Precision of probe heads against annotated lemmas: (probe, tokens, accepted, precision).

    ``lemmas`` has form, cf, gw, pos; ``heads`` has probe, head and ``accept``, a SQL condition over cf, gw and pos.
    A token counts if, without subscripts, it equals the head or starts with it and a hyphen. The rule table is the small
    side of the join: it holds a row a probe.
    """
    norm = X.without_subscripts(F.col("form"))
    rules = heads.select("probe", "head", "accept").collect()
    # one bounded rule a probe, so conditions are compiled into the plan
    each = F.array(*(
        F.when((norm == r["head"]) | norm.startswith(f"{r['head']}-"), F.struct(F.lit(r["probe"]).alias("probe"), F.coalesce(F.expr(r["accept"]), F.lit(False)).alias("ok")))
        for r in rules
    ))
    judged = lemmas.select(F.explode(F.array_compact(each)).alias("j"))
    out = judged.groupBy("j.probe").agg(F.count("*").alias("tokens"), F.sum(F.col("j.ok").cast("int")).alias("accepted"))
    return out.withColumn("precision", F.round(F.col("accepted") / F.col("tokens"), 6))


def gold_detail(lemmas: DataFrame, heads: DataFrame, kinds: int = 6, readings: int = 8) -> DataFrame:
    """What the tokens behind ``gold`` are: (probe, part, value, n, rank) of the commonest parts of speech and readings.

    A reading is citation form and guide word; what is missing is a question mark. The most frequent come first, ties by value.
    """
    norm = X.without_subscripts(F.col("form"))
    known = F.broadcast(heads.select("probe", "head"))  # a row a probe
    found = lemmas.withColumn("norm", norm).withColumn("head", F.explode(F.array_distinct(F.array("norm", F.substring_index("norm", "-", 1), F.substring_index("norm", "-", 2)))))
    met = found.join(known, "head")
    blank = lambda c: F.coalesce(F.col(c), F.lit("?"))
    parts = F.explode(F.array(F.struct(F.lit("pos").alias("part"), blank("pos").alias("value")), F.struct(F.lit("reading").alias("part"), F.concat_ws(" ", blank("cf"), blank("gw")).alias("value")))).alias("x")
    counted = met.select("probe", parts).groupBy("probe", "x.part", "x.value").agg(F.count("*").alias("n"))
    placed = ranked(counted, ["probe", "part"], [F.desc("n"), F.col("value")])
    return placed.where((F.col("part") == "pos") & (F.col("rank") <= kinds) | (F.col("part") == "reading") & (F.col("rank") <= readings))


def standalone(lemmas: DataFrame, form: str, accept: Column) -> DataFrame:
    """(tokens, accepted, share) of tokens that are exactly ``form`` without subscripts."""
    own = lemmas.where(X.without_subscripts(F.col("form")) == form)
    out = own.agg(F.count("*").alias("tokens"), F.coalesce(F.sum(F.coalesce(accept, F.lit(False)).cast("long")), F.lit(0)).alias("accepted"))
    return out.withColumn("share", F.round(F.try_divide(F.col("accepted"), F.col("tokens")), 6))


def band_verdicts(banded: DataFrame, before: Sequence[str], peak: str, after: str) -> DataFrame:
    """(verdict, held): what survives at both ends of the bands of periods; null where a period is missing.

    rise: from the last of ``before`` to the peak; further: from the peak to ``after``; both again for bands that do not touch;
    envelope: the peak's above all before; steps: every step from period to period keeps its sign, 0 counting as down.
    """
    order = [*before, peak, after]
    columns = ("rate_lower", "rate_upper", "envelope_lower", "envelope_upper")
    one = banded.where(F.col("period").isin(*order)).agg(*(F.max(F.when(F.col("period") == p, F.col(c))).alias(f"{c}_{i}") for i, p in enumerate(order) for c in columns))
    at = lambda c, i: F.col(f"{c}_{i % len(order)}")
    both = lambda i, j, what="rate": (at(f"{what}_lower", i) > at(f"{what}_lower", j)) & (at(f"{what}_upper", i) > at(f"{what}_upper", j))
    n = len(order)
    every = lambda xs: reduce(lambda a, b: a & b, xs)
    rules = {
        "rise": both(n - 2, n - 3), "rise apart": at("rate_lower", n - 2) > at("rate_upper", n - 3), "further": both(n - 1, n - 2), "further apart": at("rate_lower", n - 1) > at("rate_upper", n - 2),
        "envelope": every([both(n - 2, i, "envelope") for i in range(n - 2)]),
        "steps": every([(at("rate_lower", i + 1) > at("rate_lower", i)) == (at("rate_upper", i + 1) > at("rate_upper", i)) for i in range(n - 1)]),
    }
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("verdict"), c.alias("held")) for k, c in rules.items()))).alias("x")).select("x.*")


def bands(df: DataFrame, by: str, text: str, probe: str, rules: Sequence[Rule], seal: str, least: int = 4) -> DataFrame:
    """Prevalence with its uncertainty: texts with a true match (lower), a true or unclear one (upper), any (point).

    Texts below ``least`` content lines never fire but may be sealed. Envelopes are the same with the seal present.
    """
    lines = X.content_lines(F.col(text))
    tails = F.flatten(F.transform(lines, lambda x: R.matches(x, probe)))
    marks = F.transform(F.filter(F.transform(tails, X.strip), lambda m: m != ""), lambda m: verdict(m, rules)["verdict"])
    rows = df.select(F.col(by).alias("period"), F.size(lines).alias("n_lines"), marks.alias("marks"), F.exists(lines, lambda x: R.found(x, seal)).alias("sealed"))
    fires = F.col("n_lines") >= least
    flags = {
        "point": fires & (F.size("marks") > 0),
        "lower": fires & F.array_contains("marks", "TRUE"),
        "upper": fires & (F.array_contains("marks", "TRUE") | F.array_contains("marks", "UNCLEAR")),
    }
    marked = rows.select("period", *(c.cast("int").alias(n) for n, c in flags.items()), F.col("sealed").cast("int").alias("sealed"))
    aggs = [F.count("*").alias("n")]
    for n in flags:
        aggs += [F.sum(n).alias(f"k_{n}"), F.round(F.avg(n), 4).alias(f"rate_{n}"), F.round(F.avg(F.col(n) * F.col("sealed")), 4).alias(f"envelope_{n}")]
    out = marked.groupBy("period").agg(*aggs)
    for n in ("lower", "upper"):
        ci = wilson(F.col(f"k_{n}"), F.col("n"))
        out = out.withColumns({f"ci_{n}_low": F.round(ci["low"], 4), f"ci_{n}_high": F.round(ci["high"], 4)})
    return out


def steps(banded: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adjacent periods compared at both ends of the band; a step is stable if both ends move the same way (0 counts as down)."""
    from pyspark.sql import Window

    places = F.array(*map(F.lit, order))
    at = banded.where(F.col("period").isin(*order)).withColumn("place", F.array_position(places, F.col("period")))
    w = Window.orderBy("place")  # one row a period
    lo, hi = F.col("rate_lower") - F.lag("rate_lower").over(w), F.col("rate_upper") - F.lag("rate_upper").over(w)
    out = at.select(F.lag("period").over(w).alias("from_period"), F.col("period").alias("to_period"), F.round(lo, 4).alias("step_lower"), F.round(hi, 4).alias("step_upper"))
    return out.where("from_period IS NOT NULL").withColumn("stable", (F.col("step_lower") > 0) == (F.col("step_upper") > 0))


def drifted(now: DataFrame, published: DataFrame, key: str, value: str) -> DataFrame:
    """Rows whose value differs from the published one; must be empty before any claim is renewed."""
    was = published.select(key, F.col(value).alias("published"))
    return now.select(key, F.col(value).alias("now")).join(was, key).where(~F.col("now").eqNullSafe(F.col("published")))
