"""Queries of the lexicon: its probes, audits, year rules, closers and trailers over texts of ledger lines.

Each order stands for a tablet, its lines drawn from fixed phrases by the order's key; the priority is the genre. SQL engines
read look-around and word boundaries of other letters differently or not at all, so the SQL joins what Python's ``re`` finds in
each phrase; no match runs over a line's end.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.functions import lexicon as L
from tabulon.operators import checks, permutation, probes, resampling, sampling
from tabulon.operators import segmentation as G
from tabulon.operators.probes import Probe
from tabulon.plans import inference, ledgers, segments
from tabulon.sources.readers import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Lines that probes hit, that audits tell apart, and that nothing hits.
PHRASES = (
    "kišib₃ ur-{d}nanna", "kišib₃-bi 2(diš) i₃-gal₂", "kišib lu₂-kal-la", "iti ezem-mah", "iti-ta u₄ 3(diš) ba-ra-zal",
    "mu us₂-sa ki-maš{ki} ba-hul", "mu en {d}nanna maš-e i₃-pa₃", "mu {d}šu-{d}suen lugal", "mu-na-du₃ e₂-a-ni", "mu 3(diš) še gur",
    "mu lugal-bi in-pad₃", "mu-kuₓ lugal", "mu bad₃ mar-tu ba-du₃", "mu-bi nu-sa", "šu ba-ti",
    "lu₂-{d}šara₂ šu ba-ti", "giri₃ lugal-ezem", "igi-ni-še₃ di-ku₅", "igi ur-{d}lamma-še₃", "igi 6(diš) gal₂ ku₃",
    "šu-nigin₂ 2(u) udu", "šu-nigin 1(geš₂) gu₄", "la₂-ia₃ 4(diš) še", "diri ezem-an-na", "diri 2(diš) sila₃",
    "diri-ga", "zi-ga lugal", "mu-DU {d}en-lil₂", "dumu ur-mes", "dumu-zi sipa",
    "dumu-munus lugal", "lu₂{d} nanše", "nibru{ki}", "5(diš) udu niga", "lugal kal-ga",
    "lugal-kisal-si", "lugal", "ensi₂ umma{ki}", "nita kalag-ga", "u₃-na-a-du₁₁",
    "u₃-na-de₃-tah", "nam-ti lugal-še₃", "nam-lugal an-na", "nam-en kur-ra", "e₂ {d}inanna",
    "a-ša₃ gibil", "gaba-ri", "<unk> x x",
)
#: Lines of messages, with and without trailers.
MESSAGES = ("Signed-off-by: A B <a@b.example>", "signed-off-by: c", "Reviewed-by: D", "Cc: list@lists.example", "CC: E", "Fixes: 12ab", "see Signed-off-by: above", "Co-authored-by:", "Co-authored by: F", "Tested-by: G")
YEARS = Probe("year_name_strict", L.STRICT_YEAR, "year")
AUDITED = tuple((p, L.AUDITS[p.name]) for p in L.PROBES if p.name in L.AUDITS)
FLAGS = {"seal": L.CLOSERS["seal_of_PN (kišib₃)"], "received": L.CLOSERS["received_by (šu ba-ti)"], "month": L.CLOSERS["month (iti)"], "year": L.CLOSERS["year-name (strict mu)"], "opener": L.OPENER}


def query(oracle: str | None = None):  # noqa: ANN201
    def keep(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return keep


def _quoted(v) -> str:  # noqa: ANN001
    return str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"


def _values(rows: list[tuple], names: str) -> str:
    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(_quoted, r)) + ")" for r in rows) + f") t({names}))"


def tablets(spark, d) -> DataFrame:  # noqa: ANN001
    """(id, genre, text): 3 to 7 lines a tablet."""
    phrases = F.array(*map(F.lit, PHRASES))
    k = F.col("o_orderkey").cast("long")

    def line(j):  # noqa: ANN001, ANN202
        return F.element_at(phrases, (F.pmod(k * 7 + j * 11 + F.floor(k / 32), F.lit(len(PHRASES))) + 1).cast("int"))

    lines = F.transform(F.sequence(F.lit(0).cast("long"), 2 + F.pmod(k, F.lit(5))), line)
    orders = sampling.spread(table(spark, d, "orders", ["o_orderkey", "o_orderpriority"]), "o_orderkey")  # rows are small, what is done with them is not
    return orders.select(k.alias("id"), F.col("o_orderpriority").alias("genre"), F.array_join(lines, "\n").alias("text"))


_LINES = f"(SELECT id, genre, j, (id * 7 + j * 11 + id // 32) % {len(PHRASES)} AS phrase FROM (SELECT o_orderkey::BIGINT AS id, o_orderpriority AS genre, unnest(range(0, 3 + o_orderkey % 5)) AS j FROM orders))"


def _found(pattern: str, line: str) -> list[str]:
    return [m.group(1) if m.re.groups == 1 else m.group(0) for m in re.finditer(pattern, line)]


def _counts(probes_) -> str:  # noqa: ANN001
    return _values([(i, p.name, p.role, len(hits)) for i, x in enumerate(PHRASES) for p in probes_ if (hits := _found_all(p.pattern, x))], "phrase, probe, role, n")


def _found_all(pattern: str, line: str) -> list[str]:
    return [m.group(0) for m in re.finditer(pattern, line)]


_HITS = f"""
WITH h AS (SELECT genre, id, probe, role, sum(n) AS n FROM {_LINES} JOIN {_counts(L.PROBES)} USING (phrase) GROUP BY ALL), s AS (SELECT o_orderpriority AS genre, count(*) AS texts FROM orders GROUP BY 1)
SELECT genre, probe, role, count(*) AS texts_with_hit, round(count(*) * 100 / any_value(texts), 4) AS coverage_pct, sum(n)::BIGINT AS total_matches,
       round(sum(n) / any_value(texts), 6) AS matches_per_text, array_to_string(list_sort(list(id))[1:5], ',') AS first_ids
FROM h JOIN s USING (genre) GROUP BY genre, probe, role"""


@query(_HITS)
def ledger_probe_hits(spark, d):  # noqa: ANN001, ANN201
    return probes.hits(tablets(spark, d), L.PROBES, "genre", "id", "text")


def _share(p: Probe) -> tuple[str, str]:
    fit = [str(i) for i, x in enumerate(PHRASES) if re.search(p.pattern, x)] or ["-1"]
    return f"round(avg((hit_{L.PREVALENCE.index(p)})::INT), 6) AS \"{p.name}\"", f"bool_or(phrase IN ({', '.join(fit)})) AS hit_{L.PREVALENCE.index(p)}"


_SHARES = [_share(p) for p in L.PREVALENCE]


@query(f"SELECT genre, count(*) AS texts, {', '.join(a for a, _ in _SHARES)} FROM (SELECT genre, id, {', '.join(b for _, b in _SHARES)} FROM {_LINES} GROUP BY genre, id) GROUP BY genre")
def ledger_prevalence(spark, d):  # noqa: ANN001, ANN201
    return probes.matrix(tablets(spark, d), L.PREVALENCE, "genre", "text")


def _judged(pairs) -> str:  # noqa: ANN001
    """What Python's ``re`` makes of each match in each phrase."""
    rows: dict[tuple, int] = {}
    for i, line in enumerate(PHRASES):
        for p, rules in pairs:
            for m in (" ".join(x.split()) for x in _found(p.pattern, line)):
                if m:
                    fit = next(((r.verdict, r.label) for r in rules if re.search(r.pattern, m)), ("UNCLEAR", m[:34]))
                    rows[(i, p.name, *fit)] = rows.get((i, p.name, *fit), 0) + 1
    return f"SELECT probe, verdict, label, sum(n)::BIGINT AS n FROM {_LINES} JOIN {_values([(*k, n) for k, n in rows.items()], 'phrase, probe, verdict, label, n')} USING (phrase) GROUP BY ALL"


_AUDITS = _judged(AUDITED)


@query(_AUDITS)
def ledger_audits(spark, d):  # noqa: ANN001, ANN201
    return probes.audits(tablets(spark, d), AUDITED, "text")


@query(_judged(((YEARS, L.STRICT_RULES),)))
def strict_years(spark, d):  # noqa: ANN001, ANN201
    return probes.audit(tablets(spark, d), YEARS, L.STRICT_RULES, "text")


_PRECISION = f"""
SELECT probe, n_true, n_false, n_unclear, round(p, 6) AS precision, round(n_true / nullif(n_true + n_false + n_unclear, 0), 6) AS worst_case,
       CASE WHEN p >= 0.95 THEN 'RELIABLE' WHEN p >= 0.75 THEN 'USABLE' WHEN p >= 0.5 THEN 'WEAK' ELSE 'DO_NOT_CITE' END AS band
FROM (SELECT *, n_true / nullif(n_true + n_false, 0) AS p FROM (
  SELECT probe, coalesce(sum(n) FILTER (verdict = 'TRUE'), 0)::BIGINT AS n_true, coalesce(sum(n) FILTER (verdict = 'FALSE'), 0)::BIGINT AS n_false, coalesce(sum(n) FILTER (verdict = 'UNCLEAR'), 0)::BIGINT AS n_unclear
  FROM ({_AUDITS}) GROUP BY probe))"""


@query(_PRECISION)
def ledger_verdicts(spark, d):  # noqa: ANN001, ANN201
    return probes.precision(ledger_audits(spark, d))


_GOLD = ledgers.ORACLES["gold_lemma_precision"]


@query(f"SELECT v.probe, v.precision, v.worst_case, g.precision AS gold, coalesce(v.precision >= 0.95 AND v.worst_case >= 0.75 AND g.precision >= 0.90, false) AS graduated FROM ({_PRECISION}) v JOIN ({_GOLD}) g USING (probe)")
def ledger_graduation(spark, d):  # noqa: ANN001, ANN201
    """Probes by all three criteria, the gold share from annotated lemmas."""
    gold = ledgers.gold_lemma_precision(spark, d).select("probe", F.col("precision").alias("gold"))
    both = ledger_verdicts(spark, d).join(gold, "probe")
    return both.select("probe", "precision", "worst_case", "gold", probes.graduated(F.col("precision"), F.col("worst_case"), F.col("gold")).alias("graduated"))


# Lines before the last, those in every third place being the ones before a ruling.
_flag = lambda pattern: "phrase IN (" + ", ".join([str(i) for i, x in enumerate(PHRASES) if re.search(pattern, x)] or ["-1"]) + ")"
_INTERIOR = f"SELECT genre, id AS doc, j::INT AS i, n, (id + j) % 3 = 0 AS pre, {', '.join(f'{_flag(p)} AS {f}' for f, p in FLAGS.items())} FROM (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM {_LINES}) WHERE j < n - 1"


def _flagged(spark, d) -> DataFrame:  # noqa: ANN001
    """Lines before the last of each tablet with a column for each closer and the opener; every third stands before a ruling."""
    lines = tablets(spark, d).select("id", "genre", F.split("text", "\n").alias("ls")).select("id", "genre", F.size("ls").alias("n"), F.posexplode("ls").alias("i", "line")).where("i < n - 1")
    flags = [F.col("line").rlike(probes.R.portable(p)).alias(f) for f, p in FLAGS.items()]
    return lines.select("genre", F.col("id").alias("doc"), "i", "n", ((F.col("id") + F.col("i")) % 3 == 0).alias("pre"), *flags)


@query(inference.enrichment_sql("genre, doc", "", _INTERIOR, FLAGS))
def lexicon_enrichment(spark, d):  # noqa: ANN001, ANN201
    """Closers before rulings against hashed places in the same tablet; the opener is the control that must not be enriched."""
    flagged = lambda x, i: F.struct(i.alias("i"), (F.pmod(F.col("id") + i, F.lit(3)) == 0).alias("pre"), *(x.rlike(probes.R.portable(p)).alias(f) for f, p in FLAGS.items()))
    ls = tablets(spark, d).select("genre", "id", F.split("text", "\n").alias("ls"))
    docs = ls.select("genre", F.col("id").alias("doc"), F.transform(F.slice("ls", 1, F.size("ls") - 1), flagged).alias("ls"))
    return permutation.enrichment(docs, tuple(FLAGS), inference.REPS)


@query()
def lexicon_enrichment_whole(spark, d):  # noqa: ANN001, ANN201
    """The same against 10,000 sets of places, drawn from the counts of tablets."""
    return resampling.enrichment(_flagged(spark, d), tuple(FLAGS), 10_000)


_TRAILERS = _values([(i, x, "true" if re.match(L.TRAILER, x) else "false") for i, x in enumerate(MESSAGES)], "i, line, trailer")


@query(f"SELECT line, trailer = 'true' AS trailer, count(*) AS n FROM orders JOIN {_TRAILERS} ON o_orderkey % {len(MESSAGES)} = i GROUP BY ALL")
def trailer_lines(spark, d):  # noqa: ANN001, ANN201
    at = (F.pmod("o_orderkey", F.lit(len(MESSAGES))) + 1).cast("int")
    lines = table(spark, d, "orders", ["o_orderkey"]).select(F.element_at(F.array(*map(F.lit, MESSAGES)), at).alias("line"))
    return lines.select("line", probes.R.found(F.col("line"), L.TRAILER).alias("trailer")).groupBy("line", "trailer").agg(F.count("*").alias("n"))


#: What results of segmentation must keep to before they are stated again; pk of a method, lower is better.
INVARIANTS = {"marker no worse than equal": "marker <= equal", "marker alone no worse than lexical": "marker_k <= lex_thresh", "lexical within .015 of equal": "abs(lex_thresh - equal) < 0.015"}
_PIVOT = ", ".join(f"avg(pk) FILTER (method = '{m}') AS {m}" for m in ("equal", "marker", "marker_k", "lex_thresh", "length_prior"))
_BOOLS = " UNION ALL ".join(f"SELECT '{n}' AS rule, 1::BIGINT AS checked, (NOT coalesce({c}, false))::BIGINT AS failed, coalesce({c}, false) AS held FROM m" for n, c in INVARIANTS.items())


@query(f"WITH m AS (SELECT {_PIVOT} FROM (SELECT method, round(avg(pk), 6) AS pk FROM ({segments._SCORED}) GROUP BY method)) {_BOOLS}")
def result_invariants(spark, d):  # noqa: ANN001, ANN201
    """Verdicts fixed beforehand, as conditions over the table of means."""
    means = G.summary(segments.scores(spark, d)).groupBy().pivot("method", ["equal", "marker", "marker_k", "lex_thresh", "length_prior"]).agg(F.avg("pk"))
    return checks.assertions(means, {n: F.expr(c) for n, c in INVARIANTS.items()})
