"""Queries over documents and pages: counts, samples, structure, templates, probes, spectra.

``lang`` stands for genre and ``source`` for period.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.functions import text as X
from tabulon.operators import checks, describe, probes, sampling, substrings
from tabulon.operators.probes import Probe, Rule
from tabulon.sources.readers import table
from tabulon.sources.shared import kept
from tabulon.sources.sinks import leaked_lines

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: ASCII probes, which every engine's patterns read alike.
TEST_PROBES = (
    Probe("license_line", r"[Ll]icensed under [^\n]{0,40}", "license"),
    Probe("email", r"[a-z0-9.]+@[a-z0-9.]+\.[a-z]+", "contact"),
    Probe("token", r"token = [^\n]{0,30}", "secret"),
    Probe("digits", r"[0-9]{4,}", "number"),
    Probe("shout", r"[A-Z]{3,}!!", "noise"),
    Probe("pipe", r" \| ", "layout"),
    Probe("never", r"zzzz-never-zzzz", "absent"),
)
LICENSE_RULES = (
    Rule("TRUE", "named licence", r"Apache|MIT|GNU"),
    Rule("FALSE", "non-commercial", r"NC"),
)
THE = Probe("the_word", r"the [a-z]+", "article")
THE_RULES = (Rule("FALSE", "article twice", r"^the the$"), Rule("TRUE", "th- word", r"^the th"), Rule("FALSE", "e- word", r"^the e"))
PERIODS = tuple(f"src{i}" for i in range(20))
_MARK = "licensed under"


def query(oracle: str | None = None):  # noqa: ANN201
    """Register a function (spark, sf_dir) under its name."""

    def keep(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return keep


def _docs(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return table(spark, d, "documents", columns or ("doc_id", "text", "lang", "source"))


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join("'" + str(x).replace("'", "''") + "'" for x in r) + ")" for r in rows)


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source")
def genre_period_counts(spark, d):  # noqa: ANN001, ANN201
    return describe.counts(_docs(spark, d, "lang", "source"), "lang", "source")


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang ORDER BY n DESC, lang LIMIT 10")
def top_labels(spark, d):  # noqa: ANN001, ANN201
    return describe.counts(_docs(spark, d, "lang"), "lang").orderBy(F.desc("n"), "lang").limit(10)


@query("SELECT trim(string_split(coalesce(p_type, 'Unknown'), ' ')[1]) AS label, count(*) AS n FROM part GROUP BY 1")
def primary_label(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "part", ["p_type"]).groupBy(X.primary_label(F.col("p_type"), " ").alias("label")).agg(F.count("*").alias("n"))


@query(r"SELECT doc_id, length(regexp_replace(regexp_replace(text, '<[A-Z_]+>', '', 'g'), '[^\x{C0}-\x{24F}]', '', 'g')) AS points FROM documents WHERE length(regexp_replace(text, '[^\x{C0}-\x{24F}]', '', 'g')) > 0")
def char_class_count(spark, d):  # noqa: ANN001, ANN201
    rows = _docs(spark, d, "doc_id", "text").select("doc_id", X.class_count(F.col("text"), r"[\x{C0}-\x{24F}]").cast("long").alias("points"))
    return rows.where("points > 0")


_RANKED = "row_number() OVER (PARTITION BY {by} ORDER BY md5('{seed}|' || doc_id), doc_id)"


@query(f"SELECT doc_id, lang FROM (SELECT doc_id, lang, {_RANKED.format(by='lang', seed=42)} AS r FROM documents) WHERE r <= 50")
def stratified_sample(spark, d):  # noqa: ANN001, ANN201
    return sampling.stratified(_docs(spark, d, "doc_id", "lang"), "lang", "doc_id", 50)


@query(f"""
WITH cuts AS (SELECT lang, count(*) FILTER (n_chars > 20000) AS many, quantile_cont(n_chars, 0.75) AS q75 FROM documents GROUP BY lang),
kept AS (SELECT doc_id, d.lang, n_chars FROM documents d JOIN cuts USING (lang) WHERE CASE WHEN many >= 25 THEN n_chars > 20000 ELSE n_chars >= q75 END)
SELECT doc_id, lang, n_chars FROM (SELECT *, {_RANKED.format(by='lang', seed=42)} AS r FROM kept) WHERE r <= 50""")
def longform_sample(spark, d):  # noqa: ANN001, ANN201
    return sampling.long_form(_docs(spark, d, "doc_id", "lang", "n_chars"), "lang", "doc_id", "n_chars", floor=20_000)


@query(f"SELECT doc_id, lang FROM (SELECT doc_id, lang, {_RANKED.format(by='lang', seed=7)} AS r FROM documents) WHERE lang <> 'en' OR r <= 100")
def capped_stratum(spark, d):  # noqa: ANN001, ANN201
    docs = _docs(spark, d, "doc_id", "lang")
    capped = sampling.stratified(docs.where("lang = 'en'"), "lang", "doc_id", 100, seed=7)
    return capped.unionByName(docs.where("lang <> 'en'"))


@query("SELECT lang, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) % 2 AS half, doc_id FROM documents")
def holdout_parity(spark, d):  # noqa: ANN001, ANN201
    return sampling.parity(_docs(spark, d, "doc_id", "lang"), "lang", "doc_id").select("lang", F.col("half").cast("long").alias("half"), "doc_id")


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS place FROM (SELECT doc_id FROM documents ORDER BY md5('11|' || doc_id), doc_id LIMIT 40)")
def ordered_subset(spark, d):  # noqa: ANN001, ANN201
    from pyspark.sql import Window

    from tabulon.functions.stats import digest

    some = _docs(spark, d, "doc_id").orderBy(digest(11, F.col("doc_id").cast("string")), "doc_id").limit(40)
    return some.select("doc_id", F.row_number().over(Window.orderBy("doc_id")).cast("long").alias("place"))


@query("""
WITH t AS (SELECT coalesce(nullif(regexp_extract(url, '/(en|fr|de|es)/', 1), ''), 'none') AS genre, html FROM pages),
c AS (SELECT genre, len(string_split(html, '<p>')) - 1 AS p, len(string_split(html, '<li>')) - 1 AS li, len(string_split(html, chr(10))) AS lines,
             list_filter(list_transform(string_split(html, '<p>'), lambda x: len(regexp_extract_all(x, '[A-Z]'))), lambda n: n > 0) AS pts FROM t)
SELECT genre, count(*) AS texts, round(avg(lines), 3) AS mean_lines, round(sum(list_sum(pts)) / sum(len(pts)), 3) AS mean_chunk_points,
       sum(p)::BIGINT AS n_p, sum(li)::BIGINT AS n_li, round(avg(p), 3) AS p_per_text, round(avg(li), 3) AS li_per_text FROM c GROUP BY genre""")
def structural_stats(spark, d):  # noqa: ANN001, ANN201
    found = F.regexp_extract("url", "/(en|fr|de|es)/", 1)
    pages = table(spark, d, "pages", ["url", "html"]).withColumn("genre", F.when(found != "", found).otherwise("none"))
    return describe.structural_stats(pages, "genre", "html", ("<p>", "<li>"), "[A-Z]", "<p>")


_LINES = r"list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"
_PLAIN = f"list_filter({_LINES}, lambda x: NOT regexp_matches(x, '<(SURFACE|COLUMN|RULING|BLANK_SPACE|unk)>'))"
_MORPH = r"list_filter(string_split_regex(regexp_replace({x}, '\d+\([a-zA-Z₀-₉]+\)', '<N>', 'g'), '\s+'), lambda x: x <> '' AND x <> '<unk>')"
_WORDS = r"list_filter(string_split_regex(coalesce({x}, ''), '\s+'), lambda x: x <> '')"


@query(f"""
WITH l AS (SELECT lang AS genre, {_PLAIN} AS ls FROM documents),
h AS (SELECT genre, array_to_string({_MORPH.format(x="ls[1]")}[1:3], ' ') AS opening, array_to_string({_MORPH.format(x="ls[-1]")}[1:3], ' ') AS closing FROM l WHERE len(ls) > 0),
b AS (SELECT genre, 'opening' AS place, opening AS template FROM h UNION ALL SELECT genre, 'closing', closing FROM h WHERE closing <> opening),
c AS (SELECT genre, place, template, count(*) AS n FROM b WHERE template <> '' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY genre, place ORDER BY n DESC, template) AS rank FROM c)
SELECT * FROM r WHERE rank <= 15""")
def position_templates(spark, d):  # noqa: ANN001, ANN201
    return describe.position_templates(_docs(spark, d, "text", "lang"), "lang", "text").withColumn("rank", F.col("rank").cast("long"))


def _distinctive_sql(n: int) -> str:
    return f"""
WITH l AS (SELECT lang AS genre, unnest({_PLAIN}) AS line FROM documents),
m AS (SELECT genre, {_MORPH.format(x="line")} AS t FROM l),
g AS (SELECT genre, unnest(list_transform(range(1, len(t) - {n} + 2), lambda i: array_to_string(t[i:i + {n - 1}], ' '))) AS ngram FROM m),
c AS (SELECT genre, ngram, count(*) AS freq FROM g GROUP BY ALL),
tot AS (SELECT genre, sum(freq) AS total FROM c GROUP BY genre),
w AS (SELECT c.*, sum(freq) OVER (PARTITION BY ngram) AS freq_all, total, (SELECT sum(total) FROM tot) AS al FROM c JOIN tot USING (genre)),
s AS (SELECT genre, ngram, freq, (freq_all - freq)::BIGINT AS freq_others,
             round(ln((freq::DOUBLE / greatest(total, 1)::DOUBLE) / ((freq_all - freq + 1)::DOUBLE / ((CASE WHEN al - total = 0 THEN 1 ELSE al - total END) + 1)::DOUBLE)), 6) AS score FROM w WHERE freq >= 5)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY genre ORDER BY score DESC, freq DESC, ngram) AS rank FROM s) WHERE rank <= 30"""


def _distinctive(spark, d, n):  # noqa: ANN001, ANN202
    out = describe.distinctive(describe.ngram_counts(_docs(spark, d, "text", "lang"), "lang", "text", n))
    return out.withColumn("rank", F.col("rank").cast("long"))


@query(_distinctive_sql(2))
def distinctive_bigrams(spark, d):  # noqa: ANN001, ANN201
    return _distinctive(spark, d, 2)


@query(_distinctive_sql(3))
def distinctive_trigrams(spark, d):  # noqa: ANN001, ANN201
    return _distinctive(spark, d, 3)


_COUNTS = " UNION ALL ".join(f"SELECT lang AS genre, doc_id, '{p.name}' AS probe, '{p.role}' AS role, len(regexp_extract_all(text, '{p.pattern}')) AS n FROM documents" for p in TEST_PROBES)
_HITS_SQL = rf"""
WITH h AS (SELECT * FROM ({_COUNTS}) WHERE n > 0), s AS (SELECT lang AS genre, count(*) AS texts FROM documents GROUP BY 1)
SELECT genre, probe, role, count(*) AS texts_with_hit, round(count(*) * 100 / any_value(texts), 4) AS coverage_pct, sum(n)::BIGINT AS total_matches,
       round(sum(n) / any_value(texts), 6) AS matches_per_text, array_to_string(list_sort(list(doc_id ORDER BY doc_id))[1:5], ',') AS first_ids
FROM h JOIN s USING (genre) GROUP BY genre, probe, role"""


@query(_HITS_SQL)
def probe_hits(spark, d):  # noqa: ANN001, ANN201
    return probes.hits(_docs(spark, d, "doc_id", "text", "lang"), TEST_PROBES, "lang", "doc_id", "text")


@query("SELECT lang AS genre, count(*) AS texts, " + ", ".join(f"round(avg(regexp_matches(text, '{p.pattern}')::INT), 6) AS {p.name}" for p in TEST_PROBES) + " FROM documents GROUP BY lang")
def probe_prevalence(spark, d):  # noqa: ANN001, ANN201
    return probes.matrix(_docs(spark, d, "text", "lang"), TEST_PROBES, "lang", "text")


@query(" UNION ALL ".join(f"SELECT '{p.name}' AS probe, '{p.role}' AS role WHERE NOT EXISTS (SELECT 1 FROM documents WHERE regexp_matches(text, '{p.pattern}'))" for p in TEST_PROBES))
def dead_probes(spark, d):  # noqa: ANN001, ANN201
    return probes.dead(_docs(spark, d, "text"), TEST_PROBES, "text")


@query(f"""
WITH probe AS (SELECT genre, 'probe' AS kind, probe AS template, total_matches AS n FROM ({_HITS_SQL})),
b AS (SELECT genre, 'bigram' AS kind, ngram AS template, freq AS n FROM ({_distinctive_sql(2)}) WHERE rank <= 10),
t AS (SELECT genre, 'trigram' AS kind, ngram AS template, freq AS n FROM ({_distinctive_sql(3)}) WHERE rank <= 10),
p AS (SELECT genre, place AS kind, template, n FROM ({ORACLES['position_templates']}) WHERE rank <= 5)
SELECT * FROM probe UNION ALL SELECT * FROM b UNION ALL SELECT * FROM t UNION ALL SELECT * FROM p""")
def template_catalog(spark, d):  # noqa: ANN001, ANN201
    return describe.template_catalog(probe_hits(spark, d), distinctive_bigrams(spark, d), distinctive_trigrams(spark, d), position_templates(spark, d))


def _case(rules, m: str) -> str:  # noqa: ANN001
    whens = " ".join(f"WHEN regexp_matches({m}, '{r.pattern}') THEN {{'v': '{r.verdict}', 'l': '{r.label}'}}" for r in rules)
    return f"CASE {whens} ELSE {{'v': 'UNCLEAR', 'l': left({m}, 34)}} END"


_BUCKETS = " UNION ALL ".join(
    f"SELECT '{p.name}' AS probe, j.v AS verdict, j.l AS label, count(*) AS n FROM (SELECT {_case(rules, 'm')} AS j FROM (SELECT unnest(regexp_extract_all(text, '{p.pattern}')) AS m FROM documents)) GROUP BY ALL"
    for p, rules in ((TEST_PROBES[0], LICENSE_RULES), (THE, THE_RULES))
)


@query(_BUCKETS)
def probe_precision_buckets(spark, d):  # noqa: ANN001, ANN201
    docs = _docs(spark, d, "text")
    return probes.audit(docs, TEST_PROBES[0], LICENSE_RULES, "text").unionByName(probes.audit(docs, THE, THE_RULES, "text"))


_VERDICTS = f"""
SELECT probe, n_true, n_false, n_unclear, round(p, 6) AS precision, round(n_true / (n_true + n_false + n_unclear), 6) AS worst_case,
       CASE WHEN p >= 0.95 THEN 'RELIABLE' WHEN p >= 0.75 THEN 'USABLE' WHEN p >= 0.5 THEN 'WEAK' ELSE 'DO_NOT_CITE' END AS band
FROM (SELECT *, n_true / nullif(n_true + n_false, 0) AS p FROM (
  SELECT probe, coalesce(sum(n) FILTER (verdict = 'TRUE'), 0)::BIGINT AS n_true, coalesce(sum(n) FILTER (verdict = 'FALSE'), 0)::BIGINT AS n_false, coalesce(sum(n) FILTER (verdict = 'UNCLEAR'), 0)::BIGINT AS n_unclear
  FROM ({_BUCKETS}) GROUP BY probe))"""


@query(_VERDICTS)
def probe_verdicts(spark, d):  # noqa: ANN001, ANN201
    return probes.precision(probe_precision_buckets(spark, d))


@query(f"SELECT probe, precision, worst_case, coalesce(precision >= 0.95 AND worst_case >= 0.75 AND 0.92 >= 0.90, false) AS graduated FROM ({_VERDICTS})")
def probe_graduation(spark, d):  # noqa: ANN001, ANN201
    out = probe_verdicts(spark, d)
    return out.select("probe", "precision", "worst_case", probes.graduated(F.col("precision"), F.col("worst_case"), F.lit(0.92)).alias("graduated"))


_AUDITS = (("shout", "DO_NOT_CITE", "noise"), ("license_line", "PRECISION_VALIDATED", "fixed formula"), ("never", "NEVER_FIRES", "absent"))


@query(f"SELECT h.genre, h.probe, h.total_matches, coalesce(a.status, 'NOT_AUDITED') AS status, a.note FROM ({_HITS_SQL}) h LEFT JOIN (VALUES {_values(list(_AUDITS))}) a(probe, status, note) USING (probe)")
def audit_stamps(spark, d):  # noqa: ANN001, ANN201
    audits = spark.createDataFrame(list(_AUDITS), "probe string, status string, note string")
    return probes.stamped(probe_hits(spark, d).select("genre", "probe", "total_matches"), audits)


@query(f"SELECT probe, status FROM ({ORACLES['audit_stamps']}) WHERE probe IN ('shout') AND status <> 'DO_NOT_CITE'")
def stamp_check(spark, d):  # noqa: ANN001, ANN201
    audits = spark.createDataFrame(list(_AUDITS), "probe string, status string, note string")
    return checks.unstamped(audit_stamps(spark, d), audits).select("probe", "status")


_CONTENT = f"list_filter({_LINES}, lambda x: NOT regexp_matches(x, '^<[A-Z_]+>$'))"
BAND_PROBE, BAND_SEAL = r"[Ll]icensed under (?:the )?([^\n]{0,80})", r"[A-Z]{3,}"
_BAND_SQL = rf"""
WITH d AS (SELECT source AS period, {_CONTENT} AS ls FROM documents),
m AS (SELECT period, len(ls) AS nl, len(list_filter(ls, lambda x: regexp_matches(x, '{BAND_SEAL}'))) > 0 AS sealed,
             list_transform(list_filter(flatten(list_transform(ls, lambda x: regexp_extract_all(x, '{BAND_PROBE}', 1))), lambda x: trim(x) <> ''), lambda x: ({_case(LICENSE_RULES, 'trim(x)')}).v) AS v FROM d),
f AS (SELECT period, sealed::INT AS s, (nl >= 4 AND len(v) > 0)::INT AS point, (nl >= 4 AND list_contains(v, 'TRUE'))::INT AS lower, (nl >= 4 AND (list_contains(v, 'TRUE') OR list_contains(v, 'UNCLEAR')))::INT AS upper FROM m),
a AS (SELECT period, count(*) AS n, sum(point)::BIGINT AS k_point, sum(lower)::BIGINT AS k_lower, sum(upper)::BIGINT AS k_upper, avg(point) AS rp, avg(lower) AS rl, avg(upper) AS ru, avg(point * s) AS ep, avg(lower * s) AS el, avg(upper * s) AS eu FROM f GROUP BY period),
w AS (SELECT *, 1 + 1.96 * 1.96 / n::DOUBLE AS dd, 1.96::DOUBLE AS z FROM a)
SELECT period, n, k_point, round(rp, 4) AS rate_point, round(ep, 4) AS envelope_point, k_lower, round(rl, 4) AS rate_lower, round(el, 4) AS envelope_lower, k_upper, round(ru, 4) AS rate_upper, round(eu, 4) AS envelope_upper,
  round(greatest(0, ((rl + z * z / (2 * n)) / dd) - z * sqrt(rl * (1 - rl) / n + z * z / (4 * n * n)) / dd), 4) AS ci_lower_low, round(least(1, ((rl + z * z / (2 * n)) / dd) + z * sqrt(rl * (1 - rl) / n + z * z / (4 * n * n)) / dd), 4) AS ci_lower_high,
  round(greatest(0, ((ru + z * z / (2 * n)) / dd) - z * sqrt(ru * (1 - ru) / n + z * z / (4 * n * n)) / dd), 4) AS ci_upper_low, round(least(1, ((ru + z * z / (2 * n)) / dd) + z * sqrt(ru * (1 - ru) / n + z * z / (4 * n * n)) / dd), 4) AS ci_upper_high
FROM w"""


@query(_BAND_SQL)
def band_prevalence(spark, d):  # noqa: ANN001, ANN201
    return probes.bands(_docs(spark, d, "text", "source"), "source", "text", BAND_PROBE, LICENSE_RULES, BAND_SEAL)


@query(rf"""
WITH b AS (SELECT *, substr(period, 4)::INT AS place FROM ({_BAND_SQL}) WHERE regexp_matches(period, '^src[0-9]+$')),
s AS (SELECT lag(period) OVER w AS from_period, period AS to_period, round(rate_lower - lag(rate_lower) OVER w, 4) AS step_lower, round(rate_upper - lag(rate_upper) OVER w, 4) AS step_upper FROM b WINDOW w AS (ORDER BY place))
SELECT *, (step_lower > 0) = (step_upper > 0) AS stable FROM s WHERE from_period IS NOT NULL""")
def band_steps(spark, d):  # noqa: ANN001, ANN201
    return probes.steps(band_prevalence(spark, d), PERIODS)


_ERAS = ("src0", "src1", "src2", "src3", "src4")
_AT = {p: f"max({{c}}) FILTER (period = '{p}')" for p in _ERAS}


def _band_at(*columns: str) -> str:
    return ", ".join(f"{_AT[p].format(c=c)} AS {c}_{i}" for i, p in enumerate(_ERAS) for c in columns)


_BAND_VERDICTS = {
    "rise": "rate_lower_3 > rate_lower_2 AND rate_upper_3 > rate_upper_2", "rise apart": "rate_lower_3 > rate_upper_2", "further": "rate_lower_4 > rate_lower_3 AND rate_upper_4 > rate_upper_3", "further apart": "rate_lower_4 > rate_upper_3",
    "envelope": " AND ".join(f"envelope_lower_3 > envelope_lower_{i} AND envelope_upper_3 > envelope_upper_{i}" for i in range(3)),
    "steps": " AND ".join(f"(rate_lower_{i + 1} > rate_lower_{i}) = (rate_upper_{i + 1} > rate_upper_{i})" for i in range(4)),
}


@query(f"WITH o AS (SELECT {_band_at('rate_lower', 'rate_upper', 'envelope_lower', 'envelope_upper')} FROM ({_BAND_SQL})) " + " UNION ALL ".join(f"SELECT '{k}' AS verdict, ({c}) AS held FROM o" for k, c in _BAND_VERDICTS.items()))
def band_verdicts(spark, d):  # noqa: ANN001, ANN201
    """Five sources as periods: which claims about rises and the peak hold at both ends of the band."""
    return probes.band_verdicts(band_prevalence(spark, d), _ERAS[:3], _ERAS[3], _ERAS[4])


@query(f"SELECT period, k_point AS now, k_point + 1 AS published FROM ({_BAND_SQL}) WHERE period IN ('src1', 'src2')")
def drift_guard(spark, d):  # noqa: ANN001, ANN201
    now = band_prevalence(spark, d)
    moved = now.withColumn("k_point", F.col("k_point") + F.col("period").isin("src1", "src2").cast("int"))
    return probes.drifted(now, moved, "period", "k_point")


@query(r"""
WITH j AS (SELECT quality, toxic, regexp_matches(text, '[A-Z]{3,}!!|%%%|###') AS noise, regexp_matches(text, 'scum|pathetic') AS slur FROM labels JOIN documents USING (doc_id)),
u AS (SELECT 'noise' AS probe, quality = 0 AS ok FROM j WHERE noise UNION ALL SELECT 'slur', toxic = 1 FROM j WHERE slur)
SELECT probe, count(*) AS tokens, sum(ok::INT)::BIGINT AS accepted, round(sum(ok::INT) / count(*), 6) AS precision FROM u GROUP BY probe""")
def gold_precision(spark, d):  # noqa: ANN001, ANN201
    rows = table(spark, d, "labels").join(_docs(spark, d, "doc_id", "text"), "doc_id")
    each = F.array(
        F.when(F.col("text").rlike("[A-Z]{3,}!!|%%%|###"), F.struct(F.lit("noise").alias("probe"), (F.col("quality") == 0).alias("ok"))),
        F.when(F.col("text").rlike("scum|pathetic"), F.struct(F.lit("slur").alias("probe"), (F.col("toxic") == 1).alias("ok"))),
    )
    out = rows.select(F.explode(F.array_compact(each)).alias("j")).groupBy("j.probe").agg(F.count("*").alias("tokens"), F.sum(F.col("j.ok").cast("int")).alias("accepted"))
    return out.withColumn("precision", F.round(F.col("accepted") / F.col("tokens"), 6))


_TOKENS = f"list_filter({_WORDS.format(x='text')}, lambda x: x NOT IN ('<SURFACE>', '<COLUMN>', '<RULING>', '<BLANK_SPACE>', '<unk>'))"
_SPECTRUM = f"SELECT genre, token, freq, row_number() OVER (PARTITION BY genre ORDER BY freq DESC, token) AS rank FROM (SELECT lang AS genre, token, count(*) AS freq FROM (SELECT lang, unnest({_TOKENS}) AS token FROM documents) GROUP BY ALL)"


def _tokens(spark, d):  # noqa: ANN001, ANN202
    return _docs(spark, d, "text", "lang").select(F.col("lang").alias("genre"), F.explode(X.tokens(F.col("text"))).alias("token"))


@query(f"SELECT * FROM ({_SPECTRUM}) WHERE rank <= 100")
def token_spectrum(spark, d):  # noqa: ANN001, ANN201
    return describe.spectrum(_tokens(spark, d)).where("rank <= 100").withColumn("rank", F.col("rank").cast("long"))


_ZIPF = "SELECT {by}, count(*) AS types, CASE WHEN count(*) >= 5 THEN round(-regr_slope(ln(freq), ln(rank)), 6) END AS exponent, CASE WHEN count(*) >= 5 THEN round(regr_r2(ln(freq), ln(rank)), 6) END AS r2 FROM ({src}) GROUP BY {by}"


@query(_ZIPF.format(by="genre", src=_SPECTRUM))
def zipf_fit(spark, d):  # noqa: ANN001, ANN201
    return describe.zipf(describe.spectrum(_tokens(spark, d)))


@query(f"SELECT genre, count(*) AS tail, CASE WHEN count(*) >= 10 THEN round(1 + count(*) / sum(ln(freq / 1.5::DOUBLE)), 6) END AS alpha FROM ({_SPECTRUM}) WHERE freq >= 2 GROUP BY genre")
def hill_alpha(spark, d):  # noqa: ANN001, ANN201
    return describe.hill(describe.spectrum(_tokens(spark, d)))


_STREAM = f"""
SELECT lang AS genre, base + i AS seq, token FROM (
  SELECT lang, base, unnest(ts) AS token, unnest(range(0, len(ts))) AS i FROM (
    SELECT lang, ts, coalesce(sum(len(ts)) OVER (PARTITION BY lang ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base FROM (SELECT lang, doc_id, {_TOKENS} AS ts FROM documents)))"""


def _token_texts(spark, d):  # noqa: ANN001, ANN202
    return describe.token_texts(_docs(spark, d, "doc_id", "text", "lang"), "lang", "doc_id", "text")


def _stream(spark, d):  # noqa: ANN001, ANN202
    return describe.token_stream(_docs(spark, d, "doc_id", "text", "lang"), "lang", "doc_id", "text")


@query(f"SELECT genre, count(*) AS tokens, max(seq) AS last, sum(CASE WHEN seq % 1000 = 0 THEN length(token) ELSE 0 END)::BIGINT AS probe FROM ({_STREAM}) GROUP BY genre")
def genre_stream(spark, d):  # noqa: ANN001, ANN201
    return _stream(spark, d).groupBy("genre").agg(F.count("*").alias("tokens"), F.max("seq").alias("last"), F.sum(F.when(F.col("seq") % 1000 == 0, F.length("token")).otherwise(0)).alias("probe"))


_UNIFORM = "(('0x' || substr(md5({x}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


@query(f"""
WITH st AS (SELECT * FROM ({_STREAM})), n AS (SELECT genre, count(*) AS n, min(count(*)) OVER () AS len FROM st GROUP BY genre),
dr AS (SELECT genre, rep, len, floor({_UNIFORM.format(x="concat_ws('|', '42', rep::VARCHAR, genre)")} * greatest(n - len, 0))::BIGINT AS start FROM n, range(0, 25) r(rep)),
bl AS (SELECT st.genre, rep, token FROM st JOIN dr ON st.genre = dr.genre AND seq >= start AND seq < start + len),
sp AS (SELECT genre, rep, freq, row_number() OVER (PARTITION BY genre, rep ORDER BY freq DESC, token) AS rank FROM (SELECT genre, rep, token, count(*) AS freq FROM bl GROUP BY ALL)),
fits AS ({_ZIPF.format(by="genre, rep", src="SELECT * FROM sp")})
SELECT genre, count(exponent) AS draws, round(avg(exponent), 6) AS mean, round(stddev_pop(exponent), 6) AS sd FROM fits GROUP BY genre""")
def zipf_length_control(spark, d):  # noqa: ANN001, ANN201
    return describe.zipf_length_control(_token_texts(spark, d), reps=25)


@query()
def zipf_length_control_whole(spark, d):  # noqa: ANN001, ANN201
    """The same 25 draws under the name they had while the one with SQL had five."""
    return describe.zipf_length_control(_token_texts(spark, d), reps=25)


ELS_SKIPS = range(2, 101)
_ELS = "SELECT {by}, skip, count(*) FILTER (n >= 3) AS repeated FROM (SELECT {by}, skip, token, count(*) AS n FROM ({src}) s, (SELECT unnest(range(2, 101)) AS skip) k WHERE s.seq % k.skip = 0 GROUP BY ALL) GROUP BY {by}, skip"


@query(_ELS.format(by="genre", src=_STREAM))
def els_metric(spark, d):  # noqa: ANN001, ANN201
    return describe.els(_stream(spark, d).repartition("genre", "token"), ELS_SKIPS).withColumn("skip", F.col("skip").cast("long"))


@query()
def els_scan(spark, d):  # noqa: ANN001, ANN201
    """Whole streams, all skips and 1000 shuffles; what is observed is ``els_metric``, which has SQL."""
    return describe.els_scan(_stream(spark, d), ELS_SKIPS, reps=1000)


def _joined(spark, d):  # noqa: ANN001, ANN202
    return describe.joined_texts(_docs(spark, d, "doc_id", "text", "lang"), "lang", "doc_id", "text")


@query()
def compression_ratio(spark, d):  # noqa: ANN001, ANN201
    return describe.zlib_ratio(_joined(spark, d), seq="k", piece=sampling.BLOCK)


@query()
def compression_delta(spark, d):  # noqa: ANN001, ANN201
    """Texts are joined in order of their keys; no places of tokens are needed for it."""
    types = _tokens(spark, d).groupBy("genre", "token").agg(F.count("*").alias("freq"))
    return describe.redundancy(_joined(spark, d), reps=20, types=types, seq="k", piece=sampling.BLOCK)


@query()
def redundancy_length_control(spark, d):  # noqa: ANN001, ANN201
    texts = kept(_token_texts(spark, d), "texts", "zstd")  # read three times
    drawn = sampling.draws(texts, "genre", 20, F.sum("n"))
    out = describe.redundancy(describe.block_texts(texts, drawn), reps=10, by=["genre", "rep"], types=describe.block_types(texts, drawn))
    return out.groupBy("genre").agg(F.count("*").alias("draws"), F.round(F.avg("delta"), 6).alias("mean"), F.round(F.stddev_pop("delta"), 6).alias("sd"))


@query("SELECT source, count(*) AS n, round(avg(len), 6) AS mean, round(stddev_pop(len) / avg(len), 6) AS cv FROM (SELECT source, len(" + _WORDS.format(x="text") + ") AS len FROM documents) GROUP BY source")
def dispersion_cv(spark, d):  # noqa: ANN001, ANN201
    rows = _docs(spark, d, "text", "source").select("source", F.size(X.words(F.col("text"))).alias("len"))
    return describe.dispersion(rows, ["source"], "len")


_CV = "SELECT source, round(stddev_pop(len) / avg(len), 6) AS cv FROM (SELECT source, len(" + _WORDS.format(x="text") + ") AS len FROM documents) GROUP BY source"


@query(f"SELECT source, CASE WHEN source = 'src1' THEN cv + 0.5 ELSE cv + 0.0005 END AS published, cv AS now FROM ({_CV}) WHERE source IN ('src1', 'src2') UNION ALL SELECT 'nowhere', 1.0::DOUBLE, NULL")
def published_metrics(spark, d):  # noqa: ANN001, ANN201
    """What was published against what holds now: two sources moved, one within the tolerance of neither, one is gone."""
    now = dispersion_cv(spark, d).select("source", F.col("cv").alias("value"))
    moved = F.when(F.col("source") == "src1", 0.5).when(F.col("source") == "src2", 0.0005).otherwise(0.00005)
    published = now.withColumn("value", F.col("value") + moved).unionByName(spark.createDataFrame([("nowhere", 1.0)], "source string, value double"))
    return checks.differing(now, published, ["source"], tolerance=0.0001)


_PLACES = f"""
SELECT doc_id, lang, i / (len(ls) - 1) AS place, len(ls) AS n_lines, i FROM (SELECT doc_id, lang, ls, unnest(range(0, len(ls))) AS i FROM (SELECT doc_id, lang, {_CONTENT} AS ls FROM documents) WHERE len(ls) >= 4) WHERE regexp_matches(ls[i + 1], '(is|the|de)\\.$')"""


def _places(spark, d):  # noqa: ANN001, ANN202
    docs = _docs(spark, d, "doc_id", "text", "lang").select("doc_id", "lang", X.content_lines(F.col("text")).alias("ls"))
    placed = docs.where("size(ls) >= 4").select("doc_id", "lang", F.size("ls").alias("n_lines"), F.posexplode(X.relative_places(F.col("ls"))).alias("i", "p"))
    return placed.where(F.col("p.item").rlike(r"(is|the|de)\.$")).select("doc_id", "lang", F.col("p.place").alias("place"), F.col("n_lines").cast("long").alias("n_lines"), F.col("i").cast("long").alias("i"))


_ENTROPY = "SELECT {by}, n, CASE WHEN n >= 5 THEN round(abs(sum(-(c / n) * log2(c / n))), 6) END AS entropy FROM (SELECT {by}, c, sum(c) OVER (PARTITION BY {by})::BIGINT AS n FROM (SELECT {by}, least(9, floor(place * 10)) AS bin, count(*) AS c FROM ({src}) GROUP BY ALL)) GROUP BY {by}, n"


@query(_ENTROPY.format(by="lang", src=_PLACES))
def placement_entropy(spark, d):  # noqa: ANN001, ANN201
    return describe.decile_entropy(_places(spark, d), ["lang"])


_FLAGS = {"license": "[Ll]icensed", "digits": "[0-9]{4,}"}


@query(f"""
WITH f AS (SELECT source, 'license' AS flag, regexp_matches(text, '{_FLAGS["license"]}')::INT AS hit FROM documents UNION ALL SELECT source, 'digits', regexp_matches(text, '{_FLAGS["digits"]}')::INT FROM documents
           UNION ALL SELECT source, 'both', (regexp_matches(text, '{_FLAGS["license"]}') AND regexp_matches(text, '{_FLAGS["digits"]}'))::INT FROM documents UNION ALL SELECT source, 'neither', (NOT regexp_matches(text, '{_FLAGS["license"]}') AND NOT regexp_matches(text, '{_FLAGS["digits"]}'))::INT FROM documents),
a AS (SELECT source, flag, sum(hit)::BIGINT AS k, count(*) AS n, avg(hit) AS p, 1.96::DOUBLE AS z FROM f GROUP BY ALL)
SELECT source, flag, k, n, round(p, 6) AS rate,
  round(greatest(0, (p + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)), 6) AS low,
  round(least(1, (p + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)), 6) AS high FROM a""")
def formula_prevalence_wilson(spark, d):  # noqa: ANN001, ANN201
    a, b = (F.col("text").rlike(p) for p in _FLAGS.values())
    return describe.prevalence(_docs(spark, d, "text", "source"), ["source"], {"license": a, "digits": b, "both": a & b, "neither": ~a & ~b})


@query(f"""
WITH l AS (SELECT DISTINCT line FROM (SELECT unnest({_LINES}) AS line FROM documents) WHERE length(line) >= 8)
SELECT line FROM l WHERE EXISTS (SELECT 1 FROM benchmark WHERE contains(benchmark.text, l.line))""")
def leaked_benchmark_lines(spark, d):  # noqa: ANN001, ANN201
    return leaked_lines(_docs(spark, d, "text"), table(spark, d, "benchmark", ["text"]).withColumnRenamed("text", "blob"))


_LABELS = "string_split_regex(text, '[.!?][ \\n]+')"


@query(f"""
WITH s AS (SELECT DISTINCT trim(unnest({_LABELS}), ' ' || chr(10) || chr(9) || chr(13)) AS line FROM benchmark),
p AS (SELECT line FROM s WHERE length(line) >= 8)
SELECT line FROM p WHERE EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, p.line))""")
def leaked_benchmark_sentences(spark, d):  # noqa: ANN001, ANN201
    """The other way round: sentences of the benchmark that stand anywhere in a document."""
    sentences = table(spark, d, "benchmark", ["text"]).select(F.explode(F.split("text", r"[.!?][ \n]+", -1)).alias("text")).select(F.trim(F.col("text"), F.lit(" \n\t\r")).alias("text"))
    return substrings.contained(sentences, _docs(spark, d, "text")).withColumnRenamed("text", "line")


@query("SELECT count(*) AS rows, count(DISTINCT doc_id) AS ids, count(*) = count(DISTINCT doc_id) AS \"unique\" FROM documents")
def corpus_check(spark, d):  # noqa: ANN001, ANN201
    return checks.corpus(_docs(spark, d, "doc_id"), "doc_id")


@query("SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_texts(spark, d):  # noqa: ANN001, ANN201
    return checks.duplicates(_docs(spark, d, "text"), "text")


@query("SELECT * FROM (VALUES ('has_words', (SELECT count(*) FROM documents), (SELECT count(*) FROM documents WHERE NOT regexp_matches(text, '[a-z]'))), ('short', (SELECT count(*) FROM documents), (SELECT count(*) FROM documents WHERE n_chars >= 10000))) t(rule, checked, failed) CROSS JOIN LATERAL (SELECT failed = 0 AS held)")
def rule_assertions(spark, d):  # noqa: ANN001, ANN201
    return checks.assertions(_docs(spark, d, "text", "n_chars"), {"has_words": F.col("text").rlike("[a-z]"), "short": F.col("n_chars") < 10_000})


@query("SELECT doc_id FROM documents WHERE contains(text, 'Licensed under') AND NOT contains(substr(text, greatest(instr(text, 'Licensed under') - 300, 1), 300 + 800 + 14), 'Apache')")
def uncorrected_claims(spark, d):  # noqa: ANN001, ANN201
    return checks.near(_docs(spark, d, "doc_id", "text"), "text", "Licensed under", "Apache").select("doc_id")
