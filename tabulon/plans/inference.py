"""Queries on permutation inference, power laws, bootstrap intervals and corrections.

Conversations stand for structured documents: turns are the chunks between markers, roles or languages the genre.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.functions import stats, text as X
from tabulon.operators import describe, permutation, powerlaw, resampling, sampling
from tabulon.plans import corpus
from tabulon.sources.readers import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):  # noqa: ANN201
    def keep(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return keep


# Conversations as marked texts: turns of a conversation, in order, with a marker line between them.
_TEXTS = "SELECT conv_id AS doc, CASE WHEN conv_id % 2 = 0 THEN 'even' ELSE 'odd' END AS genre, string_agg(text, chr(10) || '<RULING>' || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id"


def _texts(spark, d) -> DataFrame:  # noqa: ANN001
    turns = sampling.spread(table(spark, d, "conversations", ["conv_id", "turn", "text"]), "conv_id")
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("ts"))
    genre = F.when(F.col("conv_id") % 2 == 0, "even").otherwise("odd")
    return rows.select(F.col("conv_id").alias("doc"), genre.alias("genre"), F.array_join(F.transform("ts", lambda t: t["text"]), f"\n{X.RULING}\n").alias("text"))


def _chunks(spark, d) -> DataFrame:  # noqa: ANN001
    return permutation.chunked(_texts(spark, d), "genre", "doc", "text")


_CHUNKED = rf"""
SELECT genre, doc, flatten(cs) AS tokens, list_transform(cs, lambda c: len(c)) AS lens FROM (
  SELECT genre, doc, list_filter(list_transform(string_split(text, '<RULING>'), lambda c: list_filter(string_split_regex(c, '\s+'), lambda x: x <> '' AND x NOT IN ('<SURFACE>', '<COLUMN>', '<RULING>', '<BLANK_SPACE>', '<unk>'))), lambda c: len(c) >= 4) AS cs FROM ({_TEXTS})) WHERE len(cs) >= 2"""


def _shared_sql(src: str, keys: str, tokens: str = "tokens", lens: str = "lens") -> str:
    """(keys, total, pairs) of shared trigrams of adjacent chunks; ``lens`` are chunk lengths over ``tokens``."""
    return f"""
SELECT {keys}, list_sum(list_transform(range(1, len(sets)), lambda i: len(list_intersect(sets[i], sets[i + 1])))) ::BIGINT AS total, len(sets) - 1 AS pairs FROM (
  SELECT {keys}, list_transform(range(1, len(ln) + 1), lambda i: list_distinct(list_transform(range((list_sum(ln[1:i]) - ln[i] + 1)::BIGINT, (list_sum(ln[1:i]) - 1)::BIGINT), lambda j: array_to_string(tk[j:j + 2], ' ')))) AS sets FROM (
    SELECT {keys}, {tokens} AS tk, {lens} AS ln FROM ({src})))"""


_OBSERVED = f"SELECT s.genre, count(*) AS docs, sum(pairs)::BIGINT AS pairs, round(sum(total) / sum(pairs), 6) AS mean_shared, round(avg((len(list_distinct(lens)) = 1)::INT), 6) AS degenerate FROM ({_shared_sql(_CHUNKED, 'genre, doc')}) s JOIN ({_CHUNKED}) c ON s.doc = c.doc GROUP BY s.genre"


@query(_OBSERVED)
def boundary_overlap_observed(spark, d):  # noqa: ANN001, ANN201
    return permutation.observed(_chunks(spark, d))


REPS = 20
_H = "md5(concat_ws('|', '42', rep::VARCHAR, doc::VARCHAR, {i}::VARCHAR))"
_REP = f"SELECT *, unnest(range(0, {REPS})) AS rep FROM ({_CHUNKED})"
_LENS_A = f"list_transform(list_sort(list_transform(range(0, len(lens)), lambda i: {{'h': {_H.format(i='i')}, 'n': lens[i + 1]}})), lambda s: s.n)"
_BALLS = f"list_transform(range(1, (list_sum(lens) - 4 * len(lens) + 1)::BIGINT), lambda b: floor(('0x' || substr({_H.format(i='b')}, 1, 8))::BIGINT / 4294967296.0::DOUBLE * len(lens))::INT)"
_LENS_B = f"list_transform(range(0, len(lens)), lambda i: 4 + len(list_filter(balls, lambda b: b = i)))"
_TOKENS_C = f"list_transform(list_sort(list_transform(range(0, len(tokens)), lambda i: {{'h': {_H.format(i='i')}, 't': tokens[i + 1]}})), lambda s: s.t)"


def _null_sql(null: str) -> str:
    if null == "A":
        per = _shared_sql(_REP, "genre, doc, rep", lens=_LENS_A)
    elif null == "B":
        per = _shared_sql(f"SELECT *, {_BALLS} AS balls FROM ({_REP})", "genre, doc, rep", lens=_LENS_B)
    else:
        per = _shared_sql(_REP, "genre, doc, rep", tokens=_TOKENS_C)
    return f"""
WITH o AS ({_OBSERVED}), n AS (SELECT genre, rep, round(sum(total) / sum(pairs), 6) AS stat FROM ({per}) GROUP BY genre, rep),
j AS (SELECT o.genre, pairs, mean_shared AS seen, avg(stat) AS m, count(*) FILTER (stat >= mean_shared) AS a, count(*) FILTER (stat <= mean_shared) AS b, count(*) AS r FROM n JOIN o USING (genre) GROUP BY ALL)
SELECT genre, pairs, seen AS observed, round(m, 6) AS null_mean, round(seen - m, 6) AS delta, round((a + 1) / (r + 1), 6) AS p_upper, round((b + 1) / (r + 1), 6) AS p_lower, round(least(1.0, 2 * least((a + 1) / (r + 1), (b + 1) / (r + 1))), 6) AS p FROM j"""


@query(_null_sql("A"))
def null_length_permute(spark, d):  # noqa: ANN001, ANN201
    return permutation.overlap_test(_chunks(spark, d), "A", REPS)


@query(_null_sql("B"))
def null_uniform_cuts(spark, d):  # noqa: ANN001, ANN201
    return permutation.overlap_test(_chunks(spark, d), "B", REPS)


@query(_null_sql("C"))
def null_token_shuffle(spark, d):  # noqa: ANN001, ANN201
    return permutation.overlap_test(_chunks(spark, d), "C", REPS)


#: Permutations of the whole tests, drawn by a generator; the queries with SQL draw by hashes.
WHOLE, WHOLE_TOKENS = 10_000, 1_000


@query()
def null_length_permute_whole(spark, d):  # noqa: ANN001, ANN201
    return permutation.overlap_test(_chunks(spark, d), "A", WHOLE, least_pairs=30, hashed=False)


@query()
def null_uniform_cuts_whole(spark, d):  # noqa: ANN001, ANN201
    return permutation.overlap_test(_chunks(spark, d), "B", WHOLE, least_pairs=30, hashed=False)


@query()
def null_token_shuffle_whole(spark, d):  # noqa: ANN001, ANN201
    return permutation.overlap_test(_chunks(spark, d), "C", WHOLE_TOKENS, least_pairs=30, hashed=False)


@query()
def sample_parity(spark, d):  # noqa: ANN001, ANN201
    """The overlap tests on a sample of texts, at most 500 of each genre by hash: 200 shuffles under all three nulls, p from five pairs on."""
    sample = sampling.stratified(_texts(spark, d), "genre", "doc", 500)
    chunks = permutation.chunked(sample, "genre", "doc", "text")
    tests = [permutation.overlap_test(chunks, n, 200, least_pairs=5, hashed=False).withColumn("null", F.lit(n)) for n in "ABC"]
    return tests[0].unionByName(tests[1]).unionByName(tests[2])


@query("""
WITH v AS (SELECT role, row_number() OVER (PARTITION BY role ORDER BY conv_id * 1000 + turn) - 1 AS pos, count(*) OVER (PARTITION BY role) AS n, length(text) AS v FROM conversations),
d AS (SELECT role, rep, floor(('0x' || substr(md5(concat_ws('|', '42', rep::VARCHAR, role, pos::VARCHAR)), 1, 8))::BIGINT / 4294967296.0::DOUBLE * n)::INT AS pick FROM v, range(0, 10000) r(rep)),
m AS (SELECT d.role, rep, avg(v) AS mean FROM d JOIN v ON d.role = v.role AND d.pick = v.pos GROUP BY ALL)
SELECT role, (SELECT count(*) FROM v WHERE v.role = m.role) AS n, round((SELECT avg(v) FROM v WHERE v.role = m.role), 6) AS mean, round(quantile_cont(m.mean, 0.025), 6) AS low, round(quantile_cont(m.mean, 0.975), 6) AS high FROM m GROUP BY role""")
def bootstrap_ci(spark, d):  # noqa: ANN001, ANN201
    turns = table(spark, d, "conversations").select("role", (F.col("conv_id") * 1000 + F.col("turn")).alias("k"), F.length("text").alias("v"))
    return permutation.bootstrap_ci(turns, ["role"], "k", "v", 10_000)


_P = "(SELECT lang AS fam, source AS test, CASE WHEN count(*) >= 3 THEN avg((n_chars % 3 = 0)::INT) END AS p FROM documents GROUP BY ALL)"


@query(f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY fam ORDER BY p, test) AS k, count(*) OVER (PARTITION BY fam) AS m FROM {_P} WHERE p IS NOT NULL)
SELECT t.fam, t.test, round(t.p, 9) AS p, CASE WHEN t.p IS NOT NULL THEN round(least(1.0, min(r.p * r.m / r.k) OVER (PARTITION BY t.fam, t.p IS NULL ORDER BY r.k DESC))::DOUBLE, 9) END AS p_adjusted FROM {_P} t LEFT JOIN r USING (fam, test)""")
def bh_adjust(spark, d):  # noqa: ANN001, ANN201
    """Shares of documents by language and source as p values; those of fewer than three documents are null."""
    share = F.when(F.count("*") >= 3, F.avg((F.col("n_chars") % 3 == 0).cast("int")))
    rows = table(spark, d, "documents", ["lang", "source", "n_chars"]).groupBy(F.col("lang").alias("fam"), F.col("source").alias("test")).agg(share.alias("p"))
    return stats.benjamini_hochberg(rows, "p", ["fam"], ["test"]).select("fam", "test", F.round("p", 9).alias("p"), F.round("p_adjusted", 9).alias("p_adjusted"))


# Lines of conversations with the junctions of turns as cuts.
_LINED = rf"""
SELECT doc, genre, flatten(rs) AS lines, list_transform(range(1, len(rs)), lambda i: list_sum(list_transform(rs[1:i], lambda r: len(r)))::INT - 1) AS truth FROM (
  SELECT conv_id AS doc, CASE WHEN conv_id % 2 = 0 THEN 'even' ELSE 'odd' END AS genre, list(ls ORDER BY turn) AS rs FROM (
    SELECT conv_id, turn, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM conversations) WHERE len(ls) > 0 GROUP BY conv_id)"""
_INTERIOR = f"SELECT genre, doc, i, n, list_contains(truth, i) AS pre, length(lines[i + 1]) < 60 AS short, regexp_matches(lines[i + 1], '^[A-E]') AS early FROM (SELECT *, len(lines) AS n, unnest(range(0, len(lines) - 1)) AS i FROM ({_LINED}))"
FLAGS = ("short", "early")


def lined(spark, d) -> DataFrame:  # noqa: ANN001
    """Conversations as documents of lines; turns are records, their junctions the true cuts."""
    from tabulon.operators.segmentation import from_records

    turns = table(spark, d, "conversations", ["conv_id", "turn", "text"]).select("conv_id", "turn", X.lines(F.col("text")).alias("ls")).where(F.size("ls") > 0)
    rows = sampling.spread(turns, "conv_id").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "ls"))).alias("ts"))
    genre = F.when(F.col("conv_id") % 2 == 0, "even").otherwise("odd")
    return from_records(rows.select(F.col("conv_id").alias("doc"), genre.alias("genre"), F.transform("ts", lambda t: t["ls"]).alias("records")), "records")


def _interior(spark, d) -> DataFrame:  # noqa: ANN001
    return permutation.interior_lines(lined(spark, d), "genre", "doc", {"short": F.length("line") < 60, "early": F.col("line").rlike("^[A-E]")})


def enrichment_sql(group: str, stratum: str, interior: str = _INTERIOR, flags: Iterable[str] = FLAGS) -> str:
    rates = " UNION ALL ".join(f"SELECT genre, '{f}' AS flag, count(*) FILTER (pre) AS cuts, avg({f}::INT) FILTER (pre) AS pre, avg({f}::INT) FILTER (NOT pre) AS oth FROM l GROUP BY genre" for f in flags)
    nulls = " UNION ALL ".join(f"SELECT genre, rep, '{f}' AS flag, avg({f}::INT) AS stat FROM k GROUP BY genre, rep" for f in flags)
    return f"""
WITH l AS (SELECT *{stratum} FROM ({interior})), s AS (SELECT {group}, sum(pre::INT) AS kk FROM l GROUP BY ALL),
k AS (SELECT * FROM (SELECT l.*, kk, rep, row_number() OVER (PARTITION BY rep, {', '.join('l.' + g.strip() for g in group.split(','))} ORDER BY md5(concat_ws('|', '42', rep::VARCHAR, doc::VARCHAR, i::VARCHAR))) AS r FROM l JOIN s USING ({group}), range(0, {REPS}) q(rep)) WHERE r <= kk),
seen AS ({rates}), nul AS ({nulls}),
j AS (SELECT seen.*, avg(stat) AS m, count(*) FILTER (round(stat, 9) >= round(pre, 9)) AS hits, count(*) AS reps FROM nul JOIN seen USING (genre, flag) GROUP BY ALL)
SELECT genre, flag, cuts, round(pre, 6) AS rate_before, round(oth, 6) AS rate_other, round(m, 6) AS null_rate, round(pre / nullif(m, 0), 4) AS enrichment, round((hits + 1) / (reps + 1), 6) AS p FROM j"""


@query(enrichment_sql("genre, doc", ""))
def closer_enrichment(spark, d):  # noqa: ANN001, ANN201
    return permutation.enrichment(_interior(spark, d), FLAGS, REPS)


@query(enrichment_sql("genre, stratum", ", least(9, floor(i * 10 / n))::BIGINT AS stratum"))
def stratified_enrichment(spark, d):  # noqa: ANN001, ANN201
    return permutation.enrichment(_interior(spark, d), FLAGS, REPS, strata=10)


@query(f"""
WITH p AS (SELECT * FROM ({corpus._PLACES}) WHERE lang IN ('en', 'fr')), docs AS (SELECT doc_id, lang, any_value(n_lines) AS size FROM p GROUP BY ALL),
cu AS (SELECT list_transform([0.2, 0.4, 0.6, 0.8], lambda q: q) AS qs, [quantile_cont(size, 0.2), quantile_cont(size, 0.4), quantile_cont(size, 0.6), quantile_cont(size, 0.8)] AS cuts FROM docs),
pl AS (SELECT docs.*, len(list_filter(cuts, lambda c: c <= size)) AS stratum FROM docs, cu),
k AS (SELECT stratum, sum((lang = 'en')::INT) AS k FROM pl GROUP BY 1),
dr AS (SELECT doc_id, rep, CASE WHEN row_number() OVER (PARTITION BY rep, pl.stratum ORDER BY md5(concat_ws('|', '42', rep::VARCHAR, doc_id::VARCHAR))) <= k THEN 'en' ELSE 'fr' END AS lab FROM pl JOIN k USING (stratum), range(0, {REPS}) q(rep)),
e AS ({corpus._ENTROPY.format(by='rep, lab', src='SELECT p.place, rep, lab FROM p JOIN dr USING (doc_id)')}),
st AS (SELECT rep, max(entropy) FILTER (lab = 'en') - max(entropy) FILTER (lab = 'fr') AS stat FROM e GROUP BY rep),
se AS (SELECT max(entropy) FILTER (lang = 'en') - max(entropy) FILTER (lang = 'fr') AS seen FROM ({corpus._ENTROPY.format(by='lang', src='SELECT * FROM p')}))
SELECT round(seen, 6) AS observed, round(avg(stat), 6) AS null_mean, round((count(*) FILTER (round(stat, 6) >= round(seen, 6)) + 1) / (count(*) + 1), 6) AS p_upper, round((count(*) FILTER (round(stat, 6) <= round(seen, 6)) + 1) / (count(*) + 1), 6) AS p_lower FROM st, se GROUP BY seen""")
def length_stratified_entropy(spark, d):  # noqa: ANN001, ANN201
    return permutation.stratified_entropy(corpus._places(spark, d), "doc_id", "lang", ("en", "fr"), "n_lines", REPS)


@query(f"""
WITH p AS (SELECT *, doc_id * 100000 + i AS k FROM ({corpus._PLACES})), n AS (SELECT count(*) AS n FROM p WHERE lang = 'fr'),
pk AS (SELECT rep, place FROM (SELECT rep, place, n, row_number() OVER (PARTITION BY rep ORDER BY md5(concat_ws('|', '42', rep::VARCHAR, k::VARCHAR))) AS r FROM p, n, range(0, {REPS}) q(rep) WHERE lang = 'en') WHERE r <= n),
e AS ({corpus._ENTROPY.format(by='rep', src='SELECT * FROM pk')}), s AS ({corpus._ENTROPY.format(by='lang', src="SELECT * FROM p WHERE lang = 'fr'")})
SELECT s.n, s.entropy AS small_entropy, round(avg(e.entropy), 6) AS mean, round(quantile_cont(e.entropy, 0.025), 6) AS low, round(quantile_cont(e.entropy, 0.975), 6) AS high FROM e, s GROUP BY s.n, s.entropy""")
def matched_entropy(spark, d):  # noqa: ANN001, ANN201
    places = corpus._places(spark, d).withColumn("k", F.col("doc_id") * 100_000 + F.col("i"))
    return permutation.matched_entropy(places, "lang", ("en", "fr"), "k", REPS)


# The same tests at full size, drawn from sufficient statistics; tests hold them against exact moments and against brute force.


@query()
def closer_enrichment_whole(spark, d):  # noqa: ANN001, ANN201
    return resampling.enrichment(_interior(spark, d), FLAGS, 10_000)


@query()
def stratified_enrichment_whole(spark, d):  # noqa: ANN001, ANN201
    return resampling.enrichment(_interior(spark, d), FLAGS, 10_000, strata=10)


@query()
def bootstrap_ci_whole(spark, d):  # noqa: ANN001, ANN201
    return resampling.bootstrap_ci(table(spark, d, "conversations").select("role", F.length("text").alias("v")), ["role"], "v", 10_000)


@query()
def length_stratified_entropy_whole(spark, d):  # noqa: ANN001, ANN201
    return resampling.stratified_entropy(corpus._places(spark, d), "doc_id", "lang", ("en", "fr"), "n_lines", 5000)


@query()
def matched_entropy_whole(spark, d):  # noqa: ANN001, ANN201
    return resampling.matched_entropy(corpus._places(spark, d), "lang", ("en", "fr"), 1000)


def _common_length(spark, d) -> DataFrame:  # noqa: ANN001
    """Frequencies of frequencies in ten blocks of each stream."""
    from tabulon.sources.shared import kept

    texts = kept(corpus._token_texts(spark, d), "texts", "zstd")  # read twice
    types = describe.block_types(texts, sampling.draws(texts, "genre", 10, F.sum("n")))
    return powerlaw.frequency_counts(types.withColumnRenamed("rep", "draw"), ["genre", "draw"])


@query()
def powerlaw_fit(spark, d):  # noqa: ANN001, ANN201
    """Exponents, distances and Vuong's test on ten blocks as long as the shortest stream."""
    return powerlaw.fits(_common_length(spark, d), ["genre", "draw"])


@query()
def powerlaw_gof_common_length(spark, d):  # noqa: ANN001, ANN201
    """Goodness of fit where length cannot be the reason: 500 tails for each of ten blocks as long as the shortest stream."""
    return powerlaw.goodness(_common_length(spark, d), 500, ["genre", "draw"])


@query()
def powerlaw_gof(spark, d):  # noqa: ANN001, ANN201
    return powerlaw.goodness(powerlaw.frequency_counts(describe.spectrum(corpus._tokens(spark, d))), 500)


@query()
def spearman_exact(spark, d):  # noqa: ANN001, ANN201
    """Rank correlation of dispersion and mean length over all sources."""
    return permutation.spearman(corpus.dispersion_cv(spark, d), "source", "cv", "mean")


@query("""
WITH c AS (SELECT source, stddev_pop(n_chars) / avg(n_chars) AS cv, avg(n_chars) - 3000 AS effect FROM documents GROUP BY source), o AS (SELECT *, lag(effect) OVER (ORDER BY cv, source) AS was FROM c)
SELECT source, round(cv, 6) AS cv, effect > 0 AS up FROM o WHERE was IS NOT NULL AND (was > 0) <> (effect > 0)""")
def sign_flips(spark, d):  # noqa: ANN001, ANN201
    """Where along the order of dispersion the sign of an effect changes."""
    from pyspark.sql import Window

    c = table(spark, d, "documents", ["source", "n_chars"]).groupBy("source").agg((F.stddev_pop("n_chars") / F.avg("n_chars")).alias("cv"), (F.avg("n_chars") - 3000).alias("effect"))
    o = c.withColumn("was", F.lag("effect").over(Window.orderBy("cv", "source")))  # a row a source
    return o.where("was IS NOT NULL AND (was > 0) <> (effect > 0)").select("source", F.round("cv", 6).alias("cv"), (F.col("effect") > 0).alias("up"))
