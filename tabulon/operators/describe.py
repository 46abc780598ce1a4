"""Descriptive statistics of a corpus: counts, structure, templates, n-grams, spectra and fits."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions import text as X
from tabulon.functions.arrays import let
from tabulon.operators.ranks import ranked
from tabulon.operators.sampling import draws, running, top
from tabulon.sources.shared import kept


def counts(df: DataFrame, *labels: str, name: str = "n") -> DataFrame:
    """Rows by labels; null is a label of its own."""
    return df.groupBy(*labels).agg(F.count("*").alias(name))


def structural_stats(df: DataFrame, genre: str, text: str, markers: Sequence[str] = X.MARKERS, pattern: str = r"[\x{12000}-\x{1247F}]", between: str = X.RULING) -> DataFrame:
    """Marker counts in all and per text, mean lines (blank ones count) and mean class code points between markers."""
    t = F.coalesce(F.col(text), F.lit(""))
    cols = {f"m{i}": F.size(F.split(t, _quoted(m), -1)) - 1 for i, m in enumerate(markers)}
    part = F.filter(F.transform(F.split(t, _quoted(between), -1), lambda c: F.regexp_count(c, F.lit(pattern))), lambda n: n > 0)
    rows = df.select(F.col(genre).alias("genre"), *(c.alias(n) for n, c in cols.items()), F.size(F.split(t, "\n", -1)).alias("lines"), F.size(part).alias("chunks"), F.aggregate(part, F.lit(0), lambda s, x: s + x).alias("points"))
    out = rows.groupBy("genre").agg(
        F.count("*").alias("texts"),
        F.round(F.avg("lines"), 3).alias("mean_lines"),
        F.round(F.try_divide(F.sum("points"), F.sum("chunks")), 3).alias("mean_chunk_points"),
        *(F.sum(f"m{i}").alias(f"total_{i}") for i in range(len(markers))),
        *(F.round(F.avg(f"m{i}"), 3).alias(f"per_text_{i}") for i in range(len(markers))),
    )
    named = out
    for i, m in enumerate(markers):
        clean = m.strip("<>").lower()
        named = named.withColumnRenamed(f"total_{i}", f"n_{clean}").withColumnRenamed(f"per_text_{i}", f"{clean}_per_text")
    return named


def _quoted(literal: str) -> str:
    return "".join(c if c.isalnum() or c in "_<> " else f"\\{c}" for c in literal)


def position_templates(df: DataFrame, genre: str, text: str, width: int = 3, n: int = 15) -> DataFrame:
    """The commonest openings and closings: first ``width`` morphemes of the first and last content line.

    A closing counts only if it differs from the text's opening.
    """
    head = lambda line: F.array_join(F.slice(X.morphemes(line), 1, width), " ")
    # a text without lines has neither; lines are bound once, as each use would make them again
    ends = let(X.plain_lines(F.col(text)), lambda ls: F.struct(let(F.get(ls, F.lit(0)), head).alias("opening"), let(F.get(ls, F.size(ls) - 1), head).alias("closing")))
    places = let(ends, lambda e: F.array(F.struct(F.lit("opening").alias("place"), e["opening"].alias("template")), F.struct(F.lit("closing").alias("place"), F.when(e["closing"] != e["opening"], e["closing"]).alias("template"))))
    both = df.select(F.col(genre).alias("genre"), F.explode(places).alias("p")).select("genre", "p.place", "p.template")
    counted = both.where("template <> ''").groupBy("genre", "place", "template").agg(F.count("*").alias("n"))
    return top(counted, ["genre", "place"], [F.desc("n"), F.asc("template")], n)


def ngram_counts(df: DataFrame, genre: str, text: str, n: int) -> DataFrame:
    """(genre, ngram, freq) of n-grams within lines."""
    line = df.select(F.col(genre).alias("genre"), F.explode(X.plain_lines(F.col(text))).alias("line"))
    gram = line.select("genre", F.explode(X.ngram_keys(X.morphemes(F.col("line")), n)).alias("ngram"))
    return gram.groupBy("genre", "ngram").agg(F.count("*").alias("freq"))


def distinctive(counted: DataFrame, least: int = 5, n: int = 30) -> DataFrame:
    """n-grams that a genre uses more than all others do: ln of the ratio of shares, one added to the others' count.

    A genre whose others hold nothing compares with a total of 1.
    """
    counted = kept(counted, "ngrams")  # read three times and counted once
    totals = counted.groupBy("genre").agg(F.sum("freq").alias("total"))
    totals = totals.crossJoin(totals.agg(F.sum("total").alias("all")))
    often = counted.where(F.col("freq") >= least)
    # all that others hold matters for kept n-grams alone, which are few, so the rest is not shuffled again
    every = counted.join(often.select("ngram").distinct(), "ngram", "left_semi").groupBy("ngram").agg(F.sum("freq").alias("freq_all"))
    joined = often.join(every, "ngram").join(F.broadcast(totals), "genre")  # a row a genre
    rest = F.col("all") - F.col("total")
    others = (F.col("freq_all") - F.col("freq") + 1) / (F.when(rest == 0, F.lit(1)).otherwise(rest) + 1)
    score = F.round(F.log((F.col("freq") / F.greatest("total", F.lit(1))) / others), 6)
    scored = joined.select("genre", "ngram", "freq", (F.col("freq_all") - F.col("freq")).alias("freq_others"), score.alias("score"))
    return top(scored, ["genre"], [F.desc("score"), F.desc("freq"), F.asc("ngram")], n)


def template_catalog(probes: DataFrame, bigrams: DataFrame, trigrams: DataFrame, places: DataFrame, n_grams: int = 10, n_places: int = 5) -> DataFrame:
    """One table of all kinds of templates: probes, the most distinctive n-grams, the commonest openings and closings."""
    kinds = [
        probes.select("genre", F.lit("probe").alias("kind"), F.col("probe").alias("template"), F.col("total_matches").alias("n")),
        bigrams.where(F.col("rank") <= n_grams).select("genre", F.lit("bigram").alias("kind"), F.col("ngram").alias("template"), F.col("freq").alias("n")),
        trigrams.where(F.col("rank") <= n_grams).select("genre", F.lit("trigram").alias("kind"), F.col("ngram").alias("template"), F.col("freq").alias("n")),
        places.where(F.col("rank") <= n_places).select("genre", F.col("place").alias("kind"), "template", "n"),
    ]
    out = kinds[0]
    for k in kinds[1:]:
        out = out.unionByName(k)
    return out


def joined_texts(df: DataFrame, genre: str, key: str, text: str) -> DataFrame:
    """(genre, k, n, token): a row a text that has tokens, with their number and themselves joined by spaces.

    Tokens hold no space, so nothing is lost, and a string takes less room than an array where texts are shuffled.
    """
    made = let(X.tokens(F.col(text)), lambda ts: F.struct(F.size(ts).alias("n"), F.array_join(ts, " ").alias("token")))
    return df.select(F.col(genre).alias("genre"), F.col(key).alias("k"), made.alias("t")).select("genre", "k", "t.n", "t.token").where("n > 0")


def token_texts(df: DataFrame, genre: str, key: str, text: str) -> DataFrame:
    """(genre, seq, n, token): texts in order of key, each with the place of its first token in the stream of its genre, from 0.

    Texts are numbered by sums of sizes over blocks of keys, which are integers.
    """
    return running(joined_texts(df, genre, key, text), ["genre"], "k", F.col("n"), "seq").select("genre", "seq", "n", "token")


def token_stream(df: DataFrame, genre: str, key: str, text: str) -> DataFrame:
    """(genre, seq, token): tokens of all texts of a genre in order of key, numbered from 0."""
    placed = token_texts(df, genre, key, text)
    return placed.select("genre", "seq", F.posexplode(F.split("token", " ", -1)).alias("i", "token")).select("genre", (F.col("seq") + F.col("i")).alias("seq"), "token")


def spectrum(tokens: DataFrame, by: Sequence[str] = ("genre",)) -> DataFrame:
    """(…, token, freq, rank): tokens by falling frequency, ranked by ranges."""
    counted = tokens.groupBy(*by, "token").agg(F.count("*").alias("freq"))
    return ranked(counted, by, [F.desc("freq"), F.col("token")])


def zipf(ranked: DataFrame, by: Sequence[str] = ("genre",), least: int = 5) -> DataFrame:
    """Slope and R squared of ln frequency on ln rank; null below ``least`` types. ``exponent`` is minus the slope."""
    x, y = F.log("rank"), F.log("freq")
    fit = ranked.groupBy(*by).agg(F.count("*").alias("types"), F.regr_slope(y, x).alias("slope"), F.regr_r2(y, x).alias("r2"))
    some = F.col("types") >= least
    return fit.select(*by, "types", F.when(some, F.round(-F.col("slope"), 6)).alias("exponent"), F.when(some, F.round("r2", 6)).alias("r2"))


def hill(ranked: DataFrame, x_min: int = 2, least: int = 10, by: Sequence[str] = ("genre",)) -> DataFrame:
    """Discrete maximum-likelihood exponent of the tail from ``x_min``; null below ``least`` observations."""
    tail = ranked.where(F.col("freq") >= x_min).groupBy(*by).agg(F.count("*").alias("tail"), F.sum(F.log(F.col("freq") / (x_min - 0.5))).alias("logs"))
    return tail.select(*by, "tail", F.when(F.col("tail") >= least, F.round(1 + F.col("tail") / F.col("logs"), 6)).alias("alpha"))


def zipf_of_counts(counted: DataFrame, by: Sequence[str]) -> DataFrame:
    """``zipf`` from (…, freq, types): how many types have each frequency.

    Types of one frequency have ranks in a row whatever their order, so sums over ranks need no ranked types. A task holds the
    distinct frequencies of a group, which are fewer than the root of twice its tokens, and RANKS ranks.
    """

    def run(group: pa.Table) -> pa.Table:
        freqs, types = np.asarray(group.column("freq"), dtype=np.int64), np.asarray(group.column("types"), dtype=np.int64)
        order = np.argsort(-freqs)
        ends, logs = np.cumsum(types[order]), np.log(freqs[order])
        n, sums = int(ends[-1]), np.zeros(5)
        for low in range(0, n, RANKS):
            places = np.arange(low, min(low + RANKS, n))
            x, y = np.log(places + 1), logs[np.searchsorted(ends, places, side="right")]
            sums += [x.sum(), y.sum(), x @ x, y @ y, x @ y]
        sx, sy, xx, yy, xy = sums
        own = [group.column(c).slice(0, 1).combine_chunks() for c in by]
        return pa.Table.from_arrays([*own, *(pa.array([v]) for v in (n, xx - sx * sx / n, yy - sy * sy / n, xy - sx * sy / n))], names=[*by, "types", "xx", "yy", "xy"])

    schema = ", ".join(f"`{c}` {counted.schema[c].dataType.simpleString()}" for c in by) + ", types long, xx double, yy double, xy double"
    some = F.col("types") >= 5
    level = F.col("yy") <= 1e-12 * F.col("types")  # all of one frequency
    r2 = F.when(level, F.lit(1.0)).otherwise(F.col("xy") * F.col("xy") / F.col("xx") / F.col("yy"))
    fit = counted.groupBy(*by).applyInArrow(run, schema)
    return fit.select(*by, "types", F.when(some, F.round(-F.when(level, F.lit(0.0)).otherwise(F.col("xy") / F.col("xx")), 6)).alias("exponent"), F.when(some, F.round(r2, 6)).alias("r2"))


#: Ranks that are summed at a time.
RANKS = 1 << 20


def block_types(texts: DataFrame, drawn: DataFrame) -> DataFrame:
    """(genre, rep, token, freq): types of blocks of streams and how often they stand there.

    ``texts`` are ``token_texts``, ``drawn`` is ``sampling.draws`` of their streams. The ends of blocks cut a stream into parts
    that lie in a block whole or not at all. A token is counted once, in its part, however many blocks overlap there; only counts
    of types are then added up by block.
    """
    ends = drawn.groupBy("genre").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array(F.col("start"), F.col("start") + F.col("len")))))).alias("ends"), F.collect_list(F.struct("rep", "start", "len")).alias("reps"))
    at = lambda x: F.size(F.filter("ends", lambda e: e <= x))
    reps = F.transform("reps", lambda r: F.struct(r["rep"].alias("rep"), at(r["start"]).alias("first"), at(r["start"] + r["len"] - 1).alias("last")))
    known = ends.select(F.col("genre").alias("__g"), "ends", reps.alias("reps"))  # a row a genre
    stop = F.col("seq") + F.col("n")
    cuts = F.concat(F.array("seq"), F.filter("ends", lambda e: (e > F.col("seq")) & (e < stop)), F.array(stop))
    some = texts.join(F.broadcast(known), F.col("genre") == F.col("__g")).withColumns({"cuts": cuts, "ts": F.split("token", " ", -1)})
    part = lambda i: F.struct(at(F.get("cuts", i)).alias("part"), F.slice("ts", (F.get("cuts", i) - F.col("seq") + 1).cast("int"), (F.get("cuts", i + 1) - F.get("cuts", i)).cast("int")).alias("ts"))
    parts = some.select("genre", "reps", F.explode(F.transform(F.sequence(F.lit(0), F.size("cuts") - 2), part)).alias("p"))
    inside = parts.where(F.exists("reps", lambda r: (r["first"] <= F.col("p.part")) & (F.col("p.part") <= r["last"])))
    counted = inside.select("genre", F.col("p.part").alias("part"), F.explode("p.ts").alias("token")).groupBy("genre", "part", "token").agg(F.count("*").alias("c"))
    # dealt by type, so that the rows of all blocks are added up where they are made and not shuffled
    own = counted.repartition("genre", "token").join(F.broadcast(known.select("__g", "reps")), F.col("genre") == F.col("__g"))
    fit = F.filter("reps", lambda r: (r["first"] <= F.col("part")) & (F.col("part") <= r["last"]))
    return own.select("genre", "token", "c", F.explode(F.transform(fit, lambda r: r["rep"])).alias("rep")).groupBy("genre", "token", "rep").agg(F.sum("c").alias("freq")).select("genre", "rep", "token", "freq")


def block_texts(texts: DataFrame, drawn: DataFrame) -> DataFrame:
    """(genre, rep, seq, token): what of each of the ``token_texts`` lies in each block of ``sampling.draws``, its tokens joined by spaces."""
    own = drawn.select(F.col("genre").alias("__g"), "rep", F.col("start").alias("low"), (F.col("start") + F.col("len")).alias("high"))
    inside = (F.col("genre") == F.col("__g")) & (F.col("seq") < F.col("high")) & (F.col("seq") + F.col("n") > F.col("low"))
    first, last = F.greatest("seq", "low"), F.least(F.col("seq") + F.col("n"), F.col("high"))
    whole = (first == F.col("seq")) & (last == F.col("seq") + F.col("n"))
    part = F.array_join(F.slice(F.split("token", " ", -1), (first - F.col("seq") + 1).cast("int"), (last - first).cast("int")), " ")
    return texts.join(F.broadcast(own), inside).select("genre", "rep", first.alias("seq"), F.when(whole, F.col("token")).otherwise(part).alias("token"))  # a row a block


def zipf_length_control(texts: DataFrame, reps: int = 25, seed: int = 42) -> DataFrame:
    """Zipf exponents of blocks as long as the shortest stream: mean and population deviation over the draws. ``texts`` are ``token_texts``."""
    texts = kept(texts, "texts", "zstd")  # read twice
    types = block_types(texts, draws(texts, "genre", reps, F.sum("n"), seed=seed))
    fits = zipf_of_counts(types.groupBy("genre", "rep", "freq").agg(F.count("*").alias("types")), ["genre", "rep"])
    return fits.groupBy("genre").agg(F.count("exponent").alias("draws"), F.round(F.avg("exponent"), 6).alias("mean"), F.round(F.stddev_pop("exponent"), 6).alias("sd"))


#: Tokens that are packed together, bytes that end a pack before, and tokens that a shuffled stream is made of at a time.
PIECE, PACKED, DEALT = 1 << 19, 1 << 22, 1 << 20


def _packed(stream: DataFrame, by: Sequence[str], seq: str, piece: int | None = None) -> DataFrame:
    """(…, piece, part, size, data): tokens of streams joined by spaces and packed by zstandard, each piece by itself and in order."""
    numbered = stream.select(*by, F.floor(F.col(seq) / (piece or PIECE)).alias("piece"), F.col(seq).alias("seq"), "token")
    dealt_ = numbered.repartition(*by, "piece").sortWithinPartitions(*by, "piece", "seq").drop("seq")
    names = [*by, "piece"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, key, part, held, size = pa.Codec("zstd", compression_level=12), None, 0, [], 0

        def pack() -> pa.RecordBatch:
            data = b"".join(held)[1:]  # without the space in front
            made = pa.array([part], pa.int32()), pa.array([len(data)], pa.int64()), pa.array([codec.compress(data, asbytes=True)], pa.binary())
            return pa.RecordBatch.from_arrays([*key, *made], names=[*names, "part", "size", "data"])

        for batch in batches:
            own = [batch.column(c) for c in names]
            changes = np.zeros(max(batch.num_rows - 1, 0), dtype=bool)
            for c in own:
                codes = c.dictionary_encode(null_encoding="encode").indices.to_numpy()
                changes |= codes[1:] != codes[:-1]
            # rows of several tokens can be long, so a batch is cut by bytes too
            spaced = pc.binary_join_element_wise(pa.scalar(b"", pa.large_binary()), batch.column("token").cast(pa.large_binary()), pa.scalar(b" ", pa.large_binary()))
            ends, data = np.frombuffer(spaced.buffers()[1], dtype=np.int64)[spaced.offset :], memoryview(spaced.buffers()[2] or b"")
            changes |= (starts := ends[: batch.num_rows] // PACKED)[1:] != starts[:-1]
            marks = [0, *(np.flatnonzero(changes) + 1).tolist(), batch.num_rows]
            for low, high in zip(marks, marks[1:], strict=False):
                now = [c.slice(low, 1) for c in own]
                if key is not None and (size >= PACKED or now != key):
                    yield pack()
                    part, held, size = part + 1 if now == key else 0, [], 0
                key = now
                held.append(bytes(data[ends[low] : ends[high]]))
                size += len(held[-1])
        if key is not None:
            yield pack()

    schema = ", ".join(f"`{c}` {stream.schema[c].dataType.simpleString()}" for c in by) + ", piece long, part int, size long, data binary"
    return dealt_.mapInArrow(run, schema)


def zlib_ratio(stream: DataFrame, by: Sequence[str] = ("genre",), seq: str = "seq", level: int = 9, piece: int | None = None) -> DataFrame:
    """Compressed over raw bytes of token streams joined by spaces: one stream, one ratio, however long.

    A row holds a token, or several that are joined by spaces, which spares rows in the shuffle; ``seq`` orders rows, and ``piece`` of its
    numbers are packed together.

    Tokens are joined and packed in pieces; a stream's pieces come to a task in order and run through the compressor one by one,
    as its state is sequential. Spark sorts them on disk where memory ends, and no more than a piece is held here. What a task
    reads is packed, and the longest streams are dealt first, so that none shares its task while others are free.
    """
    packed = kept(_packed(stream, by, seq, piece), "pieces")
    order = packed.groupBy(*by).agg(F.sum("size").alias("n__")).select(*(F.col(c).alias(f"__{c}") for c in by), (F.row_number().over(Window.orderBy(F.desc("n__"), *by)) - 1).alias("place__"))
    tasks = int(stream.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = packed.join(F.broadcast(order), [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by])
    dealt_ = each.repartitionById(tasks, F.pmod(F.col("place__"), F.lit(tasks)).cast("int"))
    sorted_ = dealt_.sortWithinPartitions(*by, "piece", "part").select(*by, "size", "data")
    fields = [stream.schema[c] for c in by]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, key, state, rows, types = pa.Codec("zstd"), None, None, [], None

        def close() -> None:
            packer, raw, packed = state
            rows.append((*key, raw, packed + len(packer.flush())))

        for batch in batches:
            types = [batch.schema.field(c).type for c in by]
            for n in range(batch.num_rows):
                *own, size, packed = (c[n].as_py() for c in batch.columns)
                data = codec.decompress(packed, size, asbytes=True)
                if tuple(own) != key or state is None:
                    if state is not None:
                        close()
                    key, state = tuple(own), [zlib.compressobj(level), 0, 0]
                else:
                    data = b" " + data
                state[1] += len(data)
                state[2] += len(state[0].compress(data))
        if state is not None:
            close()
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate([*types, pa.int64(), pa.int64()])]
            yield pa.RecordBatch.from_arrays(columns, names=[*by, "raw", "packed"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", raw long, packed long"
    sized = sorted_.mapInArrow(run, schema)
    return sized.select(*by, F.col("raw").alias("raw_bytes"), F.round(F.col("packed") / F.col("raw"), 6).alias("ratio"))


def dealt(counts: np.ndarray, blocks: int, rng: np.random.Generator) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(types, counts) of each block, every occurrence in a block at random: halves of halves, each with the types it holds alone.

    So a type that stands a few times is drawn for as many blocks, and not for all of them.
    """
    parts = [(np.arange(len(counts)), counts.astype(np.int64), blocks)]
    while parts:
        types, left, n = parts.pop()
        if n == 1:
            yield types, left
            continue
        drawn = rng.binomial(left, n // 2 / n)
        for here, m in ((left - drawn, n - n // 2), (drawn, n // 2)):
            some = here > 0
            parts.append((types[some], here[some], m))


def shuffled_ratio(words: list[bytes] | pa.Array, freqs: np.ndarray, rng: np.random.Generator, level: int = 9, block: int = DEALT) -> float:
    """Compressed over raw bytes of one uniform shuffle of a stream, which its types and their frequencies determine.

    Occurrences are dealt to blocks at random and each block is shuffled, which shuffles the whole; only a block is in memory.
    """
    spaced = pc.binary_join_element_wise(pa.scalar(b"", pa.large_binary()), pa.array(words, pa.large_binary()), pa.scalar(b" ", pa.large_binary()))
    packer, raw, packed = zlib.compressobj(level), 0, 0
    for types, drawn in dealt(freqs, max(1, -(-int(freqs.sum()) // block)), rng):
        ids = np.repeat(types, drawn)
        rng.shuffle(ids)
        if len(ids):
            taken = spaced.take(pa.array(ids))
            ends = np.frombuffer(taken.buffers()[1], dtype=np.int64)[taken.offset :]
            data = memoryview(taken.buffers()[2])[int(ends[0]) + (not raw) : int(ends[len(ids)])]  # a space before each word but the first
            raw += len(data)
            packed += len(packer.compress(data))
    return (packed + len(packer.flush())) / max(raw, 1)


#: Parts of a stream's types, each a row, so that no row holds all of them.
PARTS = 256


def shuffles(stream: DataFrame, reps: int, by: Sequence[str], types: DataFrame | None = None) -> DataFrame:
    """The types of a stream for each of its ``reps`` shuffles, in PARTS rows: a shuffle in one task, in order.

    ``types`` are the stream's (…, token, freq), where they are known.

    Shuffles are dealt to tasks by number, those of the longest streams first, so that no task is left with several of them.
    """
    counted = types or stream.groupBy(*by, "token").agg(F.count("*").alias("freq"))
    part = F.pmod(F.xxhash64("token"), F.lit(PARTS)).alias("part__")
    known = kept(counted.groupBy(*by, part).agg(F.sort_array(F.collect_list(F.struct("token", "freq"))).alias("types"), F.sum("freq").alias("n__")), "types")
    # a row a stream
    order = known.groupBy(*by).agg(F.sum("n__").alias("n__")).select(*(F.col(c).alias(f"__{c}") for c in by), (F.row_number().over(Window.orderBy(F.desc("n__"), *by)) - 1).alias("place__"))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    tasks = 4 * int(stream.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = known.join(F.broadcast(order), same).select(*by, "part__", "types", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep__"), "place__")
    dealt_ = each.repartitionById(tasks, F.pmod(F.col("place__") * reps + F.col("rep__"), F.lit(tasks)).cast("int"))
    return dealt_.drop("place__").sortWithinPartitions(*by, "rep__", "part__")


def redundancy(stream: DataFrame, reps: int = 20, seed: int = 42, by: Sequence[str] = ("genre",), types: DataFrame | None = None, seq: str = "seq", piece: int | None = None) -> DataFrame:
    """How much order matters to compression: mean ratio of shuffled streams minus the ratio as it is.

    Where rows of ``stream`` hold several tokens (``zlib_ratio``), ``types`` are the stream's (…, token, freq).

    A shuffle is the work of one task, seeded by its stream and number. A task holds the types of a stream and a block of a shuffle.
    """
    work = shuffles(stream, reps, by, types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, words, freqs, own = None, [], [], None

        def ratio() -> pa.RecordBatch:
            digest = hashlib.blake2b(repr((seed, *key)).encode(), digest_size=16).digest()
            found = shuffled_ratio(pa.concat_arrays(words), np.concatenate(freqs), np.random.default_rng(int.from_bytes(digest, "little")))
            return pa.RecordBatch.from_arrays([*own, pa.array([found])], names=[*by, "shuffled"])

        for batch in batches:
            for i in range(batch.num_rows):
                now = [batch.column(c)[i].as_py() for c in (*by, "rep__")]
                if now != key:
                    if key is not None:
                        yield ratio()
                    key, words, freqs, own = now, [], [], [batch.column(c).slice(i, 1) for c in by]
                types = batch.column("types")[i].values
                words.append(types.field("token").cast(pa.large_binary()))
                freqs.append(np.asarray(types.field("freq")))
        if key is not None:
            yield ratio()

    schema = ", ".join(f"`{c}` {stream.schema[c].dataType.simpleString()}" for c in by) + ", shuffled double"
    null = work.mapInArrow(run, schema).groupBy(*by).agg(F.avg("shuffled").alias("shuffled"))
    return zlib_ratio(stream, by, seq, piece=piece).join(null, [*by]).select(*by, "ratio", F.round("shuffled", 6).alias("shuffled"), F.round(F.col("shuffled") - F.col("ratio"), 6).alias("delta"))


def els(stream: DataFrame, skips: Sequence[int], least: int = 3, by: Sequence[str] = ("genre",)) -> DataFrame:
    """For each skip, how many distinct tokens stand at least ``least`` times at multiples of it."""
    skip = stream.sparkSession.createDataFrame([(int(k),) for k in skips], "skip int")
    taken = stream.join(F.broadcast(skip), F.pmod("seq", "skip") == 0)
    often = taken.groupBy(*by, "skip", "token").agg(F.count("*").alias("n"))
    return often.groupBy(*by, "skip").agg(F.count(F.when(F.col("n") >= least, 1)).alias("repeated"))


def _against(null: DataFrame, seen: DataFrame, skips: Sequence[int]) -> DataFrame:
    from tabulon.functions.stats import permutation_p, primes

    both = null.join(seen, ["genre", "skip"])
    out = both.groupBy("genre", "skip", "repeated").agg(
        F.avg("null_value").alias("null_mean"), F.coalesce(F.stddev_samp("null_value"), F.lit(0.0)).alias("null_sd"), F.count(F.when(F.col("null_value") >= F.col("repeated"), 1)).alias("hits"), F.count("*").alias("reps")
    )
    z = (F.col("repeated") - F.col("null_mean")) / F.greatest("null_sd", F.lit(1e-9))
    return out.select(
        "genre", "skip", F.col("skip").isin(primes(2, max(skips))).alias("is_prime"), "repeated", F.round("null_mean", 6).alias("null_mean"),
        F.when(F.col("null_sd") > 0, F.round(z, 4)).alias("z"), F.round(permutation_p(F.col("hits"), F.col("reps")), 6).alias("p"),
    )


def shuffled_repeats(freqs: np.ndarray, skips: Sequence[int], least: int, rng: np.random.Generator, block: int = 1 << 22) -> np.ndarray:
    """For each skip, how many types stand at least ``least`` times at its multiples in one shuffle of the stream.

    A shuffle depends on the frequencies of types alone. Each occurrence is dealt to a block at random, then each block is
    shuffled, which is a uniform shuffle of the whole; only one block is in memory. Types below ``least`` only take place.
    """
    few = freqs < least
    left = np.append(freqs[~few], freqs[few].sum()).astype(np.int64)
    types, total = len(left) - 1, int(left.sum())
    seen = np.zeros((len(skips), types), dtype=np.min_scalar_type(least))
    n_blocks, start = -(-total // block), 0
    for b in range(n_blocks):
        drawn = left if b == n_blocks - 1 else rng.binomial(left, 1 / (n_blocks - b))
        left = left - drawn
        ids = np.repeat(np.arange(types + 1), drawn)
        rng.shuffle(ids)
        for i, k in enumerate(skips):
            seen[i] = np.minimum(seen[i] + np.bincount(ids[-start % k :: k], minlength=types + 1)[:types], least)
        start += len(ids)
    return (seen >= least).sum(axis=1)


def _binomial(f: int, p: float) -> np.ndarray:
    """Probabilities of 0 to ``f`` hits."""
    x = np.arange(f + 1)
    logs = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, f + 1)))))
    out = np.exp(logs[f] - logs - logs[::-1] + x * np.log(p) + (f - x) * np.log1p(-p))
    return out / out.sum()


#: Draws of types that are held at a time.
DRAWS = 1 << 22


def drawn_repeats(freqs: np.ndarray, types: np.ndarray, taken: int, least: int, reps: int, rng: np.random.Generator) -> np.ndarray:
    """How many types stand at least ``least`` times at ``taken`` places of a shuffled stream, a number a replicate.

    ``types`` types have each of the distinct ``freqs``. In a shuffle the tokens at given places are a uniform subset of their size.
    It is drawn as counts: every token is in by chance alone, which is a binomial number a type and a multinomial one for types of
    one frequency. As many tokens as are then in excess are taken out of those in, or those that lack are taken from the rest, each
    by its place, evenly and without repeats. What is left is a uniform subset of the right size, so the draw is exact, and its work
    grows with the frequencies and with the root of the stream's length, not with the stream.
    """
    freqs, types = np.asarray(freqs, dtype=np.int64), np.asarray(types, dtype=np.int64)
    total = int((freqs * types).sum())
    if taken >= total:
        return np.full(reps, types[freqs >= least].sum())
    p, some = taken / total, freqs >= least
    rare = int((freqs * types)[~some].sum())  # tokens of types that never repeat enough: they only take places
    freqs, types = freqs[some], types[some]
    many = types > freqs + 1
    levels, chances = [(int(f), int(c)) for f, c in zip(freqs[many], types[many], strict=True)], [_binomial(int(f), p) for f in freqs[many]]
    single = np.repeat(freqs[~many], types[~many])
    # cells of types that have as many tokens in: (tokens, tokens in) of each
    size = np.concatenate([np.full(f + 1, f) for f, _ in levels] + [single, [1]]).astype(np.int64)
    known = np.concatenate([np.arange(f + 1) for f, _ in levels] + [np.zeros(0, np.int64)]).astype(np.int64)
    out, step = [], max(1, DRAWS // len(size))
    for start in range(0, reps, step):
        n = min(step, reps - start)
        tables = [rng.multinomial(c, q, size=n) for (_, c), q in zip(levels, chances, strict=True)]
        alone, few = rng.binomial(single, p, size=(n, len(single))), rng.binomial(rare, p, size=n)
        for i in range(n):
            held = np.concatenate([t[i] for t in tables] + [np.ones(len(single) + 1, np.int64)])
            inside = np.concatenate((known, alone[i], [0]))
            enough = int(held[:-1][inside[:-1] >= least].sum())
            excess = int((held * inside).sum()) + int(few[i]) - taken
            if excess:
                per = inside if excess > 0 else size - inside
                weights = held * per
                weights[-1] = few[i] if excess > 0 else rare - few[i]
                ends = np.cumsum(weights)
                at = np.sort(rng.choice(int(ends[-1]), size=abs(excess), replace=False, shuffle=False))
                cell = np.searchsorted(ends, at, side="right")
                at, cell = at[cell < len(per) - 1], cell[cell < len(per) - 1]
                own = (at - ends[cell] + weights[cell]) // per[cell]  # the type within its cell
                first = np.flatnonzero(np.concatenate(([True], (cell[1:] != cell[:-1]) | (own[1:] != own[:-1])))) if len(at) else np.zeros(0, np.int64)
                moved, was = np.diff(np.append(first, len(at))), inside[cell[first]]
                enough += int(((was < least) & (was + moved >= least)).sum()) if excess < 0 else -int(((was >= least) & (was - moved < least)).sum())
            out.append(enough)
    return np.array(out, dtype=np.int64)


def els_scan(stream: DataFrame, skips: Sequence[int], reps: int, least: int = 3, floor: int = 200, seed: int = 42) -> DataFrame:
    """Skips against shuffles of the whole stream: observed, null mean and deviation, z, one-sided p and whether the skip is prime.

    Every skip is judged by itself, so each has replicates of its own, drawn from the frequencies of types without making the
    shuffles (``drawn_repeats``). They are seeded by genre and skip, so results do not depend on partitions. Streams below ``floor``
    tokens are left out. A row of work is a skip and holds the distinct frequencies of a genre, which are fewer than the root of twice its tokens.
    """
    skips = [int(k) for k in skips]
    freqs = stream.groupBy("genre", "token").agg(F.count("*").alias("freq")).groupBy("genre", "freq").agg(F.count("*").alias("types"))
    known = freqs.groupBy("genre").agg(F.sort_array(F.collect_list(F.struct("freq", "types"))).alias("fs"), F.sum(F.col("freq") * F.col("types")).alias("n")).where(F.col("n") >= floor)
    tasks = 4 * int(stream.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    work = known.select("genre", "fs", "n", F.explode(F.array(*map(F.lit, skips))).alias("skip")).repartition(tasks, "genre", "skip")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                genre, skip, n = (batch.column(c)[i].as_py() for c in ("genre", "skip", "n"))
                fs = batch.column("fs")[i].values
                key = hashlib.blake2b(repr((seed, genre, skip)).encode(), digest_size=16).digest()
                found = drawn_repeats(np.asarray(fs.field("freq")), np.asarray(fs.field("types")), -(-n // skip), least, reps, np.random.default_rng(int.from_bytes(key, "little")))
                yield pa.RecordBatch.from_pydict({"genre": [genre] * reps, "skip": pa.array([skip] * reps, pa.int32()), "null_value": pa.array(found, pa.int64())})

    null = work.mapInArrow(run, "genre string, skip int, null_value long")
    # dealt by type once, so that the rows of all skips are counted where they are made and not shuffled
    return _against(null, els(stream.repartition("genre", "token"), skips, least), skips)


def dispersion(records: DataFrame, by: Sequence[str], size: str) -> DataFrame:
    """Coefficient of variation of record lengths, with the population deviation."""
    return records.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(size), 6).alias("mean"), F.round(F.try_divide(F.stddev_pop(size), F.avg(size)), 6).alias("cv"))


def decile_entropy(places: DataFrame, by: Sequence[str], place: str = "place", least: int = 5) -> DataFrame:
    """Entropy in bits of places over ten equal bins; null below ``least`` places."""
    bins = places.withColumn("bin", F.least(F.lit(9), F.floor(F.col(place) * 10))).groupBy(*by, "bin").agg(F.count("*").alias("c"))
    shares = bins.withColumn("n", F.sum("c").over(Window.partitionBy(*by)))
    q = F.col("c") / F.col("n")
    out = shares.groupBy(*by, "n").agg(F.sum(-q * F.log2(q)).alias("h"))
    return out.select(*by, "n", F.when(F.col("n") >= least, F.round(F.abs("h"), 6)).alias("entropy"))


def prevalence(df: DataFrame, by: Sequence[str], flags: dict[str, Column]) -> DataFrame:
    """Counts and shares of rows with each flag, and Wilson's interval: (…, flag, k, n, rate, low, high)."""
    from tabulon.functions.stats import wilson

    flagged = df.select(*by, F.explode(F.array(*(F.struct(F.lit(n).alias("flag"), c.cast("int").alias("hit")) for n, c in flags.items()))).alias("f"))
    out = flagged.groupBy(*by, "f.flag").agg(F.sum("f.hit").alias("k"), F.count("*").alias("n"))
    ci = wilson(F.col("k"), F.col("n"))
    return out.select(*by, "flag", "k", "n", F.round(F.col("k") / F.col("n"), 6).alias("rate"), F.round(ci["low"], 6).alias("low"), F.round(ci["high"], 6).alias("high"))
