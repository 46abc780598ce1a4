"""Secret scans with multipart credential linking, in DataFrame functions alone.

Base kinds stand by themselves: assigned secrets, access identifiers and long hexadecimal strings. Three weak kinds say
little alone: a login name, a random-looking key, an endpoint. A weak candidate is reported only when a part of a
complementary role lies within ``SCOPE`` code points of it:

* ``ident`` (a login or client name) near a secret: assign, hex or key;
* ``key`` (a random-looking token) near an identifier or an endpoint: access, ident or endpoint;
* ``endpoint`` (a host or URL) near a secret: assign, hex or key.

Spans come from splitting the text at a pattern: pieces and matches alternate, so their lengths add up to the places of
all matches. Nothing leaves the row, so nothing is shuffled: parts of one text are joined by their intervals within it,
in a merge of both sides by start. Running sums and maxima are taken by blocks, so a dump of keys costs in
proportion to its length.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.functions.arrays import let
from tabulon.llm.common import table

#: Code points between two parts that still count as one scope.
SCOPE = 200
#: Values folded together in running sums and maxima.
BLOCK = 48
#: Code points of the chunks in which a text is masked.
CHUNK = 2048
#: Beyond any place in a text.
FAR = 1 << 30


class Kind(NamedTuple):
    name: str
    pattern: str
    #: The group whose length counts, and its least length; shorter matches are dropped, not searched again.
    group: int
    least: int
    #: Lower-case strings of which a text with a match has one.
    hints: tuple[str, ...]


# The three base kinds.
ASSIGN = Kind("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, ("passw", "secret", "token", "apikey", "api_key"))
ACCESS = Kind("access", r"(AKIA[A-Z0-9]+)", 1, 16, ("akia",))
HEX = Kind("hex", r"([0-9a-f]{32,})", 1, 32, ())
BASE = (ASSIGN, ACCESS, HEX)
# The weak kinds.
IDENT = Kind("ident", r"""((?i:user(?:name|_?id)?|login|account(?:_?id)?|client_?id|access_?key(?:_?id)?))["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._+-]+)""", 2, 3, ("user", "login", "account", "client", "access"))
KEY = Kind("key", r"""((?i:key|pwd|auth|bearer|credentials?|signature))["']?(?:\x20*+[:=]\x20*+|\x20++)["']?([A-Za-z+/_=-]*+[0-9][A-Za-z0-9+/_=-]*+)""", 2, 16, ("key", "pwd", "auth", "bearer", "credential", "signature"))
ENDPOINT = Kind("endpoint", r"""((?i:https?|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[A-Za-z0-9._~:@%-]+)""", 1, 10, ("://",))
KINDS = (*BASE, IDENT, KEY, ENDPOINT)
_SPANS = "array<struct<s:int,e:int>>"


def _none() -> Column:
    return F.array().cast(_SPANS)


def _scan(values: Column, both: Callable[[Column, Column], Column], start: int, levels: int = 3) -> Column:
    """Running ``both`` over an array from ``start``.

    Within blocks every prefix is folded anew, the folds of whole blocks are run over in the same way and put before them:
    the work is linear but for arrays beyond BLOCK to the power of the levels.
    """
    fold = lambda a: F.aggregate(a, F.lit(start), both)
    within = lambda a: F.transform(a, lambda x, i: fold(F.slice(a, 1, i + 1)))
    if levels == 1:
        return let(values, within)

    def split(a: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / BLOCK).cast("int")), lambda j: F.slice(a, j * BLOCK + 1, BLOCK))

        def joined(bs: Column) -> Column:
            runs = lambda tops: F.flatten(F.transform(bs, lambda b, j: F.transform(within(b), lambda x: both(F.coalesce(F.get(tops, j - 1), F.lit(start)), x))))
            return let(_scan(F.transform(bs, fold), both, start, levels=levels - 1), runs)

        return F.when(F.size(a) <= BLOCK, within(a)).otherwise(let(blocks, joined))

    return let(values, split)


def _matches(text: Column, kind: Kind, hint: Column) -> Column:
    """Lengths in code points of the matches of a kind, of what counts of each, and of the gaps before them; none without the hint."""
    whole, part = (F.transform(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(g)), F.length) for g in (0, kind.group))
    gaps = F.transform(F.split(text, kind.pattern, -1), F.length)
    some = F.struct(whole.alias("whole"), part.alias("part"), gaps.alias("gaps"), F.lit(kind.least).alias("least"))
    return F.when(hint, some)


def _placed(matches: Column) -> Column:
    """Spans of matches, as (start, end) in code points, end exclusive, by start; short ones are dropped."""

    def placed(m: Column) -> Column:
        ends = _scan(F.transform(m["whole"], lambda n, i: n + F.get(m["gaps"], i)), lambda x, y: x + y, 0)
        every = F.arrays_zip(ends.alias("e"), m["whole"].alias("n"), m["part"].alias("part"))
        long = F.filter(every, lambda x: x["part"] >= m["least"])
        spans = F.transform(long, lambda x: F.struct((x["e"] - x["n"]).alias("s"), x["e"].alias("e")))
        return F.when(F.size(m["whole"]) > 0, spans).otherwise(_none())

    return F.transform(matches, placed)


def _near(sides: Column, scope: int) -> Column:
    """For each of the pairs (spans, others): those of the spans that have one of the others within the scope.

    Both are merged in order of start. What starts no later reaches as far as the largest end so far; of what starts later
    the first is the closest.
    """
    mark = lambda xs, own: F.transform(xs, lambda x: F.struct(x["s"].alias("s"), F.lit(own).alias("own"), x["e"].alias("e")))

    def linked(merged: Column) -> Column:
        ends = F.transform(merged, lambda x: F.when(x["own"] == 0, x["e"]).otherwise(F.lit(-FAR)))
        starts = F.transform(merged, lambda x: F.when(x["own"] == 0, -x["s"]).otherwise(F.lit(-FAR)))
        runs = F.transform(F.array(ends, F.reverse(starts)), lambda a: _scan(a, lambda x, y: F.greatest(x, y), -FAR))

        def kept(edges: Column) -> Column:
            close = lambda x, i: (x["own"] == 1) & ((F.get(edges["reach"], i) + scope >= x["s"]) | (-F.get(edges["ahead"], i) <= x["e"] + scope))
            return F.transform(F.filter(merged, close), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))

        return let(runs, lambda r: let(F.struct(F.get(r, F.lit(0)).alias("reach"), F.reverse(F.get(r, F.lit(1))).alias("ahead")), kept))

    def one(x: Column) -> Column:
        some = (F.size(x["spans"]) > 0) & (F.size(x["others"]) > 0)
        return F.when(some, let(F.array_sort(F.concat(mark(x["spans"], 1), mark(x["others"], 0))), linked)).otherwise(_none())

    return F.transform(sides, one)


def _named(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda a: F.struct(a["s"].alias("s"), F.lit(kind).alias("k"), a["e"].alias("e")))


def _listed(spans: Column) -> Column:
    names = F.array(*(F.lit(k.name) for k in KINDS))
    return F.array_join(F.transform(spans, lambda a: F.concat_ws(":", names[a["k"]], a["s"].cast("string"), a["e"].cast("string"))), ",")


def scan(docs: DataFrame, text: str = "text", scope: int = SCOPE) -> DataFrame:
    """``docs`` with ``secrets``: an array of (s, k, e) by start and then kind, where k numbers ``KINDS``.

    A null or empty text has no spans. Repeated rows are scanned each by itself; a column of the name ``secrets`` is replaced.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    lowered = F.lower(whole)

    def hinted(*kinds: Kind) -> Column:
        out = F.lit(False)
        for k in kinds:
            for x in k.hints:
                out = out | lowered.contains(x)
            out = out if k.hints else out | whole.rlike(k.pattern)
        return out

    # a weak kind is searched for only where its complement can be
    hints = (hinted(ASSIGN), hinted(ACCESS), hinted(HEX), hinted(IDENT) & hinted(KEY, ASSIGN, HEX), hinted(KEY) & hinted(ACCESS, IDENT, ENDPOINT), hinted(ENDPOINT))
    found = _placed(F.array(*(_matches(whole, k, h) for k, h in zip(KINDS, hints, strict=True))))
    out = docs.withColumn("__found", F.transform(found, lambda x: F.coalesce(x, _none())))
    assign, access, hexes, ident, key, endpoint = (F.get("__found", F.lit(i)) for i in range(len(KINDS)))
    secret, reach = F.concat(assign, hexes, key), F.concat(access, ident, endpoint)
    sides = F.array(*(F.struct(a.alias("spans"), b.alias("others")) for a, b in ((ident, secret), (key, reach), (endpoint, secret))))
    out = out.withColumn("__linked", F.when(F.size(ident) + F.size(key) + F.size(endpoint) > 0, _near(sides, scope)))
    linked = (F.coalesce(F.get("__linked", F.lit(i)), _none()) for i in range(3))
    every = F.array_sort(F.concat(*(_named(x, i) for i, x in enumerate((assign, access, hexes, *linked)))))
    return out.withColumn("secrets", every).drop("__found", "__linked")


def report(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts, a digest of the base spans, and all spans as text, for each scanned row."""
    spans = F.col("secrets")

    def count(kind: int) -> Column:
        return F.size(F.filter(spans, lambda a: a["k"] == kind)).cast("long")

    counts = {f"n_{k.name}": count(i) for i, k in enumerate(BASE)}
    base = F.filter(spans, lambda a: a["k"] < len(BASE))
    return scanned.select(key, *(c.alias(n) for n, c in counts.items()), F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(spans).alias("spans"))


def redact(docs: DataFrame, text: str = "text", scope: int = SCOPE) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind in brackets; other columns stay as they were.

    Of spans that overlap, the one that starts first names the mask, which covers them all. A null text stays null.
    """
    names = F.array(*(F.lit(k.name.upper()) for k in KINDS))
    whole = F.col(text)

    def between(chunks: Column, a: Column, b: Column) -> Column:
        """Code points a to b: the ends of two chunks and the chunks between them."""
        first, last = F.floor(a / CHUNK).cast("int"), F.floor(b / CHUNK).cast("int")
        head = F.substring(F.get(chunks, first), a % CHUNK + 1, F.when(first == last, b - a).otherwise(F.lit(CHUNK)))
        middle = F.array_join(F.slice(chunks, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
        tail = F.when(first < last, F.substring(F.get(chunks, last), F.lit(1), b % CHUNK))
        return F.concat(F.coalesce(head, F.lit("")), middle, F.coalesce(tail, F.lit("")))

    def masked(x: Column) -> Column:
        before = lambda i: F.coalesce(F.get(x["ends"], i - 1), F.lit(0))
        pieces = F.transform(
            "secrets", lambda a, i: F.when(a["s"] >= before(i), F.concat(between(x["chunks"], before(i), a["s"]), F.lit("["), names[a["k"]], F.lit("]"))).otherwise(F.lit(""))
        )
        return F.concat(F.array_join(pieces, ""), between(x["chunks"], F.element_at(x["ends"], -1), F.length(whole)))

    ends = _scan(F.transform("secrets", lambda a: a["e"]), lambda x, y: F.greatest(x, y), 0)
    chunks = F.regexp_extract_all(whole, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    replaced = let(F.struct(ends.alias("ends"), chunks.alias("chunks")), masked)
    out = scan(docs, text, scope)
    return out.withColumn(text, F.when(F.size("secrets") > 0, replaced).otherwise(whole)).select(*docs.columns)


def op7_multipart_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(scan(table(spark, sf_dir, "documents").select("doc_id", "text")))
