"""Turn repair, vector near-duplicates and token alignment against plain versions."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabulon.llm import alignment, catalog, licences, neighbours, repair, secretscan, urls, vectordedup
from tabulon.llm.legalcodes import SECTIONS
from tabulon.llm.tokens import tokenizer_path

from ..conftest import DATA

# 11. Turn repair

GRAMMAR = re.compile(r"(s?(ua)+)?")
CONVERSATION = "conv_id long, turn long, role string, text string"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        n = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if n == 1 else re.sub("[.!?]", "", text) if n == 2 else text
        out += [] if n == 0 else [(turn, "user" if n == 4 else role, text)] * (2 if n == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def plain_repair(rows):
    """Every edit of every row for every state, with the least (cost, audit) from each place on, found by itself."""
    seen, faults = set(), []
    for _, role, text in rows:
        ends = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not ends else "duplicate" if (role, text) in seen else "truncated" if ends[-1] not in ".!?" else "")
        seen.add((role, text))
    after = {"": "u", "s": "u", "u": "a", "a": "u"}  # the last initial names the state
    role_of = {"u": "user", "a": "assistant"}

    @cache
    def best(i, state, inserts):
        """(cost, audit) from row i on; up to two insertions in a row can be of use."""
        ways = [(0, "")] if i == len(rows) and state in ("", "a") else []
        if inserts:
            c, x = best(i, after[state], inserts - 1)
            ways.append((c + 5, "I" + x))
        if i < len(rows):
            role, fault = rows[i][1], faults[i]
            c, x = best(i + 1, state, 2)
            ways.append((c + 2, "D" + x))
            if fault in ("", "truncated"):
                more = 5 if fault else 0
                if role and GRAMMAR.fullmatch({"": "", "s": "s", "u": "u", "a": "ua"}[state] + role[0] + {"s": "ua", "u": "a"}.get(role[0], "")):
                    c, x = best(i + 1, role[0], 2)
                    ways.append((c + more, "K" + x))
                c, x = best(i + 1, after[state], 2)
                ways.append((c + 1 + more, "R" + x))
        return min(ways, default=(10**9, ""))

    for i in range(len(rows), -1, -1):
        for state in after:
            best(i, state, 2)
    cost, audit = best(0, "", 2)
    state, turns, i = "", [], 0
    for edit in audit:
        if edit in "IR":
            state = after[state]
            turns.append(f"{role_of[state]}:{rows[i][2] if edit == 'R' else ''}")
        elif edit == "K":
            state = rows[i][1][0]
            turns.append(f"{rows[i][1]}:{rows[i][2]}")
        i += edit != "I"
    known = [t for t, _, _ in rows if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(turns).encode()).hexdigest())


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def expected(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    return sorted(((k, *plain_repair(plain_damage(v))) for k, v in by.items()), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def conversations(n, seed, longest=9):
    rng = random.Random(seed)
    out = []
    for conv in [None, *range(n)]:
        for turn in range(rng.randint(0 if conv is not None else 4, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "No", "", " \t", None, f"It is {rng.randint(0, 3)}!", "Why?\n", "é…", "done.\x85"])
            out.append((conv, rng.choice([turn, turn, None, turn + 5, 2]), role, text))
    return out


def test_repair_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(catalog.queries()["op11_turn_repair"](spark, DATA)) == expected(rows)


def test_repair_of_odd_turns(spark):
    rows = conversations(150, 5) + [(9999, 1, "user", "Same.")] * 7 + [(5000 + i, t, "user", "x") for i in range(40) for t in range(1)]
    clash = [F.lit(1).alias(c) for c in ("copies", "part", "audit", "cost", "hash")]
    df = spark.createDataFrame(rows, CONVERSATION).select("*", *clash).repartition(5)
    assert got(repair.repair(repair.damaged(df))) == expected(rows)
    assert repair.repair(repair.damaged(df.limit(0))).collect() == []


@pytest.mark.parametrize(("most_rows", "most_chars"), [(1, 10**6), (3, 10**6), (10**6, 12)])
def test_repair_in_fragments(spark, most_rows, most_chars):
    """One conversation holds most rows, and is cut into fragments of a row or a few."""
    rows = conversations(30, 6) + [(77, t, r, x) for t, (_, _, r, x) in enumerate(conversations(60, 7))]
    df = spark.createDataFrame(rows, CONVERSATION).repartition(3)
    assert got(repair.repair(repair.damaged(df), most_rows, most_chars)) == expected(rows)


def test_ties_take_the_least_initial():
    final = repair.final()
    rows = [("a", 0, False)]
    costs = repair.togo(rows, final)
    assert costs[0][repair.START] == 2 and repair.edits_of(rows, repair.START, costs)[0] == ["D"]


# 12. Near-duplicates of vectors


def plain_vectors(rows, threshold=0.9):
    """(vec_id, n_links, component_id, kept) by brute force over usable vectors of one dimension."""
    good = [i for i, (_, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, i in enumerate(good):
        for j in good[n + 1 :]:
            a, b = (np.array(rows[k][1], dtype=np.float64) for k in (i, j))
            if len(a) != len(b):
                continue
            a, b = a / np.abs(a).max(), b / np.abs(b).max()
            if a @ b / math.sqrt((a @ a) * (b @ b)) >= threshold:
                links[i] += 1
                links[j] += 1
                parent[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root(i)] = min(least.get(root(i), k), k)
    return sorted(((k, links[i], least.get(root(i)), k == least.get(root(i))) for i, (k, _) in enumerate(rows)), key=repr)


def near(df):
    return sorted((tuple(r) for r in df.select("vec_id", "n_links", "component_id", "kept").collect()), key=repr)


def groups_of_vectors(seed, dimension=16):
    rng = np.random.default_rng(seed)
    out = [rng.standard_normal(dimension) for _ in range(60)]
    centre, other = rng.standard_normal((2, dimension))
    out += [centre + 0.05 * rng.standard_normal(dimension) for _ in range(70)]  # one tight group
    out += [other + 0.35 * rng.standard_normal(dimension) for _ in range(50)]  # a loose one, with links and without
    out += [out[3] * 7.0, out[3], out[4] * 1e-3]
    return [(int(i), [float(x) for x in v]) for i, v in zip(rng.permutation(len(out)) * 3, out, strict=True)]


def test_vectors_of_the_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    assert near(catalog.queries()["op12_sorted_passes"](spark, DATA)) == plain_vectors(rows)


@pytest.mark.parametrize(("window", "block"), [(128, 4096), (8, 16)])
def test_groups_of_vectors(spark, window, block):
    """Small windows and blocks: groups far larger than either keep all their links."""
    rows = groups_of_vectors(3)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    assert near(vectordedup.near_duplicates(df, window=window, block=block)) == plain_vectors(rows)


def test_odd_vectors(spark):
    unit = [1.0, 2.0, 3.0]
    scales = [1.0, 2.0**-49, 1e-200, 5e-324, 1e200, 2.0**0.5, -1.0]
    rows = [(i, [x * s for x in unit]) for i, s in enumerate(scales)]
    rows += [(20, None), (21, []), (22, [0.0] * 3), (23, [1.0, None, 2.0]), (24, [math.nan, 1.0, 1.0]), (25, [math.inf, 1.0, 1.0]), (26, [1.0, 2.0]), (27, [2.0, 4.0]), (None, unit), (None, None), (2, unit), (2, unit)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("*", *(F.lit(1).alias(c) for c in ("row", "vector", "root", "n_links"))).repartition(3)
    assert near(vectordedup.near_duplicates(df)) == plain_vectors(rows)
    assert near(vectordedup.near_duplicates(df.limit(0))) == []
    floats = df.select("vec_id", F.col("embedding").cast("array<float>").alias("embedding")).where("vec_id IN (0, 1, 5)")
    assert [r[1] for r in near(vectordedup.near_duplicates(floats))] == [2, 2, 2]


def test_planted_pairs_are_found(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((6000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    pairs = []
    for i in range(300):
        y = rng.standard_normal(64)
        y -= y @ x[i] * x[i]
        c = 0.9 + 0.1 * rng.random() ** 2 + 1e-9
        pairs.append(c * x[i] + math.sqrt(max(0, 1 - c * c)) * y / np.linalg.norm(y))
    rows = [(i, v.tolist()) for i, v in enumerate([*x, *pairs])]
    found = {r[0]: r for r in near(vectordedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))}
    assert sum(found[6000 + i][2] == i for i in range(300)) >= 294 and sum(r[1] for r in found.values()) <= 600


# 13. Alignment


def plain_alignment(texts):
    a, b = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    a.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(x): x for x in shown} | {chr(256 + n): x for n, x in enumerate(x for x in range(256) if x not in shown)}
    groups, totals = [], Counter()
    for _, text in texts:
        ids_a, ids_b = (a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in map(b.id_to_piece, ids_b)]
        if text and not b"".join(bytes_a) == b"".join(bytes_b) == f" {text}".encode():
            ids_a = ids_b = []
        spans_a, spans_b = ([(sum(map(len, x[:i])), sum(map(len, x[: i + 1]))) for i in range(len(n))] for x, n in ((bytes_a, ids_a), (bytes_b, ids_b)))
        links = [(ids_a[i], ids_b[j]) for i, (s, e) in enumerate(spans_a) for j, (s2, e2) in enumerate(spans_b) if s < e2 and s2 < e]
        totals.update(links)
        cuts = sorted({e for _, e in spans_a} & {e for _, e in spans_b})
        parts = []
        for low, high in zip([0, *cuts], cuts, strict=False):
            parts.append("|".join(",".join(str(n) for n, (s, e) in zip(ids, spans, strict=True) if low <= s and e <= high) for ids, spans in ((ids_a, spans_a), (ids_b, spans_b))))
        groups.append((ids_a, ids_b, parts, links))
    most = {}
    for (_, y), n in totals.items():
        most[y] = max(n, most.get(y, 0))
    out = []
    for (key, _), (ids_a, ids_b, parts, links) in zip(texts, groups, strict=True):
        sha = hashlib.sha256(";".join(parts).encode()).hexdigest() if parts else ""
        out.append((key, len(ids_a), len(ids_b), len(parts), len(links), sum(totals[x] == most[x[1]] for x in links), sum(totals[x] for x in links), sha))
    return sorted(out, key=repr)


ALIGNED = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
TEXTS = [
    (1, None), (2, ""), (3, " "), (4, "  two  spaces  "), (5, "\n\nlines\n and\n\n\nmore \n"), (6, "naïve Straße 東京 \U0001f600 é x y z ﬁ ½ don't"), (7, "<|endoftext|> and <s> </s> <unk> <0x41>"),
    (8, "a▁b"), (9, "\ttab\r\nend\x00zero"), (None, "no key"), (10, "same"), (10, "same"), (11, "x" * 3000), (12, "word " * 900), (13, "<0x0A>\x1c\x85"),
]


def aligned(df):
    return sorted((tuple(r) for r in df.select(*ALIGNED).collect()), key=repr)


def paths():
    return tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


@pytest.mark.parametrize("links", [40, 2_000_000])
def test_alignment_of_odd_texts(spark, links):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string").select("*", *(F.lit(3).alias(c) for c in ("n_a", "block", "ids", "codes"))).repartition(3)
    assert aligned(alignment.alignments(df, *paths(), links=links)) == plain_alignment(TEXTS)
    assert aligned(alignment.alignments(df.limit(0), *paths())) == []


def test_alignment_of_the_table(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    short = {k for k, t in texts if t is None or len(t) < 3000}
    found = aligned(catalog.queries()["op13_token_alignment"](spark, DATA))
    # all of it, as counts are of the whole table; texts are aligned whole here, not by chunks
    assert len(found) == len(texts) and len(short) > 50
    links, totals = {}, Counter()
    for key, t in texts:
        _, _, x, y, _ = alignment.align([f" {t}"], *alignment.sides(*paths())) if t else (None, None, np.zeros(0), np.zeros(0), None)
        links[key] = list(zip(x.tolist(), y.tolist(), strict=True))
        totals.update(links[key])
    plain = {r[0]: r for r in plain_alignment([x for x in texts if x[0] in short])}
    most = defaultdict(int)
    for (_, y), n in totals.items():
        most[y] = max(most[y], n)
    for r in found:
        mine = links[r[0]]
        assert r[4:7] == (len(mine), sum(totals[p] == most[p[1]] for p in mine), sum(totals[p] for p in mine))
        if r[0] in short:
            assert r[:5] == plain[r[0]][:5] and r[7] == plain[r[0]][7]


def test_chunks_make_whole_texts(spark, monkeypatch):
    """Texts put together from chunks equal those aligned whole, also when what is known is forgotten all the time."""
    a, b = alignment.sides(*paths())
    texts = [t for _, t in [*TEXTS, *((r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect())] if t]
    texts += ["\t\ttabs \r\n\r\nand\x0bmore\x0c ", "\n", "\t", " \n ", "a\u3000b c", "x  "]
    counts, groups, x, y, _ = alignment.align([f" {t}" for t in texts], a, b)
    digests = [hashlib.sha256(g).hexdigest() if g else "" for g in groups]
    assert b.apart
    for some in (400_000, 10):
        monkeypatch.setattr(alignment, "REMEMBER", some)
        made, at = alignment.Aligner(a, b), 0
        for i in range(0, len(texts), 7):
            rows, own, links = made.texts(texts[i : i + 7])
            assert rows.tolist() == counts[i : i + 7].tolist() and own == digests[i : i + 7]
            assert made.pairs[links].tolist() == (x[at : at + len(links)] * len(b.spelt) + y[at : at + len(links)]).tolist()
            at += len(links)
        assert at == len(x)


# 2. Vectors of any length


def test_neighbours_of_tiny_and_huge_vectors(spark):
    """Lengths at the border of two bands, and lengths whose squares are no doubles."""
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.standard_normal(8)]) for i in range(40)]
    lengths = [2.0**-49, 1e-200, 5e-324, 1e200, 2.0**0.5, 2.0**-0.5, 2.0**-49.5, 1.0]
    rows += [(100 + i, [s] * 8) for i, s in enumerate(lengths)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for some in (df, df.where("vec_id NOT IN (101, 102, 103)").select("vec_id", F.col("embedding").cast("array<float>").alias("embedding"))):
        known = {r.vec_id: np.array(r.embedding, dtype=np.float64) for r in some.collect()}
        found = defaultdict(list)
        for r in neighbours.nearest(some, F.col("vec_id") % 20 == 0, k=100).orderBy("rank").collect():
            found[r.query_id].append((r.vec_id, r.score))
        for q, v in found.items():
            exact = {k: float((v_ * known[q]).sum()) for k, v_ in known.items() if k != q}
            assert dict(v).keys() == exact.keys() and all(math.isclose(s, exact[k], rel_tol=1e-12, abs_tol=1e-300) for k, s in v)
        assert found.keys() == {0, 20, 100}


# 7. Texts of one character


@pytest.mark.parametrize("text", ["key" + " " * 200_000, "login: abcd key" + " " * 200_000 + "\n", "=" * 200_000, "a" * 200_000, "7" * 200_000, "password" + " " * 200_000, "user:" + " " * 200_000, "key " + "A" * 200_000, "f" * 200_000])
def test_secrets_of_long_runs(spark, text):
    df = spark.createDataFrame([(1, "warm key: 1 up"), (2, text)], "doc_id long, text string")
    run = lambda d: secretscan.report(secretscan.scan(d)).collect()
    run(df.limit(1))
    began = time.time()
    run(df)
    assert time.time() - began < 8


# 13. Chunks


def test_chunks_have_the_ids_of_whole_texts(spark):
    a, b = alignment.sides(*paths())
    assert a.apart and b.apart
    for _, text in [*TEXTS, *((r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect())]:
        if text and "\r" not in text and not alignment._ODD.search(text):
            chunks = alignment._CHUNK.findall(f" {text}")
            assert "".join(chunks) == f" {text}"
            assert [i for x in a.ids(chunks) for i in x] == a._whole(f" {text}")
            assert [i for x in b.ids(chunks) for i in x] == b.model.encode(text)


# 6. Repeated rows, null ids and long urls


def test_urls_of_one_host_repeated(spark):
    data = [(None, "http://one.example.org/en/1/x")] * 3000 + [(None, None)] * 50 + [(i, f"http://one.example.org/es/{i}") for i in range(50)] + [(7, "http://x.com/fr/" + "a" * 300_000), (8, "http://" + "h" * 100_000 + ".com/de/")]
    pages = spark.createDataFrame(data, "page_id long, url string").repartition(6)
    rules = spark.createDataFrame(list(urls.RULES), "verdict string, host string, path string")
    judged = urls.judge_urls(pages, rules)
    got = Counter((r.page_id, len(r.path), r.rule, r.verdict) for r in judged.select("page_id", "path", "rule", "verdict").collect())
    expected = Counter({(None, 7, "example.org/en/1", "block"): 3000, (None, 0, None, "allow"): 50, (7, 300_004, "com/fr/", "allow"): 1, (8, 4, "com/de/", "block"): 1})
    expected.update((i, 4 + len(str(i)), "example.org/es/", "block") for i in range(50))
    assert got == expected
    # copies of one row are dealt to several tasks, where Spark doesn't put small ones together
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert judged.where("rule = 'example.org/en/1'").select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


# 10. Windows and paragraphs by brute force


def plain_licences(text, templates, least=0.8):
    text = (text or "").replace("\r\n", "\n")
    words = lambda x: re.sub(r"[^\w]+|_+", " ", x.lower()).split()
    pairs = lambda ws: list(zip(ws, ws[1:], strict=False))
    units = [*text.split("\n"), *re.sub(r"([.!?])\x20+", r"\1\n", text).split("\n"), *re.split(r"\n[\x20\x09]*\n", text), text]
    whole, best = pairs(words(text)), {}
    for name, some in templates.items():
        for t in some:
            own, n = set(pairs(words(t))), len(words(t)) - 1
            sets = [set(pairs(words(u))) for u in units] + [set(whole[s : s + n]) for s in range(len(whole) - n + 1)]
            score = max((2 * len(s & own) / (len(s) + len(own)) for s in sets if s), default=0.0)
            if score >= least:
                best[name] = max(score, best.get(name, 0.0))
    return sorted((k, round(v, 9)) for k, v in best.items())


def test_licences_against_brute_force(spark):
    rng = random.Random(10)
    every = [(n, t) for n, ts in licences.ALL_TEMPLATES.items() for t in ts]
    texts = [None, "", "one", "All rights reserved.", "all rights " * 40, "the license " * 200]
    for _ in range(120):
        parts = []
        for _ in range(rng.randint(1, 4)):
            _, t = rng.choice(every)
            ws = t.split(" ")
            for _ in range(rng.choice([0, 0, 1, 3, len(ws) // 8])):
                i = rng.randrange(len(ws))
                ws[i : i + rng.randint(0, 2)] = rng.choice([[], ["changed"], ["some", "more"]])
            parts += [rng.choice(["", "Some prose before it. ", "A line\n", "\n\n", "and so on, "]), rng.choice([" ", " ", "\n", "\r\n"]).join(ws)]
        texts.append("".join(parts))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: sorted((x.license, round(x.score, 9)) for x in r.licences) for r in licences.scan(df).collect()}
    for i, t in enumerate(texts):
        assert got[i] == plain_licences(t, licences.ALL_TEMPLATES), (i, t)


def test_sections_of_legal_codes(spark):
    """Any one section of a code, wrapped as files carry it, with a few words changed, names its licence; its words in another order do not."""
    rng, data, expected = random.Random(3), [], {}
    for name, texts in SECTIONS.items():
        for t in texts:
            ws = t.split(" ")
            few = list(ws)
            for i in rng.sample(range(1, len(ws) - 1), 3):
                few[i] = "changed"
            mixed = rng.sample(ws, len(ws))
            for words, licence in ((ws, name), (few, name), (mixed, None)):
                lines = [" ".join(words[i : i + 11]) for i in range(0, len(words), 11)]
                expected[len(data)] = licence
                data.append((len(data), "What the mill wrote before.\n\n" + "\n".join(lines) + "\n\nAnd after it, too."))
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    got = {r.doc_id: [x.license for x in r.licences] for r in licences.scan(df).collect()}
    assert got == {k: [v] if v else [] for k, v in expected.items()}


def test_long_notices_take_their_length(spark):
    text = ("\n\n".join(licences.PARAGRAPHS["MIT"]) + "\n\n") * 1000  # a megabyte
    began = time.time()
    row = licences.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [(x.license, x.score) for x in row.licences] == [("MIT", 1.0)] and time.time() - began < 60
