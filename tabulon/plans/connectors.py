"""Queries over sources and sinks: files are written from the test tables to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.functions import text as X
from tabulon.plans import ledgers
from tabulon.sources import readers, sinks
from tabulon.sources.readers import table
from tabulon.sources.shared import kept, new_path
from tabulon.streaming import log as stream

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str):  # noqa: ANN201
    def keep(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = oracle
        return f

    return keep


_LINES = "list_filter(list_transform(string_split({x}, chr(10)), lambda x: trim(x)), lambda x: x <> '')"
_TURNS = f"SELECT conv_id, turn, role, text, {_LINES.format(x='text')} AS ls FROM conversations"


def _turns(spark, d) -> DataFrame:  # noqa: ANN001
    return table(spark, d, "conversations", ["conv_id", "turn", "role", "text"])


@query("""
SELECT split, count(*) AS rows, count(note) AS notes, sum(o_totalprice::DECIMAL(18, 2))::DOUBLE AS total, CASE WHEN split = 'parquet' THEN false END AS written_again
FROM (SELECT o_totalprice, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority || ', "ä" ' || o_orderkey END AS note, unnest(['csv', 'json', 'parquet']) AS split FROM orders) GROUP BY split""")
def sink_round_trips(spark, d):  # noqa: ANN001, ANN201
    """Orders as CSV, JSON and a write-once snapshot, read back as splits of one table; quotes, commas and nulls survive."""
    note = F.when(F.col("o_orderkey") % 3 > 0, F.concat("o_orderpriority", F.lit(', "ä" '), F.col("o_orderkey").cast("string")))
    rows = table(spark, d, "orders", ["o_orderkey", "o_totalprice", "o_orderpriority"]).select("o_totalprice", note.alias("note"))
    paths = {name: new_path(spark, f"round-trip-{name}") for name in ("csv", "json", "parquet")}
    sinks.csv(rows, paths["csv"])
    sinks.json(rows, paths["json"])
    readers.materialised(spark, paths["parquet"], lambda: rows)
    again = sinks.freeze(rows, paths["parquet"])
    schema = "o_totalprice double, note string"
    for name, reader in (("csv", spark.read.schema(schema).option("header", True).option("escape", "\\").csv), ("json", spark.read.schema(schema).json)):
        path = new_path(spark, f"round-trip-{name}-again")
        sinks.parquet(reader(paths[name]), path)
        paths[name] = path
    total = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")
    out = readers.splits(spark, paths).groupBy("split").agg(F.count("*").alias("rows"), F.count("note").alias("notes"), total.alias("total"))
    return out.withColumn("written_again", F.when(F.col("split") == "parquet", F.lit(again)))


@query(f"SELECT array_to_string(ls, chr(10)) AS message, count(*) AS n FROM ({_TURNS}) WHERE len(ls) > 0 GROUP BY 1")
def commit_log_messages(spark, d):  # noqa: ANN001, ANN201
    path = new_path(spark, "commit-log")
    _turns(spark, d).where("text IS NOT NULL").select("text").write.option("lineSep", "\x01").text(path)
    return readers.commit_log(spark, path).groupBy(F.array_join("lines", "\n").alias("message")).agg(F.count("*").alias("n"))


@query(f"""
SELECT bucket, list_sum(cs)::BIGINT AS lines, array_to_string(list_transform(range(1, len(cs)), lambda i: list_sum(cs[1:i])::BIGINT - 1), ',') AS truth
FROM (SELECT conv_id // 32 AS bucket, list(len(ls) ORDER BY conv_id, turn) AS cs FROM ({_TURNS}) WHERE len(ls) > 0 GROUP BY 1)""")
def markdown_documents(spark, d):  # noqa: ANN001, ANN201
    """32 conversations a file, each turn under a heading; headings become the true cuts."""
    path = new_path(spark, "markdown")
    rows = _turns(spark, d).select(F.floor(F.col("conv_id") / 32).alias("bucket"), "conv_id", "turn", F.concat(F.lit("## turn\n"), F.coalesce("text", F.lit(""))).alias("text"))
    rows.repartition("bucket").sortWithinPartitions("bucket", "conv_id", "turn").select("bucket", "text").write.partitionBy("bucket").text(path)
    docs = readers.markdown(spark, f"{path}/*/*.txt")
    return docs.select(F.regexp_extract("file", r"bucket=(\d+)", 1).cast("long").alias("bucket"), F.size("lines").cast("long").alias("lines"), F.array_join("truth", ",").alias("truth"))


_HEAD = _LINES.format(x="'text: ' || text")
_RECORD = f"list_transform(list_concat([role], ({_HEAD})[1:3], CASE WHEN turn % 2 = 0 THEN ls[1:12] ELSE [] END)[1:12], lambda x: left(x, 200))"


@query(f"SELECT conv_id || '-' || turn AS id, array_to_string({_RECORD}, chr(10)) AS record FROM ({_TURNS}) WHERE text IS NOT NULL AND len({_RECORD}) >= 2")
def transcript_records(spark, d):  # noqa: ANN001, ANN201
    """Turns as tool calls in JSON lines; every other one has a result."""
    path = new_path(spark, "transcripts")
    call_id = F.concat_ws("-", "conv_id", "turn")
    none = F.lit(None).cast("string")

    def event(kind: str, **fields):  # noqa: ANN202
        made = [fields.get(n, none).alias(n) for n in ("id", "name", "tool_use_id", "content")]
        given = fields.get("input", F.lit(None).cast("map<string,string>")).alias("input")
        return F.to_json(F.struct(F.struct(F.array(F.struct(F.lit(kind).alias("type"), *made, given)).alias("content")).alias("message")))

    used = event("tool_use", id=call_id, name=F.col("role"), input=F.create_map(F.lit("text"), F.col("text")))
    given = F.when(F.col("turn") % 2 == 0, event("tool_result", tool_use_id=call_id, content=F.col("text")))
    rows = _turns(spark, d).where("text IS NOT NULL").select(F.explode(F.array(used, given, F.lit("not json"))).alias("value"))
    rows.where("value IS NOT NULL").write.text(path)
    return readers.tool_records(spark, path).select("id", F.array_join("lines", "\n").alias("record"))


def _lengths(texts: list[str]) -> list[list[float]]:
    return [[float(len(t)), 1.0] for t in texts]


@query(f"SELECT DISTINCT sha256(x) AS key, 2 AS dims, 1.0::DOUBLE AS norm FROM (SELECT unnest(ls) AS x FROM ({_TURNS}))")
def embedded_lines(spark, d):  # noqa: ANN001, ANN201
    """Distinct lines through a vector service (here: their lengths), keyed by hash and of length 1."""
    lines = _turns(spark, d).select(F.explode(X.lines(F.col("text"))).alias("line"))
    v = F.col("vector")
    norm = F.round(F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))), 3)
    return readers.embed(lines, "line", _lengths).select("key", F.size(v).alias("dims"), norm.alias("norm"))


def _none(texts: list[str]) -> list[list[float]]:
    raise RuntimeError("a cached text was asked for again")


@query(f"SELECT DISTINCT sha256(x) AS key, 2 AS dims, 1.0::DOUBLE AS norm FROM (SELECT unnest(ls) AS x FROM ({_TURNS}))")
def embedded_lines_cached(spark, d):  # noqa: ANN001, ANN201
    """The same from a cache that two runs fill, half of the conversations each; a third run asks the service for nothing."""
    turns, path = _turns(spark, d), new_path(spark, "vectors")
    lines = lambda df: df.select(F.explode(X.lines(F.col("text"))).alias("line"))
    for half in (0, 1):
        readers.embed_cached(lines(turns.where(F.col("conv_id") % 2 == half)), "line", _lengths, path)
    v = F.col("vector")
    norm = F.round(F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))), 3)
    return readers.embed_cached(lines(turns), "line", _none, path).select("key", F.size(v).alias("dims"), norm.alias("norm"))


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def streamed_windows(spark, d):  # noqa: ANN001, ANN201
    """Events as a stream: writes by day and type, the whole result as the last micro-batch leaves it."""
    path, at = new_path(spark, "windows"), new_path(spark, "windows-checkpoint")
    source = spark.readStream.schema(table(spark, d, "events").schema).option("maxFilesPerTrigger", 4).parquet(f"{d}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    counted = stream.counts_by_window(source, width="1 day", late="3650 days")
    query_ = counted.writeStream.outputMode("complete").foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path)).option("checkpointLocation", at).trigger(availableNow=True).start()
    query_.awaitTermination()
    return spark.read.parquet(path).select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n")


@query(f"SELECT seq::BIGINT AS seq, by_seal, period, NULL AS reason FROM ({ledgers._LOG}) UNION ALL SELECT NULL, by_seal, period, reason FROM ({ledgers._JUDGED}) WHERE reason IS NOT NULL")
def streamed_log(spark, d):  # noqa: ANN001, ANN201
    """Requests as a stream that is stopped and started again three times: envelopes numbered without gaps over all of them, rejected ones with their reason."""
    paths = {name: new_path(spark, f"streamed-{name}") for name in ("in", "log", "rejected", "checkpoint")}
    requests = kept(ledgers.requests(spark, d), "streamed-requests")
    seals = kept(ledgers.revoked(spark, d), "streamed-seals")
    low, high = requests.agg(F.min("request"), F.max("request")).first()
    part = F.floor((F.col("request") - F.lit(low)) * 4 / (F.lit(high) - F.lit(low) + 1))
    for k in range(4):  # later requests come later, and the stream starts again from its checkpoint
        requests.where(part == k).write.mode("append").parquet(paths["in"])
        source = spark.readStream.schema(requests.schema).parquet(paths["in"])
        stream.append(source, seals, ledgers.periods(spark), paths["log"], paths["rejected"], paths["checkpoint"]).awaitTermination()
    written = spark.read.parquet(paths["log"]).select("seq", "by_seal", "period", F.lit(None).cast("string").alias("reason"))
    return written.unionByName(spark.read.parquet(paths["rejected"]).select(F.lit(None).cast("long").alias("seq"), "by_seal", "period", "reason"))
