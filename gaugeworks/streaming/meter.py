"""Budget metering with reservations, usage folding, publication and event-time windows, in batch and as streams."""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gaugeworks.functions import fixed
from gaugeworks.functions.scalar import nested_count


# What a request may still generate, and what a response did.


def reservation(path: Column, body: Column, budget: float) -> Column:
    """Output tokens to hold for a request (body: JSON text): the cap it names, within the budget, else the default; none off the
    generation paths."""
    request = F.try_parse_json(body)
    cap = lambda p: F.when(nested_count(request, p) > 0, F.least(nested_count(request, p), F.lit(int(budget))))
    caps = [cap(f"$.{k}") for k in ("max_tokens", "max_output_tokens", "max_completion_tokens", "generationConfig.maxOutputTokens")]
    return F.when(path.rlike(fixed.GENERATION_PATHS), F.coalesce(*caps, F.lit(fixed.DEFAULT_RESERVE))).otherwise(0).cast("long")


def usage_of(provider: Column, event: Column) -> Column:
    """value, final and model of one event (variant) of a response, in its provider's shape; value is null if it tells no usage."""
    text = lambda p: F.try_variant_get(event, p, "string")
    kind = text("$.type")
    start = kind == "message_start"
    wrapped = kind.isin("response.completed", "response.incomplete", "response.failed")
    first = F.struct(F.when(start, nested_count(event, "$.message.usage.output_tokens")).otherwise(nested_count(event, "$.usage.output_tokens")).alias("value"), (~F.coalesce(start, F.lit(False))).alias("final"), F.when(start, text("$.message.model")).otherwise(text("$.model")).alias("model"))
    second = F.struct(
        F.when(wrapped, nested_count(event, "$.response.usage.output_tokens", "$.response.usage.completion_tokens")).otherwise(nested_count(event, "$.usage.output_tokens", "$.usage.completion_tokens")).alias("value"),
        F.lit(True).alias("final"), F.when(wrapped, text("$.response.model")).otherwise(text("$.model")).alias("model"),
    )
    said, thought = (nested_count(event, f"$.usageMetadata.{k}TokenCount") for k in ("candidates", "thoughts"))
    third = F.struct(F.when(said.isNotNull() | thought.isNotNull(), F.coalesce(said, F.lit(0)) + F.coalesce(thought, F.lit(0))).alias("value"), F.lit(True).alias("final"), text("$.modelVersion").alias("model"))
    return F.when(provider == "anthropic", first).when(provider == "openai", second).when(provider == "gemini", third)


def folded_responses(events: DataFrame, keys: list[str], order: str, provider: str = "provider", event: str = "event") -> DataFrame:
    """Output tokens of each response from its events (JSON text): the last value that any tells; read: whether a final one did."""
    rows = events.withColumn("__u", usage_of(F.col(provider), F.try_parse_json(F.col(event))))
    told = F.col("__u.value").isNotNull()
    return rows.groupBy(*keys).agg(
        F.coalesce(F.max_by(F.when(told, F.col("__u.value")), F.when(told, F.col(order))), F.lit(0)).alias("tokens"),
        F.coalesce(F.bool_or(told & F.col("__u.final")), F.lit(False)).alias("read"),
        F.max_by("__u.model", F.when(F.col("__u.model").isNotNull(), F.col(order))).alias("model"),
    )


def folded_usage(events: DataFrame, key: str, order: list[str], value: str, final: Column) -> DataFrame:
    """The last final value of each response, and whether there was one."""
    return events.groupBy(key).agg(F.max_by(F.when(final, F.col(value)), F.when(final, F.struct(*order))).alias("used"), F.bool_or(final).alias("found"), F.count("*").alias("events"))


def needs_summary(calls: DataFrame, keys: list[str], order: str, free: int = fixed.SUMMARIZE_FREE_TOKENS) -> DataFrame:
    """calls (input_tokens, context_tokens) with needed: whether the call before left fewer than `free` tokens of the context."""
    last = F.lag("input_tokens").over(Window.partitionBy(*keys).orderBy(order))
    known = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) > 1
    return calls.withColumn("needed", F.coalesce(known & (F.col("context_tokens") > 0) & (F.col("context_tokens") - F.coalesce(last, F.lit(0)) < free), F.lit(False)))


def max_in_flight(spans: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Most requests at one time: a running sum of +1 at starts and -1 at ends; an end frees before a start at the same time takes."""
    edges = spans.select(key, F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("step")), F.struct(F.col(end).alias("at"), F.lit(-1).alias("step")))).alias("e"))
    w = Window.partitionBy(key).orderBy("e.at", "e.step").rowsBetween(Window.unboundedPreceding, 0)
    return edges.withColumn("now", F.sum("e.step").over(w)).groupBy(key).agg(F.max("now").alias("max_in_flight"))


# The meter of a trial.


@dataclasses.dataclass
class Ledger:
    """A trial's account. A request is admitted while what is spent and what requests in flight hold is under the budget; on its
    end its reservation gives way to what it used."""

    budget: float
    spent: float = 0.0
    reserved: float = 0.0
    in_flight: int = 0
    requests: int = 0
    generation_requests: int = 0
    refused: int = 0
    max_in_flight: int = 0
    usage_unread: int = 0
    hit_at: float | None = None
    held: dict = dataclasses.field(default_factory=dict)  # request: (reservation, whether it generates)

    def start(self, request: str, reserve: float, generates: bool) -> bool:
        self.requests += 1
        if self.spent + self.reserved >= self.budget:
            self.refused += 1
            return False
        self.generation_requests += bool(generates)
        self.held[request] = (float(reserve), bool(generates))
        self.reserved += reserve
        self.in_flight += 1
        self.max_in_flight = max(self.max_in_flight, self.in_flight)
        return True

    def finish(self, request: str, tokens: float, read: bool, ok: bool, at: float) -> None:
        """A request that isn't held (refused, or ended before) changes nothing."""
        if request not in self.held:
            return
        reserve, generates = self.held.pop(request)
        self.reserved -= reserve
        self.in_flight -= 1
        self.usage_unread += bool(ok and generates and not read)
        self.spent += tokens
        if self.spent >= self.budget and self.hit_at is None:
            self.hit_at = at

    def step(self, row) -> tuple:
        """One event: trial, seq, request, kind, then whether it was admitted and the account after it."""
        admitted = None
        if row.kind == "start":
            admitted = self.start(row.request, row.reserve, row.generates)
        else:
            self.finish(row.request, row.tokens, row.read, row.ok, row.at)
        over = max(0.0, self.spent - self.budget)
        return (row.trial, row.seq, row.request, row.kind, admitted, self.spent, self.reserved, self.in_flight, self.requests, self.generation_requests, self.refused, self.max_in_flight, over, self.hit_at, self.usage_unread)


#: kind: start (reserve, generates) or finish (tokens, read, ok, at). seq orders a trial's events.
METER_EVENT = "trial long, seq long, request string, kind string, reserve double, generates boolean, tokens double, read boolean, ok boolean, at double"
METERED = (
    "trial long, seq long, request string, kind string, admitted boolean, spent double, reserved double, in_flight long, requests long, generation_requests long, refused long, "
    "max_in_flight long, over_budget double, hit_at double, usage_unread long"
)
_NAMES = [x.split()[0] for x in METERED.split(", ")]


def _whole(events: DataFrame) -> DataFrame:
    """METER_EVENT columns without nulls."""
    return events.select("trial", "seq", "request", "kind", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("reserve", "tokens", "at")], *[F.coalesce(c, F.lit(d)).alias(c) for c, d in (("generates", False), ("read", False), ("ok", True))])


def metered(events: DataFrame, budget: float) -> DataFrame:
    """METERED rows of a table of events. Each partition goes through its trials in order, holding one account at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trial, ledger = None, Ledger(budget)
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                if row.trial != trial:
                    trial, ledger = row.trial, Ledger(budget)
                out.append(ledger.step(row))
            yield pd.DataFrame(out, columns=_NAMES)

    return _whole(events).repartition("trial").sortWithinPartitions("trial", "seq").mapInPandas(run, METERED)


def meter_totals(rows: DataFrame) -> DataFrame:
    """The account of each trial after its last event."""
    last = F.max_by(F.struct(*_NAMES[5:]), "seq")
    return rows.groupBy("trial").agg(last.alias("t")).select("trial", "t.*")


class Meter(StatefulProcessor):
    """The same over a stream: a trial's account is kept from batch to batch; rows of one batch are handled by seq."""

    def __init__(self, budget: float):
        self.budget = budget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("account", "account string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        ledger = Ledger(**json.loads(self.state.get()[0])) if self.state.exists() else Ledger(self.budget)
        out = [ledger.step(row) for row in pd.concat(list(rows)).sort_values("seq").itertuples(index=False)]
        self.state.update((json.dumps(dataclasses.asdict(ledger)),))
        yield pd.DataFrame(out, columns=_NAMES)

    def close(self) -> None:
        pass


def meter_stream(events: DataFrame, budget: float) -> DataFrame:
    """A stream of METERED rows (append mode) of a stream of events."""
    return _whole(events).groupBy("trial").transformWithStateInPandas(Meter(budget), METERED, "append", "none")


ADMITTED = "trial long, seq long, admitted boolean, spent double"


def _settled(requests: DataFrame) -> DataFrame:
    """Requests (trial, seq, tokens) that end before the next begins, as events."""
    step = lambda kind, k: F.struct((F.col("seq") * 2 + k).alias("seq"), F.lit(kind).alias("kind"))
    rows = requests.select("trial", F.col("seq").cast("string").alias("request"), F.col("tokens").cast("double").alias("tokens"), F.explode(F.array(step("start", 0), step("finish", 1))).alias("e"))
    none = lambda kind: F.lit(None).cast(kind)
    return rows.select("trial", "e.seq", "request", "e.kind", none("double").alias("reserve"), none("boolean").alias("generates"), "tokens", none("boolean").alias("read"), none("boolean").alias("ok"), none("double").alias("at"))


def admission_stream(requests: DataFrame, budget: float) -> DataFrame:
    """A stream of admissions of a stream of requests (trial, seq, tokens) that are settled one after the other; spent is what was
    spent when the request came."""
    rows = meter_stream(_settled(requests), budget).where("kind = 'start'")
    return rows.select("trial", F.col("request").cast("long").alias("seq"), "admitted", "spent")


def admission_batch(requests: DataFrame, budget: float) -> DataFrame:
    """The same over a table, spent with the request's own tokens. As an admitted request counts in full and a refused one not at
    all, a request is admitted iff all before it use less than the budget."""
    w = Window.partitionBy("trial").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    before = F.sum("tokens").over(w) - F.col("tokens")
    rows = requests.withColumn("admitted", before < budget)
    return rows.withColumn("spent", F.sum(F.when(F.col("admitted"), F.col("tokens")).otherwise(0.0)).over(w)).select("trial", "seq", "admitted", "spent")


# Publication.


def _table(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, folder: str, epoch: int | None = None) -> dict[str, int]:
    """Which epoch wrote each bucket last, up to an epoch (None: the latest). At most `buckets` entries."""
    path, fs = _table(spark, f"{folder}/index")
    if not fs.exists(path):
        return {}
    known = sorted(int(x.getPath().getName().split("=")[1]) for x in fs.listStatus(path) if x.getPath().getName().startswith("epoch="))
    known = [e for e in known if epoch is None or e <= epoch]
    return {str(r["bucket"]): r["epoch"] for r in spark.read.json(f"{folder}/index/epoch={known[-1]}", "bucket int, epoch int").collect()} if known else {}


def published(spark: SparkSession, folder: str) -> DataFrame | None:
    """The table as published last, None if nothing was."""
    paths = [f"{folder}/data/epoch={e}/bucket={b}" for b, e in _versions(spark, folder).items()]
    return spark.read.parquet(*paths) if paths else None


def publish(stream: DataFrame, folder: str, checkpoint: str, key: str, order: str, buckets: int = 16):
    """Start a query that keeps the last row, by order, of each key in folder, exactly once: a batch rewrites only the buckets of its
    keys, an index tells which epoch wrote each bucket last, and a batch that runs again writes the same. Buckets that no index
    names any more go with the epoch after."""

    def last_of(rows: DataFrame) -> DataFrame:
        w = Window.partitionBy(key).orderBy(F.col(order).desc_nulls_last(), F.xxhash64(*[c for c in rows.columns if c != key]))
        return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        new = last_of(batch).withColumn("bucket", bucket).persist()
        touched = [str(r["bucket"]) for r in new.select("bucket").distinct().collect()]
        versions = _versions(spark, folder, epoch - 1)
        old = [f"{folder}/data/epoch={versions[b]}/bucket={b}" for b in touched if b in versions]
        rows = new
        if old:
            before = spark.read.parquet(*old).withColumn("bucket", bucket)
            rows = last_of(before.unionByName(new, allowMissingColumns=True))
        rows.repartition(buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/data/epoch={epoch}")
        new.unpersist()
        index = versions | dict.fromkeys(touched, epoch)
        listing = spark.createDataFrame([(int(b), e) for b, e in index.items()], "bucket int, epoch int")
        listing.coalesce(1).write.mode("overwrite").json(f"{folder}/index/epoch={epoch}")
        for b in touched:  # what the epoch before replaced: a reader of that one may still be at it, so one more epoch is kept
            if versions.get(b) is not None and versions[b] < epoch - 1:
                path, fs = _table(spark, f"{folder}/data/epoch={versions[b]}/bucket={b}")
                fs.delete(path, True)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# Event time.


def tumbling(events: DataFrame, time: str, width: str, *keys: str, late: str | None = None) -> DataFrame:
    """Counts and sums by window of event time; with `late`, a watermark that bounds the state of a stream."""
    rows = events.withWatermark(time, late) if late else events
    return rows.groupBy(F.window(time, width).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("w.start", *keys, "n", "total")


def sessions(events: DataFrame, time: str, gap: str, key: str, late: str | None = None) -> DataFrame:
    rows = events.withWatermark(time, late) if late else events
    return rows.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n")).select("w.start", key, "n")


def allowed_scorers(memory_gb: Column, live: Column, low: int, high: int) -> Column:
    """How many scorers fit beside the live episodes."""
    return F.least(F.greatest(F.floor((memory_gb - 3 - live * 0.5) / 2.5), F.lit(low)), F.lit(high)).cast("int")


def bounded_images(rounds: pd.DataFrame, high: int, low: int) -> pd.DataFrame:
    """Images of one episode (n: new in each round, seed images never go): when more than `high` are held, the oldest go until
    `low` are; what went stays gone. Returns rounds with held and dropped."""
    held, out = 0, []
    for n in rounds.sort_values("round")["images"]:
        held += n
        gone = max(0, held - low) if held > high else 0
        held -= gone
        out.append((held, gone))
    return rounds.sort_values("round").assign(held=[h for h, _ in out], dropped=[g for _, g in out])
