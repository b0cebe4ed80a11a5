"""Structured Streaming jobs (ids S1-S6).

Every job reads a folder as a file stream and writes parquet; batches write to folders named
after the batch id, so a retried batch replaces its own output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from duelgrid.config import EngineConfig
from duelgrid.functions.names import name_pair
from duelgrid.operators import ledger as L, sweep
from duelgrid.session import ensure_checkpoint_dir
from duelgrid.sources.readers import folders, path_exists


def file_stream(spark: SparkSession, path: str, like: DataFrame, per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(like.schema)
    if per_trigger:
        r = r.option("maxFilesPerTrigger", per_trigger)
    return r.parquet(path)


def run(writer):
    """Process what is there and stop; the ended query, for its progress."""
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination()
    return q


#: Parts that a day's keys are dealt to; a part's keys are handed to Python together.
DAY_PARTS = 64


def first_of_keys(key, frames, state):
    """Of each pair of a day's part the row of the smallest patch_id in the pair's first batch; later rows of the pair
    give nothing until the day is forgotten."""
    import pandas as pd

    if state.hasTimedOut:
        state.remove()
        return
    rows = pd.concat(list(frames)).sort_values("patch_id").drop_duplicates("pair")
    seen = list(state.get[0]) if state.exists else []
    fresh = rows[~rows["pair"].isin(seen)]
    if len(fresh):
        state.update(([*seen, *fresh["pair"]],))
        yield fresh
    due = int(rows["forget"].iloc[0].timestamp() * 1000)
    state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))


def guarded_ingest(stream: DataFrame, primary: DataFrame, out: str, checkpoint: str, grace_days: int = 60,
                   window_days: int = 7, lead_days: int = 30):
    """Late feed rows: stale by the 60-day grace, duplicate of a primary contest within a week,
    or a repeat within the stream (same pair and date).  Of repeats the first delivered row stays;
    within a batch it is the one of the smallest patch_id.

    A key (pair, date) is state until the watermark passes its date by the grace; the watermark stays behind the newest
    date by the grace and `lead_days`, the days that feed dates may run ahead of the primary ones.  Rows behind it are
    late and dropped by the engine.  So state follows the window and not the output.  It lies by date and part of the pairs:
    a call of the function for each key costs more than the key's rows."""
    floor = primary.agg(F.date_sub(F.max("date"), grace_days).alias("d")).first()["d"]
    pair = name_pair(F.col("name1"), F.col("name2"))
    near = primary.filter(F.col("date") >= F.date_sub(F.lit(floor), window_days)).select(
        pair.alias("pair"), F.explode(F.sequence(F.date_sub("date", window_days), F.date_add("date", window_days))).alias("date")).distinct()
    ensure_checkpoint_dir(stream.sparkSession)
    near = near.checkpoint()  # every batch reads it
    fresh = stream.filter(F.col("date") >= F.lit(floor)).withColumn("pair", pair).join(near, ["pair", "date"], "left_anti")
    timed = fresh.withColumns({"at": F.col("date").cast("timestamp"), "forget": F.date_add("date", grace_days).cast("timestamp")})
    timed = timed.withWatermark("at", f"{grace_days + lead_days} days")
    timed = timed.withColumn("part", F.pmod(F.xxhash64("pair"), F.lit(DAY_PARTS)))
    first = timed.groupBy("date", "part").applyInPandasWithState(
        first_of_keys, timed.schema, "seen array<string>", "append", "EventTimeTimeout")
    return run(first.drop("at", "forget", "part").writeStream.outputMode("append").option("checkpointLocation", checkpoint).format("parquet").option("path", out))


#: Hash buckets of competitors, contests and slots: a batch reads and writes the ones its keys fall in.
BUCKETS = 64
STATE = "config_id int, competitor {id}, dev double, seen bigint, last_date date, last_label string"
RATED = "contest_id {contest}, date date, c1 {id}, c2 {id}, s double, method string, label string"


def bucket_of(c) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int")


def buckets_in(keys: DataFrame) -> list[int]:
    """The buckets that keys fall in; at most `BUCKETS` rows reach the driver."""
    return [r[0] for r in keys.select(bucket_of(keys.columns[0])).distinct().collect()]


def states_of(history: DataFrame, engine: EngineConfig) -> DataFrame:
    """What a competitor carries on from its last rated contest."""
    order = F.struct("date", "contest_id")
    return history.groupBy("config_id", "competitor").agg(
        (F.max_by("rating_after", order) - engine.initial_rating).alias("dev"), (F.max("nth") + 1).alias("seen"),
        F.max("date").alias("last_date"), F.max_by("label", F.when(F.col("label").isNotNull(), order)).alias("last_label"))


def marks_of(spark: SparkSession, out: str, before: int | None = None) -> DataFrame:
    """Batch, first and last day of the batches so far, and the first day that a later batch rated again."""
    if not path_exists(spark, f"{out}/marks"):
        return spark.createDataFrame([], "batch int, first date, last date, redone date")
    marks = spark.read.parquet(f"{out}/marks")
    marks = marks if before is None else marks.filter(F.col("batch") < before)
    later = W.orderBy("batch").rowsBetween(1, W.unboundedFollowing)  # one small row per batch
    return marks.select("batch", "first", "last", F.min("first").over(later).alias("redone"))


def online_history(spark: SparkSession, out: str, before: int | None = None) -> DataFrame:
    """The rating history that stands: a batch's rows from a later batch's first day on were rated again."""
    rows = spark.read.parquet(f"{out}/history").join(marks_of(spark, out, before).select("batch", "redone"), "batch")
    return rows.filter(F.coalesce(F.col("date") < F.col("redone"), F.lit(True))).drop("batch", "redone")


def online_state(spark: SparkSession, out: str, before: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
    """One row per competitor, from the last version of each bucket (of these buckets); None without a version.
    Which batch wrote a bucket last is at most `BUCKETS` rows, so the files to read are known before the scan."""
    if not path_exists(spark, f"{out}/versions"):
        return None
    versions = spark.read.parquet(f"{out}/versions")
    versions = versions if before is None else versions.filter(F.col("batch") < before)
    last = {r[0]: r[1] for r in versions.groupBy("bucket").agg(F.max("batch")).collect() if buckets is None or r[0] in buckets}
    kept = F.lit(False)
    for batch in sorted(set(last.values())):
        kept = kept | ((F.col("batch") == batch) & F.col("bucket").isin([k for k, b in last.items() if b == batch]))
    return spark.read.parquet(f"{out}/state").filter(kept).drop("batch", "bucket") if last else None


def online_ratings(stream: DataFrame, out: str, checkpoint: str, as_of: str, engine: EngineConfig | None = None):
    """Ratings updated batch by batch with the same fold as the batch job.

    A contest counts once: repeats within a batch, and ids that an earlier batch rated, are dropped.  State (one row per
    competitor) lies in hash buckets; a batch reads the buckets of its competitors and writes new versions of those
    alone, in a folder of its own, so that a retried batch replaces only what it wrote.  If a batch reaches back to a day
    that was rated before, everything from its first day on is rated again: from the state as of that day, with the
    contests of the earlier batches since.  `online_history` and `online_state` read what stands.
    """
    engine = engine or EngineConfig()
    spark = stream.sparkSession
    kinds = {"id": stream.schema["c1"].dataType.simpleString(), "contest": stream.schema["contest_id"].dataType.simpleString()}

    def rated_before(batch_id: int) -> DataFrame | None:
        if not path_exists(spark, f"{out}/rated"):
            return None
        return spark.read.schema(RATED.format(**kinds) + ", batch int, bucket int").parquet(f"{out}/rated").filter(F.col("batch") < batch_id)

    def batch(df: DataFrame, batch_id: int) -> None:
        rows = sweep.rated_contests(df)
        rows = rows.groupBy("contest_id").agg(F.min(F.struct(*[c for c in rows.columns if c != "contest_id"])).alias("x")).select("contest_id", "x.*")
        earlier = rated_before(batch_id)
        if earlier is not None:
            ids = earlier.filter(F.col("bucket").isin(buckets_in(rows.select("contest_id")))).select("contest_id")
            rows = rows.join(ids, "contest_id", "left_anti")
        rated_path = f"{out}/rated/batch={batch_id}"
        rows.withColumn("bucket", bucket_of("contest_id")).write.mode("overwrite").partitionBy("bucket").parquet(rated_path)
        rows = spark.read.schema(RATED.format(**kinds)).parquet(rated_path)
        first, last = rows.agg(F.min("date"), F.max("date")).first()
        if first is None:
            return
        known = marks_of(spark, out, batch_id).agg(F.max("last")).first()[0]
        again = known is not None and first <= known
        if again:
            rows = rows.unionByName(earlier.filter(F.col("date") >= F.lit(first)).select(*rows.columns))
        who = rows.select(F.explode(F.array("c1", "c2")).alias("competitor")).distinct()
        touched = buckets_in(who)
        held = online_state(spark, out, batch_id, touched)
        if held is None:
            held = spark.createDataFrame([], STATE.format(**kinds))
        if again:
            state = states_of(online_history(spark, out, batch_id).filter(F.col("date") < F.lit(first)).join(who, "competitor", "left_semi"), engine)
        else:
            state = held.join(who, "competitor", "left_semi")
        state = state.checkpoint()
        t = sweep.timeline(rows).join(state.select("competitor", "seen", "last_date", "last_label"), "competitor", "left").select(
            "contest_id", "date", "side", "competitor", "s", "label", "method",
            (F.col("nth") + F.coalesce("seen", F.lit(0))).alias("nth"), F.coalesce("prev_date", "last_date").alias("prev_date"),
            F.coalesce("prev_label", "last_label").alias("prev_label"))
        work = sweep.pair_up(t, [engine], as_of).checkpoint()
        folded = sweep.fold_slice(work, state.select("config_id", "competitor", "dev"), sweep.components(work.select("c1", "c2").distinct()))
        sweep.history_rows(folded).write.mode("overwrite").parquet(f"{out}/history/batch={batch_id}")
        fresh = states_of(spark.read.parquet(f"{out}/history/batch={batch_id}"), engine)
        old = state.select("competitor", F.col("last_label").alias("old_label"))
        fresh = fresh.join(old, "competitor", "left").select(
            "config_id", "competitor", "dev", "seen", "last_date", F.coalesce("last_label", "old_label").alias("last_label"))
        whole = fresh.unionByName(held.join(who, "competitor", "left_anti"))
        whole.withColumn("bucket", bucket_of("competitor")).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/state/batch={batch_id}")
        spark.createDataFrame([(k,) for k in touched], "bucket int").coalesce(1).write.mode("overwrite").parquet(f"{out}/versions/batch={batch_id}")
        spark.createDataFrame([(first, max(last, known or last))], "first date, last date").coalesce(1).write.mode("overwrite").parquet(f"{out}/marks/batch={batch_id}")

    return run(stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch))


def latest_version(spark: SparkSession, path: str) -> DataFrame:
    versions = spark.read.parquet(path).select(F.max("v").alias("v")).first()["v"]
    return spark.read.parquet(f"{path}/v={versions}")


def price_results(prices: DataFrame, contests: DataFrame, out: str, checkpoint: str, days: int = 2):
    """S3: stream-stream interval join of prices and results on the pair, both sides watermarked.  A price without a
    contest is given out, with a null contest, once the watermark has passed its days; `late_prices` tells what came behind it.
    Rows without an id (and with a pair of their own) only move the watermark on; readers leave them out.

    prices: price_id, pair, price_ts; contests: contest_id, pair, contest_ts.
    """
    p = prices.withWatermark("price_ts", f"{days + 5} days").alias("p")
    c = contests.withWatermark("contest_ts", f"{days + 5} days").alias("c")
    near = F.expr(f"p.pair = c.pair AND c.contest_ts BETWEEN p.price_ts - INTERVAL {days} DAYS AND p.price_ts + INTERVAL {days} DAYS")
    joined = p.join(c, near, "left_outer").select("price_id", "contest_id", "p.price_ts", "c.contest_ts")
    return run(joined.writeStream.outputMode("append").option("checkpointLocation", checkpoint).format("parquet").option("path", out))


def late_prices(delivered: DataFrame, out: str, watermark: str, days: int = 2) -> DataFrame:
    """S3: delivered prices that the join never gave out although the watermark has passed all their days."""
    passed = F.col("price_ts") < F.to_timestamp(F.lit(watermark)) - F.expr(f"INTERVAL {days} DAYS")
    due = delivered.filter(F.col("price_id").isNotNull() & passed)
    return due.join(delivered.sparkSession.read.parquet(out).select("price_id").distinct(), "price_id", "left_anti")


def ledger_stream(stream: DataFrame, results: DataFrame, out: str, checkpoint: str):
    """One batch per run date; settling comes before freezing.  Open rows are written anew by each batch, by due
    month; a row that a batch closes goes to that batch's own folder and is never written again.

    stream: run_date plus the prediction columns (rows with a null slot are heartbeats).
    """
    spark = stream.sparkSession

    def batch(df: DataFrame, batch_id: int) -> None:
        day = df.agg(F.max("run_date").alias("d")).first()["d"]
        if day is None:
            return
        book = open_rows(spark, out, batch_id)
        book = L.settle(book, results, F.lit(day))
        slots = df.filter("slot_id is not null")
        if path_exists(spark, f"{out}/closed"):  # a closed slot is not opened again
            done = closed_rows(spark, out, batch_id).filter(F.col("bucket").isin(buckets_in(slots.select("slot_id"))))
            slots = slots.join(done.select("slot_id"), "slot_id", "left_anti")
        book = L.freeze(book, slots, F.lit(day)).checkpoint()
        month = F.date_format("date", "yyyy-MM")
        book.filter("status <> 'pending'").withColumn("bucket", bucket_of("slot_id")).write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/closed/batch={batch_id}")
        book.filter("status = 'pending'").withColumn("due", month).write.mode("overwrite").partitionBy("due").parquet(f"{out}/open/v={batch_id}")

    return run(stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch))


def open_rows(spark: SparkSession, out: str, before: int | None = None) -> DataFrame:
    """The rows that wait, as the last batch left them."""
    empty = spark.createDataFrame([], L.SCHEMA)
    if not path_exists(spark, f"{out}/open"):
        return empty
    rows = spark.read.schema(L.SCHEMA + ", v int, due string").parquet(f"{out}/open")
    last = [int(f.split("/v=")[1].split("/")[0]) for f in folders(spark, f"{out}/open")]
    last = max((v for v in last if before is None or v < before), default=None)
    return empty if last is None else rows.filter(F.col("v") == last).select(empty.columns)


def closed_rows(spark: SparkSession, out: str, before: int | None = None) -> DataFrame:
    rows = spark.read.schema(L.SCHEMA + ", batch int, bucket int").parquet(f"{out}/closed")
    return rows if before is None else rows.filter(F.col("batch") < before)


def ledger_rows(spark: SparkSession, out: str) -> DataFrame:
    """The whole ledger: what is closed and what waits."""
    waiting = open_rows(spark, out)
    return waiting.unionByName(closed_rows(spark, out).select(waiting.columns))


def running_scores(graded: DataFrame, out: str, checkpoint: str) -> None:
    """Scores per month and model, kept as sums so cumulative values follow by adding up.

    graded: date, model, p, won1.
    """
    q = F.least(F.greatest(F.col("p"), F.lit(1e-12)), F.lit(1 - 1e-12))
    loss = F.when(F.col("won1"), -F.ln(q)).otherwise(-F.ln(1 - q))
    y = F.col("won1").cast("int")
    agg = graded.groupBy(F.trunc("date", "month").alias("month"), "model").agg(
        F.count("*").alias("n"), F.sum(loss).alias("loss"), F.sum((F.col("p") - y) * (F.col("p") - y)).alias("brier"),
        F.count_if((F.col("p") >= 0.5) == F.col("won1")).alias("hits"))

    def batch(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/v={batch_id}")

    run(agg.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(batch))


def activity_rates(events: DataFrame, out: str, checkpoint: str, size: str = "6 hours", late: str = "1 hour") -> None:
    """Events per key and tumbling window.  A batch writes every window that it changed, so the
    windows that the watermark has not passed yet are there too; `latest_windows` reads them."""
    rates = (events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "user_id")
             .agg(F.count("*").alias("n"), F.sum("value").alias("value")))
    changed = rates.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n", "value")

    def batch(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    run(changed.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(batch))


def latest_windows(spark: SparkSession, out: str) -> DataFrame:
    """The last state of each window and key."""
    rows = spark.read.parquet(out)
    return rows.groupBy("start", "end", "user_id").agg(F.max_by(F.struct("n", "value"), "batch").alias("x")).select(
        "start", "end", "user_id", "x.*")
