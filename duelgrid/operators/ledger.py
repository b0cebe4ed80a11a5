"""Prediction ledger: freeze predictions before a contest, settle them from results (id H27).

Settling always runs before freezing. A row is replaced while its contest is in the future
and never touched again from the contest day on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from duelgrid.functions import core as C

SCHEMA = ("slot_id bigint, event_id string, date date, c1 bigint, c2 bigint, prob1 double, form_prob1 double, "
          "snapshot_on date, status string, winner bigint, settled_on date")


def freeze(ledger: DataFrame, predictions: DataFrame, run_date: Column) -> DataFrame:
    """Upsert predictions of strictly future contests with both competitors known.

    predictions: slot_id, event_id, date, c1, c2, prob1, form_prob1.
    """
    fresh = predictions.filter((F.col("date") > run_date) & F.col("prob1").isNotNull()).select(
        "slot_id", "event_id", "date", "c1", "c2", "prob1", "form_prob1", run_date.alias("snapshot_on"),
        F.lit("pending").alias("status"), F.lit(None).cast("bigint").alias("winner"), F.lit(None).cast("date").alias("settled_on"))
    frozen = ledger.filter((F.col("date") <= run_date) | (F.col("status") != "pending"))
    fresh = fresh.join(frozen.select("slot_id"), "slot_id", "left_anti")
    waiting = ledger.filter((F.col("date") > run_date) & (F.col("status") == "pending")).join(
        fresh.select("slot_id"), "slot_id", "left_anti")
    return frozen.unionByName(waiting).unionByName(fresh)


def settle(ledger: DataFrame, results: DataFrame, run_date: Column, within: int = 3, scratch_after: int = 14) -> DataFrame:
    """Grade pending past rows by the same pair within days; draws, no-contests and scratches are void.

    results: c1, c2, date, result1, result2. Candidate days are exploded, so the match is an
    equi-join, and results are cut to one row per (pair, day) first.
    """
    outcome = (F.when(F.col("result1") == "W", F.col("c1")).when(F.col("result2") == "W", F.col("c2")))
    status = (F.when(outcome.isNotNull(), "settled").when((F.col("result1") == "D") & (F.col("result2") == "D"), "void_draw")
              .otherwise("void_nc"))
    waiting = (F.col("status") == "pending") & (F.col("date") < run_date)
    first, last = ledger.filter(waiting).agg(F.date_sub(F.min("date"), within), F.date_add(F.max("date"), within)).first()
    # only results that a due row can reach are grouped
    daily = results.filter(F.col("date").between(F.lit(first), F.lit(last))).select(C.pair_key(F.col("c1"), F.col("c2")).alias("pair"), "date", status.alias("s"), outcome.alias("w")).groupBy(
        "pair", "date").agg(F.min(F.struct("s", "w")).alias("r"))
    due = ledger.filter((F.col("status") == "pending") & (F.col("date") < run_date))
    asked = due.select("slot_id", "date", C.pair_key(F.col("c1"), F.col("c2")).alias("pair")).select(
        "slot_id", "pair", F.col("date").alias("planned"), F.explode(F.sequence(F.date_sub("date", within), F.date_add("date", within))).alias("date"))
    hit = asked.join(daily, ["pair", "date"]).groupBy("slot_id").agg(
        F.min(F.struct(F.abs(F.datediff("date", "planned")).alias("gap"), "date", "r"))["r"].alias("r"))
    x = ledger.join(hit, "slot_id", "left")
    was_due = (F.col("status") == "pending") & (F.col("date") < run_date)
    scratched = was_due & F.col("r").isNull() & (F.datediff(run_date, "date") > scratch_after)
    done = was_due & F.col("r").isNotNull()
    return x.select(
        "slot_id", "event_id", "date", "c1", "c2", "prob1", "form_prob1", "snapshot_on",
        F.when(done, F.col("r.s")).when(scratched, "void_scratched").otherwise(F.col("status")).alias("status"),
        F.when(done, F.col("r.w")).otherwise(F.col("winner")).alias("winner"),
        F.when(done | scratched, run_date).otherwise(F.col("settled_on")).alias("settled_on"))


def graded(ledger: DataFrame) -> DataFrame:
    """Settled rows, one per (slot, model variant), ready for the score functions."""
    won = F.col("winner") == F.col("c1")
    return ledger.filter("status = 'settled'").select("slot_id", "event_id", "date", won.alias("won1"), F.explode(F.array(
        F.struct(F.lit("pure").alias("model"), F.col("prob1").alias("p")),
        F.struct(F.lit("form").alias("model"), F.coalesce("form_prob1", "prob1").alias("p")))).alias("x")).select(
        "slot_id", "event_id", "date", "won1", "x.*")
