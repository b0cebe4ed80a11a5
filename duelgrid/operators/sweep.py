"""Chronological rating sweep.

A rating step needs only the two carried ratings; every other input (layoff regression,
division move, boundary discount, provisional boost, finish weight) depends on both sides'
calendar, which no config changes.  What is left is a fold over (date, contest_id).  Four
measures keep it exact and bounded:

* time slices: contests are cut into slices sized to the number of competitors, so inside
  one slice most competitors meet only a few others;
* components: competitors connected within a slice form independent folds;
* levels: a contest's level is one more than the last of either side, so the contests of a
  level share no competitor and are folded by arrays, for all configs of a sweep at once;
* streaming folds: a task reads its sorted rows batch by batch and holds one number per
  config and competitor it meets, never the rows.

A slice holds `SLICE_FACTOR` contests per competitor, but at least `LEAST_SLICE_ROWS`, below which a slice costs
more jobs than it saves time.  Calendar, slices, components and levels are a `SweepPlan`, made once for any number
of sweeps over the same contests.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from typing import Sequence
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from duelgrid.config import DAYS_PER_YEAR, EngineConfig
from duelgrid.functions import core as C
from duelgrid.session import ensure_checkpoint_dir

LEAST_SLICE_ROWS = 4_000_000
SLICE_FACTOR = 0.4      # contests per competitor in a labelled slice: small components
LARGEST_SHARE = 0.25    # of a slice: a component above it has each config folded in a task of its own
ONE_TASK_EDGES = 4_000_000
THIN_LEVEL = 35         # values of a level below which a loop is quicker than array operations


@dataclass(frozen=True)
class Slice:
    """Half-open range of (date, contest_id); an id of None stands before every id of its day."""

    start: tuple | None
    stop: tuple | None

    def condition(self) -> Column:
        def at_or_after(point) -> Column:
            day, cut = F.lit(point[0]), point[1]
            if cut is None:
                return F.col("date") >= day
            return (F.col("date") > day) | ((F.col("date") == day) & (F.col("contest_id") >= F.lit(cut)))

        cond = F.lit(True)
        if self.start:
            cond = cond & (F.col("date") >= F.lit(self.start[0])) & at_or_after(self.start)
        if self.stop:
            cond = cond & (F.col("date") <= F.lit(self.stop[0])) & ~at_or_after(self.stop)
        return cond


def rated_contests(contests: DataFrame) -> DataFrame:
    """Dated contests with a decisive or drawn result, narrowed to what the sweep reads."""
    return (
        contests.filter(F.col("date").isNotNull())
        .withColumn("s", C.score_of(F.col("result1"), F.col("result2"))).filter("s is not null")
        .select("contest_id", "date", "c1", "c2", "s", "method", C.move_label(F.col("division")).alias("label")))


def timeline(rated: DataFrame) -> DataFrame:
    """Per side: previous date, previous label and number of earlier contests.

    A competitor may hold a third of all rows, so the window runs per (competitor, month);
    month summaries (a few hundred per competitor at most) carry the values across months.
    """
    sides = (
        rated.select("contest_id", "date", "label", "method", F.trunc("date", "month").alias("month"), F.explode(F.array(
            F.struct(F.lit(1).alias("side"), F.col("c1").alias("competitor"), F.col("s").alias("s")),
            F.struct(F.lit(2).alias("side"), F.col("c2").alias("competitor"), (1 - F.col("s")).alias("s")))).alias("x"))
        .select("contest_id", "date", "label", "method", "month", "x.*"))
    w = W.partitionBy("competitor", "month").orderBy("date", "contest_id")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    local = sides.select(
        "*", (F.row_number().over(w) - 1).alias("n_local"), F.lag("date").over(w).alias("date_local"),
        F.last("label", ignorenulls=True).over(before).alias("label_local"))
    summary = sides.groupBy("competitor", "month").agg(
        F.count("*").alias("n"), F.max("date").alias("last_date"),
        F.max_by("label", F.when(F.col("label").isNotNull(), F.struct("date", "contest_id"))).alias("last_label"))
    wm = W.partitionBy("competitor").orderBy("month").rowsBetween(W.unboundedPreceding, -1)
    carried = summary.select(
        "competitor", "month", F.coalesce(F.sum("n").over(wm), F.lit(0)).alias("n_prior"),
        F.last("last_date").over(wm).alias("date_prior"),
        F.last("last_label", ignorenulls=True).over(wm).alias("label_prior"))
    return local.join(carried, ["competitor", "month"]).select(
        "contest_id", "date", "side", "competitor", "s", "label", "method",
        (F.col("n_local") + F.col("n_prior")).alias("nth"),
        F.coalesce("date_local", "date_prior").alias("prev_date"),
        F.coalesce("label_local", "label_prior").alias("prev_label"))


def _carry_and_k(engine: EngineConfig, as_of: str, side: Column) -> tuple[Column, Column]:
    """D4-D7 as column expressions: factor on the carried deviation, and K of a side (a struct of its calendar)."""
    date, prev_date, label, prev_label = (side[c] for c in ("date", "prev_date", "label", "prev_label"))
    gap = C.months_between_days(prev_date, date)
    carry = F.when(gap > engine.grace_months,
                   F.pow(F.lit(float(engine.retention_per_year)), (gap - engine.grace_months) / F.lit(12.0))
                   ).otherwise(F.lit(1.0))
    moved = prev_label.isNotNull() & label.isNotNull() & (label != prev_label)
    carry = carry * F.when(moved, F.lit(1.0 - engine.move_penalty)).otherwise(F.lit(1.0))
    if engine.era_start_year is None and engine.boundary_years is not None:
        edge = F.date_sub(F.lit(as_of).cast("date"), int(engine.boundary_years * DAYS_PER_YEAR))
        first_inside = (date >= edge) & (prev_date.isNull() | (prev_date < edge))
        carry = carry * F.when(first_inside, F.lit(1.0 - engine.boundary_regression)).otherwise(F.lit(1.0))
    k = (F.lit(float(engine.base_k)) * C.finish_multiplier(side["method"], engine)
         * F.when(side["nth"] < engine.provisional_contests, F.lit(float(engine.provisional_multiplier)))
         .otherwise(F.lit(1.0)))
    return carry, k


def era_of(configs: Sequence[EngineConfig]) -> int | None:
    eras = {c.era_start_year for c in configs}
    if len(eras) != 1:
        raise ValueError("one sweep takes configs of one era; run one sweep per era")
    return eras.pop()


def prepare(contests: DataFrame, configs: Sequence[EngineConfig], as_of: str) -> DataFrame:
    """One row per (config, contest) with both sides' carry factor and K."""
    return pair_up(timeline(rated_since(contests, era_of(configs))), configs, as_of)


def rated_since(contests: DataFrame, era: int | None) -> DataFrame:
    rated = rated_contests(contests)
    return rated if era is None else rated.filter(F.year("date") >= era)


SIDE = ("competitor", "nth", "prev_date", "prev_label", "date", "label", "method")


def pair_sides(t: DataFrame) -> DataFrame:
    """Side rows back to one row per contest with both sides' calendar (x1, x2), which no config changes."""
    return t.groupBy("contest_id").agg(
        F.first("date").alias("date"), F.first("label").alias("label"),
        F.max(F.when(F.col("side") == 1, F.col("s"))).alias("s"),
        *[F.max(F.when(F.col("side") == i, F.struct(*SIDE))).alias(f"x{i}") for i in (1, 2)])


def per_config(paired: DataFrame, configs: Sequence[EngineConfig], as_of: str) -> DataFrame:
    """One row per (config, contest), with carry and K of every config.  Each config is a projection of its own: as
    elements of one exploded array they make a method too long to be compiled."""
    def of(i: int, config: EngineConfig) -> DataFrame:
        (g1, k1), (g2, k2) = (_carry_and_k(config, as_of, F.col(x)) for x in ("x1", "x2"))
        return paired.select(
            F.lit(i).alias("config_id"), "contest_id", "date", "label", "s",
            F.col("x1.competitor").alias("c1"), F.col("x2.competitor").alias("c2"),
            g1.alias("g1"), g2.alias("g2"), k1.alias("k1"), k2.alias("k2"),
            *[F.col(f"x{i}.{c}").alias(f"{c}{i}") for i in (1, 2) for c in ("nth", "prev_date", "prev_label")])

    return reduce(DataFrame.unionByName, [of(i, c) for i, c in enumerate(configs)])


def pair_up(t: DataFrame, configs: Sequence[EngineConfig], as_of: str) -> DataFrame:
    """Side rows back to one row per (config, contest), with carry and K of every config."""
    return per_config(pair_sides(t), configs, as_of)


def _folder():
    """Iterator fold over rows sorted by (config, component, date, contest); state rows come first."""

    def fold(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        def values(column):  # a column without nulls passes numpy, which is quicker; with nulls, ids keep their type
            whole = column.null_count == 0 and pa.types.is_primitive(column.type)
            return column.to_numpy(zero_copy_only=False).tolist() if whole else column.to_pylist()

        state, current = {}, None
        for batch in batches:
            cols = [values(batch.column(c)) for c in (
                "config_id", "component", "carried", "c1", "c2", "g1", "g2", "k1", "k2", "s")]
            out = []
            for cfg, comp, carried, a, b, ga, gb, ka, kb, s in zip(*cols):
                if (cfg, comp) != current:
                    state, current = {}, (cfg, comp)
                if carried is not None:
                    state[a] = carried
                    continue
                x, y = state.get(a, 0.0) * ga, state.get(b, 0.0) * gb
                e = 1.0 / (1.0 + 10.0 ** ((y - x) / 400.0))
                nx, ny = x + ka * (s - e), y + kb * ((1.0 - s) - (1.0 - e))
                state[a], state[b] = nx, ny
                out.append((x, nx, y, ny))
            if out:
                kept = batch.filter(pc.is_null(batch.column("carried")))
                new = [pa.array(v, pa.float64()) for v in zip(*out)]
                names = kept.schema.names[:-1]
                yield pa.RecordBatch.from_arrays(
                    [kept.column(n) for n in names] + new, names=names + ["b1", "a1", "b2", "a2"])

    return fold


def fold_slice(rows: DataFrame, state: DataFrame | None, labels: DataFrame) -> DataFrame:
    """Fold one slice; `labels` (competitor, component) splits it into independent folds.

    Returns the slice's rows with deviations before (b1, b2) and after (a1, a2).
    """
    labels_of_state = labels.withColumn("component", F.col("component").cast("string"))
    part = rows.join(labels_of_state.withColumnRenamed("competitor", "c1"), "c1")
    keep = rows.columns
    part = part.select(*keep, "component", F.lit(None).cast("double").alias("carried"))
    if state is not None:
        seeds = state.join(labels_of_state, "competitor").select(
            "config_id", "component", F.col("competitor").alias("c1"), F.col("dev").alias("carried"))
        part = part.unionByName(seeds, allowMissingColumns=True)
    by = ["config_id", "component"]
    ordered = part.repartition(*by).sortWithinPartitions(
        *by, F.col("carried").isNull(), "date", "contest_id")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in part.schema if f.name != "carried")
    return ordered.mapInArrow(_folder(), schema + ", b1 double, a1 double, b2 double, a2 double").drop("component")


def _find(root: dict, x):
    while (up := root.setdefault(x, x)) != x:
        root[x] = root[up]
        x = root[x]
    return x


def _forest():
    """Union-find over a task's pairs: those that join two groups are given out."""

    def fold(batches):
        import pyarrow as pa

        root = {}
        for batch in batches:
            u, v = [], []
            for a, b in zip(_values(batch.column(0)), _values(batch.column(1))):
                x, y = _find(root, a), _find(root, b)
                if x != y or a == b:
                    root[y] = x
                    u.append(a)
                    v.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(u, batch.schema.field(0).type), pa.array(v, batch.schema.field(1).type)], names=["u", "v"])

    return fold


def _roots():
    """Union-find over all edges of one task: each competitor with the least one of its group."""

    def fold(batches):
        import pyarrow as pa

        root, kind = {}, None
        for batch in batches:
            kind = batch.schema.field(0).type
            for a, b in zip(_values(batch.column(0)), _values(batch.column(1))):
                x, y = _find(root, a), _find(root, b)
                if x != y:
                    root[max(x, y)] = min(x, y)
        if root:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(root), kind), pa.array([_find(root, x) for x in list(root)], kind)], names=["competitor", "component"])

    return fold


def components(pairs: DataFrame) -> DataFrame:
    """Connected components of (c1, c2) pairs: min-label propagation with pointer jumping.

    Each task first keeps a spanning forest of its pairs, fewer than it has competitors; up to `ONE_TASK_EDGES` of them
    are joined in one task, which a fold of one large component is too.  Of more, the minimum is pre-aggregated
    before each shuffle, and lineage is cut every round through the session's checkpoint folder.
    """
    ensure_checkpoint_dir(pairs.sparkSession)
    kinds = ", ".join(f"{c} {pairs.schema[f].dataType.simpleString()}" for c, f in (("u", "c1"), ("v", "c2")))
    forest = pairs.select("c1", "c2").mapInArrow(_forest(), kinds).checkpoint()
    if forest.count() <= ONE_TASK_EDGES:
        one = kinds.replace("u ", "competitor ", 1).replace("v ", "component ", 1)
        return forest.coalesce(1).mapInArrow(_roots(), one)
    edges = forest.select(F.explode(F.array(
        F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*").distinct().checkpoint()
    labels = edges.groupBy("u").agg(F.min("v").alias("m")).select(
        F.col("u").alias("competitor"), F.least("u", "m").alias("component")).checkpoint()
    while True:    # labels only fall, so it ends
        near = (edges.join(labels, edges.v == labels.competitor)
                .groupBy("u").agg(F.min("component").alias("m")).withColumnRenamed("u", "competitor"))
        step = labels.join(near, "competitor").select(
            "competitor", F.least("component", "m").alias("component"), F.col("component").alias("old"))
        jump = step.select(F.col("competitor").alias("k"), F.col("component").alias("root"))
        nxt = step.join(jump, step.component == jump.k, "left").select(
            "competitor", F.least("component", F.coalesce("root", "component")).alias("component"), "old").checkpoint()
        changed = nxt.filter("component <> old").limit(1).count()
        labels = nxt.select("competitor", "component")
        if not changed:
            return labels


def plan_slices(rated: DataFrame, target: int) -> list[Slice]:
    """Cut the calendar into slices of about `target` contests.

    Only one count per day reaches the driver (bounded by the calendar). A day larger than
    the target is split at approximate id quantiles: any cut is exact, only sizes vary.
    """
    days = sorted((r["date"], r["n"]) for r in rated.groupBy("date").agg(F.count("*").alias("n")).collect())
    big = [d for d, n in days if n > target]
    cuts = {}
    if big and rated.schema["contest_id"].dataType.simpleString() in ("bigint", "int"):
        pieces = max(n for _, n in days) // target + 1
        fractions = [i / pieces for i in range(1, pieces)]
        for row in (rated.filter(F.col("date").isin(big)).groupBy("date")
                    .agg(F.percentile_approx("contest_id", fractions, 10_000).alias("q")).collect()):
            cuts[row["date"]] = sorted(set(row["q"]))
    points, filled = [], 0
    for day, n in days:
        if filled and filled + n > target:
            points.append((day, None))
            filled = 0
        for cut in cuts.get(day, []):
            points.append((day, cut))
        filled = 0 if day in cuts else filled + n
    bounds = [None, *points, None]
    return [Slice(a, b) for a, b in zip(bounds, bounds[1:])]


@dataclass(frozen=True)
class SweepPlan:
    """What sweeps over the same contests share: each slice as a table of its contests with both sides' calendar, their
    component and their level, and the labels (competitor, component) of each slice.

    `alone` tells that most of a slice hangs together: its configs are then folded in tasks of their own.
    """

    spark: SparkSession
    tables: list[DataFrame]
    slices: list[Slice]
    labels: list[DataFrame]
    era: int | None
    alone: bool = False

    def rows(self, k: int) -> DataFrame:
        return self.tables[k].filter("level >= 0")


def _values(column) -> list:
    """A column without nulls passes numpy, which is quicker; with nulls, ids keep their type."""
    import pyarrow as pa

    whole = column.null_count == 0 and pa.types.is_primitive(column.type)
    return column.to_numpy(zero_copy_only=False).tolist() if whole else column.to_pylist()


def _levels():
    """Iterator fold that adds `level` to rows in order: one more than the last of either side, so that the contests of
    one level have no competitor in common."""

    def fold(batches):
        import pyarrow as pa

        level = {}
        for batch in batches:
            out = []
            for a, b in zip(_values(batch.column("c1")), _values(batch.column("c2"))):
                up = max(level.get(a, 0), level.get(b, 0))
                level[a] = level[b] = up + 1
                out.append(up)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int32())], names=[*batch.schema.names, "level"])

    return fold


def _calendars():
    """Iterator fold over (date, contest) that adds both sides' calendar and `level`.  Rows with `seen` >= 0 are what is
    known of a competitor from earlier slices; they come first, and the same rows end the output (level -1)."""

    def fold(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        unknown, state, names, types = (0, None, None, 0), {}, None, None
        for batch in batches:
            if names is None:
                names = [n for n in batch.schema.names if n != "seen"]
                types = [batch.schema.field(n).type for n in names]
            out = []
            for a, b, day, label, seen in zip(*(_values(c) for c in (
                    batch.column("c1"), batch.column("c2"), batch.column("date").cast(pa.int32()), batch.column("label"), batch.column("seen")))):
                if seen >= 0:
                    state[a] = (seen, day, label, 0)
                    continue
                x, y = state.get(a, unknown), state.get(b, unknown)
                up = max(x[3], y[3])
                state[a] = (x[0] + 1, day, x[2] if label is None else label, up + 1)
                state[b] = (y[0] + 1, day, y[2] if label is None else label, up + 1)
                out.append((*x[:3], *y[:3], up))
            if out:
                kept = batch.filter(pc.less(batch.column("seen"), 0)) if len(out) < batch.num_rows else batch
                n1, d1, l1, n2, d2, l2, up = zip(*out)
                new = [pa.array(n1, pa.int64()), pa.array(d1, pa.int32()).cast(pa.date32()), pa.array(l1, pa.string()),
                       pa.array(n2, pa.int64()), pa.array(d2, pa.int32()).cast(pa.date32()), pa.array(l2, pa.string()), pa.array(up, pa.int32())]
                yield pa.RecordBatch.from_arrays([kept.column(n) for n in names] + new, names=[*names, *CALENDAR, "level"])
        if state:
            n = len(state)
            seen, day, label, _ = zip(*state.values())
            own = {"c1": list(state), "c2": list(state), "date": pa.array(day, pa.int32()).cast(pa.date32()), "label": list(label)}
            old = [own[c] if isinstance(own.get(c), pa.Array) else pa.array(own[c], t) if c in own else pa.nulls(n, t) for c, t in zip(names, types)]
            end = [pa.array(seen, pa.int64()), *[pa.nulls(n, t) for t in (pa.date32(), pa.string(), pa.int64(), pa.date32(), pa.string())],
                   pa.array([-1] * n, pa.int32())]
            yield pa.RecordBatch.from_arrays(old + end, names=[*names, *CALENDAR, "level"])

    return fold


def _fields(df: DataFrame, columns: Sequence[str] | None = None) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if columns is None or f.name in columns)


def _paired_calendar(rated: DataFrame) -> DataFrame:
    """One row per contest with both sides' calendar by windows, for contests that come more than once."""
    p = pair_sides(timeline(rated))
    return p.select("contest_id", "date", "label", "s", F.col("x1.method").alias("method"), F.col("x1.competitor").alias("c1"),
                    F.col("x2.competitor").alias("c2"), *[F.col(f"x{i}.{c}").alias(f"{c}{i}") for i in (1, 2) for c in ("nth", "prev_date", "prev_label")])


def plan(contests: DataFrame, era: int | None = None, slice_rows: int | None = None) -> SweepPlan:
    """The part of a sweep that no config changes.  `slice_rows` overrides the sizing.

    The slices are read in order; a fold by component gives each contest both sides' calendar and its level, and hands what
    it knows of each competitor to the next slice.  Contests that come more than once are numbered by windows instead,
    which count every copy.
    """
    spark = contests.sparkSession
    rated = rated_since(contests, era).filter("c1 is not null and c2 is not null")
    if slice_rows is None:
        people = max(rated.agg(F.approx_count_distinct("c1"), F.approx_count_distinct("c2")).first())
        slice_rows = max(LEAST_SLICE_ROWS, int(SLICE_FACTOR * people))
    path = f"{ensure_checkpoint_dir(spark)}/sweep-{uuid4().hex}"
    repeated = rated.groupBy("contest_id").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count() > 0
    if repeated:
        _paired_calendar(rated).write.parquet(f"{path}/paired")
        rated = spark.read.parquet(f"{path}/paired")
    slices = plan_slices(rated, slice_rows)
    tables, labels, state, alone = [], [], None, False
    for k, cut in enumerate(slices):
        here = rated if len(slices) == 1 else rated.filter(cut.condition())
        components(here.select("c1", "c2")).write.parquet(f"{path}/labels/{k}")
        label = spark.read.parquet(f"{path}/labels/{k}")
        labels.append(label)
        part = here.join(label.withColumnRenamed("competitor", "c1"), "c1").select(*rated.columns, "component")
        if repeated:
            ordered = part.repartition("component").sortWithinPartitions("date", "contest_id")
            out = ordered.mapInArrow(_levels(), _fields(part) + ", level int")
        else:
            part = part.withColumn("seen", F.lit(-1).cast("bigint"))
            if state is not None:
                part = part.unionByName(state.join(label, "competitor", "left").select(
                    F.col("competitor").alias("c1"), F.col("competitor").alias("c2"), "date", "label", "seen",
                    F.coalesce("component", "competitor").alias("component")), allowMissingColumns=True)
            ordered = part.repartition("component").sortWithinPartitions(F.col("seen") < 0, "date", "contest_id")
            side = ", ".join(f"nth{i} bigint, prev_date{i} date, prev_label{i} string" for i in (1, 2))
            out = ordered.mapInArrow(_calendars(), f"{_fields(part.drop('seen'))}, {side}, level int")
        out.write.parquet(f"{path}/slice/{k}")
        table = spark.read.schema(out.schema).parquet(f"{path}/slice/{k}")
        tables.append(table)
        state = None if repeated else table.filter("level < 0").select(F.col("c1").alias("competitor"), "date", "label", F.col("nth1").alias("seen"))
        most, total = table.filter("level >= 0").groupBy("component").agg(F.count("*").alias("n")).agg(F.max("n"), F.sum("n")).first()
        alone = alone or (most or 0) > LARGEST_SHARE * (total or 0)
    return SweepPlan(spark, tables, slices, labels, era, alone)


def sweep(contests: DataFrame, configs: Sequence[EngineConfig] | EngineConfig, as_of: str,
          slice_rows: int | None = None) -> DataFrame:
    """Rating history, two rows per (config, contest).  `slice_rows` overrides the sizing."""
    configs = [configs] if isinstance(configs, EngineConfig) else list(configs)
    return history_rows(run(plan(contests, era_of(configs), slice_rows), configs, as_of))


CALENDAR = [f"{c}{i}" for i in (1, 2) for c in ("nth", "prev_date", "prev_label")]
RATINGS = ("b1", "a1", "b2", "a2")
ASKED = ("own", "opp")


def _level_folder(n: int, keep: Sequence[str], asked: bool):
    """Iterator fold of `n` configs over rows sorted by level; what is known from earlier slices (level -1) comes first
    and is given out last.  The contests of a level share no competitor, so a level is a handful of array operations.
    A task holds one number per config and competitor.  With `asked` only rows that a price asks for are given out, with
    the favourite's and the other's rating before; a further price of the same contest (`first` false) moves nothing."""

    def fold(batches):
        import numpy as np
        import pyarrow as pa

        ids, dev, of, types = {}, np.zeros((n, 1024)), None, None
        names = [f"{c}_{j}" for j in range(n) for c in (ASKED if asked else RATINGS)]
        for batch in batches:
            numbers = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
            grid = lambda c: np.stack([numbers(f"{c}_{j}") for j in range(n)])
            types = types or [batch.schema.field(c).type for c in keep]
            of = of or batch.schema.field("c1").type
            a, b = (np.array([ids.setdefault(c, len(ids)) for c in _values(batch.column(x))], dtype=np.int64) for x in ("c1", "c2"))
            if len(ids) > dev.shape[1]:
                dev = np.concatenate([dev, np.zeros((n, max(len(ids), 2 * dev.shape[1]) - dev.shape[1]))], axis=1)
            level, s = numbers("level"), numbers("s")
            g1, g2, k1, k2 = (grid(c) for c in ("g1", "g2", "k1", "k2"))
            first = numbers("first") if asked else None
            moves = None if first is None or first.all() else first
            m, seeds = batch.num_rows, int(np.searchsorted(level, 0))
            if seeds:
                dev[:, a[:seeds]] = k1[:, :seeds]
            x, y, nx, ny = (np.empty((n, m)) for _ in range(4))
            cuts = [seeds, *(np.flatnonzero(np.diff(level[seeds:])) + seeds + 1).tolist(), m]
            if len(cuts) * THIN_LEVEL > (m - seeds) * n:     # a long chain: row by row
                p, q, sc = a.tolist(), b.tolist(), s.tolist()
                for j in range(n):
                    d, rows = dev[j].tolist(), []
                    ga, gb, ka, kb = (v[j].tolist() for v in (g1, g2, k1, k2))
                    for i in range(seeds, m):
                        u, v = d[p[i]] * ga[i], d[q[i]] * gb[i]
                        e = 1.0 / (1.0 + 10.0 ** ((v - u) / 400.0))
                        nu, nv = u + ka[i] * (sc[i] - e), v + kb[i] * ((1.0 - sc[i]) - (1.0 - e))
                        if moves is None or moves[i]:
                            d[p[i]], d[q[i]] = nu, nv
                        rows.append((u, v, nu, nv))
                    dev[j] = d
                    if rows:
                        x[j, seeds:], y[j, seeds:], nx[j, seeds:], ny[j, seeds:] = zip(*rows)
            else:
                for lo, hi in zip(cuts, cuts[1:]):
                    if lo == hi:
                        continue
                    i, k, sc = a[lo:hi], b[lo:hi], s[lo:hi]
                    u, v = dev[:, i] * g1[:, lo:hi], dev[:, k] * g2[:, lo:hi]
                    t = (v - u) / 400.0      # powers one by one: an array's differ in the last bit
                    e = 1.0 / (1.0 + np.array([10.0 ** z for z in t.ravel().tolist()]).reshape(t.shape))
                    nu, nv = u + k1[:, lo:hi] * (sc - e), v + k2[:, lo:hi] * ((1.0 - sc) - (1.0 - e))
                    x[:, lo:hi], y[:, lo:hi], nx[:, lo:hi], ny[:, lo:hi] = u, v, nu, nv
                    if moves is None:
                        dev[:, i], dev[:, k] = nu, nv
                    else:
                        f = moves[lo:hi]
                        dev[:, i[f]], dev[:, k[f]] = nu[:, f], nv[:, f]
            if asked:
                side = numbers("side")
                at = np.flatnonzero((side > 0) & (level >= 0))
                new = [v[j, at] for j in range(n) for v in (np.where(side == 1, x, y), np.where(side == 1, y, x))]
                kept = batch.take(pa.array(at))
            else:
                new = [v[j, seeds:] for j in range(n) for v in (x, nx, y, ny)]
                kept = batch.slice(seeds)
            if kept.num_rows:
                yield pa.RecordBatch.from_arrays(
                    [kept.column(c) for c in keep] + [kept.column("c1"), kept.column("level")] + [pa.array(v) for v in new],
                    names=[*keep, "c1", "level", *names])
        if ids:
            size = len(ids)
            end = {f"{'own' if asked else 'a1'}_{j}": pa.array(dev[j, :size]) for j in range(n)}
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(size, t) for t in types] + [pa.array(list(ids), of), pa.array([-1] * size, pa.int32())]
                + [end.get(c, pa.nulls(size, pa.float64())) for c in names], names=[*keep, "c1", "level", *names])

    return fold


def _fold_levels(rows: DataFrame, configs: Sequence[EngineConfig], as_of: str, keep: Sequence[str], state: DataFrame | None,
                 labels: DataFrame, asked: bool) -> DataFrame:
    """One slice under some configs.  Rows are dealt and sorted without any config's columns, which are made after it."""
    n = len(configs)
    if state is not None:
        seeds = state.join(labels, "competitor", "left").select(
            F.col("competitor").alias("c1"), F.col("competitor").alias("c2"), F.coalesce("component", "competitor").alias("component"),
            F.lit(-1).alias("level"), *[f"dev_{j}" for j in range(n)])
        if asked:
            seeds = seeds.select("*", F.lit(0).alias("side"), F.lit(True).alias("first"))
        rows = rows.unionByName(seeds, allowMissingColumns=True)
    ordered = rows.repartition("component").sortWithinPartitions("level")
    columns = []
    for j, config in enumerate(configs):
        sides = (F.struct(*[F.col(f"{c}{i}").alias(c) for c in ("nth", "prev_date", "prev_label")], "date", "label", "method") for i in (1, 2))
        (g1, k1), (g2, k2) = (_carry_and_k(config, as_of, x) for x in sides)
        k1 = k1 if state is None else F.when(F.col("level") < 0, F.col(f"dev_{j}")).otherwise(k1)
        columns += [g1.alias(f"g1_{j}"), k1.alias(f"k1_{j}"), g2.alias(f"g2_{j}"), k2.alias(f"k2_{j}")]
    base = list(dict.fromkeys(["c1", "c2", "s", "level", *(["side", "first"] if asked else []), *keep]))
    given = ordered.select(*base, *columns)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in [*keep, "c1", "level"]],
                        *[f"{c}_{j} double" for j in range(n) for c in (ASKED if asked else RATINGS)]])
    return given.mapInArrow(_level_folder(n, list(keep), asked), schema)


def run_wide(plan: SweepPlan, configs: Sequence[EngineConfig], as_of: str, keep: Sequence[str], asked: bool = False) -> tuple[DataFrame, int]:
    """All slices, folded in order into one table; the state between them lies in it too.  Ratings are columns of the
    configs 0..size-1 of a row's `part`; returns the table and the size."""
    if era_of(configs) != plan.era:
        raise ValueError("the plan is of another era")
    spark = plan.spark
    path = f"{ensure_checkpoint_dir(spark)}/sweep-{uuid4().hex}"
    parts = [[c] for c in configs] if plan.alone else [list(configs)]
    size, before = len(parts[0]), None
    value = "own" if asked else "a1"
    for k, labels in enumerate(plan.labels):
        folds = []
        for g, members in enumerate(parts):
            state = None if before is None else before.filter(F.col("part") == g).select(
                F.col("c1").alias("competitor"), *[F.col(f"{value}_{j}").alias(f"dev_{j}") for j in range(size)])
            folds.append(_fold_levels(plan.rows(k), members, as_of, keep, state, labels, asked).withColumn("part", F.lit(g)))
        folded = reduce(DataFrame.unionByName, folds)
        folded.write.parquet(f"{path}/slice={k}")
        before = spark.read.schema(folded.schema).parquet(f"{path}/slice={k}").filter("level < 0")
    out = spark.read.schema(folded.schema).parquet(path)
    return out.select(*folded.columns).filter("level >= 0").drop("level"), size


def run(plan: SweepPlan, configs: Sequence[EngineConfig], as_of: str, calendar: bool = True) -> DataFrame:
    """The sweep as one row per (config, contest).  Without `calendar` the rows hold the ratings alone, which is all that
    a score of configs reads."""
    about = ["contest_id", "date", "s", "c2", *(["label", *CALENDAR] if calendar else [])]
    wide, size = run_wide(plan, configs, as_of, about)
    if size == 1:
        return wide.select(F.col("part").alias("config_id"), *about, "c1", *[F.col(f"{c}_0").alias(c) for c in RATINGS])
    x = F.explode(F.array(*[F.struct(F.lit(j).alias("config_id"), *[F.col(f"{c}_{j}").alias(c) for c in RATINGS]) for j in range(size)]))
    return wide.select(*about, "c1", x.alias("x")).select("x.config_id", *about, "c1", *[f"x.{c}" for c in RATINGS])


def with_asked(plan: SweepPlan, settled: DataFrame) -> SweepPlan:
    """The plan with the settled prices beside their contests: `side` the favourite's (0 where no price asks), `first`
    false for a further price of the same contest, and the price's year and outcome."""
    path = f"{ensure_checkpoint_dir(plan.spark)}/sweep-{uuid4().hex}/asked"
    asks = settled.select("contest_id", "competitor", "year", "fav_won", F.row_number().over(
        W.partitionBy("contest_id").orderBy("price_id")).alias("place"))
    side = F.when(F.col("competitor") == F.col("c1"), 1).when(F.col("competitor") == F.col("c2"), 2).otherwise(0)
    tables = []
    for k in range(len(plan.slices)):
        rows = plan.rows(k)
        out = rows.join(asks, "contest_id", "left").select(
            *rows.columns, side.alias("side"), (F.coalesce("place", F.lit(1)) == 1).alias("first"), "year", "fav_won")
        out.write.parquet(f"{path}/{k}")
        tables.append(plan.spark.read.schema(out.schema).parquet(f"{path}/{k}"))
    return replace(plan, tables=tables)


def rating_rows(folded: DataFrame) -> DataFrame:
    """Both sides' ratings before the contest, of a sweep with or without its calendar."""
    side = lambda i, j: F.struct(F.col(f"c{i}").alias("competitor"), (F.lit(1500.0) + F.col(f"b{i}")).alias("rating_before"),
                                 (F.lit(1500.0) + F.col(f"b{j}")).alias("opponent_rating"))
    return folded.select("config_id", "contest_id", F.explode(F.array(side(1, 2), side(2, 1))).alias("x")).select(
        "config_id", "contest_id", "x.*")


def history_rows(folded: DataFrame, *carried: str) -> DataFrame:
    """Two rows per (config, contest), each from one competitor's side; `carried` columns go with both."""
    side = lambda i, j, s: F.struct(
        F.lit(i).alias("side"), F.col(f"c{i}").alias("competitor"), F.col(f"c{j}").alias("opponent"),
        F.col(f"nth{i}").alias("nth"), F.col(f"prev_date{i}").alias("prev_date"),
        F.col(f"prev_label{i}").alias("prev_label"), s.alias("score"),
        F.col(f"b{i}").alias("before"), F.col(f"a{i}").alias("after"), F.col(f"b{j}").alias("opp"))
    x = F.explode(F.array(side(1, 2, F.col("s")), side(2, 1, 1 - F.col("s"))))
    return folded.select("config_id", "contest_id", "date", "label", *carried, x.alias("x")).select(
        "config_id", "contest_id", "date", "label", *carried, "x.side", "x.competitor", "x.opponent", "x.nth",
        "x.prev_date", "x.prev_label", "x.score",
        F.when(F.col("x.score") == 1, "W").when(F.col("x.score") == 0, "L").otherwise("D").alias("result"),
        (F.lit(1500.0) + F.col("x.before")).alias("rating_before"),
        (F.lit(1500.0) + F.col("x.after")).alias("rating_after"),
        (F.col("x.after") - F.col("x.before")).alias("delta"),
        (F.lit(1500.0) + F.col("x.opp")).alias("opponent_rating"))


def final_states(history: DataFrame, as_of: str, engine: EngineConfig | None = None) -> DataFrame:
    """Running state per competitor, regressed from the last contest to `as_of`."""
    engine = engine or EngineConfig()
    order = F.struct("date", "contest_id")
    s = history.groupBy("config_id", "competitor").agg(
        F.count("*").alias("contests_rated"), F.max("date").alias("last_date"),
        F.max_by("label", F.when(F.col("label").isNotNull(), order)).alias("last_division"),
        F.greatest(F.lit(engine.initial_rating), F.max("rating_after")).alias("peak"),
        F.max_by("rating_after", order).alias("at_last"))
    gap = C.months_between_days(F.col("last_date"), F.lit(as_of).cast("date"))
    return s.withColumn("rating", C.regress(F.col("at_last"), gap, engine))


def with_rating(df: DataFrame, states: DataFrame, key: str = "competitor", column: str = "rating") -> DataFrame:
    """Unseen competitors get the initial rating."""
    s = states.select(F.col("competitor").alias(key), F.col("rating").alias(column))
    return df.join(s, key, "left").withColumn(column, F.coalesce(column, F.lit(EngineConfig().initial_rating)))
