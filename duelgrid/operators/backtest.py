"""Scoring and fitting of predictions, walk-forward folds, parameter search (ids H9-H20)."""

from __future__ import annotations

from dataclasses import replace
from typing import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from duelgrid.config import SEARCH_GRID, EngineConfig
from duelgrid.functions import core as C
from duelgrid.functions.timeline import positions
from duelgrid.session import ensure_checkpoint_dir

EPS = 1e-12


def clip(p: Column) -> Column:
    return F.least(F.lit(1 - EPS), F.greatest(F.lit(EPS), p))


def logit(p: Column) -> Column:
    return F.ln(clip(p) / (1 - clip(p)))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def scores(rows: DataFrame, p: str, won: str, by: Sequence[str] = ()) -> DataFrame:
    """H9: sample size, log-loss, Brier score and accuracy in one pass."""
    q = clip(F.col(p))
    y = F.col(won).cast("int")
    loss = F.when(F.col(won), -F.ln(q)).otherwise(-F.ln(1 - q))
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(loss).alias("log_loss"),
        F.avg((F.col(p) - y) * (F.col(p) - y)).alias("brier"),
        F.avg(((F.col(p) >= 0.5) == F.col(won)).cast("double")).alias("accuracy"))


def reliability(rows: DataFrame, p: str, won: str, by: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """Calibration curve; empty bins stay in the result, the last bin is closed."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int").alias("bin")
    got = rows.groupBy(*by, b).agg(F.count("*").alias("n"), F.avg(p).alias("predicted"),
                                   F.avg(F.col(won).cast("double")).alias("realized"))
    frame = rows.select(*by).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))) if by else \
        rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return frame.join(got, [*by, "bin"], "left").fillna(0, ["n", "predicted", "realized"])


def calibration_error(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return curve.groupBy(*by).agg(
        (F.sum(F.col("n") * F.abs(F.col("predicted") - F.col("realized"))) / F.greatest(F.sum("n"), F.lit(1))).alias("ece"))


def fit_logistic(rows: DataFrame, features: Sequence[str], target: str, by: str | None = None,
                 iterations: int = 30, ridge: float = 1e-6) -> dict:
    """Logistic regression by IRLS, all groups at once.

    Each iteration is one aggregate of k(k+1)/2 + k sums per group; only those sums reach the
    driver, where a system of at most a few unknowns is solved. Stops early at a fixed point.
    """
    names = ["_one", *features]
    data = rows.select((F.col(by) if by else F.lit(0)).alias("_g"), F.lit(1.0).alias("_one"),
                       *[F.col(f).cast("double").alias(f) for f in features], F.col(target).cast("double").alias("_y")).persist()
    weights: dict = {}
    k = len(names)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    for _ in range(iterations):
        if weights:
            table = F.create_map(*[x for g, w in weights.items() for x in (F.lit(g), F.array(*[F.lit(float(v)) for v in w]))])
            w = [table[F.col("_g")][i] for i in range(k)]
        else:
            w = [F.lit(0.0)] * k
        eta = sum((F.col(n) * wi for n, wi in zip(names[1:], w[1:])), w[0])
        mu = sigmoid(eta)
        g = data.withColumn("_eta", eta).withColumn("_mu", mu).withColumn(
            "_w", F.greatest(F.col("_mu") * (1 - F.col("_mu")), F.lit(1e-9))).withColumn(
            "_z", F.col("_eta") + (F.col("_y") - F.col("_mu")) / F.col("_w"))
        sums = g.groupBy("_g").agg(
            *[F.sum(F.col(names[i]) * F.col("_w") * F.col(names[j])).alias(f"h{i}_{j}") for i, j in pairs],
            *[F.sum(F.col(names[i]) * F.col("_w") * F.col("_z")).alias(f"g{i}") for i in range(k)]).collect()
        fresh = {}
        for row in sums:
            h = np.zeros((k, k))
            for i, j in pairs:
                h[i, j] = h[j, i] = row[f"h{i}_{j}"]
            fresh[row["_g"]] = np.linalg.solve(h + ridge * np.eye(k), np.array([row[f"g{i}"] for i in range(k)]))
        still = weights and all(np.max(np.abs(fresh[g] - weights[g])) < 1e-13 for g in fresh)
        weights = fresh
        if still:
            break
    data.unpersist()
    return {g: [float(v) for v in w] for g, w in weights.items()}


def predict(weights: dict, features: Sequence[Column], group: Column | None = None) -> Column:
    table = F.create_map(*[x for g, w in weights.items() for x in (F.lit(g), F.array(*[F.lit(v) for v in w]))])
    w = table[group if group is not None else F.lit(0)]
    return sigmoid(sum((f * w[i + 1] for i, f in enumerate(features)), w[0]))


def chronological_split(rows: DataFrame, key: str, share: float = 0.7) -> DataFrame:
    """`is_train` for the earliest share; numbering runs per day plus day offsets."""
    n = rows.count()
    cut = int(n * share)
    return positions(rows, [], F.col("date"), [F.asc("date"), F.asc(key)], "chron").withColumn(
        "is_train", F.col("chron") <= cut)


def default_test_years(years: Sequence[int], n_test: int = 5, min_train: int = 3) -> list[int]:
    """The last years that have enough earlier years."""
    years = sorted(set(years))
    return years[min_train:][-n_test:] if len(years) > min_train else []


def walk_forward(rows: DataFrame, test_years: Sequence[int], year: str = "year") -> DataFrame:
    """(fold, role) rows of the expanding window; folds with an empty side are dropped by callers."""
    folds = F.array(*[F.lit(int(y)) for y in test_years])
    return rows.withColumn("fold", F.explode(F.filter(folds, lambda f: F.col(year) <= f))).withColumn(
        "role", F.when(F.col(year) == F.col("fold"), "test").otherwise("train"))


def _fold_sums(size: int, folds: Sequence[int], weights: dict):
    """Partial sums of a task for one step of every (config, fold): the rows of a batch are put in order of year, so that
    each fold's training rows are its first ones."""

    def sums(batches):
        import numpy as np
        import pyarrow as pa

        total: dict = {}
        for batch in batches:
            part, year = (batch.column(c).to_numpy() for c in ("part", "year"))
            won = batch.column("fav_won").to_numpy(zero_copy_only=False).astype(np.float64)
            for g in np.unique(part):
                mine = np.flatnonzero(part == g)
                mine = mine[np.argsort(year[mine], kind="stable")]
                ends, y = np.searchsorted(year[mine], folds), won[mine]
                for j in range(size):
                    x = batch.column(f"x_{j}").to_numpy()[mine]
                    for f, end in zip(folds, ends):
                        if end == 0:
                            continue
                        unit = (int(g) * size + j, f)
                        w0, w1 = weights.get(unit, (0.0, 0.0))
                        xs = x[:end]
                        eta = w0 + w1 * xs
                        with np.errstate(over="ignore"):
                            mu = 1.0 / (1.0 + np.exp(-eta))
                        v = np.maximum(mu * (1.0 - mu), 1e-9)
                        z = eta + (y[:end] - mu) / v
                        vx, vz = v * xs, v * z
                        new = np.array([v.sum(), vx.sum(), (vx * xs).sum(), vz.sum(), (vz * xs).sum()])
                        total[unit] = total[unit] + new if unit in total else new
        if total:
            yield pa.RecordBatch.from_arrays(
                [pa.array([u for u, _ in total]), pa.array([f for _, f in total])] + [pa.array(v) for v in zip(*total.values())],
                names=["unit", "fold", "h00", "h01", "h11", "g0", "g1"])

    return sums


def fit_folds(samples: DataFrame, size: int, folds: Sequence[int], iterations: int = 30, ridge: float = 1e-6) -> dict:
    """The logistic fit of every (config, fold) on the rows before the fold's year, without a copy of the rows per
    fold.  samples: part, year, fav_won, x_0..x_(size-1), the logit of configs part * size + j.

    A step is one pass, of which a few sums per task reach the driver.  Newton's steps square their distance to the fixed
    point, so a step below 1e-8 leaves less than a double tells.
    """
    weights: dict = {}
    for _ in range(iterations):
        rows = samples.mapInArrow(_fold_sums(size, list(folds), weights), "unit bigint, fold bigint, h00 double, h01 double, h11 double, g0 double, g1 double")
        total: dict = {}
        for r in rows.collect():
            unit = (r["unit"], r["fold"])
            total[unit] = total.get(unit, 0.0) + np.array(r[2:])
        fresh = {u: np.linalg.solve(np.array([[t[0], t[1]], [t[1], t[2]]]) + ridge * np.eye(2), t[3:]) for u, t in total.items()}
        step = max((float(np.max(np.abs(w - weights.get(u, 0.0)))) for u, w in fresh.items()), default=0.0)
        weights = fresh
        if step < 1e-8:
            break
    return {u: [float(v) for v in w] for u, w in weights.items()}


def pooled_out_of_sample(samples: DataFrame, size: int) -> DataFrame:
    """Calibrate per (config, fold) on earlier years, pool the held-out predictions of each config.

    samples: see `fit_folds`.  Years are a handful of numbers, collected to choose the folds; everything else is grouped.
    """
    years = [r[0] for r in samples.select("year").distinct().collect()]
    folds = default_test_years(years)
    weights = fit_folds(samples, size, folds)
    units = max((u for u, _ in weights), default=-1) + 1
    # of a held-out row: its fold's place among the folds, and with its config that of its weights
    place = F.coalesce(*[F.when(F.col("year") == f, F.lit(i)) for i, f in enumerate(folds)], F.lit(None).cast("int"))
    none = [float("nan")] * 2
    table = F.array(*[F.array(*[F.lit(v) for v in weights.get((u, f), none)]) for u in range(units) for f in folds] or [F.array(F.lit(0.0))])
    configs = F.array(*[F.struct((F.col("part") * size + j).alias("config_id"), F.col(f"x_{j}").alias("x")) for j in range(size)])
    test = (samples.filter(F.col("year").isin(list({f for _, f in weights}))).withColumn("place", place)
            .select("fav_won", "place", F.explode(configs).alias("c")).select("fav_won", "place", "c.*")
            .withColumn("w", table[F.col("config_id") * len(folds) + F.col("place")]))
    return scores(test.withColumn("p", sigmoid(F.col("x") * F.col("w")[1] + F.col("w")[0])), "p", "fav_won", ["config_id"])


def grid_line(base: EngineConfig, knob: str, grid: dict = SEARCH_GRID) -> list[EngineConfig]:
    return [replace(base, **{knob: type(getattr(base, knob))(v)}) for v in grid[knob]]


def coordinate_search(evaluate, base: EngineConfig, passes: int = 2, grid: dict = SEARCH_GRID):
    """Coordinate descent; `evaluate(configs) -> [log-loss]` scores a whole line in one job.

    Improvements are taken in grid order with the 1e-6 margin, so the path equals the
    one-candidate-at-a-time search: knobs do not interact within a line.
    """
    seen: dict = {}

    def line_scores(configs):
        missing = list({repr(c): c for c in configs if repr(c) not in seen}.values())
        for c, s in zip(missing, evaluate(missing) if missing else []):
            seen[repr(c)] = s
        return [seen[repr(c)] for c in configs]

    # the first line starts from the base, so both are one job
    best, best_score = base, line_scores([base, *(c for knob in list(grid)[:1] for c in grid_line(base, knob, grid) if passes)])[0]
    first, trail = best_score, []
    for p in range(passes):
        for knob in grid:
            line = grid_line(best, knob, grid)
            for config, s in zip(line, line_scores(line)):
                better = s < best_score - 1e-6
                trail.append((p + 1, knob, float(getattr(config, knob)), s, better))
                if better:
                    best, best_score = config, s
    return best, best_score, first, trail


def config_diff(base: EngineConfig, best: EngineConfig, grid: dict = SEARCH_GRID) -> list[tuple]:
    """Changed knobs."""
    return [(k, float(getattr(base, k)), float(getattr(best, k))) for k in grid if getattr(base, k) != getattr(best, k)]


def coverage(joined: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Match rate per year, matched volume per division."""
    ok = F.col("verdict") == "ok"
    by_year = joined.groupBy("year").agg(F.count("*").alias("total"), F.count_if(ok).alias("matched"))
    by_division = joined.filter(ok).groupBy("division").agg(F.count("*").alias("matched"))
    return by_year, by_division


def for_winner(samples: DataFrame, market: str = "market_p") -> DataFrame:
    """Each sample seen from the side that won."""
    won = F.col("fav_won")
    pick = lambda a, b: F.when(won, F.col(a)).otherwise(F.col(b))
    return samples.select(
        "price_id", "date", "division", "both_established", pick("fav_id", "dog_id").alias("winner"),
        pick("dog_id", "fav_id").alias("loser"),
        F.when(won, F.col("model_p")).otherwise(1 - F.col("model_p")).alias("model_winner"),
        F.when(won, F.col(market)).otherwise(1 - F.col(market)).alias("market_winner"),
        (pick("fav_no", "dog_no") + 1).alias("winner_no"), (pick("dog_no", "fav_no") + 1).alias("loser_no"),
        pick("fav_provisional", "dog_provisional").alias("winner_provisional"),
        pick("dog_layoff", "fav_layoff").alias("loser_layoff"), (F.col("fav_moved") | F.col("dog_moved")).alias("moved"))


def prior_form(asked: DataFrame, sides: DataFrame, key: str, who: str, count: int = 5) -> DataFrame:
    """Results strictly before a date, newest first, for a small table of questions."""
    from pyspark.sql import Window as W
    q = F.broadcast(asked.select(key, F.col(who).alias("competitor"), F.col("date").alias("before")))
    w = W.partitionBy(key).orderBy(F.desc("date"), F.desc("contest_id"))
    rows = (sides.select("competitor", "date", "contest_id", "result").join(q, "competitor")
            .filter(F.col("date") < F.col("before")).withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= count))
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "result"))),
                                                         lambda x: x["result"]), "").alias(f"{who}_form"))


def worst_misses(viewed: DataFrame, sides: DataFrame, limit: int) -> DataFrame:
    """The contests the model called most wrongly, with both competitors' prior form."""
    # a bounded table, cut off here: its plan would be run three times
    ensure_checkpoint_dir(viewed.sparkSession)
    worst = viewed.orderBy("model_winner", "price_id").limit(limit).checkpoint()
    for who in ("winner", "loser"):
        worst = worst.join(prior_form(worst.select("price_id", "date", who), sides, "price_id", who), "price_id", "left")
    return worst.fillna("-", ["winner_form", "loser_form"])


def miss_tally(worst: DataFrame) -> DataFrame:
    return worst.agg(
        F.count("*").alias("n"), F.count_if(F.col("winner_no") <= 4).alias("newcomer"),
        F.count_if("winner_provisional").alias("provisional"), F.count_if(F.col("loser_layoff") >= 12).alias("long_layoff"),
        F.count_if("moved").alias("moved"), F.count_if(F.col("market_winner") < 0.5).alias("market_wrong"),
        F.count_if(F.col("winner_form").startswith("WW")).alias("on_streak"),
        F.count_if(F.col("loser_form").contains("L")).alias("off_loss"), F.count_if("both_established").alias("established"))


def model_vs_market(samples: DataFrame, market: str = "market_p") -> DataFrame:
    """Win rates, agreement, the record when they disagree, and the mean gap."""
    picks = F.col("model_p") >= 0.5
    rate = lambda c: F.avg(c.cast("double"))
    return samples.agg(
        F.count("*").alias("matched"), rate(F.col("fav_won")).alias("market_rate"), rate(picks == F.col("fav_won")).alias("model_rate"),
        rate(picks).alias("agreement"), F.count_if(~picks).alias("disagreements"),
        F.coalesce(F.avg(F.when(~picks, (~F.col("fav_won")).cast("double"))), F.lit(0.0)).alias("underdog_rate"),
        F.avg(F.abs(F.col("model_p") - F.col(market))).alias("mean_gap"))
