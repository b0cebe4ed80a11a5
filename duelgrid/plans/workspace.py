"""Products shared by many queries, built once per session and input folder.

Each product is written as a table into the session's shared checkpoint folder and read back,
so later plans start from a short scan with statistics, and losing an executor costs nothing.
The rating history is the table most jobs read.
"""

from __future__ import annotations

import hashlib
from functools import cached_property
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F

from duelgrid.config import EngineConfig, FilterParams
from duelgrid.functions.timeline import number_timeline
from duelgrid.functions import core as C
from duelgrid.operators import backtest, analytics, etl, identity, market, ranking, surface, sweep
from duelgrid.functions.names import name_pair
from duelgrid.session import ensure_checkpoint_dir, limit_methods
from duelgrid.sources import bindings as B, sinks as K
from duelgrid.sources.readers import path_exists

_OPEN: dict[tuple[str, str], "Workspace"] = {}


def workspace(spark: SparkSession, sf_dir: str) -> "Workspace":
    limit_methods(spark)
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _OPEN:
        _OPEN[key] = Workspace(spark, sf_dir)
    return _OPEN[key]


class Workspace:
    def __init__(self, spark: SparkSession, sf_dir: str, as_of: str = B.AS_OF):
        self.spark, self.dir, self.as_of = spark, sf_dir, as_of
        self.engine = EngineConfig()
        self.root = f"{ensure_checkpoint_dir(spark)}/products-{uuid4().hex}"

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def table(self, name: str) -> DataFrame:
        return B.table(self.spark, self.dir, name)

    @property
    def today(self):
        return F.lit(self.as_of).cast("date")

    @cached_property
    def contest_years(self) -> DataFrame:
        """All contests, lying by years."""
        return K.write_years(B.contests(self.spark, self.dir), f"{self.root}/contests")

    @cached_property
    def contests(self) -> DataFrame:
        return K.years_between(self.contest_years)

    def contests_since(self, year: int | None) -> DataFrame:
        """The contests an era starts with: earlier years are not read."""
        return K.years_between(self.contest_years, year)

    @cached_property
    def sides(self) -> DataFrame:
        return self.keep("sides", number_timeline(etl.to_sides(self.contests)))

    @cached_property
    def laid_out(self) -> DataFrame:
        """The rows of `sides` without their numbers, for what needs none: a scan of the contests, no shuffle."""
        return etl.to_sides(self.contests).filter("date is not null")

    @cached_property
    def competitors(self) -> DataFrame:
        return self.keep("competitors", B.competitors(self.spark, self.dir, self.laid_out))

    @cached_property
    def name_index(self) -> DataFrame:
        """I4: letter runs of all names, in a table that a search reads by its own runs."""
        path = f"{self.root}/name_index"
        return surface.write_name_index(self.competitors, path)

    @cached_property
    def external(self) -> DataFrame:
        return self.keep("external", B.external_ranking(self.competitors))

    @cached_property
    def overrides(self) -> DataFrame:
        return B.overrides(self.external)

    @cached_property
    def sweep_plan(self) -> sweep.SweepPlan:
        """What every sweep over all contests shares, whatever its configs."""
        return sweep.plan(self.contests)

    @cached_property
    def folded(self) -> DataFrame:
        """The sweep under the default engine, one row per contest."""
        return sweep.run(self.sweep_plan, [self.engine], self.as_of)

    @cached_property
    def rated(self) -> DataFrame:
        """Rated contests per competitor: a table of known size, so while it is small the history is not shuffled to meet it."""
        return self.keep("rated", sweep.history_rows(self.folded).groupBy("competitor").agg(F.count("*").alias("rated")))

    @cached_property
    def history(self) -> DataFrame:
        """Rating history under the default engine, numbered per competitor."""
        h = sweep.history_rows(self.folded)
        return self.keep("history", h.join(self.rated, "competitor").withColumn("rev", F.col("rated") - F.col("nth")))

    @cached_property
    def states(self) -> DataFrame:
        return self.keep("states", sweep.final_states(self.history, self.as_of, self.engine))

    @cached_property
    def log(self) -> DataFrame:
        """Rating history with the contest's method, round and opponent name."""
        return self.keep("log", self.logged(self.folded))

    def log_of(self, *competitors) -> DataFrame:
        """The log's rows of a few competitors, from their contests alone."""
        mine = F.col("c1").isin(*competitors) | F.col("c2").isin(*competitors)
        return self.logged(self.folded.filter(mine)).filter(F.col("competitor").isin(*competitors))

    def logged(self, folded: DataFrame) -> DataFrame:
        # contests meet the sweep's rows before they are laid out by side: half the rows, and no numbered sides
        about = self.contests.filter("date is not null").select(
            "contest_id", "method", "round", "details", "event_id", F.col("c1").alias("first"), "name1", "name2")
        extra = ["method", "round", "details", "event_id", "first", "name1", "name2"]
        h = sweep.history_rows(folded.join(about.select("contest_id", F.struct(*extra).alias("about")), "contest_id"), "about")
        mine = F.col("competitor") == F.col("about.first")
        out = h.join(self.rated, "competitor").withColumn("rev", F.col("rated") - F.col("nth"))
        columns = [c for c in out.columns if c not in ("contest_id", "competitor", "about")]
        return out.select(
            "contest_id", "competitor", *columns, *[f"about.{c}" for c in extra[:4]],
            F.when(mine, F.col("about.name1")).otherwise(F.col("about.name2")).alias("name"),
            F.when(mine, F.col("about.name2")).otherwise(F.col("about.name1")).alias("opponent_name"))

    @cached_property
    def births(self) -> DataFrame:
        return B.births(self.spark, self.dir)

    @cached_property
    def samples(self) -> DataFrame:
        return self.keep("samples", analytics.samples(self.laid_out))

    @cached_property
    def pace(self) -> DataFrame:
        return self.keep("pace", analytics.pace_windows(analytics.usable(self.laid_out)))

    @cached_property
    def pace_wide(self) -> DataFrame:
        return self.keep("pace_wide", analytics.pace_wide(self.pace))

    @cached_property
    def trend_context(self) -> DataFrame:
        return analytics.trend_context(self.log, self.states, self.births, self.today)

    @cached_property
    def profile(self) -> DataFrame:
        """One row per competitor from all per-competitor products (joins on the same key)."""
        h = C.half_up
        rank = self.final.groupBy("competitor").agg(F.max_by(F.struct(
            "division", "rank", "contender_rank", "is_champion", "final_rating", "schedule_quality"), "final_rating").alias("r"))
        latest = self.history.groupBy("competitor").agg(F.max("date").alias("latest"), F.min("date").alias("debut"))
        nudge = self.pace_wide.select(
            "competitor", analytics.form_nudge(F.col("diff15_delta"), F.col("td15_delta")).alias("form_nudge"),
            "ratio_career", "ratio_last3", F.col("career.contests").alias("sample_contests"))
        c = self.competitors
        fin = F.col("ko_rate") + F.col("sub_rate")
        rating = F.coalesce("rating", F.lit(1500.0))
        joined = (c.join(self.states.select("competitor", "rating", "peak", "contests_rated"), "competitor", "left")
                  .join(rank, "competitor", "left").join(latest, "competitor", "left").join(nudge, "competitor", "left")
                  .join(self.births, "competitor", "left"))
        return self.keep("profile", joined.select(
            "competitor", "name", "gender", "home_division", F.concat_ws("-", "wins", "losses", "draws").alias("record"),
            "contests", F.coalesce("contests_rated", F.lit(0)).alias("contests_rated"),
            C.whole_years(F.col("born"), self.today).alias("age"),
            F.col("r.division").alias("ranked_division"), F.col("r.contender_rank").alias("shown_rank"),
            F.coalesce("r.is_champion", F.lit(False)).alias("is_champion"),
            h(rating, 2).alias("rating"), h(F.coalesce("peak", F.lit(1500.0)), 2).alias("peak"),
            h(C.display_score(rating), 2).alias("display"), F.col("r.schedule_quality").alias("schedule_quality"),
            h(F.coalesce(C.months_between_days(F.col("latest"), self.today), F.lit(999.0)), 1).alias("months_since"),
            h(fin, 3).alias("finish_rate"), "ko_rate", "sub_rate", "accuracy",
            analytics.style_label(F.col("ko_rate"), F.col("sub_rate"), F.col("accuracy"), fin).alias("style"),
            F.coalesce("form_nudge", F.lit(0.0)).alias("form_nudge"), "ratio_career", "ratio_last3",
            F.coalesce("sample_contests", F.lit(0)).alias("sample_contests")))

    @cached_property
    def roster(self) -> DataFrame:
        return B.roster(self.spark, self.dir)

    @cached_property
    def prices(self) -> DataFrame:
        return self.keep("prices", B.closing_prices(self.contests))

    @cached_property
    def price_names(self) -> DataFrame:
        """Every distinct feed name with the id it resolves to (strict cascade)."""
        names = self.prices.select(F.explode(F.array("favourite", "underdog")).alias("name"))
        return self.keep("price_names", identity.resolve_names(
            names, self.roster, B.feed_overrides(self.roster), last_first=False))

    @cached_property
    def resolved_prices(self) -> DataFrame:
        n = self.price_names.filter("competitor is not null")
        return (self.prices.select("price_id", "favourite", "underdog")
                .join(n.select(F.col("name").alias("favourite"), F.col("competitor").alias("fav_id")), "favourite", "left")
                .join(n.select(F.col("name").alias("underdog"), F.col("competitor").alias("dog_id")), "underdog", "left")
                .select("price_id", "fav_id", "dog_id"))

    @cached_property
    def known_before(self) -> DataFrame:
        """H5: what was known before each contest; both sides of a price are looked up in it."""
        return self.keep("known_before", market.point_in_time(self.history))

    @cached_property
    def joined_prices(self) -> DataFrame:
        out = market.join_prices(self.prices, self.resolved_prices, self.known_before)
        return self.keep("joined_prices", market.with_devig(out))

    @cached_property
    def market_method(self) -> str:
        """The de-vig method of the least log-loss; everything that reads a market probability uses it."""
        ok = self.joined_prices.filter("verdict = 'ok'")
        rows = ok.select("fav_won", F.explode(F.array(*[
            F.struct(F.lit(m).alias("method"), F.col(f"p_{m}").alias("p")) for m in market.METHODS])).alias("x")).select("fav_won", "x.*")
        best = backtest.scores(rows, "p", "fav_won", ["method"]).agg(F.min_by("method", "log_loss")).first()[0]
        return best or market.METHODS[0]

    @cached_property
    def samples_priced(self) -> DataFrame:
        return self.joined_prices.filter("verdict = 'ok'").withColumn("market_p", F.col(f"p_{self.market_method}"))

    @cached_property
    def settled_prices(self) -> DataFrame:
        """Settled price rows with the contest they belong to, seen from the favourite."""
        rated = sweep.rated_contests(self.contests)
        index = market.contest_days(rated)
        asked = self.prices.join(self.resolved_prices, "price_id").filter(
            "fav_id is not null and dog_id is not null and outcome <> 'unknown'")
        req = asked.select("price_id", F.col("fav_id").alias("competitor"), F.col("dog_id").alias("opponent"), "date")
        hit = market.nearest_day(req, index, "price_id").select("price_id", F.col("hit.contest_id").alias("contest_id"))
        return self.keep("settled_prices", hit.join(asked, "price_id").select(
            "price_id", "contest_id", F.col("fav_id").alias("competitor"), F.year("date").alias("year"),
            (F.col("outcome") == "favourite").alias("fav_won")))

    @cached_property
    def priced_plan(self) -> sweep.SweepPlan:
        """The sweep's plan with the settled prices beside their contests: what a score of configs reads."""
        return sweep.with_asked(self.sweep_plan, self.settled_prices)

    @cached_property
    def reigns(self) -> DataFrame:
        return self.keep("reigns", B.reigns(self.contests))

    @cached_property
    def titles(self) -> DataFrame:
        cands = market.title_candidates(B.title_format(self.contests), self.reigns, self.as_of)
        return self.keep("titles", market.attribute_titles(cands))

    @cached_property
    def raw_rounds(self) -> DataFrame:
        return self.keep("raw_rounds", B.raw_rounds(self.spark, self.dir, self.contests))

    @cached_property
    def side_stats(self) -> DataFrame:
        return self.keep("side_stats", etl.aggregate_rounds(self.raw_rounds))

    @cached_property
    def profiles(self) -> DataFrame:
        return B.foreign_profiles(self.competitors)

    @cached_property
    def outside(self) -> DataFrame:
        """Contest history outside the organisation."""
        return B.outside_history(self.spark, self.dir)

    @cached_property
    def pedigree(self) -> DataFrame:
        return self.keep("pedigree", ranking.pedigree_strength(self.outside, self.laid_out))

    def _ranking_inputs(self, engine: EngineConfig):
        members, removals = ranking.memberships(self.external, self.overrides)
        cand = ranking.candidates(self.competitors, members, removals)
        div = ranking.division_sides(self.laid_out, cand, self.as_of, engine)
        return cand, div

    @cached_property
    def ranked(self) -> DataFrame:
        cand, div = self._ranking_inputs(self.engine)
        elig = ranking.eligible(self.competitors, cand, div)
        scored = self.keep("scored", ranking.score(
            elig, div, self.states, self.pedigree, self.as_of, self.engine))
        return self.keep("ranked", ranking.order_by_rating(scored))

    @cached_property
    def edges(self) -> DataFrame:
        return self.keep("edges", ranking.head_to_head_edges(
            self.ranked, self.contests, self.laid_out, self.as_of, self.engine))

    @cached_property
    def moved(self) -> DataFrame:
        return self.keep("moved", ranking.apply_edges(self.ranked, self.edges))

    @cached_property
    def final(self) -> DataFrame:
        return self.keep("final", ranking.contender_rank(
            ranking.finalize(self.moved, ranking.loss_streaks(self.laid_out))))

    def swept(self, engine: EngineConfig) -> DataFrame:
        """The rating history of an engine: swept once for each signature and `as_of`, then read from its table."""
        name = "history-" + hashlib.sha256(f"{engine!r} {self.as_of}".encode()).hexdigest()[:16]
        if path_exists(self.spark, f"{self.root}/{name}/_SUCCESS"):
            return self.spark.read.parquet(f"{self.root}/{name}")
        return self.keep(name, sweep.sweep(self.contests_since(engine.era_start_year), engine, self.as_of))

    def rankings(self, filters: FilterParams = FilterParams()) -> DataFrame:
        """All divisions under user filters; the neutral position is the shared product."""
        if filters == FilterParams():
            return self.final
        engine = filters.engine(self.engine)
        states = sweep.final_states(self.swept(engine), self.as_of, engine)
        return ranking.contender_rank(ranking.rank_divisions(
            self.competitors, self.contests, self.sides, states, self.external, self.overrides, self.pedigree,
            self.as_of, engine))
