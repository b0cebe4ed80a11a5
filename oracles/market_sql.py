"""Oracles of market and backtest queries."""

from oracles.base import AS_OF, cte, months, r, sql, sweep_ctes
from oracles import ranking, analytics, market  # noqa: F401
from oracles.market import LOGIT, PIT, irls, nearest, norm, pair, scored, with_form

AM = f"CASE WHEN fav_odds>=2 THEN {r('(fav_odds-1)*100')} WHEN fav_odds>1 THEN {r('-100/(fav_odds-1)')} END"
BACK = f"CASE WHEN a>0 THEN 1+a/100 WHEN a<0 THEN 1+100/abs(a) END"
R6 = lambda *cs: ", ".join(f"{r(c, 6)} AS {c}" for c in cs)
sweep_ctes("o_", base_k=40.0, move=0.2)
Ks = (12, 18, 24, 32, 40, 50)
for _i, _k in enumerate(Ks):
    _p = f"g{_i}_"
    sweep_ctes(_p, base_k=float(_k))
    cte(f"{_p}pit", PIT.format(h=f"{_p}history"))
    nearest(f"{_p}hit", "fav_id", "dog_id", f"{_p}pit")
cte("grid_rows", " UNION ALL ".join(f"""SELECT {float(k)}::DOUBLE AS base_k, p.price_id, year(p.date) AS year, p.outcome='favourite' AS fav_won,
  1/(1+pow(10::DOUBLE,(f.hit.opponent_rating-f.hit.self_rating)/400)) AS model_p FROM prices p JOIN g{i}_hit f USING (price_id) WHERE p.outcome<>'unknown'""" for i, k in enumerate(Ks)))
cte("grid_years", "SELECT year AS fold FROM (SELECT year, row_number() OVER (ORDER BY year) AS k, row_number() OVER (ORDER BY year DESC) AS b FROM (SELECT DISTINCT year FROM grid_rows)) WHERE k>3 AND b<=5")
cte("grid_folds", "SELECT g.*, t.fold, g.base_k||'/'||t.fold AS unit FROM grid_rows g JOIN grid_years t ON g.year<=t.fold")
irls("gr", "grid_folds", [LOGIT("model_p")], by="unit", where="year<fold", steps=10)
cte("k_line", f"""SELECT base_k, row_number() OVER (ORDER BY base_k) AS place, avg(CASE WHEN fav_won THEN -ln(q) ELSE -ln(1-q) END) AS loss FROM (
  SELECT base_k, fav_won, least(greatest(p,1e-12),1-1e-12) AS q FROM (SELECT f.base_k, f.fav_won, 1/(1+exp(-(w.w0+w.w1*{LOGIT('model_p')}))) AS p FROM grid_folds f JOIN gr_fit w ON w.g=f.unit WHERE f.year=f.fold)) GROUP BY 1""")
cte("k_trail", """SELECT *, loss < least((SELECT loss FROM k_line WHERE base_k=24), coalesce(min(loss) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1e9)) - 1e-6 AS taken FROM k_line""")
cte("k_best", "SELECT coalesce((SELECT arg_max(base_k, place) FROM k_trail WHERE taken), 24) AS best")
cte("order_old", "SELECT competitor, home_division AS division, row_number() OVER (PARTITION BY home_division ORDER BY rating DESC, competitor) AS place FROM competitors JOIN ratings USING (competitor) WHERE contests>=3 AND home_division<>''")
cte("order_new", "SELECT competitor, home_division AS division, rating, row_number() OVER (PARTITION BY home_division ORDER BY rating DESC, competitor) AS place FROM competitors JOIN o_ratings USING (competitor) WHERE contests>=3 AND home_division<>''")
_edge = "model_p-(1/fav_odds)/(1/fav_odds+1/dog_odds)"
ORACLES = {
    "H1_price_conversion": sql(f"SELECT price_id, a AS american, {r(BACK,6)} AS decimal, {r(f'1/({BACK})',6)} AS implied FROM (SELECT price_id, {AM} AS a FROM prices)"),
    "H2_devig_methods": sql(f"SELECT price_id, {R6('p_multiplicative','p_power','p_shin')} FROM joined"),
    "H3_book_consensus": sql(f"SELECT contest_id, side, open, {r('close',6)} AS close, books FROM consensus"),
    "H4_feed_cross_validation": sql(f"SELECT count(*) AS matched, {r('avg(gap)*100',4)} AS mean_gap_points, count(*) FILTER (gap<=0.03) AS within_3_points, count(*) FILTER ((p1>=0.5)<>(consensus_p1>=0.5)) AS favourite_flips FROM gaps"),
    "H4_largest_gaps": sql(f"SELECT quote_id, date, {r('gap',6)} AS gap FROM gaps ORDER BY {r('gap',6)} DESC, quote_id LIMIT 6"),
    "H5_point_in_time": sql(f"SELECT competitor, opponent, date, contest_id, {R6('self_rating','opponent_rating','layoff_months')}, nth, provisional, moved FROM pit"),
    "H6_nearest_day": sql("SELECT price_id, hit.date AS date, hit.contest_id AS contest_id FROM hit_fav"),
    "H7_matchup_predictions": sql(f"SELECT price_id, {R6('model_p','fav_rating','dog_rating','fav_layoff','dog_layoff')}, fav_no, dog_no, fav_provisional, dog_provisional, both_established, fav_moved, dog_moved, division, contest_date FROM joined WHERE model_p IS NOT NULL"),
    "H8_price_join_audit": sql("SELECT verdict, count(*) AS rows, min(price_id) AS first_id FROM joined GROUP BY 1"),
    "H8_unresolved_names": sql("SELECT name, count(*) AS rows FROM (SELECT favourite AS name FROM prices UNION ALL SELECT underdog FROM prices) SEMI JOIN (SELECT name FROM price_names WHERE competitor IS NULL) u USING (name) GROUP BY 1"),
    "C12_feed_name_resolution": sql("SELECT * FROM price_names"),
    "H9_proper_scores": sql(f"SELECT model, {scored()} FROM long_models GROUP BY 1"),
    "H10_reliability": sql(f"SELECT model, bin, coalesce(n,0) AS n, coalesce(predicted,0) AS predicted, coalesce(realized,0) AS realized FROM (VALUES ('model'),('market')) m(model) CROSS JOIN (SELECT range::INT AS bin FROM range(10)) LEFT JOIN (SELECT model, least(floor(p*10),9)::INT AS bin, count(*) AS n, {r('avg(p)',6)} AS predicted, {r('avg(fav_won::INT)',6)} AS realized FROM long_models GROUP BY 1,2) USING (model, bin)"),
    "H10_calibration_error": sql(f"SELECT model, {r('sum(n*abs(a-b))/sum(n)',6)} AS ece FROM (SELECT model, least(floor(p*10),9) AS bin, count(*) AS n, avg(p) AS a, avg(fav_won::INT) AS b FROM long_models GROUP BY 1,2) GROUP BY 1"),
    "H11_logistic_fit": sql(f"SELECT round(w0,6) AS intercept, round(w1,6) AS w_model, round(w2,6) AS w_market, (SELECT count(*) FROM priced) AS n, (SELECT {r('avg(1/(1+exp(-(f.w0+f.w1*d.x1+f.w2*d.x2))))',6)} FROM lr_d d, lr_fit f) AS mean_p FROM lr_fit"),
    "H12_best_devig_and_segments": sql("SELECT * FROM (WITH s AS (" + " UNION ALL ".join(f"SELECT '{n}' AS source, fav_won, CASE WHEN both_established THEN 'established' ELSE 'provisional' END AS segment, {c} AS p FROM priced" for n, c in (("model", "model_p"), ("multiplicative", "p_multiplicative"), ("power", "p_power"), ("shin", "p_shin"))) + f") SELECT source, coalesce(segment,'all') AS segment, count(*) AS n, {r('avg(CASE WHEN fav_won THEN -ln(p) ELSE -ln(1-p) END)',6)} AS log_loss FROM s GROUP BY GROUPING SETS ((source, segment),(source)))"),
    "H12_best_devig": sql("SELECT * FROM (WITH s AS (" + " UNION ALL ".join(f"SELECT '{m}' AS method, avg(CASE WHEN fav_won THEN -ln(p_{m}) ELSE -ln(1-p_{m}) END) AS ll FROM priced" for m in ("multiplicative", "power", "shin")) + f") SELECT arg_min(method, ll) AS best, {r('min(ll)',6)} AS log_loss FROM s)"),
    "H13_holdout_scores": sql(f"""SELECT model, {scored()} FROM (SELECT fav_won, unnest(['raw','calibrated','market','blend']) AS model,
      unnest([model_p, 1/(1+exp(-(c.w0+c.w1*{LOGIT('model_p')}))), market_p, 1/(1+exp(-(b.w0+b.w1*{LOGIT('model_p')}+b.w2*{LOGIT('market_p')})))]) AS p FROM chron, cal_fit c, blend_fit b WHERE NOT is_train) GROUP BY 1"""),
    "H14_walk_forward_folds": sql("SELECT fold, role, count(*) AS n FROM folds GROUP BY 1,2"),
    "H15_grid_line": sql(f"SELECT base_k, {scored()} FROM (SELECT f.base_k, f.fav_won, 1/(1+exp(-(w.w0+w.w1*{LOGIT('model_p')}))) AS p FROM grid_folds f JOIN gr_fit w ON w.g=f.unit WHERE f.year=f.fold) GROUP BY 1"),
    "H15_line_trail": sql(f"SELECT 1 AS pass, 'base_k' AS knob, base_k AS value, {r('loss',6)} AS log_loss, taken FROM k_trail"),
    "H16_config_proposal": sql(f"""SELECT knob, now, CASE WHEN knob='base_k' THEN best ELSE now END AS proposed, knob='base_k' AND best<>now AS changed, {r('(SELECT loss FROM k_line WHERE base_k=24)',6)} AS loss_now, {r('(SELECT loss FROM k_line WHERE base_k=best)',6)} AS loss_proposed
      FROM k_best, (VALUES ('base_k',24::DOUBLE),('provisional_contests',5::DOUBLE),('provisional_multiplier',1.5::DOUBLE),('retention_per_year',0.92::DOUBLE),('move_penalty',0.1::DOUBLE),('finish_spread',1::DOUBLE)) v(knob, now)"""),
    "H16_rank_differences": sql(f"SELECT n.division, n.competitor, n.place AS now, o.place AS was, o.place-n.place AS gain, {r('n.rating',4)} AS rating FROM order_new n LEFT JOIN order_old o USING (division, competitor) WHERE n.place<=15"),
    "H17_coverage_by_year": sql("SELECT year, count(*) AS total, count(*) FILTER (verdict='ok') AS matched FROM joined GROUP BY 1"),
    "H17_coverage_by_division": sql("SELECT division, count(*) AS matched FROM priced GROUP BY 1"),
    "H18_model_misses": sql("SELECT price_id, date, division, winner, loser, " + R6("model_winner", "market_winner", "loser_layoff") + ", winner_no, loser_no, winner_form, loser_form, moved FROM (" + with_form("SELECT * FROM winners WHERE market_winner>=0.55 AND model_winner<0.4 ORDER BY model_winner, price_id LIMIT 22") + ")"),
    "H18_miss_tally": sql("""SELECT count(*) AS n, count(*) FILTER (winner_no<=4) AS newcomer, count(*) FILTER (winner_provisional) AS provisional, count(*) FILTER (loser_layoff>=12) AS long_layoff, count(*) FILTER (moved) AS moved,
      count(*) FILTER (market_winner<0.5) AS market_wrong, count(*) FILTER (winner_form LIKE 'WW%') AS on_streak, count(*) FILTER (loser_form LIKE '%L%') AS off_loss, count(*) FILTER (both_established) AS established FROM (""" + with_form("SELECT * FROM winners ORDER BY model_winner, price_id LIMIT 150") + ")"),
    "H19_model_vs_market": sql(f"""SELECT count(*) AS matched, count(*) FILTER (model_p<0.5) AS disagreements, {r('avg(fav_won::INT)',6)} AS market_rate, {r('avg(((model_p>=0.5)=fav_won)::INT)',6)} AS model_rate,
      {r('avg((model_p>=0.5)::INT)',6)} AS agreement, {r('coalesce(avg((NOT fav_won)::INT) FILTER (model_p<0.5),0)',6)} AS underdog_rate, {r('avg(abs(model_p-p_multiplicative))',6)} AS mean_gap FROM priced"""),
    "H19_value_spots": sql(f"""(SELECT 'favourite_edge' AS list, price_id, {r('model_p-p_multiplicative',6)} AS edge FROM priced WHERE fav_won AND {r('model_p-p_multiplicative',6)}>0 ORDER BY edge DESC, price_id LIMIT 10)
      UNION ALL (SELECT 'live_underdog', price_id, {r('model_p',6)} AS edge FROM priced WHERE model_p<0.5 AND NOT fav_won ORDER BY edge, price_id LIMIT 10)"""),
    "H20_analysis_export": sql(f"SELECT price_id, date, event, division, favourite, underdog, fav_odds, dog_odds, {r('model_p',3)} AS model_p, {r('market_p',3)} AS market_p, {r('model_p-market_p',3)} AS edge, fav_won, both_established FROM priced"),
    "H20_largest_disagreements": sql(f"SELECT price_id, edge, fav_won FROM (SELECT price_id, {r('model_p-market_p',6)} AS edge, fav_won FROM priced WHERE both_established) ORDER BY abs(edge) DESC, price_id LIMIT 40"),
    "H21_edge_verdict": sql(f"SELECT price_id, {r(_edge,4)} AS edge, {r('1/fav_odds+1/dog_odds-1',4)} AS overround, CASE WHEN {_edge}>0.03 THEN 'value' WHEN {_edge}<-0.03 THEN 'against' ELSE 'fair' END AS verdict FROM joined WHERE model_p IS NOT NULL"),
    "H22_title_candidates": sql("SELECT contest_id, holder, reign_id, div_match, established, any_match, holders FROM title_cands"),
    "H23_title_attribution": sql("SELECT * FROM titles"),
    "H24_title_prices": sql("SELECT * FROM title_prices"),
    "H25_long_shot_challengers": sql(f"SELECT contest_id, challenger_odds, outcome='underdog' AS won, CASE WHEN challenger_odds>=2 THEN {r('(challenger_odds-1)*100')} END AS american FROM title_prices WHERE challenger_odds>=4"),
    "H25_reign_timelines": sql("SELECT r.*, coalesce(n,0) AS title_contests FROM reigns r LEFT JOIN (SELECT reign_id, count(*) AS n FROM titles GROUP BY 1) USING (reign_id)"),
    "H25_unmatched_reigns": sql("SELECT reign_id, division, holder, start FROM reigns ANTI JOIN titles USING (reign_id)"),
    "H26_title_flags": sql("SELECT l.contest_id, l.competitor, EXISTS (SELECT 1 FROM titles t WHERE least(t.champion,t.challenger)=least(l.competitor,l.opponent) AND greatest(t.champion,t.challenger)=greatest(l.competitor,l.opponent) AND abs(date_diff('day',t.date,l.date))<=3) AS is_title FROM log l"),
}
