"""Oracles of the rating core."""

from oracles.base import AS_OF, months, r, sql, sweep_ctes
from oracles import ranking  # noqa: F401  (registers CTEs)
from oracles.ranking import display

sweep_ctes("f_", base_k=24 * (0.6 + 0.8 * 0.7), spread=0.8 / 0.5, retain=0.92 - (0.9 - 0.5) * 0.4)
sweep_ctes("e_", era=1999)
for _i, _k in enumerate((12, 18, 24)):
    sweep_ctes(f"k{_i}_", base_k=float(_k))

R6 = lambda *cs: ", ".join(f"{r(c, 6)} AS {c}" for c in cs)
GAP = months("last_date", f"({AS_OF} + to_years(y))::DATE")
ORACLES = {
    "D1_rating_history": sql(f"SELECT contest_id, date, competitor, opponent, result, nth, {R6('rating_before','rating_after','delta','opponent_rating')} FROM history"),
    "D2_result_decision": sql("""SELECT result1, result2, CASE WHEN result1='W' THEN 1.0 WHEN result1='L' THEN 0.0 WHEN result1='D' THEN 0.5 END::DOUBLE AS score, count(*) AS contests FROM contests GROUP BY ALL"""),
    "D3_expected_score": sql(f"SELECT contest_id, competitor, {r('1/(1+pow(10::DOUBLE,(opponent_rating-rating_before)/400))',6)} AS expected FROM history"),
    "D4_k_factor": sql(f"SELECT c.method, x.nth<5 AS provisional, count(*) AS n, max({r('x.kk',6)}) AS k FROM ctx x JOIN contests c USING (contest_id) GROUP BY ALL"),
    "D5_inactivity_regression": sql(f"SELECT competitor, y AS years, {r(GAP,6)} AS gap_months, {r(f'CASE WHEN {GAP}>12 THEN 1500+(at_last-1500)*pow(0.92::DOUBLE,({GAP}-12)/12) ELSE at_last END',6)} AS rating FROM ratings, (VALUES (0),(1),(2),(5)) v(y)"),
    "D6_division_moves": sql("SELECT competitor, count(*) AS contests, count(*) FILTER (prev_label IS NOT NULL AND prev_label<>division) AS moves FROM ctx GROUP BY 1"),
    "D7_boundary_discount": sql(f"SELECT competitor, contest_id, date, {R6('rating_before')} FROM history WHERE date>={AS_OF}-INTERVAL 1826 DAY AND coalesce(prev_date<{AS_OF}-INTERVAL 1826 DAY,true)"),
    "D8_history_newest_first": sql(f"SELECT competitor, rev, contest_id, date, opponent, result, {R6('rating_after','delta')} FROM (SELECT *, row_number() OVER (PARTITION BY competitor ORDER BY seq DESC) AS rev FROM history)"),
    "D9_running_states": sql(f"SELECT competitor, contests_rated, last_date, last_division, {R6('peak','at_last','rating')} FROM ratings"),
    "D10_default_state": sql(f"SELECT c_custkey AS competitor, {r('coalesce(rating,1500)',6)} AS rating FROM customer LEFT JOIN ratings ON competitor=c_custkey"),
    "D11_display_score": sql(f"SELECT competitor, {r(display('rating'),6)} AS display_score, {r(display('(peak+60)'),6)} AS peak_display FROM ratings"),
    "D12_filtered_engine": sql(f"SELECT competitor, contests_rated, {R6('peak','rating')} FROM f_ratings"),
    "D12_era_filter": sql(f"SELECT competitor, contests_rated, {R6('peak','rating')} FROM e_ratings"),
    "D12_many_configs": sql(" UNION ALL ".join(f"SELECT {i}::INT AS config_id, competitor, count(*) AS n, {r('max(rating_after)',6)} AS peak FROM k{i}_history GROUP BY 2" for i in range(3))),
}
