"""Oracles of sources, sinks and streams."""

from duelgrid.sources.readers import COMPETITOR_NUMBERS
from oracles.base import AS_OF, r, sql
from oracles import ranking, analytics, market, etl_sql, surface_sql  # noqa: F401
from oracles.etl_sql import METHOD
from oracles.market import pair

R6 = lambda *cs: ", ".join(f"{r(c, 6)} AS {c}" for c in cs)
RUNS = [f"(SELECT (min(date)-1 + ((date_diff('day', (min(date)-1)::DATE, (max(date)+1)::DATE)*{k})//4)::INT)::DATE FROM contests)" for k in range(5)]
_snap = "CASE " + " ".join(f"WHEN c.date>{d} THEN {d}" for d in reversed(RUNS)) + " END"
_set = "CASE " + " ".join(f"WHEN c.date<{d} THEN {d}" for d in RUNS) + " END"
_raw_method = "CASE WHEN result1='NC' THEN 'Could Not Continue' WHEN m0='KO/TKO' THEN 'KO/TKO' WHEN m0='SUB' THEN 'Submission' WHEN m0='U-DEC' THEN 'Decision - Unanimous' WHEN m0='M-DEC' THEN 'Decision - Majority' ELSE 'Decision - Split' END"
ORACLES = {
    "A1_A21_csv_round_trip": sql("""SELECT contest_id, '"'||name1||'", aka '||name2 AS title, details FROM contests"""),
    "A21_year_partitions": sql("SELECT year(date)::INT AS on_year, count(*) AS contests, count(*) FILTER (year(date)=1998) AS again, sum(contest_id)::BIGINT AS ids FROM contests GROUP BY 1"),
    "A2_A3_competitor_source": sql(f"""SELECT competitor::VARCHAR AS competitor, name, '' AS nickname, '5'' 11"' AS height, CASE WHEN nation=3 THEN 0 ELSE competitor%90+115.5 END::DOUBLE AS weight, 'Orthodox' AS stance,
      wins::DOUBLE AS wins, losses::DOUBLE AS losses, CASE WHEN draws>3 THEN draws ELSE 0 END::DOUBLE AS draws, balance>9000 AS belt, home_division AS division, gender, 'Boxer' AS style, {", ".join(f"CASE WHEN competitor%{i+2}=0 THEN 0 ELSE competitor%{i+7}+0.5 END::DOUBLE AS {n}" for i, n in enumerate(COMPETITOR_NUMBERS.values()))} FROM competitors"""),
    "A4_A5_contest_source": sql("SELECT contest_id::VARCHAR AS contest_id, c1::VARCHAR AS c1, c2::VARCHAR AS c2, CASE WHEN round=2 THEN 'unknown' ELSE event_id END AS event_id, CASE WHEN round<>2 THEN date END AS date FROM contests WHERE result1<>'NC'"),
    "A6_A7_optional_sources": sql("SELECT p.c1, p.c2, p.date, c.result1, 2::INT AS round, false AS has_metrics, 0::INT AS kd1 FROM patch p JOIN contests c ON c.contest_id=p.patch_id"),
    "A8_outside_named_source": sql("""SELECT name, organisation, CASE WHEN dated THEN date END AS date, result, count(*) AS n, max(opponent) AS opponent FROM (
      SELECT s.*, organisation, date, outside_id%7<>0 AS dated FROM outside, LATERAL (VALUES (competitor::VARCHAR, opponent_id, result), (opponent_id, competitor::VARCHAR, 'x')) s(name, opponent, result)
      WHERE outside_id%11<>0 AND opponent_id<>'') GROUP BY ALL"""),
    "A8_outside_linked_source": sql("SELECT competitor::VARCHAR AS competitor, tier, result, count(*) AS n, min(date) AS first, max(opponent_id) FILTER (opponent_id<>'') AS rival, max(tier_multiplier)::DOUBLE AS multiplier FROM outside WHERE outside_id%11<>0 AND tier<>'historical' GROUP BY 1,2,3"),
    "A9_A11_price_source": sql("SELECT price_id, date, event, favourite, underdog, fav_odds, dog_odds, outcome FROM prices WHERE outcome<>'unknown' AND dog_odds<=10"),
    "A7_merge_source": sql("SELECT competitor::VARCHAR AS secondary, (competitor+1)::VARCHAR AS primary FROM roster WHERE competitor%4<>1"),
    "A10_book_source": sql("SELECT date, event_id AS event, name1, name2, CASE WHEN contest_id%5<>0 THEN price1 END AS open1, price1 AS close1, NULL::DOUBLE AS open2, price2 AS close2, NULL::INT AS n_books FROM side_prices WHERE contest_id%13<>0 AND contest_id%17<>0"),
    "A11_upcoming_source": sql("SELECT CASE WHEN slot_id%3=0 THEN event_name ELSE event_id END AS event, event_name, CASE WHEN slot_id%5<>0 THEN date END AS date, bout_order::INT AS bout_order, division, main_event, c1::VARCHAR AS c1, name1, c2::VARCHAR AS c2, name2, 'x'||c1 AS foreign1, NULL::VARCHAR AS foreign2 FROM upcoming"),
    "A12_A13_birth_and_reach_sources": sql("SELECT competitor, CASE WHEN gender='Male' THEN DATE '1970-02-03' END AS born, CASE WHEN gender='Male' THEN true END AS approximate, CASE WHEN nation>=5 THEN nation+55 END::INT AS reach FROM competitors WHERE gender='Male' OR nation>=5"),
    "A14_media_source": sql("""SELECT competitor::VARCHAR AS canonical_id, CASE WHEN competitor%3=0 THEN '' ELSE 'Nation_'||(competitor%40) END AS nationality,
      CASE WHEN competitor%3<>0 AND competitor%40<(SELECT count(*) FROM nation) THEN chr((127462+competitor%40%26)::INT)||chr((127462+competitor%40*7%26)::INT) ELSE '' END AS flag,
      CASE WHEN competitor%5<>0 AND competitor%7=0 THEN 'h' WHEN competitor%3<>0 AND competitor%4<>0 THEN 'p'||competitor WHEN competitor%5<>0 AND competitor%2=0 THEN 'b' ELSE '' END AS avatar,
      CASE WHEN competitor%5<>0 AND competitor%2=0 THEN 'b' ELSE '' END AS full_body_url FROM roster WHERE competitor%3<>0 OR competitor%5<>0"""),
    "A16_alias_source": sql("SELECT normalized_name, source, canonical_id::VARCHAR AS canonical_id FROM aliases WHERE canonical_id%6<>0 AND normalized_name<>''"),
    "A15_title_pair_dates": sql("SELECT pair, count(*)::INT AS titles, string_agg(date::VARCHAR, ',' ORDER BY date) AS dates FROM (SELECT DISTINCT least(champion,challenger)||'|'||greatest(champion,challenger) AS pair, date FROM titles) GROUP BY 1"),
    "A17_reign_ledger": sql("""SELECT division, (row_number() OVER (PARTITION BY division ORDER BY reign_id)-1)::INT AS ordinal, holder::VARCHAR AS champion, start, "end", interim FROM reigns"""),
    "A18_external_ranking_json": sql("SELECT division, name, rank FROM external_rank"),
    "A19_A22_json_analysis": sql(f"SELECT price_id, {r('model_p',3)} AS model_p, fav_won FROM priced"),
    "A20_raw_result_source": sql(f"""SELECT CASE contest_id%4 WHEN 0 THEN 'Promo '||division||' Title Bout' WHEN 1 THEN division||' Bout' WHEN 2 THEN 'Ultimate Fighter 3 Tournament '||division||' Bout' ELSE 'Interim '||division||' Title Bout' END AS WEIGHTCLASS,
      {_raw_method} AS METHOD, OUTCOME, count(*) AS n, min(trim(EVENT)) AS first, max(trim(BOUT)) AS last FROM raw_results WHERE contest_id%19<>0 GROUP BY 1,2,3"""),
    "A20_raw_event_and_physical_sources": sql("""SELECT trim(event_id) AS EVENT, strftime(date,'%B %-d, %Y') AS DATE, 'Rio, Brazil' AS LOCATION, count(*) AS n FROM contests GROUP BY 1,2
      UNION ALL SELECT name, '5'' 11"', 'Southpaw', count(*) FROM roster WHERE competitor%9<>0 GROUP BY 1"""),
    "A20_raw_round_source": sql("SELECT event, bout, name, kd, sub_att, rev, ctrl, head_landed, ground_attempted FROM side_stats"),
    "A23_append_only_sink": sql("SELECT competitor, foreign_id FROM crosswalk"),
    "A24_report_tables": sql("SELECT coalesce(division,'all') AS division, coalesce(y,0)::INT AS year, count(*) AS contests, count(*) FILTER (has_metrics) AS with_metrics FROM (SELECT division, year(date) AS y, has_metrics FROM contests) GROUP BY ROLLUP (division, y)"),
    "S1_guarded_ingest": sql(f"SELECT arg_min(patch_id,(patch_id%3,patch_id)) AS patch_id, date, arg_min(c1,(patch_id%3,patch_id)) AS c1, arg_min(c2,(patch_id%3,patch_id)) AS c2 FROM patch_verdicts WHERE verdict='added' GROUP BY date, {pair('name1','name2')}"),
    "S2_online_ratings": sql(f"SELECT competitor, contests_rated AS seen, last_date, last_division AS last_label, {r('at_last',6)} AS rating FROM ratings"),
    "S3_price_result_join": sql("""SELECT a.price_id, CASE WHEN NOT late THEN c.contest_id END AS contest_id, CASE WHEN late THEN 'late' WHEN c.contest_id IS NULL THEN 'unmatched' ELSE 'matched' END AS kind
      FROM (SELECT *, price_id%50=0 AND year(date)=(SELECT min(year(date)) FROM contests) AS late FROM asked) a LEFT JOIN contests c
      ON NOT late AND least(c.c1,c.c2)=least(a.fav_id,a.dog_id) AND greatest(c.c1,c.c2)=greatest(a.fav_id,a.dog_id) AND abs(date_diff('day',c.date,a.date))<=2"""),
    "S4_ledger_stream": sql(f"""SELECT slot_id, date, snap AS snapshot_on, CASE WHEN st IS NULL THEN 'pending' ELSE hit[1] END AS status, CASE WHEN st IS NOT NULL THEN hit[2] END AS winner, st AS settled_on, {r('p',6)} AS prob1 FROM (
      SELECT c.contest_id AS slot_id, c.date, {_snap} AS snap, {_set} AS st, coalesce(1/(1+pow(10::DOUBLE,(h.opponent_rating-h.rating_before)/400)),0.5) AS p, d.hit
      FROM contests c LEFT JOIN history h ON h.contest_id=c.contest_id AND h.competitor=c.c1
      JOIN (SELECT c.contest_id, arg_min(d.r, (abs(date_diff('day',c.date,d.date)), d.date)) AS hit FROM contests c JOIN day_results d ON d.lo=least(c.c1,c.c2) AND d.hi=greatest(c.c1,c.c2) AND abs(date_diff('day',c.date,d.date))<=3 GROUP BY 1) d ON d.contest_id=c.contest_id)"""),
    "S5_running_scores": sql(f"SELECT date_trunc('month',p.date)::DATE AS month, model, count(*) AS n, count(*) FILTER ((l.p>=0.5)=l.fav_won) AS hits, {r('sum(CASE WHEN l.fav_won THEN -ln(l.p) ELSE -ln(1-l.p) END)',6)} AS loss, {r('sum((l.p-l.fav_won::INT)*(l.p-l.fav_won::INT))',6)} AS brier FROM long_models l JOIN priced p USING (price_id) GROUP BY 1,2"),
    "S6_activity_rates": f"""SELECT w AS start, w + INTERVAL 6 HOUR AS "end", user_id, count(*) AS n, {r('sum(value)',4)} AS value FROM (SELECT *, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS w FROM events)
      GROUP BY ALL""",
    "D1_sliced_sweep": sql(f"SELECT contest_id, competitor, {R6('rating_before','rating_after')} FROM history"),
}
