"""Oracles of ETL and identity."""

from duelgrid.config import TIER_MULTIPLIERS
from duelgrid.operators.identity_rules import ORGANISATIONS
from oracles.base import AS_OF, cte, months, r, sql
from oracles import ranking, analytics, market  # noqa: F401
from oracles.market import feed, norm, pair
from duelgrid.functions.names import VARIANTS

cte("raw_results", """
SELECT contest_id, ' Card '||contest_id AS EVENT, name1||' vs. '||name2||CASE WHEN contest_id%29=0 THEN ' (x)' ELSE '' END AS BOUT, result1||'/'||result2 AS OUTCOME,
 division, result1, result2, method AS m0, round, clock, details, date, name1, name2,
 CASE contest_id%4 WHEN 3 THEN 'Interim '||division ELSE division END AS clean FROM contests""")
cte("rounds", """
SELECT 'Card '||c.contest_id AS event, c.name1||' vs. '||c.name2 AS bout, s.name, CASE WHEN l_returnflag='R' THEN 1 ELSE 0 END AS kd, CASE WHEN l_linestatus='O' THEN 1 ELSE 0 END AS sub_att, 0 AS rev,
 l_quantity::INT AS q, l_linenumber AS n, l_partkey AS p
FROM lineitem JOIN contests c ON c.contest_id=l_orderkey JOIN sides s ON s.contest_id=l_orderkey AND s.competitor=l_suppkey""")
B_ = lambda e, a: f"sum({e})::BIGINT AS {a}"
cte("side_stats", "SELECT event, bout, name, " + ", ".join([
    B_("kd", "kd"), B_("sub_att", "sub_att"), B_("rev", "rev"), B_("CASE WHEN p%17=0 THEN 0 ELSE n*60+p%60 END", "ctrl"),
    B_("q", "sig_landed"), B_("q+n", "sig_attempted"), B_("q*2", "total_landed"), B_("q*2+n", "total_attempted"),
    B_("CASE WHEN p%9=0 THEN 0 ELSE n END", "td_landed"), B_("CASE WHEN p%9=0 THEN 0 ELSE n+1 END", "td_attempted"),
    B_("q//2", "head_landed"), B_("q", "head_attempted"), B_("n", "body_landed"), B_("q", "body_attempted"), B_("n-1", "leg_landed"), B_("n", "leg_attempted"),
    B_("q//2", "distance_landed"), B_("q//2+n", "distance_attempted"), B_("n", "clinch_landed"), B_("n*2", "clinch_attempted"), B_("0", "ground_landed"), B_("0", "ground_attempted")])
    + " FROM rounds GROUP BY 1,2,3")
H = lambda x: f"substr(md5({x}),1,16)"
STATS = ["kd", "sub_att", "rev", "ctrl"] + [f"{s}_{p}" for s in ("sig", "total", "td", "head", "body", "leg", "distance", "clinch", "ground") for p in ("landed", "attempted")]
safe = lambda a, b: f"CASE WHEN {b}>0 THEN {r(f'{a}/{b}',2)} ELSE 0 END"
_nm = "CASE WHEN contest_id%29=0 THEN name2||' (x)' ELSE name2 END"
METHOD = "CASE WHEN result1='NC' THEN 'CNC' ELSE m0 END"
cte("assembled", f"""
SELECT ltrim(x.EVENT) AS event, x.BOUT AS bout, x.name1, x.n2 AS name2, {H("ltrim(x.EVENT)||'|'||x.BOUT")} AS contest_id, {H('x.name1')} AS c1, {H('x.n2')} AS c2, {H('ltrim(x.EVENT)')} AS event_id,
 x.clean AS division, {METHOD} AS method, x.details, x.result1, x.result2, x.round::INT AS round, x.clock, x.date, """
    + ", ".join(f"coalesce(a.{s},0) AS {s}1, coalesce(b.{s},0) AS {s}2" for s in STATS) + ", "
    + ", ".join(safe(f"coalesce({t}.{s}_landed,0)", f"coalesce({t}.{s}_attempted,0)") + f" AS {s}_pct{i}" for i, t in ((1, "a"), (2, "b"))
                for s in ("sig", "total", "head", "body", "leg", "distance", "clinch", "ground")) + f"""
FROM (SELECT *, {_nm} AS n2 FROM raw_results) x LEFT JOIN side_stats a ON a.event=ltrim(x.EVENT) AND a.bout=x.BOUT AND a.name=x.name1
LEFT JOIN side_stats b ON b.event=ltrim(x.EVENT) AND b.bout=x.BOUT AND b.name=x.n2""")
cte("phys", """
SELECT *, 60+competitor%20+(o-1) AS inch FROM roster, (VALUES (1),(2)) v(o) WHERE o = CASE WHEN competitor%3=0 THEN 2 ELSE 1 END""")
N = norm("name")
cte("aliases", f"""
SELECT {N} AS normalized_name, 'roster' AS source, competitor AS canonical_id FROM roster
UNION ALL SELECT {norm("name||' Jr'")}, 'feed', competitor FROM roster WHERE competitor%5=2
UNION ALL SELECT 'the '||lower('Van'||translate((competitor//10)::VARCHAR,'0123456789','abdefgiklm')), 'nickname', competitor FROM roster WHERE competitor%10<3""")
cte("registry", "SELECT normalized_name AS norm, min(canonical_id) AS canonical_id FROM aliases WHERE normalized_name<>'' GROUP BY 1 HAVING min(canonical_id)=max(canonical_id)")
cte("patch", f"""
SELECT contest_id AS patch_id, (date+(contest_id%31-3)::INT)::DATE AS date, CASE WHEN contest_id%6=0 THEN 'sd:' ELSE '' END||c1 AS c1, CASE WHEN contest_id%6=1 THEN 'sd:' ELSE '' END||c2 AS c2,
 CASE c1%2*2 WHEN 0 THEN name1 ELSE name1||' Jr' END AS name1, name2 FROM contests WHERE date>={AS_OF}-90""")
cte("patch_verdicts", f"""
SELECT *, CASE WHEN date<(SELECT max(date)-60 FROM contests) THEN 'stale' WHEN EXISTS (SELECT 1 FROM (SELECT DISTINCT {pair('name1','name2')} AS k, date FROM contests) c WHERE c.k={pair('p.name1','p.name2')} AND abs(date_diff('day',c.date,p.date))<=7) THEN 'duplicate' ELSE 'added' END AS verdict
FROM patch p""")
cte("patched", """
SELECT p.patch_id, p.verdict, CASE WHEN p.c1 LIKE 'sd:%' AND a.name IS NOT NULL THEN a.id ELSE p.c1 END AS c1, CASE WHEN p.c2 LIKE 'sd:%' AND b.name IS NOT NULL THEN b.id ELSE p.c2 END AS c2,
 p.c1 LIKE 'sd:%' AND a.name IS NOT NULL AS resolved1, p.c2 LIKE 'sd:%' AND b.name IS NOT NULL AS resolved2
FROM patch_verdicts p LEFT JOIN (SELECT name, max(competitor)::VARCHAR AS id FROM roster GROUP BY 1 HAVING count(*)=1) a ON a.name=p.name1
LEFT JOIN (SELECT name, max(competitor)::VARCHAR AS id FROM roster GROUP BY 1 HAVING count(*)=1) b ON b.name=p.name2""")
MG = lambda c: f"CASE WHEN {c}%10 IN (1,3) THEN {c}-1 ELSE {c} END"
cte("merged", f"""
SELECT contest_id, date, c1, c2 FROM (SELECT *, row_number() OVER (PARTITION BY least(c1,c2), greatest(c1,c2), date ORDER BY contest_id) AS rn,
  (c1%10 IN (0,2) AND c1+1 IN (SELECT competitor FROM roster)) OR (c2%10 IN (0,2) AND c2+1 IN (SELECT competitor FROM roster)) AS scope
 FROM (SELECT contest_id, date, {MG('c1')} AS c1, {MG('c2')} AS c2 FROM contests)) WHERE NOT scope OR rn=1""")
cte("profiles", f"""
SELECT 'F'||competitor AS foreign_id, competitor, {feed('name','competitor')} AS foreign_name, CASE WHEN competitor%8=1 THEN '' ELSE home_division END AS foreign_division, 0 AS shift FROM competitors WHERE nation<>7
UNION ALL SELECT 'G'||competitor, competitor, name, home_division, 1 FROM competitors WHERE nation<4""")
CW = lambda x: norm(x, "crosswalk")
SUR = lambda x: f"list_last(string_split({CW(x)},' '))"
cte("mcand", f"""
SELECT competitor, foreign_id, 'name' AS block FROM roster JOIN (SELECT foreign_id, {CW('foreign_name')} AS f FROM profiles) ON f={CW('name')}
UNION ALL SELECT competitor, foreign_id, 'surname' FROM roster JOIN (SELECT foreign_id, {SUR('foreign_name')} AS f FROM profiles) ON f={SUR('name')}
 WHERE length({SUR('name')})>=3 AND competitor NOT IN (SELECT competitor FROM roster JOIN (SELECT {CW('foreign_name')} AS f FROM profiles) ON f={CW('name')})""")
cte("known", f"SELECT DISTINCT competitor, {CW('opponent_name')} AS opp_key FROM sides")
cte("fopp", f"SELECT DISTINCT p.foreign_id, {CW('s.opponent_name')} AS opp_key FROM profiles p JOIN sides s ON s.competitor=p.competitor+p.shift WHERE s.result='D'")
cte("mscore", f"""
SELECT competitor, foreign_id, name_exact, division_match, overlap, own_opponents, name_exact::INT*25+division_match::INT*15+least(overlap,5)*14 AS score FROM (
 SELECT m.competitor, m.foreign_id, {CW('c.name')}={CW('p.foreign_name')} AS name_exact, c.home_division<>'' AND p.foreign_division<>'' AND {CW('c.home_division')}={CW('p.foreign_division')} AS division_match,
  (SELECT count(*) FROM known k JOIN fopp f USING (opp_key) WHERE k.competitor=m.competitor AND f.foreign_id=m.foreign_id) AS overlap,
  (SELECT count(*) FROM known k WHERE k.competitor=m.competitor) AS own_opponents
 FROM mcand m JOIN competitors c USING (competitor) JOIN profiles p USING (foreign_id))""")
cte("crosswalk", """
SELECT competitor, 'F'||CASE WHEN competitor%10<4 THEN competitor//2 ELSE competitor END AS foreign_id, (competitor*37%100)::INT AS confidence,
 'overlap '||competitor%6||'/5, name='||CASE WHEN competitor%3=0 THEN 'true' ELSE 'false' END AS notes FROM competitors WHERE balance>=0""")
FIRST = '["Adam","Bruno","Carlos","Diego","Erik","Felix","Goran","Hugo","Ivan","Jose"]'.replace('"', "'")
cte("twins", f"SELECT competitor, {FIRST}[(k%10+1)::INT]||' Van'||translate(k::VARCHAR,'0123456789','abdefgiklm') AS name FROM (SELECT competitor, CASE WHEN competitor%25=1 THEN competitor-1 ELSE competitor END AS k FROM roster)")
cte("dkeys", f"SELECT DISTINCT competitor, {CW('opponent_name')}||'@'||date AS opp_key FROM sides")
cte("feedlink", f"""
WITH n AS (SELECT DISTINCT favourite AS feed_name, {CW('favourite')} AS nm FROM prices), e AS (SELECT DISTINCT favourite AS feed_name, {CW('underdog')}||'@'||date AS opp_key FROM prices),
 c AS (SELECT n.feed_name, r.competitor FROM n JOIN roster r ON {CW('r.name')}=n.nm),
 p AS (SELECT c.feed_name, c.competitor, count(*) AS shared FROM c JOIN e USING (feed_name) JOIN dkeys d ON d.competitor=c.competitor AND d.opp_key=e.opp_key GROUP BY 1,2),
 f AS (SELECT c.feed_name, count(*) AS candidates, count(p.shared) AS corroborated, max(c.competitor) FILTER (p.shared IS NOT NULL) AS linked_id FROM c LEFT JOIN p USING (feed_name, competitor) GROUP BY 1)
SELECT n.feed_name, coalesce(candidates,0) AS candidates, coalesce(corroborated,0) AS corroborated, CASE WHEN corroborated=1 THEN linked_id END AS linked_id,
 CASE WHEN corroborated=1 THEN 'linked' WHEN candidates IS NULL THEN 'unknown' WHEN corroborated>1 THEN 'ambiguous' ELSE 'review' END AS verdict FROM n LEFT JOIN f USING (feed_name)""")
cte("media", """
SELECT 'F'||competitor AS foreign_id, o AS ordinal, CASE WHEN (competitor+o)%3=0 THEN 'head'||competitor||'-'||o ELSE '' END AS headshot, CASE WHEN (competitor+o)%5<2 THEN 'port'||competitor||'-'||o ELSE '' END AS portrait,
 CASE WHEN competitor%2=0 THEN 'body'||competitor||'-'||o ELSE '' END AS full_body, CASE WHEN (competitor+o)%4<>0 THEN ['Brazil','France','Japan','Poland','Georgia'][(competitor%5+1)::INT] ELSE '' END AS country
FROM competitors, (VALUES (1),(2)) v(o)""")
cte("claims", f"""
SELECT CASE WHEN o<3 THEN 'register' ELSE 'profile' END AS source, CASE WHEN competitor%6<>0 THEN 'F'||competitor END AS foreign_id, {feed('name','competitor')} AS label,
 (DATE '1938-01-01'+(competitor*97%17000+o)::INT)::DATE AS born, (9+(competitor+o)%3)::INT AS precision FROM competitors, (VALUES (1),(2),(3)) v(o)""")
cte("spans", 'SELECT competitor, min(date) AS "first", max(date) AS "last" FROM sides GROUP BY 1')
PROB = f"""CASE WHEN s."first" IS NOT NULL AND (date_diff('day',born,s."first")/365.25<16 OR date_diff('day',born,s."first")/365.25>47) THEN 'debut_age'
 WHEN s."first" IS NOT NULL AND date_diff('day',born,s."last")/365.25>55 THEN 'last_age' WHEN s."first" IS NULL AND (date_diff('day',born,{AS_OF})/365.25<16 OR date_diff('day',born,{AS_OF})/365.25>80) THEN 'age_today' END AS problem"""
BEST = lambda src: f"SELECT foreign_id, arg_max(born, (precision, -date_diff('day',DATE '1970-01-01',born))) AS born, max(precision) AS precision FROM claims WHERE foreign_id IS NOT NULL AND source='{src}' GROUP BY 1"
cte("birth1", f"SELECT x.competitor, b.born, b.precision, 'register_id' AS route, {PROB} FROM crosswalk x JOIN ({BEST('register')}) b USING (foreign_id) LEFT JOIN spans s ON s.competitor=x.competitor")
BN = lambda x: norm(x, "birth")
cte("birth2", f"""SELECT o.competitor, b.born, b.precision, 'register_name' AS route, {PROB} FROM (SELECT {BN('name')} AS nm, max(competitor) AS competitor FROM competitors GROUP BY 1 HAVING count(*)=1) o
 JOIN (SELECT {BN('label')} AS nm, min(born) AS born, max(precision) AS precision FROM claims WHERE source='register' GROUP BY 1 HAVING min(born)=max(born)) b USING (nm)
 LEFT JOIN spans s ON s.competitor=o.competitor WHERE o.competitor NOT IN (SELECT competitor FROM birth1 WHERE problem IS NULL)""")
cte("birth3", f"""SELECT x.competitor, b.born, 11 AS precision, 'profile_id' AS route, {PROB} FROM crosswalk x JOIN ({BEST('profile')}) b USING (foreign_id) LEFT JOIN spans s ON s.competitor=x.competitor
 WHERE x.competitor NOT IN (SELECT competitor FROM birth1 WHERE problem IS NULL UNION ALL SELECT competitor FROM birth2 WHERE problem IS NULL)""")
cte("birth_all", "SELECT * FROM birth1 UNION ALL SELECT * FROM birth2 UNION ALL SELECT * FROM birth3")
cte("upcoming", f"""
SELECT contest_id AS slot_id, 'Card '||event_id||' - '||name1 AS event_name, event_id, (date+16)::DATE AS date, bout_order, bout_order=1 AS main_event, division, c1, name1,
 CASE WHEN contest_id%7<>0 THEN c2 END AS c2, CASE WHEN contest_id%7=0 THEN 'Debut Newcomer' ELSE name2 END AS name2
FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY contest_id DESC) AS bout_order FROM contests WHERE date>={AS_OF}-14)""")
cte("fresh", """
SELECT lo, hi, date, arg_min(row_id,row_id) AS row_id, arg_min(competitor,row_id) AS c1, arg_min(opponent,row_id) AS c2, arg_min(CASE result WHEN 'win' THEN 'W' WHEN 'loss' THEN 'L' ELSE 'D' END,row_id) AS result1
FROM (SELECT *, least(competitor,opponent) AS lo, greatest(competitor,opponent) AS hi FROM (SELECT outside_id AS row_id, competitor, (competitor*3+outside_id)%50 AS opponent, (date+2222)::DATE AS date, result FROM outside) f
 LEFT JOIN (SELECT competitor, max(date) AS latest FROM sides GROUP BY 1) USING (competitor) WHERE result IN ('win','loss','draw') AND (latest IS NULL OR date>latest)) GROUP BY 1,2,3""")
TEXTS = ["TKO (Punches)", "KO (Head Kick)", "Submission (Armbar)", "Technical Submission (Triangle)", "Decision (Unanimous)", "Decision (Split)", "Decision (Majority)", "Draw (Split)", "TKO (Doctor Stoppage)", "DQ (Illegal Knee)", "NC", "Guillotine Choke", "No Contest (Overturned)"]
CODES = ["KO/TKO", "KO/TKO", "SUB", "SUB", "U-DEC", "S-DEC", "M-DEC", "S-DEC", "TKO - Doctor''s Stoppage", "DQ", "CNC", "SUB", "CNC"]
LF = lambda x: f"(CASE WHEN len(string_split({x},' '))<2 THEN {norm(x)} ELSE {norm(f'list_last(string_split({x},chr(32)))')}||'_'||substr({norm(f'string_split({x},chr(32))[1]')},1,1) END)"
cte("casc_names", f"SELECT DISTINCT {feed('name','competitor')} AS name FROM roster UNION SELECT substr(name,1,1)||'. '||list_last(string_split(name,' ')) FROM roster")


def cascade(src, overrides=True, lf=True):
    ov = "LEFT JOIN feed_over o ON o.alias=n.name LEFT JOIN (SELECT name, max(competitor) AS id FROM roster GROUP BY 1) b ON b.name=o.target" if overrides else "LEFT JOIN (SELECT NULL::BIGINT AS id) b ON false"
    l = f"LEFT JOIN (SELECT {LF('name')} AS k, max(competitor) AS id FROM roster GROUP BY 1) f ON f.k={LF('n.name')}" if lf else "LEFT JOIN (SELECT NULL::BIGINT AS id) f ON false"
    return f"""SELECT n.name, coalesce(b.id,e.id,m.id,f.id) AS competitor, CASE WHEN b.id IS NOT NULL THEN 'override' WHEN e.id IS NOT NULL THEN 'exact' WHEN m.id IS NOT NULL THEN 'norm' WHEN f.id IS NOT NULL THEN 'lf' ELSE 'none' END AS matched_by
     FROM (SELECT DISTINCT name FROM {src}) n {ov} LEFT JOIN (SELECT name, max(competitor) AS id FROM roster GROUP BY 1) e ON e.name=n.name LEFT JOIN (SELECT {norm('name')} AS k, max(competitor) AS id FROM roster GROUP BY 1) m ON m.k={norm('n.name')} {l}"""


cte("ext_feed", f"SELECT division, {feed('name','competitor')} AS name, rank FROM external_rank")
cte("fav_names", "SELECT DISTINCT favourite AS name FROM prices")
_ov, _own, _ex, _dv, _un = "overlap", "own_opponents", "name_exact", "division_match", "exact_rivals=1"
_starts = [p for _, _, ps in ORGANISATIONS for p in ps] + ["Alash Pride", "Extreme Shootout", "Local Night", "2 Hot"]
_q = lambda x: "'" + x.replace("'", "''") + "'"
TIER_CASE = " ".join(f"WHEN {_q(t)} THEN {m}::DOUBLE" for t, m in TIER_MULTIPLIERS.items())
cte("orgs", "SELECT * FROM (VALUES " + ", ".join(f"({i}, {_q(n)}, {_q(t)}, {_q(p)})" for i, (n, t, p) in enumerate((n, t, p) for n, t, ps in ORGANISATIONS for p in ps)) + ") v(ord, name, tier, prefix)")
cte("titled", f"""SELECT ' '||st||CASE WHEN st LIKE '% ' THEN '' ELSE ' ' END||(outside_id%90)||CASE WHEN outside_id%2=0 THEN ' - A City' ELSE '' END AS title
FROM (SELECT outside_id, CASE WHEN outside_id%3=1 THEN upper(s) ELSE s END AS st FROM (SELECT outside_id, [{", ".join(map(_q, _starts))}][(outside_id%{len(_starts)}+1)::INT] AS s FROM outside))""")
ORACLES = {
    "B1_B2_cell_parsing": sql("SELECT event AS EVENT, name AS COMPETITOR, sum(CASE WHEN p%9=0 THEN 0 ELSE n END)::BIGINT AS td_landed, sum(CASE WHEN p%9=0 THEN 0 ELSE n+1 END)::BIGINT AS td_attempted, 0::BIGINT AS ground_landed, sum(CASE WHEN p%17=0 THEN 0 ELSE n*60+p%60 END)::BIGINT AS ctrl FROM rounds GROUP BY 1,2"),
    "B3_long_dates": sql("SELECT 'Card '||contest_id AS EVENT, date FROM contests"),
    "B4_B17_division_labels": sql("SELECT clean AS division, 'Female' AS gender, count(*) AS n FROM raw_results GROUP BY 1"),
    "B5_B6_outcomes_and_methods": sql(f"SELECT result1, result2, {METHOD} AS method, count(*) AS n FROM raw_results GROUP BY ALL"),
    "B7_surrogate_keys": sql(f"SELECT contest_id, {H('ltrim(EVENT)||chr(124)||BOUT')} AS contest_key, {H('ltrim(EVENT)')} AS event_key FROM raw_results"),
    "B8_round_aggregation": sql("SELECT * FROM side_stats"),
    "B9_B10_contest_assembly": sql("SELECT * FROM assembled"),
    "B11_B16_career_totals": sql("SELECT name, sum(kd)::BIGINT AS kd, sum(td_landed)::BIGINT AS td_landed, sum(sub_att)::BIGINT AS sub_att, sum(ctrl)::BIGINT AS ctrl, " + ", ".join(safe(f"sum({s}_landed)", f"sum({s}_attempted)") + f" AS {s}_pct" for s in ("sig", "head", "body", "leg", "distance", "clinch", "ground")) + " FROM side_stats GROUP BY 1"),
    "B12_B15_records_and_rates": sql("SELECT competitor, wins, losses, draws, " + ", ".join(safe(c, "wins") + f" AS {c}_rate" for c in ("ko", "sub", "dec")) + " FROM (SELECT competitor, count(*) FILTER (result='W') AS wins, count(*) FILTER (result='L') AS losses, count(*) FILTER (result='D') AS draws, count(*) FILTER (result='W' AND method='KO/TKO') AS ko, count(*) FILTER (result='W' AND method='SUB') AS sub, count(*) FILTER (result='W' AND method LIKE '%-DEC') AS dec FROM sides GROUP BY 1)"),
    "B13_B14_home_division": sql("SELECT * FROM home"),
    "B18_physical_lookup": sql("""SELECT name, (inch//12)||''' '||(inch%12)||'"' AS height, (115+competitor%10*10)::VARCHAR AS weight, CASE WHEN competitor%6=5 THEN '--' ELSE (inch+2)::VARCHAR END AS reach, ['Orthodox','Southpaw','Switch'][(competitor%3+1)::INT] AS stance FROM phys"""),
    "C1_reresolved_participants": sql("SELECT c.contest_id, " + ", ".join(f"coalesce((SELECT canonical_id FROM registry g WHERE g.norm={norm(feed(f'c.name{i}', f'c.c{i}'))}), (SELECT max(competitor) FROM roster q WHERE q.name={feed(f'c.name{i}', f'c.c{i}')}), c.c{i}+100000) AS c{i}" for i in (1, 2)) + " FROM contests c"),
    "C2_C3_patch_verdicts": sql("SELECT patch_id, date, verdict FROM patch_verdicts"),
    "C4_synthetic_ids": sql("SELECT patch_id, c1, c2, resolved1, resolved2 FROM patched"),
    "C5_patch_counters": sql("SELECT count(*) FILTER (verdict='added') AS added, count(*) FILTER (verdict='duplicate') AS duplicates, count(*) FILTER (verdict='stale') AS stale, sum(CASE WHEN verdict='added' THEN resolved1::INT+resolved2::INT ELSE 0 END)::BIGINT AS ids_resolved FROM patched"),
    "C6_identity_merges": sql("SELECT * FROM merged"),
    "C6_roster_after_merges": sql("SELECT competitor, name FROM roster WHERE competitor%10 NOT IN (1,3)"),
    "C7_sides": sql("SELECT contest_id, side, competitor, opponent, result, row_number() OVER (PARTITION BY competitor ORDER BY seq)-1 AS nth, row_number() OVER (PARTITION BY competitor ORDER BY seq DESC) AS rev, str_self, str_opp FROM sides"),
    "C8_name_variants": sql("SELECT competitor, " + ", ".join(f"{norm('x',v)} AS {v}" for v in VARIANTS) + f", {LF('x')} AS last_first, {SUR('x')} AS surname FROM (SELECT competitor, {feed('name','competitor')} AS x FROM roster)"),
    "C9_pair_keys": sql(f"SELECT {pair('name1','name2')} AS pair, count(*) AS meetings FROM contests GROUP BY 1"),
    "C10_name_cascade": sql(cascade("casc_names")),
    "C11_alias_registry": sql("SELECT * FROM registry"),
    "C13_known_opponents": sql("SELECT competitor, count(*) AS opponents FROM known GROUP BY 1"),
    "C14_match_candidates": sql("SELECT competitor, block, count(*) AS candidates FROM mcand GROUP BY 1,2"),
    "C15_candidate_scores": sql("SELECT competitor, foreign_id, name_exact, division_match, overlap, score FROM mscore WHERE overlap>0"),
    "C16_C17_best_and_verdict": sql(f"""SELECT *, CASE WHEN {_ov}>=3 OR ({_ov}>=2 AND ({_ov}>={_own}*0.5 OR ({_ex} AND {_un}))) OR ({_ov}>=1 AND {_ex} AND {_dv} AND {_un}) OR ({_own}=0 AND {_ex} AND {_dv} AND {_un}) THEN 'verified'
      WHEN {_ov}>=1 OR ({_ex} AND ({_dv} OR {_own}=0)) THEN 'review' ELSE 'reject' END AS verdict FROM (SELECT * EXCLUDE (rn) FROM (SELECT *, count(*) FILTER (name_exact) OVER (PARTITION BY competitor) AS exact_rivals, row_number() OVER (PARTITION BY competitor ORDER BY overlap DESC, score DESC, foreign_id) AS rn FROM mscore) WHERE rn=1)"""),
    "C18_unmapped_ids": sql("SELECT competitor, name FROM roster ANTI JOIN crosswalk USING (competitor)"),
    "C19_duplicate_audit": sql(f"""SELECT t.norm, t.ids, coalesce(s.n,0) AS shared_contests, CASE WHEN s.n>0 THEN 'duplicate' ELSE 'namesakes' END AS verdict FROM (SELECT {CW('name')} AS norm, count(*) AS ids FROM twins GROUP BY 1 HAVING count(*)>1) t
      LEFT JOIN (SELECT norm, count(*) AS n FROM (SELECT {CW('name')} AS norm, opp_key FROM dkeys JOIN twins USING (competitor) GROUP BY 1,2 HAVING count(*)>1) GROUP BY 1) s USING (norm)"""),
    "C19_duplicate_pairs": sql(f"""SELECT norm, lo AS primary, competitor AS secondary, count(*) AS shared_contests FROM (
      SELECT *, min(competitor) OVER (PARTITION BY norm, opp_key) AS lo FROM (SELECT DISTINCT k.competitor, opp_key, {CW('name')} AS norm FROM
        (SELECT competitor, opp_key FROM dkeys UNION SELECT competitor+1, {CW('opponent_name')}||'@'||date FROM sides WHERE competitor%25=0 AND contest_id%20=0) k JOIN twins t ON t.competitor=k.competitor))
      WHERE competitor<>lo GROUP BY 1,2,3"""),
    "C20_claimed_edges": sql(f"SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY opponent_norm, date) AS ids FROM (SELECT DISTINCT {CW('opponent_name')} AS opponent_norm, date, competitor FROM sides)) WHERE ids>1"),
    "C20_edge_audit": sql(f"SELECT CASE WHEN year(date)<2001 THEN 'early' ELSE 'modern' END AS era, count(*) AS keys, max(ids) AS most_ids FROM (SELECT {CW('opponent_name')} AS o, date, count(DISTINCT competitor) AS ids FROM sides GROUP BY 1,2 HAVING count(DISTINCT competitor)>1) GROUP BY 1"),
    "C21_split_identities": sql("SELECT foreign_id, count(DISTINCT competitor) AS ids, min(competitor) AS first_id, max(competitor) AS last_id FROM crosswalk GROUP BY 1 HAVING count(DISTINCT competitor)>1"),
    "C22_weak_links": sql(f"SELECT x.*, CASE WHEN competitor%6/5>=0.6 OR (competitor%3=0 AND competitor IN (SELECT max(competitor) FROM roster GROUP BY {norm('name')} HAVING count(*)=1)) THEN 'corroborated' ELSE 'queue' END AS decision FROM crosswalk x WHERE confidence<60"),
    "C23_feed_links": sql("SELECT * FROM feedlink"),
    "C23_record_gaps": sql("SELECT competitor, wins+losses+draws AS on_file, contests, abs(wins+losses+draws-contests) AS gap FROM competitors WHERE abs(wins+losses+draws-contests)>5"),
    "C23_registry": sql("SELECT competitor, name, (SELECT string_agg(n,'|' ORDER BY n) FROM (SELECT DISTINCT normalized_name AS n FROM aliases a WHERE a.canonical_id=r.competitor)) AS aliases FROM roster r"),
    "C24_media_cascade": sql("""SELECT competitor, coalesce(h,p,b) AS picture, CASE WHEN h IS NOT NULL THEN 'headshot' WHEN p IS NOT NULL THEN 'portrait' WHEN b IS NOT NULL THEN 'full_body' END AS picture_kind, country,
      CASE country WHEN 'Brazil' THEN 'BR' WHEN 'France' THEN 'FR' WHEN 'Japan' THEN 'JP' WHEN 'Poland' THEN 'PL' END AS iso FROM competitors LEFT JOIN crosswalk USING (competitor)
      LEFT JOIN (SELECT foreign_id, arg_min(headshot,ordinal) FILTER (headshot<>'') AS h, arg_min(portrait,ordinal) FILTER (portrait<>'') AS p, arg_min(full_body,ordinal) FILTER (full_body<>'') AS b, arg_min(country,ordinal) FILTER (country<>'') AS country FROM media GROUP BY 1) USING (foreign_id)"""),
    "C25_birth_dates": sql("SELECT competitor, born, CASE WHEN precision>=11 THEN 'day' WHEN precision=10 THEN 'month' ELSE 'year' END AS precision, route FROM birth_all WHERE problem IS NULL"),
    "C26_birth_rejects": sql("SELECT competitor, born, route, problem FROM birth_all WHERE problem IS NOT NULL"),
    "C27_birth_coverage": sql(f"""SELECT coalesce(home_division,'TOTAL') AS home_division, count(*) AS competitors, count(route) AS covered, count(*) FILTER (route LIKE 'register%') AS from_register, count(*) FILTER (route='profile_id') AS from_profile,
      count(*) FILTER (a) AS active, count(*) FILTER (a AND route IS NOT NULL) AS active_covered FROM (SELECT c.home_division, b.route, coalesce({months('s."last"',AS_OF)}<=24,false) AS a FROM competitors c LEFT JOIN (FROM birth_all WHERE problem IS NULL) b USING (competitor) LEFT JOIN spans s USING (competitor)) GROUP BY ROLLUP (home_division)"""),
    "C28_upcoming_ids": sql(f"""SELECT slot_id, foreign_id, name, coalesce(l, m) AS competitor, l IS NULL AND m IS NOT NULL AS heals FROM (SELECT u.slot_id, 'F'||u.c1 AS foreign_id, {feed('u.name1','u.c1')} AS name FROM upcoming u) x
      LEFT JOIN (SELECT foreign_id, competitor AS l FROM crosswalk) USING (foreign_id) LEFT JOIN (SELECT {norm('name','upcoming')} AS k, max(competitor) AS m FROM roster WHERE competitor IN (SELECT competitor FROM sides) GROUP BY 1 HAVING count(*)=1) y ON y.k={norm('x.name','upcoming')}"""),
    "C29_fresh_contests": sql("SELECT row_id, c1, c2, date, result1, CASE result1 WHEN 'W' THEN 'L' WHEN 'L' THEN 'W' ELSE 'D' END AS result2 FROM fresh"),
    "C30_accumulating_merge": sql("""SELECT lo, hi, date, row_id, 'fresh' AS origin FROM fresh UNION ALL SELECT least(c1,c2), greatest(c1,c2), date, contest_id, 'carried' FROM contests c WHERE
      NOT EXISTS (SELECT 1 FROM fresh f WHERE f.lo=least(c.c1,c.c2) AND f.hi=greatest(c.c1,c.c2) AND f.date=c.date)"""),
    "C31_method_audit": sql("SELECT target, matched, n, floor(n/sum(n) OVER ()*100*1e4+0.5)/1e4 AS share FROM (SELECT CASE WHEN contest_id%211=0 THEN 'Other' ELSE [" + ",".join(f"'{c}'" for c in CODES) + "][(contest_id%13+1)::INT] END AS target, contest_id%211<>0 AS matched, count(*) AS n FROM contests GROUP BY 1,2)"),
    "C31_method_verdict": sql("SELECT count(*)::BIGINT AS rows, count(*) FILTER (contest_id%211=0)::BIGINT AS unmatched, count(*) FILTER (contest_id%211=0)*100<=count(*) AS passed FROM contests"),
    "C32_titles_to_organisations": sql(f"""SELECT canonical, tier, multiplier, count(*) AS contests, min(title) AS sample, NOT matched AS needs_review FROM (
      SELECT title, coalesce(o[1], label) AS canonical, coalesce(o[2],'tier4') AS tier, o IS NOT NULL AS matched, CASE coalesce(o[2],'tier4') {TIER_CASE} END AS multiplier FROM (
       SELECT title, CASE WHEN head='' THEN trim(title) ELSE head END AS label, (SELECT arg_min((name, tier), ord) FROM orgs WHERE starts_with(lower(trim(title)), lower(prefix))) AS o FROM (
        SELECT title, trim(regexp_replace(trim(regexp_extract(title, '^(.*?)(\\s+[-–]\\s+|$)', 1)), '\\s+\\d.*$', '')) AS head FROM titled)))
      WHERE NOT contains(canonical,'UFC') GROUP BY ALL"""),
    "C32_organisation_dictionary": sql("""SELECT organisation, count(*) AS contests, min(event_name) AS sample, any_value(tier) AS tier, any_value(tier_multiplier) AS multiplier, any_value(tier)='tier4' AS needs_review FROM outside GROUP BY 1"""),
    "C33_external_match_audit": sql(f"SELECT e.division, e.name, e.rank, c.competitor AS resolved_id, c.matched_by, CASE WHEN c.competitor IS NOT NULL THEN 'MATCHED' ELSE 'UNMATCHED' END AS status FROM ext_feed e LEFT JOIN ({cascade('ext_feed', False)}) c USING (name)"),
    "C33_must_match": sql(f"SELECT e.division, e.name, e.rank FROM ext_feed e WHERE e.rank IN ('C','1','2','3') AND e.name NOT IN (SELECT name FROM ({cascade('ext_feed', False)}) c WHERE c.competitor IS NOT NULL)"),
    "C34_resolver_diff": sql(f"""SELECT name, old_id, new_id, CASE WHEN old_id IS NULL AND new_id IS NULL THEN 'both_missing' WHEN old_id=new_id THEN 'same' WHEN old_id IS NULL THEN 'gained' WHEN new_id IS NULL THEN 'lost' ELSE 'changed' END AS kind
      FROM (SELECT c.name, c.competitor AS old_id, (SELECT canonical_id FROM registry g WHERE g.norm={norm('c.name')}) AS new_id FROM ({cascade('fav_names', False, False)}) c)"""),
    "C35_stale_champions": sql("SELECT e.division, e.competitor, l.contest_id, l.date, l.opponent AS lost_to FROM external_rank e JOIN (SELECT *, row_number() OVER (PARTITION BY competitor ORDER BY seq DESC) AS rn FROM sides) l ON l.competitor=e.competitor AND l.rn=1 WHERE e.rank='C' AND l.result='L'"),
}
