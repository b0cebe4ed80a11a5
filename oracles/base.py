"""Shared DuckDB CTEs: the test tables bound to the competition tables, and the rating sweep.

Every oracle is one SQL string; `sql(body, ...)` prepends the CTEs it needs.
"""

from __future__ import annotations

import re

AS_OF = "DATE '2001-08-02'"
CTES: dict[str, str] = {}


def cte(name: str, body: str) -> None:
    CTES[name] = body


def r(expr: str, digits: int = 0) -> str:
    """Round half toward +infinity."""
    scale = f"1e{digits}"
    return f"(floor(({expr})*{scale}+0.5)/{scale})"


def months(start: str, end: str) -> str:
    return f"(date_diff('day', {start}, {end})/30.44::DOUBLE)"


def needs(text: str) -> list[str]:
    """CTEs a text refers to, dependencies first."""
    order: list[str] = []

    def visit(t: str) -> None:
        for name, body in CTES.items():
            if name not in order and re.search(rf"\b{name}\b", t):
                if body is not t:
                    visit_body(name, body)

    def visit_body(name: str, body: str) -> None:
        pending.add(name)
        for other, ob in CTES.items():
            if other not in order and other not in pending and re.search(rf"\b{other}\b", body):
                visit_body(other, ob)
        if name not in order:
            order.append(name)

    pending: set[str] = set()
    visit(text)
    return order


BODIES: dict[str, str] = {}


def sql(body: str) -> str:
    parts = []
    for name in needs(body):
        text = CTES[name]
        if text.lstrip().startswith("USING"):
            parts.append(text.replace("USING", f"{name} USING", 1))
        elif text.lstrip().startswith("("):
            parts.append(f"{name} {text}")
        else:
            parts.append(f"{name} AS MATERIALIZED ({text})")
    out = ("WITH RECURSIVE " + ",\n".join(parts) + "\n" + body) if parts else body
    BODIES[out] = body
    return out


cte("side_raw", """
SELECT l_orderkey, l_suppkey, min(l_linenumber) AS ln, sum(l_quantity) AS vol, max(l_discount) AS acc,
  count(*) FILTER (l_returnflag='R') AS kd, count(*) AS td, sum(l_extendedprice) AS amount,
  min(l_returnflag) AS rf, sum(l_linenumber)*30 AS ctrl, count(*) FILTER (l_linestatus='O') AS sub
FROM lineitem GROUP BY ALL""")
cte("side_pick", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY ln, l_suppkey) AS rn
  FROM side_raw) WHERE rn <= 2""")
FIRST_NAMES = ["Adam", "Bruno", "Carlos", "Diego", "Erik", "Felix", "Goran", "Hugo", "Ivan", "Jose"]
cte("roster", f"""
SELECT s_suppkey AS competitor, {FIRST_NAMES}[(s_suppkey%10+1)::INT] || ' Van'
  || translate(s_suppkey::VARCHAR,'0123456789','abdefgiklm') AS name,
  CASE WHEN s_nationkey%2=0 THEN 'Male' ELSE 'Female' END AS gender, s_acctbal AS balance, s_nationkey AS nation
FROM supplier""")
KO_DETAILS = ["Punch to Head At Distance", "Elbows to Head On Ground", "Knee to Body", "Kick to Head At Distance",
              "Kick to Leg At Distance", "Kick to Body", "Injury", "Corner Stoppage"]
SUB_DETAILS = ["Rear Naked Choke", "Arm Triangle From Mount", "Triangle Armbar", "Guillotine Choke",
               "Kimura", "Heel Hook", "Anaconda Choke", "Unknown hold"]


def _list(xs):
    return "[" + ",".join("'" + x + "'" for x in xs) + "]"


cte("contests", f"""
SELECT *, CASE WHEN method='KO/TKO' THEN {_list(KO_DETAILS)}[(contest_id%8+1)::INT]
    WHEN method='SUB' THEN {_list(SUB_DETAILS)}[(contest_id%8+1)::INT] ELSE '' END AS details,
  row_number() OVER (ORDER BY date, contest_id) AS seq
FROM (
SELECT o_orderkey AS contest_id, o_orderdate::DATE AS date, strftime(o_orderdate, 'E%Y%m%d') AS event_id,
  r_name AS division, a.l_suppkey AS c1, b.l_suppkey AS c2, n1.name AS name1, n2.name AS name2,
  a.kd AS kd1, b.kd AS kd2, a.vol AS str1, b.vol AS str2, a.td AS td1, b.td AS td2, a.sub AS sub1, b.sub AS sub2,
  a.acc AS acc1, b.acc AS acc2, a.ctrl AS ctrl1, b.ctrl AS ctrl2,
  {r('a.amount',2)} AS amount1, {r('b.amount',2)} AS amount2,
  CASE WHEN o_orderstatus='P' AND o_orderpriority='5-LOW' THEN 'NC'
    WHEN abs({r('a.amount',2)}-{r('b.amount',2)}) < 0.01*({r('a.amount',2)}+{r('b.amount',2)}) THEN 'D'
    WHEN {r('a.amount',2)} > {r('b.amount',2)} THEN 'W' ELSE 'L' END AS result1,
  CASE result1 WHEN 'W' THEN 'L' WHEN 'L' THEN 'W' ELSE result1 END AS result2,
  CASE WHEN a.rf='A' THEN 'KO/TKO' WHEN a.rf='N' AND a.td>1 THEN 'SUB'
    WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 'U-DEC'
    WHEN o_orderpriority='3-MEDIUM' THEN 'M-DEC' ELSE 'S-DEC' END AS method,
  1+o_orderkey%3 AS round,
  CASE WHEN o_orderkey%300=0 THEN '--' ELSE (o_orderkey%300)//60 || ':' || lpad(((o_orderkey%300)%60)::VARCHAR,2,'0') END AS clock,
  o_orderkey%11<>0 AS has_metrics
FROM orders JOIN side_pick a ON a.l_orderkey=o_orderkey AND a.rn=1
JOIN side_pick b ON b.l_orderkey=o_orderkey AND b.rn=2
JOIN customer ON c_custkey=o_custkey JOIN nation ON n_nationkey=c_nationkey JOIN region ON r_regionkey=n_regionkey
JOIN roster n1 ON n1.competitor=a.l_suppkey JOIN roster n2 ON n2.competitor=b.l_suppkey)""")
cte("sides", """
SELECT contest_id, seq, date, event_id, division, 1 AS side, c1 AS competitor, c2 AS opponent, name1 AS name, name2 AS opponent_name,
  result1 AS result, kd1 AS kd_self, kd2 AS kd_opp, str1 AS str_self, str2 AS str_opp, td1 AS td_self, td2 AS td_opp,
  sub1 AS sub_self, acc1 AS acc_self, acc2 AS acc_opp, ctrl1 AS ctrl_self, method, details, round, clock, has_metrics FROM contests
UNION ALL
SELECT contest_id, seq, date, event_id, division, 2, c2, c1, name2, name1, result2, kd2, kd1, str2, str1, td2, td1,
  sub2, acc2, acc1, ctrl2, method, details, round, clock, has_metrics FROM contests""")
cte("home", f"""
SELECT competitor, CASE WHEN sum(nr)>0 THEN arg_min(division, (-nr, fr)) FILTER (nr>0) ELSE arg_min(division, (-n, fa)) END AS home_division
FROM (SELECT competitor, division, count(*) AS n, min(contest_id) AS fa,
    count(*) FILTER (date >= {AS_OF} - INTERVAL 2 YEAR) AS nr,
    min(contest_id) FILTER (date >= {AS_OF} - INTERVAL 2 YEAR) AS fr
  FROM sides WHERE division NOT IN ('Catch Weight','Open Weight') GROUP BY 1,2) GROUP BY 1""")
cte("competitors", f"""
SELECT o.competitor, o.name, o.gender, o.balance, o.nation, coalesce(h.home_division,'') AS home_division,
  coalesce(t.wins,0) AS wins, coalesce(t.losses,0) AS losses, coalesce(t.draws,0) AS draws, coalesce(t.contests,0) AS contests,
  CASE WHEN t.wins>0 THEN {r('t.ko/t.wins',2)} ELSE 0 END AS ko_rate,
  CASE WHEN t.wins>0 THEN {r('t.sb/t.wins',2)} ELSE 0 END AS sub_rate,
  CASE WHEN t.wins>0 THEN {r('t.dc/t.wins',2)} ELSE 0 END AS dec_rate,
  coalesce(t.kd,0) AS kd_total, coalesce(t.td,0) AS td_total, coalesce(t.sub,0) AS sub_total, coalesce(t.ctrl,0) AS ctrl_total,
  CASE WHEN t.contests>0 THEN {r('t.acc100/t.contests/100',4)} ELSE 0 END AS accuracy,
  CASE WHEN t.td>0 THEN {r('t.sub/t.td',2)} ELSE 0 END AS ground_share,
  CASE WHEN t.td>0 THEN {r('t.kd/t.td',2)} ELSE 0 END AS distance_share
FROM roster o LEFT JOIN home h USING (competitor)
LEFT JOIN (SELECT competitor, count(*) FILTER (result='W') AS wins, count(*) FILTER (result='L') AS losses,
  count(*) FILTER (result='D') AS draws, count(*) AS contests,
  count(*) FILTER (result='W' AND method='KO/TKO') AS ko, count(*) FILTER (result='W' AND method='SUB') AS sb,
  count(*) FILTER (result='W' AND method LIKE '%DEC') AS dc, sum(kd_self) AS kd, sum(td_self) AS td, sum(sub_self) AS sub,
  sum(ctrl_self) AS ctrl, sum(round(acc_self*100)) AS acc100 FROM sides GROUP BY 1) t USING (competitor)""")
cte("external_rank", """
SELECT home_division AS division, competitor, name, CASE WHEN rn=1 THEN 'C' ELSE (rn-1)::VARCHAR END AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY home_division ORDER BY balance DESC, competitor) AS rn
  FROM competitors WHERE home_division<>'') WHERE rn<=16""")

# ── rating sweep ──────────────────────────────────────────────────────────


def sweep_ctes(prefix="", base_k=24.0, prov=5, prov_mult=1.5, retain=0.92, move=0.10, spread=1.0,
               era=None, boundary=True):
    """Context CTE (everything but the ratings is a window) and the level-by-level recursion."""
    boundary_date = f"({AS_OF} - INTERVAL 1826 DAY)"
    mult = lambda m: repr(1 + (m - 1) * spread)
    rated = prefix + "rated"
    cte(rated, f"""
SELECT contest_id, seq, date, c1, c2, method, division,
  CASE WHEN result1='W' THEN 1.0 WHEN result1='L' THEN 0.0 ELSE 0.5 END::DOUBLE AS s1,
  {base_k}::DOUBLE * CASE WHEN method='KO/TKO' THEN {mult(1.4)} WHEN method='SUB' THEN {mult(1.35)}
   WHEN method='M-DEC' THEN {mult(0.9)} WHEN method='S-DEC' THEN {mult(0.8)} ELSE 1.0 END::DOUBLE AS k
FROM contests WHERE result1 IN ('W','L','D') {f'AND year(date)>={era}' if era else ''}""")
    ctx = prefix + "ctx"
    disc = f"CASE WHEN date>={boundary_date} AND coalesce(prev_date<{boundary_date}, true) THEN 0.5 ELSE 1 END" \
        if boundary and not era else "1"
    cte(ctx, f"""
SELECT *, CASE WHEN gap>12 THEN pow({retain}::DOUBLE,(gap-12)/12) ELSE 1 END
  * CASE WHEN prev_label IS NOT NULL AND division IS NOT NULL AND prev_label<>division THEN {1-move}::DOUBLE ELSE 1 END
  * {disc}::DOUBLE AS carry, k * CASE WHEN nth<{prov} THEN {prov_mult} ELSE 1 END::DOUBLE AS kk
FROM (SELECT *, {months('prev_date','date')} AS gap FROM (
 SELECT *, lag(sid) OVER w AS prev_sid, lag(date) OVER w AS prev_date, count(*) OVER (PARTITION BY competitor ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS nth, lag(division) OVER w AS prev_label
 FROM (SELECT seq*2 AS sid, seq, contest_id, date, division, c1 AS competitor, c2 AS opponent, s1 AS s, k FROM {rated}
  UNION ALL SELECT seq*2+1, seq, contest_id, date, division, c2, c1, 1-s1, k FROM {rated})
 WINDOW w AS (PARTITION BY competitor ORDER BY seq)))""")
    duel = prefix + "duel"
    cte(duel, f"""
SELECT a.sid, coalesce(a.prev_sid,-1) AS p1, coalesce(b.prev_sid,-1) AS p2, a.carry AS g1, b.carry AS g2, a.kk AS k1, b.kk AS k2, a.s
FROM {ctx} a JOIN {ctx} b ON b.sid=a.sid+1 WHERE a.sid%2=0""")
    dev = prefix + "dev"
    cte(dev, f"""(sid, before, after) USING KEY (sid) AS (
 SELECT -1::BIGINT, 0::DOUBLE, 0::DOUBLE
 UNION
 SELECT d.sid+z.i, CASE z.i WHEN 0 THEN d.x1 ELSE d.x2 END,
   CASE z.i WHEN 0 THEN d.x1+d.k1*(d.s-d.e) ELSE d.x2+d.k2*((1-d.s)-(1-d.e)) END
 FROM (SELECT *, 1/(1+pow(10::DOUBLE,(x2-x1)/400)) AS e FROM (
   SELECT c.sid, c.k1, c.k2, c.s, b1.after*c.g1 AS x1, b2.after*c.g2 AS x2
   FROM {duel} c JOIN recurring.{dev} b1 ON b1.sid=c.p1 JOIN recurring.{dev} b2 ON b2.sid=c.p2
   WHERE NOT EXISTS (SELECT 1 FROM recurring.{dev} q WHERE q.sid=c.sid))) d, (VALUES (0),(1)) z(i))""")
    cte(prefix + "history", f"""
SELECT x.seq, x.sid, x.contest_id, x.date, x.division, x.competitor, x.opponent, x.nth, x.prev_date, x.prev_label, x.gap,
  CASE x.s WHEN 1 THEN 'W' WHEN 0 THEN 'L' ELSE 'D' END AS result, x.s AS score,
  1500+d.before AS rating_before, 1500+d.after AS rating_after, d.after-d.before AS delta, 1500+o.before AS opponent_rating
FROM {ctx} x JOIN {dev} d USING (sid) JOIN {dev} o ON o.sid = CASE WHEN x.sid%2=0 THEN x.sid+1 ELSE x.sid-1 END""")
    gap = months("last_date", AS_OF)
    cte(prefix + "ratings", f"""
SELECT competitor, contests_rated, last_date, last_division, peak, at_last,
  CASE WHEN {gap}>12 THEN 1500+(at_last-1500)*pow({retain}::DOUBLE,({gap}-12)/12) ELSE at_last END AS rating
FROM (SELECT competitor, count(*) AS contests_rated, max(date) AS last_date, arg_max(division, seq) AS last_division,
  greatest(1500, max(rating_after)) AS peak, arg_max(rating_after, seq) AS at_last
  FROM {prefix}history GROUP BY 1)""")


sweep_ctes()
