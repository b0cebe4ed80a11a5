"""DuckDB counterparts of the market products."""

from oracles.base import AS_OF, cte, months, r


def norm(x, variant="resolver"):
    t = f"strip_accents(lower({x}))"
    sfx = r"\b(jr|sr|ii|iii|iv)\b"
    rr = lambda e, p, w: f"regexp_replace({e},'{p}','{w}','g')"
    if variant == "resolver":
        return f"trim({rr(rr(t, r'[^a-z\s]', ''), r'\s+', ' ')})"
    if variant == "title":
        return f"trim({rr(rr(t, '[^a-z ]', ''), r'\s+', ' ')})"
    if variant == "loader":
        return f"trim({rr(rr(t, sfx, ''), '[^a-z0-9]', '')})"
    if variant == "crosswalk":
        return f"trim({rr(rr(rr(t, r'[^a-z\s]', ' '), sfx, ''), r'\s+', ' ')})"
    if variant == "upcoming":
        return f"trim({rr(rr(rr(t, '[^a-z ]', ' '), sfx, ''), r'\s+', ' ')})"
    if variant == "birth":
        return f"trim({rr(rr(t, r'\b(jr|sr|junior|senior)\b\.?', ''), '[^a-z0-9]', '')})"
    return f"trim({rr(t, '[^a-z0-9 ]', '')})"


def pair(a, b, variant="loader"):
    x, y = norm(a, variant), norm(b, variant)
    return f"(least({x},{y})||'|'||greatest({x},{y}))"


def feed(name, key):
    return f"CASE {key}%5 WHEN 0 THEN {name} WHEN 1 THEN upper({name}) WHEN 2 THEN {name}||' Jr' WHEN 3 THEN translate(replace({name},'e','e'||chr(768)),'aiostu','ăịơșțễ') ELSE replace({name},'Van','Va''n') END"


cte("side_prices", f"""
SELECT *, {r('1/(1.05::DOUBLE*p1)',4)} AS price1, {r('1/(1.05::DOUBLE*(1-p1))',4)} AS price2 FROM (
 SELECT *, least(greatest(0.5::DOUBLE+0.8::DOUBLE*(amount1/(amount1+amount2)-0.5)+0.5::DOUBLE*((contest_id*7919%1000)/1000-0.5),0.08),0.92) AS p1 FROM contests)""")
cte("prices", f"""
SELECT contest_id AS price_id, (date+((contest_id%5)-2)::INT)::DATE AS date, event_id AS event, CASE WHEN f THEN n1 ELSE n2 END AS favourite, CASE WHEN f THEN n2 ELSE n1 END AS underdog,
 least(price1,price2) AS fav_odds, greatest(price1,price2) AS dog_odds,
 CASE CASE WHEN f THEN result1 ELSE result2 END WHEN 'W' THEN 'favourite' WHEN 'L' THEN 'underdog' ELSE 'unknown' END AS outcome
FROM (SELECT *, price1<=price2 AS f, {feed('name1','c1')} AS n1, {feed('name2','c2')} AS n2 FROM side_prices)""")
cte("feed_over", f"SELECT {feed('name','competitor')} AS alias, name AS target FROM roster WHERE competitor%10=2")
cte("price_names", f"""
SELECT n.name, coalesce(b.competitor, e.competitor, m.competitor) AS competitor,
 CASE WHEN b.competitor IS NOT NULL THEN 'override' WHEN e.competitor IS NOT NULL THEN 'exact' WHEN m.competitor IS NOT NULL THEN 'norm' ELSE 'none' END AS matched_by
FROM (SELECT DISTINCT favourite AS name FROM prices UNION SELECT underdog FROM prices) n
LEFT JOIN feed_over o ON o.alias=n.name LEFT JOIN (SELECT name, max(competitor) AS competitor FROM roster GROUP BY 1) b ON b.name=o.target
LEFT JOIN (SELECT name, max(competitor) AS competitor FROM roster GROUP BY 1) e ON e.name=n.name
LEFT JOIN (SELECT {norm('name')} AS nm, max(competitor) AS competitor FROM roster GROUP BY 1) m ON m.nm={norm('n.name')}""")
PIT = """
SELECT competitor, opponent, date, max(contest_id) AS contest_id, arg_max(rating_before, contest_id) AS self_rating, arg_max(opponent_rating, contest_id) AS opponent_rating,
 arg_max(nth, contest_id) AS nth, arg_max(nth<5, contest_id) AS provisional, arg_max(coalesce(gap,0), contest_id) AS layoff_months,
 arg_max(coalesce(prev_label<>division,false), contest_id) AS moved, arg_max(division, contest_id) AS label
FROM {h} GROUP BY 1,2,3"""
cte("pit", PIT.format(h="history"))
cte("asked", "SELECT p.price_id, p.date, a.competitor AS fav_id, b.competitor AS dog_id FROM prices p LEFT JOIN price_names a ON a.name=p.favourite LEFT JOIN price_names b ON b.name=p.underdog")


def nearest(name, a, b, src="pit"):
    cte(name, f"""
SELECT q.price_id, arg_min(i, pref) AS hit FROM asked q CROSS JOIN (VALUES (0,0),(1,1),(2,-1),(3,2),(4,-2)) o(pref, off)
JOIN {src} i ON i.competitor=q.{a} AND i.opponent=q.{b} AND i.date=q.date+o.off GROUP BY 1""")


nearest("hit_fav", "fav_id", "dog_id")
nearest("hit_dog", "dog_id", "fav_id")


def power_p(f, d):
    a, b = f"(1/{f})", f"(1/{d})"
    t = (f"list_reduce(list_prepend([1.0::DOUBLE,100.0::DOUBLE], list_transform(range(80), lambda i: [0.0::DOUBLE,0.0::DOUBLE])), lambda s, x: "
         f"CASE WHEN pow({a},(s[1]+s[2])/2)+pow({b},(s[1]+s[2])/2)>1 THEN [(s[1]+s[2])/2,s[2]] ELSE [s[1],(s[1]+s[2])/2] END)")
    return t


cte("joined", f"""
SELECT *, pi_f/(pi_f+pi_d) AS p_multiplicative, pow(pi_f,tau)/(pow(pi_f,tau)+pow(pi_d,tau)) AS p_power,
 CASE WHEN sqrt(pi_f*pi_f/b)+sqrt(pi_d*pi_d/b)<1 THEN pi_f/b ELSE sh_f/(sh_f+sh_d) END AS p_shin, outcome='favourite' AS fav_won,
 CASE WHEN fav_id IS NULL OR dog_id IS NULL THEN 'unresolved_name' WHEN model_p IS NULL THEN 'no_contest' WHEN outcome='unknown' THEN 'unknown_outcome' ELSE 'ok' END AS verdict
FROM (SELECT *, (sqrt(z*z+4*(1-z)*pi_f*pi_f/b)-z)/(2*(1-z)) AS sh_f, (sqrt(z*z+4*(1-z)*pi_d*pi_d/b)-z)/(2*(1-z)) AS sh_d FROM (
 SELECT *, (tt[1]+tt[2])/2 AS tau, (zz[1]+zz[2])/2 AS z FROM (
 SELECT p.*, year(p.date)::INT AS year, q.fav_id, q.dog_id, 1/fav_odds AS pi_f, 1/dog_odds AS pi_d, 1/fav_odds+1/dog_odds AS b, {power_p('fav_odds','dog_odds')} AS tt,
  list_reduce(list_prepend([0.0::DOUBLE,0.999::DOUBLE], list_transform(range(80), lambda i: [0.0::DOUBLE,0.0::DOUBLE])), lambda s, x: CASE WHEN
   (sqrt(pow((s[1]+s[2])/2,2)+4*(1-(s[1]+s[2])/2)/fav_odds/fav_odds/(1/fav_odds+1/dog_odds))-(s[1]+s[2])/2)/(2*(1-(s[1]+s[2])/2))
   +(sqrt(pow((s[1]+s[2])/2,2)+4*(1-(s[1]+s[2])/2)/dog_odds/dog_odds/(1/fav_odds+1/dog_odds))-(s[1]+s[2])/2)/(2*(1-(s[1]+s[2])/2))>1
   THEN [(s[1]+s[2])/2,s[2]] ELSE [s[1],(s[1]+s[2])/2] END) AS zz,
  1/(1+pow(10::DOUBLE,(f.hit.opponent_rating-f.hit.self_rating)/400)) AS model_p, f.hit.self_rating AS fav_rating, f.hit.opponent_rating AS dog_rating,
  f.hit.nth AS fav_no, coalesce(d.hit.nth,-1) AS dog_no, f.hit.provisional AS fav_provisional, coalesce(d.hit.provisional,true) AS dog_provisional,
  NOT f.hit.provisional AND NOT coalesce(d.hit.provisional,true) AS both_established, f.hit.layoff_months AS fav_layoff, coalesce(d.hit.layoff_months,0) AS dog_layoff,
  f.hit.moved AS fav_moved, coalesce(d.hit.moved,false) AS dog_moved, f.hit.label AS division, f.hit.date AS contest_date
 FROM prices p JOIN asked q USING (price_id) LEFT JOIN hit_fav f USING (price_id) LEFT JOIN hit_dog d USING (price_id))))""")
METHODS = ("multiplicative", "power", "shin")
cte("best_method", "SELECT arg_min(method, ll) AS m FROM (" + " UNION ALL ".join(
    f"SELECT '{m}' AS method, avg(CASE WHEN fav_won THEN -ln(p_{m}) ELSE -ln(1-p_{m}) END) AS ll FROM joined WHERE verdict='ok'" for m in METHODS) + ")")
cte("priced", "SELECT *, CASE (SELECT m FROM best_method) " + " ".join(f"WHEN '{m}' THEN p_{m}" for m in METHODS) + " END AS market_p FROM joined WHERE verdict='ok'")
cte("long_models", "SELECT price_id, fav_won, both_established, 'model' AS model, model_p AS p FROM priced UNION ALL SELECT price_id, fav_won, both_established, 'market', market_p FROM priced")
cte("books", f"""
SELECT contest_id, side, book, {r('base*(1::DOUBLE+0.01::DOUBLE*i)',4)} AS price FROM (SELECT contest_id, 1 AS side, price1 AS base FROM side_prices UNION ALL SELECT contest_id, 2, price2 FROM side_prices),
 (VALUES (28,0),(1,1),(2,2),(3,3),(4,4)) v(book,i)""")
cte("consensus", "SELECT contest_id, side, max(price) FILTER (book=28) AS open, median(price) FILTER (book<>28) AS close, count(*) AS books FROM books GROUP BY 1,2")
cte("gaps", f"""
SELECT quote_id, date, p1, CASE WHEN fav_norm=norm1 THEN fav_p ELSE 1-fav_p END AS consensus_p1, abs(p1-CASE WHEN fav_norm=norm1 THEN fav_p ELSE 1-fav_p END) AS gap FROM (
 SELECT c.contest_id AS quote_id, c.date, {norm('c.name1')} AS norm1, (1/a.close)/(1/a.close+1/b.close) AS p1,
  arg_min({norm('p.favourite')}, p.price_id) AS fav_norm, arg_min((1/p.fav_odds)/(1/p.fav_odds+1/p.dog_odds), p.price_id) AS fav_p
 FROM contests c JOIN consensus a ON a.contest_id=c.contest_id AND a.side=1 JOIN consensus b ON b.contest_id=c.contest_id AND b.side=2
 JOIN prices p ON {pair('p.favourite','p.underdog','resolver')}={pair('c.name1','c.name2','resolver')} AND abs(date_diff('day',p.date,c.date))<=3 GROUP BY ALL)""")


def irls(prefix, src, feats, y="fav_won::INT", by=None, steps=14, where="true"):
    """Chained Newton steps: one aggregate per step, closed-form solve for one or two features."""
    k = len(feats) + 1
    g = by or "0"
    xs = ["1::DOUBLE"] + [f"x{i}" for i in range(1, k)]
    cte(f"{prefix}_d", f"SELECT {g} AS g, {y} AS y, " + ", ".join(f"{f} AS x{i+1}" for i, f in enumerate(feats)) + f" FROM {src} WHERE {where}")
    prev = None
    for s in range(steps):
        ws = [f"w.w{i}" if prev else "0::DOUBLE" for i in range(k)]
        eta = "+".join(f"{x}*{w}" for x, w in zip(xs, ws))
        join = f" JOIN {prev} w USING (g)" if prev else ""
        sums = ", ".join([f"sum({xs[i]}*wg*{xs[j]})+{'1e-6' if i == j else '0'} AS h{i}{j}" for i in range(k) for j in range(i, k)]
                         + [f"sum({xs[i]}*wg*(eta+(y-mu)/wg)) AS b{i}" for i in range(k)])
        inner = f"SELECT *, greatest(mu*(1-mu),1e-9) AS wg FROM (SELECT *, 1/(1+exp(-eta)) AS mu FROM (SELECT d.*, {eta} AS eta FROM {prefix}_d d{join}))"
        if k == 2:
            det = "(h00*h11-h01*h01)"
            sol = f"(b0*h11-b1*h01)/{det} AS w0, (h00*b1-h01*b0)/{det} AS w1"
        else:
            det = "(h00*(h11*h22-h12*h12)-h01*(h01*h22-h12*h02)+h02*(h01*h12-h11*h02))"
            sol = (f"(b0*(h11*h22-h12*h12)-h01*(b1*h22-h12*b2)+h02*(b1*h12-h11*b2))/{det} AS w0, "
                   f"(h00*(b1*h22-h12*b2)-b0*(h01*h22-h12*h02)+h02*(h01*b2-b1*h02))/{det} AS w1, "
                   f"(h00*(h11*b2-b1*h12)-h01*(h01*b2-b1*h02)+b0*(h01*h12-h11*h02))/{det} AS w2")
        name = f"{prefix}_w{s}"
        cte(name, f"SELECT g, {sol} FROM (SELECT g, {sums} FROM ({inner}) GROUP BY g)")
        prev = name
    cte(f"{prefix}_fit", f"SELECT * FROM {prev}")


LOGIT = lambda p: f"ln(least(greatest({p},1e-12),1-1e-12)/(1-least(greatest({p},1e-12),1-1e-12)))"
irls("lr", "priced", [LOGIT("model_p"), LOGIT("market_p")])
cte("chron", "SELECT *, row_number() OVER (ORDER BY date, price_id)<=(SELECT floor(count(*)*0.7::DOUBLE) FROM priced) AS is_train FROM priced")
irls("cal", "chron", [LOGIT("model_p")], where="is_train")
irls("blend", "chron", [LOGIT("model_p"), LOGIT("market_p")], where="is_train")
cte("test_years", "SELECT year AS fold FROM (SELECT year, row_number() OVER (ORDER BY year) AS k, row_number() OVER (ORDER BY year DESC) AS b FROM (SELECT DISTINCT year FROM priced)) WHERE k>3 AND b<=5")
cte("folds", "SELECT p.*, t.fold, CASE WHEN p.year=t.fold THEN 'test' ELSE 'train' END AS role FROM priced p JOIN test_years t ON p.year<=t.fold")


def scored(p="p"):
    q = f"least(greatest({p},1e-12),1-1e-12)"
    return (f"count(*) AS n, {r(f'avg(CASE WHEN fav_won THEN -ln({q}) ELSE -ln(1-{q}) END)',6)} AS log_loss, {r(f'avg(({p}-fav_won::INT)*({p}-fav_won::INT))',6)} AS brier, "
            f"{r(f'avg((({p}>=0.5)=fav_won)::INT)',6)} AS accuracy")


cte("reigns", """
SELECT division||'#'||lpad((k+1)::VARCHAR,3,'0') AS reign_id, division, holder, (DATE '1995-01-01'+((k+1)*180)::INT)::DATE AS start,
 CASE WHEN k<max(k) OVER (PARTITION BY division) THEN (DATE '1995-01-01'+((k+1)*180+179)::INT)::DATE END AS "end", (k+1)%4=3 AS interim
FROM (SELECT division, k, arg_min(holder, (-w, holder)) AS holder FROM (SELECT division, date_diff('day', DATE '1995-01-01', date)//180 AS k, competitor AS holder, count(*) AS w
  FROM sides WHERE result='W' GROUP BY 1,2,3) GROUP BY 1,2)""")
cte("title_cands", f"""
SELECT *, (SELECT count(DISTINCT t2.holder) FROM tc0 t2 WHERE t2.contest_id=t.contest_id) AS holders FROM (SELECT *, bool_or(div_match) OVER (PARTITION BY contest_id) AS any_match FROM tc0) t
WHERE any_match OR (SELECT count(DISTINCT t2.holder) FROM tc0 t2 WHERE t2.contest_id=t.contest_id)>=2""")
cte("tc0", f"""
SELECT c.contest_id, c.date, c.division, c.c1, c.c2, c.result1, c.result2, r.holder, r.reign_id, r.division AS reign_division, r.start, r.interim,
 r.division=c.division AS div_match, r.start<c.date AS established
FROM contests c JOIN reigns r ON (r.holder=c.c1 OR r.holder=c.c2) AND c.date BETWEEN r.start-21 AND coalesce(r."end",{AS_OF})+21
WHERE c.contest_id%3<>0 OR c.contest_id%9=0""")
cte("titles", """
SELECT contest_id, date, reign_id, reign_division AS title_division, interim, holder AS champion, CASE WHEN holder=c1 THEN c2 ELSE c1 END AS challenger, winner FROM (
 SELECT *, row_number() OVER (PARTITION BY contest_id ORDER BY established DESC, CASE WHEN established THEN interim::INT ELSE 0 END, CASE WHEN established THEN start END DESC NULLS LAST,
  CASE WHEN NOT established THEN coalesce(holder=winner,false) END DESC NULLS LAST, reign_id) AS rn
 FROM (SELECT *, CASE WHEN result1='W' THEN c1 WHEN result2='W' THEN c2 END AS winner FROM title_cands WHERE div_match OR NOT any_match)) WHERE rn=1""")
cte("title_prices", f"""
SELECT t.contest_id, t.date, t.title_division, t.reign_id, t.champion, t.challenger, p.price_id, p.gap,
 CASE WHEN p.price_id IS NOT NULL THEN CASE WHEN {norm('p.favourite','title')}={norm('b.name','title')} THEN p.fav_odds ELSE p.dog_odds END END AS challenger_odds,
 CASE WHEN p.price_id IS NOT NULL THEN {norm('p.favourite','title')}<>{norm('b.name','title')} END AS challenger_is_underdog, p.outcome
FROM titles t JOIN roster a ON a.competitor=t.champion JOIN roster b ON b.competitor=t.challenger
LEFT JOIN (SELECT * FROM (SELECT t.contest_id, p.*, abs(date_diff('day',t.date,p.date))::INT AS gap, row_number() OVER (PARTITION BY t.contest_id ORDER BY abs(date_diff('day',t.date,p.date)), p.price_id) AS rn
  FROM titles t JOIN roster a ON a.competitor=t.champion JOIN roster b ON b.competitor=t.challenger JOIN prices p ON {pair('p.favourite','p.underdog','title')}={pair('a.name','b.name','title')})
  WHERE rn=1 AND gap<=45) p USING (contest_id)""")
cte("winners", """
SELECT price_id, date, division, both_established, CASE WHEN fav_won THEN fav_id ELSE dog_id END AS winner, CASE WHEN fav_won THEN dog_id ELSE fav_id END AS loser,
 CASE WHEN fav_won THEN model_p ELSE 1-model_p END AS model_winner, CASE WHEN fav_won THEN market_p ELSE 1-market_p END AS market_winner,
 CASE WHEN fav_won THEN fav_no ELSE dog_no END+1 AS winner_no, CASE WHEN fav_won THEN dog_no ELSE fav_no END+1 AS loser_no,
 CASE WHEN fav_won THEN fav_provisional ELSE dog_provisional END AS winner_provisional, CASE WHEN fav_won THEN dog_layoff ELSE fav_layoff END AS loser_layoff, fav_moved OR dog_moved AS moved FROM priced""")


def with_form(src):
    form = lambda who: f"coalesce((SELECT string_agg(result,'' ORDER BY seq DESC) FROM (SELECT s.result, s.seq FROM sides s WHERE s.competitor=x.{who} AND s.date<x.date ORDER BY s.seq DESC LIMIT 5)),'-') AS {who}_form"
    return f"SELECT x.*, {form('winner')}, {form('loser')} FROM ({src}) x"
