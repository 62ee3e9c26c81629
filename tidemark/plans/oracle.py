"""SQL building blocks for the DuckDB oracle: the derived tables of ``tracker`` as named CTEs."""

from __future__ import annotations

DAY = "86400e6::DOUBLE"


def days(a: str, b: str) -> str:
    return f"((epoch_us({a}) - epoch_us({b})) / {DAY})"


CTES: dict[str, tuple[list[str], str]] = {}


def cte(name: str, needs: list[str], sql: str) -> None:
    CTES[name] = (needs, sql)


def with_(*names: str) -> str:
    """WITH clause holding the named tables and what they need, in order."""
    done: list[str] = []

    def visit(n: str) -> None:
        if n in done:
            return
        for m in CTES[n][0]:
            visit(m)
        done.append(n)

    for n in names:
        visit(n)
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in done) + "\n"


cte("box", [], """
SELECT 'P'||(o_custkey%8) AS project, 'P'||(o_custkey%8)||'__'||o_orderkey AS sprint_id, o_orderkey AS k,
 CAST(o_orderkey AS BIGINT) AS raw_sprint_id, o_orderkey+500000 AS jira, lower('Box '||o_orderkey) AS name,
 CASE WHEN o_orderstatus<>'P' THEN 'CLOSED' WHEN o_orderkey%2=0 THEN 'FUTURE' ELSE 'ACTIVE' END AS sprint_state,
 o_orderdate AS start_date, o_orderdate + to_days(CAST(7+o_orderkey%8 AS INTEGER)) AS end_date,
 o_orderdate + to_days(CAST(7+o_orderkey%8+(o_orderkey*13%17-6) AS INTEGER)) AS complete_date,
 CAST(round(o_totalprice*100) AS BIGINT) AS cents FROM orders""")
cte("sp", ["box"], "SELECT * FROM box WHERE sprint_state='CLOSED' AND end_date>=start_date AND complete_date>=start_date")
cte("lines", [], """
SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS sp, count(*) FILTER (l_linestatus='F') AS done,
 sum(l_quantity) FILTER (l_linestatus='F') AS done_sp FROM lineitem GROUP BY 1""")
cte("lab", ["box", "lines"], f"""
SELECT *, CAST(late_days > 1 AS INTEGER) AS label_delay, CAST(not_completed > 0 AS INTEGER) AS label_spillover,
 greatest(CAST(late_days > 1 AS INTEGER), CAST(not_completed > 0 AS INTEGER)) AS at_risk,
 CASE WHEN committed>0 THEN completed/committed::DOUBLE END AS completion_ratio,
 CASE WHEN committed>0 THEN not_completed/committed::DOUBLE END AS carry_ratio,
 least(greatest(late_days,0.0),30.0) AS late_capped, committed>0 AS nonempty, greatest(end_date, complete_date) AS known
FROM (SELECT box.*, {days('complete_date', 'end_date')} AS late_days, {days('end_date', 'start_date')} AS len,
 coalesce(n,0) AS committed, coalesce(sp,0.0) AS points, coalesce(done,0) AS completed, coalesce(n,0)-coalesce(done,0) AS not_completed,
 coalesce(done_sp,0.0) AS delivered FROM box LEFT JOIN lines ON l_orderkey=k)""")
cte("trail", ["lab"], """
SELECT *, avg(delivered) OVER w3 AS t_sp, avg(coalesce(completion_ratio,1.0)) OVER w3 AS t_ratio,
 lag(not_completed) OVER w AS t_carry, lag(coalesce(completion_ratio,1.0)) OVER w AS t_last, row_number() OVER w > 1 AS has_prior
FROM lab WINDOW w AS (PARTITION BY project ORDER BY start_date, sprint_id),
 w3 AS (PARTITION BY project ORDER BY start_date, sprint_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)""")
cte("known3", ["lab"], """
SELECT * FROM (SELECT a.sprint_id AS sid, b.*, row_number() OVER (PARTITION BY a.sprint_id ORDER BY b.known DESC, b.start_date DESC, b.sprint_id DESC) AS rn
FROM lab a JOIN lab b ON a.project=b.project AND b.known<=a.start_date AND a.sprint_id<>b.sprint_id) WHERE rn<=3""")
cte("full3", ["lab"], """
SELECT * FROM (SELECT a.sprint_id AS sid, b.*, row_number() OVER (PARTITION BY a.sprint_id ORDER BY b.known DESC, b.start_date DESC, b.sprint_id DESC) AS rn
FROM lab a JOIN lab b ON a.project=b.project AND b.known<=a.start_date AND a.sprint_id<>b.sprint_id AND b.committed>0) WHERE rn<=3""")
cte("conc", ["lab"], """
SELECT a.sprint_id AS sid, count(b.sprint_id) AS n_conc FROM lab a LEFT JOIN lab b ON a.project=b.project AND b.sprint_id<>a.sprint_id
 AND b.start_date<a.start_date AND b.end_date>a.start_date GROUP BY 1""")
cte("hist", ["lab", "known3", "full3", "conc"], """
SELECT lab.*, n_conc, h_late, h_rate, coalesce(h_n,0) AS h_n, h_ratio, h_carry, h_sp, h_done, h_comm, CASE WHEN h_done IS NOT NULL THEN committed/greatest(h_done,1.0) END AS s2c
FROM lab JOIN conc ON conc.sid=sprint_id
LEFT JOIN (SELECT sid, avg(late_capped) AS h_late, avg(label_delay) AS h_rate FROM known3 GROUP BY 1) x ON x.sid=sprint_id
LEFT JOIN (SELECT sid, count(*) AS h_n, avg(completed/committed::DOUBLE) AS h_ratio, max(not_completed) FILTER (rn=1) AS h_carry,
 avg(delivered) AS h_sp, avg(completed) AS h_done, avg(committed) AS h_comm FROM full3 GROUP BY 1) y ON y.sid=sprint_id""")
# items and change log
cte("item", ["box"], """
SELECT l_orderkey||'-'||l_linenumber||'-'||l_partkey||'-'||l_suppkey||'-'||CAST(round(l_extendedprice*100) AS BIGINT) AS iid, 'K'||substr(project,2)||'-'||(l_orderkey*7+l_linenumber) AS issue_key,
 project, CASE WHEN l_linenumber<>6 THEN l_orderkey END AS raw, start_date + to_days(CAST(l_partkey%12-9 AS INTEGER)) AS created,
 CASE WHEN l_linestatus='F' THEN start_date + to_days(CAST(l_suppkey%23-2 AS INTEGER)) END AS resolved,
 CASE WHEN l_linenumber<>7 THEN l_quantity END AS points, CASE l_returnflag WHEN 'A' THEN 'Bug' WHEN 'N' THEN 'Story' ELSE 'Task' END AS issue_type,
 l_linestatus||'/'||l_returnflag AS status, 'S'||l_suppkey AS assignee, start_date AS bs, l_orderkey AS ok, l_linenumber AS ln, l_partkey AS part, l_suppkey AS supp, CAST(l_quantity AS BIGINT) AS qty
FROM lineitem JOIN box ON k=l_orderkey""")
cte("sev", ["item"], """
SELECT iid, project, 1 AS cid, bs + to_days(CAST(part%7-4 AS INTEGER)) + to_hours(ln) AS ts, NULL AS fv, (ok+500000)::VARCHAR AS tv, NULL AS fs, NULL AS tstr FROM item WHERE ln IN (1,4)
UNION ALL SELECT iid, project, 2, bs + to_days(CAST(supp%10 AS INTEGER)) + to_hours(2), (ok+500000)::VARCHAR, (ok+500000)||', '||(ok+500008), NULL, NULL FROM item WHERE ln IN (4,5)
UNION ALL SELECT iid, project, 5, bs + to_days(CAST(supp%10 AS INTEGER)) + to_hours(30), (ok+500000)||', '||(ok+500008), NULL, NULL,
 CASE WHEN part%2=0 THEN 'Box '||(ok+8) ELSE 'moved to Box '||ok END FROM item WHERE ln=5""")
cte("pev", ["item"], """
SELECT iid, 3 AS cid, bs + to_days(CAST(part%11-3 AS INTEGER)) AS ts, (qty-1)::DOUBLE AS bv, (qty+part%2)::DOUBLE AS av FROM item WHERE ln=2
UNION ALL SELECT iid, 4, bs + to_days(CAST(part%5 AS INTEGER)), (qty+2)::DOUBLE, NULL FROM item WHERE ln=3""")
# every membership cell of an item with the sprints it names
cte("cells", ["item", "sev"], """
SELECT DISTINCT project, v, s, raw FROM (
 SELECT project, fv AS v, fs AS s, NULL::BIGINT AS raw FROM sev UNION ALL SELECT project, tv, tstr, NULL FROM sev
 UNION ALL SELECT project, NULL, NULL, raw FROM item WHERE raw IS NOT NULL)""")
cte("toks", ["cells", "sp"], """
SELECT c.project, c.v, c.s, c.raw, sp.sprint_id, c.tok FROM (SELECT *, unnest(regexp_extract_all(v, '\\d+')) AS tok FROM cells WHERE v IS NOT NULL) c
 LEFT JOIN sp ON sp.project=c.project AND sp.jira::VARCHAR=c.tok
UNION ALL SELECT c.project, c.v, c.s, c.raw, sp.sprint_id, c.raw::VARCHAR FROM cells c LEFT JOIN sp ON sp.project=c.project AND sp.k=c.raw WHERE c.raw IS NOT NULL
UNION ALL SELECT c.project, c.v, c.s, c.raw, x.sprint_id, c.s FROM cells c LEFT JOIN
 (SELECT project, s, sprint_id FROM (SELECT c.project, c.s, sp.sprint_id, sp.name=lower(c.s) AS ex, max(CASE WHEN sp.name=lower(c.s) THEN 1 ELSE 0 END) OVER (PARTITION BY c.project, c.s) AS anyex
  FROM cells c JOIN sp ON sp.project=c.project AND contains(lower(c.s), sp.name) WHERE c.v IS NULL AND c.s IS NOT NULL) WHERE ex OR anyex=0) x
 ON x.project=c.project AND x.s=c.s WHERE c.v IS NULL AND c.s IS NOT NULL""")
# candidate (item, sprint) pairs: every sprint ever named by the item
cte("cand", ["toks", "sev", "item"], """
SELECT DISTINCT iid, sprint_id FROM (
 SELECT e.iid, t.sprint_id FROM sev e JOIN toks t ON t.project=e.project AND t.v IS NOT DISTINCT FROM e.fv AND t.s IS NOT DISTINCT FROM e.fs AND t.raw IS NULL
 UNION ALL SELECT e.iid, t.sprint_id FROM sev e JOIN toks t ON t.project=e.project AND t.v IS NOT DISTINCT FROM e.tv AND t.s IS NOT DISTINCT FROM e.tstr AND t.raw IS NULL
 UNION ALL SELECT i.iid, t.sprint_id FROM item i JOIN toks t ON t.project=i.project AND t.raw=i.raw WHERE i.iid NOT IN (SELECT iid FROM sev))
WHERE sprint_id IS NOT NULL""")
# membership state of a candidate at the start (f = 0) and at checkpoints: first later 'from', else last 'to', else static
def _state(points: str) -> str:
    return f"""
SELECT s.iid, s.sprint_id, s.f, s.t, t.sprint_id IS NOT NULL AS member, s.hist FROM (
 SELECT c.iid, c.sprint_id, p.f, p.t, i.project, count(e.iid) > 0 AS hist,
  CASE WHEN count(e.iid)=0 THEN {{'v': NULL::VARCHAR, 's': NULL::VARCHAR, 'r': any_value(i.raw)}}
   WHEN count(*) FILTER (e.ts>p.t) > 0 THEN arg_min({{'v': e.fv, 's': e.fs, 'r': NULL::BIGINT}}, epoch_us(e.ts)*10+e.cid) FILTER (e.ts>p.t)
   ELSE arg_max({{'v': e.tv, 's': e.tstr, 'r': NULL::BIGINT}}, epoch_us(e.ts)*10+e.cid) END AS st
 FROM cand c JOIN item i ON i.iid=c.iid JOIN sp ON sp.sprint_id=c.sprint_id CROSS JOIN LATERAL ({points}) p
 LEFT JOIN sev e ON e.iid=c.iid GROUP BY 1,2,3,4,5) s
LEFT JOIN (SELECT DISTINCT project, v, s, raw, sprint_id FROM toks) t ON t.project=s.project AND t.sprint_id=s.sprint_id
 AND t.v IS NOT DISTINCT FROM s.st.v AND t.raw IS NOT DISTINCT FROM s.st.r AND (t.v IS NOT NULL OR t.raw IS NOT NULL OR t.s IS NOT DISTINCT FROM s.st.s)"""


cte("state0", ["cand", "toks", "sev", "item", "sp"], _state("SELECT 0.0::DOUBLE AS f, sp.start_date AS t"))
cte("statek", ["cand", "toks", "sev", "item", "sp"], _state(
    "SELECT f, make_timestamp(CAST(floor(epoch_us(sp.start_date)+f*(epoch_us(sp.end_date)-epoch_us(sp.start_date))) AS BIGINT)) AS t FROM (VALUES (0.0::DOUBLE),(0.25),(0.5),(0.75),(1.0)) g(f)"))


def _points(state: str) -> str:
    return f"""
SELECT m.*, i.created, i.resolved, i.issue_type, sp.project, sp.start_date, sp.end_date, sp.complete_date, count(e.iid)>0 AS phist,
 CASE WHEN count(e.iid)=0 THEN any_value(i.points) WHEN count(*) FILTER (e.ts>m.t)>0 THEN (arg_min({{'v': e.bv}}, epoch_us(e.ts)*10+e.cid) FILTER (e.ts>m.t)).v
  ELSE (arg_max({{'v': e.av}}, epoch_us(e.ts)*10+e.cid)).v END AS sp_at
FROM {state} m JOIN item i ON i.iid=m.iid JOIN sp ON sp.sprint_id=m.sprint_id LEFT JOIN pev e ON e.iid=m.iid GROUP BY ALL"""


cte("members0", ["state0"], "SELECT * FROM state0 WHERE member")
cte("pts0", ["members0", "pev", "item", "sp"], _points("members0"))
cte("commit0", ["pts0"], """
SELECT *, coalesce(sp_at,0.0) AS pt, coalesce(resolved<=end_date, FALSE) AS done,
 CASE WHEN hist THEN 'observed_sprint_history' ELSE 'static_sprint_fallback' END AS ssrc, CASE WHEN phist THEN 'observed_story_history' ELSE 'static_story_fallback' END AS psrc
FROM pts0 WHERE (created IS NULL OR created<=start_date) AND (resolved IS NULL OR resolved>=start_date)""")
cte("ptsk", ["statek", "pev", "item", "sp"], _points("statek"))
cte("pairk", ["ptsk"], """
SELECT a.*, b.member AND b.created<=b.start_date AND (b.resolved IS NULL OR b.resolved>=b.start_date) AS in0, coalesce(b.sp_at,0.0) AS sp0, b.sp_at AS sp0_raw,
 a.member AND a.created<=a.t AS ink, coalesce(a.resolved<=a.t, FALSE) AS donek, a.resolved IS NULL OR a.resolved>=a.start_date AS open0
FROM ptsk a JOIN ptsk b ON a.iid=b.iid AND a.sprint_id=b.sprint_id AND b.f=0.0 WHERE a.f>0""")
cte("ckpt", ["pairk", "sp"], """
SELECT sp.sprint_id, sp.project, sp.start_date, sp.end_date, sp.complete_date, g.f AS checkpoint,
 make_timestamp(CAST(floor(epoch_us(sp.start_date)+g.f*(epoch_us(sp.end_date)-epoch_us(sp.start_date))) AS BIGINT)) AS checkpoint_time,
 count(*) FILTER (in0) AS committed_n, coalesce(sum(sp0) FILTER (in0),0.0) AS committed_sp, count(*) FILTER (in0 AND donek) AS done_n,
 coalesce(sum(sp0) FILTER (in0 AND donek),0.0) AS done_sp, count(*) FILTER (in0 AND NOT ink) AS removed_n,
 count(*) FILTER (NOT in0 AND ink AND open0) AS added_n, count(*) FILTER (NOT in0 AND ink AND open0 AND donek) AS added_done_n,
 coalesce(sum(coalesce(sp_at,0.0)) FILTER (in0),0.0) AS sp_now
FROM sp CROSS JOIN (VALUES (0.25::DOUBLE),(0.5),(0.75),(1.0)) g(f) LEFT JOIN pairk p ON p.sprint_id=sp.sprint_id AND p.f=g.f GROUP BY ALL""")
# scored boxes and replay points
cte("scored", ["lab"], """
SELECT *, label_delay AS y, (cents%1000)/1000.0::DOUBLE AS score, (k*7919%997)/997.0::DOUBLE AS score_b,
 CAST((cents%1000)/1000.0::DOUBLE>=0.5 AS INTEGER) AS pred, CAST((k*7919%997)/997.0::DOUBLE>=0.5 AS INTEGER) AS pred_b FROM lab""")
_runs = ", ".join(
    f"((k*31+{r*17}+c*7)%100)/100.0::DOUBLE AS L{r}_p, CAST(((k*31+{r*17}+c*7)%100)/100.0::DOUBLE>=0.5 AS INTEGER) AS L{r}_warn, ((k*3+{r}+c)%11)/10.0::DOUBLE AS L{r}_unf, "
    f"((cents+k*{r*13}+c*11)%100)/100.0::DOUBLE AS G{r}_p, CAST(((cents+k*{r*13}+c*11)%100)/100.0::DOUBLE>=0.5 AS INTEGER) AS G{r}_warn, ((k*5+{2*r}+c)%11)/10.0::DOUBLE AS G{r}_unf"
    for r in (1, 2, 3))
cte("study", ["lab"], f"""
SELECT sprint_id, project, k, start_date, c/10.0::DOUBLE AS checkpoint, label_delay AS late, carry_ratio AS unfinished, 1+CAST(substr(project,2,1) AS INTEGER)/8.0::DOUBLE AS weight,
 ((cents+c*137)%700+300*label_delay)/1000.0::DOUBLE AS m_score, 0.55::DOUBLE AS m_threshold, ((k*7+c)%11)/10.0::DOUBLE AS m_unf, CAST((k+c)%3=0 AS INTEGER) AS rule_warn,
 CAST(((cents+c*137)%700+300*label_delay)/1000.0::DOUBLE>=0.55::DOUBLE AS INTEGER) AS m_warn, {_runs}
FROM lab, (VALUES (0),(5)) v(c) WHERE nonempty""")
cte("docs", [], "SELECT d.doc_id, lang, n_chars, quality, toxic, (n_chars%100)/100.0::DOUBLE AS p, CAST(n_chars>=1000 AS INTEGER) AS call FROM documents d JOIN labels USING (doc_id)")


def draw(n: str, *parts: str) -> str:
    """The hash draw: first fifteen hex digits of the md5 of the joined parts."""
    return f"(('0x'||substr(md5({' || chr(124) || '.join(parts)}),1,15))::BIGINT % {n})"


def hash_of(*parts: str) -> str:
    return f"(('0x'||substr(md5({' || chr(124) || '.join(parts)}),1,15))::BIGINT)"


def auc(label: str, score: str) -> str:
    """AUC as an aggregate over a subquery that carries mid-ranks ``rk`` (average rank of the score)."""
    return (f"CASE WHEN count(*) FILTER ({label}=1)>0 AND count(*) FILTER ({label}=0)>0 THEN (sum(rk) FILTER ({label}=1) - count(*) FILTER ({label}=1)*(count(*) FILTER ({label}=1)+1)/2.0::DOUBLE)"
            f" / (count(*) FILTER ({label}=1)::DOUBLE*count(*) FILTER ({label}=0)) END")


def mid_rank(score: str, part: str = "") -> str:
    by = f"PARTITION BY {part}" if part else ""
    same = f"PARTITION BY {part + ', ' if part else ''}{score}"
    return f"(rank() OVER ({by} ORDER BY {score}) + (count(*) OVER ({same})-1)/2.0::DOUBLE)"
