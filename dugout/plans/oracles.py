"""The same answers in DuckDB SQL.

Written from the rules, not from the Spark code: play-by-play sentences are recognised by the number
that produced them instead of by pattern, and running state uses plain per-game windows.
"""

from __future__ import annotations

from dugout.model import (
    BATTER_CATEGORIES, BATTER_COUNTERS, BATTER_WEIGHTS as BW, BOARD_BATTER_GROUPS, FIELD_COUNTERS,
    FIELD_POSITIONS, DH, PITCHER_CATEGORIES_RELIEVER, PITCHER_CATEGORIES_SHARED,
    PITCHER_CATEGORIES_STARTER, PITCHER_COUNTERS, PITCHER_WEIGHTS as PW, ROSTER_FIELD_SLOTS, TEAMS,
)
from dugout.plans import bindings as b
from dugout.plans.queries import NOW, WINDOW_DAYS, WINDOW_END


def lit(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def pick(values, index: str) -> str:
    return f"{lit(values)}[CAST((({index}) % {len(values)}) + 1 AS INT)]"


def q(name: str) -> str:
    return f'"{name}"'


# --- box score ------------------------------------------------------------------------------

LINE_BATTERS = f"""
lb AS MATERIALIZED (
  SELECT row_number() OVER () rid, CAST(l_orderkey AS VARCHAR) game_id, l_partkey part, l_linenumber line, l_suppkey supp,
    CASE WHEN l_linestatus='F' THEN 'home' ELSE 'away' END side, l_partkey*8+l_linenumber pos_idx,
    CAST(l_suppkey AS VARCHAR) player_code, 'P'||l_suppkey "name", l_partkey%9<>0 live,
    CASE WHEN l_partkey%9<>0 THEN {pick(b.POS_STRINGS, 'l_partkey')} ELSE '' END pos,
    l_returnflag='R' AND l_partkey%9<>0 subst,
    CASE WHEN l_partkey%9<>0 THEN CAST(l_quantity AS BIGINT)%5 ELSE 0 END ab,
    CASE WHEN l_partkey%9<>0 THEN l_partkey%4 ELSE 0 END hit,
    CASE WHEN l_partkey%9<>0 THEN l_suppkey%3 ELSE 0 END run,
    CASE WHEN l_partkey%9<>0 THEN l_linenumber%3 ELSE 0 END rbi,
    CASE WHEN l_partkey%9<>0 AND l_partkey%11=0 THEN 1 ELSE 0 END hr,
    CASE WHEN l_partkey%9<>0 THEN (l_partkey+l_linenumber)%3 ELSE 0 END bb,
    CASE WHEN l_partkey%9<>0 THEN (l_suppkey+l_linenumber)%4 ELSE 0 END kk,
    CASE WHEN l_partkey%9<>0 AND l_partkey%13=0 THEN 1 ELSE 0 END sb,
    list_filter([
      {pick(b.PLATE_CODES, 'l_partkey')} || CASE WHEN l_partkey%7=0 THEN '/'||{pick(b.PLATE_CODES, 'l_partkey*7+l_linenumber')} ELSE '' END,
      CASE WHEN l_linenumber%3<>0 THEN {pick(b.PLATE_CODES, 'l_suppkey+l_linenumber')} END,
      CASE WHEN l_quantity>40 THEN '' ELSE {pick(b.PLATE_CODES, 'l_orderkey+l_suppkey')} END,
      CASE WHEN l_linenumber%2=0 THEN {pick(b.PLATE_CODES, '14+l_partkey%4')} END
    ], lambda x: x IS NOT NULL AND x<>'') slots
  FROM lineitem)
"""
# Class of every code of the list, by hand.
CODE_CLASS = {
    "삼진": "K", "4구": "BB", "사구": "HBP", "유병": "GDP", "유땅": "GO", "투희땅": "SACBUNT",
    "투희번": "SACBUNT", "1번": "BUNT_OUT", "중희비": "SACFLY", "좌파": "FO", "우비": "FO", "3직": "LD",
    "2실": "REACH_ERROR", "좌중홈": "HR", "2안": "1B", "좌중2": "2B", "우3": "3B", "xx": "1B",
    "좌안": "1B", "중비": "FO",
}
CLASS_CASE = "CASE code " + " ".join(f"WHEN '{c}' THEN '{k}'" for c, k in CODE_CLASS.items()) + " END"
LINE_CODES = f"""{LINE_BATTERS},
lc AS (SELECT lb.* EXCLUDE (slots), s.slot, unnest(string_split(s.slot,'/')) code
  FROM lb, unnest(lb.slots) s(slot)),
lk AS (SELECT *, {CLASS_CASE} cls FROM lc)
"""


def cnt(*classes: str) -> str:
    inside = ", ".join(f"'{c}'" for c in classes)
    return f"count(cls) FILTER (WHERE cls IN ({inside}))"


LINE_COUNTED = f"""{LINE_CODES},
agg AS (SELECT rid, {cnt('1B')} s1, {cnt('2B')} s2, {cnt('3B')} s3,
    {cnt('FO', 'SACFLY')} fo, {cnt('GO', 'SACBUNT', 'GDP')} go_, {cnt('LD')} ld, {cnt('GDP')} gdp,
    {cnt('SACFLY')} sacfly, {cnt('SACBUNT')} sacbunt, {cnt('HBP')} hbp
  FROM lk GROUP BY ALL),
bat AS (SELECT lb.rid, lb.game_id, lb.part, lb.line, lb.supp, lb.name, run "R", hit "H", bb "BB", s2 "2B", s3 "3B", hr "HR",
    rbi "RBI", fo "FO", go_ "GO", ld "LD", gdp "GDP", sacfly "SACFLY", sacbunt "SACBUNT", sb "SB", 0 "CS",
    hbp "HBP", kk "K", 0 "PICKOFF", CAST(s1>0 AND s2>0 AND s3>0 AND hr>0 AS INT) "CYCLE", 0 "GRANDSLAM", 0 "E",
    0 "ASSIST", 0 "OF_ASSIST", 0 "DP_FIELD", 0 "TP_FIELD", 0 "CS_CATCHER", 0 "SB_ALLOWED_CATCHER", 0 "ADVANCE_OUT"
  FROM lb JOIN agg USING (rid)
  WHERE ab+hit+bb+run+rbi+hr+sb+kk>0 OR subst OR trim(pos)<>'')
"""
BAT_LP = " + ".join(f'least({q(k)},1)*{w}' if k in ("CYCLE", "DP_FIELD", "TP_FIELD") else f"{q(k)}*{w}" for k, w in BW.items())
_flags = {"QSPLUS", "QS", "PERFECT", "NOHIT", "SHO", "CG"}
PIT_LP = " + ".join(f"{q(k)}*{w}" for k, w in PW.items() if k not in _flags) + (
    f' + CASE WHEN "QSPLUS">0 THEN {PW["QSPLUS"]} WHEN "QS">0 THEN {PW["QS"]} ELSE 0 END'
    f' + CASE WHEN "PERFECT">0 THEN {PW["PERFECT"]} WHEN "NOHIT">0 THEN {PW["NOHIT"]} ELSE 0 END'
    f' + CASE WHEN "SHO">0 THEN {PW["SHO"]} WHEN "CG">0 THEN {PW["CG"]} ELSE 0 END'
)
OUTS_BY_TEXT = {"5 ⅔": 17, "⅓": 1, "6": 18, "": 0, "4.4": 13, "abc": 0, "7": 21, "6 ⅓": 19, "8": 24, "9": 27}
OUTS_BY_TEXT_B = {"6.2": 20, "6": 18, "": 0, "0.1": 1, "7.0": 21, "9": 27}


def outs_case(column: str, values: dict) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{t}' THEN {n}" for t, n in values.items()) + " END"


def line_pitchers(second: bool) -> str:
    texts, outs = (b.INNING_TEXTS_B, OUTS_BY_TEXT_B) if second else (b.INNING_TEXTS, OUTS_BY_TEXT)
    perfect = "bb=0" if second else "bbhp=0"
    limit = 3 if second else 2
    team = (
        "SELECT game_id, side, sum(o) team_outs FROM lp0 GROUP BY ALL" if second else
        "SELECT game_id, side, 3*max(CASE WHEN regexp_full_match(inn,'[0-9]') THEN CAST(inn AS INT) ELSE 0 END) team_outs FROM lp0 GROUP BY ALL"
    )
    hbp = "0" if second else "greatest(bbhp-bb,0)"
    appeared = "" if second else "WHERE o>0 OR hit+er+hr+bb+bbhp+kk<>0 OR hit<>0 OR bbhp<>0 OR wls<>''"
    return f"""
lp0 AS (SELECT CAST(l_orderkey AS VARCHAR) game_id, CASE WHEN l_linestatus='F' THEN 'home' ELSE 'away' END side,
    l_linenumber-1 pos_idx, 'P'||l_suppkey "name", {pick(texts, 'l_partkey+l_linenumber')} inn,
    l_partkey%5 hit, l_partkey%3 r, (l_partkey+l_suppkey)%5 er, CAST(l_partkey%17=0 AS INT) hr, l_suppkey%3 bb,
    l_suppkey%3 + l_partkey%2 - CAST(l_partkey%10=0 AS INT) bbhp, l_partkey%8 kk,
    {pick(b.DECISIONS, 'l_partkey+l_suppkey')} wls, {outs_case('inn', outs)} o FROM lineitem),
team AS ({team}),
lp1 AS (SELECT lp0.*, pos_idx=0 st,
    coalesce(pos_idx=0 AND o>0 AND o=team_outs AND o_orderstatus='F', false) cg
  FROM lp0 LEFT JOIN team USING (game_id, side) LEFT JOIN orders ON CAST(o_orderkey AS VARCHAR)=game_id {appeared}),
pit AS (SELECT game_id, side, pos_idx, "name", CASE WHEN st THEN '선발' ELSE '구원' END "role", o "OUT", hit "H", er "ER",
    hr "HR", bb "BB", {hbp} "HBP", kk "K", 0 "WP", 0 "BK", 0 "2B_A", 0 "3B_A", 0 "INHERITED_SCORED",
    0 "INHERITED_STRANDED", 0 "CS_A", 0 "SB_ALLOWED", 0 "PICKOFF_A", 0 "SAVE_OPP",
    CAST(st AND o>=18 AND er<=3 AND NOT (o>=21 AND er<={limit}) AS INT) "QS",
    CAST(st AND o>=21 AND er<={limit} AS INT) "QSPLUS", CAST(cg AS INT) "CG", CAST(cg AND r=0 AS INT) "SHO",
    CAST(cg AND hit=0 AS INT) "NOHIT", CAST(cg AND hit=0 AND {perfect} AS INT) "PERFECT",
    CAST(wls='홀' AS INT) "HOLD", CAST(wls='세' AS INT) "SAVE", CAST(wls='블' AS INT) "BLOWN", inn FROM lp1)
"""


LINE_RECORDS = f"""
rec AS (SELECT CAST(l_orderkey AS VARCHAR) game_id, l_partkey*8+l_linenumber idx, l_suppkey supp,
    {pick(b.RECORD_WORDS, 'l_partkey')} how, {pick(b.PLAYER_NAMES, 'l_suppkey')} n1, {pick(b.PLAYER_NAMES, 'l_partkey')} n2,
    l_linenumber line, l_partkey part FROM lineitem),
men AS (
  SELECT game_id, how, n1 "name", line inn FROM rec WHERE how NOT IN ('홈런','기타')
  UNION ALL SELECT game_id, how, n2, 1+part%9 FROM rec WHERE how NOT IN ('홈런','기타')
  UNION ALL SELECT game_id, how, n1, NULL FROM rec WHERE how='홈런' AND (CASE WHEN line%2=0 THEN supp%4=3 ELSE part%4=3 END)
  UNION ALL SELECT game_id, how, n2, NULL FROM rec WHERE how='홈런' AND line%2<>0 AND supp%4=3)
"""
# A record with one player reads the same both ways; with two, the single reading takes the first
# run count of the text and everything after it as the opponent.
GRAND_SLAMS = f"""WITH {LINE_RECORDS},
both_ AS (SELECT game_id||'-'||supp game_id, idx,
    CASE WHEN line%2=0 THEN CASE WHEN supp%4=3 THEN [n1] ELSE [] END
         ELSE CASE WHEN part%4=3 THEN [n1] ELSE [] END END old_names,
    list_sort(list_distinct(CASE WHEN line%2=0 THEN CASE WHEN supp%4=3 THEN [n1] ELSE [] END
         ELSE list_concat(CASE WHEN part%4=3 THEN [n1] ELSE [] END, CASE WHEN supp%4=3 THEN [n2] ELSE [] END) END)) new_names
  FROM rec WHERE how='홈런')
SELECT game_id, idx, array_to_string(old_names,',') old_names, array_to_string(new_names,',') new_names
FROM both_ WHERE old_names<>new_names"""

# --- positions ------------------------------------------------------------------------------

LETTER_POS = {"유": "유격수", "좌": "좌익수", "중": "중견수", "포": "포수", "一": "1루수", "二": "2루수", "三": "3루수", "우": "우익수"}
ORDER_GAMES = f"""
og AS (SELECT CAST(o_orderkey AS VARCHAR) game_id, o_orderkey game_seq, o_custkey cust, CAST(o_orderdate AS DATE) game_date,
    CASE WHEN o_orderstatus='F' THEN 'RESULT' WHEN o_orderstatus='O' THEN CASE WHEN o_custkey%2=0 THEN 'BEFORE' ELSE 'READY' END
         ELSE 'STARTED' END status_code, o_custkey%17=0 cancel,
    CAST(o_orderdate AS DATE) + to_hours(13+o_custkey%6) + INTERVAL 30 MINUTE - INTERVAL 9 HOUR start_utc,
    {pick(b.TEAM_CODES, 'o_custkey')} home_code, {pick(b.TEAM_CODES, 'o_custkey+3')} away_code,
    {pick(TEAMS, 'o_custkey')} home_name, {pick(TEAMS, 'o_custkey+3')} away_name, {pick(b.ROUNDS, 'o_orderkey')} round
  FROM orders)
"""
POSITION_TABLE = f"""{LINE_BATTERS},{ORDER_GAMES},
tm AS (SELECT CAST(l_orderkey AS VARCHAR) game_id, CASE WHEN l_linestatus='F' THEN 'home' ELSE 'away' END side,
    max(CASE WHEN regexp_full_match(t,'[0-9]') THEN CAST(t AS INT) ELSE 0 END) di
  FROM (SELECT *, {pick(b.INNING_TEXTS, 'l_partkey+l_linenumber')} t FROM lineitem) GROUP BY ALL),
pw AS (SELECT lb.player_code, lb.name, CASE WHEN side='home' THEN home_name ELSE away_name END team, di,
    list_filter(string_split(pos,''), lambda c: c IN ({", ".join(f"'{c}'" for c in LETTER_POS)})) chars,
    row_number() OVER (PARTITION BY lb.player_code ORDER BY og.game_date DESC, og.game_seq, lb.game_id,
       CASE WHEN side='home' THEN 0 ELSE 1 END, pos_idx) ord
  FROM lb JOIN og USING (game_id) JOIN tm USING (game_id, side)
  WHERE og.status_code='RESULT' AND og.game_date BETWEEN DATE '{WINDOW_END}' - {WINDOW_DAYS - 1} AND DATE '{WINDOW_END}'),
ps AS (SELECT player_code, ord, c.i char_no, {"CASE chars[c.i] " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LETTER_POS.items()) + " END"} position,
    di/len(chars) share FROM pw, unnest(range(1, len(chars)+1)) c(i)),
pp AS (SELECT player_code, position, round(sum(share),9) innings, min(ord*10+char_no) seen FROM ps GROUP BY ALL),
bestp AS (SELECT player_code, position FROM pp QUALIFY row_number() OVER (PARTITION BY player_code ORDER BY innings DESC, seen)=1),
pt AS (SELECT pw.player_code, arg_min(pw.name, ord) "name", arg_max(team, ord) team, count(*) games,
    count(*) FILTER (len(chars)=0) dh_games FROM pw GROUP BY 1),
ptab AS (SELECT pt.*, coalesce(bestp.position, CASE WHEN dh_games>0 THEN '지명타자' ELSE '미상' END) auto_position,
    (SELECT count(*) FROM pp WHERE pp.player_code=pt.player_code) positions FROM pt LEFT JOIN bestp USING (player_code))
"""
PREVIOUS = f"""
prev AS (SELECT CAST(c_custkey AS VARCHAR) player_code, 'P'||c_custkey "name", {pick(TEAMS, 'c_custkey')} team, '미상' auto_position,
    CASE WHEN c_custkey%4=0 THEN {pick(b.BOARD_POSITIONS, 'c_custkey')} END manual_position FROM customer)
"""
REQUESTS = f"""
req AS (SELECT CAST(s_suppkey*40 AS VARCHAR) player_code, {pick(('좌익수', '', DH), 's_suppkey')} new_position FROM supplier)
"""
COSTS = f"""
raw AS (SELECT CASE WHEN p_size%3=0 THEN NULL ELSE {pick(TEAMS, 'p_size')} END team,
    CASE WHEN p_partkey%13=0 THEN 'XX' ELSE {pick(b.COST_CODES, 'p_partkey')} END code, 'N'||(p_partkey*p_partkey%3001) "name",
    CASE WHEN p_partkey%17=0 THEN NULL ELSE 1+p_size%5 END cost FROM part),
cl AS (SELECT team, "name", cost, CASE code WHEN '1B' THEN '1루수' WHEN '2B' THEN '2루수' WHEN '3B' THEN '3루수' WHEN 'SS' THEN '유격수'
    WHEN 'C' THEN '포수' WHEN 'LF' THEN '좌익수' WHEN 'CF' THEN '중견수' WHEN 'RF' THEN '우익수' WHEN 'DH' THEN '지명타자' ELSE code END position
  FROM raw WHERE cost IS NOT NULL AND code<>'XX'),
rows_ AS (SELECT 'N'||(l_partkey%3001) "name", {pick(TEAMS, 'l_suppkey')} team, {pick((*FIELD_POSITIONS, DH), 'l_linenumber')} position, count(*) n
  FROM lineitem GROUP BY ALL),
bc AS (SELECT * FROM cl WHERE position NOT IN ('SP','P')), pc AS (SELECT * FROM cl WHERE position IN ('SP','P')),
looked AS (SELECT 'batter' kind, r.*,
    CASE WHEN (SELECT count(*) FROM bc WHERE bc.name=r.name AND bc.position=r.position)=1 THEN (SELECT max(cost) FROM bc WHERE bc.name=r.name AND bc.position=r.position)
         WHEN (SELECT count(*) FROM bc WHERE bc.name=r.name AND bc.position=r.position)>1 THEN
           (SELECT CASE WHEN count(*)=1 THEN max(cost) END FROM bc WHERE bc.name=r.name AND bc.position=r.position AND bc.team=r.team)
         WHEN (SELECT count(*) FROM bc WHERE bc.name=r.name)=1 THEN (SELECT max(cost) FROM bc WHERE bc.name=r.name)
         ELSE (SELECT CASE WHEN count(*)=1 THEN max(cost) END FROM bc WHERE bc.name=r.name AND bc.team=r.team) END cost FROM rows_ r
  UNION ALL
  SELECT 'pitcher', r.*,
    CASE WHEN (SELECT count(*) FROM pc WHERE pc.name=r.name)=1 THEN (SELECT max(cost) FROM pc WHERE pc.name=r.name)
         ELSE (SELECT CASE WHEN count(*)=1 THEN max(cost) END FROM pc WHERE pc.name=r.name AND pc.team=r.team) END FROM rows_ r)
"""

# --- play-by-play ---------------------------------------------------------------------------

N = len(b.SENTENCES)
MARK, SUBS, STEALS, RUNS = "0", "1,2,3,4", "5,6", "7,8,36"
PLAYS = "16,17,18,19,20,21,22,23,24,25,26,27,28,29,30,31,32,33,34,38"
CLASS_OF = {
    16: "1B", 17: "2B", 18: "3B", 19: "HR", 20: "BB", 21: "BB", 22: "HBP", 23: "K", 24: "K", 25: "GDP",
    26: "SACFLY", 27: "SACBUNT", 28: "GO", 29: "LD", 30: "FO", 32: "GO", 34: "GO",
}
TAGS = {
    "HR": ["H", "HR"], "3B": ["H", "3B"], "2B": ["H", "2B"], "1B": ["H"], "HBP": ["HBP"], "BB": ["BB"],
    "K": ["K"], "GDP": ["GDP", "GO"], "SACFLY": ["SACFLY", "FO"], "SACBUNT": ["GO", "SACBUNT"], "GO": ["GO"],
    "LD": ["LD"], "FO": ["FO"],
}
CHAINS = {
    10: ["포수", "2루수"], 13: ["유격수", "2루수"], 14: ["중견수", "포수"], 15: ["2루수"],
    25: ["유격수", "2루수", "1루수"], 26: ["중견수", "포수"], 27: ["투수", "1루수"], 28: ["유격수", "1루수"],
    31: ["포수", "1루수"], 34: ["3루수", "2루수", "1루수"],
}
RUNNER_OUT = (13, 14, 15)
EV = f"""
ev0 AS (SELECT CAST(user_id AS VARCHAR) game_id, user_id, event_id, ts, CAST(json_extract_string(props,'$.k') AS BIGINT) k,
    event_id//400 no, event_id sub, (event_id//1200)%9+1 inn, CAST((event_id//400)%2 AS VARCHAR) half FROM events),
ev AS (SELECT *, (event_id*7+k*11)%{N} t, CASE WHEN half='0' THEN 'V' ELSE 'H' END bs, CASE WHEN half='0' THEN 'H' ELSE 'V' END fs,
    event_id//700 hs, event_id//900+k%5 as_,
    [CAST(k%10 AS VARCHAR), CAST(k//10 AS VARCHAR), CAST((k*7+3)%10 AS VARCHAR)] base FROM ev0),
rl AS (SELECT *, bs||(k%9+1) bat, bs||((k//9)%9+1) run, fs||(k%9+1) fin, fs||'P'||(k%4) pin,
    CASE t {" ".join(f"WHEN {t} THEN '{c}'" for t, c in CLASS_OF.items())} END cls0,
    CASE WHEN t IN ({PLAYS}) THEN regexp_replace({lit(b.SENTENCES)}[CAST(t+1 AS INT)], '^\\S+ : ', '') END descr FROM ev),
grp AS (SELECT game_id, no, count(*) FILTER (t IN (7,36)) homes, bool_or(t=25) dbl, bool_or(t=34) tpl,
    max(sub%3)>min(sub%3) rose, coalesce(arg_min(t IN (23,24,25,26,27,28,30,31,32,34), sub) FILTER (t IN ({PLAYS})), false) bout,
    bool_or(t IN (7,9,36)) adv, arg_min(bat, sub) FILTER (t IN (27,28,32)) prod FROM rl GROUP BY ALL),
rg AS (SELECT rl.*, homes, dbl, tpl, rose, bout, CASE WHEN t=32 AND NOT rose THEN NULL ELSE cls0 END cls FROM rl JOIN grp USING (game_id, no))
"""
START = """
subbed AS (SELECT DISTINCT game_id, CASE WHEN t=1 THEN pin ELSE fin END nm FROM rl WHERE t IN (1,2,3,4)),
sd0 AS (SELECT DISTINCT game_id, CASE WHEN half='0' THEN '1' ELSE '0' END h, k%9 n, bat nm FROM rl),
sd AS (SELECT game_id, h, """ + ", ".join(f"max(nm) FILTER (n={i}) d{i}" for i in range(8)) + """
  FROM sd0 ANTI JOIN subbed USING (game_id, nm) GROUP BY ALL),
sp AS (SELECT DISTINCT game_id, half h, fs||'P0' p0 FROM rl WHERE k%4=0)
"""
DPOS = ["1루수", "2루수", "3루수", "유격수", "좌익수", "중견수", "우익수", "포수"]
_IN = {"유격수": 2, "포수": 3, "2루수": 4}


def _at(i: int, position: str) -> str:
    if position in _IN:
        return f"coalesce(last_value(CASE WHEN t={_IN[position]} THEN fin END IGNORE NULLS) OVER w, d{i}) f{i}"
    return f"d{i} f{i}"


STATE = f"""{EV},{START},
dup AS (SELECT *, half h FROM rg WHERE t<>0 UNION ALL SELECT *, '0' FROM rg WHERE t=0 UNION ALL SELECT *, '1' FROM rg WHERE t=0),
st AS (SELECT dup.*, coalesce(last_value(CASE WHEN t=1 THEN pin END IGNORE NULLS) OVER w, p0) pit,
    {", ".join(_at(i, p) for i, p in enumerate(DPOS))},
    coalesce(lag(CASE WHEN t=0 THEN ['0','0','0'] ELSE base END) OVER w, ['0','0','0']) pb,
    count(*) FILTER (t=0) OVER w epoch,
    CASE t WHEN 6 THEN 3 WHEN 7 THEN 3 WHEN 8 THEN 2 WHEN 36 THEN 1 END fb
  FROM dup LEFT JOIN sd USING (game_id, h) LEFT JOIN sp USING (game_id, h)
  WINDOW w AS (PARTITION BY game_id, h ORDER BY sub)),
ss AS (SELECT *, pb[fb] slot FROM st)
"""


def fielder(position: str) -> str:
    return f"f{DPOS.index(position)}" if position in DPOS else "NULL"


def _credit(cond: str, name: str, role: str, text: str, tag: str, points: str, n: str = "1", pos: str = "''") -> str:
    return (
        f"SELECT game_id, {name} nm, '{role}' rl, no, sub, inn, {text} txt, {tag} tag, {n} n, {points} pts, {pos} pos "
        f"FROM ss WHERE {cond} AND {name} IS NOT NULL"
    )


def _credits() -> str:
    s = lambda v: "'" + v + "'"
    out = []
    # steals
    allowed = "'도루 허용 ('||run||')'"
    out += [
        _credit("t IN (5,6)", "run", "bat", s("도루 성공"), s("SB"), "30"),
        _credit("t IN (5,6)", "f7", "bat", allowed, s("SB_ALLOWED_CATCHER"), "-10", pos=s("포수")),
        _credit("t IN (5,6)", "pit", "pitch", allowed, s("SB_ALLOWED"), "-10"),
        _credit("t IN (6,7,8,36)", "run", "bat", s("득점"), s("R"), "15"),
    ]
    stopped = "'도루 저지 ('||run||')'"
    out += [
        _credit("t=10", "run", "bat", s("도루 실패(아웃)"), s("CS"), "-15"),
        _credit("t=10", "f7", "bat", stopped, s("CS_CATCHER"), "40", pos=s("포수")),
        _credit("t=10", "pit", "pitch", stopped, s("CS_A"), "10"),
        _credit("t=10", "pit", "pitch", "'아웃카운트 1개 ('||run||' 도루 저지)'", s("OUT"), "10"),
        _credit("t IN (11,12)", "run", "bat", s("견제사(아웃)"), s("PICKOFF"), "-10"),
        _credit("t IN (11,12)", "pit", "pitch", "'아웃카운트 1개 ('||run||' 견제사)'", s("OUT"), "10"),
        _credit("t=11", "pit", "pitch", "'견제사 ('||run||')'", s("PICKOFF_A"), "10"),
    ]
    # runners put out on base
    for t in RUNNER_OUT:
        chain = CHAINS[t]
        for p in chain:
            if p in DPOS:
                out.append(_credit(f"t={t} AND dbl", fielder(p), "bat", s(f"병살 가담 ({p}, 주자 아웃)"), s("DP_FIELD"), "10", pos=s(p)))
                out.append(_credit(f"t={t} AND tpl", fielder(p), "bat", s(f"삼중살 가담 ({p}, 주자 아웃)"), s("TP_FIELD"), "50", pos=s(p)))
        p = chain[-2] if len(chain) > 1 else chain[0]
        tag, pts = ("OF_ASSIST", 30) if p in ("좌익수", "중견수", "우익수") else ("ASSIST", 1)
        out.append(_credit(f"t={t} AND NOT dbl AND NOT tpl", fielder(p), "bat", s(f"보살 ({p}, 주자 아웃)"), s(tag), str(pts), pos=s(p)))
        out.append(_credit(f"t={t} AND NOT dbl AND NOT tpl AND NOT bout", "pit", "pitch", s("아웃카운트 1개 (주자 아웃)"), s("OUT"), "10"))
    # plays
    against = lambda cond, word, tag: _credit(cond, "pit", "pitch", f"'{word} ('||bat||')'", s(tag), str(PW[tag]))
    out += [against("t=17", "피2루타", "2B_A"), against("t=18", "피3루타", "3B_A")]
    points = "CASE cls " + " ".join(f"WHEN '{c}' THEN {sum(BW.get(x, 0) for x in tags)}" for c, tags in TAGS.items()) + " END"
    out += [
        _credit("cls IS NOT NULL", "bat", "bat", "descr", "'PLAY:'||cls", points),
        _credit("t=31", "bat", "bat", "descr", s("PLAY:BUNT_OUT"), "0"),
        _credit("t=19", "bat", "bat", s("득점 (홈런)"), s("R"), "15"),
    ]
    rbi = "(CASE WHEN t IN (25,34) THEN 0 ELSE homes END + CASE WHEN t=19 THEN 1 ELSE 0 END)"
    out.append(_credit(f"(cls IS NOT NULL OR t=31) AND {rbi}>0", "bat", "bat", f"'타점 '||{rbi}||'개'", s("RBI"), f"25*{rbi}", n=rbi))
    out += [
        against("cls IN ('1B','2B','3B','HR')", "피안타", "H"), against("cls='HR'", "피홈런", "HR"),
        against("cls='BB'", "볼넷 허용", "BB"), against("cls='HBP'", "사구 허용", "HBP"), against("cls='K'", "탈삼진", "K"),
    ]
    outs = "(CASE WHEN t=31 THEN 1 WHEN cls='GDP' THEN 2 WHEN cls IN ('K','SACFLY','FO','SACBUNT','GO','LD') THEN 1 ELSE 0 END)"
    out.append(_credit(f"{outs}>0", "pit", "pitch", f"'아웃카운트 '||{outs}||'개 ('||bat||')'", s("OUT"), f"10*{outs}", n=outs))
    for t in (26, 27, 28):
        p = CHAINS[t][-2]
        tag, pts = ("OF_ASSIST", 30) if p == "중견수" else ("ASSIST", 1)
        out.append(_credit(f"t={t}", fielder(p), "bat", f"'보살 ({p}, '||bat||' 타석)'", s(tag), str(pts), pos=s(p)))
    for t, word, tag, pts in ((25, "병살 가담", "DP_FIELD", 10), (34, "삼중살 가담", "TP_FIELD", 50)):
        for p in CHAINS[t]:
            out.append(_credit(f"t={t}", fielder(p), "bat", f"'{word} ({p}, '||bat||' 타석)'", s(tag), str(pts), pos=s(p)))
    return "\nUNION ALL ".join(o for o in out if " NULL nm" not in o)


CREDITS = f"{STATE},\ncr AS ({_credits()})"
FINALS = """
fin AS (SELECT game_id, arg_max(inn, sub) last_inn, arg_max(hs, sub) home_score, arg_max(as_, sub) away_score FROM ev GROUP BY ALL)
"""
INHERITED = f"""
mv AS (SELECT game_id, h, epoch, sub, inn, NULL runner, pin taker, unnest(list_distinct(base)) slot FROM ss WHERE t=1
  UNION ALL SELECT game_id, h, epoch, sub, inn, run, NULL, slot FROM ss WHERE fb IS NOT NULL),
sg AS (SELECT *, count(runner) OVER (PARTITION BY game_id, h, epoch, slot ORDER BY sub ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) span
  FROM mv WHERE slot<>'0'),
se AS (SELECT game_id, h, epoch, slot, span, arg_min(taker, sub) FILTER (taker IS NOT NULL) nm, min(sub) FILTER (runner IS NOT NULL) rsub,
    arg_min(inn, sub) FILTER (runner IS NOT NULL) rinn, arg_min(runner, sub) FILTER (runner IS NOT NULL) runner FROM sg GROUP BY ALL HAVING nm IS NOT NULL),
mk AS (SELECT game_id, epoch-1 epoch, inn minn, sub msub FROM ss WHERE t=0 AND h='0'),
inh AS (SELECT game_id, nm, 'pitch' rl, rsub sub, rinn inn, '승계주자 '||runner||' 실점 허용' txt, 'INHERITED_SCORED' tag, 1 n, -5 pts FROM se WHERE rsub IS NOT NULL
  UNION ALL SELECT se.game_id, nm, 'pitch', coalesce(msub, 2147483647), CASE WHEN msub IS NULL THEN last_inn ELSE minn END,
    CASE WHEN msub IS NULL THEN '승계주자 실점 막음(경기 종료)' ELSE '승계주자 실점 막음' END, 'INHERITED_STRANDED', 1, 5
  FROM se LEFT JOIN mk USING (game_id, epoch) JOIN fin USING (game_id) WHERE rsub IS NULL)
"""
EARNED = """
em AS (SELECT game_id, sub, inn, CASE WHEN fb IS NOT NULL THEN run ELSE bat END runner, fb IS NOT NULL ran,
    CASE WHEN fb IS NOT NULL THEN '' ELSE pit END ow FROM ss
  WHERE fb IS NOT NULL OR (cls IN ('1B','2B','3B','BB','HBP') AND pit IS NOT NULL)),
eo AS (SELECT *, lag(ow) OVER (PARTITION BY game_id, runner ORDER BY sub) owner FROM em),
er AS (SELECT game_id, owner nm, sub, inn, runner FROM eo WHERE ran AND coalesce(owner,'')<>''
  UNION ALL SELECT game_id, pit, sub, inn, bat FROM ss WHERE t=19 AND pit IS NOT NULL)
"""
MARGINS = """
mg AS (SELECT game_id, pin nm, arg_min(CASE WHEN half='0' THEN hs-as_ ELSE as_-hs END, sub) margin FROM ev_sub GROUP BY ALL)
""".replace("ev_sub", "(SELECT * FROM rl WHERE t=1)")
ADVANCES = "av AS (SELECT game_id, prod nm, count(*) advance FROM grp WHERE prod IS NOT NULL AND adv GROUP BY ALL)"

CODE_CLASS_T = {
    16: "1B", 17: "2B", 18: "3B", 19: "HR", 20: "BB", 21: "BB", 22: "HBP", 23: "K", 24: "K", 25: "GDP", 26: "SACFLY",
    27: "SACBUNT", 28: "GO", 29: "LD", 30: "FO", 31: "GO", 32: "GO", 33: "REACH_ERROR", 34: "GO",
}


def tcount(*classes: str) -> str:
    ts = [str(t) for t, c in CODE_CLASS_T.items() if c in classes]
    return f"count(*) FILTER (t IN ({','.join(ts)}))"


GAME_SIDES = f"""
gs AS (SELECT DISTINCT game_id, user_id, {pick(TEAMS, 'user_id')} home_name, {pick(TEAMS, 'user_id+3')} away_name, user_id%4<>0 final FROM ev)
"""
_field = lambda tag: f"count(*) FILTER (tag='{tag}')"
SCORED = f"""{CREDITS},{FINALS},{INHERITED},{EARNED},{MARGINS},{ADVANCES},{GAME_SIDES},
men AS (SELECT game_id, fs||(k%9+1) nm, inn, sub FROM rl WHERE t=33),
box AS (SELECT game_id, half, k%9 n, bat nm, count(*) FILTER (t IN ({",".join(str(t) for t in CODE_CLASS_T)})) ab,
    count(*) FILTER (t BETWEEN 16 AND 19) hit, count(*) FILTER (t=7) run_, count(*) FILTER (t=36) rbi, count(*) FILTER (t=19) hr,
    count(*) FILTER (t IN (20,21)) bb, count(*) FILTER (t IN (23,24)) kk, count(*) FILTER (t=5) sb, {tcount('1B')} s1, {tcount('2B')} s2,
    {tcount('3B')} s3, {tcount('FO', 'SACFLY')} fo, {tcount('GO', 'SACBUNT', 'GDP')} go_, {tcount('LD')} ld, {tcount('GDP')} gdp,
    {tcount('SACFLY')} sacfly, {tcount('SACBUNT')} sacbunt, {tcount('HBP')} hbp FROM rl GROUP BY ALL),
fc AS (SELECT game_id, nm, {_field('ASSIST')} a1, {_field('OF_ASSIST')} a2, least({_field('DP_FIELD')},1) a3, least({_field('TP_FIELD')},1) a4,
    {_field('CS_CATCHER')} a5, {_field('SB_ALLOWED_CATCHER')} a6, count(*) FILTER (tag='PLAY:BUNT_OUT') bunts FROM cr WHERE rl='bat' GROUP BY ALL),
ec AS (SELECT game_id, nm, count(*) errs FROM men GROUP BY ALL),
sb0 AS (SELECT box.game_id, CASE WHEN half='0' THEN 'away' ELSE 'home' END side, n, box.nm "name",
    CASE WHEN half='0' THEN away_name ELSE home_name END team,
    {pick(b.BOARD_POSITIONS, 'n+length(box.game_id)')} position,
    run_ "R", hit "H", bb "BB", s2 "2B", s3 "3B", hr "HR", rbi "RBI", fo "FO", greatest(go_-coalesce(bunts,0),0) "GO", ld "LD", gdp "GDP",
    sacfly "SACFLY", sacbunt "SACBUNT", sb "SB", 0 "CS", hbp "HBP", kk "K", 0 "PICKOFF", CAST(s1>0 AND s2>0 AND s3>0 AND hr>0 AS INT) "CYCLE",
    0 "GRANDSLAM", coalesce(errs,0) "E", coalesce(a1,0) "ASSIST", coalesce(a2,0) "OF_ASSIST", coalesce(a3,0) "DP_FIELD",
    coalesce(a4,0) "TP_FIELD", coalesce(a5,0) "CS_CATCHER", coalesce(a6,0) "SB_ALLOWED_CATCHER", coalesce(advance,0) "ADVANCE_OUT", 0 ambiguous
  FROM box JOIN gs USING (game_id) LEFT JOIN fc ON fc.game_id=box.game_id AND fc.nm=box.nm LEFT JOIN ec ON ec.game_id=box.game_id AND ec.nm=box.nm
    LEFT JOIN av ON av.game_id=box.game_id AND av.nm=box.nm
  ),
sbat AS (SELECT *, {BAT_LP} lp FROM sb0),
pb0 AS (SELECT game_id, half, k%4 j, fs||'P'||(k%4) nm, count(*)%8 ip, count(*) FILTER (t BETWEEN 16 AND 19) hit, count(*) FILTER (t IN (6,7,8,19,36)) r,
    count(*) FILTER (t IN (7,19)) er, count(*) FILTER (t=19) hr, count(*) FILTER (t IN (20,21)) bb, count(*) FILTER (t IN (20,21,22)) bbhp,
    count(*) FILTER (t IN (23,24)) kk FROM rl GROUP BY ALL),
pb1 AS (SELECT *, max(ip) OVER (PARTITION BY game_id, half)*3 team_outs FROM pb0),
pcr AS (SELECT game_id, nm, tag FROM cr WHERE rl='pitch' UNION ALL SELECT game_id, nm, tag FROM inh),
pc AS (SELECT game_id, nm, {_field('2B_A')} b2, {_field('3B_A')} b3, {_field('INHERITED_SCORED')} i1, {_field('INHERITED_STRANDED')} i2,
    {_field('CS_A')} c1, {_field('SB_ALLOWED')} c2, {_field('PICKOFF_A')} c3 FROM pcr GROUP BY ALL),
sp0 AS (SELECT pb1.game_id, CASE WHEN half='0' THEN 'home' ELSE 'away' END side, j, pb1.nm "name", CASE WHEN half='0' THEN home_name ELSE away_name END team,
    CASE WHEN j=0 THEN '선발' ELSE '구원' END "role", hit "H", hr "HR", er "ER", bb "BB", greatest(bbhp-bb,0) "HBP", kk "K", ip*3 "OUT", 0 "WP", 0 "BK",
    CAST(j=0 AND ip*3>=18 AND er<=3 AND NOT (ip*3>=21 AND er<=2) AS INT) "QS", CAST(j=0 AND ip*3>=21 AND er<=2 AS INT) "QSPLUS",
    CAST(j=1 AS INT) "HOLD", CAST(j=2 AS INT) "SAVE", CAST(j=3 AS INT) "BLOWN", final AND j=0 AND ip>0 AND ip*3=team_outs cg0, r, bbhp,
    coalesce(b2,0) "2B_A", coalesce(b3,0) "3B_A", coalesce(i1,0) "INHERITED_SCORED", coalesce(i2,0) "INHERITED_STRANDED", coalesce(c1,0) "CS_A",
    coalesce(c2,0) "SB_ALLOWED", coalesce(c3,0) "PICKOFF_A",
    CAST(coalesce(margin IS NOT NULL AND (CASE WHEN half='0' THEN home_score>away_score ELSE away_score>home_score END)
      AND ((margin BETWEEN 1 AND 3 AND ip*3>=3) OR ip*3>=9), false) AS INT) "SAVE_OPP"
  FROM pb1 JOIN gs USING (game_id) LEFT JOIN pc ON pc.game_id=pb1.game_id AND pc.nm=pb1.nm LEFT JOIN mg ON mg.game_id=pb1.game_id AND mg.nm=pb1.nm
    JOIN fin ON fin.game_id=pb1.game_id WHERE ip>0 OR hit+er+hr+bb+bbhp+kk>0 OR j>0),
sp1 AS (SELECT * EXCLUDE (cg0, r, bbhp), CAST(cg0 AS INT) "CG", CAST(cg0 AND r=0 AS INT) "SHO", CAST(cg0 AND "H"=0 AS INT) "NOHIT",
    CAST(cg0 AND "H"=0 AND bbhp=0 AS INT) "PERFECT" FROM sp0),
spit AS (SELECT *, {PIT_LP} lp FROM sp1)
"""
_cap = " (1경기 1회 상한, 추가 반영 없음)"
LEDGER = f"""{SCORED},
relay_log AS (SELECT game_id, nm, rl, sub, inn, txt, tag, n, pts, pos FROM cr UNION ALL SELECT game_id, nm, rl, sub, inn, txt, tag, n, pts, '' FROM inh),
owned AS (SELECT c.*, {{seq}} seq FROM relay_log c WHERE EXISTS (SELECT 1 FROM sbat s WHERE s.game_id=c.game_id AND s.name=c.nm AND c.rl='bat')
   OR EXISTS (SELECT 1 FROM spit s WHERE s.game_id=c.game_id AND s.name=c.nm AND c.rl='pitch')),
capped AS (SELECT *, tag IN ('DP_FIELD','TP_FIELD') AND row_number() OVER (PARTITION BY game_id, nm, rl, tag ORDER BY sub, seq)>1 late FROM owned),
ends AS (SELECT game_id, nm, rl, arg_max(inn, sub) last_inn, arg_min(inn, sub) FILTER (tag='PLAY:HR') hr_inn FROM owned GROUP BY ALL),
erl AS (SELECT er.*, row_number() OVER (PARTITION BY er.game_id, er.nm ORDER BY inn, sub) rn FROM er),
erc AS (SELECT erl.* FROM erl JOIN spit s ON s.game_id=erl.game_id AND s.name=erl.nm WHERE rn<=s."ER"),
pl AS (SELECT s.*, e.last_inn FROM spit s LEFT JOIN ends e ON e.game_id=s.game_id AND e.nm=s.name AND e.rl='pitch'),
bl AS (SELECT s.*, e.last_inn, e.hr_inn FROM sbat s LEFT JOIN ends e ON e.game_id=s.game_id AND e.nm=s.name AND e.rl='bat'),
lines AS (
  SELECT game_id, nm, rl, inn, CASE WHEN late THEN txt||'{_cap}' ELSE txt END txt, tag, n, CASE WHEN late THEN 0 ELSE pts END pts FROM capped
  UNION ALL SELECT game_id, nm, 'pitch', inn, '자책점 허용 ('||runner||' 득점)', 'ER', 1, -10 FROM erc
  UNION ALL SELECT game_id, name, 'pitch', 7, '퀄리티스타트+', 'QSPLUS', 1, 30 FROM pl WHERE "QSPLUS"=1
  UNION ALL SELECT game_id, name, 'pitch', 6, '퀄리티스타트', 'QS', 1, 20 FROM pl WHERE "QS"=1
  UNION ALL SELECT game_id, name, 'pitch', last_inn, '홀드', 'HOLD', 1, 20 FROM pl WHERE "HOLD"=1
  UNION ALL SELECT game_id, name, 'pitch', last_inn, '세이브', 'SAVE', 1, 30 FROM pl WHERE "SAVE"=1
  UNION ALL SELECT game_id, name, 'pitch', last_inn, '블론 세이브', 'BLOWN', 1, -10 FROM pl WHERE "BLOWN"=1
  UNION ALL SELECT game_id, name, 'pitch', last_inn, '퍼펙트게임', 'PERFECT', 1, 100 FROM pl WHERE "PERFECT"=1
  UNION ALL SELECT game_id, name, 'pitch', last_inn, '노히트', 'NOHIT', 1, 70 FROM pl WHERE "NOHIT"=1 AND "PERFECT"=0
  UNION ALL SELECT game_id, name, 'pitch', last_inn, '완봉', 'SHO', 1, 30 FROM pl WHERE "SHO"=1
  UNION ALL SELECT game_id, name, 'pitch', last_inn, '완투', 'CG', 1, 15 FROM pl WHERE "CG"=1 AND "SHO"=0
  UNION ALL SELECT men.game_id, men.nm, 'bat', men.inn, '실책', 'E', 1, -10 FROM men JOIN sbat s ON s.game_id=men.game_id AND s.name=men.nm
  UNION ALL SELECT game_id, name, 'bat', last_inn, '사이클히트 보너스', 'CYCLE', 1, 50 FROM bl WHERE "CYCLE"=1),
tot AS (SELECT game_id, nm, rl, CAST(sum(pts) AS BIGINT) s FROM lines GROUP BY ALL),
scored AS (SELECT game_id, name nm, 'bat' rl, lp FROM sbat UNION ALL SELECT game_id, name, 'pitch', lp FROM spit),
led AS (SELECT * FROM lines UNION ALL
  SELECT sc.game_id, sc.nm, sc.rl, NULL, '기타 보정 (박스스코어 기준 상한 등)', '', 0, lp-coalesce(s,0) FROM scored sc LEFT JOIN tot USING (game_id, nm, rl)
  WHERE lp<>coalesce(s,0))
"""
# Order of the shares of one line: the chain's order.
LEDGER = LEDGER.replace(
    "{seq}",
    "CASE WHEN t_pos IS NULL THEN 0 ELSE t_pos END".replace(
        "t_pos", "list_position(['유격수','3루수','중견수','2루수','1루수','포수'], c.pos)"
    ),
)


def items_sql(table: str, categories, weights, role: str) -> str:
    out = []
    for group, label, key, flag in categories:
        key, _, info = key.partition(":")
        parts = key.split("+")
        count = "+".join(q(p) for p in parts)
        if info:
            points = "0"
        elif flag:
            points = f"CASE WHEN {q(key)}<>0 THEN {weights[key]} ELSE 0 END"
        else:
            points = "+".join(f"{q(p)}*{weights.get(p, 0)}" for p in parts)
        out.append(
            f"SELECT game_id, name, {role} AS \"role\", '{group}' category, '{label}' AS label, {count} AS times, {points} AS points, {str(flag).lower()} flag FROM {table}"
        )
    return " UNION ALL ".join(out)


# --- second league --------------------------------------------------------------------------

SECOND = f"""{EV},
cur AS (SELECT rg.*, coalesce(last_value(CASE WHEN t=37 THEN fs||'P'||((k//4)%4) END IGNORE NULLS) OVER (PARTITION BY game_id, half ORDER BY sub),
    CASE WHEN game_id IN (SELECT game_id FROM rl x WHERE x.half=rg.half AND x.k%4=0) THEN fs||'P0' END) pit FROM rg),
g3 AS (SELECT game_id, no, bool_or(t IN (7,9,36)) adv3 FROM rl GROUP BY ALL),
bx AS (SELECT game_id, nm,
    count(*) FILTER (t=17) b2, count(*) FILTER (t=18) b3, count(*) FILTER (t=25) gdp, count(*) FILTER (t=26) sf,
    count(*) FILTER (t=10) cs, count(*) FILTER (t IN (11,12)) po, count(*) FILTER (t=19 AND homes>=3) gs,
    count(*) FILTER (t IN (27,28,32) AND adv3) adv FROM
    (SELECT *, CASE WHEN t IN (10,11,12) THEN run ELSE bat END nm FROM cur JOIN g3 USING (game_id, no) WHERE t IN ({PLAYS},10,11,12)) GROUP BY ALL),
fl AS (SELECT DISTINCT game_id, CASE WHEN half='0' THEN '1' ELSE '0' END half, bat nm FROM rl WHERE k%9=4),
er2 AS (SELECT e.game_id, fl.nm, count(*) errs FROM rl e JOIN fl USING (game_id, half) WHERE e.t=38 GROUP BY ALL),
b0 AS (SELECT game_id, bat nm, count(*) FILTER (t BETWEEN 16 AND 19) hit, count(*) FILTER (t=7) run_, count(*) FILTER (t=36) rbi,
    count(*) FILTER (t=19) hr, count(*) FILTER (t IN (20,21)) bb, count(*) FILTER (t IN (23,24)) kk, count(*) FILTER (t=5) sb,
    count(*) FILTER (t=22) hbp FROM rl GROUP BY ALL),
sec AS (SELECT b0.game_id, b0.nm "name", run_ "R", hit "H", bb "BB", coalesce(b2,0) "2B", coalesce(b3,0) "3B", hr "HR", rbi "RBI", 0 "FO", 0 "GO",
    coalesce(gdp,0) "GDP", coalesce(sf,0) "SACFLY", coalesce(adv,0) "SACBUNT", sb "SB", coalesce(cs,0) "CS", hbp "HBP", kk "K", coalesce(po,0) "PICKOFF",
    coalesce(gs,0) "GRANDSLAM", coalesce(errs,0) "E", 0 "ASSIST", 0 "OF_ASSIST", 0 "DP_FIELD", 0 "TP_FIELD", 0 "CS_CATCHER", 0 "SB_ALLOWED_CATCHER",
    CAST("H"-"2B"-"3B"-"HR">0 AND "2B">0 AND "3B">0 AND "HR">0 AS INT) "CYCLE"
  FROM b0 LEFT JOIN bx ON bx.game_id=b0.game_id AND bx.nm=b0.nm LEFT JOIN er2 ON er2.game_id=b0.game_id AND er2.nm=b0.nm)
"""

# --- boards ---------------------------------------------------------------------------------

BOARD = f"""
bd AS (SELECT date_trunc('month', o_orderdate)::DATE game_date, o_orderkey row_id, 'C'||o_custkey "name", {pick(TEAMS, 'o_custkey')} team,
    {pick(TEAMS, 'o_custkey+1+o_orderkey%3')} opponent, CAST(round(trunc(o_totalprice)) AS BIGINT)%300-50 lp,
    CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 'pitcher' ELSE 'batter' END kind,
    CASE o_orderpriority WHEN '1-URGENT' THEN '선발' WHEN '2-HIGH' THEN '구원' END "role",
    CASE WHEN o_orderpriority NOT IN ('1-URGENT','2-HIGH') THEN {pick(b.BOARD_POSITIONS, 'o_orderkey')} END position,
    CASE WHEN o_orderkey%7<>0 THEN o_orderkey%6 END roster_cost FROM orders)
"""
POOLS = f"""{BOARD},
mem AS (SELECT game_date, lp, 'starter' pool, '' pool_key FROM bd WHERE "role"='선발'
  UNION ALL SELECT game_date, lp, 'reliever', '' FROM bd WHERE "role"='구원'
  UNION ALL SELECT game_date, lp, 'outfield', '' FROM bd WHERE position IN ('좌익수','중견수','우익수')
  UNION ALL SELECT game_date, lp, 'DH', '' FROM bd WHERE kind='batter'
  UNION ALL SELECT game_date, lp, 'position', coalesce(position,'') FROM bd),
thr AS (SELECT game_date, pool, pool_key, lp kth FROM mem
  QUALIFY row_number() OVER (PARTITION BY game_date, pool, pool_key ORDER BY lp DESC)=CASE pool WHEN 'starter' THEN 3 WHEN 'position' THEN 2 ELSE 5 END)
"""
HISTORY = f"""{POOLS},
fst AS (SELECT *, CASE WHEN "role"='선발' THEN 'starter' WHEN "role"='구원' THEN 'reliever' WHEN position='지명타자' THEN 'DH'
      WHEN position IN ('좌익수','중견수','우익수') THEN 'outfield' ELSE 'position' END pool FROM bd
  QUALIFY row_number() OVER (PARTITION BY game_date, name, team ORDER BY CASE WHEN kind='batter' THEN 0 ELSE 1 END, lp DESC, row_id)=1),
his AS (SELECT fst.game_date, name, team, lp, fst.pool, coalesce(kth,0) threshold, lp-coalesce(kth,0) relative_value,
    CASE WHEN coalesce(roster_cost,0)<>0 THEN lp/roster_cost::DOUBLE END cost_value,
    CASE WHEN coalesce(roster_cost,0)<>0 THEN (lp-coalesce(kth,0))/roster_cost::DOUBLE ELSE (lp-coalesce(kth,0))::DOUBLE END shown
  FROM fst LEFT JOIN thr ON thr.game_date=fst.game_date AND thr.pool=fst.pool AND thr.pool_key=CASE WHEN fst.pool='position' THEN coalesce(position,'') ELSE '' END)
"""

# --- rosters --------------------------------------------------------------------------------

POOL = f"""
rp AS (SELECT p_brand AS day, p_partkey, (p_partkey*37)%161-20 lp, (p_partkey//7)%5+1 cost,
    CASE WHEN p_partkey%3=2 THEN CASE WHEN p_partkey%2=0 THEN '선발' ELSE '구원' END
         ELSE {pick((*ROSTER_FIELD_SLOTS, DH), 'p_size')} END pool FROM part)
"""


def roster_sql(budget: int) -> str:
    """Layers per total cost, one slot after another."""
    parts = [POOL]
    parts.append("top AS (SELECT *, row_number() OVER (PARTITION BY day, pool, cost ORDER BY lp DESC, p_partkey) rn FROM rp QUALIFY rn<=3)")
    parts.append("one AS (SELECT day, pool, cost c, lp v FROM top WHERE rn=1)")
    parts.append(
        "two AS (SELECT a.day, a.pool, a.cost+b.cost c, max(a.lp+b.lp) v FROM top a JOIN top b ON a.day=b.day AND a.pool=b.pool"
        f" AND a.p_partkey<b.p_partkey WHERE a.cost+b.cost<={budget} GROUP BY ALL)"
    )
    parts.append(
        "three AS (SELECT a.day, a.pool, a.cost+b.cost+d.cost c, max(a.lp+b.lp+d.lp) v FROM top a JOIN top b ON a.day=b.day AND a.pool=b.pool AND a.p_partkey<b.p_partkey"
        f" JOIN top d ON a.day=d.day AND a.pool=d.pool AND b.p_partkey<d.p_partkey WHERE a.pool='구원' AND a.cost+b.cost+d.cost<={budget} GROUP BY ALL)"
    )

    def join(name: str, left: str, right: str, where: str) -> str:
        return (
            f"{name} AS (SELECT l.day, l.c+r.c c, max(l.v+r.v) v FROM {left} l JOIN {right} r ON l.day=r.day AND {where}"
            f" WHERE l.c+r.c<={budget} GROUP BY ALL)"
        )

    first = ROSTER_FIELD_SLOTS[0]
    parts.append(f"a0 AS (SELECT day, c, v FROM one WHERE pool='{first}')")
    parts.append(f"h0 AS (SELECT day, c, v FROM two WHERE pool='{first}')")
    for i, slot in enumerate(ROSTER_FIELD_SLOTS[1:], 1):
        parts.append(join(f"a{i}", f"a{i-1}", "one", f"r.pool='{slot}'"))
        parts.append(join(f"x{i}", f"h{i-1}", "one", f"r.pool='{slot}'"))
        parts.append(join(f"y{i}", f"a{i-1}", "two", f"r.pool='{slot}'"))
        parts.append(f"h{i} AS (SELECT day, c, max(v) v FROM (SELECT * FROM x{i} UNION ALL SELECT * FROM y{i}) GROUP BY ALL)")
    last = len(ROSTER_FIELD_SLOTS) - 1
    parts.append(join("z", f"a{last}", "one", f"r.pool='{DH}'"))
    parts.append(f"hb AS (SELECT day, c, max(v) v FROM (SELECT * FROM h{last} UNION ALL SELECT * FROM z) GROUP BY ALL)")
    parts.append(join("hs", "hb", "two", "r.pool='선발'"))
    parts.append(join("hr", "hs", "three", "true"))
    return ",\n".join(parts)


# --- schedule -------------------------------------------------------------------------------

CALENDAR = f"""{ORDER_GAMES},
cal AS (SELECT game_date, arg_min(round, game_seq) FILTER (NOT cancel) round,
    count(*) FILTER (NOT cancel) games FROM og GROUP BY ALL)
"""
PRE = f"""{ORDER_GAMES},
pg AS (SELECT *, 'home' side, home_code code, home_name team FROM og UNION ALL SELECT *, 'away', away_code, away_name FROM og),
pgw AS (SELECT * FROM pg WHERE NOT cancel AND status_code IN ('BEFORE','READY') AND TIMESTAMP '{NOW}' >= start_utc - INTERVAL 2 HOUR),
ros AS (SELECT {pick(b.TEAM_CODES, 'l_suppkey')} code, CAST(l_shipdate AS DATE) game_date, 'N'||(l_partkey%20) "name",
    {lit(b.ROSTER_ROLES[:4])}[CAST(max(l_partkey)%4+1 AS INT)] category FROM lineitem GROUP BY ALL),
lu AS (SELECT CAST(l_orderkey AS VARCHAR) game_id, CASE WHEN l_linestatus='F' THEN 'home' ELSE 'away' END side, 'N'||(l_partkey%20) "name",
    max(l_linenumber) bat_order, bool_or(l_returnflag='R') starts FROM lineitem GROUP BY ALL),
kp AS (SELECT 'N'||(s_suppkey%20) "name", {pick(TEAMS, 's_suppkey//3')} team, arg_max({pick((*FIELD_POSITIONS, DH), 's_suppkey')}, s_suppkey) kpos FROM supplier GROUP BY ALL),
nm AS (SELECT pgw.game_id, pgw.side, ros.name, pgw.team, category, bat_order, coalesce(starts,false) starts
  FROM pgw JOIN ros USING (code, game_date) LEFT JOIN lu ON lu.game_id=pgw.game_id AND lu.side=pgw.side AND lu.name=ros.name)
"""


# Columns DuckDB derives as 32-bit numbers; the Spark side returns BIGINT.
WIDE: dict[str, tuple[str, ...]] = {
    "batter_export": ("HR", "RBI", "SB", "CS", "E", "CYCLE", "GRANDSLAM"),
    "batter_lp": ("line", "HR", "CYCLE",),
    "pitcher_lp": ("pos_idx", "OUT", "QS", "QSPLUS", "CG", "SHO", "NOHIT", "PERFECT", "HOLD", "SAVE", "BLOWN",),
    "pitcher_lp_second": ("pos_idx", "OUT", "QS", "QSPLUS", "CG", "SHO", "NOHIT", "PERFECT",),
    "special_records": ("GRANDSLAM",),
    "group_facts": ("group_double", "group_triple", "group_out_rose", "group_batter_out",),
    "prev_base": ("from_base",),
    "scored_batters": ("CS", "PICKOFF", "CYCLE", "GRANDSLAM", "ambiguous",),
    "scored_pitchers": (
        "WP", "BK", "QS", "QSPLUS", "HOLD", "SAVE", "BLOWN", "PERFECT", "NOHIT", "SHO", "CG", "SAVE_OPP",
    ),
    "er_cut": ("points",),
    "field_rule_modes": ("mode", "dh",),
    "second_league_batters": ("CYCLE",),
    "hidden_columns": (
        "2B_A", "3B_A", "HR", "WP", "BK", "SB_ALLOWED", "QSPLUS", "QS", "CG", "SHO", "NOHIT", "PERFECT",
        "CS_A_PICKOFF_A",
    ),
    "roster_feasibility": ("feasible",),
    "optimal_roster_value": ("budget",),
    "optimal_roster_check": ("players", "slots",),
    "active_window": ("active",),
    "pregame_batters": ("is_starter", "show_order", "lp", "K",),
    "pregame_pitchers": ("is_starter", "show_order", "QS",),
}


def widen(text: str, columns: tuple[str, ...]) -> str:
    if not columns:
        return text
    casts = ", ".join(f"CAST({q(c)} AS BIGINT) AS {q(c)}" for c in columns)
    return f"SELECT * REPLACE ({casts}) FROM ({text})"


def oracle_sql() -> dict[str, str]:
    sql: dict[str, str] = {}
    sql["pa_class_counts"] = f"WITH {LINE_CODES} SELECT cls pa_class, count(*) appearances FROM lk GROUP BY ALL"
    sql["pa_slash_split"] = (
        f'WITH {LINE_BATTERS} SELECT name, CAST(sum(len(slots)) AS BIGINT) slots, '
        "CAST(sum(len(string_split(array_to_string(slots,'/'),'/'))) AS BIGINT) codes FROM lb GROUP BY ALL"
    )
    cols = ("H", "2B", "3B", "HR", "FO", "GO", "LD", "GDP", "SACFLY", "SACBUNT", "HBP", "K", "CYCLE")
    sql["batter_lp"] = f"WITH {LINE_COUNTED} SELECT game_id, name, part, line, {', '.join(q(c) for c in cols)}, {BAT_LP} lp FROM bat"
    a, z = line_pitchers(False), line_pitchers(True)
    one = f"SELECT 'first' league, inn, {outs_case('inn', OUTS_BY_TEXT)} o FROM (SELECT {pick(b.INNING_TEXTS, 'l_partkey+l_linenumber')} inn FROM lineitem)"
    two = f"SELECT 'second' league, inn, {outs_case('inn', OUTS_BY_TEXT_B)} o FROM (SELECT {pick(b.INNING_TEXTS_B, 'l_partkey+l_linenumber')} inn FROM lineitem)"
    sql["innings_outs"] = f"SELECT league, inn, count(*) AS rows, CAST(sum(o) AS BIGINT) outs FROM ({one} UNION ALL {two}) GROUP BY ALL"
    pc = ("OUT", "H", "ER", "HBP", "K", "QS", "QSPLUS", "CG", "SHO", "NOHIT", "PERFECT", "HOLD", "SAVE", "BLOWN")
    sql["pitcher_lp"] = f"WITH {a} SELECT game_id, side, pos_idx, name, \"role\", {', '.join(q(c) for c in pc)}, {PIT_LP} lp FROM pit"
    pc2 = ("OUT", "QS", "QSPLUS", "CG", "SHO", "NOHIT", "PERFECT")
    sql["pitcher_lp_second"] = f"WITH {z} SELECT game_id, side, pos_idx, name, \"role\", {', '.join(q(c) for c in pc2)}, {PIT_LP} lp FROM pit"
    band = "CASE WHEN lp>=150 THEN 'hot' WHEN lp>={} THEN 'warm' WHEN lp<0 THEN 'cool' ELSE '' END"
    sql["lp_bands"] = f"WITH {BOARD} SELECT {band.format(60)} board_band, {band.format(80)} report_band, count(*) AS rows FROM bd GROUP BY ALL"
    rc = {"E": "실책", "WP": "폭투", "CS": "도루자", "BK": "보크", "PICKOFF": "견제사"}
    sql["special_records"] = (
        f"WITH {LINE_RECORDS} SELECT game_id, name, "
        + ", ".join(f"count(*) FILTER (how='{w}') {q(c)}" for c, w in rc.items())
        + ", max(CASE WHEN how='홈런' THEN 1 ELSE 0 END) \"GRANDSLAM\" FROM men GROUP BY ALL"
    )
    sql["error_innings"] = f"WITH {LINE_RECORDS} SELECT name, inn, count(*) errors FROM men WHERE how='실책' GROUP BY ALL"
    sql["grand_slam_diff"] = GRAND_SLAMS

    sql["auto_position"] = f"WITH {POSITION_TABLE} SELECT player_code, name, team, games, dh_games, auto_position, positions FROM ptab"
    sql["override_merge"] = f"""WITH {POSITION_TABLE},{PREVIOUS}
      SELECT coalesce(t.player_code, p.player_code) player_code, coalesce(t.name, p.name) "name", coalesce(t.team, p.team) team,
        coalesce(t.auto_position, p.auto_position) auto_position, coalesce(p.manual_position,'-') manual_position,
        coalesce(nullif(p.manual_position,''), t.auto_position, p.auto_position) effective_position
      FROM ptab t FULL JOIN prev p ON t.player_code=p.player_code WHERE t.player_code IS NOT NULL OR coalesce(p.manual_position,'')<>''"""
    sql["override_upsert"] = f"""WITH {PREVIOUS},{REQUESTS}, u AS (SELECT p.player_code, p.auto_position,
        CASE WHEN r.player_code IS NOT NULL THEN nullif(new_position,'') ELSE manual_position END m FROM prev p LEFT JOIN req r USING (player_code))
      SELECT player_code, coalesce(m,'-') manual_position, coalesce(m, auto_position) effective_position FROM u"""
    sql["override_rejects"] = f"WITH {PREVIOUS},{REQUESTS} SELECT player_code, new_position FROM req WHERE player_code NOT IN (SELECT player_code FROM prev)"
    sql["position_attach"] = f"""WITH {PREVIOUS}, k AS (SELECT *, coalesce(nullif(manual_position,''), auto_position) e FROM prev WHERE CAST(player_code AS BIGINT)%3<>0)
      SELECT coalesce(e,'') AS "position", CAST(coalesce(manual_position,'')<>'' AS BIGINT) position_override, count(*) AS rows
      FROM lineitem LEFT JOIN k ON k.player_code=CAST(l_suppkey AS VARCHAR) GROUP BY ALL"""
    sql["name_lookup"] = f"WITH {PREVIOUS} SELECT player_code, name, team FROM prev WHERE contains(name,'77')"
    sql["cost_lookup"] = f"""WITH {COSTS} SELECT kind, name, team, position AS "position", n AS rows, CASE WHEN cost IS NULL THEN 0 ELSE n END matched,
      CAST(coalesce(cost*n,0) AS BIGINT) total_cost FROM looked"""
    sql["cost_match_rate"] = f"""WITH {COSTS} SELECT position AS "position", CAST(sum(CASE WHEN cost IS NULL THEN 0 ELSE n END) AS BIGINT) matched,
      CAST(sum(n) AS BIGINT) total FROM looked WHERE kind='batter' GROUP BY ALL"""

    kind = f"""CASE WHEN t=0 THEN 'mark' WHEN t IN ({SUBS}) THEN 'sub' WHEN t IN ({STEALS}) THEN 'steal' WHEN t IN ({RUNS}) THEN 'run'
      WHEN t=10 THEN 'caught' WHEN t IN (11,12) THEN 'pickoff' WHEN t IN (13,14,15) THEN 'runner_out' WHEN t IN ({PLAYS}) THEN 'play' ELSE 'other' END"""
    sql["relay_kinds"] = f"""WITH {EV} SELECT {kind} kind, CASE WHEN t=1 THEN pin WHEN t IN (2,3,4) THEN fin WHEN t IN ({STEALS},{RUNS},10,11,12) THEN run
      WHEN t IN ({PLAYS}) THEN bat ELSE '' END "name", count(*) "lines" FROM rl GROUP BY ALL"""
    tag_rows = " UNION ALL ".join(
        f"SELECT bat AS name, '{x}' tag FROM rl WHERE cls0='{c}'" for c, tags in TAGS.items() for x in tags
    )
    sql["relay_tags"] = f"WITH {EV} SELECT name, tag, count(*) times FROM ({tag_rows}) GROUP BY ALL"
    chain_rows = " UNION ALL ".join(
        f"""SELECT '{"runner_out" if t in RUNNER_OUT else "play"}' kind, '{">".join(c)}' AS "chain", '{c[-2] if len(c) > 1 else c[0]}' assist_position,
        '{"OF_ASSIST" if (c[-2] if len(c) > 1 else c[0]) == "중견수" else "ASSIST"}' tag FROM rl WHERE t={t}"""
        for t, c in CHAINS.items() if t != 10
    )
    sql["chain_assist"] = f'WITH {EV} SELECT kind, "chain", assist_position, tag, count(*) "lines" FROM ({chain_rows}) GROUP BY ALL'
    sql["group_facts"] = f"""WITH {EV} SELECT game_id, no, sub, homes group_homes, CAST(dbl AS INT) group_double, CAST(tpl AS INT) group_triple,
      CAST(rose AS INT) group_out_rose, CAST(bout AS INT) group_batter_out FROM rg"""
    sql["productive_outs"] = f"WITH {EV},{ADVANCES} SELECT game_id, nm AS name, advance FROM av"
    sql["pitcher_in_charge"] = f"WITH {STATE} SELECT game_id, half, sub, coalesce(pit,'-') pitcher FROM ss WHERE t<>0"
    who = " UNION ALL ".join(
        f"SELECT game_id, half, '{p}' AS \"position\", coalesce(f{i},'-') fielder FROM ss WHERE t<>0" for i, p in enumerate(DPOS)
    )
    sql["fielder_asof"] = f'WITH {STATE} SELECT game_id, half, "position", fielder, count(*) "lines" FROM ({who}) GROUP BY ALL'
    sql["prev_base"] = f"WITH {STATE} SELECT game_id, half, sub, run AS name, fb from_base, slot FROM ss WHERE fb IS NOT NULL"
    sql["inherited_runners"] = f"""WITH {STATE},{FINALS},{INHERITED} SELECT game_id, nm AS name, tag, inn, txt AS text, count(*) runners,
      CAST(sum(pts) AS BIGINT) points FROM inh GROUP BY ALL"""
    sql["earned_run_origin"] = f"WITH {STATE},{EARNED} SELECT game_id, nm AS name, sub, inn, runner FROM er"
    sql["entry_margins"] = f"WITH {EV},{MARGINS} SELECT game_id, nm AS name, margin FROM mg"
    sql["final_score"] = f"WITH {EV},{FINALS} SELECT * FROM fin"
    sql["line_credits"] = f'WITH {CREDITS} SELECT game_id, nm AS name, rl AS "role", sub, inn, txt AS text, tag, n, pts AS points, pos FROM cr'
    sql["position_events"] = f"""WITH {CREDITS} SELECT game_id, nm AS name, tag, pos, count(*) events FROM cr
      WHERE tag IN ({", ".join(f"'{c}'" for c in FIELD_COUNTERS)}) GROUP BY ALL"""
    sql["scored_batters"] = f"WITH {SCORED} SELECT game_id, side, name, team, {', '.join(q(c) for c in BATTER_COUNTERS)}, ambiguous, lp FROM sbat"
    sql["scored_pitchers"] = f"WITH {SCORED} SELECT game_id, side, name, team, \"role\", {', '.join(q(c) for c in PITCHER_COUNTERS)}, lp FROM spit"
    sql["er_cut"] = f"""WITH {LEDGER} SELECT game_id, nm AS name, rn AS ord, inn, '자책점 허용 ('||runner||' 득점)' AS text, -10 AS points FROM erc"""
    sql["play_ledger"] = f'WITH {LEDGER} SELECT game_id, nm AS name, rl AS "role", coalesce(inn,0) inn, txt AS text, tag, n, pts AS points FROM led'
    sql["inning_totals"] = f"""WITH {LEDGER} SELECT game_id, nm AS name, rl AS "role", coalesce(inn,0) inn, CAST(sum(pts) AS BIGINT) points, count(*) "lines"
      FROM led GROUP BY ALL"""
    sql["ledger_cap"] = f"""WITH {CREDITS}, o AS (SELECT *, list_position(['유격수','3루수','중견수','2루수','1루수','포수'], pos) seq FROM cr WHERE tag IN ('DP_FIELD','TP_FIELD')),
      c AS (SELECT *, row_number() OVER (PARTITION BY game_id, nm, rl, tag ORDER BY sub, seq)>1 late FROM o)
      SELECT game_id, nm AS name, tag, sub, CASE WHEN late THEN txt||'{_cap}' ELSE txt END AS text, CASE WHEN late THEN 0 ELSE pts END points FROM c"""
    group = "CASE WHEN {0}='포수' THEN 1 WHEN {0} IN ('1루수','2루수','3루수','유격수') THEN 2 WHEN {0} IN ('좌익수','중견수','우익수') THEN 3 ELSE 0 END"
    allowed = f"""CASE WHEN position='지명타자' THEN dh WHEN position='' THEN true WHEN mode=1 THEN pos=position
      WHEN mode=2 THEN {group.format('pos')}={group.format('position')} ELSE true END"""
    fields = ", ".join(
        (f"least(count(*) FILTER (tag='{c}' AND ok),1)" if c in ("DP_FIELD", "TP_FIELD") else f"count(*) FILTER (tag='{c}' AND ok)") + f" {q('n' + c)}"
        for c in FIELD_COUNTERS
    )
    delta = "+".join(f"({q('n' + c)}-{q(c)})*{BW[c]}" for c in FIELD_COUNTERS)
    sql["field_rule_modes"] = f"""WITH {SCORED}, m AS (SELECT * FROM (VALUES (1),(2),(3)) a(mode), (VALUES (true),(false)) d(dh)),
      e AS (SELECT cr.game_id, cr.nm, tag, pos, mode, dh, {allowed} ok FROM cr JOIN sbat s ON s.game_id=cr.game_id AND s.name=cr.nm, m
        WHERE rl='bat' AND tag IN ({", ".join(f"'{c}'" for c in FIELD_COUNTERS)})),
      f AS (SELECT game_id, nm, mode, dh, {fields} FROM e GROUP BY ALL)
      SELECT f.game_id, nm AS name, mode, CAST(dh AS INT) dh, {", ".join(f'{q("n" + c)} AS {q(c)}' for c in FIELD_COUNTERS)}, lp+{delta} AS lp
      FROM f JOIN sbat s ON s.game_id=f.game_id AND s.name=f.nm"""
    bat_items = items_sql("sbat", BATTER_CATEGORIES, BW, "'타자'")
    starter = items_sql("(SELECT * FROM spit WHERE \"role\"='선발')", PITCHER_CATEGORIES_SHARED + PITCHER_CATEGORIES_STARTER, PW, '"role"')
    reliever = items_sql("(SELECT * FROM spit WHERE \"role\"='구원')", PITCHER_CATEGORIES_SHARED + PITCHER_CATEGORIES_RELIEVER, PW, '"role"')
    sql["category_totals"] = f"""WITH {SCORED} SELECT game_id, name, "role", category, CAST(sum(points) AS BIGINT) points
      FROM ({bat_items} UNION ALL {starter} UNION ALL {reliever}) GROUP BY ALL"""
    sql["visible_items"] = f"""WITH {LINE_COUNTED} SELECT name, category, label, CAST(sum(times) AS BIGINT) times, CAST(sum(points) AS BIGINT) points
      FROM ({items_sql('bat', BATTER_CATEGORIES, BW, "''")}) WHERE flag OR times<>0 GROUP BY ALL"""

    sc = ("H", "2B", "3B", "HR", "GDP", "SACFLY", "SACBUNT", "CS", "PICKOFF", "GRANDSLAM", "E", "HBP", "CYCLE")
    sql["second_league_batters"] = f"WITH {SECOND} SELECT game_id, name, {', '.join(q(c) for c in sc)}, {BAT_LP} lp FROM sec"
    sql["second_league_pitchers"] = f"""WITH {SECOND} SELECT game_id, pit AS name, count(*) FILTER (t=17) "2B_A", count(*) FILTER (t=18) "3B_A",
      count(*) FILTER (t=10) "CS_A", count(*) FILTER (t IN (5,6)) "SB_ALLOWED", count(*) FILTER (t IN (11,12)) "PICKOFF_A"
      FROM cur WHERE pit IS NOT NULL AND t IN ({PLAYS},5,6,10,11,12) GROUP BY ALL"""
    blank = r"[\s\x{00a0}\x{3000}]"
    sql["split_lines"] = f"""WITH l AS (SELECT doc_id no, generate_subscripts(string_split(text, chr(10)),1)-1 sub, unnest(string_split(text, chr(10))) ln FROM documents)
      SELECT no, sub, length(regexp_replace(ln,'^{blank}+|{blank}+$','','g')) AS chars FROM l WHERE regexp_replace(ln,'^{blank}+|{blank}+$','','g')<>''"""

    sql["leaderboard"] = f"""WITH {BOARD} SELECT strftime(game_date,'%Y-%m-%d') game_date, kind,
      row_number() OVER (PARTITION BY game_date, kind ORDER BY lp DESC, row_id) AS "rank", row_id, name, lp FROM bd"""
    sql["kth_threshold"] = f"WITH {POOLS} SELECT strftime(game_date,'%Y-%m-%d') game_date, pool, pool_key, kth FROM thr"
    sql["player_history"] = f"""WITH {HISTORY} SELECT strftime(game_date,'%Y-%m-%d') game_date, name, team, lp, pool, threshold, relative_value,
      round(coalesce(cost_value,-1.0),6) cost_value, round(shown,6) shown FROM his"""
    sql["history_scale"] = f"WITH {HISTORY} SELECT name, team, round(greatest(1.0, max(abs(shown))),6) AS scale FROM his GROUP BY ALL"
    sql["daily_tiles"] = f"""WITH {BOARD},
      g AS (SELECT game_date, count(*)//2 games FROM (SELECT DISTINCT game_date, team, opponent FROM bd WHERE kind='batter') GROUP BY ALL),
      tb AS (SELECT game_date, count(*) n, max((lp, name, team)) top FROM bd WHERE kind='batter' GROUP BY ALL),
      tp AS (SELECT game_date, count(*) n, max((lp, name, team)) top FROM bd WHERE kind='pitcher' GROUP BY ALL)
      SELECT strftime(coalesce(tb.game_date, tp.game_date),'%Y-%m-%d') game_date, coalesce(games,0) games, coalesce(tb.top[1],0) top_batter_lp,
        coalesce(tb.top[2],'-') top_batter, coalesce(tb.n,0) batter_rows, coalesce(tp.top[1],0) top_pitcher_lp, coalesce(tp.top[2],'-') top_pitcher,
        coalesce(tp.n,0) pitcher_rows FROM tb FULL JOIN tp ON tb.game_date=tp.game_date LEFT JOIN g ON g.game_date=coalesce(tb.game_date, tp.game_date)"""
    sql["text_search"] = "SELECT c_name AS name, c_mktsegment AS team FROM customer WHERE contains(lower(c_name||c_mktsegment),'house')"
    sql["position_filter"] = f"""WITH {BOARD} SELECT 'first' league, row_id, position AS "position" FROM bd WHERE contains(lower(name||team),'c1') AND position='좌익수'
      UNION ALL SELECT 'second', row_id, position FROM bd WHERE contains(lower(name||team),'c1') AND position IN ('좌익수','중견수','우익수')"""
    sql["role_filter"] = f"""WITH {BOARD} SELECT row_id, name, lp FROM bd WHERE "role"='구원' AND contains(lower(name||team),'kia')"""
    sql["month_and_cost_filter"] = f"""WITH {BOARD} SELECT strftime(game_date,'%Y-%m-%d') game_date, row_id, roster_cost FROM bd
      WHERE roster_cost IS NOT NULL AND strftime(game_date,'%Y-%m')='1999-05'"""
    flat = ("2B_A", "3B_A", "HR", "WP", "BK", "SB_ALLOWED", "QSPLUS", "QS", "CG", "SHO", "NOHIT", "PERFECT")
    sql["hidden_columns"] = f"""WITH {a} SELECT game_id, side, name, {PIT_LP} lp, inn, "H", "ER", "BB"+"HBP" "BB_HBP", "K", {", ".join(q(c) for c in flat)},
      "CS_A"+"PICKOFF_A" "CS_A_PICKOFF_A" FROM pit WHERE "role"='선발'"""
    hide = {"ASSIST", "CS_CATCHER", "SB_ALLOWED_CATCHER"}
    totals = ", ".join(
        "CAST(sum(" + "+".join(f"{q(k)}*{BW[k]}" for k, _ in items if k not in hide) + f") AS BIGINT) {q(g)}"
        for g, items in BOARD_BATTER_GROUPS.items()
    )
    sql["group_board"] = f"WITH {LINE_COUNTED} SELECT name, {totals} FROM bat GROUP BY ALL"
    sql["date_facts"] = f"""WITH {BOARD} SELECT year(max(game_date)) AS "year", 'latest' fact FROM bd UNION ALL SELECT DISTINCT year(game_date), 'year' FROM bd"""

    letters = "CASE left(pos,1) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LETTER_POS.items()) + " ELSE '' END"
    named = f"""{LINE_COUNTED},{ORDER_GAMES},
      bp AS (SELECT *, {BAT_LP} lp FROM bat), ls AS (SELECT rid, side, pos, ab FROM lb),
      nb AS (SELECT bp.*, {letters} AS "position", ls.ab, og.game_date gd, CASE WHEN side='home' THEN home_name ELSE away_name END team,
        CASE WHEN side='home' THEN away_name ELSE home_name END opponent
      FROM bp JOIN ls USING (rid) JOIN og ON og.game_id=bp.game_id)"""
    export = ("H", "2B", "3B", "HR", "RBI", "R", "BB", "HBP", "K", "SB", "CS", "GDP", "SACBUNT", "E", "CYCLE", "GRANDSLAM")
    sql["batter_export"] = f"""WITH {named} SELECT row_number() OVER (PARTITION BY gd ORDER BY lp DESC, part&255, game_id, part, line, name) AS "rank", name, "position",
      team, opponent, strftime(gd,'%Y-%m-%d') game_date, lp, ab, {", ".join(q(c) for c in export)} FROM nb"""
    sql["pitcher_export"] = f"""WITH {a},{ORDER_GAMES} SELECT strftime(og.game_date,'%Y-%m-%d') game_date, CASE WHEN side='home' THEN home_name ELSE away_name END team,
      CASE WHEN side='home' THEN away_name ELSE home_name END opponent, "role", count(*) AS "rows", CAST(sum({PIT_LP}) AS BIGINT) lp, CAST(max({PIT_LP}) AS BIGINT) best
      FROM pit JOIN og USING (game_id) GROUP BY ALL"""
    team = """CASE WHEN side='home' THEN home_name ELSE away_name END team"""
    pitched = f"""pg AS (SELECT pit.*, {PIT_LP} lp, og.game_date gd, {team}, CASE WHEN side='home' THEN away_name ELSE home_name END opponent FROM pit JOIN og USING (game_id))"""
    p_export = ("H", "ER", "BB", "HBP", "K", "WP", "BK", "HOLD", "SAVE", "BLOWN", "QSPLUS", "QS", "CG", "SHO", "NOHIT", "PERFECT")
    sql["pitcher_ranked_export"] = f"""WITH {a},{ORDER_GAMES},{pitched}
      SELECT row_number() OVER (PARTITION BY gd ORDER BY lp DESC, CAST(right(game_id, 2) AS BIGINT), game_id, side, pos_idx, name, inn) AS "rank", name, "role", team, opponent,
        strftime(gd,'%Y-%m-%d') game_date, lp, inn, {", ".join(q(c) for c in p_export)} FROM pg"""
    cells = " UNION ALL ".join(
        items_sql(rows, kinds, weights, "''").replace("SELECT game_id, name,", "SELECT rid, gd, team, name,")
        for rows, kinds, weights in (
            ("(SELECT * FROM nb)", BATTER_CATEGORIES, BW),
            ("(SELECT * FROM pr WHERE \"role\"='선발')", PITCHER_CATEGORIES_SHARED + PITCHER_CATEGORIES_STARTER, PW),
            ("(SELECT * FROM pr WHERE \"role\"='구원')", PITCHER_CATEGORIES_SHARED + PITCHER_CATEGORIES_RELIEVER, PW),
        )
    ).replace("SELECT rid,", "SELECT CAST(rid AS VARCHAR) rid,")
    sql["category_cube"] = f"""WITH {named},{a},{pitched},pr AS MATERIALIZED (SELECT *, row_number() OVER () rid FROM pg),ce AS (SELECT rid, gd, team, name, category, sum(points) points FROM ({cells}) GROUP BY ALL)
      SELECT CASE WHEN grouping(name)=0 THEN 'name' WHEN grouping(team)=0 THEN 'team' ELSE 'game_date' END side, coalesce(name, team, strftime(gd,'%Y-%m-%d')) "key",
        category, count(*) AS "rows", CAST(sum(points) AS BIGINT) points FROM ce GROUP BY GROUPING SETS ((name, category), (team, category), (gd, category))"""
    sql["date_index"] = f"""WITH {named} SELECT 'kbo' league, strftime(gd,'%Y-%m-%d') game_date, count(*)//2 games FROM (SELECT DISTINCT gd, team, opponent FROM nb) GROUP BY ALL"""
    sql["date_labels"] = f"""WITH {ORDER_GAMES} SELECT strftime(game_date,'%Y-%m-%d') game_date, count(*) games, strftime(game_date,'%m월 %d일') AS label,
      strftime(game_date,'%Y-%m') AS "month", day(last_day(game_date)) days_in_month FROM og GROUP BY og.game_date"""
    counts = ", ".join(f"count(*) FILTER (pool='{s}')" for s in ROSTER_FIELD_SLOTS)
    sql["roster_feasibility"] = f"""WITH {POOL}, f AS (SELECT day, least({counts})=0 e, count(*) FILTER (pool='선발')<2 OR count(*) FILTER (pool='구원')<3 w FROM rp GROUP BY ALL)
      SELECT day, CAST(NOT e AND NOT w AS INT) feasible, CASE WHEN e THEN 'empty_slot' WHEN w THEN 'few_pitchers' ELSE '' END reason FROM f"""
    sql["optimal_roster_value"] = f"""WITH {roster_sql(40)}, bu AS (SELECT unnest([25,40]) budget)
      SELECT day, budget, v total_lp, c total_cost FROM hr, bu WHERE c<=budget QUALIFY row_number() OVER (PARTITION BY day, budget ORDER BY v DESC, c)=1"""
    sql["optimal_roster_check"] = f"""WITH {roster_sql(40)} SELECT day, v total_lp, c total_cost, 14 players, 11 slots FROM hr
      QUALIFY row_number() OVER (PARTITION BY day ORDER BY v DESC, c)=1"""

    sql["calendar_days"] = f"WITH {CALENDAR} SELECT strftime(game_date,'%Y-%m-%d') game_date, coalesce(round,'-') AS \"round\", games FROM cal"
    sql["calendar_rounds"] = f"""WITH {CALENDAR} SELECT coalesce(round,'-') AS "round", count(*) AS days, strftime(min(game_date),'%Y-%m-%d') first_day,
      strftime(max(game_date),'%Y-%m-%d') last_day FROM cal GROUP BY ALL"""
    sql["todo_dates"] = f"""WITH {CALENDAR}, dn AS (SELECT CAST(l_shipdate AS DATE) d FROM lineitem WHERE l_returnflag='A' GROUP BY ALL HAVING count(*)>=5)
      SELECT strftime(game_date,'%Y-%m-%d') game_date, round AS "round" FROM cal WHERE round IN ('kbo_r','kbo_ps_wd','kbo_ps_sp','kbo_ps_po','kbo_ps_ks')
        AND games>0 AND game_date NOT IN (SELECT d FROM dn)"""
    sql["games_of_days"] = f"WITH {ORDER_GAMES} SELECT strftime(game_date,'%Y-%m-%d') game_date, game_id FROM og WHERE NOT cancel"
    sql["active_window"] = f"""WITH {ORDER_GAMES} SELECT strftime(game_date,'%Y-%m-%d') game_date,
      CAST(TIMESTAMP '{NOW}' >= min(start_utc) - INTERVAL 2 HOUR AND bool_or(status_code<>'RESULT') AS INT) active FROM og GROUP BY game_date"""
    sql["status_gate"] = f"""WITH {ORDER_GAMES} SELECT status_code, count(*) games, 'live' gate FROM og WHERE status_code NOT IN ('BEFORE','READY') GROUP BY ALL
      UNION ALL SELECT status_code, count(*), 'finished' FROM og WHERE status_code='RESULT' GROUP BY ALL
      UNION ALL SELECT status_code, count(*), 'held' FROM og WHERE NOT cancel GROUP BY ALL
      UNION ALL SELECT status_code, count(*), 'pregame' FROM og WHERE NOT cancel AND status_code IN ('BEFORE','READY')
        AND TIMESTAMP '{NOW}' >= start_utc - INTERVAL 2 HOUR GROUP BY ALL"""
    sql["pregame_batters"] = f"""WITH {PRE} SELECT game_id, side, nm.name, nm.team, coalesce(kpos, category) AS "position", CAST(bat_order IS NOT NULL AS INT) is_starter,
      coalesce(bat_order,99) show_order, 0 lp, 0 "K" FROM nm LEFT JOIN kp ON kp.name=nm.name AND kp.team=nm.team WHERE category<>'투수'"""
    sql["pregame_pitchers"] = f"""WITH {PRE} SELECT game_id, side, name, team, CASE WHEN starts THEN '선발' ELSE '구원' END "role", CAST(starts AS INT) is_starter,
      CASE WHEN starts THEN 0 ELSE 1 END show_order, 0 "QS" FROM nm WHERE category='투수'"""
    sql["roster_pages"] = f"""SELECT {pick(b.TEAM_CODES, 'page_id')} team_code, strftime(DATE '2026-05-01' + CAST(page_id%30 AS INT),'%Y-%m-%d') game_date, name,
      arg_max({pick(b.ROSTER_ROLES, 'page_id')}, page_id) category FROM (SELECT page_id, unnest(regexp_extract_all(html,'<a href="[^"]*">([^<]+)</a>',1)) AS name FROM pages)
      WHERE page_id%5<>4 GROUP BY team_code, game_date, name"""

    live = (
        CREDITS.replace("CAST(user_id AS VARCHAR) game_id", "strftime(ts,'%Y-%m-%d')||'/'||user_id game_id")
        .replace("LEFT JOIN sd USING (game_id, h) LEFT JOIN sp USING (game_id, h)", "LEFT JOIN (SELECT * FROM sd WHERE false) sd USING (game_id, h) LEFT JOIN (SELECT * FROM sp WHERE false) sp USING (game_id, h)")
    )
    sql["live_refresh"] = f"""WITH {live} SELECT game_id, nm AS name, rl AS "role", CAST(sum(pts) AS BIGINT) points, split_part(game_id,'/',1) game_date
      FROM cr GROUP BY ALL"""
    return {name: widen(text, WIDE.get(name, ())) for name, text in sql.items()}
