"""Schemas, scoring weights and lookup values shared by every operator."""

from __future__ import annotations


# ---------------------------------------------------------------------------
# Points per counter. They must equal the published scoring rules.
# ---------------------------------------------------------------------------
BATTER_WEIGHTS = {
    "R": 15, "H": 10, "BB": 10, "2B": 15, "3B": 30, "HR": 80, "RBI": 25,
    "FO": -10, "GO": -10, "GDP": -25, "SACFLY": 10, "SACBUNT": 10, "SB": 30, "CS": -15,
    "HBP": 5, "K": -15, "PICKOFF": -10, "CYCLE": 50, "GRANDSLAM": 10, "E": -10,
    "ASSIST": 1, "DP_FIELD": 10, "TP_FIELD": 50, "OF_ASSIST": 30,
    "CS_CATCHER": 40, "SB_ALLOWED_CATCHER": -10,
}
PITCHER_WEIGHTS = {
    "H": -10, "2B_A": -10, "3B_A": -15, "HR": -40, "ER": -10, "BB": -10, "HBP": -10, "WP": -20,
    "OUT": 10, "K": 15, "BK": -50, "QS": 20, "QSPLUS": 30,
    "INHERITED_SCORED": -5, "INHERITED_STRANDED": 5,
    "CS_A": 10, "SB_ALLOWED": -10, "PICKOFF_A": 10,
    "HOLD": 20, "SAVE": 30, "BLOWN": -10, "PERFECT": 100, "NOHIT": 70,
    "SHO": 30, "CG": 15,
}

# Counters that count once however often they occur in a game.
BATTER_ONCE = ("CYCLE", "DP_FIELD", "TP_FIELD")
# Of each pair only the first that holds is paid.
PITCHER_EXCLUSIVE = (("QSPLUS", "QS"), ("PERFECT", "NOHIT"), ("SHO", "CG"))

BATTER_COUNTERS = (
    "R", "H", "BB", "2B", "3B", "HR", "RBI", "FO", "GO", "LD", "GDP", "SACFLY", "SACBUNT",
    "SB", "CS", "HBP", "K", "PICKOFF", "CYCLE", "GRANDSLAM", "E",
    "ASSIST", "OF_ASSIST", "DP_FIELD", "TP_FIELD", "CS_CATCHER", "SB_ALLOWED_CATCHER",
    "ADVANCE_OUT",
)
PITCHER_COUNTERS = (
    "H", "HR", "ER", "BB", "HBP", "K", "OUT", "WP", "BK", "QS", "QSPLUS",
    "HOLD", "SAVE", "BLOWN", "PERFECT", "NOHIT", "SHO", "CG",
    "2B_A", "3B_A", "INHERITED_SCORED", "INHERITED_STRANDED",
    "CS_A", "SB_ALLOWED", "PICKOFF_A", "SAVE_OPP",
)
PITCHER_FLAGS = ("QS", "QSPLUS", "PERFECT", "NOHIT", "SHO", "CG", "SAVE_OPP")
BATTER_FLAGS = ("CYCLE",)
FIELD_COUNTERS = (
    "ASSIST", "OF_ASSIST", "DP_FIELD", "TP_FIELD", "CS_CATCHER", "SB_ALLOWED_CATCHER",
)

# ---------------------------------------------------------------------------
# Category groups, as (group, label, counter, is_flag).
# ---------------------------------------------------------------------------
BATTER_CATEGORIES = (
    ("출루", "안타", "H", False), ("출루", "볼넷", "BB", False), ("출루", "사구", "HBP", False),
    ("장타", "2루타", "2B", False), ("장타", "3루타", "3B", False), ("장타", "홈런", "HR", False),
    ("장타", "만루홈런", "GRANDSLAM", False), ("장타", "사이클히트", "CYCLE", True),
    ("팀배팅", "타점", "RBI", False), ("팀배팅", "희생번트", "SACBUNT", False),
    ("팀배팅", "희생플라이", "SACFLY", False),
    ("주루", "도루", "SB", False), ("주루", "도루실패", "CS", False),
    ("주루", "견제사", "PICKOFF", False), ("주루", "득점", "R", False),
    ("수비", "보살", "ASSIST", False), ("수비", "외야수 보살", "OF_ASSIST", False),
    ("수비", "병살 가담", "DP_FIELD", False), ("수비", "삼중살 가담", "TP_FIELD", False),
    ("수비", "도루 저지(포수)", "CS_CATCHER", False),
    ("수비", "도루 허용(포수)", "SB_ALLOWED_CATCHER", False), ("수비", "실책", "E", False),
    ("아웃", "삼진", "K", False), ("아웃", "땅볼 아웃", "GO", False),
    ("아웃", "뜬공 아웃(파울플라이 포함)", "FO", False), ("아웃", "직선타", "LD", False),
    ("아웃", "견제사+도루실패", "PICKOFF+CS", False), ("아웃", "병살타", "GDP", False),
)
PITCHER_CATEGORIES_SHARED = (
    ("기본", "아웃카운트", "OUT", False), ("기본", "자책점", "ER", False), ("기본", "탈삼진", "K", False),
    ("출루허용", "피안타", "H", False), ("출루허용", "볼넷", "BB", False), ("출루허용", "사구", "HBP", False),
    ("장타허용", "피2루타", "2B_A", False), ("장타허용", "피3루타", "3B_A", False),
    ("장타허용", "피홈런", "HR", False),
    ("주자억제", "도루 허용", "SB_ALLOWED", False), ("주자억제", "도루 저지", "CS_A", False),
    ("주자억제", "견제사", "PICKOFF_A", False), ("주자억제", "폭투", "WP", False),
    ("주자억제", "보크", "BK", False),
)
PITCHER_CATEGORIES_STARTER = (
    ("선발 특별", "퀄리티스타트+", "QSPLUS", True), ("선발 특별", "퀄리티스타트", "QS", True),
    ("선발 특별", "완투", "CG", True), ("선발 특별", "완봉", "SHO", True),
    ("선발 특별", "노히트", "NOHIT", True), ("선발 특별", "퍼펙트게임", "PERFECT", True),
)
PITCHER_CATEGORIES_RELIEVER = (
    ("주자억제", "승계주자 수", "INHERITED_SCORED+INHERITED_STRANDED:info", False),
    ("주자억제", "승계주자 실점 허용", "INHERITED_SCORED", False),
    ("주자억제", "승계주자 실점 막음", "INHERITED_STRANDED", False),
    ("구원 특별", "세이브 기회", "SAVE_OPP:info", True),
    ("구원 특별", "홀드", "HOLD", True), ("구원 특별", "세이브", "SAVE", True),
    ("구원 특별", "블론 세이브", "BLOWN", True),
)
# The table view groups both pitcher roles together.
BOARD_BATTER_GROUPS = {
    "출루": (("H", False), ("BB", False), ("HBP", False)),
    "장타": (("2B", False), ("3B", False), ("HR", False), ("GRANDSLAM", False), ("CYCLE", True)),
    "팀배팅": (("RBI", False), ("SACBUNT", False), ("SACFLY", False)),
    "주루": (("SB", False), ("CS", False), ("PICKOFF", False), ("R", False)),
    "수비": (("ASSIST", False), ("OF_ASSIST", False), ("DP_FIELD", False), ("TP_FIELD", False),
           ("CS_CATCHER", False), ("SB_ALLOWED_CATCHER", False), ("E", False)),
    "아웃": (("FO", False), ("GO", False), ("GDP", False), ("K", False)),
}
BOARD_PITCHER_GROUPS = {
    "기본": (("OUT", False), ("ER", False), ("K", False)),
    "출루허용": (("H", False), ("BB", False), ("HBP", False)),
    "장타허용": (("2B_A", False), ("3B_A", False), ("HR", False)),
    "주자억제": (("SB_ALLOWED", False), ("CS_A", False), ("PICKOFF_A", False), ("WP", False),
             ("BK", False), ("INHERITED_SCORED", False), ("INHERITED_STRANDED", False)),
    "특별": (("QSPLUS", True), ("QS", True), ("CG", True), ("SHO", True), ("NOHIT", True),
           ("PERFECT", True), ("HOLD", True), ("SAVE", True), ("SAVE_OPP", True), ("BLOWN", True)),
}

# ---------------------------------------------------------------------------
# Positions, codes and names.
# ---------------------------------------------------------------------------
FIELD_CHARS = {
    "一": "1루수", "二": "2루수", "三": "3루수", "유": "유격수",
    "좌": "좌익수", "중": "중견수", "우": "우익수", "포": "포수",
}
FIELD_POSITIONS = tuple(FIELD_CHARS.values())
OUTFIELD = ("좌익수", "중견수", "우익수")
INFIELD = ("1루수", "2루수", "3루수", "유격수")
CATCHER = "포수"
PITCHER = "투수"
DH = "지명타자"
UNKNOWN_POSITION = "미상"
STARTER = "선발"
RELIEVER = "구원"
ROSTER_CATEGORIES = ("투수", "포수", "내야수", "외야수")
ROSTER_FIELD_SLOTS = ("포수", "1루수", "2루수", "3루수", "유격수", "좌익수", "중견수", "우익수")
COST_POSITION_NAMES = {
    "1B": "1루수", "2B": "2루수", "3B": "3루수", "SS": "유격수", "C": "포수",
    "LF": "좌익수", "CF": "중견수", "RF": "우익수", "DH": "지명타자",
}
COST_PITCHER_CODES = ("SP", "P")
TEAMS = ("KIA", "삼성", "LG", "KT", "두산", "SSG", "한화", "롯데", "NC", "키움")
SEASON_ROUNDS = ("kbo_r", "kbo_ps_wd", "kbo_ps_sp", "kbo_ps_po", "kbo_ps_ks")
OUTFIELD_NORMALISED = ("LF", "CF", "RF", "외야수", "좌익수", "중견수", "우익수")
NON_FIELDING_B = ("대타", "대주자", "지명타자")  # second league: not a starting fielder

# League settings that change a rule.
LEAGUE_RULES = {
    "kbo": {"qsplus_er": 2, "perfect_counts_hbp": True},
    "mlb": {"qsplus_er": 3, "perfect_counts_hbp": False},
}

# ---------------------------------------------------------------------------
# Table schemas.
# ---------------------------------------------------------------------------
GAMES = (
    "game_id STRING, league STRING, game_date DATE, game_datetime STRING, status_code STRING, "
    "cancel BOOLEAN, home_team_code STRING, away_team_code STRING, home_team_name STRING, "
    "away_team_name STRING, round_code STRING, game_seq INT"
)
BOX_BATTERS = (
    "game_id STRING, side STRING, pos_idx INT, player_code STRING, name STRING, pos STRING, "
    "substitute_in BOOLEAN, ab INT, hit INT, run INT, rbi INT, hr INT, bb INT, kk INT, sb INT, "
    "hbp INT, pa_codes ARRAY<STRING>"
)
BOX_PITCHERS = (
    "game_id STRING, side STRING, pos_idx INT, name STRING, inn STRING, hit INT, r INT, er INT, "
    "hr INT, bb INT, bbhp INT, kk INT, wls STRING"
)
TEAM_PITCHING = ("game_id STRING, side STRING, inn STRING")
ETC_RECORDS = ("game_id STRING, idx INT, how STRING, result STRING")
RELAY_EVENTS = (
    "game_id STRING, no INT, sub INT, inn INT, half STRING, out INT, base ARRAY<STRING>, "
    "home_score INT, away_score INT, text STRING"
)
POSITIONS = (
    "player_code STRING, name STRING, team STRING, innings_by_position MAP<STRING,DOUBLE>, "
    "games BIGINT, auto_position STRING, manual_position STRING, effective_position STRING"
)
COST_LIST = ("hint STRING, position STRING, name STRING, cost STRING")
CALENDAR = ("game_date DATE, round STRING, game_ids ARRAY<STRING>")
ROSTER = ("team_code STRING, game_date DATE, name STRING, category STRING")
LINEUPS = (
    "game_id STRING, side STRING, name STRING, bat_order INT, is_starting_pitcher BOOLEAN"
)
