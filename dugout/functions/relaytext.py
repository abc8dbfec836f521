"""Play-by-play lines: kind, names, outcome class, tags and fielding chain."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from dugout.functions.text import strip
from dugout.model import FIELD_POSITIONS, OUTFIELD, PITCHER

# Line formats, first league.
MARK = r"^(\d+)회(초|말) (.+) 공격$"
SUBSTITUTION = r"^(.+?) : (\S+) (\S+) \(으\)로 교체$"
STEAL = r"^[123]루주자 (\S+) : 도루로 (?:([123])루까지 진루|(홈인))$"
RUN = r"^([123])루주자 (\S+) : .*홈인$"
CAUGHT = r"^[123]루주자 (\S+) : 도루실패아웃 \(([^)]+)\)$"
PICKOFF = r"^[123]루주자 (\S+) : 견제사아웃 \((투수|포수) 견제"
RUNNER_OUT = r"^[123]루주자 \S+ : (?:포스아웃|태그아웃) \(([^)]+)\)$"
PLAY = r"^(\S+?) : (.+)$"
LAST_PARENTHESIS = r"\(([^)]+)\)$"
CHAIN_SUFFIX = r"\s*(?:[123]루\s*)?(?:송구아웃|터치아웃|포구아웃|태그아웃)$"
PLAIN_ADVANCE = r"^[123]루주자 \S+ : (?:[123]루까지 진루|홈인)$"
PLAIN_HOME = r"^[123]루주자 \S+ : 홈인$"
ADVANCE_MARKERS = ("폭투", "도루", "실책", "보크", "낫")

# Line formats, second league.
SUBSTITUTION_B = r"^투수 (\S+) : (\S+) \(으\)로 교체$"
STEAL_B = r"^[123]루주자 (\S+) : 도루로 (?:[123]루까지 진루|홈인)$"
CAUGHT_B = r"^[123]루주자 (\S+) : 도루실패\s?아웃"
PICKOFF_B = r"^[123]루주자 (\S+) : 견제사\s?아웃"
ERROR_B = r"(\S+수) 실책"
ADVANCE_MARKERS_B = ("폭투", "도루", "실책", "보크")

# Counters set by each outcome class.
CLASS_TAGS = {
    "HR": ("H", "HR"), "3B": ("H", "3B"), "2B": ("H", "2B"), "1B": ("H",),
    "HBP": ("HBP",), "BB": ("BB",), "K": ("K",), "GDP": ("GDP", "GO"),
    "SACFLY": ("SACFLY", "FO"), "SACBUNT": ("GO", "SACBUNT"),
    "GO": ("GO",), "LD": ("LD",), "FO": ("FO",),
}
NO_CLASS = "NONE"


def _group(text: Column, pattern: str, index: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, index), F.lit(""))


def is_mark(text: Column) -> Column:
    return text.endswith("공격") & text.rlike(MARK)


def is_substitution(text: Column) -> Column:
    return text.endswith("교체") & text.rlike(SUBSTITUTION)


def line_kind(text: Column) -> Column:
    """First format that fits, in the order the rules are tried.

    A literal every match must hold is looked for first; that is far cheaper than the pattern.
    """
    return (
        F.when(is_mark(text), "mark")
        .when(is_substitution(text), "sub")
        .when(text.contains("도루로") & text.rlike(STEAL), "steal")
        .when(text.endswith("홈인") & text.rlike(RUN), "run")
        .when(text.contains("도루실패아웃") & text.rlike(CAUGHT), "caught")
        .when(text.contains("견제사아웃") & text.rlike(PICKOFF), "pickoff")
        .when((text.contains("포스아웃") | text.contains("태그아웃")) & text.rlike(RUNNER_OUT), "runner_out")
        .when(text.rlike(PLAY), "play")
        .otherwise("other")
    )


def is_plain_home(text: Column) -> Column:
    return text.endswith("홈인") & text.rlike(PLAIN_HOME)


def line_name(text: Column, kind: Column) -> Column:
    """Runner, batter or incoming player named by the line."""
    return (
        F.when(kind == "sub", F.regexp_extract(text, SUBSTITUTION, 3))
        .when(kind == "steal", F.regexp_extract(text, STEAL, 1))
        .when(kind == "run", F.regexp_extract(text, RUN, 2))
        .when(kind == "caught", F.regexp_extract(text, CAUGHT, 1))
        .when(kind == "pickoff", F.regexp_extract(text, PICKOFF, 1))
        .when(kind == "play", F.regexp_extract(text, PLAY, 1))
    )


def line_label(text: Column, kind: Column) -> Column:
    """Incoming position of a substitution."""
    return F.when(kind == "sub", F.regexp_extract(text, SUBSTITUTION, 2))


def run_base(text: Column, kind: Column) -> Column:
    """Base the scoring runner stood on; a steal of home starts from third."""
    return F.when(kind == "run", F.regexp_extract(text, RUN, 1).cast("int")).when(
        (kind == "steal") & _group(text, STEAL, 3).isNotNull(), F.lit(3)
    )


def play_desc(text: Column, kind: Column) -> Column:
    return F.when(kind == "play", F.regexp_extract(text, PLAY, 2))


def play_class(desc: Column) -> Column:
    """Outcome class of a play description."""

    def says(*words: str) -> Column:
        found = desc.contains(words[0])
        for word in words[1:]:
            found = found | desc.contains(word)
        return found

    return (
        F.when(says("실책") & says("출루"), NO_CLASS)
        .when(says("홈런"), "HR")
        .when(says("3루타"), "3B")
        .when(says("2루타"), "2B")
        .when(says("1루타", "안타"), "1B")
        .when(says("몸에 맞는"), "HBP")
        .when(says("볼넷", "고의4구"), "BB")
        .when(says("삼진", "낫아웃", "낫 아웃"), "K")
        .when(says("병살"), "GDP")
        .when(says("희생플라이"), "SACFLY")
        .when(says("희생번트"), "SACBUNT")
        .when(says("땅볼"), "GO")
        .when(says("라인드라이브"), "LD")
        .when(says("플라이"), "FO")
        .when(says("번트"), NO_CLASS)
        .when(says("아웃"), "GO")
        .otherwise(NO_CLASS)
    )


def has_tag(play: Column, tag: str) -> Column:
    return play.isin(*[c for c, tags in CLASS_TAGS.items() if tag in tags])


def class_tags(play: Column) -> Column:
    """Counters of a class as MAP<STRING,INT>."""
    out = None
    for name, tags in CLASS_TAGS.items():
        value = F.create_map(*[x for t in tags for x in (F.lit(t), F.lit(1))])
        out = F.when(play == name, value) if out is None else out.when(play == name, value)
    return out


def class_points(play: Column, weights: dict[str, int]) -> Column:
    out = None
    for name, tags in CLASS_TAGS.items():
        value = F.lit(sum(weights.get(t, 0) for t in tags))
        out = F.when(play == name, value) if out is None else out.when(play == name, value)
    return out.otherwise(F.lit(0))


def is_bunt_out(desc: Column) -> Column:
    return (
        desc.contains("번트") & ~desc.contains("희생번트") & ~desc.contains("안타")
        & desc.contains("아웃")
    )


def is_productive_out(desc: Column) -> Column:
    return (desc.contains("땅볼") | desc.contains("희생번트")) & ~desc.contains("병살")


def is_unmarked_advance(text: Column, markers: tuple[str, ...] = ADVANCE_MARKERS) -> Column:
    marked = F.lit(False)
    for marker in markers:
        marked = marked | text.contains(marker)
    likely = text.endswith("진루") | text.endswith("홈인")
    return likely & ~marked & text.rlike(PLAIN_ADVANCE)


def chain_positions(chain: Column) -> Column:
    """Fielders named in a chain, in throwing order."""
    parts = F.split(F.regexp_replace(chain, CHAIN_SUFFIX, ""), "->")
    return F.filter(F.transform(parts, strip), lambda p: p.isin(*FIELD_POSITIONS, PITCHER))


def play_chain(desc: Column) -> Column:
    """Chain of a batter's play; a lone fielder is no chain."""
    positions = chain_positions(_group(desc, LAST_PARENTHESIS, 1))
    return F.when(F.size(positions) >= 2, positions)


def runner_out_chain(text: Column) -> Column:
    """Chain of a runner put out on base; here a lone fielder counts."""
    positions = chain_positions(_group(text, RUNNER_OUT, 1))
    return F.when(F.size(positions) >= 1, positions)


def assist_position(chain: Column) -> Column:
    """The one who threw last, or the only one."""
    return F.when(F.size(chain) >= 2, F.element_at(chain, -2)).otherwise(F.element_at(chain, 1))


def assist_tag(position: Column) -> Column:
    return F.when(position.isin(*OUTFIELD), "OF_ASSIST").otherwise("ASSIST")


def line_kind_b(text: Column) -> Column:
    """Second league. An error line falls through to ``play``; see :func:`error_position_b`."""
    return (
        F.when(text.endswith("교체") & text.rlike(SUBSTITUTION_B), "sub")
        .when(text.contains("도루로") & text.rlike(STEAL_B), "steal")
        .when(text.contains("도루실패") & text.rlike(CAUGHT_B), "caught")
        .when(text.contains("견제사") & text.rlike(PICKOFF_B), "pickoff")
        .when(text.rlike(PLAY), "play")
        .otherwise("other")
    )


def line_name_b(text: Column, kind: Column) -> Column:
    return (
        F.when(kind == "sub", F.regexp_extract(text, SUBSTITUTION_B, 2))
        .when(kind == "steal", F.regexp_extract(text, STEAL_B, 1))
        .when(kind == "caught", F.regexp_extract(text, CAUGHT_B, 1))
        .when(kind == "pickoff", F.regexp_extract(text, PICKOFF_B, 1))
        .when(kind == "play", F.regexp_extract(text, PLAY, 1))
    )


def error_position_b(text: Column, kind: Column) -> Column:
    """Position charged with an error on a line that is a play or nothing else."""
    return F.when(
        kind.isin("play", "other") & text.contains("수 실책") & ~text.contains("견제실책"), _group(text, ERROR_B, 1)
    )
