"""Tweet tokenizer as one column expression.

A text is a sequence of protected spans (links, numbers, faces, tags, ...) and
plain stretches between them, which split at blanks. Both fall out of a single
pass of ``regexp_extract_all``: at each position take a protected span, or else
non-blanks up to the next span. The pattern is one literal, so it is compiled
once per task, and the whole step stays in the JVM.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes and patterns that decide where tokens begin
# and end. They must equal the published tweet tokenizer for equal results.
PUNCT_CHARS = "['\"“”‘’.?!…,:;]"
PUNCT_RUNS = "['\"“”‘’]+|[.?!,…]+|[:;]+"
ENTITY = "&(?:amp|lt|gt|quot);"
URL_START = r"(?:https?://|\bwww\.)"
TOP_DOMAINS = ("(?:com|org|edu|gov|net|mil|aero|asia|biz|cat|coop|info|int|jobs|mobi|"
               "museum|name|pro|tel|travel|xxx)")
URL_BODY = r"(?:[^\.\s<>][^\s<>]*?)?"
URL_TAIL = f"(?:{PUNCT_CHARS}+|{ENTITY}{PUNCT_CHARS}*)(?:{ENTITY}{PUNCT_CHARS}*)*"
URL_END = r"(?:\.\.+|[<>]|\s|$)"
TIME = r"\d+(?::\d+){1,2}"
NUMBER_WITH_COMMAS = r"(?:(?<!\d)\d{1,3},)+?\d{3}(?=(?:[^,\d]|$))"
NUMBER_COMBINATION = r"\p{Sc}?\d+(?:\.\d+)+%?"
NOT_DOT_BOUNDARY = rf"(?:$|\s|[“\u0022?!,:;]|{ENTITY})"
INITIALS = rf"(?:[A-Za-z]\.){{2,}}(?={NOT_DOT_BOUNDARY})"
INITIALS_NO_LAST_DOT = rf"[^A-Za-z](?:[A-Za-z]\.){{1,}}[A-Za-z](?={NOT_DOT_BOUNDARY})"
TITLES = r"\b(?:[Mm]r|[Mm]rs|[Mm]s|[Dd]r|[Ss]r|[Jj]r|[Rr]ep|[Ss]en|[Ss]t)\."
ABBREVIATION = f"(?:{INITIALS}|{INITIALS_NO_LAST_DOT}|{TITLES})"
SEPARATORS = "(?:--+|―|—|~|–|=)"
DECORATIONS = r"(?:[♫♪]+|[★☆]+|[♥❤♡]+|[\u2639-\u263b]+|[\ue001-\uebbb]+)"
IN_WORD = r"[^\s\.,?\"]"
EMBEDDED_APOSTROPHE = f"{IN_WORD}+['’′]{IN_WORD}*"
EYES = "(?:(?iu)[:=]|[;])"
NOSE = "(?:|-|[^a-zA-Z0-9 ])"
HAPPY = r"[D\)\]\}]+"
SAD = r"[\(\[\{]+"
TONGUE = "[pPd3]+"
OTHER_MOUTHS = r"(?:[oO]+|[/\\]+|[vV]+|[Ss]+|[|]+)"
AFTER_FACE = r"(?=\W|$|RT|rt|Rt)"
SAME_EYES = r"♥|0|o|°|v|\$|t|x|;|\u0CA0|@|ʘ|•|・|◕|\^|¬|\*"
LETTERED_EYES = ("0", "o", "v", "t", "x", r"\*")
CENTER = r"(?:[\.]|[_-]+)"
DASH_FACE = "(?:--['\"])"
ARROW_FACE = r"(?:<|&lt;|>|&gt;)[\._-]+(?:<|&lt;|>|&gt;)"
DOT_FACE = "(?:[.][_]+[.])"
EAST_LEFT = r"[＼\\ƪԄ\(（<>;ヽ\-=~\*]+"
EAST_RIGHT = r"[\-=\);'\u0022<>ʃ）/／ノﾉ丿╯σっµ~\*]+"
EAST_SYMBOL = r"[^A-Za-z0-9\s\(\)\*:=-]"
HEARTS = "(?:<+/?3+)+"
ARROWS = r"(?:<*[-―—=]*>+|<+[-―—=]*>*)|\p{InArrows}+"
HASHTAG = "#[a-zA-Z0-9_]+"
MENTION = "[@＠][a-zA-Z0-9_]+"
BOUND = r"(?:\W|^|$)"
EMAIL = rf"(?<={BOUND})[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{{2,4}}(?={BOUND})"
EDGE_PUNCT = r"['\"“”‘’«»{}\(\)\[\]\*&]"
EDGE_CONTENT = "[a-zA-Z0-9]"
OFF_EDGE = r"(^|$|:|;|\s|\.|,)"
# Country domains.
COUNTRIES = tuple("""
    ac ad ae af ag ai al am an ao aq ar as at au aw ax az ba bb bd be bf bg bh bi bj bm bn
    bo br bs bt bv bw by bz ca cc cd cf cg ch ci ck cl cm cn co cr cs cu cv cx cy cz dd de
    dj dk dm do dz ec ee eg eh er es et eu fi fj fk fm fo fr ga gb gd ge gf gg gh gi gl gm
    gn gp gq gr gs gt gu gw gy hk hm hn hr ht hu id ie il im in io iq ir is it je jm jo jp
    ke kg kh ki km kn kp kr kw ky kz la lb lc li lk lr ls lt lu lv ly ma mc md me mg mh mk
    ml mm mn mo mp mq mr ms mt mu mv mw mx my mz na nc ne nf ng ni nl no np nr nu nz om pa
    pe pf pg ph pk pl pm pn pr ps pt pw py qa re ro rs ru rw sa sb sc sd se sg sh si sj sk
    sl sm sn so sr ss st su sv sy sz tc td tf tg th tj tk tl tm tn to tp tr tt tv tw tz ua
    ug uk us uy uz va vc ve vg vi vn vu wf ws ye yt za zm zw
""".split())


def _same_face(eyes: list[str], center: str = CENTER) -> str:
    """Two equal eyes around a centre, in either case of a letter."""
    return "|".join(f"(?i:{eye}{center}{eye})" for eye in eyes)


def _eastern_face() -> str:
    """Brackets around a run of small faces and symbols, in one way and without recursion.

    A small face of symbols alone is also a run of symbols, so only faces that hold a letter,
    digit, star or dash are told apart. The run is taken possessively. Either a closing bracket
    follows it, or the face ends at the last place in it where one can stand: at a symbol that
    closes, at a small face that begins with one, or at the dash inside a small face.
    """
    eyes = SAME_EYES.split("|")
    lettered = _same_face([eye for eye in eyes if eye in LETTERED_EYES])
    plain_eyes = [eye for eye in eyes if eye not in LETTERED_EYES]
    dashed = _same_face(plain_eyes, "_*-[_-]*")
    arrow = rf"(?:(?=[<>][._]*+-)|(?=&[lg]t;|[<>][._-]++&)){ARROW_FACE}"
    rest = f"{lettered}|{DASH_FACE}|{arrow}"
    closes = EAST_RIGHT.removesuffix("+")
    place = f"(?:{dashed}|(?={closes})(?:{rest}|{EAST_SYMBOL}))"
    other = f"(?:(?!{place})(?:{rest}|{EAST_SYMBOL}))*+"
    item = f"(?:{dashed}|{rest}|{EAST_SYMBOL})"
    last = f"(?:(?:{'|'.join(plain_eyes)})_*+(?=-))?+{EAST_RIGHT}"
    return (f"{EAST_LEFT}(?:{item}++{EAST_RIGHT}"
            f"|{item}(?:{other}{place}(?={other}{place}))*+{other}{last}"
            f"|(?:{'|'.join(plain_eyes)})_*+(?=-){EAST_RIGHT})")


def protected_span(countries: tuple[str, ...], inside: bool = False) -> str:
    """Alternatives in order of preference.

    ``inside`` is for a position right after a plain character, where some spans
    cannot begin because they would have begun one character earlier: a word with
    an apostrophe, a digit run after a digit, a face after a left bracket. Leaving them out there keeps the
    work linear on very long words.
    """
    country = f"(?:{'|'.join(countries)})"
    bare_host = (rf"\b(?:[A-Za-z\d-])+(?:\.[A-Za-z0-9]+){{0,3}}\."
                 rf"(?:{TOP_DOMAINS}|{country})(?:\.{country})?(?=\W|$)")
    url = f"(?:{URL_START}|{bare_host}){URL_BODY}(?=(?:{URL_TAIL})?{URL_END})"
    western = (f"(?:>|&gt;)?{EYES}(?:{NOSE}|[Oo])"
               f"(?:{TONGUE}{AFTER_FACE}|{OTHER_MOUTHS}{AFTER_FACE}|{SAD}|{HAPPY})")
    mirrored = f"(?<=(?: |^))(?:{SAD}|{HAPPY}|{OTHER_MOUTHS}){NOSE}{EYES}(?:<|&lt;)?"
    run_start = r"(?<!\d)" if inside else ""
    face_start = f"(?<!{EAST_LEFT[:-1]})" if inside else ""
    eastern = face_start + _eastern_face()
    small = f"{_same_face(SAME_EYES.split('|'))}|{DASH_FACE}|{ARROW_FACE}|{DOT_FACE}"
    emoticon = f"(?:{western}|{mirrored}|{eastern}|{small})"
    return "(?:" + "|".join([
        HEARTS, url, EMAIL, run_start + TIME, NUMBER_WITH_COMMAS,
        run_start + NUMBER_COMBINATION, emoticon, ARROWS, ENTITY, PUNCT_RUNS, ABBREVIATION,
        SEPARATORS, DECORATIONS, *([] if inside else [EMBEDDED_APOSTROPHE]),
        HASHTAG, MENTION]) + ")"


def token_pattern(countries: tuple[str, ...]) -> str:
    """A protected span, or non-blanks up to the next one.

    Shortcuts decide the common cases without trying every span: a whole word of
    letters (but no title such as ``Dr.``), a lone comma or full stop after a letter,
    and a letter other than ``h`` between letters. A blank can only begin initials
    without a last dot. The possessive repeat keeps the matcher iterative on words of
    any length.
    """
    plain_word = rf"(?<![^ ])(?!{TITLES})[A-Za-z]++(?=[.,]?(?: |$))"
    lone_stop = "(?<=[A-Za-z])[.,](?= |$)"
    not_blank = r"(?! (?![A-Za-z]\.))"
    plain_letter = "(?<=[A-Za-z])[A-Za-gi-z](?=[A-Za-z])"
    inside = protected_span(countries, inside=True)
    return (f"{plain_word}|{lone_stop}|{not_blank}{protected_span(countries)}"
            rf"|\S(?:{plain_letter}|(?!{inside})\S)*+")


def unescape_html(text: Column) -> Column:
    """Decode ``&amp;`` first, then named and numeric references; rest unchanged."""
    text = F.replace(text, F.lit("&amp;"), F.lit("&"))
    named = F.create_map(*[F.lit(v) for name, code in sorted(name2codepoint.items())
                           for v in (name, chr(code))])

    def from_code(hex_digits: Column) -> Column:
        return F.decode(F.unhex(F.lpad(hex_digits, 8, "0")), "UTF-32")

    def piece(p: Column) -> Column:
        name = F.regexp_extract(p, "^&(#?[A-Za-z0-9]+);$", 1)
        return (F.when(name == "", p)
                .when(name.rlike("^#0*[0-9]{1,5}$"),
                      from_code(F.conv(F.substring(name, 2, 20), 10, 16)))
                .when(name.rlike("^#[xX]0*[0-9a-fA-F]{1,4}$"), from_code(F.substring(name, 3, 20)))
                .otherwise(F.coalesce(F.try_element_at(named, name), p)))

    pieces = F.regexp_extract_all(text, F.lit("&#?[A-Za-z0-9]+;|[^&]+|&"), F.lit(0))
    decoded = F.array_join(F.transform(pieces, piece), "")
    return F.when(text.rlike("&#?[A-Za-z0-9]+;"), decoded).otherwise(text)


def squeeze_blanks(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\s\p{Zs}]+", " "))


def split_edge_punctuation(text: Column) -> Column:
    """Detach quotes and brackets at word edges, first left, then right."""
    text = F.regexp_replace(text, f"{OFF_EDGE}({EDGE_PUNCT}+)({EDGE_CONTENT})", "$1$2 $3")
    return F.regexp_replace(text, f"({EDGE_CONTENT})({EDGE_PUNCT}+){OFF_EDGE}", "$1 $2$3")


def tweet_tokens(text: Column | str, countries: tuple[str, ...] | None = None) -> Column:
    """Tokens of a raw, HTML-escaped post in order of appearance; NULL stays NULL."""
    text = F.col(text) if isinstance(text, str) else text
    pattern = token_pattern(tuple(countries) if countries else COUNTRIES)
    ready = split_edge_punctuation(squeeze_blanks(unescape_html(text)))
    found = F.regexp_extract_all(ready, F.lit(pattern), F.lit(0))
    blanks = F.lit("".join(chr(c) for c in range(33)))
    return F.filter(F.transform(found, lambda t: F.btrim(t, blanks)), lambda t: t != "")
