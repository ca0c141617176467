"""Text clean-up as column expressions; nothing here leaves the JVM."""

from __future__ import annotations

import unicodedata
from functools import lru_cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from adlens import fixed_values as fv

_PAIR, _KEY = "\x01", "\x02"

# runs of white space but single blanks, which are right already and stand behind nearly every word
_RUN = f" {fv.WHITESPACE}+|{fv.WHITESPACE.replace(r'\x20', r'\x1f')}{fv.WHITESPACE}*"


def null_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def first_filled(*columns: Column) -> Column:
    """First value that is neither NULL nor the empty text."""
    return F.coalesce(*[null_if_empty(c) for c in columns])


def filled(c: Column) -> Column:
    """A plain column with the empty text as NULL."""
    return F.when(c != "", c)


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def squeeze(c: Column) -> Column:
    """Collapse every run of Unicode white space to one blank and trim.

    Most texts are clean printable ASCII, and seeing that is much cheaper than replacing.
    """
    collapsed = F.trim(F.regexp_replace(c, _RUN, " "))
    return F.when(c.rlike(fv.CLEAN_TEXT), c).otherwise(collapsed)


def match_or_null(c: Column, pattern: str, group: int = 1) -> Column:
    """First match of a pattern; NULL where it does not match (or matches nothing)."""
    return null_if_empty(F.regexp_extract(c, pattern, group))


def match_in(c: Column, pattern: str, group: int = 1) -> Column:
    """:func:`match_or_null` inside ``bind`` and other lambdas, where Spark writes ``nullif`` out and matches twice."""
    return F.get(F.filter(F.array(F.regexp_extract(c, pattern, group)), lambda found: found != ""), F.lit(0))


def literal_map(entries: dict[str, str]) -> Column:
    """A constant lookup map, folded by the optimizer into one literal."""
    packed = _PAIR.join(f"{k}{_KEY}{v}" for k, v in entries.items())
    return F.str_to_map(F.lit(packed), F.lit(_PAIR), F.lit(_KEY))


def plain_blanks(c: Column) -> Column:
    """No-break spaces as blanks; a byte search, far cheaper than ``translate`` on long texts."""
    return F.replace(c, F.lit("\u00a0"), F.lit(" "))


def lookup(entries: dict[str, str], key: Column) -> Column:
    return F.try_element_at(literal_map(entries), key)


def undo_mojibake(c: Column) -> Column:
    suspicious = F.contains(c, F.lit("Ã")) | F.contains(c, F.lit("â"))
    listed = ", ".join(f"named_struct('broken', '{b}', 'good', '{g}')" for b, g in fv.MOJIBAKE.items())
    pairs = F.expr(f"array({listed})")
    fixed = F.aggregate(pairs, c, lambda text, pair: F.replace(text, pair["broken"], pair["good"]))
    return F.when(suspicious, fixed).otherwise(c)


def repair(c: Column) -> Column:
    """Undo the fixed set of wrongly decoded characters; empty text becomes NULL."""
    return bind(bind(squeeze(c), undo_mojibake), filled)


def title_case(c: Column) -> Column:
    """Capital after every character without case, small letters elsewhere.

    ``initcap`` starts words at blanks only, so a marked blank is put after each
    such character and taken out again.
    """
    marked = F.regexp_replace(c, r"([^\p{Lu}\p{Ll}\p{Lt}])", "$1\x03 ")
    return F.replace(F.initcap(marked), F.lit("\x03 "), F.lit(""))


def place_name(c: Column) -> Column:
    return bind(repair(c), title_case)


@lru_cache(maxsize=1)
def accent_tables() -> tuple[str, str, dict[str, str]]:
    """Folding tables derived from the Unicode database.

    Returns (characters to translate, their replacements, wider expansions). Characters
    past the end of the replacements are combining marks, which ``translate`` deletes.
    """
    single, marks, wide = {}, [], {}
    for code in range(0x80, 0x110000):
        if 0xD800 <= code <= 0xDFFF:
            continue
        ch = chr(code)
        if not unicodedata.decomposition(ch) and not unicodedata.combining(ch):
            continue
        bare = "".join(
            part for part in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(part)
        )
        if not bare:
            marks.append(ch)
        elif bare != ch and any(part.isascii() and part.isalnum() for part in bare):
            if len(bare) == 1:
                single[ch] = bare
            else:
                wide[ch] = bare
    return "".join(single) + "".join(marks), "".join(single.values()), wide


def ranges(characters) -> str:
    """Neighbouring characters as ranges of a character class: every entry of a class costs at every character."""
    runs: list[list[int]] = []
    for code in sorted(ord(ch) for ch in characters):
        if runs and code == runs[-1][1] + 1:
            runs[-1][1] = code
        else:
            runs.append([code, code])
    return "".join(f"\\x{{{low:x}}}-\\x{{{high:x}}}" for low, high in runs)


def fold_accents(c: Column) -> Column:
    """Compatibility decomposition without combining marks, for letters and digits."""
    source, target, wide = accent_tables()
    spelled = F.array_join(
        F.transform(F.split(c, ""), lambda ch: F.coalesce(lookup(wide, ch), ch)), ""
    )
    # one look at the span of all of them passes over almost every character
    span = rf"\x{{{min(map(ord, wide)):x}}}-\x{{{max(map(ord, wide)):x}}}"
    has_wide = c.rlike(f"(?=[{span}])[{ranges(wide)}]")
    return F.translate(F.when(has_wide, spelled).otherwise(c), source, target)


def dashed(repaired: Column) -> Column:
    """Slug of a repaired text; the empty text if nothing is left."""
    plain = F.when(repaired.rlike(r"[^\x00-\x7f]"), fold_accents(repaired)).otherwise(repaired)
    return F.btrim(F.regexp_replace(F.lower(plain), "[^a-z0-9]+", "-"), F.lit("-"))


def slug(c: Column) -> Column:
    """Key form of a text: no accents, small letters, single dashes; NULL if nothing is left."""
    return bind(bind(repair(c), dashed), filled)


def slug_of_literal(text: str) -> str:
    """Driver-side twin of :func:`slug` for the constant lists."""
    bare = "".join(
        ch for ch in unicodedata.normalize("NFKD", text) if not unicodedata.combining(ch)
    ).lower()
    kept = "".join(ch if ch.isascii() and ch.isalnum() else " " for ch in bare)
    return "-".join(kept.split())


@lru_cache(maxsize=1)
def _entity_tables() -> tuple[dict[str, str], str]:
    closed = {name[:-1]: text for name, text in html5.items() if name.endswith(";")}
    open_names = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
    return closed, "|".join(open_names)


def _code_point(value: Column) -> Column:
    """Character for a numeric reference, with the standard's replacements."""
    control = {code: bytes([code]).decode("cp1252", errors="replace") for code in range(0x80, 0xA0)}
    legacy = {str(code): ch for code, ch in control.items() if ch != "�"}
    bad = value.isNull() | (value == 0) | (value > 0x10FFFF) | value.between(0xD800, 0xDFFF)
    plain = F.decode(F.unhex(F.lpad(F.hex(value), 8, "0")), "UTF-32")
    dropped = value.between(1, 8) | value.between(14, 31) | value.between(127, 159) | (value == 11)
    return (
        F.when(bad, F.lit("�"))
        .when(lookup(legacy, value.cast("string")).isNotNull(), lookup(legacy, value.cast("string")))
        .when(value == 13, F.lit("\r"))
        .when(dropped, F.lit(""))
        .otherwise(plain)
    )


def unescape_html(c: Column) -> Column:
    """Decode character references; rows without ``&`` take the short way."""
    closed, open_names = _entity_tables()

    def decode_piece(piece: Column) -> Column:
        decimal = F.regexp_extract(piece, r"^#([0-9]+);?", 1)
        hexa = F.regexp_extract(piece, r"^#[xX]([0-9a-fA-F]+);?", 1)
        named = F.regexp_extract(piece, r"^([A-Za-z][A-Za-z0-9]{0,31});", 1)
        short = F.regexp_extract(piece, f"^({open_names})", 1)
        rest = F.regexp_replace(piece, r"^#(?:[xX][0-9a-fA-F]+|[0-9]+);?", "")
        return (
            F.when(decimal != "", F.concat(_code_point(decimal.try_cast("bigint")), rest))
            .when(hexa != "", F.concat(_code_point(F.conv(hexa, 16, 10).try_cast("bigint")), rest))
            .when(
                (named != "") & lookup(closed, named).isNotNull(),
                F.concat(lookup(closed, named), F.substring(piece, F.length(named) + 2, F.length(piece))),
            )
            .when(
                short != "",
                F.concat(lookup(closed, short), F.substring(piece, F.length(short) + 1, F.length(piece))),
            )
            .otherwise(F.concat(F.lit("&"), piece))
        )

    pieces = F.split(c, "&")
    decoded = bind(
        pieces,
        lambda p: F.array_join(
            F.transform(p, lambda piece, i: F.when(i == 0, piece).otherwise(decode_piece(piece))), ""
        ),
    )
    return F.when(F.contains(c, F.lit("&")), decoded).otherwise(c)


def strip_markup(c: Column) -> Column:
    """Markup removed, line-breaking tags kept apart; used for descriptions."""
    spaced = F.regexp_replace(c, r"(?i)<br\s*/?>|</p\s*>", "\n")
    return bind(F.regexp_replace(spaced, "<[^>]+>", ""), squeeze)


def markup_text(c: Column) -> Column:
    """Every tag becomes a blank, then references are decoded; empty input is NULL."""
    return bind(bind(F.regexp_replace(null_if_empty(c), "<[^>]+>", " "), unescape_html), squeeze)


def same_text(a: Column, b: Column) -> Column:
    """Case-blind equality; NULL or empty on either side is never equal."""
    return F.coalesce(F.lower(null_if_empty(a)) == F.lower(null_if_empty(b)), F.lit(False))


def first_label(text: Column, labels: list[str], ignore_case: bool = False) -> Column:
    """First label of the list, in list order, that the text contains."""
    seen = F.lower(text) if ignore_case else text
    return F.coalesce(
        *[F.when(F.contains(seen, F.lit(x.lower() if ignore_case else x)), F.lit(x)) for x in labels]
    )
