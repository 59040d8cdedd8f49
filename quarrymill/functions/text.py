"""Text cleaning and matching keys as Column expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache, wraps

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words and abbreviations of legal forms that matching keys leave out.
LEGAL_FORMS = (
    "bvba", "bv", "nv", "sa", "sprl", "srl", "cv", "cvba", "comm.v", "commv", "vof", "snc", "vzw", "asbl",
    "ltd", "limited", "plc", "gmbh", "ag", "inc", "inc.", "llc", "corp", "corporation", "co", "company",
    "b.v.", "n.v.", "s.a.", "s.p.r.l.", "s.r.l.", "ebvba", "eenmanszaak",
)


def once_a_session(build):
    """Keeps what ``build`` makes of its (hashable) arguments: expressions don't depend on tables, and making long ones
    takes longer than running them over a short list."""
    made: dict = {}

    @wraps(build)
    def of(*args):
        key = (id(SparkContext._gateway), args)
        if key not in made:
            made[key] = build(*args)
        return made[key]

    return of


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column | str, body) -> Column:
    """body(v) with v bound to ``value``: the expression is computed once and stands in the plan once, however often
    the body uses it."""
    return F.transform(F.array(col(value)), lambda v: body(v))[0]


def blank_to_null(x: Column | str) -> Column:
    return F.nullif(col(x), F.lit(""))


def strip_chars(x: Column | str, chars: str) -> Column:
    """``x`` without any of ``chars`` at either end."""
    return F.btrim(col(x), F.lit(chars))


def clean_text(x: Column | str, max_length: int | None = None) -> Column:
    """Control characters (but line ends and tabs) dropped, white space to single spaces, ends trimmed; null if blank.
    Longer texts than ``max_length`` end in an ellipsis."""
    kept = F.regexp_replace(col(x), r"[\p{C}&&[^\n\t]]", "")
    out = blank_to_null(F.btrim(F.regexp_replace(kept, r"(?U)\s+", " "), F.lit(" ")))
    if not max_length:
        return out
    cut = lambda v: F.concat(F.rtrim(F.substring(v, 1, max_length - 1)), F.lit("…"))
    return let(out, lambda v: F.when(F.length(v) > max_length, cut(v)).otherwise(v))


@lru_cache(maxsize=1)
def _folding() -> tuple[str, str, dict[str, str]]:
    """Characters that fold to one other, what they fold to, and those that fold to several. Characters that fold to
    nothing (combining marks) stand at the end of the first. Hangul syllables are left composed."""
    single, many, gone = {}, {}, []
    for code in range(128, 0x10000):
        c = chr(code)
        if 0xAC00 <= code <= 0xD7A3 or 0xD800 <= code <= 0xDFFF:
            continue
        to = "".join(d for d in unicodedata.normalize("NFKD", c) if not unicodedata.combining(d))
        if to == c:
            continue
        if not to:
            gone.append(c)
        elif len(to) == 1:
            single[c] = to
        else:
            many[c] = to
    return "".join(single) + "".join(gone), "".join(single.values()), many


def strip_accents(x: Column | str) -> Column:
    """Compatibility decomposition without combining marks. Texts of ASCII alone pass by the tables."""
    single, to, many = _folding()
    several = "[" + "".join(many) + "]"

    def expanded(v: Column) -> Column:
        table = F.str_to_map(F.lit("\x02".join(f"{k}\x01{to}" for k, to in many.items())), F.lit("\x02"), F.lit("\x01"))
        return F.array_join(F.transform(F.split(v, ""), lambda c: F.coalesce(F.element_at(table, c), c)), "")

    folded = lambda v: let(F.translate(v, single, to), lambda f: F.when(f.rlike(several), expanded(f)).otherwise(f))
    return let(x, lambda v: F.when(v.rlike(r"[^\x00-\x7F]"), folded(v)).otherwise(v))


def normalize_name(x: Column | str) -> Column:
    """A name for display: cleaned, with plain apostrophes, without punctuation at the ends."""
    plain = F.translate(clean_text(x), "’`", "''")
    return blank_to_null(strip_chars(plain, " -–|,;:"))


def name_key(x: Column | str) -> Column:
    """A key to match names by: unaccented, lower case, without legal forms and punctuation; empty, never null."""
    low = F.lower(strip_accents(clean_text(x)))
    forms = "|".join(f.replace(".", r"\.") for f in LEGAL_FORMS)
    bare = F.regexp_replace(low, rf"(?iU)\b({forms})\b\.?", " ")
    return F.coalesce(F.btrim(F.regexp_replace(bare, "[^a-z0-9]+", " "), F.lit(" ")), F.lit(""))


def spreadsheet_safe(x: Column | str) -> Column:
    """Without the control characters that spreadsheet files can't hold."""
    return F.regexp_replace(col(x), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def csv_cell(x: Column | str) -> Column:
    """Text that a spreadsheet takes literally: an apostrophe before anything like a formula, line ends as bars."""

    def of(v: Column) -> Column:
        risky = v.rlike("^[ \\t\\r\\n\\uFEFF]*[=+\\-@＝＋－＠]") | v.rlike(r"^[\t\r\n]")
        flat = F.regexp_replace(v, r"\r\n|\n|\r", " | ")
        return F.coalesce(F.when(risky, F.concat(F.lit("'"), flat)).otherwise(flat), F.lit(""))

    return let(x, of)


def generalise_flag(x: Column | str) -> Column:
    """A flag without what is particular to its record, for counting."""
    out = F.regexp_replace(col(x), "REC-[A-Z0-9]+", "<id>")
    out = F.regexp_replace(out, r"DUP-\d+", "<group>")
    out = F.regexp_replace(out, r"\(.*?\)", "")
    out = F.regexp_replace(out, r":.*$", "")
    return strip_chars(F.regexp_replace(out, "'[^']*'", "'…'"), " -")
