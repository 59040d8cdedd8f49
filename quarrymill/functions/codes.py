"""Postcodes, VAT numbers and telephone numbers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrymill.functions.text import blank_to_null, clean_text, col, let

#: Postcodes by country.
POSTCODES = {
    "BE": r"^[1-9]\d{3}$",
    "NL": r"^[1-9]\d{3} ?[A-Z]{2}$",
    "FR": r"^\d{5}$",
    "DE": r"^\d{5}$",
    "LU": r"^L?-?\d{4}$",
    "GB": r"^[A-Z]{1,2}\d[A-Z\d]? ?\d[A-Z]{2}$",
    "US": r"^\d{5}(-\d{4})?$",
}
#: VAT numbers by country.
VAT_NUMBERS = {
    "BE": r"^BE[01]\d{9}$",
    "NL": r"^NL\d{9}B\d{2}$",
    "FR": r"^FR[A-Z0-9]{2}\d{9}$",
    "DE": r"^DE\d{9}$",
    "LU": r"^LU\d{8}$",
}


def normalize_postcode(x: Column | str, country: str = "BE") -> Column:
    t = F.btrim(F.replace(F.upper(clean_text(x)), F.lit("B-"), F.lit("")))
    return F.regexp_replace(t, r"^(\d{4})\s*([A-Z]{2})$", "$1 $2") if country.upper() == "NL" else t


def is_valid_postcode(x: Column | str, country: str = "BE") -> Column:
    """True or false; null where the country's form isn't known. A missing postcode is false."""
    x, form = col(x), POSTCODES.get(country.upper())
    missing = x.isNull() | (x == "")
    return F.when(missing, False).otherwise(x.rlike(form) if form else F.lit(None).cast("boolean"))


def normalize_vat(x: Column | str, country: str = "BE") -> Column:
    """Upper case, without separators and labels, with a country; nine Belgian digits get their zero."""
    labels = "".join(f"(?:{label}:*)?" for label in ("BTW", "TVA", "VAT", "KBO", "BCE", "MWST", "USTID"))
    t = F.regexp_replace(F.regexp_replace(F.upper(clean_text(x)), r"(?U)[\s.\-/]", ""), f"^{labels}", "")
    t = let(t, lambda v: F.when(v.rlike("^[A-Z]{2}"), v).otherwise(F.concat(F.lit(country.upper()), v)))
    return F.regexp_replace(t, r"^BE(\d{9})$", "BE0$1")


def is_valid_vat(x: Column | str) -> Column:
    """True or false by form, for Belgium also by check digits; null where the country's form isn't known."""

    def of(v: Column) -> Column:
        out = F.lit(None).cast("boolean")
        for name, form in VAT_NUMBERS.items():
            good = v.rlike(form)
            if name == "BE":
                good = good & (97 - F.substring(v, 3, 8).try_cast("long") % 97 == F.substring(v, 11, 2).try_cast("long"))
            out = F.when(F.substring(v, 1, 2) == name, F.coalesce(good, F.lit(False))).otherwise(out)
        return F.when(v.isNull() | (F.length(v) < 4), False).otherwise(out)

    return let(x, of)


# --- telephone numbers: a small numbering plan

#: For each region its country code, trunk prefix, least and most national digits, and forms by type. Forms
#: are those of public numbering plans, shortened to what tells types apart.
PLANS = {
    "BE": ("32", "0", 8, 9, (("mobile", r"4[5-9]\d{7}"), ("toll-free", r"800[1-9]\d{4}"), ("premium", r"(?:70(?:2[0-57]|3[04-7]|44|6[4-69]|7[0579])|90\d{2})\d{4}"), ("fixed", r"80[2-8]\d{5}|(?:1[0-69]|[23][2-8]|4[23]|5\d|6[013-57-9]|71|8[1-79]|9[2-4])\d{6}"))),
    "NL": ("31", "0", 9, 9, (("mobile", r"6[1-58]\d{7}"), ("toll-free", r"800\d{4,7}"), ("premium", r"90[069]\d{4,7}"), ("voip", r"(?:85|91)\d{7}"), ("fixed", r"(?:1[0135-8]|2[02-69]|3[0-68]|4[0135-9]|[57]\d|8[478])\d{7}"))),
    "FR": ("33", "0", 9, 9, (("mobile", r"(?:6\d|7[3-9])\d{7}"), ("toll-free", r"80[0-5]\d{6}"), ("premium", r"8[129]\d{7}"), ("voip", r"9\d{8}"), ("fixed", r"[1-5]\d{8}"))),
    "DE": ("49", "0", 5, 13, (("mobile", r"1(?:5\d{9}|6[023]\d{7,8}|7\d{8,9})"), ("toll-free", r"800\d{7,12}"), ("premium", r"(?:137|900)\d{6,10}"), ("fixed", r"[2-9]\d{4,11}"))),
    "LU": ("352", "", 4, 11, (("mobile", r"6(?:[269][18]|5[1568]|7[189]|81)\d{6}"), ("toll-free", r"800\d{5}"), ("premium", r"90[015]\d{5}"), ("fixed", r"(?:2[2-9]|[3457]\d|8[1-9]|9[2-9])\d{2,9}"))),
    "GB": ("44", "0", 9, 10, (("mobile", r"7(?:[1-57-9]\d\d|624)\d{6}"), ("toll-free", r"80[08]\d{6,7}"), ("premium", r"(?:8[47][0-5]|9[018]\d)\d{7}"), ("voip", r"56\d{8}"), ("fixed", r"(?:1\d{8,9}|2[03489]\d{8})"))),
    "US": ("1", "1", 10, 10, (("toll-free", r"8(?:00|33|44|55|66|77|88)[2-9]\d{6}"), ("premium", r"900[2-9]\d{6}"), ("fixed/mobile", r"[2-9]\d{2}[2-9]\d{6}"))),
}
#: How national digits are grouped for display: (form, replacement) per region, the first that fits.
GROUPS = {
    "BE": ((r"^(4\d{2})(\d{2})(\d{2})(\d{2})$", "$1 $2 $3 $4"), (r"^([2349])(\d{3})(\d{2})(\d{2})$", "$1 $2 $3 $4"), (r"^(800|90\d|70\d?)(\d{2})(\d{3})$", "$1 $2 $3"), (r"^(\d{2})(\d{2})(\d{2})(\d{2})$", "$1 $2 $3 $4")),
    "NL": ((r"^(6)(\d{8})$", "$1 $2"), (r"^(1[035]|2[0346]|3[03568]|4[056]|5[0358]|7\d)(\d{3})(\d{4})$", "$1 $2 $3"), (r"^(\d{3})(\d{3})(\d{3})$", "$1 $2 $3")),
    "FR": ((r"^(\d)(\d{2})(\d{2})(\d{2})(\d{2})$", "$1 $2 $3 $4 $5"),),
    "DE": ((r"^(1[567]\d)(\d+)$", "$1 $2"), (r"^(30|40|69|89)(\d+)$", "$1 $2"), (r"^(\d{3})(\d+)$", "$1 $2")),
    "LU": ((r"^(6\d{2})(\d{3})(\d{3})$", "$1 $2 $3"), (r"^(\d{2})(\d{2})(\d{2})$", "$1 $2 $3")),
    "GB": ((r"^(7\d{3})(\d{6})$", "$1 $2"), (r"^(2\d)(\d{4})(\d{4})$", "$1 $2 $3"), (r"^(\d{4})(\d+)$", "$1 $2")),
    "US": ((r"^(\d{3})(\d{3})(\d{4})$", "$1-$2-$3"),),
}


def _international(x: Column, region: str) -> Column:
    """``+`` and digits, or null where a text can't be read as a number."""
    code, trunk, *_ = PLANS.get(region.upper(), ("", "", 0, 0, ()))
    text = F.regexp_replace(x, r"(?i)\s*(?:ext\.?|x|#|;ext=)\s*\d{1,7}\s*$", "")
    start = F.regexp_extract(F.regexp_replace(text, r"\(0\)", ""), r"([+＋]?[(]?\d.*)$", 1)

    def whole(digits: Column) -> Column:
        out = F.when(digits.rlike(r"^\+"), F.replace(digits, F.lit("+"), F.lit("")))
        if code:
            bare = F.replace(digits, F.lit("+"), F.lit(""))
            national = F.regexp_replace(bare, f"^{trunk}", "") if trunk else bare
            out = out.when(bare.startswith("00"), F.substr(bare, F.lit(3))).otherwise(F.concat(F.lit(code), national))
        return out

    def checked(number: Column) -> Column:
        return F.when(F.length(number) >= 4, F.concat(F.lit("+"), number))

    digits = let(start, lambda v: F.when(~v.rlike(r"\p{L}") & (v != ""), F.regexp_replace(v, r"[^\d+]", "")))
    return let(F.regexp_replace(let(digits, whole), "^(32|31|33|49|44)0", "$1"), checked)


def _fold(number: Column, of, otherwise: Column) -> Column:
    """of(region, national digits) for the region whose code the number has."""
    out = otherwise
    for region, plan in PLANS.items():
        out = F.when(number.startswith("+" + plan[0]), of(region, F.substr(number, F.lit(len(plan[0]) + 2)))).otherwise(out)
    return out


def normalize_phone(x: Column | str, region: str = "BE") -> Column:
    """E.164, or null where a text can't be a number. Of several numbers in a cell the first counts."""

    def first(t: Column) -> Column:
        several = t.contains(";") | (F.length(t) - F.length(F.replace(t, F.lit("+"), F.lit(""))) > 1)
        return F.btrim(F.when(several, F.substring_index(F.substring_index(t, ";", 1), "/", 1)).otherwise(t))

    def possible(number: Column) -> Column:
        length = F.length(number) - 1
        return F.when(_fold(number, lambda r, n: F.length(n).between(PLANS[r][2], PLANS[r][3]), length.between(7, 15)), number)

    return let(_international(F.regexp_replace(let(clean_text(x), first), "(?i)^tel:", ""), region), possible)


def phone_info(x: Column | str, region: str = "BE") -> Column:
    """A struct: valid, type, e164, international, national, region, reason. Regions outside the plan have the type
    ``unknown``; their numbers are valid with 7 to 15 digits."""

    def kind(region: str, national: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, form in reversed(PLANS[region][4]):
            out = F.when(national.rlike(f"^(?:{form})$"), name).otherwise(out)
        return out

    def grouped(region: str, national: Column) -> Column:
        out = national
        for form, shown in reversed(GROUPS[region]):
            out = F.when(national.rlike(form), F.regexp_replace(national, form, shown)).otherwise(out)
        return out

    def parts(number: Column) -> Column:
        found = _fold(number, kind, F.when((F.length(number) - 1).between(7, 15), "unknown"))
        return F.struct(
            number.alias("number"), found.alias("found"), _fold(number, lambda r, n: F.lit(r), F.lit("")).alias("where"),
            _fold(number, lambda r, n: F.concat(F.lit(PLANS[r][1] if r != "US" else ""), grouped(r, n)), F.substr(number, F.lit(2))).alias("national"),
            _fold(number, lambda r, n: F.concat(F.lit(f"+{PLANS[r][0]} "), grouped(r, n)), number).alias("international"),
        )

    def info(s: Column) -> Column:
        number, valid = s["number"], s["found"].isNotNull()
        reason = F.when(number.isNull(), "unparseable").when(valid, "").otherwise("not a valid number for its region")
        return F.struct(
            valid.alias("valid"), F.coalesce(s["found"], F.when(number.isNotNull(), "unknown")).alias("type"), number.alias("e164"),
            s["international"].alias("international"), s["national"].alias("national"), F.when(number.isNotNull(), s["where"]).alias("region"),
            F.when(blank_to_null(col(x)).isNull(), "missing").otherwise(reason).alias("reason"),
        )

    return let(let(_international(clean_text(x), region), parts), info)


def format_phone_display(x: Column | str, region: str = "BE") -> Column:
    return let(phone_info(x, region), lambda i: F.when(i["valid"], i["international"]).otherwise(col(x)))


def vat_address_part(address: Column | str, part: str) -> Column:
    """``postcode`` or ``city`` of the last address line that starts with digits; empty without one."""
    lines = F.filter(F.transform(F.split(col(address), r"\r\n|\r|\n"), lambda v: F.btrim(v)), lambda v: v.rlike(r"^\d+ +\S|^\d+ "))
    last = F.try_element_at(lines, F.lit(-1))
    return F.coalesce(blank_to_null(F.btrim(F.regexp_extract(last, r"^(\d+) (.*)$", 1 if part == "postcode" else 2))), F.lit(""))
