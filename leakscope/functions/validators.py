"""Structural and checksum validators as Column predicates. They run inside the detection projection."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leakscope import dims
from leakscope.functions.text import digits_of, let, literal_array, matches, strip


def _upper(col: Column) -> Column:
    return F.upper(strip(col))


def _suppressed(ctx: Column | None, broad: bool) -> Column:
    """Context that speaks of measurements or of invented data."""
    if ctx is None:
        return F.lit(False)
    dummy = dims.DUMMY_CONTEXT_BROAD if broad else dims.DUMMY_CONTEXT
    return matches(ctx, dims.TECHNICAL_CONTEXT) | matches(ctx, dummy)


def verhoeff_ok(col: Column) -> Column:
    """Twelve digits, first not 0 or 1, Verhoeff check value 0."""
    table_d = F.array(*[literal_array(r) for r in dims.VERHOEFF_D])
    table_p = F.array(*[literal_array(r) for r in dims.VERHOEFF_P])

    def checksum(digits: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(0), F.lit(11)),
            F.lit(0),
            lambda c, i: F.get(
                F.get(table_d, c), F.get(F.get(table_p, i % 8), F.substring(digits, F.lit(12) - i, F.lit(1)).cast("int"))
            ),
        )

    return let(
        digits_of(col),
        lambda d: F.when(d.rlike(r"^[2-9][0-9]{11}\z"), F.coalesce(checksum(d) == 0, F.lit(False))).otherwise(False),
    )


def aadhaar_ok(col: Column, ctx: Column) -> Column:
    """The live rule: twelve digits, first not 0 or 1, no measurement or account word around. No checksum."""
    return let(digits_of(col), lambda d: (F.length(d) == 12) & ~F.substring(d, 1, 1).isin("0", "1")) & ~matches(
        ctx, dims.AADHAAR_VETO
    )


def pan_ok(col: Column) -> Column:
    return _upper(col).rlike(r"^[A-Z]{3}[" + dims.PAN_HOLDER_LETTERS + r"][A-Z][0-9]{4}[A-Z]\z")


def gstin_ok(col: Column) -> Column:
    shape = r"^[0-3][0-9][A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]\z"
    return let(
        _upper(col),
        lambda v: v.rlike(shape) & F.substring(v, 1, 2).between("01", "37") & pan_ok(F.substring(v, 3, 10)),
    )


def luhn_ok(col: Column) -> Column:
    return let(
        F.regexp_replace(strip(col), r"(?U)[\s\-]", ""),
        lambda d: F.when(d.rlike(r"^[0-9]{13,19}\z"), F.call_function("luhn_check", d)).otherwise(False),
    )


def card_ok(col: Column, ctx: Column | None = None) -> Column:
    return luhn_ok(col) & ~_suppressed(ctx, broad=True)


def passport_ok(col: Column) -> Column:
    return _upper(col).rlike(r"^[A-PR-WY][1-9][0-9]{6}\z")


def licence_ok(col: Column) -> Column:
    return _upper(col).rlike(r"^([A-Z]{2}[0-9]{13}|[A-Z]{2}-[0-9]{2}-[0-9]{4}-[0-9]{7})\z")


def upi_ok(col: Column) -> Column:
    return F.lower(strip(col)).rlike(r"^[a-z0-9.\-_]{2,256}@[a-z]{2,64}\z")


def upi_known_handle(col: Column) -> Column:
    return F.substring_index(F.lower(strip(col)), "@", -1).isin(dims.KNOWN_UPI_HANDLES)


def abha_ok(col: Column) -> Column:
    return strip(col).rlike(r"(?U)^\d{2}-\d{4}-\d{4}-\d{4}\z")


def ssn_ok(col: Column, ctx: Column | None = None, profile: str = "fast") -> Column:
    """Area not 000 or 666, group and serial not zero, context not technical or invented.

    The live rule wants the hyphens; the validator-first rule strips them and has a broader list of dummy words.
    """
    live = profile in ("fast", "context")
    bare = strip(col) if live else F.replace(strip(col), F.lit("-"), F.lit(""))
    shape = r"(?U)^\d{3}-\d{2}-\d{4}\z" if live else r"(?U)^\d{9}\z"
    gap = 1 if live else 0
    good = let(
        bare,
        lambda v: v.rlike(shape)
        & ~F.substring(v, 1, 3).isin("000", "666")
        & (F.substring(v, 4 + gap, 2) != "00")
        & (F.substring(v, 6 + 2 * gap, 4) != "0000"),
    )
    return good & ~_suppressed(ctx, broad=not live)


def phone_ok(col: Column, ctx: Column | None = None, profile: str = "fast") -> Column:
    """Ten digits after an optional 91, first 6 to 9; only the validator-first rule looks at the context."""
    good = let(
        digits_of(col),
        lambda d: let(
            F.when(d.startswith("91") & (F.length(d) == 12), F.substring(d, 3, 10)).otherwise(d),
            lambda n: (F.length(n) == 10) & F.substring(n, 1, 1).isin("6", "7", "8", "9"),
        ),
    )
    return good if profile in ("fast", "context") else good & ~_suppressed(ctx, broad=True)


SHAPES = {
    "VOTER_ID": (True, r"^[A-Z]{3}[0-9]{7}\z"),
    "IFSC": (True, r"^[A-Z]{4}0[A-Z0-9]{6}\z"),
    "EMAIL": (False, r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\z"),
}


def shape_ok(col: Column, type_name: str) -> Column:
    """Whole-value re-check for the types that have no checksum."""
    upper, regex = SHAPES[type_name]
    return (F.upper(col) if upper else col).rlike(regex)


def is_code_artifact(col: Column, type_col: Column) -> Column:
    """A PERSON value that looks like source code: punctuation, too many words, a keyword, a variable name."""
    words = F.split(strip(col), r"(?U)\s+")
    looks = (
        col.rlike(dims.CODE_PUNCTUATION)
        | (F.size(words) > 5)
        | F.arrays_overlap(words, literal_array(dims.CODE_KEYWORDS))
        | col.rlike(r"^[a-z].*_")
    )
    return (type_col == "PERSON") & F.coalesce(looks, F.lit(False))


def live_check(type_name: str, value: Column, ctx: Column) -> Column:
    """Validators of the live scan; a type without one passes."""
    if type_name == "AADHAAR":
        return aadhaar_ok(value, ctx)
    if type_name == "SSN":
        return ssn_ok(value, ctx)
    if type_name == "PHONE":
        return phone_ok(value, ctx)
    return F.lit(True)


def full_check(type_name: str, value: Column, ctx: Column) -> Column:
    """Validators of the extended scan: every type has one."""
    simple = {
        "PAN": pan_ok, "GSTIN": gstin_ok, "PASSPORT_IN": passport_ok, "DL_IN": licence_ok, "UPI": upi_ok,
        "ABHA": abha_ok,
    }
    if type_name in simple:
        return simple[type_name](value)
    if type_name in SHAPES:
        return shape_ok(value, type_name)
    if type_name == "AADHAAR":
        return verhoeff_ok(value) & ~matches(ctx, dims.AADHAAR_VETO)
    if type_name == "SSN":
        return ssn_ok(value, ctx, "strict")
    if type_name == "CREDIT_CARD":
        return card_ok(value, ctx)
    if type_name == "PHONE":
        return phone_ok(value, ctx, "strict")
    return F.lit(True)
