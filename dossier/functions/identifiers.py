"""Checked identifiers in text: IBAN, NIF, Russian numbers, VAT ids (NUM2-NUM6)."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Length of an IBAN by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29,
    "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20,
    "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29,
    "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
#: Forms of EU VAT ids.
VAT_FORMS = {
    "AT": r"U\d{8}", "BE": r"[01]\d{9}", "BG": r"\d{9,10}", "CY": r"\d{8}[A-Z]", "CZ": r"\d{8,10}", "DE": r"\d{9}", "DK": r"\d{8}", "EE": r"\d{9}", "EL": r"\d{9}", "ES": r"[A-Z0-9]\d{7}[A-Z0-9]", "FI": r"\d{8}",
    "FR": r"[A-HJ-NP-Z0-9]{2}\d{9}", "HR": r"\d{11}", "HU": r"\d{8}", "IE": r"(?:\d{7}[A-W][A-I]?|\d[A-Z+*]\d{5}[A-W])", "IT": r"\d{11}", "LT": r"(?:\d{9}|\d{12})", "LU": r"\d{8}", "LV": r"\d{11}", "MT": r"\d{8}",
    "NL": r"\d{9}B\d{2}", "PL": r"\d{10}", "PT": r"\d{9}", "RO": r"[1-9]\d{1,9}", "SE": r"\d{10}01", "SI": r"\d{8}", "SK": r"\d{10}", "XI": r"(?:\d{9}|\d{12})",
}
#: How a Portuguese tax number begins.
NIF_BEGINS = "1 2 3 5 6 8 45 70 71 72 74 75 77 78 79 90 91 98 99".split()


def digits_sum(text: Column, weights: list[int]) -> Column:
    """Sum of the first digits of a text by weights."""
    return sum((F.substring(text, i + 1, 1).try_cast("int") * w for i, w in enumerate(weights)), F.lit(0))


def is_nif(text: Column) -> Column:
    """NUM3: nine digits that begin as such numbers do, the last checks the others modulo 11."""
    rest = F.lit(11) - digits_sum(text, list(range(9, 1, -1))) % 11
    return text.rlike(rf"^(?=(?:{'|'.join(NIF_BEGINS)}))\d{{9}}$") & (F.when(rest >= 10, 0).otherwise(rest) == F.substring(text, 9, 1).try_cast("int"))


def is_inn(text: Column) -> Column:
    """NUM3: ten or twelve digits with one or two check digits."""
    check = lambda w: digits_sum(text, w) % 11 % 10
    ten = text.rlike(r"^\d{10}$") & (check([2, 4, 10, 3, 5, 9, 4, 6, 8]) == F.substring(text, 10, 1).try_cast("int"))
    twelve = text.rlike(r"^\d{12}$") & (check([7, 2, 4, 10, 3, 5, 9, 4, 6, 8]) == F.substring(text, 11, 1).try_cast("int")) & (check([3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8]) == F.substring(text, 12, 1).try_cast("int"))
    return ten | twelve


def is_ogrn(text: Column) -> Column:
    """NUM3: 13 digits modulo 11, or 15 modulo 13."""
    one = text.rlike(r"^\d{13}$") & (F.substring(text, 1, 12).try_cast("long") % 11 % 10 == F.substring(text, 13, 1).try_cast("int"))
    two = text.rlike(r"^\d{15}$") & (F.substring(text, 1, 14).try_cast("long") % 13 % 10 == F.substring(text, 15, 1).try_cast("int"))
    return one | two


def is_iban(text: Column) -> Column:
    """NUM2: national length, and the remainder by 97 digit by digit."""
    bare = F.upper(F.regexp_replace(text, r"\s+", ""))
    turned = F.concat(F.substr(bare, F.lit(5)), F.substring(bare, 1, 4))
    step = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.try_cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    rest = F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), lambda a, c: step(a, c).try_cast("int"))
    lengths = F.create_map(*[F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair])
    return bare.rlike(r"^[A-Z]{2}\d{2}[A-Z0-9]+$") & (F.length(bare) == F.try_element_at(lengths, F.substring(bare, 1, 2))) & (rest == 1)


def is_vat(text: Column) -> Column:
    """NUM4: the form of its country; a Portuguese one is a tax number."""
    return text.rlike("^(?:" + "|".join(f"{c}{form}" for c, form in VAT_FORMS.items()) + ")$") & (~text.startswith("PT") | is_nif(F.substr(text, F.lit(3))))


_SIGN = r"[:\s№#.-]{0,4}"
_APART, _ENDS = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"


def _national(value: Column) -> Column:
    """As much of a value as an IBAN of its country has."""
    lengths = F.create_map(*[F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair])
    return F.substr(value, F.lit(1), F.coalesce(F.try_element_at(lengths, F.substring(value, 1, 2)), F.lit(0)))


def _any(value: Column) -> Column:
    return F.lit(True)


#: Kind to: pattern with the value as its group, check of the value without spaces in upper case.
FINDERS = {
    "iban": (rf"{_APART}([A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]){{11,30}})", is_iban),
    "nif": (rf"(?iu){_APART}(?:NIF|NIPC|contribuinte){_SIGN}(?:PT\s?)?((?:\d ?){{8}}\d){_ENDS}", is_nif),
    "inn": (rf"(?iu){_APART}ИНН(?:/КПП)?{_SIGN}(\d{{12}}|\d{{10}}){_ENDS}", is_inn),
    "kpp": (rf"(?iu){_APART}КПП{_SIGN}(?:\d{{10,12}}/)?(\d{{4}}[0-9A-Z]{{2}}\d{{3}}){_ENDS}", _any),
    "ogrn": (rf"(?iu){_APART}ОГРН(?:ИП)?{_SIGN}(\d{{15}}|\d{{13}}){_ENDS}", is_ogrn),
    "bik": (rf"(?iu){_APART}БИК{_SIGN}(04\d{{7}}){_ENDS}", _any),
    "vat": (_APART + "((?:" + "|".join(f"{c}{form}" for c, form in VAT_FORMS.items()) + "))" + _ENDS, is_vat),
}
#: NUM5: the words before a number that is no other identifier; a parameter of stable_keys.
NUMBER_LABELS = ("account", "policy", "contract", "conta", "apólice", "contrato")


def stable_keys(text: Column | str, labels: Sequence[str] = NUMBER_LABELS) -> Column:
    """NUM5, NUM6: `kind:value` in order of appearance, each once; a value found as a specific kind isn't a generic one."""
    whole = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))

    def found(kind: str, pattern: str, good) -> Column:
        value = lambda m: _national(bare(m)) if kind == "iban" else bare(m)
        bare = lambda m: F.upper(F.regexp_replace(m, r"\s", ""))
        every = F.transform(F.regexp_extract_all(whole, F.lit(pattern), F.lit(1)), lambda m: F.struct(F.instr(whole, m).alias("at"), F.lit(kind).alias("kind"), value(m).alias("value")))
        return F.filter(every, lambda x: F.coalesce(good(x["value"]), F.lit(False)))

    specific = F.flatten(F.array(*[found(kind, pattern, good) for kind, (pattern, good) in FINDERS.items()]))
    named = rf"(?iu){_APART}(?:{'|'.join(map(re.escape, labels))})(?: (?:no|number|n\.º))?{_SIGN}([A-Z0-9][A-Z0-9/-]{{3,}})"
    generic = found("account", named, lambda v: F.regexp_count(v, F.lit(r"\d")) >= 3) if labels else F.filter(specific, lambda x: F.lit(False))

    def together(some: Column) -> Column:
        values = F.transform(some, lambda x: x["value"])
        every = F.concat(some, F.filter(generic, lambda x: ~F.array_contains(values, x["value"])))
        return F.array_distinct(F.transform(F.array_sort(every), lambda x: F.concat_ws(":", x["kind"], x["value"])))

    return F.get(F.transform(F.array(specific), together), 0)
