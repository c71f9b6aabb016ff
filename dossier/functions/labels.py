"""Label values: days, periods, amounts, and operations on label arrays (DT5, DT6, NUM1, ARR1-3, PIP16, VOC16-18)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossier.functions.text import fold, one_line

#: Label kinds in their order; those of a single value; those about time.
KINDS = ["sender", "party", "type", "topic", "object", "reference", "date", "period", "deadline", "amount", "jurisdiction", "language", "tag"]
SINGLE = ["type", "date"]
TIMES = ["date", "period", "deadline"]
#: Signs that only one currency is written with (shared ones, such as $ and £, stand for none), and the codes of ISO 4217.
SIGNS = {"€": "EUR", "₽": "RUB", "₴": "UAH", "₹": "INR", "zł": "PLN", "Kč": "CZK", "R$": "BRL", "Ft": "HUF", "лв.": "BGN", "₪": "ILS", "₫": "VND", "₦": "NGN", "₺": "TRY", "₸": "KZT", "₾": "GEL", "₲": "PYG", "฿": "THB", "₼": "AZN", "֏": "AMD", "₭": "LAK", "₮": "MNT", "៛": "KHR", "৳": "BDT"}
CODES = (
    "AED AFN ALL AMD ANG AOA ARS AUD AWG AZN BAM BBD BDT BGN BHD BIF BMD BND BOB BRL BSD BTN BWP BYN BZD CAD CDF CHF CLP CNY COP CRC CUP CVE CZK DJF DKK DOP DZD EGP ERN ETB EUR FJD FKP GBP GEL GHS GIP GMD GNF GTQ GYD "
    "HKD HNL HTG HUF IDR ILS INR IQD IRR ISK JMD JOD JPY KES KGS KHR KMF KPW KRW KWD KYD KZT LAK LBP LKR LRD LSL LYD MAD MDL MGA MKD MMK MNT MOP MRU MUR MVR MWK MXN MYR MZN NAD NGN NIO NOK NPR NZD OMR PAB PEN PGK PHP PKR "
    "PLN PYG QAR RON RSD RUB RWF SAR SBD SCR SDG SEK SGD SHP SLE SOS SRD SSP STN SVC SYP SZL THB TJS TMT TND TOP TRY TTD TWD TZS UAH UGX USD UYU UZS VES VND VUV WST XAF XCD XOF XPF YER ZAR ZMW ZWG"
).split()


def kind_rank(kind: Column) -> Column:
    """Place of a kind in the fixed order."""
    return F.array_position(F.array(*map(F.lit, KINDS)), kind)


def iso_day(text: Column) -> Column:
    """DT5: ISO or day-first with any two of the signs . / - between, only days that exist."""
    value, shape = F.trim(text), r"^(\d{1,2})[./-](\d{1,2})[./-](\d{4})$"
    part = lambda n: F.lpad(F.regexp_extract(value, shape, n), 2, "0")
    day_first = F.when(value.rlike(shape), F.concat_ws("-", F.regexp_extract(value, shape, 3), part(2), part(1)))
    iso = F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), value)
    return F.date_format(F.try_to_date(F.coalesce(iso, day_first), "yyyy-MM-dd"), "yyyy-MM-dd")


def span(text: Column) -> Column:
    """DT6: struct<first,last> of a year, month, day or `a/b`; a month's last day is written -31."""
    value = F.trim(text)
    parts = F.split(value, "/")
    shape = r"^\d{4}(-\d{2}(-\d{2})?)?$"
    begin = lambda x: F.when(F.length(x) == 4, F.concat(x, F.lit("-01-01"))).when(F.length(x) == 7, F.concat(x, F.lit("-01"))).otherwise(x)
    end = lambda x: F.when(F.length(x) == 4, F.concat(x, F.lit("-12-31"))).when(F.length(x) == 7, F.concat(x, F.lit("-31"))).otherwise(x)
    a, b = F.get(parts, 0), F.coalesce(F.get(parts, 1), F.get(parts, 0))
    fits = (F.size(parts) <= 2) & a.rlike(shape) & b.rlike(shape)
    return F.when(fits, F.struct(begin(a).alias("first"), end(b).alias("last")))


def overlaps(a: Column, b: Column) -> Column:
    """JN10."""
    return (a["first"] <= b["last"]) & (b["first"] <= a["last"])


def year(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"^(\d{4})", 1), F.lit(""))


#: A number with its sign; what groups it stands between digits.
_NUMBER = "(?s)^(.*?)(-?)([0-9](?:[0-9]|[.,' \u00A0\u202F](?=[0-9]))*)(.*)$"


def decimal(number: Column) -> Column:
    """A written number with a dot for decimals and no grouping; null where its marks can't be read.

    A single mark is the decimal one; marks of one kind group; of two kinds the last is the decimal one if it stands once.
    """
    digits = F.regexp_replace(number, "[' \u00A0\u202F]", "")
    bare = lambda mark: F.replace(digits, F.lit(mark), F.lit(""))
    return (
        F.when(digits.rlike("^[0-9]+$"), digits)
        .when(digits.rlike("^[0-9]+[.,][0-9]+$"), F.replace(digits, F.lit(","), F.lit(".")))
        .when(digits.rlike(r"^[0-9]+(\.[0-9]+){2,}$"), bare("."))
        .when(digits.rlike("^[0-9]+(,[0-9]+){2,}$"), bare(","))
        .when(digits.rlike(r"^[0-9]+(\.[0-9]+)+,[0-9]+$"), F.replace(bare("."), F.lit(","), F.lit(".")))
        .when(digits.rlike(r"^[0-9]+(,[0-9]+)+\.[0-9]+$"), bare(","))
    )


def currency(text: Column) -> Column:
    """The ISO 4217 code that a text is, in any case, or that of the one currency whose sign it is."""
    signs = F.create_map(*[F.lit(x) for pair in SIGNS.items() for x in pair])
    return F.when(F.upper(text).isin(CODES), F.upper(text)).otherwise(F.try_element_at(signs, text))


def amount(text: Column) -> Column:
    """NUM1: `number CODE` of a number with a currency before or after it; null if the text is no amount."""
    part = lambda n: F.regexp_extract(text, _NUMBER, n)
    trimmed = lambda x: F.regexp_replace(x, r"^[\s\u00A0\u202F:]+|[\s\u00A0\u202F:]+$", "")
    before, after = trimmed(part(1)), trimmed(part(4))
    code = F.when((before == "") != (after == ""), currency(F.when(before == "", after).otherwise(before)))
    return F.when(code.isNotNull(), F.concat(part(2), decimal(part(3)), F.lit(" "), code))


def normalize(kind: Column, value: Column) -> Column:
    """ARR3: the value as its kind is written; null where it can't be read."""
    text = one_line(value)
    period = F.when(span(text).isNotNull(), text)
    return (
        F.when(kind.isin("date", "deadline"), iso_day(text)).when(kind == "period", period).when(kind == "amount", amount(text)).when(kind == "language", F.lower(text)).otherwise(F.when(text != "", F.substring(text, 1, 80)))
    )


def label_key(label: Column) -> Column:
    return F.concat(label["kind"], F.lit("\u0000"), fold(label["value"]))


def distinct_labels(labels: Column) -> Column:
    """ARR1: the first of each folded (kind, value), and the first of a kind of a single value."""

    def add(kept: Column, x: Column) -> Column:
        known = F.exists(kept, lambda k: (k["key"] == x["key"]) | ((k["label"]["kind"] == x["label"]["kind"]) & x["label"]["kind"].isin(*SINGLE)))
        return F.when(known, kept).otherwise(F.concat(kept, F.array(x)))

    keyed = F.transform(labels, lambda x: F.struct(x.alias("label"), label_key(x).alias("key")))
    return F.transform(F.aggregate(keyed, F.array().cast("array<struct<label:struct<kind:string,value:string>,key:string>>"), add), lambda x: x["label"])


def split_labels(labels: Column) -> Column:
    """ARR2: values joined by `;` apart."""
    parts = lambda x: F.transform(F.filter(F.transform(F.split(x["value"], ";"), lambda v: F.trim(v)), lambda v: v != ""), lambda v: F.struct(x["kind"].alias("kind"), v.alias("value")))
    return F.flatten(F.transform(labels, parts))


def edit_labels(labels: Column, removed: Column, added: Column) -> Column:
    """PIP16: removes as written or folded, then adds; an added value of a single kind takes its place."""
    left = F.filter(labels, lambda x: ~F.exists(removed, lambda r: label_key(r) == label_key(x)))
    left = F.filter(left, lambda x: ~F.exists(added, lambda a: (a["kind"] == x["kind"]) & a["kind"].isin(*SINGLE) & (label_key(a) != label_key(x))))
    return distinct_labels(F.concat(left, added))


def keep_by_hand(read: Column, before: Column, current: Column, by_hand: Column) -> Column:
    """VOC16: labels of a new reading, but kinds that the user changed or set by hand stay as they are."""
    of = lambda labels, kind: F.array_sort(F.transform(F.filter(labels, lambda x: x["kind"] == kind), label_key))
    user = lambda kind: (kind == "tag") | F.exists(by_hand, lambda h: h["kind"] == kind) | (of(before, kind) != of(current, kind))
    return distinct_labels(F.concat(F.filter(current, lambda x: user(x["kind"])), F.filter(read, lambda x: ~user(x["kind"]))))


def merge_tags(tags: Column, more: Column, most: int = 5) -> Column:
    """VOC18."""
    return F.slice(distinct_labels(F.concat(tags, more)), 1, most)


def first_value(labels: Column, kind: str) -> Column:
    """PRJ2."""
    return F.get(F.filter(labels, lambda x: x["kind"] == kind), 0)["value"]


#: English names of languages by their codes.
LANGUAGES = {
    "ar": "Arabic", "be": "Belarusian", "bg": "Bulgarian", "ca": "Catalan", "cs": "Czech", "da": "Danish", "de": "German", "el": "Greek", "en": "English", "es": "Spanish", "et": "Estonian", "fa": "Persian", "fi": "Finnish", "fr": "French", "ga": "Irish",
    "he": "Hebrew", "hi": "Hindi", "hr": "Croatian", "hu": "Hungarian", "hy": "Armenian", "id": "Indonesian", "is": "Icelandic", "it": "Italian", "ja": "Japanese", "ka": "Georgian", "kk": "Kazakh", "ko": "Korean", "lt": "Lithuanian", "lv": "Latvian", "mk": "Macedonian",
    "ms": "Malay", "nb": "Norwegian Bokmål", "nl": "Dutch", "no": "Norwegian", "pl": "Polish", "pt": "Portuguese", "ro": "Romanian", "ru": "Russian", "sk": "Slovak", "sl": "Slovenian", "sq": "Albanian", "sr": "Serbian", "sv": "Swedish", "th": "Thai", "tr": "Turkish",
    "uk": "Ukrainian", "ur": "Urdu", "vi": "Vietnamese", "zh": "Chinese",
}


def search_text(labels: Column, kind: str) -> Column:
    """FTS10: the values of a kind, one per line; a language's code is followed by its English name."""
    names = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    written = (lambda v: F.concat_ws(" ", v, F.try_element_at(names, F.lower(v)))) if kind == "language" else (lambda v: v)
    return F.array_join(F.transform(F.filter(labels, lambda x: x["kind"] == kind), lambda x: written(x["value"])), "\n")
