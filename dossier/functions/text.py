"""Text functions: folding, normalising, HTML, names and quality (TXT1-TXT18, UDF2, HSH1-3)."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

#: Letters with marks, and wide forms, with their plain letters by Unicode's decompositions; marks alone go.
_SCRIPTS = [range(0xC0, 0x530), range(0x1E00, 0x2000), range(0xFF01, 0xFF5F)]
_PLAIN = {chr(c): unicodedata.normalize("NFKD", chr(c))[0] for some in _SCRIPTS for c in some if unicodedata.normalize("NFKD", chr(c)) != chr(c) and len("".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x))) == 1}
_FOLDED = {a: b.lower() for a, b in _PLAIN.items() if a == a.lower()}
_MARKS = "".join(map(chr, range(0x300, 0x370)))
TOKEN = r"[\p{L}\p{N}\p{Co}]+"


def bind(value: Column, use) -> Column:
    """use(value), in which value is computed once; within a lambda Spark computes an expression as often as it is written."""
    return F.get(F.transform(F.array(value), use), 0)


def fold(text: Column) -> Column:
    """Lower case without accents, in native expressions (TXT8 for letters that stay one letter)."""
    return F.translate(F.lower(text), "".join(_FOLDED) + _MARKS, "".join(_FOLDED.values()))


def fold_plain(text: str) -> str:
    """What the column function makes of a value, for values at hand."""
    return text.lower().translate({ord(a): b for a, b in _FOLDED.items()} | dict.fromkeys(map(ord, _MARKS)))


def fold_text(text: str) -> str:
    """Case, accent and width folding of any script."""
    plain = unicodedata.normalize("NFKD", text)
    return "".join(c for c in plain if unicodedata.category(c) != "Mn").casefold()


@F.pandas_udf(StringType())
def fold_exact(some: pd.Series) -> pd.Series:
    """TXT8 for any script."""
    return some.map(lambda t: None if t is None else fold_text(t))


def tokens(text: Column) -> Column:
    """FTS1: folded runs of letters and digits."""
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(f"({TOKEN})"), F.lit(1))


def search_key(text: Column) -> Column:
    """TXT7: folded, every run of other characters one space."""
    return F.trim(F.regexp_replace(fold(text), r"[^\p{L}\p{N}]+", " "))


def normalize_text(text: Column) -> Column:
    """TXT1 without the composition of characters: line ends, controls, trailing blanks, runs of blank lines."""
    out = F.regexp_replace(text, "\r\n?", "\n")
    out = F.regexp_replace(out, "\f", "\n\n")
    out = F.regexp_replace(out, "[\\x00-\\x08\\x0B\\x0E-\\x1F\\x7F\\uFEFF]", "")
    out = F.regexp_replace(out, "[ \t]+\n", "\n")
    out = F.regexp_replace(out, "\n{3,}", "\n\n")
    return F.regexp_replace(out, r"^\s+|\s+$", "")


@F.pandas_udf(StringType())
def compose(some: pd.Series) -> pd.Series:
    """NFC, for which Spark has no function."""
    return some.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def normalized(text: Column) -> Column:
    """TXT1: composed characters (NFC), then line ends, controls and blanks."""
    return normalize_text(compose(text))


def one_line(text: Column) -> Column:
    """TXT2: white space of any length is one space."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def cap(text: Column, limit: int) -> Column:
    return F.substring(text, 1, limit)


def filled_lines(text: Column) -> Column:
    """Number of lines that aren't blank."""
    return F.size(F.filter(F.split(text, "\n"), lambda line: F.trim(line) != "")).cast("long")


def shorten(text: Column, limit: int) -> Column:
    """TXT10: at most `limit` characters, cut at the last space where there is one.

    One character more is looked at, so that a word which ends at the limit is whole.
    """
    head = F.substring(text, 1, limit + 1)
    cut = F.when(head.contains(" "), F.regexp_extract(head, "(?s)^(.*) [^ ]*$", 1)).otherwise(F.substring(text, 1, limit))
    return F.when(F.length(text) <= limit, text).otherwise(cut)


def excerpt(text: Column, limit: int) -> Column:
    """TXT11: head and a tail of a sixth, with a mark between."""
    mark, tail = "\n…\n", limit // 6
    short = F.concat(F.substring(text, 1, limit - tail - len(mark)), F.lit(mark), F.right(text, F.lit(tail)))
    return F.when(F.length(text) <= limit, text).otherwise(short)


def page_quality(text: Column, image_share: Column | None = None, least: int = 40, letters: float = 0.35, replaced: float = 0.02, image_chars: int = 200, coverage: float = 0.85) -> Column:
    """TXT12: why a page's text is poor; null if it isn't."""
    visible = F.length(F.regexp_replace(text, r"\s+", ""))
    letter = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    bad = F.length(F.regexp_replace(text, "[^�]+", ""))
    out = F.when(visible < least, "fewCharacters").when(letter / visible < letters, "lowLetterShare").when(bad / visible > replaced, "replacementCharacters")
    return out if image_share is None else out.when((visible < image_chars) & (image_share >= coverage), "fullPageImage")


#: Tags that end a block, and tags whose content is hidden.
_BLOCKS = "p|div|section|article|header|footer|nav|aside|main|ul|ol|li|table|tr|h[1-6]|blockquote|pre|form|dl|dt|dd|figure|hr|br|title"
_HIDDEN = "script|style|head|noscript|template"


def html_text(markup: Column) -> Column:
    """TXT3 in native expressions: hidden parts gone, blocks end a line, cells end with a tab; entities stay."""
    out = F.regexp_replace(markup, "(?s)<!--.*?-->", "")
    out = F.regexp_replace(out, rf"(?si)<({_HIDDEN})\b[^>]*>.*?</\1\s*>", "")
    out = F.regexp_replace(out, r"\s+", " ")
    out = F.regexp_replace(out, r"(?i)</t[dh]\s*>", "\t")
    out = F.regexp_replace(out, rf"(?i)</?({_BLOCKS})\b[^>]*>", "\n")
    out = F.regexp_replace(out, "<[^>]*>", "")
    out = F.regexp_replace(out, r"[ \t]*\n[ \t]*", "\n")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    return F.regexp_replace(out, r"^\s+|\s+$", "")


_ENTITY = re.compile(r"&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});")


def decode_entities(text: str) -> str:
    """TXT4: entities that end with a semicolon; unknown ones stay."""
    return _ENTITY.sub(lambda m: html.unescape(m[0]), text)


@F.pandas_udf(StringType())
def entities(some: pd.Series) -> pd.Series:
    return some.map(lambda t: None if t is None else decode_entities(t))


def file_name(path: Column) -> Column:
    """PRJ1."""
    return F.element_at(F.split(path, "/"), -1)


def safe_name(name: Column) -> Column:
    """TXT14: separators to dashes, controls to spaces, no leading dots."""
    out = F.regexp_replace(name, r"\s*:\s+", " - ")
    out = F.regexp_replace(out, r"[/:\\]", "-")
    out = F.regexp_replace(out, r"[\x00-\x1F\x7F]+", " ")
    return F.regexp_replace(one_line(out), r"^\.+", "")


def made_name(date: Column, sender: Column, title: Column) -> Column:
    """TXT15: `date sender - title`, without what the title repeats of date and sender at its start."""
    bare = F.when(date.isNotNull() & title.startswith(date), F.trim(F.substr(title, F.length(date) + 1))).otherwise(title)
    lower = F.lower(bare)
    bare = F.when(sender.isNotNull() & lower.startswith(F.lower(sender)), F.regexp_replace(F.substr(bare, F.length(sender) + 1), r"^[\s,:–-]+", "")).otherwise(bare)
    who = F.concat_ws(" - ", sender, F.when(bare != "", bare))
    return safe_name(F.concat_ws(" ", date, F.when(who != "", who)))


@F.pandas_udf(StringType())
def bounded_name(stem: pd.Series, extension: pd.Series) -> pd.Series:
    """TXT16: at most 120 characters and 250 bytes, with room for the extension and a suffix."""

    def bound(s: str, e: str) -> str:
        s, room = s[:120], 250 - len((e or "").encode()) - 6
        while len(s.encode()) > room:
            s = s[:-1]
        return s.rstrip() + (e or "")

    return pd.Series([None if s is None else bound(s, e) for s, e in zip(stem, extension, strict=True)])


def natural_key(text: Column) -> Column:
    """UDF2: orders names as people do: numbers by value, accents and case only between names that are else alike.

    A run of digits, of any length, is written with the number of its digits before it; the result has the Unicode
    collation, by which Spark compares it.
    """
    runs = F.regexp_extract_all(text, F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    digits = lambda r: F.regexp_replace(r, "^0+(?=[0-9])", "")
    keyed = F.transform(runs, lambda r: F.when(r.rlike("^[0-9]"), F.concat(F.lpad(F.length(digits(r)).cast("string"), 10, "0"), digits(r))).otherwise(r))
    return F.collate(F.array_join(keyed, ""), "UNICODE")


#: The commonest pairs of letters in Russian.
_PAIRS = "ст но то на ен ов ни ра во ко пр ро по ер ре ал ан ли не от".split()


def decode_bytes(data: bytes) -> tuple[str, str]:
    """TXT5: text and encoding: byte order mark, strict UTF-8, Cyrillic code pages if they read as Russian, Latin."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if data.startswith(mark):
            return data.decode(name, "replace"), name
    try:
        return data.decode("utf-8"), "utf-8"
    except UnicodeDecodeError:
        pass

    def russian(name: str) -> float:
        text = data.decode(name, "replace")
        letters = [c for c in text if c.isalpha()]
        cyrillic = sum("а" <= c <= "я" or c == "ё" for c in letters) / max(1, len(letters))
        return cyrillic * sum(text.count(p) for p in _PAIRS) / max(1, len(text))

    best = max(("cp1251", "koi8-r", "cp866", "iso8859-5"), key=russian)
    return (data.decode(best, "replace"), best) if russian(best) >= 0.1 else (data.decode("cp1252", "replace"), "cp1252")


@F.pandas_udf(StructType().add("text", StringType()).add("encoding", StringType()))
def decoded(some: pd.Series) -> pd.DataFrame:
    rows = [(None, None) if b is None else decode_bytes(bytes(b)) for b in some]
    return pd.DataFrame(rows, columns=["text", "encoding"])


def highlights(marked: Column) -> Column:
    """TXT20: array<struct<text, hit>>: the runs of a snippet, those between U+E000 and U+E001 being hits."""
    runs = F.regexp_extract_all(marked, F.lit("(\ue000[^\ue001]*\ue001?|[^\ue000]+)"), F.lit(1))
    return F.transform(runs, lambda r: F.struct(F.translate(r, "\ue000\ue001", "").alias("text"), r.startswith("\ue000").alias("hit")))


def unmarked(marked: Column) -> Column:
    """TXT20: a snippet as plain text."""
    return F.translate(marked, "\ue000\ue001", "")


def embedding_summary(header: list[Column], body: Column, limit: int = 2000) -> Column:
    """TXT18: header lines that aren't null, then the body, to a limit."""
    return F.substring(F.concat_ws("\n", *header, body), 1, limit)


def package_digest(parts: Column) -> Column:
    """HSH2: SHA-256 of ordered parts, each with its length before it."""
    return F.sha2(F.array_join(F.transform(F.array_sort(parts), lambda p: F.concat(F.length(p).cast("string"), F.lit(":"), p)), ""), 256)


def same_file(size_a: Column, size_b: Column, time_a: Column, time_b: Column, node_a: Column, node_b: Column) -> Column:
    """HSH3: equal size, inode if both are known, and times less than a second apart."""
    nodes = F.coalesce(node_a == node_b, F.lit(True))
    return (size_a == size_b) & nodes & (F.abs(time_a - time_b) < 1)
