"""SRC10: sheets of an XLSX workbook, found by their relationships, with shared, inline and computed cells, dates and percentages."""

from __future__ import annotations

import datetime
import posixpath
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.etree import ElementTree

#: Sheets, rows and columns that are read, and the built-in formats that show days, times or percentages.
SHEETS, ROWS, COLUMNS = 20, 300, 30
DAYS, TIMES, BOTH, SHARES = {14, 15, 16, 17, *range(27, 32), *range(34, 37), *range(50, 59)}, {18, 19, 20, 21, 32, 33, 45, 46, 47}, {22}, {9, 10}
_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


@dataclass(frozen=True)
class Cell:
    """raw: as written, without its format; shown: days and times in ISO form, shares with a percent sign."""

    raw: str
    shown: str


@dataclass
class Sheet:
    number: int
    name: str
    rows: list[tuple[int, list[Cell]]] = field(default_factory=list)
    problem: str | None = None


def _local(node) -> str:
    return node.tag.rpartition("}")[2]


def _all(tree, tag: str) -> Iterator:
    return (x for x in tree.iter() if _local(x) == tag) if tree is not None else iter(())


def _part(archive: zipfile.ZipFile, name: str):
    return ElementTree.fromstring(archive.read(name)) if name in archive.NameToInfo else None


def _relations(archive: zipfile.ZipFile, part: str) -> dict[str, tuple[str, str]]:
    """Id to the last word of its kind and the part it names."""
    folder, name = posixpath.split(part)
    found = {}
    for x in _all(_part(archive, f"{folder}/_rels/{name}.rels".lstrip("/")), "Relationship"):
        target = x.get("Target", "")
        found[x.get("Id")] = (x.get("Type", "").rpartition("/")[2], target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target)))
    return found


def _text(node) -> str:
    """The text of runs, without what tells how it is read."""
    return "".join(t.text or "" for t in node if _local(t) == "t") + "".join(t.text or "" for r in node if _local(r) == "r" for t in r if _local(t) == "t")


def _format(number: int, code: str | None) -> str:
    """What a number's format shows: day, time, both, share, or nothing of these."""
    if code is None:
        return "day" if number in DAYS else "time" if number in TIMES else "both" if number in BOTH else "share" if number in SHARES else ""
    bare = re.sub(r'"[^"]*"|\\.|_.|\*.', "", code.split(";")[0])
    elapsed = re.search(r"\[(h+|m+|s+)\]", bare, re.I)
    bare = re.sub(r"\[[^\]]*\]", "", bare).lower()
    time, day = bool(elapsed) or bool(re.search("[hs]", bare)), bool(re.search("[yd]", bare)) or ("m" in bare and not re.search("[hs]", bare) and not elapsed)
    return "both" if time and day else "time" if time else "day" if day else "share" if "%" in bare else ""


def _styles(tree) -> list[str]:
    codes = {int(x.get("numFmtId")): x.get("formatCode", "") for x in _all(tree, "numFmt")}
    for formats in _all(tree, "cellXfs"):
        return [_format(n, codes.get(n)) for x in formats if _local(x) == "xf" for n in [int(x.get("numFmtId", 0))]]
    return []


def _shown(raw: str, form: str, from_1904: bool) -> str:
    try:
        number = float(raw)
    except ValueError:
        return raw
    if form == "share":
        return f"{number * 100:.10g}%"
    if form not in ("day", "time", "both") or not 0 <= number < 2_958_466:
        return raw
    # Whole days since the epoch; the year 1900 has a 29 February there which never was.
    days = int(number)
    seconds = round((number - days) * 86_400)
    epoch = datetime.datetime(1904, 1, 1) if from_1904 else datetime.datetime(1899, 12, 31 if number < 60 else 30)
    at = epoch + datetime.timedelta(days=days, seconds=seconds)
    return at.strftime("%H:%M:%S") if form == "time" else at.strftime("%Y-%m-%d") if form == "day" else at.strftime("%Y-%m-%d %H:%M:%S")


def _column(reference: str | None) -> int | None:
    letters = re.match("[A-Z]+", reference or "")
    if not letters:
        return None
    out = 0
    for c in letters[0][:4]:
        out = out * 26 + ord(c) - 64
    return out - 1


def _cells(row, strings: list[str], styles: list[str], from_1904: bool) -> list[Cell]:
    out: list[Cell] = []
    at = -1
    for c in row:
        if _local(c) != "c":
            continue
        place = _column(c.get("r"))
        at = at + 1 if place is None else place
        if at >= COLUMNS:
            continue
        kind = c.get("t", "n")
        value = next((x.text or "" for x in c if _local(x) == "v"), "")
        if kind == "s":
            raw = strings[int(value)] if value.isdigit() and int(value) < len(strings) else ""
        elif kind == "inlineStr":
            raw = "".join(_text(x) for x in c if _local(x) == "is")
        else:
            raw = value
        style = c.get("s", "")
        form = styles[int(style)] if style.isdigit() and int(style) < len(styles) else ""
        out += [Cell("", "")] * (at + 1 - len(out))
        out[at] = Cell(raw, {"0": "FALSE", "1": "TRUE"}.get(raw, raw) if kind == "b" else _shown(raw, form, from_1904) if kind == "n" and raw else raw)
    return out


def workbook(archive: zipfile.ZipFile) -> Iterator[Sheet]:
    """The first sheets of a workbook in its order, with their filled rows among the first."""
    main = next((part for kind, part in _relations(archive, "").values() if kind == "officeDocument"), "xl/workbook.xml")
    book = _part(archive, main)
    if book is None:
        raise ValueError("no workbook")
    related = _relations(archive, main)
    named = {kind: part for kind, part in related.values()}
    shared = _part(archive, named.get("sharedStrings", "xl/sharedStrings.xml"))
    strings = [_text(x) for x in _all(shared, "si")]
    styles = _styles(_part(archive, named.get("styles", "xl/styles.xml")))
    from_1904 = any(x.get("date1904") in ("1", "true") for x in _all(book, "workbookPr"))
    every = list(_all(book, "sheet"))
    for number, x in enumerate(every[:SHEETS], 1):
        sheet = Sheet(number, x.get("name", ""))
        _, part = related.get(x.get(_RELATION), ("", "")) if related else ("", f"xl/worksheets/sheet{number}.xml")
        if part not in archive.NameToInfo:
            sheet.problem = "its part is missing"
        else:
            try:
                _fill(sheet, archive, part, strings, styles, from_1904)
            except ElementTree.ParseError:
                sheet.problem = "not well-formed"
        if number == SHEETS < len(every):
            sheet.problem = f"first {SHEETS} of {len(every)} sheets"
        yield sheet


def _fill(sheet: Sheet, archive: zipfile.ZipFile, part: str, strings: list[str], styles: list[str], from_1904: bool) -> None:
    """Rows as they are parsed, so that a large sheet isn't held; parsing ends after the last row wanted."""
    last = 0
    with archive.open(part) as file:
        for _, node in ElementTree.iterparse(file):
            if _local(node) != "row":
                continue
            last = int(node.get("r")) if (node.get("r") or "").isdigit() else last + 1
            if last > ROWS:
                sheet.problem = f"first {ROWS} rows"
                return
            cells = _cells(node, strings, styles, from_1904)
            if any(c.raw for c in cells):
                sheet.rows.append((last, cells))
            node.clear()


def text(archive: zipfile.ZipFile) -> tuple[str, list[str]]:
    """Sheets as `## name` and tab-separated rows, and what was left out or couldn't be read."""
    out, problems = [], []
    for sheet in workbook(archive):
        one_line = lambda x: " ".join(x.split())
        out.append("\n".join([f"## {sheet.name}", *("\t".join(one_line(c.raw) for c in cells) for _, cells in sheet.rows)]))
        if sheet.problem:
            problems.append(f"sheet {sheet.name}: {sheet.problem}")
    return "\n\n".join(out), problems
