"""Files to text (SRC4-SRC18): every reader is a column function over `binaryFile` rows (path, content)."""

from __future__ import annotations

import contextlib
import csv
import email
import email.policy
import io
import re
import signal
import threading
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructType

from dossier.functions.text import decode_bytes, decode_entities
from dossier.sources import packages, sheets

#: Names that aren't taken in, first bytes of formats, and limits of readers.
IGNORED_NAMES = [".DS_Store", "Thumbs.db", "desktop.ini"]
IGNORED_PREFIXES = [".", "~$"]
IGNORED_EXTENSIONS = ["tmp", "part", "crdownload", "download"]
MAGIC = [("pdf", "25504446"), ("png", "89504E47"), ("jpeg", "FFD8FF"), ("gif", "47494638"), ("tiff", "49492A00"), ("tiff", "4D4D002A"), ("rtf", "7B5C727466"), ("zip", "504B0304")]
SECONDS = 60
SLIDES, CSV_ROWS = 100, 200


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def skip_reason(path: Column) -> Column:
    """SRC4: why a file isn't taken in; null if it is."""
    name = F.element_at(F.split(path, "/"), -1)
    out = F.when(name.rlike(r"^_.*\.md$"), "managed").when(name.endswith(".sidecar.md"), "sidecar").when(name.isin(IGNORED_NAMES), "name")
    for prefix in IGNORED_PREFIXES:
        out = out.when(name.startswith(prefix), "prefix")
    return out.when(F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).isin(IGNORED_EXTENSIONS), "extension")


def folder_tag(path: Column, root: str) -> Column:
    """SRC5: the first folder below the root."""
    return F.nullif(F.regexp_extract(path, "^" + re.escape(root.rstrip("/")) + r"/([^/]+)/", 1), F.lit(""))


def file_type(path: Column, content: Column) -> Column:
    """SRC6: by extension, else by the first bytes."""
    extension = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})$", 1))
    known = extension.isin("txt", "md", "log", "json", "xml", "yaml", "csv", "tsv", "xlsx", "pptx", "docx", "odt", "html", "htm", "eml", "zip", "pdf", "png", "jpeg", "jpg", "gif", "tiff", "rtf")
    head = F.hex(F.substring(content, 1, 8))
    magic = None
    for kind, first in MAGIC:
        magic = F.when(head.startswith(first), kind) if magic is None else magic.when(head.startswith(first), kind)
    return F.when(known, extension).otherwise(F.coalesce(magic, F.lit("unknown")))


def delimiter_of(text: str) -> str:
    """The commonest of , ; tab | outside quotes in the first record."""
    quoted, counts = False, dict.fromkeys(",;\t|", 0)
    for c in text:
        if c == '"':
            quoted = not quoted
        elif c == "\n" and not quoted:
            break
        elif c in counts and not quoted:
            counts[c] += 1
    return max(counts, key=counts.get)


csv.field_size_limit(1 << 30)  # an open quotation may run through a whole file


def csv_text(data: bytes) -> tuple[str, bool]:
    """SRC9: header and 200 rows as tab-separated text, and whether there were more."""
    text = decode_bytes(data)[0]
    rows = csv.reader(io.StringIO(text, newline=""), delimiter=delimiter_of(text))
    out, more = [], False
    for n, row in enumerate(rows):
        if n > CSV_ROWS:
            more = True
            break
        out.append("\t".join(" ".join(cell.split()) for cell in row))
    return "\n".join(out), more


def _xml(archive: zipfile.ZipFile, name: str):
    return ElementTree.fromstring(archive.read(name)) if name in archive.namelist() else None


def _local(node) -> str:
    return node.tag.rpartition("}")[2]


def _texts(node, tag: str = "t") -> str:
    return "".join(x.text or "" for x in node.iter() if _local(x) == tag)


def xlsx_text(data: bytes) -> tuple[str, list[str]]:
    """SRC10: sheets as `## name` and tab-separated rows, and what was left out."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        return sheets.text(archive)


def pptx_text(data: bytes) -> str:
    """SRC11: paragraphs of the slides, then of each one's notes."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        slides = sorted((int(m[1]), m[0]) for n in archive.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
        out = []
        for n, name in slides[:SLIDES]:
            for part in (name, f"ppt/notesSlides/notesSlide{n}.xml"):
                tree = _xml(archive, part)
                if tree is not None:
                    out += [t for p in tree.iter() if _local(p) == "p" and (t := _texts(p).strip())]
        return "\n".join(out)


def word_text(data: bytes) -> str:
    """SRC12: paragraphs of DOCX or ODT."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        tree = _xml(archive, "word/document.xml")
        if tree is not None:
            return "\n".join(_texts(p) for p in tree.iter() if _local(p) == "p")
        tree = _xml(archive, "content.xml")
        return "\n".join("".join(p.itertext()) for p in tree.iter() if _local(p) in ("p", "h")) if tree is not None else ""


def markup_text(text: str) -> str:
    """TXT3 with entities, for the readers."""
    text = re.sub(r"(?s)<!--.*?-->", "", text)
    text = re.sub(r"(?si)<(script|style|head|noscript|template)\b[^>]*>.*?</\1\s*>", "", text)
    text = re.sub(r"\s+", " ", text)
    text = re.sub(r"(?i)</t[dh]\s*>", "\t", text)
    text = re.sub(r"(?i)</?(?:p|div|section|article|header|footer|nav|ul|ol|li|table|tr|h[1-6]|blockquote|pre|br|hr|title)\b[^>]*>", "\n", text)
    text = decode_entities(re.sub(r"<[^>]*>", "", text))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]*\n[ \t]*", "\n", text)).strip()


def mail_text(data: bytes, depth: int = 2) -> tuple[str, dict[str, str], list[str]]:
    """SRC13: text, headers and attachment names; forwarded messages two deep."""
    message = email.message_from_bytes(data, policy=email.policy.default)
    headers = {k.lower(): str(message[k]) for k in ("Subject", "From", "To", "Date") if message[k]}
    body = message.get_body(("plain", "html"))
    text = ""
    if body is not None:
        text = body.get_content()
        text = markup_text(text) if body.get_content_type() == "text/html" else text
    names = []
    for part in message.iter_attachments():
        if part.get_content_type() == "message/rfc822" and depth:
            inner, some, more = mail_text(part.get_payload(0).as_bytes(), depth - 1)
            text += f"\n\n{some.get('subject', '')}\n{inner}"
            names += more
        elif part.get_filename():
            names.append(part.get_filename())
    return text.strip(), headers, names


def zip_entries(data: bytes) -> tuple[str, dict[str, str], list[str]]:
    """SRC14: names and sizes, without what systems add, from a directory that was checked."""
    every = [e for e in packages.directory(lambda at, n: data[at : at + n], len(data)) if e.listed()]
    listed, whole = every[: packages.LISTED], packages.total(every)
    metadata = {"entries": str(len(every))} | ({} if whole is None else {"uncompressedBytes": str(whole)})
    return "\n".join(f"{e.name}\t{e.size}" for e in listed), metadata, ["truncated"] * (len(every) > len(listed))


def front_matter(text: str) -> tuple[dict[str, str], str]:
    """SRC17: `key: value` lines between fences, lists joined by commas, and the rest."""
    m = re.match(r"(?s)^---\n(.*?)\n---\n?(.*)$", text)
    if not m:
        return {}, text
    out: dict[str, str] = {}
    key = None
    for line in m[1].split("\n"):
        if item := re.match(r"\s+-\s+(.*)", line):
            if key:
                out[key] = f"{out[key]}, {item[1]}".lstrip(", ")
        elif pair := re.match(r"([\w-]+):\s*(.*)", line):
            key, out[pair[1]] = pair[1], pair[2].strip("\"'")
    return out, m[2]


@contextlib.contextmanager
def deadline(seconds: float):
    """Ends what runs in it by a TimeoutError; without effect outside a process's main thread, where Python has no timer."""
    if threading.current_thread() is not threading.main_thread():
        yield
        return

    def end(*_) -> None:
        raise TimeoutError

    before = signal.signal(signal.SIGALRM, end)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


@F.pandas_udf(StructType().add("text", StringType()).add("metadata", MapType(StringType(), StringType())).add("warnings", ArrayType(StringType())))
def extracted(kinds: pd.Series, contents: pd.Series) -> pd.DataFrame:
    """SRC7: text of a file by its type; a file that can't be read, or not in SECONDS, gives a warning and no text."""

    def timed(kind: str, data: bytes) -> tuple[str | None, dict[str, str], list[str]]:
        with deadline(SECONDS):
            return one(kind, data)

    def one(kind: str, data: bytes) -> tuple[str | None, dict[str, str], list[str]]:
        try:
            if kind in ("csv", "tsv"):
                text, more = csv_text(data)
                return text, {}, ["truncated"] * more
            if kind == "eml":
                text, headers, names = mail_text(data)
                return text, headers | ({"attachments": ", ".join(names)} if names else {}), []
            if kind == "zip":
                return zip_entries(data)
            if kind in ("html", "htm"):
                return markup_text(decode_bytes(data)[0]), {}, []
            if kind == "xlsx":
                text, problems = xlsx_text(data)
                return text, {}, problems
            if kind in ("pptx", "docx", "odt"):
                return {"pptx": pptx_text, "docx": word_text, "odt": word_text}[kind](data), {}, []
            if kind in ("txt", "log", "json", "xml", "yaml"):
                text, encoding = decode_bytes(data[: 10 << 20])
                return text, {"encoding": encoding}, []
            if kind == "md":
                fields, text = front_matter(decode_bytes(data)[0])
                return text, fields, []
        except TimeoutError:
            return None, {}, ["deadline"]
        except Exception as e:  # whatever a damaged file makes a parser raise is a finding about that file
            return None, {}, [f"unreadable: {type(e).__name__}"]
        return None, {}, ["noReader"]

    return pd.DataFrame([timed(k, bytes(b or b"")) for k, b in zip(kinds, contents, strict=True)], columns=["text", "metadata", "warnings"])


def extract(files: DataFrame, largest: int = 524_288_000) -> DataFrame:
    """(path, kind, text, metadata, warnings) of files; those over `largest` bytes give metadata only."""
    kind = file_type(F.col("path"), F.col("content"))
    fits = F.col("length") <= largest
    read = files.withColumn("kind", kind).withColumn("x", extracted("kind", F.when(fits, F.col("content"))))
    only = F.struct(F.lit(None).cast("string").alias("text"), F.create_map(F.lit("length"), F.col("length").cast("string")).alias("metadata"), F.array(F.lit("tooLarge")).alias("warnings"))
    return read.withColumn("x", F.when(fits, F.col("x")).otherwise(only)).select("path", "kind", "x.text", "x.metadata", "x.warnings")


def logs(spark: SparkSession, path: str, category: str | None = None, least: str = "info", since: str | None = None) -> DataFrame:
    """SRC18: JSON lines (at, level, category, message)."""
    levels = ["debug", "info", "notice", "warning", "error"]
    out = spark.read.schema("at timestamp, level string, category string, message string, fields map<string,string>").json(path)
    out = out.where(F.col("level").isin(levels[levels.index(least) :]))
    if category:
        out = out.where(F.col("category") == category)
    return out.where(F.col("at") >= F.lit(since).cast("timestamp")) if since else out
