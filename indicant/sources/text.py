"""Getting text: files, HTML, tables of documents, and what kind a file is."""

from __future__ import annotations

import json
from collections.abc import Callable
from html.entities import html5

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lists as L
from ..functions.text import let, url_host, url_path

MAX_FILE_BYTES = 100 << 20
MAX_URL_BYTES = 50 << 20


def read_text(spark: SparkSession, paths: str | list[str], max_bytes: int = MAX_FILE_BYTES, strict: bool = True) -> DataFrame:
    """(source_kind, source_value, text) of whole files; malformed bytes are left out.

    A file over max_bytes raises or, unless strict, has an empty text.
    """
    files = spark.read.format("binaryFile").load(paths)
    refused = F.raise_error(F.concat(F.lit("file too large: "), F.col("path"))).cast("binary") if strict else F.lit(b"")
    content = F.when(F.col("length") > max_bytes, refused).otherwise(F.col("content"))
    text = without_malformed(content)
    return files.select(F.lit("file").alias("source_kind"), F.col("path").alias("source_value"), text.alias("text"))


def without_malformed(content: Column) -> Column:
    """Bytes as UTF-8, malformed ones left out; replacement characters of the text itself stay."""
    text, own, stand = content.cast("string"), F.lit("\ufffd"), F.lit("\ue000\uf8ff\ue000")
    fixed = F.replace(F.replace(F.make_valid_utf8(F.replace(text, own, stand)), own, F.lit("")), stand, own)
    return F.when(F.is_valid_utf8(text), text).otherwise(fixed)


def type_by_mime(mime: Column) -> Column:
    low = F.lower(mime)
    return F.when(low.contains("pdf"), "pdf").when(low.contains("html") | low.contains("xml"), "html").when(low.contains("text"), "text")


def type_by_extension(path: Column) -> Column:
    """By the lower-case ending of the file name; text if it says nothing."""
    name = F.substring_index(path, "/", -1)
    ending = F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))
    known = F.create_map(*[F.lit(x) for pair in L.EXTENSION_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, ending), F.lit("text"))


def detect_type(path: Column, mime: Column | None = None) -> Column:
    by_ending = type_by_extension(path)
    return by_ending if mime is None else F.coalesce(type_by_mime(mime), by_ending)


def parser_for(path: Column) -> Column:
    """pdf, html or null: endings count as written, then web addresses are HTML."""
    return F.when(path.endswith(".pdf"), "pdf").when(path.endswith(".html") | path.endswith(".htm") | path.rlike("^https?://"), "html")


def is_valid_url(url: Column) -> Column:
    return url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+")


def temp_filename(url: Column, content_type: Column) -> Column:
    """Name for a download: the last part of the path, or the host, with an ending for its type."""
    last = F.substring_index(F.regexp_replace(url_path(url), "/+$", ""), "/", -1)
    name = F.when(last != "", last).otherwise(F.replace(url_host(url), F.lit("."), F.lit("_")))
    kind = F.lower(content_type)
    ended = name.endswith(".html") | name.endswith(".htm")
    return F.when(kind.contains("application/pdf") & ~name.endswith(".pdf"), F.concat(name, F.lit(".pdf"))).when(
        ~kind.contains("application/pdf") & kind.contains("text/html") & ~ended, F.concat(name, F.lit(".html"))
    ).otherwise(name)


#: The rest of a tag: a quoted value may hold what would end it; a quote that is never closed is a character.
ATTRIBUTES = r"""(?:[^>=]++|=\s*+(?:"[^"]*"|'[^']*'|))*+"""


def html_to_text(html: Column) -> Column:
    """Visible text of a page: script, style, noscript, head and comments fall away, white space becomes one space.

    What is never closed reaches to the page's end.  All named, decimal and hexadecimal
    references are read, names of old without their semicolon too; unknown ones stay as they are.
    A page that is only a web address of under five lines is given back stripped.
    """
    bare = F.regexp_replace(html, r"(?U)^\s+|\s+$", "")
    address = bare.rlike(r"^(?:https?|hxxps?)://") & (F.size(F.split(bare, r"\r\n|\n|\r")) < 5)
    # Comments, and what is no mark-up inside, whichever comes first; then elements that are not shown; then tags.
    text = F.regexp_replace(html, rf"(?is)<!--.*?(?:-->|\z)|<(script|style)\b{ATTRIBUTES}>.*?(?:</\1\s*>|\z)", " ")
    for tag in ("noscript", "head"):
        text = F.regexp_replace(text, rf"(?is)<{tag}\b{ATTRIBUTES}>.*?(?:</{tag}\s*>|\z)", " ")
    text = F.regexp_replace(text, rf"(?s)<[!/a-zA-Z?]{ATTRIBUTES}(?:>|\z)", " ")
    text = let(text, unescaped)
    return F.when(address, bare).otherwise(F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", ""))


REFERENCE = r"&#[xX][0-9a-fA-F]+;?|&#[0-9]+;?|&[a-zA-Z][a-zA-Z0-9]*;?"


def unescaped(text: Column) -> Column:
    """The text with its character references read, each place once: pieces between them and characters by turns."""
    codes = F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0))
    joined = lambda chars: F.array_join(F.transform(F.split(text, REFERENCE), lambda p, i: F.concat(p, F.coalesce(F.get(chars, i), F.lit("")))), "")
    return F.when(F.contains(text, F.lit("&")) & text.rlike(REFERENCE), let(F.transform(codes, character), joined)).otherwise(text)


def character(code: Column) -> Column:
    """The characters of one reference, and what of it the reference does not need."""
    digits = F.regexp_replace(code, "[&#;xX]", "")
    number = F.when(code.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).try_cast("bigint")
    old = let(F.regexp_extract(code, OLD_NAMES, 0), lambda n: F.concat(named(n), F.substr(code, F.length(n) + 1)))
    return F.when(code.startswith("&#"), code_point(number)).otherwise(F.coalesce(F.when(code.endswith(";"), named(code)), old, code))


#: Named references of the standard library's table, and what 0x80 to 0x9F mean on the web: Windows-1252.
NAMED = {f"&{name}": chars for name, chars in html5.items()}
#: The names by their first two letters, as JSON: one literal of the plan, which folds it to a map.
BY_START = json.dumps({start: {n: chars for n, chars in NAMED.items() if n[1:3] == start} for start in {n[1:3] for n in NAMED}}, sort_keys=True)
OLD_NAMES = "^&(?:" + "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))) + ")"
WESTERN = {n: char for n in range(0x80, 0xA0) if (char := bytes([n]).decode("cp1252", "ignore"))}


def named(code: Column) -> Column:
    """The characters of a name, null if unknown; looked up by its first two letters, since a map is searched entry by entry."""
    return F.try_element_at(F.try_element_at(F.from_json(F.lit(BY_START), "map<string,map<string,string>>"), F.substr(code, F.lit(2), F.lit(2))), code)


def code_point(n: Column) -> Column:
    """The character of a code point; what is no character becomes U+FFFD."""
    western = F.create_map(*[F.lit(x) for pair in WESTERN.items() for x in pair])
    good = n.between(1, 0xD7FF) | n.between(0xE000, 0x10FFFF)
    plain = F.when(good, F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")).otherwise("\ufffd")
    return F.coalesce(F.when(n.between(0x80, 0x9F), F.try_element_at(western, n.cast("int"))), plain)


def table_text(tables: Column) -> Column:
    """Text of page tables (arrays of rows of cells): cells by spaces, rows by line feeds, empty ones left out."""
    row = lambda r: F.array_join(F.filter(r, lambda c: c.isNotNull() & (c != "")), " ")
    rows = F.filter(F.transform(tables, row), lambda t: t != "")
    return F.when(F.size(rows) > 0, F.concat(F.array_join(rows, "\n"), F.lit("\n"))).otherwise("")


def pdf_texts(parse: Callable[[bytes], str]) -> Callable[[Column], Column]:
    """A function of PDF bytes to (text, error), with a parser of the caller's choice; null stays null and is not parsed."""

    @F.arrow_udf("struct<text:string,error:string>")
    def run(contents: pa.Array) -> pa.Array:
        out = []
        for c in contents:
            try:
                out.append(None if c.as_py() is None else {"text": parse(c.as_py()), "error": None})
            except Exception as e:  # noqa: BLE001  whatever the parser raises is the file's error
                out.append({"text": None, "error": str(e) or type(e).__name__})
        return pa.array(out, pa.struct([("text", pa.string()), ("error", pa.string())]))

    return run


def read_all(spark: SparkSession, paths: str | list[str], pdf: Callable[[bytes], str] | None = None, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """(source_kind, source_value, kind, text, stage, error): every file once, by its detected type, with what went wrong.

    One scan reads each file's bytes once, whatever kinds there are; those of files over
    max_bytes are not read at all.  A file that cannot be used has a null text, the stage that
    refused it (``size``, ``pdf``) and a reason.  ``dead_letters`` and ``good`` take the two apart.
    """
    files = spark.read.format("binaryFile").load(paths)
    kind = detect_type(F.col("path"))
    head = [F.lit("file").alias("source_kind"), F.col("path").alias("source_value"), kind.alias("kind")]
    none = F.lit(None).cast("string")
    large = files.filter(F.col("length") > max_bytes).select(*head, none.alias("text"), F.lit("size").alias("stage"), F.concat(F.lit("file too large: "), F.col("length").cast("string"), F.lit(" bytes")).alias("error"))
    parsed = F.struct(none.alias("text"), F.when(kind == "pdf", "no PDF parser was given").alias("error")) if pdf is None else pdf_texts(pdf)(F.when(kind == "pdf", F.col("content")))
    some = files.filter(F.col("length") <= max_bytes).select(*head, F.when(kind != "pdf", F.col("content")).alias("content"), parsed.alias("parsed"))
    plain = without_malformed(F.col("content"))
    text = F.when(F.col("kind") == "pdf", F.col("parsed.text")).when(F.col("kind") == "html", html_to_text(plain)).otherwise(plain)
    fit = some.select("source_kind", "source_value", "kind", text.alias("text"), F.when(F.col("parsed.error").isNotNull(), "pdf").alias("stage"), F.col("parsed.error").alias("error"))
    return fit.unionByName(large)


def good(read: DataFrame) -> DataFrame:
    """(source_kind, source_value, text) of the files that could be used."""
    return read.filter("error IS NULL").select("source_kind", "source_value", "text")


def dead_letters(read: DataFrame) -> DataFrame:
    """(source_value, stage, error) of those that could not."""
    return read.filter("error IS NOT NULL").select("source_value", "stage", "error")


def read_documents(spark: SparkSession, paths: str | list[str], pdf: Callable[[bytes], str] | None = None, max_bytes: int = MAX_FILE_BYTES, strict: bool = True) -> DataFrame:
    """(source_kind, source_value, text) of files of mixed kinds, each by its detected type.

    A file that cannot be read raises or, unless strict, gives an empty text, so that one bad
    file does not end a batch.
    """
    read = read_all(spark, paths, pdf, max_bytes)
    refused = F.raise_error(F.concat_ws(": ", "source_value", "error")).cast("string") if strict else F.lit("")
    return read.select("source_kind", "source_value", F.when(F.col("error").isNotNull(), refused).otherwise(F.col("text")).alias("text"))


def read_pdf(spark: SparkSession, paths: str | list[str], parse: Callable[[bytes], str] | None, max_bytes: int = MAX_FILE_BYTES, strict: bool = True) -> DataFrame:
    """The PDF files among paths, as read_documents gives them."""
    return read_documents(spark, paths, parse, max_bytes, strict).filter(type_by_extension(F.col("source_value")) == "pdf")
