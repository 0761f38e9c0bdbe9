"""Column functions on names, sizes and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Short names of stream filters.
FILTER_LABELS = {
    "DCTDecode": "JPEG",
    "FlateDecode": "Flate",
    "JPXDecode": "JPEG2000",
    "CCITTFaxDecode": "CCITT",
    "JBIG2Decode": "JBIG2",
    "LZWDecode": "LZW",
    "RunLengthDecode": "RunLength",
    "Raw": "Raw",
}


def readable_count(value: Column) -> Column:
    """Characters that are neither white space nor control characters (null: 0)."""
    return F.coalesce(F.length(F.regexp_replace(value, r"[\s\p{Z}\p{Cc}]", "")), F.lit(0))


def content_hash(value: Column, prefix: str = "") -> Column:
    """Upper-case SHA-256 of a prefixed string or of bytes."""
    return F.upper(F.sha2(F.concat(F.lit(prefix), value) if prefix else value, 256))


def byte_size(n: Column) -> Column:
    """1536 -> '1.5 KB': base 1024 up to GB, one decimal, a trailing .0 left out; negative numbers are '0 B'."""
    out = F.concat(F.greatest(n, F.lit(0)).cast("long").cast("string"), F.lit(" B"))
    for power, unit in enumerate(("KB", "MB", "GB"), start=1):
        scaled = F.regexp_replace(F.format_string("%.1f", n / F.lit(float(1024**power))), r"\.0$", "")
        out = F.when(n >= 1024**power, F.concat(scaled, F.lit(f" {unit}"))).otherwise(out)
    return out


def filter_label(chain: Column) -> Column:
    """A '+'-joined chain of filter names with short labels; an unknown name loses its slash; null is 'Raw'."""

    def one(name: Column) -> Column:
        bare = F.ltrim(F.regexp_replace(name, "^/", ""))
        out = bare
        for known, label in FILTER_LABELS.items():
            out = F.when(bare == known, F.lit(label)).otherwise(out)
        return out

    return F.array_join(F.transform(F.split(F.coalesce(chain, F.lit("Raw")), r"\+"), one), "+")


def cleaned_name(name: Column) -> Column:
    """report.pdf -> report_cleaned.pdf -> report_cleaned(2).pdf -> report_cleaned(3).pdf; the extension keeps its case."""
    stem, ext = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 2)
    numbered = F.regexp_extract(stem, r"^(.*_cleaned)\(([1-9][0-9]{0,8})\)$", 1)
    number = F.regexp_extract(stem, r"^(.*_cleaned)\(([1-9][0-9]{0,8})\)$", 2)
    new = (
        F.when(numbered != "", F.concat(numbered, F.lit("("), (number.try_cast("long") + 1).cast("string"), F.lit(")")))
        .when(stem.endswith("_cleaned"), F.concat(stem, F.lit("(2)")))
        .otherwise(F.concat(stem, F.lit("_cleaned")))
    )
    return F.concat(new, ext)


def thumbnail_text(value: Column) -> Column:
    """White space alone stands in quotes, so that it can be seen."""
    return F.when(F.trim(F.regexp_replace(value, r"\s", " ")) == "", F.concat(F.lit('"'), value, F.lit('"'))).otherwise(value)


def object_label(value: Column, most: int = 40) -> Column:
    """At most `most` characters, the rest as an ellipsis."""
    return F.when(F.length(value) > most, F.concat(F.substring(value, 1, most), F.lit("…"))).otherwise(value)


def warning_label(is_safe: Column, full_page: Column) -> Column:
    """An unsafe object's warning goes before that of a full-page one."""
    return F.when(~is_safe, "unsafe").when(full_page, "full page").otherwise("")


def size_label(kind: Column, width: Column, height: Column, text: Column) -> Column:
    """Pixels of an image, characters of a text, points of a vector object."""
    box = F.concat(width.cast("string"), F.lit("x"), height.cast("string"))
    return F.when(kind == 1, F.concat(F.length(text).cast("string"), F.lit(" chars"))).when(kind.isin(2, 3), F.concat(box, F.lit(" pt"))).otherwise(box)


def compression_label(kind: Column, chain: Column) -> Column:
    """The filter label of images and shadows; other kinds have none."""
    return F.when(kind.isin(0, 4), filter_label(chain)).otherwise("N/A")


def utf16_hex(value: Column) -> Column:
    """Hex digits as UTF-16BE text; leading zeros fill them up to whole code units."""
    units = F.concat(F.repeat(F.lit("0"), F.pmod(-F.length(value), F.lit(4))), value)
    return F.decode(F.unhex(units), "UTF-16BE")


def progress(completed: Column, total: Column) -> Column:
    """completed/total between 0 and 1; null without a total."""
    return F.when(total > 0, F.least(F.greatest(completed / total, F.lit(0.0)), F.lit(1.0)))


def shown_step(completed: Column, total: Column) -> Column:
    """The step that a progress line names: the one after those completed, never beyond the last."""
    return F.least(completed + 1, F.greatest(total, F.lit(1)))


# All kinds of errors, and what to do about each.
REMEDIES = {
    "DestinationNotWritable": "Choose a folder that may be written to.",
    "DiskFull": "Free some space and try again.",
    "FileInUse": "Close the file in other programs.",
    "ImageExtractionFailed": "The picture cannot be shown; the file can still be cleaned.",
    "ImageRemovalUnsafe": "Leave this object out of the selection.",
    "NotAPdf": "Choose a PDF file.",
    "PdfCorrupted": "Open the file in its program and save it again.",
    "PdfEncrypted": "Remove the password or protection first.",
    "PdfPasswordRequired": "Open the file with its password and save it without.",
    "PostSaveVerificationFailed": "The file is left as it was; report what it holds.",
    "Unexpected": "Try again, and report it if it happens again.",
    "UnsupportedEncryption": "Save the file without protection.",
    "UserCanceled": "Nothing was changed.",
}

#: Exceptions of a reader that meets something that is no sound PDF.
READER_ERRORS = ("PdfError", "error", "ValueError", "KeyError", "IndexError", "TypeError", "RecursionError", "UnicodeDecodeError")
#: Exceptions of input and output.
IO_ERRORS = ("OSError", "IOError", "BlockingIOError", "ConnectionError", "InterruptedError", "TimeoutError")


def error_kind(exception: Column, message: Column) -> Column:
    """Kind of a failure from its exception name and message, by the first rule that holds; a kind's own name is that kind."""
    has = lambda *words: F.lower(F.coalesce(message, F.lit(""))).rlike("|".join(words))
    reader, io = exception.isin(*READER_ERRORS), exception.isin(*IO_ERRORS)
    return (
        F.when(exception.isin(*REMEDIES), exception)
        .when(reader & has("password", "encrypt"), "PdfEncrypted")
        .when(reader & has("not a pdf", "header"), "NotAPdf")
        .when(reader | exception.isin("FileNotFoundError", "NotADirectoryError", "IsADirectoryError"), "PdfCorrupted")
        .when(exception == "PermissionError", "DestinationNotWritable")
        .when(io & has("space", "disk"), "DiskFull")
        .when(io & has("used by another", "being used"), "FileInUse")
        .when(io, "DestinationNotWritable")
        .when(exception.isin("KeyboardInterrupt", "CancelledError", "Py4JInterrupted"), "UserCanceled")
        .otherwise("Unexpected")
    )


def error_remedy(kind: Column) -> Column:
    """What to do about a kind of error; kinds without advice count as unexpected."""
    table = F.create_map(*[F.lit(x) for pair in REMEDIES.items() for x in pair])
    return F.coalesce(F.element_at(table, kind), F.lit(REMEDIES["Unexpected"]))


def file_parts(path: Column) -> tuple[Column, Column, Column]:
    """File name, stem and extension (lower case, with its dot) of a path."""
    return F.regexp_extract(path, "([^/]*)$", 1), F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1), F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
