"""Rows of literals by column: well-formed text goes through the CSV reader, a column at a time, and anything else is left
to the parser."""

from __future__ import annotations

import re

import pyarrow as pa
from pyarrow import csv

_GAPS = re.compile(r"\s*([,()])\s*")


def _spaced(text: str) -> bool:
    return len(text.split(None, 1)) != 1 or text[:1].isspace() or text[-1:].isspace()


def _broken(frame: str) -> bool:
    """Whether a comma lacks a value before or after it, a quoted part, NUL, stands next to a word, or other marks are left."""
    if frame[:1] in ",\n" or frame[-1:] in ",\n" or any(x in frame for x in (",,", ",\n", "\n,", "\n\n", *"();=<>")):
        return True
    n = frame.count("\0")
    before = frame.count(",\0") + frame.count("\n\0") + frame.startswith("\0")
    after = frame.count("\0,") + frame.count("\0\n") + frame.endswith("\0")
    return before != n or after != n


def text_columns(body: str) -> pa.Table | None:
    """The values after VALUES as columns of text; None unless all rows have one length and the text is plainly well formed.

    Quoted parts are set aside first, so that marks in them aren't taken for
    structure; line feeds then part the rows.
    """
    parts = body.split("'")
    if len(parts) % 2 == 0 or "\0" in body or "\ufeff" in body:
        return None
    frame, quoted = "\0".join(parts[0::2]).strip().removesuffix(";").rstrip(), parts[1::2]
    frame = frame.replace("), (", "),(").replace(", ", ",")
    if _spaced(frame):
        frame = _GAPS.sub(r"\1", frame)
    if frame[:1] != "(" or frame[-1:] != ")" or _spaced(frame):
        return None
    frame = frame[1:-1].replace("),(", "\n")
    if not frame or _broken(frame):
        return None
    if quoted:
        inside = "".join(quoted)
        if "\n" in inside or "\r" in inside:
            return None
        woven = [""] * len(parts)
        woven[0::2], woven[1::2] = frame.split("\0"), quoted
        frame = "'".join(woven)
    width = len(frame.split("\n", 1)[0].split(",")) if not quoted else _fields(frame.split("\n", 1)[0])
    names = [str(i) for i in range(width)]
    data = frame.encode()
    try:
        return csv.read_csv(
            pa.py_buffer(data),
            csv.ReadOptions(use_threads=False, block_size=len(data) + 1, column_names=names),
            csv.ParseOptions(quote_char="'", double_quote=False, escape_char=False, ignore_empty_lines=False),
            csv.ConvertOptions(column_types={n: pa.string() for n in names}, null_values=[], strings_can_be_null=False),
        )
    except (pa.ArrowInvalid, UnicodeEncodeError):
        return None


def _fields(line: str) -> int:
    """Fields of a line whose quoted parts may hold commas."""
    return "".join(line.split("'")[0::2]).count(",") + 1
