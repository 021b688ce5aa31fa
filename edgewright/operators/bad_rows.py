"""Loading untidy lines: typed rows for the valid ones, a reason for each failing one.

Blocks of lines are tested in bulk by one columnar pattern that accepts only what is
plainly in order. A block that fails is cut in two, again and again, the failures of
either half being known from their running count, until the offending lines stand alone. The
clean stretches between them stay Arrow slices and are typed in bulk; the single lines
go through the strict parser, which either loads them (quoted but sound) or names the
reason of failure.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Largest number an edge list may hold.
MAX_NUMBER = 2147483647
PARSED = "line_id bigint, file_name string, u bigint, v bigint, weight bigint, r string, h string, t string, reason string"


@dataclass(frozen=True)
class LineFormat:
    """How the lines of a file are built: kinds of its columns (``int``, ``relation``, ``value``) and the separator."""

    columns: tuple[str, ...]
    kinds: tuple[str, ...]
    tab_only: bool = False


FORMATS = {
    "higgs-retweet_network.edgelist": LineFormat(("u", "v", "weight"), ("int", "int", "int")),
    "facebook_combined.txt": LineFormat(("u", "v"), ("int", "int")),
    "train.txt": LineFormat(("r", "h", "t"), ("relation", "value", "value"), tab_only=True),
}


class QuotingError(ValueError):
    """A quote that isn't closed, opens inside a field or is followed by text."""


def split_strict(line: str, tab_only: bool) -> list[str]:
    """Fields of one line; raises QuotingError.

    With ``tab_only`` one tab parts two fields and spaces around a field don't count;
    otherwise any run of spaces and tabs parts fields and those at the ends don't count.
    """
    gap = "\t" if tab_only else " \t"
    fields: list[str] = []
    i, n = 0, len(line)
    while True:
        while i < n and line[i] in (" " if tab_only else gap):
            i += 1
        if not tab_only and i >= n:
            return fields
        if i < n and line[i] == '"':
            held, i = [], i + 1
            while True:
                end = line.find('"', i)
                if end < 0:
                    raise QuotingError
                held.append(line[i:end])
                i = end + 1
                if i < n and line[i] == '"':
                    held.append('"')
                    i += 1
                else:
                    break
            fields.append("".join(held))
            while tab_only and i < n and line[i] == " ":
                i += 1
            if i < n and line[i] not in gap:
                raise QuotingError
        else:
            end = i
            while end < n and line[end] not in gap:
                if line[end] == '"':
                    raise QuotingError
                end += 1
            fields.append(line[i:end].rstrip(" ") if tab_only else line[i:end])
            i = end
        if tab_only:
            if i >= n:
                return fields
            i += 1


_DIGITS = re.compile(r"[0-9]+")


def convert(fields: list[str], kinds: tuple[str, ...], relations: frozenset[str]) -> list[int | str] | None:
    """Typed values, or None if one is invalid."""
    out: list[int | str] = []
    for text, kind in zip(fields, kinds):
        if kind == "int":
            if not _DIGITS.fullmatch(text) or len(text.lstrip("0")) > 10 or int(text) > MAX_NUMBER:
                return None
            out.append(int(text))
        elif kind == "relation":
            name = text[3:] if text.startswith("/r/") else text
            if name not in relations:
                return None
            out.append(name)
        else:
            if "�" in text or not any(c.isalnum() for c in text):
                return None
            out.append(text)
    return out


def parse_line(line: str, form: LineFormat, relations: frozenset[str]) -> tuple[list[int | str] | None, str | None]:
    """(values, None) or (None, reason), the first of quoting, column_count, invalid_value."""
    try:
        fields = split_strict(line.rstrip("\r"), form.tab_only)
    except QuotingError:
        return None, "quoting"
    if len(fields) != len(form.columns):
        return None, "column_count"
    values = convert(fields, form.kinds, relations)
    return (None, "invalid_value") if values is None else (values, None)


def plain_pattern(form: LineFormat, relations: frozenset[str]) -> str:
    """Pattern of the lines that are valid beyond doubt: no quotes, ASCII values, numbers well below the largest."""
    if not form.tab_only:
        return r"^[ \t]*" + r"[ \t]+".join([r"[0-9]{1,9}"] * len(form.columns)) + r"[ \t]*\r*$"
    names = "|".join(re.escape(x) for x in sorted(relations)) or "[^\\s\\S]"
    held = {"int": "[0-9]{1,9}", "relation": f"(?:/r/)?(?:{names})", "value": '[^\\t"\\r\ufffd]*[0-9A-Za-z][^\\t"\\r\ufffd]*'}
    return "^" + "\\t".join(f" *{held[k]} *" for k in form.kinds) + r"\r*$"


def bisect_block(bad: np.ndarray) -> tuple[list[tuple[int, int]], list[int]]:
    """(clean stretches as (start, length), failing lines) of a block, by halving whatever holds a failing line."""
    before = np.concatenate([[0], np.cumsum(bad)]).tolist()
    clean: list[tuple[int, int]] = []
    single: list[int] = []
    todo = [(0, len(bad))] if len(bad) else []
    while todo:
        at, n = todo.pop()
        if before[at + n] == before[at]:
            clean.append((at, n))
        elif n == 1:
            single.append(at)
        else:
            half = n // 2
            todo += [(at + half, n - half), (at, half)]
    return clean, single


def _typed(lines: pa.Array, form: LineFormat) -> list[pa.Array]:
    """Columns of lines that are plainly valid."""
    text = pc.utf8_rtrim(lines, "\r")
    parts = pc.split_pattern(text, "\t") if form.tab_only else pc.split_pattern_regex(pc.utf8_trim(text, " \t"), "[ \t]+")
    out = []
    for i, kind in enumerate(form.kinds):
        value = pc.utf8_trim(pc.list_element(parts, i), " ")
        if kind == "relation":
            value = pc.replace_substring_regex(value, "^/r/", "")
        out.append(pc.cast(value, pa.int64()) if kind == "int" else value)
    return out


def parse_block(lines: pa.Array, form: LineFormat, relations: frozenset[str], pattern: str | None = None, typed: bool = True) -> tuple[list[tuple[int, int]], list[pa.Array], list[tuple[int, list | None, str | None]]]:
    """(clean stretches, their typed columns one after the other, (line, values or None, reason or None) of each other line)."""
    plain = pc.match_substring_regex(lines, pattern or plain_pattern(form, relations))
    clean, single = bisect_block(~plain.to_numpy(zero_copy_only=False))
    columns: list[pa.Array] = []
    if typed and clean:
        columns = _typed(pa.concat_arrays([lines.slice(at, n) for at, n in clean]), form)
    return clean, columns, [(k, *parse_line(lines[k].as_py(), form, relations)) for k in single]


_EMPTY = r"^[ \t\r]*$"


def parse_lines(lines: DataFrame, relations: DataFrame, formats: dict[str, LineFormat] | None = None, only_failing: bool = False) -> DataFrame:
    """Every line that counts, once: typed values with a null ``reason``, or a ``reason`` with null values.

    ``lines`` has ``line_id``, ``file_name``, ``line``; ``relations`` has ``relation``
    (a fixed list of names, sent with the task). Null lines, blank lines (space, tab,
    carriage return) and lines beginning with ``#`` are left out, as are lines of files
    without a format. Null line ids are kept; repeated lines are parsed each; other
    columns are ignored; an empty table gives no rows. A very long line is one record
    like any other. Nothing is shuffled. With ``only_failing`` valid lines are tested but
    neither typed nor returned.
    """
    forms = formats or FORMATS
    names = frozenset(x.relation for x in relations.select("relation").filter("relation is not null").distinct().collect())
    patterns = {name: plain_pattern(form, names) for name, form in forms.items()}
    types = {"line_id": pa.int64(), "u": pa.int64(), "v": pa.int64(), "weight": pa.int64()}
    schema = pa.schema([(n, types.get(n, pa.string())) for n in ("line_id", "file_name", "u", "v", "weight", "r", "h", "t", "reason")])

    def rows(held: dict[str, pa.Array], n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([held[f.name] if f.name in held else pa.nulls(n, f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, form in forms.items():
                block = batch.filter(pc.equal(batch.column("file_name"), name))
                if not block.num_rows:
                    continue
                clean, columns, others = parse_block(block.column("line"), form, names, patterns[name], typed=not only_failing)
                if columns:
                    ids = pa.concat_arrays([block.column("line_id").slice(at, n) for at, n in clean])
                    yield rows({"line_id": ids, "file_name": pa.repeat(pa.scalar(name), len(ids)), **dict(zip(form.columns, columns))}, len(ids))
                others = [x for x in others if x[2] is not None or not only_failing]
                if others:
                    values = {c: pa.array([x[1][i] if x[1] else None for x in others], schema.field(c).type) for i, c in enumerate(form.columns)}
                    ids = block.column("line_id").take(pa.array([x[0] for x in others]))
                    yield rows({"line_id": ids, "file_name": pa.repeat(pa.scalar(name), len(ids)), "reason": pa.array([x[2] for x in others], pa.string()), **values}, len(ids))

    told = lines.select(F.col("line_id").cast("bigint").alias("line_id"), "file_name", "line")
    counted = told.filter(F.col("file_name").isin(*forms) & F.col("line").isNotNull() & ~F.col("line").rlike(_EMPTY) & ~F.col("line").startswith("#"))
    return counted.mapInArrow(run, PARSED)


def failing_lines(lines: DataFrame, relations: DataFrame) -> DataFrame:
    """``line_id``, ``reason`` of the failing lines."""
    return parse_lines(lines, relations, only_failing=True).select("line_id", "reason")


def loaded_rows(lines: DataFrame, relations: DataFrame) -> DataFrame:
    """The valid lines as typed rows: ``line_id``, ``file_name``, ``u``, ``v``, ``weight``, ``r``, ``h``, ``t``."""
    return parse_lines(lines, relations).filter("reason is null").drop("reason")
