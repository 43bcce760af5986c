"""Regular-expression matches with offsets, as one column expression.

ASCII texts are searched by RE2 in Arrow batches, which reads each letter once; other texts, and patterns that RE2 doesn't have
or reads otherwise, by Java's patterns. Both find the same matches.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from pagemill.functions.text import strip
from pagemill.session import ship_code


def java(pattern: str, flags: str = "i") -> str:
    """``pattern`` with the given flags, Unicode classes, and only line feeds as line ends."""
    return f"(?{flags}dU){pattern}"


BREAK, FIELD = "\x01", "\x02"
#: escapes that mean the same to both engines on ASCII texts; white space is spelled out, as RE2's lacks the vertical tab
_ALIKE, _SPACE = frozenset("dbw.-[](){}$+*?|^/"), r"\t-\r "


def re2(pattern: str) -> str | None:
    """A pattern of :func:`java` as RE2 takes it: the same matches on ASCII texts. None where it may read it otherwise."""
    head = re.match(r"\(\?([im]*)dU\)", pattern)
    if head is None:
        return None
    out, inside, rest = [], False, pattern[head.end() :]
    at = 0
    while at < len(rest):
        one, two = rest[at], rest[at : at + 2]
        if one == "\\":
            if two[1:] == "s":
                out.append(_SPACE if inside else f"[{_SPACE}]")
            elif two[1:] in _ALIKE and not (inside and two[1:] == "b"):
                out.append(two)
            else:
                return None
            at += 2
            continue
        if inside and (one == "[" or two == "&&" or not one.isascii()) or not one.isascii() and one.isalpha():
            return None
        if not inside and (one == "$" or two == "(?" and rest[at + 2 : at + 3] != ":" or two in ("++", "*+", "?+", "}+")):
            return None
        if one == "[":
            inside = True
            if rest[at + 1 : at + 2] == "]":
                return None
            if rest[at + 1 : at + 2] == "^":
                out.append("[^")
                at += 2
                continue
        elif one == "]":
            inside = False
        out.append(one)
        at += 1
    return (f"(?{head[1]})" if head[1] else "") + "".join(out)


def _replaced(pattern: str, by: str):
    """An Arrow function that replaces each match of an RE2 ``pattern``. It is sent whole, so no executor needs this package."""

    def replaced(texts):
        import pyarrow.compute as pc

        return pc.replace_substring_regex(texts, pattern, by)

    replaced.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return replaced


def _parts(text: Column, pattern: str, groups: int, skip: str | None, arrow: bool = True) -> Column:
    """The text in parts: odd ones hold a match and its groups, or what ``skip`` matched and empty groups."""
    fields = "".join(f"{FIELD}${g}" for g in range(1, groups + 1))
    plain = F.translate(text, BREAK + FIELD, "\x04\x04")
    either = pattern if skip is None else f"{pattern}|{skip}"
    marked = F.regexp_replace(plain, either, f"{BREAK}$0{fields}{BREAK}")
    if arrow and (own := re2(pattern)) is not None:
        by = f"{BREAK}\\0" + "".join(f"{FIELD}\\{g}" for g in range(1, groups + 1)) + BREAK
        # Python gets a null for texts that aren't ASCII
        quick = F.arrow_udf(_replaced(own, by), "string")
        marked = F.coalesce(quick(F.when(F.length(plain) == F.octet_length(plain), plain)), marked)
    return F.split(marked, BREAK, -1)


def _skipped(part: Column, groups: int) -> Column:
    return part.endswith(FIELD * groups)


def matches(text: Column, pattern: str, groups: int = 0, skip: str | None = None, arrow: bool = True) -> Column:
    """array<struct<start, match, g1...>>: the non-overlapping matches of a Java ``pattern``, left to right.

    ``start`` counts characters from 0. The pattern runs once: a replacement sets each match and its groups between
    control characters (those of a text become U+0004), and splitting on these gives gaps and matches in turn. Where the
    pattern doesn't match, the search goes on behind what ``skip`` matches there, which must not hold the start of a match;
    with it, the first group must not match an empty text. Without ``arrow`` all texts go to Java's pattern.
    """
    parts = _parts(text, pattern, groups, skip, arrow)
    # odd parts are matches; a fold adds up what lies before each
    begin = F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside"), F.array().cast("array<struct<start:int,part:string>>").alias("found"))

    def step(acc: Column, part: Column) -> Column:
        size = F.length(F.substring_index(part, FIELD, 1))
        wanted = acc["inside"] if skip is None else acc["inside"] & ~_skipped(part, groups)
        found = F.when(wanted, F.array_append(acc["found"], F.struct(acc["at"].alias("start"), part.alias("part")))).otherwise(acc["found"])
        return F.struct((acc["at"] + size).alias("at"), (~acc["inside"]).alias("inside"), found.alias("found"))

    def row(x: Column) -> Column:
        cells = F.split(x["part"], FIELD, -1)
        return F.struct(x["start"].alias("start"), cells[0].alias("match"), *(cells[g].alias(f"g{g}") for g in range(1, groups + 1)))

    return F.transform(F.aggregate(parts, begin, step, lambda acc: acc["found"]), row)


def found(text: Column, pattern: str, groups: int = 0, skip: str | None = None, arrow: bool = True) -> Column:
    """array<struct<match, g1...>>: as :func:`matches` without offsets, which spares the fold."""
    parts = _parts(text, pattern, groups, skip, arrow)
    wanted = lambda part, i: i % 2 == 1 if skip is None else (i % 2 == 1) & ~_skipped(part, groups)
    cells = F.transform(F.filter(parts, wanted), lambda part: F.split(part, FIELD, -1))
    return F.transform(cells, lambda c: F.struct(c[0].alias("match"), *(c[g].alias(f"g{g}") for g in range(1, groups + 1))))


def snippet(text: Column, start: Column, size: Column, before: int, after: int) -> Column:
    """The match with what stands around it, line feeds as spaces."""
    first = F.greatest(start - before, F.lit(0))
    return F.translate(F.substring(text, first + 1, start + size + after - first), "\n", " ")


class Rule(NamedTuple):
    """A pattern of :func:`java`, what :func:`matches` may skip, and what each match holds in lower case (empty: not known)."""

    pattern: str
    skip: str | None = None
    held: str = ""


def _ranges(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """The bytes of ``values`` from each ``begin`` to its ``end``, as texts."""
    size = end - begin
    offsets = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(offsets[-1]) + np.repeat(begin - offsets[:-1], size)
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(values[at]))


def _searched(texts: pa.Array, rules: list[tuple[str, str]], groups: int, around: tuple[int, int] | None) -> Iterator[tuple[int, np.ndarray, np.ndarray, list]]:
    """For each rule (RE2 pattern, what is held) with matches: its number, the text and the place of each match, and its columns."""
    import pyarrow.compute as pc

    by = BREAK + "".join(f"\\{g}{BREAK}" for g in range(groups + 1))
    each = groups + 2  # parts that a match adds
    lowered = pc.ascii_lower(texts) if any(held for _, held in rules) else None
    holding: dict[str, np.ndarray] = {}
    for number, (pattern, held) in enumerate(rules):
        asked, rows = texts, None
        if held:
            if held not in holding:
                holding[held] = np.flatnonzero(pc.match_substring(lowered, held).to_numpy(zero_copy_only=False))
            rows = holding[held]
            if not len(rows):
                continue
            if len(rows) < len(texts):
                asked = texts.take(pa.array(rows))
            else:
                rows = None
        parts = pc.split_pattern(pc.replace_substring_regex(asked, pattern, by), BREAK)
        offsets, flat = parts.offsets.to_numpy().astype(np.int64), parts.values
        counts = np.diff(offsets) // each
        total = int(counts.sum())
        if not total:
            continue
        source = np.repeat(np.arange(len(asked)), counts)
        place = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
        at = offsets[:-1][source] + each * place + 1
        columns = [flat.take(pa.array(at + k)) for k in range(groups + 1)]
        if around is not None:
            length = np.concatenate([[0], np.cumsum(pc.binary_length(flat).to_numpy(zero_copy_only=False).astype(np.int64))])
            own = length[at + 1 + groups] - length[at + 1]  # letters of groups, which don't count for places
            before = np.cumsum(own) - own
            start = length[at] - length[offsets[:-1][source]] - (before - before[(np.cumsum(counts) - counts)[source]])
            stop = start + length[at + 1] - length[at]
            bounds = np.frombuffer(asked.buffers()[1], np.int32)[asked.offset : asked.offset + len(asked) + 1].astype(np.int64)
            values = np.frombuffer(asked.buffers()[2], np.uint8)
            low = np.maximum(start - around[0], 0)
            columns += [pa.array(start, pa.int32()), _ranges(values, bounds[:-1][source] + low, np.minimum(bounds[:-1][source] + stop + around[1], bounds[1:][source]))]
        yield number, source if rows is None else rows[source], place, columns


def every_match(rows: DataFrame, columns: list[str], rules: list[Rule], groups: int, around: tuple[int, int] | None = None) -> DataFrame:
    """A row for each match of some patterns in ``text``: ``columns`` of its row, rule (its number), match_index, match, g1...

    Groups come without white space at their ends. With ``around`` also ``start`` (characters from 0) and ``around``, the match
    with so many characters before and behind it. The text is read once and a row holds what belongs to its match only. ASCII
    texts are searched in Arrow batches, others by Java's patterns before, with the same results.
    """
    cells = [f"g{g}" for g in range(1, groups + 1)]
    placed = ["start", "around"] if around is not None else []
    names = ["rule", "match_index", "match", *cells, *placed]
    kinds = {"rule": IntegerType(), "match_index": IntegerType(), "start": IntegerType()}
    schema = StructType([*(rows.schema[c] for c in columns), *(StructField(n, kinds.get(n, StringType())) for n in names)])
    own = [(re2(rule.pattern), rule.held) for rule in rules]
    width = len(columns)

    def row(number: int):
        def made(m: Column, k: Column) -> Column:
            near = []
            if around is not None:
                low = F.greatest(m["start"] - around[0], F.lit(0))
                near = [m["start"].alias("start"), F.substring(F.col("text"), low + 1, m["start"] + F.length(m["match"]) + around[1] - low).alias("around")]
            return F.struct(F.lit(number).alias("rule"), k.alias("match_index"), m["match"].alias("match"), *(strip(m[c]).alias(c) for c in cells), *near)

        return made

    search = found if around is None else matches
    by_java = F.concat(*(F.transform(search(F.col("text"), rule.pattern, groups, rule.skip, False), row(k)) for k, rule in enumerate(rules)))
    if any(pattern is None for pattern, _ in own):
        return rows.select(*columns, F.explode(by_java).alias("m")).select(*columns, "m.*")

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for batch in batches:
            if not batch.num_rows:
                continue
            texts, other = batch.column(width), batch.column(width + 1)
            for number, source, place, made in _searched(pc.fill_null(texts, "") if texts.null_count else texts, own, groups, around):
                at = pa.array(source)
                made[1 : groups + 1] = [pc.ascii_trim_whitespace(c) for c in made[1 : groups + 1]]
                held = [batch.column(k).take(at) for k in range(width)]
                yield pa.RecordBatch.from_arrays([*held, pa.array(np.full(len(source), number, np.int32)), pa.array(place.astype(np.int32)), *made], [*columns, *names])
            if other.null_count < len(other):
                made = [(at, m) for at, found_there in enumerate(other.to_pylist()) if found_there for m in json.loads(found_there)]
                at = pa.array([at for at, _ in made], pa.int64())
                own_columns = [pa.array([m.get(n) for _, m in made], pa.int32() if n in kinds else pa.string()) for n in names]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(width)), *own_columns], [*columns, *names])

    ship_code(rows.sparkSession)
    # as text, since a batch's size is looked at row by row, which takes long for nested columns
    text = F.col("text")
    plain = (F.length(text) == F.octet_length(text)) & ~text.contains(BREAK) & ~text.contains(FIELD)
    return rows.select(*columns, F.when(plain, text).alias("plain"), F.when(~plain, F.to_json(by_java)).alias("other")).mapInArrow(searched, schema)
