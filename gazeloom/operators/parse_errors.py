"""Rows that fail to parse: minimum-cost error parses of CSV lines and of JSON objects.

A record is reduced to the string of its structural symbols, on which a dynamic program finds the
cheapest list of inserted and deleted quotes and delimiters that turns it into a well-formed record
of the expected shape. A parse of cost zero is the record itself; its values are then checked
against their types, in Spark expressions. Otherwise the edits state the reason. Records share few
structures, so a task solves each structure once.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARSED = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("quotes", "texts", "delimiters")] + [T.StructField("edits", T.StringType()), T.StructField("fields", T.ArrayType(T.StringType()))]
)


class Cost(NamedTuple):
    """Numbers of edits, in order of weight: one of quotes outweighs all of text, that all of delimiters.

    So only a line that isn't well quoted gets edits of quotes.
    """

    quotes: int = 0
    texts: int = 0
    delimiters: int = 0


FREE, QUOTE, TEXT, DELIMITER = Cost(), Cost(quotes=1), Cost(texts=1), Cost(delimiters=1)


@dataclass(frozen=True)
class Step:
    """A move of the parser: cost, the state it leads to, the symbols it reads, the edit it makes."""

    cost: Cost
    state: tuple
    reads: int
    edit: str


FAR = 1 << 61


class Grammar:
    """A parser's moves as one matrix per symbol: the cheapest way from state to state that reads it.

    steps(state, symbol) yields moves (symbol is '' at the end). Moves that read nothing lead between
    states at the same place, so a way is any number of them and one that reads.
    """

    def __init__(self, start: tuple, steps: Callable[[tuple, str], Iterator[Step]], symbols: str, final: Callable[[tuple], bool]):
        self.states = [start]
        number = {start: 0}
        for state in self.states:  # grows
            for symbol in ("", *symbols):
                for step in steps(state, symbol):
                    if step.state not in number:
                        number[step.state] = len(self.states)
                        self.states.append(step.state)
        self.ways = {symbol: [self._ways(state, symbol, steps, number) for state in self.states] for symbol in ("", *symbols)}
        self.final = [i for i, state in enumerate(self.states) if final(state)]

    @staticmethod
    def _ways(state: tuple, symbol: str, steps, number: dict) -> dict[int, tuple[Cost, tuple[str, ...]]]:
        """State reached: (cost, edits), after reading symbol or, at the end, without reading."""
        best: dict[tuple, tuple[Cost, tuple[str, ...]]] = {state: (FREE, ())}
        reached: dict[int, tuple[Cost, tuple[str, ...]]] = {}
        todo = [state]
        while todo:
            here = todo.pop(0)
            cost, edits = best[here]
            for step in steps(here, symbol):
                total = Cost(*map(sum, zip(cost, step.cost))), edits + ((step.edit,) if step.edit else ())
                if step.reads and total < reached.get(number[step.state], (Cost(FAR),)):
                    reached[number[step.state]] = total
                elif not step.reads and total < best.get(step.state, (Cost(FAR),)):
                    best[step.state] = total
                    todo.append(step.state)
        return reached if symbol else {number[s]: w for s, w in best.items()}

    def cheapest(self, symbols: str) -> tuple[Cost, str]:
        """The least cost of reading all symbols from the start to a final state, and the edits made.

        Per place and state one byte leads the way back, so edits are listed for records of any
        length. Costs are held relative to the place's least, so they stay small.
        """
        base = 4 * len(symbols) + 64  # more edits than any cheapest way makes
        weigh = lambda c: (c.quotes * base + c.texts) * base + c.delimiters
        n = len(self.states)
        matrices = {}
        for symbol in {"", *symbols}:
            matrix = matrices[symbol] = np.full((n, n), FAR)  # to, from
            for s, ways in enumerate(self.ways[symbol]):
                for t, (cost, _) in ways.items():
                    matrix[t, s] = weigh(cost)
        here = np.full(n, FAR)
        here[0] = 0
        total, rows = 0, np.arange(n)
        came = np.empty((len(symbols) + 1, n), np.uint8)
        for i, symbol in enumerate((*symbols, "")):
            ways = matrices[symbol] + here
            best = ways.argmin(1)
            came[i] = best
            here = ways[rows, best]
            least = int(here.min())
            total += least
            here = np.minimum(here - least, FAR)
        end = min(self.final, key=lambda s: (here[s], s))
        total += int(here[end])
        edits, at = [], end
        for i in range(len(symbols), -1, -1):
            before = int(came[i, at])
            made = self.ways[symbols[i] if i < len(symbols) else ""][before][at][1]
            edits += [f"{e}@{i}" for e in reversed(made)]
            at = before
        high, delimiters = divmod(total, base)
        return Cost(*divmod(high, base), delimiters), " ".join(reversed(edits))


# --- CSV -----------------------------------------------------------------------------------------

BEGIN, PLAIN, QUOTED, CLOSED = range(4)
FIELD = re.compile(r'"(?:[^"]|"")*"|[^",]*', re.DOTALL)


def csv_structure(line: str) -> str:
    """Quotes and commas of a line, with x for every stretch of other characters."""
    return re.sub(r'[^",]+', "x", line)


def csv_steps(width: int):
    """Moves over a CSV line. A state is (place in the field, number of the field)."""

    def steps(state: tuple, symbol: str) -> Iterator[Step]:
        place, field = state
        if symbol == '"':
            if place in (BEGIN, CLOSED):  # opens, or is the second of a doubled quote
                yield Step(FREE, (QUOTED, field), 1, "")
            elif place == QUOTED:
                yield Step(FREE, (CLOSED, field), 1, "")
            yield Step(QUOTE, state, 1, "-quote")
        elif symbol == "x":
            if place in (BEGIN, PLAIN):
                yield Step(FREE, (PLAIN, field), 1, "")
            elif place == QUOTED:
                yield Step(FREE, state, 1, "")
        elif symbol == ",":
            if place == QUOTED:
                yield Step(FREE, state, 1, "")
            else:
                if field < width:
                    yield Step(FREE, (BEGIN, field + 1), 1, "")
                yield Step(DELIMITER, (BEGIN, field), 1, "-delimiter")
        if symbol in ("", ",") and place != QUOTED and field < width:
            yield Step(DELIMITER, (BEGIN, field + 1), 0, "+delimiter")
        if place != PLAIN:
            yield Step(QUOTE, (CLOSED if place == QUOTED else QUOTED, field), 0, "+quote")

    return steps


@lru_cache
def csv_grammar(width: int) -> Grammar:
    return Grammar((BEGIN, 1), csv_steps(width), '",x', lambda s: s[0] != QUOTED and s[1] == width)


def csv_parse(structure: str, width: int) -> tuple[Cost, str]:
    return csv_grammar(width).cheapest(structure)


def csv_fields(line: str) -> list[str]:
    """The fields of a line whose parse costs nothing."""
    fields, i = [], 0
    while True:
        match = FIELD.match(line, i)
        text = match[0]
        fields.append(text[1:-1].replace('""', '"') if text.startswith('"') else text)
        i = match.end() + 1
        if i > len(line):
            return fields


# --- JSON ----------------------------------------------------------------------------------------

LITERAL = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null", re.ASCII)
STRING = re.compile(r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"')
SPACE = " \t\r\n"


def json_structure(text: str) -> tuple[str, list[str]]:
    """A symbol per token of a flat JSON object, and the tokens.

    s a string, n another scalar or a well-formed container inside the object, w a stretch that is
    no token; braces, brackets, colon, comma and a lone quote stand for themselves.
    """
    symbols, tokens, i = [], [], 0
    decoder = json.JSONDecoder(parse_constant=_no_constant)
    while i < len(text):
        c = text[i]
        if c in SPACE:
            i += 1
            continue
        end, symbol = i + 1, c
        if c == '"':
            if match := STRING.match(text, i):
                end, symbol = match.end(), "s"
        elif c in "{[" and symbols:
            try:
                end, symbol = decoder.raw_decode(text, i)[1], "n"
            except (ValueError, RecursionError):
                pass
        elif c not in "{}[]:,":
            while end < len(text) and text[end] not in '{}[]:,"' + SPACE:
                end += 1
            symbol = "n" if LITERAL.fullmatch(text, i, end) else "w"
        symbols.append(symbol)
        tokens.append(text[i:end])
        i = end
    return "".join(symbols), tokens


def _no_constant(name: str):
    raise ValueError(name)


OUTSIDE, KEY_OR_END, KEY, COLON, VALUE, NEXT, DONE = range(7)


def json_steps(state: tuple, symbol: str) -> Iterator[Step]:
    """Moves over a flat JSON object. A state is (what is expected,)."""
    (place,) = state
    reads = {
        (OUTSIDE, "{"): KEY_OR_END, (KEY_OR_END, "s"): COLON, (KEY_OR_END, "}"): DONE, (KEY, "s"): COLON,
        (COLON, ":"): VALUE, (VALUE, "s"): NEXT, (VALUE, "n"): NEXT, (NEXT, ","): KEY, (NEXT, "}"): DONE,
    }
    if (place, symbol) in reads:
        yield Step(FREE, (reads[place, symbol],), 1, "")
    if symbol in ("n", "w") and place in (KEY_OR_END, KEY, VALUE):
        yield Step(Cost(quotes=2), (NEXT if place == VALUE else COLON,), 1, "+quote")
    if symbol:
        kind = "-quote" if symbol in ('"', "s") else "-delimiter" if symbol in "{}[]:," else "-text"
        yield Step(QUOTE if kind == "-quote" else DELIMITER if kind == "-delimiter" else TEXT, state, 1, kind)
    inserted = {OUTSIDE: KEY_OR_END, COLON: VALUE, NEXT: DONE}
    if place in inserted:
        yield Step(DELIMITER, (inserted[place],), 0, "+delimiter")
    if place == NEXT:
        yield Step(DELIMITER, (KEY,), 0, "+delimiter")
    if place == KEY:
        yield Step(DELIMITER, (NEXT,), 0, "-delimiter")
    if place == KEY_OR_END:
        yield Step(DELIMITER, (DONE,), 0, "+delimiter")
    if place in (KEY, VALUE):
        yield Step(Cost(quotes=2), (COLON if place == KEY else NEXT,), 0, "+quote")


@lru_cache
def json_grammar() -> Grammar:
    return Grammar((OUTSIDE,), json_steps, '{}[]:,"snw', lambda s: s[0] == DONE)


def json_parse(structure: str) -> tuple[Cost, str]:
    return json_grammar().cheapest(structure)


USUAL = 256
"""Symbols up to which a structure's parse is remembered; longer ones are parsed each time."""


@lru_cache(maxsize=1 << 14)
def _remembered(parse, *args):
    return parse(*args)


def solved(parse, structure: str, *args) -> tuple[Cost, str]:
    """parse(structure, *args), remembered for the structures of usual length."""
    return _remembered(parse, structure, *args) if len(structure) <= USUAL else parse(structure, *args)


def _csv_record(text: str, width: int) -> tuple:
    cost, edits = solved(csv_parse, csv_structure(text), width)
    return *cost, edits, None if any(cost) else csv_fields(text)


def _json_record(text: str) -> tuple:
    symbols, tokens = json_structure(text)
    cost, edits = solved(json_parse, symbols)
    fields = None
    if not any(cost):  # { key : value , key : value }
        scalars = [t for t, s in zip(tokens, symbols) if s in "sn"]
        fields = [json.loads(t) if i % 2 == 0 else t for i, t in enumerate(scalars)]
    return *cost, edits, fields


# --- operators -----------------------------------------------------------------------------------


def parse_records(kind: Column, raw: Column, widths: dict[str, int], objects: tuple[str, ...]) -> Column:
    """Struct (quotes, texts, delimiters, edits, fields) of each record, its columns' counts being those of the edits.

    A record whose kind is in widths is a CSV line of that many fields, one whose kind is in objects
    a JSON object; others, and null records, have a null struct. fields are given where there are no
    edits: the values of a line; key, value, key, value, ... as written of an object.
    """

    @F.pandas_udf(PARSED)
    def parse(kinds: pd.Series, texts: pd.Series) -> pd.DataFrame:
        rows = []
        for k, text in zip(kinds, texts):
            if text is not None and k in widths:
                rows.append(_csv_record(text, widths[k]))
            elif text is not None and k in objects:
                rows.append(_json_record(text))
            else:
                rows.append((None,) * 5)
        return pd.DataFrame(rows, columns=PARSED.names).astype({n: "Int64" for n in PARSED.names[:3]})

    return parse.asNondeterministic()(kind, raw)  # so that a filter on its result doesn't run it again


GAZE_FIELDS = ("x", "y", "timestamp", "gaze_point_validity", "left_z", "remark")
META_FIELDS = ("radiologist", "fname", "global_ind", "num_part", "num_img", "x0", "y0", "win_width", "win_height")
# The spellings of the validity flag.
VALIDITY = ("1", "1.0", "true", "0", "0.0", "false")
DECIMAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?$"
JSON_NUMBER = r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$"


def _plain(column: Column) -> Column:
    return F.lower(F.trim(column))


def _decimal(column: Column) -> Column:
    text = _plain(column)
    return F.when(text.rlike(DECIMAL), text.cast("double"))


def _finite(column: Column) -> Column:
    number = _decimal(column)
    return number.isNotNull() & (F.abs(number) < F.lit(float("inf")))


def _sound(ok: Column) -> Column:
    return F.coalesce(ok, F.lit(False))


def parse_raw_records(df: DataFrame, kind: str = "kind", raw: str = "raw") -> DataFrame:
    """df with columns reason, edits, gaze and meta, of records of both kinds in one pass.

    gaze: the typed fields of a sound gaze.csv line (kind 'gaze'); meta: those of a sound meta.json
    object (kind 'meta'). reason is null for a sound record, else the first of: malformed (a line's
    quotes or an object's structure were edited, or the record is null), column_count (a line's
    delimiters were edited, or an object's keys are not the nine), invalid_value. Both typed columns
    are null where reason isn't. An empty x, y or left_z of a line is a null value, not a failure.
    Records of any other kind are unknown_kind. Repeated rows are each judged. An empty table gives
    no rows; other columns are kept, but for ones of the names added.
    """
    lines, objects = F.col(kind) == "gaze", F.col(kind) == "meta"
    df = df.withColumn("_parsed", parse_records(F.col(kind), F.col(raw), {"gaze": len(GAZE_FIELDS)}, ("meta",)))
    edited = lambda n: F.col(f"_parsed.{n}") > 0
    gaze_sound, gaze = _gaze_line()
    meta_complete, meta_sound, meta = _meta_object()
    broken = F.col(raw).isNull() | edited("quotes") | edited("texts") | (objects & edited("delimiters"))
    reason = (
        F.when(~_sound(lines | objects), "unknown_kind")
        .when(broken, "malformed")
        .when(edited("delimiters") | (objects & ~_sound(meta_complete)), "column_count")
        .when((lines & ~gaze_sound) | (objects & ~meta_sound), "invalid_value")
    )
    judged = df.withColumn("reason", reason).withColumn("edits", F.col("_parsed.edits"))
    typed = {n: F.when(F.col("reason").isNull() & k, value) for n, k, value in (("gaze", lines, gaze), ("meta", objects, meta))}
    return judged.withColumns(typed).drop("_parsed")


def parse_gaze_lines(df: DataFrame, raw: str = "raw") -> DataFrame:
    """df with columns reason, edits and typed, all its records being lines of a gaze.csv: see parse_raw_records."""
    return parse_raw_records(df.withColumn("_kind", F.lit("gaze")), "_kind", raw).withColumnRenamed("gaze", "typed").drop("_kind", "meta")


def parse_meta_objects(df: DataFrame, raw: str = "raw") -> DataFrame:
    """df with columns reason, edits and typed, all its records being meta.json objects: see parse_raw_records."""
    return parse_raw_records(df.withColumn("_kind", F.lit("meta")), "_kind", raw).withColumnRenamed("meta", "typed").drop("_kind", "gaze")


def _gaze_line() -> tuple[Column, Column]:
    """Whether a line's values are valid, and the typed row."""
    f = {name: F.col("_parsed.fields")[i] for i, name in enumerate(GAZE_FIELDS)}
    valid = [_sound((_plain(f[n]) == "") | _finite(f[n])) for n in ("x", "y", "left_z")]
    valid += [_sound(_finite(f["timestamp"]) & (_decimal(f["timestamp"]) >= 0)), _sound(_plain(f["gaze_point_validity"]).isin(*VALIDITY))]
    typed = F.struct(
        *[_decimal(f[n]).alias(n) for n in ("x", "y", "timestamp")],
        _plain(f["gaze_point_validity"]).isin("1", "1.0", "true").alias("gaze_point_validity"),
        _decimal(f["left_z"]).alias("left_z"),
        f["remark"].alias("remark"),
    )
    return reduce(Column.__and__, valid), typed


def _meta_object() -> tuple[Column, Column, Column]:
    """Whether an object has the nine keys, whether its values are valid, and the typed row."""
    fields = F.col("_parsed.fields")
    keys = F.filter(fields, lambda _, i: i % 2 == 0)
    values = F.filter(fields, lambda _, i: i % 2 == 1)
    f = {n: F.try_element_at(values, F.array_position(keys, n).cast("int")) for n in META_FIELDS}
    text = {n: F.when(f[n].startswith('"'), F.from_json(F.concat(F.lit('{"v":'), f[n], F.lit("}")), "v string")["v"]) for n in ("radiologist", "fname")}
    numbers = [n for n in META_FIELDS if n not in text]
    valid = [_sound(_plain(text["radiologist"]).rlike("^[a-d][0-9]{4,}$")), _sound(_plain(text["fname"]).rlike(r"(?s)\.png$"))]
    valid += [_sound(f[n].rlike(JSON_NUMBER)) for n in numbers]
    complete = F.array_sort(keys) == F.array(*[F.lit(n) for n in sorted(META_FIELDS)])
    integers = ("global_ind", "num_part", "num_img")
    typed = F.struct(
        *[_plain(text[n]).alias(n) for n in text],
        *[f[n].try_cast("double").cast("bigint" if n in integers else "double").alias(n) for n in numbers],
    )
    return complete, reduce(Column.__and__, valid), typed
