"""Several values packed in one field: dialects chosen by minimum description length.

A *dialect* is a layout of a packed string: a JSON list of objects, a bracketed list, or a set of
separators with or without quotes and escapes. Every distinct string is parsed under all dialects
that fit it. The description length of a parse is

    bits of the dialect + sum over its values of the bits of the value,

where a value costs the less of ``-log2(its share among all values of the field, the string's own
part left out)`` and a character code. The shares are counted over all rows of the table.
A string takes its cheapest parse; ties go to the parse with more values, then to the dialect
that sorts first.

Defined results: null, empty and blank strings, ``[]`` and strings made of separators only have no
values. Repeated values keep their own positions. A broken JSON string is parsed as plain text.
"""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korrel.session import cut, lookup

#: Characters that separate values in any field, and those of single fields. Fixed values.
SEPARATORS = ",;|\t\n"
OWN_SEPARATORS = {"categories": "/", "owner_names": "&"}
#: Fields whose values are separated by blanks if nothing else separates or quotes them.
BLANK_FIELDS = ("entities",)
#: Bits of an ordinary character, and of a bare separator or quote inside a value, in the character
#: code. Values with bare ones are always spelled in it.
CHAR_BITS, BARE_BITS, BARE_QUOTE_BITS = 5.0, 16.0, 96.0

PARSES = "array<struct<dialect:string,items:array<string>,bits:double,plain:array<double>,clean:array<boolean>>>"


def split_quoted(text: str, separators: str, quotes: bool) -> list[tuple[str, bool]]:
    """Values of ``text`` with a mark for quoted ones. A quote opens only at the start of a value,
    a doubled quote or a backslash protects a character."""
    return [(v, q) for v, q, _, _ in split_places(text, separators, quotes)]


def split_places(text: str, separators: str, quotes: bool) -> list[tuple[str, bool, int, int]]:
    """The values of ``split_quoted``, each with its start and end in ``text``: within its quotes, and
    with the backslashes of its characters."""
    out: list[tuple[str, bool, int, int]] = []
    value: list[str] = []
    at: list[tuple[int, int]] = []  # where each character of the value is
    quote, was_quoted, i, n = "", False, 0, len(text)

    def end() -> None:
        whole = "".join(value)
        if own := whole.strip():
            first = len(whole) - len(whole.lstrip())
            out.append((own, was_quoted, at[first][0], at[first + len(own) - 1][1]))

    while i < n:
        c = text[i]
        if c == "\\" and i + 1 < n and (text[i + 1] in separators or text[i + 1] in "\\\"'&/ " or text[i + 1] in SEPARATORS):
            value.append(text[i + 1])
            at.append((i, i + 2))
            i += 2
            continue
        if quote:
            if c == quote:
                if i + 1 < n and text[i + 1] == quote:
                    value.append(quote)
                    at.append((i, i + 2))
                    i += 2
                    continue
                quote = ""
            else:
                value.append(c)
                at.append((i, i + 1))
        elif quotes and c in "\"'" and not "".join(value).strip() and not was_quoted and closes(text, i, separators):
            value, at, quote, was_quoted = [], [], c, True
        elif c in separators:
            end()
            value, at, was_quoted = [], [], False
        elif not (was_quoted and c.isspace()):
            value.append(c)
            at.append((i, i + 1))
        i += 1
    end()
    return out


def closes(text: str, at: int, separators: str) -> bool:
    """Whether the quote at ``at`` has an end mark that is followed by a separator or the end."""
    return re.match(r"(?:\\.|(?!%s)[^\\])*(?:%s%s(?:\\.|(?!%s)[^\\])*)*%s\s*(?:[%s]|$)" % ((text[at],) * 5 + (re.escape(separators) or "\n",)), text[at + 1 :], re.S) is not None


def listed(text: str) -> list[str] | None:
    """Values of a bracketed list or of a JSON list of objects with tokens; None if it is neither."""
    body = text.strip()
    if not (body.startswith("[") and body.endswith("]")):
        return None
    try:
        found = json.loads(body)
        if isinstance(found, list) and all(isinstance(x, (str, dict, int, float)) for x in found):
            values = [" ".join(str(t) for t in x.get("tokens") or [] if str(t).strip()) if isinstance(x, dict) else str(x) for x in found]
            return [v.strip() for v in values if v.strip()]
    except ValueError:
        pass
    return [v for v, _ in split_quoted(body[1:-1], ",", True)]


def plain_bits(value: str, quoted: bool, separators: str) -> float:
    """Bits of a value in the character code, with its end. Separators are cheap only in quotes."""
    bare = 0 if quoted else sum(c in separators for c in value)
    marks = 0 if quoted else value.count('"')
    return (len(value) - bare - marks + 1) * CHAR_BITS + bare * BARE_BITS + marks * BARE_QUOTE_BITS


def splits(field: str, text: str) -> Iterator[tuple[bool, tuple[str, ...], list[tuple[str, bool, int, int]]]]:
    """(quotes, separators, values with their places) of all different ways to split ``text``."""
    there = [c for c in SEPARATORS + OWN_SEPARATORS.get(field, "") if c in text]
    seen = set()
    for quotes in (True, False) if '"' in text or "'" in text else (True,):
        for r in range(len(there) + 1):
            for chosen in itertools.combinations(there, r):
                got = split_places(text, "".join(chosen), quotes)
                values = tuple(x[0] for x in got)
                if values and values not in seen:
                    seen.add(values)
                    yield quotes, chosen, got


def parses(field: str, text: str) -> list[dict]:
    """All different parses of ``text`` under the dialects that fit it."""
    if text is None or not text.strip():
        return []
    if (values := listed(text)) is not None:
        return [{"dialect": "list", "items": values, "bits": 1.0, "plain": [0.0] * len(values), "clean": [True] * len(values)}] if values else []
    known = SEPARATORS + OWN_SEPARATORS.get(field, "")
    if field in BLANK_FIELDS and '"' not in text and not any(c in text for c in known):
        values = text.split()
        return [{"dialect": "blank", "items": values, "bits": 1.0, "plain": [0.0] * len(values), "clean": [True] * len(values)}]
    out = []
    for quotes, chosen, got in splits(field, text):
        # which separators are used: one of the subsets; quotes on or off
        bits = 1.0 + len(known) * 0.5 + len(chosen) + len(got)
        out.append({"dialect": f"{'q' if quotes else 'n'}{','.join(str(ord(c)) for c in chosen)}", "items": [x[0] for x in got], "bits": bits, "plain": [plain_bits(v, q, known) for v, q, _, _ in got], "clean": [q or not any(c in known or c == '"' for c in v) for v, q, _, _ in got]})
    return out


_DECODER = json.JSONDecoder()
_JSON_BLANKS = re.compile(r"[ \t\n\r]*")


def _after_blanks(text: str, i: int) -> int:
    return _JSON_BLANKS.match(text, i).end()


def _members(text: str, i: int) -> Iterator[tuple[str | None, object, int, int]]:
    """(key, value, start, end) of the members of the JSON list or object that opens at ``i``."""
    keyed, i = text[i] == "{", _after_blanks(text, i + 1)
    while text[i] not in "]}":
        key = None
        if keyed:
            key, i = _DECODER.raw_decode(text, i)
            i = _after_blanks(text, _after_blanks(text, i) + 1)
        x, end = _DECODER.raw_decode(text, i)
        yield key, x, i, end
        i = _after_blanks(text, end)
        if text[i] == ",":
            i = _after_blanks(text, i + 1)


def places(field: str, text: str, items: list[str]) -> tuple[list[tuple[int, int]], bool] | None:
    """(start and end in ``text`` of every one of ``items``, which a parse of it gave; whether they are
    JSON values, with their quotes). None if no parse gives them."""
    body = text.strip()
    if body.startswith("[") and body.endswith("]"):
        first = text.index("[")
        if listed(text) != items:
            return None
        try:
            json.loads(body)
            members = list(_members(text, first))
        except ValueError:
            members = None
        if members is not None and all(isinstance(x, (str, dict, int, float)) for _, x, _, _ in members):
            out = []
            for _, x, start, end in members:
                if isinstance(x, dict):
                    if not any(str(t).strip() for t in x.get("tokens") or []):
                        continue
                    _, tokens, start, end = [m for m in _members(text, start) if m[0] == "tokens"][-1]
                    if isinstance(tokens, list):
                        inner = [(a, b) for _, _, a, b in _members(text, start)]
                        start, end = inner[0][0], inner[-1][1]
                elif not str(x).strip():
                    continue
                out.append((start, end))
            return out, True
        return [(first + 1 + a, first + 1 + b) for _, _, a, b in split_places(body[1:-1], ",", True)], False
    for _, _, got in splits(field, text):
        if [x[0] for x in got] == items:
            return [(a, b) for _, _, a, b in got], False
    return None


def _parse_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"field": b["field"], "raw": b["raw"], "n": b["n"], "parses": [parses(f, t) for f, t in zip(b["field"], b["raw"])]})


def distinct_strings(files: DataFrame, fields: list[str]) -> DataFrame:
    """(field, raw, n): every distinct non-blank string of the fields, with its number of rows."""
    return stacked(files, fields).groupBy("field", "raw").agg(F.count("*").alias("n"))


def stacked(files: DataFrame, fields: list[str]) -> DataFrame:
    """(id, field, raw), one row for each non-blank field of a file."""
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").alias("raw")) for f in fields])).alias("c")
    return files.select("id", cells).select("id", "c.field", "c.raw").where("raw IS NOT NULL AND trim(raw) <> ''")


def chosen_parses(strings: DataFrame) -> DataFrame:
    """(field, raw, n, items): the cheapest parse of every distinct string of (field, raw, n)."""
    parsed = cut(strings.mapInPandas(_parse_batches, f"field string, raw string, n bigint, parses {PARSES}"))
    every = parsed.select("field", "raw", "n", F.size("parses").alias("k"), F.posexplode("parses").alias("p", "x")).select(
        "field", "raw", "n", "k", "p", "x.dialect", "x.bits", F.arrays_zip("x.items", "x.plain", "x.clean").alias("z")
    )
    cells = every.select("field", "raw", "n", "k", "p", "dialect", "bits", F.explode("z").alias("z")).select(
        "field", "raw", "n", "k", "p", "dialect", "bits", F.lower("z.items").alias("value"), F.col("z.plain").alias("plain"), F.col("z.clean").alias("clean")
    )
    weights = cells.groupBy("field", "value").agg(F.sum(F.when(F.col("clean"), F.col("n") / F.col("k")).otherwise(0.0)).alias("w"))
    weights = cut(weights)
    totals = weights.groupBy("field").agg(F.sum("w").alias("total"))
    # Only strings with more than one parse are scored. Values repeat much: hot ones are broadcast.
    open_cells = cells.where("k > 1")
    uses = open_cells.groupBy("field", "value").agg(F.count("*").alias("uses"))
    codes = weights.join(uses, ["field", "value"]).join(F.broadcast(totals), "field")
    scored = lookup(open_cells, codes, ["field", "value"], "uses")
    others = F.when(F.col("clean"), F.greatest(F.col("w") - F.col("n") / F.col("k"), F.lit(0.0))).otherwise(0.0)
    known = F.when(others > 1e-9, -F.log2(others / F.col("total"))).otherwise(F.col("plain"))
    # one bit says which of the two codes spells the value
    cost = F.col("bits") + F.sum(F.least(known, F.col("plain")) + 1.0)
    best = (
        scored.groupBy("field", "raw", "p", "bits", "dialect")
        .agg(cost.alias("cost"), F.count("*").alias("size"))
        .groupBy("field", "raw")
        .agg(F.min_by("p", F.struct(F.round("cost", 6), -F.col("size"), "dialect")).alias("p"))
    )
    decided = parsed.where("size(parses) > 1").join(best, ["field", "raw"]).select("field", "raw", "n", F.expr("parses[p].items").alias("items"))
    sure = parsed.where("size(parses) = 1").select("field", "raw", "n", F.expr("parses[0].items").alias("items"))
    return sure.unionByName(decided)


def packed_items(files: DataFrame, fields: list[str] = ("categories", "owner_names", "entities")) -> DataFrame:
    """(id, field, items): the values of each packed field of each file, in reading order."""
    fields = list(fields)
    return lookup(stacked(files, fields), chosen_parses(distinct_strings(files, fields)), ["field", "raw"], "n").select("id", "field", "items")


def unpack(files: DataFrame, fields: list[str] = ("categories", "owner_names", "entities"), least: int = 2) -> DataFrame:
    """(id, field, pos, item): one row per value of the fields that hold ``least`` values or more,
    ``pos`` from 1."""
    return packed_items(files, fields).where(F.size("items") >= least).select("id", "field", F.posexplode("items").alias("pos", "item")).select(
        "id", "field", (F.col("pos") + 1).cast("int").alias("pos"), "item"
    )
