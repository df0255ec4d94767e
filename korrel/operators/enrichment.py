"""What a raw query asks for: tokens, time, type, action, period."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korrel.functions import text as T
from korrel.functions import values as V


def enriched(queries: DataFrame, query: str = "query", year: int | None = None) -> DataFrame:
    """``queries`` with clean tokens, their stable order, and hints of time, type, action, target and
    quarter. ``year`` is the present one; years are hints only if it is stated."""
    raw = F.col(query)
    times = [(name, list(triggers)) for name, triggers in V.TIME_HINTS]
    if year is not None:
        for name, triggers in times:
            triggers += [str(year)] if name == "this-year" else [str(year - k) for k in (1, 2, 3)] if name == "older" else []
    core = T.without_stop_words(T.tokenize(raw))
    return queries.withColumns(
        {
            "core_tokens": core,
            "stable_order": T.ordered(core),
            "time_hint": T.first_hint(raw, times),
            "type_hint": T.first_hint(raw, [(name, triggers.split()) for name, triggers in V.TYPE_HINTS]),
            "action": T.first_hint(raw, [(a, [a]) for a in V.ACTIONS]),
            "target": T.first_hint(raw, [(to, [word]) for word, to in V.SHARE_TARGETS]),
            "quarters": F.array_distinct(F.transform(F.regexp_extract_all(F.lower(raw), F.lit(r"\b(?:q|quarter )([1-4])\b"), 1), lambda q: F.concat(F.lit("Q"), q))),
            "scripts": T.scripts_of(raw),
        }
    )
