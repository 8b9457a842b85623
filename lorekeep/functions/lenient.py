"""JSON as models write it: in fences, among prose, with trailing commas."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_MARKS = re.compile(r'"(?:\\[\s\S]|[^"\\])*(?:"|\\?\Z)|[{}]')
_FENCE = re.compile(r"```(?:json)?\s*([\s\S]*?)```", re.IGNORECASE)


def without_trailing_commas(text: str) -> str:
    """Commas before a closing bracket go, but not within strings."""
    return re.sub(r'("(?:\\[\s\S]|[^"\\])*(?:"|\\?\Z))|,(?=\s*[}\]])', lambda m: m.group(1) or "", text)


def balanced_objects(text: str) -> list[str]:
    """Objects whose braces balance, strings and escapes heeded; none within another.

    One walk from a brace tells where every brace that it passes outside of strings closes, for a walk from there would go the same way; only braces
    that lay in what it took for a string are walked from anew.
    """
    out: list[str] = []
    ends: dict[int, int | None] = {}
    at = text.find("{")
    while at >= 0:
        if at not in ends:
            opened: list[int] = []
            for m in _MARKS.finditer(text, at):
                if m.group() == "{":
                    if m.start() in ends:
                        break  # a walk from there is known
                    opened.append(m.start())
                elif m.group() == "}":
                    if not opened:
                        break
                    ends[opened.pop()] = m.end()
                    if not opened:
                        break
            for o in opened:
                ends.setdefault(o, None)
        end = ends[at]
        if end is not None:
            out.append(text[at:end])
        at = text.find("{", end if end is not None else at + 1)
    return out


def _refuse(name: str) -> None:
    raise ValueError(name)


def _reads(text: str) -> bool:
    try:
        json.loads(text, parse_constant=_refuse)
    except (ValueError, RecursionError):
        return False
    return True


def first_json(text: str | None) -> str | None:
    """The first candidate that reads as JSON, as it is or without trailing commas: the text without its fence, what stands in fences, balanced objects."""
    body = (text or "").strip()
    told = [re.sub(r"\s*```$", "", re.sub(r"^```(?:json)?\s*", "", body, flags=re.IGNORECASE)), *(m.strip() for m in _FENCE.findall(body))]
    seen = set()
    for part in (told, None):
        for candidate in part if part is not None else balanced_objects(body):
            if not candidate or candidate in seen:
                continue
            seen.add(candidate)
            for form in (candidate, without_trailing_commas(candidate)):
                if _reads(form):
                    return form
    return None


def lenient_value(c: Column | str) -> Column:
    """JSON text of the first value that a text holds (see :func:`first_json`); null if it holds none. Texts are taken whole."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(first_json).astype(object).where(lambda s: s.notna(), None)

    return run(F.col(c) if isinstance(c, str) else c)
