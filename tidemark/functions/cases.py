"""Per-stream constants as expressions.

Profiles are a handful of literals, so they are compiled into CASE expressions:
no join, no broadcast, and one pass over the data whatever the number of streams.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.profiles import TITLES, Profile


def per_stream(
    profiles: Mapping[str, Profile], value: Callable[[Profile], object], only_these: bool = False
) -> Column:
    """``value(profile)`` of the row's stream. If all streams agree it is one literal,
    unless ``only_these`` asks for null on other streams."""
    groups: dict[object, list[str]] = {}
    for name, p in profiles.items():
        groups.setdefault((type(v := value(p)), v), []).append(name)
    if len(groups) == 1 and not only_these:
        return F.lit(next(iter(groups))[1])
    out = None
    for (_, v), names in groups.items():
        if v is not None:
            cond = F.col("stream").isin(*names)
            out = F.when(cond, F.lit(v)) if out is None else out.when(cond, F.lit(v))
    return F.lit(None) if out is None else out


def title_for(stream: Column, rule: Column) -> Column:
    """The phrase of a rule on a stream, falling back to the rule's name."""
    phrases = [
        F.lit(text) for name, titles in TITLES.items() for r, t in titles.items() for text in (f"{name}/{r}", t)
    ]
    return F.coalesce(F.try_element_at(F.create_map(*phrases), F.concat(stream, F.lit("/"), rule)), rule)
