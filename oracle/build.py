"""Puts the CTEs a query needs in front of it."""

from __future__ import annotations

import re

from oracle import ab_records, cd_scoring, e_flags, fg_skills, hi_text, jk_reports
from oracle.views import VIEWS

SECTIONS = (ab_records, cd_scoring, e_flags, fg_skills, hi_text, jk_reports)
ALL_VIEWS = {**VIEWS, **{n: t for s in SECTIONS for n, t in s.HELPERS.items()}}
QUERIES = {n: t for s in SECTIONS for n, t in s.QUERIES.items()}


def _needed(text: str, found: list[str]) -> list[str]:
    for name in re.findall(r"\b\w+_v\b", text):
        if name in ALL_VIEWS and name not in found:
            _needed(ALL_VIEWS[name], found)
            if name not in found:
                found.append(name)
    return found


def full_sql(query: str) -> str:
    names = _needed(query, [])
    if not names:
        return query.strip()
    ctes = ",\n".join(f"{n} AS (\n{ALL_VIEWS[n].strip()}\n)" for n in names)
    return f"WITH {ctes}\n{query.strip()}"


def all_sql() -> dict[str, str]:
    return {name: full_sql(text) for name, text in QUERIES.items()}
