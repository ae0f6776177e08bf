"""Label normalisation as SQL expressions."""

from rolefit import refdata as R


def _map(pairs: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in pairs.items()) + "}"


def _contained(expr: str, names) -> str:
    tests = " ".join(f"WHEN contains({expr}, '{n.replace('_', '')}') THEN '{n}'" for n in names)
    return f"CASE {tests} END"


def seniority_sql(raw: str) -> str:
    s = f"lower(trim({raw}))"
    levels = _map({**{x: x for x in R.SENIORITY_LEVELS}, **R.SENIORITY_ALIASES})
    return f"""coalesce({levels}[{s}],
  list_filter(list_transform(regexp_split_to_array({s}, '[|/\\-,&\\s]+'), lambda w: {levels}[w]), lambda x: x IS NOT NULL)[1],
  {_contained(s, R.SENIORITY_SUBSTRING_ORDER)})"""


def status_sql(raw: str) -> str:
    s = f"lower(trim({raw}))"
    known = _map({**{x: x for x in R.SKILL_STATUSES}, **R.SKILL_STATUS_ALIASES})
    squeezed = f"regexp_replace({s}, '[_ ]', '', 'g')"
    return f"coalesce({known}[{s}], {_contained(squeezed, R.SKILL_STATUSES)}, 'missing')"
