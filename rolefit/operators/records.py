"""Record assembly and cleaning (section B)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolefit import refdata as R
from rolefit.functions.text import empty_if_null, falsy_to_null, strip, zero_to_null

TEXT = T.StringType()


def _fields(*names: str) -> list[T.StructField]:
    return [T.StructField(n, TEXT) for n in names]


_LIST = T.ArrayType(TEXT)
ENTRY_SCHEMAS = {
    "experience": T.StructType(_fields("title", "company", "location", "start_date", "end_date")
                               + [T.StructField("bullets", _LIST), T.StructField("technologies", _LIST)]),
    "education": T.StructType(_fields("degree", "institution", "location", "year", "gpa")),
    "projects": T.StructType(_fields("name", "description", "link")
                             + [T.StructField("bullets", _LIST), T.StructField("technologies", _LIST)]),
    "certifications": T.StructType(_fields("name", "issuer", "year")),
}
REQUIRED_FIELDS = {
    "experience": ("title", "company"), "education": ("degree", "institution"),
    "projects": ("name", "description"), "certifications": ("name",),
}

# --- B1 ---------------------------------------------------------------------------------------------------------------
WITH_FALLBACK = ("full_name", "headline", "email", "phone", "linkedin", "github")
WITHOUT_FALLBACK = ("location", "portfolio", "summary", "primary_domain")
LISTS = ("skills", "tech_stack", "languages", "experience", "education", "projects", "certifications")


def profile_assemble(base: DataFrame, *parts: DataFrame) -> DataFrame:
    """Merge extraction parts over the deterministic record.

    A column that several parts have comes from the last part that has a value for it. Contact columns and years
    fall back to the base record when the merged value is blank (or zero); the others do not.
    """
    joined = base.select("resume_id", *[F.col(c).alias(f"base_{c}") for c in base.columns if c != "resume_id"])
    owners: dict[str, list[str]] = {}
    for i, part in enumerate(parts):
        names = [c for c in part.columns if c != "resume_id"]
        joined = joined.join(part.select("resume_id", *[F.col(c).alias(f"p{i}_{c}") for c in names]), "resume_id", "left")
        for c in names:
            owners.setdefault(c, []).insert(0, f"p{i}_{c}")

    def merged(c: str) -> Column | None:
        return F.coalesce(*owners[c]) if c in owners else None

    def base_value(c: str) -> list[Column]:
        return [F.col(f"base_{c}")] if c in base.columns else []

    out = [F.col("resume_id")]
    for c in WITH_FALLBACK:
        parts_value = [falsy_to_null(merged(c))] if c in owners else []
        if parts_value or base_value(c):
            out.append(F.coalesce(*parts_value, *base_value(c)).alias(c))
    out += [merged(c).alias(c) for c in WITHOUT_FALLBACK if c in owners]
    if "total_years" in owners or "total_years" in base.columns:
        stated = [zero_to_null(parse_number(merged("total_years").cast("string")))] if "total_years" in owners else []
        out.append(F.coalesce(*stated, *base_value("total_years")).alias("total_years"))
    for c in LISTS:
        if c in owners:
            out.append(F.coalesce(merged(c), F.array()).alias(c))
    return joined.select(*out)


# --- B2 ---------------------------------------------------------------------------------------------------------------
def entry_quarantine(raw: DataFrame, kind: str = "experience") -> tuple[DataFrame, DataFrame]:
    """Parse entry JSON and split it into (entries, bad); bad rows keep the raw text and a reason."""
    schema = T.StructType(ENTRY_SCHEMAS[kind].fields + [T.StructField("_corrupt", TEXT)])
    parsed = raw.withColumn("e", F.from_json("raw_json", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    reason = F.when(F.col("e").isNull() | F.col("e._corrupt").isNotNull(), "not_json")
    for name in REQUIRED_FIELDS[kind]:
        reason = reason.when(F.col(f"e.{name}").isNull(), f"missing_{name}")
    marked = parsed.withColumn("reason", reason)
    keys = [c for c in raw.columns if c != "raw_json"]
    entries = marked.filter("reason IS NULL").select(*keys, *[f"e.{f.name}" for f in ENTRY_SCHEMAS[kind].fields])
    return entries, marked.filter("reason IS NOT NULL").select(*keys, "raw_json", "reason")


# --- B3 ---------------------------------------------------------------------------------------------------------------
def _lookup(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def parse_seniority(raw: Column) -> Column:
    """Level of a free-text label: whole label, then its words in order, then a contained level name, else null."""
    label = F.lower(strip(raw))
    known = _lookup({**{level: level for level in R.SENIORITY_LEVELS}, **R.SENIORITY_ALIASES})
    by_word = F.filter(F.transform(F.split(label, R.SENIORITY_SPLIT_RE), lambda w: F.try_element_at(known, w)),
                       lambda level: level.isNotNull())
    contained = [F.when(F.contains(label, F.lit(level)), level) for level in R.SENIORITY_SUBSTRING_ORDER]
    return F.coalesce(F.try_element_at(known, label), F.get(by_word, F.lit(0)), *contained)


def parse_skill_status(raw: Column) -> Column:
    """Status of a free-text label; missing when nothing fits."""
    label = F.lower(strip(raw))
    known = _lookup({**{s: s for s in R.SKILL_STATUSES}, **R.SKILL_STATUS_ALIASES})
    squeezed = F.regexp_replace(label, "[_ ]", "")
    contained = [F.when(F.contains(squeezed, F.lit(s.replace("_", ""))), s) for s in R.SKILL_STATUSES]
    return F.coalesce(F.try_element_at(known, label), *contained, F.lit("missing"))


def parse_number(raw: Column) -> Column:
    """First number in a text, or null."""
    return F.nullif(F.regexp_extract(raw, r"\d+(?:\.\d+)?", 0), F.lit("")).try_cast("double")


def parse_bool(raw: Column, default: bool = True) -> Column:
    label = F.lower(strip(raw))
    return (F.when(label.isin(*R.TRUE_WORDS), True).when(label.isin(*R.FALSE_WORDS), False).otherwise(F.lit(default)))


LABEL_PARSERS = {"seniority": parse_seniority, "status": parse_skill_status, "number": parse_number, "boolean": parse_bool}


def label_normalise(df: DataFrame, column: str, kind: str, out: str | None = None) -> DataFrame:
    """Add the normalised form of a free-text label column."""
    return df.withColumn(out or f"{column}_norm", LABEL_PARSERS[kind](F.col(column)))


def unmatched_labels(df: DataFrame, column: str) -> DataFrame:
    """Non-blank seniority labels that fit no level, with their counts."""
    return (df.filter((F.col(column) != "") & parse_seniority(F.col(column)).isNull())
            .groupBy(F.col(column).alias("label")).agg(F.count(F.lit(1)).alias("n")))


# --- B4 ---------------------------------------------------------------------------------------------------------------
def profile_unnest(resumes: DataFrame) -> dict[str, DataFrame]:
    """Long entity tables of nested resumes, positions from 1."""
    out = {}
    for section in ("experience", "education", "projects", "certifications"):
        if section in resumes.columns:
            rows = resumes.select("resume_id", F.posexplode(section).alias("pos", "entry"))
            fields = [f"entry.{n}" for n in resumes.schema[section].dataType.elementType.names if n != "pos"]
            out[section] = rows.select("resume_id", (F.col("pos") + 1).alias("pos"), *fields)
    for section in ("skills", "tech_stack", "languages"):
        if section in resumes.columns:
            rows = resumes.select("resume_id", F.posexplode(section).alias("pos", "value"))
            out[section] = rows.select("resume_id", (F.col("pos") + 1).alias("pos"), "value")
    return out


def placeholder_rows(resumes: DataFrame, compat: bool = True, caps: dict[str, int] | None = None) -> DataFrame:
    """(resume_id, placeholder, value) for mail merge. All rows of a resume come from its own row, without a shuffle.

    caps limits the entries of a section by name; by default all have their rows. refdata.PLACEHOLDER_CAPS has those of the original
    templates. With compat=True an absent date, issuer or year inside a composed text prints as 'None'; otherwise as nothing.
    """
    absent = F.lit("None" if compat else "")
    have = set(resumes.columns)

    def text(c: Column) -> Column:
        return F.coalesce(c, absent)

    def row(name: Column | str, value: Column) -> Column:
        return F.struct((F.lit(name) if isinstance(name, str) else name).alias("placeholder"),
                        F.coalesce(value, F.lit("")).alias("value"))

    def numbered(prefix: str, i: Column, suffix: str = "") -> Column:
        return F.concat(F.lit(prefix), (i + 1).cast("string"), F.lit(suffix))

    def capped(array: Column, section: str) -> Column:
        return F.slice(array, 1, caps[section]) if caps and section in caps else array

    plain = {"FULL_NAME": "full_name", "NAME": "full_name", "EMAIL": "email", "PHONE": "phone", "LOCATION": "location",
             "LINKEDIN": "linkedin", "GITHUB": "github", "PORTFOLIO": "portfolio", "SUMMARY": "summary"}
    blocks = [F.array(*[row(k, F.col(c)) for k, c in plain.items() if c in have])]
    if "skills" in have:
        first = capped(empty_if_null(F.col("skills")), "skills")
        blocks.append(F.array(row("SKILLS_LIST", F.array_join(first, " · ")), row("SKILLS_COMMA", F.array_join(first, ", "))))
    if "experience" in have:
        def job(e: Column, i: Column) -> Column:
            dates = F.concat(text(e["start_date"]), F.lit(" – "), text(e["end_date"]))
            rows = F.array(*[row(numbered("EXP_", i, s), v) for s, v in (
                ("_TITLE", e["title"]), ("_COMPANY", e["company"]), ("_LOCATION", e["location"]), ("_DATES", dates),
                ("_START", e["start_date"]), ("_END", e["end_date"]))])
            bullets = F.transform(capped(empty_if_null(e["bullets"]), "bullets"),
                                  lambda b, j: row(F.concat(numbered("EXP_", i, "_BULLET_"), (j + 1).cast("string")), b))
            return F.concat(rows, bullets)
        blocks.append(F.flatten(F.transform(capped(F.col("experience"), "experience"), job)))
    if "education" in have:
        blocks.append(F.flatten(F.transform(capped(F.col("education"), "education"), lambda e, i: F.array(
            *[row(numbered("EDU_", i, s), e[f]) for s, f in (("_DEGREE", "degree"), ("_INSTITUTION", "institution"),
                                                             ("_LOCATION", "location"), ("_YEAR", "year"))]))))
    if "projects" in have:
        blocks.append(F.flatten(F.transform(capped(F.col("projects"), "projects"), lambda e, i: F.array(
            row(numbered("PROJ_", i, "_NAME"), e["name"]), row(numbered("PROJ_", i, "_DESC"), e["description"]),
            row(numbered("PROJ_", i, "_TECH"), F.array_join(empty_if_null(e["technologies"]), ", "))))))
    if "certifications" in have:
        def cert(e: Column, i: Column) -> Column:
            full = F.concat(text(e["name"]), F.lit(" — "), text(e["issuer"]), F.lit(" "), text(e["year"]))
            return row(numbered("CERT_", i), F.regexp_replace(full, "^[ —]+|[ —]+$", ""))
        blocks.append(F.transform(capped(F.col("certifications"), "certs"), cert))
    blocks = [F.coalesce(b, F.array().cast("array<struct<placeholder:string,value:string>>")) for b in blocks]
    return (resumes.select("resume_id", F.explode(F.concat(*blocks)).alias("p"))
            .select("resume_id", "p.placeholder", "p.value"))


# --- B5 ---------------------------------------------------------------------------------------------------------------
def skill_union(resumes: DataFrame, cap: int | None = None) -> DataFrame:
    """(resume_id, pos, skill): skills then tech stack, distinct in order; with a cap at most that many."""
    union = F.array_distinct(F.concat(empty_if_null(F.col("skills")), empty_if_null(F.col("tech_stack"))))
    if cap is not None:
        union = F.slice(union, 1, cap)
    return resumes.select("resume_id", F.posexplode(union).alias("pos", "skill"))


def skill_frequency(resumes: DataFrame) -> DataFrame:
    """Resumes per skill."""
    return skill_union(resumes).groupBy("skill").agg(F.count(F.lit(1)).alias("n_resumes"))


# --- B6 ---------------------------------------------------------------------------------------------------------------
RESTORED_CONTACTS = ("full_name", "email", "phone", "location", "linkedin", "github", "portfolio", "headline")


def contact_restore(rewritten: DataFrame, original: DataFrame) -> DataFrame:
    """Fill blank contact fields and empty certification and language lists from the original record."""
    fields = [c for c in RESTORED_CONTACTS if c in rewritten.columns and c in original.columns]
    lists = [c for c in ("certifications", "languages") if c in rewritten.columns and c in original.columns]
    kept = [c for c in rewritten.columns if c not in (*fields, *lists, "resume_id")]
    source = original.select("resume_id", *[F.col(c).alias(f"orig_{c}") for c in (*fields, *lists)])

    def filled(c: str) -> Column:
        return F.coalesce(falsy_to_null(F.col(c)), falsy_to_null(F.col(f"orig_{c}")), F.col(c)).alias(c)

    def filled_list(c: str) -> Column:
        return F.when(F.coalesce(F.size(c), F.lit(0)) <= 0, F.coalesce(f"orig_{c}", c)).otherwise(F.col(c)).alias(c)

    return rewritten.join(source, "resume_id", "left").select(
        "resume_id", *[filled(c) for c in fields], *[filled_list(c) for c in lists], *kept)
