"""Mismatch flags between candidates and postings (section E).

All checks of a pair read one joined row, so the flags of a pair are built as one array in that row: no union of
scans, no window and no shuffle beyond the two joins that bring candidate and posting to the pair.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolefit import refdata as R
from rolefit.functions.ratio import gestalt_ratio
from rolefit.functions.text import contains_any, empty_if_null, strip, words, zero_to_null
from rolefit.operators.records import parse_seniority

FLAG_FIELDS = ("flag_type", "category", "title", "message", "detail", "requires_acknowledgement")
_FLAG_TYPE = ("struct<prio:int,check_ord:int,item_ord:int,flag_type:string,category:string,title:string,message:string,"
              "detail:string,requires_acknowledgement:boolean>")


def _domain_columns(side: str) -> list[Column]:
    """The primary domain as text, in normal form, and the clusters and words of that form."""
    norm = normalise_domain(strip(F.coalesce("primary_domain", F.lit(""))))
    return [strip(F.col("primary_domain")).alias(f"{side}_area"), norm.alias(f"{side}_norm"), cluster_bits(norm).alias(f"{side}_clusters"),
            content_words(norm).alias(f"{side}_content")]


def candidate_side(candidates: DataFrame) -> DataFrame:
    """The candidate columns (r_) the checks read, one row per resume_id; what they need of a text is worked out here, once per candidate."""
    return candidates.select("resume_id", F.col("total_years").alias("r_years"), F.col("primary_domain").alias("r_domain"),
                             F.col("location").alias("r_location"), F.lower(F.concat_ws(" ", empty_if_null(F.col("certifications")))).alias("r_held"),
                             *_domain_columns("r"), F.lit(True).alias("r_known"))


def posting_side(postings: DataFrame) -> DataFrame:
    """The posting columns (j_) the checks read, one row per job_id; j_on_site and j_at_once are what the work mode and the notice period say."""
    return postings.select("job_id", F.col("min_years").alias("j_min"), F.col("max_years").alias("j_max"),
                           parse_seniority(F.col("seniority_raw")).alias("j_seniority"),
                           F.col("primary_domain").alias("j_domain"), F.col("location").alias("j_location"),
                           F.col("work_mode").alias("j_work_mode"),
                           contains_any(F.lower(F.coalesce("work_mode", F.lit(""))), ("wfo", "office")).alias("j_on_site"),
                           contains_any(F.lower("notice_period"), ("immediate", "0 days")).alias("j_at_once"),
                           F.col("certifications_required").alias("j_certs"),
                           F.transform("certifications_required", lambda c: F.lower(c)).alias("j_certs_low"), words(F.lower("location")).alias("j_places"),
                           *_domain_columns("j"), F.lit(True).alias("j_known"))


def pair_context(candidates: DataFrame, postings: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs with the columns of both sides."""
    return pairs.select("resume_id", "job_id").join(candidate_side(candidates), "resume_id").join(posting_side(postings), "job_id")


def _flag(check: int, kind: str, category: str, title, message, detail, ack: bool, item: Column | None = None) -> Column:
    def text(x) -> Column:
        return F.lit(x) if isinstance(x, str) else x

    return F.struct(
        F.lit(R.FLAG_PRIORITY[kind]).alias("prio"), F.lit(check).alias("check_ord"),
        (item if item is not None else F.lit(0)).alias("item_ord"), F.lit(kind).alias("flag_type"),
        F.lit(category).alias("category"), text(title).alias("title"), text(message).alias("message"),
        text(detail).alias("detail"), F.lit(ack).alias("requires_acknowledgement"))


def _number(c: Column) -> Column:
    return c.cast("string")


def experience_flag() -> Column:
    have, need = F.col("r_years"), F.col("j_min")
    gap = need - have
    over = F.when(need.isNotNull(), have - F.coalesce(zero_to_null(F.col("j_max")), need))
    return (
        F.when(gap > R.EXPERIENCE_GAP_RED, _flag(
            0, "red", "experience_gap", "Significant Experience Gap",
            F.concat(F.lit("JD requires "), _number(need), F.lit("+ years · Your resume reflects ~"), _number(have), F.lit(" years")),
            F.concat(F.lit("A gap of "), F.bround(gap, 0).cast("int").cast("string"),
                     F.lit("+ years may cause automatic ATS rejection at most companies.")), True))
        .when(gap > 0, _flag(
            0, "yellow", "experience_gap", "Experience Gap",
            F.concat(F.lit("JD requires "), _number(need), F.lit(" years · Your resume shows ~"), _number(have), F.lit(" years")),
            "You are slightly below the stated requirement. Optimization will still proceed.", True))
        .when(over > R.OVERQUALIFIED_YEARS, _flag(
            0, "yellow", "seniority_mismatch", "Potential Overqualification",
            F.concat(F.lit("Your experience ("), _number(have), F.lit(" yrs) significantly exceeds JD requirement ("),
                     _number(need), F.lit(" yrs)")),
            "You may appear overqualified. Consider whether to de-emphasize seniority.", False)))


def normalise_domain(c: Column) -> Column:
    """Letters only, lower case, abbreviations written out one after the other in list order."""
    letters = F.regexp_replace(strip(F.lower(c)), r"[^a-z\s]", " ")
    short = F.regexp_like(letters, F.lit(rf"\b(?:{'|'.join(short for short, _ in R.DOMAIN_ABBREVIATIONS)})\b"))
    written = reduce(lambda text, step: F.regexp_replace(text, rf"\b{step[0]}\b", step[1]), R.DOMAIN_ABBREVIATIONS, letters)
    return F.when(short, written).otherwise(letters)


def cluster_bits(norm: Column) -> Column:
    """The synonym clusters a normalised domain touches, a bit for each."""
    return reduce(Column.__add__, [F.when(contains_any(norm, terms), 1 << i).otherwise(0) for i, terms in enumerate(R.DOMAIN_CLUSTERS)])


def content_words(norm: Column) -> Column:
    return F.array_except(F.array_distinct(words(norm)), F.array(*[F.lit(w) for w in R.DOMAIN_STOP_WORDS]))


def domain_tier(raw_a: Column, raw_b: Column, a: Column, b: Column, clusters_a: Column, clusters_b: Column) -> Column:
    """What settles the similarity of two domains, of their texts, normal forms and clusters: unknown, equal, contained, cluster or fuzzy."""
    return (F.when((raw_a == "") | (raw_b == ""), "unknown").when(a == b, "equal").when(F.contains(a, b) | F.contains(b, a), "contained")
            .when(clusters_a.bitwiseAND(clusters_b) != 0, "cluster").otherwise("fuzzy"))


def tier_similarity(tier: Column, a: Column, b: Column, wa: Column, wb: Column) -> Column:
    """The similarity of two normal forms with these content words. Only what the cheap tiers leave open reaches the character ratio, which gets nulls for all
    others."""
    jaccard = F.when((F.size(wa) > 0) & (F.size(wb) > 0),
                     F.size(F.array_intersect(wa, wb)) / F.size(F.array_union(wa, wb))).otherwise(0.0)
    open_ = tier == "fuzzy"
    ratio = gestalt_ratio(F.when(open_, a), F.when(open_, b))
    return F.when(tier.isin("unknown", "equal"), 1.0).when(open_, F.greatest(jaccard, ratio)).otherwise(R.DOMAIN_NEAR)


def domain_similarity(domain_pairs: DataFrame) -> DataFrame:
    """(domain_a, domain_b, tier, similarity) of the distinct pairs of raw domain texts; only domain pairs that occur are compared, each once.

    domain_pairs: (domain_a, domain_b), and the normal forms norm_a and norm_b where they are known.
    """
    if "norm_a" not in domain_pairs.columns:
        domain_pairs = domain_pairs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("domain_a", "domain_b")]).select(
            "*", normalise_domain(F.col("domain_a")).alias("norm_a"), normalise_domain(F.col("domain_b")).alias("norm_b"))
    raw_a, raw_b, a, b = (F.col(c) for c in ("domain_a", "domain_b", "norm_a", "norm_b"))
    tiered = domain_pairs.distinct().withColumn("tier", domain_tier(raw_a, raw_b, a, b, cluster_bits(a), cluster_bits(b)))
    return tiered.select("domain_a", "domain_b", "tier", tier_similarity(F.col("tier"), a, b, content_words(a), content_words(b)).alias("similarity"))


def domain_pairs(context: DataFrame) -> DataFrame:
    """The domain pairs of the context with their normal forms: two columns that depend on the texts alone."""
    return context.select(F.coalesce("r_area", F.lit("")).alias("domain_a"), F.coalesce("j_area", F.lit("")).alias("domain_b"),
                          F.col("r_norm").alias("norm_a"), F.col("j_norm").alias("norm_b"))


def with_similarity(context: DataFrame, similarity: DataFrame | None = None) -> DataFrame:
    """Adds domain_a, domain_b, tier and similarity to each pair (similarity null when either domain is unknown). Without a table of similarities they are
    worked out inside the row; equal pairs of domains that lie in one batch of rows are compared once."""
    keyed = context.withColumns({"domain_a": F.col("r_area"), "domain_b": F.col("j_area")})
    if similarity is not None:
        scores = similarity.filter("tier <> 'unknown'").select("domain_a", "domain_b", "tier", "similarity")
        return keyed.join(scores, ["domain_a", "domain_b"], "left")
    known = (F.coalesce("domain_a", F.lit("")) != "") & (F.coalesce("domain_b", F.lit("")) != "")
    a, b = F.col("r_norm"), F.col("j_norm")
    tier = F.when(known, domain_tier(F.col("domain_a"), F.col("domain_b"), a, b, F.col("r_clusters"), F.col("j_clusters")))
    tiered = keyed.withColumn("tier", tier)
    similarity = tier_similarity(F.col("tier"), a, b, F.col("r_content"), F.col("j_content"))
    return tiered.withColumn("similarity", F.when(F.col("tier").isNotNull(), similarity))


def domain_flag() -> Column:
    score = F.col("similarity")
    message = F.concat(F.lit("Your primary domain is "), F.col("domain_a"), F.lit(" · JD targets "), F.col("domain_b"))
    return (
        F.when(score.isNull() | (score >= R.DOMAIN_COMPATIBLE), F.lit(None))
        .when(score >= R.DOMAIN_PARTIAL, _flag(
            1, "info", "domain_mismatch", "Partial Domain Match", message,
            "There is some overlap between the domains — optimization will still be effective.", False))
        .otherwise(_flag(
            1, "red", "domain_mismatch", "Domain Mismatch", message,
            "Significant domain mismatch detected. Resume optimization will be limited in effectiveness.", True)))


def seniority_flag() -> Column:
    years, level = zero_to_null(F.col("r_years")), F.col("j_seniority")
    message = F.concat(F.lit("JD targets "), level, F.lit(" level · You have "), _number(years), F.lit(" years of experience"))
    return (
        F.when(level.isin("intern", "junior") & (years > R.SENIORITY_YEARS), _flag(
            2, "yellow", "seniority_mismatch", "Seniority Mismatch — Overqualified", message,
            "Recruiters may screen you out as overqualified.", False))
        .when(level.isin("lead", "manager", "director") & (years < R.SENIORITY_YEARS), _flag(
            2, "red", "seniority_mismatch", "Seniority Mismatch — Underqualified", message,
            "This role typically requires significant leadership/management experience.", True)))


def location_flag() -> Column:
    here, there, mode = F.col("r_location"), F.col("j_location"), F.coalesce("j_work_mode", F.lit(""))
    apart = ~F.arrays_overlap("j_places", words(F.lower(here)))
    return F.when(F.col("j_on_site") & (here != "") & (there != "") & apart, _flag(
        3, "yellow", "location_mismatch", "Location Mismatch",
        F.concat(F.lit("JD: "), there, F.lit(" ("), mode, F.lit(") · Your location: "), here),
        "This role requires work from office. Location may be a concern.", False))


def notice_flag() -> Column:
    return F.when(F.col("j_at_once"), _flag(
        4, "yellow", "notice_period", "Immediate Joiner Preferred", "JD prefers immediate joiners",
        "If you have a notice period, this may affect your candidacy.", False))


def missing_certs() -> Column:
    """Required certifications whose name does not occur in the joined names of the candidate, in posting order."""
    return F.filter(empty_if_null(F.col("j_certs")), lambda c, i: ~F.contains(F.col("r_held"), F.get("j_certs_low", i)))


def certification_flags() -> Column:
    return F.transform(missing_certs(), lambda c, i: _flag(
        5, "red", "certification_missing", F.concat(F.lit("Required Certification Missing: "), c),
        F.concat(F.lit("JD requires '"), c, F.lit("' · Not found in your resume")),
        "This certification cannot be added without fabricating credentials.", True, item=i))


def _single(context: DataFrame, flag: Column) -> DataFrame:
    return (context.select("resume_id", "job_id", flag.alias("f")).filter("f IS NOT NULL")
            .select("resume_id", "job_id", *[f"f.{c}" for c in FLAG_FIELDS]))


def flag_experience(context: DataFrame) -> DataFrame:
    return _single(context, experience_flag())


def flag_domain(context: DataFrame, similarity: DataFrame | None = None) -> DataFrame:
    return _single(with_similarity(context, similarity), domain_flag())


def flag_seniority(context: DataFrame) -> DataFrame:
    return _single(context, seniority_flag())


def flag_location(context: DataFrame) -> DataFrame:
    return _single(context, location_flag())


def flag_notice(context: DataFrame) -> DataFrame:
    return _single(context, notice_flag())


def flag_certifications(context: DataFrame) -> DataFrame:
    return (context.select("resume_id", "job_id", F.explode(certification_flags()).alias("f"))
            .select("resume_id", "job_id", "f.item_ord", *[f"f.{c}" for c in FLAG_FIELDS]))


def missing_certifications(context: DataFrame) -> DataFrame:
    """(resume_id, job_id, pos, certification): what the candidate really lacks."""
    return context.select("resume_id", "job_id", F.posexplode(missing_certs()).alias("pos", "certification"))


def flags_array(context: DataFrame, similarity: DataFrame | None = None, domains: bool = False) -> DataFrame:
    """One row per pair with its ordered array of flags: red, yellow, info; then check order; then posting order. domains, or a table of similarities, adds
    the domain check."""
    checks = [experience_flag(), seniority_flag(), location_flag(), notice_flag()]
    if domains or similarity is not None:
        context = with_similarity(context, similarity)
        checks.insert(1, domain_flag())
    # each check is a column of its own, met twice: so it is compiled, which nothing is that lies inside a filter of an array
    typed = {f"flag_{i}": c.cast(_FLAG_TYPE) for i, c in enumerate(checks)}
    none = F.array().cast(f"array<{_FLAG_TYPE}>")
    raised = [F.when(F.col(name).isNotNull(), F.array(name)).otherwise(none) for name in typed]
    flags = F.sort_array(F.concat(*raised, certification_flags().cast(f"array<{_FLAG_TYPE}>")))
    return context.withColumns(typed).withColumn("flags", flags).drop(*typed)


def run_flags(context: DataFrame, similarity: DataFrame | None = None, domains: bool = False) -> DataFrame:
    """(resume_id, job_id, ord, ...) for all flags of all pairs. The outer form with a filter behind it: below the plain one Spark puts a filter that works the
    flags out once more."""
    return (flags_array(context, similarity, domains).select("resume_id", "job_id", F.posexplode_outer("flags").alias("ord", "f")).filter("ord IS NOT NULL")
            .select("resume_id", "job_id", "ord", *[f"f.{c}" for c in FLAG_FIELDS]))


def gate_columns() -> tuple[Column, Column, Column]:
    """open_red, open_skills and can_proceed of a pair row with flags, items (skill, status), acknowledged categories and decisions (skill, add)."""
    blocking = F.filter("flags", lambda f: (f["flag_type"] == "red") & f["requires_acknowledgement"] & ~F.array_contains("acknowledged", f["category"]))
    decided = F.transform(F.filter("decisions", lambda d: d["add"].isNotNull()), lambda d: d["skill"])
    waiting = F.filter("items", lambda i: i["status"].isin("can_add", "partial") & ~F.array_contains(decided, i["skill"]))
    open_red, open_skills = (F.coalesce(F.when(c.isNotNull(), F.size(c)), F.lit(0)).cast("long") for c in (blocking, waiting))
    return open_red.alias("open_red"), open_skills.alias("open_skills"), ((open_red == 0) & (open_skills == 0)).alias("can_proceed")


def flag_gate(rows: DataFrame) -> DataFrame:
    """Per pair row: open red flags, open skill decisions and whether the pair may proceed."""
    return rows.select("resume_id", "job_id", *gate_columns())


def acknowledged_flags() -> Column:
    """The flags of a pair row whose category was acknowledged, with their place."""
    placed = F.transform("flags", lambda f, i: F.struct(i.alias("ord"), f["title"].alias("title"), f["category"].alias("category")))
    return F.filter(placed, lambda f: F.array_contains("acknowledged", f["category"]))


def known_gaps(rows: DataFrame) -> DataFrame:
    """Titles of the flags whose category was acknowledged."""
    return rows.select("resume_id", "job_id", F.explode(acknowledged_flags()).alias("g")).select("resume_id", "job_id", "g.ord", "g.title")
