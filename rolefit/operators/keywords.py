"""Keyword matching (section C).

The rule for one keyword and one text: the keyword occurs literally, or every word of it that has at least three
letters has an inflected form among the words of the text. Tests are made per *pair*, so the work is
linear in the pairs table. What a pair needs is prepared once per resume and once per job:

* Job side: keywords lower-cased and split into words once.
* Resume side: which keyword words a resume contains in any form, and which keywords literally (rolefit.operators.word_index). Both come from one
  dictionary of the distinct tokens of the corpus, or, with not too many keywords, of the row itself. Pairs carry these arrays as numbers, never a text: no
  text is searched above the pair join.

Keywords whose words are all shorter than three letters hold for every resume; they are a flag on the keyword and
never expanded to rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolefit import refdata as R
from rolefit.functions.text import empty_if_null, tokens
from rolefit.operators.word_index import coded, index_of, keyword_words, long_words, number, told_apart, word_stems

SCOPES = ("all", "summary", "skills")
#: So many jobs, with their keywords, are broadcast to the pairs; more meet them by a shuffle, and before the resumes do.
BROADCAST_JOBS = 5_000


def scope_texts(resumes: DataFrame, verified: bool = False) -> DataFrame:
    """One row per resume with the lower-cased text of the three scopes, and in the order of a verified resume where that is wanted.

    Input columns: resume_id, summary, skills, tech_stack, bullets.
    """
    skills, tech, bullets = (empty_if_null(F.col(c)) for c in ("skills", "tech_stack", "bullets"))
    summary = F.coalesce("summary", F.lit(""))
    return resumes.select(
        "resume_id",
        F.lower(F.concat_ws(" ", F.concat_ws(" ", skills), F.concat_ws(" ", tech), F.concat_ws(" ", bullets), summary))
        .alias("text_all"),
        F.lower(summary).alias("text_summary"),
        F.lower(F.concat_ws(" ", F.concat(skills, tech))).alias("text_skills"),
        *([verified_text().alias("text_verified")] if verified else ()),
    )


def token_index(resumes: DataFrame) -> DataFrame:
    """Distinct (resume_id, scope, token). Distinct inside each row, so it needs no shuffle."""
    return (
        scope_texts(resumes)
        .select("resume_id", F.explode(F.array(*[F.struct(F.lit(s).alias("scope"), F.col(f"text_{s}").alias("text"))
                                                 for s in SCOPES])).alias("s"))
        .select("resume_id", F.col("s.scope").alias("scope"), F.explode(tokens(F.col("s.text"))).alias("token"))
        .filter("token <> ''")
    )


def job_keywords(jobs: DataFrame) -> DataFrame:
    """Long form (job_id, kind, pos, keyword): lower-cased, duplicates and positions kept, pos from 0."""
    def side(kind: str) -> DataFrame:
        return jobs.select("job_id", F.lit(kind).alias("kind"),
                           F.posexplode(empty_if_null(F.col(f"{kind}_keywords"))).alias("pos", "keyword"))

    return side("hard").unionByName(side("soft")).select("job_id", "kind", "pos", F.lower("keyword").alias("keyword"))


def variant_index(keywords: DataFrame) -> DataFrame:
    """Distinct (word, variant) for the distinct words of at least three letters of a keyword column."""
    words = keywords.select(F.explode(long_words(F.lower("keyword"))).alias("word")).distinct()
    endings = F.array(F.lit(""), *[F.lit(e) for e in R.WORD_ENDINGS])
    forms = F.flatten(F.transform(word_stems(F.col("word")),
                                  lambda stem: F.transform(endings, lambda e: F.concat(stem, e))))
    return words.select("word", F.explode(F.array_distinct(forms)).alias("variant"))


def prepared_jobs(jobs: DataFrame, lists: dict[str, str] | None = None) -> DataFrame:
    """(job_id, an array of (term, keyword, code, long, n_words) for each list in job order, job_stems, job_codes): code is the number of the keyword, long has
    the numbers of the stems of each of its long words; the last two are all of these of all lists, each once. lists names the columns they come from; hard and
    soft keywords by default."""
    lists = lists or {"hard": "hard_keywords", "soft": "soft_keywords"}

    def side(column: str) -> Column:
        return F.transform(
            empty_if_null(F.col(column)),
            lambda k: F.struct(k.alias("term"), F.lower(k).alias("keyword"), number(F.lower(k)).alias("code"),
                               F.transform(long_words(F.lower(k)), lambda w: F.transform(word_stems(w), number)).alias("long"),
                               F.size(keyword_words(F.lower(k))).alias("n_words")))

    sides = jobs.select("job_id", *[side(column).alias(name) for name, column in lists.items()])
    stems = F.flatten(F.flatten(F.transform(F.concat(*lists), lambda k: k["long"])))
    return sides.withColumns({"job_stems": F.array_distinct(stems), "job_codes": F.array_distinct(F.transform(F.concat(*lists), lambda k: k["code"]))})


def keywords_of(prepared: DataFrame) -> DataFrame:
    """(keyword): every keyword of prepared jobs."""
    lists = [c for c, kind in prepared.dtypes if kind.startswith("array<struct<term:")]
    return prepared.select(F.explode(F.transform(F.concat(*lists), lambda k: k["keyword"])).alias("keyword")).distinct()


def few(jobs: DataFrame) -> bool:
    return jobs.select("job_id").limit(BROADCAST_JOBS + 1).count() <= BROADCAST_JOBS


def met(pairs: DataFrame, jobs: DataFrame, resumes: DataFrame, broadcast: bool) -> DataFrame:
    """Pairs with both of their sides. Where the jobs are few, the pairs go to the resumes as two keys and nothing wide is shuffled."""
    if broadcast:
        return pairs.join(resumes, "resume_id").join(F.broadcast(jobs), "job_id")
    return pairs.join(jobs, "job_id").join(resumes, "resume_id")


def indexed(tables: list[DataFrame], keywords: DataFrame, first: str = "text_all", forms: bool = True):
    """The index, in numbers, of each of these tables of texts (called with a table, its scopes and its reordered scopes); first names their first scope."""
    told_apart(keywords)
    index = index_of([t.select(first) for t in tables], keywords, forms)
    return lambda table, scopes, reordered=(): coded(index(table, scopes, reordered))


def index_columns(suffix: str = "", scopes: tuple[str, ...] = SCOPES) -> list[str]:
    return [f"{c}_{s}{suffix}" for c in ("words", "literals") for s in scopes]


def narrowed(rows: DataFrame, suffix: str = "", scopes: tuple[str, ...] = SCOPES) -> DataFrame:
    """The index of the resume in a pair row, cut down to what its job asks for: found once by hash for all keywords of the pair. The job's
    list is the shorter one, which is hashed."""
    for s in scopes:
        rows = rows.withColumn(f"words_{s}{suffix}", F.array_intersect(f"words_{s}{suffix}", "job_stems"))
        rows = rows.withColumn(f"literals_{s}{suffix}", F.array_intersect(f"literals_{s}{suffix}", "job_codes"))
    return rows


def holds(keyword: Column, words: str, literals: str) -> Column:
    """Whether a prepared keyword holds for the resume with these words and literals."""
    have, named = F.col(words), F.col(literals)
    formed = (F.size(keyword["long"]) == 0) | (
        (F.size(have) > 0) & F.forall(keyword["long"], lambda stems: F.exists(stems, lambda stem: F.array_contains(have, stem))))
    by_form = ((keyword["n_words"] > 1) | ((keyword["n_words"] == 1) & (F.size(keyword["long"]) > 0))) & formed
    return by_form | (keyword["keyword"] == "") | ((F.size(named) > 0) & F.array_contains(named, keyword["code"]))


def tested(kind: str, suffix: str = "", scopes: tuple[str, ...] = SCOPES) -> Column:
    """The keywords of a list with in_<scope> for the scopes, all being the first. The others are parts of the whole text."""
    whole = F.transform(F.col(kind), lambda k: F.struct(k.alias("k"), holds(k, f"words_all{suffix}", f"literals_all{suffix}").alias("in_all")))
    return F.transform(whole, lambda h: F.struct(
        h["k"]["term"].alias("term"), h["k"]["keyword"].alias("keyword"), h["in_all"].alias("in_all"),
        *[(h["in_all"] & holds(h["k"], f"words_{s}{suffix}", f"literals_{s}{suffix}")).alias(f"in_{s}") for s in scopes[1:]]))


def pair_keyword_hits(resumes: DataFrame, jobs: DataFrame, pairs: DataFrame, per_resume: DataFrame | None = None,
                      scopes: tuple[str, ...] = SCOPES, per_job: DataFrame | None = None) -> DataFrame:
    """One row per pair: arrays hard and soft of (term, keyword, in_all, in_summary, in_skills) in job order; scopes leaves out what is not wanted.

    Columns of per_resume (one row per resume_id) come along with the resumes, those of per_job (one row per job_id) with the jobs; they are null where it lacks
    one.
    """
    prepared = prepared_jobs(jobs)
    texts = scope_texts(resumes)
    ready = indexed([texts], keywords_of(prepared))(texts, scopes)
    carried = []
    if per_job is not None:
        carried += [c for c in per_job.columns if c != "job_id"]
        prepared = prepared.join(per_job, "job_id", "left")
    if per_resume is not None:
        carried += [c for c in per_resume.columns if c != "resume_id"]
        ready = ready.join(per_resume, "resume_id", "left")
    joined = narrowed(met(pairs.select("resume_id", "job_id"), prepared, ready, few(jobs)), scopes=scopes)
    return joined.select("resume_id", "job_id", *[tested(kind, scopes=scopes).alias(kind) for kind in ("hard", "soft")], *carried)


def keyword_hits(resumes: DataFrame, jobs: DataFrame, pairs: DataFrame, scopes: tuple[str, ...] = SCOPES) -> DataFrame:
    """Long form: (resume_id, job_id, kind, pos, keyword, in_all, in_summary, in_skills), of the scopes that are wanted."""
    hits = pair_keyword_hits(resumes, jobs, pairs, scopes=scopes)

    def side(kind: str) -> Column:
        return F.transform(F.col(kind), lambda h, i: F.struct(F.lit(kind).alias("kind"), i.alias("pos"), h.alias("h")))

    return (
        hits.select("resume_id", "job_id", F.explode(F.concat(side("hard"), side("soft"))).alias("k"))
        .select("resume_id", "job_id", "k.kind", "k.pos", "k.h.keyword", *[f"k.h.in_{s}" for s in scopes])
    )


def _count(array: Column, field: str) -> Column:
    return F.size(F.filter(array, lambda h: h[field])).cast("double")


def _share(part: Column, whole: Column) -> Column:
    return part / F.greatest(F.size(whole), F.lit(1))


def keyword_match_score(hard: str = "hard", soft: str = "soft") -> Column:
    hard, soft = F.col(hard), F.col(soft)
    points = _share(_count(hard, "in_all"), hard) * 20 + _share(_count(soft, "in_all"), soft) * 10
    return F.when((F.size(hard) == 0) & (F.size(soft) == 0), F.lit(R.NEUTRAL_KEYWORD_MATCH)).otherwise(
        F.least(F.bround(points, 1), F.lit(R.SIGNAL_MAX["keyword_match"])))


def keyword_placement_score(hard: str = "hard", keywords: int = R.PLACEMENT_KEYWORDS) -> Column:
    """Of the first keywords of the job, which the signal is about, the share in summary and skills."""
    first = F.slice(F.col(hard), 1, keywords)
    points = _share(_count(first, "in_summary"), first) * 8 + _share(_count(first, "in_skills"), first) * 7
    return F.when(F.size(hard) == 0, F.lit(R.NEUTRAL_KEYWORD_PLACEMENT)).otherwise(
        F.least(F.bround(points, 1), F.lit(R.SIGNAL_MAX["keyword_placement"])))


def keyword_match(hits: DataFrame) -> DataFrame:
    """(resume_id, job_id, keyword_match) from pair_keyword_hits."""
    return hits.select("resume_id", "job_id", keyword_match_score().alias("keyword_match"))


def keyword_placement(hits: DataFrame) -> DataFrame:
    """(resume_id, job_id, keyword_placement) from pair_keyword_hits."""
    return hits.select("resume_id", "job_id", keyword_placement_score().alias("keyword_placement"))


def keyword_scores(hits: DataFrame) -> DataFrame:
    """Both keyword signals in one pass, beside the other columns of the hits."""
    carried = [c for c in hits.columns if c not in ("hard", "soft")]
    return hits.select(*carried, keyword_match_score().alias("keyword_match"),
                       keyword_placement_score().alias("keyword_placement"))


def keyword_gap(long_hits: DataFrame) -> DataFrame:
    """Keywords of the job that the resume does not have, per pair."""
    return long_hits.filter(~F.col("in_all")).select("resume_id", "job_id", "kind", "pos", "keyword")


def most_missed(gap: DataFrame, k: int) -> DataFrame:
    """The k keywords of each job that the most resumes lack."""
    counts = gap.groupBy("job_id", "keyword").agg(F.count_distinct("resume_id").alias("n_missing"))
    by_count = Window.partitionBy("job_id").orderBy(F.desc("n_missing"), "keyword")
    return counts.withColumn("rank", F.row_number().over(by_count)).filter(F.col("rank") <= k)


def verified_text() -> Column:
    """Lower-case text of a verified resume: summary, skills, tech stack, bullets."""
    parts = [F.concat_ws(" ", empty_if_null(F.col(c))) for c in ("skills", "tech_stack", "bullets")]
    return F.lower(F.concat_ws(" ", F.coalesce("summary", F.lit("")), *parts))


def present(terms: Column, literals: str) -> Column:
    """(pos, keyword) of the prepared terms that occur literally in the text of the row."""
    found = F.transform(terms, lambda k, i: F.struct(i.alias("pos"), k["term"].alias("keyword"), k["keyword"].alias("low"), k["code"].alias("code")))
    return F.filter(found, lambda k: (k["low"] == "") | F.array_contains(F.col(literals), k["code"]))


def keywords_present(resumes: DataFrame, jobs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Hard keywords of the job that occur literally in the resume text: (resume_id, job_id, pos, keyword)."""
    prepared = prepared_jobs(jobs, {"hard": "hard_keywords"})
    texts = resumes.select("resume_id", verified_text().alias("text_verified"))
    index = indexed([texts], keywords_of(prepared), "text_verified", forms=False)(texts, ("verified",)).select("resume_id", "literals_verified")
    joined = met(pairs.select("resume_id", "job_id"), prepared.drop("job_stems"), index, few(jobs)).withColumn(
        "literals_verified", F.array_intersect("job_codes", "literals_verified"))
    return joined.select("resume_id", "job_id", F.explode(present(F.col("hard"), "literals_verified")).alias("p")).select(
        "resume_id", "job_id", "p.pos", "p.keyword")


def keywords_injected(before: DataFrame, after: DataFrame) -> DataFrame:
    """Keywords present after the rewrite and not before: distinct (resume_id, job_id, keyword)."""
    key = ["resume_id", "job_id", "keyword"]
    return after.select(*key).distinct().join(before.select(*key), key, "left_anti")
