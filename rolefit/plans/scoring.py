"""End-to-end scoring plans over the adapter views."""

from __future__ import annotations

from pyspark.sql import DataFrame

from rolefit.operators import keywords as K
from rolefit.operators import signals as S
from rolefit.sources.adapters import Views


def pair_hits(v: Views, scopes: tuple[str, ...] = K.SCOPES) -> DataFrame:
    return K.pair_keyword_hits(v.keyed_resumes, v.jobs, v.pairs, scopes=scopes)


def scores_before(v: Views) -> DataFrame:
    return S.score_pairs(v.keyed_resumes, v.candidates, v.history, v.education, v.doc_facts, v.section_facts, v.jobs, v.pairs)


def scores_of(v: Views, documents: DataFrame) -> DataFrame:
    """Scores of the resumes in a micro-batch of the documents table against all their jobs. Every static table is cut down to the batch's resumes
    before anything of it is grouped."""
    ids = documents.selectExpr("doc_id AS resume_id")

    def own(table: DataFrame, key: str = "resume_id") -> DataFrame:
        return table.join(ids.withColumnRenamed("resume_id", key), key, "left_semi")

    return S.score_pairs(v.resumes_of(documents), own(v.candidates), v.history_of(own(v.table("orders"), "o_custkey")), own(v.education), v.doc_facts_of(documents),
                         own(v.section_facts, "doc_id"), v.jobs, own(v.pairs))


def scores_after(v: Views) -> DataFrame:
    return S.score_rewrites(v.rewritten_resumes, v.candidates, v.history, v.education, v.jobs, v.pairs)
