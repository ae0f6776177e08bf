"""Rewrites and alignment: properties and cases worked out by hand."""

import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from rolefit.functions.ratio import gestalt_ratio
from rolefit.operators import align as AL
from rolefit.operators import skills as SK
from rolefit.operators import verify as V

UNITS = "resume_id long, section string, entry_idx int, bullet_idx int, text string"


def fit(key, entry):
    """How an entry (page, block, entry, n_lines, norm) suits a key: tier, lower being better, and points within it; None if not at all."""
    text, n_lines = entry[4], entry[3]
    if text == key:
        return 0, n_lines
    if (key.startswith(text) or text.startswith(key)) and min(len(text), len(key)) >= 0.65 * max(len(text), len(key)):
        return 1, min(len(text), len(key)) / max(len(text), len(key))
    if len(key) >= 60 and text.startswith(key):
        return 2, n_lines
    ratio = SequenceMatcher(None, key, text).ratio()
    return (3, ratio) if ratio >= 0.75 else None


def check_alignment(keys, entries, got):
    """One to one; longer keys choose first; nobody has a free entry of a better tier, or of more points, than the one it got."""
    assert len({g[0] for g in got}) == len(got) == len({g[1:] for g in got})
    place = {g[0]: g[1:] for g in got}
    by_length = sorted(keys, key=len, reverse=True)
    for page in sorted({e[0] for e in entries}):
        waiting = [k for k in by_length if k not in place or place[k][0] >= page]
        taken = set()
        for key in waiting:
            free = {e[:3]: fit(key, e) for e in entries if e[0] == page and e[:3] not in taken}
            free = {e: f for e, f in free.items() if f}
            if place.get(key, (None,))[0] != page:
                assert not free, (key, free)
                continue
            tier, points = free[place[key]]
            assert all(f[0] > tier or f[0] == tier and f[1] <= points or tier == 3 and points > 0.95 for f in free.values()), (key, free)
            taken.add(place[key])


def test_alignment_leaves_nothing_better(spark):
    rnd = random.Random(11)
    base = ["led the migration of the billing platform to a new cloud region", "built data pipelines in spark for the finance team",
            "built data pipelines in spark", "managed a team of five engineers", "managed a team of six engineers", "wrote tests",
            "wrote tests and docs", "summary of a long career in analytics and reporting with many details that follow here now"]

    def noise(text):
        kind = rnd.randint(0, 4)
        if kind == 0:
            return text
        if kind == 1:
            return text + " " + rnd.choice(["again", "and more of it", "x", "with a great many more words than before, in full"])
        if kind == 2:
            at = rnd.randrange(len(text))
            return (text[:at] + rnd.choice("abcxyz") + text[at + 1:]).strip()
        return text[:max(4, int(len(text) * rnd.uniform(0.5, 0.95)))].strip()

    changes, entries, want = [], [], {}
    for doc in range(150):
        keys = list(dict.fromkeys(noise(rnd.choice(base)) for _ in range(rnd.randint(3, 12))))
        rows = [(page, 0, e, rnd.randint(1, 3), noise(rnd.choice(base))) for page in range(rnd.randint(1, 3)) for e in range(rnd.randint(1, 7))]
        changes += [(doc, k, k.upper(), i) for i, k in enumerate(keys)]
        entries += [(doc, *r[:4], r[4]) for r in rows]
        want[doc] = (keys, rows)
    changed = spark.createDataFrame(changes, "resume_id long, norm string, new_text string, ord int")
    segmented = spark.createDataFrame(entries, "doc_id long, page long, block int, entry long, n_lines long, text string")
    got = {d: [] for d in want}
    for r in AL.entry_align(changed, segmented).collect():
        got[r.doc_id].append((r.key, r.page, r.block, r.entry))
    for doc, (keys, rows) in want.items():
        check_alignment(keys, rows, got[doc])
    assert sum(map(len, got.values())) > 150


def test_alignment_worked_out_by_hand(spark):
    entries = [(1, 1, 0, 0, 1, "built data pipelines in spark for teams"), (1, 1, 0, 1, 1, "built data pipelines in spark"), (1, 1, 0, 2, 1, "wrote tests"),
               (1, 2, 0, 0, 1, "wrote tests"), (1, 2, 0, 1, 1, "managed a team of six engineers"), (1, 2, 0, 2, 1, "something else entirely")]
    keys = ["built data pipelines in spark", "wrote tests", "managed a team of five engineers", "built data pipelines in spark for teams", "unheard of"]
    changed = spark.createDataFrame([(1, k, k.upper(), i) for i, k in enumerate(keys)], "resume_id long, norm string, new_text string, ord int")
    segmented = spark.createDataFrame(entries, "doc_id long, page long, block int, entry long, n_lines long, text string")
    got = {(r.key, r.page, r.entry) for r in AL.entry_align(changed, segmented).collect()}
    assert got == {("built data pipelines in spark for teams", 1, 0), ("built data pipelines in spark", 1, 1), ("wrote tests", 1, 2),
                   ("managed a team of five engineers", 2, 1)}


@pytest.mark.parametrize("run", [16, 1])
def test_an_entry_on_many_pages_is_compared_once_a_run(spark, monkeypatch, run):
    monkeypatch.setattr(AL, "PAGE_RUN", run)
    line, near = "managed a team of six engineers", "managed a team of five engineers"
    items = spark.createDataFrame([(1, page, 0, 0, 1, line) for page in range(4)] + [(1, 2, 0, 1, 1, line)],
                                  "doc_id long, page long, block int, entry long, n_lines long, norm string").withColumn(
        "norm_counts", AL.character_counts(F.col("norm")))
    keys = spark.createDataFrame([(1, near, -len(near), 0, [1])], "doc_id long, key string, neg_len int, ord int, skip array<long>").withColumn(
        "key_counts", AL.character_counts(F.col("key")))
    met = AL.comparable(keys, items).collect()
    assert len(met) == (1 if run == 16 else 3) and sorted(p for r in met for p in r.pages) == [0, 2, 3]
    assert sorted((r.page, r.entry, r.score) for r in AL.fuzzy_candidates(keys, items).collect()) == [
        (page, entry, SequenceMatcher(None, near, line).ratio()) for page, entry in ((0, 0), (2, 0), (2, 1), (3, 0))]


def test_ratio_stops_where_the_blocks_found_cannot_reach_the_bound(spark):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("abcd ") for _ in range(rnd.choice([0, 3, 40, 260]))) for _ in range(60)]
    texts += [t[:i] + "x" + t[i + 2:] for t in texts for i in (1, len(t) // 2)]
    pairs = [(a, b) for a in texts[:60] for b in texts[60:]] + [(None, "a"), ("", "")]
    want = [None if a is None else SequenceMatcher(None, a, b).ratio() for a, b in pairs]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    for bound in (0.0, 0.75):
        got = [r.r for r in df.select("i", gestalt_ratio(F.col("a"), F.col("b"), bound).alias("r")).orderBy("i").collect()]
        assert got == [None if w is None or w < bound else w for w in want]


@pytest.mark.parametrize("chunk", [4096, 2, 1])
def test_segmentation_keeps_all_lines(spark, monkeypatch, chunk):
    monkeypatch.setattr(AL, "CHUNK_LINES", chunk)
    lines = ["Summary text", "goes on", "• bullet one", "continued", "EXPERIENCE", "Acme Corp — Engineer", "Jan 2020", "Tools: a, b", "-no bullet"]
    rows = [(1, 0, 0, i, t, 12.0 * i, 12.0 * i + 10) for i, t in enumerate(lines)] + [(1, 0, 1, 20, "next block", 0.0, 10.0)]
    df = spark.createDataFrame(rows, "doc_id long, page long, block int, line int, text string, y0 double, y1 double")
    got = [r.text for r in sorted(AL.entry_segment(df).collect(), key=lambda r: (r.block, r.entry))]
    assert got == ["Summary text goes on", "• bullet one continued", "EXPERIENCE", "Acme Corp — Engineer", "Jan 2020", "Tools: a, b -no bullet",
                   "next block"]


@pytest.mark.parametrize("chunk", [4096, 3])
def test_segmentation_of_gaps(spark, monkeypatch, chunk):
    monkeypatch.setattr(AL, "CHUNK_LINES", chunk)
    gaps = [0, 2, 25, 2, 2, 30, 2, 21, 20, 2, 2, 40]
    rows, y = [], 0.0
    for i, gap in enumerate(gaps):
        y += gap
        rows.append((1, 0, 0, i * 2, f"word {i}", y, y + 10))
        y += 10
    df = spark.createDataFrame(rows, "doc_id long, page long, block int, line int, text string, y0 double, y1 double")
    got = [(r.entry, r.n_lines, r.first_line) for r in sorted(AL.entry_segment(df).collect(), key=lambda r: r.entry)]
    assert got == [(0, 2, "word 0"), (1, 3, "word 2"), (2, 2, "word 5"), (3, 4, "word 7"), (4, 1, "word 11")]


def _units(spark, rows):
    return spark.createDataFrame(rows, UNITS)


def _rows(df):
    return sorted(tuple(r) for r in df.select("resume_id", "section", "entry_idx", "bullet_idx", "text").collect())


def test_revert_scopes(spark):
    old = [(1, "summary", 0, 0, "s"), (1, "experience", 0, 0, "a"), (1, "experience", 0, 1, "b"), (1, "experience", 1, 0, "c"),
           (1, "skills", 0, 0, "sql"), (1, "tech_stack", 0, 0, "java"), (1, "education", 0, 0, "BSc, School")]
    new = [(r[0], r[1], r[2], r[3], r[4] + " new") for r in old] + [(1, "experience", 0, 2, "extra")]
    flags = "resume_id long, section string, entry_index int, bullet_index int, original_text string, rewritten_text string"
    verdicts = spark.createDataFrame([(1, "false")], "resume_id long, is_clean string")
    nobody = spark.createDataFrame([], "resume_id long, skill string")
    original, rewritten = _units(spark, old), _units(spark, new)

    def run(rows, verdict=verdicts, approved=nobody):
        scoped = V.revert_scope(original, rewritten, spark.createDataFrame(rows, flags), verdict, approved)
        return _rows(V.revert_apply(original, rewritten, scoped)), {r.scope for r in scoped.collect()}

    texts, scopes = run([(1, "experience", 0, 1, "", "x")])
    assert scopes == {"bullet"} and (1, "experience", 0, 1, "b") in texts and (1, "experience", 0, 2, "extra") in texts
    texts, scopes = run([(1, "experience", 0, 9, "", "x")])
    assert scopes == {"entry"} and (1, "experience", 0, 2, "extra") not in texts and (1, "experience", 1, 0, "c new") in texts
    texts, scopes = run([(1, "experience", -1, -1, "", "x"), (1, "skills", -1, -1, "", "x"), (1, "summary", -1, -1, "", "x")])
    assert scopes == {"section"} and (1, "tech_stack", 0, 0, "java") in texts and (1, "education", 0, 0, "BSc, School new") in texts
    assert run([(1, "education", -1, -1, "school", "x")])[1] == {"kept: in original"}
    granted = spark.createDataFrame([(1, "SQL")], "resume_id long, skill string")
    assert run([(1, "skills", -1, -1, "", "SQL, rust")], approved=granted)[1] == {"kept: approved"}
    assert run([(1, "skills", -1, -1, "", "None")], approved=granted)[1] == {"kept: empty flag"}
    clean = spark.createDataFrame([(1, "???")], "resume_id long, is_clean string")
    assert run([(1, "summary", -1, -1, "", "x")], verdict=clean)[0] == sorted(new)
    everything = [(1, s, -1, -1, "", "x") for s in ("summary", "experience", "skills")] + [(1, "education", -1, -1, "zzz", "x")]
    texts, _ = run(everything)
    assert texts == sorted(old)
    assert run(everything[::-1] + everything)[0] == texts


def test_change_map_keeps_last_text_of_a_key(spark):
    old = [(1, "experience", 0, 0, "• Same  line"), (1, "experience", 0, 1, "same line"), (1, "experience", 0, 2, "same line")]
    new = [(1, "experience", 0, 0, "A"), (1, "experience", 0, 1, "B"), (1, "experience", 0, 2, "C"), (1, "experience", 0, 3, "D")]
    changes = V.change_map(V.paired_units(_units(spark, old), _units(spark, new)))
    assert sorted((r.key, r.new_text) for r in V.registered_changes(changes).collect()) == [
        ("Same  line", "A"), ("same line", "C"), ("• Same  line", "A")]
    (only,) = V.change_dedupe(changes).collect()
    assert (only.norm, only.key, only.new_text) == ("same line", "• Same  line", "A")


def test_summary_limits_use_the_whole_paragraph(spark):
    paragraph = "one two three four five six seven eight\nnine ten"
    raw = spark.createDataFrame([(1, f"Name\n{paragraph}\n\nEXPERIENCE\nmore")], "resume_id long, raw_text string")
    pairs = spark.createDataFrame([(1, "summary", 0, 0, "one two three four five six seven", "x " * 30)],
                                  "resume_id long, section string, entry_idx int, bullet_idx int, original_text string, rewritten_text string")
    row = V.length_check(pairs, raw).first()
    assert (row.n_original, row.n_rewritten, row.within) == (10, 30, False)


def test_skill_merge_is_idempotent(spark):
    resumes = spark.createDataFrame([(1, ["SQL"], ["Java"])], "resume_id long, skills array<string>, tech_stack array<string>")
    added = spark.createDataFrame([(1, 1, 0, "sql"), (1, 1, 1, "Rust"), (1, 1, 2, "rust"), (1, 1, 3, "JAVA")],
                                  "resume_id long, job_id long, ord int, skill string")
    pairs = spark.createDataFrame([(1, 1), (1, 2)], "resume_id long, job_id long")
    once, bare = SK.skill_merge(resumes, pairs, added).orderBy("job_id").collect()
    assert (bare.skills, bare.tech_stack) == (["SQL"], ["Java"])  # a pair without additions stays as it is
    assert (once.skills, once.tech_stack) == (["SQL", "Rust", "JAVA"], ["Java", "sql", "Rust"])
    again = SK.skill_merge(spark.createDataFrame([(1, once.skills, once.tech_stack)], resumes.schema), pairs, added).orderBy("job_id").first()
    assert (again.skills, again.tech_stack) == (once.skills, once.tech_stack)


def test_character_counts_never_rule_out_what_the_ratio_accepts(spark):
    rnd = random.Random(11)
    texts = ["".join(rnd.choices("abc 12éß-Z", k=rnd.randint(1, 14))) for _ in range(50)]
    pairs = [(a, b) for a in texts[:25] for b in texts[25:]]
    df = spark.createDataFrame(pairs, "a string, b string").withColumns({"x": AL.character_counts(F.col("a")), "y": AL.character_counts(F.col("b"))})
    for r in df.select("a", "b", AL.most_shared(F.col("x"), F.col("y")).alias("n")).collect():
        m = SequenceMatcher(None, r.a, r.b)
        assert r.n >= sum(block.size for block in m.get_matching_blocks()) and 2 * r.n <= len(r.a) + len(r.b)


def test_prefix_alignment_serves_long_keys_first(spark):
    """Keys wait for each other: the longest takes the entry that the second wants most, which takes that of the third, in as many rounds."""
    base = "built many data pipelines in spark"
    keys = [base + " abcd", base + " abc", base + " ab", base + " a"]
    entries = [(1, 0, 0, i, 1, t) for i, t in enumerate([base + " abcde", base + " abcdef", base])]
    changed = spark.createDataFrame([(1, k, k.upper(), i) for i, k in enumerate(keys)], "resume_id long, norm string, new_text string, ord int")
    segmented = spark.createDataFrame(entries, "doc_id long, page long, block int, entry long, n_lines long, text string")
    got = {r.key: r.entry for r in AL.prefix_align(changed, segmented).collect()}
    assert got == {keys[0]: 0, keys[1]: 1, keys[2]: 2}


def test_unused_placeholders(spark):
    templates = spark.createDataFrame([(1, "Dear {{NAME}}, {{NAME}} {{X_1}}"), (1, "{{CITY}}"), (2, ""), (3, None)], "resume_id long, template string")
    rows = [(r, p, "v") for r in (1, 2, 3, 4) for p in ("NAME", "CITY", "X_2")] + [(1, "X_2", "again")]
    placeholders = spark.createDataFrame(rows, "resume_id long, placeholder string, value string")
    got = sorted(map(tuple, AL.unused_placeholders(templates, placeholders).collect()))
    assert got == [(1, "X_2"), (2, "CITY"), (2, "NAME"), (2, "X_2")]
    assert AL.unused_placeholders(templates.limit(0), placeholders).count() == 0


def test_unused_placeholders_are_told_apart_per_resume(spark):
    """Repeated and null names, and no aggregate that has the name among its keys: it would hold every name of all resumes of a task."""
    templates = spark.createDataFrame([(1, "{{NAME}}"), (None, "{{CITY}}")], "resume_id long, template string")
    placeholders = spark.createDataFrame([(1, "NAME"), (1, "CITY"), (1, "CITY"), (1, None), (None, "NAME")], "resume_id long, placeholder string")
    unused = AL.unused_placeholders(templates, placeholders)
    assert [tuple(r) for r in unused.collect()] == [(1, "CITY")]
    plan = unused._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if re.search(r"Aggregate \[resume_id#\d+L, placeholder", line)], plan


def test_revert_of_lost_projects_is_quarantined(spark):
    original = _units(spark, [(1, "projects", 0, 0, "a"), (1, "projects", 1, 0, "b"), (1, "certifications", 0, 0, "CKA")])
    rewritten = _units(spark, [(1, "projects", 0, 0, "a new"), (1, "certifications", 0, 0, "CKA"), (1, "certifications", 0, 1, "PMP")])
    flags = spark.createDataFrame([(1, "projects", 1, 0, "", "x"), (1, "projects", 0, 0, "", "x"), (1, "certifications", -1, -1, "", "PMP"), (1, "languages", 0, 0, "", "x")],
                                  "resume_id long, section string, entry_index int, bullet_index int, original_text string, rewritten_text string")
    scoped = V.revert_scope(original, rewritten, flags, spark.createDataFrame([(1, "false")], "resume_id long, is_clean string"),
                            spark.createDataFrame([], "resume_id long, skill string"))
    assert sorted(r.scope for r in scoped.collect()) == ["bullet", "kept: unknown section", "quarantined", "section"]
    assert _rows(V.revert_apply(original, rewritten, scoped)) == [(1, "certifications", 0, 0, "CKA"), (1, "projects", 0, 0, "a")]
