"""Line segmentation and text alignment (section I)."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolefit import refdata as R
from rolefit.functions.ratio import gestalt_ratio
from rolefit.functions.text import normalise_line, strip
from rolefit.sources.corpus import materialise

BULLET_START = rf"(?U)^[{R.BULLET_CHARS}]\s"
HEADER_LINE = "(?i)^(?:" + "|".join(R.SECTION_HEADERS) + ")$"


CHUNK_LINES = 4096


def entry_segment(lines: DataFrame) -> DataFrame:
    """Group the lines of each block into logical entries.

    lines: (doc_id, page, block, line, text, y0, y1). Result: (doc_id, page, block, entry, n_lines, first_line, text,
    y0, y1). Blocks are cut into chunks of line numbers, so that one very long block is spread over tasks: a line looks
    back inside its chunk, and one row per chunk carries the last line and the number of entries on to the next.
    """
    block = ["doc_id", "page", "block"]
    chunk = [*block, "chunk"]
    inside = Window.partitionBy(*chunk).orderBy("line")
    across = Window.partitionBy(*block).orderBy("chunk")
    text = strip(F.col("text"))
    by_text = (
        F.regexp_like(text, F.lit(BULLET_START)) | F.regexp_like(text, F.lit(HEADER_LINE))
        | F.regexp_like(text, F.lit(R.CATEGORY_LABEL_RE))
        | (F.regexp_like(text, F.lit(R.JOB_HEADER_RE)) & (F.length(text) < R.JOB_HEADER_MAX_CHARS))
        | F.regexp_like(text, F.lit(R.DATE_LINE_RE))
    )
    above = F.lag("y1").over(inside)
    marked = (
        lines.select(*block, F.floor(F.col("line") / CHUNK_LINES).alias("chunk"), "line", text.alias("text"), "y0", "y1",
                     by_text.alias("by_text"))
        .withColumn("first", above.isNull())
        .withColumn("starts", F.when(~F.col("first"), (F.col("by_text") | (F.col("y0") - above > R.LINE_GAP)).cast("int")).otherwise(0))
    )
    # the first line of a chunk starts an entry by its own text, by the gap to the chunk before, or where there is none
    gap = F.col("top") - F.lag("bottom").over(across)
    opening = F.when(F.col("opens") | F.coalesce(gap > R.LINE_GAP, F.lit(True)), 1).otherwise(0)
    chunks = (
        marked.groupBy(*chunk).agg(
            F.sum("starts").alias("inner"), F.bool_or(F.col("first") & F.col("by_text")).alias("opens"),
            F.max(F.when(F.col("first"), F.col("y0"))).alias("top"), F.max_by("y1", "line").alias("bottom"))
        .withColumn("opening", opening)
        .withColumn("entries_before", F.coalesce(F.sum(F.col("opening") + F.col("inner")).over(
            across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .select(*chunk, (F.col("entries_before") + F.col("opening") - 1).alias("base"))
    )
    running = F.sum("starts").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    numbered = marked.withColumn("running", running).join(chunks, chunk).withColumn("entry", F.col("base") + F.col("running"))
    parts = F.array_sort(F.collect_list(F.struct("line", "text")))
    return (
        numbered.groupBy(*block, "entry")
        .agg(F.count(F.lit(1)).alias("n_lines"), F.transform(parts, lambda p: p["text"]).alias("parts"),
             F.min("y0").alias("y0"), F.max("y1").alias("y1"))
        .select(*block, "entry", "n_lines", F.get("parts", F.lit(0)).alias("first_line"),
                F.array_join("parts", " ").alias("text"), "y0", "y1"))


# --- I2 ---------------------------------------------------------------------------------------------------------------
def ascii_form(c: Column, keep_bullet: bool = False) -> Column:
    """Typographic marks as ASCII, then everything outside Latin-1 dropped."""
    single = [(a, b) for a, b in R.ASCII_FORMS if len(b) == 1 and not (keep_bullet and a == "•")]
    out = F.translate(c, "".join(a for a, _ in single), "".join(b for _, b in single))
    for mark, form in R.ASCII_FORMS:
        if len(form) > 1:
            out = F.replace(out, F.lit(mark), F.lit(form))
    return F.regexp_replace(out, r"[^\x00-\xFF•]" if keep_bullet else r"[^\x00-\xFF]", "")


def text_normalise(lines: DataFrame, mode: str = "compare", column: str = "text") -> DataFrame:
    """Add the normalised text; mode is compare, ascii or ascii_keep_bullet."""
    value = F.col(column)
    form = normalise_line(value) if mode == "compare" else ascii_form(value, mode == "ascii_keep_bullet")
    return lines.withColumn("normalised", form)


def charset_report(lines: DataFrame) -> DataFrame:
    """Per source: characters, characters with an ASCII form and characters that are dropped."""
    marks = "".join(a for a, _ in R.ASCII_FORMS)
    text = F.col("text")
    unmarked = F.regexp_replace(text, f"[{marks}]", "")
    return lines.groupBy("source").agg(
        F.sum(F.length(text)).alias("n_chars"), F.sum(F.length(text) - F.length(unmarked)).alias("n_replaced"),
        F.sum(F.length(unmarked) - F.length(F.regexp_replace(unmarked, r"[^\x00-\xFF]", ""))).alias("n_dropped"))


# --- I3 ---------------------------------------------------------------------------------------------------------------
# A key goes through the pages in order. On a page the keys are served longest first, and each takes its best entry
# that is still free: an equal one, else a prefix either way, else an entry that begins with it, else a similar one.
# The preference of a key for an entry does not depend on what is taken, so all of it is computed by joins first. Serving then goes in rounds
# over all documents at once (serve).
ENTRY = ["page", "block", "entry"]
SHORT_ANCHOR, LONG_ANCHOR = 1, 16
PAGE_RUN = 16  # pages whose entries a key meets at once; results do not depend on it
LENGTH_RATIO = R.FUZZY_RATIO / (2 - R.FUZZY_RATIO)  # shorter/longer length that the similarity bound still allows


def align_keys(changes: DataFrame) -> DataFrame:
    """(doc_id, key, new_text, neg_len, ord) from deduplicated changes; (neg_len, ord) is the serving order."""
    return changes.select(F.col("resume_id").alias("doc_id"), F.col("norm").alias("key"), "new_text",
                          (-F.length("norm")).alias("neg_len"), "ord")


def align_entries(entries: DataFrame) -> DataFrame:
    norm = normalise_line(F.col("text"))
    return entries.select("doc_id", *ENTRY, "n_lines", norm.alias("norm")).filter("norm <> ''")


def exact_candidates(keys: DataFrame, entries: DataFrame) -> DataFrame:
    return keys.join(entries.withColumnRenamed("norm", "key"), ["doc_id", "key"]).select(
        "doc_id", "key", "neg_len", "ord", *ENTRY, F.lit(1).alias("tier"), (-F.col("n_lines")).cast("double").alias("pref"),
        F.lit(1.0).alias("score"))


def _anchors(c: Column) -> Column:
    """Join keys such that any two strings, one a prefix of the other at PREFIX_RATIO or longer, share exactly one."""
    shortest_partner = math.ceil(LONG_ANCHOR / R.PREFIX_RATIO)
    n = F.length(c)
    return F.array_compact(F.array(
        F.when(n >= LONG_ANCHOR, F.concat(F.lit("L"), F.substring(c, 1, LONG_ANCHOR))),
        F.when(n <= shortest_partner, F.concat(F.lit("S"), F.substring(c, 1, SHORT_ANCHOR)))))


def prefix_candidates(keys: DataFrame, entries: DataFrame) -> DataFrame:
    left = keys.select("doc_id", "key", "neg_len", "ord", F.explode(_anchors(F.col("key"))).alias("anchor"))
    right = entries.select("doc_id", *ENTRY, "n_lines", "norm", F.explode(_anchors(F.col("norm"))).alias("anchor"))
    a, b = F.length("key"), F.length("norm")
    ratio = F.least(a, b) / F.greatest(a, b)
    once = F.startswith("anchor", F.lit("L")) | (F.least(a, b) < LONG_ANCHOR)
    entry_longer, key_longer = F.startswith("norm", "key"), F.startswith("key", "norm")
    near = (entry_longer | key_longer) & (ratio >= R.PREFIX_RATIO)
    leading = entry_longer & (a >= R.LEAD_PREFIX_CHARS)
    return (left.join(right, ["doc_id", "anchor"]).filter(once & (F.col("key") != F.col("norm")) & (near | leading))
            .select("doc_id", "key", "neg_len", "ord", *ENTRY, F.when(near, 2).otherwise(3).alias("tier"),
                    F.when(near, -ratio).otherwise(-F.col("n_lines").cast("double")).alias("pref"),
                    F.when(near, ratio).otherwise(R.LEAD_PREFIX_SCORE).alias("score")))


#: Character classes that are counted, and behind them all characters.
_CLASSES = (*"abcdefghijklmnopqrstuvwxyz ", "0123456789")


def character_counts(c: Column) -> Column:
    """How often each class of characters occurs in a text. Single characters are replaced, which searches bytes; translate looks up each character."""
    def without(chars: str) -> Column:
        return F.replace(c, F.lit(chars), F.lit("")) if len(chars) == 1 else F.translate(c, chars, "")

    counts = [F.length(c) - F.length(without(chars)) for chars in _CLASSES]
    return F.array(*counts, F.length(c))


def most_shared(a: Column, b: Column) -> Column:
    """An upper bound, from the counts of both, of the characters that two texts can have in matching blocks; characters of no class are one more. One sum
    without lambdas: it is compiled."""
    def total(columns: list[Column]) -> Column:
        return reduce(Column.__add__, columns)

    of_a, of_b = ([F.get(c, F.lit(i)) for i in range(len(_CLASSES) + 1)] for c in (a, b))
    shared = [F.least(x, y) for x, y in zip(of_a[:-1], of_b[:-1])]
    return total(shared) + F.least(*(own[-1] - total(own[:-1]) for own in (of_a, of_b)))


def comparable(keys: DataFrame, entries: DataFrame) -> DataFrame:
    """(doc_id, key, neg_len, ord, norm, pages): keys and the distinct entries whose ratio can reach the bound, by their lengths, then by their characters, with the
    pages that the key looks on. keys: with look, pages on which they look, or skip, pages on which they do not; both tables with the character counts of
    their texts.

    Keys meet runs of PAGE_RUN pages and not pages: a key has a row for each run, and an entry that comes again inside a run is compared once.
    """
    def band(c: str) -> Column:
        return F.floor(F.log(F.length(c).cast("double")) / math.log(1 / LENGTH_RATIO)).cast("int")

    run = F.floor(F.col("page") / PAGE_RUN).alias("run")
    left = (keys.join(entries.select("doc_id", run).distinct(), "doc_id")
            .withColumn("band", F.explode(F.array(band("key") - 1, band("key"), band("key") + 1))))
    right = (entries.groupBy("doc_id", run, "norm").agg(F.collect_set("page").alias("pages"), F.any_value("norm_counts").alias("norm_counts"))
             .withColumn("band", band("norm")))
    a, b = F.length("key"), F.length("norm")
    near = 2 * F.least(a, b) >= R.FUZZY_RATIO * (a + b)
    chosen = F.array_intersect("pages", "look") if "look" in keys.columns else F.array_except("pages", "skip")
    met = left.join(right, ["doc_id", "run", "band"]).filter((F.col("key") != F.col("norm")) & near)
    met = met.filter(2 * most_shared(F.col("key_counts"), F.col("norm_counts")) >= R.FUZZY_RATIO * (a + b))
    return met.select("doc_id", "key", "neg_len", "ord", "norm", chosen.alias("pages")).filter(F.size("pages") > 0)


def fuzzy_candidates(keys: DataFrame, entries: DataFrame) -> DataFrame:
    """keys: as comparable() takes them. Only its pairs reach the ratio, and entries of a page that are copies of each other are compared once."""
    scored = (comparable(keys, entries).withColumn("ratio", gestalt_ratio(F.col("key"), F.col("norm"), R.FUZZY_RATIO)).filter("ratio IS NOT NULL")
              .withColumn("page", F.explode("pages")))
    sure = F.col("ratio") > R.FUZZY_STOP_RATIO  # the search of a key stops at the first entry above this
    return scored.join(entries.select("doc_id", *ENTRY, "norm"), ["doc_id", "page", "norm"]).select("doc_id", "key", "neg_len", "ord", *ENTRY, F.lit(4).alias("tier"),
                         F.when(sure, -2.0).otherwise(-F.col("ratio")).alias("pref"), F.col("ratio").alias("score"))


def settled_now(candidates: DataFrame) -> DataFrame:
    """The keys whose best entry no key served before them can want, on the first page on which they can be served."""
    rank, place = F.struct("neg_len", "ord"), F.struct("tier", "pref", "block", "entry", "score")
    best = candidates.groupBy("doc_id", "page", "key").agg(F.min(place).alias("best"), F.min(rank).alias("rank"))
    first_page = candidates.groupBy("doc_id", "key").agg(F.min("page").alias("page"))
    first_taker = candidates.groupBy("doc_id", *ENTRY).agg(F.min(rank).alias("rank"))
    return (best.join(first_page, ["doc_id", "key", "page"], "left_semi")
            .select("doc_id", "key", "page", "best.block", "best.entry", "best.tier", "best.score", "rank")
            .join(first_taker, ["doc_id", *ENTRY, "rank"], "left_semi").select("doc_id", "key", *ENTRY, "tier", "score"))


def serve(candidates: DataFrame) -> DataFrame:
    """(doc_id, key, page, block, entry, tier, score) as if, page by page, the keys took their best free entry in serving order.

    What is settled at once is what that order would give; it goes with all candidates of its keys and entries, and what is left is the same
    problem again. Every round settles a key of each open document at least, so the rounds end; they are as many as the longest chain of keys that wait
    for each other, whatever the number of documents. Each round is written, so that a lost executor repeats no earlier one.
    """
    done = []
    while True:
        settled = materialise(settled_now(candidates), "align-settled")
        done.append(settled)
        candidates = materialise(candidates.join(settled, ["doc_id", "key"], "left_anti").join(settled, ["doc_id", *ENTRY], "left_anti"), "align-open")
        if candidates.isEmpty():
            return reduce(DataFrame.union, done)


def _best_reason(candidates: DataFrame) -> DataFrame:
    """One candidate for each key and entry: by its best tier."""
    return (candidates.groupBy("doc_id", "key", "neg_len", "ord", *ENTRY).agg(F.min(F.struct("tier", "pref", "score")).alias("p"))
            .select("doc_id", "key", "neg_len", "ord", *ENTRY, "p.tier", "p.pref", "p.score"))


def prefix_align(changes: DataFrame, entries: DataFrame) -> DataFrame:
    """The alignment by equal texts and prefixes alone: (doc_id, key, page, block, entry, tier, score)."""
    keys, items = align_keys(changes).drop("new_text"), align_entries(entries)
    return serve(materialise(_best_reason(exact_candidates(keys, items).unionByName(prefix_candidates(keys, items))), "align-candidates"))


def entry_align(changes: DataFrame, entries: DataFrame) -> DataFrame:
    """(doc_id, key, page, block, entry, tier, score): every key and every entry at most once."""
    items = materialise(align_entries(entries).withColumn("norm_counts", character_counts(F.col("norm"))), "align-entries")
    keys = materialise(align_keys(changes).drop("new_text").withColumn("key_counts", character_counts(F.col("key"))), "align-keys")
    exact, prefix = exact_candidates(keys, items), prefix_candidates(keys, items)
    with_exact = exact.groupBy("doc_id", "key").agg(F.collect_set("page").alias("skip"))
    looking = keys.join(with_exact, ["doc_id", "key"], "left").withColumn("skip", F.coalesce("skip", F.array().cast(with_exact.schema["skip"].dataType)))
    fuzzy = fuzzy_candidates(looking, items)
    first = materialise(exact.unionByName(prefix).unionByName(fuzzy), "align-first")
    # An equal entry is out of reach of its key only if a longer key without an equal entry may take it first. On pages
    # where that can happen every key needs its similar entries; elsewhere the keys with an equal entry do not.
    equal = first.filter("tier = 1")
    claims = equal.select("doc_id", *ENTRY, F.struct("neg_len", "ord").alias("claim"))
    rivals = first.filter("tier > 1").join(equal, ["doc_id", "page", "key"], "left_anti")
    contested = (rivals.join(claims, ["doc_id", *ENTRY]).filter(F.struct("neg_len", "ord") < F.col("claim"))
                 .select("doc_id", "page").distinct())
    displaced = fuzzy_candidates(
        equal.join(contested, ["doc_id", "page"], "left_semi").groupBy("doc_id", "key", "neg_len", "ord").agg(F.collect_set("page").alias("look"))
        .withColumn("key_counts", character_counts(F.col("key"))), items)
    return serve(materialise(_best_reason(first.unionByName(displaced)), "align-candidates"))


# --- I4 ---------------------------------------------------------------------------------------------------------------
def align_gate(changes: DataFrame, matches: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """Match rate and decision per document; documents of docs without any key count as fully matched."""
    keys = changes.select(F.col("resume_id").alias("doc_id"), F.col("norm").alias("key")).distinct()
    hit = matches.select("doc_id", "key").distinct().withColumn("hit", F.lit(1))
    rates = (keys.join(hit, ["doc_id", "key"], "left").groupBy("doc_id")
             .agg(F.count(F.lit(1)).alias("n_keys"), F.count("hit").alias("n_matched")))
    if docs is not None:
        rates = docs.select("doc_id").join(rates, "doc_id", "left").na.fill(0)
    rate = F.when(F.col("n_keys") == 0, 1.0).otherwise(F.col("n_matched") / F.greatest("n_keys", F.lit(1)))
    return (rates.withColumn("match_rate", rate)
            .withColumn("decision", F.when(F.col("match_rate") < R.MIN_MATCH_RATE, "regenerate").otherwise("in place")))


# --- I5 ---------------------------------------------------------------------------------------------------------------
def text_apply(units: DataFrame, changes: DataFrame) -> DataFrame:
    """Rewrite the lines that equal a change key, with or without bullet mark; a leading mark is kept.

    units: (doc_id, pos, text); changes: verify.registered_changes. The first matching change wins.
    """
    mark = F.regexp_extract("text", rf"(?U)^[{R.DOC_BULLET_CHARS}]\s*", 0)

    def bare(c: Column) -> Column:
        return strip(F.regexp_replace(c, rf"(?U)^[{R.DOC_BULLET_CHARS}]\s*", ""))

    # equal when the bare forms are equal, or when the whole texts are; the latter implies the former
    wanted = (changes.select(F.col("resume_id").alias("doc_id"), bare(F.col("key")).alias("bare"), "ord", "new_text")
              .groupBy("doc_id", "bare").agg(F.min_by("new_text", "ord").alias("new_text")))
    return (units.withColumn("bare", bare(strip(F.col("text")))).join(wanted, ["doc_id", "bare"], "left")
            .select("doc_id", "pos", F.coalesce(F.concat(mark, "new_text"), "text").alias("text"),
                    F.col("new_text").isNotNull().alias("changed")))


def rebuilt_text(units: DataFrame) -> DataFrame:
    """Full text per document from its lines."""
    return units.groupBy("doc_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda u: u["text"]), "\n").alias("text"),
        F.count(F.when(F.col("changed"), 1)).alias("n_changed"))


# --- I6 ---------------------------------------------------------------------------------------------------------------
def reading_order(blocks: DataFrame) -> DataFrame:
    """(doc_id, page, stream_pos, read_pos, moved, page_in_order) from (doc_id, page, stream_pos, y).

    Larger y is higher on the page. Blocks of equal height keep their stream order.
    """
    page = ["doc_id", "page"]
    stream = Window.partitionBy(*page).orderBy("stream_pos")
    reading = Window.partitionBy(*page).orderBy(F.desc("y"), "stream_pos")
    numbered = (blocks.withColumn("rises", F.coalesce(F.lag("y").over(stream) < F.col("y"), F.lit(False)))
                .withColumn("in_stream", F.row_number().over(stream)).withColumn("read_pos", F.row_number().over(reading)))
    return numbered.select(
        *page, "stream_pos", "read_pos", (F.col("in_stream") != F.col("read_pos")).alias("moved"),
        (~F.max("rises").over(Window.partitionBy(*page))).alias("page_in_order"))


# --- I7 ---------------------------------------------------------------------------------------------------------------
TOKEN = r"\{\{[A-Z_0-9]+\}\}"


def template_pieces(templates: DataFrame) -> DataFrame:
    """(resume_id, pos, piece, token): literal pieces and tokens of each resume's template in order.

    Cut up inside each row: one template shared by all resumes is no hot join key.
    """
    pieces = F.regexp_extract_all("template", F.lit(rf"({TOKEN}|(?s:.+?)(?={TOKEN}|\z))"), F.lit(1))
    piece = F.col("piece")
    return templates.select("resume_id", F.posexplode(pieces).alias("pos", "piece")).withColumn(
        "token", F.when(F.regexp_like(piece, F.lit(f"^{TOKEN}$")), F.regexp_replace(piece, r"[{}]", "")))


def template_merge(templates: DataFrame, placeholders: DataFrame) -> DataFrame:
    """(resume_id, text): each resume's template with its tokens filled; tokens without a value vanish.

    templates: (resume_id, template), placeholders: (resume_id, placeholder, value).
    """
    placed = template_pieces(templates).join(
        placeholders.withColumnRenamed("placeholder", "token"), ["resume_id", "token"], "left")
    text = F.when(F.col("token").isNull(), F.col("piece")).otherwise(F.coalesce("value", F.lit("")))
    return (placed.withColumn("text", text).groupBy("resume_id")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda p: p["text"]), "")
                 .alias("text")))


def unresolved_tokens(templates: DataFrame, placeholders: DataFrame) -> DataFrame:
    """(resume_id, token): tokens of a resume's template that have no placeholder row."""
    wanted = template_pieces(templates).filter("token IS NOT NULL").select("resume_id", "token").distinct()
    return wanted.join(placeholders.withColumnRenamed("placeholder", "token"), ["resume_id", "token"], "left_anti")


def unused_placeholders(templates: DataFrame, placeholders: DataFrame) -> DataFrame:
    """(resume_id, placeholder): placeholder rows of a resume with a template that none of its tokens takes.

    A template's tokens stay one array of its row, and the names of a resume become one set before they meet it: no task holds every name of all its
    resumes to tell them apart. Placeholders of resumes without a template have no row.
    """
    token = F.transform(F.regexp_extract_all("template", F.lit(f"({TOKEN})"), F.lit(1)), lambda t: F.regexp_replace(t, r"[{}]", ""))
    taken = templates.filter("template IS NOT NULL").groupBy("resume_id").agg(F.flatten(F.collect_set(token)).alias("taken"))
    named = placeholders.groupBy("resume_id").agg(F.collect_set("placeholder").alias("names"))
    return named.join(taken, "resume_id").select("resume_id", F.explode(F.array_except("names", "taken")).alias("placeholder"))
