"""Which keywords the texts of a corpus hold: found per distinct token, not per text or pair.

A keyword is held in one of two ways (section C):
* In an inflected form. A word w and a token t are forms of each other exactly when a stem of w equals t minus one ending.
* Literally. A keyword of letters and digits alone can only lie inside one token, and one without any of them only inside one of the runs between tokens.
  Any other keyword has a longest word, which must lie inside a token; where it does, the keyword is looked for in the text, once per resume.

dictionary() evaluates this once for each distinct unit (token or run) of the corpus: stems meet stems, and for the literal leg everything to look for is
filed under the trigram that the fewest units have, which the trigrams of the units meet before they are compared. The dictionary is written, so that its size decides how it
meets the units of the resumes.

text_index() gathers per resume what its units stand for. Its arrays are bounded by the units of the resume's own text.

Up to ROW_KEYWORDS keywords need none of that: row_index() cuts the tokens of a text into their parts and stems and meets them with the keywords inside the row
of the text, so that nothing is shuffled. index_of() chooses.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolefit import refdata as R
from rolefit.functions.text import tokens
from rolefit.sources.corpus import materialise

_OTHER = "[^a-z0-9]"
#: Keywords, and characters of all of them, that are tested inside the row of a text; keywords among them that are looked for in the whole text, and lengths of
#: the others. With more of any the dictionary is written.
ROW_KEYWORDS, ROW_CHARS, ROW_SOUGHT, ROW_LENGTHS = 20_000, 1_000_000, 100, 100
#: A longer token is searched for each keyword and not cut into parts.
LONG_TOKEN = 256


def keyword_words(keyword: Column) -> Column:
    return F.filter(F.split(keyword, f"{_OTHER}+"), lambda w: w != "")


def long_words(keyword: Column) -> Column:
    return F.array_distinct(F.filter(keyword_words(keyword), lambda w: F.length(w) >= R.MIN_WORD_CHARS))


def word_stems(word: Column) -> Column:
    """The word itself and, for each suffix it carries over a root of three letters or more, root and root + e."""
    stems = [word]
    for suffix in R.STRIPPED_SUFFIXES:
        fits = F.endswith(word, F.lit(suffix)) & (F.length(word) >= len(suffix) + R.MIN_WORD_CHARS)
        root = F.when(fits, F.substring(word, F.lit(1), F.length(word) - len(suffix)))
        stems += [root, F.concat(root, F.lit("e"))]
    return F.array_distinct(F.array_compact(F.array(*stems)))


def token_stems(token: Column) -> Column:
    """Everything the token could be an inflected form of: itself and itself minus one ending; null where none fits.

    No two of them are equal. Nulls are left in: filtering exploded rows stays inside generated code.
    """
    parts = [token]
    for ending in R.WORD_ENDINGS:
        fits = F.endswith(token, F.lit(ending)) & (F.length(token) >= len(ending) + R.MIN_WORD_CHARS)
        parts.append(F.when(fits, F.substring(token, F.lit(1), F.length(token) - len(ending))))
    return F.array(*parts)


def needles(keywords: DataFrame) -> DataFrame:
    """(keyword, needle, exact): what a unit must contain; if not exact, the text must be searched besides. The empty keyword has no row."""
    letters, others = F.regexp_like("keyword", F.lit("[a-z0-9]")), F.regexp_like("keyword", F.lit(_OTHER))
    longest = F.get(F.sort_array(F.transform(keyword_words(F.col("keyword")), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))), asc=False), F.lit(0))
    mixed = letters & others
    return keywords.select("keyword").where("keyword <> ''").distinct().select(
        "keyword", F.when(mixed, longest["w"]).otherwise(F.col("keyword")).alias("needle"), (~mixed).alias("exact"))


def _pieces(text: Column, n: int) -> Column:
    """Distinct pieces of n characters."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=({'.' * n}))"), F.lit(1)))


def held(units: DataFrame, wanted: DataFrame) -> DataFrame:
    """(unit, keyword, exact): the needles inside each unit. A needle is filed under the trigram that the fewest units have; one of one or two characters
    is its own piece."""
    grams = units.select("unit", F.explode(_pieces(F.col("unit"), 3)).alias("gram"))
    counts = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    filed = (wanted.where(F.length("needle") > 2).select("*", F.explode(_pieces(F.col("needle"), 3)).alias("gram")).join(counts, "gram")
             .groupBy(*wanted.columns).agg(F.min_by("gram", F.struct("n", "gram")).alias("gram")))
    found = grams.join(filed, "gram").where(F.contains("unit", "needle")).select("unit", "keyword", "exact")
    for n in (1, 2):
        short = wanted.where(F.length("needle") == n)
        if not short.isEmpty():
            pieces = units.select("unit", F.explode(_pieces(F.col("unit"), n)).alias("needle"))
            found = found.unionByName(pieces.join(short, "needle").select("unit", "keyword", "exact"))
    return found


def stems_of(keywords: DataFrame) -> DataFrame:
    """(word): the distinct stems of the long words of keywords."""
    words = keywords.select(F.explode(long_words(F.col("keyword"))).alias("word")).distinct()
    return words.select(F.explode(word_stems(F.col("word"))).alias("word")).distinct()


def dictionary(units: DataFrame, keywords: DataFrame, forms: bool = True) -> DataFrame:
    """(unit, words, literals, sought): the stems of keyword words that the unit is a form of, the keywords inside it, and those to look for in texts that have
    it. Units that stand for nothing have no row. units: (unit), distinct; keywords: (keyword), lower-case."""
    none = F.lit(None).cast("string")
    found = held(units, needles(keywords)).select(
        "unit", none.alias("word"), F.when(F.col("exact"), F.col("keyword")).alias("literal"), F.when(~F.col("exact"), F.col("keyword")).alias("sought"))
    if forms:
        stems = units.select("unit", F.explode(token_stems(F.col("unit"))).alias("word")).where("word IS NOT NULL")
        found = found.unionByName(stems.join(stems_of(keywords), "word").select("unit", "word", none.alias("literal"), none.alias("sought")))
    return found.groupBy("unit").agg(F.collect_set("word").alias("words"), F.collect_set("literal").alias("literals"),
                                     F.collect_set("sought").alias("sought"))


def runs_between(text: Column) -> Column:
    """Distinct runs of characters that are in no token."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"({_OTHER}+)"), F.lit(1)))


def written_dictionary(texts: DataFrame, keywords: DataFrame, forms: bool = True) -> DataFrame:
    """The dictionary of the tokens, and of the runs between them if a keyword can lie there, of a table with one column of lower-case texts, as a
    written table."""
    text = F.col(texts.columns[0])
    marks = not keywords.where((F.col("keyword") != "") & ~F.regexp_like("keyword", F.lit("[a-z0-9]"))).isEmpty()
    units = texts.select(F.explode(F.concat(tokens(text), runs_between(text)) if marks else tokens(text)).alias("unit")).where("unit <> ''")
    return materialise(dictionary(materialise(units.distinct(), "units"), keywords, forms), "dictionary")


def coded_dictionary(known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((code, words, literals, sought), (unit, code)) of a dictionary, both written. Many units stand for the same, so the lists are as many as the keywords
    give occasion for, while the units grow with the corpus."""
    lists = ("words", "literals", "sought")
    ordered = known.select("unit", *[F.sort_array(c).alias(c) for c in lists])
    meanings = materialise(ordered.select(*lists).distinct().withColumn("code", F.monotonically_increasing_id()), "meanings")
    return meanings, materialise(ordered.join(meanings, list(lists)).select("unit", "code"), "coded-units")


def text_index(texts: DataFrame, known: DataFrame, scopes: tuple[str, ...], reordered: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of texts: resume_id and per scope words_<scope> (stems of the keyword words that it has in any form) and literals_<scope>.

    texts has resume_id and a lower-case text_<scope> for each scope; the first one holds the words of all others. Scopes in reordered have the tokens of the
    first scope in another order and get literals only; a keyword without letters and digits counts there as it does in the first scope. known is a
    dictionary over the first scope.
    """
    marks = not known.where(~F.regexp_like("unit", F.lit("[a-z0-9]"))).isEmpty()
    mixed = not known.where(F.size("sought") > 0).isEmpty()

    def listed(number: int, scope: str) -> Column:
        text = F.col(f"text_{scope}")
        units = F.concat(tokens(text), runs_between(text)) if marks else tokens(text)
        return F.transform(units, lambda u: F.struct(F.lit(number).alias("scope"), u.alias("unit")))

    rows = (texts.select("resume_id", F.explode(F.concat(*[listed(i, s) for i, s in enumerate(scopes)])).alias("u"))
            .select("resume_id", "u.scope", "u.unit").where("unit <> ''"))

    # a resume meets the units as numbers of what they stand for, each once per scope; the lists themselves come to the resume's own numbers
    meanings, coded = coded_dictionary(known)
    numbers = rows.join(coded, "unit").groupBy("resume_id").agg(F.collect_set(F.col("code") * len(scopes) + F.col("scope")).alias("codes"))
    each = numbers.select("resume_id", F.explode("codes").alias("c")).select(
        "resume_id", F.expr(f"c div {len(scopes)}").alias("code"), (F.col("c") % len(scopes)).alias("scope"))
    # what several units of a resume stand for counts once before anything is collected
    def labelled(kind: str) -> Column:
        return F.transform(kind, lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("keyword")))

    entries = F.concat(*[labelled(kind) for kind in ("words", "literals", "sought")])
    listed_once = each.join(meanings, "code").select("resume_id", "scope", F.explode(entries).alias("e")).select(
        "resume_id", "scope", "e.kind", "e.keyword").distinct()

    def gathered(number: int, kind: str) -> Column:
        return F.collect_list(F.when((F.col("scope") == number) & (F.col("kind") == kind), F.col("keyword")))

    per_resume = listed_once.groupBy("resume_id").agg(
        *[gathered(i, c).alias(f"{c}_{s}") for i, s in enumerate(scopes) for c in ("words", "literals")],
        *([gathered(0, "sought").alias("sought")] if mixed else ()))
    base = texts.select("resume_id", *([f"text_{s}" for s in (*scopes, *reordered)] if mixed else ()))
    none = F.array().cast("array<string>")

    def value(column: str) -> Column:
        return F.coalesce(F.col(column), none)

    def literals(scope: str, column: str) -> Column:
        if not mixed:
            return value(column)
        return F.array_union(value(column), F.filter(value("sought"), lambda k: F.contains(F.col(f"text_{scope}"), k)))

    return base.join(per_resume, "resume_id", "left").select(
        "resume_id", *[value(f"words_{s}").alias(f"words_{s}") for s in scopes],
        *[literals(s, f"literals_{s}").alias(f"literals_{s}") for s in scopes],
        *[literals(s, f"literals_{scopes[0]}").alias(f"literals_{s}") for s in reordered])


def _parts(units: Column, lengths: list[int]) -> Column:
    """All parts of those lengths of all units."""
    def cut(unit: Column) -> Column:
        n = F.length(unit)
        fits = F.filter(F.array(*[F.lit(x) for x in lengths]), lambda x: x <= n)
        return F.flatten(F.transform(fits, lambda x: F.transform(F.sequence(F.lit(1), n - x + 1), lambda i: F.substring(unit, i, x))))

    return F.flatten(F.transform(units, cut))


def row_index(texts: DataFrame, scopes: tuple[str, ...], reordered: tuple[str, ...] = (), *, exact: list[str], sought: list[str], stems: list[str]) -> DataFrame:
    """The same as text_index of a few keywords, each row from itself alone. exact: keywords of letters and digits, sought: all others, stems: stems_of all."""
    none = F.array().cast("array<string>")

    def listed(terms: list[str]) -> Column:
        return F.split(F.lit(" ".join(terms)), " ") if terms else none

    def text(scope: str) -> Column:
        return F.coalesce(f"text_{scope}", F.lit(""))

    lengths = sorted({len(k) for k in exact})
    rows = texts.select("resume_id", *[f"text_{s}" for s in (*scopes, *reordered)],
                        *[F.filter(tokens(text(s)), lambda t: t != "").alias(f"units_{s}") for s in scopes])
    first, known = scopes[0], listed(exact)
    rows = rows.withColumn("long", F.filter(f"units_{first}", lambda t: F.length(t) > LONG_TOKEN))
    short, long = F.filter(f"units_{first}", lambda t: F.length(t) <= LONG_TOKEN), F.col("long")
    have = F.array_intersect(known, _parts(short, lengths)) if lengths else none
    inside = F.filter(known, lambda k: F.exists(long, lambda t: F.contains(t, k)))

    def contained(scope: str) -> Callable[[Column], Column]:
        return lambda k: F.contains(text(scope), k)

    def words(scope: str, of: Column) -> Column:
        return F.array_intersect(of, F.flatten(F.transform(f"units_{scope}", token_stems))) if stems else none

    rows = rows.withColumns({f"words_{first}": words(first, listed(stems)), f"exact_{first}": F.when(F.size(long) > 0, F.array_union(have, inside)).otherwise(have)})
    # the first scope holds the words of all others, so that these are asked for what it has and not for all keywords
    rows = rows.withColumns({f"words_{s}": words(s, F.col(f"words_{first}")) for s in scopes[1:]} | {
        f"exact_{s}": F.filter(f"exact_{first}", contained(s)) for s in scopes[1:]})

    def literals(scope: str, own: str) -> Column:
        """own: the scope that has the tokens, and the runs between them that count."""
        if not sought:
            return F.col(f"exact_{own}")
        marks, mixed = ([F.lit(k) for k in sought if bool(re.search("[a-z0-9]", k)) == m] for m in (False, True))
        found = [F.filter(F.array(*keys), lambda k: F.contains(text(where), k)) for keys, where in ((marks, own), (mixed, scope)) if keys]
        return F.concat(F.col(f"exact_{own}"), *found)

    return rows.select("resume_id", *[f"words_{s}" for s in scopes], *[literals(s, s).alias(f"literals_{s}") for s in scopes],
                       *[literals(s, scopes[0]).alias(f"literals_{s}") for s in reordered])


def index_of(texts: list[DataFrame], keywords: DataFrame, forms: bool = True) -> Callable[..., DataFrame]:
    """text_index (of tables, scopes and reordered scopes) or row_index, whichever the number of keywords asks for. texts: the first scope of each table that
    will be indexed, in one column."""
    own = keywords.select("keyword").where("keyword <> ''").distinct()
    terms = sorted(r.keyword for r in own.limit(ROW_KEYWORDS + 1).collect())
    sought = [k for k in terms if re.search(_OTHER, k)]
    exact = [k for k in terms if not re.search(_OTHER, k)]
    if len(terms) > ROW_KEYWORDS or sum(map(len, terms)) > ROW_CHARS or len(sought) > ROW_SOUGHT or len({len(k) for k in exact}) > ROW_LENGTHS:
        known = written_dictionary(reduce(DataFrame.unionByName, texts), keywords, forms)
        return lambda table, scopes, reordered=(): text_index(table, known, scopes, reordered)
    stems = sorted(r.word for r in stems_of(own).collect()) if forms else []
    return partial(row_index, exact=exact, sought=sought, stems=stems)


def coded(index: DataFrame) -> DataFrame:
    """An index with the numbers of its stems and keywords (number()) in place of their letters, as pairs meet it."""
    return index.select("resume_id", *[F.transform(c, number).alias(c) for c in index.columns if c != "resume_id"])


def number(word: Column) -> Column:
    """64 bits that stand for a stem or keyword; told_apart() sees to it that no two of them share theirs."""
    return F.xxhash64(word)


def told_apart(keywords: DataFrame) -> None:
    """An error if two stems or two keywords of a corpus have one number."""
    for words in (keywords.select(F.col("keyword").alias("word")), stems_of(keywords)):
        counts = words.agg(F.count_distinct("word").alias("words"), F.count_distinct(number(F.col("word"))).alias("numbers")).first()
        if counts.words != counts.numbers:
            raise ValueError("two keywords have the same 64-bit number")
