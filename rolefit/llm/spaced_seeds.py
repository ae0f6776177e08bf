"""Benchmark decontamination by spaced-seed hashing.

The rule: a document holds an item if, on one diagonal (document place less item place), some WINDOW adjacent tokens of the item, or the
whole item if it is shorter, stand there with at least SHARE of them equal, whatever stands at the other places. n_equal is the number of equal
tokens in the best such window.

A mask selects some of the adjacent tokens and ignores the others, so that a hit survives substitutions at ignored places. The masked tokens of
every position of every document and of every item are hashed, and the hashes joined. The fixed masks of FAMILIES are chosen, by enumeration of
all patterns of substitutions that the rule accepts, so that every accepted window has a hit of one of them (the tests enumerate them again); so nothing that the
rule accepts is lost, and items of any length have seeds. The tokens around a hit are then compared one to one along the diagonal. Tokens are compared by
64-bit hashes. In a run of hits of one mask on one diagonal, the first and then every WINDOW-th is verified; the places around it reach all windows of the run.

DataFrame functions only: tokens, hashes, join and verification stay in the JVM. Benchmark seeds are a stated query set: they are written once and
broadcast in blocks of BROADCAST_SEEDS, each with the hashes of the REGION tokens around it at most, so a block is bounded whatever
the items are; every block meets all documents. Documents are never shuffled; only what was found is, by its keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolefit.llm.common import checkpointed

#: Adjacent tokens of an item that are judged together, and the share of them that must be equal, in tenths.
WINDOW, SHARE = 15, 8
#: Masks by the item lengths that they serve: least and greatest length, places that each mask selects. Of 15 places 3 may differ, of 10
#: to 14 places 2, of 5 to 9 places 1, of fewer none.
FAMILIES = (
    (15, None, ((0, 1, 2, 3, 5, 6), (0, 1, 4, 8, 9, 10), (0, 1, 3, 5, 6, 10))),
    (10, 14, ((0, 1, 2, 4, 5), (0, 1, 3, 6, 7), (0, 1, 2, 3, 4))),
    (5, 9, ((0, 1, 2, 3), (0, 1, 2, 4), (0, 1, 3, 4), (0, 2, 3, 4))),
    (4, 4, ((0, 1, 2, 3),)),
    (3, 3, ((0, 1, 2),)),
    (2, 2, ((0, 1),)),
    (1, 1, ((0,),)),
)
#: All masks, each with the least and the greatest length that it serves.
MASKS = tuple((mask, low, high) for low, high, masks in FAMILIES for mask in masks)
#: Places around a verified hit: a window before it and two from it on; as bits they fit in a long.
REGION = 3 * WINDOW
#: Seeds in a block that is broadcast, some 400 bytes each at most.
BROADCAST_SEEDS = 200_000

#: Letters of ASCII are named first because they are tested first.
TOKEN_BREAK = r"[^a-z0-9\p{L}\p{N}\p{M}]+"
#: Scripts written without blanks: each of their characters is a token. All lie beyond FIRST_UNBROKEN, which is a cheaper test.
FIRST_UNBROKEN = r"[\x{E00}-\x{10FFFF}]"
SCRIPTS = ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar")


def tokens(text: Column) -> Column:
    """Runs of letters, digits and marks in lower case, and single characters of SCRIPTS; a null text has none."""
    unbroken = "([" + "".join(rf"\p{{Is{script}}}" for script in SCRIPTS) + "])"
    text = F.lower(F.coalesce(text, F.lit("")))
    parted = F.when(text.rlike(FIRST_UNBROKEN), F.regexp_replace(text, unbroken, " $1 ")).otherwise(text)
    return F.array_remove(F.split(parted, TOKEN_BREAK), "")


def need(n: Column) -> Column:
    """Equal tokens that make a leak of an item of n tokens: SHARE tenths of its window, rounded up."""
    return F.floor((F.least(n, F.lit(WINDOW)) * SHARE + 9) / 10).cast("int")


def seed(words: str, at: str, mask: int) -> Column:
    """Hash of the selected tokens from a place on; where the text ends before the mask does it may hit by chance, and is verified."""
    return F.xxhash64(F.lit(mask), *(F.get(words, F.col(at) + place) for place in MASKS[mask][0]))


def seed_rows(items: DataFrame, item_key: str, text: str) -> DataFrame:
    """One row per mask and place of each different item: the seed, the item's length, the hashes of the tokens around, with the number of those
    before the place, and whether it is a WINDOW-th place. Places of an item with the same surroundings are one row."""
    rows = items.select(F.col(item_key).alias("_item"), tokens(F.col(text)).alias("_item_words")).where(F.size("_item_words") > 0).distinct()
    n, j = F.size("_item_words"), F.col("_j")
    placed = rows.select("_item", "_item_words", n.alias("_n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("_j"))
    serves = [F.col("_n").between(low, high) if high else F.col("_n") >= low for _, low, high in MASKS]
    every = F.array(*(F.when(serves[k] & (j + mask[-1] < F.col("_n")), F.struct(F.lit(k).alias("_mask"), seed("_item_words", "_j", k).alias("_seed")))
                      for k, (mask, _, _) in enumerate(MASKS)))
    seeds = placed.select("_item", "_item_words", "_n", "_j", F.explode(every).alias("_hit")).where("_hit is not null")
    back = F.least(j, F.lit(WINDOW))
    # a generated column cuts the surroundings out before any row is copied with all tokens of its item
    cut = F.inline(F.array(F.struct(back.alias("_back"), F.slice("_item_words", j - back + 1, back + 2 * WINDOW).alias("_near"))))
    around = F.transform("_near", lambda word: F.xxhash64(word))
    return (seeds.select("_item", "_n", (j % WINDOW == 0).alias("_always"), "_hit.*", cut)
            .select("_item", "_n", "_always", "_mask", "_seed", "_back", around.alias("_around"))
            .groupBy("_item", "_n", "_mask", "_seed", "_back", "_around").agg(F.max("_always").alias("_always")))


def starts_run(masks: list[int]) -> Column:
    """Whether a hit is to be verified: the one before it on the diagonal is no hit of the same mask, or it is a WINDOW-th place of the item."""
    def before(mask: int) -> Column:
        same = (F.coalesce(F.xxhash64(F.get("_words", F.col("_i") + (place - 1))) == F.get("_around", F.col("_back") + (place - 1)), F.lit(False))
                for place in MASKS[mask][0])
        return reduce(Column.__and__, same) & (F.col("_i") > 0) & (F.col("_back") > 0)

    hit = F.lit(False)
    for mask in masks:
        hit = F.when(F.col("_mask") == mask, before(mask)).otherwise(hit)
    return F.col("_always") | ~hit


def equal_bits() -> Column:
    """The places around a hit as bits, set where the tokens are equal."""
    same = F.zip_with("_near", "_item_near", lambda word, other: F.coalesce(F.xxhash64(word) == other, F.lit(False)).cast("long"))
    return F.aggregate(same, F.lit(0).cast("long"), lambda bits, bit: bits * 2 + bit)


def best_window() -> Column:
    """The most bits that are set in WINDOW adjacent ones; in a lambda, so that the bits are worked out once."""
    def count(bits: Column) -> Column:
        return F.greatest(*(F.bit_count(F.shiftright(bits, s).bitwiseAND((1 << WINDOW) - 1)) for s in range(REGION - WINDOW + 1)))

    return F.element_at(F.transform(F.array(equal_bits()), count), 1)


def find_leaks(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text",
               broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """doc_key, item_key, n_equal and item_tokens: the items that a document holds, with the equal tokens of the best window.

    Null texts and texts without tokens, on either side, have no rows; a document without leaks has no row. Rows of one key, the null key
    too, are taken together. An item of one token is held by every document with that token. Other columns of either table are not read.
    """
    seeds = checkpointed(seed_rows(items, item_key, text))
    number, masks = seeds.agg(F.count(F.lit(1)), F.sort_array(F.collect_set("_mask"))).first()
    doc_rows = docs.select(F.col(doc_key).alias("_doc"), tokens(F.col(text)).alias("_words"))
    every = F.when(F.size("_words") > 0, F.sequence(F.lit(0), F.size("_words") - 1))
    places = doc_rows.select("_doc", "_words", F.explode(every).alias("_i"))
    doc_seeds = places.select("_doc", "_words", "_i", F.explode(F.array(*(seed("_words", "_i", k) for k in masks or [0]))).alias("_seed"))
    blocks = max(1, -(-number // max(1, broadcast_seeds)))
    found = [_verified(doc_seeds, seeds.where(F.pmod(F.xxhash64("_item", "_mask", "_back", "_around"), F.lit(blocks)) == block), masks) for block in range(blocks)]
    if blocks > 1:  # a written table for each block keeps the plan short
        found = [checkpointed(rows) for rows in found]
    return (reduce(DataFrame.unionAll, found).groupBy("_doc", "_item")
            .agg(F.max(F.struct("n_equal", "_n")).alias("_best"))
            .select(F.col("_doc").alias(doc_key), F.col("_item").alias(item_key), F.col("_best.n_equal").cast("long").alias("n_equal"),
                    F.col("_best._n").cast("long").alias("item_tokens")))


def _verified(doc_seeds: DataFrame, block: DataFrame, masks: list[int]) -> DataFrame:
    """_doc, _item, _n and n_equal of the hits with the seeds of a block that the rule accepts, one row for each pair of keys and length."""
    hits = doc_seeds.join(F.broadcast(block), "_seed").where(starts_run(masks))
    front = F.least(F.col("_i"), F.col("_back"))
    # a generated column keeps the comparison, which cannot be compiled, out of the stage of the join, and whole texts out of the rows
    near = F.struct(F.slice("_words", F.col("_i") - front + 1, front + 2 * WINDOW).alias("_near"),
                    F.slice("_around", F.col("_back") - front + 1, F.lit(REGION)).alias("_item_near"))
    return (hits.select("_doc", "_item", "_n", F.inline(F.array(near))).select("_doc", "_item", "_n", best_window().alias("n_equal"))
            .where(F.col("n_equal") >= need(F.col("_n")))
            .groupBy("_doc", "_item", "_n").agg(F.max("n_equal").alias("n_equal")))


def oracle_sql(docs: str = "documents", items: str = "benchmark") -> str:
    """DuckDB SQL for the rule itself, without masks: all equal tokens of a document and an item by diagonal."""
    unbroken = "([" + "".join(rf"\p{{{script}}}" for script in SCRIPTS) + "])"

    def words(table: str, key: str) -> str:
        parted = rf"regexp_replace(lower(coalesce(text, '')), '{unbroken}', ' \1 ', 'g')"
        return f"SELECT {key}, row_number() OVER () AS r, list_filter(string_split_regex({parted}, '{TOKEN_BREAK}'), lambda x: x <> '') AS w FROM {table}"

    return f"""
WITH d AS ({words(docs, "doc_id")}), b AS ({words(items, "item_id")}),
dp AS (SELECT r, unnest(w) AS t, unnest(range(len(w))) AS i FROM d),
bp AS (SELECT r AS s, len(w) AS n, unnest(w) AS t, unnest(range(len(w))) AS j FROM b),
equal AS (SELECT r, s, n, j, i - j AS diagonal FROM dp JOIN bp USING (t)),
many AS (SELECT r, s, diagonal FROM equal GROUP BY r, s, diagonal, n HAVING count(*) * 10 >= least(n, {WINDOW}) * {SHARE}),
windows AS (SELECT r, s, n, count(*) OVER (PARTITION BY r, s, diagonal ORDER BY j RANGE BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS c
    FROM equal SEMI JOIN many USING (r, s, diagonal)),
found AS (SELECT r, s, n, max(c) AS c FROM windows GROUP BY r, s, n HAVING max(c) * 10 >= least(n, {WINDOW}) * {SHARE})
SELECT doc_id, item_id, CAST(max({{'c': c, 'n': n}}).c AS BIGINT) AS n_equal, CAST(max({{'c': c, 'n': n}}).n AS BIGINT) AS item_tokens
FROM found JOIN d USING (r) JOIN b ON b.r = s GROUP BY doc_id, item_id"""
