"""N-gram Jaccard join: all pairs of documents whose word-shingle sets have a Jaccard similarity of 0.75 or more, as connected components.

The result is exact. The plan:
1. One pass turns every text into its set of shingle hashes and writes per document the size, a digest of the set, a bitmap of parities
   (2 to 4 bits per shingle) and the prefix of the set: the first n - ceil(0.75 n) + 1 shingles in one order that holds for all
   documents. Two sets that link share a shingle of both prefixes. The order is by hash, with shingles that a sample of the documents
   shows to be frequent at the end: a passage that very many documents share is in the prefix of few. The sample steers the work only;
   any order gives the same result.
2. Documents of equal sets become one by their digest.
3. Prefix rows meet by shingle. Within each shingle only a star is proposed: the smallest member with every other. A frequent shingle is
   salted into stars whose centres form a star again. Pairs are tested by the bitmaps first (the bits in which two bitmaps differ are at most the
   shingles in which the sets differ, which bounds the overlap from above) and then by intersecting the sorted arrays, in tiles: a centre with
   some of its partners. Links give first components.
4. What the stars leave: members of one shingle in different components. They have the centre of that shingle in common, so all members of a centre's
   stars are cut into tiles and sorted by size; in a tile only sizes within 3:4 are compared, all of them, by bitmap. Pairs that pass are
   intersected exactly and their links join the components.
No pair inside a component is proposed in step 4, so a group of thousands of near copies does not grow into its square.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolefit.llm.common import checkpointed, text_slices, written
from rolefit.llm.components import components
from rolefit.llm.shingles import shingle_set

#: Share of the documents whose shingles are counted to find frequent ones, how often one has to occur there, and how many are kept at most.
SAMPLE, FREQUENT, MAX_FREQUENT = 1 / 32, 3, 1_000_000
#: Stars that a frequent shingle is dealt into; partners in a tile of step 3; members in a tile side of step 4.
SALTS, PARTNERS, MEMBERS = 64, 256, 1_024
#: Rows (document, tile) that are broadcast at most to fetch the arrays of candidates; beyond that they are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def prefix_size(n: int) -> int:
    return n - (3 * n + 3) // 4 + 1 if n else 0


def parity_bitmap(shingles: np.ndarray) -> bytes:
    """A power of two of bits, at least twice the size of the set; a bit is the parity of the shingles that fall on it."""
    width = max(64, 1 << int(2 * len(shingles) - 1).bit_length())
    return np.packbits(np.bincount((shingles & np.uint64(width - 1)).astype(np.int64), minlength=width).astype(np.uint8) & 1, bitorder="little").tobytes()


def folded(bitmap: np.ndarray, words: int) -> np.ndarray:
    """A bitmap as one of fewer 64-bit words."""
    while bitmap.shape[-1] > words:
        half = bitmap.shape[-1] // 2
        bitmap = bitmap[..., :half] ^ bitmap[..., half:]
    return bitmap


def may_link(n: int, bitmap: bytes, m: int, other: bytes) -> bool:
    if 4 * min(n, m) < 3 * max(n, m):
        return False
    x, y = np.frombuffer(bitmap, np.uint64), np.frombuffer(other, np.uint64)
    words = min(len(x), len(y))
    return 7 * int(np.bitwise_count(folded(x, words) ^ folded(y, words)).sum()) <= n + m


def links(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two ascending arrays of distinct values have a Jaccard similarity of 0.75 or more."""
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum()) if len(a) and len(b) else 0
    return both > 0 and 100 * both >= 75 * (len(a) + len(b) - both)


def frequent_shingles(docs: DataFrame) -> np.ndarray:
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in text_slices(batches, "text"):
            values, counts = np.unique(np.concatenate([shingle_set(t) for t in texts]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts)], ["s", "n"])

    counted = docs.sample(SAMPLE, seed=11).select("text").mapInArrow(step, "s long, n long").groupBy("s").agg(F.sum("n").alias("n"))
    top = counted.where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "s").limit(MAX_FREQUENT).select("s").toArrow()
    return np.sort(top.column(0).to_numpy().view(np.uint64))


SET_SCHEMA = "id long, n long, digest binary, bitmap binary, head array<bigint>, tail array<bigint>"


def set_table(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(id, n, digest, bitmap, head, tail) for each row of (id, text): head and tail are the prefix, the tail of frequent shingles. Of equal
    sets that one task meets only the first has a bitmap and a prefix; the others are found by their digest."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)
    long_list = pa.list_(pa.int64())

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = shared.value, set()
        for part, texts in text_slices(batches, "text"):
            sizes, digests, bitmaps, heads, tails = [], [], [], [], []
            for text in texts:
                s = shingle_set(text)
                digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None
                head = tail = np.zeros(0, np.uint64)
                bitmap = None
                if len(s) and digest not in seen:
                    seen.add(digest)
                    bitmap = parity_bitmap(s)
                    keep = prefix_size(len(s))
                    late = np.zeros(len(s), bool)
                    if len(last):
                        late = last[np.minimum(np.searchsorted(last, s), len(last) - 1)] == s
                    head = s[~late][:keep]
                    tail = s[late][:keep - len(head)]
                sizes.append(len(s))
                digests.append(digest)
                bitmaps.append(bitmap)
                heads.append(head.view(np.int64))
                tails.append(tail.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(bitmaps, pa.binary()),
                 pa.array(heads, long_list), pa.array(tails, long_list)], ["id", "n", "digest", "bitmap", "head", "tail"])

    return docs.mapInArrow(step, SET_SCHEMA)


def shared_prefixes(sets: DataFrame) -> DataFrame:
    """(shingle, centre, id, wide): the stars of prefix shingles that several sets have, centre being the smallest member.

    Of a usual shingle the name is null, so that the stars of one centre fall together; wide marks members of a star of three or more. Of a
    frequent one, which is dealt into SALTS stars, the name stays, and stars of one member are there too.
    """
    rows = sets.select("id", F.explode("head").alias("shingle")).select("shingle", F.lit(-1).alias("salt"), "id").union(
        sets.select("id", F.explode("tail").alias("shingle")).select(
            "shingle", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"), "id"))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, count, last = None, 0, 0, 0  # of the star that the last row belongs to: its first id, rows so far, last id
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            s, salt, ids = (np.asarray(batch.column(i)) for i in range(3))
            same = np.r_[(s[0], salt[0]) == key, (s[1:] == s[:-1]) & (salt[1:] == salt[:-1])]
            at = np.arange(n)
            begin = np.maximum.accumulate(np.where(same, -1, at))  # -1 where the star began in an earlier batch
            centre = np.where(begin < 0, first, ids[begin])
            place = np.where(begin < 0, count + at, at - begin)
            before = np.r_[last, ids[:-1]]
            key, first, count, last = (s[-1], salt[-1]), centre[-1], int(place[-1]) + 1, ids[-1]
            usual, pairs, third = salt < 0, place >= 1, place == 2
            chosen = usual & pairs
            salted = ~usual
            shingle = pa.concat_arrays([pa.nulls(int(chosen.sum() + (usual & third).sum()), pa.int64()), pa.array(s[salted], pa.int64())])
            yield pa.RecordBatch.from_arrays(
                [shingle, pa.array(np.r_[centre[chosen], centre[usual & third], centre[salted]], pa.int64()),
                 pa.array(np.r_[ids[chosen], before[usual & third], ids[salted]], pa.int64()),
                 pa.array(np.r_[place[chosen] >= 2, np.ones(int((usual & third).sum() + salted.sum()), bool)], pa.bool_())],
                ["shingle", "centre", "id", "wide"])

    stars = rows.repartition("shingle", "salt").sortWithinPartitions("shingle", "salt", "id").mapInArrow(
        step, "shingle long, centre long, id long, wide boolean")
    return stars.groupBy("shingle", "centre", "id").agg(F.max("wide").alias("wide"))


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Of the pairs (a, b) those whose sets link, by intersecting sorted arrays in tiles of one a and up to about PARTNERS of its b."""
    spark = pairs.sparkSession
    sizes = pairs.groupBy("a").count().select("a", F.ceil(F.col("count") / PARTNERS).cast("int").alias("tiles"))
    tiled = pairs.join(sizes, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("tiles")).cast("int").alias("tile"))
    needs = checkpointed(tiled.select(F.col("b").alias("need"), "a", "tile", F.lit(1).alias("role")).union(
        tiled.select(F.col("a").alias("need"), "a", "tile", F.lit(0).alias("role")).distinct()))
    small = needs.count() <= BROADCAST_ROWS
    wanted = needs.select("need").distinct()
    chosen = docs.join(F.broadcast(wanted) if small else wanted, docs.id == wanted.need, "left_semi")

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingle_set(t).tobytes() for t in texts], pa.binary())], ["id", "shingles"])

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, centres = None, []
        for batch in batches:
            found = []
            for a, tile, role, own, raw in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4)):
                shingles = np.frombuffer(raw.as_buffer(), np.uint64)
                if (a, tile) != at:
                    at, centres = (a, tile), []
                if role == 0:
                    centres.append(shingles.copy())
                elif any(links(c, shingles) for c in centres):
                    found.append((a, own))
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    hashed = chosen.select("id", "text").mapInArrow(arrays, "id long, shingles binary")
    placed = hashed.join(F.broadcast(needs) if small else needs, hashed.id == needs.need).select("a", "tile", "role", "id", "shingles")
    return placed.repartition("a", "tile").sortWithinPartitions("a", "tile", "role").mapInArrow(tiles, "a long, b long").distinct()


def bounded(pairs: DataFrame, maps: DataFrame) -> DataFrame:
    """Of the pairs (a, b) those that size and bitmaps do not rule out."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n, x, m, y = (batch.column(i).to_pylist() for i in range(6))
            keep = pa.array([may_link(*pair) for pair in zip(n, x, m, y)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    left = pairs.join(maps.select(F.col("id").alias("a"), "n", F.col("bitmap").alias("x")), "a")
    both = left.join(maps.select(F.col("id").alias("b"), F.col("n").alias("m"), F.col("bitmap").alias("y")), "b")
    return (both.where("4 * least(n, m) >= 3 * greatest(n, m)").select("a", "b", "n", "x", "m", "y")
            .mapInArrow(step, "a long, b long").distinct())


def crossing_pairs(members: DataFrame, maps: DataFrame, nearest: bool = False) -> DataFrame:
    """Pairs (a, b), a < b, of members (centre, id, root) of one centre in different components that sizes and bitmaps do not rule out;
    with nearest=True only that of each member whose bitmap is nearest to its own."""
    several = (members.groupBy("centre").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("size")).where("low <> high")
               .select("centre", F.ceil(F.col("size") / MEMBERS).cast("int").alias("blocks")))
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    # a member of block i goes to the tiles (i, j) of all blocks j, as the smaller or the larger number
    tiles = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(
        F.least("block", j).alias("low"), F.greatest("block", j).alias("high")))
    rows = (members.join(several, "centre").withColumn("block", block).join(maps, "id")
            .select("centre", F.explode(tiles).alias("t"), "id", "root", "n", "block", "bitmap")
            .select("centre", "t.low", "t.high", "id", "root", "n", "block", "bitmap"))

    def compare(group: list[tuple]) -> list[tuple[int, int]]:
        _, low, high, *_ = group[0]
        group.sort(key=lambda r: r[5])
        ids, roots, sizes, blocks = (np.array([r[i] for r in group]) for i in (3, 4, 5, 6))
        widths = np.array([len(r[7]) // 8 for r in group])
        found, least, best = [], np.full(len(ids), np.iinfo(np.int64).max), np.full(len(ids), -1)
        for width in np.unique(widths):
            near = np.flatnonzero((widths == width) | (widths == 2 * width))
            maps = np.stack([folded(np.frombuffer(group[i][7], np.uint64), width) for i in near])
            near_sizes = sizes[near]
            for at, i in enumerate(near):
                if widths[i] != width:
                    break
                end = np.searchsorted(near_sizes, sizes[i] * 4 // 3, "right")
                other = near[at + 1:end]
                if not len(other):
                    continue
                apart = np.bitwise_count(maps[at + 1:end] ^ maps[at]).sum(axis=1).astype(np.int64)
                ok = (roots[other] != roots[i]) & (7 * apart <= sizes[other] + sizes[i])
                if low != high:
                    ok &= blocks[other] != blocks[i]  # pairs inside a block have their own tile
                if not ok.any():
                    continue
                other, apart = other[ok], apart[ok]
                if nearest:
                    if apart.min() < least[i]:
                        least[i], best[i] = apart.min(), other[apart.argmin()]
                    closer = apart < least[other]
                    least[other[closer]], best[other[closer]] = apart[closer], i
                else:
                    found += [(min(ids[i], j), max(ids[i], j)) for j in ids[other]]
        return found + [(min(ids[i], ids[best[i]]), max(ids[i], ids[best[i]])) for i in np.flatnonzero(best >= 0)]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, []

        def out():
            found = set(compare(group)) if len(group) > 1 else ()
            return pa.RecordBatch.from_arrays([pa.array([int(f[i]) for f in found], pa.int64()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(8))):
                if row[:3] != key:
                    if len(group) > 1:
                        yield out()
                    key, group = row[:3], []
                group.append(row)
        if len(group) > 1:
            yield out()

    return rows.repartition("centre", "low", "high").sortWithinPartitions("centre", "low", "high").mapInArrow(step, "a long, b long").distinct()


def similar_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles and component_id (the smallest key reachable by links, its own included) for every row.

    Null and empty texts and texts without words have no shingles and are linked with nothing. Rows of one key are one document in
    several rows: what links one of them links all. A row with a null key has a null component. Other columns are not read. Keys are integers.
    """
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    sets = written(set_table(rows, frequent_shingles(rows)))
    known = sets.where("id is not null and n > 0")

    # equal sets: every document hangs on the smallest one
    first = known.groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("size")).where("size > 1").select("digest", "rep")
    copies = checkpointed(known.select("id", "digest").join(first, "digest").where("id <> rep").select("id", "rep").distinct())

    # a key of several rows keeps its own sets
    several = known.groupBy("id").count().where("count > 1").select("id")
    stand_in = checkpointed(copies.join(several, "id", "left_anti").select(F.col("id").alias("_copy"), F.col("rep").alias("_rep")))

    def represented(df: DataFrame, *names: str) -> DataFrame:
        for name in names:
            own = stand_in.select("_copy", "_rep")
            df = df.join(own, df[name] == own["_copy"], "left").withColumn(name, F.coalesce("_rep", name)).drop("_copy", "_rep")
        return df

    # a representative may have its bitmap under the name of a copy that another task met first
    maps = known.where(F.col("bitmap").isNotNull()).select("id", "n", "bitmap")
    maps = written(represented(maps, "id").distinct())

    stars = written(represented(shared_prefixes(known), "id", "centre"))
    salted = stars.where("shingle is not null")
    hubs = salted.groupBy("shingle").agg(F.min("centre").alias("hub"))
    proposed = stars.select("centre", "id").union(salted.select("shingle", F.col("centre").alias("id")).join(hubs, "shingle").select("hub", "id"))
    proposed = proposed.select(F.least("centre", "id").alias("a"), F.greatest("centre", "id").alias("b")).where("a <> b").distinct()
    tested = checkpointed(bounded(proposed, maps))
    found = checkpointed(verified(tested, rows))
    roots = checkpointed(components(found.union(copies)))

    # what is left: two members of one shingle in different components. Both are in the stars of one centre (or hub), where they meet once
    # for all the shingles that they share. First every member proposes its nearest one, which joins most of what links at all; then
    # all pairs that are still apart are tested
    beside = checkpointed(stars.where("wide and shingle is null").select("centre", "id")
                          .union(salted.join(hubs, "shingle").select(F.col("hub").alias("centre"), "id")).distinct())

    def members() -> DataFrame:
        return beside.join(roots, "id", "left").select("centre", "id", F.coalesce("root", "id").alias("root"))

    for nearest in (True, False):
        rest = checkpointed(crossing_pairs(members(), maps, nearest).join(tested, ["a", "b"], "left_anti"))
        roots = checkpointed(merged(roots, checkpointed(verified(rest, rows))))
        tested = tested.union(rest)

    labelled = sets.select("id", "n").join(roots, "id", "left")
    return labelled.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("root", "id").alias("component_id"))


def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The roots (id, root) with the components joined that the links (a, b) connect."""
    def rooted(df: DataFrame, name: str) -> DataFrame:
        own = roots.select(F.col("id").alias("_id"), F.col("root").alias("_root"))
        return df.join(own, df[name] == own["_id"], "left").withColumn(name, F.coalesce("_root", name)).drop("_id", "_root")

    ends = links.select(F.col("a").alias("id")).union(links.select("b")).distinct()
    known = roots.unionByName(ends.join(roots, "id", "left_anti").select("id", F.col("id").alias("root")))
    joined = components(rooted(rooted(links, "a"), "b")).select(F.col("id").alias("_old"), F.col("root").alias("_new"))
    return known.join(joined, known.root == joined["_old"], "left").select("id", F.coalesce("_new", "root").alias("root"))


def oracle_sql(docs: str = "documents") -> str:
    """DuckDB SQL for the rows of similar_groups, with whole shingles in place of hashes and every pair that shares one counted."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{lower}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM {docs}),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE []::VARCHAR[] END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM w UNION SELECT r.doc_id, e.b FROM reach r JOIN ways e ON e.a = r.other)
SELECT r.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.other) AS component_id
FROM reach r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id"""
