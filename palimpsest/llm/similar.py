"""Near-duplicates by Jaccard similarity of the sets of word shingles, exactly: every pair at the similarity is linked, and no other.

Candidates come from the grid range join of SimHash fingerprints of the same shingles: sets whose fingerprints are equal, or differ in few bits. A similarity of 0.8 is about 10 differing bits of 64, beyond what cells of a grid can be small for, and any cut of an estimate loses pairs. So what lies further apart is found by the sets: two sets at the similarity share one of their first members (a fifth of them and one), whatever one order all sets are put in. Members that are common in a sample of the documents come last in this order, so that a passage that many documents share brings them together only where it is most of them. Candidates are ruled out by size, by the place of what they share, and by a fingerprint of 512 or more bits whose Hamming distance is a lower bound of the symmetric difference; what is left is compared set by set.

A first member that more than CROWDED sets have doesn't give all pairs, and members that are very common in the sample don't meet in one task at all. Each of the sets is compared with three of them; then only the members of which the sets are still in several components are compared in pairs of blocks, which give a spanning forest of what the fingerprints allow. Of members that the same sets have one is enough.

What candidates connect is then decided exactly: first by the sets at the ends of a tree of candidates, and where that leaves several components, by all pairs of sets of different components, in pairs of blocks again, which give a spanning forest of the links.

Equal sets count once. Null and empty texts have no words and one, empty, set; fewer words than a shingle make one. Whole texts count, however long. Links at exactly the similarity hold. Of equal keys with different texts each is a document of its own. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import shingle_hashes, small, written
from palimpsest.llm.components import components
from palimpsest.llm.grid import DISTANCE, MOST_BROADCAST, links, majority

SHINGLE = 5
SIMILARITY = 0.8
BITS = 512
#: Rows of sets that a worker gives at once.
ROWS = 256
CROWDED = 32
BLOCK = 2048
#: Members of sets in a block.
BLOCK_MEMBERS = 1 << 19
#: Documents of which members are counted, about, in how many of them a member is common, in what share of them very common, and how many common members there are at most. Any list gives the same links.
SAMPLED, COMMON_IN, VERY_COMMON, MOST_COMMON = 8000, 3, 0.01, 200_000


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The distinct hashes of a text's shingles in order."""
    return distinct(list(shingle_hashes(text, shingle)[1]))


def distinct(blocks: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate(blocks)).view("<i8") if blocks else np.empty(0, "<i8")


def prefix_length(n: int, similarity: float) -> int:
    """Two sets at the similarity have one of the first so many members in common: a set of n shares at least similarity * n of them."""
    return n - ceil(similarity * n - 1e-9) + 1 if n else 0


def parities(hashes: np.ndarray) -> np.ndarray:
    """BITS bits as longs, twice as many as long as the set has more members than they are, in which each member flips one: two sets differ in at least as many members as these differ in bits. The halves of longer ones, combined by exclusive or, are the shorter ones."""
    width = BITS
    while width < len(hashes):
        width *= 2
    # Not the upper bits: prefixes are chosen by the order of the hashes.
    return np.packbits(np.bincount(hashes & (width - 1), minlength=width) & 1, bitorder="little").view("<i8")


def near_sets(a: Column, b: Column, n_a: Column, n_b: Column, similarity: float) -> Column:
    """False only for sets below the similarity. a and b: their parities, of sizes so near that one is at most twice as long as the other."""
    sized = F.least(n_a, n_b) >= F.greatest(n_a, n_b) * similarity - 1e-6
    shorter = F.least(F.size(a), F.size(b))
    fold = lambda x, i: F.get(x, i).bitwiseXOR(F.coalesce(F.get(x, i + shorter), F.lit(0)))
    apart = F.aggregate(F.sequence(F.lit(0), shorter - 1), F.lit(0), lambda n, i: n + F.bit_count(fold(a, i).bitwiseXOR(fold(b, i))))
    return sized & F.when(sized, apart <= F.lit((1 - similarity) / (1 + similarity)) * (n_a + n_b) + F.lit(1e-6))


def set_arrays(batches: Iterator[pa.RecordBatch], make: Callable[[str | None], list], kinds: list[pa.DataType], names: list[str]) -> Iterator[pa.RecordBatch]:
    """The columns of each batch but the last, and what make() gives of the last, a text; a few hundred rows at a time, as sets are larger than texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            made = list(zip(*map(make, part.column(part.num_columns - 1).to_pylist()), strict=True))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *[pa.array(c, k) for c, k in zip(made, kinds, strict=True)]], names=names)


def common_members(df: DataFrame, text: str, shingle: int, sampled: int, least: int, very: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The members that most documents of the sample have, and of these the very common ones apart, in order of their hashes. The driver gets at most `most` longs."""

    @F.pandas_udf("array<long>")
    def members(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t, shingle) for t in texts])

    n = df.count()
    some = df.where(F.pmod(F.xxhash64(text), F.lit(1 << 30)) < int(min(1.0, sampled / max(n, 1)) * (1 << 30)))
    counts = some.select(F.explode(members(F.col(text))).alias("x")).groupBy("x").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    found = counts.orderBy(F.desc("n"), "x").limit(most).collect()
    hot = max(least, very * min(n, sampled))
    return tuple(np.sort(np.array([r["x"] for r in found if (r["n"] > hot) == x], "<i8")) for x in (False, True))


def among(x: np.ndarray, listed: np.ndarray) -> np.ndarray:
    """Which of x are in a sorted array."""
    return listed[np.minimum(np.searchsorted(listed, x), len(listed) - 1)] == x if len(listed) else np.zeros(len(x), bool)


def sketches(df: DataFrame, key: str, text: str, shingle: int, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """For each row of df: id (unique), key, h (hash of the text), digest and n (of its set), the SimHash of the text (fp), its first members in order, but for very common ones (first), and these (hot), and bits (parities)."""
    held = df.sparkSession.sparkContext.broadcast(common)

    def sketch(text: str | None) -> list:
        n, blocks = shingle_hashes(text, shingle)
        blocks = list(blocks)
        x, (often, hot) = distinct(blocks), held.value
        is_hot = among(x, hot)
        is_often = among(x, often) & ~is_hot
        length = prefix_length(len(x), similarity)
        first = np.concatenate((x[~is_often & ~is_hot], x[is_often]))[:length]
        return [xxhash.xxh3_128_digest(x.tobytes()), len(x), majority(n, blocks), first, x[is_hot][: length - len(first)], parities(x)]

    longs = pa.list_(pa.int64())
    rows = df.select(F.monotonically_increasing_id().alias("id"), df[key].alias("key"), F.xxhash64(df[text]).alias("h"), df[text].alias("text"))
    schema = T.StructType([*rows.schema.fields[:3], T.StructField("digest", T.BinaryType()), T.StructField("n", T.IntegerType()), T.StructField("fp", T.LongType()), *[T.StructField(x, T.ArrayType(T.LongType())) for x in ("first", "hot", "bits")]])
    return written(rows.mapInArrow(lambda b: set_arrays(b, sketch, [pa.binary(), pa.int32(), pa.int64(), longs, longs, longs], schema.names), schema))


def grid_pairs(points: DataFrame, distance: int, most_broadcast: int) -> DataFrame:
    """a < b, candidates by the grid range join: sets with linked fingerprints, by the first set of each fingerprint, and each other set of a fingerprint with its first. points: id and fp."""
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    firsts = written(points.groupBy("fp").agg(F.min("id").alias("first")))
    # Dealt out by a hash of its own, as in simhash.near_duplicates().
    near = written(links(firsts.select("fp").repartition(parts, F.xxhash64("fp")), distance, most_broadcast=most_broadcast))
    held = small(firsts, most_broadcast)
    for x in "ab":
        near = near.join(held.select(F.col("fp").alias(x), F.col("first").alias(f"first_{x}")), x)
    equal = points.select("id", "fp").join(held, "fp").where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"))
    return equal.unionByName(near.select(F.least("first_a", "first_b").alias("a"), F.greatest("first_a", "first_b").alias("b")))


def thin_pairs(keyed: DataFrame, similarity: float, crowded: int) -> DataFrame:
    """a < b, candidates that share a first member which at most so many sets have, or band and a, each set of a member that more have. keyed: band, id, and n and the place of the member, packed. Rows stream through the tasks in the order of bands, and at most `crowded` of them are held back."""
    ratio = similarity / (1 + similarity)

    def pairs(band: np.ndarray, ids: np.ndarray, packed: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        n, at = packed >> 32, packed & 0xFFFFFFFF
        for d in range(1, crowded):
            i = np.flatnonzero(band[d:] == band[:-d])
            if not len(i):
                break
            j = i + d
            near = np.minimum(n[i], n[j]) >= np.maximum(n[i], n[j]) * similarity - 1e-6
            # At the first member that two sets share, what follows must suffice.
            near &= np.minimum(n[i] - at[i], n[j] - at[j]) >= (n[i] + n[j]) * ratio - 1e-6
            yield ids[i[near]], ids[j[near]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 3
        hot = None

        def give(a, b, band):
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, band)], names=["a", "b", "band"])

        def done(band, ids, packed):
            """Whole runs."""
            size = np.diff(np.append(np.flatnonzero(np.append(True, band[1:] != band[:-1])), len(band)))
            size = np.repeat(size, size)
            few, many = (size > 1) & (size <= crowded), size > crowded
            for a, b in pairs(band[few], ids[few], packed[few]):
                yield give(np.minimum(a, b), np.maximum(a, b), [None] * len(a))
            if many.any():
                yield give(ids[many], [None] * int(many.sum()), band[many])

        for batch in batches:
            band, ids, packed = (np.concatenate([x, c.to_numpy()]) for x, c in zip(held, batch.columns, strict=True))
            if hot is not None:
                k = int(np.searchsorted(band, hot, side="right"))
                if k:
                    yield give(ids[:k], [None] * k, band[:k])
                    band, ids, packed = band[k:], ids[k:], packed[k:]
            if not len(band):
                held = [np.empty(0, np.int64)] * 3
                continue
            hot, k = None, int(np.searchsorted(band, band[-1]))
            if k:
                yield from done(band[:k], ids[:k], packed[:k])
            held = [band[k:], ids[k:], packed[k:]]
            if len(held[0]) > crowded:
                hot = int(band[-1])
                yield give(held[1], [None] * len(held[1]), held[0])
                held = [np.empty(0, np.int64)] * 3
        if len(held[0]):
            yield from done(*held)

    return keyed.repartition("band").sortWithinPartitions("band").mapInArrow(run, "a long, b long, band long")


def in_blocks(members: DataFrame, group: str, block: int, most_broadcast: int) -> DataFrame:
    """members (group, id, n, ...) dealt into blocks of their group; block i meets each block j, and the pair is named by the smaller and the larger. Groups of one block share a bucket with others."""
    blocks = members.groupBy(group).agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") / BLOCK_MEMBERS)).cast("int").alias("blocks"))
    dealt = members.join(small(written(blocks), most_broadcast), group).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.withColumn("bucket", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64(group), F.lit(16 * parts))).otherwise(F.xxhash64(group)))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("block", "other", "blocks")


def forest_of(ids: np.ndarray, roots: np.ndarray, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect what all pairs that are near connect, together with the components that roots tell. near(i, others): which of the others."""
    rest, of, out = np.ones(len(ids), bool), {}, []
    for k, r in enumerate(roots):
        of.setdefault(r, []).append(k)
    for start in range(len(ids)):
        if not rest[start]:
            continue
        rest[of[roots[start]]] = False
        queue = list(of[roots[start]])
        while queue:
            i = queue.pop()
            others = np.flatnonzero(rest)
            if not len(others):
                break
            for j in others[near(i, others)]:
                if rest[j]:
                    out.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
                    rest[of[roots[j]]] = False
                    queue += of[roots[j]]
    return out


def forests(members: DataFrame, group: str, near_in: Callable[[pd.DataFrame], Callable[[int, np.ndarray], np.ndarray]], block: int, most_broadcast: int) -> DataFrame:
    """a and b: a spanning forest for each group (or pair of its blocks) by the comparison that near_in() makes of its rows. members: group, id, root, n and more."""

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, one in pdf.groupby(group, sort=False):
            one = one.drop_duplicates("id").sort_values("id").reset_index(drop=True)
            if one["root"].nunique() > 1:
                out += forest_of(one["id"].to_numpy(), one["root"].to_numpy(), near_in(one))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return in_blocks(members, group, block, most_broadcast).groupBy("bucket", "i", "j").applyInPandas(compare, "a long, b long").distinct()


def by_bits(similarity: float) -> Callable[[pd.DataFrame], Callable[[int, np.ndarray], np.ndarray]]:
    """Compares parities; those of different widths are folded to the smaller, and sizes differ by less than half where they count."""
    apart = (1 - similarity) / (1 + similarity)

    def near_in(rows: pd.DataFrame) -> Callable[[int, np.ndarray], np.ndarray]:
        n, widths = rows["n"].to_numpy().astype(np.int64), rows["bits"].map(len).to_numpy()
        folded = {}
        for width in np.unique(widths):
            fold = np.zeros((len(n), width), np.int64)
            for i in np.flatnonzero((widths == width) | (widths == 2 * width)):
                fold[i] = np.bitwise_xor.reduce(np.asarray(rows["bits"].iloc[i]).reshape(-1, width), axis=0)
            folded[width] = fold

        def near(i: int, others: np.ndarray) -> np.ndarray:
            out = np.minimum(n[others], n[i]) >= similarity * np.maximum(n[others], n[i]) - 1e-6
            for width in np.unique(np.minimum(widths[others], widths[i])[out]):
                here = np.flatnonzero(out & (np.minimum(widths[others], widths[i]) == width))
                bits = folded[width]
                differ = np.bitwise_count((bits[others[here]] ^ bits[i]).view(np.uint64)).sum(axis=1, dtype=np.int64)
                out[here] = differ <= apart * (n[others[here]] + n[i]) + 1e-6
            return out

        return near

    return near_in


def by_members(similarity: float) -> Callable[[pd.DataFrame], Callable[[int, np.ndarray], np.ndarray]]:
    """Compares the sets themselves."""

    def near_in(rows: pd.DataFrame) -> Callable[[int, np.ndarray], np.ndarray]:
        sizes = rows["members"].map(len).to_numpy()
        ends = np.cumsum(sizes)
        members = np.unique(np.concatenate([*rows["members"], np.empty(0, np.int64)]), return_inverse=True)[1].ravel()
        flag = np.zeros(len(members) + 1, bool)

        def near(i: int, others: np.ndarray) -> np.ndarray:
            own = members[ends[i] - sizes[i] : ends[i]]
            flag[own] = True
            out = np.minimum(sizes[others], sizes[i]) >= similarity * np.maximum(sizes[others], sizes[i]) - 1e-6
            for k in np.flatnonzero(out):
                j = others[k]
                common = np.count_nonzero(flag[members[ends[j] - sizes[j] : ends[j]]])
                out[k] = common * (1 + similarity) >= similarity * (sizes[j] + sizes[i]) - 1e-6
            flag[own] = False
            return out

        return near

    return near_in


def near_duplicates_by_similarity(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, crowded: int = CROWDED, block: int = BLOCK, distance: int = DISTANCE, common: tuple[int, int, float, int] = (SAMPLED, COMMON_IN, VERY_COMMON, MOST_COMMON), most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """For each row of df: key, h (hash of the text), component, the smallest key that links reach from it (null if none of them has a key), and root, a number for each component, which tells apart those that have a key in common."""
    rows = sketches(df, key, text, shingle, similarity, common_members(df, text, shingle, *common))
    names = written(rows.groupBy("digest").agg(F.min("id").alias("id"), F.min("key").alias("least"), F.count("*").alias("copies")))
    again = written(rows.select("id", "digest").join(names.where("copies > 1").select("digest", F.col("id").alias("first")), "digest").where("id <> first").select("id"))
    points = rows.join(small(again, most_broadcast), "id", "left_anti")

    keyed = points.select("id", "n", F.posexplode("first").alias("at", "band")).select("band", "id", F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("at").cast("long")).alias("packed"))
    found = written(thin_pairs(keyed, similarity, crowded))
    crowd = written(found.where("band IS NOT NULL").select("band", F.col("a").alias("id")).unionByName(points.select(F.explode("hot").alias("band"), "id")))
    alike = ["n", "x", "y", "sum", "xor"]  # the same for members that the same sets have
    pivots = crowd.groupBy("band").agg(F.min("id").alias("x"), F.max("id").alias("y"), F.min_by("id", F.xxhash64("id")).alias("z"), F.count("*").alias("n"), F.sum(F.xxhash64("id", F.lit(1)).cast("decimal(38,0)")).alias("sum"), F.bit_xor(F.xxhash64("id", F.lit(2))).alias("xor"))
    pivots = written(pivots.where("n > 1").groupBy(*alike).agg(F.min("band").alias("band"), F.first("z").alias("z")).select("band", "x", "y", "z"))
    crowd = written(crowd.join(small(pivots.select("band"), most_broadcast), "band", "left_semi"))
    starred = crowd.join(small(pivots, most_broadcast), "band").select("id", F.explode(F.array("x", "y", "z")).alias("pivot")).where("id <> pivot")
    pairs = grid_pairs(points, distance, most_broadcast).unionByName(found.where("band IS NULL").select("a", "b")).unionByName(starred.select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")))
    pairs = written(pairs.distinct())

    def fetched(pairs: DataFrame, ids: DataFrame, columns: dict[str, str]) -> DataFrame:
        """pairs and, of each of the two, the columns of ids under their names and _a or _b. By a shuffle, as Spark takes an array for one number."""
        for x in "ab":
            pairs = pairs.join(ids.select(F.col("id").alias(x), *[F.col(c).alias(f"{name}_{x}") for c, name in columns.items()]).hint("merge"), x)
        return pairs

    nodes = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    wanted = points.select("id", "n", "bits").join(small(written(nodes(pairs)), most_broadcast), "id", "left_semi")
    maybe = fetched(pairs, wanted, {"n": "n", "bits": "w"}).where(near_sets(F.col("w_a"), F.col("w_b"), F.col("n_a"), F.col("n_b"), similarity)).select("a", "b")
    maybe = written(maybe)

    def linked(a: Column, b: Column) -> Column:
        return F.size(F.array_intersect(a, b)) * (1 + similarity) >= similarity * (F.size(a) + F.size(b)) - 1e-6

    def sets_of(ids: DataFrame) -> DataFrame:
        """id and members of the sets with these ids, made again from the texts, which are read once more."""
        which = written(points.select("id", "key", "h").join(small(ids, most_broadcast), "id", "left_semi"))
        held = df.select(df[key].alias("k_"), F.xxhash64(df[text]).alias("h_"), df[text].alias("t_")).join(small(which, most_broadcast), F.col("k_").eqNullSafe(F.col("key")) & (F.col("h_") == F.col("h")))
        made = held.select("id", "t_").mapInArrow(lambda b: set_arrays(b, lambda t: [shingle_set(t, shingle)], [pa.list_(pa.int64())], ["id", "members"]), "id long, members array<long>")
        return written(made.dropDuplicates(["id"]))

    def told(ids: DataFrame, joined: DataFrame, root: str) -> DataFrame:
        """ids with their component under the name root, itself where it has no link."""
        return ids.join(small(joined.select(F.col("node").alias("id"), F.col("root").alias(root)), most_broadcast), "id", "left").withColumn(root, F.coalesce(root, "id"))

    # Crowded members whose sets candidates leave in several components.
    may = written(components(maybe))
    placed = told(crowd, may, "root")
    several = written(placed.groupBy("band").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("band"))
    members = placed.join(small(several, most_broadcast), "band", "left_semi").join(points.select("id", "n", "bits").hint("merge"), "id")
    more = written(forests(members, "band", by_bits(similarity), block, most_broadcast))
    if more.take(1):
        maybe = written(maybe.unionByName(more).distinct())
        may = written(components(maybe))
    # Now exactly: a tree of the candidates first.
    sets = sets_of(written(may.select(F.col("node").alias("id"))))
    tree = maybe.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    good = written(fetched(tree, sets, {"members": "s"}).where(linked(F.col("s_a"), F.col("s_b"))).select("a", "b"))
    groups = told(may.select(F.col("node").alias("id"), F.col("root").alias("group")), written(components(good)), "root")
    split = written(groups.groupBy("group").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("group"))
    left = groups.join(small(split, most_broadcast), "group", "left_semi").join(sets.hint("merge"), "id").withColumn("n", F.size("members"))
    good = written(good.unionByName(forests(left, "group", by_members(similarity), block, most_broadcast)))
    joined = written(components(good))
    # Of all texts with a set of the component, the smallest key.
    classes = told(names.select("digest", "id", "least"), joined, "root")
    least = written(classes.groupBy("root").agg(F.min("least").alias("component")))
    named = classes.join(small(least, most_broadcast), "root").select("digest", "component", "root")
    return rows.select("key", "h", "digest").join(named, "digest").select(F.col("key").alias(key), "h", "component", "root")


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """The rows of df, of each component one: that with the smallest key, and of several texts with this key that with the smallest hash. Of rows that repeat key and text one stays. Rows without a key stay as they are. The columns are those of df, whatever their names."""
    found = written(near_duplicates_by_similarity(df.where(df[key].isNotNull()), key, text, shingle, similarity, most_broadcast=most_broadcast).withColumnRenamed(key, "k_").withColumnRenamed("h", "h_"))
    texts = found.groupBy("k_", "h_", "root", "component").agg(F.count("*").alias("n"))
    least = texts.where("k_ = component")
    best = least.groupBy("root").agg(F.min("h_").alias("best"))
    gone = written(texts.where("k_ <> component").select("k_", "h_").unionByName(least.join(best, "root").where("h_ <> best").select("k_", "h_")))
    twice = written(texts.where("n > 1").select("k_", "h_"))
    # As a struct, so that no name of df's columns is in the way.
    rows = df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), df[key].alias("k"), F.xxhash64(df[text]).alias("h"))
    same = (F.col("k") == F.col("k_")) & (F.col("h") == F.col("h_"))
    kept = rows.join(small(gone, most_broadcast), same, "left_anti")
    if twice.take(1):
        repeated = kept.join(small(twice, most_broadcast), same, "left_semi").dropDuplicates(["k", "h"])
        kept = kept.join(small(twice, most_broadcast), same, "left_anti").unionByName(repeated)
    return kept.select("row.*")
