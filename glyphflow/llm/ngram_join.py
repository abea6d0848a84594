"""N-gram Jaccard join by a MinHash LSH forest, verified exactly.

A text is the set of its runs of five words (a text of one to four words is one
run).  Texts with equal sets form one class from the start.  Each class gets a
signature: for each of TREES trees, the labels (one byte of a minimum hash) of its way
from the root of a prefix tree down to level DEEPEST.  No hash serves two trees.

The forest is read from its longest prefixes upward.  At a depth, the ways of a tree
are sorted, and classes that share the prefix are linked to the smallest of them; what
is linked, also by way of others, makes a candidate group, and within it every pair of
sets is compared exactly.  The similarities found tell the recall: a pair of similarity
s is met at depth d with probability 1 - (1 - s ** d) ** TREES, so the pairs found, each
weighed by one over that (and one pair more at the threshold itself), estimate all pairs
there are, by similarity.  While the estimated recall is below TARGET the prefixes are
shortened to the greatest depth that reaches it by that estimate, and read again.  All
links of the corpus take part in the estimate; nothing is sampled.

Comparison is in tiles of at most TILE by TILE sets of TILE_BYTES a side (one longer
text is a side of its own), so that a group of any size is many small tasks.  Pairs
aren't written out: a tile gives each class its number of links, the similarities
counted in hundredths, and, for the classes of the result, a forest of at most
2 * TILE links.

Scale: signatures are made once and kept in the shared folder (TREES * DEEPEST bytes a
class); a class's prefixes move as one row of two numbers a tree.  A map task links
what shares a prefix within its batch itself and sends one row a prefix, so a prefix
of a third of all rows is a row a batch.  Texts move once a depth, compressed, to the
candidate groups' rows, and those of candidate groups once more, to their tiles.  Groups
are found by label propagation over links to the smallest member, each round cut by a
checkpoint in the shared folder; nothing but a count of changed labels and 21 counts of
similarities reaches the driver.

Recall: TARGET of all links by the estimate, and by the added pair never less than a
depth of about half of DEEPEST gives where nothing similar is found; candidate groups add
to that.  No link found is wrong.

Edge cases: null and empty texts have no runs, no links and a class of their own;
rows with a null id pass as classes of their own with no links; repeated rows (same
id and text) count as copies of each other; texts that differ under one id are
told apart by the hash of their runs; an empty table gives an empty result; only
the columns named are looked at.  Ids are whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SIZE, THRESHOLD = 5, 0.8
TREES, DEEPEST, TARGET = 40, 12, 0.999
HASHES = TREES * DEEPEST
#: Sets, and bytes of their texts, on one side of a tile.
TILE, TILE_BYTES = 512, 4 << 20

_rng = np.random.default_rng(2024)
_MULTIPLY = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def met(similarity: np.ndarray | float, depth: int, trees: int = TREES) -> np.ndarray:
    """How likely a pair of this similarity shares a prefix of this depth in some tree."""
    return 1 - (1 - np.asarray(similarity, float) ** depth) ** trees


def depth_for(similarities: np.ndarray, weights: np.ndarray, target: float, deepest: int = DEEPEST) -> int:
    """The longest prefix that meets the target share of pairs, given by similarity and number."""
    for depth in range(deepest, 1, -1):
        if (weights * met(similarities, depth)).sum() >= target * weights.sum():
            return depth
    return 1


def all_pairs(found: dict[int, int], depth: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Similarities and estimated numbers of all pairs, from those found at a depth (counted in hundredths)."""
    similarities = np.array([threshold, *(min(1.0, max(threshold, k / 100 + 0.005)) for k in found)])
    return similarities, np.array([1.0, *found.values()]) / met(similarities, depth)


def run_sets(texts: list[bytes], size: int = SIZE) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's runs of words."""
    words, counts = common.word_hashes(texts)
    grams = common.gram_hashes(words, size)
    out = []
    for s, n in zip(common.starts_of(counts), counts, strict=True):
        out.append(np.unique(grams[s : s + n - size + 1]) if n >= size else common.gram_hashes(words[s : s + n], int(n)) if n else np.zeros(0, np.uint64))
    return out


def signature(grams: np.ndarray) -> np.ndarray:
    """TREES x DEEPEST labels: of each tree the way from its root."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(grams), 128):
        x = grams[i : i + 128, None] * _MULTIPLY  # the high bits of a product with an odd number decide
        np.minimum(least, x.min(0), out=least)
    return (common.mix(least) & np.uint64(255)).astype(np.uint8).reshape(DEEPEST, TREES).T


def prefixes(ways: np.ndarray, depth: int) -> np.ndarray:
    """One hash a tree of the first depth labels; ways: (classes x) TREES x DEEPEST."""
    h = np.broadcast_to(np.arange(TREES, dtype=np.uint64), ways.shape[:-1])
    for k in range(depth):
        h = common.mix(h * np.uint64(0x9E3779B97F4A7C15) + ways[..., k].astype(np.uint64) + np.uint64(1))
    return h


def set_key(grams: np.ndarray) -> int:
    """A hash of the set, whatever the order."""
    return int(np.bitwise_xor.reduce(common.mix(grams ^ np.uint64(len(grams)))).view(np.int64))


def _shred(with_text: bool):
    """doc_id, key (hash of the set; null without runs), size (bytes) and, if asked for, z (the text, compressed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=3, write_checksum=False)
        for b in batches:
            texts = b.column(1).to_pylist()
            for part in common.groups(texts):
                keys = [set_key(s) if len(s) else None for s in run_sets(texts[part])]
                cols, names = [b.column(0).slice(part.start, part.stop - part.start), pa.array(keys, pa.int64())], ["doc_id", "key"]
                if with_text:
                    cols, names = [*cols, pa.array([zip_.compress(t) for t in texts[part]], pa.binary())], [*names, "z"]
                else:
                    cols, names = [*cols, pa.array(list(map(len, texts[part])), pa.int64())], [*names, "size"]
                yield pa.record_batch(cols, names=names)

    return run


def stars(pairs: np.ndarray) -> np.ndarray:
    """The same groups in one link a member, to the smallest of its group; pairs: n x 2."""
    names, ends = np.unique(pairs, return_inverse=True)
    a, b = ends.reshape(-1, 2).T
    label = np.arange(len(names))
    while len(names):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for at in (a, b, label[a], label[b]):
            np.minimum.at(new, at, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    out = np.stack([names, names[label]], 1)
    return out[out[:, 0] != out[:, 1]]


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, ways: of each class of a batch its signature."""
    for b in batches:
        texts, known = b.column(0).to_pylist(), {}
        for part in common.groups(texts):
            for s in run_sets(texts[part]):
                if len(s) and (key := set_key(s)) not in known:
                    known[key] = signature(s).tobytes()
        yield pa.record_batch([pa.array(known, pa.int64()), pa.array(known.values(), pa.binary())], names=["key", "ways"])


def _tree_rows(depth: int):
    """prefix, key and to: of each prefix in a batch the smallest key of its group there, for the shuffle (to is null), and links to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ways = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(-1, TREES, DEEPEST)
            keys = np.repeat(b.column(0).to_numpy(), TREES)
            made = prefixes(ways, depth).reshape(-1).view(np.int64)
            order = np.lexsort((keys, made))
            keys, made = keys[order], made[order]
            first = np.concatenate([[True], made[1:] != made[:-1]]) if len(made) else np.zeros(0, bool)
            group = np.cumsum(first) - 1
            pairs = np.stack([keys[~first], keys[first][group[~first]]], 1)
            pairs = stars(pairs[pairs[:, 0] != pairs[:, 1]])  # a class may stand in a batch twice
            sent = keys[first]
            if len(pairs):  # pairs are sorted by key
                at = np.minimum(np.searchsorted(pairs[:, 0], sent), len(pairs) - 1)
                sent = np.where(pairs[at, 0] == sent, pairs[at, 1], sent)
            spread = common.mix(pairs[:, 0].astype(np.uint64)).view(np.int64)
            to = pa.concat_arrays([pa.nulls(int(first.sum()), pa.int64()), pa.array(pairs[:, 1], pa.int64())])
            yield pa.record_batch([pa.array(np.concatenate([made[first], spread])), pa.array(np.concatenate([sent, pairs[:, 0]])), to], names=["prefix", "key", "to"])

    return run


def _prefix_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by prefix and key, a link of each key to the smallest that shares a prefix."""
    last, least = None, None
    for b in batches:
        told = b.column(2).is_valid().to_numpy(zero_copy_only=False)
        prefix, key = b.column(0).to_numpy()[~told], b.column(1).to_numpy()[~told]
        links = [np.stack([c.filter(pa.array(told)).to_numpy(zero_copy_only=False) for c in b.columns[1:]], 1)]
        if len(key):
            begins = np.flatnonzero(np.concatenate([[True], prefix[1:] != prefix[:-1]]))
            group = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(key))))
            first = key[begins]
            if last == prefix[0]:
                first[0] = least
            pairs = np.stack([key, first[group]], 1)
            links.append(pairs[pairs[:, 0] != pairs[:, 1]])
            last, least = prefix[-1], first[-1]
        links = stars(np.concatenate(links))
        yield pa.record_batch([pa.array(links[:, 0], pa.int64()), pa.array(links[:, 1], pa.int64())], names=["key", "to"])


def groups_of(links: DataFrame) -> DataFrame:
    """key, label: the smallest key that each key is linked to, directly or by way of others.

    links: (key, to).  Labels sink along the links until none changes; each round also
    takes the label of the own label, which halves the distance to the smallest.
    """
    links = common.cut(links.distinct())
    both = links.select("key", "to").unionByName(links.select(F.col("to").alias("key"), F.col("key").alias("to")))
    labels = common.cut(both.groupBy("key").agg(F.least("key", F.min("to")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("key").alias("to"), "label"), "to").groupBy("key").agg(F.min("label").alias("near"))
        step = labels.join(near, "key").select("key", F.least("label", "near").alias("new"), F.col("label").alias("old"))
        jump = labels.select(F.col("key").alias("new"), F.col("label").alias("far"))
        new = common.cut(step.join(jump, "new", "left").select("key", F.least("new", F.coalesce("far", "new")).alias("label"), "old"))
        changed = new.filter(F.col("label") != F.col("old")).limit(1).count()
        labels = new.select("key", "label")
        if not changed:
            return labels


class _Forest:
    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return int(i)

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of the sets of a with those of b.

    Runs that stand in one set alone on either side share nothing; the others are
    columns of two 0/1 matrices, multiplied in strips of columns.
    """
    flat, other = np.concatenate(a), np.concatenate(b)
    common_, inverse = np.unique(np.concatenate([flat, other]), return_inverse=True)
    left, right = inverse[: len(flat)], inverse[len(flat) :]
    both = np.flatnonzero((np.bincount(left, minlength=len(common_)) > 0) & (np.bincount(right, minlength=len(common_)) > 0))
    col = np.full(len(common_), -1, np.int64)
    col[both] = np.arange(len(both))
    rows_a, rows_b = np.repeat(np.arange(len(a)), [len(s) for s in a]), np.repeat(np.arange(len(b)), [len(s) for s in b])
    left, right = col[left], col[right]
    out = np.zeros((len(a), len(b)), np.float32)
    order_a, order_b = np.argsort(left, kind="stable"), np.argsort(right, kind="stable")
    left, rows_a, right, rows_b = left[order_a], rows_a[order_a], right[order_b], rows_b[order_b]
    for lo in range(0, len(both), 4096):
        hi = min(lo + 4096, len(both))
        x, y = np.zeros((len(a), hi - lo), np.float32), np.zeros((len(b), hi - lo), np.float32)
        s, t = np.searchsorted(left, [lo, hi])
        x[rows_a[s:t], left[s:t] - lo] = 1
        s, t = np.searchsorted(right, [lo, hi])
        y[rows_b[s:t], right[s:t] - lo] = 1
        out += x @ y.T
    return out


def verify(a: list[np.ndarray], b: list[np.ndarray] | None, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs (i in a, j in b; i < j if b is None) of similarity threshold or more, and their similarities."""
    other = a if b is None else b
    inter = overlaps(a, other).astype(np.float64)
    size_a, size_b = np.array([len(s) for s in a], np.float64), np.array([len(s) for s in other], np.float64)
    union = size_a[:, None] + size_b[None, :] - inter
    like = inter >= threshold * union - 1e-9
    i, j = np.nonzero(np.triu(like, 1) if b is None else like)
    return i, j, inter[i, j] / union[i, j]


def _link_rows(keys: np.ndarray, weights: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: np.ndarray, forest: list[tuple[int, int]]) -> pa.RecordBatch:
    """Links of each class (to texts: counted with copies; to classes), the forest's links, and counts by hundredths of similarity (no key)."""
    n = len(keys)
    texts = np.bincount(i, weights[j], n) + np.bincount(j, weights[i], n) if len(i) else np.zeros(n)
    classes = np.bincount(i, minlength=n) + np.bincount(j, minlength=n) if len(i) else np.zeros(n, np.int64)
    has = np.flatnonzero(classes)
    edge = np.array(forest, np.int64).reshape(-1, 2)
    like, many = np.unique((similarity * 100 + 1e-6).astype(np.int64), return_counts=True)
    none, zero = pa.nulls(len(like), pa.int64()), np.zeros(len(edge), np.int64)
    return pa.record_batch(
        [
            pa.concat_arrays([pa.array(np.concatenate([keys[has], keys[edge[:, 0]]]), pa.int64()), none]),
            pa.concat_arrays([pa.array(np.concatenate([keys[has], keys[edge[:, 1]]]), pa.int64()), none]),
            pa.array(np.concatenate([texts[has].astype(np.int64), zero, like])),
            pa.array(np.concatenate([classes[has].astype(np.int64), zero, many])),
        ],
        names=["key", "to", "texts", "classes"],
    )


_LINKS = "key long, to long, texts long, classes long"


def _tiles(threshold: float):
    """Reads rows sorted by (label, tile) and compares the sets of each tile of each group."""

    def compare(rows: list[tuple]) -> pa.RecordBatch:
        # a tile on the diagonal has one side, any other two
        unzip = zstandard.ZstdDecompressor()
        keys, weights = np.array([r[2] for r in rows], np.int64), np.array([r[3] for r in rows], np.int64)
        sets = run_sets([unzip.decompress(r[4]) for r in rows])
        sides = np.array([r[5] for r in rows])
        left, right = np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)
        i, j, similarity = verify([sets[k] for k in left], [sets[k] for k in right] if len(right) else None, threshold)
        i, j = left[i], (right if len(right) else left)[j]
        f = _Forest(len(rows))
        forest = [(a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True) if f.join(a, b)]
        return _link_rows(keys, weights, i, j, similarity, forest)

    def done(rows: list[tuple]) -> bool:
        """Nothing to compare: one class, or one side of a tile that has two."""
        return len(rows) < 2 or (not rows[0][6] and len({r[5] for r in rows}) < 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                for row in zip(*(c.to_pylist() for c in b.slice(lo, 1000).columns), strict=True):
                    if held and held[0][:2] != row[:2]:
                        if not done(held):
                            yield compare(held)
                        held = []
                    if not held or held[-1][2] != row[2]:  # repeated rows of one id
                        held.append(row)
        if not done(held):
            yield compare(held)

    return run


def _twice(df: DataFrame, name: str) -> DataFrame:
    """A second key: where one side of a join is grouped by the first, both are shuffled for it, and AQE can split a hot key."""
    return df.withColumn(f"{name}_2", F.xxhash64(name))


def _compared(rows: DataFrame, sizes: DataFrame, ways: DataFrame, depth: int, threshold: float) -> DataFrame:
    """Links, the forest of links and counts of similarities of all candidate groups at a depth."""
    n = common.partitions(rows.sparkSession)
    trees = ways.mapInArrow(_tree_rows(depth), "prefix long, key long, to long")
    labels = groups_of(trees.repartition(n, "prefix").sortWithinPartitions("prefix", "key").mapInArrow(_prefix_links, "key long, to long"))
    # a class's side in its group decides its tiles; one row of each class carries its text: that of the smallest id
    placed = common.cut(labels.join(sizes, "key").select("key", "label", "copies", "size", F.col("first").alias("doc_id")))
    crowds = placed.groupBy("label").agg(F.count("*").alias("crowd"), F.sum("size").alias("bytes"))
    sides = F.ceil(F.greatest(F.col("crowd") / F.lit(TILE), F.col("bytes") / F.lit(TILE_BYTES))).cast("int")
    placed = _twice(placed, "label").join(_twice(crowds, "label"), ["label", "label_2"]).select("key", "label", "copies", "doc_id", sides.alias("sides"))
    placed = placed.withColumn("side", F.pmod(F.xxhash64("key", F.lit(3)), F.col("sides")).cast("int"))
    texts = rows.filter("doc_id IS NOT NULL").mapInArrow(_shred(True), "doc_id long, key long, z binary")
    sets = texts.join(placed.hint("merge"), ["key", "doc_id"]).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
    tile = F.least("side", "other").cast("long") * F.col("sides") + F.greatest("side", "other")
    tiles = sets.select("label", tile.alias("tile"), "key", "copies", "z", F.when(F.col("side") <= F.col("other"), 0).otherwise(1).alias("half"), (F.col("side") == F.col("other")).alias("diagonal"))
    return common.cut(tiles.repartition(n, "label", "tile").sortWithinPartitions("label", "tile", "key").mapInArrow(_tiles(threshold), _LINKS))


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, target: float = TARGET) -> DataFrame:
    """One row per row of docs: doc_id, class_id (smallest id of the texts linked directly or by way
    of others), n_copies (other rows with the same runs), n_links (other rows of similarity
    threshold or more), n_similar (classes of equal runs among those, the own one left out)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), common.as_bytes(text_col))
    usable = F.col("doc_id").isNotNull() & F.col("key").isNotNull()
    members = common.cut(rows.mapInArrow(_shred(False), "doc_id long, key long, size long"))
    sizes = members.filter(usable).groupBy("key").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first"), F.max("size").alias("size"))
    ways = common.cut(rows.filter("doc_id IS NOT NULL").select("text").mapInArrow(_signatures, "key long, ways binary"))
    depth = DEEPEST
    while True:
        found = _compared(rows, sizes, ways, depth, threshold)
        # 21 rows at most
        like = {r["texts"]: r["n"] for r in found.filter("key IS NULL").groupBy("texts").agg(F.sum("classes").alias("n")).collect()}
        shorter = depth_for(*all_pairs(like, depth, threshold), target, depth)
        if shorter == depth:
            break
        depth = shorter
    found = found.filter("key IS NOT NULL")
    counts = found.groupBy("key").agg(F.sum("texts").alias("texts"), F.sum("classes").alias("classes"))
    final = groups_of(found.filter(F.col("key") != F.col("to")).select("key", "to"))
    named = common.cut(final.join(sizes.select("key", "first"), "key"))
    least = named.groupBy("label").agg(F.min("first").alias("class_id"))
    named = _twice(named, "label").join(_twice(least, "label"), ["label", "label_2"]).select("key", "class_id")
    facts = sizes.join(counts, "key", "left").join(named, "key", "left").select("key", "copies", "texts", "classes", F.coalesce("class_id", "first").alias("class_id"))
    known, rest = members.filter(usable), members.filter(~usable)
    none = F.lit(0).cast("long")
    out = _twice(known, "key").join(_twice(facts, "key"), ["key", "key_2"]).select("doc_id", "class_id", (F.col("copies") - 1).alias("n_copies"), (F.col("copies") - 1 + F.coalesce("texts", none)).alias("n_links"), F.coalesce("classes", none).alias("n_similar"))
    return out.unionByName(rest.select("doc_id", F.col("doc_id").alias("class_id"), none.alias("n_copies"), none.alias("n_links"), none.alias("n_similar")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, with the one of smallest id of each class; rows
    without runs or id stay; of repeated rows with that id one stays."""
    classes = common.cut(similar(docs, id_col, text_col))
    gone = classes.filter(F.col("class_id") != F.col("doc_id")).select(F.col("doc_id").alias("_gone")).distinct()
    left = docs.join(gone, docs[id_col].cast("long") == gone["_gone"], "left_anti")
    first = classes.filter((F.col("class_id") == F.col("doc_id")) & (F.col("n_copies") > 0))
    twice = first.groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("_twice"))
    if twice.isEmpty():
        return left
    once = left.join(twice, left[id_col].cast("long") == twice["_twice"], "left_anti")
    more = left.join(twice, left[id_col].cast("long") == twice["_twice"], "left_semi").dropDuplicates([id_col, text_col])
    return once.unionByName(more)
