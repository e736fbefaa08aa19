"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints: 64 bits over word shingles (XXH64, seed 42); a bit is 1 if it is set in over half of the shingles' hashes. Distinct fingerprints
are sorted by Gray rank, so that neighbours share bits; leaves are grouped by eight, and a node keeps the bits that all its leaves share and its
parent doesn't (a mask and a pattern). A search goes down with the differences accumulated so far, leaves out every group whose count is over
the limit, and takes a group whole when even its unshared bits can't bring it over.

To spread the work, the bits are cut into `limit + k` bands and the index is built once for each choice of k of them: fingerprints that agree in
the chosen bands share a top node, which is the shuffle's key. Two fingerprints that differ in at most `limit` bits agree in k bands, so that
they meet below a top node of some choice: no link is lost. k grows with the table (5 choices of 12 bits, 15 of 20, 35 of 27, 70 of 32), so
that top nodes don't, and the links are the same for every k. Top nodes with more than `most` fingerprints are cut into salted blocks that
meet pairwise. A task hands on a spanning forest of its links, not the links themselves.

For a similarity of 0.8 over shingles, as a near-duplicate stage needs it, 64 bits and 4 differences are too few: similar_links() indexes 256-bit
fingerprints in the same way, through more turns, each by some bits at random places. Wider turns keep top nodes small in large tables; as each
is met by fewer pairs there are more of them, so that a pair's chance to meet is the same at every size.

Defined cases: null text counts as empty; texts without words have fingerprint zero and link like others; rows with equal text share a
fingerprint; rows that repeat a doc_id are one document if their texts are equal, else each has its own fingerprint; a null doc_id takes
part and gives its component the null id only if nothing else is in it; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import checkpointed, parts, table
from docloom.llm.components import SALTS, components

FAN = 8


def shingles(text: str | None, words: int) -> np.ndarray:
    """XXH64 of each shingle of a whole text in order; of all its words where it has fewer than `words`."""
    import xxhash

    hashed = xxhash.xxh64_intdigest
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    line = b" ".join(tokens)
    ends = list(accumulate([len(t) + 1 for t in tokens]))
    starts, ends = [0, *ends[:-words]] if len(tokens) > words else [0], ends[words - 1 :] or ends[-1:]
    return np.fromiter((hashed(line[s : e - 1], 42) for s, e in zip(starts, ends, strict=True)), np.uint64, len(starts))


def majority(hashes: np.ndarray, count: int = 1) -> np.ndarray:
    """The fingerprint of shingle hashes: `count` 64-bit words; the first from the hashes, each further one from a mix of them, 16k at a time."""
    n = len(hashes)
    if not n:
        return np.zeros(count, np.uint64)
    ones = np.zeros(64 * count, np.int64)
    for at in range(0, n, 16_384):
        h = hashes[at : at + 16_384]
        every = np.stack([h, *(_mixed(h, j) for j in range(1, count))], axis=1)
        ones += np.unpackbits(every.view(np.uint8).reshape(-1, 8 * count), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)


def prints(text: str | None, words: int = 4, count: int = 1) -> np.ndarray:
    """The fingerprint of a whole text."""
    return majority(shingles(text, words), count)


def _mixed(h: np.ndarray, j: int) -> np.ndarray:
    x = h + np.uint64(j * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def fingerprint(text: str | None, words: int = 4) -> int:
    return int(prints(text, words)[0])


def fingerprints(docs: DataFrame, words: int = 4, text: str = "text", keep: tuple[str, ...] = ("doc_id",), names: tuple[str, ...] = ("fp",)) -> DataFrame:
    """keep's columns and the fingerprint's words as signed longs, one column a name."""
    schema = T.StructType([*(docs.schema[k] for k in keep), *(T.StructField(n, T.LongType()) for n in names)])

    def run(batches):
        for b in batches:
            found = np.array([prints(t, words, len(names)) for t in b.column(text).to_pylist()], np.uint64).reshape(-1, len(names)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), *(pa.array(found[:, i]) for i in range(len(names)))], names=schema.names)

    return docs.select(*keep, text).mapInArrow(run, schema)


def _few(batches, rows: int = 256):
    """Batches in slices, so that texts and sets of few rows are held at once."""
    return (b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows))


def set_key(sorted_set: np.ndarray) -> int:
    """A signed 64-bit key of a set of shingle hashes."""
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(sorted_set.tobytes(), 42)).view(np.int64))


def set_prints(docs: DataFrame, words: int, text: str, keep: tuple[str, ...]) -> DataFrame:
    """keep's columns, and of the set of the text's shingles: its key (id), its size (n) and its fingerprint, in which each shingle counts once."""
    schema = T.StructType([*(docs.schema[k] for k in keep), *(T.StructField(n, T.LongType()) for n in ("id", "n", *WIDE))])

    def run(batches):
        for b in _few(batches):
            sets = [(set_key(s), len(s), majority(s, len(WIDE))) for s in (np.unique(shingles(t, words)) for t in b.column(text).to_pylist())]
            found = np.array([x[2] for x in sets], np.uint64).reshape(-1, len(WIDE)).view(np.int64)
            own = [pa.array([x[i] for x in sets], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), *own, *(pa.array(found[:, i]) for i in range(len(WIDE)))], names=schema.names)

    return docs.select(*keep, text).mapInArrow(run, schema)


def gray_rank(bits: np.ndarray) -> np.ndarray:
    """Place of each word in the reflected Gray order."""
    out = bits.copy()
    for s in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(s)
    return out


def gray_order(fps: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Rows by group and Gray rank of all words: an odd number of bits before a word turns its order round."""
    ranks, turned = [], np.zeros(len(fps), np.uint64)
    for w in fps.T:
        ranks.append(gray_rank(w) ^ turned)
        turned = np.where(ranks[-1] & np.uint64(1), ~np.uint64(0), np.uint64(0))
    return np.lexsort((*ranks[::-1], group))


class _Level:
    """Nodes of one height: the bits they share, the first leaf and the number of leaves, the first child and the number of children."""

    def __init__(self, ones, zeros, leaf, leaves, child, children, group):
        self.ones, self.zeros, self.leaf, self.leaves, self.child, self.children, self.group = ones, zeros, leaf, leaves, child, children, group
        self.mask = ~(ones ^ zeros)


def _tree(fps: np.ndarray, group: np.ndarray) -> list[_Level]:
    """Levels from the leaves up to one node a group. fps are sorted by group and Gray rank."""
    n = len(fps)
    at = np.arange(n)
    levels = [_Level(fps, fps, at, np.ones(n, np.int64), at, np.zeros(n, np.int64), group)]
    while True:
        low = levels[-1]
        m = len(low.group)
        new = np.r_[True, low.group[1:] != low.group[:-1]]
        place = np.arange(m) - np.maximum.accumulate(np.where(new, np.arange(m), 0))
        if not (place > 0).any() and len(levels) > 1:
            return levels
        first = np.flatnonzero(place % FAN == 0)
        levels.append(
            _Level(np.bitwise_and.reduceat(low.ones, first, axis=0), np.bitwise_or.reduceat(low.zeros, first, axis=0), low.leaf[first], np.add.reduceat(low.leaves, first), first, np.diff(np.r_[first, m]), low.group[first])
        )


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(axis=1, dtype=np.int64)


def links(fps: np.ndarray, group: np.ndarray, limit: int, budget: int = 4_000_000) -> np.ndarray:
    """A spanning forest's root for each fingerprint (a row of one or more words), over the links of at most `limit` bits within a group. Rows
    are in gray_order(). Fingerprints search together as long as their groups' sizes add up to `budget`, which bounds the memory."""
    n = len(fps)
    root = np.arange(n)
    if n < 2:
        return root
    levels = _tree(fps, group)
    for lv in levels[1:]:  # all of a group that can't differ in more bits are one
        whole = _bits(~lv.mask) <= limit
        if whole.any():
            a = np.repeat(lv.leaf[whole], lv.leaves[whole])
            b = a + _within(lv.leaves[whole])
            root = _join(root, a, b)
    top = levels[-1]
    tops = np.searchsorted(top.group, group)
    cost = np.cumsum(top.leaves[tops])
    cuts = np.unique(np.r_[0, np.searchsorted(cost, np.arange(budget, int(cost[-1]), budget), side="right"), n])
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        q = np.arange(lo, hi)
        node, known = tops[q], np.zeros((len(q), fps.shape[1]), np.uint64)
        spent = np.zeros(len(q), np.int64)
        for lv in reversed(levels):
            fresh = lv.mask[node] & ~known
            spent = spent + _bits((fps[q] ^ lv.ones[node]) & fresh)
            stay = (spent <= limit) & (lv.leaf[node] + lv.leaves[node] > q + 1)
            q, node, spent = q[stay], node[stay], spent[stay]
            taken = spent + _bits(~lv.mask[node]) <= limit
            if taken.any():
                # the group's leaves are one already: its free bits are few enough
                root = _join(root, q[taken], lv.leaf[node[taken]])
                q, node, spent = q[~taken], node[~taken], spent[~taken]
            if lv is levels[0] or not len(q):
                break
            many = lv.children[node]
            known = np.repeat(lv.mask[node], many, axis=0)
            child = np.repeat(lv.child[node], many) + _within(many)
            q, node, spent = np.repeat(q, many), child, np.repeat(spent, many)
    return root


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, .. for each run of the given sizes."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def _join(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Joins the sets of a[i] and b[i]; root holds the least member of each set."""
    while True:
        x, y = root[a], root[b]
        differ = x != y
        if not differ.any():
            return root
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        root = root.copy()
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (nxt := root[root]).tobytes() != root.tobytes():
            root = nxt


def bands(limit: int, k: int) -> list[list[tuple[int, int]]]:
    """The choices of k of limit + k bands of a 64-bit word, a band being (first bit, bits)."""
    cuts = [64 * i // (limit + k) for i in range(limit + k + 1)]
    return [list(x) for x in combinations([(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)], k)]


def bands_for(count: int, limit: int, most: int) -> int:
    """The least k by which `count` fingerprints, spread evenly, make top nodes of less than a quarter of `most`; 4 at most (keys of 32 bits)."""
    return next((k for k in (1, 2, 3) if count < (most // 4) << min(sum(w for _, w in x) for x in bands(limit, k))), 4)


def near_links(fps: DataFrame, limit: int = 4, most: int = 20_000, k: int | None = None) -> DataFrame:
    """fps: fp (long, distinct). Links (a, b) with the same components as all pairs of at most `limit` different bits."""
    tops = []
    for choice in bands(limit, bands_for(fps.count(), limit, most) if k is None else k):
        top = F.lit(0).cast("long")
        for first, width in choice:
            top = F.shiftleft(top, width).bitwiseOR(F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << width) - 1)))
        tops.append(top)
    keyed = fps.select(F.col("fp").alias("id"), "fp", F.posexplode(F.array(*tops)).alias("turn", "top"))
    return _linked_below(keyed, ("fp",), limit, most)


#: Times that a pair at the similarity in question meets on the average.
MEETINGS = 6.0


def turns_for(count: int, share: float) -> tuple[int, int]:
    """(bits, turns) for so many fingerprints, of which the wanted pairs differ in this share of the bits: 14 bits up to 2 ** 18, then one more
    for every fourfold count; as many turns as let such a pair meet MEETINGS times on the average."""
    width = 14 + max(0, (max(count - 1, 1).bit_length() - 17) // 2)
    return width, math.ceil(MEETINGS / (1 - share) ** width)


def similar_links(fps: DataFrame, names: tuple[str, ...], limit: int, share: float, most: int = 20_000, count: int | None = None) -> DataFrame:
    """fps: id, and the words of distinct fingerprints. Links (a, b) of ids of at most `limit` different bits, found below top nodes of some bits
    at random places, in turns as turns_for() says. A pair that differs in a share d of the bits, as wide as `share` or less, meets with a
    chance of about 1 - exp(-MEETINGS) or more, whatever else the table holds and however much of it."""
    width, turns = turns_for(fps.count() if count is None else count, share)
    rng = np.random.RandomState(2)
    places = np.stack([rng.permutation(64 * len(names))[:width] for _ in range(turns)])
    schema = "id long, " + ", ".join(f"{n} long" for n in names) + ", tops array<long>"

    def run(batches):
        for b in batches:
            words = np.stack([b.column(n).to_numpy() for n in names], axis=1).view(np.uint64)
            for lo in range(0, len(words), 4096):
                part = words[lo : lo + 4096]
                tops = np.zeros((len(part), turns), np.uint64)
                for at in places.T:  # a bit of every turn
                    tops = tops << np.uint64(1) | part[:, at // 64] >> (at % 64).astype(np.uint64) & np.uint64(1)
                rows = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype="i4") * turns), pa.array(tops.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(lo, 4096) for c in ("id", *names)), rows], names=["id", *names, "tops"])

    keyed = fps.select("id", *names).mapInArrow(run, schema).select("id", *names, F.posexplode("tops").alias("turn", "top"))
    return _linked_below(keyed, names, limit, most, 400_000)  # a loose limit cuts little of the tree


def _blocks():
    """The blocks of a row with an id: every pair of salts that its own is in, so that all rows of a group meet in some block."""
    own = F.pmod(F.xxhash64("id"), F.col("salts")).cast("int")
    return F.when(F.col("salts").isNull(), F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), F.col("salts") - 1), lambda j: F.least(own, j) * F.col("salts") + F.greatest(own, j)))


def _linked_below(keyed: DataFrame, names: tuple[str, ...], limit: int, most: int, budget: int = 4_000_000) -> DataFrame:
    """keyed: id, the fingerprint's words, turn, top. Links (a, b) of ids of at most `limit` different bits that share a top node of some turn."""
    spark = keyed.sparkSession
    sizes = keyed.groupBy("turn", "top").agg(F.count("*").alias("n")).where(F.col("n") > most).withColumn("salts", F.ceil(F.col("n") / (most / 2)).cast("int")).drop("n")
    # at most one large node for `most` keyed rows, so few that they are broadcast; rows of a large top node go to every pair of blocks that their own block is in
    salted = keyed.join(F.broadcast(sizes), ["turn", "top"], "left").withColumn("blocks", _blocks())
    columns = ("turn", "top", "block", "id", *names)
    dealt = salted.select("id", *names, "turn", "top", F.explode("blocks").alias("block")).select(*columns).repartition(parts(spark), "turn", "top", "block").sortWithinPartitions("turn", "top", "block")

    def run(batches):
        def flush(rows, last):
            turn, top, block, ids = rows[:4]
            new = np.r_[True, (turn[1:] != turn[:-1]) | (top[1:] != top[:-1]) | (block[1:] != block[:-1])]
            cut = len(ids) if last else int(np.flatnonzero(new)[-1])
            group = np.cumsum(new)[:cut]
            bits = np.stack([x[:cut] for x in rows[4:]], axis=1).view(np.uint64)
            order = gray_order(bits, group)
            ids = ids[:cut][order]
            root = links(bits[order], group[order], limit, budget)
            apart = np.flatnonzero(root != np.arange(cut))
            return pa.RecordBatch.from_arrays([pa.array(ids[apart]), pa.array(ids[root[apart]])], names=["a", "b"]), tuple(x[cut:] for x in rows)

        rest = None
        for b in batches:
            now = tuple(b.column(k).to_numpy() for k in columns)
            rest = now if rest is None else tuple(np.concatenate(x) for x in zip(rest, now, strict=True))
            if len(rest[0]) >= 200_000:
                out, rest = flush(rest, False)
                yield out
        if rest is not None and len(rest[0]):
            yield flush(rest, True)[0]

    return dealt.mapInArrow(run, "a long, b long")


def near_components(docs: DataFrame, words: int = 5, limit: int = 4, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, keep's columns, fp, component_id (the smallest doc_id of the component) and root (its key) for every row."""
    own = checkpointed(fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, text), words, text, ("doc_id", *keep)))
    distinct = own.groupBy("fp").agg(F.min("doc_id").alias("first"))
    stars = components(near_links(distinct.select("fp"), limit))
    placed = distinct.join(stars.select(F.col("key").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # a component may hold a third of all fingerprints: they meet its name in salted parts
    salts = F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("salt")
    name = placed.groupBy("root").agg(F.min("first").alias("component_id")).select("root", "component_id", salts)
    named = placed.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")).join(name, ["root", "salt"]).select("fp", "component_id", "root")
    return own.join(named, "fp").select("doc_id", *keep, "fp", "component_id", "root")


def different_share(similarity: float) -> float:
    """Expected share of different bits of SimHashes of two shingle sets with this Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def bits_of_similarity(similarity: float, bits: int) -> int:
    """Most different bits of SimHashes of two shingle sets with this Jaccard similarity: the expected number and three standard deviations."""
    d = different_share(similarity)
    return int(bits * d + 3 * math.sqrt(bits * d * (1 - d)))


WIDE = ("w0", "w1", "w2", "w3")


def similar_sets(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """For each set (sorted, distinct members) the place of one set of its component, over links of at least this Jaccard similarity. A set is
    held against those of fitting size that have no component yet."""
    order = np.argsort([len(s) for s in sets], kind="stable")
    size = np.array([len(sets[i]) for i in order])
    ends = np.cumsum(size)
    flat = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)[1]
    root, free = np.arange(len(sets)), np.ones(len(sets), bool)
    own = np.zeros(len(flat), np.int64)
    for first in range(len(sets)):
        queue = [first] if free[first] and size[first] else []
        free[first] = False
        while queue:
            i = queue.pop()
            lo, hi = np.searchsorted(size, max(1, math.floor(size[i] * similarity))), np.searchsorted(size, math.ceil(size[i] / similarity), "right")
            others = lo + np.flatnonzero(free[lo:hi])
            if not len(others):
                continue
            mine = flat[ends[i] - size[i] : ends[i]]
            own[mine] = 1
            n = size[others]
            members = flat[np.repeat(ends[others] - n, n) + _within(n)]
            both = np.add.reduceat(own[members], np.cumsum(n) - n)
            own[mine] = 0
            near = others[both / (size[i] + n - both) >= similarity]
            free[near], root[near] = False, first
            queue.extend(near.tolist())
    out = np.empty(len(sets), np.int64)
    out[order] = order[root]
    return out


def verified_links(texts: DataFrame, words: int, similarity: float, text: str = "text", most: int = 2_000) -> DataFrame:
    """texts: id (the key of the text's shingle set), n (its size), root (its component of candidates) and the text. Links (a, b) of ids with the
    components that all pairs of one root of at least this Jaccard similarity have, told from the shingles themselves. A root with more than
    `most` texts, or more shingles than as many texts of 500, is cut into salted blocks that meet pairwise."""
    spark = texts.sparkSession
    weight = F.greatest(F.count("*"), F.ceil(F.sum("n") / 500))
    sizes = texts.groupBy("root").agg(weight.alias("m")).where(F.col("m") > most).withColumn("salts", F.ceil(F.col("m") / (most / 2)).cast("int")).drop("m")

    def cut(batches):
        for b in _few(batches):
            sets = [np.unique(shingles(t, words)) for t in b.column("_text").to_pylist()]
            ours = pa.array([set_key(s) == k for s, k in zip(sets, b.column("id").to_pylist(), strict=True)], pa.bool_())
            columns = [b.column("id"), b.column("root"), pa.array([s.tobytes() for s in sets], pa.large_binary()).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "root", "members"]).filter(ours)

    held = texts.select("id", "root", F.col(text).alias("_text")).mapInArrow(cut, "id long, root long, members binary")
    blocks = held.join(F.broadcast(sizes), "root", "left").withColumn("block", F.explode(_blocks())).select("root", "block", "id", "members")
    dealt = blocks.repartition(parts(spark), "root", "block").sortWithinPartitions("root", "block")

    def run(batches):
        at, ids, sets = None, [], []

        def found():
            place = similar_sets(sets, similarity) if len(ids) > 1 else np.zeros(len(ids), np.int64)
            return [(ids[i], ids[j]) for i, j in enumerate(place.tolist()) if ids[i] != ids[j]]

        for b in _few(batches):
            out = []
            for r, k, i, members in zip(*(b.column(c).to_pylist() for c in ("root", "block", "id", "members")), strict=True):
                if (r, k) != at:
                    out += found()
                    at, ids, sets = (r, k), [], []
                ids.append(i)
                sets.append(np.frombuffer(members, np.uint64))
            yield _pairs(out)
        yield _pairs(found())

    return dealt.mapInArrow(run, "a long, b long")


def _pairs(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"])


def similar_components(docs: DataFrame, words: int = 5, similarity: float = 0.8, text: str = "text", keep: tuple[str, ...] = (), most: int = 2_000) -> DataFrame:
    """doc_id, keep's columns, and root: equal for documents of one component of links of at least this Jaccard similarity of their shingle
    sets. 256-bit fingerprints propose components (64 bits are too few to tell 0.8 from less); the sets of a proposed one are compared."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, text, F.xxhash64(text).alias("_x"))
    own = checkpointed(set_prints(docs, words, text, ("doc_id", *keep, "_x")))
    one = F.max(F.struct("doc_id", "_x")).alias("one")  # a document with the set; null ids are the least
    distinct = checkpointed(own.groupBy("id").agg(one, *(F.first(c).alias(c) for c in ("n", *WIDE))))
    proposed = components(similar_links(distinct.select("id", *WIDE), WIDE, bits_of_similarity(similarity, 64 * len(WIDE)), different_share(similarity))).withColumnRenamed("key", "id")
    held = distinct.join(proposed, "id").select("id", "n", "root", F.col("one.doc_id").alias("_d"), F.col("one._x").alias("_h"))
    texts = checkpointed(docs.select("doc_id", "_x", text).join(held, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_x") == F.col("_h"))).select("id", "n", "root", text))
    stars = components(verified_links(texts, words, similarity, text, most)).select(F.col("key").alias("id"), "root")
    return own.join(stars, "id", "left").select("doc_id", *keep, F.coalesce("root", "id").alias("root"))


def one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8, text: str = "text") -> DataFrame:
    """docs' rows that stay: of each component the row with the smallest doc_id (null last), then the smallest hash of its text."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("_t"), F.struct(*docs.columns).alias("row"))
    found = similar_components(own.select("doc_id", "text", "_t"), words, similarity, "text", ("_t",))
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.coalesce("doc_id", F.lit(0)).alias("d"), F.col("_t").alias("t"))
    stay = found.groupBy("root").agg(F.min(order).alias("s")).select(F.when(~F.col("s.n"), F.col("s.d")).alias("_d"), F.col("s.t").alias("_h"))
    kept = own.join(stay, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_t") == F.col("_h")), "left_semi")
    # rows that repeat doc_id and text
    first = F.row_number().over(Window.partitionBy("doc_id", "_t").orderBy("_t"))
    return kept.withColumn("_n", first).where("_n = 1").select("row.*")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_components(table(spark, sf_dir, "documents"), words=4, limit=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
