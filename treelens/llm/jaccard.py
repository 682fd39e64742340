"""N-gram Jaccard join by PartEnum signatures, and its connected components.

The domain of shingle hashes is partitioned, finer for larger sets: sets of a band of sizes (r to 2r)
share one partition of the domain. A signature is a band, a part of the domain and all of a set's
members in that part, or in a subset of parts. Two sets that differ in at most d members differ in at most d parts, so of the
k+s first parts of either, in the order of their hashes, s are shared if d is at most k. For sets that may differ
in at most PAIRS members, all subsets of two of the k+2 first parts are enumerated, so that short texts don't meet for one
passage that is in all of them; for larger ones single parts, as there would be (k+1)*(k+2)/2 subsets of two.
Empty parts are left out, as they would be shared by everything; that is exact as long as a set fills
more than k parts, which is counted for every set, and bands where one doesn't do so get the finest
partition, one member a part, as well. Sets at the lower end of a band also sign for the band
below, where their smaller partners are. Sets of under SMALL members use the finest partition.

Rows that share a signature are never paired off blindly:
1. equal sets are one node;
2. each node is held against one hub only, the smallest node of most of its signatures, and joined to it
   if the two sets' bitmaps allow it (see 3) and their shingles really are similar enough;
3. signatures with the same smallest node are one group, so a pair that shares many of them meets once
   or a few times. Groups that still hold nodes of different components are worked off in blocks of
   bounded size. A pair of nodes passes if the parity bitmaps of the two sets, whose distance never
   exceeds the sets' own, allow the similarity; only pairs that pass leave the block, and are held
   against each other shingle by shingle. In a first round only the best pair of each node leaves a
   block, no more pairs than nodes, which joins most of what belongs together; in the second all do.
So every similar pair is either joined or in one component already, and each join is exact.

Shingles are told apart by 64-bit hashes, sets by 64-bit sums of them.

Defined results: a null text, or one without words, has an empty set and is linked with nothing; rows
repeated or equal in their sets are linked; a null doc_id counts as the largest; a component of null
doc_ids alone has none; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treelens.llm import shingles
from treelens.llm.common import TEXT, cut, discard, join_groups, partitions, pick, slices
from treelens.llm.tokens import _U64, mix

WIDTH, PERCENT, SMALL, PAIRS = 5, 75, 64, 9
#: Nodes of a group in one block; members of a hub that one task holds against it; nodes that a task remembers to have signed.
BLOCK, HUB_ROWS, SIGNED = 1024, 256, 500_000
FINEST = -1


def band(n: int) -> int:
    """FINEST, or the power of two of SMALL at which the band starts."""
    return FINEST if n < SMALL else (n // SMALL).bit_length() - 1


def parts_of(b: int) -> int:
    """How many parts the domain has: enough that a set of the band fills more parts than may differ, by many standard deviations."""
    r = SMALL << b
    return r if r < 256 else r * 85 // 100 if r < 1024 else r * 78 // 100


def members(text_words: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """The set: distinct shingle hashes, ascending."""
    return np.unique(shingles.of(text_words, width))


def set_key(s: np.ndarray) -> int:
    return int(mix(mix(s * _U64(0xA24BAED4963EE407)).sum(keepdims=True) + _U64(len(s)))[0].view(np.int64))


def _filled(s: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray]:
    """The parts that s has members in, and where in s each starts."""
    part = ((s >> _U64(32)) * _U64(parts_of(b))) >> _U64(32)
    at = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    return part[at], at


def differing(n: int, b: int, percent: int = PERCENT) -> int:
    """How many members a set of n can differ in from a similar one that signs for band b."""
    largest = n * 100 // percent if band(n) == b else (SMALL << (b + 1)) - 1
    # |A| + |B| - 2 |A and B| with |A and B| >= p |A or B|
    return (n + largest) * (100 - percent) // (100 + percent)


def unlucky(s: np.ndarray, percent: int = PERCENT) -> int | None:
    """The band in which s fills too few parts, if there is one."""
    n = len(s)
    if n < SMALL:
        return None
    return next((b for b in _bands(n, percent) if b != FINEST and len(_filled(s, b)[0]) <= differing(n, b, percent)), None)


def _bands(n: int, percent: int = PERCENT) -> list[int]:
    b = band(n)
    if b == FINEST:
        return [b]
    return [b, b - 1 if b else FINEST] if -(-n * percent // 100) < SMALL << b else [b]


def _alone(n: int, percent: int) -> bool:
    """Whether a set of n members signs by single ones."""
    return n - -(-n * percent // 100) > PAIRS


def _pairs(tokens: np.ndarray) -> np.ndarray:
    """All subsets of two."""
    i, j = np.triu_indices(len(tokens), 1)
    return mix(tokens[i] * _U64(0xA0761D6478BD642F) + mix(tokens[j]))


def signatures(s: np.ndarray, finest_for: frozenset[int] = frozenset(), percent: int = PERCENT) -> np.ndarray:
    n, out = len(s), []
    bands = _bands(n, percent)
    if FINEST not in bands and band(n) in finest_for:
        bands = [*bands, FINEST]
    for b in bands:
        if b == FINEST:  # at least so many members are shared; the other's parts are its members
            tokens, first = mix(s ^ _U64(0x5851F42D4C957F2D)), n - -(-n * percent // 100) + 1
            if 1 < n and first <= PAIRS + 1:
                out.append(_pairs(np.sort(tokens)[: first + 1]))
                if not _alone(-(-n * 100 // percent), percent):  # no similar set is too large for pairs
                    continue
        else:
            part, at = _filled(s, b)
            sums = np.add.reduceat(mix(s * _U64(0x9FB21C651E98DF25)), at)
            tokens, first = mix(sums + (part + _U64(1)) * _U64(0xC2B2AE3D27D4EB4F) + _U64(b + 1) * _U64(0x165667B19E3779F9)), differing(n, b, percent) + 1
        out.append(np.partition(tokens, first - 1)[:first] if first < len(tokens) else tokens)
    return np.concatenate(out)


def bitmap(s: np.ndarray) -> bytes:
    """One bit for each value of the hash's low bits: whether an odd number of members has it."""
    bits = 4 * (SMALL << max(0, band(len(s))))
    odd = np.bincount((s & _U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _fold(raw: bytes, size: int) -> np.ndarray:
    """A larger bitmap as one of size bytes: packbits puts low values first, so halves are folded."""
    a = np.frombuffer(raw, np.uint8)
    while len(a) > size:
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return a


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return slices(batches, 20_000, 4 << 20)


def _sets(batch: pa.RecordBatch, width: int) -> list[np.ndarray]:
    return [members(w, width) for w in shingles.words([(t or "").encode() for t in batch["text"].to_pylist()])]


def _digest(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            sets = _sets(batch, width)
            columns = [batch["doc_id"], batch["th"], pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) if len(s) else None for s in sets], pa.int64()), pa.array([unlucky(s, percent) for s in sets], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "th", "n", "node", "unlucky"])

    return run


def _sign(width: int, percent: int, finest_for: frozenset[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signed: set[int] = set()  # copies in one task sign once
        for batch in _parts(batches):
            sigs, nodes, counts = [], [], []
            if len(signed) > SIGNED:
                signed.clear()
            for s in _sets(batch, width):
                if len(s) and (key := set_key(s)) not in signed:
                    signed.add(key)
                    sigs.append(signatures(s, finest_for, percent))
                    nodes.append(key)
                    counts.append(len(sigs[-1]))
            if sigs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.repeat(np.array(nodes, np.int64), counts))], names=["sig", "node"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by signature and node: the nodes after a signature's first, with that one as their hub."""
    sig = node = hub = None
    for batch in batches:
        s, v = batch["sig"].to_numpy(), batch["node"].to_numpy()
        if not len(s):
            continue
        starts = np.concatenate(([sig is None or s[0] != sig], s[1:] != s[:-1]))
        other = np.concatenate(([node is None or v[0] != node], v[1:] != v[:-1]))
        run = np.maximum.accumulate(np.where(starts, np.arange(len(s)), -1))
        hubs = np.where(run >= 0, v[run], np.int64(0 if hub is None else hub))
        out = np.flatnonzero(~starts & other)
        sig, node, hub = s[-1], v[-1], hubs[-1]
        if len(out):
            yield pa.RecordBatch.from_arrays([pa.array(v[out]), pa.array(hubs[out])], names=["node", "hub"])


def _with_bitmaps(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            yield pa.RecordBatch.from_arrays([batch["node"], batch["n"], batch["text"], pa.array([bitmap(s) for s in _sets(batch, width)], pa.binary())], names=["node", "n", "text", "bits"])

    return run


def _held(width: int, percent: int):
    """Rows come by hub, the hub itself first: the members similar to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, of = None, np.zeros(0, np.uint64)
        for batch in _parts(batches):
            got_a, got_b = [], []
            for a, first, b, s in zip(batch["a"].to_pylist(), batch["first"].to_pylist(), batch["b"].to_pylist(), _sets(batch, width), strict=True):
                if first == 0:
                    hub, of = a, s
                elif hub == a:
                    both = len(np.intersect1d(of, s, assume_unique=True))
                    if 100 * both >= percent * (len(of) + len(s) - both):
                        got_a.append(a)
                        got_b.append(b)
            if got_a:
                yield pa.RecordBatch.from_arrays([pa.array(got_a, pa.int64()), pa.array(got_b, pa.int64())], names=["a", "b"])

    return run


def similar(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets really are similar. A node with many partners is dealt over several tasks."""
    spark = pairs.sparkSession
    many = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / HUB_ROWS).cast("int").alias("salts"))
    salted = pairs.join(many, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int"))
    own = texts.select("node", "text")
    partners = salted.join(own, salted.b == own.node).select("a", "salt", F.lit(1).alias("first"), "b", "text")
    hubs = many.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).join(own, F.col("a") == own.node).select("a", "salt", F.lit(0).alias("first"), F.col("a").alias("b"), "text")
    rows = hubs.unionByName(partners).repartition(partitions(spark), "a", "salt").sortWithinPartitions("a", "salt", "first")
    return rows.select("a", "first", "b", "text").mapInArrow(_held(width, percent), "a long, b long")


def _blocks(percent: int, best: bool):
    """Rows come by group and pair of blocks: the pairs of nodes of different components whose sizes and bitmaps allow the similarity; if best, one pair a node, whose bitmaps differ least."""

    def passing(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        size = min(len(r[4]) for r in rows)
        node, comp, n = (np.array([r[i] for r in rows], np.int64) for i in (1, 2, 3))
        block = np.array([r[0] for r in rows])
        bits = np.stack([_fold(r[4], size) for r in rows]).view(np.uint64)
        a, b = [], []
        one = (block == block[0]).all()
        for i in range(len(rows)):
            j = np.arange(i + 1, len(rows)) if one else np.flatnonzero(block > block[i])
            j = j[(comp[j] != comp[i]) & (100 * np.minimum(n[j], n[i]) >= percent * np.maximum(n[j], n[i]))]
            if len(j):
                apart = np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1, dtype=np.int64)
                ok = apart * (100 + percent) <= (n[j] + n[i]) * (100 - percent)
                if best and ok.any():
                    ok = np.array([np.where(ok, apart / (n[j] + n[i]), 2).argmin()])
                j = j[ok]
                a += [node[i]] * len(j)
                b += node[j].tolist()
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        return np.minimum(a, b), np.maximum(a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        names = ["hub", "low", "high", "block", "node", "comp", "n", "bits"]
        for batch in batches:
            out = []
            for *at, block, node, comp, n, bits in zip(*(batch[c].to_pylist() for c in names), strict=True):
                if at != key:
                    if len(rows) > 1:
                        out.append(passing(rows))
                    key, rows = at, []
                rows.append((block, node, comp, n, bits))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[i] for o in out])) for i in (0, 1)], names=["a", "b"])
        if len(rows) > 1:
            a, b = passing(rows)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def _allowed(percent: int):
    """The pairs whose sizes and bitmaps allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (n, m, x, y) in enumerate(zip(*(batch[c].to_pylist() for c in ("a_n", "b_n", "a_bits", "b_bits")), strict=True)):
                if 100 * min(n, m) >= percent * max(n, m):
                    size = min(len(x), len(y))
                    apart = int(np.bitwise_count(_fold(x, size) ^ _fold(y, size)).sum(dtype=np.int64))
                    if apart * (100 + percent) <= (n + m) * (100 - percent):
                        keep.append(i)
            yield pa.RecordBatch.from_arrays([batch[c].take(pa.array(keep, pa.int64())) for c in ("a", "b")], names=["a", "b"])

    return run


def allowed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are worth holding against each other: their texts needn't move otherwise."""
    side = lambda x: texts.select(F.col("node").alias(x), F.col("n").alias(f"{x}_n"), F.col("bits").alias(f"{x}_bits"))
    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "a_n", "b_n", "a_bits", "b_bits").mapInArrow(_allowed(percent), "a long, b long")


def components(edges: DataFrame, about: int | None = None) -> DataFrame:
    """(node, root, moved), a written table: the smallest node of each edge's component.

    Each round every node takes the least label among its neighbours, then what that label leads to: the
    label's own label, or the least that any node of the same label has met. So paths halve, and a whole
    region moves as soon as its border meets a smaller label. ``about`` says how many edges there may be.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges", about and 2 * about)
    most = both.count()
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root"), F.lit(True).alias("moved")), "labels", most)
    while not labels.where("moved").isEmpty():
        old = labels.select("node", "root")
        around = both.join(old.toDF("b", "near"), "b").groupBy("a").agg(F.min("near").alias("near"))
        step = old.join(around.withColumnRenamed("a", "node"), "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        leads = old.toDF("root", "next").unionByName(step.select(F.col("was").alias("root"), F.col("root").alias("next"))).groupBy("root").agg(F.min("next").alias("next"))
        jumped = step.join(leads, "root").select("node", F.least("root", "next").alias("root"), "was")
        before, labels = labels, cut(jumped.select("node", "root", (F.col("root") < F.col("was")).alias("moved")), "labels", most)
        discard(before)
    discard(both)
    return labels


def regroup(shared: DataFrame, rooted: DataFrame, texts: DataFrame, best: bool, width: int, percent: int) -> DataFrame:
    """(node, comp) with those components joined that similar nodes of one group link: by all such links, or by each node's best. rooted, a written table, is removed."""
    own = rooted.select(F.col("node").alias("hub"), F.col("comp").alias("hub_comp"))
    most, nodes = shared.count(), rooted.count()
    every = cut(shared.select("hub", "node").join(rooted, "node"), "every", most)
    open_ = every.groupBy("hub").agg(F.count(F.lit(1)).alias("m"), F.min("comp").alias("x"), F.max("comp").alias("y")).join(own, "hub").where("x < y or x <> hub_comp").select("hub", "hub_comp", "m", F.ceil((F.col("m") + 1) / BLOCK).cast("int").alias("n_blocks"))
    open_ = cut(open_, "open", min(most, nodes))
    left = join_groups(every, open_.select("hub", "m", "n_blocks"), "hub", "m").drop("m").unionByName(open_.select("hub", F.col("hub").alias("node"), F.col("hub_comp").alias("comp"), "n_blocks"))
    left = left.withColumn("block", F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int"))
    left = left.join(texts.select("node", "n", "bits"), "node")
    dealt = left.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))).select("hub", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"), "block", "node", "comp", "n", "bits")
    dealt = dealt.repartition(partitions(rooted.sparkSession), "hub", "low", "high").sortWithinPartitions("hub", "low", "high")
    pairs = cut(dealt.mapInArrow(_blocks(percent, best), "a long, b long").distinct(), "pairs", most)
    more = similar(pairs, texts, width, percent)
    # Components of components.
    to = lambda x: rooted.select(F.col("node").alias(x), F.col("comp").alias(f"{x}_comp"))
    merged = components(more.join(to("a"), "a").join(to("b"), "b").select(F.col("a_comp").alias("a"), F.col("b_comp").alias("b")), nodes)
    out = cut(rooted.join(merged.select(F.col("node").alias("comp"), "root"), "comp", "left").select("node", F.coalesce("root", "comp").alias("comp")), "rooted", nodes)
    discard(every, open_, pairs, merged, rooted)
    return out


def jaccard_classes(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, th (a hash of the text), n_shingles, component_id of every row."""
    spark = docs.sparkSession
    rows = pick(docs, "doc_id", "text").selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").withColumn("th", F.xxhash64("text"))
    ids = cut(rows.mapInArrow(_digest(width, percent), "doc_id long, th long, n long, node long, unlucky int"), "sets")
    n_docs = ids.count()
    bad = [r.unlucky for r in ids.where("unlucky is not null").select("unlucky").distinct().collect()]  # bands, a few dozen at most
    finest_for = frozenset(b + i for b in bad for i in (-1, 0, 1))

    signed = rows.select("text").mapInArrow(_sign(width, percent, finest_for), "sig long, node long")
    meet = signed.repartition(partitions(spark), "sig").sortWithinPartitions("sig", "node").mapInArrow(_shared, "node long, hub long")
    shared = cut(meet.groupBy("node", "hub").agg(F.count(F.lit(1)).alias("c")), "shared", 4 * n_docs)

    # Texts and bitmaps of the nodes that share a signature, one row each.
    most = shared.count()
    wanted = shared.select("node").union(shared.select("hub")).distinct()
    at = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    place = ids.where("node is not null").join(wanted, "node", "left_semi").groupBy("node", "n").agg(F.min(at).alias("at")).select("node", "n", F.col("at.doc_id").alias("p_doc"), F.col("at.th").alias("p_th"))
    found = rows.join(place, rows.doc_id.eqNullSafe(place.p_doc) & (rows.th == place.p_th)).dropDuplicates(["doc_id", "th"]).select("node", "n", "text")
    texts = cut(found.mapInArrow(_with_bitmaps(width), "node long, n long, text string, bits binary"), "texts", TEXT * n_docs)

    hubs = shared.groupBy("node").agg(F.min_by("hub", F.struct((-F.col("c")).alias("c"), "hub")).alias("hub"))
    hopeful = cut(allowed(hubs.select(F.col("hub").alias("a"), F.col("node").alias("b")), texts, percent), "hubs", most)
    first = components(similar(hopeful, texts, width, percent), most)
    discard(hopeful)

    # Groups whose nodes still are in different components.
    rooted = cut(wanted.join(first.select("node", "root"), "node", "left").select("node", F.coalesce("root", "node").alias("comp")), "rooted", 2 * most)
    discard(first)
    rooted = regroup(shared, rooted, texts, True, width, percent)
    rooted = regroup(shared, rooted, texts, False, width, percent)

    roots = rooted.withColumnRenamed("comp", "root")
    low = ids.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("low")).join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "low")
    low = cut(low, "roots", n_docs)
    discard(shared, texts, rooted)
    least = low.groupBy("root").agg(F.min("low").alias("component_id"))
    class_of = low.join(least, "root").select("node", "component_id")
    full = ids.where("node is not null").join(class_of, "node").select("doc_id", "th", "n", "component_id")
    empty = ids.where("node is null").select("doc_id", "th", "n", F.col("doc_id").alias("component_id"))
    return full.unionByName(empty).withColumnRenamed("n", "n_shingles")


def jaccard_join(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    return jaccard_classes(docs, width, percent).select("doc_id", "n_shingles", "component_id")
