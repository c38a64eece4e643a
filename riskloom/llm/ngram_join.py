"""N-gram Jaccard join by signature trees.

A document is the set of its distinct four-word runs; two link when their sets' Jaccard
similarity is 0.85 or more. The join is exact and returns each document's component. It
works on distinct sets, so exact copies cost nothing, in four steps:

1. **Counting.** A linked set has at most 15 % of its runs to itself. Runs with a hash in
   the lower half of all hashes are dealt out by hash, packed in arrays, and each set
   learns how many of its own occur elsewhere. Sets with too many lonely runs link with
   nothing and drop out, which leaves the small part of a corpus that repeats itself.
2. **Signatures.** Sets of similar size that link differ in at most d runs, so if hashes
   are split into d + 1 + z parts, more than z parts agree entirely. Each part's content
   hashed is a signature; linked sets share one. Sets with at most z empty parts need no
   signature for those.
3. **Signature trees.** Sets that share signatures, directly or through others, form a
   candidate group, and a set is sent to one group only. In each group a tree is built
   whose nodes hold the OR and the AND of their members' token bitmaps and their range of
   sizes. Two nodes are compared downwards only while the largest possible overlap can
   still reach the threshold; surviving pairs are compared exactly. Pairs that are connected
   already are skipped, so a cluster of n copies costs about n comparisons.
4. **Components** of the links, and of the documents behind each set.

A candidate group too large for one task is taken apart again. A first pass compares its
sets within single signatures of three parts, in blocks that all hold the signature's first
set, and connects nearly everything. Then a group of a few blocks is compared by pairs of
blocks; a larger one by the signatures that still join different components, large ones as
pairs of blocks with different components. No group is ever cut short.

Defined results: texts without words (or null) have an empty set and link with nothing,
each is its own component; a text of one to three words is one run; repeated rows link
with each other; rows with a null id take part and count only for links; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from riskloom.llm import text as T
from riskloom.llm.components import connected_components
from riskloom.session import materialize

WORDS = 4
#: Similarity in hundredths: 100 * intersection >= NEAR * union.
NEAR = 85
#: Hashes below this take part in the counting step.
LOW = np.uint64((1 << 64) // 2)
#: Parts of the counting step at least, and counted runs of a part at most.
LEAST_PARTS, RUNS_PER_PART = 32, 4_000_000
#: Sets compared in one task, and blocks of so many that a group is compared by pairs of.
BLOCK, BLOCKS = 512, 32
#: Bits of the map that keeps most texts without an open set out of a shuffle.
MAP_BITS = 1 << 23
BITS, FANOUT = 1_024, 8


def own_runs(n):
    """Most runs of a set of size n that a linked set may lack."""
    return n - -(-NEAR * n // 100)


def shingle_sets(part: T.Slice) -> tuple[np.ndarray, np.ndarray]:
    """Distinct run hashes of a slice's texts, sorted within each, and n + 1 bounds."""
    part = T.Slice(part.first, part.last, T.LOWER[part.data], part.offsets)
    words = T.split_words(part)
    hashes = T.range_hashes(part.data, words.starts, words.ends)
    runs, first = T.windows(hashes, words.bounds, WORDS)
    owners = words.owners[first]
    few = np.flatnonzero((words.counts > 0) & (words.counts < WORDS))
    if len(few):
        whole = [T.mix(np.array([len(h), *h], np.uint64).cumsum(dtype=np.uint64)).sum(dtype=np.uint64)
                 for h in (hashes[words.bounds[k] : words.bounds[k + 1]] * np.uint64(3) for k in few)]
        runs, owners = np.concatenate([runs, np.array(whole, np.uint64)]), np.concatenate([owners, few])
    order = np.lexsort((runs, owners))
    runs, owners = runs[order], owners[order]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:] != runs[:-1]) | (owners[1:] != owners[:-1])
    runs, owners = runs[new], owners[new]
    return runs, np.searchsorted(owners, np.arange(len(part) + 1))


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def set_ids(runs: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 128-bit id of each set as two numbers (n x 2)."""
    n = np.diff(bounds).astype(np.uint64)
    one = T.mix(_sums(T.mix(runs + np.uint64(1)), bounds) + n)
    two = T.mix(_sums(T.mix(runs ^ np.uint64(0x5555555555555555)), bounds) + n * np.uint64(7))
    return np.stack([one, two], 1)


def _binary(ids: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(ids.astype(">u8"))], pa.binary())


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Set id, size and counted size of each text."""
    for batch in batches:
        for part in T.slices(batch.column("text")):
            runs, bounds = shingle_sets(part)
            n = np.diff(bounds)
            ids = pa.array(_binary(set_ids(runs, bounds)).to_pylist(), pa.binary(), mask=n == 0) if len(n) else pa.array([], pa.binary())
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id").slice(part.first, len(part)),
                "text_key": batch.column("text_key").slice(part.first, len(part)),
                "sid": ids, "n": pa.array(n, pa.int64()), "n_low": pa.array(T.per_text(runs < LOW, bounds), pa.int64()),
            })


def _lonely_runs(texts: DataFrame, total_low: int) -> DataFrame:
    """(short id of a set, number of its counted runs that other sets have too)."""
    parts = max(LEAST_PARTS, -(-total_low // RUNS_PER_PART))
    width = int(LOW) // parts + 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for piece in T.slices(batch.column("text")):
                runs, bounds = shingle_sets(piece)
                short = set_ids(runs, bounds)[:, 0]
                low = runs < LOW
                found.append((np.repeat(short, np.diff(bounds))[low], runs[low]))
            if not found:
                continue
            owners, runs = (np.concatenate(x) for x in zip(*found))
            part = (runs // np.uint64(width)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            owners, runs, part = owners[order], runs[order], part[order]
            cuts = np.searchsorted(part, np.arange(parts + 1))
            rows = []
            for p in range(parts):
                o, r = owners[cuts[p] : cuts[p + 1]], runs[cuts[p] : cuts[p + 1]]
                if not len(o):
                    continue
                heads = np.flatnonzero(np.append(True, o[1:] != o[:-1]))
                rows.append((p, o[heads].tobytes(), np.diff(np.append(heads, len(o))).astype(np.int32).tobytes(), r.tobytes()))
            if rows:
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["part", "sets", "sizes", "runs"]
                )

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        sets = np.frombuffer(b"".join(frame["sets"]), np.uint64)
        sizes = np.frombuffer(b"".join(frame["sizes"]), np.int32)
        runs, owners = np.frombuffer(b"".join(frame["runs"]), np.uint64), np.repeat(sets, sizes)
        order = np.lexsort((owners, runs))
        runs, owners = runs[order], owners[order]
        new = np.ones(len(runs), bool)  # exact copies bring the same run of the same set again
        new[1:] = (runs[1:] != runs[:-1]) | (owners[1:] != owners[:-1])
        runs, owners = runs[new], owners[new]
        same = runs[1:] == runs[:-1]
        shared = np.append(same, False) | np.append(False, same)
        short, n = np.unique(owners[shared], return_counts=True)
        del runs, owners, order, new, same, shared
        T.give_back()
        return pd.DataFrame({"short": short.view(np.int64), "shared": n.astype(np.int64)})

    dealt = texts.select("text").mapInArrow(deal, "part long, sets binary, sizes binary, runs binary")
    counted = dealt.groupBy("part").applyInPandas(count, "short long, shared long")
    return counted.groupBy("short").agg(F.sum("shared").alias("shared"))


def size_classes(largest: int) -> list[tuple[int, int, int, int]]:
    """(smallest size, largest size, parts, z) of classes up to ``largest``; linked sets are at most one class apart."""
    out, low = [], 1
    while low <= largest:
        high = low * 100 // NEAR
        differ = (100 - NEAR) * (high + high * 100 // NEAR) // (100 + NEAR)
        z = 1 + (differ + 1) // 16
        out.append((low, high, differ + 1 + z, z))
        low = high + 1
    return out


def signatures(runs: np.ndarray, classes: list[tuple[int, int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of one set, and whether each belongs to the first pass."""
    own = next(k for k, c in enumerate(classes) if c[0] <= len(runs) <= c[1])
    found, early = [], []
    for k in (own - 1, own):
        if k < 0:
            continue
        _, _, parts, z = classes[k]
        at = (T.mix(runs ^ np.uint64(0xA5A5A5A5A5A5A5A5)) % np.uint64(parts)).astype(np.int64)
        sums = np.zeros(parts, np.uint64)
        np.add.at(sums, at, T.mix(runs + np.uint64(77)))
        filled = np.bincount(at, minlength=parts) > 0
        keep = np.arange(parts) if parts - filled.sum() > z else np.flatnonzero(filled)
        found.append(T.mix(sums[keep] + T.mix(keep.astype(np.uint64) + np.uint64(k << 32))))
        early.append((keep < 3) & filled[keep])
    return np.concatenate(found), np.concatenate(early)


class SignatureTree:
    """A tree over sets: bitmaps of runs combined by OR and AND, and ranges of sizes."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        sizes = np.array([len(s) for s in sets])
        bitmaps = np.zeros((len(sets), BITS // 64), np.uint64)
        for row, s in zip(bitmaps, sets):
            bit = s % np.uint64(BITS)
            np.bitwise_or.at(row, (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
        # Sets with equal small hashes are likely to be alike; they become neighbours.
        self.order = np.lexsort((sizes, [s[0] for s in sets]))
        sizes, bitmaps = sizes[self.order], bitmaps[self.order]
        self.levels = [(bitmaps, bitmaps, sizes, sizes)]
        while len(self.levels[-1][2]) > 1:
            union, common, low, high = self.levels[-1]
            at = np.arange(0, len(low), FANOUT)
            self.levels.append((
                np.bitwise_or.reduceat(union, at), np.bitwise_and.reduceat(common, at),
                np.minimum.reduceat(low, at), np.maximum.reduceat(high, at),
            ))

    def possible(self, level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which node pairs may hold a linked pair, by sizes and by the largest possible overlap."""
        union, common, low, high = self.levels[level]
        wanted = -(-NEAR * (low[i] + low[j]) // (100 + NEAR))
        missing_i = np.bitwise_count(common[i] & ~union[j]).sum(1, dtype=np.int64)
        missing_j = np.bitwise_count(common[j] & ~union[i]).sum(1, dtype=np.int64)
        overlap = np.minimum(high[i] - missing_i, high[j] - missing_j)
        return (overlap >= wanted) & (100 * high[i] >= NEAR * low[j]) & (100 * high[j] >= NEAR * low[i])

    def candidates(self) -> Iterator[tuple[int, int]]:
        """Pairs of sets left by the dual traversal, as positions in ``sets``."""
        todo = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while todo:
            level, i, j = todo.pop()
            ok = self.possible(level, i, j) if level else (i < j) & self.possible(0, i, j)
            i, j = i[ok], j[ok]
            if level == 0:
                yield from zip(self.order[i].tolist(), self.order[j].tolist())
                continue
            n = len(self.levels[level - 1][2])
            step = np.arange(FANOUT)
            for k in range(0, len(i), 2_048):  # keep the frontier small
                a = i[k : k + 2_048, None, None] * FANOUT + step[:, None] + 0 * step
                b = j[k : k + 2_048, None, None] * FANOUT + step + 0 * step[:, None]
                use = (a < n) & (b < n) & (a <= b)
                todo.append((level - 1, a[use], b[use]))


def linked(one: np.ndarray, two: np.ndarray) -> bool:
    both = len(np.intersect1d(one, two, assume_unique=True))
    return 100 * both >= NEAR * (len(one) + len(two) - both)


def tree_links(sets: list[np.ndarray], components: list, sides: list) -> list[tuple[int, int]]:
    """Linked pairs of different sides that join different components; enough to connect all that link."""
    parent: dict = {}

    def root(c):
        while parent.setdefault(c, c) != c:
            parent[c] = c = parent[parent[c]]
        return c

    out = []
    for a, b in SignatureTree(sets).candidates():
        if sides[a] == sides[b]:
            continue
        x, y = root(components[a]), root(components[b])
        if x != y and linked(sets[a], sets[b]):
            parent[x] = y
            out.append((a, b))
    return out


def _solve(members: DataFrame, sets: DataFrame, components: DataFrame | None = None) -> DataFrame:
    """Links (a, b) found in the groups of ``members`` (grp, id, and side if only pairs across sides count)."""
    if "side" not in members.columns:
        members = members.withColumn("side", F.col("id"))
    rows = members.join(sets.select("id", "runs"), "id")
    if components is None:
        rows = rows.withColumn("component", F.col("id"))
    else:
        rows = rows.join(components, rows["id"] == components["node"], "left").withColumn("component", F.coalesce("component", "id"))
    rows = rows.select("grp", "id", "runs", "component", "side").repartition("grp").sortWithinPartitions("grp")

    def solve(frame: pd.DataFrame) -> list[tuple[int, int]]:
        ids = frame["id"].tolist()
        pairs = tree_links([np.frombuffer(r, np.uint64) for r in frame["runs"]], frame["component"].tolist(), frame["side"].tolist())
        return [(ids[a], ids[b]) for a, b in pairs]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for frame in frames:
            if not len(frame):
                continue
            key = frame["grp"].to_numpy()
            cuts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            found = []
            for low, high in zip(cuts, np.append(cuts[1:], len(frame))):
                if held and held[0]["grp"].iloc[0] != key[low]:
                    found += solve(pd.concat(held))
                    held = []
                held.append(frame.iloc[low:high])
            yield pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)
        if held:
            yield pd.DataFrame(solve(pd.concat(held)), columns=["a", "b"], dtype=np.int64)

    return rows.mapInPandas(run, "a long, b long")


def _memberships(rows: DataFrame, *more) -> DataFrame:
    """Signatures with their number of members, one for each distinct membership."""
    groups = rows.groupBy("sig").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.bit_xor(F.xxhash64("id")).alias("check"), *more)
    if more:
        groups = groups.where("low <> high")
    groups = groups.where("n > 1")
    once = groups.groupBy("n", "first", "check").agg(F.min("sig").alias("sig"))
    return once.select("sig", "n", "first")


def _first_pass(shared: DataFrame) -> DataFrame:
    """Members (grp, id) of the signatures of three parts; large ones in blocks that share their first set."""
    early = shared.where("early").select("sig", "id")
    groups = _memberships(early)
    rows = early.join(groups, "sig").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("long"))
    block = F.pmod(F.xxhash64("id"), "blocks")
    own = rows.select(F.xxhash64("sig", block).alias("grp"), "id")
    firsts = groups.where(F.col("n") > BLOCK).select(
        "sig", F.col("first").alias("id"), F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / BLOCK) - 1)).alias("block")
    )
    return own.union(firsts.select(F.xxhash64("sig", F.col("block").cast("long")).alias("grp"), "id")).distinct()


def _second_pass(shared: DataFrame, components: DataFrame) -> DataFrame:
    """Members (grp, id) of all signatures that still hold different components."""
    rows = shared.join(components, shared["id"] == components["node"], "left")
    rows = materialize(rows.select("sig", "id", F.coalesce("component", "id").alias("component")), "labelled")
    groups = _memberships(rows, F.min("component").alias("low"), F.max("component").alias("high"))
    rows = materialize(rows.join(groups, "sig"), "open-groups")
    small = rows.where(F.col("n") <= BLOCK).select(F.xxhash64("sig", F.lit(0).cast("long")).alias("grp"), "id")
    large = rows.where(F.col("n") > BLOCK)
    # Blocks: of one component if it is large, of several small components otherwise.
    inside = large.groupBy("sig", "component").agg(F.count("*").alias("m"), F.first("n").alias("n"))
    block = F.when(F.col("m") >= BLOCK, F.xxhash64("component", F.pmod(F.xxhash64("id"), F.ceil(F.col("m") / BLOCK)))).otherwise(
        F.pmod(F.xxhash64("component"), F.ceil(F.col("n") / BLOCK))
    )
    blocked = large.drop("n").join(inside, ["sig", "component"]).select(
        "sig", "id", block.alias("block"), F.when(F.col("m") >= BLOCK, F.col("component")).alias("only")
    )
    each = blocked.groupBy("sig", "block").agg(F.first("only").alias("only"))
    pairs = each.alias("x").join(each.alias("y"), F.expr("x.sig = y.sig and x.block <= y.block and not (x.only <=> y.only and x.only is not null)"))
    pairs = pairs.select(F.col("x.sig").alias("sig"), F.col("x.block").alias("p"), F.col("y.block").alias("q"))
    sides = pairs.select("sig", F.col("p").alias("block"), "p", "q").union(pairs.select("sig", F.col("q").alias("block"), "p", "q"))
    crossed = blocked.join(sides, ["sig", "block"]).select(F.xxhash64("sig", "p", "q").alias("grp"), "id").distinct()
    return small.union(crossed)


def _links(found: DataFrame, marked: DataFrame) -> DataFrame:
    """All links needed to connect the sets (id, runs) that link, from their signatures (sig, id, early)."""
    groups = marked.groupBy("sig").agg(F.count("*").alias("n"), F.min("id").alias("first")).where("n > 1")
    shared = materialize(marked.join(groups.drop("n"), "sig"), "shared-signatures")
    near = connected_components(shared.select(F.col("id").alias("a"), F.col("first").alias("b")))
    sizes = near.groupBy("component").agg(F.count("*").alias("size"))
    near = materialize(near.join(sizes, "component").select(F.col("node").alias("id"), F.col("component").alias("grp"), "size"), "candidates")
    links = materialize(_solve(near.where(F.col("size") <= BLOCK).select("grp", "id"), found), "links")
    large = near.where(F.col("size") > BLOCK)
    if large.isEmpty():
        return links
    shared = materialize(shared.drop("first").join(large.select("id"), "id", "left_semi"), "large-candidates")
    first = materialize(_solve(_first_pass(shared), found), "first-links")
    components = connected_components(first)
    few = large.where(F.col("size") <= BLOCK * BLOCKS)
    second = materialize(_solve(_block_pairs(few), found, components), "second-links")
    links = links.union(first).union(second)
    many = large.where(F.col("size") > BLOCK * BLOCKS)
    if many.isEmpty():
        return links
    shared = shared.join(many.select("id"), "id", "left_semi")
    return links.union(materialize(_solve(_second_pass(shared, components), found, components), "third-links"))


def _block_pairs(large: DataFrame) -> DataFrame:
    """Members (grp, id, side) of all pairs of blocks of each candidate group (id, grp, size)."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("long")
    rows = large.withColumn("own", F.pmod(F.xxhash64("id"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    return rows.select(
        F.xxhash64("grp", F.least("own", "other"), F.greatest("own", "other")).alias("grp"), "id",
        F.when(F.col("own") == F.col("other"), F.col("id")).otherwise(F.col("own")).alias("side"),
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Every row's doc_id, text_key, n_shingles, component_id, and whether it stands for its component.

    ``component_id`` is the smallest doc_id reachable by links. Rows that stand for a
    component may repeat if the table repeats a row; texts without words all stand for themselves.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("text_key", F.xxhash64("text"))
    rows = texts.mapInArrow(_describe, "doc_id long, text_key long, sid binary, n long, n_low long")
    rows = materialize(rows, "sets")
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")
    sets = rows.where("sid is not null").groupBy("sid").agg(
        F.max("n").alias("n"), F.max("n_low").alias("n_low"), F.min("doc_id").alias("smallest"), F.min(place).alias("place")
    )
    sets = materialize(sets, "distinct-sets")
    total_low = sets.agg(F.coalesce(F.sum("n_low"), F.lit(0))).first()[0]
    largest = sets.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]

    counted = _lonely_runs(texts, total_low)
    spare = F.col("n") - F.ceil(F.lit(NEAR) * F.col("n") / 100)
    short = F.conv(F.hex(F.substring("sid", 1, 8)), 16, -10).cast("long")
    # A set of six may lack nothing, but a set of seven that holds it links; smaller ones link with equal sets only.
    can_link = 100 * F.col("n") >= NEAR * (F.col("n") + 1)
    open_sets = sets.where(can_link).withColumn("short", short).join(counted, "short", "left")
    open_sets = open_sets.where(F.col("n_low") - F.coalesce("shared", F.lit(0)) <= spare).select("sid", "place")
    open_sets = materialize(open_sets, "still-open")

    found = materialize(_with_runs(texts, open_sets), "open-sets")  # ids are fixed by this
    classes = size_classes(largest)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, runs = batch.column("id"), batch.column("runs")
            for low in range(0, batch.num_rows, 256):  # a set has about a third as many signatures as runs
                some = [signatures(np.frombuffer(r.as_buffer(), np.uint64), classes) for r in runs.slice(low, 256)]
                owner = np.repeat(np.arange(low, low + len(some)), [len(s) for s, _ in some])
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([s for s, _ in some]).view(np.int64)), ids.take(pa.array(owner)),
                    pa.array(np.concatenate([e for _, e in some])),
                ], names=["sig", "id", "early"])

    marked = materialize(found.select("id", "runs").mapInArrow(mark, "sig long, id long, early boolean"), "signatures")
    components = connected_components(_links(found, marked))
    # From set numbers back to set ids; a component is named by one of its sets.
    components = components.join(found.select(F.col("id").alias("node"), "sid"), "node")
    components = components.select(F.col("sid").alias("node"), F.col("component"))

    named = sets.join(components, sets["sid"] == components["node"], "left")
    named = named.select("sid", "smallest", "place", F.coalesce(F.col("component").cast("string").cast("binary"), "sid").alias("component"))
    heads = named.groupBy("component").agg(F.min("smallest").alias("component_id"), F.min("place").alias("place"))
    named = named.drop("place").join(heads, "component").select("sid", "component_id", "place")
    out = rows.join(named, "sid", "left")
    empty = F.col("sid").isNull()
    stands = empty | (F.col("doc_id").eqNullSafe(F.col("place.doc_id")) & (F.col("text_key") == F.col("place.text_key")))
    return out.select(
        "doc_id", "text_key", F.col("n").alias("n_shingles"),
        F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), stands.alias("stands"),
    )


def _with_runs(texts: DataFrame, open_sets: DataFrame) -> DataFrame:
    """(id, sid, runs) of the sets that are still open, runs packed."""
    wanted = open_sets.select(F.col("place.doc_id").alias("id"), F.col("place.text_key").alias("key"))
    # A bitmap of fixed size lets most other texts go before the shuffle; the join decides.
    bit = F.pmod("key", F.lit(MAP_BITS))
    words = wanted.groupBy(F.floor(bit / 64).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, int(pmod(key, {MAP_BITS}) % 64))")).alias("bits"))
    bitmap = np.zeros(MAP_BITS // 64, np.uint64)
    for row in words.collect():
        bitmap[row["word"]] = np.uint64(row["bits"] & (2**64 - 1))

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.mod(batch.column("text_key").to_numpy(zero_copy_only=False), MAP_BITS).astype(np.uint64)
            there = bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)
            yield batch.filter(pa.array(there > 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            for part in T.slices(batch.column("text")):
                runs, bounds = shingle_sets(part)
                ids = _binary(set_ids(runs, bounds)).to_pylist()
                new = [k for k, i in enumerate(ids) if i != (ids[k - 1] if k else last)]  # repeated rows are neighbours
                last = ids[-1]
                raw, b = runs.tobytes(), bounds.tolist()
                yield pa.RecordBatch.from_arrays([
                    pa.array([ids[k] for k in new], pa.binary()), pa.array([raw[8 * b[k] : 8 * b[k + 1]] for k in new], pa.binary()),
                ], names=["sid", "runs"])

    some = texts.mapInArrow(likely, texts.schema)
    same = some["doc_id"].eqNullSafe(wanted["id"]) & (some["text_key"] == wanted["key"])
    kept = some.join(wanted.hint("merge"), same, "left_semi")
    return kept.select("text").mapInArrow(run, "sid binary, runs binary").withColumn("id", F.monotonically_increasing_id())


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component, with all its columns."""
    places = near_duplicates(docs).where("stands").groupBy("doc_id", "text_key").agg(
        F.max("n_shingles").alias("n"), F.count("*").alias("copies")
    )
    places = materialize(places.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), "n", "copies"), "places")
    keyed = docs.withColumn("__key_of_text", F.xxhash64(F.coalesce("text", F.lit(""))))

    def at(side: DataFrame, how: str) -> DataFrame:
        same = keyed["doc_id"].cast("long").eqNullSafe(side["__id"]) & (keyed["__key_of_text"] == side["__key"])
        return keyed.join(side, same, how)

    # Texts are shuffled once; only rows that repeat with their id are dealt out again.
    repeated = places.where("n > 0 AND copies > 1")
    if repeated.isEmpty():
        kept = at(places, "left_semi")
    else:
        single = at(places.where("n = 0 OR copies = 1"), "left_semi")
        kept = single.unionByName(at(repeated, "left_semi").dropDuplicates(["doc_id", "__key_of_text"]))
    return kept.drop("__key_of_text")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")
