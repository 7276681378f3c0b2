"""Near-duplicate documents by an LSH forest over MinHash signatures.

Each text gives its set of distinct 4-word shingles (A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``)
and one MinHash signature.  Texts with the same set are one class, so copies cost one row.  The
forest holds several trees; a tree orders all classes by its own slice of the signature, and rows that
share a prefix of it lie together.

*Depth by region.*  A region is what shares the first four values of a slice.  Where more than ``CROWDED``
classes do, it is cut by longer and longer prefixes until its parts are no larger; classes whose prefixes
part there are no neighbours in that tree.  What that loses is made up by more trees: classes that were
still crowded at eight values are ordered again by slices that begin in between.  A part that stays crowded
under the whole slice holds sets that are nearly equal; it is dealt in blocks, its least member in each.

*Candidates.*  In each part classes are compared by their whole signatures, and those that agree nearly as
much as a link asks for are tied, by a spanning set.  Boilerplate that fills a region thus ties nothing.

*Confirmation* is on the full sets, exactly and without all pairs (``confirm``).  What hangs together by ties
is a cluster, and a task confirms clusters of at most ``BLOCK_SHINGLES`` shingles.  Of a larger one, texts that share too
little with all others to link with any are set apart, and the rest goes by blocks of that size: it is cut in several of the forest's orders, as above, each block is confirmed, and
the hubs of all blocks, which stand for what they cover, are confirmed with one another in further rounds.
What is then still apart in a cluster is settled exactly (``_across``): where it is little beside the main component, it
meets all of that, block by block; elsewhere the shingles of its texts are counted, and
a text's rarest ones, as many as every partner must share one of, are its prefix.  Texts that share one are compared
wherever they are not yet known to be connected, in blocks of the same size; so the size of a cluster changes
the work, not the result.

Measured: the tests plant pairs at 0.80 to 0.85 among 1,200 texts that share most of their words, where a
region is crowded; 0.97 of the pairs or more must be found.

Defined results: null and blank texts have an empty set and link with nothing; texts of one to
three words have one shingle; a text of any length is taken whole; repeated rows get the same component;
a null doc_id takes part and never names a component; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.graph import components, spanning
from quarry.llm.textkernel import MIX, U64, mix64, release, releasing, shingle_sets, steps, text_arrays
from quarry.scratch import joined, staged

#: Trees, the values of a slice, and the prefixes under which rows are neighbours: the first one, and those
#: by which crowded regions are cut.
TREES, DEPTH, FIRST_DEPTH, DEPTHS = 16, 16, 4, (6, 8, 10, 12, 14, 16)
VALUES = TREES * DEPTH
CROWDED = 256
#: Where the slices of the further trees begin, and from which depth on crowded classes need them.
BETWEEN, SHALLOW = [x for x in range(0, VALUES, 4) if x % DEPTH], 8
#: Shingles whose sets one task confirms at once, and the orders in which larger clusters are cut.
BLOCK_SHINGLES, ORDERS, HUB_ROUNDS = 1 << 21, 4, 8
#: Sets of a group after which a worker gives memory back.
LARGE = 256
#: Rows up to which a table is sent to all executors.
MOST_SENT = 300_000
WIDTH, NUM, DEN = 4, 80, 100
SKETCH = "doc_id long, key binary, n_shingles long, node binary, keys array<long>, sig binary, packed binary"


def _salts(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(77)
    return rng.integers(0, 2**63, n, dtype=U64) * U64(2) + U64(1), rng.integers(0, 2**63, n, dtype=U64)


def digest(shingles: np.ndarray) -> bytes:
    """128 bits of a shingle set: two sums of independent mixes, and so free of order."""
    with np.errstate(over="ignore"):
        a, b = mix64(shingles ^ MIX[2]).sum(dtype=U64), mix64(shingles * MIX[3] + MIX[4]).sum(dtype=U64)
    return int(a).to_bytes(8, "big") + int(b).to_bytes(8, "big")


def signature(shingles: np.ndarray, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    """Minima of ``len(mul)`` multiply-add hashes, 32 bits each."""
    least = np.full(len(mul), np.iinfo(U64).max, U64)
    for i in range(0, len(shingles), 512):
        np.minimum(least, (shingles[i : i + 512, None] * mul + add).min(axis=0), out=least)
    return least >> U64(32)


def region_keys(sig: np.ndarray) -> np.ndarray:
    """For each tree a hash of its number and its first four values."""
    v = sig.reshape(TREES, DEPTH)
    pair = (v[:, 0] << U64(32)) | v[:, 1], (v[:, 2] << U64(32)) | v[:, 3]
    return mix64(mix64(pair[0] + np.arange(TREES, dtype=U64) * MIX[3]) ^ (pair[1] * MIX[1])).astype(np.int64)


def _sketcher(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mul, add = _salts(VALUES)
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            raw, offs = text_arrays(batch.column(2))
            for i, j in steps(offs):
                part, at = raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                sets = shingle_sets(part, at, width)
                sigs = [signature(s, mul, add) if len(s) else None for s in sets]
                # one byte of each value tells signatures apart; the first slice follows the last one
                small = [None if x is None else np.concatenate([x, x[:DEPTH]]).astype(np.uint8).tobytes() for x in sigs]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        batch.column(1).slice(i, j - i),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([digest(s) if len(s) else None for s in sets], pa.binary()),
                        pa.array([None if x is None else region_keys(x) for x in sigs], pa.list_(pa.int64())),
                        pa.array(small, pa.binary()),
                        pa.array([press.compress(part[at[k] : at[k + 1]].tobytes()) if len(s) else None for k, s in enumerate(sets)], pa.binary()),
                    ],
                    names=["doc_id", "key", "n_shingles", "node", "keys", "sig", "packed"],
                )

    return releasing(run)


def agreement(num: int, den: int) -> int:
    """Equal bytes of two signatures that a link at num/den has but once in 400,000 cases."""
    p = num / den + (1 - num / den) / 256
    return int(VALUES * p - 4.6 * (VALUES * p * (1 - p)) ** 0.5)


def _tied(least: int):
    """Spanning ties (u, v) within each region of rows (region, node, sig) that come sorted by region."""

    def within(region: np.ndarray, nodes: pa.Array, sig: np.ndarray) -> pa.RecordBatch:
        root = np.arange(len(region))
        for o in range(1, len(region)):
            u = np.flatnonzero(region[o:] == region[:-o])
            if not len(u):
                break
            u = u[root[u] != root[u + o]]
            u = u[np.count_nonzero(sig[u] == sig[u + o], axis=1) >= least]
            for k in u:
                a, b = int(k), int(k + o)
                while root[a] != a:
                    a = int(root[a])
                while root[b] != b:
                    b = int(root[b])
                root[max(a, b)] = min(a, b)
            while len(u) and not np.array_equal(root, up := root[root]):
                root = up
        v = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([nodes.take(pa.array(root[v])), nodes.take(pa.array(v))], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([batch])]).combine_chunks()
            region = table.column("region").to_numpy()
            # the last region may go on in the next batch
            cut = int(np.searchsorted(region, region[-1]))
            if cut:
                yield from done(table.slice(0, cut))
            kept = table.slice(cut)
        if kept is not None:
            yield from done(kept)

    def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
        region, nodes = table.column("region").to_numpy(), table.column("node").combine_chunks()
        sig = np.frombuffer(b"".join(x.as_py()[:VALUES] for x in table.column("sig")), np.uint8).reshape(len(region), VALUES)
        edges = np.flatnonzero(np.concatenate([[True], region[1:] != region[:-1], [True]]))
        i = 0
        while i < len(edges) - 1:  # some thousand rows at once, in whole regions
            j = max(i + 1, int(np.searchsorted(edges, edges[i] + 4096, "right")) - 1)
            a, b = int(edges[i]), int(edges[j])
            yield within(region[a:b], nodes.slice(a, b - a), sig[a:b])
            i = j

    return releasing(run)


def cut(rows: DataFrame, depths: tuple[int, ...], weight: str, limit: int, name: str) -> tuple[DataFrame, DataFrame | None]:
    """(region, node) of rows (base, off, node, sig, ...): regions of at most ``limit`` of ``weight``.

    A region is what shares ``base`` and the shortest of the prefixes, from byte ``off`` of the signature, that is
    short enough; rows alone in theirs are left out.  What is still too much under the longest prefix is
    dealt in blocks, with the least node in each.  The second table is what was too much at ``SHALLOW``.
    """
    parts, deep, left = [], None, rows
    for depth in depths:
        left = left.withColumn("region", F.expr(f"xxhash64(base, {depth}, substring(sig, off + 1, {depth}))"))
        sizes = left.groupBy("region").agg(F.sum(weight).cast("double").alias("w"), F.count("*").alias("n"), F.min("node").alias("least")).where("n > 1")
        inside = staged(left.join(sizes, "region"), name)
        parts.append(inside.where(F.col("w") <= limit).select("region", "node"))
        over = inside.where(F.col("w") > limit)
        if over.isEmpty():
            break
        if depth == SHALLOW:
            deep = over.select("node").distinct()
        if depth == depths[-1]:
            blocks = f"cast(ceil(w / {limit}) as int)"
            parts.append(over.selectExpr(f"xxhash64(region, pmod(xxhash64(node), {blocks})) as region", "node"))
            heads = over.groupBy("region", "least").agg(F.first("w").alias("w"))
            parts.append(heads.selectExpr("region as whole", "least", f"explode(sequence(0, {blocks} - 1)) as block").selectExpr("xxhash64(whole, block) as region", "least as node"))
        left = over.drop("region", "w", "n", "least")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct() if len(parts) > 1 else out, deep


def candidate_ties(classes: DataFrame, num: int = NUM, den: int = DEN, crowded: int = CROWDED) -> DataFrame:
    """(u, v): spanning ties between neighbours in the trees whose signatures agree; classes (node, keys, sig) staged."""
    rows = classes.select("node", F.posexplode("keys").alias("tree", "base"))
    sizes = rows.groupBy("base").agg(F.count("*").alias("n")).where("n > 1")
    inside = staged(rows.join(sizes, "base"), "forest-regions", codec="lz4")
    regions = inside.where(F.col("n") <= crowded).select(F.col("base").alias("region"), "node")
    over = inside.where(F.col("n") > crowded)
    if not over.isEmpty():
        signed = over.join(classes.select("node", "sig"), "node").selectExpr("base", f"tree * {DEPTH} as off", "node", "sig", "1 as one")
        parts, deep = cut(signed, DEPTHS, "one", crowded, "forest-crowded")
        regions = regions.unionByName(parts)
        if deep is not None:
            again = classes.join(deep, "node").select("node", "sig", F.explode(F.array(*map(F.lit, BETWEEN))).alias("off")).selectExpr("cast(off as long) as base", "off", "node", "sig", "1 as one")
            regions = regions.unionByName(cut(again, tuple(d for d in DEPTHS if d >= SHALLOW), "one", crowded, "forest-between")[0])
    rows = regions.join(classes.select("node", "sig"), "node").select("region", "node", "sig")
    ties = rows.repartition("region").sortWithinPartitions("region").mapInArrow(_tied(agreement(num, den)), "u binary, v binary")
    return staged(ties.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "forest-ties")


def linked(common: np.ndarray, size: np.ndarray, other: int | np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether den * |A & B| >= num * |A | B|."""
    return den * common >= num * (size + other - common)


def confirm(sets: list[np.ndarray], num: int = NUM, den: int = DEN) -> np.ndarray:
    """For each set the number of the first set of its component under Jaccard >= num/den; exact."""
    return confirm_with_hubs(sets, num, den)[0]


def _possible(size: np.ndarray, ids: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which sets may link with another: of what they share with any, a set of some size that is there could hold enough.

    A link of sets of sizes s and t has (num + den) * common >= num * (s + t), and t is at least s * num / den.  What is left out
    makes others' shingles rarer, so this goes on until nothing changes.
    """
    owner, alive = np.repeat(np.arange(len(size)), size), np.ones(len(size), bool)
    while True:
        held = np.bincount(ids[alive[owner]], minlength=int(ids.max()) + 1)
        shared = np.bincount(owner[held[ids] > 1], minlength=len(size))
        sizes, times = np.unique(size[alive], return_counts=True)
        # the least size that a partner can have; where it is the set's own, another must have it too
        at = np.searchsorted(sizes, -(-size * num // den))
        alone = (at < len(sizes)) & (sizes[np.minimum(at, len(sizes) - 1)] == size) & (times[np.minimum(at, len(sizes) - 1)] == 1)
        at = at + alone
        least = np.append(sizes, np.iinfo(np.int64).max // (2 * den))[np.minimum(at, len(sizes))]
        left = alive & ((num + den) * shared >= num * (size + least))
        if left.sum() == alive.sum() or not left.any():
            return left
        alive = left


def confirm_with_hubs(sets: list[np.ndarray], num: int = NUM, den: int = DEN) -> tuple[np.ndarray, np.ndarray]:
    """As ``confirm``, and which sets are hubs; one that can link with nothing is its own."""
    size = np.array([len(s) for s in sets], np.int64)
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    able = _possible(size, ids, num, den)
    comp, hubs = np.arange(len(sets)), ~able
    if able.any():
        among = np.flatnonzero(able)
        found, own = _covered(size[able], ids[np.repeat(able, size)], num, den)
        comp[among], hubs[among] = among[found], own
    return comp, hubs


def _covered(size: np.ndarray, ids: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Components and hubs of sets of numbers, by their sizes and their members one set after the other.

    Hubs are taken in order, those first whose members most sets hold, so that the middle of a crowd covers it; a hub is
    compared with all sets in one vectorised pass, and every set that links with it is covered.  A set that no hub covers
    becomes a hub itself.  So each link has two covered ends.  Jaccard distance is a metric: a link between the covers of hubs
    g and h needs both ends within twice the link distance of the other hub, and only such sets are compared, and only while
    g and h are apart.
    """
    n = len(size)
    at = np.concatenate([[0], np.cumsum(size)])
    mark = np.zeros(int(ids.max()) + 1, bool)
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def union(x: int, y: int) -> None:
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)

    def common(i: int, members: np.ndarray, starts: np.ndarray) -> np.ndarray:
        mark[own := ids[at[i] : at[i + 1]]] = True
        got = np.add.reduceat(mark[members], starts, dtype=np.int64)
        mark[own] = False
        return got

    far = 2 * (1 - num / den) + 1e-9
    cover = np.full(n, -1, np.int64)
    near: dict[int, np.ndarray] = {}
    crowd = np.add.reduceat(np.bincount(ids)[ids], at[:-1]) / size
    for i in np.lexsort((-size, -crowd)):
        i = int(i)
        if cover[i] >= 0:
            continue
        c = common(i, ids, at[:-1])
        hit = linked(c, size, size[i], num, den)
        for k in np.flatnonzero(hit):
            union(i, int(k))
        cover[hit & (cover < 0)] = i
        near[i] = np.flatnonzero(1 - c / (size + size[i] - c) <= far)
    for g, wide in near.items():
        for h in {int(x) for x in cover[wide]}:
            if h <= g or find(g) == find(h):  # the pair (h, g) asks for the same
                continue
            few, many = near[h][cover[near[h]] == g], wide[cover[wide] == h]
            if not len(few):
                continue
            if len(few) > len(many):
                few, many = many, few
            members, starts = np.concatenate([ids[at[k] : at[k + 1]] for k in many]), np.concatenate([[0], np.cumsum(size[many])])[:-1]
            for u in few:
                if linked(common(int(u), members, starts), size[many], size[u], num, den).any():
                    union(g, h)
                    break
    hubs = np.zeros(n, bool)
    hubs[list(near)] = True
    return np.array([find(x) for x in range(n)]), hubs


def _unpack(column: pa.Array, width: int) -> list[np.ndarray]:
    press = zstandard.ZstdDecompressor()
    texts = [press.decompress(x.as_py()) for x in column]
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    return shingle_sets(np.frombuffer(b"".join(texts), np.uint8), offs, width)


def _confirmer(width: int, num: int, den: int):
    """For rows (node, packed) of one group: node, the first node of its component here, and whether it is a hub."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        group = group.take(pa.compute.sort_indices(group, [("node", "ascending")]))
        nodes = group.column("node").combine_chunks()
        found, hubs = confirm_with_hubs(_unpack(group.column("packed").combine_chunks(), width), num, den)
        if len(found) > LARGE:
            release()
        return pa.table({"node": nodes, "comp": nodes.take(pa.array(found)), "hub": pa.array(hubs)}).cast(pa.schema([("node", pa.binary()), ("comp", pa.binary()), ("hub", pa.bool_())]))

    return run


def _confirmed_in_blocks(rows: DataFrame, texts: DataFrame, width: int, num: int, den: int, block: int) -> DataFrame:
    """(node, comp) of clusters that no task holds: rows (cluster, node, n_shingles, sig), texts (node, packed)."""
    confirmer, made = _confirmer(width, num, den), "node binary, comp binary, hub boolean"
    nodes = rows.select("node").distinct()
    shingles = staged(rows.select("cluster", "node").join(texts, "node").select("cluster", "node", "packed").mapInArrow(_shingler(width), "cluster binary, node binary, shingle long"), "forest-shingles")
    rows = _able(rows, shingles, num, den)
    named = rows.withColumn("base", F.xxhash64("cluster"))
    links, hubs = None, None
    for order in range(ORDERS):
        regions, _ = cut(named.withColumn("off", F.lit(order * VALUES // ORDERS)), (2, 4, 8, 16), "n_shingles", block, "forest-blocks")
        found = staged(regions.join(texts, "node").groupBy("region").applyInArrow(confirmer, made), "forest-confirmed")
        links = found.select("node", "comp") if links is None else links.unionByName(found.select("node", "comp"))
        if order == 0:  # what is alone in its region stands for itself
            covered = found.groupBy("node").agg(F.max("hub").alias("hub"))
            hubs = staged(named.join(covered, "node", "left").where("coalesce(hub, true)").select("base", "node", "n_shingles"), "forest-hubs")
    for turn in range(HUB_ROUNDS):
        sizes = hubs.groupBy("base").agg(F.sum("n_shingles").alias("w"))
        blocks = hubs.join(sizes, "base").selectExpr("base", f"xxhash64(base, pmod(xxhash64({turn}, node), cast(ceil(w / {block}) as int))) as region", "node", "n_shingles")
        found = staged(blocks.join(texts, "node").select("region", "node", "packed").groupBy("region").applyInArrow(confirmer, made), "forest-hub-round")
        links = links.unionByName(found.select("node", "comp"))
        if sizes.where(F.col("w") > block).isEmpty():
            break
        fewer = staged(hubs.join(found.where("hub").select("node"), "node").select("base", "node", "n_shingles"), "forest-hubs")
        if fewer.count() > 0.9 * hubs.count():  # hubs that cover nothing
            break
        hubs = fewer

    def connected(pairs: DataFrame) -> DataFrame:
        comps = components(pairs.where("node <> comp").select(F.col("comp").alias("u"), F.col("node").alias("v")).distinct(), "forest-large")
        return staged(nodes.join(comps, "node", "left").select("node", F.coalesce("comp", "node").alias("comp")), "forest-connected")

    comps = connected(links)
    more = _across(rows, comps, texts, shingles, width, num, den, block)
    return comps if more is None else connected(comps.unionByName(more))


def _shingler(width: int):
    """(cluster, node, shingle) of every text of rows (cluster, node, packed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, shingles in enumerate(_unpack(batch.column(2), width)):
                yield pa.RecordBatch.from_arrays([pa.repeat(batch.column(0)[k], len(shingles)), pa.repeat(batch.column(1)[k], len(shingles)), pa.array(shingles.view(np.int64))], names=["cluster", "node", "shingle"])

    return releasing(run)


def _able(rows: DataFrame, shingles: DataFrame, num: int, den: int) -> DataFrame:
    """Those of rows (cluster, node, n_shingles, ...) that may link with another of their cluster, as in ``_possible``, once."""
    shared = shingles.groupBy("cluster", "shingle").agg(F.count("*").alias("held")).where("held > 1").drop("held").join(shingles, ["cluster", "shingle"]).groupBy("cluster", "node").agg(F.count("*").alias("shared"))
    # the different sizes in a cluster, squared, are no more than twice its shingles
    sizes = staged(rows.groupBy("cluster", "n_shingles").agg(F.count("*").alias("times")), "forest-sizes")
    other = sizes.selectExpr("cluster", "n_shingles as other", "times")
    least = sizes.drop("times").join(other, "cluster").where(f"{den} * other >= {num} * n_shingles and (other <> n_shingles or times > 1)").groupBy("cluster", "n_shingles").agg(F.min("other").alias("least"))
    able = rows.join(shared, ["cluster", "node"]).join(least, ["cluster", "n_shingles"]).where(f"{num + den} * shared >= {num} * (n_shingles + least)")
    return staged(able.select(*rows.columns), "forest-able", codec="lz4")


def _across(rows: DataFrame, comps: DataFrame, texts: DataFrame, shingles: DataFrame, width: int, num: int, den: int, block: int) -> DataFrame | None:
    """Links (node, comp) between components (node, comp) of one cluster: rows (cluster, node, n_shingles); None where no
    cluster has two.  Two sets that link share a shingle of their prefixes, the size - ceil(size * num / den) + 1 that come first
    in an order common to both, here the rarest first."""
    named = rows.select("cluster", "node", "n_shingles").join(comps, "node")
    parted = named.groupBy("cluster").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").select("cluster")
    open_ = staged(named.join(parted, "cluster"), "forest-open")
    if open_.isEmpty():
        return None
    confirmer, made = _confirmer(width, num, den), "node binary, comp binary, hub boolean"
    # where little stands apart from a cluster's main component, it meets the rest block by block
    main = open_.groupBy("cluster", "comp").agg(F.sum("n_shingles").alias("w")).groupBy("cluster").agg(F.expr("max_by(comp, struct(w, comp))").alias("main"), F.max("w").alias("most"), F.sum("w").alias("w"))
    probed = staged(main.where(f"w - most <= {block} div 2").selectExpr("cluster", "main", f"cast(ceil(2 * most / {block}) as int) as parts"), "forest-probed")
    met = open_.join(probed, "cluster").selectExpr("cluster", "node", "explode(if(comp = main, array(cast(pmod(xxhash64(node), parts) as int)), sequence(0, parts - 1))) as part")
    beside = met.selectExpr("xxhash64(cluster, part) as region", "node").join(texts, "node").groupBy("region").applyInArrow(confirmer, made)
    open_ = open_.join(probed.select("cluster"), "cluster", "left_anti")
    shingles = shingles.join(open_.select("cluster", "node"), ["cluster", "node"], "left_semi")
    counts = shingles.groupBy("cluster", "shingle").agg(F.count("*").alias("held"))
    placed = shingles.join(counts, ["cluster", "shingle"]).join(open_.select("node", "comp", "n_shingles"), "node")
    prefix = placed.withColumn("place", F.expr("row_number() over (partition by node order by held, shingle)")).where(f"place <= n_shingles - (n_shingles * {num} + {den} - 1) div {den} + 1 and held > 1")
    sharing = staged(prefix.select("cluster", "shingle", "node", "comp", "n_shingles"), "forest-prefixes")
    # shingles that part nothing are left out, and of those held by the same texts one is enough
    groups = sharing.groupBy("cluster", "shingle").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.sum("n_shingles").alias("w"), F.expr("sum(cast(xxhash64(node) as decimal(20, 0)))").alias("who"), F.expr("bit_xor(xxhash64('again', node))").alias("too"))
    groups = groups.where("a <> b").groupBy("cluster", "who", "too", "w").agg(F.min("shingle").alias("shingle")).drop("who", "too")
    members = staged(sharing.drop("comp", "n_shingles").join(groups, ["cluster", "shingle"]).selectExpr("xxhash64(cluster, shingle) as region", "node", f"cast(ceil(2 * w / {block}) as int) as parts", "w"), "forest-sharing")
    small = members.where(F.col("w") <= block).select("region", "node")
    # larger groups go by pairs of blocks, each pair a task
    dealt = members.where(F.col("w") > block).withColumn("own", F.expr("cast(pmod(xxhash64(node), parts) as int)")).withColumn("other", F.expr("explode(sequence(0, parts - 1))"))
    pairs = dealt.selectExpr("xxhash64(region, least(own, other), greatest(own, other)) as region", "node")
    found = small.unionByName(pairs).join(texts, "node").groupBy("region").applyInArrow(confirmer, made).unionByName(beside)
    return staged(found.where("node <> comp").select("node", "comp").distinct(), "forest-across")


def classes_of(sketches: DataFrame) -> DataFrame:
    return staged(sketches.where("node is not null").groupBy("node").agg(F.first("n_shingles").alias("n_shingles"), F.first("keys").alias("keys"), F.first("sig").alias("sig")), "forest-classes", codec="lz4")


def grouped(docs: DataFrame, width: int = WIDTH, num: int = NUM, den: int = DEN, key: str = "cast(null as binary)", crowded: int = CROWDED, block: int = BLOCK_SHINGLES) -> DataFrame:
    """One row per row of ``docs``: doc_id, key (an expression), n_shingles, comp (null without shingles)."""
    sketches = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.expr(key).alias("key"), "text").mapInArrow(_sketcher(width), SKETCH), "forest-sketch", codec="lz4")
    classes = classes_of(sketches)
    clusters = staged(components(candidate_ties(classes, num, den, crowded), "forest").withColumnRenamed("comp", "cluster"), "forest-clusters")
    # only texts of classes that are tied move, and copies fold into one row of their class before they do
    texts = staged(joined(sketches.where("node is not null").select("node", "packed"), clusters.select("node"), ["node"], "left_semi", MOST_SENT).groupBy("node").agg(F.first("packed").alias("packed")), "forest-texts", codec="lz4")
    placed = clusters.join(classes.select("node", "n_shingles", "sig"), "node")
    sizes = placed.groupBy("cluster").agg(F.sum("n_shingles").alias("w"))
    sized = staged(placed.join(sizes, "cluster"), "forest-sized", codec="lz4")
    found = sized.where(F.col("w") <= block).select("cluster", "node").join(texts, "node").groupBy("cluster").applyInArrow(_confirmer(width, num, den), "node binary, comp binary, hub boolean").select("node", "comp")
    large = sized.where(F.col("w") > block)
    if not large.isEmpty():
        found = found.unionByName(_confirmed_in_blocks(large.select("cluster", "node", "n_shingles", "sig"), texts, width, num, den, block))
    found = staged(found, "forest-found")
    return sketches.select("doc_id", "key", "n_shingles", "node").join(found, "node", "left").select("doc_id", "key", "n_shingles", F.coalesce("comp", "node").alias("comp"))


def near_duplicates(docs: DataFrame, width: int = WIDTH, num: int = NUM, den: int = DEN, crowded: int = CROWDED, block: int = BLOCK_SHINGLES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    named = grouped(docs, width, num, den, crowded=crowded, block=block)
    least = named.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    out = named.join(least, "comp", "left").withColumn("component_id", F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.expr("doc_id <=> component_id").alias("kept"))
