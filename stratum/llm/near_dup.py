"""MinHash near-dedup by a multi-index Hamming join of b-bit signatures.

1. Each text's set of distinct word shingles gives a signature of 132 MinHash slots of 8 bits. Texts with equal sets
   are one class from here on.
2. A signature is split into 22 chunks of 6 slots. Two signatures at a distance of at most 43 slots have, by the
   pigeonhole principle, a chunk in which they differ in one slot at most; so each chunk is indexed once for each slot
   that may be wrong, and any two such signatures meet in a bucket. Sets with a similarity of 0.8 differ in 26.3 slots
   on average with a standard deviation of 4.6: 43 is 3.6 of them away, and 1 such pair in 5,000 is farther apart. At a
   similarity of 0.85 it is 1 in 10 million.
3. A bucket or candidate cluster of many members is first held against two of them, its least and its greatest node, on
   the full sets. Members with a true link to one share its label, and two members of one label need no comparison any
   more: a template with a million copies costs a few comparisons a copy. This is exact, as labels only say what is linked.
4. Within a bucket, signatures are compared, and those within the threshold joined to candidate clusters; a bucket puts
   out one row for each member at most, never its pairs. Every candidate cluster is compared on the full sets and puts out
   a spanning forest of its true links; their connected components are the result. Where buckets or clusters are large,
   they are dealt out as pairs of blocks: members with the commonest label meet the others, but not each other. So what is
   moved and compared grows with the members times those outside the commonest label; only a large cluster whose members
   are near enough to be candidates and still not linked to the two is compared all with all, as an exact answer needs.

Sets are told apart by 128 bits and then numbered, so no two different sets share a node below some 10**19 of them.

Defined cases: null texts and texts without words have an empty set and no links; ids that are null come after all
others; rows that tie in their id are told apart by their text; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialize, text_blocks
from .components import connected_components
from .textscan import Scan, mix, shingles

_U = np.uint64
CHUNKS, WIDTH = 22, 6
SLOTS = CHUNKS * WIDTH
#: Signature distance up to which no pair is lost.
DISTANCE = 2 * CHUNKS - 1
#: Members of a block of a bucket; sets, and shingles in sets, of a block of a cluster. Larger ones are held against two
#: of their members first. Parts of a representative's rows.
BUCKET_BLOCK, CLUSTER_BLOCK, CLUSTER_SHINGLES, SALTS = 1024, 512, 1_000_000, 16
_rng = np.random.default_rng(8)
_TIMES = _rng.integers(0, 1 << 31, SLOTS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_PLUS = _rng.integers(0, 1 << 32, SLOTS, dtype=np.uint32)
_WEIGHTS = _rng.integers(0, 1 << 63, (CHUNKS, WIDTH), dtype=np.uint64) * _U(2) + _U(1)
_SALTS = _rng.integers(0, 1 << 63, (CHUNKS, WIDTH), dtype=np.uint64)


def signatures(runs: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of SLOTS bytes for each set; sets without shingles have zeros."""
    out = np.zeros((len(offsets) - 1, SLOTS), np.uint8)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        x, starts = (runs >> _U(32)).astype(np.uint32), offsets[full]
        for k in range(SLOTS):
            y = x * _TIMES[k] + _PLUS[k]
            y ^= y >> np.uint32(15)
            least = np.minimum.reduceat(y, starts)
            out[full, k] = (least * np.uint32(0x9E3779B1)) >> np.uint32(24)
    return out


def bucket_keys(signature: np.ndarray) -> np.ndarray:
    """Of each signature, a key for each chunk and each slot of it that is left out."""
    terms = (signature.reshape(-1, CHUNKS, WIDTH).astype(np.uint64) + _U(1)) * _WEIGHTS
    return mix(terms.sum(axis=2, keepdims=True, dtype=np.uint64) - terms + _SALTS).reshape(len(signature), -1).view(np.int64)


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) as (node, least node of its component), without the least nodes themselves."""
    nodes, flat = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    while (label[label] != label).any():
        label = label[label]
    inner = label != np.arange(len(nodes))
    return nodes[inner], nodes[label[inner]]


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], limit: int = 20_000) -> Iterator[pa.Table]:
    """Tables of whole groups from batches that are sorted by keys, of about limit rows or of one group."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        for at in range(0, len(batch), limit):
            part = batch.slice(at, limit)
            held.append(part)
            rows += len(part)
            if rows < limit:
                continue
            table = pa.Table.from_batches(held)
            new = _changes(table, keys)
            if not len(new):
                continue
            cut = int(new[-1])
            yield table.slice(0, cut).combine_chunks()
            held, rows = table.slice(cut).to_batches(), len(table) - cut
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _changes(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Rows, but for the first, with which a group begins."""
    new = np.zeros(max(0, len(table) - 1), bool)
    for k in keys:
        x = table.column(k).to_numpy()
        new |= x[1:] != x[:-1]
    return np.flatnonzero(new) + 1


def _pairs(first: np.ndarray, end: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of each row with its partners, rows first..end, some at a time."""
    count = end - first
    ends = np.cumsum(count)
    at = 0
    while at < len(count):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        n = count[at:stop]
        left = np.repeat(np.arange(at, stop), n)
        yield left, np.repeat(first[at:stop], n) + np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
        at = stop


def _partners(table: pa.Table, group: str) -> tuple[np.ndarray, np.ndarray]:
    """The partners of each row of a table sorted by (group, p, q, side), as ranges of rows.

    In a block by itself, all later rows of the group; in a pair of blocks, the rows of the other side.
    """
    n = len(table)
    starts = np.concatenate(([0], _changes(table, [group, "p", "q"])))
    ends = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n)))
    other = table.column("side").to_numpy()
    second = np.add.reduceat(1 - other, starts) + starts  # where the other side begins
    second = np.repeat(second, np.diff(np.append(starts, n)))
    alone = table.column("p").to_numpy() == table.column("q").to_numpy()
    first = np.where(alone, np.arange(n) + 1, np.where(other == 0, second, ends))
    return np.minimum(first, ends), ends


def _near_in_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in whole_groups(batches, ["key", "p", "q"]):
        node, label = table.column("node").to_numpy(), table.column("label").to_numpy()
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(-1, SLOTS)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for left, right in _pairs(*_partners(table, "key")):
            apart = label[left] != label[right]
            left, right = left[apart], right[apart]
            near = np.empty(len(left), bool)
            for at in range(0, len(left), 1 << 15):
                s = slice(at, at + (1 << 15))
                near[s] = (sig[left[s]] != sig[right[s]]).sum(axis=1, dtype=np.uint8) <= DISTANCE
            u, v = spanning(node[left[near]], node[right[near]])
            a.append(u)
            b.append(v)
        u, v = spanning(np.concatenate(a), np.concatenate(b))
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets of sorted distinct values."""
    sizes = np.asarray([len(s) for s in sets])
    if len(sets) == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.asarray([[sizes[0], both], [both, sizes[1]]])
    owner = np.repeat(np.arange(len(sets)), sizes)
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    shared = np.bincount(column, minlength=len(values)) > 1
    position = np.cumsum(shared) - 1
    held = shared[column]
    owner, column = owner[held], position[column[held]]
    order = np.argsort(column, kind="stable")
    owner, column, step = owner[order], column[order], 4096
    out = np.zeros((len(sets), len(sets)), np.int64)
    for at in range(0, int(shared.sum()), step):
        lo, hi = np.searchsorted(column, (at, at + step))
        member = np.zeros((len(sets), step), np.float32)
        member[owner[lo:hi], column[lo:hi] - at] = 1
        out += (member @ member.T).astype(np.int64)
    out[np.arange(len(sets)), np.arange(len(sets))] = sizes
    return out


def _linked(both: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of sizes a and b with so many shingles in common are linked."""
    return 100 * both >= percent * (a + b - both)


def _links_in_clusters(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["root", "p", "q"], 500):
            starts = np.concatenate(([0], _changes(table, ["root", "p", "q"]), [len(table)]))
            nodes, sides, sets = table.column("node").to_numpy(), table.column("side").to_numpy(), table.column("shingles")
            alone = table.column("p").to_numpy() == table.column("q").to_numpy()
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for lo, hi in zip(starts[:-1], starts[1:]):
                node, first = np.unique(nodes[lo:hi], return_index=True)
                if len(node) < 2:
                    continue
                own = [np.frombuffer(sets[int(lo + k)].as_py(), np.uint64) for k in first]
                size, side = np.asarray([len(s) for s in own]), sides[lo:hi][first]
                linked = np.triu(_linked(overlaps(own), size[:, None], size[None, :], percent), 1)
                if not alone[lo]:
                    linked &= side[:, None] != side[None, :]
                u, v = spanning(*(node[x] for x in np.nonzero(linked)))
                a.append(u)
                b.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["u", "v"])

    return links


def _links_in_pairs(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
                    kept += [k] * bool(_linked(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b), percent))
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(kept, pa.int64())) for c in (0, 1)], names=["u", "v"])

    return links


def _fingerprints(runs: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Twice 64 bits that stand for each set."""
    out = []
    for salt in (0x51ED270B, 0x2545F4914F6CDD1D):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(runs + _U(salt)), dtype=np.uint64)))
        sums = total[offsets[1:]] - total[offsets[:-1]] + np.diff(offsets).astype(np.uint64) * _U(0xD1B54A32D192ED03)
        out.append(mix(sums).view(np.int64))
    return out


def _signed(df: DataFrame, words: int) -> DataFrame:
    """df (id, text_hash, text) to (id, text_hash, fa, fb, n_shingles, sig)."""
    kind = dict(df.dtypes)["id"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, flat, offsets in text_blocks(batch, 2):
                runs, bounds = shingles(Scan(flat, offsets, lower=True), words)
                sig = pa.array([x.tobytes() for x in signatures(runs, bounds)], pa.binary())
                own = [batch.column(k).slice(at, end - at) for k in (0, 1)]
                marks = [pa.array(x) for x in _fingerprints(runs, bounds)]
                yield pa.RecordBatch.from_arrays(
                    [*own, *marks, pa.array(np.diff(bounds)), sig], names=["id", "text_hash", "fa", "fb", "n_shingles", "sig"]
                )

    return df.mapInArrow(scan, f"id {kind}, text_hash long, fa long, fb long, n_shingles long, sig binary")


def _shingled(df: DataFrame, words: int) -> DataFrame:
    """df (text, node, ...) to (shingles as bytes, node, ...). Rows that repeat a node within a block of text are left out."""
    schema = ", ".join(["shingles binary", *(f"{n} {k}" for n, k in df.dtypes[1:])])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, flat, offsets in text_blocks(batch, 0):
                runs, bounds = shingles(Scan(flat, offsets, lower=True), words)
                first = np.unique(batch.column(1).slice(at, end - at).to_numpy(), return_index=True)[1]
                sets = pa.array([runs[bounds[k] : bounds[k + 1]].tobytes() for k in first], pa.binary())
                own = [c.slice(at, end - at).take(pa.array(first)) for c in batch.columns[1:]]
                yield pa.RecordBatch.from_arrays([sets, *own], names=["shingles", *batch.schema.names[1:]])

    return df.mapInArrow(scan, schema)


def _in_pairs_of_blocks(df: DataFrame, group: str) -> DataFrame:
    """Each row of df (group, node, common, others, commons, ...) once for each pair of blocks p <= q it is in, and its side.

    others and commons are the group's numbers of blocks; common says which of the two kinds a row belongs to. Blocks of
    others meet all blocks, and those of commons meet the others only.
    """
    hashed = F.xxhash64("node")
    own = F.when(F.col("common"), F.col("others") + F.pmod(hashed, F.col("commons"))).otherwise(F.pmod(hashed, F.col("others")))
    last = F.when(F.col("common"), F.col("others")).otherwise(F.col("others") + F.col("commons")) - 1
    out = df.withColumn("_own", own.cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), last.cast("int"))))
    out = out.withColumn("p", F.least("_own", "_other")).withColumn("q", F.greatest("_own", "_other"))
    out = out.withColumn("side", (F.col("_own") > F.col("_other")).cast("int"))
    return out.drop("_own", "_other", "common", "others", "commons")


def _dealt(df: DataFrame, group: str) -> DataFrame:
    """Rows of (group, p, q, side) brought together and sorted."""
    return df.repartition(_tasks(df), group, "p", "q").sortWithinPartitions(group, "p", "q", "side")


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _kinds(df: DataFrame, group: str, blocks: Callable[[Column, Column], Column]) -> DataFrame:
    """df (group, node, label, weight, ...) with common, others and commons, without groups of one label.

    blocks says how many blocks rows of a number and a total weight make. Counted for each label first, so a hot group is
    a few rows before it moves; the joins on the group are Spark's, which splits skewed ones.
    """
    each = df.groupBy(group, "label").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"))
    most = F.max_by(F.struct("label", "n", "w"), F.struct("n", "label"))
    sums = each.groupBy(group).agg(most.alias("most"), F.sum("n").alias("n"), F.sum("w").alias("w")).where("n > most.n")
    sums = sums.select(
        group,
        F.col("most.label").alias("common_label"),
        F.greatest(blocks(F.col("n") - F.col("most.n"), F.col("w") - F.col("most.w")), F.lit(1)).alias("others"),
        blocks(F.col("most.n"), F.col("most.w")).alias("commons"),
    )
    return df.join(sums, group).withColumn("common", F.col("label") == F.col("common_label")).drop("common_label", "weight")


class _Sets:
    """The distinct sets of a table of texts, and ways to get at them again."""

    def __init__(self, slim: DataFrame, made: DataFrame, words: int, percent: int):
        order = F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash")
        nodes = made.where("n_shingles > 0").groupBy("fa", "fb")
        nodes = nodes.agg(F.min(order).alias("first"), F.first("sig").alias("sig"), F.first("n_shingles").alias("size"))
        self.nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "near-nodes")
        self.slim, self.words, self.percent = slim, words, percent

    def with_shingles(self, wanted: DataFrame) -> DataFrame:
        """wanted (node, ...) with the set of each node, from its text."""
        found = self.nodes.select("node", F.col("first.id").alias("_id"), F.col("first.text_hash").alias("_hash"))
        found = wanted.join(found, "node")
        # Texts are shuffled whatever the other side's size: what a run moves then follows its input.
        match = F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
        texts = self.slim.join(found.hint("merge"), match)
        return _shingled(texts.select("text", "node", *(c for c in wanted.columns if c != "node")), self.words)

    def links_to(self, pairs: DataFrame) -> DataFrame:
        """Of pairs (node, rep), those that are linked, as (u, v); a representative of any number of nodes is split."""
        wanted = pairs.select("node").union(pairs.select("rep")).distinct()
        sets = materialize(self.with_shingles(wanted), "near-sets")
        salt = F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")
        rows = pairs.join(sets, "node").withColumn("salt", salt)
        of = pairs.select("rep").distinct().join(sets.select(F.col("node").alias("rep"), F.col("shingles").alias("other")), "rep")
        of = of.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.join(of, ["rep", "salt"]).select("node", "rep", "shingles", "other")
        return materialize(rows.mapInArrow(_links_in_pairs(self.percent), "u long, v long"), "near-known")


def _keyed(nodes: DataFrame) -> DataFrame:
    """(node, key) for each of a signature's keys."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part = batch.slice(at, 2000)
                keys = bucket_keys(np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(-1, SLOTS))
                offsets = pa.array(np.arange(0, keys.size + 1, SLOTS, dtype=np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["node", "keys"])

    return nodes.select("node", "sig").mapInArrow(keyed, "node long, keys array<long>").select("node", F.explode("keys").alias("key"))


def _candidates(sets: _Sets) -> tuple[DataFrame, DataFrame | None]:
    """Spanning forests of all pairs of nodes within DISTANCE, as (u, v); and links (u, v) that are known by then."""
    nodes = sets.nodes.select("node", "sig")
    by_sig = nodes.repartition(_tasks(nodes), "sig").groupBy("sig")
    alike = materialize(by_sig.agg(F.min("node").alias("least"), F.max("node").alias("greatest"), F.count(F.lit(1)).alias("n")), "near-alike")
    several = alike.where("least < greatest")
    same = nodes.join(several, "sig").where("node <> least").select("node", "least", "greatest", "n")
    entries = _keyed(alike.select(F.col("least").alias("node"), "sig").repartition(_tasks(nodes)))
    ends = (F.min("node").alias("least"), F.max("node").alias("greatest"))
    counted = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *ends).where("n > 1")
    shared = materialize(entries.join(counted, "key"), "near-buckets")

    large = shared.where(F.col("n") > BUCKET_BLOCK).select("node", "least", "greatest")
    large = large.unionByName(same.where(F.col("n") > CLUSTER_BLOCK).drop("n"))
    large = large.groupBy("node").agg(F.min("least").alias("least"), F.max("greatest").alias("greatest"))
    pairs = large.select("node", F.explode(F.array_distinct(F.array("least", "greatest"))).alias("rep")).where("node <> rep")
    pairs = materialize(pairs, "near-representatives")
    known = None if pairs.isEmpty() else sets.links_to(pairs)

    small = shared.where(F.col("n") <= BUCKET_BLOCK).select("key", "node").join(nodes, "node")
    zero = F.lit(0)
    placed = small.select("key", zero.alias("p"), zero.alias("q"), zero.alias("side"), "node", F.col("node").alias("label"), "sig")
    if known is not None:
        rows = _labelled(shared.where(F.col("n") > BUCKET_BLOCK).select("key", "node"), known).withColumn("weight", F.lit(0))
        kinds = _kinds(rows, "key", lambda n, w: F.ceil(n / BUCKET_BLOCK))
        rows = _in_pairs_of_blocks(kinds, "key").join(nodes, "node")
        placed = placed.unionByName(rows.select(*placed.columns))
    near = _dealt(placed, "key").mapInArrow(_near_in_buckets, "u long, v long")
    return near.unionByName(same.select(F.col("node").alias("u"), F.col("least").alias("v"))), known


def _labelled(df: DataFrame, known: DataFrame | None) -> DataFrame:
    """df (node, ...) with a label; nodes of one label are in one component of the known links."""
    if known is None:
        return df.withColumn("label", F.col("node"))
    labels = known.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label"))
    return df.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of docs: id, text_hash, n_shingles, component_id, kept.

    Texts are linked when the intersection of their sets of shingles has at least percent of the union's size.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    made = materialize(_signed(slim, words), "near-signatures")
    sets = _Sets(slim, made, words, percent)
    near, known = _candidates(sets)
    clusters = connected_components(near if known is None else near.unionByName(known))
    many = _labelled(clusters, known).join(sets.nodes.select("node", F.col("size").alias("weight")), "node")
    blocks = lambda n, w: F.ceil(F.greatest(n / CLUSTER_BLOCK, w / CLUSTER_SHINGLES))
    many = _kinds(many, "root", blocks).drop("label")
    placed = _in_pairs_of_blocks(sets.with_shingles(many), "root")
    links = _dealt(placed, "root").select("root", "p", "q", "side", "node", "shingles")
    links = links.mapInArrow(_links_in_clusters(percent), "u long, v long")
    links = connected_components(links if known is None else links.unionByName(known))
    of = sets.nodes.join(links, "node", "left").select("fa", "fb", "first", F.coalesce("root", "node").alias("root"))
    least = of.groupBy("root").agg(F.min("first").alias("least"))
    of = of.join(least, "root").select("fa", "fb", "least")
    out = made.select("id", "text_hash", "fa", "fb", "n_shingles").join(of, ["fa", "fb"], "left")
    empty = F.col("least").isNull()
    first = F.col("id").eqNullSafe(F.col("least.id")) & (F.col("text_hash") == F.col("least.text_hash"))
    component = F.when(empty, F.col("id")).otherwise(F.col("least.id"))
    return out.select("id", "text_hash", "n_shingles", component.alias("component_id"), (empty | first).alias("kept"))


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80
) -> DataFrame:
    """One document of each component of linked documents, that with the smallest id; columns as they were.

    Of rows that tie in id and text all stay: exact dedup comes before.
    """
    gone = near_duplicates(docs, id_col, text_col, words, percent).where("NOT kept")
    gone = gone.select(F.col("id").alias("_gone"), F.col("text_hash").alias("_hash")).distinct()
    gone = materialize(gone, "near-drop").hint("merge")
    mark = free_name(docs.columns, "text_hash")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.withColumn(mark, F.xxhash64(text))
    match = rows[f"`{id_col}`"].eqNullSafe(gone["_gone"]) & (rows[mark] == gone["_hash"])
    return rows.join(gone, match, "left_anti").drop(mark)
