"""MinHash near-duplicates by a multi-index Hamming join.

A text is a set of distinct word shingles.  Its signature is ``SLOTS`` minima, of which ``BITS`` bits
are kept.  Two sets with Jaccard similarity s differ in each slot with probability (1 - s) at most,
so pairs at or above the link threshold differ in at most ``max_distance`` slots but for a chance of
``MISS``.  All pairs within that distance are found for certain: the slots are cut in
(max_distance + 1) / 2 chunks, by pigeonhole some chunk of such a pair has at most one error, and
every chunk enumerates its possible errors as keys with one slot left out.

Stages:

1. sets: shingle sets are hashed; documents with equal sets form a class, numbered ``rep``, with its
   least id as ``first``, so exact copies cost one row from here on.  An id with several sets is in
   several classes, each with its own signature and text.
2. index: the keys of each representative meet in buckets.  Each member of a bucket is compared with
   the bucket's least member, which is linear.  In buckets that fall into several components by then,
   all members outside the largest component meet all others, in blocks of ``SIG_BLOCK`` signatures;
   a meeting gives back a forest.
3. groups: components of near signatures hold all candidate pairs.
4. links on full shingle sets: a group is dealt to blocks of ``BLOCK`` texts or ``BLOCK_BYTES``, and
   each block, with the group's least member, is compared pair by pair.  Where a group of several blocks is not one component then, the
   members outside its largest component meet all others as above.
5. components of the links, spread over classes and named by their least id.

No group is ever in one task as a whole, and no list of pairs of a group is made.

Null and empty texts have no shingles and link with nothing.  A text with fewer words than a shingle
is one shingle.  Rows without id link with nothing, have no component and are kept.  Rows that repeat
an id are one document: they share component and verdict.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import graph, storage
from gridloom.llm import textkit as tk

SLOTS = 64
BITS = 16
#: The chance at most of a pair at the threshold to differ in more slots than the index covers.
MISS = 2e-6
#: Texts of a block and their bytes; two blocks meet at a time.
BLOCK, BLOCK_BYTES = 256, 4 << 20
#: Signatures of a block (128 bytes each), and how many are compared with the other side at once.
SIG_BLOCK, TILE = 4096, 256

_RNG = np.random.default_rng(77)
_MULT = _RNG.integers(1, 1 << 31, SLOTS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _RNG.integers(0, 1 << 32, SLOTS, dtype=np.uint32)
_SLOT_CODE = _RNG.integers(1, 1 << 63, SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def max_distance(percent: int) -> int:
    """The least odd distance that covers pairs of this similarity but for a chance of ``MISS``."""
    differ = 1 - percent / 100
    for t in range(1, SLOTS, 2):
        if sum(math.comb(SLOTS, k) * differ**k * (1 - differ) ** (SLOTS - k) for k in range(t + 1, SLOTS + 1)) <= MISS:
            return t
    return SLOTS - 1


def shingle_sets(offsets: np.ndarray, data: np.ndarray, size: int) -> list[np.ndarray]:
    """For each row its distinct shingles as sorted 64-bit hashes."""
    words = tk.Words(offsets, tk.LOWER[data])
    hashes = words.hashes()
    grams = tk.windows(hashes, size)
    out = []
    for a, b in zip(words.rows[:-1].tolist(), words.rows[1:].tolist(), strict=True):
        if b - a >= size:
            s = np.sort(grams[a : b - size + 1])
            keep = np.ones(len(s), dtype=bool)
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif b > a:
            out.append(tk.windows(hashes[a:b], b - a) ^ np.uint64(b - a))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(rows, SLOTS) of uint16; the sets must not be empty."""
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    x = (np.concatenate(sets) >> np.uint64(16)).astype(np.uint32)
    out = np.empty((len(sets), SLOTS), dtype=np.uint16)
    for i in range(SLOTS):
        least = np.minimum.reduceat(x * _MULT[i] + _ADD[i], starts)
        out[:, i] = (least ^ (least >> np.uint32(16)) * np.uint32(0x9E3B)).astype(np.uint16)
    return out


def index_keys(sig: np.ndarray, distance: int) -> np.ndarray:
    """(rows, SLOTS) keys: one for each chunk and each slot of it that may be wrong."""
    coded = tk.mix((sig.astype(np.uint64) + np.uint64(1)) * _SLOT_CODE)
    keys = np.empty(sig.shape, dtype=np.uint64)
    edges = np.linspace(0, SLOTS, (distance + 1) // 2 + 1).round().astype(int)
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        keys[:, a:b] = coded[:, a:b].sum(axis=1, dtype=np.uint64)[:, None] - coded[:, a:b]
    return tk.mix(keys + np.arange(SLOTS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _sketch(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, text_key (a hash of the text), n_shingles, set_key (of equal sets; null for none), sig."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, text_keys = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "text_key"))
            for first, end, offsets, data in tk.slices(tk.text_column(batch)):
                sets = shingle_sets(offsets, data, size)
                full = [s for s in sets if len(s)]
                sig = iter(signatures(full)) if full else iter(())
                rows = [(xxhash.xxh3_128_digest(s.tobytes()), next(sig).tobytes()) if len(s) else (None, None) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(first, end - first),
                        text_keys.slice(first, end - first),
                        pa.array([len(s) for s in sets], type=pa.int64()),
                        pa.array([k for k, _ in rows], type=pa.binary()),
                        pa.array([s for _, s in rows], type=pa.binary()),
                    ],
                    names=["doc_id", "text_key", "n_shingles", "set_key", "sig"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return keyed.mapInArrow(run, f"doc_id {kind}, text_key long, n_shingles long, set_key binary, sig binary")


def _runs(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[pa.Table]:
    """Consecutive rows with equal keys, from batches that are sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in by]
        new = np.zeros(batch.num_rows, dtype=bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(new).tolist()]
        for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            key = tuple(c[a] for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def tie(self, i: int, j: int) -> bool:
        a, b = self.find(i), self.find(j)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _forest(ids: np.ndarray, first: np.ndarray, second: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the pairs (positions into ids)."""
    forest = _Forest(len(ids))
    return [(int(ids[i]), int(ids[j])) for i, j in zip(first.tolist(), second.tolist(), strict=True) if forest.tie(i, j)]


def _blocks(count, size, block: int):
    """How many blocks hold so many members of so many bytes."""
    return F.greatest(F.ceil(count / F.lit(block)), F.ceil(size / F.lit(BLOCK_BYTES)), F.lit(1)).cast("int")


def own_blocks(members: DataFrame, by: str, block: int = BLOCK) -> DataFrame:
    """Each member in its block of its group (bi = bj), and the group's least member in all of them.

    Members are dealt by a hash of their id to as many blocks as bound both members and ``bytes``.
    """
    sizes = members.groupBy(by).agg(F.min("rep").alias("least"), F.count("*").alias("size"), F.sum("bytes").alias("all_bytes")).filter("size > 1")
    dealt = members.join(sizes.select(by, "least", _blocks(F.col("size"), F.col("all_bytes"), block).alias("blocks")), by)
    to = F.when(F.col("rep") == F.col("least"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(
        F.array(F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    )
    return dealt.withColumn("bi", F.explode(to)).withColumn("bj", F.col("bi")).withColumn("mine", F.col("bi")).drop("least", "blocks")


def open_meetings(members: DataFrame, by: str, block: int) -> DataFrame:
    """Meetings of blocks for all pairs of members with different ``root`` in a group.

    The largest component's members have no business with each other, so only the members outside it
    are sent to several meetings: each of their blocks meets each later one (bj > bi) and each block of
    the largest component (bj < 0); its own pairs are compared where it meets the first of these
    (bj = -1).  Where each side is one block, as in nearly all groups, every member is sent once.
    """
    counts = members.groupBy(by, "root").agg(F.count("*").alias("n"), F.sum("bytes").alias("size"))
    groups = counts.groupBy(by).agg(
        F.max_by(F.struct("root", "n", "size"), F.struct("n", "root")).alias("top"), F.sum("n").alias("n"), F.sum("size").alias("size"), F.count("*").alias("roots")
    )
    blocks = groups.filter("roots > 1").select(
        by,
        F.col("top.root").alias("largest"),
        _blocks(F.col("top.n"), F.col("top.size"), block).alias("gb"),
        _blocks(F.col("n") - F.col("top.n"), F.col("size") - F.col("top.size"), block).alias("mb"),
    )
    dealt = members.join(blocks, by).withColumn("inner", F.col("root") == F.col("largest"))
    dealt = dealt.withColumn("mine", F.pmod(F.xxhash64("rep"), F.when(F.col("inner"), F.col("gb")).otherwise(F.col("mb"))).cast("int"))
    outer = F.sequence(F.lit(0), F.col("mb") - 1)
    met = F.when(
        F.col("inner"), F.transform(outer, lambda i: F.struct(i.alias("bi"), (-1 - F.col("mine")).alias("bj"), F.lit(-1).alias("mine")))
    ).otherwise(
        F.concat(
            F.transform(
                F.filter(outer, lambda i: i != F.col("mine")),
                lambda i: F.struct(F.least(i, "mine").alias("bi"), F.greatest(i, "mine").alias("bj"), F.col("mine").alias("mine")),
            ),
            F.transform(F.sequence(F.lit(1), F.col("gb")), lambda j: F.struct(F.col("mine").alias("bi"), (-j).alias("bj"), F.col("mine").alias("mine"))),
        )
    )
    return dealt.withColumn("at", F.explode(met)).drop("inner", "largest", "gb", "mb", "mine").select("*", "at.*").drop("at")


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the members that are compared with each other in a meeting."""
    mine = table["mine"].to_numpy()
    bi, bj = table["bi"][0].as_py(), table["bj"][0].as_py()
    every = np.arange(len(mine))
    if bi == bj:
        return every, every
    own = mine == bi
    return every[own], every if bj == -1 else every[~own]


def _meet(met: DataFrame, by: str, links: Callable[[pa.Table], list[tuple[int, int]]], payload: list[str]) -> DataFrame:
    """Runs ``links`` on the members of each meeting; gives edges u, v."""
    keys = [by, "bi", "bj"]
    rows = met.select(*keys, "mine", "rep", *payload).repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, tuple(keys)):
            if table.num_rows > 1 and (found := links(table)):
                u, v = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(u, type=pa.int64()), pa.array(v, type=pa.int64())], names=["u", "v"])

    return rows.mapInArrow(run, "u long, v long")


def _sig_matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, SLOTS)


def _near_links(distance: int) -> Callable[[pa.Table], list[tuple[int, int]]]:
    """Forest of the pairs of different components within the distance, in one meeting."""

    def links(table: pa.Table) -> list[tuple[int, int]]:
        ids, root, sig = table["rep"].to_numpy(), table["root"].to_numpy(), _sig_matrix(table["sig"])
        one, two = _sides(table)
        slots = np.ascontiguousarray(sig[two].T)
        forest, found = _Forest(len(ids)), []
        for at in range(0, len(one), TILE):
            tile = one[at : at + TILE]
            differ = np.zeros((len(tile), len(two)), dtype=np.uint8)
            for i in range(SLOTS):
                differ += sig[tile, i][:, None] != slots[i][None, :]
            first, second = np.nonzero((differ <= distance) & (root[tile][:, None] != root[two][None, :]))
            found += [(int(ids[i]), int(ids[j])) for i, j in zip(tile[first].tolist(), two[second].tolist(), strict=True) if forest.tie(i, j)]
        return found

    return links


def _exact_links(size: int, percent: int) -> Callable[[pa.Table], list[tuple[int, int]]]:
    def links(table: pa.Table) -> list[tuple[int, int]]:
        ids = table["rep"].to_numpy()
        one, two = _sides(table)
        sets: list[np.ndarray] = []
        for chunk in table["text"].chunks:
            for _, _, offsets, data in tk.slices(chunk.fill_null("")):
                sets += shingle_sets(offsets, data, size)
        sizes = np.array([len(s) for s in sets])
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(flat, kind="stable")
        ranked = flat[order]
        column = np.cumsum(np.concatenate([[0], (ranked[1:] != ranked[:-1]).astype(np.int64)]))
        owner = owner[order]
        shared = np.zeros((len(one), len(two)), dtype=np.float32)
        # Intersections as products of 0/1 matrices, a bounded number of shingles at a time.
        step = 4096
        bounds = np.searchsorted(column, np.arange(0, column[-1] + 1 + step, step))
        for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            if b > a:
                has = np.zeros((len(sets), step), dtype=np.float32)
                has[owner[a:b], column[a:b] - k * step] = 1.0
                shared += has[one] @ has[two].T
        inter = shared.astype(np.int64)
        union = sizes[one][:, None] + sizes[two][None, :] - inter
        ok = (100 * inter >= percent * union) & (one[:, None] != two[None, :])
        if "root" in table.column_names:
            root = table["root"].to_numpy()
            ok &= root[one][:, None] != root[two][None, :]
        first, second = np.nonzero(ok)
        return _forest(ids, one[first], two[second])

    return links


def _distance(pairs: DataFrame, distance: int) -> DataFrame:
    """pairs with sig_u, sig_v -> u, v, far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = _sig_matrix(batch.column(2)), _sig_matrix(batch.column(3))
                far = (a != b).sum(axis=1) > distance
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(far)], names=["u", "v", "far"])

    return pairs.select("u", "v", "sig_u", "sig_v").mapInArrow(run, "u long, v long, far boolean")


def _bucket_keys(reps: DataFrame, distance: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = 4096
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                keys = index_keys(_sig_matrix(part.column(1)), distance)
                rep = np.repeat(part.column(0).to_numpy(), SLOTS)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(rep)], names=["key", "rep"])

    return reps.select("rep", "sig").mapInArrow(run, "key long, rep long")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """Every row's doc_id, n_shingles, component_id and kept.  Links need a similarity of
    ``percent`` / 100 or more on sets of ``shingle`` words; ids must be integers."""
    distance = max_distance(percent)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    held = storage.Scratch(docs.sparkSession)
    sketch = storage.table(_sketch(docs, shingle), "sketch")
    known = sketch.filter("set_key is not null and doc_id is not null")
    classes = known.groupBy("set_key").agg(F.min(F.struct("doc_id", "text_key")).alias("at"), F.min("sig").alias("sig"))
    # Numbers are fixed by writing them; one id may be the least of several classes.
    reps = storage.table(
        classes.select("set_key", F.col("at.doc_id").alias("first"), F.col("at.text_key").alias("text_key"), "sig", F.monotonically_increasing_id().alias("rep")), "classes"
    )
    keys = _bucket_keys(reps, distance)
    buckets = keys.groupBy("key").agg(F.min("rep").alias("least"), F.max("rep").alias("most"), F.count("*").alias("n")).filter("least < most")
    shared = held.table(keys.join(buckets.select("key", "least", "n"), "key"), "buckets")
    stars = shared.filter("rep <> least").select(F.col("least").alias("u"), F.col("rep").alias("v")).distinct()
    sigs = reps.select("rep", "sig")
    paired = stars.join(sigs.select(F.col("rep").alias("u"), F.col("sig").alias("sig_u")), "u").join(
        sigs.select(F.col("rep").alias("v"), F.col("sig").alias("sig_v")), "v"
    )
    judged = held.table(_distance(paired, distance), "stars")
    near = judged.filter("not far").select("u", "v")
    # Buckets of three and more with a member that is far from the least one.
    mixed = shared.filter("n > 2 and rep <> least").join(
        judged.filter("far").select(F.col("u").alias("least"), F.col("v").alias("rep")), ["least", "rep"], "left_semi"
    ).select("key").distinct()
    roots = held.table(graph.components(near), "roots")
    members = (
        shared.join(mixed, "key", "left_semi")
        .select("key", "rep")
        .join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left")
        .select("key", "rep", F.coalesce("root", "rep").alias("root"), F.lit(2 * SLOTS).alias("bytes"))
    )
    # Written, as the meetings read them twice: to count the components of a bucket and to deal its members.
    met = open_meetings(held.table(members, "members"), "key", SIG_BLOCK).join(sigs, "rep")
    more = held.table(_meet(met, "key", _near_links(distance), ["root", "sig"]), "near")
    told = roots.filter("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v"))
    groups = held.table(graph.components(told.unionAll(more)), "groups") if not more.isEmpty() else roots
    grouped = groups.select(F.col("node").alias("rep"), F.col("root").alias("grp"))
    repeated = not known.groupBy("doc_id").count().filter("count > 1").isEmpty()
    texts = held.table(_class_texts(docs, reps, grouped, repeated), "texts")
    links = storage.table(_meet(own_blocks(texts, "grp", BLOCK), "grp", _exact_links(shingle, percent), ["text"]), "links")
    linked = graph.components(links)
    # Groups of several blocks that are not one component yet.
    large = texts.groupBy("grp").agg(F.count("*").alias("n"), F.sum("bytes").alias("size")).filter(_blocks(F.col("n"), F.col("size"), BLOCK) > 1).select("grp")
    if not large.isEmpty():
        rooted = texts.select("rep", "grp", "bytes").join(large, "grp", "left_semi").join(linked.select(F.col("node").alias("rep"), "root"), "rep", "left")
        rooted = held.table(rooted.withColumn("root", F.coalesce("root", "rep")), "rooted")
        met = open_meetings(rooted, "grp", BLOCK).join(texts.select("rep", "text"), "rep")
        told = linked.filter("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v"))
        links = told.unionAll(storage.table(_meet(met, "grp", _exact_links(shingle, percent), ["root", "text"]), "links"))
        linked = graph.components(links)
    held.clear()
    # Ids of a class follow it.
    ids = known.select("doc_id", "set_key").distinct().join(reps.select("set_key", "rep", "first"), "set_key").select("doc_id", "rep", "first")
    doubled = known.groupBy("doc_id").agg(F.count_distinct("set_key").alias("n")).filter("n > 1")
    if repeated and not doubled.isEmpty():  # an id with several sets ties their classes together
        ties = ids.join(doubled, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("rep").alias("u"), F.collect_set("rep").alias("all"))
        links = links.unionAll(ties.select("u", F.explode("all").alias("v")))
        linked = graph.components(links)
    linked = linked.select(F.col("node").alias("rep"), "root")
    named = linked.join(reps.select("rep", "first"), "rep").groupBy("root").agg(F.min("first").alias("name"))
    named = linked.join(graph.apart(named, "root", "of"), F.col("root") == F.col("of")).select("rep", "name")
    component = (
        ids.join(named, "rep", "left")
        .groupBy("doc_id")
        .agg(F.min(F.coalesce("name", "first")).alias("component_id"))
    )
    component = component.filter("doc_id <> component_id")
    out = sketch.select("doc_id", "n_shingles").join(component, "doc_id", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _class_texts(docs: DataFrame, reps: DataFrame, grouped: DataFrame, repeated: bool) -> DataFrame:
    """rep, grp and text of every class in a group: one row each, also where rows repeat an id."""
    wanted = reps.join(grouped, "rep").select(F.col("first").alias("doc_id"), "text_key", "rep", "grp")
    found = docs.withColumn("text_key", F.xxhash64("text")).join(wanted, ["doc_id", "text_key"]).select("rep", "grp", F.octet_length("text").alias("bytes"), "text")
    return found.dropDuplicates(["rep"]) if repeated else found


def deduplicate(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows whose document stands for its group, with all columns."""
    gone = near_duplicates(docs, shingle, percent).filter("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
