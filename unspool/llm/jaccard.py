"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence with its transpose.

A document's n-grams are its distinct five-word shingles; two documents link where the share that
they have in common is `share` or more. The incidence is dealt out by n-gram into column blocks,
each of which counts the documents of its n-grams; an n-gram of one document adds to no overlap and
goes. Ordered by how few documents have them, two documents that link must share one of the first
n - ceil(share * n) + 1 n-grams of each (the bound that the size gives), which leaves a few
documents and ties those together that may link. Within what is tied together the rows' overlaps
are accumulated block by block of columns, and pairs under the bound of their two sizes are dropped.
Groups too large for a task are cut by size class (only neighbouring classes can link) and by
hash into row blocks, and every pair of blocks is a task of its own. A product gives each row's
number of links and its smallest linked row, never a list of pairs.

Texts with the same set are one class and stand as one row in the product. The number of column
blocks follows the bytes of text, so a block's size is bounded at any size of the table; an n-gram
that many documents of a batch hold travels to its block as one entry with their number, so a very
common n-gram doesn't gather in one block.

Defined results: every row is a document of its own, also where rows share a doc_id: such rows
link only if their texts do, and each gets the smallest doc_id of its own component. A null or
wordless text has no n-grams and links with nothing; fewer than five words make one n-gram; a row
without doc_id links like any other and lends its component no id; an empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unspool.llm import kernels as K
from unspool.llm.common import delete, materialize, small_batches, written
from unspool.llm.graph import components

WIDTH = 5
SHARE = (75, 100)
#: Entries and rows of the incidence that a task holds before it deals them out.
FLUSH_ENTRIES, FLUSH_ROWS = 1 << 20, 60_000
#: Bytes of text whose entries make a column block: the first up to FINE_BLOCKS blocks, so that tasks get evenly many, then up to the second.
BLOCK_BYTES, MOST_BYTES, FINE_BLOCKS = 1 << 19, 1 << 24, 1 << 14
#: Documents of a batch from which on an n-gram of theirs is one entry.
COMMON = 32
#: Rows of a block of the product, and columns that are multiplied at once.
BLOCK_ROWS, BLOCK_COLUMNS = 512, 4096
#: Classes of most copies that meet their rows by a broadcast; all others by a shuffle.
MOST_COPIED = 256
_KEY = np.uint64((1 << 48) - 1)
_DEALT = pa.schema([("block", pa.int64()), ("batch", pa.int64()), ("blob", pa.binary())])
_MANIFEST = np.dtype([("doc_id", "<i8"), ("tag", "<i8"), ("n", "<i8"), ("d1", "<i8"), ("d2", "<i8"), ("known", "?"), ("first", "?")])


def digest(own: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set of hashes."""
    one = K.mix(own ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64)
    two = np.bitwise_xor.reduce(K.mix(own * np.uint64(3) + np.uint64(1)), initial=np.uint64(len(own)))
    return int(one.astype(np.int64)), int(two.astype(np.int64))


def prefix_length(n: int, share: tuple[int, int] = SHARE) -> int:
    """Of n ordered n-grams, how many must hold one that a linked document has in its own first ones."""
    return n - -(-n * share[0] // share[1]) + 1 if n else 0


def _steps(rows: np.ndarray) -> bytes:
    """Ascending numbers as the low bytes, then the high bytes, of their differences."""
    return _bytes(np.diff(rows, prepend=np.uint16(0)))


def _bytes(numbers: np.ndarray) -> bytes:
    """16-bit numbers as their low bytes, then their high bytes."""
    return (numbers & 255).astype(np.uint8).tobytes() + (numbers >> 8).astype(np.uint8).tobytes()


def _rows(blob: bytes, n: int, at: int) -> np.ndarray:
    low, high = np.frombuffer(blob, np.uint8, n, at), np.frombuffer(blob, np.uint8, n, at + n)
    return np.cumsum(low.astype(np.uint16) + (high.astype(np.uint16) << np.uint16(8)), dtype=np.uint16)


def _block_of(h: np.ndarray, blocks: int) -> np.ndarray:
    return (((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)).astype(np.uint32)


def _key_bytes(h: np.ndarray) -> bytes:
    return np.ascontiguousarray((h & _KEY).view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _keys(blob: bytes, n: int, at: int) -> np.ndarray:
    key = np.zeros((n, 8), np.uint8)
    key[:, :6] = np.frombuffer(blob, np.uint8, 6 * n, at).reshape(-1, 6)
    return key.view(np.uint64).ravel()


def _common(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of entries h: the n-grams that COMMON rows or more hold, their counts, and the place of each entry's n-gram or -1."""
    bin_ = (h & np.uint64(0xFFFFF)).astype(np.int64)
    some = np.flatnonzero(np.bincount(bin_, minlength=1 << 20)[bin_] >= COMMON)
    place = np.full(len(h), -1)
    grams, back, count = np.unique(h[some], return_inverse=True, return_counts=True)
    often = count >= COMMON
    place[some] = np.where(often, np.cumsum(often) - 1, -1)[back] if len(some) else -1
    return grams[often], count[often], place


def _deal(blocks: int):
    """Rows (doc_id, tag, text) to the entries of each column block, and a manifest of the rows of each batch.

    A block's blob: the number of common n-grams, the other entries (n-gram, row), the common n-grams
    with their counts. The rows of common n-grams stay in the manifest.
    """

    def out(ids: list[int | None], tags: list[int | None], sets: list[np.ndarray], batch: int) -> pa.RecordBatch:
        manifest = np.zeros(len(ids), _MANIFEST)
        seen: set[tuple[int, int, int]] = set()
        for i, own in enumerate(sets):
            key = (len(own), *digest(own))
            manifest[i] = (ids[i] or 0, tags[i] or 0, *key, ids[i] is not None, len(own) > 0 and key not in seen)
            seen.add(key)
        use = [i for i in range(len(ids)) if manifest["first"][i]]
        h = np.concatenate([sets[i] for i in use]) if use else np.zeros(0, np.uint64)
        row = np.repeat(np.array(use, np.uint16), [len(sets[i]) for i in use])
        common, held, place = _common(h)
        to = np.flatnonzero(place >= 0)
        to = to[np.argsort(place[to], kind="stable")]
        kept = np.array([len(ids), len(common)], np.int64).tobytes() + manifest.tobytes() + common.tobytes() + held.astype(np.int64).tobytes() + row[to].tobytes()
        h, row = h[place < 0], row[place < 0]
        block = _block_of(h, blocks)
        # Stable: within a block the rows ascend, and steps between them are small numbers that compress.
        order = np.argsort(block, kind="stable")
        h, row, block = h[order], row[order], block[order]
        cut = np.searchsorted(block, np.arange(blocks + 1))
        # Common n-grams ascend, and so do their blocks.
        cut_common = np.searchsorted(_block_of(common, blocks), np.arange(blocks + 1))
        filled = np.flatnonzero((cut[1:] > cut[:-1]) | (cut_common[1:] > cut_common[:-1]))
        blobs = []
        for b in filled:
            own, often = slice(cut[b], cut[b + 1]), slice(cut_common[b], cut_common[b + 1])
            blobs.append(int(often.stop - often.start).to_bytes(4, "little") + _key_bytes(h[own]) + _steps(row[own]) + _key_bytes(common[often]) + held[often].astype(np.uint32).tobytes())
        where = [*filled.tolist(), -1 - batch]
        return pa.RecordBatch.from_arrays([pa.array(where, pa.int64()), pa.array([batch] * len(where), pa.int64()), pa.array([*blobs, kept], pa.binary())], schema=_DEALT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 24
        serial, ids, tags, sets, entries = 0, [], [], [], 0
        for batch in batches:
            own, own_tags = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            data, offs = K.buffer_of(batch.column(2))
            for a, b in K.steps(offs):
                ids += own[a:b]
                tags += own_tags[a:b]
                new = K.shingle_sets(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], WIDTH)
                sets += new
                entries += sum(map(len, new))
                if entries >= FLUSH_ENTRIES or len(ids) >= FLUSH_ROWS:
                    yield out(ids, tags, sets, first + serial)
                    serial, ids, tags, sets, entries = serial + 1, [], [], [], 0
        if ids:
            yield out(ids, tags, sets, first + serial)

    return run


def _count(key: tuple, dealt: pa.Table) -> pa.Table:
    """One column block: for each batch the entries whose n-gram more rows have, with their number."""
    block = key[0].as_py()
    if block < 0:
        return dealt
    batches, blobs = dealt.column("batch").to_pylist(), dealt.column("blob").to_pylist()
    often = [int.from_bytes(b[:4], "little") for b in blobs]
    sizes = [(len(b) - 4 - 10 * m) // 8 for b, m in zip(blobs, often, strict=True)]
    total = sum(sizes) + sum(often)
    keys, weight, at = np.zeros(total, np.uint64), np.ones(total, np.int64), 0
    for blob, n, m in zip(blobs, sizes, often, strict=True):
        keys[at : at + n] = _keys(blob, n, 4)
        keys[at + n : at + n + m] = _keys(blob, m, 4 + 8 * n)
        weight[at + n : at + n + m] = np.frombuffer(blob, np.uint32, m, 4 + 8 * n + 6 * m)
        at += n + m
    _, back = np.unique(keys, return_inverse=True)
    docs = np.minimum(np.bincount(back, weight), 65535).astype(np.uint16)[back]
    out_batches, out_blobs, at = [], [], 0
    for batch, blob, n, m in zip(batches, blobs, sizes, often, strict=True):
        keep = at + np.flatnonzero(docs[at : at + n] > 1)
        if len(keep) or m:
            row = _rows(blob, n, 4 + 6 * n)[keep - at]
            of = slice(at + n, at + n + m)
            out_batches.append(batch)
            out_blobs.append(m.to_bytes(4, "little") + _key_bytes(keys[keep]) + _steps(row) + _bytes(docs[keep]) + _key_bytes(keys[of]) + docs[of].tobytes())
        at += n + m
    return pa.Table.from_arrays([pa.array([block] * len(out_batches), pa.int64()), pa.array(out_batches, pa.int64()), pa.array(out_blobs, pa.binary())], schema=_DEALT)


def _assemble(share: tuple[int, int], blocks: int):
    schema = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("grams", pa.binary())])

    def number(block: np.ndarray | int, key: np.ndarray) -> np.ndarray:
        """An n-gram's number: its block above the bits that tell it apart within the block."""
        return key | np.asarray(block % 65536, np.uint64) << np.uint64(48)

    def run(back: pa.Table) -> pa.Table:
        """The rows of one batch, with the shared n-grams of those that may link, fewest documents first."""
        manifest, row, docs, gram = np.zeros(0, _MANIFEST), [], [], []
        often, often_docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint16)]
        common = held = np.zeros(0, np.uint64)
        common_row = np.zeros(0, np.uint16)
        for block, blob in zip(back.column("block").to_pylist(), back.column("blob").to_pylist(), strict=True):
            if block < 0:
                rows, m = np.frombuffer(blob, np.int64, 2)
                manifest = np.frombuffer(blob, _MANIFEST, rows, 16)
                at = 16 + rows * _MANIFEST.itemsize
                common, held = np.frombuffer(blob, np.uint64, m, at), np.frombuffer(blob, np.int64, m, at + 8 * m)
                common_row = np.frombuffer(blob, np.uint16, -1, at + 16 * m)
                continue
            m = int.from_bytes(blob[:4], "little")
            n = (len(blob) - 4 - 8 * m) // 10
            row.append(_rows(blob, n, 4 + 6 * n))
            docs.append(np.frombuffer(blob, np.uint8, n, 4 + 8 * n) + (np.frombuffer(blob, np.uint8, n, 4 + 9 * n).astype(np.uint16) << np.uint16(8)))
            gram.append(number(block, _keys(blob, n, 4)))
            often.append(number(block, _keys(blob, m, 4 + 10 * n)))
            often_docs.append(np.frombuffer(blob, np.uint16, m, 4 + 10 * n + 6 * m))
        if len(common):
            # What the blocks counted of the common n-grams meets their rows.
            own, order = number(_block_of(common, blocks), common & _KEY), np.argsort(np.concatenate(often))
            count = np.concatenate(often_docs)[order][np.searchsorted(np.concatenate(often)[order], own)]
            row.append(common_row)
            docs.append(np.repeat(count, held))
            gram.append(np.repeat(own, held))
        grams: list[bytes | None] = [None] * len(manifest)
        if row:
            row_, docs_, gram_ = np.concatenate(row), np.concatenate(docs), np.concatenate(gram)
            order = np.lexsort((gram_, docs_, row_))
            gram_, count = gram_[order], np.bincount(row_, minlength=len(manifest))
            end = np.cumsum(count)
            for i in np.flatnonzero(count):
                n, some = int(manifest["n"][i]), int(count[i])
                if n - some < prefix_length(n, share):
                    grams[i] = gram_[end[i] - some : end[i]].tobytes()
        ids = pa.array(np.ascontiguousarray(manifest["doc_id"]), mask=~manifest["known"])
        return pa.Table.from_arrays([ids, *[pa.array(np.ascontiguousarray(manifest[c])) for c in ("tag", "n", "d1", "d2")], pa.array(grams, pa.binary())], schema=schema)

    return run


def _ties(share: tuple[int, int]):
    """Rows (node, n, grams) to (kind, a, b): ties a-b between rows here (0), and n-gram a's smallest row b here (1)."""

    def out(ids: list[np.ndarray], grams: list[np.ndarray]) -> pa.RecordBatch:
        cid = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        gram = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        order = np.lexsort((cid, gram))
        cid, gram = cid[order], gram[order]
        new = np.ones(len(gram), bool)
        new[1:] = gram[1:] != gram[:-1]
        least = cid[new][np.cumsum(new) - 1] if len(gram) else cid
        pairs = np.unique(np.column_stack([cid, least])[cid != least], axis=0) if len(gram) else np.zeros((0, 2), np.int64)
        a = np.concatenate([pairs[:, 0], gram[new].astype(np.int64)])
        b = np.concatenate([pairs[:, 1], cid[new]])
        kind = np.repeat(np.array([0, 1], np.int32), [len(pairs), int(new.sum())])
        return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(a), pa.array(b)], ["kind", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, grams, held = [], [], 0
        for batch in batches:
            for cid, n, blob in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
                own = np.frombuffer(blob, np.uint64)
                take = prefix_length(n, share) - (n - len(own))
                ids.append(np.full(take, cid))
                grams.append(own[:take])
                held += take
            if held >= FLUSH_ENTRIES:
                yield out(ids, grams)
                ids, grams, held = [], [], 0
        yield out(ids, grams)

    return run


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """The product of the incidence of sets with its transpose: how many elements each two share."""
    m = len(sets)
    total = np.zeros((m, m), np.float32)
    row = np.repeat(np.arange(m), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # A column of one row adds to the diagonal alone.
    used = np.cumsum(count > 1) - 1
    keep = count[column] > 1
    row, column = row[keep], used[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, BLOCK_COLUMNS):
        a, b = np.searchsorted(column, (first, first + BLOCK_COLUMNS))
        x = np.zeros((m, BLOCK_COLUMNS), np.float32)
        x[row[a:b], column[a:b] - first] = 1
        total += x @ x.T
    return total


def _least_reached(linked: np.ndarray) -> np.ndarray:
    """For each row the smallest row that its links lead to."""
    label = np.arange(len(linked))
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], len(label)).min(1, initial=len(label)))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _multiply(share: tuple[int, int]):
    schema = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def run(task: pa.Table) -> pa.Table:
        """One task: groups that fit as a whole, or two blocks of a large one (side 0 against side 1)."""
        t = {c: task.column(c).to_numpy() for c in ("node", "n", "copies", "label", "side")}
        blobs = task.column("grams").to_pylist()
        links, root = np.zeros(len(blobs), np.int64), t["node"].copy()
        order = np.lexsort((t["node"], t["label"]))
        new = np.flatnonzero(np.append(True, t["label"][order][1:] != t["label"][order][:-1]))
        for a, b in zip(new, [*new[1:], len(order)], strict=True):
            own = order[a:b]
            if len(own) < 2:
                continue
            n = t["n"][own]
            both = overlaps([np.frombuffer(blobs[i], np.uint64) for i in own]).astype(np.int64)
            linked = share[1] * both >= share[0] * (n[:, None] + n[None, :] - both)
            np.fill_diagonal(linked, False)
            side = t["side"][own]
            if side.any():
                linked &= side[:, None] != side[None, :]
            links[own] = linked @ t["copies"][own]
            root[own] = t["node"][own][_least_reached(linked)]
        return pa.Table.from_arrays([pa.array(t["node"]), pa.array(links), pa.array(root)], schema=schema)

    return run


def _tasks(rows: DataFrame, share: tuple[int, int]) -> DataFrame:
    """rows (label, node, n, copies, grams) with task and side; rows of large groups once for each task."""
    # Sizes of documents that link differ by `share` at most, so by one level.
    step = max(math.log(share[1] / share[0]) * (1 + 1e-9), 0.05)
    rows = rows.withColumn("level", F.floor(F.log(F.col("n").cast("double")) / F.lit(step)).cast("int"))
    sizes = rows.groupBy("label", "level").agg(F.count("*").alias("m")).groupBy("label").agg(F.sum("m").alias("m"), F.map_from_entries(F.collect_list(F.struct("level", F.ceil(F.col("m") / BLOCK_ROWS).cast("int").alias("parts")))).alias("parts"))
    sizes = materialize(sizes, "group-sizes")
    small = sizes.where(F.col("m") <= BLOCK_ROWS).agg(F.coalesce(F.sum("m"), F.lit(0)).alias("m")).first()["m"]
    # Small groups share tasks of as many rows as a block has.
    bins = max(1, -(-small // BLOCK_ROWS))
    rows = rows.join(sizes, "label")
    whole = F.array(F.struct(F.concat(F.lit("bin:"), F.pmod(F.xxhash64("label"), F.lit(bins)).cast("string")).alias("task"), F.lit(0).alias("side")))
    parts = lambda level: F.coalesce(F.try_element_at("parts", level), F.lit(0))
    count = lambda n: F.filter(F.sequence(F.lit(0), n), lambda k: k < n)
    name = lambda a, i, b, j: F.concat_ws(":", F.col("label").cast("string"), a.cast("string"), i.cast("string"), b.cast("string"), j.cast("string"))
    own, level = F.col("part"), F.col("level")
    same = F.transform(count(parts(level)), lambda k: F.struct(name(level, F.least(own, k), level, F.greatest(own, k)).alias("task"), (own > k).cast("int").alias("side")))
    above = F.transform(count(parts(level + 1)), lambda k: F.struct(name(level, own, level + 1, k).alias("task"), F.lit(0).alias("side")))
    below = F.transform(count(parts(level - 1)), lambda k: F.struct(name(level - 1, k, level, own).alias("task"), F.lit(1).alias("side")))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("node"), F.greatest(parts(level), F.lit(1))).cast("int"))
    return rows.withColumn("to", F.explode(F.when(F.col("m") <= BLOCK_ROWS, whole).otherwise(F.concat(same, above, below)))).select("to.task", "to.side", "label", "node", "n", "copies", "grams")


def join(docs: DataFrame, share: tuple[int, int] = SHARE, tag: Column | None = None) -> DataFrame:
    """doc_id, tag, n_shingles, component_id, n_links, group_id of every row.

    component_id: the smallest doc_id that links lead to; n_links: how many other rows link;
    group_id: a number that the rows of a component share and no other has (null where nothing
    links), another on each run. tag: a number by which the caller knows a row.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.lit(0) if tag is None else tag).cast("long").alias("tag"), "text")
    size = known.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size")).first()["size"]
    blocks = max(64, min(-(-size // BLOCK_BYTES), FINE_BLOCKS), -(-size // MOST_BYTES))
    dealt = known.mapInArrow(_deal(blocks), "block long, batch long, blob binary")
    back = dealt.groupBy("block").applyInArrow(_count, "block long, batch long, blob binary")
    rows = back.groupBy("batch").applyInArrow(_assemble(share, blocks), "doc_id long, tag long, n long, d1 long, d2 long, grams binary")
    rows = materialize(rows, "incidence")
    before = len(written(spark))
    classes = rows.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("cid"), F.count("*").alias("copies"), F.max("grams").alias("grams"))
    # A class gets its number as it is written, so it has the same one wherever it is read.
    classes = materialize(classes.where("copies > 1 or grams is not null").withColumn("node", F.monotonically_increasing_id()), "classes")
    may = classes.where("grams is not null").select("node", "n", "copies", "grams")
    ties = materialize(may.select("node", "n", "grams").mapInArrow(_ties(share), "kind int, a long, b long"), "ties")
    hubs = ties.where("kind = 1")
    least = hubs.groupBy("a").agg(F.min("b").alias("least"), F.max("b").alias("most")).where("least < most").select("a", "least")
    edges = ties.where("kind = 0").select("a", "b").union(hubs.join(least, "a").where("b > least").select(F.col("b").alias("a"), F.col("least").alias("b")))
    groups = components(edges)
    tied = materialize(may.join(groups.select("node", "label"), "node"), "tied")
    found = materialize(_tasks(tied, share).groupBy("task").applyInArrow(_multiply(share), "node long, links long, root long"), "links")
    linked = components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    degree = found.groupBy("node").agg(F.sum("links").alias("links"))
    result = classes.select("node", "n", "d1", "d2", "cid", "copies").join(degree, "node", "left")
    result = result.join(linked.select("node", "label"), "node", "left").withColumn("group_id", F.coalesce("label", "node"))
    result = materialize(result, "class-links")
    # Classes that stand alone are their own component; only linked ones look for its smallest id.
    least_id = result.where("label is not null").groupBy("group_id").agg(F.min("cid").alias("component"))
    result = result.join(least_id, "group_id", "left").select("n", "d1", "d2", "copies", "group_id", F.coalesce("component", "cid").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    result = materialize(result, "class-components")
    delete(spark, written(spark)[before:-1])
    # The classes of most copies, at most MOST_COPIED rows, go to all tasks, so that no task gets all copies of one.
    key = ["n", "d1", "d2"]
    copied = F.broadcast(result.orderBy(F.desc("copies"), *key).limit(MOST_COPIED))
    slim = rows.drop("grams")
    some = slim.where("n > 0").join(copied.select(*key), key, "left_anti").join(result, key, "left")
    wordless = slim.where("n = 0").select("*", *[F.lit(None).cast("long").alias(c) for c in ("copies", "group_id", "component", "links")])
    out = some.unionByName(slim.join(copied, key)).unionByName(wordless)
    return out.select("doc_id", "tag", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), "group_id")
