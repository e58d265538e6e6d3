"""MinHash near-duplicate groups with tensored banding.

A text's set is that of its distinct shingles (runs of ``n`` words, A-Z lower-cased; a text of fewer words is one shingle).
Two collections of ``SIDE`` minhash pairs are computed, ``4 * SIDE`` minhashes in all; a table is a pair of one entry from
each, which makes ``SIDE ** 2`` tables of four minhashes. Two sets of similarity 0.8 miss every table with a probability
under ``2 * 0.36 ** SIDE``.

Steps, all keyed by single documents or by table keys:

1. ``sketches``: one pass over the texts. Equal sets are collapsed inside the task to their smallest id, then across tasks,
   so that copies, however many, enter the tables once.
2. Tables: each task groups its own keys first and sends one row a key, so no key has more rows than there are tasks.
   Members of a bucket are paired with its hub, chosen by one of a few orders; nothing emits all pairs.
3. Candidates are confirmed on their full sets, whose shingles are compared by their words' bytes. Components come from
   confirmed links. (Equal sets are told by 128 bits of digests.)
4. The rest, exactly: documents of buckets that still hold several components are compared by a prefix filter over their
   own shingles, rarest first, which finds every link that the hubs missed.

Defined results: a null or empty text, or one without words, has no shingles and no links. Rows of one id are one
document. A null id is never linked and is its own group. An empty table gives an empty result. Only the id and the text
of the input are read, whatever its other columns are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit
from .common import in_slots, materialized, partitions, texts
from .graph import components

SIDE = 12
#: Orders in which hubs are taken, by table.
HUBS = 4
HASHES = 4 * SIDE
U64 = np.uint64
_SEEDS = textkit.mix(np.arange(1, 2 * HASHES + 1, dtype=U64) * U64(0xD1342543DE82EF95))
_ADD, _TIMES = _SEEDS[:HASHES], _SEEDS[HASHES:] | U64(1)


def _sets(row: np.ndarray, shingle: np.ndarray, rows: int, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct shingles of each row, sorted, what belongs to them, and where each row's begin."""
    order = np.lexsort((shingle, row))
    row, shingle = row[order], shingle[order]
    keep = np.ones(len(row), bool)
    keep[1:] = (row[1:] != row[:-1]) | (shingle[1:] != shingle[:-1])
    return shingle[keep], *(x[order][keep] for x in more), np.searchsorted(row[keep], np.arange(rows + 1))


def shingle_sets(data: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each row, by the digests of their words: sorted first halves, second halves, and where each row's begin."""
    words = textkit.Words(data, offs, lower=True)
    at = words.runs(n)
    count = np.diff(words.first)
    short = np.flatnonzero((count > 0) & (count < n))
    row = np.concatenate([words.row[at], short])
    halves = []
    for half in words.digests():
        sums = textkit.prefix_sums(half)
        whole = textkit.spans_hash(sums, words.first[short], words.first[short + 1])
        halves.append(np.concatenate([textkit.windows_hash(sums, n)[at], whole]))
    return _sets(row, halves[0], len(offs) - 1, halves[1])


def exact_sets(data: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each row as numbers, sorted, and where each row's begin. Two shingles have one number if and only if their words have equal bytes."""
    words = textkit.Words(data, offs, lower=True)
    count = np.diff(words.first)
    # A text of fewer words is filled up with a number that no word has.
    fill = np.where((count > 0) & (count < n), n - count, 0)
    number = np.insert(words.number[0] + 1, np.repeat(words.first[1:], fill), 0)
    first = words.first + np.append(0, np.cumsum(fill))
    row = np.repeat(np.arange(len(count)), np.diff(first))
    shingle = textkit.window_numbers(number, n)
    at = np.flatnonzero(np.arange(len(shingle)) + n <= first[row[: len(shingle)] + 1])
    return _sets(row[at], shingle[at], len(count))


def _sums_by_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, U64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def sketches(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, n_shingles, h1, h2, rep, sig): h1, h2 name the set, by sums of both halves of its shingles' digests; rep is the smallest id of the task with that set; sig is there for these alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, h1, h2, sigs = [], [], [], [], []
        for rows, data, offs in textkit.blocks(batches):
            sets, second, first = shingle_sets(data, offs, n)
            size = np.diff(first)
            full = np.flatnonzero(size)
            sig = np.zeros((rows.num_rows, HASHES), np.uint32)
            if len(full):
                for k in range(HASHES):
                    sig[full, k] = np.minimum.reduceat((sets ^ _ADD[k]) * _TIMES[k], first[full]) >> U64(32)
            ids.append(np.array(rows.column(0).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)))
            sizes.append(size)
            h1.append(_sums_by_row(textkit.mix(sets), first))
            h2.append(_sums_by_row(textkit.mix(second), first))
            sigs.append(sig)
        if not ids:
            return
        ids, sizes, h1, h2, sigs = (np.concatenate(x) for x in (ids, sizes, h1, h2, sigs))
        order = np.lexsort((ids, sizes, h2, h1))
        new = np.ones(len(ids), bool)
        new[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1]) | (sizes[order][1:] != sizes[order][:-1])
        lead = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
        rep = np.empty(len(ids), np.int64)
        rep[order] = ids[lead]
        own = np.zeros(len(ids), bool)
        own[order[new]] = True
        own &= sizes > 0
        missing = ids == -(1 << 63)
        rep = np.where(sizes > 0, rep, ids)
        for at in range(0, len(ids), 4096):
            part = slice(at, at + 4096)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[part], mask=missing[part]),
                    pa.array(sizes[part].astype(np.int64)),
                    pa.array(h1[part].view(np.int64)),
                    pa.array(h2[part].view(np.int64)),
                    pa.array(rep[part], mask=missing[part]),
                    pa.array([s.tobytes() if o else None for s, o in zip(sigs[part], own[part] & ~missing[part], strict=True)], pa.binary()),
                ],
                names=["doc_id", "n_shingles", "h1", "h2", "rep", "sig"],
            )

    return texts(docs).mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long, rep long, sig binary")


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, HASHES).astype(U64)


def table_keys(sig: np.ndarray) -> np.ndarray:
    """Keys by document and table: each pairs one entry of the first collection with one of the second."""
    half = [textkit.mix(sig[:, 2 * k] * U64(0x100000001B3) + textkit.mix(sig[:, 2 * k + 1] + U64(k << 32))) for k in range(2 * SIDE)]
    return np.stack([textkit.mix(half[i] + U64(3) * half[SIDE + j]) for i in range(SIDE) for j in range(SIDE)], 1)


def _hub_rank(ids: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Order in which members are taken as hubs: by id in tables of kind 0, by a hash of the id and the kind in others."""
    return np.where(kind == 0, ids.view(U64), textkit.mix(ids.view(U64) ^ (kind.astype(U64) << U64(48))))


def _stars(keys: np.ndarray, ids: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the rows by key and hub rank, and for each its hub's row."""
    order = np.lexsort((ids, _hub_rank(ids, kind), keys))
    new = np.ones(len(order), bool)
    new[1:] = keys[order][1:] != keys[order][:-1]
    return order, order[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(order) else order


#: Rows between tasks. Of a bucket: its key, its hub in the task, kind (+ SEVERAL if the task has more members). Of a pair: b, a, kind + PAIR.
_BUCKET = "key long, id long, mark long"
SEVERAL, PAIR = 16, 32


def _own_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's documents: one row for each bucket, and the pairs of its other members with its hub."""
    textkit.release()
    for whole in batches:
        for at in range(0, whole.num_rows, 2048):
            batch = whole.slice(at, 2048)
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            keys = table_keys(_signatures(batch.column(1))).reshape(-1)
            who, kind = np.repeat(np.arange(len(ids)), SIDE * SIDE), np.tile(np.repeat(np.arange(SIDE) % HUBS, SIDE), len(ids))
            order, hub = _stars(keys, ids[who], kind)
            a, b, k = who[order], who[hub], kind[order]
            lead = order == hub
            more = np.append(~lead[1:], False)
            yield _rows(keys[order[lead]].view(np.int64), ids[a[lead]], k[lead] + SEVERAL * more[lead])
            once = np.unique(np.stack([a[~lead], b[~lead], k[~lead]], 1), axis=0)
            yield _rows(ids[once[:, 1]], ids[once[:, 0]], once[:, 2] + PAIR)


def _rows(key: np.ndarray, ids: np.ndarray, mark: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids), pa.array(mark)], names=["key", "id", "mark"])


#: Of a pair (a, b) with b a hub: ALONE if the bucket has no further members, OWN if b is the hub of a slice, TOP if it is the whole bucket's and a a slice's hub.
_PAIR = "a long, b long, kind long, wide int"
ALONE, OWN, TOP = 0, 1, 2


def _all_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the rows of whole keys: pairs (a, b) with the buckets' hubs, and the pairs that tasks found before."""
    held = []
    textkit.release()
    for batch in batches:
        mark = batch.column(2).to_numpy(zero_copy_only=False)
        found = mark >= PAIR
        if found.any():
            done = batch.filter(pa.array(found))
            yield _pairs(done.column(1).to_numpy(), done.column(0).to_numpy(), mark[found] - PAIR, np.full(int(found.sum()), OWN))
        if not found.all():
            held.append(batch.filter(pa.array(~found)))
    if not held:
        return
    table = pa.Table.from_batches(held)
    keys, ids, mark = (table.column(k).to_numpy() for k in range(3))
    kind = mark & (SEVERAL - 1)
    order, hub = _stars(keys.view(U64), ids, kind)
    new = order == hub
    start = np.flatnonzero(new)
    members = np.add.reduceat(1 + (mark[order] >= SEVERAL), start)
    wide = np.repeat(np.where(members > 2, TOP, ALONE), np.diff(np.append(start, len(order))))
    rows = np.stack([ids[order], ids[hub], kind[order], wide], 1)[~new]
    once = np.unique(rows, axis=0)
    for at in range(0, len(once), 1 << 16):
        part = once[at : at + (1 << 16)]
        yield _pairs(part[:, 0], part[:, 1], part[:, 2], part[:, 3])


def _pairs(a: np.ndarray, b: np.ndarray, kind: np.ndarray, wide: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in (a, b, kind, wide.astype(np.int32))], names=["a", "b", "kind", "wide"])


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text) of the distinct ``ids``, a row each. The join is an inner one: Spark moves a semi join below the filter by slots, so that all texts would be shuffled."""
    return in_slots(texts(docs), ids).join(ids, "doc_id").dropDuplicates(["doc_id"])


def confirm(pairs: DataFrame, held: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are alike enough: 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        textkit.release()
        for whole in batches:
            size = np.append(0, np.cumsum(np.diff(textkit.text_bytes(whole.column(2))[1])))
            at = 0
            while at < whole.num_rows:
                to = min(at + 256, max(at + 1, int(np.searchsorted(size, size[at] + textkit.BLOCK_BYTES, "right")) - 1))
                batch, at = whole.slice(at, to - at), to
                # A hub's rows stand together, so that its set is made once.
                _, first, which = np.unique(batch.column(1).to_numpy(), return_index=True, return_inverse=True)
                data, offs = textkit.text_bytes(pa.chunked_array([batch.column(2), batch.column(3).take(pa.array(first))]))
                sets, begin = exact_sets(data, offs, n)
                good = np.zeros(batch.num_rows, bool)
                for k, h in enumerate((which + batch.num_rows).tolist()):
                    p, q = sets[begin[k] : begin[k + 1]], sets[begin[h] : begin[h + 1]]
                    if len(p) and 100 * min(len(p), len(q)) >= percent * max(len(p), len(q)):
                        both = len(np.intersect1d(p, q, assume_unique=True))
                        good[k] = 100 * both >= percent * (len(p) + len(q) - both)
                yield batch.select([0, 1]).filter(pa.array(good))

    left = held.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    right = held.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _prefix_rows(held: DataFrame, n: int) -> DataFrame:
    """(doc_id, size, shingle) of each distinct shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in textkit.blocks(batches):
            sets, _, first = shingle_sets(data, offs, n)
            size = np.diff(first)
            ids = rows.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, size)), pa.array(np.repeat(size, size).astype(np.int32)), pa.array(sets.view(np.int64))], names=["doc_id", "size", "shingle"])

    return held.select("doc_id", "text").mapInArrow(run, "doc_id long, size int, shingle long")


def _missed(held: DataFrame, label: DataFrame, n: int, percent: int) -> DataFrame:
    """Candidate pairs (a, b) of different components, by a prefix filter: exact for the documents in ``held``.

    Sets with 100 * intersection >= percent * union have a common shingle among the first size - ceil(percent * size / 100)
    + 1 of each in any common order; here the rarest come first. The first that they share, at places i and j, leaves
    min(size_x - i, size_y - j) that can be common, which must be at least percent / (100 + percent) of both sizes. A text
    that differs from a large group by shingles of its own has these in front, so it is paired with few or none.
    """
    rows = _prefix_rows(held, n)
    often = rows.groupBy("shingle").agg(F.count("*").alias("n")).filter("n > 1")
    common = rows.join(often, "shingle").select("doc_id", "size", "shingle", "n")

    def prefix(key: tuple, batch: pa.Table) -> pa.Table:
        size = batch.column("size")[0].as_py()
        own = size - batch.num_rows  # shingles that no other document has come first
        keep = size - (-(-percent * size // 100)) + 1 - own
        order = np.lexsort((batch.column("shingle").to_numpy(), batch.column("n").to_numpy()))[: max(0, keep)]
        out = batch.take(pa.array(order)).select(["doc_id", "size", "shingle"])
        return out.append_column("place", pa.array(np.arange(own, own + len(order)), pa.int64()))

    heads = common.groupBy("doc_id").applyInArrow(prefix, "doc_id long, size int, shingle long, place long")
    heads = heads.join(label, heads["doc_id"] == label["node"], "left").select("doc_id", "size", "shingle", "place", F.coalesce("component", "doc_id").alias("component"))
    heads = materialized(heads, "near-prefix")
    mixed = heads.groupBy("shingle").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).filter("c0 <> c1").select("shingle")
    heads = heads.join(mixed, "shingle", "left_semi").withColumn("room", F.col("size") - F.col("place"))
    x, y = (heads.select("shingle", *[F.col(c).alias(f"{c}_{v}") for c in ("doc_id", "size", "component", "room")]) for v in "xy")
    enough = f"{100 + percent} * least(room_x, room_y) >= {percent} * (size_x + size_y)"
    pairs = x.join(y, "shingle").filter(f"component_x <> component_y AND doc_id_x > doc_id_y AND {enough}")
    return pairs.select(F.col("doc_id_x").alias("a"), F.col("doc_id_y").alias("b")).distinct()


def opened(stars: DataFrame, label: DataFrame) -> DataFrame:
    """doc_id of all members of buckets of three or more of which some are in another component than their hub.

    Buckets are stars of stars: members under the hub of their slice, these hubs under the bucket's. One stray at either
    level opens the bucket, with the members of all its slices: first up from its star to the buckets' hubs, then down.
    """
    name = lambda c, x: label.select(F.col("node").alias(c), F.col("component").alias(x))
    wide = stars.filter(F.col("wide") > ALONE).select("a", "b", "wide")
    named = wide.join(name("a", "ca"), "a", "left").join(name("b", "cb"), "b", "left")
    mixed = materialized(named.filter("coalesce(ca, a) <> coalesce(cb, b)").select("b").distinct(), "near-mixed")
    top = wide.filter(F.col("wide") == TOP).select("a", "b")
    roots = materialized(mixed.unionByName(top.join(mixed.withColumnRenamed("b", "a"), "a", "left_semi").select("b")).distinct(), "near-mixed")
    hubs = materialized(roots.unionByName(top.join(roots, "b", "left_semi").select(F.col("a").alias("b"))).distinct(), "near-mixed")
    members = wide.join(hubs, "b", "left_semi").select(F.col("a").alias("doc_id"))
    return members.unionByName(hubs.select(F.col("b").alias("doc_id"))).distinct()


def near_groups(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row a row of ``docs``. component_id is the smallest id that links reach."""
    spark = docs.sparkSession
    sketch = materialized(sketches(docs, n), "near-sketches")
    local = sketch.filter("sig IS NOT NULL").select("doc_id", "n_shingles", "h1", "h2", "sig").dropDuplicates(["doc_id"])
    sets = local.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.min_by("sig", "doc_id").alias("sig"))
    sets = materialized(sets, "near-sets")
    same = local.join(sets, ["h1", "h2", "n_shingles"]).filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    reps = sets.select(F.col("rep").alias("doc_id"), "n_shingles", "sig")

    keyed = reps.select("doc_id", "sig").mapInArrow(_own_buckets, _BUCKET).repartition(partitions(spark), "key")
    stars = keyed.mapInArrow(_all_buckets, _PAIR).groupBy("a", "b").agg(F.max("wide").alias("wide"))
    stars = materialized(stars, "near-stars")
    ids = stars.select(F.col("a").alias("doc_id")).unionByName(stars.select(F.col("b").alias("doc_id"))).distinct()
    held = materialized(texts_of(docs, ids), "near-texts")

    links = materialized(confirm(stars, held, n, percent), "near-links")
    label = materialized(components(links), "near-labels")

    open_ids = opened(stars, label)
    rest = materialized(held.join(open_ids, "doc_id", "left_semi"), "near-rest")
    more = materialized(confirm(_missed(rest, label, n, percent), rest, n, percent), "near-links")

    final = components(links.unionByName(more).unionByName(same))
    out = sketch.join(final.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.coalesce("component", "rep")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its group of near copies."""
    columns = docs.columns
    gone = near_groups(docs, n, percent).filter("NOT kept").select(F.col("doc_id").alias("__gone_id")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["__gone_id"], "left_anti").select(*columns)
