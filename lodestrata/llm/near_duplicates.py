"""n-gram Jaccard join by chosen paths.

A document is the set of its five-word shingles.  Documents with equal sets form
a class; the join runs over one member of each class.  Every run is a random tree
over the sets.  A node draws, from its own path, which of SAMPLES hash functions
tell its children apart: on average 1 / threshold of them, so a pair at the
threshold has one common child on average, at any depth.  A set goes on to the
child of the token (shingle) that is smallest in it under such a function, and two
sets share it with a probability equal to their Jaccard similarity.  A node with at
most LEAF sets is a leaf; at depth DEPTH every node is one.  Leaves are searched by
brute force and the runs repeated until ``missed`` (a pair at the threshold whose
common leaves all lie at the greatest depth) is below 1 - recall; pairs that meet in
shallower leaves, nearly all, are missed far more rarely.

A pair is examined only in the leaf of the smallest id that it shares; each set
carries the ids of its leaves, so this is decided inside the leaf.  Pairs that
agree under fewer than ``sketch_least`` of the SAMPLES functions are not examined; for
a pair at the threshold the chance of that is below SKETCH_CHANCE.  All other pairs
get their exact Jaccard similarity from the whole shingle sets.

Large leaves (a group of thousands of near copies, or a passage in many
documents) are cut into blocks of BLOCK sets and dealt as pairs of blocks to
separate tasks; a task returns link *counts* and a spanning forest, so rows stay
linear in its members and no list of all pairs is ever written.  The forest's
components are the near-duplicate groups.

Result per document: class_id (smallest doc_id of the group), copy_id (smallest
doc_id with the same shingle set), n_links (other documents with similarity at or
above the threshold, members of its own class included) and n_text_links (other
classes linked).

Texts are read twice, for their samples and, of sets that have a pair to examine,
for their shingles; the rows of the latter are found by a join with a table whose
measured size decides whether it is broadcast.

Defined cases: a null text or one without words has an empty set, links to
nothing and is a class of its own; a text of fewer than five words is one
shingle; rows that repeat are members of one class; null ids are ignored when the
smallest id is taken (and the group's id is null if it has no other); an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.arrow_groups import lean, lists, matrix, runs, slices
from lodestrata.llm.columns import text_key
from lodestrata.llm.components import components
from lodestrata.llm.shingles import minhash, shingle_set, texts_of
from lodestrata.storage import discard, materialise, sized

DEPTH = 3
LEAF = 64
BLOCK = 512
SAMPLES = 64
SKETCH_CHANCE = 1e-9
#: Bytes of text whose shingles a task holds at once.
SLICE_BYTES = 4 << 20
#: Cells of a dense shingle matrix that one multiplication may hold.
DENSE_CELLS = 8_000_000


def root_children(run: int, threshold: float) -> int:
    """Hash functions that split the root of a run: 1 / threshold on average over the runs."""
    return int((run + 1) / threshold + 1e-9) - int(run / threshold + 1e-9)


def missed(runs: int, threshold: float, depth: int = DEPTH) -> float:
    """Chance that a pair at the threshold shares no leaf at ``depth`` in any of ``runs`` runs."""
    whole = int(1 / threshold + 1e-9)
    part = 1 / threshold - whole
    alive = 1.0
    for _ in range(depth - 1):
        alive = 1 - (1 - threshold * alive) ** whole * (1 - part * threshold * alive)
    chance = 1.0
    for run in range(runs):
        chance *= (1 - threshold * alive) ** root_children(run, threshold)
    return chance


def runs_for(threshold: float, recall: float, depth: int = DEPTH) -> int:
    count = 1
    while missed(count, threshold, depth) > 1 - recall:
        count += 1
    return count


def sketch_least(threshold: float) -> int:
    """The largest m for which Binomial(SAMPLES, threshold) lies below m with a chance of at most SKETCH_CHANCE."""
    total, m = 0.0, 0
    while m < SAMPLES:
        total += math.comb(SAMPLES, m) * threshold**m * (1 - threshold) ** (SAMPLES - m)
        if total > SKETCH_CHANCE:
            break
        m += 1
    return m


def _sampler(k: int):
    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in slices(batch.column("text"), SLICE_BYTES):
                sets = [shingle_set(raw, k) for raw in texts_of(texts)]
                keys = [blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                drawn = iter(minhash([s for s in sets if len(s)], SAMPLES).view(np.int32))
                samples = [next(drawn) if len(s) else None for s in sets]
                ids, text_keys = (batch.column(c).slice(begin, len(texts)) for c in ("doc_id", "key"))
                yield pa.RecordBatch.from_arrays([ids, text_keys, pa.array(keys, pa.binary()), pa.array(samples, pa.list_(pa.int32()))], ["doc_id", "key", "node", "sample"])
    return sample


def _shingler(k: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in slices(batch.column("text"), SLICE_BYTES):
                sets = [shingle_set(raw, k).view(np.int64) for raw in texts_of(texts)]
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(begin, len(texts)), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])
    return make


def _candidates(table: pa.Table) -> np.ndarray:
    """Upper-triangle matrix of the pairs whose smallest common leaf is this cell's."""
    block = table.column("block").to_numpy()
    leaf, i, j = (table.column(c)[0].as_py() for c in _CELL)
    wanted = np.triu(np.ones((len(block),) * 2, bool), 1)
    if i != j:
        wanted &= block[:, None] != block[None, :]
    held = lists(table.column("leaves"), np.int64)
    owner = np.repeat(np.arange(len(held)), [len(x) for x in held])
    every = np.concatenate(held)
    owner, every = owner[every < leaf], every[every < leaf]
    order = np.argsort(every, kind="stable")
    owner, every = owner[order], every[order]
    cuts = np.flatnonzero(np.diff(every)) + 1
    for members in np.split(owner, cuts):
        if len(members) > 1:
            wanted[np.ix_(members, members)] = False
    return wanted


_CELL = ["leaf", "i", "j"]


def _needed(least: int):
    """The rows of each cell that are in a pair to examine, without their samples."""
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, _CELL):
            if table.num_rows < 2:
                continue
            wanted = _candidates(table)
            if not wanted.any():
                continue
            sample = matrix(table.column("sample"), SAMPLES, np.int32)
            agree = np.zeros(wanted.shape, np.int8)
            for c in range(SAMPLES):
                agree += sample[:, c][:, None] == sample[:, c][None, :]
            wanted &= agree >= least
            some = wanted.any(0) | wanted.any(1)
            if some.any():
                yield from table.drop_columns(["sample"]).filter(pa.array(some)).combine_chunks().to_batches()
    return keep


def overlaps(sets: list[np.ndarray], first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Exact intersection sizes of the pairs (first[p], second[p])."""
    if len(first) <= 4 * len(sets):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(first, second)], np.int64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, where, uses = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = uses[where] > 1
    owner, where = owner[shared], where[shared]
    number = np.cumsum(uses > 1) - 1
    where = number[where]
    total = np.zeros((len(sets),) * 2, np.float64)
    width = max(1, DENSE_CELLS // len(sets))
    order = np.argsort(where, kind="stable")
    owner, where = owner[order], where[order]
    for begin in range(0, int(where[-1]) + 1 if len(where) else 0, width):
        lo, hi = np.searchsorted(where, (begin, begin + width))
        dense = np.zeros((len(sets), int(where[hi - 1]) - begin + 1 if hi > lo else 1), np.float32)
        dense[owner[lo:hi], where[lo:hi] - begin] = 1
        total += dense @ dense.T
    return total[first, second].astype(np.int64)


def _forest(size: int, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The smallest member of each member's component."""
    parent = list(range(size))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(first.tolist(), second.tolist()):
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    return np.array([root(x) for x in range(size)])


def _verifier(numerator: int, denominator: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, _CELL):
            if table.num_rows < 2:
                continue
            first, second = np.nonzero(_candidates(table))
            if not len(first):
                continue
            sets = lists(table.column("shingles"), np.int64)
            sizes = np.array([len(s) for s in sets], np.int64)
            common = overlaps(sets, first, second)
            linked = common * denominator >= numerator * (sizes[first] + sizes[second] - common)
            first, second = first[linked], second[linked]
            if not len(first):
                continue
            members = table.column("members").to_numpy()
            weight = np.bincount(first, members[second], len(sets)) + np.bincount(second, members[first], len(sets))
            links = np.bincount(first, minlength=len(sets)) + np.bincount(second, minlength=len(sets))
            root = _forest(len(sets), first, second)
            some = links > 0
            nodes = table.column("node").combine_chunks()
            nodes = nodes.chunk(0) if isinstance(nodes, pa.ChunkedArray) else nodes
            yield pa.RecordBatch.from_arrays(
                [nodes.filter(pa.array(some)), nodes.take(pa.array(root[some])), pa.array(weight[some].astype(np.int64)), pa.array(links[some].astype(np.int64))],
                ["node", "root", "weight", "links"],
            )
    return verify


def _child(path: Column, function: Column) -> Column:
    return F.xxhash64(path, function, F.element_at("sample", function + 1))


def _roots(count: int, threshold: float) -> tuple[Column, int]:
    """The first children of a set in all runs, and the number of hash functions these use up."""
    found, used = [], 0
    for run in range(count):
        for _ in range(root_children(run, threshold)):
            found.append(_child(F.lit(run), F.lit(used)))
            used += 1
    return F.array(*found), used


def _children(path: Column, used: int, threshold: float) -> Column:
    """The children of a set at the node ``path``, by functions that the node's path draws from those the roots leave."""
    whole = int(1 / threshold + 1e-9)
    part = round((1 / threshold - whole) * 1_000_000)
    first = F.pmod(F.xxhash64(path, F.lit("function")), F.lit(SAMPLES - used)).cast("int")
    found = []
    for n in range(whole + (part > 0)):
        child = _child(path, F.lit(used) + F.pmod(first + n, F.lit(SAMPLES - used)))
        found.append(child if n < whole else F.when(F.pmod(F.xxhash64(path, F.lit("part")), F.lit(1_000_000)) < part, child))
    return F.array_compact(F.array(*found))


def _leaves(sets: DataFrame, count: int, threshold: float, leaf: int) -> tuple[DataFrame, list[DataFrame]]:
    """(node, leaf, n) for every leaf that holds at least two sets, and the tables that it reads."""
    roots, used = _roots(count, threshold)
    if used >= SAMPLES - 1:
        raise ValueError("the runs use up all hash functions")
    alive, found, tables = sets.select("node", F.explode(roots).alias("leaf")), None, []
    for level in range(1, DEPTH + 1):
        sizes = materialise(alive.groupBy("leaf").agg(F.count("*").alias("n")).where("n > 1"), f"nodes-{level}")
        placed = materialise(alive.join(sizes, "leaf"), f"placed-{level}")
        discard(sizes, *([alive] if level > 1 else []))
        tables.append(placed)
        ends = placed if level == DEPTH else placed.where(F.col("n") <= leaf)
        found = ends if found is None else found.unionByName(ends)
        if level < DEPTH:
            going = placed.where(F.col("n") > leaf).select("node", F.col("leaf").alias("path")).join(sets.select("node", "sample"), "node")
            alive = materialise(going.select("node", F.explode(_children(F.col("path"), used, threshold)).alias("leaf")), f"alive-{level}")
    return found, tables


def classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: tuple[int, int] = (4, 5), recall: float = 0.9999, k: int = 5, leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """doc_id, key (of the text), node, group, class_id, copy_id, n_links and n_text_links of every row."""
    numerator, denominator = threshold
    share = numerator / denominator
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_key(F.col(text)).alias("key"), F.col(text).alias("text"))
    kind = docs.schema[doc_id].dataType.simpleString()
    sampled = materialise(rows.mapInArrow(lean(_sampler(k)), f"doc_id {kind}, key struct<a:bigint,b:bigint>, node binary, sample array<int>"), "sampled")
    sets = materialise(
        sampled.where("node is not null").groupBy("node")
        .agg(F.min("doc_id").alias("copy_id"), F.count("*").alias("members"), F.min(F.struct("doc_id", "key")).alias("first"), F.first("sample").alias("sample")),
        "sets",
    )
    leaves, tables = _leaves(sets, runs_for(share, recall), share, leaf)
    carried = materialise(
        leaves.groupBy("node").agg(F.collect_list("leaf").alias("leaves")).join(sets.select("node", "members", "sample"), "node"), "carried",
    )
    cells = (
        leaves.withColumn("blocks", F.ceil(F.col("n") / F.lit(block)).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("node", "leaf", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
        .join(carried, "node").select("node", *_CELL, "block", "members", "leaves", "sample")
    )
    dealt = cells.repartition(*_CELL).sortWithinPartitions(*_CELL)
    need = materialise(dealt.mapInArrow(lean(_needed(sketch_least(share))), cells.drop("sample").schema), "to-examine")
    discard(carried, *tables)

    # One row of the documents for each set that has a pair to examine.
    chosen = materialise(need.select("node").distinct().join(sets.select("node", "first"), "node"), "chosen")
    texts = rows.withColumn("first", F.struct("doc_id", "key")).join(sized(chosen), "first").select("node", "text")
    shingles = texts.mapInArrow(lean(_shingler(k)), "node binary, shingles array<bigint>").dropDuplicates(["node"])
    examined = need.join(shingles, "node").repartition(*_CELL).sortWithinPartitions(*_CELL)
    linked = materialise(examined.mapInArrow(lean(_verifier(numerator, denominator)), "node binary, root binary, weight bigint, links bigint"), "linked")
    discard(need, chosen)

    labels = components(linked.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = labels.join(sets.select("node", "copy_id"), "node")
    groups = named.groupBy("label").agg(F.min("copy_id").alias("class_id"))
    sums = linked.groupBy("node").agg(F.sum("weight").alias("weight"), F.sum("links").alias("links"))
    per_set = materialise(
        sets.select("node", "copy_id", "members")
        .join(sums, "node", "left")
        .join(labels.join(groups, "label").select("node", "label", "class_id"), "node", "left")
        .select(
            "node", "copy_id", F.coalesce("label", "node").alias("group"), F.when(F.col("label").isNull(), F.col("copy_id")).otherwise(F.col("class_id")).alias("class_id"),
            (F.col("members") - 1 + F.coalesce("weight", F.lit(0))).alias("n_links"),
            F.coalesce("links", F.lit(0)).alias("n_text_links"),
        ),
        "set-classes",
    )
    discard(linked, sets)
    return sampled.select("doc_id", "key", "node").join(per_set, "node", "left").select(
        "doc_id", "key", "node", "group",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("copy_id")).alias("copy_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("n_text_links", F.lit(0)).cast("long").alias("n_text_links"),
    )


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """``docs`` with one row of each group, the one with the smallest (doc_id, text key); of rows that repeat id and text one stays."""
    columns = list(docs.columns)
    found = materialise(classes(docs, text, doc_id, **options).select(F.struct("doc_id", "key").alias("place"), "group"), "places")
    stays = found.where("group is not null").groupBy("group").agg(F.min("place").alias("place")).select("place")
    goes = found.where("group is not null").select("place").distinct().join(stays, "place", "left_anti")
    again = found.groupBy("place").agg(F.count("*").alias("times")).where("times > 1").select("place")
    goes = materialise(goes.select("place", F.lit(False).alias("twice")).unionByName(again.join(goes, "place", "left_anti").select("place", F.lit(True).alias("twice"))), "goes")
    discard(found)
    wide = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")
    marked = docs.select(wide, F.struct(F.col(doc_id).alias("doc_id"), text_key(F.col(text)).alias("key")).alias("place"))
    once = marked.join(sized(goes), "place", "left_anti").select("row.*")
    several = goes.where("twice").select("place")
    if not several.head(1):  # no row repeats id and text: one pass over the texts is enough
        return once
    return once.unionByName(marked.join(several, "place", "left_semi").dropDuplicates(["place"]).select("row.*"))
