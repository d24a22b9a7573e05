"""Near duplicates: a Jaccard self-join on word n-grams by MinHash banding.

Texts are lower-cased; words are runs of anything but white space; a text's set holds its runs of
``n`` words, or its one run of all words where it has fewer. Two texts link if the Jaccard
similarity of their sets is at least ``threshold``.

1. Every text gets one signature of ``bands * rows`` minima; ``bands`` follows from the recall asked
   for at the threshold. Equal texts (same 64-bit hash) become one node with a number of copies.
2. A band hash that two nodes share makes both candidates; band hashes with the same nodes count as
   one bucket. Only a star per bucket is formed (each node to the least node), so the edges are
   linear in the nodes. Their connected components hold every candidate pair.
3. Candidates meet by component or, where fewer n-gram sets travel that way, by bucket: components of
   texts that are alike only in part grow with the corpus, their buckets do not. Either way the nodes
   are dealt to blocks of about ``BLOCK``; each pair of blocks is one small group that meets on the
   full n-gram sets. A pair in several buckets counts in the least one. A group returns, per node, its
   number of links and the root of its locally connected nodes: nothing grows with the number of
   pairs.
4. The local roots are edges of a second component search, which gives the classes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybird.llm.components import components
from tallybird.llm.staging import staged
from tallybird.llm.texts import whole_text
from tallybird.llm.tokens import CASED, WORDS, grams, mix, random_words, text_slices, tokenise

N = 5
THRESHOLD = 0.8
ROWS = 6
RECALL = 0.999
BLOCK = 48
_CHUNK = 1 << 15
_MARK_BITS = 26


def bands_for(threshold: float = THRESHOLD, rows: int = ROWS, recall: float = RECALL) -> int:
    """The fewest bands of ``rows`` minima that find a pair at ``threshold`` with chance ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def minhash_bands(sets: np.ndarray, bounds: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(texts, bands) band hashes; texts without grams get zeros."""
    count = len(bounds) - 1
    minima = np.full((bands * rows, count), 0xFFFFFFFF, np.uint32)
    short = (sets >> np.uint64(32)).astype(np.uint32)
    factors = (random_words(bands * rows, 31) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    masks = (random_words(bands * rows, 37) >> np.uint64(32)).astype(np.uint32)
    filled = np.flatnonzero(np.diff(bounds) > 0)
    at = 0
    while at < len(filled):  # runs of texts whose grams stay in the processor's cache
        first = bounds[filled[at]]
        to = max(at + 1, int(np.searchsorted(bounds[filled + 1], first + _CHUNK, "right")))
        run = filled[at:to]
        part, starts = short[first : bounds[run[-1] + 1]], bounds[run] - first
        for k in range(bands * rows):
            minima[k, run] = np.minimum.reduceat((part ^ masks[k]) * factors[k], starts)
        at = to
    out = np.zeros((bands, count), np.uint64)
    mult = random_words(rows, 41) | np.uint64(1)
    for r in range(rows):
        out += minima[r::rows].astype(np.uint64) * mult[r]
    return mix(out + np.arange(bands, dtype=np.uint64)[:, None] * np.uint64(0xA24BAED4963EE407)).T


def _signatures(bands: int, rows: int, n: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in text_slices(batch.column("t")):
                words = tokenise(data, offsets, WORDS, CASED)
                sets, bounds = grams(words.hashes, words.bounds, n)
                hashes = minhash_bands(sets, bounds, bands, rows).view(np.int64)
                full = np.diff(bounds) > 0
                ends = np.concatenate([[0], np.cumsum(full * bands)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(low, high - low),
                        batch.column("node").slice(low, high - low),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes[full].ravel())),
                    ],
                    names=["doc_id", "node", "bands"],
                )

    return sign


def _gram_sets(n: int, marks):
    """Full sets of the texts whose node the bitmap ``marks`` has; it may have a few more."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column("node").to_numpy().view(np.uint64) >> np.uint64(64 - _MARK_BITS)
            marked = (marks.value[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1
            batch = batch.filter(pa.array(marked.astype(bool)))
            for low, high, data, offsets in text_slices(batch.column("t")):
                words = tokenise(data, offsets, WORDS, CASED)
                found, bounds = grams(words.hashes, words.bounds, n)
                each = [np.unique(found[a:b]).tobytes() for a, b in zip(bounds, bounds[1:])]
                kept = [batch.column(c).slice(low, high - low) for c in ("doc_id", "node")]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(each, pa.binary())], names=["doc_id", "node", "grams"]
                )

    return sets


def _bitmap(nodes: DataFrame) -> np.ndarray:
    """``2 ** _MARK_BITS`` bits, 8 MB at any size, with the top bits of all nodes set: what it does
    not have need not be moved. More nodes than bits only make it let more pass."""
    place = F.shiftrightunsigned("node", 64 - _MARK_BITS) + 1  # the functions count from 1
    made = (
        nodes.groupBy(F.bitmap_bucket_number(place).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
        .collect()
    )
    out = np.zeros(1 << (_MARK_BITS - 3), np.uint8)
    for row in made:
        bits = np.frombuffer(bytes(row["bits"]), np.uint8)
        out[(row["bucket"] - 1) * len(bits) : row["bucket"] * len(bits)] = bits
    return out


def _roots(linked: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """The least node of each connected part of a small adjacency matrix (reflexive)."""
    label = nodes.copy()
    while True:
        low = np.where(linked, label[None, :], np.iinfo(np.int64).max).min(1)
        if np.array_equal(low, label):
            return label
        label = low


def _earlier(table: pa.Table, first: np.ndarray) -> np.ndarray:
    """Which pairs of the nodes in rows ``first`` share a bucket before this one."""
    bucket = table.column("unit")[0].as_py()
    lists = table.column("buckets")
    held = [x[x < bucket] for x in (lists[int(i)].values.to_numpy() for i in first)]
    keys, which = np.unique(np.concatenate(held), return_inverse=True)
    holds = np.zeros((len(held), len(keys)), np.float32)
    holds[np.repeat(np.arange(len(held)), [len(x) for x in held]), which] = 1
    return holds @ holds.T > 0


def _links(threshold: float):
    def verify(table: pa.Table) -> pa.Table:
        """Exact Jaccard of every pair between two blocks (or within one) of a component or bucket."""
        table = table.combine_chunks()
        node, first = np.unique(table.column("node").to_numpy(), return_index=True)
        block = table.column("block").to_numpy()[first]
        copies = table.column("copies").to_numpy()[first]
        grams_of = table.column("grams")
        sets = [np.frombuffer(grams_of[int(i)].as_buffer(), np.uint64) for i in first]
        size = np.array([len(s) for s in sets], np.float64)
        gram, which = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), size.astype(np.int64))
        shared = np.bincount(which, minlength=len(gram)) > 1
        number = np.cumsum(shared) - 1
        keep = shared[which]
        held = np.zeros((int(shared.sum()), len(sets)), bool)
        held[number[which[keep]], owner[keep]] = True
        # near copies hold the same grams: equal rows of the incidence are counted once
        kinds, times = np.unique(np.packbits(held, axis=1), axis=0, return_counts=True)
        rows = np.unpackbits(kinds, axis=1, count=len(sets)).astype(np.float64)
        both = (rows.T * times) @ rows
        either = size[:, None] + size[None, :] - both
        linked = both >= threshold * either - 1e-9
        if block.min() != block.max():
            linked &= block[:, None] != block[None, :]
        if table.column("by_bucket")[0].as_py():
            linked &= ~_earlier(table, first)
        np.fill_diagonal(linked, False)
        links = linked @ copies
        np.fill_diagonal(linked, True)
        return pa.table({"node": node, "links": links.astype(np.int64), "root": _roots(linked, node)})

    return verify


def _blocks(size: str) -> Column:
    return F.ceil(F.col(size) / BLOCK).cast("int")


def candidates(nodes: DataFrame) -> DataFrame:
    """Where the nodes (node, bands) that share a band hash with another meet: (node, by_bucket, units,
    buckets). ``units`` has (unit, blocks): the node's component, or its buckets where the n-gram sets
    then travel fewer times; ``buckets`` all of its buckets in the second case."""
    keys = nodes.select("node", F.explode("bands").alias("key"))
    mark = F.bit_xor(F.xxhash64("node", F.lit(1)))  # equal for equal sets of nodes
    buckets = staged(
        keys.groupBy("key")
        .agg(F.min("node").alias("hub"), F.max("node").alias("other"), F.count("*").alias("size"), mark.alias("mark"))
        .where("hub < other")
        .groupBy("hub", "other", "size", "mark")
        .agg(F.min("key").alias("bucket"))
        .drop("other", "mark"),
        "buckets",
    )
    # merge joins at every size: a band hash with very many nodes can then be split
    held = staged(keys.join(buckets.hint("merge"), keys["key"] == buckets["bucket"]).drop("key"), "held")
    stars = held.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    groups = staged(components(stars), "candidates")
    large = groups.groupBy("root").agg(F.count("*").alias("size")).where(F.col("size") > BLOCK)
    costs = (
        buckets.join(groups, buckets["hub"] == groups["node"])
        .groupBy("root")
        .agg(F.sum(F.col("size") * _blocks("size")).alias("moved"))
    )
    large = staged(
        large.join(costs, "root").select("root", _blocks("size").alias("blocks"), (F.col("moved") < F.col("size") * _blocks("size")).alias("by_bucket")),
        "large",
    )
    placed = groups.join(large, "root", "left").select(
        "node",
        F.coalesce("by_bucket", F.lit(False)).alias("by_bucket"),
        F.struct(F.col("root").alias("unit"), F.coalesce("blocks", F.lit(1)).alias("blocks")).alias("component"),
    )
    parted = placed.where("by_bucket").select(F.col("node").alias("member"))
    own = (
        held.join(parted, held["node"] == parted["member"])
        .groupBy("node")
        .agg(F.collect_list(F.struct(F.col("bucket").alias("unit"), _blocks("size").alias("blocks"))).alias("own"))
    )  # at most one for each band
    return placed.join(own, "node", "left").select(
        "node",
        "by_bucket",
        F.coalesce("own", F.array("component")).alias("units"),
        F.coalesce(F.col("own.unit"), F.array().cast("array<long>")).alias("buckets"),
    )


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    n: int = N,
    threshold: float = THRESHOLD,
    rows: int = ROWS,
    recall: float = RECALL,
) -> DataFrame:
    """One row per row of ``docs``: (doc_id, class_id, n_links, node, kept).

    ``class_id`` is the least doc_id among all texts that links connect with this one; ``n_links``
    counts the other rows whose text links with this row's, copies included; ``node`` is the hash of
    the lower-cased text; ``kept`` marks the rows with the (node, doc_id) that stands for the class.
    A text without words links with nothing: its class is its own id, it is kept, its ``node`` is
    null. Null ids take part; a class whose ids are all null has a null class_id. Repeated rows are
    copies. Other columns of ``docs`` are not read. An empty table gives an empty table.
    """
    bands = bands_for(threshold, rows, recall)
    base = docs.select(
        docs[doc_id].cast("long").alias("doc_id"), F.lower(whole_text(docs, text)).alias("t")
    ).withColumn("node", F.xxhash64("t"))
    signed = staged(
        base.mapInArrow(_signatures(bands, rows, n), "doc_id long, node long, bands array<long>"),
        "signatures",
    )
    nodes = staged(
        signed.where("size(bands) > 0")
        .groupBy("node")
        .agg(F.min("doc_id").alias("min_id"), F.count("*").alias("copies"), F.first("bands").alias("bands")),
        "nodes",
    )
    members = staged(
        candidates(nodes.select("node", "bands")).join(nodes.select("node", "min_id", "copies"), "node"), "members"
    )
    marks = docs.sparkSession.sparkContext.broadcast(_bitmap(members.select("node")))
    found = base.mapInArrow(_gram_sets(n, marks), "doc_id long, node long, grams binary")
    wanted = members.withColumnRenamed("node", "member").hint("merge")
    sets = found.join(
        wanted, (found["node"] == wanted["member"]) & found["doc_id"].eqNullSafe(wanted["min_id"])
    ).select("node", "copies", "grams", "by_bucket", "buckets", F.inline("units"))
    dealt = sets.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    carried = ["by_bucket", "unit", "node", "copies", "block", "grams", "buckets"]
    pairs = dealt.select(*carried, F.explode(F.expr("sequence(0, blocks - 1)")).alias("with")).select(
        *carried, F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j")
    )
    verified = staged(
        pairs.groupBy("by_bucket", "unit", "i", "j").applyInArrow(_links(threshold), "node long, links long, root long"),
        "links",
    )
    classes = components(verified.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    by_node = staged(
        nodes.select("node", "min_id", "copies")
        .join(classes, "node", "left")
        .join(links, "node", "left")
        .select(
            "node",
            "min_id",
            F.coalesce("root", "node").alias("root"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        ),
        "by-node",
    )
    heads = staged(
        by_node.groupBy("root").agg(
            F.min("min_id").alias("class_id"),
            F.min(F.struct(F.col("min_id").isNull(), "min_id", F.col("node").alias("head"))).alias("first"),
        ).select("root", "class_id", "first.head"),
        "heads",
    )
    settled = staged(by_node.join(heads, "root").drop("root"), "settled")
    rows_ = signed.select("doc_id", F.when(F.size("bands") > 0, F.col("node")).alias("node"))
    return rows_.join(settled, "node", "left").select(
        "doc_id",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        "node",
        (
            F.col("node").isNull()
            | ((F.col("node") == F.col("head")) & F.col("doc_id").eqNullSafe(F.col("min_id")))
        ).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, with one row of each class of near duplicates.

    The row with the least id stays (nulls last); of rows that agree in id and lower-cased text
    exactly one does. Texts without words are no duplicates: all their rows stay.
    """
    found = near_duplicates(docs, doc_id, text)
    heads = staged(
        found.where("kept AND node IS NOT NULL").select("node", F.col("doc_id").alias("kept_id")).distinct(), "kept"
    )
    lowered = F.lower(whole_text(docs, text))
    keyed = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"),
        docs[doc_id].cast("long").alias("id"),
        F.xxhash64(lowered).alias("node"),
        lowered.rlike(r"[^\x20\x09-\x0D]").alias("worded"),
    )
    single = (
        keyed.where("worded")
        .join(heads, (keyed["node"] == heads["node"]) & keyed["id"].eqNullSafe(heads["kept_id"]))
        .select("row", keyed["node"], "id")
        .dropDuplicates(["node", "id"])
        .select("row.*")
    )
    return single.unionByName(keyed.where("NOT worded").select("row.*"))
