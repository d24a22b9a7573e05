"""The prefix trie of conversations, one balanced-parentheses sequence per shard.

A conversation is its path of turn digests. Paths are sorted and dealt out in ranges; a shard of sorted
paths lists its trie in preorder, so the depths alone give its parentheses. ``findclose`` on blocks of
excess minima delimits every subtree, ranks turn its ends into preorder numbers, and sums of a subtree are
differences of running totals.

A node whose members may go on in another shard lies on the path of the shard's first or last conversation,
its spine. A shard settles all other nodes at once and hands on its outline: the spine with what hangs on
it, summed. Outlines in order merge by the same code, first within a task, then in groups of ``FAN``
tasks, until one is left; each round settles what has become inner.
"""

from __future__ import annotations

import hashlib
from binascii import unhexlify
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybird.llm.staging import staged

SHARED = 20  # conversations that share the turns of one
SHARD_TURNS = 1 << 20
FAN = 16
PIECE_IDS = 1 << 16  # ids of a piece of a list of ends
_BLOCK = 64
_FAR = np.iinfo(np.int64).max
_HIGH = np.iinfo(np.int32).max


class Parentheses:
    """A trie as balanced parentheses: '(' where a node begins in preorder, ')' where its subtree ends."""

    def __init__(self, depth: np.ndarray):
        """``depth`` of the nodes in preorder; the first is the root."""
        n = len(depth)
        self.open = 2 * np.arange(n, dtype=np.int64) - depth
        bits = np.zeros(2 * n, np.int8)
        bits[self.open] = 1
        self.leaf = bits[self.open + 1] == 0
        self.excess = np.cumsum(2 * bits - 1, dtype=np.int32)
        blocks = -(-2 * n // _BLOCK)
        padded = np.full(blocks * _BLOCK, _HIGH, np.int32)
        padded[: 2 * n] = self.excess
        self.minima = [padded.reshape(blocks, _BLOCK).min(axis=1)]
        while len(self.minima[-1]) > 1:
            below = self.minima[-1]
            if len(below) % 2:
                below = np.append(below, np.int32(_HIGH))
            self.minima.append(below.reshape(-1, 2).min(axis=1))

    def _least(self, level: int, at: np.ndarray) -> np.ndarray:
        row = self.minima[level]
        return np.where(at < len(row), row[np.minimum(at, len(row) - 1)], _HIGH)

    def _scan(self, at: np.ndarray, want: np.ndarray) -> np.ndarray:
        """From ``at``, the first place with excess ``want`` or less, or else the next block's start."""
        at = at.copy()
        going = np.flatnonzero(at < len(self.excess))
        while True:
            going = going[self.excess[at[going]] > want[going]]
            if not len(going):
                return at
            at[going] += 1
            going = going[(at[going] % _BLOCK != 0) & (at[going] < len(self.excess))]

    def findclose(self, places: np.ndarray) -> np.ndarray:
        """The ')' of each '(' at ``places``."""
        want = self.excess[places] - 1
        at = self._scan(places + 1, want)
        far = np.flatnonzero(self.excess[at] > want)
        if not len(far):
            return at
        # the next block whose minimum is small enough: up the tree, then down
        want, block = want[far], at[far] // _BLOCK
        found, going = np.zeros(len(far), np.int64), np.arange(len(far))
        for level in range(len(self.minima)):
            hit = self._least(level, block[going]) <= want[going]
            sibling = ~hit & (block[going] % 2 == 0) & (self._least(level, block[going] + 1) <= want[going])
            block[going[sibling]] += 1
            found[going] = level
            going = going[~(hit | sibling)]
            block[going] = block[going] // 2 + 1
            if not len(going):
                break
        for level in range(int(found.max()), 0, -1):
            down = np.flatnonzero(found >= level)
            left = 2 * block[down]
            block[down] = np.where(self._least(level - 1, left) <= want[down], left, left + 1)
        at[far] = self._scan(block * _BLOCK, want)
        return at

    def rank(self, places: np.ndarray) -> np.ndarray:
        """How many '(' stand before each of ``places`` (none of them 0)."""
        return (places + self.excess[places - 1]) // 2


class Nodes(NamedTuple):
    """Nodes in preorder. All but depth and words: the node's own, and of what hangs on it beside the
    nodes listed."""

    depth: np.ndarray
    words: np.ndarray  # of the last text
    members: np.ndarray
    least: np.ndarray  # smallest member
    children: np.ndarray
    leaves: np.ndarray
    saved: np.ndarray


class Totals(NamedTuple):
    """Of whole subtrees."""

    parent: np.ndarray  # -1 for the root
    n_convs: np.ndarray
    conv_id: np.ndarray
    n_children: np.ndarray
    n_leaves: np.ndarray
    saved: np.ndarray


def totals(nodes: Nodes) -> Totals:
    depth, n = nodes.depth, len(nodes.depth)
    trie = Parentheses(depth)
    past = trie.rank(trie.findclose(trie.open))  # the subtree of k has the numbers k .. past[k] - 1

    def below(values: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return upto[past] - upto[:-1]

    by_depth = np.argsort(depth, kind="stable")
    level = np.concatenate([[0], np.cumsum(np.bincount(depth))])
    parent, least = np.full(n, -1), nodes.least.copy()
    for d in range(len(level) - 2, 0, -1):
        own, above = by_depth[level[d] : level[d + 1]], by_depth[level[d - 1] : level[d]]
        parent[own] = above[np.searchsorted(above, own) - 1]
        first = np.flatnonzero(np.concatenate([[True], parent[own][1:] != parent[own][:-1]]))
        up = parent[own][first]
        least[up] = np.minimum(least[up], np.minimum.reduceat(least[own], first))
    children = nodes.children + np.bincount(parent[1:], minlength=n)
    n_convs = below(nodes.members)
    leaves = below(nodes.leaves + (trie.leaf & (nodes.children == 0)))
    return Totals(parent, n_convs, least, children, leaves, below(nodes.saved + (n_convs - 1) * nodes.words))


def spine_of(depth: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Nodes on the first or the last path."""
    spine = np.logical_and.accumulate(depth == np.arange(len(depth)))
    at = len(depth) - 1
    while not spine[at]:
        spine[at] = True
        at = parent[at]
    return spine


class Outline(NamedTuple):
    nodes: Nodes
    keys: list[bytes]  # a digest of each node's path


def outline_of(nodes: Nodes, sums: Totals, spine: np.ndarray, keys: list[bytes]) -> Outline:
    """The spine alone, with all else hanging on it. ``keys`` are the spine's."""
    hung = np.flatnonzero(~spine)
    hung = hung[spine[sums.parent[hung]]]
    at = sums.parent[hung]
    out = nodes._asdict()
    for name, values in (("members", sums.n_convs), ("children", np.ones_like(spine, np.int64)), ("leaves", sums.n_leaves), ("saved", sums.saved)):
        out[name] = out[name].astype(np.int64)
        np.add.at(out[name], at, values[hung])
    out["least"] = out["least"].copy()
    np.minimum.at(out["least"], at, sums.conv_id[hung])
    return Outline(Nodes(**{name: values[spine] for name, values in out.items()}), keys)


def merged(outlines: list[Outline]) -> Outline:
    """Outlines of successive shards as one trie: equal keys are one node."""
    number: dict[bytes, int] = {}
    which = np.array([number.setdefault(key, len(number)) for o in outlines for key in o.keys], np.int64)
    first = np.unique(which, return_index=True)[1]
    columns = {name: np.concatenate([getattr(o.nodes, name) for o in outlines]) for name in Nodes._fields}
    out = {name: columns[name][first] for name in ("depth", "words")}
    for name in ("members", "children", "leaves", "saved"):
        out[name] = np.zeros(len(first), np.int64)
        np.add.at(out[name], which, columns[name])
    out["least"] = np.full(len(first), _FAR)
    np.minimum.at(out["least"], which, columns["least"])
    return Outline(Nodes(**out), list(number))


_ROWS = {
    "kind": pa.string(),  # node, outline or ids
    "shard": pa.int32(),
    "place": pa.int64(),
    "key": pa.binary(),
    "parent_key": pa.binary(),
    "conv_id": pa.int64(),
    "depth": pa.int64(),
    "parent_conv_id": pa.int64(),
    "n_convs": pa.int64(),
    "n_children": pa.int64(),
    "n_leaves": pa.int64(),
    "saved_tokens": pa.int64(),
    "words": pa.int64(),
    "text": pa.string(),  # of a node the digest of its ends, of ids the piece of their list
}
_SQL_TYPES = {pa.string(): "string", pa.int32(): "int", pa.int64(): "bigint", pa.binary(): "binary"}
_SCHEMA = ", ".join(f"{name} {_SQL_TYPES[kind]}" for name, kind in _ROWS.items())


def _batch(kind: str, shard: int, n: int, **columns) -> pa.RecordBatch:
    columns |= {"kind": [kind] * n, "shard": [shard] * n}
    made = {name: columns.get(name) for name in _ROWS}
    return pa.RecordBatch.from_arrays(
        [pa.nulls(n, t) if made[name] is None else c if isinstance(c := made[name], pa.Array) else pa.array(c, t) for name, t in _ROWS.items()],
        list(_ROWS),
    )


def _settle(shard: int, nodes: Nodes, sums: Totals, spine: np.ndarray, key_of: dict[int, bytes], own: bool, digests: dict[int, str] | None) -> Iterator[pa.RecordBatch]:
    """Rows of the nodes beside ``spine``. A parent on it has no id yet; its key stands in. ``own``: whether
    the nodes have keys themselves, by which their ends are found."""
    nothing = hashlib.sha256().hexdigest()
    settled = np.flatnonzero(~spine)
    for low in range(0, len(settled), 1 << 16):
        at = settled[low : low + (1 << 16)]
        parent = sums.parent[at]
        above = np.maximum(parent, 0)
        waits = (parent >= 0) & spine[above]
        yield _batch(
            "node",
            shard,
            len(at),
            key=[key_of[k] for k in at.tolist()] if own else None,
            parent_key=[key_of[k] if w else None for k, w in zip(above.tolist(), waits.tolist())],
            conv_id=sums.conv_id[at],
            depth=nodes.depth[at],
            parent_conv_id=pa.array(sums.conv_id[above], pa.int64(), mask=(parent < 0) | waits),
            n_convs=sums.n_convs[at],
            n_children=sums.n_children[at],
            n_leaves=sums.n_leaves[at],
            saved_tokens=sums.saved[at],
            text=None if digests is None else [digests.get(k, nothing) for k in at.tolist()],
        )


def _hand_on(shard: int, outline: Outline) -> pa.RecordBatch:
    nodes, n = outline.nodes, len(outline.keys)
    return _batch(
        "outline", shard, n, place=np.arange(n), key=outline.keys, conv_id=nodes.least, depth=nodes.depth, n_convs=nodes.members,
        n_children=nodes.children, n_leaves=nodes.leaves, saved_tokens=nodes.saved, words=nodes.words,
    )


def _received(table: pa.Table) -> Outline:
    number = lambda name: table.column(name).to_numpy()
    nodes = Nodes(number("depth"), number("words"), number("n_convs"), number("conv_id"), number("n_children"), number("n_leaves"), number("saved_tokens"))
    return Outline(nodes, table.column("key").to_pylist())


def _join(shard: int, outlines: list[Outline], last: bool) -> Iterator[pa.RecordBatch | Outline]:
    """Settled nodes of the outlines' common trie, and its outline unless all are settled (``last``)."""
    whole = merged(outlines)
    sums, key_of = totals(whole.nodes), dict(enumerate(whole.keys))
    spine = np.zeros(len(key_of), bool) if last else spine_of(whole.nodes.depth, sums.parent)
    yield from _settle(shard, whole.nodes, sums, spine, key_of, True, None)
    if not last:
        yield outline_of(whole.nodes, sums, spine, [whole.keys[k] for k in np.flatnonzero(spine)])


def _shard(shard: int, place: int, ids: np.ndarray, digests: np.ndarray, words: np.ndarray, ends: np.ndarray) -> Iterator[pa.RecordBatch | Outline]:
    """Settled nodes, pieces of the spine's lists of ends, and the outline of sorted conversations ``ids``.

    ``digests`` (two 64-bit numbers) and ``words`` of all turns; those of conversation k end at ``ends[k + 1]``.
    """
    n, lengths = len(ids), np.diff(ends)
    # turns that a conversation has in common with the one before
    shared = np.concatenate([[0], np.minimum(lengths[1:], lengths[:-1])])
    upto = np.concatenate([[0], np.cumsum(shared)])
    which = np.repeat(np.arange(n), shared)
    place_in = np.arange(upto[-1]) - upto[which]
    differs = np.flatnonzero((digests[ends[which] + place_in] != digests[ends[which - 1] + place_in]).any(axis=1))
    np.minimum.at(shared, which[differs], place_in[differs])
    # the turns beyond are new nodes, after the root
    new = lengths - shared
    owner = np.repeat(np.arange(n), new)
    begin = np.cumsum(new) - new
    turn = shared[owner] + np.arange(len(owner)) - begin[owner]
    depth = np.concatenate([[0], turn + 1])
    node_digests = digests[ends[owner] + turn]
    node_words = np.concatenate([[0], words[ends[owner] + turn]]).astype(np.int64)
    end = np.cumsum(new)  # the node at which a conversation ends
    zero = np.zeros(len(depth), np.int64)
    least = np.full(len(depth), _FAR)
    np.minimum.at(least, end, ids)
    nodes = Nodes(depth, node_words, np.bincount(end, minlength=len(depth)), least, zero, zero, zero)
    sums = totals(nodes)
    spine = spine_of(depth, sums.parent)
    key_of: dict[int, bytes] = {}
    for k in np.flatnonzero(spine).tolist():
        key_of[k] = hashlib.md5(key_of[int(sums.parent[k])] + node_digests[k - 1].tobytes()).digest() if k else bytes(16)
    # lists of ends
    first = np.flatnonzero(np.concatenate([[True], end[1:] != end[:-1]]))
    hashed, pieces = {}, []
    for node, low, high in zip(end[first].tolist(), first.tolist(), [*first[1:].tolist(), n]):
        if spine[node]:
            for at in range(low, high, PIECE_IDS):
                pieces.append((key_of[node], place + at, ",".join(map(str, ids[at : min(high, at + PIECE_IDS)].tolist()))))
        else:
            hashed[node] = hashlib.sha256(",".join(map(str, ids[low:high].tolist())).encode()).hexdigest()
    yield from _settle(shard, nodes, sums, spine, key_of, False, hashed)
    for low in range(0, len(pieces), 16):
        keys, places, texts = zip(*pieces[low : low + 16])
        yield _batch("ids", shard, len(keys), key=list(keys), place=list(places), text=list(texts))
    yield outline_of(nodes, sums, spine, [key_of[k] for k in sorted(key_of)])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Sorted conversations in runs of about ``SHARD_TURNS`` turns."""
    held, turns = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = np.array([len(w) for w in batch.column("words")], np.int64)
        words = batch.column("words").flatten().to_numpy(zero_copy_only=False)
        digests = np.frombuffer(unhexlify("".join(batch.column("path").to_pylist())), "<u8").reshape(-1, 2)
        held.append((batch.column("conv_id").to_numpy(), digests, words, lengths))
        turns += len(words)
        if turns >= SHARD_TURNS:
            yield _together(held)
            held, turns = [], 0
    if held:
        yield _together(held)


def _together(held: list[tuple]) -> tuple:
    ids, digests, words, lengths = (np.concatenate(x) for x in zip(*held))
    return ids, digests, words, np.concatenate([[0], np.cumsum(lengths)])


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All shards of one range, and one outline of them all."""
    number, place, outline = TaskContext.get().partitionId(), 0, None
    for ids, digests, words, ends in _shards(batches):
        for made in _shard(number, place, ids, digests, words, ends):
            if isinstance(made, Outline):
                parts = [made] if outline is None else [outline, made]
            else:
                yield made
        outline = parts[0]
        if len(parts) > 1:
            for made in _join(number, parts, False):
                if isinstance(made, Outline):
                    outline = made
                else:
                    yield made
        place += len(ids)
    if outline is not None:
        yield _hand_on(number, outline)


def _merge(last: bool):
    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by([("shard", "ascending"), ("place", "ascending")])
        shards = table.column("shard").to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(shards)) + 1, [len(shards)]])
        outlines = [_received(table.slice(low, high - low)) for low, high in zip(cuts[:-1], cuts[1:])]
        made = list(_join(int(shards[0]), outlines, last))
        made = [_hand_on(int(shards[0]), x) if isinstance(x, Outline) else x for x in made]
        return pa.Table.from_batches(made, pa.schema(list(_ROWS.items())))

    return merge


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 per key of its pieces, which come in order, joined by commas."""
    key, state = None, None

    def done(pairs: list[tuple]) -> pa.RecordBatch:
        keys, texts = zip(*pairs) if pairs else ([], [])
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(texts, pa.string())], ["key", "ends"])

    for batch in batches:
        out = []
        for k, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
            if k == key:
                state.update(b",")
            else:
                if key is not None:
                    out.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256()
            state.update(text.encode())
        yield done(out)
    yield done([] if key is None else [(key, state.hexdigest())])


def turn_order(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns): digest and words of the turns of each conversation, by turn, null first; turns of one
    number by digest. Null roles and texts are empty. Rows without a conversation take no part."""

    def plain(name: str) -> Column:
        return F.coalesce(conversations[name].cast("string"), F.lit(""))

    who, said = plain(role), plain(text)
    rows = conversations.where(conversations[conv].isNotNull()).select(
        conversations[conv].cast("bigint").alias("conv_id"),
        F.struct(
            conversations[turn].alias("turn"),
            F.md5(F.concat(F.length(who).cast("string"), F.lit(":"), who, said)).alias("digest"),
            F.regexp_count(said, F.lit(r"[^\x20\x09-\x0D]+")).alias("words"),
        ).alias("one"),
    )
    ordered = F.sort_array(F.collect_list("one"))
    return rows.groupBy("conv_id").agg(F.transform(ordered, lambda x: F.struct(x["digest"], x["words"])).alias("turns"))


def rebuilt(ordered: DataFrame, shared: int = SHARED) -> DataFrame:
    """Conversations of ``turn_order`` that begin with up to three turns of the one ``shared`` of them
    have in common: how many says the CRC-32 of their id."""
    at_front = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")
    hosts = ordered.where(F.col("conv_id") % shared == 0).select(
        F.col("conv_id").alias("host"), F.slice("turns", 1, 3).alias("front")
    )
    own = ordered.select("conv_id", "turns", at_front.alias("h"), (F.col("conv_id") - F.col("conv_id") % shared).alias("host"))
    none = F.array().cast(ordered.schema["turns"].dataType)
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    turns = F.concat(F.slice(F.coalesce("front", none), F.lit(1), F.col("h")), rest)
    return own.join(hosts, "host", "left").select("conv_id", turns.alias("turns"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): one row per
    node of the prefix trie of conversations (conv_id, turns), as ``turn_order`` or ``rebuilt`` give them.

    Conversations without turns end at the root; ids are distinct. An empty table has no node, not
    even a root. A task holds the turns of one shard as digests, 24 bytes each.
    """
    spark = conversations.sparkSession
    digest, words = F.transform("turns", lambda x: x["digest"]), F.transform("turns", lambda x: x["words"])
    paths = conversations.select("conv_id", F.array_join(digest, "").alias("path"), words.alias("words"))
    # whole paths first, then the id, so copies of one conversation can be in many ranges
    dealt = paths.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    made = [staged(dealt.mapInArrow(_build, _SCHEMA), "trie")]
    group, most = 1, made[0].agg(F.max("shard")).first()[0] or 0
    while True:
        group *= FAN
        last = most < group
        outlines = made[-1].where("kind = 'outline'")
        joined = outlines.groupBy((F.col("shard") / group).cast("int").alias("group")).applyInArrow(_merge(last), _SCHEMA)
        made.append(staged(joined, "trie"))
        if last:
            break
    rows = made[0]
    for more in made[1:]:
        rows = rows.unionByName(more)

    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    nodes = rows.where("kind = 'node'")
    pieces = made[0].where("kind = 'ids'").select("key", "shard", "place", "text")
    in_order = pieces.repartition("key").sortWithinPartitions("key", "shard", "place").select("key", "text")
    ends = in_order.mapInArrow(_digest, "key binary, ends string")
    nothing = F.lit(hashlib.sha256().hexdigest())
    # nodes that were on a spine: few, with keys
    keyed = nodes.where("key IS NOT NULL").select("key", "shard", "parent_key", *columns)
    keyed = staged(keyed.join(ends, "key", "left").withColumn("ends_sha256", F.coalesce("ends", nothing)).drop("ends"), "spines")
    inner = nodes.where("key IS NULL").select("shard", "parent_key", *columns, F.col("text").alias("ends_sha256"))
    settled = inner.unionByName(keyed.drop("key"))
    # the parent's id by shard and key, so that the root is no hot key
    waiting = settled.where("parent_key IS NOT NULL")
    parents = (
        waiting.select("shard", "parent_key").distinct()
        .join(keyed.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above")), "parent_key")
    )
    found = waiting.join(parents, ["shard", "parent_key"]).withColumn("parent_conv_id", F.col("above"))
    out = [*columns, "ends_sha256"]
    return settled.where("parent_key IS NULL").select(*out).unionByName(found.select(*out))
