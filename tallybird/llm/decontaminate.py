"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

Words are runs of letters and digits, A-Z lowered; signs separate. A document holds an item if some
run of its words is within ``max_edits`` (a fifth of the item's words) of the item in edit distance
over words.

The CGK embedding walks over a word sequence: step ``j`` writes the word under the cursor and moves
on if a random bit of (j, word) says so. Two sequences that differ by an edit fall back into step, so
a small edit distance becomes a small Hamming distance between what the walks write. Every word of a
document starts a walk; a walk is a seed shorter than the item (``STEPS`` steps pass about half as
many words). Its key is what it writes at ``SAMPLES`` positions drawn for each of ``REPEATS``
independent walks. All starts within an item are indexed, so that a stretch of few edits anywhere in
it retrieves it. Items of up to ``SHORT`` words have walks that pass no more words than stay untouched
in a row under every allowed set of edits, so they are always retrieved. Every retrieved alignment is
then verified on the whole item.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybird.llm.tokens import LETTERS, LOWER, mix, random_words, text_slices, tokenise

SIMILARITY = 0.8
REPEATS = 6
STEPS = 14
SAMPLES = 7
SHORT = 24  # words of the longest item that is retrieved for certain and not by chance
BLOCK_BYTES = 16 << 20  # of item texts that are shipped to the tasks at once
_FILTER_BITS = 20
_ALIGNMENTS = 1 << 20  # alignments made at once


def max_edits(words: int, similarity: float = SIMILARITY) -> int:
    return int((1 - similarity) * words + 1e-9)


def walk_length(words: int, similarity: float = SIMILARITY) -> int:
    """Steps of the walks of an item. A short item gets as many as words are left untouched in a row
    somewhere in it by every allowed set of edits, so each of its walks always retrieves it."""
    if words > SHORT:
        return STEPS
    slack = max_edits(words, similarity)
    return max(1, (words - slack) // (slack + 1))


def _drawn(repeat: int, steps: int) -> np.ndarray:
    """The sampled positions of a walk of ``steps`` steps."""
    return np.sort(np.argsort(random_words(steps, 1000 * repeat + steps))[:SAMPLES])


def walk_keys(words: np.ndarray, lengths: list[int], repeat: int) -> dict[int, np.ndarray]:
    """For every start in ``words`` the sampled key of the walk, per walk length."""
    n = len(words)
    padded = np.concatenate([words, np.zeros(max(lengths), np.uint64)])
    coins = mix(padded ^ random_words(1, 70 + repeat)[0])
    weight = random_words(max(lengths), 90 + repeat) | np.uint64(1)
    keys = {length: np.zeros(n, np.uint64) for length in lengths}
    drawn = {length: set(_drawn(repeat, length).tolist()) for length in lengths}
    cursor = np.arange(n)
    for step in range(max(lengths)):
        wanted = [length for length in lengths if step in drawn[length]]
        if wanted:
            written = padded[cursor] * weight[step]
            for length in wanted:
                keys[length] += written
        cursor += ((coins[cursor] >> np.uint64(step)) & np.uint64(1)).astype(np.int64)
    return keys


def walk_reach(words: np.ndarray, steps: int, repeat: int) -> np.ndarray:
    """For every start in ``words`` how many words a walk passes."""
    coins = mix(np.concatenate([words, np.zeros(steps, np.uint64)]) ^ random_words(1, 70 + repeat)[0])
    start = np.arange(len(words))
    cursor = start.copy()
    for step in range(steps - 1):
        cursor += ((coins[cursor] >> np.uint64(step)) & np.uint64(1)).astype(np.int64)
    return cursor - start


def least_edits(item: np.ndarray, region: np.ndarray) -> int:
    """Edit distance between ``item`` and the best run within ``region``."""
    columns = np.arange(len(region) + 1)
    row = np.zeros(len(region) + 1, np.int64)
    for k, word in enumerate(item):
        new = np.empty_like(row)
        new[0] = k + 1
        np.minimum(row[1:] + 1, row[:-1] + (region != word), out=new[1:])
        row = np.minimum.accumulate(new - columns) + columns
    return int(row.min())


@dataclass
class ItemIndex:
    """Items of one block and the keys of all their starts."""

    ids: list = field(default_factory=list)
    words: list[np.ndarray] = field(default_factory=list)
    similarity: float = SIMILARITY

    def build(self) -> ItemIndex:
        self.vocabulary = np.unique(np.concatenate([np.empty(0, np.uint64), *self.words]))
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.slack = np.array([max_edits(len(w), self.similarity) for w in self.words], np.int64)
        self.item_ends = np.concatenate([[0], np.cumsum(self.sizes)])
        self.item_words = np.searchsorted(self.vocabulary, np.concatenate([np.empty(0, np.uint64), *self.words]))
        self.lengths = sorted({walk_length(len(w), self.similarity) for w in self.words})
        self.tables = {}
        none = np.empty(0, np.int64)
        best = []  # by item and start: of walks that all retrieve a short item, the one that passes most words
        for words in self.words:
            own = walk_length(len(words), self.similarity)
            short = len(words) <= SHORT
            best.append(np.argmax([walk_reach(words, own, r) for r in range(REPEATS)], axis=0) if short else None)
        for repeat in range(REPEATS):
            found: dict[int, list] = {length: [(none.astype(np.uint64), none, none)] for length in self.lengths}
            for number, words in enumerate(self.words):
                own = walk_length(len(words), self.similarity)
                keys = walk_keys(words, [own], repeat)[own]
                starts = np.arange(max(1, len(words) - own + 1))
                if best[number] is not None:
                    starts = starts[best[number][starts] == repeat]
                found[own].append((keys[starts], np.full(len(starts), number), starts))
            for length, parts in found.items():
                keys, numbers, starts = (np.concatenate(x) for x in zip(*parts))
                order = np.argsort(keys, kind="stable")
                marks = np.zeros(1 << _FILTER_BITS, bool)
                marks[(keys >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
                self.tables[repeat, length] = keys[order], numbers[order], starts[order], marks
        return self

    def _numbered(self, words: np.ndarray) -> np.ndarray:
        """Places of ``words`` in the vocabulary, its length for others."""
        known = np.searchsorted(self.vocabulary, words)
        known[known == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[known] == words, known, len(self.vocabulary))

    def _runs(self, words: np.ndarray, bounds: np.ndarray) -> Iterator[tuple]:
        """Per table the places whose key is known, with the table's rows of that key: (starts of the
        table, place, its run) and of each run, one per text and key, (text, first row, rows)."""
        for repeat in range(REPEATS):
            for length, keys in walk_keys(words, self.lengths, repeat).items():
                known, numbers, starts, marks = self.tables[repeat, length]
                at = np.flatnonzero(marks[(keys >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
                low = np.searchsorted(known, keys[at], "left")
                count = np.searchsorted(known, keys[at], "right") - low
                at, low, count = at[count > 0], low[count > 0], count[count > 0]
                if len(at):
                    text = np.searchsorted(bounds, at, "right") - 1
                    _, first, run = np.unique(text * len(known) + low, return_index=True, return_inverse=True)
                    yield numbers, starts, at, run, text[first], low[first], count[first]

    def _worth_trying(self, pairs: np.ndarray, known: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The ``pairs`` (text * items + item, ascending) whose text has all but ``slack`` of the item's words
        somewhere; without them it cannot hold the item."""
        kept = np.zeros(len(pairs), bool)
        text, item = np.divmod(pairs, len(self.words))
        member = np.zeros(len(self.vocabulary) + 1, bool)
        first = np.flatnonzero(np.diff(text, prepend=-1))
        for a, b in zip(first, np.append(first[1:], len(pairs))):
            own = known[bounds[text[a]] : bounds[text[a] + 1]]
            member[own] = True
            member[-1] = False
            for low in range(a, b, 4096):
                items = item[low : min(b, low + 4096)]
                n = self.sizes[items]
                ends = np.cumsum(n)
                places = np.repeat(self.item_ends[items] - (ends - n), n) + np.arange(ends[-1])
                there = np.add.reduceat(member[self.item_words[places]].astype(np.int64), ends - n)
                kept[low : low + len(items)] = there >= n - self.slack[items]
            member[own] = False
        return pairs[kept]

    def alignments(self, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Distinct (text, item, place of the item's first word) of all retrieved pairs that are worth trying.

        A text's keys are first looked up once each, so a passage that many items share and a text repeats
        costs no more than its keys times those items before the texts that lack the rest are out.
        """
        n = len(self.words)
        runs, pairs = list(self._runs(words, bounds)), [np.empty(0, np.int64)]
        for numbers, _, _, _, text, low, count in runs:
            ends = np.cumsum(count)
            rows = np.repeat(low - (ends - count), count) + np.arange(ends[-1])
            pairs.append(np.unique(np.repeat(text, count) * n + numbers[rows]))
        worth = self._worth_trying(np.unique(np.concatenate(pairs)), self._numbered(words), bounds)
        longest = int(self.sizes.max(initial=0))
        span = len(words) + longest + 1
        out = np.empty(0, np.int64)
        for numbers, starts, at, run, text, low, count in runs if len(worth) else ():
            ends = np.cumsum(count)
            owner = np.repeat(np.arange(len(count)), count)
            rows = np.repeat(low - (ends - count), count) + np.arange(ends[-1])
            pair = text[owner] * n + numbers[rows]
            place = np.minimum(np.searchsorted(worth, pair), len(worth) - 1)
            good = worth[place] == pair
            owner, rows, place = owner[good], rows[good], place[good]
            size = np.bincount(owner, minlength=len(count))
            begin = np.cumsum(size) - size
            each = size[run]
            step = max(1, int(len(at) * _ALIGNMENTS / max(int(each.sum()), 1)))
            for a in range(0, len(at), step):
                b = min(len(at), a + step)
                m = each[a:b]
                stop = np.cumsum(m)
                pick = np.repeat(begin[run[a:b]] - (stop - m), m) + np.arange(stop[-1])
                shift = np.repeat(at[a:b], m) - starts[rows[pick]]
                out = np.union1d(out, place[pick] * span + shift + longest)
        place, shift = np.divmod(out, span)
        text, item = np.divmod(worth[place], n) if len(worth) else (place, place)
        return np.stack([text, item, shift - longest], axis=1)

    def plausible(self, words: np.ndarray, bounds: np.ndarray, tried: np.ndarray) -> np.ndarray:
        """The rows (text, item, shift) of ``tried`` whose surroundings hold enough words of the item:
        within ``slack`` edits, all but ``slack`` of its words must be there. Drops no match."""
        known = self._numbered(words)
        member = np.zeros(len(self.vocabulary) + 1, bool)
        order = np.argsort(tried[:, 1], kind="stable")
        tried = tried[order]
        kept = np.zeros(len(tried), bool)
        first = np.flatnonzero(np.diff(tried[:, 1], prepend=-1))
        for a, b in zip(first, np.append(first[1:], len(tried))):
            item = self.words[tried[a, 1]]
            slack = max_edits(len(item), self.similarity)
            own = np.searchsorted(self.vocabulary, item)
            member[own] = True
            for at in range(a, b, 4096):
                rows = tried[at : min(b, at + 4096)]
                where = rows[:, 2:] + np.arange(-slack, len(item) + slack)
                inside = (where >= bounds[rows[:, 0], None]) & (where < bounds[rows[:, 0] + 1, None])
                hits = member[known[np.where(inside, where, 0)]] & inside
                kept[at : at + len(rows)] = hits.sum(1) >= len(item) - slack
            member[own] = False
        return tried[kept]

    def search(self, words: np.ndarray, bounds: np.ndarray) -> dict[int, set[int]]:
        """Items held by each text: {text: {item number}}."""
        found: dict[int, set[int]] = defaultdict(set)
        if not self.words or len(words) == 0:
            return found
        tried = self.plausible(words, bounds, self.alignments(words, bounds))
        regions: dict[tuple[int, int], list[list[int]]] = defaultdict(list)
        for t, i, shift in tried.tolist():
            slack = max_edits(len(self.words[i]), self.similarity)
            low = max(shift - slack, int(bounds[t]))
            high = min(shift + len(self.words[i]) + slack, int(bounds[t + 1]))
            own = regions[t, i]
            if own and low <= own[-1][0] + slack:  # nearly the same alignment: one wider region
                own[-1][1] = max(own[-1][1], high)
            else:
                own.append([low, high])
        for (t, i), own in regions.items():
            needle = self.words[i]
            slack = max_edits(len(needle), self.similarity)
            if any(high - low >= len(needle) - slack and least_edits(needle, words[low:high]) <= slack for low, high in own):
                found[t].add(i)
        return found


def item_blocks(benchmark: DataFrame, item_id: str, text: str, similarity: float) -> Iterator[ItemIndex]:
    """The benchmark in blocks of at most ``BLOCK_BYTES`` of text (a longer item is its own block),
    read one by one. Items without words are left out."""
    block, held = ItemIndex(similarity=similarity), 0
    rows = benchmark.select(benchmark[item_id].alias("i"), benchmark[text].cast("string").alias("t"))
    for row in rows.where("t IS NOT NULL").toLocalIterator():
        data = np.frombuffer(row["t"].encode("utf-8", "replace"), np.uint8)
        words = tokenise(data, np.array([0, len(data)]), LETTERS, LOWER).hashes
        if not len(words):
            continue
        if block.ids and held + len(data) > BLOCK_BYTES:
            yield block.build()
            block, held = ItemIndex(similarity=similarity), 0
        block.ids.append(row["i"])
        block.words.append(words)
        held += len(data)
    yield block.build()


def find_items(
    docs: DataFrame,
    benchmark: DataFrame,
    found: str = "item_ids",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    similarity: float = SIMILARITY,
) -> DataFrame:
    """``docs`` with the sorted ids of the items that each whole text holds, in column ``found``.

    Nothing is shuffled: the items travel to the texts, in blocks of bounded size, each block one
    more step of the same pass. A null or empty text and an empty benchmark give empty lists;
    items with equal words are all reported; an item without id is reported as null, last. Other
    columns pass through; ``found`` must not be one of them.
    """
    spark = docs.sparkSession
    kind = benchmark.schema[item_id].dataType.simpleString()
    out = docs.withColumn(found, F.array().cast(f"array<{kind}>"))
    for block in item_blocks(benchmark, item_id, item_text, similarity):
        shipped = spark.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            index = shipped.value
            for batch in batches:
                at = batch.schema.get_field_index(found)
                column = batch.column(batch.schema.get_field_index(text))
                if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
                    column = column.cast(pa.string())
                own = batch.column(at).to_pylist()
                for low, _, data, offsets in text_slices(column):
                    tokens = tokenise(data, offsets, LETTERS, LOWER)
                    for t, items in index.search(tokens.hashes, tokens.bounds).items():
                        ids = own[low + t] + [index.ids[i] for i in items]
                        own[low + t] = sorted(set(ids), key=lambda x: (x is None, x))
                columns = list(batch.columns)
                columns[at] = pa.array(own, batch.column(at).type)
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

        out = out.mapInArrow(search, out.schema)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item, all columns."""
    found = "item_ids"
    while found in docs.columns:
        found += "_"
    return find_items(docs, benchmark, found, text).where(F.size(found) == 0).drop(found)
