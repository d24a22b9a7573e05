"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

1. Voters. Features are words (letters and digits, A-Z lowered) and word beginnings of 4 to 8 bytes.
   A bounded sample of labelled documents gives the features that toxic documents hold far more
   often: the lexicon, of any size. A feature fires on a document that holds it more often than its
   rate in clean documents explains at the document's length. Features with the same evidence (as
   many toxic and clean documents and occurrences, such as the beginnings of one word) share a voter;
   the surest have one each, the rest are pooled by how sure they are, and a voter fires with any of
   its features. Pattern voters fire on the number of voters that fire and on density. All others
   abstain.
2. Label model. Votes are drawn given the hidden label, each voter with a rate per class. Rates start
   from the labelled sample and are refined by EM over the votes of *all* documents, with the sample
   as prior. Correlations between voters within the classes are estimated from the same votes, and
   a voter counts for less the more others repeat it.
3. A logistic regression on the votes is trained on the posterior labels of at most ``SAMPLE``
   documents, and scores every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tallybird.llm.quality import labelled_sample
from tallybird.llm.staging import staged
from tallybird.llm.texts import whole_text
from tallybird.llm.tokens import _BASE, _INVERSE, LETTERS, LOWER, mix, powers, text_slices, tokenise

SAMPLE = 10_000
SINGLE = 224  # voters of the surest evidence; with the pools and patterns below 256
POOLS = 24  # voters that share all other features of the lexicon
LEXICON = SINGLE + POOLS
PREFIXES = (4, 5, 6, 7, 8)
PATTERNS = 5
VOTERS = LEXICON + PATTERNS
LEAST = 4  # toxic documents of the sample that hold a feature
ROUNDS = 5
_PART = 64


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, text) of every word and word beginning, and the number of words of each text."""
    words = tokenise(data, offsets, LETTERS, LOWER)
    texts = np.diff(words.bounds)
    if len(words.hashes) == 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64), texts
    owner = np.repeat(np.arange(len(texts)), texts)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(LOWER[data] * powers(_BASE, len(data)), dtype=np.uint64)])
    back = powers(_INVERSE, len(data))
    found, whose = [words.hashes], [owner]
    for length in PREFIXES:
        longer = words.end - words.start > length
        start = words.start[longer]
        found.append(mix((sums[start + length] - sums[start]) * back[start] + np.uint64(length)))
        whose.append(owner[longer])
    return np.concatenate(found), np.concatenate(whose), texts


def _grouped(keys: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    if not len(first):
        return keys, np.zeros((0, len(columns)), np.int64)
    return keys[first], np.stack([np.add.reduceat(c[order], first) for c in columns], axis=1)


def _packed(keys: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    """Sorted keys and their sums, cut by the top bits of the key."""
    part = (keys >> np.uint64(58)).astype(np.int64)
    cuts = np.searchsorted(part, np.arange(_PART + 1))
    full = np.flatnonzero(np.diff(cuts))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(full.astype(np.int32)),
            pa.array([keys[cuts[p] : cuts[p + 1]].tobytes() for p in full], pa.binary()),
            pa.array([np.ascontiguousarray(sums[cuts[p] : cuts[p + 1]], np.int64).tobytes() for p in full], pa.binary()),
        ],
        names=["part", "keys", "sums"],
    )


_PACKED = "part int, keys binary, sums binary"


def _merged(least: int):
    """Sums per key of one part; keys whose first sum is below ``least`` are left out."""

    def merge(table: pa.Table) -> pa.Table:
        keys = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("keys")])
        sums = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in table.column("sums")])
        sums = sums.reshape(len(keys), -1)
        keys, sums = _grouped(keys, list(sums.T))
        kept = sums[:, 0] >= least
        return pa.Table.from_batches([_packed(keys[kept], sums[kept])])

    return merge


def _collected(df: DataFrame, columns: int) -> tuple[np.ndarray, np.ndarray]:
    rows = df.collect()
    keys = [np.frombuffer(bytes(r["keys"]), np.uint64) for r in rows]
    sums = [np.frombuffer(bytes(r["sums"]), np.int64).reshape(-1, columns) for r in rows]
    if not rows:
        return np.empty(0, np.uint64), np.zeros((0, columns), np.int64)
    keys, sums = np.concatenate(keys), np.concatenate(sums)
    order = np.argsort(keys)
    return keys[order], sums[order]


def _held_by_toxic(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        toxic = batch.column("y").to_numpy() > 0.5
        for low, _, data, offsets in text_slices(batch.column("t")):
            found, whose, _ = features(data, offsets)
            mine = toxic[low + whose]
            pairs = np.unique(np.stack([whose[mine].astype(np.uint64), found[mine]], axis=1), axis=0)
            yield _packed(*_grouped(pairs[:, 1], [np.ones(len(pairs), np.int64)]))


def _held_by_all(known: np.ndarray):
    """Of the known features: toxic documents, clean documents, occurrences in clean documents. Key
    0 holds the sums over all documents: toxic ones, clean ones, words of clean ones."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column("y").to_numpy() > 0.5
            for low, high, data, offsets in text_slices(batch.column("t")):
                found, whose, words = features(data, offsets)
                at = np.searchsorted(known, found)
                at[at == len(known)] = 0
                hit = known[at] == found
                pair, times = np.unique(whose[hit] * len(known) + at[hit], return_counts=True)
                text, key = np.divmod(pair, len(known))
                ill = toxic[low + text]
                of_slice = toxic[low:high]
                keys = np.concatenate([known[key], np.zeros(1, np.uint64)])
                columns = [
                    np.append(ill, of_slice.sum()),
                    np.append(~ill, (~of_slice).sum()),
                    np.append(times * ~ill, words[~of_slice].sum()),
                ]
                yield _packed(*_grouped(keys, [c.astype(np.int64) for c in columns]))

    return count


@dataclass
class Voters:
    """Lexicon: sorted feature hashes with their rates (occurrences per word) in clean documents and
    the voter of each."""

    keys: np.ndarray
    rate: np.ndarray
    voter: np.ndarray
    ill: np.ndarray  # starting rates of firing, by class, of all voters
    well: np.ndarray
    prior: float
    sampled: int

    def votes(self, column: pa.Array) -> np.ndarray:
        """(texts, VOTERS) booleans."""
        out = np.zeros((len(column), VOTERS), bool)
        if not len(self.keys):
            return out
        marks = np.zeros(1 << 16, bool)
        marks[(self.keys >> np.uint64(48)).astype(np.int64)] = True
        for low, high, data, offsets in text_slices(column):
            found, whose, words = features(data, offsets)
            near = np.flatnonzero(marks[(found >> np.uint64(48)).astype(np.int64)])
            at = np.searchsorted(self.keys, found[near])
            at[at == len(self.keys)] = 0
            hit = self.keys[at] == found[near]
            pair, times = np.unique(whose[near][hit] * len(self.keys) + at[hit], return_counts=True)
            text, feature = np.divmod(pair, len(self.keys))
            fired = times > 3 * words[text] * self.rate[feature]
            text, feature, times = text[fired], feature[fired], times[fired]
            out[low + text, self.voter[feature]] = True
            kinds = out[low:high, :LEXICON].sum(1)
            times = np.bincount(text, weights=times, minlength=high - low)
            for k, pattern in enumerate(
                (kinds >= 4, kinds >= 8, times >= 12, times * 100 >= words, times * 25 >= words)
            ):
                out[low:high, LEXICON + k] = pattern & (kinds > 0)
        return out


def dealt(sums: np.ndarray, sure: np.ndarray) -> np.ndarray:
    """The voter of each feature: one per different evidence for the surest, pools of as many different
    evidences each for all others."""
    _, first, number = np.unique(sums, axis=0, return_index=True, return_inverse=True)
    rank = np.empty(len(first), np.int64)
    rank[np.argsort(-sure[first], kind="stable")] = np.arange(len(first))
    rest = max(len(first) - SINGLE, 1)
    voter = np.where(rank < SINGLE, rank, SINGLE + (rank - SINGLE) * POOLS // rest)
    return voter[number.ravel()]


def find_voters(
    docs: DataFrame, labels: DataFrame, eligible: Column, label: str, sample: int, doc_id: str, text: str
) -> Voters:
    """Voters from at most ``sample`` labelled documents for which ``eligible`` holds."""
    chosen = labelled_sample(labels, label, eligible, sample, doc_id)
    texts = staged(
        docs.select(docs[doc_id].cast("long").alias("id"), whole_text(docs, text).alias("t"))
        .join(F.broadcast(chosen), F.col("id") == chosen["doc_id"])  # at most ``sample`` ids
        .select("y", "t"),
        "labelled",
    )
    known, _ = _collected(
        texts.mapInArrow(_held_by_toxic, _PACKED).groupBy("part").applyInArrow(_merged(LEAST), _PACKED), 1
    )
    nothing = Voters(np.empty(0, np.uint64), np.empty(0), np.empty(0, int), np.zeros(VOTERS), np.zeros(VOTERS), 0.0, 0)
    known = known[known > 0]
    if not len(known):
        return nothing
    keys, sums = _collected(
        texts.mapInArrow(_held_by_all(known), _PACKED).groupBy("part").applyInArrow(_merged(0), _PACKED), 3
    )
    whole = sums[keys == 0].sum(0)
    keys, sums = keys[keys > 0], sums[keys > 0]
    in_ill, in_well = (sums[:, 0] + 0.5) / (whole[0] + 1), (sums[:, 1] + 0.5) / (whole[1] + 1)
    odds = np.log(in_ill / (1 - in_ill)) - np.log(in_well / (1 - in_well))
    sure = odds / np.sqrt(1 / (sums[:, 0] + 0.5) + 1 / (sums[:, 1] + 0.5))
    worth = np.flatnonzero((odds > 1.5) & (sure > 3))
    if not len(worth):
        return nothing
    voters = Voters(
        keys[worth],
        sums[worth, 2] / max(whole[2], 1),
        dealt(sums[worth], sure[worth]),
        np.zeros(VOTERS),
        np.zeros(VOTERS),
        0.0,
        int(whole[:2].sum()),
    )
    # how often each voter fires in the sample, by class
    fired = _sums(
        texts.select(F.when(F.col("y") > 0.5, 1.0).otherwise(0.0).alias("p"), F.lit(1).cast("long").alias("n"), "t"),
        lambda batch: voters.votes(batch.column("t")),
    )
    voters.prior = (fired.ill + 0.5) / (fired.ill + fired.well + 1)
    voters.ill = (fired.ill_votes + 0.5) / (fired.ill + 1)
    voters.well = (fired.well_votes + 0.5) / (fired.well + 1)
    return voters


@dataclass
class _Sums:
    ill: float
    well: float
    ill_votes: np.ndarray
    well_votes: np.ndarray
    ill_pairs: np.ndarray
    well_pairs: np.ndarray


def _sums(weighted: DataFrame, read, posterior=None, pairs: bool = False) -> _Sums:
    """Sums over rows (n copies each) of votes, by class weight p (a column, or ``posterior`` of the
    votes); with ``pairs`` also of products of votes. Tables of fixed size per task, added by row."""
    width = VOTERS + 1

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [np.zeros((width if pairs else 1, width)) for _ in range(2)]
        for batch in batches:
            votes = read(batch).astype(np.float64)
            one = np.concatenate([np.ones((len(votes), 1)), votes], axis=1)
            p = posterior(votes) if posterior else batch.column("p").to_numpy()
            n = batch.column("n").to_numpy().astype(np.float64)
            for table, weight in zip(tables, (p * n, (1 - p) * n)):
                left = one if pairs else one[:, :1]
                table += (left * weight[:, None]).T @ one
        number = np.arange(len(tables[0]), dtype=np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([2 * number, 2 * number + 1])),
                pa.array([row.tobytes() for table in tables for row in table], pa.binary()),
            ],
            names=["part", "sums"],
        )

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer(), np.float64) for x in table.column("sums"))
        return pa.table({"part": table.column("part").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})

    made = weighted.mapInArrow(add_up, "part int, sums binary").groupBy("part").applyInArrow(add, "part int, sums binary")
    out = np.zeros((2, width, width))
    for row in made.collect():  # at most 2 * width rows
        out[row["part"] % 2, row["part"] // 2] = np.frombuffer(bytes(row["sums"]), np.float64)
    return _Sums(out[0, 0, 0], out[1, 0, 0], out[0, 0, 1:], out[1, 0, 1:], out[0, 1:, 1:], out[1, 1:, 1:])


@dataclass
class LabelModel:
    """Firing rates by class, and how much each voter counts beside the voters that repeat it."""

    ill: np.ndarray
    well: np.ndarray
    prior: float
    share: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        ill, well = np.clip(self.ill, 1e-4, 1 - 1e-4), np.clip(self.well, 1e-4, 1 - 1e-4)
        fired = self.share * (np.log(ill) - np.log(well))
        silent = self.share * (np.log1p(-ill) - np.log1p(-well))
        prior = np.clip(self.prior, 1e-4, 1 - 1e-4)
        odds = np.log(prior / (1 - prior)) + silent.sum() + votes @ (fired - silent)
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def _repeats(sums: _Sums) -> np.ndarray:
    """1 / (1 + sum of correlations with other voters), correlations taken within the classes."""
    total = np.zeros((VOTERS, VOTERS))
    weight = 0.0
    for n, votes, pairs in ((sums.ill, sums.ill_votes, sums.ill_pairs), (sums.well, sums.well_votes, sums.well_pairs)):
        if n <= 0:
            continue
        mean = votes / n
        spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
        total += votes.sum() * (pairs / n - np.outer(mean, mean)) / np.outer(spread, spread)
        weight += votes.sum()
    tied = np.clip(total / max(weight, 1e-12), 0, 1)
    np.fill_diagonal(tied, 0)
    return 1 / (1 + np.where(tied > 0.1, tied, 0).sum(1))


def fit_label_model(patterns: DataFrame, voters: Voters, rounds: int = ROUNDS) -> LabelModel:
    """EM over ``patterns`` (votes, n): the different votes of all documents with their numbers."""

    def read(batch: pa.RecordBatch) -> np.ndarray:
        return unpacked(batch.column("votes"))

    model = LabelModel(voters.ill, voters.well, voters.prior, np.ones(VOTERS))
    for k in range(rounds):
        sums = _sums(patterns, read, model.posterior, pairs=k == 0)
        share = _repeats(sums) if k == 0 else model.share
        known = float(voters.sampled)  # the labelled rates count like so many documents
        ill, well = known * voters.prior, known * (1 - voters.prior)
        model = LabelModel(
            (sums.ill_votes + ill * voters.ill) / max(sums.ill + ill, 1e-9),
            (sums.well_votes + well * voters.well) / max(sums.well + well, 1e-9),
            (sums.ill + ill) / max(sums.ill + sums.well + known, 1e-9),
            share,
        )
    return model


def packed(votes: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in np.packbits(votes, axis=1)], pa.binary())


def unpacked(column: pa.Array) -> np.ndarray:
    if len(column) == 0:
        return np.zeros((0, VOTERS), bool)
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    return np.unpackbits(raw, axis=1, count=VOTERS).astype(bool)


def fit_linear(votes: np.ndarray, target: np.ndarray, weight: np.ndarray, steps: int = 400) -> np.ndarray:
    """Logistic regression on soft labels by full-batch Adam; the last weight is the intercept."""
    x = np.concatenate([votes.astype(np.float64), np.ones((len(votes), 1))], axis=1)
    w, first, second = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    total = max(weight.sum(), 1e-9)
    for step in range(1, steps + 1):
        error = (1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) - target) * weight / total
        grad = x.T @ error + 1e-6 * w
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        w -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return w


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    eligible: Column,
    label: str = "toxic",
    sample: int = SAMPLE,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(doc_id, score): the probability of toxicity of every whole text.

    ``eligible`` is a condition on ``labels``: others are never learned from. A null or empty text
    fires no voter and scores low; repeated rows score alike; null ids pass through. Without usable
    labels no voter exists and every score is 0. Other columns of ``docs`` are not read.
    """
    voters = find_voters(docs, labels, eligible, label, sample, doc_id, text)
    shipped = docs.sparkSession.sparkContext.broadcast(voters)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), packed(shipped.value.votes(batch.column("t")))], names=["doc_id", "votes"]
            )

    base = docs.select(docs[doc_id].cast("long").alias("doc_id"), whole_text(docs, text).alias("t"))
    cast = staged(base.mapInArrow(vote, "doc_id long, votes binary"), "votes")
    patterns = staged(cast.groupBy("votes").agg(F.count("*").alias("n")), "patterns")
    if len(voters.keys):
        model = fit_label_model(patterns, voters)
        # different votes in hash order; a pattern counts like the documents that cast it
        taken = patterns.orderBy(F.xxhash64("votes"), "votes").limit(sample).toArrow()
        x = unpacked(taken.column("votes").combine_chunks())
        weights = fit_linear(x, model.posterior(x), np.sqrt(taken.column("n").to_numpy().astype(np.float64)))
    else:
        weights = np.append(np.zeros(VOTERS), -np.inf)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logit = unpacked(batch.column("votes")) @ weights[:-1] + weights[-1]
            found = np.where(np.isneginf(logit), 0.0, 1 / (1 + np.exp(-np.clip(logit, -30, 30))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], names=["doc_id", "score"])

    return cast.mapInArrow(score, StructType([cast.schema["doc_id"], StructField("score", DoubleType())]))
