"""Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm import text as tx

#: Words are runs of ASCII letters and digits and of bytes beyond ASCII, so punctuation hides none.
#: The terms of a word are the word and its first bytes, as inflected insults share their beginning.
STEMS = (4, 5, 6, 7, 8)
_APART = np.array([not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123 or b >= 128) for b in range(256)])


@dataclass(frozen=True)
class FMOptions:
    """``sample_rows`` bounds the labelled rows that the model is fitted on (drawn by a hash of the id); all rows are scored.

    Terms fall in 2^``bits`` slots; slots of fewer than ``least_rows`` sampled rows are left
    out, and so are those whose shares in the two labels differ by fewer than ``least_z``
    standard errors, unless they belong to a pair that tells more than both its terms
    (``paired``).  ``l1`` drives weights and whole factor vectors of uninformative terms to zero.
    One row in ``fold`` is kept out of all that, and sets how far the model's odds may be trusted.  Pairs are
    counted in ``pair_rows`` of the others.
    """

    sample_rows: int = 15_000
    fold: int = 5
    pair_rows: int = 5000
    bits: int = 22
    factors: int = 4
    least_rows: int = 4
    least_z: float = 2.5
    steps: int = 800
    rate: float = 0.05
    l1: float = 5e-4
    seed: int = 5


@dataclass(frozen=True)
class FMModel:
    """``slots`` (sorted) have weight ``w`` and factors ``v``; others have none.

    The score is ``floor`` + (1 - ``floor``) times the logistic of ``slope`` times the machine's sum, plus ``shift``.
    """

    bits: int
    slots: np.ndarray
    bias: float
    w: np.ndarray
    v: np.ndarray
    slope: float = 1.0
    shift: float = 0.0
    floor: float = 0.0

    def scores(self, column: pa.Array) -> np.ndarray:
        """Probability of label 1 for each text."""
        total = self.slope * self.sums(*terms(column, self.bits, self.slots), len(column)) + self.shift
        return self.floor + (1 - self.floor) / (1 + np.exp(-np.clip(total, -40, 40)))

    def sums(self, row: np.ndarray, slot: np.ndarray, n: int) -> np.ndarray:
        """Bias, weights and products of factors over all pairs of terms, for ``n`` rows with known terms (row, slot)."""
        at = np.searchsorted(self.slots, slot)
        total = self.bias + np.bincount(row, self.w[at], n)
        for f in range(self.v.shape[1]):
            x = self.v[at, f]
            total += 0.5 * (np.bincount(row, x, n) ** 2 - np.bincount(row, x * x, n))
        return total


def _logistic(x: np.ndarray, target: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Newton's steps on the log loss of soft targets, with a weak pull of the first coefficient to 0."""
    loss = lambda at: np.logaddexp(0, x @ at).sum() - (target * (x @ at)).sum() + 1e-3 * at[0] ** 2
    best = start
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ best, -500, 500)))
        grad = x.T @ (p - target) + np.array([2e-3 * best[0], 0.0])
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag([2e-3, 1e-9]), grad)
        size = 1.0
        while size > 1e-6 and loss(best - size * step) > loss(best):
            size /= 2
        best = best - size * step
        if size * np.abs(step).max() < 1e-7:
            break
    return best


def calibrated(z: np.ndarray, y: np.ndarray, rounds: int = 25) -> tuple[float, float, float]:
    """Slope (not below 0), shift and floor: the chance of label 1 is floor + (1 - floor) / (1 + exp(-(slope z + shift))).

    ``z`` and ``y`` are of rows that the model has not seen.  The floor stands for rows labelled 1 whatever
    their text says, which would else flatten the slope; of several the likeliest is taken, each with its curve
    fitted by EM.  Targets are drawn in a little, so that rows told apart without error give a finite slope,
    and sums that say nothing one of about 0.
    """
    scale = max(float(np.median(np.abs(z))), 1e-9)
    x = np.stack([z / scale, np.ones(len(z))], 1)
    share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
    flat = np.array([0.0, np.log(share / (1 - share))])
    low = 1 / (len(y) + 2)
    best = (-np.inf, flat, 0.0)
    for part in (0.0, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3):
        floor, curve = part * share, flat
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ curve, -500, 500)))
            curve = _logistic(x, np.clip(np.where(y == 1, p / (floor + (1 - floor) * p), 0.0), low, 1 - low), curve)
        p = 1 / (1 + np.exp(-np.clip(x @ curve, -500, 500)))
        either = np.clip(floor + (1 - floor) * p, 1e-12, 1 - 1e-12)
        likely = float(np.log(np.where(y == 1, either, 1 - either)).sum())
        if curve[0] > 0 and likely > best[0] + 0.5:  # a floor has to earn its place
            best = (likely, curve, floor)
    _, curve, floor = best
    return float(curve[0] / scale), float(curve[1]), floor


def terms(column: pa.Array, bits: int, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, term slot) of the texts, in order; of the ``wanted`` (sorted) slots only, if given.

    Terms are made once for each distinct word of the column.
    """
    raw, offsets = tx.buffer_of(column)
    starts, ends, first = tx.word_bounds(raw, offsets, _APART)
    words = tx.span_hashes(raw, starts, ends)
    rows = np.repeat(np.arange(len(column)), np.diff(first))
    _, sample, word = np.unique(words, return_index=True, return_inverse=True)
    begin, end = starts[sample], ends[sample]
    slots, owner = [words[sample] >> np.uint64(64 - bits)], [np.arange(len(sample))]
    for length in STEMS:
        longer = np.flatnonzero(end - begin > length)
        owner.append(longer)
        slots.append(tx.mix(tx.span_hashes(raw, begin[longer], begin[longer] + length) + np.uint64(1)) >> np.uint64(64 - bits))
    slot, owner = np.concatenate(slots).astype(np.int64), np.concatenate(owner)
    if wanted is not None:
        at = np.minimum(np.searchsorted(wanted, slot), max(len(wanted) - 1, 0))
        hit = wanted[at] == slot if len(wanted) else np.zeros(len(slot), bool)
        slot, owner = slot[hit], owner[hit]
    by = np.argsort(owner, kind="stable")
    slot, count = slot[by], np.bincount(owner, minlength=len(sample))
    start = np.cumsum(count) - count
    reps = count[word]
    at = np.repeat(start[word] - (np.cumsum(reps) - reps), reps) + np.arange(int(reps.sum()))
    got = np.repeat(rows, reps) << bits | slot[at]
    got.sort()
    got = got[np.diff(got, prepend=-1) != 0]
    return got >> bits, got & (1 << bits) - 1


def _featurizer(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in tx.slices(batch.column(0)):
                row, slot = terms(batch.column(0).slice(begin, end - begin), bits)
                cuts = np.searchsorted(row, np.arange(end - begin + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(cuts), pa.array(slot.astype(np.int32))), batch.column(1).slice(begin, end - begin), batch.column(2).slice(begin, end - begin)], ["terms", "label", "draw"])

    return run


def paired(row: np.ndarray, column: np.ndarray, y: np.ndarray, m: int) -> np.ndarray:
    """Which of ``m`` terms are in a pair whose share of label 1 is beyond what its two terms explain.

    ``row, column`` is the incidence list in order of both.  The terms explain the shares between
    the overall one, their own and that of their odds combined.  All pairs are counted; one
    counts as informative if its share has a chance (Chernoff's bound) of less than one in the number of pairs.
    Terms of the same rows are counted once, and terms of too few rows for any such pair not.
    """
    out = np.zeros(m, bool)
    n, ones = np.bincount(column, minlength=m), np.bincount(column[y[row] == 1], minlength=m)
    share, nats = y.mean(), np.log(max(m * (m - 1) / 2, 2.0))
    least = nats / -np.log(min(share, 1 - share))
    key = np.random.default_rng(m).integers(1, 1 << 38, len(y)).astype(np.float64)
    _, head, same = np.unique(np.bincount(column, key[row], m), return_index=True, return_inverse=True)
    able = head[n[head] >= least]
    able.sort()
    number = np.full(m, -1, np.int32)
    number[able] = np.arange(len(able))
    hit = number[column] >= 0
    row, column, n, ones = row[hit], number[column[hit]], n[able], ones[able]
    bounds = np.searchsorted(row, np.arange(len(y) + 1))
    order = np.argsort(column, kind="stable")
    cuts = np.searchsorted(column[order], np.arange(len(able) + 1))
    lift = np.log((ones + 0.5) / (y.sum() + 1)) - np.log((n - ones + 0.5) / (len(y) - y.sum() + 1))
    base = np.log(share / (1 - share))
    beside = lambda at: np.bincount(np.concatenate([column[i + 1 : e] for i, e in zip(at, bounds[row[at] + 1], strict=True)]), minlength=len(able))
    for a in range(len(able)):
        at = order[cuts[a] : cuts[a + 1]]
        both = beside(at)
        b = np.flatnonzero(both >= least)
        hot = at[y[row[at]] == 1]
        if not len(b):
            continue
        got = (beside(hot)[b] if len(hot) else np.zeros(len(b))) / both[b]
        # Chernoff's bound is at most this, and the overall share is among those explained.
        far_off = both[b] * (got - share) ** 2 >= nats * share * (1 - share)
        b, got = b[far_off], got[far_off]
        if not len(b):
            continue
        known = 1 / (1 + np.exp(-(base + np.stack([np.zeros(len(b)), np.full(len(b), lift[a]), lift[b], lift[a] + lift[b]]))))
        near = np.clip(got, known.min(0), known.max(0))
        with np.errstate(divide="ignore", invalid="ignore"):
            far = np.where(got > 0, got * np.log(got / near), 0) + np.where(got < 1, (1 - got) * np.log((1 - got) / (1 - near)), 0)
        b = b[both[b] * far >= nats]
        out[able[b]] = True
        out[able[a]] |= len(b) > 0
    return out[head][same]


def fit(docs: DataFrame, labels: DataFrame, options: FMOptions | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "label") -> FMModel:
    """Fit on the documents that ``labels`` (id, label of 0 or 1) names.

    The bounded sample is drawn from the labels, so it may be broadcast and only the texts it
    names are read for it.  Of several labels of an id the largest counts.  A part of the sample is kept
    out to calibrate, so labels that no text explains give scores near the share of label 1.  No labelled
    document, one label only, or no term that tells anything: every score is that share.
    """
    o = options or FMOptions()
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    drawn = known.orderBy(F.xxhash64("id", F.lit(o.seed)), "id").limit(o.sample_rows)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(drawn), "id")
    draw = F.pmod(F.xxhash64("id", F.lit(o.seed + 1)), F.lit(1 << 30)).cast("int").alias("draw")
    got = rows.select("text", "label", draw).mapInArrow(_featurizer(o.bits), "terms array<int>, label int, draw int").toArrow()
    return learn(got.column("terms"), got.column("label").to_numpy().astype(np.float64), got.column("draw").to_numpy(), o)


def learn(lists: pa.ChunkedArray, labels_of: np.ndarray, draws: np.ndarray, o: FMOptions) -> FMModel:
    """The model of rows with known term lists, labels and draws (whole numbers that deal the rows)."""
    seen = draws % o.fold != 0
    if not 0 < labels_of[seen].sum() < seen.sum() or not 0 < labels_of[~seen].sum() < (~seen).sum():
        seen[:] = True  # too few rows to keep some out
    y = labels_of[seen]
    share = float(labels_of.mean()) if len(labels_of) else 0.0
    bias = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
    flat = FMModel(o.bits, np.zeros(0, np.int64), bias, np.zeros(0), np.zeros((0, o.factors)))
    if not 0 < share < 1:
        return flat

    def parts(wanted: np.ndarray = seen) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, slot) of some of the wanted rows at a time, so that the driver holds no array of all terms."""
        at, number = 0, np.cumsum(wanted) - 1
        for chunk in lists.chunks:
            for begin in range(0, len(chunk), 500):
                part = chunk.slice(begin, 500)
                row = np.repeat(np.arange(at, at + len(part)), np.diff(part.offsets.to_numpy()))
                keep = wanted[row]
                yield number[row[keep]], part.flatten().to_numpy()[keep]
                at += len(part)

    counts = np.zeros((2, 1 << o.bits), np.int32)
    for row, slot in parts():
        for label in (0, 1):
            np.add.at(counts[label], slot[y[row] == label], 1)
    slots = np.flatnonzero(counts.sum(0) >= o.least_rows)
    n0, n1 = counts[:, slots].astype(np.float64)
    del counts
    pooled = np.clip((n0 + n1) / len(y), 1e-9, 1 - 1e-9)
    z = np.abs(n1 / y.sum() - n0 / (len(y) - y.sum())) / np.sqrt(pooled * (1 - pooled) * (1 / y.sum() + 1 / (len(y) - y.sum())))
    number = np.full(1 << o.bits, -1, np.int32)

    def incidence(slots: np.ndarray, wanted: np.ndarray = seen) -> tuple[np.ndarray, np.ndarray]:
        number[:] = -1
        number[slots] = np.arange(len(slots))
        kept = [(row[number[slot] >= 0].astype(np.int32), number[slot[number[slot] >= 0]]) for row, slot in parts(wanted)]
        return tuple(np.concatenate(x) for x in zip(*kept, strict=True))

    telling = z >= o.least_z
    some = seen.copy()
    some[seen] = draws[seen] <= np.sort(draws[seen])[: o.pair_rows][-1]
    if not telling.all() and 0 < labels_of[some].sum() < some.sum():
        telling |= paired(*incidence(slots, some), labels_of[some], len(slots))
    slots = slots[telling]
    if not len(slots):
        return flat
    row, column = (x.astype(np.int64) for x in incidence(slots))
    # Rows come in no fixed order: sort the incidence list by what each row holds.
    digest = np.bincount(row, (column * 2654435761 % 1000003).astype(np.float64), len(y))
    place = np.empty(len(y), np.int64)
    place[np.lexsort((digest, y))] = np.arange(len(y))
    order = np.lexsort((column, place[row]))
    model = _descend(place[row][order], column[order], np.sort(y), slots, o)
    if not len(model.slots):
        return flat
    if seen.all():
        return replace(model, shift=bias)
    kept = [(row[hit], slot[hit]) for row, slot in parts(~seen) for hit in (np.isin(slot, model.slots),)]
    z = model.sums(*(np.concatenate(x) for x in zip(*kept, strict=True)), int((~seen).sum()))
    slope, shift, floor = calibrated(z, labels_of[~seen])
    return replace(model, slope=slope, shift=shift, floor=floor)


def _descend(row: np.ndarray, column: np.ndarray, y: np.ndarray, slots: np.ndarray, o: FMOptions) -> FMModel:
    """Full-batch Adagrad with proximal steps over the incidence list (row, column), sorted by row.

    Sums over rows take the terms that have a weight or factors at that step, as the others add
    nothing; gradients are those of all terms, summed over segments of the list sorted by column.
    """
    m, n, k = len(slots), len(y), o.factors
    rng = np.random.default_rng(o.seed)
    w, v = np.zeros(m), np.ascontiguousarray(rng.normal(0, 0.02, (m, k)).T)
    seen_w, seen_v, seen_b = np.full(m, 1e-8), np.full((k, m), 1e-8), 1e-8
    # Both labels weigh the same, so a rare one is not drowned.
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (n - y.sum()))
    by_column = row[np.argsort(column, kind="stable")]
    held = np.bincount(column, minlength=m)
    begin = (np.cumsum(held) - held)[held > 0]
    bias, live, part = 0.0, np.ones(m, bool), (row, column)
    for _ in range(o.steps):
        now = (w != 0) | (v != 0).any(0)
        if (now & ~live).any() or now.sum() < 0.8 * live.sum():
            live = now
            at = np.flatnonzero(live[column])
            part = row[at], column[at]
        at, term = part
        sums = np.stack([np.bincount(at, x.take(term), n) for x in v])
        total = bias + np.bincount(at, (w - 0.5 * (v**2).sum(0)).take(term), n) + 0.5 * (sums**2).sum(0)
        error = weight * (1 / (1 + np.exp(-np.clip(total, -40, 40))) - y)
        grad = np.zeros((k + 1, m))
        for to, each in zip(grad, (error, *(error * sums)), strict=True):
            to[held > 0] = np.add.reduceat(each.take(by_column), begin)
        grad_w, grad_v = grad[0], grad[1:] - grad[0] * v
        seen_b += error.sum() ** 2
        bias -= o.rate * error.sum() / np.sqrt(seen_b)
        seen_w += grad_w**2
        seen_v += grad_v**2
        step_w, step_v = o.rate / np.sqrt(seen_w), o.rate / np.sqrt(seen_v)
        w = w - step_w * grad_w
        w = np.sign(w) * np.maximum(np.abs(w) - step_w * o.l1, 0)
        v = v - step_v * grad_v
        size = np.sqrt((v**2).sum(0))
        v = v * np.maximum(1 - step_v.mean(0) * o.l1 / np.maximum(size, 1e-12), 0)
    live = (w != 0) | (v != 0).any(0)
    return FMModel(o.bits, slots[live], bias, w[live], np.ascontiguousarray(v[:, live].T))


def score(docs: DataFrame, model: FMModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` for every row, from its text alone.

    Defined cases: a null or empty text has no terms and gets the score of the bias;
    texts are read whole; repeated rows and null ids are scored like others; other
    columns are not read; an empty table gives an empty one.
    """
    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in tx.slices(batch.column(1)):
                got = model.scores(batch.column(1).slice(begin, end - begin))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), pa.array(got), pa.array((got >= 0.5).astype(np.int32))], ["id", "score", "predicted"])

    return kept.mapInArrow(run, f"id {kept.schema['id'].dataType.simpleString()}, score double, predicted int").withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, model: FMModel, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose predicted label is 0.  No shuffle."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in tx.slices(batch.column(at)):
                part = batch.slice(begin, end - begin)
                yield part.filter(pa.array(model.scores(part.column(at)) < 0.5))

    return docs.mapInArrow(run, docs.schema)
