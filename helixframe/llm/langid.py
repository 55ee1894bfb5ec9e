"""Language identification by interpolated Kneser-Ney character models.

Languages share one sorted hash array an order, in groups of ``GROUP``; beside each key stands the
log probability in every language (and, as a context, every back-off weight).  A
text goes to the language of lowest cross-entropy a character.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm import text as tx

#: Symbol 0 pads the start, 1 is any gap between words, 2 any letter that no learned text holds.
START, GAP, OTHER = 0, 1, 2
#: Bits that such a letter costs.
UNSEEN = 12
#: Up to so many counts of languages are broadcast; of more the join is a shuffle.
MOST_BROADCAST = 10_000
#: Languages in one set of arrays; a language's probabilities do not depend on the others of its group.
GROUP = 32


@dataclass(frozen=True)
class LangOptions:
    """``sample_rows`` bounds the labelled rows a language that are learned from (drawn by a hash of the id).

    Every language and every letter of the sample is learned.
    A fifth of the rows is kept out of the counts, to calibrate.  ``order`` is the length of
    the n-grams, less where the alphabet needs so many bits a symbol that 64 do not hold them.  A text is rejected if its surprise is over ``slack`` times that which the
    share ``usual`` of the calibration rows of its language stays below, so odd rows among them
    (up to a tenth) do not set the limit; a language with fewer than ``least_rows`` such rows
    has the limit of all rows.
    """

    sample_rows: int = 1500
    order: int = 4
    usual: float = 0.9
    slack: float = 10.0
    least_rows: int = 20
    seed: int = 3


@lru_cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: its lower case (where that is one character), and whether it is a letter."""
    low = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        if (x := chr(c)).isupper() and len(x.lower()) == 1:
            low[c] = ord(x.lower())
    return low, np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def letter_stream(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters of all texts with one blank (0) for each run of others, and the bounds of the texts.

    Each text begins with a blank, and ends with one if it has a letter.
    """
    low, letter = _letters()
    raw = np.frombuffer("".join(f" {t or ''} " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    begins = np.cumsum([0, *(len(t or "") + 2 for t in texts)], dtype=np.int64)
    code = low[raw]
    is_letter = letter[code]
    code = np.where(is_letter, code, 0)
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    keep[begins[:-1]] = True
    return code[keep], np.concatenate(([0], np.cumsum(keep)))[begins]


def has_letter(out: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(out > 0)))
    return total[bounds[1:]] > total[bounds[:-1]]


def symbol_bits(alphabet: np.ndarray) -> int:
    return (len(alphabet) + 2).bit_length()


def ngrams(symbols: np.ndarray, bounds: np.ndarray, order: int, bits: int) -> np.ndarray:
    """Packed n-grams that end at each position but the first of every text; before its first blank stand start symbols."""
    n = len(symbols)
    packed = np.zeros(n, np.uint64)
    age = np.arange(n) - bounds[:-1][np.maximum(np.searchsorted(bounds[:-1], np.arange(n), "right") - 1, 0)] if n else np.zeros(0, np.int64)
    for back in range(order - 1, -1, -1):
        part = np.zeros(n, np.uint64)
        part[back:] = symbols[: n - back]
        if back:
            part[age < back] = START
        packed = packed << np.uint64(bits) | part
    return packed


@dataclass(frozen=True)
class Order:
    """Sorted hashes of the n-grams of one order, with log2 probabilities and back-off weights by language."""

    keys: np.ndarray
    starts: np.ndarray
    logp: np.ndarray
    backoff: np.ndarray

    def find(self, packed: np.ndarray) -> np.ndarray:
        """Rows of the n-grams, -1 where absent: a jump by the leading bits, then a walk along the sorted hashes."""
        if not len(self.keys):
            return np.full(len(packed), -1, np.int64)
        keys = tx.mix(packed + np.uint64(1))
        at = self.starts[keys >> np.uint64(48)]
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            here = self.keys[np.minimum(at, len(self.keys) - 1)]
            hit = (here == keys[todo]) & (at < len(self.keys))
            out[todo[hit]] = at[hit]
            more = (here < keys[todo]) & (at < len(self.keys))
            todo, at = todo[more], at[more] + 1
        return out


def _order(packed: np.ndarray, logp: np.ndarray, backoff: np.ndarray) -> Order:
    keys = tx.mix(packed + np.uint64(1))
    by = np.argsort(keys)
    keys = keys[by]
    starts = np.searchsorted(keys, np.arange(1 << 16, dtype=np.uint64) << np.uint64(48))
    return Order(keys, starts, logp[by].astype(np.float32), backoff[by].astype(np.float32))


@dataclass(frozen=True)
class LangModel:
    """``alphabet`` (sorted code points) numbers the symbols from 3; ``groups[g][n - 1]`` has the n-grams of order n.

    ``centre`` and ``limit`` have a value for each language, once calibrated.
    """

    langs: list[str]
    alphabet: np.ndarray
    groups: list[list[Order]]
    beta: float = 1.0
    centre: np.ndarray | float = 0.0
    limit: np.ndarray | float = float("inf")

    def symbols(self, codes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.alphabet, codes), max(len(self.alphabet) - 1, 0))
        known = self.alphabet[at] == codes if len(self.alphabet) else np.zeros(len(codes), bool)
        return np.where(codes == 0, GAP, np.where(known, at + 3, OTHER)).astype(np.uint64)

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bits a character (text, language), characters, and whether the text has a letter."""
        codes, bounds = letter_stream(texts)
        letters = has_letter(codes, bounds)
        packed = ngrams(self.symbols(codes), bounds, len(self.groups[0]), symbol_bits(self.alphabet))
        scored = np.ones(len(codes), bool)
        scored[bounds[:-1]] = False
        where = np.flatnonzero(scored)
        total = np.zeros((len(codes) + 1, len(self.langs)))
        total[where + 1] = self.logs(packed[where])
        total = np.cumsum(total, axis=0)
        n = np.maximum(bounds[1:] - bounds[:-1] - 1, 1)
        return -(total[bounds[1:]] - total[bounds[:-1]]) / n[:, None], n, letters

    def logs(self, packed: np.ndarray) -> np.ndarray:
        """log2 probability of the last symbol of each n-gram given those before, by language."""
        bits = symbol_bits(self.alphabet)
        return np.concatenate([_logs(orders, packed, bits) for orders in self.groups], axis=1)

    def judge(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Best language (-1: no letter), its calibrated probability, bits a character, and whether it is rejected."""
        if not self.langs:
            return np.full(len(texts), -1), np.zeros(len(texts)), np.zeros(len(texts)), np.ones(len(texts), bool)
        bits, n, letters = self.entropies(texts)
        best = bits.argmin(1)
        low = bits[np.arange(len(bits)), best]
        odds = np.exp(np.clip(-self.beta * np.sqrt(n)[:, None] * (bits - low[:, None]), -700, 0))
        centre, limit = (np.broadcast_to(x, len(self.langs))[best] for x in (self.centre, self.limit))
        return np.where(letters, best, -1), np.where(letters, 1 / odds.sum(1), 0.0), low, ~letters | (_surprise(low, n, centre) > limit)


def _logs(orders: list[Order], packed: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros((len(packed), orders[0].logp.shape[1]), np.float32)
    todo, left = np.arange(len(packed)), packed
    for n in range(len(orders), 0, -1):
        order = orders[n - 1]
        row = order.find(left)
        hit = row >= 0
        out[todo[hit]] += order.logp[row[hit]]
        todo, left = todo[~hit], left[~hit]
        if not len(todo):
            break
        if n == 1:
            out[todo] -= np.float32(UNSEEN)
            break
        shorter = orders[n - 2]
        context = shorter.find(left >> np.uint64(bits))
        known = context >= 0
        out[todo[known]] += shorter.backoff[context[known]]
        left = left & np.uint64((1 << bits * (n - 1)) - 1)
    return out


def _surprise(bits: np.ndarray, n: np.ndarray, centre: np.ndarray | float) -> np.ndarray:
    return (bits - centre) * np.sqrt(np.minimum(n, 400))


def build(counts: list[dict[int, np.ndarray]], langs: list[str], alphabet: np.ndarray, order: int) -> LangModel:
    """Interpolated Kneser-Ney: ``counts[l][0]`` are packed n-grams of the top order in language l, ``[1]`` how often."""
    bits = symbol_bits(alphabet)
    groups = [_group(counts[at : at + GROUP], len(alphabet), order, bits) for at in range(0, max(len(langs), 1), GROUP)]
    return LangModel(langs, alphabet, groups)


def _group(counts: list[dict[int, np.ndarray]], letters: int, order: int, bits: int) -> list[Order]:
    n_lang = len(counts)
    mask = lambda n: np.uint64((1 << bits * n) - 1)
    grams: list[np.ndarray] = [np.zeros(0, np.uint64)] * (order + 1)
    grams[order] = np.unique(np.concatenate([c[0] for c in counts] or [np.zeros(0, np.uint64)]))
    for n in range(order, 1, -1):
        grams[n - 1] = np.unique(np.concatenate((grams[n] >> np.uint64(bits), grams[n] & mask(n - 1))))
    # Every group has all letters, so that what a language has not seen costs the same in each.
    grams[1] = np.union1d(grams[1], np.array([START, GAP, *range(3, letters + 3)], np.uint64))
    table: list[np.ndarray] = [np.zeros((len(g), n_lang)) for g in grams]
    for i, c in enumerate(counts):
        table[order][np.searchsorted(grams[order], c[0]), i] = c[1]
    # Below the top a gram counts the different symbols seen before it; at a start nothing stands before, so it counts occurrences.
    for n in range(order - 1, 0, -1):
        suffix = np.searchsorted(grams[n], grams[n + 1] & mask(n))
        np.add.at(table[n], suffix, (table[n + 1] > 0).astype(float))
    size = max(1, len(grams[1]))
    below = np.full((1, n_lang), 1.0 / (size + 1))
    orders: list[Order] = []
    backoffs: list[np.ndarray] = []
    probs: list[np.ndarray] = []
    for n in range(1, order + 1):
        c = table[n]
        once, twice = (c == 1).sum(0), (c == 2).sum(0)
        discount = np.clip(once / np.maximum(once + 2 * twice, 1), 0.1, 0.95)
        if n == 1:
            context = np.zeros(len(grams[1]), np.int64)
            n_context = 1
            lower = np.broadcast_to(below, (len(grams[1]), n_lang))
        else:
            context = np.searchsorted(grams[n - 1], grams[n] >> np.uint64(bits))
            n_context = len(grams[n - 1])
            lower = probs[-1][np.searchsorted(grams[n - 1], grams[n] & mask(n - 1))]
        total, kinds = np.zeros((n_context, n_lang)), np.zeros((n_context, n_lang))
        np.add.at(total, context, c)
        np.add.at(kinds, context, (c > 0).astype(float))
        weight = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
        probs.append(np.where(total[context] > 0, np.maximum(c - discount, 0) / np.maximum(total[context], 1), 0) + weight[context] * lower)
        backoffs.append(np.log2(weight))
    for n in range(1, order + 1):
        backoff = backoffs[n] if n < order else np.zeros((len(grams[n]), n_lang))
        orders.append(_order(grams[n], np.log2(np.maximum(probs[n - 1], 1e-12)), backoff))
    return orders


def _pieces(texts: list[str], most: int = 1 << 18) -> Iterator[list[str]]:
    """The texts in lists of about ``most`` characters, which bounds what the driver holds."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > most:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def _calibrated(model: LangModel, texts: list[str], langs: list[str], o: LangOptions) -> LangModel:
    """Probability scale of least log loss, and by language the surprise that right texts stay below."""
    if not texts:
        return model
    bits, n, letters = (np.concatenate(x) for x in zip(*map(model.entropies, _pieces(texts)), strict=True))
    truth = np.array([model.langs.index(x) for x in langs])
    keep = letters
    bits, n, truth = bits[keep], n[keep], truth[keep]
    if not len(truth):
        return model
    low = bits.min(1)
    gap = (bits - low[:, None]) * np.sqrt(n)[:, None]
    losses = []
    grid = [0.05 * 1.3**i for i in range(30)]
    for beta in grid:
        odds = np.exp(np.clip(-beta * gap, -700, 0))
        losses.append(-np.log(np.maximum(odds[np.arange(len(truth)), truth] / odds.sum(1), 1e-9)).mean())
    beta = grid[int(np.argmin(losses))]
    right = bits.argmin(1) == truth
    right = right if right.any() else ~right
    centre, limit = np.empty(len(model.langs)), np.empty(len(model.langs))
    for i in range(len(model.langs)):
        own = right & (truth == i)
        own = own if own.sum() >= o.least_rows else right
        centre[i] = np.median(low[own])
        limit[i] = o.slack * max(np.quantile(_surprise(low[own], n[own], centre[i]), o.usual), 0.5)
    return LangModel(model.langs, model.alphabet, model.groups, beta, centre, limit)


def fit(labelled: DataFrame, options: LangOptions | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LangModel:
    """Learn from the rows whose language and text are not null; a bounded sample of each language.

    Rows are drawn by a hash of id and text, so rows without an id are drawn one by one, and of repeated rows one is.
    """
    o = options or LangOptions()
    text = labelled[text_col].cast("string")
    rows = labelled.select(text.alias("text"), labelled[lang_col].cast("string").alias("lang"), F.pmod(F.xxhash64(labelled[id_col], text, F.lit(o.seed)), F.lit(1 << 40)).alias("draw")).where("text IS NOT NULL AND lang IS NOT NULL")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    listed = sizes.limit(MOST_BROADCAST + 1).collect()
    if len(listed) <= MOST_BROADCAST:
        sizes = F.broadcast(labelled.sparkSession.createDataFrame(listed, sizes.schema))
    rows = rows.join(sizes, "lang").where(F.col("draw") < F.least(F.lit(1.0), o.sample_rows / F.col("n")) * (1 << 40)).dropDuplicates(["lang", "draw"])
    got = sorted(rows.select("lang", "draw", "text").toArrow().to_pylist(), key=lambda r: (r["lang"], r["draw"], r["text"]))
    langs = sorted({r["lang"] for r in got})
    known = [r for i, r in enumerate(got) if i % 5]
    found = [np.unique(letter_stream(part)[0]) for part in _pieces([r["text"] for r in known])]
    letters = np.unique(np.concatenate(found or [np.zeros(0, np.uint32)]))
    alphabet = letters[letters > 0]
    bits = symbol_bits(alphabet)
    order = min(o.order, 64 // bits)
    bare = LangModel(langs, alphabet, [])
    counts = []
    for lang in langs:
        texts = [r["text"] for r in known if r["lang"] == lang]
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for part in _pieces(texts):
            codes, bounds = letter_stream(part)
            packed = ngrams(bare.symbols(codes), bounds, order, bits)
            scored = np.ones(len(codes), bool)
            scored[bounds[:-1]] = False
            parts.append(np.unique(packed[scored], return_counts=True))
        keys, where = np.unique(np.concatenate([p[0] for p in parts] or [np.zeros(0, np.uint64)]), return_inverse=True)
        counts.append((keys, np.bincount(where, np.concatenate([p[1] for p in parts] or [np.zeros(0)]), len(keys))))
    model = build(counts, langs, alphabet, order)
    held = [r for i, r in enumerate(got) if not i % 5]
    return _calibrated(model, [r["text"] for r in held], [r["lang"] for r in held], o)


def identify(docs: DataFrame, model: LangModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, bits_per_char, rejected`` of every row, from its text alone.

    ``score`` is the calibrated probability of the language.  ``rejected`` texts are
    those without a letter (``und``, score 0) and those whose cross-entropy is much further above
    the usual of their language than calibration saw for most texts, allowing for length.  Defined cases: a null
    text counts as empty; ties go to the language first in order; texts are read
    whole; repeated rows and null ids are judged like others; with nothing to learn from
    every text is ``und``; other columns are not read; an empty table gives an empty one.
    """
    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    names = np.array([*model.langs, "und"], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in tx.slices(batch.column(1), tx.SLICE_BYTES // 2):
                best, score, bits, rejected = model.judge(batch.column(1).slice(begin, end - begin).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), pa.array(names[best], pa.string()), pa.array(score, pa.float64()), pa.array(bits, pa.float64()), pa.array(rejected)], ["id", "lang_pred", "score", "bits_per_char", "rejected"])

    return kept.mapInArrow(run, f"id {kept.schema['id'].dataType.simpleString()}, lang_pred string, score double, bits_per_char double, rejected boolean").withColumnRenamed("id", id_col)


def drop_rejected(docs: DataFrame, model: LangModel, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text is not rejected.  No shuffle."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in tx.slices(batch.column(at), tx.SLICE_BYTES // 2):
                part = batch.slice(begin, end - begin)
                yield part.filter(pa.array(~model.judge(part.column(at).to_pylist())[3]))

    return docs.mapInArrow(run, docs.schema)
