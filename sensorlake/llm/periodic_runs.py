"""Periodic runs of words by internal pattern matching.

A run is a stretch of words that repeats with a smallest period q and that no
neighbouring word extends; those of at least ``MIN_POWER`` periods and
``MIN_WORDS`` words count. The search takes the texts of a chunk together:

* Prefix doubling ranks, for each k, all stretches of 2^k words inside a text
  and ends in the suffix array. A group of equal stretches is an interval of it.
* Every text is cut into dyadic blocks of 2^k words. A run of period q holds,
  for the one k with 2^(k+1) <= 3q + 1 < 2^(k+2), an aligned block near its
  beginning that occurs again q words on. So the block asks for its
  occurrences among the next places from ``nearest(k)`` to ``farthest(k)``: a
  wavelet tree over the suffix array tells how many there are in the block's
  interval, and the first two of them (range successor).
* One or two occurrences are candidate periods. Three or more form an
  arithmetic progression, whose difference p is a period of the block; then
  the block and its copy lie in two stretches of period p, and the distance of
  their ends is the one candidate. Within one such stretch there is none, as q
  would be a multiple of p.
* A candidate is extended to both sides with the ranks (equal stretches of
  2^k words are skipped, k falling), and kept if it is long enough.

Work is in proportion to words times the logarithm of the longest text of the
chunk, however periodic a text is: a block has one to two candidates, never
all its occurrences. Words are known by 64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorlake.llm import words

MIN_WORDS = 6
MIN_POWER = 4

_U = np.uint64
RUN_FIELDS = ("start", "length", "period")
RUN_SCHEMA = T.StructType([T.StructField(name, T.LongType()) for name in RUN_FIELDS])
RESULTS = T.StructType(
    [
        T.StructField("n_runs", T.LongType()),
        *RUN_SCHEMA.fields,
        T.StructField("exponent_milli", T.LongType()),
        T.StructField("runs", T.ArrayType(RUN_SCHEMA)),
        T.StructField("collapsed", T.StringType()),
    ]
)


def nearest(k: int) -> int:
    """The smallest period that blocks of 2^k words look for."""
    return -(-((2 << k) - 1) // 3)


def farthest(k: int) -> int:
    """The largest period that blocks of 2^k words look for."""
    return nearest(k + 1) - 1


class Ranks:
    """The suffix array of texts laid side by side, and the ranks of stretches of 2^k words.

    ids: equal for equal words of one text, unequal otherwise. bounds: the n + 1
    places where texts begin and end. ranks[k][i] is the place in the suffix
    array where the group of the 2^k words from i begins; stretches cut short by
    the end of their text are alone. blocks[k]: the aligned stretches of 2^k
    words that are not alone, with the interval of their group.
    """

    def __init__(self, ids: np.ndarray, bounds: np.ndarray):
        n = len(ids)
        counts = np.diff(bounds)
        ends = np.repeat(bounds[1:], counts)
        self.local = np.arange(n) - np.repeat(bounds[:-1], counts)
        self.suffixes = np.argsort(ids, kind="stable")
        head = np.ones(n, dtype=bool)
        ordered = ids[self.suffixes]
        head[1:] = ordered[1:] != ordered[:-1]
        rank = np.full(n + 1, -1, dtype=np.int32)
        rank[self.suffixes] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
        self.ranks, self.blocks = [rank], [(np.zeros(0, dtype=np.int64),) * 3]
        shared = self._shared(head, np.arange(n))
        length = 1
        while len(shared):
            places = self.suffixes[shared]
            on = places + length
            second = np.where(on < ends[places], rank[on], -1).astype(np.int64)
            key = rank[places].astype(np.int64) * (n + 1) + second + 1
            order = np.argsort(key, kind="stable")
            key, places = key[order], places[order]
            self.suffixes[shared] = places
            head[shared[1:]] |= key[1:] != key[:-1]
            rank = rank.copy()
            rank[places] = np.maximum.accumulate(np.where(head[shared], shared, 0))
            self.ranks.append(rank)
            length *= 2
            shared = self._shared(head, shared)
            self._add_blocks(rank, shared, length)

    @staticmethod
    def _shared(head: np.ndarray, among: np.ndarray) -> np.ndarray:
        """The places of the suffix array, of those given, whose group has several."""
        last = np.ones(len(head), dtype=bool)
        last[:-1] = head[1:]
        return among[~(head & last)[among]]

    def _add_blocks(self, rank: np.ndarray, shared: np.ndarray, length: int) -> None:
        places = self.suffixes[shared]
        low = rank[places].astype(np.int64)
        begun = np.flatnonzero(np.diff(low, prepend=-1))
        sizes = np.diff(np.append(begun, len(low)))
        high = low + np.repeat(sizes, sizes)
        aligned = (self.local[places] & (length - 1)) == 0
        self.blocks.append((places[aligned], low[aligned], high[aligned]))

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i on equal those from j on; i < j, both in one text."""
        at, other = i.copy(), j.copy()
        for k in range(len(self.ranks) - 1, -1, -1):
            equal = self.ranks[k][at] == self.ranks[k][other]
            at[equal] += 1 << k
            other[equal] += 1 << k
        return at - i

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before i equal those before j; i < j, both in one text."""
        at, other = i.copy(), j.copy()
        for k in range(len(self.ranks) - 1, -1, -1):
            there, beside = np.maximum(at - (1 << k), 0), np.maximum(other - (1 << k), 0)
            equal = (at >= 1 << k) & (self.ranks[k][there] == self.ranks[k][beside])
            at[equal] -= 1 << k
            other[equal] -= 1 << k
        return i - at


class WaveletTree:
    """Counts and order statistics of intervals of an array of values from 0, many at a time.

    A level holds one bit of each value, from the highest bit down, after a
    stable partition by the bits above; 64 bits a word beside running totals.
    """

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        self.levels = []
        rest = values
        for bit in range(int(values.max(initial=0)).bit_length() - 1, -1, -1):
            ones = ((rest >> bit) & 1).astype(bool)
            packed = np.packbits(ones, bitorder="little")
            stored = np.zeros((self.n // 64 + 1) * 8, dtype=np.uint8)
            stored[: len(packed)] = packed
            stored = stored.view(_U)
            totals = np.zeros(len(stored), dtype=np.int64)
            np.cumsum(np.bitwise_count(stored[:-1]), out=totals[1:])
            self.levels.append((bit, stored, totals, self.n - int(ones.sum())))
            rest = np.concatenate((rest[~ones], rest[ones]))

    @staticmethod
    def _ones(stored: np.ndarray, totals: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The one bits before each place."""
        word = place >> 6
        below = (_U(1) << (place & 63).astype(_U)) - _U(1)
        return totals[word] + np.bitwise_count(stored[word] & below)

    def below(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many values of each interval are smaller than the bound."""
        out = np.zeros(len(low), dtype=np.int64)
        top = 1 << len(self.levels)
        whole = bound >= top
        out[whole] = (high - low)[whole]
        at = np.flatnonzero(~whole)
        low, high, bound = low[at], high[at], bound[at]
        for bit, stored, totals, zeros in self.levels:
            a, b = self._ones(stored, totals, low), self._ones(stored, totals, high)
            one = ((bound >> bit) & 1).astype(bool)
            out[at[one]] += ((high - low) - (b - a))[one]
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + b, high - b)
        return out

    def smallest(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The value of each interval that k values of it go before, k less than its size."""
        out = np.zeros(len(low), dtype=np.int64)
        for bit, stored, totals, zeros in self.levels:
            a, b = self._ones(stored, totals, low), self._ones(stored, totals, high)
            smaller = (high - low) - (b - a)
            one = k >= smaller
            out |= one.astype(np.int64) << bit
            k = np.where(one, k - smaller, k)
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + b, high - b)
        return out


def candidates(ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances at which a run may have its period."""
    tree = WaveletTree(ranks.local[ranks.suffixes])
    places, periods = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for k in range(1, len(ranks.blocks)):
        place, low, high = ranks.blocks[k]
        here = ranks.local[place]
        before = tree.below(low, high, here + nearest(k))
        within = tree.below(low, high, here + farthest(k) + 1) - before
        for n in (1, 2):
            asked = np.flatnonzero((within >= n) & (within < 3))
            found = tree.smallest(low[asked], high[asked], before[asked] + n - 1)
            places.append(place[asked])
            periods.append(found - here[asked])
        many = np.flatnonzero(within >= 3)
        block, low, high, before, here = place[many], low[many], high[many], before[many], here[many]
        first, second = (tree.smallest(low, high, before + n) for n in (0, 1))
        copy, step = block + first - here, second - first
        apart = copy + ranks.ahead(copy, copy + step) - block - ranks.ahead(block, block + step)
        good = (apart >= nearest(k)) & (apart <= farthest(k))
        places.append(block[good])
        periods.append(apart[good])
    return np.concatenate(places), np.concatenate(periods)


def find(ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and periods of the runs of texts laid side by side, by start, then period.

    ids: of words, equal for equal ones of one text, and otherwise unequal.
    """
    if not len(ids):
        return (np.zeros(0, dtype=np.int64),) * 3
    ranks = Ranks(ids, bounds)
    place, period = candidates(ranks)
    text = np.searchsorted(bounds, place, side="right")
    inside = place + period < bounds[text] if len(place) else np.zeros(0, dtype=bool)
    place, period = place[inside], period[inside]
    start = place - ranks.behind(place, place + period)
    length = place + period + ranks.ahead(place, place + period) - start
    good = length >= np.maximum(MIN_WORDS, MIN_POWER * period)
    start, length, period = start[good], length[good], period[good]
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    # a stretch has its smallest period, the others are multiples of it
    new = np.ones(len(start), dtype=bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[new], length[new], period[new]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """Of some runs the one of the most periods, then of the smallest start, then period."""
    return max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]))


def planted(key: int | None, n: int) -> np.ndarray | None:
    """For one key in ten, by crc32: the order of n words in which the end of the text repeats.

    From word a on, the words are those of the first p from there, over and
    over. None: the words as they are; likewise for a null key.
    """
    if key is None or not n:
        return None
    digest = zlib.crc32(str(key).encode())
    if digest % 10:
        return None
    g = digest // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    order = np.arange(n)
    order[a:] = a + (order[a:] - a) % p
    return order


def detect(
    docs: DataFrame, text: str = "text", key: str | None = None,
    arrange: Callable[[object, int], np.ndarray | None] | None = None,
) -> DataFrame:
    """Every row with its columns, and the periodic runs of its words.

    Adds n_runs; start (a word number from 0), length, period and
    exponent_milli (floor of 1000 times length over period) of the run of the
    most periods; runs, all of them as an array of (start, length, period); and
    collapsed, the words joined by one space without those that any run holds
    after its first period. All numbers are long. A row without a run has 0,
    four nulls and an empty array. A null or empty text has no words; its
    collapsed text is empty. Each row is taken alone, so repeated rows get equal
    results. Columns of the input that are called like a result are replaced.

    arrange: from the value of the column key and the number of words, the
    words to take instead, by number; None for all as they are.
    """
    names = [f for f in docs.schema.fields if f.name not in RESULTS.fieldNames()]
    columns = [F.col(f"`{f.name}`") for f in names]
    if text not in docs.columns:
        raise ValueError(f"no column {text}")
    hidden = T.StructType([T.StructField("_text", T.StringType()), T.StructField("_key", T.StringType())])
    own = docs.select(
        F.struct(*columns).alias("row") if columns else F.struct(F.lit(None).alias("row")).alias("row"),
        F.col(f"`{text}`").alias(hidden[0].name),
        (F.col(f"`{key}`") if key else F.lit(None).cast("string")).alias(hidden[1].name),
    )
    row = own.schema["row"]
    schema = T.StructType([row, *RESULTS.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("_key").to_pylist() if arrange else []
            for part in words.split(batch.column("_text")):
                yield _batch(batch.slice(part.first, len(part.counts)), part, keys[part.first : part.first + len(part.counts)], arrange)

    return own.mapInArrow(run, schema).select("row.*", *RESULTS.fieldNames())


def _batch(rows: pa.RecordBatch, part: words.Words, keys: list, arrange) -> pa.RecordBatch:
    bounds = part.offsets.astype(np.int64)
    count = len(part.counts)
    orders: dict[int, np.ndarray] = {}
    if arrange:
        for k, (name, n) in enumerate(zip(keys, part.counts.tolist(), strict=True)):
            own = arrange(name, n)
            if own is not None:
                orders[k] = np.asarray(own, dtype=np.int64)
    taken = np.arange(bounds[-1])
    for k, own in orders.items():
        taken[bounds[k] : bounds[k + 1]] = bounds[k] + own
    of = np.repeat(np.arange(count), part.counts)
    ids = words.mix(part.hashes()[taken] + words.mix(of.astype(_U) + _U(1)))
    start, length, period = find(ids, bounds)

    cover = np.zeros(bounds[-1] + 1, dtype=np.int64)
    np.add.at(cover, start + period, 1)
    np.add.at(cover, start + length, -1)
    dropped = np.cumsum(cover)[:-1] > 0
    text_of = np.searchsorted(bounds, start, side="right") - 1
    cuts = np.searchsorted(text_of, np.arange(count + 1))
    start = start - bounds[text_of]
    best = {name: [None] * count for name in (*RUN_FIELDS, "exponent_milli")}
    for k in np.flatnonzero(np.diff(cuts)):
        mine = slice(cuts[k], cuts[k + 1])
        a, size, q = strongest(list(zip(start[mine].tolist(), length[mine].tolist(), period[mine].tolist(), strict=True)))
        best["start"][k], best["length"][k], best["period"][k], best["exponent_milli"][k] = a, size, q, 1000 * size // q

    data = part.data.tobytes()
    any_dropped = np.concatenate(([0], np.cumsum(dropped)))
    any_dropped = np.diff(any_dropped[bounds]) > 0
    collapsed = []
    for k, (low, high) in enumerate(zip(part.text_starts.tolist(), part.text_ends.tolist(), strict=True)):
        each = data[low:high].split()
        if k in orders or any_dropped[k]:
            left = taken[bounds[k] : bounds[k + 1]][~dropped[bounds[k] : bounds[k + 1]]] - bounds[k]
            each = [each[i] for i in left]
        collapsed.append(b" ".join(each))

    runs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], names=RUN_FIELDS)
    arrays = [
        rows.column("row"),
        pa.array(np.diff(cuts), pa.int64()),
        *[pa.array(best[name], pa.int64()) for name in (*RUN_FIELDS, "exponent_milli")],
        pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), runs),
        pa.array(collapsed, pa.large_binary()).cast(pa.large_string()).cast(pa.string()),
    ]
    return pa.RecordBatch.from_arrays(arrays, names=["row", *RESULTS.fieldNames()])
