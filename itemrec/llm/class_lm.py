"""Class-based n-grams: exchange clustering of words, class transitions and word emissions."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemrec.llm.common import arrow_schema, as_batch, bound_batches, named
from itemrec.runtime import store

#: Classes, rounds of exchange, and the pseudo-count that ties a class's transitions to the class shares.
CLASSES, ROUNDS, STRENGTH = 32, 8, 100.0
#: Most frequent words that every task gets with counts and classes, and those of them that exchange
#: classes among themselves first, so that all words start from good ones.
SHARED_WORDS, CORE_WORDS = 1 << 20, 1 << 14
#: Occurrences below which a word's neighbours say too little for that start.
CORE_COUNT = 8
#: Most frequent words whose neighbours aren't gathered: tasks add up what they meet beside them, in tables cut into slices.
HOT_WORDS, SLICES = 1 << 12, 16
#: Entries of a row of lists (more if a word has more), tokens for each part of the lists, and the most parts.
PACKED, PART_TOKENS, MOST_PARTS = 1 << 16, 1 << 20, 1 << 14
#: Kinds of rows of lists.
NEAR, FAR, OPEN = 0, 1, 2
#: Code beside the classes after and before a word: the word after itself.
SELF = 2 * (CLASSES + 1)
#: Distinct entries that a task adds up before it passes them on.
HELD = 1 << 20
#: Word numbers are 64-bit hashes; this one is the end of a text.
END = 0
_BASE = 0x9E3779B97F4A7C15 | 1
_SLICE = 1 << 20


@functools.cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    powers = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(size + 1, base, np.uint64)
        steps[0] = 1
        powers.append(np.cumprod(steps, dtype=np.uint64))
    return tuple(powers)


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(number of each word of all texts, and how many words each text has), without ends.

    Words are runs of characters other than white space (ASCII), with A-Z in lower case. A number is
    a polynomial over the word's bytes, modulo 2^64 and mixed.
    """
    data = np.frombuffer(b"\n".join([*texts, b""]).lower(), np.uint8)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, stops = edges[::2], edges[1::2]
    out = np.empty(len(starts), np.uint64)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(starts):
            upto = max(at + 1, int(np.searchsorted(stops, starts[at] + _SLICE, side="right")))
            first = starts[at]
            part = data[first : stops[upto - 1]].astype(np.uint64) + np.uint64(1)
            up, down = _powers(_SLICE if len(part) <= _SLICE else 1 << int(len(part)).bit_length())
            sums = np.concatenate([[np.uint64(0)], np.cumsum(part * up[: len(part)], dtype=np.uint64)])
            a, b = starts[at:upto] - first, stops[at:upto] - first
            h = (sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(29)
            out[at:upto] = h
            at = upto
    out[out == END] = 1
    ends = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
    upto = np.searchsorted(starts, ends)
    return out.view(np.int64), np.diff(np.concatenate([[0], upto]))


def with_ends(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(numbers with END after each text, place after each text's END)."""
    found, sizes = words(texts)
    stops = np.cumsum(sizes + 1)
    out = np.empty(len(found) + len(sizes), np.int64)
    is_end = np.zeros(len(out), bool)
    is_end[stops - 1] = True
    out[is_end], out[~is_end] = END, found
    return out, stops


class Sums:
    """Counts of keys, added up in a task; ``full`` once it should pass them on."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray) -> None:
        found, n = np.unique(keys, return_counts=True)
        self.parts.append((found, n))
        self.size += len(found)

    def full(self) -> bool:
        if self.size > HELD:
            self.parts = [self.total()]
            self.size = len(self.parts[0][0])
        return self.size > HELD // 2

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        found, at = np.unique(np.concatenate([k for k, _ in self.parts]), return_inverse=True)
        n = np.bincount(at, weights=np.concatenate([n for _, n in self.parts]), minlength=len(found))
        return found, n.astype(np.int64)


def summed(rows: DataFrame, keys_of, schema: str = "key bigint, n bigint") -> DataFrame:
    """(key, n): how often ``keys_of(texts)`` gives each key, over all rows."""
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums()
        for batch in batches:
            sums.add(keys_of([t or b"" for t in batch["text"].to_pylist()]))
            if sums.full():
                yield from flush(sums)
                sums = Sums()
        yield from flush(sums)

    def flush(sums: Sums) -> Iterator[pa.RecordBatch]:
        keys, n = sums.total()
        for a in range(0, len(keys), 1 << 16):
            yield as_batch({"key": keys[a : a + (1 << 16)], "n": n[a : a + (1 << 16)]}, out)

    return rows.mapInArrow(run, schema).groupBy("key").agg(F.sum("n").alias("n"))


class Lookup:
    """Place of each of some numbers, by a hash table with open addresses."""

    def __init__(self, keys: np.ndarray):
        size = 1 << max(4, int(2 * len(keys)).bit_length())
        self.mask, self.slots, self.place = size - 1, np.zeros(size, np.int64), np.full(size, -1, np.int32)
        at, waiting = keys & self.mask, np.arange(len(keys), dtype=np.int32)
        while len(waiting):
            free = self.place[at] < 0
            self.place[at[free]] = waiting[free]
            self.slots[at[free]] = keys[waiting[free]]
            left = self.place[at] != waiting
            waiting, at = waiting[left], (at[left] + 1) & self.mask

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int32)
        at, waiting = keys & self.mask, np.arange(len(keys))
        while len(waiting):
            place = self.place[at]
            hit = (place >= 0) & (self.slots[at] == keys[waiting])
            out[waiting[hit]] = place[hit]
            on = (place >= 0) & ~hit
            waiting, at = waiting[on], (at[on] + 1) & self.mask
        return out


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def best_class(right: np.ndarray, left: np.ndarray, own: int, own_pairs: int, pairs: np.ndarray) -> int:
    """The class of ``CLASSES`` to which a word is best moved, by the likelihood of the class bigrams.

    ``right`` and ``left`` count the classes after and before the word, ``own_pairs`` the word after
    itself, ``pairs`` all class bigrams. A last class holds the end alone.
    """
    n = len(pairs) - 1
    g = pairs.astype(float)
    r, l = right.astype(float), left.astype(float)
    g[own] -= r
    g[:, own] -= l
    g[own, own] += own_pairs
    r[own] -= own_pairs
    l[own] -= own_pairs
    rows, columns = g.sum(axis=1)[:n] + l[:n], g.sum(axis=0)[:n] + r[:n]
    after, before = _xlogx(g[:n] + r) - _xlogx(g[:n]), _xlogx(g[:, :n].T + l) - _xlogx(g[:, :n].T)
    same = np.arange(n)
    corner = g[same, same]
    gain = after.sum(axis=1) - after[same, same] + before.sum(axis=1) - before[same, same]
    gain += _xlogx(corner + r[:n] + l[:n] + own_pairs) - _xlogx(corner)
    gain -= _xlogx(rows + r.sum() + own_pairs) - _xlogx(rows) + _xlogx(columns + l.sum() + own_pairs) - _xlogx(columns)
    best = int(np.argmax(gain))
    return best if gain[best] > gain[own] + 1e-9 else own


def _top(vocabulary: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, counts) of the most frequent words, ``most`` at most, from how many words have each rounded count."""
    step = F.floor(F.log("n") / F.log(F.lit(1.01)))
    sizes = vocabulary.where(F.col("key") != END).groupBy(step.alias("step")).agg(F.count("*").alias("words")).orderBy(F.desc("step")).collect()
    total, least = 0, None
    for at, n in sizes:
        total += n
        if total > most:
            break
        least = at
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    table = vocabulary.where((F.col("key") != END) & (step >= least)).toArrow()
    keys, n = table["key"].to_numpy(), table["n"].to_numpy()
    order = np.lexsort((keys, -n))
    return keys[order], n[order]


class Model:
    """What tasks get: the shared words' numbers, counts and classes, and the tables of log probabilities.

    ``transition`` is by class, the end's class and that of unknown words last. A class's mass is its
    words' counts with half a word more each. Unknown words are together as frequent as words seen once, from
    whatever class, and each has an even share: there are ``unseen`` of them. After one, classes come by mass. So what may stand
    at a place adds up to one.
    """

    def __init__(self, n_tokens: int, n_words: int, n_ends: int, n_once: int, lookup: Lookup, counts: np.ndarray, classes: np.ndarray, masses: np.ndarray, pairs: np.ndarray, unseen: float = 1.0):
        self.n_tokens, self.n_words, self.n_ends = n_tokens, n_words, n_ends
        self.lookup, self.counts, self.classes = lookup, counts, classes
        self.total = n_tokens + 0.5 * (n_words + 1)
        self.unseen = np.log10(max(1.0, unseen))
        unknown = (n_once + 0.5) / (self.total + n_once)
        share = masses / max(masses.sum(), 1e-300)
        known = np.vstack([(pairs + STRENGTH * share) / (pairs.sum(axis=1, keepdims=True) + STRENGTH), share])
        table = np.hstack([(1 - unknown) * known, np.full((len(known), 1), unknown)])
        self.transition = np.log10(np.maximum(table, 1e-300))
        self.mass = np.log10(np.maximum(np.append(masses, 1.0), 1e-300))

    @property
    def unknown(self) -> int:
        return len(self.mass) - 1


def best_classes(right: np.ndarray, left: np.ndarray, own: np.ndarray, own_pairs: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """``best_class`` of many words, a row for each; what a word doesn't touch isn't computed.

    A word of class -1 has none yet: ``pairs``, ``right`` and ``left`` are without its bigrams with itself.
    """
    n, at, has = len(pairs) - 1, np.arange(len(own)), own >= 0
    p, r, l, s = pairs.astype(float), right.astype(float), left.astype(float), own_pairs.astype(float)
    of = np.where(has, own, 0)
    r_all, l_all, r_own, l_own = r.sum(axis=1), l.sum(axis=1), r[at, of], l[at, of]
    rest_r, rest_l = r.copy(), l.copy()
    rest_r[at, of] -= s * has
    rest_l[at, of] -= s * has
    gain = np.zeros((len(own), n))
    for table, far, near, near_all in ((p, rest_r, l, r), (p.T, rest_l, r, l)):
        word, other = np.nonzero(far)
        g = table[:n, other].T.copy()
        mine = np.flatnonzero(other == own[word])
        g[mine] -= near[word[mine], :n]
        each = np.flatnonzero(has[word])
        g[each, own[word[each]]] -= near_all[word[each], other[each]]
        g[mine, own[word[mine]]] += s[word[mine]]
        change = _xlogx(g + far[word, other][:, None]) - _xlogx(g)
        inner = np.flatnonzero(other < n)
        change[inner, other[inner]] = 0.0
        if len(word):
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            gain[word[starts]] += np.add.reduceat(change, starts, axis=0)
    corner = np.tile(p.diagonal()[:n], (len(own), 1))
    corner[at, of] += (s - r_own - l_own) * has
    gain += _xlogx(corner + rest_r[:, :n] + rest_l[:, :n] + s[:, None]) - _xlogx(corner)
    for sums, near, all_n in ((p.sum(axis=1), rest_l, r_all), (p.sum(axis=0), rest_r, l_all)):
        total = sums[:n] + near[:, :n] * ~has[:, None]
        total[at, of] -= all_n * has
        total_after = total + (all_n + s * ~has)[:, None]
        gain -= _xlogx(total_after) - _xlogx(total)
    best = gain.argmax(axis=1)
    return np.where(has & (gain[at, best] <= gain[at, of] + 1e-9), own, best)


def _starts(*sorted_by: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    if not len(sorted_by[0]):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], np.any([x[1:] != x[:-1] for x in sorted_by], axis=0)]))


def lists(rows: DataFrame, lookup, n_shared: int, n_hot: int, n_parts: int, n_far: int) -> DataFrame:
    """What stands beside each word, from one pass over the texts and one exchange; stored rows of a ``kind``.

    ``NEAR``: shared words beside a shared word. A bigram with one hot word (the ``n_hot`` most frequent,
    and END) is listed under the other word only, one of two hot words under its first, any other under both.
    ``FAR``: shared words beside a word that isn't shared. ``OPEN``: two words in a row that aren't shared.
    A row has whole words (but hot ones, whose lists are dealt to all parts), ``least`` is the first of them.
    ``other`` is twice the place of the word beside, one more if that comes after.
    """
    schema = "part int, kind int, word binary, other binary, n binary"
    out, stored, width = arrow_schema(schema), arrow_schema("kind int, least int, word binary, other binary, n binary"), n_shared + 1

    def is_hot(x: np.ndarray) -> np.ndarray:
        return (x < n_hot) | (x == n_shared)

    def sent(kind: int, part: np.ndarray, word: np.ndarray, other: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((other, word, part))
        part, word, other, n = part[order], word[order], other[order], n[order]
        cuts = np.append(_starts(part), len(part)).tolist()
        made = [_pack(kind, word[x:y], other[x:y], n[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)]
        if made:
            yield as_batch({"part": part[cuts[:-1]], "kind": [kind] * len(made)} | {c: [m[c] for m in made] for c in ("word", "other", "n")}, out)

    def send(near: Sums, beside: list[tuple[np.ndarray, np.ndarray]], pairs: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        keys, n = near.total()
        a, b = keys // width, keys % width
        hot_a, hot_b = is_hot(a), is_hot(b)
        first, second = ~hot_a | hot_b, ~hot_b
        part = np.where(hot_a, a * 31 + b, a)[first] % n_parts
        yield from sent(
            NEAR, np.concatenate([part, b[second] % n_parts]), np.concatenate([a[first], b[second]]),
            np.concatenate([b[first] * 2 + 1, a[second] * 2]), np.concatenate([n[first], n[second]]),
        )
        for kind, held in ((FAR, beside), (OPEN, pairs)):
            if held:
                word, other = (np.concatenate(x) for x in zip(*held, strict=True))
                yield from sent(kind, n_parts + word % n_far, word, other, np.ones(len(word), np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, beside, pairs = Sums(), [], []
        for batch in batches:
            numbers, _ = with_ends([t or b"" for t in batch["text"].to_pylist()])
            place = np.concatenate([[n_shared], np.where(numbers == END, n_shared, lookup.value(numbers))]).astype(np.int64)
            numbers = np.concatenate([[END], numbers])
            a, b = place[:-1], place[1:]
            near.add((a * width + b)[(a >= 0) & (b >= 0)])
            after, before = (a < 0) & (b >= 0), (a >= 0) & (b < 0)
            beside.append((np.concatenate([numbers[:-1][after], numbers[1:][before]]), np.concatenate([b[after] * 2 + 1, a[before] * 2])))
            both = (a < 0) & (b < 0)
            pairs.append((numbers[:-1][both], numbers[1:][both]))
            if near.full() or sum(len(x) for x, _ in beside) + sum(len(x) for x, _ in pairs) > HELD:
                yield from send(near, beside, pairs)
                near, beside, pairs = Sums(), [], []
        yield from send(near, beside, pairs)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds up the lists of the words of a partition; what it holds is no more than their distinct neighbours."""
        held: dict[int, list] = {NEAR: [], FAR: [], OPEN: []}
        last = dict.fromkeys(held, 0)
        for batch in batches:
            for kind, *x in zip(batch["kind"].to_pylist(), *_unpack(batch, OPEN), strict=True):
                held[kind].append(x)
                if sum(len(y[0]) for y in held[kind]) > 2 * last[kind] + HELD:
                    held[kind] = [added(held[kind])]
                    last[kind] = len(held[kind][0][0])
        for kind, parts in held.items():
            if parts:
                word, other, n = added(parts)
                at = 0
                while at < len(word):
                    upto = len(word) if at + PACKED >= len(word) else max(int(np.searchsorted(word, word[at + PACKED], "left")), int(np.searchsorted(word, word[at], "right")))
                    row = _pack(kind, word[at:upto], other[at:upto], n[at:upto])
                    yield as_batch({"kind": [kind], "least": [int(word[at]) if kind == NEAR else None]} | {c: [row[c]] for c in ("word", "other", "n")}, stored)
                    at = upto

    def added(parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        word, other, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((other, word))
        word, other, n = word[order], other[order], n[order]
        at = _starts(word, other)
        return word[at], other[at], np.add.reduceat(n.astype(np.int64), at)

    dealt = rows.mapInArrow(run, schema).repartitionById(n_parts + n_far, F.col("part"))
    return store(dealt.mapInArrow(gather, "kind int, least int, word binary, other binary, n binary"), "kind")


def _pack(kind: int, word: np.ndarray, other: np.ndarray, n: np.ndarray) -> dict[str, bytes]:
    """Words in order as steps, and counts in as few bytes as the largest needs."""
    size = next(s for s in (1, 2, 4, 8) if int(n.max()) < 1 << (8 * s - 1) or s == 8)
    word = np.diff(word.astype(np.int64), prepend=np.int64(0))
    return {"word": word.astype("<i4" if kind == NEAR else "<i8").tobytes(), "other": other.astype("<i8" if kind == OPEN else "<i4").tobytes(), "n": n.astype(f"<i{size}").tobytes()}


def _unpack(batch: pa.RecordBatch, kind: int | None = None) -> tuple[list[np.ndarray], ...]:
    """(words, others, counts) of each row; ``kind`` is that of all rows unless the batch has a column of it."""
    kinds = batch["kind"].to_pylist() if "kind" in batch.schema.names else [kind] * batch.num_rows
    word, other, n = [], [], []
    for k, w, o, m in zip(kinds, *(batch[c].to_pylist() for c in ("word", "other", "n")), strict=True):
        word.append(np.cumsum(np.frombuffer(w, "<i4" if k == NEAR else "<i8"), dtype=np.int64))
        other.append(np.frombuffer(o, "<i8" if k == OPEN else "<i4"))
        n.append(np.frombuffer(m, f"<i{len(m) // max(1, len(word[-1]))}"))
    return word, other, n


def _rows_of(table: DataFrame, kind: int) -> DataFrame:
    return table.where(F.col("kind") == kind).select("word", "other", "n")


class Exchange:
    """Rounds of exchange of the shared words; every pass reads the ``NEAR`` lists once and moves no rows.

    Classes are broadcast, a byte for each shared word. A task holds the whole list of each word that isn't hot, and
    what it meets beside hot words is added up in a table of fixed size, so hot words are decided last, by the driver.
    """

    def __init__(self, near: DataFrame, n_shared: int, n_hot: int):
        self.near, self.n_shared, self.n_hot = near, n_shared, n_hot
        self.context = near.sparkSession.sparkContext

    def pairs(self, classes: np.ndarray, upto: int) -> np.ndarray:
        """Bigrams of the classes, over rows with words before place ``upto``."""
        n_shared, n_hot, width = self.n_shared, self.n_hot, CLASSES + 1
        shared, out = self.context.broadcast(classes), arrow_schema("pair int, n bigint")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            of, total = shared.value, np.zeros(width * width)
            for batch in batches:
                for word, other, n in zip(*_unpack(batch, NEAR), strict=True):
                    after, place = (other & 1).astype(bool), other >> 1
                    own, beside = of[word].astype(np.int16), of[place].astype(np.int16)
                    x = (after | (place < n_hot) | (place == n_shared)) & (own >= 0) & (beside >= 0)
                    total += np.bincount(np.where(after, own * width + beside, beside * width + own)[x], n[x], width * width)
            yield as_batch({"pair": np.arange(width * width), "n": total.astype(np.int64)}, out)

        return _matrix(self._upto(upto).mapInArrow(run, "pair int, n bigint"), shared)

    def _upto(self, place: int) -> DataFrame:
        rows = self.near if place >= self.n_shared else self.near.where((F.col("least") < place) | (F.col("least") == self.n_shared))
        return rows.select("word", "other", "n")

    def change(self, classes: np.ndarray, upto: int, moving, choose) -> np.ndarray:
        """New classes: ``choose(own, counts of each code)`` for the words for which ``moving(word, own)`` holds."""
        n_shared, n_hot, width = self.n_shared, self.n_hot, CLASSES + 1
        shared, out = self.context.broadcast(classes), arrow_schema("slice int, word binary, data binary")
        codes = SELF + 1
        step = -(-max(1, n_hot) // SLICES) * codes

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            of, hot = shared.value, np.zeros(SLICES * step)
            for batch in batches:
                for word, other, n in zip(*_unpack(batch, NEAR), strict=True):
                    after, place = (other & 1).astype(bool), (other >> 1).astype(np.int64)
                    own, beside = of[word].astype(np.int64), of[place].astype(np.int64)
                    code = np.where(after, beside, width + beside)
                    plain = (word >= n_hot) & (word < n_shared)
                    x = plain & (beside >= 0) & moving(word, own)
                    if x.any():
                        at = _starts(word[x])
                        row = np.repeat(np.arange(len(at)), np.diff(np.append(at, int(x.sum()))))
                        counts = np.bincount(row * codes + code[x], n[x], len(at) * codes)
                        twice = np.flatnonzero((word[x] == place[x]) & after[x])
                        counts[row[twice] * codes + SELF] += n[x][twice]
                        words, of_words = word[x][at], own[x][at]
                        new = _in_blocks(choose, of_words, counts.reshape(-1, codes).astype(np.int64))
                        moved = new != of_words
                        if moved.any():
                            yield as_batch({"slice": [SLICES + int(words[0]) % SLICES], "word": [words[moved].astype("<i8").tobytes()], "data": [new[moved].astype("<i8").tobytes()]}, out)
                    x = (own >= 0) & (place < n_hot)  # a hot word beside: this one counts on its other side
                    hot += np.bincount(place[x] * codes + np.where(after, width + own, own)[x], n[x], len(hot))
                    x = (beside >= 0) & (word < n_hot)
                    hot += np.bincount(word[x] * codes + code[x], n[x], len(hot))
                    x &= word == place
                    hot += np.bincount(word[x] * codes + SELF, n[x], len(hot)) if x.any() else 0
            parts = hot.astype("<i8").reshape(SLICES, -1)
            yield as_batch({"slice": np.arange(SLICES), "word": [b""] * SLICES, "data": [p.tobytes() for p in parts]}, out)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for i, word, data in zip(*(batch[c].to_pylist() for c in ("slice", "word", "data")), strict=True):
                    if i < SLICES:
                        sums[i] = sums.get(i, 0) + np.frombuffer(data, "<i8")
                    else:
                        yield as_batch({"slice": [i], "word": [word], "data": [data]}, out)
            yield as_batch({"slice": list(sums), "word": [b""] * len(sums), "data": [s.tobytes() for s in sums.values()]}, out)

        schema = "slice int, word binary, data binary"
        found = self._upto(upto).mapInArrow(run, schema).repartition("slice").mapInArrow(add, schema).collect()
        shared.destroy()
        classes, hot = classes.copy(), np.zeros((SLICES, step), np.int64)
        for i, word, data in found:
            if i < SLICES:
                hot[i] += np.frombuffer(data, "<i8")
            else:
                classes[np.frombuffer(word, "<i8")] = np.frombuffer(data, "<i8")
        own = classes[:n_hot].astype(np.int64)
        x = np.flatnonzero(moving(np.arange(n_hot), own))
        if len(x):
            classes[x] = choose(own[x], hot.reshape(-1, codes)[x])
        return classes


def _in_blocks(choose, own: np.ndarray, counts: np.ndarray) -> np.ndarray:
    step = 1 << 13
    return np.concatenate([choose(own[a : a + step], counts[a : a + step]) for a in range(0, len(own), step)])


def _matrix(found: DataFrame, *shared) -> np.ndarray:
    """(pair, n) of all tasks as a table of class by class."""
    width = CLASSES + 1
    total = np.zeros(width * width, np.int64)
    for row in found.groupBy("pair").agg(F.sum("n")).collect():
        total[row[0]] = row[1]
    for x in shared:
        x.destroy()
    return total.reshape(width, width)


def _likelihood(pairs: np.ndarray) -> float:
    return float(_xlogx(pairs).sum() - _xlogx(pairs.sum(axis=0)).sum() - _xlogx(pairs.sum(axis=1)).sum())


def _best_moves(pairs: np.ndarray, width: int = CLASSES + 1):
    return lambda own, counts: best_classes(counts[:, :width], counts[:, width : 2 * width], own, counts[:, SELF], pairs)


def exchange(near: DataFrame, n_shared: int, n_hot: int, n_core: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(classes of the shared words and END, bigrams of those classes).

    The core words exchange among themselves for a start. The others begin in the class under which their neighbours of
    the core are likeliest. Then all exchange: each round, one half looks for its best class given the classes of all, and moves at once.
    Words of a small corpus may move to and fro, so the classes returned are those of the likeliest bigrams met.
    """
    work, width = Exchange(near, n_shared, n_hot), CLASSES + 1
    classes = np.full(n_shared + 1, -1, np.int8)
    classes[:n_core], classes[n_shared] = np.arange(n_core) % CLASSES, CLASSES

    def rounds_of(classes: np.ndarray, upto: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        best = None
        for turn in range(rounds + 1):
            pairs = work.pairs(classes, upto)
            if best is None or _likelihood(pairs) > best[0]:
                best = _likelihood(pairs), classes, pairs
            if turn < rounds:
                half = turn % 2
                classes = work.change(classes, upto, lambda word, own, half=half: (own >= 0) & ((word // CLASSES + word) % 2 == half), _best_moves(pairs))
        return best[1:]

    classes, pairs = rounds_of(classes, n_core, rounds)
    if n_core < n_shared:
        shares = (pairs.sum(axis=0) + 1) / (pairs.sum() + width)
        follows = np.log((pairs + STRENGTH * shares) / (pairs.sum(axis=1, keepdims=True) + STRENGTH))
        table = np.vstack([follows.T[:, :CLASSES], follows[:, :CLASSES] - np.log(shares[:CLASSES])])
        classes = work.change(classes, n_shared, lambda word, own: own < 0, lambda own, counts: (counts[:, : 2 * width] @ table).argmax(axis=1))
        classes[classes < 0] = 0  # no neighbour in the core
        classes, pairs = rounds_of(classes, n_shared, rounds)
    return classes, pairs


def place_rest(far: DataFrame, classes: np.ndarray, pairs: np.ndarray) -> DataFrame:
    """(word, class, n) for words that aren't shared: each moves to its best class given the shared words' classes.

    Rows of class -1 have in ``word`` a bigram of classes and in ``n`` how often it stands beside these words.
    """
    context, width, out = far.sparkSession.sparkContext, CLASSES + 1, arrow_schema("word bigint, class int, n bigint")
    shared, choose = context.broadcast(classes), _best_moves(pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, total = shared.value, np.zeros(width * width)
        for batch in batches:
            for word, other, n in zip(*_unpack(batch, FAR), strict=True):
                after, beside = (other & 1).astype(bool), of[other >> 1].astype(np.int64)
                at = _starts(word)
                row = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(word))))
                counts = np.bincount(row * (SELF + 1) + np.where(after, beside, width + beside), n, len(at) * (SELF + 1)).reshape(-1, SELF + 1)
                new = _in_blocks(choose, np.full(len(at), -1), counts.astype(np.int64))
                own = new[row]
                total += np.bincount(np.where(after, own * width + beside, beside * width + own), n, width * width)
                yield as_batch({"word": word[at], "class": new, "n": pa.nulls(len(at), pa.int64())}, out)
        yield as_batch({"word": np.arange(width * width), "class": [-1] * width * width, "n": total.astype(np.int64)}, out)

    return store(far.mapInArrow(run, "word bigint, class int, n bigint"))


def _open_pairs(rows: DataFrame) -> DataFrame:
    """(a, b, n) of words in a row that aren't shared."""
    out = arrow_schema("a bigint, b bigint, n bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for word, other, n in zip(*_unpack(batch, OPEN), strict=True):
                yield as_batch({"a": word, "b": other, "n": n.astype(np.int64)}, out)

    return rows.mapInArrow(run, "a bigint, b bigint, n bigint")


def fit(docs: DataFrame, learn: Column | bool = True, text_col: str = "text", shared_words: int = SHARED_WORDS, core_words: int = CORE_WORDS, rounds: int = ROUNDS, hot_words: int = HOT_WORDS) -> tuple[Model, DataFrame]:
    """The model of the rows for which ``learn`` holds, and (key, n, class) of the words that it doesn't hold itself.

    Counts of all words are summed over the corpus. The shared words exchange classes, the core of them first, for a
    start; then each other word moves to its best class. Class bigrams are those of all tokens.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    context = spark.sparkContext
    rows = docs.where(F.lit(learn) if isinstance(learn, bool) else learn).select(named(text_col).cast("binary").alias("text"))
    vocabulary = store(summed(rows, lambda texts: with_ends(texts)[0]))
    n_tokens, n_words = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n_ends = (vocabulary.where(F.col("key") == END).first() or (0, 0))[1]
    keys, counts = _top(vocabulary, shared_words)
    n_shared, n_core, n_hot = len(keys), min(core_words, int((counts >= CORE_COUNT).sum())), min(hot_words, len(keys))
    lookup = Lookup(keys)
    n_rest = n_tokens - n_ends - int(counts.sum())
    parts = [min(MOST_PARTS, 1 + n // PART_TOKENS) for n in (n_tokens, 2 * n_rest)]
    beside = lists(rows, context.broadcast(lookup), n_shared, n_hot, *parts)
    classes, pairs = exchange(beside.where(F.col("kind") == NEAR).select("least", "word", "other", "n"), n_shared, n_hot, n_core, rounds)
    # Counts rank the words, so the shared ones are those from the least shared count up.
    least = int(counts[-1]) if n_shared else None
    rest = vocabulary.where((F.col("key") != END) & (F.col("n") < least if least is not None else F.lit(True)))
    cold = rest.limit(0).withColumn("class", F.lit(0))
    if n_rest:
        placed = place_rest(_rows_of(beside, FAR), classes, pairs)
        pairs = pairs + _matrix(placed.where("class < 0").select(F.col("word").cast("int").alias("pair"), "n"))
        found = placed.where("class >= 0").select(F.col("word").alias("key"), "class")
        cold = store(rest.join(found, "key", "left").withColumn("class", F.coalesce("class", F.lit(0))))
        of = {c: cold.select(F.col("key").alias(c), F.col("class").alias(f"{c}_class")) for c in ("a", "b")}
        pairs = pairs + _matrix(_open_pairs(_rows_of(beside, OPEN)).join(of["a"], "a").join(of["b"], "b").select((F.col("a_class") * (CLASSES + 1) + F.col("b_class")).alias("pair"), "n"))
    masses = np.bincount(classes[:n_shared], counts + 0.5, CLASSES + 1)
    masses[CLASSES] = n_ends + 0.5 if n_words else 0.0
    for row in cold.groupBy("class").agg(F.sum(F.col("n") + 0.5)).collect():
        masses[row[0]] += row[1]
    n_once, n_twice = vocabulary.agg(F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).first()
    # a bound from below for how many words the corpus has yet to show, by those that it shows once and twice
    unseen = n_once * (n_once - 1) / (2 * (n_twice + 1))
    return Model(n_tokens, n_words, n_ends, n_once, lookup, counts, classes[:n_shared], masses, pairs, unseen), cold


SCORED = "doc_id bigint, n_tokens bigint, n_known bigint, base double, score double, open_key array<bigint>, open_class array<int>, open_before array<bigint>, open_next array<int>"


def _score_batch(batch: pa.RecordBatch, model: Model) -> dict[str, object]:
    """Sums over the words whose classes the model has, and for each of the others what is beside it."""
    numbers, stops = with_ends([t or b"" for t in batch["text"].to_pylist()])
    place, is_end = model.lookup(numbers), numbers == END
    known = (place >= 0) | is_end
    n = np.where(is_end, model.n_ends, np.append(model.counts, 0)[place])
    of = np.where(known, np.append(model.classes, 0)[place], -1)
    of[is_end] = CLASSES if model.n_words else model.unknown
    end = CLASSES if model.n_words else model.unknown
    before = np.concatenate([[end], of[:-1]]).astype(np.int64)
    following = np.append(of[1:], end)
    counted = known & (n > 0)
    base = np.where(known, np.log10((n + 0.5) / model.total), 0.0)
    emission = np.where(counted, np.log10(n + 0.5) - model.mass[of], 0.0)
    score = emission + np.where(known & (before >= 0), model.transition[before, of], 0.0)
    starts = np.concatenate([[0], stops[:-1]])
    if not len(stops):
        return {f.name: [] for f in arrow_schema(SCORED)}
    sums = [np.add.reduceat(x, starts) for x in (counted.astype(np.int64), base, score)]
    at = np.flatnonzero(~known)
    offsets = pa.array(np.concatenate([[0], np.searchsorted(at, stops)]), pa.int32())
    beside = {
        "open_key": numbers[at], "open_class": before[at].astype(np.int32), "open_before": np.concatenate([[END], numbers[:-1]])[at], "open_next": following[at].astype(np.int32),
    }
    return {
        "doc_id": batch["doc_id"], "n_tokens": stops - starts, "n_known": sums[0], "base": sums[1], "score": sums[2],
    } | {c: pa.ListArray.from_arrays(offsets, pa.array(v)) for c, v in beside.items()}


def score(docs: DataFrame, model: Model, cold: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score, perplexity) for each row.

    A text's tokens are its words and one end. base_score sums the log10 of (n + 0.5) / (N + 0.5 (V + 1)),
    score the log10 of transition times emission, from an end before the first word. Words that
    the model doesn't hold are looked up in ``cold`` by a join.

    Null texts are empty and have one token, the end. Rows of equal ids, null ones too, each yield a
    row. No rows give no rows; other columns are ignored. Without anything to learn from all words
    are unknown and every score is 0.
    """
    bound_batches(docs.sparkSession)
    shared, out = docs.sparkSession.sparkContext.broadcast(model), arrow_schema(SCORED)
    rows = docs.select(named(id_col).cast("bigint").alias("doc_id"), named(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield as_batch(_score_batch(batch, shared.value), out)

    found = store(rows.mapInArrow(run, SCORED).withColumn("row", F.monotonically_increasing_id()))
    opened = found.select("row", F.explode(F.arrays_zip("open_key", "open_class", "open_before", "open_next")).alias("x")).select(
        "row", F.col("x.open_key").alias("key"), F.col("x.open_class").alias("before_class"), F.col("x.open_before").alias("before"), F.col("x.open_next").alias("next_class")
    )
    unknown = F.lit(model.unknown)
    named_now = opened.join(cold.select("key", "n", "class"), "key", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("class", F.coalesce("class", unknown))
    kept = ["row", "n", "class", "before_class", "next_class"]
    earlier = cold.select(F.col("key").alias("before"), F.col("class").alias("found_class"))
    both = named_now.where("before_class >= 0").select(*kept).unionByName(
        named_now.where("before_class < 0").join(earlier, "before", "left").withColumn("before_class", F.coalesce("found_class", unknown)).select(*kept)
    )
    more_out = arrow_schema("row bigint, known bigint, base double, score double")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            row, n, of, before, following = (batch[c].to_numpy().astype(np.int64) for c in kept)
            base = np.log10((n + 0.5) / own.total)
            value = own.transition[before, of] + np.where(n > 0, np.log10(n + 0.5) - own.mass[of], -own.unseen)
            value += np.where(following >= 0, own.transition[of, following], 0.0)
            yield as_batch({"row": row, "known": (n > 0).astype(np.int64), "base": base, "score": value}, more_out)

    more = both.mapInArrow(add, "row bigint, known bigint, base double, score double").groupBy("row").agg(
        F.sum("known").alias("known"), F.sum("base").alias("more_base"), F.sum("score").alias("more_score")
    )
    zero = F.lit(0)
    return found.select("row", "doc_id", "n_tokens", "n_known", "base", "score").join(more, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("known", zero)).alias("n_known"), (F.col("base") + F.coalesce("more_base", zero)).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", zero)).alias("score"),
    ).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
