"""Byte-level BPE: every merge, in rank order, replayed over all distinct words of a block at once."""

from __future__ import annotations

import base64
import functools
import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemrec.llm.common import arrow_schema, as_batch, bound_batches, named

#: Characters of text whose distinct words one index covers. A longer text is a block of its own.
BLOCK_CHARS = 2 << 20
#: Rank of a pair that no merge applies to.
NEVER = np.iinfo(np.int32).max


@functools.cache
def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 bytes and rank on each line."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


@functools.cache
def _pattern(text: str) -> regex.Pattern:
    return regex.compile(text)


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """One word by itself: the adjacent pair of least rank, the first of them, is merged until none is left."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        rank, i = min((ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if rank == NEVER:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


class Merges:
    """A vocabulary and, for each two tokens that make a third, its rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.width = ranks, max(ranks.values()) + 1
        self.tokens = [b""] * self.width
        for token, rank in ranks.items():
            self.tokens[rank] = token
        found = np.array([
            (ranks[a] * self.width + ranks[b], rank)
            for token, rank in ranks.items() for i in range(1, len(token)) if (a := token[:i]) in ranks and (b := token[i:]) in ranks
        ], np.int64).reshape(-1, 2)
        found = found[found[:, 0].argsort()]
        self.keys, self.made = found[:, 0].copy(), found[:, 1].astype(np.int32)
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.of_bytes = self.rank_of(np.repeat(self.byte, 256), np.tile(self.byte, 256)).reshape(256, 256)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge of each two tokens, or NEVER."""
        key = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], np.int32(NEVER))


@functools.cache
def merges(path: str) -> Merges:
    return Merges(load_ranks(path))


def replay(words: list[bytes], table: Merges) -> list[np.ndarray]:
    """The ids of each word.

    The words lie end to end and each byte is a place. A place holds a token or, once merged into
    the one before, none; ``after`` and ``before`` lead to its neighbours in the word. ``index`` has
    the places of the pairs that each merge applies to. Merges are taken by rank and applied to all
    their places; that changes the pairs with the two neighbours only, which go to the index. If one
    of those has a lesser rank than the merge, so that it would come before the word's next place,
    the word is encoded by itself.
    """
    if not words:
        return []
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    text = np.frombuffer(b"".join(words), np.uint8)
    token, size = table.byte[text], len(text)
    after, before = np.arange(1, size + 1), np.arange(-1, size - 1)
    after[ends - 1] = -1
    before[0] = -1
    before[ends[:-1]] = -1
    rank = np.full(size, NEVER, np.int32)
    inner = np.flatnonzero(after >= 0)
    rank[inner] = table.of_bytes[text[inner], text[inner + 1]]
    apart: set[int] = set()
    index: dict[int, list[np.ndarray]] = defaultdict(list)
    queue: list[int] = []

    def enter(places: np.ndarray) -> None:
        """Put places into the index under the ranks of their pairs."""
        ranks = rank[places]
        order = np.argsort(ranks, kind="stable")
        places, ranks = places[order], ranks[order]
        cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(places)]
        firsts = ranks[cuts[:-1]].tolist()
        for a, b, r in zip(cuts, cuts[1:], firsts, strict=False):
            if r not in index:
                heapq.heappush(queue, r)
            index[r].append(places[a:b])

    there = np.flatnonzero(rank < NEVER)
    if len(there):
        enter(there)
    while queue:
        now = heapq.heappop(queue)
        listed = index.pop(now)
        at = np.unique(np.concatenate(listed)) if len(listed) > 1 else listed[0]
        at = at[rank[at] == now]
        if len(at) > 1 and (after[at[:-1]] == at[1:]).any():  # as in "aaa": the first of two that overlap goes first
            free, last = [], -1
            for i, j in zip(at.tolist(), after[at].tolist(), strict=True):
                if i != last:
                    free.append(i)
                    last = j
            at = np.array(free)
        if not len(at):
            continue
        gone = after[at]
        beyond = after[gone]
        right = beyond >= 0
        follows = token[beyond[right]]
        token[at] = now
        after[at] = beyond
        rank[gone] = NEVER
        before[beyond[right]] = at[right]
        rank[at] = NEVER
        left = before[at]
        left = left[left >= 0]
        rank[at[right]] = table.rank_of(token[at[right]], token[beyond[right]])
        rank[left] = table.rank_of(token[left], token[after[left]])
        merged_too = token[beyond[right]] != follows  # the word's next place, which would have come after this one
        if merged_too.any():
            sooner = table.rank_of(token[at[right][merged_too]], follows[merged_too]) < now
            apart.update(np.searchsorted(ends, at[right][merged_too][sooner], side="right").tolist())
        touched = np.concatenate([at[right], left])
        touched = touched[rank[touched] < NEVER]
        if len(touched):
            early = touched[rank[touched] < now]
            if len(early):
                apart.update(np.searchsorted(ends, early, side="right").tolist())
            enter(touched)
    heads = np.concatenate([[0], ends[:-1]])
    alive = np.zeros(size, bool)
    front = heads[ends > heads]
    while len(front):
        alive[front] = True
        front = after[front]
        front = front[front >= 0]
    bounds = np.concatenate([[0], np.cumsum(alive)])
    ids = token[alive].astype("<u4")
    cut = [ids[a:b] for a, b in zip(bounds[heads].tolist(), bounds[ends].tolist(), strict=True)]
    for w in apart:
        cut[w] = np.array(merge_word(words[w], table.ranks), "<u4")
    return cut


def encode_block(texts: list[str], pattern: str, table: Merges) -> list[bytes]:
    """The ids of each text, as little-endian unsigned 32-bit integers.

    A match may start with one space and has no other, so where a space stands alone, what the
    pattern matches on either side of it depends on that side. Texts are cut there and each
    distinct part is matched once. Texts with other white space beside a space are matched whole.
    """
    find = _pattern(pattern).findall
    parts = {p for t in texts for p in t.split(" ")}
    odd = {p for p in parts if not p or p[0].isspace() or p[-1].isspace()}
    matched = {p: find(" " + p) for p in parts - odd}
    alone = [t for t in texts if odd and not odd.isdisjoint(t.split(" "))]
    firsts = {t.partition(" ")[0] for t in texts} - odd
    whole = {t: find(t) for t in {*firsts, *alone}}
    words = list({w for ws in (*matched.values(), *whole.values()) for w in ws})
    raw = [w.encode() for w in words]
    known = [table.ranks.get(w) for w in raw]
    rest = iter(replay([w for w, r in zip(raw, known, strict=True) if r is None], table))
    of_word = {w: (next(rest).tobytes() if r is None else r.to_bytes(4, "little")) for w, r in zip(words, known, strict=True)}
    of_part = {p: of_word[ws[0]] if len(ws) == 1 else b"".join([of_word[w] for w in ws]) for p, ws in matched.items()}
    of_whole = {t: b"".join([of_word[w] for w in ws]) for t, ws in whole.items()}
    out = []
    for text in texts:
        if text in of_whole:
            out.append(of_whole[text])
        else:
            first, *others = text.split(" ")
            out.append(b"".join([of_whole[first], *map(of_part.__getitem__, others)]))
    return out


def decode(ids: bytes, table: Merges) -> bytes:
    return b"".join(map(table.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) for each row: the ids as little-endian unsigned 32-bit integers, and the bytes they stand for.

    The text is split into words by ``pattern``, whose only tie across single spaces is that a match
    may start with one. A task takes its texts in blocks of ``block_chars`` and replays the merges
    over the distinct words of a block, so each merge is looked for once a block and not once a
    word. Null and empty texts have no tokens. Repeated rows and ids, null ids too, each yield a row.
    No rows give no rows; other columns are ignored. Special tokens are ordinary text.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(named(id_col).cast("bigint").alias("doc_id"), F.coalesce(named(text_col).cast("string"), F.lit("")).alias("text"))
    schema = "doc_id bigint, n_tokens bigint, ids binary, decoded binary"
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, waiting, size = merges(ranks_path), [], 0

        def done() -> Iterator[pa.RecordBatch]:
            coded = encode_block([t for _, t in waiting], pattern, table)
            for a in range(0, len(coded), 1_000):
                part = coded[a : a + 1_000]
                yield as_batch({
                    "doc_id": [i for i, _ in waiting[a : a + 1_000]], "n_tokens": [len(x) // 4 for x in part], "ids": part, "decoded": [decode(x, table) for x in part],
                }, out)

        for batch in batches:
            for row in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                waiting.append(row)
                if (size := size + len(row[1])) >= block_chars:
                    yield from done()
                    waiting, size = [], 0
        yield from done()

    return rows.mapInArrow(run, schema)


def digests(encoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
