"""Exact Jaccard join of shingle sets by set relations, and the components that its links make.

An inverted index lists, for each token, the sets that have it in their prefix. Lists are read in
blocks of equal set size and position, and a block that can't reach the overlap is skipped whole.

Sets that are highly similar make a family: each is known by the tokens in which it differs from
the set that leads it. Which sets of a family link follows from those differences alone, and answers of a set
to sets of other families follow from its leader's. So a family of near copies needs neither its pairs nor its texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemrec.llm.common import arrow_schema, as_batch, bound_batches, hash_pair, join_frequent, map_batches, named
from itemrec.llm.components import components
from itemrec.runtime import store

SHINGLE = 5
#: Two sets link if their intersection has this share of their union: NUMERATOR / DENOMINATOR.
NUMERATOR, DENOMINATOR = 80, 100
#: The sketch of token counts has a fixed size: 2 ** SKETCH_BITS counters, sent in CHUNKS parts.
SKETCH_BITS, CHUNKS = 22, 64
#: Rounds in which sets join the families that lead their lists; what stays apart is compared as sets of different families.
ROUNDS = 3
#: Bytes of the mark by which sets are judged worth a look as one family, and the share of them that must agree.
MARK, AGREE = 32, 0.4
#: Postings of one list, or sets compared with one set, that a task takes at a time.
LIST_PART = 4_096
#: Rows of a broadcast table of sets to be made again and where they go.
BROADCAST_ROWS = 200_000


def least_overlap(n: np.ndarray | int, m: np.ndarray | int) -> np.ndarray | int:
    """The intersection that sets of sizes ``n`` and ``m`` need to link."""
    return -(-NUMERATOR * (n + m) // (NUMERATOR + DENOMINATOR))


def prefix_length(n: int) -> int:
    """Any set that links with one of ``n`` tokens shares one of its first tokens, this many, in any common order."""
    return n - -(-NUMERATOR * n // DENOMINATOR) + 1 if n else 0


def shingle_set(text: bytes, width: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of ``width`` words; shorter texts are one shingle, blank ones none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh3_64_intdigest(line)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    shingles = map(line.__getitem__, map(slice, [0, *ends[:-width].tolist()], (ends - 1)[width - 1 :].tolist()))
    return np.unique(np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, shingles)), ">u8").astype(np.uint64))


def mark_of(tokens: np.ndarray) -> bytes:
    """A byte of the least token in each of ``MARK`` equal ranges of the hash, 0 for none: sets agree in about the share of tokens they share."""
    edges = np.arange(MARK, dtype=np.uint64) << np.uint64(64 - (MARK.bit_length() - 1))
    at = np.searchsorted(tokens, edges)
    inside = at < len(tokens)
    least = tokens[np.minimum(at, max(0, len(tokens) - 1))] if len(tokens) else np.zeros(MARK, np.uint64)
    inside &= np.searchsorted(edges, least, side="right") == np.arange(1, MARK + 1)
    return np.where(inside, (least & np.uint64(0xFF)) | np.uint64(1), np.uint64(0)).astype(np.uint8).tobytes()


def _place(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _sum_chunks(rows: DataFrame, *keys: str) -> DataFrame:
    """Adds up packed counters by ``keys`` (chunk first), one row in memory at a time."""
    schema = ", ".join(f"{k} int" for k in keys) + ", counts binary"
    out, size = arrow_schema(schema), (1 << SKETCH_BITS) // CHUNKS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for *key, counts in zip(*[batch[c].to_pylist() for c in (*keys, "counts")], strict=True):
                held = sums.setdefault(tuple(key), np.zeros(size, np.int64))
                held += np.frombuffer(pa.decompress(counts, decompressed_size=8 * size, codec="zstd", asbytes=True), np.int64)
        for key, held in sums.items():
            yield as_batch({k: [v] for k, v in zip(keys, key, strict=True)} | {"counts": [pa.compress(held.tobytes(), codec="zstd", asbytes=True)]}, out)

    return rows.repartition(*keys).mapInArrow(run, schema)


def token_sketch(docs: DataFrame, width: int) -> np.ndarray:
    """How many texts of (text) have a token of each hash prefix: counters of all tokens, whatever their number.

    It only sets the order of tokens, rare ones first, and any order gives the same links. So tokens
    may share a counter, and the table sent to the tasks never grows.
    """
    schema, size = "chunk int, part int, counts binary", (1 << SKETCH_BITS) // CHUNKS
    out = arrow_schema(schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for t in batch["text"].to_pylist():
                sums[_place(shingle_set(t or b"", width))] += 1
        part = TaskContext.get().partitionId() % 64
        for i in range(CHUNKS):
            held = sums[i * size : (i + 1) * size]
            if held.any():
                yield as_batch({"chunk": [i], "part": [part], "counts": [pa.compress(held.tobytes(), codec="zstd", asbytes=True)]}, out)

    bound_batches(docs.sparkSession)
    found = np.zeros((CHUNKS, size), np.uint32)
    for row in _sum_chunks(_sum_chunks(docs.select("text").mapInArrow(count, schema), "chunk", "part"), "chunk").collect():
        counts = np.frombuffer(pa.decompress(bytes(row.counts), decompressed_size=8 * size, codec="zstd", asbytes=True), np.int64)
        found[row.chunk] = np.minimum(counts, 0xFFFFFFFF)
    return found.ravel()


def describe(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, h1, h2, n, s1, s2, mark, prefix) for rows (doc_id, text, h1, h2): a set's size, signature, mark and first tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(token_sketch(docs, width))

    def sets(batch: pa.RecordBatch) -> dict[str, object]:
        sketch, n, signed, marks, prefixes = shared.value, [], [], [], []
        for t in batch["text"].to_pylist():
            tokens = shingle_set(t or b"", width)
            n.append(len(tokens))
            signed.append(xxhash.xxh3_128_digest(tokens.tobytes()))
            marks.append(mark_of(tokens))
            order = np.lexsort((tokens, sketch[_place(tokens)]))[: prefix_length(len(tokens))]
            prefixes.append(tokens[order].view(np.int64))
        signs = np.frombuffer(b"".join(signed), np.int64).reshape(-1, 2)
        return {c: batch[c] for c in ("doc_id", "h1", "h2")} | {"n": n, "s1": signs[:, 0], "s2": signs[:, 1], "mark": marks, "prefix": prefixes}

    return store(map_batches(docs, sets, "doc_id bigint, h1 bigint, h2 bigint, n bigint, s1 bigint, s2 bigint, mark binary, prefix array<bigint>"))


def _sent(docs: DataFrame, classes: DataFrame, dests: DataFrame, width: int) -> DataFrame:
    """``dests`` (id, z, part, x, kind) with the tokens of class ``id``, made again from the text of one of its rows.

    If the table of destinations is small, it goes to the texts, and tokens are moved once; else they are
    joined by shuffle. A class may be made from several equal rows, which does no harm to who reads them.
    """
    dests = store(dests)
    wanted = store(classes.join(dests.select("id").distinct(), "id", "left_semi").select("id", *[F.col(f"rep.{c}").alias(f"rep_{c}") for c in ("doc_id", "h1", "h2")]))
    small = dests.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    same = (F.col("h1") == F.col("rep_h1")) & (F.col("h2") == F.col("rep_h2")) & F.col("doc_id").eqNullSafe(F.col("rep_doc_id"))
    found = docs.join(F.broadcast(wanted) if small else wanted, same).select("id", "text")
    made = map_batches(found, lambda b: {"id": b["id"], "tokens": [shingle_set(t or b"", width).tobytes() for t in b["text"].to_pylist()]}, "id bigint, tokens binary")
    if small:
        return made.join(F.broadcast(dests), "id")
    return dests.join(made.groupBy("id").agg(F.first("tokens").alias("tokens")), "id")


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.intersect1d(a, b, assume_unique=True)


def compare(pairs: DataFrame, sent, relate: bool = False) -> DataFrame:
    """The links among ``pairs`` (z, x, y, minus, plus): (z, y, overlap, size, minus, plus).

    Set y is x without the tokens ``minus`` and with ``plus``; its overlap with z follows from that of x
    with z, counted once, and from those tokens. With ``relate``, y is x itself, and pairs are returned that differ in at most
    half of their tokens, with what y lacks and has beside z (of ``size``). A set z with many partners is dealt to several tasks.
    ``sent`` gives destinations their tokens, see ``_sent``.
    """
    parts = pairs.groupBy("z").agg(F.ceil(F.count("*") / LIST_PART).alias("parts"))
    salted = pairs.join(parts, "z").withColumn("part", F.pmod(F.xxhash64("y"), F.col("parts")))
    salted = store(salted.select("z", "part", "x", "y", "minus", "plus"))
    all_parts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))
    heads = parts.select(F.col("z").alias("id"), "z", all_parts.alias("part"), F.lit(-1).cast("bigint").alias("x"), F.lit(0).alias("kind"))
    bases = salted.select(F.col("x").alias("id"), "z", "part", "x", F.lit(1).alias("kind")).distinct()
    whole_sets = sent(heads.unionByName(bases)).select("z", "part", "x", "kind", F.lit(-1).cast("bigint").alias("y"), F.col("tokens").alias("minus"), F.lit(None).cast("binary").alias("plus"))
    rows = whole_sets.unionByName(salted.select("z", "part", "x", F.lit(2).alias("kind"), "y", "minus", "plus"))
    schema = "z bigint, y bigint, overlap bigint, size bigint, minus binary, plus binary"
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = base = np.zeros(0, np.uint64)
        met = 0
        for batch in batches:
            found: dict[str, list] = {c: [] for c in out.names}
            for z, kind, y, minus, plus in zip(*[batch[c].to_pylist() for c in ("z", "kind", "y", "minus", "plus")], strict=True):
                if kind == 0:
                    whole = np.frombuffer(minus, np.uint64)
                elif kind == 1:
                    base = np.frombuffer(minus, np.uint64)
                    met = len(_shared(base, whole))
                else:
                    gone, new = (np.frombuffer(v or b"", np.uint64) for v in (minus, plus))
                    overlap = met - len(_shared(gone, whole)) + len(_shared(new, whole))
                    size = len(base) - len(gone) + len(new)
                    lacks = has = None
                    if relate:
                        lacks, has = np.setdiff1d(whole, base, assume_unique=True), np.setdiff1d(base, whole, assume_unique=True)
                        if 2 * (len(lacks) + len(has)) > size + len(whole):
                            continue
                        lacks, has = lacks.tobytes(), has.tobytes()
                    elif overlap < least_overlap(size, len(whole)):
                        continue
                    for c, v in zip(out.names, (z, y, overlap, len(whole), lacks, has), strict=True):
                        found[c].append(v)
            yield as_batch(found, out)

    bound_batches(pairs.sparkSession)
    return store(rows.repartition("z", "part").sortWithinPartitions("z", "part", "x", "kind", "y").mapInArrow(run, schema))


def _pairs_of_list(held: list[list[int]]) -> Iterator[tuple[list[int], list[int]]]:
    """Pairs of (id, size, position) that the postings (id, size, position, root, side) of one list leave possible.

    Postings come by size and position, and are taken in blocks of which both are equal. A pair of blocks is skipped
    if the smaller size can't reach the overlap, or if this token and all that follow it in both sets can't. Sets of one
    family are no pair, nor are sets on one side where two parts of a list meet.
    """
    starts = [i for i in range(len(held)) if not i or held[i][1:3] != held[i - 1][1:3]] + [len(held)]
    for b, (i0, i1) in enumerate(zip(starts, starts[1:], strict=False)):
        _, n, at, _, _ = held[i0]
        for j0, j1 in zip(starts[b:], starts[b + 1 :], strict=False):
            _, m, to, _, _ = held[j0]
            need = least_overlap(n, m)
            if n < need:
                break  # sizes only grow from here on
            if min(n - at, m - to) < need:
                continue
            for i in range(i0, i1):
                x, _, _, root, side = held[i]
                for j in range(max(j0, i + 1), j1):
                    y, _, _, other, facing = held[j]
                    if root != other and (side < 0 or side != facing):
                        yield (x, n, at), (y, m, to)


def candidates(lists: DataFrame) -> DataFrame:
    """(a, b) of different families that the postings (token, id, n, pos, root, n_list) leave possible; ``root`` is the family.

    Every common token of two prefixes is met up to the first that comes too late to matter, so what they share is at most
    that number and what follows the last. A list longer than ``LIST_PART`` is cut into parts by id, and each two parts meet apart.
    """
    parts = F.ceil(F.col("n_list") / LIST_PART)
    own = lists.withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")))
    dealt = own.withColumn("with", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    dealt = dealt.select("token", F.least("own", "with").alias("p"), F.greatest("own", "with").alias("q"), "id", "n", "pos", "root", F.when(F.col("own") == F.col("with"), -1).otherwise(F.col("own")).alias("side"))
    schema = "a bigint, b bigint, n_a bigint, n_b bigint, pos_a int, pos_b int"
    out = arrow_schema(schema)
    names = ("token", "p", "q", "id", "n", "pos", "root", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, waiting = None, [], {c: [] for c in out.names}

        def take() -> None:
            """Add the pairs of the list that has ended."""
            for (x, n, at), (y, m, to) in _pairs_of_list(held):
                for c, v in zip(out.names, (x, y, n, m, at, to) if x < y else (y, x, m, n, to, at), strict=True):
                    waiting[c].append(v)

        for batch in batches:
            for token, p, q, *posting in zip(*[batch[c].to_pylist() for c in names], strict=True):
                if (token, p, q) != key:
                    take()
                    key, held = (token, p, q), []
                    if len(waiting["a"]) > 50_000:
                        yield as_batch(waiting, out)
                        waiting = {c: [] for c in out.names}
                held.append(posting)
        take()
        yield as_batch(waiting, out)

    bound_batches(lists.sparkSession)
    met = dealt.repartition("token", "p", "q").sortWithinPartitions("token", "p", "q", "n", "pos", "id").mapInArrow(run, schema)
    sums = met.groupBy("a", "b", "n_a", "n_b").agg(F.count("*").alias("n_met"), F.max("pos_a").alias("last_a"), F.max("pos_b").alias("last_b"))
    most = F.col("n_met") + F.least(F.col("n_a") - F.col("last_a"), F.col("n_b") - F.col("last_b")) - 1
    return sums.where((NUMERATOR + DENOMINATOR) * most >= NUMERATOR * (F.col("n_a") + F.col("n_b"))).select("a", "b")


def _apart(minus: bytes | None, plus: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(minus or b"", np.uint64), np.frombuffer(plus or b"", np.uint64)


def moved(first: tuple[np.ndarray, np.ndarray], then: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """In what a set differs from x, if it differs from z by ``then`` and z from x by ``first``: (lacks, has)."""
    (m, p), (n, q) = first, then
    lacks = np.union1d(np.setdiff1d(m, q, assume_unique=True), np.setdiff1d(n, p, assume_unique=True))
    return lacks, np.union1d(np.setdiff1d(p, n, assume_unique=True), np.setdiff1d(q, m, assume_unique=True))


RELATIONS = "id bigint, lead bigint, lead_n bigint, minus binary, plus binary"


def alike(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The ``pairs`` (x, z) whose marks agree: a guess that only says which sets are looked at as families."""
    side = lambda c: classes.select(F.col("id").alias(c), F.col("mark").alias(f"mark_{c}"))

    def agree(batch: pa.RecordBatch) -> dict[str, object]:
        a, b = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint8).reshape(-1, MARK) for c in ("mark_x", "mark_z"))
        shared, filled = ((a == b) & (a > 0)).sum(axis=1), ((a > 0) | (b > 0)).sum(axis=1)
        near = pa.array(shared >= AGREE * filled)
        return {c: batch[c].filter(near) for c in ("x", "z")}

    return map_batches(pairs.join(side("x"), "x").join(side("z"), "z"), agree, "x bigint, z bigint")


def families(live: DataFrame, docs: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """``RELATIONS``: the set that leads each related set, and in what they differ.

    In a round, each family goes to the first family of most of its lists if their leading sets are close, and
    its members' differences follow from its leader's. A family that others come to stays where it is.
    """
    related = live.sparkSession.createDataFrame([], RELATIONS)
    for turn in range(ROUNDS):
        lists = live.select("token", F.col("id").alias("f"), F.col("n").alias("f_n"))
        if turn:
            by = related.select(F.col("id").alias("f"), "lead", "lead_n")
            lists = store(lists.join(by, "f", "left").select("token", F.coalesce("lead", "f").alias("f"), F.coalesce("lead_n", "f_n").alias("f_n")).distinct())
        first = lists.groupBy("token").agg(F.min("f").alias("z"), F.count("*").alias("n")).where("n > 1").select("token", "z")
        met = lists.join(first, "token").where("f <> z").groupBy(F.col("f").alias("x"), "f_n", "z").agg(F.count("*").alias("n_met"))
        length = F.col("f_n") - F.ceil(NUMERATOR * F.col("f_n") / DENOMINATOR) + 1
        pairs = met.where(4 * F.col("n_met") >= length).groupBy("x").agg(F.max_by("z", F.struct("n_met", "z")).alias("z"))
        none = F.lit(None).cast("binary")
        pairs = store(alike(pairs.select("x", "z"), classes).select("z", "x", F.col("x").alias("y"), none.alias("minus"), none.alias("plus")))
        if pairs.isEmpty():
            break
        close = compare(pairs, lambda dests: _sent(docs, classes, dests, width), relate=True)
        close = close.join(close.select(F.col("y").alias("z")), "z", "left_anti").select(F.col("y").alias("x"), F.col("z").alias("to"), F.col("size").alias("to_n"), F.col("minus").alias("m"), F.col("plus").alias("p"))
        if close.isEmpty():
            break

        def follow(batch: pa.RecordBatch) -> dict[str, object]:
            rows = zip(*[batch[c].to_pylist() for c in ("m", "p", "minus", "plus")], strict=True)
            apart = [moved(_apart(m, p), _apart(n, q)) for m, p, n, q in rows]
            return {"id": batch["id"], "lead": batch["to"], "lead_n": batch["to_n"], "minus": [a.tobytes() for a, _ in apart], "plus": [b.tobytes() for _, b in apart]}

        brought = map_batches(related.join(close, F.col("lead") == F.col("x")), follow, RELATIONS)
        stayed = related.join(close.select(F.col("x").alias("lead")), "lead", "left_anti").select(*related.columns)
        led = close.select(F.col("x").alias("id"), F.col("to").alias("lead"), F.col("to_n").alias("lead_n"), F.col("m").alias("minus"), F.col("p").alias("plus"))
        related = store(stayed.unionByName(brought).unionByName(led))
    return related


def family_links(related: DataFrame) -> DataFrame:
    """Links (a, b) that connect what all links within the families connect, from differences alone.

    Let X be the tokens that most of a family have, and let a set that lacks m of them and has p others cost 100 m + 80 p. Two
    sets whose differences from X have s tokens in common link if and only if their costs, less 180 s, are at most 20 |X|.
    Where s is 0, the set of least cost links with both. So that one's links stand for all of these, and other pairs
    meet in lists of the tokens that differ.
    """
    diffs = related.select("id", "lead", "lead_n", "minus", "plus").unionByName(
        related.select("lead", "lead_n").distinct().select(F.col("lead").alias("id"), "lead", "lead_n", F.lit(None).cast("binary").alias("minus"), F.lit(None).cast("binary").alias("plus"))
    )
    as_lists = lambda b: {c: b[c] for c in ("id", "lead", "lead_n")} | {c: [_apart(v, None)[0].view(np.int64) for v in b[c].to_pylist()] for c in ("minus", "plus")}
    listed = store(map_batches(diffs, as_lists, "id bigint, lead bigint, lead_n bigint, minus array<bigint>, plus array<bigint>"))
    sizes = listed.groupBy("lead").agg(F.count("*").alias("members"))
    tokens = listed.select("lead", F.explode("minus").alias("token"), F.lit(True).alias("gone")).unionByName(listed.select("lead", F.explode("plus").alias("token"), F.lit(False).alias("gone")))
    most = tokens.groupBy("lead", "gone", "token").agg(F.count("*").alias("n")).join(sizes, "lead").where(2 * F.col("n") > F.col("members"))
    common = most.groupBy("lead").agg(*[F.collect_list(F.when(F.col("gone") == g, F.col("token"))).alias(c) for g, c in ((True, "drop"), (False, "add"))])
    none = F.array().cast("array<bigint>")
    whole = listed.join(common, "lead", "left").withColumns({c: F.coalesce(c, none) for c in ("drop", "add")})
    lacks = F.array_union(F.array_except("minus", "drop"), F.array_except("add", "plus"))
    has = F.array_union(F.array_except("plus", "add"), F.array_except("drop", "minus"))
    members = whole.select("id", "lead", lacks.alias("lacks"), has.alias("has"), ((DENOMINATOR - NUMERATOR) * (F.col("lead_n") - F.size("drop") + F.size("add"))).alias("budget"))
    members = store(members.select("id", "lead", "budget", (DENOMINATOR * F.size("lacks") + NUMERATOR * F.size("has")).cast("bigint").alias("cost"), F.concat("lacks", "has").alias("apart")))
    least = members.groupBy("lead").agg(F.min(F.struct("cost", "id")).alias("least"))
    placed = store(members.join(least, "lead").select("id", "lead", "budget", "cost", "apart", F.col("least.id").alias("first"), (F.col("cost") + F.col("least.cost") <= F.col("budget")).alias("core")))
    star = placed.where("core and id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"))
    mixed = placed.where("not core").select("lead").distinct()
    tokens = placed.join(mixed, "lead", "left_semi").select("lead", "id", F.explode("apart").alias("token"))
    counts = tokens.groupBy("lead", "token").agg(F.count("*").alias("n"))
    ordered = tokens.join(counts, ["lead", "token"]).groupBy("lead", "id").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("order"))
    listed = placed.select("lead", "id", "budget", "cost", "core").join(ordered, ["lead", "id"])
    rows = store(listed.select("lead", "id", "budget", "cost", "core", F.size("order").alias("size"), F.posexplode("order").alias("pos", "x")).where("x.n > 1").select("*", "x.token").drop("x"))
    other = rows.select("lead", "token", *[F.col(c).alias(f"{c}_b") for c in ("id", "cost", "core", "size", "pos")])
    both = rows.join(other, ["lead", "token"]).where("id < id_b and not (core and core_b)")
    most = lambda met: (NUMERATOR + DENOMINATOR) * (met + F.least(F.col("size") - F.col("pos"), F.col("size_b") - F.col("pos_b")) - 1)
    # differences come rarest first: pairs that meet too late in them can't have enough in common
    met = both.where(most(F.lit(1)) >= F.col("cost") + F.col("cost_b") - F.col("budget"))
    pairs = met.groupBy("id", "id_b", "cost", "cost_b", "budget", "size", "size_b").agg(F.count("*").alias("n_met"), F.max("pos").alias("pos"), F.max("pos_b").alias("pos_b"))
    pairs = pairs.where(most(F.col("n_met")) >= F.col("cost") + F.col("cost_b") - F.col("budget")).select(F.col("id").alias("a"), F.col("id_b").alias("b"), "cost", "cost_b", "budget")
    apart = lambda side: placed.select(F.col("id").alias(side), F.col("apart").alias(f"apart_{side}"))
    shared = store(pairs).join(apart("a"), "a").join(apart("b"), "b").withColumn("s", F.size(F.array_intersect("apart_a", "apart_b")))
    return star.unionByName(shared.where(F.col("cost") + F.col("cost_b") - (NUMERATOR + DENOMINATOR) * F.col("s") <= F.col("budget")).select("a", "b"))


def links(docs: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """Links (a, b) among ``classes`` (id, n, prefix, rep) that connect what all links connect."""
    postings = classes.select("id", "n", F.posexplode("prefix").alias("pos", "token"))
    total = classes.agg(F.sum(F.size("prefix"))).first()[0] or 0
    several = postings.groupBy("token").agg(F.count("*").alias("n_list")).where("n_list > 1")
    live = store(join_frequent(postings, several, ["token"], "n_list", total))
    related = families(live, docs, classes, width)
    lists = live.join(related.select("id", "lead"), "id", "left").withColumn("root", F.coalesce("lead", "id")).drop("lead")
    mixed = lists.select("token", "root").distinct().groupBy("token").count().where("count > 1").select("token")
    pairs = store(candidates(lists.join(mixed, "token", "left_semi")))
    known = related.select(F.col("id").alias("b"), F.lit(True).alias("known"))
    turned = pairs.join(known, "b", "left").select(F.when(F.col("known"), F.col("b")).otherwise(F.col("a")).alias("y"), F.when(F.col("known"), F.col("a")).otherwise(F.col("b")).alias("z"))
    relations = related.select(F.col("id").alias("y"), F.col("lead").alias("x"), "minus", "plus")
    asked = store(turned.join(relations, "y", "left").select("z", F.coalesce("x", "y").alias("x"), "y", "minus", "plus"))
    found = compare(asked, lambda dests: _sent(docs, classes, dests, width))
    return family_links(related).unionByName(found.select(F.col("z").alias("a"), F.col("y").alias("b")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row: the size of its shingle set, and the smallest id that links lead to.

    A set is the distinct shingles of ``width`` words in lower case (ASCII); a text of fewer words is one shingle. Two
    sets link if 80 of 100 tokens of their union are in both. Tokens are compared by 64 bits of hash.

    Null, empty and blank texts have no shingles, link with nothing and are components of their own.
    Equal sets are one class, linked to its id whatever the number of copies. Repeated rows each yield a
    row. Null ids are members, but don't count for the smallest id unless a component has no other. No rows give no
    rows; other columns are ignored.
    """
    rows = docs.select(
        named(id_col).cast("bigint").alias("doc_id"), named(text_col).cast("binary").alias("text"),
        *[h.alias(n) for h, n in zip(hash_pair(F.coalesce(named(text_col), F.lit(""))), ("h1", "h2"), strict=True)],
    )
    held = describe(rows, width)
    classes = store(
        held.where("n > 0").groupBy("s1", "s2")
        .agg(F.first("n").alias("n"), F.first("mark").alias("mark"), F.first("prefix").alias("prefix"), F.min("doc_id").alias("least"), F.count("*").alias("n_rows"), F.min(F.struct("doc_id", "h1", "h2")).alias("rep"))
        .withColumn("id", F.monotonically_increasing_id())
    )
    linked = components(links(rows, classes, width))
    rooted = classes.select("id", "s1", "s2", "least", "n_rows").join(linked.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    table = rooted.join(smallest, "root").select("s1", "s2", "component_id", "n_rows")
    full = held.where("n > 0").select("doc_id", "n", "s1", "s2")
    joined = join_frequent(full, table, ["s1", "s2"], "n_rows", full.count())
    alone = held.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(alone)
