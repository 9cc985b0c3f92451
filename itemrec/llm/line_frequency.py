"""Quality rules: counts within a text, and how often its lines occur in other documents of its host."""

from __future__ import annotations

from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemrec.llm.common import drop_rows, join_frequent, map_batches, named, row_hashes
from itemrec.runtime import store

SPACES, SYMBOLS = b" \t\n\x0b\f\r", b"#*$%&|<>"
#: Bytes that start no character of UTF-8.
FOLLOWING = bytes(range(0x80, 0xC0))
WINDOW, MIN_WORDS = 5, 10
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
VERDICTS = ("base_failed", "n_frequent_words", "depleted", "kept")
FEATURES = "doc_id bigint, host string, h1 bigint, h2 bigint, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", line_keys array<binary>, line_words array<bigint>, line_beside array<bigint>"


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words that lie in a window of ``width`` words which the text holds twice or more."""
    if len(words) <= width:
        return 0
    line = b" ".join(words)
    starts = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    ends = (starts - 1)[width - 1 :].tolist()
    windows = list(map(line.__getitem__, map(slice, [0, *starts[:-width].tolist()], ends)))
    if len(set(windows)) == len(windows):
        return 0
    times = Counter(windows)
    edges = np.zeros(len(words) + 1, np.int64)
    for i, w in enumerate(windows):
        if times[w] > 1:
            edges[i] += 1
            edges[i + width] -= 1
    return int((edges.cumsum() > 0).sum())


def text_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """The values of ``COUNTS``."""
    words, seen, doubled = text.split(), set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            doubled += 1
        elif line.strip():
            seen.add(line)
    return (
        len(words), len(text.translate(None, SPACES + FOLLOWING)), len(text) - len(text.translate(None, SYMBOLS)), doubled, repeated_words(words),
    )


def line_table(text: bytes) -> tuple[list[bytes], list[int], list[int]]:
    """Of each line that has a word: its key, its words over all occurrences, and a mark of what else the text says.

    The mark is a hash of the first, in order of bytes, of all windows of ``WINDOW`` words in the other
    lines; a shorter line is one window. Near copies of a text mostly agree on it, and other texts with the line don't.
    """
    found: Counter[bytes] = Counter()
    first: dict[bytes, bytes] = {}
    for line in text.split(b"\n"):
        words = line.lower().split()
        if not words:
            continue
        joined = b" ".join(words)
        if joined not in found:
            if len(words) <= WINDOW:
                first[joined] = joined
            else:
                starts = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
                first[joined] = min(map(joined.__getitem__, map(slice, [0, *starts[:-WINDOW].tolist()], (starts - 1)[WINDOW - 1 :].tolist())))
        found[joined] += len(words)
    least = (sorted(first.values())[:2] + [b"", b""])[:2]
    beside = {least[0]: xxhash.xxh3_64_intdigest(least[1]) >> 1, None: xxhash.xxh3_64_intdigest(least[0]) >> 1}
    return [xxhash.xxh3_128_digest(k) for k in found], list(found.values()), [beside.get(first[k], beside[None]) for k in found]


def _features(batch) -> dict[str, object]:
    rows = [t or b"" for t in batch["text"].to_pylist()]
    out: dict[str, object] = {c: batch[c] for c in ("doc_id", "host", "h1", "h2")}
    out |= dict(zip(COUNTS, zip(*map(text_counts, rows), strict=True), strict=True)) if rows else {c: [] for c in COUNTS}
    tables = [line_table(t) for t in rows]
    return out | {c: [x[i] for x in tables] for i, c in enumerate(("line_keys", "line_words", "line_beside"))}


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits: float) -> DataFrame:
    """Counts and verdict for each row of ``docs``: doc_id, ``COUNTS`` and ``VERDICTS``.

    A line, in lower case and with single spaces, is frequent on a host if ``min_documents`` (10) of the host's documents
    hold it. Documents of equal text on a host count once, and those that agree in what else they say (see ``line_table``) do too:
    copies and near copies, which another operator removes, don't make their lines frequent; nor does a line of which
    more than half of the texts are such. The limit is the same whatever the size of a host. A document is depleted if fewer than
    ``min_left`` (half) of its words are in other lines. ``kept`` means that it isn't, and that its own counts don't fail it: 10 words
    at least, and of its words at most a fifth in repeated 5-word windows.

    Null or empty text: all counts 0, base_failed. Null host: the host ''. Null or repeated ids:
    each row is judged by itself and yields one row. No rows give no rows; other columns are ignored.
    """
    return judged(docs, id_col, text_col, host_col, **limits).drop("h1", "h2")


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits: float) -> DataFrame:
    """The rows of ``docs`` that ``score`` keeps, as they are; rows of equal id and text on different hosts each have their own verdict."""
    return drop_rows(docs, judged(docs, id_col, text_col, host_col, **limits).where("not kept"), id_col, text_col, host_col)


def judged(
    docs: DataFrame, id_col: str, text_col: str, host_col: str, min_documents: int = 10, min_left: float = 0.5,
) -> DataFrame:
    """What ``score`` returns, and two hashes of text and host, by which rows of one id are told apart."""
    rows = docs.select(
        named(id_col).cast("bigint").alias("doc_id"), named(text_col).cast("binary").alias("text"),
        F.coalesce(named(host_col).cast("string"), F.lit("")).alias("host"),
        *[h.alias(n) for h, n in zip(row_hashes(text_col, host_col), ("h1", "h2"), strict=True)],
    )
    found = store(map_batches(rows, _features, FEATURES).withColumn("row", F.monotonically_increasing_id()))
    unique = found.groupBy("host", "h1", "h2").agg(F.first("line_keys").alias("line_keys"), F.first("line_beside").alias("line_beside"), F.count("*").alias("copies"))
    frequent = (
        unique.select("host", "copies", F.explode(F.arrays_zip("line_keys", "line_beside")).alias("x"))
        .groupBy("host", F.col("x.line_keys").alias("line"), F.col("x.line_beside").alias("beside")).agg(F.count("*").alias("texts"), F.sum("copies").alias("rows"))
        .groupBy("host", "line").agg(F.count("*").alias("n_documents"), F.sum("texts").alias("n_texts"), F.sum("rows").alias("n_rows"))
        .where((F.col("n_documents") >= min_documents) & (2 * F.col("n_documents") >= F.col("n_texts")))
        .select("host", "line", "n_rows")
    )
    held = found.select("row", "host", F.explode(F.arrays_zip("line_keys", "line_words")).alias("x")).select(
        "row", "host", F.col("x.line_keys").alias("line"), F.col("x.line_words").alias("words")
    )
    n_lines = found.agg(F.sum(F.size("line_keys"))).first()[0] or 0
    gone = join_frequent(held, frequent, ["host", "line"], "n_rows", n_lines).groupBy("row").agg(F.sum("words").alias("n_frequent_words"))
    words, left = F.col("n_words"), F.col("n_words") - F.col("n_frequent_words")
    return (
        found.select("row", "doc_id", "h1", "h2", *COUNTS).join(gone, "row", "left")
        .withColumn("n_frequent_words", F.coalesce("n_frequent_words", F.lit(0)).cast("bigint"))
        .withColumn("base_failed", (words < MIN_WORDS) | (100 * F.col("n_repeat_words") > 20 * words))
        .withColumn("depleted", left < min_left * words)
        .withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))
        .select("doc_id", "h1", "h2", *COUNTS, *VERDICTS)
    )

