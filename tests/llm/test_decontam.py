import re

import pytest

from itemrec.llm import decontam


def words_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def expected(docs, items):
    windows = {}
    for item, text in items:
        words = words_of(text)
        for i in range(max(1, len(words) - 12) if words else 0):
            windows.setdefault(tuple(words[i : i + 13]), set()).add("" if item is None else str(item))
    out = []
    for i, text in docs:
        words, hit, found = words_of(text), set(), set()
        for size in {len(w) for w in windows}:
            for p in range(len(words) - size + 1):
                if (w := tuple(words[p : p + size])) in windows:
                    hit |= set(range(p, p + size))
                    found |= windows[w]
        out.append((i, len(words), len(hit), len(found), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(words)))
    return sorted(out, key=str)


def check(spark, docs, items, **options):
    d = spark.createDataFrame([(i, t, 5, "s") for i, t in docs], "doc_id bigint, text string, n_words int, spans string")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    found = decontam.mark(d, b, **options)
    assert found.columns == ["doc_id", "text", "spans", *decontam.ADDED]
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.item_ids, r.contaminated) for r in found.collect()), key=str) == expected(docs, items)


@pytest.mark.parametrize("index_words", [decontam.INDEX_WORDS, 300])
def test_documents(spark, index_words):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    assert sum(x[2] > 0 for x in expected(docs, items)) > 0
    check(spark, docs, items, index_words=index_words)


LONG = " ".join(f"w{i}" for i in range(20))


def test_odd_rows(spark):
    items = [(1, LONG), (2, LONG.upper()), (10, "two words"), (3, "one"), (None, "é漢 x y"), (4, None), (5, "--- !"), (6, "a a a a a a a a a a a a a"), (7, "a a")]
    docs = [(1, LONG.replace(" ", "-")), (1, None), (None, "TWO\nwords, two words"), (2, ""), (3, "a " * 40), (3, "a " * 40), (4, "É漢 x y é漢_x.y"), (5, " ".join(LONG.split()[:12])), (6, "one " + "z " * 18), (7, "one " + "z " * 19),
            (8, "z " * 100_000 + LONG), (9, "two two words one")]
    check(spark, docs, items)


def test_empty_tables(spark):
    check(spark, [(1, "a b c")], [])
    check(spark, [], [(1, "a b c")])
