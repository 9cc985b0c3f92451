from collections import defaultdict

from itemrec.llm import line_dedup

SMALL = "/root/testdata/sf0.001/documents.parquet"


def key(line):
    return line.strip(" \t\n\x0b\f\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def expected(rows, min_chars=20, min_documents=3):
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders[key(line)].add(i)

    def dropped(i, line):
        ids = holders[key(line)]
        return len(key(line)) >= min_chars and len(ids) >= min_documents and i != max(ids, key=lambda x: (x is not None, x or 0))

    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if not dropped(i, x)]
        out.append((i, "\n".join(left), len(lines), len(lines) - len(left)))
    return sorted(out, key=str)


def check(spark, rows):
    df = spark.createDataFrame([(i, t, [1], "n") for i, t in rows], "doc_id bigint, text string, lost_lines array<int>, N_lines string")
    found = line_dedup.dedup_lines(df)
    assert found.columns == ["doc_id", "text", "lost_lines", "n_lines", "n_dropped"]
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in found.collect()), key=str) == expected(rows)


def test_documents(spark):
    check(spark, [(r.doc_id, r.text) for r in spark.read.parquet(SMALL).collect()])


def test_odd_rows(spark):
    line, wide = "a line of over twenty characters", "ä" * 20
    rows = [(1, line), (2, f"  {line.upper()}\t\nother"), (2, f"x\n{line}\n{line}"), (3, f"{line}\r\n\n{line}"), (3, f"{line}\r\n\n{line}"), (None, line), (None, None), (9, ""),
            (4, wide), (5, wide + "\n" + wide), (6, "Ä" * 20), (7, wide), (8, "short\n" * 50_000 + line), (10, "ä" * 19), (11, "ä" * 19), (12, "ä" * 19), (13, "\x1c" + wide)]
    check(spark, rows)


def test_two_documents_keep_their_lines(spark):
    check(spark, [(1, "the very same line of text"), (2, "the very same line of text"), (2, "the very same line of text")])


def test_only_null_ids(spark):
    check(spark, [(None, "the very same line of text")] * 4)


def test_no_rows(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_frequent_lines_by_a_split_join(spark, monkeypatch):
    """Few rows may be broadcast: the frequent keys are, and the others are joined by shuffle."""
    import itemrec.llm.common as common

    plain = common.join_frequent
    monkeypatch.setattr(line_dedup, "join_frequent", lambda *a, **b: plain(*a, **b, bound=2))
    rows = [(i, "a line in every document, and long\n" + f"a line for every fifth document {i % 5}") for i in range(60)]
    check(spark, rows)
