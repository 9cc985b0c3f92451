import pytest

import corpus_pipeline as pipeline
from itemrec.llm.common import drop_rows, row_hashes
from itemrec.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in pipeline.STAGES[:-1]:
        docs = pipeline.store(stage(spark, docs, SMALL))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        sizes.append(docs.count())
        if name == "line_dedup":
            assert docs.where("n_chars <> char_length(text)").isEmpty()
    assert sizes == sorted(sizes, reverse=True) and len(set(sizes)) > 2
    last = pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, pipeline.run(spark, SMALL).collect()))
    assert last.count() == sizes[-1]


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


KIND = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LINE = "a line that is long enough to be looked at by all"
ODD = [
    (1, None, None, None, None), (2, "", "", "", 0), (3, " \n\t", "en", "s", 3), (None, f"{LINE}\nbelow a null id", None, "s", 1), (4, f"{LINE}\nfour", "en", None, None),
    (4, f"{LINE}\nfour", "en", None, None), (5, f"{LINE} \nfive says more", "en", "s", 1), (6, "x" * 300_000 + " end", "en", "s", 1), (7, "Ünïcode \U0001f600 </s>", "zz", "s", 1),
]


@pytest.mark.parametrize("name, stage", pipeline.STAGES)
@pytest.mark.parametrize("rows", [ODD, []])
def test_stages_bear_odd_rows(spark, name, stage, rows):
    """Nulls, repeats, blank and very long texts, no rows, and columns of names that the operators use themselves."""
    extra = ", line string, gone_doc_id int, h1 int, N_WORDS string"
    docs = spark.createDataFrame([(*r, "l", 1, 2, "w") for r in rows], KIND + extra)
    found = stage(spark, docs, SMALL)
    got = found.collect()
    if name == "bpe":
        assert len(got) == len(rows)
        return
    assert found.columns == docs.columns
    if name == "line_dedup":
        assert len(got) == len(rows)
        texts = {r.doc_id: r.text for r in got}
        assert not rows or (texts[5] == f"{LINE} \nfive says more" and texts[4] == "four" and texts[None] == "below a null id" and texts[1] == "")
    elif name == "decontamination":
        assert len(got) == len(rows)
    elif name == "simhash":
        # blank texts are one group, the repeated row is one document
        assert sorted((r.doc_id for r in got), key=str) == ([1, 4, 5, 6, 7, None] if rows else [])
    else:
        assert sorted((r.doc_id for r in got), key=str) == ([4, 4, 5, None] if rows else [])  # the others are too short or one word


def test_many_rows_are_dropped_by_shuffle(spark):
    """Beyond its bound the table of rows to drop is joined, not broadcast, with the same result."""
    docs = spark.createDataFrame([(i % 50 if i % 7 else None, f"t{i % 9}" if i % 5 else None, f"s{i % 3}") for i in range(400)], "doc_id bigint, text string, source string")
    hashes = [h.alias(c) for h, c in zip(row_hashes("text", "source"), ("h1", "h2"), strict=True)]
    gone = docs.where("doc_id < 20 or doc_id is null").where("source <> 's2'").select("doc_id", *hashes)
    few, many = (drop_rows(docs, gone, "doc_id", "text", "source", bound=b) for b in (1_000, 3))
    assert sorted(map(tuple, few.collect()), key=str) == sorted(map(tuple, many.collect()), key=str)
    assert sorted(map(tuple, few.collect()), key=str) == sorted((tuple(r) for r in docs.collect() if not ((r.doc_id is None or r.doc_id < 20) and r.source != "s2")), key=str)
