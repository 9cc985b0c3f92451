from collections import Counter, defaultdict

import pytest

from itemrec.llm import line_frequency

SPACE = " \t\n\x0b\f\r"


def words_of(text):
    for c in SPACE[1:]:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def beside(text):
    """{line: the first of all 5-word windows in the other lines}"""
    lines = {" ".join(words_of(lower(x))) for x in text.split("\n") if words_of(x)}
    split = {x: x.split(" ") for x in lines}
    windows = {x: min(" ".join(ws[k : k + 5]).encode() for k in range(max(1, len(ws) - 4))) for x, ws in split.items()}
    return {x: min((w for y, w in windows.items() if y != x), default=b"") for x in lines}


def expected(rows, min_documents=10, min_left=0.5):
    holders = defaultdict(dict)
    for _, t, h in rows:
        for line, other in beside(t or "").items():
            holders[h or "", line][t or ""] = other
    out = []
    for i, t, h in rows:
        words, lines = words_of(t or ""), [x for x in (t or "").split("\n") if words_of(x)]
        windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        times = Counter(windows)
        hit = {k + j for k, w in enumerate(windows) if times[w] > 1 for j in range(5)}
        kinds = lambda x: (len(set(x.values())), len(x))
        held = [(x, *kinds(holders[h or "", " ".join(words_of(lower(x)))])) for x in lines]
        gone = sum(len(words_of(x)) for x, n, m in held if n >= min_documents and 2 * n >= m)
        failed = len(words) < 10 or 100 * len(hit) > 20 * len(words)
        depleted = len(words) - gone < min_left * len(words)
        out.append((i, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(hit), failed, gone, depleted, not failed and not depleted))
    return sorted(out, key=str)


def check(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, source string, n_words string")
    assert sorted(map(tuple, line_frequency.score(df).collect()), key=str) == expected(rows)
    kept = line_frequency.keep(df)
    assert kept.columns == df.columns
    verdicts = Counter((r[0], r[-1]) for r in expected(rows))
    assert Counter(r.doc_id for r in kept.collect()) == Counter({i: n for (i, k), n in verdicts.items() if k})


def test_documents(spark):
    check(spark, [(r.doc_id, r.text, r.source) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()])


def test_lines_of_a_host(spark):
    body = "a body of ten words that no other document has {} "
    rows = [(i, f"the Banner of this  host\n{body.format(i)}", "a") for i in range(12)]
    rows += [(100 + i, "the banner of this host and then nothing else that isn't on it\nThe banner of this host\n" + "x\n" * (i % 2), "b") for i in range(12)]
    rows += [(200 + i, "the banner of this host is what this one document says again and again", "a") for i in range(12)]  # copies count once
    rows += [(300 + i, f"the banner of this host\nthe banner of this host\nthe banner of this host\n{i}", "a") for i in range(3)]
    check(spark, rows)


def test_near_copies_do_not_make_their_lines_frequent(spark):
    """Thirty near copies of one text stay; the banner that differing texts carry goes, on a large host as on a small one."""
    lines = [" ".join(f"w{i}{k}" for k in range(12)) for i in range(6)]
    copies = [(i, "\n".join([*lines[: i % 6], lines[i % 6] + f" edit{i}", *lines[i % 6 + 1 :]]), "a") for i in range(30)]
    banner = "this banner has more words than what is said beside it here"
    short = [(100 + i, f"{banner}\nnumber {i} says a little", "a") for i in range(11)]
    many = [(1_000 + i, f"text {i} of many on this host that is large and says {i * 7}", "a") for i in range(400)]
    check(spark, copies + short + many)
    kept = {r.doc_id for r in line_frequency.keep(spark.createDataFrame(copies + short + many, "doc_id bigint, text string, source string")).collect()}
    assert kept == {r[0] for r in copies + many}


def test_a_verdict_is_of_a_row_on_its_host(spark):
    """An equal id and text on another host keeps its own verdict."""
    banner = "this banner has more words than what is said beside it here"
    rows = [(i, f"{banner}\nnumber {i} says a little", "a") for i in range(11)]
    rows.append((0, rows[0][1], "b"))
    kept = line_frequency.keep(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    assert [(r.doc_id, r.source) for r in kept] == [(0, "b")]


@pytest.mark.parametrize("rows", [
    [(1, None, None), (1, "", "a"), (None, "one two three four five six seven eight nine ten", None), (None, " \t\n", "a"), (2, "é # $ " * 40, ""), (2, "é # $ " * 40, "")],
    [(3, "word " * 200_000 + "end", "a"), (4, "Same line here\nSame line here\nsame line here\r\n", "a"), (5, "a b c d e f a b c d e g h i j k l m n o p q r s t u v w x y z", "a")],
])
def test_odd_rows(spark, rows):
    check(spark, rows)


def test_no_rows(spark):
    assert line_frequency.score(spark.createDataFrame([], "doc_id bigint, text string, source string")).collect() == []
