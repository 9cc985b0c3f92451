import hashlib

from pyspark.sql import functions as F

from itemrec.llm import merkle
from itemrec.llm.common import LOWER, UPPER

SMALL = "/root/testdata/sf0.001/documents.parquet"
KIND = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def up(nodes):
    return [h(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]


def climbed(nodes, at, changed):
    """(root, siblings on the way, root with the node changed)."""
    proof = []
    while len(nodes) > 1:
        first = at - at % 8
        run = nodes[first : first + 8]
        proof += run[: at - first] + run[at - first + 1 :]
        changed = h(*run[: at - first], changed, *run[at - first + 1 :])
        nodes, at = up(nodes), at // 8
    return nodes[0], proof, changed


def expected(rows, tampered):
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    names = sorted(trees, key=lambda n: (n is not None, (n or "").encode()))
    for t in trees.values():
        t.sort(key=lambda x: x[:3])
    tops = [climbed([x[2] for x in trees[n]], 0, "")[0] for n in names]
    out = []
    for n, name in enumerate(names):
        leaves = [x[2] for x in trees[name]]
        for i, (_, _, own, r) in enumerate(trees[name]):
            lowered = r[4] and r[4].translate(str.maketrans(UPPER, LOWER))
            subroot, below, changed = climbed(leaves, i, leaf((*r[:4], lowered)) if tampered(r[0]) else own)
            root, above, changed = climbed(tops, n, changed)
            out.append((r[0], own, subroot, root, h(*below, *above), changed, changed == root))
    return sorted(out, key=str)


def check(spark, rows, tampered=lambda i: i is not None and i % 3 == 0, kind=KIND, **options):
    df = spark.createDataFrame(rows, kind)
    found = merkle.manifest(df, tampered=F.coalesce(F.col("doc_id") % 3 == 0, F.lit(False)), changes={"text": F.translate("text", UPPER, LOWER)}, **options)
    assert sorted(map(tuple, found.collect()), key=str) == expected([r[:5] for r in rows], tampered)


def test_documents(spark):
    check(spark, [tuple(r) for r in spark.read.parquet(SMALL).select("doc_id", "source", "lang", "n_chars", "text").collect()])


def test_odd_rows(spark):
    rows = [(i, "s", "en", i, f"Text {i}") for i in range(20)] + [(1, None, None, None, None), (2, "", "", 0, ""), (None, "s", "en", 1, "Null id"), (3, "ü", "é", 1, "Größe A" * 9_000)]
    rows += [(4, "s", "z", 1, "A"), (4, "s", "z", 1, "A"), (4, "s", "z", 1, "B")]
    check(spark, [(*r, "x", 1) for r in rows], kind=KIND + ", tree string, pos int")


def test_one_row_and_none(spark):
    check(spark, [(3, "s", "en", 1, "ABC")])
    check(spark, [(3, "s", "en", 1, "abc")])
    assert merkle.manifest(spark.createDataFrame([], KIND)).collect() == []


def test_sizes_around_runs_and_blocks(spark):
    """Blocks of 8 leaves, so that versions go on through several tables."""
    check(spark, [(i, "s", f"l{n}", i, f"T {i}") for n in (1, 7, 8, 9, 64, 65, 130) for i in range(n)], levels=1)
    check(spark, [(i, "s", f"l{i:03}", i, f"T {i}") for i in range(75)], levels=1)


def test_versions_share_what_they_do_not_change():
    leaves = [hashlib.sha256(bytes([i])).digest() for i in range(100)]
    block = merkle.Block(leaves, 3)
    before, n = list(block.digests), len(block.digests)
    root = block.version(70, b"x" * 32)
    assert len(block.digests) == n + 4 and block.digests[:n] == before  # the leaf and its three ancestors
    kept = set(block.below[block.root]) & set(block.below[root])
    assert len(kept) == 1 and block.digests[block.root] == before[-1]
    whole = merkle.Block([*leaves[:70], b"x" * 32, *leaves[71:]], 3)
    assert whole.digests[whole.root] == block.digests[root]
    other = block.version(0, b"y" * 32)
    assert block.digests[root] == whole.digests[whole.root] and other != root
