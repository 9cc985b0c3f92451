import numpy as np
import xxhash

from itemrec.llm import simhash
from itemrec.llm.components import components, forest

SMALL = "/root/testdata/sf0.001/documents.parquet"


def by_definition(text):
    words = [w for w in (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(rows):
    """Expected component of each (id, fingerprint), by comparing all."""
    left, out = set(range(len(rows))), {}
    while left:
        front = {left.pop()}
        group = set()
        while front:
            i = front.pop()
            group.add(i)
            near = {j for j in left if (rows[i][1] ^ rows[j][1]).bit_count() <= 2}
            left -= near
            front |= near
        ids = [rows[i][0] for i in group if rows[i][0] is not None]
        out |= {i: min(ids, default=None) for i in group}
    return [out[i] for i in range(len(rows))]


def check(spark, rows, **options):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, fp string")
    found = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df, **options).collect()), key=str)
    prints = [(i, by_definition(t)) for i, t in rows]
    assert found == sorted(((i, f"{p:016x}", c) for (i, p), c in zip(prints, groups(prints), strict=True)), key=str)


def test_documents(spark):
    check(spark, [(r.doc_id, r.text) for r in spark.read.parquet(SMALL).collect()])


def test_odd_rows(spark):
    long = " ".join(f"w{i % 977}" for i in range(70_000))
    check(spark, [(5, None), (4, ""), (3, " \n"), (9, "a b"), (8, "A\tB"), (7, "one"), (7, "one"), (7, "two three four"), (None, "one"), (None, "only null ids here"),
                  (1, long), (2, long + " x"), (11, "Ä b c"), (12, "ä b c")])


def test_no_rows(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_tree_finds_what_comparing_all_does():
    random = np.random.default_rng(1)
    base = random.integers(0, 1 << 63, 300, dtype=np.uint64)
    near = base[:200] ^ (np.uint64(1) << random.integers(0, 63, 200, dtype=np.uint64)) ^ (np.uint64(1) << random.integers(0, 63, 200, dtype=np.uint64))
    values = np.unique(np.concatenate([base, near]))
    a, b = simhash.BKTree(values).pairs(values, 2)
    every = {(i, j) for i in range(len(values)) for j in range(len(values)) if (int(values[i]) ^ int(values[j])).bit_count() <= 2}
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == every


def test_split_shards_lose_no_link(spark):
    """Trees of three fingerprints each, for a ball that meets in one shard."""
    values = [0, *[1 << b for b in range(40, 63)], *[3 << b for b in range(40, 62)], 1 << 20]
    fps = spark.createDataFrame([(v,) for v in values], "fp bigint")
    roots = {r.node: r.root for r in components(simhash.links(fps, tree_size=3)).collect()}
    assert roots == dict.fromkeys(values, 0)


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    found = {r.node: r.root for r in components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert found == dict.fromkeys(range(41), 0) | {100: 100, 101: 100, 102: 100}
    a, b = np.array(chain[:-1]).T
    least, other = forest(a, b)
    assert dict(zip(other.tolist(), least.tolist(), strict=True)) == {k: v for k, v in found.items() if k != v}


def test_one_of_each_group_stays(spark):
    rows = [(2, "same text here", "a"), (1, "same text here", "b"), (1, "same text here", "b"), (3, "another one altogether now", None), (None, "same text here", "c")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, component_id string")
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(map(tuple, kept.collect())) == [rows[1], rows[3]]
