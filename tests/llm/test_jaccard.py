import numpy as np
import pytest

from itemrec.llm import jaccard

SMALL = "/root/testdata/sf0.001/documents.parquet"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def by_definition(text):
    lowered = (text or "").translate(str.maketrans(UPPER + "\t\n\x0b\f\r", LOWER + " " * 5))
    words = [w for w in lowered.split(" ") if w]
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def expected(rows):
    """(id, set size, smallest id reachable) for each row, by comparing all."""
    sets = [by_definition(t) for _, t in rows]
    left, out = set(range(len(rows))), {}
    while left:
        front, group = {left.pop()}, set()
        while front:
            i = front.pop()
            group.add(i)
            near = {j for j in left if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
            left -= near
            front |= near
        ids = [rows[i][0] for i in group if rows[i][0] is not None]
        out |= {i: min(ids, default=None) for i in group}
    return sorted(((rows[i][0], len(sets[i]), out[i]) for i in range(len(rows))), key=str)


def check(spark, rows, kind="doc_id bigint, text string"):
    df = spark.createDataFrame([r if len(r) == len(kind.split(",")) else (*r, 0) for r in rows], kind)
    found = sorted(map(tuple, jaccard.near_duplicates(df).collect()), key=str)
    assert found == expected([r[:2] for r in rows])


def texts(random, n, words=60):
    return [" ".join(f"w{x}" for x in random.integers(0, 5_000, words)) for _ in range(n)]


def changed(random, text, edits):
    words = text.split()
    for i in random.integers(0, len(words), edits):
        words[i] = f"x{random.integers(0, 10**6)}"
    return " ".join(words)


def test_documents(spark):
    check(spark, [(r.doc_id, r.text) for r in spark.read.parquet(SMALL).collect()])


def test_odd_rows(spark):
    long = " ".join(f"w{i % 977}" for i in range(70_000))
    words = [f"v{i}" for i in range(40)]
    rows = [(5, None), (4, ""), (3, " \n"), (9, "a b"), (8, "A\tB"), (7, "one"), (7, "one"), (7, "two three four"), (None, "one"), (None, "only null ids"),
            (1, long), (2, long + " x"), (11, "Ä b c d e f"), (12, "ä b c d e f"), (20, " ".join(words)), (19, " ".join(words[:-3])), (18, " ".join(words[:-9]))]
    check(spark, [(*r, 1) for r in rows], "doc_id bigint, text string, N bigint")


def test_no_rows(spark):
    assert jaccard.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
    check(spark, [(1, ""), (2, None)])


def test_near_copies_chains_and_shared_passages(spark):
    """Groups of near copies around the threshold, and unrelated texts that share a passage of theirs."""
    random = np.random.default_rng(3)
    bases, passage = texts(random, 6), texts(random, 1, 30)[0]
    rows = [changed(random, b, k % 5) for b in bases for k in range(25)]
    chain = [texts(random, 1, 80)[0]]
    for _ in range(20):
        chain.append(" ".join(chain[-1].split()[2:] + texts(random, 1, 2)[0].split()))
    rows += chain + [f"{t} {passage}" for t in texts(random, 40, 20)] + [bases[0]] * 3
    order = random.permutation(len(rows))
    check(spark, [(int(i) + 100, rows[j]) for i, j in enumerate(order)])


def test_long_lists_are_dealt_in_parts(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "LIST_PART", 3)
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 2)
    monkeypatch.setattr(jaccard, "ROUNDS", 1)
    random = np.random.default_rng(4)
    base = texts(random, 1, 50)[0]
    check(spark, [(i, changed(random, base, i % 4)) for i in range(40)])


@pytest.mark.parametrize("n", [1, 2, 4, 5, 6, 9, 10, 33, 100])
def test_prefixes_and_overlaps(n):
    for m in range(1, 200):
        need = jaccard.least_overlap(n, m)
        assert all((100 * o >= 80 * (n + m - o)) == (o >= need) for o in range(min(n, m) + 1))
        if need <= min(n, m):
            assert n - need + 1 <= jaccard.prefix_length(n)


def test_blocks_skip_only_what_cannot_link():
    random = np.random.default_rng(5)
    held = sorted([i, int(random.integers(1, 12)), 0, int(random.integers(0, 4)), -1] for i in range(60))
    for row in held:
        row[2] = int(random.integers(0, jaccard.prefix_length(row[1])))
    held.sort(key=lambda r: (r[1], r[2], r[0]))
    found = {frozenset((a[0], b[0])) for a, b in jaccard._pairs_of_list(held)}
    for i, x in enumerate(held):
        for y in held[:i]:
            possible = 1 + min(x[1] - x[2] - 1, y[1] - y[2] - 1)
            links = x[3] != y[3] and min(x[1], y[1], possible) >= jaccard.least_overlap(x[1], y[1])
            assert (frozenset((x[0], y[0])) in found) == links


def test_families_link_as_their_sets_do(spark):
    """Differences from a leading set say which sets of a family link, through what is common to most of them."""
    random = np.random.default_rng(8)
    base, turn = np.arange(100, 160, dtype=np.uint64), np.arange(300, 306, dtype=np.uint64)
    sets = {0: np.setdiff1d(base, base[:9])}
    for i in range(1, 60):
        own = np.setdiff1d(base, random.choice(base, int(random.integers(0, 16)), replace=False))
        sets[i] = np.union1d(own, np.concatenate([random.choice(turn, int(random.integers(0, 4)), replace=False), random.integers(1_000, 9_999, int(random.integers(0, 9))).astype(np.uint64)]))
    rows = [(i, 0, len(sets[0]), bytearray(np.setdiff1d(sets[0], s).tobytes()), bytearray(np.setdiff1d(s, sets[0]).tobytes())) for i, s in sets.items() if i]
    found = {frozenset((r.a, r.b)) for r in jaccard.family_links(spark.createDataFrame(rows, jaccard.RELATIONS)).collect()}
    real = {frozenset((i, j)) for i in sets for j in sets if i < j and len(np.intersect1d(sets[i], sets[j])) >= jaccard.least_overlap(len(sets[i]), len(sets[j]))}
    assert found <= real
    def groups(edges):
        root = {i: i for i in sets}
        for _ in sets:
            for e in edges:
                low = min(root[i] for i in e)
                root |= dict.fromkeys(e, low)
        return root
    assert groups(found) == groups(real) and len(set(groups(real).values())) > 1


def test_marks_agree_as_sets_do():
    random = np.random.default_rng(10)
    hashes = lambda n: np.unique(random.integers(0, 1 << 64, n, dtype=np.uint64))
    agreed = lambda a, b: sum(x == y != 0 for x, y in zip(jaccard.mark_of(a), jaccard.mark_of(b))) / jaccard.MARK
    base = hashes(500)
    assert agreed(base, base) == 1 and agreed(base, np.concatenate([base[::9], hashes(400)])) < jaccard.AGREE
    assert agreed(base, np.union1d(np.delete(base, np.arange(0, 500, 10)), hashes(50))) > jaccard.AGREE
    assert jaccard.mark_of(base[:0]) == bytes(jaccard.MARK) and sum(b > 0 for b in jaccard.mark_of(base[:1])) == 1


def test_differences_are_carried_over():
    random = np.random.default_rng(9)
    x, z, y = (np.unique(random.integers(0, 40, 25).astype(np.uint64)) for _ in range(3))
    apart = lambda a, b: (np.setdiff1d(a, b), np.setdiff1d(b, a))  # what b lacks and has beside a
    for got, want in zip(jaccard.moved(apart(x, z), apart(z, y)), apart(x, y)):
        assert got.tolist() == want.tolist()


def test_relations_give_the_answers_of_whole_sets(spark):
    """A set known by its difference from another has the overlaps that its own tokens have."""
    random = np.random.default_rng(6)
    sets = {i: np.unique(random.integers(0, 60, 50).astype(np.uint64)) for i in range(12)}
    tokens = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in sets.items()], "id bigint, tokens binary")
    rows = []
    for z in range(12):
        for y in range(12):
            x = (y + 1) % 12
            rows.append((z, x, y, bytearray(np.setdiff1d(sets[x], sets[y]).tobytes()), bytearray(np.setdiff1d(sets[y], sets[x]).tobytes())))
    found = {(r.z, r.y): r.overlap for r in jaccard.compare(spark.createDataFrame(rows, "z bigint, x bigint, y bigint, minus binary, plus binary"), lambda dests: dests.join(tokens, "id")).collect()}
    want = {(z, y): len(np.intersect1d(a, b)) for z, a in sets.items() for y, b in sets.items()}
    assert found == {k: v for k, v in want.items() if v >= jaccard.least_overlap(len(sets[k[0]]), len(sets[k[1]]))}
