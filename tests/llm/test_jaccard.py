import itertools

import numpy as np

import corpus_pipeline
from spanloom.llm import jaccard, simhash


def brute(text):
    words = (text or "").lower().encode().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def kept_by_brute(docs):
    """Smallest id of every component of pairs at 0.8 or more."""
    sets, root = [brute(t) for _, t in docs], list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    inside = {}
    for i, s in enumerate(sets):
        for x in s:
            inside.setdefault(x, []).append(i)
    pairs = {p for v in inside.values() if len(v) < 500 for p in itertools.combinations(v, 2)}
    for i, j in pairs:
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return {docs[i][0] for i in range(len(docs)) if find(i) == i}


def edited(words, r, share):
    return " ".join("new%d" % r.integers(10**9) if r.random() < share else w for w in words)


def test_near_copies_beyond_three_bits(spark):
    """Copies at 0.8 and above, of which most differ in more than three bits of a fingerprint."""
    r = np.random.default_rng(5)
    docs = []
    for base in range(60):
        words = [f"w{r.integers(5000)}" for _ in range(200)]
        docs += [(len(docs) + k, t) for k, t in enumerate([" ".join(words), *(edited(words, r, s) for s in (0.005, 0.01, 0.02, 0.03, 0.05))])]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    want = kept_by_brute(docs)
    got = {x.doc_id for x in corpus_pipeline.near_dedup(spark, df, "").collect()}
    assert got == want
    assert simhash.keep_one(df).count() > len(want)


def test_small_table(spark, small):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = sorted((x.doc_id, x.text) for x in df.select("doc_id", "text").collect())
    assert {x.doc_id for x in jaccard.keep_one(df).collect()} == kept_by_brute(docs)


def test_families_in_blocks(spark):
    """Families cut into blocks that meet pairwise give the same components, each set is there once a task."""
    r = np.random.default_rng(6)
    words = [f"w{i}" for i in range(60)]
    docs = [(k, edited(words, r, 0.06)) for k in range(80)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    made = jaccard.staged(jaccard.sketches(df), "made")
    nodes = made.drop("doc_id", "mark").dropDuplicates(["node"])
    members = jaccard.staged(jaccard.buckets(nodes), "members")
    alone = nodes.limit(0).select("node", nodes.node.alias("root"))
    want = None
    for size in (1_000_000, 500):
        related = jaccard.staged(jaccard.families(members, nodes, alone, size), "related")
        assert related.count() == related.select("task", "node").distinct().count()
        tasks = related.select("task").distinct().count()
        assert (tasks > 10) == (size == 500)
        links = jaccard.family_links(related, jaccard.shingle_sets(related, df, made))
        roots = {x.node: x.root for x in jaccard.components(links).collect()}
        want = want or roots
        assert roots == want and len(set(roots.values())) < len(roots)
    assert {x.doc_id for x in jaccard.keep_one(df).collect()} == kept_by_brute(docs)


def test_labels_leave_out_pairs():
    r = np.random.default_rng(7)
    codes, group, label = r.integers(0, 2**64, 400, dtype=np.uint64), r.integers(0, 4, 400), r.integers(0, 6, 400)
    codes[::3] ^= codes[0] ^ codes[::3] & np.uint64(0xFFFFFFFFFFFFF000)
    index = simhash.GrayIndex(group, codes)
    linked = label[index.order]
    found = {(int(a), int(b)) for i, j in index.pairs(22, linked) for a, b in zip(i, j, strict=True)}
    want = {(int(a), int(b)) for i, j in index.pairs(22) for a, b in zip(i, j, strict=True) if linked[a] != linked[b]}
    assert found == want and want
    assert not list(index.pairs(22, np.zeros(400, int)))


def test_smallest_nodes_are_searched_for(spark):
    """The Gray index finds what comparing each smallest node with all nodes of its buckets does, also in blocks."""
    r = np.random.default_rng(8)
    words = [f"w{i}" for i in range(80)]
    texts = [edited(words, r, s) for s in r.choice([0.01, 0.03, 0.08], 120)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    nodes = jaccard.staged(jaccard.sketches(df).drop("doc_id", "mark").dropDuplicates(["node"]), "nodes")
    members = jaccard.staged(jaccard.buckets(nodes), "members")
    known = {x.node: x for x in nodes.collect()}
    differ = lambda a, b, *cs: sum(((a[c] ^ b[c]) & (2**64 - 1)).bit_count() for c in cs)
    want = set()
    for first, node in {(x["first"], x.node) for x in members.collect()}:
        a, b = known[first], known[node]
        if first != node and min(a.n, b.n) >= max(a.n, b.n) * 0.8 and differ(a, b, "fp") <= 22 and differ(a, b, "b0", "b1", "b2", "b3") <= 50:
            want.add((first, first, node))
    assert want
    for hot in (50_000, 7):
        got = [tuple(x) for x in jaccard.led(members, nodes, hot=hot).collect()]
        assert len(got) == len(want) and set(got) == want


def test_clashing_names(spark):
    names = ["__gone", "__id", "__mark", "mark", "id", "component", "c0", "c1"]
    rows = [(1, "one two three four five six", *"abcdefgh"), (2, "one  two three four five SIX", *"abcdefgh"), (3, "other", *"abcdefgh")]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    for keep_one in (jaccard.keep_one, simhash.keep_one):
        out = keep_one(df)
        assert out.columns == df.columns and sorted(tuple(x) for x in out.collect()) == [rows[0], rows[2]]


def test_odd_rows(spark, odd_docs, no_docs):
    kept = jaccard.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [x.doc_id for x in kept.collect()]
    assert ids.count(0) == 1 and ids.count(2) == 1 and ids.count(3) == 1 and None in ids and not {1, 4, 7} & set(ids)
    assert jaccard.keep_one(no_docs).collect() == []


def test_sets_are_sent_once_to_a_group(spark):
    """Pairs of one bucket in blocks: every pair is there, with both sets, and few sets are sent."""
    pairs = [(7, a, b) for a in range(60) for b in range(a + 1, 60)] + [(k, 1000 + k, 2000 + k) for k in range(30)]
    df = spark.createDataFrame(pairs, "bucket long, a long, b long")
    for block, sets in ((256, 4096), (10, 20)):
        asked, needed = jaccard.dealt(df, block, sets)
        asked, needed = [tuple(x) for x in asked.collect()], [tuple(x) for x in needed.collect()]
        assert sorted((a, b) for _, a, b in asked) == sorted((a, b) for _, a, b in pairs)
        assert len(set(needed)) == len(needed) and {(g, x) for g, a, b in asked for x in (a, b)} == set(needed)
        assert len(needed) < len(pairs) / 2


def test_templates(spark):
    """Texts of one template on both sides of the threshold: the components are those of brute force."""
    r = np.random.default_rng(9)
    words = [f"t{i}" for i in range(150)]
    docs = [(k, edited(words, r, (0.01, 0.02, 0.03, 0.035)[k % 4])) for k in range(160)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert {x.doc_id for x in jaccard.keep_one(df).collect()} == kept_by_brute(docs)
