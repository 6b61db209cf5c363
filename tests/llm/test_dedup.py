import random
from collections import defaultdict

import numpy as np

from tessella.llm import near_dup
from tessella.llm.components import components
from tests.llm.common import docs, empty, rows


def brute(texts):
    """Class of each text by comparing all pairs."""
    bags = [set(near_dup.occurrences(*near_dup.bag(t)).tolist()) for t in texts]
    top = list(range(len(texts)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, p in enumerate(bags):
        for j in range(i):
            q = bags[j]
            if 5 * len(p & q) >= 4 * len(p | q):
                top[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(texts)):
        groups[find(i)].append(i)
    return sorted(map(sorted, groups.values()))


def grouped(out):
    groups = defaultdict(list)
    for r in out:
        groups[r.class_id].append(r.doc_id)
    return sorted(map(sorted, groups.values()))


def chains(n_groups=12, seed=2):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    out = []
    for g in range(n_groups):
        words = [word() for _ in range(rng.choice([3, 40, 200]))]
        if g % 3 == 0:
            words = words[:20] * 6 + words  # a bag with weights
        for _ in range(rng.choice([1, 4, 25])):  # each copy edits the one before: chains beyond the threshold
            out.append(" ".join(words))
            words = list(words)
            for _ in range(max(1, len(words) // 60)):
                words[rng.randrange(len(words))] = word()
    return out


def test_signature_is_unbiased():
    rng = random.Random(3)
    vocabulary = [str(rng.random()) for _ in range(400)]
    errors = []
    for t in range(30):
        a = [rng.choice(vocabulary) for _ in range(rng.choice([20, 100, 300]))]
        a = a[:10] * 9 + a if t % 2 else a
        b = list(a)
        for _ in range(rng.choice([1, 3, 6])):
            b[rng.randrange(len(b))] = rng.choice(vocabulary)
        p, q = (set(near_dup.occurrences(*near_dup.bag(" ".join(x))).tolist()) for x in (a, b))
        alike = near_dup.signature(*near_dup.bag(" ".join(a)), m=2000) == near_dup.signature(*near_dup.bag(" ".join(b)), m=2000)
        errors.append(alike.mean() - len(p & q) / len(p | q))
    assert abs(np.mean(errors)) < 0.006 and np.abs(errors).max() < 0.06


def test_bags_count_occurrences():
    shingles, counts = near_dup.bag("a b c d e f a b c d e")
    assert len(shingles) == 6 and sorted(counts) == [1, 1, 1, 1, 1, 2]
    assert len(set(near_dup.occurrences(shingles, counts).tolist())) == 7
    assert len(near_dup.bag("one two")[0]) == 1 and len(near_dup.bag(None)[0]) == 0


def test_classes_equal_all_pairs(spark):
    texts = chains()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = near_dup.near_duplicate_classes(df).collect()
    assert grouped(out) == brute(texts)
    assert sum(r.stays for r in out) == len({r.class_id for r in out})
    assert len(near_dup.drop_near_duplicates(df).collect()) == len({r.class_id for r in out})


def test_on_tables(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = [(r.doc_id, r.text) for r in df.collect()]
    want = [sorted(held[i][0] for i in g) for g in brute([t for _, t in held])]
    assert grouped(near_dup.dedup_digest(df).collect()) == sorted(want)


def test_odd_rows(spark):
    out = near_dup.dedup_digest(docs(spark)).collect()
    assert len(out) == len(rows())
    by = {r.doc_id: r.class_id for r in out}
    assert by[1] == by[2] == by[3] == 1 and by[4] == by[5] == 4 and by[None] is None
    kept = near_dup.drop_near_duplicates(docs(spark))
    assert kept.columns == docs(spark).columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, {r.class_id for r in out}))
    assert near_dup.dedup_digest(empty(spark)).count() == 0 and near_dup.drop_near_duplicates(empty(spark)).count() == 0


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(60)] + [(200, 200 + i) for i in range(1, 40)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(70)] + [(9, 9), (1, 0)]
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        if a != b:
            top[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(top)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def exact_links(texts):
    """Pairs of at least the similarity: an exact set-similarity join by prefixes of rare occurrences."""
    from collections import Counter

    bags = [near_dup.occurrences(*near_dup.bag(t)).tolist() for t in texts]
    often = Counter(h for b in bags for h in b)
    index, links = defaultdict(list), set()
    for i in sorted(range(len(bags)), key=lambda i: len(bags[i])):
        own = sorted(bags[i], key=lambda h: (often[h], h))
        n = len(own)
        prefix = own[: n - -(-4 * n // 5) + 1]
        met = {j for h in prefix for j in index[h] if 5 * len(bags[j]) >= 4 * n}
        have = set(own)
        for j in met:
            both = len(have.intersection(bags[j]))
            if 5 * both >= 4 * (n + len(bags[j]) - both):
                links.add((min(i, j), max(i, j)))
        for h in prefix:
            index[h].append(i)
    return links


def linked(n, links):
    top = list(range(n))

    def find(x):
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for a, b in links:
        top[find(a)] = find(b)
    return [find(i) for i in range(n)]


def test_recall_against_an_exact_join(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = sorted((r.text, r.doc_id) for r in df.collect())
    texts = sorted({t for t, _ in held})
    links = exact_links(texts)
    label = dict(zip(texts, linked(len(texts), links), strict=True))
    want = defaultdict(list)
    for t, i in held:
        want[label[t]].append(i)
    assert len(links) >= 3
    assert grouped(near_dup.dedup_digest(df).collect()) == sorted(map(sorted, want.values()))


def test_a_bucket_of_texts_just_under_the_threshold(spark):
    """A family whose members share bands but are mostly not alike: compared, not skipped."""
    rng = random.Random(12)
    base = [f"w{i}" for i in range(300)]
    texts = []
    for i in range(250):
        words = list(base)
        for k in rng.sample(range(300), rng.choice([6, 8, 9])):
            words[k] = f"x{i}y{k}"
        texts.append(" ".join(words))
    got = near_dup.dedup_digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    label = linked(len(texts), exact_links(texts))
    want = defaultdict(list)
    for i, x in enumerate(label):
        want[x].append(i)
    assert grouped(got) == sorted(map(sorted, want.values()))


def test_survivors_are_determined(spark):
    """Rows with one id and one text: the same row stays whatever the partitions."""
    rows_ = [(1, "one two three four five six", c) for c in "zyxwvut"] + [(2, "one two three four five six", "a"), (3, "other text", "b")]
    df = spark.createDataFrame(rows_, "doc_id long, text string, source string")
    found = {tuple(sorted(map(tuple, near_dup.drop_near_duplicates(df.repartition(n)).collect()))) for n in (1, 2, 5)}
    assert found == {((1, "one two three four five six", "t"), (3, "other text", "b"))}


def test_marks_bound_what_two_texts_share():
    rng = random.Random(9)
    for _ in range(300):
        words = [str(rng.randrange(60)) for _ in range(rng.choice([3, 30, 300, 3000]))]
        other = [w if rng.random() < 0.9 else str(rng.randrange(60)) for w in words][: rng.randrange(1, len(words) + 1)]
        p, q = (near_dup.occurrences(*near_dup.bag(" ".join(x))) for x in (words, other))
        a, b = (near_dup.marks(x).view(np.uint64) for x in (p, q))
        both = len(set(p.tolist()) & set(q.tolist()))
        lacking = lambda x, y: sum(int(w).bit_count() for w in x & ~y)
        assert both <= len(p) - lacking(a, b) and both <= len(q) - lacking(b, a)
