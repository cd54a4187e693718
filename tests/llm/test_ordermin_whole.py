"""Order MinHash over groups that no one node of a bucket is near to."""

import random

from pyspark.sql import functions as F
from test_bruteforce import classes_by_hand, frame

from foliant.llm import ordermin


def altered(rng, words, share):
    out = list(words)
    for i in rng.sample(range(len(out)), round(share * len(out))):
        out[i] = f"w{rng.randrange(10**9)}"
    return out


def test_star_group_and_shared_passage(spark):
    """Copies near their original but not near each other, and pairs among many texts that hold one passage."""
    rng = random.Random(21)
    one = [f"s{i}" for i in range(100)]
    own = [one] + [altered(rng, one, 0.12) for _ in range(150)]
    passage = [f"p{i}" for i in range(30)]
    for i in range(60):
        text = [f"t{i}-{j}" for j in range(30)]
        own += [passage + text, passage + altered(rng, text, 0.1)]
    own = [" ".join(t) for t in own]
    got = {r.doc_id: r.class_id for r in ordermin.near_duplicates(frame(spark, own)).collect()}
    sketched = [set(ordermin.bucket_keys(hashed(t)).tolist()) for t in own]
    links = [(i, j) for i in range(len(own)) for j in range(i) if ordermin.similar(hashed(own[i]), hashed(own[j]))]
    least = closed(len(own), [(i, j) for i, j in links if sketched[i] & sketched[j]])
    most = closed(len(own), links)
    for i in range(len(own)):  # all pairs that share a bucket are joined, and nothing but true pairs
        assert got[i] == got[least[i]] and most[i] == most[got[i]]
    assert sum(got[i] == 0 for i in range(151)) > 120


def closed(n, links):
    """The least member of each one's class."""
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in links:
        a, b = sorted((root(i), root(j)))
        parent[b] = a
    return [root(i) for i in range(n)]


def test_crowded_bucket_of_unlike_texts(spark):
    """Hundreds of texts around one passage, among them near pairs that share no rare word with others."""
    rng = random.Random(25)
    passage = "this text is licensed under the same general terms as all of the others".split()
    own, pairs = [], []
    for i in range(150):
        text = passage + [f"t{i}-{j}" for j in range(rng.randint(6, 25))]
        own.append(text)
        if i % 5 == 0:
            pairs.append((len(own) - 1, len(own)))
            own.append(altered(rng, text, 0.1))
    own = [" ".join(t) for t in own]
    got = {r.doc_id: r.class_id for r in ordermin.near_duplicates(frame(spark, own)).collect()}
    links = [(i, j) for i in range(len(own)) for j in range(i) if ordermin.similar(hashed(own[i]), hashed(own[j]))]
    want = closed(len(own), links)
    assert [got[i] for i in range(len(own))] == want and all(got[a] == got[b] for a, b in pairs)


def test_one_id_with_unlike_texts_and_clashing_columns(spark):
    rows = [(5, "one text of its own with some words in it"), (5, "quite another that nobody else has written down"), (7, "a third which is like neither of the two others"), (8, "a third which is like neither of the two others"), (5, "one text of its own with some words in it"), (None, "a third which is like neither of the two others"), (9, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for name in ("kept_id", "kept_own", "own", "label", "__kept", "id", "node", "class_id", "Kept_Own_"):
        df = df.withColumn(name, F.lit("x"))
    out = ordermin.keep_first(df)
    assert out.columns == df.columns
    assert sorted(((r.doc_id or 0), r.text or "") for r in out.collect()) == sorted([(5, rows[0][1]), (5, rows[1][1]), (7, rows[2][1]), (0, rows[2][1]), (9, "")])


def test_text_that_only_null_ids_have(spark):
    text = " ".join(f"w{i}" for i in range(40))
    got = ordermin.near_duplicates(spark.createDataFrame([(None, text), (None, text), (7, text + " more"), (3, "unlike")], "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id or 0, r.class_id) for r in got) == [(0, 7), (0, 7), (3, 3), (7, 7)]


def test_long_alignment_by_anchors():
    rng = random.Random(26)
    one = ordermin.np.array([rng.randrange(2**32) for _ in range(60_000)], ordermin.np.uint32)
    two = ordermin.np.delete(one, rng.sample(range(len(one)), 6000))
    two[rng.sample(range(len(two)), 3000)] = 1
    assert ordermin.similar(one, two)
    small = [rng.randrange(50) for _ in range(300)]
    for share in (0.05, 0.15, 0.3):  # anchors never claim what the full alignment denies
        other = [x if rng.random() > share else rng.randrange(50) for x in small]
        a, b = (ordermin.np.array(x, ordermin.np.uint32) for x in (small, other))
        assert not ordermin.anchored(a, b, 60) or ordermin.distance(small, other, 60) is not None


def hashed(text):
    words, hashes = ordermin.lowered(text), ordermin.Words()
    return ordermin.np.array([hashes[w] for w in words], ordermin.np.uint64)


def test_profiles_exclude_no_edge():
    rng = random.Random(22)
    for _ in range(500):
        a = [rng.randrange(40) for _ in range(rng.randint(1, 60))]
        b = [x if rng.random() < 0.85 else rng.randrange(40) for x in a][: rng.randint(1, 60)]
        x, y = (ordermin.np.array(t, ordermin.np.uint32) for t in (a, b))
        possible = ordermin.near_profiles([ordermin.profile(x)], [ordermin.profile(y)], [4 * len(a)], [4 * len(b)])[0]
        assert possible or not ordermin.similar(x, y)


def test_short_texts_miss_no_edge(spark):
    rng = random.Random(23)
    own = []
    for n in range(3, 15):
        for _ in range(4):
            base = [f"a{rng.randrange(10**9)}" for _ in range(n)]
            other = list(base)
            for _ in range(max(1, n // 5)):
                at = rng.randrange(len(other))
                match rng.randrange(3):
                    case 0:
                        other[at] = "changed"
                    case 1:
                        del other[at]
                    case _:
                        other.insert(at, "more")
            own += [" ".join(base), " ".join(other)]
    own = [t for t in own if len(t.split()) <= ordermin.FEW]
    got = {r.doc_id: r.class_id for r in ordermin.near_duplicates(frame(spark, own)).collect()}
    assert [got[i] for i in range(len(own))] == classes_by_hand(own)


def test_recall_at_the_least_similarity():
    rng = random.Random(24)
    missed = 0
    for _ in range(200):
        one = [f"b{rng.randrange(10**9)}" for _ in range(200)]
        a, b = (set(ordermin.bucket_keys(hashed(" ".join(t))).tolist()) for t in (one, altered(rng, one, 0.2)))
        missed += not a & b
    assert missed < 25


def test_recall_on_documents(spark):
    """Of all pairs of the test documents that align within the threshold, found by brute force, at least nine in ten are in one class."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    hashes = ordermin.Words()
    own = {}
    for r in rows:
        words = ordermin.lowered(r.text)
        if words:
            own[r.doc_id] = ordermin.np.array([hashes[w] for w in words], ordermin.np.uint64).astype(ordermin.np.uint32)
    ids = sorted(own)
    profiles, sizes = [ordermin.profile(own[i]) for i in ids], [4 * len(own[i]) for i in ids]
    links = []
    for k, i in enumerate(ids[:-1]):
        rest = ids[k + 1 :]
        ok = ordermin.near_profiles([profiles[k]] * len(rest), profiles[k + 1 :], [sizes[k]] * len(rest), sizes[k + 1 :])
        links += [(i, rest[j]) for j in ordermin.np.flatnonzero(ok).tolist() if ordermin.similar(own[i], own[rest[j]])]
    got = {r.doc_id: r.class_id for r in ordermin.near_duplicates(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()}
    found = sum(got[a] == got[b] for a, b in links)
    print(f"{found} of {len(links)} true pairs in one class")
    assert len(links) > 50 and found >= 0.9 * len(links)
