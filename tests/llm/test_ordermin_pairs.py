"""Order MinHash: how much is left to compare in groups of hard pairs, and keys of many texts at once."""

import random

from test_ordermin_whole import hashed

from foliant.llm import ordermin

np = ordermin.np


def test_pairs_of_texts_that_repeat_one_phrase(spark):
    """Texts that are four fifths one phrase all share rarest words; pairs too far apart go before they are compared, no edge does."""
    rng = random.Random(31)
    vocabulary = [f"v{i}" for i in range(3000)]
    own = []
    for _ in range(80):
        n = rng.randint(130, 150)
        own.append([f"o{rng.choice(vocabulary)}" for _ in range(n)] + ["is", "onhe."] * rng.randint(170, 200))
        if rng.random() < 0.2:
            own.append([w if rng.random() < 0.9 else "else" for w in own[-1]])
    words = [hashed(" ".join(t)).astype(np.uint32) for t in own]
    crowd = spark.createDataFrame([(bytes([i]), bytes([i]), w.tobytes()) for i, w in enumerate(words)], "node binary, label binary, words binary")
    got = {(r.root[0], r.node[0]) for r in ordermin.rare_pairs(crowd, ordermin.THRESHOLD).collect()}
    every = [(i, j) for j in range(len(own)) for i in range(j)]
    edges = {(i, j) for i, j in every if ordermin.similar(words[i], words[j])}
    assert len(edges) > 10 and edges <= got
    assert len(got) < 0.5 * len(every)


def join_rows(df, found):
    """Rows that each inner join of an executed plan made."""

    def walk(node):
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            return walk(node.executedPlan())
        if "QueryStage" in name:
            return walk(node.plan())
        if "Join" in name and "Inner" in node.simpleString(1000):
            found.append(node.metrics().apply("numOutputRows").value())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return found


def test_rows_of_texts_that_repeat_one_phrase(spark):
    """Texts of 300 times one pair of words after words of a language: two of them meet about once at most, not at each rare word that they share; every edge is found."""
    rng = random.Random(34)
    weights = [1 / (k + 3) for k in range(4000)]
    own = [rng.choices(range(4000), weights, k=rng.randint(140, 260)) + [5000, 5001] * 300 for _ in range(150)]
    for text in own[:20]:
        own.append([w if rng.random() < 0.9 else 6000 for w in text])
    words = [ordermin.mixed(np.array(t, np.uint64) + np.uint64(1)).astype(np.uint32) for t in own]
    crowd = spark.createDataFrame([(bytes([i]), bytes([i]), w.tobytes()) for i, w in enumerate(words)], "node binary, label binary, words binary")
    pairs = ordermin.rare_pairs(crowd, ordermin.THRESHOLD)
    got = {(r.root[0], r.node[0]) for r in pairs.collect()}
    every = [(i, j) for j in range(len(own)) for i in range(j)]
    edges = {(i, j) for i, j in every if ordermin.similar(words[i], words[j])}
    assert len(edges) > 20 and edges <= got
    assert 0 < sum(join_rows(pairs, [])) < 2 * len(every)


def test_edges_among_few_words(spark):
    """Texts of few words, with phrases and repeats, in classes of several: no edge between classes is lost."""
    rng = random.Random(35)
    own = []
    for _ in range(40):
        base = [rng.randrange(12) if rng.random() < 0.8 else rng.randrange(10**6) for _ in range(rng.randint(1, 60))]
        at = rng.randint(0, len(base))
        base[at:at] = [20, 21] * rng.randint(0, 40)
        for _ in range(4):
            text = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 4)):
                p = rng.randrange(len(text))
                text[p : p + rng.randint(0, 1)] = [rng.randrange(24)] * rng.randint(0 if len(text) > 1 else 1, 1)
            own.append(text)
    words = [np.array(t, np.uint32) for t in own]
    labels = [rng.randrange(100) for _ in own]
    crowd = spark.createDataFrame([(bytes([i]), bytes([k]), w.tobytes()) for i, (k, w) in enumerate(zip(labels, words, strict=True))], "node binary, label binary, words binary")
    got = {(r.root[0], r.node[0]) for r in ordermin.rare_pairs(crowd, ordermin.THRESHOLD).collect()}
    edges = {(i, j) for j in range(len(own)) for i in range(j) if labels[i] != labels[j] and ordermin.similar(words[i], words[j])}
    assert len(edges) > 20 and edges <= got


def test_keys_of_many_texts(monkeypatch):
    """Equal to the definition taken a text at a time, with one call for the bands of all."""
    rng = random.Random(33)
    texts = [np.array([rng.randrange(2**63) for _ in range(n)], np.uint64) for n in (1, 2, 3, 4, 5, 6, 14, 15, 60, 300)] + [np.tile(np.arange(7, dtype=np.uint64), 5000)]
    calls = []
    plain = ordermin.bands
    monkeypatch.setattr(ordermin, "bands", lambda s: (calls.append(len(s)), plain(s))[1])
    got = ordermin.keys_of_all(texts)
    assert calls == [len(texts)]
    for h, keys in zip(texts, got, strict=True):
        assert keys.tolist() == ordermin.bucket_keys(h).tolist()
        m = ordermin.kmers(h)
        for i, (mult, flip) in enumerate(ordermin._SEEDS):
            x = (m * mult) ^ flip
            x = (x ^ (x >> np.uint64(33))) * ordermin.MULT
            least = np.zeros(1, np.uint64)
            for at in sorted(np.argsort(x)[: ordermin.KEEP].tolist()):
                least = ordermin.mixed(least * ordermin.STEP + m[at])
            assert least[0] == ordermin.sketches(h)[i]
