"""Operators against brute force, libraries and exact round trips."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from tokenizers import Tokenizer

import corpus_pipeline
from foliant.llm import bpe, langid, lattice, ordermin, perplexity, quality, quotes, substring, tokens, winnow

JSON, MODEL, RANKS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken"))
ODD = ["", " ", "a", "Hello  world\n\nfoo", "it's we've I'll 'd", "tab\tand \r\n mix  ", "naïve café ß ﬁ 东京 🙂🙂", "a<|endoftext|>b <|endoftext|>", "x" * 300, " lead", "trail ", "1234 5,6", "　wide space ", "A\x00B", "don't'll", "    four", "'re\n've", "é combining"]
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def texts(spark, sf):
    return [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]


def frame(spark, own):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(own)], DOCS).repartition(3)


def made(seed, n=60, most=120):
    rng = random.Random(seed)
    return [" ".join(rng.choice("abcdefghij") * rng.randint(1, 4) for _ in range(rng.randint(0, most))) for _ in range(n)]


# -- 2 ------------------------------------------------------------------------------------------------------------------


def contaminated_by_hand(docs, items, window=10):
    words = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) if w]
    out = {}
    for i, text in docs:
        own, hit, found = words(text), set(), set()
        for item, t in items:
            w = words(t)
            n = min(window, len(w))
            spans = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
            for k in range(len(own) - n + 1) if n else ():
                if tuple(own[k : k + n]) in spans:
                    hit |= set(range(k, k + n))
                    found.add(str(item))
        out[i] = (len(own), len(hit), sorted(found))
    return out


@pytest.mark.parametrize(("broadcast", "bits"), [(200_000, 22), (0, 12)])
def test_winnowing(spark, monkeypatch, broadcast, bits):
    """The same rows whatever is broadcast and however full the bitmap is."""
    monkeypatch.setattr(winnow, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(winnow, "MOST_BITS", bits)
    rng = random.Random(2)
    items = [(i, " ".join(rng.choice(["al", "be", "Ga", "de", "eé"]) for _ in range(n))) for i, n in enumerate([0, 1, 3, 9, 10, 11, 25, 40, 40])] + [(20, None)]
    own = [(i, " ".join(rng.choice(["AL", "be", "ga", "de,", "eé"]) for _ in range(rng.randint(0, 80)))) for i in range(40)]
    own += [(100 + k, f"start {t} end. {t}") for k, (_, t) in enumerate(items) if t]
    got = winnow.contamination(spark.createDataFrame(own, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in got} == contaminated_by_hand(own, items)


# -- 3, 5 ---------------------------------------------------------------------------------------------------------------


def test_token_counts(spark, sf):
    own = ODD + texts(spark, sf)[:60]
    library = Tokenizer.from_file(JSON)
    want = [len(e.ids) for e in library.encode_batch(own, add_special_tokens=False)]
    got = {r.doc_id: r for r in tokens.token_counts(frame(spark, own), JSON, 100).collect()}
    assert [got[i].n_tokens for i in range(len(own))] == want
    assert [got[i].n_bytes for i in range(len(own))] == [len(t.encode()) for t in own]
    assert [got[i].over_limit for i in range(len(own))] == [n > 100 for n in want]


def test_prefix_counts(spark):
    own = [t for t in ODD if len(t) < 60]
    library = Tokenizer.from_file(JSON)
    got = {r.doc_id: r.prefix_tokens for r in tokens.token_prefixes(frame(spark, own), JSON).collect()}
    for i, t in enumerate(own):
        assert got[i] == [len(library.encode(t[:k], add_special_tokens=False).ids) for k in range(len(t) + 1)], t
    stored = frame(spark, own).join(tokens.token_prefixes(frame(spark, own), JSON), "doc_id")
    for r in tokens.truncated(stored, 3).collect():
        assert own[r.doc_id].startswith(r.text) and len(library.encode(r.text, add_special_tokens=False).ids) <= 3


def test_bpe_round_trip(spark, sf):
    own = ODD + texts(spark, sf)[:60]
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in bpe.encode_documents(frame(spark, own), RANKS, public_tokenizers.PATTERN).collect()}
    plain = {r.doc_id: r for r in bpe.encode_documents(frame(spark, own), RANKS, public_tokenizers.PATTERN, digest=False).collect()}
    for i, t in enumerate(own):
        ids = library.encode_ordinary(t)
        assert plain[i].ids == ids and bytes(plain[i].decoded) == t.encode()
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


# -- 4, 8: held-out accuracy ----------------------------------------------------------------------------------------------


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.predict_languages(docs, langid.fit(docs)).join(docs.select("doc_id", "lang", "text"), "doc_id").filter("held_out AND lang IS NOT NULL AND length(text) > 100").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97


def test_quality_auc(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    got = quality.quality_scores(docs, quality.fit(docs, labels)).filter("held_out").join(labels, "doc_id").collect()
    good, bad = ([r.score for r in got if r.quality == q] for q in (1, 0))
    assert good and bad and np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.9
    assert all(r.predicted == int(r.score >= 0.7) for r in got)


# -- 6 ------------------------------------------------------------------------------------------------------------------


def base_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 10 or 100 * len(hit) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit), failed


def grams_by_hand(text):
    padded = "    " + "".join(" " if ord(c) <= 32 else "0" if c in "0123456789" else c for c in text.lower()) + " "
    return [padded[i : i + 5] for i in range(len(padded) - 4)]


def kneser_ney_by_hand(texts):
    """p of each 5-gram of some texts of one language, with dictionaries."""
    counts = {5: Counter(g for t in texts for g in grams_by_hand(t))}
    for k in (4, 3, 2, 1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    below = {"": 1 / len(counts[1])}
    for k in (1, 2, 3, 4, 5):
        own = counts[k]
        n = [sum(c == i for c in own.values()) for i in range(5)]
        d = [0.5, 1.0, 1.5]
        if all(n[1:5]):
            y = n[1] / (n[1] + 2 * n[2])
            est = [i - (i + 1) * y * n[i + 1] / n[i] for i in (1, 2, 3)]
            if all(0 < x < i for i, x in enumerate(est, 1)):
                d = est
        d = [1.0 if k >= 3 else d[0], *d[1:]]
        less = {g: d[min(c, 3) - 1] for g, c in own.items()}
        total, mass = Counter(), Counter()
        for g, c in own.items():
            total[g[:-1]] += c
            mass[g[:-1]] += less[g]
        below = {g: (c - less[g] + mass[g[:-1]] * below[g[1:]]) / total[g[:-1]] for g, c in own.items()}
    return below


def rules_by_hand(rows, reach=3.0, slack=0.25):
    """(kept, perplexity) of each (text, lang)."""
    logs, entropy = {}, []
    for lang in {x for _, x in rows}:
        texts = [t for t, x in rows if x == lang and t]
        logs[lang] = kneser_ney_by_hand(texts) if texts else {}
    for t, lang in rows:
        entropy.append(round(-sum(math.log(logs[lang][g]) for g in grams_by_hand(t)) / len(grams_by_hand(t)), 4) if t else None)
    out = []
    for (t, lang), e in zip(rows, entropy, strict=True):
        own = sorted(x for (u, y), x in zip(rows, entropy, strict=True) if y == lang and u and not base_by_hand(u)[5])
        inside = True
        if own and e is not None:
            q1, q3 = (own[math.ceil(len(own) * q) - 1] for q in (0.25, 0.75))
            wide = max(reach * (q3 - q1), slack)
            inside = q1 - wide <= e <= q3 + wide
        out.append((not base_by_hand(t)[5] and inside, math.exp(e) if e is not None else None))
    return out


def sentences(seed, n):
    """Texts with a word order."""
    rng = random.Random(seed)
    say = lambda: f"the {rng.choice(NOUNS)} of the {rng.choice(NOUNS)} will {rng.choice(VERBS)} every {rng.choice(NOUNS)} in the {rng.choice(NOUNS)}."
    return [" ".join(say() for _ in range(rng.randint(4, 9))) for _ in range(n)]


NOUNS = ["river", "house", "teacher", "window", "garden", "engine", "letter", "market", "forest", "doctor", "bridge", "harbour", "kitchen", "village"]
VERBS = ["follow", "answer", "carry", "paint", "repair", "describe", "measure", "visit"]


def shuffled(text, seed):
    letters = list(text)
    random.Random(seed).shuffle(letters)
    return "".join(letters)


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_quality_rules(spark, sf, broadcast):
    own = [(t, "en") for t in sentences(1, 120)] + [(shuffled(t, i), "en") for i, t in enumerate(sentences(2, 6))]
    own += [(t, "de") for t in made(6)] + [("a b c d e f g h i j\na b c d e f g h i j\n\n \n#|<", None), ("one two three four five " * 4, None), (None, "en"), ("", None), ("x", "zz")]
    own += [(t, "und") for t in ODD] + [(t, "x") for t in texts(spark, sf)[:60]]
    df = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(own)], "doc_id bigint, text string, lang string").repartition(3)
    got = {r.doc_id: r for r in perplexity.quality_rules(df, broadcast_grams=broadcast).collect()}
    want = rules_by_hand(own)
    for i, (t, _) in enumerate(own):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_by_hand(t), t
        assert r.kept == want[i][0], t
        assert (r.perplexity is None) == (want[i][1] is None) and (r.perplexity is None or math.isclose(r.perplexity, want[i][1], rel_tol=2e-3)), t
    kept = [got[i].kept for i in range(126) if not got[i].base_failed]
    assert len(kept) > 90 and all(kept[:-6]) and not any(kept[-6:])  # shuffled letters are rejected


def test_scripts_differ(spark):
    """Texts of other scripts are scored by their wording: shuffled letters are less likely and rejected."""
    greek = str.maketrans("abcdefghijklmnopqrstuvwxyz", "αβγδεζηθικλμνξοπρστυφχψωάέ")
    plain = [t.translate(greek) for t in sentences(3, 120)]
    own = plain + [shuffled(t, i) for i, t in enumerate(plain[:5])]
    got = {r.doc_id: r for r in perplexity.quality_rules(frame(spark, own)).collect()}
    assert all(got[i].kept or got[i].base_failed for i in range(120)) and sum(got[i].kept for i in range(120)) > 90
    assert not any(got[i].kept for i in range(120, 125))


def test_long_texts_in_pieces(monkeypatch):
    """A text cut into pieces has the n-grams of the whole."""
    text = " ".join(sentences(4, 30))
    monkeypatch.setattr(perplexity, "PIECE", 97)
    monkeypatch.setattr(perplexity, "DENSE", 500)
    counts = Counter()
    for _, _, g in perplexity.pieces(["x", "x"], [text, None]):
        for p, n in zip(g.points, g.counts.tolist(), strict=True):
            counts["".join(map(chr, p))] += n
    assert counts == Counter(grams_by_hand(text))


# -- 7 ------------------------------------------------------------------------------------------------------------------


def test_lattice(spark):
    own = ["the cat sat", "The Cat", "", "naïve 🙂", "a a a cat"] + made(8, 20, most=20)
    rows = frame(spark, own)
    got = {r.doc_id: r for r in lattice.lattice_scores(rows, MODEL).collect()}
    held = {i for i in range(len(own)) if zlib.crc32(str(i).encode()) % 7 == 2}
    lower = lambda t: re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
    counts = Counter(w for i, t in enumerate(own) if i not in held for w in [*lower(t), None])
    n, v = sum(counts.values()), len(counts)
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    pieces = Counter(p for w, c in counts.items() if w for p in sp.encode(w) for _ in range(c))
    logs, end = lattice.piece_logs(MODEL, pieces, counts[None])
    names = lattice.vocabulary(MODEL)[1]
    prob = {p: math.exp(logs[i]) for i, p in enumerate(names) if p is not None and not sp.is_byte(i)}
    spelled = {int(p[3:5], 16): math.exp(logs[i]) for i, p in enumerate(names) if sp.is_byte(i)}

    def total(s):  # the sum over all segmentations, in the open
        f = [1.0] + [0.0] * len(s)
        for j in range(1, len(s) + 1):
            f[j] = sum(f[i] * prob.get(s[i:j], 0.0) for i in range(j))
            if s[j - 1] not in prob:
                f[j] += f[j - 1] * math.prod(spelled[b] for b in s[j - 1].encode())
        return f[-1]

    for i, t in enumerate(own):
        r, ws = got[i], lower(t)
        assert r.held_out == (i in held) and r.train_tokens == n and r.n_tokens == len(ws) + 1
        assert r.n_known == sum(counts[w] > 0 for w in [*ws, None])
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in [*ws, None]), rel_tol=1e-9)
        want = end / math.log(10) + sum(math.log10(total(lattice.MARK + w)) for w in ws)
        assert math.isclose(r.score, want, rel_tol=1e-9, abs_tol=1e-9), t


# -- 9 ------------------------------------------------------------------------------------------------------------------


def removed_by_hand(own, size):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in own]
    windows = Counter(tuple(w[i : i + size]) for w in words for i in range(len(w) - size + 1))
    return [[x for k, x in enumerate(w) if not any(0 <= i <= len(w) - size and windows[tuple(w[i : i + size])] > 1 for i in range(k - size + 1, k + 1))] for w in words], words


@pytest.mark.parametrize("size", [35, 6])
def test_repeated_windows(spark, size):
    rng = random.Random(9)
    own = [" ".join(str(rng.randint(0, 10**6)) for _ in range(rng.randint(0, 90))) for _ in range(30)]
    own += [f"{own[3]}\n {own[4]} x {own[3]}", own[5], own[5], " ".join(["la"] * 80), None]
    kept, words = removed_by_hand(own, size)
    got = {r.doc_id: r for r in substring.remove_repeats(frame(spark, own), size, keep_text=False).collect()}
    for i, k in enumerate(kept):
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(words[i]), len(words[i]) - len(k), hashlib.sha256(" ".join(k).encode()).hexdigest()), i


# -- 10 -----------------------------------------------------------------------------------------------------------------


def classes_by_hand(own):
    words = [(t or "").lower().split() for t in own]

    def far(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    of = list(range(len(own)))
    for i in range(len(own)):
        for j in range(i):
            if words[i] and words[j] and far(words[i], words[j]) <= int(0.2 * max(len(words[i]), len(words[j])) + 1e-9):
                a, b = of[i], of[j]
                of = [min(a, b) if x in (a, b) else x for x in of]
    return of


def test_near_duplicates(spark):
    rng = random.Random(10)
    base = [[str(rng.randint(0, 10**6)) for _ in range(rng.randint(60, 120))] for _ in range(12)]
    own = [" ".join(b) for b in base]
    for b in base[:8]:
        for _ in range(3):
            c = list(b)
            for _ in range(2):
                c[rng.randrange(len(c))] = "changed"
            own.append(" ".join(c))
    own += [own[0].upper() if own[0].isalpha() else own[0], own[1] + "  ", "", None, "short text", "short text", " ".join(reversed(base[2]))]
    got = {r.doc_id: r.class_id for r in ordermin.near_duplicates(frame(spark, own)).collect()}
    assert [got[i] for i in range(len(own))] == classes_by_hand(own)


def test_distance_against_table():
    rng = random.Random(11)
    for _ in range(300):
        a, b = ([rng.randint(0, 3) for _ in range(rng.randint(0, 30))] for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        for most in (0, 3, 8, 40):
            assert ordermin.distance(a, b, most) == (row[-1] if row[-1] <= most else None)


# -- the pipeline -------------------------------------------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    """Stage by stage against what brute force leaves of the stage's own input."""
    rng = random.Random(12)
    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("length(text) between 200 and 4000").orderBy("doc_id").limit(40).collect()
    passage = " ".join(str(rng.randint(0, 10**6)) for _ in range(60))
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in source]
    top = max(r[0] for r in rows) + 1
    rows += [(top, rows[0][1] + " end", "en", "s", 0), (top + 1, rows[1][1] + " " + passage, "en", "s", 0), (top + 2, rows[2][1][: len(rows[2][1]) // 2] + " " + passage + " " + rows[3][1][: len(rows[3][1]) // 2], "en", "s", 0), (top + 3, None, None, "s", 0), (top + 4, "12 34", None, "s", 0)]
    item = " ".join(rows[5][1].split()[3:30])
    folder = str(tmp_path)
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    one = corpus_pipeline.identify_language(spark, docs, folder)
    ids = {r.doc_id for r in one.collect()}
    assert ids == {r[0] for r in rows} - {top + 3, top + 4}
    two = corpus_pipeline.drop_near_duplicates(spark, one, folder)
    own = sorted((r.doc_id, r.text) for r in one.collect())
    classes = classes_by_hand([t for _, t in own])
    assert {r.doc_id for r in two.collect()} == {own[c][0] for c in set(classes)}
    three = corpus_pipeline.drop_repeated_passages(spark, two, folder)
    own = sorted((r.doc_id, r.text) for r in two.collect())
    kept, words = removed_by_hand([t for _, t in own], 35)
    assert {r.doc_id: r.text for r in three.collect()} == {i: (" ".join(k) if len(k) < len(w) else t) for (i, t), k, w in zip(own, kept, words, strict=True)}
    four = corpus_pipeline.drop_contaminated(spark, three, folder)
    hits = contaminated_by_hand([(r.doc_id, r.text) for r in three.collect()], [(1, item)])
    assert {r.doc_id for r in four.collect()} == {i for i, (_, n, _) in hits.items() if not n}
    assert one.columns == two.columns == three.columns == four.columns == docs.columns
    out = corpus_pipeline.run(spark, folder).collect()
    texts = {r.doc_id: r.text for r in four.collect()}
    assert {r.doc_id: r.decoded_sha256 for r in out} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts.items()}


# -- 1 ------------------------------------------------------------------------------------------------------------------


def normal_by_hand(line):
    return re.sub(r"[ \t]+", " ", re.sub(r"^(?:[ \t]*>)+", "", line).lower()).strip()


def level_by_hand(line):
    return re.match(r"(?:[ \t]*>)*", line)[0].count(">")


def passages_by_hand(text):
    """(level, normal lines) of each run of lines on one level."""
    out, last = [], None
    for x in text.split("\n"):
        now = (level_by_hand(x), normal_by_hand(x))
        if now[1]:
            if last is None or last[0] != now[0]:
                out.append((now[0], []))
            out[-1][1].append(now[1])
        last = now if now[1] else None
    return out


def links_by_hand(rows):
    """(parent, thread, depth, linked lines) of each (conv, turn); rows in order of turns."""
    want = {}
    for c, t, _, text in rows:
        said = {}
        for d, u, _, s in rows:
            if d == c and u < t:
                for level, norms in passages_by_hand(s):
                    if not level:
                        said |= dict.fromkeys([" ".join(norms), *norms], u)
        quoted = []
        for level, norms in passages_by_hand(text):
            if level:
                whole = said.get(" ".join(norms))
                quoted += [(level, said.get(x) if whole is None else whole) for x in norms]
        votes = Counter(s for n, s in quoted if n == 1 and s is not None)
        parent = max(votes, key=lambda s: (votes[s], s)) if votes else None
        root, depth = (want[c, parent][1], want[c, parent][2] + 1) if parent is not None else (t, 0)
        want[c, t] = (parent, root, depth, sum(s is not None for _, s in quoted))
    return want


def test_quotes_by_hand(spark):
    rng = random.Random(1)
    rows = []
    for c in range(8):
        said = []
        for t in range(12):
            parts = [[f"line {rng.randint(0, 30)} of  it" for _ in range(rng.randint(1, 3))] for _ in range(2)]
            lines = [x for part in parts for x in [*part, ""]]
            if said and rng.random() < 0.8:
                marks, part = "> " * rng.randint(1, 2), rng.choice(said)
                words = " ".join(part).upper().split()
                match rng.randrange(3):
                    case 0:  # wrapped anew
                        lines = [marks + " ".join(words[:2]), marks + " ".join(words[2:]), *lines]
                    case 1:
                        lines = [marks + x for x in part] + lines
                    case 2:
                        lines = [marks + rng.choice(part), marks + "and more", ">", *lines]
            said += parts
            rows.append((c, t, "user", "\n".join(lines)))
    got = quotes.link_quotes(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()
    assert {(r.conv_id, r.turn): (r.parent_turn, r.thread_turn, r.depth, r.n_linked) for r in got} == links_by_hand(rows)


def test_passages_before_lines(spark):
    """A passage that one turn holds whole goes there, though a later turn has one of its lines; a wrapped one is found."""
    rows = [(1, 0, "user", "thanks\nthe tide turns at nine"), (1, 1, "user", "thanks"), (1, 2, "user", "> Thanks\n> the tide turns at nine\nso it does"), (1, 3, "user", "> so  it\n> does\nwell"), (1, 4, "user", "> thanks\nno worries")]
    got = {r.turn: r for r in quotes.link_quotes(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()}
    assert [got[t].parent_turn for t in range(5)] == [None, None, 0, 2, 1] and got[3].text == "well"
