"""Spelling variants, likeness to trusted texts, ranked search: against brute force, and on odd input."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from pageloom.llm import domain_rules, ranked, spelling
from pageloom.session import Scratch


def _near(a, b):
    """Exactly one letter put in, taken out or changed."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _variants(rows, every):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    near = {w: [v for v in words if _near(w, v)] for w in words}
    best = {w: min(v, key=lambda x: (-words[x], x)) if v else None for w, v in near.items()}
    form = {w: b if b and words[b] >= 5 * words[w] else None for w, b in best.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items())


def test_spelling(spark):
    rng = np.random.default_rng(4)
    stems = ["".join(rng.choice(list("abcé"), n)) for n in (6, 6, 7, 7, 8, 9, 12) for _ in range(12)]
    words = []
    for stem in stems:
        words += [stem] * int(rng.integers(5, 200))
        for _ in range(3):
            i = int(rng.integers(len(stem)))
            words += [stem[:i] + str(rng.choice(["", "a", "bÉ", "x"])) + stem[i + 1 :]] * int(rng.integers(1, 12))
    # A run that goes on below others, chains of forms, ties, and letters beside the class.
    words += ["aaaaaa"] * 500 + ["aaaaaaa"] * 90 + ["aaaaaaaa"] * 15 + ["Bbbbbbb"] * 6 + ["ÀÀÀÀÀÀ", "àààààà"] * 6 + ["z" * 5000] * 40 + ["z" * 4999] * 5 + ["a1aaaaaa"] * 5
    rng.shuffle(words)
    rows = [(i if i % 7 else None, " ".join(words[i * 40 : i * 40 + 40])) for i in range(len(words) // 40 + 1)] + [(1, None), (2, ""), (2, "short"), (3, "aaaaaa aaaaab")] * 2
    docs = spark.createDataFrame([(d, t, "w", 3) for d, t in rows], "doc_id long, text string, word string, n int")
    for every in (199, 7):
        got = sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(docs, every).collect())
        assert got == _variants(rows, every)
    assert spelling.variants(docs.limit(0)).count() == 0
    assert spelling.variants(docs).columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_trie_walk_of_any_words(spark):
    """All pairs, of words of any length, from the same few letters."""
    rng = np.random.default_rng(8)
    words = sorted({"".join(rng.choice(list("ab"), rng.integers(1, 9))) for _ in range(250)})
    run = Scratch(spark)
    got = {(r.word, r.near) for r in spelling.neighbours(spark.createDataFrame([(w, 1) for w in words], "word string, n long"), run).collect()}
    run.drop()
    assert got == {(a, b) for a in words for b in words if _near(a, b)}


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def _hash(value, seed=42):
    xxhash = pytest.importorskip("xxhash")
    return xxhash.xxh64_intdigest(value, seed)


def _slots(text):
    h = [_hash(w.encode()) for w in _words(text)]
    pairs = [_hash(b.to_bytes(8, "little"), _hash(a.to_bytes(8, "little"))) for a, b in zip(h, h[1:], strict=False)]
    return [x % domain_rules.SLOTS for x in h + pairs]


def _base(text):
    words, text = _words(text), text or ""
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    counts = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if _words(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_domain_rules(spark):
    rng = np.random.default_rng(1)
    clean = ["".join(rng.choice(list("abcdeé"), 5)) for _ in range(300)]
    spam = ["".join(rng.choice(list("XYZ#$"), 4)) for _ in range(60)]
    texts = [" ".join(rng.choice(clean, 80)) for _ in range(60)] + [" ".join(rng.choice(spam, 70)) for _ in range(25)]
    loop = " ".join(clean[:9])
    texts += [None, "", " \n\t ", "a b c", " ".join([loop] * 4), f"{' '.join(clean[:40])} {' '.join(clean[:20])}", "x\ny\nx\n \n\nx \ny", "one two " * 3000, "a\x0bb\x1cc | d"]
    rows = [(i if i % 11 else None, t, "k", 1) for i, t in enumerate(texts)] + [(1, texts[2], "k", 1)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, score int")
    labels = spark.createDataFrame([(i, 1) for i in range(1, 50)] + [(i, 0) for i in range(60, 85)] + [(None, 1), (1, 1), (5, None)], "doc_id long, quality int")
    got = domain_rules.judged(docs, labels)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    raw, target = np.zeros(domain_rules.SLOTS), np.zeros(domain_rules.SLOTS)
    for doc_id, text, *_ in rows:
        for s in _slots(text):
            raw[s] += 1
            target[s] += doc_id in range(1, 50)
    weight = np.log((target + domain_rules.PRIOR) / (raw * target.sum() / raw.sum() + domain_rules.PRIOR))
    want = []
    for doc_id, text, *_ in rows:
        n_words, chars, symbols, lines, repeated = _base(text)
        slots = _slots(text)
        score = float(np.mean(weight[slots])) if slots else 0.0
        failed = n_words < 20 or 100 * repeated > 30 * n_words
        want.append((doc_id, n_words, chars, symbols, lines, repeated, failed, round(score, 9), not failed and score >= domain_rules.CUT))
    found = [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in got.collect()]
    assert sorted(found, key=str) == sorted(want, key=str)
    kept = {r.doc_id: r.kept for r in got.collect()}
    assert all(kept[i] for i in range(1, 60) if i % 11) and not any(kept[i] for i in range(60, 85) if i % 11)
    assert domain_rules.judged(docs.limit(0), labels).count() == 0
    assert {r.score for r in domain_rules.judged(docs, labels.limit(0)).collect()} == {0.0}


def test_domain_rules_of_given_texts(spark):
    """Labelled documents that were not trusted: the good stay, most bad ones go."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    learnt = labels.where("pmod(xxhash64(doc_id), 2) = 0")
    rows = domain_rules.judged(docs, learnt).join(labels.where("pmod(xxhash64(doc_id), 2) = 1"), "doc_id").where("NOT base_failed").collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.2


def _ranks(docs, items, top):
    terms = lambda t: re.findall("[0-9a-z\u0080-\U0010ffff]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    found = [(d, Counter(terms(t))) for d, t in docs]
    n_docs, n_terms = sum(1 for _, c in found if c), sum(c.total() for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in found:
            if c:
                m = 100 - 50 + (50 * c.total() * n_docs) // n_terms
                s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
                if s > 0:
                    scored.append((-s, d is None, d or 0, d))
        out += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


def test_ranked(spark, monkeypatch):
    rng = np.random.default_rng(6)
    vocabulary = ["w%d" % i for i in range(150)] + ["é", "naïve", "漢字", "ÀB", "x-y"]
    docs = [(i, " ".join(rng.choice(vocabulary, rng.integers(1, 60)))) for i in range(150)]
    docs += [(i + 150, docs[i % 9][1]) for i in range(60)] + [(None, docs[0][1]), (7, docs[0][1]), (900, None), (901, ""), (902, "..."), (903, "w1 " * 20_000)]
    items = [(i, " ".join(rng.choice(vocabulary, rng.integers(1, 30)))) for i in range(12)] + [(20, None), (21, "nowhere"), (22, docs[0][1].upper()), (3, "w1 w2"), (None, "w5")]
    frame = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, rank int, slots string").repartition(5)
    bench = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, score int")
    want = _ranks(docs, items, 50)
    assert sorted(map(tuple, ranked.search(frame, bench).collect()), key=str) == want
    monkeypatch.setattr(ranked, "BLOCK_ITEMS", 5)
    assert sorted(map(tuple, ranked.search(frame, bench, top=3).collect()), key=str) == _ranks(docs, items, 3)
    assert ranked.search(frame.limit(0), bench).count() == ranked.search(frame, bench.limit(0)).count() == 0


def test_tiles_and_ties():
    """Tiles of the vocabulary add up; what does not fit is dropped only where it can't be among the best."""
    rng = np.random.default_rng(2)
    best = ranked.Best(3, 4)
    scores = rng.integers(0, 5, (3, 400))
    ids = rng.permutation(400)
    old, ranked.HELD = ranked.HELD, 30
    for at in range(0, 400, 25):
        best.add(scores[:, at : at + 25], ids[at : at + 25], np.zeros(25, bool))
    ranked.HELD = old
    item, score, _, doc = best.shrink()
    got = [(int(i), int(s), int(d)) for i, s, d in zip(item, score, doc, strict=True)]
    want = [(i, int(scores[i, k]), int(ids[k])) for i in range(3) for k in sorted(range(400), key=lambda k: (-scores[i, k], ids[k]))[:4]]
    assert got == want
    assert ranked.TILE * 2**36 <= 2**53 and 45_000 * 10**6 < 2**36


def test_paths_of_the_trie(spark):
    """A text's own way is known without a walk: from the root, by nodes where words part, to its own node."""
    run = Scratch(spark)
    words = spark.createDataFrame([("abcd", 0, 1), ("abce", 0, 1), ("ab", 0, 1)], "text string, root long, n long")
    _, ends, paths = spelling.trie(words, run)
    own = {r.text: r.node for r in ends.collect()}
    got = {r.text: [(p["at"], p["node"]) for p in r.path] for r in paths.collect()}
    run.drop()
    assert {t: [at for at, _ in p] for t, p in got.items()} == {"abcd": [0, 2, 3, 4], "abce": [0, 2, 3, 4], "ab": [0, 2]}
    assert all(p[0][1] == 0 and p[-1][1] == own[t] for t, p in got.items()) and got["abcd"][1][1] == own["ab"]
