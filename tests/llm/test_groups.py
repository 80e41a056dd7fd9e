"""Operators that compare rows: against brute force on small tables, and on odd input."""

import base64
import hashlib
from collections import Counter

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from pageloom.llm import lines, near_dups, quality, trees, warc
from pageloom.llm.components import components
from pageloom.llm.hashing import word_hashes
from pageloom.session import Scratch

SMALL = "/root/testdata/sf0.001"


def _edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_components(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(1, 1), (None, 3), (7, None)] + [(1000, 1001 + i) for i in range(300)] + [(i, i + 1) for i in range(2000, 2040)]
    roots = {}

    def find(x):
        while roots.setdefault(x, x) != x:
            x = roots[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = sorted((find(a), find(b)))
            roots[b] = a
    want = {(x, find(x)) for x in roots if find(x) != x}
    got = components(spark.createDataFrame(edges, "u long, v long"))
    assert {tuple(r) for r in got.select("node", "root").collect()} == want
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_banded_distance():
    rng = np.random.default_rng(0)
    for _ in range(600):
        a = rng.integers(0, 5, rng.integers(0, 25))
        b = a.copy() if rng.random() < 0.6 else rng.integers(0, 5, rng.integers(0, 25))
        for _ in range(rng.integers(0, 4)):
            b = np.delete(b, rng.integers(len(b))) if len(b) and rng.random() < 0.5 else np.insert(b, rng.integers(len(b) + 1), rng.integers(0, 5))
        most, d = int(rng.integers(0, 10)), _edit(a.tolist(), b.tolist())
        assert near_dups.distance(a, b, most) == (d if d <= most else None)
        assert near_dups.similar(a, b) == (d <= 0.2 * max(len(a), len(b)) + 1e-9)
        if len(a) and len(b) and abs(len(a) - len(b)) <= most:
            short, long_ = sorted((a, b), key=len)
            rows = near_dups._by_rows(short, long_, most)
            assert (rows if rows is not None and rows <= most else None) == (d if d <= most else None)


def test_distance_of_long_texts():
    """Halves that changed places, and scattered edits: bounded memory, in seconds."""
    rng = np.random.default_rng(3)
    a = rng.integers(0, 10**6, 20_000)
    b = a.copy()
    b[rng.choice(20_000, 3000, replace=False)] = -1
    assert near_dups.distance(a, b, 4000) == 3000
    assert near_dups.distance(a, np.r_[a[10_000:], a[:10_000]], 4000) is None


def _near_fixture():
    rng = np.random.default_rng(8)
    vocabulary = ["w%d" % i for i in range(400)]
    bases = [list(rng.choice(vocabulary, n)) for n in (30, 80, 200, 60)]
    texts = [" ".join(rng.choice(vocabulary, 50)) for _ in range(40)]
    for base in bases:
        texts += [" ".join(base)] * 3
        for _ in range(12):
            copy = list(base)
            for k in rng.integers(0, len(copy), max(1, len(copy) // 40)):
                copy[k] = str(rng.choice(vocabulary))
            texts.append(" ".join(copy))
    return [*texts, None, "", "...", "one two", "One, two!"]


def test_near_duplicates(spark):
    texts = _near_fixture()
    docs = spark.createDataFrame([(i, t, "q", 1) for i, t in enumerate(texts)], "doc_id long, text string, class_id string, row int")
    got = {r.doc_id: r for r in near_dups.near_duplicates(docs).collect()}
    words = [word_hashes(t) for t in texts]
    parent = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if len(words[a]) == len(words[b]) == 0 or near_dups.similar(words[a], words[b]):
                pa, pb = a, b
                while parent[pa] != pa:
                    pa = parent[pa]
                while parent[pb] != pb:
                    pb = parent[pb]
                parent[max(pa, pb)] = min(pa, pb)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    assert {i: r.class_id for i, r in got.items()} == {i: root(i) for i in range(len(texts))}
    sizes = Counter(root(i) for i in range(len(texts)))
    assert all(r.class_size == sizes[r.class_id] and r.kept == (r.doc_id == r.class_id) for r in got.values())
    kept = near_dups.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(sizes)


def test_near_duplicates_odd_ids(spark):
    rows = [(None, "a b c d e f g"), (5, "a b c d e f g"), (5, "a b c d e f g"), (None, None), (6, "other words stand here now"), (6, "not the same at all, this one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [tuple(r) for r in near_dups.deduplicated(docs).collect()]
    assert sorted(kept, key=str) == sorted([rows[1], rows[3], rows[4], rows[5]], key=str)
    assert near_dups.near_duplicates(docs).count() == len(rows)
    assert near_dups.deduplicated(docs.limit(0)).count() == 0


def _normal(line):
    return regex.sub(r"[^\p{L}\p{N}]+", " ", line.lower()).strip()


def _brute_lines(texts):
    """Kept lines by edit similarity of words alone, all pairs compared."""
    keys = list(dict.fromkeys(n for t in texts if t for n in map(_normal, t.split("\n")) if n))
    root = dict(zip(keys, _groups(keys), strict=True))
    seen, out = set(), []
    for text in texts:
        kept = None if text is None else []
        for line in text.split("\n") if text is not None else []:
            group = root[_normal(line)] if _normal(line) else None
            if group is None or group not in seen:
                kept.append(line)
            if group is not None:
                seen.add(group)
        out.append(kept if kept is None else "\n".join(kept))
    return out


def test_lines(spark):
    rng = np.random.default_rng(6)
    vocabulary = ["w%d" % i for i in range(300)]
    long_ = [str(w) for w in rng.choice(vocabulary, 160)]
    variants = []
    for _ in range(6):
        copy = list(long_)
        copy[int(rng.integers(160))] = "other"
        variants.append(" ".join(copy))
    short = [" ".join(rng.choice(vocabulary, 6)) for _ in range(30)]
    texts = [None, "", "\n\n", "Only one. Line!\nonly   ONE line\n---\n---", " ".join(long_)] + [f"{short[i % 9]}\n{v}\n{short[i]}" for i, v in enumerate(variants)]
    texts += ["\n".join(rng.choice(short, 12)) for _ in range(20)] + ["x"]
    docs = spark.createDataFrame([(i, t, len(t or ""), "k", 3) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long, key string, pos int")
    got = lines.dedup_lines(docs)
    assert got.columns == docs.columns
    rows = {r.doc_id: r for r in got.collect()}
    assert [rows[i].text for i in range(len(texts))] == _brute_lines(texts)
    assert all(r.n_chars == len(r.text or "") and r.key == "k" for r in rows.values())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    counted = {r.doc_id: (r.n_lines, r.n_kept) for r in lines.dedup_lines(docs, counts=True).collect()}
    assert counted[0] == (0, 0) and counted[1] == (1, 1) and counted[3] == (4, 3)
    assert lines.dedup_lines(docs.limit(0)).count() == 0


def test_lines_odd_ids(spark):
    rows = [(None, "a line of words"), (3, "a line of words\nb"), (3, "c\na line of words"), (2, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in lines.dedup_lines(docs).collect()), key=str)
    ones = [r for r in got if r[0] == 3]
    assert (2, "b") in got and (None, "") in got
    assert Counter("\n".join(r[1] for r in ones).split("\n")) - Counter([""]) == Counter(["c", "a line of words"])


def test_warc(spark, tmp_path):
    html = ["<p>a</p>", "<p>ä\r\n\r\nWARC/1.1\r\n</p>", "<p>a</p>", None, "", "<p>a</p>", "<p>ä\r\n\r\nWARC/1.1\r\n</p>", "alone"]
    rows = [(i * 3, f"http://x/{i}\nX: y", h, "z") for i, h in enumerate(html)] + [(None, None, "<p>a</p>", "z"), (0, "http://again", "<p>a</p>", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    warc.write_archives(pages.repartition(3), str(tmp_path / "w"), per_file=2)
    got = warc.read_archives(spark, str(tmp_path / "w")).collect()
    first = {}
    for page, _, h, _ in rows:
        if page is not None:
            first[h or ""] = min(first.get(h or "", page), page)
    want = []
    for page, _, h, _ in rows:
        raw = (h or "").encode()
        again = page != first[h or ""]
        want.append((page, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", first[h or ""] if again else None))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == sorted(want, key=str)
    large = warc.resolve(pages, least=6).where("record_type = 'revisit'")
    assert large.where("payload_bytes < 6").count() == 0 and large.count() > 0
    warc.write_archives(pages.limit(0), str(tmp_path / "none"))
    assert warc.read_archives(spark, str(tmp_path / "none")).count() == 0


def test_rules_are_the_column(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.train(docs, labels)
    stats = docs.select("doc_id", *[c.alias(n) for n, c in quality.statistics(F.col("text")).items()]).toPandas().sort_values("doc_id")
    matrix = quality._matrix([r for r, _ in model.rules], stats[model.names].to_numpy(float))
    want = trees.sigmoid(matrix @ np.array([w for _, w in model.rules]) + model.bias)
    got = quality.score(docs, model).toPandas().sort_values("doc_id")["score"].to_numpy()
    assert np.allclose(got, want)
    judged = quality.judged(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (judged.predicted == judged.quality).mean() > 0.97
    import zlib

    assert all(h == (zlib.crc32(str(d).encode()) % 5 == 0) for d, h in quality.judged(docs, labels).select("doc_id", "held_out").collect())


def test_quality_odd(spark):
    docs = spark.createDataFrame([(1, None, 0.5, "a"), (None, "", 0.5, "a"), (1, "Words stand here.", 0.5, "a")], "doc_id long, text string, score double, _stats string")
    labels = spark.createDataFrame([(1, None), (None, 1), (1, 1), (1, 0)], "doc_id long, quality int")
    rows = quality.judged(docs, labels).collect()
    assert len(rows) == 3 and all(0 <= r.score <= 1 for r in rows)
    assert quality.score(docs, quality.train(docs, labels.limit(0)), "made").columns == [*docs.columns, "made"]
    assert quality.judged(docs.limit(0), labels).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    run = Scratch(spark)
    before = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = run.settle(stage(spark, docs, SMALL))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        ids = [r.doc_id for r in docs.collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= before
        before = set(ids)
    assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()} == before
    run.drop()


def test_links_of_a_hot_bucket(spark):
    """Members of one bucket, like their neighbours only, come into the groups that all pairs give."""
    from pageloom.llm.anchors import anchored_links

    rng = np.random.default_rng(9)
    values = sorted(int(v) for v in rng.choice(2000, 300, replace=False))
    left = spark.createDataFrame([(1, v, (v,)) for v in values] + [(2, v, (v,)) for v in values[:9]], "bucket long, key long, info struct<at: int>")
    near = lambda a, b: F.abs(a["at"] - b["at"]) <= 6
    run = Scratch(spark)
    roots = {r.node: r.root for r in components(anchored_links(left, near, lambda pairs: pairs.where("v - u <= 6"), run), run).collect()}
    want, root = {}, values[0]
    for before, v in zip(values, values[1:], strict=False):
        root = root if v - before <= 6 else v
        want |= {v: root} if v != root else {}
    assert roots == want
    run.drop()


def test_few_pairs_of_a_large_group(spark):
    """Members whom another bucket put into the group of a bucket's anchor are not compared with further anchors."""
    from pageloom.llm.anchors import anchored_links

    # The first member of bucket 1 is like the second alone, which is like all others.
    order = [r.key for r in spark.range(400).select(F.col("id").alias("key")).orderBy(F.xxhash64("key"), "key").collect()]
    rows = [(1, key, (place,)) for place, key in enumerate(order)] + [(2, key, (place,)) for place, key in enumerate(order) if place]
    left = spark.createDataFrame(rows, "bucket long, key long, info struct<at: int>")
    fits = lambda a, b: ((a["at"] > 0) & (b["at"] > 0)) | (a["at"] + b["at"] == 1)
    looked, run = [], Scratch(spark)

    def verified(pairs):
        looked.append(pairs.count())
        return pairs

    links = anchored_links(left, fits, verified, run)
    assert {r.root for r in components(links, run).collect()} == {0} and links.distinct().count() >= 399
    print("pairs looked at:", looked)
    assert sum(looked) <= 500
    run.drop()


def _groups(normals, least=0.8):
    """The first of each line's group by edit similarity of words alone."""
    parent = list(range(len(normals)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    words = [x.split() for x in normals]
    # Words with their number among equals: what two lines lack of each other must be edited.
    bags = [{(w, x[:i].count(w)) for i, w in enumerate(x)} for x in words]
    for i, x in enumerate(words):
        for j in range(i):
            longer = max(len(x), len(words[j]))
            most = (1 - least) * longer + 1e-9
            if longer - min(len(x), len(words[j])) <= most and longer - len(bags[i] & bags[j]) <= most and _edit(x, words[j]) <= most:
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return [find(i) for i in range(len(normals))]


def _scattered(rng, base, edits):
    """``base`` with so many words changed, dropped or put in at random places."""
    copy = list(base)
    for _ in range(edits):
        at, what = int(rng.integers(len(copy))), rng.random()
        if what < 0.6:
            copy[at] = "n%d" % rng.integers(10**6)
        elif what < 0.8:
            del copy[at]
        else:
            copy.insert(at, "n%d" % rng.integers(10**6))
    return copy


def test_lines_recall(spark):
    """Pairs found, by edit similarity; nothing goes that has no similar line before it."""
    rng = np.random.default_rng(11)
    bands, texts = {}, []
    for edits in (1, 2, 3, 4, 6, 8):
        for _ in range(60):
            base = [str(w) for w in rng.choice(["w%d" % i for i in range(4000)], 40)]
            other = _scattered(rng, base, edits)
            bands.setdefault(20 - int(20 * _edit(base, other) / max(len(base), len(other)) + 0.999), []).append(len(texts) + 1)
            texts += [" ".join(base), " ".join(other)]
    texts += [" ".join(rng.choice(["v%d" % i for i in range(4000)], 40)) for _ in range(100)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    gone = {r.doc_id for r in lines.dedup_lines(docs).collect() if not r.text}
    assert gone <= {i for second in bands.values() for i in second}
    share = {5 * band: len(gone.intersection(i)) / len(i) for band, i in sorted(bands.items())}
    print("share of near lines that go, by edit similarity from:", share)
    assert share[95] > 0.93 and share[90] > 0.75 and share[80] > 0.3


def test_lines_recall_of_given_texts(spark):
    """Of the lines that repeat an earlier one up to edits, in the given tables, nine of ten go; nothing else goes."""
    texts = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in lines.dedup_lines(docs, counts=True).collect()}
    want = _brute_lines(texts)
    exact, fuzzy, missed = set(), 0, 0
    for i, text in enumerate(texts):
        ours, theirs = (Counter(x for x in (t or "").split("\n") if _normal(x)) for t in (got[i].text, want[i]))
        assert not theirs - ours
        missed += (ours - theirs).total()
        for line in (text or "").split("\n"):
            if _normal(line) and _normal(line) not in exact:
                exact.add(_normal(line))
    lost = sum(r.n_lines - r.n_kept for r in got.values())
    fuzzy = lost + missed - sum(1 for t in texts for line in (t or "").split("\n") if _normal(line)) + len(exact)
    print("near lines:", fuzzy, "missed:", missed)
    assert missed <= 0.1 * fuzzy


def test_near_duplicates_recall(spark):
    """Pairs found, by edit similarity, edits scattered over the text; nothing else is joined."""
    rng = np.random.default_rng(12)
    texts, bands = [], {}
    for n in (20, 60, 200):
        for share in (0.05, 0.1, 0.15, 0.2):
            for _ in range(25):
                base = [str(w) for w in rng.choice(["w%d" % i for i in range(3000)], n)]
                other = _scattered(rng, base, int(share * n + 1e-9))
                bands.setdefault(share, []).append(len(texts))
                texts += [" ".join(base), " ".join(other)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dups.near_duplicates(docs).collect()}
    assert all(got[i] in (i, i - i % 2) for i in got)
    found = {share: np.mean([got[i] == got[i + 1] for i in first]) for share, first in bands.items()}
    print("share of pairs found, by share of words edited:", found)
    assert min(found.values()) >= 0.95


def test_lines_of_repeated_rows(spark):
    """A row that is there many times has lines as long as they are, and is like its neighbours."""
    words = [f"word{i}" for i in range(20)]
    rows = [(5, " ".join(words))] * 9 + [(6, " ".join([*words[:7], "other", *words[8:]])), (7, "not like these at all")] + [(8, "alone in here\nsame\nsame")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in lines.dedup_lines(docs, counts=True).collect()]
    want = [(5, rows[0][1], 1, 1)] * 9 + [(6, "", 1, 0), (7, rows[10][1], 1, 1)] + [(8, "alone in here\nsame", 3, 2)] * 2
    assert sorted(got) == sorted(want)


def test_lines_of_any_length(spark):
    """Lines beyond a million letters are compared like all others."""
    words = [f"{i}" + "x" * 60_000 for i in range(20)]
    texts = [" ".join(words), " ".join([*words[:9], "other", *words[10:]]), "short"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.text for r in sorted(lines.dedup_lines(docs).collect())] == [texts[0], "", "short"]


def test_simhash(spark):
    """Bits by majority, whatever counts them: lanes of 8 or 16 bits, or a counter for each."""
    rng = np.random.default_rng(5)
    rows = [rng.integers(-(2**63), 2**63 - 1, n).tolist() for n in (1, 2, 5, 34, 127, 128, 300, 32_767, 32_768)]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, h array<bigint>")
    got = {r.i: (r.p, r.c) for r in df.select("i", lines.simhash(F.col("h")).alias("p"), lines._counted(F.col("h")).alias("c")).collect()}
    for i, row in enumerate(rows):
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in row) > len(row))
        assert [x % (1 << 64) for x in got[i]] == [want, want]


def test_told_of_lines(spark):
    """What is told of a line is that of its words, however often it stands there."""
    rng = np.random.default_rng(15)
    texts = ["\n".join(" ".join("v%d" % i for i in rng.integers(0, 9000, n)) for n in (1, 3, 4, 9, 64, 128, 129, 700)), " ".join("u%d" % i for i in range(20_000))]
    docs = spark.createDataFrame([(0, texts[0])] * 2 + [(1, texts[1])], "doc_id long, text string")
    rows = lines.occurrences(docs).collect()
    assert sorted((r.doc_id, r.pos) for r in rows) == sorted([(0, i) for i in range(8)] * 2 + [(1, 0)])
    found = {(r.doc_id, r.pos): r for r in rows}
    split = spark.createDataFrame([(i, p, line.split()) for i, t in enumerate(texts) for p, line in enumerate(t.split("\n"))], "i long, p int, w array<string>")
    for i, p, h in split.select("i", "p", F.transform("w", lambda w: F.xxhash64(w))).collect():
        row, n = found[i, p], len(h)
        odd = {x: sum(1 << b for b in range(64) if sum(1 for y in h if (y >> 20) % x[0] == x[1] and (y >> 24) % 64 == b) % 2) for x in [(4, k) for k in range(4)] + [(16, k) for k in range(16)]}
        want = [sum(1 << b for b in range(64) if 2 * sum(y >> b & 1 for y in h) > n), *[odd[4, k] for k in range(4)]] if n > 3 else [None] * 5
        assert row.n_words == n and [x if x is None else x % (1 << 64) for x in (row.print, row.p0, row.p1, row.p2, row.p3)] == want
        assert (row.wide and [x % (1 << 64) for x in row.wide]) == ([odd[16, k] for k in range(16)] if n > 128 else None)


def test_long_lines_that_share_words(spark, monkeypatch):
    """Long lines of the same frequent words are no pairs to be read again."""
    rng = np.random.default_rng(16)
    common = ["c%d" % i for i in range(110)]
    texts = []
    for _ in range(60):
        words = [*common, *["r%d" % i for i in rng.integers(0, 10**6, 190)]]
        texts.append(" ".join(rng.permutation(words)))
    looked, verified = [], lines._verified

    def counted(docs, classes, pairs, least, run):
        looked.append(pairs.count())
        return verified(docs, classes, pairs, least, run)

    monkeypatch.setattr(lines, "_verified", counted)
    monkeypatch.setattr(lines, "RADIUS", 64)
    monkeypatch.setattr(lines, "_tables", lambda: [F.lit(0).cast("long")])
    docs = spark.createDataFrame([*enumerate(texts), (60, texts[7] + " more")], "doc_id long, text string")
    assert [r.doc_id for r in lines.dedup_lines(docs).collect() if not r.text] == [60]
    print("pairs looked at:", looked)
    assert sum(looked) <= 3


def test_lines_are_verified_twice(spark, monkeypatch):
    """The texts are read again once after the anchors and once after all blocks, for few pairs that are not similar."""
    calls, verified = [], lines._verified

    def counted(docs, classes, pairs, least, run):
        got = verified(docs, classes, pairs, least, run)
        calls.append((pairs.count(), got.count()))
        return got

    monkeypatch.setattr(lines, "_verified", counted)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    lines.dropped_lines(docs).count()
    assert len(calls) == 2
    looked, similar = (sum(c[i] for c in calls) for i in (0, 1))
    print("pairs looked at:", looked, "similar:", similar)
    assert looked <= 3 * similar + 50


def test_similar_lines_share_a_run(spark):
    """Whatever words are edited, two similar lines have one of the runs in common that each is looked at by."""
    rng = np.random.default_rng(21)
    rows = []
    for n in [*range(4, 30), 60, 150]:
        for _ in range(12):
            base = ["w%d" % i for i in rng.integers(0, 40, n)]
            for edits in range(1, n // 5 + 2):
                other = _scattered(rng, base, edits)
                if len(other) > 3 and _edit(base, other) <= 0.2 * max(n, len(other)) + 1e-9:
                    rows.append((len(rows), " ".join(base), " ".join(other)))
    pairs = spark.createDataFrame(rows, "doc_id long, a string, b string")
    first, second = (lines.places(pairs.select("doc_id", F.col(c).alias("text")), 0.8).select("doc_id", F.col("runs").alias(c)) for c in ("a", "b"))
    met = first.join(second, "doc_id")
    assert met.count() == len(rows) > 500 and met.where(~F.arrays_overlap("a", "b")).count() == 0


def test_unlike_lines_are_not_read_again(spark, monkeypatch):
    """Lines that share no run of words are in no bucket, however many there are; copies of a line are one."""
    rng = np.random.default_rng(22)
    texts = [" ".join("v%d" % i for i in rng.integers(0, 10**9, 12)) for _ in range(300)]
    near = texts[5].split()
    near[6] = "other"
    told, sketched = [], lines._sketched

    def counted(rows, line):
        got = sketched(rows, line)
        told.append(got.count())
        return got

    monkeypatch.setattr(lines, "_sketched", counted)
    docs = spark.createDataFrame([*enumerate([*texts, *[texts[9]] * 20, " ".join(near)])], "doc_id long, text string")
    assert [r.doc_id for r in lines.dedup_lines(docs).orderBy("doc_id").collect() if not r.text] == [*range(300, 321)]
    assert sum(told) == 2


def test_crowded_buckets(spark, monkeypatch):
    """Lines of buckets that hold many are compared beyond their anchors, and by blocks where there are very many."""
    rng = np.random.default_rng(23)
    shared = ["extraordinarily%d" % i for i in range(3)]
    texts = []
    for _ in range(20):
        base = [*shared, *["x%d" % i for i in rng.integers(0, 10**6, 20)]]
        texts += [" ".join(base), " ".join([*base[:20], "other", *base[21:]])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(lines, "RADIUS", 64)
    monkeypatch.setattr(lines, "ROWS", 100)
    for many in (lines.MANY, 10):
        monkeypatch.setattr(lines, "MANY", many)
        gone = [r.doc_id for r in lines.dedup_lines(docs).collect() if not r.text]
        assert set(gone) <= set(range(1, 40, 2)) and len(gone) >= 18


def test_texts_that_share_a_passage(spark, monkeypatch):
    """Unlike texts meet in the buckets of a passage they share, but no pair of them is written."""
    rng = np.random.default_rng(13)
    passage = ["p%d" % i for i in range(30)]
    texts = [" ".join([*passage, *rng.choice(["w%d" % i for i in range(3000)], 70)]) for _ in range(40)]
    pairs, members, links = [], [], near_dups.anchored_links

    def counted(left, fits, verified, run):
        members.append(left.count())

        def seen(found):
            pairs.append(found.count())
            return verified(found)

        return links(left, fits, seen, run)

    monkeypatch.setattr(near_dups, "anchored_links", counted)
    docs = spark.createDataFrame(list(enumerate([*texts, texts[0] + " more"])), "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_dups.near_duplicates(docs).collect()} == {i: i % 40 for i in range(41)}
    assert members[0] > 40 and sum(pairs) == 1
