"""Operators that look at one row at a time: against brute force, and on odd input."""

import hashlib
import re
import zlib

import numpy as np
import pytest

tokenizers = pytest.importorskip("tokenizers")

from pageloom.llm import ctph, decontaminate, hashing, html_text, licenses, token_store  # noqa: E402
from pageloom.llm.bpe import Encoder, Memo, Vocabulary, encode_documents  # noqa: E402
from pageloom.llm.catalogue import VOCABULARY  # noqa: E402
from pageloom.llm.pieces import chunks  # noqa: E402
from pageloom.llm.suffix import Automaton  # noqa: E402

TEXTS = [
    None, "", " \n ", "Hello wörld's  <|endoftext|> ab12 \x1c ΑΣ don'T <|x|>", "éa İstanbul ǅ ²½ Ⅷ 漢字かな 🎉 x y\x85z", "''s 'S I'LL",
    "á" * 30, "x" * 3000, "!?" * 400, "<|startoftext|><|startoftext|>A", "ŉ ſ K Å ﬁ ᾳ", "The end.", "The end.", "word " * 5000,
]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(VOCABULARY)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i if i % 5 else None, t, "x", 1.0) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, score double")


def test_suffix_automaton():
    rng = np.random.default_rng(1)
    rows = [rng.integers(0, 3, rng.integers(1, 9)).tolist() for _ in range(40)]
    a = Automaton(3)
    for row in rows:
        a.add(row)
    known = {tuple(r[i:j]) for r in rows for i in range(len(r)) for j in range(i + 1, len(r) + 1)}
    for size in range(1, 6):
        for n in range(3**size):
            word = tuple(n // 3**k % 3 for k in range(size))
            state = 0
            for s in word:
                state = a.step.get(state * 3 + s)
                if state is None:
                    break
            assert (state is not None) == (word in known)


def test_bpe_is_the_library(spark, odd, library):
    got = sorted(encode_documents(spark, odd, VOCABULARY).collect(), key=str)
    want = []
    for i, text in enumerate(TEXTS):
        ids = library.encode(text or "", add_special_tokens=False).ids
        sha = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        back = hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        want.append((i if i % 5 else None, len(ids), sha, back))
    assert [tuple(r) for r in got] == sorted(want, key=lambda r: str(next(x for x in got if tuple(x) == r)))


def test_bpe_on_random_words(library):
    memo = Memo(Encoder(Vocabulary.read(VOCABULARY)))
    rng = np.random.default_rng(3)
    letters = list("abcdefghinorstuäéß'.,0 ")
    for _ in range(300):
        text = "".join(rng.choice(letters, rng.integers(0, 60)))
        ours = [int(i) for c in chunks(text) for i in memo[c][0].split()]
        assert ours == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("top", [1, 200, 256, 70_000, 2**32 - 1])
@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 3000])
def test_codes_round_trip(n, top):
    ids = np.random.default_rng(n).integers(0, top, n, dtype=np.uint32, endpoint=True)
    code = token_store.Packed(token_store.pack(ids))
    assert (code.all() == ids).all() and code.size == n
    assert all(code[i] == ids[i] for i in range(0, n, 7))
    with pytest.raises(IndexError):
        code[n]


def test_token_store(spark, odd, library, tmp_path):
    folder = str(tmp_path / "store")
    token_store.write_tokens(spark, odd, folder, VOCABULARY)
    got = token_store.read_documents(spark, folder).orderBy("start").collect()
    ids = {}
    for i, text in enumerate(TEXTS):
        ids.setdefault(i if i % 5 else None, []).append([*library.encode(text or "", add_special_tokens=False).ids, 1])
    at = 0
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda d: (d is not None, d or 0))
    for row in got:
        assert row.start == at
        at += row.n_tokens
        assert row.ids_crc32 in [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids[row.doc_id]]
    wanted = spark.createDataFrame([(3, 0), (3, 4), (3, 10**6), (12345, 0)], "doc_id long, position long")
    found = {(r.doc_id, r.position): r.token_id for r in token_store.tokens_at(spark, folder, wanted).collect()}
    assert found == {(3, 0): ids[3][0][0], (3, 4): ids[3][0][4]}


def test_empty_tables(spark, odd, tmp_path):
    none = odd.limit(0)
    assert encode_documents(spark, none, VOCABULARY).count() == 0
    assert licenses.scan_licenses(spark, none).count() == 0
    assert ctph.fingerprint_with_next(none).count() == 0
    token_store.write_tokens(spark, none, str(tmp_path / "none"), VOCABULARY)
    assert token_store.read_documents(spark, str(tmp_path / "none")).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_text.extract(pages).count() == 0


def _phrases(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    places = [(i, label) for phrase, label in licenses.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), places


def test_licenses(spark):
    mit = licenses.TEMPLATES[0][1]
    texts = [None, "", "MIT", "cc-BY cc by cc by-nc 4.0", "the GNU General Public GNU General Public License", f"intro {mit} Apache\nLicense, Version 2.0", mit.replace("without restriction", "freely"), "MİT license ÄMIT license mit license"]
    docs = spark.createDataFrame([(i, t, "a") for i, t in enumerate(texts)], "doc_id long, text string, labels string")
    for row in licenses.scan_licenses(spark, docs).collect():
        n, places = _phrases(texts[row.doc_id])
        starts = [p for p, _ in places]
        assert (row.n_words, row.n_base) == (n, len(places))
        assert (row.first_word, row.last_word) == ((min(starts), max(starts)) if starts else (None, None))
        assert row.base_labels == ",".join(sorted({label for _, label in places}))
        assert set(filter(None, row.base_labels.split(","))) <= set(row.labels.split(",")) | {""}
        assert 0 <= row.score <= 1
    labels = {r.doc_id: r.labels.split(",") for r in licenses.scan_licenses(spark, docs).collect()}
    assert labels[3] == ["cc-by", "cc-by-nc"] and labels[5] == ["apache", "apache-2.0", "mit"] and labels[6] == ["mit"]


def test_fingerprints(spark):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefgé "), 6)) for _ in range(400)]
    texts = [" ".join(rng.choice(words, n)) for n in (900, 900, 40, 3, 2000)] + ["", None, "x", "same", "same", "z" * 5000]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, fingerprint int")
    got = {r.doc_id: r for r in ctph.fingerprint_with_next(docs.repartition(4)).collect()}
    for i, text in enumerate(texts):
        text, after = text or "", texts[(i + 1) % len(texts)] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        row = got[i]
        assert row.n_chars == len(text) and row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert row.fingerprint == ctph.fingerprint(text.encode()) and row.edited_fingerprint == ctph.fingerprint(edited.encode())
        assert 0 <= row.near_edited <= 1 and 0 <= row.near_next <= 1
    assert got[8].near_next == 1.0 and got[0].near_edited > 0.3 > got[0].near_next
    one = docs.where("doc_id = 0")
    assert ctph.fingerprint_with_next(one).first().near_next == 1.0


def test_common_subsequence():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = ("".join(rng.choice(list("abc"), rng.integers(0, 9))) for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert ctph._common(a, b) == table[-1][-1]


def test_word_hashes():
    texts = ["", None, "Ab cd, ab  CD", "naïve—Naïve “naïve”", "x" * 10, "a b " * 600_000]
    for text in texts:
        found = re.findall(r"[^\W_]+", (text or "").lower())
        hashes = hashing.word_hashes(text)
        assert len(hashes) == len(found)
        assert len(set(hashes.tolist())) == len(set(found))


def test_leaks(spark):
    rng = np.random.default_rng(2)
    vocabulary = ["w%d" % i for i in range(500)]
    items = [" ".join(rng.choice(vocabulary, n)) for n in (6, 15, 30, 45, 60, 60)] + ["only three words", "", None]
    changed = items[4].split()
    changed[30] = "other"
    shuffled = list(rng.permutation(items[3].split()))
    filler = lambda n: " ".join(rng.choice(["f%d" % i for i in range(300)], n))
    texts = [f"{filler(40)} {items[k].upper()}. {filler(30)}" for k in range(6)]
    texts += [f"{filler(9)} {' '.join(changed)} {filler(9)}", " ".join(shuffled), "say only three words, twice", filler(300), "", None, f"{items[1]} {items[2]}"]
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, item_id int")
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = {(k, k) for k in range(6)} | {(6, 4), (8, 6), (12, 1), (12, 2)}
    for per_pass in (20_000, 3):
        rows = decontaminate.find_leaks(docs, benchmark, per_pass=per_pass).collect()
        assert {(r.doc_id, r.item_id) for r in rows} == want
    assert {r.start_word for r in rows if r.doc_id < 6} == {40}
    left = decontaminate.without_leaks(docs, benchmark)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {7, 9, 10, 11}
    assert decontaminate.find_leaks(docs, benchmark.limit(0)).count() == 0
    assert decontaminate.without_leaks(docs.limit(0), benchmark).count() == 0


def test_leaks_of_short_texts():
    words = ["w%d" % i for i in range(50)]
    index = decontaminate.Index([(1, " ".join(words)), (2, " ".join(words[:16])), (3, "only three words")])
    assert [(i, round(v, 2), at, n) for i, v, at, n in index.leaks(" ".join(words[:15]))] == [(2, 0.92, 0, 15)]
    assert [(i, round(v, 2), at, n) for i, v, at, n in index.leaks(" ".join(words[:45]))] == [(1, 0.89, 0, 45), (2, 1.0, 0, 16)]
    assert [i for i, *_ in index.leaks(" ".join(words[5:]))] == [1]
    assert index.leaks(" ".join(words[20:50])) == index.leaks("only three") == index.leaks("w1") == []


PAGE = """<!doctype html><html><head><title>No</title><style>p{}</style><script>var a="<p>no</p>"</script></head><body>
<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>About</a></li><li><a href=/c>News</a></li></ul></nav><!-- <p>no</p> -->
<div class="cookie-notice"><p>We use cookies.</p></div><article><h1>A &amp; B</h1><p><b>First   one,<br><p>second&nbsp;one with a <a href=/x>link</a> in it.
<p>Third, longer than the others, to have some text. And more of it.</p></article><div class=ad>Buy this.</div>
<section class="comments"><h3>Comments</h3><div class="comment"><p>Nice text, I liked it.</p></div></section>
<form class="newsletter"><label>Mail</label><input></form><footer><p>&copy; Somebody</p></footer>"""


def test_html(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    model = html_text.train(pages)
    rows = [(1, "u", PAGE, "x"), (2, None, None, "x"), (None, "v", "", "x"), (4, "w", "<p>", "x"), (4, "w", "<div>" * 3000 + "deep", "x"), (5, "y", "a < b & c <", "x")]
    odd = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = [r for r in html_text.extract(odd, model).collect()]
    assert len(got) == len(rows) and [r.n_chars for r in got] == [len(r.text) for r in got]
    text = got[0].text
    assert text == "A & B First one, second one with a link in it. Third, longer than the others, to have some text. And more of it."
    assert got[1].text == got[2].text == ""


def test_html_of_given_pages(spark):
    from html import unescape

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    for row in html_text.extract(pages).collect():
        article = re.search(r"<article>(.*?)(</article>|\Z)", source[row.page_id], re.S)[1]
        plain = unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", article)))
        assert row.text == " ".join(plain.split())
