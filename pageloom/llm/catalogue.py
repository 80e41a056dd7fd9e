"""The queries of this subpackage and the SQL they must agree with."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pageloom.llm.bpe import encode_documents
from pageloom.llm.ctph import fingerprint_with_next
from pageloom.llm.decontaminate import find_leaks
from pageloom.llm.domain_rules import judged as judged_by_domain
from pageloom.llm.html_text import extract
from pageloom.llm.licenses import scan_licenses
from pageloom.llm.lines import dedup_lines
from pageloom.llm.near_dups import near_duplicates
from pageloom.llm.quality import judged
from pageloom.llm.ranked import search
from pageloom.llm.spelling import variants
from pageloom.llm.token_store import read_documents, write_tokens
from pageloom.llm.warc import read_archives, write_archives
from pageloom.session import scratch_folder

VOCABULARY = str(public_tokenizers.path("word_bpe_49k.json"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases, labels and score of every document."""
    return scan_licenses(spark, _table(spark, sf_dir, "documents")).drop("spans")


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as directly addressable codes, then read from the files."""
    folder = scratch_folder(spark, "tokens")
    write_tokens(spark, _table(spark, sf_dir, "documents"), folder, VOCABULARY)
    return read_documents(spark, folder)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents, as pairs."""
    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded, as digests."""
    return encode_documents(spark, _table(spark, sf_dir, "documents"), VOCABULARY)


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piecewise hashes of every document, its edited text and the next one."""
    return fingerprint_with_next(_table(spark, sf_dir, "documents"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate group of every document."""
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives with revisits, then read back."""
    folder = scratch_folder(spark, "warc")
    write_archives(_table(spark, sf_dir, "pages"), folder)
    return read_archives(spark, folder).drop("url")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that stand earlier in the corpus."""
    return dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(_table(spark, sf_dir, "pages"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document."""
    return judged(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequent words of all documents, their near words, forms and roots."""
    return variants(_table(spark, sf_dir, "documents"))


def op12_domain_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document judged by counts of its words and by its likeness to trusted ones."""
    return judged_by_domain(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents of every benchmark item."""
    return search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_licenses": op1_licenses,
    "op2_token_store": op2_token_store,
    "op3_decontamination": op3_decontamination,
    "op4_bpe": op4_bpe,
    "op5_fingerprints": op5_fingerprints,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_warc": op7_warc,
    "op8_line_dedup": op8_line_dedup,
    "op9_html_text": op9_html_text,
    "op10_quality": op10_quality,
    "op11_spelling": op11_spelling,
    "op12_domain_rules": op12_domain_rules,
    "op13_ranked": op13_ranked,
    "pipeline": corpus_pipeline.run,
}
ORACLE: dict[str, str] = {
    "op7_warc": """
        WITH p AS (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
        ), d AS (
            SELECT page_id, payload_bytes, hex, min(page_id) OVER (PARTITION BY hex) AS first FROM p
        )
        SELECT page_id, payload_bytes,
            array_to_string(list_transform(range(32), lambda i: substr(
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                CAST(1 + ((CAST('0x' || substr(hex, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) AS BIGINT), 1)), '') AS payload_digest,
            CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> first THEN first END AS refers_to
        FROM d
    """,
    # The crc32 of an id and a word, bit by bit: a byte is mixed in where an entry is none of the -1.
    "op11_spelling": """
        WITH runs AS (
            SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00C0-\u00FF]+')) AS run
            FROM documents
        ), counted AS (
            SELECT doc_id, run, count(*) AS times, hex(encode(doc_id || ':' || run)) AS hex FROM runs WHERE length(run) >= 6 GROUP BY doc_id, run
        ), steps AS (
            SELECT run, times, flatten(list_transform(range(length(hex) // 2), lambda i: list_prepend(
                CAST('0x' || substr(hex, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT), [-1, -1, -1, -1, -1, -1, -1, -1]))) AS bits
            FROM counted
        ), hashed AS (
            SELECT run, times, xor(4294967295, list_reduce(list_prepend(4294967295, bits), lambda c, x: CASE
                WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS h
            FROM steps
        ), spelt AS (
            SELECT times, CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word FROM hashed
        ), words AS (
            SELECT word, CAST(sum(times) AS BIGINT) AS n FROM spelt WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5
        ), less AS (
            SELECT word, n, length(word) AS size, i, substr(word, 1, CAST(i AS BIGINT)) || substr(word, CAST(i AS BIGINT) + 2) AS part FROM words, unnest(range(length(word))) AS t(i)
        ), pairs AS (
            SELECT a.word, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.part = b.part AND a.i = b.i AND a.size = b.size AND a.word <> b.word
            UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.part = b.word
            UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.part = b.word
        ), best AS (
            SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS place FROM pairs
        ), formed AS (
            SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * n THEN near END AS form, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n
            FROM words LEFT JOIN best ON best.word = words.word AND place = 1
        ), follow AS (
            WITH RECURSIVE chain AS (
                SELECT word, word AS here, form AS next FROM formed
                UNION ALL SELECT chain.word, formed.word, formed.form FROM chain JOIN formed ON formed.word = chain.next
            ) SELECT word, here AS root FROM chain WHERE next IS NULL
        )
        SELECT formed.word, form, root, n, n_near, form_n FROM formed JOIN follow ON follow.word = formed.word
    """,
    "op13_ranked": """
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS found FROM documents
        ), s AS (
            SELECT count(*) AS n_docs, CAST(sum(len(found)) AS BIGINT) AS n_terms FROM d WHERE len(found) > 0
        ), item AS (
            SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')) AS term FROM benchmark
        ), tf AS (
            SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(found) AS n, unnest(found) AS term FROM d) WHERE term IN (SELECT term FROM item) GROUP BY doc_id, n, term
        ), w AS (
            SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, s GROUP BY term, n_docs
        ), scored AS (
            SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * n_docs) // n_terms))))) AS BIGINT) AS score
            FROM tf JOIN w USING (term) JOIN item USING (term), s GROUP BY item_id, doc_id
        ), ranked AS (
            SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM scored WHERE score > 0
        )
        SELECT * FROM ranked WHERE rank <= 50
    """,
}
