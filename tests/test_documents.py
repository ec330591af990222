import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from claimloom.functions import text as TX
from claimloom.operators.rules import FAILURE
from claimloom.plans import silver


def windows(text, size, overlap):
    """What the windows must be, in plain Python."""
    tokens = (text or "").split()
    out, start = [], 0
    while tokens:
        out.append(tokens[start:start + size])
        if start + size >= len(tokens):
            break
        start += max(1, size - overlap)
    return out


def chunked(spark, texts, size, overlap):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = df.select("i", TX.chunks(F.col("t"), size, overlap).alias("c")).orderBy("i").collect()
    return [r["c"] for r in rows]


@pytest.mark.parametrize("tokens, count", [(0, 0), (1, 1), (512, 1), (513, 2), (700, 2), (960, 2), (961, 3), (5000, 12)])
def test_window_counts(spark, tokens, count):
    text = " ".join(f"t{i}" for i in range(tokens))
    (got,) = chunked(spark, [text], 512, 64)
    assert len(got) == count
    assert [c["chunk_text"].split() for c in got] == windows(text, 512, 64)
    if count > 1:
        assert got[0]["chunk_text"].split()[-64:] == got[1]["chunk_text"].split()[:64]
        assert [c["chunk_index"] for c in got] == list(range(count))
        assert [c["token_count"] for c in got] == [len(w) for w in windows(text, 512, 64)]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\t\r", max_size=80), min_size=10, max_size=30), st.integers(1, 6), st.integers(0, 8))
def test_windows_match_brute_force(spark, texts, size, overlap):
    got = chunked(spark, [*texts, None], size, overlap)
    assert [[c["chunk_text"].split() for c in doc] for doc in got] == [windows(t, size, overlap) for t in [*texts, None]]


def test_spaces(spark):
    df = spark.createDataFrame([("Line one\n\nLine two\tLine three",), (" \n ",), (None,)], "t string")
    assert [r[0] for r in df.select(TX.normalize_spaces(F.col("t"))).collect()] == ["Line one Line two Line three", None, None]


def test_extraction_outcomes(spark):
    page = "<html><head><style>p{}</style><script>if (a<b) x()</script></head><!-- <p>no</p> --><body><p>Fish &amp; chips</p></body></html>"
    rows = [(page.encode(), True), (b"<p>cut <div class='x", True), (b"<p> </p>", True), (b"a < b and c", True), (b"plain <b>", False),
            (b"\xff\xfe bad", False), (None, False), (b" \n", False)]
    df = spark.createDataFrame(rows, "c binary, m boolean").select(TX.extract_text(F.col("c"), F.col("m")).alias("x"))
    got = [(r["x"]["status"], r["x"]["policy_text"]) for r in df.collect()]
    assert got == [("OK", "Fish & chips"), ("UNREADABLE_PDF", None), ("EMPTY_PDF_TEXT", None), ("OK", "a < b and c"), ("OK", "plain <b>"),
                   ("UNREADABLE_PDF", None), ("EMPTY_PDF_TEXT", None), ("EMPTY_PDF_TEXT", None)]


def test_only_newest_version_is_chunked(spark):
    t = [datetime.datetime(2024, 1, d) for d in (1, 2, 3)]
    rows = [("a.txt", t[0], 3, b"old text", t[0]), ("a.txt", t[0], 3, b"new text", t[1]), ("b.txt", t[2], 0, b"", None), ("b.txt", t[1], 3, b"older", None)]
    df = spark.createDataFrame([(*r, "f", "r") for r in rows],
                               "path string, modificationTime timestamp, length long, content binary, _ingested_at timestamp, _source_file string, _pipeline_run_id string")
    documents = silver.validated_documents(df)
    assert [(r["document_path"], r["chunk_text"]) for r in silver.policy_chunks(documents).collect()] == [("a.txt", "new text")]
    held = {(r["path"], r["rule_name"]) for r in silver.quarantined_documents(documents).collect()}
    assert held == {("a.txt", "duplicate_policy_path"), ("b.txt", "empty_pdf_text"), ("b.txt", "duplicate_policy_path")}
    assert documents.where(F.col(FAILURE).isNull()).count() == 1


def test_count_without_chunks(spark):
    texts = [" ".join("x" * n) for n in (0, 1, 5, 6, 7, 9, 10, 40)] + [None, " \n"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = df.select(TX.chunk_count(F.col("t"), 5, 2).alias("n"), F.size(TX.chunks(F.col("t"), 5, 2)).alias("m")).collect()
    assert [r["n"] for r in rows] == [r["m"] for r in rows]

