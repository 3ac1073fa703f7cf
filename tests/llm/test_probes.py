"""Awkward inputs of single operators."""

import base64
import bz2
import gzip
import time
import urllib.parse
import zlib

import pytest

from terraframe.llm import html_extract, language_id, secret_scan
from tests.llm.cases import documents

SECRET = "password = hunter2hunter2hunter2"
LONG = "x" * 40 + " " + SECRET + " " + "y" * 40


def nested(data, times):
    for _ in range(times):
        data = zlib.compress(data)
    return data


def literal(data):
    return repr(data)[2:-1]


@pytest.mark.parametrize(
    "hidden",
    [
        urllib.parse.quote_from_bytes(gzip.compress(LONG.encode())),
        "".join(f"%{b:02X}" for b in gzip.compress(LONG.encode())),
        urllib.parse.quote_from_bytes(zlib.compress(LONG.encode())),
        urllib.parse.quote_from_bytes(bz2.compress(LONG.encode())),
        "".join(f"\\x{b:02x}" for b in gzip.compress(LONG.encode())),
        literal(gzip.compress(LONG.encode())),
        base64.b64encode(gzip.compress(b"nothing") + gzip.compress(LONG.encode())).decode(),
        base64.b64encode(nested(LONG.encode(), 70)).decode(),
        base64.b64encode(nested(LONG.encode(), 150)).decode(),
        base64.b64encode(gzip.compress(b"\n" * (40 << 20) + LONG.encode())).decode(),
        base64.b64encode(b"\x1b" + LONG.encode()).decode(),
        base64.b64encode(LONG.encode("utf-16")).decode(),
        base64.b64encode(LONG.encode("utf-16-be")).decode(),
        "blob_" + base64.b64encode(LONG.encode()).decode(),
        "ab" + base64.b64encode(gzip.compress(LONG.encode())).decode(),
        urllib.parse.quote(base64.b64encode(gzip.compress(urllib.parse.quote(LONG).encode())).decode()),
    ],
)
def test_hidden_secrets(hidden):
    text = f"before é ({hidden}) after"
    plain, more = secret_scan.secrets(text)
    at = text.index(hidden)
    assert any(k == 0 and at <= s < e <= at + len(hidden) for s, k, e in more), (plain, more)


def test_archive_that_holds_itself_ends():
    texts = [base64.b64encode(nested(b"x" * 30, 64 * 3)).decode(), "%25" * 200, "A" * 5000, "%1F%8B%08" * 300, "\\x1f\\x8b\\x08" * 300]
    began = time.time()
    assert all(secret_scan.secrets(t)[1] == [] for t in texts) and time.time() - began < 20


def test_letters(spark):
    net = language_id.ByteGru(["x", "y"])
    rows = [(1, "² ½ ¼ Ⅷ ٣ 12 _"), (2, "ª"), (3, "12 é"), (4, "漢"), (5, "!?")]
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(documents(spark, rows).withColumnRenamed("score", "lang_pred"), net).collect()}
    assert {i for i, x in got.items() if x == "und"} == {1, 5}


def text_of(page):
    return html_extract.extract(page, set(), 0)


@pytest.mark.parametrize("mark", ['class="related-work"', 'class="notice-board"', 'id="discussion"', 'class="share-price"', 'class="comment-on-results"'])
def test_class_words_of_articles(mark):
    assert text_of(f"<main><p>one</p><section {mark}><p>two</p></section></main>") == "one\ntwo"


@pytest.mark.parametrize("mark", ['class="comments"', 'class="user-comments"', 'id="comment-list"', 'class="share-buttons"', 'class="ad-slot"', 'class="related-articles box"', 'class="cookieNotice"', 'class="sidebar2"'])
def test_class_words_of_chrome(mark):
    assert text_of(f"<main><p>one</p><section {mark}><p>two</p></section></main>") == "one"


@pytest.mark.parametrize("tag", ["svg", "object", "math", "canvas", "select"])
def test_unclosed_elements(tag):
    assert text_of(f"<main><p>one<{tag}><p>two</main>") == "one\ntwo"


def test_form_words_in_an_article():
    assert text_of("<article><p>one</p><fieldset>two <label>three</label></fieldset><form><label>no</label></form></article>") == "one\ntwo three"


@pytest.mark.parametrize("page", ["<div>" * 40_000, "<div>" * 20_000 + "</b>" * 20_000, "<p><table>" + "<div>" * 20_000, "<ul><li>" * 10_000, "<p>" * 40_000, "x " * 1_000_000])
def test_deep_and_long_pages(page):
    began = time.time()
    assert text_of(page + "end").endswith("end") and time.time() - began < 5


def test_extraction_of_repeats_and_clashing_columns(spark):
    rows = [(1, "http://h/a", "<main>one</main>", "x"), (1, "http://h/a", "<main>one</main>", "y"), (2, None, None, None), (3, "h", "", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r["page_id"], r["text"]) for r in html_extract.extract_text(pages).collect())
    assert got == [(1, "one"), (1, "one"), (2, ""), (3, "")]
    assert html_extract.extract_text(pages.limit(0)).count() == 0


def test_scan_of_empty_tables_and_clashing_columns(spark):
    docs = documents(spark, [(1, SECRET), (1, SECRET)]).withColumnRenamed("kept", "spans")
    assert [len(r["spans"]) for r in secret_scan.scan(docs).collect()] == [1, 1]
    assert secret_scan.scan(docs.limit(0)).count() == 0
