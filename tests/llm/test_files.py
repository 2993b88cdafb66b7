"""Operators with stored forms: WARC, media, HTML; and the pipeline."""

import base64
import hashlib
import html
import re
import zlib

import numpy as np
import pytest

from linenet.llm import html_text, jpeg, queries, warc
from linenet.llm.common import fresh_path
from linenet.llm.storage import RangeReader


def test_sort_keys():
    assert warc.sort_key("https://www.Example.org:443/a b?q#f") == "org,example)/a%20b?q"
    assert warc.sort_key("http://u@x.y:8080") == "y,x:8080)/"
    assert warc.sort_key(None) == "-" and warc.sort_key("//h/p") == "h)/p"


def test_warc_cases(spark):
    rows = [(5, "http://a.b/1", "same"), (2, "http://a.b/1", "same"), (None, None, "same"), (9, "http://c.d/", None), (10, "", ""), (11, "http://é.fr/ü", "é" * 70_000), (2, "http://a.b/1", "same")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, refers_to string")
    found = warc.round_trip(pages).collect()
    got = sorted((str(r.page_id), r.payload_bytes, r.record_type, r.refers_to) for r in found)
    assert got == sorted([("5", 4, "revisit", 2), ("2", 4, "response", None), ("2", 4, "response", None), ("None", 4, "revisit", 2), ("9", 0, "response", None), ("10", 0, "revisit", 9), ("11", 140_000, "response", None)])
    assert {r.payload_digest for r in found if r.payload_bytes == 0} == {base64.b32encode(hashlib.sha1(b"").digest()).decode()}
    assert warc.round_trip(pages.where("page_id < 0")).count() == 0
    least = {r.page_id: r.record_type for r in warc.round_trip(pages, least_bytes=5).collect()}
    assert set(least.values()) == {"response"}


def test_index(spark):
    pages = spark.range(3000).selectExpr("id AS number", "concat('http://h', id % 7, '.x/', id % 50) AS url", "cast(id AS string) AS payload", "cast(NULL AS long) AS refers_to")
    folder = fresh_path(spark, "t")
    captures = warc.write_archives(pages, f"{folder}/a", archive_bytes=20_000)
    assert captures.select("archive").distinct().count() > 3
    top = warc.build_index(captures, f"{folder}/i", block_lines=16)
    reader = RangeReader()
    index = warc.CaptureIndex(top, reader)
    for i in (0, 1, 1499, 2999):
        key = warc.capture_key(f"http://h{i % 7}.x/{i % 50}", i)
        ((number, archive, offset, length, kind),) = index.find(key)
        fields, _, payload = warc.parse(reader.read(archive, offset, length))
        assert number == i and payload == str(i).encode() and kind == "response" and fields["X-Row"] == str(i)
    assert len(list(index.find("x,h3)/3 ", prefix=True))) == len([i for i in range(3000) if i % 7 == 3 and i % 50 == 3])
    assert list(index.find("nothing")) == [] and list(index.find("zzz")) == []


def test_jpeg_bytes():
    rng = np.random.default_rng(1)
    payloads = [rng.integers(0, 256, 64 * n, dtype=np.uint8).tobytes() for n in (1, 2, 3, 7, 50, 300)] + [b"\xff" * 128, bytes(64), b"\xff\xd8" * 32]
    for p, (image, parts) in zip(payloads, jpeg.decode(jpeg.encode(payloads)), strict=True):
        assert jpeg.payload_of(image, parts) == p and image.width % 8 == image.height % 8 == 0


def general_jpeg(blocks, interval=0):
    """A grey JPEG with tables of several codes: blocks of 64 coefficients in zigzag order, one row of blocks."""
    dc_code = bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]) + bytes(range(12))
    symbols = [0x01, 0x02, 0x03, 0x00, 0xF0, 0x11, 0x21, 0x04, 0x05, 0x31, 0x06, 0x12]
    ac_code = bytes([0, 2, 1, 3, 3, 3, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0]) + bytes(symbols)

    def codes(table):
        out, code, k = {}, 0, 16
        for length in range(1, 17):
            for _ in range(table[length - 1]):
                out[table[k]] = format(code, f"0{length}b")
                code, k = code + 1, k + 1
            code <<= 1
        return out

    dc, ac, stream, bits, before = codes(dc_code), codes(ac_code), b"", "", 0

    def size(v):
        return abs(v).bit_length()

    def magnitude(v):
        return format(v if v > 0 else v + (1 << size(v)) - 1, f"0{size(v)}b") if v else ""

    def flush(bits):
        bits += "1" * (-len(bits) % 8)
        return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")

    for n, block in enumerate(blocks):
        if interval and n and n % interval == 0:
            stream += flush(bits) + bytes([0xFF, 0xD0 + (n // interval - 1) % 8])
            bits, before = "", 0
        bits += dc[size(block[0] - before)] + magnitude(block[0] - before)
        before, run = block[0], 0
        last = max((i for i in range(1, 64) if block[i]), default=0)
        for i in range(1, last + 1):
            if not block[i]:
                run += 1
                continue
            while run > 15:
                bits, run = bits + ac[0xF0], run - 16
            bits, run = bits + ac[run * 16 + size(block[i])] + magnitude(block[i]), 0
        bits += ac[0] if last < 63 else ""
    stream += flush(bits)
    return (
        b"\xff\xd8" + jpeg.segment(0xDB, bytes([0]) + bytes([16] + [3] * 63)) + jpeg.segment(0xC0, bytes([8, 0, 8]) + (8 * len(blocks)).to_bytes(2, "big") + bytes([1, 1, 0x11, 0]))
        + jpeg.segment(0xC4, bytes([0]) + dc_code + bytes([0x10]) + ac_code) + (jpeg.segment(0xDD, interval.to_bytes(2, "big")) if interval else b"") + jpeg.segment(0xDA, bytes([1, 1, 0, 0, 63, 0])) + stream + b"\xff\xd9"
    )


@pytest.mark.parametrize("interval", [0, 1, 3])
def test_general_jpeg(interval):
    blocks = []
    for n in range(7):
        block = [0] * 64
        block[0] = [50, -60, 0, 63, 12, -3, 20][n]
        block[1], block[3] = n, (-1) ** n
        blocks.append(block)
    blocks[2][21] = 1  # after 17 zeros
    ((image, parts),) = jpeg.decode([general_jpeg(blocks, interval)])
    assert (image.width, image.height) == (56, 8) and parts[0].reshape(-1, 64).tolist() == blocks
    assert jpeg.thumbnail(image, parts).ravel().tolist() == [int(np.clip(np.rint(b[0] * 16 / 8 + 128), 0, 255)) for b in blocks]


def test_damaged_jpeg():
    with pytest.raises(ValueError):
        jpeg.parse(b"GIF89a")
    with pytest.raises(ValueError):
        jpeg.parse(b"\xff\xd8" + jpeg.segment(0xC2, bytes(9)))


def test_media_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op8_media(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, payload = jpeg.padded(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    odd = spark.createDataFrame([(None, None, 1), (1, "", 2), (1, "", 2), (2, "x" * 300_000, 3)], "doc_id long, text string, media int")
    out = jpeg.features(jpeg.store(odd)).collect()
    assert len(out) == 4 and len({(r.feature, r.media_sha256) for r in out}) == 2
    assert jpeg.features(jpeg.store(odd.where("media > 9"))).count() == 0


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><a href=x>Home</a></nav>
<div class="cookie-notice">We use cookies and that is all there is to say about it, in one long sentence for you.</div>
<article><h1>Title &amp; more</h1><p>First   paragraph&nbsp;of the article, which is long enough to be decided by its length alone, really.<p>Short.
<div class="ad"><p>Buy this now, the offer of the year is here and it is only for you and all of your friends!</p></div>
<blockquote>Quoted <b>text</b> with a <a href="/x">link</a> in it &lt;here&gt;.</blockquote><script>var a="<p>no</p>";</script>
<section id="comments"><p>A reader says that this is the best article of them all, and that it should be read by all.</p></section></article>
<aside>More</aside><form><p>Search for the thing that you want in the box.</p></form><footer>Foot</footer></body>"""


def test_html_cases(spark):
    assert html_text.main_text(PAGE) == "Title & more\nFirst paragraph of the article, which is long enough to be decided by its length alone, really.\nShort.\nQuoted text with a link in it <here>."
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p>") == ""
    bare = "<ul><li><a href=a>One</a></li><li><a href=b>Two</a></li></ul><p>" + "This is a text that has all of the words and it is the one that we want. " * 4 + "</p><p>Short end.</p>"
    assert html_text.main_text(bare).endswith("Short end.") and "Two" not in html_text.main_text(bare)
    assert html_text.main_text("<p>a < b & c <p title='>'>d") == "a < b & c\nd"
    rows = spark.createDataFrame([(1, None, PAGE, "x"), (None, "u", None, "y")], "page_id long, url string, html string, text string")
    assert sorted((r.n_chars, r.url) for r in html_text.extract(rows).collect())[0] == (0, "u")
    assert html_text.extract(rows.where("page_id > 5")).count() == 0
    html_text.main_text("<a " + "x='" * 20_000)


SAID = "The paper of the year that was in all of the news and it is long enough for that. " * 4


def test_html_names():
    for name in ("site has-sidebar", "no-sidebar", "with-sidebar wide", "modal"):
        assert html_text.main_text(f'<div class="{name}"><article><p>{SAID}</p></article></div>') == SAID.strip()
    inside = f'<p>{SAID}</p><div class="side-by-side"><p>{SAID}</p></div><div class="cookie-banner">{SAID}</div><ul><li><a>a</a><li><a>b</a><li><a>c</a></ul><p>End.</p>'
    assert html_text.main_text(f"<article>{inside}</article>") == f"{SAID.strip()}\n{SAID.strip()}\nEnd."
    assert html_text.main_text(f'<div class="sidebar"><article>Teaser</article></div><article><p>{SAID}</p></article>') == SAID.strip()


def test_html_query(spark, sf):
    """Brute force on the table's own pages, whose articles hold headings, paragraphs, unclosed bold type and line ends only."""

    def text(page):
        inside = re.search(r"<article>(.*?)(</article>|$)", page or "", re.S)
        blocks = re.split(r"</?(?:p|h1)>", inside.group(1)) if inside else []
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in blocks]
        return "\n".join(b for b in blocks if b)

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    found = queries.op9_html(spark, sf).collect()
    assert len(found) == len(pages)
    assert all(r.text == text(pages[r.page_id]) and r.n_chars == len(r.text) for r in found)
    rows = spark.createDataFrame([(1, "u", f"<article><p>{SAID * 3000}</p></article>", 5)] * 2, "page_id long, url string, html string, n_chars long")
    assert [r.n_chars for r in html_text.extract(rows).collect()] == [len(SAID) * 3000 - 1] * 2


def test_pipeline(spark, sf, tmp_path):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, sf).where("NOT decoded").isEmpty()
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, row int")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        assert out.count() == 0 and (k == len(corpus_pipeline.STAGES) - 1 or out.columns == docs.columns)
    odd = spark.createDataFrame([(1, None, None, None, None), (None, "", "en", "s", 0), (None, "a b c d e f", "en", None, 11), (2, "a b c d e f", "en", "s", 11), (2, "a b c d e f", "en", "s", 11)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        odd = stage(spark, odd, sf)
    assert odd.count() >= 1
