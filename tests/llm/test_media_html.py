"""Matroska packets and HTML text."""

import random
import struct
from html.parser import HTMLParser

import pytest

from fixtures import LONG, ROWS, awkward, empty
from loomtext.llm import html_text, media
from loomtext.llm.html_text import render

SF = "/root/testdata/sf0.001"


def payload(data):
    t = media.File(data).table()
    return b"".join(data[a : a + n] for a, n in zip(t["byte_offset"], t["byte_length"], strict=True))


@pytest.mark.parametrize("n", [0, 1, 191, 192, 193, 1000, 5000, 92_160, 300_001])
def test_round_trip(n):
    text = random.Random(n).randbytes(n)
    f = media.File(media.mux(text))
    assert f.error is None and payload(f.data) == text
    t = f.table()
    assert sum(t["cued"]) == len(f.cues) == len(f.clusters) and t["packet"] == list(range(len(t["packet"])))
    assert t["timestamp_ns"] == [20_000_000 * i for i in range(len(t["packet"]))]


def test_integers():
    assert media.vint(b"\x81", 0) == (1, 1, False) and media.vint(b"\x40\x02", 0) == (2, 2, False) and media.vint(b"\xff", 0) == (127, 1, True)
    for n in (0, 1, 126, 127, 128, 16_382, 16_383, 1 << 20, (1 << 56) - 2):
        assert media.vint(media.coded(n), 0)[:2] == (n, len(media.coded(n)))
    for bad in (b"", b"\x00", b"\x40"):
        with pytest.raises(media.Damaged):
            media.vint(bad, 0)


@pytest.mark.parametrize("lacing", [1, 3])
def test_laces_of_any_sizes(lacing):
    rng = random.Random(lacing)
    for _ in range(200):
        frames = [rng.randbytes(rng.choice([0, 1, 3, 254, 255, 256, 509, 510, 511, 5000])) for _ in range(rng.randint(2, 9))]
        body = media.laced(frames, lacing)
        at, sizes = media.laces(body, 0, len(body), lacing)
        assert sizes == [len(f) for f in frames] and body[at:] == b"".join(frames)
    same = [b"abcd"] * 5
    body = media.laced(same, 2)
    assert media.laces(body, 0, len(body), 2) == (1, [4] * 5)
    with pytest.raises(media.Damaged):
        media.laces(body[:-1], 0, len(body) - 1, 2)


def test_void_crc_and_groups():
    void, crc = media.element(0xEC, b"\0" * 30), media.element(0xBF, b"abcd")
    tracks = media.element(media.TRACKS, crc + media.element(media.ENTRY, media.unsigned(media.NUMBER, 300) + media.unsigned(media.KIND, 1) + media.element(media.CODEC, b"V_X")))
    block = media.coded(300) + struct.pack(">h", -5) + b"\0" + b"frame"
    group = media.element(media.GROUP, media.element(media.BLOCK, block) + media.unsigned(media.LASTS, 40) + media.element(media.REFERENCE, b"\x01"))
    cluster = media.element(media.CLUSTER, void + media.unsigned(media.TIME, 1000) + group + void)
    info = media.element(media.INFO, media.unsigned(media.SCALE, 500_000))
    data = media._HEAD + media.element(media.SEGMENT, void + info + tracks + void + cluster)
    t = media.File(data).table()
    assert {k: v[0] for k, v in t.items() if k != "byte_offset"} == {"packet": 0, "track": 300, "codec": "V_X", "cluster": 0, "timestamp_ns": 995 * 500_000, "duration_ns": 20_000_000, "keyframe": False, "lacing": "none", "lace_index": 0, "cued": False, "byte_length": 5}
    assert payload(data) == b"frame"


def test_damaged_files_give_what_comes_before():
    whole = media.mux(bytes(range(256)) * 200)
    n = len(media.File(whole).packets)
    text, last = bytes(range(256)) * 200, 0
    for cut in range(0, len(whole), 997):
        f = media.File(whole[:cut])
        got = b"".join(whole[p[7] : p[7] + p[8]] for p in f.packets)
        assert last <= len(f.packets) <= n and text.startswith(got) and len(got) >= cut - 3000
        last = len(f.packets)
    rng = random.Random(5)
    for _ in range(300):
        bad = bytearray(whole)
        for _ in range(5):
            bad[rng.randrange(len(bad))] = rng.randrange(256)
        media.File(bytes(bad)).table()
    assert media.File(b"junk").error and media.File(None).packets == [] and media.File(b"").error is None


def extremes():
    """Files with every numeric element at its extremes, and of odd lengths."""
    names = (media.SCALE, media.NUMBER, media.KIND, media.EACH, media.TIME, media.LASTS, media.CUE_TIME, media.CUE_TRACK, media.CUE_CLUSTER, media.CUE_INSIDE)
    for odd in names:
        for content in (b"", b"\0", b"\xff" * 4, b"\xff" * 8, b"\x7f" + b"\xff" * 7, b"\xff" * 9, b"\xff" * 100):
            put = lambda name, n, odd=odd, content=content: media.element(name, content) if name == odd else media.unsigned(name, n)
            tracks = media.element(media.TRACKS, media.element(media.ENTRY, put(media.NUMBER, 1) + put(media.KIND, 2) + put(media.EACH, 20)))
            block = media.coded(1) + struct.pack(">h", 5) + b"\0" + b"frame"
            group = media.element(media.GROUP, media.element(media.BLOCK, block) + put(media.LASTS, 40))
            laced = media.element(media.SIMPLE, media.coded(1) + struct.pack(">h", 6) + bytes([0x80 | 2 << 1]) + b"\x01abcd")
            cluster = media.element(media.CLUSTER, put(media.TIME, 1000) + group + laced)
            cue = media.element(media.POINT, put(media.CUE_TIME, 1005) + media.element(media.PLACES, put(media.CUE_TRACK, 1) + put(media.CUE_CLUSTER, 0) + put(media.CUE_INSIDE, 3)))
            yield media._HEAD + media.element(media.SEGMENT, media.element(media.INFO, put(media.SCALE, 1_000_000)) + tracks + cluster + media.element(media.CUES, cue))


def test_ten_thousand_damaged_files_through_arrow(spark):
    files = list(extremes())
    small = media.mux(bytes(range(256)) * 9)
    rng = random.Random(7)
    while len(files) < 10_000:
        bad = bytearray(rng.choice((small, files[rng.randrange(70)])))
        for _ in range(rng.randint(1, 4)):
            bad[rng.randrange(len(bad))] = rng.choice((0, 1, 8, 0x7F, 0x80, 0xFF, rng.randrange(256)))
        files.append(bytes(bad[: rng.randint(len(bad) // 2, len(bad))] if rng.random() < 0.3 else bad))
    df = spark.createDataFrame(list(enumerate(files)), "doc_id long, media binary").repartition(4)
    size = {i: len(f) for i, f in enumerate(files)}
    n, last = 0, {}
    for r in media.packets(df).collect():
        assert 0 <= r.byte_offset and r.byte_length >= 0 and r.byte_offset + r.byte_length <= size[r.doc_id]
        last[r.doc_id] = max(last.get(r.doc_id, -1), r.packet)
        n += 1
    assert n == sum(last.values()) + len(last) > 10_000
    assert all(r.doc_id in size for r in media.cues(df).collect())


def test_cues_find_their_packets(spark):
    files = [media.mux(random.Random(i).randbytes(n)) for i, n in enumerate((0, 100, 5000, 30_000, 92_160))]
    df = spark.createDataFrame(list(enumerate(files)), "doc_id long, media binary")
    packets = {(r.doc_id, r.packet): r for r in media.packets(df).collect()}
    rows = media.cues(df).collect()
    assert len(rows) == sum(len(media.File(f).clusters) for f in files) > 5
    for r in rows:
        p = packets[r.doc_id, r.packet]
        assert (p.timestamp_ns, p.track, p.cluster, p.cued) == (r.timestamp_ns, r.track, r.cluster, True)
        assert files[r.doc_id][r.cluster_offset : r.cluster_offset + 4] == bytes.fromhex("1f43b675")
    assert media.cues(empty(spark)).count() == 0


def test_two_segments_and_wrong_codec():
    def segment(text):
        tracks = media.element(media.TRACKS, media.element(media.ENTRY, media.unsigned(media.NUMBER, 1) + media.element(media.CODEC, b"\xff\xfe\0")))
        block = media.element(media.SIMPLE, media.coded(1) + struct.pack(">h", 0) + b"\x80" + text)
        cluster = media.element(media.CLUSTER, media.unsigned(media.TIME, 3) + block)
        place = len(tracks)
        cue = media.element(media.POINT, media.unsigned(media.CUE_TIME, 3) + media.element(media.PLACES, media.unsigned(media.CUE_TRACK, 1) + media.unsigned(media.CUE_CLUSTER, place)))
        return media.element(media.SEGMENT, tracks + cluster + media.element(media.CUES, cue))

    data = media._HEAD + segment(b"one") + segment(b"two")
    f = media.File(data)
    t, c = f.table(), f.cue_table()
    assert f.error is None and payload(data) == b"onetwo" and t["cued"] == [True, True] and t["codec"] == ["\ufffd\ufffd"] * 2
    assert c["packet"] == [0, 1] and c["cluster"] == [0, 1]
    assert all(data[a : a + 4] == b"\x1f\x43\xb6\x75" for a in c["cluster_offset"])


def test_files_of_a_folder(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.mkv").write_bytes(media.mux(b"x" * 200 * i))
    got = media.packets(media.read_files(spark, str(tmp_path)), "path").groupBy("path").count().collect()
    assert sorted(r["count"] for r in got) == [2, 3]


def test_packets_of_tables(spark):
    got = media.packets(media.muxed(awkward(spark))).collect()
    want = {}
    for r in ROWS:
        want[r[0]] = want.get(r[0], 0) + -(-len((r[1] or "").encode()) // media.FRAME)
    have = {k: 0 for k in want}
    for r in got:
        have[r.doc_id] += 1
    assert have == want
    assert sum(r.byte_length for r in got if r.doc_id == 8) == len(LONG)
    assert media.packets(media.muxed(empty(spark))).count() == 0
    odd = spark.createDataFrame([("x", None), ("y", b""), ("z", b"junk"), (None, media.mux(b"abc"))], "doc_id string, media binary")
    assert [(r.doc_id, r.byte_length) for r in media.packets(odd).collect()] == [(None, 3)]


def test_query_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    parts = {}
    for r in media.query(spark, SF).orderBy("doc_id", "packet").collect():
        parts.setdefault(r.doc_id, []).append(media.mux(docs[r.doc_id].encode())[r.byte_offset : r.byte_offset + r.byte_length])
    assert {k: b"".join(v).decode() for k, v in parts.items()} == {k: v for k, v in docs.items() if v}


# --- HTML ---

CASES = [
    ("<p>a<p>b <b>c</b>d<br>e", "a\n\nb cd\ne"),
    ("<ul><li>one<li>two<ul><li>in</ul><li>3</ul>x", "- one\n- two\n  - in\n- 3\n\nx"),
    ("<ol start=3><li>q<li value=9>r<li>s</ol>", "3. q\n9. r\n10. s"),
    ("<ol reversed><li>q<li>r</ol>", "2. q\n1. r"),
    ("a<pre>\n  x\n   y</pre>b", "a\n\n  x\n   y\n\nb"),
    ("<table>lost<tr><td>1</table>", "lost\n\n1"),
    ("<table><tr><th>name<th>n<tr><td>x<td>10<tr><td>longer<td>7</table>", "name    n\nx       10\nlonger  7"),
    ("<table><tr><td colspan=2>wide wide wide<td>z<tr><td>a<td>b<td>c</table>", "wide wide wide  z\na  b            c"),
    ("<table><tr><td rowspan=2>A<td>b<tr><td>c</table>", "A  b\n   c"),
    ("<table><tfoot><tr><td>end<tbody><tr><td>mid<thead><tr><td>top</table>", "top\nmid\nend"),
    ("<table><caption>cap</caption><td>1<td>2</table>", "cap\n1  2"),
    ("<div hidden>x</div>y<span style='DISPLAY : none'>z</span>", "y"),
    ("<div style='visibility:hidden'>a<b style='visibility:visible'>b</b></div>", "b"),
    ("<style>.k, #i {display:none}</style><p class='q k'>no<p id=i>no<p>yes", "yes"),
    ("<script>var a = '</p>';</script>t<noscript>n</noscript><template>x</template>", "t"),
    ("<title>t</title><body>b", "b"),
    ("a<!-- x > y -->b<!-->c<!doctype html>d<?php e?>f</>g</ h>i", "abcdfgi"),
    ("a &lt;b&gt; &amp;amp; &#228; &copy &notit; &nope;", "a <b> &amp; ä © ¬it; &nope;"),
    ("1 < 2 and 3 <4", "1 < 2 and 3 <4"),
    ("<a title='>' href=\"<\">x</a><a b=c>y", "xy"),
    ("a<b", "a"),
    ("a<!-- never closed", "a"),
    ("x<textarea>\n <b> &lt;</textarea>", "x\n <b> <"),
    ("<details><summary>s</summary>no</details><details open>yes</details><dialog>no</dialog>", "s\nyes"),
    ("<dl><dt>t<dd>d<dd>e</dl>", "t\n  d\n  e"),
    ("<select><option>1<option>2</select>", "1\n2"),
    ("  a \n\t b  <b> c</b> <i> d", "a b c d"),
    ("<p>a</div></p>b</p>c", "a\n\nb\n\nc"),
    ("<h1>A</h2>b", "A\n\nb"),
    ("<b><p>x</b>y", "xy"),
    ("x\0y\r\nz", "xy z"),
    ("", ""),
    ("<p></p><div> </div>", ""),
]


@pytest.mark.parametrize(("html", "text"), CASES)
def test_cases(html, text):
    assert render(html) == text


def test_deep_long_and_hostile_pages():
    assert render("<div>" * 50_000 + "deep") == "deep"
    assert render("<li>" * 3000 + "x") == "- x"
    assert "x" in render("<table><td>" * 2000 + "x")
    assert render("<b>" * 3000 + "x" + "</b>" * 3000) == "x"
    assert len(render("word " * 500_000)) == 5 * 500_000 - 1
    assert render("<a b='" * 20_000) == ""
    assert render("<table>" + "<tr>" + "<td rowspan=9 colspan=1000>c" * 300 + "</table>").split() == ["c"] * 300


class Plain(HTMLParser):
    """All words outside scripts, styles and heads, by another parser."""

    def __init__(self):
        super().__init__()
        self.words, self.off = [], 0

    def handle_starttag(self, tag, attrs):
        self.off += tag in ("script", "style", "title")

    def handle_endtag(self, tag):
        self.off -= tag in ("script", "style", "title")

    def handle_data(self, data):
        if not self.off:
            self.words += data.split()


def test_query_against_another_parser(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {r.page_id: r.text for r in html_text.query(spark, SF).collect()}
    assert got.keys() == pages.keys()
    for k, html in pages.items():
        p = Plain()
        p.feed(html)
        assert [w for line in got[k].split("\n") for w in line.removeprefix("- ").split()] == p.words


def test_awkward_pages(spark):
    rows = [(1, "u", "<p>a"), (1, "u", "<p>a"), (2, None, None), (3, "u", ""), (None, "u", "b")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, text string, html string")).collect()
    assert {(r.page_id, r.text) for r in got} == {(1, "a"), (2, None), (3, ""), (None, "b")}
    assert len(got) == 5 and html_text.extract(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_rows_that_never_end():
    """Cells that span all further rows: ends with the row group, and padding has a bound."""
    one = "<table><tbody><tr><td rowspan=0>a<td>b<tr><td>c</tbody><tbody><tr><td>d<td>e</table>"
    assert render(one).split("\n") == ["a  b", "   c", "d  e"]
    many = "<table>" + "<tr><td rowspan=0>x" * 4000 + "</table>"
    text = render(many)
    assert text.count("x") == 4000 and len(text) < 4000 * 1100


def test_deep_nesting():
    for n in (100, 511, 3000):
        for tag in ("div", "b", "blockquote", "ul><li", "table><tr><td"):
            assert "deep" in render(f"<{tag}>" * n + "deep")
