"""HTML extraction and WARC archives."""

import base64
import hashlib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from tests.llm.rows import listed
from tests.oracle import connect, duckdb_rows, spark_rows
from tracewright.llm import html, warc

PAGE = "page_id long, url string, html string"


def site(i, paragraphs, comments=2, article=True, note=""):
    body = f"<h1>Title {i} &amp; more</h1>" + "".join(f"<p>Paragraph {i}.{k}  with <b>bold</b>\n text &lt;{k}&gt;</p>" for k in range(paragraphs))
    body += f"<ul><li>item {i}</li><li>item</li></ul>"
    inner = f"<article>{body}</article>" if article else f'<div class="body">{body}</div>'
    return (
        f"<!DOCTYPE html><html><head><title>T{i}</title><style>p{{}}</style><script>var t='</p><p>no';</script></head><body><header><h2>Site</h2></header>"
        f"<nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li></ul></nav><div class='cookie-notice'><p>We use cookies</p></div>{note}"
        f"<div class='wrap'>{inner}<div class='sidebar'><p>Links</p></div></div><!-- ad --><div class=\"ad\">Buy {i}</div>"
        f"<section id='comments'>{''.join(f'<div class=comment><p>I disagree {i}.{k}</p></div>' for k in range(comments))}</section>"
        f"<form><label>mail</label><input></form><footer>&copy; all {i}</footer></body></html>"
    )


def expected(i, paragraphs):
    return "\n".join([f"Title {i} & more", *(f"Paragraph {i}.{k} with bold text <{k}>" for k in range(paragraphs)), f"item {i}", "item"])


@pytest.mark.parametrize("article", [True, False])
def test_main_text_of_a_site(article):
    pages = [site(i, i % 4 + 1, i % 3, article, "<p>Breaking: read this</p>" if not article else "") for i in range(9)]
    wrapper = json.loads(json.dumps(html.infer(pages[:6])))
    known = {}
    for i, page in enumerate(pages):
        assert html.main_text(page, wrapper, known) == expected(i, i % 4 + 1)
    assert known


def test_two_templates_on_one_host():
    """A page without a main zone keeps its own text, whatever the host's other pages have."""
    plain = [f"<body><div class=body><h3>Head {i}</h3><pre>Code {i}</pre><p>Text {i}</p></div></body>" for i in range(4)]
    pages = [f"<body><article><p>Story {i}</p></article></body>" for i in range(4)] + plain
    wrapper = json.loads(json.dumps(html.infer(pages)))
    for i, page in enumerate(plain):
        assert html.main_text(page, wrapper, {}) == f"Head {i}\nCode {i}\nText {i}"


@pytest.mark.parametrize(
    "source, want",
    [
        ("<article><h2 id='search-and-rescue'>Search</h2><section id='related-work'><p>Work</p></section></article>", "Search\nWork"),
        ("<article><section id='comments'><p>No</p></section><div class='share-bar'>No</div><p>Yes</p></article>", "Yes"),
        ("<div><p class=share>Share<p>One<p>Two</div>", "One\nTwo"),
        ("<div class='text-center'>Centred</div><div><p>Story</p></div>", "Centred\nStory"),
        ("<ul class='post-list'><li>Item</ul><div><p>Story</p></div>", "Item\nStory"),
        ("<div><p>Other</p></div><div class='post-body'><p>Story</p></div>", "Story"),
    ],
)
def test_zones_of_names(source, want):
    assert html.main_text(source, None) == want


def test_wrapper_decides_inside_an_article():
    """A notice without a telling name, the same on every page, stands inside the article."""
    pages = [f"<body><article><h1>Head {i}</h1><div class=box>Our terms changed</div>" + "".join(f"<p>Text {i}.{k}</p>" for k in range(i % 3 + 1)) + "</article></body>" for i in range(6)]
    wrapper = json.loads(json.dumps(html.infer(pages[:4])))
    for i, page in enumerate(pages):
        want = [f"Head {i}", *(f"Text {i}.{k}" for k in range(i % 3 + 1))]
        assert html.main_text(page, wrapper, {}) == "\n".join(want)
        assert html.main_text(page, None) == "\n".join([want[0], "Our terms changed", *want[1:]])


def test_headings_that_every_article_has_stay():
    """In the article's flow, in a box with text of its own, and as labels of a table."""
    for open_, close in (("", ""), ("<div class=inner>", "</div>"), ("<div class=inner><section id=s1>", "</section></div>")):
        pages = [f"<body><article>{open_}<h1>Head {i}</h1><h2>Background</h2><p>Text {i}</p><h2 class=sub>Method</h2><table><tr><td class=k>Size</td><td>{i} m</td></tr></table><p>Same words</p>{close}<div class=box><p>Our terms changed</p></div></article></body>" for i in range(6)]
        wrapper = json.loads(json.dumps(html.infer(pages[:4])))
        for i, page in enumerate(pages):
            assert html.main_text(page, wrapper, {}) == "\n".join([f"Head {i}", "Background", f"Text {i}", "Method", "Size", f"{i} m", "Same words"])
            assert html.main_text(page, None).endswith("Our terms changed")


def test_links_and_items_are_seen_at_any_depth():
    inner = "<b><i><u><s><em>"
    assert html.Page(f"<a href=x>{inner}far</em></s></u></i></b></a>").tokens[-7][0] == "#a"
    assert html.main_text(f"<ul><li>{inner}{inner}one<li>two</ul>", None) == "one\ntwo"


def test_wrapper_decides_without_telling_names():
    pages = [f"<body><div class=x1><p>Top line</p></div><div class=x2><h3>Head {i}</h3><p>Story {i}</p></div><div class=x3><p>Bottom line</p></div></body>" for i in range(5)]
    wrapper = json.loads(json.dumps(html.infer(pages[:4])))
    assert [html.main_text(p, wrapper, {}) for p in pages] == [f"Head {i}\nStory {i}" for i in range(5)]
    assert html.main_text(pages[4], None) == "Top line\nHead 4\nStory 4\nBottom line"


@pytest.mark.parametrize("bits", [1, 40, 10**9])
def test_alignment_is_a_longest_common_subsequence(bits, monkeypatch):
    monkeypatch.setattr(html, "MOST_BITS", bits)
    rng = random.Random(bits)
    for _ in range(150):
        x, y = ([rng.choice("abcd") for _ in range(rng.randint(0, 25))] for _ in range(2))
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, a in enumerate(x):
            for j, b in enumerate(y):
                best[i + 1][j + 1] = best[i][j] + 1 if a == b else max(best[i][j + 1], best[i + 1][j])
        found = html._matches(x, y)
        assert all(x[i] == y[j] for i, j in found) and found == sorted(found)
        assert len({i for i, _ in found}) == len({j for _, j in found}) == len(found) == best[-1][-1]
        covered = [(a, b, c, d) for _, a, b, c, d in html._steps([[s] for s in x], [[s] for s in y])]
        assert sum(b - a for a, b, _, _ in covered) == len(x) and sum(d - c for _, _, c, d in covered) == len(y)


def test_wrapper_has_slots_options_and_repeats():
    wrapper = html.infer([site(1, 1, 0), site(2, 3, 2), site(3, 2, 1)])

    def flat(nodes):
        for n in nodes:
            yield n
            yield from flat(n[2] or [])

    symbols = [n[0] for n in flat(wrapper)]
    assert "+p" in symbols and "+li" in symbols and "#" in symbols
    assert any(n[1] for n in flat(wrapper))


@pytest.mark.parametrize("source", ["", "plain text", "<", "<p", "a < b > c", "<p>" * 3000 + "x" + "</p>" * 9, "<div>" * 3000 + "deep", "<script>never closed", "</p></div>", "<b><p>un<p>closed", "<p title='a>b'>x</p>", "&#0;&bogus;&amp"])
def test_broken_pages(source):
    text = html.main_text(source, html.infer([source, site(1, 2)]), {})
    assert isinstance(text, str) and "\x00" not in text.replace("�", "")
    assert html.main_text("plain text", None) == "plain text"
    assert html.main_text("<p title='a>b'>x</p>", None) == "x"
    assert html.main_text("<b><p>un<p>closed", None) == "un\nclosed"


@pytest.mark.parametrize("extra", [False, True])
def test_page_rows(spark, extra):
    rows = [(i, f"https://{'a' if i % 3 else 'b'}.example.com/{i}", site(i, i % 5)) for i in range(30)]
    rows += [(100, "https://a.example.com/x", None), (101, None, site(101, 2)), (102, "no host", ""), (None, "https://c.example.com/", site(7, 1)), (3, rows[3][1], rows[3][2]), (103, "http://A.example.com", site(103, 4000))]
    pages = spark.createDataFrame(rows, PAGE)
    if extra:
        pages = pages.withColumns({c: F.lit("x") for c in ("host", "wrapper", "text", "rank", "n_chars")})
    for limit in (0, 32_000_000):
        found = html.extract(pages, broadcast_bytes=limit)
        want = sorted(((p, u, t, len(t)) for p, u, t in ((p, u, "" if not h else expected(int(re.search(r"Title (\d+)", h).group(1)), h.count("<p>Paragraph"))) for p, u, h in rows)), key=repr)
        assert listed(found, "page_id", "url", "text", "n_chars") == want
    assert html.extract(pages.where("false")).count() == 0


def test_extraction_of_the_table(spark, sf):
    import html as entities

    for r in html.op4_html_extraction(spark, sf).join(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inner = re.split("</article>|<footer", r["html"].split("<article>")[1])[0].replace("<br>", " ")
        blocks = (" ".join(entities.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", inner))
        assert r["text"] == "\n".join(b for b in blocks if b)


def payloads(rows):
    first = {}
    for page, _, h in rows:
        if page is not None:
            first[h or ""] = min(page, first.get(h or "", page))
    out = []
    for page, _, h in rows:
        data = (h or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        revisit = first.get(h or "", page) != page
        out.append((page, len(data), digest, "revisit" if revisit else "response", first[h or ""] if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("extra", [False, True])
def test_archive_round_trip(spark, extra):
    rng = random.Random(2)
    bodies = ["", None, "<p>é 漢</p>", "x" * 200_000, *(f"<p>{rng.random()}</p>" for _ in range(40))]
    rows = [(k, f"https://www.{rng.choice('abc')}.example.com:8080/{rng.randint(0, 9)}?q={k % 7}#f", rng.choice(bodies)) for k in rng.sample(range(10_000), 300)]
    rows += [(20_000, None, "z"), (20_001, "bad\r\nurl: x", "z"), (20_002, "https://www.a.example.com/", "z"), (None, "https://n.example.com/", "z"), (-3, "u", "<p>é 漢</p>")]
    pages = spark.createDataFrame(rows, PAGE)
    if extra:
        pages = pages.withColumns({c: F.lit("x") for c in ("key", "sha", "revisit", "first", "file", "offset")})
    found = warc.archive(pages.repartition(5))
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    want = [x if x[0] is not None else (None, *x[1:3], "revisit", 20_000) for x in payloads(rows)]
    assert listed(found, *columns) == sorted(want, key=repr)


def test_small_payloads_do_not_revisit(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "v", "ab"), (3, "w", "abcd"), (4, "x", "abcd")], PAGE)
    assert listed(warc.archive(pages, min_bytes=3), "page_id", "record_type", "refers_to") == [(1, "response", None), (2, "response", None), (3, "response", None), (4, "revisit", 3)]
    assert warc.archive(pages.where("false")).count() == 0


def test_equal_rows_each_have_a_record(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (1, "u", "ab"), (1, "v", "ab")], PAGE)
    assert listed(warc.archive(pages), "page_id", "record_type", "refers_to") == [(1, "response", None), (1, "response", None), (1, "revisit", 1)]


def test_binary_search_in_the_index(spark, tmp_path):
    pages = spark.createDataFrame([(k, f"https://{'hot' if k % 3 else f'h{k}'}.example.com/{k % 400}", f"<p>{k}</p>") for k in range(1200)], PAGE)
    captures = warc.write(pages, str(tmp_path))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        shards = warc.shard_list(warc.index(captures, str(tmp_path), block_lines=16))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(shards) > 1
    known = warc.Index(str(tmp_path), shards)
    rows = captures.collect()
    for r in rows[::7]:
        (capture,) = known.find(r["key"])
        assert capture == list(r)
        assert known.read(capture)["page_id"] == r["page_id"]
    assert known.find("absent") == [] and known.find("") == [] and known.find("zzzz") == []
    assert sorted(r["key"] for r in rows)[0].startswith("com,example,")


def test_a_damaged_record_is_noticed():
    data = warc.record(1, "u", b"abc", base64.b32encode(hashlib.sha1(b"abd").digest()).decode(), False, None)
    with pytest.raises(ValueError, match="damaged"):
        warc.parse(data)


def test_surt(spark):
    df = spark.createDataFrame([("https://WWW.Example.com:80/A/b?q=1#x",), ("http://u@h.org",), (None,), ("junk",)], "url string")
    assert [r[0] for r in df.select(warc.surt("url")).collect()] == ["com,example,www)/A/b?q=1", "org,h)", ")", ")junk"]


def test_warc_oracle(spark, sf):
    assert spark_rows(warc.op10_warc(spark, sf)) == duckdb_rows(connect(sf), warc.ORACLE)


def test_warc_oracle_on_awkward_pages(spark, tmp_path):
    rows = [(1, "u", None), (2, "u", ""), (None, "u", "é漢"), (None, "t", "é漢"), (4, None, "x"), (4, "a", "x"), (4, "a", "x"), (9, "b", "x"), (9, "c", "z" * 70_000)]
    pages = spark.createDataFrame(rows, PAGE)
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    (tmp_path / "pages.parquet" / "_SUCCESS").unlink()
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert spark_rows(warc.archive(pages)) == duckdb_rows(con, warc.ORACLE)


def notices(n, odd):
    """Articles with a box that says the same on all pages of a host but one."""
    return [f"<body><article><h1>Head {i}</h1><div class=box>{'Closed today' if i == odd else 'Open today'}</div>{'<ul><li>x</li></ul>' * (i % 7)}<p>Text {i}</p></article></body>" for i in range(n)]


@pytest.mark.parametrize("at_once, held", [(32, 50_000), (2, 1)])
def test_every_page_of_a_host_has_its_say(spark, at_once, held):
    """The one page that differs makes the box text of its own, wherever it lies; a host without one keeps its template."""
    rows = [(i, "https://a.example.com/", h) for i, h in enumerate(notices(60, 41))] + [(100 + i, "https://b.example.com/", h) for i, h in enumerate(notices(60, None))]
    pages = spark.createDataFrame(rows, PAGE).repartition(5)
    found = {r["page_id"]: r["text"].split("\n") for r in html.extract(pages).collect()}
    assert all(("Open today" in found[i]) == (i != 41) and ("Closed today" in found[i]) == (i == 41) for i in range(60))
    assert not any("Open today" in found[100 + i] for i in range(60))
    read = pages.select(html.host().alias("host"), "html")
    same = {r["host"]: json.loads(r["wrapper"]) for r in html.wrappers(read, at_once, held).collect()}
    for host, wrapper in same.items():
        for i, _, h in rows:
            if ("a.ex" in host) == (i < 100):
                assert html.main_text(h, wrapper, {}).split("\n") == found[i]


def test_copies_of_a_page_count_once(spark):
    page = "<body><article><h1>Head</h1><div class=box>Open today</div><p>Text</p></article></body>"
    rows = spark.createDataFrame([(i, "https://a.example.com/", page) for i in range(9)], PAGE)
    assert {r["text"] for r in html.extract(rows.repartition(4)).collect()} == {"Head\nOpen today\nText"}
