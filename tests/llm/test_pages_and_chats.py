import base64
import gzip
import hashlib
import os
import time
import re

import pytest

from claimspark.llm import chat_format, html_extract, warc

PAGES = "page_id long, url string, html string, id string, text string, templates string, path string"
CHATS = "conv_id long, turn long, role string, text string, pos int, turns string, source string"


def pages_frame(spark, rows):
    return spark.createDataFrame([(*r, "i", "t", "p", "q") for r in rows], PAGES)


def plain(rows):
    return sorted((tuple(r) for r in rows), key=lambda t: tuple((v is None, str(v)) for v in t))


# -- html ------------------------------------------------------------------------

def extract(spark, rows, **options):
    out = html_extract.extract_text(pages_frame(spark, rows), **options)
    got = [tuple(r) for r in out.select("page_id", "url", "text", "n_chars").collect()]
    assert all(n == len(t) for _, _, t, n in got)
    return {(i, u): t for i, u, t, _ in got}


def body(site, k, main, extra=""):
    return (f"<!DOCTYPE html><html><head><title>T {k}</title><style>p{{}}</style><script>var x='</p>';</script></head><body>"
            f"<header><h1>{site}</h1></header><nav><ul><li><a href='/a'>Home</a></li><li>More</li></ul></nav>"
            f"<!-- ad {k} --><div class='ad'>Buy {k}!</div>{main}{extra}"
            f"<footer>&copy; {site} &middot; all rights</footer></body></html>")


def test_article_without_furniture(spark):
    rows = []
    for k in range(12):
        main = (f"<article><h1>Title&nbsp;{k} &amp;&amp; co</h1><p>First  line\n of <b>story {k}</b>.<p>Second &eacute;&#233;&#xe9;<br>after"
                f"<p>Shared words of all pages.</p><ul><li>one {k}<li>two</ul><form>Name <input></form>"
                f"<div class='comments'><p>Reader {k} says</p></div></article>")
        rows.append((k, f"https://www.Site{k % 2}.example:80/p/{k}", body("Site", k, main, "<aside>side</aside>")))
    got = extract(spark, rows)
    for k, url, _ in rows:
        assert got[(k, url)] == f"Title {k} && co First line of story {k}. Second ééé after Shared words of all pages. one {k} two"


def test_article_inside_main_and_its_own_header(spark):
    page = ("<body><main><p>teaser</p><article class='post'><div class='entry-header'><h1>Title</h1></div><header><p>By me</p></header>"
            "<p>Text</p><div id='cookie-notice'>We use</div><section class='commentList'><p>x</p></section><article class='comment'>y</article>"
            "<div role='complementary'>z</div></article><div class=sidebar>s</div></main></body>")
    rows = [(1, "http://a.example/", page), (2, "http://a.example/", "<main><p>only main</p><nav>n</nav></main><p>after</p>")]
    got = extract(spark, rows)
    assert got[(1, "http://a.example/")] == "Title By me Text" and got[(2, "http://a.example/")] == "only main"


@pytest.mark.parametrize("bound", [html_extract.BROADCAST_BYTES, 0])
def test_templates_are_counted_per_host(spark, monkeypatch, bound):
    monkeypatch.setattr(html_extract, "BROADCAST_BYTES", bound)
    def page(k, host):
        return (k, f"http://{host}/x{k}", "<html><body><div class=top><span>Welcome to the site</span></div>"
                f"<div><p>Own words {k}</p></div><p>Terms apply here</p></body></html>")

    rows = [page(k, "many.example") for k in range(20)] + [page(100 + k, f"h{k}.example") for k in range(20)]
    got = extract(spark, rows, min_pages=5)
    for k, url, _ in rows:
        own = f"Own words {k}"
        assert got[(k, url)] == (own if k < 100 else f"Welcome to the site {own} Terms apply here")


@pytest.mark.parametrize("bound", [html_extract.BROADCAST_BYTES, 0])
def test_pages_of_null_and_shared_ids_use_their_own_host(spark, monkeypatch, bound):
    monkeypatch.setattr(html_extract, "BROADCAST_BYTES", bound)
    rows = [(None if k % 2 else 7, f"http://t.example/x{k}", f"<div>Terms apply</div><p>Own {k}</p>") for k in range(12)]
    rows += [(i, f"http://other.example/{i}", f"<div>Terms apply</div><p>Other {i}</p>") for i in (None, 7)]
    got = extract(spark, rows)
    assert got == {(i, u): f"Own {u.split('x')[-1]}" if "t.example" in u else f"Terms apply Other {i}" for i, u, _ in rows}


def test_recurring_pieces_of_running_text_stay(spark):
    def some(k):  # on 6 of 40 pages
        return "<h2>Summary</h2><table><tr><td>0</td><td>v%d</td></tr></table>" % k if k < 6 else ""

    rows = [(k, f"http://plain.example/{k}", f"<div class=top>Welcome</div><p>Own {k} <b>note</b> by <a href=/b>Berlin</a> end.</p>{some(k)}"
             f"<h2>Facts</h2><p>More {k}</p><div>cut <section>in two</section> here {k}</div><h3>Links</h3><ul><li>a<li>b</ul>") for k in range(40)]
    rows += [(100 + k, f"http://marked.example/{k}", f"<div class=x>Site</div><article><div class=body><p>Own{k}<sup>2</sup> <u>under</u> "
              f"<small>fine</small> <cite>cited</cite></p><table><tr><td>Year</td></tr><tr><td>{k}</td></tr></table></div></article>") for k in range(12)]
    got = extract(spark, rows)
    for k, url, _ in rows[:40]:
        assert got[(k, url)] == (f"Own {k} note by Berlin end. " + (f"Summary 0 v{k} " if k < 6 else "")
                                 + f"Facts More {k} cut in two here {k}")
    for k, url, _ in rows[40:]:
        assert got[(k, url)] == f"Own{k - 100}2 under fine cited Year {k - 100}"


def test_copies_of_a_page_are_no_template(spark):
    copy = "<html><body><div class=wrap><h1>Title</h1><p>First words</p><p>Second words</p></div></body></html>"
    rows = [(k, f"http://copies.example/{k}", copy) for k in range(6)]
    rows += [(10 + k, f"http://near.example/{k}", f"{copy}<p>Seen {k} times</p>") for k in range(6)]
    rows += [(20 + k, f"http://marked.example/{k}", f"<article><div><p>All words</p><p>of it</p></div><p>{k}</p></article>") for k in range(6)]
    got = extract(spark, rows)
    for k, url, _ in rows:
        assert got[(k, url)] == ("Title First words Second words" + (f" Seen {k - 10} times" if k >= 10 else "")
                                 if k < 20 else f"All words of it {k - 20}")


BODY = "<p>" + "Long words of the article. " * 5 + "</p>"
TOLD = ("Long words of the article. " * 5).strip()


@pytest.mark.parametrize("source, want", [
    (f"<form id=aspnetForm><div><h1>T</h1>{BODY}</div><input><button>Go</button></form>", f"T {TOLD}"),
    (f"<div class='layout has-sidebar'><article><h1>T</h1>{BODY}</article></div>", f"T {TOLD}"),
    (f"<div class='layout has-sidebar'><h1>T</h1>{BODY}</div>", f"T {TOLD}"),
    (f"<div class=sidebar><article>{BODY}</article></div>", TOLD),
    ("<main><h1>Title</h1>text of it<article class=card>Other story</article></main>", "Title text of it"),
    (f"<main><h1>Title</h1>{BODY}<article>Other</article></main>", f"Title {TOLD} Other"),
    (f"<main><h1>Title</h1><article>{BODY}</article><div>Read also</div></main>", f"Title {TOLD}"),
    (f"<header><h1>Site</h1></header><main><header><h1>Title</h1></header><article>{BODY}</article></main>", f"Title {TOLD}"),
    ("<article>Price <div class='share-price'>12</div><div class='share-buttons'>Tweet</div></article>", "Price 12"),
    (f"<section class=comments><article>{BODY * 4}</article></section><article>{BODY}</article>", TOLD),
    (f"<section class=related><article>One</article></section><article>{BODY}</article>", TOLD),
    (f"{BODY}<form class=newsletter>Your mail <input></form><footer>Imprint</footer>", TOLD),
    ("<p title=it's>quote</p><p class=\"x>broken</p><p>after</p>", "quote broken after"),
    ("a &#" + "1" * 6000 + "; b &#" + "0" * 6000 + "65; c", "a \ufffd b A c")])
def test_the_page_body_is_no_furniture(source, want):
    root = html_extract.parse(f"<html><head><title>t</title></head><body>{source}</body></html>")
    html_extract.hash_subtrees(root)
    assert html_extract.read_text(root, frozenset()) == want


@pytest.mark.parametrize("piece", ["<a ", "<a b=", "<div></span>", "<div>", '<a =">"', "<script></script ", "<", "<!--", "<p><b>x</b>",
                                   "<ul><li>", "&", "<a class='aB-"])
def test_hostile_pages_take_linear_time(piece):
    start = time.monotonic()
    root = html_extract.parse("<p>hello</p>" + piece * (1_000_000 // len(piece)))
    html_extract.hash_subtrees(root)
    assert html_extract.read_text(root, frozenset()).startswith("hello")
    assert time.monotonic() - start < 15  # seconds for 1 MB; a quadratic reader takes hours


def test_recurring_prose_goes_at_the_edges_of_articles(spark):
    rows = [(k, f"http://h/{k}", f"<article><h1>Title {k}</h1><p>Sponsored by nobody</p><p>Own words {k}</p><p>Quoted line</p><p>More of {k}</p>"
             "<p>Licence: free</p><ul><li>Report an error</li></ul></article>") for k in range(12)]
    got = html_extract.extract_text(pages_frame(spark, rows)).collect()
    assert {r["page_id"]: r["text"] for r in got} == {k: f"Title {k} Own words {k} Quoted line More of {k}" for k in range(12)}


def test_html_defined_results(spark):
    rows = [(1, "http://a.example/", None), (2, None, ""), (3, "nonsense", "no tags & text &lt;b&gt;"), (None, "http://a.example/", "<p>x"),
            (None, None, "<p>y"), (4, "http://a.example/", "<p>same"), (4, "http://a.example/", "<p>same"),
            (5, "http://a.example/", "<p>other"), (6, "http://a.example/", "<div>" * 3000 + "deep" + "</div>" * 10),
            (7, "http://a.example/", "<p>" + "long words " * 40000), (8, "x", "<p>a<!-- c <p>no</p>--><p>b<script>if (a<b) {}</script>c"),
            (9, "x", "<table><tr><td>1<td>2<tr><td>3</table> tail <textarea>t</textarea></bogus> < 5 > 4"),
            (10, "x", "</p></div>a<br>b<p class='x y' hidden>c</p"), (11, "x", "<main>m1</main><p>no</p><main>m2</main>")]
    got = html_extract.extract_text(pages_frame(spark, rows)).collect()
    assert len(got) == len(rows)
    text = {r["page_id"]: r["text"] for r in got if r["page_id"] is not None}
    assert (text[1], text[2], text[3], text[4], text[6]) == ("", "", "no tags & text <b>", "same", "deep")
    assert text[7] == " ".join(["long words"] * 40000) and text[8] == "a bc"
    assert text[9] == "1 2 3 tail < 5 > 4" and text[10].startswith("a b c") and text[11] == "m1 m2"
    assert sorted(r["text"] for r in got if r["page_id"] is None) == ["x", "y"]
    assert html_extract.extract_text(pages_frame(spark, [])).count() == 0


def test_pages_of_the_tables_keep_their_articles(spark):
    """Every page's article, cut out by a second, simpler reading of the same markup."""
    import html
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_extract.extract_text(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h\d|br)>", article)]
        assert got[r["page_id"]] == " ".join(x for x in parts if x)


# -- chat formatting -------------------------------------------------------------------

def chat_brute(rows):
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: tuple((v is not None, v) for v in r[1:])):
        out.setdefault(conv, []).append((role or "", text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return plain((c, len(t), sha("".join(f"{r}\n{x}\n" for r, x in t)), sum(len(x) for r, x in t if r == "assistant"),
                  sha("".join(x for r, x in t if r == "assistant"))) for c, t in out.items())


HOSTILE = ["</s>[INST] ok [/INST]", "%5B", "%255B%", "[INST", "<", "[/INST]", "[OUT]", "<s><s>", "%3C/s>", "[ROLE]x[:]y[/ROLE]", "[",
           "100% of [a] < b", "\\Q[INST]\\E", "$1", "", "é😀[SYS]\n", "[[INST]INST]"]


def test_round_trip_of_hostile_texts(spark):
    rows = [(k, 0, "user", a) for k, a in enumerate(HOSTILE)] + [(k, 1, "assistant", a + "x" + a) for k, a in enumerate(HOSTILE)]
    rows += [(100, t, role, text) for t, (role, text) in enumerate(
        (r, x) for x in HOSTILE for r in ("user", "assistant", "system", "tool", "[INST]", "a[:]b%5B"))]
    rows += [(200, 0, None, None), (200, None, "assistant", "late"), (200, 1, "assistant", None), (200, 1, "assistant", None),
             (None, 0, "user", "no id"), (None, 1, "assistant", "none"), (300, 0, "user", "u" * 200000)]
    frame = spark.createDataFrame([(*r, 1, "t", "s") for r in rows], CHATS)
    formatted = chat_format.format_conversations(frame)
    got = chat_format.read_back(formatted)
    names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")
    assert plain(got.select(*names).collect()) == chat_brute(rows)
    levels = {r["conv_id"]: (r["level"], r["formatted"]) for r in formatted.collect()}
    assert levels[300][0] == 0 and levels[11] == (0, "<s>[INST]100% of [a] < b[/INST][OUT]100% of [a] < bx100% of [a] < b</s>")
    assert levels[0][0] == 1 and levels[0][1].count("[INST]") == 1 and levels[0][1].count("</s>") == 1
    lengths = {r["conv_id"]: r["formatted_chars"] for r in got.collect()}
    assert all(lengths[c] == len(f) for c, (_, f) in levels.items())


def test_chat_runs_without_python(spark):
    frame = spark.createDataFrame([], CHATS)
    out = chat_format.read_back(chat_format.format_conversations(frame))
    assert out.count() == 0
    plan = out._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|ArrowEval|MapInArrow", plan)
    assert plan.count("Exchange hashpartitioning") <= 3  # logical and physical views of one shuffle


# -- WARC -----------------------------------------------------------------------------------

def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def warc_brute(rows):
    first = {}
    for i, _, text in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    return plain((i, len((text or "").encode()), digest(text),
                  "response" if i is None or first[text or ""] == i else "revisit",
                  None if i is None or first[text or ""] == i else first[text or ""]) for i, _, text in rows)


ROWS = [(5, "http://a/", "<p>one</p>"), (3, "u\r\nWARC-Type: x %0D", "<p>one</p>"), (9, None, "<p>one</p>"), (1, "b", None), (2, "c", ""),
        (7, "d", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"), (8, "e", "é\0\x1f" * 5), (None, "f", "<p>one</p>"),
        (None, "g", "alone"), (11, "h", "twice"), (11, "h", "twice"), (12, "i", "x" * 300000), (-4, "j", "neg"), (13, "j", "neg")]


@pytest.mark.parametrize("compress", [True, False])
@pytest.mark.parametrize("broadcast", [True, False])
def test_archives_read_back(spark, tmp_path, monkeypatch, compress, broadcast):
    if not broadcast:
        monkeypatch.setattr(warc, "BROADCAST_BYTES", 0)
    path = str(tmp_path / "w")
    warc.write_warc(warc.plan_records(pages_frame(spark, ROWS)), path, records_per_file=3, compress=compress)
    read = warc.read_warc(spark, path)
    assert warc.gap_log(read).count() == 0
    got = warc.records(read).collect()
    assert plain((None if r["record_id"] is None else int(r["record_id"]), r["payload_bytes"], r["payload_digest"],
                  r["record_type"], None if r["refers_to"] is None else int(r["refers_to"])) for r in got) == warc_brute(ROWS)
    assert {r["target_uri"] for r in got} == {u or "" for _, u, _ in ROWS} or {r["target_uri"] for r in got} == {u for _, u, _ in ROWS} | {None}
    assert {bytes(r["payload"]).decode() for r in got if r["record_type"] == "response"} == {t or "" for _, _, t in ROWS}


def test_empty_archive(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write_warc(warc.plan_records(pages_frame(spark, [])), path)
    assert warc.read_warc(spark, path).count() == 0


def record(k, payload):
    d = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    return (f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{k}>\r\nWARC-Payload-Digest: sha1:{d}\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode() + payload + b"\r\n\r\n"


def found(data):
    items = list(warc.salvage(data))
    return ([i[3]["warc-record-id"][10:-1] for i in items if i[0] == "record"],
            [(i[1], i[2], i[3]) for i in items if i[0] == "gap"])


def test_salvage_of_plain_archives():
    own = [record(k, f"payload {k} ".encode() * (k + 1)) for k in range(6)]
    assert found(b"".join(own)) == ([str(k) for k in range(6)], [])
    at = [sum(map(len, own[:k])) for k in range(7)]
    cut = bytearray(b"".join(own))
    cut[at[2] + len(own[2]) - 6] ^= 1  # a payload byte
    assert found(bytes(cut)) == (["0", "1", "3", "4", "5"], [(at[2], at[3], "digest")])
    data = own[0] + b"garbage WARC/1.1\r\nno header " + own[1] + own[2][:-9] + own[3]
    ids, gaps = found(data)
    assert ids == ["0", "1", "3"] and [g[2] for g in gaps] == ["header", "trailer"]
    assert sum(g[1] - g[0] for g in gaps) == len(data) - len(own[0]) - len(own[1]) - len(own[3])
    assert found(own[0][:-8]) == ([], [(0, len(own[0]) - 8, "truncated")])
    assert found(b"") == ([], []) and found(b"\0\0") == ([], [])
    inner = record(9, own[4] + own[5])  # a payload that holds records is one record
    assert found(inner) == (["9"], [])


def test_records_inside_a_damaged_record_are_none():
    quoted = record(99, b"quoted")
    hurt = bytearray(record(1, b"x" * 50 + quoted + b"y" * 50))
    hurt[-60] ^= 1  # the digest fails, the trailer stands
    for before, after in ((b"", b""), (record(0, b"a"), record(2, b"c")), (b"junk", b"\0" + gzip.compress(record(2, b"c")))):
        ids, gaps = found(before + bytes(hurt) + after)
        assert "99" not in ids and ids == [k for k, part in (("0", before), ("2", after)) if len(part) > 4]
        assert (len(before) if before != b"junk" else 4, len(before) + len(hurt), "digest") in gaps
    assert found(gzip.compress(bytes(hurt)))[0] == []


@pytest.mark.parametrize("compress", [True, False])
def test_archives_are_bounded_by_bytes(spark, tmp_path, compress):
    rows = [(k, "u", os.urandom(1500).hex()) for k in range(40)]
    path = str(tmp_path / "w")
    planned = warc.plan_records(pages_frame(spark, rows)).coalesce(1)
    warc.write_warc(planned, path, compress=compress, archive_bytes=10_000)
    sizes = [os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.startswith("part-")]
    assert len(sizes) >= 5 and max(sizes) < 10_000 + 4_000
    read = warc.read_warc(spark, path)
    assert {bytes(r["payload"]).decode() for r in warc.records(read).collect()} == {r[2] for r in rows} and warc.gap_log(read).count() == 0


def test_salvage_of_gzip_members():
    own = [record(k, os.urandom(200) + str(k).encode()) for k in range(6)]
    members = [gzip.compress(r) for r in own]
    assert found(b"".join(members)) == ([str(k) for k in range(6)], [])
    hurt = bytearray(members[2])
    hurt[60] ^= 0xFF
    data = members[0] + members[1] + bytes(hurt) + members[3] + b"\0" + members[4] + members[5][:50]
    ids, gaps = found(data)
    start = len(members[0]) + len(members[1])
    assert ids == ["0", "1", "3", "4"] and gaps[0] == (start, start + len(hurt), "gzip")
    assert gaps[1][0] == len(data) - 50 and gaps[1][1] == len(data)
    whole = gzip.compress(own[0] + b"junk" + own[1])  # one member with a gap inside
    ids, gaps = found(whole)
    assert ids == ["0", "1"] and gaps == [(0, len(whole), "member: header")]


def test_gap_log_from_files(spark, tmp_path):
    good, bad = record(1, b"a"), record(2, b"b")
    (tmp_path / "x.warc").write_bytes(good + b"lost" + bad)
    (tmp_path / "y.warc.gz").write_bytes(gzip.compress(record(3, b"c")) + b"\x1f\x8b\x08 broken")
    read = warc.read_warc(spark, str(tmp_path))
    assert sorted(r["record_id"] for r in warc.records(read).collect()) == ["1", "2", "3"]
    gaps = {(os.path.basename(r["path"]), r["end"] - r["start"], r["why"]) for r in warc.gap_log(read).collect()}
    assert gaps == {("x.warc", 4, "header"), ("y.warc.gz", 10, "gzip")}
