"""Pages, conversations and embeddings: round trips, brute force and awkward rows."""

import base64
import gzip
import hashlib
import html as entities
import re
from collections import Counter, defaultdict

import pytest
from oracle_check import compare, duck
from pyspark.sql import functions as F

from retailflow.llm import chat_format, cross_polytope, html_wrapper, queries, warc

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.STATEMENTS))
def test_against_sql(spark, name):
    problem, n = compare(queries.QUERIES[name](spark, SF), duck(SF), queries.STATEMENTS[name])
    assert problem is None and n > 0


# -- pages ---------------------------------------------------------------------


def article(page):
    """The article's blocks, read off these pages' fixed markup."""
    found = re.search(r"<article>(.*?)(</article>|$)", page or "", re.S)
    body = re.sub(r"</?(?:p|h1)>", "\x01", found[1]) if found else ""
    body = re.sub(r"<[^>]*>", "", body.replace("<br>", " "))
    return "\n\n".join(x for x in (" ".join(entities.unescape(b).split()) for b in body.split("\x01")) if x)


def test_extraction_of_given_pages(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = queries.op1_html_wrapper(spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r["text"] == article(pages[r["page_id"]]["html"])
        assert (r["url"], r["n_chars"]) == (pages[r["page_id"]]["url"], len(r["text"]))


def test_template_is_induced_where_nothing_names_the_parts(spark):
    def page(k):
        body = "".join(f"<p>Story {k} paragraph {j} &amp; more.</p>" for j in range(1 + k % 3))
        return (
            f"<html><body><div class=x>All our stories</div><table><tr><td>Since <b>1999</b></table>"
            f"<div class=y><h2>Story {k}</h2>{body}</div><div class=z><p>Printed by hand</div></body></html>"
        )

    rows = [(k, "http://h.example/" + str(k), page(k)) for k in range(12)]
    rows += [(50, "http://h.example/50", page(3)), (60, "http://alone.example/", page(0))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_wrapper.extract(df).collect()}
    for k in range(12):
        want = [f"Story {k}"] + [f"Story {k} paragraph {j} & more." for j in range(1 + k % 3)]
        assert got[k] == "\n\n".join(want)
    assert got[50] == got[3]
    assert got[60].startswith("All our stories")  # a single page shows no template


def test_known_parts_go_and_the_article_stays():
    page = """<body class="no-sidebar"><header><h2>Site</h2></header><nav>menu</nav><div id="cookie-notice">ok?</div>
    <main><article><header><h1>Title</h1></header><p>One<p>Two &eacute;&#x41;<aside>see also</aside>
    <form>join <input></form><script>if (a < b) "</p>";</script><style>p{}</style><blockquote>Quoted  text</blockquote>
    <ul><li>first<li>second</ul><div class="comments"><p>me too</div><div class="adBox">buy</div></article></main>
    <div class="sidebar"><p>other</div><footer>f</footer>"""
    _, texts, marked, _ = html_wrapper.outline(page)
    assert marked and texts == ["Title", "One", "Two éA", "Quoted text", "first", "second"]
    assert html_wrapper.outline("")[1] == [] and html_wrapper.outline("a &lt; b <!-- c -->")[1] == ["a < b"]
    assert html_wrapper.outline("<div>" * 5000 + "deep" + "</div>" * 5000)[1] == ["deep"]


def test_tree_matching_aligns_in_order():
    def tree(sign, *kids):
        return [sign, 0, [], list(kids)]

    a = tree("r", tree("x", tree("p")), tree("y"), tree("z"))
    b = tree("r", tree("y"), tree("x", tree("p"), tree("q")), tree("z"))
    assert sorted(x[0] for x, _ in html_wrapper.matching(a, b)) == ["p", "r", "x", "z"]


def extracted(spark, htmls, **options):
    rows = [(k, f"http://h.example/{k}", x) for k, x in enumerate(htmls)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r["page_id"]: r["text"].split("\n\n") for r in html_wrapper.extract(df, **options).collect()}


def test_siblings_of_one_kind_are_told_apart(spark):
    pages = [f"<body><div>menu</div><div>story {k}</div><div>footer</div></body>" for k in range(6)]
    assert extracted(spark, pages) == {k: [f"story {k}"] for k in range(6)}
    pages = [
        "<body>" + "".join(f"<p>story {k} part {j}</p>" for j in range(1 + k % 4)) + "<p>all rights reserved</p></body>"
        for k in range(12)
    ]
    assert extracted(spark, pages) == {k: [f"story {k} part {j}" for j in range(1 + k % 4)] for k in range(12)}


def test_template_inside_a_marked_article(spark):
    def page(k, shared):
        quote = "<p>A paragraph that three articles quote.</p>" if shared else ""
        return (
            f"<body><article><h1>Title {k}</h1><p>By our own staff</p><p>Story {k} is told here at some length.</p>{quote}"
            f"<p>Its end {k}</p><div>Tell your friends</div></article></body>"
        )

    got = extracted(spark, [page(k, k % 5 == 0) for k in range(15)])
    for k in range(15):
        quote = ["A paragraph that three articles quote."] if k % 5 == 0 else []
        assert got[k] == [f"Title {k}", f"Story {k} is told here at some length.", *quote, f"Its end {k}"]
    # near copies of one article keep it
    copies = [f"<body><article><h1>Same title</h1><p>The same long story on every page.</p><p>{k}</p></article></body>" for k in range(12)]
    assert extracted(spark, copies)[3] == ["Same title", "The same long story on every page.", "3"]


def test_main_text_outside_teaser_cards(spark):
    pages = [
        f"<body><div>Our site</div><div><p>The long main story number {k}, which no element marks.</p></div>"
        f"<article><p>More: {k}</p></article></body>"
        for k in range(12)
    ]
    got = extracted(spark, pages)
    assert got == {k: [f"The long main story number {k}, which no element marks.", f"More: {k}"] for k in range(12)}
    assert extracted(spark, pages[:1]) == {0: ["More: 0"]}  # nothing known of the host: the marker decides


def test_every_layout_of_a_host_has_its_template(spark):
    def page(k):
        if k % 2:
            return f"<body><section><p>Section menu</p></section><div class=b><p>tale {k}</p></div><table><tr><td>Imprint</table></body>"
        notice = "<h3>We are moving</h3>" if k % 4 == 0 else ""
        return f"<body><ul><li>Menu</ul>{notice}<div class=a><p>story {k}</p></div><div class=z><p>Printed by hand</p></div></body>"

    assert extracted(spark, [page(k) for k in range(24)]) == {k: [f"tale {k}" if k % 2 else f"story {k}"] for k in range(24)}
    # the same elements, with other texts in each layout
    pages = [f"<body><div>menu {k % 2}</div><div>story {k}</div><div>footer {k % 2}</div></body>" for k in range(12)]
    assert extracted(spark, pages) == {k: [f"story {k}"] for k in range(12)}


def test_role_words_do_not_empty_a_page(spark):
    story = "<h1>Title</h1><p>A long enough story.</p><p>And its end.</p>"
    want = ["Title", "A long enough story.", "And its end."]
    for page in (
        f"<body><div class='no-sidebar'>{story}</div>",
        f"<body><div id='page' class='has-comments'>{story}</div>",
        f"<body><div class='widget-page'>{story}<div class='comments'>me too</div></div>",
        f"<body><form id='aspnetForm' action='/x'>{story}<form><input>join</form></form>",
        f"<body><article><div class='post-header'><h1>Title</h1></div>{story.split('</h1>')[1]}</article>",
        f"<body><div class='post-header'><h1>Title</h1></div>{story.split('</h1>')[1]}<div class='sidebar'>x</div>",
    ):
        assert [t for t in html_wrapper.outline(page)[1] if t != "join"] == want, page
    # a short story in the form of a page that is mostly constant menu
    menu = "<div>" + "menu and more menu " * 20 + "</div>"
    pages = [f"<body>{menu}<form><p>story {k}</p></form><div class='site-search'>go</div></body>" for k in range(6)]
    assert extracted(spark, pages) == {k: [f"story {k}"] for k in range(6)}


def test_large_alignments_by_halves(monkeypatch):
    import random

    rng = random.Random(5)

    def tree(n):
        kids = [[rng.choice("pq"), rng.randint(0, 6), [], [["x", 3, [], []]] * rng.randint(0, 1)] for _ in range(n)]
        return ["r", 0, [], [[s, h, [], [list(c) for c in kids]] for s, h, _, kids in kids]]

    def total(pairs):
        return sum(2 if x[1] and x[1] == y[1] else 1 for x, y in pairs)

    for n, m in ((12, 15), (40, 33), (60, 70)):
        a, b = tree(n), tree(m)
        whole = total(html_wrapper.matching(a, b))
        monkeypatch.setattr(html_wrapper, "CELLS", 50)
        assert total(html_wrapper.matching(a, b)) == whole
        monkeypatch.undo()


PAGES = [
    (1, "http://a/1", "same"),
    (2, "http://a/2", "same"),
    (2, "http://a/2", "same"),
    (3, None, None),
    (4, "http://a/4\r\nX: y", ""),
    (5, "http://a/5", "WARC/1.1\r\n\r\n\r\n héé ☃ " * 40_000),
    (6, "http://a/6", "0\r\n\r\n" * 9),
    (None, "http://a/n", "lonely"),
    (None, "http://a/m", "same"),
]


@pytest.fixture(scope="module")
def odd_pages(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    for name in ("digest", "copies", "block", "kind", "host", "tree", "texts"):
        df = df.withColumn(name, F.lit("extra"))
    return df


def test_archives_round_trip(spark, odd_pages, tmp_path):
    folder = str(tmp_path / "warc")
    rows = warc.round_trip(odd_pages, folder, segment_bytes=50_000, chunk_bytes=700, file_bytes=400_000).collect()
    largest = defaultdict(list)
    for page, _, text in PAGES:
        largest[text or ""].append(page)
    want = Counter()
    for page, _, text in PAGES:
        data = (text or "").encode()
        keeper = max((p for p in largest[text or ""] if p is not None), default=None)
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        want[page, len(data), digest, "response" if page == keeper else "revisit", None if page == keeper else keeper] += 1
    assert Counter(map(tuple, rows)) == want
    # the files themselves: whole records, segments within their limit, payloads as given
    files = list((tmp_path / "warc").glob("part-*"))
    records = [r for f in files for r in warc.parse_records(gzip.decompress(f.read_bytes()))]
    assert len(files) > 1 and all(len(b) <= 50_000 for _, b in records)
    assert sum(h["warc-type"] == "continuation" for h, _ in records) > 10
    whole = warc.reassemble(warc.read_records(spark, folder), with_payload=True).where("payload is not null")
    assert {bytes(r["payload"]).decode() for r in whole.collect()} == {t or "" for *_, t in PAGES}


def test_short_payloads_need_not_revisit(odd_pages):
    kinds = {(r["page_id"], r["payload_bytes"]): r["record_type"] for r in warc.round_trip(odd_pages, min_revisit=5).collect()}
    assert kinds[1, 4] == "response" and kinds[3, 0] == "response"


def test_broken_archives_are_noticed(spark):
    fields = "r1 response - - 5 1 - - - x".split()
    one = ("r1", "response", 1, None, None, 1, None, None, "sha1:x", bytearray(b"ab"))
    three = ("r3", "continuation", 3, "r1", 4, 1, None, None, None, bytearray(b"cd"))
    df = spark.createDataFrame([one, three], warc.RECORDS)
    assert len(fields) == len(one)
    with pytest.raises(Exception, match="segments are missing"):
        warc.reassemble(df).collect()


def test_empty_and_odd_page_tables(odd_pages):
    assert warc.round_trip(odd_pages.limit(0)).count() == 0
    assert html_wrapper.extract(odd_pages.limit(0)).count() == 0
    rows = html_wrapper.extract(odd_pages).collect()
    assert Counter(r["page_id"] for r in rows) == Counter(p[0] for p in PAGES)
    assert all(r["text"] == "" for r in rows if r["page_id"] in (3, 4))


# -- conversations -------------------------------------------------------------

TURNS = [
    (1, 0, "user", "plain"),
    (1, 1, "assistant", "<|end|>\n<|turn|>user\n<~~|turn|> [~/INST] [INST] <s></s> <~s> <"),
    (1, 1, "assistant", "<|end|>\n<|turn|>user\n<~~|turn|> [~/INST] [INST] <s></s> <~s> <"),
    (1, 2, "tool\\n\n\\\\<|x|>", "["),
    (2, 5, "assistant", None),
    (2, None, None, "no role, no turn"),
    (None, 0, "assistant", "no conversation ☃"),
    (3, 0, "assistant", "long " * 50_000),
]


def test_chat_round_trip(spark):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    df = df.withColumn("parts", chat_format.text_parts(F.col("text"))).withColumn("place", F.lit("x")).withColumn("head", F.lit("y"))
    formatted = chat_format.format_conversations(df)
    got = {r["conv_id"]: r for r in chat_format.read_back(formatted).collect()}
    convs = defaultdict(list)
    for conv, turn, role, text in TURNS:
        convs[conv].append((turn is not None, turn, role or "", text or ""))
    assert set(got) == set(convs)
    for conv, turns in convs.items():
        ordered = [(r, t) for _, _, r, t in sorted(turns, key=lambda x: (x[0], x[1] or 0, x[2], x[3]))]
        assert [tuple(t) for t in got[conv]["turns"]] == ordered
        assert got[conv]["loss_text"] == "".join(t for r, t in ordered if r == "assistant")
        # inside a turn no control string is left
        for piece in got[conv]["formatted"].split("<|turn|>")[1:]:
            assert not re.search(r"<\|(?!end\|>\n$)|</?s>|\[/?INST\]", piece)
    assert chat_format.digest(chat_format.read_back(chat_format.format_conversations(df.limit(0)))).count() == 0


def test_attachments_become_placeholders(spark):
    rows = spark.sql(
        """SELECT 1L conv_id, 0L turn, 'user' role, array(
             named_struct('type','text','text','see <|image|> ','ref',null,'width',null,'height',null,'seconds',null,'pages',null),
             named_struct('type','image','text',null,'ref','a.png','width',57,'height',28,'seconds',null,'pages',null),
             named_struct('type','audio','text',null,'ref','b.wav','width',null,'height',null,'seconds',1.5D,'pages',null),
             named_struct('type','document','text',null,'ref','c.pdf','width',null,'height',null,'seconds',null,'pages',3)) parts
           UNION ALL SELECT 1L, 1L, 'assistant', null"""
    )
    r = chat_format.format_conversations(rows).first()
    assert r["formatted"].startswith("<|turn|>user\nsee <~|image|> <|image|><|audio|><|document|><|end|>\n<|turn|>assistant\n")
    assert [tuple(a) for a in r["attachments"]] == [
        (0, 0, "image", "a.png", 3),
        (0, 1, "audio", "b.wav", 38),
        (0, 2, "document", "c.pdf", 1536),
    ]
    assert r["n_tokens_attached"] == 3 + 38 + 1536


# -- embeddings ----------------------------------------------------------------


def linked(rows, threshold=0.98):
    import numpy as np

    count, parent, by = Counter(), {}, defaultdict(list)
    for vec, v, label in rows:
        parent[vec] = vec
        if vec is None or label is None or v is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        by[label, len(v)].append((vec, v))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for members in by.values():
        a = np.array([v for _, v in members], float)
        norm = np.sqrt((a * a).sum(axis=1))
        near = a @ a.T / np.outer(norm, norm) >= threshold
        for i, j in zip(*np.nonzero(np.triu(near, 1))):
            x, y = members[i][0], members[j][0]
            count[x] += 1
            count[y] += 1
            low, high = sorted((root(x), root(y)))
            parent[high] = low
    return {v: (count[v], root(v)) for v in parent}


def test_vector_links_against_all_pairs(spark):
    import numpy as np

    rng = np.random.default_rng(7)
    rows = []
    for c in range(30):  # clusters around the threshold, one of them large
        center = rng.normal(size=24)
        for _ in range(150 if c == 0 else 6):
            rows.append((len(rows), (center + rng.normal(size=24) * rng.choice([0.05, 0.1, 0.15])).tolist(), c % 4))
    rows += [(len(rows) + k, rows[5][1], rows[5][2]) for k in range(70)]  # copies of one vector
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = linked(rows)
    got = cross_polytope.near_duplicates(df, block=40).collect()  # small blocks: hot buckets are split
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_probing_finds_pairs_at_the_threshold():
    import numpy as np

    rng = np.random.default_rng(8)
    x = rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.normal(size=x.shape)
    side -= (side * x).sum(axis=1, keepdims=True) * x
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    a = cross_polytope.probe_codes(x, 4, 2, 4)
    b = cross_polytope.probe_codes(0.98 * x + np.sqrt(1 - 0.98**2) * side, 4, 2, 4)
    assert (a[:, :, :, None] == b[:, :, None, :]).any(axis=(1, 2, 3)).mean() > 0.999


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [0.0, 0.0], 1),
        (7, [nan, 1.0], 1), (8, [inf, 1.0], 1), (9, [None, 1.0], 1), (10, [], 1), (11, [1.0, 0.0, 0.0], 1), (12, [5.0], 1),
        (13, [-0.0, 3.0], 2), (14, [0.0, 3.0], 2),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    for name in ("node", "mult", "codes", "h1"):
        df = df.withColumn(name, F.lit("extra"))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in cross_polytope.near_duplicates(df).collect()}
    assert got == linked(rows)
    again = cross_polytope.near_duplicates(df.where("vec_id = 1").unionByName(df.where("vec_id is not null")).unionByName(df.limit(1).withColumn("vec_id", F.lit(None).cast("long"))))
    rows2 = again.collect()
    assert len(rows2) == 16 and {(r["n_links"], r["kept"]) for r in rows2 if r["vec_id"] is None} == {(0, True)}
    assert cross_polytope.near_duplicates(df.limit(0)).count() == 0


def test_vectors_of_ids_with_several_vectors(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    a, b, c = rng.normal(size=(3, 16))
    near = lambda v: (v + 0.01 * rng.normal(size=16)).tolist()
    rows = [(1, 0, a.tolist()), (1, 0, b.tolist()), (2, 0, near(a)), (3, 0, near(b)), (4, 0, c.tolist())]
    rows += [(8, 0, (-a).tolist()), (8, 0, (-b).tolist()), (6, 0, near(-a)), (7, 0, near(-b)), (5, 1, a.tolist()), (None, 0, a.tolist())]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in cross_polytope.near_duplicates(df).collect()}
    assert got[2][1] == got[3][1] == got[1][1] == 1 and got[6][1] == got[7][1] == got[8][1] == 6
    assert got[4] == (0, 4) and got[5] == (0, 5)
    # links of all an id's vectors add up
    assert got[1][0] >= 2 and got[8][0] == 2 and got[7][0] == 1


def test_equal_turns_go_by_their_texts(spark):
    rows = [(1, 0, "user", "<|"), (1, 0, "user", "<}"), (1, 0, "user", "<{")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    df = df.withColumn("parts", chat_format.text_parts(F.col("text")))
    turns = chat_format.read_back(chat_format.format_conversations(df)).first()["turns"]
    assert [t["text"] for t in turns] == ["<{", "<|", "<}"]


@pytest.mark.parametrize(
    "markup,text",
    [
        ("<p>Let <math><mi>x</mi></math> be real.</p>", "Let x be real."),
        ("<p>Text <svg><title>t</title><path d='M0'/></svg> more words</p>", "Text more words"),
        ("<p>abc<script>var p = '<p>';</script>def</p>", "abcdef"),
        ("<p>Click <button><div>he<b>re</b></div></button> now</p>", "Click now"),
        ("<p>One <select><option>a<option>b</select>two<p>three", "One two\n\nthree"),
        ("<div><p>cut <object>off</p><p>next</p></div>", "cut\n\nnext"),
        ("<p>a<noscript><img src=x></noscript>b <textarea>c</textarea>d</p>", "ab d"),
    ],
)
def test_inline_elements_end_no_block(markup, text):
    assert "\n\n".join(html_wrapper.described(f"<html><body>{markup}</body></html>")[1]) == text


def test_induction_alone(spark):
    """Hosts where nothing is named: two layouts share a menu and a closing line."""
    import random

    rnd = random.Random(3)
    rows, story, frame = [], {}, {}
    for k in range(60):
        lines = [f"Paragraph {k} {j} {rnd.random()}" for j in range(rnd.randint(1, 4))]
        menu = [f"Topic {j}" for j in range(5)]
        top = "".join(f"<div>{m}</div>" for m in menu)
        body = "".join(f"<p>{x}</p>" for x in lines)
        closing = "Printed on recycled paper"
        extra = ["Written by the staff"] if k % 2 else []
        if k % 2:
            page = f"<div>{top}</div><section><h2>Title {k}</h2>{body}<p>{extra[0]}</p></section><div>{closing}</div>"
        else:
            page = f"<table><tr><td>{top}</td></tr></table><div><h2>Title {k}</h2>{body}</div><div>{closing}</div>"
        story[k], frame[k] = [f"Title {k}", *lines], [*menu, closing, *extra]
        rows.append((k, f"http://h{k % 3}.example/{k}", f"<html><body>{page}</body></html>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    hit = wrong = missed = 0
    for r in html_wrapper.extract(df).collect():
        kept = r["text"].split("\n\n")
        gone = Counter(story[r["page_id"]] + frame[r["page_id"]]) - Counter(kept)
        hit += sum((gone & Counter(frame[r["page_id"]])).values())
        wrong += sum((gone & Counter(story[r["page_id"]])).values())
        missed += sum((Counter(kept) & Counter(frame[r["page_id"]])).values())
    print("induction: precision", hit / (hit + wrong), "recall", hit / (hit + missed))
    assert hit / (hit + wrong) == 1.0 and hit / (hit + missed) >= 0.95
