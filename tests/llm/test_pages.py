"""Extraction of articles from pages of several shapes, and the vote of a host."""

from fairstream.llm import html
from fairstream.llm import queries as registered

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="home">
<header><a href=/>Site</a></header><div id="cookie-notice">We use cookies</div><nav><ul><li><a href="/x">A</a></ul></nav>
<div class="content"><article><h1>My &amp; title</h1><p>First  para
 with <b>bold</b> and&nbsp;space &lt;tag&gt;<p>Second <a href="x>y">link</a> text.<ul><li>one<li>two <i>x</i></ul>
<div class="share">Tweet</div><pre>code  x</pre><script>if(a<b){"</p>"}</script><!-- hid <p>den -->
<table><tr><td>c1<td>c2</table>Tail text<br>goes on</article>
<section class="comments"><p>Reader says a lot of things here which are long long long long</p></section></div>
<aside>Side</aside><div class="ad-box">Buy</div><form><input><label>L</label></form><footer>&copy; f</footer></body></html>"""


def test_page():
    blocks = ["My & title", "First para with bold and space <tag>", "Second link text.", "one", "two x", "code x", "c1", "c2", "Tail text goes on"]
    assert html.main_text(PAGE, []) == "\n\n".join(blocks)
    assert html.best_path(html.parse(PAGE)) == ">html>body.home>div.content>article"


def test_broken_pages():
    assert html.main_text(None, []) == html.main_text("", []) == html.main_text("<script>x", []) == ""
    assert html.main_text("plain", []) == "plain"
    assert html.main_text("<p>a</b>c<p>d", []) == "ac\n\nd"
    assert html.main_text('<p title="x>one</p><p>two', []).endswith("two")
    assert html.main_text("a &lt b <!-- open", []) == "a < b"


def test_host_path_wins(spark):
    """A page on which a long box outscores the story still gives the story."""
    story = "<body><div class='s1'><p>{}</p></div><div class='box'><p>{}</p></div></body>"
    rows = [(i, "http://h.example/x", story.format("story words " * 30, "box")) for i in range(9)]
    rows.append((9, "http://h.example/x", story.format("short story", "box words " * 30)))
    found = html.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string"))
    assert {r.page_id: r.text for r in found.collect()}[9] == "short story"


def test_query_gives_the_articles(spark):
    import html as library
    import re

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    found = {r.page_id: r for r in registered.op9_html_text(spark, "/root/testdata/sf0.01").collect()}
    for page in pages:
        inner = re.search(r"<article>(.*)</article>", page.html, re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", inner).replace("<br>", " "))
        blocks = [b for b in (" ".join(library.unescape(p).split()) for p in parts) if b]
        assert found[page.page_id].text == "\n\n".join(blocks)
        assert found[page.page_id].n_chars == len(found[page.page_id].text)


def test_wrappers_named_for_the_layout():
    """A name or a form puts out what it names, not a wrapper of the article."""
    story = "<h1>Title</h1><p>First paragraph of the story.</p><p>Second one.</p>"
    ad, wanted = "<div class='ad'>Buy this</div>", "Title\n\nFirst paragraph of the story.\n\nSecond one."
    side = "<div class='sidebar'>Side text</div>"
    for open_tag, close_tag in (
        ("<div class='content-sidebar-wrap'>", "</div>"), ("<div class='has-sidebar'>", "</div>"), ("<div class='layout social-on'>", "</div>"),
        ("<section id='no-sidebar'>", "</section>"), ("<form id='aspnetForm'>", "</form>"), ("<form><div class='with-sidebar'>", "</div></form>"),
        ("<div class='has-header'>", "</div>"),
    ):
        for inner in (f"<main><article>{story}{ad}</article></main>{side}", f"<article>{story}</article>{side}", f"<div>{story}{ad}</div>{side}"):
            assert html.main_text(f"<body>{open_tag}{inner}{close_tag}</body>", []) == wanted


def test_named_boxes_stay_out():
    comments = "<p>A reader says very much more than the author did.</p>" * 3
    for box in (f"<div id='comments'>{comments}</div>", f"<div class='related'><article>{comments[:40]}</article></div>", f"<form>{comments}</form>"):
        text = html.main_text(f"<body><article><h1>T</h1><p>{'Story words. ' * 9}</p>{box}</article></body>", [])
        assert text == "T\n\n" + ("Story words. " * 9).strip()


def test_headline_and_lead_in_boxes_of_their_own(spark):
    """However long the body box is, its article is the whole; also by the host's vote."""
    shapes = (
        "<article><h1>T</h1><div class='entry-content'>{}</div></article>",
        "<article><header><h1>T</h1></header><div><div class='post-body'>{}</div></div></article>",
        "<main><div><h1>T</h1></div><div class='content'><div class='text'>{}</div></div></main>",
        "<div class='post'><h1>T</h1><div class='x'><div class='entry-content'>{}</div></div></div><ul><li><a href=/>Other pages</a></ul>",
        "<div class='page'><h1>T</h1><div class='wrap'><div class='content'>{}</div></div></div><div>Some other box</div>",
    )
    rows, wanted = [], {}
    for shape in shapes:
        for times in (1, 4, 40, 400):
            paragraphs = ["Words of the body."] * times
            page = "<body>" + shape.format("".join(f"<p>{p}</p>" for p in paragraphs)) + "</body>"
            lead = page.replace("<h1>T</h1>", "<h1>T</h1><div class='lead'><p>The lead.</p></div>")
            for html_text, start in ((page, ["T"]), (lead, ["T", "The lead."])):
                assert html.main_text(html_text, []) == "\n\n".join([*start, *paragraphs]), (shape, times)
                wanted[len(rows)] = "\n\n".join([*start, *paragraphs])
                rows.append((len(rows), f"http://h{shapes.index(shape)}.example/x", html_text))
    found = html.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string"))
    assert {r.page_id: r.text for r in found.collect()} == wanted


def test_names_inside_a_line_say_nothing():
    line = "<p>We took <span class='notice'>great care</span> of it and <em class='ad-hoc'>so on</em>.</p>"
    assert html.main_text(f"<body><article>{line}</article></body>", []) == "We took great care of it and so on."


def test_a_part_of_a_name_is_only_a_hint():
    """Boxes of the article whose names hold a telling word stay; lists of links under such names go."""
    story = "<h1>T</h1><p>First words of the story.</p>"
    kept = "<div class='related-work'><h2>Related work</h2><p>Others did it.</p></div><section id='social-history'><h2>Life</h2><p>Born early.</p></section>"
    links = "<div class='related-reading'><a href=/a>One more page</a> <a href=/b>And another</a></div>"
    gone = "<div class='related-posts'><p>Read on</p></div><div class='share-buttons'>Send</div><div class='ad-box'>Buy</div>"
    text = html.main_text(f"<body><article>{story}{kept}{links}{gone}<p>Last words.</p></article></body>", [])
    assert text == "\n\n".join(["T", "First words of the story.", "Related work", "Others did it.", "Life", "Born early.", "Last words."])


def test_comments_under_an_unknown_name():
    """Readers write far more than the author, in boxes of one shape."""
    said = "".join(f"<div class='r r{i}'><b>Reader {i}</b><p>{'I think so too, and more. ' * 6}</p></div>" for i in range(30))
    story = "<h1>Title</h1><p>The story is short.</p><p>It ends here.</p>"
    wanted = "Title\n\nThe story is short.\n\nIt ends here."
    for inner in (f"<article>{story}</article><div class='responses'>{said}</div>", f"<main><article>{story}</article></main><ol class='responses'>{said.replace('div', 'li')}</ol>"):
        assert html.main_text(f"<body>{inner}</body>", []) == wanted


def test_a_host_of_many_layouts(spark):
    """No path has a tenth of the votes; the one with most still counts."""
    page = "<body><div class='{}'><p>{}</p></div><div class='zz'><p>{}</p></div></body>"
    letters = [f"{a}{b}" for a in "abcdefg" for b in "hij"]
    rows = [(i, "http://h.example/x", page.format(x, "story words " * 30, "box")) for i, x in enumerate([*letters, "ah"])]
    rows.append((99, "http://h.example/x", page.format("ah", "short story", "box words " * 30)))
    found = html.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string"))
    assert {r.page_id: r.text for r in found.collect()}[99] == "short story"


def _random_page(rng, depth=0):
    """Nested lists ``[tag, class, children or text]``."""
    if depth == 3 or depth and rng.random() < 0.4:
        return ["p", "", "word " * rng.integers(1, 40)]
    return ["div", f"c{rng.choice(list('xyz'))}", [_random_page(rng, depth + 1) for _ in range(rng.integers(1, 4))]]


def _shown(node):
    tag, name, inner = node
    attribute = f" class='{name}'" if name else ""
    return f"<{tag}{attribute}>{inner if isinstance(inner, str) else ''.join(map(_shown, inner))}</{tag}>"


def _paragraphs(node, above, out):
    """``(containers from the outermost, text)`` of every paragraph, by walking the tree that was written."""
    tag, name, inner = node
    if isinstance(inner, str):
        out.append((above, " ".join(inner.split())))
        return
    path = (above[-1][0] if above else "") + f">{tag}" + (f".{name}" if name else "")
    for child in inner:
        _paragraphs(child, [*above, (path, id(node))], out)


def _plain_best(paragraphs):
    """The container with the best sum of text, less by 0.6 a level; the first seen of equal ones."""
    scores = {}
    for above, text in paragraphs:
        for far, container in enumerate(reversed(above)):
            scores[container] = scores.get(container, 0.0) + len(text) * 0.6**far
    return max(scores, key=scores.get)[0]


def test_votes_and_texts_against_a_plain_version(spark):
    """Scores, votes of a host and the texts of pages without marked articles or lists of like boxes."""
    from collections import Counter

    import numpy as np

    rng, pages, votes = np.random.default_rng(6), [], Counter()
    while len(pages) < 60:
        tree = ["body", "", [_random_page(rng) for _ in range(2)]]
        if html._like_boxes(html.parse(_shown(tree))):
            continue
        paragraphs = []
        _paragraphs(tree, [], paragraphs)
        best = _plain_best(paragraphs)
        pages.append((_shown(tree), paragraphs, best))
        votes[best] += 1
    order = sorted(votes, key=lambda p: (-votes[p], p))
    ranked = [p for p in order if votes[p] >= html.MIN_SHARE * len(pages) or p == order[0]]
    rows = [(i, "http://h.example/", page) for i, (page, _, _) in enumerate(pages)]
    found = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    for i, (_, paragraphs, best) in enumerate(pages):
        texts = []
        for path in [*ranked, best]:
            texts = texts or [t for above, t in paragraphs if path in [p for p, _ in above]]
        assert found[i] == "\n\n".join(texts)
