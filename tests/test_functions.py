"""Extraction, chunking, addresses, rules and validators on hand-made cases."""

import random

import pytest

from corpusweave import schemas as S
from corpusweave.functions import html as H
from corpusweave.functions.analyze import stem
from corpusweave.functions.chunk import PieceTokenizer, chunk_document, split_sentences
from corpusweave.functions.embed import HashingEmbedder
from corpusweave.functions.urls import resolve
from corpusweave.operators.crawl import cooldown_fold
from corpusweave.sources.fetch import Robots


@pytest.mark.parametrize(
    "base, href, want",
    [
        ("https://A.example/x/y?q=1#f", "../z?k=v#top", "https://a.example/z?k=v"),
        ("https://a.example/x/y", "z", "https://a.example/x/z"),
        ("https://a.example/x/y?q=1", "?p=2", "https://a.example/x/y?p=2"),
        ("https://a.example/x", "#top", "https://a.example/x"),
        ("https://a.example:443/", "/für", "https://a.example/f%C3%BCr"),
        ("http://a.example:8080/", "//b.example/p", "http://b.example/p"),
        ("https://a.example/", "HTTP://B.example:80/./a/../b", "http://b.example/b"),
        ("https://a.example/", "mailto:x@y.z", None),
        ("https://a.example/", "javascript:void(0)", None),
        ("https://a.example/a b", " c d ", "https://a.example/c%20d"),
        ("nowhere", "/x", None),
        ("https://a.example/x/", ".", "https://a.example/x/"),
    ],
)
def test_resolve(base, href, want):
    assert resolve(base, href) == want


def test_tables():
    kv = "<table><tr><th>A</th><td>1</td></tr><tr><th>B</th><td>2</td></tr></table>"
    assert H.tables(kv) == [{"caption": None, "headers": [], "rows": [["A", "1"], ["B", "2"]]}]
    full = "<table><caption> C </caption><thead><tr><th>h1<th>h2</tr></thead><tbody><tr><td>1<td> 2  3</tr></tbody><tfoot><tr><td>x<td>y</tr></tfoot></table>"
    assert H.tables(full) == [{"caption": "C", "headers": ["h1", "h2"], "rows": [["1", "2 3"]]}]
    assert H.tables("<table><tr><td>a</td><td>b</td></tr><tr><td>1</td><td>2</td></tr></table>")[0]["headers"] == ["a", "b"]
    assert H.tables("<table><tr><td>only</td></tr></table>") == []
    nested = "<table><tr><td>a</td><td>b</td></tr><tr><td><table><tr><td>x</td><td>y</td></tr><tr><td>1</td><td>2</td></tr></table></td><td>z</td></tr></table>"
    outer, inner = H.tables(nested)
    assert inner == {"caption": None, "headers": ["x", "y"], "rows": [["1", "2"]]} and ["x", "y"] in outer["rows"]


def test_links_and_documents():
    html = '<a href="/a/Report.PDF#p2">First</a><a href="/a/Report.PDF">Second</a><a href="/b">B</a><a href="/b#x">again</a><a href="https://other.example/c">C</a>'
    assert H.document_links(html, "https://h.example/") == [{"url": "https://h.example/a/Report.PDF", "text": "First", "type": "pdf"}]
    assert H.same_host_links(html, "https://h.example/") == ["https://h.example/a/Report.PDF", "https://h.example/b"]
    assert H.document_links(html, "") == []


def test_text_of_pages():
    two = "<title> T  1 </title><body><nav>menu</nav><main><p>One</p></main><div>skip</div><main>Two<script>x</script></main></body>"
    assert H.extract(two) == ("T 1", "OneTwo", False)
    assert H.extract("<body><header><h1>Head</h1></header><p>Text</p></body>") == ("Head", "Text", False)
    long = "<body><nav>menu</nav><article>" + "<p>" + "A long paragraph, with commas, and words. " * 10 + "</p></article><div class='ad'>buy</div></body>"
    title, text, used = H.extract(long)
    assert used and title is None and "buy" not in text and "menu" not in text
    assert H.extract(None) == (None, "", False)


def test_sentences_keep_known_quirks_and_the_strict_form_mends_them():
    assert split_sentences("It costs £51.77 now.") == ["It costs £51.", "77 now."]
    assert split_sentences("...Hello world.") == ["Hello world."]
    assert split_sentences("It costs £51.77 now. Yes!", compat=False) == ["It costs £51.77 now.", "Yes!"]
    assert split_sentences("...", compat=True) == ["..."]


def test_chunks_cover_all_sentences_in_order_with_overlap():
    random.seed(5)
    text = " ".join(" ".join(random.choice(["alpha", "beta", "gamma"]) for _ in range(random.randint(3, 60))) + "." for _ in range(120))
    units = split_sentences(text)
    chunks = chunk_document(text, "H")
    tok = PieceTokenizer()
    assert all(c.token_count == len(tok.encode(c.text)) and c.heading_path == "H" for c in chunks) and len(chunks) > 3
    at = 0
    for c in chunks:
        own = split_sentences(c.text)
        start = units.index(own[0], max(0, at - 30))
        assert units[start : start + len(own)] == own and start <= at
        at = start + len(own)
    assert at == len(units)
    monster = " ".join(["word"] * 1700) + "."
    assert [c.token_count for c in chunk_document(monster, None)][0] == 800
    long = " ".join(["w"] * 650) + ". Next one."
    a, b = chunk_document(long, None)
    assert b.text.startswith(a.text)
    assert chunk_document("  ", None) == [] and chunk_document(None, None) == []


def test_stems():
    pairs = "caresses caress|ponies poni|ties tie|cats cat|feed feed|agreed agre|hopping hop|hoping hope|happy happi|relational relat|conditional condit|rational ration|generalization general|oscillators oscil|skies sky|dying die|news news|national nation|knightly knight|consistency consist"
    assert {a: stem(a) for a, _ in map(str.split, pairs.split("|"))} == dict(map(str.split, pairs.split("|")))


def test_cooldown_window_is_anchored_at_the_first_block():
    assert cooldown_fold([0, 30_000, 59_000, 60_000], [True] * 4)[0] == [False, False, False, True]
    assert cooldown_fold([0, 30_000, 61_000, 62_000], [True] * 4)[0] == [False] * 4


def test_robots():
    r = Robots("User-agent: *\nDisallow: /a\nAllow: /a/b$\nCrawl-delay: 2\n\nUser-agent: corpusweave\nDisallow: /x*y")
    assert r.allowed("https://h/a/c", "corpusweave/1") and not r.allowed("https://h/x1y", "corpusweave")
    assert not r.allowed("https://h/a/c", "other") and r.allowed("https://h/a/b", "other") and r.delay("other") == 2.0
    assert Robots(None).allowed("https://h/") and Robots("").delay() is None


def test_request_bounds():
    for bad in (0, -1, "abc", 1.5, None, True):
        with pytest.raises(ValueError):
            S.positive_id(bad)
    assert S.page() == (20, 0) and S.page("100", "3") == (100, 3)
    for bad in (101, 0):
        with pytest.raises(ValueError):
            S.page(bad)
    assert S.search_request(" q ") == ("q", "hybrid", 5)
    for args in ((" ",), ("q", "fuzzy"), ("q", None, 51)):
        with pytest.raises(ValueError):
            S.search_request(*args)
    assert S.ask_request("why so", 3, ["a", "b"]) == ("why so", 4, ["a", "b"])
    for args in (("hi",), ("why", 50), ("why", 5, []), ("why", 5, ["x"] * 6)):
        with pytest.raises(ValueError):
            S.ask_request(*args)
    for args in ((11, None), (None, 0)):
        with pytest.raises(ValueError):
            S.crawl_request(*args)
    with pytest.raises(ValueError):
        S.choice("done", "status", S.PAGE_STATUS)


def test_hashing_embedder_is_deterministic_and_unit():
    a, b = HashingEmbedder(64).embed(["some words here", "some words here"])
    assert a == b and abs(sum(x * x for x in a) - 1) < 1e-5 and HashingEmbedder(8).embed([""]) == [[0.0] * 8]


def test_chunks_by_a_public_vocabulary():
    public = pytest.importorskip("public_tokenizers")
    import tiktoken

    from corpusweave.functions import chunk as K

    pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    own = K.RankTokenizer(public.path("byte_bpe_50k.tiktoken"), pattern)
    text = " ".join(f"Sentence number {i} tells of gardens, grüne Blätter and {i * 37} other things." for i in range(300))
    assert own.decode(own.encode(text)) == text and isinstance(own.model, tiktoken.Encoding)
    made = K.chunk_document(text, "Title", own)
    assert len(made) > 5 and all(c.token_count == len(own.encode(c.text)) <= K.MOST for c in made)
    assert [c.token_count for c in made] != [c.token_count for c in K.chunk_document(text, "Title", K.PieceTokenizer())][: len(made)]
    words = " ".join(c.text for c in made)
    assert all(f"number {i} tells" in words for i in range(300))


@pytest.mark.parametrize("piece", ["<table><tr><td>", "<table><tr><td>x<td>y", "<blockquote>a long text, with commas, ", "<a href='x.pdf'>t ", "<main>w ", "<div><p>", "<ul><li>"])
def test_nested_elements_take_linear_time(piece):
    import time

    html = piece * 1000
    began = time.perf_counter()
    page = H.parse(html)
    H.extract(html, page), H.tables(html, page), H.document_links(html, "https://h.example/", page)
    assert time.perf_counter() - began < 1


def test_deeply_nested_tables_keep_every_cell_once(monkeypatch):
    html = "".join(f"<table><tr><td>a{i}</td><td>b{i}" for i in range(60)) + "</td></tr></table>" * 60
    whole = H.tables(html)
    assert len(whole) == 60 and len(whole[0]["headers"]) == 120
    monkeypatch.setattr(H, "MOST_CELLS", 1000)
    own = H.tables(html)
    assert [t["headers"] for t in own] == [[f"a{i}", f"b{i}"] for i in range(60)] and all(t["rows"] == [] for t in own)
    small = "<table><tr><td>x</td><td>y</td></tr></table>"
    assert H.tables(small)[0]["headers"] == ["x", "y"]


def test_reader_takes_siblings_of_like_kind():
    prose = "A long paragraph, with commas, and words that go on. " * 6
    page = f"<body><div><section><p>{prose}one</p></section><section><p>{prose}two</p></section><p>Short end.</p><p><a href='/x'>link</a></p><ul><li>item</li></ul></div></body>"
    title, text, used = H.extract(page)
    assert used and "one" in text and "two" in text and "Short end." in text and "link" not in text and "item" not in text
    assert H.extract(f"<p>{prose}</p><p>{prose}</p>")[1].count("A long") == 12
    assert "menu" not in H.extract(f"<div class='menu'><p>{prose}menu</p></div><article><p>{prose}</p><p>{prose}</p></article>")[1]


def test_page_index_answers_as_a_walk_would():
    """Lengths, commas and links by running sums, against the text itself."""
    r = random.Random(2)
    tags = "p div a nav td table tr section blockquote script".split()
    for _ in range(300):
        html = "".join(r.choice([f"<{r.choice(tags)}>", f"</{r.choice(tags)}>", "word, ", " ", "a\n\tb ", "x"]) for _ in range(r.randrange(40)))
        page = H.parse(html)
        for i in range(len(page.tags)):
            assert page.length(i) == len(H.collapse(page.clean_of(i)))
            assert page.commas(i) == page.clean_of(i).count(",")
            assert page.linked(i) == sum(len(page.text_of(a)) for a in page.below(i, page.of("a")))
            assert all(page.parents[k] >= i for k in range(i + 1, page.ends[i]))


def test_a_word_is_stemmed_once():
    from corpusweave.functions import analyze

    analyze.stem.cache_clear()
    assert analyze.english_tokens("Running dogs, running dogs: running", frozenset()) == ["run", "dog", "run", "dog", "run"]
    assert (analyze.stem.cache_info().misses, analyze.stem.cache_info().hits) == (2, 3)
