"""Extraction over small pages with the values to be found, and the seed sites."""

from pyspark.sql import functions as F

from corpusweave import schemas
from corpusweave.operators import catalog as G
from corpusweave.operators import extract as E

URL = "https://site.example/dir/page.html"
PAGES = [
    (1, "<html><head><title> One  page </title></head><body><nav>menu</nav><main><p>Main text.</p></main><footer>foot</footer></body></html>"),
    (2, "<body><h1>Only a heading</h1><table><caption>Prices</caption><tr><th>Item</th><th>Price</th></tr><tr><td>Tea</td><td>2</td></tr><tr><td>Milk</td><td>1</td></tr></table></body>"),
    (3, "<table><thead><tr><th>A</th><th>B</th></tr></thead><tbody><tr><td>1</td><td>2</td></tr></tbody></table><table><tr><td>layout</td></tr></table>"),
    (4, "<a href='/a'>a</a><a href='b?x=1#top'>b</a><a href='/a'>again</a><a href='https://other.example/c'>c</a><a href='mailto:x@y.example'>m</a><a href='/files/Report.PDF'>The  report</a><a href='data.csv?v=2'>data</a>"),
    (5, "<body><script>var x = 1;</script><p>Plain</p><style>p {}</style><p>words</p></body>"),
    (6, ""),
]


def extracted(spark):
    return E.extract(spark.createDataFrame([(i, URL, h) for i, h in PAGES], "page_version_id bigint, url string, raw_html string"))


def test_title_and_text(spark):
    got = sorted((r.page_version_id, r.title, r.text) for r in extracted(spark).collect())
    assert got == [(1, "One page", "Main text."), (2, "Only a heading", "Only a headingPricesItemPriceTea2Milk1"), (3, None, "AB12layout"), (4, None, "abagaincmThe reportdata"), (5, None, "Plainwords"), (6, None, "")]


def test_tables(spark):
    found = extracted(spark).select("page_version_id", F.posexplode("structured.tables").alias("pos", "t")).collect()
    assert sorted((r.page_version_id, r.pos, r.t.caption, r.t.headers, r.t.rows) for r in found) == [(2, 0, "Prices", ["Item", "Price"], [["Tea", "2"], ["Milk", "1"]]), (3, 0, None, ["A", "B"], [["1", "2"]])]


def test_links(spark):
    pages = spark.createDataFrame([(i, URL, h) for i, h in PAGES], "page_id bigint, url string, html string")
    base = "https://site.example/"
    assert sorted((r.page_id, r.place, r.url) for r in E.links(pages).collect()) == [(4, 0, base + "a"), (4, 1, base + "dir/b?x=1"), (4, 2, base + "files/Report.PDF"), (4, 3, base + "dir/data.csv?v=2")]


def test_documents(spark):
    found = extracted(spark).select("page_version_id", F.inline("structured.documentLinks")).collect()
    assert sorted(map(tuple, found)) == [(4, "https://site.example/dir/data.csv?v=2", "data", "csv"), (4, "https://site.example/files/Report.PDF", "The report", "pdf")]


def test_seed_sites(spark):
    sites = schemas.seed_sites(spark)
    assert [(r.id, r.crawl_delay_ms, r.render_mode, r.max_depth, r.max_pages) for r in sites.orderBy("id").collect()] == [(1, 500, "static", 2, 50), (2, 500, "js", 2, 50), (3, 1000, "static", 2, 30)]
    one = G.site_by(sites, "scrapethis").collect()
    assert [(r.id, r.base_url) for r in one] == [(3, "https://www.scrapethissite.com/pages/")]


def test_batches_of_pages_are_small(spark):
    """A worker holds 512 pages at most, however many a partition has."""
    from corpusweave.functions.embed import embed_column
    from corpusweave.operators import extract as E

    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        pages = spark.range(1200).coalesce(1).selectExpr("id as page_version_id", "'u' as url", "'<p>x</p>' as raw_html")
        E.extract(pages)
        assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == 512
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        embed_column(pages, "url")
        sizes = pages.mapInArrow(lambda batches: (b.slice(0, 1) for b in batches), "page_version_id bigint, url string, raw_html string")
        assert sizes.count() == 3
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
