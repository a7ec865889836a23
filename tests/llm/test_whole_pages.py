"""Pages whose head stays open, whose text stands outside blocks, or that hold formulas."""

from swathframe.llm import html_extract

PROSE = "This is a sentence with several words, and another clause. " * 5
BODY = f"<article><h1>Title</h1><p>{PROSE}</p><p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p></article>"
WANT = " ".join(f"Title {PROSE} so x=2 holds".split())


def test_open_heads_loose_text_and_formulas(spark):
    full = "<html><head><title>T</title></head><body>" + BODY + "<footer>foot</footer></body></html>"
    rows = [(i, full) for i in range(12)] + [
        (20, "<html><head><title>T</title><meta charset=utf-8><style>p {}</style><body>" + BODY), (21, "<head><title>T</title><link rel=x>\n" + BODY),
        (30, "no markup"), (31, "<b>bold</b>er <i>text</i>"), (32, "<head><title>T</title>plain text after"),
    ]
    df = spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id bigint, url string, html string")
    out = {r.page_id: r.text for r in html_extract.main_text(df).collect()}
    assert [out[i] for i in (0, 20, 21)] == [WANT] * 3
    assert [out[i] for i in (30, 31, 32)] == ["no markup", "bolder text", "plain text after"]


def test_silent_text_stays_out():
    for page in ("<head><script>a</script><title>b</title></head>c", "<div><svg><text>a</text></svg><button>b</button>c</div>", "<head><noscript>a</noscript><svg><text>b</text></svg>c"):
        nodes = html_extract.parse(page)
        assert html_extract.joined(nodes, [True] * len(nodes)) == "c"
