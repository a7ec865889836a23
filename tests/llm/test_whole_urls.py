"""Alias edges of every form, by the operator and by its SQL."""

import duckdb

from swathframe.llm import url_filter
from swathframe.llm.oracle import URLS
from swathframe.llm.queries import URL_RULES


def canon(u):
    return f'<link rel="canonical" href="{u}">'


ROWS = [
    (1, "http://a.net/p", "<meta http-equiv=refresh content=0;url=http://shop.com/de/1>"), (2, "http://b.net/x/y?page=1", canon("?page=2")), (3, "http://b.net/x/y?page=2", canon("http://shop.com/de/2")),
    (4, "http://c.net/x/y/z", canon("../../n/./m/..")), (5, "http://c.net/n/", canon("http://shop.com/de/3")),
    (10, "http://g.net/x/..", canon("http://shop.com/de/6")), (11, "http://h.net/x", canon("http://g.net/../../")),
    (12, "http://i.net/x", """<meta content='0; url="http://shop.com/de/7"' http-equiv='refresh'>"""),
    (13, "http://j.net:80/x?a=1&b=2", ""), (14, "https://j.net/x?a=1&b=2", canon("http://shop.com/de/9")),
    (15, "http://k.net/q", '<base href="http://l.net/u/v"><link rel=canonical href="w">'), (16, "http://l.net/u/w", canon("&#104;ttp://shop.com&#x2F;de/8&amp;x")),
]
MORE = [
    (20, "http://m.net/a", canon("mailto:x@shop.com")), (21, "http://n.net/a", canon("#part")), (22, "http://o.net:8080/a", canon("//o.net/a")), (23, "http://o.net/a", None), (None, "http://p.net/", canon("http://shop.com/de/")), (1, "http://free.net/", None),
    (24, None, canon("http://shop.com/de/")), (25, "no address", canon("http://shop.com/de/")), (26, "http://q.net/", canon("http://fr.com/fr/") + canon("http://shop.com/de/77")), (27, "http://both.org/x", canon("http://shop.com/de/78")), (28, "http://shop.com/de/78", ""), (29, "http://r.net/&#65;", canon("&unknown;&#xD800;&#0;")),
    (30, "http://s.net/x", "<link rel='stylesheet' href='http://shop.com/de/1'><link rel='canonical' href=''>"), (31, "http://sub.Example.ORG/en/12?x", ""),
]


def test_alias_edges_of_every_form(spark):
    pages = spark.createDataFrame(ROWS, "page_id bigint, url string, html string")
    out = {r.page_id: r.verdict for r in url_filter.judge(pages, URL_RULES).collect()}
    assert sorted(out) == sorted(r[0] for r in ROWS) and set(out.values()) == {"block"}


def test_sql_follows_the_same_aliases(spark):
    """Repeated rows, an id with two addresses, and columns that share names with the operator's own."""
    rows = [(*r, "x", "x", "x", "x") for r in ROWS + MORE + ROWS[:2] + MORE[4:5]]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, host string, best string, address string, rule string")
    out = [tuple(r) for r in url_filter.judge(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict").collect()]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", [r[:3] for r in rows])
    assert sorted(map(repr, out)) == sorted(map(repr, con.execute(URLS).fetchall()))
    kept = {(r[0], r[1]): r[4] for r in out}
    assert kept[1, "free.net"] == "allow" and kept[22, "o.net:8080"] == "allow" and kept[26, "q.net"] == "allow" and kept[28, "shop.com"] == "block" and kept[None, "p.net"] == "block"


UNREAD = [
    '<!-- <link rel="canonical" href="{}"> -->', "<script>var s='<link rel=\"canonical\" href=\"{}\">'</script>", '<link rel="alternate" data-x=" rel=canonical " href="{}">', '<style>/* <link rel=canonical href={}> */</style>',
    '<!-- a > <meta http-equiv=refresh content="0;url={}">', '<textarea><link rel=canonical href={}></textarea >', '<meta name="x" content="http-equiv=refresh url={}">', '<link rel="uncanonical" href="{}">', '<link title="rel=canonical" href="{}">', "<SCRIPT SRC=x>'<link rel=canonical href={}>'", '<link a="open rel=x rel=canonical href={}>',
]
READ = [
    '<link title="a>b" rel="canonical" href="{}">', "<script>1</script><link href='{}' rel='next CANONICAL'>", '<!-- x --><LINK REL = canonical HREF = {} >', '<script><!-- </script><link rel=canonical href={}>', '<title>a > b</title><meta content="3; URL=\'{}\'" HTTP-EQUIV=" Refresh ">',
    '<link data-a=\'"\' rel=canonical href="{}"/>', '<link rel=canonical\n\thref="\n {} ">',
]


def test_markup_that_is_no_link_and_links_in_odd_markup(spark):
    forms = [(k, f"https://a{k}.net/", form.format(f"https://b{k}.com/de/1")) for k, form in enumerate(UNREAD + READ)]
    pages = spark.createDataFrame(forms, "page_id bigint, url string, html string")
    out = {r.page_id: r.verdict for r in url_filter.judge(pages, URL_RULES).collect()}
    assert [out[k] for k in range(len(forms))] == ["allow"] * len(UNREAD) + ["block"] * len(READ)
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", forms)
    assert {r[0]: r[4] for r in con.execute(URLS).fetchall()} == out


def test_hostile_markup(spark):
    rows = [(1, "http://a.net/", "<link " + 'a="b" ' * 50_000 + "rel=canonical href=http://shop.com/de/1>"), (2, "http://b.net/", "<!--" * 100_000 + "canonical"), (3, "http://c.net/", "<script>" * 50_000 + "canonical"), (4, "http://d.net/", '<link "' * 50_000 + "canonical")]
    assert url_filter.judge(spark.createDataFrame(rows, "page_id bigint, url string, html string"), URL_RULES).where("verdict = 'allow'").count() == 4


def test_without_rules_nothing_is_blocked(spark):
    pages = spark.createDataFrame(ROWS, "page_id bigint, url string, html string")
    assert url_filter.judge(pages, []).where("verdict = 'block' OR rule IS NOT NULL").count() == 0


def test_no_stage_is_too_large_to_compile(spark):
    """Hosts and paths are computed once, however many rules there are."""
    rules = [("block", f"h{i}.example.com", f"/p{i}") for i in range(300)] + URL_RULES
    plan = url_filter.judge(spark.createDataFrame(ROWS, "page_id bigint, url string, html string"), rules)._jdf.queryExecution().executedPlan().toString()
    assert len(plan) < 60_000
