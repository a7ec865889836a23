"""URL decisions that hold for every alias of a page: DataFrame and SQL functions only.

Rules allow or block a host with its subdomains and a beginning of the path; the longest
fitting rule wins, allow before block at equal length. Redirects (meta refresh) and
canonical links are edges between URLs; their connected components are equivalence classes
of aliases. A page without a rule is blocked if an alias of it is blocked by a rule, unless
an alias is allowed by one: an explicit allow takes precedence over what is propagated.
Without any of these it is allowed.

Aliases are the same address without scheme, default port and fragment. Edges come from the
pages' html, and from a table of redirects where one is given; references are resolved
against the page's base as RFC 3986 says.

Rules are a table, keyed by host. A host is looked up by its last labels, once for each
number of labels that rules have, so there are as many joins as kinds of rules and none
needs a group of rows.

Edge cases: a null url and one without ``://`` have an empty host and path, fit no rule and
are nobody's alias; null html has no edges; repeated rows are judged alike; an empty table
gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..plans.storage import saved

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Comments, and elements whose content is text; one that is not closed goes to the end.
UNREAD = r"(?is)<!--.*?(?:-->|\z)|<(script|style|textarea|title|xmp|iframe|noembed|noframes)\b[^>]*>.*?(?:</\1[ \t\n\f\r]*>|\z)"
#: Elements that name another address, up to the > outside of quotes; their parts are bounded, as each takes stack.
TAGS = r"(?i)<(?:link|meta|base)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"']){0,400}+>"
#: An attribute: name, and the value in double quotes, in single quotes or without.
ATTRIBUTE = r"([^ \t\n\f\r\"'<>/=]+)[ \t\n\f\r]*(?:=[ \t\n\f\r]*(?:\"([^\"]*)\"|'([^']*)'|([^ \t\n\f\r\"'>]*)))?"
BLANKS, ENDS = r"[ \t\n\f\r]+", r"^[ \t\n\f\r]+|[ \t\n\f\r]+$"
TARGET = r"(?i)\burl[ \t\n\f\r]*=[ \t\n\f\r]*[\"']?([^\"' \t\n\f\r]+)"
#: Named character references that may stand in a link.
NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
#: Up to so many rules the table is sent to every task instead of shuffling the pages.
SENT = 100_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def rest_of(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(rest_of(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(rest_of(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def slashed(path: Column) -> Column:
    return F.coalesce(F.nullif(path, F.lit("")), F.lit("/"))


def without_dots(path: Column) -> Column:
    """The path without its segments . and .. (RFC 3986, 5.2.4)."""
    parts = F.slice(F.split(path, "/"), 2, 1 << 20)
    up = lambda kept: F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda a, x: F.when(x == "..", up(a)).when(x == ".", a).otherwise(F.concat(a, F.array(x))))
    end = F.when(F.element_at(parts, -1).isin(".", ".."), "/").otherwise("")
    whole = let(kept, lambda k: F.concat(F.lit("/"), F.array_join(k, "/"), F.when(F.size(k) > 0, end).otherwise("")))
    return F.when(path.contains("/."), whole).otherwise(path)


def address_of(url: Column) -> Column:
    """The key under which a URL is an alias: host without its scheme's default port, path and query; null for no URL."""

    def keyed(u: Column) -> Column:
        usual = F.when(u.rlike("^(?i)http:"), ":80").when(u.rlike("^(?i)https:"), ":443")
        host = let(host_of(u), lambda h: F.when(h.endswith(usual), F.regexp_replace(h, r":[0-9]+$", "")).otherwise(h))
        query = F.regexp_extract(rest_of(u), r"^[^?#]*(\??[^#]*)", 1)
        return let(host, lambda h: F.when(h != "", F.concat(h, let(slashed(path_of(u)), without_dots), query)))

    return let(url, keyed)


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(rule_host, labels, rules): all rules of a host; rules: (allow or block, host, path beginning)."""
    rows = [(h, h.count(".") + 1, len(h + p), v == "allow", h + p, p) for v, h, p in rules]
    made = spark.createDataFrame(rows, "rule_host string, labels int, length int, allow boolean, rule string, path string")
    return made.groupBy("rule_host", "labels").agg(F.collect_list(F.struct("length", "allow", "rule", "path")).alias("rules"))


def with_best_rule(rows: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``rows`` (host, path, ...) with ``best``: struct(length, allow, rule) of the longest fitting rule, else null."""
    spark = rows.sparkSession
    table = rule_table(spark, rules) if rules else None
    kept, found = rows.columns, []
    for k in sorted({h.count(".") + 1 for _, h, _ in rules}):
        own = table.where(F.col("labels") == k).select(F.col("rule_host").alias(f"__h{k}"), F.col("rules").alias(f"__r{k}"))
        own = F.broadcast(own) if len(rules) <= SENT else own
        rows = rows.withColumn(f"__h{k}", F.substring_index("host", ".", -k)).join(own, f"__h{k}", "left")
        found.append(f"__r{k}")
    fitting = F.filter(F.flatten(F.array_compact(F.array(*found))), lambda r: F.col("path").startswith(r["path"])) if found else None
    best = F.array_max(F.transform(fitting, lambda r: F.struct(r["length"].alias("length"), r["allow"].alias("allow"), r["rule"].alias("rule")))) if found else F.lit(None).cast("struct<length:int,allow:boolean,rule:string>")
    return rows.select(*[F.col(f"`{c}`") for c in kept], best.alias("best"))


def unescaped(text: Column) -> Column:
    """Character references decoded: numbers, and the names that a link may hold."""
    reference = r"^(?:#([0-9]{1,7})|#[xX]([0-9a-fA-F]{1,6})|(amp|lt|gt|quot|apos));?"

    def decoded(part: Column) -> Column:
        number = F.coalesce(F.nullif(F.regexp_extract(part, reference, 1), F.lit("")).cast("int"), F.conv(F.nullif(F.regexp_extract(part, reference, 2), F.lit("")), 16, 10).cast("int"))
        coded = let(number, lambda n: F.when((n > 0) & (n < 0x110000) & ~n.between(0xD800, 0xDFFF), F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")))
        named = let(F.regexp_extract(part, reference, 3), lambda n: F.coalesce(*[F.when(n == name, F.lit(c)) for name, c in NAMED.items()]))
        return let(F.coalesce(named, coded), lambda c: F.when(c.isNull(), F.concat(F.lit("&"), part)).otherwise(F.concat(c, F.regexp_replace(part, reference, ""))))

    return let(F.split(text, "&"), lambda parts: F.array_join(F.concat(F.slice(parts, 1, 1), F.transform(F.slice(parts, F.lit(2), F.size(parts)), decoded)), ""))


def target_of(href: Column, url: Column) -> Column:
    """The absolute form of a reference found under the base ``url`` (RFC 3986, 5.2.2; dot segments go with the address)."""

    def found(h: Column, u: Column) -> Column:
        scheme = F.regexp_extract(u, r"^([^:/?#]+)://", 1)
        site = F.concat(scheme, F.lit("://"), host_of(u))
        path = slashed(path_of(u))
        return (
            F.when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), h)
            .when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))  # another kind of address
            .when(h.startswith("//"), F.concat(scheme, F.lit(":"), h))
            .when(h.startswith("/"), F.concat(site, h))
            .when(h.startswith("#"), u)
            .when(h.startswith("?"), F.concat(site, path, h))
            .otherwise(F.concat(site, F.regexp_replace(path, r"[^/]*$", ""), h))
        )

    return let(href, lambda h: let(url, lambda u: found(h, u)))


def attributes(tag: Column) -> Column:
    """struct(names, values) of a tag's attributes, names in lower case; the first is the element's name."""
    of = lambda k: F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(k))
    both = lambda x, y: F.concat(x, y)
    values = F.zip_with(F.zip_with(of(2), of(3), both), of(4), both)
    return F.struct(F.transform(of(1), lambda n: F.lower(n)).alias("names"), F.transform(values, lambda v: F.regexp_replace(v, ENDS, "")).alias("values"))


def value_of(tag: Column, name: str) -> Column:
    """The first value of an attribute, empty without one."""
    return let(F.array_position(tag["names"], name), lambda i: F.when(i > 0, F.get(tag["values"], (i - 1).cast("int"))).otherwise(""))


def alias_edges(pages: DataFrame) -> DataFrame:
    """(a, b): addresses of pages and of what they redirect to or name as canonical. Links are saved before they are resolved."""
    found = pages.where("html IS NOT NULL AND url LIKE '%://%'").where(F.col("html").rlike(r"(?i)canonical|http-equiv"))
    tags = F.regexp_extract_all(F.regexp_replace("html", UNREAD, " "), F.lit(TAGS), F.lit(0))
    found = found.select("url", F.transform(tags, attributes).alias("tags"))
    own = lambda name, test, read: F.transform(F.filter("tags", lambda t: (t["names"][0] == name) & test(t)), read)
    href = lambda t: value_of(t, "href")
    canonical = own("link", lambda t: F.array_contains(F.split(F.lower(value_of(t, "rel")), BLANKS), "canonical"), href)
    refresh = own("meta", lambda t: F.lower(value_of(t, "http-equiv")) == "refresh", lambda t: F.regexp_extract(value_of(t, "content"), TARGET, 1))
    base = F.get(F.filter(own("base", lambda t: F.lit(True), href), lambda h: h != ""), F.lit(0))
    found = found.select("url", base.alias("base"), F.explode(F.array_distinct(F.concat(canonical, refresh))).alias("href"))
    links = saved(found.where("href <> ''"), "url-links")
    base = F.coalesce(target_of(unescaped(F.col("base")), F.col("url")), F.col("url"))
    ways = links.select(address_of(F.col("url")).alias("a"), address_of(target_of(unescaped(F.col("href")), base)).alias("b"))
    return saved(ways, "url-edges").where("a IS NOT NULL AND b IS NOT NULL AND a <> b")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of ``pages`` (page_id, url, html).

    redirects: optional (from_url, to_url). Only addresses with an edge take part in the
    components; a page meets its class by a left join on its address.
    """
    edges = alias_edges(pages)
    if redirects is not None:
        edges = edges.union(redirects.select(address_of(F.col("from_url")), address_of(F.col("to_url"))))
    nodes = connected_components(edges)
    at = F.concat(F.lit("x://"), F.col("node"))
    ruled = with_best_rule(nodes.select("node", "component", host_of(at).alias("host"), path_of(at).alias("path")), rules)
    classes = ruled.groupBy("component").agg(F.max(F.col("best.allow")).alias("allowed"), F.max(~F.col("best.allow")).alias("blocked"))
    known = saved(ruled.join(saved(classes, "url-classes"), "component").select(F.col("node").alias("address"), (F.coalesce("blocked", F.lit(False)) & ~F.coalesce("allowed", F.lit(False))).alias("by_alias")), "url-aliases")
    own = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.coalesce(address_of(F.col("url")), F.concat(F.lit("://"), F.xxhash64("page_id", "url", "html").cast("string"))).alias("address"))  # pages without an address are dealt out
    joined = with_best_rule(own, rules).join(known, "address", "left")
    blocked = F.when(F.col("best").isNotNull(), ~F.col("best.allow")).otherwise(F.coalesce("by_alias", F.lit(False)))
    return joined.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.when(blocked, "block").otherwise("allow").alias("verdict"))
