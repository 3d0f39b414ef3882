"""URL rules, spread over redirects and canonical links.

A rule fits its host and all subdomains if the url's path starts with the rule's; the longest rule wins. Pages that
name a canonical link or a refresh redirect are linked to the target's url; components of these links are found by
distributed label passing. Links are read from a page's tags in one pass; what stands in comments, scripts or other raw
elements is none. Targets are resolved against the page's url or its <base> (RFC 3986), and character references in them
are decoded. Urls are the same node whatever the case of scheme and host, default port, empty path, dot segments,
percent codes of unreserved characters, case of other codes, and fragment. Links whose target isn't absolute even then
(mailto:) are no links. A url without a rule of its own takes its component's: allow if a member is allowed by a rule,
else block if a member is blocked by one, else allow.

Null urls and urls without :// have an empty host and path, fit no rule, have no links and are allowed. Null html has
no links. Pages may be of any length. Repeated rows are each judged. Extra columns are ignored.
"""

from __future__ import annotations

import re
import string
from html import unescape
from html.entities import html5
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, joined, map_arrow, table
from .markup import START, attributes, tokens
from .simhash import components

#: (verdict, host, path)
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Rules up to which they become one expression; more are joined by host suffix.
INLINE = 256
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOW, _BREAKS, _BLANK = str.maketrans(_UPPER, _LOWER), str.maketrans("", "", "\t\n\r"), "".join(map(chr, range(33)))
_UNRESERVED, _PORTS = frozenset(string.ascii_letters + string.digits + "-._~"), {"http:": "80", "https:": "443", "ftp:": "21"}
_URL = re.compile(r"([A-Za-z][A-Za-z0-9+.\-]*+:)?(//[^/?#]*+)?([^?#]*+)(\?[^#]*+)?")
_CODE = re.compile("%([0-9A-Fa-f]{2})")
_REFERENCE = re.compile("&(?:#[0-9]++;?|#[xX][0-9a-fA-F]++;?|[A-Za-z][A-Za-z0-9]*+(?:;|(?!=)))")
_REFRESH = re.compile(r"\s*+(?:\d[\d.]*+|\.[\d.]*+)(?:\s*+[;,]|\s)\s*+(.*)", re.S)
_NAMED = re.compile(r"url\s*+=\s*+", re.I)


def _low(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def host(url: Column) -> Column:
    return _low(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def ruled(urls: DataFrame, rules: list[tuple[str, str, str]], url: str = "url") -> DataFrame:
    """Adds host, path, rule and rule_verdict (null where none fits)."""
    df = urls.withColumns({"host": host(F.col(url)), "path": path(F.col(url))})
    longest = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2], r[0]))
    if len(rules) <= INLINE:
        fits = lambda r: ((F.col("host") == r[1]) | F.col("host").endswith("." + r[1])) & F.col("path").startswith(r[2])
        of = lambda f: F.coalesce(*(F.when(fits(r), F.lit(f(r))) for r in longest), F.lit(None).cast("string"))
        return df.withColumns({"rule": of(lambda r: r[1] + r[2]), "rule_verdict": of(lambda r: r[0])})
    known = df.sparkSession.createDataFrame(rules, "v string, h string, p string")
    parts = F.split("host", r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    df = df.withColumn("_row", F.monotonically_increasing_id())
    got = df.select("_row", "path", F.explode(tails).alias("h")).join(known, "h").filter(F.expr("startswith(path, p)"))
    best = got.groupBy("_row").agg(F.max_by(F.struct(F.concat("h", "p").alias("rule"), F.col("v").alias("rule_verdict")), F.struct(F.length(F.concat("h", "p")), F.concat("h", "p"))).alias("b"))
    return df.join(best, "_row", "left").select("*", "b.rule", "b.rule_verdict").drop("_row", "b")


def _attribute(text: str) -> str:
    """An attribute's text with its character references decoded; a name without ; is none before = or a letter or digit."""
    return _REFERENCE.sub(lambda m: unescape(m[0]) if m[0][1] == "#" else html5.get(m[0][1:], m[0]), text) if "&" in text else text


def _plain(text: str) -> str:
    """Percent codes of unreserved characters as the characters, others in upper case (RFC 3986, 6.2.2)."""
    return _CODE.sub(lambda m: c if (c := chr(int(m[1], 16))) in _UNRESERVED else m[0].upper(), text) if "%" in text else text


def _without_dots(path: str) -> str:
    """A path from / on without its . and .. segments."""
    if not path.startswith("/") or "/." not in path:
        return path
    names, out = path[1:].split("/"), []
    for x in names:
        if x == "..":
            del out[-1:]
        elif x != ".":
            out.append(x)
    return "/" + "/".join(out + ([""] if names[-1] in (".", "..") else []))


class Url(NamedTuple):
    """scheme with its colon, authority with its slashes, path, and query with its mark; a fragment is dropped."""

    scheme: str
    authority: str
    path: str
    query: str

    @staticmethod
    def of(text: str) -> Url:
        m = _URL.match(text.translate(_BREAKS).strip(_BLANK))
        authority = m[2] or ""
        user, at, host = authority.rpartition("@")
        return Url((m[1] or "").lower(), f"{user}{at}{host.translate(_LOW)}", _plain(m[3]), _plain(m[4] or ""))

    def joined(self, ref: Url) -> Url:
        """ref relative to this absolute url (RFC 3986, 5.2.2), without a default port; an empty path of a host is /."""
        scheme, own = ref.scheme or self.scheme, bool(ref.scheme or ref.authority)
        authority = ref.authority if own else self.authority
        name, colon, port = authority.rpartition(":")
        if colon and port in ("", _PORTS.get(scheme)):
            authority = name
        if own or ref.path.startswith("/"):
            path = ref.path
        elif not ref.path:
            path = self.path
        else:
            path = (self.path[: self.path.rindex("/") + 1] if "/" in self.path else "/") + ref.path
        return Url(scheme, authority, _without_dots(path) or ("/" if authority else ""), ref.query if own or ref.path or ref.query else self.query)

    def __str__(self) -> str:
        return "".join(self)


def node(url: str) -> str:
    """The url that stands for all its spellings."""
    u = Url.of(url)
    return str(u.joined(u))


def _refreshed(content: str) -> str:
    """The target of a refresh after its seconds, with or without url= and quotes; empty if it has none."""
    m = _REFRESH.match(content)
    if m is None:
        return ""
    to = m[1]
    if name := _NAMED.match(to):
        to = to[name.end() :]
    return to[1:].split(to[0], 1)[0] if to[:1] in ("'", '"') else to


def targets(url: str, html: str) -> list[str]:
    """Nodes of the canonical links and refreshes of a page, other than its own; links in comments and raw elements are none."""
    refs, base = [], ""
    for kind, name, rest in tokens(html):
        if kind != START or name not in ("link", "meta", "base"):
            continue
        a = attributes(rest)
        if name == "base":
            base = base or _attribute(a.get("href", "")).strip(_BLANK)
        elif name == "link" and "canonical" in _attribute(a.get("rel", "")).lower().split():
            refs.append(_attribute(a.get("href", "")))
        elif name == "meta" and a.get("http-equiv", "").strip(_BLANK).lower() == "refresh":
            refs.append(_refreshed(_attribute(a.get("content", ""))))
    if not (refs := [r for r in refs if r.strip(_BLANK)]):
        return []
    own = Url.of(url)
    on, here = own.joined(Url.of(base)), str(own.joined(own))
    return [t for t in dict.fromkeys(str(on.joined(Url.of(r))) for r in refs) if "://" in t and t != here]


def alias_links(pages: DataFrame) -> DataFrame:
    """a, b: nodes of urls that canonical links or refresh redirects make the same."""
    found = pages.select("url", "html").filter(F.col("html").rlike("(?i)canonical|http-equiv") & F.col("url").contains("://"))

    def rows(batch: pa.RecordBatch) -> dict:
        out = {"a": [], "b": []}
        for url, html in zip(batch["url"].to_pylist(), batch["html"].to_pylist(), strict=True):
            for to in targets(url, html):
                out["a"].append(node(url))
                out["b"].append(to)
        return out

    return map_arrow(found, rows, "a string, b string").distinct()


def nodes(url: Column) -> Column:
    """node() of a column; null where the url is."""
    return F.arrow_udf(lambda urls: pa.array([None if u is None else node(u) for u in urls.to_pylist()], pa.string()), "string")(url)


def url_filter(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and by (rule, alias or none) of every page."""
    own = ruled(pages.select("page_id", "url"), rules)
    edges = cut(alias_links(pages))
    if edges.limit(1).count() == 0:
        return own.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", F.lit("allow")).alias("verdict"), F.when(F.col("rule").isNull(), "none").otherwise("rule").alias("by"))
    label = components(edges)
    members = ruled(label, rules, "node")
    told = members.groupBy("root").agg(F.max(F.col("rule_verdict") == "allow").alias("allowed"), F.max(F.col("rule_verdict") == "block").alias("blocked"))
    alias = joined(label, told, ["root"]).select(F.col("node").alias("bare"), F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block").alias("alias_verdict")).filter("alias_verdict IS NOT NULL")
    pages_of = cut(own.withColumn("bare", nodes(F.col("url"))))
    j = joined(pages_of, alias, ["bare"], "left")
    by = F.when(F.col("rule").isNotNull(), "rule").when(F.col("alias_verdict").isNotNull(), "alias").otherwise("none")
    return j.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", "alias_verdict", F.lit("allow")).alias("verdict"), by.alias("by"))


def op8_url_filter(spark, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages")).drop("by")


def _sql() -> str:
    """The same in SQL, from other expressions: elements that hold no tags are blanked, and each tag is taken apart by patterns."""
    low = lambda x: f"translate({x}, '{_UPPER}', '{_LOWER}')"
    blank = "|".join(["<!--.*?-->", *(rf"<{n}\b[^>]*>.*?</{n}" for n in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"))])
    tags = lambda n: rf"""regexp_extract_all(h, '(?is)<{n}\b(?:[^>"'']|"[^"]*"|''[^'']*'')*>')"""
    pairs = lambda t: rf"""regexp_extract_all({t}, '(?s)[^\s=>"''/]+\s*=\s*(?:"[^"]*"|''[^'']*''|[^\s"''>][^\s>]*)')"""
    bare = lambda x: rf"""regexp_replace({x}, '(?s)^[^=]*=\s*(?:"(.*)"|''(.*)''|(.*))$', '\1\2\3')"""
    value = lambda t, n: "coalesce(" + bare(f"list_filter({pairs(t)}, lambda y: regexp_matches(y, '(?is)^{n}[[:space:]]*='))[1]") + ", '')"
    text = lambda x: "replace(" * 5 + x + """, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&')"""
    trimmed = lambda x: rf"regexp_replace(regexp_replace({x}, '[\t\n\r]', '', 'g'), '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"
    part = lambda u, k: rf"regexp_extract({u}, '(?s)^([A-Za-z][A-Za-z0-9+.\-]*:)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?', {k})"
    user = lambda x, k: f"regexp_extract({x}, '(?s)^(.*@)?(.*)$', {k})"
    free = "^%(2[DE]|5F|7E|3[0-9]|[46][1-9A-F]|[57][0-9A])$"
    code = f"CASE WHEN regexp_matches(upper(z), '{free}') THEN chr(CAST('0x' || z[2:3] AS INTEGER)) WHEN regexp_matches(z, '^%..$') THEN upper(z) ELSE z END"
    codes = lambda x: f"array_to_string(list_transform(regexp_extract_all({x}, '(?s)%[0-9A-Fa-f][0-9A-Fa-f]|[^%]+|%'), lambda z: {code}), '')"
    parts = lambda u, p: f"{low(part(u, 1))} AS {p}s, {user(part(u, 2), 1)} || {low(user(part(u, 2), 2))} AS {p}a, {codes(part(u, 3))} AS {p}p, {codes(part(u, 4))} AS {p}q"
    step = "CASE z[1] WHEN '.' THEN a WHEN '..' THEN CASE WHEN len(a) > 1 THEN a[1:len(a) - 1] ELSE a END ELSE list_concat(a, z) END"
    kept = lambda x: f"list_reduce(list_concat([['']], list_transform(string_split({x}, '/')[2:], lambda z: [z])), lambda a, z: {step})[2:]"
    folder = lambda x: rf"CASE WHEN regexp_matches({x}, '/\.\.?$') THEN list_concat({kept(x)}, ['']) ELSE {kept(x)} END"
    dots = lambda x: f"CASE WHEN starts_with({x}, '/') THEN '/' || array_to_string({folder(x)}, '/') ELSE {x} END"

    def resolved(name: str, source: str, base: str, ref: str, to: str) -> str:
        own = "(rs <> '' OR ra <> '')"
        merged = "CASE WHEN contains(bp, '/') THEN regexp_extract(bp, '(?s)^(.*/)', 1) || rp ELSE '/' || rp END"
        path = f"CASE WHEN {own} OR starts_with(rp, '/') THEN rp WHEN rp = '' THEN bp ELSE {merged} END"
        port = "CASE ms WHEN 'http:' THEN regexp_replace(ma, ':(80)?$', '') WHEN 'https:' THEN regexp_replace(ma, ':(443)?$', '') ELSE regexp_replace(ma, ':$', '') END"
        whole = f"ms || {port} || CASE WHEN mp = '' AND ma <> '' THEN '/' ELSE {dots('mp')} END || CASE WHEN {own} OR rp <> '' OR rq <> '' THEN rq ELSE bq END"
        return f"""
{name}_1 AS (SELECT *, {parts(trimmed(base), "b")}, {parts(trimmed(ref), "r")} FROM {source}),
{name}_2 AS (SELECT *, {path} AS mp, CASE WHEN rs <> '' THEN rs ELSE bs END AS ms, CASE WHEN {own} THEN ra ELSE ba END AS ma FROM {name}_1),
{name} AS (SELECT * EXCLUDE (bs, ba, bp, bq, rs, ra, rp, rq, mp, ms, ma), {whole} AS {to} FROM {name}_2)"""

    canonical = rf"list_transform(list_filter({tags('link')}, lambda t: list_contains(regexp_split_to_array(lower({value('t', 'rel')}), '\s+'), 'canonical')), lambda t: {value('t', 'href')})"
    after = rf"regexp_extract({value('t', 'content')}, '(?is)^\s*(?:[0-9][0-9.]*|[.][0-9.]*)(?:\s*[;,]|\s)\s*(?:url\s*=\s*)?(.*)$', 1)"
    unquoted = rf"""regexp_replace({after}, '(?s)^"([^"]*).*$|^''([^'']*).*$', '\1\2')"""
    refresh = f"list_transform(list_filter({tags('meta')}, lambda t: lower({value('t', 'http-equiv')}) = 'refresh'), lambda t: {unquoted})"
    fits = "(host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)"
    return rf"""
WITH RECURSIVE h AS (
  SELECT page_id, url, html, {low("regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1)")} AS host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r(v, rh, rp) AS (VALUES {", ".join(map(str, RULES))}),
raw AS (
  SELECT url, regexp_replace(html, '(?is){blank}', ' ', 'g') AS h FROM pages
  WHERE regexp_matches(html, '(?i)canonical|http-equiv') AND contains(url, '://')),
tg AS (
  SELECT url, coalesce(list_filter(list_transform({tags("base")}, lambda t: {value("t", "href")}), lambda x: x <> '')[1], '') AS base,
    unnest(list_distinct(list_concat({canonical}, {refresh}))) AS ref FROM raw),
td AS (SELECT url, {text("base")} AS base, {text("ref")} AS ref FROM tg WHERE trim(ref) <> ''),
{resolved("w1", "td", "url", "base", "base_url")},
{resolved("w2", "w1", "base_url", "ref", "b")},
{resolved("w3", "w2", "url", "url", "a")},
e AS (SELECT DISTINCT a, b FROM w3 WHERE contains(b, '://') AND a <> b),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
c AS (SELECT a AS root, a AS node FROM s UNION SELECT c.root, s.b FROM c JOIN s ON s.a = c.node),
n AS (SELECT DISTINCT node, {low("regexp_extract(node, '://([^/?#]*)', 1)")} AS host, regexp_extract(node, '://[^/?#]*([^?#]*)', 1) AS path FROM c),
nr AS (SELECT node, arg_max(v, length(rh || rp)) AS v FROM n JOIN r ON {fits} GROUP BY node),
al AS (
  SELECT c.root AS node, CASE WHEN bool_or(v = 'allow') THEN 'allow' WHEN bool_or(v = 'block') THEN 'block' END AS v
  FROM c JOIN nr ON nr.node = c.node GROUP BY c.root),
pr AS (
  SELECT host, path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS v
  FROM (SELECT DISTINCT host, path FROM h) JOIN r ON {fits} GROUP BY host, path),
hu AS (SELECT page_id, host, path, coalesce(url, '') AS u FROM h),
{resolved("hn", "hu", "u", "u", "node")}
SELECT hn.page_id, hn.host, hn.path, pr.rule, coalesce(pr.v, al.v, 'allow') AS verdict
FROM hn LEFT JOIN pr ON pr.host = hn.host AND pr.path = hn.path LEFT JOIN al ON al.node = hn.node
"""


#: It decodes five character references where the operator knows all, and takes quotes anywhere in a tag for a value's.
OP8_SQL = _sql()
