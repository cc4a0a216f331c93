"""Verdicts on page URLs by host and path rules, carried to aliases over redirect and canonical-link edges.

Canonical links and refresh redirects in a page, and a redirect target in a URL's query, join nodes; a node is a URL
without its fragment, whether or not it is a row of ``pages``. Connected components of these edges are classes of
aliases. A page that no rule judges takes its class's decision: allow if a rule allows any URL of the class, else block
if one blocks any, else allow.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copse.llm.common import cut
from copse.llm.components import components

#: (verdict, host, path); rules are a parameter list of the query, written out as one expression.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
MAX_RULES = 1000

_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TRACKING = r"(?:utm_[^=&]*|ref|fbclid|gclid)(?:=[^&]*)?"
_COMMENT = r"(?s)<!--.*?(?:-->|\z)"
#: Tags as far as the next angle bracket: no expression over a tag looks back or repeats a group, so each is linear in it.
_LINK, _META = r"(?is)<link\b[^<>]*+", r"(?is)<meta\b[^<>]*+"
#: The value of an attribute in either kind of quotes, or bare.
_VALUE = r"\s*+=\s*+(?:\"([^\"]*+)|'([^']*+)|([^\"'\s]++))"
_URL = r"(?is)[\s;,\"']url\s*+=\s*+[\"']?+\s*+([^\"']++)"
_TARGET = r"[?&](?:url|redirect|redirect_uri|dest|target|to)=(https?(?::|%3A|%3a)[^&#]*)"
#: Pages without one of these words have no link of either kind; the patterns are not tried on them.
_HINT = r"(?i)canonical|http-equiv"


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), _CAPITALS, _SMALL), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column, spellings: bool = False) -> Column:
    """The name of a URL's node: the URL without its fragment, null without ``://``.

    Scheme and host are lower-cased, and an empty path is ``/``. With ``spellings``, the scheme, ``www.`` or ``m.``,
    ``index.html`` and the like, trailing slashes and tracking parameters make no difference either.
    """
    host, path, query = host_of(url), path_of(url), F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    if spellings:
        host = F.regexp_replace(host, r"^(?:www|m)\.", "")
        path = F.regexp_replace(F.regexp_replace(path, r"(?:/index)?\.html?$", ""), r"/+$", "")
        query = F.regexp_replace(F.regexp_replace(query, rf"(?<=^|&){_TRACKING}(?:&|$)", ""), r"&$", "")
        scheme = F.lit("")
    else:
        path = F.when(path == "", "/").otherwise(path)
        scheme = F.concat(F.translate(F.substring_index(url, "://", 1), _CAPITALS, _SMALL), F.lit("://"))
    return F.when(F.instr(url, "://") > 0, F.concat(scheme, host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def resolved(base: Column, target: Column) -> Column:
    """A link's target as a whole URL, from the URL of the page that it stands on."""
    origin = F.regexp_extract(base, r"^(.*?://[^/?#]*)", 1)
    plain = F.regexp_extract(base, r"^([^?#]*)", 1)
    folder = F.when(path_of(base).contains("/"), F.regexp_extract(plain, r"^(.*/)", 1)).otherwise(F.concat(origin, F.lit("/")))
    whole = (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), target)
        .when(target.startswith("//"), F.concat(F.substring_index(base, "://", 1), F.lit(":"), target))
        .when(target.startswith("/"), F.concat(origin, target))
        .when(target.startswith("?"), F.concat(plain, target))
        .when(target.startswith("#"), F.concat(F.substring_index(base, "#", 1), target))
        .otherwise(F.concat(folder, target))
    )
    return F.when(path_of(whole).rlike(r"/\.\.?(?:/|$)"), _without_dots(whole)).otherwise(whole)


def _without_dots(url: Column) -> Column:
    """``.`` and ``..`` in a path are steps that are taken."""
    parts = F.slice(F.split(path_of(url), "/", -1), 2, 1 << 30)
    step = lambda done, p: F.when(p == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(p == ".", done).otherwise(F.concat(done, F.array(p)))
    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    slash = F.when(F.element_at(parts, -1).isin(".", ".."), F.lit("/")).otherwise("")
    rest = F.regexp_extract(url, r"^[^?#]*(.*)$", 1)
    return F.concat(F.regexp_extract(url, r"^(.*?://[^/?#]*)", 1), F.lit("/"), F.array_join(kept, "/"), F.when(F.size(kept) > 0, slash).otherwise(""), rest)


def _attribute(tag: Column, name: str) -> Column:
    """The value of a tag's first attribute of a name, without white space around it; empty if there is none."""
    return F.trim(F.concat(*[F.regexp_extract(tag, rf"(?is)\s{name}{_VALUE}", i) for i in (1, 2, 3)]))


def _links(html: Column) -> Column:
    """Targets of all canonical links and refresh redirects outside comments, with ``&amp;`` and its like decoded.

    A link is canonical if that is one of the words of its ``rel``, however many there are.
    """
    text = F.regexp_replace(html, _COMMENT, "")
    tags = lambda pattern, fits: F.filter(F.regexp_extract_all(text, F.lit(pattern), 0), fits)
    canonical = tags(_LINK, lambda t: F.array_contains(F.split(F.lower(_attribute(t, "rel")), r"\s+"), "canonical"))
    refresh = tags(_META, lambda t: _attribute(t, "http-equiv").rlike(r"(?i)^refresh\b"))
    found = F.concat(F.transform(canonical, lambda t: _attribute(t, "href")), F.transform(refresh, lambda t: F.regexp_extract(t, _URL, 1)))
    return F.transform(found, lambda x: F.trim(F.regexp_replace(x, "(?i)&(?:amp|#38|#x26);", "&")))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The longest rule that fits, as a struct (rule, verdict), or null; of equal rules an allowing one."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules make too large an expression")
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "allow")):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def alias_edges(pages: DataFrame, spellings: bool = False) -> DataFrame:
    """``a, b, to``: node names joined by canonical links, refresh redirects and redirect targets in URLs, and the target's URL.

    All such links of a page count. A relative target is resolved against the page's URL; links inside HTML comments
    are none; targets without ``://`` (``mailto:`` and the like) and links of a page to itself are left out.
    """
    url, html = F.col("url"), F.coalesce(F.col("html"), F.lit(""))
    none = F.array().cast("array<string>")
    inside = F.when(html.rlike(_HINT), F.transform(F.filter(_links(html), lambda x: x != ""), lambda x: resolved(url, x))).otherwise(none)
    asked = F.transform(F.regexp_extract_all(url, F.lit(_TARGET), 1), F.try_url_decode)
    pairs = pages.where(F.instr(url, "://") > 0).select(node_of(url, spellings).alias("a"), F.explode(F.concat(inside, asked)).alias("to"))
    pairs = pairs.select("a", node_of(F.col("to"), spellings).alias("b"), F.regexp_extract("to", "^([^#]*)", 1).alias("to"))
    return pairs.where("b IS NOT NULL AND a <> b").distinct()


def _decisions(found: DataFrame, key: str) -> DataFrame:
    """``key, allow, block``: whether a rule allows or blocks any of the key's rows."""
    return found.groupBy(key).agg(F.bool_or("allow").alias("allow"), F.bool_or("block").alias("block"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, spellings: bool = False) -> DataFrame:
    """``page_id, host, path, rule, verdict, alias_class`` for each row of ``pages`` (``page_id, url, html``).

    A null URL, or one without ``://``, has empty host and path, fits no rule, has no aliases and is allowed. A
    null html has no links; a long one is read whole. Links are those of ``alias_edges``: all of a page, relative ones
    included. A link's target is judged by the rules whether or not it is a row, so a page that redirects to a blocked
    URL outside the table is blocked. With ``spellings``, other spellings of a URL (see ``node_of``) are the same node.
    Repeated rows each get a row; an empty table gives an empty result; other columns are left out. ``alias_class`` is
    the smallest node name of the class.
    """
    url = F.col("url")
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), node_of(url, spellings).alias("node"))
    rows = rows.withColumn("found", rule_for(F.col("host"), F.col("path"), rules))
    edges = cut(alias_edges(pages.select("url", "html"), spellings))
    to = edges.select(F.col("b").alias("node"), rule_for(host_of(F.col("to")), path_of(F.col("to")), rules).alias("found"))
    ruled = rows.select("node", "found").unionByName(to).where("node IS NOT NULL AND found IS NOT NULL")
    ruled = _decisions(ruled.select("node", (F.col("found.verdict") == "allow").alias("allow"), (F.col("found.verdict") == "block").alias("block")), "node")
    roots = components(edges).withColumnRenamed("root", "alias_class")
    named = ruled.join(roots, "node", "left").withColumn("alias_class", F.coalesce("alias_class", "node"))
    out = rows.join(roots, "node", "left").withColumn("alias_class", F.coalesce("alias_class", "node"))
    out = out.join(_decisions(named, "alias_class"), "alias_class", "left")
    by_class = F.when(F.col("block") & ~F.col("allow"), "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", by_class).alias("verdict"), "alias_class")
