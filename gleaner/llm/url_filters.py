"""URL rules whose block decisions reach redirect and canonical-link aliases.

A rule (verdict, host, path) fits its host, all subdomains, and paths that start
with its path; the longest fitting rule decides, an allow rule before a block
rule of the same length. Pages state aliases by ``<link rel=canonical>`` and
``<meta http-equiv=refresh>``; the alias graph's connected components carry a
block verdict from any member (a link target need not be a page of the table) to
every member that no rule names. A rule that fits a page itself comes first, so
an explicit allow is never overruled by an alias.

Only DataFrame expressions are used. Rules are matched by an equi-join on the
host's suffixes of up to as many labels as a rule has, so a long rule list needs no
other code path and a host of very many labels stays small; only pages with an
alias link take part in the component search. Pages without a url join nothing;
what joins a frequent url runs between plain exchanges, which the session's skew
handling (spark.sql.adaptive.skewJoin) may split.

Defined cases: a null url, or one without ``://``, has empty host and path and
is allowed unless an alias blocks it; null html has no links; repeated urls are one
node of the graph and every row is judged; very long urls and html are read whole;
of an allow and a block rule of equal length the allow rule decides; empty tables
give empty results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, scratch
from .components import connected_components

Rule = tuple[str, str, str]


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), "^[^?#]*", 0)
    return ascii_lower(raw), path


def match_rules(urls: DataFrame, rules: DataFrame, labels: int) -> DataFrame:
    """``urls`` (key, host, path) -> key, rule, verdict of the longest fitting rule; keys without one are absent. labels: of a rule's host at most."""
    most = F.least(F.lit(labels), F.length("host") - F.length(F.replace("host", F.lit("."), F.lit(""))) + 1)
    suffixes = F.transform(F.sequence(F.lit(1), most), lambda i: F.call_function("substring_index", F.col("host"), F.lit("."), -i))
    ended = urls.select("key", "path", F.explode(suffixes).alias("rule_host"))
    fitting = ended.join(rules, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    rank = F.struct(F.length(F.concat("rule_host", "rule_path")), F.col("rule_verdict") == "allow", F.concat("rule_host", "rule_path"))
    best = fitting.groupBy("key").agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_verdict").alias("verdict")), rank).alias("b"))
    return best.select("key", "b.rule", "b.verdict")


def alias_links(pages: DataFrame) -> DataFrame:
    """(url, target) by canonical links and immediate or delayed refreshes, targets made absolute, fragments cut."""
    tags = F.regexp_extract_all(F.regexp_replace("html", "(?s)<!--.*?-->", ""), F.lit("(?is)<(?:link|meta)\\b[^>]*>"), F.lit(0))
    found = pages.where(F.col("url").isNotNull() & F.col("html").rlike("(?i)canonical|http-equiv")).select("url", F.explode(tags).alias("tag"))
    value = lambda name: F.regexp_extract("tag", f"(?is)\\b{name}\\s*=\\s*(\"[^\"]*\"|'[^']*'|[^\\s\"'>]+)", 1)
    bare = lambda c: F.trim(F.regexp_replace(c, "^[\"']|[\"']$", ""))
    canonical = F.col("tag").rlike("(?is)^<link\\b") & bare(value("rel")).rlike("(?i)(^|\\s)canonical(\\s|$)")
    refresh = F.col("tag").rlike("(?is)^<meta\\b") & bare(value("http-equiv")).rlike("(?i)^refresh$")
    jump = F.regexp_extract(bare(value("content")), "(?is)^[0-9.\\s]*[;,]\\s*(?:url\\s*=)?\\s*[\"']?([^\"']+)", 1)
    raw = F.when(canonical, bare(value("href"))).when(refresh, F.trim(jump))
    links = found.select("url", F.regexp_replace(F.replace(raw, F.lit("&amp;"), F.lit("&")), "#.*$", "").alias("to")).where("to != ''")
    scheme, root = F.regexp_extract("url", "^[^:/?#]*:", 0), F.regexp_extract("url", "^[^:/?#]*://[^/?#]*", 0)
    folder = F.regexp_extract("url", "^[^:/?#]*://[^/?#]*(?:/(?:[^?#]*/)?)?", 0)
    folder = F.when(folder == root, F.concat(root, F.lit("/"))).otherwise(folder)
    target = (
        F.when(F.col("to").rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.col("to"))
        .when(F.col("to").startswith("//"), F.concat(scheme, "to"))
        .when(F.col("to").startswith("/"), F.concat(root, "to"))
        .otherwise(F.concat(folder, "to"))
    )
    return links.select("url", target.alias("target"))


def node_of(url: Column) -> Column:
    """A url as a node: fragment cut, scheme and host in lower case, an empty path as ``/``."""
    plain = F.regexp_replace(url, "#.*$", "")
    head = F.regexp_extract(plain, "^[^:/?#]*://[^/?#]*", 0)
    tail = F.substring(plain, F.length(head) + 1, F.length(plain))
    return F.concat(ascii_lower(head), F.when((head != "") & ~tail.startswith("/"), F.concat(F.lit("/"), tail)).otherwise(tail))


def url_filters(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """page_id, host, path, rule and verdict of every page row."""
    spark = pages.sparkSession
    table = spark.createDataFrame(rules, "rule_verdict string, rule_host string, rule_path string")
    labels = max((host.count(".") + 1 for _, host, _ in rules), default=1)
    pages = pages.select("page_id", F.col("url").cast("string"), F.col("html").cast("string"))
    links = materialize(alias_links(pages).select(node_of(F.col("url")).alias("u"), node_of(F.col("target")).alias("v")).distinct(), "alias_links")
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    names = parsed.select("host", "path").distinct()
    ruled = match_rules(names.select(F.struct("host", "path").alias("key"), "host", "path"), table, labels).select("key.host", "key.path", "rule", "verdict")
    with scratch():
        members = materialize(connected_components(links), "alias_members", keep=True)
    host, path = host_and_path(F.col("node"))
    judged = match_rules(members.select(F.col("node").alias("key"), host.alias("host"), path.alias("path")), table, labels).where("verdict = 'block'")
    bad = judged.join(members, judged["key"] == members["node"]).select("component").distinct()
    blocked = members.join(bad, "component").select("node", F.lit("block").alias("spread"))
    none = parsed.where("url is null").select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    out = parsed.where("url is not null").withColumn("node", node_of(F.col("url"))).join(ruled, ["host", "path"], "left").join(blocked, "node", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", "spread", F.lit("allow")).alias("verdict")).union(none)
