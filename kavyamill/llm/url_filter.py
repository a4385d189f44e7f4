"""URL filters: rules by host and path, and decisions passed on to redirect and canonical aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kavyamill.llm.common import checkpointed
from kavyamill.llm.graph import connected_components

#: The rules that the query applies.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
MAX_RULES = 2_000

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)([^#]*)"
_CANONICAL = (r"(?is)<link\b[^>]*?\brel\s*=\s*[\"']?canonical\b[^>]*>", r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)")
_REFRESH = (r"(?is)<meta\b[^>]*?\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>", r"(?is)\burl\s*=\s*'?([^\"'\s>]+)")


def _part(url: Column, group: int) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, group), F.lit(""))


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or end, A-Z lower-cased; empty without ://."""
    return F.translate(_part(url, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return _part(url, 2)


def key_of(url: Column) -> Column:
    """What names a page: host, path and query, without scheme and fragment; null without ://."""
    key = F.concat(host_of(url), path_of(url), _part(url, 3))
    return F.when(F.contains(url, F.lit("://")), key)


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits: its host or a subdomain of it, and a path that starts with the rule's."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda x: (len(x), x)):
        at, slash, rest = rule.partition("/")
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(slash + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def verdict_of(rule: Column, rules: dict[str, str]) -> Column:
    return F.when(rule.isin([k for k, v in rules.items() if v == "allow"]), "allow").when(rule.isin([k for k, v in rules.items() if v == "block"]), "block")


def alias_links(pages: DataFrame) -> DataFrame:
    """(url, target) of each canonical link and meta refresh in the pages' html; relative targets are resolved."""

    def target(pattern: tuple[str, str]) -> Column:
        return F.regexp_extract(F.regexp_extract("html", pattern[0], 0), pattern[1], 1)

    # The plain search comes first: most pages have neither, and it is far cheaper than the patterns.
    some = pages.select("url", "html").where(F.contains(F.col("url"), F.lit("://")) & F.lower("html").rlike("canonical|refresh"))
    found = some.select("url", F.explode(F.array(target(_CANONICAL), target(_REFRESH))).alias("to")).where("to <> ''")
    scheme = F.regexp_extract("url", r"(?s)^(.*?)://", 1)
    root = F.regexp_extract("url", r"(?s)^.*?://[^/?#]*", 0)
    folder = F.regexp_replace(F.regexp_extract("url", r"(?s)^.*?://[^?#]*", 0), r"(?s)(?<=[^/:])/[^/]*$", "")
    full = F.when(F.contains(F.col("to"), F.lit("://")), F.col("to")).when(F.col("to").startswith("//"), F.concat(scheme, F.lit(":"), "to")).when(F.col("to").startswith("/"), F.concat(root, "to")).otherwise(F.concat(folder, F.lit("/"), "to"))
    return found.select("url", full.alias("target"))


def judge(pages: DataFrame, rules: dict[str, str] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, alias_verdict and component of every row of pages.

    verdict is the longest fitting rule's; without one, that of the url's aliases: urls joined by canonical links
    or meta refreshes in the pages' html, or by `redirects` (url, target), in any number of steps. Aliases with an
    allowed url allow, else those with a blocked one block, else the page is allowed. component names the aliases
    (null without). Null urls and urls without :// have empty host and path and no aliases; null html has no links;
    repeated rows repeat; other columns are ignored.
    """
    links = alias_links(pages)
    if redirects is not None:
        links = links.unionByName(redirects.select("url", "target"))
    ends = links.select(key_of(F.col("url")).alias("a"), F.col("target"), key_of(F.col("target")).alias("b")).where("a is not null and b is not null and a <> b")
    ends = checkpointed(ends.select("a", "b").distinct())
    judged = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    judged = judged.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    own = verdict_of(F.col("rule"), rules)
    if ends.isEmpty():
        nothing = F.lit(None)
        return judged.select("page_id", "host", "path", "rule", F.coalesce(own, F.lit("allow")).alias("verdict"), nothing.cast("string").alias("alias_verdict"), nothing.cast("long").alias("component"))
    names = ends.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    parts = connected_components(ends.select(F.xxhash64("a").alias("src"), F.xxhash64("b").alias("dst")))
    host, path = F.regexp_extract("key", r"(?s)^[^/?#]*", 0), F.regexp_extract("key", r"(?s)^[^/?#]*([^?#]*)", 1)
    seen = names.withColumn("own", verdict_of(rule_of(host, path, rules), rules)).withColumn("id", F.xxhash64("key"))
    seen = seen.join(parts, "id")
    fate = seen.groupBy("component").agg(F.min("own").alias("alias_verdict"))  # "allow" comes before "block"
    known = seen.join(fate, "component").select("key", "component", "alias_verdict")
    joined = judged.withColumn("key", key_of(F.col("url"))).join(known, "key", "left")
    return joined.select("page_id", "host", "path", "rule", F.coalesce(own, "alias_verdict", F.lit("allow")).alias("verdict"), "alias_verdict", "component")
