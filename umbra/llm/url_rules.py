"""URL filtering by rules that are indexed by their rarest literal token.

A rule is a regular expression for the host and one for the path, of which both or either must be found, with the literal tokens that
any url it fits must have. Tokens are counted over the urls; each rule waits under its rarest one. A url's tokens fetch the rules that
wait for them, and only those are tried. Of the rules that fit, the longest decides, and at equal length the first by number.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str
    host: str  # Java and RE2 syntax, searched in the host
    path: str  # and in the path
    tokens: tuple[str, ...]  # lower-case runs of letters and digits that stand whole in every url that the rule fits
    length: int
    named: bool = True  # reported as the url's rule
    either: bool = False  # one of host and path is enough


def _tokens(*texts: str) -> tuple[str, ...]:
    found = tuple(t for x in texts for t in re.findall(r"[a-z0-9]+", x))
    if not found:
        raise ValueError(f"a rule needs a literal token of letters a-z or digits: {texts}")
    return found


def site_rule(verdict: str, site: str) -> Rule:
    """A rule for a host and all its subdomains, and all paths that start with what follows the host."""
    host, _, path = site.partition("/")
    path = "/" + path
    whole = re.findall(r"[a-z0-9]+(?=[^a-z0-9])", path.lower())  # what the prefix may cut short is no whole token
    return Rule(site, verdict, rf"^(?:(?s:.*)\.)?{re.escape(host)}\z", rf"^{re.escape(path)}", (*_tokens(host), *whole), len(site))


def label_rule(verdict: str, label: str) -> Rule:
    """A rule for hosts that have this label before another one."""
    return Rule(label, verdict, rf"(^|\.){re.escape(label)}\.", "", _tokens(label), 0, named=False)


def word_rule(verdict: str, word: str) -> Rule:
    """A rule for urls that have this word in host or path."""
    found = rf"(^|[^A-Za-z0-9])(?i:{re.escape(word)})([^A-Za-z0-9]|$)"
    return Rule(word, verdict, found, found, _tokens(word.lower()), 0, named=False, either=True)


#: The rules that a url's verdict is named after.
SITES = [site_rule("block", "com/en/"), site_rule("allow", "example.com/en/7"), site_rule("allow", "net/de/"), site_rule("block", "example.net/de/8"), site_rule("block", "org/es/")]
#: Rules for the other urls; what none of them fits is allowed.
OTHERS = [*(label_rule("block", x) for x in ("cheap-pills", "spam-farm")), *(word_rule("block", x) for x in ("casino", "viagra", "torrent", "xxx", "porn"))]


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next / ? # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What stands between the host and the next ? # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    rows = [(k, r.name if r.named else None, r.verdict, r.host, r.path, r.either, list(r.tokens), r.length) for k, r in enumerate(rules)]
    return spark.createDataFrame(rows, "rule_no int, rule string, verdict string, host_pattern string, path_pattern string, either boolean, tokens array<string>, length int")


def tried(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls(host, path) with each rule that is tried on them: those whose rarest token, by the number of urls that have it, the url has."""
    tokens = F.array_distinct(F.filter(F.split(F.lower(F.concat_ws(" ", "host", "path")), "[^a-z0-9]+"), lambda t: t != ""))
    held = urls.select("host", "path", F.explode(tokens).alias("token"))
    waiting = rules.select("rule_no", F.explode("tokens").alias("token"))
    seen = held.join(waiting.select("token").distinct(), "token").groupBy("token").agg(F.count("*").alias("n"))
    rarest = waiting.join(seen, "token", "left").groupBy("rule_no").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "token"))["token"].alias("token"))
    index = rules.join(rarest, "rule_no").select("token", "rule", "verdict", "host_pattern", "path_pattern", "either", "length", "rule_no")
    return held.join(index, "token")


def judged(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: id, host, path, rule (null if a rule without name, or none, decided), verdict.

    Null urls and those without :// have an empty host and path and are allowed: no rule's token is in them. Repeated rows stay
    repeated, empty tables stay empty, other columns are not read. Very long urls are judged whole. Urls are judged once, however often
    they occur; Spark sends the rules to all tasks only if they are under its broadcast threshold, and joins them otherwise.
    """
    named = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    parts = named.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).filter("host <> '' OR path <> ''").distinct()
    in_host, in_path = F.regexp("host", F.col("host_pattern")), F.regexp("path", F.col("path_pattern"))
    fits = tried(parts, rules).filter(F.when(F.col("either"), in_host | in_path).otherwise(in_host & in_path))
    best = fits.groupBy("host", "path").agg(F.max(F.struct("length", (-F.col("rule_no")).alias("first"), "rule", "verdict")).alias("best"))
    whole = named.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))}).select("id", "host", "path")
    blank = (F.col("host") == "") & (F.col("path") == "")  # these may be many, and have no token that a rule could wait for
    met = whole.filter(~blank).join(best, ["host", "path"], "left")
    none = F.lit(None).cast("string")
    found = met.select("id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict"))
    return found.unionByName(whole.filter(blank).select("id", "host", "path", none.alias("rule"), F.lit("allow").alias("verdict")))
