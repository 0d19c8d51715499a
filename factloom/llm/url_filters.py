"""Verdicts on urls by pattern rules that are found through their rarest literal token; DataFrame operators only.

A rule is a host and the beginning of a path, in which ``*`` stands for any
characters. It fits its host and all subdomains, if the url's path begins like
the rule's. The longest fitting rule decides.

The labels of a rule's host and the whole literal segments of its path are its
tokens: a url that the rule fits holds each of them. All urls' tokens that occur
in a rule are counted once, and each rule is indexed by the one that the fewest
urls hold. A url's tokens fetch candidate rules, and only those run their
regular expression.

Up to ``INLINE`` rules the index is a map inside the plan, so rows aren't
shuffled at all. A larger index is a table that the urls' tokens are joined with;
Spark broadcasts it if its measured size allows, else it shuffles and splits
tokens that many urls hold. The fitting rules of equal hosts and paths are merged
before they are joined back. Both ways give the same rows.

Defined results: a null url, or one without ``://``, has an empty host and path; a
url that no rule fits, and every url without rules, gets the default; of equally
long rules the one with the longer host decides, then block before allow; rules
that repeat count once, and those with a null count as none; repeated rows get
equal verdicts; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ship_by_value
from .workspace import Workspace

ship_by_value(__name__)

INLINE = 256
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _tokens(host: Column, segments: Column) -> Column:
    """A host's labels and a path's segments, apart from one another; an empty token that each url holds."""
    labels = F.transform(F.filter(F.split(host, r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("."), x))
    parts = F.transform(F.filter(segments, lambda x: x != ""), lambda x: F.concat(F.lit("/"), x))
    return F.array_distinct(F.concat(labels, parts, F.array(F.lit(""))))


def url_tokens(host: Column, path: Column) -> Column:
    return _tokens(host, F.split(path, "/"))


def compiled(rules: DataFrame) -> DataFrame:
    """(rule, verdict, host_chars, pattern, tokens) of rules (host, path, verdict)."""
    c = F.col
    given = rules.where("host is not null and path is not null and verdict is not null")
    given = given.select(F.translate("host", UPPER, LOWER).alias("host"), c("path").cast("string").alias("path"), c("verdict").cast("string").alias("verdict")).distinct()
    literal = lambda x: F.regexp_replace(x, r"([\\.^$|?+()\[\]{}])", r"\\$1")
    domain = F.when(c("host") == "", F.lit("[^/]*")).otherwise(F.concat(F.lit(r"(?:[^/]*\.)?"), literal(F.regexp_replace("host", r"\*", r"\\*"))))
    begin = F.when(c("path") == "", F.lit(r"(?:/|\z)")).otherwise(F.regexp_replace(literal(c("path")), r"\*", ".*"))
    segments = F.split("path", "/")
    # What follows the last slash may go on in a url, so it is no whole segment.
    whole = F.filter(F.slice(segments, F.lit(1), F.size(segments) - 1), lambda x: ~F.contains(x, F.lit("*")))
    return given.select(
        F.concat("host", "path").alias("rule"), "verdict", F.length("host").alias("host_chars"),
        F.concat(F.lit(r"(?s)\A"), domain, begin).alias("pattern"), _tokens(c("host"), whole).alias("tokens"),
    )


def by_rarest_token(urls: DataFrame, rules: DataFrame, space: Workspace) -> DataFrame:
    """(token, rules): compiled rules under their token that the fewest of urls (host, path) hold."""
    asked = rules.select(F.explode("tokens").alias("token")).where("token != ''").distinct()
    seen = urls.select(F.explode(url_tokens(F.col("host"), F.col("path"))).alias("token")).join(asked, "token", "left_semi").groupBy("token").count()
    each = rules.select("rule", "verdict", "host_chars", "pattern", F.explode("tokens").alias("token"))
    # The empty token is a last resort, behind the commonest one.
    rank = F.struct(F.col("token") == "", F.coalesce("count", F.lit(0)), "token")
    chosen = each.join(space.write(seen, "frequencies"), "token", "left").groupBy("rule", "verdict", "host_chars", "pattern").agg(F.min_by("token", rank).alias("token"))
    item = F.struct(F.length("rule").alias("chars"), "host_chars", "verdict", "rule", "pattern")
    return chosen.groupBy("token").agg(F.sort_array(F.collect_list(item)).alias("rules"))


def _fitting(found: Column, address: Column) -> Column:
    return F.filter(found, lambda r: F.rlike(address, r["pattern"]))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url", inline: int = INLINE) -> DataFrame:
    """id_col, host, path, rule, verdict for every row of pages; rules (host, path, verdict)."""
    spark = pages.sparkSession
    space = Workspace(spark, "url-filters")
    host, path = host_and_path(F.coalesce(F.col(url_col).cast("string"), F.lit("")))
    urls = pages.select(F.col(id_col).alias("_id"), host.alias("host"), path.alias("path"))
    index = space.write(by_rarest_token(urls, space.write(compiled(rules), "rules"), space), "index")
    address, tokens = F.concat("host", "path"), url_tokens(F.col("host"), F.col("path"))
    out = lambda df: df.select(F.col("_id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))

    sizes = index.agg(F.coalesce(F.sum(F.size("rules")), F.lit(0))).first()[0]
    if sizes <= inline:
        kind = "array<struct<chars: int, host_chars: int, verdict: string, rule: string, pattern: string>>"
        literal = lambda r: F.struct(*(F.lit(r[k]).alias(k) for k in ("chars", "host_chars", "verdict", "rule", "pattern")))
        pairs = [x for row in sorted(index.collect()) for x in (F.lit(row["token"]), F.array(*map(literal, row["rules"])))]
        known = F.create_map(*pairs) if pairs else F.from_json(F.lit("{}"), f"map<string, {kind}>")
        candidates = F.flatten(F.filter(F.transform(tokens, lambda t: F.try_element_at(known, t)), lambda x: x.isNotNull()))
        return out(urls.select("*", F.array_max(_fitting(candidates, address)).alias("best")))

    fetched = urls.select("host", "path", F.explode(tokens).alias("token")).join(index, "token")
    fits = fetched.select("host", "path", F.array_max(_fitting(F.col("rules"), address)).alias("best")).where("best is not null")
    matched = space.write(fits.groupBy("host", "path").agg(F.max("best").alias("best")), "matched")
    return out(urls.join(matched, ["host", "path"], "left"))
