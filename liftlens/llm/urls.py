"""URL filter rules, indexed by their rarest literal token. DataFrame functions only.

A rule is (verdict, host, path): it fits its host and all subdomains where the
URL's path starts with the rule's; the longest rule wins. Its literal tokens are
the labels of its host and the whole segments of its path. Each rule is listed
under the one of them that the fewest URLs hold (counted over all URLs). The
tokens of a URL fetch the rules listed there, and only these run their regular
expression against ``host || path``. The index goes to the tasks as a constant
map, in blocks of at most BLOCK rules, so its size is bounded for any rule set;
URLs aren't shuffled.

Host: from behind the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
lower-cased; path: from there up to ``?``, ``#`` or the end. Null URLs, and those
without ``://``, have empty ones. No fitting rule: null rule, the default verdict.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import free

BLOCK = 5_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The rules of the registered query.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(host: Column, path: Column) -> Column:
    """Host labels as ``h:label``, whole path segments (with a slash on both sides) as ``p:segment``."""
    labels = F.transform(F.split(host, r"\."), lambda t: F.concat(F.lit("h:"), t))
    parts = F.split(path, "/")
    inner = F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0)))
    segments = F.transform(inner, lambda t: F.concat(F.lit("p:"), t))
    return F.array_distinct(F.concat(labels, segments))


def _rule_tokens(host: str, path: str) -> set[str]:
    return {f"h:{t}" for t in host.split(".")} | {f"p:{t}" for t in path.split("/")[1:-1]}


def _blocks(rules: Iterable[tuple[str, str, str]]) -> list[list[tuple[str, str, str]]]:
    rules = list(dict.fromkeys((v, h.translate(str.maketrans(UPPER, LOWER)), p) for v, h, p in rules))
    return [rules[i:i + BLOCK] for i in range(0, len(rules), BLOCK)]


def token_counts(urls: DataFrame, tokens: set[str]) -> dict[str, int]:
    """How many rows of ``urls`` (host, path) hold each of the tokens; one row per wanted token comes back."""
    wanted = F.from_json(F.lit(json.dumps(dict.fromkeys(sorted(tokens), 1))), "map<string,int>")
    held = urls.select(F.explode(F.filter(tokens_of(F.col("host"), F.col("path")), lambda t: wanted[t].isNotNull())).alias("token"))
    return {r["token"]: r["n"] for r in held.groupBy("token").agg(F.count("*").alias("n")).collect()}


def index_of(rules: list[tuple[str, str, str]], counts: dict[str, int]) -> dict[str, list[dict]]:
    """Rules by their rarest token, with their regular expressions over ``host || path``."""
    index: dict[str, list[dict]] = {}
    for verdict, host, path in rules:
        rarest = min(sorted(_rule_tokens(host, path)), key=lambda t: counts.get(t, 0))
        pattern = rf"^(?:[^/]*\.)?{re.escape(host)}" + (re.escape(path) if path else r"(?:/|\z)")
        index.setdefault(rarest, []).append({"n": len(host + path), "rule": host + path, "verdict": verdict, "re": pattern})
    return index


def _fetched(tokens: Column, index: Column) -> Column:
    """The index's entries of the tokens, null where it has none."""
    return F.transform(tokens, lambda t: index[t])


def judge(df: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, url: str = "url", default: str = "allow") -> DataFrame:
    """``df`` with host, path, rule and verdict of its URLs (such columns are replaced); rows and other columns stay."""
    parsed = df.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    host, path, best = F.col("host"), F.col("path"), []
    for block in _blocks(rules):
        counts = token_counts(parsed.select("host", "path"), set().union(*(_rule_tokens(h, p) for _, h, p in block)))
        index = F.from_json(F.lit(json.dumps(index_of(block, counts))),
                            "map<string,array<struct<n:int,rule:string,verdict:string,re:string>>>")
        listed = F.filter(_fetched(tokens_of(host, path), index), lambda r: r.isNotNull())
        fitting = F.filter(F.flatten(listed), lambda r: F.rlike(F.concat(host, path), r["re"]))
        best.append(F.array_max(F.transform(fitting, lambda r: F.struct(r["n"].alias("n"), r["rule"].alias("rule"), r["verdict"].alias("verdict")))))
    top = F.greatest(*best) if len(best) > 1 else best[0] if best else F.lit(None).cast("struct<n:int,rule:string,verdict:string>")
    best_name = free("best_rule", parsed.columns)
    return parsed.withColumn(best_name, top).withColumn("rule", F.col(f"{best_name}.rule")) \
        .withColumn("verdict", F.coalesce(f"{best_name}.verdict", F.lit(default))).drop(best_name)


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, winning rule and verdict."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")).drop("url")
