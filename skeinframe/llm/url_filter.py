"""URL filter lists: a trie over reversed host labels, then path segments, broadcast to the tasks.

A rule (action, host, path) fits its host and all hosts below it, if the url's path starts with the rule's. The longest
fitting rule wins: the one with the most host labels, then with the longest path; of equal ones, block. Urls that no rule
fits get the default verdict.

Host: what follows the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case (a port or user stays). Path: from
there up to `?`, `#` or the end. Both are cut out by Spark functions; tasks walk the trie only for distinct pairs of an
Arrow batch. The rule list must fit a broadcast: more than MOST_RULES are refused.

Cases. Null url or one without `://`: empty host and path, default verdict. Repeated rows: each its own verdict. Empty
table: no rows. Extra columns are dropped, and html is never read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import only

#: (action, host, path)
Rule = tuple[str, str, str]
MOST_RULES = 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def build_trie(rules: Iterable[Rule]) -> dict:
    """Nested dicts: ("label", x) leads down the host from the right, "paths" to a host's path trie, ("segment", x) down
    whole path segments, and "rules" to what ends there: (rest of the path, action, rule), the longest rest first, block
    before allow.
    """
    root: dict = {}
    ends = []
    for action, host, path in rules:
        if action not in ("allow", "block"):
            raise ValueError(f"unknown action {action!r}")
        node = root
        for label in reversed(host.translate(str.maketrans(UPPER, LOWER)).split(".")):
            node = node.setdefault(("label", label), {})
        *whole, rest = path.split("/")
        node = node.setdefault("paths", {})
        for segment in whole:
            node = node.setdefault(("segment", segment), {})
        ends.append(node.setdefault("rules", []))
        ends[-1].append((rest, action, host + path))
    for rules_here in ends:
        rules_here.sort(key=lambda r: (-len(r[0]), r[1] == "allow"))
    return root


def longest_match(trie: dict, host: str, path: str) -> tuple[str, str] | None:
    """(action, rule) of the longest rule that fits."""
    found, node = None, trie
    segments = path.split("/")
    for label in reversed(host.split(".")):
        node = node.get(("label", label))
        if node is None:
            break
        inner, best = node.get("paths"), None
        for i, segment in enumerate(segments):
            if inner is None:
                break
            for rest, action, rule in inner.get("rules", ()):
                if segment.startswith(rest):
                    best = (action, rule)
                    break
            if i + 1 < len(segments):
                inner = inner.get(("segment", segment))
        found = best or found
    return found


def host_and_path(url: str | F.Column = "url") -> tuple[F.Column, F.Column]:
    url = F.col(url) if isinstance(url, str) else url
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*", 0), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return F.translate(host, UPPER, LOWER), path


def judge(pages: DataFrame, rules: Iterable[Rule], default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) for pages (page_id, url)."""
    rules = list(rules)
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; a broadcast trie takes {MOST_RULES}")
    spark = pages.sparkSession
    shared = spark.sparkContext.broadcast(build_trie(rules))
    host, path = host_and_path()
    parts = only(pages, page_id="long", url="string").select("page_id", host.alias("host"), path.alias("path"))

    @F.pandas_udf("rule string, verdict string")
    def walk(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        trie = shared.value
        for hosts, paths in it:
            known: dict = {}
            rows = []
            for pair in zip(hosts, paths, strict=True):
                if pair not in known:
                    action, rule = longest_match(trie, *pair) or (default, None)
                    known[pair] = (rule, action)
                rows.append(known[pair])
            yield pd.DataFrame(rows, columns=["rule", "verdict"])

    return parts.withColumn("judged", walk("host", "path")).select("page_id", "host", "path", "judged.rule", "judged.verdict")
