"""URL filters: a trie over reversed host labels and path segments, the longest matching rule decides.

A rule is a host, the beginning of a path and a verdict, ``allow`` or ``block``. It fits its host and all
hosts below it, where the url's path begins with the rule's; an empty host fits every host. Of the rules that
fit, the one of most host labels wins, of these the one of the longest path; where both verdicts are given for
one host and path, block wins. A url that no rule fits gets the default verdict.

The host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z in lower case; the
path is what follows up to ``?``, ``#`` or the end. Both are taken as they are: no port, user, dot or escape is
interpreted.

The trie is broadcast if the rules, counted, are few and small (``RULES_ROWS``, ``RULES_BYTES``); it then costs
a step per host label and path segment. A longer list meets the urls in shuffle joins on the trie's nodes, which
give the same answers.

Defined cases: a null url, or one without ``://``, has an empty host and path; a null host or path of a rule is
empty, a rule of another verdict than allow or block is an error; repeated rows each get their answer; no rules
leave the default; other columns stay, and the four that are added replace columns of their names.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.components import salted_join
from veilframe.llm.shipping import settle, ship

#: Rules, and bytes of their hosts and paths, up to which the trie is broadcast (some 100 MB of a worker).
RULES_ROWS, RULES_BYTES = 200_000, 16 << 20
ADDED = ("host", "path", "rule", "verdict")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Empty strings where there is no ``://``."""
    part = lambda n: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", n), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


class Trie:
    """Edges by (node, host label) and, below a host, by (node, "/" and path segment); a rule's last segment is the beginning of one, so it is kept by its length."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.edges: dict[tuple[int, str], int] = {}
        self.tails: dict[int, dict[str, tuple[str, str]]] = {}
        for host, path, verdict in sorted(rules):  # allow before block, which so replaces it
            node = 0
            for label in reversed(host.split(".")) if host else ():
                node = self.edges.setdefault((node, label), len(self.edges) + 1)
            *whole, tail = path.split("/")
            for segment in whole:
                node = self.edges.setdefault((node, "/" + segment), len(self.edges) + 1)
            self.tails.setdefault(node, {})[tail] = host + path, verdict
        self.lengths = {node: sorted({len(t) for t in tails}, reverse=True) for node, tails in self.tails.items()}

    def _below(self, node: int, segments: list[str]) -> tuple[str, str] | None:
        """Of the host's rules the one of the longest path."""
        best, last = None, len(segments) - 1
        for i, segment in enumerate(segments):
            if node in self.tails:
                tails = self.tails[node]
                best = next((tails[segment[:n]] for n in self.lengths[node] if n <= len(segment) and segment[:n] in tails), best)
            node = self.edges.get((node, "/" + segment), -1) if i < last else -1
            if node < 0:
                break
        return best

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """The rule that decides, as text, and its verdict."""
        segments, node = path.split("/"), 0
        best = self._below(0, segments)
        for label in reversed(host.split(".")) if host else ():
            node = self.edges.get((node, label), -1)
            if node < 0:
                break
            best = self._below(node, segments) or best
        return best


def _by_trie(df: DataFrame, rules: list[tuple[str, str, str]], default: str) -> DataFrame:
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(Trie(rules))
    kind = pa.struct([("rule", pa.string()), ("verdict", pa.string())])

    @F.arrow_udf("rule string, verdict string")
    def decided(host: pa.Array, path: pa.Array) -> pa.Array:
        find = shared.value.find
        found = (find(h, p) or (None, default) for h, p in zip(host.to_pylist(), path.to_pylist()))
        return pa.array([{"rule": r, "verdict": v} for r, v in found], kind)

    return df.withColumn("rule found", decided("host", "path")).withColumn("rule", F.col("`rule found`.rule")).withColumn("verdict", F.col("`rule found`.verdict")).drop("rule found")


def _directory(path: Column) -> Column:
    """Up to the last slash."""
    return F.regexp_extract(path, r"(?s)^(.*/)?", 0)


def _by_joins(df: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same by joins on (host, directory), the trie's nodes: of hosts with their parents that have rules, then of paths with their directories."""
    each = rules.groupBy("rule_host", "rule_path").agg(F.max("rule_verdict").alias("rule_verdict"))  # block comes after allow
    directory = _directory(F.col("rule_path"))
    nodes = each.select("rule_host", directory.alias("directory"), F.struct(F.substring("rule_path", F.length(directory) + 1, F.length("rule_path")).alias("tail"), "rule_verdict").alias("t"))
    nodes = settle(nodes.groupBy("rule_host", F.concat("rule_host", F.lit("/"), "directory").alias("node"), "directory").agg(F.collect_list("t").alias("tails")))
    hosts = df.select("host").distinct()
    labels = F.split("host", r"\.")
    above = F.when(F.col("host") == "", F.array(F.lit(""))).otherwise(
        F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.call_function("substring_index", "host", F.lit("."), -n))))
    fitting = hosts.select("host", F.explode(above).alias("rule_host")).join(nodes.select("rule_host").distinct(), "rule_host")
    urls = df.select("host", "path").distinct()
    of_host = salted_join(urls, fitting.groupBy("host").agg(F.collect_list("rule_host").alias("above")), "host", "path").select("host", "path", F.explode("above").alias("rule_host"))
    parts = F.size(F.split("path", "/"))
    directories = F.concat(F.array(F.lit("")), F.when(parts > 1, F.transform(F.sequence(F.lit(1), parts - 1), lambda n: F.concat(F.call_function("substring_index", "path", F.lit("/"), n), F.lit("/")))).otherwise(F.array().cast("array<string>")))
    at = of_host.select("host", "path", F.explode(F.transform(directories, lambda d: F.concat("rule_host", F.lit("/"), d))).alias("node"))
    met = salted_join(at, nodes, "node", "path")
    rest = F.substring("path", F.length("directory") + 1, F.length("path"))
    fits = F.filter("tails", lambda t: F.startswith(rest, t["tail"]))
    best = F.array_max(F.transform(fits, lambda t: F.struct(
        F.when(F.col("rule_host") == "", 0).otherwise(F.size(F.split("rule_host", r"\."))).alias("labels"), (F.length("directory") + F.length(t["tail"])).alias("n"),
        F.concat("rule_host", "directory", t["tail"]).alias("rule"), t["rule_verdict"].alias("verdict"))))
    found = met.withColumn("best", best).filter("best is not null").groupBy("host", "path").agg(F.max("best").alias("best"))
    decided = found.select(F.col("host").alias("_h"), F.col("path").alias("_p"), F.col("best.rule").alias("rule"), F.col("best.verdict").alias("_v"))
    return df.join(decided, (F.col("host") == F.col("_h")) & (F.col("path") == F.col("_p")), "left").withColumn("verdict", F.coalesce("_v", F.lit(default))).drop("_h", "_p", "_v")


def judge(df: DataFrame, rules: DataFrame, default: str = "allow", url_col: str = "url") -> DataFrame:
    """``df`` with ``host``, ``path``, ``rule`` (the deciding rule's host and path, or null) and ``verdict``; ``rules`` has host, path and verdict."""
    host, path = host_and_path(F.col(f"`{url_col}`"))
    parsed = df.withColumns({"host of url": host, "path of url": path}).drop(*ADDED).withColumnsRenamed({"host of url": "host", "path of url": "path"})
    verdict = F.when(F.col("verdict").isin("allow", "block"), F.col("verdict")).otherwise(F.raise_error(F.lit("a rule allows or blocks")))
    known = rules.select(
        F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), verdict.alias("rule_verdict"))
    size = known.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("rule_host") + F.octet_length("rule_path")).alias("bytes")).first()
    if size["rows"] <= RULES_ROWS and (size["bytes"] or 0) <= RULES_BYTES:
        return _by_trie(parsed, [tuple(r) for r in known.collect()], default)
    return _by_joins(parsed, known, default)
