"""URL filters: host and path rules, then a tree of path templates per host. Column expressions only."""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.session import cut, small


@dataclass(frozen=True)
class Rule:
    """A verdict for a host, all its subdomains, and paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @classmethod
    def parse(cls, verdict: str, text: str) -> Rule:
        host, slash, path = text.partition("/")
        return cls(verdict, host, slash + path)

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class TemplateRules:
    """Limits of the template tree.

    A node's children are variable if there are ``min_children`` or more and they
    number at least ``variable_share`` of the node's urls. Other children with
    ``min_labels`` or more labels merge with those that are mostly blocked, or
    mostly allowed like them, if their block rate is within ``z`` standard errors
    of that group's. A template's purity is its block rate, smoothed by
    ``prior_weight`` urls of its parent's purity; a host's parent is the overall
    rate. On hosts with ``min_labels`` or more labels, templates whose purity
    reaches ``purity`` are rejected.
    """

    min_children: int = 8
    variable_share: float = 0.3
    min_labels: int = 5
    z: float = 1.96
    prior_weight: float = 2.0
    purity: float = 0.8


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host (A-Z lower-cased) and path of a url; both empty if it is null or lacks ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def longest_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as ``struct<n, blocks, text>``, or null; of equal ones, blocking wins.

    Rules come from the caller as a list, so they are a literal of the plan.
    """
    if not rules:
        return F.lit(None).cast("struct<n:int,blocks:int,text:string>")
    known = F.array(
        *[
            F.struct(
                F.lit(len(r.text)).alias("n"),
                F.lit(int(r.verdict == "block")).alias("blocks"),
                F.lit(r.text).alias("text"),
                F.lit(r.host).alias("host"),
                F.lit(r.path).alias("path"),
            )
            for r in rules
        ]
    )

    def fits(r: Column) -> Column:
        return ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"])

    best = F.array_max(F.transform(F.filter(known, fits), lambda r: F.struct(r["n"], r["blocks"], r["text"])))
    return best.cast("struct<n:int,blocks:int,text:string>")


def shape(path: Column) -> Column:
    """The path's segments, numbers and long hexadecimal names generalised."""
    return F.transform(
        F.split(F.regexp_replace(path, "^/", ""), "/"),
        lambda p: F.when(p.rlike(r"^[0-9]+(\.[A-Za-z]+)?$"), F.regexp_replace(p, "^[0-9]+", "{n}"))
        .when(p.rlike(r"^(?=.*[0-9])[0-9A-Fa-f-]{8,}$"), "{h}")
        .otherwise(p),
    )


def _smoothed(parent: Column, weight: float) -> Column:
    return (F.col("bad") + weight * parent) / (F.col("bad") + F.col("good") + weight)


def _sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in ("n", "bad", "good")]


def reject_templates(shapes: DataFrame, rules: TemplateRules) -> DataFrame:
    """The shapes whose template is rejected: ``(host, shape, purity)``.

    ``shapes`` has one row ``(host, shape, n, bad, good)`` per host and shape. The
    tree grows level by level, as deep as labels differ below a node: where all
    agree, nothing further down could, and the node is a template. At each level
    the children of every open node are counted; variable ones become ``*``,
    statistically alike ones merge, the others stay. Branches without labels keep
    their parent's purity. Only sums per child and per node are shuffled, so that
    a host with a third of all pages is no hot key.
    """
    overall = shapes.agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).first()
    prior = (overall["bad"] or 0) / max(1, (overall["bad"] or 0) + (overall["good"] or 0))
    weight, labels = rules.prior_weight, F.col("bad") + F.col("good")
    hosts = shapes.groupBy("host").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).where(labels >= rules.min_labels)
    hosts = cut(hosts.select("host", _smoothed(F.lit(prior), weight).alias("purity"), ((F.col("bad") > 0) & (F.col("good") > 0)).alias("open")))
    tree = cut(shapes.join(small(hosts), "host").withColumn("node", F.lit("")))
    depth, closed = 0, tree.where("not open")
    growing = tree.where("open")
    while not growing.isEmpty():
        end = F.lit("$")
        at = growing.withColumn("kid", F.coalesce(F.concat(F.lit("="), F.get("shape", F.lit(depth))), end))
        kids = cut(at.groupBy("host", "node", "purity", "kid").agg(*_sums()))
        inner = kids.where("kid <> '$'")
        nodes = inner.groupBy("host", "node").agg(F.count("*").alias("kids"), F.sum("n").alias("all_n"))
        variable = (F.col("kids") >= rules.min_children) & (F.col("kids") >= rules.variable_share * F.col("all_n"))
        spread = nodes.where(variable).select("host", "node", F.lit(True).alias("variable"))
        kids = kids.join(spread, ["host", "node"], "left").withColumn("side", F.col("bad") / F.nullif(labels, F.lit(0)) >= 0.5)
        sided = kids.where((labels >= rules.min_labels) & F.col("variable").isNull() & (F.col("kid") != "$"))
        groups = sided.groupBy("host", "node", "side").agg(F.sum("bad").alias("all_bad"), F.sum(labels).alias("all"))
        rate, own = F.col("all_bad") / F.col("all"), F.col("bad") / F.nullif(labels, F.lit(0))
        alike = (labels >= rules.min_labels) & (F.abs(own - rate) <= rules.z * F.sqrt(rate * (1 - rate) / labels) + 1e-12)
        name = F.when(F.col("kid") == "$", "$").when(F.col("variable"), "*").when(alike, F.when(F.col("side"), "+b").otherwise("+g")).otherwise(F.col("kid"))
        named = cut(kids.join(groups, ["host", "node", "side"], "left").withColumn("name", name))
        below = named.groupBy("host", "node", "purity", "name").agg(*_sums())
        mixed = (F.col("bad") > 0) & (F.col("good") > 0) & (F.col("name") != "$")
        below = below.select("host", "node", "name", _smoothed(F.col("purity"), weight).alias("after"), mixed.alias("still"))
        step = named.select("host", "node", "kid", "name").join(below, ["host", "node", "name"])
        moved = at.drop("purity", "open").join(step, ["host", "node", "kid"])
        moved = cut(
            moved.select(
                "host", "shape", "n", "bad", "good", F.col("after").alias("purity"), F.col("still").alias("open"), F.concat("node", F.lit("/"), "name").alias("node")
            )
        )
        closed = closed.unionByName(moved.where("not open"))
        growing, depth = moved.where("open"), depth + 1
    return closed.where(F.col("purity") >= rules.purity).select("host", "shape", "purity")


def filter_urls(
    pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", limits: TemplateRules | None = None
) -> DataFrame:
    """A verdict for every row of ``pages``.

    Returns ``(id, host, path, rule, verdict, purity)``. The longest fitting rule
    decides; ``rule`` is its text. Urls that rules decide are the labelled ones.
    Others are blocked if their template on their host is rejected, with its
    smoothed block rate as ``purity``, and allowed otherwise. Paths are judged
    whole, however deep.

    Null urls and urls without ``://`` have an empty host and path, fit no rule and
    no template, and are allowed. Null ids and repeated rows pass through; repeats
    count in the templates. Other columns are ignored. Empty tables give empty
    results.
    """
    limits = limits or TemplateRules()
    host, path = host_and_path(F.col("url"))
    source = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"))
    parsed = source.select("id", host.alias("host"), path.alias("path")).withColumn("hit", longest_rule(F.col("host"), F.col("path"), rules))
    parsed = parsed.withColumn("shape", shape(F.col("path")))
    shapes = parsed.where("host <> ''").groupBy("host", "shape").agg(
        F.count("*").alias("n"),
        F.sum(F.when(F.col("hit.blocks") == 1, 1).otherwise(0)).alias("bad"),
        F.sum(F.when(F.col("hit.blocks") == 0, 1).otherwise(0)).alias("good"),
    )
    judged = parsed.join(reject_templates(shapes, limits), ["host", "shape"], "left")
    verdict = F.when(F.col("hit").isNotNull(), F.when(F.col("hit.blocks") == 1, "block").otherwise("allow")).otherwise(
        F.when(F.col("purity").isNotNull(), "block").otherwise("allow")
    )
    return judged.select(
        F.col("id").alias(id_col),
        "host",
        "path",
        F.col("hit.text").alias("rule"),
        verdict.alias("verdict"),
        F.when(F.col("hit").isNull(), F.col("purity")).alias("purity"),
    )
