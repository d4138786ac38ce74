"""URL filters: rules by host and path, and gradient-boosted trees for the rest, in DataFrame code only.

Host and path come from the text of the URL.  The longest rule that fits decides;
URLs that a rule decides are the labelled ones.  The trees learn from them lexical
features, each in a few fixed bins: length, path depth, digit ratio, entropy,
number of parameters, and how much is blocked among the labelled URLs with
the same last label and the same last two labels of the host.  These two statistics
say what rules say, and rules are few: each rule counts once, the share of all
rules' URLs is one rule more, a labelled URL's statistics come from the hosts of the other fold
only, and only every third tree may use them.

All labelled URLs are used: they are first summed into cells of equal bins (there
are at most as many cells as combinations of bins, whatever the table's size), and
each level of each tree is one small aggregation over the cells.

Defined results: a null URL, or one without `://`, has an empty host and path, and
gets the trees' verdict on its features like any other; without a labelled URL of both
kinds the verdict is the majority's, or allow.  Ties between splits go to the first
feature and lowest bin.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm.shared import ASCII_LOWER, ASCII_UPPER, cut

BLOCK, ALLOW = "block", "allow"
#: rule -> verdict: a host (with its subdomains), then the start of the path
RULES = {"net/": BLOCK, "example.net/en/": ALLOW, "example.com/de/": BLOCK, "org/fr/": ALLOW}
#: Upper edges of the bins of each feature; the last bin is open.
EDGES = {
    "length": [20, 30, 40, 50, 60, 80, 120],
    "depth": [0, 1, 2, 3, 4, 6],
    "digits": [0.0, 0.05, 0.1, 0.15, 0.2, 0.3],
    "entropy": [3.0, 3.5, 3.75, 4.0, 4.25, 4.5],
    "parameters": [0, 1, 2, 4],
    "suffix": [0.05, 0.2, 0.4, 0.6, 0.8, 0.95],
    "domain": [0.05, 0.2, 0.4, 0.6, 0.8, 0.95],
}
TREES, DEPTH, RATE, RIDGE = 12, 3, 0.4, 1.0
#: Features that rest on the rules themselves, and how often a tree may use them.
STATED, STATED_EVERY = ("suffix", "domain"), 3


def parsed(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return F.translate(host, ASCII_UPPER, ASCII_LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits, or null."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def entropy(text: Column) -> Column:
    """Bits per character."""
    n = F.length(text).cast("double")
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    bits = F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), lambda a, c: a + F.when(c == "", 0.0).otherwise(-share(c) * F.log2(share(c))))
    return F.when(F.length(text) > 0, bits).otherwise(0.0)


def binned(value: Column, edges: list) -> Column:
    out = F.lit(len(edges))
    for i in range(len(edges) - 1, -1, -1):
        out = F.when(value <= F.lit(float(edges[i])), F.lit(i)).otherwise(out)
    return out.cast("int")


def with_features(urls: DataFrame) -> DataFrame:
    """Add `_bins` of what the text alone gives, `_suffix` and `_domain` to urls with url, host, path."""
    u = F.coalesce("url", F.lit(""))
    query = F.regexp_extract(u, "\\?([^#]*)", 1)
    values = {
        "length": F.length(u),
        "depth": F.size(F.filter(F.split("path", "/"), lambda p: p != "")),
        "digits": F.length(F.regexp_replace(u, "[^0-9]", "")) / F.greatest(F.lit(1), F.length(u)),
        "entropy": entropy(u),
        "parameters": F.size(F.filter(F.split(query, "&"), lambda p: p != "")),
    }
    labels = F.split("host", "\\.")
    return urls.withColumns({f"_{k}_bin": binned(v, EDGES[k]) for k, v in values.items()} | {"_suffix": F.element_at(labels, -1), "_domain": F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 1), 2), ".")})


class BoostedTrees:
    """Trees over binned features, as column expressions; fit() learns them by aggregations over cells (bins, n, blocked)."""

    def __init__(self, features: list[str], trees: int = TREES, depth: int = DEPTH, rate: float = RATE, ridge: float = RIDGE):
        self.features, self.trees, self.depth, self.rate, self.ridge = features, trees, depth, rate, ridge
        self.base, self.grown = 0.0, []

    def margin(self) -> Column:
        """Log odds of block."""
        out = F.lit(self.base)
        for root in self.grown:
            out = out + self._value(root)
        return out

    def _value(self, node) -> Column:
        if not isinstance(node, tuple):
            return F.lit(float(node))
        feature, b, low, high = node
        return F.when(F.col(f"_{feature}_bin") <= b, self._value(low)).otherwise(self._value(high))

    def fit(self, cells: DataFrame) -> BoostedTrees:
        n, blocked = cells.agg(F.sum("n"), F.sum("blocked")).first()
        if not n:
            self.base = -1.0
            return self
        self.base = math.log((blocked + 0.5) / (n - blocked + 0.5))
        if not 0 < blocked < n:
            return self
        for k in range(self.trees):
            self.grown.append(self._tree(cells, [f for f in self.features if f not in STATED or k % STATED_EVERY == 0]))
        return self

    def _tree(self, cells: DataFrame, features: list[str]):
        p = 1.0 / (1.0 + F.exp(-self.margin()))
        g = cells.withColumn("_g", F.col("blocked") - F.col("n") * p).withColumn("_h", F.col("n") * p * (1 - p))
        splits: dict[int, tuple[str, int]] = {}
        sums: dict[int, tuple[float, float]] = {}
        level = [1]
        for _ in range(self.depth):
            node = F.lit(1)
            for k in sorted(splits):
                f, b = splits[k]
                node = F.when(node == k, F.when(F.col(f"_{f}_bin") <= b, 2 * k).otherwise(2 * k + 1)).otherwise(node)
            bins = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"_{f}_bin").alias("b")) for f in features])).alias("_x")
            found = g.select(node.alias("_node"), "_g", "_h", bins).filter(F.col("_node").isin(level)).groupBy("_node", "_x.f", "_x.b").agg(F.sum("_g").alias("g"), F.sum("_h").alias("h")).collect()
            following = []
            for k in level:
                best = self._best([r for r in found if r["_node"] == k])
                if best is None:
                    continue
                f, b, low, high = best
                splits[k] = f, b
                sums[2 * k], sums[2 * k + 1] = low, high
                following += [2 * k, 2 * k + 1]
            level = following
            if not level:
                break

        def build(k: int):
            if k in splits:
                f, b = splits[k]
                return f, b, build(2 * k), build(2 * k + 1)
            a, h = sums.get(k, (0.0, 0.0))
            return self.rate * a / (h + self.ridge)

        return build(1)

    def _best(self, rows):
        """The split of a node with the largest gain, or None."""
        worth = lambda a, h: a * a / (h + self.ridge)
        best, gained = None, 1e-6
        for f in self.features:
            own = {r["b"]: (r["g"], r["h"]) for r in rows if r["f"] == f}
            total = tuple(map(sum, zip(*own.values(), strict=True))) if own else (0.0, 0.0)
            a = h = 0.0
            for b in sorted(own)[:-1]:
                a, h = a + own[b][0], h + own[b][1]
                rest = total[0] - a, total[1] - h
                gain = worth(a, h) + worth(*rest) - worth(*total)
                if gain > gained * (1 + 1e-9):
                    best, gained = (f, b, (a, h), rest), gain
        return best


#: Not a fold: statistics of all labelled URLs.
ALL = -1


def fold(host: Column) -> Column:
    return (F.crc32(host.cast("binary")) % 2).cast("int")


def stated_rates(labelled: DataFrame, key: str) -> tuple[DataFrame, float]:
    """(key, _fold, _rate): what rules say of a value of key, for those of a fold by the URLs of the other fold, for ALL by all; and the rate of all rules.

    A rule counts as the share of its own URLs that are blocked, 0 or 1.
    """
    rules = cut(labelled.withColumn("_for", F.explode(F.array(1 - F.col("_fold"), F.lit(ALL)))).groupBy(key, "_for", "rule").agg(F.avg("_y").alias("share")), "url-rules")
    prior = rules.filter(F.col("_for") == ALL).groupBy("rule").agg(F.avg("share").alias("share")).agg(F.avg("share")).first()[0]
    prior = 0.5 if prior is None else prior
    return rules.groupBy(key, F.col("_for").alias("_fold")).agg(((F.sum("share") + prior) / (F.count(F.lit(1)) + 1.0)).alias("_rate")), prior


def judge(pages: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    """One row for each row of pages (page_id, url): page_id, host, path, rule, verdict, block_score (the trees' probability of block)."""
    rules = RULES if rules is None else rules
    host, path = parsed(F.col("url"))
    p = pages.select("page_id", "url", host.alias("host"), path.alias("path")).withColumn("rule", matched_rule(F.col("host"), F.col("path"), rules))
    verdicts = F.create_map(*[F.lit(x) for r in rules.items() for x in r]) if rules else F.create_map().cast("map<string,string>")
    p = p.withColumn("_ruled", F.when(F.col("rule").isNotNull(), F.element_at(verdicts, F.col("rule"))))
    d = cut(with_features(p).withColumn("_fold", F.when(F.col("_ruled").isNotNull(), fold(F.col("host"))).otherwise(ALL)).drop("url"), "url-features")
    labelled = d.filter(F.col("_ruled").isNotNull()).withColumn("_y", F.when(F.col("_ruled") == BLOCK, 1).otherwise(0))
    for key in STATED:
        rates, prior = stated_rates(labelled, f"_{key}")
        d = d.join(rates, [f"_{key}", "_fold"], "left").withColumn(f"_{key}_bin", binned(F.coalesce("_rate", F.lit(prior)), EDGES[key])).drop("_rate")
    labelled = d.filter(F.col("_ruled").isNotNull()).withColumn("_y", F.when(F.col("_ruled") == BLOCK, 1).otherwise(0))
    bins = [f"_{f}_bin" for f in EDGES]
    cells = cut(labelled.groupBy(*bins).agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("blocked")), "url-cells")
    model = BoostedTrees(list(EDGES)).fit(cells)
    score = 1.0 / (1.0 + F.exp(-model.margin()))
    d = d.withColumn("block_score", score)
    return d.select("page_id", "host", "path", "rule", F.coalesce("_ruled", F.when(F.col("block_score") > 0.5, F.lit(BLOCK)).otherwise(F.lit(ALLOW))).alias("verdict"), "block_score")
