"""URL filters by association rules.

Pages that a listed rule decides are labelled rows.  FP-growth mines token combinations of
their URLs together with the label; rules `tokens -> label` are pruned by support, confidence
and redundancy.  Pages that no listed rule decides are judged by the mined rules: each rule is
indexed under its rarest token, a URL meets it in an equi-join on that token, and applies it if
it has all its tokens.  DataFrame and SQL functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.store import store

#: (verdict, rule); a rule is a host, which stands for its subdomains too, and the beginning of a path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
SUPPORT, CONFIDENCE, FEWEST = 0.002, 0.95, 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (lower case) and path; both empty for a null URL or one without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def listed_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest listed rule that fits, or nulls.  The list is a parameter of bounded size."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own, _, rest = text.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(f"/{rest}")
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, decision).otherwise(verdict)
    return rule, verdict


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: words of the host, its last label, path segments and query keys, without numbers."""
    labels = F.split(host, r"\.")
    words = F.transform(F.filter(F.flatten(F.transform(F.slice(labels, 1, F.greatest(F.size(labels) - 1, F.lit(0))), lambda x: F.split(x, r"[-_]"))), lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x))
    last = F.array(F.concat(F.lit("t:"), F.element_at(labels, -1)))
    segments = F.transform(F.filter(F.split(F.regexp_replace(path, r"[0-9]+", ""), r"[/._-]+"), lambda x: x != ""), lambda x: F.concat(F.lit("p:"), x))
    keys = F.transform(F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([^=&#]+)"), F.lit(1)), lambda x: F.concat(F.lit("q:"), x))
    return F.sort_array(F.array_distinct(F.concat(words, last, segments, keys)))


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, fewest: int = FEWEST) -> DataFrame:
    """Rules (tokens, verdict, confidence, support, key) from rows (tokens, verdict).

    A rule needs the share `support` of the labelled rows, and `fewest` rows in any case.  It
    goes if one with fewer of its tokens has the same verdict and at least its
    confidence; the key is the token that fewest labelled rows have.
    """
    baskets = labelled.select(F.array_distinct(F.concat("tokens", F.array(F.concat(F.lit("="), F.col("verdict"))))).alias("items"))
    least = min(1.0, max(support, fewest / max(1, labelled.count())))
    model = FPGrowth(itemsCol="items", minSupport=least, minConfidence=confidence).fit(baskets)
    found = model.associationRules.where("size(filter(consequent, x -> x LIKE '=%')) = 1 AND size(filter(antecedent, x -> x LIKE '=%')) = 0")
    found = store(found.select(F.sort_array("antecedent").alias("tokens"), F.substring(F.element_at("consequent", 1), 2, 100).alias("verdict"), "confidence", "support"), "rules")
    small = found.select(F.col("tokens").alias("s"), F.col("verdict").alias("v"), F.col("confidence").alias("c"))
    each = found.select("tokens", "verdict", "confidence", F.explode("tokens").alias("token"))
    shorter = each.join(small.select("s", "v", "c", F.explode("s").alias("token")), "token").where("v = verdict AND c >= confidence AND size(s) < size(tokens) AND size(array_except(s, tokens)) = 0")
    found = found.join(shorter.select("tokens", "verdict").distinct(), ["tokens", "verdict"], "left_anti")
    counts = model.freqItemsets.where("size(items) = 1").select(F.element_at("items", 1).alias("token"), "freq")
    rarest = found.select("tokens", "verdict", F.explode("tokens").alias("token")).join(counts, "token").groupBy("tokens", "verdict").agg(F.min_by("token", F.struct("freq", "token")).alias("key"))
    return found.join(rarest, ["tokens", "verdict"])


def judge_urls(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", rules: Sequence[tuple[str, str]] = RULES, labels: DataFrame | None = None,
               support: float = SUPPORT, confidence: float = CONFIDENCE, otherwise: str = "allow") -> DataFrame:
    """One row per row of `pages`: host, path, the listed rule or null, and the verdict.

    `labels` (url, verdict) trains the mined rules; without it the pages do that a listed rule
    decides.  Of the mined rules that apply, the one with most confidence, then support, then
    tokens decides; `block` before `allow` on a tie; `otherwise` if none applies.  A null or
    odd URL has an empty host and path, no listed rule, and is judged by its tokens.  Repeated
    rows are kept, an empty table gives none, other columns are ignored.
    """
    url = F.col("_url")
    host, path = host_and_path(url)
    base = pages.select(F.col(id_column).alias("_id"), F.col(url_column).cast("string").alias("_url")).withColumn("host", host).withColumn("path", path)
    rule, verdict = listed_rule(F.col("host"), F.col("path"), rules)
    base = base.withColumn("rule", rule).withColumn("listed", verdict).withColumn("tokens", url_tokens(url, F.col("host"), F.col("path")))
    if labels is None:
        labelled = base.where("listed IS NOT NULL").select("tokens", F.col("listed").alias("verdict"))
    else:
        known = labels.where("verdict IS NOT NULL").select(F.col("url").cast("string").alias("_url"), "verdict")
        host, path = host_and_path(url)
        known = known.withColumn("host", host).withColumn("path", path)
        labelled = known.select(url_tokens(url, F.col("host"), F.col("path")).alias("tokens"), "verdict")
    learned = mine(labelled, support, confidence)
    kinds = base.where("listed IS NULL").select("tokens").distinct()
    meets = kinds.select("tokens", F.explode("tokens").alias("key")).join(learned.withColumnRenamed("tokens", "needs").withColumnRenamed("verdict", "mined"), "key").where("size(array_except(needs, tokens)) = 0")
    best = meets.groupBy("tokens").agg(F.max_by("mined", F.struct("confidence", "support", F.size("needs"), "mined")).alias("mined"))
    best = store(best, "verdicts")
    out = base.join(best, "tokens", "left")
    return out.select(F.col("_id").alias(id_column), "host", "path", "rule", F.coalesce("listed", "mined", F.lit(otherwise)).alias("verdict"))
