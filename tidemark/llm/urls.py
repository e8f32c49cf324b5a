"""URL verdicts by rules and by mined token associations (operator 3)."""

from __future__ import annotations

import math
import string
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import salted, stored

BLOCK, ALLOW = "block", "allow"


def parse(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without '://'."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^([^?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def longest_rule(host: Column, path: Column, rules: Sequence[str]) -> Column:
    """The longest rule (host, then path) that fits: its host or a subdomain of it, and a path that begins with its path."""
    if len(rules) > 2000:
        raise ValueError("the rule list is compiled into the plan; join larger ones by host suffix")
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        h, slash, p = rule.partition("/")
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(slash + p))
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: scheme, host labels and their words, the last label and the last two, path segments and their words, query keys, pairs and words of values; numbers are one token."""
    filled = lambda xs: F.filter(xs, lambda x: x != "")
    named = lambda kind, xs: F.transform(xs, lambda x: F.concat(F.lit(kind), F.regexp_replace(x, r"[0-9]+", "0")))
    host_parts = lambda at: F.transform(filled(F.split(host, at)), lambda x: F.concat(F.lit("host:"), x))
    segments = F.split(path, "/")
    words = lambda xs: filled(F.flatten(F.transform(xs, lambda x: F.split(x, r"[^\p{L}\p{N}]+"))))
    found = lambda at: F.regexp_extract_all(url, F.lit(at), F.lit(1))
    all_ = F.concat(
        F.array(F.concat(F.lit("scheme:"), F.lower(F.substring_index(url, "://", 1)))),
        host_parts(r"\."), host_parts(r"[.\-]"), F.array(F.concat(F.lit("domain:"), F.substring_index(host, ".", -2)), F.concat(F.lit("top:"), F.substring_index(host, ".", -1))),
        named("path:", filled(segments)), named("path:", words(segments)),
        named("key:", found(r"[?&]([^=&#?]+)=")), named("pair:", found(r"[?&]([^=&#?]+=[^&#]+)")), named("value:", words(found(r"[?&][^=&#?]+=([^&#]+)"))),
    )
    return F.array_distinct(F.coalesce(all_, F.array().cast("array<string>")))


@dataclass(frozen=True)
class Mined:
    """rules: antecedent (items), confidence, support, lift; items: token, item. Tokens that the same labelled rows hold are one item: a url has it with any of them."""

    rules: DataFrame
    items: DataFrame
    base: float
    looked_at: int


def mine(labelled: DataFrame, *, min_rows: int = 5, min_support: float = 1e-4, min_confidence: float = 0.6, chance: float = 0.05) -> Mined:
    """Rules of token combinations that lead to bad, by FP-growth over the bad rows.

    labelled has tokens and bad (boolean). FP-growth gives the item sets that min_rows bad rows, and min_support of them, hold; items that
    every row has tell nothing and stay out. How many of all labelled rows hold a set is counted by an inverted index on its rarest item. A set is a rule if
    min_confidence of its rows are bad, and so many that with labels dealt at random any set at all would look like this with a probability of at most
    `chance` (Chernoff's bound times the sets looked at), at every number of rows. No rule with some of its items is as confident. Time grows with two to the power of the different frequent items of one url, which urls keep small.
    """
    spark = labelled.sparkSession
    rows = stored(labelled.select("tokens", "bad").withColumn("row", F.monotonically_increasing_id()))
    total, bad = rows.agg(F.count(F.lit(1)), F.count_if("bad")).first()
    none = lambda looked_at=0: Mined(spark.createDataFrame([], "antecedent array<string>, confidence double, support double, lift double"), spark.createDataFrame([], "token string, item string"), bad / total if total else 0.0, looked_at)
    if not bad or bad == total:
        return none()
    least = max(min_rows, math.ceil(min_support * bad))
    each = rows.select("row", "bad", F.explode("tokens").alias("token"))
    same = [F.bit_xor(F.xxhash64("row", F.lit(k))).alias(f"s{k}") for k in (0, 1)]
    known = each.groupBy("token").agg(F.count(F.lit(1)).alias("held"), F.count_if("bad").alias("held_bad"), *same)
    known = stored(known.where((F.col("held_bad") >= least) & (F.col("held") < total)))
    classes = known.groupBy("held", "held_bad", "s0", "s1").agg(F.min("token").alias("item"))
    items = stored(known.join(classes, ["held", "held_bad", "s0", "s1"]).select("token", "item", "held"))
    held_items = F.broadcast(items)  # each is on 1e-4 of the bad rows or more: at most 10,000 times the tokens of a url
    had = stored(each.join(held_items, "token").groupBy("row").agg(F.collect_set("item").alias("items"), F.first("bad").alias("bad")))
    of_bad = had.where("bad").select("items")
    n = of_bad.count()
    if not n:
        return none()
    model = FPGrowth(itemsCol="items", minSupport=max(0.0, (least - 0.5) / n)).fit(of_bad)
    sets = stored(model.freqItemsets.select(F.array_sort("items").alias("items"), F.col("freq").alias("held_bad")))
    looked_at = sets.count()
    base = bad / total
    sizes = items.select("item", "held").distinct()
    rarest = sets.select("items", "held_bad", F.explode("items").alias("item")).join(F.broadcast(sizes), "item").groupBy("items", "held_bad").agg(F.min_by("item", F.struct("held", "item")).alias("item"))
    places = had.select(F.col("items").alias("of"), F.explode("items").alias("item"))
    met = salted(places, "item", rarest, "of", counts=sizes.withColumnRenamed("held", "n"), how="inner", merge=True)  # an item may be on any share of the rows
    held = met.where(F.size(F.array_except("items", "of")) == 0).groupBy("items", "held_bad").agg(F.count(F.lit(1)).alias("held"))
    sure = F.col("held_bad") / F.col("held")
    apart = sure * F.log(sure / base) + F.when(sure < 1, (1 - sure) * F.log((1 - sure) / (1 - base))).otherwise(0.0)
    found = held.where((sure >= min_confidence) & (sure > base) & (F.col("held") * apart >= math.log(max(1, looked_at) / chance)))
    rules = stored(found.select(F.col("items").alias("antecedent"), sure.alias("confidence"), (F.col("held_bad") / total).alias("support"), (sure / base).alias("lift")))
    wide = rules.select("antecedent", "confidence", F.explode("antecedent").alias("p_first"))
    part = rules.select(F.col("antecedent").alias("p_antecedent"), F.col("confidence").alias("p_confidence"), F.col("antecedent")[0].alias("p_first"))
    looser = wide.join(part, "p_first")
    looser = looser.where((F.size("p_antecedent") < F.size("antecedent")) & (F.size(F.array_except("p_antecedent", "antecedent")) == 0) & (F.col("p_confidence") >= F.col("confidence")))
    rules = stored(rules.join(looser.select("antecedent").distinct(), "antecedent", "left_anti"))
    used = rules.select(F.explode("antecedent").alias("item")).distinct()
    return Mined(rules, stored(items.join(used, "item").select("token", "item", "held")), base, looked_at)


def matched(urls: DataFrame, found: Mined) -> DataFrame:
    """url, confidence of the surest rule all of whose items the url has, by an inverted index on each rule's rarest item. Only tokens of rules are joined."""
    sizes = found.items.select("item", "held").distinct()
    index = found.rules.select("antecedent", "confidence", F.explode("antecedent").alias("item")).join(sizes, "item")
    index = index.groupBy("antecedent", "confidence").agg(F.min_by("item", F.struct("held", "item")).alias("item"))
    rows = urls.select("url", F.explode("tokens").alias("token")).join(F.broadcast(found.items.select("token", "item")), "token")  # bounded as in mine()
    rows = rows.groupBy("url").agg(F.collect_set("item").alias("items"))
    rows = salted(rows.select("url", "items", F.explode("items").alias("item")), "item", index, "url", how="inner")
    return rows.where(F.size(F.array_except("antecedent", "items")) == 0).groupBy("url").agg(F.max("confidence").alias("confidence"))


def judge(pages: DataFrame, rules: dict[str, str], labelled: DataFrame, *, id_col: str = "page_id", url_col: str = "url", **mining: float) -> DataFrame:
    """id, host, path, rule, verdict and confidence for every row of pages.

    rules: verdict by rule (at most 2,000); the longest that fits decides. Elsewhere a url is blocked if a mined rule matches it, and allowed otherwise.
    labelled: url and bad (boolean, null rows are left out) to mine from; mining: parameters of mine(). Null urls have empty host and path and are allowed; a very
    long url is judged whole; repeated rows give repeated results; an empty table of pages gives none, an empty one of labels no mined rules; other
    columns of pages are ignored.
    """
    url = F.col("url")
    host, path = parse(url)
    of = lambda df: df.select("*", host.alias("host"), path.alias("path")).select("*", tokens(url, F.col("host"), F.col("path")).alias("tokens"))
    found = mine(of(labelled.where("url is not null and bad is not null").select("url", "bad")).select("tokens", "bad"), **mining)
    rows = pages.select(pages[id_col].alias(id_col), pages[url_col].cast("string").alias("url"))
    if found.rules.isEmpty():
        out = rows.withColumn("confidence", F.lit(None).cast("double"))
    else:
        out = salted(rows, "url", matched(of(rows.where("url is not null").select("url").distinct()), found), id_col)
    rule = longest_rule(F.col("host"), F.col("path"), list(rules))
    names = F.create_map(*[F.lit(x) for kv in rules.items() for x in kv]) if rules else F.create_map().cast("map<string,string>")
    verdict = F.coalesce(F.try_element_at(names, F.col("rule")), F.when(F.col("confidence").isNotNull(), F.lit(BLOCK)).otherwise(F.lit(ALLOW)))
    out = out.select(id_col, host.alias("host"), path.alias("path"), "confidence")
    return out.withColumn("rule", rule).select(id_col, "host", "path", "rule", verdict.alias("verdict"), "confidence")
