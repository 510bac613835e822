"""URL filtering by listed rules and, where none fits, by mined association rules.

A URL is a set of tokens: the labels of its host, the words of its path and the
names in its query, each marked with where it stands. Spark's FP-growth mines
the token combinations of labelled URLs; a combination becomes a rule if enough
URLs have it together with the label and if its confidence is high, and is
dropped where a part of it has a rule as confident. Rules are matched through
an inverted index: each stands under its rarest token alone, a URL looks up its
tokens there, and what it finds is compared in full.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from .shared import materialize

ALLOW, BLOCK = "allow", "block"
#: Share of the labelled URLs that have a rule's tokens and its label.
SUPPORT = 0.01
#: Share of the URLs with a rule's tokens that have its label.
CONFIDENCE = 0.8
#: Tokens of a rule at most.
TOKENS = 3

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?"
_WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def lowered(text: Column) -> Column:
    """A-Z lowered, and nothing else."""
    return F.translate(text, _UPPER, _LOWER)


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next of / ? # or the end, A-Z lowered; empty without ://."""
    return lowered(F.coalesce(F.regexp_extract(url, _SPLIT, 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ? or # or the end."""
    return F.coalesce(F.regexp_extract(url, _SPLIT, 2), F.lit(""))


def url_tokens(url: Column) -> Column:
    """Distinct tokens: h: labels of the host, p: words of the path, q: names in the query, A-Z lowered."""
    words = lambda text: F.regexp_extract_all(lowered(text), F.lit(_WORDS), F.lit(0))
    host = F.filter(F.split(host_of(url), r"\.", -1), lambda x: x != "")
    names = F.regexp_extract_all(F.coalesce(F.regexp_extract(url, _SPLIT, 3), F.lit("")), F.lit("(?:^|&)([^&=]+)"), F.lit(1))
    marked = lambda kind, found: F.transform(found, lambda x: F.concat(F.lit(f"{kind}:"), x))
    return F.array_distinct(F.concat(marked("h", host), marked("p", words(path_of(url))), marked("q", F.transform(names, lowered))))


def listed(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest of the rules (verdict, host, path) that fits: the host or a subdomain of it, and a path that starts with the rule's; a struct (verdict, rule), null if none fits.

    Of rules that are equally long, the first one given. The list is short: it
    becomes one expression.
    """
    out = None
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == rule_host) | F.endswith(host, F.lit(f".{rule_host}"))) & F.startswith(path, F.lit(rule_path))
        told = F.struct(F.lit(verdict).alias("verdict"), F.lit(rule_host + rule_path).alias("rule"))
        out = F.when(fits, told) if out is None else out.when(fits, told)
    return F.lit(None).cast("struct<verdict: string, rule: string>") if out is None else out


def mine_rules(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, tokens: int = TOKENS) -> DataFrame:
    """(antecedent: sorted tokens, verdict, n, confidence, pivot) mined from labelled URLs (tokens, label: allow or block).

    n counts the URLs that have the tokens and the label. A rule has a count of
    support * URLs or more, a confidence or more, and up to `tokens` tokens; it
    is dropped if a part of its tokens has a rule of the same verdict and no
    less confidence. pivot is the rarest of its tokens. Rows with a null label or null
    tokens are left out; nothing labelled gives no rules.
    """
    spark = labelled.sparkSession
    empty = spark.sql("select cast(null as array<string>) antecedent, '' verdict, 0l n, 0d confidence, '' pivot where false")
    verdict = F.concat(F.lit("="), F.col("label"))
    baskets = materialize(labelled.where("label is not null and tokens is not null").select(F.concat("tokens", F.array(verdict)).alias("items")), "baskets")
    if baskets.isEmpty():
        return empty
    sets = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets).freqItemsets
    labels = [f"={ALLOW}", f"={BLOCK}"]
    own = F.filter("items", lambda x: ~x.isin(labels))
    sets = sets.select(F.array_sort(own).alias("antecedent"), F.get(F.array_except("items", own), F.lit(0)).alias("label"), "freq")
    sets = materialize(sets.where(F.size("antecedent").between(1, tokens)), "itemsets")
    whole = sets.where("label is null").select("antecedent", F.col("freq").alias("of"))
    rules = sets.where("label is not null").join(whole, "antecedent").withColumn("confidence", F.col("freq") / F.col("of")).where(F.col("confidence") >= confidence)
    rules = rules.select("antecedent", F.substring("label", 2, 10).alias("verdict"), F.col("freq").alias("n"), "confidence")
    # All proper parts of up to `tokens` tokens, by place.
    parts = [F.when(F.size("antecedent") > max(c), F.array(*(F.get("antecedent", F.lit(i)) for i in c))) for size in range(1, tokens) for c in combinations(range(tokens), size)]
    if parts:
        rules = materialize(rules, "rules")
        part = rules.withColumn("part", F.explode(F.array(*parts))).where(F.size("part") < F.size("antecedent")).select("part", "antecedent", "verdict", F.col("confidence").alias("whole"))
        surer = rules.select(F.col("antecedent").alias("part"), "verdict", "confidence")
        rules = rules.join(part.join(surer, ["part", "verdict"]).where("confidence >= whole").select("antecedent", "verdict"), ["antecedent", "verdict"], "left_anti")
    single = whole.where(F.size("antecedent") == 1).select(F.col("antecedent")[0].alias("token"), "of")
    each = rules.withColumn("token", F.explode("antecedent")).join(single, "token")
    return each.groupBy("antecedent", "verdict", "n", "confidence").agg(F.min(F.struct("of", "token"))["token"].alias("pivot"))


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(row, mined: the surest rule that fits) of URLs (row, tokens) that a rule fits: by confidence, then count, then fewer tokens, then tokens in order; block before allow."""
    index = rules.select(F.col("pivot").alias("token"), "antecedent", "verdict", "n", "confidence")
    # A rule's tokens are all among the URL's: the pivot leads to it, the rest is compared.
    met = urls.withColumn("token", F.explode("tokens")).join(index, "token").where(F.size(F.array_except("antecedent", "tokens")) == 0)
    rank = F.struct((-F.col("confidence")).alias("c"), (-F.col("n")).alias("m"), F.size("antecedent").alias("s"), F.array_join("antecedent", " ").alias("mined_rule"), (F.col("verdict") == ALLOW).alias("a"), F.col("verdict"), F.col("confidence"))
    return met.groupBy("row").agg(F.min(rank).alias("mined"))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], labelled: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", support: float = SUPPORT, confidence: float = CONFIDENCE, tokens: int = TOKENS) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, mined_rule, confidence.

    The longest listed rule (verdict, host, path) that fits decides; where none
    does, the surest mined rule; where none of those fits either, the URL is
    allowed. Mined rules come from `labelled` (url, label: allow or block); by
    default from the pages on which a listed rule decides, so that the list's
    verdicts are carried over to URLs that it doesn't know. rule is null unless
    a listed rule decided, mined_rule and confidence unless a mined one did.

    A null URL, or one without ://, has an empty host and path and no tokens: it
    is allowed. URLs of any length are read whole; repeated rows and null ids
    are rows like others; ties are settled as `matched` states. Other columns
    are ignored, so their names cannot clash. An empty table gives an empty
    result.
    """
    url = F.col("url")
    judged = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.monotonically_increasing_id().alias("row"))
    judged = judged.withColumns({"host": host_of(url), "path": path_of(url), "tokens": url_tokens(url)}).drop("url")
    judged = materialize(judged.withColumn("fit", listed(F.col("host"), F.col("path"), rules)), "judged-urls")
    if labelled is None:
        known = judged.where("fit is not null").select("tokens", F.col("fit.verdict").alias("label"))
    else:
        known = labelled.select(url_tokens(url).alias("tokens"), "label")
    mined = materialize(mine_rules(known, support, confidence, tokens), "mined-rules")
    found = matched(judged.where("fit is null").select("row", "tokens"), mined)
    verdict = F.coalesce("fit.verdict", "mined.verdict", F.lit(ALLOW)).alias("verdict")
    return judged.join(found, "row", "left").select("id", "host", "path", F.col("fit.rule").alias("rule"), verdict, F.col("mined.mined_rule").alias("mined_rule"), F.col("mined.confidence").alias("confidence"))
