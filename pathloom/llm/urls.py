"""URL filter: host and path rules, and for the rest a ratio of two character language models, in DataFrame functions only.

URLs that a rule settles are the training text: accepted and rejected ones, one variable-order Markov model each.  A
character is predicted from its longest context of up to ORDER characters that the model has seen, interpolated with each
shorter one by Witten-Bell weights, down to the uniform distribution.  A URL's evidence is the mean over its characters of
the log-likelihood difference (rejected less accepted); the threshold that separates the two training sets with the
fewest errors, each set weighing the same, is the calibration.

Counts are of all rule-settled URLs and combine before the shuffle.  A gram's log-probability is worked out once for each
distinct gram and model, and URLs look their grams up by a join on them, in which grams that most URLs hold are dealt over
tasks.  A URL is walked once, in time linear in its length, and its evidence is summed in whole numbers of 2 ** -UNIT, so that
it does not depend on the order of its terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import column, lower_ascii, saved, spread_join

#: (verdict, host, path): a rule fits its host and all subdomains if the path starts with the rule's; the longest wins.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
ORDER = 4
ALPHABET = 256
#: Bins of the evidence, for the threshold.
BINS, SPAN = 400, 4.0
START = "\x02"
#: Bits after the point in sums of evidence: a character's is below 2 ** 7, so that a URL may have 2 ** 24 of them.
UNIT = 32


def with_parts(pages: DataFrame, url: Column) -> DataFrame:
    """host: after the first :// up to / ? # or the end, A-Z lower-cased; path: then up to ? # or the end."""
    rest = F.when(F.instr("_u", "://") > 0, F.expr("substring(_u, instr(_u, '://') + 3)")).otherwise("")
    pages = pages.withColumn("_u", F.coalesce(url, F.lit(""))).withColumn("_rest", rest)
    host = F.regexp_extract("_rest", r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(F.expr("substring(_rest, length(_host) + 1)"), r"(?s)^[^?#]*", 0)
    return pages.withColumn("_host", host).withColumn("path", path).withColumn("host", lower_ascii(F.col("_host"))).drop("_host", "_rest")


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """(rule as text, its verdict), null where none fits.  Longest: by characters of host and path together, then the host's."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]))):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def _grams(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, gram (context and character, context of ORDER) for each character of the text column."""
    chars = F.regexp_extract_all(F.concat(F.lit(START * ORDER), F.col("text")), F.lit("(?s)."), F.lit(0))
    shifted = [F.slice(chars, F.lit(k + 1), F.char_length("text")).alias(f"c{k}") for k in range(ORDER + 1)]
    rows = df.filter("text <> ''").select(*keys, F.explode(F.arrays_zip(*shifted)).alias("c"))
    return rows.select(*keys, F.concat(*[F.col(f"c.c{k}") for k in range(ORDER + 1)]).alias("gram"))


def _probabilities(wanted: DataFrame, counts: DataFrame) -> DataFrame:
    """(gram, diff) for each wanted gram: log p(rejected) - log p(accepted) of its last character after the others.

    From the shortest context up: p_k = (c(context + char) + types(context) * p_(k-1)) / (c(context) + types(context)),
    and p_(k-1) where the context was never seen.
    """
    out = wanted.select("gram", *[F.lit(1.0 / ALPHABET).alias(f"p{m}") for m in (0, 1)])
    for k in range(ORDER + 1):
        gram = counts.groupBy(F.expr(f"substring(gram, {ORDER - k + 1}, {k + 1})").alias(f"g{k}")).agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
        gram = saved(gram)
        context = gram.groupBy(F.expr(f"substring(g{k}, 1, {k})").alias("h")).agg(*[F.sum(f"c{m}").alias(f"n{m}") for m in (0, 1)], *[F.count_if(F.col(f"c{m}") > 0).alias(f"t{m}") for m in (0, 1)])
        out = out.withColumn(f"g{k}", F.expr(f"substring(gram, {ORDER - k + 1}, {k + 1})")).withColumn("h", F.expr(f"substring(gram, {ORDER - k + 1}, {k})"))
        out = out.join(gram, f"g{k}", "left").join(context, "h", "left")
        p = [F.when(F.col(f"n{m}") > 0, (F.coalesce(f"c{m}", F.lit(0)) + F.col(f"t{m}") * F.col(f"p{m}")) / (F.col(f"n{m}") + F.col(f"t{m}"))).otherwise(F.col(f"p{m}")).alias(f"p{m}") for m in (0, 1)]
        out = out.select("gram", *p)
    return out.select("gram", (F.log("p1") - F.log("p0")).alias("diff"))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple = RULES) -> DataFrame:
    """One row per row of pages: id_col, host, path, rule, verdict.

    Null URLs and those without :// have empty host and path; they are judged by the model, a null one as empty text, and empty text is
    allowed.  Without both accepted and rejected training URLs, what no rule settles is allowed.  A URL of any length is read
    whole.  Equal URLs have equal verdicts; repeated rows and null ids are returned as they are.  Of rules that are equally long
    the one with the longer host wins.  An empty table gives no rows.  Other columns, whatever their names, are neither
    read nor returned.
    """
    base = with_parts(pages.select(column(id_col).alias("_id"), column(url_col).cast("string").alias("url")), F.col("url"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    base = saved(base.select("_id", "host", "path", F.col("_u").alias("text"), rule.alias("rule"), verdict.alias("by_rule")))
    texts = base.groupBy("text", "by_rule").agg(F.count("*").alias("w"))
    y = F.when(F.col("by_rule") == "block", 1).when(F.col("by_rule") == "allow", 0)
    texts = saved(texts.select("text", "w", y.alias("y"), F.monotonically_increasing_id().alias("tid")))
    grams = _grams(texts, ["tid", "y", "w"])
    train = grams.filter("y is not null")
    counts = saved(train.groupBy("gram").agg(F.sum(F.when(F.col("y") == 0, F.col("w")).otherwise(0)).alias("c0"), F.sum(F.when(F.col("y") == 1, F.col("w")).otherwise(0)).alias("c1")))
    uses = saved(grams.groupBy("gram").agg(F.count("*").alias("n")))
    diff = _probabilities(uses.select("gram"), counts).select("gram", F.round(F.col("diff") * 2.0**UNIT).cast("long").alias("d"))
    diff = saved(diff.join(uses, "gram"))
    term = spread_join(grams, diff, ["gram"], "tid").groupBy("tid", "y", "w").agg(F.sum("d").alias("d"), F.count("*").alias("c"))
    evidence = saved(term.select("tid", "y", "w", (F.col("d") / F.col("c") / 2.0**UNIT).alias("e")))
    step = SPAN * 2 / BINS
    bins = evidence.filter("y is not null").groupBy(F.greatest(F.lit(0), F.least(F.lit(BINS), F.floor((F.col("e") + SPAN) / step))).alias("b"))
    rows = {r["b"]: (r["n0"], r["n1"]) for r in bins.agg(F.sum(F.when(F.col("y") == 0, F.col("w")).otherwise(0)).alias("n0"), F.sum(F.when(F.col("y") == 1, F.col("w")).otherwise(0)).alias("n1")).collect()}  # BINS rows
    n0, n1 = (sum(r[m] for r in rows.values()) for m in (0, 1))
    cut = None
    if n0 and n1:
        wrong, options = 1.0, []  # blocked from bin 0 on: all accepted ones are wrong
        for b in range(BINS + 2):
            options.append((round(wrong, 12), abs(b - BINS // 2), b))
            a, r = rows.get(b, (0, 0))
            wrong += r / n1 - a / n0
        cut = min(options)[2] * step - SPAN
    judged = F.when(F.col("e") >= F.lit(cut), "block").otherwise("allow") if cut is not None else F.lit("allow")
    e = evidence.filter("y is null").join(texts.select("tid", F.col("text").alias("_t")), "tid").select("_t", judged.alias("by_model"))
    open_ = base.filter("by_rule is null").join(e, base.text == e._t, "left").select("_id", "host", "path", "rule", F.coalesce("by_model", F.lit("allow")).alias("verdict"))
    settled = base.filter("by_rule is not null").select("_id", "host", "path", "rule", F.col("by_rule").alias("verdict"))
    return settled.unionByName(open_).withColumnRenamed("_id", id_col)
