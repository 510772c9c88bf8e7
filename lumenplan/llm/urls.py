"""URL filter: host and path rules, and a character language-model ratio for the rest.

URLs that a rule decides are the accepted and rejected examples.  Two character models of variable
order are estimated from them: Witten-Bell smoothing takes each order's estimate back to the next
shorter context, down to equal chances, and a context never seen is passed over.  A URL's score is
the mean over its characters of the log-likelihood difference; a threshold calibrated on examples
left out of the models decides.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch
from .hot import join_keys

ALLOW, BLOCK = "allow", "block"

#: (verdict, rule); a rule is a host and a path.
RULES = ((BLOCK, "net/"), (ALLOW, "example.net/en/"), (BLOCK, "example.com/de/"), (ALLOW, "org/fr/"))
#: Rules up to which they are one expression; more are a table that is joined with the hosts' parent domains.
INLINE_RULES = 200
#: Characters of a gram: the predicted one and its context.
ORDER = 4
#: Characters that are equally likely before anything is known.
ALPHABET = 256
#: Grams up to which their table is broadcast; beyond it only the most frequent ones are, and the rest is shuffled.
BROADCAST_GRAMS = 300_000
#: Scores are put into so many classes a unit, between minus and plus LIMIT, to calibrate.
CLASSES, LIMIT = 50, 8


def parse(df: DataFrame, url: str = "url") -> DataFrame:
    """Add ``host``, with A-Z lower-cased, and ``path``, in place of columns of these names.

    Both are empty for null and for a URL without ``://``.
    """
    rest = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), "(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*+)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return df.withColumn("host", host).withColumn("path", F.regexp_extract(rest, "^[^/?#]*+([^?#]*+)", 1))


def apply_rules(df: DataFrame, rules=RULES) -> DataFrame:
    """Add ``rule`` and ``ruled``: the longest rule for the host or a parent domain and its verdict, else null.

    Of equally long rules the first in the alphabet counts.  Any number of rules may be given.
    """
    if len(rules) > INLINE_RULES:
        return _join_rules(df, rules)
    rule = verdict = None
    host, path = F.col("host"), F.col("path")
    for value, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        domain, slash, start = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + start)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, value) if verdict is None else verdict.when(fits, value)
    none = F.lit(None).cast("string")
    return df.withColumn("rule", none if rule is None else rule).withColumn("ruled", none if verdict is None else verdict)


def _join_rules(df: DataFrame, rules) -> DataFrame:
    """``apply_rules`` by a join: every different host and path meets the rules of the host's parent domains."""
    spark = df.sparkSession
    parts = [(text.partition("/")[0], "/" + text.partition("/")[2] if "/" in text else "", text, value) for value, text in rules]
    table = spark.createDataFrame(parts, "domain string, start string, rule string, ruled string")
    places = df.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    best = F.min(F.struct((-F.length("rule")).alias("l"), "rule", "ruled")).alias("best")
    found = (
        places.withColumn("domain", F.explode(parents)).join(F.broadcast(table), "domain").where(F.col("path").startswith(F.col("start"))).groupBy("host", "path").agg(best)
    )
    return df.join(found, ["host", "path"], "left").withColumns({"rule": F.col("best.rule"), "ruled": F.col("best.ruled")}).drop("best")


def _grams(url: str) -> Column:
    padded = F.concat(F.lit("\u0002" * (ORDER - 1)), F.col(url), F.lit("\u0003"))
    return F.regexp_extract_all(padded, F.lit(f"(?s)(?=(.{{{ORDER}}}))"), F.lit(1))


def _witten_bell(level: DataFrame, shorter: DataFrame | None, order: int) -> DataFrame:
    """Probabilities of both models at one order, from counts ``(gram, a, b)`` and the shorter grams' probabilities."""
    sums = [f(n).alias(n + s) for n in ("a", "b") for f, s in ((F.sum, "n"), (lambda c: F.count_if(F.col(c) > 0), "t"))]
    if order > 1:
        rows = level.withColumn("context", F.substring("gram", 1, order - 1))
        rows = rows.join(rows.groupBy("context").agg(*sums), "context")
    else:
        total = level.agg(*sums).first()
        rows = level.withColumns({k: F.lit(v or 0) for k, v in total.asDict().items()})
    if shorter is None:
        rows = rows.withColumn("qa", F.lit(1.0 / ALPHABET)).withColumn("qb", F.lit(1.0 / ALPHABET))
    else:
        low = shorter.select(F.col("gram").alias("tail"), F.col("pa").alias("qa"), F.col("pb").alias("qb"))
        rows = rows.withColumn("tail", F.substring("gram", 2, order - 1)).join(low, "tail")
    p = lambda n, q: F.when(F.col(n + "n") + F.col(n + "t") == 0, F.col(q)).otherwise(
        (F.col(n) + F.col(n + "t") * F.col(q)) / F.greatest(F.col(n + "n") + F.col(n + "t"), F.lit(1))
    )
    return rows.select("gram", p("a", "qa").alias("pa"), p("b", "qb").alias("pb"))


def fit(urls: DataFrame) -> DataFrame:
    """Log-likelihood difference ``ratio`` of every ``gram`` that occurs in any URL, and its places ``n`` in different URLs.

    ``urls`` has url, ruled and the number ``n`` of rows; rows where ``learn`` is true count.
    """
    counted = lambda v: F.sum(F.when(F.col("learn") & (F.col("ruled") == v), F.col("n")).otherwise(0))
    longest = (
        urls.select("ruled", "learn", "n", F.explode(_grams("url")).alias("gram"))
        .groupBy("gram")
        .agg(counted(ALLOW).alias("a"), counted(BLOCK).alias("b"), F.count("*").alias("places"))
    )
    level = scratch.save(longest, "grams")
    tables = {ORDER: level}
    for order in range(ORDER - 1, 0, -1):
        tables[order] = (
            tables[order + 1].groupBy(F.substring("gram", 2, order).alias("gram")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        )
    known = None
    for order in range(1, ORDER + 1):
        known = _witten_bell(tables[order], known, order)
    ratios = known.select("gram", (F.ln("pa") - F.ln("pb")).alias("ratio")).join(level.select("gram", F.col("places").alias("n")), "gram")
    found = scratch.save(ratios, "ratios")
    scratch.drop(level)
    return found


def score(urls: DataFrame, ratios: DataFrame) -> DataFrame:
    """Add ``score``, the mean ratio of a URL's grams; ``urls`` must not repeat a URL."""
    grams = urls.select("url", F.explode(_grams("url")).alias("gram"))
    if ratios.count() <= BROADCAST_GRAMS:
        rated = grams.join(F.broadcast(ratios), "gram")
    else:
        rated = join_keys(grams, ratios, "gram", ratios.agg(F.sum("n")).first()[0])
    means = rated.groupBy("url").agg(F.avg("ratio").alias("score"))
    return urls.join(means, "url", "left")


def calibrate(scored: DataFrame) -> float:
    """The score from which URLs are allowed: the least sum of both kinds' error shares on rows not learnt."""
    part = F.greatest(F.least(F.floor(F.col("score") * CLASSES), F.lit(LIMIT * CLASSES)), F.lit(-LIMIT * CLASSES))
    rows = (
        scored.where(F.col("ruled").isNotNull() & F.col("score").isNotNull())
        .groupBy(part.alias("part"), "learn")
        .agg(*[F.sum(F.when(F.col("ruled") == v, F.col("n")).otherwise(0)).alias(v) for v in (ALLOW, BLOCK)])
        .orderBy("part")
        .collect()  # two rows per class at most
    )
    held = [r for r in rows if not r.learn]
    if not (sum(r[ALLOW] for r in held) and sum(r[BLOCK] for r in held)):
        held = rows
    allowed, blocked = sum(r[ALLOW] for r in held), sum(r[BLOCK] for r in held)
    if not (allowed and blocked):
        return float("-inf")
    best, threshold, lost, caught = 1.0, float("-inf"), 0, 0
    parts = sorted({r.part for r in held})
    for part, following in zip(parts, [*parts[1:], None], strict=True):
        lost += sum(r[ALLOW] for r in held if r.part == part)
        caught += sum(r[BLOCK] for r in held if r.part == part)
        error = lost / allowed + (blocked - caught) / blocked
        if error < best - 1e-12:
            # in the middle of the gap before the next class with rows
            best, threshold = error, (part + 1 + (part + 1 if following is None else following)) / 2 / CLASSES
    return threshold


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, score.

    Null and empty URLs have empty host and path and are scored as the empty URL; a URL of any length is
    scored whole; repeated rows get the same verdict; a score at the threshold is allowed; where the
    rules give no example of one kind, all other URLs are allowed; other columns are ignored; an empty
    table gives none.
    """
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"))
    different = rows.groupBy("url").agg(F.count("*").alias("n"))
    ruled = apply_rules(parse(different), rules).withColumn("learn", F.xxhash64("url") % 5 != 0)
    urls = scratch.save(ruled, "urls")
    scored = scratch.save(score(urls, fit(urls)), "scored")
    threshold = calibrate(scored)
    method = F.when(F.col("score") >= threshold, ALLOW).otherwise(BLOCK)
    verdicts = scored.select("url", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "score")
    return rows.join(verdicts, "url").select("page_id", "host", "path", "rule", "verdict", "score")
