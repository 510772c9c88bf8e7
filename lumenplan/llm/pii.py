"""Personal data: span proposals from patterns, judged by boosted trees, with DataFrame functions only.

Generators with high recall propose spans that may overlap.  Four of them are fixed patterns whose
matches stay if they pass a check (the base).  The proposals of the others are judged by boosted trees
on the span's format, its check and the words before it.  The trees are grown from a small labelled
table of sentences, which the same generators read, and come back as a column expression.  A proposal
whose probability passes its kind's calibrated threshold is added where it is clear of the base.

The work on a text is linear in its length and its spans: sums and maxima over the spans of a text run
over pieces of bounded size, and overlaps are found by a sweep over the sorted spans.
"""

from __future__ import annotations

import random
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)

# Base patterns.  Lookbehinds and possessive loops only keep the search linear: a match that begins
# inside a run of the first class would begin at the run's start or at the end of the match before.
_LOCAL = "[A-Za-z0-9._%+-]"
_LABEL = "[A-Za-z0-9-]"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_AT = r"[(\[{] ?(?:at|AT) ?[)\]}]"
_DOT = r"(?:\.| ?[(\[{] ?(?:dot|DOT) ?[)\]}] ?)"


@dataclass(frozen=True)
class Generator:
    """A pattern that proposes spans of a kind in texts that pass the quick test."""

    kind: int
    base: bool
    pattern: str
    quick: str


GENERATORS = (
    Generator(EMAIL, True, rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++", "@"),
    Generator(IP, True, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    Generator(CARD, True, r"(?<![0-9])[0-9](?:[ -]?+[0-9]){11,}+", r"[0-9](?:[ -]?[0-9]){11}"),
    Generator(PHONE, True, r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]"),
    # written-out addresses, and letters beyond ASCII
    Generator(EMAIL, False, rf"(?<!{_LOCAL}){_LOCAL}{{2,64}}+ ?{_AT} ?{_LABEL}{{2,63}}+(?:{_DOT}{_LABEL}{{2,63}}+){{1,4}}+", _AT),
    Generator(EMAIL, False, r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@[\p{L}\p{N}-]{1,63}+(?:\.[\p{L}\p{N}-]{1,63}+){1,6}+", "@"),
    # colons: IPv6, but also times and hardware addresses
    Generator(IP, False, r"(?<![0-9A-Za-z:.])(?:[0-9a-fA-F]{0,4}:){2,7}[0-9a-fA-F]{1,4}(?![0-9A-Za-z:])", r":[0-9a-fA-F]{0,4}:[0-9a-fA-F]"),
    # long runs, and groups with separators that the base does not know
    Generator(CARD, False, r"(?<![0-9])[0-9]{13,19}+(?![0-9])", r"[0-9]{13}"),
    Generator(CARD, False, r"(?<![0-9])[0-9]{4}([ .\x{A0}_/-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])", r"[0-9]{4}[ .\x{A0}_/-][0-9]{4}[ .\x{A0}_/-][0-9]{4}"),
    Generator(CARD, False, r"(?<![0-9])[0-9]{4}([ .\x{A0}_/-])[0-9]{6}\1[0-9]{5}(?![0-9])", r"[0-9]{4}[ .\x{A0}_/-][0-9]{6}"),
    # national numbers
    Generator(PHONE, False, r"\+[0-9]{1,3}[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])", r"\+[0-9]"),
    Generator(PHONE, False, r"(?<![0-9+.(-])\(?[0-9]{3}\)?[ ./-]{1,2}[0-9]{3}[ .-][0-9]{4}(?![0-9.-])", r"[0-9]{3}\)?[ ./-]{1,2}[0-9]{3}[ .-][0-9]{4}"),
    Generator(PHONE, False, r"(?<![0-9+.-])0[0-9]{1,4}[ /-][0-9]{2,8}(?:[ -][0-9]{2,6}){0,4}+(?![0-9.-])", r"0[0-9]{1,4}[ /-][0-9]{2}"),
)

#: Rounds, step and depth of the boosting, and the least share of true spans among those above a threshold.
ROUNDS, STEP, DEPTH, PRECISION = 40, 0.3, 3, 0.95
#: Code points before a span in which words count.
CONTEXT = 40
#: Words that stand before a span of a kind, and words that stand before other numbers.
CUES = (
    r"mail|contact|write|reach|send",
    r"\bip\b|ipv6|host|server|ping|router|gateway|address",
    r"card|visa|master|amex|credit|debit|pay|cvv|karte|carte|tarjeta",
    r"phone|tel\b|telefon|téléphone|teléfono|call|mobile|cell|fax|whatsapp|dial|ring|sms|hotline|number is",
)
OTHER = (
    r"version|isbn|order|invoice|serial|section|chapter|page|tracking|\bref|\bid\b|token|key|hash|commit|population|total|price|costs?\b"
    r"|\bno\.|date|time|clock|year|\bmac\b|between|score|range|pieces|sample|batch|item|lot\b|article"
)
FEATURES = ("kind", "digits", "letters", "others", "groups", "parens", "doubled", "check", "before", "after", "cue", "other")
#: Spans that sums and maxima are taken over at a time, and code points of a piece of text that is cut.
PIECE, CUT = 64, 4096
_SPAN = "struct<kind:int,base:boolean,start:int,end:int,m:string,before:string,after:string>"
_FAR = (1 << 31) - 1


def _let(value: Column, then) -> Column:
    """``then`` of a value that is computed once; in a lambda an expression would be computed for every element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _running(values: Column, add, zero: int) -> Column:
    """For each of ``values`` the total of those before it, by ``add`` from ``zero`` on, in pieces."""

    def cut(v: Column) -> Column:
        count = F.floor((F.size(v) - 1) / PIECE).cast("int")
        return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), count)), lambda i: F.slice(v, i * PIECE + 1, F.lit(PIECE)))

    def scan(array: Column, start: Column) -> Column:
        state = F.struct(start.alias("at"), F.array().cast("array<int>").alias("seen"))
        step = lambda s, v: F.struct(add(s["at"], v).alias("at"), F.concat(s["seen"], F.array(s["at"])).alias("seen"))
        return F.aggregate(array, state, step, lambda s: s["seen"])

    first = F.lit(zero)
    totals = lambda pieces: F.transform(pieces, lambda p: F.aggregate(p, first, add))
    return _let(_let(values, cut), lambda pieces: F.flatten(F.zip_with(pieces, scan(totals(pieces), first), scan)))


def _sum(values: Column) -> Column:
    return _running(values, lambda a, b: a + b, 0)


def _most(values: Column) -> Column:
    return _running(values, lambda a, b: F.greatest(a, b), 0)


def _least_after(values: Column) -> Column:
    """For each of ``values`` the least of those after it."""
    return F.reverse(_running(F.reverse(values), lambda a, b: F.least(a, b), _FAR))


def _read(text: Column, g: Generator) -> Column:
    """The matches of a generator and the pieces between them; null if the quick test finds none."""
    return F.when(
        text.rlike(g.quick),
        F.struct(F.split(text, g.pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(g.pattern), F.lit(0)).alias("matches")),
    )


def _found(read: Column, g: Generator) -> Column:
    """The matches of a generator as an array of spans in code points, in order."""
    pieces, matches = read["pieces"], read["matches"]
    lengths = F.zip_with(F.slice(pieces, F.lit(1), F.size(matches)), matches, lambda p, m: F.length(p) + F.length(m))
    rows = F.arrays_zip(matches.alias("m"), F.slice(pieces, F.lit(1), F.size(matches)).alias("p"), F.slice(pieces, F.lit(2), F.size(matches)).alias("q"), _sum(lengths).alias("s"))

    def span(r: Column) -> Column:
        start = r["s"] + F.length(r["p"])
        return F.struct(
            F.lit(g.kind).alias("kind"), F.lit(g.base).alias("base"), start.alias("start"), (start + F.length(r["m"])).alias("end"), r["m"].alias("m"),
            F.right(r["p"], F.lit(CONTEXT)).alias("before"), F.left(r["q"], F.lit(1)).alias("after"),
        ).cast(_SPAN)

    none = F.array().cast(f"array<{_SPAN}>")
    return F.when(F.size(F.coalesce(matches, F.array().cast("array<string>"))) > 0, F.transform(rows, span)).otherwise(none)


def _passes(span: Column) -> Column:
    """The check of a span's kind: bounds of the parts, checksum, number of digits."""
    digits = F.regexp_replace(span["m"], "[^0-9]", "")
    n = F.length(digits)
    six = span["m"].rlike("^(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}$") | (span["m"].contains("::") & ~span["m"].contains(":::"))
    return (
        F.when(span["kind"] == EMAIL, True)
        .when(span["kind"] == IP, span["m"].rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$") | (~span["base"] & six))
        .when(span["kind"] == CARD, n.between(12, 19) & F.call_function("luhn_check", digits))
        .otherwise(n.between(9, 15))
    )


def _class(char: Column) -> Column:
    return (
        F.when(char == "", 0).when(char.rlike(r"\s"), 1).when(char.rlike("[0-9]"), 3).when(char.rlike(r"\p{L}"), 2).when(char.rlike("[$€£¥#=/_%]"), 5).otherwise(4)
    )


def _features(span: Column) -> Column:
    """A struct of FEATURES, all of them small integers."""
    count = lambda pattern, most: F.least(F.length(F.regexp_replace(span["m"], pattern, "")), F.lit(most))
    before = F.coalesce(span["before"], F.lit(""))
    last = F.right(before, F.lit(1))
    words = F.lower(before)
    cue = F.lit(False)
    for kind, pattern in enumerate(CUES):
        cue = F.when(span["kind"] == kind, words.rlike(pattern)).otherwise(cue)
    flag = lambda c: F.when(c, 1).otherwise(0)
    return F.struct(
        span["kind"].alias("kind"),
        count("[^0-9]", 24).alias("digits"),
        count(r"[^\p{L}]", 24).alias("letters"),
        count(r"[\p{L}0-9]", 24).alias("others"),
        F.least(F.size(F.split(span["m"], "[^0-9]+", -1)), F.lit(12)).alias("groups"),
        flag(span["m"].rlike(r"[(\[{]")).alias("parens"),
        flag(span["m"].contains("::") | span["m"].contains("  ")).alias("doubled"),
        flag(_passes(span)).alias("check"),
        _class(last).alias("before"),
        _class(F.coalesce(span["after"], F.lit(""))).alias("after"),
        flag(cue).alias("cue"),
        flag(words.rlike(OTHER)).alias("other"),
    )


@dataclass
class Trees:
    """Boosted trees of depth three, and a threshold per kind."""

    start: float
    trees: list[tuple]
    thresholds: list[float]

    def value(self, x: np.ndarray) -> np.ndarray:
        def leaf(tree, rows):
            if not isinstance(tree, tuple):
                return np.full(len(rows), tree)
            f, t, low, high = tree
            return np.where(rows[:, f] <= t, leaf(low, rows), leaf(high, rows))

        return self.start + sum((leaf(t, x) for t in self.trees), np.zeros(len(x)))

    def column(self, features: Column) -> Column:
        def leaf(tree):
            if not isinstance(tree, tuple):
                return F.lit(float(tree))
            f, t, low, high = tree
            return F.when(features[FEATURES[f]] <= t, leaf(low)).otherwise(leaf(high))

        total = reduce(lambda a, b: a + b, (leaf(t) for t in self.trees), F.lit(float(self.start)))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def threshold(self, kind: Column) -> Column:
        out = F.lit(self.thresholds[-1])
        for k, t in enumerate(self.thresholds[:-1]):
            out = F.when(kind == k, F.lit(t)).otherwise(out)
        return out


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
    """A regression tree on gradients, by the best gain over all cuts."""
    here = g.sum() ** 2 / (h.sum() + 1)
    best = (1e-6, None)
    for f in range(x.shape[1] if depth else 0):
        for t in np.unique(x[:, f])[:-1]:
            low = x[:, f] <= t
            gain = g[low].sum() ** 2 / (h[low].sum() + 1) + g[~low].sum() ** 2 / (h[~low].sum() + 1) - here
            if gain > best[0]:
                best = (gain, (f, int(t)))
    if best[1] is None:
        return -STEP * float(g.sum() / (h.sum() + 1))
    f, t = best[1]
    low = x[:, f] <= t
    return (f, t, _grow(x[low], g[low], h[low], depth - 1), _grow(x[~low], g[~low], h[~low], depth - 1))


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, check: np.ndarray) -> Trees:
    """Trees from the rows outside ``check``; the thresholds from those inside."""
    fit = ~check if (~check).any() else np.ones(len(x), bool)
    share = np.clip((y * weight)[fit].sum() / max(1.0, weight[fit].sum()), 0.01, 0.99) if len(x) else 0.5
    model = Trees(float(np.log(share / (1 - share))), [], [0.9] * len(KINDS))
    value = np.full(len(x), model.start)
    for _ in range(ROUNDS if len(x) else 0):
        p = 1 / (1 + np.exp(-value))
        tree = _grow(x[fit], ((p - y) * weight)[fit], (p * (1 - p) * weight)[fit], DEPTH)
        model.trees.append(tree)
        value = model.value(x)
    p = 1 / (1 + np.exp(-value))
    for k in range(len(KINDS)):
        of = np.flatnonzero(check & (x[:, 0] == k)) if len(x) else np.zeros(0, int)
        order = of[np.argsort(-p[of], kind="stable")]
        right = np.cumsum((y * weight)[order]) / np.maximum(np.cumsum(weight[order]), 1)
        good = np.flatnonzero(right >= PRECISION)
        if len(good):
            # in the middle of the gap below the last one that keeps the precision
            last = p[order][good[-1]]
            below = p[order][good[-1] + 1 :]
            model.thresholds[k] = float(min(0.9, max(0.5, (last + (below[0] if len(below) else 0.5)) / 2)))
    return model


def _luhn(digits: str) -> str:
    """The digits and the check digit that makes them pass."""
    total = sum(sum(divmod(int(c) * (2 - k % 2), 10)) for k, c in enumerate(reversed(digits)))
    return digits + str(-total % 10)


#: Sentences around the values of the labelled table: those in which a value is personal data, those in which
#: it is not, and those that tell nothing.
TOLD = (
    ("my email is {}", "contact: {}", "please write to {} soon", "send it by e-mail to {}, thanks", "you can reach us under {}"),
    ("the ip is {}", "our server {} is down", "ping {} first", "set the gateway to {}.", "host {} answers", "router at {}"),
    ("my card is {}", "credit card: {}", "please pay with visa {} today", "debit {} cvv 123", "mastercard number {}, thanks", "Kreditkarte {}"),
    ("call me at {}", "phone: {}", "tel. {} (office)", "my mobile number is {}", "fax {}", "dial {} now", "Telefon {}", "WhatsApp {}, thanks"),
)
DENIED = (
    ("he stood {} today", "the key is {}", "version {}"),
    ("at the time of {} it rang", "the clock shows {}", "mac {}", "between {} and noon", "score {}", "section {} of the text"),
    ("order {}", "tracking id {}", "serial no. {}", "token = {}", "invoice {} is open", "isbn {}", "sample {} of the batch", "population total {}"),
    ("order {}", "invoice no. {}", "version {}", "isbn {}", "total price {}", "pieces in the range {}", "serial {}", "date {}", "page {} of the article"),
)
BARE = ("and then {} came", "{}", "some words of a text {} more words", "the end. {} The next", "see ({}) there")


def labelled() -> list[tuple[int, int, int, int, str]]:
    """The labelled table (label, kind, start, end, text): values of many formats in sentences, made by rule."""
    rng = random.Random(17)
    number = lambda n: str(rng.randint(1, 9)) + "".join(str(rng.randint(0, 9)) for _ in range(n - 1))
    cut = lambda d, sizes, by: by.join(d[sum(sizes[:k]) : sum(sizes[: k + 1])] for k in range(len(sizes)))
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows = []

    def add(label: int, kind: int, value: str, sentences) -> None:
        for s in sentences:
            start = s.index("{}")
            rows.append((label, kind, start, start + len(value), s.replace("{}", value)))

    for k in range(6):
        name, host = rng.choice(["anna.lee", "j_smith", "office", "bob22", "m.rossi"]), rng.choice(["example", "firma-west", "uni", "mail9"])
        for v in (f"{name} [at] {host}.org", f"{name}(at){host}.com", f"{name} [at] {host} [dot] de", f"{name} (AT) {host} (DOT) net", f"jos\u00e9.{name}\u00e9@{host}.es", f"{name}@b\u00fccher-{host}.de", f"\u00e9.{name[:3]}@m\u00fcller.de", f"zo\u00eb{k}@\u00e9t\u00e9.fr"):
            add(1, EMAIL, v, TOLD[EMAIL] + BARE)
        for v in (f"{name} (at) {host}.section", f"look (at) {host}.Then"):
            add(0, EMAIL, v, DENIED[EMAIL])
        for v in (":".join(hexa(4) for _ in range(8)), f"2001:db8::{hexa(4)}", f"fe80::{hexa(4)}:{hexa(3)}:{hexa(4)}", f"2a02:{hexa(4)}:{hexa(4)}::1"):
            add(1, IP, v, TOLD[IP] + BARE)
        for v in (f"{rng.randint(10, 23)}:{rng.randint(10, 59)}:{rng.randint(10, 59)}", f"{k}:{k + 1}:{k + 2}", ":".join(hexa(2) for _ in range(6)), "bad::cafe", f"{number(2)}:{number(2)}:{number(2)}:{number(2)}"):
            add(0, IP, v, DENIED[IP] + BARE)
        good, bad = _luhn(str(rng.randint(3, 6)) + number(14)), str(rng.randint(3, 6)) + number(15)
        while _luhn(bad[:-1]) == bad:
            bad = bad[:-1] + str((int(bad[-1]) + 1) % 10)
        amex = _luhn("37" + number(12))
        for v in (good, *(cut(good, (4, 4, 4, 4), by) for by in (".", "\u00a0", "_", "/", " ", "-")), cut(amex, (4, 6, 5), "."), cut(amex, (4, 6, 5), "/")):
            add(1, CARD, v, TOLD[CARD] + BARE)
        for v in (bad, *(cut(bad, (4, 4, 4, 4), by) for by in (".", "/"))):
            add(1, CARD, v, TOLD[CARD])
            add(0, CARD, v, DENIED[CARD] + BARE)
        for n in (13, 14, 17, 18, 19):
            d = number(n)
            add(0, CARD, d if _luhn(d[:-1]) != d else d[:-1] + str((int(d[-1]) + 1) % 10), DENIED[CARD] + BARE)
        for n in (13, 16):
            add(0, CARD, number(n), ("token = \"a{}bc0f\"", "key c3{}d", "at /{}/x", "sum ${} paid", "f{}"))
        d = number(3) + number(7)
        for v in (cut(d, (3, 3, 4), "-"), f"({d[:3]}) {d[3:6]}-{d[6:]}", cut(d, (3, 3, 4), " "), cut(d, (3, 3, 4), "."), f"0{number(3)} {number(7)}", f"0{number(2)}/{number(7)}", f"00{number(2)} {number(2)} {number(7)}", f"0{number(1)} {number(2)} {number(2)} {number(2)} {number(2)}"):
            add(1, PHONE, v, TOLD[PHONE])
            add(0, PHONE, v, DENIED[PHONE])
        for v in (cut(d, (3, 3, 4), "-"), f"({d[:3]}) {d[3:6]}-{d[6:]}"):
            add(1, PHONE, v, BARE)
        for v in (cut(d, (3, 3, 4), " "), cut(d, (3, 3, 4), "."), f"0{number(3)} {number(7)}", f"0{k} {number(2)}", f"01-02-{2000 + k}", f"0{number(1)}/{number(2)}", f"00 {number(2)} {number(2)}", f"007 {number(3)} {number(3)}"):
            add(0, PHONE, v, BARE)
        for v in (f"0{k + 1} {number(2)}", f"0{k + 1}-{number(2)}-{2000 + k}", f"0{k}/{number(4)}"):
            add(0, PHONE, v, DENIED[PHONE] + TOLD[PHONE][:2])
    return rows


@lru_cache(maxsize=1)
def _labelled_lines() -> str:
    return "\n".join("|".join(map(str, row)) for row in labelled())


def _proposed(docs: DataFrame, text: str) -> DataFrame:
    """Add ``_spans``, the proposals of all generators; each reads a text at most twice."""
    whole = F.coalesce(F.col(text), F.lit(""))
    read = docs.withColumns({f"_read{k}": _read(whole, g) for k, g in enumerate(GENERATORS)})
    every = read.withColumn("_spans", F.concat(*[_found(F.col(f"_read{k}"), g) for k, g in enumerate(GENERATORS)]))
    return every.drop(*[f"_read{k}" for k in range(len(GENERATORS))])


def examples(spark: SparkSession) -> DataFrame:
    """FEATURES of the proposals in the sentences of the labelled table, ``y`` (1: the value is personal data) and ``fold``."""
    lines = spark.range(1).select(F.explode(F.split(F.lit(_labelled_lines()), "\n")).alias("line"))
    part = lambda k: F.get(F.split("line", r"\|", 5), F.lit(k))
    table = lines.select(*[part(k).cast("int").alias(c) for k, c in enumerate(("label", "of", "start", "end"))], part(4).alias("text"))
    spans = _proposed(table, "text").select("label", "of", "start", "end", "text", F.explode(F.filter("_spans", lambda s: ~s["base"])).alias("s"))
    true = (F.col("label") == 1) & (F.col("s.kind") == F.col("of")) & (F.col("s.start") == F.col("start")) & (F.col("s.end") == F.col("end"))
    return spans.select(_features(F.col("s")).alias("f"), true.cast("int").alias("y"), (F.pmod(F.xxhash64("text"), F.lit(3)) == 0).alias("fold")).select("f.*", "y", "fold")


_trained: dict[str, Trees] = {}


def train(spark: SparkSession) -> Trees:
    """Trees from the labelled table; a third of its sentences calibrates the thresholds."""
    if "model" not in _trained:
        rows = examples(spark).groupBy(*FEATURES, "y", "fold").count().orderBy(*FEATURES, "y", "fold").collect()  # as many as the table has at most
        x = np.array([[r[f] for f in FEATURES] for r in rows], np.int64).reshape(-1, len(FEATURES))
        _trained["model"] = boost(x, np.array([float(r.y) for r in rows]), np.array([float(r["count"]) for r in rows]), np.array([r.fold for r in rows], bool))
    return _trained["model"]


def find(docs: DataFrame, text: str = "text", model: Trees | None = None) -> DataFrame:
    """Add ``base`` and ``spans``: arrays of (start, kind, end), in this order.

    ``spans`` holds the base spans and those that the trees add: proposals clear of every base span, and
    not inside another that is added.  Null and empty texts have none.
    """
    trees = model or train(docs.sparkSession)
    kept = "struct<start:int,kind:int,end:int>"
    slim = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")).cast(kept)
    marked = _proposed(docs, text)
    marked = marked.withColumns(
        {
            "base": F.sort_array(F.transform(F.filter("_spans", lambda s: s["base"] & _passes(s)), slim)),
            "_more": F.filter("_spans", lambda s: ~s["base"]),
        }
    ).drop("_spans")
    # a sweep over the base and the proposals by start finds the proposals that are clear of the base
    line = lambda array, base: F.transform(
        array, lambda s, k: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(base).alias("base"), k.alias("k"))
    )
    marked = marked.withColumn("_line", F.when(F.size("_more") > 0, F.sort_array(F.concat(line("base", True), line("_more", False)))))
    swept = F.arrays_zip(
        F.col("_line").alias("s"),
        _most(F.transform("_line", lambda s: F.when(s["base"], s["end"]).otherwise(0))).alias("end"),
        _least_after(F.transform("_line", lambda s: F.when(s["base"], s["start"]).otherwise(_FAR))).alias("next"),
    )
    clear = F.filter(swept, lambda z: ~z["s"]["base"] & (z["end"] <= z["s"]["start"]) & (z["next"] >= z["s"]["end"]))
    marked = marked.withColumn("_near", F.when(F.size("_more") > 0, clear))
    seen = F.transform("_near", lambda z: F.get("_more", z["s"]["k"]))
    marked = marked.withColumn("_seen", F.transform(seen, lambda s: F.struct(_features(s).alias("f"), s["start"].alias("start"), s["end"].alias("end"))))
    sure = F.filter("_seen", lambda c: trees.column(c["f"]) >= trees.threshold(c["f"]["kind"]))
    # the longer first, so what lies inside another ends before the most seen
    ranked = F.sort_array(F.transform(sure, lambda c: F.struct(c["start"].alias("start"), (-c["end"]).alias("back"), c["f"]["kind"].alias("kind"))))
    marked = marked.withColumn("_clear", ranked).drop("_more", "_line", "_near", "_seen")
    outer = F.filter(F.arrays_zip(F.col("_clear").alias("s"), _most(F.transform("_clear", lambda s: -s["back"])).alias("end")), lambda z: z["end"] < -z["s"]["back"])
    more = F.transform(outer, lambda z: F.struct(z["s"]["start"].alias("start"), z["s"]["kind"].alias("kind"), (-z["s"]["back"]).alias("end")).cast(kept))
    spans = F.when(F.col("_clear").isNull() | (F.size("_clear") == 0), F.col("base")).otherwise(F.sort_array(F.concat("base", more)))
    return marked.withColumn("spans", spans).drop("_clear")


def _written(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])))


def report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, base counts per kind, digest of the base spans, all spans, whether there is any.

    Null and empty texts have no spans and the digest of the empty list; a text of any length is read
    whole, in time linear in its length and spans; repeated rows give repeated rows; other columns are
    ignored; an empty table gives none.
    """
    found = find(docs.select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(_written("base"), 256).alias("base_sha256"),
        _written("spans").alias("spans"),
        (F.size("spans") > 0).alias("personal"),
    )


def _between(pieces: Column, start: Column, end: Column) -> Column:
    """The code points from ``start`` to ``end`` of a text cut into ``pieces`` of CUT code points."""
    i, j = F.floor(start / CUT).cast("int"), F.floor(end / CUT).cast("int")
    head = F.substring(F.coalesce(F.get(pieces, i), F.lit("")), start % CUT + 1, F.lit(CUT))
    tail = F.substring(F.coalesce(F.get(pieces, j), F.lit("")), F.lit(1), end % CUT)
    whole = F.array_join(F.slice(pieces, i + 2, F.greatest(F.lit(0), j - i - 1)), "")
    return F.when(i == j, F.substring(F.coalesce(F.get(pieces, i), F.lit("")), start % CUT + 1, end - start)).otherwise(F.concat(head, whole, tail))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with every span replaced by its kind in brackets; overlapping spans become one.

    ``n_chars``, where there is such a column, is counted anew for the changed texts.  Null and empty
    texts, repeated rows and all other columns stay as they are, whatever the columns' names; an empty
    table gives none.
    """
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    found = find(docs.select(F.struct("*").alias("_row"), F.col(text).alias("_text")), "_text")
    same = F.size("spans") == 0
    found = found.withColumn("_pieces", F.when(~same, F.regexp_extract_all(F.col("_text"), F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0))))
    found = found.withColumn("_ends", F.when(~same, _most(F.transform("spans", lambda s: s["end"]))))
    pieces = F.col("_pieces")
    out = F.transform(
        F.arrays_zip("spans", "_ends"),
        lambda z: F.when(z["_ends"] > z["spans"]["start"], "").otherwise(
            F.concat(_between(pieces, z["_ends"], z["spans"]["start"]), F.get(names, z["spans"]["kind"]))
        ),
    )
    last = F.array_max(F.transform("spans", lambda s: s["end"]))
    clean = F.concat(F.array_join(out, ""), _between(pieces, last, F.length("_text")))
    done = found.withColumn("_clean", F.when(same, F.col("_text")).otherwise(clean))
    changed = {text: F.col("_clean")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(same, F.col("_row.n_chars")).otherwise(F.length("_clean").cast("long"))
    return done.select(*[changed.get(c, F.col("_row").getField(c)).alias(c) for c in docs.columns])
