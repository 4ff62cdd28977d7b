"""Secret scans with DataFrame functions only.

Base patterns give spans of three kinds.  Beside them every run of 20 or more
characters of an encoding's alphabet is a candidate, if it mixes digits and
letters as that encoding does (hex, base32, base36, base62, base64).  Each
candidate gets a battery of randomness tests under the hypothesis that its
symbols are drawn evenly and independently from the inferred encoding:

* chi-squared uniformity of the alphabet (Wilson-Hilferty),
* runs of symbols in the upper and lower half of the alphabet (Wald-Wolfowitz),
* serial correlation of neighbouring symbols.

The smallest of the three p-values, times three, is the candidate's.
Candidates are rejected as not random by the Benjamini-Hochberg rule over all
candidates of the table, with weights in proportion to their length (long
tokens can be judged more surely), so that at most ``FALSE_REJECTIONS`` of the
rejected ones are expected to be random.

That rule guards the random ones; short identifiers often pass it.  So a second
test bounds the false alarms: the candidate's neighbouring letters and digits
get a probability under a pair model of the table's own words (runs of fewer
than 20 letters and digits, so no candidate is counted; a share ``SPREAD`` of it
is even draws, so an unseen pair is not proof) and one under even draws.  Under
the text model the second exceeds the first k times with a chance of 1/k at most,
so their ratio is a p-value; the text hypothesis has to be rejected by the same
rule, with at most ``FALSE_ALARMS`` of the rejected expected to be text.
A step from a small to a capital letter is a word break and not scored, nor are
digits at the end.  What
passes both becomes a span of kind ``random``, unless it overlaps a base span.
A table without such words has no text model and gives no random spans.

Texts are read twice, once for the pair counts (27 x 27 at most leave the
cluster); what is left of them (spans, candidates) is written to the shared
folder.  The rules need only histograms of the p-values with ``CELLS`` cells, of
which each holds a tenth of a power of ten.  The work is linear in a text's
length but for the places, whose sums go over pieces of the square root of the
number of matches.

Nulls and odd rows: a null text is an empty text; a null doc_id stays null;
repeated rows come out once each; empty tables give no rows; other columns are
ignored.  Positions count code points; ends are exclusive.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tablekeeper.session import materialize

#: fixed values: the base patterns, and the least length of what they must hold
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"      # a run of 32 or more is the same span as a run that is kept if it has 32 or more
MIN_ASSIGN, MIN_ACCESS = 8, 16
KINDS = ["assign", "access", "hex", "random"]

CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}"
#: encodings in the order they are tried: pattern, alphabet
ENCODINGS = [
    (r"^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$", "0123456789abcdef"),
    (r"^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$", "0123456789ABCDEF"),
    (r"^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    (r"^(?=.*[0-9])(?=.*[a-z])[a-z0-9]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    (r"^(?=.*[0-9])(?=.*[A-Z])[A-Z0-9]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    (r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    (r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    (r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9_-]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
]
FALSE_REJECTIONS = 0.05
FALSE_ALARMS = 0.05
SPREAD = 0.1
CELLS = 160

SYMBOLS = "abcdefghijklmnopqrstuvwxyz0123456789"
CODES = 27      # letters, and one for all digits
_SPAN = "array<struct<start:int,end:int,token:string>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, also where a lambda function inside uses it per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _folds(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Prefix folds of a short array of integers that are not negative, from 0."""
    def step(s: Column, x: Column) -> Column:
        at = op(s["at"], x)
        return F.struct(at.alias("at"), F.concat(s["out"], F.array(at)).alias("out"))

    return F.aggregate(values, F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<int>)").alias("out")), step, lambda s: s["out"])


def _running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Prefix folds of an array of integers that are not negative, from 0.

    ``op`` is associative.  The array is folded in pieces of the square root of
    its size, and the pieces' folds are folded again, as growing an array copies it.
    """
    def pieces(v: Column, size: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / size).cast("int")),
                           lambda k: _folds(F.slice(v, k * size + 1, size), op))

    def joined(each: Column) -> Column:
        ends = F.concat(F.array(F.lit(0)), _folds(F.transform(each, lambda p: F.element_at(p, -1)), op))
        return F.flatten(F.zip_with(each, F.slice(ends, F.lit(1), F.size(each)), lambda p, e: F.transform(p, lambda x: op(e, x))))

    def whole(v: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(v).cast("double"))).cast("int")
        return F.when(F.size(v) > 0, _let(_let(size, lambda n: pieces(v, n)), joined)).otherwise(F.expr("CAST(array() AS array<int>)"))

    return _let(values, whole)


def _spans(text: Column, pattern: str, ok: str) -> Column:
    """Matches of a pattern with their places: the text between matches gives the steps.  ``ok`` is a pattern for the match.

    Texts without a match are not split.
    """
    def placed(found: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        ends = _running(F.zip_with(gaps, found, lambda g, m: F.length(g) + F.length(m)), lambda x, y: x + y)
        return F.zip_with(found, ends, lambda m, end: F.struct((end - F.length(m)).alias("start"), end.alias("end"), m.alias("token")))

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(
        F.size(found) > 0, F.filter(placed(found), lambda m: F.call_function("rlike", m["token"], F.lit(ok)))
    ).otherwise(F.expr(f"CAST(array() AS {_SPAN})")))


def _apart(candidates: Column, base: Column) -> Column:
    """Candidates that overlap no base span: none that starts before a candidate's end reaches beyond its start."""
    def mark(s: Column, at: str, kind: int) -> Column:
        return F.struct(s[at].alias("at"), F.lit(kind).alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["token"].alias("token"))

    def free(events: Column) -> Column:
        reach = _running(F.transform(events, lambda e: F.when(e["k"] == 1, e["end"]).otherwise(F.lit(0))), F.greatest)
        both = F.zip_with(events, reach, lambda e, r: F.struct(e.alias("e"), r.alias("r")))
        return F.transform(F.filter(both, lambda x: (x["e"]["k"] == 0) & (x["r"] <= x["e"]["start"])), lambda x: F.struct(
            x["e"]["start"].alias("start"), x["e"]["end"].alias("end"), x["e"]["token"].alias("token")))

    return _let(F.array_sort(F.concat(F.transform(candidates, lambda c: mark(c, "end", 0)),
                                      F.transform(base, lambda b: mark(b, "start", 1)))), free)


def _normal_tail(z: Column) -> Column:
    """Upper tail of the normal distribution: a rational approximation up to 3 (within 1e-7), a continued fraction beyond."""
    def tail(z: Column) -> Column:
        x = F.least(F.lit(37.0), F.abs(z))
        poly = _let(1 / (1 + 0.2316419 * x), lambda t: t * (0.319381530 + t * (-0.356563782 + t * (
            1.781477937 + t * (-1.821255978 + t * 1.330274429)))))
        below = x
        for k in range(12, 0, -1):
            below = x + k / below
        upper = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * F.when(x < 3, poly).otherwise(1 / below)
        return F.when(z < 0, 1 - upper).otherwise(upper)

    return _let(z, tail)


def _alphabet(token: Column) -> Column:
    out = F.lit(None).cast("string")
    for pattern, alphabet in reversed(ENCODINGS):
        out = F.when(token.rlike(pattern), F.lit(alphabet)).otherwise(out)
    return out


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def _pairs(values: Column) -> Column:
    return F.zip_with(F.slice(values, F.lit(1), F.greatest(F.lit(0), F.size(values) - 1)), F.slice(values, F.lit(2), F.size(values)),
                      lambda u, v: F.struct(u.alias("u"), v.alias("v")))


def _p_random(token: Column, alphabet: Column) -> Column:
    """The battery's p-value of one candidate, if its symbols were drawn evenly and independently."""
    def battery(s: Column) -> Column:
        x, n, a, middle, upper = (s[k] for k in ("x", "n", "a", "middle", "upper"))
        squares = _total(F.transform(F.array_distinct(x), lambda c: F.pow(F.size(F.filter(x, lambda v: v == c)).cast("double"), F.lit(2.0))))
        chi, df = a / n * squares - n, a - 1
        p_chi = _normal_tail((F.pow(chi / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)))
        runs = 1 + _total(F.transform(_pairs(x), lambda q: ((q["u"] > a / 2) != (q["v"] > a / 2)).cast("double")))
        mean = 2 * upper * (n - upper) / n + 1
        spread = F.sqrt(F.greatest(F.lit(1e-9), (mean - 1) * (mean - 2) / (n - 1)))
        p_runs = 2 * _normal_tail(F.abs(runs - mean) / spread)
        var = _total(F.transform(x, lambda v: (v - middle) * (v - middle)))
        corr = _total(F.transform(_pairs(x), lambda q: (q["u"] - middle) * (q["v"] - middle))) / F.greatest(F.lit(1e-9), var)
        p_serial = 2 * _normal_tail(F.abs(corr + 1 / n) * F.sqrt(n))
        return F.greatest(F.lit(1e-16), F.least(F.lit(1.0), 3 * F.least(p_chi, p_runs, p_serial)))

    x = F.transform(F.split(F.regexp_replace(token, "=+$", ""), ""), lambda c: F.call_function("instr", alphabet, c).cast("double"))
    sums = lambda x: F.struct(
        x.alias("x"), F.size(x).cast("double").alias("n"), F.length(alphabet).cast("double").alias("a"),
        (_total(x) / F.size(x)).alias("middle"),
        _total(F.transform(x, lambda v: (v > F.length(alphabet) / 2).cast("double"))).alias("upper"))
    return _let(_let(x, sums), battery)


def pair_model(docs: DataFrame) -> list[list[float]] | None:
    """Counts (and a half) of neighbouring letters and digits in the table's words, 27 x 27; none without words.

    Words are counted first, so a word that fills the table moves once a task.
    """
    words = (docs.select(F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(r"(?<![A-Za-z0-9])[A-Za-z0-9]{2,19}+(?![A-Za-z0-9])"),
                                                        F.lit(0))).alias("w"))
             .groupBy(F.regexp_replace(F.lower("w"), "[0-9]", "0").alias("w")).count())
    pairs = (words.select("count", F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 1), lambda i: F.substr(F.col("w"), i, F.lit(2)))).alias("pair"))
             .groupBy("pair").agg(F.sum("count").alias("n")).collect())      # 729 rows at most
    if not pairs:
        return None
    counts = [[0.5] * CODES for _ in range(CODES)]
    for pair, n in pairs:
        counts[SYMBOLS.index(pair[0])][SYMBOLS.index(pair[1])] += n
    return counts


def _p_text(token: Column, counts: list[list[float]]) -> Column:
    """P-value of one candidate if its letters and digits followed each other as in the table's words."""
    even = [1 / 36] * (CODES - 1) + [10 / 36]
    ratio = F.array(*[F.lit(math.log((1 - SPREAD) * n / sum(row) / u + SPREAD)) for row in counts for n, u in zip(row, even)])

    def code(c: Column) -> Column:
        return F.struct(F.least(F.lit(CODES), F.call_function("instr", F.lit(SYMBOLS), F.lower(c))).alias("code"), (c != F.lower(c)).alias("big"))

    scored = lambda q: (q["u"]["code"] > 0) & (q["v"]["code"] > 0) & ~(q["v"]["big"] & ~q["u"]["big"])
    pairs = F.filter(_pairs(F.transform(F.split(F.regexp_replace(token, "[0-9]*=*$", ""), ""), code)), scored)
    total = _total(F.transform(pairs, lambda q: F.get(ratio, (q["u"]["code"] - 1) * CODES + q["v"]["code"] - 1)))
    return F.exp(F.greatest(F.lit(math.log(1e-16)), F.least(F.lit(0.0), total)))


def _limits(p: DataFrame, shares: list[float]) -> list[float]:
    """Benjamini-Hochberg limits of the weighted p-values in each column, from histograms."""
    cell = lambda v: F.least(F.lit(CELLS - 1), F.greatest(F.lit(0), F.floor(-10 * F.log10(v)).cast("int")))
    test = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), cell(F.col(c)).alias("cell")) for k, c in enumerate(p.columns)]))
    counts = {(r["k"], r["cell"]): r["count"] for r in p.select(test.alias("t")).groupBy("t.k", "t.cell").count().collect()}  # CELLS rows a column
    out = []
    for k, share in enumerate(shares):
        m, within, limit = sum(n for (j, _), n in counts.items() if j == k), 0, 0.0
        for c in range(CELLS - 1, -1, -1):
            within += counts.get((k, c), 0)
            if (edge := 10 ** (-c / 10)) <= within * share / max(1, m):
                limit = max(limit, edge)
        out.append(limit)
    return out


def scan(docs: DataFrame, false_rejections: float = FALSE_REJECTIONS, false_alarms: float = FALSE_ALARMS) -> DataFrame:
    """Per document: the spans of each kind (arrays of start, end, token)."""
    counts = pair_model(docs)
    p_text = (lambda token: F.lit(1.0)) if counts is None else (lambda token: _p_text(token, counts))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
             .select("doc_id",
                     _spans(F.col("text"), ASSIGN, r"(?s).").alias("assign"),
                     _spans(F.col("text"), ACCESS, rf"^.{{{MIN_ACCESS},}}$").alias("access"),
                     _spans(F.col("text"), HEX, r".").alias("hex"),
                     _spans(F.col("text"), CANDIDATE, r"[0-9]").alias("candidates"))
             .withColumn("assign", F.filter("assign", lambda m: F.length(F.regexp_extract(m["token"], ASSIGN, 2)) >= MIN_ASSIGN)))
    tested = found.withColumn("candidates", _apart(F.col("candidates"), F.concat("assign", "access", "hex")))
    tested = tested.withColumn("candidates", F.filter(F.transform("candidates", lambda c: F.struct(
        c["start"].alias("start"), c["end"].alias("end"), c["token"].alias("token"), _alphabet(c["token"]).alias("alphabet"))),
        lambda c: c["alphabet"].isNotNull()))
    tested = tested.withColumn("candidates", F.transform("candidates", lambda c: F.struct(
        c["start"].alias("start"), c["end"].alias("end"), c["token"].alias("token"),
        _p_random(c["token"], c["alphabet"]).alias("p_random"), p_text(c["token"]).alias("p_text"))))
    rows = materialize(tested, "secret-candidates")
    each = rows.select(F.explode("candidates").alias("c")).select("c.p_random", "c.p_text", F.length("c.token").alias("n"))
    mean = each.agg(F.avg("n")).first()[0] or 1.0
    weighted = lambda p, n: p * F.lit(float(mean)) / n
    uneven, unlike = _limits(each.select(weighted(F.col("p_random"), F.col("n")).alias("a"), weighted(F.col("p_text"), F.col("n")).alias("b")),
                             [false_rejections, false_alarms])
    span = lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["token"].alias("token"))
    kept = F.filter("candidates", lambda c: (weighted(c["p_random"], F.length(c["token"])) > F.lit(uneven))
                    & (weighted(c["p_text"], F.length(c["token"])) <= F.lit(unlike)))
    return rows.select("doc_id", "assign", "access", "hex", F.transform(kept, span).alias("random"))


def listed(*kinds: str) -> Column:
    """kind:start:end of the kinds' spans, by start and then kind as in ``KINDS``, joined by commas."""
    def keyed(kind: str) -> Column:
        return F.transform(F.col(kind), lambda s: F.struct(s["start"].alias("a"), F.lit(KINDS.index(kind)).alias("k"),
                                                           s["end"].alias("b")))

    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(F.concat(*map(keyed, kinds))), lambda s: F.concat_ws(
        ":", F.get(names, s["k"]), s["a"].cast("string"), s["b"].cast("string"))), ",")
