"""Secret scans: fixed patterns, and a battery of randomness tests with false-discovery control. Built-in functions only.

A candidate is an unbroken run of 20 letters, digits and coding marks or more. Its alphabet is inferred (digits, hex, base 32,
letters, letters and digits, base 64). Three statistics are taken over that alphabet: chi-squared uniformity, runs of its
lower and upper half (Wald-Wolfowitz), and lag-1 serial correlation. A candidate counts as a secret if

- it passes for random: none of the three rejects that (Bonferroni), and
- that it is written text is rejected under Benjamini-Hochberg control over the document's candidates. The p-value joins two
  by Fisher's method: of a chi-squared as small as this where letters have the frequencies of text, and of so many
  changes of the class of character where text changes it seldom. Both laws take the length into account.

Short candidates of few classes can't reject either hypothesis, and are left.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ["assign", "access", "hex", "random"]
#: The base patterns. The assigned value is group 2.
ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ASSIGN_MIN, ACCESS, HEX = 12, r"AKIA[A-Z0-9]{14,}", r"[0-9a-f]{16,}"
_GATES = {"assign": r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", "access": ACCESS, "hex": r"(?<![0-9a-f])[0-9a-f]{16,}", "random": r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"}
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Level of each candidate's randomness battery, false-discovery rate of a document, chance that text changes its class of
#: character, and chance that two letters of text are the same.
BATTERY_LEVEL, DISCOVERY_RATE, CLASS_CHANGE, SAME_LETTER = 0.01, 0.01, 0.1, 0.066
#: Matches are placed so many at a time, so that the cost follows their number.
AT_ONCE = 256
_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPAN = "array<struct<start:int,ord:int,end:int,value:string>>"


def let(value, body):
    """body(value), with value computed once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _spans(text, pattern: str, order: int, group: int = 0):
    """All leftmost non-overlapping matches with their places: what lies between matches and the matches themselves, added up.

    Sums run within groups of AT_ONCE matches and then over the groups.
    """

    def step(acc, p):
        begin = acc["at"] + p["g"]
        end = begin + p["h"]
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(begin.alias("start"), F.lit(order).alias("ord"), end.alias("end"), p["v"].alias("value")))).alias("out"))

    def placed(parts):
        """Spans of a group, from its own start, and its length."""
        return F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out")), step)

    def moved(spans, by):
        return F.transform(spans, lambda s: F.struct((s["start"] + by).alias("start"), s["ord"].alias("ord"), (s["end"] + by).alias("end"), s["value"].alias("value")))

    def joined_groups(groups):
        starts = F.aggregate(groups, F.array(F.lit(0)), lambda acc, g: F.concat(acc, F.array(F.element_at(acc, -1) + g["at"])))
        return let(starts, lambda at: F.flatten(F.transform(groups, lambda g, i: moved(g["out"], F.get(at, i)))))

    def sizes(hits, values):
        gaps = F.split(text, pattern)
        return F.arrays_zip(F.transform(F.slice(gaps, 1, F.size(hits)), F.length).alias("g"), F.transform(hits, F.length).alias("h"), values.alias("v"))

    def grouped(parts):
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / AT_ONCE).cast("int")), lambda c: placed(F.slice(parts, c * AT_ONCE + 1, AT_ONCE)))

    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: let(sizes(hits, F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits), lambda parts: F.when(F.size(parts) > 0, let(grouped(parts), joined_groups)).otherwise(F.array().cast(_SPAN))))
    return found


def _gated(kind: str, text, spans):
    return F.when(text.rlike(_GATES[kind]), spans).otherwise(F.array().cast(_SPAN))


def base_spans(text):
    """Array of (start, ord, end, value) of the base patterns, by start and kind."""
    assign = F.filter(_spans(text, ASSIGN, 0, 2), lambda s: F.length(s["value"]) >= ASSIGN_MIN)
    return F.array_sort(F.concat(_gated("assign", text, assign), _gated("access", text, _spans(text, ACCESS, 1)), _gated("hex", text, _spans(text, HEX, 2))))


def normal_tail(z):
    """P(Z > z) of a standard normal column, by a rational approximation (error below 1e-7)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-x * x) / 2
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _alphabet(token):
    """The smallest of the known alphabets that holds the candidate (upper-cased if it is hexadecimal)."""
    kinds = [("^[0-9]+$", _DIGITS), ("^([0-9a-f]+|[0-9A-F]+)$", _DIGITS + "ABCDEF"), ("^[a-z]+$", _LOWER), ("^[A-Z]+$", _UPPER), ("^[A-Z2-7]+=*$", _UPPER + "234567"), ("^[A-Za-z]+$", _UPPER + _LOWER), ("^[A-Za-z0-9]+$", _UPPER + _LOWER + _DIGITS)]
    found = F.lit(_UPPER + _LOWER + _DIGITS + "+/_-=")
    for pattern, alphabet in reversed(kinds):
        found = F.when(token.rlike(pattern), alphabet).otherwise(found)
    return found


def _total(numbers):
    return F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x)


def battery(token):
    """Struct (size, chi, runs, serial, text) of one candidate: chi, runs and serial are p-values of the hypothesis that it is
    random, text of the hypothesis that it is written text."""

    def chi_squared(text, n, k):
        squares = F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), lambda a, c: a + F.pow(n - F.length(F.replace(text, c, F.lit(""))), F.lit(2.0)))
        return k / n * squares - n

    def measured(text, n, k, places):
        halves = F.transform(places, lambda x: F.when(x > (k + 1) / 2, 1.0).otherwise(0.0))
        centred = let(_total(places) / n, lambda centre: F.transform(places, lambda x: x - centre))
        # Wilson and Hilferty: the cube root of a chi-squared over its degrees of freedom is nearly normal.
        uniform = lambda chi: normal_tail((F.cbrt(chi / (k - 1)) - (1 - 2 / (9 * (k - 1)))) / F.sqrt(2 / (9 * (k - 1))))
        return let(
            F.struct(chi_squared(text, n, k).alias("chi"), halves.alias("h"), centred.alias("m")),
            lambda x: F.struct(n.alias("size"), uniform(x["chi"]).alias("chi"), runs(x["h"], n).alias("runs"), serial(x["m"], n).alias("serial"), _text_p(token, x["chi"], n, k).alias("text")),
        )

    def runs(halves, n):
        changed = _total(F.zip_with(halves, F.slice(halves, 2, F.size(halves)), lambda a, b: F.when(a != b, 1.0).otherwise(0.0)))

        def p(ones):
            mean = 1 + 2 * ones * (n - ones) / n
            spread = (mean - 1) * (mean - 2) / (n - 1)
            return F.when(spread > 0, 2 * normal_tail(F.abs(changed + 1 - mean) / F.sqrt(spread))).otherwise(0.0)

        return let(_total(halves), p)

    def serial(moved, n):
        product = _total(F.zip_with(moved, F.slice(moved, 2, F.size(moved)), lambda a, b: a * F.coalesce(b, F.lit(0.0))))
        return let(_total(F.transform(moved, lambda x: x * x)), lambda power: F.when(power > 0, 2 * normal_tail(F.abs(product / power * F.sqrt(n)))).otherwise(0.0))

    def of(alphabet):
        text = F.when(token.rlike("^[0-9a-f]+$"), F.upper(token)).otherwise(token)
        places = lambda t: F.transform(F.split(t, ""), lambda c: F.call_function("locate", c, alphabet).cast("double"))
        return let(text, lambda t: let(places(t), lambda at: measured(t, F.length(t).cast("double"), F.length(alphabet).cast("double"), at)))

    return let(_alphabet(token), of)


def _text_p(token, chi, n, k):
    """p-value of the hypothesis that the candidate is text, from two by Fisher's method.

    Text repeats letters, so its chi-squared has a mean of k - 1 + n (k SAME_LETTER - 1); and its class of character (words with
    or without a capital, capitals, digits, marks) changes seldom.
    """
    excess = n * F.greatest(k * SAME_LETTER - 1, F.lit(0.0))
    even = normal_tail((k - 1 + excess - chi) / F.sqrt(2 * (k - 1) + 4 * excess))
    changes = F.regexp_count(token, F.lit("[A-Z]?[a-z]+|[A-Z]+|[0-9]+|[+/_=-]+")) - 1
    mixed = normal_tail((changes - CLASS_CHANGE * (n - 1) - 0.5) / F.sqrt(CLASS_CHANGE * (1 - CLASS_CHANGE) * (n - 1)))
    return let(F.greatest(even * mixed, F.lit(1e-300)), lambda x: x * (1 - F.ln(x)))


def random_spans(text, base):
    """Candidates that the battery passes, under false-discovery control; none that overlaps a base span."""

    def chosen(ordered):
        # The largest rank r with p <= r * rate / m sets the threshold.
        passed = let(F.size(ordered), lambda m: F.array_max(F.transform(ordered, lambda x, i: F.when(x["b"]["text"] <= (i + 1) * DISCOVERY_RATE / m, i + 1).otherwise(0))))
        random = lambda x: 3 * F.least(x["b"]["chi"], x["b"]["runs"], x["b"]["serial"]) >= BATTERY_LEVEL
        return F.transform(F.filter(F.slice(ordered, 1, F.coalesce(passed, F.lit(0))), random), lambda x: x["s"])

    # Candidates are told from base spans by place: those that meet none.
    free = lambda found: F.filter(found, lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    tested = lambda spans: F.array_sort(F.transform(spans, lambda s: let(battery(s["value"]), lambda b: F.struct(b["text"].alias("p"), s.alias("s"), b.alias("b")))))
    return _gated("random", text, let(tested(free(_spans(text, CANDIDATE, 3))), chosen))


def find_secrets(df: DataFrame, text: str = "text", base: str = "base_secrets", spans: str = "secrets") -> DataFrame:
    """Adds `base` and `spans`: arrays of (start, ord, end, value) by start and kind (ord: place in KINDS), in code points, end exclusive.

    `base` has the matches of the fixed patterns, `spans` these and the tested candidates. Null text counts as empty.
    Whole texts; other columns stay, namesakes are replaced. One pass of built-in functions, no shuffle.
    """
    kept = [c for c in df.columns if c not in (base, spans)]
    held = df.select(*kept, base_spans(F.coalesce(F.col(text), F.lit(""))).alias(base))
    whole = F.coalesce(F.col(text), F.lit(""))
    return held.select(*kept, base, F.array_sort(F.concat(F.col(base), random_spans(whole, F.col(base)))).alias(spans))


def joined(spans):
    """kind:start:end of an array of spans, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["ord"]), s["start"], s["end"])), ",")
