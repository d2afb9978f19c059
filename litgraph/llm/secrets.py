"""Operator 10: secret scans, with DataFrame functions only.

**Base kinds** are patterns: ``assign`` (a secret's name, a separator, a value
of 6 characters at least), ``access`` (key ids that begin with AKIA) and
``hex`` (runs of 24 hexadecimal digits at least).

**Randomness battery.**  Every run of 16 characters at least over
``[A-Za-z0-9+/_-]`` whose alphabet speaks for an encoding is a candidate:
hexadecimal, base32 and base36 in one case, with ``+/_-`` as mere separators
that are left out of the symbols, or base62 and base64 in mixed case.  Runs of
one case need a digit (letters alone are words) and ``LEAST`` symbols beside
separators.  The characters become symbol values, and three tests ask whether
they are random: chi-squared of the symbols against a uniform alphabet (in groups of equal chance, more of them for longer strings),
the Wald-Wolfowitz runs test around the middle value, and the lag-1 serial
correlation.  The score is the sum of the squared standardised statistics (of
chi-squared the upper side only): about 2.5 for random strings.

**False-discovery control by length.**  The letters of every whole document are
cut into stretches of the strata's lengths in turn, scored in the same way: the
nulls of each stratum.  The share of nulls among the
candidates is estimated from those with scores above ``TAIL`` (Storey's
estimate), and the largest score bound is taken at which the estimated false-
discovery rate is at most ``FDR``; short strings, which words resemble, thus
need a lower score than long ones.  Accepted candidates that overlap no base
span are ``random`` spans.  Candidates and nulls come from all documents; only
a histogram of fixed size reaches the driver.

Positions are code points, the end exclusive.

Defined results: a null text is an empty one, without spans.  Rows with null
ids and repeated rows are scanned like others; other columns are ignored.  An
empty table gives no rows; with too few letters for nulls nothing is
accepted beyond the base kinds.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litgraph.llm.common import materialize

# The patterns of the base kinds.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")

#: Tested runs and their least length.
RUN = r"[A-Za-z0-9+/_-]{16,}"
FDR = 0.05
TAIL = 12.0
#: Length strata by their least lengths; bins of the score's histogram.
STRATA = (16, 24, 40, 64)
BINS, WIDTH = 80, 0.5
#: Least symbols of a run of one case, and its separators.
LEAST, SEPARATORS = 12, "+/_-"
#: Alphabets in the order of their symbol values.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "abcdefghijklmnopqrstuvwxyz234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-",
    "word": "abcdefghijklmnopqrstuvwxyz",
}
#: The lowest bit of each byte of a number.
BYTES = 0x0101010101010101
SPANS = "array<struct<start:int,end:int,kind:string,hit:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def number(values: list[Column], body: Callable[..., Column]) -> Column:
    """``let`` of several values for a double.  A fold does not look through its
    body's types for each row, as Spark does for nested ``let``."""
    return F.aggregate(F.array(F.array(*values)), F.lit(0.0),
                       lambda _, x: body(*[F.get(x, F.lit(i)) for i in range(len(values))]))


def _none() -> Column:
    return F.array().cast(SPANS)


def find_spans(text: Column, pattern: str, kind: str) -> Column:
    """(start, end, kind, hit) of the pattern's leftmost matches.  Matches and
    the text between them alternate, so positions are sums of their lengths."""
    both = F.arrays_zip(F.split(text, pattern, -1).alias("gap"),
                        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        span = F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), x["hit"].alias("hit"))
        return F.when(x["hit"].isNull(), a).otherwise(
            F.struct(end.alias("at"), F.concat(a["out"], F.array(span)).alias("out")))

    return F.aggregate(both, F.struct(F.lit(0).alias("at"), _none().alias("out")), step, lambda a: a["out"])


def base_spans(text: Column) -> Column:
    """Spans of the three base kinds, kind by kind."""
    assigned = F.filter(find_spans(text, ASSIGN, "assign"),
                        lambda s: F.length(F.regexp_extract(s["hit"], ASSIGN, 1)) >= 6)
    # plain searches for what every match contains come first: they rule out most texts
    return F.concat(
        F.when(F.contains(text, F.lit("=")) | F.contains(text, F.lit(":")), assigned).otherwise(_none()),
        F.when(F.contains(text, F.lit("AKIA")), find_spans(text, ACCESS, "access")).otherwise(_none()),
        F.when(F.regexp_like(text, F.lit(HEX)), find_spans(text, HEX, "hex")).otherwise(_none()))


def encoding(s: Column) -> Column:
    """The encoding that a run's alphabet speaks for, null if none does."""
    def of(plain: Column) -> Column:
        like = lambda p: F.regexp_like(plain, F.lit(p))
        digit, mixed = like("[0-9]"), like("[a-z]") & like("[A-Z]")
        single = digit & like("[A-Za-z]") & (F.length(plain) >= LEAST)
        return (F.when(single & (like("^[0-9a-f]*$") | like("^[0-9A-F]*$")), "hex")
                .when(single & (like("^[A-Z2-7]*$") | like("^[a-z2-7]*$")), "base32")
                .when(single & (like("^[A-Z0-9]*$") | like("^[a-z0-9]*$")), "base36")
                .when((F.length(plain) == F.length(s)) & like("[A-Za-z]") & (
                    (digit & mixed) | like("[a-z][A-Z].*[a-z][A-Z]")), "base62")
                .when(digit & mixed, "base64"))
    return let(F.translate(s, SEPARATORS, ""), of)


def _values(s: Column, name: str) -> Column:
    """Symbol values of a run, scaled into (0, 1)."""
    size = min(64, len(ALPHABETS[name]))  # the url form of base64 repeats two symbols
    if name in ("hex", "base32", "base36", "word"):
        s = F.translate(F.lower(s), SEPARATORS, "")
    return F.transform(F.filter(F.split(s, ""), lambda c: c != ""),
                       lambda c: (F.pmod(F.instr(F.lit(ALPHABETS[name]), c) - 1, F.lit(size)) + 0.5) / size)


def battery(u: Column, thirds: Column | None = None) -> Column:
    """Score of an array of values in (0, 1): about 2.5 if they are random.
    ``thirds``: the alphabet's size is a multiple of 12, not of 16."""
    thirds = F.lit(False) if thirds is None else thirds
    n = F.size(u).cast("double")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    count = lambda a, f: F.size(F.filter(a, f)).cast("double")

    def uneven(k: Column) -> Column:
        """Chi-squared of k groups, standardised; 0 if it is below its mean."""
        own = F.transform(F.sequence(F.lit(0), k - 1), lambda g: F.pow(
            count(u, lambda x: F.floor(x * k) == g) - n / k, F.lit(2.0)) / (n / k))
        return F.pow(F.greatest((total(own) - k + 1) / F.sqrt(2.0 * (k - 1)), F.lit(0.0)), F.lit(2.0))

    # four characters are expected in a group at least
    chi = let(F.when(n >= 64, F.when(thirds, 12).otherwise(16)).when(n >= 32, F.when(thirds, 6).otherwise(8)).otherwise(4),
              uneven)
    following = F.slice(u, F.lit(2), F.size(u) - 1)
    leading = F.slice(u, F.lit(1), F.size(u) - 1)

    def runs_of(high: Column) -> Column:
        low = n - high
        mean = 2 * high * low / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        turns = count(F.zip_with(leading, following, lambda x, y: (x > 0.5) != (y > 0.5)), lambda x: x)
        return F.when(var > 0, F.pow(turns + 1 - mean, F.lit(2.0)) / var).otherwise(n)

    def serial_of(mean: Column) -> Column:
        around = total(F.transform(u, lambda x: (x - mean) * (x - mean)))
        both = total(F.zip_with(leading, following, lambda x, y: (x - mean) * (y - mean)))
        return F.when(around > 0, F.pow(both / around, F.lit(2.0)) * n).otherwise(n)

    runs = let(count(u, lambda x: x > 0.5), runs_of)
    return chi + runs + let(total(u) / n, serial_of)


def score(s: Column, enc: Column) -> Column:
    values = F.lit(None).cast("array<double>")
    for name in ALPHABETS:
        values = F.when(enc == name, _values(s, name)).otherwise(values)
    return let(values, lambda u: battery(u, enc == "base36"))


def tested_runs(text: Column) -> Column:
    """(start, end, encoding, score) of all runs that have an encoding."""
    spans = F.transform(
        find_spans(text, RUN, "random"),
        lambda s: let(encoding(s["hit"]), lambda e: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), e.alias("enc"),
            F.round(score(s["hit"], e), 6).alias("score"))))
    none = F.array().cast("array<struct<start:int,end:int,enc:string,score:double>>")
    return F.when(F.regexp_like(text, F.lit(RUN)), F.filter(spans, lambda r: r["enc"].isNotNull())).otherwise(none)


def _at_least(planes: Sequence[Column], t: int) -> Column:
    """The letters whose code, held in bit planes, is ``t`` (above 0) or more."""
    out = None
    for j, plane in enumerate(planes):
        if t >> j & 1:
            out = plane if out is None else plane.bitwiseAND(out)
        elif out is not None:
            out = plane.bitwiseOR(out)
    return out


def _letter_score(n: int, *word: Column) -> Column:
    """``battery`` of ``n`` letters, given as codes from 1 in the bytes of
    ``word``.  Whole texts pass through here, so letters are not looked at one
    by one: bit ``j`` of all codes is gathered in one number, plane ``j`` (letter
    ``8 i + p`` at bit ``8 (7 - p) + i``), and counts and sums are sums of bit
    counts of planes."""
    k = 16 if n >= 64 else 8 if n >= 32 else 4
    both = lambda a, b: F.bit_count(a.bitwiseAND(b))
    add = lambda parts: reduce(Column.__add__, parts)

    def plane(j: int) -> Column:
        bits = [F.shiftright(w, j).bitwiseAND(F.lit(BYTES)) for w in word]
        return reduce(Column.bitwiseOR, [bits[0], *(F.shiftleft(x, i) for i, x in enumerate(bits) if i)])

    def chi(planes: Sequence[Column]) -> Column:
        firsts = [next(i for i in range(26) if int((i + 0.5) / 26 * k) >= g) for g in range(1, k)]
        above = [F.lit(n), *[F.bit_count(_at_least(planes, i + 1)) for i in firsts], F.lit(0)]

        def of(*a: Column) -> Column:
            squares = add([F.pow((a[g] - a[g + 1]).cast("double"), F.lit(2.0)) for g in range(k)])
            return F.pow(F.greatest((squares * k / n - n - k + 1) / F.sqrt(F.lit(2.0 * (k - 1))), F.lit(0.0)), F.lit(2.0))
        return number(above, of)

    def following(plane: Column) -> Column:
        """The plane of the letters that follow; 0 after the last."""
        return F.shiftleft(plane, 8).bitwiseOR(F.shiftrightunsigned(plane, 57))

    def runs(high: Column) -> Column:
        # all but the last letter, which nothing follows
        pairs = [8 * (7 - i % 8) + i // 8 for i in range(n - 1)]
        mask = sum(1 << x for x in pairs)
        turns = both(high.bitwiseXOR(following(high)), F.lit(mask - (mask >> 63 << 64)))

        def of(high: Column) -> Column:
            mean = 2 * high * (n - high) / n + 1
            var = (mean - 1) * (mean - 2) / (n - 1)
            return F.when(var > 0, F.pow(turns + 1 - mean, F.lit(2.0)) / var).otherwise(F.lit(float(n)))
        return number([F.bit_count(high).cast("double")], of)

    def serial(planes: Sequence[Column], after: Sequence[Column]) -> Column:
        bits = range(len(planes))
        total = add([F.bit_count(planes[j]) * (1 << j) for j in bits])
        squares = add([both(planes[j], planes[i]) * (1 << i + j + (i < j)) for j in bits for i in range(j + 1)])
        products = add([both(planes[j], after[i]) * (1 << i + j) for j in bits for i in bits])
        ends = (F.shiftright(word[0], 56) + word[-1].bitwiseAND(F.lit(31)))

        def of(total: Column, squares: Column) -> Column:
            # whole numbers: n times the squares, n * n times the products, both around the mean
            around = squares * n - total * total
            near = products * (n * n) - total * n * (total * 2 - ends) + total * total * (n - 1)
            return number([around], lambda x: F.when(x > 0, F.pow(near / (x * n), F.lit(2.0)) * n).otherwise(F.lit(float(n))))
        return number([total.cast("long"), squares.cast("long")], of)

    def of(*planes: Column) -> Column:
        return (chi(planes) + number([_at_least(planes, 14)], runs)
                + number([following(x) for x in planes], lambda *after: serial(planes, after)))
    return number([plane(j) for j in range(5)], of)


def _bin(score: Column) -> Column:
    return F.least(F.floor(score / WIDTH), F.lit(BINS - 1)).cast("int")


def null_bins(text: Column) -> Column:
    """``stratum * BINS + bin`` of all stretches that the text's letters are cut
    into, of the strata's lengths in turn; what is left at the end is too short
    for its stratum."""
    letters = F.lower(F.regexp_replace(text, "[^A-Za-z]+", ""))
    # eight letters a number, a byte each: the strata's lengths are multiples of eight
    words = F.transform(F.regexp_extract_all(F.hex(letters), F.lit("[0-9A-F]{16}"), F.lit(0)),
                        lambda x: F.conv(x, 16, 10).cast("long").bitwiseAND(F.lit(31 * BYTES)))
    step = sum(STRATA) // 8

    def of(w: Column) -> Column:
        def turn(i: Column) -> Column:
            out, at = [], 0
            for stratum, n in enumerate(STRATA):
                place = i * step + at
                here = number([F.get(w, place + j) for j in range(n // 8)], partial(_letter_score, n))
                out.append(F.when(F.size(w) >= place + n // 8, F.lit(stratum * BINS) + _bin(F.round(here, 6))))
                at += n // 8
            return F.array_compact(F.array(*out))
        return F.flatten(F.transform(F.sequence(F.lit(0), F.floor(F.size(w) / step).cast("int")), turn))
    return let(words, of)


def _stratum(length: Column) -> Column:
    return sum(((length >= x).cast("int") for x in STRATA[1:]), F.lit(0))


def bounds(found: DataFrame) -> list[float]:
    """Score bound of each length stratum (below 0: nothing is accepted), from
    the columns ``runs`` and ``nulls`` of all documents."""
    cands = found.select(F.explode("runs").alias("r")).select(
        _stratum(F.col("r.end") - F.col("r.start")).alias("stratum"), F.lit(False).alias("null"), _bin(F.col("r.score")).alias("bin"))
    nulls = found.select(F.explode("nulls").alias("x")).select(
        F.floor(F.col("x") / BINS).cast("int").alias("stratum"), F.lit(True).alias("null"), (F.col("x") % BINS).alias("bin"))
    seen = {(x["stratum"], x["null"], x["bin"]): x["n"] for x in cands.union(nulls).groupBy(
        "stratum", "null", "bin").agg(F.count("*").alias("n")).collect()}
    out = []
    tail = int(TAIL / WIDTH)
    for s in range(len(STRATA)):
        null = [seen.get((s, True, b), 0) for b in range(BINS)]
        cand = [seen.get((s, False, b), 0) for b in range(BINS)]
        n0, n1, best = sum(null), sum(cand), -1.0
        if n0 and n1:
            above = (sum(null[tail:]) + 0.5) / (n0 + 1)
            share = min(1.0, (sum(cand[tail:]) + 1) / (n1 * above))
            below = accepted = 0
            for b in range(tail):
                below += null[b]
                accepted += cand[b]
                if accepted and share * n1 * (below + 1) / (n0 + 1) / accepted <= FDR:
                    best = (b + 1) * WIDTH
        out.append(best)
    return out


def all_spans(base: Column, runs: Column, limit: list[float]) -> Column:
    """Base spans and accepted runs that overlap none of them, by start, then
    by kind as listed; struct(start, rank, end)."""
    ranked = F.transform(base, lambda s: F.struct(
        s["start"].alias("start"),
        F.when(s["kind"] == "assign", 0).when(s["kind"] == "access", 1).otherwise(2).alias("rank"),
        s["end"].alias("end")))

    def accepted(r: Column) -> Column:
        stratum = _stratum(r["end"] - r["start"])
        bound = F.lit(-1.0)
        for i, x in enumerate(limit):
            bound = F.when(stratum == i, F.lit(float(x))).otherwise(bound)
        return (r["score"] < bound) & ~F.exists(
            base, lambda s: (s["start"] < r["end"]) & (r["start"] < s["end"]))

    more = F.transform(F.filter(runs, accepted), lambda r: F.struct(
        r["start"].alias("start"), F.lit(3).alias("rank"), r["end"].alias("end")))
    return F.array_sort(F.concat(ranked, more))


def _joined(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _scanned(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select(
        "doc_id", base_spans(F.col("text")).alias("base"), tested_runs(F.col("text")).alias("runs"),
        null_bins(F.col("text")).alias("nulls"))


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random`` for
    every row of ``docs``.  Texts are read once; what was found is kept."""
    found = materialize(_scanned(docs), "secrets")
    limit = bounds(found)
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.withColumn("all", all_spans(F.col("base"), F.col("runs"), limit)).select(
        "doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
        F.sha2(_joined(F.filter("all", lambda s: s["rank"] < 3)), 256).alias("base_sha256"),
        _joined(F.col("all")).alias("spans"),
        F.size(F.filter("all", lambda s: s["rank"] == 3)).cast("long").alias("n_random"))


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with all secret spans of ``text`` replaced by ``mark`` (spans
    that overlap or touch become one); rows without spans stay as they are.
    Columns and their types are kept; ``n_chars``, if there is one, follows."""
    limit = bounds(materialize(_scanned(docs).select("runs", "nulls"), "secret-runs"))
    text = F.coalesce(F.col("text"), F.lit(""))

    def cut(spans: Column, text: Column) -> Column:
        """The text outside the spans, with a mark for each stretch of spans."""
        def step(a: Column, s: Column) -> Column:
            gap = F.substring(text, a["at"] + 1, s["start"] - a["at"])
            return F.when(s["end"] <= a["at"], a).otherwise(F.struct(
                s["end"].alias("at"),
                F.when((s["start"] <= a["at"]) & (a["at"] > 0), a["out"])
                .otherwise(F.concat(a["out"], gap, F.lit(mark))).alias("out")))
        return F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step,
                           lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))

    spans = let(base_spans(text), lambda b: all_spans(b, tested_runs(text), limit))
    new = let(spans, lambda s: F.when(F.size(s) == 0, F.col("text")).otherwise(cut(s, text)))
    out = docs.withColumn("text", new)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(
            F.contains(F.col("text"), F.lit(mark)), F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(docs.columns)
