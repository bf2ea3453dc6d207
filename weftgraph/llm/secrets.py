"""Secret scans: patterns, and a battery of randomness tests with false-discovery control. DataFrame functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import cut

#: The base patterns, in the order in which kinds are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: Longest runs only can be long enough, so the length goes into the pattern where nothing precedes the run.
KINDS = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]{12,}", "hex": r"[0-9a-f]{32,}"}
#: What may be an encoded key: a run of encoding characters with a letter, which no letter or digit of any script extends.
CANDIDATE = r"(?<![\p{L}\p{N}+/_=-])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{12,}+={0,2}+(?![\p{L}\p{N}])"
ORDER = [*KINDS, "random"]

#: Encodings a candidate is inferred to have, the narrowest first, with their symbols in order.
_DIGITS, _UP = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOW = _UP.lower()
ENCODINGS = {
    "hex": ("[0-9a-f]+", _DIGITS + "abcdef"),
    "HEX": ("[0-9A-F]+", _DIGITS + "ABCDEF"),
    "lower": ("[a-z]+", _LOW),
    "upper": ("[A-Z]+", _UP),
    "base32": ("[A-Z2-7]+", _UP + "234567"),
    "base36": ("[0-9a-z]+", _DIGITS + _LOW),
    "BASE36": ("[0-9A-Z]+", _DIGITS + _UP),
    "alpha": ("[A-Za-z]+", _UP + _LOW),
    "base62": ("[0-9A-Za-z]+", _DIGITS + _UP + _LOW),
    "base64": ("[0-9A-Za-z+/_-]+", _UP + _LOW + _DIGITS + "+/_-"),
}
#: Percentages of the letters a to z in English text, where symbol counts start from.
ENGLISH = (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.095, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4, 0.15, 2.0, 0.074)
#: Coefficients of the polynomial approximation of the normal distribution's tail.
TAIL = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


@dataclass(frozen=True)
class Battery:
    """rate: the share of ordinary strings among those reported that is allowed, in each class of length and encoding.

    accept: from which p of the battery on a string may be random. prior: symbols of ordinary text that counts start from.
    Ordinary p-values are told apart by `bins` of a tenth of a power of ten.
    """

    rate: float = 0.05
    accept: float = 0.01
    prior: float = 1000.0
    bins: int = 400


def _tail(z: Column) -> Column:
    """1 - Phi(z)."""
    a = F.least(F.abs(z), F.lit(37.0))
    t = 1 / (1 + 0.2316419 * a)
    poly = F.lit(0.0)
    for c in reversed(TAIL):
        poly = (poly + c) * t
    up = F.exp(-a * a / 2) * (1 / math.sqrt(2 * math.pi)) * poly
    return F.when(z >= 0, up).otherwise(1 - up)


def _sum(values: Column, f=lambda x: x) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + f(x))


def battery(rows: DataFrame, token: str = "token") -> DataFrame:
    """rows with encoding, squares (the sum of the squares of symbol counts) and p: the combined p-value that the token is
    uniformly random. Tokens without symbols have null instead.

    Chi-squared uniformity over the encoding's alphabet, the runs test about the alphabet's middle and the lag-one
    serial correlation, combined by Fisher's method.
    """
    t = F.col(token)
    encoding = F.coalesce(*[F.when(t.rlike(f"^{pattern}$"), name) for name, (pattern, _) in ENCODINGS.items()])
    rows = rows.withColumn("encoding", encoding)
    rows = rows.withColumn("_a", F.coalesce(F.element_at(_map({name: x for name, (_, x) in ENCODINGS.items()}), F.col("encoding")), F.lit("")))
    n = F.when(F.char_length(t) > 1, F.char_length(t)).cast("double")  # null for what cannot be tested
    k = F.when(F.char_length("_a") > 1, F.char_length("_a")).cast("double")
    rows = rows.withColumn("_x", F.transform(F.split(t, ""), lambda c: (F.instr(F.col("_a"), c) - 1).cast("double")))
    # each symbol of a short token adds how often it occurs, each of the alphabet adds its square for a long one
    often = lambda c: (n - F.char_length(F.replace(t, c, F.lit("")))).cast("double")
    squares = F.when(n <= 64, _sum(F.transform(F.split(t, ""), often))).otherwise(_sum(F.transform(F.split("_a", ""), often), lambda x: x * x))
    pairs = F.arrays_zip(F.slice("_x", 1, F.size("_x") - 1).alias("a"), F.slice("_x", 2, F.size("_x") - 1).alias("b"))
    rows = rows.withColumn("squares", squares).withColumn("_pairs", pairs).withColumn("_mean", _sum(F.col("_x")) / n)
    chi = k / n * F.col("squares") - n
    free = k - 1
    z_chi = (F.pow(F.greatest(chi, F.lit(0.0)) / free, F.lit(1 / 3)) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
    high = _sum(F.transform("_x", lambda x: (x >= k / 2).cast("double")))
    runs = 1 + _sum(F.transform("_pairs", lambda p: ((p["a"] >= k / 2) != (p["b"] >= k / 2)).cast("double")))
    expected = 2 * high * (n - high) / n + 1
    spread = (expected - 1) * (expected - 2) / (n - 1)
    z_runs = F.when(spread > 0, (runs - expected) / F.sqrt(spread)).otherwise(8.0)
    mean = F.col("_mean")
    var = _sum(F.transform("_x", lambda x: (x - mean) * (x - mean)))
    cov = _sum(F.transform("_pairs", lambda p: (p["a"] - mean) * (p["b"] - mean)))
    z_serial = F.when(var > 0, (cov / var + 1 / n) * F.sqrt(n)).otherwise(8.0)
    rows = rows.select("*", z_chi.alias("_z1"), F.abs(z_runs).alias("_z2"), F.abs(z_serial).alias("_z3"))
    logs = [F.log(F.greatest(p, F.lit(1e-12))) for p in (_tail(F.col("_z1")), 2 * _tail(F.col("_z2")), 2 * _tail(F.col("_z3")))]
    rows = rows.withColumn("_h", -(logs[0] + logs[1] + logs[2]))
    h = F.col("_h")
    p = F.when(n.isNotNull() & k.isNotNull(), F.least(F.lit(1.0), F.exp(-h) * (1 + h + h * h / 2)))
    return rows.withColumn("p", p).drop("_a", "_x", "_pairs", "_mean", "_h", "_z1", "_z2", "_z3")


def symbol_shares(tested: DataFrame, prior: float) -> dict[str, float]:
    """Shares of the symbols of ordinary strings: of letters those of all tokens of letters alone, on top of `prior` letters of
    English text, as keys that lack digits are rare; digits are taken for 5 % and other symbols for 0.2 % each."""
    out = {c: prior * 0.95 * x / sum(ENGLISH) for c, x in zip(_LOW, ENGLISH, strict=True)}
    out |= {c.upper(): x / 0.95 * 0.05 for c, x in out.items()}
    words = tested.where(F.col("encoding").isin("lower", "upper", "alpha"))
    for c, n in words.select(F.explode(F.split("token", "")).alias("c")).groupBy("c").count().collect():  # as many rows as letters
        out[c] += n
    total = sum(out.values())
    return {c: n / total for c, n in out.items()} | dict.fromkeys(_DIGITS, 0.005) | dict.fromkeys("+/_-", 0.002)


def ordinary(shares: dict[str, float], token: str = "token") -> Column:
    """How far, in standard deviations, a token's symbol counts (`squares`) are from those of an ordinary string of its
    length; the lower, the more even they are.

    Ordinary strings are draws from the shares of their encoding's symbols; the sum of the squares of a draw's counts has a
    mean and variance that the sums of the shares' powers give.
    """
    powers = {}
    for name, (_, symbols) in ENCODINGS.items():
        q = [shares[c] for c in symbols]
        powers[name] = [sum((x / sum(q)) ** k for x in q) for k in (2, 3)]
    s2, s3 = (F.element_at(_map({name: v[i] for name, v in powers.items()}), F.col("encoding")) for i in (0, 1))
    n = F.char_length(token).cast("double")
    var = 2 * n * (n - 1) * (s2 + 2 * (n - 2) * s3 - (2 * n - 3) * s2 * s2)
    return F.when(n > 1, (F.col("squares") - n - n * (n - 1) * s2) / F.sqrt(F.greatest(var, F.lit(1e-9))))


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def even_enough(tested: DataFrame, b: Battery) -> DataFrame:
    """(encoding, length_class, least): from which bin of ordinary p-values on tokens of a class are reported.

    By Benjamini and Hochberg: the largest p at which the ordinary strings to be expected among all tokens of the class, p
    times their number, are at most `rate` of those with p or less. Counts of fixed bins over all tokens decide, so the table
    stays small whatever the input.
    """
    bins = tested.groupBy("encoding", "length_class", "bin").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("encoding", "length_class")
    bins = bins.withColumn("reported", F.sum("n").over(whole.orderBy(F.desc("bin")))).withColumn("all", F.sum("n").over(whole))
    enough = F.col("all") * F.pow(F.lit(10.0), -F.col("bin") / F.lit(10.0)) <= b.rate * F.col("reported")
    return bins.where(enough).groupBy("encoding", "length_class").agg(F.min("bin").alias("least"))


def _found(text: Column, pattern: str) -> Column:
    """Matches with the number of characters before each, since the last; null where there are none."""
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.char_length(g).cast("long"))
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(text.rlike(pattern), F.arrays_zip(F.slice(gaps, 1, F.size(matches)).alias("gap"), matches.alias("m")))


def _named(kind: str) -> Column:
    """The matches of a kind with its name; an empty list where there are none."""
    none = F.array().cast("array<struct<kind:string,gap:bigint,m:string>>")
    return F.coalesce(F.transform(F.col(kind), lambda x: F.struct(F.lit(kind).alias("kind"), x["gap"].alias("gap"), x["m"].alias("m"))), none)


def secret_spans(docs: DataFrame, b: Battery = Battery()) -> DataFrame:
    """docs' doc_id with n_assign, n_access, n_hex, base_spans, base_sha256, spans and tests: one row per row of docs.

    Spans are kind:start:end in code points, end exclusive, by start and then kind in the order of ORDER, comma-joined.
    Base: leftmost non-overlapping matches of each kind; assignments need a value of 8 characters. The kind `random`
    adds candidates that overlap no base span, that the battery takes for random, and whose symbols are more even than those
    of ordinary strings of their length, of which no more than b.rate are let through in each class of encoding and length.
    `tests` lists all spans with the encoding of their value and two p-values: that it is random, and that an
    ordinary string is as even; short strings and those of letters alone often look both. Null and empty texts have
    no spans. Repeated rows each get their own result; other columns are ignored; no ties: spans of a kind do not overlap.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    patterns = KINDS | {"random": CANDIDATE}
    rows = docs.select("doc_id", *[_found(text, p).alias(k) for k, p in patterns.items()])
    rows = cut(rows.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.concat(*[_named(k) for k in patterns]).alias("found")))
    each = rows.where(F.size("found") > 0).select("rid", F.posexplode("found").alias("i", "f")).select("rid", "i", "f.*")
    upto = Window.partitionBy("rid", "kind").orderBy("i")
    each = each.withColumn("end", F.sum(F.col("gap") + F.char_length("m")).over(upto)).withColumn("start", F.col("end") - F.char_length("m"))
    value = F.regexp_extract("m", ASSIGN, 2)
    token = F.regexp_replace(F.when(F.col("kind") == "assign", value).otherwise(F.col("m")), "[.=]", "").alias("token")
    each = each.where((F.col("kind") != "assign") | (F.char_length(value) >= 8)).select("rid", "kind", "start", "end", token)

    # base spans, and candidates that none of them overlaps
    base = F.col("kind") != "random"
    before = Window.partitionBy("rid").orderBy("start", base).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("rid").orderBy("start", base).rowsBetween(0, Window.unboundedFollowing)
    each = each.withColumn("reach", F.max(F.when(base, F.col("end"))).over(before)).withColumn("next", F.min(F.when(base, F.col("start"))).over(after))
    clear = (F.coalesce("reach", F.lit(0)) <= F.col("start")) & F.coalesce(F.col("next") >= F.col("end"), F.lit(True))
    each = battery(each.where(base | clear).drop("reach", "next"))
    each = cut(each.select("rid", "kind", "start", "end", "token", "encoding", "squares", "p"))
    shares = symbol_shares(each.where(~base), b.prior)
    tested = each.withColumn("z", ordinary(shares)).withColumn("even", _tail(-F.col("z"))).withColumn("length_class", F.floor(F.log2(F.greatest(F.char_length("token"), F.lit(1)))).cast("int"))
    size = F.floor(-10 * F.log10(F.greatest(F.col("even"), F.lit(1e-300))))
    tested = tested.withColumn("bin", F.least(F.greatest(size, F.lit(0)), F.lit(b.bins)).cast("int"))
    tested = tested.select("rid", "kind", "start", "end", "encoding", "length_class", "p", "even", "bin")
    least = even_enough(tested.where(~base), b)
    found = tested.join(F.broadcast(least), ["encoding", "length_class"], "left").where(base | (F.col("bin") >= F.col("least")) & (F.col("p") >= b.accept))

    rank = F.array_position(F.array(*[F.lit(k) for k in ORDER]), F.col("kind"))
    span = F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string"))
    shown = [F.coalesce(F.format_string(f, F.col(c)), F.lit("-")) for f, c in (("%s", "encoding"), ("%.4f", "p"), ("%.1e", "even"))]
    shown = [F.when(F.col("p").isNull(), F.lit("-")).otherwise(x) for x in shown]
    one = F.struct(F.col("start"), rank.alias("rank"), span.alias("s"), F.concat_ws(":", span, *shown).alias("t"))
    counts = [F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in KINDS]
    merged = found.groupBy("rid").agg(F.array_sort(F.collect_list(one)).alias("all"), *counts)

    def joined(a: Column, name: str = "s") -> Column:
        return F.array_join(F.transform(a, lambda x: x[name]), ",")

    out = rows.select("rid", "doc_id").join(merged, "rid", "left")
    none = F.lit("")
    base_spans = F.coalesce(joined(F.filter("all", lambda x: x["rank"] <= len(KINDS))), none)
    return out.select("doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS], base_spans.alias("base_spans"), F.sha2(base_spans, 256).alias("base_sha256"), F.coalesce(joined(F.col("all")), none).alias("spans"), F.coalesce(joined(F.col("all"), "t"), none).alias("tests"))
