"""Secret scans with a battery of randomness tests (operator 6, native).

Three fixed kinds are found by pattern.  Beyond them, long tokens get an encoding
inferred from their characters, the narrowest alphabet that holds them all: decimal, hex,
base26 (small letters), base32, base36, base62 or base64.  Per encoding, a chi-squared
test of even use of the alphabet (from exact tables up to ``EXACT`` characters, where the
usual approximation fails), a runs test about its middle and a lag-1 serial correlation
test give one p-value of "is random" (the least of three, corrected for being that).

Few tests speak against a short token, so what bounds false alarms is a comparison: each
token has ``DECOYS`` decoys, as long, cut out of the ordinary text of its own document and
written in the token's alphabet.  For each encoding and class of lengths, tokens with a
p-value over a bound are reported, the bound being the least at which the ordinary strings
expected over it are at most ``FALSE_DISCOVERY`` of the tokens over it; and never under
``LEVEL``, the level at which the tests themselves reject a token.  How many are expected
follows from the decoys: the share of them over the bound, or that of a normal law with
the mean and spread of their log p-values, whichever is more, times the ordinary strings
among the stratum's tokens.  Those are told by how many tokens have p-values under
``LOW``, where random ones have few and decoys have many (one more is counted, so that a
few tokens prove nothing).  So the share that is controlled (by an estimate) is that of ordinary strings
among those reported.  The control needs counts and sums of p-values in ``BINS`` bins a
stratum, which is all that reaches the driver.  Where documents with tokens hold no
ordinary text, the bound is ``LEVEL``.

A '=' inside a run ends one token and begins the next: in NAME=value the value is tested
by itself, and the name as any other token.  Not tested: tokens of fewer than 20
characters with their padding, or 16 without it.

Positions are code points, ends exclusive: gaps between matches (split) and matches
(extract all) alternate, so their lengths add up to positions.

Defined cases: null and empty texts have no spans; rows with one doc_id are scanned
each; a corpus without tokens needs no control; an empty table gives an empty result;
spans that begin at one place (a tie) go by kind as listed; of a very long text the JVM
holds the arrays of its tokens and spans in one row; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, stage, work_dir

#: Share of ordinary strings among the tokens reported, as the decoys tell.
FALSE_DISCOVERY = 0.05
#: A token whose p-value is under this is not random, whatever the decoys say.
LEVEL = 0.01
BINS = 200
#: P-values under this tell how many of a stratum's tokens are ordinary.
LOW = 0.05
#: Ordinary strings that each token is held against.
DECOYS = 4
#: Log p-values under this count as this.
_LEAST_LOG_P = -40.0
#: Least number of characters of each class of lengths.
CLASSES = [16, 24, 32, 48, 64]
#: Tokens up to this length have exact chi-squared tables.
EXACT = 64

# The base patterns.
_ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_ACCESS = r"AKIA[A-Z0-9]{12,}"  # AKIA and all of its run, 16 or more characters
_HEX = r"[0-9a-f]{32,}"  # whole runs of 32 or more
# 20 or more characters; a '=' is padding at the end of a token and a border before the next, so NAME=value is two tokens.
_CHAR = r"[A-Za-z0-9+/_-]"
_TOKEN = rf"(?<!{_CHAR})(?:(?=[A-Za-z0-9+/_=-]{{20}}){_CHAR}{{16,}}+=++(?!{_CHAR})|{_CHAR}{{20,}}+)"
_BASE_KINDS = ["assign", "access", "hex"]
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Encodings from narrow to wide: what all characters are, the alphabet, and how a token is spelt in it.
_ENCODINGS = {
    "random_decimal": ("^[0-9]+$", _DIGITS, F.lower),
    "random_hex": ("^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef", F.lower),
    "random_base26": ("^[a-z]+$", _LOWER, F.lower),
    "random_base32": ("^[A-Z2-7]+$", _UPPER + "234567", F.upper),
    "random_base36": ("^([0-9a-z]+|[0-9A-Z]+)$", _DIGITS + _LOWER, F.lower),
    "random_base62": ("^[0-9A-Za-z]+$", _UPPER + _LOWER + _DIGITS, lambda c: c),
    "random_base64": ("^.+$", _UPPER + _LOWER + _DIGITS + "+/", lambda c: F.translate(c, "-_", "+/")),
}
_KINDS = [*_BASE_KINDS, *_ENCODINGS]

_SPAN = "array<struct<start:int,rank:int,kind:string,end:int,token:string>>"
_BLOCK = 64



def _matches(text: Column, pattern: str, kind: str, value_group: int = 0, least: int = 0) -> Column:
    """Spans of a pattern; those whose value group has fewer than ``least`` characters are dropped.

    A position is a sum of lengths before it: over whole blocks of matches, and inside its own.
    """
    p = F.lit(pattern)
    gaps, whole, value = F.split(text, pattern, -1), F.regexp_extract_all(text, p, 0), F.regexp_extract_all(text, p, value_group)
    both = F.zip_with(gaps, F.zip_with(whole, value, lambda m, v: F.struct(m.alias("m"), F.length(v).alias("v"))), lambda g, x: F.struct(F.length(g).alias("g"), x["m"].alias("m"), x["v"].alias("v")))
    found = F.filter(both, lambda x: x["m"].isNotNull())

    def length_of(xs: Column) -> Column:
        return F.aggregate(xs, F.lit(0), lambda acc, x: acc + x["g"] + F.length(x["m"]))

    blocks = F.sequence(F.lit(0), F.floor(F.size(found) / _BLOCK).cast("int"))
    sums = lambda xs: F.aggregate(
        blocks, F.array(F.lit(0)), lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + length_of(F.slice(xs, b * _BLOCK + 1, F.lit(_BLOCK)))))
    )

    def span(xs: Column, before: Column, x: Column, i: Column) -> Column:
        block = F.floor(i / _BLOCK).cast("int")
        begin = F.get(before, block) + length_of(F.slice(xs, block * _BLOCK + 1, i % _BLOCK)) + x["g"]
        token = x["m"] if kind == "token" else F.lit(None).cast("string")
        rank = F.lit(_KINDS.index(kind) if kind in _KINDS else len(_KINDS))
        return F.struct(
            begin.cast("int").alias("start"), rank.alias("rank"), F.lit(kind).alias("kind"), (begin + F.length(x["m"])).cast("int").alias("end"), token.alias("token"), x["v"].alias("v")
        )

    # Each array is made once and handed to the lambda.
    spans = F.flatten(F.transform(F.array(found), lambda xs: F.flatten(F.transform(F.array(sums(xs)), lambda before: F.transform(xs, lambda x, i: span(xs, before, x, i))))))
    kept = F.transform(
        F.filter(spans, lambda x: x["v"] >= least), lambda x: F.struct(*(x[c].alias(c) for c in ("start", "rank", "kind", "end", "token")))
    )
    return F.when(text.rlike(pattern), kept.cast(_SPAN)).otherwise(F.array().cast(_SPAN))


@lru_cache(maxsize=16)
def collision_tails(k: int, longest: int = EXACT) -> list[np.ndarray]:
    """For each length n up to ``longest``: P(at least c equal pairs among n random characters of k), c = 0, 1, ...

    Pairs of equal characters are the chi-squared statistic but for a scale.  One character's
    share is Poisson, so the distribution is the k-th power of a polynomial in (characters,
    pairs), read off where the characters add up to n.
    """
    mean, pairs = longest * 0.6 / k, longest * (longest - 1) / 2
    cap = int(min(pairs, pairs / k + 14 * np.sqrt(pairs / k) + 20))
    one = np.zeros((longest + 1, cap + 1))
    weight = np.exp(-mean)
    for c in range(longest + 1):
        if c * (c - 1) // 2 <= cap:
            one[c, c * (c - 1) // 2] = weight
        weight *= mean / (c + 1)
    shape = (2 * longest + 2, 2 * cap + 2)

    def times(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.maximum(np.fft.irfft2(np.fft.rfft2(x, shape) * np.fft.rfft2(y, shape), shape)[: longest + 1, : cap + 1], 0)

    power, square, left = None, one, k
    while left:
        if left % 2:
            power = square if power is None else times(power, square)
        left //= 2
        square = times(square, square) if left else square
    mu = k * mean
    out = []
    for n in range(longest + 1):
        log_all = n * np.log(mu) - mu - float(np.sum(np.log(np.arange(1, n + 1))))
        below = np.concatenate([[0.0], np.cumsum(power[n])]) / np.exp(log_all)
        out.append(np.clip(1 - below, 0, 1))
    return out


def _tables(df: DataFrame) -> DataFrame:
    """kind, size, tail: one row an encoding and length, a few hundred rows by definition."""
    rows = [(kind, n, [float(x) for x in collision_tails(len(alphabet))[n]]) for kind, (_, alphabet, _) in _ENCODINGS.items() for n in range(CLASSES[0], EXACT + 1)]
    return df.sparkSession.createDataFrame(rows, "kind string, size int, tail array<double>")


def _two_sided(z: Column) -> Column:
    """P(|N| > |z|), by a rational approximation of the complementary error function."""
    x = F.abs(z) / F.lit(2**0.5)
    t = 1 / (1 + F.lit(0.3275911) * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.greatest(poly * F.exp(-x * x), F.lit(1e-300))


def inferred(bare: Column) -> Column:
    """The encoding of a token without its padding."""
    kind = F.lit(None).cast("string")
    for name, (pattern, _, _) in reversed(_ENCODINGS.items()):
        kind = F.when(bare.rlike(pattern), name).otherwise(kind)
    return kind


def spelt(kind: Column, bare: Column) -> Column:
    """A token in the characters of its alphabet."""
    out = bare
    for name, (_, _, write) in _ENCODINGS.items():
        out = F.when(kind == name, write(bare)).otherwise(out)
    return out


def in_alphabet(kind: Column, plain: Column) -> Column:
    """Letters and digits of ordinary text in an encoding's alphabet, letters by their place modulo its size."""
    out = plain
    for name, alphabet in (("random_decimal", _DIGITS), ("random_hex", "0123456789abcdef")):
        letters = "".join(alphabet[i % len(alphabet)] for i in range(26))
        out = F.when(kind == name, F.translate(F.lower(plain), _LOWER, letters)).otherwise(out)
    out = F.when(kind == "random_base26", F.translate(F.lower(plain), _DIGITS, _LOWER[:10])).otherwise(out)
    out = F.when(kind == "random_base32", F.translate(F.upper(plain), "0189", "OIBG")).otherwise(out)
    return F.when(kind == "random_base36", F.lower(plain)).otherwise(out)


def battery(tokens: DataFrame) -> DataFrame:
    """Adds symbols and p (of "is random") to rows with kind and s, a string over the alphabet of the kind."""
    df = tokens
    alphabet = F.create_map(*[F.lit(x) for kind, (_, a, _) in _ENCODINGS.items() for x in (kind, a)])[F.col("kind")]
    df = df.withColumn("alphabet", alphabet).withColumn("size", F.length("s")).withColumn("n", F.col("size").cast("double")).withColumn("k", F.length("alphabet").cast("double"))
    df = df.join(F.broadcast(_tables(df)), ["kind", "size"], "left").withColumn("letters", F.regexp_extract_all("alphabet", F.lit("."), 0))
    counts = F.transform("letters", lambda c: F.col("n") - F.length(F.replace(F.col("s"), c, F.lit(""))))
    df = df.withColumn("squares", F.aggregate(counts, F.lit(0.0), lambda acc, c: acc + c * c))
    df = df.withColumn("chi2", F.col("k") / F.col("n") * F.col("squares") - F.col("n"))
    codes = F.transform(F.regexp_extract_all("s", F.lit("."), 0), lambda c: F.instr(F.col("alphabet"), c).cast("double") - 1)
    zero = {"prev": -1.0, "first": -1.0, "sum": 0.0, "sq": 0.0, "xy": 0.0, "runs": 0.0, "high": 0.0}
    start = F.struct(*(F.lit(v).alias(c) for c, v in zero.items()))

    def step(acc, x):
        up, was = x * 2 >= F.col("k"), acc["prev"] * 2 >= F.col("k")
        fresh = acc["prev"] < 0
        return F.struct(
            x.alias("prev"), F.when(fresh, x).otherwise(acc["first"]).alias("first"), (acc["sum"] + x).alias("sum"), (acc["sq"] + x * x).alias("sq"),
            (acc["xy"] + F.when(fresh, 0.0).otherwise(acc["prev"] * x)).alias("xy"),
            (acc["runs"] + F.when(fresh | (up != was), 1.0).otherwise(0.0)).alias("runs"), (acc["high"] + F.when(up, 1.0).otherwise(0.0)).alias("high"),
        )

    df = df.withColumn("f", F.aggregate(codes, start, step))
    n, f, d = F.col("n"), F.col("f"), F.col("k") - 1
    wilson = (F.pow(F.col("chi2") / d, F.lit(1 / 3)) - (1 - 2 / (9 * d))) / F.sqrt(2 / (9 * d))
    # Only uneven use speaks against.  Beyond the table's last entry a count is as good as impossible.
    far = F.when(wilson <= 0, 1 - _two_sided(wilson) / 2).otherwise(_two_sided(wilson) / 2)
    pairs = ((F.col("squares") - n) / 2).cast("int")
    p_chi = F.when(F.col("tail").isNotNull(), F.coalesce(F.get("tail", pairs), F.lit(0.0))).otherwise(far)
    mu = 2 * f["high"] * (n - f["high"]) / n + 1
    var = (mu - 1) * (mu - 2) / (n - 1)
    p_runs = F.when(var > 0, _two_sided((f["runs"] - mu) / F.sqrt(F.greatest(var, F.lit(1e-9))))).otherwise(1e-300)
    mean = f["sum"] / n
    spread = f["sq"] - n * mean * mean
    corr = (f["xy"] - mean * (2 * f["sum"] - f["first"] - f["prev"]) + (n - 1) * mean * mean) / F.greatest(spread, F.lit(1e-9))
    p_serial = F.when(spread > 0, _two_sided((corr + 1 / n) * F.sqrt(n))).otherwise(1e-300)
    least = F.greatest(F.lit(0.0), F.least(p_chi, p_runs, p_serial))
    return df.withColumn("p", 1 - F.pow(1 - least, F.lit(3.0))).withColumn("symbols", F.col("size"))


def _class_of(symbols: Column) -> Column:
    out = F.lit(0)
    for i, least in enumerate(CLASSES):
        out = F.when(symbols >= least, i).otherwise(out)
    return out


def bounds(tested: DataFrame, rate: float = FALSE_DISCOVERY) -> dict[tuple[str, int], float]:
    """For each encoding and class of lengths the p-value over which tokens are reported (see the module)."""
    level = F.least(F.lit(BINS - 1), F.floor(F.col("p") * BINS)).cast("int")
    log_p = F.greatest(F.lit(_LEAST_LOG_P), F.log(F.greatest(F.col("p"), F.lit(1e-300))))
    # Strata x 2 x BINS rows at most.
    rows = tested.groupBy("kind", _class_of(F.col("symbols")).alias("class"), "decoy", level.alias("level")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(log_p).alias("sum"), F.sum(log_p * log_p).alias("squares")
    )
    seen: dict[tuple[str, int], np.ndarray] = {}
    for r in rows.collect():
        seen.setdefault((r["kind"], r["class"]), np.zeros((2, 3, BINS)))[int(r["decoy"]), :, r["level"]] = r["n"], r["sum"], r["squares"]
    out = {}
    for stratum, (tokens, decoys) in seen.items():
        over = tokens[0][::-1].cumsum()[::-1]
        share, ordinary = np.zeros(BINS), over[0]
        if n := decoys[0].sum():
            low = int(LOW * BINS)
            of_decoys = decoys[0][:low].sum() / n
            if of_decoys > 2 * LOW:
                ordinary = min(over[0], (tokens[0][:low].sum() + 1 - LOW * over[0]) / (of_decoys - LOW))
            mean, mean_square = decoys[1].sum() / n, decoys[2].sum() / n
            spread = max(np.sqrt(max(mean_square - mean * mean, 0.0)), 1.0)
            normal = [0.5 * math.erfc((math.log(max(i, 0.5) / BINS) - mean) / spread / math.sqrt(2)) for i in range(BINS)]
            share = np.maximum(decoys[0][::-1].cumsum()[::-1] / n, normal)
        fine = [i for i in range(int(LEVEL * BINS), BINS) if over[i] and share[i] * max(ordinary, 0) <= rate * over[i]]
        out[stratum] = min(fine) / BINS if fine else 2.0
    return out


def scan(docs: DataFrame, rate: float = FALSE_DISCOVERY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, spans (start, rank, kind, end), in order of start and kind."""
    work = work_dir(docs.sparkSession, "secrets")
    text = F.col("text")
    rows = id_text(docs, id_col, text_col).select("doc_id", F.monotonically_increasing_id().alias("uid"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select(
        "doc_id", "uid",
        F.concat(_matches(text, _ASSIGN, "assign", 2, 8), _matches(text, _ACCESS, "access"), _matches(text, _HEX, "hex")).alias("base"),
        _matches(text, _TOKEN, "token").alias("tokens"),
        # Ordinary text: letters and digits outside long tokens; wanted only where there is a token.
        F.when(text.rlike(_TOKEN), F.regexp_replace(F.regexp_replace(text, _TOKEN, ""), "[^A-Za-z0-9]+", "")).otherwise("").alias("plain"),
    )
    size = lambda t: F.length(F.regexp_replace(t["token"], "=+$", ""))
    place = lambda t, i: 1 + F.pmod(F.xxhash64(F.lit(i), t["start"], t["token"]), F.greatest(F.length("plain") - size(t) + 1, F.lit(1)).cast("long")).cast("int")
    cuts = lambda t: F.array(*[F.substring(F.col("plain"), place(t, i), size(t)) for i in range(DECOYS)])
    clear = lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))
    paired = F.transform(F.filter("tokens", clear), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), t["token"].alias("token"), cuts(t).alias("decoys")))
    rows = stage(rows.select("doc_id", "uid", "base", paired.alias("tokens")), f"{work}/rows")
    bare = F.regexp_replace("t.token", "=+$", "")
    tokens = rows.select("uid", F.explode("tokens").alias("t")).select("uid", "t.start", "t.end", bare.alias("bare"), inferred(bare).alias("kind"), F.col("t.decoys").alias("plain"))
    kind = F.col("kind")
    own = F.array(F.struct(F.lit(False).alias("decoy"), spelt(kind, F.col("bare")).alias("s")))
    decoys = F.transform("plain", lambda x: F.struct(F.lit(True).alias("decoy"), F.when(F.length(x) == F.length("bare"), in_alphabet(kind, x)).alias("s")))
    both = tokens.select("uid", "start", "end", "kind", F.explode(F.concat(own, decoys)).alias("x")).select("uid", "start", "end", "kind", "x.*").where("s is not null and length(s) >= 16")
    tested = stage(battery(both).select("uid", "start", "end", "kind", "decoy", "symbols", "p"), f"{work}/tested")
    least = F.lit(2.0)  # a few dozen strata
    for (name, class_), bound in sorted(bounds(tested, rate).items()):
        least = F.when((kind == name) & (_class_of(F.col("symbols")) == class_), bound).otherwise(least)
    names = F.array(*map(F.lit, _KINDS))
    random = tested.where(~F.col("decoy") & (F.col("p") >= least)).select(
        "uid", F.struct("start", (F.array_position(names, kind) - 1).cast("int").alias("rank"), "kind", "end", F.lit(None).cast("string").alias("token")).alias("span")
    )
    random = random.groupBy("uid").agg(F.collect_list("span").alias("more"))
    return rows.join(random, "uid", "left").select(
        "doc_id", F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(_SPAN)))).alias("spans")
    )


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (text)."""
    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["rank"] < len(_BASE_KINDS))
    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [number(k) for k in _BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
