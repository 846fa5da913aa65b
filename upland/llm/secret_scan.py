"""Secret scans, in DataFrame expressions only.

Fixed patterns find assignments, access keys and long hex strings. Beside them every long token is put to a battery of
randomness tests in the encoding its letters suggest: a chi-squared test of a uniform alphabet, a runs test and a test
of serial correlation. A token counts as random when no test rejects, and it becomes a finding when it is also far more
even than text of its length would be, at a false-discovery rate held per encoding and length class over all tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from upland.llm.common import stash, text_of

# fixed values: the base patterns
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_HINT = r"(?i)passw|secret|token|api_?key"
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")

TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
RATE = 0.05                      # expected share of false findings in each class
PASS = 0.01                      # a token fails the battery under this p, after Bonferroni
LENGTHS = (20, 32, 48, 96)       # lower ends of the length classes
EXCESS = {"hex": 0.6, "base64": 1.3}   # how uneven text is over 16 bins: 16 * sum(p * p) - 1; digits in hex, letters in base64
STEPS, BINS = 20, 800            # p-values are rounded up to 1 / STEPS of a decade
BLOCK = 64


def running_sums(values: Column) -> Column:
    """Prefix sums of an array, in blocks, so that long arrays don't cost the square of their size."""
    n = F.size(values)
    blocks = F.transform(F.sequence(F.lit(0), F.ceil(n / BLOCK).cast("int") - 1), lambda b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK)))
    plus = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    sums = F.transform(blocks, plus)
    inner = F.transform(blocks, lambda x, b: F.transform(x, lambda v, i: plus(F.slice(sums, F.lit(1), b)) + plus(F.slice(x, F.lit(1), i + 1))))
    return F.when(n > 0, F.flatten(inner)).otherwise(F.array().cast("array<bigint>"))


def places(df: DataFrame, text: str, pattern: str, hint: Column, out: str, group: int = 0) -> DataFrame:
    """Add a column of (start, end, found) for the leftmost non-overlapping matches, in code points. Splitting by the
    pattern gives the gaps between the matches, and gaps and matches in turn give the places."""
    none = F.array().cast("array<string>")
    df = df.withColumn(f"{out}_m", F.when(hint, F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).otherwise(none))
    some = F.size(f"{out}_m") > 0
    df = df.withColumn(f"{out}_g", F.when(some, F.transform(F.split(F.col(text), pattern, -1), lambda x: F.length(x).cast("long"))).otherwise(F.array().cast("array<bigint>")))
    if group:
        df = df.withColumn(f"{out}_f", F.when(some, F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(group))).otherwise(none))
    df = df.withColumn(f"{out}_l", F.transform(f"{out}_m", lambda x: F.length(x).cast("long")))
    df = df.withColumn(f"{out}_g", F.zip_with(F.slice(f"{out}_g", F.lit(1), F.size(f"{out}_l")), f"{out}_l", lambda g, m: g + m))
    df = df.withColumn(f"{out}_e", running_sums(F.col(f"{out}_g")))
    found = f"{out}_f" if group else f"{out}_m"
    df = df.withColumn(out, F.transform(F.arrays_zip(F.col(f"{out}_e").alias("e"), F.col(f"{out}_l").alias("l"), F.col(found).alias("f")),
                                        lambda x: F.struct((x["e"] - x["l"]).alias("start"), x["e"].alias("end"), x["f"].alias("found"))))
    return df.drop(*[f"{out}_{c}" for c in "mgfle"])


# ---------------------------------------------------------------- the battery


def tail(z: Column) -> Column:
    """Upper tail of the standard normal distribution, by a rational approximation good to 1e-7."""
    x = F.least(F.abs(z), F.lit(37.0))
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    up = F.exp(-x * x / 2) / 2.5066282746310002 * poly
    return F.when(z >= 0, up).otherwise(1 - up)


def battery(token: Column) -> Column:
    """struct(stratum, level): the class of the token, and -STEPS * log10 of its p-value as text, -1 where a test of
    randomness rejects it."""
    n = F.length(token)
    hexa = token.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")
    code = F.transform(F.sequence(F.lit(1), n), lambda i: F.ascii(F.substring(token, i, F.lit(1))))
    as_hex = lambda c: F.when(c < 58, c - 48).otherwise(c.bitwiseOR(F.lit(32)) - 87)
    as_64 = lambda c: F.when(c >= 97, c - 71).when(c == 95, 63).when(c >= 65, c - 65).when(c >= 48, c + 4).when((c == 43) | (c == 45), 62).otherwise(63)
    sym = F.when(hexa, F.transform(code, as_hex)).otherwise(F.transform(code, as_64))
    return F.struct(n.alias("n"), hexa.alias("hexa"), sym.alias("sym"))


def levels(df: DataFrame, column: str) -> DataFrame:
    """Replace an array of (start, end, found) by (start, end, stratum, level)."""
    df = df.withColumn(column, F.transform(column, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), battery(x["found"]).alias("t"))))

    def counts(x):
        t = x["t"]
        n, sym, hexa = t["n"].cast("double"), t["sym"], t["hexa"]
        width = F.when(hexa, 1).otherwise(4)
        squares = F.aggregate(F.sequence(F.lit(0), F.lit(15)), F.lit(0.0), lambda a, b: a + F.pow(F.size(F.filter(sym, lambda s: F.floor(s / width) == b)).cast("double"), F.lit(2)))
        high = F.size(F.filter(sym, lambda s: s >= 8 * width)).cast("double")
        pairs = F.zip_with(F.slice(sym, F.lit(1), F.size(sym) - 1), F.slice(sym, F.lit(2), F.size(sym) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        turns = F.size(F.filter(pairs, lambda p: (p["a"] >= 8 * width) != (p["b"] >= 8 * width))).cast("double")
        total = lambda f: F.aggregate(sym, F.lit(0.0), lambda a, s: a + f(s.cast("double")))
        cross = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + p["a"] * p["b"])
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), n.alias("n"), hexa.alias("hexa"), squares.alias("sq"), high.alias("hi"), turns.alias("turns"), total(lambda s: s).alias("sum"),
                        total(lambda s: s * s).alias("sum2"), cross.alias("cross"), F.element_at(sym, 1).alias("first"), F.element_at(sym, -1).alias("last"))

    def verdict(x):
        n, hi = x["n"], x["hi"]
        chi = 16 * x["sq"] / n - n
        p_chi = tail((F.pow(chi / 15, F.lit(1 / 3)) - (1 - 2 / 135)) / (2 / 135) ** 0.5)
        both = 2 * hi * (n - hi)
        spread = both * (both - n) / (n * n * (n - 1))
        p_runs = F.when(spread > 0, 2 * tail(F.abs((x["turns"] - both / n) / F.sqrt(spread)))).otherwise(0.0)
        mean = x["sum"] / n
        var = x["sum2"] - n * mean * mean
        lagged = x["cross"] - mean * (2 * x["sum"] - x["first"] - x["last"]) + (n - 1) * mean * mean
        p_lag = F.when(var > 0, 2 * tail(F.abs((lagged / var + 1 / n) * F.sqrt(n)))).otherwise(0.0)
        excess = n * F.when(x["hexa"], EXCESS["hex"]).otherwise(EXCESS["base64"])
        p_text = tail(-(chi - 15 - excess) / F.sqrt(2 * (15 + 2 * excess)))
        level = F.least(F.floor(-F.log10(F.greatest(p_text, F.lit(1e-300))) * STEPS), F.lit(BINS)).cast("int")
        size = sum((F.when(n >= low, 1).otherwise(0) for low in LENGTHS), F.lit(0))
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), (size * 2 + F.when(x["hexa"], 1).otherwise(0)).alias("stratum"),
                        F.when(3 * F.least(p_chi, p_runs, p_lag) >= PASS, level).otherwise(-1).alias("level"))

    return df.withColumn(column, F.transform(column, counts)).withColumn(column, F.transform(column, verdict))


def cuts(tokens: DataFrame, rate: float = RATE) -> dict[int, int]:
    """Benjamini-Hochberg on rounded p-values: per class, the lowest level at which p * tokens / findings is within the
    rate. A class has at most BINS + 2 different levels, so what the driver reads has a fixed bound."""
    per = tokens.groupBy("stratum", "level").agg(F.count("*").alias("n")).collect()
    out = {}
    for s in {r["stratum"] for r in per}:
        own = sorted(((r["level"], r["n"]) for r in per if r["stratum"] == s), reverse=True)
        total, above = sum(n for _, n in own), 0
        for level, n in own:
            above += n
            if level >= 0 and 10 ** (-level / STEPS) * total / above <= rate:
                out[s] = level
    return out


def scan(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """One row per document: doc_id and arrays assign, access, hex and random of (start, end), in code points.

    A null text has no findings; repeated rows are scanned alike; an empty table gives no rows; other columns are not
    looked at. Places of one kind never overlap; those of different kinds may."""
    text = text_of(docs)
    df = docs.select(docs["doc_id"].alias("doc_id"), text.alias("text"))
    df = places(df, "text", ASSIGN, F.col("text").rlike(ASSIGN_HINT), "assign", 2)
    df = places(df, "text", ACCESS, F.col("text").contains("AKIA"), "access")
    df = places(df, "text", HEX, F.lit(True), "hex")
    df = places(df, "text", TOKEN, F.lit(True), "random")
    df = df.withColumn("assign", F.filter("assign", lambda x: F.length(x["found"]) >= 8)).drop("text")
    df = levels(df, "random")
    place = lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))
    df = stash(df.select("doc_id", *[F.transform(c, place).alias(c) for c in KINDS[:3]], "random"))
    cut = cuts(df.select(F.explode("random").alias("t")).select("t.*"), rate)
    limit = F.array(*[F.lit(cut.get(s, BINS + 1)) for s in range(2 * len(LENGTHS) + 2)])
    found = F.filter("random", lambda x: x["level"] >= F.element_at(limit, x["stratum"] + 1))
    return df.select("doc_id", *KINDS[:3], F.transform(found, place).alias("random"))


def listed(kinds) -> Column:
    """kind:start:end by start, then kind in the order given, comma-joined."""
    def tagged(i):
        return F.transform(KINDS[i], lambda x: F.struct(x["start"].alias("s"), F.lit(i).alias("k"), x["end"].alias("e")))

    rows = [tagged(KINDS.index(k)) for k in kinds]
    name = lambda x: F.element_at(F.array(*[F.lit(k) for k in KINDS]), x["k"] + 1)
    return F.array_join(F.transform(F.array_sort(F.concat(*rows)), lambda x: F.concat_ws(":", name(x), x["s"], x["e"])), ",")


def digest(found: DataFrame) -> DataFrame:
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(F.encode(listed(KINDS[:3]), "UTF-8"), 256).alias("base_sha256"), listed(KINDS).alias("spans"))
