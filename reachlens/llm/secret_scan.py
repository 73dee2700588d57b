"""Secrets in texts: known formats, and tokens that a battery of randomness tests cannot tell from random.

A token is a long run of characters that encodings use. Its encoding is inferred from its characters, every token has
one; over that alphabet it is tested for uniform letters (chi-squared), for runs of high and low letters (Wald and Wolfowitz) and for
serial correlation of neighbours. Fisher's method makes one p-value of the three. Ordinary text fails; a random key passes.

Many tokens are tested, and a random one must not be dismissed as text by chance. So within each encoding and class of
lengths (short tokens hold less evidence) the dismissals are controlled by Benjamini and Hochberg: of the tokens called text at
most the share ``rate`` is expected to be random. Ranks come from counts over a fixed grid of p-values, so a threshold
needs no sorted group. Everything is built from DataFrame functions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reachlens.llm import spans as S
from reachlens.session import materialize

# The contract's patterns. A hex or access match is a whole run, so its least length is part of the
# pattern; an assignment's match is consumed even if its value is too short, so that is tested afterwards.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}+"
KINDS = ("assign", "access", "hex", "random")

TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+"
ALPHABETS = {
    "hex": "0123456789abcdef",
    "letters": "abcdefghijklmnopqrstuvwxyz",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base38": "0123456789abcdefghijklmnopqrstuvwxyz-_",
    "mixed": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
# Encodings that use one case, upper or lower.
_ONE_CASE = ("hex", "letters", "base36", "base38")
_GRID = 300


@dataclass(frozen=True)
class Battery:
    """``rate``: share of random tokens among those dismissed; ``least_value``: of an assignment."""

    rate: float = 0.05
    least_value: int = 12
    classes: int = 12


def encoding(token: Column) -> Column:
    """The narrowest encoding whose alphabet explains the token; what no other explains is base64, in either variant."""
    digit = token.rlike("[0-9]")
    one_case = lambda more: token.rlike(f"^([a-z{more}]+|[A-Z{more}]+)$")
    return (
        F.when(digit & token.rlike("[a-f]") & token.rlike("^[0-9a-f]+$"), "hex")
        .when(digit & token.rlike("[A-F]") & token.rlike("^[0-9A-F]+$"), "hex")
        .when(one_case(""), "letters")
        .when(digit & token.rlike("[A-Z]") & token.rlike("^[A-Z2-7]+$"), "base32")
        .when(one_case("0-9"), "base36")
        .when(one_case("0-9_-"), "base38")
        .when(token.rlike("^[A-Za-z]+$"), "mixed")
        .otherwise("base64")
    )


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of the normal distribution, to 1e-7, by a rational approximation for z >= 0."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    # Coefficients of the approximation of the complementary error function.
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    tail = 0.5 * poly * F.exp(-x * x)
    return F.greatest(F.when(z >= 0, tail).otherwise(1 - tail), F.lit(1e-300))


def _codes(token: Column, name: Column) -> Column:
    """Places of the token's characters in its alphabet."""
    plain = F.when(name.isin(*_ONE_CASE), F.lower(token)).when(name == "base64", F.translate(token, "-_", "+/")).otherwise(token)
    alphabet = F.create_map(*[F.lit(x) for pair in ALPHABETS.items() for x in pair])[name]
    return F.transform(F.split(plain, ""), lambda c: F.position(c, alphabet) - 1)


def _tested(tokens: DataFrame) -> DataFrame:
    """Rows with ``token, encoding`` get the p-value of the battery."""
    size = F.create_map(*[x for k, v in ALPHABETS.items() for x in (F.lit(k), F.lit(len(v)))])[F.col("encoding")]
    df = tokens.withColumn("codes", _codes(F.col("token"), F.col("encoding"))).withColumn("a", size.cast("double"))
    df = df.withColumn("n", F.size("codes").cast("double"))
    # Sum of squared letter counts, in one pass over the sorted letters: the k-th of its kind adds 2 k - 1.
    first = F.struct(F.lit(-2).alias("last"), F.lit(0.0).alias("k"), F.lit(0.0).alias("sum"))

    def counted(acc: Column, c: Column) -> Column:
        k = F.when(c == acc["last"], acc["k"] + 1.0).otherwise(F.lit(1.0))
        return F.struct(c.alias("last"), k.alias("k"), (acc["sum"] + 2.0 * k - 1.0).alias("sum"))

    same = F.aggregate(F.array_sort("codes"), first, counted, lambda acc: acc["sum"])
    high = F.transform("codes", lambda c: c * 2 >= F.col("a"))
    df = df.withColumn("squares", same).withColumn("high", high)
    df = df.withColumn("ones", F.size(F.filter("high", lambda h: h)).cast("double"))
    pairs = F.sequence(F.lit(1), F.col("n").cast("int") - 1)
    df = df.withColumn("runs", 1.0 + F.size(F.filter(pairs, lambda i: F.get("high", i) != F.get("high", i - 1))))
    total = F.aggregate("codes", F.lit(0.0), lambda acc, c: acc + c)
    squared = F.aggregate("codes", F.lit(0.0), lambda acc, c: acc + c * c)
    lagged = F.aggregate(
        F.sequence(F.lit(0), F.col("n").cast("int") - 1),
        F.lit(0.0),
        lambda acc, i: acc + F.get("codes", i) * F.get("codes", F.pmod(i + 1, F.col("n").cast("int")).cast("int")),
    )
    df = df.withColumn("total", total).withColumn("squared", squared).withColumn("lagged", lagged)
    n, a, ones, zeros = F.col("n"), F.col("a"), F.col("ones"), F.col("n") - F.col("ones")
    chi = a / n * F.col("squares") - n
    z_letters = (chi - (a - 1)) / F.sqrt(2 * (a - 1) * (n - 1) / n)
    expected = 2 * ones * zeros / n + 1
    spread = (expected - 1) * (expected - 2) / (n - 1)
    z_runs = F.when(spread > 0, (F.col("runs") - expected) / F.sqrt(spread)).otherwise(F.lit(6.0))
    variation = F.col("squared") - F.col("total") ** 2 / n
    lag = (F.col("lagged") - F.col("total") ** 2 / n) / variation
    z_serial = F.when(variation > 0, (lag + 1 / (n - 1)) / F.sqrt(n * n / ((n - 1) ** 2 * (n - 2)))).otherwise(F.lit(6.0))
    logs = [F.log(_upper_tail(z_letters)), F.log(2 * _upper_tail(F.abs(z_runs))), F.log(2 * _upper_tail(F.abs(z_serial)))]
    df = df.withColumn("s", -(logs[0] + logs[1] + logs[2]))
    # Fisher: minus twice the sum of logs is chi-squared with six degrees of freedom, whose tail is closed.
    return df.withColumn("p", F.exp(-F.col("s")) * (1 + F.col("s") + F.col("s") ** 2 / 2))


def _scanned(docs: DataFrame, rule: Battery, id_column: str, text_column: str) -> DataFrame:
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    df = docs.select(F.col(id_column).cast("long").alias("doc_id"), text.alias("text"))
    for name, pattern in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("tokens", TOKEN)):
        df = S.with_matches(df, name, "text", pattern)
    value = lambda s: F.length(F.regexp_extract(s["match"], ASSIGN, 1))
    df = df.withColumn("assign", F.filter("assign", lambda s: value(s) >= rule.least_value))
    base = F.concat(*[S.named(F.col(kind), kind, i) for i, kind in enumerate(KINDS[:3])])
    df = df.withColumn("base", base)
    return df.select(
        "doc_id",
        *[F.size(kind).cast("long").alias(f"n_{kind}") for kind in KINDS[:3]],
        "base",
        S.apart(F.col("tokens"), F.col("base")).alias("tokens"),
    )


def _length_class(n: Column, rule: Battery) -> Column:
    """Two classes to a doubling of the length."""
    return F.least(F.floor(2 * F.log2(n / 20)), F.lit(rule.classes - 1)).cast("int")


def scan(docs: DataFrame, rule: Battery = Battery(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, found`` of every row of ``docs``.

    ``found`` has all spans as (start, order, end, kind), in code points. Tokens that pass the battery are added as
    ``random`` where they overlap no span of a known format. A null text is empty; repeated rows are reported each.
    """
    rows = materialize(
        _scanned(docs, rule, id_column, text_column).withColumn("row", F.monotonically_increasing_id()), "secrets"
    )
    tokens = rows.select("row", F.explode("tokens").alias("t")).select("row", "t.start", "t.end", F.col("t.match").alias("token"))
    judged = _tested(tokens.withColumn("encoding", encoding(F.col("token"))))
    judged = judged.withColumn("class", _length_class(F.col("n"), rule))
    judged = materialize(judged.select("row", "start", "end", "encoding", "class", "p"), "tokens")
    # Benjamini and Hochberg on a grid: bin b has the p-values up to exp(-b / 10).
    binned = judged.withColumn("bin", F.least(F.floor(-10 * F.log(F.greatest("p", F.lit(1e-300)))), F.lit(_GRID)).cast("int"))
    counts = binned.groupBy("encoding", "class", "bin").agg(F.count(F.lit(1)).alias("own"))
    stratum = Window.partitionBy("encoding", "class")
    ranked = counts.withColumn("upto", F.sum("own").over(stratum.orderBy(F.desc("bin")))).withColumn("all", F.sum("own").over(stratum))
    fits = F.exp(-F.col("bin") / 10) <= rule.rate * F.col("upto") / F.col("all")
    limits = ranked.where(fits).groupBy("encoding", "class").agg(F.min("bin").alias("dismissed"))
    # At most encodings times classes rows.
    kept = binned.join(F.broadcast(limits), ["encoding", "class"], "left").where(F.col("dismissed").isNull() | (F.col("bin") < F.col("dismissed")))
    random = kept.groupBy("row").agg(
        F.collect_list(F.struct("start", F.lit(3).alias("order"), "end", F.lit("random").alias("kind"))).alias("random")
    )
    told = rows.join(random, "row", "left").withColumn("found", F.array_sort(F.concat("base", F.coalesce("random", F.slice("base", 1, 0)))))
    return told.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(S.listed(F.col("base")), 256).alias("base_sha256"), S.listed(F.col("found")).alias("spans"), "found"
    )
