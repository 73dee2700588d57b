"""Personal data in texts: known formats, and looser candidates judged by aggregated weak labels.

Candidates are spans of known formats and of looser patterns. Five labelers vote on each for, against or not at all: the
strict format, a checksum or value range, gazetteers of endings and prefixes, cue words in the text before, and the
characters around it. Expectation-maximisation over the counts of vote patterns estimates how often each labeler is right,
per kind, and gives every pattern a probability. With these as soft labels a naive Bayes span classifier is trained on
features of the span itself; it decides on the candidates that no known format covers.

Only counts of vote patterns and of feature values leave the cluster: a few thousand numbers whatever the corpus.
Everything on the rows is built from DataFrame functions.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reachlens.llm import spans as S
from reachlens.session import materialize

# The contract's patterns. Quantifiers are possessive and starts are tied to where the plain patterns can
# start (a run's first character, or the end of the match before), so no run is tried from each of its characters. A card
# is a whole run of digits, so its least number of digits is part of the pattern.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = ("email", "ip", "card", "phone")
# Looser candidates: written-out addresses, numbers without a country prefix, long numbers, bank accounts.
LOOSE = {
    "email_like": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]{1,63}+\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z]{2,24}",
    "phone_like": r"(?<![0-9+.-])(?:\([0-9]{3}\)|[0-9]{3})[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
    "number_like": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){8,18}+(?![0-9])(?![\x20-][0-9])",
    "account_like": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?![A-Za-z0-9])",
}
KINDS = (*BASE, *LOOSE)
# Gazetteers.
ENDINGS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu", "it", "nl", "ch", "at")
CUES = {
    "email": "mail|correo|courriel|contact|kontakt|schreib|write|escrib",
    "ip": "ip|host|server|addr|adress|direcci",
    "card": "card|karte|tarjeta|carte|visa|master|pay|zahl|pago",
    "phone": "phone|tel|call|fon|mobil|cell|appel|llam|ruf",
}
_FAMILY = {"email": "email", "ip": "ip", "card": "card", "phone": "phone", "email_like": "email", "phone_like": "phone", "number_like": "card", "account_like": "card"}
LABELERS = ("format", "check", "gazetteer", "context", "border")
_CANDIDATE = "array<struct<start:int,order:int,end:int,kind:string,match:string,before:string,after:string>>"


@dataclass(frozen=True)
class Weak:
    """``rounds`` of expectation-maximisation; characters of context; odds from which a span counts."""

    rounds: int = 60
    before: int = 40
    after: int = 8
    least: float = 0.5


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""

    def add(acc: Column, i: Column) -> Column:
        digit = F.substr(number, F.length(number) - i, F.lit(1)).cast("int")
        doubled = digit * 2 - F.when(digit > 4, 9).otherwise(0)
        return acc + F.when(i % 2 == 1, doubled).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(0), F.length(number) - 1), F.lit(0), add) % 10 == 0


def _small(part: Column) -> Column:
    """Whether a string of digits is at most 255."""
    plain = F.regexp_replace(part, "^0+", "")
    return (F.length(plain) < 3) | ((F.length(plain) == 3) & (plain <= "255"))


def _valid(name: str) -> Callable[[Column], Column]:
    """The test that a match of a known format must pass."""

    def test(s: Column) -> Column:
        number = digits(s["match"])
        if name == "ip":
            return F.forall(F.split(s["match"], "[.]"), _small)
        if name == "card":
            return F.when(F.length(number).between(12, 19), luhn(number)).otherwise(False)
        if name == "phone":
            return F.length(number).between(9, 15)
        return F.lit(True)

    return test


def _of(kind: str) -> Callable[[Column], Column]:
    return lambda c: c["kind"] == kind


def _candidates(spans: Column, pieces: Column, kind: str, rule: Weak) -> Column:
    """Spans with their kind and what stands around them, cut from the text in chunks."""

    def one(s: Column) -> Column:
        return F.struct(
            s["start"].alias("start"),
            F.lit(KINDS.index(kind)).alias("order"),
            s["end"].alias("end"),
            F.lit(kind).alias("kind"),
            s["match"].alias("match"),
            F.lower(S.part(pieces, F.greatest(s["start"] - rule.before, F.lit(0)), s["start"])).alias("before"),
            S.part(pieces, s["end"], s["end"] + rule.after).alias("after"),
        )

    return F.transform(spans, one)


def _scanned(df: DataFrame, text: str, rule: Weak) -> DataFrame:
    """``df`` with ``base`` and ``loose``: candidates of known formats, and others that overlap none of those."""
    for name, pattern in (("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE), *LOOSE.items()):
        df = S.with_matches(df, f"__{name}", text, pattern)
    found = {name: F.filter(f"__{name}", _valid(name)) for name in BASE}
    any_found = F.lit(False)
    for name in KINDS:
        any_found = any_found | (F.size(f"__{name}") > 0)
    none = F.array().cast(_CANDIDATE)

    def around(names: tuple[str, ...], spans: dict[str, Column]) -> Column:
        return S.bound(S.chunks(F.col(text)), lambda pieces: F.concat(*[_candidates(spans[name], pieces, name, rule) for name in names]))

    df = df.withColumn("base", F.when(any_found, around(BASE, found)).otherwise(none))
    loose = around(tuple(LOOSE), {name: F.col(f"__{name}") for name in LOOSE})
    loose = S.apart(F.when(any_found, loose).otherwise(none), F.col("base"))
    df = df.withColumn("loose", F.when(F.size("base") >= 0, loose).cast(_CANDIDATE))
    return df.drop(*[f"__{name}" for name in KINDS])


def votes(c: Column) -> dict[str, Column]:
    """The labelers' votes on a candidate: 1 for, -1 against, 0 none."""
    match, kind, number = c["match"], c["kind"], digits(c["match"])
    sign = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    family = F.create_map(*[F.lit(x) for pair in _FAMILY.items() for x in pair])[kind]
    email, phone, ip, card = (family == name for name in ("email", "phone", "ip", "card"))
    cues = F.coalesce(*[F.when(family == name, c["before"].rlike(f"({words})[^.!?]*$")) for name, words in CUES.items()])
    ending = F.lower(F.regexp_extract(match, r"([A-Za-z]+)$", 1))
    return {
        "format": sign(kind.isin(*BASE), kind.isin("number_like")),
        "check": F.when(card, sign(F.when(F.length(number).between(12, 19), luhn(number)).otherwise(False), F.lit(True)))
        .when(phone, sign(F.length(number).between(10, 13), F.length(number) < 9))
        .when(ip, sign(~match.rlike(r"^0+\."), F.lit(True)))
        .otherwise(sign(~match.rlike(r"\.\.|^[.]"), F.lit(True))),
        "gazetteer": F.when(email, sign(ending.isin(*ENDINGS), F.length(ending) > 6))
        .when(phone, sign(match.rlike(r"^\+(1|33|34|39|4[0-9]|5[0-9])"), F.lit(False)))
        .when(ip, sign(~match.rlike(r"^(0|127|255)\."), F.lit(True)))
        .otherwise(sign(number.rlike(r"^(4|5[1-5]|3[47]|6011|62)"), number.rlike("^(0|[12][0-9]{3}[01][0-9])"))),
        "context": sign(cues, c["before"].rlike(r"(version|isbn|issn|https?://\S*|order|total|page|seite|id)[^.!?]{0,6}$")),
        "border": sign(c["before"].rlike(r"(^|[\s(\"':,;|<])$") & c["after"].rlike(r"^($|[\s)\"':,;|.!?>])"), c["before"].rlike(r"[/=_#]$")),
    }


def features(c: Column) -> dict[str, Column]:
    """Features of the span and its borders, as short texts."""
    match = c["match"]
    length, number = F.length(match), F.length(digits(match))
    share = F.floor(number * 4 / F.greatest(length, F.lit(1)))
    first = F.when(c["before"] == "", "start").when(c["before"].rlike(r"\s$"), "blank").when(c["before"].rlike("[a-z0-9]$"), "word")
    last = F.when(c["after"] == "", "end").when(c["after"].rlike(r"^\s"), "blank").when(c["after"].rlike("^[A-Za-z0-9]"), "word")
    return {
        "length": F.least(F.floor(length / 4), F.lit(10)).cast("string"),
        "digits": share.cast("string"),
        "marks": F.least(F.length(F.regexp_replace(match, "[A-Za-z0-9]", "")), F.lit(6)).cast("string"),
        "first": F.coalesce(first, F.lit("mark")),
        "last": F.coalesce(last, F.lit("mark")),
        "luhn": F.when(number.between(12, 19), luhn(digits(match)).cast("string")).otherwise("none"),
    }


@dataclass
class Model:
    """``agree[kind][labeler]``: estimated share of its votes that are right; ``prior`` odds and ``weights`` of features."""

    agree: dict = field(default_factory=dict)
    prior: dict[str, float] = field(default_factory=dict)
    weights: dict[tuple[str, str, str], float] = field(default_factory=dict)
    posterior: dict[tuple, float] = field(default_factory=dict)

    def score(self, c: Column) -> Column:
        """Log odds that a candidate is personal data."""
        literal = lambda items: F.create_map(*[F.lit(x) for pair in items for x in pair])
        out = F.coalesce(literal(self.prior.items())[c["kind"]], F.lit(-1.0)) if self.prior else F.lit(-1.0)
        for name, value in features(c).items():
            own = [(f"{kind}|{v}", w) for (kind, f, v), w in self.weights.items() if f == name]
            if own:
                out = out + F.coalesce(literal(own)[F.concat_ws("|", c["kind"], value)], F.lit(0.0))
        return out


def _estimate(patterns: list, rule: Weak) -> tuple[dict, dict]:
    """Expectation-maximisation on counts of vote patterns: posterior of every pattern, reliabilities by kind."""
    by_kind = defaultdict(list)
    for row in patterns:
        by_kind[row["kind"]].append((tuple(row[name] for name in LABELERS), row["n"]))
    posterior, agree = {}, {}
    for kind, rows in by_kind.items():
        # P(vote | class), from labelers that are right more often than not.
        table = [{1: {1: 0.6, 0: 0.3, -1: 0.1}, 0: {1: 0.2, 0: 0.3, -1: 0.5}} for _ in LABELERS]
        share, total = 0.5, sum(n for _, n in rows)
        for _ in range(rule.rounds):
            counts = [{y: dict.fromkeys((1, 0, -1), 0.5) for y in (1, 0)} for _ in LABELERS]
            mass = 1.0
            for vote, n in rows:
                yes = share * math.prod(t[1][v] for t, v in zip(table, vote))
                no = (1 - share) * math.prod(t[0][v] for t, v in zip(table, vote))
                p = yes / (yes + no) if yes + no else 0.5
                posterior[kind, vote] = p
                mass += n * p
                for c, v in zip(counts, vote):
                    c[1][v] += n * p
                    c[0][v] += n * (1 - p)
            share = mass / (total + 2)
            table = [{y: {v: x / sum(c[y].values()) for v, x in c[y].items()} for y in (1, 0)} for c in counts]
        agree[kind] = {
            name: (share * t[1][1] + (1 - share) * t[0][-1]) / max(1e-9, share * (t[1][1] + t[1][-1]) + (1 - share) * (t[0][1] + t[0][-1]))
            for name, t in zip(LABELERS, table)
        }
    return posterior, agree


def train(candidates: DataFrame, rule: Weak = Weak()) -> Model:
    """A model from a column ``c`` of candidates.

    Vote patterns are at most kinds times 3 to the 5th rows, feature values a few hundred: only these aggregates are collected.
    """
    voted = candidates.select("c", *[v.alias(name) for name, v in votes(F.col("c")).items()])
    shown = materialize(voted.select(F.col("c.kind").alias("kind"), *LABELERS, *[f.alias(f"f_{name}") for name, f in features(F.col("c")).items()]), "votes")
    patterns = shown.groupBy("kind", *LABELERS).agg(F.count(F.lit(1)).alias("n")).collect()
    posterior, agree = _estimate(patterns, rule)
    names = [c.removeprefix("f_") for c in shown.columns if c.startswith("f_")]
    stacked = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"f_{n}").alias("value")) for n in names]))
    counted = shown.groupBy("kind", *LABELERS, *[f"f_{n}" for n in names]).agg(F.count(F.lit(1)).alias("n"))
    by_value = counted.withColumn("x", stacked).groupBy("kind", *LABELERS, "x.feature", "x.value").agg(F.sum("n").alias("n")).collect()
    yes, no = defaultdict(lambda: 0.5), defaultdict(lambda: 0.5)
    for row in by_value:
        p = posterior[row["kind"], tuple(row[name] for name in LABELERS)]
        yes[row["kind"], row["feature"], row["value"]] += p * row["n"]
        no[row["kind"], row["feature"], row["value"]] += (1 - p) * row["n"]
    totals = defaultdict(lambda: [1.0, 1.0])
    for row in patterns:
        p = posterior[row["kind"], tuple(row[name] for name in LABELERS)]
        totals[row["kind"]][0] += p * row["n"]
        totals[row["kind"]][1] += (1 - p) * row["n"]
    prior = {kind: math.log(a / b) for kind, (a, b) in totals.items()}
    weights = {key: math.log(yes[key] / totals[key[0]][0] * totals[key[0]][1] / no[key]) for key in yes}
    return Model(agree, prior, weights, posterior)


def _plain(candidates: Column) -> Column:
    return F.transform(candidates, lambda c: F.struct(c["start"], c["order"], c["end"], c["kind"]))


def _judged(loose: Column, model: Model, rule: Weak) -> Column:
    least = math.log(rule.least / (1 - rule.least))
    return F.filter(loose, lambda c: model.score(c) > least)


def _texts(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), text.alias("text"))


def scan(docs: DataFrame, rule: Weak = Weak(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, found`` of every row of ``docs``.

    Spans of known formats always stay; looser candidates that overlap none of them are added if the classifier takes
    them. Places are in code points. A null text is empty; repeated rows are reported each.
    """
    rows = materialize(_scanned(_texts(docs, id_column, text_column), "text", rule).drop("text"), "pii")
    model = train(rows.select(F.explode(F.concat("base", "loose")).alias("c")), rule)
    counts = [F.size(F.filter("base", _of(kind))).cast("long").alias(f"n_{kind}") for kind in BASE]
    told = rows.withColumn("found", _plain(F.concat("base", _judged(F.col("loose"), model, rule))))
    return told.select(
        "doc_id", *counts, F.sha2(S.listed(_plain(F.col("base"))), 256).alias("base_sha256"), S.listed(F.col("found")).alias("spans"), "found"
    )


def mask(docs: DataFrame, rule: Weak = Weak(), text_column: str = "text", length_column: str | None = "n_chars") -> DataFrame:
    """``docs`` with every span in the text replaced by its kind, and the length column brought up to date.

    All rows and columns stay; a null text stays null.
    """
    plain = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)], F.coalesce(docs[text_column], F.lit("")).alias("text"))
    # Written whole: reading it again costs far less than a second scan of the texts.
    scanned = materialize(_scanned(plain, "text", rule), "pii")
    model = train(scanned.select(F.explode(F.concat("base", "loose")).alias("c")), rule)
    told = scanned.withColumn("found", _plain(F.concat("base", _judged(F.col("loose"), model, rule))))
    masked = told.withColumn("masked", F.when(F.size("found") > 0, S.replaced(F.col("text"), F.col("found"))).otherwise(F.col("text")))

    def column(i: int, name: str) -> Column:
        own = F.col(f"c{i}")
        if name == text_column:
            return F.when(own.isNotNull(), F.col("masked")).alias(name)
        if name == length_column:
            kind = docs.schema[name].dataType
            return F.when(F.size("found") > 0, F.length("masked").cast(kind)).otherwise(own).alias(name)
        return own.alias(name)

    return masked.select(*[column(i, name) for i, name in enumerate(docs.columns)])
