"""Personal data by weak supervision, in DataFrame functions alone.

Base patterns and wider candidate patterns give spans. Labelers vote on each span
(yes, no, or nothing): the base pattern, a validity check, a gazetteer, and the words
around it. The votes are counted per combination, which bounds what the driver sees
by the number of combinations. Expectation-maximisation estimates prevalence and
reliabilities from these counts; its posteriors train a logistic classifier over the
features of a span, also from counts. Base spans stay whatever it says; other
candidates are added where it is sure.

Patterns never try a run of characters from its middle, so long runs cost linear time.

Defined cases: a null text is an empty one without spans; null and repeated ids are
handled like any other row; a candidate that overlaps a base span of any kind, or an
earlier candidate, is left out; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from airspark.session import written

KINDS = ("email", "ip", "card", "phone")
#: Characters before a span that the context labeler reads.
REACH = 40
SURE = 0.9

#: The base patterns, with anchors that leave their matches as they are.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A string that every match of the base pattern holds.
HINT = {"email": "@", "ip": ".", "card": "", "phone": "+"}
WIDER = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:\[at\]|\(at\)|\{at\}|\x20at\x20)\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\[dot\]|\(dot\)|\{dot\}|\x20dot\x20)\x20?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9]{4}(?:[._/][0-9]{4}){3}(?![0-9])",
    "phone": r"(?<![0-9+.-])(?:\([0-9]{2,5}\)\x20?|00[0-9]{1,3}[\x20.-])?[0-9]{2,5}(?:[\x20./-][0-9]{2,5}){2,4}(?![0-9.-])",
}
WIDER_HINTS = {"email": ("(at)", "[at]", "{at}", " dot ", "(dot)", "[dot]", "{dot}"), "ip": (":",), "card": (".", "_", "/"), "phone": ("-", " ", ".", "/")}

IP_PARTS = r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$"
#: Gazetteers: domains' ends, network ranges of private use, issuers' first digits, calling codes.
LISTED = {
    "email": r"(?i)(?:\.|dot[\])}\x20]?\x20?)(?:com|org|net|edu|gov|info|io|eu|de|at|ch|fr|be|es|mx|it|nl|uk)$",
    "ip": r"^(?:10\.|192\.168\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|127\.|fe80:|fd)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)",
    "phone": r"^(?:\+|00)\x20?(?:1|7|20|27|30|31|32|33|34|39|40|41|43|44|45|46|47|48|49|51|52|54|55|56|57|61|64|81|82|86|90|91|351|352|353|358|420)",
}
CONTEXT = {
    "email": r"(?i)e-?mail|mail|contact|kontakt|courriel|correo|write to|schreib|écri|escrib",
    "ip": r"(?i)\bip\b|address|adresse|host|server|serveur|servidor|client|dirección",
    "card": r"(?i)card|karte|carte|tarjeta|visa|master|amex|credit|kredit|crédit|crédito",
    "phone": r"(?i)phone|tel|call|fax|mobil|cell|ruf|appel|llam|whatsapp",
}
AGAINST = r"(?i)version|isbn|issn|doi|order|invoice|rechnung|facture|factura|serial|page|seite|build|§|\$\x20*$|€\x20*$"

LABELERS = ("pattern", "valid", "listed", "context")
FEATURES = ("base", "valid", "invalid", "listed", "unlisted", "context", "against", "other_kind", "several")


def matches(text: Column, values: Column, pattern: str) -> Column:
    """Places of ``values``, the matches of ``pattern`` in ``text``: start, end and value.

    The text between matches has known lengths, so starts are sums of lengths.
    """
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), values.alias("value"))
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def step(acc: Column, part: Column) -> Column:
        start = acc["at"] + F.length(part["gap"])
        end = start + F.coalesce(F.length(part["value"]), F.lit(0))
        one = F.array(F.struct(start.alias("start"), end.alias("end"), part["value"].alias("value")))
        return F.struct(end.alias("at"), F.when(part["value"].isNull(), acc["found"]).otherwise(F.concat(acc["found"], one)).alias("found"))

    found = F.aggregate(parts, F.struct(F.lit(0).alias("at"), empty.alias("found")), step)["found"]
    return F.when(F.size(values) > 0, found).otherwise(empty)


def luhn(number: Column) -> Column:
    """The check digit holds for the digits of ``number``."""
    digits = F.split(F.reverse(F.regexp_replace(number, "[^0-9]", "")), "")

    def worth(digit: Column, i: Column) -> Column:
        d = digit.cast("int")
        return F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return F.aggregate(F.transform(digits, worth), F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def sound(kind: str, value: Column) -> Column:
    """The check that a base match must pass."""
    n = F.length(F.regexp_replace(value, "[^0-9]", ""))
    if kind == "ip":
        return value.rlike(IP_PARTS)
    if kind == "card":
        return n.between(14, 19) & luhn(value)
    return n.between(10, 15) if kind == "phone" else F.lit(True)


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and ``spans``: kind number, start, end, whether base, and the bits of FEATURES."""
    out = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    text = F.col("text")
    none = F.array().cast("array<string>")

    def found(hints: tuple[str, ...], pattern: str) -> Column:
        hinted = F.lit(False)
        for hint in hints:
            hinted = hinted | F.contains(text, F.lit(hint))
        return F.when(hinted, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none)

    out = out.withColumns(
        {f"_b_{k}": found((HINT[k],), BASE[k]) for k in KINDS} | {f"_w_{k}": found(WIDER_HINTS[k], WIDER[k]) for k in KINDS}
    )

    def spans(kind: str, base: bool) -> Column:
        i = KINDS.index(kind)
        at = matches(text, F.col(f"_{'b' if base else 'w'}_{kind}"), (BASE if base else WIDER)[kind])
        if base:
            at = F.filter(at, lambda m: sound(kind, m["value"]))
        elif kind == "phone":
            at = F.filter(at, lambda m: F.length(F.regexp_replace(m["value"], "[^0-9]", "")).between(9, 15))
        return F.transform(at, lambda m: F.struct(m["start"].alias("start"), F.lit(i).alias("kind"), m["end"].alias("end"), F.lit(base).alias("base"), m["value"].alias("value")))

    out = out.select(
        "doc_id",
        "text",
        F.array_sort(F.concat(*[spans(k, True) for k in KINDS])).alias("_base"),
        F.array_sort(F.concat(*[spans(k, False) for k in KINDS])).alias("_wide"),
    )

    def free(w: Column) -> Column:
        apart = lambda other: (other["end"] <= w["start"]) | (other["start"] >= w["end"])
        earlier = F.filter("_wide", lambda o: (o["start"] < w["start"]) | ((o["start"] == w["start"]) & (o["kind"] < w["kind"])))
        return F.forall("_base", apart) & F.forall(earlier, apart)

    out = out.withColumn("_wide", F.when(F.size("_wide") > 0, F.filter("_wide", free)).otherwise(F.col("_wide")))
    several = F.size(F.array_distinct(F.transform("_base", lambda s: s["kind"]))) > 1

    def features(s: Column) -> Column:
        before = F.substring(text, F.greatest(s["start"] - REACH, F.lit(0)) + 1, F.least(s["start"], F.lit(REACH)))
        by_kind = lambda make: F.element_at(F.array(*[make(k) for k in KINDS]), s["kind"] + 1)
        digits = F.length(F.regexp_replace(s["value"], "[^0-9]", ""))
        valid = (
            F.when(s["kind"] == 2, digits.between(14, 19) & luhn(s["value"]))
            .when(s["kind"] == 3, digits.between(10, 15))
            .when(s["kind"] == 1, s["base"] | F.contains(s["value"], F.lit(":")))
            .otherwise(F.length(s["value"]) <= 254)
        )
        listed = by_kind(lambda k: s["value"].rlike(LISTED[k]))
        listed = F.when(s["kind"] == 1, ~listed).otherwise(listed)
        near = by_kind(lambda k: before.rlike(CONTEXT[k]))
        other = before.rlike("|".join(f"(?:{CONTEXT[k]})" for k in KINDS)) & ~near
        bits = [s["base"], valid, ~valid, listed, ~listed, near, before.rlike(AGAINST), other, several]
        total = F.lit(0)
        for j, bit in enumerate(bits):
            total = total + F.when(bit, 1 << j).otherwise(0)
        return F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["base"].alias("base"), total.alias("bits"))

    return out.select("doc_id", F.array_sort(F.transform(F.concat("_base", "_wide"), features)).alias("spans"))


def votes(bits: int) -> tuple[int, ...]:
    """What the labelers say to a combination of features: 1, 0 or -1 for nothing."""
    on = {name: bool(bits >> j & 1) for j, name in enumerate(FEATURES)}
    return (
        1 if on["base"] else -1,
        1 if on["valid"] else 0,
        1 if on["listed"] else -1,
        1 if on["context"] else 0 if on["against"] or on["other_kind"] else -1,
    )


def reliabilities(counts: dict[tuple[int, ...], int], rounds: int = 100) -> tuple[float, list[dict]]:
    """Expectation-maximisation over vote combinations: prevalence and, for each labeler,
    the chances of its votes given the truth. Starts from labelers that are right in 4 of 5
    cases and keeps a weight of ten spans on that belief."""
    start = [{1: {1: 0.7, 0: 0.1, -1: 0.2}, 0: {1: 0.1, 0: 0.4, -1: 0.5}} for _ in LABELERS]
    chances, prevalence = start, 0.5
    total = sum(counts.values())
    for _ in range(rounds):
        share = {v: posterior(v, prevalence, chances) for v in counts}
        new = []
        for i in range(len(LABELERS)):
            table = {}
            for truth in (1, 0):
                mass = {
                    vote: 10 * start[i][truth][vote]
                    + sum(n * (share[v] if truth else 1 - share[v]) for v, n in counts.items() if v[i] == vote)
                    for vote in (1, 0, -1)
                }
                table[truth] = {vote: m / sum(mass.values()) for vote, m in mass.items()}
            new.append(table)
        was, prevalence = prevalence, (5 + sum(n * share[v] for v, n in counts.items())) / (10 + total)
        chances = new
        if abs(was - prevalence) < 1e-9:
            break
    return prevalence, chances


def posterior(vote: tuple[int, ...], prevalence: float, chances: list[dict]) -> float:
    odds = math.log(prevalence) - math.log(1 - prevalence)
    for v, table in zip(vote, chances):
        odds += math.log(table[1][v]) - math.log(table[0][v])
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))


def fit_classifier(counts: dict[int, int], rounds: int = 500) -> list[float]:
    """Weights (bias first) of a logistic classifier of feature bits, from EM posteriors."""
    by_vote: dict[tuple[int, ...], int] = {}
    for bits, n in counts.items():
        by_vote[votes(bits)] = by_vote.get(votes(bits), 0) + n
    prevalence, chances = reliabilities(by_vote)
    # Half the weight is shared equally by the combinations, so that rare ones count.
    total = sum(counts.values())
    rows = [
        ([1.0] + [float(bits >> j & 1) for j in range(len(FEATURES))], posterior(votes(bits), prevalence, chances), 0.5 * n / total + 0.5 / len(counts))
        for bits, n in sorted(counts.items())
    ]
    w = [0.0] * (len(FEATURES) + 1)
    for _ in range(rounds):
        grad = [1e-4 * x for x in w]
        for x, y, n in rows:
            miss = n * (1 / (1 + math.exp(-sum(a * b for a, b in zip(w, x)))) - y)
            grad = [g + miss * v for g, v in zip(grad, x)]
        w = [a - 2.0 * g for a, g in zip(w, grad)]
    return w


def personal_spans(docs: DataFrame, sure: float = SURE) -> DataFrame:
    """One row per document: doc_id and ``spans`` (start, kind, end, base, score), base spans and added ones."""
    rows = written(candidates(docs), "pii")  # narrow: arrays of numbers, mostly empty
    seen = rows.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.bits").count().collect()  # at most kinds x combinations
    counts = {i: {r["bits"]: r["count"] for r in seen if r["kind"] == i} for i in range(len(KINDS))}
    weights = {i: fit_classifier(c) for i, c in counts.items() if c}

    def score(s: Column) -> Column:
        total = F.lit(0.0)
        for i, w in weights.items():
            odds = F.lit(w[0])
            for j, weight in enumerate(w[1:]):
                odds = odds + F.when(s["bits"].bitwiseAND(F.lit(1 << j)) != 0, weight).otherwise(0.0)
            total = F.when(s["kind"] == i, 1 / (1 + F.exp(-odds))).otherwise(total)
        return total

    scored = F.transform("spans", lambda s: F.struct(s["start"], s["kind"], s["end"], s["base"], score(s).alias("score")))
    return rows.select("doc_id", F.filter(scored, lambda s: s["base"] | (s["score"] >= sure)).alias("spans"))


def pii_digest(found: DataFrame) -> DataFrame:
    """The contract's columns from ``personal_spans``."""
    base = F.filter("spans", lambda s: s["base"])
    text = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat(F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ","
    )
    count = lambda i: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == i))).cast("long")
    return found.select(
        "doc_id",
        *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(text(base), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
    )
