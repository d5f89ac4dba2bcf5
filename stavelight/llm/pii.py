"""Personal data by weak supervision. Built-in functions only on the data; the model is fitted from a bounded table of counts.

Fixed patterns give the base spans. Looser patterns give candidates that no single rule settles. Over every span of all
documents four labelers vote 1, 0 or -1: shape (regex), gazetteer, context words, validity. The counts of each (kind, anchor, votes, length)
pattern, at most ``len(KINDS) * 3 * 81 * 4`` rows however large the corpus, go to the driver. Expectation-maximisation there
estimates each labeler's reliability by kind and the posterior of every pattern. It is anchored: base spans that pass their check are personal data,
matches of base patterns that fail it are not, and every reliability has a prior above one half whose weight is a share of the kind's spans, so labels
can't switch. A logistic span classifier is trained on the soft labels and goes back as one SQL expression. Candidates it accepts
join the base spans. Spans are written once to the checkpoint folder, so texts are read once.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, without
from .spans import SPAN, gathered, in_order, let, listed, matches, of_kind

#: Fixed patterns, by kind; possessive and anchored to the start of a run so that long runs take linear time.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = ["email", "ip", "card", "phone"]
#: Candidate patterns, by kind.
LOOSE = {
    "phone_local": r"(?<![0-9+(])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9])",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])",
    "person": r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sra?)\.?\x20[A-Z][a-z]{1,30}(?:\x20[A-Z][a-z]{1,30})?",
    "email_masked": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[(\[](?:at|AT)[)\]]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[(\[](?:dot|DOT)[)\]]\x20?)[A-Za-z0-9-]++)+",
    "mac": r"(?<![0-9A-Za-z:-])[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}(?![0-9A-Za-z:-])",
    "birth_date": r"(?<![0-9./-])(?:[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4}|[0-9]{4}-[0-9]{2}-[0-9]{2})(?![0-9./-])",
    "street": r"(?<![0-9A-Za-z])[0-9]{1,5}\x20(?:[A-Z][a-z]{1,20}\x20){1,3}(?:Street|Road|Avenue|Lane|Drive|Court|Square|Boulevard|St|Rd|Ave)(?![a-z])",
}
KINDS = [*BASE, *LOOSE]
#: Titles, small default gazetteers (larger ones are a parameter), cue words by kind, counter-cues of all kinds.
TITLES = ("Mr", "Ms", "Dr", "Prof", "Herr", "Frau", "Mme", "Sr")
GIVEN_NAMES = (
    "Ana", "Anna", "Carlos", "Claire", "David", "Elena", "Emma", "Hans", "James", "Jean", "John", "Jose", "Juan", "Karl", "Laura", "Maria", "Marie", "Mary",
    "Michael", "Paul", "Peter", "Pierre", "Robert", "Sofia", "Thomas",
)
IBAN_COUNTRIES = ("AT", "BE", "CH", "CZ", "DE", "DK", "ES", "FI", "FR", "GB", "GR", "HU", "IE", "IT", "LU", "NL", "NO", "PL", "PT", "RO", "SE")
TOP_LEVEL = ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "it", "uk", "eu", "info")
CUES = {
    "email": "mail|contact|write", "email_masked": "mail|contact|write", "ip": "ip|address|host|login", "mac": "mac|ethernet|device|address",
    "card": "card|visa|credit|karte|tarjeta|carte", "phone": "call|phone|tel|telefon|fax|mobile|contact", "phone_local": "call|phone|tel|telefon|fax|mobile|contact",
    "national_id": "ssn|social|security|id", "iban": "iban|account|konto|bank|cuenta|compte", "person": "name|patient|contact|dear|from|signed",
    "birth_date": "born|birth|dob|birthday|geboren|nacido|nacida", "street": "address|lives|live|adresse|home|resides",
}
COUNTER_CUES = "isbn|order|version|figure|fig|page|ref|invoice|total|price|serial|score|year|part|model"
LABELERS = ("shape", "gazetteer", "context", "validity")
CONTEXT = 40


#: Share of a kind's spans that the prior of each reliability weighs, its least weight, and P(vote | label) of votes that are no abstentions.
PRIOR_SHARE, PRIOR_LEAST = 0.1, 8.0
PRIOR = {1: {-1: 0.2, 1: 0.8}, 0: {-1: 0.8, 1: 0.2}}


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the digits pass the check sum."""
    ds = F.transform(F.split(F.reverse(number), ""), lambda d, i: let(d.cast("int"), lambda n: F.when(i % 2 == 0, n).otherwise(2 * n - F.when(n > 4, 9).otherwise(0))))
    return F.aggregate(ds, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod_97(value: Column) -> Column:
    """The remainder by which account numbers are checked: first four characters last, letters as 10 to 35."""
    turned = F.split(F.concat(F.substring(value, 5, 64), F.substring(value, 1, 4)), "")
    codes = F.transform(turned, lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55))
    return F.aggregate(codes, F.lit(0), lambda a, x: (a * F.when(x > 9, 100).otherwise(10) + x) % 97)


def _gates(text: Column) -> dict[str, Column]:
    """Cheap tests that every text with a match passes: most texts fail them and no pattern is run."""
    some = lambda *xs: reduce(lambda a, b: a | b, [text.contains(x) for x in xs])
    digit = text.rlike("[0-9]")
    return {
        "email": some("@"), "ip": digit, "card": digit, "phone": some("+") & digit, "person": some(*TITLES), "email_masked": some("(at", "[at", "(AT", "[AT"), "mac": digit & some(":", "-") | text.rlike("[0-9A-Fa-f]{2}[:-][0-9A-Fa-f]{2}[:-]"),
        **{k: digit for k in ("phone_local", "national_id", "iban", "birth_date", "street")},
    }


def _passes(x: Column) -> Column:
    """Whether a match of a base pattern is one."""
    v, part = x["value"], r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    return (
        F.when(x["kind"] == "ip", v.rlike(rf"^{part}(?:\.{part}){{3}}$"))
        .when(x["kind"] == "card", let(digits(v), lambda d: F.when(F.length(d).between(13, 19), luhn(d)).otherwise(False)))
        .when(x["kind"] == "phone", F.length(digits(v)).between(9, 15)).otherwise(True)
    )


def _word(words: str) -> str:
    return f"(?i)(?<![a-z])(?:{words})(?![a-z])"


def votes(x: Column, text: Column, gazetteers: dict[str, tuple[str, ...]]) -> list[Column]:
    """One vote, 1, 0 or -1, of each labeler for a span of the text."""
    v, kind = x["value"], x["kind"]
    bare = digits(v)
    shaped = {
        "phone_local": r"^\([0-9]{3}\)\x20[0-9]{3}-[0-9]{4}$|^[0-9]{3}([.-])[0-9]{3}\1[0-9]{4}$", "card": r"^[0-9]{16}$|^[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}$", "phone": r"^\+[0-9]{1,3}[\x20.-]?\(?[0-9]",
        "person": r"\x20.*\x20", "email": r"^[A-Za-z0-9].*\.[A-Za-z]{2,6}$", "email_masked": r"[A-Za-z]{2,6}$", "mac": r"^[0-9A-F]{2}(:[0-9A-F]{2}){5}$|^[0-9a-f]{2}(:[0-9a-f]{2}){5}$|^[0-9A-F]{2}(-[0-9A-F]{2}){5}$",
        "street": r"(Street|Road|Avenue|Lane|Drive|Court|Square|Boulevard)$", "national_id": "^", "ip": "^",
    }
    shape = F.when((kind != "birth_date") & bare.rlike(r"^([0-9])\1+$"), -1)
    for k, p in shaped.items():
        shape = shape.when((kind == k) & v.rlike(p), 1)
    last = F.lower(F.regexp_extract(v, "([A-Za-z0-9-]+)[^A-Za-z0-9-]*$", 1))
    gazetteer = (
        F.when(kind == "person", F.when(F.split(v, r"\x20")[1].isin(*gazetteers["given_names"]), 1).otherwise(0)).when(kind == "iban", F.when(F.substring(v, 1, 2).isin(*gazetteers["iban_countries"]), 1).otherwise(-1))
        .when(kind.isin("email", "email_masked"), F.when(last.isin(*gazetteers["top_level"]), 1).otherwise(0))
        .when(kind == "phone_local", F.when(bare.rlike("^[2-9]"), 1).otherwise(-1)).when(kind == "ip", F.when(v.rlike(r"^(10|127|192\.168)\."), -1).otherwise(0)).otherwise(0)
    )
    near = F.substring(text, F.greatest(x["start"] - CONTEXT + 1, F.lit(1)).cast("int"), F.least(x["start"], F.lit(CONTEXT)).cast("int"))

    def said(n: Column) -> Column:
        out = F.when(n.rlike(_word(COUNTER_CUES)), -1)
        for k, words in CUES.items():
            out = out.when((kind == k) & n.rlike(_word(words)), 1)
        return out.when(kind == "birth_date", -1).otherwise(0)  # a date is personal only if it is said to be

    day = F.when(v.rlike(r"^[0-9]{4}"), F.substring(v, 9, 2)).otherwise(F.regexp_extract(v, r"^([0-9]+)", 1)).cast("int")
    month = F.when(v.rlike(r"^[0-9]{4}"), F.substring(v, 6, 2)).otherwise(F.regexp_extract(v, r"^[0-9]+.([0-9]+)", 1)).cast("int")
    validity = (
        F.when(kind == "card", 1).when(kind == "ip", F.when(v.rlike(r"^0|\.0[0-9]"), -1).otherwise(1))
        .when(kind == "national_id", F.when(v.rlike(r"^(000|666|9)|-00-|-0000$"), -1).otherwise(1))
        .when(kind == "phone_local", F.when(bare.rlike("^[0-9]{3}[01]"), -1).otherwise(1))
        .when(kind == "iban", F.when(mod_97(v) == 1, 1).otherwise(-1)).when(kind == "mac", F.when(v.rlike(r"(?i)^(ff[:-]){5}|^(00[:-]){5}"), -1).otherwise(1))
        .when(kind == "birth_date", F.when((F.least(day, month) >= 1) & (F.least(day, month) <= 12) & (F.greatest(day, month) <= 31) & v.rlike("(19|20)[0-9]{2}"), 0).otherwise(-1)).otherwise(0)
    )
    return [c.cast("int") for c in (shape.otherwise(0), gazetteer, let(near, said), validity)]


def expectation_maximisation(counts: dict[tuple, int], rounds: int = 50) -> tuple[dict[tuple, float], dict[str, list[dict[int, dict[int, float]]]]]:
    """counts by (kind, anchor, votes, size) -> (posterior of each pattern, P(vote | label) by kind and labeler).

    Anchors 1 and 0 are known labels; the others' first guess is the votes' majority. The validity of anchored spans is what anchors them and counts for
    nothing, nor does an abstention. Priors keep each reliability informative: ``PRIOR`` weighs a share of the kind's spans.
    """
    keys = sorted(counts, key=str)
    post = {k: float(k[1]) if k[1] >= 0 else 1 / (1 + math.exp(0.5 - 1.5 * sum(k[2]))) for k in keys}
    rates: dict[str, list[dict[int, dict[int, float]]]] = {}
    for _ in range(rounds):
        rates, prior = {}, {}
        for kind in {k[0] for k in keys}:
            own = [k for k in keys if k[0] == kind]
            n = sum(counts[k] for k in own)
            weight = max(PRIOR_LEAST, PRIOR_SHARE * n)
            tables = []
            for j, name in enumerate(LABELERS):
                table = {y: {v: weight * PRIOR[y][v] for v in (-1, 1)} for y in (0, 1)}
                for k in own:
                    if k[2][j] and (k[1] < 0 or name != "validity"):
                        table[1][k[2][j]] += counts[k] * post[k]
                        table[0][k[2][j]] += counts[k] * (1 - post[k])
                tables.append({y: {v: c / sum(t.values()) for v, c in t.items()} for y, t in table.items()})
            rates[kind] = tables
            prior[kind] = (sum(counts[k] * post[k] for k in own) + weight / 2) / (n + weight)
        for k in keys:
            if k[1] < 0:
                odds = math.log(prior[k[0]] / (1 - prior[k[0]])) + sum(math.log(rates[k[0]][j][1][v] / rates[k[0]][j][0][v]) for j, v in enumerate(k[2]) if v)
                post[k] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return post, rates


def reliabilities(rates: list[dict[int, dict[int, float]]]) -> dict[str, float]:
    """Each labeler's chance to be right when it votes, both labels alike."""
    return {n: (r[1][1] + r[0][-1]) / (r[1][1] + r[1][-1] + r[0][1] + r[0][-1]) for n, r in zip(LABELERS, rates, strict=True)}


def features(kind: str, vote: tuple[int, ...], size: int) -> list[str]:
    said = [f"{n}={v}" for n, v in zip(LABELERS, vote, strict=True) if v]
    return ["bias", f"kind={kind}", f"size={size}", *said, *[f"{kind}:{x}" for x in said]]


def train_classifier(counts: dict[tuple, int], post: dict[tuple, float], rounds: int = 400, ridge: float = 0.001) -> dict[str, float]:
    """Weights of a logistic model on the soft labels, by gradient descent over the patterns; every kind weighs the same, its patterns by their counts."""
    keys = sorted(counts, key=str)
    mass: dict[str, int] = {}
    for k in keys:
        mass[k[0]] = mass.get(k[0], 0) + counts[k]
    rows = [(features(k[0], k[2], k[3]), counts[k] / mass[k[0]], post[k]) for k in keys]
    w: dict[str, float] = {}
    for _ in range(rounds):
        grad: dict[str, float] = {f: ridge * x for f, x in w.items()}
        for fs, weight, y in rows:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w.get(f, 0.0) for f in fs)))))
            for f in fs:
                grad[f] = grad.get(f, 0.0) + weight / len(mass) * (p - y)
        for f, g in grad.items():
            w[f] = w.get(f, 0.0) - 2.0 * g
    return w


def _size(value: Column) -> Column:
    n = F.length(value)
    return F.when(n < 10, 0).when(n < 14, 1).when(n < 20, 2).otherwise(3)


def spans_with_votes(docs: DataFrame, text: str = "text", gazetteers: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Docs with base_spans, _more (candidates outside them) and _not (near misses of base patterns); each span has votes and a length class."""
    t = F.col(text)
    known = {"given_names": GIVEN_NAMES, "iban_countries": IBAN_COUNTRIES, "top_level": TOP_LEVEL} | (gazetteers or {})
    gates = _gates(t)
    found = gathered(*[matches(t, p, k, gate=gates[k]) for k, p in zip(BASE, (EMAIL, IP, CARD, PHONE), strict=True)])
    # a run of digits of another length than a card's says nothing about cards
    near_miss = lambda x: (x["kind"] != "card") | F.length(digits(x["value"])).between(13, 19)
    judged = F.transform(found, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), _passes(x).alias("ok")))
    df = docs.withColumn("_m", F.when(F.size(found) > 0, judged))
    plain = lambda xs: F.transform(xs, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"))).cast(SPAN)
    df = df.withColumn("_b", in_order(F.coalesce(plain(F.filter("_m", lambda x: x["ok"])), F.array().cast(SPAN)), KINDS, by_kind=True))
    more = gathered(*[matches(t, p, k, gate=gates[k]) for k, p in LOOSE.items()])
    apart = F.filter(more, lambda x: ~F.exists("_b", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    voted = lambda xs: F.transform(xs, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), F.array(*votes(x, t, known)).alias("votes"), _size(x["value"]).alias("size")))
    empty = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,value:string,votes:array<int>,size:int>>")
    none = lambda xs: F.when(F.size(xs) > 0, voted(xs)).otherwise(empty)
    df = df.withColumn("base_spans", none(F.col("_b"))).withColumn("_not", none(F.filter("_m", lambda x: ~x["ok"] & near_miss(x))))
    return df.withColumn("_x", apart).withColumn("_more", none(F.col("_x"))).drop("_b", "_m", "_x")


def fit(spans: DataFrame) -> tuple[dict[str, float], dict[str, list[dict[int, dict[int, float]]]]]:
    """(classifier weights, P(vote | label) by kind and labeler) from the spans of all documents."""
    anchored = lambda name, y: F.transform(name, lambda x: F.struct(x["kind"].alias("kind"), F.lit(y).alias("anchor"), x["votes"].alias("votes"), x["size"].alias("size")))
    every = F.concat(anchored("base_spans", 1), anchored("_not", 0), anchored("_more", -1))
    rows = spans.select(F.explode(every).alias("x")).groupBy("x.kind", "x.anchor", "x.votes", "x.size").count().collect()
    counts = {(r["kind"], r["anchor"], tuple(r["votes"]), r["size"]): r["count"] for r in rows}
    post, rates = expectation_maximisation(counts)
    return train_classifier(counts, post), rates


def logit(x: Column, w: dict[str, float]) -> Column:
    out = F.lit(w.get("bias", 0.0))
    for kind in KINDS:
        out = out + F.when(x["kind"] == kind, w.get(f"kind={kind}", 0.0)).otherwise(0.0)
    for size in range(4):
        out = out + F.when(x["size"] == size, w.get(f"size={size}", 0.0)).otherwise(0.0)
    for j, name in enumerate(LABELERS):
        for v in (-1, 1):
            own = F.lit(w.get(f"{name}={v}", 0.0))
            for kind in LOOSE:
                if f"{kind}:{name}={v}" in w:
                    own = own + F.when(x["kind"] == kind, w[f"{kind}:{name}={v}"]).otherwise(0.0)
            out = out + F.when(F.element_at(x["votes"], j + 1) == v, own).otherwise(0.0)
    return out


def find_pii(docs: DataFrame, text: str = "text", drop_text: bool = False, gazetteers: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Docs with base_spans and spans: arrays of (kind, start, end, value), sorted by kind, then start.

    Positions count code points, end exclusive. Base spans are the matches of the four fixed patterns that pass their check (ip parts at most
    255; card 13 to 19 digits and Luhn; phone 9 to 15 digits), leftmost and non-overlapping by kind; failing matches are dropped
    without a retry. Spans adds the candidates outside them that the classifier accepts (probability over 0.5). gazetteers replaces the lists
    given_names, iban_countries or top_level. Null and empty texts have empty arrays; texts of any length are searched whole; repeated rows get equal results and vote as
    often as they occur; without any span nothing is trained or added; an empty table gives an empty one. Columns named base_spans or spans are replaced, others are carried.
    """
    docs = without(docs, ["base_spans", "spans", "_more", "_not", "_b", "_m", "_x"])
    df = spans_with_votes(docs, text, gazetteers)
    df = cut(df.drop(text) if drop_text else df)
    w, _ = fit(df)
    plain = lambda xs: F.transform(xs, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"))).cast(SPAN)
    more = F.filter("_more", lambda x: logit(x, w) > 0)
    out = df.withColumn("spans", in_order(F.concat(plain(F.col("base_spans")), plain(more)), KINDS, by_kind=True))
    return out.withColumn("base_spans", plain(F.col("base_spans"))).drop("_more", "_not")


def digest(df: DataFrame) -> DataFrame:
    return df.select("doc_id", *[of_kind(F.col("base_spans"), k).alias(f"n_{k}") for k in BASE], F.sha2(listed(F.col("base_spans")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def brute_force_base(text: str | None) -> list[tuple[str, int, int]]:
    """Base spans of a text with the plain patterns, in plain Python; for tests."""
    import re

    def passes(d: str) -> bool:
        n = [int(c) for c in reversed(d)]
        return (sum(n[0::2]) + sum(sum(divmod(2 * x, 10)) for x in n[1::2])) % 10 == 0

    bare = lambda m: re.sub("[^0-9]", "", m)
    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(bare(m)) <= 19 and passes(bare(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(bare(m)) <= 15),
    }
    return [(k, *m.span()) for k, (p, ok) in rules.items() for m in re.finditer(p, text or "") if ok(m[0])]
