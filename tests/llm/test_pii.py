import random
import re
from collections import Counter

from stavelight.llm import pii
from stavelight.llm.spans import listed
from pyspark.sql import functions as F


def texts():
    rng = random.Random(2)
    out = [None, "", "a" * 20_000, "1" * 20_000, "+" * 1000, "+1" + " " * 50_000, "a@b" + ".c" * 20_000, "a@b.c..d@e.f a@b.c@d.e", "1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.4 1.2.3"]
    out += ["Call me: tel (212) 456-7890 or 212.456.7890", "order 212-45-7890 and ssn 212-45-7890", "Dear Dr. Anna Schmidt, Mr. Xx", "iban DE89370400440532013000", " ".join(f"u{i}@mail.example.com" for i in range(700))]
    parts = ["a", "é\U0001f600", "@", ".", "+1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 (30) 123-4567", "192.168.0.1", " ", "-", "5", "77", "x.y@z-1.org", "(", ")", "\n"]
    return out + ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 25))) for _ in range(300)]


def test_base_against_brute_force(spark):
    ts = texts()
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(ts)], "doc_id long, text string, _more int")
    rows = pii.find_pii(df).select("doc_id", listed(F.col("base_spans")).alias("b"), listed(F.col("spans")).alias("s")).collect()
    assert len(rows) == len(ts)
    for r in rows:
        assert r.b == ",".join(f"{k}:{s}:{e}" for k, s, e in pii.brute_force_base(ts[r.doc_id])), ts[r.doc_id]
        assert not r.b or set(r.b.split(",")) <= set(r.s.split(","))
    by = {r.doc_id: r.s for r in rows}
    assert by[9].count("phone_local") == 2


def plain_votes(kind, v, start, text):
    """The labelers' votes in plain Python."""
    bare = re.sub("[^0-9]", "", v)
    if kind != "birth_date" and bare and len(set(bare)) == 1 and len(bare) > 1:
        shape = -1
    else:
        shape = int({
            "phone_local": lambda: re.search(r"^\([0-9]{3}\) [0-9]{3}-[0-9]{4}$|^[0-9]{3}([.-])[0-9]{3}\1[0-9]{4}$", v), "card": lambda: len(v) == 16 or re.search(r"^[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}$", v),
            "phone": lambda: re.search(r"^\+[0-9]{1,3}[ .-]?\(?[0-9]", v), "person": lambda: v.count(" ") == 2, "email": lambda: v[0].isalnum() and re.search(r"\.[A-Za-z]{2,6}$", v), "email_masked": lambda: re.search("[A-Za-z]{2,6}$", v),
            "mac": lambda: v in (v.upper(), v.lower()) and (v.count(":") == 5 or v == v.upper() and v.count("-") == 5), "street": lambda: not v.endswith(("St", "Rd", "Ave")), "national_id": lambda: True, "ip": lambda: True,
        }.get(kind, lambda: False)() not in (None, False))
    last = (re.findall("[A-Za-z0-9-]+", v) or [""])[-1].lower()
    gazetteer = {
        "person": lambda: int(v.split(" ")[1] in pii.GIVEN_NAMES), "iban": lambda: 1 if v[:2] in pii.IBAN_COUNTRIES else -1, "email": lambda: int(last in pii.TOP_LEVEL), "email_masked": lambda: int(last in pii.TOP_LEVEL),
        "phone_local": lambda: 1 if bare[0] >= "2" else -1, "ip": lambda: -int(v.startswith(("10.", "127.", "192.168."))),
    }.get(kind, lambda: 0)()
    near = text[max(0, start - pii.CONTEXT) : start].lower()
    said = lambda words: re.search(f"(?<![a-z])(?:{words})(?![a-z])", near)
    context = -1 if said(pii.COUNTER_CUES) else 1 if said(pii.CUES[kind]) else -int(kind == "birth_date")
    validity = 0
    if kind == "card":
        validity = 1
    elif kind == "ip":
        validity = -1 if re.search(r"^0|\.0[0-9]", v) else 1
    elif kind == "national_id":
        validity = -1 if re.search("^(000|666|9)|-00-|-0000$", v) else 1
    elif kind == "phone_local":
        validity = -1 if bare[3] in "01" else 1
    elif kind == "iban":
        validity = 1 if int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1 else -1
    elif kind == "mac":
        validity = -1 if re.search("^(ff[:-]){5}|^(00[:-]){5}", v.lower()) else 1
    elif kind == "birth_date":
        p = [int(x) for x in re.findall("[0-9]+", v)]
        day, month = (p[2], p[1]) if v[:4].isdigit() else (p[0], p[1])
        validity = 0 if 1 <= min(day, month) <= 12 and max(day, month) <= 31 and re.search("(19|20)[0-9]{2}", v) else -1
    return shape, gazetteer, context, validity


def plain(texts):
    """All spans of each text, with the model fitted from them, in plain Python."""
    size = lambda v: 0 if len(v) < 10 else 1 if len(v) < 14 else 2 if len(v) < 20 else 3
    counts, base, more = Counter(), [], []
    fixed = {"email": pii.EMAIL.replace(r"|\G", ""), "ip": pii.IP.replace(r"|\G", ""), "card": pii.CARD, "phone": pii.PHONE}
    for t in texts:
        t = t or ""
        base.append(pii.brute_force_base(t))
        missed = [(k, m.start(), m.end()) for k, p in fixed.items() for m in re.finditer(p, t) if (k, *m.span()) not in base[-1] and (k != "card" or 13 <= len(re.sub("[^0-9]", "", m[0])) <= 19)]
        free = [(k, *m.span()) for k, p in pii.LOOSE.items() for m in re.finditer(p, t) if not any(a < m.end() and m.start() < b for _, a, b in base[-1])]
        more.append(free)
        for y, xs in ((1, base[-1]), (0, missed), (-1, free)):
            counts.update((k, y, plain_votes(k, t[a:b], a, t), size(t[a:b])) for k, a, b in xs)
    post, rates = pii.expectation_maximisation(dict(counts))
    w = pii.train_classifier(dict(counts), post)
    accepted = lambda t, k, a, b: sum(w.get(f, 0.0) for f in pii.features(k, plain_votes(k, t[a:b], a, t), size(t[a:b]))) > 0
    order = lambda x: (pii.KINDS.index(x[0]), x[1], x[2])
    return [sorted(b + [(k, s, e) for k, s, e in m if accepted(t or "", k, s, e)], key=order) for t, b, m in zip(texts, base, more, strict=True)], rates


def planted(n=1500):
    """(texts, spans of personal data that no base pattern matches, look-alikes)."""
    rng = random.Random(11)
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8)))

    def iban(ok):
        body = d(18)
        check = 98 - int("".join(str(int(c, 36)) for c in body + "DE00")) % 97
        return f"DE{check if ok else (check + 1 + rng.randrange(50)) % 97:02d}{body}"

    good = {
        "phone_local": lambda: (rng.choice(["call", "tel", "my number"]), f"({rng.randrange(2, 10)}{d(2)}) {rng.randrange(2, 10)}{d(2)}-{d(4)}"),
        "national_id": lambda: (rng.choice(["ssn", "social security", "mine is"]), f"{rng.randrange(100, 600)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}"),
        "iban": lambda: (rng.choice(["iban", "pay to account", "to"]), iban(True)), "person": lambda: (rng.choice(["dear", "signed", "with"]), f"{rng.choice(['Mr', 'Dr.', 'Frau'])} {rng.choice(pii.GIVEN_NAMES)} {word().title()}"),
        "email_masked": lambda: (rng.choice(["mail", "contact", "at"]), f"{word()} [at] {word()} [dot] {rng.choice(['com', 'org', 'de'])}"),
        "mac": lambda: (rng.choice(["device", "mac", "on"]), ":".join(f"{rng.randrange(256):02x}" for _ in range(6))), "birth_date": lambda: (rng.choice(["born", "date of birth", "dob"]), f"{rng.randrange(1, 28)}/{rng.randrange(1, 13)}/{rng.randrange(1930, 2010)}"),
        "street": lambda: (rng.choice(["lives at", "address", "see"]), f"{rng.randrange(1, 999)} {word().title()} {rng.choice(['Street', 'Road', 'Avenue'])}"),
    }
    bad = {
        "phone_local": lambda: (rng.choice(["part", "serial", "of"]), f"{rng.randrange(2)}{d(2)} {rng.randrange(2)}{d(2)} {d(4)}"), "national_id": lambda: (rng.choice(["order", "invoice", "no"]), f"{rng.choice(['000', '666', '9' + d(2)])}-{d(2)}-{d(4)}"),
        "iban": lambda: (rng.choice(["serial", "model", "a"]), rng.choice([iban(False), "XX" + d(16)])), "birth_date": lambda: (rng.choice(["order", "version", "on", "due"]), f"{rng.randrange(1, 28)}/{rng.randrange(1, 13)}/{rng.randrange(1930, 2030)}"),
        "mac": lambda: (rng.choice(["part", "model", "so"]), rng.choice(["ff:ff:ff:ff:ff:ff", "00:00:00:00:00:0a"])),
    }
    texts, yes, no = [], set(), set()
    for i in range(n):
        t = word()
        for _ in range(rng.randrange(3)):
            real = rng.random() < 0.6
            kind = rng.choice(list(good if real else bad))
            cue, v = (good if real else bad)[kind]()
            t += f" {cue} {v} " + " ".join(word() for _ in range(12))
            (yes if real else no).add((i, kind, t.rindex(v), t.rindex(v) + len(v)))
        if rng.random() < 0.5:
            t += rng.choice([f" mail {word()}@{word()}.com ok", f" {word()}@{word()}.zz ok", " +1 (212) 555-0000 ok", " visa 4111 1111 1111 1111 ok", f" 4{d(15)} ok", " 999.1.1.1 ok", f" login {rng.randrange(1, 255)}.8.8.{rng.randrange(255)} ok"])
        texts.append(t)
    return texts, yes, no


def test_whole_result_against_plain_python_on_planted_data(spark):
    ts, yes, no = planted()
    ts += texts() + ts[:5]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(ts)], "doc_id long, text string, base_spans int, spans string").repartition(3)
    got = {r.doc_id: [(x.kind, x.start, x.end) for x in r.spans] for r in pii.find_pii(df).collect()}
    want, rates = plain(ts)
    for i, w in enumerate(want):
        assert got[i] == w, ts[i]
    added = {(i, *x) for i in range(1500) for x in got[i] if x[0] in pii.LOOSE}
    assert len(added & yes) / len(added) >= 0.9 and len(added & yes) / len(yes) >= 0.9, (len(added & yes), len(added), len(yes))
    assert len(added & no) <= 0.1 * len(no)
    assert all(v > 0.5 for kind in pii.LOOSE for v in pii.reliabilities(rates[kind]).values())
    # repeated rows get equal results
    assert got[len(ts) - 5] == got[0]


def test_reliabilities_recover():
    rng = random.Random(3)
    counts: dict = {}
    for _ in range(20_000):
        y = rng.random() < 0.4
        vote = tuple(rng.choices((-1, 0, 1), w)[0] for w in ([(0.05, 0.05, 0.9), (0.1, 0.3, 0.6), (0.1, 0.6, 0.3), (0.2, 0.2, 0.6)] if y else [(0.9, 0.05, 0.05), (0.6, 0.3, 0.1), (0.3, 0.6, 0.1), (0.6, 0.2, 0.2)]))
        counts[("phone_local", -1, vote, 1)] = counts.get(("phone_local", -1, vote, 1), 0) + 1
    post, rates = pii.expectation_maximisation(counts)
    got = pii.reliabilities(rates["phone_local"])
    assert all(abs(got[k] - x) < 0.08 for k, x in zip(pii.LABELERS, (0.947, 0.857, 0.75, 0.75), strict=True)), got
    w = pii.train_classifier(counts, post)
    assert w["shape=1"] > w["context=1"] > 0 > w["shape=-1"]
    assert pii.expectation_maximisation({}) and pii.train_classifier({}, {}) == {}


def test_no_spans_and_empty(spark):
    df = spark.createDataFrame([(1, "nothing here"), (2, None)], "doc_id long, text string")
    assert [r.spans for r in pii.digest(pii.find_pii(df)).collect()] == ["", ""]
    assert pii.find_pii(df.limit(0)).count() == 0
