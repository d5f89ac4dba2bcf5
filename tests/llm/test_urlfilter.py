import random
from collections import Counter, defaultdict

from stavelight.llm import urlfilter as uf


def brute(urls):
    """The tree in plain Python, over lists."""
    rows = []
    for u in urls:
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            end = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
            path = rest[end:].split("?")[0].split("#")[0]
        fit = [(len(h + p), h + p, v) for h, p, v in uf.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fit)[1:] if fit else (None, None)
        parts = (path[1:] if path.startswith("/") else path).split("/")
        rows.append([host, path, rule, verdict, ["*" if any(c in "0123456789" for c in x) else x for x in parts], ""])
    i = 0
    while sum(len(r[4]) > i for r in rows) >= uf.LEAST:
        n, total = Counter((h, r[5], r[4][i]) for r in rows if len(r[4]) > i for h in above(r[0])), Counter((h, r[5]) for r in rows if len(r[4]) > i for h in above(r[0]))
        new = []
        for r in rows:
            if len(r[4]) <= i:
                new.append(r[5])
                continue
            s = r[4][i]
            fixed = s != "*" and any(n[(h, r[5], s)] >= uf.LEAST and n[(h, r[5], s)] >= uf.SHARE * total[(h, r[5])] for h in above(r[0]))
            new.append(r[5] + "/" + (s if fixed else "*"))
        for r, t in zip(rows, new, strict=True):
            r[5] = t
        i += 1
    for r in rows:
        r[5] += "/*" * max(0, len(r[4]) - i)
    to = {(h, r[5]): r[5] for r in rows for h in above(r[0])}
    stat = {k: [0, 0] for k in to}
    prefix = defaultdict(lambda: [0, 0])
    for r in rows:
        for h in above(r[0]):
            stat[(h, r[5])][r[3] == "allow"] += r[3] is not None
        for p in prefixes(r[5]):
            prefix[p][r[3] == "allow"] += r[3] is not None
    for j in range(max((len(prefixes(t)) for _, t in to), default=0) - 1, 0, -1):
        now, pool, wide = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0]), {}
        for (h, t), m in to.items():
            x = m.split("/")
            wide[m] = "/".join(["*" if k == j else y for k, y in enumerate(x)])
            for k in (0, 1):
                now[(h, m)][k] += stat[(h, t)][k]
                pool[(h, wide[m])][k] += stat[(h, t)][k]
        for key, m in list(to.items()):
            (b, g), (pb, pg) = now[(key[0], m)], pool[(key[0], wide[m])]
            n, rest = b + g, pb + pg - b - g
            if n and rest:
                rate = pb / (pb + pg)
                if abs(b / n - (pb - b) / rest) <= uf.Z * (rate * (1 - rate) * (1 / n + 1 / rest)) ** 0.5:
                    to[key] = wide[m]
    final = defaultdict(lambda: [0, 0])
    for (h, t), m in to.items():
        for k in (0, 1):
            final[(h, m)][k] += stat[(h, t)][k]
    out = []
    for h, p, rule, v, _, t in rows:
        purity = 0.5
        for b, g in [prefix[x] for x in prefixes(t)] + [final[(s, to[(s, t)])] for s in above(h)]:
            purity = (b + uf.SMOOTHING * purity) / (b + g + uf.SMOOTHING)
        out.append((h, p, rule, v or ("block" if purity >= uf.REJECT else "allow"), to[(h, t)], round(purity, 9)))
    return out


def above(host):
    """All hosts, the last labels, the host."""
    x = host.split(".")
    return list(dict.fromkeys(["", *[".".join(x[-k:]) for k in range(1, uf.LEVELS + 1)], host]))


def prefixes(template):
    x = template.split("/")
    while len(x) > 1 and x[-1] == "*":
        x.pop()
    return ["/".join(x[:k]) for k in range(1, len(x) + 1)]


def test_against_brute_force(spark):
    rng = random.Random(5)
    urls = [None, "", "nothing", "http://", "http://A.ORG", "x://b.com/de/1?x#y", "http://h.com?q=://z/fr/", "ftp://a.b.example.org/en/12/3/4/5/6/7", "http://ORG/é//", "://com/fr/", "http://xcom/fr/a", "http://a.com/x\ny/z"]
    for _ in range(900):
        host = rng.choice(["a.example.org", "example.org", "b.com", "m.c.com", "d.net"])
        first = rng.choice(["en", "fr", "de", "es", "tag", "p"])
        urls.append(f"http://{host}/{first}/{rng.choice(['news', 'shop', str(rng.randrange(99)), f'w{chr(97 + rng.randrange(26))}x'])}" + rng.choice(["", "/", f"/{rng.randrange(9)}.html", "?a=/b", "#c/d", "/a/b/c/d"]))
    urls += [f"http://x{i % 9}.net/{rng.choice(['en', 'es', 'fr', 'de'])}/{'long/' * (i % 7)}{i}" for i in range(200)]
    urls += ["http://h.net/" + "deep/" * 3000, "http://" + "a." * 2000 + "net/es/1", "*://*/*/*"] + urls[:30]
    df = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)], "page_id long, url string, host string").repartition(3)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict, r.template, round(r.purity, 9)) for r in uf.judge_urls(df).collect()}
    want = dict(enumerate(brute(urls)))
    assert got == want
    assert {v[3] for v in want.values() if v[2] is None} == {"allow", "block"}  # the tree decides both ways
    assert any("*" not in t[1:3] for t in (v[4] for v in want.values()))


def test_rejected_template(spark):
    rows = [(i, f"http://s.net/buy/{i}", True if i < 9 else None) for i in range(20)] + [(100 + i, f"http://s.net/read/{i}", False if i < 9 else None) for i in range(20)]
    df = spark.createDataFrame(rows, "page_id long, url string, bad boolean")
    out = {r.page_id: r.verdict for r in uf.judge_urls(df, rules=(), bad=df.bad).collect()}
    assert all(out[i] == "block" for i in range(20)) and all(out[100 + i] == "allow" for i in range(20))


def test_branches_and_hosts_inherit(spark):
    """A branch blocked on labelled hosts is blocked on an unlabelled one of the same domain; alike siblings merge, others don't."""
    bad = {"shop": True, "ads": True, "news": False}
    rows = [(f"http://h{i % 6}.net/{k}/x/{i}", v if i % 6 else None, i) for i in range(120) for k, v in bad.items()]
    df = spark.createDataFrame([(u, b, "old") for u, b, _ in rows], "url string, bad boolean, Verdict string")
    out = {r.url: r for r in uf.judge_urls(df, rules=(), bad=df.bad).collect()}
    for u, _, i in rows:
        k = u.split("/")[3]
        assert out[u].verdict == ("block" if bad[k] else "allow"), u
        assert out[u].template.startswith(f"/{k}/") or k != "news" or i % 6


def test_empty_table(spark):
    assert uf.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
