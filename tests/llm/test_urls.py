import random

import pytest

from pagewright.llm import urls as U


def brute(captures, entries):
    active = {}
    for lst, pattern, at, action in sorted((e for e in entries if None not in e and e[3] in ("add", "remove")), key=lambda e: (e[2], e[3])):
        active.setdefault((lst, pattern.lower()), []).append((at, action))
    out = []
    for key, host, path, at in captures:
        labels, parts = host.split("."), [p for p in path.split("/") if p]
        tried = {".".join(labels[i:]) for i in range(len(labels))} | {host + "/" + "/".join(parts[: i + 1]) for i in range(len(parts))} if host else set()
        hits = []
        for (lst, pattern), changes in active.items():
            past = [a for t, a in changes if at is not None and t <= at]
            if pattern in tried and past and past[-1] == "add":
                hits.append((lst, pattern))
        lists = sorted({x for x, _ in hits})
        best = min(((-len(p), p) for _, p in hits), default=(0, None))[1]
        out.append((key, host, ",".join(lists), best, bool(set(lists) - {U.ALLOW}) and U.ALLOW not in lists))
    return sorted(out, key=str)


@pytest.mark.parametrize(("few", "share"), [(U.FEW, U.SHARE), (1, U.SHARE), (1, 30)])
def test_against_brute_force(spark, monkeypatch, few, share):
    monkeypatch.setattr(U, "FEW", few)
    monkeypatch.setattr(U, "SHARE", share)
    r = random.Random(1)
    hosts = ["a.example.com", "b.a.example.com", "example.com", "x.org", "com", "y.net"]
    paths = ["/", "/p", "/p/q", "/p//q/r", ""]
    entries = [(r.choice(["spam", "adult", U.ALLOW]), r.choice([*hosts, "example.com/p", "x.org/p/q", "A.example.com/p/q"]), r.randint(0, 60), r.choice(["add", "add", "remove"])) for _ in range(200)]
    entries += [(None, "com", 0, "add"), ("spam", None, 0, "add"), ("spam", "com", None, "add"), ("spam", "com", 1, "what")]
    caps = [(i, r.choice(hosts), r.choice(paths), r.choice([None, *range(70)])) for i in range(400)] + [(None, "", "", 3), (7, "x.org", "/p", 30), (7, "x.org", "/p", 30)]
    make = lambda h, p, i: None if not h else ["http://", "HTTPS://u:p@", "//"][i % 3] + h.upper() + ["", ":80", "."][i % 3] + p + ["", "?a=/b", "#/c"][i % 3]
    df = spark.createDataFrame([(k, make(h, p, i), t, "clash") for i, (k, h, p, t) in enumerate(caps)], "page_id bigint, url string, fetched int, host string")
    es = spark.createDataFrame(entries, "list string, pattern string, at int, action string")
    assert sorted((tuple(x) for x in U.filter_urls(df, es).collect()), key=str) == brute(caps, entries)
    assert U.filter_urls(df.limit(0), es).count() == 0
    assert U.filter_urls(df, es.limit(0)).filter("blocked").count() == 0
