"""Rounds of changes, each taken into the index that the round before left, against an index built anew."""

import json

from pagewright.operators import incremental
from pagewright.operators import index as I
from pagewright.sources import json_pages
from tests.test_engine import LINKS, PAGES, canonical, idx, kb, wiki, write  # noqa: F401

CHAIN = [("policy-3", "policy-2", "supersedes"), ("policy-4", "policy-3", "supersedes")]


def put(pages, slug, kind, body, extra=()):
    pages[slug] = canonical(slug, kind, body, extra)


def reordered(pages):
    page = pages["long"]
    order = page["block_order"]
    page["block_order"] = [order[0], *reversed(order[2:])]
    page["blocks"].pop(order[1])


def renamed(pages):
    page = pages.pop("hub")
    pages["centre"] = page | {"slug": "centre"}


ROUNDS = {
    "two newer versions": lambda p: (put(p, "policy-3", "source", "# Policy three\n\nNinety days for zebra records.", CHAIN), put(p, "policy-4", "source", "# Policy four\n\nA year for zebra records.", CHAIN)),
    "body of a member of a chain": lambda p: put(p, "policy-2", "source", "# Policy two\n\nRetention is sixty-one days for zebra records."),
    "middle of a chain goes": lambda p: p.pop("policy-3"),
    "head of a chain goes": lambda p: p.pop("policy-4"),
    "slug of the hub": renamed,
    "block goes, others are reordered": reordered,
    "no blocks": lambda p: p["beta"].update(blocks={}, block_order=[]),
    "a fork and a circle": lambda p: (put(p, "fork", "source", "# Fork\n\nOther.", [("fork", "policy-1", "supersedes")]), put(p, "policy-1", "source", "# Policy one\n\nRetention.", [("policy-1", "policy-2", "supersedes")])),
    "many at once": lambda p: (p.pop("alpha"), put(p, "alpha-two", "concept", "# Alpha\n\nThe same title."), put(p, "new", "entity", "# New\n\nSee [[alpha]].", [("new", "fork", "related")])),
}


def test_rounds(spark, idx, tmp_path):  # noqa: F811
    pages = {s: canonical(s, k, b) for s, (k, b) in PAGES.items()}
    index = idx
    for n, (name, change) in enumerate(ROUNDS.items()):
        before = {p["id"]: json.dumps(p, sort_keys=True) for p in pages.values()}
        change(pages)
        write(str(tmp_path / str(n)), list(pages.values()))
        new = json_pages.knowledge_base(json_pages.read_pages(spark, str(tmp_path / str(n))))
        table = lambda d: spark.createDataFrame(list(d.items()), "page_id string, sha256 string")
        delta = incremental.changes(table(before), table({p["id"]: json.dumps(p, sort_keys=True) for p in pages.values()}))
        index = incremental.apply(index, new, delta)
        if n % 4 == 3:
            index = I.settled(index)
        full = I.build(new)
        for t in I.TABLES:
            a, b = getattr(full, t), getattr(index, t)
            assert I.digest(a).collect() == I.digest(b.select(*a.columns)).collect(), (name, t)


def test_nothing_changed(spark, kb, idx):  # noqa: F811
    same = incremental.apply(idx, kb, idx.pages.select("page_id").limit(0))
    assert all(I.digest(getattr(idx, t)).collect() == I.digest(getattr(same, t)).collect() for t in I.TABLES)
    assert same.heads is idx.heads and same.adjacency is idx.adjacency  # what nothing hangs on isn't touched
