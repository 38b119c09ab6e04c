"""Filter interactions: against a walk through all orders."""

import collections
import itertools
import re

import pytest

from panelwright.llm import filter_audit

FIELDS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def brute_audit(rows, labels):
    """rows: (doc_id, text, source); every order is applied to every row."""
    smallest = {}
    for i, text, _ in rows:
        if i is not None:
            smallest[text or ""] = min(i, smallest.get(text or "", i))
    facts = []
    for i, text, source in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": i is not None and smallest[text] < i,
        }
        own = [x for x in labels if i is not None and x[0] == i]
        facts.append((source or "", {k for k, v in fails.items() if v}, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    want, shapley = {}, collections.Counter()
    for part in {f[0] for f in facts}:
        for order in itertools.permutations("ABCDE"):
            left = own = [f for f in facts if f[0] == part]
            for step, name in enumerate(order, 1):
                out, left = [f for f in left if name in f[1]], [f for f in left if name not in f[1]]
                late = sum(name in f[1] for f in own) - len(out)
                alone = sum(f[1] == {name} for f in own)
                want[part, "".join(order), step] = [len(left), len(out), late, alone, sum(f[2] for f in out), sum(f[3] for f in out)]
                shapley[part, name] += len(out)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in want.items()}


def check(docs, labels):
    rows = [(r.doc_id, r.text, r.source) for r in docs.select("doc_id", "text", "source").collect()]
    known = [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()]
    got = filter_audit.audit(docs, labels).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r[c] for c in FIELDS) for r in got} == brute_audit(rows, known)
    assert len(got) == 600 * len({r[2] or "" for r in rows})


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 0), (2, 1, None), (2, 0, 1), (5, None, 1), (None, 1, 1), (10, 1, 1), (77, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_audit_of_awkward_rows(awkward, labels):
    docs = awkward.selectExpr("*", "if(doc_id % 3 = 0, null, concat('s', doc_id % 2)) source", "text as hash", "1 as bits", "'n' as n", "'p' as part")
    check(docs, labels)
    check(docs.unionByName(docs), labels)


def test_audit_of_many_copies(spark, copies, labels, monkeypatch):
    monkeypatch.setattr(filter_audit, "HOT_SHARE", 20)
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(7000 + i, f"{words} {'ABC' * (i % 4)} {'$' * (i % 3 == 0)} {'w1 ' * (i % 5) * 9}{i % 50}") for i in range(400)]
    docs = copies.union(spark.createDataFrame(rows, "doc_id long, text string"))
    docs = docs.selectExpr("*", "if(doc_id % 3 = 0, 'hot', if(doc_id % 7 = 0, null, '')) source")
    check(docs.union(docs.filter("doc_id % 11 = 0")), labels)


def test_audit_of_nothing(empty, labels):
    assert filter_audit.audit(empty.selectExpr("*", "'s' as source"), labels).count() == 0


def test_audit_without_labels(awkward, labels):
    got = filter_audit.audit(awkward.selectExpr("*", "null as source"), labels.limit(0))
    assert got.filter("good_lost != 0 or toxic_lost != 0").count() == 0 and got.select("part").distinct().collect() == [("",)]
