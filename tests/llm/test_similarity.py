"""Operators 6 and 10 against brute force."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kerbflow.llm import multi_order_join, phrase_index

from .conftest import prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


@pytest.fixture(scope="module")
def benchmark(spark, texts):
    by = dict(texts)
    passage = by[300].split()
    rows = [(1, " ".join(passage[45:70]).upper()), (2, "ONE, two!"), (3, " ".join(by[500].split()[8990:]) + " unseen"), (4, "never seen words"),
            (5, None), (6, ""), (2, "ONE, two!"), (10, " ".join(by[105].split()[:10])), (None, " ".join(by[5].split()[3:13])), (11, by[205])]
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "item_id bigint, text string, terms string, w string")


def expected_hits(texts, items):
    wins = set()
    for item, text in items:
        w = words(text)
        for s in range(max(len(w) - 10, 0) + 1 if w else 0):
            wins.add(("" if item is None else str(item), tuple(w[s:s + 10])))
    out = {}
    for doc, text in texts:
        w = words(text)
        hits, found = set(), set()
        for item, terms in wins:
            for s in range(len(w) - len(terms) + 1):
                if tuple(w[s:s + len(terms)]) == terms:
                    hits |= set(range(s, s + len(terms)))
                    found.add(item)
        n, old_hits, old_found = out.get(doc, (0, set(), set()))
        out[doc] = (max(n, len(w)), hits | old_hits, found | old_found)
    return {d: (n, len(h), sorted(f)) for d, (n, h, f) in out.items()}


def test_phrase_index(docs, texts, benchmark, monkeypatch):
    monkeypatch.setattr(phrase_index, "BLOCK", 40)  # several blocks of words
    got = {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in phrase_index.decontaminate(docs, benchmark).collect()}
    items = [(r.item_id, r.text) for r in benchmark.collect()]
    assert got == expected_hits(texts, items)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "x alpha beta gamma y"), (2, "alpha x x beta gamma"), (3, "gamma alpha"), (4, "alpha " + "x " * 9 + "gamma")],
                                 "doc_id bigint, text string")
    items = spark.createDataFrame([(9, "alpha gamma")], "item_id bigint, text string")
    search = phrase_index.plan_search(docs, items)
    index = phrase_index.build_index(docs, search)
    near = {(r.doc_id, abs(r.off)) for r in phrase_index.proximity_matches(index, search, slop=3).collect()}
    assert near == {(1, 1), (2, 3), (3, 2)}
    assert phrase_index.phrase_matches(index, search).count() == 0


def test_phrase_index_empty(docs, nothing, benchmark):
    assert phrase_index.decontaminate(nothing, benchmark).count() == 0
    none = phrase_index.decontaminate(docs, benchmark.where("false"))
    assert none.where("contaminated").count() == 0 and none.count() == docs.select("doc_id").distinct().count()


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def expected_components(texts):
    sets = [(i, shingles(t)) for i, t in texts]
    root = {i: i for i, _ in texts if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    named = [(i, s) for i, s in sets if i is not None and s]
    for k, (a, x) in enumerate(named):
        for b, y in named[:k]:
            if 100 * len(x & y) >= 75 * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return Counter((i, len(s), None if i is None else find(i)) for i, s in sets)


@pytest.mark.parametrize("rounds", [0, 6])
def test_near_duplicates(docs, texts, monkeypatch, rounds):
    monkeypatch.setattr(multi_order_join, "BLOCK", 3000)  # several blocks in a partition
    plain = multi_order_join.connected
    monkeypatch.setattr(multi_order_join, "connected", lambda rows: plain(rows, max_rounds=rounds))
    got = Counter(tuple(r) for r in multi_order_join.near_duplicates(docs).collect())
    assert got == expected_components(texts)


def test_near_duplicates_of_different_texts_under_one_id(spark, texts):
    by = dict(texts)
    rows = [(1, by[5]), (2, by[6]), (3, by[5]), (3, by[6]), (4, by[7])]
    got = multi_order_join.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (3, 1), (4, 4)} and len(got) == 5


def test_near_duplicates_empty(nothing):
    assert multi_order_join.near_duplicates(nothing).count() == 0


def test_group_whose_members_only_meet_in_the_middle(spark):
    """Each copy replaces another tenth of one text: copies are like the original, not like each other."""
    base = [f"w{i}" for i in range(400)]
    rows = [(50, " ".join(base))]
    for k in range(9):
        own = base.copy()
        own[40 * k:40 * k + 40] = [f"e{k}x{i}" for i in range(40)]
        rows.append((k, " ".join(own)))
    got = multi_order_join.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert Counter(tuple(r) for r in got.collect()) == expected_components(rows)
    assert got.agg(F.countDistinct("component_id")).first()[0] == 1


def test_rounds_end_when_they_help_no_more(spark, monkeypatch):
    """Unlike documents made of common passages: no round connects any, so the second look lists the pairs."""
    rng, calls, plain = random.Random(8), [], multi_order_join.verified
    passages = [prose(rng, 20) for _ in range(12)]
    rows = [(i, " ".join(passages[k] for k in sorted(rng.sample(range(12), 4)))) for i in range(110)]
    monkeypatch.setattr(multi_order_join, "verified", lambda pairs, sets: calls.append(1) or plain(pairs, sets))
    got = multi_order_join.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert Counter(tuple(r) for r in got.collect()) == expected_components(rows)
    assert len(calls) <= 2


def test_sets_leave_the_disk(spark, docs):
    """Once written, what a step needed is emptied: of all sets only those that may link stay, once."""
    from kerbflow.llm import common

    common.release(docs)
    found = multi_order_join.near_duplicates(docs.select("doc_id", "text"))
    held = [path.rsplit("/", 1)[1] for path, _ in common.WRITTEN]
    assert not [x for x in held if x.startswith(("shingle-sets", "linkable", "prefixes", "members"))], held
    assert any(x.startswith("set-rows") for x in held) and found.count() == docs.count()
