"""Operators 3, 4, 5 and 8 against the libraries and plain Python."""

import gc
import hashlib
import random
import re
import tracemalloc
import weakref
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kerbflow.llm import bitplane, digest_index, heap_bpe, license_compression
from kerbflow.llm.common import worker_state
from kerbflow.session import work_path

from .conftest import prose

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
word, byte = Tokenizer.from_file(WORD), Tokenizer.from_file(BYTE)
encoder, count = bitplane.WordEncoder(WORD), heap_bpe.counter(BYTE)
odd = st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("  \n\t'sSrRe\x01\x85　"))) | st.sampled_from(
    ["<|endoftext|>", "a<|endoftext|> b", "<|startoftext|>x", "it'S we'RE", "a  b \n\n c"])


@settings(max_examples=300, deadline=None)
@given(odd)
def test_one_text_as_the_library_has_it(text):
    assert np.frombuffer(encoder(text), "<u4").tolist() == word.encode(text, add_special_tokens=False).ids
    assert count(text) == len(byte.encode(text, add_special_tokens=False).ids)


def test_long_piece_is_merged_in_reasonable_time():
    assert count("ab" * 100_000) == len(byte.encode("ab" * 100_000).ids)


@pytest.mark.parametrize("layout", ["byte", "bit"])
@pytest.mark.parametrize("n", [1, 7, 8, 1000])
def test_planes_round_trip(layout, n):
    ids = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint32)
    assert (bitplane.from_planes(bitplane.to_planes(ids, layout), n, layout) == ids).all()


@given(st.binary(), st.binary())
def test_crc32_join(a, b):
    assert bitplane.crc32_join(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


@pytest.mark.parametrize("layout, size", [("byte", 65_536), ("bit", 100)])
def test_id_files(docs, texts, layout, size):
    chunks = bitplane.write_planes(docs, WORD, 2, chunk_ids=size, layout=layout)
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in bitplane.read_documents(chunks).collect()]
    at, want = 0, []
    for doc_id, text in sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        ids = word.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want


def test_token_counts(docs, texts):
    got = Counter(tuple(r) for r in heap_bpe.token_counts(docs, BYTE).collect())
    sizes = [(i, len((t or "").encode()), len(byte.encode(t or "").ids)) for i, t in texts]
    assert got == Counter((*s, s[2] > 1024) for s in sizes)


def expected_groups(texts):
    digest = lambda t: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()
    size = Counter(digest(t) for _, t in texts)
    first = {}
    for i, t in texts:
        if i is not None:
            first[digest(t)] = min(i, first.get(digest(t), i))
    return Counter((i, k := first.get(h), size[h], i == k, h) for i, t in texts for h in [digest(t)])


def test_digest_index(spark, docs, texts):
    index = digest_index.DigestIndex(spark, work_path(spark, "test-index"), buckets=4)
    assert Counter(map(tuple, digest_index.deduplicate(docs, index).collect())) == expected_groups(texts)
    size = index.table().count()
    index.add(digest_index.digests(docs))  # again: nothing new
    assert index.table().count() == size == len({r[4] for r in expected_groups(texts)})
    # a later batch keeps what was there first, also by another session's handle on the same path
    later = spark.createDataFrame([(7000, next(t for i, t in texts if i == 100)), (7001, "never seen")], "doc_id bigint, text string")
    index.drop()
    again = digest_index.DigestIndex(spark, index.path, buckets=4)
    got = {r.doc_id: (r.keep_id, r.kept) for r in digest_index.deduplicate(later, again).collect()}
    assert got == {7000: (100, False), 7001: (7001, True)}
    again.drop()


def test_license_blocks(spark):
    mit = license_compression.TEMPLATES["MIT-permission"]
    rows = [(1, "Some prose here.\nReleased under the MIT License.\nMore prose."), (2, "Plain words, no notice."), (3, None), (4, ""),
            (5, "Intro. " + mit.replace(" to deal in", " to  DEAL\nin").replace("free of charge", "at no charge")),
            (6, "A warranty of an unrelated kind came with the washing machine that we bought in spring."),
            (None, "word " * 5000 + "Licensed under CC BY-NC 4.0. " + "word " * 5000), (1, "Released under the MIT License.")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, block string")
    got = sorted((r.doc_id or 0, r.license, r.missing, r.confirmed) for r in license_compression.scan(df).collect())
    assert got[:3] == [(0, "CC-BY-NC-4.0", 0, True), (1, "MIT", 0, True), (1, "MIT", 0, True)]
    assert [g for g in got if g[0] == 5] == [(5, "MIT-permission", 2, True)]
    assert [g[3] for g in got if g[0] == 6] == [False] and not [g for g in got if g[0] in (2, 3, 4)]


def test_license_cut_is_exact(spark):
    text = "Here. Licensed under the Apache License, Version 2.0.\nThere."
    row = license_compression.scan(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert text[row.start:row.start + row.length] == row.text == "Licensed under the Apache License, Version 2.0."
    assert row.differences == "" and row.extra == 0


def confirmed_licenses(text):
    """License, words missing and words added of each confirmed row, in the order of the text."""
    return [(r[3], r[-5], r[-4]) for r in license_compression.Scanner(license_compression.TEMPLATES).scan(text) if r[-3]]


def test_every_license_of_a_text():
    mit, gpl, cc = (license_compression.TEMPLATES[k] for k in ("MIT", "GPL-3.0", "CC-BY-NC-4.0"))
    for gap in (" ", "\n", " Or, as you like, this one holds. "):
        assert confirmed_licenses(mit + gap + gpl) == [("MIT", 0, 0), ("GPL-3.0", 0, 0)]
    assert confirmed_licenses("\n".join([mit, gpl, cc, mit])) == [("MIT", 0, 0), ("GPL-3.0", 0, 0), ("CC-BY-NC-4.0", 0, 0), ("MIT", 0, 0)]


def test_license_wording_decides():
    """Exact notices, whatever stands around them and however they are wrapped."""
    scanner, rng = license_compression.Scanner(license_compression.TEMPLATES), random.Random(6)
    for name, template in license_compression.TEMPLATES.items():
        assert confirmed_licenses(template) == [(name, 0, 0)]
        for width in (1, 5, 12):
            words = template.split()
            wrapped = "\n".join(" ".join(words[k:k + width]) for k in range(0, len(words), width))
            assert confirmed_licenses(wrapped) == [(name, 0, 0)]
        for before in (37, 199, 333):
            text = prose(rng, before) + " " + template + " " + prose(rng, 150) + " whose license is another matter. " + prose(rng, 90)
            assert confirmed_licenses(text) == [(name, 0, 0)]
            row = next(r for r in scanner.scan(text) if r[-3])
            assert text[row[1]:row[1] + row[2]] == row[-1] == template and row[4] == 1
    assert confirmed_licenses("This LICENSE is of no known kind, released, and under review by the editors.") == []


def test_empty_tables(spark, nothing):
    index = digest_index.DigestIndex(spark, work_path(spark, "test-index"), buckets=2)
    assert digest_index.deduplicate(nothing, index).count() == 0
    index.drop()
    assert heap_bpe.token_counts(nothing, BYTE).count() == 0
    assert bitplane.read_documents(bitplane.write_planes(nothing, WORD, 2)).count() == 0
    assert license_compression.scan(nothing).count() == 0


def test_license_versions_and_variants_are_refused():
    t = license_compression.TEMPLATES
    wrong = {
        t["GPL-3.0"].replace("version 3", "version 4"): [], t["GPL-3.0-header"].replace("version 3", "version 2"): ["GPL-2.0-header"],
        t["GPL-3.0-header"].replace("General", "Lesser General"): [], t["CC-BY-4.0"].replace("4.0", "3.0"): [],
        t["CC-BY-4.0"].replace("Attribution", "Attribution-ShareAlike"): ["CC-BY-SA-4.0"],
        t["CC-BY-4.0"].replace("Attribution", "Attribution-NoDerivatives"): ["CC-BY-ND-4.0"],
        t["GPL-3.0"].replace("is licensed", "is not licensed"): [], "This was never " + t["MIT"]: [], "Licensed under CC BY-NC-SA 4.0.": [],
        t["Apache-2.0"].replace("2.0", "1.1"): [], t["GPL-3.0"].replace("version 3.", "version 3 of 2007 or any later version."): ["GPL-3.0"],
        t["MIT-permission"].replace("Permission", "# Copyright 2024\nPermission").replace("the rights", "all the rights"): ["MIT-permission"]}
    for text, names in wrong.items():
        assert [name for name, *_ in confirmed_licenses(text)] == names, text
    scanner = license_compression.Scanner(t)
    for name, notice in t.items():  # every notice saves most with its own template
        assert scanner.ranked(notice)[0][0] == name and scanner.ranked(notice)[0][1] > 0


def test_half_of_the_ids_null(spark):
    """The rows without an id are spread over all shards."""
    rows = [(None if k % 2 else k, f"text {k} " + "word " * (k % 7)) for k in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        chunks = bitplane.write_planes(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    sizes = sorted(r.n for r in chunks.groupBy("shard").agg(F.sum(F.size("doc_ids")).alias("n")).collect())
    assert len(sizes) > 2 and sizes[-1] < 3 * sizes[len(sizes) // 2]
    assert bitplane.read_documents(chunks).count() == 6000


def test_texts_encoded_together(monkeypatch):
    """Many texts cost few calls of the library, and a full memory gives the same ids."""
    rng = random.Random(6)
    texts = [prose(rng, 30) + odd for odd in ("", " it'S we'RE", "<|endoftext|>", " a\x01b", " \u00e9t\u00e9 42nd", "<|startoftext|>x") * 20] + ["", " \n"]
    want = [np.array(word.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    own, calls = bitplane.WordEncoder(WORD), []
    plain = own.library
    monkeypatch.setattr(own, "library", lambda parts: calls.append(1) or plain(parts))
    assert list(bitplane.in_groups(own, texts)) == want and len(calls) < len(texts) // 2
    small = bitplane.WordEncoder(WORD, words=50, pieces=40)
    assert list(bitplane.in_groups(small, texts, 500)) == want and list(bitplane.in_groups(small, [])) == []


def test_latin_words_go_to_the_model(monkeypatch):
    """Words of Latin-1 letters cost no call of the whole library, and a word of a group of texts is looked up once."""
    texts = ["\u00c9T\u00c9s,\u00fcber stra\u00dfe'S \u00d8l na\u00efve42\u00e9 \u00c0\u00d7\u00f7 \u00aa\u00b5 x\u00ff\u00fe\u00de", " \u00c9t\u00e9 ", "", "\x7f\x02a\u0301", "e\u0301t H\u0331 \u0130"] * 300
    want = [np.array(word.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    own, asked = bitplane.WordEncoder(WORD), []
    plain = own.library
    monkeypatch.setattr(own, "library", lambda parts: asked.extend(parts) or plain(parts))
    assert list(bitplane.in_groups(own, texts, 400)) == want
    assert "\u00fcber" not in " ".join(asked) and "\u00d8l" not in " ".join(asked)


def test_remembered_words_take_little_memory():
    """100,000 words and their ids take less than 60 bytes each, with the few pieces that are remembered."""
    own = bitplane.WordEncoder(WORD, words=200_000, pieces=5_000)
    tracemalloc.start()
    for lo in range(0, 100_000, 5_000):
        list(bitplane.in_groups(own, [" ".join(f"the {k * 7919 % 100_003:x}q" for k in range(lo, lo + 5_000))]))
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert len(own.words) > 100_000 and held + own.words.nbytes + own.ids.nbytes < 6e6


def test_words_asked_for_again_stay(monkeypatch):
    """A full memory keeps the words that several groups of texts had, and all words of one large group are encoded."""
    own, asked = bitplane.WordEncoder(WORD, words=100, pieces=20), []
    plain = own.library
    monkeypatch.setattr(own, "library", lambda parts: asked.extend(parts) or plain(parts))
    for k in range(12):
        text = "\u4e2d\u6587 " + " ".join(f"\u4e2d{j}" for j in range(60 * k, 60 * k + 60 + 200 * (k == 11)))
        assert np.frombuffer(own(text), "<u4").tolist() == word.encode(text, add_special_tokens=False).ids
    assert " ".join(asked[:11]).split().count("\u4e2d\u6587") == 1


def test_worker_keeps_one_state():
    """What an earlier step remembered does not stay beside that of the next."""
    class Large:
        pass

    first = worker_state("test first", Large)
    gone = weakref.ref(first)
    assert worker_state("test first", Large) is first
    del first
    gc.collect()
    assert gone() is not None and worker_state("test second", Large) is not None
    gc.collect()
    assert gone() is None


@settings(max_examples=200, deadline=None)
@given(st.lists(odd, max_size=5), st.integers(1, 40))
def test_texts_in_any_groups(texts, most):
    want = [np.array(word.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert list(bitplane.in_groups(encoder, texts, most)) == want


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(max_codepoint=0x180), max_size=12))
def test_latin_text_as_the_library_has_it(text):
    assert np.frombuffer(encoder(text), "<u4").tolist() == word.encode(text, add_special_tokens=False).ids
