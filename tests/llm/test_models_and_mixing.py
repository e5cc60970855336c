"""Operators 1, 2, 7 and 9, and the pipeline."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbflow.llm import chat_snapshots, masked_lm, mixing, string_kernel

from .conftest import DOCS, prose

CHAT = "conv_id bigint, turn bigint, role string, text string, c string, t string, pos string, segment string"


def expected_chat(rows):
    talks = defaultdict(set)
    for c, t, role, text in rows:
        talks[c].add((t, role, text))
    mark = lambda v: "-" if v is None else f"{len(v)}={v}"
    digest = lambda x: hashlib.md5(f"{mark(x[1])}|{mark(x[2])}".encode()).hexdigest()
    talks = {c: sorted(v, key=lambda x: (x[0] is not None, x[0] or 0, digest(x))) for c, v in talks.items()}
    plain = {c: [digest(x) for x in v] for c, v in talks.items()}
    out = Counter()
    for c, v in plain.items():
        longer = any(len(o) > len(v) and o[:len(v)] == v for o in plain.values())
        equal = min((d for d, o in plain.items() if o == v), key=lambda d: (d is not None, d or 0))
        if not longer and equal == c:
            for s in range(0, len(v), chat_snapshots.SEGMENT):
                text = "".join(f"<|im_start|>{r or ''}\n{x or ''}<|im_end|>\n" for _, r, x in talks[c][s:s + chat_snapshots.SEGMENT])
                out[(c, len(v), s // chat_snapshots.SEGMENT, text)] += 1
    return out


def test_chat_snapshots(spark):
    rng = random.Random(2)
    rows = []
    for c in range(12):
        talk = [(c * 100, t, "user" if t % 2 == 0 else "assistant", "hello" if t == 0 else prose(rng, 5)) for t in range(rng.randint(1, 9))]
        rows += talk
        for k in range(1, len(talk)):  # logged again after each turn
            rows += [(c * 100 + k, *x[1:]) for x in talk[:k]]
        rows += [(c * 100 + 50, *x[1:]) for x in talk] + talk[:2]
    rows += [(5000, t, "user", f"long {t}") for t in range(300)] + [(5001, t, "user", f"long {t}") for t in range(150)]
    rows += [(None, 0, None, None), (None, None, "user", ""), (6000, 0, "user", "tie a"), (6000, 0, "user", "tie b"), (6001, 3, None, "")]
    df = spark.createDataFrame([(*r, "x", "y", "z", "s") for r in rows], CHAT).repartition(3)
    got = Counter(tuple(r) for r in chat_snapshots.rendered(df).collect())
    assert got == expected_chat(rows)
    assert chat_snapshots.rendered(df.where("false")).count() == 0


def expected_mixture(rows, entropy, repetitions, budget, block_tokens):
    key = lambda *p: int(hashlib.md5("|".join(["mix", *map(str, p)]).encode()).hexdigest()[:15], 16)
    units = defaultdict(int)
    for i, text, source in rows:
        units[(source, i, text)] += max(len((text or "").encode().split()), 1)
    size = defaultdict(int)
    for (source, _, _), n in units.items():
        size[source] += n
    total, top = sum(size.values()), max(size.values())
    share = {s: n / total for s, n in size.items()}

    def spread(e):
        w = {s: p**e for s, p in share.items()}
        z = sum(w.values())
        return {s: x / z for s, x in w.items()}

    def fits(e):
        w = spread(e)
        most = max(w[s] / share[s] for s in w) * (budget / total if budget else share[max(share, key=share.get)] / w[max(w, key=w.get)])
        return most <= repetitions * (1 + 1e-12)

    def rich(e):
        return -sum(x * math.log(x) for x in spread(e).values()) >= entropy * math.log(len(share)) - 1e-12

    steps = 1 << 24
    low = max((k for k in _bisect(steps, rich)), default=0) / steps
    first = 0 if fits(0.0) else next(k for k in _bisect_up(steps, fits))
    tau = max(low, first / steps)
    w = spread(tau)
    quota = {s: round(n * (n / top) ** (tau - 1)) if budget is None else round(budget * w[s]) for s, n in size.items()}
    out = Counter()
    for s, n in size.items():
        name = "-" if s is None else f"={s}"
        blocks = math.ceil(n / block_tokens)
        deal = defaultdict(list)
        for (source, i, text), t in units.items():
            if source == s:
                deal[key(*([] if i is None else [i])) % blocks].append((i, text, t))
        for epoch in range(max(math.ceil(quota[s] / n), 1)):
            at = epoch * n
            for block in sorted(deal, key=lambda b: (key(name, epoch, b), b)):
                for i, text, t in sorted(deal[block], key=lambda x: key(epoch, *([] if x[0] is None else [x[0]]))):
                    if at < quota[s]:
                        out[(i, s, t, epoch, block, at)] += 1
                    at += t
    return out


def _bisect(steps, holds):
    if holds(1.0):
        return [steps]
    low, high = 0, steps
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if holds(middle / steps) else (low, middle)
    return [low]


def _bisect_up(steps, holds):
    low, high = 0, steps
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (low, middle) if holds(middle / steps) else (middle, high)
    return [high]


@pytest.mark.parametrize("entropy, repetitions, budget", [(0.95, 4.0, 3000), (1.0, 1.5, 6000), (0.95, 3.0, None), (0.2, 9.0, 2500)])
def test_mixture(spark, entropy, repetitions, budget):
    rng = random.Random(9)
    rows = [(i, prose(rng, rng.randint(1, 60)), "big" if i % 3 else ["s1", "s2", None][i // 3 % 3]) for i in range(120)]
    rows += [(900, None, "s1"), (901, "", "big"), (902, "alone here", "tiny"), (5, rows[5][1], rows[5][2])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("block", F.lit(1)).withColumn("s", F.lit("x"))
    got = mixing.mixture(df, entropy=entropy, repetitions=repetitions, budget=budget, block_tokens=200)
    found = Counter((r.doc_id, r.source, r.tokens, r.epoch, r.block, r.start) for r in got.collect())
    assert found == expected_mixture(rows, entropy, repetitions, budget, 200)
    if budget is None:
        copies = Counter(r.doc_id for r in mixing.apply(df, entropy=entropy, repetitions=repetitions, block_tokens=200).collect())
        assert set(copies) == {r[0] for r in rows} and max(copies.values()) <= 6
        assert mixing.apply(df, entropy=entropy, repetitions=repetitions).columns == df.columns


def test_mixture_deals_hot_ids_by_row(spark):
    """Half of the rows without an id, a quarter with one id: no block is much larger than the others."""
    rng = random.Random(4)
    rows = [(None if i % 2 else 7 if i % 4 else i, f"{i} " + prose(rng, 5), "one") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.mixture(df, repetitions=1.0, block_tokens=500).collect()
    assert Counter((r.doc_id, r.tokens) for r in got) == Counter((i, len(t.split())) for i, t, _ in rows)
    sizes = Counter()
    for r in got:
        sizes[r.block] += r.tokens
    assert len(sizes) > 20 and max(sizes.values()) < 2 * sorted(sizes.values())[len(sizes) // 2]
    starts = sorted((r.start, r.tokens) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))


def test_mixture_empty(nothing):
    assert mixing.mixture(nothing).count() == 0 and mixing.apply(nothing).count() == 0


def test_language(spark):
    rng = random.Random(4)
    alphabets = {"aa": "abcdeé", "bb": "mnopqü", "cc": "adgjmp"}
    talk = lambda lang, n: " ".join("".join(rng.choices(alphabets[lang], k=rng.randint(2, 6))) for _ in range(n))
    rows = [(i, talk(lang, rng.randint(3, 40)), lang, "s", 0, "x", "y", "z") for i in range(300) for lang in [rng.choice(list(alphabets))]]
    rows += [(1000, None, "aa", "s", 0, "x", "y", "z"), (1001, "12 34 !?", "aa", "s", 0, "x", "y", "z"), (1002, "", None, "s", 0, "x", "y", "z"),
             (1003, talk("bb", 40_000) + " mn", "zz", None, 0, "x", "y", "z"), (None, talk("cc", 20), "cc", "s", 0, "x", "y", "z")]
    df = spark.createDataFrame(rows, DOCS)
    model = string_kernel.train(df.where("coalesce(lang, '') <> 'zz'"), train_rows=200, landmarks=60)
    got = {r.doc_id: r for r in string_kernel.identify(df, model).collect()}
    held = [r for r in rows if r[0] is not None and r[0] < 1000 and got[r[0]].held_out]
    assert np.mean([got[r[0]].lang_pred == r[2] for r in held]) > 0.95 and len(held) > 30
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and [got[i].score for i in (1000, 1001, 1002)] == [0] * 3
    assert got[1003].lang_pred == "bb" and got[None].lang_pred == "cc" and got[None].held_out
    assert all(0 <= r.score <= 1 for r in got.values())
    assert string_kernel.train(df.where("false")) is None
    assert {r.lang_pred for r in string_kernel.identify(df, None).collect()} == {"und"}


def test_kernel_is_the_cosine_of_presence():
    """Decision values computed pair by pair from sets of grams, with the model's own gram hash."""
    rng = random.Random(8)
    texts = [prose(rng, 12) for _ in range(20)]
    model = string_kernel.fit(texts, ["a", "b"] * 10, landmarks=20)
    letters = string_kernel.letter_table()

    def sets(text):
        found, _ = string_kernel.grams([text], letters)
        return {n: {c for c in model.columns[n][gram] if c >= 0} for n, (_, gram) in found.items()}

    values, _ = model.decide(texts, letters)
    for text, row in zip(texts[:5], values):
        want = sum(model.weights[n][sorted(s)].sum(axis=0) / math.sqrt(len(s)) for n, s in sets(text).items())
        assert np.allclose(row, want, atol=1e-4)
    assert (values.argmax(axis=1) == [0, 1] * 10).mean() > 0.9


def test_masked_lm(spark):
    rng = random.Random(3)
    nouns, verbs = [f"n{i}" for i in range(20)], [f"v{i}" for i in range(20)]
    line = lambda n: " ".join(f"{a} v{a[1:]} ." for a in rng.choices(nouns, k=n))
    rows = [(i, line(60)) for i in range(400)] + [(900, None), (901, "  "), (902, "v3"), (None, line(3)), (5, "x")]
    rows.append((903, line(12_000)))
    scrambled = line(60).split()
    rng.shuffle(scrambled)
    rows.append((904, " ".join(scrambled)))
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, share string").repartition(3)
    known, weights = masked_lm.train(df, rounds=2, mask=2)
    assert len(known) <= masked_lm.WORDS and {"n1", "v1", "."} <= set(known)
    got = {r.doc_id: r for r in masked_lm.score(df, known, weights).collect()}
    assert [(got[i].n_tokens, got[i].log_prob, got[i].mean_log_prob) for i in (900, 901)] == [(0, 0.0, None)] * 2
    assert got[902].n_tokens == 1 and got[903].n_tokens == 36_000
    start = masked_lm.Network.start().flat()
    before = {r.doc_id: r for r in masked_lm.score(df, known, start).collect()}
    assert got[7].mean_log_prob > before[7].mean_log_prob + 2  # it has learned
    assert got[7].mean_log_prob > got[904].mean_log_prob + 0.3  # and tells order
    # whole texts, in stretches, as word by word
    net = masked_lm.Network.start().load(weights)
    ids = masked_lm.encode(dict(rows)[7], {w.encode(): i for w, i in known.items()})
    each = [net.log_probs(net.contexts(ids, np.array([k])), ids[[k]])[0] for k in range(len(ids))]
    assert math.isclose(sum(map(float, each)), got[7].log_prob, rel_tol=1e-4)
    empty = df.where("false")
    assert masked_lm.score(empty, *masked_lm.train(empty)).count() == 0


def test_masks_reach_every_place(spark):
    """Short texts and the last words of texts are trained, and so is the edge after them."""
    df = spark.createDataFrame([(i, f"a{i % 7} b c d last") for i in range(600)], "doc_id bigint, text string").repartition(2)
    known, weights = masked_lm.train(df)
    start, net = masked_lm.Network.start(), masked_lm.Network.start().load(weights)
    assert all((net.place[k][masked_lm.EDGE] != start.place[k][masked_lm.EDGE]).all() for k in range(4))
    ids = masked_lm.encode("a1 b c d last", {w.encode(): i for w, i in known.items()})
    at = np.arange(5)
    assert (net.log_probs(net.contexts(ids, at), ids) > start.log_probs(start.contexts(ids, at), ids)).all()
    hidden = masked_lm.masks("some text", np.arange(4000), 0, 8)
    assert set(Counter(hidden.tolist())) == set(range(8)) and min(Counter(hidden.tolist()).values()) > 400
    assert (hidden != masked_lm.masks("some text", np.arange(4000), 1, 8)).any()


def test_words_of_a_bucket_have_their_own_share(spark):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(300)] + ["É", "ŸÉ", "x" * 40]
    rows = [(i % 50, " ".join(rng.choices(words, range(1, len(words) + 1), k=rng.randint(0, 60))).upper()) for i in range(200)] + [(None, None), (None, "W7 w9")]
    corpus = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    lower = lambda text: [w.decode() for w in (text or "").encode().lower().split()]
    seen = Counter(w for _, text in rows for w in lower(text))
    known = {w: i for i, (w, _) in enumerate(seen.most_common(40))}
    place = {w.encode(): i for w, i in known.items()}
    bucket = lambda w: masked_lm.encode(w, place)[0]
    size = Counter()
    for w, n in seen.items():
        size[bucket(w)] += n + 1
    net = masked_lm.Network.start()

    def expected(text):
        ids = masked_lm.encode(text or "", place)
        own = sum(math.log((seen[w] + 1) / (size[i] + 1)) for w, i in zip(lower(text), ids) if i >= masked_lm.WORDS)
        return own + (float(net.log_probs(net.contexts(ids, np.arange(len(ids))), ids).sum()) if len(ids) else 0.0)

    want = sorted((i or -1, round(expected(text), 2)) for i, text in rows)
    got = masked_lm.score(corpus, known, net.flat()).collect()
    assert np.allclose(sorted((r.doc_id or -1, round(r.log_prob, 2)) for r in got), want, atol=0.02)
    # other documents, with words never counted
    others = spark.createDataFrame([(1, "w1 unseen"), (2, "neverseen w299 w7")], "doc_id bigint, text string")
    got = {r.doc_id: r.log_prob for r in masked_lm.score(others, known, net.flat(), masked_lm.word_counts(corpus)).collect()}
    assert math.isclose(got[1], expected("w1 unseen"), rel_tol=1e-4) and math.isclose(got[2], expected("neverseen w299 w7"), rel_tol=1e-4)


def test_frequent_words_need_no_join(spark, monkeypatch):
    """Only words that are no large part of the corpus go through the join with all counts; the scores are the same."""
    rng = random.Random(13)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(rng.choices(words, [1 / (k + 1) for k in range(400)], k=80))) for i in range(60)] + [(None, None), (7, "w399 other")]
    corpus = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    counts, start = masked_lm.word_counts(corpus), masked_lm.Network.start().flat()
    known = {f"w{i}": i for i in range(10)}
    joined = []
    plain = masked_lm.stored

    def seen(df, name):
        out = plain(df, name)
        if name == "scored":
            joined.append(out.selectExpr("sum(size(rare))").first()[0])
        return out

    monkeypatch.setattr(masked_lm, "stored", seen)
    got = []
    for heads in (1 << 19, 200, 1):
        monkeypatch.setattr(masked_lm, "HEADS", heads)
        got.append(sorted((r.doc_id or -1, r.n_tokens, r.log_prob) for r in masked_lm.score(corpus, known, start, counts).collect()))
    others = sum(w not in known for _, text in rows for w in (text or "").split())
    assert joined[0] == 0 < joined[1] < others and joined[2] == others
    assert all(np.allclose(g, got[0], rtol=1e-9) for g in got[1:])


def test_steps_use_their_arrays_again():
    """A step and a block of scores allocate less than one fresh array of a batch's hidden values for each of their stages."""
    import tracemalloc

    rng = np.random.default_rng(8)
    net = masked_lm.Network.start()
    context, target = rng.integers(0, masked_lm.SIZE, (4, 2048)), rng.integers(0, masked_lm.SIZE, 2048)
    net.step(context, target, 0.1)
    tracemalloc.start()
    net.step(context, target, 0.1)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 600_000


def test_texts_side_by_side():
    """The words around every place of several texts are those of each text alone, and so are the masks."""
    rng = np.random.default_rng(9)
    sizes = np.array([0, 3, 1, 0, 40, 2, 0])
    ids, net = rng.integers(0, masked_lm.EDGE, sizes.sum()), masked_lm.Network.start()
    padded, at = masked_lm.edged(ids, sizes)
    ends = np.cumsum(sizes)
    alone = [net.contexts(ids[hi - n:hi], np.arange(n)) for n, hi in zip(sizes, ends)]
    assert (masked_lm.around(padded, at) == np.concatenate(alone, axis=1)).all()
    texts = [f"text {k} \u00e9" for k in range(len(sizes))]
    seeds = np.array([masked_lm.seed_of(t.encode(), 1) for t in texts], np.uint64)
    places = np.arange(len(ids)) - np.repeat(ends - sizes, sizes)
    want = np.concatenate([masked_lm.masks(t, np.arange(n), 1, 8) for t, n in zip(texts, sizes)])
    assert (masked_lm.dealt(places, np.repeat(seeds, sizes), 8) == want).all()


def test_gradient():
    """A step moves the loss as its gradient says."""
    rng = np.random.default_rng(1)
    net = masked_lm.Network.start()
    context, target = rng.integers(0, masked_lm.SIZE, (4, 50)), rng.integers(0, masked_lm.SIZE, 50)
    before = net.log_probs(context, target).mean()
    net.step(context, target, 0.05)
    assert net.log_probs(context, target).mean() > before


def test_gradient_in_numbers():
    """The largest slopes of every part equal differences of the loss, and the probabilities of all words add up to 1."""
    rng = np.random.default_rng(5)
    net = masked_lm.Network.start()
    context, target = rng.integers(0, masked_lm.SIZE, (4, 60)), np.minimum(rng.zipf(1.4, 60), masked_lm.SIZE) - 1
    context[:, ::3] = 11  # an embedding that stands in many rows and at all places
    for _ in range(3):
        net.step(context, target, 1.0)
    every = masked_lm.Network.start().load(net.flat())
    assert np.isclose(np.exp(every.log_probs(np.repeat(context[:, :1], masked_lm.SIZE, axis=1), np.arange(masked_lm.SIZE))).sum(), 1, atol=1e-4)
    moved = masked_lm.Network.start().load(net.flat())
    moved.step(context, target, 1.0)
    for part, (a, b) in enumerate(zip(net.parts(), moved.parts())):
        slope = (a - b).ravel()
        for k in np.argsort(-np.abs(slope))[:4]:
            loss = []
            for by in (0.02, -0.02):
                other = masked_lm.Network.start().load(net.flat())
                other.parts()[part].ravel()[k] += by
                loss.append(-other.log_probs(context, target).mean(dtype=float))
            assert math.isclose((loss[0] - loss[1]) / 0.04, slope[k], rel_tol=0.03, abs_tol=1e-4), (part, k)


def test_word_counts_in_parts(spark, monkeypatch):
    """Words are counted in the tasks, and a task sends what it holds when there are too many distinct words."""
    monkeypatch.setattr(masked_lm, "HELD", 5)
    rng = random.Random(2)
    texts = [" ".join(rng.choices(["a", "A", "b\u00c9", "b\u00e9", "c.", "d\u00a0e", "f\u0085g", *map(str, range(20))], k=30)) for _ in range(50)]
    texts += ["x\ty\x0bz\n\x0cx\r x\x1fy", "", "  ", None]
    frame = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    want = Counter(w.decode() for t in texts for w in masked_lm.split(t or ""))
    assert {r.w: r.n for r in masked_lm.word_counts(frame).collect()} == want and want["x"] == 2
    assert masked_lm.word_counts(frame.limit(0)).isEmpty()


def test_texts_are_numbered_together():
    """A word of many places is met once, and every text has the numbers that it has alone."""
    import pyarrow as pa

    rng = random.Random(4)
    texts = ["", " \n", "A\x0bb\x0c\tC ", " \u00c9 b\x1fc a", *(" ".join(rng.choices(["a", "B", "x\u00a0y", "\u0130", "z."], k=12)) + " " * (k % 2) for k in range(50))]
    known = {b"a": 0, b"b": 1}
    for some in (texts, texts[2:9], [""], []):
        ids, ends, distinct, which = masked_lm.encode_all(pa.array(["skipped", *some], pa.string())[1:], known)
        assert [ids[lo:hi].tolist() for lo, hi in ends] == [masked_lm.encode(t, known).tolist() for t in some]
        assert [distinct[k] for k in which] == [w for t in some for w in masked_lm.split(t)] and len({*distinct}) == len(distinct)
