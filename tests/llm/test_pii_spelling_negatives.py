"""Personal data, spelling variants and hard negatives against brute force, and their SQL on the same small tables."""

import itertools
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd

from kerbflow.llm import hard_negatives, pii, spelling
from kerbflow.llm.oracle import ORACLE

DOCS = "doc_id bigint, text string, spans string, word string, n string"


def by_sql(name, **tables):
    con = duckdb.connect()
    for table, frame in tables.items():
        con.register(f"_{table}", frame)
        con.execute(f"CREATE TABLE {table} AS SELECT * FROM _{table}")
    cursor = con.execute(ORACLE[name])
    return [c[0] for c in cursor.description], cursor.fetchall()


def same_rows(df, columns, rows):
    assert sorted(df.columns) == sorted(columns)
    assert Counter(map(tuple, df.select(*columns).collect())) == Counter(rows)


# --- personal data ---------------------------------------------------------------------------------------------

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    """The base kinds by the patterns as they are written."""
    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0

    keep = {"email": lambda m: True, "ip": lambda m: all(int(p) < 256 for p in m.split(".")),
            "card": lambda m: 14 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d),
            "phone": lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15}
    found = [(m.start(), rank, m.end()) for rank, k in enumerate(PLAIN) for m in re.finditer(PLAIN[k], text) if keep[k](m.group())]
    return [(pii.BASE[rank], start, end) for start, rank, end in sorted(found)]


def insee(first):
    return f"{first}{97 - int(first) % 97:02d}"


PRIVATE = [
    ("iban", "Transfer to GB82 WEST 1234 5698 7654 32 NOW", "GB82 WEST 1234 5698 7654 32"),
    ("iban", "konto DE89370400440532013000.", "DE89370400440532013000"),
    ("ssn", "her social security number 123-45-6789,", "123-45-6789"),
    ("routing", "wire it to routing number 021000021", "021000021"),
    ("insee", f"NIR {insee('2550814168025')} (ü)", insee("2550814168025")),
]
CLEAN = [
    "GB82 WEST 1234 5698 7654 33", "DE8937040044053201300", "XDE89370400440532013000", "part 123-45-6789", "000-12-3456 social",
    "social 666-12-3456 and 123-00-4567 and 123-45-0000 and 912-34-5678", "routing 021000022", "021000021", "999.1.1.256", "1.2.3",
    "4111111111111112", "+1 23 45", "a@b", "@b.c", insee("2550814168025"), "secu 255081416802500", "a@b@c", "1234-123-45-6789 ssn"]


def test_spans_of_base_kinds():
    rng = random.Random(3)
    assert [k for k, *_ in plain_spans("x.y@a-b.c.d 4111 1111-1111 1111, 10.0.0.1 +1 (555) 010-0199")] == ["email", "card", "ip", "phone"]
    for alphabet, size in ((["a@b.c", "@", ".", "-", "_", "b", "%", "1", " "], 12), (["1", "25", "4111111111111111", ".", " ", "-", "+1", "(", ")", "00"], 14),
                           (["10.0.0.1", ".", "256", "0000001", "é", "7"], 9)):
        for _ in range(3000):
            text = "".join(rng.choices(alphabet, k=size))
            assert [s[:3] for s in pii.spans(text) if s[0] in pii.BASE] == plain_spans(text), text


def test_added_kinds_and_scores():
    for kind, text, span in PRIVATE:
        start = text.index(span)
        assert [(k, a, b) for k, a, b, _ in pii.spans(text) if k == kind] == [(kind, start, start + len(span))], text
    for text in CLEAN:
        assert [s[:3] for s in pii.spans(text)] == plain_spans(text), text
    points = {text: pii.spans(text)[0][3] for text in ("call +1 555 010 0199", "+1 555 010 0199", "order +1 555 010 0199")}
    assert list(points.values()) == [80, 50, 20]
    assert "insee" in [s[0] for s in pii.spans(f"x {insee('2550814168025')}", least=50)]
    text = "mail a@b.org, 1.2.3.4 and again 1.2.3.4"
    assert pii.redact(text, pii.spans(text)) == "mail <email>, <ip> and again <ip>"


def test_long_runs_are_read_once():
    long = 400_000
    assert pii.spans("a" * long + "@" + "b" * long) == []
    assert pii.spans("1" * long + "." + "2" * long + ".3.4") == [] and pii.spans("1." * long) == [
        ("ip", k, k + 7, 50) for k in range(0, 2 * long - 7, 8)]
    assert pii.spans("+1" + " " * long) == pii.spans("@" * long) == pii.spans("A" * long) == []
    assert [s[:3] for s in pii.spans("w " * long + "a@b.org")] == [("email", 2 * long, 2 * long + 7)]


def test_pii_rows(spark):
    rng = random.Random(8)
    texts = [t for _, t, _ in PRIVATE] + CLEAN + ["", None, "é\n@", "x" * 200_000 + " a@b.org", "same 1.2.3.4", "same 1.2.3.4"]
    texts += [" ".join(rng.choices(["ünder", "call", "+49 30 1234567", "4111 1111 1111 1111", "test", "a.b@c-d.org", "10.20.30.40", "bank",
                                    "021000021", "GB82WEST12345698765432", "ssn", "123-45-6789", ".", "Sécu"], k=12)) for _ in range(40)]
    rows = [(None if k % 11 == 5 else k // 2, t, "x", "y", "z") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    got = pii.digest(pii.find(docs))
    same_rows(got, *by_sql("op11_pii_spans", documents=pd.DataFrame(rows, columns=["doc_id", "text", "spans", "word", "n"]).astype({"doc_id": "Int64"})))
    assert got.where("n_added > 0").count() > 5 and got.where("n_email + n_ip + n_card + n_phone > 0").count() > 30
    assert pii.find(docs, redacted=True).where("redacted LIKE '%<%'").count() == got.where("top_score IS NOT NULL").count()
    assert pii.digest(pii.find(spark.createDataFrame([], DOCS))).collect() == []


# --- spelling variants -----------------------------------------------------------------------------------------

def one_edit(x, y):
    if len(x) > len(y):
        x, y = y, x
    if len(x) == len(y):
        return sum(p != q for p, q in zip(x, y)) == 1
    return len(y) - len(x) == 1 and any(y[:k] + y[k + 1:] == x for k in range(len(y)))


def expected_variants(counts, ratio=5):
    out, form = {}, {}
    for w, n in counts.items():
        near = [(-counts[v], v) for v in counts if one_edit(w, v)]
        best = min(near, default=None)
        if best and -best[0] >= ratio * n:
            form[w] = best[1]
        out[w] = (n, len(near), form.get(w), -best[0] if w in form else None)
    for w, row in out.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (w, *row, root)
    return set(out.values())


def words_of(rows, damage=199, shortest=6, least=5):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            counts[w[:h % len(w)] + w[h % len(w) + 1:] if h % damage == 0 else w] += 1
    return {w: n for w, n in counts.items() if len(w) >= shortest and n >= least}


def test_sorted_list_pairs():
    rng = random.Random(1)
    for letters, size in (("ab", 6), ("abé", 4), ("abcdefg", 3)):
        for _ in range(60):
            words = sorted({"".join(rng.choices(letters, k=rng.randint(0, size))) for _ in range(40)})
            got = list(spelling.sorted_list_pairs(words))
            assert len(got) == len(set(got))
            assert set(got) == {(i, j) for i, j in itertools.combinations(range(len(words)), 2) if one_edit(words[i], words[j])}


def test_variants_of_hot_ranges(spark):
    """Few letters make large ranges; with ``most`` 3 they are cut down to single places."""
    rng = random.Random(2)
    counts = {"".join(rng.choices("abß", k=rng.randint(6, 9))): rng.choice([5, 6, 25, 26, 130, 700]) for _ in range(500)}
    counts |= {"prefix" + "x" * 300 + tail: n for tail, n in (("a", 5), ("b", 25), ("ab", 125), ("abc", 625), ("", 5))}
    frame = spark.createDataFrame(list(counts.items()), "word string, n bigint").repartition(3)
    expected = expected_variants(counts)
    for most in (3, 2000):
        got = [tuple(r) for r in spelling.variants(frame, most=most).collect()]
        assert len(got) == len(counts) and {(w, n, k, f, m, r) for w, n, k, f, m, r in got} == expected
    largest = spelling.ranges(frame, most=3).groupBy(*spelling.RANGE).count()
    assert largest.where("count > 3 AND b - a > 1").isEmpty() and not largest.where("b - a = 1").isEmpty()
    assert len({r for *_, f, _, r in expected if f}) < len([1 for *_, f, _, r in expected if f])  # chains meet
    groups = {r.root: r for r in spelling.grouped(spelling.variants(frame)).collect()}
    assert sum(len(g.variants) for g in groups.values()) == sum(1 for e in expected if e[3] or any(o[5] == e[0] and o[0] != e[0] for o in expected))


def test_spelling_of_corpus(spark, docs, texts):
    rng = random.Random(4)
    words = ["Frühling", "frühlings", "Fruhling", "ÀÉÿ×÷aa", "letters", "lettters", "lettres", "sixsix", "short", "ÄÖÜ"]
    rows = [(k % 300 if k % 7 else None, " ".join(rng.choices(words, [90, 9, 9, 20, 70, 9, 9, 40, 40, 9], k=40)) + "9x_" * (k % 3)) for k in range(900)]
    rows += [(1, None), (2, ""), (3, "q" * 50_000), *[(4 + k, "same longer text") for k in range(6)], (5, "same longer text")]
    expected = words_of(rows)
    frame = spark.createDataFrame([(i, t, "a", "b", "c") for i, t in rows], DOCS).repartition(5)
    got = spelling.of_corpus(frame, damage=199)
    assert {(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in got.collect()} == expected_variants(expected)
    assert got.where("form IS NOT NULL").count() > 2 and set(expected) - {w.lower() for w in words}  # damaged words count
    same_rows(got, *by_sql("op12_spelling_variants", documents=pd.DataFrame(rows, columns=["doc_id", "text"]).astype({"doc_id": "Int64"})))
    same_rows(spelling.of_corpus(docs, damage=199), *by_sql("op12_spelling_variants", documents=pd.DataFrame(texts, columns=["doc_id", "text"]).astype({"doc_id": "Int64"})))
    assert spelling.of_corpus(spark.createDataFrame([], DOCS)).collect() == []
    assert spelling.of_corpus(spark.createDataFrame([(1, "a b 12", "", "", "")], DOCS)).collect() == []


# --- hard negatives --------------------------------------------------------------------------------------------

VECTORS = "vec_id bigint, embedding array<float>, label int, key string, v string, block string"


def expected_negatives(rows, k=5):
    """rows: (vec_id, components, label) in any order; rows with one id must not tie with each other."""
    usable = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v], (y + 1) % 10 if i % 7 == 0 else y) for i, v, y in rows
              if i is not None and y is not None and v is not None and all(x is not None and np.isfinite(x) and abs(x) < 4096 for x in v)]
    out = []
    for at, (a, u, y) in enumerate(usable):
        if a % 100 == 0:
            scored = [(-sum(p * q for p, q in zip(u, v)), i, label == y) for row, (i, v, label) in enumerate(usable) if row != at]
            for s, p, _ in sorted(x for x in scored if x[2])[:k]:
                inside = sorted(x for x in scored if not x[2] and 80 * -s <= 100 * -x[0] <= 100 * -s)[:k]
                out += [(a, p, n, i, -s, -t) for n, (t, i, _) in enumerate(inside, 1)]
    return out


def mined(spark, rows):
    frame = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], VECTORS).repartition(3)
    label = hard_negatives.F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    table = hard_negatives.prepared(frame, label=label)
    return hard_negatives.mine(table, table.where("id % 100 = 0"))


def vectors(rng, n, width=8):
    centres = rng.normal(size=(4, width))
    out = []
    for i in range(n):
        y = int(rng.integers(4))
        v = centres[rng.integers(4)] + rng.normal(scale=0.4, size=width)
        out.append((i * 10, [float(x) for x in np.float32(v / np.linalg.norm(v))], y))
    return out


def test_hard_negatives(spark):
    rng = np.random.default_rng(5)
    rows = vectors(rng, 700)
    rows += [(20_000 + i, rows[0][1], i % 3) for i in range(300)]  # a third of the rows are one vector
    rows += [(30_000, None, 1), (30_100, rows[1][1], None), (None, rows[1][1], 1), (30_200, [1.0, None, 0.0], 1), (30_300, [float("nan")] * 8, 1),
             (30_400, [float("inf")] + [0.0] * 7, 1), (30_500, [], 1), (30_600, [0.5, 0.25], 1), (30_700, [0.5] * 11, 2), (30_800, [5000.0] * 8, 2),
             (30_900, [0.0] * 8, 1), (31_000, [-x for x in rows[2][1]], 1)]
    rows += [(rows[5][0], [0.9 * x for x in rows[5][1]], rows[5][2]), (rows[0][0], rows[0][1], rows[0][2])]  # ids that repeat
    got = [(r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in mined(spark, rows).collect()]
    expected = expected_negatives(rows)
    assert Counter(got) == Counter(expected) and len(expected) > 1000
    simple = vectors(rng, 300)
    frame = pd.DataFrame(simple, columns=["vec_id", "embedding", "label"])
    same_rows(mined(spark, simple), *by_sql("op13_hard_negatives", embeddings=frame))
    assert mined(spark, []).collect() == [] and mined(spark, [(100, [1.0], 1)]).collect() == []


def test_threshold_stops_early():
    """Where scores differ clearly, the search ends before all rows are met, and the best rows are the brute-force ones."""
    rng = np.random.default_rng(6)
    matrix = np.floor(256 * rng.laplace(size=(5000, 4))).astype(np.int64)
    lists = hard_negatives.SortedLists(matrix, np.arange(5000))
    scored = []

    class Counted(hard_negatives.Windows):
        def offer(self, scores, rows, ids):
            scored.append(len(rows))
            super().offer(scores, rows, ids)

    for anchor in (np.array([900, -5, 3, 0]), np.array([0, 0, 0, -700]), np.array([300, 300, -300, 2])):
        scored.clear()
        best = Counted([(-np.inf, np.inf)], 5)
        lists.search(anchor, best)
        scores = matrix @ anchor
        order = np.lexsort((np.arange(5000), -scores))[:5]
        assert best.kept[0][1].tolist() == order.tolist() and sum(scored) < 2500
    everything = Counted([(-np.inf, np.inf)], 5)
    lists.search(np.zeros(4, np.int64), everything)  # without a direction all rows tie
    assert everything.kept[0][1].tolist() == [0, 1, 2, 3, 4]
