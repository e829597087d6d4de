"""Periodic runs against every place and period by definition."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest
from helixframe.llm import queries, runs


def all_runs(w, repeats=4, least=6):
    """By definition, in n^2 steps: every maximal stretch of every period that has no smaller one."""
    out = []
    for p in range(1, len(w) // repeats + 1):
        i = 0
        while i + p < len(w):
            if w[i] != w[i + p]:
                i += 1
                continue
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            s, length = i, j - i + p
            x = w[s : s + length]
            if length >= max(least, repeats * p) and not any(all(x[k] == x[k + q] for k in range(length - q)) for q in range(1, p)):
                out.append((s, length, p))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def columns(doc_id, text, plant):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if plant and doc_id is not None and w:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            a = h // 10 % len(w)
            p = 1 + (len(w) - a) // (3 + h // 10 % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    found = all_runs(w)
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    return (len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{n},{p}\n" for s, n, p in found)), sha(kept)), found, kept


def texts():
    r = random.Random(3)
    out = [None, "", " \n", "a", "a a a a a", "a a a a a a", "a b " * 3, "a b " * 4, "x " + "a b c " * 4 + "a", "ab\x00 " * 30, "é\xa0é " * 9, "\x1fa\x1f " * 8]
    out += [("a " * 10 + "b ") * 6, ("a " * 7 + "b c ") * 5 + "a " * 30, "a " * 40 + "b " + "a " * 40, ("a b a b a c " * 5 + "d ") * 5, ("a b " * 5 + "c ") * 5 + "a b " * 9]
    for n in range(120):  # few words, so that there are many periods
        w = [r.choice("ab" if n % 2 else "abc") for _ in range(r.randint(1, 60))]
        for _ in range(r.randint(0, 3)):
            at, p, k = r.randrange(len(w)), r.randint(1, 7), r.randint(3, 7)
            w[at:at] = [r.choice("abc") for _ in range(p)] * k
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("plant", [False, True])
def test_runs_by_definition(spark, plant):
    rows = [(i if i % 11 else None, t, 1, 2) for i, t in enumerate(texts())] + [(5, "a a a a a a", 1, 2), (5, "b", 1, 2), (5, "b", 1, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_runs int, id int").repartition(3)
    got = runs.periodic_runs(df, plant=plant).collect()
    expected = []
    for i, t, *_ in rows:
        figures, found, kept = columns(i, t, plant)
        expected.append((i, *figures, tuple(found), kept))
    key = lambda x: tuple((v is None, v) for v in x[:9])
    assert sorted([(*r[:8], tuple(tuple(x) for x in r.runs), r.collapsed) for r in got], key=key) == sorted(expected, key=key)
    assert any(r.n_runs > 2 for r in got) and any(r.n_runs == 0 for r in got)


def test_other_repeats_and_empty_table(spark, empty):
    w = "a b c a b c a b x y x y x y x".split()
    got = runs.periodic_runs(spark.createDataFrame([(1, " ".join(w))], "doc_id long, text string"), repeats=2, least=4).first()
    assert [tuple(x) for x in got.runs] == all_runs(w, 2, 4)
    assert runs.periodic_runs(empty).count() == 0


def test_a_very_long_text(spark):
    r = random.Random(8)
    w = ["w%d" % r.randrange(5000) for _ in range(200_000)]
    w[70_000:70_000] = w[100:12_100] * 5  # a long period
    w[10:10] = ["one"] * 60_000
    got = runs.periodic_runs(spark.createDataFrame([(1, " ".join(w)), (2, "one " * 300_000), (3, ("one " * 999 + "two ") * 50)], "doc_id long, text string")).collect()
    got = {x.id: [tuple(v) for v in x.runs] for x in got}
    assert (10, 60_000, 1) in got[1] and any(p == 12_000 and n >= 60_000 for _, n, p in got[1]) and len(got[1]) == 2
    assert got[2] == [(0, 300_000, 1)] and (0, 50_000, 1000) in got[3] and len(got[3]) == 51


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries.op12_periodic_runs(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    short = [d for d in docs if len((d.text or "").split()) <= 400]
    assert len(got) == len(docs) and len(short) > 100
    for d in short:
        assert tuple(got[d.doc_id])[1:] == columns(d.doc_id, d.text, True)[0], d.doc_id
