"""Personal data against plain regular expressions and counts in Python."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from helixframe.llm import personal_data, queries

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def valid(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in hit.split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def class_of(w):
    return "number" if re.search("[0-9]", w) else "name" if w[0].isupper() else "word"


def plain(rows, window=8, disclosure=0.95, contexts=3):
    """For each row (base spans, all spans, new text)."""
    base, near, shown, held = [], defaultdict(set), defaultdict(set), defaultdict(set)
    for n, (_, text) in enumerate(rows):
        text, spans = text or "", []
        words = [(m.start(), m.end()) for m in re.finditer(WORD, text)]
        for k, kind in enumerate(personal_data.KINDS):
            hits = [(m.start(), m.end()) for m in re.finditer(PLAIN[kind], text)]
            for i, (s, e) in enumerate(hits):
                if not valid(kind, text[s:e]):
                    continue
                spans.append((s, k, e, kind))
                begin, end = hits[i - 1][1] if i else -1, hits[i + 1][0] if i + 1 < len(hits) else len(text) + 1
                around = [w for w in words if w[0] > begin and w[1] < s][-window:] + [w for w in words if w[0] > e and w[1] < end][:window]
                c = (kind, low(text[s:e]) if kind == "email" else text[s:e] if kind == "ip" else re.sub("[^0-9]", "", text[s:e]))
                held[c].add(n)
                around = tuple(text[a:b] for a, b in around)
                for t in {low(w) for w in around} | {("class", class_of(w)) for w in around}:
                    near[c, t].add(n)
                    shown[c, t].add(around)
        base.append(sorted(spans))
    n_t = Counter()
    for _, text in rows:
        words = re.findall(WORD, text or "")
        n_t.update({low(w) for w in words} | {("class", class_of(w)) for w in words})
    reveal = {t for (c, t), at in near.items() if len(shown[c, t]) >= contexts and len(at) >= n_t[t] * (len(held[c]) / len(rows)) ** (1 - disclosure)}
    out = []
    for (_, text), spans in zip(rows, base):
        both = list(spans)
        for m in re.finditer(WORD, text or ""):
            if low(m.group()) in reveal and not any(m.start() < e and m.end() > s for s, _, e, _ in spans):
                both.append((m.start(), 4, m.end(), "term"))
        both.sort()
        new, at = "", 0
        for s, _, e, kind in both:
            if s >= at:
                label = class_of(text[s:e]) if kind == "term" else kind
                new += text[at:s] + ("" if kind == "term" and ("class", label) in reveal else f"[{label}]")
            at = max(at, e)
        out.append((spans, both, None if text is None else new + text[at:]))
    return out


def corpus():
    r = random.Random(12)
    words = ["on", "the", "of", "Ann", "ward", "7b", "Zürich", "é", "日本", "it", "x_y", "so"]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    out = [None, "", " ", "a@b.c", "a@b", "@b.c", "a@b.c.", "a@b.c_d@e.f", "a..@b-.c-d.e@f.g", "x@y.z@w.v", "é@b.c aé@b.cé", "A.B%+c@D.E,a@b.c;", "1.2.3.4", "1.2.3.4.5.6.7.8", "1.2.3.4.5", "256.1.1.1 255.255.255.0000255", "01.2.3.4é 1.2.3", "0.0.0.0.", "300.1.1.1.1.1.1.1", "9" * 40 + ".1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111 4111 1111 1111 1112", "4111  1111 1111 1111", "0" * 12, "0" * 20, "1 2 3", "+1 (743) 555-3824", "+41 44 1234567", "+1+2 345 678 90 12", "+1 (", "+12345678 9)", "+123.123.123.123", "+4111 1111 1111 1111", "tel:+1 743 555 3824.", "++1 743 555 3824 1"]
    out += ["call Ann at +1 743 555 3824 or ann@example.com now"] * 3  # copies are no evidence
    for n in range(60):
        w = text(r.randint(0, 12)).split()
        for _ in range(r.randint(0, 3)):
            w.insert(r.randint(0, len(w)), r.choice(["kim@mail.example.com", "KIM@mail.example.com", "10.0.0.1", "4111111111111111", "+1 743 555 3824", "4111111111111112"]))
        out.append(r.choice([" ", ", ", "\n", ""]).join(w))
    for n in range(12):  # a nickname and a badge that stand with one address only
        out.append(f"{text(3)} Quill badge q{7}x: quill@example.org {text(4)}")
    out += ["here is quill again", "QUILL, q7x?", text(5) + " 4111111111111111" * 40 + " Quill " + text(2000)]
    return [(i // 2, t) for i, t in enumerate(out)] + [(None, out[40]), (None, out[-1])]


@pytest.mark.parametrize("options", [{}, {"disclosure": 0.6, "contexts": 2, "window": 3}, {"disclosure": 0.0, "contexts": 1, "window": 2}])
def test_spans_by_definition(spark, options):
    rows = corpus()
    df = spark.createDataFrame([(*r, 1, 2, "x", n) for n, r in enumerate(rows)], "doc_id long, text string, n_ip int, a int, base string, row int")
    expected = plain(rows, **options)
    got = personal_data.sanitised(df.repartition(3), **options).select("row", "text", "base").collect()
    assert {r.row: r.text for r in got} == {n: x[2] for n, x in enumerate(expected)} and all(r.base == "x" for r in got)
    spans = lambda x: tuple((s, e, k) for s, _, e, k in x)
    got = personal_data.personal_data(df.drop("n_ip", "a", "row"), **options).collect()
    key = lambda r: str(r)
    assert sorted([(r.id, r.n_email, r.n_ip, r.n_card, r.n_phone, tuple(map(tuple, r.base)), tuple(map(tuple, r.spans))) for r in got], key=key) == sorted([(rows[n][0], *(sum(s[3] == k for s in x[0]) for k in personal_data.KINDS), spans(x[0]), spans(x[1])) for n, x in enumerate(expected)], key=key)
    assert any(len(x[1]) > len(x[0]) for x in expected)
    if not options:
        texts = [x[2] for x in expected]
        assert "QUILL, [number]?" in texts and "here is quill again" in texts and sum("[word] [number]: [email]" in (t or "") for t in texts) == 12


def test_no_rows_no_data_and_a_shuffle_beyond_the_bound(spark, empty, monkeypatch):
    assert personal_data.personal_data(empty).count() == 0 and personal_data.sanitised(empty).count() == 0
    clean = spark.createDataFrame([(1, "nothing here"), (2, None)], "doc_id long, text string")
    assert [tuple(r) for r in personal_data.personal_data(clean).orderBy("id").collect()] == [(1, 0, 0, 0, 0, [], []), (2, 0, 0, 0, 0, [], [])]
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    usual = sorted(map(str, personal_data.personal_data(df).collect()))
    monkeypatch.setattr(personal_data, "BROADCAST_TERMS", -1)
    assert sorted(map(str, personal_data.personal_data(df).collect())) == usual


def test_long_texts(spark):
    w = ["kim@mail.example.com", "and", "10.0.0.1"] * 20_000
    rows = [(1, " ".join(w)), (2, "a" * 300_000 + " " + "1" * 300_000 + "@"), (3, "1 " * 200_000 + "+" * 1000 + "1 " * 1000), (4, "9." * 200_000)]
    got = {r.id: r for r in personal_data.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].n_email == got[1].n_ip == 20_000 and tuple(got[1].spans[-1]) == (len(rows[0][1]) - 8, len(rows[0][1]), "ip")
    assert [got[i].n_email + got[i].n_card + got[i].n_phone for i in (2, 3, 4)] == [0, 0, 0] and got[4].n_ip == 50_000


def test_query_by_definition(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: r for r in queries.op13_personal_data(spark, sf).collect()}
    name = lambda spans: ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)
    for (i, _), (base, spans, _) in zip(rows, plain(rows)):
        assert (got[i].spans, got[i].base_sha256) == (name(spans), hashlib.sha256(name(base).encode()).hexdigest())
    assert any(r.n_card for r in got.values())
