"""Licences, tokens, mixing, fingerprints, piece sampling, toxicity and the pipeline."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helixframe.llm import fingerprints, license_scan, mixing, piece_sampling, token_counts, toxicity
from helixframe.llm.common import tokenizer
from helixframe.llm.textblocks import blocks, mix
from pyspark.sql import functions as F

# --- licences


def base_phrases(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    at, labels = [], set()
    for phrase, label in license_scan.BASE_PHRASES.items():
        p = phrase.split()
        found = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        at += found
        labels |= {label} if found else set()
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


LICENCES = [
    "Released under the MIT License. And under the mit license!", "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0.", "cc-by-nc-sa 4.0 text", "CC  by\nnc",
    "This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: BSD-3-Clause", "the license of a driver", "under the mit licence", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "underthe mit license under theé mit license", None, "", "word " * 5000 + "Licensed under the Mozilla Public License 2.0", "\x00\x01", "Dual licensed under the MIT license and the GPL v2",
]


def test_licences(spark):
    rows = [(i, t, "x") for i, t in enumerate(LICENCES + LICENCES[:2])]
    got = {r.id: r for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string, labels string")).collect()}
    for i, t, _ in rows:
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_phrases(t), t
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert r.labels == ",".join(sorted(set(filter(None, r.labels.split(","))))) and 0 <= r.score <= 1
    labels = [got[i].labels for i in range(len(LICENCES))]
    assert labels[5] == "gpl-3" and labels[6] == "bsd-3-clause" and labels[7] == "" and labels[9] == "mit"
    assert labels[3] == "cc-by-nc,cc-by-nc-sa" and labels[13] == "mpl-2" and labels[15] == "gpl-2,mit"
    assert got[5].detections[0].start == 0 or got[5].detections[0].end <= len(LICENCES[5])


def test_a_contained_detection_of_lower_priority_goes(spark):
    r = license_scan.license_scan(spark.createDataFrame([(1, "Licensed under the GNU General Public License, version 3.")], "doc_id long, text string")).first()
    assert [d.label for d in r.detections] == ["gpl-3"]
    assert len(license_scan.rules()) >= 200 and all(re.compile(x.regex) for x in license_scan.rules())


def test_the_gate_lets_every_notice_with_under_through(spark):
    texts = ["released\nunder the MIT terms", "Released  under MIT", "Released to everyone under the BSD 3-clause terms", "Distributed (freely) under ISC", "Available, under MIT", "PUBLISHED\r\n * under\tthe terms of the ISC"]
    texts += [f"x {v}{a}{b}under{a}the{a}MIT y" for v in license_scan._VERBS.split("|") for a in (" ", "\n", "\n# ", " -- ") for b in ("", f"to{a}all,{a}é{a}")]
    texts += ["released to each and every one under MIT", "thunder over MIT"]
    found = {r.id: r for r in license_scan.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    table = license_scan.rules()
    for i, t in enumerate(texts):
        joined = " ".join(re.findall(license_scan._WORD, t.lower()))
        expected = max((r.priority for r in table if re.search(r.regex, joined)), default=0)
        assert expected == (0 if i >= len(texts) - 2 else 80) and found[i].score == expected / 100 and bool(found[i].labels) == (expected > 0), t


def sampled(regex, r):
    """A string that a rule's regex matches."""
    from re import _constants as C, _parser

    def go(parts):
        out = ""
        for op, arg in parts:
            if op is C.LITERAL:
                out += chr(arg)
            elif op is C.NOT_LITERAL:
                out += r.choice("abc7é")
            elif op is C.IN:
                out += "x" if arg[0][0] is C.NEGATE else chr(r.randint(*arg[0][1])) if arg[0][0] is C.RANGE else chr(r.choice(arg)[1])
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
                low, high, body = arg
                out += "".join(go(body) for _ in range(r.randint(low, min(high, low + 3))))
            elif op is C.SUBPATTERN:
                out += go(arg[3])
            elif op is C.BRANCH:
                out += go(r.choice(arg[1]))
            else:
                assert op in (C.ASSERT, C.ASSERT_NOT, C.AT), op
        return out

    return go(_parser.parse(regex))


def plain_scan(text, table):
    """license_scan's rules without any gate or keyword: (labels, score, detections)."""
    s = " ".join(re.findall(license_scan._WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)))
    hits = [(x.label, x.priority, m.start(), m.end(), n) for n, x in enumerate(table) for m in re.finditer(x.regex, s) if m.end() > m.start()]
    within = lambda a, b: b[2] <= a[2] and b[3] >= a[3] and (b[1] > a[1] or b[1] == a[1] and (b[3] - b[2] > a[3] - a[2] or b[3] - b[2] == a[3] - a[2] and b[4] < a[4]))
    kept = [h for h in hits if not any(within(h, o) for o in hits)]
    base = base_phrases(text)[4]
    labels = {h[0] for h in kept} | set(filter(None, base.split(",")))
    return ",".join(sorted(labels)), 1.0 if base else max((h[1] for h in kept), default=0) / 100, sorted(h[:4] for h in kept)


def test_every_rule_is_found_as_without_gates(spark):
    """Texts made from each rule, with other words around, other separators and other cases, against plain regular expressions."""
    r, table, texts = random.Random(6), license_scan.rules(), []
    for n, rule in enumerate(table):
        for k in range(3):
            body = sampled(rule.regex, r).split()
            if k == 2:
                body = [*sampled(r.choice(table).regex, r).split(), *body]
            w = [*["see", "über", "it"][: r.randint(0, 3)], *body, *["and", "so"][: r.randint(0, 2)]]
            gap = [" ", "  ", "\n", "\n * ", ", ", "-", " \t(", "\r\n# "]
            text = "".join((x.upper() if r.random() < 0.2 else x.title() if r.random() < 0.2 else x) + (r.choice(gap) if k else " ") for x in w)
            texts.append((n * 3 + k, text, rule))
    got = {x.id: x for x in license_scan.license_scan(spark.createDataFrame([t[:2] for t in texts], "doc_id long, text string").repartition(4)).collect()}
    found = 0
    for i, text, rule in texts:
        expected = plain_scan(text, table)
        x = got[i]
        assert (x.labels, x.score, sorted((d.label, d.priority, d.start, d.end) for d in x.detections)) == expected, (text, rule)
        found += bool(expected[0])
    assert found >= 0.95 * len(texts)


def test_licences_of_nothing(spark, empty):
    assert license_scan.license_scan(empty).count() == 0
    rows = spark.createDataFrame([(None, "under the MIT License"), (None, None), (3, "MIT licence"), (3, "MIT licence")], "doc_id long, text string")
    got = license_scan.license_scan(rows).collect()
    assert sorted((r.id or 0, r.labels) for r in got) == [(0, ""), (0, "mit"), (3, "mit"), (3, "mit")]


# --- tokens

TEXTS = ["Hello  World", "don't stop<|endoftext|>now", "<|startoftext|> x <|ENDOFTEXT|>", "é é ﬁ Å", "a b c\x85d", "日本語 テキスト🙂", "", None, "123 4.5 x1y2", "I'm we'll '", "ǅ İ ß ΑΣ", "\t\n\x0b\x0c\r\x1c\x1d x", "z" * 5000, "ab " * 4000, "́a ́"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts(spark, name):
    path = tokenizer(name)
    encode = token_counts._encoder(path)
    rows = [(i, t, 0) for i, t in enumerate(TEXTS * 2)]
    got = sorted(map(tuple, token_counts.token_counts(spark.createDataFrame(rows, "doc_id long, text string, n long"), path).collect()))
    assert got == [(i, len((t or "").encode()), encode([t or ""])[0]) for i, t, _ in rows]


def test_long_words_stay_out_of_the_table(spark, empty):
    path = tokenizer("word_bpe_49k.json")
    encode = token_counts._encoder(path)
    rows = [(i, " ".join(["x" * 5000, "short"] * 3)) for i in range(6)] + [(None, "short"), (None, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    kept = token_counts.frequent_lengths(table.coalesce(1).select("text"), path)
    assert len(kept.keys) == 1
    got = token_counts.token_counts(table, path).collect()
    assert sorted((r.id is None, r.n_tokens) for r in got) == sorted((i is None, encode([t or ""])[0]) for i, t in rows)


def test_word_tokenizer_is_split_and_others_are_not(spark, empty):
    assert token_counts.splits_at_spaces(tokenizer("word_bpe_49k.json"))
    assert not token_counts.splits_at_spaces(tokenizer("byte_bpe_50k.json")) and not token_counts.splits_at_spaces(tokenizer("piece_bpe_32k.model"))
    assert token_counts.token_counts(empty, tokenizer("word_bpe_49k.json")).count() == 0


def test_token_cache_starts_anew(spark, monkeypatch, word):
    path = tokenizer("word_bpe_49k.json")
    rows = [(i, word(i, 60)) for i in range(30)]
    few = token_counts.token_counts(spark.createDataFrame(rows, "doc_id long, text string"), path, table_size=4)
    encode = token_counts._encoder(path)
    assert sorted((r.id, r.n_tokens) for r in few.collect()) == [(i, encode([t])[0]) for i, t in rows]


# --- mixing


def expected_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, cap = sum(sizes.values()), {}
    while True:
        left, weight = total - sum(cap.values()), sum(w[s] for s in sizes if s not in cap)
        above = [s for s in sizes if s not in cap and weight and left * w[s] / weight > 3 * sizes[s]]
        if not above:
            return {s: cap.get(s, left * w[s] / weight if weight else 0.0) for s in sizes}
        cap |= {s: 3 * sizes[s] for s in above}


def mixing_rows(word, n=400):
    r = random.Random(3)
    rows = [(i, word(i, r.randint(0, 60)), "big" if r.random() < 0.4 else r.choice(["a", "B", "é", None, "z", "tiny"]) if r.random() < 0.9 else "tiny") for i in range(n)]
    return rows + [(n, None, "only empty"), (n + 1, "", "a"), (0, rows[0][1], rows[0][2]), (0, rows[0][1], rows[0][2])]


def test_mixing(spark, word):
    rows = mixing_rows(word)
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("k", F.lit(1)).repartition(6)
    out = mixing.mixed(table, block_words=8)
    got = [r.asDict() for r in out.collect()]
    size = Counter()
    for _, t, s in rows:
        size[s] += len((t or "").split())
    target = expected_targets({s: size[s] for s in {r[2] for r in rows}})
    taken, seen = Counter(), set()
    for r in got:
        assert r["source_size"] == size[r["source"]] and math.isclose(r["target"], target[r["source"]], rel_tol=1e-9)
        assert r["taken"] is None or 0 < r["taken"] <= r["size"] and 0 <= r["cycle"] < 3
        taken[r["source"]] += r["taken"] or 0
        seen.add(r["id"])
    assert seen == {r[0] for r in rows}
    for s in size:
        assert taken[s] == math.floor(target[s] + 0.5) and taken[s] <= 3 * size[s], s
    again = [r.asDict() for r in mixing.mixed(table.repartition(3), block_words=8).collect()]
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mixing_nothing(spark, empty):
    assert mixing.mixed(empty).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert sorted((r.id, r.size, r.target, r.taken) for r in mixing.mixed(blank).collect()) == [(1, 0, 0.0, None), (2, 0, 0.0, None)]


def test_mixing_query_keeps_repeated_rows(spark, word, tmp_path):
    from helixframe.llm import queries

    rows = mixing_rows(word, 60) + [(None, "some words here", "a"), (None, "some words here", "a"), (7, None, None), (7, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op5_mixing(spark, str(tmp_path)).collect()
    key = lambda x: (-1 if x is None else x)
    assert sorted((key(r.doc_id), r.size) for r in got) == sorted((key(i), len((t or "").split())) for i, t, _ in rows)
    size = Counter()
    for _, t, s in rows:
        size[s] += len((t or "").split())
    target = expected_targets({s: size[s] for s in {r[2] for r in rows}})
    assert all(0 <= r.taken <= 3 * r.size for r in got) and sum(r.taken for r in got) == sum(math.floor(t + 0.5) for t in target.values())


@pytest.mark.parametrize("texts", [["one two three"], ["a b", "c", "d e f g h i j k"], ["x"]])
def test_mixing_of_a_few_words(spark, texts):
    rows = [(i, t, f"s{i}") for i, t in enumerate(texts)]
    got = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string"), by_cycle=False).collect()
    target = expected_targets({f"s{i}": len(t.split()) for i, t in enumerate(texts)})
    assert {r.source: r.taken for r in got} == {s: math.floor(t + 0.5) for s, t in target.items()}


def test_points_keep_their_spacing(spark):
    """Of any n points no two are nearer than 1 / (sqrt(5) n) or so, also far from the first."""
    for first in (0, 10**11, 2**47):
        u = sorted(r[0] for r in spark.range(first, first + 1000).select(mixing.point(F.col("id")).alias("u")).collect())
        gaps = [b - a for a, b in zip(u, u[1:])]
        assert min(gaps) > 0.3 / 1000 and max(gaps) < 3 / 1000
    n, phi = 123456789, mixing.GOLDEN
    assert abs(spark.range(1).select(mixing.point(F.lit(n).cast("long"))).first()[0] - float(n * phi % 1)) < 1e-11


# --- fingerprints


def test_equal_substrings_share_interior_phrases(word):
    a, b = word(1, 300), "shifted by this " + word(1, 300)
    for names, at in fingerprints.levels([a, b]):
        x, y = set(names[: at[1]].tolist()), set(names[at[1] :].tolist())
        assert len(x & y) >= 0.8 * len(x) - 4
        assert len(names[: at[1]]) > 0


def test_phrases_are_short_and_cover_runs():
    for text in ("a" * 1000, "ab" * 500, "".join(chr(97 + i * i % 26) for i in range(1000))):
        (names, at), *_ = fingerprints.levels([text])
        assert at.tolist()[-1] == len(names) and (text == "a" * 1000 or len(names) >= 1000 / 18)


def test_edit_likeness(spark, corpus, docs):
    got = sorted(fingerprints.edit_likeness(docs).collect(), key=lambda r: r.id)
    order = sorted((r[0], r[1] or "") for r in corpus)
    assert [r.id for r in got] == [i for i, _ in order]
    for k, (r, (_, t)) in enumerate(zip(got, order)):
        following = order[(k + 1) % len(order)][1]
        q = len(t) // 4
        edited = t[: len(t) - q] + following[:q] if q else t
        own, new, after = (fingerprints.fingerprints([x])[0] for x in (t, edited, following))
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (fingerprints.spelled(own), fingerprints.spelled(new))
        assert (r.near_edited, r.near_next) == (fingerprints.likeness(own, new), fingerprints.likeness(own, after))
    long = [r for r in got if r.n_chars > 500]
    assert sum(r.near_edited > r.near_next for r in long) >= 0.9 * len(long)


@pytest.mark.parametrize("ids", [[None], [None, None, None], [None, 5], [None, 5, 5, 5], [None, None, 1, 2, 3], [None, 1, 1, 1, 1, 1, 1, 2]])
def test_rows_without_an_id_have_a_next_row(spark, ids):
    rows = [(i, f"text {k} of the table") for k, i in enumerate(ids)]
    got = fingerprints.edit_likeness(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.id or 0, r.n_chars) for r in got) == sorted((i or 0, len(t)) for i, t in rows)
    if ids == [None, 5]:
        nexts = {r.id: r.edited_sha256 for r in got}
        edit = lambda t, u: hashlib.sha256((t[: len(t) - len(t) // 4] + u[: len(t) // 4]).encode()).hexdigest()
        assert nexts == {None: edit(rows[0][1], rows[1][1]), 5: edit(rows[1][1], rows[1][1])}


def test_edit_likeness_reads_id_and_text_only(spark, docs, odd_columns):
    more = odd_columns.withColumn("bucket", F.lit("x")).withColumn("tail", F.lit(7)).withColumn("h", F.lit(1.5))
    assert sorted(map(tuple, fingerprints.edit_likeness(more).collect())) == sorted(map(tuple, fingerprints.edit_likeness(docs).collect()))


def test_edit_likeness_of_few_rows(spark, empty):
    assert fingerprints.edit_likeness(empty).count() == 0
    one = fingerprints.edit_likeness(spark.createDataFrame([(4, "some text here")], "doc_id long, text string")).first()
    assert one.near_next == 1.0 and one.n_chars == 14
    same = fingerprints.edit_likeness(spark.createDataFrame([(4, "x y"), (4, "x y"), (9, None)], "doc_id long, text string")).collect()
    assert len(same) == 3 and len({r.fingerprint for r in same if r.id == 4}) == 1
    assert fingerprints.read_spelled(one.fingerprint)[0].dtype == np.uint32


# --- pieces


@pytest.fixture(scope="module")
def vocabulary():
    return piece_sampling.load(tokenizer("piece_bpe_32k.model"))


def every_path(v, text):
    b = (" " + text).encode() if text else b""
    known = {s: i for i, s in enumerate(v.spelling) if s and i not in set(v.of_byte.tolist())}
    out = []

    def go(p, ids, w):
        if p == len(b):
            out.append((tuple(ids), w))
            return
        k = 1
        while p + k < len(b) and b[p + k] & 0xC0 == 0x80:
            k += 1
        for n in range(1, v.longest + 1):
            if p + n <= len(b) and b[p : p + n] in known:
                i = known[b[p : p + n]]
                go(p + n, [*ids, i], w + v.log_weight[i])
        if b[p : p + k] not in known:
            own = [int(v.of_byte[x]) for x in b[p : p + k]]
            go(p + k, ids + own, w + sum(v.log_weight[i] for i in own))

    go(0, [], 0.0)
    total = np.logaddexp.reduce([w for _, w in out])
    return {p: math.exp(w - total) for p, w in out}


@pytest.mark.parametrize("text", ["the cat", "a\nb", "é漢🙂x", "  two", "", "▁x"])
def test_samples_follow_the_lattice(vocabulary, text):
    p = every_path(vocabulary, text)
    n = 4000
    (block,) = blocks(pa.array([text] * n), 1 << 30)
    rows = piece_sampling.sample_block(vocabulary, block, mix(np.arange(n, dtype=np.uint64)), 3)
    first = Counter(tuple(r[0][0].tolist()) for r in rows)
    for path, share in sorted(p.items(), key=lambda x: -x[1])[:4]:
        assert abs(first[path] / n - share) < 0.04
    whole = 0.0
    for r in rows:
        assert len({tuple(x[0].tolist()) for x in r}) == len(r) == min(3, len(p))
        assert [x[2] for x in r] == sorted((x[2] for x in r), reverse=True)
        assert all(math.isclose(math.exp(x[1]), p[tuple(x[0].tolist())], rel_tol=1e-9) and x[3] <= 0 for x in r)
        whole += sum(math.exp(x[1] - x[3]) for x in r) / n
        assert all(piece_sampling.decode(vocabulary, x[0].tolist()) == text for x in r)
    assert abs(whole - 1) < 0.03  # the weighted samples sum to one on average


def test_op9_and_the_pipeline_return_the_pieces(spark, docs, corpus, tmp_path):
    import corpus_pipeline as P
    from helixframe.llm import queries

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    path, texts = tokenizer("piece_bpe_32k.model"), {r[0]: r[1] or "" for r in corpus}
    sampled = sorted((r.id, r.sample, r.pieces) for r in piece_sampling.sample_pieces(docs, path).collect())
    for out in (queries.op9_piece_sampling(spark, str(tmp_path)), P.encode(spark, docs, str(tmp_path))):
        got = piece_sampling.decode_pieces(out, path).collect()
        assert sorted((r.doc_id, r.sample, r.pieces) for r in got) == sampled
        assert all(r.decoded == texts[r.doc_id] and r.decodes and r.n_tokens == len(r.pieces) for r in got)
        assert all(r.pieces_sha256 == hashlib.sha256(np.array(r.pieces, "<i4").tobytes()).hexdigest() for r in got)


def test_pieces_of_null_and_repeated_ids(spark):
    path = tokenizer("piece_bpe_32k.model")
    rows = [(None, "some text"), (None, "some text"), (2, "some text"), (2, "some text"), (2, None), (None, "")]
    got = piece_sampling.encode_and_decode(spark.createDataFrame(rows, "doc_id long, text string"), path).collect()
    of = lambda i: sorted((r.sample, r.pieces_sha256) for r in got if r.id == i and r.pieces)
    assert len(got) == 2 * 4 + 2 and all(r.decodes for r in got)
    assert of(2)[::2] == of(2)[1::2] and of(None)[::2] == of(None)[1::2]
    assert sorted((r.id or 0, r.n_tokens) for r in got if not r.pieces) == [(0, 0), (2, 0)]


def test_pieces_do_not_depend_on_other_rows(spark, docs, corpus, odd_columns, empty):
    path = tokenizer("piece_bpe_32k.model")
    a = {(r.id, r.sample): (r.pieces, r.log_prob) for r in piece_sampling.sample_pieces(docs, path).collect()}
    b = {(r.id, r.sample): (r.pieces, r.log_prob) for r in piece_sampling.sample_pieces(odd_columns.coalesce(1), path).collect()}
    assert {k: v[0] for k, v in a.items()} == {k: v[0] for k, v in b.items()}
    assert all(math.isclose(a[k][1], b[k][1], rel_tol=1e-9, abs_tol=1e-9) for k in a)
    both = piece_sampling.decode_pieces(piece_sampling.sample_pieces(docs, path), path).join(docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("t")), "id")
    assert both.where("decoded <> t").count() == 0 and both.count() >= 2 * len(corpus) - 6
    done = piece_sampling.encode_and_decode(docs, path).collect()
    assert all(r.decodes for r in done)
    assert {(r.id, r.sample): r.pieces_sha256 for r in done} == {k: hashlib.sha256(np.array(v[0], "<i4").tobytes()).hexdigest() for k, v in a.items()}
    assert piece_sampling.sample_pieces(empty, path).count() == 0


# --- toxicity


def kernel_by_definition(s, t):
    from itertools import combinations

    def sums(token):
        x, _ = toxicity.letters([token])
        out = Counter()
        for i in range(len(x)):
            for o in combinations(range(1, toxicity.SPAN), toxicity.ORDER - 1):
                if i + o[-1] < len(x):
                    out[(x[i], *(x[i + k] for k in o))] += toxicity.DECAY ** (o[-1] + 1 - toxicity.ORDER)
        return out

    a, b = sums(s), sums(t)
    return sum(a[k] * b[k] for k in a)


def test_kernel():
    tokens = [b"idiot", b"id-iot", b"idxiot", b"trash", b"a", b"", b"r\xc3\xa9eux", b"IDIOT!!"]
    got = toxicity.kernel(tokens, tokens)
    size = toxicity.scale(tokens)
    for i, s in enumerate(tokens):
        for j, t in enumerate(tokens):
            assert math.isclose(got[i, j] * size[i] * size[j], kernel_by_definition(s, t), rel_tol=1e-3, abs_tol=1e-4)
    assert np.allclose(got[0], got[1], atol=1e-5) and np.allclose(got[0], got[7], atol=1e-5)
    assert got[0, 2] > 0.3 > got[0, 3]


def labelled(spark, word, n=900):
    r = random.Random(8)
    bad = ["grumblesnark", "vilefop", "stinkweed"]
    rows, labels = [], []
    for i in range(n):
        t = word(5000 + i, r.randint(3, 60)).split()
        toxic = r.random() < 0.2
        if toxic:
            for _ in range(r.randint(1, 2)):
                t.insert(r.randrange(len(t)), r.choice(bad) + r.choice(["", "en", "!!", "s"]))
        rows.append((i, " ".join(t), "en", f"s{i % 4}", 0))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def trained(spark, word):
    docs, labels = labelled(spark, word)
    return docs.cache(), labels.cache(), toxicity.train(docs, labels)


def test_toxicity_of_held_out_texts(trained):
    docs, labels, machine = trained
    got = {r.id: r.score for r in toxicity.toxicity(docs, machine).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((got[i] >= 0.7) == truth[i] for i in held) >= 0.97 * len(held)
    assert all(0 <= x <= 1 for x in got.values())


def test_training_gives_memory_back(spark, monkeypatch):
    """The driver trains beside Spark's own memory: it weighs few tokens at once, and keeps nothing when it is done."""
    most, released = [0], []
    weigh = toxicity.weigh
    monkeypatch.setattr(toxicity, "weigh", lambda tokens, table: most.append(len(tokens)) or weigh(tokens, table))
    monkeypatch.setattr(toxicity, "release", lambda: released.append(1))
    texts = [(i, " ".join(f"w{i}x{k}" for k in range(60)) + (" zornig" if i % 2 else " milde")) for i in range(240)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    toxicity.train(docs, docs.selectExpr("doc_id", "cast(doc_id % 2 as int) toxic"))
    assert 0 < max(most) <= 4000 and released


def test_toxicity_reads_texts_only(spark, trained):
    _, _, machine = trained
    rows = [(1, "so vilefop you"), (2, "so v i l e f o p you"), (3, "so vile-fop you"), (4, None), (5, ""), (5, ""), (6, "so kind you"), (7, "x " * 50000 + "grumblesnark"), (None, "so vilefop you")]
    got = [(r.id, r.score) for r in toxicity.toxicity(spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit(9.0)), machine).collect()]
    by = dict(got)
    assert len(got) == len(rows) and by[1] == by[None] >= 0.7 and by[2] >= 0.7 and by[3] >= 0.7 and by[7] >= 0.7
    assert by[4] == by[5] < 0.5 and by[6] < 0.5


def test_letters_beyond_ascii():
    spelled = lambda t: toxicity.letters([t.encode()])[0].tolist()
    assert spelled("réeux") == spelled("RÉEUX") != spelled("reeux") and spelled("ПРИВЕТ") == spelled("привет")
    assert len(set(spelled("абвгдежзийклмнопрстуфхц"))) == 24  # and the bound
    assert len(spelled("“x”")) == 3 and spelled("a b") == [31, 1, 31, 2, 31]
    assert toxicity.kernel([("глупец").encode()], [("глупецы").encode(), ("человек").encode(), b"clever"])[0].argmax() == 0


def scripts_and_phrases(spark, word, n=1500):
    """Insults in Cyrillic, a phrase of two ordinary words, and clean words that have an insult inside."""
    r = random.Random(21)
    vocabulary = word(1, 400).split()
    rows, labels = [], []
    for i in range(n):
        t = [r.choice(vocabulary) for _ in range(r.randint(8, 50))] + ["привет", "человек", "дорога"][: r.randint(0, 3)]
        t += r.sample(["crawl", "hence"], r.randint(0, 1))
        toxic = r.random() < 0.3
        if toxic:
            at = r.randrange(1, len(t))
            t[at:at] = [["гнусняк"], ["crawl", "hence"], ["snark"]][i % 3]
        elif r.random() < 0.3:
            t.insert(r.randrange(len(t)), r.choice(["snarkelberry", "unsnarkable"]))
        rows.append((i, " ".join(t)))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_of_phrases_scripts_and_words_inside_words(spark, word):
    docs, labels = scripts_and_phrases(spark, word)
    machine = toxicity.train(docs, labels)
    assert machine.phrases
    score = {r.id: r.score for r in toxicity.toxicity(docs, machine).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [i for i in score if zlib.crc32(str(i).encode()) % 3 == 1]
    caught = [score[i] >= 0.7 for i in held if truth[i]]
    left = [score[i] < 0.7 for i in held if not truth[i]]
    assert sum(caught) >= 0.95 * len(caught) and sum(left) >= 0.97 * len(left)
    for kind in range(3):
        own = [score[i] >= 0.7 for i in held if truth[i] and i % 3 == kind]
        assert sum(own) >= 0.9 * len(own), kind
    base = word(9, 10)
    texts = ["Crawl, hence!", "hence crawl", "crawl on hence", "гнуснняк", "гнус-няк", "snarkelberry", "человек", "sn4rk"]
    got = [r.score >= 0.7 for r in sorted(toxicity.toxicity(spark.createDataFrame([(i, f"{base} {t} {base}") for i, t in enumerate(texts)], "doc_id long, text string"), machine).collect(), key=lambda r: r.id)]
    assert got == [True, False, False, True, True, False, False, True], got


def test_toxicity_without_labels(spark, empty, trained):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    machine = toxicity.train(empty, labels)
    assert toxicity.toxicity(empty, machine).count() == 0
    assert all(r.score < 0.01 for r in toxicity.toxicity(trained[0], machine).take(5))


def test_held_out(spark):
    got = spark.range(50).select("id", toxicity.held_out("id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in got)


# --- the pipeline, stage by stage


def test_null_ids_go_through_all_stages(spark, word, tmp_path):
    import corpus_pipeline as P

    rows = [(i, word(i, 30 + i), "en", ["a", "b"][i % 2], 0) for i in range(12)]
    rows += [(None, word(100 + i, 90), "en", ["a", "b", None][i % 3], 0) for i in range(6)]
    rows += [(None, word(200, 80), lang, source, 0) for lang, source in [("en", None), ("en", None), ("de", None), (None, None), ("en", "b"), ("en", "a")]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    sf = str(tmp_path)
    table = spark.read.parquet(f"{sf}/documents.parquet")
    for stage in (P.reject_toxic, P.drop_repeated_lines, P.drop_near_duplicates):
        assert stage(spark, table, sf).where("doc_id is null").count() == 12
    got = P.mix_sources(spark, table, sf).collect()
    plan = [r for r in mixing.mixed(table).collect() if r.taken]
    assert any(r.id is None for r in plan)
    assert sorted((r.doc_id or -1, r.source or "", len(r.text.split())) for r in got) == sorted((r.id or -1, r.source or "", r.taken) for r in plan)
    # equal texts keep their own languages: each row at most once in each of three cycles
    own = Counter((r.lang, r.source) for r in got if r.doc_id is None and r.text == word(200, 80))
    have = Counter((x[2], x[3]) for x in rows if x[1] == word(200, 80))
    assert set(own) <= set(have) and all(own[k] <= 3 * have[k] for k in own) and {k[0] for k in own} == {"en", "de", None}
    assert any(r.doc_id is None for r in P.run(spark, sf).collect())


@pytest.mark.parametrize("rows", [[], [(1, None, "en", "a", None), (2, "", "en", None, 0), (2, "", "en", None, 0), (None, " \n", None, None, None)]])
def test_pipeline_of_nothing(spark, tmp_path, rows):
    from helixframe.llm import pipeline as P

    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    table = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in P.STAGES[:3]:
        assert stage(spark, table, str(tmp_path)).count() == len(rows), name
    assert P.run(spark, str(tmp_path)).count() == 0


def test_near_duplicates_leave_one_row_of_each_group(spark, word):
    from helixframe.llm import pipeline as P

    a, b = word(700, 40), word(701, 40)
    rows = [(3, a), (5, a), (5, b), (7, b + " x"), (9, b + " y"), (5, b + " z"), (8, "kept alone " + word(702, 20)), (None, a), (11, None), (12, ""), (8, word(703, 25))]
    table = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in P.drop_near_duplicates(spark, table, "").collect()]
    of_b = [x for x in got if x[1] and x[1].startswith(b)]
    assert (3, a) in got and (5, a) not in got and len(of_b) == 1 and of_b[0][0] == 5
    assert sorted((x for x in got if x not in of_b), key=str) == sorted([(3, a), rows[6], (None, a), (11, None), (12, ""), rows[10]], key=str)


def test_pipeline(spark, word, tmp_path, trained):
    import corpus_pipeline as P
    from test_dedup import components, lines, shingles

    docs, labels, machine = trained
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs.where("doc_id < 150").collect()]
    rows += [(1000, rows[0][1] + " end", "en", "s0", 0), (1001, None, "en", None, 0), (1002, rows[3][1] + "\nthe same line twice", "en", "s1", 0), (1003, "the same line twice\n" + word(1, 40), "en", "s2", 0)]
    spark.createDataFrame(rows, docs.schema).write.parquet(str(tmp_path / "documents.parquet"))
    labels.where("doc_id < 150").write.parquet(str(tmp_path / "labels.parquet"))
    sf = str(tmp_path)
    assert [n for n, _ in P.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "encoding"]
    table = spark.read.parquet(f"{sf}/documents.parquet")

    own = toxicity.train(table, spark.read.parquet(f"{sf}/labels.parquet"))
    score = {r.id: r.score for r in toxicity.toxicity(table, own).collect()}
    one = P.reject_toxic(spark, table, sf)
    assert one.columns == list(P.COLUMNS) and {r.doc_id for r in one.collect()} == {i for i in score if score[i] < 0.7}

    two = P.drop_repeated_lines(spark, table, sf)
    assert two.columns == list(P.COLUMNS)
    assert sorted((r.doc_id, r.text) for r in two.collect()) == [x[:2] for x in lines([r[:2] for r in rows], 10, 2)]

    three = P.drop_near_duplicates(spark, table, sf)
    sets = {r[0]: shingles(r[1], 5) for r in rows}
    import itertools

    c = components(sets, [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    assert sorted(r.doc_id for r in three.collect()) == sorted(i for i in c if c[i] == i)

    four = P.mix_sources(spark, table, sf)
    taken = sum(r.taken or 0 for r in mixing.mixed(table).collect())
    assert four.columns == list(P.COLUMNS) and sum(len(r.text.split()) for r in four.collect()) == taken

    whole = P.run(spark, sf).collect()
    assert whole and all(r.decodes for r in whole)
