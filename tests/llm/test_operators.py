"""Each operator against a plain version of its definition, with nulls, empty and repeated rows, ties, extra columns and empty tables."""

import base64
import hashlib
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from policyloom.llm import bpe, components, embeddings, fingerprints, jaccard, kernels, langid, linedup, mixing, suffixes, toxicity, warc
from policyloom.runtime import shared_dir

tokenizers = pytest.importorskip("public_tokenizers")


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


# --- kernels and components ---------------------------------------------------------------------------------------


def test_window_hashes_depend_on_bytes_alone():
    data = np.frombuffer(b"abcdefghij" * 20, np.uint8)
    for width in (1, 2, 3, 7, 20, 50):
        assert len(set(kernels.window_hashes(data, width).tolist())) == 10
    assert len(kernels.window_hashes(data[:10], 50)) == 0


def test_shingles_follow_the_definition():
    got = list(kernels.batch_shingles([None, b"", b"a b", b"A  b", b"a b c d e f", "é\x0bx".encode(), b"x " * 9]))
    assert [len(g) for g in got] == [0, 0, 1, 1, 2, 1, 1] and (got[2] == got[3]).all()


def test_long_words_and_texts_are_whole():
    long = b"x" * (3 << 20)
    a, b = kernels.batch_shingles([long + b" y", long + b"x y"])
    assert len(a) == len(b) == 1 and a[0] != b[0]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, k) for k in range(101, 120)] + [(7, 7)]
    got = {r.id: r.component_id for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, **{k: 100 for k in range(100, 120)}}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def thue_morse(n, flip=0):
    return "".join("ab"[bin(i).count("1") + flip & 1] for i in range(n))


def test_patterned_words_do_not_collide(spark):
    words = [thue_morse(n, f) for n in (16, 64, 128, 129, 256, 1024, 2048, 8192) for f in (0, 1)]
    sets = list(kernels.batch_shingles([f"{w} w x y z".encode() for w in words]))
    assert len({int(s[0]) for s in sets}) == len(words)
    rows = [(k, f"{w} w x y z") for k, w in enumerate(words)]
    assert sorted(r.component_id for r in jaccard.jaccard_components(docs_of(spark, rows)).collect()) == list(range(len(words)))
    prints = [fingerprints.minhash(s) for s in sets]
    assert all(fingerprints.likeness(a, b) < 0.2 for i, a in enumerate(prints) for b in prints[:i])


def test_spans_are_compared_by_all_bytes():
    data = np.frombuffer(b"abcdefghijklmnop" + b"abcdefghijklmnoX" + b"abcdefghijklmnop", np.uint8)
    blocks = kernels.blocks_of(data)
    starts, sizes = np.array([0, 0, 0]), np.array([16, 16, 15])
    assert kernels.same_spans(data, blocks, starts, np.array([16, 32, 16]), sizes).tolist() == [False, True, True]
    first, which = bpe._distinct_spans(data, blocks, np.array([0, 16, 32]), np.array([16, 16, 16]), np.array([7, 7, 7], np.uint64))
    assert which[0] == which[2] != which[1] and len(first) == 2


# --- 1 embeddings -------------------------------------------------------------------------------------------------


def brute_vectors(rows):
    ok = [r for r in rows if r[1] is not None and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    unit = [np.array(r[1]) / np.linalg.norm(r[1]) for r in ok]
    links, comp = dict.fromkeys([r[0] for r in rows], 0), {r[0]: r[0] for r in rows}
    near = [[a for a in range(len(ok)) if a != b and ok[a][2] == ok[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.98] for b in range(len(ok))]
    for b, r in enumerate(ok):
        links[r[0]] = len(near[b])
    changed = True
    while changed:
        changed = False
        for b, r in enumerate(ok):
            least = min([comp[r[0]], *(comp[ok[a][0]] for a in near[b])])
            changed |= least != comp[r[0]]
            comp[r[0]] = least
    return sorted((i, links[i], comp[i], comp[i] == i) for i in links)


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(300):
        center = np.random.default_rng(i % 25).standard_normal(16)
        rows.append((1000 - i, [float(np.float32(x)) for x in center + 0.12 * rng.standard_normal(16)], i % 3))
    rows += [(2000, rows[0][1], rows[0][2]), (2001, [2 * x for x in rows[0][1]], rows[0][2]), (2002, rows[0][1], None), (2003, None, 1), (2004, [0.0] * 16, 1), (2005, [float("nan")] * 16, 1), (2006, [None] * 16, 1), (2007, [1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("kept", F.lit("clash"))
    far = spark.createDataFrame([(1, [1e200, 1e200], 0), (2, [1e-200, 1.01e-200], 0), (3, [1e200, -1e200], 0), (4, [5e199, 5e199], 0)], "vec_id long, embedding array<double>, label int")
    assert sorted(map(tuple, embeddings.near_duplicates(far).collect())) == [(1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True), (4, 2, 1, False)]
    assert sorted(map(tuple, embeddings.near_duplicates(df, block=7).collect())) == brute_vectors(rows)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


# --- 2 fingerprints -----------------------------------------------------------------------------------------------


def test_fingerprints(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    rows = [(k * 3, " ".join(rng.choice(words) for _ in range(rng.randint(0, 200))) + "é😀") for k in range(120)] + [(400, rows_text := "same text here"), (401, rows_text), (402, None), (402, "b"), (402, "a")]
    got = fingerprints.edit_pairs(docs_of(spark, rows).withColumn("near_next", F.lit(1))).collect()
    order = sorted(rows, key=lambda r: (r[0], r[1] or ""))
    texts = [t or "" for _, t in order]
    after = texts[1:] + texts[:1]
    by = {(r.doc_id, r.edited_sha256): r for r in got}
    assert len(got) == len(rows)
    for (i, _), t, n in zip(order, texts, after):
        changed = fingerprints.edited(t, n)
        r = by[i, hashlib.sha256(changed.encode()).hexdigest()]
        assert r.n_chars == len(t)
        a, b, c = kernels.batch_shingles([t.encode(), changed.encode(), n.encode()])
        true = lambda x, y: len(np.intersect1d(x, y)) / len(np.union1d(x, y)) if len(x) or len(y) else 1.0
        assert abs(r.near_edited - true(a, b)) < 0.15 and abs(r.near_next - true(a, c)) < 0.15
    assert by[400, hashlib.sha256(fingerprints.edited(rows_text, rows_text).encode()).hexdigest()].near_next == 1.0
    assert fingerprints.edit_pairs(docs_of(spark, [])).count() == 0
    assert fingerprints.edit_pairs(docs_of(spark, [(None, "a b")])).first().near_next == 1.0


# --- 3 archives ---------------------------------------------------------------------------------------------------


def test_archives_round_trip(spark):
    tricky = "a\r\n\r\nWARC/1.1\r\nContent-Length: 0\r\n\r\n"
    rows = [(1, "u\r\nX: y", tricky), (2, None, tricky), (3, "x", None), (4, "y", ""), (None, "q", "é"), (7, "q", "é"), (7, "q", "é"), (8, "q", "é"), (9, "z", "only")]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("record_type", F.lit("clash")), records_per_file=2).collect()
    digest = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    expected = []
    for i, _, h in rows:
        h = h or ""
        top = max((r[0] for r in rows if (r[2] or "") == h and r[0] is not None), default=None)
        again = i is not None and i != top
        expected.append((i, len(h.encode()), digest(h), "revisit" if again else "response", top if again else None))
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# --- 4 suffix arrays ----------------------------------------------------------------------------------------------


def brute_repeats(rows, length=50):
    key = lambda i: 1 << 63 if i is None else i
    first = {}
    for i, t in rows:
        raw = (t or "").encode()
        for k in range(len(raw) - length + 1):
            first[raw[k : k + length]] = min(first.get(raw[k : k + length], 1 << 64), key(i))
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for k in range(len(raw) - length + 1):
            if first[raw[k : k + length]] < key(i):
                gone[k : k + length] = True
        runs = int((np.diff(np.concatenate(([False], gone)).astype(int)) == 1).sum())
        out.append((i, len(raw), int(gone.sum()), runs, bytes(b for b, g in zip(raw, gone) if not g)))
    return sorted(out, key=str)


def test_suffix_dedup(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdé \n") for _ in range(rng.randint(0, 400))) for _ in range(10)]
    rows = []
    for _ in range(120):
        t = "".join(rng.choice(base)[rng.randint(0, 150) : rng.randint(100, 400)] for _ in range(rng.randint(0, 4)))
        rows.append((rng.randint(0, 110), t + "ab" * rng.choice([0, 0, 60]) + "\0" * rng.choice([0, 70])))
    rows += [(None, base[0] * 2), (None, base[0]), (7, None), (8, "")]
    got = suffixes.remove_repeats(docs_of(spark, rows).withColumn("kept", F.lit(0)))
    assert sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got.collect()], key=str) == brute_repeats(rows)
    assert suffixes.remove_repeats(docs_of(spark, [])).count() == 0


def test_levels_merge_geometrically():
    levels = suffixes.SuffixLevels(2)
    rng = random.Random(8)
    for k in rng.sample(range(32), 32):
        levels.add(np.array([bytes([k, k + 1])], "S2"))
    sizes = [len(x) for x in levels.levels]
    assert sum(sizes) == 32 and all(2 * b < a for a, b in zip(sizes, sizes[1:]))
    assert all((np.sort(x) == x).all() for x in levels.levels)
    assert levels.scan(np.array([bytes([1, 1]), bytes([7, 8]), bytes([99, 100])], "S2")).tolist() == [False, True, False]


def test_suffix_array_is_in_byte_order():
    rng = random.Random(9)
    texts = [bytes(rng.choices([0, 1, 128, 255], k=rng.randint(5, 300))) for _ in range(20)] + [bytes(60), bytes(5)]
    plain = [t[k : k + 5] for t in texts for k in range(len(t) - 4)]
    order, strings, first = suffixes.suffix_array(texts, 5)
    assert order.tolist() == sorted(range(len(plain)), key=lambda k: (plain[k], k))
    assert [x.ljust(5, b"\0") for x in strings.tolist()] == sorted(plain)
    assert [k for k in range(len(plain)) if first[k]] == [k for k in range(len(plain)) if not k or sorted(plain)[k] != sorted(plain)[k - 1]]


def test_pieces_cover_each_string_once():
    data = np.frombuffer(bytes(random.Random(1).choices(range(97, 101), k=5000)), np.uint8)
    anchor, start, count = suffixes.pieces(data, 50, 20)
    assert start[0] == 0 and (start[1:] == start[:-1] + count[:-1]).all() and start[-1] + count[-1] == len(data) - 49


# --- 5 lines ------------------------------------------------------------------------------------------------------


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a != b and len(b) - len(a) <= 1 and (a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :])


@pytest.mark.parametrize("least", [1, 8])
def test_line_dedup(spark, least):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcde ") for _ in range(rng.randint(1, 30))) for _ in range(40)]

    def changed(x):
        i, r = rng.randrange(len(x) + 1), rng.random()
        return x if r < 0.3 else x[:i] + rng.choice("abé") + x[i:] if r < 0.55 else x[:i] + x[i + 1 :] if r < 0.75 else x[:i] + rng.choice("aü") + x[i + 1 :]

    rows = [(k, "\n".join(changed(rng.choice(base)) for _ in range(rng.randint(0, 6)))) for k in (*range(-70, 74), -(1 << 63), 1 - (1 << 63), (1 << 63) - 1, (1 << 63) - 2, -(1 << 31), 1 << 31)]
    rows += [(None, "abc"), (500, None), (501, ""), (502, "aa\n\n \nbb"), (502, "aa\ncc"), (503, "x" * 3000), (504, "x" * 3001)]
    key = lambda i: 1 << 63 if i is None else i
    seen = [(key(i), p, x) for i, t in rows if t is not None for p, x in enumerate(t.split("\n")) if x.strip(" \t\r\x0b\f")]
    first = {}
    for i, p, x in sorted(seen):
        first.setdefault(x, (i, p))
    near = {x for x in first if len(x) >= least and any(len(y) >= least and first[y] < first[x] and one_edit(x, y) for y in first)}
    expected = [(i, None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if x not in first or x not in near and first[x] == (key(i), p))) for i, t in rows]
    got = linedup.dedupe_lines(docs_of(spark, rows).withColumn("n_lines", F.lit("clash")), near_chars=least).select("doc_id", "text").collect()
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)
    assert near and linedup.dedupe_lines(docs_of(spark, [])).count() == 0


def test_short_lines_one_edit_apart_and_a_hot_line(spark):
    rows = [(0, "short line one\na\nhot"), (1, "short line onf\nb\nhot"), (2, "short line tne!\nab\nhot"), (3, "other\nhot"), *[(k, "hot\nhot") for k in range(4, 400)]]
    got = {r.doc_id: (r.text, r.n_removed) for r in linedup.dedupe_lines(docs_of(spark, rows)).collect()}
    assert got[0] == ("short line one\na\nhot", 0) and got[1] == ("b", 2) and got[2] == ("short line tne!\nab", 1) and got[3] == ("other", 1)
    assert all(got[k] == ("", 2) for k in range(4, 400))


def test_code_keeps_its_short_lines_and_negative_ids_meet(spark):
    code = "{\nx = compute(a)\n}\n1\n2"
    rows = [(-2, "x\nline number one"), (-1, "y\nline number onf"), (5, code)]
    got = {r.doc_id: r.text for r in linedup.dedupe_lines(docs_of(spark, rows)).collect()}
    assert got == {-2: "x\nline number one", -1: "y", 5: code}


def test_a_text_of_many_lines_is_rebuilt(spark):
    lines = [f"line {k:08} {k * 7919 % 1000003:08}" for k in range(60_000)]
    rows = [(1, "\n".join(lines[::2])), (2, "\n".join(lines))]
    got = {r.doc_id: r.text for r in linedup.dedupe_lines(docs_of(spark, rows), near_chars=100).collect()}
    assert got[1] == rows[0][1] and got[2] == "\n".join(lines[1::2])


# --- 6 toxicity ---------------------------------------------------------------------------------------------------


def test_grammar_machines():
    model = toxicity.ToxicityModel({"idiot": 3.0, "lowei*": 2.0}, np.zeros(11))
    kinds = lambda t: sorted(toxicity.KINDS[k] for k, _ in toxicity.matches(t, model))
    assert kinds("What an idiot.") == ["plain"] and kinds("You are an idiot!") == ["targeted"]
    assert kinds("This is not an idiot.") == ["negated"] and kinds("She wrote that the man is an idiot") == ["reported"]
    assert kinds("I will kill. Idiot") == ["plain", "threat"] and kinds("idiotic loweiung") == ["plain"] and kinds("") == []


def test_toxicity_is_learned(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("bdgklmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(200)]
    rows, labels = [], []
    for i in range(600):
        toxic = rng.random() < 0.3
        t = [rng.choice(words) for _ in range(30)] + ([rng.choice(["zorgol", "vexing" + rng.choice(words)])] if toxic else [])
        rng.shuffle(t)
        rows.append((i, " ".join(t)))
        labels.append((i, int(toxic)))
    docs, known = docs_of(spark, [*rows, (None, None), (900, ""), (1, rows[1][1])]), spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, known.where(~toxicity.held_out()))
    got = toxicity.add_scores(docs.withColumn("score", F.lit("clash")), model).collect()
    truth = dict(labels)
    hits = [r.predicted == truth[r.doc_id] for r in got if r.doc_id in truth]
    assert len(got) == 603 and np.mean(hits) > 0.97 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if not r.text}) == 1
    none = toxicity.fit(docs, known.limit(0))
    assert toxicity.score("you idiot", none) > 0.5 > toxicity.score("fine", none)
    assert toxicity.add_scores(docs.limit(0), none).count() == 0


# --- 7 languages --------------------------------------------------------------------------------------------------


def test_language_id(spark):
    rng = random.Random(7)
    stems = {"xx": "ka lo mi tu re", "yy": "sch ung ein ver keit", "zz": "ção nho lha que dos"}
    rows = [(i, " ".join("".join(rng.choices(stems[x].split(), k=3)) for _ in range(rng.randint(3, 40))), x) for i in range(300) for x in [rng.choice(list(stems))]]
    rows += [(400, None, "xx"), (401, "", "yy"), (402, "123 !?", "zz"), (403, "kalomi", None), (403, "kalomi", None), (None, "schungein verkeit", "yy"), (405, "ver" * 200_000, "yy")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    model = langid.fit(docs.where(~langid.held_out()), max_rows=120, landmarks=24)
    got = langid.identify(docs, model).collect()
    hits = [r.lang == r.lang_pred for r in got if r.doc_id is not None and r.doc_id < 300 and r.doc_id]
    assert len(got) == len(rows) and np.mean(hits) > 0.97
    assert {r.lang_pred for r in got if r.doc_id in (400, 401, 402)} == {"und"}
    assert {r.lang_pred for r in got if r.doc_id == 403} == {"xx"} and {r.lang_pred for r in got if r.doc_id == 405} == {"yy"}
    empty = langid.fit(docs.limit(0))
    assert {r.lang_pred for r in langid.identify(docs, empty).collect()} == {"und"} and langid.identify(docs.limit(0), model).count() == 0


def test_kernel_is_that_of_presence_sets():
    rows = np.zeros((2, 1 << 14), np.float32)
    for text, row in zip(("abcabc", "bcd"), rows):
        langid.presence(text, (1, 2, 3), 1 << 14, row)
    sets = [{t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)} for t in ("abcabc", "bcd")]
    assert rows.sum(1).tolist() == [len(s) for s in sets] and (rows[0] @ rows[1]) == len(sets[0] & sets[1])


def test_every_language_is_learned(spark):
    rows = [(k, chr(0x4E00 + k % 430) * 3, f"l{k % 430:03}") for k in range(430 * 5 - 3)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(labelled)
    assert len(model.languages) == 430
    assert langid.score_block([rows[429][1]], model)[0] == ["l429"]


# --- 8 Jaccard ----------------------------------------------------------------------------------------------------


def brute_components(rows, percent=80):
    sets = []
    for _, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i, len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("block, short_list", [(4, 3), (512, 32)])
def test_jaccard_components(spark, block, short_list):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 90))) for _ in range(20)]
    rows = []
    for k in range(300):
        w = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            if w:
                j = rng.randrange(len(w))
                w[j : j + 1] = rng.choice([[], ["zz"], [rng.choice(words)]])
        rows.append((k * 3 % 901, " ".join(w + ("common line that all have in the end".split() if rng.random() < 0.3 else []))))
    rows += [(5000, None), (5001, ""), (5002, "A b"), (5003, "a  B"), (5004, "A b c d e"), (5005, "a b c d E"), (5005, "a b c d E")]
    got = jaccard.jaccard_components(docs_of(spark, rows).withColumn("component_id", F.lit("clash")), block=block, short_list=short_list)
    assert sorted(map(tuple, got.collect())) == brute_components(rows)


def test_blocks_are_skipped_only_where_no_pair_is_possible():
    rng = np.random.default_rng(9)
    ns = np.sort(rng.integers(5, 400, 300))
    pos = (rng.random(300) * (ns * 0.2 + 1)).astype(np.int64)
    edges = np.arange(0, 300, 16)
    least, most, rests = ns[edges], ns[np.append(edges[1:], 300) - 1], np.maximum.reduceat(ns - pos, edges)
    skipped = 0
    for k in range(300):
        open_ = jaccard.open_blocks(int(ns[k]), int(ns[k] - pos[k]), least, most, rests, 80)
        fits = jaccard._possible(ns, pos, ns[k], pos[k], 80) & (np.minimum(ns, ns[k]) * 100 >= np.maximum(ns, ns[k]) * 80)
        assert not (fits & ~np.repeat(open_, 16)[:300]).any()
        skipped += int((~open_).sum())
    assert skipped > 300


def test_derived_answers_are_right():
    rng = np.random.default_rng(4)
    found = set()
    for _ in range(3000):
        hub = rng.permutation(40)[: rng.integers(10, 40)]
        x, y = (np.union1d(rng.choice(hub, rng.integers(1, len(hub) + 1), False), rng.integers(40, 60, rng.integers(0, 6))) for _ in range(2))
        cx, cy, both = (len(np.intersect1d(a, b)) for a, b in ((x, hub), (y, hub), (x, y)))
        answer = int(jaccard.derived(len(x), cx, len(y), cy, len(hub), 80))
        linked = 100 * both >= 80 * (len(x) + len(y) - both)
        assert answer == 0 or (answer == 1) == linked
        found.add(answer)
    assert found == {-1, 0, 1}


def test_sketches_rule_out_no_link():
    rng = np.random.default_rng(8)
    fate = set()
    for _ in range(2000):
        n = int(rng.integers(1, 300))
        x = np.unique(rng.integers(0, 2**64, n, np.uint64))
        y = np.union1d(x[rng.random(len(x)) < rng.choice([0, 0.5, 0.9, 1])], rng.integers(0, 2**64, rng.integers(1, 1 + n // 8 + 1), np.uint64))
        both = len(np.intersect1d(x, y))
        linked, near = 100 * both >= 80 * (len(x) + len(y) - both), jaccard.may_link(len(x), jaccard.sketch(x), len(y), jaccard.sketch(y), 80)
        assert near or not linked
        fate.add((linked, near, both == 0))
    assert {(True, True, False), (False, False, False), (False, False, True)} <= fate


def test_shingles_of_several_sets_are_counted(spark):
    rows = [(k, " ".join(f"{'all' if j < 30 else 'pair' + str(k // 2) if j < 60 else 'own' + str(k)}-{j}" for j in range(90))) for k in range(40)]
    bits = 7
    want, limit = {}, jaccard._reach(80)
    for s in kernels.batch_shingles([t.encode() for _, t in rows]):
        for stem in jaccard._stems(s[s < limit], bits).tolist():
            want[stem] = want.get(stem, 0) + 1
    got = jaccard.repeated_shingles(docs_of(spark, rows).repartition(5), "doc_id", "text", 5, 80, bits)
    assert sorted(map(tuple, got.collect())) == sorted((k, n) for k, n in want.items() if n > 1)
    assert set(jaccard.frequent_stems(got, 40).tolist()) == {k for k, n in want.items() if n == 40}


@pytest.mark.parametrize("shared", [0, 60])
def test_jaccard_sends_little_of_sets_that_cannot_link(spark, monkeypatch, shared):
    sent, own = {}, {}
    for name in ("_wanted_sets", "_lists"):
        own[name] = getattr(jaccard, name)
        monkeypatch.setattr(jaccard, name, lambda frame, *a, name=name: sent.setdefault(name, []).append(frame.count()) or own[name](frame, *a))
    before = set(os.listdir(shared_dir(spark).removeprefix("file:")))
    rows = [(k, " ".join([f"same{j}" for j in range(shared)] + [f"own{k}-{j}" for j in range(60)])) for k in range(600)]
    got = jaccard.jaccard_components(docs_of(spark, rows), block=16, short_list=8)
    assert {(r.n_shingles, r.component_id == r.doc_id) for r in got.collect()} == {(56 + shared, True)}
    # Shingles of one set are no postings; sketches tell that sets with a common half do not link.
    assert sum(sent["_wanted_sets"]) == 0 and sum(sent["_lists"]) < 600 * (2 if shared == 0 else 15)
    left = {x.partition("-")[0] for x in set(os.listdir(shared_dir(spark).removeprefix("file:"))) - before}
    assert not left & {"lists", "hub", "open", "short", "few", "crowded"}


def test_jaccard_without_rows_or_ids(spark):
    assert jaccard.jaccard_components(docs_of(spark, [])).count() == 0
    got = jaccard.jaccard_components(docs_of(spark, [(None, "a b c"), (4, "a b c"), (2, "a b c")])).collect()
    assert sorted(map(tuple, got), key=str) == [(2, 1, 2), (4, 1, 2), (None, 1, None)]


# --- 9 mixing -----------------------------------------------------------------------------------------------------


def test_mixing_meets_targets(spark):
    rows = [(i, f"t{i}", "big" if i % 10 else ("small" if i % 20 else None)) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("copy_no", F.lit("clash"))
    mixed = mixing.mix(docs, weights={"big": 1.0, "small": 2.0}, default_weight=1.0).collect()
    share = {s: sum(r.source == s for r in mixed) / len(mixed) for s in ("big", "small", None)}
    assert abs(share["big"] - 0.25) < 0.03 and abs(share["small"] - 0.5) < 0.03 and abs(len(mixed) - 6000) < 300
    by = {}
    for r in mixed:
        by.setdefault(r.doc_id, []).append(r)
    assert all(sorted(x.copy_no for x in v) == list(range(1, v[0].n_copies + 1)) for v in by.values())
    again = mixing.mix(docs.repartition(7), weights={"big": 1.0, "small": 2.0}, default_weight=1.0)
    assert sorted((r.doc_id, r.copy_no) for r in again.collect()) == sorted((r.doc_id, r.copy_no) for r in mixed)
    assert not [r for r in mixing.mix(docs, weights={"big": 0.0}).collect() if r.source == "big"]
    assert mixing.mix(docs.limit(0)).count() == 0
    joined = mixing.rates(docs, max_local_sources=1).select("s", "rate").collect()
    assert sorted((r.s or "", round(r.rate, 9)) for r in joined) == sorted((r.s or "", round(r.rate, 9)) for r in mixing.rates(docs).select("s", "rate").collect())


def test_poisson_counts_invert_the_distribution(spark):
    from math import exp, factorial

    for rate in (0.3, 2.5, 40.0):
        exact = np.cumsum([exp(-rate) * rate**k / factorial(k) for k in range(160)])
        draws = [0.0, 0.01, 0.2, 0.5, 0.9, 0.999999, 1 - 2**-40]
        got = spark.createDataFrame([(u,) for u in draws], "u double").select(mixing.poisson_count(F.lit(rate), F.col("u")).alias("n")).collect()
        assert [r.n for r in got] == [int((exact <= u).sum()) for u in draws]
    assert spark.range(1).select(mixing.poisson_count(F.lit(0.0), F.lit(0.5)).alias("n")).first().n == 0
    # A rate of several hundred copies needs no table of its distribution.
    assert 400 < spark.range(1).select(mixing.poisson_count(F.lit(500.0), F.lit(0.5)).alias("n")).first().n < 600


# --- 10 tokens ----------------------------------------------------------------------------------------------------


def reference_encoding():
    import tiktoken

    ranks = {token: k for k, token in enumerate(bpe.read_ranks(tokenizers.path("byte_bpe_multi_50k.tiktoken")))}
    return tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoding_equals_the_library(spark):
    rng = random.Random(8)
    letters = " \n\t'  abstredvlm'é中文٣½²!?., 　😀1ⅧßÀ_-\x1c\x85'"
    texts = ["", "  ", "it's I'll we've 'x 's\n's ''s 'll", "a  \n b", "x" * 5000, " " * 300 + "a", "'re're'r", "don't", None]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(800)]
    texts += [thue_morse(n, f) for n in (1024, 2048, 8192) for f in (0, 1)] + [thue_morse(2048) + " " + thue_morse(2048, 1), "né lo " * 200_000]
    rows = [(i, t, "keep") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    path = tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode(docs, path)
    library = reference_encoding()
    decoded = {r.doc_id: r for r in bpe.decode(encoded, path).collect()}
    for i, t in enumerate(texts):
        assert bpe.unpack(decoded[i].token_ids) == library.encode_ordinary(t or "")
        assert bytes(decoded[i].decoded).decode() == (t or "") and decoded[i].n_tokens == len(bpe.unpack(decoded[i].token_ids))
    assert bpe.encode(docs.limit(0), path).count() == 0


def test_perfect_hash_is_minimal():
    keys = kernels.mix(np.arange(1, 2001, dtype=np.uint64))
    assert sorted(bpe.PerfectHash(keys)(keys).tolist()) == list(range(2000))
