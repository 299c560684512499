"""Operators against brute force on small fixtures with nulls, empties, ties, repeats and clashing columns."""

import hashlib
import itertools
import math
import random
import re
import time
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from symspark.llm import chat_repair, components, decontaminate, knn_quality, line_dedup, mixing, ngram_jaccard_join, pii, pitman_yor, quality_cascade, store, textops, warc
from symspark.llm.store import new_folder

DOCS = "doc_id long, text string"


def texts(seed, n, words=60, vocabulary=400):
    r = random.Random(seed)
    v = ["".join(r.choices("abcdeéß", k=r.randint(1, 6))) for _ in range(vocabulary)]
    return [" ".join(r.choices(v, k=words)) for _ in range(n)]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 50), (50, 50), (None, 3), (100, 50)], "a long, b long")
    got = {r.node: r.component for r in components.components(edges).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 50: 50, 100: 50}


def test_jaccard_against_brute_force(spark):
    rows = list(enumerate(texts(1, 12)))
    r = random.Random(2)
    for k in range(60):
        w = rows[k % 12][1].split(" ")
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = "changed%d" % r.randrange(9)
        rows.append((100 + k, " ".join(w)))
    rows += [(500, None), (501, ""), (502, " \t"), (503, "one Two"), (504, "ONE two"), (505, "x"), (506, texts(3, 1, 30000)[0]), (507, rows[-1][1])]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in ngram_jaccard_join.near_duplicates(spark.createDataFrame([(i, t, 1) for i, t in rows], DOCS + ", sigs int"), 3, "0.9", block=16).collect()}

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0d]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()

    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = Counter()
    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert got == {i: (len(s), find(i), links[i]) for i, s in sets.items()}


@pytest.mark.parametrize("similarity", ["0.8", "0.9"])
def test_jaccard_links_share_a_signature(similarity):
    bands, r, total, elements = ngram_jaccard_join.size_bands(Fraction(similarity), 1 << 20), np.random.default_rng(5), 0, 0
    for n in [*range(5, 60), 100, 300, 1000, 6000, 20000]:
        for extra in (0, n // 20, n // 8):
            most = int((Fraction(1) - Fraction(similarity)) * (n + extra))  # with so many of the union not shared they still link
            whole = r.integers(0, 1 << 64, size=n + extra, dtype=np.uint64)
            alone = r.permutation(n + extra)[:most]
            left = int(r.integers(0, most + 1))
            pair = [np.sort(np.delete(whole, alone[:left])), np.sort(np.delete(whole, alone[left:]))]
            if len(np.union1d(*pair)) == 0 or np.array_equal(*pair):
                continue
            sigs, each = ngram_jaccard_join.signatures(np.concatenate(pair), np.array([len(x) for x in pair]), bands)
            assert len(np.intersect1d(sigs[: each[0]], sigs[each[0] :])), (n, extra)
            total, elements = total + len(sigs), elements + len(pair[0]) + len(pair[1])
    assert total < 2 * elements


def test_pipeline_near_copies_are_those_of_five_words_and_eight_tenths(spark):
    base = texts(31, 3, 200, 3000)
    w = texts(32, 3, 60, 3000)
    rows = [(i, t) for i, t in enumerate(base)]
    rows.append((10, base[0] + " " + " ".join(w[0].split(" ")[:40])))  # an appended fifth: near at 0.8, not at 0.9
    edited = base[1].split(" ")
    for at in range(10, 200, 50):
        edited[at] = "changed"  # four scattered edits: 20 of 196 shingles
    rows.append((11, " ".join(edited)))
    rows.append((12, base[2] + " " + w[2]))  # too long to be a copy

    def shingles(t):
        x = t.lower().split()
        return {tuple(x[i : i + 5]) for i in range(len(x) - 4)}

    copies = {(a, b) for (a, x), (b, y) in itertools.combinations(rows, 2) if 10 * len(shingles(x) & shingles(y)) >= 8 * len(shingles(x) | shingles(y))}
    assert copies == {(0, 10), (1, 11)}
    got = corpus_pipeline.near_copies(spark, spark.createDataFrame([(i, t) for i, t in rows], DOCS), "")
    assert sorted(r.doc_id for r in got.collect()) == [0, 1, 2, 12]


def test_jaccard_sets_of_a_common_passage_are_not_compared_in_full(spark, monkeypatch):
    r, rows = random.Random(41), []
    common = texts(43, 1, 60, 3000)[0]
    for i in range(150):  # half of each text in common, a third of two texts' shingles
        rows.append((i, common + " " + " ".join(f"w{r.randrange(10**6)}" for _ in range(60))))
    long = texts(42, 1, 120, 3000)[0].split(" ")
    for i in range(40):  # near copies, in a chain of a few edits each
        long[r.randrange(len(long))] = f"edit{i}"
        rows.append((200 + i, " ".join(long)))
    tables, save = {}, ngram_jaccard_join.save

    def counted(df, name, *a, **k):
        tables[name] = save(df, name, *a, **k)
        if name == "jaccard-links":
            counted.links = tables[name].count()
        return tables[name]

    monkeypatch.setattr(ngram_jaccard_join, "save", counted)
    got = {x.doc_id: (x.component_id, x.n_links) for x in ngram_jaccard_join.near_duplicates(spark.createDataFrame(rows, DOCS), 5, "0.8", block=16, sketched=12).collect()}
    assert counted.links <= 40 * 3  # those of the chain, once for each of its blocks; before, nearly all of the 150 others too, each once for each of ten blocks

    sets = {}
    for i, t in rows:
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    root, links = {i: i for i in sets}, Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {i: (find(i), links[i]) for i in sets} and len(links) == 40


@pytest.mark.parametrize("similarity", ["0.8", "0.9"])
@pytest.mark.parametrize("others", [0, 20])
def test_jaccard_sketches_lose_no_link(similarity, others):
    r, share = np.random.default_rng(6), Fraction(similarity)
    for n in (3, 40, 255, 257, 1020, 1030, 9000):
        for extra in (0, n // 4):
            most = int((1 - share) * n)
            whole = r.integers(0, 1 << 64, size=n, dtype=np.uint64)
            sets = [np.sort(x) for x in (whole, whole[most:] if most else whole.copy(), *(r.integers(0, 1 << 64, size=n + extra, dtype=np.uint64) for _ in range(others)))]
            words, each = ngram_jaccard_join.sketches(np.concatenate(sets), np.array([len(x) for x in sets]))
            marks = textops.list_array(words.view(np.int64), each, pa.int64())
            rows = pa.RecordBatch.from_arrays([pa.array([7] * len(sets)), pa.array(range(len(sets))), pa.array([len(x) for x in sets]), marks], names=["key", "node", "n", "sketch"])
            cut = [rows.slice(0, 1), rows.slice(1)]
            found = [tuple(x) for b in ngram_jaccard_join._alike(share)(iter(cut)) for x in zip(b["a"].to_pylist(), b["b"].to_pylist(), strict=True)]
            assert (0, 1) in found and (n < 40 or len(found) == 1), (n, extra, found)


def test_jaccard_shared_signatures_over_batches():
    sig, node = [-5, -5, -5, 1, 2, 2, 2, 9, 9], [3, 4, 4, 8, 3, 3, 4, 5, 6]
    for k in range(1, 10):
        batches = [pa.RecordBatch.from_arrays([pa.array(sig[i : i + k]), pa.array(node[i : i + k])], names=["sig", "node"]) for i in range(0, 9, k)]
        keys = {}
        for b in ngram_jaccard_join._shared(iter(batches)):
            for x, y in zip(b["key"].to_pylist(), b["node"].to_pylist(), strict=True):
                keys.setdefault(x, set()).add(y)
        assert sorted(map(sorted, keys.values())) == [[3, 4], [5, 6]]


def test_shuffle_files_of_a_freed_save_go(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        found = disk.getAllFiles()
        return {found.apply(i).getName() for i in range(found.size())}

    before, rows = files(), spark.range(10_000).repartition(3, "id")
    kept, until = store.save(rows, "freed", free=True), time.monotonic() + 20
    while (left := {x for x in files() - before if x.startswith("shuffle_")}) and time.monotonic() < until:
        time.sleep(0.2)
    assert not left and kept.count() == 10_000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) != "true"


def test_jaccard_empty(spark):
    assert ngram_jaccard_join.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_decontamination(spark):
    item = texts(5, 1, 14)[0]
    docs = [(1, "Start " + item.upper().replace("É", "é") + " end"), (2, "no"), (3, None), (4, item + ". " + item), (5, ""), (None, item), (6, "SHORT item"), (6, "SHORT item")]
    items = [(10, item), (9, item), (7, "short item"), (8, None), (6, "!!")]
    got = decontaminate.decontaminate(spark.createDataFrame([(*d, "x") for d in docs], DOCS + ", n_hit string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    want = []
    for i, t in docs:
        w, hit, found = split(t), set(), set()
        for item_id, x in items:
            v = split(x)
            for k in range(max(1, len(v) - 9)) if v else []:
                win = v[k : k + 10]
                for s in range(len(w) - len(win) + 1):
                    if w[s : s + len(win)] == win:
                        hit |= set(range(s, s + len(win)))
                        found.add(str(item_id))
        want.append((i, len(w), len(hit), len(found), ",".join(sorted(found)), bool(hit)))
    key = lambda x: repr(x)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.item_list, r.contaminated) for r in got), key=key) == sorted(want, key=key)


def test_mixing_stays_within_a_block(spark):
    rows = [(i, f"s{min(i % 7, 3)}" if i % 11 else None) for i in range(700)]
    got = mixing.mix(spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, source string, block int"), granularity=40, block=4).collect()
    assert sorted(r.doc_id for r in got) == list(range(700)) and len({r.position for r in got}) == 700
    assert all(r.release <= r.slot < r.deadline for r in got)
    weights = {r.source: r.p for r in mixing.period(mixing.root_weights(spark.createDataFrame([("a", 100), ("b", 9), ("c", 1)], "source string, n long"), 20)).select("source", "p").distinct().collect()}
    assert sum(weights.values()) == 20 and weights["a"] > weights["b"] > weights["c"]
    plan = mixing.period(spark.createDataFrame([("a", 7), ("b", 2), ("c", 1)], "source string, p int")).orderBy("slot").collect()
    done = Counter()
    for t, r in enumerate(plan, 1):
        done[r.source] += 1
        assert all(abs(done[s] - p * t / 10) < 1 for s, p in (("a", 7), ("b", 2), ("c", 1)))


def test_mixing_empty_and_limits(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, source string")).count() == 0
    assert mixing.mix(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, source string"), granularity=1).count() == 2


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def test_pii_base_against_regular_expressions():
    r = random.Random(4)
    for _ in range(3000):
        t = "".join(r.choices("ab@.-+ 0123456789()é", k=r.randint(0, 60)))
        want = [(m.start(), m.end(), "email") for m in EMAIL.finditer(t)]
        want += [(m.start(), m.end(), "ip") for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
        want += [(m.start(), m.end(), "card") for m in CARD.finditer(t) if 14 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and pii.luhn(d)]
        want += [(m.start(), m.end(), "phone") for m in PHONE.finditer(t) if 10 <= len(re.findall("[0-9]", m[0])) <= 15]
        assert pii.find_base(t) == sorted(want, key=lambda s: (s[0], pii.KINDS.index(s[2])))


@pytest.mark.parametrize(
    ("text", "kind", "shown"),
    [
        ("to john (at) mail [dot] com now", "email", "john (at) mail [dot] com"),
        ("jоhn@exаmple.com!", "email", "jоhn@exаmple.com"),
        ("ip one nine two dot one six eight dot zero dot one", "ip", "one nine two dot one six eight dot zero dot one"),
        ("call plus one five five five two three four five six seven eight", "phone", "plus one five five five two three four five six seven eight"),
        ("bob@ex​ample.org", "email", "bob@ex​ample.org"),
    ],
)
def test_pii_disguises(text, kind, shown):
    assert [(k, text[a:b]) for a, b, k in pii.find_disguised(text, pii.find_base(text))] == [(kind, shown)]


@pytest.mark.parametrize(
    ("text", "kind", "base", "whole"),
    [
        ("jоhn@example.com", "email", "hn@example.com", "jоhn@example.com"),
        ("to jane@example.cоm now", "email", "jane@example.c", "jane@example.cоm"),
        ("mary dot jo@example.com", "email", "jo@example.com", "mary dot jo@example.com"),
        ("+44 20 7946 095 eight three one", "phone", "+44 20 7946 095", "+44 20 7946 095 eight three one"),
    ],
)
def test_pii_disguises_beyond_a_base_span(text, kind, base, whole):
    plain = pii.find_base(text)
    assert [(k, text[a:b]) for a, b, k in plain] == [(kind, base)]
    assert [(k, text[a:b]) for a, b, k in pii.find_disguised(text, plain)] == [(kind, whole)]
    assert pii.redact(text) == text.replace(whole, f"[{kind}]")


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("+1 415 555 26 seven one", "phone"),
        ("+1 415 555 26 one", "phone"),
        ("+1 415 555 26 seven", "phone"),
        ("10.0.0.two", "ip"),
        ("4111 1111 1111 111 one", "card"),
    ],
)
def test_pii_few_spelled_digits(text, kind):
    assert (0, len(text), kind) in pii.find_disguised(text, pii.find_base(text))


def test_pii_spelled_digits_alone():
    for text in ("one of 12 files, two at most", "version 2, one fix", "10.0.0.two hundred and 300.1.1.one", "no one 4"):
        assert [s for s in pii.find_disguised(text, pii.find_base(text)) if s[2] != "ip"] == []


def test_pii_rows(spark):
    got = pii.personal_data(spark.createDataFrame([(1, "a@b.co"), (2, None), (None, "look at home.Then"), (3, "")], DOCS)).collect()
    assert [(r.doc_id, r.n_email, r.spans) for r in got] == [(1, 1, "email:0:6"), (2, 0, ""), (None, 0, ""), (3, 0, "")]
    assert pii.redact("x a@b.co y") == "x [email] y"


def test_warc_round_trip(spark):
    big = "é" * 50_000
    rows = [(3, "u", big), (1, "u/ü", big), (2, None, "small"), (4, "u", None), (5, "u", "small"), (6, "u", "WARC/1.1\r\n\r\n" * 30), (7, "u", "x" * 100), (8, "u", "x" * 100), (9, "u", "\n" * 99)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = new_folder(spark, "t")
    warc.write_archives(pages, folder, segment=4096)
    got = {r.page_id: tuple(r)[1:] for r in warc.page_digests(warc.read_archives(spark, folder)).collect()}
    first = {}
    for i, _, h in rows:
        b = (h or "").encode()
        first[b] = min(i, first.get(b, i)) if len(b) >= 100 else i
    want = {i: (len(b := (h or "").encode()), hashlib.sha256(b).hexdigest(), "response" if first[b] == i or len(b) < 100 else "revisit", first[b] if first[b] != i and len(b) >= 100 else None) for i, _, h in rows}
    assert got == want


def test_warc_errors():
    assert warc.dechunked(warc.chunked(b"abc" * 9999, 7)) == b"abc" * 9999
    assert warc.reassemble([(2, 5, b"de"), (1, None, b"abc")]) == (b"abcde", 1)
    for bad in ([(1, None, b"a"), (3, 2, b"b")], [(1, None, b"a"), (2, 9, b"b")]):
        with pytest.raises(warc.WarcError):
            warc.reassemble(bad)
    with pytest.raises(warc.WarcError):
        list(warc.parse(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort"))


def test_quality_counts_and_order(spark):
    t = texts(9, 1, 30)[0]
    rows = [(1, t), (2, t + "\n" + t + "\n\n" + t), (3, None), (4, ""), (5, "THE END!! " * 30), (6, "a*** " * 40)]
    got = {r.doc_id: r for r in quality_cascade.quality_rules(spark.createDataFrame(rows, DOCS)).collect()}
    for i, x in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", x or "")
        c = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        hit = {p for k in range(len(w) - 7) if c[tuple(w[k : k + 8])] > 1 for p in range(k, k + 8)}
        ls = [y for y in (x or "").split("\n") if y.strip(" \t\n\v\f\r")]
        assert (got[i].n_words, got[i].word_chars, got[i].n_dup_lines, got[i].n_repeat_words) == (len(w), sum(map(len, w)), len(ls) - len(set(ls)), len(hit))
    assert got[1].kept and not any(got[i].kept for i in (2, 3, 4, 5, 6))
    a, b = quality_cascade.RULES[:2]
    assert quality_cascade.cascade_order([(a, 2.0, 0.1), (b, 1.0, 0.1)]) == [b, a]


def test_classifier_separates(spark):
    good, bad = texts(11, 60), [" ".join(x + "***" for x in t.split(" ")) for t in texts(12, 60)]
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(good + bad)] + [(900, None, "z"), (901, "", "z")], DOCS + ", score string")
    labels = spark.createDataFrame([(i, int(i < 60), None) for i in range(0, 120, 2)] + [(5000, 1, 1), (None, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in knn_quality.score_quality(docs, knn_quality.fit(docs, labels)).collect()}
    assert all(got[i].predicted == int(i < 60) for i in range(1, 120, 2))
    assert got[900].score == got[901].score == 0 == got[900].predicted


def test_classifier_counts_distinct_words_at_every_length():
    loop = [f"word{i}" for i in range(10)]
    for n in (1999, 2000, 2001, 20_000, 400_000):  # the last is over two pieces long
        row = knn_quality._matrix(pa.array([" ".join(loop[i % 10] for i in range(n))]))[0]
        assert row[knn_quality.TERMS + 3] == pytest.approx(0.3 * (1 - 10 / n))
    several = " ".join(f"w{i % 300_000}" for i in range(400_000))
    assert knn_quality._matrix(pa.array([several, None]))[0][knn_quality.TERMS + 3] == pytest.approx(0.3 * 0.25)


def test_tables_are_seated_customer_by_customer():
    r = np.random.default_rng(8)
    for c, mass, d in ((2, 0.5, 0.5), (7, 3.0, 0.3), (40, 25.0, 0.75), (300, 1e-3, 0.5), (300, 60.0, 0.0)):
        chance = np.zeros(c + 1)
        chance[1] = 1  # of t tables when one customer sits
        for n in range(1, c):
            t = np.arange(c + 1)
            opens = np.where(t > 0, mass / (mass + np.maximum(n - d * t, 0)), 0)
            chance = chance * (1 - opens) + np.concatenate(([0], (chance * opens)[:-1]))
        want, spread = (chance * np.arange(c + 1)).sum(), (chance * np.arange(c + 1) ** 2).sum()
        got = pitman_yor.draw_tables(np.full(20_000, c), np.full(20_000, mass), d, r.integers(0, 1 << 63, 20_000).astype(np.uint64))
        assert got.min() >= 1 and got.max() <= c
        assert got.mean() == pytest.approx(want, abs=6 * math.sqrt(max(spread - want**2, 1e-9) / 20_000) + 1e-3)
    assert list(pitman_yor.draw_tables(np.array([0, 1]), np.array([1.0, 1.0]), 0.5, np.array([1, 2], dtype=np.uint64))) == [0, 1]


@pytest.mark.parametrize("frequent", [0, 20, 1 << 18])
def test_language_model(spark, frequent):
    rows = [(i, t) for i, t in enumerate(texts(21, 60, 80))] + [(90, None), (91, ""), (91, ""), (93, "Unseen words é")]
    docs = spark.createDataFrame([(i, t, i % 7 != 2) for i, t in rows], DOCS + ", train boolean")
    model = pitman_yor.fit(docs, frequent=frequent)
    split = lambda t: re.findall(r"[^\x20\x09-\x0d]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) + [""]
    c = Counter(w for i, t in rows if i % 7 != 2 for w in split(t))
    n, v = sum(c.values()), len(c)
    assert (model.tokens, model.kinds) == (n, v)
    words, states = model.frequent, model.states
    size = len(words.hashes) + 2
    assert size - 2 <= frequent
    raw = sorted(c)
    data = " ".join(x for x in raw if x).encode()
    hashes = dict(zip((x for x in raw if x), textops.words_of_bytes(np.frombuffer(data, dtype=np.uint8), np.array([0, len(data)]))[0], strict=True)) | {"": np.uint64(0)}
    dish = lambda w: int(words.ids(np.array([hashes[w]], dtype=np.uint64))[0]) if w in hashes else size - 2
    pairs, contexts = Counter(), Counter()
    for i, t in rows:
        for u, w in itertools.pairwise([size - 1] + [dish(w) for w in split(t)]):
            if i % 7 != 2:
                pairs[u, w] += 1
                contexts[u] += 1
    assert all(list(s.seating.customers) == [contexts[u] for u in range(size)] for s in states)
    code = lambda u, w: np.array([(u << pitman_yor.DISH_BITS) | w], dtype=np.uint64)
    memo = {}

    def p(u, w):
        if (u, w) not in memo:
            memo[u, w] = sum(float(s.predict(code(u, w), np.array([pairs[u, w]]))[0]) for s in states) / len(states)
        return memo[u, w]

    for u in [size - 1, size - 2, *range(min(size - 2, 5))]:  # each context's dishes come to one
        assert sum(p(u, w) for w in range(size - 1)) == pytest.approx(1, abs=1e-6)
    own = {r.h: r.own for r in model.words.collect()}
    for s in states:  # so do the rare words, the unseen ones among them
        assert sum(own.values()) + sum(x.rare_back(words.rare) * x.outside for x in states) / len(states) == pytest.approx(1, abs=1e-6)
    spelt = lambda w: sum(s.rare_back(words.rare) * 10 ** s.spelling.log10(*pitman_yor.spell(pa.array([w.encode()], type=pa.binary())))[0] for s in states) / len(states)
    got = pitman_yor.score(docs, model).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in rows)
    for r in got:
        w = split(dict(rows)[r.doc_id])
        assert (r.n_tokens, r.n_known) == (len(w), sum(c[x] > 0 for x in w))
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w))
        want = sum(math.log10(p(u, x)) for u, x in itertools.pairwise([size - 1] + [dish(x) for x in w]))
        want += sum(math.log10(own.get(int(np.array(hashes[x]).view(np.int64)), 0) + spelt(x) if x in hashes else spelt(x)) for x in w if dish(x) == size - 2)
        assert r.score == pytest.approx(want)


def test_language_model_reads_the_order_of_words(spark):
    r = random.Random(3)
    base = [" ".join(f"{x} {x}s" for x in r.choices(["red", "green", "blue", "white"], k=30)) for _ in range(40)]
    shuffled = [" ".join(r.sample(t.split(" "), 60)) for t in base[:10]]
    docs = spark.createDataFrame([(i, t, i >= 10 and i < 40) for i, t in enumerate(base + shuffled)], DOCS + ", train boolean")
    got = {x.doc_id: x.score for x in pitman_yor.score(docs, pitman_yor.fit(docs)).collect()}
    assert all(got[i] > got[40 + i] + 10 for i in range(10))


def test_line_dedup(spark):
    line = "a line that stands in many documents é"
    rows = [(i, f"own {i}\n  {line.upper() if i % 2 else line}\t\n{line}\nshort") for i in range(9)] + [(20, None), (21, ""), (22, line[:19]), (23, "\n\n" + line + "\n")]
    df = spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", n_lines int")
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.kept_digest(line_dedup.drop_repeated_lines(df, fan_in=2)).collect()}
    assert got == line_dedup.brute_force(rows)
    assert line_dedup.drop_repeated_lines(spark.createDataFrame([], DOCS)).count() == 0


def test_chat_costs_are_least():
    """Against all sequences of roles, merges and insertions."""
    legal = lambda s: s and s[-1] == 3 and all((a, b) in {(0, 1), (0, 2), (1, 2), (2, 3), (3, 2)} for a, b in zip([0, *s], s, strict=False))
    for n in range(1, 4):
        for roles in itertools.product((0, 1, 2, 3), repeat=n):
            best = 1 << 30
            for target in itertools.product((1, 2, 3), repeat=n):
                label = sum(chat_repair._label_cost(r, t) for r, t in zip(roles, target, strict=True))
                for merges in itertools.product((False, True), repeat=n):
                    if merges[0] or any(m and target[i] != target[i - 1] for i, m in enumerate(merges)):
                        continue
                    kept = [t for t, m in zip(target, merges, strict=True) if not m]
                    for gaps in itertools.product(((), (2,), (3,)), repeat=len(kept)):
                        seq = [x for t, g in zip(kept, gaps, strict=True) for x in (*g, t)]
                        for end in ((), (3,), (2, 3)):
                            if legal([*seq, *end]):
                                best = min(best, label + chat_repair.MERGE * sum(merges) + chat_repair.INSERT * (sum(map(len, gaps)) + len(end)))
            names = {0: None, 1: "system", 2: "user", 3: "assistant"}
            assert chat_repair.brute_force([(names[r], "") for r in roles])[0] == best


def test_chat_blocks_do_not_matter(spark):
    r = random.Random(7)
    rows = [(c if c else None, t if t else None, r.choice(["user", "assistant", "system", "Human", "tool", None]), f"t{t}" if t % 5 else None) for c in range(12) for t in range(r.choice([1, 3, 40]))]
    df = spark.createDataFrame([(*x, 1) for x in rows], "conv_id long, turn long, role string, text string, block int")
    for size in (4, 256):
        whole = {}
        for x in sorted(chat_repair.repair(df, size).collect(), key=lambda x: (x.block, x.place)):
            whole[x.conv_id] = whole.get(x.conv_id, "") + x.rendered
        for c in {x[0] for x in rows}:
            own = sorted((x for x in rows if x[0] == c), key=lambda x: -1 if x[1] is None else x[1])
            assert whole[c] == chat_repair.brute_force([(x[2], x[3]) for x in own])[1]
