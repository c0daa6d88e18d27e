"""Small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import (
    _text,
    ann,
    components,
    decontaminate,
    licenses,
    line_dedup,
    mixing,
    ngram_join,
    quality,
    substring_dedup,
    token_counts,
    toxicity,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, _cuts int, line string"
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORDS.findall((text or "").translate(LOWER))


def shingles(text, n=5):
    w = words(text)
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(n))


def corpus(n=60, seed=1):
    """Texts with near copies, exact copies, nulls, empties, a long text and repeated rows."""
    rng = random.Random(seed)
    texts = ["\n".join(sentence(rng, 25).capitalize() + "." for _ in range(4)) for _ in range(n)]
    for i in range(0, n - 6, 6):
        t = texts[i].split(" ")
        t[len(t) // 2] = "changed"
        texts[i + 1] = " ".join(t)
        texts[i + 2] = texts[i]
    texts += [None, "", " \n\t\n", "short", "Short", "ÄÖ ü é 日本語 x", "a" * 5000, sentence(rng, 6000), "x\x00y z"]
    rows = [(i, t, "en", f"s{i % 4}" if i % 9 else None, 0, "k", 7, "l") for i, t in enumerate(texts)]
    return rows + [rows[3], rows[3], (None, texts[0], None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 3 > 0, i % 2) for i in range(0, 60, 2)], "doc_id long, quality boolean, toxic int").select(
        "doc_id", F.col("quality").cast("int").alias("quality"), "toxic"
    )


def test_span_hashes_tell_words_apart():
    import pyarrow as pa

    texts = ["one two one", None, "", "two", "é one"]
    for _, _, raw, off in _text.chunks(pa.array(texts)):
        _, _, _, first, h = _text.words(raw, off)
    assert first.tolist() == [0, 3, 3, 3, 4, 6]
    assert h[0] == h[2] == h[5] and h[1] == h[3] and len({int(x) for x in h}) == 3


def test_chunks_do_not_change_results():
    import pyarrow as pa

    texts = pa.array([t for _, t, *_ in corpus()])
    whole = list(_text.shingle_sets(texts))
    for t, s in zip(texts.to_pylist(), whole):
        assert len(s) == len(shingles(t))


# 1 lines


def brute_lines(rows, t=0.8):
    """Lines to cut from each (id, text), by all pairs."""
    docs = sorted({(i, x) for i, x, *_ in rows if i is not None and x}, key=lambda d: d[0])
    spots, sets = [], {}
    for i, x in docs:
        at = 0
        for line in x.encode().split(b"\n"):
            low = line.decode().translate(LOWER).encode()
            if any(48 <= c < 58 or 97 <= c < 123 or c > 127 for c in low):
                spots.append((i, at, low))
                sets[low] = frozenset(low[k : k + 5] for k in range(max(len(low) - 4, 1)))
            at += len(line) + 1
    names = list(sets)
    root = dict(zip(names, names))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for k, a in enumerate(names):
        for b in names[:k]:
            both = len(sets[a] & sets[b])
            if both >= t * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    seen, gone = set(), set()
    for i, at, low in spots:
        g = find(low)
        if g in seen:
            gone.add((i, at))
        seen.add(g)
    return gone


def test_line_dedup_is_brute_force(docs):
    report = line_dedup.line_report(docs).collect()
    assert len(report) == docs.count()
    got = {(r.doc_id, x) for r in report if r.doc_id is not None for x in r.removed}
    assert got == brute_lines(corpus())
    assert all(r.n_removed == 0 for r in report if r.doc_id is None)


def templated(seed=3, families=6, size=60):
    """One-line documents: words of a family's template replaced, so that many pairs are just near or just not."""
    rng = random.Random(seed)
    rows = []
    for _ in range(families):
        base = sentence(rng, 16).split(" ")
        for _ in range(size):
            w = list(base)
            for k in rng.sample(range(16), rng.randint(1, 4)):
                w[k] = sentence(rng, 1)
            rows.append(" ".join(w))
    rng.shuffle(rows)
    return [(i, t, None, None, None, None, None, None) for i, t in enumerate(rows)]


@pytest.mark.parametrize("parts", [1, 12])
def test_templated_families_are_brute_force_over_many_batches(spark, parts, monkeypatch):
    monkeypatch.setattr(line_dedup, "BLOCK", 16)
    rows = templated()
    report = line_dedup.line_report(spark.createDataFrame(rows, SCHEMA).repartition(parts)).collect()
    got = {(r.doc_id, x) for r in report for x in r.removed}
    want = brute_lines(rows)
    assert got <= want and len(got) >= 0.99 * len(want)


def test_many_chunks_do_not_change_lines(spark, docs, monkeypatch):
    monkeypatch.setattr(line_dedup.tx, "CHUNK", 300)
    monkeypatch.setattr(line_dedup.tx.chunks, "__defaults__", (300,))
    batch = spark.createDataFrame(corpus(), SCHEMA).select("text").toArrow().to_batches()
    small = [b.to_pylist() for b in line_dedup.bucket_rows(0.8)(iter(batch))]
    monkeypatch.undo()
    large = [b.to_pylist() for b in line_dedup.bucket_rows(0.8)(iter(batch))]
    flat = lambda x: {(r["key"], r["line"], r["mark"]) for b in x for r in b}
    assert flat(small) == flat(large) and len(flat(small)) > 1000


def test_emptied_documents_are_dropped_on_demand(docs):
    out = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs, drop_emptied=True).collect()}
    assert 2 not in out and out[60] is None and out[61] == "" and out[0] == corpus()[0][1]


def test_dedup_lines_cuts_and_keeps_columns(docs):
    out = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect() if r.doc_id is not None}
    assert line_dedup.dedup_lines(docs).columns == docs.columns
    assert out[2].text == "" and out[2].n_chars == 0 and out[60].text is None and out[61].text == ""
    assert out[0].text == corpus()[0][1] and out[3]._cuts == 7 and out[3].line == "l"


# 2 mixing


def brute_mix(rows, weights=(5, 2, 1), share=1.5, cap=2.0):
    """Targets by reshaping again and again."""
    size = {}
    for _, t, _, s, *_ in rows:
        size[s] = size.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = share * sum(size.values()), set()
    while True:
        rest = total - sum(cap * size[s] for s in full)
        target = {s: cap * size[s] if s in full else rest * w[s] / max(sum(w[x] for x in size if x not in full), 1) for s in size}
        over = {s for s in size if s not in full and target[s] > cap * size[s] + 1e-9}
        if not over:
            return size, target
        full |= over


def test_mix_targets_and_copies(docs):
    size, target = brute_mix(corpus())
    out = mixing.mix_sizes(docs).join(docs.select("doc_id", "source").distinct(), "doc_id").collect()
    for r in out:
        assert r.source_size == size[r.source] and math.isclose(r.target, target[r.source], abs_tol=1e-6)
        assert 0 <= r.taken <= 2 * r.size and r.copies in (0, 1, 2)
    assert {(r.doc_id, r.taken) for r in mixing.mix_sizes(docs).collect()} == {(r.doc_id, r.taken) for r in mixing.mix_sizes(docs.repartition(7)).collect()}


def test_mix_of_one_id_with_several_texts_agrees_in_any_order(spark):
    texts = [" ".join(["w"] * n) + f" {n}" for n in (30, 31, 32, 33, 34, 35, 36, 37, 38)]
    rows = [(i, t, None, "a", 0, None, 0, None) for i in (7, None) for t in texts] + [(9, "x " * 300, None, "b", 0, None, 0, None)]
    taken = lambda r, n: sorted((x.doc_id or -1, x.size, x.taken) for x in mixing.mix_sizes(spark.createDataFrame(r, SCHEMA).repartition(n)).collect())
    first = taken(rows, 1)
    assert first == taken(rows[::-1], 3) == taken(rows[5:] + rows[:5], 5)


def test_mix_emits_once_a_boundary(spark):
    rows = [(i, "w " * 3, None, "a" if i < 900 else "b", 0) for i in range(1000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, copy long").withColumn("copies", F.lit(9))
    sizes = mixing.mix_sizes(d).collect()
    out = mixing.mix(d)
    assert out.columns == ["doc_id", "text", "lang", "source", "copies", "copy"]
    assert out.count() == sum(r.copies for r in sizes)
    by = {}
    for r in sizes:
        key = "a" if r.doc_id < 900 else "b"
        by.setdefault(key, [r.target, 0])[1] += r.taken
    assert all(abs(taken - target) <= 6 for target, taken in by.values())


# 3 decontamination


def brute_contamination(rows, items, window=10):
    patterns = {}
    for i, t in items:
        w = words(t)
        m = min(window, len(w))
        for k in range(len(w) - m + 1 if m else 0):
            patterns.setdefault(tuple(w[k : k + m]), set()).update([] if i is None else [str(i)])
    out = []
    for d, t, *_ in rows:
        w, hit, found = words(t), set(), set()
        for p, ids in patterns.items():
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit.update(range(k, k + len(p)))
                    found |= ids
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [1 << 20, 300])
def test_contamination_is_brute_force(spark, docs, block, monkeypatch):
    rows = corpus()
    w0, w9 = words(rows[0][1]), words(rows[9][1])
    items = [
        (1, " ".join(w0[3:20])), (2, ", ".join(w9[:10]).upper()), (2, "short"), (3, None), (4, ""), (None, " ".join(w9[30:44])),
        (5, " ".join(w0[3:20])), (10, "a b c"), (11, "ö"), (12, " ".join(w0[10:13])), (13, "z"),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate.pattern_blocks, "__defaults__", (block,))
    blocks = decontaminate.pattern_blocks
    monkeypatch.setattr(decontaminate, "pattern_blocks", lambda b, w, _=0: blocks(b, w, block))
    got = sorted((tuple(r) for r in decontaminate.contamination(docs, bench).collect()), key=str)
    assert got == brute_contamination(rows, items)
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns
    clean = [r[0] for r in brute_contamination(rows, items) if not r[5]]
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, clean))


def test_contamination_without_patterns(docs, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in decontaminate.contamination(docs, none).collect()} == {0}


# 4, 5 scores


def junk_corpus(spark):
    rng = random.Random(3)
    rows, marks = [], []
    for i in range(400):
        t = sentence(rng, 60)
        bad, toxic = i % 5 == 0, i % 4 == 0
        if bad:
            t = "!! ".join(x.upper() for x in t.split()) + "!!"
        if toxic:
            t += " " + rng.choice(["vilebad", "nastyone", "awfulzz"]) + " " + sentence(rng, 4) + " vilebad"
        rows.append((i, t, "x", "y", 0, "k", 1, "l"))
        marks.append((i, int(not bad), int(toxic)))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def accuracy(scored, marks, column):
    p = scored.join(marks, "doc_id").filter("held_out").toPandas()
    return (p["predicted"] == p[column]).mean()


def test_quality_on_held_out_rows(spark):
    d, m = junk_corpus(spark)
    out = quality.scores(d, m)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and out.count() == 400
    assert accuracy(out, m, "quality") >= 0.95
    kept = quality.keep_good(d, m)
    assert kept.columns == d.columns and kept.filter("doc_id % 5 <> 0").count() >= 310


def test_best_bin_finds_the_share_of_positives():
    rng = np.random.default_rng(5)
    counts = lambda x: np.bincount((np.clip(x, 0, 1) * (quality.BINS - 1)).astype(int), minlength=quality.BINS).astype(float)
    for prior in (0.2, 0.5, 0.85):
        n = 40_000
        high, low = rng.beta(6, 2, n), rng.beta(2, 6, n)
        mixed = np.where(rng.random(n) < prior, rng.beta(6, 2, n), low)
        assert abs(quality.best_bin(counts(mixed), counts(high[:4000])) - prior) < 0.05
    assert quality.best_bin(np.zeros(quality.BINS), np.zeros(quality.BINS)) == 0.5


def test_prior_without_labels_of_the_other_class(spark):
    docs, marks = junk_corpus(spark)
    only = marks.filter("quality = 1")
    got = quality.scores(docs, only).orderBy("doc_id").collect()
    assert got == quality.scores(docs, marks).orderBy("doc_id").collect()


def test_toxicity_on_held_out_rows(spark):
    d, m = junk_corpus(spark)
    out = toxicity.scores(d, m)
    assert accuracy(out, m, "toxic") >= 0.95
    spans = out.filter("doc_id = 4").first().passages
    text = d.filter("doc_id = 4").first().text.encode()
    assert any(b"vilebad" in text[s.first : s.end] for s in spans)


def test_scores_of_odd_rows(docs, labels, nothing):
    for module in (quality, toxicity):
        out = module.scores(docs, labels).collect()
        assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
        assert module.scores(nothing, labels).count() == 0
        assert {r.score for r in module.scores(docs, labels.limit(0)).collect()} in ({0.5}, {0.0})


def test_maximal_segments_by_definition():
    def brute(v):
        best = max(((sum(v[i:j]), i - j, -i, -j) for i in range(len(v)) for j in range(i + 1, len(v) + 1)), default=(0, 0, 0, 0))
        if best[0] <= 1e-12:
            return []
        i, j = -best[2], -best[3]
        return [(a, b) for a, b in brute(v[:i])] + [(i, j)] + [(a + j, b + j) for a, b in brute(v[j:])]

    rng = random.Random(5)
    for _ in range(200):
        v = [rng.choice([0.5, 1.0, 2.25, -0.75, -0.75, -1.625]) for _ in range(rng.randint(0, 20))]
        at = [i for i, x in enumerate(v) if x > 0]
        got = toxicity.maximal_segments(at, [v[i] for i in at], [sum(v[:i]) for i in at])
        assert [g[:2] for g in got] == brute(v)


def test_passages_weigh_all_certain_words_and_the_constant_is_fitted(spark):
    hashes = toxicity.tx.words(*toxicity.tx.buffers(toxicity.pa.array(["bad nice"])))[4]
    lexicon = toxicity.Lexicon(hashes, np.array([2.0, -3.0]), 1.0, 0.5, 0.1)
    texts = toxicity.pa.array(["bad x bad", "bad nice bad", "x y", None, ""])
    got = [(n, [(a, b, round(s, 9)) for a, b, s in found]) for n, found in lexicon.segments(texts)]
    assert got == [(3, [(0, 9, 3.5)]), (3, [(0, 3, 2.0), (9, 12, 2.0)]), (2, []), (0, []), (0, [])]
    assert [len(p) for _, p in lexicon.passages(texts)] == [1, 2, 0, 0, 0]
    clean = spark.createDataFrame([(t,) for t in texts.to_pylist()], "t string")
    want = 2 / (3 * math.exp(-3.5) + 3 * math.exp(-2.0) + 2 * math.exp(-2.0))
    assert abs(toxicity.extreme_constant(clean, lexicon) - want) < 1e-9
    assert toxicity.extreme_constant(clean.limit(0), lexicon) == 0.1


# 6 tokens


def test_token_counts_are_the_library_s(docs):
    tokenizers = pytest.importorskip("tokenizers")
    P = pytest.importorskip("public_tokenizers")
    path = P.path("byte_bpe_50k.json")
    t = tokenizers.Tokenizer.from_file(path)
    extra = docs.sparkSession.createDataFrame(
        [(900, "<|endoftext|>a<|endoftext|>"), (901, "it's we'll\n\n  x "), (902, "aaaaaaaaab" * 30), (903, "½ ٣ x² 😀")], "doc_id long, text string"
    )
    both = docs.select("doc_id", "text").unionByName(extra)
    out = token_counts.token_counts(both, path)
    want = sorted((r.doc_id or -1, len((r.text or "").encode()), len(t.encode(r.text or "", add_special_tokens=False).ids)) for r in both.collect())
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in out.collect()) == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in out.collect())


# 7 neighbours


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 8)).round(3)
    x[100:140] = x[0]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    rows += [(1000, None, 1), (1001, [0.0] * 8, 1), (1002, [float("nan")] * 8, 1), (1003, [1.0, None] + [0.0] * 6, 1), (None, [1.0] * 8, 1), (1020, [1.0, 2.0], 1), (5, x[5].tolist(), 1)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = {}
    for r in ann.nearest(d, d.filter("vec_id % 20 = 0"), k=20, shard_rows=200).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    found = total = 0
    for q in range(0, 600, 20):
        s = x @ x[q]
        order = [i for i in np.lexsort((np.arange(600), -s)) if i != q][:20]
        assert len(got[q]) == 20 and got[q] == sorted(got[q], key=lambda a: (-a[1], a[0])) and q not in [v for v, _ in got[q]]
        assert all(math.isclose(sc, float(s[v]), abs_tol=1e-12) for v, sc in got[q])
        found += len(set(order) & {v for v, _ in got[q]})
        total += 20
    assert found / total >= 0.9 and set(got) == set(range(0, 600, 20))
    few = ann.nearest(d.filter("vec_id < 4"), d.filter("vec_id = 0"))
    assert few.count() == 3 and ann.nearest(d.limit(0), d.limit(0)).count() == 0


# 8 passages


def test_repeated_passages(spark, docs, nothing):
    rng = random.Random(9)
    passage = " ".join(sentence(rng, 12).capitalize() + "." for _ in range(5))
    rows = [(i, sentence(rng, 30) + ". " + (passage + " " if i in (3, 5, 8) else "") + sentence(rng, 30) + ".", 1) for i in range(10)]
    d = spark.createDataFrame(rows, "doc_id long, text string, digest int")
    got = {r.doc_id: r for r in substring_dedup.repeat_report(d).collect()}
    assert set(got) == {5, 8} and got[5].kept_ids == [3]
    for i in (5, 8):
        text = rows[i][1].encode()
        cut = b" ".join(text[s.first : s.end] for s in got[i].removed).decode()
        assert passage.startswith(cut[:200]) and len(cut) >= 0.7 * len(passage)
        left = substring_dedup.dedup_units(d).filter(F.col("doc_id") == i).first()
        assert hashlib.sha256(left.text.encode()).hexdigest() == got[i].text_sha256
    assert substring_dedup.dedup_units(docs).columns == docs.columns
    out = {r.doc_id: r.text for r in substring_dedup.dedup_units(docs).collect() if r.doc_id is not None}
    assert out[0] == corpus()[0][1] and out[2] == "" and out[60] is None
    assert substring_dedup.repeat_report(nothing).count() == 0
    lines = substring_dedup.repeat_report(docs, lines=True).filter("doc_id = 2").first()
    assert lines.n_removed == 4 and lines.kept_ids == [0]


def test_boundaries_hide_no_passage(spark):
    rng = random.Random(4)
    said = lambda *n, end=".": " ".join(sentence(rng, k).capitalize() + end for k in n)
    cut_in, quoted, stops = said(5, 14), said(9, 12, 11, end='."'), said(8, 9, 10, end="\u3002")
    common = [said(2) for _ in range(12)]
    rows = []
    for i in range(4):  # the passage stands between halves of sentences of its own text
        half = lambda: sentence(rng, 19)
        rows.append((i, f"{half()} word. {cut_in} {sentence(rng, 3)} {quoted} {half()}. {half()}\n{stops} {half()} end."))
    for i in range(4, 10):  # short sentences that all repeat, but never two of them together
        order = common[:]
        rng.shuffle(order)
        rows.append((i, " ".join(f"{x} {said(1)}" for x in order)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in substring_dedup.dedup_units(d, min_words=19).collect()}
    assert all(got[i] == rows[i][1] for i in (0, *range(4, 10)))
    for i in (1, 2, 3):
        assert cut_in not in got[i] and stops not in got[i] and quoted.split('."')[1] not in got[i]


# 9 near duplicates


def test_ngram_groups_are_brute_force(docs, nothing):
    rows = [r for r in corpus() if r[0] is not None]
    sets = [shingles(r[1]) for r in rows]
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    group = {}
    for i, r in enumerate(rows):
        group[find(i)] = min(group.get(find(i), r[0]), r[0])
    want = sorted((r[0], group[find(i)], links[i]) for i, r in enumerate(rows))
    got = sorted(tuple(r) for r in ngram_join.ngram_groups(docs).filter("doc_id is not null").collect())
    assert got == want
    small = sorted(tuple(r) for r in ngram_join.ngram_groups(docs, block=2).filter("doc_id is not null").collect())
    assert small == want
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(group.values()))
    assert ngram_join.ngram_groups(nothing).count() == 0 and ngram_join.keep_one(nothing).count() == 0


def test_large_leaf_in_blocks_is_brute_force(docs):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, (5, 8), dtype=np.int64).view(np.uint64)
    rows = np.repeat(base, 80, 0)
    for i in range(len(rows)):
        for _ in range(6):
            rows[i, rng.integers(8)] ^= np.uint64(1) << np.uint64(rng.integers(64))
    whole = ngram_join.leaf_stars(rows, 460)
    near = ngram_join._agree(rows, rows) >= 460
    assert (whole == ngram_join.local_roots(len(rows), *np.nonzero(near))).all() and len(set(whole.tolist())) == 5
    part = rng.integers(0, 2, len(rows))
    across = ngram_join.leaf_stars(rows, 460, part)
    assert (across == ngram_join.local_roots(len(rows), *np.nonzero(near & (part[:, None] != part[None, :])))).all()
    few = sorted(tuple(r) for r in ngram_join.ngram_groups(docs, leaf=1).filter("doc_id is not null").collect())
    assert few == sorted(tuple(r) for r in ngram_join.ngram_groups(docs).filter("doc_id is not null").collect())


def test_depth_grows_with_the_corpus():
    assert [ngram_join.depth_for(n) for n in (0, 10**6, 4 * 10**6, 10**9)] == [3, 3, 4, 8]


def test_runs_needed_reach_the_recall():
    assert ngram_join.runs_needed(3, 0.995) == 12


def test_components(spark):
    edges = [(1, 2), (3, 2), (10, 11), (11, 12), (12, 13), (13, 14), (20, 20), (2, 1)]
    got = dict(components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, 12: 10, 13: 10, 14: 10}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 10 licences


def test_licenses_and_inheritance(spark):
    files = [
        (1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/c.py", "print(1)"), (3, "a/b/d.py", "x\nLicensed under the Apache License, Version 2.0.\ny"),
        (4, "e/f.py", "nothing"), (5, "a/b/LICENSE", "This work is licensed under the GNU General Public License, version 3."), (6, "a/g.py", None), (7, None, ""),
        (8, "a/b/c/d/h.py", ""), (8, "a/b/c/d/h.py", ""), (9, "ab/x.py", "licence fees went up by a third last year in many towns"),
    ]
    d = spark.createDataFrame(files, "id long, path string, text string").withColumn("own", F.lit(1))
    got = {(r.id): (r.own, r.license, r.inherited_from) for r in licenses.scan(d).collect()}
    assert got[1] == ("MIT", "MIT", None) and got[2] == (None, "GPL-3.0", "a/b") and got[3][0] == "Apache-2.0"
    assert got[4] == (None, None, None) and got[6] == (None, "MIT", "a") and got[7] == (None, None, None)
    assert got[8] == (None, "GPL-3.0", "a/b") and got[9] == (None, None, None)
    assert licenses.scan(d).count() == len(files) and licenses.scan(d.limit(0)).count() == 0


def test_licenses_of_the_root_and_of_mixed_files(spark):
    header = "Released under the MIT License."
    files = [(1, "LICENSE", header), (2, "src/x/y.c", "int main"), (3, "lib/z.c", header + "\n" + sentence(random.Random(1), 40)), (4, "lib/w.c", "other code")]
    got = {r.id: (r.license, r.inherited_from) for r in licenses.scan(spark.createDataFrame(files, "id long, path string, text string")).collect()}
    assert got == {1: ("MIT", None), 2: ("MIT", ""), 3: ("MIT", None), 4: ("MIT", "")}


def owned(spark, texts):
    d = spark.createDataFrame([(i, f"d{i}/f", t) for i, t in enumerate(texts)], "id long, path string, text string")
    d = d.unionByName(spark.range(100, 400).selectExpr("id", "'x/y' path", "concat('some words of no licence by and for all ', id) text"))
    got = {r.id: r.own for r in licenses.scan(d).collect()}
    return [got[i] for i in range(len(texts))]


def test_license_notices_and_bsd_headers(spark):
    bsd = "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."
    texts = [
        "All rights reserved.", "Copyright (c) 2024 X. All rights reserved.", "Copyright 2024 Some Works Ltd, all rights reserved\ncode", bsd,
        f"Copyright 2009 The Authors. All rights reserved.\n{bsd}", "Redistribution and use in source and binary forms, with or without modification, are permitted.",
        "all the rights of the town",
    ]
    assert owned(spark, texts) == ["Proprietary"] * 3 + ["BSD-3-Clause"] * 3 + [None]


def test_each_creative_commons_form_is_its_own(spark):
    forms = {
        "BY": "Attribution", "BY-NC": "Attribution-NonCommercial", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives",
        "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
    }
    short = [f"Licensed under CC {x} 4.0." for x in forms] + [f"Licensed under CC {x} 4.0" for x in forms]
    long = [f"This work is licensed under a Creative Commons {x} 4.0 International License." for x in forms.values()]
    assert owned(spark, short + long) == [f"CC-{x}-4.0" for x in forms] * 3


def test_license_texts_wrapped_headers_and_tags(spark):
    gpl = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
import os"""
    full = {n: forms[-1] for n, forms in licenses.TEMPLATES.items() if len(forms) and len(forms[-1]) > 500}
    holder = "Copyright (c) 2024 Some Works Ltd. All rights reserved.\n\n"
    small = {
        "SPDX-License-Identifier: MIT": "MIT", "// SPDX-License-Identifier: GPL-2.0-or-later\nint x;": "GPL-2.0", "SPDX-License-Identifier: Zlib": None,
        gpl: "GPL-3.0", gpl.replace("version 3", "version 2"): "GPL-2.0", "Licensed under CC BY 3.0.": None,
        " * Licensed under the Apache License,\n * Version 2.0 (the \"License\");\n": "Apache-2.0",
    }
    assert {"MIT", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "Apache-2.0"} <= set(full)
    got = owned(spark, [holder + t for t in full.values()] + list(small))
    assert got == list(full) + list(small.values())
    # a full text passes its licence on, whatever its path is
    rows = [(1, "p/1", holder + full["MIT"]), (2, "p/q/2", "nothing"), (3, "r/3", gpl + "\nx = 1" * 50), (4, "r/4", "nothing")]
    d = spark.createDataFrame(rows, "id long, path string, text string")
    assert {r.id: r.license for r in licenses.scan(d).collect()} == {1: "MIT", 2: "MIT", 3: "GPL-3.0", 4: None}


# all of them on nothing


def test_empty_tables(nothing, spark, labels):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert line_dedup.line_report(nothing).count() == 0 and line_dedup.dedup_lines(nothing).count() == 0
    assert mixing.mix_sizes(nothing).count() == 0 and mixing.mix(nothing).count() == 0
    assert decontaminate.contamination(nothing, bench).count() == 0
    assert quality.keep_good(nothing, labels).count() == 0
