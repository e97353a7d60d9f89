"""Trained operators: held-out accuracy, brute-force twins, edge rows; and the pipeline."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from mercato.llm import decontaminate, html_extract, quality, toxicity
from mercato.llm.common import load, word_count
from mercato.llm.html_pages import labelled_pages

SF = "/root/testdata/sf0.01"


def slow_segments(scores):
    """Maximal segments by definition: the best segment, then the same on both sides of it."""
    best = max(((sum(scores[a:b]), -(b - a), -a, (a, b)) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=None)
    if best is None or best[0] <= 0:
        return []
    a, b = best[3]
    left, right = slow_segments(scores[:a]), slow_segments(scores[b:])
    return [*left, (a, b, best[0]), *[(x + b, y + b, s) for x, y, s in right]]


@pytest.mark.parametrize("seed", range(30))
def test_segments_equal_the_definition(seed):
    rng = random.Random(seed)
    scores = [rng.choice([-2.13, -0.51, 1.07, 3.29]) * rng.uniform(0.9, 1.1) for _ in range(rng.randint(0, 28))]
    got = sorted((a, b) for a, b, _ in toxicity.segments(np.array(scores)))
    assert got == sorted((a, b) for a, b, _ in slow_segments(scores))


def auc(y, s):
    pos, neg = [b for a, b in zip(y, s, strict=True) if a], [b for a, b in zip(y, s, strict=True) if not a]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize(("query", "label", "least"), [(toxicity.op7_toxicity, "toxic", 0.75), (quality.op8_quality, "quality", 0.9)])
def test_held_out_accuracy(spark, query, label, least):
    rows = query(spark, SF).join(load(spark, SF, "labels"), "doc_id").where("held_out").select(label, "score", "predicted").collect()
    y = [r[label] for r in rows]
    assert auc(y, [r.score for r in rows]) > least
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    assert sum(r.predicted == r[label] for r in rows) > 0.85 * len(rows)


def test_toxic_passages_in_long_texts(spark):
    rng = random.Random(1)
    plain = [f"w{k}" for k in range(300)]
    say = lambda n: " ".join(rng.choice(plain) for _ in range(n))
    docs = [(k, say(80) + (" vile nasty foul vile " if k % 4 == 0 else " ") + say(80), "d") for k in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(400)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels)
    long = say(20_000) + " nasty, VILE! foul " + say(20_000)
    test = spark.createDataFrame([(1, long), (2, say(20_000)), (3, ""), (4, None), (4, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score(test, model).collect()}
    assert got[1].score > 0.5 > got[2].score and got[3].score == got[4].score < 0.3
    assert [(p.start, p.end) for p in got[1].passages] == [(20_000, 20_003)] and not got[2].passages
    kept = toxicity.drop_toxic(df, labels)
    assert kept.columns == df.columns and {r.doc_id % 4 for r in kept.collect()} == {1, 2, 3}
    assert toxicity.score(test.where("false"), model).count() == 0
    none = toxicity.fit(df, labels.where("false"))
    assert all(r.score < 0.01 for r in toxicity.score(test, none).collect())


def test_quality_tables():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 3))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (x[:, 2] > 1.5)).astype(float)
    model = quality.train(x, y)
    z = rng.normal(size=(2000, 3))
    want = (z[:, 0] * z[:, 1] > 0) ^ (z[:, 2] > 1.5)
    assert ((model.predict(z) > 0.5) == want).mean() > 0.9
    assert quality.train(x[:0], y[:0]).predict(z).tolist() == [0.5] * 2000
    assert (quality.train(x, np.ones(3000)).predict(z) > 0.99).all()


def test_quality_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, 2), (2, "", 2), (3, "word " * 200_000, 2), (3, "퟿ é ß", 2)], "doc_id long, text string, n int")
    model = quality.fit(load(spark, SF, "documents"), load(spark, SF, "labels"))
    got = quality.score(docs, model).collect()
    assert len(got) == 4 and got[0].score == got[1].score and all(0 <= r.score <= 1 for r in got)
    assert quality.score(docs.where("false"), model).count() == 0


def test_pages_of_the_grammar_are_read_back():
    model, pages = html_extract.default_model(), labelled_pages(150, seed=77)
    good = sum(html_extract.main_text(p, model) == "\n".join(html_extract.SPACE.sub(" ", m).strip() for m in main) for p, main in pages)
    assert good >= 0.93 * len(pages)


def test_viterbi_is_the_best_labelling():
    model, rng = html_extract.default_model(), random.Random(3)
    for page, _ in labelled_pages(40, seed=5):
        blocks = html_extract.leaf_blocks(page)[: rng.randint(1, 9)]
        emit = [sum(map(model._weight, f)) for f in model.features(blocks)]

        def total(y, emit=emit):
            s = model.start[y[0]] + model.end[y[-1]] + sum(e for e, k in zip(emit, y, strict=True) if k)
            return s + sum(model.moves[a][b] for a, b in zip(y, y[1:], strict=False))

        every = [[k >> i & 1 for i in range(len(blocks))] for k in range(1 << len(blocks))]
        assert total(model.decode(blocks)) == pytest.approx(max(map(total, every)))


def test_extraction_edge_rows(spark):
    page = "<html><head><title>t</title><script>if (a<b) '</p>'</script></head><body><nav><a href=/x>Menu</a></nav><article><h1>T&amp;C</h1><p>One &lt;two&gt;\n three &eacute; and a few words more of this text<p>Two&nbsp;two, also with quite a few words.<div class=ad>buy now</div></article><footer>&copy; x</footer>"
    rows = [(1, "u", page, "old"), (1, "u", page, "old"), (2, None, None, "old"), (None, "v", "", "old"), (3, "w", "<p>" + "word " * 100_000, "old"), (4, "w", "<<<p 'x", "old")]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    text = "T&C\nOne <two> three é and a few words more of this text\nTwo two, also with quite a few words."
    assert [r.text for r in got[:4]] == [text, text, "", ""] and [r.n_chars for r in got[:4]] == [len(text), len(text), 0, 0]
    assert len(got) == 6


def slow_alignment(p, q):
    h, best = [[0] * (len(q) + 1) for _ in range(len(p) + 1)], 0
    for i in range(1, len(p) + 1):
        for j in range(1, len(q) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if p[i - 1] == q[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def test_alignment():
    rng = random.Random(9)
    pairs = [([rng.choice(b"abcde") for _ in range(rng.randint(0, 30))], [rng.choice(b"abcde") for _ in range(rng.randint(1, 20))]) for _ in range(60)]
    join = lambda x: b" ".join(bytes([c]) for c in x)
    got = decontaminate.align([join(p) for p, _ in pairs], [join(q) for _, q in pairs])
    assert got.tolist() == [slow_alignment(p, q) for p, q in pairs]


def test_edited_and_exact_leaks(spark):
    rng = random.Random(10)
    vocabulary = [f"v{k}" for k in range(400)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [say(n) for n in (30, 45, 60, 20, 3)]
    edit = lambda x: [rng.choice(vocabulary) if rng.random() < 0.15 else w for w in x if rng.random() > 0.03]
    leaks = [(k, " ".join([*say(200), *(items[k % 4] if k % 2 else edit(items[k % 4])), *say(100)]).upper()) for k in range(40)]
    clean = [(100 + k, " ".join(say(400))) for k in range(40)]
    docs = spark.createDataFrame([(*r, "z") for r in [*leaks, *clean, (200, None), (201, ""), (None, leaks[1][1]), (1, leaks[1][1]), (300, " ".join(say(30_000) + items[2]))]], "doc_id long, text string, digest string")
    bench = spark.createDataFrame([(i, " ".join(x) + ".") for i, x in enumerate(items)] + [(50, None), (51, ""), (None, "a b c d")], "item_id long, text string")
    got = Counter((r.doc_id, r.contaminated, r.item_id if r.contaminated else None) for r in decontaminate.judge(docs, bench).collect())
    want = Counter([(k, True, k % 4) for k in range(40)] + [(100 + k, False, None) for k in range(40)] + [(200, False, None), (201, False, None), (None, True, 1), (1, True, 1), (300, True, 2)])
    assert got == want
    kept = decontaminate.drop_leaks(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {200, 201, *range(100, 140)}
    assert decontaminate.judge(docs, bench.where("false")).where("contaminated").count() == 0
    assert decontaminate.judge(docs.where("false"), bench).count() == 0


def test_op10_equals_brute_force(spark):
    """Documents that hold an item's words in a row are exactly those with a full score."""
    docs, bench = load(spark, SF, "documents").toPandas(), load(spark, SF, "benchmark").toPandas()
    normal = lambda t: b" " + b" ".join(toxicity.tokens(t)) + b" "
    items = [normal(t) for t in bench.text]
    want = {i for i, t in zip(docs.doc_id, docs.text, strict=True) if any(x in normal(t) for x in items)}
    got = decontaminate.op10_decontaminate(spark, SF).collect()
    assert len(got) == len(docs) and {r.doc_id for r in got if r.score == 1.0} == want


@pytest.mark.parametrize("copies", [1, 40])
def test_no_edited_leak_is_missed(spark, copies):
    """All documents against all items by Smith-Waterman; words are replaced, put in or left out every few words."""
    rng = random.Random(11)
    vocabulary = [f"v{int(400 * rng.random() ** 3)}" for _ in range(2000)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [[f"own{i}x{k}" if rng.random() < 0.5 else rng.choice(vocabulary) for k in range(n)] for i, n in enumerate((15, 24, 38, 59))]
    docs = []
    for x in items:
        for every in (1, 2, 3, 4, 5, 6, 7):
            replaced = [f"new{k}" if k % every == every - 1 else w for k, w in enumerate(x)]
            longer = [y for k, w in enumerate(x) for y in ([w, f"new{k}"] if k % every == every - 1 else [w])]
            shorter = [w for k, w in enumerate(x) if k % every != every - 1]
            docs += [[*say(60), *y, *say(40)] for y in (replaced, longer, shorter)]
    rows = [(k, " ".join(d)) for k, d in enumerate(docs) for _ in range(copies)]
    best = {k: max(decontaminate.align([" ".join(d).encode()], [" ".join(x).encode()])[0] / (2 * len(x)) for x in items) for k, d in enumerate(docs)}
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    for threshold in (0.4, 0.5, 0.75):
        got = decontaminate.judge(spark.createDataFrame(rows, "doc_id long, text string"), bench, threshold).collect()
        assert len(got) == len(rows)
        assert {r.doc_id for r in got if r.contaminated} == {k for k, v in best.items() if v >= threshold}
        assert all(r.score == best[r.doc_id] for r in got if r.contaminated)


def test_near_copies_of_the_pipeline(spark):
    """The stage keeps what brute force over 5-word shingles keeps; chains, exact copies and a large group among them."""
    rng = random.Random(12)
    base = [[f"w{rng.randrange(300)}" for _ in range(n)] for n in (20, 60, 200, 400)]
    texts = [None, "", "one two", "One  two", "other words here"]
    for x in base:
        for rate in (0, 0.003, 0.01, 0.02, 0.03, 0.05):
            texts += [" ".join(rng.choice(("new", "else")) + str(k) if rng.random() < rate else w for k, w in enumerate(x)) for _ in range(8)]
    for k in range(30):  # each is like the one before
        base[2][5 * k] = f"step{k}"
        texts.append(" ".join(base[2]))
    words = [(t or "").lower().split() for t in texts]
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset() for w in words]
    root = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            if (len(a & sets[j]) >= 0.8 * len(a | sets[j])) and root[i] != root[j]:
                new, old = sorted((root[i], root[j]))
                root = [new if r == old else r for r in root]
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)] + [(None, texts[-1], "en")], "doc_id long, text string, lang string")
    kept = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(set(root))
    assert kept.where("doc_id is null").count() == 1
    assert corpus_pipeline.drop_near_copies(spark, docs.where("false"), SF).count() == 0


def test_pipeline(spark):
    docs = load(spark, SF, "documents")
    columns, before = docs.columns, {r.doc_id: r for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = spark.createDataFrame(stage(spark, docs, SF).toPandas())
        ids = [r.doc_id for r in after.select("doc_id").collect()]
        assert set(ids) <= set(before)
        if k < 4:
            assert after.columns == columns and len(ids) == len(set(ids))
        if name == "toxicity":
            toxic = {i for i, r in before.items() if {b"idiot", b"scum", b"moron"} <= set(toxicity.tokens(r.text))}
            assert not toxic & set(ids) and len(ids) > 0.85 * len(before)
        if name == "substring dedup":
            assert len(ids) == docs.count()
        docs = after
    assert docs.where(word_count(F.col("text")) != F.col("taken")).count() == 0
    again = {tuple(r) for r in corpus_pipeline.run(spark, SF).select("doc_id", "copy", "taken", "shard", "place").collect()}
    assert again == {tuple(r) for r in docs.select("doc_id", "copy", "taken", "shard", "place").collect()}
