"""Clusters against their definitions, set selection rules, and the entry without the training-data folder."""

import math
import random
import re
import shutil
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from mercato.functions import normalize, text
from mercato.operators import curation, graph, optimize, similarity

REPO = Path(__file__).resolve().parent.parent


def test_entry_without_the_training_data_folders(tmp_path):
    """Queries and SQL can be listed when mercato/llm is gone, even though corpus_pipeline.py is still there."""
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (REPO / name).exists():
            shutil.copy(REPO / name, tmp_path)
    shutil.copytree(REPO / "mercato", tmp_path / "mercato", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'facets' in q and 'pipeline' not in q and set(o) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def greedy_by_definition(names, threshold):
    bags = [Counter(w for w in re.findall(similarity.TERM, n.lower()) if len(w) > 2 and w not in similarity.TERM_STOP) for n in names]
    df = Counter(w for b in bags for w in b)
    vec = [{w: c / b.total() * (math.log((len(names) + 1) / (df[w] + 1)) + 1) for w, c in b.items()} for b in bags]
    cos = lambda a, b: sum(x * b.get(w, 0) for w, x in a.items()) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values())) if a and b else 0.0
    members, out = [], []
    for v in vec:
        means = [{w: sum(m.get(w, 0) for m in ms) / len(ms) for w in set().union(*ms)} for ms in members]
        best = max(range(len(means)), key=lambda k: (round(cos(v, means[k]), 12), -k), default=-1)
        if best < 0 or cos(v, means[best]) <= threshold:
            members.append([v])
            best = len(members) - 1
        else:
            members[best].append(v)
        out.append(best)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_greedy_clusters(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(25)]
    names = [" ".join(rng.choices(words, k=rng.randint(0, 5))) for _ in range(90)] + ["", "el la"]
    for threshold in (0.28, 0.6):
        assert similarity.greedy_clusters(names, threshold) == greedy_by_definition(names, threshold)


def test_linked_clusters_follow_long_chains(spark):
    """A chain of 130 names, each like the next only, is one cluster; equal names are one node; names without terms stand alone."""
    letter = lambda k: "".join(chr(97 + int(d)) for d in f"{k:04d}")
    chain = [f"{letter(k)} {letter(k + 1)}" for k in range(130)]
    rows = [(k, n) for k, n in enumerate(chain)] + [(500 + k, chain[-1]) for k in range(40)] + [(900, "zzzz yyyy"), (901, ""), (902, None)]
    docs = spark.createDataFrame(rows, "seq long, name string")
    got = {r.seq: r.cluster for r in similarity.linked_clusters(docs, "seq", "name").collect()}
    assert len(got) == len(rows) and {got[k] for k in [*range(130), *range(500, 540)]} == {0}
    assert [got[k] for k in (900, 901, 902)] == [900, 901, 902]


@pytest.mark.parametrize("seed", range(3))
def test_cosine_pairs_are_all_pairs(spark, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(12)]  # every term is common
    names = [" ".join(rng.choices(words, k=rng.randint(1, 6))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(names)), "seq long, name string")
    weights = {}
    for r in similarity.tf_idf(docs, "seq", "name").collect():
        weights.setdefault(r.seq, {})[r.term] = r.weight
    norm = {k: math.sqrt(sum(x * x for x in v.values())) for k, v in weights.items()}
    cos = {(a, b): sum(x * weights[b].get(t, 0) for t, x in weights[a].items()) / norm[a] / norm[b] for a in weights for b in weights if a < b}
    got = {(r.left, r.right) for r in similarity.cosine_pairs(docs, "seq", "name", 0.5).collect()}
    assert {p for p, c in cos.items() if c > 0.5 + 1e-9} <= got <= {p for p, c in cos.items() if c > 0.5 - 1e-9}


def test_components(spark):
    edges = [(k, k + 1) for k in range(200)] + [(300, 301), (None, 5), (7, None), (8, 8)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**dict.fromkeys(range(201), 0), 300: 300, 301: 300}
    assert graph.components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_too_many_prototypes(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id long, embedding array<float>")
    many = spark.range(similarity.PROTOTYPES + 1).select(F.col("id").alias("label"), F.array(F.lit(1.0), F.lit(2.0)).alias("vector"))
    with pytest.raises(ValueError, match="prototypes"):
        similarity.against_prototypes(vectors, many)


def test_only_the_same_extreme_fit_on_torso_and_legs_clashes():
    item = lambda slot, fit: optimize.Candidate(slot, "u", 1.0, 1.0, fit)
    assert optimize.coherence(item("torso_top", "oversize"), [item("piernas", "oversize")]) == 0.7
    assert optimize.coherence(item("torso_top", "entallado"), [item("piernas", "entallado")]) == 0.7
    assert optimize.coherence(item("torso_top", "slim"), [item("piernas", "slim")]) == 1.0
    assert optimize.coherence(item("calzado", "oversize"), [item("piernas", "oversize")]) == 1.0
    assert optimize.coherence(item("torso_top", "oversize"), [item("piernas", "entallado")]) == 1.0


def test_of_equal_sets_the_emptier_and_earlier_wins():
    cs = [optimize.Candidate("a", "a0", 5.0, 3.0), optimize.Candidate("a", "a1", 5.0, 3.0), optimize.Candidate("b", "b0", 5.0, 3.0), optimize.Candidate("c", "c0", 1.0, 0.0)]
    assert [c.url for c in optimize.best_set(cs, 100.0)] == ["a0", "b0"]
    assert [c.url for c in optimize.best_set(cs, 5.0)] == ["b0"]
    assert optimize.best_set([], 5.0) == []


def test_labels_of_one_bag_of_words_are_one(spark):
    rows = [(0, "red hat")] * 3 + [(1, "hat red")] * 2 + [(2, "Hat!")]
    found = curation.cluster_labels(spark.createDataFrame(rows, "cluster int, name string"))
    assert found == [(0, "Red", 3), (1, "Hat", 2)]


def test_query_cleaning_and_gender(spark):
    rows = [("Remera Negra de mujer talle M nuevo 12345678 (oferta)",), ("remera female",), ("Female top",)]
    df = spark.createDataFrame(rows, "n string")
    assert df.select(text.search_query(F.col("n"))).first()[0] == "Remera oferta"
    got = [r[0] for r in df.select(normalize.gender(F.lit(""), F.col("n"), F.lit("Otros"))).collect()]
    assert got == ["mujer", "hombre", "hombre"]
