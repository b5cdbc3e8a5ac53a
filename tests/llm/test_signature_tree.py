import random

import brute
import numpy as np
import pytest

from cuesheet.llm import jaccard_join, minhash, signature_tree
from test_operators import BASE, SCHEMA, appended, documents, near, replaced, say


def tree_of(rows, size=2):
    return signature_tree.tree_of([(i, i, minhash.shingle_set(t, size, minhash._WordHashes())) for i, t in rows])


def merged(ids, links):
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        p, q = sorted((root(a), root(b)))
        up[q] = p
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("seed", range(6))
def test_traversal_joins_what_is_linked(seed):
    rng = random.Random(seed)
    rows = [(i, near(BASE, rng.randint(0, 12)) if rng.random() < 0.6 else say(rng.randint(1, 60))) for i in range(rng.choice([1, 5, 70, 130]))]
    tree = tree_of(rows)
    links, _ = signature_tree.traverse(tree, tree, 80)
    assert merged(dict(rows), links) == {i: c for i, (_, c) in brute.near_duplicates(rows).items()}


def test_two_trees_of_unequal_heights_and_widths():
    left, right = [(i, near(BASE, 6)) for i in range(40)] + [(90, say(900))], [(100, BASE), (101, say(7))]
    links, _ = signature_tree.traverse(tree_of(left), tree_of(right), 80)
    alone = {tuple(sorted(x)) for x in links}
    sets = {i: minhash.shingle_set(t, 2, minhash._WordHashes()) for i, t in left + right}
    want = {(a, b) for a, _ in left for b, _ in right if signature_tree.similar(sets[a], sets[b], 80)}
    assert alone == want and want


@pytest.mark.parametrize("group", [appended, replaced])
def test_few_pairs_of_sets_are_compared_under_the_threshold(group):
    """Of pairs at 0.76 to 0.79 the signatures leave less than one in fifty, and joined ones are not compared again."""
    for n in (150, 300):
        tree = tree_of(group(n))
        assert signature_tree.traverse(tree, tree, 80)[1] < n * (n - 1) / 2 / 50


def test_similar_is_exact():
    rng = np.random.default_rng(1)
    for _ in range(500):
        x, y = (np.unique(rng.integers(0, 40, rng.integers(1, 40)).astype(np.uint64)) for _ in range(2))
        n = len(np.intersect1d(x, y))
        assert signature_tree.similar(x, y, 80) == (100 * n >= 80 * (len(x) + len(y) - n))


def components(spark, rows, **how):
    got = jaccard_join.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), **how).collect()
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got}


def test_join_of_odd_rows_equals_brute_force(spark):
    """Nulls, empty and very long texts, repeated rows, columns of clashing names, a null id."""
    docs = spark.createDataFrame(documents(), SCHEMA).repartition(3)
    got = jaccard_join.similar_documents(docs.filter("doc_id is not null"), size=2).collect()
    want = brute.near_duplicates([r[:2] for r in documents() if r[0] is not None])
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want and len(got) == len(documents()) - 1
    whole = jaccard_join.similar_documents(docs, size=2).collect()
    assert len(whole) == len(documents()) and [r["component_id"] for r in whole if r["doc_id"] is None] == [None]


def test_dense_groups_equal_brute_force(spark):
    """Near copies, two groups just under the threshold, unlike texts with a common passage, and others, all at once."""
    passage = say(60)
    groups = [appended(150), replaced(150), [(0, near(BASE, 3)) for _ in range(150)], [(0, f"{passage} {say(90)}") for _ in range(150)], [(0, passage), (0, passage.upper())], [(0, say(80)) for _ in range(40)]]
    rows = [(i, t) for i, t in enumerate(t for g in groups for _, t in g)]
    assert components(spark, rows, size=2) == brute.near_duplicates(rows, size=2)


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.similar_documents(none).collect() == []
