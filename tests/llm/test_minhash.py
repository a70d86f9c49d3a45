"""Near-duplicate components against all pairs of full sets."""

from cohortlake.llm import minhash
from tests.llm.helpers import WORDS, edited, lower, odd_texts, prose, table


def shingles(text):
    w = WORDS.findall(lower(text))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(texts):
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return [(len(s), root(i)) for i, s in enumerate(sets)]


def corpus():
    base = [prose(s, 120) for s in range(6)]
    chain = [prose(50, 100)]
    for s in range(5):
        chain.append(edited(chain[-1], s, 2))
    hot = [edited(base[0], 100 + s, 1) for s in range(40)]  # one large group of near copies
    shared = prose(77, 40)
    strays = [shared + " " + prose(200 + s, 20) for s in range(40)]  # one passage, but no links
    return [*odd_texts(), *base, *base[:3], *chain, *hot, *strays, *[edited(base[1], s, k) for k, s in ((1, 1), (3, 2), (6, 3), (9, 4))]]


def test_components(spark):
    texts = corpus()
    got = {r["doc_id"]: r for r in minhash.near_duplicates(table(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, (n, root) in enumerate(brute(texts)):
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (n, root, root == i), texts[i]


def test_one_of_each_stays(spark):
    texts = corpus()
    docs = table(spark, texts)
    kept = minhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i, (_, root) in enumerate(brute(texts)) if root == i]


def test_empty_table(spark):
    assert minhash.near_duplicates(table(spark, [])).count() == 0


def test_rows_without_id(spark):
    text = prose(9, 30)
    got = minhash.near_duplicates(table(spark, [text, text, text, ""], [None, 5, 7, None])).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in got) == [(-1, -1, True), (-1, -1, True), (5, 5, True), (7, 5, False)]
