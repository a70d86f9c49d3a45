"""Line dedup against all pairs of lines."""

import pytest

from cohortlake.llm import lines
from tests.llm.helpers import odd_texts, prose, table


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    a, b = sorted((a, b), key=len)
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i:] == b[i + 1 :]


def brute(texts, min_chars):
    first = {}
    for i, t in enumerate(texts):
        for k, x in enumerate((t or "").split("\n")):
            if x and not x.isspace():
                first.setdefault(x, (i, k))
    gone = {a for a in first for b in first if min(len(a), len(b)) >= min_chars and first[b] < first[a] and near(a, b)}
    out = []
    for i, t in enumerate(texts):
        kept, n_exact, n_near = [], 0, 0
        for k, x in enumerate((t or "").split("\n")):
            copy = x in first and first[x] != (i, k)
            n_exact, n_near = n_exact + copy, n_near + (not copy and x in gone)
            if not copy and x not in gone:
                kept.append(x)
        out.append((n_exact, n_near, "\n".join(kept) if t else t))
    return out


def corpus():
    line = "The quick brown fox jumps over the lazy dog."
    variants = [line[:k] + "#" + line[k + 1 :] for k in (0, 20, len(line) - 1)] + [line[:k] + line[k + 1 :] for k in (0, 21, len(line) - 1)] + [line[:k] + "é" + line[k:] for k in (0, 22, len(line))]
    two = "Thx quick brown fox jumps over the lazy cog."
    docs = [f"{prose(s, 12)}\n{v}\n\n{prose(s + 1, 9)}" for s, v in enumerate([line, *variants, two])]
    return [*odd_texts(), *docs, "short\nshort\nshorf", "a\n\n\na\n", f"{line}\n{line}", "aaaaaaaaaaaaaaaaaaaaaaaaa\naaaaaaaaaaaaaaaaaaaaaaaa", prose(5, 4000).replace(" w1", "\nw1")]


@pytest.mark.parametrize("min_chars", [0, 20])
def test_lines(spark, min_chars):
    texts = corpus()
    got = {r["doc_id"]: (r["__n_exact"], r["__n_near"], r["text"]) for r in lines.line_dedup(table(spark, texts), min_chars).collect()}
    for i, expected in enumerate(brute(texts, min_chars)):
        assert got[i] == expected, texts[i]


def test_names_that_clash_and_rows_without_or_with_equal_ids(spark):
    rows = [(None, "first line of all", 1, 2, "d"), (None, "other\nfirst line of bll", 1, 2, "d"), (7, "x y z w v", 1, 2, "d"), (7, "q r s t u", 1, 2, "d"), (9, "x y z w w\nq r s t u", 1, 2, "d"), (9, "x y z w w\nq r s t u", 1, 2, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_exact long, n_near long, drops string")
    out = sorted((r["doc_id"] or 0, r["text"], r["__n_exact"], r["__n_near"], r["n_exact"], r["drops"]) for r in lines.line_dedup(docs).collect())
    assert out == [(0, "first line of all", 0, 0, 1, "d"), (0, "other", 0, 1, 1, "d"), (7, "q r s t u", 0, 0, 1, "d"), (7, "x y z w v", 0, 0, 1, "d"), (9, "", 1, 1, 1, "d"), (9, "", 1, 1, 1, "d")]


def test_long_texts_are_hashed_in_parts(monkeypatch):
    import pyarrow as pa

    text = "\n".join(prose(s, 10) for s in range(100))
    batch = pa.record_batch([pa.array([1]), pa.array([2]), pa.array([text])], names=["row", "doc_id", "text"])
    whole = pa.Table.from_batches(list(lines._lines(0)([batch])))
    monkeypatch.setattr(lines, "CHUNK_BYTES", 300)
    parts = list(lines._lines(0)([batch]))
    assert len(parts) > 10 and pa.Table.from_batches(parts).to_pylist() == whole.to_pylist()


def test_stage_keeps_columns_and_drops_emptied(spark):
    docs = table(spark, ["one line that is long enough", "one line that is long enough", "", None, "fresh line here\none line that is long enough"])
    out = {r["doc_id"]: r for r in lines.keep_first_lines(docs).collect()}
    assert lines.keep_first_lines(docs).columns == docs.columns
    assert set(out) == {0, 2, 3, 4}
    assert (out[4]["text"], out[4]["n_chars"]) == ("fresh line here", 15)


def test_empty_and_repeated(spark):
    assert lines.line_dedup(table(spark, [])).count() == 0
    assert lines.line_dedup(table(spark, ["x y z", "x y z", None], [1, 1, None])).count() == 3
