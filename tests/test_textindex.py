"""The stored index against searches that read all documents, and what is rejected."""

import pytest
from pyspark.sql import functions as F

from tessera.errors import CommandError
from tessera.operators import search, vectors
from tessera.operators.textindex import TextIndex

ROWS = [(1, "red apple pie", "fruit"), (2, "apple apple tart", "fruit"), (3, "green tea 中文搜索", "drink"), (4, "black tea", "drink"), (5, "", None)]


@pytest.fixture()
def docs(spark):
    return spark.createDataFrame([(i, t, s, [float(i), 1.0]) for i, t, s in ROWS], "doc_id long, title string, kind string, v array<double>")


def found(df):
    return [(r["doc"], round(r["score"], 9)) for r in df.collect()]


def test_search_equals_reading_all(spark, docs, tmp_path):
    index = TextIndex.create(spark, str(tmp_path / "i"), ["title", "kind"], "v")
    index.add(docs.filter("doc_id <> 4"))
    index.add(docs.filter("doc_id = 4"))
    for text in ("apple", "@title:tea drink", "搜索", "中文", "搜", "*", "nothing", "", "tea tea apple"):
        for mode in ("any", "all"):
            assert found(index.search(text, mode=mode)) == found(search.text_search(docs, ["title", "kind"], text, mode=mode)), text
    assert [d for d, _ in found(index.search("搜索"))] == [3] and found(index.search("搜")) == []
    replaced = spark.createDataFrame([(2, "plum", "fruit", [9.0, 9.0])], docs.schema)
    index.add(replaced)
    index.delete(docs.filter("doc_id = 1").select("doc_id"))
    now = docs.filter("doc_id not in (1, 2)").unionByName(replaced)
    again = TextIndex(spark, str(tmp_path / "i"))
    for text in ("apple", "plum", "fruit tea"):
        assert found(again.search(text)) == found(search.text_search(now, ["title", "kind"], text))
    assert [r["doc"] for r in again.search("tea", withscores=False, nocontent=False, contents=now).orderBy("doc").collect()] == [3, 4]
    assert again.info().first().asDict()["num_docs"] == 4
    with pytest.raises(CommandError):
        TextIndex.create(spark, str(tmp_path / "i"), ["title"])
    with pytest.raises(CommandError):
        index.search("@nope:x")
    index.drop()
    with pytest.raises(CommandError):
        TextIndex(spark, str(tmp_path / "i"))


def test_vectors_go_to_partitions(spark, tmp_path):
    rows = [(i, f"n{i % 3}", [float(i % 4) * 10, float(i)]) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, title string, v array<double>")
    index = TextIndex.create(spark, str(tmp_path / "i"), ["title"], "v")
    index.add(docs.filter("doc_id < 30"))
    near = lambda df: [(r["doc"], round(r["dist"], 9)) for r in df.collect()]
    assert near(index.knn([3.0, 7.0], 5)) == [(r["doc_id"], round(r["dist"], 9)) for r in vectors.knn(docs.filter("doc_id < 30"), [3.0, 7.0], 5, "doc_id", "v").collect()]
    index.build(k=4, iterations=5, seed=1)
    index.add(docs.filter("doc_id >= 30"))
    index.delete(docs.filter("doc_id = 7").select("doc_id"))
    left = docs.filter("doc_id <> 7")
    want = [(r["doc_id"], round(r["dist"], 9)) for r in vectors.knn(left, [3.0, 7.0], 6, "doc_id", "v").collect()]
    assert near(index.knn([3.0, 7.0], 6, nprobe=4)) == near(index.knn([3.0, 7.0], 6)) == want
    some = index.knn([3.0, 7.0], 40, nprobe=1)
    assert 0 < some.count() < 39 and {d for d, _ in near(some)} < set(range(40))
    assert [d for d, _ in near(index.search("n1", knn=(3, [3.0, 7.0])))] == [r["doc_id"] for r in vectors.knn(left.filter("title = 'n1'"), [3.0, 7.0], 3, "doc_id", "v").collect()]
    for n in range(9):
        index.add(docs.filter(f"doc_id = {n}"))  # merges
    assert len(index._entry()["deltas"]) <= 8 and index.info().first()["num_docs"] == 40


def test_seeds_of_kmeans_follow_the_draws():
    """The first seed and the weighted second one by hand: of points 0, 3 and 7 on a line."""
    draw = lambda n: [d.next() for _ in range(n)] if (d := vectors._Draws(7)) else None
    one, two = draw(2)
    points = [0.0, 3.0, 7.0]
    first = one % 3
    weights = [0 if i == first else int((points[first] - x) ** 2) for i, x in enumerate(points)]
    at = two % sum(weights)
    second = next(i for i in range(3) if at < sum(weights[: i + 1]))
    rest = ({0, 1, 2} - {first, second}).pop()
    near = min((first, second), key=lambda i: abs(points[i] - points[rest]))
    want = {i: points[i] for i in (first, second)}
    want[near] = (points[near] + points[rest]) / 2
    got = vectors.kmeans([[x] for x in points], 2, 1, 7)
    assert [float(c[0]) for c in got] == [want[first], want[second]]


def test_all_postings_are_read_by_document(spark, tmp_path):
    rows = [(1, "Red apple, RED pie", "fruit"), (2, "中文搜索 tea 茶 İstanbul Straße x²", None), (3, "", ""), (4, "ab_c d-e ﬁ ١٢ é", "a a")]
    docs = spark.createDataFrame(rows, "doc_id long, title string, kind string")
    fields = ["title", "kind"]
    counted = search.words(docs, fields)
    every = lambda df: sorted(map(tuple, df.select("doc", "field", "term", "tf").collect()))
    assert every(search.of_words(counted)) == every(search.postings(docs, fields))
    assert sorted(map(tuple, counted.select("doc", "doclen").collect())) == sorted(map(tuple, search.doc_lengths(docs, fields).collect()))
    index = TextIndex.create(spark, str(tmp_path / "i"), fields)
    index.add(docs)
    index.add(docs.filter("doc_id = 2").withColumn("title", F.lit("plum")))
    index.delete(docs.filter("doc_id = 4").select("doc_id"))
    now = docs.filter("doc_id <> 4").withColumn("title", F.when(F.col("doc_id") == 2, "plum").otherwise(F.col("title")))
    read = index.postings()
    assert every(read) == every(search.postings(now, fields))
    assert read.inputFiles() and all("/docs/" in f for f in read.inputFiles())  # no row a posting before the documents are known
    index._merge(None)
    assert every(index.postings()) == every(index._postings({**index._entry(), "words": False})) == every(search.postings(now, fields))


def test_an_addition_splits_each_text_once(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame(ROWS[:3], "doc_id long, title string, kind string")
    want = search.doc_lengths(docs, ["title", "kind"]).agg(F.sum("doclen")).first()[0]
    for name in ("postings", "doc_lengths"):  # each would split all texts
        monkeypatch.setattr(search, name, None)
    index = TextIndex.create(spark, str(tmp_path / "i"), ["title", "kind"])
    index.add(docs)
    assert index.info().select("num_docs", "sum_doclen").first() == (3, want)
