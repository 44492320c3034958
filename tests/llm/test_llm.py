"""The training-data operators on small fixtures: against brute force, round trips and held-out accuracy, and
with nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import hashlib
import random
import re
import weakref
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from tessera.llm import media, mixing, neardup, neighbours, packing, pii, quality, token_files, tokens, toxicity
from tessera.llm.components import components
from tessera.llm.labelled import training_rows

public = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, size int, _id int, _rows int, class_id int, rate double"


@pytest.fixture(scope="module")
def odd(spark):
    """Rows that try the edges: null and empty texts and ids, repeated rows, one very long text and word, and
    extra columns whose names the operators use themselves."""
    texts = [(0, None), (1, ""), (2, "  \n "), (3, "one two three"), (4, "one two three"), (5, "é" * 3000), (6, "word " * 30_000), (None, "no id"), (None, None), (7, "mail a@b.org and 10.0.0.1 or +1 (017) 555-7713"), (7, "mail a@b.org and 10.0.0.1 or +1 (017) 555-7713"), (8, "<|endoftext|> \x1c x\t\ty  z\r\n"), (9, "😀".encode("utf-16", "surrogatepass").decode("utf-16") * 5)]
    return spark.createDataFrame([(i, t, "en", None if (i or 0) % 4 == 3 else f"s{(i or 0) % 3}", len(t or ""), "k", 1, 2, 3, 4, 0.5) for i, t in texts], SCHEMA).persist()


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")


def texts_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


# 1 personal data
NAIVE = [re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def naive_spans(text):
    out = []
    for k, r in enumerate(NAIVE):
        for m in r.finditer(text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            doubled = [d if n % 2 == 0 else sum(divmod(2 * d, 10)) for n, d in enumerate(reversed(digits))]
            ok = (True, all(int(p) <= 255 for p in m[0].split(".")) if k == 1 else True, 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0, 8 <= len(digits) <= 15)[k]
            if ok:
                out.append((k, m.start(), m.end()))
    return out


def test_base_spans_are_the_patterns(docs):
    r = random.Random(5)
    parts = ["a", "b.c", "@", ".", "-", "1", "23", "4417744280351547", " ", "+", "+1", "(017)", "555-7713", "256", "0", ".5", "é", "\n", "1.2.3.4", "x@y.zz"]
    for text in ["".join(r.choices(parts, k=r.randint(0, 14))) for _ in range(4000)] + [t for _, t in texts_of(docs)]:
        assert pii.base_spans(text) == naive_spans(text)


def field_of(texts):
    return pii.SkipChain.fit(sum((pii.SkipChain.counts(t) for t in texts), Counter()))


#: Texts, what base patterns leave out of them, and whether only distant mentions can tell (None: they may help).
DISTANT = [
    ("Card 5 4417744280351547 7 here" + " and so on" * 200 + ", again 4417744280351547 ok", ["4417744280351547"], None),
    ("pay 4417744280351547 now" + " and so on" * 200 + " for ****-****-****-1547", ["****-****-****-1547"], True),
    ("pay 4417744280351547 now" + " and so on" * 200 + " or 4417744280351548", ["4417744280351548"], True),
    ("write john.d+x1@example.com" + " and so on" * 200 + " or john.d+x1, please", ["john.d+x1"], True),
    ("write john.d+x1[at]example[dot]com", ["john.d+x1[at]example[dot]com"], False),
    ("see +1 (487) 555-7209 4736962573099581 there", ["+1 (487) 555-7209", "4736962573099581"], False),
    ("nothing to see 123 here, 4417744280351548 neither, nor x264, ##1234 or 3.1.2", [], False),
]


def test_field_decides_beyond_the_patterns(docs):
    field = field_of([t for _, t in texts_of(docs)] + ["pay 4417744280351547 now", "call +1 (017) 555-7713 or write a.b@x.org"] * 5)
    for text, want, _ in DISTANT:
        spans = field.spans(text)
        added = [text[a:b] for k, a, b in spans if (k, a, b) not in pii.base_spans(text)]
        assert set(added) <= set(want) and (added or not want), text
    text = DISTANT[0][0]
    assert pii.redact(text, field.spans(text)).startswith("Card 5 [CARD] 7 here") and pii.redact(text, field.spans(text)).endswith("again [CARD] ok")


def test_skip_edges_change_the_table(spark, docs):
    """Without the potentials of skip edges a whole table's spans differ, by what only distant mentions tell;
    base columns do not, and documents without any kind of private data stay as they are."""
    rows = [(10**6 + n, t) for n, (t, _, _) in enumerate(DISTANT * 3)]
    table = docs.select("doc_id", "text").unionAll(spark.createDataFrame(rows, "doc_id long, text string"))
    field = pii.train(table)
    flat = pii.SkipChain(field.own, field.chain, np.zeros((5, 5)), np.zeros((5, 5)))
    got, without = ({r["doc_id"]: r for r in pii.find_pii(table, f).collect()} for f in (field, flat))
    for i, (_, want, distant) in zip(range(10**6, 10**6 + len(rows)), DISTANT * 3):
        assert distant is None or (got[i]["spans"] != without[i]["spans"]) == distant
        assert got[i]["n_spans"] - sum(got[i][f"n_{k}"] for k in pii.KINDS) in ((len(want),) if distant else range(len(want) + 1))
    assert all(r["base_sha256"] == without[i]["base_sha256"] for i, r in got.items())
    private = {i for i, t in texts_of(docs) if re.search(r"[0-9]{7}|@|\+[0-9]", t)}
    assert all(r["spans"] == "" for i, r in got.items() if i < 10**6 and not r["n_ip"] and i not in private)


def test_marginals_equal_enumeration_on_a_tree():
    nodes = pii.Nodes("10.0.0.1 x 4417744280351547", [])
    field = pii.SkipChain(np.random.default_rng(0).normal(size=(pii.FEATURES, 5)), np.random.default_rng(1).normal(size=(5, 5)), np.eye(5))
    own = nodes.features @ field.own
    joint = np.exp(own[0][:, None] + own[1][None] + (field.chain if len(nodes.chain) else 0))
    assert len(nodes.chain) == 1 and np.allclose(field.marginals(nodes)[0], joint.sum(1) / joint.sum(), atol=1e-3)


def test_one_edit():
    assert all(pii._one_edit(a, b) and pii._one_edit(b, a) for a, b in [("1234", "1235"), ("1234", "124"), ("1234", "1324"), ("1234", "12345")])
    assert not any(pii._one_edit(a, b) for a, b in [("1234", "1234"), ("1234", "1245"), ("1234", "12"), ("1234", "4321"), ("1234", "1256")])


def test_one_edit_pairs_equal_brute_force():
    r = random.Random(3)
    for _ in range(100):
        values = ["".join(r.choices("01" if r.random() < 0.5 else "0123456789", k=r.randint(1, 16))) for _ in range(r.randint(0, 12))]
        for x in list(values) * 3:
            k, y = r.randrange(len(x)), r.choice("0123456789")
            values.append(r.choice([x[:k] + y + x[k + 1 :], x[:k] + y + x[k:], x[:k] + x[k : k + 2][::-1] + x[k + 2 :]]))
        values = list(dict.fromkeys(values))
        want = [(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if pii._one_edit(values[i], values[j])]
        assert pii._one_edit_pairs(values) == want


def similar(text):
    nodes = pii.Nodes(text, pii.base_spans(text))
    return {(nodes.cores[i], nodes.cores[j]) for i, j in nodes.alike}


def test_similar_mentions_meet_whatever_lies_between(docs):
    """Partners that share digits or names with many other mentions, a change over in the middle, and a number
    whose two halves are equal."""
    field = field_of([t for _, t in texts_of(docs)] + ["pay 4417744280351547 now"] * 5)
    cards = [next(n for d in "0123456789" if pii.luhn(n := f"441774{x}{d}")) for x in ("000000000", "111222333", "222333444", "333444555")]
    for card in cards:
        wrong = card[:-1] + str((int(card[-1]) + 1) % 10)
        text = " and so on ".join([*cards, wrong])
        assert similar(text) == {(card, wrong)}
        assert [text[a:b] for _, a, b in field.spans(text)] == [*cards, wrong]
    assert similar("123451678901 and 123456178901") == {("123451678901", "123456178901")}
    assert similar("123456789012 and 123457689012") == {("123456789012", "123457689012")}
    assert similar("1234567812345678 and 1234567892345678 and 0234567812345678") == {("1234567812345678", "1234567892345678"), ("1234567812345678", "0234567812345678")}
    mails = [f"anna99@{x}.de" for x in "abcd"]
    assert similar(" or ".join([*mails, "anna99"])) == {(m, "anna99") for m in mails}
    whole = ["+1 (017) 5551234", "5550001234", "5550011234", "5550021234"]
    assert similar(" or ".join([whole[0], "****1234", *whole[1:]])) == {("5551234", "****1234"), *(("****1234", n) for n in whole[1:])}


def test_many_similar_numbers_do_not_outvote_a_base_span():
    text = " and so on ".join(str(4111110000000000 + i) for i in range(300))
    base = pii.base_spans(text)
    nodes = pii.Nodes(text, base)
    pairs = sum(pii._one_edit(a, b) for i, a in enumerate(nodes.cores) for b in nodes.cores[:i])
    assert len(nodes.alike) == pairs and len(base) == 30
    own = pii._prior()
    own[0, 0] = 8.0
    best = pii.SkipChain(own).marginals(nodes).argmax(1)
    assert (best[nodes.label > 0] == 3).all()


def test_pii_rows(odd, spark):
    field = pii.train(odd)
    rows = pii.find_pii(odd, field).collect()
    assert len(rows) == 13
    hit = [r for r in rows if r["doc_id"] == 7]
    assert len(hit) == 2 and all((r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == (1, 1, 0, 1) for r in hit)
    assert all(r["base_sha256"] == hashlib.sha256(b"").hexdigest() and r["spans"] == "" for r in rows if r["doc_id"] in (0, 1, None))
    clean = pii.redact_pii(odd, field)
    assert clean.schema.simpleString() == odd.schema.simpleString() and clean.count() == 13
    whole = odd.withColumn("n_chars", F.col("n_chars").cast("int"))
    assert pii.redact_pii(whole, field).schema["n_chars"].dataType == whole.schema["n_chars"].dataType
    assert {r["text"] for r in clean.filter("doc_id = 7").collect()} == {"mail [EMAIL] and [IP] or [PHONE]"}
    assert pii.find_pii(odd.limit(0), field).count() == 0


# 2 near-duplicates
def mutated(words, n, r):
    out = list(words)
    for _ in range(n):
        out[r.randrange(len(out))] = f"new{r.randrange(10**6)}"
    return out


def test_near_classes_equal_brute_force(spark):
    r = random.Random(2)
    rows, n = [], 0
    for _ in range(12):
        base = [f"w{r.randrange(900)}" for _ in range(r.randint(60, 160))]
        for k in range(r.randint(1, 9)):
            rows.append((n, " ".join(mutated(base, min(k, 4), r))))
            n += 1
    rows += [(n + i, rows[0][1]) for i in range(30)] + [(n + 30, None), (n + 31, ""), (n + 32, "a b"), (n + 33, "a  b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    weights = neardup.frequent_shingles(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    sets = {t or "": neardup.shingles(t or "") for _, t in rows}
    weighed = {t: (h, weights.of(h, tf)) for t, (h, tf) in sets.items()}
    group = {t: t for t in sets}

    def root(t):
        while group[t] != t:
            t = group[t]
        return t

    for a in sets:
        for b in sets:
            if a < b and len(sets[a][0]) and len(sets[b][0]) and neardup.weighted_jaccard(weighed[a], weighed[b]) >= 0.8:
                group[root(a)] = root(b)
    want = {}
    for i, t in rows:
        want.setdefault(root(t or ""), []).append(i)
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_classes(docs).collect()}
    assert got == {i: min(ids) for ids in want.values() for i in ids}
    kept = neardup.one_of_each(docs)
    assert kept.columns == ["doc_id", "text"] and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(got.values()))


@pytest.mark.parametrize("parts, marked", [(10, lambda i: i % 40 < 2), (1, lambda i: i < 2 or 1000 <= i < 1030)])
def test_frequent_shingles_are_counted_exactly(spark, parts, marked):
    n = 400 if parts > 1 else 2000
    texts = [f"own{i} a{i} b{i} c{i} d{i}" + (" s1 s2 s3 s4 s5" if marked(i) else "") for i in range(n)]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(list(enumerate(texts)), parts), "doc_id long, text string")
    got = neardup.frequent_shingles(neardup.doc_text(docs))
    times = sum(map(marked, range(n)))
    assert got.hashes.tolist() == neardup.shingles("s1 s2 s3 s4 s5")[0].tolist()
    assert np.isclose(got.idf[0], 0.8 + 0.2 * np.log(n / times) / np.log(100))


def test_words_are_those_of_split():
    r = random.Random(3)
    parts = ["a", "ab", "ba", "İ", "Σ", "É", " ", "\t", "\n", "\x1c", "\x85", "\xa0", "\u2003", "\u3000", "\u3001", "漢字", "😀", "\ud800", "\x00"]
    of: dict[int, str] = {}
    for text in ["".join(r.choices(parts, k=r.randint(0, 30))) for _ in range(3000)] + ["x" * 40_000 + " y"]:
        words, hashes = text.lower().split(), neardup.word_hashes(text)
        assert len(words) == len(hashes) and all(of.setdefault(int(h), w) == w for h, w in zip(hashes, words))
    assert len(of) == len(set(of.values()))


def test_sampling_estimates_the_weighted_similarity():
    r = np.random.default_rng(3)
    h = np.unique(r.integers(0, 1 << 63, 500, dtype=np.uint64))
    w = np.where(r.random(len(h)) < 0.3, 1.7, 1.0)
    a, b = (h[:400], w[:400]), (h[60:], w[60:])
    sampler = neardup.Sampler(picks=2000, seed=4)
    assert abs((sampler.picks(*a) == sampler.picks(*b)).mean() - neardup.weighted_jaccard(a, b)) < 0.05


def test_large_bucket_is_linked_through_its_centre():
    sig = np.random.default_rng(1).integers(0, 256, (1, 80)).astype(np.uint8).repeat(200, 0)
    pairs, centre = neardup._propose(sig, True)
    assert sorted(pairs[:, 1]) == [i for i in range(200) if i != centre] and set(pairs[:, 0]) == {centre}


def test_blocks_of_a_large_bucket_meet_through_their_centres(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL", 4)
    monkeypatch.setattr(neardup, "BLOCK", 6)
    sig = bytes(range(80))
    nodes = spark.createDataFrame([(bytes([i]), sig) for i in range(200)], "key binary, sig binary")
    pool = nodes.select("key", F.lit(7).cast("long").alias("band"), F.lit(200).cast("long").alias("n"))
    pairs = [(bytes(a)[0], bytes(b)[0]) for a, b in neardup._proposals(pool, nodes).collect()]
    assert set(classes_of(200, pairs)) == {0} and len(pairs) < 260


@pytest.mark.parametrize("parts", [1, 7])
def test_two_large_families_equal_brute_force(spark, parts):
    r = random.Random(9)
    rows = []
    for _ in range(2):
        base = [f"w{r.randrange(10**6)}" for _ in range(300)]
        rows += [" ".join(mutated(base, r.randint(0, 9), r)) for _ in range(120)]
    weights = neardup.Weights(np.zeros(0, np.uint64), np.zeros(0))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(parts)
    weights = neardup.frequent_shingles(neardup.doc_text(docs))
    sets = [(h, weights.of(h, tf)) for h, tf in map(neardup.shingles, rows)]
    want = classes_of(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if neardup.weighted_jaccard(sets[i], sets[j]) >= 0.8])
    got = {x["doc_id"]: x["class_id"] for x in neardup.near_classes(docs).collect()}
    assert [got[i] for i in range(len(rows))] == want and 2 <= len(set(want)) < 100


def test_rows_of_one_id_and_unlike_texts_all_stay(spark):
    one, two = "a b c d e f g h", "p q r s t u v w"
    docs = spark.createDataFrame([(1, one), (1, two), (2, two), (None, one), (None, "x y z 1 2 3"), (None, "x y z 1 2 3")], "doc_id long, text string")
    assert sorted(r["text"] for r in neardup.one_of_each(docs).collect()) == sorted([one, two, "x y z 1 2 3"])


def subgroups():
    """Texts of one bucket: 60 near a base, and 12 pairs of subgroups of nine far from it, joined at 0.8 to 0.9
    only; their keys and signatures, and a filter of pairs."""
    r = random.Random(5)
    base = [f"w{i}" for i in range(400)]
    change = lambda words, places: [f"x{r.randrange(10**9)}" if i in places else w for i, w in enumerate(words)]
    texts = [" ".join(change(base, {r.randrange(400)})) for _ in range(60)]
    for _ in range(12):
        far = change(base, set(r.sample(range(0, 200, 6), 20)))
        for side in (far, change(far, {230, 250, 270, 290, 310, 330})):
            texts += [" ".join(change(side, {399 - k})) for k in range(9)]
    sets = [(h, np.where(tf > 1, 1 + np.log(tf), 1.0)) for h, tf in map(neardup.shingles, texts)]
    sampler = neardup.Sampler()
    sig = np.array([(sampler.picks(*s) & np.uint64(255)).astype(np.uint8) for s in sets])
    verified = lambda pairs: [(i, j) for i, j in pairs if neardup.weighted_jaccard(sets[i], sets[j]) >= 0.8]
    return texts, [hashlib.md5(t.encode()).digest() for t in texts], sig, verified


def classes_of(n, links):
    label = list(range(n))
    for i, j in links:
        one, two = label[i], label[j]
        label = [min(one, two) if x in (one, two) else x for x in label]
    return label


def test_subgroups_of_a_large_bucket_equal_brute_force(spark, monkeypatch):
    texts, keys, sig, verified = subgroups()
    want = classes_of(len(texts), verified((i, j) for i in range(len(texts)) for j in range(i)))
    at = {k: i for i, k in enumerate(keys)}
    first = verified(map(tuple, neardup._propose(sig, True)[0]))
    assert classes_of(len(texts), first) != want
    monkeypatch.setattr(neardup, "PAIRED", 40)
    keyed = spark.createDataFrame([(i, t, k, len(t)) for i, (t, k) in enumerate(zip(texts, keys))], "doc_id long, text string, key binary, size long")
    links = spark.createDataFrame([(keys[i], keys[j]) for i, j in first], "a binary, b binary")
    inside = keyed.select("key", F.lit(1).cast("long").alias("band"))
    rest = neardup._rest_links(keyed, keyed, inside, components(links), neardup.Weights(np.zeros(0, np.uint64), np.zeros(0)), 0.8).collect()
    assert classes_of(len(texts), first + [(at[bytes(x["a"])], at[bytes(x["b"])]) for x in rest]) == want


def test_block_links_are_exact():
    r = random.Random(8)
    texts = ["a b c d e f g " * r.randint(2, 9) + " ".join(r.choice("pqrstuv") for _ in range(r.randint(3, 30))) for _ in range(90)] + ["", " "]
    some = neardup.shingles(texts[0])[0][:3]
    weights = neardup.Weights(some, np.full(len(some), 0.85))
    for t in texts:
        h, tf = neardup.shingles(t)
        assert np.isclose(neardup._features(h, tf, weights)[1].sum(), weights.of(h, tf).sum())
    sets = [(h, weights.of(h, tf)) for h, tf in map(neardup.shingles, texts)]
    rows, cols = list(range(40)), list(range(40, 92))
    label = list(range(92))

    def join(a, b):
        label[:] = [label[a] if x == label[b] else x for x in label]

    for a in rows:
        for b in cols:
            if len(sets[b][0]) and neardup.weighted_jaccard(sets[a], sets[b]) >= 0.6:
                join(a, b)
    want, label[:] = [label.index(x) for x in label], range(92)
    for a, b in neardup.block_links(texts, [bytes([i]) for i in range(92)], rows, cols, weights, 0.6):
        join(a, b)
    assert [label.index(x) for x in label] == want and len(set(want)) < 92


def test_near_edges(odd):
    rows = neardup.near_classes(odd).collect()
    assert len(rows) == 13
    kept = neardup.one_of_each(odd)
    assert kept.columns == odd.columns
    ids = sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.select("doc_id").collect())
    assert ids == sorted((x is None, x) for x in [0, 2, 3, 5, 6, 7, 8, 9, None])
    assert neardup.near_classes(odd.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (200, 200)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in (100, 101, 102)} == {100}


# 3 quality
def test_trees_learn_and_flatten():
    r = np.random.default_rng(0)
    x = r.random((2000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    model = quality.BoostedTrees(trees=30).fit(x[:1500], y[:1500])
    assert ((model.score(x[1500:]) >= 0.5) == y[1500:]).mean() > 0.95

    def walk(row):
        total = model.bias
        for node in model.roots:
            while model.left[node] != node:
                node = model.left[node] + (row[model.feature[node]] > model.threshold[node])
            total += model.value[node]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(model.score(x[:20]), [walk(v) for v in x[:20]])
    assert quality.BoostedTrees().fit(x[:0], y[:0]).score(x[:1])[0] == 0.5


def test_quality_held_out(docs, labels, odd):
    model = quality.train(docs, labels)
    scored = quality.quality_scores(docs, model).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in scored) >= 0.9 * len(scored)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in scored)
    rows = quality.quality_scores(odd, model).collect()
    assert len(rows) == 13 and all(0 <= r["score"] <= 1 for r in rows)
    clash = odd.withColumn("score", F.lit(1)).withColumn("predicted", F.lit("x")).withColumn("_text", F.lit(2.5))
    for given in (odd, clash):
        kept = quality.keep_good(given, model)
        assert kept.schema.simpleString() == given.schema.simpleString() and kept.count() == sum(r["predicted"] for r in rows)
    assert quality.quality_scores(odd.limit(0), model).count() == quality.keep_good(odd.limit(0), model).count() == 0


def test_quality_query_equals_trees_walked_by_hand(spark, sf, docs, labels):
    from tessera.llm.queries import op3_quality_classifier

    model = quality.train(docs, labels)
    got = {r["doc_id"]: r for r in op3_quality_classifier(spark, sf).collect()}
    texts = dict(texts_of(docs))
    assert set(got) == set(texts)
    for i, text in texts.items():
        row, total = quality.statistics(text), model.bias
        for node in model.roots:
            while model.left[node] != node:
                node = model.left[node] + (row[model.feature[node]] > model.threshold[node])
            total += model.value[node]
        assert np.isclose(got[i]["score"], 1 / (1 + np.exp(-total))) and got[i]["predicted"] == int(got[i]["score"] >= 0.5)


def test_training_rows_are_bounded(spark):
    docs = spark.createDataFrame([(i % 4, f"text {i}") for i in range(400)] + [(9, "long " * 50), (12, "held"), (None, "none")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i in (0, 3))) for i in (0, 1, 2, 3, 9, 12)] + [(None, 1), (2, None), (3, 0)], "doc_id long, toxic int")
    rows = training_rows(docs, labels, "toxic", 2, 100).collect()
    free = [i for i in (0, 1, 2, 3) if zlib.crc32(str(i).encode()) % 3 != 1]
    assert sorted(r["doc_id"] for r in rows) == free and len(rows) <= 4
    assert all(r["text"] == min(f"text {i}" for i in range(400) if i % 4 == r["doc_id"]) and r["y"] == int(r["doc_id"] in (0, 3)) for r in rows)
    assert training_rows(docs, labels, "toxic", 1, 100).count() <= 2
    assert training_rows(docs.limit(0), labels, "toxic", 2, 100).count() == training_rows(docs, labels.limit(0), "toxic", 2, 100).count() == 0
    assert quality.train(docs.limit(0), labels.withColumnRenamed("toxic", "quality")).score(np.zeros((1, len(quality.FEATURES))))[0] == 0.5


# 4 media
def test_images_round_trip():
    image = np.random.default_rng(0).integers(0, 256, (7, 5, 3)).astype(np.uint8)
    assert (media.decode(media.encode_pnm(image)) == image).all() and (media.decode(media.encode_bmp(image)) == image).all()
    assert (media.decode(media.encode_pnm(image[..., 0])) == image[..., 0]).all()
    assert (media.decode(b"P3 # c\n2 1\n255\n1 2 3 4 5 6") == [[[1, 2, 3], [4, 5, 6]]]).all()
    assert (media.decode(b"P1\n3 1\n1 0 1") == [[0, 255, 0]]).all() and (media.decode(b"P4\n3 1\n\xa0") == [[0, 255, 0]]).all()
    assert media.decode(b"P5\n1 1\n65535\n\x01\x02")[0, 0] == 258
    with pytest.raises(ValueError):
        media.decode(b"GIF89a")


def test_area_resize_is_the_mean_of_areas():
    image = np.random.default_rng(1).random((6, 10))
    fine = image.repeat(4, 0).repeat(3, 1)  # 24 x 30
    want = fine.reshape(4, 6, 3, 10).mean((1, 3))
    assert np.allclose(media.area_resize(image, 4, 3), want)


def test_media_rows(odd):
    for r in media.media_digest(media.text_images(odd)).collect():
        assert r["payload_bytes"] == max(192, -(-r["n_bytes"] // 192) * 192)
    digests = {r["doc_id"]: r for r in media.media_digest(media.text_images(odd)).collect()}
    assert digests[0]["payload_sha256"] == hashlib.sha256(b" " * 192).hexdigest() == digests[1]["payload_sha256"]
    assert digests[3]["tail_crc32"] == zlib.crc32(b" " * 16) and digests[3]["feature"] == digests[4]["feature"]
    assert media.text_images(odd.limit(0)).count() == 0


@pytest.mark.parametrize("form", ["pnm", "bmp"])
def test_media_features_equal_an_independent_reading(odd, form):
    """Payload, tile and hash of every stored image against plain loops over its exact areas."""
    images = media.text_images(odd.filter("doc_id < 10 or doc_id is null"), form)
    texts = Counter((r["doc_id"], r["text"] or "") for r in odd.collect())
    stored = images.collect()
    seen = {bytes(r["media"]) for r in stored}
    want = {}
    for data in seen:
        if form == "pnm":
            head, size, most, body = data.split(b"\n", 3)
            w, h = map(int, size.split())
            rgb = [[body[3 * (w * y + x) : 3 * (w * y + x) + 3] for x in range(w)] for y in range(h)]
        else:
            w, h = int.from_bytes(data[18:22], "little"), int.from_bytes(data[22:26], "little")
            rgb = [[data[54 + 192 * (h - 1 - y) + 3 * x :][:3][::-1] for x in range(w)] for y in range(h)]
        payload = b"".join(b"".join(row) for row in rgb)

        def mean(f, y0, y1, x0, x1):
            total = 0.0
            for y in range(int(y0), min(h, int(np.ceil(y1 - 1e-9)))):
                for x in range(int(x0), min(w, int(np.ceil(x1 - 1e-9)))):
                    total += (min(y + 1, y1) - max(y, y0)) * (min(x + 1, x1) - max(x, x0)) * f(rgb[y][x])
            return total / ((y1 - y0) * (x1 - x0))

        if h <= 3:
            bits, tile = "", np.zeros((32, 32, 3), np.uint8)
            light = lambda c: 0.299 * c[0] + 0.587 * c[1] + 0.114 * c[2]
            for y in range(8):
                row = [round(mean(light, y * h / 8, (y + 1) * h / 8, x * w / 9, (x + 1) * w / 9), 6) for x in range(9)]
                bits += "".join("1" if b > a else "0" for a, b in zip(row, row[1:]))
            want[data] = f"{int(bits, 2):016x}"
            for k in range(3):
                for y in range(32):
                    for x in range(32):
                        tile[y, x, k] = round(mean(lambda c: c[k], y * h / 32, (y + 1) * h / 32, x * 2, x * 2 + 2))
            want[data] += f":{zlib.crc32(b'%cNUMPY%c%c' % (0x93, 1, 0) + npy_head() + tile.tobytes()):08x}"
        assert payload.rstrip(b" ").decode() in {t.rstrip(" ") for _, t in texts}
    rows = media.media_digest(images).collect()
    digest = {hashlib.sha256(d).hexdigest(): (d, f) for d, f in want.items()}
    assert len(digest) >= 6 and len(rows) == 13
    for r in rows:
        if r["media_sha256"] in digest:
            assert r["feature"] == digest[r["media_sha256"]][1]
    tiles = media.media_tiles(images).collect()
    assert {f"{r['dhash']}:{zlib.crc32(r['tile']):08x}" for r in tiles} == {r["feature"] for r in rows}


def npy_head():
    text = "{'descr': '|u1', 'fortran_order': False, 'shape': (32, 32, 3), }"
    text += " " * (-(len(text) + 11) % 64) + "\n"
    return len(text).to_bytes(2, "little") + text.encode()


# 5, 6 and 10 tokens
@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_and_counts_equal_the_library(name, docs):
    from tokenizers import Tokenizer

    library, encoder, counter = Tokenizer.from_file(public.path(name)), tokens.Encoder(public.path(name)), tokens.PairCounter(public.path(name))
    r = random.Random(7)
    parts = ["a", "B", "é", "é", "İ", "Σ", "ß", " ", "  ", "\n", "\n\n", "\t", "\x1c", "\x85", "\xa0", "　", "'s", "'LL", "12", "٣", "!!", "<|endoftext|>", "<|startoftext|>", "<|", "नमस्ते", "한국어", "\x00", "tion"]
    for text in ["".join(r.choices(parts, k=r.randint(0, 12))) for _ in range(1500)] + [t for _, t in texts_of(docs)][:60] + ["x" * 5000]:
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == want and counter.count(text) == len(want)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_batches_of_texts_equal_the_library(name, docs, monkeypatch):
    """Words of many texts at once: known, new, long and forgotten ones, and texts that Arrow's cut does not fit."""
    from tokenizers import Tokenizer

    library, r = Tokenizer.from_file(public.path(name)), random.Random(8)
    parts = ["a", "B", "é", "tion", "'s", "'LL", "12", "!!", " ", " ", " ", "\n", "\xa0", "\x1c", "\t", "नमस्ते", "한국어", "\x00", "<|endoftext|>", "<|", "y" * 60, "Ġ", "Ċ", "\u200b"]
    texts = ["".join(r.choices(parts, k=r.randint(0, 12))) for _ in range(1500)] + [t for _, t in texts_of(docs)][:60] + ["x" * 5000]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    for known in (40, 10**6):
        monkeypatch.setattr(tokens, "KNOWN", known)
        encoder = tokens.Encoder(public.path(name))
        for n in (len(texts), 7):
            got = [x for at in range(0, len(texts), n) for x in encoder.batch(pa.array(texts[at : at + n], pa.string()))]
            assert [np.frombuffer(x, "<u4").tolist() for x in got] == want
        assert len(encoder.known.words) <= known and all(len(w) <= tokens.LONGEST for w in encoder.known.words.to_pylist())
    assert encoder.batch(pa.array([], pa.string())) == []


def test_batches_look_up_each_new_word_once():
    """Ten thousand texts of the same words ask for two rows of tokens, and nothing of them goes through the dict."""
    encoder = tokens.Encoder(public.path("byte_bpe_50k.json"))
    asked, row = [], encoder.row
    encoder.row = lambda keys: (asked.append(list(keys)), row(keys))[1]
    for texts in (["one two three two"] * 10_000, ["one two four"] * 10):
        assert len(set(encoder.batch(pa.array(texts)))) == 1
    assert [sorted(x) for x in asked] == [["one", "three", "two"], ["four"]] and len(encoder.part) == 1


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_an_encoder_goes_with_its_last_use(name):
    """A worker's next operator needs its memory, and the collector of cycles may come late."""
    encoder = tokens.Encoder(public.path(name))
    encoder.batch(pa.array(["one two three"]))
    gone = weakref.ref(encoder)
    del encoder
    assert gone() is None


def test_cache_turns_over(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 3)
    kept = tokens._Kept(lambda k: k * 2)
    assert [kept[k] for k in "abcdabcdeeab"] == [k * 2 for k in "abcdabcdeeab"] and len(kept) <= 3 and len(kept.old) <= 3


def test_token_counts(odd):
    rows = {r["doc_id"]: r for r in tokens.token_counts(odd, public.path("word_bpe_49k.json")).collect() if r["doc_id"] is not None}
    assert (rows[0]["n_bytes"], rows[0]["n_tokens"]) == (0, 0) and rows[6]["n_tokens"] == 30_000 and rows[6]["over_limit"] and not rows[3]["over_limit"]


@pytest.mark.parametrize("seed", range(8))
def test_plan_places_every_piece_without_holes(seed):
    r = random.Random(seed)
    capacity = r.choice([7, 20, 100, 2048])
    counts = {r.randint(1, capacity): r.randint(1, 50) for _ in range(r.randint(1, 50))}
    plan, sequences = packing.pack_plan(counts, capacity), {}
    for n, c in counts.items():
        own = [x for x in plan.tolist() if x[0] == n]
        for rank in range(c):
            _, first, at, each, offset = [x for x in own if x[1] <= rank][-1]
            sequences.setdefault(at + (rank - first) // each, []).append((offset + n * ((rank - first) % each), n))
    for places in sequences.values():
        end = 0
        for offset, n in sorted(places):
            assert offset == end
            end += n
        assert end <= capacity and sum(3 * n > capacity for _, n in places) <= 2
    assert len(sequences) <= 1.25 * sum(n * c for n, c in counts.items()) / capacity + 2


def check_packed(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        end = 0
        for offset, n in sorted(places):
            assert offset == end
            end += n
        assert end <= capacity


def test_packed_rows(odd):
    rows = packing.pack(odd, public.path("word_bpe_49k.json")).collect()
    check_packed(rows, 2048)
    long = sorted((r["piece"], r["start"], r["length"]) for r in rows if r["doc_id"] == 6)
    assert [x[1] for x in long] == [2048 * k for k in range(15)] and sum(x[2] for x in long) == 30_001
    assert sum(r["length"] == 1 for r in rows) == 4  # null, empty and blank texts are the end id alone
    assert packing.pack(odd.limit(0), public.path("word_bpe_49k.json")).count() == 0


def test_token_files_round_trip(odd, docs):
    path = public.path("byte_bpe_50k.json")
    files = token_files.write_token_files(docs, path, file_bytes=40_000)
    assert files.count() > 1
    encoder, start = tokens.Encoder(path), 0
    got = {r["doc_id"]: r for r in token_files.read_token_files(files).collect()}
    for i, text in sorted(texts_of(docs)):
        ids = encoder.ids(text) + np.array([2], "<u4").tobytes()
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"], bytes(got[i]["ids"])) == (start, len(ids) // 4, zlib.crc32(ids), ids)
        start += len(ids) // 4
    some = token_files.read_token_files(files, wanted=[3, 5]).collect()
    assert {r["doc_id"] for r in some} == {3, 5} & set(got) and token_files.read_token_files(files, wanted=[]).count() == 0
    # a damaged file is not opened for documents that it does not hold
    last = max(got)
    damaged = files.withColumn("content", F.when(F.col("last_id") == last, F.lit(b"damaged" * 9)).otherwise(F.col("content")))
    assert token_files.read_token_files(damaged, wanted=[min(got)]).count() == 1
    with pytest.raises(Exception, match="seek table is"):
        token_files.read_token_files(damaged, wanted=[last]).count()
    assert token_files.read_token_files(token_files.write_token_files(odd, path)).count() == 13
    assert token_files.read_token_files(token_files.write_token_files(odd.limit(0), path)).count() == 0


def test_equal_ids_have_one_order(spark):
    path, rows = public.path("byte_bpe_50k.json"), [(1, "one two three"), (1, "four"), (None, "five six"), (None, None), (1, "four"), (2, "seven")]
    seen = set()
    for own in (rows, rows[::-1], rows[3:] + rows[:3]):
        files = token_files.write_token_files(spark.createDataFrame(own, "doc_id long, text string").repartition(3), path)
        seen.add(tuple(sorted((r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_files.read_token_files(files).collect())))
    assert len(seen) == 1


def test_file_is_seekable_and_checked():
    writer = token_files.FileWriter()
    for i, ids in enumerate([b"\1\0\0\0", b"", b"\2\0\0\0" * 500]):
        writer.add(None if i == 1 else i, ids)
    content = writer.content()
    reader = token_files.FileReader(content)
    assert [reader.read(k) for k in range(3)] == [b"\1\0\0\0", b"", b"\2\0\0\0" * 500] and reader.find(2) == [b"\2\0\0\0" * 500] and reader.find(None) == [b""]
    whole = zstandard.ZstdDecompressor().stream_reader(content, read_across_frames=True).read()
    assert whole == b"\1\0\0\0" + b"\2\0\0\0" * 500
    reader.table = reader.table.copy()
    reader.table[0, 2] ^= 1
    with pytest.raises(ValueError):
        reader.read(0)


# 7 neighbours
def test_neighbours(spark, monkeypatch):
    r = np.random.default_rng(0)
    x = r.normal(size=(3000, 16)) * r.uniform(0.5, 2, (3000, 1))
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    rows += [(3000 + i, rows[40][1]) for i in range(30)]  # ties
    rows += [(4000, None), (4020, []), (4040, [0.0] * 16), (4060, [float("nan")] * 16), (4080, [None] * 16), (4100, [float("inf")] * 16), (None, rows[1][1]), (4120, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = neighbours.search(df, df.filter("vec_id % 20 = 0")).toPandas()
    ids, full = np.array([i for i, v in rows if i is not None and i < 4000]), np.array([v for i, v in rows if i is not None and i < 4000], np.float64)
    hit = 0
    for q, own in got.groupby("query_id"):
        assert q < 4000
        s = (full * full[q]).sum(1)
        s[q] = -np.inf
        best = ids[np.lexsort((ids, -s))[:20]]
        own = own.sort_values("rank")
        assert list(own["rank"]) == list(range(1, 21)) and np.allclose(own["score"], s[own["vec_id"]])
        hit += len(set(best) & set(own["vec_id"]))
    assert hit >= 0.9 * len(got)
    tied = got[got["query_id"] == 40].sort_values("rank")["vec_id"].tolist()
    assert [v for v in tied if v >= 3000] == list(range(3000, 3000 + sum(v >= 3000 for v in tied)))
    monkeypatch.setattr(neighbours, "BLOCK", 700)
    blocks = neighbours.search(df, df.filter("vec_id % 20 = 0")).toPandas()
    assert len(blocks) == len(got) and sum(len(set(a["vec_id"]) & set(got[got["query_id"] == q]["vec_id"])) for q, a in blocks.groupby("query_id")) >= 0.9 * len(got)
    few = df.filter("vec_id < 5")
    assert neighbours.search(few, few.filter("vec_id = 0")).count() == 4
    assert neighbours.search(df.limit(0), df.limit(0)).count() == 0


def test_neighbour_query_has_its_recall(spark):
    from tessera.llm.queries import op7_collision_counting

    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    x, ids = np.array([r["embedding"] for r in rows], np.float64), np.array([r["vec_id"] for r in rows])
    got = {}
    for r in op7_collision_counting(spark, "/root/testdata/sf0.1").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    hit = 0
    for at in np.flatnonzero(ids % 20 == 0):
        s = x @ x[at]
        s[at] = -np.inf
        hit += len(set(ids[np.lexsort((ids, -s))[:20]].tolist()) & {v for _, v in got[ids[at]]})
    assert hit >= 0.95 * 20 * len(got) and len(got) == sum(ids % 20 == 0)


# 8 toxicity
def test_gradients():
    net = toxicity.Network(3)
    r = np.random.default_rng(0)
    for k, v in net.p.items():
        net.p[k] = v.astype(np.float64)
    numbers, grams = net.features(["ab", "cde", "xyz", "q"])
    x = net.project(numbers, grams)
    at, mask = r.integers(0, 4, (5, 3)), np.ones((5, 3))
    mask[3:, 1] = 0
    up = r.normal(size=3)
    keep: dict = {}
    run = lambda: float((net.forward(x, at, mask) * up).sum())
    net.forward(x, at, mask, keep)
    g, d_x = net.gradients(x, at, mask, keep, up)
    for name in ("fore", "back", "att", "pick", "out"):
        p = net.p[name]
        place = tuple(r.integers(0, s) for s in p.shape)
        p[place] += 1e-3
        high = run()
        p[place] -= 2e-3
        low = run()
        p[place] += 1e-3
        assert abs((high - low) / 2e-3 - g[name][place]) < 2e-3
    x[1, 5] += 1e-3
    high = run()
    x[1, 5] -= 2e-3
    assert abs((high - run()) / 2e-3 - d_x[1, 5]) < 2e-3


def test_toxicity_learns_and_scores_every_window():
    r = random.Random(1)
    make = lambda bad: " ".join(r.choice(["sun", "moon", "tree", "stone", "river", "cloud"]) for _ in range(r.randint(20, 90))) + (" vile scum" if bad else "")
    y = np.array([i % 2 for i in range(160)], np.float32)
    net = toxicity.fit([make(b) for b in y], y, epochs=6)
    scorer = toxicity.Scorer(net)
    calm = "sun moon " * 400
    s = scorer.score([calm, calm + "vile scum", "vile scum " + calm, calm + "vile scum " + calm, ""])
    assert s[0] < 0.5 and (s[1:4] > 0.7).all() and 0 <= s[4] <= 1
    assert np.allclose(scorer.score(["vile scum"]), toxicity.Scorer(net).score([calm, "vile scum"])[1:])
    assert toxicity.Scorer(toxicity.fit([], np.zeros(0, np.float32))).score(["x"])[0] == 0.5


def test_every_gram_of_a_long_word_is_read():
    word = "".join(random.Random(4).choice("abcdefghij漢字") for _ in range(5000))
    for size in (16, 17, 32, 33, 34, 61, 62, 5000):
        w = word[:size]
        pieces = toxicity.words_of(w)
        assert all(any(w[i : i + 4] in p for p in pieces) for i in range(size - 3))
        assert max(map(len, pieces)) <= 32 and pieces[0][:3] == w[:3] and pieces[-1][-3:] == w[-3:]
        for p in pieces:
            assert (toxicity.gram_ids(["x", p])[1] > 0).sum() == 2 * len(f"<{p}>".encode()) - 5
    r, calm = random.Random(6), [random.Random(i).choice("aeiou") + random.Random(i + 99).choice("lmnr") for i in range(60)]
    make = lambda bad: "".join(r.choice(calm) for _ in range(200)) + ("vilescum" if bad else "") + "".join(r.choice(calm) for _ in range(200))
    y = np.array([i % 2 for i in range(160)], np.float32)
    s = toxicity.Scorer(toxicity.fit([make(b) for b in y], y)).score([make(i % 2) for i in range(40)])
    assert (s[1::2] > 0.5).mean() > 0.9 and (s[::2] < 0.5).mean() > 0.9


def test_toxicity_rows(odd, docs, labels):
    net = toxicity.train(docs, labels)
    assert toxicity.toxicity_scores(odd.limit(0), net).count() == 0
    rows = toxicity.toxicity_scores(odd, net).collect()
    assert len(rows) == 13 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)


def test_toxicity_held_out(spark):
    from tessera.llm.queries import op8_toxicity

    sf = "/root/testdata/sf0.1"
    rows = op8_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    score, y = np.array([r["score"] for r in rows]), np.array([r["toxic"] for r in rows])
    assert (score[y == 1][:, None] > score[y == 0][None]).mean() >= 0.9
    assert (score[y == 1] >= 0.7).mean() >= 0.8 and (score[y == 0] >= 0.7).mean() <= 0.03


# 9 mixing
def fill_naively(sizes, weights):
    """Share by weight, cap, share the excess anew, until nothing is above."""
    left, full, share = 1.5 * sum(sizes), [2.0 * s for s in sizes], [0.0] * len(sizes)
    rest = set(range(len(sizes)))
    while rest:
        w = sum(weights[i] for i in rest)
        over = {i for i in rest if left * weights[i] / w > full[i]}
        if not over:
            for i in rest:
                share[i] = left * weights[i] / w
            break
        for i in over:
            share[i] = full[i]
            left -= full[i]
        rest -= over
    return share


def test_mixing(spark, odd):
    r = random.Random(4)
    rows = [(i, "w " * r.randint(0, 60), f"s{min(i % 9, r.randint(0, 8))}" if i % 50 else None) for i in range(2500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mixing_report(docs).collect()
    sizes = {}
    for r_ in got:
        sizes[r_["doc_id"]] = r_["size"]
        assert r_["size"] == len(rows[r_["doc_id"]][1].split()) and r_["taken"] <= 2 * r_["size"]
    names = sorted({s for _, _, s in rows if s}) + [None]
    total = [sum(sizes[i] for i, _, s in rows if s == n) for n in names]
    want = fill_naively(total, [(5, 2, 1)[i % 3] for i in range(len(names))])
    target = {rows[r_["doc_id"]][2]: r_["target"] for r_ in got}
    assert np.allclose([target[n] for n in names], want)
    assert abs(sum(r_["taken"] for r_ in got) - 1.5 * sum(total)) < 0.05 * sum(total)
    assert sorted(map(tuple, mixing.mixing_report(docs).collect())) == sorted(map(tuple, got))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r_["copies"] for r_ in got)
    assert mixing.mixing_report(odd).count() == 13 and mixing.mix(odd).columns == odd.columns
    assert mixing.mixing_report(odd.limit(0)).count() == 0 and mixing.mix(odd.limit(0)).count() == 0


# the pipeline
def test_pipeline(spark, sf, docs, labels, tmp_path):
    import corpus_pipeline as cp

    assert [n for n, _ in cp.STAGES] == ["quality", "near_duplicates", "personal_data", "mixing", "packing"]
    rows = docs
    seen = [docs.count()]
    for n, (name, stage_of) in enumerate(cp.STAGES):
        out = stage_of(spark, rows, sf)
        out.write.parquet(str(tmp_path / name))
        rows = spark.read.parquet(str(tmp_path / name))
        seen.append(rows.count())
        if n < 4:
            assert rows.columns == docs.columns
    good = quality.quality_scores(docs, quality.train(docs, labels)).filter("predicted = 1").count()
    assert seen[1] == good and seen[2] <= seen[1] and seen[3] == seen[2] and seen[4] > seen[3]
    check_packed(rows.collect(), 2048)
    private = spark.read.parquet(str(tmp_path / "personal_data"))
    assert all(not pii.base_spans(t) for _, t in texts_of(private))
