"""N-gram Jaccard join and components against brute force."""

import random

import numpy as np
import pytest

from tests.llm.helpers import clashing, documents, edge_docs, empty_docs, rows, space_words
from tests.oracle import compare
from tidelog.llm import common, ngram_join, shingles
from tidelog.llm.components import components
from tidelog.llm.queries import ORACLE_SQL, QUERIES


def brute_set(text):
    w = space_words((text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(docs):
    sets = [(i, brute_set(t)) for i, t in docs]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, len(s), least.get(find(k))) for k, (i, s) in enumerate(sets)), key=repr)


def found(df):
    return rows(ngram_join.cluster(df), "doc_id", "n_shingles", "component_id")


def variants(seed, n, words, edits):
    """Near copies of one text, each edited at some places."""
    r = random.Random(seed)
    base = [f"w{seed}x{i}" for i in range(words)]
    out = []
    for k in range(n):
        w = list(base)
        for _ in range(r.randrange(edits + 1)):
            w[r.randrange(words)] = f"e{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_against_brute_force(spark, sf):
    docs = documents(spark, sf)
    assert found(docs) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_matches_sql(spark, sf):
    compare(QUERIES["op3_ngram_jaccard_join"](spark, sf), ORACLE_SQL["op3_ngram_jaccard_join"], sf)


@pytest.mark.parametrize("seed", range(3))
def test_groups_of_near_copies(spark, seed, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 25)  # several blocks a shingle
    texts = variants(seed, 70, 120, 8) + variants(seed + 50, 45, 30, 3) + variants(seed + 90, 60, 12, 2) + ["same text for all of these here"] * 40
    random.Random(seed).shuffle(texts)
    assert found(frame(spark, texts)) == brute(list(enumerate(texts)))


@pytest.mark.parametrize("postings", [16, 256, 4096])
def test_few_near_copies_of_a_text_with_many_copies(spark, monkeypatch, postings):
    """Copies make a text's shingles hot in the sketch; with many buckets its near copies still link."""
    monkeypatch.setattr(ngram_join, "BUCKET_POSTINGS", postings)
    r = random.Random(7)
    other = [" ".join(f"f{r.randrange(10**9)}" for _ in range(40)) for _ in range(postings // 4)]
    texts = other + variants(5, 14, 80, 3) + [" ".join(f"w5x{i}" for i in range(80))] * 300 + variants(6, 3, 40, 1)
    random.Random(5).shuffle(texts)
    assert found(frame(spark, texts)) == brute(list(enumerate(texts)))


def test_near_copies_beyond_what_a_bucket_holds(spark, monkeypatch):
    """Distinct sets at one shingle, more than a bucket holds: the stream of postings passes them on."""
    monkeypatch.setattr(ngram_join, "BUCKET_POSTINGS", 32)
    monkeypatch.setattr(ngram_join, "hot_limits", lambda sketch: np.full(len(sketch), 1 << 30))
    texts = variants(8, 160, 60, 6) + variants(9, 40, 25, 1)
    random.Random(5).shuffle(texts)
    assert found(frame(spark, texts)) == brute(list(enumerate(texts)))


def test_a_bucket_holds_no_more_than_it_should(monkeypatch):
    monkeypatch.setattr(ngram_join, "BUCKET_POSTINGS", 8)
    rows = np.zeros(100, ngram_join.POSTING)
    rows["shingle"], rows["set"], rows["size"] = 7, np.arange(100), 40
    rows["shingle"][::10] = 9
    bucket = ngram_join.Bucket(False)
    out = np.concatenate([bucket.add(rows[k : k + 5]) for k in range(0, 100, 5)])
    assert bucket.n <= 32 and set(bucket.gone.tolist()) >= {7}
    pairs, crowd = bucket.finish()
    assert len(out) + len(crowd) + len(np.unique(pairs)) >= 100 and not set(out["set"]) & set(np.unique(pairs).tolist())
    assert len(ngram_join.Bucket(True).add(rows)) == 100


def test_sketch_grows_with_the_documents():
    assert [shingles.sketch_bits(n) for n in (0, 1, 4 << 20, (4 << 20) + 1, 10 << 20, 1 << 40)] == [18, 18, 18, 19, 20, 22]


def test_tables_on_the_way_are_removed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda _: f"file://{tmp_path}")
    ngram_join.cluster(frame(spark, variants(3, 60, 40, 3))).collect()
    assert sorted(p.name.split("-")[0] for p in tmp_path.iterdir()) == ["members", "profile"]


def test_edges(spark):
    docs = edge_docs(spark)
    assert found(clashing(docs)) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert found(empty_docs(spark)) == []
    kept = ngram_join.first_of_each(clashing(docs))
    assert kept.columns == clashing(docs).columns and {r["join_row"] for r in kept.collect()} == {"clash"}
    assert sorted(space_words(r["text"])[0] for r in kept.collect() if r["text"] and r["text"].strip()) == sorted(["word", "ÀÉ", "alpha", "x", "one", "one"])
    unique = docs.where("doc_id is not null and doc_id <> 11")
    assert rows(ngram_join.first_of_each(unique), "doc_id") == [(i,) for i in ("1", "10", "2", "3", "4", "5", "6", "9") for i in [int(i)]]


def test_threshold_is_exact(spark):
    base = [f"w{i}" for i in range(32)]  # 28 shingles; k changed at the end leave 28 - k of 28 + k
    texts = [" ".join(base)] + [" ".join(base[: 32 - k] + [f"n{k}{i}" for i in range(k)]) for k in range(1, 9)]
    got = {r[0]: r[2] for r in found(frame(spark, texts[:1] + texts[4:5]))}
    assert got == {0: 0, 1: 0}  # 24 of 32 is 3/4
    got = {r[0]: r[2] for r in found(frame(spark, texts[:1] + texts[5:6]))}
    assert got == {0: 0, 1: 1}


def test_shingles_are_words_not_bytes():
    s = lambda t: set(shingles.shingles(t.encode()).tolist())
    assert s("a b  c\td\x0be") == s("A B C D E") and len(s("a b c d e f")) == 2 and s("É") != s("é")
    assert len(shingles.shingles(None)) == len(shingles.shingles(b" \n")) == 0
    assert s("a\u00a0b") != s("a b") and len(s("ab c d e f")) == 1 and s("ab c d e f") != s("a bc d e f")


def test_prefixes_of_linked_sets_meet():
    r = np.random.default_rng(0)
    sketch = r.integers(0, 50, (shingles.SKETCH_ROWS, 1 << 18)).astype(np.int32)
    for _ in range(300):
        n = int(r.integers(1, 80))
        a = np.unique(shingles.mix(r.integers(0, 1 << 62, n).astype(np.uint64)))
        b = np.unique(np.concatenate([a[r.random(len(a)) < 0.9], shingles.mix(r.integers(0, 1 << 62, int(r.integers(0, n // 5 + 1))).astype(np.uint64))]))
        if not len(b) or 7 * len(np.intersect1d(a, b)) < 3 * (len(a) + len(b)):
            continue
        made = []
        for k, s in enumerate((a, b)):
            p = shingles.prefix_size(len(s))
            one = np.empty(p, ngram_join.POSTING)
            one["shingle"], one["set"], one["size"], one["pos"] = shingles.rare_first(s, sketch)[:p], k, len(s), np.arange(p)
            made.append(one)
        pairs, _ = ngram_join.meet(np.concatenate(made))
        assert pairs.tolist() == [[0, 1]] and ngram_join.linked(a, b)


def test_texts_that_only_share_passages_are_not_compared_whole(spark, monkeypatch):
    """All texts of four passages of three each: they meet at common shingles, and none links but the near copies."""
    passage = lambda k, v: [f"p{k}v{v}w{i}" for i in range(20)]
    texts = [" ".join(w for k in range(4) for w in passage(k, n // 3**k % 3)) for n in range(81)]
    texts += [t + " more" for t in texts[:5]]
    compared = []
    monkeypatch.setattr(ngram_join, "verify", lambda pairs, t, real=ngram_join.verify: compared.append(pairs.count()) or real(pairs, t))
    assert found(frame(spark, texts)) == brute(list(enumerate(texts)))
    assert 5 <= compared[0] < 200


def test_parities_never_exclude_a_link():
    r = np.random.default_rng(1)
    some = lambda n: shingles.mix(r.integers(0, 1 << 62, n).astype(np.uint64))
    sets = []
    for n in [1, 3, 60, 64, 65, 120, 130, 1000, 1100, 70_000]:
        base = some(n)
        sets += [np.unique(np.concatenate([base[: n - k], some(m)])) for k, m in ((0, 0), (n // 8, n // 8), (n // 4, 0), (0, n // 3))] + [np.unique(some(n))]
    marks, sizes = [shingles.parities(s) for s in sets], np.array([len(s) for s in sets])
    near = lambda i, j: 7 * shingles.differing(marks[i], marks[j]) <= sizes[i] + sizes[j]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i)]
    for i, j in pairs:
        assert shingles.differing(marks[i], marks[j]) <= len(np.setxor1d(sets[i], sets[j]))
        assert near(i, j) or not ngram_join.linked(sets[i], sets[j])
    assert any(ngram_join.linked(sets[i], sets[j]) and len(marks[i]) != len(marks[j]) for i, j in pairs)
    each, one = np.arange(len(sets)), np.zeros(len(sets), int)
    kept = ngram_join.block_near(one, each, sizes, marks, 0, 0)
    assert all(kept[i] and kept[j] for i, j in pairs if ngram_join.linked(sets[i], sets[j]))
    assert not any(ngram_join.block_near(one, one, sizes, marks, 0, 0)) and not any(ngram_join.block_near(one, each, sizes, marks, 0, 1))
    apart = [4 + 5 * k for k in range(4, 10)]  # with no part in common
    assert not any(ngram_join.block_near(one[apart], each[apart], sizes[apart], [marks[i] for i in apart], 0, 0)[:-1])


def test_sketch_grows_with_the_text(spark, monkeypatch):
    assert [shingles.sketch_bits_of_text(n) for n in (0, 1, 6144 << 18, (6144 << 18) + 6144, 6144 << 20, 1 << 60)] == [18, 18, 18, 19, 20, 22]
    texts = variants(4, 30, 50, 4) + ["one two three four five six"] * 300
    about, small = ngram_join.profile(frame(spark, texts))
    monkeypatch.setattr(shingles, "sketch_bits_of_text", lambda size: 20 if size == sum(map(len, texts)) else 18)
    again, large = ngram_join.profile(frame(spark, texts))
    assert small.shape == (2, 1 << 18) and large.shape == (2, 1 << 20) and large.max() == 300
    assert small.sum(1).tolist() == large.sum(1).tolist() == [sum(r["n_shingles"] for r in about.collect())] * 2


def test_counters_take_the_bytes_they_need():
    for most, width in ((255, 1), (256, 2), (65_536, 4)):
        raw = ngram_join.narrow(np.array([0, 7, most], np.uint32))
        assert len(raw) == 3 * width and np.frombuffer(raw, f"<u{width}").tolist() == [0, 7, most]


@pytest.mark.parametrize("local", [0, 500_000])
def test_components(spark, monkeypatch, local):
    monkeypatch.setattr("tidelog.llm.components.LOCAL_EDGES", local)
    r = random.Random(3)
    chain = [(i, i + 1) for i in range(1, 300)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    edges = [(a, b) if r.random() < 0.5 else (b, a) for a, b in chain + star + [(5000, 5001)]]
    r.shuffle(edges)
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    got = {x["set_id"]: x["root"] for x in components(df).collect()}
    assert got == {i: 1 for i in range(1, 301)} | {1000 + i: 1000 for i in range(200)} | {5000: 5000, 5001: 5000}
    assert components(df.limit(0)).collect() == []
