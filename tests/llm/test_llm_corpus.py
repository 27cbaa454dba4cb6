"""Top-k search, quality classifier, n-gram Jaccard join, the pipeline and the queries' SQL."""

import collections
import hashlib
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

jaccard = pytest.importorskip("framewell.llm.jaccard")
from framewell.llm import cotrain, queries, topk  # noqa: E402

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SMALL = "/root/testdata/sf0.001"


def with_clashes(d):
    return d.withColumns({"cls": F.lit("x"), "id": F.lit(1), "first": F.lit(2), "side": F.lit(3), "keep": F.lit(4), "y": F.lit(5), "k": F.lit(6), "v": F.lit(7), "stays": F.lit(8)})


def brute_sets(texts):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD))
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def brute_components(rows):
    sets = brute_sets([t for _, t in rows])
    where = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            where[g].append(i)
    both = collections.Counter((a, b) for v in where.values() for n, b in enumerate(v) for a in v[:n])
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in both.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            a, b = root(a), root(b)
            parent[a] = b
    least = {}
    for i, (k, _) in enumerate(rows):
        r = root(i)
        least[r] = min((x for x in (least.get(r), k) if x is not None), default=None)
    return [(k, len(sets[i]), least[root(i)]) for i, (k, _) in enumerate(rows)]


def near_corpus(n, seed, words=60):
    """Texts with copies, edits about the threshold, chains, a shared passage and a hot text."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choices(vocab, k=25))
    base, rows = [], []
    for i in range(n):
        kind = rng.random()
        if kind < 0.35 or not base:
            t = rng.choices(vocab, k=rng.choice([1, 2, 3, 4, 5, 6, 8, words, 3 * words]))
            base.append(t)
        elif kind < 0.8:
            t = list(rng.choice(base[-20:]))
            for _ in range(rng.choice([0, 1, 1, 2, 3, max(1, len(t) // 40)])):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            base.append(t)
        else:
            t = base[0]
        text = " ".join(t) if rng.random() < 0.8 else "\n".join(t).upper()
        rows.append((i * 3, text + (" " + passage if rng.random() < 0.3 else "")))
    return rows


@pytest.mark.parametrize("seed,chunk", [(1, 2048), (2, 16), (3, 5)])
def test_components_lose_no_link(spark, seed, chunk):
    rows = near_corpus(250, seed) + [(10001, None), (10002, ""), (10003, " \n"), (10004, "one"), (10005, "ONE"), (10006, "x " * 30000), (10007, "x " * 30001 + "y")]
    d = with_clashes(spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], DOCS))
    expected = sorted(brute_components(rows))
    for least_frequent in (jaccard.FREQUENT, 9):
        found = sorted(tuple(r) for r in jaccard.components(d, chunk=chunk, part_chars=2000, least_frequent=least_frequent).collect())
        assert found == expected


def test_classes_that_share_a_name(spark):
    rows = [(i, f"text {i % 700}") for i in range(2000)]
    keyed, of = jaccard._classes(spark.createDataFrame(rows, "id bigint, text string"), name_digits=2)
    assert of.count() == 700 and keyed.groupBy("text").agg(F.count_distinct("cls").alias("n")).where("n > 1").isEmpty()
    with pytest.raises(RuntimeError):
        jaccard._classes(spark.createDataFrame(rows, "id bigint, text string"), name_digits=1, most=5)


def test_frequent_grams_decide_as_others(spark):
    """Texts made of passages that most others share, so that prefixes reach into the frequent n-grams."""
    rng = random.Random(12)
    passages = [" ".join(f"p{i}w{j}" for j in range(30)) for i in range(4)]
    rows = []
    for i in range(160):
        own = " ".join(f"own{i}x{j}" for j in range(rng.choice([0, 0, 3, 12, 60])))
        rows.append((i, " ".join([*rng.sample(passages, rng.randint(1, 4)), own])))
    d = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], DOCS).repartition(2)
    found = sorted(tuple(r) for r in jaccard.components(d, chunk=8, least_frequent=15).collect())
    assert found == sorted(brute_components(rows))


def test_components_of_odd_tables(spark):
    make = lambda rows: spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], DOCS)
    assert jaccard.components(make([])).count() == 0
    assert sorted(tuple(r) for r in jaccard.components(make([(1, None), (2, "")])).collect()) == [(1, 0, 1), (2, 0, 2)]
    same = jaccard.components(make([(5, "a b c d e f")] * 3 + [(4, "a b c d e f")])).collect()
    assert sorted(tuple(r) for r in same) == [(4, 2, 4)] + [(5, 2, 4)] * 3
    text = " ".join(f"u{i}" for i in range(60))
    odd = jaccard.components(make([(None, text), (9, text.replace("u59", "v"))])).collect()
    assert sorted(r["component_id"] for r in odd) == [9, 9]


def test_tree_join_is_brute_force():
    rng = np.random.default_rng(6)
    for n, m in ((40, 0), (70, 55), (300, 0), (1, 0), (17, 300)):
        base = [np.unique(rng.integers(0, 2**63, rng.integers(4, 200)).astype(np.uint64)) for _ in range(8)]
        sets = []
        for _ in range(n + m):
            s = base[rng.integers(8)]
            s = np.unique(np.r_[s[rng.random(len(s)) > 0.12], rng.integers(0, 2**63, rng.integers(0, 6)).astype(np.uint64)])
            sets.append(s if len(s) else base[0])
        left, right = sets[:n], sets[n:]
        links = jaccard.tree_join(jaccard.Tree(left), jaccard.Tree(right) if m else None)

        def label(pairs):
            parent = list(range(n + m))

            def root(x):
                while parent[x] != x:
                    x = parent[x]
                return x

            for a, b in pairs:
                parent[root(a)] = root(b)
            groups = collections.defaultdict(set)
            for i in range(n + m):
                groups[root(i)].add(i)
            return sorted(map(sorted, groups.values()))

        pairs = [(i, j) for i in range(n + m) for j in range(i) if (m == 0 or (i < n) != (j < n)) and 100 * (b := len(np.intersect1d(sets[i], sets[j]))) >= 75 * (len(sets[i]) + len(sets[j]) - b)]
        assert label(links) == label(pairs)
        assert len(links) <= n + m - 1


def test_top_k_is_brute_force(spark):
    rng = random.Random(9)
    rows = [(i, [float(rng.choice([-1, 1]) * rng.random() ** 6) for _ in range(8)]) for i in range(400)]
    rows += [(1000, rows[0][1]), (1050, rows[0][1]), (1001, rows[0][1])]  # ties
    rows += [(1100, None), (1150, []), (1200, [1.0, None] + [0.0] * 6), (1250, [float("nan")] * 8), (1300, [float("inf")] + [0.0] * 7), (1350, [1.0, 2.0]), (1400, [1.0, 2.0]), (None, rows[1][1])]
    d = with_clashes(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"))
    vectors = d.select("vec_id", topk.quantize("embedding").alias("v"))
    good = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in e]) for i, e in rows if i is not None and e and all(x is not None and np.isfinite(x) for x in e)]
    expected = set()
    for q, v in good:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q and len(w) == len(v))[:5]
            expected |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    for block in (4096, 64):
        found = {tuple(r) for r in topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), block=block, query_block=5).select("query_id", "rank", "vec_id", "score").collect()}
        assert found == expected
    assert topk.top_k(vectors.limit(0), vectors.limit(0)).count() == 0


def brute_top(cand, ids, query, own, k=5):
    return sorted((-int(s), int(i)) for s, i in zip(cand @ query, ids) if i != own)[:k]


def test_bounds_stop_searches_of_vectors_like_the_tables():
    """Unit vectors in 64 dimensions: the bounds stop most queries, though late, and the result is brute force's."""
    rng = np.random.default_rng(1)
    v = rng.normal(size=(3000, 64))
    v = np.floor(256 * v / np.linalg.norm(v, axis=1)[:, None]).astype(np.int64)
    ids = rng.permutation(3000) * 7
    lists, read = topk.Lists(v, ids), []
    for i in range(60):
        at, score, depth = lists.search(v[i], int(ids[i]), 5)
        assert [(-s, j) for s, j in zip(score.tolist(), ids[at].tolist())] == brute_top(v, ids, v[i], ids[i])
        read.append(depth)
    assert np.mean(np.array(read) < 1) > 0.9 and np.mean(read) < 0.95


def test_bounds_stop_early_where_few_stand_out():
    rng = np.random.default_rng(1)
    cand = rng.integers(-20, 20, (2000, 6))
    cand[:9] = rng.integers(200, 250, (9, 6))
    ids, lists = np.arange(2000), topk.Lists(cand, np.arange(2000))
    for _ in range(50):
        query = rng.integers(1, 100, 6)
        at, score, depth = lists.search(query, 5000, 5)
        assert [(-s, j) for s, j in zip(score.tolist(), at.tolist())] == brute_top(cand, ids, query, 5000)
        assert depth < 0.1


def test_searches_of_odd_blocks():
    rng = np.random.default_rng(2)
    for n, dims in ((1, 3), (4, 1), (6, 2), (21, 5), (300, 3), (900, 8)):
        cand = rng.integers(-3, 4, (n, dims))  # many ties
        ids = rng.integers(0, max(n // 2, 1), n)  # and repeated ids
        for scale in (1, 10**7, 10**8):  # beyond what float64 holds exactly
            lists = topk.Lists(cand * scale, ids)
            for query in (rng.integers(-3, 4, dims) * scale, np.zeros(dims, int), cand[0] * scale):
                at, score, _ = lists.search(query, int(ids[0]), 5)
                assert [(-s, j) for s, j in zip(score.tolist(), ids[at].tolist())] == brute_top(cand * scale, ids, query, ids[0])


def test_top_k_of_repeated_ids(spark):
    """Rows of one query id share its k best; candidates of one id are candidates each."""
    rows = [(50, [4, 0]), (50, [0, 4]), *[(1, [2, 1])] * 4, (2, [1, 3]), (3, [3, 0]), (50, [9, 9])]
    v = spark.createDataFrame(rows, "vec_id bigint, v array<bigint>")
    found = sorted(tuple(r) for r in topk.top_k(v, v.where("vec_id = 50"), k=4, block=2).collect())
    scores = sorted(((-int(np.dot(q, c)), i) for j, q in rows if j == 50 for i, c in rows if i != 50))[:4]
    assert found == [(50, n + 1, i, -s) for n, (s, i) in enumerate(scores)]


def quality_corpus(n, seed=3):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.75
        words = ["".join(rng.choices("abcdeilnorst", k=rng.randint(2, 8))) for _ in range(rng.randint(8, 80))]
        if good:
            text = ". ".join(" ".join(words[j : j + 8]).capitalize() for j in range(0, len(words), 8)) + "."
        else:
            text = " ".join(w + rng.choice(["$$$", "###", "%%%"]) for w in words) if rng.random() < 0.5 else " ".join([words[0]] * len(words))
        rows.append((i, text, rng.choice(["en", "fr"]), f"src{i % 5}", len(text)))
        if i % 3 == 0:
            labels.append((i, int(good), 0))
        rows[-1] = rows[-1] + (good,)
    return rows, labels


def test_quality_on_held_out_rows(spark):
    rows, labels = quality_corpus(900)
    d = with_clashes(spark.createDataFrame([r[:5] for r in rows], DOCS))
    known = spark.createDataFrame([*labels, (None, 1, 0), (7, None, 0), (99999, 1, 0), (0, labels[0][1], 1)], "doc_id bigint, quality int, toxic int")
    model = cotrain.fit(d, known)
    found = {r["doc_id"]: r for r in cotrain.score(d, model).collect()}
    taught = {i for i, *_ in labels}
    held = [r for r in rows if r[0] not in taught]
    assert sum(found[r[0]]["keep"] == r[5] for r in held) >= 0.98 * len(held)
    assert np.mean([found[r[0]]["keep"] for r in held if r[5]]) >= 0.99
    again = cotrain.fit(d.repartition(7), known.repartition(3))
    assert np.allclose(again.weights, model.weights)
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "", "", 0), (None, "a b. " * 100000, "en", "src1", 5), (2**60 + 1, "x", None, "s", None)], DOCS)
    out = cotrain.score(odd, model, columns=("doc_id", "text", "lang", "source", "n_chars")).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in out)[2][1] == 2**60 + 1 and all(0 <= r["score"] <= 1 for r in out)


def test_quality_without_labels(spark):
    d = spark.createDataFrame([(1, "a", "en", "s", 1)], DOCS)
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert cotrain.score(d, cotrain.fit(d, none)).first()["keep"]
    bad = spark.createDataFrame([(1, 0, 0)], none.schema)
    assert not cotrain.score(d, cotrain.fit(d, bad)).first()["keep"]
    empty = d.limit(0)
    assert cotrain.score(empty, cotrain.fit(empty, none)).count() == 0


def write_tables(spark, folder, rows, labels):
    spark.createDataFrame(rows, DOCS).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.mode("overwrite").parquet(f"{folder}/labels.parquet")
    return str(folder)


def brute_mix(rows, seed=11):
    """How often the mix has each of rows(doc_id, text, ..., source, ...), from the contract's own words."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows]
    names = sorted({r[3] for r in rows if r[3] is not None}, key=lambda x: x.encode()) + [None] * any(r[3] is None for r in rows)
    total = {s: sum(n for n, r in zip(size, rows) if r[3] == s) for s in names}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    full, every = set(), 1.5 * sum(total.values())
    while True:
        rest, weights = every - sum(2 * total[s] for s in full), sum(weight[s] for s in names if s not in full)
        over = {s for s in names if s not in full and rest * weight[s] / weights > 2 * total[s]}
        if not over:
            break
        full |= over
    rate = {s: (2.0 if s in full else rest * weight[s] / weights / total[s]) if total[s] else 0.0 for s in names}
    u = lambda i: int(hashlib.md5(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:13], 16) / 2**52
    return [int(rate[r[3]]) + (u(r[0]) < rate[r[3]] - int(rate[r[3]])) for r in rows]


def test_pipeline_is_its_stages_by_brute_force(spark, tmp_path):
    """Classifier: its own scores against the documents' true quality.  All else: independent code."""
    from tokenizers import Tokenizer

    import corpus_pipeline as p
    from framewell.llm import bpe

    rows, labels = quality_corpus(300, seed=5)
    good = {r[0] for r in rows if r[5]}
    rows = [r[:5] for r in rows]
    rows += [(i + 1000, rows[i][1], "en", "src0", rows[i][4]) for i in range(40)]
    good |= {i + 1000 for i in range(40) if i in good}
    sf = write_tables(spark, tmp_path, rows, labels)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = p.quality(spark, docs, sf)
    assert kept.columns == list(p.COLUMNS)
    kept = sorted(tuple(r) for r in kept.collect())
    assert len({r[0] for r in kept} ^ good) <= 0.03 * len(rows)
    unique = [r for r, (k, _, c) in zip(kept, brute_components([(r[0], r[1]) for r in kept])) if k == c]
    assert sorted(tuple(r) for r in p.near_duplicates(spark, spark.createDataFrame(kept, DOCS), sf).collect()) == unique
    times = brute_mix(unique)
    mixed = [r[0] for r, n in zip(unique, times) for _ in range(n)]
    assert sorted(r["doc_id"] for r in p.mixing_weights(spark, spark.createDataFrame(unique, DOCS), sf).collect()) == mixed
    final = p.run(spark, sf).collect()
    library = Tokenizer.from_file(bpe.default_path())
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    text = {r[0]: r[1] for r in rows}
    assert sorted(r["doc_id"] for r in final) == mixed
    for r in final:
        ids = library.encode(text[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_near_duplicates_keep_odd_rows(spark):
    import corpus_pipeline as p

    text = "a b c d e f g h"
    other = " ".join(f"n{i}" for i in range(60))
    near = other.replace("n59", "m")
    rows = [(1, text, "en", "s", 1), (1, text, "en", "s", 1), (2, text, "en", "s", 1), (3, None, "en", "s", 1), (3, None, "en", "s", 1), (None, "q", "en", "s", 1), (4, "", None, None, None)]
    out = p.near_duplicates(spark, spark.createDataFrame(rows, DOCS), "").collect()
    assert sorted(str(r["doc_id"]) for r in out) == ["1", "3", "3", "4", "None"]
    # One id with unlinked texts: each is judged by its own text, whatever the order of rows.
    rows = [(1, text, "en", "s", 1), (1, "quite another text of its own words", "en", "s", 2), (1, None, "en", "s", 3), (0, text, "en", "s", 4), (7, other, "en", "b", 5), (7, near, "en", "a", 6), (8, other, None, None, None), (None, text, "en", "s", 1), (None, "x y z", "en", "t", 1), (None, "x y z", "en", "s", 1)]
    expected = None
    for order in (rows, rows[::-1], rows[3:] + rows[:3]):
        out = sorted(map(repr, (tuple(r) for r in p.near_duplicates(spark, spark.createDataFrame(order, DOCS), "").collect())))
        assert expected in (None, out)
        expected = out
    assert len(out) == 5 and sum("quite" in x for x in out) == 1 and sum("None, 'x y z', 'en', 's'" in x for x in out) == 1 and sum(x.startswith("(7,") for x in out) == 1 and repr(rows[3]) in out
    empty = spark.createDataFrame([], DOCS)
    for stage in (p.near_duplicates, p.mixing_weights, p.encoding):
        assert stage(spark, empty, "").count() == 0


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    own = queries.queries()[name](spark, SMALL)
    theirs = con.sql(queries.oracle_sql()[name])
    columns = sorted(own.columns)
    assert columns == sorted(theirs.columns)
    assert sorted(map(repr, (tuple(r) for r in own.select(*columns).collect()))) == sorted(map(repr, theirs.select(", ".join(columns)).fetchall()))
