"""BPE, token counts, fingerprints, mixing."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

bpe = pytest.importorskip("framewell.llm.bpe")
from framewell.llm import mixing, token_count, winnow  # noqa: E402

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "word stream " * 20000
ROWS = [
    (1, "Plain words, it's 42 of them.", "en", "a", 10),
    (2, None, None, None, None),
    (3, "", "en", "b", 0),
    (4, LONG, "en", "a", len(LONG)),
    (5, "x" * 3000, "de", "b", 3000),
    (2**60 + 1, "ΑΣ́ İß <|endoftext|> \x1c\x85 中文😀 tail", "el", "a", 5),
    (None, "no id at all here", "en", "c", 4),
    (1, "Plain words, it's 42 of them.", "en", "a", 10),
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


def docs(spark, rows=ROWS):
    d = spark.createDataFrame(rows, DOCS)
    return d.withColumns({"size": F.lit("clash"), "row": F.lit(1), "_text": F.lit(2), "n_tokens": F.lit(3), "copies": F.lit(4), "cls": F.lit(5), "_bucket": F.lit("x")})


def random_texts(n, seed=3):
    rng = random.Random(seed)
    letters = list("aAbé ÉΣσİ́̈ \n\t'sd12³½<|>endoftext|中文😀​\x1c\x85.,!-_ǅßﬁ") + ["<|endoftext|>", "<|startoftext|>", "it's", " "]
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 120))) for _ in range(n)]


def test_encode_and_decode_as_the_library(library):
    own = bpe.load(bpe.default_path())
    for text in random_texts(1500):
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids
        assert own.count(text) == len(ids)
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_digests(spark, library):
    found = bpe.digests(docs(spark)).collect()
    assert len(found) == len(ROWS)
    by_text = {r[1]: r for r in ROWS}
    for text in by_text:
        e = library.encode(text or "", add_special_tokens=False)
        expected = (len(e.ids), hashlib.sha256(" ".join(map(str, e.ids)).encode()).hexdigest(), hashlib.sha256(library.decode(e.ids, skip_special_tokens=False).encode()).hexdigest())
        own = [tuple(r)[1:] for r in found if r["doc_id"] == by_text[text][0]]
        assert own and set(own) == {expected}
    assert bpe.digests(docs(spark, [])).count() == 0


def test_round_trip_columns(spark):
    own = bpe.load(bpe.default_path())
    d = docs(spark).where("doc_id = 1").limit(1)
    row = bpe.decode(bpe.encode(d)).first()
    assert row["decoded"] == own.decode(row["token_ids"]) and len(row["token_ids"]) == len(own.encode(row["text"]))


def test_chunked_counts_are_whole_counts(library):
    rng = random.Random(5)
    for text in [*random_texts(1200, 8), "a" * 5000, ("b" * 300 + " ") * 20, "<|endoftext|>" * 50]:
        whole = len(library.encode(text, add_special_tokens=False))
        assert token_count.count(library, text, rng.choice([8, 16, 40]), rng.choice([2, 4, 8])) == whole


def test_counts_without_the_normalizer(library):
    """Where the normalizer is left out, each character, their neighbourhoods, white space and special strings count as the library has it."""
    path = bpe.default_path()
    bare, _ = token_count.load_bare(path)
    space = re.compile(r"[ \t-\r\x85\xa0]+")
    for c in filter(token_count._STABLE.fullmatch, map(chr, range(0x10000))):
        assert space.sub(" ", c.lower()) == library.normalizer.normalize_str(c)
    rng = random.Random(6)
    stable = [*filter(token_count._STABLE.fullmatch, map(chr, range(0x2100)))]
    some = list("aAzZ '\u2019\u0130\u0131\xdf\xb5\u01c5\u023a \n\t\x0b\x1c\x1f\x85\xa0\xad12\xbd.,<|>") + ["it's", "WE'LL", "  ", "<|ENDOFTEXT|>", "<|endoftext|", "word ", "Stream "]
    texts = ["".join(rng.choice(rng.choice((some, stable))) for _ in range(rng.randint(0, 150))) for _ in range(1500)]
    used = 0
    for text in [*texts, *random_texts(300, 9), "<|endoftext|>", "a<|ENDOFTEXT|>b", "e\u0301 E\u0301", "\u03a3\u0391\u03a3", "\u2000a\u2028b"]:
        t, form = token_count.prepared(path, text)
        used += t is bare
        whole = library.encode(text, add_special_tokens=False).ids
        assert t.encode(form, add_special_tokens=False).ids == whole
        assert token_count.count(t, form) == token_count.count(t, form, 16, 4) == len(whole)
    assert used > 500  # many hold a special string
    assert [token_count.prepared(path, x)[0] is bare for x in ("Plain", "<|ENDOFTEXT|>", "e\u0301", "\u03a3", "\u2000")] == [True, False, False, False, False]


def test_bare_only_for_known_steps(tmp_path):
    import json

    with open(bpe.default_path(), encoding="utf-8") as f:
        file = json.load(f)
    file["normalizer"] = {"type": "Lowercase"}
    path = str(tmp_path / "other.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(file, f)
    assert token_count.load_bare(path) is None and token_count.prepared(path, "Plain") == (token_count.load(path), "Plain")


def test_token_counts(spark, library):
    found = {r["doc_id"]: r for r in token_count.token_counts(docs(spark), chunk=4096, overlap=64).collect()}
    for i, text, *_ in ROWS:
        n = len(library.encode(text or "", add_special_tokens=False))
        assert (found[i]["n_tokens"], found[i]["n_bytes"], found[i]["over_limit"]) == (n, len((text or "").encode()), n > 2048)
    assert token_count.token_counts(docs(spark, [])).count() == 0


def brute_fingerprint(text, grams=None):
    """Chosen places of the gram hashes, which come from Spark."""
    n, chosen = len(grams), []
    for i in range(max(n - winnow.WINDOW + 1, min(n, 1))):
        window = grams[i : i + winnow.WINDOW]
        low = min(window)
        chosen.append((low, i + max(j for j, h in enumerate(window) if h == low)))
    return list(dict.fromkeys(chosen))


def brute_hashes(tokens, token_hash):
    """Rolling hashes: each from the one before, less the token that leaves and with the one that enters."""
    t = [token_hash[x] for x in tokens]
    t += [0] * (winnow.K - len(t)) if t else []
    out, top = [], pow(winnow.BASE, winnow.K - 1, winnow.PRIME)
    for i in range(len(t) - winnow.K + 1):
        if i:
            h = ((out[-1] - t[i - 1] * top) * winnow.BASE + t[i + winnow.K - 1]) % winnow.PRIME
        else:
            h = 0
            for x in t[: winnow.K]:
                h = (h * winnow.BASE + x) % winnow.PRIME
        out.append(h)
    return out


def brute_entries(text, token_hash, tokens):
    grams = brute_hashes(tokens, token_hash)
    return [h * winnow._PLACES + winnow._PLACES - 1 - p for h, p in brute_fingerprint(text, grams)]


def token_hashes(spark, tokens):
    d = spark.createDataFrame([(x,) for x in sorted(set(tokens))], "t string")
    return {r["t"]: r["h"] for r in d.select("t", F.pmod(F.xxhash64("t"), F.lit(winnow.PRIME)).alias("h")).collect()}


def test_winnowing_is_brute_force(spark):
    texts = ["a b c d e f g h i j k l m n o p", "a a a a a a a a a a a a", "one two", "", None, "x" * 100, "la " * 50 + "end", "ä ö ü ß é"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = winnow.entries(d, "text", "fp", sliding=True).collect()
    known = token_hashes(spark, [x for t in texts for x in brute_tokens(t)])
    for r in rows:
        assert r["fp"] == brute_entries(r["text"], known, brute_tokens(r["text"])), r["text"]


def test_fingerprint_query_is_brute_force(spark, tmp_path):
    """All columns of the query, over a table with odd rows; ids repeat, and a third of them are null."""
    from framewell.llm import queries

    rng = random.Random(4)
    rows = [(i * 7 % 101, " ".join(rng.choices("abcdefg", k=rng.randint(0, 60))) + "x" * rng.choice([0, 0, 30]), "en", "s", 0) for i in range(101)]
    rows += [(500, None, "en", "s", 0), (501, "", "en", "s", 0), (502, "é😀" * 400, "en", "s", 0), (2**62, "last", "en", "s", 0), (-5, "neg a b c d e", "en", "s", 0)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r for r in queries.op5_fingerprints(spark, str(tmp_path)).collect()}
    order = sorted(((i, t or "") for i, t, *_ in rows), reverse=True)
    after = {i: order[(n + 1) % len(order)][1] for n, (i, _) in enumerate(order)}
    after_id = {i: order[(n + 1) % len(order)][0] for n, (i, _) in enumerate(order)}
    text = dict(order)
    cut = {i: text[i][: len(text[i]) - len(text[i]) // 3] + after[i][: len(text[i]) // 3] for i in text}
    known = token_hashes(spark, [x for t in [*text.values(), *cut.values()] for x in brute_tokens(t)])
    entries = lambda t: brute_entries(t, known, brute_tokens(t))
    told = lambda t: hashlib.sha256(" ".join(f"{x:X}" for x in entries(t)).encode()).hexdigest()
    of = lambda t: {x >> winnow.PLACE_BITS for x in entries(t)}
    near = lambda a, b: len(of(a) & of(b)) / len(of(a) | of(b)) if of(a) | of(b) else 1.0
    assert len(found) == len(rows)
    for i, t in text.items():
        r = found[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(cut[i].encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (told(t), told(cut[i]))
        assert r["next_id"] == after_id[i]
        assert r["near_edited"] == pytest.approx(near(t, cut[i])) and r["near_next"] == pytest.approx(near(t, after[i]))


def test_frequent_ids_are_split(spark):
    """A third of all ids are null and another third equal: their rows are cut by hash, and none is lost."""
    rows = [(None if i % 3 == 0 else 77 if i % 3 == 1 else i, f"text {i} of many words {i * i}", "en", "s", 0) for i in range(3000)]
    d = docs(spark, rows).select("doc_id", F.col("text"))
    placed, _ = winnow._buckets(d, "doc_id", 2000, 64)
    most = placed.groupBy("_bucket").count().agg(F.max("count")).first()[0]
    assert most < 300
    ordered = [tuple(r) for r in placed.orderBy("_bucket", F.desc("_k"), "_h").select("_k", "_h").collect()]
    assert ordered == sorted(ordered, key=lambda r: (-r[0], r[1]))
    found = winnow.edited(docs(spark, rows), bytes_each=2000, quantiles=64).select("_text", "_edited").collect()
    assert len(found) == 3000 and len({r["_text"] for r in found}) == 3000
    follows = {r["_text"]: r["_edited"] for r in found}
    assert all(v.startswith(k[: len(k) - len(k) // 3]) and len(v) == len(k) for k, v in follows.items())


def brute_tokens(text, piece=winnow.PIECE):
    runs = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return [run[i : i + piece] for run in runs for i in range(max(len(run) - piece + 1, 1))]


def test_tokens_are_brute_force(spark):
    texts = random_texts(300) + ["", None, "中" * 7, "中" * 8, "中" * 9, "😀" * 30, " 😀a" * 9 + "😀中文" * 9, "x" * 5000, "a\u3000b\x0b" + "é" * 20]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for piece in (1, 2, winnow.PIECE):
        found = {r["doc_id"]: r["t"] for r in d.select("doc_id", winnow.tokens(F.col("text"), piece).alias("t")).collect()}
        assert all(found[i] == brute_tokens(t, piece) for i, t in enumerate(texts))


def test_passages_at_any_offset_share_a_choice(spark):
    """In text without spaces, a passage of the guaranteed length is found wherever it begins in its run."""
    rng = random.Random(8)
    letters = "的一是在不了有和人这中大为上个国我以要他時来用们生到作地于出就分对成会可主发年动同工也能下过子说产种面而方后多定行学法所民得经十三之进着等部度家电力里如水化高自二理起小物现实加量都两体制机当使点从业本去把性好应开它合还因由其些然前外天政四日那社义事平形相全表间样与关各重新线内数正心反你明看原又么利比或但质气第向道命此变条只没结解问意建月公无系军很情者最立代想已通并提直题党程展五果料象员革位入常文总次品式活设及管特件长求老头基资边流路级少图山统接知较将组见计别她手角期根论运农指几九区强放决西被干做必战先回则任取据处队南给色光门即保治北造百规热领七海口东导器压志世金增争济阶油思术极交受联什认六共权收证改清己美再采转更单风切打白教速花带安场身车例真务具万每目至达走积示议声报斗完类八离华名确才科张信马节话米整空元况今集温传土许步群广石记需段研界拉林律叫且究观越织装影算低持音众书布复容儿须际商非验连断深难近矿千周委素技备半办青省列习响约支般史感劳便团往酸历市克何除消构府称太准精值号率族维划选标写存候毛亲快效斯院查江型眼王按格养易置派层片始却专状育厂京识适属圆包火住调满县局照参红细引听该铁价严"
    piece = lambda n: "".join(rng.choice(letters) for _ in range(n))
    least = winnow.PIECE + winnow.K + winnow.WINDOW - 2
    rows = []
    for i in range(16):
        passage = piece(least)
        rows.append((i, piece(40) + passage + piece(30), piece(40 + i) + passage + piece(25)))
    whole = piece(500)
    rows.append((100, whole, "￥" + whole))
    d = spark.createDataFrame(rows, "doc_id bigint, text string, other string")
    d = winnow.entries(winnow.entries(d, "text", "a", sliding=True), "other", "b", sliding=True)
    d = d.select("doc_id", winnow.hashes("a").alias("a"), winnow.hashes("b").alias("b"))
    found = {r["doc_id"]: r for r in d.select("doc_id", F.size(F.array_intersect("a", "b")).alias("both"), winnow.likeness(F.col("a"), F.col("b")).alias("near")).collect()}
    assert all(found[i]["both"] >= 1 for i in range(16))
    assert found[100]["near"] > 0.9


def test_edited_fingerprints_slide(spark):
    """The query's fingerprints: documents whose common paragraph begins at different places are alike."""
    text = "".join(chr(0x4E00 + (i * i * 31 + i * 7) % 5000) for i in range(400))
    rows = [(1, text, "zh", "s", 0), (2, "二" + text, "zh", "s", 0)]
    found = winnow.edited(docs(spark, rows)).select("doc_id", winnow.likeness(F.col("_hashes"), F.col("_next")).alias("near")).collect()
    assert len(found) == 2 and all(r["near"] > 0.9 for r in found)


def test_edited_texts(spark):
    rows = [(i, "word%d " % i * (i % 7 + 3), "en", "s", 0) for i in range(60)] + [(100, None, "en", "s", 0), (101, "", "en", "s", 0), (102, "é😀" * 9, "en", "s", 0), (103, "ab", "en", "s", 0)]
    d = docs(spark, rows)
    found = {r["doc_id"]: r for r in winnow.edited(d, bytes_each=64).select("doc_id", "_chars", "_edited").collect()}
    order = sorted(rows, reverse=True, key=lambda r: r[0])
    for k, (i, text, *_) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        cut = len(text) // 3
        assert found[i]["_chars"] == len(text) and found[i]["_edited"] == text[: len(text) - cut] + after[:cut]
    assert winnow.edited(docs(spark, [])).count() == 0
    one = winnow.edited(docs(spark, [(7, "abcdef", "en", "s", 6)])).first()
    assert one["_edited"] == "abcdab"
    twice = winnow.edited(docs(spark, [(7, "abcdef", "en", "s", 6)] * 3 + [(None, "x y z", "en", "s", 5)])).collect()
    assert len(twice) == 4 and {r["_edited"] for r in twice if r["doc_id"] == 7} == {"abcdab", "abcdx "}


def brute_targets(sizes, share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    full, total = set(), share * sum(sizes.values())
    while True:
        left = total - sum(most * sizes[s] for s in full)
        weight = sum(w[s] for s in names if s not in full)
        new = {s for s in names if s not in full and left * w[s] / weight > most * sizes[s]}
        if not new:
            return {s: most * sizes[s] if s in full else left * w[s] / weight for s in names}
        full |= new


def test_targets_are_brute_force(spark):
    rng = random.Random(1)
    for _ in range(4):
        sizes = {s: rng.choice([0, 1, 10, 1000, rng.randint(1, 10**6)]) for s in [*"abcdefgé", "Z", "src10", "src9", None]}
        d = spark.createDataFrame(list(sizes.items()), "source string, size bigint")
        found = {r["source"]: r["target"] for r in mixing.source_targets(d).collect()}
        for s, t in brute_targets(sizes).items():
            assert found[s] == pytest.approx(t, rel=1e-9, abs=1e-6)


def test_mix(spark):
    rows = [(i, "w " * (i % 50), "en", f"s{i % 3}" if i % 2 else "hot", 0) for i in range(3000)]
    d = docs(spark, rows)
    c = mixing.copies(d).collect()
    assert len(c) == 3000 and all(r["size"] == r["row"]["doc_id"] % 50 for r in c)
    taken = {}
    for r in c:
        assert 0 <= r["copies"] <= 2
        t = taken.setdefault(r["row"]["source"], [0, r["target"]])
        t[0] += r["size"] * r["copies"]
    for got, target in taken.values():
        assert abs(got - target) < 0.1 * target
    mixed = mixing.mix(d)
    assert mixed.columns == d.columns and mixed.count() == sum(r["copies"] for r in c)
    assert sorted(r["doc_id"] for r in mixed.collect()) == sorted(r["doc_id"] for r in mixing.mix(d.repartition(7)).collect())
    assert mixing.mix(docs(spark, [])).count() == 0
    assert {r["size"] for r in mixing.copies(docs(spark, [(1, None, None, None, None)])).collect()} == {0}
