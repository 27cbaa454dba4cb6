"""N-gram Jaccard join with signature trees.

Two documents link when their sets of distinct word n-grams have a Jaccard similarity of at least
`similarity`.  The result is each document's set size and the smallest id it reaches by links.

1. Classes.  Documents with equal texts are one class, named by 60 bits of the text's md5; a name that
   texts of different further bits share gets others until none is shared.  Only one document of each
   class goes further.  A text that a third of all rows repeat is one row per task after a local pass.
2. Frequencies.  A first pass finds the frequent n-grams, those in very many classes (of all, at most
   2^16: see FREQUENT); they take no part in the counting, and count as rarer than none.  Each task packs its classes' n-grams into a binary row for each of `parts` ranges of
   hashes, as tokens of 32 bits within the range and 2 bytes for the owner.  A range's task counts in
   how many classes each token is and packs those of two classes or more for ranges of class names.
   Tokens only order and group n-grams: a collision adds candidates and loses none.
3. Prefixes.  With a set's n-grams in order of (frequency, hash), rarest first, two sets that link
   share one of the first n - ceil(similarity * n) + 1 of each.  N-grams of one class alone come
   first, and a class with enough of them has no partner; the others keep those of their prefix that
   occur elsewhere.
4. Blocks.  Classes that share a prefix n-gram, directly or through others, are one block.  Every link
   lies within a block.  A block of more than `chunk` classes is cut into chunks in order of set size;
   what the chunks' own joins leave outside the block's largest component meets, chunk by chunk, the
   classes that share a prefix n-gram with it: see _links().  The texts of blocks' classes, and few
   others, are shuffled once to get their sets, and of the sets those that a step joins.
5. Signature trees.  A group builds a tree for each chunk: a leaf entry has its set's token bitmap, a
   node the OR of its entries' bitmaps, and the range of their sizes.  The dual traversal starts at
   the roots and drops a node pair if its size ranges can't link, if the greatest overlap that the
   bitmaps allow is less than what the smallest sizes need, or if both nodes lie in one component
   already, since a further link would change nothing.  Entry pairs that are left are compared
   exactly.  A group returns each component's classes with its least one, never all pairs.
6. Components over the groups' forests.

Defined results: null texts and texts without words have an empty set and link with nothing, not even
each other; fewer words than n are one gram; rows that repeat an id have a row each, each by its own
text, and a null id is never a component's; equal texts link whatever their size; texts of any length
are read whole; an empty table gives an empty result; only the id and the text are read, so further
columns may have any name.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewell.llm.common import keep, let_go
from framewell.llm.graph import connected_components

N, SIMILARITY = 5, (75, 100)
CHUNK = 512
#: An n-gram in more classes than one 2^17th of all characters, or than this, is frequent.
FREQUENT = 4096
#: So many classes of those that a task holds at a time make an n-gram a candidate for that.
_OFTEN = 8
#: Components of a chunk that stand for it among a large block's chunks; it changes the cost, not the result.
HEADS = 16
BITS = 2048
#: Bits of the filter (4 MB) that keeps texts outside blocks from being shuffled; it changes the cost, not the result.
FILTER_BITS = 1 << 25
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz     ")


class _Words(dict):
    """64-bit hashes of words, held for short words up to a bound."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 32:
            if len(self) >= 1 << 17:
                self.clear()
            self[word] = h
        return h


_words = _Words()


def _mix(h: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, n: int = N) -> np.ndarray:
    """The distinct n-grams of a text as sorted 64-bit hashes."""
    words = text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    k = min(n, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):  # order matters: each step mixes what came before
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[i : len(w) - k + 1 + i]
        h ^= h >> np.uint64(29)
    return np.unique(_mix(h))


def _classes(rows: DataFrame, name_digits: int = 15, most: int = 10000) -> tuple[DataFrame, DataFrame]:
    """rows(id, text, ...) with cls, and the classes (cls, first id, chars).

    Names are 60 bits of the text's md5; 60 others tell whether texts that share a name differ, which
    few of many billions do: their names are hashed anew from both.
    """
    digest = F.md5("text")
    part = lambda at, digits: F.conv(F.substring(digest, at, digits), 16, 10).cast("long")
    keyed = rows.withColumns({"cls": part(1, name_digits), "check": part(18, 15)})
    for again in range(8):
        of = keep(keyed.groupBy("cls").agg(F.min("id").alias("first"), F.first(F.char_length("text")).alias("chars"), F.min("check").alias("lo"), F.max("check").alias("hi")))
        shared = [r[0] for r in of.where("lo <> hi").select("cls").limit(most + 1).collect()]
        if not shared:
            return keyed.drop("check"), of.drop("lo", "hi")
        if len(shared) > most:
            break
        keyed = keyed.withColumn("cls", F.when(F.col("cls").isin(shared), F.xxhash64("cls", "check", F.lit(again))).otherwise(F.col("cls")))
    raise RuntimeError("texts share names that no other name tells apart")


def _distinct(batches: Iterator[pd.DataFrame], n: int, most: int) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """(text, cls) -> classes and their sets, of `most` n-grams or so at a time; a class once, as far as is remembered."""
    done: set[int] = set()
    cls, sets, held = [], [], 0
    for b in batches:
        for text, c in zip(b["text"], b["cls"]):
            if c in done:
                continue
            if len(done) < 1 << 20:
                done.add(c)
            s = shingles(text, n)
            if len(s):
                cls.append(c)
                sets.append(s)
                held += len(s)
                if held >= most or len(cls) == 65535:
                    yield cls, sets
                    cls, sets, held = [], [], 0
    if cls:
        yield cls, sets
    _words.clear()  # workers are used again by other stages
    let_go()


def _often(batches: Iterator[pd.DataFrame], n: int, most: int) -> Iterator[pd.DataFrame]:
    """(text, cls) -> n-grams that several classes have, and how many."""
    for _, sets in _distinct(batches, n, most):
        grams, count = np.unique(np.concatenate(sets), return_counts=True)
        some = count >= _OFTEN
        yield pd.DataFrame({"gram": grams[some].astype(np.int64), "count": count[some]})


def _pack(batches: Iterator[pd.DataFrame], n: int, parts: int, most: int, frequent: np.ndarray, similarity: tuple[int, int]) -> Iterator[pd.DataFrame]:
    """(text, cls) -> for each range of hashes (part, data): classes, sizes, tokens, places of owners.

    A class's size is told in the range of its least hash only, and is 0 in the others.  Frequent n-grams
    (a sorted array) aren't told; rows of part -1 - p have for the p-th range of class names how many of
    them each class has, and those of its prefix, which begins with all others.
    """
    wide, shift = _width(parts), _shift(parts)

    def split(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The other n-grams, and the places of the frequent ones."""
        at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
        has = frequent[at] == s
        return s[~has], at[has]

    def few(cls: list[int], sets: list[np.ndarray]) -> tuple[list[tuple], list[int], list[np.ndarray]]:
        names, counts, owner, gram = [], [], [], []
        left_cls, left = [], []
        for c, s in zip(cls, sets):
            light, heavy = split(s)
            if len(heavy):
                take = max(len(s) - int(_need(len(s), similarity)) + 1 - len(light), 0)
                owner += [len(names)] * len(heavy[:take])
                gram += heavy[:take].tolist()
                names.append(c)
                counts.append(len(heavy))
            if len(light):
                left_cls.append(c)
                left.append(light)
        names, counts, owner, gram = (np.array(x, np.int64) for x in (names, counts, owner, gram))
        to = names % parts
        rows = []
        for p in np.unique(to):
            mine = np.flatnonzero(to == p)
            place = np.full(len(names), -1)
            place[mine] = np.arange(len(mine))
            of = place[owner] >= 0 if len(owner) else np.zeros(0, bool)
            rows.append((int(-1 - p), names[mine].tobytes() + counts[mine].tobytes() + place[owner[of]].astype(np.int64).tobytes() + gram[of].tobytes(), len(mine), int(of.sum())))
        return rows, left_cls, left

    for cls, sets in _distinct(batches, n, most):
        rows: list[tuple] = []
        if len(frequent):
            rows, cls, sets = few(cls, sets)
        if cls:
            size = np.array([len(x) for x in sets])
            h = np.concatenate(sets)
            owner = np.repeat(np.arange(len(cls), dtype=np.uint16), size)
            part = h // wide
            low = ((h - part * wide) >> shift).astype(np.uint32)
            # Two n-grams of one class that share a token are neighbours, as hashes are sorted.
            twice = np.r_[False, (owner[1:] == owner[:-1]) & (part[1:] == part[:-1]) & (low[1:] == low[:-1])]
            first = np.r_[0, np.cumsum(size)[:-1]]
            told = size.astype(np.uint64) | np.add.reduceat(twice, first).astype(np.uint64) << np.uint64(40)
            told_in = part[first]
            at = np.flatnonzero(~twice)
            at = at[np.argsort(part[at], kind="stable")]
            part, low, owner = part[at], low[at], owner[at]
            cut = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
            names = np.array(cls, np.int64)
            for p, (x, y) in enumerate(zip(cut, cut[1:])):
                if y > x:
                    o, place = np.unique(owner[x:y], return_inverse=True)  # only the owners that occur here go along
                    s = np.where(told_in[o] == p, told[o], np.uint64(0))
                    rows.append((p, names[o].tobytes() + s.tobytes() + low[x:y].tobytes() + place.astype(np.uint16).tobytes(), len(o), int(y - x)))
        yield pd.DataFrame(rows, columns=["part", "data", "owners", "grams"])


def _width(parts: int) -> np.uint64:
    return np.uint64(-(-(1 << 64) // parts) if parts > 1 else (1 << 64) - 1)


def _shift(parts: int) -> np.uint64:
    """So many low bits of an offset within a range are dropped to keep 32."""
    return np.uint64(max(0, int(_width(parts)).bit_length() - 32))


def _unpack(data: bytes, owners: int, grams: int) -> tuple[np.ndarray, ...]:
    a, b, c = 8 * owners, 16 * owners, 16 * owners + 4 * grams
    return np.frombuffer(data[:a], np.int64), np.frombuffer(data[a:b], np.uint64), np.frombuffer(data[b:c], np.uint32), np.frombuffer(data[c:], np.uint16)


def _count(b: pd.DataFrame, parts: int) -> pd.DataFrame:
    """One range of hashes -> for ranges of class names: sizes told here, shared tokens and their counts."""
    part = int(b["part"].iloc[0])
    if part < 0:  # frequent n-grams' rows go on to their range of names as they are
        return b.assign(to=-1 - part, part=-1)[["to", "part", "data", "owners", "grams"]]
    found = [_unpack(*x) for x in zip(b["data"], b["owners"], b["grams"])]
    start = np.cumsum([0, *(len(x[0]) for x in found)])[:-1]
    names, same = np.unique(np.concatenate([x[0] for x in found]), return_inverse=True)
    sizes = np.zeros(len(names), np.uint64)
    np.maximum.at(sizes, same, np.concatenate([x[1] for x in found]))
    gram = np.concatenate([x[2] for x in found]).astype(np.uint64)
    owner = np.concatenate([same[x[3].astype(np.int64) + s] for x, s in zip(found, start)]).astype(np.uint64)
    pair = np.unique(gram << np.uint64(32) | owner)  # a class that several tasks have sent counts once
    gram, owner = pair >> np.uint64(32), (pair & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.r_[True, gram[1:] != gram[:-1]]
    n = np.diff(np.r_[np.flatnonzero(new), len(gram)])[np.cumsum(new) - 1]
    shared = n > 1  # how many tokens a class has alone follows from its size
    owner, gram, n = owner[shared], gram[shared].astype(np.uint32), n[shared].astype(np.uint32)
    to = (names % parts).astype(np.int64)
    by = np.argsort(to[owner], kind="stable")
    owner, gram, n = owner[by], gram[by], n[by]
    told = np.flatnonzero(sizes > 0)
    told = told[np.argsort(to[told], kind="stable")]
    rows = []
    for p in np.union1d(to[told], to[owner]):
        x, y = np.searchsorted(to[owner], [p, p + 1])
        t = told[slice(*np.searchsorted(to[told], [p, p + 1]))]
        o = np.union1d(owner[x:y], t)
        place = np.searchsorted(o, owner[x:y]).astype(np.uint32)
        rows.append((int(p), part, names[o].tobytes() + sizes[o].tobytes() + gram[x:y].tobytes() + n[x:y].tobytes() + place.tobytes(), len(o), int(y - x)))
    return pd.DataFrame(rows, columns=["to", "part", "data", "owners", "grams"])


def _need(n: np.ndarray, similarity: tuple[int, int]) -> np.ndarray:
    """The least size of a set that can link with one of n, which is also the least overlap."""
    a, b = similarity
    return -(-np.asarray(n, np.int64) * a // b)


def _prefix(b: pd.DataFrame, similarity: tuple[int, int]) -> pd.DataFrame:
    """One range of class names -> cls, n, and the tokens of the prefix that other classes have too."""
    names, sizes, cls, gram, count = [], [], [], [], []
    many, many_count, heavy_cls, heavy = [], [], [], []
    for part, data, owners, grams in zip(b["part"], b["data"], b["owners"], b["grams"]):
        own = np.frombuffer(data[: 8 * owners], np.int64)
        names.append(own)
        if part < 0:
            rest = np.frombuffer(data[8 * owners :], np.int64)
            sizes.append(np.zeros(owners, np.uint64))
            many.append(own)
            many_count.append(rest[:owners])
            heavy_cls.append(own[rest[owners : owners + grams]])
            heavy.append(-1 - rest[owners + grams :])
            continue
        a, z, k = 8 * owners, 16 * owners, 4 * grams
        sizes.append(np.frombuffer(data[a:z], np.uint64))
        gram.append(np.frombuffer(data[z : z + k], np.uint32).astype(np.int64) + (np.int64(part) << 32))
        count.append(np.frombuffer(data[z + k : z + 2 * k], np.uint32))
        cls.append(own[np.frombuffer(data[z + 2 * k :], np.uint32).astype(np.int64)])
    join = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
    names, same = np.unique(np.concatenate(names), return_inverse=True)
    told = np.zeros(len(names), np.uint64)
    np.maximum.at(told, same, np.concatenate(sizes))
    size, twice = (told & np.uint64((1 << 40) - 1)).astype(np.int64), (told >> np.uint64(40)).astype(np.int64)
    frequent = np.zeros(len(names), np.int64)
    frequent[np.searchsorted(names, join(many))] = join(many_count)
    # Of all n-grams of a class the frequent ones come last; what is told of them is its prefix's.
    last = np.unique(np.stack([join(heavy_cls), join(heavy)]), axis=1)
    cls, gram, count = join(cls), join(gram), join(count)
    at = np.lexsort((gram, count, cls))
    cls, gram = cls[at], gram[at]
    x, y = np.searchsorted(cls, names), np.searchsorted(cls, names, side="right")
    alone = size - twice - (y - x)  # n-grams that share a token count once here, so the prefix is rather too long
    size = size + frequent
    take = np.clip(size - _need(size, similarity) + 1 - alone, 0, y - x)
    u, v = np.searchsorted(last[0], names), np.searchsorted(last[0], names, side="right")
    return pd.DataFrame({"cls": names, "n": size, "grams": [np.r_[gram[i : i + k], last[1, j:m]] for i, k, j, m in zip(x, take, u, v)]})


class Tree:
    """A signature tree over sets in an order that keeps like sets together: levels of `fan` each."""

    def __init__(self, sets: list[np.ndarray], bits: int = BITS, fan: int = 16):
        self.sets = sets
        size = np.array([len(s) for s in sets], np.int64)
        b = np.zeros((len(sets), bits), np.float32)
        for i, s in enumerate(sets):
            b[i] = np.bincount((s % np.uint64(bits)).astype(np.int64), minlength=bits)
        self.weight = b.max(axis=0)
        levels = [((b > 0).astype(np.float32), size, size)]
        while len(levels[-1][0]) > 1:
            v, lo, hi = levels[-1]
            at = np.arange(0, len(v), fan)
            levels.append((np.maximum.reduceat(v, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at)))
        self.levels, self.fan, self.height = levels, fan, len(levels) - 1

    def level(self, k: int):
        """The nodes on level k; above the root, the root."""
        return self.levels[min(k, self.height)]


def tree_join(left: Tree, right: Tree | None = None, similarity: tuple[int, int] = SIMILARITY, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links between two trees' sets, or within one; right's numbers follow left's.

    known has a number for each set, equal where sets are known to be connected already.
    """
    same = right is None
    right = left if same else right
    shift = 0 if same else len(left.sets)
    sets = left.sets if same else left.sets + right.sets
    label = np.arange(len(sets)) if known is None else known.copy()
    weight = np.minimum(left.weight, right.weight)  # the most tokens that two sets can share on a bit
    a, b = similarity
    links: list[tuple[int, int]] = []

    def one_component(k: int, i: int, j: int) -> bool:
        x = label[i * left.fan**k : (i + 1) * left.fan**k]
        y = label[shift + j * right.fan**k : shift + (j + 1) * right.fan**k]
        return x[0] == y[0] and (x == x[0]).all() and (y == x[0]).all()

    def compare(u: int, v: int) -> None:
        if label[u] == label[v]:
            return
        s, t = sets[u], sets[v]
        both = len(np.intersect1d(s, t, assume_unique=True))
        if b * both >= a * (len(s) + len(t) - both):
            links.append((int(u), int(v)))
            label[label == max(label[u], label[v])] = min(label[u], label[v])

    def descend(k: int, c: np.ndarray, d: np.ndarray) -> None:
        """The pairs of nodes c and d on level k, depth first: links found early spare later pairs."""
        (vx, lo_x, hi_x), (vy, lo_y, hi_y) = left.level(k), right.level(k)
        ok = (b * hi_x[c][:, None] >= a * lo_y[d]) & (b * hi_y[d] >= a * lo_x[c][:, None])
        # overlap >= similarity * union, so (a + b) * overlap >= a * (|x| + |y|)
        most = ((vx[c] * weight) @ vy[d].T).astype(np.int64)
        ok &= (a + b) * most >= a * (lo_x[c][:, None] + lo_y[d])
        if same:
            ok &= c[:, None] <= d if k else c[:, None] < d
        for i, j in np.argwhere(ok):
            i, j = c[i], d[j]
            if not k:
                compare(i, j + shift)
            elif not one_component(k, i, j):
                down = lambda t, x: np.arange(x * t.fan, min((x + 1) * t.fan, len(t.level(k - 1)[0])))
                descend(k - 1, down(left, i), down(right, j))

    descend(max(left.height, right.height), np.array([0]), np.array([0]))
    return links


def _kept_sets(batches: Iterator[pd.DataFrame], n: int) -> Iterator[pd.DataFrame]:
    """(text, cls) -> (cls, set), a class once in a task as far as is remembered."""
    done: set[int] = set()
    for b in batches:
        rows = []
        for text, c in zip(b["text"], b["cls"]):
            if c not in done:
                if len(done) < 1 << 20:
                    done.add(c)
                rows.append((c, shingles(text, n).tobytes()))
        yield pd.DataFrame(rows, columns=["cls", "set"])
    _words.clear()  # workers are used again by other stages
    let_go()


def _sets(b: pd.DataFrame) -> list[tuple[int, np.ndarray, int]]:
    """(class, set, known component), near copies often side by side, since they often share their least hash."""
    held = [(int(c), np.frombuffer(x, np.uint64), int(k)) for x, c, k in zip(b["set"], b["cls"], b["known"])]
    return sorted(held, key=lambda x: (x[1][:1].tolist(), len(x[1]), x[0]))


def _group(b: pd.DataFrame, similarity: tuple[int, int], use_known: bool = False) -> pd.DataFrame:
    """Blocks, or one pair of a block's chunks (block, side, known, cls, set) -> links src, dst to the least of each component."""
    src, dst = [], []
    for _, of in b.groupby("block", sort=False):
        left, right = (_sets(of[of["side"] == side]) for side in (0, 1))
        if not left:
            continue
        names = np.array([c for c, _, _ in left + right], np.int64)
        known = np.unique([k for _, _, k in left + right], return_inverse=True)[1] if use_known else None
        links = tree_join(Tree([s for _, s, _ in left]), Tree([s for _, s, _ in right]) if right else None, similarity, known)
        least = _least(names, links)
        src.append(names[names != least])
        dst.append(least[names != least])
    none = [np.empty(0, np.int64)]
    return pd.DataFrame({"src": np.concatenate(src or none), "dst": np.concatenate(dst or none)})


def _least(names: np.ndarray, links: list[tuple[int, int]]) -> np.ndarray:
    """The least name of each set's component."""
    label = np.arange(len(names))
    for u, v in links:
        label[label == label[v]] = label[u]
    least = np.full(len(names), np.iinfo(np.int64).max)
    np.minimum.at(least, label, names)
    return least[label]


def _label(b: pd.DataFrame, similarity: tuple[int, int]) -> pd.DataFrame:
    """One chunk (cls, set) -> each class and the least class of its component within the chunk."""
    sets = _sets(b.assign(known=0))
    names = np.array([c for c, _, _ in sets], np.int64)
    return pd.DataFrame({"cls": names, "label": _least(names, tree_join(Tree([s for _, s, _ in sets]), None, similarity))})


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, similarity: tuple[int, int] = SIMILARITY, chunk: int = CHUNK, part_chars: int = 8 << 20, least_frequent: int = FREQUENT, carry: bool = False) -> DataFrame:
    """docs -> one row each: id, n_shingles, component_id.

    With `carry` there are also row (a struct of all columns of docs), cls (the same for equal texts) and
    component (the same for all rows that reach each other, unlike component_id also where ids repeat).
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *([F.struct("*").alias("row")] if carry else []))
    keyed, of = _classes(rows)
    chars = of.agg(F.sum("chars")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // part_chars))
    texts = keyed.select("text", "cls")

    often = texts.mapInPandas(lambda it: _often(it, n, 1 << 19), "gram bigint, count bigint")
    # Their classes sum up to half of all characters at most, so there are 2^16 at most.
    often = often.groupBy("gram").agg(F.sum("count").alias("count")).where(F.col("count") > max(least_frequent, chars >> 17)).select("gram").collect()
    frequent = np.sort(np.array([r[0] for r in often], np.int64).astype(np.uint64))

    packed = texts.mapInPandas(lambda it: _pack(it, n, parts, 1 << 20, frequent, similarity), "part int, data binary, owners int, grams int")
    counted = packed.groupBy("part").applyInPandas(lambda b: let_go(_count(b, parts)), "to int, part int, data binary, owners int, grams int")
    known = keep(counted.groupBy("to").applyInPandas(lambda b: let_go(_prefix(b, similarity)), "cls bigint, n bigint, grams array<bigint>"))

    grams = known.where(F.size("grams") > 0).select("cls", F.explode("grams").alias("gram"))
    least = grams.groupBy("gram").agg(F.min("cls").alias("least"), F.count("*").alias("k")).where("k > 1")
    near = grams.join(least, "gram").where("cls <> least").select(F.col("cls").alias("src"), F.col("least").alias("dst"))
    blocks = keep(connected_components(near).select(F.col("node").alias("cls"), F.col("component").alias("block")))

    links = _links(keyed.select("id", "text", "cls"), of, known, blocks, n, similarity, chunk)
    joined = keep(connected_components(links).select(F.col("node").alias("cls"), F.col("component").alias("group")))
    firsts = joined.join(of, "cls").groupBy("group").agg(F.min("first").alias("component_id"))
    named = joined.join(firsts, "group").select("cls", "component_id", "group")
    told = known.select("cls", "n").join(named, "cls", "left").join(of.select("cls", "first"), "cls")
    told = told.select("cls", "n", F.coalesce("component_id", "first").alias("component_id"), F.coalesce("group", "cls").alias("component"))
    out = keyed.drop("text").join(told, "cls", "left")
    found = [F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id")]
    return out.select(*found, *(["row", "cls", F.coalesce("component", "cls").alias("component")] if carry else []))


def _numbered(sized: DataFrame, by: list[str], chunk: int) -> DataFrame:
    """sized(cls, n, ...) with m, the number of classes of its `by`, and chunk, its number in order of n.

    A size with more sets than a chunk holds has several chunks, and its sets are dealt by hash; so no
    set's rank is needed, only each size's.
    """
    total = sized.groupBy(*by).agg(F.count("*").alias("m"))
    by_size = sized.groupBy(*by, "n").agg(F.count("*").alias("k"))
    before = F.sum("k").over(Window.partitionBy(*by).orderBy("n").rowsBetween(Window.unboundedPreceding, -1))
    by_size = by_size.withColumn("before", F.coalesce(before, F.lit(0)))
    spread = F.pmod(F.xxhash64("cls"), F.greatest(F.ceil(F.col("k") / chunk), F.lit(1)))
    placed = sized.join(total, by).join(by_size, [*by, "n"])
    return placed.withColumn("chunk", (F.floor(F.col("before") / chunk) + spread).cast("long")).drop("k", "before")


def _likely(rows: DataFrame, by: list[str], wanted: DataFrame, of: list[str]) -> DataFrame:
    """The rows whose columns `by` may be among the columns `of` of wanted, and few others.

    A bitmap of FILTER_BITS bits of their hashes goes to all tasks, so that most other texts or sets
    aren't shuffled to be dropped.  Its size is fixed; the fuller it is, the more rows pass in vain, and
    none is lost.
    """
    place = lambda c: F.pmod(F.xxhash64(*c), F.lit(FILTER_BITS)) + 1
    bits = wanted.select(place(of).alias("p")).groupBy(F.bitmap_bucket_number("p").alias("_bucket"))
    bits = bits.agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("_bits"))
    p = F.bitmap_bit_position(place(by))
    byte = F.conv(F.hex(F.substr("_bits", F.floor(p / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = rows.withColumn("_bucket", F.bitmap_bucket_number(place(by))).join(F.broadcast(bits), "_bucket")
    return found.where(F.bit_get(byte, (p % 8).cast("int")) == 1).drop("_bucket", "_bits")


def _links(keyed: DataFrame, of: DataFrame, known: DataFrame, blocks: DataFrame, n: int, similarity: tuple[int, int], chunk: int) -> DataFrame:
    """Spanning links within the blocks.

    Blocks of one chunk share groups.  A larger block is joined in three steps, so that its largest
    set of near copies, which may hold a third of all rows, costs no more than its size: each chunk in
    itself; then the first of each chunk's largest components with each other; then only what isn't in
    the block's largest component by now, with itself and with the rest of the block.
    """
    # Never a broadcast: the classes of blocks grow with the corpus, so the plan is one and the same at every size.
    edges = "src bigint, dst bigint"
    sized = blocks.join(known.select("cls", "n"), "cls").join(of.select("cls", "first"), "cls")
    placed = keep(_numbered(sized, ["block"], chunk))
    # The texts of blocks are read once; from here on their sets go along.
    wanted = placed.select(F.col("cls").alias("_cls"), "first").hint("merge")
    found = _likely(keyed, ["id", "cls"], wanted, ["first", "_cls"]).join(wanted, F.col("id").eqNullSafe(F.col("first")) & (F.col("cls") == F.col("_cls"))).select("text", "cls")
    # Rows of one id and class meet in a task, which keeps one of them; a second one would only cost.
    sets = keep(found.mapInPandas(lambda it: _kept_sets(it, n), "cls bigint, set binary"))
    with_sets = lambda dealt: dealt.hint("merge").join(_likely(sets, ["cls"], dealt, ["cls"]), "cls")
    small, large = placed.where(F.col("m") <= chunk), placed.where(F.col("m") > chunk)
    bins = max(-(-small.count() // (chunk // 2)), 1)
    small = small.select("cls", "block", F.lit(0).alias("side"), F.lit(0).alias("known"), F.pmod(F.xxhash64("block"), F.lit(bins)).alias("bin"))
    found = with_sets(small).groupBy("bin").applyInPandas(lambda g: let_go(_group(g, similarity)), edges)
    if large.isEmpty():
        return found

    inside = with_sets(large.select("cls", "block", "chunk")).groupBy("block", "chunk").applyInPandas(lambda g: let_go(_label(g, similarity)), "cls bigint, label bigint")
    inside = keep(inside)
    large = large.join(inside, "cls")
    found = found.unionByName(inside.select(F.col("cls").alias("src"), F.col("label").alias("dst")))

    per = large.groupBy("block", "chunk", "label").agg(F.count("*").alias("c"))
    first = per.withColumn("rank", F.row_number().over(Window.partitionBy("block", "chunk").orderBy(F.desc("c"), "label"))).where(F.col("rank") <= HEADS)
    groups = per.groupBy("block").agg(F.max("chunk").alias("last"))
    heads = first.join(groups, "block").select(F.col("label").alias("cls"), "block", F.pmod(F.xxhash64("chunk"), F.floor((F.col("last") + 1) * HEADS / chunk) + 1).alias("bin"), F.lit(0).alias("side"), F.lit(0).alias("known"))
    met = with_sets(heads).groupBy("block", "bin").applyInPandas(lambda g: let_go(_group(g, similarity)), edges)
    met = keep(met)
    found = found.unionByName(met)

    named = large.join(connected_components(met).select(F.col("node").alias("label"), "component"), "label", "left").withColumn("label", F.coalesce("component", "label")).drop("component", "chunk", "m")
    most = named.groupBy("block", "label").agg(F.count("*").alias("c")).groupBy("block").agg(F.max_by("label", F.struct("c", "label")).alias("most"))
    named = named.join(most, "block").withColumn("rest", (F.col("label") != F.col("most")).cast("int"))
    again = keep(_numbered(named.drop("most"), ["block", "rest"], chunk))

    a, b = similarity
    # A number for each chunk, those of the rest after those of the largest component.
    chunks = again.groupBy("block", "rest", "chunk").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("label").alias("one_label"), F.max("label").alias("last_label"))
    here = chunks.select("block", F.struct("rest", "chunk").alias("one"), F.col("lo"), F.col("hi"), F.col("one_label").alias("l1"), F.col("last_label").alias("h1"))
    there = chunks.where("rest = 1").select("block", F.struct("rest", "chunk").alias("two"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.col("one_label").alias("l2"), F.col("last_label").alias("h2"))
    one_component = (F.col("l1") == F.col("h1")) & (F.col("l2") == F.col("h2")) & (F.col("l1") == F.col("l2"))
    pairs = here.join(there, "block").where((F.col("one") <= F.col("two")) & (b * F.col("hi") >= a * F.col("lo2")) & (b * F.col("hi2") >= a * F.col("lo")) & ~one_component)
    # A chunk of the rest meets only those classes of another that share a prefix n-gram with one of its own.
    place = F.struct("rest", "chunk")
    entries = known.select("cls", "grams").join(again.select("cls", "block", place.alias("one")), "cls").select("cls", F.explode("grams").alias("gram"), "block", "one")
    shared = entries.where("one.rest = 1").select("gram", "block", F.col("one").alias("two")).distinct()
    meets = entries.join(shared, ["gram", "block"]).where("one <= two").select("cls", "block", "one", "two").distinct()
    columns = ["cls", "block", "side", F.col("label").alias("known"), "one", "two"]
    held = again.select("cls", "block", "label", place.alias("place"))
    left = meets.join(pairs.select("block", "one", "two"), ["block", "one", "two"]).join(held.drop("block", "place"), "cls").withColumn("side", F.lit(0))
    right = pairs.where("one <> two").select("block", "one", "two").join(held.withColumnRenamed("place", "two"), ["block", "two"]).withColumn("side", F.lit(1))
    dealt = keep(left.select(*columns).unionByName(right.select(*columns)))
    rest = with_sets(dealt).groupBy("block", "one", "two").applyInPandas(lambda g: let_go(_group(g, similarity, True)), edges)
    return found.unionByName(rest)
