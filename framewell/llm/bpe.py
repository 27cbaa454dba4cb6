"""BPE encoding and decoding by merge ranks.

A word's symbols are a doubly linked list; a priority queue holds the merges that are possible,
lowest rank first and leftmost first among equals.  Merging a pair unlinks its right symbol and
queues the pairs with its new neighbours; entries whose symbols have changed meanwhile are stale and
skipped.  Decoding joins vocabulary strings by what the file's decoder asks for.

The file (of the tokenizers library) gives vocabulary, merges, added tokens, normalizer and split;
what it may contain is stated in Bpe.__init__, and anything else is refused rather than guessed.
Words repeat, so a bounded memory of short words stands before the queue.

Defined results: null and empty texts have no tokens; a text of any length is worked through word by
word, so only its ids are held; repeated rows are encoded each.
"""

import functools
import hashlib
import heapq
import json
import os
import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewell.llm.common import as_text, let_go

VOCABULARY = "word_bpe_49k.json"
#: White space as Unicode defines it.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_WORDS_HELD, _LONGEST_HELD = 1 << 18, 48


def default_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_chars() -> list[str]:
    """The character that stands for each byte: itself if it is printable, else the next from 256."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class Held(dict):
    """The results of short words, in two generations: those in use when one is full go on to the next."""

    def __init__(self, of):
        super().__init__()
        self.of, self.old = of, {}

    def __missing__(self, word: str):
        found = self.old.get(word)
        if found is None:
            found = self.of(word)
        if len(word) <= _LONGEST_HELD:
            if len(self) >= _WORDS_HELD:
                self.old = dict(self)
                super().clear()
            self[word] = found
        return found

    def clear(self) -> None:
        """Hold nothing."""
        self.old = {}
        super().clear()


class Bpe:
    """A vocabulary file with byte-level characters and word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, norm, pre = file["model"], file["normalizer"], file["pre_tokenizer"]
        if model["type"] != "BPE" or model["dropout"] or model["unk_token"] or model["continuing_subword_prefix"] or model["ignore_merges"] or model["byte_fallback"] or file["post_processor"] or file["decoder"]:
            raise ValueError(f"{path}: not a plain BPE model")
        steps = [(x["type"], x.get("pattern", {}).get("Regex")) for x in norm["normalizers"]]
        if steps != [("NFC", None), ("Replace", r"\s+"), ("Lowercase", None)]:
            raise ValueError(f"{path}: normalizer {steps}")
        split, level = pre["pretokenizers"]
        if split["type"] != "Split" or split["behavior"] != "Removed" or not split["invert"] or level["type"] != "ByteLevel" or level["use_regex"] or level["add_prefix_space"]:
            raise ValueError(f"{path}: pre-tokenizer")
        self.words = regex.compile(split["pattern"]["Regex"].replace(r"[^\s\p{L}", f"[^{_SPACE}\\p{{L}}"))
        self.added = {x["content"]: x["id"] for x in file["added_tokens"]}
        if any(x["normalized"] or x["single_word"] or x["lstrip"] or x["rstrip"] for x in file["added_tokens"]):
            raise ValueError(f"{path}: added tokens")
        self.special = regex.compile("|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True))) if self.added else None
        # What all of them begin with: a text without it has none.
        self.sign = os.path.commonprefix(list(self.added))
        vocab = model["vocab"]
        self.strings = {i: s for s, i in vocab.items()} | {i: s for s, i in self.added.items()}
        end, chars = model["end_of_word_suffix"] or "", byte_chars()
        self.first = [vocab[c] for c in chars]
        self.last = [vocab[c + end] for c in chars]
        self.pairs = []
        for pair in model["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.pairs.append((vocab[a], vocab[b], vocab[a + b]))
        self.ranks = {(a, b): rank for rank, (a, b, _) in enumerate(self.pairs)}
        self.held = Held(self.merge)

    def merge(self, word: str) -> tuple[int, ...]:
        """The ids of one word."""
        data = word.encode("utf-8", "surrogatepass")
        n, rank, first = len(data), self.ranks.get, self.first
        ids = [first[b] for b in data]
        ids[-1] = self.last[data[-1]]
        ids.append(-1)  # stands after the last symbol and, as ids[-1], before the first
        after, before = [*range(1, n + 1), n], [*range(-1, n)]
        # An entry is rank * n + place: the lowest rank first, the leftmost place among equals.
        queue = [r * n + i for i in range(n - 1) if (r := rank((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(queue)
        while queue:
            r, i = divmod(heapq.heappop(queue), n)
            a, b, made = self.pairs[r]
            j = after[i]
            if ids[i] != a or ids[j] != b:  # stale: a neighbour's merge has changed either symbol
                continue
            ids[i], ids[j] = made, -2
            after[i] = k = after[j]
            before[k] = i
            if (r := rank((made, ids[k]))) is not None:
                heapq.heappush(queue, r * n + i)
            h = before[i]
            if h >= 0 and (r := rank((ids[h], made))) is not None:
                heapq.heappush(queue, r * n + h)
        return tuple(x for x in ids if x >= 0)

    @staticmethod
    def normalize(text: str) -> str:
        """NFC, then lower case character by character: a capital sigma is the same at a word's end.

        White space needs no step of its own: the split drops it in any form.
        """
        text = unicodedata.normalize("NFC", text)
        return (text.replace("Σ", "σ") if "Σ" in text else text).lower()

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        ids: list[int] = []
        at = 0
        for m in self.special.finditer(text) if self.special and self.sign in text else ():
            self._plain(text[at : m.start()], ids)
            ids.append(self.added[m[0]])
            at = m.end()
        self._plain(text[at:] if at else text, ids)
        return ids

    def _plain(self, text: str, ids: list[int]) -> None:
        for x in map(self.held.__getitem__, self.words.findall(self.normalize(text))):
            ids += x

    def count(self, text: str | None) -> int:
        """Number of ids of a text without holding them."""
        if not text:
            return 0
        if self.special and self.sign in text:
            return len(self.encode(text))
        return sum(map(len, map(self.held.__getitem__, self.words.findall(self.normalize(text)))))

    def decode(self, ids: list[int]) -> str:
        """Vocabulary strings; the file names no decoder, so one space joins them."""
        return " ".join(map(self.strings.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


def encode(df: DataFrame, text_col: str = "text", path: str | None = None, name: str = "token_ids") -> DataFrame:
    """df with the column `name` array<int>, the ids of the text."""

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = load(path or default_path())
        for texts in batches:
            yield texts.map(bpe.encode, na_action=None)

    return df.withColumn(name, ids(F.col(text_col)))


def decode(df: DataFrame, ids_col: str = "token_ids", path: str | None = None, name: str = "decoded") -> DataFrame:
    """df with the column `name` string, the text of the ids; null ids give null."""

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = load(path or default_path())
        for ids in batches:
            yield ids.map(lambda x: None if x is None else bpe.decode(x))

    return df.withColumn(name, text(F.col(ids_col)))


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """df -> id, n_tokens, ids_sha256, decoded_sha256: encoded and decoded in one pass in the worker.

    Ids and decoded texts are several times the text and needn't leave the worker for their digests.
    """
    sent, back = as_text(df.select(id_col, text_col), id_col)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load(path or default_path())
        decimal = {i: str(i) for i in bpe.strings}
        for b in batches:
            rows = []
            for text in b[text_col]:
                ids = bpe.encode(text if isinstance(text, str) else None)
                rows.append((len(ids), hashlib.sha256(" ".join(map(decimal.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(bpe.decode(ids).encode()).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, id_col, b[id_col].array)
            yield out
        bpe.held.clear()  # workers are used again by other stages
        let_go()

    return back(sent.mapInPandas(work, f"`{id_col}` string, n_tokens bigint, ids_sha256 string, decoded_sha256 string"))
