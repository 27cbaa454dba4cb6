"""Token counts with overlap resynchronisation.

A text is encoded by the library in chunks of `chunk` characters that overlap by `overlap`, with
offsets; a text that fits into one chunk is one chunk.  Two neighbouring encodings are spliced where
both are proven right: at white space in the overlap, since no token, special string or composed
character spans white space, and only if from there to the next white space both give the same tokens
at the same places.  Where an overlap has no such place it is widened, doubling, to the text's end if
need be; a text without white space is so encoded as one.  The counts are those of the library on
whole texts, and memory is that of one chunk, or of the longest stretch without white space.

Most of the library's time goes into its normalizer and into places that only splicing needs.  So a text
of one chunk is encoded without places.  And where the file's steps are NFC, white space to one space,
lower case and a split that drops white space (`_STEPS`, `_SPLIT`), a text of `_STABLE` characters
is lower-cased here and encoded by the library without its normalizer: NFC changes none of them beside any
other, their lower case depends neither on their neighbours nor on the version of Unicode, and how much
white space separates two words doesn't matter to the split.  Added tokens are found before the normalizer,
so a text that holds one once it is lower-cased takes the usual way, as do all other texts and files.

Defined results: null and empty texts have 0 bytes and 0 tokens; very long texts are counted whole;
repeated rows and repeated ids are counted each, a null id as any other; an empty table gives an empty
result; only the id and the text are read, so further columns may have any name.
"""

import functools
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from framewell.llm.bpe import default_path
from framewell.llm.common import as_text

CHUNK, OVERLAP = 1 << 14, 1 << 8
#: Only characters that every Unicode version counts as white space.
_SPACE = re.compile(r"[ \t-\r]+")
#: Latin letters without combining marks, dashes, quotation marks, ellipsis, euro sign.
_STABLE = re.compile(r"[\x00-\u024f\u2010-\u2027\u20ac]*")
_STEPS = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}


@functools.lru_cache(maxsize=2)
def load(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@functools.lru_cache(maxsize=2)
def load_bare(path: str):
    """(the library's tokenizer without its normalizer, lower-cased added tokens), or None if the file's steps are others."""
    from tokenizers import Tokenizer

    file = json.loads(load(path).to_str())
    pre, added = file["pre_tokenizer"] or {}, file["added_tokens"]
    if file["normalizer"] != _STEPS or pre.get("pretokenizers", [None])[0] != _SPLIT or any(x["normalized"] or x["single_word"] or x["lstrip"] or x["rstrip"] for x in added):
        return None
    return Tokenizer.from_str(json.dumps(file | {"normalizer": None})), [x["content"].lower() for x in added]


def prepared(path: str, text: str):
    """(tokenizer, text) that together give the library's tokens of the text."""
    bare = load_bare(path)
    if bare and _STABLE.fullmatch(text):
        low = text.lower()
        if not any(x in low for x in bare[1]):
            return bare[0], low
    return load(path), text


class _Part:
    """The encoding of text[start:end]; tokens' places are asked of the library one by one, as few are needed."""

    def __init__(self, t, text: str, start: int, end: int):
        self.start, self.end = start, end
        self.encoding = t.encode(text[start:end], add_special_tokens=False)
        self.n = len(self.encoding)

    def span(self, i: int) -> tuple[int, int]:
        """Where token i starts and ends, in the whole text."""
        a, b = self.encoding.token_to_chars(i)
        return a + self.start, b + self.start

    def index(self, at: int) -> int | None:
        """Number of tokens before `at`, or None if one spans it."""
        lo, hi = 0, self.n
        while lo < hi:
            mid = (lo + hi) // 2
            if self.span(mid)[0] < at:
                lo = mid + 1
            else:
                hi = mid
        return lo if lo == 0 or self.span(lo - 1)[1] <= at else None

    def stretch(self, i: int, j: int) -> list[tuple[int, int, int]]:
        """Tokens i to j - 1 and their places."""
        ids = self.encoding.ids[i:j]
        return [(x, *self.span(i + k)) for k, x in enumerate(ids)]


def _splice(text: str, a: _Part, b: _Part) -> tuple[int, int, int] | None:
    """(place, tokens of a before it, tokens of b before it), the first place where both agree."""
    gaps = list(_SPACE.finditer(text, b.start, a.end))
    # b may have begun, and a may have ended, in the middle of a token: only whole stretches between two gaps prove.
    for x, y in zip(gaps, gaps[1:]):
        ia, ib, ja, jb = a.index(x.start()), b.index(x.start()), a.index(y.start()), b.index(y.start())
        if x.start() > b.start and None not in (ia, ib, ja, jb) and ja > ia and a.stretch(ia, ja) == b.stretch(ib, jb):
            return x.start(), ia, ib
    return None


def count(t, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Number of tokens of one text of any length."""
    if len(text) <= chunk:
        return len(t.encode_batch_fast([text], add_special_tokens=False)[0])
    total, a, skip = 0, _Part(t, text, 0, min(chunk, len(text))), 0
    while a.end < len(text):
        wide = min(overlap, chunk // 2)
        while True:
            start = max(a.start, a.end - wide)
            b = _Part(t, text, start, min(len(text), start + chunk))
            if b.end > a.end and (found := _splice(text, a, b)) and found[1] >= skip:
                total += found[1] - skip
                a, skip = b, found[2]
                break
            wide *= 2
            if start == a.start or wide > chunk // 2:
                # No place back there: go on from the same start, with twice the stretch.
                a = _Part(t, text, a.start, min(len(text), a.start + 2 * (a.end - a.start)))
                break
    return total + a.n - skip


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP, limit: int = 2048) -> DataFrame:
    """df -> id, n_bytes, n_tokens, over_limit (n_tokens > limit)."""
    sent, back = as_text(df.select(id_col, text_col), id_col)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        file = path or default_path()
        for b in batches:
            texts = [x if isinstance(x, str) else "" for x in b[text_col]]
            n = [count(*prepared(file, x), chunk, overlap) for x in texts]
            yield pd.DataFrame({id_col: b[id_col].array, "n_bytes": [len(x.encode("utf-8", "surrogatepass")) for x in texts], "n_tokens": n, "over_limit": [k > limit for k in n]})

    return back(sent.mapInPandas(work, f"`{id_col}` string, n_bytes bigint, n_tokens bigint, over_limit boolean"))
