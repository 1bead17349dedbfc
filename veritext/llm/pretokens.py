"""Encoding and counting the tokens of whole texts.

A byte-level BPE tokenizer encodes each pre-token on its own, and its
pre-tokens never run across the place before a space that a visible character
follows.  So a text cut before such spaces can be encoded chunk by chunk, and
equal chunks always get equal counts, which a worker keeps in a cache.

Texts and missing chunks are encoded by the faster of two libraries that can
hold the same vocabulary and merges, tiktoken.  It joins any neighbours whose
union is in the vocabulary, where tokenizers joins listed pairs only; both
give the same ids for all texts if tokenizers encodes every entry of the
vocabulary as that entry (inside the span of an entry the merges before its
own are then the listed ones).  ``merges_alike`` checks that, entry by entry.
Where it does not hold, for texts with characters on which Unicode versions
may differ or with added tokens, tokenizers does the work.  When counting, a
text with white space runs that would straddle a cut is encoded whole, and so
is every text where the tokenizer is of another kind.  Results equal those of tokenizers on whole texts.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import numpy as np
import tiktoken
from tokenizers import Tokenizer

#: Entries of a generation of the cache, which keeps two.
CHUNKS = 150_000
#: Longest entry (code points) worth keeping.
CACHED_CHARS = 48
#: Below this code point all Unicode versions agree on letters, digits and white space.
UNSETTLED = re.compile("[\u0250-\U0010ffff]").search
#: The pre-token pattern of byte-level BPE (fixed value of that scheme).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes that byte-level BPE writes as themselves; the others are written from U+0100 on.
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]

_LOADED: dict[str, tuple] = {}


def _config(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def load(path: str) -> tuple[Tokenizer, bool, tuple[str, ...]]:
    """The tokenizer of a worker, read once; whether its texts can be cut; its added tokens."""
    if path not in _LOADED:
        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        c = _config(path)
        kind, added = c["pre_tokenizer"] or {}, c["added_tokens"]
        plain = not any(a["single_word"] or a["lstrip"] or a["rstrip"] or not a["content"] or any(map(str.isspace, a["content"])) for a in added)
        cuts = (plain and kind.get("type") == "ByteLevel" and kind.get("use_regex", False) and not kind["add_prefix_space"]
                and c["normalizer"] is None and c["model"]["type"] == "BPE" and c["model"].get("dropout") is None)
        _LOADED[path] = (t, cuts, tuple(a["content"] for a in added))
    return _LOADED[path]


def _ranks(path: str) -> tuple[dict[bytes, int], np.ndarray]:
    """Merge order of the vocabulary as bytes, and the id of every rank."""
    model = _config(path)["model"]
    hidden = [b for b in range(256) if b not in PRINTED]
    byte_of = {chr(b): b for b in PRINTED} | {chr(256 + i): b for i, b in enumerate(hidden)}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    names = [n for n in model["vocab"] if len(n) == 1] + [a + b for a, b in pairs]
    return ({bytes(byte_of[c] for c in n): i for i, n in enumerate(names)}, np.array([model["vocab"][n] for n in names], "u4"))


def merges_alike(path: str) -> bool:
    """Whether tokenizers encodes every vocabulary entry as that entry; asked once, on the driver."""
    tokenizer, cuts, _ = load(path)
    model = _config(path)["model"] if cuts else {}
    if not cuts or model.get("ignore_merges") or any(model.get(k) for k in ("unk_token", "continuing_subword_prefix", "end_of_word_suffix")):
        return False
    merged = len({n for n in model["vocab"] if len(n) == 1}) + len(model["merges"])
    return merged == len(model["vocab"]) and all([t.id for t in tokenizer.model.tokenize(n)] == [i] for n, i in model["vocab"].items())


class Straddles(Exception):
    """White space runs on across the cut before or after this chunk."""


def chunks_of(text: str) -> list[str]:
    """Chunks with their leading space left out (all but the first had one)."""
    return text.split(" ")


class Cache(dict):
    """Two generations of ``make(key)``; ``frequent`` entries are never lost."""

    def __init__(self, make: Callable[[str], object], entries: int, frequent: dict | None = None):
        super().__init__()
        self.make, self.entries, self.frequent, self.old = make, entries, frequent or {}, {}

    def __missing__(self, key: str):
        found = self.frequent.get(key)
        if found is None:
            found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(key) <= CACHED_CHARS:
            if len(self) >= self.entries:
                self.old = dict(self)
                self.clear()
            self[key] = found
        return found


class Encoder:
    """Ids of texts.  ``alike`` is what ``merges_alike`` says of the tokenizer."""

    def __init__(self, path: str, alike: bool):
        self.tokenizer, self.cuts, self.added = load(path)
        self.merge = None
        if alike:
            ranks, ids = _ranks(path)
            self.ids = None if np.array_equal(ids, np.arange(len(ids))) else ids
            self.merge = tiktoken.Encoding("merges", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def library(self, text: str) -> list[int]:
        """What tokenizers gives."""
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def settled(self, text: str) -> bool:
        """Whether both libraries cut the text alike."""
        return self.merge is not None and not UNSETTLED(text) and not any(a in text for a in self.added)

    def ids_of(self, text: str) -> np.ndarray:
        """The ids of a whole text."""
        if not text or not self.settled(text):
            return np.array(self.library(text), "u4")
        ids = self.merge.encode_to_numpy(text, disallowed_special=())
        return ids if self.ids is None else self.ids[ids]

    def count(self, text: str) -> int:
        """How many ids a short text has."""
        return len(self.merge.encode_ordinary(text)) if self.settled(text) else len(self.library(text))


class Counter:
    """Token counts of whole texts: chunk by chunk through the cache."""

    def __init__(self, path: str, alike: bool, frequent: dict | None = None):
        self.encoder = Encoder(path, alike)
        self.first = Cache(self.chunk, CHUNKS // 10)
        self.rest = Cache(lambda c: self.chunk(c, " "), CHUNKS, frequent)

    def chunk(self, chunk: str, lead: str = "") -> int:
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            raise Straddles
        return self.encoder.count(lead + chunk)

    def __call__(self, text: str) -> int:
        if not text:
            return 0
        if not self.encoder.cuts:
            return len(self.encoder.library(text))
        chunks = chunks_of(text)
        try:
            return self.first[chunks[0]] + sum(map(self.rest.__getitem__, chunks[1:]))
        except Straddles:
            return len(self.encoder.library(text))
