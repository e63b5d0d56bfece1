"""BPE encoding and decoding with forced boundaries.

A text is normalised and cut into words as the tokenizer file says. Inside a word, two neighbouring bytes that stand
side by side in no vocabulary token can never end up in one token, so the word is cut between them for certain. The
fragments are encoded independently, by merges in order of rank, and concatenated. Short fragments and whole chunks
between blanks recur, so a task keeps those it has met, up to a fixed number.

The tokenizer file is read on the driver (a parameter, of bounded size) and shipped with the task. Supported are files
with NFC, white space and lower case normalisation, a split pattern, byte-level symbols and an end-of-word suffix.

Defined results: null text is encoded as empty, to no ids; strings of special tokens become their ids; very long words
take n log n steps; equal texts give equal rows; an empty table gives no rows; other columns are not returned. Letters that Unicode 16 or later has added follow the
tables of Python and of the regex module, which may be older or newer than those of another implementation.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import unicodedata
from array import array
from pathlib import Path

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import per_batch

#: What a task remembers at most: entries, and characters of one entry.
KEPT, LONGEST = 150_000, 48
#: Blanks to Python's str.split, but not to the split pattern.
ODD = re.compile("[\x1c-\x1f]")
BLANK = regex.compile(r"[\t-\r \x85\xa0  -     　]+")


def byte_letters() -> list[str]:
    """The printable letter of every byte in byte-level vocabularies: itself if printable, else the next free one from 256."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in own else next(free)) for b in range(256)]


class Recent:
    """A dictionary of bounded size: once half full, the entries not met since are the first to go."""

    def __init__(self, most: int = KEPT):
        self.young: dict = {}
        self.old: dict = {}
        self.half = most // 2

    def get(self, key):
        found = self.young.get(key)
        if found is None:
            found = self.old.get(key)
            if found is not None:
                self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.young) >= self.half:
            self.old, self.young = self.young, {}
        self.young[key] = value


class ForcedBpe:
    def __init__(self, file: bytes):
        spec = json.loads(file)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        end = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        self.token = {i: t for t, i in {**vocab, **self.special}.items()}
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern)
        letter = byte_letters()
        byte = {c: b for b, c in enumerate(letter)}
        self.first = [vocab[c] for c in letter]  # id of a byte inside a word
        self.last = [vocab[c + end] for c in letter]  # and at its end
        #: Pair of ids -> rank and id of the merged token, in one number that orders by rank.
        self.merge: dict[int, int] = {}
        for k, m in enumerate(model["merges"]):
            x, y = m if isinstance(m, list) else m.split(" ")
            self.merge[vocab[x] << 32 | vocab[y]] = k << 32 | vocab[x + y]
        inside = np.zeros((256, 256), np.uint8)
        for t in vocab:
            b = [byte[c] for c in t.removesuffix(end) if c in byte]
            inside[b[:-1], b[1:]] = 1
        self.inside = inside.tobytes()
        self.chunks, self.parts = Recent(), Recent()

    def fragments_of(self, word: bytes) -> list[bytes]:
        """The word cut wherever two bytes are side by side in no token."""
        inside = self.inside
        at = [i for i, (x, y) in enumerate(zip(word, word[1:], strict=False), 1) if not inside[x << 8 | y]]
        if not at:
            return [word]
        return [word[i:j] for i, j in zip([0, *at], [*at, len(word)], strict=True)]

    def merged(self, ids: list[int]) -> list[int]:
        """The pair of least rank is merged first, the leftmost among equals."""
        if len(ids) > LONGEST * 4:
            return self._merged_long(ids)
        get, none = self.merge.get, 1 << 62
        pairs = [get(x << 32 | y, none) for x, y in zip(ids, ids[1:], strict=False)]
        while pairs and (best := min(pairs)) != none:
            i = pairs.index(best)
            new = best & 0xFFFFFFFF
            ids[i] = new
            del ids[i + 1], pairs[i]
            if i:
                pairs[i - 1] = get(ids[i - 1] << 32 | new, none)
            if i < len(pairs):
                pairs[i] = get(new << 32 | ids[i + 1], none)
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        """The same in n log n steps, by a heap over linked symbols."""
        n = len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.merge.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, x, y = heapq.heappop(heap)
            j = after[i]
            if ids[i] != x or j < 0 or ids[j] != y:
                continue
            ids[i], ids[j], after[i] = r & 0xFFFFFFFF, -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q >= 0 and (r := self.merge.get(ids[p] << 32 | ids[q])) is not None:
                    heapq.heappush(heap, (r, p, ids[p], ids[q]))
        return [x for x in ids if x >= 0]

    def word(self, word: str) -> list[int]:
        raw = word.encode("utf-8", "replace")
        parts = self.fragments_of(raw)
        out: list[int] = []
        for k, p in enumerate(parts, 1):
            key = (p, k == len(parts))
            ids = self.parts.get(key)
            if ids is None:
                ids = [self.first[b] for b in p]
                if key[1]:
                    ids[-1] = self.last[p[-1]]
                ids = self.merged(ids)
                if len(p) <= LONGEST:
                    self.parts.put(key, ids)
            out += ids
        return out

    def chunk(self, text: str) -> bytes:
        """Ids of a normalised run without blanks."""
        known = self.chunks.get(text)
        if known is not None:
            return known
        if text.isalpha():
            ids = self.word(text)
        elif text[:-1].isalpha() and text[-1] in ".,;:!?":
            ids = self.word(text[:-1]) + self.word(text[-1])
        else:
            ids = [i for w in self.words.findall(text) for i in self.word(w)]
        out = array("I", ids).tobytes()
        if len(text) <= LONGEST:
            self.chunks.put(text, out)
        return out

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        ids: list[bytes] = []
        for part in self.specials.split(text or "") if self.specials else [text or ""]:
            if part in self.special:
                ids.append(array("I", [self.special[part]]).tobytes())
                continue
            if not unicodedata.is_normalized("NFC", part):
                part = unicodedata.normalize("NFC", part)
            part = part.replace("Σ", "σ").lower()  # a sigma at the end of a word is no exception here
            chunks = BLANK.split(part) if ODD.search(part) else part.split()
            near, get = self.chunks.young, self.chunk
            ids += [near.get(c) or get(c) for c in chunks if c]
        return b"".join(ids)

    def decode(self, ids: bytes) -> str:
        """Without a decoder in the file, tokens are joined by blanks."""
        token = self.token
        return " ".join([token[i] for i in array("I", ids)])


@functools.lru_cache(maxsize=2)
def load(file: bytes) -> ForcedBpe:
    return ForcedBpe(file)


def encode_documents(docs: DataFrame, tokenizer: str, keep_decoded: bool = True) -> DataFrame:
    """``(doc_id, ids binary, decoded string)``: ids as little-endian unsigned 32-bit integers."""
    file = Path(tokenizer).read_bytes()

    def make():
        bpe = load(file)

        def work(rows: dict) -> dict:
            ids = [bpe.encode(t) for t in rows["text"]]
            return {"doc_id": rows["doc_id"], "ids": ids, "decoded": [bpe.decode(x) for x in ids] if keep_decoded else [None] * len(ids)}

        return work

    return per_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, "doc_id long, ids binary, decoded string")
