"""Token ids by a tokenizer file, with a bounded store of the ids of text chunks in each Python worker."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNKS = 1_000_000
#: Bytes of text that are cut into chunks at once.
BLOCK = 8 << 20
#: Runs of white space, as the byte-level pattern knows it, that are too long for the pattern's engine.
LONG_BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")
#: Lower-case letters that no normalization changes; words of these alone are one piece to the tokenizer.
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
WORD = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")

SPACE, LETTER, SIGN, APOSTROPHE, OTHER = range(5)
KIND = np.full(256, OTHER, dtype=np.uint8)
KIND[33:127] = SIGN
KIND[[*range(65, 91), *range(97, 123)]] = LETTER
KIND[39] = APOSTROPHE
KIND[[*range(9, 14), 32]] = SPACE
#: Whether a chunk ends between bytes of two kinds, by 5 * left + right.
CUT = np.zeros((5, 5), dtype=bool)
CUT[SPACE, :] = CUT[:, SPACE] = True
CUT[LETTER, [SIGN, APOSTROPHE]] = CUT[SIGN, LETTER] = True
CUT[SPACE, SPACE] = False
CUT = CUT.ravel()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_READY: dict[str, ChunkEncoder] = {}


class ChunkEncoder:
    """Encode texts chunk by chunk for tokenizers that drop white space and case, and never join letters to other characters but an
    apostrophe before them.

    For such a tokenizer the ids of a text are the ids of its chunks, one after the other: chunks end at ASCII white space and between
    ASCII letters and other ASCII characters, unless an apostrophe comes before the letters. Corpora repeat their chunks, so their ids
    are kept, at most ``limit`` of them (then the store starts anew). Texts that may hold a special token keep their case and end
    chunks at white space only. The ids of a word of ``LETTERS`` come from the file's model at once, those of other chunks from the whole tokenizer.
    """

    def __init__(self, path: str, limit: int = CHUNKS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.model, self.known = self.tokenizer.model, {}
        spelled = [self.pieces(c) for c in LETTERS]
        if self.pieces(LETTERS) != ["".join(p for p, in spelled)]:
            raise ValueError(f"{path} does not take a run of letters as one piece")
        self.spelling = {ord(c): p for c, (p,) in zip(LETTERS, spelled)}

    def pieces(self, text: str) -> list[str]:
        return [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(text))]

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text (null: none) as little-endian unsigned 32-bit numbers."""
        texts = texts.fill_null("")
        special = pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)
        texts = texts.cast(pa.large_binary())
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + BLOCK, "right")) - 1)
            yield from self.block(data[ends[at] : ends[to]], ends[at : to + 1] - ends[at], np.flatnonzero(special[at:to]))
            at = to

    def block(self, data: np.ndarray, ends: np.ndarray, special: np.ndarray) -> Iterator[bytes]:
        """The ids of the texts between ``ends`` of ``data``; the texts numbered in ``special`` may hold special tokens."""
        kinds, lower = KIND[data], LOWER[data]
        black = kinds != SPACE
        cut = np.ones(len(data), dtype=bool)
        cut[1:] = CUT[5 * kinds[:-1] + kinds[1:]]
        for k in special:
            a, b = ends[k], ends[k + 1]
            lower[a:b], cut[a + 1 : b] = data[a:b], black[a : b - 1] != black[a + 1 : b]
        cut[ends[:-1][ends[:-1] < len(data)]] = True
        first = np.searchsorted(np.flatnonzero(cut & black), ends)
        lower, starts = lower[black], np.flatnonzero(cut[black])
        starts = np.append(starts, len(lower)).astype(np.int32)
        chunks = pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(lower)]).dictionary_encode()
        ids = pa.array(self.known_ids(chunks.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(chunks.indices)
        at = np.frombuffer(ids.buffers()[1], np.int64)[first].tolist() if len(ids) else [0] * len(first)
        found = memoryview(ids.buffers()[2] or b"")
        for a, b in zip(at, at[1:]):
            yield bytes(found[a:b])

    def known_ids(self, chunks: list[bytes]) -> list[bytes]:
        """The ids of each of some different chunks."""
        found = list(map(self.known.get, chunks))
        new = [c for c, ids in zip(chunks, found) if ids is None]
        if not new:
            return found
        if len(self.known) + len(new) > self.limit:
            self.known.clear()
            new = chunks
        words = [c for c in new if WORD.fullmatch(c)]
        for c in words:
            self.known[c] = array("I", [t.id for t in self.model.tokenize(c.decode().translate(self.spelling))]).tobytes()
        others = [c for c in new if c not in self.known]
        for k in range(0, len(others), 4096):
            self.learn(others[k : k + 4096])
        return [self.known[c] if ids is None else ids for c, ids in zip(chunks, found)]

    def learn(self, chunks: list[bytes]) -> None:
        """Encode many chunks as one text; each token belongs to the chunk in which it starts."""
        texts = [c.decode() for c in chunks]
        found = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
        starts = np.cumsum([0, *[len(t) + 1 for t in texts[:-1]]])
        at = np.searchsorted(starts, np.array([a for a, _ in found.offsets], dtype=np.int64), "right") - 1
        ends = np.cumsum(np.bincount(at, minlength=len(texts))).tolist()
        ids = np.array(found.ids, dtype="<u4")
        for c, a, b in zip(chunks, [0, *ends[:-1]], ends):
            self.known[c] = ids[a:b].tobytes()


def chunk_encoder(path: str) -> ChunkEncoder:
    """One encoder per file and Python worker."""
    if path not in _READY:
        _READY[path] = ChunkEncoder(path)
    return _READY[path]


def byte_pairs(path: str, specials: tuple[str, ...] = ()):
    """A byte-level encoding from a rank file; the special tokens get the free ids after the ranks."""
    import base64

    import public_tokenizers
    import tiktoken

    key = f"{path}|{specials}"
    if key not in _READY:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        free = max(ranks.values()) + 1
        _READY[key] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={s: free + i for i, s in enumerate(specials)})
    return _READY[key]


def ordinary_ids(model, text: str) -> list[int]:
    """The ids of a text without special tokens, also of texts with very long runs of white space.

    The pattern takes a run but for its last character, or all of a run that ends the text, as one piece; the search of so long a piece overflows
    the engine's stack, so it is cut out here and merged as the piece that it is.
    """
    ids, start = [], 0
    for run in LONG_BLANKS.finditer(text):
        end = run.end() - (run.end() < len(text))
        ids += model.encode_ordinary(text[start : run.start()])
        ids += model._encode_single_piece(text[run.start() : end])
        start = end
    return ids + model.encode_ordinary(text[start:])
