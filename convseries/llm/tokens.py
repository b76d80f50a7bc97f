"""Token ids of whole texts, batch by batch.

A text is cut where the tokenizer cuts it anyway (pieces of about a word), every distinct piece of a batch is encoded
once by the tokenizers library, and the ids of the texts are put together with array operations. Pieces seen before in
the same column are remembered up to a bound.
"""

from __future__ import annotations

import contextlib
import json
import re
from functools import lru_cache

import numpy as np

from convseries.llm.common import IS_WHITE, WHITE, text_chunks

#: Bytes that begin a character that is certainly not white space.
_SOLID = np.zeros(256, bool)
_SOLID[33:127] = True
_SOLID[0xC3:0xE1] = True
_SOLID[0xE4:0xF5] = True
#: Pieces that are remembered before it starts anew.
REMEMBERED = 300_000


def _flags(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for first, last in ranges:
        out[first : last + 1] = True
    return out


#: Last bytes and first bytes of letters without a doubt: ASCII, and Latin-1 letters by their lead byte C3.
_ASCII_LETTER = _flags((65, 90), (97, 122))
_C3_LETTER = _flags((0x80, 0x96), (0x98, 0xB6), (0xB8, 0xBF))
#: ASCII signs but for the apostrophe, which can begin a piece with letters.
_SIGN = _flags((33, 38), (40, 47), (58, 64), (91, 96), (123, 126))


def _letter_cuts(buf: np.ndarray, cut: np.ndarray) -> None:
    """Cuts between a letter and a sign, either way round."""
    before, after = buf[:-1], buf[1:]
    ends = _ASCII_LETTER[before]
    ends[1:] |= (buf[:-2] == 0xC3) & _C3_LETTER[before[1:]]
    begins = _ASCII_LETTER[after]
    begins[:-1] |= (after[:-1] == 0xC3) & _C3_LETTER[buf[2:]]
    cut[1:-1] |= (ends & _SIGN[after]) | (_SIGN[before] & begins)


def _byte_level_cuts(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Cuts of a byte-level pre-tokenizer with the usual pattern: before the last white space that precedes a solid character of its text, and after it unless it is a space (which the next word takes); between letters and signs."""
    cut = np.zeros(len(buf) + 1, bool)
    if len(buf) > 1:
        before = IS_WHITE[buf[:-1]] & _SOLID[buf[1:]]
        ends = offsets[(offsets > 0) & (offsets < len(buf))]
        before[ends - 1] = False  # what follows belongs to the next text
        cut[:-2] |= before
        cut[1:-1] |= before & (buf[:-1] != 32)
        _letter_cuts(buf, cut)
    return cut


def _word_cuts(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Cuts of a pre-tokenizer that drops white space: where a word begins after ASCII white space; between letters and signs. All look at the two sides of the cut only, and a cut between two texts is one anyway."""
    cut = np.zeros(len(buf) + 1, bool)
    if len(buf) > 1:
        cut[1:-1] = IS_WHITE[buf[:-1]] & ~IS_WHITE[buf[1:]]
        _letter_cuts(buf, cut)
    return cut


CUTS = {"byte": _byte_level_cuts, "word": _word_cuts}
#: The parts of a tokenizer's file that the cuts rely on; others are encoded text by text.
# The patterns of the two kinds of files.
RELIED_ON = {
    "byte": {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}},
    "word": {
        "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
        "pre_tokenizer": {
            "type": "Sequence",
            "pretokenizers": [
                {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
                {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
            ],
        },
    },
}


def _cuts_hold(tokenizer, kind: str) -> bool:  # noqa: ANN001
    """Whether the file is of the kind whose cuts are known: its normaliser, pre-tokenizer and a plain BPE model, and added tokens that take no white space beside them."""
    found = json.loads(tokenizer.to_str())
    model = found["model"]
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "byte_fallback", "ignore_merges", "continuing_subword_prefix"))
    added = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in found["added_tokens"])
    return plain and added and not found.get("truncation") and all(found.get(k) == v for k, v in RELIED_ON[kind].items())


_LETTERS, _SIGNS = "[A-Za-zÀ-ÖØ-öø-ÿ]+", r"[!-&(-/:-@\[-`{-~]+"
#: Pieces that the pre-tokenizer leaves whole, so that they can go to the BPE model itself.
WHOLE = {"byte": re.compile(f" ?(?:{_LETTERS}|{_SIGNS})"), "word": re.compile(rf"(?:{_LETTERS}|{_SIGNS})[ \t\n\x0b\x0c\r]*")}


def _byte_alphabet() -> dict[int, str]:
    """The printable stand-ins of a byte-level vocabulary: printable Latin-1 bytes stand for themselves, the others follow from 256."""
    same = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in same]
    return {b: chr(b) for b in same} | {b: chr(256 + k) for k, b in enumerate(others)}


_ALPHABET = _byte_alphabet()


class PieceEncoder:
    """Encodes texts by pieces. kind: 'byte' for byte-level vocabularies, 'word' for those that drop white space. A file whose rules are not those of its kind is encoded text by text."""

    def __init__(self, path: str, kind: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.cuts, self.whole, self.kind = Tokenizer.from_file(path), CUTS[kind], WHOLE[kind], kind
        self.by_pieces = _cuts_hold(self.tokenizer, kind)
        self.model = self.tokenizer.model
        self.marks = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.table = {c: "".join(_ALPHABET[b] for b in chr(c).encode()) for c in range(256)}
        self._reset()

    def forget(self) -> None:
        """Gives memory back: workers live on, and other stages need it."""
        import ctypes
        import gc

        import pyarrow as pa

        self._reset()
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)

    def _reset(self) -> None:
        self.slots: dict[str, int] = {}
        self.ids = np.zeros(1 << 20, np.uint32)
        self.starts = np.zeros(1 << 18, np.int64)  # starts[slot + 1] is the end of slot
        self.used = 0

    def _encoded(self, pieces: list[str]) -> list[list[int]]:
        """The ids of each piece: by the model where it is one pre-token, else by the whole tokenizer."""
        out: list = [None] * len(pieces)
        rest = []
        for k, piece in enumerate(pieces):
            if self.whole.fullmatch(piece):
                if self.kind == "word":
                    piece = piece.rstrip(WHITE).lower()
                out[k] = [t.id for t in self.model.tokenize(piece.translate(self.table))]
            else:
                rest.append(k)
        for k, e in zip(rest, self.tokenizer.encode_batch([pieces[k] for k in rest], add_special_tokens=False)):
            out[k] = e.ids
        return out

    def _cut(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where texts are cut. The text before an added token ends there, and there is no cut inside the token."""
        raw, found = buf.tobytes(), []
        for mark in self.marks:
            at = raw.find(mark)
            while at >= 0:
                found.append((at, len(mark)))
                at = raw.find(mark, at + 1)
        cut = self.cuts(buf, np.concatenate([offsets, np.array([at for at, _ in found], np.int64)]))
        for at, n in found:
            cut[at + 1 : at + n] = False
        cut[offsets] = True
        return cut

    def _learn(self, pieces: list[str]) -> None:
        for k in range(0, len(pieces), 20_000):
            part = pieces[k : k + 20_000]
            found = self._encoded(part)
            sizes = np.fromiter((len(x) for x in found), np.int64, len(found))
            flat = np.fromiter((i for x in found for i in x), np.uint32, int(sizes.sum()))
            while self.used + len(flat) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            n = len(self.slots)
            while n + len(part) + 1 > len(self.starts):
                self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.ids[self.used : self.used + len(flat)] = flat
            self.starts[n + 1 : n + 1 + len(part)] = self.used + np.cumsum(sizes)
            self.slots.update(zip(part, range(n, n + len(part))))
            self.used += len(flat)

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the first id of each text (one more at the end)."""
        import pyarrow as pa

        if not self.by_pieces:
            raw = buf.tobytes()
            found = [e.ids for e in self.tokenizer.encode_batch([raw[a:b].decode() for a, b in zip(offsets[:-1], offsets[1:])], add_special_tokens=False)]
            return np.array([i for ids in found for i in ids], np.uint32), np.concatenate([[0], np.cumsum([len(ids) for ids in found])]).astype(np.int64)
        bounds = np.flatnonzero(self._cut(buf, offsets))
        if len(bounds) < 2:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        pieces = pa.Array.from_buffers(pa.large_string(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(buf))])
        coded = pieces.dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.slots) + len(words) > REMEMBERED:
            self._reset()
        self._learn([w for w in words if w not in self.slots])
        slot = np.fromiter(map(self.slots.__getitem__, words), np.int64, len(words))
        at = slot[coded.indices.to_numpy(zero_copy_only=False)]
        first, size = self.starts[at], self.starts[at + 1] - self.starts[at]
        ends = np.cumsum(size)
        where = np.repeat(first - (ends - size), size) + np.arange(ends[-1])
        upto = np.concatenate([[0], ends])
        return self.ids[where], upto[np.searchsorted(bounds, offsets)]


@lru_cache(maxsize=2)
def encoder(path: str, kind: str) -> PieceEncoder:
    """One encoder for each Python worker."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return PieceEncoder(path, kind)


def encoded_texts(column, path: str, kind: str, end_id: int | None = 0, chunk_bytes: int = 2_000_000):
    """For slices of an Arrow string column: (first row, ids, offsets) with end_id after each text."""
    enc = encoder(path, kind)
    for row, buf, offsets in text_chunks(column, chunk_bytes):
        ids, first = enc.encode(buf, offsets)
        if end_id is not None:
            ids = np.insert(ids, first[1:], np.uint32(end_id))
            first = first + np.arange(len(first))
        yield row, ids, first
    enc.forget()
