"""Token ids of whole texts, by the tokenizers library, each different word of a batch encoded once.

A byte-level pre-tokenizer lets a single space begin the next token, never puts letters of both sides of it into one, and ends a token where letters are followed by another
character. So a text may be cut at every space that has other characters than white space on both sides, a piece may be cut behind its leading letters, and the parts' ids, joined, are the
text's. Cutting, telling the different parts and joining their ids are Arrow and numpy operations over the batch; different words go to the library many at a time, and the first REMEMBERED
words that a worker meets only once. Texts with white space beside a space, and all texts where the tokenizer is of another kind, are encoded whole.
"""

from __future__ import annotations

import json
import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words of a text for the library, and such texts it gets together.
AT_ONCE, TOGETHER = 250, 16
#: Words whose ids a worker keeps.
REMEMBERED = 300_000
#: Text to encode at once: the larger, the more often its words occur again.
SLICE_BYTES = 6 << 20
#: Leading letters, and a tail that begins with an ASCII character that is no letter.
_PARTS = r"(?s)^(?P<word>[A-Za-zÀ-ÖØ-öø-ɏ]+)(?P<tail>[\x00-\x40\x5b-\x60\x7b-\x7f].*)?$"


class Encoder:
    """Encodes texts as the bytes of little-endian unsigned ids: of two bytes where the vocabulary allows it, else of four."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        self.width = 2 if self._tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        made = json.loads(self._tokenizer.to_str())
        pre = made.get("pre_tokenizer") or {}
        self._known, self._known_ids = pa.array([], pa.string()), pa.array([], pa.list_(pa.from_numpy_dtype(self.dtype)))
        self._cuts = made.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")

    def _direct(self, texts: list[str]) -> list[bytes]:
        kind = "H" if self.width == 2 else "I"
        return [array(kind, e.ids).tobytes() for e in self._tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _ragged(self, ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The sizes and the joined values."""
        return np.array([len(x) // self.width for x in ids], np.int64), np.frombuffer(b"".join(ids), self.dtype)

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of words of letters, each behind a space: many words are one text, and the pre-tokens tell them apart."""
        sizes, values = [], []
        for at in range(0, len(words), AT_ONCE * TOGETHER):
            groups = [words[i : min(i + AT_ONCE, at + AT_ONCE * TOGETHER)] for i in range(at, min(len(words), at + AT_ONCE * TOGETHER), AT_ONCE)]
            for group, e in zip(groups, self._tokenizer.encode_batch([f" {' '.join(g)}" for g in groups], add_special_tokens=False)):
                n = np.bincount(np.array(e.word_ids, np.int32), minlength=len(group))
                n, ids = (n, np.array(e.ids, self.dtype)) if len(n) == len(group) and n.all() else self._ragged(self._direct([f" {w}" for w in group]))
                sizes.append(n)
                values.append(ids)
        return np.concatenate(sizes or [np.zeros(0, np.int64)]), np.concatenate(values or [np.zeros(0, self.dtype)])

    def _remembered(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of words, most of which have been met before."""
        place = pc.index_in(words, value_set=self._known)
        new = words.filter(place.is_null())
        sizes, values = self._words(new.to_pylist())
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values))
        at = pc.fill_null(place, -1).to_numpy().astype(np.int64)
        at[at < 0] = len(self._known) + np.arange(len(new))
        taken = pa.concat_arrays([self._known_ids, lists]).take(pa.array(at))
        room = REMEMBERED - len(self._known)
        if room > 0 and len(new):
            self._known, self._known_ids = pa.concat_arrays([self._known, new.slice(0, room)]), pa.concat_arrays([self._known_ids, lists.slice(0, room)])
        return np.diff(taken.offsets.to_numpy()).astype(np.int64), taken.flatten().to_numpy()

    def _parts(self, pieces: pa.Array) -> tuple[pa.ListArray, np.ndarray, np.ndarray]:
        """Of different pieces, each behind a space: a list of ids per part, and each piece's first and second part."""
        cut = pc.extract_regex(pieces, _PARTS)
        plain = cut.is_valid().to_numpy(zero_copy_only=False)
        words = pc.struct_field(cut, "word").filter(pa.array(plain)).dictionary_encode()
        tails = pc.struct_field(cut, "tail").filter(pa.array(plain)).dictionary_encode()
        others = pieces.filter(pa.array(~plain)).to_pylist()
        made = [self._remembered(words.dictionary), self._ragged(self._direct([t or "" for t in tails.dictionary.to_pylist()])), self._ragged(self._direct([f" {p}" for p in others])), self._ragged([b""])]
        starts = np.cumsum([0, *(len(m[0]) for m in made)])
        first, second = np.empty(len(pieces), np.int64), np.full(len(pieces), starts[3])
        first[plain], first[~plain] = words.indices.to_numpy(), starts[2] + np.arange(len(others))
        second[plain] = starts[1] + tails.indices.to_numpy()
        offsets = np.concatenate([[0], np.cumsum(np.concatenate([m[0] for m in made]))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([m[1] for m in made]))), first, second

    def encode(self, texts: list[bytes]) -> list[bytes]:
        strings = [t.decode("utf-8", "replace") for t in texts]
        if not self._cuts or not texts:
            return self._direct(strings) if texts else []
        split = pc.split_pattern(pa.array(strings, pa.string()), " ")
        at = split.offsets.to_numpy().astype(np.int64)
        coded = split.flatten().dictionary_encode()
        pieces, of = coded.dictionary, coded.indices.to_numpy()
        # A space beside white space leaves a piece that is empty or has white space at an end.
        odd = pc.or_(pc.equal(pieces, ""), pc.not_equal(pieces, pc.utf8_trim_whitespace(pieces))).to_numpy(zero_copy_only=False)
        whole = np.add.reduceat(odd[of], at[:-1], dtype=np.int64) > 0
        inner = np.repeat(~whole, np.diff(at))
        inner[at[:-1]] = False  # a text's first piece has no space before it
        used = np.zeros(len(pieces), bool)
        used[of[inner]] = True
        lists, first, second = self._parts(pieces.filter(pa.array(used)))
        of = (np.cumsum(used) - 1)[of[inner]]
        taken = lists.take(pa.array(np.stack([first[of], second[of]], axis=1).ravel()))
        ends = taken.offsets.to_numpy().astype(np.int64)
        data = taken.flatten().to_numpy().tobytes()
        before = np.concatenate([[0], np.cumsum(inner)])[at]
        bounds = (self.width * ends[2 * before]).tolist()
        heads = self._direct([s if w else s.split(" ", 1)[0] for s, w in zip(strings, whole.tolist())])
        return [h + data[a:b] for h, a, b in zip(heads, bounds, bounds[1:])]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def default_path() -> str:
    """The public 50k byte-level vocabulary; its place is the installed package's."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
