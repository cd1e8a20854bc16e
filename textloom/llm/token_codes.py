"""Token ids of whole texts by the tokenizers library, with words encoded once.

The vocabulary file splits at white space before anything else, so the ids of a
text are those of its chunks between spaces and line feeds, joined. A batch's
distinct chunks are found by Arrow's dictionaries. One of letters below U+0130
and perhaps ASCII punctuation at its end is a lower-cased word and a run of
punctuation, which are tokens apart; words new to a bounded table go to the
library many at a time, through the same BPE model behind a pre-tokenizer that
splits at spaces alone. All other chunks go to the library whole.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MEMO_WORDS = 800_000
#: No apostrophe: contractions are tokens of their own.
_PLAIN = r"^(?P<w>[A-Za-zÀ-ÖØ-öø-į]+)(?P<p>[!-&(-/:-@\[-`{-~]*)$"


def _byte_letters() -> dict[int, int]:
    """Byte-level BPE's letters for bytes: printable ones stand for themselves, the rest for U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return dict(zip(own, own)) | {b: 256 + k for k, b in enumerate(rest)}


def _strings(a: pa.Array) -> list[str]:
    """to_pylist, without a scalar object for each string."""
    return a.to_numpy(zero_copy_only=False).tolist()


class TextEncoder:
    """encode_many(texts) gives an array of ids a text, equal to the library's encode(text, add_special_tokens=False)."""

    def __init__(self, path: str, memo_words: int = MEMO_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocab = self.whole.get_vocab(with_added_tokens=True)
        self.size = max(vocab.values()) + 1
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.ends = np.zeros(self.size, bool)
        for token, k in vocab.items():
            self.ends[k] = token.endswith("</w>")
        self.letters = _byte_letters()
        self.memo_words = memo_words
        self.words: dict[str, bytes] = {}
        self.odd: dict[str, bytes] = {}
        # the word path needs tokens that end where words end, and separate punctuation
        self.by_word = bool(self.ends.any()) and self._one("ab,") == self._one("ab") + self._one(",")

    def _one(self, chunk: str) -> bytes:
        return np.array(self.whole.encode(chunk, add_special_tokens=False).ids, self.dtype).tobytes()

    def _learn_words(self, new: list[str], step: int = 256) -> None:
        coded = [w.encode().decode("latin-1").translate(self.letters) for w in new]
        joined = [" ".join(coded[i : i + step]) for i in range(0, len(coded), step)]
        for k, e in enumerate(self.bare.encode_batch_fast(joined, add_special_tokens=False)):
            ids, part = np.array(e.ids, self.dtype), new[k * step : (k + 1) * step]
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(part):
                raw, size = ids.tobytes(), self.dtype.itemsize
                at = [0, *(cuts * size).tolist()]
                self.words.update(zip(part, map(raw.__getitem__, map(slice, at, at[1:]))))
            else:
                self.words.update((w, self._one(w)) for w in part)

    def _of_words(self, words: list[str]) -> list[bytes]:
        if len(self.words) > self.memo_words:
            self.words = {}
        found = list(map(self.words.get, words))
        new = [w for w, x in zip(words, found) if x is None]
        if new:
            self._learn_words(new)
            found = [self.words[w] if x is None else x for w, x in zip(words, found)]
        return found

    def _of_odd(self, chunks: list[str]) -> list[bytes]:
        if len(self.odd) > self.memo_words // 8:
            self.odd = {}
        for c in chunks:
            if c not in self.odd:
                self.odd[c] = self._one(c)
        return [self.odd[c] for c in chunks]

    def _units(self, chunks: pa.Array) -> tuple[np.ndarray, list[bytes]]:
        """For each distinct chunk two unit numbers; the units' ids."""
        parts = pc.extract_regex(chunks, _PLAIN)
        plain = pc.is_valid(parts).to_numpy(zero_copy_only=False) & self.by_word
        units = np.zeros((len(chunks), 2), np.int64)
        found = [b""]
        good = parts.filter(pa.array(plain))
        for side, of in ((0, self._of_words), (1, self._of_odd)):
            code = pc.struct_field(good, [side])
            code = (pc.utf8_lower(code) if side == 0 else code).dictionary_encode()
            units[plain, side] = code.indices.to_numpy() + len(found)
            found += of(_strings(code.dictionary))
        rest = _strings(chunks.filter(pa.array(~plain)))
        units[~plain, 0] = np.arange(len(rest)) + len(found)
        return units, found + self._of_odd(rest)

    def encode_many(self, texts: pa.Array | list[str | None]) -> list[np.ndarray]:
        arr = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        if not len(arr):
            return []
        lists = pc.split_pattern(pc.replace_substring(pc.fill_null(arr, ""), "\n", " "), " ")
        code = lists.flatten().dictionary_encode()
        units, found = self._units(code.dictionary)
        size = self.dtype.itemsize
        length = np.fromiter(map(len, found), np.int64, len(found)) // size
        ids = np.frombuffer(b"".join(found), self.dtype)
        start = np.cumsum(length) - length
        u = units[code.indices.to_numpy()].ravel()
        n = length[u]
        end = np.cumsum(n)
        total = int(end[-1]) if len(end) else 0
        out = ids[np.repeat(start[u] - (end - n), n) + np.arange(total)]
        cuts = np.concatenate([[0], end])[2 * (np.asarray(lists.offsets) - lists.offsets[0].as_py())]
        return [out[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


_encoders: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """One encoder a Python process and file, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = TextEncoder(path)
    return _encoders[path]


def default_path() -> str:
    """The vocabulary of the registered queries; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
