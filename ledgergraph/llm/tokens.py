"""Token ids by the tokenizers library, encoding each distinct word once per task instead of each occurrence."""

from __future__ import annotations

import os
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex

from ledgergraph.llm.common import Lookup, ragged, words_of

CACHED_PARTS = 1_500_000  # kept by a worker for all its tasks: about 90 MB
_PART = regex.compile(r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
_ENCODERS: dict[str, WordEncoder] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoder(path: str) -> WordEncoder:
    """One encoder per Python worker and tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _spaced(word: str) -> str:
    """The parts of a word of any script, spaced; unnormalised words stay whole."""
    return word if word.isalpha() or not unicodedata.is_normalized("NFC", word) else " ".join(_PART.findall(word))


class _Rows:
    """A growing table of id lists in two flat arrays."""

    def __init__(self) -> None:
        self.flat, self.ends = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64)
        self.rows = self.used = 0

    def add(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        ends = self.used + np.cumsum(lengths)
        if self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat[:self.used], np.zeros(max(len(flat), self.used // 2), np.uint32)])
        if self.rows + 1 + len(ends) > len(self.ends):
            self.ends = np.concatenate([self.ends[:self.rows + 1], np.zeros(max(len(ends), self.rows // 2), np.int64)])
        self.flat[self.used:self.used + len(flat)] = flat
        self.ends[self.rows + 1:self.rows + 1 + len(ends)] = ends
        self.used, self.rows = self.used + len(flat), self.rows + len(ends)

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of these rows one after the other, and the length of each."""
        starts = self.ends[rows]
        lengths = self.ends[rows + 1] - starts
        return self.flat[ragged(starts, lengths)], lengths


class WordEncoder:
    """Encodes columns of texts with a tokenizer that drops white space and never joins over it.

    A text's ids are then those of its words in turn, so distinct words are encoded once and looked up afterwards.
    Words are cut into runs of letters, single digits and runs of symbols, which are encoded many to a call and kept;
    where the number of word ends in an answer is not the number of parts, each part is encoded by itself. Words that
    the tokenizer may cut otherwise (apostrophes, special tokens, unnormalised letters) stay whole. The cache is
    emptied when it is full.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.word_end = np.zeros(self.size, bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.word_end[i] = token.endswith("</w>")
        self._clear()

    def _clear(self) -> None:
        self.parts = Lookup(np.int64)
        self.part_ids = _Rows()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts in one array (uint32), and where each text's ids end."""
        if not pc.any(pc.match_substring(texts, "<|")).as_py():
            texts = pc.ascii_lower(texts)  # the tokenizer lowers letters anyway; special tokens are found before that
        flat, doc_ends = words_of(texts)
        if not len(flat):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        words = flat.dictionary_encode()
        ids, ends = self._words(words.dictionary)
        places = words.indices.to_numpy(zero_copy_only=False)
        lengths = np.diff(ends)[places]
        return ids[ragged(ends[places], lengths)], np.concatenate([[0], np.cumsum(lengths)])[doc_ends]

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of each of these words, and where they begin and end."""
        spaced = pc.replace_substring_regex(words, "([A-Za-z]+|[0-9]|[^A-Za-z0-9]+)", r"\1 ")
        other = pc.invert(pc.string_is_ascii(words))
        spaced = pc.replace_with_mask(spaced, other, pa.array([_spaced(w) for w in words.filter(other).to_pylist()], pa.string()))
        alone = pc.or_(pc.match_substring(words, "'"), pc.match_substring(words, "<|"))
        flat, ends = words_of(pc.if_else(alone, words, spaced))
        coded = flat.dictionary_encode()
        rows = self._rows(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]
        ids, lengths = self.part_ids.take(rows)
        return ids, np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], ends])]

    def _rows(self, parts: pa.Array) -> np.ndarray:
        """Row of each of these distinct parts in the table of ids; parts are known by 63 bits of a hash."""
        if self.part_ids.rows + len(parts) > CACHED_PARTS:
            self._clear()
        names = parts.to_numpy(zero_copy_only=False)
        keys = (pd.util.hash_array(names, categorize=False) >> np.uint64(1)).astype(np.int64)
        rows, unknown = self.parts.find(keys)
        if len(unknown):
            marked = np.array(["'" in p for p in names[unknown]])
            before = self.part_ids.rows
            self._encode_parts(names[unknown[~marked]].tolist())
            self._encode_each(names[unknown[marked]].tolist())
            rows[np.concatenate([unknown[~marked], unknown[marked]])] = np.arange(before, self.part_ids.rows)
            self.parts.add(keys[unknown], rows[unknown])
        return rows

    def _encode_parts(self, parts: list[str], step: int = 32) -> None:
        groups = [parts[i:i + step] for i in range(0, len(parts), step)]
        for group, got in zip(groups, self._ids([" ".join(g) for g in groups]), strict=True):
            ends = np.flatnonzero(self.word_end[got]) + 1
            if len(ends) != len(group) or ends[-1] != len(got):
                self._encode_each(group)
            else:
                self.part_ids.add(got, np.diff(ends, prepend=0))

    def _encode_each(self, parts: list[str]) -> None:
        got = self._ids(parts)
        if got:
            self.part_ids.add(np.concatenate(got), np.fromiter(map(len, got), np.int64, len(got)))

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
