"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1, drawn from its code point. A trigram is bound from the vectors of its letters,
each rotated by its place, by multiplication; a text is the bundle (sum) of all its trigrams, and a language the bundle of
its training texts. A text has the language whose profile is nearest by cosine.

Texts are lower-cased and each run of other characters than letters, and each end of the text, is one blank, which is a
letter here. Bundles of a batch are one matrix product: counts of the batch's trigrams by their vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgergraph.llm.common import Lookup, pieces

DIM = 1024
SEED = 71
BATCH, ROWS = 1_000_000, 512  # bytes and texts that are bundled at once
PART = 1 << 20  # code points of a long text that are bundled at once
WIDTH = 1 << 12  # trigrams that one matrix product takes
DIRECT = 1 << 22  # trigrams that an alphabet can have and still be counted in a table
KNOWN = 1 << 14  # trigrams whose vectors a worker keeps: 64 MB
MOST_LANGUAGES = 2048  # profiles are broadcast: 8 KB each, 16 MB at most
UNKNOWN = "und"
BLANK = 32


class Letters:
    """Random vectors of letters, and which code points are letters."""

    def __init__(self) -> None:
        self.kind = np.full(0x110000, -1, np.int8)  # -1: not asked yet
        self.vectors: dict[int, np.ndarray] = {}

    def among(self, codes: np.ndarray) -> np.ndarray:
        """True for the letters of an array of code points."""
        kind = self.kind[codes]
        if (kind < 0).any():
            for c in np.unique(codes[kind < 0]).tolist():
                self.kind[c] = chr(c).isalpha()
            kind = self.kind[codes]
        return kind > 0

    def vector(self, code: int) -> np.ndarray:
        if code not in self.vectors:
            self.vectors[code] = np.random.default_rng([SEED, code]).integers(0, 2, DIM).astype(np.int8) * 2 - 1
        return self.vectors[code]


class Trigrams:
    """Vectors of the trigrams that a worker has met, a row each; forgotten when there are too many."""

    def __init__(self) -> None:
        self.letters = Letters()
        self.vectors = np.empty((KNOWN, DIM), np.float32)
        self._forget()

    def _forget(self) -> None:
        self.places, self.size = Lookup(np.int64), 0

    def rows(self, codes: np.ndarray) -> np.ndarray:
        """Rows of ``vectors`` of at most ``KNOWN`` distinct codes, which are added where they are new."""
        rows, new = self.places.find(codes)
        if self.size + len(new) > KNOWN:
            self._forget()
            new = np.arange(len(codes))
        if len(new):
            rows[new] = np.arange(self.size, self.size + len(new))
            self.vectors[self.size:self.size + len(new)] = self.bound(codes[new])
            self.places.add(codes[new], rows[new])
            self.size += len(new)
        return rows

    def bound(self, codes: np.ndarray) -> np.ndarray:
        out = np.ones((len(codes), DIM), np.float32)
        for place in range(3):
            letters, at = np.unique(codes >> 21 * (2 - place) & 0x1FFFFF, return_inverse=True)
            rolled = np.array([np.roll(self.letters.vector(int(c)), 2 - place) for c in letters], np.float32).reshape(-1, DIM)
            out *= rolled[at]
        return out


@cache
def trigram_table() -> Trigrams:
    """One table for each Python worker."""
    return Trigrams()


def symbols(letters: Letters, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Letters and single blanks of all texts and the text each is of, in parts of bounded size, however long a text is.

    Each text is between two blanks, and a part begins with the last two symbols of the one before.
    """
    padded = [f" {t.lower()} " for t in texts]
    line, ends = "".join(padded), np.cumsum([len(t) for t in padded])
    z, owner = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for at in range(0, len(line), PART):
        codes = np.frombuffer(line[at:at + PART].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        z = np.concatenate([z[-2:], np.where(letters.among(codes), codes, BLANK)])
        owner = np.concatenate([owner[-2:], np.searchsorted(ends, np.arange(at, at + len(codes)), "right")])
        kept = z != BLANK  # of blanks in a row, the first; the last two symbols of the part before are kept already
        kept[1:] |= (z[:-1] != BLANK) | (owner[1:] != owner[:-1])
        kept[0] = True
        z, owner = z[kept], owner[kept]
        yield z, owner


def trigrams(z: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct trigrams of symbols, ascending, and for each place its number and the text it is of."""
    present = np.flatnonzero(np.bincount(z))
    rank = np.zeros(present[-1] + 1 if len(present) else 0, np.int64)
    rank[present] = np.arange(len(present))
    m, whole = len(present), owner[:-2] == owner[2:]
    code = ((rank[z[:-2]] * m + rank[z[1:-1]]) * m + rank[z[2:]])[whole]
    if m**3 <= DIRECT:
        seen = np.zeros(m**3, bool)
        seen[code] = True
        distinct, kind = np.flatnonzero(seen), (np.cumsum(seen) - 1)[code]
    else:
        distinct, kind = np.unique(code, return_inverse=True)
    return present[distinct // (m * m)] << 42 | present[distinct // m % m] << 21 | present[distinct % m], kind, owner[:-2][whole]


def bundles(known: Trigrams, texts: list[str], group: np.ndarray, n: int) -> np.ndarray:
    """The sums of the trigram vectors of the texts of each of ``n`` groups."""
    out = np.zeros((n, DIM))
    for z, of in symbols(known.letters, texts):
        distinct, kind, owner = trigrams(z, of)
        for at in range(0, len(distinct), KNOWN):
            mine = slice(None) if len(distinct) <= KNOWN else (kind >= at) & (kind < at + KNOWN)
            row, to = known.rows(distinct[at:at + KNOWN])[kind[mine] - at], group[owner[mine]]
            for low in range(0, known.size, WIDTH):
                width = min(WIDTH, known.size - low)
                some = slice(None) if known.size <= WIDTH else (row >= low) & (row < low + width)
                counts = np.bincount(to[some] * width + row[some] - low, minlength=n * width)
                out += counts.reshape(n, -1).astype(np.float32) @ known.vectors[low:low + width]  # whole numbers below 2^24: exact
    return out


def held_out(doc_id: Column) -> Column:
    """True if crc32 of the id as text is 1 modulo 3; a null id counts as the empty text."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(3)) == 1


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text", BATCH):
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def profiles(docs: DataFrame) -> DataFrame:
    """``lang string, at int, value long``: the bundle of each language of ``docs (text, lang)``, one row per dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sums = trigram_table(), {}
        for batch in parts(batches):
            langs = batch.column(1).dictionary_encode()
            found = bundles(known, batch.column(0).to_pylist(), langs.indices.to_numpy().astype(np.int64), len(langs.dictionary))
            for lang, vector in zip(langs.dictionary.to_pylist(), found, strict=True):
                sums[lang] = sums[lang] + vector if lang in sums else vector
        for lang, vector in sums.items():
            yield pa.record_batch({"lang": pa.array([lang] * DIM), "at": np.arange(DIM, dtype=np.int32), "value": vector.astype(np.int64)})

    found = docs.select("text", "lang").mapInArrow(run, "lang string, at int, value long")
    return found.groupBy("lang", "at").agg(F.sum("value").alias("value"))


def predict(docs: DataFrame) -> DataFrame:
    """The language of each whole text, learned from the documents with a language that aren't held out.

    Reads doc_id, text and lang; returns ``doc_id, held_out, lang_pred, score``, the score being the cosine with the profile
    of the language, 0 if that is negative. Of equal cosines the least language in code-point order is taken. Texts that are
    null, empty or without a letter have the language ``und`` and score 0, as have all texts if there is nothing to learn
    from. Null ids and repeated rows are treated like others, an empty table gives an empty result, and other columns are
    ignored. Profiles are broadcast; more than ``MOST_LANGUAGES`` languages are an error.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    learned = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    table = profiles(learned).where("value != 0")
    languages = sorted(r.lang for r in table.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    rows = table.toArrow()
    matrix = np.zeros((len(languages), DIM), np.float64)
    if languages:
        matrix[np.searchsorted(languages, rows["lang"].to_pylist()), rows["at"].to_numpy()] = rows["value"].to_numpy()
        matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    shared = docs.sparkSession.sparkContext.broadcast((np.array([*languages, UNKNOWN], object), matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, (names, directions) = trigram_table(), shared.value
        for batch in parts(batches):
            texts = [t or "" for t in batch.column(2).to_pylist()]
            found = bundles(known, texts, np.arange(len(texts)), len(texts))
            length = np.linalg.norm(found, axis=1)
            best, score = np.full(len(texts), len(names) - 1), np.zeros(len(texts))
            some = np.flatnonzero(length > 0)
            if len(directions) and len(some):
                cosine = found[some] @ directions.T / length[some, None]
                best[some] = cosine.argmax(1)
                score[some] = np.clip(cosine.max(1), 0, 1)
            yield pa.record_batch({"doc_id": batch.column(0), "held_out": batch.column(1), "lang_pred": pa.array(names[best].tolist(), pa.string()), "score": score})

    asked = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return asked.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
