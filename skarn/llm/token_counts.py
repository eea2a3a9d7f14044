"""2. Token counts with overlap resynchronisation for long documents.

Two neighbouring characters that no piece of the vocabulary holds side by side are never merged, directly or later: between them is a stable boundary,
where a text's tokens are those of its two sides, whatever else the text holds. (The model's normalisation must be the identity, but for blanks,
which it reads as the mark U+2581; other models count whole texts by the library.)

Documents over chunk_chars are cut into chunks that overlap. Each chunk is encoded by the library with the offsets of its tokens. Two
neighbouring chunks are spliced at the first place in their overlap where a token starts in both and which is a stable boundary; tokens before it are counted in one, the others in the next.
Where an overlap has no such place the chunk is encoded again with an overlap twice as wide, until there is one or the text ends,
so the result is always exactly the library's and no more than a chunk with its overlap is encoded at once. Shorter documents are counted word by word: no
piece has the mark after another character, so blanks are stable boundaries, and a worker remembers the counts of words.

Defined results: a null text counts as empty (0 tokens); repeated rows and null ids are counted each; a very long text is counted whole; an empty table gives
no rows; other columns are not read. There are no ties.
"""

import re
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_COUNTERS: dict = {}
_SEGMENTS = re.compile(r" *[^ ]+| +\Z")
#: Bytes of words that a worker remembers, in two halves of which the older is let go; characters of the longest word that is remembered.
REMEMBERED, LONG = 48 << 20, 100


class _Counts(dict):
    """Word after the blank that marks it -> tokens."""

    def __init__(self, count):
        self.count, self.old, self.size = count, {}, 0

    def __missing__(self, word):
        n = self.old.get(word)
        if n is None:
            n = self.count(word)
        if len(word) <= LONG:
            if self.size >= REMEMBERED // 2:
                self.old, self.size = dict(self), 0
                self.clear()
            self[word] = n
            self.size += sys.getsizeof(word) + 100  # and its place in the table
        return n


class PieceCounter:
    def __init__(self, path: str):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [m.id_to_piece(i) for i in range(m.vocab_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i))]
        #: Characters that stand side by side in some piece.
        self.together = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        signs = "".join({c for p in pieces for c in p}) + "\ufb01\u00bd\u2460e\u0301\t\n\u3000\xa0"
        self.plain = m.normalize(f"  {signs}  ").removeprefix("▁") == f"  {signs}  ".replace(" ", "▁")
        #: No piece has the mark after another character: blanks cut cleanly.
        self.stable = self.plain and not any(p[1] == "▁" and p[0] != "▁" for p in self.together)
        self.words = _Counts(lambda w: len(self.model.encode(w)))

    def cuts(self, text: str, p: int) -> bool:
        """Whether there is a stable boundary before the character at p."""
        return text[p - 1 : p + 1].replace(" ", "▁") not in self.together

    def starts(self, text: str) -> np.ndarray:
        """Where the text's tokens start, by the library's offsets (a byte of a character the vocabulary hasn't starts where the character does)."""
        return np.fromiter((a for a, _ in self.model.encode(text, return_type="offset_mapping")["offsets"]), "i8")

    def _blanks(self, n: int) -> int:
        """Tokens of n blanks at the end of a text that has something before them."""
        return len(self.model.encode("a" + " " * n)) - len(self.model.encode("a"))

    def _segment(self, text: str, first: bool) -> int:
        """Tokens of a stretch that starts at a stable boundary (its first blank is the word mark) or a text's start."""
        if first:
            return self.words[text]
        return self._blanks(len(text)) if not text.strip(" ") else self.words[text[1:]]

    def count(self, text: str) -> int:
        """The count of a text, word by word."""
        if not text:
            return 0
        if not self.stable:
            return len(self.model.encode(text))
        text = text.replace("▁", " ")
        if "  " not in text and text[0] != " " and text[-1] != " ":
            return sum(map(self.words.__getitem__, text.split(" ")))
        return sum(self._segment(s, i == 0) for i, s in enumerate(_SEGMENTS.findall(text)))


def count_by_chunks(counter: PieceCounter, text: str, chunk: int, overlap: int) -> int:
    """The count of a long text: overlapping chunks, spliced at stable boundaries that both have."""
    size = len(text)
    at, left, total, wide = 0, 0, 0, overlap
    stop = min(size, chunk + wide)
    mine = counter.starts(text[:stop])
    while stop < size:
        cut = at + chunk
        their_stop = min(size, max(cut + chunk + overlap, stop))
        theirs = cut + counter.starts(text[cut:their_stop])
        both = np.intersect1d(mine, theirs)
        place = next((p for p in both[(both > cut) & (both < stop)].tolist() if counter.cuts(text, p)), None)
        if place is None:  # not aligned: a wider overlap
            wide *= 2
            stop = min(size, cut + wide)
            mine = at + counter.starts(text[at:stop])
            continue
        total += int(np.searchsorted(mine, place) - np.searchsorted(mine, left))
        at, left, mine, stop, wide = cut, place, theirs, their_stop, overlap
    return total + len(mine) - int(np.searchsorted(mine, left))


def count_tokens(docs: DataFrame, model: str, *, limit: int, chunk_chars: int = 4096, overlap: int = 256) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit)."""

    def run(batches):
        if model not in _COUNTERS:
            _COUNTERS[model] = PieceCounter(model)
        counter = _COUNTERS[model]
        for b in batches:
            n = [counter.count(t or "") if len(t or "") <= chunk_chars or not counter.plain else count_by_chunks(counter, t, chunk_chars, overlap) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, "int64")], names=["doc_id", "n_bytes", "n_tokens"])

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
