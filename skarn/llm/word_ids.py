"""Token ids of whole texts by the tokenizers library, each distinct word once per worker.

The library's byte-level pre-tokeniser always starts a new piece at a blank or line feed that stands between two characters which are not
white space. A text's ids are therefore the ids of its words, one after another. A batch of texts is cut into words and the words are made
distinct by Arrow; those not seen before go to the library many at a time, joined by blanks (or line feeds), and the ids of each are cut out where a
token starts with a blank. Texts with other white space than single blanks and line feeds between words are cut by a pattern instead.

What is remembered is bounded by bytes; words over LONG bytes are encoded in every batch they occur in.
"""

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Marks keys that are encoded as they stand; others follow a blank.
MARK = "\x01"
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
_SPACE = re.compile(r"\s")
_RARE = r"\t\x0b-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Texts that need the pattern: white space at an end, beside other white space, or of a rare kind; or the mark itself.
_ODD = rf"[ \n][ \n]|\A[ \n]|[ \n]\z|[\x01{_RARE}]"
_SPACED = rf"[ \n{_RARE}]"
#: A letter, then signs up to a word's end: a new piece starts there too, if the signs have no apostrophe and end no added token.
_TAIL = r"([A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}])([!-&(-/:-=?@\[-`{-~]+(?:[ \n]|\z))"
_ENCODERS: dict = {}
#: Bytes of words and ids that a worker remembers before it starts anew; bytes of the longest word that is remembered; words that go to the library as one text.
REMEMBERED, LONG, TOGETHER = 16 << 20, 100, 500


def gathered(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[start : start + size] of each, one after another."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(start - (ends - size), size) + np.arange(total)]


class TextEncoder:
    """many(texts): the ids of all texts one after another and how many each has."""

    def __init__(self, path):
        from tokenizers import Tokenizer

        self.tokenizer = t = Tokenizer.from_file(path)
        self.blank_led = np.zeros(t.get_vocab_size(), bool)
        for token, i in t.get_vocab().items():
            self.blank_led[i] = token[:1] == "Ġ"
        self.tails = all(a.content.endswith(">") for a in t.get_added_tokens_decoder().values())
        self.line = t.encode("\n", add_special_tokens=False).ids
        self._forget()

    def _forget(self):
        self.words = pa.array([f"{MARK}\n"], "string")
        self.flat, self.size = np.asarray(self.line, "u4"), np.asarray([len(self.line)], "i8")

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        each = [np.asarray(e.ids, "u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate(each) if each else np.zeros(0, "u4"), np.asarray([len(x) for x in each], "i8")

    def _joined(self, words: pa.Array, by: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of words without white space, encoded after blanks (by " ") or as they stand (by line feed)."""
        n = len(words)
        at = pa.array([*range(0, n, TOGETHER), n], "int32")
        texts = pc.binary_join(pa.ListArray.from_arrays(at, words), by).to_pylist()
        if by == " ":
            ids, _ = self._library([f" {t}" for t in texts])
            start = np.flatnonzero(self.blank_led[ids])
            size = np.diff(np.r_[start, len(ids)])
        else:
            ids, _ = self._library([f"{t}\n" for t in texts])
            ends = np.flatnonzero(ids == self.line[0])
            size = np.diff(np.r_[-1, ends]) - 1
            ids = np.delete(ids, ends)
        if len(size) != n or int(size.sum()) != len(ids):  # not a vocabulary for which the cuts hold: one by one
            return self._library([by + w if by == " " else w for w in words.to_pylist()])
        return ids, size

    def _learned(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of keys that aren't remembered."""
        as_is = pc.starts_with(new, MARK).to_numpy(zero_copy_only=False)
        spaced = as_is & pc.match_substring_regex(new, _SPACED).to_numpy(zero_copy_only=False)
        groups = [np.flatnonzero(x) for x in (~as_is, as_is & ~spaced, spaced)]
        found = []
        for k, rows in enumerate(groups):
            if not len(rows):
                continue
            words = new.take(pa.array(rows))
            if k:
                words = pc.utf8_slice_codeunits(words, 1)
            found.append((rows, *(self._joined(words, " \n"[k]) if k < 2 else self._library(words.to_pylist()))))
        rows, ids, size = (np.concatenate(x) for x in zip(*found, strict=True))
        start = np.cumsum(size) - size
        o = np.argsort(rows)
        return gathered(ids, start[o], size[o]), size[o]

    def _words(self, keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all keys one after another, and the size of each."""
        d = keys.dictionary_encode()
        at, own = d.indices.to_numpy(), d.dictionary
        place = pc.index_in(own, value_set=self.words)
        missing = np.flatnonzero(place.is_null().to_numpy(zero_copy_only=False))
        place = place.fill_null(0).to_numpy().astype("i8")
        flat, size = self.flat, self.size
        new = None
        if len(missing):
            new = own.take(pa.array(missing))
            ids, n = self._learned(new)
            place[missing] = len(size) + np.arange(len(missing))
            flat, size = np.concatenate([flat, ids]), np.concatenate([size, n])
        start = np.cumsum(size) - size
        which = place[at]
        out = gathered(flat, start[which], size[which]), size[which]
        if new is not None:
            self._remember(new, ids, n, own, place, flat, start, size)
        return out

    def _remember(self, new, ids, n, own, place, flat, start, size):
        short = pc.less_equal(pc.binary_length(new), LONG)
        keep = short.to_numpy(zero_copy_only=False)
        if not keep.all():
            ids, n, new = ids[np.repeat(keep, n)], n[keep], new.filter(short)
        if self.words.nbytes + new.nbytes + 4 * (len(self.flat) + len(ids)) + 8 * (len(self.size) + len(n)) <= REMEMBERED:
            self.words = pa.concat_arrays([self.words, new])
            self.flat, self.size = np.concatenate([self.flat, ids]), np.concatenate([self.size, n])
            return
        self._forget()  # and go on with this batch's own words, as far as the bound lets
        short = pc.and_(pc.less_equal(pc.binary_length(own), LONG), pc.not_equal(own, f"{MARK}\n"))
        own, place = own.filter(short), place[short.to_numpy(zero_copy_only=False)]
        fit = np.cumsum(4 * size[place] + 12 + pc.binary_length(own).to_numpy()) <= REMEMBERED // 2
        own, place = pa.concat_arrays([own.filter(pa.array(fit))]), place[fit]
        self.words = pa.concat_arrays([self.words, own])
        self.flat, self.size = np.concatenate([self.flat, gathered(flat, start[place], size[place])]), np.concatenate([self.size, size[place]])

    def many(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = texts.cast("string").fill_null("")
        n = np.zeros(len(texts), "i8")
        some = pc.not_equal(texts, "")
        odd = pc.match_substring_regex(texts, _ODD)
        plain = np.flatnonzero(pc.and_(some, pc.invert(odd)).to_numpy(zero_copy_only=False))
        rest = np.flatnonzero(pc.and_(some, odd).to_numpy(zero_copy_only=False))
        parts = []
        if len(plain):
            marked = pc.binary_join_element_wise(MARK, texts.take(pa.array(plain)), "")
            if self.tails:
                marked = pc.replace_substring_regex(marked, _TAIL, rf"\1 {MARK}\2")
            lists = pc.split_pattern(pc.replace_substring(marked, "\n", f" {MARK}\n {MARK}"), " ")
            parts.append((plain, lists.flatten(), lists.value_lengths().to_numpy()))
        if len(rest):
            keys = [_keys(t) for t in texts.take(pa.array(rest)).to_pylist()]
            parts.append((rest, pa.array([k for x in keys for k in x], "string"), np.asarray([len(x) for x in keys])))
        if not parts:
            return np.zeros(0, "u4"), n
        ids, size = self._words(pa.concat_arrays([k for _, k, _ in parts]) if len(parts) > 1 else parts[0][1])
        rows, words = np.concatenate([r for r, _, _ in parts]), np.concatenate([w for _, _, w in parts])
        before = np.r_[0, np.cumsum(size)]
        last = np.cumsum(words)
        n[rows] = before[last] - before[last - words]
        if len(parts) > 1:
            start = np.zeros(len(texts), "i8")
            start[rows] = before[last - words]
            ids = gathered(ids, start, n)
        return ids, n


def _keys(text: str) -> list[str]:
    """The keys of a text with unusual white space."""
    return [p[1:] if len(p) > 1 and p[0] == " " and p[1] != MARK and not _SPACE.search(p, 1) else MARK + p for p in _CUT.split(text)]


def text_encoder(path: str) -> TextEncoder:
    """The worker's encoder for a tokenizer file."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _ENCODERS:
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]
