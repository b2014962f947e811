"""Encoding whole texts through cached units.

A text falls apart into units that a tokenizer encodes independently of each
other, so each distinct unit is encoded once per task and whole texts are put
together from cached values. Units are words as single spaces and single line
ends separate them; a text with any other white space takes the slow path, in
which the pre-tokenizer's own pattern (or the library over the whole text) cuts.
"""

from __future__ import annotations

import ctypes
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Two white space characters in a row, or one that is neither space nor line end (RE2).
ODD_SPACE = (
    r"[ \n][ \n]|[\t\r\v\f\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}"
    r"\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
#: Characters of text worked on at a time, but for a longer text by itself.
SLICE = 1 << 20
#: Estimated bytes of a cache, above which it starts again.
CACHE_BYTES = 64 << 20

_LOADED: dict = {}

try:
    _LIBC = ctypes.CDLL(None)
    _TRIM = _LIBC.malloc_trim
    # arrays of a megabyte and more go back to the system when they are freed
    _LIBC.mallopt(-3, 1 << 20)
except (OSError, AttributeError):
    _TRIM = None


def library_tokenizer(path: str):
    """The tokenizer file, once per process."""
    if path not in _LOADED:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _LOADED[path] = tokenizer
    return _LOADED[path]


#: The encoder whose cache this process holds.
_HOLDER: list = [None]


def only_cache(encoder) -> None:
    """Empty the cache another encoder left: workers live on from stage to stage."""
    held = _HOLDER[0]
    if held is not encoder:
        _HOLDER[0] = encoder
        if held is not None:
            held.clear()
        release_memory()


def release_memory() -> None:
    """Give freed memory back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def slices(texts: list, most: int = SLICE):
    """(first, one past the last) of runs of texts of at most ``most`` characters
    together, or one longer text."""
    first = size = 0
    for k, text in enumerate(texts):
        if k > first and size + len(text) > most:
            yield first, k
            first, size = k, 0
        size += len(text)
    if first < len(texts):
        yield first, len(texts)


class UnitEncoder:
    """Encodes lists of texts into lists of per-unit values.

    ``encode(list of str) -> list of values`` is called with distinct units.
    ``keep_space``: a unit after a space starts with that space (byte-level
    vocabularies); otherwise white space is dropped. ``whole``: cuts a text with
    odd white space into units of its own. ``room``: how much larger a cache, and slices,
    a worker may hold; less costs time alone.
    """

    def __init__(self, encode, keep_space: bool, whole, room: int = 1):
        self.encode, self.keep_space, self.whole = encode, keep_space, whole
        self.cache_bytes, self.slice = room * CACHE_BYTES, min(room, 4) * SLICE
        self.cache: dict = {}
        self.held, self.cleared = 0, lambda: None

    def clear(self) -> None:
        self.cache.clear()
        self.held = 0
        self.cleared()

    def values(self, units: list) -> list:
        """The values of distinct units."""
        cache = self.cache
        out = list(map(cache.get, units))
        missing = [k for k, x in enumerate(out) if x is None]
        if missing:
            new = [units[k] for k in missing]
            got = self.encode(new)
            cache.update(zip(new, got))
            self.held += 250 * len(new) + 2 * sum(map(len, new))
            for k, x in zip(missing, got):
                out[k] = x
        return out

    def texts(self, texts: list):
        """One list of values per text, in order; together they encode it. The cache
        starts again between two slices only, so that values which are places in a
        table hold for a slice."""
        only_cache(self)
        for first, last in slices(texts, self.slice):
            if self.held > self.cache_bytes:
                self.clear()
            yield from self._slice(texts[first:last])

    def places(self, texts: list):
        """(values of all words of all texts, number of words per text) as arrays, for texts
        of one slice, an encoder without white space and values that are whole numbers."""
        only_cache(self)
        if self.held > self.cache_bytes:
            self.clear()
        odd = pc.match_substring_regex(pa.array(texts, type=pa.large_string()), f"{ODD_SPACE}|^[ \\n]|[ \\n]$").to_pylist()
        even = [" ".join(t.split()) if o else t.replace("\n", " ") for t, o in zip(texts, odd)]
        # null has no word, where an empty text would have an empty one
        lists = pc.split_pattern(pa.array([t or None for t in even], type=pa.large_string()), " ")
        del even
        coded = lists.flatten().dictionary_encode()
        values = np.array(self.values(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), dtype=np.int64)
        return values[coded.indices.to_numpy()], pc.fill_null(pc.list_value_length(lists), 0).to_numpy()

    def _slice(self, texts: list):
        odd = pc.match_substring_regex(pa.array(texts, type=pa.large_string()), ODD_SPACE)
        even = [not x for x in odd.to_pylist()]
        if self.keep_space:
            marked = [
                t.replace("\n", "\x1f\n\x1f").replace(" ", "\x1f ") if e else "" for t, e in zip(texts, even)
            ]
        else:
            marked = [t.replace("\n", "\x1f").replace(" ", "\x1f") if e else "" for t, e in zip(texts, even)]
        lists = pc.split_pattern(pa.array(marked, type=pa.large_string()), "\x1f")
        del marked
        coded = lists.flatten().dictionary_encode()
        ends = lists.offsets.to_pylist()
        value = self.values(coded.dictionary.to_pylist()).__getitem__
        at = coded.indices.to_numpy().tolist()
        for k, text in enumerate(texts):
            if even[k]:
                yield list(map(value, at[ends[k] : ends[k + 1]]))
            else:
                units = self.whole(text)
                known = dict(zip(found := list(dict.fromkeys(units)), self.values(found)))
                yield [known[u] for u in units]


#: Letters below U+0100 with at most one comma or full stop behind, and a space before.
_PLAIN = re.compile("( ?[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff]+)[,.]?").fullmatch


def _plain_words(tokenizer, keep_space: bool):
    """units -> bytes of their ids, None where a unit is not plain: a plain unit is one or
    two pre-tokens in either vocabulary and no normalizer composes anything in it, so the
    library's model encodes it without the steps before."""
    from .bpe_automaton import byte_letters

    table = {b: c for c, b in byte_letters().items()}
    apart = chr(0x2028)  # no letter of the alphabet
    tokenize = tokenizer.model.tokenize
    as_bytes = [k.to_bytes(4, "little") for k in range(tokenizer.get_vocab_size(True))]

    def words(texts: list) -> list:
        joined = "\x1f".join(texts) if keep_space else "\x1f".join(texts).lower()
        letters = joined.encode().decode("latin-1").translate({**table, 0x1F: apart}).split(apart)
        return [b"".join([as_bytes[t.id] for t in tokenize(x)]) for x in letters]

    tails = dict(zip(",.", words([",", "."])))

    def encode(units: list) -> list:
        cores = [(u[:-1] if u[-1] in tails else u) if _PLAIN(u) else None for u in units]
        known = list({c for c in cores if c is not None})
        known = dict(zip(known, words(known)))
        return [None if c is None else known[c] if len(c) == len(u) else known[c] + tails[u[-1]] for c, u in zip(cores, units)]

    return encode


def library_units(path: str, keep_space: bool, room: int = 6) -> UnitEncoder:
    """Values are the library's ids as little-endian unsigned 32-bit bytes."""
    key = ("units", path, keep_space, room)
    if key not in _LOADED:
        tokenizer = library_tokenizer(path)
        plain = _plain_words(tokenizer, keep_space)

        def encode(units: list) -> list:
            out = plain(units)
            rest = [k for k, x in enumerate(out) if x is None]
            got = tokenizer.encode_batch_fast([units[k] for k in rest], add_special_tokens=False)
            for k, x in zip(rest, got):
                out[k] = np.array(x.ids, dtype="<u4").tobytes()
            return out

        _LOADED[key] = UnitEncoder(encode, keep_space, lambda text: [text], room)
    return _LOADED[key]


_BATCHES = [0]


def as_texts(column) -> list:
    """A pandas column of texts; null is empty. Called batch by batch, so every few of
    them what the ones before left is given back to the system."""
    _BATCHES[0] += 1
    if _BATCHES[0] % 4 == 0:
        release_memory()
    return [x if isinstance(x, str) else "" for x in column]
