"""Token ids by a public tokenizer, with the ids of frequent words kept."""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

#: Words whose ids a worker keeps (about 0.2 KB each); the older half goes when there are more.
KEPT_WORDS = 600_000
#: Longer texts are cut at white space, so that what is made of a stretch stays small.
STRETCH = 4 << 20
BLANKS = b"\t\n\x0b\x0c\r "
_BLANK = re.compile(rb"[\t-\r ]")

#: What a byte is (0: anything else), and at which pairs a word begins with the second byte.
LETTER, MARK, APOSTROPHE, BLANK = 1, 2, 3, 4
_KIND = np.zeros(256, np.uint8)
_KIND[list(b"abcdefghijklmnopqrstuvwxyz")] = LETTER
_KIND[list(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")] = MARK
_KIND[list(b"'")] = APOSTROPHE
_KIND[list(BLANKS)] = BLANK
_BEGINS = np.zeros((8, 8), bool)
_BEGINS[BLANK, :BLANK] = True
_BEGINS[LETTER, [MARK, APOSTROPHE]] = True
_BEGINS[MARK, LETTER] = True
_BEGINS = _BEGINS.ravel()
#: Second bytes of the two-byte letters that begin with C3.
_LATIN = np.zeros(256, bool)
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False


def path(name: str) -> str:
    """Where the tokenizer's file is on this machine; an absolute path is taken as it is."""
    return name if os.path.isabs(name) else public_tokenizers.path(name)


def plain(text: bytes) -> bool:
    """Whether lower-casing and cutting at punctuation can't matter: no combining marks, no special tokens."""
    return not (b"\xcc" in text or b"\xcd" in text or b"<|" in text)


def stretches(text: bytes) -> Iterator[bytes]:
    """The text, cut at white space."""
    first = 0
    while first < len(text):
        blank = _BLANK.search(text, first + STRETCH)
        until = blank.start() if blank else len(text)
        yield text[first:until]
        first = until


def words_in(texts: list[bytes], cut: bool) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of all texts, and where among them each text's begin and the last one's end.

    With `cut` words also begin where a letter and a punctuation mark meet, but not behind an apostrophe.
    """
    whole = b"".join(part for text in texts for part in (b" ", text))
    codes = np.frombuffer(whole, np.uint8)
    kind = _KIND[codes]
    if not cut:
        kind[kind != BLANK] = 0
    elif b"\xc3" in whole:
        at = np.flatnonzero(codes[:-1] == 0xC3)
        at = at[_LATIN[codes[at + 1]]]
        kind[at] = kind[at + 1] = LETTER
    starts = np.flatnonzero(_BEGINS[(kind[:-1] << 3) | kind[1:]]) + 1
    blanks = np.cumsum(kind == BLANK, dtype=np.int32)
    data = whole.translate(None, BLANKS)
    offsets = np.append(starts - blanks[starts], len(data)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    ends = np.cumsum([0] + [len(text) + 1 for text in texts])
    return words.dictionary_encode(), np.searchsorted(starts, ends)


class WordTokenizer:
    """The ids of texts under a tokenizer that drops white space and never joins words.

    Such a tokenizer gives a text the ids of its words one after the other, so each word is tokenized once.
    It lower-cases too, and starts anew where a letter and a punctuation mark meet; both are done beforehand, as
    they leave fewer different words, but not for texts in which that could matter (combining marks, special tokens).
    """

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path(name))
        self.model = self.tokenizer.model
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def ids(self, text: bytes | None) -> bytes:
        """Little-endian unsigned 32-bit ids; a null text has none."""
        return self.ids_of([text])[0]

    def ids_of(self, texts: list[bytes | None]) -> list[bytes]:
        """The ids of each text."""
        found = [b""] * len(texts)
        for cut in (True, False):
            own = [i for i, text in enumerate(texts) if text and len(text) <= STRETCH and plain(text) == cut]
            for i, ids in zip(own, self.together([texts[i] for i in own], cut), strict=True):
                found[i] = ids
        for i, text in enumerate(texts):
            if text and len(text) > STRETCH:
                cut = plain(text)
                found[i] = b"".join(self.together([part], cut)[0] for part in stretches(text))
        return found

    def together(self, texts: list[bytes], cut: bool) -> list[bytes]:
        """The ids of each text; every different word is looked up once."""
        words, firsts = words_in([text.lower() for text in texts] if cut else texts, cut)
        if not len(words):
            return [b""] * len(texts)
        each = self.look_up(words.dictionary.to_pylist())
        ids = np.frombuffer(b"".join(each), "<u4")
        word = words.indices.to_numpy()
        lengths = np.fromiter(map(len, each), np.int64, len(each)) // 4
        first = np.cumsum(lengths) - lengths
        lengths = lengths[word]
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])
        all_ids = ids[np.repeat(first[word] - ends[:-1], lengths) + np.arange(ends[-1])]
        cuts = ends[firsts].tolist()
        return [all_ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]

    def look_up(self, words: list[bytes]) -> list[bytes]:
        """The ids of different words: known, or from the older ones, or by the tokenizer."""
        if len(self.known) + len(words) > KEPT_WORDS // 2:
            self.known, self.older = {}, self.known
        found = list(map(self.known.get, words))
        mixed = []
        for i, ids in enumerate(found):
            if ids is None:
                word = words[i]
                ids = self.older.get(word)
                if ids is None and word.isalpha() and word.islower():  # the model would get it as it is
                    own = [token.id for token in self.model.tokenize(word.decode())]
                    ids = struct.pack(f"<{len(own)}I", *own)
                if ids is None:
                    mixed.append(i)
                else:
                    found[i] = self.known[word] = ids
        encoded = self.tokenizer.encode_batch_fast([words[i].decode(errors="replace") for i in mixed], add_special_tokens=False)
        for i, one in zip(mixed, encoded, strict=True):
            found[i] = self.known[words[i]] = struct.pack(f"<{len(one.ids)}I", *one.ids)
        return found


@cache
def word_tokenizer(name: str) -> WordTokenizer:
    """One per worker, so that tasks share what is kept."""
    return WordTokenizer(name)
