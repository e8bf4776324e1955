"""Token ids of whole texts by the tokenizers library, and the check sums of runs of ids."""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from itertools import chain, islice

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer
from tokenizers.models import BPE
from tokenizers.pre_tokenizers import WhitespaceSplit

VOCABULARY = "word_bpe_49k.json"  # a file of the public tokenizers' folder, or a path of one's own
CACHE_BYTES = 32 << 20  # what a worker keeps of words and their ids in each of two generations, about
LARGE_CACHE = 128 << 20  # the same for a query that does nothing else in its workers
SEEN_SLOTS = 1 << 22  # marks of words met once: only a second time makes a word worth keeping
ENTRY_BYTES = 200  # of an entry, besides the word's own length
BETWEEN = 0xFFFF  # between words' ids; no vocabulary of 16 bits here has it
BLANK = BETWEEN.to_bytes(2, "little")
BETWEEN_ONLY = np.arange(BETWEEN + 1) == BETWEEN
TEXT_BYTES = 2 << 20  # text whose words are held at once, about
# The vocabulary's word rule, for the characters below U+0180 (fixed: contractions, letters, single numbers, other marks).
LATIN = [chr(c) for c in range(33, 0x180)]
LETTERS, NUMBERS, MARKS = ("".join(c for c in LATIN if unicodedata.category(c)[0] in kinds) for kinds in ("L", "N", "PS"))
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
WORD_PARTS = re.compile(f"{CONTRACTIONS}|[{re.escape(LETTERS)}]+|[{re.escape(NUMBERS)}]|[{re.escape(MARKS)}]+| ")  # and the blank between words
# The alphabet of bytes: visible ones stand for themselves, the others for U+0100, U+0101, ... in order (fixed); blanks part.
VISIBLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
ALPHABET = np.arange(0x100, dtype="<u2")
ALPHABET[[b for b in range(0x100) if b not in VISIBLE]] = np.arange(0x100, 0x200 - len(VISIBLE))
ALPHABET[0x20] = 0x20
PLAIN = re.compile(f"[ {re.escape((LETTERS + NUMBERS + MARKS).replace(chr(0x130), ''))}]*")

_encoders: dict[str, "Encoder"] = {}


def encoder(path: str, cache_bytes: int | None = None) -> "Encoder":
    """The encoder of this worker process for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path if "/" in path else public_tokenizers.path(path))
    _encoders[path].cache_bytes = cache_bytes or CACHE_BYTES
    return _encoders[path]


def forget_encoders() -> None:
    """Drop the encoders of this worker process with all they keep, for stages that have no use for them."""
    _encoders.clear()


class Encoder:
    """Ids of texts, equal to encode(text, add_special_tokens=False) of the library.

    This vocabulary's normaliser turns white space into blanks and its word rule
    never matches across one, so a text's ids are those of its blank-separated
    words one after the other. Of the texts handled at once, the different words
    that are not kept from before are encoded together; texts are then put together
    from the words' ids. Words of Latin characters are cut by the word rule here,
    and their different parts go to the library's merges in one call, where each is
    a word that ends with an id for ends; all others (and such as hold a mark that
    may be a special token) are encoded whole, one by one.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.whole = Tokenizer.from_file(path)
        model = json.loads(self.whole.to_str())["model"]  # the same merges, without the library's own cache of words
        self.whole.model = BPE(model["vocab"], [tuple(m) for m in model["merges"]], cache_capacity=0, end_of_word_suffix=model["end_of_word_suffix"])
        self.merges = Tokenizer(self.whole.model)
        self.merges.pre_tokenizer = WhitespaceSplit()
        self.ends = np.zeros(BETWEEN, bool)
        self.ends[[k for t, k in self.whole.get_vocab(with_added_tokens=False).items() if t.endswith("</w>")]] = True
        self.cache_bytes = CACHE_BYTES
        self.forget()

    def forget(self) -> None:
        self.words: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.size = 0
        self.seen, self.marks = np.zeros(SEEN_SLOTS, bool), 0

    def _again(self, items: list) -> list[bool]:
        """Which words or parts have been met before; marks are wiped when half the slots have one."""
        slots = np.fromiter(map(hash, items), np.int64, len(items)) & (SEEN_SLOTS - 1)
        seen = self.seen[slots].tolist()
        self.marks += len(seen) - sum(seen)
        if self.marks > SEEN_SLOTS // 2:
            self.seen[:], self.marks = False, 0
        self.seen[slots] = True
        return seen

    def _keep(self, kept: dict[bytes, bytes]) -> None:
        if self.size > self.cache_bytes:
            self.words, self.older, self.parts, self.size = {}, self.words, {}, 0
        self.size += ENTRY_BYTES * len(kept) + sum(map(len, kept))
        self.words |= kept

    def _merged(self, parts: list[str]) -> list[bytes]:
        """Ids of different parts of words."""
        written = ALPHABET[np.frombuffer(" ".join(parts).encode(), np.uint8)].tobytes().decode("utf-16-le")
        found = cut(np.array(self.merges.encode_batch_fast([written], add_special_tokens=False)[0].ids, np.uint16), self.ends)
        for part, ids, again in zip(parts, found, self._again(parts), strict=True):
            if again:
                self.parts[part] = ids
                self.size += ENTRY_BYTES + len(part)
        return found

    def _encoded(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of different words that are not kept, as 16-bit integers."""
        found = {}
        if not is_latin(b" ".join(words).decode()):
            plain = []
            for word in words:
                text = word.decode()
                if is_latin(text):
                    plain.append(word)
                else:
                    found[word] = np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint16).tobytes()
            words = plain
        if words:
            parts = WORD_PARTS.findall(b" ".join([*words, b""]).decode().lower())
            own = dict.fromkeys(parts)
            own[" "] = BLANK
            own |= {part: self.parts[part] for part in own.keys() & self.parts.keys()}
            new = [part for part, ids in own.items() if ids is None]
            if new:
                own |= zip(new, self._merged(new))
            ids = np.frombuffer(b"".join(map(own.__getitem__, parts)), np.uint16)
            found |= zip(words, [x[:-2] for x in cut(ids, BETWEEN_ONLY)], strict=True)
        return found

    def texts(self, raw: bytes, at: np.ndarray) -> list[np.ndarray]:
        """Ids of each of some UTF-8 texts as unsigned 16-bit integers."""
        out = []
        for a, b in runs(at, TEXT_BYTES):
            bounds = at[a : b + 1].tolist()
            split = [raw[x:y].split() for x, y in zip(bounds, bounds[1:])]
            words = list(chain.from_iterable(split))
            found = list(map(self.words.get, words))
            missing = [k for k, ids in enumerate(found) if ids is None]
            new = dict.fromkeys(map(words.__getitem__, missing))
            kept = {word: self.older[word] for word in self.older.keys() & new.keys()}
            unknown = [word for word in new if word not in kept]
            new |= kept
            new |= self._encoded(unknown)
            self._keep(kept | {word: new[word] for word, again in zip(unknown, self._again(unknown)) if again})
            for k in missing:
                found[k] = new[words[k]]
            rest = iter(found)
            out += [np.frombuffer(b"".join(islice(rest, len(own))), np.uint16) for own in split]
        return out

    def ids(self, text: bytes) -> np.ndarray:
        """Ids of one text."""
        return self.texts(text, np.array([0, len(text)]))[0]


def is_latin(text: str) -> bool:
    """Whether words of this text, or words parted by blanks, may be cut by the word rule here."""
    return PLAIN.fullmatch(text) is not None and "<|" not in text and unicodedata.is_normalized("NFC", text)


def cut(ids: np.ndarray, last: np.ndarray) -> list[bytes]:
    """Runs of ids that each end with the next id of those marked in `last`."""
    raw, to = ids.tobytes(), (2 * np.flatnonzero(last[ids]) + 2).tolist()
    return [raw[a:b] for a, b in zip([0, *to], to)]


def runs(at: np.ndarray, most: int):
    """Rows a to b of texts whose offsets are `at`, with about `most` bytes together or one row."""
    a = 0
    while a < len(at) - 1:
        b = max(a + 1, int(np.searchsorted(at, at[a] + most, "right")) - 1)
        yield a, b
        a = b


def crc_of(ids: np.ndarray) -> int:
    """CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())
