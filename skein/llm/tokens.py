"""Token ids of whole texts, by the public tokenizer files, with a bounded memo of word-sized units.

A text is cut at places where both supported pre-tokenizers always cut too, so encoding each unit alone and joining the ids
equals encoding the whole text.  Units are words with the space before them; each distinct one of some megabytes is looked
up once, and what the memo lacks goes through the library in smaller units.

Defined cases: a null or empty text has no ids; a text that holds the string of an added token (such as `<|endoftext|>`)
goes through the library as a whole, which gives that token there; a text with white space beyond ASCII is cut by a regular
expression where white space has ids; texts of any length are cut, none is shortened.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np

from .common import remembers
from .hashing import CHUNK, SPACES, Words

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
os.environ.setdefault("RAYON_NUM_THREADS", "1")

#: Characters with the Unicode property White_Space (fixed values), and those of them beyond ASCII.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WIDE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Letters of the Latin blocks below U+0250 whose lower case is letters alone: a mark in it would join what follows.
LATIN = "".join(c for c in map(chr, range(0x250)) if c.isalpha() and c.lower().isalpha())
_UNIT = re.compile(
    rf" ?[{LATIN}]++(?=[\x00-\x7f]|\Z)"  # a whole run of letters: what follows is ASCII and no letter
    r"| ?[!-&(-/:-@\[-`{-~]++(?=[\sA-Za-z0-9]|\Z)"  # a whole run of ASCII marks but the apostrophe
    rf"| ?[^{WHITE}]+"  # anything else up to white space
    rf"|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+",  # white space but its last character, then that one
    re.ASCII,
)
#: For tokenizers that fold case and drop white space: the same places, without the white space.
_FOLDED = re.compile(
    rf"[{LATIN}]++(?=[\x00-\x7f]|\Z)" r"|[!-&(-/:-@\[-`{-~]++(?=[\sA-Za-z0-9]|\Z)" rf"|[^{WHITE}]+",
    re.ASCII,
)
#: Units that are one piece for the pre-tokenizer and, in lower case, the same after the normalizer.
_ONE_PIECE = re.compile(rf" ?(?:[{LATIN}]+|[!-&(-/:-@\[-`{{-~]+)")
DEFAULT_FOLDER = "/opt/tokenizers"
#: Units that one Python worker remembers; beyond it new units are encoded each time.
MEMO_UNITS = 1_000_000
MEMO_LENGTH = 40
#: Bytes of text whose distinct words are looked up together.
GROUP_BYTES = 4 << 20
#: In the last quarter of the memo a unit gets a place when it is met again; slots of hashes tell.
_SLOTS = (1 << 24) - 1
#: Parts the hash of a word after a space from that of the word alone.
_SPACED = np.uint64(0x9D8F3C5B7A61E24D)


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """Where the vocabulary file `name` lies; `public_tokenizers` if it can be imported, else `folder`."""
    if folder is None:
        try:
            import public_tokenizers

            return public_tokenizers.path(name)
        except ImportError:
            folder = DEFAULT_FOLDER
    return os.path.join(folder, name)


def parts_of(text: bytes, most: int) -> Iterator[bytes]:
    """The text in parts of at most `most` bytes, cut before a space between two ASCII letters or digits, or at the next such space."""
    at = 0
    while len(text) - at > most:
        cut = near = at + most
        while not _safe(text, cut) and cut > at:
            cut = text.rfind(b" ", at + 1, cut)
        if cut <= at:
            found = _SAFE.search(text, near)
            if not found:
                break
            cut = found.start() + 1
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


#: Places where all supported tokenizers cut, at or after the space.
_SAFE = re.compile(rb"[0-9A-Za-z] [0-9A-Za-z]")


def _safe(text: bytes, space: int) -> bool:
    return space > 0 and _SAFE.match(text, space - 1) is not None


class Encoder:
    """Encodes whole texts into little-endian unsigned 32-bit ids, as the library does with add_special_tokens=False."""

    def __init__(self, path: str, memo_units: int = MEMO_UNITS):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self._plain, self._tokenizer, self._bare = (Tokenizer.from_file(path) for _ in range(3))
        self._tokenizer.encode_special_tokens = True  # units have no added token, but folding may make one up
        # the same vocabulary and merges, for units that are one piece already
        self._bare.normalizer = normalizers.Sequence([])
        self._bare.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        spec = json.loads(self._tokenizer.to_str())
        steps = spec.get("normalizer") or {}
        self._folds = "Lowercase" in [n.get("type") for n in steps.get("normalizers", [steps])]
        self._cut = (_FOLDED if self._folds else _UNIT).findall
        self._added = [t["content"] for t in spec.get("added_tokens") or []]
        self._words = Words(fold=self._folds)
        self._memo: dict[bytes, bytes] = {}
        self._memo_units, self._met = memo_units, bytearray(_SLOTS + 1)

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        out = [b""] * len(texts)
        group: list[int] = []
        held: list[bytes] = []
        size = 0

        def flush() -> None:
            for i, ids in zip(group, self._encode_group(held), strict=True):
                out[i] = ids

        for i, t in enumerate(texts):
            if not t:
                continue
            if any(a in t for a in self._added):
                out[i] = np.array(self._plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
            elif not self._folds and not t.isascii() and _WIDE.search(t):
                out[i] = b"".join(self._looked_up([u.encode("utf-8", "surrogatepass") for u in self._cut(t)]))
            else:
                b = t.encode("utf-8", "surrogatepass")
                if group and size + len(b) > GROUP_BYTES:
                    flush()
                    group, held, size = [], [], 0
                group.append(i)
                held.append(b)
                size += len(b) + 1
        if group:
            flush()
        return out

    #: A text may be counted in the parts that parts_of gives; the space at a cut stays with the part behind it.
    splits, keeps_space = True, True

    def count_batch(self, texts: list[bytes]) -> np.ndarray:
        """The number of ids of each text, given as UTF-8."""
        counts = np.zeros(len(texts), np.int64)
        group: list[int] = []
        added = [a.encode("utf-8") for a in self._added]
        for i, t in enumerate(texts):
            if not t:
                continue
            if any(a in t for a in added):
                counts[i] = len(self._plain.encode(t.decode("utf-8", "surrogatepass"), add_special_tokens=False).ids)
            elif not self._folds and not t.isascii() and _WIDE.search(text := t.decode("utf-8", "surrogatepass")):
                counts[i] = sum(map(len, self._looked_up([u.encode("utf-8", "surrogatepass") for u in self._cut(text)]))) // 4
            else:
                group.append(i)
        if group:
            parts, back, until_text = self._units([texts[i] for i in group])
            until = np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts))[back] // 4)])
            counts[group] = np.diff(until[until_text], prepend=0)
        return counts

    def _encode_group(self, texts: list[bytes]) -> list[bytes]:
        parts, back, until_text = self._units(texts)
        length = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        flat, begin = np.frombuffer(b"".join(parts), "<u4"), np.cumsum(length) - length
        each = length[back]
        until = np.cumsum(each)
        ids = flat[np.repeat(begin[back] - (until - each), each) + np.arange(int(until[-1]) if len(until) else 0)]
        cuts = np.concatenate([[0], until])[until_text].tolist()
        return [ids[a:b].tobytes() for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]

    def _units(self, texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The ids of the distinct units of texts, which unit stands at each place, and how many places there are up to the end of each text.

        Words are told apart by 64-bit hashes inside a group; the memo is by their bytes.
        """
        data = b"\n".join(texts) + b"\n"
        view, found, at = np.frombuffer(data, np.uint8), [], 0
        while at < len(data):
            end = min(at + CHUNK, len(data))
            while end < len(data) and data[end] not in SPACES:
                end += 1
            h, starts, ends = self._words.located(view[at:end])
            found.append((h, starts + at, ends + at))
            at = end
        h, starts, ends = (np.concatenate(x) for x in zip(*found, strict=True))
        after = np.cumsum([len(t) + 1 for t in texts])  # behind each text and its separator
        until_text = np.searchsorted(starts, after)  # how many words up to the end of each text
        spaced = np.zeros(len(starts), bool)
        gaps: list[tuple[int, int, bytes]] = []
        if not self._folds:
            spaced, gaps = self._gaps(data, view, starts, ends, after, until_text)
            h = h ^ (spaced * _SPACED)
        _, first, back = np.unique(h, return_index=True, return_inverse=True)
        words = [data[a:b] for a, b in zip((starts - spaced)[first].tolist(), ends[first].tolist(), strict=True)]
        if self._folds:
            words = [w.lower() for w in words]
        if gaps:
            place = {g: len(words) + n for n, g in enumerate(dict.fromkeys(g for _, _, g in gaps))}
            words += list(place)
            back = np.insert(back, [j for j, _, _ in gaps], [place[g] for _, _, g in gaps])
            until_text = until_text + np.searchsorted([k for _, k, _ in gaps], np.arange(len(texts)), "right")
        return self._looked_up(words), back, until_text

    @staticmethod
    def _gaps(data: bytes, view: np.ndarray, starts: np.ndarray, ends: np.ndarray, after: np.ndarray, until_text: np.ndarray) -> tuple[np.ndarray, list]:
        """Which words take the space before them, and the white space besides: (word it stands before, text, unit), in order.

        Of white space before a word the last character is the word's own if it is a space, else a unit by itself; the rest
        is one unit, and so is white space at the end of a text.
        """
        owner = np.searchsorted(after, starts, "right")
        begins = np.concatenate([[0], after[:-1]])
        before = np.maximum(np.concatenate([[0], ends[:-1]])[: len(starts)], begins[owner])
        gap = starts - before
        spaced = (gap > 0) & (view[np.maximum(starts, 1) - 1] == 0x20)
        out = []
        for j in np.flatnonzero(gap > spaced).tolist():
            g = data[before[j] : starts[j] - spaced[j]]
            for unit in (g,) if spaced[j] else (g[:-1], g[-1:]):
                if unit:
                    out.append((j, int(owner[j]), unit))
        counts = np.diff(until_text, prepend=0)
        last = np.where(counts > 0, np.concatenate([[0], ends])[until_text], begins)
        tails = [(int(until_text[k]), k, data[last[k] : after[k] - 1]) for k in np.flatnonzero(after - 1 > last).tolist()]
        return spaced, sorted([*tails, *out], key=lambda x: (x[1], x[0])) if tails else out

    def _looked_up(self, units: list[bytes]) -> list[bytes]:
        """The ids of each unit."""
        parts = list(map(self._memo.get, units))
        if missing := {units[k]: None for k, ids in enumerate(parts) if ids is None}:
            new = self._encode(list(missing))
            parts = [new[u] if ids is None else ids for u, ids in zip(units, parts, strict=True)]
            self._remember(new)
        return parts

    def _remember(self, new: dict[bytes, bytes]) -> None:
        memo, met = self._memo, self._met
        for unit, ids in new.items():
            if len(unit) <= MEMO_LENGTH and len(memo) < self._memo_units:
                slot = hash(unit) & _SLOTS
                if met[slot] or 4 * len(memo) < 3 * self._memo_units:
                    memo[unit] = ids
                met[slot] = 1

    def _encode(self, units: list[bytes]) -> dict[bytes, bytes]:
        """Ids of distinct units that the memo lacks, by way of the smaller units they are made of."""
        cut = [self._cut(u.decode("utf-8", "surrogatepass")) for u in units]
        known = {x: self._memo.get(x.encode("utf-8", "surrogatepass")) for own in cut for x in own}
        found = known | self._library([x for x, ids in known.items() if ids is None])
        return {u: b"".join([found[x] for x in own]) for u, own in zip(units, cut, strict=True)}

    def _library(self, units: list[str]) -> dict[str, bytes]:
        """Ids of distinct units, from the library."""
        found: dict[str, bytes] = {}
        one, more = [], []
        for u in units:
            bare = _ONE_PIECE.fullmatch(u) and not (self._folds and (u[0] == " " or u != u.lower()))
            (one if bare else more).append(u)
        for tokenizer, own in ((self._bare, one), (self._tokenizer, more)):
            for i in range(0, len(own), 4096):
                part = own[i : i + 4096]
                ids = [e.ids for e in tokenizer.encode_batch_fast(part, add_special_tokens=False)]
                flat = np.array(array("I", chain.from_iterable(ids)), "<u4").tobytes()
                at = 0
                for unit, x in zip(part, ids, strict=True):
                    found[unit] = flat[at : at + 4 * len(x)]
                    at += 4 * len(x)
        return found


class Pieces:
    """Counts the pieces of texts by a sentencepiece model, without begin and end."""

    def __init__(self, path: str):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        own = map(self._model.id_to_piece, range(self._model.get_piece_size()))
        #: No piece reaches across a space, so a text may be counted in parts; the model puts the space at a cut back itself.
        self.splits, self.keeps_space = not any("\u2581" in p.lstrip("\u2581") for p in own), False

    def count_batch(self, texts: list[bytes]) -> np.ndarray:
        """The number of pieces of each text, given as UTF-8."""
        return np.array(list(map(len, self._model.encode([t.decode("utf-8", "surrogatepass") for t in texts], num_threads=1))), np.int64)


_encoders: dict[str, Encoder | Pieces] = {}
remembers(_encoders.clear)


def encoder(path: str) -> Encoder | Pieces:
    """The encoder of this process for a file; Python workers are reused, so its memo serves later tasks too."""
    if path not in _encoders:
        _encoders[sys.intern(path)] = Pieces(path) if path.endswith(".model") else Encoder(path)
    return _encoders[path]
