"""Exact token ids of whole texts, with a bounded cache of short pieces.

A text is cut only where the tokenizer itself always cuts, so that the ids of the
pieces, put one after another, are the ids of the text:

* ``words``: the tokenizer drops white space, so every space and line end is a cut;
* ``bytes``: a space that stands before a character that is no white space opens a
  new pre-token whatever stands before it, and white space before such a space is a
  pre-token of its own: it stays at the end of the piece before.

Pieces repeat, so most of them are found in the cache and never reach the library.
Long pieces are encoded but not kept, and a full cache drops all but its first pieces: its
memory has a bound that does not depend on the input.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tidemark.llm.common import worker_keeps

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Bound of the cache: pieces held, those of them that stay when it is full (the first met, which are the frequent ones), and the length of a piece that is held.
CACHE_PIECES = 1_200_000
CACHE_CORE = 800_000
PIECE_CHARS = 48
#: A word, signs, and perhaps a line end, a word and signs.  Letters that stay letters in lower case and are not composed with others; signs that are neither space, letter, digit nor apostrophe.
_SIMPLE = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([-.,;:!?#$%&*()]*)(?:\n([A-Za-zÀ-ÖØ-öø-ÿ]+)([-.,;:!?#$%&*()]*))?")
#: Pieces given to the library at once, and characters of text decoded and encoded at once.
LIBRARY_BATCH = 4096
WORK_CHARS = 500_000
ENCODE_CHARS = 30_000


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; a path that exists is taken as it is."""
    if os.path.sep in name and os.path.exists(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def pack_ids(ids: Iterable[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if sys.byteorder != "little":
        out.byteswap()
    return out.tobytes()


#: Characters that byte-level vocabularies have for bytes: printable ones for themselves, the others follow from U+0100 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: b if b in _PRINTABLE else 256 + sum(c not in _PRINTABLE for c in range(b)) for b in range(256)}
#: What stands for a piece that can't be cut off; no ids are a single byte.
_UNCUT = b"-"
#: A space that doesn't open a pre-token with the character after it, and one that does.
_SPACES = re.compile(r" (?=\s|$)")
_OPENING = re.compile(r" (?=\S)")


class PieceEncoder:
    """Encodes texts to packed ids (see ``pack_ids``) by way of cached pieces."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import Split

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        kind = json.dumps(said.get("pre_tokenizer"))
        safe = all(not t.get("lstrip") and not t.get("rstrip") and not any(c.isspace() for c in t["content"]) for t in said.get("added_tokens", []))
        if not safe:
            self.mode = "whole"
        elif '"Removed"' in kind:
            self.mode = "words"
        elif said.get("normalizer") is None and '"ByteLevel"' in kind and '"use_regex": true' in kind and '"add_prefix_space": true' not in kind:
            self.mode = "bytes"
        else:
            self.mode = "whole"
        self.cache: dict[str, bytes] = {}
        #: Signs, and words without a space before them.
        self.bare: dict[str, bytes] = {}
        self.model_alone = Tokenizer(self.tokenizer.model)
        self.model_alone.pre_tokenizer = Split("Ġ", "merged_with_next") if self.mode == "bytes" else Split(" ", "removed")
        self.line_end = self.whole(["\n"])[0] if self.mode == "bytes" else b""
        self.line_end_id = int.from_bytes(self.line_end[:4], "little")
        #: Ids that open a pre-token with a space, or end a pre-token.
        self.marks = np.zeros(self.tokenizer.get_vocab_size() + 1, dtype=bool)
        for piece, i in self.tokenizer.get_vocab().items():
            self.marks[i] = piece.startswith("Ġ") if self.mode == "bytes" else piece.endswith("</w>")

    def whole(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for i in range(0, len(texts), LIBRARY_BATCH):
            out += [pack_ids(e.ids) for e in self.tokenizer.encode_batch_fast(texts[i : i + LIBRARY_BATCH], add_special_tokens=False)]
        return out

    def _cut(self, text: str) -> list[str]:
        """Pieces; in mode ``bytes`` all but the first stand for a space and themselves."""
        if self.mode == "words":
            return text.replace("\n", " ").split(" ")
        if self.mode == "bytes":
            return _OPENING.split(text) if "  " in text or " \n" in text or text.endswith(" ") else text.split(" ")
        return [text]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text; about ENCODE_CHARS of text are in work at once, but for a longer single text."""
        return [ids for a, b in in_parts(map(len, texts), ENCODE_CHARS) for ids in self._encode(texts[a:b])]

    def _encode(self, texts: list[str]) -> list[bytes]:
        if self.mode == "whole":
            return self.whole(texts)
        if len(self.cache) > CACHE_PIECES:
            self.cache = dict(islice(self.cache.items(), CACHE_CORE))
        cache = self.cache
        cut = [self._cut(t) for t in texts]
        first = None
        if self.mode == "bytes":
            first = self._first([c[0] for c in cut])
            for c in cut:
                del c[0]
        seen: set[str] = set()
        for c in cut:
            seen.update(c)
        missing = list(seen.difference(cache))
        cache.update(zip(missing, self._pieces(missing)))
        get = cache.__getitem__
        out: list[bytes] = []
        for i, c in enumerate(cut):
            ids = list(map(get, c))
            if first is None:
                out.append(b"".join(ids))
            else:
                out.append(self.whole([texts[i]])[0] if _UNCUT in ids else first[i] + b"".join(ids))  # rare white space after a space
        for p in missing:
            if len(p) > PIECE_CHARS:
                del cache[p]
        return out

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces; _UNCUT for those that can't be cut off in mode ``bytes``.

        A word with signs after it, and a line end with another such word, are pre-tokens of
        their own: their ids are put together from those of the parts, most of which are known.
        """
        out: dict[str, bytes] = {}
        parts: list[tuple[str, str, str, str | None, str | None]] = []
        whole: list[str] = []
        spaced: list[str] = []
        in_words = self.mode == "words"
        for p in pieces:
            if not in_words and (not p or p[0].isspace()):
                out[p] = _UNCUT
            elif not p:
                out[p] = b""
            elif m := _SIMPLE.fullmatch(p):
                word, signs, second, more = m.groups()
                parts.append((p, word.lower() if in_words else word, signs, second, more))
            elif " " in p and not in_words:
                spaced.append(p)
            else:
                whole.append(p)
        cache, bare = self.cache, self.bare
        if len(bare) > CACHE_CORE // 4:
            bare.clear()
        words = {x[1] for x in parts}.difference(cache)
        signs = {y for x in parts for y in x[2:] if y}.difference(bare)
        kept = dict(zip(words, self._words(list(words))))
        bare.update(zip(signs, self._joined(list(signs), led=False)))
        for p, word, after, second, more in parts:
            ids = kept[word] if word in kept else cache[word]
            if after:
                ids += bare[after]
            if second:
                ids += self.line_end + bare[second] + (bare[more] if more else b"")
            out[p] = ids
        cache.update((w, ids) for w, ids in kept.items() if len(w) <= PIECE_CHARS)
        out.update(zip(whole, self._joined(whole, led=True) if not in_words else self.whole(whole)))
        out.update(zip(spaced, self.whole([" " + p for p in spaced])))
        return [out[p] for p in pieces]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters alone (in mode ``bytes`` with a space before them): a pre-token each, so the vocabulary's model is all it takes."""
        out: list[bytes] = []
        lead = "Ġ" if self.mode == "bytes" else " "
        for i in range(0, len(words), LIBRARY_BATCH):
            part = words[i : i + LIBRARY_BATCH]
            text = lead.join(["", *(w if w.isascii() else w.encode().decode("latin-1").translate(_BYTES) for w in part)])
            ids = np.array(self.model_alone.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
            at = np.flatnonzero(self.marks[ids])
            begins = at if self.mode == "bytes" else np.append(0, at[:-1] + 1)
            if len(begins) == len(part):
                packed, ends = ids.tobytes(), [*(begins[1:] * 4).tolist(), len(ids) * 4]
                out += [packed[a:b] for a, b in zip((begins * 4).tolist(), ends)]
            else:
                out += self._joined(part, led=True)
        return out

    def _joined(self, pieces: list[str], led: bool) -> list[bytes]:
        """Ids of pieces (in mode ``words`` of one pre-token each), encoded together.

        Mode ``words``: each ends with an id that ends a word.  Mode ``bytes``: each begins with
        one that begins with a space (``led``), or stands after a line end.
        """
        out: list[bytes] = []
        in_words = self.mode == "words"
        for i in range(0, len(pieces), LIBRARY_BATCH):
            part = pieces[i : i + LIBRARY_BATCH]
            text = " ".join(part) if in_words else "".join([" " + p for p in part]) if led else "\n" + "\n".join(part)
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
            if in_words:
                ends = np.flatnonzero(self.marks[ids]) + 1
                begins = np.append(0, ends[:-1])
            else:
                begins = np.flatnonzero(self.marks[ids] if led else ids == self.line_end_id)
                ends = np.append(begins[1:], len(ids))
                begins = begins if led else begins + 1
            if len(begins) == len(part):
                packed = ids.tobytes()
                out += [packed[4 * a : 4 * b] for a, b in zip(begins.tolist(), ends.tolist())]
            else:
                out += self.whole([" " + p for p in part] if led and not in_words else part)
        return out

    def pre_tokens(self, text: str) -> list | None:
        """Names of the text's pieces, to be given to ``spelled``; None if it has to be encoded whole."""
        if self.mode == "whole":
            return None
        cut: list = _OPENING.split(text) if self.mode == "bytes" and _SPACES.search(text) else self._cut(text)
        if self.mode == "bytes":
            cut[0] = (cut[0],)  # no space before it
        return cut

    def spelled(self, names: Iterable) -> list[str]:
        """The pieces themselves."""
        lead = " " if self.mode == "bytes" else ""
        return [lead + p if type(p) is str else p[0] for p in names]

    def count(self, pieces: list[str]) -> list[int]:
        """Number of ids of each piece (as ``spelled`` gives them), best in order: then few known pieces suffice."""
        if len(self.cache) > CACHE_CORE // 8:
            self.cache = {}
        if self.mode != "bytes":
            return [len(x) // 4 for x in self._pieces(pieces)]
        led = [p[:1] == " " and not p[1:2].isspace() and len(p) > 1 for p in pieces]
        inner = iter(self._pieces([p[1:] for p, x in zip(pieces, led) if x]))
        other = iter(self.whole([p for p, x in zip(pieces, led) if not x]))
        return [len(next(inner if x else other)) // 4 for x in led]

    def _first(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces at the start of texts, which have no space before them."""
        parts: dict[str, tuple[str, ...] | None] = {}
        for p in pieces:
            if p and p not in parts:
                m = _SIMPLE.fullmatch(p)
                parts[p] = m.groups() if m else None
        new = {x for g in parts.values() if g for x in g if x}.difference(self.bare)
        self.bare.update(zip(new, self._joined(list(new), led=False)))
        bare = self.bare
        out = {p: bare[g[0]] + (bare[g[1]] if g[1] else b"") + (self.line_end + bare[g[2]] + (bare[g[3]] if g[3] else b"") if g[2] else b"") for p, g in parts.items() if g}
        odd = [p for p, g in parts.items() if not g]
        out.update(zip(odd, self.whole(odd)))
        return [out.get(p, b"") for p in pieces]


def encoder(path: str) -> PieceEncoder:
    """The worker's encoder for a vocabulary file."""
    return worker_keeps(path, lambda: PieceEncoder(path))


def in_parts(sizes: Iterable[int], limit: int = WORK_CHARS) -> Iterator[tuple[int, int]]:
    """Bounds of runs of items with about ``limit`` each in all."""
    begin = end = total = 0
    for size in sizes:
        total += size
        end += 1
        if total >= limit:
            yield begin, end
            begin, total = end, 0
    if begin < end:
        yield begin, end


def text_parts(texts: pa.Array, limit: int = WORK_CHARS) -> Iterator[tuple[int, int, list[str]]]:
    """A batch's texts, decoded a bounded part at a time: bounds and texts."""
    for a, b in in_parts(pc.binary_length(texts).to_pylist(), limit):
        yield a, b, texts.slice(a, b - a).to_pylist()
