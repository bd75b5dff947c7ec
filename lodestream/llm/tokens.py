"""Whole-text encoding with a public tokenizer, one chunk at a time.

Both vocabularies encode each pre-token on its own, and a single space between
two characters that are not white space always begins a new pre-token. So a text
may be cut at such spaces, each distinct chunk encoded once, and the ids joined:
the result is the one of encoding the whole text. Texts with other white space
beside a space are cut by a regular expression at exactly those spaces.

The library takes the contents of added tokens (``<|endoftext|>``) out of a text
before anything else and encodes what lies between them by itself; so do we.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import regex

#: Distinct chunks kept by one worker, in two generations of half as many.
KEPT_CHUNKS = 600_000
#: Characters of a chunk or pre-token that is kept; longer ones are encoded each time, so that the caches are bounded in bytes too.
LONGEST_KEPT = 64
END_ID = 2
_SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: Below this character every text is its own NFC form, and all libraries agree which characters are letters.
_PLAIN = "ɐ"


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids, by a tokenizer's own model."""

    def __init__(self, path: str, kept: int = KEPT_CHUNKS):
        self.kept = kept
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path) as f:
            spec = json.load(f)
        if odd := [x["content"] for x in spec["added_tokens"] if x["normalized"] or x["lstrip"] or x["rstrip"] or x["single_word"]]:
            raise ValueError(f"added tokens with conditions: {odd}")
        self.added = {x["content"]: array("I", [x["id"]]).tobytes() for x in spec["added_tokens"]}
        self.at_added = re.compile("|".join(f"({re.escape(x)})" for x in sorted(self.added, key=len, reverse=True)))
        steps = spec["pre_tokenizer"].get("pretokenizers", [spec["pre_tokenizer"]])
        given = [x["pattern"]["Regex"] for x in steps if x["type"] == "Split"]
        self.find = regex.compile(given[0] if given else public_tokenizers.PATTERN).findall
        self.space = chr(256 + 32)
        self.lower = "Lowercase" in json.dumps(spec["normalizer"])
        # byte-level vocabularies write byte b as the character of rank b among the printable ones, then those from 256 on
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        self.bytes_as = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in set(shown))}
        self.young: dict[str, bytes | None] = {}
        self.old: dict[str, bytes | None] = {}
        self.parts: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        """Ids of one pre-token, by the model itself."""
        if len(self.parts) > self.kept // 2:
            self.parts.clear()
        shown = self.space + part[1:] if part[0] == " " else part
        if not (part.isascii() and shown.isalnum()):
            shown = part.encode().decode("latin-1").translate(self.bytes_as)
        ids = array("I", [x.id for x in self.model.tokenize(shown)]).tobytes()
        if len(part) <= LONGEST_KEPT:
            self.parts[part] = ids
        return ids

    def _learn(self, chunk: str) -> bytes | None:
        """Puts the ids of ``chunk``, after a space, in the cache; None if white space is at an edge or it is empty."""
        if len(self.young) > self.kept // 2:
            self.old, self.young = self.young, {}
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            ids = None
        elif chunk.isascii() or max(chunk) < _PLAIN:
            known = self.parts
            text = chunk.lower() if self.lower else chunk
            if text.isalpha():  # one pre-token; the pattern would give the same
                text = text if self.lower else " " + text
                ids = known.get(text) or self._part(text)
            elif text[-1] in ".," and text[:-1].isalpha():  # two
                word, mark = text[:-1] if self.lower else " " + text[:-1], text[-1]
                ids = (known.get(word) or self._part(word)) + (known.get(mark) or self._part(mark))
            else:
                ids = b"".join([known.get(x) or self._part(x) for x in self.find(" " + text)])
        else:
            ids = self._whole(" " + chunk)
        if len(chunk) <= LONGEST_KEPT:
            self.young[chunk] = ids
        return ids

    def _joined(self, chunks: list[str]) -> bytes | None:
        """Ids of ``chunks``, each after a space; None if one of them has white space at an edge."""
        ids = [*map(self.young.get, chunks)]
        if None in ids:
            old, k = self.old.get, -1
            try:
                while True:
                    k = ids.index(None, k + 1)
                    chunk = chunks[k]
                    if (x := self.young.get(chunk)) is None:
                        if (x := old(chunk)) is not None:
                            self.young[chunk] = x
                        elif (x := self._learn(chunk)) is None:
                            return None
                    ids[k] = x
            except ValueError:  # none left
                pass
        return b"".join(ids)

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _first(self, chunk: str) -> bytes:
        """Ids of a chunk that begins a text."""
        if not chunk.isascii():
            return self._whole(chunk)
        return b"".join([self.parts.get(x) or self._part(x) for x in self.find(chunk.lower() if self.lower else chunk)])

    def forget(self) -> None:
        """Drops the chunks: a worker outlives its task, and pre-tokens are enough to learn them again."""
        self.young, self.old = {}, {}

    def encode(self, text: str) -> bytes:
        if not any(x in text for x in self.added):
            return self._plain(text)
        return b"".join([self.added.get(x) or self._plain(x) for x in self.at_added.split(text) if x])

    def _plain(self, text: str) -> bytes:
        """Ids of a text without added tokens."""
        first, space, rest = text.partition(" ")
        if not space:
            return self._first(text)
        if not first or first[-1].isspace() or (ids := self._joined(rest.split(" "))) is None:
            first, *chunks = _SINGLE_SPACE.split(text)
            parts = [self._whole(first)]
            for chunk in chunks:
                parts.append(self._whole(" " + chunk) if chunk[0].isspace() or chunk[-1].isspace() else self._joined([chunk]))
            return b"".join(parts)
        return self._first(first) + ids


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str, kept: int = KEPT_CHUNKS) -> Encoder:
    """The worker's own encoder for a vocabulary file; its cache lives as long as the worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path, kept)
    return _ENCODERS[path]


def public_path(name: str) -> str:
    """Where a public vocabulary lies on this machine; looked up in the task, so that each executor uses its own."""
    import public_tokenizers

    return public_tokenizers.path(name) if not os.path.isabs(name) else name
