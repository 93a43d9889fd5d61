"""Whole texts to ids of a public tokenizer, piece by piece.

A tokenizer that first cuts a text at white space gives each such chunk the same ids wherever it stands, so a worker
keeps the ids of the chunks it has met.  many() takes a batch of texts: Arrow cuts them at single spaces and finds their
different words, and the model is asked for many new words at once, kept apart by letters of bytes that no text holds.  Texts that could hold one of the tokenizer's special strings, and tokenizers
that don't cut at white space, are encoded as a whole.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space as Unicode defines it (fixed values).
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
#: A word with the space before it, or white space up to the last before a word.
CHUNK = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
CLOSERS = frozenset(".,;:!?|*%&$#")

#: Where each kind of tokenizer cuts a chunk of ASCII characters without apostrophes (fixed values).
PARTS = {"spaced": re.compile(r" ?[A-Za-z]+| ?[0-9]+| ?[^ A-Za-z0-9]+"), "words": re.compile(r"[a-z]+|[0-9]|[^a-z0-9]+")}


def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it prints, else the next from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(256, 512))
    return {b: b if b in shown else next(hidden) for b in range(256)}


def _mixed(token: str) -> bool:
    """Whether an ASCII token has more than one of letters, digits and other signs, or a space or line feed that isn't first."""
    core = token[1:] if token[0] in "ĠĊ" else token
    kinds = {1 if c.isalpha() else 2 if c.isdigit() else 3 for c in core if c.isascii()}
    spaced = any(c in "ĠĊ" for c in token[1:]) or token[0] == "Ċ"
    return "'" not in token and (len(kinds) > 1 or spaced and bool(kinds))


#: The mark of the first word of a text, where a space stands before each line feed.
FIRST = "\n\n"

#: Text that is cut at once.
MOST_BYTES = 16_000_000


class Encoder:
    """ids(text) -> the ids as little-endian unsigned 32-bit integers; many(texts) -> those of each text as an array."""

    def __init__(self, path: str, entries: int = 200_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole, self.entries, self.letters = Tokenizer.from_file(path), entries, _byte_letters()
        model = self.whole.model
        if hasattr(model, "_resize_cache"):
            model._resize_cache(0)  # what is asked for here is new to it, so a cache of its own only costs
        self.pieces = model.tokenize
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.marks = [t["content"] for t in spec.get("added_tokens", [])]
        normal, pre = spec.get("normalizer"), spec.get("pre_tokenizer") or {}
        steps = [x.get("type") for x in (normal or {}).get("normalizers", [])]
        if normal is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            self.kind = "spaced"
        elif steps == ["NFC", "Replace", "Lowercase"] and pre.get("type") == "Sequence":
            self.kind = "words"
        else:
            self.kind = "whole"
        encoder = self

        class Known(dict):
            def __missing__(self, chunk):
                if len(self) >= encoder.entries:
                    self.clear()
                self[chunk] = out = encoder._chunk(chunk)
                return out

        self.known = Known()
        vocabulary = self.whole.get_vocab(with_added_tokens=False)
        longer = [t for t in vocabulary if len(t) > 1]
        inside = set("".join(longer))
        free = [b for b in range(0xF8, 0x100) if chr(b) in vocabulary and chr(b) not in inside]
        #: Letters that end a piece and a word; with them and without mixed tokens many words can go through the model at once.
        self.ends = free[:2] if self.kind == "spaced" and len(free) > 1 and not any(map(_mixed, longer)) else []
        self.end_ids = [vocabulary[chr(b)] for b in self.ends]

        class Words(dict):
            """What stands between two spaces -> ids; new words are noted, words not met for long forgotten."""

            def __missing__(self, word):
                if (out := encoder.older.get(word)) is None:
                    encoder.new.append(word)
                else:
                    self[word] = out
                return out

        self.words, self.older, self.new, self.white = Words(), {}, [], frozenset(SPACE)

    def _encode(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _letters(self, text: str) -> bytes:
        """Of text that is one piece for the model."""
        if not text.isascii():
            text = text.encode().decode("latin-1").translate(self.letters)
        elif text[0] == " ":
            text = chr(self.letters[32]) + text[1:]
        return array("I", [t.id for t in self.pieces(text)]).tobytes()

    def _chunk(self, chunk) -> bytes:
        text = chunk if self.kind == "spaced" else chunk.decode()
        core = text[1:] if self.kind == "spaced" and text[0] == " " else text
        end = core[-1:] if core[-1:] in CLOSERS else ""
        body = core[: len(core) - len(end)]
        if len(chunk) <= 200 and core.isascii() and core.isprintable() and "'" not in core and core:
            # Letters, digits and other signs part; a byte-level tokenizer leaves the space with the first.
            found = PARTS[self.kind].findall(text if self.kind == "spaced" else text.lower())
            return b"".join(map(self._letters, found))
        if len(chunk) > 200 or not body.isalpha():
            return self._encode(text)
        if self.kind == "words":
            if not body.isascii() and (not unicodedata.is_normalized("NFC", body) or "Σ" in body):
                return self._encode(text)
            text = text.lower()
            if not text[: len(text) - len(end)].strip().isalpha():  # dotted I becomes i and a mark, where the tokenizer cuts
                return self._encode(chunk.decode())
        return self._letters(text[: len(text) - len(end)]) + (self._letters(end) if end else b"")

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.kind == "whole" or any(m in text for m in self.marks):
            return self._encode(text)
        chunks = CHUNK.findall(text) if self.kind == "spaced" else text.encode().split()
        return b"".join(map(self.known.__getitem__, chunks))


    def many(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; none is null."""
        if len(texts) > 1 and texts.nbytes > MOST_BYTES:
            return self.many(texts[: len(texts) // 2]) + self.many(texts[len(texts) // 2 :])
        if not self.ends:
            return [np.frombuffer(self.ids(t.as_py()), "<u4") for t in texts]
        lines = pc.replace_substring(texts, "\n", " \n")  # a line feed starts a word that no space stands before
        odd = pc.or_(pc.equal(pc.binary_length(texts), 0), pc.starts_with(lines, " "))
        for sign in ("  ", *self.marks):
            odd = pc.or_(odd, pc.match_substring(texts, sign))
        odd = odd.to_numpy(zero_copy_only=False).copy()
        kept = ~odd
        lines = pc.binary_join_element_wise(FIRST, lines.filter(pa.array(kept)), "")
        cut = pc.split_pattern(lines, " ")
        at, found = cut.offsets.to_numpy(), cut.flatten().dictionary_encode()
        self.new = []
        words = found.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = list(map(self.words.__getitem__, words))
        if self.new:
            made, bad = self._learn(self.new)
            self.words.update(made)
            learned = iter(self.new)
            ids = [made.get(next(learned), b"") if x is None else x for x in ids]
            if bad:
                among = np.isin(found.indices.to_numpy(), [i for i, w in enumerate(words) if w in bad])
                odd[np.flatnonzero(kept)[np.unique(np.searchsorted(at, np.flatnonzero(among), "right") - 1)]] = True
        flat = pa.array(ids, pa.binary()).take(found.indices)
        whole = np.frombuffer(b"" if not len(flat) else flat.buffers()[2], "<u4")
        to = np.frombuffer(flat.buffers()[1], np.int32)[flat.offset :] // 4 if len(flat) else np.zeros(1, np.int32)
        cuts = to[at].tolist()
        parts = iter(zip(cuts, cuts[1:]))
        out = []
        for i, is_cut in enumerate(kept.tolist()):
            start, end = next(parts) if is_cut else (0, 0)
            out.append(np.frombuffer(self.ids(texts[i].as_py()), "<u4") if odd[i] else whole[start:end])
        return out

    def _learn(self, new: list[str]) -> tuple[dict[str, bytes], set[str]]:
        """(the ids of new words, those with white space at an end, which words alone don't tell)."""
        if len(self.words) >= self.entries * 5 // 2:
            self.older = dict(self.words)
            self.words.clear()
        made, bad, plain, others, texts = {}, set(), [], [], []
        for word in new:
            # The model keeps letters, digits and other signs apart by itself.
            if len(word) <= 200 and (word.isalpha() or word and word.isascii() and word.isprintable() and "'" not in word):
                plain.append(word)
                continue
            first = word.startswith(FIRST)
            core = word[2:] if first else word[1:] if word[:1] == "\n" else word
            if core[-1:] in self.white or not first and core[:1] in self.white or word == "\n":
                bad.add(word)
                continue
            text = core if first else word if word[:1] == "\n" else " " + word
            body = core.rstrip("".join(CLOSERS))
            if len(core) > 200 or not (core.isascii() and core.isprintable() and "'" not in core or body.isalpha()):
                made[word] = self._encode(text)
                continue
            others.append(word)
            raw = text.encode()
            texts.append(raw if core.isascii() or body is core else raw[: len(body) - len(core)] + bytes(self.ends[:1]) + core[len(body) :].encode())
        end, piece_id, end_id = bytes(self.ends[1:]), *self.end_ids
        asked = [" " + "\n ".join(plain[i : i + 48]) for i in range(0, len(plain), 48)]
        asked = [x.encode().replace(b"\n", end) for x in asked] + [end.join(texts[i : i + 48]) for i in range(0, len(texts), 48)]
        ids: list[int] = []
        for raw in asked:
            ids += [t.id for t in self.pieces(raw.decode("latin-1").translate(self.letters))]
            ids.append(end_id)
        x = np.array(ids, "<u4")
        x = x[x != piece_id]
        ends = 4 * np.flatnonzero(x == end_id)
        flat, starts = x.tobytes(), np.concatenate([[0], ends[:-1] + 4]) if len(ends) else ends
        made.update(zip(plain + others, [flat[i:j] for i, j in zip(starts.tolist(), ends.tolist())]))
        return made, bad


_made: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process."""
    if path not in _made:
        _made[path] = Encoder(path)
    return _made[path]
