"""Exact token ids of whole texts from a ``tokenizers`` file, with a bounded cache of words.

The ids are those of ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)``: a special
token's string inside a text is that token, as the file says.

Two layouts of files are known.  Both split a text before merging: at a single white character with
others on both sides, and between a letter or digit and a full stop or comma before white space.  So a
text may be encoded piece by piece between these places and the ids joined.  A vocabulary that keeps
white space takes a space together with the word behind it; other pieces are marked with ``JOIN``.
Texts with runs of white space there, texts that hold a special token's string, and all texts of a
file with another layout are encoded whole.  A new word of Latin letters alone is one piece for both
layouts, so the library's model takes it directly; others go through the whole tokenizer.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

from marlstone.llm.shared import worker_cache

JOIN = "\x00"
_WHOLE = re.compile(r"\s\s|\x00")
_STOP = re.compile(r"(?<=[^\W_])([.,])(?=\s|$)")
_AFTER_OTHER = re.compile(r" \x00(?<=[\W_] \x00)")

#: Letters that NFC leaves alone and whose lower case is one letter.
_LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e]+")

# The settings of the two layouts whose places to split are known, as in the files.
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
_WORD_CLEANING = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_WORD_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}


def _byte_signs() -> dict[int, str]:
    """How byte-level files write bytes: those that print stand for themselves, others for 256 and up."""
    print_ = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in print_]
    return {b: chr(256 + k) for k, b in enumerate(rest)}


_SIGNS = _byte_signs()


def layout(path: str) -> tuple[str | None, list[str]]:
    """``bytes``, ``words`` or None for a file whose places to split are not known; and the strings of
    its added tokens."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    added = told.get("added_tokens") or []
    strings = [t["content"] for t in added]
    if not added or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] or not t["special"] for t in added):
        return None, strings
    if told["model"]["type"] != "BPE" or told["model"].get("dropout") or told.get("truncation") or told.get("padding"):
        return None, strings
    if told["normalizer"] is None and told["pre_tokenizer"] == _BYTE_LEVEL:
        return "bytes", strings
    split = (told["pre_tokenizer"] or {}).get("pretokenizers") or [None]
    if told["normalizer"] == _WORD_CLEANING and split[0] == _WORD_SPLIT and split[1:] == [_BYTE_LEVEL | {"use_regex": False}]:
        return "words", strings
    return None, strings


def _has_runs(text: str) -> bool:
    """Whether ``_WHOLE`` is found.  Of white space, only the space is printable, so most texts need no search."""
    if text.replace("\n", "").isprintable() and not any(pair in text for pair in ("  ", "\n\n", " \n", "\n ")):
        return False
    return _WHOLE.search(text) is not None


def _part_stops(text: str) -> str:
    """Part full stops and commas from the letters and digits before them."""
    out = text.replace(". ", " \x00. ").replace(", ", " \x00, ").replace(".\n", " \x00.\n").replace(",\n", " \x00,\n")
    return _STOP.sub(" \x00\\1", text) if _AFTER_OTHER.search(out) else out


class WordEncoder:
    def __init__(self, path: str, max_words: int = 450_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.kind, self.strings = layout(path)
        self.tokenizer = Tokenizer.from_file(path)
        if self.kind:  # pieces are encoded with this token between them, which splits what surrounds it
            self.mark = self.strings[-1]
            self.mark_id = self.tokenizer.token_to_id(self.mark)
            self.model = self.tokenizer.model
        self.max_words = max_words
        self.words: dict[str, bytes] = {"": b""}
        self.passed = 0  # words encoded and not kept since the cache was filled

    def _alone(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _together(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without special strings: all in one call, with marks between."""
        if not texts:
            return []
        ids = np.array(self.tokenizer.encode_batch_fast([self.mark.join(texts) + self.mark], add_special_tokens=False)[0].ids, dtype="<u4")
        data, ends = ids.tobytes(), (4 * np.flatnonzero(ids == self.mark_id)).tolist()
        return [data[a:b] for a, b in zip([0, *[e + 4 for e in ends]], ends)]

    def _new(self, words: list[str]) -> None:
        """Enter the ids of words that the cache lacks."""
        lead, hard, known, tokenize = "", [], self.words, self.model.tokenize
        bytes_kind = self.kind == "bytes"
        for w in words:
            core = w[1:] if w[:1] == JOIN else w
            if not _LETTERS.fullmatch(core):
                hard.append(w)
                continue
            if bytes_kind:
                lead = "" if core is not w else _SIGNS[32]
            else:
                core = core.lower()
            if not core.isascii():
                core = core.encode().decode("latin-1").translate(_SIGNS)
            known[w] = array("I", [t.id for t in tokenize(lead + core)]).tobytes()
        joint = " " if bytes_kind else ""
        known.update(zip(hard, self._together([w.removeprefix(JOIN) if w[:1] == JOIN else joint + w for w in hard])))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        if not self.kind:
            return self._alone(texts)
        if self.passed > 4 * self.max_words:  # other texts than those that filled the cache
            self.words, self.passed = {"": b""}, 0
        bytes_kind, strings = self.kind == "bytes", self.strings
        words, whole, special, split = self.words, [], [], []
        for i, text in enumerate(texts):
            if any(x in text for x in strings):
                special.append(i)
                split.append([])
            elif _has_runs(text) if bytes_kind else JOIN in text:
                whole.append(i)
                split.append([])
            elif bytes_kind:  # a leading space keeps its word; a text's start has none
                text = _part_stops(text).replace("\n", " \x00\n \x00")
                split.append((text[1:] if text[:1] == " " else JOIN + text).split(" ") if text else [])
            else:
                split.append(_part_stops(text).replace("\n", " ").split(" "))
        fresh = list(set().union(*split).difference(words))
        self._new(fresh)
        if bytes_kind:
            words[""] = self._together([" "])[0]  # only a text's last space stands alone
        ids = [b"".join(map(words.__getitem__, pieces)) for pieces in split]
        for at, found in ((whole, self._together([texts[i] for i in whole])), (special, self._alone([texts[i] for i in special]))):
            for i, x in zip(at, found):
                ids[i] = x
        if len(words) > self.max_words:  # full: what is common is there, and rare words pass by
            self.passed += len(fresh)
            for w in fresh:
                del words[w]
        return ids


def encoder(path: str) -> WordEncoder:
    """One encoder for each vocabulary and worker process."""
    key = ("encoder", path)
    cache = worker_cache()
    if key not in cache:
        cache[key] = WordEncoder(path)
    return cache[key]


def encode_in_blocks(path: str, texts: list[str], chars: int = 1_000_000):
    """Yield (index, ids) of each text, encoding about ``chars`` characters at a time."""
    enc, block, size = encoder(path), [], 0
    start = 0
    for i, text in enumerate(texts):
        block.append(text)
        size += len(text)
        if size >= chars or i + 1 == len(texts):
            yield from zip(range(start, i + 1), enc.encode(block))
            block, size, start = [], 0, i + 1
