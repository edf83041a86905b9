"""Tokens of a tokenizer's file, remembered for each stretch between white space where that is right.

One kind of tokenizer drops white space and lower-cases, and nothing it merges crosses white space, so a text's ids are those
of its stretches, one after the other. Stretches recur, and a worker asks the library only for those it doesn't remember. Whether a
file is of this kind is read from it (`drops_blanks`); any other, and any SentencePiece model, gets whole texts.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
from collections.abc import Callable
from functools import cache
from pathlib import Path

#: Stretches that a worker remembers (some 200 bytes each); beyond that it starts anew.
REMEMBERED = 450_000
#: Signs that end a stretch after a letter or digit and start a token there; an apostrophe, or a part of a special token, may not.
_TAIL = b".,;:!?#$%&*()[]{}+-/=@^_`~\"\\"


class Stretches(dict):
    """Ids of each stretch (UTF-8, no ASCII white space) as packed 32-bit integers, or what `of` makes of them."""

    def __init__(self, path: str, of: Callable[[list[int]], object], add: Callable[[object, object], object]) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library, self.of, self.add = Tokenizer.from_file(path), of, add
        self.model = self.library.model

    def __missing__(self, stretch: bytes):
        body = stretch.rstrip(_TAIL)
        if body and len(body) < len(stretch) and _letter_or_digit(body):
            got = self.add(self[body], self[stretch[len(body) :]])
        elif b"<|" not in stretch and (low := stretch.lower()) != stretch:
            got = self[low]
        elif (word := _plain_word(stretch)) is not None:
            got = self.of([token.id for token in self.model.tokenize(word)])
        else:
            got = self.of(self.library.encode(stretch.decode(), add_special_tokens=False).ids)
        self[stretch] = got
        return got

    def tidy(self) -> None:
        if len(self) > REMEMBERED:
            self.clear()


def _byte_letters() -> dict[int, str]:
    """The characters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, the others from 256 on in order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {i: chr(i) if i in printable else chr(next(others)) for i in range(256)}


_LETTERS = _byte_letters()


def _plain_word(stretch: bytes) -> str | None:
    """The stretch as the tokenizer's model takes it, if it is letters up to U+017F alone: one piece, composed already, lower-cased letter by letter."""
    if stretch.isalpha():
        return stretch.decode().lower()
    text = stretch.decode()
    if text.isalpha() and max(text) <= "\u017f" and "\u0130" not in text:
        return text.lower().encode().decode("latin-1").translate(_LETTERS)
    return None


def _letter_or_digit(body: bytes) -> bool:
    """Whether the last character is an ASCII letter or digit, or a Latin letter of two bytes; punctuation after it starts a token.

    Not so the dotted capital I, whose lower case ends in a mark that goes with punctuation.
    """
    if body[-1] < 128:
        return body[-1:].isalnum()
    return len(body) > 1 and 0xC3 <= body[-2] <= 0xC5 and body[-2:] not in (b"\xc3\x97", b"\xc3\xb7", b"\xc4\xb0")


# How a file says that it composes characters, folds white space, lower-cases and keeps nothing else between pieces.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_PIECES = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


@cache
def drops_blanks(path: str) -> bool:
    """Whether the file is of a tokenizer whose ids of a text are those of its stretches between ASCII white space."""
    if not path.endswith(".json"):
        return False
    told = json.loads(Path(path).read_text(encoding="utf-8"))
    normal, pieces, model = told.get("normalizer") or {}, told.get("pre_tokenizer") or {}, told.get("model") or {}
    steps = pieces.get("pretokenizers") or [{}, {}]
    split, last = steps[0], steps[-1]
    folds = normal.get("type") == "Sequence" and normal.get("normalizers") == _NORMALIZERS
    cuts = pieces.get("type") == "Sequence" and len(steps) == 2 and (split.get("type"), split.get("pattern"), split.get("behavior"), split.get("invert")) == ("Split", {"Regex": _PIECES}, "Removed", True)
    plain = last.get("type") == "ByteLevel" and not last.get("add_prefix_space") and not last.get("use_regex") and model.get("type") == "BPE" and not model.get("dropout")
    added = all(x.get("special") and x["content"].startswith("<|") and not x.get("lstrip") and not x.get("rstrip") and not x.get("normalized") for x in told.get("added_tokens", []))
    return folds and cuts and plain and added and not told.get("truncation") and not told.get("padding")


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


@cache
def _library(path: str) -> Callable[[str], list[int]]:
    """The ids that the file's library gives for a whole text, without special tokens around it, cut or filled up."""
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path).encode
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    return lambda text: library.encode(text, add_special_tokens=False).ids


@cache
def packed_ids(path: str) -> Callable[[bytes | None], bytes]:
    """A text's ids, packed as 32-bit integers; null has none."""
    if not drops_blanks(path):
        whole = _library(path)
        return lambda text: _packed(whole(text.decode())) if text else b""
    known = Stretches(path, _packed, bytes.__add__)

    def ids(text: bytes | None) -> bytes:
        known.tidy()
        return b"".join(map(known.__getitem__, text.split())) if text else b""

    return ids


@cache
def counts(path: str) -> Callable[[bytes | None], int]:
    """How many ids a text has; null has none."""
    if not drops_blanks(path):
        whole = _library(path)
        return lambda text: len(whole(text.decode())) if text else 0
    known = Stretches(path, len, int.__add__)

    def count(text: bytes | None) -> int:
        known.tidy()
        return sum(map(known.__getitem__, text.split())) if text else 0

    return count


def version(path: str) -> str:
    """Names the tokenizer by its file and library, so that stored counts of another one are never taken."""
    if path.endswith(".model"):
        import sentencepiece as library
    else:
        import tokenizers as library
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()[:32] + "-" + library.__version__
