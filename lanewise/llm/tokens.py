"""Token ids by the tokenizers library with a bounded memory of words, and shards of ids as wavelet matrices."""

from __future__ import annotations

import re

#: White space in Unicode's sense, as the byte-level pre-tokenizer takes it.
_SPACE = r"\t-\r\x20\x85\xa0  -     　"
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Stretches at whose bounds the pre-tokenizer always cuts: a whole run of Latin letters, or a run of
#: other characters, each with the space before it, or white space (without the one space that goes
#: with what follows). The run of letters counts only where no further letter can follow.
_STRETCH = re.compile(rf" ?[{_LETTER}]++(?![^\x00-\x7f])| ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_ONE_PIECE = re.compile(rf" ?[{_LETTER}]+").fullmatch


def _byte_letters() -> dict[int, str]:
    """The visible characters by which byte-level vocabularies write bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_AS_LETTERS = _byte_letters()
_SPACE_LETTER = _AS_LETTERS[32]
#: Stretches of a generation of the memory, some 40 MB, and the longest that is kept, in characters.
MEMORY, LONGEST = 250_000, 64


class _Memory(dict):
    """stretch -> ids; one that is missing is taken from the generation before or encoded, and kept unless it is long."""

    def __init__(self, encode, old: dict[str, bytes]):
        super().__init__()
        self.encode, self.old = encode, old

    def __missing__(self, s: str) -> bytes:
        ids = self.old.get(s)
        if ids is None:
            ids = self.encode(s)
        if len(s) <= LONGEST:
            self[s] = ids
        return ids


class ByteLevelIds:
    """text -> ids as little-endian unsigned 32-bit integers, equal to encode(text, add_special_tokens=False).

    Tokenization never looks across the bounds of a stretch, so each stretch is
    encoded once by the library's own pre-tokenizer and model and remembered;
    two generations of at most MEMORY stretches bound the memory. Strings of
    special tokens are found in the text first, as the library does.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        self.split, self.model = whole.pre_tokenizer.pre_tokenize_str, whole.model
        self.four = [int(i).to_bytes(4, "little") for i in range(whole.get_vocab_size())]
        special = {t.content: i for i, t in whole.get_added_tokens_decoder().items()}
        self.special = {k: self.four[v] for k, v in special.items()}
        self.special_at = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.young = _Memory(self._stretch, {})

    def _stretch(self, s: str) -> bytes:
        four, tokenize = self.four, self.model.tokenize
        if _ONE_PIECE(s):
            if s.isascii():
                return b"".join([four[t.id] for t in tokenize(_SPACE_LETTER + s[1:] if s[0] == " " else s)])
            return b"".join([four[t.id] for t in tokenize(s.encode().decode("latin-1").translate(_AS_LETTERS))])
        return b"".join([four[t.id] for piece, _ in self.split(s) for t in tokenize(piece)])

    def _plain(self, text: str) -> bytes:
        out = b"".join(map(self.young.__getitem__, _STRETCH.findall(text)))
        if len(self.young) > MEMORY:
            self.young.old = {}
            self.young = _Memory(self._stretch, self.young)
        return out

    def __call__(self, text: str) -> bytes:
        if self.special_at is None or not any(s in text for s in self.special):
            return self._plain(text)
        return b"".join(self.special[p] if p in self.special else self._plain(p) for p in self.special_at.split(text))


_made: dict[str, ByteLevelIds] = {}


def encoder(path: str) -> ByteLevelIds:
    """One encoder for each Python worker and file, kept between batches and tasks."""
    if path not in _made:
        _made[path] = ByteLevelIds(path)
    return _made[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
