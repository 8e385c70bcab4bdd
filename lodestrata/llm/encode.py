"""Exact, cached encoding with a public tokenizer file (never trained, never copied)."""

from __future__ import annotations

import os
import re

import numpy as np

# Classes of the code points below 256, as the files' own split patterns have them.
_L = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_N = "0-9\xb2\xb3\xb9\xbc-\xbe"
_S = " \t\n\r\x0b\x0c"
_ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
_SPLIT = {
    "word": re.compile(f"{_ENDINGS}|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+"),
    "byte": re.compile(f"{_ENDINGS}| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"),
}
#: Code points on whose class Python and the tokenizer's pattern engine may differ.
_UNSURE = re.compile("[\x1c-\x1f\x85\xa0]")
CACHE_ENTRIES = 250_000


class CachedEncoder:
    """Encodes whole texts; the ids equal those of the tokenizers library on the whole text.

    A text of code points below 256 is split by the file's own pattern here, and each distinct part goes to
    the file's merge model once; parts stay in a bounded cache of two generations. Any other text, and one that
    holds an added token's content in any case, goes to the library whole.
    """

    def __init__(self, path: str, kind: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.merge, self.split, self.lower = self.tokenizer.model.tokenize, _SPLIT[kind].findall, kind == "word"
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {i: "".join(x for x, _ in level.pre_tokenize_str(chr(i))) for i in range(256)}
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def parts(self, text: str) -> list[str] | None:
        """The text's parts; None: it goes to the library whole."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return None
        low = text.lower()
        if _UNSURE.search(text) or any(a in low for a in self.added):
            return None
        return self.split(low if self.lower else text)

    def _fill(self, wanted: set[str]) -> None:
        if len(self.cache) + len(wanted) > CACHE_ENTRIES:
            self.older, self.cache = self.cache, {}
        cache, older, merge, letters = self.cache, self.older, self.merge, self.letters
        for p in wanted:
            if p not in cache:
                cache[p] = older.get(p) or b"".join([t.id.to_bytes(4, "little") for t in merge(p.translate(letters))])

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; null is empty."""
        texts = ["" if t is None else t for t in texts]
        split = [self.parts(t) for t in texts]
        self._fill(set().union(*(s for s in split if s)))
        get = self.cache.__getitem__
        return [self.whole(t) if s is None else b"".join(map(get, s)) for t, s in zip(texts, split, strict=True)]
