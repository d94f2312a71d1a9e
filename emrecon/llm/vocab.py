"""Encoders for the public vocabularies, with the ids that the tokenizers library gives.

``byte_bpe`` is the byte-level vocabulary over the rank file of the same ids, which the
second library reads several times faster. ``word_bpe`` cuts a text at white space, which
no token of that vocabulary crosses, and keeps the ids of the words seen last."""

from __future__ import annotations

import base64
import json
import re
from functools import lru_cache

import numpy as np
import public_tokenizers
import regex
import tiktoken
from tokenizers import Tokenizer

from emrecon.llm.common import held

#: The code points with Unicode's White_Space property, as a pattern's class.
SPACE = "\\u0009-\\u000d\\u0020\\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
WORDS = re.compile(f"[^{SPACE}]+")
#: Fixed value: the split pattern of the word vocabulary.
WORD_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Stands for the end of a word; a text that holds it takes the library's own way.
END = "\x1f"
#: Words that a worker keeps at most; then it starts anew.
CACHE = 200_000


def fresh(path: str) -> Tokenizer:
    found = Tokenizer.from_file(path)
    found.no_padding()
    found.no_truncation()
    return found


load = lru_cache(maxsize=4)(fresh)


@lru_cache(maxsize=4)
def byte_ranks(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def byte_alphabet() -> dict[str, int]:
    """The byte for which each character stands in the vocabularies' strings: printable
    bytes stand for themselves, the others, in order, for the code points from 256."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*plain}))}


class WordEncoder:
    """Called with a text, gives its ids as little-endian unsigned 32-bit bytes.

    The merges run in the second library, an end-of-word byte standing for the suffix: as
    the pair with it ranks first, the last byte takes it up before any other merge. All
    words of a text that are new go there at once, a line each."""

    def __init__(self, path: str):
        self.known: dict[str, bytes] = {}
        self.tokenizer = fresh(path)  # goes with this encoder
        with open(path) as f:
            spec = json.load(f)["model"]
        suffix, vocab, back = spec["end_of_word_suffix"], spec["vocab"], byte_alphabet()

        def raw(token: str) -> bytes:
            word = token.endswith(suffix)
            return bytes(back[c] for c in (token[: -len(suffix)] if word else token)) + END.encode() * word

        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["merges"]]
        order = [*back, *(c + suffix for c in back), *(a + b for a, b in pairs)]
        ranks: dict[bytes, int] = {}
        for i, token in enumerate(order):
            ranks.setdefault(raw(token), i)
        self.ids = np.array([vocab[t] for t in order], "<u4")
        self.line = ranks[b"\n"]
        self.merges = tiktoken.Encoding(path, pat_str=f"[^{END}\n]+{END}|\n", mergeable_ranks=ranks, special_tokens={})

    def learn(self, words: set[str]) -> None:
        # below U+0250 a word is its own NFC form and is lower-cased letter by letter
        odd = [w for w in words if max(w) >= "ɐ" or "İ" in w or END in w or "<|" in w]
        if odd:
            for w, e in zip(odd, self.tokenizer.encode_batch(odd, add_special_tokens=False), strict=True):
                self.known[w] = np.array(e.ids, "<u4").tobytes()
        plain = [*words.difference(odd)]
        ranks = self.merges.encode_to_numpy(WORD_SPLIT.sub(rf"\g<0>{END}", "\n".join([*plain, ""]).lower()), disallowed_special=())
        raw, ends = self.ids[ranks].tobytes(), (np.flatnonzero(ranks == self.line) * 4).tolist()
        start = 0
        for w, end in zip(plain, ends, strict=True):
            self.known[w] = raw[start:end]
            start = end + 4

    def __call__(self, text: str) -> bytes:
        # split() also cuts at four control characters, which are no white space here
        words = WORDS.findall(text) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()
        if new := set(words).difference(self.known):
            if len(self.known) + len(new) > CACHE:
                self.known.clear()
                new = set(words)
            self.learn(new)
        return b"".join(map(self.known.__getitem__, words))


def word_bpe(path: str) -> WordEncoder:
    return held(("words", path), lambda: WordEncoder(path))
