"""What the byte-level token operators share: the vocabulary file and the cutting of texts into words.

The tokenizer cuts a text before it merges: words with one space before them, runs of other signs, blanks. Any
such cut that lies at a single space or line feed before a non-blank can be made first without
changing the tokens, so a text is cut into words with plain string functions and every distinct
word is worked out once per worker. Only texts with other blanks take the tokenizer's own
pattern, and only those with signs newer than this Python's Unicode tables its own cutter.
"""

from __future__ import annotations

import codecs
import functools
import json
import re

import regex
from tokenizers import pre_tokenizers

#: The pattern by which the tokenizer cuts texts.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_PATTERN = regex.compile(WORD_PATTERN)
#: Texts of these signs only are cut alike by every Unicode version in use: a bound below the first sign added lately.
_SETTLED = re.compile("[^\x00-՗‐-‧‰-⁞₠-₿、-龥가-힣]")

MEMORY = 600_000  # words remembered per worker in each of two generations


@functools.cache
def byte_signs() -> list[str]:
    """The printable sign that the vocabulary uses for each byte: itself if visible in Latin-1, else the next free one from U+0100."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    signs = {b: chr(b) for b in visible} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}
    return [signs[b] for b in range(256)]


@functools.cache
def _all_signs() -> str:
    return "".join(byte_signs())


def in_signs(word: str) -> str:
    if word.isascii() and word.isprintable():
        return word.replace(" ", byte_signs()[32])
    return codecs.charmap_decode(word.encode(), "strict", _all_signs())[0]


class Remembered(dict):
    """``fn`` of words, remembered in two generations so that memory stays bounded and frequent words stay."""

    def __init__(self, fn, size: int = MEMORY):
        super().__init__()
        self.fn, self.size, self.old = fn, size, {}

    def __missing__(self, word):
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        value = self.old.get(word)
        if value is None:
            value = self.fn(word)
        self[word] = value
        return value

    def known(self, word) -> bool:
        """Whether ``word`` is remembered; one of the older generation is taken over."""
        if word in self.old:
            self[word]
        return word in self

    def put(self, words, values) -> None:
        """Remember what is known of ``words``; all of them stay at least until the next call, however many they are."""
        if len(self) + len(words) > self.size:
            self.old = dict(self)
            self.clear()
        self.update(zip(words, values))


def specials(spec: str) -> list[str]:
    """Strings that the tokenizer takes out of a text before anything else."""
    return [t["content"] for t in json.loads(spec).get("added_tokens", [])]


_CUTTER = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)


def exact_words(text: str) -> list[str]:
    """The words by the pattern; by the tokenizer's own cutter if the text has signs on which Unicode versions differ."""
    if _SETTLED.search(text):
        return [text[a:b] for _, (a, b) in _CUTTER.pre_tokenize_str(text)]
    return _PATTERN.findall(text)


def spaced_words(word: str) -> list[str]:
    """The words by the pattern of one space and ``word``, which has no blanks."""
    if word.isalpha():  # letters alone are one word
        return [" " + word]
    if word[:-1].isalpha() and word[-1] in ".,":
        return [" " + word[:-1], word[-1]]
    return exact_words(" " + word)


def lines_of_words(text: str) -> list[list[str]] | None:
    """Words of every line if all blanks of the text are single spaces and line feeds between words, else None."""
    words = text.split()
    flat = text.replace("\n", " ")
    if not words or " ".join(words) != flat:
        return None
    return [line.split(" ") for line in text.split("\n")]
