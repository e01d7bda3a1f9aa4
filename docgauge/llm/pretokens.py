"""Pre-tokens of the byte-level BPE tokenizer, split as its library splits them."""

import re

#: Characters on which the patterns below and the library agree one by one (see
#: tests); texts with others are split by the library itself.
_ODD = re.compile("[^\t-\r -±´-¸º»¿-ɏ‐-‧‰-⁞]")
_FAST = re.compile(r" ?[^\W\d_]+|'(?:[sdmt]|ll|ve|re)| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: White space beside a space; elsewhere a pre-token never reaches over a single space.
_BLANK = "\t\n\x0b\x0c\r\x85\xa0 "
_WIDE = [*dict.fromkeys(x for c in _BLANK for x in (c + " ", " " + c))]
_loaded: dict = {}


def library(path: str):
    """The tokenizer of a vocabulary file, loaded once in each worker; unused truncation and padding are off."""
    if path not in _loaded:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _loaded[path] = tokenizer
    return _loaded[path]


class Splitter:
    """Splits texts into special tokens and pre-tokens."""

    def __init__(self, path: str):
        self.pre = library(path).pre_tokenizer
        self.special = {str(t.content): i for i, t in library(path).get_added_tokens_decoder().items()}
        self.uncut = [*_WIDE, *self.special]
        self.at = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def plain(self, text: str) -> list[str]:
        if _ODD.search(text) is None:
            return _FAST.findall(text)
        return [text[a:b] for _, (a, b) in self.pre.pre_tokenize_str(text)]

    def chunks(self, text: str) -> list[str] | None:
        """The text between single spaces, or None if it can't be split there.

        The pre-tokens of the text are those of the first chunk and of each later chunk
        with its space before it, so what is known of a chunk can be used again.
        """
        if not text or text[0] in _BLANK or text[-1] in _BLANK or any(x in text for x in self.uncut) or _ODD.search(text) is not None:
            return None
        return text.split(" ")

    def __call__(self, text: str) -> list[str]:
        """The pieces in order; a special token's string is a piece of its own."""
        if self.at is None or not any(s in text for s in self.special):
            return self.plain(text)
        out: list[str] = []
        for k, part in enumerate(self.at.split(text)):
            if k % 2:
                out.append(part)
            elif part:
                out += self.plain(part)
        return out
