"""Words of a text, folded: no case, accents, punctuation, markup or invisible characters."""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import chain

from reelspan.llm.transducer import fold

#: Markup: tags, and the time codes of transcripts.
TAG = re.compile(r"</?[A-Za-z][^<>]{0,300}>")
TIME_CODE = re.compile(r"\[\d{1,2}(?::\d\d){1,2}\]")

#: A word with the marks and invisible characters that may stand in it. An underscore is no letter.
WORD = re.compile("[\\w\u0300-\u036f\u00ad\u200b-\u200f\u2060-\u2064\ufe0e\ufe0f\ufeff]+")


def split_words(text: str) -> tuple[str, ...]:
    """The folded words of a text, by the rules themselves."""
    if "[" in text:
        text = TIME_CODE.sub(" ", text)
    if "_" in text:
        text = text.replace("_", " ")
    return tuple(w for w in map(fold, WORD.findall(text)) if w)


class Tokens(dict):
    """What stands between two spaces, to its folded words; computed once each.

    ``code`` turns each word into what the caller needs. Forgets all when it
    grows large.
    """

    LIMIT = 300_000

    def __init__(self, code: Callable[[str], object] | None = None) -> None:
        super().__init__()
        self.code = code

    def __missing__(self, raw: str) -> tuple:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[raw] = self.coded(raw)
        return value

    def coded(self, raw: str) -> tuple:
        found = split_words(raw)
        return found if self.code is None else tuple(map(self.code, found))

    def of(self, text: str | None) -> list:
        """The words of a text in order; none for null."""
        if not text:
            return []
        if "<" in text:
            text = TAG.sub(" ", text)
        return list(chain.from_iterable(map(self.__getitem__, text.split())))
