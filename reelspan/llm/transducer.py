"""Problem 6: one consistent form for text that looks the same.

Method: a transducer over grapheme clusters, compiled once. Its states stand for
what a cluster has become so far; its transitions are the characters of the
sources: a letter, then the accents, voicing marks and invisible characters that
follow it. A text is read once from left to right; at each place the transitions
are followed as long as there is one, which is the longest match, and the last
state's target is put out. ``e`` + circumflex + dot below is one source of three
characters, and so is a full-width ``e`` with the same marks, or a half-width
kana with its voicing mark.

Transitions are compiled for every letter and stack of accents that are one
character together, in every order of the accents; any other stack, or one on a
letter of another script, gets its transitions when it is first met. Targets are canonical:
accents are joined to the letter where there is one character for both, else
they stand in canonical order.

A state has two targets, one for Latin text and one for any other, which differ
for look-alike letters and what is built on them. Look-alikes count as Latin in
a word that also holds a Latin letter; in a word made wholly of look-alikes if
the text has Latin words and no word really written in that other script. So
such words are held back until the word, or the text, ends.

The compiler refuses a table in which one source has two targets or in which a
target could be mapped again, so the form is a fixed point.

Rows without any character that begins or joins a source are passed by in the
JVM; only the others reach Python.

Defined results: null stays null; an empty text stays empty; the order of rows,
repeated rows and other columns are untouched.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import defaultdict
from functools import lru_cache
from itertools import permutations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters that print nothing.
INVISIBLE = (
    "\u00ad\u061c\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180e\u200b\u200c\u200d\u200e\u200f"
    "\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069"
    "\u206a\u206b\u206c\u206d\u206e\u206f\u3164\ufe0e\ufe0f\ufeff\uffa0\ufff9\ufffa\ufffb"
)

# Spaces other than the ordinary one.
SPACES = (
    "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\u0085"
)

# Letters that have the shape of a Latin letter.
CYRILLIC = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O",
    "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V",
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x",
    "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ү": "y", "ӏ": "l", "Ӏ": "I",
    "к": "k", "м": "m", "н": "h", "т": "t", "в": "b",
}
GREEK = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ϲ": "c", "ϳ": "j",
    "β": "b", "ε": "e", "η": "n", "μ": "m", "ζ": "z",
}
OTHER = {
    "Ð": "Đ", "ð": "đ", "Ɖ": "Đ", "ı": "i", "ȷ": "j", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʋ": "v",
    "Օ": "O", "օ": "o", "Տ": "S", "ո": "n", "ս": "u", "հ": "h", "Լ": "L",
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭼ": "E", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮇ": "M", "Ꮲ": "P", "Ꭲ": "T",
}

_MARKS = "\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\u3099\u309a\ufe20-\ufe2f"
_MARK = re.compile(f"[{_MARKS}]")


def _widths() -> dict[str, str]:
    """Full-width and half-width forms, from the character database."""
    found = {}
    for code in range(0xFF01, 0xFFEF):
        char = chr(code)
        if char in INVISIBLE:
            continue
        kind, _, rest = unicodedata.decomposition(char).partition(" ")
        if kind in ("<wide>", "<narrow>"):
            found[char] = "".join(chr(int(x, 16)) for x in rest.split())
    return found


def _styled() -> dict[str, str]:
    """Mathematical letters (bold, script, double-struck, ...) as plain Latin letters and digits."""
    found = {}
    for code in range(0x1D400, 0x1D800):
        plain = unicodedata.normalize("NFKD", chr(code))
        if len(plain) == 1 and plain.isascii() and plain.isalnum():
            found[chr(code)] = plain
    return found


def _singles() -> dict[str, str]:
    """Latin letters that have a second number of their own, as the signs of kelvin and angstrom."""
    found = {chr(code): unicodedata.normalize("NFC", chr(code)) for code in range(0x2100, 0x2150)}
    return {c: plain for c, plain in found.items() if c != plain and _script(plain) == "LATIN"}


class MappingConflict(ValueError):
    """The mapping has two targets for one source, or maps a target again."""


def _compiled(tables: list[dict[str, str]]) -> dict[str, str]:
    made: dict[str, str] = {}
    for one in tables:
        for source, target in one.items():
            if made.get(source, target) != target:
                raise MappingConflict(f"two targets for {source!r}")
            made[source] = target
    # a target that is itself mapped is followed to its end, at compile time
    for source, target in list(made.items()):
        for _ in range(4):
            target = "".join(made.get(char, char) for char in target)
        made[source] = target
    return made


#: Characters that many texts hold and that never change: Latin letters and signs, punctuation, superscripts and fractions.
ORDINARY = "\u0020-\u007e\u00a1-\u024f\u1e00-\u1eff\u2010-\u2027\u2030-\u205e\u2070-\u209c\u20ab-\u20ac\u2116\u2122\u2150-\u2189"


#: What a character is to the word it stands in: of no word, of a word but no letter, a letter that looks like another.
BREAK, NEUTRAL, LOOK = "break", "neutral", "look"


class Transducer:
    """The compiled mapping: states, their transitions and their two targets."""

    #: Transitions made when first met are kept up to so many states.
    LIMIT = 200_000

    def __init__(self, lookalikes: dict[str, str] | None = None, invisible: str = INVISIBLE, spaces: str = SPACES) -> None:
        look = {**CYRILLIC, **GREEK, **OTHER} if lookalikes is None else dict(lookalikes)
        always = _compiled([dict.fromkeys(invisible, ""), dict.fromkeys(spaces, " "), _widths(), _styled(), _singles()])
        look = _compiled([look])
        if both := always.keys() & look.keys():
            raise MappingConflict(f"two entries for {sorted(both)}")
        for source, target in [*always.items(), *look.items()]:
            if any(char in always or char in look for char in target):
                raise MappingConflict(f"the target of {source!r} is mapped again")
        self.always, self.look, self.invisible = always, look, frozenset(invisible)
        #: targets of each state: in other text, in Latin text
        self.plain: list[str] = []
        self.latin: list[str] = []
        #: transitions of each state
        self.after: list[dict[str, int]] = []
        self.kinds: list[str] = []
        #: the state that a source begins with
        self.begin: dict[str, int] = {}
        self._number: dict[tuple[str, str, str], int] = {}
        for char, target in always.items():
            self.begin[char] = self._state(target, target, self._kind_of(target))
        for char, target in look.items():
            self.begin[char] = self._state(char, target, LOOK)
        # letters of another alphabet that are one character with their accent
        for code in [*range(0x370, 0x530), *range(0x1F00, 0x2000)]:
            apart = unicodedata.normalize("NFD", chr(code))
            if len(apart) > 1 and apart[0] in look:
                self.begin[chr(code)] = self._state(chr(code), unicodedata.normalize("NFC", look[apart[0]] + apart[1:]), LOOK)
        #: what can follow within a cluster, and the accent or nothing it stands for
        self.joins = {c: c for c in map(chr, _codes(_MARKS))} | dict.fromkeys(invisible, "")
        self.joins |= {c: t for c, t in always.items() if _MARK.fullmatch(t)}
        self._compile()
        self._fixed = len(self.plain)
        changing = [c for c, s in self.begin.items() if self.latin[s] != c] + list(self.joins)
        #: a class of the characters that a text must hold one of to be changed
        self._touched = re.compile("[" + _ranges(changing) + "]")
        #: the same for the JVM, of few ranges: they hold rare characters besides, but no ordinary ones
        self.touched = "[\\x{80}-\\x{10FFFF}&&[" + _ranges(changing, ORDINARY) + "]]"

    def _compile(self) -> None:
        """A transition for every letter and accent that are one character together; so accents that can be joined in turn are followed in turn."""
        joined = [chr(code) for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0x3040, 0x3100)] if len(unicodedata.normalize("NFD", chr(code))) > 1]
        pairs = defaultdict(set)
        for one in joined:
            letter, *accents = unicodedata.normalize("NFD", one)
            # accents of different places can come in any order
            for order in permutations(accents):
                at = letter
                for accent in order:
                    both = unicodedata.normalize("NFC", at + accent)
                    pairs[at].add(accent)
                    at = both
        for char in pairs:
            if len(char) == 1 and char not in self.begin:
                self._begun(char)
        for state in list(self.begin.values()):
            self._joined(state, pairs)

    def _joined(self, state: int, pairs: dict[str, set[str]]) -> None:
        """The transitions of a state by the accents of its Latin target, and on from there."""
        for char, accent in self.joins.items():
            if accent in pairs.get(self.latin[state], ()) and char not in self.after[state]:
                self._joined(self._step(state, char), pairs)

    def _state(self, plain: str, latin: str, kind: str) -> int:
        key = (plain, latin, kind)
        number = self._number.get(key)
        if number is None:
            number = self._number[key] = len(self.plain)
            self.plain.append(plain)
            self.latin.append(latin)
            self.kinds.append(kind)
            self.after.append({})
        return number

    def _begun(self, char: str) -> int:
        """The state of a character that maps to itself."""
        target = unicodedata.normalize("NFC", char)
        number = self.begin[char] = self._state(target, target, self._kind_of(target))
        return number

    def _step(self, state: int, char: str) -> int:
        """The state after one more character of the cluster; its transition is made if there is none yet."""
        found = self.after[state].get(char)
        if found is None:
            mark = self.joins[char]
            if not mark:
                found = state
            else:
                found = self._state(unicodedata.normalize("NFC", self.plain[state] + mark), unicodedata.normalize("NFC", self.latin[state] + mark), self.kinds[state])
            self.after[state][char] = found
        return found

    @staticmethod
    def _kind_of(target: str) -> str:
        """Of a target that is the same in every text: break, neutral, or the script of its letter."""
        char = target[:1]
        if not char or _MARK.match(char):
            return NEUTRAL
        return _word_kind(char)

    def __call__(self, text: str | None) -> str | None:
        """The consistent form."""
        if not text or text.isascii() or not self._touched.search(text):
            return text
        if len(self.plain) > self.LIMIT:
            self._forget()
        begin, after, joins, kinds = self.begin, self.after, self.joins, self.kinds
        out: list[str] = []
        held: list[list[tuple[int, str, str]]] = []  # words of look-alikes only
        own: set[str] = set()  # kinds of letters that words without a Latin one have
        word, looks, any_latin = set(), [], False  # kinds of the word so far, and its look-alikes: place, Latin target, script
        at, end = 0, len(text)
        while at <= end:
            kind = BREAK
            if at < end:
                char = text[at]
                state = begin.get(char)
                if state is None and (char in joins or (at + 1 < end and text[at + 1] in joins and not char.isspace())):
                    state = self._begun(char)
                if state is None:
                    out.append(char)
                    kind = _word_kind(char)
                else:
                    ways, ahead = after[state], at + 1
                    while ahead < end:
                        following = ways.get(text[ahead])
                        if following is None:
                            if text[ahead] not in joins or self.plain[state] == " ":
                                break
                            following = self._step(state, text[ahead])
                        state, ahead = following, ahead + 1
                        ways = after[state]
                    at = ahead - 1
                    kind = kinds[state]
                    if kind == LOOK:
                        looks.append((len(out), self.latin[state], _script(char)))
                    out.append(self.plain[state])
            at += 1
            word.add(kind)
            if kind != BREAK:
                continue
            if "LATIN" in word:
                any_latin = True
                for place, target, _ in looks:
                    out[place] = target
            else:
                own |= word
                if looks and word <= {LOOK, NEUTRAL, BREAK}:
                    held.append(looks)
            word, looks = set(), []
        for places in held if any_latin else ():
            if not any(script in own for _, _, script in places):
                for place, target, _ in places:
                    out[place] = target
        return "".join(out)

    def _forget(self) -> None:
        """Drop the states made since the compilation."""
        del self.plain[self._fixed :], self.latin[self._fixed :], self.kinds[self._fixed :], self.after[self._fixed :]
        self._number = {k: n for k, n in self._number.items() if n < self._fixed}
        self.begin = {c: n for c, n in self.begin.items() if n < self._fixed}
        self.after[:] = [{c: n for c, n in ways.items() if n < self._fixed} for ways in self.after]

    def needed(self, text: str | None) -> bool:
        """Whether the text is not in the consistent form."""
        return bool(text) and self(text) != text


def _codes(char_class: str) -> list[int]:
    """The numbers of a class of characters and ranges."""
    found = []
    for one in re.findall(r"(.)(?:-(.))?", char_class, re.DOTALL):
        found += range(ord(one[0]), ord(one[1] or one[0]) + 1)
    return found


def _ranges(chars: list[str], ordinary: str | None = None) -> str:
    """The characters as ranges of a class, in a form that both Python and the JVM read.

    With ``ordinary`` a range goes on over what lies between two characters
    unless one of these does.
    """
    codes = sorted(set(map(ord, chars)))
    apart = sorted(set(_codes(ordinary)) - set(codes)) if ordinary else []
    name = lambda c: f"\\u{c:04x}" if c < 0x10000 else chr(c)
    out, low = [], None
    for k, code in enumerate(codes):
        low = code if low is None else low
        follows = k + 1 < len(codes) and (codes[k + 1] == code + 1 if ordinary is None else bisect_right(apart, code) == bisect_right(apart, codes[k + 1]))
        if not follows:
            out.append(name(low) + (f"-{name(code)}" if code > low else ""))
            low = None
    return "".join(out)


@lru_cache(maxsize=70_000)
def _script(char: str) -> str:
    return unicodedata.name(char, "?").split(" ")[0]


@lru_cache(maxsize=70_000)
def _word_kind(char: str) -> str:
    if char == "_" or not char.isalnum():
        return BREAK
    return _script(char) if char.isalpha() else NEUTRAL


@lru_cache(maxsize=1)
def default_transducer() -> Transducer:
    return Transducer()


def fold(text: str | None) -> str:
    """Letters and digits only: the consistent form without case, accents, spaces and punctuation."""
    if not text:
        return ""
    text = default_transducer()(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
        text = _MARK.sub("", text).casefold().replace("đ", "d").replace("ð", "d")
    else:
        text = text.lower()
    return _NOT_WORD.sub("", text)


_NOT_WORD = re.compile(r"[\W_]+")


@F.pandas_udf(T.StringType())
def _changed_form(texts: pd.Series) -> pd.Series:
    """Arrow UDF over the compiled transducer."""
    change = default_transducer()
    return pd.Series([None if t is None else change(t) for t in texts], dtype=object)


def touched(column: Column) -> Column:
    """Whether a text holds a character that begins or joins a source; only such texts can change."""
    return column.rlike(default_transducer().touched)


def consistent(column: Column) -> Column:
    """The consistent form. Only texts that can change are sent to Python."""
    return F.coalesce(_changed_form(F.when(touched(column), column)), column)


def with_consistent_text(df: DataFrame, *columns: str, suffix: str = "_consistent") -> DataFrame:
    """Add, for each named column, its consistent form and whether it needed the change.

    Columns ``<name><suffix>`` and ``<name>_changed`` must not exist yet.
    """
    if clash := {n for c in columns for n in (c + suffix, c + "_changed")} & set(df.columns):
        raise ValueError(f"columns exist already: {sorted(clash)}")
    for name in columns:
        df = df.withColumn(name + suffix, consistent(F.col(name)))
        df = df.withColumn(name + "_changed", F.coalesce(F.col(name) != F.col(name + suffix), F.lit(False)))
    return df
