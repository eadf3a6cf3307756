"""A cache of encoded chunks between single spaces and line feeds.

Most of a text's chunks have been seen before, more so with a comma or full stop
at their end as a chunk of its own.  A chunk that an encoder cannot take by
itself (it holds other white space, rare characters or the start of a special
token, or it still ends in a mark) spoils its text, which is then encoded in
another way.
"""

from __future__ import annotations

from __future__ import annotations

import re
from collections.abc import Callable

#: Chunks kept by a Python worker; a full cache is emptied, which costs only time.
LIMIT = 600_000
#: Marks that must stay together: a text with them is not split at its marks.
RUNS = (",, ", "., ", ",. ", ".. ")
#: What a chunk may hold: characters whose class no library version disputes,
#: after a sign that the caller may have put before it.
_PLAIN = re.compile("[\x03\x04]?[!-~¡-¬®-ǿ]+").fullmatch


def plain(chunk: str) -> bool:
    return _PLAIN(chunk) is not None and "<|" not in chunk


class Chunks:
    """``encode`` turns a list of chunks into a list of bytes; ``fixed`` are
    chunks with bytes of their own; with ``bare``, other chunks that do not end
    in a letter or digit, as lower case, spoil a text; with ``ragged``, only if
    one of ``fixed`` follows them; what ``other`` knows is not encoded again."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], fixed: dict[str, bytes], bare: bool, other: Chunks | None = None, ragged: bool = False, limit: int = LIMIT):
        self.encode, self.fixed, self.bare, self.limit = encode, fixed, bare, limit
        self.ragged: dict[str, bytes] | None = {} if ragged else None
        self.other: dict[str, bytes | bool] = other.known if other else {}
        self.known: dict[str, bytes | bool] = dict(fixed)

    def get(self, words: list[str]) -> bytes | None:
        """The bytes of all ``words``, joined; None if one of them spoils it."""
        return self.get_all([words])[0]

    def get_all(self, texts: list[list[str]]) -> list[bytes | None]:
        """The same for each of ``texts``; what is new in any is encoded at once."""
        known = self.known
        outs = [list(map(known.get, words)) for words in texts]
        holes = [[i for i, v in enumerate(out) if v is None] if None in out else [] for out in outs]
        new = {words[i] for words, spots in zip(texts, holes) for i in spots}
        if new:
            self._learn(new)
        got: list[bytes | None] = []
        loose = []
        for k, (words, out, spots) in enumerate(zip(texts, outs, holes)):
            for i in spots:
                out[i] = known[words[i]]
            try:
                got.append(b"".join(out))
            except TypeError:
                got.append(None)
                loose.append(k)
        if loose and self.ragged is not None:
            for k, x in zip(loose, self._loose([texts[k] for k in loose], [outs[k] for k in loose])):
                got[k] = x
        return got

    def _learn(self, new: set[str]) -> None:
        known = self.known
        if len(known) + len(new) > self.limit:
            known.clear()
            known.update(self.fixed)
        good = [w for w in new if (w.isalnum() and w.isascii()) or (plain(w) and (not self.bare or w.lower()[-1].isalnum()))]
        if len(good) < len(new):
            known.update(dict.fromkeys(new.difference(good), False))
        if self.other:
            known.update((w, self.other.get(w, False)) for w in good)
            good = [w for w in good if not known[w]]
        if good:
            known.update(zip(good, self.encode(good)))

    def _loose(self, texts: list[list[str]], outs: list[list]) -> list[bytes | None]:
        """The same where chunks that end in no letter or digit are no spoilers,
        unless a fixed chunk follows, which would belong to their last token."""
        ragged, fixed = self.ragged, self.fixed
        spots = [[i for i, v in enumerate(out) if v is False] for out in outs]
        for k, words in enumerate(texts):
            if not all(plain(words[i]) for i in spots[k]) or any(words[i + 1] in fixed for i in spots[k] if i + 1 < len(words)):
                spots[k] = []
        need = {words[i] for words, mine in zip(texts, spots) for i in mine}
        if len(ragged) + len(need) > LIMIT // 8:
            ragged.clear()
        new = [w for w in need if w not in ragged]
        if new:
            ragged.update(zip(new, self.encode(new)))
        for words, out, mine in zip(texts, outs, spots):
            for i in mine:
                out[i] = ragged[words[i]]
        return [b"".join(out) if mine else None for out, mine in zip(outs, spots)]
