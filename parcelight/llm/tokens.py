"""Token ids of whole texts through the public ``tokenizers`` library, cached by pre-token.

Byte-pair merges never cross a pre-token, so a document's ids are the ids of its pre-tokens in
order.  Each worker keeps a bounded table ``pre-token -> little-endian uint32 ids`` and asks the
library only for pre-tokens it has not met, many at a time.  Texts with characters outside
:data:`PLAIN` (where two regular-expression engines might class a character differently), and texts
that hold a special token's string, go to the library whole.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import lru_cache

import numpy as np

#: Characters whose class (letter, number, space, other) is the same in every Unicode version.
PLAIN = re.compile("[^\t\n\r -~¡-¬®-ʯ]")
_L = "A-Za-zªµºÀ-ÖØ-öø-ʯ"
_N = "0-9²³¹¼-¾"
#: The pre-token patterns that the two vocabularies' own files state, over PLAIN characters; letters, the most common kind, first.
BYTE_LEVEL = re.compile(f" ?[{_L}]++|'(?:[stmd]|re|ve|ll)| ?[^\\s{_L}{_N}]++| ?[{_N}]++|\\s+(?!\\S)|\\s++")
WORD_END = re.compile(f"[{_L}]++|'(?:[stmd]|re|ve|ll)|[^\\s{_L}{_N}]++|[{_N}]")


class CachedTokenizer:
    """``encode(texts)`` gives, for each text, its ids as little-endian uint32 bytes.

    ``max_cached`` bounds the table, so memory does not grow with the corpus: it has two halves, and when the newer
    is full it replaces the older.  Pre-tokens met again are taken over from the older half, so the common
    ones stay.  Null counts as empty.
    """

    def __init__(self, path: str, max_cached: int = 600_000, together: int = 100):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.max_cached, self.together = max_cached, together
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        size = self.lib.get_vocab_size(with_added_tokens=True)
        names = [self.lib.id_to_token(i) or "" for i in range(size)]
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        # "Ġ" starts a pre-token that has its space; "</w>" ends a word.
        self.word_end = any(n.endswith("</w>") for n in names)
        self.mark = np.array([n.endswith("</w>") if self.word_end else n.startswith("Ġ") for n in names])
        self.line_break = None if self.word_end else self.lib.token_to_id("Ċ")
        self.pattern = WORD_END if self.word_end else BYTE_LEVEL

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _learn(self, pieces: list[str], known: dict[str, bytes]) -> None:
        """Put the ids of new pre-tokens in ``known``; runs of plain words go to the library as one text."""
        words, spaced, rest = [], [], []
        for p in pieces:  # a pre-token that starts with a letter holds letters alone, and so does one of a space and a letter
            (words if p[0].isalpha() else spaced if p[0] == " " and p[-1].isalpha() else rest).append(p)
        for group, glue in ((words, " " if self.word_end else "\n"), (spaced, "")):
            parts = [group[i : i + self.together] for i in range(0, len(group), self.together)]
            for some, e in zip(parts, self.lib.encode_batch_fast([glue.join(g) for g in parts], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, dtype="<u4")
                if self.word_end:
                    ends = np.flatnonzero(self.mark[ids]) + 1
                    starts, stops = np.concatenate(([0], ends[:-1])), ends
                elif glue:
                    cut = np.flatnonzero(ids == self.line_break)
                    starts, stops = np.concatenate(([0], cut + 1)), np.concatenate((cut, [len(ids)]))
                else:
                    starts = np.flatnonzero(self.mark[ids])
                    stops = np.concatenate((starts[1:], [len(ids)]))
                if len(starts) == len(some):
                    raw = ids.tobytes()
                    known.update(zip(some, map(raw.__getitem__, map(slice, (4 * starts).tolist(), (4 * stops).tolist())), strict=True))
                else:  # not seen in practice; the library alone decides then
                    rest += some
        for i in range(0, len(rest), 4096):
            some = rest[i : i + 4096]
            for p, e in zip(some, self.lib.encode_batch_fast(some, add_special_tokens=False), strict=True):
                known[p] = np.array(e.ids, dtype="<u4").tobytes()

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        out: list[bytes] = []
        for i in range(0, len(texts), 256):
            out += self._encode_some(texts[i : i + 256])
        return out

    def _encode_some(self, texts: Sequence[str | None]) -> list[bytes]:
        get, out, open_, new = self.cache.get, [], [], {}
        for k, text in enumerate(texts):
            text = text or ""
            if PLAIN.search(text) or any(s in text for s in self.special):
                out.append(self._ids(text).tobytes())
                continue
            pieces = self.pattern.findall(text.lower() if self.word_end else text)
            found = list(map(get, pieces))
            try:
                out.append(b"".join(found))
            except TypeError:  # a piece is not in the table
                holes = [i for i, f in enumerate(found) if f is None]
                names = [pieces[i] for i in holes]
                new.update(dict.fromkeys(names))
                open_.append((k, found, holes, names))
                out.append(b"")
        if new:
            self._learn([p for p in new if p not in self.older], new)
            new.update((p, self.older[p]) for p, f in new.items() if f is None)
            for k, found, holes, names in open_:
                for i, p in zip(holes, names, strict=True):
                    found[i] = new[p]
                out[k] = b"".join(found)
            if 2 * (len(self.cache) + len(new)) > self.max_cached:
                self.older, self.cache = self.cache, {}
            self.cache.update(new)
        return out


@lru_cache(maxsize=2)
def tokenizer(path: str) -> CachedTokenizer:
    """One per worker process and vocabulary file."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return CachedTokenizer(path)
