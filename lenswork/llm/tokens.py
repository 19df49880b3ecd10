"""Token ids of whole texts with the tokenizers library, for the packing and the id writing operators.

The ids are those of the tokenizer as its file states it: the strings of its special tokens become those
tokens also inside a text. A text is cut at single spaces, where neither vocabulary lets a token cross, and
each distinct chunk is encoded once per Python worker. Texts with runs of white space or with the string of
a special token go to the tokenizer whole, so the ids are always those of the whole text.
"""

from __future__ import annotations

import re
from array import array

import numpy as np

from .common import worker_cache

#: Chunks kept per worker (about 160 MB), and the longest chunk that is kept.
CACHE_ENTRIES, CACHE_CHARS = 800_000, 40
#: Chunks in one string for the tokenizer.
GROUP = 64
_WHITE = [chr(c) for c in range(0x3001) if chr(c).isspace()]
_RARE = re.compile("[" + "".join(c for c in _WHITE if c not in " \n") + "]")


def _doubtful(text: str) -> bool:
    """Whether a space may stand beside other white space or at an end."""
    return text[0].isspace() or text[-1].isspace() or "  " in text or " \n" in text or "\n " in text or _RARE.search(text) is not None


class Encoder:
    def __init__(self, path: str, leading_space: bool):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.prefix = " " if leading_space else ""
        self.known: dict[str, bytes] = {}
        #: A text of one token that never joins its neighbours, to encode many chunks in one call.
        self.mark, self.between = ("\n", "\n ") if leading_space else ("|", " | ")
        self.mark_id = self.tokenizer.encode(self.mark, add_special_tokens=False).ids

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """The same for chunks without spaces (with the prefix): most of them in one call, cut at the marks."""
        plain = [c for c in chunks if c and self.mark not in c]
        found: dict[str, bytes] = {}
        groups = [plain[i : i + GROUP] for i in range(0, len(plain), GROUP)] if len(self.mark_id) == 1 else []
        made = self.tokenizer.encode_batch_fast([self.prefix + self.between.join(g) for g in groups], add_special_tokens=False)
        for group, one in zip(groups, made):
            ids = np.array(one.ids, np.uint32)
            cuts = (4 * np.flatnonzero(ids == self.mark_id[0])).tolist()
            if len(cuts) == len(group) - 1:
                raw = ids.tobytes()
                found.update({c: raw[a:z] for c, a, z in zip(group, [0, *(x + 4 for x in cuts)], [*cuts, len(raw)])})
        rest = [c for c in chunks if c not in found]
        found.update(zip(rest, self._encode([self.prefix + c for c in rest])))
        return [found[c] for c in chunks]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(texts)
        whole, heads, parts, missing = [], [], {}, {}
        get = self.known.get
        for i, text in enumerate(texts):
            if not text:
                continue
            if any(x in text for x in self.special) or self.prefix and _doubtful(text):
                whole.append(i)
                continue
            chunks = text.split(" ")
            if self.prefix:
                heads.append(chunks.pop(0))
            found = list(map(get, chunks))
            parts[i] = found
            if new := [(k, chunks[k]) for k, ids in enumerate(found) if ids is None]:
                missing[i] = new
        wanted = list({c for x in missing.values() for _, c in x})
        new = dict(zip(wanted, self._encode_chunks(wanted)))
        for i, x in missing.items():
            found = parts[i]
            for k, c in x:
                found[k] = new[c]
        if len(self.known) + len(new) <= CACHE_ENTRIES:
            self.known.update((c, v) for c, v in new.items() if len(c) <= CACHE_CHARS)
        first = self._encode(heads) if self.prefix else [b""] * len(parts)
        for head, (i, found) in zip(first, parts.items()):
            out[i] = head + b"".join(found)
        for i, ids in zip(whole, self._encode([texts[i] for i in whole])):
            out[i] = ids
        return out


def encoder(path: str, leading_space: bool) -> Encoder:
    """One per Python worker and file; workers are used again, so the chunks stay known."""
    encoders, key = worker_cache("tokens"), (path, leading_space)
    if key not in encoders:
        encoders[key] = Encoder(path, leading_space)
    return encoders[key]


def in_groups(values: list, most_chars: int = 2_000_000):
    """Index ranges of at most so many characters (or one text)."""
    start, chars = 0, 0
    for i, v in enumerate(values):
        n = len(v) if v else 0
        if i > start and chars + n > most_chars:
            yield start, i
            start, chars = i, 0
        chars += n
    if start < len(values):
        yield start, len(values)
