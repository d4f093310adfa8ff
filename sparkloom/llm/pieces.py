"""Encoding texts with a public byte-level tokenizer, piece by piece.

The tokenizer splits a text before it merges, and it always splits before a single space
or line break that stands between two characters that are not white space, and after such
a line break. Ids of the text are therefore those of its pieces, put together: a piece is
a word with the space or line break before it. The distinct pieces of a group of texts are
looked up among those met before, the new ones are encoded as the words of one text and told
apart by the ids that begin with a space (as the lines of one, for those after a line break),
and the texts are put together by position. A text
with any other white space (doubled, leading or trailing, or next to other white space), or
with the string of an added token, is encoded as it is.

What a worker remembers is bounded in number and by the length of a piece; beyond the bound
it keeps what the texts at hand have met again.
"""

from __future__ import annotations

import functools
import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces that a worker remembers, and the length up to which it does.
REMEMBERED = 300_000
LONGEST = 32
#: Characters of texts (about) whose pieces are looked up together; pieces in one call of the tokenizer.
CHARACTERS = 1 << 21
PIECES = 200
#: A word of letters and what closes it: the tokenizer always splits between the two.
_CLOSING = ".,;:!?"


def vocabulary(name: str) -> str:
    """A tokenizer file by name; a path is taken as it is."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Texts to ids (uint32), remembering pieces. ``added_as_text``: the strings of added tokens in a text are ordinary text."""

    def __init__(self, name: str, added_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary(name))
        self.tokenizer.encode_special_tokens = added_as_text
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Ids as bytes, by piece (without its space, but with its line break).
        self.known: dict[str, bytes] = {}
        self.ends: dict[str, bytes] = {}
        self.line_break = int(self._whole(["\n"])[0][0])
        space = self.tokenizer.id_to_token(int(self._whole([" "])[0][0]))
        vocabulary_ = self.tokenizer.get_vocab(with_added_tokens=True)
        #: Whether an id's token begins with a space.
        self.spaced = np.zeros(max(vocabulary_.values()) + 1, bool)
        self.spaced[[i for t, i in vocabulary_.items() if t.startswith(space)]] = True

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(array("I", e.ids), np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _each(self, words: list[str], lead: str) -> list[bytes]:
        """The ids of words without white space at their ends, each after ``lead``, a space or nothing."""
        out: list[bytes] = []
        for at in range(0, len(words), PIECES):
            part = words[at : at + PIECES]
            ids = self._whole([lead + (lead or "\n").join(part)])[0]
            edges = np.flatnonzero(self.spaced[ids])[1:] if lead else np.flatnonzero(ids == self.line_break)
            if len(edges) != len(part) - 1:
                out += [x.tobytes() for x in self._whole([lead + w for w in part])]
                continue
            raw, ends = ids.tobytes(), (4 * edges).tolist()
            skip = 0 if lead else 4
            out += [raw[a:b] for a, b in zip([0, *[e + skip for e in ends]], [*ends, len(raw)], strict=True)]
        return out

    def _end(self, closing: str) -> bytes:
        if (ids := self.ends.get(closing)) is None:
            if len(self.ends) >= PIECES:
                self.ends.clear()
            ids = self.ends[closing] = self._whole([closing])[0].tobytes()
        return ids

    def _learn(self, new: list[str]) -> tuple[dict[str, bytes], dict[str, bytes]]:
        """The ids of pieces, but for those with white space that the rule doesn't cover: of words, to be remembered, and of closed words, put together from the word and its closing."""
        words, closed = [], []
        for piece in new:
            if piece.isalpha():
                words.append(piece)
                continue
            body = piece[1:] if piece[:1] == "\n" else piece
            if not body or body[0].isspace() or body[-1].isspace():
                continue
            if body[-1] in _CLOSING and (word := piece.rstrip(_CLOSING)).lstrip("\n").isalpha():
                closed.append((piece, word))
            else:
                words.append(piece)
        known = self.known
        words = list(dict.fromkeys([*words, *[w for _, w in closed if w not in known]]))
        after, heads = [w for w in words if w[0] != "\n"], [w for w in words if w[0] == "\n"]
        ids = dict(zip(after, self._each(after, " "), strict=True))
        line_break = np.uint32(self.line_break).tobytes()
        ids |= {w: line_break + i for w, i in zip(heads, self._each([w[1:] for w in heads], ""), strict=True)}
        return ids, {p: (ids[w] if w in ids else known[w]) + self._end(p[len(w) :]) for p, w in closed}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, in order."""
        out: list[np.ndarray] = []
        at = 0
        while at < len(texts):
            upto, size = at + 1, len(texts[at])
            while upto < len(texts) and size + len(texts[upto]) <= CHARACTERS:
                size += len(texts[upto])
                upto += 1
            out += self._together(texts[at:upto])
            at = upto
        return out

    def _together(self, texts: list[str]) -> list[np.ndarray]:
        # Each text begins with a line break, whose id is left out again.
        pieces = pc.split_pattern(pa.array(["\n" + t.replace("\n", " \n") for t in texts], pa.large_string()), " ")
        edges, coded = pieces.offsets.to_numpy(), pieces.flatten().dictionary_encode()
        which, distinct = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = list(map(self.known.get, distinct))
        if len(self.known) > REMEMBERED:
            self.known = {p: i for p, i in zip(distinct, ids, strict=True) if i is not None}
        new, closed = self._learn([p for p, i in zip(distinct, ids, strict=True) if i is None])
        closed |= new
        ids = [closed.get(p) if i is None else i for p, i in zip(distinct, ids, strict=True)]
        self.known.update((p, i) for p, i in new.items() if len(p) <= LONGEST)

        odd = np.array([i is None for i in ids])
        length = np.array([0 if i is None else len(i) // 4 for i in ids])
        flat = np.frombuffer(b"".join([i for i in ids if i is not None]), np.uint32)
        each = length[which]
        ends = np.cumsum(each)
        got = flat[np.repeat((np.cumsum(length) - length)[which] - (ends - each), each) + np.arange(len(each) and ends[-1])]
        ends = np.concatenate([[0], ends])[edges]
        whole = np.add.reduceat(odd[which], edges[:-1]) > 0
        out = [got[a + 1 : b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        again = [i for i, t in enumerate(texts) if t and (whole[i] or any(x in t for x in self.added))]
        for i, found in zip(again, self._whole([texts[i] for i in again]), strict=True):
            out[i] = found
        for i, t in enumerate(texts):
            if not t:
                out[i] = np.empty(0, np.uint32)
        return out


@functools.lru_cache
def encoder(name: str) -> Encoder:
    """One encoder for each tokenizer and process."""
    return Encoder(name)
