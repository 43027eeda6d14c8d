"""Token ids of whole texts by a public vocabulary, fast enough for text with many unseen words."""

from __future__ import annotations

import os
from collections.abc import Sequence

import numpy as np

#: Name of the default vocabulary file; ``tokenizer_path`` is a parameter wherever it is used.
VOCABULARY = "byte_bpe_50k.json"
#: Words whose ids a Python worker remembers, in two generations.
REMEMBERED = 1_000_000
#: New words that are encoded at once: few enough that the library's own tables for them stay in the processor's cache.
TOGETHER = 128


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


class Encoder:
    """Encodes texts with the tokenizers library, remembering the ids of pieces between single spaces.

    In this vocabulary's splitting rule a single space between two non-space characters always begins a new
    piece, and no merge crosses pieces. So a text may be cut there, and the ids of its cuts concatenated. Where white space
    stands beside a space, the cuts are joined again first. ``exact`` texts in tests show that ids equal those of the whole text.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.model = Tokenizer.from_file(path)
        rule = self.model.pre_tokenizer
        #: Other vocabularies may split or change texts differently: they get whole texts.
        self.cuttable = self.model.normalizer is None and isinstance(rule, ByteLevel) and rule.use_regex and not rule.add_prefix_space
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        #: Ids of words. Those not met in the newer half of what is remembered are ``older``; of these the ones that come again stay.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}
        words = self.model.get_vocab()
        self.width = np.zeros(max(words.values()) + 1, np.int64)  # bytes of each token: a character of the vocabulary is a byte
        for w, i in words.items():
            self.width[i] = len(w)

    def _learn(self, words: set[str]) -> None:
        """Remembers the ids of each word with a space before it.

        Marks after a letter or digit are a piece of their own, so a word with marks is put together from its parts.
        """
        known, ended, plain = self.known, [], []
        for w in words:
            base = w.rstrip(_MARKS)
            if base and base != w and base[-1].isalnum():
                ended.append((w, base))
            else:
                plain.append(w)
        self._learn_plain(list({base for _, base in ended}.difference(known).union(plain)))
        new = list({w[len(base) :] for w, base in ended}.difference(self.marks))
        self.marks.update(zip(new, self._alone(new), strict=True))
        for w, base in ended:
            known[w] = known[base] + self.marks[w[len(base) :]]

    def _learn_plain(self, words: list[str]) -> None:
        """Words are encoded as one text, ``TOGETHER`` at a time, and told apart by length."""
        for i in range(0, len(words), TOGETHER):
            some = words[i : i + TOGETHER]
            ids = np.array(self.model.encode_batch_fast([" " + " ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.cumsum([len(w.encode()) + 1 for w in some])
            upto = np.searchsorted(np.cumsum(self.width[ids]), ends, side="right").tolist()
            raw, last = ids.tobytes(), 0
            for w, k in zip(some, upto, strict=True):
                self.known[w] = raw[4 * last : 4 * k]
                last = k

    def _alone(self, texts: list[str]) -> list[bytes]:
        got = self.model.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, np.uint32).tobytes() for e in got]

    def encode(self, texts: Sequence[str | None], end: int | None = None) -> list[np.ndarray]:
        """uint32 ids of each text, with ``end`` appended if given; a null text is an empty one."""
        tail = b"" if end is None else np.array([end], np.uint32).tobytes()
        if len(self.known) > REMEMBERED // 2:
            self.older, self.known = self.known, {}
            self.marks.clear()
        heads, parts = [], []
        new: set[str] = set()
        for t in texts:
            t = t or ""
            # a text that holds a special token's string is encoded whole, as the library reads such strings as that token
            (head,), words = _cuts(t) if self.cuttable and not any(map(t.__contains__, self.special)) else ([t], [])
            # the words are looked up twice, but both times without a Python step for each
            new |= set(words).difference(self.known)
            heads.append(head)
            parts.append(words)
        if self.older:
            again = [*filter(self.older.__contains__, new)]
            self.known.update(zip(again, map(self.older.__getitem__, again), strict=True))
            new.difference_update(again)
        if new:
            self._learn(new)
        ids = self.known.__getitem__
        return [np.frombuffer(b"".join([head, *map(ids, words), tail]), np.uint32) for head, words in zip(self._alone(heads), parts, strict=True)]


#: Marks that may end a word.
_MARKS = ".,;:!?#$%&*|)]}\"/-_+=~"
#: White space other than the space and the line feed.
_RARE = tuple(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")


def _plain(text: str) -> bool:
    """No white space but line feeds inside, and no space beside another white space; quick to see."""
    ends = text[:1] + text[-1:]
    return not (" " in ends or "\n" in ends or "  " in text or " \n" in text or "\n " in text or any(map(text.__contains__, _RARE)))


def _cuts(text: str) -> tuple[list[str], list[str]]:
    """([beginning], words): the text is the beginning and then each word after a single space, all safe to cut there."""
    if _plain(text):
        first, *words = text.split(" ")
        return [first], words
    out: list[str] = []
    safe = False  # what is before ends with a non-space
    for p in text.split(" "):
        if out and not (safe and p and not p[0].isspace()):
            out[-1] += " " + p
        else:
            out.append(p)
        safe = bool(p) and not p[-1].isspace()
    # only the last word can end with white space, where nothing may follow when many words are encoded at once
    if len(out) > 1 and out[-1][-1].isspace():
        return [" ".join(out)], []
    return out[:1], out[1:]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per Python worker and vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
