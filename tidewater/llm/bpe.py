"""Byte-pair encoding by a tokenization automaton, and decoding by emitting its arcs' labels."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm import common
from tidewater.llm.common import tidied

#: How byte-level vocabularies split text before their merges.
PRE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces whose ids a Python worker keeps at once; when full, it starts over.
KEPT = 700_000
#: Texts whose new pieces are encoded together.
TOGETHER = 256


def byte_names() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """A deterministic automaton over token ids that accepts exactly the token sequences that BPE makes.

    Merges are compiled one after another by a gadget each. Before any merge, one state has an arc to itself
    for every byte. The gadget for u v -> w redirects all u-arcs to a copy of their target without its
    v-arc, and adds a w-arc beside each u-arc, to where u v led. All u-arcs share one target at any time, so
    after a token the state is named by the token, and its copies by time: ``gone`` holds the time at which a
    copy lost an arc. A token made by a merge starts in the state that its right part had just then (``born``,
    ``right``), and has an arc from every state that had one for its left part (``left``).
    """

    def __init__(self, vocab: dict[bytes, int], merges: list[tuple[bytes, bytes]], special: dict[str, int]):
        self.special = special
        size = max([*vocab.values(), *special.values()], default=-1) + 1
        self.labels: list[bytes] = [b""] * size
        for label, i in [*vocab.items(), *((s.encode(), i) for s, i in special.items())]:
            self.labels[i] = label
        self.gone: dict[int, int] = {}
        self.born, self.left, self.right = [0] * size, [-1] * size, [-1] * size
        made = {i for t, i in vocab.items() if len(t) == 1}
        for time, (a, b) in enumerate(merges, 1):
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            if w in made or u not in made or v not in made or not self.follows(u, v):
                continue
            self.gone[u << 20 | v] = time
            self.born[w], self.left[w], self.right[w] = time, u, v
            made.add(w)
        self.ids = {t: i for t, i in vocab.items() if i in made}
        self.longest = max(map(len, self.ids), default=1)
        self.table: dict[int, bool] = {}
        self.last, self.came, self.by = b"", [0], [-1]
        split = "|".join(map(re.escape, sorted(special, key=len, reverse=True)))
        self.split_special = re.compile(f"({split})") if special else None
        self.pre = regex.compile(PRE_SPLIT)
        self.inner: dict[str, tuple[int, ...]] = {}
        self.after_space: dict[str, bytes] = {}

    def follows(self, x: int, y: int) -> bool:
        """Whether the state after token ``x`` has an arc for token ``y``."""
        gone, born, until = self.gone, self.born, 1 << 40
        while True:
            added = born[y]
            while True:
                if gone.get(x << 20 | y, until) < until:
                    return False
                if born[x] <= added:
                    break
                until, x = born[x], self.right[x]
            if not added:
                return True
            until, y = added + 1, self.left[y]

    def word(self, data: bytes) -> tuple[int, ...]:
        """The ids of one pre-split word: the only path whose labels spell it.

        Every prefix has one path, so a place needs one state; the longest last token is tried first. What the
        word has in common with the one before isn't walked again.
        """
        ids, table, longest = self.ids, self.table, self.longest
        if (whole := ids.get(data)) is not None:
            return (whole,)
        came, by, same = self.came, self.by, 0
        for a, b in zip(data, self.last):
            if a != b:
                break
            same += 1
        n = len(data)
        if n >= len(by):
            came += [0] * (n + 1 - len(by))
            by += [-1] * (n + 1 - len(by))
        self.last = data
        for stop in range(same + 1, n + 1):
            for start in range(max(0, stop - longest), stop):
                token = ids.get(data[start:stop])
                if token is None:
                    continue
                if start:
                    key = by[start] << 20 | token
                    arc = table.get(key)
                    if arc is None:
                        arc = table[key] = self.follows(by[start], token)
                    if not arc:
                        continue
                came[stop], by[stop] = start, token
                break
        if len(table) > 4 * KEPT:
            table.clear()
        out = []
        while n:
            out.append(by[n])
            n = came[n]
        return tuple(reversed(out))

    def piece(self, text: str) -> tuple[int, ...]:
        """The ids of a text without special tokens."""
        out: list[int] = []
        for w in self.pre.findall(text):
            ids = self.inner.get(w)
            if ids is None:
                if len(self.inner) > KEPT:
                    self.inner.clear()
                ids = self.word(w.encode())
                if len(w) < 64:
                    self.inner[w] = ids
            out += ids
        return tuple(out)

    def learn(self, texts: set[str]) -> None:
        """Keeps the ids of a space and each of ``texts``; letters, alone or before symbols, need no pattern to be split."""
        kept = self.after_space
        pack = lambda ids: np.array(ids, dtype="<u4").tobytes()
        ended = {w: m for w in texts if not w.isalpha() and (m := ENDED.fullmatch(w)) and m[1].isalpha()}
        for w in sorted({w for w in texts if w.isalpha()}.union(m[1] for m in ended.values()).difference(kept)):
            kept[w] = pack(self.word(b" " + w.encode()))
        for w, m in ended.items():
            kept[w] = kept[m[1]] + pack(self.piece(m[2]))
        for w in texts.difference(kept):
            kept[w] = pack(self.piece(" " + w))

    def encode_all(self, texts: list[str]) -> Iterator[list[int]]:
        """The ids of each text.

        A space between two characters that aren't white space always begins a word, so a text can be cut there and
        the pieces' ids are kept, as unsigned 32-bit integers; a text with other runs of white space around spaces is
        encoded in one piece, and so are the parts of a text that holds special tokens.
        """
        cut = [None if self.whole(t) else t.split(" ") for t in texts]
        for c in cut:
            if c:
                c[0] = self.piece(c[0])
        if len(self.after_space) > KEPT:
            self.after_space.clear()
        self.learn(set().union(*(c[1:] for c in cut if c)).difference(self.after_space))
        kept = self.after_space
        for text, parts in zip(texts, cut):
            if parts:
                yield [*parts[0], *np.frombuffer(b"".join(map(kept.__getitem__, parts[1:])), "<u4").tolist()]
            elif self.special:
                yield [i for part in self.split_special.split(text) for i in ((self.special[part],) if part in self.special else self.piece(part))]
            else:
                yield list(self.piece(text))

    def whole(self, text: str) -> bool:
        """Whether a text can't be cut at its spaces."""
        return "  " in text or "\n " in text or " \n" in text or text[:1] == " " or text[-1:] == " " or bool(odd_space(text)) or any(s in text for s in self.special)

    def encode(self, text: str) -> list[int]:
        return next(self.encode_all([text]))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", errors="replace")


#: Letters before a run of symbols other than the apostrophe, which may begin a suffix.
ENDED = re.compile(r"([^\W\d_]+)([^\w\s']+)")
#: Finds white space other than space and newline.
odd_space = re.compile(r"[^\S \n]").search


@lru_cache(maxsize=2)
def automaton(path: str) -> Automaton:
    """The automaton of a byte-level vocabulary file, compiled once a Python worker."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    names = byte_names()
    raw = lambda s: bytes(names[c] for c in s)
    merges = [m.split(" ", 1) if isinstance(m, str) else m for m in spec["model"]["merges"]]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    vocab = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    return Automaton(vocab, [(raw(a), raw(b)) for a, b in merges], special)


def encode_documents(docs: DataFrame, path: str, keep: list[str] | None = None, with_ids: bool = False) -> DataFrame:
    """Each document's id count, digest of its ids, and digest of the text decoded from them.

    Texts are encoded whole; a null text counts as empty (no ids, digests of the empty string). Special tokens'
    strings in a text become their ids. ``keep`` names columns to carry (default doc_id); ``with_ids`` adds the ids as
    little-endian unsigned 32-bit integers.
    """
    keep = keep or ["doc_id"]
    source = docs.select(*keep, F.col("text").alias("_text"))
    out = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]], "n_tokens long, ids_sha256 string, decoded_sha256 string"])
    names = [f.name for f in source.schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(path)
        common.KEPT["bpe"] = automaton.cache_clear
        digits = [str(i) for i in range(len(machine.labels))]
        for part in (b.slice(at, TOGETHER) for b in batches for at in range(0, b.num_rows, TOGETHER)):
            made = [
                (
                    len(ids),
                    hashlib.sha256(",".join(map(digits.__getitem__, ids)).encode()).hexdigest(),
                    hashlib.sha256(machine.decode(ids).encode()).hexdigest(),
                    np.array(ids, dtype="<u4").tobytes() if with_ids else None,
                )
                for ids in machine.encode_all([t or "" for t in part.column(len(names)).to_pylist()])
            ]
            facts = [pa.array([m[i] for m in made], kind) for i, kind in enumerate([pa.int64(), pa.string(), pa.string()] + [pa.binary()] * with_ids)]
            yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], *facts], names=[*names, "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids)

    return source.mapInArrow(tidied(run, "bpe"), out + ", ids binary" * with_ids)
