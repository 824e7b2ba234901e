"""BPE by a deterministic tokenization automaton.

Two tables are compiled from a vocabulary file. The first is over tokens and accepts exactly the sequences that merging
would produce. It starts as one state with an arc for each symbol; each merge (x, y) -> z in turn adds its gadget:
wherever an x-arc leads to a state with a y-arc, a z-arc by-passes the two to where they led, and the x-arc now leads
to a copy of that state without a y-arc. All arcs of one token lead to one state. With tokens numbered so that a token
is followed by those that begin with it, the latest gadget first, what a copy lacks is one range of numbers: a state's
row is the bounds of the ranges that it and the states that it was copied from lack.

The second is over bytes: a state is the set of tokens begun and not ended, each with the token before it. As each
prefix of a word has exactly one path, a byte ends exactly one token on a path, so a state has one token to its name,
and one next state for each byte. Encoding is a look-up for each byte, and the tokens are read off from the word's end.
States and rows are worked out when first reached, and kept. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Words whose tokens a task keeps, and states of the byte table; beyond it either starts anew.
CACHE = 300_000
STATES = 150_000


@lru_cache(maxsize=1)
def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else the next free code point from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class _Words(dict):
    """Packed ids of the words that a task has met; others go through the automaton."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        ids = self.automaton.encode_word(word.encode())
        found = self[word] = struct.pack(f"<{len(ids)}I", *ids)
        return found


class Automaton:
    """tokens: id of each token string; merges: pairs in order of rank; end: what the last symbol of a word carries."""

    def __init__(self, tokens: dict[str, int], merges: list[tuple[str, str]], end: str, special: dict[str, int]):
        self.special = special
        self.labels = {i: t for t, i in (tokens | special).items()}
        n = max(self.labels) + 1
        #: Of tokens: the time of the gadget (0: a symbol), and the state that all arcs of a token lead to.
        made, self.target = array("i", [0] * n), array("i", [0] * n)
        #: Of states: the range of token numbers that it lacks against its parent.
        self.parent, lacks = array("i", [0]), [(-1, 0)]
        longer: list[list[int]] = [[] for _ in range(n)]
        for when, (x, y) in enumerate(merges, 1):
            a, b, z = tokens[x], tokens[y], tokens[x + y]
            made[z] = when
            longer[a].append(z)
            self.target[z] = self.target[b]
            self.parent.append(self.target[a])
            lacks.append((b, when))
            self.target[a] = len(lacks) - 1
        self.number, stop = array("i", [0] * n), array("i", [0] * n)
        at = 0
        todo = [(t, False) for t in tokens.values() if not made[t]]
        while todo:
            t, left = todo.pop()
            if left:
                stop[t] = at
                continue
            self.number[t] = at
            at += 1
            todo.append((t, True))
            todo += [(z, False) for z in longer[t]]  # the latest is on top
        # A copy made at a time lacks b and all that begin with b by gadgets from that time on.
        self.low, self.high = array("i"), array("i")
        for b, when in lacks:
            known = longer[b] if b >= 0 else []
            first = bisect_left(known, when, key=made.__getitem__)
            self.low.append(self.number[b] if b >= 0 else 0)
            self.high.append(stop[known[first]] if first < len(known) else self.low[-1] + (b >= 0))
        self.rows: dict[int, array] = {}
        self.words = _Words(self)

        back = {c: b for b, c in enumerate(byte_symbols())}
        #: The tokens' bytes as a tree: next node by node and byte, and the token that a node ends, within a word and at its end.
        self.tree: dict[int, int] = {}
        self.inner, self.final, self.size, self.n = array("i", [-1]), array("i", [-1]), array("i", [0] * n), n
        for token, i in tokens.items():
            last = token.endswith(end)
            node = 0
            raw = bytes(back[c] for c in (token[: -len(end)] if last else token))
            self.size[i] = len(raw)
            for byte in raw:
                node = self.tree.setdefault(node << 8 | byte, len(self.inner))
                if node == len(self.inner):
                    self.inner.append(-1)
                    self.final.append(-1)
            (self.final if last else self.inner)[node] = i
        self.restart()

    def restart(self) -> None:
        """The byte table with its first state alone: nothing begun, no token before."""
        self.states: list[tuple[tuple[int, int], ...]] = [((0, -1),)]
        self.known, self.ended = {self.states[0]: 0}, array("i", [-1])
        self.next: dict[int, int] = {}
        self.last: dict[int, int] = {}

    def row(self, state: int) -> array:
        """Bounds of the ranges of token numbers that a state lacks, in order."""
        found = self.rows.get(state)
        if found is None:
            spans, s = [], state
            while s:
                spans.append((self.low[s], self.high[s]))
                s = self.parent[s]
            found = array("i")
            for a, b in sorted(spans):
                if found and a <= found[-1]:
                    found[-1] = max(found[-1], b)
                else:
                    found.extend((a, b))
            self.rows[state] = found
        return found

    def arc(self, before: int, token: int) -> bool:
        """Whether the state after a token (-1: the first state) has an arc of another."""
        return before < 0 or not bisect_right(self.row(self.target[before]), self.number[token]) & 1

    def step(self, state: int, byte: int) -> int:
        """The entry of the byte table for a byte within a word."""
        begun, ended = [], -1
        for node, before in self.states[state]:
            to = self.tree.get(node << 8 | byte)
            if to is not None:
                begun.append((to, before))
                if self.inner[to] >= 0 and self.arc(before, self.inner[to]):
                    ended = self.inner[to]
        if ended < 0:
            raise ValueError(f"the vocabulary has no token for the byte {byte}")
        own = ((0, ended), *begun)
        found = self.known.setdefault(own, len(self.states))
        if found == len(self.states):
            self.states.append(own)
            self.ended.append(ended)
        self.next[state << 8 | byte] = found
        return found

    def stop(self, state: int, byte: int) -> int:
        """The entry for a word's last byte: the token that ends with it."""
        for node, before in self.states[state]:
            to = self.tree.get(node << 8 | byte)
            if to is not None and self.final[to] >= 0 and self.arc(before, self.final[to]):
                self.last[state << 8 | byte] = self.final[to]
                return self.final[to]
        raise ValueError(f"the vocabulary has no token for the last byte {byte}")

    def encode_word(self, word: bytes) -> list[int]:
        """The tokens on the one path of a pre-split word."""
        if not word:
            return []
        if len(self.states) > STATES:
            self.restart()
        state, path, get = 0, [], self.next.get
        for byte in word[:-1]:
            to = get(state << 8 | byte)
            state = self.step(state, byte) if to is None else to
            path.append(state)
        key = state << 8 | word[-1]
        token = self.last[key] if key in self.last else self.stop(state, word[-1])
        out, at = [token], len(word) - self.size[token]
        while at:
            token = self.ended[path[at - 1]]
            out.append(token)
            at -= self.size[token]
        return out[::-1]

    def encode_words(self, words: list[str]) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        kept = self.words
        return b"".join([kept[w] for w in words])

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs, as the file has no decoder: token strings with spaces between."""
        return " ".join(map(self.labels.__getitem__, ids))


class Tokenizer:
    """Reads a tokenizers JSON file of the word-end kind: its rules of splitting are taken from the file, and a file
    with others than these is refused."""

    #: The normalizer, and the steps of splitting with the pattern left out, that this class follows.
    NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
    SPLIT = [{"type": "Split", "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
    #: Fixed value: the pattern of splitting whose form for texts of code points under 256, which have no case or form
    #: outside of them, is LATIN.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    LATIN = re.compile("[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|'s|'t|'re|'ve|'m|'ll|'d|[^\t-\r \x85\xa0a-z0-9ªµº²³¹¼-¾ß-öø-ÿ]+")

    def __init__(self, content: str):
        known = json.loads(content)
        model = known["model"]
        if model["type"] != "BPE" or not model.get("end_of_word_suffix") or known["decoder"] or known["post_processor"]:
            raise ValueError("only BPE files with word ends, without decoder and post-processor, are read")
        if any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
            raise ValueError("the file's model has options that are not read")
        steps = [dict(x) for x in (known["pre_tokenizer"] or {}).get("pretokenizers", [])]
        pattern = (steps[0].pop("pattern", None) or {}).get("Regex") if steps else None
        if (known["normalizer"] or {}).get("normalizers") != self.NORMAL or steps != self.SPLIT or not pattern:
            raise ValueError("the file's normalizer or splitting is of a kind that is not read")
        if any(x.get(k) for x in known["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("the file's added tokens have flags that are not read")
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self.special = {x["content"]: x["id"] for x in known["added_tokens"]}
        self.automaton = Automaton(model["vocab"], merges, model["end_of_word_suffix"], self.special)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.latin = pattern == self.PATTERN
        self.content, self.library = content, None
        self.pattern = regex.compile(pattern.replace("\\s", "\\p{White_Space}"))

    def words(self, text: str) -> list[str]:
        if self.latin:
            try:
                text.encode("latin-1")
                return self.LATIN.findall(text.lower())
            except UnicodeEncodeError:
                pass
        if any(unicodedata.category(c) == "Cn" for c in set(text)):
            return self.library_words(text)
        # Letter by letter: a final sigma is lower-cased like any other. White space is not made one space first, as
        # the pattern drops it.
        return [m[0] for m in self.pattern.finditer(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())]

    def library_words(self, text: str) -> list[str]:
        """The same by the library's own steps, for texts with code points that newer versions of Unicode have letters at:
        what these are there is the version's that the library was built with."""
        if self.library is None:
            from tokenizers import Tokenizer as Library

            self.library = Library.from_str(self.content)
        back = {c: b for b, c in enumerate(byte_symbols())}
        cut = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(map(back.__getitem__, word)).decode() for word, _ in cut]

    def packed(self, text: str | None) -> bytes:
        if not text:
            return b""
        a = self.automaton
        if not any(x in text for x in self.special):
            return a.encode_words(self.words(text))
        return b"".join([struct.pack("<I", self.special[x]) if x in self.special else a.encode_words(self.words(x)) for x in self.cut.split(text)])

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.packed(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        return self.automaton.decode(ids)


def read_tokenizer(path: str) -> str:
    """The content of the file at path, read by the driver: a vocabulary is a few MB, whatever the corpus."""
    with open(path, encoding="utf-8") as f:
        return f.read()


@lru_cache(maxsize=1)
def _compiled(content: str) -> Tokenizer:
    return Tokenizer(content)


def encode(docs: DataFrame, tokenizer: str, ids: bool = True) -> DataFrame:
    """The columns of docs but for text, then n_tokens long, ids array<int> (if asked for), ids_sha256 and
    decoded_sha256 string, one row for each row of docs.

    tokenizer is the content of the file, see read_tokenizer. Texts are encoded whole; null counts as empty and gives
    no tokens. ids_sha256 is over the ids as little-endian unsigned 32-bit integers, decoded_sha256 over the decoded
    text in UTF-8. Columns of docs that are named like a new one keep their place under
    `source_<name>` (see common.renamed).
    """
    held = docs.sparkSession.sparkContext.broadcast(tokenizer)
    new = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    if not ids:
        new.pop("ids")
    kept = [c for c in docs.columns if c != "text"]
    names = common.renamed(kept, list(new))
    rows = docs.select("text", *[F.col(f"`{c}`").alias(n) for c, n in zip(kept, names, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _compiled(held.value)
        for batch in batches:
            # One text at a time: only the digests and, if asked for, the ids of a batch are held.
            n, own, packed, text = [], [], [], []
            for x in batch.column(0).to_pylist():
                raw = t.packed(x)
                found = np.frombuffer(raw, "<u4")
                n.append(len(found))
                if ids:
                    own.append(found.astype(np.int32))
                packed.append(hashlib.sha256(raw).hexdigest())
                text.append(hashlib.sha256(t.decode(found.tolist()).encode()).hexdigest())
            made = [pa.array(n, pa.int64()), *([pa.array(own, new["ids"])] if ids else []), pa.array(packed, pa.string()), pa.array(text, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *made], names=[*names, *new])

    kinds = {"n_tokens": "long", "ids": "array<int>", "ids_sha256": "string", "decoded_sha256": "string"}
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[1:]] + [f"{k} {kinds[k]}" for k in new])
    return common.arrow_map(rows, run, schema)
