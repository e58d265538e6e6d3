"""Byte-pair encoding as a deterministic automaton over tokens.

``MergeAutomaton`` is compiled by one gadget for each merge, in order. The automaton starts as one state with an arc for each
symbol. A state stands for the token that was read last; its arcs say which tokens may follow, and lead to their states. The
gadget of a merge (u, v) -> w gives the arc w to every state with an arc u from which v can follow, lets w lead where v led, and
takes the arc v from the state behind u. So each text has exactly one accepted path, the one that merging gives, and so has
each beginning of a text.

All states with all their arcs would be a table of 24 thousand by 49 thousand entries. A gadget is therefore stored as its
facts (what w is made of, when, and which arc went), and ``_compile`` works out the arcs that a block asks for from the
gadgets, all at once, into the transition table, where they stay. Labels are found by a trie that is a table too. Encoding steps
all words of a block through both tables together, place by place: of the arcs that end at a place exactly one is accepted,
so nothing is searched or undone. Decoding writes the arcs' labels.

Defined results: a null or empty text, or one of white space alone, has no tokens and decodes to nothing. Rows are
encoded one by one, equal or not. Texts are encoded whole; equality of words is that of their bytes. A null doc_id stays null.
An empty table gives an empty result. Only the id and the text are read, whatever the other columns are called.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import textkit
from .common import texts


def byte_characters() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte: itself if printable, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + rest.index(b)) for b in range(256)]


class Table:
    """Numbers from 0 on by 64-bit key, open-addressed in two arrays; keys are put in and looked up by the array."""

    def __init__(self, bits: int = 12):
        self.size = 0
        self._empty(bits)

    def _empty(self, bits: int) -> None:
        self.bits, self.mask = bits, (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values of keys, -1 for those that aren't there."""
        slot = self._slots(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.values[slot], -1)
        rest = np.flatnonzero((held != keys) & (held >= 0))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & self.mask
            held = self.keys[slot[rest]]
            hit = held == keys[rest]
            out[rest[hit]] = self.values[slot[rest[hit]]]
            rest = rest[~hit & (held >= 0)]
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Put in distinct keys that aren't there yet."""
        self.size += len(keys)
        if 2 * self.size > self.mask:
            used = np.flatnonzero(self.keys >= 0)
            keys, values = np.concatenate([self.keys[used], keys]), np.concatenate([self.values[used], values])
            self._empty((4 * self.size).bit_length())
        slot, rest = self._slots(keys), np.arange(len(keys))
        while len(rest):
            free = rest[self.keys[slot[rest]] < 0]
            self.keys[slot[free]] = keys[free]
            mine = self.keys[slot[rest]] == keys[rest]
            self.values[slot[rest[mine]]] = values[rest[mine]]
            rest = rest[~mine]
            slot[rest] = (slot[rest] + 1) & self.mask


#: Symbols: the bytes, and the bytes as the last of a word.
SYMBOLS = 512
#: Longer pieces are stepped one by one.
LONG = 256
#: Arcs that a worker's transition table holds before it is begun anew.
TABLE_ARCS = 1 << 21


class MergeAutomaton:
    """The automaton of a vocabulary. State 0 is the start, state t + 1 the one behind token t."""

    def __init__(self, vocabulary: dict[str, int], merges: list, end: str = ""):
        self.end = end
        self.size = max(vocabulary.values()) + 1
        self.left, self.right, self.born = (np.full(self.size, -1, np.int64) for _ in range(3))
        gone: dict[int, int] = {}
        made = set()
        for rank, pair in enumerate(merges):
            u, v = pair.split(" ") if isinstance(pair, str) else pair
            w = vocabulary[u + v]
            if w in made:
                raise ValueError(f"two merges make token {w}")
            made.add(w)
            self.left[w], self.right[w], self.born[w] = vocabulary[u], vocabulary[v], rank
            gone[vocabulary[u] * self.size + vocabulary[v]] = rank
        self.gone = Table()
        self.gone.add(np.fromiter(gone, np.int64, len(gone)), np.fromiter(gone.values(), np.int32, len(gone)))
        self.arcs = Table()
        self._labels(vocabulary, made)

    def _labels(self, vocabulary: dict[str, int], made: set[int]) -> None:
        """The trie of the labels, by symbols: ``trie`` from node and symbol to node, ``token`` by node."""
        code = {c: b for b, c in enumerate(byte_characters())}
        nodes: dict[int, int] = {}
        token = [-1]
        for text, t in vocabulary.items():
            last = bool(self.end) and text.endswith(self.end)
            symbols = [code[c] for c in (text[: -len(self.end)] if last else text)]
            if t not in made and len(symbols) != 1:
                continue
            symbols[-1] += 256 * last
            node = 0
            for s in symbols:
                key = node * SYMBOLS + s
                if key not in nodes:
                    nodes[key] = len(token)
                    token.append(-1)
                node = nodes[key]
            token[node] = t
        self.trie = Table()
        self.trie.add(np.fromiter(nodes, np.int64, len(nodes)), np.fromiter(nodes.values(), np.int32, len(nodes)))
        self.token = np.array(token)

    def _compile(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether y follows x when all gadgets are in place. Each step goes back to before the younger of the two was made."""
        x, y = x.copy(), y.copy()
        out = np.ones(len(x), bool)
        now = np.full(len(x), 1 << 40)
        rest = np.arange(len(x))
        while len(rest):
            a, b = x[rest], y[rest]
            gone = self.gone.get(a * self.size + b)
            dead = (gone >= 0) & (gone < now[rest])
            out[rest[dead]] = False
            made_a, made_b = self.born[a], self.born[b]
            on = ~dead & ((made_a >= 0) | (made_b >= 0))
            rest, a, b, made_a, made_b = rest[on], a[on], b[on], made_a[on], made_b[on]
            x[rest] = np.where(made_a >= made_b, self.right[a], a)
            y[rest] = np.where(made_b >= made_a, self.left[b], b)
            now[rest] = np.where(made_b > made_a, made_b + 1, made_a)
        return out

    def step(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        """The states behind arcs, 0 where a state has no such arc."""
        key = state * self.size + token
        to = self.arcs.get(key)
        if (to < 0).any():
            new = np.unique(key[to < 0])
            x, y = new // self.size - 1, new % self.size
            there = x < 0
            there[~there] = self._compile(x[~there], y[~there])
            self.arcs.add(new, np.where(there, y + 1, 0))
            to = self.arcs.get(key)
        return to

    def _arcs_in(self, symbols: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(from, to, token): all labels that stand in the pieces; stop is each place's end of piece."""
        at, node, width = np.arange(len(symbols)), np.zeros(len(symbols), np.int64), 0
        found = []
        while len(at):
            node = self.trie.get(node * SYMBOLS + symbols[at + width])
            on = node >= 0
            at, node, width = at[on], node[on].astype(np.int64), width + 1
            token = self.token[node]
            some = token >= 0
            found.append((at[some], at[some] + width, token[some]))
            on = at + width < stop[at]
            at, node = at[on], node[on]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all pieces, and the first of each piece. No piece is empty."""
        if not pieces:
            return np.zeros(0, np.int64), np.zeros(1, np.int64)
        if self.arcs.size > TABLE_ARCS:
            self.arcs = Table()
        size = np.array([len(p) for p in pieces])
        first = np.append(0, np.cumsum(size))
        symbols = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
        if self.end:
            symbols[first[1:] - 1] += 256
        piece = np.repeat(np.arange(len(pieces)), size)
        begin, end, token = self._arcs_in(symbols, first[1:][piece])
        owner = piece[begin]
        # Arcs by the place in the piece where they end; a piece has one place more than symbols.
        order = np.argsort(end - first[owner], kind="stable")
        begin, end, token, owner = begin[order], end[order], token[order], owner[order]
        place = end - first[owner]
        begin, end = begin + owner, end + owner
        state, by = np.full(len(symbols) + len(pieces), -1), np.full(len(symbols) + len(pieces), -1)
        start = first[:-1] + np.arange(len(pieces))
        state[start] = 0
        long = size[owner] > LONG
        some = np.flatnonzero(~long)
        bounds = np.searchsorted(place[some], np.arange(1, LONG + 2))
        for k in range(int(size[size <= LONG].max(initial=0))):
            e = some[bounds[k] : bounds[k + 1]]
            e = e[state[begin[e]] >= 0]
            to = self.step(state[begin[e]], token[e])
            e, to = e[to > 0], to[to > 0]
            state[end[e]], by[end[e]] = to, e
        known: dict[tuple[int, int], int] = {}
        for e in np.flatnonzero(long).tolist():
            if (s := int(state[begin[e]])) >= 0:
                key = s, int(token[e])
                to = known.get(key)
                if to is None:
                    to = known[key] = int(self.step(np.array([s]), token[e : e + 1])[0])
                if to:
                    state[end[e]], by[end[e]] = to, e
        # The path of each piece, from its end.
        at, which, tokens, owners = first[1:] + np.arange(len(pieces)), np.arange(len(pieces)), [], []
        while len(at):
            e = by[at]
            if (e < 0).any():
                raise ValueError(f"no path for {pieces[int(which[np.flatnonzero(e < 0)[0]])]!r}")
            tokens.append(token[e])
            owners.append(which)
            at = begin[e]
            on = at > start[which]
            at, which = at[on], which[on]
        tokens, owners = np.concatenate(tokens[::-1]), np.concatenate(owners[::-1])
        return tokens[np.argsort(owners, kind="stable")], np.append(0, np.cumsum(np.bincount(owners, minlength=len(pieces))))


class WordEncoder:
    """Texts of a lower-casing word tokenizer: white space only separates, so each word between it is encoded alone."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        model = held["model"]
        self.automaton = MergeAutomaton(model["vocab"], model["merges"], model.get("end_of_word_suffix") or "")
        self.labels = {i: t for t, i in model["vocab"].items()} | {t["id"]: t["content"] for t in held["added_tokens"]}
        self.added = {t["content"]: t["id"] for t in held["added_tokens"]}
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None
        # White space is what Unicode calls so; the expressions of Python know four control characters more.
        white = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
        self.pieces = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{white}\p{{L}}\p{{N}}]+")

    def _pieces(self, text: str) -> list[bytes]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return [p.encode() for p in self.pieces.findall(text.lower())]

    def encode(self, words: list[str]) -> list[list[int]]:
        """The ids of each word."""
        number: dict[bytes, int] = {}
        parts: list[list[int]] = []
        for word in words:
            own: list[int] = []
            for part in [word] if self.split_added is None or "<" not in word else self.split_added.split(word):
                # An added token is the number -1 - id.
                own += [-1 - self.added[part]] if part in self.added else [number.setdefault(p, len(number)) for p in self._pieces(part)]
            parts.append(own)
        flat, first = self.automaton.encode(list(number))
        ids, at = flat.tolist(), first.tolist()
        return [[i for k in own for i in (ids[at[k] : at[k + 1]] if k >= 0 else (-1 - k,))] for own in parts]

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.labels[i] for i in ids])


TABLE_WORDS = 500_000


@lru_cache(maxsize=2)
def _kept(path: str) -> tuple[WordEncoder, dict[bytes, tuple[int, bytes, bytes]]]:
    """The encoder, and its words so far, that a worker keeps from task to task."""
    return WordEncoder(path), {}


def coded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids (decimal, joined by one space) and of the text decoded from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, table = _kept(path)
        for rows, data, offs in textkit.blocks(batches):
            if len(table) > TABLE_WORDS:
                table.clear()
            words = textkit.Words(data, offs)
            distinct, which = words.distinct, words.number[0]
            missing = [w for w in distinct if w not in table]
            for word, ids in zip(missing, encoder.encode([w.decode() for w in missing]), strict=True):
                table[word] = len(ids), " ".join(map(str, ids)).encode(), encoder.decode(ids).encode()
            entries = [table[w] for w in distinct]
            sizes = np.array([e[0] for e in entries], np.int64)[which]
            total = np.append(0, np.cumsum(sizes))
            id_text, decoded = [e[1] for e in entries], [e[2] for e in entries]
            # A word without tokens (of characters that all count as white space) leaves no gap.
            some = np.flatnonzero(sizes > 0)
            number = which[some].tolist()
            bounds = np.searchsorted(some, words.first)
            one, two = [], []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                part = number[a:b]
                one.append(hashlib.sha256(b" ".join([id_text[k] for k in part])).hexdigest())
                two.append(hashlib.sha256(b" ".join([decoded[k] for k in part])).hexdigest())
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(total[words.first])), pa.array(one, pa.string()), pa.array(two, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
