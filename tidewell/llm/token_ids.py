"""Token ids of whole texts, as the tokenizers library gives them.

Where a byte-level vocabulary's ids are its merges' ranks, ``tiktoken`` gives the same ids from the same text several times
faster. Texts that it can't take (they hold an added token's content, or a run of white space so long that its matcher
gives up) go through ``tokenizers`` itself. Every text is encoded whole, from its own bytes.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import regex

from . import textkit

_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
#: Runs of white space that only ``tokenizers`` reads.
_WIDE = regex.compile(r"\s{20000}")


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class TextEncoder:
    """Ids of the rows of a block. ``tokenizers`` is loaded only for texts that ``fast`` can't take: workers live on, and the vocabulary with them."""

    def __init__(self, path: str, fast=None, added: tuple[str, ...] = ()):
        self.path, self.fast, self.added, self.tokenizer = path, fast, added, None

    def encode(self, text: str) -> list[int]:
        if self.fast is None or any(t in text for t in self.added) or (len(text) >= 20000 and _WIDE.search(text)):
            return self.whole(text)
        return self.fast(text)

    def whole(self, text: str) -> list[int]:
        self.tokenizer = self.tokenizer or _tokenizer(self.path)
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def block(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block, and the first of each row."""
        raw = data.tobytes()
        rows = [np.array(self.encode(raw[a:b].decode()), np.uint32) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
        return np.concatenate([*rows, np.zeros(0, np.uint32)]), np.append(0, np.cumsum([len(r) for r in rows], dtype=np.int64))


def _rank_encoder(path: str):
    """An encoder of plain texts by ``tiktoken``, if the vocabulary's ids are its merges' ranks; then both libraries give the same ids."""
    from .bpe_automaton import byte_characters

    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    vocabulary = model["vocab"]
    code = {c: b for b, c in enumerate(byte_characters())}
    plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
    if not plain or any(vocabulary.get(u + v) != 256 + k for k, (u, v) in enumerate(merges)) or len(vocabulary) != 256 + len(merges):
        return None
    import tiktoken

    ranks = {bytes(code[c] for c in token): i for token, i in vocabulary.items()}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("texts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@lru_cache(maxsize=2)
def text_encoder(path: str) -> TextEncoder:
    """Texts get the ids that ``tokenizers`` gives with ``encode(text, add_special_tokens=False)``."""
    held = json.loads(_tokenizer(path).to_str())
    fast = _rank_encoder(path) if held["pre_tokenizer"] == _BYTE_LEVEL and held["normalizer"] is None else None
    encoder = TextEncoder(path, fast, tuple(t["content"] for t in held["added_tokens"]))
    del held
    textkit.release()
    return encoder


def id_type(path: str) -> str:
    """The narrowest little-endian type that holds every id of a vocabulary, as NumPy names it."""
    with open(path, encoding="utf-8") as file:
        held = json.load(file)
    largest = max([*held["model"]["vocab"].values(), *(t["id"] for t in held["added_tokens"])])
    return "<u2" if largest <= 0xFFFF else "<u4"
