"""Public tokenizer files: ids and pre-tokens."""

from __future__ import annotations

import json
from functools import cached_property, lru_cache

import numpy as np

#: Fixed value: the pre-token pattern that a byte-level pre-tokenizer with ``use_regex`` stands for.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Runs of white space from this length on go to the tokenizers library: the faster one's regex gives up
#: at a million characters.
LONG_BLANK = 100_000


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies print bytes as visible characters: printable ones as themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class ByteLevelBPE:
    """A byte-level BPE .json whose ids are merge ranks: the same ids as the tokenizers library, several times faster."""

    def __init__(self, spec: dict, path: str) -> None:
        import regex
        import tiktoken

        self.path = path
        self.long_blank = regex.compile(rf"\s{{{LONG_BLANK}}}")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        byte = _byte_of_char()
        ranks = {bytes(byte[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in self.special}
        self.coder = tiktoken.Encoding("file", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens=self.special)
        self.pattern = regex.compile(BYTE_LEVEL)
        self.splitter = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None

    @cached_property
    def library(self) -> Library:
        """Loaded by the first text that needs it: few do, and each Python worker would hold it."""
        return Library(self.path)

    @staticmethod
    def fits(spec: dict) -> bool:
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        plain = all(t["special"] and not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in spec["added_tokens"])
        if not (plain and spec.get("normalizer") is None and model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not model.get("ignore_merges")):
            return False
        vocab = model["vocab"]
        joined = ("".join(m.split(" ")) if isinstance(m, str) else "".join(m) for m in model["merges"])
        return all(vocab.get(w) == 256 + i for i, w in enumerate(joined))

    def ids(self, text: str) -> np.ndarray:
        if len(text) >= LONG_BLANK and self.long_blank.search(text):
            return self.library.ids(text)
        return self.coder.encode_to_numpy(text, allowed_special="all")

    def count_piece(self, piece: str) -> int:
        """Pieces of one pre-token."""
        if len(piece) >= LONG_BLANK:
            return self.library.count_piece(piece)
        return len(self.coder.encode_ordinary(piece))

    def pretokens(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens, and the number of special strings between them."""
        if self.splitter is None or not self.splitter.search(text):
            return self.pattern.findall(text), 0
        parts = self.splitter.split(text)
        return [p for part in parts for p in self.pattern.findall(part)], len(parts) - 1


class Library:
    """Any other .json: the tokenizers library itself."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()

    def ids(self, text: str) -> np.ndarray:
        return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def count_piece(self, piece: str) -> int:
        return len(self.tok.encode(piece, add_special_tokens=False).ids)


class Pieces:
    """A sentencepiece .model."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)

    def ids(self, text: str) -> np.ndarray:
        return np.asarray(self.sp.encode([text], num_threads=1)[0], dtype=np.uint32)

    def count_piece(self, piece: str) -> int:
        return len(self.sp.encode([piece], num_threads=1)[0])


@lru_cache(maxsize=4)
def load(path: str):
    """The tokenizer of a file, once per Python worker."""
    if path.endswith(".model"):
        return Pieces(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return ByteLevelBPE(spec, path) if ByteLevelBPE.fits(spec) else Library(path)
