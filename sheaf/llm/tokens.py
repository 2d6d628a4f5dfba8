"""Byte-level BPE encoding with a public vocabulary; ids equal those of the vocabulary's tokenizers file as it stands.

The ranks give the ids of that file several times faster. Its one special token is a token of its own wherever a text holds
its string, and the text on both sides of it is split as if it ended and began there. Runs of white space of any length
are encoded without the split's regular expression, whose backtracking is bounded.
"""

from __future__ import annotations

import base64
import functools
import re

import numpy as np

#: File of the public vocabulary, by the name under which its package knows it.
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed values of the vocabulary: its special token and that token's id; Unicode's White_Space.
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: White space from this length on is encoded as the pieces that the split would make of it.
LONG_RUN = 4096

_RUN = re.compile(f"[{WHITE}]{{{LONG_RUN},}}")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=2)
def encoder(path: str | None = None):
    """One encoder for each Python worker, of text without special tokens."""
    import public_tokenizers
    import tiktoken

    with open(path or vocabulary_path(), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def piece_ids(piece: str) -> list[int]:
    """The ids of one pre-token, whatever its length."""
    return [SPECIAL_ID] if piece == SPECIAL else encoder()._encode_single_piece(piece)


def _part(text: str) -> np.ndarray:
    """The ids of a text without special tokens."""
    enc, at, out = encoder(), 0, []
    if len(text) >= LONG_RUN:
        for run in _RUN.finditer(text):
            out.append(enc.encode_to_numpy(text[at : run.start()]))
            # the last character of a run belongs to what follows it
            at = run.end() if run.end() == len(text) else run.end() - 1
            out.append(np.array(enc._encode_single_piece(text[run.start() : at]), np.uint32))
    if not out:
        return enc.encode_to_numpy(text)
    return np.concatenate([*out, enc.encode_to_numpy(text[at:])])


def token_ids(text: str | None) -> np.ndarray:
    """The ids of a text, special tokens included."""
    if not text:
        return np.empty(0, np.uint32)
    if SPECIAL not in text:
        return _part(text)
    out = []
    for part in text.split(SPECIAL):
        out += [_part(part), np.array([SPECIAL_ID], np.uint32)]
    return np.concatenate(out[:-1])


@functools.lru_cache(maxsize=1)
def splitter():
    """The vocabulary's split of a text into pre-tokens, with the special token as one more kind."""
    import public_tokenizers
    import regex

    special = re.escape(SPECIAL)
    letters, rest = public_tokenizers.PATTERN.split(r"| ?[^\s\p{L}\p{N}]+|")
    if rest != r"\s+(?!\S)|\s+":
        raise ValueError("the vocabulary's split is another one")
    symbols = rf" ?(?:(?!{special})[^{WHITE}\p{{L}}\p{{N}}])+"
    return regex.compile(rf"{special}|{letters}|{symbols}|[{WHITE}]+(?=[{WHITE}]|\Z|{special})|[{WHITE}]+")
