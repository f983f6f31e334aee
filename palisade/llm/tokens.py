"""Token ids of the public tokenizers, with a memory of the pieces between single spaces.

No token of either kind of vocabulary holds a space after a visible character, so a text may be cut
before any single space that stands between two visible characters: the pieces' ids, joined, are the
text's. Distinct pieces are few, and each is encoded once a task.
"""

from __future__ import annotations

import os
import re

#: A single space between characters that every library takes for visible.
CUT = re.compile("(?<=[!-~À-ɏ]) (?=[!-~À-ɏ])")
#: Pieces that a task remembers, and the longest of them in characters.
REMEMBERED, LONGEST = 400_000, 64


def file_of(name: str) -> str:
    """A tokenizer's file: a path, or the name of one of the public files of the worker."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_tokenizer(name: str, plain: bool) -> object:
    """A tokenizer of the tokenizers library; with plain, special tokens' strings in texts are plain text."""
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    t = Tokenizer.from_file(file_of(name))
    t.encode_special_tokens = plain
    return t


def byte_values(t: object) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary.

    Its characters stand for bytes: visible ones of Latin-1 for themselves, the others, in order, for
    those from U+0100 on.
    """
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(own)]
    back = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}
    return [bytes(back[c] for c in t.id_to_token(i) or "") for i in range(t.get_vocab_size())]


def piece_tokenizer(name: str) -> object:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=file_of(name))


def piece_values(p: object) -> list[bytes]:
    """The bytes of each id of a piece vocabulary: U+2581 is a space, a byte piece its byte."""
    return [bytes([int(x[3:5], 16)]) if p.is_byte(i) else x.replace("▁", " ").encode() for i in range(p.get_piece_size()) for x in [p.id_to_piece(i)]]
