"""Token ids by a public tokenizer, one white-space chunk at a time.

The tokenizer drops white space, none of its tokens spans any, and its special strings hold none, so the ids of a text
are those of its chunks in order. Chunks repeat much more than texts do: each Python worker keeps a bounded table of
those it has encoded. Special strings in a chunk are handled as by default, since the library encodes the chunk.

Three more facts spare encoding: the tokenizer lower-cases (A-Z are lowered here unless the chunk may hold a special
string), a single stop after an ASCII letter is a token run of its own, and a chunk of letters up to U+00FF is one word
that no normaliser but lower-casing changes, so the library's model can be asked for it directly.
"""

from __future__ import annotations

import numpy as np

MAX_CHUNKS = 600_000
STOPS = frozenset(b".,;:!?")
#: byte -> its character in a byte-level vocabulary: itself where that is visible, else the next from U+0100 on
VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARACTERS = {b: chr(b) for b in VISIBLE} | {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(VISIBLE)))}
_tables: dict[tuple, "ChunkTable"] = {}


class ChunkTable(dict):
    """Chunk -> ids as little-endian unsigned 32-bit bytes. Beyond ``limit`` chunks, new ones are encoded each time."""

    def __init__(self, tokenizer_json: str, limit: int = MAX_CHUNKS):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        super().__init__()
        self.limit = limit
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.model = self.tokenizer.model
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def __missing__(self, chunk: bytes) -> bytes:
        plain = chunk if b"<|" in chunk else chunk.lower()
        if len(chunk) > 1 and chunk[-1] in STOPS and 97 <= plain[-2] <= 122:
            packed = self[plain[:-1]] + self[plain[-1:]]
        elif plain != chunk:
            packed = self[plain]
        else:
            text = chunk.decode("utf-8")
            if chunk.isalpha():
                ids = [t.id for t in self.model.tokenize(text)]
            elif text.isalpha() and max(text) <= "\xff":
                ids = [t.id for t in self.model.tokenize("".join(BYTE_CHARACTERS[b] for b in text.lower().encode()))]
            else:
                ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            packed = np.array(ids, dtype="<u4").tobytes()
        if len(self) < self.limit:
            self[chunk] = packed
        return packed


def chunk_table(key: str, tokenizer_json: str) -> ChunkTable:
    """The table of this Python worker for the tokenizer that ``key`` names; it outlives a task."""
    if key not in _tables:
        _tables.clear()
        _tables[key] = ChunkTable(tokenizer_json)
    return _tables[key]


def encode(table: ChunkTable, text: bytes) -> bytes:
    """The ids of a text in UTF-8, packed."""
    return b"".join(map(table.__getitem__, text.split()))


def read_tokenizer(path: str) -> tuple[str, str]:
    """(version digest, JSON) of a tokenizer file. The digest also covers the library's version."""
    import hashlib

    import tokenizers

    with open(path, encoding="utf-8") as f:
        text = f.read()
    return hashlib.sha256(f"{tokenizers.__version__}\n{text}".encode()).hexdigest(), text
